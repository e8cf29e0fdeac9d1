"""Deterministic sharded WARC archives.

The same records give the same files, byte for byte, on any cluster: shard
bounds come from an exact histogram of record sizes over the ordering key
(never from a sample), records are sorted inside a shard, files roll when their
compressed size passes a limit, every header and digest is regenerated from the
record, and gzip members carry no clock.  A task writes under temporary names
that no other attempt shares and reports them; the reported files are written
down as a manifest, whose table keeps one attempt of each shard, and only then
get their names.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, written

#: Bytes of payload in a shard, and of compressed archive after which a new file begins.
SHARD_BYTES, ROLL_BYTES = 64 << 20, 32 << 20
#: Every record's WARC-Date unless another is given: archives must not depend on the clock.
DATE = "1970-01-01T00:00:00Z"

_MANIFEST = "shard int, seq int, temporary string, name string, records long, bytes long, sha256 string"
_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, shard int, seq int"


def filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a URI and the path in it. Any that pyarrow knows: file, hdfs, s3, gs."""
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else "file://" + posixpath.abspath(uri) if not uri.startswith("file:") else "file://" + uri[5:])


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _between(lows: np.ndarray, highs: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which of the ascending, disjoint spans lows..highs holds each id, -1 where none does."""
    at = np.searchsorted(lows, ids, side="right") - 1
    return np.where((at >= 0) & (ids <= highs[np.maximum(at, 0)]), at, -1)


@dataclass
class Layout:
    """Shards by page_id: ids up to ``upper[k]`` (the last: all others) go to ``count[k]`` shards from ``base[k]`` on; rows without id to the first ``nulls``.

    Where a group has several shards, one page_id alone (or none) is too heavy for a shard: its rows are dealt by the hash of url and digest."""

    upper: np.ndarray
    count: np.ndarray
    nulls: int

    def __post_init__(self):
        self.base = self.nulls + np.cumsum(self.count) - self.count

    @property
    def shards(self) -> int:
        return int(self.base[-1] + self.count[-1])

    def of(self, ids: np.ndarray, known: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        group = np.searchsorted(self.upper, ids, side="left")
        count, base = np.where(known, self.count[group], max(1, self.nulls)), np.where(known, self.base[group], 0)
        return (base + (mixed.view(np.uint64) % count.astype(np.uint64)).astype(np.int64)).astype(np.int32)


def _shards(rows: DataFrame, shard_bytes: int) -> Layout:
    """A layout from an exact histogram of sizes over page_id, refined wherever a cell is heavier than a shard.

    The driver sees some 100,000 cells at a time at most, whatever the number of rows; beyond 100,000 shards they get larger.
    """
    low, high, total, nulls = rows.agg(F.min("page_id"), F.max("page_id"), F.sum("size"), F.sum(F.when(F.col("page_id").isNull(), F.col("size")))).first()
    target = max(shard_bytes, (total or 0) // 100_000)
    nulls = -(-nulls // target) if (nulls or 0) > target else 0
    done, todo = [], [] if low is None or total <= target else [(int(low), int(high))]
    while todo:
        cells = max(4, 100_000 // len(todo)) if len(todo) > 1 else 4096
        lows, highs = (np.array(x, np.int64) for x in zip(*todo))
        widths = [max(1, -(-(b - a + 1) // cells)) for a, b in todo]
        wide = np.array(widths, np.uint64)

        @F.arrow_udf("long")
        def cell(ids: pa.Array) -> pa.Array:
            known, values = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()  # noqa: B023
            at = _between(lows, highs, values)  # noqa: B023
            off = (values.view(np.uint64) - lows.view(np.uint64)[at]) // wide[at]  # noqa: B023 (differences modulo 2 ** 64 are exact)
            return pa.array(at * cells + off.astype(np.int64), mask=~known | (at < 0))  # noqa: B023

        got = rows.groupBy(cell("page_id").alias("cell")).agg(F.sum("size").alias("size")).where("cell is not null").collect()
        last, todo = todo, []
        for code, size in sorted(map(tuple, got)):
            part, k = divmod(code, cells)
            a = last[part][0] + k * widths[part]
            b = min(last[part][1], a + widths[part] - 1)
            (todo if size > target and b > a else done).append((a, b, size) if size <= target or b == a else (a, b))
    upper, count, held = [], [], 0
    for a, b, size in sorted(done):
        if held and held + size > target:
            upper.append(a - 1)
            count.append(1)
            held = 0
        held += size
        if held > target:  # one id alone
            upper.append(b)
            count.append(-(-size // target))
            held = 0
    return Layout(np.array(upper, np.int64), np.array([*count, 1], np.int64), nulls)


def record(page_id: int | None, url: str | None, payload: bytes, length: int, digest: str, refers: int | None, kind: str, nth: int, date: str, refers_url: str | None = None) -> bytes:
    """One WARC/1.1 record; a revisit has no payload but names the record that has, and its page."""
    name = lambda *parts: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(31).join(map(repr, parts)))}>"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {name(page_id, url, digest, nth)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {length}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {'' if refers is None else refers}"]
        lines += [f"WARC-Refers-To: {name(refers, refers_url, digest, 0)}", f"WARC-Refers-To-Target-URI: {_uri(refers_url)}", f"WARC-Refers-To-Date: {date}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _uri(url: str | None) -> str:
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def information(name: str, date: str) -> bytes:
    """The warcinfo record that begins the file ``name``."""
    block = b"software: docloom\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'warcinfo' + chr(31) + name)}>", f"WARC-Date: {date}", f"WARC-Filename: {name}"]
    lines += [f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """A gzip member without name or time."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


class _Roll:
    """The files of one shard, under temporary names of this attempt."""

    def __init__(self, folder: str, shard: int, most: int, date: str):
        self.fs, self.folder = filesystem(folder)
        self.shard, self.most, self.date, self.attempt = shard, most, date, uuid.uuid4().hex
        self.out, self.files = None, []

    def add(self, member: bytes) -> None:
        if self.out is None:
            temporary = f"{self.folder}/_temporary/{self.shard:06d}-{len(self.files):06d}-{self.attempt}"
            self.fs.create_dir(f"{self.folder}/_temporary", recursive=True)
            self.out = self.fs.open_output_stream(temporary)
            self.files.append([self.shard, len(self.files), temporary, f"part-{self.shard:06d}-{len(self.files):06d}.warc.gz", 0, 0, hashlib.sha256()])
            self._put(gzip_member(information(self.files[-1][3], self.date)))
        now = self.files[-1]
        self._put(member)
        now[4] += 1
        if now[5] >= self.most:
            self.close()

    def _put(self, member: bytes) -> None:
        self.out.write(member)
        self.files[-1][5] += len(member)
        self.files[-1][6].update(member)

    def close(self) -> list[list]:
        if self.out is not None:
            self.out.close()
            self.out = None
        return [[*f[:6], f[6].hexdigest()] for f in self.files]


def write_warc(pages: DataFrame, folder: str, *, payload: str = "html", least: int = 0, date: str = DATE, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes a record for each row of ``pages`` (page_id, url, ``payload``) into ``folder``; returns its manifest.

    Payloads are UTF-8, null counts as empty. Of records with equal payloads of at least ``least`` bytes the one with
    the largest page_id (of equal ones, the largest url; a null is smaller than anything) is a response and the others
    revisit it; rows that repeat it in full follow it and revisit it too. Smaller payloads are always responses.
    Rows without page_id come first. An empty table gives no files. Other columns are left out. Rows of one page_id that are too
    many for a shard are dealt by the hash of url and digest, so they are sorted inside each of its shards only.
    ``folder`` is a URI that all executors reach; it must not hold an archive yet.
    """
    spark = pages.sparkSession
    body = F.encode(F.coalesce(pages[payload].cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), body.alias("body")).withColumn("size", F.octet_length("body"))
    narrow = rows.select("page_id", "url", "size", F.sha1("body").alias("digest"))
    layout = _shards(narrow, shard_bytes)
    # Who revisits whom, on narrow rows: a digest's copies are combined before they are dealt out.
    last = narrow.where(F.col("size") >= least).groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    same = F.struct("page_id", "url").eqNullSafe(F.col("first"))
    # Each row of the pages meets its verdict in the shard that writes it, so payloads move once.
    verdicts = narrow.where(F.col("size") >= least).join(last, "digest").where(~same).select("page_id", "url", "digest", F.col("first.page_id").alias("refers"), F.col("first.url").alias("refers_url")).distinct()
    none = F.lit(None)
    wide = verdicts.select("page_id", "url", "digest", F.lit(0).alias("kind"), none.cast("binary").alias("body"), "refers", "refers_url").unionByName(rows.select("page_id", "url", F.sha1("body").alias("digest"), F.lit(1).alias("kind"), "body", none.cast("long").alias("refers"), none.cast("string").alias("refers_url")))

    @F.arrow_udf("int")
    def shard_of(ids: pa.Array, mixed: pa.Array) -> pa.Array:
        return pa.array(layout.of(ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), mixed.to_numpy()))

    dealt = wide.withColumn("shard", shard_of("page_id", F.xxhash64("url", "digest"))).repartitionById(layout.shards, F.col("shard")).sortWithinPartitions("shard", "page_id", "url", "digest", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, verdict, before, nth = None, None, None, 0
        names = _names(_MANIFEST)
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "digest", "kind", "body", "refers", "refers_url", "shard")]
            for k in range(batch.num_rows):
                page_id, url, digest, kind, body, refers, refers_url, shard = (c[k].as_py() for c in columns)
                if roll is None or roll.shard != shard:
                    if roll is not None:
                        yield _batch(roll.close(), names, _MANIFEST_TYPES)
                    roll = _Roll(folder, shard, roll_bytes, date)
                key = (page_id, url, digest)
                if kind == 0:
                    verdict = (key, refers, refers_url)
                    continue
                nth = nth + 1 if before == key else 0
                before = key
                code = base64.b32encode(bytes.fromhex(digest)).decode()
                if verdict is not None and verdict[0] == key:
                    again, refers, refers_url = True, verdict[1], verdict[2]
                else:
                    again, refers, refers_url = nth > 0 and len(body) >= least, page_id, url
                roll.add(gzip_member(record(page_id, url, b"" if again else body, len(body), code, refers if again else None, "revisit" if again else "response", nth, date, refers_url)))
        if roll is not None:
            yield _batch(roll.close(), names, _MANIFEST_TYPES)

    manifest = written(dealt.mapInArrow(run, _MANIFEST), "warc-manifest")
    return _commit(manifest, folder)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
_MANIFEST_TYPES = [_ARROW[x.split()[1]] for x in _MANIFEST.split(", ")]
_RECORD_TYPES = [_ARROW[x.split()[1]] for x in _RECORD.split(", ")]


def _batch(rows: list, names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def _commit(manifest: DataFrame, folder: str) -> DataFrame:
    """Gives the files of the manifest their names; a file that has its name already is left, so it can be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                to = f"{root}/{row['name']}"
                if fs.get_file_info(to).type == pyarrow.fs.FileType.NotFound:
                    try:
                        fs.move(row["temporary"], to)
                    except OSError:
                        if fs.get_file_info(to).type == pyarrow.fs.FileType.NotFound:
                            raise
            yield batch

    named = written(manifest.mapInArrow(run, manifest.schema).select("shard", "seq", "name", "records", "bytes", "sha256"), "warc-committed")
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    named.coalesce(1).orderBy("name").write.mode("overwrite").json(f"{folder}/_manifest")
    if fs.get_file_info(f"{root}/_temporary").type != pyarrow.fs.FileType.NotFound:
        fs.delete_dir(f"{root}/_temporary")  # what attempts that were lost have left
    return named


def records_of(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an open ``.warc.gz``, a member at a time."""
    rest, inflate, plain = b"", zlib.decompressobj(31), []
    while True:
        data = rest or stream.read(1 << 20)
        if not data:
            break
        plain.append(inflate.decompress(data))
        rest = inflate.unused_data
        if inflate.eof:
            raw = b"".join(plain)
            head, _, block = raw.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
            yield fields, block[: int(fields["Content-Length"])]
            inflate, plain = zlib.decompressobj(31), []
    if plain and any(plain):
        raise ValueError("the archive ends inside a record")


def read_warc(manifest: DataFrame, folder: str, *, payload: bool = False) -> DataFrame:
    """One row for each record in the files of ``manifest``; digests of blocks and payloads are checked.

    With ``payload`` the bytes of responses come along; a revisit's are null.
    """
    names, types = _names(_RECORD) + ["payload"] * payload, _RECORD_TYPES + [pa.binary()] * payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        rows, held = [], 0
        for batch in batches:
            for file in batch.to_pylist():
                with fs.open_input_stream(f"{root}/{file['name']}", compression=None) as stream:
                    for fields, block in records_of(stream):
                        if f"sha1:{base32_sha1(block)}" != fields["WARC-Block-Digest"]:
                            raise ValueError(f"wrong block digest in {file['name']}")
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        body, kind = block.partition(b"\r\n\r\n")[2], fields["WARC-Type"]
                        if kind == "response" and f"sha1:{base32_sha1(body)}" != fields["WARC-Payload-Digest"]:
                            raise ValueError(f"wrong payload digest in {file['name']}")
                        number = lambda name: int(fields[name]) if fields.get(name) else None  # noqa: B023, E731
                        row = [number("X-Page-Id"), fields["WARC-Target-URI"], number("X-Payload-Length"), fields["WARC-Payload-Digest"][5:], kind, number("X-Refers-To-Page"), fields["WARC-Record-ID"], file["shard"], file["seq"]]
                        rows.append(row + [body if kind == "response" else None] * payload)
                        held += len(body) * payload
                        if len(rows) >= 5000 or held > 8 << 20:
                            yield _batch(rows, names, types)
                            rows, held = [], 0
        if rows:
            yield _batch(rows, names, types)

    files = manifest.repartition(max(1, min(10_000, manifest.count())), "name")
    return files.mapInArrow(run, _RECORD + ", payload binary" * payload)


def archived(pages: DataFrame) -> DataFrame:
    """``pages`` written as archives in the shared folder and read back."""
    folder = fresh_path(pages.sparkSession, "warc")
    return read_warc(write_warc(pages, folder), folder)
