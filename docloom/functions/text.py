"""Text as column expressions: cleaning, hashing, counting, splitting. All stay in the JVM but the two that cut chunks one after the other."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"
#: Entities that pages use, in the order in which they are replaced; the ampersand comes last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
#: Typographic signs and their plain forms.
SIGNS = ("“”‘’–—…", "\"\"''--.")


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, SPACE, " ")


def chunk_id(c: Column, length: int = 16) -> Column:
    """A content id: the same for texts that differ in case, white space or punctuation only."""
    plain = F.regexp_replace(collapse(F.lower(strip(c))), r"(?U)[^\w\s]", "")
    return F.substring(F.sha2(plain, 256), 1, length)


def digest(c: Column, algorithm: str = "sha256", length: int | None = None) -> Column:
    """Hex digest by md5, sha1, sha256 or sha512, cut to ``length`` if given."""
    made = {"md5": F.md5, "sha1": F.sha1, "sha256": lambda x: F.sha2(x, 256), "sha512": lambda x: F.sha2(x, 512)}[algorithm](c)
    return made if length is None else F.substring(made, 1, length)


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?U)\b\w+\b"), F.lit(0))


def token_count(c: Column) -> Column:
    """Number of words, the count to use where no tokenizer is at hand."""
    return F.size(words(c)).cast("long")


def sentences(c: Column) -> Column:
    """Sentences with their marks, and what follows the last mark; trimmed, none empty."""
    # The end of the text ends a match as well: without that, a long tail would be searched again from each of its places.
    found = F.regexp_extract_all(c, F.lit(r"[^.!?]+(?:[.!?]+|\z)"), F.lit(0))
    return F.filter(F.transform(found, strip), lambda s: s != "")


def ocr_clean(c: Column) -> Column:
    """Frequent misreadings put right: | as I, 0 as O, 1 as l; control characters go. For scanned text only."""
    seen = F.regexp_replace(c, r"[\x00-\x08\x0E-\x1F\x7F]", "")
    return strip(collapse(F.translate(seen, "|01", "IOl")))


def plain_signs(c: Column) -> Column:
    return F.translate(c, *SIGNS)


def html_text(c: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags removed, entities resolved. Text without tags stays as it is."""
    bare = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</\1>", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->", ""), r"(?s)<[^>]+>", "")
    bare = reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES, bare)
    return F.when(c.contains("<") & c.contains(">"), bare).otherwise(c)


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def on_lines(c: Column, change) -> Column:
    return F.array_join(F.transform(lines(c), change), "\n")


def normal_space(c: Column) -> Column:
    """Line breaks as newlines, other white space as single blanks, trimmed lines, no empty lines at either end and none doubled."""
    one = F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"[\t\f\x0B  -   　]+", " ")
    trimmed = on_lines(F.regexp_replace(one, " +", " "), lambda s: F.trim(s))
    return F.regexp_replace(F.regexp_replace(trimmed, r"\n{2,}", "\n\n"), r"^\n+|\n+$", "")


def bullets(c: Column) -> Column:
    """Bullets of all kinds as one, numbering as ``n. ``."""

    def one(s: Column) -> Column:
        marked = F.regexp_replace(s, r"^[ ]*[•●◦▪*+–-] +", "• ")
        return F.regexp_replace(marked, r"^[ ]*\(?([0-9]{1,3})[.):] +", "$1. ")

    return on_lines(c, one)


def section_tags(c: Column) -> Column:
    """Lines that number or shout a heading, tagged."""

    def one(s: Column) -> Column:
        sub = s.rlike(r"^[0-9]+\.[0-9]+(\.[0-9]+)*\.? +\S")
        top = s.rlike(r"^[0-9]+\. +[A-Z][A-Z ]+$") | s.rlike(r"^[A-Z][A-Z ]{3,}$") | s.rlike(r"^(SECTION|ARTICLE|CHAPTER) +[0-9IVX]+")
        return F.when(sub, F.concat(F.lit("[SUBSECTION] "), s)).when(top, F.concat(F.lit("[SECTION] "), s)).otherwise(s)

    return on_lines(c, one)


#: Lines that repeat on every page of a document.
RUNNING_LINES = r"(?i)^(page [0-9]+( of [0-9]+)?|[0-9]+|confidential.*|draft.*|copyright.*|©.*|all rights reserved.*|internal use only.*)$"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it, in lambdas of its own too."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def without_running_lines(c: Column, share: float = 0.1) -> Column:
    """Without page headers and footers: lines of the usual kinds that occur more than twice and on over ``share`` of all lines."""

    def frequent(every: Column) -> Column:
        """Different running lines that occur often enough, at most ``1 / share`` of them: from runs of equal ones in order."""
        least = F.greatest(F.lit(2.0), F.lit(share) * F.size(F.filter(every, lambda s: F.trim(s) != "")))
        runs = lambda held: F.filter(F.transform(held, lambda s, k: F.when((k == 0) | (F.get(held, k - 1) != s), k)), lambda k: k.isNotNull())

        def long_runs(held: Column, heads: Column) -> Column:
            sized = F.transform(heads, lambda h, j: F.struct(F.get(held, h).alias("s"), (F.coalesce(F.get(heads, j + 1), F.size(held)) - h).alias("n")))
            return F.transform(F.filter(sized, lambda x: x["n"] > least), lambda x: x["s"])

        held = F.sort_array(F.filter(F.transform(every, lambda s: F.trim(s)), lambda s: s.rlike(RUNNING_LINES)))
        return bound(held, lambda held: bound(runs(held), lambda heads: long_runs(held, heads)))

    left = lambda every, often: F.when(F.size(often) > 0, F.filter(every, lambda s: ~F.array_contains(often, F.trim(s)))).otherwise(every)
    return F.array_join(bound(lines(c), lambda every: bound(frequent(every), lambda often: left(every, often))), "\n")


def table_pipes(c: Column) -> Column:
    """Columns set apart by blanks, in two lines or more that follow each other, set apart by bars instead."""
    wide = lambda s: s.rlike(r"\S {2,}\S")

    def all_of(every: Column) -> Column:
        def one(s: Column, k: Column) -> Column:
            near = wide(F.coalesce(F.get(every, k - 1), F.lit(""))) | wide(F.coalesce(F.get(every, k + 1), F.lit("")))
            return F.when(wide(s) & near, F.regexp_replace(strip(s), r" {2,}", " | ")).otherwise(s)

        return F.transform(every, one)

    return F.array_join(bound(lines(c), all_of), "\n")


def final_form(c: Column, newline: bool = True) -> Column:
    """Trimmed, with no more than one empty line in a row, and a newline at the end unless it is empty."""
    bare = strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))
    return F.when(bare == "", "").otherwise(F.concat(bare, F.lit("\n"))) if newline else bare


def preprocess(c: Column, *, html: bool = True, bullet_points: bool = True, running_lines: bool = True, sections: bool = False, tables: bool = False, newline: bool = True) -> Column:
    """The whole cleaning of a text, in a fixed order; null counts as empty. Doing it twice changes nothing."""
    c = plain_signs(F.coalesce(c, F.lit("")))
    c = html_text(c) if html else c
    c = table_pipes(c) if tables else c
    c = normal_space(c)
    c = bullets(c) if bullet_points else c
    c = section_tags(c) if sections else c
    c = without_running_lines(c) if running_lines else c
    return final_form(c, newline)


def parsed(c: Column) -> Column:
    """A parsed document's text: one line; empty if that is a number, shorter than three letters, or a running line."""
    one = strip(collapse(c))
    return F.when(one.rlike(RUNNING_LINES) | (F.length(one) < 3), "").otherwise(one)


#: What makes a text suspicious: one letter many times in a row, long runs of signs, long runs of digits.
SUSPICIOUS = (r"(?U)(\w)\1{5,}", r"(?U)[^\w\s]{5,}", r"[0-9]{10,}")


def quality(c: Column, patterns: tuple[str, ...] = SUSPICIOUS) -> Column:
    """score (0 to 1) and suspicious: matches of ``patterns`` cost by their share of the length, short and repetitive texts lose more."""
    size = F.greatest(F.length(c), F.lit(1))
    ratios = [F.regexp_count(c, F.lit(p)) / size for p in patterns]
    score = reduce(lambda s, r: s - F.lit(0.3) * r, ratios, F.lit(1.0))
    suspicious = reduce(lambda s, r: s | (r > 0.1), ratios, F.lit(False))
    split = F.filter(F.split(F.lower(c), SPACE), lambda w: w != "")
    repetitive = (F.size(split) > 10) & (F.size(F.array_distinct(split)) / F.greatest(F.size(split), F.lit(1)) < 0.5)
    score = F.when(F.length(c) < 50, score * 0.5).otherwise(score)
    score = F.when(repetitive, score * 0.7).otherwise(score)
    return F.struct(F.when(F.length(c) == 0, 0.0).otherwise(F.greatest(score, F.lit(0.0))).alias("score"), suspicious.alias("suspicious"))


def _window_ends(text: str, size: int, overlap: int, least: int) -> Iterator[tuple[int, int]]:
    start, n = 0, len(text)
    while n:
        end = stop = min(start + size, n)
        if stop < n and (blank := text.rfind(" ", start, stop) - start) > least:
            end = start + blank
        yield start, end
        if end >= n:
            return
        start = max(end - overlap, start + 1)


def fixed_chunks(c: Column, size: int = 1000, overlap: int = 100, least: int = 200) -> Column:
    """Windows of ``size`` characters as (index, start, end, content): a window ends at its last blank beyond ``least`` characters,
    the next begins ``overlap`` before that end; the last ends with the text. Windows shorter than ``least`` go.

    Over Arrow batches: each window depends on the one before, which expressions can only fold by copying what they have so far.
    """
    kind = pa.list_(pa.struct([("chunk_index", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("content", pa.string())]))

    @F.arrow_udf("array<struct<chunk_index:int,start:int,end:int,content:string>>")
    def cut(texts: pa.Array) -> pa.Array:
        def of(text: str | None) -> list[tuple] | None:
            kept = [(a, b) for a, b in _window_ends(text, size, overlap, least) if b - a >= least] if text is not None else None
            return kept and [(k, a, b, text[a:b]) for k, (a, b) in enumerate(kept)]

        return pa.array([of(x.as_py()) for x in texts], kind)

    return cut(c)


def _packed(sized: list[tuple[str, int]], most: int, least: int, overlap: int) -> Iterator[tuple[list[str], int]]:
    held: list[tuple[str, int]] = []
    total = 0
    for s, n in sized:
        if held and total + n > most:
            if total >= least:
                yield [x for x, _ in held], total
            kept = total = 0
            while kept < len(held) and total + held[-1 - kept][1] <= overlap:
                total += held[-1 - kept][1]
                kept += 1
            held = held[len(held) - kept :]
        held.append((s, n))
        total += n
    if total >= least:
        yield [x for x, _ in held], total


def sentence_chunks(c: Column, most: int = 256, least: int = 100, overlap: int = 30) -> Column:
    """Whole sentences packed into chunks of up to ``most`` words, as (index, content, words): a chunk of fewer than ``least`` words
    goes, and each begins with the sentences of up to ``overlap`` words that end the one before."""
    kind = pa.list_(pa.struct([("chunk_index", pa.int32()), ("content", pa.string()), ("words", pa.int64())]))

    @F.arrow_udf("array<struct<chunk_index:int,content:string,words:bigint>>")
    def packed(sized: pa.Array) -> pa.Array:
        def of(rows: list[dict] | None) -> list[tuple] | None:
            return None if rows is None else [(k, " ".join(x), n) for k, (x, n) in enumerate(_packed([(r["s"], r["n"]) for r in rows], most, least, overlap))]

        return pa.array([of(x.as_py()) for x in sized], kind)

    return packed(F.transform(sentences(c), lambda s: F.struct(s.alias("s"), F.size(words(s)).alias("n"))))


def terms(c: Column) -> Column:
    """Words for sparse search: lower case, split at white space."""
    return F.filter(F.split(F.lower(c), SPACE), lambda w: w != "")


def query_words(c: Column) -> Column:
    """Words of a query, lower case, of two letters or more."""
    return F.filter(words(F.lower(c)), lambda w: F.length(w) > 1)


def first_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(F.filter(F.split(c, SPACE), lambda w: w != ""), 1, n), " ")


def word_overlap(query: Column, c: Column) -> Column:
    """Share of the query's different words that the text has."""
    q, t = F.array_distinct(words(F.lower(query))), words(F.lower(c))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, t)) / F.size(q)).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Shared different words by all different words."""
    x, y = F.array_distinct(words(F.lower(a))), F.array_distinct(words(F.lower(b)))
    return F.when(F.size(F.array_union(x, y)) > 0, F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(0.0)


def distinct_words(c: Column) -> Column:
    return F.array_distinct(words(F.lower(c)))


def summary(query: Column, c: Column, most: int = 150) -> Column:
    """The sentences that share most words with the query, until ``most`` words are reached, in the order of their rank.

    ``query``: its ``distinct_words``, made before the join that brings query and text together, so once for a query.
    """
    share = lambda s: F.when(F.size(query) > 0, F.size(F.array_intersect(query, words(F.lower(s)))) / F.size(query)).otherwise(0.0)
    split = F.filter(F.transform(F.split(c, r"[.!?]+"), strip), lambda s: s != "")
    ranked = F.array_sort(F.transform(split, lambda s, k: F.struct((-share(s)).alias("o"), k.alias("k"), s.alias("s"), F.size(F.split(s, SPACE)).alias("n"))))
    kind = "struct<n:int,open:boolean,out:array<string>>"
    start = F.expr(f"cast(named_struct('n', 0, 'open', true, 'out', array()) as {kind})")

    def step(x: Column, s: Column) -> Column:
        fits = x["open"] & (x["n"] + s["n"] <= most)
        return F.struct(F.when(fits, x["n"] + s["n"]).otherwise(x["n"]).alias("n"), fits.alias("open"), F.when(fits, F.concat(x["out"], F.array(s["s"]))).otherwise(x["out"]).alias("out"))

    kept = F.aggregate(ranked, start, step, lambda x: x["out"])
    short = F.slice(split, 1, 3)
    return F.array_join(F.when(F.size(kept) > 0, kept).otherwise(short), ". ")
