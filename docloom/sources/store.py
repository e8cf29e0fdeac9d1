"""Vector stores: vectors with metadata as a table that is added to, deleted from, searched, saved and loaded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import search
from docloom.plumbing import written


class FlatStore:
    """Exact search. A store is a value: adding and deleting give another one, so a failed step leaves the one before as it was."""

    kind = "flat"

    def __init__(self, rows: DataFrame, size: int, metric: str = "cosine"):
        if size < 1 or metric not in search.METRICS:
            raise ValueError("a store needs vectors of one number or more and a known metric")
        self.rows, self.size, self.metric = rows, size, metric

    @classmethod
    def empty(cls, spark: SparkSession, size: int, metric: str = "cosine") -> FlatStore:
        return cls(spark.createDataFrame([], "vec_id long, embedding array<double>"), size, metric)

    def _with(self, rows: DataFrame) -> FlatStore:
        return type(self)(rows, self.size, self.metric)

    def add(self, new: DataFrame) -> FlatStore:
        """With the rows of ``new`` (vec_id, embedding) in place of those with the same vec_id. Wrong lengths, nulls and numbers that are not finite are refused."""
        new = new.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        bad = F.col("vec_id").isNull() | F.col("embedding").isNull() | (F.size("embedding") != self.size) | F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        wrong = new.where(F.coalesce(bad, F.lit(True))).count()
        if wrong:
            raise ValueError(f"{wrong} vectors are not {self.size} finite numbers with an id")
        return self._with(self.rows.join(new.select("vec_id"), "vec_id", "left_anti").unionByName(new))

    def delete(self, ids: DataFrame) -> FlatStore:
        """Without the rows whose vec_id is among ``ids``; ids that are not there do nothing."""
        return self._with(self.rows.join(ids.select("vec_id"), "vec_id", "left_anti"))

    def search(self, queries: DataFrame, k: int, **how) -> DataFrame:
        """query_id, vec_id, score and rank of the ``k`` nearest of each of ``queries`` (vec_id, embedding)."""
        return search.nearest(queries, self.rows, k, self.metric, **how)

    def stats(self) -> dict:
        return {"kind": self.kind, "size": self.size, "metric": self.metric, "vectors": self.rows.count()}

    def save(self, path: str) -> None:
        """Rows as Parquet in ``path``/rows, and what the store is in ``path``/store."""
        spark = self.rows.sparkSession
        self.rows.write.mode("errorifexists").parquet(f"{path}/rows")
        spark.createDataFrame([(self.kind, self.size, self.metric)], "kind string, size int, metric string").coalesce(1).write.json(f"{path}/store")  # last: a store without it was not finished

    def settled(self) -> FlatStore:
        """The same rows, written to the shared folder, so that a long line of changes is not computed again."""
        return self._with(written(self.rows, "store"))


class ListStore(FlatStore):
    """Search in inverted lists; the recall that it aims at is measured when it searches."""

    kind = "lists"

    def search(self, queries: DataFrame, k: int, **how) -> DataFrame:
        return search.nearest_by_lists(queries, self.rows, k, **how) if self.metric == "cosine" else super().search(queries, k, **how)


KINDS = {c.kind: c for c in (FlatStore, ListStore)}


def store(kind: str, spark: SparkSession, size: int, metric: str = "cosine") -> FlatStore:
    """An empty store of a known ``kind``."""
    if kind not in KINDS:
        raise ValueError(f"unknown store {kind}; known: {', '.join(KINDS)}")
    return KINDS[kind].empty(spark, size, metric)


def load(spark: SparkSession, path: str) -> FlatStore:
    """A store that was saved in ``path``."""
    what = spark.read.schema("kind string, size int, metric string").json(f"{path}/store").first()
    return KINDS[what.kind](spark.read.schema("vec_id long, embedding array<double>").parquet(f"{path}/rows"), what.size, what.metric)
