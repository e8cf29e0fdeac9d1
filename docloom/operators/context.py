"""Context for a prompt: duplicates out, budgets kept, texts packed, queries expanded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text
from docloom.functions.vectors import cosine

#: Synonyms and abbreviations of the insurance and office domain; this library's own small tables.
SYNONYMS = [("coverage", ["protection", "cover"]), ("policy", ["contract", "plan"]), ("claim", ["request", "demand"]), ("cost", ["price", "expense"]), ("doctor", ["physician", "medic"]), ("deadline", ["due date", "time limit"]), ("start", ["begin", "commence"])]
ABBREVIATIONS = [("HR", "human resources"), ("IT", "information technology"), ("FAQ", "frequently asked questions"), ("SLA", "service level agreement"), ("KPI", "key performance indicator"), ("ETA", "estimated time of arrival")]


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def within_budget(df: DataFrame, group: list[str], order: list, tokens: Column, budget: int) -> DataFrame:
    """Rows while their running total stays within the budget; all after the first that breaks it go."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(tokens).over(w)).where(F.col("used") <= budget)


def truncated_to_budget(df: DataFrame, group: list[str], order: list, budget: int, least: int = 50, column: str = "text") -> DataFrame:
    """Rows within a budget of words; the one that breaks it is cut to what is left if that is more than ``least`` words."""
    n = F.size(F.filter(F.split(column, text.SPACE), lambda w: w != ""))
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = df.withColumn("words", n).withColumn("before", F.coalesce(F.sum("words").over(w), F.lit(0)))
    room = F.lit(budget) - F.col("before")
    whole = F.col("words") <= room
    kept = before.where(whole | ((F.col("before") < budget) & (room > least)))
    cut = F.array_join(F.slice(F.filter(F.split(column, text.SPACE), lambda w: w != ""), 1, F.greatest(room, F.lit(1)).cast("int")), " ")
    return kept.withColumn(column, F.when(whole, F.col(column)).otherwise(cut)).withColumn("words", F.least("words", room)).drop("before")


def greedy_distinct(df: DataFrame, group: list[str], threshold: float = 0.85) -> DataFrame:
    """Of each group's rows (id, score, embedding), in order of score, those whose cosine with every row kept so far is at most
    ``threshold``. A group is a result list of bounded length; its rows are folded in one expression."""
    rows = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("o"), "id", "score", "embedding")))
    kept = F.expr("cast(array() as array<struct<o:double,id:bigint,score:double,embedding:array<float>>>)")
    near = lambda k, x: F.exists(k, lambda y: cosine(y["embedding"], x["embedding"]) > threshold)
    fold = F.aggregate(rows, kept, lambda k, x: F.when(near(k, x), k).otherwise(F.concat(k, F.array(x))))
    return df.select(*group, F.col("id").cast("long"), F.col("score").cast("double"), F.col("embedding").cast("array<float>")).groupBy(*group).agg(fold.alias("k")).select(*group, F.explode("k").alias("x")).select(*group, "x.id", "x.score")


def clusters(df: DataFrame, group: list[str], *, linkage: str = "complete", threshold: float = 0.2) -> DataFrame:
    """Agglomerative clusters of each group's rows (id, score, embedding) and the row of best score in each.

    Complete linkage merges while the largest Euclidean distance stays below ``threshold``, ward while the growth of variance
    does. A group is a result list of some dozens of rows.
    """
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        x = np.stack([np.asarray(e, float) for e in pdf["embedding"]])
        members = [[k] for k in range(len(x))]

        def distance(a: list[int], b: list[int]) -> float:
            if linkage == "ward":
                gap = x[a].mean(0) - x[b].mean(0)
                return float(np.sqrt(2 * len(a) * len(b) / (len(a) + len(b)) * (gap @ gap)))
            return float(max(np.linalg.norm(x[i] - x[j]) for i in a for j in b))

        while len(members) > 1:
            d, i, j = min((distance(members[i], members[j]), i, j) for i in range(len(members)) for j in range(i + 1, len(members)))
            if d >= threshold:
                break
            members[i] += members.pop(j)
        label = {k: n for n, own in enumerate(members) for k in own}
        best = {min(own) for own in members}
        pdf["cluster"] = [label[k] for k in range(len(pdf))]
        pdf["best"] = [k in best for k in range(len(pdf))]
        return pdf[[*group, "id", "score", "cluster", "best"]]

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"{g} {kinds[g]}" for g in group), "id long", "score double", "cluster int", "best boolean"])
    return df.select(*group, "id", "score", "embedding").groupBy(*group).applyInPandas(run, schema)


def header(source: Column, clause: Column, page: Column, score: Column, place: Column) -> Column:
    """The line above a passage in a prompt; what is missing, and a score of zero, is left out."""
    parts = [F.concat(F.lit("Source "), place.cast("string")), F.concat(F.lit("Doc: "), source), F.concat(F.lit("Clause: "), clause), F.concat(F.lit("Page: "), page.cast("string")), F.when(score != 0, F.concat(F.lit("Score: "), F.format_string("%.3f", score)))]
    return F.concat(F.lit("["), F.concat_ws(" - ", *parts), F.lit("]"))


#: Prompts by task, and how models want them. Our own wording.
TEMPLATES = {"qa": "Use the passages to answer.\n\n{context}\n\nQuestion: {question}\nAnswer:", "summary": "Sum up what bears on: {question}\n\n{context}", "extract": "List the facts about {question}.\n\n{context}"}
WRAPPERS = {"plain": "{prompt}", "chat": "System: You answer from documents.\nUser: {prompt}\nAssistant:", "im": "<|im_start|>user\n{prompt}<|im_end|>\n<|im_start|>assistant\n"}


def prompt(task: str, model: str, context: Column, question: Column) -> Column:
    shape = WRAPPERS[model].replace("{prompt}", TEMPLATES[task])
    return reduce(lambda c, x: F.replace(c, F.lit(x[0]), x[1]), [("{question}", question), ("{context}", context)], F.lit(shape))


def expanded(queries: DataFrame, k: int = 3) -> DataFrame:
    """query_id, query, kind, confidence and place of up to ``k`` expansions of each query (query_id, text).

    The query itself (confidence 1), with a word replaced by each of its first two synonyms (0.8), with an abbreviation written
    out (0.9). Of expansions that are equal but for case the surest stays; the surest come first, the shorter of equals.
    """
    spark = queries.sparkSession
    words = queries.select("query_id", "text", F.explode(text.query_words(F.col("text"))).alias("w")).distinct()
    synonyms = spark.createDataFrame(SYNONYMS, "w string, s array<string>").select("w", F.explode(F.slice("s", 1, 2)).alias("s"))
    short = spark.createDataFrame(ABBREVIATIONS, "w string, s string").select(F.lower("w").alias("w"), "s")
    swapped = lambda t, kind, sure: words.join(F.broadcast(t), "w").select("query_id", F.expr("regexp_replace(text, concat('(?i)\\\\b', w, '\\\\b'), s, 1)").alias("query"), F.lit(kind).alias("kind"), F.lit(sure).alias("confidence"))
    every = queries.select("query_id", F.col("text").alias("query"), F.lit("original").alias("kind"), F.lit(1.0).alias("confidence")).unionByName(swapped(synonyms, "synonym", 0.8)).unionByName(swapped(short, "abbreviation", 0.9))
    order = [F.col("confidence").desc(), F.length("query"), "query"]
    once = first_of(every.withColumn("low", F.lower("query")), ["query_id", "low"], order).drop("low")
    return once.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("place") <= k)
