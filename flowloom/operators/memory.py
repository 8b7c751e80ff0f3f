"""Memories as a table (scope, id, text): remember, forget, and recall by words in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def remember(memories: DataFrame, new: DataFrame) -> DataFrame:
    """New rows take the place of those with the same scope and id."""
    return memories.join(new.select("scope", "id"), ["scope", "id"], "left_anti").unionByName(new)


def forget(memories: DataFrame, gone: DataFrame) -> DataFrame:
    return memories.join(gone.select("scope", "id").distinct(), ["scope", "id"], "left_anti")


def recall(memories: DataFrame, asked: str, limit: int, min_score: float = 0.0, scope: str | None = None) -> DataFrame:
    """Of each scope (or one) the `limit` best; the score is the share of the asked words that a memory holds."""
    wanted = words(F.lit(asked))
    rows = memories if scope is None else memories.where(F.col("scope") == scope)
    scored = rows.withColumn("score", F.coalesce(F.try_divide(F.size(F.array_intersect(wanted, words(F.col("text")))).cast("double"), F.size(wanted).cast("double")), F.lit(0.0)))
    order = Window.partitionBy("scope").orderBy(F.desc("score"), "id")
    ranked = scored.where(F.col("score") > min_score).withColumn("place", F.row_number().over(order))
    return ranked.where(F.col("place") <= limit)
