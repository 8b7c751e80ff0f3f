"""Analytics over a run journal: rows (run, node, step, seq, ts_ms, kind, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def paired_latencies(events: DataFrame, keys: list[str], seq: str, ts_ms: str, started: Column, ended: Column) -> DataFrame:
    """Each end with the start it takes off its key's queue, first in first out; ends that find the queue empty are left out.
    The running minimum of starts minus ends counts these, so windows do it in one pass over each key."""
    w = Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    e = events.where(started | ended).withColumn("_start", started)
    e = e.withColumn("_starts", F.sum(F.col("_start").cast("long")).over(w)).withColumn("_ends", F.sum((~F.col("_start")).cast("long")).over(w))
    e = e.withColumn("_lost", F.greatest(F.max(F.col("_ends") - F.col("_starts")).over(w), F.lit(0)))
    e = e.withColumn("_was", F.coalesce(F.lag("_lost").over(Window.partitionBy(*keys).orderBy(seq)), F.lit(0)))
    starts = e.where("_start").select(*keys, F.col("_starts").alias("_turn"), F.col(ts_ms).alias("started_ms"))
    ends = e.where(~F.col("_start") & (F.col("_lost") == F.col("_was"))).withColumn("_turn", F.col("_ends") - F.col("_lost"))
    out = ends.join(starts, [*keys, "_turn"])
    return out.withColumn("elapsed_ms", F.greatest(F.col(ts_ms) - F.col("started_ms"), F.lit(0))).drop("_start", "_starts", "_ends", "_lost", "_was", "_turn")


def node_health(events: DataFrame, node: str, started: Column, completed: Column, failed: Column) -> DataFrame:
    out = events.groupBy(node).agg(F.count_if(started).alias("started"), F.count_if(completed).alias("completed"), F.count_if(failed).alias("failed"))
    return out.withColumn("failure_rate", F.coalesce(F.try_divide(F.col("failed").cast("double"), F.col("failed") + F.col("completed")), F.lit(0.0)))


def run_status(events: DataFrame, run: str, failed: Column) -> DataFrame:
    status = F.when(F.bool_or(failed), "completed_with_errors").otherwise("completed")
    return events.groupBy(run).agg(status.alias("status"))


def failed_steps(steps: DataFrame, run: str, status: str, started_ms: str, finished_ms: str) -> DataFrame:
    bad = F.lower(F.trim(F.col(status))).isin("failed", "error")
    return steps.groupBy(run).agg(F.count_if(bad).alias("failed_steps"), F.greatest(F.max(finished_ms) - F.min(started_ms), F.lit(0)).alias("duration_ms"))


def diagnosis(steps: DataFrame, run: str, null_bindings: Column, empty_prompt: Column, hidden_error: Column) -> DataFrame:
    """Counts of each finding by run, and whether there is none."""
    out = steps.groupBy(run).agg(F.sum(null_bindings.cast("long")).alias("null_bindings"), F.count_if(empty_prompt).alias("empty_prompts"), F.count_if(hidden_error).alias("hidden_errors"))
    return out.withColumn("is_clean", F.col("null_bindings") + F.col("empty_prompts") + F.col("hidden_errors") == 0)


def trace_summary(steps: DataFrame, calls: Column, failed: Column, nulls: Column) -> DataFrame:
    return steps.agg(F.format_string("%d steps, %d calls, %d failed, %d null", F.count(F.lit(1)), F.count_if(calls), F.count_if(failed), F.count_if(nulls)).alias("summary"))


def never_ran(nodes: DataFrame, steps: DataFrame, node: str) -> DataFrame:
    return nodes.join(steps.select(node).distinct(), node, "left_anti")
