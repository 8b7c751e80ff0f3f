"""Outcome tables: scores, rankings, evaluations and the decisions drawn from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MIN_TRIALS = 3
LONG = "long"


def help_rate(helped: str = "helped", applied: str = "applied") -> Column:
    return F.coalesce(F.try_divide(F.col(helped).cast("double"), F.col(applied).cast("double")), F.lit(0.0))


def workflow_scores(uses: DataFrame, keys: list[str], helped: Column) -> DataFrame:
    return uses.groupBy(*keys).agg(F.count(F.lit(1)).alias("applied"), F.count_if(helped).alias("helped"))


def recalled(lessons: DataFrame, k: int, scope: list[str], always: str = "constraint") -> DataFrame:
    """Lessons of the kind `always`, and of others the k best: useful ones first (by rate), then untried, then useless."""
    band = F.when(F.col("applied") == 0, 1).when(F.col("helped") > 0, 0).otherwise(2).cast(LONG)
    ranked = lessons.withColumn("band", band).withColumn("rate", help_rate())
    order = Window.partitionBy(*scope, F.col("kind") == always).orderBy("band", F.desc("rate"), "id")
    return ranked.withColumn("place", F.row_number().over(order)).where((F.col("kind") == always) | (F.col("place") <= k))


def standings(members: DataFrame, family: str, root_first: str) -> DataFrame:
    """Each member's band and standing: the best of its family is the champion (if proven), other proven ones are beaten."""
    band = F.when(F.col("applied") < MIN_TRIALS, 1).when(F.col("helped") > 0, 0).otherwise(2).cast(LONG)
    ranked = members.withColumn("band", band).withColumn("rate", help_rate())
    order = Window.partitionBy(family).orderBy("band", F.desc("rate"), F.desc("applied"), root_first)
    ranked = ranked.withColumn("place", F.row_number().over(order).cast(LONG))
    return ranked.withColumn("standing", F.when(F.col("band") == 1, "unproven").when(F.col("place") == 1, "champion").otherwise("beaten"))


def collapsed_families(members: DataFrame, family: str, root_first: str, on_offer: Column) -> DataFrame:
    """Of each family the member to offer: its champion over all members if that is on offer, else the first on offer in family order."""
    ranked = standings(members, family, root_first).withColumn("_offer", F.coalesce(on_offer, F.lit(False)))
    fallback = F.row_number().over(Window.partitionBy(family).orderBy(F.desc("_offer"), F.desc((F.col("place") == 1) & F.col("_offer")), root_first))
    return ranked.withColumn("_pick", fallback).where((F.col("_pick") == 1) & F.col("_offer")).drop("_pick", "_offer")


def visible(rows: DataFrame, scope: str, column: str = "scope_key") -> DataFrame:
    """Rows of a scope and global ones (empty key)."""
    return rows.where(F.col(column).isin(scope, ""))


def layered_override(rows: DataFrame, key: str, layer: str) -> DataFrame:
    row = F.struct(*[c for c in rows.columns if c != key])
    return rows.groupBy(key).agg(F.max_by(row, layer).alias("_row")).select(key, "_row.*").select(*rows.columns)


def newest(rows: DataFrame, scope: list[str], *order: Column, keep: int) -> DataFrame:
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*scope).orderBy(*order)))
    return ranked.where(F.col("_rank") <= keep).drop("_rank")


def narrowed(limits: DataFrame, a: str, b: str, into: str) -> DataFrame:
    """The lesser of two optional limits; null is no limit."""
    return limits.withColumn(into, F.least(a, b))


def granted(tools: DataFrame, grants: DataFrame, tool: str, pattern: str) -> DataFrame:
    """Tools that a grant covers: the same name, or a prefix with a trailing .* ; grants are broadcast where a count shows that they are few."""
    prefix = F.regexp_extract(pattern, r"^(.*)\.\*$", 1)
    covers = (F.col(tool) == F.col(pattern)) | (F.col(pattern).endswith(".*") & F.startswith(F.col(tool), prefix))
    return tools.join(F.broadcast(grants) if grants.limit(10_001).count() <= 10_000 else grants, covers, "left_semi")


def outcome(satisfied: Column, verified: Column) -> Column:
    sure = F.coalesce(verified, F.lit(None).cast("boolean"))
    return F.when(satisfied & (sure == F.lit(False)), "wrong").when(satisfied, "solved").when(sure, "refused").otherwise("failed")


def evaluated(episodes: DataFrame, arm: str = "arm") -> DataFrame:
    """A row for each arm: episodes, solved, mean_attempts (of solved), cost_per_solve, hit_rate, trend (of attempts over pos, solved only)."""
    solved = F.col("satisfied") & F.coalesce(F.col("verified"), F.lit(True))
    e = episodes.withColumn("_solved", solved)
    x, y = F.when(F.col("_solved"), F.col("pos").cast("double")), F.when(F.col("_solved"), F.col("attempts").cast("double"))
    return e.groupBy(arm).agg(
        F.count(F.lit(1)).alias("episodes"),
        F.count_if("_solved").alias("solved"),
        F.avg(y).alias("mean_attempts"),
        F.coalesce(F.try_divide(F.sum("cost_usd"), F.count_if("_solved").cast("double")), F.lit(0.0)).alias("cost_per_solve"),
        F.avg(F.col("used_workflow").cast("double")).alias("hit_rate"),
        F.regr_slope(y, x).alias("trend"),
    )


def verdict(arms: DataFrame, on: str, off: str, arm: str = "arm") -> DataFrame:
    """One row: solved_more, converged or no_evidence."""
    of = lambda name, c: F.max(F.when(F.col(arm) == name, F.col(c)))
    one = arms.agg(*[of(n, c).alias(f"{c}_{k}") for k, n in (("on", on), ("off", off)) for c in ("solved", "mean_attempts", "trend")])
    no_worse = F.coalesce(F.col("mean_attempts_on") <= F.col("mean_attempts_off"), F.lit(True))
    more = F.coalesce((F.col("solved_on") > F.col("solved_off")) & no_worse, F.lit(False))
    bends = F.coalesce((F.col("trend_on") < F.col("trend_off")) & no_worse, F.lit(False))
    return one.withColumn("verdict", F.when(more, "solved_more").when(bends, "converged").otherwise("no_evidence"))


def stalled_streaks(attempts: DataFrame, episode: str, seq: str, reset: Column) -> DataFrame:
    """Attempts in a row that neither satisfied nor advanced: gaps and islands."""
    w = Window.partitionBy(episode).orderBy(seq)
    e = attempts.withColumn("_reset", F.coalesce(reset, F.lit(False)).cast("int")).withColumn("_island", F.sum("_reset").over(w))
    inside = Window.partitionBy(episode, "_island").orderBy(seq)
    return e.withColumn("stalled", F.sum(1 - F.col("_reset")).over(inside)).drop("_reset", "_island")


def should_retry(satisfied: Column, continuable: Column, spent: Column, stalled: Column, attempts: int = 12, min_attempts: int = 3, stall_limit: int = 2) -> Column:
    return F.when(satisfied | ~continuable | (spent >= attempts), False).when(spent < min_attempts, True).otherwise(stalled < stall_limit)


def next_step(satisfied: Column, continuable: Column, blocker: Column, spent: Column, stalled: Column, attempts: int = 12) -> Column:
    retry = should_retry(satisfied, continuable, spent, stalled, attempts)
    return (
        F.when(satisfied, "done")
        .when(retry, "retry")
        .when(~continuable, F.concat(F.lit("stand down: "), blocker))
        .when(spent >= attempts, F.concat(F.lit("stand down: out of attempts after "), spent.cast("string")))
        .otherwise(F.concat(F.lit("stand down: "), stalled.cast("string"), F.lit(" attempts in a row made no progress")))
    )


def approach_signature(selected: Column, fingerprint: Column) -> Column:
    return F.when(selected.isNotNull(), F.concat(F.lit("selected:"), selected)).when(fingerprint.isNotNull(), F.concat(F.lit("authored:"), fingerprint)).otherwise("errand")


def untried(candidates: DataFrame, rows: DataFrame, key: str, signature: str) -> DataFrame:
    """Enabled candidates whose selected:<id> is no signature of the rows."""
    mine = candidates.where("enabled").withColumn("_sig", F.concat(F.lit("selected:"), F.col(key).cast("string")))
    return mine.join(rows.select(F.col(signature).alias("_sig")).distinct(), "_sig", "left_anti").drop("_sig")


def numbered(rows: DataFrame, start: Column, prefix: str, *order: str, scope: list[str]) -> DataFrame:
    """Ids after the greatest sequence number so far: prefix_00000001."""
    n = start + F.row_number().over(Window.partitionBy(*scope).orderBy(*order))
    return rows.withColumn("seq", n.cast(LONG)).withColumn("id", F.concat(F.lit(prefix + "_"), F.lpad(F.col("seq").cast("string"), 8, "0")))
