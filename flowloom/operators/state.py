"""Keyed state: reducers, channels, checkpoints.

Writes are rows (key columns, seq, value); seq is the order of writes. Reducers are aggregates that combine in each task
before the shuffle wherever the rule allows it."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from flowloom.sources.staging import staged


def last_value(writes: DataFrame, keys: list[str], value: str = "value", seq: str = "seq") -> DataFrame:
    return writes.groupBy(*keys).agg(F.max_by(value, seq).alias(value))


def conflicts(writes: DataFrame, keys: list[str], step: str, writer: str) -> DataFrame:
    """Keys of a last-value channel that more than one writer wrote in a step."""
    return writes.groupBy(*keys, step).agg(F.countDistinct(writer).alias("writers")).where("writers > 1")


def appended(writes: DataFrame, keys: list[str], value: str = "value", seq: str = "seq") -> DataFrame:
    """All values of a key, in order, as one array; for keys whose lists are bounded."""
    return writes.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(seq, value))), lambda x: x[value]).alias(value))


def set_union(current: Column, new: Column) -> Column:
    """`current` as it is, repeats included, then the new values not in it, each once."""
    return F.concat(current, F.array_except(F.array_distinct(new), current))


def first_seen(writes: DataFrame, keys: list[str], value: str = "value", seq: str = "seq") -> DataFrame:
    """Each different value of a key with its first seq."""
    return writes.groupBy(*keys, value).agg(F.min(seq).alias(seq))


def extremes(writes: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return writes.groupBy(*keys).agg(F.min(value).alias("least"), F.max(value).alias("most"))


def delta(writes: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Sum; whole numbers stay whole."""
    return writes.groupBy(*keys).agg(F.sum(value).alias(value))


def upserted_messages(writes: DataFrame, keys: list[str], message_id: str = "id", value: str = "value", seq: str = "seq") -> DataFrame:
    """Messages by id: the place of the first write, the value of the last. Messages without an id are each their own."""
    own = F.coalesce(F.col(message_id).cast("string"), F.concat(F.lit("\u0000"), F.col(seq).cast("string")))
    return writes.withColumn("_id", own).groupBy(*keys, "_id").agg(F.min(seq).alias("place"), F.max_by(value, seq).alias(value), F.first(message_id).alias(message_id)).drop("_id")


def ephemeral(writes: DataFrame, keys: list[str], step: str) -> DataFrame:
    """Only what was written in a key's latest step."""
    latest = writes.groupBy(*keys).agg(F.max(step).alias("_latest"))
    return writes.join(latest, keys).where(F.col(step) == F.col("_latest")).drop("_latest")


def tracked(snapshot: DataFrame, untracked: list[str]) -> DataFrame:
    return snapshot.drop(*untracked)


def barrier(arrivals: DataFrame, keys: list[str], needed: int) -> DataFrame:
    return arrivals.groupBy(*keys).agg(F.count(F.lit(1)).alias("arrived")).withColumn("ready", F.col("arrived") >= needed)


def named_barrier(arrivals: DataFrame, keys: list[str], name: str, expected: list[str]) -> DataFrame:
    """Ready once all expected names have arrived; the names of arrivals are few, those expected."""
    few = arrivals.where(F.col(name).isin(expected)).groupBy(*keys).agg(F.collect_set(name).alias("_names"))
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, expected)), F.coalesce("_names", F.array().cast("array<string>"))))
    return arrivals.select(*keys).distinct().join(few, keys, "left").withColumn("missing", missing).withColumn("ready", F.size("missing") == 0).drop("_names")


def folded(writes: DataFrame, keys: list[str], start: Column, step: Callable[[Column, Column], Column], value: str = "value", seq: str = "seq") -> DataFrame:
    """A custom fold over a key's values in order; for keys whose lists are bounded."""
    lists = appended(writes, keys, value, seq)
    return lists.withColumn(value, F.aggregate(value, start, step))


@F.pandas_udf(StringType())
def deep_merged(current: pd.Series, new: pd.Series) -> pd.Series:
    """Objects merge key by key, all else is replaced; a lone {"$replace": v} replaces what it meets. JSON text in and out."""
    import json

    def merge(a, b):
        if not isinstance(b, dict):
            return b
        if set(b) == {"$replace"}:
            return b["$replace"]
        out = dict(a) if isinstance(a, dict) else {}  # what is new is walked too, so that no $replace in it stays
        for k, v in b.items():
            out[k] = merge(out.get(k), v)
        return out

    return pd.Series([json.dumps(merge(json.loads(a or "null"), json.loads(b)), sort_keys=True) if b is not None else a for a, b in zip(current, new)])


@F.pandas_udf(StringType())
def merge_patched(target: pd.Series, patch: pd.Series) -> pd.Series:
    """RFC 7386: null takes a key out. JSON text in and out."""
    import json

    def apply(a, p):
        if not isinstance(p, dict):
            return p
        out = dict(a) if isinstance(a, dict) else {}
        for k, v in p.items():
            if v is None:
                out.pop(k, None)
            else:
                out[k] = apply(out.get(k), v)
        return out

    return pd.Series([json.dumps(apply(json.loads(a or "null"), json.loads(p)), sort_keys=True) if p is not None else a for a, p in zip(target, patch)])


def latest_checkpoint(checkpoints: DataFrame, scope: list[str], seq: str = "seq") -> DataFrame:
    """The newest checkpoint of each scope (thread and namespace)."""
    cols = [c for c in checkpoints.columns if c not in scope]
    return checkpoints.groupBy(*scope).agg(F.max_by(F.struct(*cols), seq).alias("_c")).select(*scope, "_c.*")


def ancestors(start: DataFrame, parents: DataFrame, node: str, parent: str, most: int) -> DataFrame:
    """(origin, node, depth): each row of start with all that lies above it, `most` steps at most; a row for each way up.
    What is known up to k steps and the jumps of k steps give what lies up to 2 k above, so the number of joins grows with
    the logarithm of the depth; it ends once no jump is left."""
    jump = staged(parents.select(F.col(node).alias("_from"), F.col(parent).alias("_to")).where(F.col(parent).isNotNull()), "jumps")
    known = start.select(F.col(node).alias("origin"), F.col(node).alias("node"), F.lit(0).cast("long").alias("depth"))
    length = 1
    while length <= most:
        above = known.join(jump, known.node == jump._from).select("origin", F.col("_to").alias("node"), (F.col("depth") + length).alias("depth"))
        known = staged(known.unionByName(above), "ancestors")
        on = jump.select(F.col("_from").alias("_via"), F.col("_to").alias("_top"))
        length *= 2
        if length > most:
            break
        jump = staged(jump.join(on, jump._to == on._via).select("_from", F.col("_top").alias("_to")), "jumps")
        if jump.isEmpty():
            break
    return known.where(F.col("depth") <= most)


def state_history(checkpoints: DataFrame, thread: str, node: str, parent: str, seq: str, limit: int) -> DataFrame:
    """From each thread's newest checkpoint up its parents, `limit` rows at most; a cycle ends there."""
    newest = checkpoints.groupBy(thread).agg(F.max_by(node, seq).alias(node))
    chain = ancestors(newest, checkpoints, node, parent, limit - 1)
    chain = chain.groupBy("origin", "node").agg(F.min("depth").alias("depth"))
    return chain.join(newest.withColumnRenamed(node, "origin"), "origin").select(thread, F.col("node").alias(node), "depth")


def all_above(start: DataFrame, parents: DataFrame, node: str, parent: str) -> DataFrame:
    """Each node of start or above one, once, however far up; a cycle ends there as it brings no new node. What is known up to
    k steps and the jumps of k steps give what lies up to 2 k above."""
    jump = staged(parents.select(F.col(node).alias("_from"), F.col(parent).alias("_to")).where(F.col(parent).isNotNull()).distinct(), "jumps")
    known = staged(start.select(F.col(node).alias("node")).distinct(), "above")
    n, length, edges = known.count(), 1, max(jump.count(), 1)
    while n and length <= 2 * edges:  # no way without a cycle is longer than the edges are many
        above = known.join(jump, known.node == jump._from).select(F.col("_to").alias("node"))
        known = staged(known.unionByName(above).distinct(), "above")
        on = jump.select(F.col("_from").alias("_via"), F.col("_to").alias("_top"))
        jump = staged(jump.join(on, jump._to == on._via).select("_from", F.col("_top").alias("_to")).distinct(), "jumps")
        length *= 2
        if jump.isEmpty():
            break
    return known


def pruned(checkpoints: DataFrame, scope: list[str], node: str, parent: str, seq: str, keep_last: int) -> DataFrame:
    """What stays: the newest `keep_last` (1 at least) of each scope and all above them."""
    rank = F.row_number().over(Window.partitionBy(*scope).orderBy(F.desc(seq)))
    window = checkpoints.withColumn("_rank", rank).where(F.col("_rank") <= max(keep_last, 1))
    kept = all_above(window.select(node), checkpoints, node, parent).select(F.col("node").alias(node))
    return checkpoints.join(kept, node, "left_semi")


def merged_writes(writes: DataFrame, identity: list[str], idx: str, value: str, seq: str) -> DataFrame:
    """Of writes with one identity (idx is part of it): the last of the control plane (idx < 0), the first of data."""
    kept = writes.groupBy(*identity).agg(F.max_by(value, seq).alias("_last"), F.min_by(value, seq).alias("_first"))
    return kept.withColumn(value, F.when(F.col(idx) < 0, F.col("_last")).otherwise(F.col("_first"))).drop("_last", "_first")


def pending_tasks(tasks: DataFrame, completed: DataFrame, key: str) -> DataFrame:
    """Tasks without a completion marker; all of them where every one has its marker."""
    left = tasks.join(completed.select(key).distinct(), key, "left_anti")
    none_left = left.agg((F.count(F.lit(1)) == 0).alias("_none"))
    return tasks.join(left.select(key).withColumn("_left", F.lit(True)), key, "left").crossJoin(F.broadcast(none_left)).where(F.col("_none") | F.col("_left")).drop("_none", "_left")


def copied_thread(checkpoints: DataFrame, source: str, target: str) -> DataFrame:
    """The source thread's rows under another name; refused where the target has rows."""
    if not checkpoints.where(F.col("thread_id") == target).isEmpty():
        raise ValueError(f"thread {target!r} isn't empty")
    return checkpoints.where(F.col("thread_id") == source).withColumn("thread_id", F.lit(target))


def threads(checkpoints: DataFrame, thread: str = "thread_id") -> DataFrame:
    return checkpoints.select(thread).distinct()


def without_runs(checkpoints: DataFrame, runs: DataFrame, run: str = "run_id") -> DataFrame:
    return checkpoints.join(runs.select(run).distinct(), run, "left_anti")


def forked(checkpoints: DataFrame, node: str, parent: str, source, new_id, changes: dict[str, Column]) -> DataFrame:
    """The table with one more checkpoint: the source's child, with changed columns."""
    child = checkpoints.where(F.col(node) == source).withColumns({**changes, parent: F.col(node), node: F.lit(new_id)})
    return checkpoints.unionByName(child.select(*checkpoints.columns))


def chain_groups(notes: DataFrame, node: str, superseded_by: str) -> DataFrame:
    """(node, group): notes that supersede each other, however long the chain, have one group, named by its last note (of a cycle by the
    least). What is known over k steps gives what lies over 2 k; a note that isn't there ends a chain."""
    ids = notes.select(F.col(node).alias("node"))
    links = notes.select(F.col(node).alias("node"), F.col(superseded_by).alias("to")).where(F.col("to").isNotNull()).join(ids.withColumnRenamed("node", "to"), "to", "left_semi")
    ways = staged(ids.join(links, "node", "left").select("node", F.coalesce("to", "node").alias("to")).withColumn("least", F.col("to")), "chains")
    n, steps = ways.count(), 1
    while steps <= n:
        ahead = ways.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("least").alias("_least"))
        moved = staged(ways.join(ahead, "to").select("node", "to", F.col("_to"), F.least("least", "_least").alias("least")), "chains")
        done = moved.where(F.col("to") != F.col("_to")).isEmpty()
        ways, steps = moved.select("node", F.col("_to").alias("to"), "least"), 2 * steps
        if done:
            break
    return ways.join(ways.select(F.col("node").alias("to"), F.col("least").alias("group")), "to").select("node", "group")


def retained_notes(notes: DataFrame, scope: str, node: str, superseded_by: str, pinned: str, keep: int) -> DataFrame:
    """Of a scope with more than `keep` notes the groups with the oldest notes go, until no more than `keep` are left or only groups with a
    pinned note are; notes that supersede each other stay or go together."""
    groups = chain_groups(notes, node, superseded_by)
    grouped = staged(notes.join(groups, notes[node] == groups.node).drop(groups.node), "notes")
    sizes = grouped.groupBy(scope, "group").agg(F.count(F.lit(1)).alias("n"), F.bool_or(pinned).alias("_pinned"), F.min(node).alias("_oldest"))
    over = grouped.groupBy(scope).agg((F.count(F.lit(1)) - keep).alias("_over"))
    before = F.sum("n").over(Window.partitionBy(scope).orderBy("_oldest")) - F.col("n")
    gone = sizes.where(~F.col("_pinned")).withColumn("_before", before).join(over, scope).where(F.col("_before") < F.col("_over"))
    return grouped.join(gone.select(scope, "group"), [scope, "group"], "left_anti").drop("group")


def failure_boundary(checkpoints: DataFrame, thread: str, seq: str = "seq") -> DataFrame:
    """Of each thread whose newest checkpoint tells a failed node: that node, the error, the checkpoint, its step and the nodes that were to
    come. checkpoints has checkpoint_id, metadata (JSON text) and next_nodes; a thread that was interrupted or has ended has no row."""
    newest = latest_checkpoint(checkpoints, [thread], seq)
    of = lambda name: F.get_json_object("metadata", f"$.{name}")
    step = F.coalesce(of("step").try_cast("long"), F.lit(0).cast("long"))
    found = newest.select(thread, of("failed_node").alias("failed_node"), F.coalesce(of("error"), F.lit("")).alias("error"), "checkpoint_id", step.alias("step"), F.col("next_nodes").alias("pending"))
    return found.where(F.col("failed_node").isNotNull())
