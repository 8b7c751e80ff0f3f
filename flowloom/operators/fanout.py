"""Fan-out and fan-in: lanes, tickets, approvals, duplicates, bounded loops, reliability."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from flowloom.functions.values import at_path
from flowloom.operators.items import ORD, positions
from flowloom.sources.staging import staged

MAX_LANES = 256


def scatter(items: DataFrame, lanes: int | None, *order: str) -> DataFrame:
    """Contiguous lanes of ceil(N / lanes) items (one each without `lanes`, or if there are as many): columns lane and
    lane_count, which can be less than asked for. At most MAX_LANES lanes are asked for at once."""
    placed = positions(items, *(order or (ORD,)), into="_at")
    size = placed.agg(F.count(F.lit(1)).alias("_n"))
    asked = F.lit(min(lanes, MAX_LANES)) if lanes else F.col("_n")
    size = size.withColumn("_size", F.greatest(F.ceil(F.col("_n") / F.greatest(asked, F.lit(1))), F.lit(1)))
    out = placed.crossJoin(F.broadcast(size)).withColumn("lane", F.floor(F.col("_at") / F.col("_size")).cast("long"))
    return out.withColumn("lane_count", F.ceil(F.col("_n") / F.col("_size")).cast("long")).drop("_at", "_n", "_size")


def scatter_path(items: DataFrame, column: str, path: str, lanes: int | None = None, into: str = "value") -> DataFrame:
    """Lanes over the array at a path of the first item, each element an item of its own; what is no array gives one lane, of the items as they are."""
    first = items.orderBy(ORD).limit(1)
    value = at_path(F.col(column), path, items.schema[column].dataType)
    if not isinstance(first.select(value.alias("v")).schema["v"].dataType, ArrayType):
        return items.withColumn("lane", F.lit(0).cast("long")).withColumn("lane_count", F.lit(1).cast("long"))
    made = first.where(value.isNotNull()).select(F.posexplode(value).alias(ORD, into))
    return scatter(made.withColumn(ORD, F.col(ORD).cast("long")), lanes)


def gather(lanes: DataFrame, failed: Column, message: Column, on_error: str = "collect") -> DataFrame:
    """Items of all lanes; paired with their lane. A failed lane is one row that tells so (collect), is left out (skip), or
    raises (fail_fast, the lowest lane)."""
    marked = lanes.withColumn("_failed", F.coalesce(failed, F.lit(False)))
    bad = marked.where("_failed").groupBy("lane").agg(F.min_by(message, F.col(ORD)).alias("error"))
    good = marked.join(bad.select("lane"), "lane", "left_anti").drop("_failed").withColumn("failed", F.lit(False))
    if on_error == "skip":
        return good
    if on_error == "fail_fast":
        first = bad.agg(F.min_by("error", "lane").alias("_error"))
        ok = F.when(F.col("_error").isNotNull(), F.raise_error(F.col("_error")).cast("boolean")).otherwise(F.lit(True))
        return good.crossJoin(F.broadcast(first)).where(ok).drop("_error")
    return good.unionByName(bad.withColumn("failed", F.lit(True)), allowMissingColumns=True)


def release(policy: str, arrived: Column, expected: Column, spent: Column, n: int = 1) -> Column:
    """emit, wait or timeout for a collector that has `arrived` of `expected`; n is clamped to what is expected."""
    needed = {"all": expected, "timeout_partial": expected, "any": F.least(F.lit(1), expected), "first_n": F.least(F.lit(n), expected), "quorum": F.least(F.lit(n), expected)}[policy]
    late = "emit" if policy == "timeout_partial" else "timeout"
    return F.when(arrived >= needed, "emit").when(~spent, "wait").otherwise(late)


MAX_DEPTH = 8


def sub_flow(items: DataFrame, flows: Mapping[str, Callable[[DataFrame, int], DataFrame]], name: str, inputs: Mapping[str, Column] | None = None, depth: int = 0, most: int = MAX_DEPTH) -> DataFrame:
    """Runs another flow on the items: one of `flows` by its name, which gets the columns that `inputs` maps (with ORD; all columns without it) and its own
    depth, to pass on to flows that it calls. Over `most` levels, or an unknown name, is an error."""
    if name not in flows:
        raise ValueError(f"no flow {name!r}")
    if depth >= most:
        raise ValueError(f"flow {name!r} is nested over {most} levels deep")
    given = items if inputs is None else items.select(ORD, *[c.alias(k) for k, c in inputs.items()])
    return flows[name](given, depth + 1)


def gate(tickets: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Tickets with their results; `done` tells whether one has come."""
    return tickets.join(results.withColumn("done", F.lit(True)), key, "left").withColumn("done", F.coalesce("done", F.lit(False)))


def spawn(items: DataFrame, prefix: str = "ticket") -> DataFrame:
    """A ticket for each item, named by its place, so that a repeated task names the same one."""
    return items.withColumn("ticket", F.concat(F.lit(f"{prefix}-"), F.col(ORD).cast("string")))


def released(tickets: DataFrame, results: DataFrame, key: str, group: list[str], policy: str, spent: Column, n: int = 1) -> DataFrame:
    """A gate over groups of tickets: every ticket with its result, how many of its group have come and were expected, and the group's port: emit,
    wait or timeout by `policy`. Where a group is emitted before all have come, tickets without a result are left out."""
    joined = gate(tickets, results, key)
    counts = joined.groupBy(*group).agg(F.count_if("done").alias("arrived"), F.count(F.lit(1)).alias("expected"), F.bool_or(F.coalesce(spent, F.lit(False))).alias("_spent"))
    port = release(policy, F.col("arrived"), F.col("expected"), F.col("_spent"), n)
    out = joined.join(counts.withColumn("port", port).drop("_spent"), group)
    return out.where((F.col("port") != "emit") | F.col("done"))


def approval_gate(gates: DataFrame, approvals: DataFrame, denials: DataFrame, error_ports: DataFrame, key: str = "id") -> DataFrame:
    """The port of each node that requires an approval: a denial goes to `error` where the node has such a port and fails the run where it has none,
    an id in the list of approvals goes on by `main`, any other node is `paused`. A denial counts before an approval."""
    marked = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    out = gates.join(marked(approvals, "_yes"), key, "left").join(marked(denials, "_no"), key, "left").join(marked(error_ports, "_error"), key, "left")
    port = F.when(F.col("_no"), F.when(F.col("_error"), "error").otherwise("failed")).when(F.col("_yes"), "main").otherwise("paused")
    return out.withColumn("port", port).drop("_yes", "_no", "_error")


def decided_item(requests: DataFrame, decisions: DataFrame, key: str = "request_id") -> DataFrame:
    """Each settled request (subject, subject_kind, input) with its decision (approved, payload, decided_by, comment): the subject is the reviewer's edit
    where there is one, and the input stays beside it."""
    joined = requests.join(decisions, key)
    subject = F.coalesce(F.col("payload"), F.col("subject"))
    return joined.select("approved", subject.alias("subject"), "subject_kind", F.col("payload").isNotNull().alias("edited"), "decided_by", "comment", key, "input")


def approval_port(decision: Column, waited: Column, most: int) -> Column:
    """approved or rejected by an explicit decision; without one waiting, then timeout."""
    return F.when(decision.isNull(), F.when(waited >= most, "timeout").otherwise("waiting")).when(decision, "approved").otherwise("rejected")


def dedup(items: DataFrame, key: Column, committed: DataFrame | None = None, committed_key: str = "key") -> DataFrame:
    """The first item of each key that isn't committed; items with a null or empty key all pass. The pre-aggregate keeps one
    order for each key in each task, so a frequent key isn't gathered."""
    keyed = items.withColumn("_key", F.when(key.cast("string") != "", key.cast("string")))
    first = keyed.where(F.col("_key").isNotNull()).groupBy("_key").agg(F.min(ORD).alias(ORD))
    if committed is not None:
        first = first.join(committed.select(F.col(committed_key).cast("string").alias("_key")), "_key", "left_anti")
    kept = keyed.join(first.select(ORD), ORD, "left_semi")
    return kept.unionByName(keyed.where(F.col("_key").isNull())).drop("_key")


def new_keys(items: DataFrame, key: Column) -> DataFrame:
    """Keys to commit once their items are done with."""
    return items.select(key.cast("string").alias("key")).where("key is not null and key <> ''").distinct()


def loop(
    state: DataFrame,
    body: Callable[[DataFrame], DataFrame],
    until: Column,
    most: int = 25,
    on_exceeded: str = "continue",
    every: int = 4,
    condition: Column | None = None,
    fold: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Runs `body` on the rows that go on; columns iteration and exit_reason. Before each pass a row ends if `until` holds, else if
    `condition` doesn't, else after `most` passes. After each pass `fold` sets accumulator columns, all from the state as the body left it,
    before the tests. Rows that are done aren't touched again: every few rounds the new ones are written, and lineage is cut."""
    going = state.withColumn("iteration", F.lit(0).cast("long"))
    stop = F.coalesce(until, F.lit(False))
    halt = F.lit(False) if condition is None else ~F.coalesce(condition, F.lit(False))
    written: list[DataFrame] = []
    fresh: list[DataFrame] = []

    def all_done() -> DataFrame:
        return reduce(DataFrame.unionByName, written + fresh)

    for k in range(most + 1):
        fresh.append(going.where(stop | halt).withColumn("exit_reason", F.when(stop, "until").otherwise("condition")))
        going = going.where(~(stop | halt))
        if k == most:
            break
        going = body(going)
        if fold:
            going = going.withColumns(dict(fold))
        going = going.withColumn("iteration", F.lit(k + 1).cast("long"))
        if k % every == every - 1:
            going = staged(going, "loop")
            written.append(staged(reduce(DataFrame.unionByName, fresh), "loop-done"))
            fresh.clear()
            if going.isEmpty():
                return all_done()
    done = all_done()
    if on_exceeded == "error":
        return done.unionByName(going.withColumn("exit_reason", F.raise_error(F.lit(f"over {most} iterations")).cast("string")))
    return done.unionByName(going.withColumn("exit_reason", F.lit("max_iterations")))


def retry_schedule(attempts: DataFrame, attempt: str, base_ms: int, backoff: str = "exponential", cap_ms: int = 60_000) -> DataFrame:
    """wait_ms after each failed attempt (from 0), never over the cap."""
    exact = F.lit(base_ms) if backoff == "fixed" else F.lit(base_ms) * F.pow(F.lit(2.0), F.least(F.col(attempt), F.lit(40)))
    return attempts.withColumn("wait_ms", F.least(exact, F.lit(cap_ms)).cast("long"))


def with_retry(action: Callable[[], DataFrame], attempts: int = 3, base_ms: int = 100, cap_ms: int = 60_000) -> DataFrame:
    """Runs an action (which must start its Spark job) until it succeeds; the last error is raised."""
    for k in range(attempts):
        try:
            return action()
        except Exception:
            if k == attempts - 1:
                raise
            time.sleep(min(base_ms * 2**k, cap_ms) / 1000)
    raise ValueError("attempts must be at least 1")


def on_error_continue(node: str, action: Callable[[], DataFrame]) -> tuple[str, DataFrame | dict]:
    """Port main and the result, or port error and {error: {message, node}}."""
    try:
        return "main", action()
    except Exception as e:
        return "error", {"error": {"message": str(e), "node": node}}


def fan_in(parts: DataFrame, key: str, into: str = "arrived") -> DataFrame:
    """How many different inputs have arrived for each key."""
    return parts.groupBy(key).agg(F.countDistinct("input").alias(into))


def latest_per(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of each key the row with the greatest order; combined in each task before the shuffle."""
    row = F.struct(*[c for c in df.columns if c not in keys])
    return df.groupBy(*keys).agg(F.max_by(row, order).alias("_row")).select(*keys, "_row.*").select(*df.columns)
