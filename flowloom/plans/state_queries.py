"""Reducers, channels, checkpoints, journals and graphs on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.operators import graphs, journal, state
from flowloom.plans.registry import query
from flowloom.sources.tables import table

L = "long"


def writes(spark: SparkSession, d: str) -> DataFrame:
    """Writes to a user's state: key user_id, seq event_id."""
    return table(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("name"), "value", F.to_date("ts").alias("step"), F.get_json_object("props", "$.k").cast(L).alias("k"))


@query("SELECT user_id, arg_max(event_type, event_id) AS name FROM events GROUP BY user_id")
def reduce_last_value(spark: SparkSession, d: str) -> DataFrame:
    return state.last_value(writes(spark, d), ["user_id"], "name")


@query("SELECT user_id, CAST(strftime(CAST(ts AS DATE), '%Y-%m-%d') AS VARCHAR) AS step, count(DISTINCT event_type) AS writers FROM events GROUP BY user_id, CAST(ts AS DATE) HAVING count(DISTINCT event_type) > 1")
def channel_conflict(spark: SparkSession, d: str) -> DataFrame:
    return state.conflicts(writes(spark, d), ["user_id"], "step", "name").withColumn("step", F.col("step").cast("string"))


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS names FROM events GROUP BY user_id")
def reduce_append(spark: SparkSession, d: str) -> DataFrame:
    return state.appended(writes(spark, d), ["user_id"], "name").select("user_id", F.array_join("name", ",").alias("names"))


@query("""WITH e AS (SELECT user_id, list(event_type ORDER BY event_id) FILTER (WHERE event_type IN ('view', 'click')) AS cur FROM events WHERE user_id % 2 = 0 GROUP BY user_id),
f AS (SELECT user_id, event_type, min(event_id) AS s FROM events WHERE user_id % 2 = 0 GROUP BY user_id, event_type),
n AS (SELECT f.user_id, list(event_type ORDER BY s) AS more FROM f JOIN e USING (user_id) WHERE NOT list_contains(coalesce(cur, []), event_type) GROUP BY f.user_id)
SELECT user_id, array_to_string(list_concat(coalesce(cur, []), coalesce(more, [])), ',') AS names FROM e LEFT JOIN n USING (user_id)""")
def reduce_set_union(spark: SparkSession, d: str) -> DataFrame:
    """Views and clicks are the current list, with repeats; all writes are the new one."""
    w = writes(spark, d).where("user_id % 2 = 0")
    new = state.appended(w, ["user_id"], "name")
    cur = state.appended(w.where("name in ('view', 'click')"), ["user_id"], "name").withColumnRenamed("name", "cur")
    both = new.join(cur, "user_id", "left").withColumn("cur", F.coalesce("cur", F.array().cast("array<string>")))
    return both.select("user_id", F.array_join(state.set_union(F.col("cur"), F.col("name")), ",").alias("names"))


@query("SELECT user_id, min(value) AS least, max(value) AS most FROM events GROUP BY user_id")
def reduce_min_max(spark: SparkSession, d: str) -> DataFrame:
    return state.extremes(writes(spark, d), ["user_id"])


@query("SELECT user_id, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY user_id")
def channel_delta(spark: SparkSession, d: str) -> DataFrame:
    return state.delta(writes(spark, d), ["user_id"], "k")


@query("""SELECT conv_id, CAST(min(turn) AS BIGINT) AS place, arg_max(text, turn) AS value, CASE WHEN role <> 'system' THEN role END AS id
FROM conversations GROUP BY conv_id, role, CASE WHEN role = 'system' THEN turn END""")
def channel_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages by role; those of the system have no id, so they are appended."""
    c = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("seq"), F.when(F.col("role") != "system", F.col("role")).alias("id"), F.col("text").alias("value"))
    return state.upserted_messages(c, ["conv_id"]).select("conv_id", "place", "value", "id")


@query("SELECT e.user_id, event_id AS seq FROM events e JOIN (SELECT user_id, max(CAST(ts AS DATE)) AS latest FROM events GROUP BY user_id) m ON m.user_id = e.user_id AND CAST(ts AS DATE) = latest")
def channel_ephemeral(spark: SparkSession, d: str) -> DataFrame:
    return state.ephemeral(writes(spark, d), ["user_id"], "step").select("user_id", "seq")


@query("SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def channel_untracked(spark: SparkSession, d: str) -> DataFrame:
    snapshot = state.latest_checkpoint(writes(spark, d), ["user_id"])
    return state.tracked(snapshot, ["seq", "name", "step", "k"])


@query("SELECT o_custkey, count(*) AS arrived, count(*) >= 10 AS ready FROM orders GROUP BY o_custkey")
def barrier_ready(spark: SparkSession, d: str) -> DataFrame:
    return state.barrier(table(spark, d, "orders"), ["o_custkey"], 10)


@query("""SELECT o_custkey, array_to_string(list_sort(list_filter(['1-URGENT', '2-HIGH', '5-LOW'], lambda x: NOT list_contains(list(DISTINCT o_orderpriority), x))), ',') AS missing,
count(DISTINCT o_orderpriority) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')) = 3 AS ready FROM orders GROUP BY o_custkey""")
def named_barrier_ready(spark: SparkSession, d: str) -> DataFrame:
    found = state.named_barrier(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"])
    return found.select("o_custkey", F.array_join("missing", ",").alias("missing"), "ready")


@query("""SELECT user_id, CAST(list_reduce(list_prepend(CAST(7 AS BIGINT), list(CAST(json_extract(props, '$.k') AS BIGINT) ORDER BY event_id)), lambda a, x: (a * 31 + x) % 1000003) AS BIGINT) AS k FROM events GROUP BY user_id""")
def reduce_custom_fold(spark: SparkSession, d: str) -> DataFrame:
    return state.folded(writes(spark, d), ["user_id"], F.lit(7).cast(L), lambda a, x: (a * 31 + x) % 1000003, "k")


@query("""WITH w AS (SELECT user_id, arg_min(event_type, event_id) AS n, arg_min(json_extract(props, '$.k'), event_id) AS k, arg_max(event_type, event_id) AS m, arg_max(round(value), event_id) AS v FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN m = 'error' THEN '{"a": {"k": ' || k || ', "name": "' || n || '"}, "name": "error", "z": {"w": 5}}' ELSE '{"a": {"k": ' || k || ', "name": "' || m || '", "v": ' || CAST(v AS BIGINT) || '}}' END AS merged FROM w""")
def reduce_deep_merge(spark: SparkSession, d: str) -> DataFrame:
    """Each user's last event merged into the first, one level down; errors replace what isn't there yet, at any depth."""
    w = writes(spark, d).groupBy("user_id").agg(F.min_by(F.struct("name", "k"), "seq").alias("a"), F.max_by(F.struct("name", F.round("value").cast("long").alias("v")), "seq").alias("b"))
    named = F.struct(F.struct(F.col("b.name").alias("$replace")).alias("name"), F.struct(F.struct(F.lit(5).alias("$replace")).alias("w")).alias("z"))
    new = F.when(F.col("b.name") == "error", F.to_json(named)).otherwise(F.to_json(F.struct(F.col("b").alias("a"))))
    return w.select("user_id", state.deep_merged(F.to_json(F.struct("a")), new).alias("merged"))


@query("""SELECT user_id, '{"name": "' || arg_min(event_type, event_id) || '"}' AS merged FROM events GROUP BY user_id""")
def reduce_merge_patch(spark: SparkSession, d: str) -> DataFrame:
    """The patch takes `k` out."""
    w = writes(spark, d).groupBy("user_id").agg(F.min_by(F.struct("name", "k"), "seq").alias("a"))
    return w.select("user_id", state.merge_patched(F.to_json("a"), F.lit('{"k": null}')).alias("merged"))


def checkpoints(spark: SparkSession, d: str) -> DataFrame:
    """Orders as checkpoints: thread o_custkey, namespace o_orderstatus, each the child of the thread's one before it (every fifth starts anew)."""
    from pyspark.sql.window import Window

    o = table(spark, d, "orders").select(F.col("o_custkey").alias("thread"), F.col("o_orderstatus").alias("namespace"), F.col("o_orderkey").alias("id"), F.round("o_totalprice", 2).alias("state"))
    before = F.lag("id").over(Window.partitionBy("thread").orderBy("id"))
    return o.withColumn("parent", F.when(F.col("id") % 5 != 0, before))


_CHECKPOINTS = """WITH RECURSIVE c AS (SELECT o_custkey AS thread, o_orderstatus AS namespace, o_orderkey AS id, round(o_totalprice, 2) AS state,
CASE WHEN o_orderkey % 5 <> 0 THEN lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END AS parent FROM orders)"""


@query(_CHECKPOINTS + " SELECT thread, namespace, max(id) AS id, arg_max(state, id) AS state FROM c GROUP BY thread, namespace")
def checkpoint_latest(spark: SparkSession, d: str) -> DataFrame:
    c = checkpoints(spark, d).withColumn("seq", F.col("id"))
    return state.latest_checkpoint(c, ["thread", "namespace"]).select("thread", "namespace", "id", "state")


@query(_CHECKPOINTS + """, h AS (SELECT thread, max(id) AS id, CAST(0 AS BIGINT) AS depth FROM c GROUP BY thread
UNION ALL SELECT h.thread, c.parent, h.depth + 1 FROM h JOIN c USING (id) WHERE c.parent IS NOT NULL AND h.depth < 5) SELECT thread, id, depth FROM h""")
def state_history(spark: SparkSession, d: str) -> DataFrame:
    return state.state_history(checkpoints(spark, d), "thread", "id", "parent", "id", 6)


@query(_CHECKPOINTS + """, w AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY thread, namespace ORDER BY id DESC) AS r FROM c) WHERE r <= 1),
k AS (SELECT id FROM w UNION SELECT c.parent FROM k JOIN c USING (id) WHERE c.parent IS NOT NULL) SELECT thread, id FROM c WHERE id IN (SELECT id FROM k)""")
def checkpoint_prune(spark: SparkSession, d: str) -> DataFrame:
    return state.pruned(checkpoints(spark, d), ["thread", "namespace"], "id", "parent", "id", 1).select("thread", "id")


@query("""SELECT l_suppkey AS task, CAST(idx AS BIGINT) AS idx, CASE WHEN idx < 0 THEN arg_max(l_partkey, s) ELSE arg_min(l_partkey, s) END AS part FROM
(SELECT l_suppkey, l_linenumber - 3 AS idx, l_partkey, (l_orderkey, l_partkey, l_quantity, l_extendedprice) AS s FROM lineitem) GROUP BY l_suppkey, idx""")
def merge_writes(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("task"), (F.col("l_linenumber") - 3).cast(L).alias("idx"), F.col("l_partkey").alias("part"), F.struct("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice").alias("seq"))
    return state.merged_writes(w, ["task", "idx"], "idx", "part", "seq")


@query("SELECT o_orderkey AS task FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F')")
def resume_pending_anti(spark: SparkSession, d: str) -> DataFrame:
    tasks = table(spark, d, "orders").select(F.col("o_orderkey").alias("task"))
    markers = table(spark, d, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("task"))
    return state.pending_tasks(tasks, markers, "task")


def steps(spark: SparkSession, d: str) -> DataFrame:
    """Events as a journal: run user_id, node the parity of k, ts in milliseconds; views and sign-ups start, the rest ends."""
    e = table(spark, d, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select(F.col("user_id").alias("run"), (F.get_json_object("props", "$.k").cast(L) % 2).alias("node"), F.col("event_id").alias("seq"), ms.alias("ts_ms"), F.col("event_type").alias("kind"), "value")


@query("""WITH e AS (SELECT user_id AS run, CAST(json_extract(props, '$.k') AS BIGINT) % 2 AS node, event_id AS seq, epoch_us(ts) // 1000 AS ms, event_type IN ('view', 'signup') AS s FROM events),
n AS (SELECT *, sum(s::INT) OVER w AS starts, sum((NOT s)::INT) OVER w AS ends FROM e WINDOW w AS (PARTITION BY run, node ORDER BY seq)),
l AS (SELECT *, greatest(max(ends - starts) OVER (PARTITION BY run, node ORDER BY seq), 0) AS lost FROM n),
p AS (SELECT *, coalesce(lag(lost) OVER (PARTITION BY run, node ORDER BY seq), 0) AS was FROM l),
m AS (SELECT e.run, greatest(e.ms - b.ms, 0) AS ms FROM p e JOIN p b ON b.s AND NOT e.s AND e.lost = e.was AND b.run = e.run AND b.node = e.node AND b.starts = e.ends - e.lost)
SELECT run, count(*) AS nodes, CAST(sum(ms) AS BIGINT) AS total_ms, max(ms) AS max_ms, round(avg(ms), 3) AS average_ms FROM m GROUP BY run""")
def latency_metrics(spark: SparkSession, d: str) -> DataFrame:
    pairs = journal.paired_latencies(steps(spark, d), ["run", "node"], "seq", "ts_ms", F.col("kind").isin("view", "signup"), ~F.col("kind").isin("view", "signup"))
    return pairs.groupBy("run").agg(F.count(F.lit(1)).alias("nodes"), F.sum("elapsed_ms").alias("total_ms"), F.max("elapsed_ms").alias("max_ms"), F.round(F.avg("elapsed_ms"), 3).alias("average_ms"))


@query("""SELECT user_id AS run, count(*) FILTER (WHERE event_type IN ('view', 'signup')) AS started, count(*) FILTER (WHERE event_type IN ('click', 'purchase')) AS completed,
count(*) FILTER (WHERE event_type = 'error') AS failed, CASE WHEN count(*) FILTER (WHERE event_type IN ('click', 'purchase', 'error')) = 0 THEN 0.0 ELSE
round(count(*) FILTER (WHERE event_type = 'error') / count(*) FILTER (WHERE event_type IN ('click', 'purchase', 'error')), 6) END AS failure_rate FROM events GROUP BY user_id""")
def node_health(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("kind")
    found = journal.node_health(steps(spark, d), "run", k.isin("view", "signup"), k.isin("click", "purchase"), k == "error")
    return found.withColumn("failure_rate", F.round("failure_rate", 6))


@query("SELECT user_id AS run, CASE WHEN bool_or(event_type = 'error' AND value > 300) THEN 'completed_with_errors' ELSE 'completed' END AS status FROM events GROUP BY user_id")
def run_status(spark: SparkSession, d: str) -> DataFrame:
    return journal.run_status(steps(spark, d), "run", (F.col("kind") == "error") & (F.col("value") > 300))


@query("SELECT user_id AS run, count(*) FILTER (WHERE event_type = 'error') AS failed_steps, greatest(max(epoch_us(ts) // 1000) - min(epoch_us(ts) // 1000), 0) AS duration_ms FROM events GROUP BY user_id")
def run_failed_steps(spark: SparkSession, d: str) -> DataFrame:
    s = steps(spark, d).withColumn("kind", F.concat(F.lit(" "), F.upper("kind")))
    return journal.failed_steps(s, "run", "kind", "ts_ms", "ts_ms")


@query("""SELECT user_id AS run, count(*) FILTER (WHERE value < 20) AS null_bindings, count(*) FILTER (WHERE event_type = 'view' AND value < 5) AS empty_prompts,
count(*) FILTER (WHERE event_type = 'error' AND value > 200) AS hidden_errors,
count(*) FILTER (WHERE value < 20 OR event_type = 'error' AND value > 200) = 0 AS is_clean FROM events GROUP BY user_id""")
def diagnosis_counts(spark: SparkSession, d: str) -> DataFrame:
    k, v = F.col("kind"), F.col("value")
    return journal.diagnosis(steps(spark, d), "run", v < 20, (k == "view") & (v < 5), (k == "error") & (v > 200))


@query("""SELECT printf('%d steps, %d calls, %d failed, %d null', count(*), count(*) FILTER (WHERE event_type = 'click'), count(*) FILTER (WHERE event_type = 'error'), count(*) FILTER (WHERE value < 20)) AS summary FROM events""")
def trace_summary(spark: SparkSession, d: str) -> DataFrame:
    return journal.trace_summary(steps(spark, d), F.col("kind") == "click", F.col("kind") == "error", F.col("value") < 20)


def tree(spark: SparkSession, d: str) -> DataFrame:
    """Edges region -> nation -> customer."""
    name = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    n = table(spark, d, "nation").select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst"))
    return n.unionByName(table(spark, d, "customer").select(name("n", "c_nationkey").alias("src"), name("c", "c_custkey").alias("dst")))


@query("""SELECT 'r' || r_regionkey AS node, CAST(0 AS BIGINT) AS layer FROM region UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation UNION ALL SELECT 'c' || c_custkey, 2 FROM customer""")
def graph_layers(spark: SparkSession, d: str) -> DataFrame:
    roots = table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    return graphs.layers(tree(spark, d), roots)


@query("""SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
UNION ALL SELECT 'r' || n_regionkey, 'c' || c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def graph_reachability(spark: SparkSession, d: str) -> DataFrame:
    return graphs.reachable(tree(spark, d))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT n_nationkey AS s, (n_nationkey * 7 + 3) % 25 AS t FROM nation WHERE n_regionkey <> 4),
r AS (SELECT s, t FROM e UNION SELECT r.s, e.t FROM r JOIN e ON e.s = r.t) SELECT s AS node FROM r WHERE s = t""")
def validate_cycles(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").where("n_regionkey <> 4")
    return graphs.on_cycle(n.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("dst")))


@query("SELECT l_orderkey * 10 + l_linenumber AS id, count(*) AS times FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def validate_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return graphs.duplicate_ids(table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")))


@query("""SELECT DISTINCT o_orderkey AS id, 'source' AS "end" FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT DISTINCT o_custkey, 'target' FROM orders WHERE o_custkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def validate_endpoints(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"))
    return graphs.unknown_endpoints(nodes, table(spark, d, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst")))


@query("SELECT conv_id AS flow, count(*) FILTER (WHERE role = 'system') AS triggers FROM conversations GROUP BY conv_id HAVING count(*) FILTER (WHERE role = 'system') <> 1")
def validate_triggers(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "conversations").select(F.col("conv_id").alias("flow"), F.when(F.col("role") == "system", "trigger").otherwise("agent").alias("kind"))
    return graphs.trigger_errors(nodes)


@query("SELECT o_orderkey AS dst, o_orderpriority AS port FROM orders WHERE o_custkey % 2 = 0 AND o_custkey IN (SELECT c_custkey FROM customer)")
def validate_condition_ports(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, "condition").otherwise("agent").alias("kind"))
    edges = table(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), F.col("o_orderpriority").alias("port"))
    return graphs.condition_port_errors(nodes, edges).select("dst", "port")


@query("""SELECT 'c' || c_custkey AS node FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal < 0 AND n_regionkey = 2""")
def ancestors_disjoint(spark: SparkSession, d: str) -> DataFrame:
    """Failed nodes under an edited one (region 2); a run may continue where none is left."""
    edited = spark.createDataFrame([("r2",)], "node string")
    failed = table(spark, d, "customer").where("c_acctbal < 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))
    return graphs.edited_above(tree(spark, d), edited, failed)
