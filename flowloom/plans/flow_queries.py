"""Items, routing, joins, fan-out and expressions on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from flowloom.functions import values as V
from flowloom.operators import fanout, items, ledger, state
from flowloom.plans.registry import query
from flowloom.sources.tables import table, void

L = "long"


def orders(spark: SparkSession, d: str) -> DataFrame:
    return items.as_items(table(spark, d, "orders"), "o_orderkey")


def events(spark: SparkSession, d: str) -> DataFrame:
    return items.as_items(table(spark, d, "events"), "event_id")


def order_lines(spark: SparkSession, d: str, base: DataFrame | None = None, one: bool = False) -> DataFrame:
    """Orders (or base; `one`: of a single row) with their lines as an array of structs; an order without lines has an empty one."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast(L).alias("qty"), F.round("l_extendedprice", 2).alias("price"), "l_returnflag", "l_shipdate")
    o = orders(spark, d) if base is None else base
    source = table(spark, d, "lineitem")
    if one:
        source = source.join(F.broadcast(o.select(F.col("o_orderkey").alias("l_orderkey"))), "l_orderkey", "left_semi")
    lines = source.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    joined = o.join(lines, o.o_orderkey == lines.l_orderkey, "left")
    return joined.withColumn("lines", F.coalesce("lines", F.array().cast(lines.schema["lines"].dataType))).drop("l_orderkey")


@query("""WITH i AS (SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'gold' ELSE 'base' END AS tier,
                         row_number() OVER (ORDER BY o_orderkey) - 1 AS ord FROM orders),
     port AS (SELECT (SELECT count(*) FROM lineitem WHERE l_orderkey = i.o_orderkey) <> 0 AS p FROM i WHERE ord = 0)
SELECT tier, count(*) AS n, CAST(sum(ord) AS BIGINT) AS pairs, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty
FROM i JOIN lineitem ON l_orderkey = o_orderkey WHERE (SELECT p FROM port) GROUP BY tier""")
def flow_order_etl(spark: SparkSession, d: str) -> DataFrame:
    """trigger -> transform -> condition -> split_out, then counted."""
    placed = items.positions(orders(spark, d).select("o_orderkey", "o_totalprice", items.ORD), items.ORD)  # before the lines, which are wide
    batch = order_lines(spark, d, placed)
    tiered = items.transform_set(batch, {"tier": F.when(F.col("o_totalprice") > 250000, "gold").otherwise("base")})
    first = order_lines(spark, d, placed.orderBy(items.ORD).limit(1), one=True)
    chosen = items.condition(tiered, F.col("lines"), tiered.schema["lines"].dataType, True, first)
    out = items.split_out(chosen, "lines")
    return out.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.sum("position").alias("pairs"), F.sum("value.qty").alias("qty"))


@query("SELECT o_orderkey AS ord, o_custkey, o_orderstatus, round(o_totalprice, 2) AS total FROM orders")
def trigger_scan(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).select("ord", "o_custkey", "o_orderstatus", F.round("o_totalprice", 2).alias("total"))


@query("SELECT count(*) AS discarded FROM events")
def void_count(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(void(events(spark, d)),)], "discarded long")


@query("""SELECT event_id AS ord, CASE WHEN substr(props, 1, 1) IN ('{', '[') THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
CAST(NULL AS VARCHAR) AS text, props AS raw FROM events
UNION ALL SELECT -1 - c.conv_id * 1000 - c.turn, NULL, c.text, c.text FROM conversations c""")
def envelope_wrap(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("ord", V.envelope(F.col("props")).alias("e")).select("ord", F.get_json_object("e.json", "$.k").cast(L).alias("k"), "e.text", "e.raw")
    quoted = F.to_json(F.col("text").cast("variant"))  # a plain string as JSON text
    c = table(spark, d, "conversations").select((F.lit(-1) - F.col("conv_id") * 1000 - F.col("turn")).alias("ord"), V.envelope(quoted).alias("e"), "text")
    return e.unionByName(c.select("ord", F.lit(None).cast(L).alias("k"), "e.text", F.col("text").alias("raw")))


@query("""SELECT o_orderkey AS paired_item, CASE WHEN o_totalprice > 250000 THEN 'gold' ELSE 'base' END AS o_orderstatus,
o_orderstatus AS was, round(o_totalprice * 2, 2) AS doubled FROM orders""")
def transform_set(spark: SparkSession, d: str) -> DataFrame:
    """`was` reads the item as it came, though o_orderstatus is set too."""
    sets = {"o_orderstatus": F.when(F.col("o_totalprice") > 250000, "gold").otherwise("base"), "was": F.col("o_orderstatus"), "doubled": F.round(F.col("o_totalprice") * 2, 2)}
    return items.transform_set(orders(spark, d), sets).select("paired_item", "o_orderstatus", "was", "doubled")


@query("""WITH n AS (SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS c, o_orderkey % 3 AS m,
CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN NULL ELSE o_orderstatus END AS s FROM orders)
SELECT o_orderkey AS ord, c > 0 AS lines, m <> 0 AS number, coalesce(s <> '', false) AS string, coalesce(m > 1, false) AS flag FROM n""")
def truthiness(spark: SparkSession, d: str) -> DataFrame:
    o = order_lines(spark, d).withColumn("m", F.col("ord") % 3)
    o = o.withColumn("s", F.when(F.col("ord") % 4 == 0, "").when(F.col("ord") % 4 == 1, F.lit(None)).otherwise(F.col("o_orderstatus"))).withColumn("f", F.col("m") > 1)
    return o.select("ord", *[V.truthy(F.col(c), o.schema[c].dataType).alias(n) for c, n in (("lines", "lines"), ("m", "number"), ("s", "string"), ("f", "flag"))])


@query("SELECT event_id AS ord, user_id FROM events WHERE (SELECT coalesce(arg_min(value, event_id), 0) <> 0 FROM events)")
def condition_true(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    return items.condition(e, F.col("value"), DoubleType(), True).select("ord", "user_id")


@query("SELECT event_id AS ord, user_id FROM events WHERE NOT (SELECT arg_min(event_type = 'error' AND user_id < 0, event_id) FROM events)")
def condition_false(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("flag", (F.col("event_type") == "error") & (F.col("user_id") < 0))
    return items.condition(e, F.col("flag"), e.schema["flag"].dataType, False).select("ord", "user_id")


@query("SELECT o_orderkey AS ord, (SELECT arg_min(o_orderstatus, o_orderkey) FROM orders) AS port FROM orders")
def switch_route(spark: SparkSession, d: str) -> DataFrame:
    return items.switch(orders(spark, d), F.col("o_orderstatus"), StringType()).select("ord", "port")


@query("""SELECT d.doc_id AS ord, concat_ws('; ', CASE WHEN quality IS NULL THEN '$.quality: missing' END,
CASE WHEN NOT coalesce(lang IN ('en', 'de'), false) THEN '$.lang: not one of the values' END, CASE WHEN quality IS NOT NULL AND quality NOT IN (1) THEN '$.quality: not one of the values' END) AS errors
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def schema_validate(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("ord"), "lang")
    docs = docs.join(table(spark, d, "labels").withColumnRenamed("doc_id", "ord"), "ord", "left")
    schema = {"required": ["quality"], "properties": {"lang": {"type": "string", "enum": ["en", "de"]}, "quality": {"type": "integer", "enum": [1]}}}
    return items.validated(docs, schema, ["lang", "quality"]).select("ord", F.array_join("errors", "; ").alias("errors"))


@query("""SELECT CAST(row_number() OVER (ORDER BY input, ord) - 1 AS BIGINT) AS position, CAST(input AS BIGINT) AS input, ord, name FROM
(SELECT 0 AS input, s_suppkey AS ord, s_name AS name FROM supplier UNION ALL SELECT 1, c_custkey, c_name FROM customer)""")
def merge_concat(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("ord"), F.col("s_name").alias("name"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("ord"), F.col("c_name").alias("name"))
    return items.positions(items.merge(s, c), "input", "ord").select("position", F.col("input").cast(L).alias("input"), "ord", "name")


@query("""SELECT l_orderkey AS paired_item, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT), round(l_extendedprice, 2), l_returnflag, l_shipdate) - 1 AS BIGINT) AS element,
l_partkey AS part, CAST(l_quantity AS BIGINT) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def split_out_explode(spark: SparkSession, d: str) -> DataFrame:
    out = items.split_out(order_lines(spark, d), "lines")
    return out.select("paired_item", F.col("element").cast(L).alias("element"), F.col("value.l_partkey").alias("part"), "value.qty")


@query("""SELECT d.doc_id AS ord, concat_ws(',', CASE WHEN quality IS NULL THEN 'item.quality' END, CASE WHEN nullif(lang, 'en') IS NULL THEN 'item.lang' END) AS nulls
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def null_bindings(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("ord"), "lang").join(table(spark, d, "labels").withColumnRenamed("doc_id", "ord"), "ord", "left")
    found = items.null_bindings({"item.quality": F.col("quality"), "item.lang": F.nullif("lang", F.lit("en"))})
    return docs.select("ord", F.array_join(found, ",").alias("nulls"))


@query("SELECT event_id AS paired_item, CAST(json_extract(props, '$.k') AS BIGINT) * 2 AS doubled FROM events")
def per_item_map(spark: SparkSession, d: str) -> DataFrame:
    k = V.at_path(F.col("props"), "k", StringType()).cast(L)
    return items.transform_set(events(spark, d), {"doubled": k * 2}).select("paired_item", "doubled")



def _called(spark: SparkSession, d: str, on_error: str) -> DataFrame:
    e = events(spark, d)
    k = V.at_path(F.col("props"), "k", StringType()).cast(L)
    value = F.floor(F.try_divide(F.lit(100), k)).cast(L)
    return items.with_errors(e, value, (F.col("event_type") == "error") | (k == 0), F.concat(F.lit("no answer for "), F.col("user_id").cast("string")), on_error)


@query("""SELECT event_id AS ord, CASE WHEN event_type = 'error' OR k = 0 THEN NULL ELSE 100 // k END AS value,
CASE WHEN event_type = 'error' OR k = 0 THEN 'no answer for ' || user_id END AS error, event_type = 'error' OR k = 0 AS failed
FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""")
def item_error_collect(spark: SparkSession, d: str) -> DataFrame:
    return _called(spark, d, "collect").select("ord", "value", "error", "failed")


@query("""SELECT event_id AS ord, 100 // k AS value FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
WHERE event_type <> 'error' AND k <> 0""")
def item_error_skip(spark: SparkSession, d: str) -> DataFrame:
    return _called(spark, d, "skip").select("ord", "value")


@query("""SELECT p_partkey AS lesson, count(*) AS evidence, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty
FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey""")
def evidence_join(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("evidence"), F.sum(F.col("l_quantity").cast(L)).alias("qty"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("lesson")).join(line, F.col("lesson") == line.l_partkey).drop("l_partkey")


@query("""SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_extendedprice > (SELECT avg(o_totalprice) / 5 FROM orders) GROUP BY l_returnflag""")
def cross_node_ref(spark: SparkSession, d: str) -> DataFrame:
    node = table(spark, d, "orders").agg((F.avg("o_totalprice") / 5).alias("least"))
    line = table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice").crossJoin(F.broadcast(node))
    return line.where(F.col("l_extendedprice") > F.col("least")).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey AS ord, r.n IS NOT NULL AS done, r.n FROM orders LEFT JOIN
(SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) r ON l_orderkey = o_orderkey""")
def gate_join(spark: SparkSession, d: str) -> DataFrame:
    results = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("ord")).agg(F.count(F.lit(1)).alias("n"))
    return fanout.gate(orders(spark, d).select("ord"), results, "ord").select("ord", "done", "n")


@query("SELECT c_custkey AS node FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def never_ran_anti(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "customer").select(F.col("c_custkey").alias("node"))
    return nodes.join(table(spark, d, "orders").select(F.col("o_custkey").alias("node")), "node", "left_anti")


@query("""SELECT min(event_id) AS ord, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 100) GROUP BY user_id""")
def dedup_committed_anti(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    committed = fanout.new_keys(e.where("event_type = 'purchase' and value > 100"), F.col("user_id"))
    return fanout.dedup(e, F.col("user_id"), committed).select("ord", "user_id")


@query("SELECT min(event_id) AS ord, user_id FROM events WHERE user_id % 7 <> 0 GROUP BY user_id UNION ALL SELECT event_id, user_id FROM events WHERE user_id % 7 = 0")
def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    """Users divisible by 7 have no key, so all their items pass."""
    e = events(spark, d)
    return fanout.dedup(e, F.when(F.col("user_id") % 7 != 0, F.col("user_id"))).select("ord", "user_id")


@query("""SELECT p_partkey AS tool, lower(p_type) || '.' || p_brand AS name FROM part
WHERE starts_with(lower(p_type) || '.' || p_brand, 'economy.') OR starts_with(lower(p_type) || '.' || p_brand, 'pro') OR lower(p_type) || '.' || p_brand = 'small.Brand#4'""")
def tool_grant_semi(spark: SparkSession, d: str) -> DataFrame:
    tools = table(spark, d, "part").select(F.col("p_partkey").alias("tool"), F.concat(F.lower("p_type"), F.lit("."), F.col("p_brand")).alias("name"))
    grants = spark.createDataFrame([("economy..*",), ("pro.*",), ("small.Brand#4",)], "pattern string")
    return ledger.granted(tools, grants, "name", "pattern")


@query("""SELECT o_orderkey AS ord, (row_number() OVER (ORDER BY o_orderkey) - 1) // CAST(ceil(n / 7.0) AS BIGINT) AS lane, CAST(ceil(n / ceil(n / 7.0)) AS BIGINT) AS lane_count
FROM orders, (SELECT count(*) AS n FROM orders)""")
def scatter_lanes(spark: SparkSession, d: str) -> DataFrame:
    return fanout.scatter(orders(spark, d).select("ord"), 7).select("ord", "lane", "lane_count")


_LANES = """WITH l AS (SELECT event_id AS ord, event_type, user_id, (row_number() OVER (ORDER BY event_id) - 1) // CAST(ceil(n / 64.0) AS BIGINT) AS lane FROM events, (SELECT count(*) AS n FROM events)),
bad AS (SELECT lane, arg_min('no answer for ' || user_id, ord) AS error FROM l WHERE event_type = 'error' AND user_id % 10 = 3 GROUP BY lane)
"""


def _gathered(spark: SparkSession, d: str, on_error: str) -> DataFrame:
    lanes = fanout.scatter(events(spark, d).select("ord", "event_type", "user_id"), 64)
    return fanout.gather(lanes, (F.col("event_type") == "error") & (F.col("user_id") % 10 == 3), F.concat(F.lit("no answer for "), F.col("user_id").cast("string")), on_error)


@query(_LANES + "SELECT lane, ord, CAST(NULL AS VARCHAR) AS error, false AS failed FROM l WHERE lane NOT IN (SELECT lane FROM bad) UNION ALL SELECT lane, NULL, error, true FROM bad")
def gather_collect(spark: SparkSession, d: str) -> DataFrame:
    return _gathered(spark, d, "collect").select("lane", "ord", "error", "failed")


@query(_LANES + "SELECT lane, ord FROM l WHERE lane NOT IN (SELECT lane FROM bad)")
def gather_skip(spark: SparkSession, d: str) -> DataFrame:
    return _gathered(spark, d, "skip").select("lane", "ord")


@query("""WITH a AS (SELECT o_custkey, count(*) AS arrived FROM orders GROUP BY o_custkey)
SELECT o_custkey, CASE WHEN arrived >= 12 THEN 'emit' WHEN o_custkey % 2 = 0 THEN 'wait' ELSE 'timeout' END AS for_all, 'emit' AS for_any,
CASE WHEN arrived >= 8 THEN 'emit' WHEN o_custkey % 2 = 0 THEN 'wait' ELSE 'timeout' END AS for_quorum,
CASE WHEN arrived >= 12 THEN 'emit' WHEN o_custkey % 2 = 0 THEN 'wait' ELSE 'emit' END AS for_partial FROM a""")
def release_policy(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("arrived"))
    rule = lambda p, n=1: fanout.release(p, F.col("arrived"), F.lit(12), F.col("o_custkey") % 2 != 0, n)
    return a.select("o_custkey", rule("all").alias("for_all"), rule("any").alias("for_any"), rule("quorum", 8).alias("for_quorum"), rule("timeout_partial").alias("for_partial"))


@query("""WITH RECURSIVE s AS (SELECT o_orderkey AS ord, CAST(floor(o_totalprice) AS BIGINT) AS x, 0 AS k FROM orders
UNION ALL SELECT ord, CASE WHEN x % 2 = 0 THEN x // 2 ELSE 3 * x + 1 END, k + 1 FROM s WHERE x <> 1 AND k < 25)
SELECT ord, arg_max(x, k) AS x, CAST(max(k) AS BIGINT) AS iteration, CASE WHEN arg_max(x, k) = 1 THEN 'until' ELSE 'max_iterations' END AS exit_reason FROM s GROUP BY ord""")
def loop_bounded_state(spark: SparkSession, d: str) -> DataFrame:
    start = orders(spark, d).select("ord", F.floor("o_totalprice").cast(L).alias("x"))
    x = F.col("x")
    return fanout.loop(start, lambda df: df.withColumn("x", F.when(x % 2 == 0, F.floor(x / 2)).otherwise(3 * x + 1).cast(L)), x == 1)


def _child(df: DataFrame) -> DataFrame:
    return items.transform_set(df.where("value > 50"), {"value": F.round(F.col("value") * 2, 2)})


@query("SELECT event_id AS paired_item, round(round(value * 2, 2) * 2, 2) AS value FROM events WHERE value > 50")
def sub_flow(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("ord", "value").transform(_child).transform(_child).select("paired_item", "value")


@query("""SELECT o_orderkey AS ord, CASE WHEN o_orderstatus = 'P' THEN CASE WHEN o_custkey % 5 >= 3 THEN 'timeout' ELSE 'waiting' END
WHEN o_orderstatus = 'F' THEN 'approved' ELSE 'rejected' END AS port FROM orders""")
def approval_route(spark: SparkSession, d: str) -> DataFrame:
    """Decisions come from a table of their own, not from the items."""
    o = orders(spark, d)
    decisions = o.where("o_orderstatus <> 'P'").select("ord", (F.col("o_orderstatus") == "F").alias("decision"))
    port = fanout.approval_port(F.col("decision"), F.col("o_custkey") % 5, 3)
    return o.join(decisions, "ord", "left").select("ord", port.alias("port"))


@query("""SELECT CAST(input AS BIGINT) AS input, o_orderkey AS ord, round(x, 2) AS x FROM (
SELECT 0 AS input, o_orderkey, o_totalprice * 2 AS x FROM orders UNION ALL SELECT 1, o_orderkey, o_totalprice * 3 FROM orders WHERE o_orderstatus = 'F')""")
def fan_out_merge(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d).select("ord", "o_totalprice", "o_orderstatus")
    a = items.transform_set(o, {"x": F.col("o_totalprice") * 2})
    b = items.transform_set(o.where("o_orderstatus = 'F'"), {"x": F.col("o_totalprice") * 3})
    return items.merge(a, b).select(F.col("input").cast(L).alias("input"), "ord", F.round("x", 2).alias("x"))


@query("""SELECT c_custkey AS child, n_regionkey AS root, CAST(2 AS BIGINT) AS depth FROM customer JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT -1 - n_nationkey, n_regionkey, 1 FROM nation""")
def lineage_family(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's and nation's topmost ancestor, by walking parents 8 steps at most."""
    name = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    parents = c.select(name("c", "c_custkey").alias("id"), name("n", "c_nationkey").alias("parent")).unionByName(n.select(name("n", "n_nationkey").alias("id"), name("r", "n_regionkey").alias("parent")))
    up = state.ancestors(parents, parents, "id", "parent", 8)
    top = up.groupBy("origin").agg(F.max_by("node", "depth").alias("top"), F.max("depth").alias("depth"))
    number = F.substring("origin", 2, 20).cast(L)
    child = F.when(F.startswith("origin", F.lit("c")), number).otherwise(-1 - number)
    return top.select(child.alias("child"), F.substring("top", 2, 20).cast("int").alias("root"), "depth")


@query("""SELECT o_orderkey AS ord, lines[1].p AS first_part, lines[-1].p AS last_part, coalesce(len(lines), 0) AS n FROM orders LEFT JOIN
(SELECT l_orderkey, list({'n': l_linenumber, 'p': l_partkey, 's': l_suppkey} ORDER BY l_linenumber, l_partkey, l_suppkey) AS lines FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey""")
def expr_path_index(spark: SparkSession, d: str) -> DataFrame:
    o = order_lines(spark, d)
    return o.select("ord", V.element(F.col("lines"), 0)["l_partkey"].alias("first_part"), V.element(F.col("lines"), -1)["l_partkey"].alias("last_part"), F.size("lines").cast(L).alias("n"))


@query("""SELECT o_orderkey AS ord, round(t, 2) AS total, coalesce(n, 0) AS n FROM orders LEFT JOIN
(SELECT l_orderkey, sum(round(l_extendedprice, 2)) AS t, count(*) FILTER (WHERE l_quantity > 25) AS n FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey""")
def expr_add_map_select(spark: SparkSession, d: str) -> DataFrame:
    o = order_lines(spark, d)
    return o.select("ord", F.round(V.total(F.col("lines.price"), DoubleType()), 2).alias("total"), F.size(F.filter("lines", lambda x: x["qty"] > 25)).cast(L).alias("n"))


@query("""SELECT o_orderkey AS ord, coalesce(a, false) AS any_returned, coalesce(b, true) AS all_big, f AS first_big FROM orders LEFT JOIN
(SELECT l_orderkey, bool_or(l_returnflag = 'R') AS a, bool_and(l_quantity > 5) AS b,
arg_min(l_partkey, (l_linenumber, l_partkey, l_suppkey)) FILTER (WHERE l_quantity > 40) AS f FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey""")
def expr_any_all(spark: SparkSession, d: str) -> DataFrame:
    o = order_lines(spark, d)
    first = V.first_where(F.col("lines"), lambda x: x["qty"] > 40)["l_partkey"]
    return o.select("ord", F.exists("lines", lambda x: x["l_returnflag"] == "R").alias("any_returned"), F.forall("lines", lambda x: x["qty"] > 5).alias("all_big"), first.alias("first_big"))


@query("""SELECT event_id AS ord, CASE WHEN user_id % 10 = 0 THEN NULL ELSE round(value / (user_id % 10), 6) END AS quotient,
CASE WHEN user_id % 10 = 0 THEN NULL ELSE event_id % (user_id % 10) END AS rest FROM events""")
def expr_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    """What would be an error is null."""
    by = F.col("user_id") % 10
    return events(spark, d).select("ord", F.round(F.try_divide("value", by.cast("double")), 6).alias("quotient"), F.try_mod("event_id", by).alias("rest"))


@query("SELECT event_id AS ord, CASE WHEN coalesce(nullif(event_type, 'view'), 'none') = 'none' THEN upper(event_type) ELSE event_type || '-' || user_id END AS label FROM events")
def expr_if_concat(spark: SparkSession, d: str) -> DataFrame:
    kind = F.nullif("event_type", F.lit("view"))
    label = F.when(~V.holds(kind, StringType()), F.upper("event_type")).otherwise(F.concat("event_type", F.lit("-"), F.col("user_id").cast("string")))
    return events(spark, d).select("ord", label.alias("label"))


@query("""WITH v AS (SELECT event_id AS ord, CASE event_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 ELSE 5 END AS k, value, event_type, user_id FROM events)
SELECT ord, row_number() OVER (PARTITION BY user_id ORDER BY k, CASE WHEN k = 3 THEN value END, CASE WHEN k = 4 THEN CASE WHEN ord % 4 = 0 THEN event_type || ' x' ELSE event_type END END, CASE WHEN k = 5 THEN ord % 100 END, ord) AS place FROM v""")
def expr_order_types(spark: SparkSession, d: str) -> DataFrame:
    """null < false < true < numbers < strings < arrays, on values of mixed types."""
    from pyspark.sql.window import Window

    k = F.col("event_id") % 6
    text = F.when(k == 0, "null").when(k == 1, "false").when(k == 2, "true").when(k == 3, F.col("value").cast("string")).when(k == 4, F.concat(F.lit('"'), F.col("event_type"), F.when(F.col("event_id") % 4 == 0, ' x"').otherwise('"'))).otherwise(F.concat(F.lit("["), (F.col("event_id") % 100).cast("string"), F.lit("]")))
    e = events(spark, d).withColumn("key", V.order_key(F.parse_json(text)))
    return e.select("ord", F.row_number().over(Window.partitionBy("user_id").orderBy("key", "ord")).cast(L).alias("place"))


@query("SELECT event_id AS ord, md5(event_type || ':' || user_id) AS tag, sha256(props) AS fingerprint FROM events")
def graph_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("ord", F.md5(F.concat("event_type", F.lit(":"), F.col("user_id").cast("string")).cast("binary")).alias("tag"), F.sha2("props", 256).alias("fingerprint"))


@query("""SELECT event_id AS ord, lower(printf('%016x', CAST(h AS UBIGINT))) AS digest FROM (SELECT event_id, list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), list_transform(string_split(props, ''), lambda c: CAST(unicode(c) AS HUGEINT))),
lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616) AS h FROM events)""")
def fnv_digest(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("ord", V.fnv1a64("props").alias("digest"))


@query("""WITH RECURSIVE n AS (SELECT doc_id, text, least(length(text), 64) AS k FROM documents UNION ALL SELECT doc_id, text, k - 1 FROM n WHERE strlen(left(text, k)) > 64)
SELECT doc_id AS ord, left(text, CAST(min(k) AS BIGINT)) AS evidence FROM n GROUP BY doc_id, text""")
def bounded_evidence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("ord"), V.bounded(F.col("text"), 64).alias("evidence"))


@query("SELECT event_type, count(*) FILTER (WHERE props LIKE '%\"k\": 1%') AS ones, count(*) FILTER (WHERE event_type LIKE '%e%r%') AS errors FROM events GROUP BY event_type")
def glob_count(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy("event_type").agg(F.count_if(V.glob(F.col("props"), '*"k": 1*')).alias("ones"), F.count_if(V.glob(F.col("event_type"), "*e*r*")).alias("errors"))


@query("""SELECT CAST(a AS BIGINT) AS attempt, least(100 * (1 << a), 60000) AS exponential, CAST(250 AS BIGINT) AS fixed FROM range(0, 15) t(a)""")
def retry_schedule(spark: SparkSession, d: str) -> DataFrame:
    t = fanout.retry_schedule(spark.range(15).withColumnRenamed("id", "attempt"), "attempt", 100).withColumnRenamed("wait_ms", "exponential")
    return fanout.retry_schedule(t, "attempt", 250, "fixed").withColumnRenamed("wait_ms", "fixed")


@query("""SELECT event_id AS ord, CASE WHEN event_type = 'error' THEN 'error' ELSE 'main' END AS port, CASE WHEN event_type = 'error' THEN 'failed at score' END AS message FROM events""")
def on_error_continue(spark: SparkSession, d: str) -> DataFrame:
    made = items.with_errors(events(spark, d), F.col("value"), F.col("event_type") == "error", F.lit("failed at score"))
    return made.select("ord", F.when(F.col("failed"), "error").otherwise("main").alias("port"), F.col("error").alias("message"))
