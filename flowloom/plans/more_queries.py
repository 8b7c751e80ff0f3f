"""Expression functions, memories, graph edits and stores on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions import expr as X
from flowloom.operators import fanout, graphs, memory, state
from flowloom.plans.flow_queries import order_lines
from flowloom.plans.registry import query
from flowloom.plans.state_queries import tree
from flowloom.sources.tables import latest_documents, table

L = "long"

_LINES = """WITH o AS (SELECT o_orderkey AS ord, coalesce(lines, []) AS lines FROM orders LEFT JOIN (SELECT l_orderkey, list({'n': l_linenumber, 'p': l_partkey, 's': l_suppkey, 'q': CAST(l_quantity AS BIGINT), 'f': l_returnflag}
ORDER BY l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT), round(l_extendedprice, 2), l_returnflag, l_shipdate) AS lines FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey)
"""


@query(_LINES + """SELECT ord, array_to_string(list_transform(list_sort(list_transform(lines, lambda x: {'q': x.q, 'p': x.p})), lambda x: x.p), ',') AS by_qty,
array_to_string(list_sort(list_distinct(list_transform(lines, lambda x: x.f))), ',') AS flags, array_to_string(list_transform(list_reverse(lines), lambda x: x.p), ',') AS reversed FROM o""")
def expr_sort_unique(spark: SparkSession, d: str) -> DataFrame:
    o = order_lines(spark, d)
    pairs = F.transform("lines", lambda x: F.struct(x["qty"].alias("q"), x["l_partkey"].alias("p")))
    by_qty = F.transform(X.sort_by(F.array_sort(pairs), lambda x: x["q"]), lambda x: x["p"])
    flags = F.transform(X.unique_by(F.col("lines"), lambda x: x["l_returnflag"]), lambda x: x["l_returnflag"])
    return o.select("ord", X.joined(by_qty, ",").alias("by_qty"), X.joined(flags, ",").alias("flags"), X.joined(F.transform(F.reverse("lines"), lambda x: x["l_partkey"]), ",").alias("reversed"))


@query(_LINES + """SELECT ord, CAST(list_sum(list_transform(list_filter(lines, lambda x: x.f = 'A'), lambda x: x.q)) AS BIGINT) AS a, CAST(list_sum(list_transform(list_filter(lines, lambda x: x.f = 'N'), lambda x: x.q)) AS BIGINT) AS n,
CAST(list_sum(list_transform(list_filter(lines, lambda x: x.f = 'R'), lambda x: x.q)) AS BIGINT) AS r FROM o""")
def expr_group_entries(spark: SparkSession, d: str) -> DataFrame:
    """group_by, then an object of sums by flag."""
    groups = X.group_by(F.col("lines"), lambda x: x["l_returnflag"])
    entries = F.transform(groups, lambda g: F.struct(X.first_of(g)["l_returnflag"].alias("key"), X.reduce(g, F.lit(0).cast(L), lambda s, x: s + x["qty"]).alias("value")))
    m = order_lines(spark, d).withColumn("m", X.from_entries(entries))
    return m.select("ord", *[F.try_element_at("m", F.lit(k)).alias(k.lower()) for k in "ANR"])


@query(_LINES + """SELECT ord, list_max(list_transform(lines, lambda x: x.q)) AS most, list_min(list_transform(lines, lambda x: x.q)) AS least, CAST(coalesce(list_position(list_transform(lines, lambda x: x.f), 'R'), 0) - 1 AS BIGINT) AS first_r,
len(list_filter(lines, lambda x: x.f = 'R')) AS n_r, array_to_string(list_transform(lines[1:2], lambda x: x.p), '/') AS first_two FROM o""")
def expr_extremes_indices(spark: SparkSession, d: str) -> DataFrame:
    lines = F.col("lines")
    at = X.indices(F.transform(lines, lambda x: x["l_returnflag"]), F.lit("R"))
    return order_lines(spark, d).select(
        "ord", X.max_by(lines, lambda x: x["qty"])["qty"].alias("most"), X.min_by(lines, lambda x: x["qty"])["qty"].alias("least"), X.alternative(X.first_of(at), F.lit(-1).cast(L)).alias("first_r"),
        F.size(at).cast(L).alias("n_r"), X.joined(F.transform(X.limit(lines, 2), lambda x: x["l_partkey"]), "/").alias("first_two"),
    )


@query(_LINES + "SELECT ord, array_to_string(list_transform(range(1, len(lines) + 1), lambda k: CAST(list_sum(list_transform(lines[1:k], lambda x: x.q)) AS BIGINT)), ',') AS running FROM o")
def expr_foreach(spark: SparkSession, d: str) -> DataFrame:
    running = X.running(F.col("lines"), F.lit(0).cast(L), lambda s, x: s + x["qty"])
    return order_lines(spark, d).select("ord", X.joined(running, ",").alias("running"))


@query("""SELECT p_partkey AS id, CASE WHEN starts_with(p_brand, 'Brand#') THEN substr(p_brand, 7) ELSE p_brand END AS brand, CASE WHEN p_name LIKE '%widget' THEN left(p_name, length(p_name) - 6) ELSE p_name END AS stem,
len(string_split(p_name, ' ')) AS words, array_to_string(list_reverse(string_split(p_name, ' ')), '-') AS back, TRY_CAST(substr(p_brand, 7) AS DOUBLE) AS number, CAST(unicode(p_name) AS BIGINT) AS code FROM part""")
def expr_strings(spark: SparkSession, d: str) -> DataFrame:
    p, name = table(spark, d, "part"), F.col("p_name")
    brand, words = X.ltrimstr(F.col("p_brand"), "Brand#"), X.pieces(name, " ")
    return p.select(F.col("p_partkey").alias("id"), brand.alias("brand"), X.rtrimstr(name, "widget").alias("stem"), F.size(words).cast(L).alias("words"), X.joined(F.reverse(words), "-").alias("back"), X.to_number(brand).alias("number"), X.first_of(X.code_points(name)).alias("code"))


@query("""SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN 'null' WHEN 1 THEN 'boolean' WHEN 2 THEN 'number' WHEN 3 THEN 'string' WHEN 4 THEN 'array' ELSE 'object' END AS type FROM events""")
def expr_types(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 6
    text = F.when(k == 0, "null").when(k == 1, "false").when(k == 2, F.col("value").cast("string")).when(k == 3, F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))).when(k == 4, "[1]").otherwise(F.col("props"))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), X.type_name(F.parse_json(text)).alias("type"))


@query("""WITH m AS (SELECT conv_id, turn, len(list_intersect(['the', 'of', 'de', 'que', 'und'], list_distinct(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')))) / 5 AS score FROM conversations)
SELECT conv_id, turn, score FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS place FROM m WHERE score > 0.3) WHERE place <= 2""")
def memory_recall(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("scope"), F.col("turn").alias("id"), "text")
    return memory.recall(rows, "the of de que und", 2, 0.3).select(F.col("scope").alias("conv_id"), F.col("id").alias("turn"), "score")


@query("""SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'redacted' ELSE role END AS role FROM conversations WHERE NOT (role = 'assistant' AND turn > 3)""")
def memory_remember_forget(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("scope"), F.col("turn").alias("id"), F.col("role").alias("text"))
    rows = memory.remember(rows, rows.where("text = 'system'").withColumn("text", F.lit("redacted")))
    kept = memory.forget(rows, rows.where("text = 'assistant' and id > 3"))
    return kept.select(F.col("scope").alias("conv_id"), F.col("id").alias("turn"), F.col("text").alias("role"))


@query("""SELECT CASE WHEN n_regionkey = 2 THEN 'asia' ELSE 'r' || n_regionkey END AS src, 'n' || n_nationkey AS dst FROM nation WHERE n_nationkey <> 7
UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer WHERE c_nationkey <> 7""")
def graph_edits(spark: SparkSession, d: str) -> DataFrame:
    edges = tree(spark, d)
    nodes = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    nodes, edges = graphs.renamed_node(nodes, edges, "r2", "asia")
    return graphs.removed_node(nodes, edges, "n7")[1]


@query("""SELECT c_custkey AS id, '{"balance": ' || CAST(round(c_acctbal) AS BIGINT) || CASE WHEN c_custkey % 2 = 0 THEN '}' ELSE ', "segment": "' || c_mktsegment || '"}' END AS config FROM customer""")
def graph_config_patch(spark: SparkSession, d: str) -> DataFrame:
    """Patches of every second node take `segment` out."""
    nodes = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.to_json(F.struct(F.round("c_acctbal").cast(L).alias("balance"), F.col("c_mktsegment").alias("segment"))).alias("config"))
    patches = nodes.select("id", F.when(F.col("id") % 2 == 0, '{"segment": null}').otherwise("{}").alias("patch"))
    return graphs.patched_configs(nodes, patches)


@query("""SELECT o_custkey AS id, arg_max(round(o_totalprice, 2), o_orderkey) AS total, max(o_orderkey) AS revision FROM orders GROUP BY o_custkey""")
def store_upsert(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.round("o_totalprice", 2).alias("total"), F.col("o_orderkey").alias("revision"))
    return latest_documents(o, "id", "revision")


_NOTES = """WITH RECURSIVE n AS (SELECT o_custkey AS author, o_orderkey AS id, CASE WHEN o_orderkey % 3 <> 0 THEN lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END AS next, o_totalprice > 495000 AS pinned FROM orders),
u AS (SELECT id, id AS top FROM n UNION ALL SELECT u.id, n.next FROM u JOIN n ON n.id = u.top WHERE n.next IS NOT NULL), g AS (SELECT id, max(top) AS grp FROM u GROUP BY id),
s AS (SELECT author, grp, count(*) AS k, bool_or(pinned) AS p, min(id) AS oldest FROM n JOIN g USING (id) GROUP BY author, grp),
r AS (SELECT author, grp, sum(k) OVER (PARTITION BY author ORDER BY oldest) - k AS before FROM s WHERE NOT p),
x AS (SELECT author, grp FROM r WHERE before < (SELECT count(*) FROM n m WHERE m.author = r.author) - 6)
"""


@query(_NOTES + "SELECT n.author, n.id FROM n JOIN g USING (id) WHERE (n.author, g.grp) NOT IN (SELECT author, grp FROM x)")
def notes_retained(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    o = table(spark, d, "orders").select(F.col("o_custkey").alias("author"), F.col("o_orderkey").alias("id"), (F.col("o_totalprice") > 495000).alias("pinned"))
    o = o.withColumn("next", F.when(F.col("id") % 3 != 0, F.lead("id").over(Window.partitionBy("author").orderBy("id"))))
    return state.retained_notes(o, "author", "id", "next", "pinned", 6).select("author", "id")


@query("""SELECT o_custkey, count(DISTINCT o_orderstatus) AS arrived, count(DISTINCT o_orderstatus) = 3 AS complete FROM orders GROUP BY o_custkey""")
def fan_in_barrier(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "orders").select("o_custkey", F.col("o_orderstatus").alias("input"))
    return fanout.fan_in(parts, "o_custkey").withColumn("complete", F.col("arrived") == 3)


@query("""SELECT o_orderkey AS id, o_custkey AS thread FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 490000)""")
def checkpoint_delete_runs(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    gone = o.where("o_totalprice > 490000").select(F.col("o_custkey").alias("thread"))
    return state.without_runs(o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("thread")), gone, "thread")


@query("SELECT l_partkey AS src, l_suppkey AS dst, l_returnflag AS port, count(*) AS times FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def validate_duplicate_edges(spark: SparkSession, d: str) -> DataFrame:
    return graphs.duplicate_edges(table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("port")))


def _kinds(spark: SparkSession, d: str) -> DataFrame:
    """Nations scatter, rich customers gather, regions are conditions."""
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("scatter").alias("kind"))
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.when(F.col("c_acctbal") > 9800, "gather").otherwise("agent").alias("kind"))
    r = table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.lit("condition").alias("kind"))
    return n.unionByName(c).unionByName(r)


@query("SELECT 'n' || n_nationkey AS id FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9800)")
def validate_ungathered(spark: SparkSession, d: str) -> DataFrame:
    return graphs.ungathered(_kinds(spark, d), tree(spark, d)).select("id")


@query("SELECT 'c' || c_custkey AS node, 'r' || n_regionkey AS above, CAST(2 AS BIGINT) AS depth FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal < 500")
def upstream_condition(spark: SparkSession, d: str) -> DataFrame:
    start = table(spark, d, "customer").where("c_acctbal < 500").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))
    return graphs.upstream(tree(spark, d), _kinds(spark, d), start, "condition")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT n_nationkey AS s, (n_nationkey * 3) % 25 AS t FROM nation), r AS (SELECT s, t FROM e UNION SELECT r.s, e.t FROM r JOIN e ON e.s = r.t)
SELECT s AS node FROM r a WHERE s = t AND NOT EXISTS (SELECT 1 FROM r x JOIN r y ON x.s = y.t AND x.t = y.s WHERE x.s = a.s AND x.t IN (1, 5))""")
def validate_unbounded_cycles(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    nodes = n.select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey").isin(1, 5), "loop").otherwise("agent").alias("kind"))
    return graphs.unbounded_cycles(nodes, n.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 3) % 25).alias("dst")))


@query("SELECT p_partkey AS tool FROM part WHERE p_brand NOT IN (SELECT 'Brand#' || s_nationkey FROM supplier)")
def host_facts_anti(spark: SparkSession, d: str) -> DataFrame:
    """Tools that no host offers."""
    offered = table(spark, d, "supplier").select(F.concat(F.lit("Brand#"), F.col("s_nationkey").cast("string")).alias("p_brand")).distinct()
    return table(spark, d, "part").select(F.col("p_partkey").alias("tool"), "p_brand").join(offered, "p_brand", "left_anti").select("tool")
