"""Gates, repairs, loops with state, rules of definitions and more expression functions on the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from flowloom.functions import expr as X
from flowloom.functions import text as T
from flowloom.functions import values as V
from flowloom.operators import checks, fanout, graphs, items, journal, ledger, state
from flowloom.plans.flow_queries import events, order_lines, orders
from flowloom.plans.more_queries import _LINES
from flowloom.plans.registry import query
from flowloom.plans.state_queries import tree
from flowloom.sources.staging import shared_folder
from flowloom.sources.tables import agent_turn, append_journal, call_each, json_documents, read_journal, table

L = "long"


@query("""SELECT event_id AS ord, CASE WHEN event_type = 'purchase' THEN 'click' ELSE event_type END AS event_type, event_type = 'purchase' AS fixed, event_type IN ('view', 'click', 'purchase') AS valid FROM events""")
def parser_auto_fix(spark: SparkSession, d: str) -> DataFrame:
    """One try to repair what breaches the schema; other kinds than those that the repair knows stay in breach."""
    schema = {"properties": {"event_type": {"enum": ["view", "click"]}}}
    fix = lambda bad: bad.withColumn("event_type", F.when(F.col("event_type") == "purchase", "click").otherwise(F.col("event_type")))
    return items.auto_fixed(events(spark, d).select("ord", "event_type"), schema, ["event_type"], fix).select("ord", "event_type", "fixed", "valid")


@query("""WITH RECURSIVE l AS (SELECT o_orderkey AS ord, o_orderkey % 50 AS x, CAST(0 AS BIGINT) AS seen, CAST(0 AS BIGINT) AS i FROM orders UNION ALL
SELECT ord, x + 7, seen + x + 7, i + 1 FROM l WHERE NOT (x + seen >= 100) AND x % 9 <> 0 AND i < 6)
SELECT ord, x, seen, i AS iteration, CASE WHEN x + seen >= 100 THEN 'until' WHEN x % 9 = 0 THEN 'condition' ELSE 'max_iterations' END AS exit_reason
FROM l WHERE x + seen >= 100 OR x % 9 = 0 OR i = 6""")
def loop_condition_fold(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d).select("ord", (F.col("o_orderkey") % 50).alias("x"), F.lit(0).cast(L).alias("seen"))
    return fanout.loop(o, lambda s: s.withColumn("x", F.col("x") + 7), F.col("x") + F.col("seen") >= 100, most=6, condition=F.col("x") % 9 != 0, fold={"seen": F.col("seen") + F.col("x")})


@query(_LINES + """, f AS (SELECT unnest(lines) AS v, CAST(generate_subscripts(lines, 1) - 1 AS BIGINT) AS ord, len(lines) AS n FROM (SELECT lines FROM o ORDER BY ord LIMIT 1))
SELECT ord, v.p AS part, ord // greatest(ceil(n / 3.0)::BIGINT, 1) AS lane FROM f""")
def scatter_first_path(spark: SparkSession, d: str) -> DataFrame:
    """Lanes over the lines of the first order."""
    o = order_lines(spark, d).select("ord", F.struct("lines").alias("order"))
    return fanout.scatter_path(o, "order", "lines", 3).select("ord", F.col("value.l_partkey").alias("part"), "lane")


@query("""WITH t AS (SELECT o_orderkey AS ord, o_custkey AS batch, o_orderstatus = 'F' AS done, o_totalprice > 400000 AS late FROM orders),
g AS (SELECT batch, count(*) FILTER (WHERE done) AS arrived, count(*) AS expected, bool_or(late) AS spent FROM t GROUP BY batch),
p AS (SELECT *, CASE WHEN arrived >= least(3, expected) THEN 'emit' WHEN NOT spent THEN 'wait' ELSE 'timeout' END AS port FROM g)
SELECT 'ticket-' || ord AS ticket, t.batch, arrived, expected, port, done FROM t JOIN p USING (batch) WHERE port <> 'emit' OR done""")
def gate_release(spark: SparkSession, d: str) -> DataFrame:
    """Tickets of a customer's orders; finished ones have a result; three results, or all, release the batch."""
    o = orders(spark, d).select("ord", F.col("o_custkey").alias("batch"), "o_orderstatus", (F.col("o_totalprice") > 400000).alias("late"))
    tickets = fanout.spawn(o)
    results = tickets.where("o_orderstatus = 'F'").select("ticket")
    return fanout.released(tickets.drop("o_orderstatus"), results, "ticket", ["batch"], "quorum", F.col("late"), 3).select("ticket", "batch", "arrived", "expected", "port", "done")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'error' ELSE 'failed' END WHEN c_mktsegment = 'BUILDING' THEN 'main' ELSE 'paused' END AS port FROM customer""")
def approval_gates(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment")
    return fanout.approval_gate(c.select("id"), c.where("c_mktsegment = 'BUILDING'"), c.where("id % 7 = 0"), c.where("id % 2 = 0"))


@query("""SELECT o_orderkey AS request_id, o_orderstatus = 'F' AS approved, CASE WHEN o_orderkey % 5 = 0 THEN 'edited ' || o_orderpriority ELSE o_orderpriority END AS subject, 'order' AS subject_kind,
o_orderkey % 5 = 0 AS edited, 'c' || o_custkey AS decided_by, CAST(NULL AS VARCHAR) AS comment, o_custkey AS input FROM orders WHERE o_orderstatus <> 'P'""")
def decided_items(spark: SparkSession, d: str) -> DataFrame:
    """The reviewer's edit wins over what was sent."""
    o = table(spark, d, "orders")
    requests = o.select(F.col("o_orderkey").alias("request_id"), F.col("o_orderpriority").alias("subject"), F.lit("order").alias("subject_kind"), F.col("o_custkey").alias("input"))
    payload = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("edited "), "o_orderpriority"))
    decisions = o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("request_id"), (F.col("o_orderstatus") == "F").alias("approved"), payload.alias("payload"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("decided_by"), F.lit(None).cast("string").alias("comment"))
    return fanout.decided_item(requests, decisions)


@query("""WITH l AS (SELECT user_id AS thread, max(event_id) AS id FROM events GROUP BY user_id)
SELECT thread, 'step-' || event_type AS failed_node, CASE WHEN value > 50 THEN 'too large' ELSE '' END AS error, id AS checkpoint_id, CAST(json_extract(props, '$.k') AS BIGINT) AS step, event_type || ',end' AS pending
FROM l JOIN events ON event_id = id WHERE event_type <> 'view'""")
def failure_boundaries(spark: SparkSession, d: str) -> DataFrame:
    failed = F.when(F.col("event_type") != "view", F.concat(F.lit("step-"), "event_type"))
    meta = F.to_json(F.struct(failed.alias("failed_node"), F.when(F.col("value") > 50, "too large").alias("error"), F.get_json_object("props", "$.k").cast(L).alias("step")))
    c = table(spark, d, "events").select(F.col("user_id").alias("thread"), F.col("event_id").alias("checkpoint_id"), F.col("event_id").alias("seq"), meta.alias("metadata"), F.array("event_type", F.lit("end")).alias("next_nodes"))
    return state.failure_boundary(c, "thread").withColumn("pending", X.joined(F.col("pending"), ","))


_CONFIG = {
    "agent": "CASE n % 3 WHEN 0 THEN '{\"execution\": \"per_item\", \"concurrency\": 4, \"prompt\": \"=summarise the news\"}' WHEN 1 THEN '{\"concurrency\": 2, \"prompt\": \"=.items | length\"}' ELSE '{\"execution\": \"twice\"}' END",
    "transform": "CASE n % 2 WHEN 0 THEN '{\"execution\": \"once\", \"x\": \"=nodes.a.item.name\"}' ELSE '{\"x\": [\"=nodes.a.item.json.name\", {\"y\": \"=item.z\"}]}' END",
    "tool_call": "CASE n % 3 WHEN 0 THEN '{\"concurrency\": \"all\", \"on_item_error\": \"skip\"}' WHEN 1 THEN '{\"concurrency\": -1}' ELSE '{\"on_item_error\": \"ignore\"}' END",
    "memory": "CASE n % 4 WHEN 0 THEN '{\"operation\": \"remember\", \"scope\": \"user\", \"key\": \"k\"}' WHEN 1 THEN '{\"operation\": \"recall\"}' WHEN 2 THEN '{\"operation\": \"dance\"}' ELSE '{}' END",
    "dedup": "CASE n % 2 WHEN 0 THEN '{\"key\": \"=item.id\"}' ELSE '{\"key\": \"\"}' END",
    "approval": "CASE n % 3 WHEN 0 THEN '{\"wait_mode\": \"poll\", \"assignees\": [\"a\"]}' WHEN 1 THEN '{\"on_reject\": \"shrug\", \"assignees\": []}' ELSE '{\"on_timeout\": 5, \"assignees\": [1]}' END",
    "code": "CASE n % 2 WHEN 0 THEN '{\"language\": \"python\"}' ELSE '{\"language\": \"bash\"}' END",
}
_NODES = "SELECT id, kind, CASE kind " + " ".join(f"WHEN '{k}' THEN {c}" for k, c in _CONFIG.items()) + " END AS config FROM (SELECT c_custkey AS id, c_custkey // 7 AS n, CASE c_custkey % 7 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_CONFIG)) + " END AS kind FROM customer)"


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    kind = F.element_at(F.array(*map(F.lit, _CONFIG)), (F.col("id") % len(_CONFIG) + 1).cast("int"))
    made = c.select(F.col("c_custkey").alias("id")).withColumn("kind", kind).withColumn("n", F.floor(F.col("id") / 7))
    config = F.expr("CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _CONFIG.items()) + " END")
    return made.select("id", "kind", config.alias("config"))


@query(f"""WITH n AS (SELECT *, id // 7 AS n FROM ({_NODES}))
SELECT id, unnest(CASE kind WHEN 'agent' THEN CASE n % 3 WHEN 0 THEN [] WHEN 1 THEN ['concurrency_without_per_item'] ELSE ['execution_unknown'] END
WHEN 'transform' THEN CASE n % 2 WHEN 0 THEN ['execution_unsupported'] ELSE [] END
WHEN 'tool_call' THEN CASE n % 3 WHEN 0 THEN [] WHEN 1 THEN ['concurrency_value'] ELSE ['on_item_error_value'] END
WHEN 'memory' THEN CASE n % 4 WHEN 0 THEN ['memory_scope_read_only', 'memory_value_missing'] WHEN 1 THEN ['memory_scope_missing', 'memory_query_missing'] WHEN 2 THEN ['memory_operation_unknown'] ELSE ['memory_operation_missing'] END
WHEN 'dedup' THEN CASE n % 2 WHEN 0 THEN [] ELSE ['dedup_key_missing'] END
WHEN 'approval' THEN CASE n % 3 WHEN 0 THEN [] WHEN 1 THEN ['approval_on_reject_value', 'approval_assignees'] ELSE ['approval_on_timeout_value', 'approval_assignees'] END
ELSE CASE n % 2 WHEN 0 THEN [] ELSE ['code_language_unknown'] END END) AS rule FROM n""")
def validate_node_rules(spark: SparkSession, d: str) -> DataFrame:
    return checks.node_rule_errors(_nodes(spark, d))


@query(f"SELECT id, 'prompt' AS key FROM ({_NODES}) WHERE kind = 'agent' AND config LIKE '%summarise the%'")
def validate_prompts(spark: SparkSession, d: str) -> DataFrame:
    return checks.prompt_errors(_nodes(spark, d))


@query(f"SELECT id, 'x' AS location, 'a' AS node_id FROM ({_NODES}) WHERE config LIKE '%a.item.name%'")
def validate_bindings(spark: SparkSession, d: str) -> DataFrame:
    named = _nodes(spark, d).withColumn("id", F.col("id").cast("string"))
    a = spark.createDataFrame([("a", "agent", "{}")], named.schema)
    return checks.binding_errors(named.unionByName(a)).withColumn("id", F.col("id").cast(L))


@query(f"""WITH n AS ({_NODES}) SELECT id AS node, 'x' AS location, '=nodes.a.item.name' AS expression FROM n WHERE config LIKE '%a.item.name%'
UNION ALL SELECT id, 'x.0', '=nodes.a.item.json.name' FROM n WHERE config LIKE '%item.json%' UNION ALL SELECT id, 'x.1.y', '=item.z' FROM n WHERE config LIKE '%item.json%'
UNION ALL SELECT id, 'key', '=item.id' FROM n WHERE kind = 'dedup' AND config LIKE '%item.id%' UNION ALL SELECT id, 'prompt', json_extract_string(config, '$.prompt') FROM n WHERE kind = 'agent' AND config LIKE '%prompt%'""")
def config_expressions(spark: SparkSession, d: str) -> DataFrame:
    return T.expressions(_nodes(spark, d))


@query("""SELECT 'c' || c_custkey AS id, CASE WHEN c_acctbal > 9000 THEN 'void_has_outgoing' ELSE 'void_has_no_incoming' END AS rule FROM customer WHERE c_acctbal > 9000 OR c_acctbal < 1000 AND c_nationkey < 5""")
def validate_voids(spark: SparkSession, d: str) -> DataFrame:
    """Rich customers' sinks have an edge on; poor ones of the first nations lack the edge in."""
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), "c_acctbal", "c_nationkey")
    edges = tree(spark, d).join(c.where("c_acctbal < 1000 and c_nationkey < 5").select(F.col("id").alias("dst")), "dst", "left_anti")
    more = c.where("c_acctbal > 9000").select(F.col("id").alias("src"), F.lit("r0").alias("dst"))
    return checks.void_errors(c.select("id", F.lit("void").alias("kind")), edges.select("src", "dst").unionByName(more))


@query("""WITH a AS (SELECT CASE WHEN s_suppkey % 11 = 0 THEN '' ELSE 'a' || (s_suppkey // 2) END AS agent, s_suppkey % 6 AS steps FROM supplier),
g AS (SELECT 'a' || (p_partkey % 40) AS agent, CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN '=item.tool' WHEN 2 THEN 'git*' WHEN 3 THEN 'git.*' WHEN 4 THEN '*' ELSE 'mail.send' END AS slug, CASE WHEN p_partkey % 10 = 5 THEN '=item.c' END AS ref FROM part)
SELECT agent, 'id_empty' AS rule FROM a WHERE agent = '' UNION ALL SELECT agent, 'limit_max_steps' FROM a WHERE steps = 0 UNION ALL SELECT agent, 'id_duplicate' FROM a WHERE agent <> '' GROUP BY agent HAVING count(*) > 1
UNION ALL SELECT agent, CASE WHEN slug = '' THEN 'grant_empty' WHEN slug[1] = '=' THEN 'grant_expression' WHEN slug IN ('git*', '*') THEN 'grant_pattern' ELSE 'connection_expression' END FROM g WHERE slug IN ('', '=item.tool', 'git*', '*') OR ref IS NOT NULL""")
def validate_agents(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    name = F.when(F.col("s_suppkey") % 11 == 0, "").otherwise(F.concat(F.lit("a"), F.floor(F.col("s_suppkey") / 2).cast("string")))
    slug = F.element_at(F.array(*map(F.lit, ["", "=item.tool", "git*", "git.*", "*", "mail.send"])), (F.col("p_partkey") % 6 + 1).cast("int"))
    grants = table(spark, d, "part").select(F.concat(F.lit("a"), (F.col("p_partkey") % 40).cast("string")).alias("agent"), slug.alias("slug"), F.when(F.col("p_partkey") % 10 == 5, "=item.c").alias("connection_ref"))
    return checks.agent_errors(s.select(name.alias("agent"), (F.col("s_suppkey") % 6).alias("max_steps")), grants)


@query("""WITH g AS (SELECT DISTINCT s_nationkey AS agent, CASE WHEN s_suppkey % 2 = 0 THEN 'b' || (s_suppkey % 5) || '.*' ELSE 'b' || (s_suppkey % 5) || '.x' END AS slug FROM supplier),
n AS (SELECT DISTINCT p_partkey % 25 AS agent, 'b' || (p_partkey % 7) || CASE WHEN p_partkey % 3 = 0 THEN '.x' ELSE '.y' END AS slug FROM part WHERE p_partkey % 25 < 20)
SELECT agent, slug FROM n WHERE EXISTS (SELECT 1 FROM g WHERE g.agent = n.agent AND (g.slug = n.slug OR g.slug LIKE '%.*' AND starts_with(n.slug, left(g.slug, length(g.slug) - 1))))
UNION ALL SELECT agent, slug FROM g WHERE agent NOT IN (SELECT agent FROM n)""")
def agent_narrowing(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_nationkey").cast(L).alias("agent"), F.concat(F.lit("b"), (F.col("s_suppkey") % 5).cast("string"), F.when(F.col("s_suppkey") % 2 == 0, ".*").otherwise(".x")).alias("slug"))
    p = table(spark, d, "part").where("p_partkey % 25 < 20").select((F.col("p_partkey") % 25).cast(L).alias("agent"), F.concat(F.lit("b"), (F.col("p_partkey") % 7).cast("string"), F.when(F.col("p_partkey") % 3 == 0, ".x").otherwise(".y")).alias("slug"))
    return checks.narrowed_tools(s, p)


@query("""SELECT p_partkey AS id, p_name || '|a"b' AS literals, p_partkey % 2 = 0 AS pasted, CASE WHEN p_partkey % 3 = 0 THEN 'p' || p_partkey END AS node_id, CASE WHEN p_partkey % 3 = 0 THEN 'x.y' END AS field,
p_name LIKE '% %' AS prose FROM part""")
def text_helpers(spark: SparkSession, d: str) -> DataFrame:
    """Literals of an expression, a value pasted in or read, a binding, and prose."""
    p, name = table(spark, d, "part"), F.col("p_name")
    quoted = F.concat(F.lit('=.x + "'), name, F.lit('" + "a\\"b" + "open'))
    leaf = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('="review '), name, F.lit('"'))).otherwise(F.concat(F.lit("=.run."), name))
    bound = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("=nodes.p"), F.col("p_partkey").cast("string"), F.lit(".item.json.x.y."))).otherwise("=item.x")
    b = T.node_binding(bound)
    return p.select(F.col("p_partkey").alias("id"), X.joined(T.quoted_literals(quoted), "|").alias("literals"), T.pasted(leaf, name).alias("pasted"), b["node_id"].alias("node_id"), b["field_path"].alias("field"), T.reads_as_prose(F.concat(name, F.lit(' | "not this one" | if . then 1 end'))).alias("prose"))


@query(_LINES + """SELECT ord, array_to_string(flatten(list_transform(lines, lambda x: [x.p, x.s])), ',') AS flat, lines[2].p AS second, lines[-1].s AS last, array_to_string(list_transform(lines, lambda x: x.f), '') AS flags, CAST(list_sum(list_transform(lines, lambda x: x.p)) AS BIGINT) AS parts FROM o""")
def expr_flatten_nth_add(spark: SparkSession, d: str) -> DataFrame:
    o, lines = order_lines(spark, d), F.col("lines")
    pairs = F.transform(lines, lambda x: F.array(x["l_partkey"].cast(L), x["l_suppkey"].cast(L)))
    flags = V.total(F.transform(lines, lambda x: x["l_returnflag"]), StringType())
    return o.select(
        "ord", X.joined(X.flattened(pairs), ",").alias("flat"), X.nth(lines, 1)["l_partkey"].alias("second"), X.last_of(lines)["l_suppkey"].alias("last"),
        F.coalesce(flags, F.lit("")).alias("flags"), V.total(F.transform(lines, lambda x: x["l_partkey"]), LongType()).alias("parts"),
    )


@query("""WITH RECURSIVE u AS (SELECT event_id AS ord, 1 + event_id % 90 AS x, 0 AS i FROM events UNION ALL SELECT ord, x * 2, i + 1 FROM u WHERE x < 100 AND i < 5) SELECT ord, max(x) FILTER (WHERE x >= 100) AS x FROM u GROUP BY ord""")
def expr_until(spark: SparkSession, d: str) -> DataFrame:
    """Doubled until 100 is reached, within five steps."""
    return events(spark, d).select("ord", X.until(1 + F.col("ord") % 90, lambda x: x >= 100, lambda x: x * 2, 5).alias("x"))


@query("""SELECT event_id AS ord, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, '{"a":[1,{"b":"' || event_type || '"}],"c":' || event_id || '}' AS text, 'a,a.0,a.1,a.1.b,c' AS paths, event_type LIKE '%i%' AS has_i, true AS has_k FROM events""")
def expr_json_text(spark: SparkSession, d: str) -> DataFrame:
    """tojson, fromjson, paths, inside and in."""
    made = F.to_json(F.struct(F.array(F.lit("1"), F.to_json(F.struct(F.col("event_type").alias("b")))).alias("a")))
    text = F.concat(F.lit('{"a":[1,{"b":"'), "event_type", F.lit('"}],"c":'), F.col("ord").cast("string"), F.lit("}"))
    k = X.to_json_text(F.try_variant_get(X.from_json_text(F.col("props")), "$.k", "variant"))
    keys = F.map_from_arrays(F.array(F.lit("k")), F.array(F.lit(1)))
    e = events(spark, d).withColumn("_made", made)
    return e.select("ord", k.alias("k"), X.to_json_text(X.from_json_text(text)).alias("text"), X.joined(X.value_paths(text), ",").alias("paths"), X.inside(F.lit("i"), F.col("event_type")).alias("has_i"), X.within(F.lit("k"), keys).alias("has_k"))


@query("""SELECT event_id AS ord, CASE WHEN event_id % 9 = 0 THEN 'no ' || event_type END AS error, CASE WHEN event_id % 9 <> 0 THEN '{"got": "' || event_type || '"}' END AS response FROM events""")
def capability_call(spark: SparkSession, d: str) -> DataFrame:
    """A call for each row, in the tasks; its errors are collected."""

    def answer(row: dict) -> str:
        if row["ord"] % 9 == 0:
            raise ValueError(f"no {row['event_type']}")
        return f'{{"got": "{row["event_type"]}"}}'

    return call_each(events(spark, d).select("ord", "event_type"), answer).select("ord", "response", "error")


@query("""SELECT event_id AS ord, CASE WHEN event_id % 4 = 0 THEN '{"sum": ' || (user_id + 1) || '}' ELSE '{"kind": "' || event_type || '"}' END AS response FROM events""")
def agent_hop(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth row's runner asks for a tool and answers with its result."""

    def runner(row: dict) -> str:
        if "tool_result" in row:
            return f'{{"sum": {row["tool_result"]}}}'
        return f'{{"tool_call": {{"n": {row["user_id"]}}}}}' if row["ord"] % 4 == 0 else f'{{"kind": "{row["event_type"]}"}}'

    return agent_turn(events(spark, d).select("ord", "event_type", "user_id"), runner, lambda asked: asked["n"] + 1).select("ord", "response")


@query("SELECT event_id AS \"offset\", event_type FROM events WHERE user_id = 7 AND event_id >= 100")
def journal_read_from(spark: SparkSession, d: str) -> DataFrame:
    """Observations appended to a journal by run, one run's read from an offset."""
    at = f"{shared_folder(spark)}/flowloom/journal-{uuid.uuid4().hex}"
    e = table(spark, d, "events").where("user_id < 20").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("run_id"), F.col("event_id").alias("offset"), "event_type")
    append_journal(e.where("offset % 2 = 0").repartition("run_id"), at)
    append_journal(e.where("offset % 2 = 1").repartition("run_id"), at)
    return read_journal(spark, at, "u7", 100).select("offset", "event_type")


def _threads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("thread_id"), F.col("o_orderkey").alias("id"), F.lit(None).cast(L).alias("parent"), F.round("o_totalprice", 2).alias("total"))


@query("""WITH c AS (SELECT CAST(o_custkey AS VARCHAR) AS thread_id, o_orderkey AS id, CAST(NULL AS BIGINT) AS parent, round(o_totalprice, 2) AS total FROM orders)
SELECT thread_id, id, parent, total FROM c UNION ALL SELECT 'copy', id, parent, total FROM c WHERE thread_id = '1' UNION ALL SELECT thread_id, -1, id, 0.5 FROM c WHERE id = (SELECT min(id) FROM c)""")
def thread_copy_and_fork(spark: SparkSession, d: str) -> DataFrame:
    c = _threads(spark, d)
    first = c.agg(F.min("id")).first()[0]
    both = c.unionByName(state.copied_thread(c, "1", "copy"))
    if first is None:
        return both
    forked = state.forked(c.where(F.col("id") == first), "id", "parent", first, -1, {"total": F.lit(0.5)})
    return both.unionByName(forked.where("id = -1").select(*both.columns))


@query("SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS thread_id FROM orders")
def thread_list(spark: SparkSession, d: str) -> DataFrame:
    return state.threads(_threads(spark, d))


@query("SELECT n_nationkey AS node FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)")
def never_ran_nodes(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("node"))
    return journal.never_ran(n, table(spark, d, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("node")), "node")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT n_nationkey AS s, (n_nationkey * 3) % 25 AS t FROM nation), r AS (SELECT s, t FROM e UNION SELECT r.s, e.t FROM r JOIN e ON e.s = r.t)
SELECT s AS id FROM r WHERE s = t AND s % 4 = 0""")
def validate_merge_cycles(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    nodes = n.select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 4 == 0, "merge").otherwise("agent").alias("kind"))
    return graphs.merges_on_cycles(nodes, n.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 3) % 25).alias("dst"))).select("id")


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS s, n_nationkey + 1 AS t FROM nation UNION ALL SELECT n_nationkey, n_nationkey + 7 FROM nation),
r AS (SELECT s, t FROM e WHERE s % 5 = 0 UNION SELECT r.s, e.t FROM r JOIN e ON e.s = r.t WHERE r.t % 5 <> 3) SELECT s AS src, t AS dst FROM r WHERE t % 5 = 0 AND t < 25""")
def validate_nested_scatters(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast(L).alias("id"))
    nodes = n.withColumn("kind", F.when(F.col("id") % 5 == 0, "scatter").when(F.col("id") % 5 == 3, "gather").otherwise("agent"))
    edges = n.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).unionByName(n.select(F.col("id").alias("src"), (F.col("id") + 7).alias("dst")))
    return graphs.nested_scatters(nodes, edges)


@query("SELECT o_custkey AS batch, CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'F') >= least(2, count(*)) THEN 'emit' WHEN NOT bool_or(o_totalprice > 300000) THEN 'wait' ELSE 'timeout' END AS port FROM orders GROUP BY o_custkey")
def release_first_n(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("batch")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("a"), F.count(F.lit(1)).alias("e"), F.bool_or(F.col("o_totalprice") > 300000).alias("s"))
    return o.select("batch", fanout.release("first_n", F.col("a"), F.col("e"), F.col("s"), 2).alias("port"))


@query("SELECT c_nationkey AS ord, CAST(sum(len(string_split(c_mktsegment, 'I'))) AS BIGINT) AS n FROM customer GROUP BY c_nationkey")
def expr_add_arrays(spark: SparkSession, d: str) -> DataFrame:
    """add on arrays joins them."""
    lists = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("ord")).agg(F.collect_list(X.pieces(F.col("c_mktsegment"), "I")).alias("lists"))
    return lists.select("ord", F.size(V.total(F.col("lists"), ArrayType(StringType()))).cast(L).alias("n"))


@query("SELECT o_orderkey AS ord, o_custkey * 4 + 3 AS x FROM orders WHERE o_orderstatus = 'F'")
def sub_workflow_call(spark: SparkSession, d: str) -> DataFrame:
    """A flow that calls another one twice, with its inputs mapped."""

    def twice(df: DataFrame, depth: int) -> DataFrame:
        once = fanout.sub_flow(df, flows, "step", {"n": F.col("start")}, depth)
        return fanout.sub_flow(once, flows, "step", {"n": F.col("x")}, depth)

    flows = {"step": lambda df, depth: df.select("ord", (F.col("n") * 2 + 1).alias("x")), "twice": twice}
    return fanout.sub_flow(orders(spark, d).where("o_orderstatus = 'F'"), flows, "twice", {"start": F.col("o_custkey")})


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'own ' || c_mktsegment ELSE c_mktsegment END AS segment, CAST(CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS BIGINT) AS layer FROM customer""")
def layered_json_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents of two folders of JSON; a later folder's overrides an earlier one's."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    at = f"{shared_folder(spark)}/flowloom/layers-{uuid.uuid4().hex}"
    c.write.json(f"{at}/base")
    c.where("id % 4 = 0").withColumn("segment", F.concat(F.lit("own "), "segment")).write.json(f"{at}/own")
    both = json_documents(spark, [f"{at}/base", f"{at}/own"], "id long, segment string")
    return ledger.layered_override(both, "id", "layer").select("id", "segment", F.col("layer").cast(L).alias("layer"))
