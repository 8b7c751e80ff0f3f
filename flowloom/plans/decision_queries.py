"""Ledger rankings, evaluations and decisions on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowloom.operators import ledger
from flowloom.plans.registry import query
from flowloom.sources.tables import table

L = "long"

# a part is a lesson, or a member of its brand's family: applied and helped count its lines
_SCORES = """WITH s AS (SELECT l_partkey, count(*) AS applied, count(*) FILTER (WHERE l_returnflag = 'R' AND l_quantity > 40) AS helped FROM lineitem WHERE l_quantity > 35 GROUP BY l_partkey),
m AS (SELECT p_partkey AS id, p_brand AS family, CASE WHEN p_size % 10 = 0 THEN 'constraint' ELSE lower(p_type) END AS kind, p_size, p_retailprice, coalesce(applied, 0) AS applied, coalesce(helped, 0) AS helped,
CASE WHEN coalesce(applied, 0) = 0 THEN 0.0 ELSE helped / applied END AS rate FROM part LEFT JOIN s ON l_partkey = p_partkey)
"""


def members(spark: SparkSession, d: str) -> DataFrame:
    uses = table(spark, d, "lineitem").where("l_quantity > 35")
    scores = ledger.workflow_scores(uses, ["l_partkey"], (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("family"), F.when(F.col("p_size") % 10 == 0, "constraint").otherwise(F.lower("p_type")).alias("kind"), "p_size", "p_retailprice")
    joined = p.join(scores, p.id == scores.l_partkey, "left").drop("l_partkey")
    return joined.fillna(0, ["applied", "helped"])


@query("""SELECT l_suppkey AS scope, l_partkey % 10 AS workflow, count(*) AS applied, count(*) FILTER (WHERE l_returnflag = 'R') AS helped FROM lineitem GROUP BY l_suppkey, l_partkey % 10""")
def workflow_scores(spark: SparkSession, d: str) -> DataFrame:
    uses = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("scope"), (F.col("l_partkey") % 10).alias("workflow"), "l_returnflag")
    return ledger.workflow_scores(uses, ["scope", "workflow"], F.col("l_returnflag") == "R")


@query(_SCORES + "SELECT id, round(rate, 6) AS rate FROM m")
def help_rate(spark: SparkSession, d: str) -> DataFrame:
    return members(spark, d).select("id", F.round(ledger.help_rate(), 6).alias("rate"))


@query(_SCORES + """, r AS (SELECT *, row_number() OVER (PARTITION BY family, kind = 'constraint' ORDER BY CASE WHEN applied = 0 THEN 1 WHEN helped > 0 THEN 0 ELSE 2 END, rate DESC, id) AS place FROM m)
SELECT family, id, kind FROM r WHERE kind = 'constraint' OR place <= 5""")
def recall_topk(spark: SparkSession, d: str) -> DataFrame:
    return ledger.recalled(members(spark, d), 5, ["family"]).select("family", "id", "kind")


_STANDING = _SCORES + """, b AS (SELECT *, CASE WHEN applied < 3 THEN 1 WHEN helped > 0 THEN 0 ELSE 2 END AS band FROM m),
p AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY band, rate DESC, applied DESC, id) AS place FROM b)
"""


@query(_STANDING + "SELECT family, id FROM p WHERE place = 1")
def champion(spark: SparkSession, d: str) -> DataFrame:
    return ledger.standings(members(spark, d), "family", "id").where("place = 1").select("family", "id")


@query(_STANDING + "SELECT id, CASE WHEN band = 1 THEN 'unproven' WHEN place = 1 THEN 'champion' ELSE 'beaten' END AS standing FROM p")
def standing(spark: SparkSession, d: str) -> DataFrame:
    return ledger.standings(members(spark, d), "family", "id").select("id", "standing")


@query(_STANDING + """SELECT p.id, p.family, p.applied, p.helped, CASE WHEN band = 1 THEN 'unproven' WHEN place = 1 THEN 'champion' ELSE 'beaten' END AS standing, root.id AS parent
FROM p LEFT JOIN (SELECT family, min(id) AS id FROM m GROUP BY family) root ON root.family = p.family AND root.id <> p.id""")
def inventory_shelf(spark: SparkSession, d: str) -> DataFrame:
    ranked = ledger.standings(members(spark, d), "family", "id")
    root = ranked.groupBy("family").agg(F.min("id").alias("parent"))
    return ranked.join(root, "family").select("id", "family", "applied", "helped", "standing", F.nullif("parent", "id").alias("parent"))


@query(_STANDING + """, o AS (SELECT *, p_size % 3 <> 0 AS offer FROM p)
SELECT family, id FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY offer DESC, (place = 1 AND offer) DESC, id) AS pick FROM o) WHERE pick = 1 AND offer""")
def family_collapse(spark: SparkSession, d: str) -> DataFrame:
    return ledger.collapsed_families(members(spark, d), "family", "id", F.col("p_size") % 3 != 0).select("family", "id")


@query("""SELECT o_orderkey AS id, o_custkey, round(o_totalprice, 2) AS total FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100""")
def episodes_page(spark: SparkSession, d: str) -> DataFrame:
    """The filter comes before the page."""
    o = table(spark, d, "orders").where("o_orderstatus = 'O'").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(100).limit(50)
    return o.select(F.col("o_orderkey").alias("id"), "o_custkey", F.round("o_totalprice", 2).alias("total"))


@query("""SELECT o_custkey, o_orderkey AS run FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r <= 3""")
def runs_newest(spark: SparkSession, d: str) -> DataFrame:
    return ledger.newest(table(spark, d, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey"), keep=3).select("o_custkey", F.col("o_orderkey").alias("run"))


@query("""SELECT conv_id, turn AS note FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 2""")
def notes_newest(spark: SparkSession, d: str) -> DataFrame:
    return ledger.newest(table(spark, d, "conversations"), ["conv_id"], F.desc("turn"), keep=2).select("conv_id", F.col("turn").alias("note"))


@query("""SELECT conv_id, turn FROM (SELECT *, lead(turn) OVER (PARTITION BY conv_id, role ORDER BY turn) AS superseded_by FROM conversations) WHERE superseded_by IS NULL""")
def current_notes(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").withColumn("superseded_by", F.lead("turn").over(Window.partitionBy("conv_id", "role").orderBy("turn")))
    return c.where(F.col("superseded_by").isNull()).select("conv_id", "turn")


@query("SELECT p_partkey AS id, CASE WHEN p_brand = 'Brand#1' THEN '' ELSE p_brand END AS scope_key FROM part WHERE p_brand IN ('Brand#7', 'Brand#1')")
def scope_visible(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_brand") == "Brand#1", "").otherwise(F.col("p_brand")).alias("scope_key"))
    return ledger.visible(rows, "Brand#7")


@query("""SELECT id, arg_max(name, layer) AS name, CAST(max(layer) AS BIGINT) AS layer FROM (SELECT s_suppkey AS id, s_name AS name, 0 AS layer FROM supplier UNION ALL SELECT c_custkey, c_name, 1 FROM customer WHERE c_custkey % 3 = 0) GROUP BY id""")
def layered_override(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit(0).cast(L).alias("layer"))
    over = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(1).cast(L).alias("layer"))
    return ledger.layered_override(base.unionByName(over), "id", "layer")


@query("SELECT p_partkey AS id, CAST(least(CASE WHEN p_size % 2 = 0 THEN p_size END, CASE WHEN p_size % 3 = 0 THEN p_size // 3 END) AS BIGINT) AS limit_ FROM part")
def limits_narrow(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size").cast(L)
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(s % 2 == 0, s).alias("a"), F.when(s % 3 == 0, F.floor(s / 3).cast(L)).alias("b"))
    return ledger.narrowed(p, "a", "b", "limit_").select("id", "limit_")


@query("SELECT user_id, event_type AS signature, min(event_id) AS seq FROM events GROUP BY user_id, event_type")
def signatures_first_seen(spark: SparkSession, d: str) -> DataFrame:
    from flowloom.operators.state import first_seen

    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("signature"), F.col("event_id").alias("seq"))
    return first_seen(e, ["user_id"], "signature")


# orders are episodes of two arms by the parity of o_custkey, each arm's in the order of o_orderkey
_EPISODES = """WITH e AS (SELECT CASE WHEN o_custkey % 2 = 0 THEN 'on' ELSE 'off' END AS arm, o_orderpriority AS family, o_orderkey % 12 + 1 AS attempts, o_orderstatus <> 'P' AS satisfied,
CASE WHEN o_custkey % 5 = 0 THEN false WHEN o_custkey % 5 = 1 THEN true END AS verified, o_totalprice AS cost, o_custkey % 3 = 0 AS used,
row_number() OVER (PARTITION BY o_custkey % 2 ORDER BY o_orderkey) - 1 AS pos FROM orders), s AS (SELECT *, satisfied AND coalesce(verified, true) AS solved FROM e)
"""


def episodes(spark: SparkSession, d: str) -> DataFrame:
    from flowloom.operators.items import positions

    o = table(spark, d, "orders")
    e = o.select(
        F.when(F.col("o_custkey") % 2 == 0, "on").otherwise("off").alias("arm"), F.col("o_orderpriority").alias("family"), (F.col("o_orderkey") % 12 + 1).alias("attempts"),
        (F.col("o_orderstatus") != "P").alias("satisfied"), F.when(F.col("o_custkey") % 5 == 0, False).when(F.col("o_custkey") % 5 == 1, True).alias("verified"),
        F.col("o_totalprice").alias("cost_usd"), (F.col("o_custkey") % 3 == 0).alias("used_workflow"), "o_orderkey",
    )
    placed = positions(e, "arm", "o_orderkey", into="pos")
    start = placed.groupBy("arm").agg(F.min("pos").alias("_start"))
    return placed.join(F.broadcast(start), "arm").withColumn("pos", F.col("pos") - F.col("_start")).drop("_start")


@query(_EPISODES + "SELECT arm, family, count(*) AS episodes, count(*) FILTER (WHERE solved) AS solved FROM s GROUP BY arm, family")
def eval_solved(spark: SparkSession, d: str) -> DataFrame:
    e = episodes(spark, d).withColumn("solved", ledger.outcome(F.col("satisfied"), F.col("verified")) == "solved")
    return e.groupBy("arm", "family").agg(F.count(F.lit(1)).alias("episodes"), F.count_if("solved").alias("solved"))


@query(_EPISODES + """SELECT a.arm, o.outcome, count(s.arm) AS n FROM (SELECT DISTINCT arm FROM s) a CROSS JOIN (VALUES ('solved'), ('refused'), ('wrong'), ('failed')) o(outcome)
LEFT JOIN (SELECT arm, CASE WHEN satisfied AND verified = false THEN 'wrong' WHEN satisfied THEN 'solved' WHEN verified THEN 'refused' ELSE 'failed' END AS outcome FROM s) s ON s.arm = a.arm AND s.outcome = o.outcome GROUP BY a.arm, o.outcome""")
def eval_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes without episodes count 0."""
    e = episodes(spark, d).withColumn("outcome", ledger.outcome(F.col("satisfied"), F.col("verified")))
    names = ["solved", "refused", "wrong", "failed"]
    wide = e.groupBy("arm").agg(*[F.count_if(F.col("outcome") == n).alias(n) for n in names])
    return wide.unpivot("arm", names, "outcome", "n")


def _arms(spark: SparkSession, d: str) -> DataFrame:
    return ledger.evaluated(episodes(spark, d))


@query(_EPISODES + "SELECT arm, round(avg(attempts) FILTER (WHERE solved), 6) AS mean_attempts FROM s GROUP BY arm")
def eval_mean_attempts(spark: SparkSession, d: str) -> DataFrame:
    return _arms(spark, d).select("arm", F.round("mean_attempts", 6).alias("mean_attempts"))


@query(_EPISODES + "SELECT arm, round(sum(cost) / count(*) FILTER (WHERE solved), 3) AS cost_per_solve FROM s GROUP BY arm")
def eval_cost_per_solve(spark: SparkSession, d: str) -> DataFrame:
    return _arms(spark, d).select("arm", F.round("cost_per_solve", 3).alias("cost_per_solve"))


@query(_EPISODES + "SELECT arm, round(avg(used::INT), 6) AS hit_rate FROM s GROUP BY arm")
def eval_hit_rate(spark: SparkSession, d: str) -> DataFrame:
    return _arms(spark, d).select("arm", F.round("hit_rate", 6).alias("hit_rate"))


@query(_EPISODES + "SELECT arm, round(regr_slope(attempts, pos) FILTER (WHERE solved), 7) AS trend FROM s GROUP BY arm")
def eval_trend(spark: SparkSession, d: str) -> DataFrame:
    return _arms(spark, d).select("arm", F.round("trend", 7).alias("trend"))


@query(_EPISODES + """, a AS (SELECT arm, count(*) FILTER (WHERE solved) AS solved, avg(attempts) FILTER (WHERE solved) AS mean, regr_slope(attempts, pos) FILTER (WHERE solved) AS trend FROM s GROUP BY arm)
SELECT CASE WHEN x.solved > y.solved AND coalesce(x.mean <= y.mean, true) THEN 'solved_more' WHEN x.trend < y.trend AND coalesce(x.mean <= y.mean, true) THEN 'converged' ELSE 'no_evidence' END AS verdict
FROM a x, a y WHERE x.arm = 'on' AND y.arm = 'off'""")
def eval_verdict(spark: SparkSession, d: str) -> DataFrame:
    return ledger.verdict(_arms(spark, d), "on", "off").select("verdict")


@query("SELECT user_id AS episode, round(sum(value), 2) AS cost, bool_or(event_type = 'purchase') AS satisfied, count(*) AS attempts FROM events GROUP BY user_id")
def episode_rollup(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("episode"))
    return e.agg(F.round(F.sum("value"), 2).alias("cost"), F.bool_or(F.col("event_type") == "purchase").alias("satisfied"), F.count(F.lit(1)).alias("attempts"))


@query("""SELECT event_id, 'row_' || lpad(CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) + user_id AS VARCHAR), 8, '0') AS id FROM events""")
def sequence_ids(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id")
    return ledger.numbered(e, F.col("user_id"), "row", "event_id", scope=["user_id"]).select("event_id", "id")


# an episode is a user's events: attempt = place, satisfied = purchase, advanced = sign-up or a value over 250
_ATTEMPTS = """WITH a AS (SELECT user_id AS episode, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt, event_type = 'purchase' AS satisfied,
event_type = 'signup' OR value > 250 AS advanced, CASE WHEN event_type = 'error' AND value > 300 THEN 'impossible' ELSE 'none' END AS blocker FROM events),
i AS (SELECT *, sum((satisfied OR advanced)::INT) OVER (PARTITION BY episode ORDER BY seq) AS island FROM a),
t AS (SELECT *, CAST(sum((NOT (satisfied OR advanced))::INT) OVER (PARTITION BY episode, island ORDER BY seq) AS BIGINT) AS stalled FROM i),
r AS (SELECT *, CASE WHEN satisfied OR blocker <> 'none' OR attempt >= 12 THEN false WHEN attempt < 3 THEN true ELSE stalled < 2 END AS retry FROM t)
"""


def attempts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast(L)
    blocker = F.when((F.col("event_type") == "error") & (F.col("value") > 300), "impossible").otherwise("none")
    e = e.select(F.col("user_id").alias("episode"), F.col("event_id").alias("seq"), place.alias("attempt"), (F.col("event_type") == "purchase").alias("satisfied"), ((F.col("event_type") == "signup") | (F.col("value") > 250)).alias("advanced"), blocker.alias("blocker"))
    return ledger.stalled_streaks(e, "episode", "seq", F.col("satisfied") | F.col("advanced"))


@query(_ATTEMPTS + "SELECT episode, seq, stalled FROM t")
def stalled_streak(spark: SparkSession, d: str) -> DataFrame:
    return attempts(spark, d).select("episode", "seq", "stalled")


@query(_ATTEMPTS + "SELECT seq, retry FROM r")
def retry_rule(spark: SparkSession, d: str) -> DataFrame:
    rule = ledger.should_retry(F.col("satisfied"), F.col("blocker") == "none", F.col("attempt"), F.col("stalled"))
    return attempts(spark, d).select("seq", rule.alias("retry"))


@query(_ATTEMPTS + """SELECT seq, CASE WHEN satisfied THEN 'done' WHEN retry THEN 'retry' WHEN blocker <> 'none' THEN 'stand down: ' || blocker
WHEN attempt >= 12 THEN 'stand down: out of attempts after ' || attempt ELSE 'stand down: ' || stalled || ' attempts in a row made no progress' END AS next FROM r""")
def decide_next(spark: SparkSession, d: str) -> DataFrame:
    found = ledger.next_step(F.col("satisfied"), F.col("blocker") == "none", F.col("blocker"), F.col("attempt"), F.col("stalled"))
    return attempts(spark, d).select("seq", found.alias("next"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'selected:' || o_custkey WHEN o_orderstatus = 'O' THEN 'authored:' || left(md5(o_orderpriority), 8) ELSE 'errand' END AS signature FROM orders""")
def approach_sig(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    selected = F.when(F.col("o_orderstatus") == "F", F.col("o_custkey").cast("string"))
    authored = F.when(F.col("o_orderstatus") == "O", F.substring(F.md5(F.col("o_orderpriority").cast("binary")), 1, 8))
    return o.select(F.col("o_orderkey").alias("id"), ledger.approach_signature(selected, authored).alias("signature"))


@query("""SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def candidates_untried(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") > 0).alias("enabled"))
    tried = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("selected:"), F.col("o_custkey").cast("string")).alias("signature"))
    return ledger.untried(c, tried, "id", "signature").select("id")


@query("SELECT c_custkey AS id, c_mktsegment AS name FROM customer WHERE c_acctbal > 0")
def callables_enabled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"))


@query("""SELECT l_suppkey AS workflow, count(*) AS applied, count(*) FILTER (WHERE l_linestatus = 'O' AND o_orderstatus = 'F') AS helped
FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_suppkey""")
def subflow_credit(spark: SparkSession, d: str) -> DataFrame:
    """A step helped if it went well and its episode was satisfied."""
    steps = table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("workflow"), "l_linestatus")
    joined = steps.join(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"))
    return ledger.workflow_scores(joined, ["workflow"], (F.col("l_linestatus") == "O") & (F.col("o_orderstatus") == "F"))


@query("SELECT user_id AS run, bool_or(value < 3 OR event_type = 'error' AND value > 300) AS suspect FROM events GROUP BY user_id")
def graph_suspect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("user_id").alias("run")).agg(F.bool_or((F.col("value") < 3) | (F.col("event_type") == "error") & (F.col("value") > 300)).alias("suspect"))


@query(_SCORES + "SELECT family, string_agg('- #' || id || ' (' || helped || '/' || applied || ')', chr(10) ORDER BY id) AS lines FROM m WHERE applied > 0 GROUP BY family")
def lesson_lines(spark: SparkSession, d: str) -> DataFrame:
    m = members(spark, d).where("applied > 0").withColumn("line", F.format_string("- #%d (%d/%d)", "id", "helped", "applied"))
    return m.groupBy("family").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda x: x["line"]), "\n").alias("lines"))
