"""Operators on small inputs: the cases that are easy to get wrong."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType

from flowloom.functions import values as V
from flowloom.operators import fanout, graphs, items, journal, ledger, state
from flowloom.sources import tables
from flowloom.streaming import streams


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.fixture()
def batch(spark):
    return spark.createDataFrame([(0, "a", 1.5), (1, "b", 0.0), (2, None, None)], "ord long, name string, x double")


def test_transform_reads_the_item_as_it_was(batch):
    out = items.transform_set(batch, {"name": F.upper("name"), "was": F.col("name")})
    assert rows(out, "ord", "name", "was", "paired_item") == [(0, "A", "a", 0), (1, "B", "b", 1), (2, None, None, 2)]


@pytest.mark.parametrize("column, kind, expected", [("x", DoubleType(), True), ("name", StringType(), True)])
def test_first_item_decides(batch, column, kind, expected):
    assert items.condition(batch, F.col(column), kind, True).count() == 3 * expected
    assert items.condition(batch, F.col(column), kind, False).count() == 3 * (not expected)


def test_condition_without_items_is_false(batch):
    empty = batch.limit(0)
    assert items.condition(empty, F.col("x"), DoubleType(), True).count() == 0
    assert items.condition(empty, F.col("x"), DoubleType(), False).count() == 0


def test_truthiness(spark):
    v = spark.sql("SELECT parse_json(j) AS v, j FROM VALUES ('null'), ('false'), ('0'), ('0.0'), ('\"\"'), ('[]'), ('{}'), ('true'), ('1'), ('\"0\"'), ('[0]'), ('{\"a\":null}') AS t(j)")
    found = {r["j"]: r["t"] for r in v.select("j", V.truthy(F.col("v"), v.schema["v"].dataType).alias("t")).collect()}
    assert [j for j, t in found.items() if not t] == ["null", "false", "0", "0.0", '""', "[]", "{}"]


def test_ports(batch):
    assert {r["port"] for r in items.switch(batch, F.col("name"), StringType()).collect()} == {"a"}
    assert {r["port"] for r in items.switch(batch.where("ord = 2"), F.col("name"), StringType()).collect()} == {"default"}
    assert {r["port"] for r in items.switch(batch, F.col("ord") > 0, BooleanType()).collect()} == {"false"}


def test_split_out(spark):
    df = spark.createDataFrame([(0, [1, 2]), (1, []), (2, None)], "ord long, a array<long>")
    assert rows(items.split_out(df, "a"), "paired_item", "value") == [(0, 1), (0, 2), (2, None)]
    scalar = spark.createDataFrame([(0, "x")], "ord long, a string")
    assert rows(items.split_out(scalar, "a"), "paired_item", "value") == [(0, "x")]


def test_positions_hold_for_any_partitioning(spark):
    df = spark.range(1000).withColumnRenamed("id", "ord").repartition(13)
    assert rows(items.positions(df, "ord").where("position <> ord"), "ord") == []


def test_on_item_error(batch):
    failed, message = F.col("x").isNull(), F.lit("no x")
    assert rows(items.with_errors(batch, F.col("x"), failed, message), "ord", "error") == [(0, None), (1, None), (2, "no x")]
    assert items.with_errors(batch, F.col("x"), failed, message, "skip").count() == 2
    with pytest.raises(Exception, match="no x"):
        items.with_errors(batch, F.col("x"), failed, message, "fail_fast").collect()


def test_schema(spark):
    df = spark.createDataFrame([(1.0, "a", ["x"]), (1.5, "b", ["x", "y"]), (None, "a", None)], "n double, s string, t array<string>")
    schema = {"required": ["n"], "properties": {"n": {"type": "integer"}, "s": {"enum": ["a"]}, "t": {"type": "array", "items": {"enum": ["x"]}}}}
    found = [r["errors"] for r in items.validated(df, schema, ["n", "s", "t"]).collect()]
    assert found == [[], ["$.n: not of type integer", "$.s: not one of the values", "$.t[]: not one of the values"], ["$.n: missing"]]
    with pytest.raises(Exception, match="missing"):
        items.validated(df.where("n is null"), schema, ["n", "s", "t"], "fail").collect()


def test_values(spark):
    one = spark.sql("SELECT 'aé☃z' AS t, array(1.0, 2.0, null) AS a, array() AS e, '{\"text\": \"hi\", \"k\": {\"z\": 3}}' AS j")
    r = one.select(*[V.bounded(F.col("t"), n).alias(f"b{n}") for n in range(8)], V.total(F.col("a")).alias("sum"), V.at_path(F.col("j"), "k.z", StringType()).alias("z"), V.envelope(F.col("j")).alias("env"), V.fnv1a64("t").alias("fnv"), V.glob(F.col("t"), "a*z").alias("g")).first()
    assert [r[f"b{n}"] for n in range(8)] == ["", "a", "a", "aé", "aé", "aé", "aé☃", "aé☃z"]
    assert (r["sum"], r["z"], r["env"]["text"], r["g"]) == (3.0, "3", "hi", True)
    h = 0xCBF29CE484222325
    for b in "aé☃z".encode():
        h = (h ^ b) * 0x100000001B3 % 2**64
    assert r["fnv"] == f"{h:016x}"


@pytest.mark.parametrize("pattern, text, expected", [("a*b", "axb", True), ("a*b", "axbxb", False), ("*", "x\n", True), ("a*", "ba", False), ("*.x", "a.x", True), ("a.b", "axb", False), ("a*b*", "axbxb", True), ("a", "a\n", False)])
def test_glob(spark, pattern, text, expected):
    assert spark.range(1).select(V.glob(F.lit(text), pattern)).first()[0] is expected


def test_scatter_can_make_fewer_lanes(spark):
    df = spark.range(10).withColumnRenamed("id", "ord")
    lanes = rows(fanout.scatter(df, 6), "lane", "lane_count")
    assert sorted({n for n, _ in lanes}) == [0, 1, 2, 3, 4] and {c for _, c in lanes} == {5}
    assert len({r[0] for r in rows(fanout.scatter(df, None), "lane")}) == 10


def test_gather(spark):
    df = spark.createDataFrame([(0, 0, False), (1, 0, False), (2, 1, True), (3, 1, False)], "ord long, lane long, bad boolean")
    assert rows(fanout.gather(df, F.col("bad"), F.lit("boom")), "lane", "ord", "error") == [(0, 0, None), (0, 1, None), (1, None, "boom")]
    assert fanout.gather(df, F.col("bad"), F.lit("boom"), "skip").count() == 2
    with pytest.raises(Exception, match="boom"):
        fanout.gather(df, F.col("bad"), F.lit("boom"), "fail_fast").collect()


@pytest.mark.parametrize("policy, n, arrived, spent, expected", [
    ("all", 1, 3, False, "emit"), ("all", 1, 2, False, "wait"), ("all", 1, 2, True, "timeout"), ("any", 1, 1, False, "emit"), ("quorum", 9, 3, False, "emit"), ("first_n", 2, 2, False, "emit"), ("timeout_partial", 1, 0, True, "emit"),
])
def test_release(spark, policy, n, arrived, spent, expected):
    assert spark.range(1).select(fanout.release(policy, F.lit(arrived), F.lit(3), F.lit(spent), n)).first()[0] == expected


def test_dedup(spark):
    df = spark.createDataFrame([(0, "a"), (1, "a"), (2, None), (3, ""), (4, "b"), (5, None)], "ord long, key string")
    assert rows(fanout.dedup(df, F.col("key")), "ord") == [(0,), (2,), (3,), (4,), (5,)]
    committed = spark.createDataFrame([("a",)], "key string")
    assert rows(fanout.dedup(df, F.col("key"), committed), "ord") == [(2,), (3,), (4,), (5,)]
    assert rows(fanout.new_keys(df, F.col("key")), "key") == [("a",), ("b",)]


def test_loop(spark):
    df = spark.createDataFrame([(1,), (5,), (100,)], "x long")
    out = fanout.loop(df, lambda d: d.withColumn("x", F.col("x") - 2), F.col("x") <= 0, most=10)
    assert rows(out, "x", "iteration", "exit_reason") == [(-1, 1, "until"), (-1, 3, "until"), (80, 10, "max_iterations")]
    with pytest.raises(Exception, match="over 2 iterations"):
        fanout.loop(df, lambda d: d.withColumn("x", F.col("x") - 2), F.col("x") <= 0, most=2, on_exceeded="error").collect()


def test_retry():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ValueError("not yet")
        return "done"

    assert fanout.with_retry(flaky, 3, 1) == "done" and len(calls) == 3
    port, out = fanout.on_error_continue("n1", lambda: 1 / 0)
    assert (port, out["error"]["node"]) == ("error", "n1")


def test_set_union_keeps_old_repeats(spark):
    one = spark.sql("SELECT array('a', 'a', 'b') AS cur, array('b', 'c', 'c', 'd') AS new")
    assert one.select(state.set_union(F.col("cur"), F.col("new"))).first()[0] == ["a", "a", "b", "c", "d"]


def test_json_merges(spark):
    df = spark.createDataFrame([('{"a":{"x":1,"y":2},"b":1}', '{"a":{"y":3},"b":{"$replace":{"q":null}}}')], "a string, b string")
    assert json.loads(df.select(state.deep_merged("a", "b")).first()[0]) == {"a": {"x": 1, "y": 3}, "b": {"q": None}}
    df = spark.createDataFrame([('{"a":{"x":1,"y":2},"b":1}', '{"a":{"y":null},"c":2}')], "a string, b string")
    assert json.loads(df.select(state.merge_patched("a", "b")).first()[0]) == {"a": {"x": 1}, "b": 1, "c": 2}


def test_checkpoints(spark):
    c = spark.createDataFrame([("t", "n", k, k - 1 if k else None) for k in range(6)] + [("t", "m", 10, 2)], "thread string, ns string, id long, parent long")
    assert rows(state.pruned(c, ["thread", "ns"], "id", "parent", "id", 0), "id") == sorted([(k,) for k in range(6)] + [(10,)], key=str)
    assert rows(state.pruned(c.where("id <> 5"), ["thread"], "id", "parent", "id", 1), "id") == sorted([(0,), (1,), (2,), (10,)], key=str)
    assert rows(state.state_history(c, "thread", "id", "parent", "id", 3), "id", "depth") == sorted([(10, 0), (2, 1), (1, 2)], key=str)
    w = spark.createDataFrame([("k", -1, "a", 1), ("k", -1, "b", 2), ("k", 0, "c", 3), ("k", 0, "d", 4)], "task string, idx long, v string, seq long")
    assert rows(state.merged_writes(w, ["task", "idx"], "idx", "v", "seq"), "idx", "v") == [(-1, "b"), (0, "c")]
    tasks = spark.createDataFrame([("a",), ("b",)], "task string")
    assert rows(state.pending_tasks(tasks, tasks.where("task = 'a'"), "task"), "task") == [("b",)]
    assert rows(state.pending_tasks(tasks, tasks, "task"), "task") == [("a",), ("b",)]


def test_latencies_are_first_in_first_out(spark):
    e = spark.createDataFrame([("r", 0, 5, "end"), ("r", 1, 10, "start"), ("r", 2, 20, "start"), ("r", 3, 25, "end"), ("r", 4, 45, "end"), ("r", 5, 50, "end"), ("r", 6, 60, "start"), ("r", 7, 61, "end")], "run string, seq long, ms long, kind string")
    out = journal.paired_latencies(e, ["run"], "seq", "ms", F.col("kind") == "start", F.col("kind") == "end")
    assert rows(out, "seq", "elapsed_ms") == [(3, 15), (4, 25), (7, 1)]


def test_graphs(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d")], "src string, dst string")
    roots = spark.createDataFrame([("a",)], "node string")
    assert rows(graphs.layers(edges, roots), "node", "layer") == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert rows(graphs.on_cycle(edges), "node") == [("b",), ("c",)]
    kinds = spark.createDataFrame([("b", "merge"), ("d", "merge")], "id string, kind string")
    assert rows(graphs.merges_on_cycles(kinds, edges), "id") == [("b",)]


def test_rankings(spark):
    m = spark.createDataFrame([("f", 1, 0, 0, True), ("f", 2, 5, 4, False), ("f", 3, 9, 0, True), ("f", 4, 4, 1, True)], "family string, id long, applied long, helped long, offer boolean")
    assert rows(ledger.standings(m, "family", "id"), "id", "standing") == [(1, "unproven"), (2, "champion"), (3, "beaten"), (4, "beaten")]
    assert rows(ledger.collapsed_families(m, "family", "id", F.col("offer")), "id") == [(1,)]
    assert rows(ledger.collapsed_families(m, "family", "id", F.lit(True)), "id") == [(2,)]
    lessons = m.withColumn("kind", F.when(F.col("id") == 3, "constraint").otherwise("hint"))
    assert rows(ledger.recalled(lessons, 1, ["family"]), "id") == [(2,), (3,)]


def test_evaluation(spark):
    e = spark.createDataFrame([("on", 0, 4, True, None, 1.0, True), ("on", 1, 9, True, False, 1.0, False), ("on", 2, 2, True, True, 1.0, True), ("off", 0, 5, False, None, 2.0, False)], "arm string, pos long, attempts long, satisfied boolean, verified boolean, cost_usd double, used_workflow boolean")
    arms = ledger.evaluated(e)
    assert rows(arms, "arm", "solved", "mean_attempts", "cost_per_solve", "trend") == [("off", 0, None, 0.0, None), ("on", 2, 3.0, 1.5, -1.0)]
    assert ledger.verdict(arms, "on", "off").first()["verdict"] == "solved_more"


def test_void_and_calls(batch):
    assert tables.void(batch) == 3

    def call(row):
        if row["x"] is None:
            raise ValueError("no x")
        return str(row["x"])

    assert rows(tables.call_each(batch, call), "ord", "response", "error") == [(0, "1.5", None), (1, "0.0", None), (2, None, "no x")]
    assert tables.call_each(batch, call, on_error="skip").count() == 2


def test_journal_and_stream(spark, tmp_path):
    log = spark.createDataFrame([("r1", k, f"2024-01-01 00:0{k}:00") for k in range(6)] + [("r2", 0, "2024-01-01 00:00:30")], "run_id string, offset long, ts string").withColumn("ts", F.to_timestamp("ts"))
    tables.append_journal(log, str(tmp_path / "journal"))
    assert rows(tables.read_journal(spark, str(tmp_path / "journal"), "r1", 4), "offset") == [(4,), (5,)]
    log.where("offset < 3").coalesce(1).write.parquet(str(tmp_path / "in"))
    log.where("offset >= 3").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = streams.tail(spark, str(tmp_path / "in"), log.schema, 1)
    done = streams.to_table(streams.latencies(source.withColumn("start", F.col("offset") % 2 == 0), ["run_id"], "offset", "ts", "start", "1 hour"))
    assert rows(done, "run_id", "seq", "elapsed_ms") == [("r1", 1, 60000), ("r1", 3, 60000), ("r1", 5, 60000)]
    sessions = streams.to_table(streams.session_counts(streams.tail(spark, str(tmp_path / "in"), log.schema, 1), "ts", ["run_id"], "5 minutes", "1 minute"))
    assert set(sessions.columns) == {"start", "end", "run_id", "n", "batch"}


def test_expression_functions(spark):
    from flowloom.functions import expr as X

    one = spark.sql("SELECT array(3, 1, 2, 1) AS a, map('b', 1, 'a', 2) AS m, 'a--b--' AS s, array('x', null, 'z') AS t, 'é☃' AS u, array(struct(2 AS k, 'p' AS v), struct(1 AS k, 'q' AS v), struct(2 AS k, 'r' AS v)) AS rows")
    a, m, s = F.col("a"), F.col("m"), F.col("s")
    r = one.select(
        X.keys(m).alias("keys"), X.has(m, F.lit("a")).alias("has"), X.with_entries(m, lambda e: F.struct(F.upper(e["key"]).alias("key"), (e["value"] * 2).alias("value"))).alias("with"),
        X.contains_all(a, F.array(F.lit(1), F.lit(3))).alias("contains"), X.indices(a, F.lit(1)).alias("at"), X.numbers(1, F.lit(4)).alias("range"), X.numbers(5, F.lit(4)).alias("none"),
        X.running(a, F.lit(0), lambda x, y: x + y).alias("foreach"), X.pieces(s, "--").alias("pieces"), X.pieces(F.lit(""), "-").alias("no_pieces"), X.rtrimstr(s, "--").alias("rtrim"), X.ltrimstr(s, "a-").alias("ltrim"),
        X.joined(F.col("t"), "+").alias("join"), X.to_number(F.lit("1.5e1")).alias("n"), X.to_number(s).alias("nan"), X.code_points(F.col("u")).alias("codes"), X.from_code_points(X.code_points(F.col("u"))).alias("text"),
        F.transform(X.group_by(F.col("rows"), lambda x: x["k"]), lambda g: X.joined(F.transform(g, lambda x: x["v"]), "")).alias("groups"), X.max_by(F.col("rows"), lambda x: x["k"])["v"].alias("max"), X.min_by(F.col("rows"), lambda x: x["k"])["v"].alias("min"),
        X.alternative(F.lit(None).cast("int"), F.lit(7)).alias("alt"), X.alternative(F.lit(False), F.lit(True), True).alias("alt2"),
    ).first()
    assert r["keys"] == ["a", "b"] and r["has"] and r["with"] == {"A": 4, "B": 2} and r["contains"]
    assert (r["at"], r["range"], r["none"], r["foreach"]) == ([1, 3], [1, 2, 3], [], [3, 4, 6, 7])
    assert (r["pieces"], r["no_pieces"], r["rtrim"], r["ltrim"], r["join"]) == (["a", "b", ""], [], "a--b", "-b--", "x++z")
    assert (r["n"], r["nan"], r["codes"], r["text"]) == (15.0, None, [233, 9731], "é☃")
    assert (r["groups"], r["max"], r["min"], r["alt"], r["alt2"]) == (["q", "pr"], "r", "q", 7, True)
    twice = spark.sql("SELECT array(struct('a' AS key, 1 AS value), struct('a' AS key, 2 AS value)) AS e")
    assert twice.select(X.from_entries(F.col("e"))).first()[0] == {"a": 2}


def test_graph_edits_and_forks(spark):
    nodes = spark.createDataFrame([("a", "{}"), ("b", '{"x": 1}')], "id string, config string")
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    with pytest.raises(ValueError):
        graphs.add_nodes(nodes, nodes.where("id = 'a'"))
    assert graphs.connected_edges(edges, edges).count() == 1 and graphs.disconnected_edges(edges, edges).count() == 0
    assert rows(graphs.removed_node(nodes, edges, "b")[1], "src") == []
    assert rows(graphs.renamed_node(nodes, edges, "b", "c")[1], "src", "dst") == [("a", "c")]
    assert rows(graphs.patched_configs(nodes, spark.createDataFrame([("b", '{"x": null, "y": 2}')], "id string, patch string")), "id", "config") == [("a", "{}"), ("b", '{"y": 2}')]
    c = spark.createDataFrame([("t", 1, None, 5.0)], "thread_id string, id long, parent long, state double")
    assert rows(state.forked(c, "id", "parent", 1, 2, {"state": F.lit(6.0)}), "id", "parent", "state") == [(1, None, 5.0), (2, 1, 6.0)]
    with pytest.raises(ValueError):
        state.copied_thread(c, "t", "t")
    assert rows(state.copied_thread(c, "t", "u"), "thread_id", "id") == [("u", 1)]
    assert rows(state.threads(c), "thread_id") == [("t",)]


def test_staged_tables_can_be_cleared(spark):
    from pathlib import Path

    from flowloom.sources.staging import cleared, shared_folder, staged

    kept = staged(spark.range(5), "kept")
    folder = Path(shared_folder(spark)) / "flowloom" / spark.sparkContext.applicationId
    assert kept.count() == 5 and any(folder.glob("kept-*"))
    cleared(spark)
    assert not folder.exists()


def test_unknown_endpoints_deal_ids_by_rows(spark):
    """Over enough tasks for their rows, however small their bytes; nulls, repeats and ids of both ends."""
    nodes = spark.range(20_000).selectExpr("id % 9000 AS id").unionByName(spark.createDataFrame([(None,)], "id long"))
    edges = spark.range(20_000).selectExpr("id AS src", "id % 9001 AS dst").unionByName(spark.createDataFrame([(None, 5), (-1, None), (-1, 3)], "src long, dst long"))
    want = {(None, "source"), (None, "target"), (-1, "source"), (9000, "target")} | {(k, "source") for k in range(9000, 20_000)}
    for rows in (graphs.ROWS, 4000):
        found = graphs.unknown_endpoints(nodes, edges, rows)
        got = [tuple(r) for r in found.select("id", "end").collect()]
        assert len(got) == len(want) and set(got) == want
    assert "hashpartitioning(id#" in (plan := found._jdf.queryExecution().toString()) and "REPARTITION_BY_NUM" in plan  # packed by bytes before
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", -1)
    try:
        assert graphs.unknown_endpoints(nodes, edges, 4000).rdd.getNumPartitions() >= 15
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
