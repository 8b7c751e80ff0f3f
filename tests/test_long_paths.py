"""Paths of more than 64 edges."""

from flowloom.operators import graphs, state


def test_all_ancestors_of_a_kept_checkpoint_stay(spark):
    rows = [("a", k, k - 1 if k else None) for k in range(150)] + [("b", 200, 201), ("b", 201, 200), ("b", 199, None)]
    c = spark.createDataFrame(rows, "thread string, id long, parent long")
    assert sorted(r["id"] for r in state.pruned(c, ["thread"], "id", "parent", "id", 1).collect()) == [*range(150), 200, 201]


def test_a_long_cycle_is_seen(spark):
    edges = spark.createDataFrame([(k, (k + 1) % 100) for k in range(100)], "src long, dst long")
    assert graphs.on_cycle(edges).count() == 100


def test_chains_and_paths_of_any_length(spark):
    """A chain of 200 checkpoints stays whole, a cycle of 150 nodes is found, 40 notes that supersede each other go together."""
    from pyspark.sql import functions as F

    n = 200
    chain = spark.range(n).select(F.lit("t").alias("thread"), F.col("id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.col("id").alias("seq"))
    assert state.pruned(chain, ["thread"], "id", "parent", "seq", 1).count() == n
    ring = spark.range(150).select(F.col("id").alias("src"), ((F.col("id") + 1) % 150).alias("dst"))
    assert graphs.on_cycle(ring).count() == 150
    path = spark.range(60).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert graphs.on_cycle(path).count() == 0 and graphs.reachable(path).count() == 60 * 61 // 2
    kinds = spark.createDataFrame([(0, "condition"), (60, "agent")], "id long, kind string")
    start = spark.createDataFrame([(60,)], "node long")
    assert [tuple(r) for r in graphs.upstream(path, kinds, start, "condition").collect()] == [(60, 0, 60)]
    assert graphs.ungathered(spark.createDataFrame([(0, "scatter"), (60, "gather")], "id long, kind string"), path).count() == 0
    notes = spark.range(60).select(F.lit("s").alias("scope"), F.col("id"), F.when((F.col("id") >= 20) & (F.col("id") < 59), F.col("id") + 1).alias("by"), F.lit(False).alias("pinned"))
    kept = state.retained_notes(notes, "scope", "id", "by", "pinned", 30)
    assert sorted(r["id"] for r in kept.collect()) == []  # 20 single notes are too few to drop, so the chain of 40 goes with them
    kept = state.retained_notes(notes, "scope", "id", "by", "pinned", 40)
    assert sorted(r["id"] for r in kept.collect()) == list(range(20, 60))
    pinned = notes.withColumn("pinned", F.col("id") == 33)
    assert sorted(r["id"] for r in state.retained_notes(pinned, "scope", "id", "by", "pinned", 30).collect()) == list(range(20, 60))
    cycle = spark.createDataFrame([("s", 1, 2, False), ("s", 2, 1, False), ("s", 3, 1, False), ("s", 4, 99, False)], notes.schema)
    assert {r["node"]: r["group"] for r in state.chain_groups(cycle, "id", "by").collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_order_across_types(spark):
    import json
    import random

    from pyspark.sql import functions as F

    from flowloom.functions import values as V

    values = [None, False, True, -5, -0.5, 0, 3, 1e300, "", "a", "a b", "ab", "é", "b\u0000", "b", [], [1], [2], [10], [[1], 2], [1, 2], ["a b"], ["a"], {}, {"a": 1}, {"a": 2}, {"a": [3]}, {"a": 1, "b": 0}, {"b": 0}]
    ranked = [(k, json.dumps(v)) for k, v in enumerate(values)]
    order = {json.dumps(v): k for k, v in enumerate([*values[:7], 1e300, "", "a", "a b", "ab", "b", "b\u0000", "é", [], [1], [1, 2], [2], [10], ["a"], ["a b"], [[1], 2], {}, {"a": 1}, {"a": 2}, {"a": [3]}, {"a": 1, "b": 0}, {"b": 0}])}
    random.Random(1).shuffle(ranked)
    df = spark.createDataFrame(ranked, "k long, t string")
    got = [r["t"] for r in df.orderBy(V.order_key(F.parse_json("t"))).collect()]
    assert got == sorted((t for _, t in ranked), key=order.get)


def test_fnv_and_nested_replace(spark):
    from pyspark.sql import functions as F

    from flowloom.functions import values as V

    def plain(t):
        h = 0xCBF29CE484222325
        for b in t.encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        return f"{h:016x}"

    texts = ["", "a", "é☃", None, "x" * 999, "foobar"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    assert [r["d"] for r in df.orderBy("k").select(V.fnv1a64("t").alias("d")).collect()] == [None if t is None else plain(t) for t in texts]
    pair = spark.createDataFrame([('{"x": 1}', '{"z": {"w": {"$replace": 5}}, "x": {"y": {"$replace": {"$replace": 1}}}}'), ("[1]", '{"a": null}')], "a string, b string")
    assert [r[0] for r in pair.select(state.deep_merged("a", "b")).collect()] == ['{"x": {"y": {"$replace": 1}}, "z": {"w": 5}}', '{"a": null}']
