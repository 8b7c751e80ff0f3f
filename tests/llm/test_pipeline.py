"""Each stage of the pipeline against brute force on its own input."""

import collections

import corpus_pipeline
from flowloom.llm import mixing, pieces, quality
from flowloom.llm.common import table, written
from flowloom.llm.toxicity import is_training
from tests.llm.test_near_copies import brute_groups


def kept_text(raw, seen, length=200):
    covered = bytearray(len(raw))
    for i in range(len(raw) - length + 1):
        if seen[raw[i : i + length]] > 1:
            covered[i : i + length] = b"\x01" * length
    return bytes(x for x, c in zip(raw, covered) if not c).decode("utf-8", "ignore")


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    made = {}
    for name, stage in corpus_pipeline.STAGES:
        made[name] = (docs, docs := written(stage(spark, docs, sf_dir), name))
    for name, (before, after) in made.items():
        if name != "tokens":
            assert after.columns == columns and after.dtypes == before.dtypes

    before, after = made["quality"]
    model = quality.fit(before, table(spark, sf_dir, "labels"), "quality", is_training(3, 1))
    good = {r["doc_id"] for r in quality.scores(before, model).where("score >= 0.5").collect()}
    assert {r["doc_id"] for r in after.collect()} == good
    clean = before.join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id").collect()
    assert sum(r["doc_id"] in good for r in clean) >= 0.98 * len(clean)

    before, after = made["near_dedup"]
    heads = brute_groups({r["doc_id"]: r["text"] for r in before.collect()})
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(set(heads.values()))

    before, after = made["suffix_dedup"]
    texts = {r["doc_id"]: r["text"].encode() for r in before.collect()}
    seen = collections.Counter(t[i : i + 200] for t in texts.values() for i in range(len(t) - 199))
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in after.collect()}
    want = {i: kept_text(t, seen) for i, t in texts.items()}
    assert got == {i: (t, len(t)) for i, t in want.items()}

    before, after = made["mixing"]
    plan = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix(before).collect()}
    words = collections.Counter()
    whole = {r["doc_id"]: r["text"].split() for r in before.collect()}
    for r in after.collect():
        mine = r["text"].split()
        words[r["doc_id"]] += len(mine)
        it = iter(whole[r["doc_id"]])
        assert all(w in it for w in mine)  # in the text's order
    assert {i: n for i, n in words.items()} == {i: t for i, (t, _) in plan.items() if t}

    before, after = made["tokens"]
    assert after.count() == before.count() and after.where("not round_trip").count() == 0
    back = sorted((r["doc_id"], r["text"]) for r in pieces.detokenized(after).collect())
    assert back == sorted((r["doc_id"], r["text"]) for r in before.collect())


def test_registered(spark):
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {"pipeline"} | {f"op{k}" for k in range(1, 11)} <= {n if n == "pipeline" else n.split("_")[0] for n in names}
    assert len(corpus_pipeline.STAGES) == 5 and set(__spark_entry__.oracle_sql()) <= names


def test_nulls_empty_and_long_texts_and_an_empty_table(spark, sf_dir, tmp_path):
    """From end to end: ids and texts that are null, texts that are empty or long, repeated rows; and no rows at all."""
    docs = table(spark, sf_dir, "documents")
    odd = [(None, "a b c d e f"), (None, None), (900_001, None), (900_002, ""), (900_003, "word " * 30_000), (900_003, "word " * 30_000), (900_004, "x" * 20_000)]
    rows = spark.createDataFrame([(i, t, None, None, None) for i, t in odd], docs.select("doc_id", "text", "lang", "source", "n_chars").schema).select(*docs.columns)
    for name, df in (("odd", docs.limit(40).unionByName(rows)), ("none", docs.limit(0))):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        table(spark, sf_dir, "labels").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert out.where("not round_trip or n_tokens <> size(token_ids)").count() == 0
        assert (out.count() > 0) == (name == "odd")
