"""Prints the figures of the README for folders of tables: python -m tests.llm.figures FOLDER..."""

from __future__ import annotations

import sys
import tempfile

import numpy as np
from pyspark.sql import SparkSession

from flowloom.llm import multi_index, pieces, quality, toxicity, vantage
from tests.llm.test_vectors import brute_links, brute_nearest, taken


def held_out(spark, d, query, label):
    rows = query(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet").where(f"{label} is not null"), "doc_id").select("predicted", label).collect()
    right = np.array([r["predicted"] == r[label] for r in rows])
    truth = np.array([r[label] == 1 for r in rows])
    return f"accuracy {right.mean():.4f}, of label 1 {right[truth].mean():.4f}, of label 0 {right[~truth].mean():.4f} ({len(rows)} rows)"


def main() -> None:
    spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="flowloom-figures-")).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for d in sys.argv[1:]:
        print(d, "op1", held_out(spark, d, quality.op1_quality_classifier, "quality"), flush=True)
        print(d, "op2", held_out(spark, d, toxicity.op2_toxicity, "toxic"), flush=True)
        ids, x = taken(spark.read.parquet(f"{d}/embeddings.parquet"))
        want = brute_nearest(ids, x, 5, 50)
        rows = vantage.op4_nearest_neighbours(spark, d).collect()
        print(d, "op4 recall", round(sum(r["vec_id"] in want.get(r["query_id"], ()) for r in rows) / sum(map(len, want.values())), 4), flush=True)
        links = brute_links(ids, x)
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in multi_index.op9_embedding_dedup(spark, d).collect()}
        print(d, "op9 links", sum(got[i][0] for i in links), "of", sum(n for n, _ in links.values()), "components alike", np.mean([got[i][1] == links[i][1] for i in links]), flush=True)
        found = pieces.op5_sentencepiece(spark, d).selectExpr("sum(n_tokens) n", "sum(n_bytes) b", "count_if(not round_trip) bad").first()
        print(d, "op5", found["n"], "tokens for", found["b"], "bytes,", found["bad"], "texts not given back", flush=True)


if __name__ == "__main__":
    main()
