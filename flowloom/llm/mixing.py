"""Mixing sources to target weights by Sainte-Laguë apportionment.

Every source has a weight and so a target share of all words; a target stops at `most` times the source's
size, and what is left over is shared again by weight. The words of a source lie in shards, those of a shard
in blocks of `block` words; one word by default, so that the smallest sources come out at their targets too. Sainte-Laguë (highest quotients
claim / (2 seats + 1)) allots whole blocks first to sources, then within a source to its shards. A shard with n blocks and a quota q takes
each block q // n times, and q % n of them once more: those from a seeded place on, going on at the shard's start. Documents lie in their
shard in the order of a seeded hash, so these are whole documents but for the first and the last.

Targets and quotas are computed on tables with a row for each source or shard. The documents are shuffled once,
by shard; shards hold about `shard_rows` rows, more where a source would have over `most_shards`, so a source with a third of all rows is spread
out and its quotas fit in a task.

Cases: null text counts 0 words and is never taken; null source is a source of its own, ranked last; empty tables
give an empty result; repeated rows each take part, and rows that are alike in all columns may swap their parts; very long texts are one document in
their shard, which may then be much larger than others;
columns named like the ones that mix() adds are replaced there and kept by mixed_documents().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowloom.llm.common import bounded_broadcast, table, written

WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"
_ADDED = ("size", "source_size", "target", "taken", "_sid", "_shard", "_start", "_quota", "_blocks", "_words", "_block")


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """source, source_size, n_rows -> also _sid (rank from 0) and target. Where a cap binds, the lowest cap per weight
    binds first: with sources in that order, the first whose share of what is left stays under its cap fixes the level."""
    ranked = sizes.withColumn("_sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("_sid") % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("_cap", F.col("source_size") * float(most))
    every = Window.orderBy(F.col("_cap") / F.col("_w"), "_sid")
    up, down = every.rowsBetween(Window.unboundedPreceding, -1), every.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    ranked = ranked.withColumn("_left", F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(up), F.lit(0.0)))
    ranked = ranked.withColumn("_level", F.col("_left") / F.sum("_w").over(down))
    fits = F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct((F.col("_cap") / F.col("_w")).alias("r"), "_sid", F.col("_level").alias("level")))
    level = F.coalesce(F.min(fits).over(whole)["level"], F.lit(float("inf")))
    return ranked.withColumn("target", F.least("_cap", level * F.col("_w"))).select("source", "_sid", "source_size", "n_rows", "target")


def sainte_lague(parties: DataFrame, group: list[str], claim: str, seats: str, key: list[str], into: str) -> DataFrame:
    """Seats for each party of a group. Every party starts with its share rounded; what that misses or exceeds is
    settled by highest (lowest) quotients. A party can gain or lose at most its share of that difference and two more."""
    g = Window.partitionBy(*group)
    p = parties.withColumn("_total", F.sum(claim).over(g))
    share = F.when(F.col("_total") > 0, F.col(claim) / F.col("_total")).otherwise(F.lit(0.0))
    p = p.withColumn("_share", share).withColumn("_first", F.floor(F.col("_share") * F.col(seats) + 0.5))
    p = p.withColumn("_miss", F.when(F.col("_total") > 0, F.col(seats) - F.sum("_first").over(g)).otherwise(F.lit(0)))
    steps = F.when(F.col("_miss") == 0, F.lit(0)).otherwise(F.ceil(F.abs("_miss") * F.col("_share")) + 2)
    steps = F.when(F.col("_miss") < 0, F.least(steps, F.col("_first"))).otherwise(steps)
    more = p.where(steps > 0).select(*group, *[k for k in key if k not in group], claim, "_first", "_miss", F.explode(F.sequence(F.lit(1), steps.cast("int"))).alias("_j"))
    seat = F.when(F.col("_miss") > 0, F.col("_first") + F.col("_j") - 1).otherwise(F.col("_first") - F.col("_j"))
    quotient = F.col(claim) / (2 * seat + 1)
    # of equal quotients the first party keeps its seat, so it is the first to gain one and the last to lose one
    gains, loses = F.col("_miss") > 0, F.col("_miss") < 0
    name = F.struct(*key, "_j")
    order = Window.partitionBy(*group).orderBy(F.when(gains, -quotient).otherwise(quotient), F.when(gains, name), F.desc(F.when(loses, name)))
    more = more.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= F.abs("_miss"))
    more = more.groupBy(*key).agg(F.sum(F.signum("_miss")).cast("long").alias("_more"))
    return p.join(more, key, "left").withColumn(into, F.col("_first") + F.coalesce("_more", F.lit(0))).drop("_total", "_share", "_first", "_miss", "_more")


def mix(docs: DataFrame, text: str | None = "text", block: int = 1, shard_rows: int = 256, most_shards: int = 1 << 16, seed: int = 7, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """`docs` (doc_id, source, and text or, where `text` is None, size) with size, source_size, target, taken, and the
    plan of what is taken: _start (first word's place in the shard), _words, _blocks and _quota of its shard, _sid and _shard."""
    docs = docs.drop(*[c for c in _ADDED if c != "size" or text is not None])
    sized = docs.withColumn("size", word_count(text)) if text is not None else docs
    ordered = ["doc_id", "size"] + ([text] if text is not None else [])
    per_source = written(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows")), weights, most), "mix-sources")
    placed = F.xxhash64(F.lit(seed), *ordered)
    known = bounded_broadcast(per_source.select(F.col("source").alias("_source"), "_sid", "source_size", "target", F.least(F.ceil(F.col("n_rows") / shard_rows), F.lit(most_shards)).alias("_shards")))
    sharded = sized.withColumn("_placed", placed).join(known, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    sharded = sharded.withColumn("_shard", F.pmod("_placed", F.col("_shards")))
    shards = sharded.groupBy("_sid", "_shard").agg(F.sum("size").alias("_size"), F.first("source_size").alias("_of"), F.first("target").alias("_target"))
    sources = per_source.select("_sid", "target", F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long").alias("_seats"))
    allotted = sainte_lague(sources.withColumn("_all", F.lit(0)), ["_all"], "target", "_seats", ["_sid"], "_source_quota").select("_sid", "_source_quota")
    shards = shards.join(bounded_broadcast(written(allotted, "mix-quotas")), "_sid").withColumn("_claim", F.col("_size").cast("double"))
    quotas = sainte_lague(shards, ["_sid"], "_claim", "_source_quota", ["_sid", "_shard"], "_q")
    blocks = F.ceil(F.col("_size") / block)
    quotas = written(quotas.select("_sid", "_shard", F.col("_size").alias("_words"), blocks.alias("_blocks"), F.least("_q", blocks * most).alias("_quota")), "mix-shards")
    inside = Window.partitionBy("_sid", "_shard").orderBy("_placed", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    laid = sharded.join(quotas.hint("merge"), ["_sid", "_shard"]).withColumn("_start", F.sum("size").over(inside) - F.col("size"))
    laid = laid.withColumn("_block", F.lit(block)).withColumn("taken", taken())
    return laid.drop("_placed", "_shards")


def _extra() -> list[tuple[Column, Column]]:
    """Of a document: the ranges of its words, from 0, that lie in blocks taken once more; two, as these may go on at the shard's start. Empty ones end where or before they start."""
    n, block, start, size = F.col("_blocks"), F.col("_block"), F.col("_start"), F.col("size")
    first = F.pmod(F.xxhash64("_sid", "_shard"), n)
    last = first + F.pmod(F.col("_quota"), n)
    ranges = [(first * block, F.least(last, n) * block), (F.lit(0).cast("long"), F.greatest(last - n, F.lit(0)) * block)]
    return [(F.greatest(a - start, F.lit(0)), F.least(b - start, size)) for a, b in ranges]


def taken() -> Column:
    extra = sum((F.greatest(b - a, F.lit(0)) for a, b in _extra()), F.lit(0).cast("long"))
    return F.when((F.col("size") == 0) | (F.col("_blocks") == 0), F.lit(0)).otherwise(F.floor(F.col("_quota") / F.col("_blocks")) * F.col("size") + extra).cast("long")


def mixed_documents(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mix itself, with the columns of `docs`: a row for each time a whole text is taken, and one for the words of a
    text that lie in blocks taken once more, joined by one space."""
    columns = docs.columns
    whole = docs.select("doc_id", "source", text, F.struct(*[c for c in columns if c != text]).alias("_row"))
    laid = mix(whole, text, **options).where(F.col("taken") > 0)
    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rest = F.col("taken") % F.col("size")
    times = F.floor(F.col("taken") / F.col("size"))
    spans = [F.slice(words, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int")) for a, b in reversed(_extra())]  # in the text's order
    part = F.array_join(F.concat(*spans), " ")
    texts = F.concat(F.array_repeat(F.col(text), times.cast("int")), F.when(rest > 0, F.array(part)).otherwise(F.array().cast("array<string>")))
    out = laid.select("_row", F.explode(texts).alias("_text"))
    made = {text: F.col("_text"), "n_chars": F.char_length("_text").cast(docs.schema["n_chars"].dataType) if "n_chars" in columns else None}
    return out.select(*[made[c].alias(c) if c in made else F.col("_row").getField(c).alias(c) for c in columns])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "documents").select("doc_id", "source", word_count("text").alias("size"))
    return mix(written(sizes, "mix-sizes"), text=None).select("doc_id", "size", "source_size", "target", "taken", "source", F.col("_shard").alias("shard"))
