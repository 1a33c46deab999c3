"""Mix sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.common import WORD, running, written

#: Buckets of the rank order in each source; a bucket is what one window sorts.
BUCKETS = 1024


def word_count(text: Column) -> Column:
    """Words of a text, null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """A target for each row (source, source_size) of ``sizes``.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` times all sizes. No
    target exceeds ``most`` times its source's size; the excess goes to the others by weight. With the
    sources ordered by limit per weight, those at their limit are a prefix, so one pass finds them.
    ``sizes`` has one row for each source, not for each document.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(most)).alias("limit"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    rows = rows.withColumn("level", F.greatest(left, F.lit(0.0)) / F.sum("weight").over(after))
    rows = rows.withColumn("nth", F.row_number().over(order))
    # the first source whose level stays within its limit, and all after it, are filled to that level
    within = F.col("level") * F.col("weight") <= F.col("limit")
    first = F.min(F.when(within, F.struct("nth", "level"))).over(every)
    target = F.when(first.isNull() | (F.col("nth") < first["nth"]), F.col("limit")).otherwise(F.least(first["level"] * F.col("weight"), F.col("limit")))
    return rows.select("source", "source_size", target.alias("target"))


def unit(id_col: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the id and the seed only."""
    hexa = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit("null")))), 1, 12)
    return (F.conv(hexa, 16, 10).cast("double") + 0.5) / F.lit(float(16**12))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 7,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", liking: Column | None = None,
) -> DataFrame:
    """How many copies of each document a mix takes whose sources have the target sizes of :func:`targets`.

    Each source needs ``ratio = target / source_size`` copies of its words on average: every document
    gets ``floor(ratio)`` certain whole copies. The rest is a fixed-size sample without replacement by
    Pareto order sampling: a document with inclusion probability ``p`` ranks by the odds of its random
    number divided by the odds of ``p``, and the source's first documents in this order are taken until
    the words come nearest to what is wanted. ``liking`` (a positive column, mean near 1) makes the
    probabilities unequal; without it a longer document is a little less likely than a short one of the same
    source, which evens the sample's words out. The random number depends on the id and the seed only, so reruns
    agree. The order is cut by prefix sums over rank buckets, so a source that holds most rows is spread
    over many tasks.

    Returns one row per input row: ``doc_id, size`` (words; null text: 0), ``source``, ``source_size``,
    ``target``, ``copies`` (0 to ``most``), ``taken`` (``copies * size``), ``row_key`` (a hash of text and source). A document without words is
    never part of the sample's rest. Repeated rows are documents of their own; an empty table gives none.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), (F.lit(1.0) if liking is None else liking.cast("double")).alias("liking"), F.xxhash64(text_col, source_col).alias("row_key"))
    rows = written(rows)  # texts are read once
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.avg("size").alias("mean"), F.avg("liking").alias("mean_liking"))
    aims = targets(per.select("source", "source_size"), weights, share, float(most)).alias("a")
    per = per.alias("p").join(aims, F.col("p.source").eqNullSafe(F.col("a.source"))).select("p.source", "p.source_size", "mean", "mean_liking", "target")
    per = per.withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    per = per.withColumn("certain", F.floor(F.col("ratio") + F.lit(1e-12))).withColumn("rest", F.greatest(F.col("ratio") - F.col("certain"), F.lit(0.0)))
    per = per.withColumn("wanted", F.greatest(F.col("target") - F.col("certain") * F.col("source_size"), F.lit(0.0)))
    # one row for each source; as a table of known size Spark broadcasts it where it is small, and splits a large source where not
    per = written(per)
    joined = rows.alias("r").join(per.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).select("r.*", F.struct("source_size", "target", "rest", "certain", "wanted", "mean", "mean_liking").alias("s"))
    # inclusion probability: the source's rest, tilted by liking and length
    tilt = F.col("liking") / F.col("s.mean_liking") * F.lit(2.0) / (F.lit(1.0) + F.col("size") / F.greatest(F.col("s.mean"), F.lit(1.0))) if liking is None else F.col("liking") / F.col("s.mean_liking")
    p = F.least(F.greatest(F.col("s.rest") * (F.lit(0.9) + F.lit(0.1) * tilt), F.lit(1e-9)), F.lit(1 - 1e-9))
    u = unit(F.col("doc_id"), seed)
    odds = (u / (1 - u)) / (p / (1 - p))
    # near u, and in the order of the odds within a source: so its buckets are near equal
    usual = F.least(F.greatest(F.col("s.rest"), F.lit(1e-9)), F.lit(1 - 1e-9))
    even = odds * (usual / (1 - usual))
    ranked = joined.select(
        "doc_id", "source", "size", "row_key", "s", odds.alias("odds"), F.coalesce(F.col("source"), F.lit("")).alias("__group"), F.isnull("source").alias("__none"),
        F.least(F.floor(even / (even + 1) * BUCKETS), F.lit(BUCKETS - 1)).cast("int").alias("__bucket"),
    )
    summed = running(ranked, ["__group", "__none"], "__bucket", ["odds", "doc_id", "size", "row_key"], {"before": "size"})
    # taken if more than half of it fits into what is wanted: the cut that comes nearest
    extra = F.when((F.col("size") > 0) & (F.col("s.wanted") > 0) & (F.col("before") + F.col("size") / 2 <= F.col("s.wanted")), 1).otherwise(0)
    copies = F.least(F.col("s.certain") + extra, F.lit(most)).cast("int")
    return summed.select("doc_id", "size", "source", F.col("s.source_size").alias("source_size"), F.col("s.target").alias("target"), copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), "row_key")


def mixed_rows(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as ``decisions`` (doc_id, row_key, copies) says, with their own columns only.

    Of rows with the same id, text and source each takes one of their decisions, so the words are those of the mix.
    """
    key = ["doc_id", "row_key"]
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1))).alias("nth")
    d = decisions.select(*key, "copies", F.row_number().over(Window.partitionBy(*key).orderBy("copies")).alias("nth")).where("copies > 0").alias("d")
    r = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text", "source").alias("row_key")).select("*", nth).alias("r")
    hit = r.join(d, F.col("r.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("r.row_key") == F.col("d.row_key")) & (F.col("r.nth") == F.col("d.nth")))
    return hit.select(F.explode(F.array_repeat("r.row", F.col("d.copies"))).alias("row")).select("row.*")
