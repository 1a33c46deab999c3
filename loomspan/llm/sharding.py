"""Balanced contiguous shards from global prefix sums of byte sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.common import whole_text, written


def shards(docs: DataFrame, count: int = 16, id_col: str = "doc_id", text_col: str = "text", give: float = 0.05) -> DataFrame:
    """Deal every row of ``docs`` into ``count`` contiguous shards of near equal bytes (law ``bytes``), equal texts together.

    The rows are ordered by checksum, size and hash of the text, then id (null first), so equal texts follow each other. A range
    partitioning deals that order into partitions, whose totals (one row each) give the offset of each
    partition; a window inside the partition gives the rest. A group of equal texts of at most ``give``
    of a shard's equal share is never cut: it goes where its middle byte is. Larger groups, of which there are
    at most ``count / give``, are cut at the equal targets, row by row: a row whose middle byte is at ``p`` of
    ``total`` goes to shard ``p * count div total``. So each cut is at most half such a group, or half a row, from the
    equal share. Only four small columns are moved, never a text.

    Returns one row per input row: id, ``size`` (UTF-8 bytes plus 1; null text: 1), ``text_crc32``
    (null text: that of no bytes), ``law``, ``shard``, ``slot`` (from 0 in its shard, without gaps) and
    ``grown_shard`` (null under this law). Repeated rows count each; an empty table gives no rows; an
    empty shard occurs only with fewer rows than shards or a row above the equal share.
    """
    spark = docs.sparkSession
    text = whole_text(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("hash"),
    )
    rows = written(rows)
    group = ["text_crc32", "size", "hash"]
    every = rows.agg(F.sum("size").alias("total"))  # one row
    groups = rows.groupBy(*group).agg(F.count("*").alias("copies")).crossJoin(F.broadcast(every))
    # at most count / give of them
    large = groups.where(F.col("copies") * F.col("size") * count > F.lit(give) * F.col("total")).select(*group, F.lit(True).alias("large"))
    split = F.when(F.col("large"), F.struct(F.col("doc_id")))  # rows of a large group may lie in several partitions
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marked = rows.join(F.broadcast(large), group, "left").withColumn("split", split).drop("large")
    # Written once: the partition of a row must be the same in each use below.
    dealt = written(marked.repartitionByRange(parts, *group, "split").withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    totals = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy(*group, "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("part", *group)
    # totals: one row for each partition, whose count the driver holds anyway
    placed = dealt.select("*", F.coalesce(F.sum("size").over(inside), F.lit(0)).alias("bytes_here"), F.count("*").over(inside).alias("rows_here"))
    placed = placed.select("*", F.min("bytes_here").over(same).alias("group_here"), F.sum("size").over(same).alias("group_bytes")).join(F.broadcast(totals), "part")
    cut = F.col("split").isNotNull()
    start, length = F.when(cut, F.col("bytes_here")).otherwise(F.col("group_here")), F.when(cut, F.col("size")).otherwise(F.col("group_bytes"))
    placed = placed.select("doc_id", "size", "text_crc32", (F.col("rows_before") + F.col("rows_here")).alias("place"), (F.col("bytes_before") + start).alias("start"), length.alias("length"), "total")
    placed = placed.withColumn("shard", F.expr(f"cast((2 * start + length) * {count} div (2 * total) as int)"))
    starts = placed.groupBy("shard").agg(F.min("place").alias("first"))  # one row for each shard
    return placed.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("place") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
