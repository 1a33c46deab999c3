"""Exact duplicates by content-defined chunk recipes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.common import ascii_lower, whole_text

#: Shortest and longest chunk in characters. A chunk ends behind the first place, after the shortest length, where
#: the text itself shows one of about 80 of the pairs of a letter, a blank and a letter; so a change moves few cuts.
SHORTEST, LONGEST = 384, 4096
CHUNK = rf"(?s).{{{SHORTEST},{LONGEST}}}?[dhnst] (?=[a-f])|(?s).{{1,{LONGEST}}}"


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_sha256, chunks, recipe) of each row; a recipe lists the chunks' 64-bit names in order."""
    text = ascii_lower(whole_text(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("norm"))
    rows = rows.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), F.regexp_extract_all("norm", F.lit(CHUNK), F.lit(0)).alias("chunks"))
    return rows.withColumn("recipe", F.transform("chunks", lambda c: F.xxhash64(c)))


def colliding(chunks: DataFrame) -> DataFrame:
    """Names (column ``name``) that more than one distinct chunk bears.

    ``chunks`` has ``name`` and ``chunk``. Equal chunks are merged before they are moved, so each distinct
    chunk crosses the network once for each task that saw it.
    """
    return chunks.groupBy("name", "chunk").agg(F.lit(1).alias("one")).groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group the rows of ``docs`` whose texts are equal after lower-casing A-Z; the largest id of a group stays.

    Texts are cut into content-defined chunks; a chunk's identifier is its 64-bit name, verified against
    the content: the distinct chunks of the whole corpus are brought together by name once, and a name
    that two different chunks bear (expected: none) makes its chunks count under their SHA-256 as well.
    From then on only ordered identifier lists are compared and moved, never a text. Groups are found by
    a pre-aggregation on the list, so a group of any size takes no task of its own.

    Returns one row per input row: ``doc_id, keep_id, group_size, kept, text_sha256, chunks`` (their
    number). Null text counts as empty; all empty texts are equal. Rows with the same id and text are
    copies too: just one of them is kept. A null id is smaller than any other. An empty table gives no rows.
    """
    rows = recipes(docs, id_col, text_col)
    parts = rows.select(F.explode(F.arrays_zip(F.col("recipe").alias("name"), F.col("chunks").alias("chunk"))).alias("c"))
    bad = colliding(parts.select("c.name", "c.chunk"))
    keyed = rows.select("doc_id", "text_sha256", F.col("recipe").alias("ids"), F.lit("").alias("also"))
    if bad.limit(1).count():
        # Names are only as good as their proof: lists with a name in doubt are told apart by the chunks' own digests.
        doubt = rows.select("text_sha256", "recipe", F.explode("recipe").alias("name")).join(bad, "name", "left_semi").select("text_sha256", "recipe").distinct()
        keyed = rows.join(doubt.withColumn("doubt", F.lit(True)), ["text_sha256", "recipe"], "left").select(
            "doc_id", "text_sha256", F.col("recipe").alias("ids"),
            F.when(F.col("doubt"), F.array_join(F.transform("chunks", lambda c: F.sha2(c, 256)), ",")).otherwise("").alias("also"),
        )
    lists = ["ids", "also"]
    same = keyed.groupBy("doc_id", "text_sha256", *lists).agg(F.count("*").alias("rows"))
    groups = same.groupBy(*lists).agg(F.max("doc_id").alias("keep_id"), F.sum("rows").alias("group_size"))
    joined = same.join(groups, lists)
    one = joined.select("doc_id", "keep_id", "group_size", "text_sha256", F.size("ids").alias("chunks"), F.posexplode(F.sequence(F.lit(1).cast("long"), "rows")).alias("copy", "n"))
    return one.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 0)).alias("kept"), "text_sha256", "chunks")


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_groups` keeps, with their own columns only.

    Rows that share id and text are put beside each other by the join itself, and the first stays.
    """
    kept = exact_groups(docs).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("__id"), F.sha2(ascii_lower(whole_text()), 256).alias("__sha")).alias("o")
    hit = own.join(kept.alias("k"), F.col("o.__id").eqNullSafe(F.col("k.__id")) & (F.col("o.__sha") == F.col("k.__sha"))).select("row", "o.__id", "o.__sha")
    first = F.row_number().over(Window.partitionBy("__id", "__sha").orderBy(F.lit(1)))
    return hit.withColumn("n", first).where("n = 1").select("row.*")
