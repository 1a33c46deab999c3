"""Find many names in whole texts: one pass of an automaton over each text, or a join by grams where the names are too many."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions import text as T

#: Characters of the names that one automaton holds (some 100 MB in a Python worker).
BLOCK_CHARS = 2_000_000
#: Automata, that is passes over the texts, before names meet texts by a join.
BLOCKS = 8
GRAM = 4
WORD_CHARS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
#: The names whose automaton this worker has built last, and the automaton.
_BUILT: list[tuple[list[str], ahocorasick.Automaton]] = []


def _automaton(names: Broadcast) -> ahocorasick.Automaton:
    if not _BUILT or _BUILT[0][0] is not names.value:
        built = ahocorasick.Automaton()
        for name in names.value:
            built.add_word(name, name)
        built.make_automaton()
        _BUILT[:] = [(names.value, built)]
    return _BUILT[0][1]


def held_names(text: str, names: ahocorasick.Automaton, whole: bool) -> set[str]:
    """The names in a text; if ``whole`` only where no letter or digit of a-z, 0-9 stands beside."""
    if not whole:
        return {name for _, name in names.iter(text)}
    out: set[str] = set()
    for end, name in names.iter(text):
        start = end - len(name) + 1
        if name not in out and not (start > 0 and text[start - 1] in WORD_CHARS) and not (end + 1 < len(text) and text[end + 1] in WORD_CHARS):
            out.add(name)
    return out


def _by_automaton(texts: DataFrame, names: list[str], key: str, whole: bool) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast(names)
    kind = texts.schema[key].dataType

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(sent)
        for batch in batches:
            at, found = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                own = held_names(text, automaton, whole) if text else ()
                at += [k] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], [key, "name"])

    return texts.select(key, "text").mapInArrow(find, f"`{key}` {kind.simpleString()}, name string")


def _by_grams(texts: DataFrame, names: DataFrame, key: str, whole: bool) -> DataFrame:
    """Names meet the texts that hold their rarest gram (rare among the names); the pairs are then held against the texts."""
    long = F.least(F.lit(GRAM), F.char_length("name"))
    grams = names.select("name", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("name") - long + 1), lambda i: F.substring(F.col("name"), i, long)))).alias("gram"))
    often = grams.groupBy("gram").agg(F.count("*").alias("n"))
    rare = grams.join(often, "gram").groupBy("name").agg(F.min(F.struct("n", "gram")).alias("rarest")).select("name", F.col("rarest.gram").alias("gram"))

    def cut(n: int):
        count = F.char_length("text") - n + 1
        return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(F.col("text"), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    # a text's grams move without the text
    own = texts.select(key, F.explode(F.array_distinct(F.concat(*(cut(n) for n in range(1, GRAM + 1))))).alias("gram"))
    met = own.join(rare, "gram").select(key, "name").distinct()
    test = T.has_phrase(F.col("text"), F.col("name")) if whole else F.contains("text", F.col("name"))
    return met.join(texts.select(key, "text"), key).where(test).select(key, "name").distinct()


def names_in_texts(texts: DataFrame, names: DataFrame, key: str, whole: bool = False, block_chars: int = BLOCK_CHARS, blocks: int = BLOCKS) -> DataFrame:
    """(``key``, ``name``): the names (column ``name``) that stand in the texts (columns ``key``, ``text``), each once.

    Case counts: fold both before. ``whole`` asks for no a-z or 0-9 beside the name. Null and empty names and texts have no
    hits; texts that share a key are one. No text is moved. The names are sent to the tasks in blocks of about ``block_chars`` characters, each an
    automaton that reads every text once however many names it holds; above ``blocks`` of them names and texts meet in an
    equi-join on a gram instead, which sends nothing and has the same result.
    """
    own = names.select("name").where("name <> ''").distinct()
    size = own.agg(F.coalesce(F.sum(F.char_length("name")), F.lit(0))).first()[0]
    count = -(-size // block_chars)
    clean = texts.select(key, "text").where("text <> ''")
    if count > blocks:
        return _by_grams(clean, own, key, whole)
    held = ([r[0] for r in own.where(F.pmod(F.xxhash64("name"), F.lit(count)) == b).collect()] for b in range(count))
    parts = [_by_automaton(clean, block, key, whole) for block in held if block]
    return reduce(DataFrame.unionByName, parts).distinct() if parts else clean.select(key, F.col("text").alias("name")).limit(0)
