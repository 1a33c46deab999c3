"""Group spelling variants: a positional q-gram index finds the words one edit apart, the frequent one is the form."""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import ascii_lower, whole_text, written

RUN = r"[A-Za-zÀ-ÿ]+"
#: One in so many occurrences loses a code point.
DAMAGED = 97
#: Grams have three code points; a word is padded by two at each end.
Q, LEFT, RIGHT = 3, "##", "$$"
#: Words of one length share all but so many grams with a word one edit away; a word shorter by one all but one less.
SLACK = Q
#: Positions are kept as one character, modulo the number of characters.
TOP = 0x110000
#: A cell of more words than this is divided by one more gram that they share.
CELL = 1024


def runs(docs: DataFrame) -> DataFrame:
    """``doc_id, run``: each maximal run of letters of a text, A-Z lower-cased. A null or empty text has none."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all(whole_text(), F.lit(RUN), F.lit(0))).alias("run"))
    return found.select("doc_id", ascii_lower(F.col("run")).alias("run"))


def damaged(found: DataFrame) -> DataFrame:
    """``run`` where one in ``DAMAGED`` has lost a code point, by the CRC-32 of ``doc_id:run``; a null doc_id counts as empty."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    at = (h % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return found.select(F.when(h % DAMAGED == 0, cut).otherwise(F.col("run")).alias("run"))


def vocabulary(found: DataFrame, shortest: int = 5, least: int = 3) -> DataFrame:
    """``word, n``: the distinct runs of at least ``shortest`` code points that occur ``least`` times. Counted before they are moved."""
    return found.where(F.char_length("run") >= shortest).groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _grams(words: DataFrame) -> DataFrame:
    """``word, n, grams``: the positional grams of a padded word, rarest first, as structs (df, gram, pos)."""
    padded = F.concat(F.lit(LEFT), F.col("word"), F.lit(RIGHT))
    each = words.select("word", "n", F.posexplode(F.transform(F.sequence(F.lit(1), F.char_length("word") + Q - 1), lambda i: F.substring(padded, i, F.lit(Q)))).alias("pos", "gram"))
    df = each.groupBy("gram").agg(F.count("*").alias("df"))
    return each.join(df, "gram").groupBy("word", "n").agg(F.sort_array(F.collect_list(F.struct("df", "gram", "pos"))).alias("grams"))


def _key(before: Column, size: Column, gram: Column, pos: Column) -> Column:
    return F.xxhash64(before, size, gram, pos)


def _entered(rows: DataFrame) -> DataFrame:
    """One gram more for each row ``word, n, grams, size, slack, cell, last, shift``: a row for each that can be the next one shared.

    ``size`` is the length of the longer words of the cell. A shorter word (its slack is one less) has a gram
    at the same position as the longer one, or one before it; behind the edit it stays one before.
    """
    size = F.char_length("word")
    # of the grams up to the next shared one at most ``slack`` are not shared
    upto = F.least(F.col("slack") + F.col("depth") + 1, F.size("grams"))
    nexts = F.when(upto > F.col("last") + 1, F.sequence(F.col("last") + 1, upto - 1))
    moved = rows.select("*", F.explode(nexts).alias("at")).withColumn("g", F.col("grams")[F.col("at")])
    moved = moved.withColumn("s", F.explode(F.when(size == F.col("size"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    held = F.col("last_pos").isNull() | F.when(F.col("g.pos") > F.col("last_pos"), F.col("s") >= F.col("shift")).otherwise(F.col("s") <= F.col("shift"))
    return moved.where(held).select(
        "word", "n", "size", "slack", (F.col("depth") + 1).alias("depth"), _key(F.col("cell"), F.col("size"), F.col("g.gram"), F.col("g.pos") + F.col("s")).alias("cell"),
        F.col("at").alias("last"), F.col("g.pos").alias("last_pos"), F.col("s").alias("shift"),
    )


def cells(words: DataFrame, most: int = CELL) -> DataFrame:
    """``cell, size, word, n``: words one edit apart share a cell at least, and no cell holds more than ``most`` words.

    Two words one edit apart, the longer of ``size`` code points, share at least size - 1 grams, at positions that
    differ by their lengths at most. So they share one of the ``SLACK`` + 1 rarest of the longer and of the ``SLACK`` rarest of
    the shorter: each is a cell. The words of a cell that is too large go to cells of two shared grams, then three, and so
    on. Words that share size - 1 grams differ in one code point, so such a cell holds few words per letter and the division ends.
    """
    grams = written(_grams(words))
    start = grams.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("less"))
    start = start.select(
        "word", "n", "grams", (F.char_length("word") + F.col("less")).alias("size"), (F.lit(SLACK) - F.col("less")).alias("slack"), F.lit(0).alias("depth"),
        F.lit(0).cast("long").alias("cell"), F.lit(-1).alias("last"), F.lit(None).cast("int").alias("last_pos"), F.lit(0).alias("shift"),
    )
    done = None
    while True:
        rows = written(_entered(start))
        counts = rows.groupBy("cell", "size").agg(F.count("*").alias("held"), F.max(F.char_length("word")).alias("longest")).where((F.col("held") > 1) & (F.col("longest") == F.col("size")))
        rows = written(rows.join(counts.drop("longest"), ["cell", "size"]))
        # as deep as it goes, a cell is as small as the alphabet
        ends = (F.col("held") <= most) | (F.col("depth") >= F.col("size") - 1)
        small, large = rows.where(ends).select("cell", "size", "word", "n"), rows.where(~ends)
        done = small if done is None else done.unionByName(small)
        if large.isEmpty():
            return done
        start = large.drop("held").join(grams.select("word", "grams"), "word")


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one code point inserted, deleted or replaced turns ``a`` into ``b``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def _holds(postings: list[int], k: int) -> bool:
    at = bisect_left(postings, k)
    return at < len(postings) and postings[at] == k


def near_pairs(members: list[str], size: int) -> Iterator[tuple[int, int]]:
    """Pairs of positions of words one edit apart, of which one at least has ``size`` code points and the other as many or one less.

    ``members`` come shorter ones first. An inverted index has for each gram with its position the words that hold it, in order; a shorter word is entered
    at the next position too. A word one edit away is met in size - 1 of a word's postings, so in one at least of the shortest that are left without size - 2 of
    them: these are merged by a heap, and a word met there is looked up in the longer ones as long as the bound can be reached, then verified.
    """
    index: dict[str, list[int]] = {}
    least = size - 1
    for k, word in enumerate(members):
        if len(word) < least:
            continue
        padded = f"{LEFT}{word}{RIGHT}"
        keys = [padded[p : p + Q] + chr(p % TOP) for p in range(len(word) + Q - 1)]
        if len(word) == size:
            lists = sorted((index[key] for key in keys if key in index), key=len)
            short = len(lists) - least + 1
            if short > 0:
                rest = lists[short:]
                for other, met in groupby(heapq.merge(*lists[:short])):
                    lack = least - sum(1 for _ in met)
                    for n, postings in enumerate(rest):
                        if lack <= 0 or lack > len(rest) - n:
                            break
                        lack -= _holds(postings, other)
                    if lack <= 0 and one_edit(members[other], word):
                        yield other, k
        else:
            keys += [padded[p : p + Q] + chr((p + 1) % TOP) for p in range(len(word) + Q - 1)]
        for key in keys:
            index.setdefault(key, []).append(k)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = ["a", "a_n", "b", "b_n"], [pa.string(), pa.int64(), pa.string(), pa.int64()]
    out: list[tuple] = []
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("cell", "size", "word", "n")), strict=True))
    for (_, size), own in groupby(rows, key=lambda r: r[:2]):
        held = {word: n for _, _, word, n in own}
        members = sorted(held, key=len)
        for i, j in near_pairs(members, size):
            a, b = sorted((members[i], members[j]))
            out.append((a, held[a], b, held[b]))
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def links(words: DataFrame, most: int = CELL) -> DataFrame:
    """``a, a_n, b, b_n``: each pair of words one edit apart once, ``a`` the smaller."""
    held = cells(words, most)
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = held.repartition(parts, "cell", "size").sortWithinPartitions("cell", "size")
    return dealt.mapInArrow(_found, "a string, a_n long, b string, b_n long").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``word, form`` (each word once, no circles): the end of the chain of forms, by doubling steps.

    A form has twice the count of its word, so a chain has at most 62 steps and 6 rounds reach its end.
    """
    at = written(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = written(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = after.drop("moved")
        if after.where("moved").isEmpty():
            return at


def variants(words: DataFrame, times: int = 2, most: int = CELL) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for a table ``word, n`` (each word once, of two code points at least).

    Two words are near if one code point inserted, deleted or replaced turns one into the other. A word's form is its near
    word of the largest n (ties: the smallest in code-point order) if that is at least ``times`` its own n, else null; ``root`` is the end
    of the chain of forms, the word itself without one. An empty table gives no rows; a word without near words has
    ``n_near`` 0. A word near a third of all others is counted before its rows are moved.
    """
    words = written(words.select("word", F.col("n").cast("long").alias("n")))
    pairs = written(links(words, most))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    is_form = -F.col("best.less") >= F.col("n") * times
    rows = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")
    )
    rows = written(rows)
    ends = roots(rows.where("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, shortest: int = 5, least: int = 3, times: int = 2) -> DataFrame:
    """:func:`variants` of the words of whole texts, as damaged by :func:`damaged`.

    Null and empty texts have no words, rows that repeat count each, and other columns aren't read.
    """
    return variants(vocabulary(damaged(runs(docs)), shortest, least), times)
