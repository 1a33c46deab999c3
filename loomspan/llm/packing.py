"""Packing by power-of-two decomposition."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import running, written

#: Hash buckets of documents within which sequences are numbered by one window.
BUCKETS = 1024
#: Distinct words whose ids a worker remembers; beyond it, it keeps those of the texts at hand.
REMEMBERED = 400_000
#: Words that are encoded in one string.
LEARNT = 20_000
#: Texts are encoded together up to so many characters.
TOGETHER = 2 << 20


class Encoder:
    """Ids of whole texts by a byte-level BPE file of ``tokenizers``, with the ids of words remembered.

    Such a tokenizer starts a new word at every blank that stands alone, and a word's ids depend on nothing
    else. So a text without two blanks in a row is cut before each blank, and of the pieces only those
    not seen before are encoded, all in one string: as no other id begins with a blank, the ids that
    do tell the words apart again. Any other text is encoded whole, as is one that holds an added token of the
    file (its name in a text is that token, as the tokenizer reads it).
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, int] = {}  # behind a blank
        self.heads: dict[str, int] = {}  # at the start of a text
        self.flat = np.zeros(1 << 16, np.uint32)
        self.begin = np.zeros(1 << 14, np.int64)  # where each remembered piece begins in flat, and the last ends
        self.count = 0

    def whole(self, text: str) -> np.ndarray:
        # the batch call that leaves out offsets; the ids are those of encode()
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def keep(self, ids: np.ndarray, lengths: np.ndarray) -> range:
        """Remember consecutive pieces; their numbers."""
        first, end = self.count, int(self.begin[self.count])
        while end + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + len(lengths) + 1 > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
        self.flat[end : end + len(ids)] = ids
        self.begin[first + 1 : first + len(lengths) + 1] = end + np.cumsum(lengths)
        self.count += len(lengths)
        return range(first, self.count)

    def forget(self, kept: set[str]) -> None:
        """Remember ``kept`` only: the words of the texts at hand, among which the common ones are."""
        words = list(kept)
        old = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        begin, flat = self.begin, self.flat
        length = begin[old + 1] - begin[old]
        at = np.repeat(begin[old] - (np.cumsum(length) - length), length) + np.arange(length.sum())
        self.clear()
        self.words.update(zip(words, self.keep(flat[at], length)))

    def numbers(self, words: list[str]) -> np.ndarray:
        missing = [w for w in words if w not in self.words]
        if self.count + len(missing) > REMEMBERED:
            self.forget(set(words).difference(missing))
        for lo in range(0, len(missing), LEARNT):
            new = missing[lo : lo + LEARNT]
            ids = self.whole(" " + " ".join(new))
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) != len(new):
                raise ValueError("the tokenizer does not begin a word at each blank")
            self.words.update(zip(new, self.keep(ids, np.diff(np.append(starts, len(ids)))), strict=True))
        return np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))

    def together(self, texts: list[str]) -> list[np.ndarray]:
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        first = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        index = coded.indices.to_numpy()
        inner = np.ones(len(index), bool)
        inner[first] = False
        used = np.zeros(len(coded.dictionary), bool)
        used[index[inner]] = True
        spots = np.flatnonzero(used)
        table = np.zeros(len(used), np.int64)
        table[spots] = self.numbers(coded.dictionary.take(pa.array(spots)).to_numpy(zero_copy_only=False).tolist())
        number = table[index]
        for at, text in zip(first.tolist(), texts, strict=True):
            head = text.partition(" ")[0]
            if (known := self.heads.get(head)) is None:
                ids = self.whole(head) if head else np.zeros(0, np.uint32)
                known = self.heads[head] = self.keep(ids, np.array([len(ids)]))[0]
            number[at] = known
        start = self.begin[number]
        length = self.begin[number + 1] - start
        end = np.cumsum(length)
        ids = self.flat[np.repeat(start - (end - length), length) + np.arange(end[-1])]
        return np.split(ids, end[np.append(first[1:], len(number)) - 1][:-1])

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        some: list[str] = []
        size = 0
        for text in texts:
            if "  " in text or any(name in text for name in self.added):
                if some:
                    yield from self.together(some)
                yield self.whole(text)
                some, size = [], 0
                continue
            some.append(text)
            size += len(text)
            if size > TOGETHER:
                yield from self.together(some)
                some, size = [], 0
        if some:
            yield from self.together(some)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder: tasks that follow each other share what it remembers."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the parts of ``n``: as many of ``longest`` as fit, then one for each binary digit, long ones first."""
    out = [(k * longest, longest) for k in range(n // longest)]
    at, rest = n - n % longest, n % longest
    while rest:
        length = 1 << (rest.bit_length() - 1)
        out.append((at, length))
        at, rest = at + length, rest - length
    return out


def _cut(path: str, longest: int, end_id: int, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
        for batch in batches:
            rows: list[tuple] = []
            texts = (t.as_py() or "" for t in batch.column(1))
            for doc, ids in zip(batch.column(0).to_pylist(), own.encode(texts), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4", copy=False)
                raw = ids.tobytes()
                for start, length in pieces(len(ids), longest):
                    part = raw[4 * start : 4 * (start + length)]
                    rows.append((doc, start, length, zlib.crc32(part), len(ids), *([ids[start : start + length].tolist()] * with_ids)))
                if len(rows) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.int64()) if n == "ids" else pa.int64()) for c, n in zip(zip(*rows, strict=True), names, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.int64()) if n == "ids" else pa.int64()) for c, n in zip(zip(*rows, strict=True), names, strict=True)], names)

    return cut


def pack(docs: DataFrame, tokenizer_path: str, longest: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Cut each document's ids (with ``end_id`` at its end) into pieces of binary lengths, each a sequence of its own.

    A document of n ids gives ``n div longest`` pieces of ``longest`` ids and one piece for each binary digit of the
    rest. Pieces of equal length are bucketed: a bucket's sequences have consecutive numbers, long buckets
    first, so that batches of one length can be formed without padding, and no sequence crosses documents.
    Numbers come from prefix sums over hash buckets of documents, not from one global sort.

    Returns one row per piece: ``doc_id, start, length, ids_crc32`` (of the ids as little-endian unsigned
    32-bit numbers), ``doc_tokens, sequence_id, offset`` (always 0), and ``ids`` if asked for. A null or empty text
    has the end id only. Rows that repeat an id are documents of their own. An empty table gives no rows.
    """
    longest_bits = longest.bit_length() - 1
    if longest != 1 << longest_bits:
        raise ValueError("longest must be a power of two")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_cut(tokenizer_path, longest, end_id, with_ids), schema)
    rows = written(rows)
    keyed = rows.withColumn("one", F.lit(1).cast("long")).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int"))
    placed = running(keyed, ["length"], "bucket", ["doc_id", "start", "ids_crc32", "doc_tokens"], {"before": "one"})
    sizes = rows.groupBy("length").count()  # one row for each power of two
    sizes = sizes.alias("s").join(F.broadcast(sizes.alias("t")), F.col("t.length") > F.col("s.length"), "left").groupBy("s.length").agg(F.coalesce(F.sum("t.count"), F.lit(0)).alias("base"))
    out = placed.join(F.broadcast(sizes), "length")
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("before")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *(["ids"] * with_ids))
