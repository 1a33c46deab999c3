"""A quality classifier: boosted trees over statistics of whole documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.boosting import Trees, fit
from loomspan.llm.shingles import BATCH_BYTES, word_hashes

#: Labelled documents that a model is fitted on at most, those with the smallest hash of their id.
SAMPLE = 20_000
THRESHOLD = 0.7
NAMES = [
    "log_bytes", "log_words", "word_bytes", "bytes_a_char", "upper", "lower", "digit", "space", "newline", "stop", "comma", "bang", "bar", "mark", "bracket", "control",
    "distinct", "top_word", "same_as_before", "log_lines", "distinct_lines", "top_line", "entropy",
]


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


_CLASSES = np.stack([
    _mask(bytes(range(65, 91))), _mask(bytes(range(97, 123))), _mask(bytes(range(48, 58))), _mask(b" \t"), _mask(b"\n"), _mask(b".?"), _mask(b",;:"), _mask(b"!"),
    _mask(b"|"), _mask(b"*#$%&@~^=+_\\/"), _mask(b"()[]{}<>\"'`"), _mask(bytes(range(9)) + bytes(range(14, 32)) + b"\x7f"),
], 1)
_LATER = _mask(bytes(range(128, 192)))  # bytes that continue a character


def _spread(hashes: np.ndarray) -> tuple[float, float]:
    """Share of distinct values, and of the commonest one."""
    if not len(hashes):
        return 1.0, 0.0
    counts = np.unique(hashes, return_counts=True)[1]
    return len(counts) / len(hashes), counts.max() / len(hashes)


def features(texts: pa.Array) -> np.ndarray:
    """A row of statistics (``NAMES``) for each text, null as empty; every byte of a text counts."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    out = np.zeros((len(texts), len(NAMES)))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BATCH_BYTES, side="right")) - 1)
        part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        # a blank between texts keeps words and lines apart
        spaced = np.insert(part, at[1:], 10) if len(part) else np.full(hi - lo, 10, np.uint8)
        at = at + np.arange(hi - lo + 1)
        starts, words = word_hashes(spaced)
        word_at = np.searchsorted(starts, at)
        starts, lines = word_hashes(spaced, spaced == 10)
        line_at = np.searchsorted(starts, at)
        for k in range(hi - lo):
            raw = spaced[at[k] : at[k + 1] - 1]
            histogram = np.bincount(raw, minlength=256)
            n, own, rows = max(len(raw), 1), words[word_at[k] : word_at[k + 1]], lines[line_at[k] : line_at[k + 1]]
            share = histogram[histogram > 0] / n
            blank = histogram[32] + histogram[9:14].sum()
            out[lo + k] = [
                np.log1p(len(raw)), np.log1p(len(own)), (len(raw) - blank) / max(len(own), 1), len(raw) / max(len(raw) - histogram @ _LATER, 1), *(histogram @ _CLASSES / n),
                *_spread(own), float((own[1:] == own[:-1]).mean()) if len(own) > 1 else 0.0, np.log1p(len(rows)), *_spread(rows), float(-(share * np.log(share)).sum()),
            ]
        lo = hi
    return out


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn labels from: crc32 of the id as text leaves 2 modulo 4. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Fit on at most ``sample`` labelled documents that aren't held out.

    The sample is that of the smallest hashed ids, so it is the same in each run; it is small by its
    parameter, so it is broadcast to find its texts, and their statistics (not the texts) are gathered. Null labels and
    ids are left out; of several labels of one id the greatest counts. Without labels the model gives 0.5.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = known.select(F.col("doc_id").cast("long"), F.col("label").cast("int")).toArrow()
    picked = docs.sparkSession.createDataFrame(rows) if len(rows) else known.limit(0)
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "label", "text").mapInArrow(_statistics, "doc_id long, label int, x array<double>")
    found = found.groupBy("doc_id", "label").agg(F.max("x").alias("x")).toArrow()  # of rows that repeat an id one counts
    order = np.lexsort([np.array([np.sum(x) for x in found.column("x").to_pylist()]), found.column("doc_id").to_numpy()]) if len(found) else []
    x = np.array(found.column("x").to_pylist(), float).reshape(-1, len(NAMES))[order]
    return fit(x, found.column("label").to_numpy().astype(float)[order])


def _statistics(batches):
    for batch in batches:
        if len(batch):
            x = features(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["doc_id", "label", "x"])


def score(model: Trees) -> "callable":
    """A column function text -> probability of quality 1, over Arrow batches; rows stay where they are."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(model.predict(features(texts)))

    return scored


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Score every row: ``doc_id, held_out, score`` (0 to 1), ``predicted`` (1 if the score is ``threshold`` or more).

    Only the text is an input. Null and empty texts get the score of a text without bytes. Rows that repeat an id are scored each.
    """
    probability = score(train(docs, labels))(F.col("text"))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), probability.alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with a score of ``threshold`` or more, unchanged and unmoved."""
    return docs.where(score(train(docs, labels))(F.col("text")) >= threshold)
