"""Nearest neighbours by a block matrix join with int8 tiles and error bounds."""

from __future__ import annotations

import heapq
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.common import written

#: Vectors of a block of candidates and of queries, and numbers in it at most.
BLOCK, NUMBERS = 8192, 1 << 22
#: Queries and candidates whose products are held at once, and numbers of pairs that are recomputed at once.
STRIPE, TILE, SLICE = 256, 2048, 1 << 21


def _are_floats(vectors: DataFrame, vector_col: str) -> bool:
    return vectors.schema[vector_col].dataType.elementType.typeName() == "float"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v, dim) of the vectors that take part; of rows that repeat an id the greatest vector."""
    # float vectors travel as such; they are made double where they are multiplied
    v = F.col(vector_col).cast("array<float>" if _are_floats(vectors, vector_col) else "array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    return rows.where(fine).groupBy("vec_id").agg(F.max("v").alias("v")).withColumn("dim", F.size("v"))


def _quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whole numbers from -127 to 127, their scale, the norm of what they stand for and that of the error."""
    scale = np.abs(x).max(1) / 127
    scale = np.where(scale > 0, scale, 1.0)
    whole = np.rint(x / scale[:, None])
    stands = whole * scale[:, None]
    # int8 values; held as floats, in which sums of their products are exact, for the sake of the matrix product
    kind = np.float32 if x.shape[1] * 127 * 127 < 2**24 else np.float64
    return whole.astype(np.int8).astype(kind), scale, np.linalg.norm(stands, axis=1), np.linalg.norm(x - stands, axis=1)


def folded(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows in double precision, added from the first component to the last."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the ``k`` nearest of ``rows`` to each query, exactly; a row with the query's id isn't compared.

    The int8 product of a pair differs from the true one by no more than a bound from the norms of both errors. Where
    the upper bound of a pair lies under the k-th best score so far, or the k-th best lower bound of its tile, it is out; the others
    are computed in full, some at a time, and each tile's best are merged with the best so far by a heap.
    """
    whole = _quantised(rows)
    at = np.argsort(ids, kind="stable")  # so equal scores are met in the order of ids
    ids, rows, (b, sb, nb, eb) = ids[at], rows[at], tuple(x[at] for x in whole)
    out: list[tuple[int, int, float]] = []
    width = rows.shape[1]
    for lo in range(0, len(queries), STRIPE):
        x, own = queries[lo : lo + STRIPE], query_ids[lo : lo + STRIPE]
        a, sa, na, ea = _quantised(x)
        best: list[list[tuple[float, int]]] = [[] for _ in own]  # (-score, id), in order
        floor = np.full(len(own), -np.inf)
        for left in range(0, len(ids), TILE):
            part = slice(left, left + TILE)
            near = (a @ b[part].T).astype(np.float64) * sa[:, None] * sb[None, part]
            slack = (ea[:, None] * nb[part] + na[:, None] * eb[part] + ea[:, None] * eb[part]) * (1 + 1e-9) + 1e-12 * na[:, None] * nb[part]
            same = own[:, None] == ids[None, part]
            # bounds that overflow (vectors of numbers near 1e154 and above) tell nothing: such a pair is recomputed
            known = np.isfinite(near) & np.isfinite(slack)
            low = np.where(same | ~known, -np.inf, near - slack)
            least = np.maximum(floor, np.partition(low, -k, axis=1)[:, -k]) if low.shape[1] > k else floor
            q, c = np.nonzero(((near + slack >= least[:, None]) | ~known) & ~same)
            score = np.empty(len(q))
            for first in range(0, len(q), max(1, SLICE // width)):
                some = slice(first, first + max(1, SLICE // width))
                score[some] = folded(x[q[some]], rows[left + c[some]])
            score[np.isnan(score)] = -np.inf  # a sum of both infinities is below every number
            order = np.lexsort((c, -score, q))
            begin = np.searchsorted(q, np.arange(len(own) + 1))
            for row in range(len(own)):
                top = order[begin[row] : begin[row + 1]][:k]
                new = zip((-score[top]).tolist(), ids[left + c[top]].tolist())
                best[row] = list(islice(heapq.merge(best[row], new), k))
                if len(best[row]) == k:
                    floor[row] = -best[row][-1][0]
        out += [(int(own[row]), i, -s) for row, found in enumerate(best) for s, i in found]
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    query, found, scores = zip(*out, strict=True)
    return np.array(query, np.int64), np.array(found, np.int64), np.array(scores, float)


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, dim)


def nearest(vectors: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20) -> DataFrame:
    """The ``k`` nearest other vectors, by largest inner product, of each vector whose id is divisible by ``every``.

    Vectors are dealt by hash into blocks; each pair of a query block and a candidate block is a task,
    which returns at most ``k`` rows a query, and Spark merges them with bounded heaps on both sides of the shuffle. No
    pair is lost, so the result is exact (recall 1); a product that overflows both ways counts as minus infinity. A vector is copied once for each block of queries, of ``BLOCK`` vectors and
    ``NUMBERS`` numbers at most. A task holds its two blocks and the products of ``STRIPE`` by ``TILE`` pairs, however many scores are equal.

    Returns ``query_id, rank`` (from 1)``, vec_id, score``: nearest first, ties to the smaller id, all candidates if fewer than
    ``k``. Null, zero and non-finite vectors and null ids take no part; vectors are compared with those of
    the same dimension only; rows that repeat an id count once. An empty table gives no rows.
    """
    rows = written(usable(vectors, id_col, vector_col))
    query = F.col("vec_id") % every == 0
    # one row for each dimension that occurs
    block = F.greatest(F.least(F.lit(BLOCK), F.expr(f"{NUMBERS} div dim")), F.lit(1))
    sized = written(rows.groupBy("dim").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.ceil(F.count_if(query) / block).cast("int").alias("query_blocks")))
    placed = rows.join(sized, "dim").withColumn("h", F.xxhash64("vec_id"))
    candidates = placed.where("query_blocks > 0").select("dim", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("qb"), F.pmod("h", "blocks").cast("int").alias("cb"), F.lit(False).alias("query"), "vec_id", "v")
    queries = placed.where(query).select("dim", F.pmod("h", "query_blocks").cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("cb"), F.lit(True).alias("query"), "vec_id", "v")

    def compare(table: pa.Table) -> pa.Table:
        is_query = table.column("query").to_numpy()
        ids, v = table.column("vec_id").to_numpy(), _matrix(table.column("v"), table.column("dim")[0].as_py())
        if not is_query.any() or is_query.all():
            q, c, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        else:
            q, c, s = tile(ids[is_query], v[is_query], ids[~is_query], v[~is_query], k)
        return pa.table({"query_id": q, "vec_id": c, "score": s})

    best = candidates.unionByName(queries).groupBy("dim", "qb", "cb").applyInArrow(compare, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
