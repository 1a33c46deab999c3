"""Near duplicates by SetSketch bands, joint likelihood and exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.common import written
from loomspan.llm.components import components
from loomspan.llm.setsketch import REGISTERS, likelier, sketches
from loomspan.llm.shingles import in_batches

#: 32 bands of 4 registers: a pair at similarity 0.75 shares none with a probability of 5e-6, and less above. That holds for
#: independent registers; those of tiny sets aren't (of pairs of 4 and 3 shingles 15 of 60,000 shared none), so
#: a pair with a set of at most ``TINY`` shingles meets by its common part, exactly.
ROWS = 4
BANDS = REGISTERS // ROWS
TINY = 8
#: Passes, at most, in which each bucket's members are held against one of them; what is then still open is compared by blocks.
PASSES = 4
#: Bands of the first pass.
FIRST = 8
#: Documents of a block; two blocks are compared in a task.
BLOCK = 512
#: Passes go on while a bucket has more blocks of members outside its largest component.
BLOCKS = 4
#: Members of open buckets that one call compares, about, and shingles of their sets; the members of two blocks of a bucket stay together.
CRATE, CRATE_SHINGLES = 1024, 1 << 22
#: Pairs of sketches that are compared at once.
PAIRS = 1 << 13
#: Pairs whose estimate lies under the threshold by this much (over 5 standard errors) are not verified.
SLACK = 0.2
#: Columns of the matrices whose product counts common shingles.
WIDTH = 8192


def _key(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _parts(own: np.ndarray, percent: int) -> list[dict]:
    """Of a set that may be similar to a tiny one, the digests of the parts that the two could have in common, and how many shingles are left out.

    A set of n and one of m shingles with c in common are similar if 100 * c >= percent * (n + m - c); so c >= percent * n / 100.
    """
    n = len(own)
    least = -(-percent * n // 100)
    if not 0 < percent * n <= 100 * TINY:
        return []
    return [{"part": _key(own[list(held)]), "extra": n - size} for size in range(least, n + 1) for held in combinations(range(n), size)]


def _sketched(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("part", pa.binary()), ("extra", pa.int32())]))
    for batch in batches:
        sets: list[np.ndarray] = []
        at = 0
        for own in in_batches(t.as_py() for t in batch.column(2)):
            sets.append(own)
            if len(sets) == 512 or at + len(sets) == len(batch) or sum(map(len, sets[-8:])) > 1 << 22:
                table = sketches(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k).slice(at, len(sets)) for k in (0, 1)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_key(s) for s in sets], pa.binary()),
                        pa.array([row.astype("<u2").tobytes() for row in table], pa.binary()),
                        pa.array([_parts(s, percent) for s in sets], kind),
                    ],
                    ["doc_id", "text_key", "n_shingles", "node", "sketch", "parts"],
                )
                at += len(sets)
                sets = []


def sketch_table(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, text_key, n_shingles, node, sketch, parts) of each row; equal shingle sets have the same ``node``, a 128-bit digest."""
    schema = "doc_id long, text_key string, n_shingles long, node binary, sketch binary, parts array<struct<part: binary, extra: int>>"
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit(""))).alias("text_key"), "text")
    return own.mapInArrow(lambda batches: _sketched(batches, percent), schema)


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of the texts whose digest is the wanted node; another text under the same id is left out."""
    for batch in batches:
        nodes = batch.column(0).to_pylist()
        found: list[tuple[bytes, bytes]] = []
        size = 0
        for k, s in enumerate(in_batches(t.as_py() for t in batch.column(1))):
            if _key(s) == nodes[k]:
                found.append((nodes[k], s.tobytes()))
                size += len(found[-1][1])
            if found and (size > 4 << 20 or k + 1 == len(nodes)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found, strict=True)], ["node", "shingles"])
                found, size = [], 0


def _registers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, REGISTERS)


def _estimated(x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sketches have an estimated similarity that isn't far under the threshold."""
    return likelier((x > y).sum(1), (x < y).sum(1), (x == y).sum(1), n_x, n_y, percent / 100 - SLACK)


def _near(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of the pairs (hub, node, sketch, n, hub_sketch, hub_n) those whose estimate is near enough."""
    for batch in batches:
        if len(batch):
            x, y = _registers(batch.column("sketch")), _registers(batch.column("hub_sketch"))
            good = _estimated(x, y, batch.column("n").to_numpy(), batch.column("hub_n").to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good)) for c in ("hub", "node")], ["hub", "node"])


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The links among the pairs (hub, node, shingles, hub_shingles), by their full sets."""
    for batch in batches:
        good = []
        for x, y in zip(batch.column("shingles"), batch.column("hub_shingles"), strict=True):
            own, other = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            common = np.intersect1d(own, other, assume_unique=True).size
            good.append(100 * common >= percent * (len(own) + len(other) - common))
        hit = pa.array(good, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(hit) for c in ("node", "hub")], ["a", "b"])


def _held(pairs: DataFrame, sketched: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): the links among ``pairs`` (hub, node), by sketches first, then by full sets.

    Each is a join of its own rows, so Spark can split a hub with many members; a set is held one pair at a time.
    """
    hubs = sketched.select(F.col("node").alias("hub"), F.col("sketch").alias("hub_sketch"), F.col("n").alias("hub_n"))
    sized = pairs.join(sketched.select("node", "sketch", "n"), "node").join(hubs, "hub").where(100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n"))
    near = sized.mapInArrow(lambda batches: _near(batches, percent), "hub binary, node binary")
    full = near.join(sets, "node").join(sets.select(F.col("node").alias("hub"), F.col("shingles").alias("hub_shingles")), "hub")
    return full.mapInArrow(lambda batches: _linked(batches, percent), "a binary, b binary")


def _buckets(table: pa.Table) -> Iterator[pa.Table]:
    """The rows of each bucket, one bucket after the other."""
    no, band = table.column("no").to_numpy(), table.column("band").to_numpy()
    order = np.lexsort((band, no))
    no, band, table = no[order], band[order], table.take(pa.array(order)).combine_chunks()
    edge = np.flatnonzero((no[1:] != no[:-1]) | (band[1:] != band[:-1])) + 1
    for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(order)], strict=True):
        yield table.slice(lo, hi - lo)


def _numbered(label: pa.ChunkedArray) -> np.ndarray:
    return label.combine_chunks().dictionary_encode().indices.to_numpy()


def _cross(percent: int):
    """Nodes of two blocks of a bucket that have a partner of another component whose estimate is near enough.

    Pairs inside one component are known; a pair that shares an earlier band belongs to that band's bucket.
    """

    def near(table: pa.Table) -> pa.Table:
        i, j, no = (table.column(c)[0].as_py() for c in ("i", "j", "no"))
        block, label = table.column("block").to_numpy(), _numbered(table.column("label"))
        registers, n = _registers(table.column("sketch")), table.column("n").to_numpy()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        keep = np.zeros(len(block), bool)
        step = max(1, PAIRS // max(1, len(right)))
        for lo in range(0, len(left), step):
            some = left[lo : lo + step]
            p, q = np.repeat(some, len(right)), np.tile(right, len(some))
            good = (label[p] != label[q]) & (np.minimum(n[p], n[q]) * 100 >= percent * np.maximum(n[p], n[q]))
            p, q = (x[good & (p < q) if i == j else good] for x in (p, q))
            if len(p):
                same = (registers[p] == registers[q]).reshape(len(p), BANDS, ROWS).all(2)
                p, q = (x[same.argmax(1) == no] for x in (p, q))
            if len(p):
                good = _estimated(registers[p], registers[q], n[p], n[q], percent)
                keep[p[good]] = keep[q[good]] = True
        return table.filter(pa.array(keep))

    def cross(table: pa.Table) -> pa.Table:
        return pa.concat_tables([near(t) for t in _buckets(table)]).drop(["crate", "sketch"])

    return cross


def _verified(percent: int):
    """A spanning forest of the links between different components among the rows of two blocks of a bucket."""

    def forest(table: pa.Table, shingles: list[pa.Scalar]) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        block, label = table.column("block").to_numpy(), _numbered(table.column("label"))
        sets = [np.frombuffer(shingles[k].as_buffer(), np.uint64) for k in table.column("row").to_pylist()]
        pairs = _similar(sets, percent) & (label[:, None] != label[None, :])
        pairs &= (block[:, None] == i) & (block[None, :] == j)
        pairs |= pairs.T
        root = np.arange(len(sets))
        while True:  # the least index that each can reach, so as many links leave as join the parts, not all pairs
            lower = np.minimum(root, np.where(pairs, root[None, :], len(root)).min(1))
            lower = np.minimum(lower, lower[lower])
            if (lower == root).all():
                break
            root = lower
        hit = np.flatnonzero(root != np.arange(len(root)))
        node = table.column("node")
        return pa.table({"a": node.take(pa.array(hit)), "b": node.take(pa.array(root[hit]))})

    def links(table: pa.Table) -> pa.Table:
        shingles = list(table.column("shingles"))
        rows = table.drop(["shingles"]).append_column("row", pa.array(range(len(table)), pa.int64()))
        return pa.concat_tables([forest(t, shingles) for t in _buckets(rows)])

    return links


def _similar(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of sets reach the similarity: a product of matrices counts their common shingles."""
    size = np.array([len(s) for s in sets], np.int64)
    flat, where = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, where = flat[order], where[order]
    column = np.cumsum(np.concatenate(([True], flat[1:] != flat[:-1]))) - 1
    shared = np.bincount(column)[column] > 1
    where, column = where[shared], column[shared]
    common = np.zeros((len(sets), len(sets)), np.int64)
    if len(column):
        column = np.cumsum(np.concatenate(([0], (column[1:] != column[:-1]).astype(np.int64))))
        for lo in range(0, int(column[-1]) + 1, WIDTH):
            left, right = np.searchsorted(column, [lo, lo + WIDTH])
            part = np.zeros((len(sets), WIDTH), np.float32)
            part[where[left:right], column[left:right] - lo] = 1
            common += (part @ part.T).astype(np.int64)
    return 100 * common >= percent * (size[:, None] + size[None, :] - common)


def tiny_links(nodes: DataFrame, percent: int = 75) -> DataFrame:
    """(a, b): links of all similar pairs with a tiny set, by equal digests of what they have in common.

    If the common part is the smaller set itself, the two meet at its digest. If each has one shingle more, all sets
    of one shingle more than the part are similar to each other, so they are linked to the least of them. No other
    pair of at most ``TINY`` shingles is similar. Both are joins with one row a key; no pairs are formed.
    """
    parts = nodes.where(F.size("parts") > 0).select("node", "n", F.explode("parts").alias("p")).select("node", "n", "p.part", "p.extra")
    # c common and one more each: 100 * c >= percent * (c + 2)
    one = (F.col("extra") == 1) & (100 * (F.col("n") - 1) >= percent * (F.col("n") + 1))
    met = parts.groupBy("part").agg(F.max(F.when(F.col("extra") == 0, F.col("node"))).alias("whole"), F.min(F.when(one, F.col("node"))).alias("least"), F.count("*").alias("c"))
    near = parts.where("extra > 0").join(met.where("c > 1"), "part")
    inside = F.when(F.col("whole").isNotNull(), F.struct(F.col("node").alias("a"), F.col("whole").alias("b")))
    beside = F.when(one & (F.col("least") != F.col("node")), F.struct(F.col("node").alias("a"), F.col("least").alias("b")))
    return near.select(F.explode(F.array(inside, beside)).alias("l")).where("l is not null").select("l.a", "l.b")


def _labelled(links: DataFrame) -> DataFrame:
    """(node, label): nodes of the same label are connected by ``links``; those of one component may still have several.

    The label is the least linked node, or the least one linked to that.
    """
    parent = links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("up")).groupBy("node").agg(F.min("up").alias("up"))
    # the few parents that have a parent: Spark broadcasts them if they are as few as they should be
    above = parent.select("up").distinct().join(parent.select(F.col("node").alias("up"), F.col("up").alias("top")), "up")
    return written(parent.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("label")))


def _nodes(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(table of rows, (node, component) of every node with a link): see :func:`near_duplicates`."""
    if percent < 75:
        raise ValueError("the bands are made for similarities of 75 % or more")
    table = written(sketch_table(docs, percent))
    nodes = table.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least_id"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n"), F.first("parts").alias("parts"))
    nodes = written(nodes)
    links = written(tiny_links(nodes, percent))
    rows = table.join(nodes.select("node", "least_id"), "node", "left")
    bucket = ["no", "band"]
    # a node alone in all its buckets has no candidate; a collision of these hashes only makes a node count as not lonely
    marked = _banded(nodes.select(F.xxhash64("node").alias("node"), "sketch"), 0, BANDS)
    alone = marked.groupBy(*bucket).agg(F.max("node").alias("mark"), F.count("*").alias("c")).where("c = 1")
    lonely = alone.groupBy("mark").agg(F.count("*").alias("c")).where(F.col("c") == BANDS)
    sketched = written(nodes.withColumn("mark", F.xxhash64("node")).join(lonely, "mark", "left_anti").select("node", "sketch", "n", "least_id"))

    # one row of documents for each node that has candidates, found by id and then by its digest
    wanted = sketched.select("node", F.col("least_id").alias("id")).alias("w")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").alias("d")
    texts = own.join(wanted, F.col("d.doc_id").eqNullSafe(F.col("w.id"))).select("node", "text")
    sets = texts.mapInArrow(_checked, "node binary, shingles binary")
    sets = written(sets.groupBy("node").agg(F.first("shingles").alias("shingles")))

    members = _banded(sketched, 0, FIRST)
    now = members.select(*bucket, "node", F.lit(0).alias("covered"), F.col("node").alias("label"))
    for k in range(PASSES):
        first = F.min(F.struct("covered", "node", "label")).alias("first")
        buckets = now.groupBy(*bucket).agg(first, F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select(*bucket, F.col("first.node").alias("hub"), F.col("first.label").alias("hub_label"))
        # a bucket's hub leaves it: all its pairs are dealt with in this pass
        pending = written(now.join(buckets, bucket).where("node <> hub"))
        pairs = pending.where("label <> hub_label").select("hub", "node").distinct()
        links = written(links.unionByName(_held(pairs, sketched, sets, percent)))
        labels = _labelled(links)
        hub = labels.select(F.col("node").alias("hub"), F.col("label").alias("new_hub_label"))
        pending = pending.drop("label").join(labels, "node", "left").join(hub, "hub", "left")
        mine = F.coalesce("label", "node") == F.coalesce("new_hub_label", "hub")
        now = pending.select(*bucket, "node", F.when(mine, 1).otherwise(F.col("covered")).alias("covered"), F.coalesce("label", "node").alias("label"))
        if k == 0:  # most copies are joined by now, so most of their buckets in the other bands are closed
            rest = _banded(sketched, FIRST, BANDS).join(labels, "node", "left")
            now = now.unionByName(rest.select(*bucket, "node", F.lit(0).alias("covered"), F.coalesce("label", "node").alias("label")))
            continue
        now = written(now)
        open_ = _open_buckets(now)
        widest, held = open_.agg(F.max("minors"), F.sum("all")).first()
        if widest is None:
            return rows, written(components(links))
        if widest <= BLOCKS:  # each block then meets few others
            break
    return rows, written(components(links.unionByName(_across(now.drop("covered"), open_, -(-held // CRATE), sketched, sets, percent))))


def _banded(nodes: DataFrame, first: int, end: int) -> DataFrame:
    """(no, band, node): the nodes' values of the bands from ``first`` on, before ``end``."""
    band = F.explode(F.array(*(F.struct(F.lit(b).alias("no"), F.xxhash64(F.substring("sketch", 2 * ROWS * b + 1, 2 * ROWS)).alias("band")) for b in range(first, end))))
    return nodes.select("node", band.alias("b")).select("b.no", "b.band", "node")


def _open_buckets(members: DataFrame) -> DataFrame:
    """Of each bucket with several labels the commonest one, the number of blocks of its members and of the others, and that of all rows."""
    counted = members.groupBy("no", "band", "label").agg(F.count("*").alias("c"))
    buckets = counted.groupBy("no", "band").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("all")).where("all > top.c")
    return written(buckets.select("no", "band", F.col("top.label").alias("major"), F.ceil(F.col("top.c") / BLOCK).cast("int").alias("majors"), F.ceil((F.col("all") - F.col("top.c")) / BLOCK).cast("int").alias("minors"), "all"))


def _across(members: DataFrame, buckets: DataFrame, crates: int, sketched: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different labels inside the open buckets of ``members`` (no, band, node, label): each pair in blocks, none left out.

    The members of a bucket's commonest label need not meet each other: they are dealt into blocks of their own,
    and those of the others meet all. Sketches are moved first, full sets only for nodes with a near enough partner.
    Buckets are dealt into ``crates``, as most have a few rows and a call for each costs more than its work.
    """
    major = F.col("label") == F.col("major")
    here = F.pmod(F.xxhash64("node"), F.when(major, F.col("majors")).otherwise(F.col("minors"))).cast("int")
    # blocks of the others are numbered first, those of the largest component behind them
    placed = members.join(buckets.drop("all"), ["no", "band"]).select("no", "band", "node", "label", "majors", "minors", major.alias("major"), (here + F.when(major, F.col("minors")).otherwise(0)).alias("block"))
    met = F.when(F.col("major"), F.sequence(F.lit(0), F.col("minors") - 1)).otherwise(F.sequence(F.lit(0), F.col("minors") + F.col("majors") - 1))
    dealt = placed.select("no", "band", "node", "label", "block", F.explode(met).alias("with"))
    dealt = dealt.select("no", "band", _crate(crates), F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "label", "node").join(sketched.select("node", "sketch", "n"), "node")
    key = ["crate", "i", "j"]
    near = written(dealt.groupBy(*key).applyInArrow(_cross(percent), "no int, band long, i int, j int, block int, label binary, node binary, n long"))
    rows, shingles = near.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    crates = max(1, -(-rows // CRATE), -(-shingles // CRATE_SHINGLES))
    return near.withColumn("crate", _crate(crates)).join(sets, "node").groupBy(*key).applyInArrow(_verified(percent), "a binary, b binary")


def _crate(crates: int) -> Column:
    return F.pmod(F.xxhash64("no", "band"), F.lit(crates)).alias("crate")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Components of documents that are linked by 100 * common >= ``percent`` (75 or more) * united distinct 5-word shingles.

    1. One pass gives every document a SetSketch of its shingle set; equal sets become one node.
    2. Pairs with a set of at most ``TINY`` shingles are linked by digests of their common part, exactly (:func:`tiny_links`).
    3. Nodes that share a band of registers meet in a bucket, first in ``FIRST`` bands, then in all. In a pass one member of a bucket is its hub, and
       all others of another component are held against it: those whose jointly estimated similarity is near the threshold
       are verified by their full sets. A large group of copies is so joined by about as many comparisons as it has members.
       Passes go on, ``PASSES`` at most, while a bucket has more than ``BLOCKS`` blocks of members outside its largest component.
    4. Pairs of a bucket that aren't in one component by then, nor compared, are compared in blocks (:func:`_across`); a
       pair that shares several bands only at the first of them.
    5. The components of the verified links; each is named by its least doc_id.

    Full shingle sets are moved for documents with a near enough candidate only. Returns one row per input row:
    ``doc_id, n_shingles, component_id, kept``. Texts are lower-cased for A-Z; a text of fewer than five words is one
    shingle; a text without words (or null) is a component of its own. A null doc_id is
    never a component's name unless all its documents have none. Rows that repeat an id get their own
    row each. An empty table gives no rows. Shingles are compared by 64-bit hashes, nodes by 128-bit ones.
    """
    table, found = _nodes(docs, percent)
    named = found.join(table.where("n_shingles > 0").select("node", "least_id").distinct(), "node")
    names = written(named.groupBy("component").agg(F.min("least_id").alias("name")))
    joined = written(found.join(names, "component").select("node", "name"))
    out = table.join(joined, "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("name", "least_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def without_near_copies(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component of :func:`near_duplicates`, with its own columns only.

    It is the row with the least doc_id; of rows that share it, the one with the least digest of its text, and of rows
    that share both, the first that the join brings together. Each row without words stays, but for rows with the same id and text.
    """
    table, found = _nodes(docs, 75)
    rows = table.join(found, "node", "left").select("doc_id", "text_key", F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")).alias("label"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("k")
    kept = rows.where("label is not null").groupBy("label").agg(best).select("k.doc_id", "k.text_key").unionByName(rows.where("label is null").select("doc_id", "text_key")).distinct()
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("__id"), F.md5(F.coalesce("text", F.lit(""))).alias("__key")).alias("o")
    hit = own.join(kept.alias("k"), F.col("o.__id").eqNullSafe(F.col("k.doc_id")) & (F.col("o.__key") == F.col("k.text_key"))).select("row", "__id", "__key")
    first = F.row_number().over(Window.partitionBy("__id", "__key").orderBy(F.lit(1)))
    return hit.withColumn("nth", first).where("nth = 1").select("row.*")
