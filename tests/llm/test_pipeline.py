"""The pipeline's stages, each against a brute-force version on its own input."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from loomspan.llm import mixing, packing, quality
from tests.llm.test_operators import DOCS, WORD, fold, near_truth, prose, public_tokenizers


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    rows = []
    for k in range(240):
        text = prose(rng, rng.randrange(30, 200))
        if k % 6 == 0:
            text = " ".join(w + "$$$" for w in text.split())
        rows.append([k, text, "en", f"s{k % 4}", len(text), 1, 2])
    for k in range(240, 300):
        copy = list(rows[rng.randrange(1, 200)])
        words = copy[1].split()
        if k % 2:
            words[rng.randrange(len(words))] = "changed"
        rows.append([k, " ".join(words) if k % 3 else " ".join(words).upper(), "en", "s0", 1, 1, 2])
    rows += [[900, None, "en", None, None, None, None], [901, "", None, "s1", 0, 1, 2], list(rows[7])]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([tuple(r) for r in rows], DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 6 > 0)) for k in range(0, 240)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, rows = docs.columns, [tuple(r) for r in docs.collect()]
    stage = dict(corpus_pipeline.STAGES)
    again = lambda df: spark.createDataFrame(df.collect(), df.schema)

    good = again(stage["quality classifier"](spark, docs, folder))
    want = {r.doc_id for r in quality.classify(docs, spark.read.parquet(f"{folder}/labels.parquet")).where("predicted = 1").collect()}
    assert good.columns == columns and Counter(map(tuple, good.collect())) == Counter(r for r in rows if r[0] in want)
    kept = {r.doc_id for r in good.collect()}
    assert not any(k % 6 == 0 for k in kept if k < 240) and sum(k % 6 > 0 for k in kept if k < 240) >= 195

    unique = again(stage["exact dedup"](spark, good, folder))
    largest = defaultdict(list)
    for r in map(tuple, good.collect()):
        largest[fold(r[1])].append(r)
    assert unique.columns == columns and sorted(map(str, map(tuple, unique.collect()))) == sorted(str(max(g)) for g in largest.values())

    near = again(stage["MinHash near-dedup"](spark, unique, folder))
    before = [tuple(r) for r in unique.collect()]
    assert near.columns == columns and sorted(r.doc_id for r in near.collect()) == sorted(i for i, _, name in near_truth(before) if i == name)

    mix = again(stage["mixing to target weights"](spark, near, folder))
    copies = {r.doc_id: r.copies for r in mixing.mix(near).collect()}
    assert mix.columns == columns and Counter(r.doc_id for r in mix.collect()) == Counter({k: n for k, n in copies.items() if n})

    packed = stage["packing"](spark, mix, folder).collect()
    tokens = {r.doc_id: r.doc_tokens for r in packed}
    want = Counter((r.doc_id, *p) for r in mix.collect() for p in packing.pieces(tokens[r.doc_id], 1024))
    assert Counter((r.doc_id, r.start, r.length) for r in packed) == want


def brute_force(rows, keep):
    """run() by loops over all rows: the classifier's decisions are given, all else is done anew. (doc_id, start, length, ids_crc32, doc_tokens) of the pieces."""
    from tokenizers import Tokenizer

    texts = defaultdict(list)
    for r in rows:
        if r in keep:
            texts[fold(r[1])].append(r)
    unique = [max(g, key=lambda r: -1 if r[0] is None else r[0]) for g in texts.values()]
    near = [r for r, (i, _, name) in zip(unique, near_truth(unique)) if i == name]
    size = {r: len(WORD.findall(r[1] or "")) for r in near}
    source = defaultdict(list)
    for r in near:
        source[r[3]].append(r)
    total = {s: sum(size[r] for r in own) for s, own in source.items()}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(total, key=lambda s: (s is None, s)))}
    target, free, left = {}, set(total), 1.5 * sum(total.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * total[s]}
        for s in over or free:
            target[s] = 2.0 * total[s] if over else level * weight[s]
        if not over:
            break
        free, left = free - over, left - sum(2 * total[s] for s in over)
    own = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    out = Counter()
    for s, docs in source.items():
        ratio = target[s] / total[s] if total[s] else 0.0
        certain = int(ratio + 1e-12)
        rest, wanted, mean = max(ratio - certain, 0.0), max(target[s] - certain * total[s], 0.0), total[s] / len(docs)

        def odds(r):
            p = min(max(rest * (0.9 + 0.1 * (2.0 / (1.0 + size[r] / max(mean, 1.0)))), 1e-9), 1 - 1e-9)
            u = (int(hashlib.md5(f"7:{'null' if r[0] is None else r[0]}".encode()).hexdigest()[:12], 16) + 0.5) / 16**12
            return (u / (1 - u)) / (p / (1 - p))

        before = 0
        for r in sorted(docs, key=odds):
            copies = min(2, certain + (size[r] > 0 and wanted > 0 and before + size[r] / 2 <= wanted))
            before += size[r]
            ids = own.encode(r[1] or "", add_special_tokens=False).ids + [0]
            for start, length in packing.pieces(len(ids), 1024):
                out[r[0], start, length, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[start : start + length])), len(ids)] += copies
    return +out


def test_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    keep = {tuple(r) for r in quality.good_documents(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == brute_force([tuple(r) for r in docs.collect()], keep)
    assert got and sorted(r.sequence_id for r in got) == list(range(len(got))) and all(r.length & (r.length - 1) == 0 for r in got)
    assert len({n for n, _ in corpus_pipeline.STAGES}) == 5


def test_run_over_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
