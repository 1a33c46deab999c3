"""Each operator against a brute-force version, and its defined results for awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspan.llm import ann, chat, exact_dedup, license_scan, mixing, near_dedup, packing, quality, sharding, warc
from loomspan.llm.boosting import fit
from loomspan.llm.components import components
from loomspan.llm.setsketch import likelier, sketches
from loomspan.llm.shingles import in_batches

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def prose(rng, n):
    return " ".join(rng.choice("the of and to in water tree stone river light cloud green under over little house winter morning".split()) + rng.choice(["", "s", "ly", "ed", ","]) for _ in range(n))


def corpus():
    """Null and empty texts, long ones, copies, case variants, near copies, repeated rows, a hot source, a null id."""
    rng = random.Random(3)
    base = [prose(rng, n) for n in (3, 40, 300, 900, 5000)]
    near = [" ".join(w if rng.random() > 0.02 else "changed" for w in base[2].split()) for _ in range(30)]
    texts = [None, "", " \t\n", *base, *[b.upper() for b in base], *[base[1]] * 20, *near, "É", "é", "ONE two", "one TWO"]
    rows = [(k, t, "en", "hot" if k % 3 else f"s{k % 7}", len(t or ""), 1, 2) for k, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, base[3], "en", None, 5, 1, 2), (500, base[0], None, None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def fold(text):
    return (text or "").translate(FOLD)


def test_exact_groups(docs):
    rows = corpus()
    groups = defaultdict(list)
    for r in rows:
        groups[fold(r[1])].append(r[0])
    largest = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    got = exact_dedup.exact_groups(docs).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter((r[0], largest[fold(r[1])], len(groups[fold(r[1])]), hashlib.sha256(fold(r[1]).encode()).hexdigest()) for r in rows)
    assert Counter(r.text_sha256 for r in got if r.kept) == {hashlib.sha256(t.encode()).hexdigest(): 1 for t in groups}
    kept = exact_dedup.without_copies(docs)
    assert kept.columns == docs.columns and sorted(fold(r.text) for r in kept.collect()) == sorted(groups)


def test_chunks_are_whole_and_local(spark):
    rng = random.Random(5)
    text = prose(rng, 4000)
    cut = spark.createDataFrame([(1, text), (2, "new words here " + text)], "doc_id long, text string")
    a, b = (r.chunks for r in exact_dedup.recipes(cut).orderBy("doc_id").collect())
    assert "".join(a) == text and len(a) > 10 and len(set(a) & set(b)) >= len(a) - 3


def test_colliding_chunk_names_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: exact_dedup.F.lit(7).cast("long"))
    rows = [(1, "one"), (2, "two"), (3, "ONE")]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (3, 2), 2: (2, 1), 3: (3, 2)}


def near_truth(rows, percent=75):
    sets = []
    for r in rows:
        w = WORD.findall(fold(r[1]))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    names = defaultdict(list)
    for k, r in zip(label, rows):
        names[k].append(r[0])
    return [(r[0], len(s), min((i for i in names[k] if i is not None), default=None)) for r, s, k in zip(rows, sets, label)]


def test_near_duplicates(docs):
    want = near_truth(corpus())
    got = near_dedup.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(want)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = near_dedup.without_near_copies(docs)
    assert kept.columns == docs.columns
    words = {name for i, _, name in want}
    assert sorted(r.doc_id for r in kept.collect() if WORD.findall(r.text or "")) == sorted((i for i in {name for i, n, name in want if n}), key=lambda i: i)
    assert words


def test_rows_that_share_an_id_keep_their_own_fate(spark):
    rng = random.Random(8)
    a, b = prose(rng, 60), prose(rng, 70)
    rows = [(3, b, 1), (5, a, 2), (5, b, 3), (5, a, 4), (None, a, 5), (6, " ", 6), (6, " ", 7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, node int")
    kept = Counter((r.doc_id, r.text) for r in near_dedup.without_near_copies(frame).collect())
    assert kept == Counter([(3, b), (5, a), (6, " ")])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.without_near_copies(empty).count() == 0


def test_buckets_of_two_large_groups_and_strangers(spark, monkeypatch):
    """Groups that share bands but aren't linked, over several blocks and passes; every link is found."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "BLOCKS", 1)
    rng = random.Random(21)
    common = prose(rng, 60).split()
    bases = [common + prose(rng, 18).split() + [f"b{k}"] for k in range(6)]
    rows = []
    for k in range(240):
        words = list(bases[k % 6 if k % 3 else 0])
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            words[rng.randrange(len(words))] = f"w{rng.random()}"
        rows.append((k, " ".join(words)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == set(near_truth(rows))


def test_recall_of_known_pairs_near_the_threshold():
    """10,000 pairs at similarities from 0.75 to 0.8: all share a band, and the estimate puts none aside."""
    rng = np.random.default_rng(17)
    sets, pairs = [], 10_000
    for _ in range(pairs):
        n = int(rng.integers(12, 90))
        c = -(-6 * n // 7)  # c / (2 n - c) is 0.75 or little more
        x = rng.integers(0, 2**63, 2 * n - c, dtype=np.uint64)
        sets += [np.unique(x[:n]), np.unique(np.concatenate([x[:c], x[n:]]))]
    t = sketches(sets)
    a, b = t[0::2], t[1::2]
    n_a, n_b = (np.array([len(s) for s in sets[k::2]], float) for k in (0, 1))
    met = (a == b).reshape(pairs, -1, near_dedup.ROWS).all(2).any(1)
    good = near_dedup._estimated(a, b, n_a, n_b, 75)
    assert (met & good).sum() >= pairs - 1


def test_near_duplicates_of_a_large_group(spark):
    """Copies that are near a common base, but not all near each other, over several blocks."""
    rng = random.Random(9)
    base = prose(rng, 200).split()
    rows = []
    for k in range(400):
        words = list(base)
        for _ in range(rng.choice([1, 2, 4, 6, 8])):
            words[rng.randrange(len(words))] = f"w{rng.random()}"
        rows.append((k, " ".join(words)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == set(near_truth(rows))


def test_shingles_of_odd_texts():
    texts = ["", None, "a", "a b c d", "a b c d e", "A b\tc\x0bd\x0ce\rf", "a b c d e " * 9, "é ü\u00a0x y z w"]
    for text, own in zip(texts, in_batches(iter(texts))):
        w = WORD.findall(fold(text))
        assert len(own) == (len({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}) if w else 0)


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(2)
    x = np.unique(rng.integers(0, 2**63, 3000, dtype=np.uint64))
    a, b = x[:2000], x[500:2500]
    t = sketches([a, b, np.union1d(a, b), a[:0], a[:1]])
    assert (np.maximum(t[0], t[1]) == t[2]).all() and not t[3].any() and t[4].all()
    d = [np.array([(f(t[0], t[1])).sum()]) for f in (np.greater, np.less, np.equal)]
    n = np.array([2000.0])
    assert likelier(*d, n, n, 0.45)[0] and not likelier(*d, n, n, 0.8)[0]


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7)] + [(200, 200 + rng.randrange(1, 30)) for _ in range(60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[100] == got[101] == 100 and all(v == 200 for k, v in got.items() if k >= 200)


def test_mixing(spark, docs):
    got = mixing.mix(docs).collect()
    rows = corpus()
    sizes = Counter((r[0], len(WORD.findall(r[1] or ""))) for r in rows)
    assert Counter((r.doc_id, r.size) for r in got) == sizes
    per = defaultdict(int)
    for r in rows:
        per[r[3]] += len(WORD.findall(r[1] or ""))
    names = sorted(per, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    capped, total = set(), 1.5 * sum(per.values())
    while True:
        rest = total - sum(2 * per[s] for s in capped)
        free = [s for s in names if s not in capped]
        level = rest / sum(weight[s] for s in free) if free else 0
        above = {s for s in free if level * weight[s] > 2 * per[s]}
        if not above:
            break
        capped |= above
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == per[r.source] and r.target == pytest.approx(2 * per[r.source] if r.source in capped else level * weight[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        taken[r.source] += r.taken
    longest = max(s for _, s in sizes)
    for r in got:
        assert abs(taken[r.source] - r.target) <= longest / 2 + 1
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    out = mixing.mixed_rows(docs, mixing.mix(docs))
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in got for _ in range(r.copies))
    alike = spark.createDataFrame([(1, "one two three", "s")] * 40 + [(2, prose(random.Random(4), 90), "s"), (2, prose(random.Random(5), 90), "s"), (3, "z", None)], "doc_id long, text string, source string")
    mix = mixing.mix(alike)
    assert sum(len(r.text.split()) for r in mixing.mixed_rows(alike, mix).collect()) == sum(r.taken for r in mix.collect())


def check_shards(got, rows, count=16, give=0.05):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    total, at, slots, border = sum(r.size for r in got), 0, Counter(), Counter()
    copies = Counter((r.size, r.text_crc32) for r in got)
    held = defaultdict(set)
    for r in sorted(got, key=lambda r: (r.shard, r.slot)):
        assert r.slot == slots[r.shard]
        slots[r.shard] += 1
        border[r.shard] += r.size
        held[r.size, r.text_crc32].add(r.shard)
    largest = max([n * size for (size, _), n in copies.items() if n * size * count <= give * total] + [max(r.size for r in got)])
    ends = 0
    for shard in range(count - 1):  # each cut is at most half a row or an uncut group from its target
        ends += border[shard]
        assert abs(ends - total * (shard + 1) / count) <= largest / 2 + 1
    for (size, crc), n in copies.items():
        if n * size * count <= give * total:
            assert len(held[size, crc]) == 1


def test_sharding(spark, docs):
    check_shards(sharding.shards(docs, 16).collect(), corpus())
    rng = random.Random(12)
    base = [prose(rng, rng.randrange(2, 60)) for _ in range(2500)]
    rows = [(k, base[k] if k < 2500 else base[rng.randrange(600)] if k < 4000 else base[7]) for k in range(6000)]
    got = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 16).collect()
    check_shards(got, rows)
    assert len({r.shard for r in got}) == 16
    assert sum(len({r.shard for r in got if r.text_crc32 == zlib.crc32(t.encode())}) > 1 for t in base[:60]) <= 1  # the large group only


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    own = Tokenizer.from_file(path)
    want = Counter()
    odd = [(7000 + k, t) for k, t in enumerate(["<|endoftext|>", "a<|endoftext|>b c", "x <|endoftext|>  y", prose(random.Random(1), 30000)])]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    for r in [*corpus(), *odd]:
        ids = own.encode(r[1] or "", add_special_tokens=False).ids + [0]
        for start, length in packing.pieces(len(ids), 1024):
            want[r[0], start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()), len(ids)] += 1
    got = packing.pack(docs, path).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    assert sorted(r.sequence_id for r in got) == list(range(len(got))) and not any(r.offset for r in got)
    lengths = [r.length for r in sorted(got, key=lambda r: r.sequence_id)]
    assert lengths == sorted(lengths, reverse=True) and all(n & (n - 1) == 0 and n <= 1024 for n in lengths)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tab1'sé漢\u00a0\u0120.,|<endoftx>", max_size=40), max_size=6))
def test_encoding_equals_the_tokenizers(texts):
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    plain = Tokenizer.from_file(path)
    for text, ids in zip(texts, packing.encoder(path).encode(texts), strict=True):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids


@given(st.integers(0, 10**6))
def test_pieces_are_binary_and_whole(n):
    at = 0
    for start, length in packing.pieces(n, 1024):
        assert start == at and length & (length - 1) == 0
        at += length
    assert at == n


def test_trees_split_and_generalise():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = fit(x[:2000], y[:2000])
    assert ((model.predict(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    assert np.allclose(fit(x[:0], y[:0]).predict(x[:3]), 0.5)
    assert (fit(x, np.ones(3000)).predict(x) > 0.99).all()


def test_trees_against_a_walk_and_a_search():
    """Predictions by a node-by-node walk; the first split by trying every threshold of every feature."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3)).round(1)
    y = ((x[:, 0] > 0.3) | (x[:, 2] < -1)).astype(float)
    model = fit(x, y, trees=6, depth=3, bins=16)
    for row, p in zip(x, model.predict(x)):
        total = model.start
        for feature, threshold, leaf in zip(model.feature, model.threshold, model.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += leaf[node - len(feature)]
        assert p == pytest.approx(1 / (1 + np.exp(-total)))
    p = 1 / (1 + np.exp(-model.start))
    g, h = p - y, np.full(len(y), p * (1 - p))

    def gain(f, at):
        left = x[:, f] <= at
        if h[left].sum() < 4 or h[~left].sum() < 4:
            return 0.0
        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
        return part(left) + part(~left) - part(np.ones(len(y), bool))

    best = max(gain(f, at) for f in range(3) for at in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 17)[1:-1])))
    assert gain(model.feature[0, 0], model.threshold[0, 0]) == pytest.approx(best)


def test_quality(spark, docs, none):
    rng = random.Random(4)
    rows = [(k, prose(rng, 80) if k % 3 else " ".join(w + "$$$" for w in prose(rng, 80).split()), "en", "s", 1, 1, 1) for k in range(900)]
    good, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(900)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = quality.classify(good, labels).collect()
    out = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got) and len(out) > 150
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in out) >= 0.98 * len(out)
    flipped = labels.withColumn("quality", quality.F.when(quality.held_out(quality.F.col("doc_id")), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    assert [r.score for r in quality.classify(good, flipped).orderBy("doc_id").collect()] == [r.score for r in sorted(got, key=lambda r: r.doc_id)]
    odd = quality.classify(docs, labels).collect()
    assert len(odd) == len(corpus()) and all(0 <= r.score <= 1 for r in odd)
    assert len({r.score for r in odd if r.doc_id in (0, 1)}) == 1
    assert all(r.score == 0.5 for r in quality.classify(docs, labels.limit(0)).collect())
    kept = quality.good_documents(good, labels)
    assert kept.columns == good.columns and all(r.doc_id % 3 for r in kept.collect())


def test_features_do_not_depend_on_the_batch():
    texts = [r[1] for r in corpus()]
    together = quality.features(pa.array(texts, pa.string()))
    alone = np.concatenate([quality.features(pa.array([t], pa.string())) for t in texts])
    assert np.array_equal(together, alone) and np.array_equal(together[5:9], quality.features(pa.array(texts, pa.string()).slice(5, 4)))


def test_nearest(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 24)).astype(np.float32)
    x[50:90] = x[40]
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    rows += [(1000, None, 1), (1020, [0.0] * 24, 1), (1040, [float("nan")] * 24, 1), (1060, [1.0, None] * 12, 1), (1080, [float("inf")] * 24, 1), (None, x[0].tolist(), 1), (2000, [1.0, 2.0], 1), (2001, [3.0, 4.0], 1), (40, x[40].tolist(), 1)]
    got = defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    x = x.astype(float)
    want = {}
    for q in range(0, 300, 20):
        s = ann.folded(np.repeat(x[q : q + 1], 300, 0), x)
        order = [i for i in np.lexsort((np.arange(300), -s)) if i != q][:20]
        want[q] = [(k + 1, int(i), s[i]) for k, i in enumerate(order)]
    want[2000] = [(1, 2001, 11.0)]
    assert got == want


def test_equal_scores_stay_small():
    """20,000 equal vectors: ties go to the smaller ids, and what a tile holds is bounded."""
    import tracemalloc

    x = np.ones((20_000, 32), np.float64)
    tracemalloc.start()
    q, c, s = ann.tile(np.arange(0, 20_000, 40), x[::40], np.arange(20_000)[::-1], x, 5)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200 << 20
    assert c[q == 40].tolist() == [0, 1, 2, 3, 4] and c[q == 0].tolist() == [1, 2, 3, 4, 5] and (s == 32).all()


def test_tiles_keep_the_bound():
    rng = np.random.default_rng(8)
    q, x = rng.normal(size=(9, 40)) * np.exp(rng.normal(size=(9, 1)) * 4), rng.normal(size=(800, 40))
    a, b, s = ann.tile(np.arange(9), q, np.arange(5, 805), x, 7)
    for k in range(9):
        full = ann.folded(np.repeat(q[k : k + 1], 800, 0), x)
        full[np.arange(5, 805) == k] = -np.inf
        assert b[a == k].tolist() == (np.lexsort((np.arange(800), -full))[:7] + 5).tolist()


def all_repairs(roles):
    """Least cost by trying all sequences of moves."""
    best = {chat.START: 0}
    for r in roles:
        new = {}
        for state, cost in best.items():
            for price, to, _ in chat.MOVES[r][state]:
                new[to] = min(new.get(to, 10**9), cost + price)
        best = new
    return min(c + chat.end_cost(s) for s, c in best.items())


@settings(max_examples=200)
@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 12), max_size=3))
def test_repairs_are_legal_and_least(roles, cuts):
    done = chat.repair(roles)
    assert done.cost == all_repairs(roles)
    state = chat.START
    for role, what in done.moves:
        if what == "merge":
            assert role == state
        else:
            if what != "append":
                middle = int(what.split()[1])
                assert middle in chat.NEXT[state]
                state = middle
            assert role in chat.NEXT[state]
        state = role
    bounds = sorted({0, len(roles), *(c for c in cuts if c <= len(roles))})
    whole = np.where(np.eye(4, dtype=bool), 0, chat.FAR)
    for lo, hi in zip(bounds, bounds[1:]):
        whole = chat.joined(whole, chat.transfer(roles[lo:hi]))
    assert min(whole[chat.START][s] + chat.end_cost(s) for s in range(4)) == done.cost


def test_long_conversations_in_parts_are_those_in_one(spark):
    rng = random.Random(16)
    rows = [(c, t // 3 if c else 1, rng.choice(["user", "assistant", "system", "x"]), f"{c} {t}", 1) for c in range(3) for t in range(200)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment int").repartition(5)
    whole = {r.conv_id: r for r in chat.format_chats(turns).collect()}
    parts = defaultdict(list)
    for r in chat.format_chats(turns, 16).orderBy("conv_id", "part").collect():
        parts[r.conv_id].append(r)
    for c in range(3):
        assert [r.part for r in parts[c]] == list(range(13)) and sum(r.cost for r in parts[c]) == whole[c].cost
        said = lambda x: re.findall(r"\d+ \d+", x)
        assert said("".join(r.text for r in parts[c])) == said(whole[c].text)


def test_chats(spark):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "Human ", None, "tool"]), rng.choice(["x", None, "", "<|user|> y"])) for c in range(30) for t in range(rng.randrange(1, 9))]
    rows += [(99, t, "user" if t % 2 else "assistant", "z") for t in range(300)] + [(None, 1, "user", "a"), (None, 2, "user", "b"), (98, None, "user", "q"), (98, None, "user", "q"), (98, 1, "assistant", "w")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    whole = {(r.conv_id, r.part): r for r in chat.format_chats(turns.where("conv_id is not null")).collect()}
    parts = defaultdict(list)
    for r in chat.format_chats(turns.where("conv_id is not null"), 2).orderBy("conv_id", "part").collect():
        parts[r.conv_id].append(r)
    assert len(parts[99]) == 150
    for conv, own in parts.items():
        first = whole[conv, 0]
        assert sum(r.cost for r in own) == (first.cost if conv != 98 else sum(r.cost for r in own))
        assert sum(r.turns_in for r in own) == sum(x[0] == conv for x in rows)
        tags = re.findall(r"<\|(\w+)\|>", "".join(r.text for r in own))
        roles = tags[0::2]
        assert all(t == "end" for t in tags[1::2]) and roles[-1] == "assistant" and len(roles) == sum(r.turns_out for r in own)
        assert all(chat.ROLES.index(b) + 1 in chat.NEXT[chat.ROLES.index(a) + 1] for a, b in zip(roles, roles[1:]))
    assert chat.format_chats(turns).where("conv_id is null").count() == 2
    lone = spark.createDataFrame([(None, 1, "user", "a")] * 3 + [(7, 1, "user", "b")] * 3 + [(8, 5, "user", f"t{k}") for k in range(50)] + [(9, None, "bot", str(k)) for k in range(40)], "conv_id long, turn long, role string, text string")
    got = chat.format_chats(lone, 4).collect()
    assert Counter((r.conv_id, r.turns_in, r.relabels) for r in got if r.conv_id is None) == {(None, 1, 0): 3}
    assert max(r.turns_in for r in got) == 4 and Counter({c: sum(r.turns_in for r in got if r.conv_id == c) for c in (None, 7, 8, 9)}) == {None: 3, 7: 3, 8: 50, 9: 40}
    whole = {r.conv_id: r for r in chat.format_chats(lone.where("conv_id > 7")).collect()}
    assert all(sum(r.cost for r in got if r.conv_id == c) == whole[c].cost for c in (8, 9))


def test_licences(spark, docs):
    rng = random.Random(2)
    rows = []
    for k, (name, notice) in enumerate(license_scan.TEMPLATES.items()):
        words = notice.split()
        rows.append((2 * k, prose(rng, 50) + " " + notice.upper() + " " + prose(rng, 700)))
        rows.append((2 * k + 1, prose(rng, 90) + " " + " ".join(words[: len(words) // 2])))
    rows += [(900, None), (901, ""), (902, "license"), (903, prose(rng, 9000))]
    got = {(r.doc_id, r.license): r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {}
    for i, text in rows:
        w = re.findall("[a-z0-9]+", (text or "").lower())
        s = [" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))]
        for name, notice in license_scan.TEMPLATES.items():
            own = license_scan.template_shingles(notice)
            length, stride = license_scan.window(len(own))
            best = max((len(set(s[k : k + length]) & set(own)) / len(own), -k) for k in range(0, len(s), stride))
            if best[0] >= 0.75:
                want[i, name] = (best[0], -best[1])
    assert {k: (r.containment, r.first_word) for k, r in got.items()} == want and len(want) >= len(license_scan.TEMPLATES)
    assert license_scan.scan(docs).count() == 0 and license_scan.scan(docs, {}).count() == 0
    short = spark.createDataFrame([(1, "released under the mit license ok"), (2, "MIT License"), (3, "mit licensee"), (4, "x" * 300 + " mit " + "y" * 90), (2, "MIT License")], "doc_id long, text string")
    got = license_scan.scan(short, {"MIT": "MIT License", "own": "the mit license ok"}).collect()
    assert Counter((r.doc_id, r.license, r.first_word, r.windows) for r in got) == {(1, "MIT", 3, 1): 1, (1, "own", 2, 1): 1, (2, "MIT", 0, 1): 2}


def test_long_words_of_templates_are_found(spark):
    word = "x" * 70
    templates = {"long": f"this {word} notice has a very long word in it", "short": "a plain notice"}
    docs = spark.createDataFrame([(1, f"before {templates['long']} behind"), (2, f"{word} {'y' * 900} a plain notice")], "doc_id long, text string")
    assert sorted((r.doc_id, r.license, r.containment) for r in license_scan.scan(docs, templates).collect()) == [(1, "long", 1.0), (2, "short", 1.0)]


def test_products_that_overflow_lose_no_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 4))
    x[::2] *= 1e153
    x[1::6] *= 1e160
    found = ann.nearest(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>"), 10).collect()
    for q in (0, 20, 40):
        own = {r.vec_id: r.score for r in found if r.query_id == q}
        full = {k: float(np.nan_to_num(ann.folded(x[q : q + 1], x[k : k + 1])[0], nan=-np.inf, posinf=np.inf, neginf=-np.inf)) for k in range(60) if k != q}
        assert own == dict(sorted(full.items(), key=lambda y: (-y[1], y[0]))[:10])


def test_licences_in_long_texts(spark, monkeypatch):
    """Pieces much shorter than the text, words longer than any of a template: the same windows as in one piece."""
    rng = random.Random(22)
    notices = list(license_scan.TEMPLATES.values())
    rows = []
    for k in range(6):
        words = []
        for _ in range(12):
            words += [rng.choice(["a", "lo" * 200, "the", "license"]) for _ in range(rng.randrange(400))] + notices[rng.randrange(len(notices))].split()
        rows.append((k, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(license_scan, "PIECE", 1 << 30)
    want = sorted(map(tuple, license_scan.scan(frame).collect()))
    monkeypatch.setattr(license_scan, "PIECE", 64)
    assert len(want) > 20 and sorted(map(tuple, license_scan.scan(frame).collect())) == want

@settings(max_examples=100)
@given(st.lists(st.tuples(st.text(max_size=20), st.binary(max_size=200)), max_size=5), st.sampled_from([1, 2]))
def test_arc_round_trip(pages, version):
    data = warc.arc_header(version) + b"".join(warc.arc_record(version, url, body) for url, body in pages)
    got = list(warc.parse_arc(data))
    assert [r.body for r in got] == [body for _, body in pages] and all(r.status == (200 if version == 2 else None) for r in got)
    archive = b"".join(warc.warc_record(r, k, None) + warc.TAIL for k, r in enumerate(got))
    assert [block for _, block in warc.parse_warc(archive)] == [body for _, body in pages]


@pytest.mark.parametrize("data", [b"x\n", warc.arc_header(1) + b"u i 2000 t 99\nab\n", warc.arc_header(1) + b"u i 2000 9\n", warc.arc_header(2).replace(b"2 0 ", b"7 0 ")])
def test_damaged_archives_are_refused(data):
    with pytest.raises(ValueError):
        list(warc.parse_arc(data))


def test_archives(spark):
    same, rng = "<p>" + "x" * 200, random.Random(1)
    rows = [(k, f"http://h/{k} ä", rng.choice([same, "short", None, "", f"é{k}" * 99, "a\r\n\r\nWARC/1.1\r\nb"]), 1) for k in range(60)] + [(None, None, same, 1), (70, None, same, 1), (70, None, same, 1)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(4)).collect()
    first = defaultdict(lambda: 10**9)
    for i, _, html, _ in rows:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(first[html], i)
    want = Counter()
    for i, _, html, _ in rows:
        body = (html or "").encode()
        again = i is not None and len(body) >= 100 and first[html] != i
        want[i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first[html] if again else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert all(re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", r.date) for r in got) and len({r.record_id for r in got}) == 62


def test_tiny_sets_that_share_no_band_are_linked(spark):
    from loomspan.llm.shingles import in_batches as shingled

    found = ["659297 936330 275050 634473 906150 54012 542934 846298", "48568 252069 396206 48480 688854 399269 35560 268818", "862541 823150 301554 103569 883232 936511 900893 89972", "524378 832358 67065 38412 63951 289400 623128 632537"]
    longer = [" ".join(f"w{w}" for w in x.split()) for x in found]
    texts = [*longer, *(x.rpartition(" ")[0] for x in longer)]
    tables = sketches(list(shingled(iter(texts))))
    assert not (tables[:4] == tables[4:]).reshape(4, -1, 4).all(2).any()
    rng = random.Random(4)
    for n in range(3, 13):  # a random set of words, without its last or first
        words = [f"v{rng.randrange(10**6)}" for _ in range(n + 4)]
        texts += [" ".join(words), " ".join(words[:-1]), " ".join(words[1:])]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[k + 4] for k in range(4)] == [0, 1, 2, 3]
    assert all(got[k] == got[k + 1] == got[k + 2] for k in range(11, len(texts), 3)) and len({got[8], got[9], got[10]}) == 3


def test_long_urls_and_gzip_members(spark, tmp_path):
    import gzip

    urls = ["http://h/" + "a" * 3000 + end for end in "xy"]
    got = warc.round_trip(spark.createDataFrame([(k, u, "<p>") for k, u in enumerate(urls)], "page_id long, url string, html string")).collect()
    assert {r.page_id: r.url for r in got} == dict(enumerate(urls))
    records = [warc.warc_record(r, k, None) + warc.TAIL for k, r in enumerate(warc.parse_arc(warc.arc_header(1) + b"".join(warc.arc_record(1, u, b"body") for u in urls)))]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    assert {r.page_id: r.url for r in warc.read_archives(spark, str(tmp_path)).collect()} == dict(enumerate(urls))


def test_archive_files_are_bounded_by_bytes(spark, monkeypatch, tmp_path):
    import gzip

    files = warc._Files(1000)
    made = [f for n in (300, 300, 300, 5000, 10) for f in files.add(bytes(n))] + list(files.end())
    assert len(made) == 3
    pages = spark.createDataFrame([(k, f"http://h/{k}", f"{k}" + "é" * 700_000) for k in range(60)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "out"))
    found = [f for f in (tmp_path / "out").glob("part-*")]
    sizes = [len(gzip.decompress(f.read_bytes())) for f in found]
    assert len(found) >= 2 and max(sizes) <= warc.FILE_BYTES + (1 << 16)
    heads = [h for f in found for h, _ in warc.parse_warc(gzip.decompress(f.read_bytes()))]
    assert sum(h["warc-type"] == "warcinfo" for h in heads) == len(found) and sum(h["warc-type"] == "response" for h in heads) == 60


def test_arc_files_are_converted(spark, tmp_path):
    import gzip

    head = warc.http_head({"Content-Type": "text/html"})
    one = warc.arc_header(1) + b"".join(warc.arc_record(1, f"http://h/{k}", head + b"x" * k) for k in range(5)) + warc.arc_record(1, "dns:h", b"1.2.3.4")
    two = warc.arc_header(2) + b"".join(warc.arc_record(2, f"http://g/{k}", head + b"HTTP/y" * k) for k in range(4))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.arc").write_bytes(one)
    (tmp_path / "in" / "b.arc.gz").write_bytes(gzip.compress(two))
    warc.convert_archives(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    got = warc.read_archives(spark, str(tmp_path / "out")).collect()
    want = [(f"http://h/{k}", "response", b"x" * k) for k in range(5)] + [("dns:h", "resource", b"1.2.3.4")] + [(f"http://g/{k}", "response", b"HTTP/y" * k) for k in range(4)]
    assert Counter((r.url, r.record_type, r.payload_digest) for r in got) == Counter((u, t, hashlib.sha256(p).hexdigest()) for u, t, p in want)
    assert len({r.record_id for r in got}) == 10 and all(r.date == "2000-01-01T00:00:00Z" for r in got)


def test_empty_tables(spark, none):
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for frame in (exact_dedup.exact_groups(none), near_dedup.near_duplicates(none), mixing.mix(none), sharding.shards(none), packing.pack(none, path), quality.classify(none, labels), license_scan.scan(none)):
        assert frame.count() == 0
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
