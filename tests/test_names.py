"""Names in texts against plain searches, older sources and candidates against loops over all pairs."""

import datetime
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from loomspan.operators import corpus, evidence, insight, labels
from loomspan.operators.names import names_in_texts

LETTERS = "ab c1é.-"


def sample(seed):
    rng = random.Random(seed)
    names = {"".join(rng.choice(LETTERS) for _ in range(rng.randrange(1, 9))) for _ in range(150)} | {"c++", "\\e", "a"}
    texts = [(k, "".join(rng.choice(LETTERS) for _ in range(rng.randrange(0, 120)))) for k in range(60)]
    return [*texts, (60, None), (61, ""), (3, "c++ \\e"), texts[0]], sorted(names)


@pytest.mark.parametrize(("chars", "blocks"), [(1 << 20, 8), (100, 100), (10, 0)])
@pytest.mark.parametrize("whole", [False, True])
def test_names_by_automaton_in_blocks_and_by_grams(spark, chars, blocks, whole):
    texts, names = sample(3)
    side = "[a-z0-9]" if whole else "(?!)"
    expected = {(k, n) for k, t in texts for n in names if re.search(f"(?<!{side}){re.escape(n)}(?!{side})" if whole else re.escape(n), t or "")}
    rows = spark.createDataFrame([(k, t, "other") for k, t in texts], "doc_id long, text string, name string").repartition(3)
    table = spark.createDataFrame([(n,) for n in [*names, names[0], "", None]], "name string")
    found = names_in_texts(rows, table, "doc_id", whole, chars, blocks).collect()
    assert len(found) == len(set(found))
    assert {tuple(r) for r in found} == expected
    assert names_in_texts(rows, table.limit(0), "doc_id", whole, chars, blocks).collect() == []
    assert names_in_texts(rows.limit(0), table, "doc_id", whole, chars, blocks).collect() == []


def test_aliases_in_any_case_and_awkward_ones(spark):
    docs = spark.createDataFrame([(1, "Use C++ now"), (2, "the R-tree"), (3, "art"), (4, None), (1, "also a Tree")], "doc_id long, text string")
    aliases = spark.createDataFrame([("cpp", "c++"), ("r", "R"), ("art", "ART"), ("none", ""), ("null", None), ("tree", "a tree"), ("tree", "r-TREE")], "node_id string, alias string")
    assert {tuple(r) for r in corpus.assign_by_phrase(docs, aliases).collect()} == {(1, "cpp"), (2, "r"), (3, "art"), (2, "tree"), (1, "tree")}


DAY = datetime.date(2000, 1, 1)


def entities(seed=1, n=40):
    rng = random.Random(seed)
    words = ["graph", "river", "deep", "forest", "stance", "topic", "vector", "causal"]
    rows, texts = [], []
    for k in range(n):
        name = " ".join(rng.sample(words, rng.randrange(1, 4))) + rng.choice(["", " method", " coding"])
        rows.append((f"e{k:02}", name, rng.choice(["m", "d"]), DAY + datetime.timedelta(rng.randrange(0, 8000)), rng.randrange(1, 9), rng.sample(["n1", "n2", "n3", "n4", "n5", "n6"], rng.randrange(0, 3))))
    for r in rows:
        if rng.random() < 0.9:
            texts.append((r[0], f"We {rng.choice(['extend', 'use'])} {rng.choice(rows)[1].upper()} {'x' * rng.choice([0, 300])} and {rng.choice(rows)[1]}."))
    return rows, texts


def content(name):
    return {w for w in name.split() if len(w) >= 4 and w not in labels.STRUCTURE + labels.GENERIC_NAMES}


def cue(text):
    return any(c in text for c in insight.EVOLUTION_CUES)


def older(rows, texts):
    said, out = dict(texts), {}
    for t in rows:
        for s in rows:
            days = (t[3] - s[3]).days
            shared, overlap, mentioned = len({*s[5]} & {*t[5]}), len(content(s[1]) & content(t[1])), s[1].lower() in said.get(t[0], "").lower()
            if s[2] == t[2] and 0 < days <= 365.25 * 18 and (shared or overlap or mentioned):
                out[s[0], t[0]] = (days, shared, overlap, mentioned, round(2 * shared + 1.5 * overlap + 4 * mentioned + 1 / (1 + days / 365.25) + min(2, 0.25 * math.log1p(s[4])), 6))
    return out


def frames(spark, rows, texts):
    e = spark.createDataFrame(rows, "entity_id string, canonical_name string, entity_type string, first_seen date, n_docs long, nodes array<string>")
    return e.withColumn("tokens", labels.content_tokens(F.col("canonical_name"))), spark.createDataFrame(texts, "entity_id string, text string")


def test_older_sources_with_mentions_alone(spark):
    rows, texts = entities()
    expected = older(rows, texts)
    assert any(x[3] and not x[1] and not x[2] for x in expected.values())
    found = insight.older_sources(*frames(spark, rows, texts)[:1], "entity_type", 18, 1000, frames(spark, rows, texts)[1]).collect()
    assert {(r.source, r.target): (r.days, r.shared, r.overlap, r.mentioned, r.score) for r in found} == expected
    for target in {r.target for r in found}:
        own = sorted((r for r in found if r.target == target), key=lambda r: r["rank"])
        assert [r.source for r in own] == [r.source for r in sorted(own, key=lambda r: (-r.score, r.days, r.source))]


def test_candidates_against_a_loop(spark):
    rows, texts = entities(7)
    by_id, said, fates, kept = {r[0]: r for r in rows}, dict(texts), {}, []
    e, t = frames(spark, rows, texts)
    pairs = [(s, d, *x) for (s, d), x in older(rows, texts).items() if d in said]
    names = spark.createDataFrame([(s, d, by_id[s][1], by_id[d][1], by_id[s][2]) for s, d, *_ in pairs], "s string, d string, sn string, dn string, kind string")
    told = labels.with_generic_predecessor(labels.with_variant_reason(names, "sn", "dn", "v"), "sn", "kind", "g")
    why = {(r.s, r.d): r.v or r.g for r in told.collect()}
    for s, d, days, shared, overlap, mentioned, _ in pairs:
        low, name = said[d].lower(), by_id[s][1].lower()
        score = min(0.28, 0.08 * shared) + min(0.16, 0.06 * overlap) + 0.08 * cue(low) + (0.12 if days / 365.25 <= 6 else 0.06 if days / 365.25 <= 12 else 0) + min(0.08, math.log1p(by_id[d][4]) * 0.03)
        if mentioned and name not in by_id[d][1].lower():
            at = low.find(name)
            score += 0.24 if cue(low[max(0, at - 160) : at + len(name) + 160]) else 0.12
        fate = f"skipped_{why[s, d]}" if why[s, d] else "skipped_below_min_candidate_score" if score < 0.25 else "retained_before_per_target_cap"
        fates[fate] = fates.get(fate, 0) + 1
        if fate.startswith("retained"):
            kept.append((s, d, days, round(score, 3)))
    assert len(fates) >= 4
    best = []
    for d in by_id:
        best += sorted((x for x in kept if x[1] == d), key=lambda x: (-x[3], x[2], x[0]))[:2]
    for limit in (0, 5):
        found, counters = evidence.successor_candidates(e, "entity_type", t, per_target=2, limit=limit)
        want = sorted(best, key=lambda x: (-x[3], by_id[x[1]][3], x[0], x[1]))[: limit or None]
        assert {(r.source, r.target, r.days, r.score) for r in found.collect()} == set(want)
        counts = {r.counter: r.n for r in counters.collect()}
        assert counts == fates | {"source_pairs_considered": len(pairs), "retained_after_per_target_cap": len(best), "retained_after_global_limit": len(want)}


@pytest.mark.parametrize(("s", "t", "want"), [
    ("Stance coding", "stance  Coding", "duplicate_label"), ("graph model", "graph models", "same_core_label"), ("river graph", "graph river model", "same_core_label"), ("deep river model", "dr method deep river", "same_core_label"),
    ("stance coding", "novel stance coding", "source_label_with_generic_modifier"), ("stance coding", "stance coding detection", "source_label_with_context_suffix"), ("improved stance coding", "stance coding", "target_label_with_generic_modifier"),
    ("topic detection task", "topic", "target_label_with_context_suffix"), ("a b c d", "other thing", ""), ("graph river", "graph forest", ""), ("...", "graph", ""),
])
def test_variants_of_labels(spark, s, t, want):
    assert labels.with_variant_reason(spark.createDataFrame([(s, t)], "s string, t string"), "s", "t").first()["reason"] == want


def test_generic_predecessors(spark):
    broad = [("Machine Learning", "m"), ("deep learning model", "m"), ("network approach", "m"), ("survey data", "data_source"), ("graph methods", "m"), ("system", "m"), ("real data science methods", "m")]
    fine = [("topic model", "m"), ("stance coding", "m"), ("causal forest", "m"), ("survey data", "unknown kind of two"), ("", "m"), ("deep causal river network inference", "m")]
    rows = spark.createDataFrame(broad + fine, "label string, kind string")
    found = {(r.label, r.kind): r.reason for r in labels.with_generic_predecessor(rows, "label", "kind").collect()}
    assert {k for k, v in found.items() if v} == {*broad, ("survey data", "unknown kind of two")}
