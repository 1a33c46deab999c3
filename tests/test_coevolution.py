"""Revisions, expansions and the loop between graph and taxonomy, against loops over all rows."""

import random
import re
import datetime
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomspan.operators import coevolution
from loomspan.plans import loop, run
from loomspan.sources import loaders
from tests.test_core import corpus_files

EDGE = "node_id string, edge_id string, source string, target string, edge_type string, verified boolean, source_document string, target_document string, bottleneck boolean"
STRONG = {"extends", "improves", "replaces", "adapts"}


def slug(x):
    return re.sub("[^a-z0-9]+", "_", x.lower()).strip("_")


def graph_of(seed):
    rng = random.Random(seed)
    nodes = [(f"n{k}", None if k < 3 else f"n{k % 3}", rng.choice(["method", "measurement_strategies", "", "policy"]), rng.choice([f"node {k}", "tidal stage"])) for k in range(12)]
    nodes += [("method__river_one", "n1", "method", "something"), ("method__river_one_2", "n1", "method", "other thing")]
    entities = [(f"{t}__{n.replace(' ', '_')}", n, t) for t in ("method", "evaluation", "governance") for n in ("river one", "lake two", "the sea", "pond of many more words than four", "tidal stage", "cold current")]
    entities += [("method__river-one", "River-One", "method")]
    ids = [e[0] for e in entities] + ["method__not_known", "x__improves_it"]
    edges = []
    for k in range(160):
        s, t = rng.sample(ids, 2)
        row = (f"e{k}", s, t, rng.choice([*STRONG, "background"]), rng.random() < 0.7, f"d{rng.randrange(9)}", rng.choice([None, f"d{rng.randrange(9)}"]), rng.random() < 0.2)
        edges += [(n, *row) for n in rng.sample([f"n{j}" for j in range(10)], rng.choice([1, 1, 1, 2]))]
    return nodes, entities, edges


def frames(spark, nodes, entities, edges):
    return spark.createDataFrame(nodes, "node_id string, parent_id string, dimension string, label string"), spark.createDataFrame(entities, "entity_id string, canonical_name string, entity_type string"), spark.createDataFrame(edges, EDGE)


def advice_of(nodes, edges):
    by, out = defaultdict(list), {}
    for e in edges:
        by[e[0]].append(e)
    for n in nodes:
        own = by[n[0]]
        strong = [e for e in own if e[4] in STRONG and e[5]]
        members = {x for e in own for x in e[2:4]}
        words = []
        if len({e[3] for e in strong}) >= 3 and len({e[2] for e in strong}) >= 2:
            words.append("split_review")
        if len(members) >= 4 and len(own) >= 4:
            words.append("cross_link_review")
        if strong and any(e[8] for e in own):
            words.append("mark_fragmenting_or_growing")
        out[n[0]] = (own, strong, members, words or ["monitor"])
    return out


def revisions(nodes, entities, edges, fits):
    known, every, found = {e[0]: e for e in entities}, defaultdict(set), {}
    for e in edges:
        every[e[1]].add(e[0])

    def add(key, *row):
        if key not in found or row[-2] > found[key][-2]:
            found[key] = row

    for n in sorted(nodes):
        own, strong, members, words = advice_of(nodes, edges)[n[0]]
        if "split_review" in words:
            counts = Counter(e[3] for e in own if e[5])
            for target, k in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:3]:
                label = known[target][1] if target in known else target.partition("__")[2].replace("_", " ")
                tokens = [w for w in re.findall("[a-z0-9]+", label.lower()) if len(w) >= 3 and w not in ("the", "this")]
                if 1 <= len(tokens) <= 4 and " the" not in f" {label.lower()} " and " improves " not in f" {label.lower()} " and (target not in known or fits[n[2], known[target][2]]):
                    docs = {d for e in own if e[5] and e[3] == target for d in e[6:8] if d}
                    add(f"revision_split__{slug(n[0])}__{slug(label)}", "split_child", n[0], label, "", round(min(0.9, 0.55 + 0.08 * k + 0.04 * len(members)), 3), docs)
        docs = {d for e in own for d in e[6:8] if d}
        others = {m for e in own for m in every[e[1]]} - {n[0]}
        strange = {x for x in members if x in known and not fits[n[2], known[x][2]]}
        if others or strange:
            add(f"revision_cross_link__{slug(n[0])}", "cross_link", n[0], "", "", round(min(0.86, 0.5 + 0.04 * len(others) + 0.04 * len(strange) + 0.02 * len(own)), 3), docs)
        if own and {"split_review", "mark_fragmenting_or_growing"} & {*words}:
            n_next = len({e[3] for e in own if e[5]})
            state = "fragmenting" if n_next >= 2 else "growing"
            add(f"revision_state__{slug(n[0])}__{state}", "state_annotation", n[0], "", state, round(min(0.88, 0.54 + 0.05 * n_next + 0.02 * len(strong)), 3), docs)
    return found


def test_dimensions_and_types(spark):
    cases = [("method", "methods", True), ("policy", "governance_practice", True), ("method", "evaluation", False), ("", "x", True), ("measurement_strategies", "evaluation", True), ("public_frames", "framing", True), ("policies", "mechanism", False), ("of", "anything", True)]
    rows = spark.createDataFrame(cases, "a string, b string, want boolean")
    assert [r.got for r in rows.select(coevolution.dimension_fits(F.col("a"), F.col("b")).alias("got")).collect()] == [c[2] for c in cases]


@pytest.mark.parametrize("seed", [1, 2])
def test_revisions_against_a_loop(spark, seed):
    nodes, entities, edges = graph_of(seed)
    n, e, g = frames(spark, nodes, entities, edges)
    members = g.select("node_id", F.explode(F.array("source", "target")).alias("entity_id"))
    told = coevolution.node_feedback(n, members, g)
    expected = advice_of(nodes, edges)
    assert {r.node_id: r.advice for r in told.collect()} == {k: v[3] for k, v in expected.items()}
    kinds = spark.createDataFrame([(a, b) for a in {x[2] for x in nodes} for b in {x[2] for x in entities}], "a string, b string")
    fits = {(r.a, r.b): r.fit for r in kinds.select("a", "b", coevolution.dimension_fits(F.col("a"), F.col("b")).alias("fit")).collect()}
    want = revisions(nodes, entities, edges, fits)
    candidates, documents = coevolution.propose_revisions(n, e, g, told, 1000)
    docs = defaultdict(set)
    for r in documents.collect():
        docs[r.candidate_id].add(r.doc_id)
    assert {r.candidate_id: (r.revision_type, r.node_id, r.label, r.state, r.confidence, docs[r.candidate_id]) for r in candidates.collect()} == want
    kinds = {x[0] for x in want.values()}
    assert kinds == {"split_child", "cross_link", "state_annotation"}
    few = coevolution.propose_revisions(n, e, g, told, 5)[0].collect()
    assert {r.candidate_id for r in few} == set(sorted(want, key=lambda k: (-want[k][4], k))[:5])


def applied(nodes, order, least, most):
    """Fates of (candidate_id, type, node, dimension, label, confidence, valid) in order, ids of new nodes."""
    labels, ids, out, done = {x[3].lower() for x in nodes}, {x[0] for x in nodes}, {}, 0
    for key, kind, node, dimension, label, sure, valid in order:
        name = None
        if done >= most:
            fate = "max_applied_revisions_reached"
        elif sure < least:
            fate = "below_revision_acceptance_threshold"
        elif kind == "split_child" and not label.strip():
            fate = "missing_label_or_parent"
        elif kind == "split_child" and not valid:
            fate = "low_quality_label"
        elif kind == "split_child" and label.strip().lower() in labels:
            fate = "label_already_exists_in_taxonomy"
        elif kind == "split_child":
            fate, k = "created_graph_derived_child", 1
            base = f"{slug(dimension) or 'taxonomy'}__{slug(label)}"
            while (name := base if k == 1 else f"{base}_{k}") in ids:
                k += 1
            ids.add(name)
            labels.add(label.strip().lower())
            done += 1
        elif kind not in ("cross_link", "state_annotation"):
            fate = "unknown_revision_type"
        elif node not in ids:
            fate = "source_node_missing"
        else:
            fate, done = "annotated_existing_node", done + 1
        out[key] = (fate, name)
    return out


@pytest.mark.parametrize("most", [0, 1, 3, 7, 100])
def test_revisions_are_applied_in_order(spark, most):
    nodes, _, _ = graph_of(1)
    rows = [
        ("a", "split_child", "n1", "method", "River one", 0.9, True), ("b", "split_child", "n2", "method", " river ONE ", 0.9, True), ("c", "split_child", "n2", "method", "river-one", 0.88, True), ("d", "split_child", "n2", "", "Tidal Stage", 0.87, True),
        ("e", "cross_link", "n2", "method", "", 0.86, True), ("f", "state_annotation", "gone", "method", "", 0.85, True), ("g", "state_annotation", "n2", "method", "", 0.84, True), ("h", "split_child", "n4", "", "delta wave", 0.83, True),
        ("i", "split_child", "n4", "method", "  ", 0.82, True), ("j", "split_child", "n4", "method", "this improves it", 0.82, False), ("k", "merge", "n4", "method", "x", 0.81, True), ("l", "cross_link", "n2", "", "", 0.8, True), ("m", "split_child", "n4", "", "late label", 0.1, True),
    ]
    state = {"g": "growing"}
    links = {"e": ["n9", "n3"], "l": ["n3", "n5"]}
    table = spark.createDataFrame([(k, t, n, d, x, state.get(k, ""), links.get(k, []), [], c) for k, t, n, d, x, c, _ in rows], "candidate_id string, revision_type string, node_id string, dimension string, label string, state string, linked_nodes array<string>, linked_entities array<string>, confidence double")
    documents = spark.createDataFrame([("a", "d1"), ("a", "d2"), ("b", "d3"), ("h", "d4")], "candidate_id string, doc_id string")
    taxonomy = spark.createDataFrame(nodes, "node_id string, parent_id string, dimension string, label string")
    changed, assigned, report = coevolution.apply_revisions(taxonomy, table, documents, 0.58, most)
    want = applied(nodes, rows, 0.58, most)
    assert {r.candidate_id: (r.reason, r.new_node_id) for r in report.collect()} == want
    new = {k: v[1] for k, v in want.items() if v[1]}
    assert {(r.doc_id, r.node_id) for r in assigned.collect()} == {(d, new[k]) for k, d in (("a", "d1"), ("a", "d2"), ("h", "d4")) if k in new}
    found = {r.node_id: r for r in changed.collect()}
    noted = {r[2] for r in rows if want[r[0]][0] == "annotated_existing_node"}
    assert set(found) == {*new.values(), *noted}
    if most == 100:
        assert (found["n2"].state, found["n2"].linked_nodes) == ("growing", ["n3", "n5", "n9"])
        assert new == {"a": "method__river_one_3", "c": "method__river_one_4", "h": "taxonomy__delta_wave"}


def test_many_hopeless_candidates_hide_no_good_one(spark):
    nodes = spark.createDataFrame([(f"n{k}", None, "", f"label {k}") for k in range(60)], "node_id string, parent_id string, dimension string, label string")
    rows = [(f"c{k:02}", "split_child", "n1", "", f"Label {k}", "", [], [], 0.9) for k in range(60)] + [("z", "split_child", "n1", "", "good one", "", [], [], 0.6)]
    table = spark.createDataFrame(rows, "candidate_id string, revision_type string, node_id string, dimension string, label string, state string, linked_nodes array<string>, linked_entities array<string>, confidence double")
    _, _, report = coevolution.apply_revisions(nodes, table, spark.createDataFrame([], "candidate_id string, doc_id string"), 0.58, 1)
    assert Counter(r.status for r in report.collect()) == {"deduplicated": 60, "applied": 1}
    none = coevolution.apply_revisions(nodes, table.limit(0), spark.createDataFrame([], "candidate_id string, doc_id string"))
    assert [df.count() for df in none] == [0, 0, 0]


def test_expansions_go_on_until_there_are_enough(spark):
    texts = [("a", "d1", "red lake red lake"), ("a", "d2", "Red Lake"), ("b", "d3", "sea"), ("c", "d4", "one two three four")]
    docs = spark.createDataFrame(texts, "node_id string, doc_id string, text string")
    nodes = spark.createDataFrame([("a", None, "m", "A"), ("b", "a", "m", "B"), ("c", "a", "m", "C"), ("e", "a", "m", "bare label"), ("f", "a", "m", "F")], "node_id string, parent_id string, dimension string, label string")
    signals = spark.createDataFrame([("b", 0.9, "width_expansion"), ("e", 0.85, "monitor"), ("a", 0.8, "depth_expansion"), ("c", 0.8, "monitor"), ("f", 0.3, "monitor"), ("gone", 0.99, "monitor")], "node_id string, score double, action string")
    for most, want in ((1, "b"), (2, "be"), (5, "bea"), (8, "beac")):
        candidates, documents = coevolution.propose_expansions(signals, docs, nodes, 0.55, 3, most)
        assert {r.trigger_node_id for r in candidates.collect()} == set(want)
    rows = {r.candidate_id: r for r in candidates.collect()}
    assert rows["depth__a__red_lake"].parent_node_id == "a" and rows["width__b__sea"].parent_node_id == "a"
    assert {r.doc_id for r in documents.where("candidate_id = 'depth__a__red_lake'").collect()} == {"d1", "d2"}
    told = coevolution.judged(candidates, documents, None, 0.6)
    assert {r.candidate_id for r in told.where("not accepted").collect()} == {k for k, r in rows.items() if r.trigger_node_id == "e"}


def test_expansions_are_applied_once(spark):
    nodes = spark.createDataFrame([("topic", None, "Topic"), ("topic__sea", "topic", "Sea"), ("topic__lake", "other", "Lake"), ("free", None, "rain")], "node_id string, parent_id string, label string")
    rows = [("c1", "topic", "sea", 0.9, True), ("c2", "topic", "lake", 0.8, True), ("c3", "topic", "Lake", 0.7, True), ("c4", "topic", "pond", 0.6, False), ("c5", None, "pond", 0.5, True), ("c55", None, None, 0.45, True), ("c6", None, "Rain", 0.4, True), ("c7", "x", "rain", 0.3, True), ("c8", "x", "late", 0.2, True)]
    table = spark.createDataFrame([(*r, "topic") for r in rows], "candidate_id string, parent_node_id string, label string, trigger_score double, accepted boolean, dimension string")
    new, assigned, report = coevolution.apply_expansions(nodes, table, spark.createDataFrame([("c2", "d1"), ("c3", "d2")], "candidate_id string, doc_id string"), 3)
    want = [("c1", "deduplicated", None), ("c2", "applied", "topic__lake_2"), ("c3", "deduplicated", None), ("c4", "rejected", None), ("c5", "applied", "topic__pond"), ("c55", "rejected", None), ("c6", "deduplicated", None), ("c7", "applied", "topic__rain")]
    assert sorted(tuple(r)[:2] + (r.new_node_id,) for r in report.collect()) == want
    assert new.count() == 3 and [tuple(r) for r in assigned.collect()] == [("d1", "topic__lake_2")]


def loop_state(spark, seed=1):
    nodes, entities, edges = graph_of(seed)
    n, e, g = frames(spark, nodes, entities, edges)
    assigned = g.select(F.col("source_document").alias("doc_id"), "node_id").distinct()
    mentions = g.select(F.col("source").alias("entity_id"), F.col("source_document").alias("doc_id"), "node_id").distinct()
    return {"nodes": n, "assignments": assigned, "mentions": mentions, "edges": g}, e


def test_the_loop_goes_on_where_it_failed(spark, tmp_path):
    start, entities = loop_state(spark)
    asked, calls = [], []

    def begin():
        asked.append(1)
        return start

    def extract(fail_at):
        def work(pairs):
            calls.append({(r.doc_id, r.node_id) for r in pairs.collect()})
            if len(calls) == fail_at:
                raise OSError("lost")
            new = start["mentions"].drop("node_id").distinct().join(pairs, "doc_id").select("entity_id", "doc_id", "node_id")
            more = start["edges"].drop("node_id").distinct().join(pairs.withColumnRenamed("doc_id", "source_document"), "source_document").select(start["edges"].columns)
            return new, more

        return work

    whole = loop.coevolve(spark, str(tmp_path / "a"), begin, entities, extract(0), 3)
    n = len(calls)
    assert n == 3 and calls[0] and not calls[0] & calls[1]
    with pytest.raises(OSError, match="lost"):
        loop.coevolve(spark, str(tmp_path / "b"), begin, entities, extract(n + 2), 3)
    assert [r.status for r in loop.steps(spark, str(tmp_path / "b")).orderBy("round").collect()] == ["start", "applied"]
    again = loop.coevolve(spark, str(tmp_path / "b"), begin, entities, extract(0), 3)
    assert len(asked) == 2  # the first state of each folder, once
    assert calls[n] == calls[0] and calls[n + 1] == calls[n + 2] == calls[1]
    for name in whole:
        columns = sorted(whole[name].columns)
        assert sorted(map(repr, whole[name].select(columns).collect())) == sorted(map(repr, again[name].select(columns).collect())), name
    assert whole["nodes"].count() == len({r.node_id for r in whole["nodes"].collect()}) > start["nodes"].count()


def test_the_loop_ends_without_revisions(spark, tmp_path):
    start, entities = loop_state(spark)
    quiet = start | {"edges": start["edges"].limit(0)}
    out = loop.coevolve(spark, str(tmp_path), lambda: quiet, entities, lambda pairs: (quiet["mentions"].limit(0), quiet["edges"]), 3)
    assert [(r.round, r.status) for r in out["steps"].orderBy("round").collect()] == [(0, "start"), (1, "no_revision_candidates")]
    assert out["nodes"].count() == start["nodes"].count()
    none = loop.coevolve(spark, str(tmp_path / "n"), lambda: start, entities, lambda pairs: (start["mentions"].limit(0), start["edges"].limit(0)), 3, least=2.0)
    assert [r.status for r in none["steps"].orderBy("round").collect()] == ["start", "no_applied_revisions"]


def test_full_run(spark, tmp_path):
    config = loaders.load_config(str(corpus_files(tmp_path)))
    with pytest.raises(ValueError, match="root"):
        run.run(spark, config, mode="full")
    got = run.run(spark, config, str(tmp_path / "out"), mode="full")
    steps = [(r.round, r.status) for r in got["rounds"].orderBy("round").collect()]
    assert steps[0] == (0, "start") and len(steps) >= 2
    applied_ = [r for r in got["revision_reports"].collect() if r.status == "applied"]
    assert applied_ and all(r.node_id for r in applied_)
    ids = [r.node_id for r in got["nodes"].collect()]
    assert len(ids) == len(set(ids))
    assert got["forecast_hooks"].count() and got["node_states"].count() == len(ids)
    edges = [r.edge_id for r in got["edges"].collect()]
    assert edges and len(edges) == len(set(edges))


def exchanges(df):
    return str(df.select("*")._jdf.queryExecution().executedPlan()).count("Exchange hashpartitioning")  # of a plan that hasn't run


def test_edges_are_moved_to_their_nodes_once(spark):
    nodes, entities, edges = graph_of(3)
    n, e, g = frames(spark, nodes, entities, edges)
    told = coevolution.node_feedback(n, None, g)
    members = g.select("node_id", F.explode(F.array("source", "target")).alias("entity_id"))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(told) == key(coevolution.node_feedback(n, members, g))
    assert exchanges(told) <= 2  # the distinct nodes, the edges
    # all nodes of an edge beside it say the same as a join
    every = g.groupBy("edge_id").agg(F.collect_set("node_id").alias("nodes"))
    plain, beside = (coevolution.propose_revisions(n, e, x, told, 2**31 - 1) for x in (g, g.join(every, "edge_id")))
    for a, b in zip(plain, beside):
        assert key(a) == key(b) and a.count()
    assert "SinglePartition" not in str(plain[0]._jdf.queryExecution().executedPlan()) and plain[0].inputFiles()
    assert exchanges(plain[1]) <= 4


def test_lines_meet_their_parts_once(spark, tmp_path):
    from loomspan.plans import tables

    line = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    rows = [(k, p, 1, 1, 1.0, 1.0, 0.0, 0.0, "A", "F", datetime.datetime(2020, 1, k)) for k, p in ((1, 7), (2, 8), (3, None), (4, 7), (5, 99), (6, 8), (7, 7))]
    spark.createDataFrame(rows, line).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(7, "red ring", "B1", "SMALL"), (8, "old bolt", "B2", "LARGE")], "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    e = tables.edges(spark, str(tmp_path))
    # lines with no part stand between others
    assert [(r.source_document, r.source, r.target, r.node_id, r.edge_id) for r in e.orderBy("edge_id").collect()] == [
        (1, "small__red_ring", "large__old_bolt", "B1", 7500001), (6, "large__old_bolt", "small__red_ring", "B2", 7500006),
    ]
    assert str(e._jdf.queryExecution().optimizedPlan()).count("Join ") == 1
