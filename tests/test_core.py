"""Functions, operators, sources, sinks, streams and whole runs of the core library."""

import json
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.functions import values as V
from loomspan.operators import corpus, evidence, graph, induction, insight, model_calls, relations, reports, windows
from loomspan.plans import evidence_queries, graph_queries, registry, relation_queries, run, text_queries  # noqa: F401
from loomspan.sources import loaders, sinks
from loomspan.streaming import windows as stream

DATA = "/root/testdata/sf0.001"


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "want"), [("  a b\n c ", "a b c"), ("", ""), ("\t", "")])
def test_normalize_space(spark, text, want):
    assert one(spark, T.normalize_space(F.col("t")), t=text) == want
    assert one(spark, T.normalize_space(F.lit(None))) == ""


def test_slugs(spark):
    assert one(spark, T.slugify(F.lit("  Große Sätze -- 2! "))) == "gro_e_s_tze_2"
    assert one(spark, T.slugify(F.lit("!!"))) == "unknown"
    assert one(spark, T.slugify(F.lit("a" * 79 + " b"))) == "a" * 79


def test_tokens_and_phrases(spark):
    assert one(spark, T.tokenize(F.lit("The well-known Ideas, of (two) minds in 2024"))) == ["well", "known", "ideas", "two", "minds", "2024"]
    assert one(spark, T.ngrams(F.array(*map(F.lit, "abc")), 2, 3)) == ["a b", "b c", "a b c"]
    assert one(spark, T.ngrams(F.array(F.lit("a")), 2, 2)) == []
    assert one(spark, T.has_phrase(F.lit("large GPT-4 models"), F.lit("gpt"))) and not one(spark, T.has_phrase(F.lit("flagpole"), F.lit("flag")))
    assert one(spark, T.phrase_match(F.lit("the networks of a neural mind"), F.lit("neural networks x"))) and not one(spark, T.phrase_match(F.lit("mind"), F.lit("neural networks")))


def test_quotes(spark):
    text = F.lit("We extend the river model with better stones and water.")
    assert one(spark, T.quote_verified(F.lit("extend the RIVER model"), text))
    assert one(spark, T.quote_verified(F.lit("extend river model better stones clouds"), text))
    assert not one(spark, T.quote_verified(F.lit("other clouds"), text)) and not one(spark, T.quote_verified(F.lit(""), text))


def test_cleaner(spark):
    page = "No Access Deep results of rivers. https://doi.org/10.1/x Tools Share Cited By 3"
    got = one(spark, T.clean_abstract(F.col("t")), t=page)
    assert got.text == "Deep results of rivers." and got.markers == ["access_banner", "doi_url"] and got.cleaned_length < got.original_length
    plain = one(spark, T.clean_abstract(F.lit("x " * 400 + "references y")))
    assert plain.markers == []


def test_dates(spark):
    want = {"2020": "2020-01-01", "2020/3/9": "2020-03-09", "2020-03-09T10:00": "2020-03-09", "2024-05": None, "2020-13-01": None, "x": None}
    for text, day in want.items():
        assert str(one(spark, V.parse_date(F.col("t")), t=text)) == str(day)
    assert one(spark, V.year_span(F.lit("from 1999 to 2004, not 3000"))) == "1999-2004"


@pytest.mark.parametrize(("delta", "kind", "verified", "conf", "status"), [(10, "extends", True, 0.8, "trusted"), (10, "extends", False, 0.8, "candidate"), (1, "compares", True, 0.9, "candidate"), (1, "extends", True, 0.2, "unverified")])
def test_strata(spark, delta, kind, verified, conf, status):
    assert one(spark, graph.stratum(F.lit(kind), F.lit(conf), F.lit(verified))) == status


def test_edge_score_of_a_backward_edge(spark):
    score = one(spark, graph.edge_score(F.lit(0.8), F.lit(1.0), graph.temporal_score(F.lit(-10)), F.lit(0.55), F.lit(0.9), F.lit(0.25)))
    assert score == pytest.approx(0.654) and one(spark, graph.temporal_score(F.lit(-10))) == 0.0


def test_relations_and_grounding(spark):
    s = T.sentences(F.lit("Rivers are old. We extend River by Lake here. River versus Lake."))
    assert one(spark, evidence.relation_of(s, F.lit("River"), F.lit("Lake"))).edge_type == "extends"
    assert one(spark, evidence.relation_of(T.sentences(F.lit("River and Lake.")), F.lit("River"), F.lit("Lake"), {"extends": ["zzz"]})).cue == "co-mention"
    q, t = F.lit("we improve river flow"), F.lit("Here we improve river flow. And lake basins.")
    for mode, want in (("substring", True), ("one_sided_cue", True), ("two_sided_cue", False)):
        assert one(spark, evidence.grounding(q, t, F.lit("river flow"), F.lit("lake basin"), ["improve"], mode)) is want


def test_beam(spark):
    edges = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.8), ("c", "a", 0.9), ("a", "d", 0.5), ("b", "d", 0.7)], "source string, target string, weight double")
    got = {(r.path, r.score) for r in graph.beam_paths(edges, 3, 2, 2).collect()}
    assert ("a>b", 0.9) in got and ("a>b>c", 0.85) in got and not any(p.startswith("a>b>c>a") for p, _ in got)


def test_successor_paths_hold_every_edge_and_four_steps(spark):
    import random

    rng = random.Random(3)
    rows = [(f"e{k}", "hub", f"t{k % 6}", round(0.9 - 0.01 * k, 2), k) for k in range(8)]
    rows += [(f"f{k}", f"t{k}", f"t{k + 1}", 0.5, 1) for k in range(5)] + [("back", "t3", "t1", 0.9, 1), ("self", "t5", "t5", 0.9, 1)]
    rows += [(f"r{k}", f"n{rng.randrange(9)}", f"n{rng.randrange(2, 9)}", rng.randrange(4) / 4, rng.randrange(3)) for k in range(60)]
    for part in (rows, [r for r in rows if r[0] in ("back", "f1", "f2")]):
        out, want = {}, {(r[0],): (r[1], r[2]) for r in part}
        for r in sorted(part, key=lambda r: (-r[3], r[4], r[2], r[0])):
            out.setdefault(r[1], []).append(r)

        def extend(path, edges):
            for r in out.get(path[-1], [])[:4] if len(edges) < 4 else []:
                if r[2] not in path:
                    want[(*edges, r[0])] = (*path, r[2])
                    extend((*path, r[2]), (*edges, r[0]))

        for start in {r[1] for r in part} - {r[2] for r in part} or {r[1] for r in part}:
            extend((start,), ())
        got = graph.successor_paths(spark.createDataFrame(part, "edge_id string, source string, target string, confidence double, time_delta_days int")).collect()
        assert sorted((r.edge_path, r.path, r.depth) for r in got) == sorted((">".join(e), ">".join(p), len(e)) for e, p in want.items())
        assert len(part) < 9 or max(r.depth for r in got) == 4


def test_labels_inside_texts_are_assigned_without_a_shared_token(spark):
    docs = spark.createDataFrame([(1, "We use AI here"), (2, "about metaheuristics"), (3, "river  Deep things"), (4, "none")], "doc_id long, text string")
    nodes = spark.createDataFrame([("ai", "p", "AI"), ("heur", "p", "heuristic"), ("deep", "p", "deep river"), ("root", None, "none")], "node_id string, parent_id string, label string")
    known = spark.createDataFrame([(4, "k")], "doc_id long, node_id string")
    assert {tuple(r) for r in evidence.fuzzy_assign(docs, nodes, known).collect()} == {(1, "ai"), (2, "heur"), (3, "deep"), (4, "k")}


NEW_QUERIES = ["joi13_sco04_older_sources", "str10_whole_names", "grf06_agg32_all_hooks", "joi03_fuzzy_assignment", "grf04_successor_edge_paths", "sco03_candidate_score", "sco08_grf09_revisions", "joi18_pattern_links", "str19_quote_verification"]


@pytest.mark.parametrize("name", NEW_QUERIES)
def test_whole_queries_equal_their_sql(spark, name):
    test_queries_equal_their_sql(spark, name)


def test_hooks_have_every_family(spark):
    kinds = {r.kind: r.n for r in registry.QUERIES["grf06_agg32_all_hooks"](spark, DATA).groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert set(kinds) == {"chain", "branch", "bottleneck"} and kinds["chain"] == registry.QUERIES["grf01_chains"](spark, DATA).count()


def test_registered_parameters_are_whole(spark):
    paths = registry.QUERIES["grf02_trajectories"](spark, DATA)
    metrics = dict(map(tuple, registry.QUERIES["agg23_trajectory_metrics"](spark, DATA).collect()))
    assert paths.agg(F.max("path_length")).first()[0] == 4 and metrics["trajectories"] == paths.count()
    assert registry.QUERIES["joi13_sco04_older_sources"](spark, DATA).agg(F.max("rank")).first()[0] > 6


def test_trees_of_any_depth(spark):
    rows = [("n0", None), *((f"n{k}", f"n{k - 1}") for k in range(1, 37)), ("lost", "nowhere"), ("below", "lost")]
    got = {r.node: (r.root, r.level) for r in corpus.flatten_tree(spark.createDataFrame(rows, "id string, up string"), "id", "up").collect()}
    assert got == {f"n{k}": ("n0", k) for k in range(37)}
    with pytest.raises(ValueError):
        corpus.flatten_tree(spark.createDataFrame([("a", "b"), ("b", "a"), ("r", None)], "id string, up string"), "id", "up")
    assert corpus.flatten_tree(spark.createDataFrame([], "id string, up string"), "id", "up").count() == 0


def test_first_pairs_equal_those_of_all_pairs(spark):
    import random
    from datetime import date

    rng = random.Random(5)
    rows = [(g, date(2024, 1, rng.randrange(1, 9)), k) for g in range(12) for k in range(rng.randrange(0, 9))]
    want = []
    for g in range(12):
        own = [(d, k) for x, d, k in rows if x == g]
        pairs = sorted((td, t, sd, s) for sd, s in own for td, t in own if sd <= td and s != t)[:3]
        want += [(g, s, t, n + 1) for n, (_, t, _, s) in enumerate(pairs)]
    got = graph.first_pairs(spark.createDataFrame(rows, "g long, day date, k long"), ["g"], "day", "k", 3)
    assert sorted(tuple(r) for r in got.select("g", "source", "target", "rank").collect()) == sorted(want)


def test_short_and_embedded_quotes_are_found(spark):
    quotes = spark.createDataFrame([(1, "AI"), (2, "stem wat"), (3, "alpha beta gamma delta epsilon"), (4, " "), (5, "x of y"), (6, "deep blue river runs")], "item_id long, quote string")
    docs = spark.createDataFrame([(1, "we use ai here"), (2, "a system water pump"), (3, "Delta, gamma; beta ALPHA"), (4, "max of yes"), (5, "the deep  blue river runs"), (6, None)], "doc_id long, text string")
    want = {(i, d) for i, q in ((r.item_id, r.quote) for r in quotes.collect()) for d, t in ((r.doc_id, r.text) for r in docs.collect()) if one(spark, T.quote_verified(F.col("q"), F.col("t")), q=q, t=t or "")}
    assert {tuple(r) for r in evidence.quoting_documents(quotes, docs).select("item_id", "doc_id").collect()} == want and len(want) == 5


def test_terms_are_chosen_greedily(spark):
    terms = spark.createDataFrame([("deep river", 9, 9.0), ("deep river flow", 8, 8.0), ("cold lake", 7, 7.0), ("lake cold", 6, 6.0), ("warm sea", 5, 5.0)], "phrase string, support long, score double")
    assert induction.choose_terms(terms, 14, 2) == ["deep river", "cold lake", "warm sea"] and induction.choose_terms(terms, 2) == ["deep river", "cold lake"]


def test_relation_schemas_and_seeds(tmp_path):
    base = {"background": {"definition": "b"}, "extends": {"definition": "e"}}
    out, report = induction.relation_schema([{"edge_type": "Merges With", "definition": "m"}, {"name": "empty"}, {}], base, ["extends"], 2)
    assert list(out) == ["background", "extends"] and [r["reason"] for r in report] == ["", "missing_definition", "missing_edge_type"]
    assert "merges_with" in induction.relation_schema([{"edge_type": "Merges With", "definition": "m"}], base, ["extends"], 9)[0]
    (tmp_path / "seed.json").write_text('{"a": {"definition": "x"}}')
    (tmp_path / "list.json").write_text("[1]")
    assert induction.load_schema_seed(str(tmp_path / "seed.json")) == {"a": {"definition": "x"}} and induction.load_schema_seed(str(tmp_path / "list.json")) == induction.load_schema_seed(str(tmp_path / "none")) == {}


def test_reports_as_markdown(spark):
    text = reports.markdown(spark.createDataFrame([("a|b", None, 2)], "x string, y string, z long"), "Report")
    assert text.splitlines() == ["# Report", "", "| x | y | z |", "| --- | --- | --- |", "| a\\|b |  | 2 |"]


def test_windows_close_and_stay_open(spark):
    rows = [("s", k, f"2020-01-{k + 1:02d}", "document") for k in range(9)] + [("t", 50, "2020-01-01", "edge"), ("t", 51, None, "edge"), (None, 52, "2020-01-01", "edge")]
    events = spark.createDataFrame(rows, "scope string, event_id long, day string, kind string").withColumn("day", F.to_date("day"))
    got = {r.event_id: (r.window_index, r.closed_by) for r in windows.adaptive_windows(events, {"document": 3}, 2, 100).collect()}
    assert [got[k] for k in range(9)] == [(0, None), (0, None), (0, "document"), (1, None), (1, None), (1, "document"), (2, None), (2, None), (2, "document")]
    assert got[50] == (0, None) and 51 not in got and 52 not in got
    rows = windows.window_rows(windows.adaptive_windows(events, {"document": 3}, 2, 100))
    assert {(r.window_id, r.trigger) for r in rows.collect()} == {("s__w0001", "document"), ("s__w0002", "document"), ("s__w0003", "document"), ("t__w0001", "open")}


def test_similar_names_are_linked(spark):
    rows = [("m__a", "graph network", "m"), ("m__b", "graph networks", "m"), ("m__c", "river model", "m"), ("d__a", "graph network", "d")]
    got = dict(map(tuple, corpus.merge_similar(spark.createDataFrame(rows, "entity_id string, canonical_name string, entity_type string")).collect()))
    assert got == {"m__a": "m__a", "m__b": "m__a", "m__c": "m__c", "d__a": "d__a"}


def test_similar_names_equal_a_greedy_pass_over_all_names(spark):
    import difflib
    import random

    rng, names = random.Random(5), ["transformer", "transfomer", "tokenizer", "tokeniser", "large language model", "lage language model", "deep river graph", "graph river deep", "AI", "ai", "ML", "x of"]
    words = "graph network river model language tokenizer transformer attention sparse deep policies".split()
    for _ in range(140):
        name = list(" ".join(rng.sample(words, rng.randint(1, 3))))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(name))
            name[k : k + 1] = rng.choice(["", rng.choice("aestz"), name[k] + rng.choice("aest")])
        names.append("".join(name))
    rows = [(f"{t}__{k}", n, t) for k, n in enumerate(names) for t in ("m", "d")]
    df = spark.createDataFrame(rows, "entity_id string, canonical_name string, entity_type string")
    norms = {r.entity_id: r.norm for r in df.select("entity_id", T.alias_norm(F.col("canonical_name")).alias("norm")).collect()}

    def near(a, b, low_a, low_b):
        if not a or not b:
            return a == b and low_a == low_b
        s, t = set(a.split()), set(b.split())
        return len(s & t) / len(s | t) >= 0.86 or difflib.SequenceMatcher(None, a, b).ratio() >= 0.86

    want, targets = {}, {"m": [], "d": []}
    for low, own, kind in sorted((n.lower(), i, k) for i, n, k in rows):
        hit = next((i for n, i, text in targets[kind] if near(n, norms[own], text, low)), None)
        if hit is None:
            targets[kind].append((norms[own], own, low))
        want[own] = hit or own
    assert dict(map(tuple, corpus.merge_similar(df).collect())) == want
    for k in (0, 2, 4, 6, 8):
        assert want[f"m__{k}"] == want[f"m__{k + 1}"]


def test_upper_median(spark):
    rows = spark.createDataFrame([("a", v) for v in (5, 1, 3, 4)] + [("b", 2)], "g string, v int")
    assert {(r.g, r.median) for r in graph.upper_median(rows, "g", "v").collect()} == {("a", 4), ("b", 2)}


def test_samples_are_fixed_and_bounded(spark):
    rows = spark.range(200).withColumn("s", F.col("id") % 3)
    a, b = ({r.id for r in insight.stratified(x, "s", "id", 30).collect()} for x in (rows, rows.repartition(5)))
    assert a == b and len(a) == 30


def test_json_lines(spark, tmp_path):
    (tmp_path / "good.jsonl").write_text('{"id": "a"}\n\n{"id": "b", "n": 1}\n')
    assert loaders.read_records(spark, str(tmp_path / "good.jsonl")).count() == 2
    (tmp_path / "list.json").write_text('[{"id": 1}, {"id": 2}]')
    assert loaders.read_records(spark, str(tmp_path / "list.json")).count() == 2
    (tmp_path / "bad.jsonl").write_text('{"id": "a"}\n[1]\n')
    with pytest.raises(Exception, match="not a JSON object"):
        loaders.read_records(spark, str(tmp_path / "bad.jsonl")).collect()


def test_documents_are_mapped_and_counted(spark, tmp_path):
    rows = [{"paper_id": "p1", "title": " A  b ", "abstract": "one", "summary": "two", "published": "2020-02-03", "role": "core"}, {"title": "none"}, {"doc_id": "p2", "text": "x", "publication_date": "2030"}, {"text": "late"}]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, rows)))
    docs, reasons = loaders.load_documents(loaders.read_lines(spark, str(tmp_path / "c.jsonl")), loaders.CorpusConfig(cutoff="2025-01-01"))
    got = {r.doc_id: r for r in docs.collect()}
    assert got["p1"].text == "one\ntwo" and got["p1"].title == "A b" and got["p1"].chronology_slice == "2020-02" and got["doc_000004"].chronology_slice == "unknown"
    assert dict(map(tuple, reasons.collect())) == {"loaded": 2, "missing_text": 1, "post_cutoff": 1}


def test_taxonomies(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([{"node_id": "a", "canonical_label": "A", "children": [{"label": "Deep River"}, {"label": ""}]}, {"node_id": "a", "label": "again"}]))
    got = {r.node_id: r.parent_id for r in loaders.load_nodes(spark, str(tmp_path / "t.json")).collect()}
    assert got == {"a": None, "deep_river": "a", "a_0002": None}
    (tmp_path / "a.jsonl").write_text('{"doc_id": "d", "taxonomy_nodes": ["a", " b ", ""]}\n{"doc_id": "e", "taxonomy_nodes": {"x": ["a"], "y": ["c", "a"]}}\n')
    assert {tuple(r) for r in loaders.load_assignments(loaders.read_lines(spark, str(tmp_path / "a.jsonl"))).collect()} == {("d", "a"), ("d", "b"), ("e", "a"), ("e", "c")}


def test_taxonomies_by_dimension_and_under_nodes_without_a_label(spark, tmp_path):
    data = {"theme": {"node_id": "t", "label": "Theme", "children": [{"node_id": "x", "children": [{"label": "Deep", "children": [{"label": "Deeper"}]}]}, "no node"]}, "method": {"children": [{"node_id": "m", "label": "M"}]}, "list": [{"label": "L"}]}
    (tmp_path / "t.json").write_text(json.dumps(data))
    got = {(r.node_id, r.dimension, r.parent_id) for r in loaders.load_nodes(spark, str(tmp_path / "t.json")).collect()}
    assert got == {("t", "theme", None), ("deep", "theme", "x"), ("deeper", "theme", "deep"), ("m", "method", None), ("l", "list", None)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, ["a"]), (1, ["b", "c"])], "k int, v array<string>")
    sinks.write_jsonl(df, str(tmp_path / "j"), ["k"])
    assert [json.loads(x)["k"] for f in sorted((tmp_path / "j").glob("part*")) for x in f.read_text().splitlines()] == [1, 2]
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).where("k = 1").first().v == '["b","c"]'
    assert dict(map(tuple, sinks.write_artifacts({"x": df}, str(tmp_path / "r")).collect())) == {"x": 2}
    assert sinks.read_artifact(spark, str(tmp_path / "r"), "x", "k int").count() == 2 and sinks.read_artifact(spark, str(tmp_path / "r"), "none", "k int").count() == 0


class Canned:
    def complete(self, task, prompt):
        if "bad" in prompt:
            return "no"
        return '```json\n{"decision": "core", "score": 7,}\n```'


def test_model_calls(spark):
    docs = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "good")], "doc_id long, text string")
    got = {r.doc_id: (r.decision, r.score) for r in model_calls.screening(docs, Canned()).collect()}
    assert got == {1: ("core", 1.0), 2: ("peripheral", 0.5), 3: ("core", 1.0)}
    assert {r.decision for r in model_calls.screening(docs, model_calls.Deterministic()).collect()} == {"peripheral"}
    requests = docs.select(F.lit("t").alias("task"), F.col("text").alias("prompt"), F.lit("{}").alias("fallback"))
    first = model_calls.call(requests, Canned(), required=("decision",))
    rows = first.collect()
    assert len(rows) == 2 and {r.json_repaired for r in rows} == {True, False} and [r.attempts for r in rows if r.error] == [2]
    cached = model_calls.call(requests, model_calls.Deterministic(), cache=first)
    assert {r.output for r in cached.collect()} == {r.output for r in rows}
    assert model_calls.filled("{a} {b} {", {"a": "x"}) == "x {b} {"


def test_streamed_windows_equal_the_batch(spark, tmp_path):
    """Batches in a shuffled order within the watermark; what is far behind it is dropped, what it hasn't passed is held."""
    import random

    events = spark.read.parquet(f"{DATA}/events.parquet").select(F.col("event_type").alias("scope"), "event_id", "ts", F.when(F.col("event_id") % 2 == 0, "document").otherwise("edge").alias("kind"))
    days = sorted({r.d for r in events.select(F.to_date("ts").alias("d")).collect()})
    order = [days[k : k + 3] for k in range(0, len(days), 3)]
    random.Random(2).shuffle(order[0])
    shape = "scope string, event_id long, ts timestamp, kind string"
    for k, some in enumerate(order):
        events.where(F.to_date("ts").isin(some)).orderBy(F.rand(k)).coalesce(1).select("scope", "event_id", F.col("ts").cast("timestamp").alias("ts"), "kind").write.parquet(str(tmp_path / f"in/{k:03d}"))
    late = spark.sql("select 'click' as scope, 10000001L as event_id, timestamp '2020-01-01' as ts, 'edge' as kind")
    last = spark.sql("select 'none' as scope, 10000002L as event_id, timestamp '2031-01-01' as ts, 'edge' as kind")

    def run_with(folder):
        source = spark.readStream.schema(shape).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(folder))
        return stream.streaming_windows(source, {"document": 20, "edge": 25}, 1, 4, "5 days").writeStream.format("memory").queryName("win").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()

    q = run_with(tmp_path / "in")
    q.processAllAvailable()
    late.coalesce(1).write.parquet(str(tmp_path / "in/late"))
    q.processAllAvailable()
    last.coalesce(1).write.parquet(str(tmp_path / "in/last"))
    q.processAllAvailable()
    q.processAllAvailable()
    q.stop()
    got = {(r.event_id, r.window_index, r.closed_by) for r in spark.table("win").collect()}
    batch = windows.adaptive_windows(events.withColumn("day", F.to_date("ts")), {"document": 20, "edge": 25}, 1, 4)
    assert got == {(r.event_id, r.window_index, r.closed_by) for r in batch.collect()} and len(got) == events.count()


def test_resumed_batches_add_nothing_twice(spark, tmp_path):
    spark.createDataFrame([(1,), (2,)], "k long").coalesce(1).write.parquet(str(tmp_path / "in"))
    work = lambda df: df.withColumn("status", F.when(F.col("k") == 2, "failed").otherwise("done"))
    for n in range(2):
        source = spark.readStream.schema("k long").parquet(str(tmp_path / "in"))
        stream.resume_into(source, "resumed", "k", str(tmp_path / f"cp{n}"), work).awaitTermination()
    assert sorted((r.k, r.status) for r in spark.table("resumed").collect()) == [(1, "done"), (2, "failed"), (2, "failed")]
    spark.sql("drop table resumed")


def corpus_files(folder):
    docs = [
        ("d1", "River Model one", "We propose River Model for stance coding. It uses clear water data.", "2020-01-05"),
        ("d2", "Lake Model", "Lake Model extends River Model and improves flow coding. A limitation remains.", "2021-03-01"),
        ("d3", "Sea Model", "Sea Model improves Lake Model for coding. We compare River Model.", "2022-06-01"),
        ("d4", "Other", "Nothing of the kind.", "2022-07-01"),
    ]
    (folder / "corpus.jsonl").write_text("\n".join(json.dumps({"doc_id": i, "title": t, "abstract": x, "published": p, "role": "core"}) for i, t, x, p in docs))
    (folder / "nodes.json").write_text(json.dumps([{"node_id": "n1", "canonical_label": "coding"}, {"node_id": "n2", "canonical_label": "data"}]))
    (folder / "run.toml").write_text('corpus_path = "corpus.jsonl"\ntaxonomy_path = "nodes.json"\nshortest_days = 1\n[entity_patterns]\nmethod = ["River Model", "Lake Model", "Sea Model"]\n[windows]\ndocument = 2\n')
    return folder / "run.toml"


def test_whole_run(spark, tmp_path):
    config = loaders.load_config(str(corpus_files(tmp_path)))
    got = run.run(spark, config, str(tmp_path / "out"))
    rows = {k: v.collect() for k, v in got.items()}
    assert len(rows["documents"]) == 4 and {r.node_id for r in rows["assignments"]} == {"n1", "n2"} and len(rows["entities"]) == 3
    extends = [r for r in rows["edges"] if r.source.endswith("river_model") and r.target.endswith("lake_model")]
    assert extends and all(r.edge_type == "extends" and r.verified and r.status == "trusted" and r.time_delta_days in (0, 421) for r in extends if r.target_document == "d2")
    assert rows["trajectories"] and len(rows["windows"]) >= 2
    assert {r.artifact for r in spark.read.parquet(str(tmp_path / "out/manifest")).collect()} == set(got)
    (tmp_path / "bad.toml").write_text('corpus_path = "c"\ngrounding = "none"\n')
    with pytest.raises(ValueError, match="grounding"):
        loaders.load_config(str(tmp_path / "bad.toml"))


def test_induced_run(spark, tmp_path):
    corpus_files(tmp_path)
    got = run.run(spark, loaders.RunConfig(str(tmp_path / "corpus.jsonl"), entity_patterns={"method": ("River Model",)}))
    assert got["nodes"].count() >= 2 and got["assignments"].count() >= 1


@pytest.mark.parametrize("name", ["str04_tokenize", "joi02_phrase_assignment", "joi09_remap", "agg20_upper_median", "grf02_trajectories", "win02_windows"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = registry.QUERIES[name](spark, DATA)
    want = con.sql(registry.SQL[name])
    order = [list(want.columns).index(c) for c in df.columns]
    plain = lambda v: round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    assert sorted(repr([plain(v) for v in r]) for r in df.collect()) == sorted(repr([plain(r[i]) for i in order]) for r in want.fetchall())


def test_the_core_does_not_need_the_optional_package():
    from pathlib import Path

    root = Path(run.__file__).parents[1]
    for file in root.rglob("*.py"):
        if "llm" not in file.relative_to(root).parts:
            assert not re.search(r"loomspan\.llm|corpus_pipeline", file.read_text()), file
