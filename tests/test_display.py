"""Each rule by which a relation isn't shown, and its place among the others."""

from pyspark.sql import functions as F

from loomspan.operators import display, reports

GOOD = {
    "accepted": True, "edge_type": "extends", "confidence": 0.9, "time_delta_days": 400, "source_document": "d1", "target_document": "d2", "source_name": "topic lexicon coding", "target_name": "stance vector forest", "source_type": "method",
    "target_type": "method", "schema_group": "analytic_method", "candidate_reasons": ["target_text_mentions_source_with_evolution_cue"], "source_quote": "a quote", "target_quote": "another", "rationale": "r",
}
CASES = [
    ({}, ""), ({"accepted": False}, "raw_rejected"), ({"accepted": None, "confidence": 0.1}, "raw_rejected"), ({"edge_type": "compares"}, "relation_type_not_for_display"), ({"edge_type": None}, "relation_type_not_for_display"), ({"confidence": 0.5}, "low_confidence"),
    ({"confidence": None}, "low_confidence"), ({"time_delta_days": None}, "too_near_in_time"), ({"time_delta_days": 179}, "too_near_in_time"), ({"target_document": "d1"}, "same_source_and_target_document"), ({"source_document": None, "target_document": None}, ""),
    ({"target_name": "Topic Lexicon codings"}, "label_variant:same_core_label"), ({"source_name": "machine learning", "target_name": "topic model"}, "generic_predecessor_source"), ({"source_name": "political science"}, "weak_source_label"),
    ({"source_name": "ring"}, "weak_source_label"), ({"source_name": "gpt"}, ""), ({"source_name": "many tiny lake steps"}, "weak_source_label"), ({"source_name": "river baseline scores"}, "baseline_source_not_predecessor"), ({"source_name": "lake inference"}, "weak_source_label"),
    ({"target_name": "river posts"}, "weak_target_label"), ({"target_name": "river lake methods"}, "broad_target_label"), ({"target_name": None}, "weak_target_label"), ({"target_type": "data_source", "target_name": "neural river lake"}, "misbucketed_data_source_label"),
    ({"source_name": "river flow detection"}, "source_is_task_not_predecessor"), ({"source_name": "river flow detection", "target_name": "fast river watch"}, ""), ({"source_name": "river flow detection", "source_type": "x", "schema_group": None}, ""),
    ({"edge_type": "generalizes", "target_name": "topic lexicon"}, "label_variant:") , ({"edge_type": "generalizes", "source_name": "stance river lexicon coding", "target_name": "river coding"}, "broad_generalization_not_display_edge"),
    ({"source_name": "graph cnn encoder", "target_name": "deep lstm attention", "candidate_reasons": []}, "generic_ml_architecture_not_css_evolution"), ({"source_name": "graph cnn encoder", "target_name": "deep lstm attention"}, ""),
    ({"source_name": "graph cnn encoder", "rationale": "It does not explicitly cite it"}, "generic_ml_architecture_not_css_evolution"), ({"candidate_reasons": None}, "weak_lineage_evidence"), ({"candidate_reasons": ["target_text_mentions_source"]}, "weak_lineage_evidence"),
    ({"candidate_reasons": ["target_text_mentions_source"], "target_quote": "we outperform it"}, ""), ({"candidate_reasons": [], "target_quote": "lexicon and forest scale"}, ""), ({"candidate_reasons": [], "target_quote": "lexicon f1 score"}, "weak_lineage_evidence"),
    ({"candidate_reasons": [], "edge_type": "improves", "target_quote": "lexicon f1 score"}, ""),
]
SCHEMA = "n int, accepted boolean, edge_type string, confidence double, time_delta_days int, source_document string, target_document string, source_name string, target_name string, source_type string, target_type string, schema_group string, candidate_reasons array<string>, source_quote string, target_quote string, rationale string"


def test_rules_of_the_display(spark):
    cases = [c for c in CASES if not c[1].endswith(":")]
    rows = spark.createDataFrame([(k, *(GOOD | change).values()) for k, (change, _) in enumerate(cases)], SCHEMA)
    found = {r.n: r.reason for r in display.with_rejection(rows).collect()}
    assert [(cases[k][0], found[k]) for k in range(len(cases))] == cases
    assert {r.n for r in display.shown(rows).collect()} == {k for k, c in enumerate(cases) if not c[1]}
    assert display.with_rejection(rows.limit(0)).collect() == []


def test_types_of_the_ends(spark):
    rows = [("a", "b", "m__x"), ("", "method", "m__x"), (None, "analytic_method", "m__x"), (None, "analytic_method", "x"), (None, None, None)]
    frame = spark.createDataFrame(rows, "own string, kind string, id string")
    assert [r.t for r in frame.select(display.end_type(F.col("own"), F.col("kind"), F.col("id")).alias("t")).collect()] == ["a", "method", "m", "analytic_method", ""]
    table = spark.createDataFrame([("method", None, None, None, "data_source__x", "y__z"), (None, None, "q", "given", "data_source__x", "plain")], "entity_type string, source_entity_type string, target_entity_type string, schema_group string, source string, target string")
    assert [(r.schema_group, r.source_type, r.target_type) for r in display.resolved(table).collect()] == [("analytic_method", "method", "method"), ("given", "data_source", "q")]


def test_a_report_says_what_it_leaves_out(spark):
    frame = spark.range(7).coalesce(1)
    assert reports.markdown(frame, "Ids", 5).splitlines()[-1] == "2 more rows."
    assert "more rows" not in reports.markdown(frame, "Ids", 7)
