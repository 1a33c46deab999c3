"""What is moved: texts and edges once, by one key, and not what is made of them."""

from pyspark.sql import functions as F

from loomspan.operators import coevolution, corpus, display, graph, induction


def moves(df):
    return str(df.select("*")._jdf.queryExecution().executedPlan()).count("Exchange hashpartitioning")  # of a plan that hasn't run


def test_an_index_moves_texts_once(spark):
    docs = spark.createDataFrame([(1, "b a  b"), (2, ""), (3, None), (4, " x ")], "doc_id long, text string")
    out = corpus.text_of_index(corpus.inverted_index(docs))
    assert moves(out) == 1
    assert {r.doc_id: r.text for r in out.collect()} == {1: "b a b", 2: "", 3: "", 4: "x"}


def test_terms_move_texts_once_and_count_documents_once(spark):
    rows = [(1, "tidal stage one", "tidal stage one tidal stage"), (1, "tidal stage one", "tidal stage one"), (2, "the 12 34", "tidal stage"), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, title string, text string").withColumn("keywords", F.array(F.lit("lake water"))).withColumn("concepts", F.lit(None).cast("array<string>"))
    terms = induction.corpus_terms(induction.phrase_rows(docs), 10)
    assert moves(terms) == 2
    found = {r.phrase: r.support for r in terms.collect()}
    assert found == {"tidal stage": 2, "stage one": 1, "tidal stage one": 1, "lake water": 3, "stage one tidal": 1, "one tidal": 1, "one tidal stage": 1}
    phrases = induction.corpus_phrases(docs)
    assert phrases.count() == phrases.distinct().count() == sum(1 for _ in phrases.select("doc_id", "phrase", "source").collect())


def test_aggregated_edges_move_once_for_documents(spark):
    rows = [("a", "b", "extends", "d1", "d2", "n1", 0.5, True), ("a", "b", "extends", "d2", None, "n2", 0.7, False), ("b", "a", "extends", "d1", "d1", "n1", 0.1, True)]
    e = spark.createDataFrame(rows, "source string, target string, edge_type string, source_document string, target_document string, node_id string, confidence double, verified boolean")
    out = graph.aggregate_edges(e)
    assert moves(out) == 2
    assert sorted(map(tuple, out.collect())) == [("a", "b", "extends", 2, 2, ["n1", "n2"], 0.6, 1), ("b", "a", "extends", 1, 1, ["n1"], 0.1, 1)]


def test_figures_speak_without_quotes(spark):
    rows = [(False, "extends", 0.9, 400, "a", "b"), (True, "extends", 0.9, 400, "a", "a"), (True, "extends", 0.9, 400, "a", "b"), (True, "uses", None, None, None, None)]
    frame = spark.createDataFrame(rows, "accepted boolean, edge_type string, confidence double, time_delta_days int, source_document string, target_document string")
    assert [r[0] for r in frame.select(display.by_figures()).collect()] == ["raw_rejected", "same_source_and_target_document", "", "relation_type_not_for_display"]


def test_texts_are_not_moved_to_their_candidates(spark):
    signals = spark.createDataFrame([("n", 0.9, "depth_expansion"), ("m", 0.1, "x")], "node_id string, score double, action string")
    nodes = spark.createDataFrame([("n", None, "d", "lake"), ("m", None, "d", "sea")], "node_id string, parent_id string, dimension string, label string")
    docs = spark.createDataFrame([("n", k, "tidal stage") for k in range(4)] + [("m", 9, "tidal stage")], "node_id string, doc_id long, text string")
    candidates, documents = coevolution.propose_expansions(signals, docs, nodes, 0.5, 1)
    assert [(r.label, r.trigger_node_id) for r in candidates.collect()] == [("tidal stage", "n")]
    assert sorted(r.doc_id for r in documents.collect()) == [0, 1, 2, 3]
    assert moves(documents) == 0 and documents.inputFiles()  # written: read for the support and for what is assigned
