"""Queries over taxonomy, entities, edges, paths, windows, states and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.operators import corpus, graph, insight, windows
from loomspan.plans import registry
from loomspan.plans import tables as tb
from loomspan.plans.registry import query
from loomspan.plans.text_queries import tok


@query("src06_tree_flatten", "SELECT 'r' || r_regionkey AS node, 'r' || r_regionkey AS root, 0 AS level FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 1 FROM nation UNION ALL SELECT 's' || s_suppkey, 'r' || n_regionkey, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(spark, d):
    name = lambda p, c: F.concat(F.lit(p), F.col(c))
    rows = tb.table(spark, d, "region").select(name("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"))
    rows = rows.unionByName(tb.table(spark, d, "nation").select(name("n", "n_nationkey").alias("node"), name("r", "n_regionkey").alias("parent")))
    rows = rows.unionByName(tb.table(spark, d, "supplier").select(name("s", "s_suppkey").alias("node"), name("n", "s_nationkey").alias("parent")))
    return corpus.flatten_tree(rows, "node", "parent")


@query("src07_set01_assignments", "SELECT node_id, count(*) AS n FROM (SELECT doc_id, node_id FROM assignment UNION SELECT doc_id, lang FROM documents) GROUP BY 1", tb.ASSIGNMENTS)
def _(spark, d):
    again = tb.table(spark, d, "documents").select("doc_id", F.col("lang").alias("node_id"))
    return tb.assignments(spark, d).unionByName(again).distinct().groupBy("node_id").agg(F.count("*").alias("n"))


@query("src12_overlap_distribution", "SELECT buckets, count(*) AS ids FROM (SELECT l_partkey, count(DISTINCT l_returnflag) AS buckets FROM lineitem GROUP BY 1) GROUP BY 1")
def _(spark, d):
    return corpus.overlap_distribution(tb.table(spark, d, "lineitem"), "l_partkey", "l_returnflag")


@query("src13_work_rows", "SELECT CASE WHEN coalesce(url, '') = '' THEN 'missing_title' WHEN length(html) < 400 THEN 'missing_abstract' WHEN NOT contains(lower(html), '<p>') THEN 'low_relevance' ELSE 'kept' END AS reason, count(*) AS n FROM pages GROUP BY 1")
def _(spark, d):
    reason = F.when(F.coalesce("url", F.lit("")) == "", "missing_title").when(F.char_length("html") < 400, "missing_abstract").when(~F.contains(F.lower("html"), F.lit("<p>")), "low_relevance").otherwise("kept")
    return tb.table(spark, d, "pages").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("src14_first_wins", "SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey, l_extendedprice)) AS l_partkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS buckets FROM lineitem GROUP BY 1")
def _(spark, d):
    rows = tb.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_returnflag")
    return corpus.first_wins(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_extendedprice"], "l_returnflag").select("l_orderkey", "l_partkey", F.array_join("buckets", ",").alias("buckets"))


@query("src17_shard_merge", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def _(spark, d):
    return corpus.last_wins(tb.table(spark, d, "events").select("user_id", "event_type", "event_id", F.col("event_id").alias("seq")), "user_id", "seq").select("user_id", "event_type", "event_id")


@query("joi01_support", "SELECT node_id, count(DISTINCT a.doc_id) AS n_docs FROM assignment a JOIN labels l ON a.doc_id = l.doc_id GROUP BY 1", tb.ASSIGNMENTS)
def _(spark, d):
    return corpus.support(tb.assignments(spark, d), tb.table(spark, d, "labels"))


_ALIAS = "(VALUES ('time', 'the'), ('time', 'and'), ('law', 'license'), ('law', 'public license'), ('place', 'que'), ('place', 'under the'))"


@query("joi02_phrase_assignment", f"""SELECT node_id, slice, count(DISTINCT doc_id) AS docs FROM document, {_ALIAS} n(node_id, alias) WHERE regexp_matches(lower(text), '(^|[^a-z0-9])' || alias || '($|[^a-z0-9])') GROUP BY 1, 2""", tb.DOCUMENTS)
def _(spark, d):
    aliases = spark.createDataFrame([("time", "the"), ("time", "and"), ("law", "license"), ("law", "public license"), ("place", "que"), ("place", "under the")], "node_id string, alias string")
    docs = tb.documents(spark, d)
    return corpus.assign_by_phrase(docs, aliases).join(docs.select("doc_id", "slice"), "doc_id").groupBy("node_id", "slice").agg(F.count("*").alias("docs"))


@query("joi12_set04_taxonomy_events", """WITH b AS (SELECT * FROM node WHERE label NOT LIKE '%7' AND node_id NOT LIKE 'fr%'), p AS (SELECT node_id, parent_id, CASE WHEN label LIKE '%3' THEN label || ' old' ELSE label END AS label FROM b)
SELECT node_id, 'birth' AS event FROM node WHERE node_id NOT IN (SELECT node_id FROM p) UNION ALL SELECT node.node_id, 'rename' FROM node JOIN p ON node.node_id = p.node_id WHERE node.label <> p.label
UNION ALL SELECT n.parent_id, 'split' FROM (SELECT parent_id, count(*) AS k FROM node WHERE parent_id IS NOT NULL GROUP BY 1) n LEFT JOIN (SELECT parent_id, count(*) AS k FROM p WHERE parent_id IS NOT NULL GROUP BY 1) q ON n.parent_id = q.parent_id WHERE n.k >= 2 AND coalesce(q.k, 0) < 2""", tb.NODES)  # fmt: skip
def _(spark, d):
    now = tb.nodes(spark, d)
    before = now.where("label not like '%7' and node_id not like 'fr%'").withColumn("label", F.when(F.col("label").endswith("3"), F.concat("label", F.lit(" old"))).otherwise(F.col("label")))
    return corpus.taxonomy_events(now, before)


@query("agg02_entities", "SELECT entity_id, arg_min(canonical_name, (published_at, doc_id, seq)) AS canonical_name, min(published_at) AS first_seen, count(*) AS mentions, count(DISTINCT doc_id) AS n_docs, array_to_string(list_sort(list(DISTINCT node_id)), ',') AS nodes FROM mention GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2", tb.MENTIONS)
def _(spark, d):
    return corpus.build_entities(tb.mentions(spark, d), 2).select("entity_id", "canonical_name", "first_seen", "mentions", "n_docs", F.array_join("nodes", ",").alias("nodes"))


@query("agg03_entity_frequency", "SELECT entity_type, count(DISTINCT entity_id) AS entities, count(*) AS mentions FROM mention GROUP BY 1", tb.MENTIONS)
def _(spark, d):
    return tb.mentions(spark, d).groupBy("entity_type").agg(F.count_distinct("entity_id").alias("entities"), F.count("*").alias("mentions"))


@query("joi10_agg04_canonical", """WITH e AS (SELECT DISTINCT entity_id, canonical_name, entity_type FROM part_entity), k AS (SELECT entity_id, entity_type, CASE canonical_name WHEN 'red ring' THEN 'blue bolt' WHEN 'small ring' THEN 'large ring' ELSE canonical_name END AS norm FROM e)
SELECT k.entity_id, min(c.entity_id) AS canonical_id FROM k JOIN k c ON k.entity_type = c.entity_type AND k.norm = c.norm GROUP BY k.entity_id""", tb.PARTS)  # fmt: skip
def _(spark, d):
    entities = tb.parts(spark, d).select("entity_id", "canonical_name", "entity_type").distinct()
    aliases = spark.createDataFrame([("red ring", "blue bolt"), ("small ring", "large ring")], "alias string, target string")
    return corpus.canonical_links(entities, aliases)


@query("joi11_str18_similar_entities")
def _(spark, d):
    return corpus.merge_similar(tb.parts(spark, d).select("entity_id", "canonical_name", "entity_type").distinct())


_QUALITY = """WITH e AS (SELECT entity_id, arg_min(canonical_name, (published_at, doc_id, seq)) AS name, count(*) AS mentions, count(DISTINCT doc_id) AS n_docs FROM mention GROUP BY 1),
t AS (SELECT *, len({t}) AS n FROM e),
q AS (SELECT entity_id, round(greatest(0.0, least(1.0, 0.45::DOUBLE + CASE WHEN n = 0 THEN -0.5 ELSE 0 END + CASE WHEN n BETWEEN 1 AND 4 THEN 0.18 WHEN n > 6 THEN -0.28 ELSE 0 END
  + CASE WHEN n >= 4 AND n_docs < 2 AND mentions < 2 THEN -0.12 ELSE 0 END + CASE WHEN substr(name, 1, 1) <> lower(substr(name, 1, 1)) AND n <= 4 THEN 0.08 ELSE 0 END + CASE WHEN regexp_matches(name, '\\d') THEN 0.04 ELSE 0 END
  + CASE WHEN regexp_matches(name, '[-_]') THEN 0.04 ELSE 0 END + CASE WHEN mentions >= 2 THEN 0.12 ELSE 0 END + CASE WHEN n_docs >= 2 THEN 0.1 ELSE 0 END)), 3) AS quality FROM t)
SELECT entity_id, quality, CASE WHEN quality >= 0.42 THEN 'kept' ELSE 'filtered' END AS status FROM q"""


@query("fil02_entity_quality", _QUALITY.replace("{t}", tok("name")), tb.MENTIONS)
def _(spark, d):
    return corpus.entity_quality(corpus.build_entities(tb.mentions(spark, d))).select("entity_id", "quality", "status")


@query("agg05_top_phrases", f"""WITH t AS (SELECT lang, {tok('text')} AS t FROM documents), g AS (SELECT lang, 1 AS n, unnest(t) AS phrase FROM t UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM t),
c AS (SELECT lang, n, phrase, count(*) AS cnt FROM g GROUP BY 1, 2, 3), r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY n DESC, cnt DESC, phrase)::INTEGER AS rank, phrase, cnt FROM c) SELECT * FROM r WHERE rank <= 8""")  # fmt: skip
def _(spark, d):
    return corpus.top_phrases(tb.table(spark, d, "documents"), "lang", 8)


_MEMBERS = "m AS (SELECT a.node_id, a.doc_id, published_at FROM assignment a JOIN document d ON a.doc_id = d.doc_id)"


@query("agg06_node_enrichment", f"""WITH {_MEMBERS}, l AS (SELECT node_id, max(year(published_at)) AS last, count(DISTINCT doc_id) AS n_docs FROM m GROUP BY 1),
r AS (SELECT m.node_id, n_docs, round(1 / sqrt(n_docs + 1), 3) AS uncertainty, round(sum(CASE WHEN year(published_at) >= last - 1 THEN 1 ELSE 0 END)::DOUBLE / count(*), 3) AS novelty FROM m JOIN l ON m.node_id = l.node_id GROUP BY m.node_id, n_docs)
SELECT *, CASE WHEN n_docs < 3 THEN 'emerging' WHEN novelty >= 0.75 THEN 'growing' WHEN n_docs >= 10 THEN 'mature' ELSE 'emerging' END AS status FROM r""", tb.DOCUMENTS, tb.ASSIGNMENTS)  # fmt: skip
def _(spark, d):
    return corpus.node_enrichment(tb.assignments(spark, d).join(tb.documents(spark, d).select("doc_id", "published_at"), "doc_id"))


@query("agg07_hlp17_node_quality", """WITH s AS (SELECT node_id, count(DISTINCT doc_id) AS n FROM assignment GROUP BY 1), k AS (SELECT parent_id AS node_id, count(*) AS kids FROM node WHERE parent_id IS NOT NULL GROUP BY 1)
SELECT node.node_id, CASE WHEN count(*) OVER (PARTITION BY lower(label)) > 1 THEN 0.4 ELSE 1.0 END AS uniqueness, round(least(1.0, coalesce(n, 0)::DOUBLE / 5), 3) AS coverage, CASE WHEN coalesce(kids, 0) > 10 THEN 0.6 WHEN coalesce(kids, 0) > 0 THEN 0.8 ELSE 0.7 END AS granularity,
CASE WHEN parent_id IS NULL THEN 0.8 WHEN max(len(string_split(label, ' '))) OVER w - min(len(string_split(label, ' '))) OVER w <= 3 THEN 0.85 ELSE 0.6 END AS siblings
FROM node LEFT JOIN s ON node.node_id = s.node_id LEFT JOIN k ON node.node_id = k.node_id WINDOW w AS (PARTITION BY parent_id)""", tb.ASSIGNMENTS, tb.NODES)  # fmt: skip
def _(spark, d):
    support = tb.assignments(spark, d).groupBy("node_id").agg(F.count_distinct("doc_id").alias("n_docs"))
    return corpus.node_quality(tb.nodes(spark, d), support)


@query("agg08_heterogeneity", f"""WITH c AS (SELECT lang, doc_id, text, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS nth FROM documents),
s AS (SELECT lang, doc_id, list_distinct({tok('text')}) AS t FROM c WHERE floor(floor((nth + greatest(1.0::DOUBLE, n / 120.0::DOUBLE) - 1e-9::DOUBLE) / greatest(1.0::DOUBLE, n / 120.0::DOUBLE)) * greatest(1.0::DOUBLE, n / 120.0::DOUBLE)) = nth)
SELECT a.lang, count(*) AS pairs, round(greatest(0.0, 1 - avg(CASE WHEN len(list_distinct(list_concat(a.t, b.t))) > 0 THEN len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t))) ELSE 0.0 END)), 6) AS heterogeneity FROM s a JOIN s b ON a.lang = b.lang AND a.doc_id < b.doc_id GROUP BY 1""")  # fmt: skip
def _(spark, d):
    return insight.heterogeneity(tb.table(spark, d, "documents"), "lang")


@query("sco07_agg08_expansion", """WITH s AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2), g AS (SELECT p_brand, sum(n) AS n, max(n)::DOUBLE / sum(n) AS burst, count(*)::DOUBLE / 6 AS spread FROM s GROUP BY 1),
f AS (SELECT p_brand, least(1.0::DOUBLE, n / 10.0::DOUBLE) AS density, 0.4::DOUBLE AS mass, spread AS heterogeneity, least(1.0::DOUBLE, 1 / sqrt(n)) AS uncertainty, burst FROM g)
SELECT p_brand, round(0.15 * density + 0.12 * mass + 0.18 * heterogeneity + 0.12 * uncertainty + 0.12 * burst + 0.13 * burst + 0.10 * 0.5 + 0.08 * 0.25, 3) AS score, CASE WHEN mass >= 0.4 AND burst >= 0.5 THEN 'width_expansion' WHEN density >= 0.5 AND heterogeneity >= 0.55 THEN 'depth_expansion' WHEN uncertainty >= 0.7 THEN 'assignment_review' ELSE 'monitor' END AS action FROM f""")  # fmt: skip
def _(spark, d):
    s = tb.table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    g = s.groupBy("p_brand").agg(F.sum("n").alias("n"), F.max("n").alias("m"), (F.count("*") / 6).alias("h")).withColumn("burst", F.col("m") / F.col("n"))
    density, mass, unsure = F.least(F.lit(1.0), F.col("n") / 10.0), F.lit(0.4), F.least(F.lit(1.0), 1 / F.sqrt("n"))
    score = insight.expansion_score(density, mass, F.col("h"), unsure, F.col("burst"), F.col("burst"), F.lit(0.5), F.lit(0.25))
    return g.select("p_brand", score.alias("score"), insight.expansion_action(mass, F.col("burst"), density, F.col("h"), unsure).alias("action"))


_ENT = "ent AS (SELECT entity_id, node_id, min(published_at) AS first_seen, count(DISTINCT doc_id) AS n_docs FROM mention GROUP BY 1, 2)"
_TOP = "top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY n_docs DESC, first_seen, entity_id)::INTEGER AS rank FROM ent) WHERE rank <= 10)"


def _entities(spark, d):
    return tb.mentions(spark, d).groupBy("entity_id", "node_id").agg(F.min("published_at").alias("first_seen"), F.count_distinct("doc_id").alias("n_docs"))


@query("win04_top_entities", f"WITH {_ENT}, {_TOP} SELECT node_id, rank, entity_id, n_docs, first_seen FROM top", tb.MENTIONS)
def _(spark, d):
    return graph.top_per_group(_entities(spark, d), ["node_id"], [F.desc("n_docs"), "first_seen", "entity_id"], 10).select("node_id", "rank", "entity_id", "n_docs", "first_seen")


@query("joi04_entity_pairs", f"WITH {_ENT}, {_TOP} SELECT a.node_id, a.entity_id AS source, b.entity_id AS target FROM top a JOIN top b ON a.node_id = b.node_id WHERE a.entity_id <> b.entity_id AND a.first_seen <= b.first_seen", tb.MENTIONS)
def _(spark, d):
    return graph.entity_pairs(_entities(spark, d), "node_id", 10)


@query("joi05_pair_limit", """WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS day, o_orderstatus FROM orders), p AS (SELECT s.o_custkey, s.o_orderkey AS source, t.o_orderkey AS target, row_number() OVER (PARTITION BY s.o_custkey ORDER BY t.day, t.o_orderkey, s.day, s.o_orderkey)::INTEGER AS rank
  FROM o s JOIN o t ON s.o_custkey = t.o_custkey AND s.day <= t.day AND s.o_orderkey <> t.o_orderkey) SELECT * FROM p WHERE rank <= 3""")  # fmt: skip
def _(spark, d):
    o = tb.table(spark, d, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"))
    return graph.first_pairs(o, ["o_custkey"], "day", "o_orderkey", 3)


@query("joi06_mention_flags", """WITH m AS (SELECT DISTINCT entity_id, doc_id FROM mention) SELECT edge_id, a.doc_id IS NOT NULL AS source_in_target, b.doc_id IS NOT NULL AS target_in_source
FROM edge LEFT JOIN m a ON edge.source = a.entity_id AND edge.target_document = a.doc_id LEFT JOIN m b ON edge.target = b.entity_id AND edge.source_document = b.doc_id""", tb.MENTIONS, tb.EDGES.replace(tb.PARTS + ", ", ""))  # fmt: skip
def _(spark, d):
    m = tb.mentions(spark, d).select("entity_id", "doc_id").distinct().withColumn("yes", F.lit(True))
    a = m.select(F.col("entity_id").alias("source"), F.col("doc_id").alias("target_document"), F.col("yes").alias("a"))
    b = m.select(F.col("entity_id").alias("target"), F.col("doc_id").alias("source_document"), F.col("yes").alias("b"))
    e = tb.edges(spark, d).join(a, ["source", "target_document"], "left").join(b, ["target", "source_document"], "left")
    return e.select("edge_id", F.col("a").isNotNull().alias("source_in_target"), F.col("b").isNotNull().alias("target_in_source"))


@query("joi07_merged_pairs", "SELECT source, target, source_document, target_document, array_to_string(list_sort(list(DISTINCT node_id)), ',') AS nodes, max(confidence) AS score FROM edge GROUP BY 1, 2, 3, 4", tb.EDGES)
def _(spark, d):
    return tb.edges(spark, d).groupBy("source", "target", "source_document", "target_document").agg(F.array_join(F.array_sort(F.collect_set("node_id")), ",").alias("nodes"), F.max("confidence").alias("score"))


@query("joi09_remap", """WITH e AS (SELECT DISTINCT entity_id, canonical_name, entity_type FROM part_entity), l AS (SELECT e.entity_id, min(c.entity_id) AS canonical_id FROM e JOIN e c ON e.canonical_name = c.canonical_name GROUP BY 1),
m AS (SELECT edge_id, s.canonical_id AS source, t.canonical_id AS target, edge_type, confidence FROM edge JOIN l s ON source = s.entity_id JOIN l t ON target = t.entity_id)
SELECT source, target, edge_type, arg_max(edge_id, (confidence, -edge_id)) AS edge_id, max(confidence) AS confidence FROM m WHERE source <> target GROUP BY 1, 2, 3""", tb.EDGES)  # fmt: skip
def _(spark, d):
    e = tb.parts(spark, d).select("entity_id", "canonical_name").distinct()
    links = e.join(e.groupBy("canonical_name").agg(F.min("entity_id").alias("canonical_id")), "canonical_name").select("entity_id", "canonical_id")
    return graph.remap_edges(tb.edges(spark, d), links)


_BASE = "CASE WHEN edge_type = 'background' THEN 0.35 ELSE round(least(0.95, 0.45::DOUBLE + CASE WHEN edge_type IN ('extends', 'improves', 'replaces', 'adapts') THEN 0.2 ELSE 0 END + CASE WHEN verified THEN 0.15 ELSE 0 END + CASE WHEN source_type = target_type THEN 0.1 ELSE 0 END + CASE WHEN time_delta_days >= 0 THEN 0.1 ELSE 0 END), 3) END"
_TEMPORAL = "CASE WHEN time_delta_days IS NULL THEN 0.6 WHEN time_delta_days < 0 THEN 0.0 WHEN time_delta_days = 0 THEN 0.8 ELSE 1.0 END::DOUBLE"
_SCORE = f"round(greatest(0.0, least(1.0, 0.30::DOUBLE * confidence + 0.22::DOUBLE * (CASE WHEN verified THEN 1.0 ELSE 0.45 END)::DOUBLE + 0.16::DOUBLE * ({_TEMPORAL}) + 0.12::DOUBLE * (CASE WHEN source_type = target_type THEN 1.0 ELSE 0.55 END)::DOUBLE + 0.12::DOUBLE * (CASE WHEN edge_type IN ('extends', 'improves', 'replaces', 'adapts') THEN 1.0 ELSE 0.8 END)::DOUBLE + 0.08::DOUBLE * 0.8::DOUBLE)), 3)"
_STATUS = "CASE WHEN edge_type IN ('extends', 'improves', 'replaces', 'adapts') AND confidence >= 0.65 AND verified THEN 'trusted' WHEN confidence >= 0.35 THEN 'candidate' ELSE 'unverified' END"


@query("sco01_base_confidence", f"SELECT edge_id, ({_BASE})::DOUBLE AS base FROM edge", tb.EDGES)
def _(spark, d):
    e = tb.edges(spark, d)
    return e.select("edge_id", graph.base_confidence(F.col("edge_type"), F.col("verified"), F.col("source_type") == F.col("target_type"), F.col("time_delta_days")).alias("base"))


def _scored(e):
    return e.withColumn("score", graph.edge_score(F.col("confidence"), F.when(F.col("verified"), 1.0).otherwise(0.45), graph.temporal_score(F.col("time_delta_days")), F.when(F.col("source_type") == F.col("target_type"), 1.0).otherwise(0.55), F.when(F.col("edge_type").isin(graph.STRONG), 1.0).otherwise(0.8), F.lit(0.8)))


@query("sco02_edge_score", f"SELECT edge_id, {_SCORE} AS score FROM edge", tb.EDGES)
def _(spark, d):
    return _scored(tb.edges(spark, d)).select("edge_id", "score")


_STEP = f"round((0.34::DOUBLE * confidence + 0.24::DOUBLE * ({_TEMPORAL}) + 0.18::DOUBLE * (CASE WHEN verified THEN 1.0 ELSE 0.45 END)::DOUBLE + 0.14::DOUBLE * 0.8::DOUBLE + 0.10::DOUBLE * 0.55::DOUBLE) * 0.92::DOUBLE, 3)"


@query("sco05_step_score", f"SELECT edge_id, {_STEP} AS step FROM edge", tb.EDGES)
def _(spark, d):
    step = graph.step_score(F.col("confidence"), graph.temporal_score(F.col("time_delta_days")), F.when(F.col("verified"), 1.0).otherwise(0.45), F.lit(0.8), F.lit(0.55), 2)
    return tb.edges(spark, d).select("edge_id", step.alias("step"))


@query("fil03_stratify", f"SELECT edge_type, {_STATUS} AS status, count(*) AS n FROM edge GROUP BY 1, 2", tb.EDGES)
def _(spark, d):
    return tb.edges(spark, d).groupBy("edge_type", graph.stratum(F.col("edge_type"), F.col("confidence"), F.col("verified")).alias("status")).agg(F.count("*").alias("n"))


@query("fil04_first_tier", f"WITH s AS (SELECT edge_id, {_STATUS} AS status FROM edge) SELECT edge_id, status FROM s WHERE status = 'trusted'", tb.EDGES)
def _(spark, d):
    s = tb.edges(spark, d).select("edge_id", graph.stratum(F.col("edge_type"), F.col("confidence"), F.col("verified")).alias("status"))
    return graph.first_tier(s)


@query("fil05_successor_edges", "SELECT edge_id FROM edge WHERE source_type = target_type AND time_delta_days > 0", tb.EDGES)
def _(spark, d):
    return insight.successor_edges(tb.edges(spark, d)).select("edge_id")


@query("fil06_display_filter", """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN NOT verified THEN 'raw_rejected' WHEN edge_type NOT IN ('extends', 'improves') THEN 'relation_type_not_for_display' WHEN confidence < 0.6 THEN 'low_confidence' WHEN coalesce(time_delta_days, 0) < 180 THEN 'too_near_in_time' WHEN source_document = target_document THEN 'same_source_and_target_document' ELSE '' END AS reason FROM edge) GROUP BY 1""", tb.EDGES)
def _(spark, d):
    reason = insight.display_rejection(F.col("verified"), F.col("edge_type"), F.col("confidence"), F.col("time_delta_days"), F.col("source_document"), F.col("target_document"), ["extends", "improves"], 0.6, 180)
    return tb.edges(spark, d).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("fil10_audit_flags", """SELECT edge_id, array_to_string(list_filter([CASE WHEN confidence < 0.5 THEN 'low_confidence' END, CASE WHEN NOT verified THEN 'unverified' END, CASE WHEN time_delta_days < 0 THEN 'backwards' END, CASE WHEN source = target THEN 'self' END], lambda x: x IS NOT NULL), ',') AS flags FROM edge""", tb.EDGES)
def _(spark, d):
    flags = F.array_compact(F.array(F.when(F.col("confidence") < 0.5, "low_confidence"), F.when(~F.col("verified"), "unverified"), F.when(F.col("time_delta_days") < 0, "backwards"), F.when(F.col("source") == F.col("target"), "self")))
    return tb.edges(spark, d).select("edge_id", F.array_join(flags, ",").alias("flags"))


@query("win05_set02_best_edge", "SELECT source, target, arg_max(edge_id, (confidence, -edge_id)) AS edge_id, max(confidence) AS confidence FROM edge GROUP BY 1, 2", tb.EDGES)
def _(spark, d):
    return graph.best_per_key(tb.edges(spark, d).select("source", "target", "edge_id", "confidence"), ["source", "target"], [F.col("confidence"), -F.col("edge_id")])


@query("agg01_aggregate_edges", """SELECT source, target, edge_type, count(*) AS n_edges, len(list_distinct(list_concat(list(source_document), list(target_document)))) AS n_docs, array_to_string(list_sort(list(DISTINCT node_id)), ',') AS nodes, round(avg(confidence), 3) AS confidence, count(*) FILTER (verified) AS verified_count FROM edge GROUP BY 1, 2, 3""", tb.EDGES)
def _(spark, d):
    return graph.aggregate_edges(tb.edges(spark, d)).withColumn("nodes", F.array_join("nodes", ",")).withColumn("n_docs", F.col("n_docs").cast("long"))


@query("agg21_branch_points", "SELECT source, count(DISTINCT target) AS targets FROM edge WHERE verified AND edge_type IN ('extends', 'improves') GROUP BY 1 HAVING count(DISTINCT target) >= 2", tb.EDGES)
def _(spark, d):
    return graph.branch_points(tb.edges(spark, d))


@query("grf05_degrees", "SELECT entity_id, sum(o) AS out_degree, sum(i) AS in_degree FROM (SELECT source AS entity_id, 1 AS o, 0 AS i FROM edge UNION ALL SELECT target, 0, 1 FROM edge) GROUP BY 1", tb.EDGES)
def _(spark, d):
    return graph.degrees(tb.edges(spark, d))


def _beam_sql(depth: int, beam: int, fan: int) -> str:
    ctes = [f"w AS (SELECT source, target, max(confidence) AS weight FROM edge WHERE verified AND source <> target AND time_delta_days > 0 GROUP BY 1, 2), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY weight DESC, target) AS r FROM w) WHERE r <= {fan})"]
    ctes.append("c1 AS (SELECT source AS start, [source, target] AS path, target AS tip, weight AS total FROM o)")
    for k in range(1, depth + 1):
        if k > 1:
            ctes.append(f"c{k} AS (SELECT start, list_append(path, o.target) AS path, o.target AS tip, total + o.weight AS total FROM b{k - 1} b JOIN o ON b.tip = o.source WHERE NOT list_contains(path, o.target))")
        ctes.append(f"b{k} AS (SELECT * FROM (SELECT *, round(total / {k}, 6) AS score, row_number() OVER (PARTITION BY start ORDER BY round(total / {k}, 6) DESC, array_to_string(path, '>')) AS r FROM c{k}) WHERE r <= {beam})")
    return f"WITH {', '.join(ctes)} " + " UNION ALL ".join(f"SELECT start, array_to_string(path, '>') AS path, score, {k} AS depth FROM b{k}" for k in range(1, depth + 1))


def _weights(spark, d):
    e = tb.edges(spark, d).where("verified and source <> target and time_delta_days > 0")
    return e.groupBy("source", "target").agg(F.max("confidence").alias("weight"))


@query("grf01_chains", _beam_sql(4, 5, 5), tb.EDGES)
def _(spark, d):
    return graph.beam_paths(_weights(spark, d), 4, 5, 5)


@query("grf02_beam_of_4", _beam_sql(4, 6, 6), tb.EDGES)
def _(spark, d):
    return graph.beam_paths(_weights(spark, d), 4, 6, 6)


def _trajectory_sql(depth: int, beam: int, fan: int) -> str:
    temporal = "(CASE WHEN time_delta_days IS NULL THEN 0.6 WHEN time_delta_days < 0 THEN 0.0 WHEN time_delta_days = 0 THEN 0.8 ELSE 1.0 END)::DOUBLE"
    step = lambda k: f"round((0.34::DOUBLE * confidence + 0.24::DOUBLE * temporal + 0.18::DOUBLE * 1.0::DOUBLE + 0.14::DOUBLE * 0.75::DOUBLE + 0.10::DOUBLE * 1.0::DOUBLE) * {max(0.75, 1 - 0.04 * k)}::DOUBLE, 3) AS s{k}"
    ctes = [f"g AS (SELECT edge_id::VARCHAR AS edge_id, source, target, confidence, {temporal} AS temporal FROM edge WHERE verified AND confidence > 0 AND time_delta_days >= 0 AND edge_type IN ('extends', 'improves', 'replaces', 'adapts')), w AS (SELECT *, {', '.join(map(step, range(depth)))} FROM g)"]
    ctes.append(f"deg AS (SELECT source, count(*) AS degree FROM w GROUP BY 1), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY s0 DESC, target, edge_id) AS r FROM w) WHERE r <= {fan})")
    for k in range(depth):
        if k == 0:
            ctes.append("c0 AS (SELECT source AS start, [source, target] AS path, [edge_id] AS steps, target AS tip, s0 AS total, confidence AS sure, temporal AS time FROM o WHERE source <> target)")
        else:
            ctes.append(f"c{k} AS (SELECT start, list_append(path, o.target) AS path, list_append(steps, o.edge_id) AS steps, o.target AS tip, total + o.s{k} AS total, sure + o.confidence AS sure, time + o.temporal AS time FROM b{k - 1} b JOIN o ON b.tip = o.source WHERE NOT list_contains(path, o.target))")
        ctes.append(f"b{k} AS (SELECT * FROM (SELECT *, round(total / {k + 1}, 3) AS score, {k + 1} AS length, row_number() OVER (PARTITION BY start ORDER BY round(total / {k + 1}, 3) DESC, path, steps) AS r FROM c{k}) WHERE r <= {beam})")
    every = " UNION ALL ".join(f"SELECT path, steps, score, length, round(sure / length, 3) AS sure, round(time / length, 3) AS time FROM b{k}" for k in range(depth))
    ctes.append(f"u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, steps) AS r FROM ({every})) WHERE r = 1)")
    ctes.append("x AS (SELECT path, max(degree) AS branching FROM (SELECT path, unnest(path) AS source FROM u) y JOIN deg ON y.source = deg.source GROUP BY 1)")
    return f"WITH {', '.join(ctes)} SELECT array_to_string(u.path, '>') AS entity_path, array_to_string(steps, '>') AS edge_path, score AS trajectory_score, length::INTEGER AS path_length, sure AS mean_edge_confidence, time AS temporal_coherence, 1.0::DOUBLE AS quote_grounding, branching AS branching_factor FROM u JOIN x ON u.path = x.path"


@query("grf02_trajectories", _trajectory_sql(4, 6, 6), tb.EDGES)
def _(spark, d):
    return graph.trajectories(tb.edges(spark, d), 4, 6, 6).withColumn("entity_path", F.array_join("entity_path", ">")).withColumn("edge_path", F.array_join("edge_path", ">"))


@query("grf04_successor_edge_paths", f"""WITH RECURSIVE {tb.EDGES}, e AS (SELECT edge_id, source, target, confidence, time_delta_days AS days FROM edge WHERE verified AND source_type = target_type AND source < target),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY confidence DESC, days, target, edge_id::VARCHAR) AS r FROM e) WHERE r <= 4), free AS (SELECT DISTINCT source FROM e WHERE source NOT IN (SELECT target FROM e)),
p AS (SELECT [edge_id] AS edges, [source, target] AS path, target AS tip, confidence AS total FROM o WHERE source IN (FROM free) OR NOT EXISTS (FROM free)
 UNION ALL SELECT list_append(edges, o.edge_id), list_append(path, o.target), o.target, total + o.confidence FROM p JOIN o ON p.tip = o.source WHERE len(edges) < 4 AND NOT list_contains(path, o.target))
SELECT array_to_string(edges, '>') AS edge_path, array_to_string(path, '>') AS path, round(total / len(edges), 6)::DOUBLE AS score, len(edges)::INTEGER AS depth
FROM (SELECT [edge_id] AS edges, [source, target] AS path, confidence AS total FROM e UNION ALL SELECT edges, path, total FROM p WHERE len(edges) > 1)""")  # fmt: skip
def _(spark, d):
    return graph.successor_paths(tb.edges(spark, d).where("verified and source_type = target_type and source < target"), 4, 4)


@query("win01_adaptive_windows")
def _(spark, d):
    return windows.adaptive_windows(tb.events(spark, d), {"document": 100, "mention": 120, "edge": 90}, 1, 5).select("scope", "event_id", "window_index", "closed_by")


_FOLD = """WITH RECURSIVE {ctes}, e AS (SELECT scope, day, kind, event_id, row_number() OVER (PARTITION BY scope ORDER BY day, event_id) AS nth FROM event),
f AS (SELECT scope, nth, event_id, day, day AS start, (kind = 'document')::INTEGER AS d, (kind = 'mention')::INTEGER AS m, (kind = 'edge')::INTEGER AS g, 0 AS window_index, false AS closed FROM e WHERE nth = 1
 UNION ALL SELECT x.scope, x.nth, x.event_id, x.day, CASE WHEN x.closed THEN x.day ELSE x.start END, x.d, x.m, x.g, x.w, (datediff('day', CASE WHEN x.closed THEN x.day ELSE x.start END, x.day) >= 5) OR ((x.g >= 90 OR x.m >= 120 OR x.d >= 100) AND datediff('day', CASE WHEN x.closed THEN x.day ELSE x.start END, x.day) >= 1)
 FROM (SELECT e.scope, e.nth, e.event_id, e.day, f.start, f.closed, CASE WHEN f.closed THEN 0 ELSE f.d END + (e.kind = 'document')::INTEGER AS d, CASE WHEN f.closed THEN 0 ELSE f.m END + (e.kind = 'mention')::INTEGER AS m, CASE WHEN f.closed THEN 0 ELSE f.g END + (e.kind = 'edge')::INTEGER AS g, f.window_index + f.closed::INTEGER AS w
   FROM f JOIN e ON e.scope = f.scope AND e.nth = f.nth + 1) x)
SELECT scope || '__w' || lpad((window_index + 1)::VARCHAR, 4, '0') AS window_id, scope, min(day) AS start, max(day) AS "end", datediff('day', min(day), max(day))::INTEGER AS days, count(*) AS events FROM f GROUP BY scope, window_index"""


@query("win02_windows", _FOLD.replace("{ctes}", tb.EVENTS))
def _(spark, d):
    assigned = windows.adaptive_windows(tb.events(spark, d), {"document": 100, "mention": 120, "edge": 90}, 1, 5)
    return windows.window_rows(assigned).drop("trigger")


@query("win03_event_facts", "SELECT scope, count(*) AS n, min(day) AS first, max(day) AS last FROM (SELECT 'global' AS scope, published_at AS day FROM document UNION ALL SELECT 'node:' || m.node_id, m.published_at FROM mention m UNION ALL SELECT 'type:' || entity_type, m.published_at FROM mention m) GROUP BY 1", tb.DOCUMENTS, tb.MENTIONS)
def _(spark, d):
    m = tb.mentions(spark, d)
    facts = tb.documents(spark, d).select(F.lit("global").alias("scope"), F.col("published_at").alias("day"))
    for prefix, c in (("node:", "node_id"), ("type:", "entity_type")):
        facts = facts.unionByName(m.select(F.concat(F.lit(prefix), c).alias("scope"), F.col("published_at").alias("day")))
    return facts.groupBy("scope").agg(F.count("*").alias("n"), F.min("day").alias("first"), F.max("day").alias("last"))


@query("agg30_window_summary")
def _(spark, d):
    return windows.window_summary(windows.window_rows(windows.adaptive_windows(tb.events(spark, d), {"document": 100, "mention": 120, "edge": 90}, 1, 5)))


@query("win06_distinct_cap", """WITH r AS (SELECT doc_id, entity_id, min(seq) AS seq FROM mention GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq, entity_id)::INTEGER AS rank FROM r) SELECT doc_id, entity_id, rank FROM k WHERE rank <= 3""", tb.MENTIONS)
def _(spark, d):
    first = tb.mentions(spark, d).groupBy("doc_id", "entity_id").agg(F.min("seq").alias("seq"))
    return graph.top_per_group(first, ["doc_id"], ["seq", "entity_id"], 3).select("doc_id", "entity_id", "rank")


@query("win07_renumber", "SELECT p_brand, 'chain__' || lpad(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)::VARCHAR, 6, '0') AS chain_id, p_partkey FROM part")
def _(spark, d):
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    return tb.table(spark, d, "part").select("p_brand", F.format_string("chain__%06d", nth).alias("chain_id"), "p_partkey")


@query("win08_win09_top_edges", "SELECT edge_id, confidence FROM edge ORDER BY confidence DESC, edge_id LIMIT 100", tb.EDGES)
def _(spark, d):
    return tb.edges(spark, d).select("edge_id", "confidence").orderBy(F.desc("confidence"), "edge_id").limit(100)


@query("win10_top_per_target", "SELECT target, edge_id, rank FROM (SELECT target, edge_id, row_number() OVER (PARTITION BY target ORDER BY confidence DESC, edge_id)::INTEGER AS rank FROM edge) WHERE rank <= 6", tb.EDGES)
def _(spark, d):
    return graph.top_per_group(tb.edges(spark, d), ["target"], [F.desc("confidence"), "edge_id"], 6).select("target", "edge_id", "rank")


@query("win11_paging", "WITH g AS (SELECT source, count(*) AS degree FROM edge GROUP BY 1) SELECT source, degree FROM g WHERE contains(lower(source), 'ring') ORDER BY degree DESC, source LIMIT 10 OFFSET 5", tb.EDGES)
def _(spark, d):
    return insight.page(tb.edges(spark, d).groupBy("source").agg(F.count("*").alias("degree")), "ring", ["source"], [F.desc("degree"), "source"], 5, 10)


@query("win12_stratified_sample", """WITH r AS (SELECT o_orderkey, o_orderpriority, md5('7:' || o_orderkey) AS h FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY h, o_orderkey) AS nth, (SELECT count(DISTINCT o_orderpriority) FROM orders) AS strata FROM r)
SELECT o_orderkey, o_orderpriority FROM n ORDER BY (nth <= floor(60.0 / strata)) DESC, h, o_orderkey LIMIT 60""")  # fmt: skip
def _(spark, d):
    return insight.stratified(tb.table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 60)


@query("win13_quota_sample", f"""WITH e AS (SELECT edge_id, edge_type, {_STATUS} AS status FROM edge),
a AS (SELECT edge_id, edge_type, status FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY md5('7:' || edge_id), edge_id) AS r FROM e) WHERE r <= 20), b AS (SELECT edge_id, edge_type, status FROM (SELECT *, row_number() OVER (PARTITION BY status, edge_type ORDER BY md5('8:' || edge_id), edge_id) AS r FROM e) WHERE r <= 20)
SELECT * FROM a UNION SELECT * FROM b""", tb.EDGES)  # fmt: skip
def _(spark, d):
    e = tb.edges(spark, d).select("edge_id", "edge_type", graph.stratum(F.col("edge_type"), F.col("confidence"), F.col("verified")).alias("status"))
    return insight.quota_sample(e, [["status"], ["status", "edge_type"]], "edge_id", 20)


@query("agg09_feedback", """WITH p AS (SELECT node_id, count(*) AS edges, count(*) FILTER (verified AND edge_type IN ('extends', 'improves')) AS strong, count(DISTINCT CASE WHEN verified AND edge_type IN ('extends', 'improves') THEN target END) AS successors, count(DISTINCT CASE WHEN verified AND edge_type IN ('extends', 'improves') THEN source END) AS sources, count(DISTINCT source) AS entities FROM edge GROUP BY 1)
SELECT *, coalesce(nullif(array_to_string(list_filter([CASE WHEN successors >= 3 AND sources >= 2 THEN 'split_review' END, CASE WHEN entities >= 4 AND edges >= 4 THEN 'cross_link_review' END], lambda x: x IS NOT NULL), ','), ''), 'monitor') AS advice FROM p""", tb.EDGES)  # fmt: skip
def _(spark, d):
    return insight.feedback(tb.edges(spark, d))


@query("agg10_state_snapshot", "SELECT year, edge_type, count(*) AS n, round(avg(confidence), 6) AS confidence, round(avg(verified::INTEGER), 6) AS verified_rate FROM edge GROUP BY 1, 2", tb.EDGES)
def _(spark, d):
    return tb.edges(spark, d).groupBy("year", "edge_type").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"), F.round(F.avg(F.col("verified").cast("int")), 6).alias("verified_rate"))


_NODE_EVENT = "fact AS (SELECT event_type || user_id AS node_id, CASE WHEN event_type = 'signup' THEN 'birth' WHEN event_type = 'purchase' AND value > 30 THEN 'cross_link' WHEN event_type = 'error' AND value > 20 THEN 'state_update' WHEN event_type = 'click' THEN 'edge' ELSE 'other' END AS event, value, ts FROM events)"


def _facts(spark, d):
    e = tb.table(spark, d, "events")
    kind = F.when(F.col("event_type") == "signup", "birth").when((F.col("event_type") == "purchase") & (F.col("value") > 30), "cross_link").when((F.col("event_type") == "error") & (F.col("value") > 20), "state_update").when(F.col("event_type") == "click", "edge").otherwise("other")
    return e.select(F.concat("event_type", "user_id").alias("node_id"), kind.alias("event"), "value", "ts", "event_id")


@query("agg11_node_states", """SELECT node_id, CASE WHEN count(*) FILTER (event = 'cross_link') > 0 THEN 'bridging' WHEN count(*) FILTER (event = 'state_update') > 0 OR count(*) FILTER (event = 'edge') >= 3 THEN 'active' WHEN count(*) FILTER (event IN ('birth', 'split')) > 0 THEN 'emerging' ELSE 'stable' END AS state, count(*) FILTER (event = 'edge') AS edges FROM fact GROUP BY 1""", _NODE_EVENT)
def _(spark, d):
    return insight.node_states(_facts(spark, d))


@query("agg12_set03_transitions", f"""WITH s AS (SELECT edge_type, verified, time_delta_days, {_SCORE} AS score FROM edge), r AS (SELECT CASE WHEN time_delta_days < 0 THEN 'backwards' ELSE 'unverified' END AS reason FROM edge WHERE NOT verified OR time_delta_days < 0)
SELECT 'edge_downweighted' AS kind, edge_type AS key, count(*) AS n, NULL::DOUBLE AS confidence FROM s WHERE score < 0.55 GROUP BY 2 UNION ALL SELECT 'negative_relation', reason, count(*), round(least(0.95, 0.35 + 0.04 * count(*)), 3)::DOUBLE FROM r GROUP BY 2""", tb.EDGES)  # fmt: skip
def _(spark, d):
    e = _scored(tb.edges(spark, d))
    rejected = e.where("not verified or time_delta_days < 0").select(F.when(F.col("time_delta_days") < 0, "backwards").otherwise("unverified").alias("reason"))
    return insight.transitions(e, rejected)


@query("agg13_report_means", "SELECT edge_type, round(avg(confidence), 6) AS mean, round(min(confidence), 6) AS low, count(*) FILTER (confidence < 0.55) AS weak FROM edge GROUP BY 1", tb.EDGES)
def _(spark, d):
    return tb.edges(spark, d).groupBy("edge_type").agg(F.round(F.avg("confidence"), 6).alias("mean"), F.round(F.min("confidence"), 6).alias("low"), F.count_if(F.col("confidence") < 0.55).alias("weak"))


@query("agg14_quality_report", f"WITH s AS (SELECT confidence, verified, {_STATUS} AS status FROM edge) SELECT round(0.45 * avg((status = 'trusted')::INTEGER) + 0.25 * avg(verified::INTEGER) + 0.2 * avg(confidence) + 0.1 * (1 - avg((status = 'unverified')::INTEGER)), 6) AS edge_quality, count(*) AS edges FROM s", tb.EDGES)
def _(spark, d):
    s = tb.edges(spark, d).withColumn("status", graph.stratum(F.col("edge_type"), F.col("confidence"), F.col("verified")))
    score = 0.45 * F.avg((F.col("status") == "trusted").cast("int")) + 0.25 * F.avg(F.col("verified").cast("int")) + 0.2 * F.avg("confidence") + 0.1 * (1 - F.avg((F.col("status") == "unverified").cast("int")))
    return s.agg(F.round(score, 6).alias("edge_quality"), F.count("*").alias("edges"))


_FEATURE = "feature AS (SELECT event_id AS feature, strftime(ts, '%Y-%m-%d') AS slice, CASE event_type WHEN 'signup' THEN 'differentiation' WHEN 'purchase' THEN 'convergence' WHEN 'error' THEN 'stabilization' ELSE 'recontextualization' END AS pattern, (CASE event_type WHEN 'signup' THEN 0.48 WHEN 'purchase' THEN 0.65 WHEN 'error' THEN 0.35 ELSE 0.36 END)::DOUBLE * (value / 100) AS score FROM events)"


def _features(spark, d):
    e = tb.table(spark, d, "events")
    kind = F.when(F.col("event_type") == "signup", "birth").when(F.col("event_type") == "purchase", "cross_link").when(F.col("event_type") == "error", "state_update").otherwise("revision")
    return insight.macro_features(e.select(F.col("event_id").alias("feature"), kind.alias("event"), F.date_format("ts", "yyyy-MM-dd").alias("slice"), (F.col("value") / 100).alias("weight")))


@query("agg15_hlp10_macro_features", "SELECT pattern, count(*) AS n, round(sum(score), 6) AS score FROM feature GROUP BY 1", _FEATURE)
def _(spark, d):
    return _features(spark, d).groupBy("pattern").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("score"))


@query("agg16_pattern_profiles", """WITH b AS (SELECT pattern, feature FROM (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY score DESC, feature) AS r FROM feature) WHERE r <= 5), e AS (SELECT pattern, array_to_string(list_sort(list(feature)), ',') AS evidence FROM b GROUP BY 1)
SELECT f.pattern, count(*) AS n, round(greatest(0, least(1, avg(score) + least(0.35, 0.035 * count(*)))), 3)::DOUBLE AS score, any_value(evidence) AS evidence FROM feature f JOIN e ON f.pattern = e.pattern GROUP BY 1""", _FEATURE)  # fmt: skip
def _(spark, d):
    return insight.pattern_profiles(_features(spark, d))


@query("agg17_pattern_timeline", "SELECT pattern, slice, count(*) AS n, round(greatest(0, least(1, avg(score) + least(0.2, 0.03 * count(*)))), 3)::DOUBLE AS score FROM feature GROUP BY 1, 2", _FEATURE)
def _(spark, d):
    return insight.pattern_timeline(_features(spark, d))


@query("agg18_hubs", """SELECT 'branching' AS kind, source AS entity_id, count(DISTINCT target) AS n, round(least(1.0, count(DISTINCT target)::DOUBLE / 8), 3) AS score FROM edge GROUP BY 2 HAVING count(DISTINCT target) >= 3
UNION ALL SELECT 'convergence', target, count(DISTINCT source), round(least(1.0, count(DISTINCT source)::DOUBLE / 8), 3) FROM edge GROUP BY 2 HAVING count(DISTINCT source) >= 3""", tb.EDGES)  # fmt: skip
def _(spark, d):
    return insight.hubs(tb.edges(spark, d))


@query("agg19_agg22_shares", "SELECT source_type, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM edge), 6) AS share FROM edge GROUP BY 1", tb.EDGES)
def _(spark, d):
    return insight.shares(tb.edges(spark, d), "source_type")


@query("agg20_upper_median", "WITH s AS (SELECT edge_type, list_sort(list(time_delta_days)) AS v FROM edge GROUP BY 1) SELECT edge_type, len(v) AS n, v[1] AS low, v[len(v) // 2 + 1] AS median, v[len(v)] AS high FROM s", tb.EDGES)
def _(spark, d):
    return graph.upper_median(tb.edges(spark, d), "edge_type", "time_delta_days")


_T = registry.SQL["grf02_trajectories"]


@query("agg23_trajectory_metrics", f"""WITH t AS ({_T}), o AS (SELECT count(*)::DOUBLE AS trajectories, round(avg(trajectory_score), 6)::DOUBLE AS mean_score, round(avg(path_length), 6)::DOUBLE AS mean_length, max(path_length)::DOUBLE AS longest, round(avg(mean_edge_confidence), 6)::DOUBLE AS mean_confidence, round(avg(temporal_coherence), 6)::DOUBLE AS mean_temporal FROM t)
SELECT unnest(['trajectories', 'mean_score', 'mean_length', 'longest', 'mean_confidence', 'mean_temporal']) AS metric, unnest([trajectories, mean_score, mean_length, longest, mean_confidence, mean_temporal]) AS value FROM o""")
def _(spark, d):
    return insight.trajectory_metrics(graph.trajectories(tb.edges(spark, d), 4, 6, 6))


@query("agg24_sco06_hooks", """SELECT source, round(greatest(0.0, least(1.0, 0.28 * avg(confidence) + 0.22 * avg(verified::INTEGER) + 0.18 * least(1.0, count(*)::DOUBLE / 4) + 0.14 * 1.0 + 0.12 * 0.5 - 0.06 * 0.25)), 3)::DOUBLE AS score FROM edge GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""", tb.EDGES)
def _(spark, d):
    per = tb.edges(spark, d).groupBy("source").agg(F.avg("confidence").alias("c"), F.avg(F.col("verified").cast("int")).alias("v"), F.count("*").alias("n"))
    return per.select("source", insight.hook_score(F.col("c"), F.col("v"), F.col("n"), F.lit(1.0), F.lit(0.5), F.lit(0.25)).alias("score")).orderBy(F.desc("score"), "source").limit(20)


@query("agg25_screening_summary", "SELECT source, count(*) AS documents, count(*) FILTER (l.quality = 1) AS core, count(*) FILTER (l.toxic = 1) AS excluded, count(*) FILTER (l.doc_id IS NULL) AS missing FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY ROLLUP (source)")
def _(spark, d):
    labels = tb.table(spark, d, "labels").select("doc_id", "quality", "toxic", F.lit(True).alias("known"))
    rows = tb.table(spark, d, "documents").join(labels, "doc_id", "left")
    return rows.rollup("source").agg(F.count("*").alias("documents"), F.count_if(F.col("quality") == 1).alias("core"), F.count_if(F.col("toxic") == 1).alias("excluded"), F.count_if(F.col("known").isNull()).alias("missing"))


@query("agg27_hlp15_probe", """WITH n AS (SELECT d.doc_id, count(DISTINCT node_id) AS n FROM documents d LEFT JOIN (SELECT * FROM assignment WHERE node_id LIKE '%\\_\\_src1%' ESCAPE '\\') a ON d.doc_id = a.doc_id GROUP BY 1), k AS (SELECT node.node_id, count(DISTINCT a.doc_id) AS n FROM node LEFT JOIN (SELECT * FROM assignment WHERE node_id LIKE '%\\_\\_src1%' ESCAPE '\\') a ON node.node_id = a.node_id GROUP BY 1)
SELECT count(*) AS docs, count(*) FILTER (n > 0) AS covered, round(count(*) FILTER (n > 0)::DOUBLE / count(*), 6) AS coverage, any_value(b.balance) AS balance, round(count(*) FILTER (n >= 4)::DOUBLE / count(*), 6) AS overloaded_share, round(avg(n), 6) AS mean_nodes
FROM n, (SELECT round(greatest(0, least(1, 1 - avg(abs(n - m)) / greatest(max(m), 1))), 6)::DOUBLE AS balance FROM k, (SELECT avg(n) AS m FROM k)) b""", tb.ASSIGNMENTS, tb.NODES)  # fmt: skip
def _(spark, d):
    assigned = tb.assignments(spark, d).where(F.contains("node_id", F.lit("__src1")))
    return insight.probe_variant(assigned, tb.table(spark, d, "documents"), tb.nodes(spark, d))


@query("agg28_token_profiles", f"""WITH t AS (SELECT lang, unnest({tok('text')}) AS token FROM documents), c AS (SELECT lang, token, count(*) AS n FROM t GROUP BY 1, 2), r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token)::INTEGER AS rank, token, n FROM c) SELECT * FROM r WHERE rank <= 20""")
def _(spark, d):
    return insight.token_profiles(tb.table(spark, d, "documents"), "lang")


@query("joi13_sco04_older_sources", "SELECT source, target, days, shared, overlap, mentioned, score, rank FROM ranked WHERE rank <= 120", tb.DATED_ENTITIES)
def _(spark, d):
    entities, texts = tb.dated_entities(spark, d)
    return insight.older_sources(entities, "entity_type", 18, 120, texts)


@query("joi15_screened_corpus", """WITH x AS (SELECT doc_id, arg_max(quality, toxic) AS quality FROM labels GROUP BY 1) SELECT CASE quality WHEN 1 THEN 'core' WHEN 0 THEN 'support' ELSE 'skipped' END AS role, count(*) AS n FROM documents LEFT JOIN x ON documents.doc_id = x.doc_id GROUP BY 1""")
def _(spark, d):
    x = corpus.last_wins(tb.table(spark, d, "labels").select("doc_id", "quality", "toxic"), "doc_id", "toxic")
    role = F.when(F.col("quality") == 1, "core").when(F.col("quality") == 0, "support").otherwise("skipped")
    return tb.table(spark, d, "documents").join(x, "doc_id", "left").groupBy(role.alias("role")).agg(F.count("*").alias("n"))


@query("joi16_unprocessed", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    return tb.table(spark, d, "documents").select("doc_id").join(tb.table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("joi19_no_predecessor", "SELECT DISTINCT entity_id FROM part_entity WHERE entity_id NOT IN (SELECT target FROM edge WHERE verified AND edge_type = 'extends' AND confidence >= 0.85)", tb.EDGES)
def _(spark, d):
    done = tb.edges(spark, d).where("verified and edge_type = 'extends' and confidence >= 0.85").select(F.col("target").alias("entity_id"))
    return tb.parts(spark, d).select("entity_id").distinct().join(done, "entity_id", "left_anti")


@query("joi22_wide_audit", """SELECT edge_id, s.o_orderpriority AS source_role, t.o_orderpriority AS target_role, s.o_orderpriority || '->' || t.o_orderpriority AS role_pair FROM edge LEFT JOIN orders s ON source_document = s.o_orderkey LEFT JOIN orders t ON target_document = t.o_orderkey""", tb.EDGES)
def _(spark, d):
    o = tb.table(spark, d, "orders")
    a = o.select(F.col("o_orderkey").alias("source_document"), F.col("o_orderpriority").alias("source_role"))
    b = o.select(F.col("o_orderkey").alias("target_document"), F.col("o_orderpriority").alias("target_role"))
    e = tb.edges(spark, d).select("edge_id", "source_document", "target_document").join(a, "source_document", "left").join(b, "target_document", "left")
    return e.select("edge_id", "source_role", "target_role", F.concat_ws("->", "source_role", "target_role").alias("role_pair"))


@query("joi23_year_series", """WITH y AS (SELECT unnest(range((SELECT least(min(year(o_orderdate)), min(year(l_shipdate))) FROM orders, (SELECT min(l_shipdate) AS l_shipdate FROM lineitem)), (SELECT greatest(max(year(o_orderdate)), max(year(l_shipdate))) FROM orders, (SELECT max(l_shipdate) AS l_shipdate FROM lineitem)) + 1))::INTEGER AS year)
SELECT year, coalesce(o.n, 0) AS orders, coalesce(l.n, 0) AS lines FROM y LEFT JOIN (SELECT year(o_orderdate) AS k, count(*) AS n FROM orders GROUP BY 1) o ON year = o.k LEFT JOIN (SELECT year(l_shipdate) AS k, count(*) AS n FROM lineitem GROUP BY 1) l ON year = l.k""")  # fmt: skip
def _(spark, d):
    return graph.year_series({"orders": tb.table(spark, d, "orders").select(F.year("o_orderdate").alias("year")), "lines": tb.table(spark, d, "lineitem").select(F.year("l_shipdate").alias("year"))})


@query("hlp07_schema_groups", """SELECT kind, CASE WHEN kind IN ('method', 'modeling_strategy', 'measurement_strategy') THEN 'analytic_method' WHEN kind IN ('data_source', 'infrastructure_tooling') THEN 'evidence_and_infrastructure' ELSE kind END AS grp, count(*) AS n FROM (SELECT ['method', 'data_source', 'modeling_strategy', 'infrastructure_tooling', 'other'][(p_size % 5 + 1)::INTEGER] AS kind FROM part) GROUP BY 1, 2""")
def _(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("method", "data_source", "modeling_strategy", "infrastructure_tooling", "other"))), (F.col("p_size") % 5 + 1).cast("int"))
    return tb.table(spark, d, "part").select(kind.alias("kind")).groupBy("kind", insight.schema_group(F.col("kind")).alias("grp")).agg(F.count("*").alias("n"))


def flagship(spark, d):
    """Documents to phrase assignments by month, with the novelty of their node."""
    docs = tb.documents(spark, d)
    members = tb.assignments(spark, d).join(docs.select("doc_id", "published_at", "slice"), "doc_id")
    per = members.groupBy("node_id", "slice").agg(F.count_distinct("doc_id").alias("docs"))
    return per.join(corpus.node_enrichment(members), "node_id").select("node_id", "slice", "docs", "n_docs", "novelty", "uncertainty", "status")



