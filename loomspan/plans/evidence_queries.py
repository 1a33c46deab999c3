"""Queries over cues, quotes, candidates, cards and hooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.operators import corpus, display, evidence, graph, insight, labels, lineage
from loomspan.plans import registry
from loomspan.plans import tables as tb
from loomspan.plans.graph_queries import _weights
from loomspan.plans.registry import query
from loomspan.plans.text_queries import LABEL, sent, tok

_CUES = {"extends": ["tion", "ever"], "improves": ["better", "license"], "replaces": ["instead of"]}
_TYPE = "coalesce(list_filter(list_transform({s}, lambda s: CASE WHEN contains(s, 'tion') THEN 'extends|tion' WHEN contains(s, 'ever') THEN 'extends|ever' WHEN contains(s, 'better') THEN 'improves|better' WHEN contains(s, 'license') THEN 'improves|license' WHEN contains(s, 'instead of') THEN 'replaces|instead of' END), lambda x: x IS NOT NULL)[1], CASE WHEN len(list_filter({l}, lambda s: contains(s, 'the') AND contains(s, 'que'))) > 0 THEN 'uses_component|co-mention' ELSE 'background|' END)"
_LOW = f"list_transform({sent('text')}, lambda s: lower(s))"


@query("sco09_relation_of", f"SELECT doc_id, {_TYPE.replace('{s}', f'list_filter({_LOW}, lambda s: contains(s, ' + chr(39) + 'the' + chr(39) + ') OR contains(s, ' + chr(39) + 'que' + chr(39) + '))').replace('{l}', _LOW)} AS relation FROM documents")
def _(spark, d):
    r = evidence.relation_of(T.sentences(F.col("text")), F.lit("the"), F.lit("que"), _CUES)
    return tb.table(spark, d, "documents").select("doc_id", r.alias("r")).select("doc_id", F.concat_ws("|", "r.edge_type", "r.cue").alias("relation"))


@query("sco10_joi08_grounding")
def _(spark, d):
    turns = tb.table(spark, d, "conversations")
    docs = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    e = docs.select(F.col("doc_id").alias("edge_id"), F.col("doc_id").alias("source_document"), (F.col("doc_id") + 1).alias("target_document"), F.col("text").alias("quote"), F.element_at(F.split(T.normalize_space(F.col("text")), " "), 1).alias("source_name"), F.lit("the que").alias("target_name"))
    return evidence.audit_quotes(e, docs, ["th", "e"]).select("edge_id", "verified")


@query("str11_proper_names")
def _(spark, d):
    return evidence.proper_names(tb.table(spark, d, "documents"), ("th", "en"))


@query("sco11_evidence_slots", "SELECT doc_id, CASE WHEN contains(lower(text), 'problem') OR contains(lower(text), 'issue') OR contains(lower(text), 'limitation') OR contains(lower(text), 'bottleneck') OR contains(lower(text), 'challenge') OR contains(lower(text), 'lack of') THEN md5(text) ELSE md5('') END AS bottleneck FROM documents")
def _(spark, d):
    slots = evidence.evidence_slots(F.col("text"), ["bottleneck", "mechanism", "tradeoff"])
    return tb.table(spark, d, "documents").select("doc_id", F.md5(slots["bottleneck"]).alias("bottleneck"))


#: Names of an edge's ends with modifiers, plurals and kinds as the edge's number says.
_SN = "CASE edge_id % 7 WHEN 0 THEN s WHEN 1 THEN 'improved ' || s WHEN 2 THEN s || ' methods' WHEN 3 THEN s WHEN 4 THEN 'machine learning ' || split_part(s, ' ', 1) WHEN 5 THEN s || ' algorithm' ELSE s || 's' END"
_TN = "CASE edge_id % 11 WHEN 0 THEN s WHEN 1 THEN s || 's method' WHEN 2 THEN 'novel ' || s || ' systems' WHEN 3 THEN s || ' detection' WHEN 4 THEN split_part(s, ' ', 2) || ' ' || split_part(s, ' ', 1) WHEN 5 THEN s || ' ' || t || ' prediction' ELSE t END"
_TOKENS = "list_filter(string_split(trim(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '_'), '_'), lambda w: length(w) >= 2)"
_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_BARE = f"list_filter({{0}}, lambda w: NOT list_contains({_LIST(labels.STRUCTURE)}, w))"
_ACRONYM = "CASE WHEN len({0}) >= 2 THEN array_to_string(list_transform({0}, lambda w: w[1]), '') ELSE '' END"
_MORE = f"len(list_filter({{0}}, lambda w: NOT list_contains({_LIST(labels.MODIFIERS)}, w))) = 0"
_WIDE = f"len(list_filter({{0}}, lambda w: NOT list_contains({_LIST(labels.MODIFIERS + labels.CONTEXTS)}, w))) = 0"
_NAMED = f"""ends AS (SELECT edge_id, a.canonical_name AS s, b.canonical_name AS t, source_type FROM edge JOIN (SELECT DISTINCT entity_id, canonical_name FROM part_entity) a ON a.entity_id = source JOIN (SELECT DISTINCT entity_id, canonical_name FROM part_entity) b ON b.entity_id = target),
named AS (SELECT edge_id, source_type, {_SN} AS sn, {_TN} AS tn FROM ends),
parts_of AS (SELECT *, {_TOKENS.format('sn')} AS st, {_TOKENS.format('tn')} AS tt FROM named),
bared AS (SELECT *, {_BARE.format('st')} AS sb, {_BARE.format('tt')} AS tb FROM parts_of),
short AS (SELECT *, {_ACRONYM.format('sb')} AS sa, {_ACRONYM.format('tb')} AS ta FROM bared),
cored AS (SELECT *, list_distinct(list_transform(list_filter(sb, lambda w: NOT list_contains(list_filter([sa, ta], lambda x: length(x) >= 2), w)), lambda t: {LABEL})) AS sc,
    list_distinct(list_transform(list_filter(tb, lambda w: NOT list_contains(list_filter([sa, ta], lambda x: length(x) >= 2), w)), lambda t: {LABEL})) AS tc,
    list_distinct(list_filter(sb, lambda w: NOT (length(sa) >= 2 AND w = sa))) AS own, ' ' || array_to_string(st, ' ') || ' ' AS sw, ' ' || array_to_string(tt, ' ') || ' ' AS tw FROM short),
extra AS (SELECT *, list_filter(tc, lambda w: NOT list_contains(sc, w)) AS mt, list_filter(sc, lambda w: NOT list_contains(tc, w)) AS ms, len(list_intersect(sc, tc)) AS both_n, len(sc) > 0 AND len(tc) > 0 AS cores FROM cored)"""


def _named_edges(spark, d, edges=None, *more):
    names = tb.parts(spark, d).select("entity_id", "canonical_name").distinct()
    e = (tb.edges(spark, d) if edges is None else edges).join(names.toDF("source", "s"), "source").join(names.toDF("target", "t"), "target")
    n, s, t = F.col("edge_id"), F.col("s"), F.col("t")
    word = lambda k: F.element_at(F.split(s, " "), k)
    said = F.when(n % 7 == 1, F.concat(F.lit("improved "), s)).when(n % 7 == 2, F.concat(s, F.lit(" methods"))).when(n % 7 == 4, F.concat(F.lit("machine learning "), word(1))).when(n % 7 == 5, F.concat(s, F.lit(" algorithm"))).when(n % 7 == 6, F.concat(s, F.lit("s"))).otherwise(s)
    told = F.when(n % 11 == 0, s).when(n % 11 == 1, F.concat(s, F.lit("s method"))).when(n % 11 == 2, F.concat(F.lit("novel "), s, F.lit(" systems"))).when(n % 11 == 3, F.concat(s, F.lit(" detection")))
    told = told.when(n % 11 == 4, F.concat(word(2), F.lit(" "), word(1))).when(n % 11 == 5, F.concat(s, F.lit(" "), t, F.lit(" prediction"))).otherwise(t)
    return e.select("edge_id", "source_type", said.alias("sn"), told.alias("tn"), *more)


@query("fil07_variants", f"""SELECT edge_id, CASE WHEN st = tt THEN 'duplicate_label' WHEN list_transform(st, lambda t: {LABEL}) = list_transform(tt, lambda t: {LABEL}) THEN 'same_core_label' WHEN cores AND len(ms) = 0 AND len(mt) = 0 THEN 'same_core_label'
  WHEN cores AND len(ms) = 0 AND {_MORE.format('mt')} THEN 'source_label_with_generic_modifier' WHEN cores AND len(ms) = 0 AND contains(tw, sw) AND {_WIDE.format('mt')} THEN 'source_label_with_context_suffix'
  WHEN cores AND len(mt) = 0 AND {_MORE.format('ms')} THEN 'target_label_with_generic_modifier' WHEN cores AND len(mt) = 0 AND contains(sw, tw) AND {_WIDE.format('ms')} THEN 'target_label_with_context_suffix'
  WHEN cores AND both_n >= 0.86 * (len(sc) + len(tc) - both_n) AND (contains(sw, tw) OR contains(tw, sw)) THEN 'near_duplicate_label' ELSE '' END AS reason FROM extra""", tb.EDGES, _NAMED)  # fmt: skip
def _(spark, d):
    return labels.with_variant_reason(_named_edges(spark, d), "sn", "tn").select("edge_id", "reason")


#: Of the rules those that names of this dimension can meet: a broad phrase of learning, a general last word, a lone structure word.
@query("fil07_generic_predecessors", f"""SELECT edge_id, CASE WHEN (contains(array_to_string(sb, ' '), 'machine learning') AND len(own) <= 3) OR (list_contains(own, 'machine') AND list_contains(own, 'learning') AND len(list_filter(own, lambda w: NOT list_contains({_LIST(labels.LEARNING_MODIFIERS)}, w))) <= 2)
  OR (list_contains({_LIST(labels.HEADS)}, st[-1]) AND len(own) <= 2) OR (len(own) <= 1 AND list_contains({_LIST(labels.STRUCTURE)}, st[-1])) THEN 'generic_predecessor_source' ELSE '' END AS reason FROM extra""", tb.EDGES, _NAMED)  # fmt: skip
def _(spark, d):
    return labels.with_generic_predecessor(_named_edges(spark, d), "sn", "source_type").select("edge_id", "reason")


@query("fil06_all_rules")
def _(spark, d):
    """Every edge with the first rule that speaks against it; the orders' texts are its quotes, its cue is a reason."""
    said = tb.order_texts(spark, d)
    limits = (["extends", "improves"], 0.5, 30)
    e = tb.edges(spark, d).select("edge_id", "source", "target", F.col("verified").alias("accepted"), "edge_type", "confidence", "time_delta_days", "source_document", "target_document", "source_type", "target_type")
    # the figures speak first: only the edges that they let through, the fewer ones, need names and quotes
    e = lineage.written(e.withColumn("figures", display.by_figures(*limits)))
    kept = e.where("figures = ''").drop("figures", "source_type")
    kept = _named_edges(spark, d, e.where("figures = ''"), *(c for c in kept.columns if c not in ("edge_id", "source", "target")))
    kept = kept.join(said.toDF("source_document", "source_quote"), "source_document", "left").join(said.toDF("target_document", "target_quote"), "target_document", "left")
    why = F.when(F.col("edge_id") % 3 == 0, F.array(F.lit("target_text_mentions_source"))).when(F.col("edge_id") % 3 == 1, F.array(F.lit("target_text_mentions_source_with_evolution_cue")))
    kind = lambda c: F.when(F.col(c) == "promo", "data_source").otherwise("method")
    rows = kept.select("edge_id", "accepted", "edge_type", "confidence", "time_delta_days", "source_document", "target_document", F.col("sn").alias("source_name"), F.col("tn").alias("target_name"), kind("source_type").alias("source_type"), kind("target_type").alias("target_type"),
                       F.lit("").alias("schema_group"), why.alias("candidate_reasons"), "source_quote", "target_quote", F.lit("").alias("rationale"))
    told = display.with_rejection(rows, *limits).select("edge_id", "reason")
    return told.unionByName(e.where("figures <> ''").select("edge_id", F.col("figures").alias("reason")))


@query("fil08_relevance", "SELECT doc_id, contains(lower(text), 'mit license') OR ((contains(lower(text), 'the') OR contains(lower(text), 'que')) AND (contains(lower(text), 'license') OR contains(lower(text), 'version'))) AS relevant FROM documents")
def _(spark, d):
    return tb.table(spark, d, "documents").select("doc_id", evidence.relevance(F.col("text"), ["mit license"], [["the", "que"], ["license", "version"]]).alias("relevant"))


@query("joi03_fuzzy_assignment", f"""WITH t AS (SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS low, list_distinct({tok('text')}) AS t FROM documents), n(node_id, label) AS (VALUES ('n1', 'public license version'), ('n2', 'released under license'), ('n3', 'the que'))
SELECT node_id, count(*) AS docs FROM (SELECT doc_id, node_id FROM assignment UNION SELECT doc_id, node_id FROM t, n WHERE (contains(low, label) OR len(list_intersect(list_distinct({tok('label')}), t)) >= 0.67 * len(list_distinct({tok('label')})))) GROUP BY 1""", tb.ASSIGNMENTS)  # fmt: skip
def _(spark, d):
    nodes = spark.createDataFrame([("n1", "p", "public license version"), ("n2", "p", "released under license"), ("n3", "p", "the que"), ("n4", None, "the")], "node_id string, parent_id string, label string")
    return evidence.fuzzy_assign(tb.table(spark, d, "documents"), nodes, tb.assignments(spark, d)).groupBy("node_id").agg(F.count("*").alias("docs"))


_HAS_CUE = " OR ".join(f"contains({{0}}, '{c}')" for c in insight.EVOLUTION_CUES)
_LOW_TEXT, _AT = "lower(text)", "instr(lower(text), lower(sn))"
_NEAR = _HAS_CUE.format(f"substr(lower(text), greatest({_AT} - 160, 1), {_AT} + length(sn) + 160 - greatest({_AT} - 160, 1))")
#: Candidates with their scores and fates; names of this dimension have no variants but those of other word order or plural.
_SCORED = f"""scored AS (SELECT *, round(least(1.0::DOUBLE, CASE WHEN shared > 0 THEN least(0.28::DOUBLE, 0.08::DOUBLE * shared) ELSE 0 END + CASE WHEN overlap > 0 THEN least(0.16::DOUBLE, 0.06::DOUBLE * overlap) ELSE 0 END
    + CASE WHEN mentioned AND NOT contains(lower(tn), lower(sn)) THEN CASE WHEN {_NEAR} THEN 0.24::DOUBLE ELSE 0.12::DOUBLE END ELSE 0 END + CASE WHEN {_HAS_CUE.format(_LOW_TEXT)} THEN 0.08::DOUBLE ELSE 0 END
    + CASE WHEN days / 365.25 <= 6 THEN 0.12::DOUBLE WHEN days / 365.25 <= 12 THEN 0.06::DOUBLE ELSE 0 END + least(0.08::DOUBLE, ln(1 + target_docs) * 0.03::DOUBLE)), 3) AS points FROM ranked WHERE rank <= 120),
fated AS (SELECT *, CASE WHEN sn = tn THEN 'skipped_duplicate_label' WHEN list_sort(string_split(sn, ' ')) = list_sort(string_split(tn, ' ')) THEN 'skipped_same_core_label' WHEN points < 0.25 THEN 'skipped_below_min_candidate_score' ELSE 'retained_before_per_target_cap' END AS fate FROM scored),
capped AS (SELECT source, target, days, target_date, points AS score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY points DESC, days, source)::INTEGER AS r FROM fated WHERE fate = 'retained_before_per_target_cap') WHERE r <= 6),
kept AS (SELECT * FROM capped ORDER BY score DESC, target_date, source, target LIMIT 240)"""


@query("joi14_candidates", "SELECT source, target, days, score, rank FROM kept", tb.DATED_ENTITIES, _SCORED)
def _(spark, d):
    entities, texts = tb.dated_entities(spark, d)
    return evidence.successor_candidates(entities, "entity_type", texts, limit=240)[0].drop("reasons")


@query("joi14_counters", """SELECT fate AS counter, count(*) AS n FROM fated GROUP BY 1 UNION ALL SELECT 'source_pairs_considered', count(*) FROM fated UNION ALL SELECT 'retained_after_per_target_cap', count(*) FROM capped
UNION ALL SELECT 'retained_after_global_limit', count(*) FROM kept""", tb.DATED_ENTITIES, _SCORED)  # fmt: skip
def _(spark, d):
    entities, texts = tb.dated_entities(spark, d)
    return evidence.successor_candidates(entities, "entity_type", texts, limit=240)[1]


@query("joi17_path_windows", "SELECT l_orderkey AS path_id, array_to_string(list_sort(list(DISTINCT strftime(l_shipdate, '%Y'))), ',') AS windows, count(*) AS steps FROM lineitem GROUP BY 1")
def _(spark, d):
    from pyspark.sql import Window

    line = tb.table(spark, d, "lineitem").withColumn("edge_id", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")) + F.col("l_orderkey") * 1000)
    paths = line.groupBy(F.col("l_orderkey").alias("path_id")).agg(F.collect_list("edge_id").alias("edges"))
    out = evidence.path_windows(paths, line.select("edge_id", F.date_format("l_shipdate", "yyyy").alias("window_id")))
    return out.select("path_id", F.array_join("windows", ",").alias("windows"), "steps")


@query("fil09_allowed_paths", "SELECT l_orderkey AS path_id FROM lineitem GROUP BY 1 HAVING bool_and(l_returnflag <> 'R')")
def _(spark, d):
    line = tb.table(spark, d, "lineitem").withColumn("edge_id", F.concat_ws(":", "l_orderkey", "l_returnflag"))
    paths = line.groupBy(F.col("l_orderkey").alias("path_id")).agg(F.collect_set("edge_id").alias("edges"))
    return evidence.allowed_paths(paths, line.where("l_returnflag <> 'R'").select("edge_id").distinct()).select("path_id")


@query("joi20_entity_cards", """WITH e AS (SELECT DISTINCT entity_id FROM mention), md AS (SELECT entity_id, doc_id, min(published_at) AS day FROM mention GROUP BY 1, 2), dd AS (SELECT entity_id, list(doc_id ORDER BY day, doc_id) AS docs FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY day, doc_id) AS r FROM md) WHERE r <= 24 GROUP BY 1),
oe AS (SELECT source AS entity_id, list(target ORDER BY c DESC, target) AS outs FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY c DESC, target) AS r FROM (SELECT source, target, max(confidence) AS c FROM edge GROUP BY 1, 2)) WHERE r <= 24 GROUP BY 1)
SELECT e.entity_id, md5(array_to_string(docs, ',')) AS documents, md5(array_to_string(outs, ',')) AS out_edges FROM e LEFT JOIN dd ON e.entity_id = dd.entity_id LEFT JOIN oe ON e.entity_id = oe.entity_id""", tb.MENTIONS, tb.EDGES.replace(tb.PARTS + ", ", ""))  # fmt: skip
def _(spark, d):
    m = tb.mentions(spark, d)
    cards = evidence.entity_cards(m.select("entity_id").distinct(), m, tb.edges(spark, d))
    joined = lambda c, f: F.md5(F.array_join(F.transform(c, lambda x: x[f].cast("string")), ","))
    return cards.select("entity_id", joined("documents", "doc_id").alias("documents"), joined("out_edges", "entity").alias("out_edges"))


_HOOKS = """WITH b AS (SELECT source, count(DISTINCT target) AS n FROM edge WHERE verified AND edge_type IN ('extends', 'improves') GROUP BY 1 HAVING count(DISTINCT target) >= 2), c AS (SELECT source, count(*) AS n FROM edge WHERE NOT verified AND edge_type = 'background' GROUP BY 1)
SELECT 'branch' AS kind, source AS key, least(1.0::DOUBLE, n / 8.0::DOUBLE) AS weight FROM b UNION ALL SELECT 'bottleneck', source, least(1.0::DOUBLE, n / 8.0::DOUBLE) FROM c"""  # fmt: skip


@query("grf06_agg32_all_hooks", f"SELECT kind, key, weight FROM (WITH {tb.EDGES}, {_HOOKS[5:]}) UNION ALL SELECT 'chain', path, score FROM ({registry.SQL['grf01_chains']})")
def _(spark, d):
    e = tb.edges(spark, d)
    return evidence.forecast_hooks(graph.beam_paths(_weights(spark, d), 4, 5, 5), graph.branch_points(e), e.where("not verified and edge_type = 'background'"))


@query("grf07_induction", f"""WITH t AS (SELECT {tok('text')} AS t FROM documents), g AS (SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS phrase FROM t), c AS (SELECT phrase, count(*) AS n FROM g GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6)
SELECT 'topic' AS node_id, NULL::VARCHAR AS parent_id, 'topic' AS label, (SELECT count(*) FROM documents) AS support UNION ALL SELECT 'topic__' || coalesce(nullif(trim(regexp_replace(lower(phrase), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown'), 'topic', phrase, n FROM c WHERE n >= 2""")
def _(spark, d):
    return evidence.induce_taxonomy(tb.table(spark, d, "documents"), "topic")


@query("agg31_schema_revisions", "SELECT edge_type, count(*) AS n, round(avg(verified::INTEGER), 3) AS verified_rate, CASE WHEN avg(verified::INTEGER) < 0.3 THEN 'negative_prior' WHEN avg(verified::INTEGER) < 0.6 THEN 'needs_review' ELSE 'observed' END AS proposal FROM edge GROUP BY 1 HAVING count(*) >= 5", tb.EDGES)
def _(spark, d):
    return evidence.schema_revisions(tb.edges(spark, d))


@query("agg22_group_diagnostics", "SELECT entity_type, entity_type AS schema_group, count(DISTINCT entity_id) AS entities, count(DISTINCT (entity_id, doc_id)) AS documents, round(count(DISTINCT entity_id)::DOUBLE / (SELECT count(DISTINCT entity_id) FROM mention), 6) AS share FROM mention GROUP BY 1", tb.MENTIONS)
def _(spark, d):
    return evidence.group_diagnostics(corpus.build_entities(tb.mentions(spark, d)))
