"""A run end to end: files to the tables of the evolution graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.operators import coevolution, corpus, evidence, graph, insight, windows
from loomspan.plans import loop
from loomspan.sources import loaders, sinks


def aliases_of(nodes: DataFrame) -> DataFrame:
    """(node_id, alias): labels and aliases."""
    return nodes.select("node_id", F.explode(T.listify(F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("alias")).distinct()


def configured_mentions(docs: DataFrame, assigned: DataFrame, patterns: dict[str, tuple[str, ...]]) -> DataFrame:
    """Mentions of the configured names by type, as whole phrases; the type given first wins for a name."""
    names = list({p.lower(): (k, p) for k, ps in reversed(patterns.items()) for p in ps}.values())
    table = docs.sparkSession.createDataFrame([(p, k) for k, p in names], "alias string, node_id string")
    found = docs.select("doc_id", "text", "published_at").join(corpus.assign_by_phrase(docs, table.select(F.concat_ws("\u0001", "node_id", "alias").alias("node_id"), "alias")), "doc_id")
    parts = F.split("node_id", "\u0001")
    rows = found.select("doc_id", "text", "published_at", parts[0].alias("entity_type"), parts[1].alias("canonical_name"))
    rows = rows.withColumn("entity_id", F.concat_ws("__", "entity_type", T.slugify(F.col("canonical_name")))).withColumn("evidence", F.substring(T.first_sentence_with(F.col("text"), F.col("canonical_name")), 1, 500))
    return rows.join(assigned, "doc_id", "left").select("doc_id", "entity_id", "canonical_name", "entity_type", F.coalesce("node_id", F.lit("")).alias("node_id"), "published_at", F.lit(0).alias("seq"), "evidence")


def events_of(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(node_id, event) for the nodes' states: a birth each, an edge each, and a cross link where an edge has several nodes."""
    births = nodes.select("node_id", F.lit("birth").alias("event"))
    ends = rows.select("node_id", "edge_id").distinct()
    several = ends.groupBy("edge_id").agg(F.count("*").alias("n")).where("n > 1")
    return births.unionByName(ends.select("node_id", F.lit("edge").alias("event"))).unionByName(ends.join(several, "edge_id", "left_semi").select("node_id", F.lit("cross_link").alias("event")))


def edge_rows(entities: DataFrame, mentions: DataFrame, docs: DataFrame, cues: dict[str, list[str]] | None, mode: str, pair_limit: int = 3) -> DataFrame:
    """Edges between entities of a node over dated document pairs, a row for each node, with relation, quote, score and status (JOI04 to JOI09, SCO01, SCO02, SCO09, FIL03).

    The first ``pair_limit`` pairs of two entities have no later sources than the first ``pair_limit`` of the source, so only these are paired.
    """
    cues = cues or graph.EDGE_CUES
    support = mentions.groupBy("node_id", "entity_id").agg(F.count_distinct("doc_id").alias("n_docs"), F.min("published_at").alias("first_seen"))
    pairs = graph.entity_pairs(support, "node_id", 40)
    own = mentions.select("entity_id", "node_id", "doc_id", "published_at").distinct()
    s = own.select(F.col("entity_id").alias("source"), "node_id", F.col("doc_id").alias("source_document"), F.col("published_at").alias("sd"))
    s = graph.top_per_group(s, ["source", "node_id"], ["sd", "source_document"], pair_limit).drop("rank")
    t = own.select(F.col("entity_id").alias("target"), "node_id", F.col("doc_id").alias("target_document"), F.col("published_at").alias("td"))
    dated = pairs.join(s, ["source", "node_id"]).join(t, ["target", "node_id"]).where("sd is null or td is null or sd <= td")
    picked = graph.top_per_group(dated, ["source", "target", "node_id"], ["td", "target_document", "sd", "source_document"], pair_limit).drop("rank")
    names = entities.select("entity_id", "canonical_name", "entity_type")
    named = picked.join(names.toDF("source", "source_name", "source_type"), "source").join(names.toDF("target", "target_name", "target_type"), "target")
    told = named.join(docs.select(F.col("doc_id").alias("target_document"), "text"), "target_document").withColumn("r", evidence.relation_of(T.sentences(F.col("text")), F.col("source_name"), F.col("target_name"), cues))
    quote = F.coalesce(T.first_sentence_with(F.col("text"), F.col("target_name")), T.first_sentence_with(F.col("text"), F.col("source_name")), F.lit(""))
    rows = told.select("source", "target", "source_name", "target_name", "source_type", "target_type", "node_id", "source_document", "target_document", "r.edge_type", "r.cue", F.substring(quote, 1, 500).alias("quote"), F.datediff("td", "sd").alias("time_delta_days"))
    all_cues = [c for kind in graph.STRONG for c in cues.get(kind, [])] or ["use"]
    audited = evidence.audit_quotes(rows, docs, all_cues, mode)
    delta = F.col("time_delta_days")
    base = audited.withColumn("confidence", graph.base_confidence(F.col("edge_type"), F.col("cue") != "", F.lit(True), delta))
    # an edge of a node is local; a relation type is described by its name, and calls for no slots but those of every edge
    local = F.when(F.col("node_id") != "", 1.0).otherwise(0.55)
    fit = graph.schema_fit(F.col("edge_type"), {kind: {"definition": kind} for kind in cues}, graph.STRONG)
    filled = F.when(evidence.has_bottleneck(F.col("quote")), F.array(F.lit("bottleneck"))).otherwise(F.array().cast("array<string>"))
    slots = graph.slot_completeness(F.col("edge_type"), filled, {}, [])
    grounded = graph.quote_grounding(F.col("verified"), F.when(F.col("verified"), 1).otherwise(0), F.col("quote") != "")
    scored = base.withColumn("score", graph.edge_score(F.col("confidence"), grounded, graph.temporal_score(delta), local, fit, slots))
    key = F.concat_ws("__", "edge_type", "source", "target", "target_document")
    named = scored.withColumn("edge_id", key).withColumn("bottleneck", evidence.has_bottleneck(F.col("quote")))
    return named.withColumn("status", graph.stratum(F.col("edge_type"), F.col("score"), F.col("verified")))


def one_per_edge(rows: DataFrame) -> DataFrame:
    """Of the rows of an edge, one for each node, the best scored."""
    return graph.best_per_key(rows, ["edge_id"], [F.col("score"), F.col("source_document"), F.col("node_id")])


def run(spark: SparkSession, config: loaders.RunConfig, root: str | None = None, mode: str = "lite", rounds: int = 2) -> dict[str, DataFrame]:
    """All tables of a run; with ``root`` they are written below it, with a manifest, and read from there.

    Without a taxonomy one is induced from the texts (GRF07); without assignments documents are assigned by phrase (JOI02). The mode ``full`` needs a ``root``: graph
    and taxonomy then change each other for at most ``rounds`` rounds (GRF10, ``loop.coevolve``) below ``root/coevolution``, and a run that failed goes on behind its last
    written round. What the rounds need is extracted from the documents that they assign anew, not from all.
    """
    if mode not in ("lite", "full") or (mode == "full" and root is None):
        raise ValueError("the mode is lite, or full with a root")
    # what later steps read again is kept, and made anew where an executor that held a part is lost
    docs, reasons = loaders.load_documents(loaders.read_records(spark, config.corpus_path), config.corpus)
    kept_frames = [docs := docs.persist()]
    nodes = loaders.load_nodes(spark, config.taxonomy_path) if config.taxonomy_path else evidence.induce_taxonomy(docs, "topic").select("node_id", F.lit("topic").alias("dimension"), "label", "parent_id", F.lit("").alias("definition"), F.array().cast("array<string>").alias("aliases"))
    given = loaders.load_assignments(loaders.read_records(spark, config.assignments_path)) if config.assignments_path else None
    phrase = corpus.assign_by_phrase(docs, aliases_of(nodes))
    assigned = (given.join(docs.select("doc_id"), "doc_id", "left_semi") if given is not None else phrase).select("doc_id", "node_id").distinct().persist()
    mentions = configured_mentions(docs, assigned, config.entity_patterns).persist()
    entities = corpus.entity_quality(corpus.build_entities(mentions)).persist()
    kept = entities.where("status = 'kept'")
    own = mentions.join(kept.select("entity_id"), "entity_id", "left_semi")
    rows = edge_rows(kept, own, docs, config.cues or None, config.grounding).persist()
    kept_frames += [assigned, mentions, entities, rows]
    extra = {}
    if mode == "full":
        found = own.drop("node_id").distinct()

        def extract(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
            new = found.join(pairs, "doc_id").select(own.columns)
            return new, edge_rows(kept, new, docs, config.cues or None, config.grounding)

        grown = loop.coevolve(spark, f"{root}/coevolution", lambda: {"nodes": nodes, "assignments": assigned, "mentions": own, "edges": rows}, kept, extract, rounds)
        nodes, assigned, mentions, rows = (grown[name] for name in loop.TABLES)
        extra = {"node_feedback": grown["feedback"], "rounds": grown["steps"], "revision_reports": grown["reports"]}
    else:
        extra = {"node_feedback": coevolution.node_feedback(nodes, own.select("node_id", "entity_id").distinct(), rows)}
    edges = one_per_edge(rows).persist()
    kept_frames.append(edges)
    tier = graph.first_tier(edges)
    paths = graph.trajectories(tier)
    chains = paths.select(F.array_join("entity_path", ">").alias("path"), F.col("trajectory_score").alias("score"))
    branches = graph.branch_points(edges)
    hooks = evidence.forecast_hooks(chains, branches, edges.where("bottleneck"))
    numbered = lambda df, scope, day, kind, *ids: df.select(F.concat(*scope).alias("scope"), F.abs(F.xxhash64(*ids)).alias("event_id"), F.col(day).alias("day"), F.lit(kind).alias("kind"))
    dates = docs.select(F.col("doc_id").alias("target_document"), F.col("published_at"))
    events = reduce(DataFrame.unionByName, [
        numbered(docs, [F.lit("global")], "published_at", "document", "doc_id"), numbered(mentions, [F.lit("node:"), "node_id"], "published_at", "mention", "doc_id", "entity_id", "node_id"),
        numbered(mentions, [F.lit("type:"), "entity_type"], "published_at", "mention", "doc_id", "entity_id"), numbered(edges.join(dates, "target_document"), [F.lit("relation:"), "edge_type"], "published_at", "edge", "edge_id"),
    ])
    members = assigned.join(docs.select("doc_id", "published_at"), "doc_id")
    windowed = windows.adaptive_windows(events, config.windows, config.shortest_days, config.longest_days)
    tables = {
        "documents": docs, "skip_reasons": reasons, "nodes": nodes, "assignments": assigned, "node_enrichment": corpus.node_enrichment(members), "mentions": mentions, "entities": entities, "edges": edges, "downstream_edges": tier,
        "aggregated_edges": graph.aggregate_edges(tier), "trajectories": paths, "branch_points": branches, "forecast_hooks": hooks, "windows": windows.window_rows(windowed), "node_states": insight.node_states(events_of(nodes, rows)), **extra,
    }
    if root is None:
        return tables
    sinks.write_artifacts(tables, root)
    for df in kept_frames:
        df.unpersist()
    return {name: spark.read.parquet(f"{root}/{name}") for name in tables}
