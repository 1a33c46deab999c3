"""Reports of runs and rows for display."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.operators.graph import top_per_group

DIMENSIONS = ("taxonomy", "entity_layer", "edge_evidence", "coevolution", "forecast_hooks", "llm_reliability")


def _mean(x: Column) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


def _rate(x: Column) -> Column:
    return _mean(F.coalesce(x, F.lit(False)).cast("int"))


def taxonomy_score(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean of the rounded means of the metrics (AGG14)."""
    return rows.agg(F.round(reduce(lambda a, b: a + b, (F.round(_mean(F.col(m)), 3) for m in metrics)) / len(metrics), 3).alias("score"))


def entity_score(rows: DataFrame) -> DataFrame:
    """``rows``: status (kept or filtered), quality."""
    kept = F.col("status") == "kept"
    return rows.agg(F.round(F.lit(0.6) * _mean(F.when(kept, F.col("quality"))) + F.lit(0.4) * _rate(kept), 3).alias("score"))


def edge_score(rows: DataFrame) -> DataFrame:
    """``rows``: status (trusted, candidate, unverified), verified_quote_count, confidence."""
    quotes = _mean(F.least(F.lit(1.0), F.coalesce("verified_quote_count", F.lit(0)) / 3.0))
    score = F.lit(0.45) * _rate(F.col("status") == "trusted") + F.lit(0.25) * quotes + F.lit(0.2) * _mean(F.col("confidence")) + F.lit(0.1) * (1.0 - _rate(F.col("status") == "unverified"))
    return rows.agg(F.round(score, 3).alias("score"))


def coevolution_score(feedback: DataFrame, expansions: DataFrame, revisions: DataFrame) -> DataFrame:
    """``feedback``: advice; the others: status."""
    a = feedback.agg(_rate(F.col("advice") != "monitor").alias("a"))
    e = expansions.agg(_rate(F.col("status") == "applied").alias("e"))
    r = revisions.agg(_rate(F.col("status") == "applied").alias("r"))
    return a.crossJoin(e).crossJoin(r).select(F.round(F.lit(0.35) * F.col("a") + F.lit(0.35) * F.col("r") + F.lit(0.3) * F.col("e"), 3).alias("score"))


def hook_score(hooks: DataFrame) -> DataFrame:
    """``hooks``: score."""
    return hooks.agg(F.round(F.round(_mean(F.col("score")), 3), 3).alias("score"))


def model_score(records: DataFrame) -> DataFrame:
    """``records``: schema_valid, error. Without records: 1."""
    error = F.coalesce("error", F.lit(""))
    bad = (error != "") & (error != "No LLM tasks enabled.")
    score = F.lit(0.7) * _rate(F.col("schema_valid")) + F.lit(0.3) * (1.0 - _rate(bad))
    return records.agg(F.when(F.count("*") == 0, 1.0).otherwise(F.round(score, 3)).alias("score"))


def quality_report(scores: dict[str, DataFrame]) -> DataFrame:
    """One row (AGG14): a score for each of :data:`DIMENSIONS` (one-row frames), ``overall`` and ``recommendations``.

    A dimension under 0.55 is to be reviewed; if none is, the run is ready.
    """
    row = reduce(lambda a, b: a.crossJoin(b), (scores[n].select(F.col("score").alias(n)) for n in DIMENSIONS))
    overall = F.round(reduce(lambda a, b: a + b, (F.col(n) for n in DIMENSIONS)) / len(DIMENSIONS), 3)
    review = F.array_compact(F.array(*(F.when(F.col(n) < 0.55, F.lit(f"review_{n}")) for n in DIMENSIONS)))
    ready = F.array(F.lit("ready_for_larger_corpus_or_gold_evaluation"))
    return row.withColumn("overall", overall).withColumn("recommendations", F.when(F.size(review) > 0, review).otherwise(ready))


def extraction_summary(entities: DataFrame, candidates: DataFrame, decisions: DataFrame, edges: DataFrame) -> DataFrame:
    """(measure, key, n) of a successor extraction (AGG26)."""

    def one(name: str, n: DataFrame) -> DataFrame:
        return n.toDF("n").select(F.lit(name).alias("measure"), F.lit("").alias("key"), F.col("n").cast("long").alias("n"))

    def by(name: str, df: DataFrame, column: str) -> DataFrame:
        return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("key")).agg(F.count("*").alias("n")).select(F.lit(name).alias("measure"), "key", "n")

    count = lambda df: df.agg(F.count("*"))
    targets, found = candidates.select(F.col("target").alias("entity_id")).distinct(), edges.select(F.col("target").alias("entity_id")).distinct()
    parts = [
        one("entities", count(entities)), one("candidates", count(candidates)), one("accepted_edges", count(edges)),
        one("accepted_sources", edges.agg(F.count_distinct("source"))), one("accepted_targets", count(found)),
        one("targets_without_predecessor", count(targets.join(found, "entity_id", "left_anti"))),
        one("entities_without_predecessor", count(entities.select("entity_id").distinct().join(found, "entity_id", "left_anti"))),
        by("relation_type", edges, "edge_type"), by("rejection_reason", decisions.where("not accepted"), "rejection_reason"),
    ]
    return reduce(DataFrame.unionByName, parts)


def best_variants(rows: DataFrame, measures: list[str]) -> DataFrame:
    """(measure, variant, value): the first variant with the greatest value (AGG33); ``rows``: variant, nth, and the measures. Null counts as 0."""
    aggs = [F.max(F.struct(F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias("value"), (-F.col("nth")).alias("nth"), "variant")).alias(m) for m in measures]
    one = rows.agg(*aggs)
    return reduce(DataFrame.unionByName, (one.select(F.lit(m).alias("measure"), F.col(f"{m}.variant").alias("variant"), F.col(f"{m}.value").alias("value")) for m in measures))


def display_edges(edges: DataFrame, pinned: DataFrame, most_edges: int, most_nodes: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the part of a graph that is shown (WIN14).

    Edges by confidence, nearness in time and id, greatest first, the first ``most_edges``; their entities by 1,000 for a pinned one,
    100 for each edge and 8 * log(1 + support), the first ``most_nodes``; then the edges between these. ``pinned``: entity_id, support, pinned.
    """
    best = edges.orderBy(F.desc("confidence"), F.abs(F.coalesce("time_delta_days", F.lit(0))), F.desc("edge_id")).limit(most_edges)
    degree = best.select(F.explode(F.array("source", "target")).alias("entity_id")).groupBy("entity_id").agg(F.count("*").alias("degree"))
    ranked = degree.join(pinned, "entity_id", "full").select("entity_id", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("support", F.lit(0)).alias("support"), F.coalesce("pinned", F.lit(False)).alias("pinned"))
    score = F.when(F.col("pinned"), 1000.0).otherwise(0.0) + 100.0 * F.col("degree") + 8.0 * F.log1p("support")
    nodes = ranked.where("degree > 0 or pinned").withColumn("rank_score", F.round(score, 6)).orderBy(F.desc("rank_score"), "entity_id").limit(most_nodes)
    ids = nodes.select("entity_id")
    shown = best.join(ids.withColumnRenamed("entity_id", "source"), "source", "left_semi").join(ids.withColumnRenamed("entity_id", "target"), "target", "left_semi")
    return nodes, shown


def display_windows(windows: DataFrame, allowed: DataFrame, most: int) -> DataFrame:
    """Windows by their allowed edges, mentions, documents and start, greatest first, the first ``most`` (WIN15).

    ``windows``: window_id, start, edges (array of ids), edge_count, mentions, documents. One whose edges are all not allowed is left out.
    """
    held = windows.select("window_id", F.explode("edges").alias("edge_id")).join(allowed.select("edge_id").distinct(), "edge_id", "left_semi").groupBy("window_id").agg(F.count("*").alias("shown"))
    rows = windows.join(held, "window_id", "left").withColumn("shown", F.coalesce("shown", F.lit(0)))
    kept = rows.where("shown > 0 or edge_count = 0")
    return kept.orderBy(F.desc("shown"), F.desc("mentions"), F.desc("documents"), F.desc("start"), F.desc("window_id")).limit(most).select("window_id", "start", F.col("shown").alias("edge_count"), "mentions", "documents")


def pattern_links(evidence: DataFrame, trajectories: DataFrame, edges: DataFrame) -> DataFrame:
    """(pattern, kind, id): edges, trajectories and entities that a pattern's evidence leads to (JOI18).

    ``evidence``: pattern, evidence_id; ``trajectories``: trajectory_id, edge_path, entity_path (arrays); ``edges``: edge_id. Ids are strings.
    """
    ids = edges.select(F.col("edge_id").alias("id")).distinct()
    direct = evidence.select("pattern", F.col("evidence_id").alias("id")).distinct()
    held = direct.join(trajectories.select(F.col("trajectory_id").alias("id"), "edge_path", "entity_path"), "id")
    steps = held.select("pattern", F.explode("edge_path").alias("id"))
    found = direct.unionByName(steps).distinct().join(ids, "id", "left_semi").select("pattern", F.lit("edge").alias("kind"), "id")
    entity = held.select("pattern", F.explode("entity_path").alias("id")).distinct().select("pattern", F.lit("entity").alias("kind"), "id")
    return found.unionByName(held.select("pattern", F.lit("trajectory").alias("kind"), "id")).unionByName(entity)


def type_transition(source: Column, target: Column) -> Column:
    """``a -> b``, empty if either is (HLP09, HLP24)."""
    a, b = T.normalize_space(source), T.normalize_space(target)
    return F.when((a != "") & (b != ""), F.concat_ws(" -> ", a, b)).otherwise("")


def group_value(source: Column, target: Column) -> Column:
    """One group, or ``a -> b`` where they differ (HLP09)."""
    return F.when(T.normalize_space(source) == T.normalize_space(target), T.normalize_space(source)).otherwise(type_transition(source, target))


def context_shift(source: Column, target: Column) -> Column:
    """``a -> b`` where both are known and differ, else empty (HLP08, HLP09)."""
    return F.when(F.lower(T.normalize_space(source)) != F.lower(T.normalize_space(target)), type_transition(source, target)).otherwise("")


# Words that tell of institutions.
INSTITUTIONS = ["benchmark", "validation", "evaluation", "governance", "audit", "standard", "protocol", "reproduc", "policy"]


def institutional(*texts: Column) -> Column:
    """A word that tells of an institution in any of the texts (HLP08)."""
    low = F.lower(F.concat_ws(" ", *texts))
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in INSTITUTIONS))


def edge_year(*days: Column) -> Column:
    """The year of the first date that is known, as text; empty without one (HLP08, HLP24)."""
    return F.coalesce(F.year(F.coalesce(*days)).cast("string"), F.lit(""))


def with_missing_entities(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities, and a row for each end of an edge that has none (HLP12): name and type from its id, its first date."""
    ends = edges.select(F.col("source").alias("entity_id"), "day").unionByName(edges.select(F.col("target").alias("entity_id"), "day"))
    missing = ends.where("entity_id <> ''").groupBy("entity_id").agg(F.min("day").alias("first_seen")).join(entities.select("entity_id"), "entity_id", "left_anti")
    rows = missing.select("entity_id", T.name_of(F.col("entity_id")).alias("canonical_name"), T.type_of(F.col("entity_id")).alias("entity_type"), "first_seen", F.lit(True).alias("fallback"))
    return entities.select("entity_id", "canonical_name", "entity_type", "first_seen", F.lit(False).alias("fallback")).unionByName(rows)


def referenced_documents(docs: DataFrame, *ids: DataFrame) -> DataFrame:
    """The documents that any of the frames (column doc_id) names (HLP12)."""
    return docs.join(reduce(DataFrame.unionByName, (i.select("doc_id") for i in ids)).distinct(), "doc_id", "left_semi")


def mention_quotes(mentions: DataFrame) -> DataFrame:
    """Of an entity's mentions with the same document and quote one, longest quotes first (HLP26): ``rank`` by entity."""
    rows = mentions.select("entity_id", "doc_id", T.normalize_space(F.col("evidence")).alias("quote")).where("quote <> ''").distinct()
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc(F.char_length("quote")), "doc_id", "quote")))


def incident_edges(edges: DataFrame, entities: DataFrame, k: int = 24) -> DataFrame:
    """The best ``k`` edges that lead into or out of each entity (HLP26): ``entity_id, side, edge_id, rank``."""
    ids = entities.select("entity_id").distinct()
    both = [edges.select(F.col(end).alias("entity_id"), F.lit(side).alias("side"), "edge_id", "confidence").join(ids, "entity_id", "left_semi") for end, side in (("source", "out"), ("target", "in"))]
    return top_per_group(both[0].unionByName(both[1]), ["entity_id", "side"], [F.desc("confidence"), "edge_id"], k).select("entity_id", "side", "edge_id", "rank")


def gap_years(series: DataFrame, value: str) -> DataFrame:
    """Years between the first and the last with any, that have none (HLP25); ``series``: a row a year."""
    held = series.where(F.col(value) > 0).agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    return series.join(F.broadcast(held), F.col("year").between(F.col("lo"), F.col("hi"))).where(F.col(value) == 0).select("year")


def markdown(df: DataFrame, title: str, most: int = 50) -> str:
    """A table of the first ``most`` rows of a small report as Markdown (SRC22), and how many rows it leaves out."""
    rows = df.limit(most).collect()
    more = df.count() - len(rows) if len(rows) == most else 0
    cell = lambda x: str("" if x is None else x).replace("|", "\\|").replace("\n", " ")
    head = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    left = [f"{more} more rows.", ""] if more > 0 else []
    return "\n".join([*head, *("| " + " | ".join(map(cell, r)) + " |" for r in rows), "", *left])
