"""Edges, scores, evidence, paths and hooks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import values as V
from loomspan.operators.lineage import cut, written

# Cues of each relation, in the order in which they are tried.
EDGE_CUES = {
    "extends": ["extend", "build on", "build upon", "augment", "add", "incorporate"],
    "improves": ["improve", "outperform", "better", "enhance", "reduce error", "increase"],
    "replaces": ["replace", "instead of", "substitute", "supersede"],
    "adapts": ["adapt", "transfer", "port", "apply to", "generalize to"],
    "uses_component": ["use", "based on", "component", "module", "integrate"],
    "compares": ["compare", "baseline", "versus", "vs.", "benchmark against"],
    "background": ["related work", "prior work"],
}
STRONG = ["extends", "improves", "replaces", "adapts"]


def top_per_group(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each group in a total order (WIN04, WIN10); kept to k on both sides of the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def best_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The greatest row of each key by the struct of ``order`` (WIN05, SET02): an aggregation, so hot keys shrink early."""
    return df.groupBy(*key).agg(F.max_by(F.struct(*(c for c in df.columns if c not in key)), F.struct(*order)).alias("row")).select(*key, "row.*")


def entity_pairs(entities: DataFrame, node: str = "node_id", most: int = 40) -> DataFrame:
    """Ordered pairs of the first ``most`` entities of each node by support (JOI04); so a node gives at most most**2 pairs."""
    top = top_per_group(entities, [node], [F.desc("n_docs"), "first_seen", "entity_id"], most).select(node, "entity_id", "first_seen")
    a, b = top.alias("a"), top.alias("b")
    return a.join(b, node).where("a.entity_id <> b.entity_id and a.first_seen <= b.first_seen").select(node, F.col("a.entity_id").alias("source"), F.col("b.entity_id").alias("target"))


def first_pairs(rows: DataFrame, group: list[str], day: str, key: str, k: int = 3) -> DataFrame:
    """The first ``k`` pairs of each group of a row and a later or equally dated other, by target, then source (JOI05).

    The targets of the first k pairs are among the group's first k + 1 rows by (day, key), as the n-th of them has n - 1 sources,
    and so are their sources; only these rows are paired, so a large group gives no more than (k + 1) ** 2 pairs.
    """
    first = top_per_group(rows, group, [F.col(day).asc_nulls_last(), key], k + 1)
    s, t = (first.select(*group, F.col(key).alias(name), F.col(day).alias(d)) for name, d in (("source", "sd"), ("target", "td")))
    pairs = s.join(t, group).where("sd <= td and source <> target")
    return top_per_group(pairs, group, ["td", "target", "sd", "source"], k).select(*group, "source", "target", "rank")


def base_confidence(edge_type: Column, has_cue: Column, shared_node: Column, delta: Column) -> Column:
    """Confidence before any audit (SCO01)."""

    def plus(rule: Column, value: float) -> Column:
        return F.when(rule, value).otherwise(0.0)

    score = F.lit(0.45) + plus(edge_type.isin(STRONG), 0.2) + plus(has_cue, 0.15) + plus(shared_node, 0.1) + plus(delta >= 0, 0.1)
    return F.round(F.when(edge_type == "background", 0.35).otherwise(F.least(F.lit(0.95), score)), 3)


def temporal_score(delta: Column) -> Column:
    return F.when(delta.isNull(), 0.6).when(delta < 0, 0.0).when(delta == 0, 0.8).otherwise(1.0)


def edge_score(confidence: Column, quote: Column, temporal: Column, locality: Column, schema_fit: Column, slots: Column) -> Column:
    """Weighted score of an edge (SCO02)."""
    return F.round(V.clamp01(V.weighted({0.30: confidence}) + V.weighted({0.22: quote}) + V.weighted({0.16: temporal}) + F.lit(0.12) * locality + F.lit(0.12) * schema_fit + F.lit(0.08) * slots), 3)


def stratum(edge_type: Column, confidence: Column, verified: Column, trusted: float = 0.65, candidate: float = 0.35) -> Column:
    """trusted, candidate or unverified (FIL03)."""
    return (
        F.when(edge_type.isin(STRONG) & (confidence >= trusted) & verified, "trusted")
        .when(confidence >= candidate, "candidate")
        .otherwise("unverified")
    )


def first_tier(df: DataFrame, status: str = "status") -> DataFrame:
    """Trusted edges if there are any, else candidates, else the rest (FIL04)."""
    rank = F.when(F.col(status) == "trusted", 0).when(F.col(status) == "candidate", 1).otherwise(2)
    best = df.agg(F.min(rank).alias("best"))  # one row
    return df.join(F.broadcast(best), rank == F.col("best")).drop("best")


def aggregate_edges(edges: DataFrame) -> DataFrame:
    """Edges by source, target and type (AGG01)."""
    key = ["source", "target", "edge_type"]
    edges = written(edges.select(*key, "source_document", "target_document", "node_id", "confidence", "verified"))
    # documents are counted by pairs, so none of an edge's sets of them is gathered; they are moved once, two a row
    docs = edges.select(*key, "source_document", "target_document").repartition(*key).select(*key, F.explode(F.array("source_document", "target_document")).alias("doc")).distinct().groupBy(*key).agg(F.count("doc").alias("n_docs"))
    per = edges.groupBy(*key).agg(F.count("*").alias("n_edges"), F.array_sort(F.collect_set("node_id")).alias("nodes"), F.round(F.avg("confidence"), 3).alias("confidence"), F.count_if("verified").alias("verified_count"))
    return per.join(docs, key).select(*key, "n_edges", F.col("n_docs").cast("int").alias("n_docs"), "nodes", "confidence", "verified_count")


def branch_points(edges: DataFrame, least: int = 2) -> DataFrame:
    """Sources with several distinct verified strong targets (AGG21)."""
    good = edges.where(F.col("verified") & F.col("edge_type").isin(STRONG))
    return good.groupBy("source").agg(F.count_distinct("target").alias("targets")).where(F.col("targets") >= least)


def degrees(edges: DataFrame) -> DataFrame:
    """In-degree and out-degree (GRF05)."""
    ends = edges.select(F.col("source").alias("entity_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("target").alias("entity_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("entity_id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def remap_edges(edges: DataFrame, links: DataFrame) -> DataFrame:
    """Ends through a link table, without self loops, the most confident of each (source, target, type) (JOI09)."""
    a, b = links.select(F.col("entity_id").alias("source"), F.col("canonical_id").alias("s")), links.select(F.col("entity_id").alias("target"), F.col("canonical_id").alias("t"))
    moved = edges.join(a, "source", "left").join(b, "target", "left").select("edge_id", F.coalesce("s", "source").alias("source"), F.coalesce("t", "target").alias("target"), "edge_type", "confidence")
    return best_per_key(moved.where("source <> target"), ["source", "target", "edge_type"], [F.col("confidence"), -F.col("edge_id")])


def step_score(confidence: Column, temporal: Column, quote: Column, schema: Column, locality: Column, depth: int) -> Column:
    """Score of a trajectory's step at a depth (SCO05)."""
    return F.round((F.lit(0.34) * confidence + F.lit(0.24) * temporal + F.lit(0.18) * quote + F.lit(0.14) * schema + F.lit(0.10) * locality) * F.lit(max(0.75, 1 - 0.04 * depth)), 3)


def beam_paths(edges: DataFrame, depth: int = 4, beam: int = 6, fan_out: int = 6) -> DataFrame:
    """Simple paths by beam search from every entity (GRF01, GRF02).

    ``edges`` (source, target, weight), one row a pair. One join a level, whose result is written; out-edges are capped at ``fan_out``
    before any join and paths at ``beam`` for each start after it, so a level has at most starts * beam * fan_out rows.
    Every survivor of every level is returned: ``start, path, score`` (mean weight), ``depth``.
    """
    out = cut(top_per_group(edges, ["source"], [F.desc("weight"), "target"], fan_out).select("source", "target", "weight"))
    level = out.select(F.col("source").alias("start"), F.array("source", "target").alias("path"), F.col("target").alias("tip"), F.col("weight").alias("total"))
    found = []
    for k in range(1, depth + 1):
        if k > 1:
            level = level.join(out, level["tip"] == out["source"]).where(~F.array_contains("path", F.col("target"))).select("start", F.concat("path", F.array("target")).alias("path"), F.col("target").alias("tip"), (F.col("total") + F.col("weight")).alias("total"))
        ranked = level.withColumn("score", F.round(F.col("total") / k, 6)).withColumn("key", F.array_join("path", ">"))
        level = cut(top_per_group(ranked, ["start"], [F.desc("score"), "key"], beam).drop("rank"))
        found.append(level.select("start", F.col("key").alias("path"), "score", F.lit(k).alias("depth")))
        level = level.select("start", "path", "tip", "total")
    return reduce(DataFrame.unionByName, found)


def step_scores(edges: DataFrame, depth: int) -> Column:
    """Score of an edge as the step of a trajectory at ``depth`` (SCO05); ``edges`` has confidence, time_delta_days, and local and schema_fit if known."""
    local = F.when(F.col("local"), 1.0).otherwise(0.6) if "local" in edges.columns else F.lit(1.0)
    fit = V.clamp01(F.col("schema_fit")) if "schema_fit" in edges.columns else F.lit(0.75)
    return step_score(F.col("confidence"), temporal_score(F.col("time_delta_days")), F.lit(1.0), fit, local, depth)


def trajectories(edges: DataFrame, depth: int = 4, beam: int = 6, fan_out: int = 6, strong: list[str] | None = None) -> DataFrame:
    """Trajectories by a beam search over the verified, strong, not backward edges (GRF02): a path's score is the mean of its steps' scores.

    ``edges``: edge_id, source, target, edge_type, verified, confidence, time_delta_days. Of paths over the same entities the best
    stays. Returns ``entity_path, edge_path`` (arrays)``, trajectory_score, path_length, mean_edge_confidence, temporal_coherence, quote_grounding, branching_factor``.
    """
    temporal = temporal_score(F.col("time_delta_days"))
    good = edges.where(F.col("edge_type").isin(STRONG if strong is None else strong) & F.col("verified") & (F.col("confidence") > 0) & (temporal > 0))
    rows = good.select(F.col("edge_id").cast("string").alias("edge_id"), "source", "target", "confidence", temporal.alias("temporal"), *(step_scores(edges, k).alias(f"s{k}") for k in range(depth)))
    degree = rows.groupBy("source").agg(F.count("*").alias("degree"))
    # each level is read by the next and by the result: written once, it isn't planned and run again for every later level
    out = cut(top_per_group(rows, ["source"], [F.desc("s0"), "target", "edge_id"], fan_out).drop("rank"))
    level, found = None, []
    for k in range(depth):
        if level is None:
            level = out.select(F.col("source").alias("start"), F.array("source", "target").alias("path"), F.array("edge_id").alias("steps"), F.col("target").alias("tip"), F.col("s0").alias("total"), F.col("confidence").alias("sure"), F.col("temporal").alias("time")).where("start <> tip")
        else:
            joined = level.join(out, level["tip"] == out["source"]).where(~F.array_contains("path", F.col("target")))
            level = joined.select("start", F.concat("path", F.array("target")).alias("path"), F.concat("steps", F.array("edge_id")).alias("steps"), F.col("target").alias("tip"), (F.col("total") + F.col(f"s{k}")).alias("total"), (F.col("sure") + F.col("confidence")).alias("sure"), (F.col("time") + F.col("temporal")).alias("time"))
        ranked = level.withColumn("score", F.round(F.col("total") / (k + 1), 3))
        level = cut(top_per_group(ranked, ["start"], [F.desc("score"), "path", "steps"], beam).drop("rank"))
        found.append(level.select("path", "steps", "score", F.lit(k + 1).alias("length"), F.round(F.col("sure") / (k + 1), 3).alias("sure"), F.round(F.col("time") / (k + 1), 3).alias("time")))
    best = top_per_group(reduce(DataFrame.unionByName, found), ["path"], [F.desc("score"), "steps"], 1).drop("rank")
    branching = best.select("path", F.explode("path").alias("source")).join(degree, "source").groupBy("path").agg(F.max("degree").alias("branching_factor"))
    return best.join(branching, "path").select(
        F.col("path").alias("entity_path"), F.col("steps").alias("edge_path"), F.col("score").alias("trajectory_score"), F.col("length").alias("path_length"), F.col("sure").alias("mean_edge_confidence"),
        F.col("time").alias("temporal_coherence"), F.lit(1.0).alias("quote_grounding"), "branching_factor",
    )


def schema_fit(edge_type: Column, schema: dict[str, dict], strong: list[str]) -> Column:
    """How well a relation type is described (SCO02): unknown 0.25, else 0.55 and more for a strong type, slots and a definition."""
    fits = {name: min(1.0, 0.55 + 0.2 * (name in strong) + 0.15 * bool(spec.get("evidence_slots")) + 0.1 * bool(spec.get("definition"))) for name, spec in schema.items()}
    return F.coalesce(*(F.when(edge_type == name, F.lit(value)) for name, value in fits.items()), F.lit(0.25))


def slot_completeness(edge_type: Column, filled: Column, schema: dict[str, dict], required: list[str]) -> Column:
    """Share of the slots that a relation type calls for, else of the required ones, that are filled; 0.8 if none is called for (SCO02). ``filled``: array of slots."""

    def share(slots: list[str]) -> Column:
        return F.size(F.array_intersect(F.array(*(F.lit(s) for s in slots)), filled)) / len(slots) if slots else F.lit(0.8)

    return F.coalesce(*(F.when(edge_type == name, share(list(spec.get("evidence_slots") or required))) for name, spec in schema.items()), share(required))


def quote_grounding(verified: Column, verified_quotes: Column, has_quote: Column) -> Column:
    """1 for a verified edge, 0.75 with a verified quote, 0.45 with any quote, else 0.1 (SCO02)."""
    return F.when(verified, 1.0).when(F.coalesce(verified_quotes, F.lit(0)) > 0, 0.75).when(F.coalesce(has_quote, F.lit(False)), 0.45).otherwise(0.1)


def successor_paths(edges: DataFrame, depth: int = 4, fan_out: int = 4) -> DataFrame:
    """Strict successor paths (GRF04), unique by their edges: ``edge_path, path, score`` (mean confidence), ``depth``.

    ``edges`` (edge_id, source, target, confidence, time_delta_days); parallel edges are paths of their own. Every edge is a
    path of one step. Longer ones start where no edge ends, or everywhere if there is no such entity; only for these each
    entity goes on by its first ``fan_out`` edges, and to none that the path holds.
    """
    e = edges.select(F.col("edge_id").cast("string").alias("edge_id"), "source", "target", "confidence", F.coalesce("time_delta_days", F.lit(0)).alias("days"))
    filled = reduce(lambda a, b: a & b, (F.coalesce(F.col(c), F.lit("")) != "" for c in ("edge_id", "source", "target")))
    row = [F.col("source").alias("start"), F.array("edge_id").alias("edges"), F.array("source", "target").alias("path"), F.col("target").alias("tip"), F.col("confidence").alias("total")]
    out = top_per_group(e, ["source"], [F.desc("confidence"), "days", "target", "edge_id"], fan_out).where(filled).select("edge_id", "source", "target", "confidence")
    ends = e.select(F.col("target").alias("source")).distinct().withColumn("ended", F.lit(True))
    sources = e.select("source").distinct().join(ends, "source", "left").select("source", F.col("ended").isNull().alias("free"))
    any_free = sources.agg(F.max("free").alias("any"))  # one row
    starts = sources.join(F.broadcast(any_free), F.col("free") == F.col("any")).select("source")
    level = out.where("source <> target").join(starts, "source", "left_semi").select(*row)
    levels = [e.where(filled).select(*row)]
    for _ in range(1, depth):
        level = level.join(out, level["tip"] == out["source"]).where(~F.array_contains("path", F.col("target"))).select("start", F.concat("edges", F.array("edge_id")).alias("edges"), F.concat("path", F.array("target")).alias("path"), F.col("target").alias("tip"), (F.col("total") + F.col("confidence")).alias("total"))
        levels.append(level)
    steps = F.size("edges")
    return reduce(DataFrame.unionByName, levels).select(F.array_join("edges", ">").alias("edge_path"), F.array_join("path", ">").alias("path"), F.round(F.col("total") / steps, 6).alias("score"), steps.alias("depth"))


def year_series(facts: dict[str, DataFrame]) -> DataFrame:
    """A row for each year from the first to the last of any table (column ``year``), with counts, gaps 0 (JOI23)."""
    parts = [df.groupBy("year").agg(F.count("*").alias(n)).select("year", *(F.col(n) if n == m else F.lit(0).cast("long").alias(m) for m in facts)) for n, df in facts.items()]
    counts = reduce(DataFrame.unionByName, parts).where("year is not null").groupBy("year").agg(*(F.sum(n).alias(n) for n in facts))
    years = counts.agg(F.explode(F.sequence(F.min("year"), F.max("year"))).alias("year"))
    return years.join(counts, "year", "left").select("year", *(F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in facts))


def upper_median(df: DataFrame, group: str, value: str) -> DataFrame:
    """The middle value, the upper of two, with count, least and greatest (AGG20).

    Values are counted first; a running count over distinct values then finds the middle, so no group is held as a list.
    """
    counts = df.groupBy(group, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(group).orderBy(value)
    run = counts.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy(group)))
    middle = F.floor(F.col("n") / 2)
    hit = (F.col("upto") > middle) & (F.col("upto") - F.col("c") <= middle)
    return run.groupBy(group).agg(F.max("n").alias("n"), F.min(value).alias("low"), F.max(F.when(hit, F.col(value))).alias("median"), F.max(value).alias("high"))
