"""State, macro patterns, quality, successors, sampling and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.functions import values as V
from loomspan.operators.graph import STRONG, top_per_group
from loomspan.operators.names import names_in_texts


def node_states(facts: DataFrame) -> DataFrame:
    """stable < emerging < active < bridging for each node (AGG11); ``facts`` has (node_id, event)."""
    per = facts.groupBy("node_id").agg(F.count_if(F.col("event").isin("birth", "split")).alias("born"), F.count_if(F.col("event") == "state_update").alias("updates"), F.count_if(F.col("event") == "edge").alias("edges"), F.count_if(F.col("event") == "cross_link").alias("links"))
    state = F.when(F.col("links") > 0, "bridging").when((F.col("updates") > 0) | (F.col("edges") >= 3), "active").when(F.col("born") > 0, "emerging").otherwise("stable")
    return per.select("node_id", state.alias("state"), "edges")


def feedback(edges: DataFrame) -> DataFrame:
    """Counts of a node's edges and what to do about it (AGG09)."""
    strong = F.col("verified") & F.col("edge_type").isin(STRONG)
    per = edges.groupBy("node_id").agg(F.count("*").alias("edges"), F.count_if(strong).alias("strong"), F.count_distinct(F.when(strong, F.col("target"))).alias("successors"), F.count_distinct(F.when(strong, F.col("source"))).alias("sources"), F.count_distinct("source").alias("entities"))
    advice = F.array_compact(F.array(F.when((F.col("successors") >= 3) & (F.col("sources") >= 2), "split_review"), F.when((F.col("entities") >= 4) & (F.col("edges") >= 4), "cross_link_review")))
    return per.withColumn("advice", F.when(F.size(advice) > 0, F.array_join(advice, ",")).otherwise("monitor"))


def transitions(edges: DataFrame, rejected: DataFrame) -> DataFrame:
    """Union of edge transitions and rejection-reason counts (AGG12, SET03)."""
    down = edges.where("score < 0.55").groupBy("edge_type").agg(F.count("*").alias("n")).select(F.lit("edge_downweighted").alias("kind"), F.col("edge_type").alias("key"), "n", F.lit(None).cast("double").alias("confidence"))
    negative = rejected.groupBy("reason").agg(F.count("*").alias("n")).select(F.lit("negative_relation").alias("kind"), F.col("reason").alias("key"), "n", F.round(F.least(F.lit(0.95), F.lit(0.35) + F.lit(0.04) * F.col("n")), 3).alias("confidence"))
    return down.unionByName(negative)


# The weight of an event for a pattern.
EVENT_PATTERNS = {"birth": ("differentiation", 0.48), "split": ("differentiation", 0.72), "cross_link": ("convergence", 0.65), "state_update": ("stabilization", 0.35), "revision": ("recontextualization", 0.36)}


def macro_features(events: DataFrame) -> DataFrame:
    """(feature, event, slice, pattern, score) of each event that speaks for a pattern (AGG15, HLP10)."""
    table = F.create_map(*(x for e, (p, w) in EVENT_PATTERNS.items() for x in (F.lit(e), F.struct(F.lit(p).alias("pattern"), F.lit(w).alias("score")))))
    rows = events.withColumn("hit", table[F.col("event")]).where("hit is not null")
    return rows.select("feature", "slice", F.col("hit.pattern").alias("pattern"), (F.col("hit.score") * F.col("weight")).alias("score"))


def pattern_profiles(features: DataFrame, k: int = 5) -> DataFrame:
    """Score of each pattern with its best features (AGG16): mean plus a bonus for their number, at most 1."""
    per = features.groupBy("pattern").agg(F.count("*").alias("n"), F.avg("score").alias("mean"))
    best = top_per_group(features, ["pattern"], [F.desc("score"), "feature"], k).groupBy("pattern").agg(F.array_join(F.array_sort(F.collect_list("feature")), ",").alias("evidence"))
    return per.join(best, "pattern").select("pattern", "n", F.round(V.clamp01(F.col("mean") + F.least(F.lit(0.35), F.lit(0.035) * F.col("n"))), 3).alias("score"), "evidence")


def pattern_timeline(features: DataFrame) -> DataFrame:
    """Score of each pattern and slice (AGG17)."""
    return features.groupBy("pattern", "slice").agg(F.count("*").alias("n"), F.round(V.clamp01(F.avg("score") + F.least(F.lit(0.2), F.lit(0.03) * F.count("*"))), 3).alias("score"))


def shares(df: DataFrame, value: str, k: int | None = None) -> DataFrame:
    """Count and share of each value, commonest first (AGG19, AGG22). The whole is a one-row sum over the counts."""
    counts = df.groupBy(value).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("all"))
    out = counts.crossJoin(F.broadcast(whole)).select(value, "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))
    return out if k is None else out.orderBy(F.desc("n"), value).limit(k)


def hubs(edges: DataFrame, least: int = 3) -> DataFrame:
    """Sources with ``least`` targets or more (branching) and targets with as many sources (convergence) (AGG18)."""
    out = edges.groupBy("source").agg(F.count_distinct("target").alias("n")).where(F.col("n") >= least).select(F.lit("branching").alias("kind"), F.col("source").alias("entity_id"), "n")
    into = edges.groupBy("target").agg(F.count_distinct("source").alias("n")).where(F.col("n") >= least).select(F.lit("convergence").alias("kind"), F.col("target").alias("entity_id"), "n")
    return out.unionByName(into).withColumn("score", F.round(F.least(F.lit(1.0), F.col("n") / 8), 3))


SCHEMA_GROUPS = {
    "method": "analytic_method", "modeling_strategy": "analytic_method", "measurement_strategy": "analytic_method",
    "data_source": "evidence_and_infrastructure", "infrastructure_tooling": "evidence_and_infrastructure",
    "evaluation_protocol": "validation_and_governance", "governance_practice": "validation_and_governance",
}


def schema_group(kind: Column) -> Column:
    """Group of an entity type; an unknown type is its own (HLP07)."""
    table = F.create_map(*(x for k, g in SCHEMA_GROUPS.items() for x in (F.lit(k), F.lit(g))))
    return F.coalesce(table[kind], kind)


def successor_edges(edges: DataFrame) -> DataFrame:
    """Edges within a schema group that lead forward in time (FIL05)."""
    return edges.where((schema_group(F.col("source_type")) == schema_group(F.col("target_type"))) & (F.col("time_delta_days") > 0))


def pre_score(shared: Column, overlap: Column, mentioned: Column, years: Column, support: Column) -> Column:
    """Order of possible predecessors (SCO04)."""
    return F.round(2 * shared + 1.5 * overlap + 4 * mentioned + 1 / (1 + years) + F.least(F.lit(2.0), 0.25 * F.log1p(support)), 6)


def older_sources(entities: DataFrame, scope: str, years: float = 18, k: int = 120, texts: DataFrame | None = None) -> DataFrame:
    """Possible predecessors of each entity in its scope (JOI13): first seen up to ``years`` years of 365.25 days earlier, the best ``k``.

    ``entities``: entity_id, canonical_name, first_seen, n_docs, tokens, nodes. A pair shares a node or a name token, or the target's text in ``texts``
    (entity_id, text) holds the source's name in any case. Ranked by pre-score, then nearness in time, then id. Returns ``source, target, days, shared, overlap, mentioned, score, rank``.
    """
    # entities meet at a shared token or node only; the shared ones are summed before anything is ranked
    shared = lambda c, kind: F.transform(F.array_distinct(c), lambda x: F.struct(F.lit(kind).alias("kind"), x.cast("string").alias("item")))
    items = entities.select(scope, "entity_id", "first_seen", "n_docs", F.explode(F.concat(shared(F.col("tokens"), "t"), shared(F.col("nodes"), "n"))).alias("x")).select(scope, "entity_id", "first_seen", "n_docs", "x.kind", "x.item")
    a = items.select(scope, "kind", "item", F.col("entity_id").alias("source"), F.col("first_seen").alias("sf"), F.col("n_docs").alias("support"))
    b = items.select(scope, "kind", "item", F.col("entity_id").alias("target"), F.col("first_seen").alias("tf"))
    met = a.join(b, [scope, "kind", "item"]).select("source", "target", "sf", "tf", "support", "kind")
    if texts is not None:
        named = entities.select(F.col(scope).alias("scope"), F.col("entity_id").alias("source"), F.lower("canonical_name").alias("name"), F.col("first_seen").alias("sf"), F.col("n_docs").alias("support"))
        found = names_in_texts(texts.select(F.col("entity_id").alias("target"), F.lower("text").alias("text")), named, "target")
        holder = entities.select(F.col(scope).alias("own"), F.col("entity_id").alias("target"), F.col("first_seen").alias("tf"))
        held = found.join(named, "name").join(holder, "target").where("scope = own")
        met = met.unionByName(held.select("source", "target", "sf", "tf", "support", F.lit("m").alias("kind")))
    days = F.datediff("tf", "sf")
    pairs = met.where((days > 0) & (days <= 365.25 * years)).groupBy("source", "target", days.alias("days"), "support").agg(
        F.count_if(F.col("kind") == "n").alias("shared"), F.count_if(F.col("kind") == "t").alias("overlap"), F.max(F.col("kind") == "m").alias("mentioned")
    )
    score = pre_score(F.col("shared"), F.col("overlap"), F.col("mentioned").cast("int"), F.col("days") / 365.25, F.col("support"))
    return top_per_group(pairs.withColumn("score", score), ["target"], [F.desc("score"), "days", "source"], k).select("source", "target", "days", "shared", "overlap", "mentioned", "score", "rank")


# Cues of an evolution in a text.
EVOLUTION_CUES = [
    "adapt", "based on", "benchmark", "build", "extend", "improv", "instead of", "move beyond", "new method", "outperform", "replace", "robust", "scale", "supersed",
]


def candidate_score(shared: Column, overlap: Column, source_name: Column, target_name: Column, text: Column, years: Column, support: Column) -> Column:
    """Struct (score, reasons) of a possible successor (SCO04): ``text`` is the target's best document, ``support`` its number of documents.

    A source's name in the text counts more with a cue near, and nothing where the target's own name holds it.
    """
    low, name = F.lower(text), F.lower(source_name)
    mentioned, inside = F.contains(low, name), F.contains(F.lower(target_name), name)
    near = T.cue_near(text, source_name, EVOLUTION_CUES, 160)
    rules = [
        (shared > 0, F.least(F.lit(0.28), 0.08 * shared), "shared_taxonomy"), (overlap > 0, F.least(F.lit(0.16), 0.06 * overlap), "name_token_overlap"),
        (mentioned & inside, F.lit(0.0), "target_label_contains_source_label"), (mentioned & ~inside & near, F.lit(0.24), "target_text_mentions_source_with_evolution_cue"),
        (mentioned & ~inside & ~near, F.lit(0.12), "target_text_mentions_source"), (reduce(lambda a, b: a | b, (F.contains(low, F.lit(c)) for c in EVOLUTION_CUES)), F.lit(0.08), "target_text_has_evolution_cue"),
        (years <= 6, F.lit(0.12), "near_temporal_successor"), ((years > 6) & (years <= 12), F.lit(0.06), "medium_temporal_successor"),
    ]
    total = reduce(lambda a, b: a + b, (F.when(rule, value).otherwise(0.0) for rule, value, _ in rules)) + F.least(F.lit(0.08), F.log1p(support) * 0.03)
    return F.struct(F.least(F.lit(1.0), total).alias("score"), F.array_compact(F.array(*(F.when(rule, F.lit(why)) for rule, _, why in rules))).alias("reasons"))


DISPLAY_RULES = ("raw_rejected", "relation_type_not_for_display", "low_confidence", "too_near_in_time", "same_source_and_target_document")


def display_rejection(accepted: Column, edge_type: Column, confidence: Column, delta: Column, source_doc: Column, target_doc: Column, types: list[str], least: float = 0.84, days: int = 180) -> Column:
    """The first rule by which an edge isn't shown, empty if it is (FIL06, the rules on its figures; ``display.with_rejection`` has all). No time delta counts as 0."""
    rules = (~accepted, ~edge_type.isin(types), confidence < least, F.coalesce(delta, F.lit(0)) < days, source_doc == target_doc)
    return F.coalesce(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for rule, name in zip(rules, DISPLAY_RULES, strict=True)), F.lit(""))


def hash_order(seed: int, *keys: str) -> Column:
    """A fixed random order: by a digest of the keys and a seed (WIN12)."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def stratified(df: DataFrame, stratum: str, key: str, size: int, seed: int = 7) -> DataFrame:
    """``size`` rows: an equal quota from each stratum, then filled from the rest, in hash order (WIN12)."""
    order = hash_order(seed, key)
    ranked = df.withColumn("h", order).withColumn("nth", F.row_number().over(Window.partitionBy(stratum).orderBy("h", key)))
    strata = df.agg(F.count_distinct(stratum).alias("strata"))
    quota = ranked.crossJoin(F.broadcast(strata)).withColumn("first", F.col("nth") <= F.floor(F.lit(size) / F.col("strata")))
    return quota.orderBy(F.desc("first"), "h", key).limit(size).drop("nth", "strata", "h", "first")


def quota_sample(df: DataFrame, strata: list[list[str]], key: str, quota: int, seed: int = 7) -> DataFrame:
    """Union of the first ``quota`` rows of each stratum of several stratifications (WIN13)."""
    parts = [top_per_group(df.withColumn("h", hash_order(seed + k, key)), by, ["h", key], quota).select(*df.columns) for k, by in enumerate(strata)]
    return reduce(DataFrame.unionByName, parts).distinct()


def page(df: DataFrame, query: str, columns: list[str], order: list, offset: int, limit: int) -> DataFrame:
    """Rows with the words in any column, a page of a total order (WIN11)."""
    hit = reduce(lambda a, b: a | b, (F.contains(F.lower(F.col(c)), F.lit(query.lower())) for c in columns))
    return df.where(hit).orderBy(*order).offset(offset).limit(limit)


def probe_variant(assigned: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Coverage, overlap, balance and overload of a taxonomy (AGG27), one row."""
    per_doc = docs.select("doc_id").join(assigned.groupBy("doc_id").agg(F.count_distinct("node_id").alias("n")), "doc_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    d = per_doc.agg(F.count("*").alias("docs"), F.count_if(F.col("n") > 0).alias("covered"), F.count_if(F.col("n") >= 4).alias("overloaded"), F.avg("n").alias("mean_nodes"))
    per_node = nodes.select("node_id").join(assigned.groupBy("node_id").agg(F.count_distinct("doc_id").alias("n")), "node_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    mean = per_node.agg(F.avg("n").alias("m"))
    b = per_node.crossJoin(F.broadcast(mean)).agg(F.avg(F.abs(F.col("n") - F.col("m"))).alias("deviation"), F.max("m").alias("m"))
    coverage, balance, over = F.col("covered") / F.col("docs"), V.clamp01(1 - F.col("deviation") / F.greatest("m", F.lit(1.0))), F.col("overloaded") / F.col("docs")
    return d.crossJoin(b).select("docs", "covered", F.round(coverage, 6).alias("coverage"), F.round(balance, 6).alias("balance"), F.round(over, 6).alias("overloaded_share"), F.round("mean_nodes", 6).alias("mean_nodes"))


def expansion_score(density: Column, mass: Column, heterogeneity: Column, uncertainty: Column, burst: Column, entity_burst: Column, bottleneck: Column, evaluation: Column) -> Column:
    """Weighted sum of the eight signals (SCO07)."""
    parts = (density, mass, heterogeneity, uncertainty, burst, entity_burst, bottleneck, evaluation)
    return F.round(sum((F.lit(w) * p for w, p in zip((0.15, 0.12, 0.18, 0.12, 0.12, 0.13, 0.10, 0.08), parts, strict=True)), F.lit(0.0)), 3)


def expansion_action(mass: Column, burst: Column, density: Column, heterogeneity: Column, uncertainty: Column) -> Column:
    """What a node's signals call for, the first that applies (AGG08)."""
    return F.when((mass >= 0.4) & (burst >= 0.5), "width_expansion").when((density >= 0.5) & (heterogeneity >= 0.55), "depth_expansion").when(uncertainty >= 0.7, "assignment_review").otherwise("monitor")


def hook_score(evidence: Column, verified: Column, length: Column, is_open: Column, maturity: Column, risk: Column) -> Column:
    """Score of a forecast hook (SCO06)."""
    return F.round(V.clamp01(F.lit(0.28) * evidence + F.lit(0.22) * verified + F.lit(0.18) * F.least(F.lit(1.0), length / 4) + F.lit(0.14) * is_open + F.lit(0.12) * maturity - F.lit(0.06) * risk), 3)


def trajectory_metrics(paths: DataFrame) -> DataFrame:
    """(metric, value) of trajectories (AGG23)."""
    mean = lambda c: F.round(F.avg(c), 6)
    one = paths.agg(F.count("*").cast("double").alias("trajectories"), mean("trajectory_score").alias("mean_score"), mean("path_length").alias("mean_length"), F.max("path_length").cast("double").alias("longest"), mean("mean_edge_confidence").alias("mean_confidence"), mean("temporal_coherence").alias("mean_temporal"))
    return one.select(F.expr(f"stack({len(one.columns)}, {', '.join(f"'{c}', {c}" for c in one.columns)}) AS (metric, value)"))


def token_profiles(docs: DataFrame, group: str, k: int = 20) -> DataFrame:
    """The commonest tokens of each group (AGG28)."""
    counts = docs.select(F.col(group).alias("grp"), F.explode(T.tokenize(F.col("text"))).alias("token")).groupBy("grp", "token").agg(F.count("*").alias("n"))
    return top_per_group(counts, ["grp"], [F.desc("n"), "token"], k).select(F.col("grp").alias(group), "rank", "token", "n")


def heterogeneity(docs: DataFrame, group: str, size: int = 120) -> DataFrame:
    """1 - mean pairwise Jaccard of tokens over at most ``size`` documents spread evenly over each group (AGG08).

    The spread sample is the operator's own definition; it bounds the pairs of a group at size**2 / 2.
    """
    w = Window.partitionBy(group)
    n, nth = F.count("*").over(w), F.row_number().over(w.orderBy("doc_id")) - 1
    step = F.greatest(F.lit(1.0), F.col("n") / size)
    ids = docs.select(group, "doc_id").withColumn("n", n).withColumn("nth", nth).where(F.floor(F.floor((F.col("nth") + step - 1e-9) / step) * step) == F.col("nth"))
    spread = docs.join(ids.select(group, "doc_id"), [group, "doc_id"], "left_semi")
    own = spread.select(group, "doc_id", F.array_distinct(T.tokenize(F.col("text"))).alias("t"))
    a, b = own.alias("a"), own.alias("b")
    pairs = a.join(b, group).where("a.doc_id < b.doc_id").select(group, T.jaccard(F.col("a.t"), F.col("b.t")).alias("j"))
    return pairs.groupBy(group).agg(F.count("*").alias("pairs"), F.round(F.greatest(F.lit(0.0), 1 - F.avg("j")), 6).alias("heterogeneity"))
