"""Relation candidates, quotes of edges, decisions to edges, revisions of a taxonomy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.operators.graph import EDGE_CUES, top_per_group

# Further cues that tell a direction.
DIRECTED_CUES = ["adapts", "applied to", "based on", "builds on", "builds upon", "extends", "improves", "incorporates", "integrates", "uses"]
# Pairs of different entity types between which a relation is plausible.
PLAUSIBLE_PAIRS = [
    ("method", "modeling_strategy"), ("modeling_strategy", "method"), ("data_source", "method"), ("data_source", "measurement_strategy"), ("data_source", "modeling_strategy"),
    ("measurement_strategy", "method"), ("infrastructure_tooling", "method"), ("infrastructure_tooling", "measurement_strategy"), ("infrastructure_tooling", "modeling_strategy"),
    ("evaluation_protocol", "method"), ("evaluation_protocol", "measurement_strategy"), ("method", "evaluation_protocol"), ("measurement_strategy", "evaluation_protocol"),
    ("governance_practice", "method"), ("governance_practice", "data_source"),
]
# Cues of an entity type in the text around a name, in the order in which they are tried.
TYPE_CUES = {"policy_instrument": ["policy", "regulation", "governance"], "intervention": ["intervention", "treatment"], "evaluation_protocol": ["evaluation", "benchmark", "metric"], "mechanism": ["mechanism"]}


def _any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def _names(text: Column, names: Column) -> Column:
    return F.exists(names, lambda n: F.contains(text, n))


def entity_type(context: Column, types: list[str]) -> Column:
    """Type by the first cue in the context (STR12); a type that isn't among ``types`` gives the first of them, as no cue does."""
    low, first = F.lower(context), types[0] if types else "method"
    return F.coalesce(*(F.when(_any(low, words), kind if kind in types else first) for kind, words in TYPE_CUES.items()), F.lit(first))


def relation_text(text: Column, source: Column, target: Column, cues: list[str] | None = None) -> Column:
    """The first sentence with both entities and a cue, else the first with one of them and a cue, else empty; at most 500 long (SCO03).

    ``source`` and ``target`` are arrays of lower-case names.
    """
    cues = [c for words in EDGE_CUES.values() for c in words] if cues is None else cues
    cued = F.filter(T.sentences(text), lambda s: (s != "") & _any(F.lower(s), cues))
    both = F.filter(cued, lambda s: _names(F.lower(s), source) & _names(F.lower(s), target))
    one = F.filter(cued, lambda s: _names(F.lower(s), source) | _names(F.lower(s), target))
    return F.substring(F.coalesce(F.try_element_at(both, F.lit(1)), F.try_element_at(one, F.lit(1)), F.lit("")), 1, 500)


def direction_hint(text: Column, source: Column, target: Column, cues: list[str] | None = None) -> Column:
    """1 where the first sentence that tells has a cue behind the target's and before the source's name, -1 for the other way round, else 0 (SCO03)."""
    if cues is None:
        cues = [c for kind, words in EDGE_CUES.items() if kind not in ("background", "compares") for c in words] + DIRECTED_CUES
    table = F.array(*(F.lit(c) for c in cues))

    def least(s: Column, names: Column) -> Column:
        return F.array_min(F.filter(F.transform(names, lambda n: F.position(n, s)), lambda p: p > 0))

    found = F.transform(F.transform(T.sentences(text), lambda s: F.lower(s)), lambda s: F.struct(s.alias("s"), least(s, source).alias("a"), least(s, target).alias("b")))
    named = F.filter(found, lambda x: x["a"].isNotNull() & x["b"].isNotNull())
    cued = F.transform(named, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), F.array_min(F.filter(F.transform(table, lambda c: F.position(c, x["s"])), lambda p: (p >= F.least(x["a"], x["b"])) & (p <= F.greatest(x["a"], x["b"])) & (p > 0))).alias("c")))
    first = F.try_element_at(F.filter(cued, lambda x: x["c"].isNotNull()), F.lit(1))
    return F.when(first.isNull(), 0).when((first["b"] <= first["c"]) & (first["c"] <= first["a"]), 1).otherwise(-1)


def plausible_types(source: Column, target: Column) -> Column:
    pairs = [f"{a}>{b}" for a, b in PLAUSIBLE_PAIRS]
    return (source != "") & (target != "") & ((source == target) | F.concat_ws(">", source, target).isin(pairs))


def candidate_score(
    source_in_target: Column, target_in_target: Column, source_in_source: Column, target_in_source: Column, same_document: Column, target_text: Column, source_text: Column,
    direction: Column, source_type: Column, target_type: Column, shared_nodes: Column, delta: Column,
) -> Column:
    """Struct (score, reasons) of a pair of entities in two documents (SCO03).

    The flags say which document names which entity; the texts are those of :func:`relation_text`, empty without one.
    """
    target_cue, source_cue = target_text != "", source_text != ""
    rules: list[list[tuple[Column, float, str]]] = [
        [(source_in_target & target_in_target, 0.45, "target_doc_mentions_both_entities"), (same_document & source_in_source & target_in_source, 0.4, "same_doc_mentions_both_entities"), (source_in_target, 0.25, "target_doc_mentions_source_entity")],
        [(target_cue, 0.35, "target_doc_relation_cue_near_entity"), (source_cue & ~same_document, 0.18, "source_doc_relation_cue_near_entity")],
        [(direction > 0, 0.12, "directional_cue_supports_source_to_target"), (direction < 0, -0.12, "directional_cue_points_to_reverse_pair")],
        [(same_document, 0.12, "same_document_pair")],
        [(plausible_types(source_type, target_type), 0.08, "plausible_entity_type_pair")],
        [(shared_nodes >= 2, 0.05, "multiple_shared_taxonomy_nodes")],
        [(delta >= 0, 0.05, "chronology_ok")],
        [((source_type == "evaluation_protocol") & ~source_in_target, -0.18, "evaluation_source_not_in_target_doc")],
        [(~(source_in_target | same_document), -0.22, "no_source_evidence_in_target_doc")],
    ]
    points = [F.coalesce(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(value)) for rule, value, _ in group), F.lit(0.0)) for group in rules]
    reasons = [F.coalesce(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for rule, _, name in group)) for group in rules]
    total = reduce(lambda a, b: a + b, points)
    return F.struct(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)).alias("score"), F.array_compact(F.array(*reasons)).alias("reasons"))


def role_pairs(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """``edges`` with ``role_pair``: the roles of both documents, ``missing`` where there is none (HLP01)."""
    role = F.when(F.col("role") != "", F.col("role"))
    s, t = docs.select(F.col("doc_id").alias("source_document"), role.alias("sr")), docs.select(F.col("doc_id").alias("target_document"), role.alias("tr"))
    joined = edges.join(s, "source_document", "left").join(t, "target_document", "left")
    return joined.withColumn("role_pair", F.concat_ws("->", F.coalesce("sr", F.lit("missing")), F.coalesce("tr", F.lit("missing")))).drop("sr", "tr")


def best_quote(checks: Column, evidence: Column) -> Column:
    """Struct (field, quote, reason): the longest verified check, the first of equals, else the longest quote of the evidence (HLP02).

    ``checks``: array of (field, quote, verified, reason); ``evidence``: array of (field, quote), in their order.
    """

    def longest(rows: Column) -> Column:
        numbered = F.transform(rows, lambda x, i: F.struct(F.char_length(x["quote"]).alias("n"), (-i).alias("i"), x.alias("x")))
        return F.array_max(numbered)["x"]

    good = longest(F.filter(F.coalesce(checks, F.array().cast("array<struct<field:string,quote:string,verified:boolean,reason:string>>")), lambda x: x["verified"] & (F.trim(x["quote"]) != "")))
    other = longest(F.filter(F.coalesce(evidence, F.array().cast("array<struct<field:string,quote:string>>")), lambda x: F.coalesce(x["quote"], F.lit("")) != ""))
    pick = lambda x, reason: F.struct(x["field"].alias("field"), T.normalize_space(x["quote"]).alias("quote"), reason.alias("reason"))
    none = F.struct(F.lit("").alias("field"), F.lit("").alias("quote"), F.lit("missing_quote").alias("reason"))
    return F.when(good.isNotNull(), pick(good, good["reason"])).when(other.isNotNull(), pick(other, F.lit("edge_evidence_quote"))).otherwise(none)


def plain_name(x: Column) -> Column:
    """Runs of a-z and 0-9, joined by blanks (HLP03)."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", " "))


def quote_names_both(quote: Column, names: list[Column]) -> Column:
    """Two of the names are in the quote, whole or by two of their tokens of three letters (by the only one) (HLP03)."""
    low = F.lower(T.normalize_space(quote))

    def hit(name: Column) -> Column:
        raw = F.lower(T.normalize_space(name))
        tokens = F.filter(F.split(plain_name(raw), " "), lambda t: F.char_length(t) > 2)
        found = F.size(F.filter(tokens, lambda t: F.contains(low, t)))
        return ((raw != "") & (F.contains(low, raw) | (found >= F.least(F.lit(2), F.size(tokens))))).cast("int")

    return reduce(lambda a, b: a + b, (hit(n) for n in names)) >= 2


# Names that are too general for an entity.
GENERIC_NAMES = [
    "computational social science", "data source evidence base", "computational infrastructure algorithms", "reproducibility ethics governance", "machine learning ai classification", "modeling simulation strategy",
    "measurement annotation strategy", "evaluation validation practice", "network analysis", "text as data computational text analysis", "digital trace data", "online interaction social media",
]


def is_generic(name: Column) -> Column:
    """A name that is too general, of one word, or of eight or more (HLP03)."""
    norm = plain_name(name)
    words = F.size(F.filter(F.split(norm, " "), lambda w: w != ""))
    return norm.isin(GENERIC_NAMES) | (words == 1) | (words >= 8)


def is_title_fragment(name: Column, titles: Column) -> Column:
    """Four words or more that stand in a title (HLP03); ``titles`` is an array."""
    norm = plain_name(name)
    return (F.size(F.split(norm, " ")) >= 4) & F.exists(titles, lambda t: F.contains(plain_name(t), norm))


def best_documents(entities: DataFrame, docs: DataFrame, mentions: DataFrame) -> DataFrame:
    """(entity_id, best_document, best_quote): the first supporting document that exists and the longest evidence (HLP04).

    ``entities`` has ``support_documents``, ``mentions`` (entity_id, evidence). Both are pre-aggregated before they are joined.
    """
    at = entities.select("entity_id", F.posexplode("support_documents").alias("pos", "doc_id")).join(docs.select("doc_id"), "doc_id", "left_semi")
    first = at.groupBy("entity_id").agg(F.min_by("doc_id", "pos").alias("best_document"))
    text = F.coalesce("evidence", F.lit(""))
    quote = mentions.groupBy("entity_id").agg(F.max(F.struct(F.char_length(text).alias("n"), text.alias("q"))).alias("best"))
    quote = quote.select("entity_id", F.substring(T.normalize_space(F.col("best.q")), 1, 500).alias("best_quote"))
    return entities.select("entity_id").join(first, "entity_id", "left").join(quote, "entity_id", "left").withColumn("best_quote", F.coalesce("best_quote", F.lit("")))


def needs_retry(accepted: Column, used_model: Column, error: Column, rejection: Column, attempts: Column) -> Column:
    """Whether a decision is to be asked for again (HLP05)."""
    again = ~F.coalesce(used_model, F.lit(False)) | (F.trim(F.coalesce(error, F.lit(""))) != "") | F.coalesce(rejection.isin("missing_output", "model_not_run"), F.lit(False)) | (F.coalesce(attempts, F.lit(0)) <= 0)
    return ~F.coalesce(accepted, F.lit(False)) & again


def edges_of_decisions(decisions: DataFrame, allowed: list[str]) -> DataFrame:
    """Edges of the accepted decisions of an allowed type (UDF07): ``edge_id`` from type, ends and target document, slots in order of names.

    ``decisions``: accepted, edge_type, source, target, source_document, target_document, time_delta_days, confidence, slots (array).
    """
    good = decisions.where(F.coalesce("accepted", F.lit(False)) & F.col("edge_type").isin(allowed))
    edge_id = F.concat_ws("__", *(T.slugify(F.col(c).cast("string")) for c in ("edge_type", "source", "target", "target_document")))
    always = F.array(F.lit("mechanism"), F.lit("methodological_problem"), F.lit("tradeoff"))
    slots = F.array_sort(F.array_union(F.coalesce("slots", F.array().cast("array<string>")), always))
    return good.select(edge_id.alias("edge_id"), "source", "target", "edge_type", "source_document", "target_document", "time_delta_days", F.round("confidence", 3).alias("confidence"), slots.alias("schema_slots"), F.lit(True).alias("verified"))


def slot_union(*lists: Column) -> Column:
    """Slots of several lists in order of their first place, blank ones left out; three defaults if there are none (JSN05)."""
    empty = F.array().cast("array<string>")
    every = F.array_distinct(F.filter(F.concat(*(F.coalesce(x, empty) for x in lists)), lambda s: F.trim(s) != ""))
    return F.when(F.size(every) > 0, every).otherwise(F.array(F.lit("bottleneck"), F.lit("mechanism"), F.lit("tradeoff")))


def split_confidence(edges: Column, entities: Column) -> Column:
    return F.round(F.least(F.lit(0.9), F.lit(0.55) + F.lit(0.08) * edges + F.lit(0.04) * entities), 3)


def cross_link_confidence(nodes: Column, entities: Column, edges: Column) -> Column:
    return F.round(F.least(F.lit(0.86), F.lit(0.5) + F.lit(0.04) * nodes + F.lit(0.04) * entities + F.lit(0.02) * edges), 3)


def state_confidence(successors: Column, strong: Column) -> Column:
    return F.round(F.least(F.lit(0.88), F.lit(0.54) + F.lit(0.05) * successors + F.lit(0.02) * strong), 3)


def feedback_events(feedback: DataFrame) -> DataFrame:
    """Events that a node's feedback calls for (GRF13): ``event_id, event_type, node_id, confidence``."""
    kinds = (("split_review", "feedback_split__", "fragmentation", 0.7), ("cross_link_review", "feedback_cross_link__", "cross_link", 0.6))
    found = [F.when(F.contains("advice", F.lit(word)), F.struct(F.concat(F.lit(prefix), "node_id").alias("event_id"), F.lit(event).alias("event_type"), F.lit(value).alias("confidence"))) for word, prefix, event, value in kinds]
    return feedback.select("node_id", F.explode(F.array_compact(F.array(*found))).alias("e")).select("e.event_id", "e.event_type", "node_id", "e.confidence")


def or_chains(trajectories: DataFrame, chains: DataFrame) -> DataFrame:
    """The trajectories, or the chains in their place if there are none (GRF03), by one plan: the test is a one-row aggregate."""
    empty = trajectories.limit(1).agg((F.count("*") == 0).alias("__empty"))
    return trajectories.unionByName(chains.crossJoin(F.broadcast(empty)).where("__empty").drop("__empty"))
