"""Which accepted relations are shown: the first rule that speaks against one (FIL06, HLP06)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.operators.insight import EVOLUTION_CUES, SCHEMA_GROUPS, schema_group
from loomspan.operators.labels import ANCHORS, content_tokens, label_tokens, with_generic_predecessor, with_variant_reason

# Relation types that are shown.
SHOWN = ["adapts", "extends", "improves", "replaces", "specializes", "generalizes"]
# Labels that say too little as a whole.
WEAK_PHRASES = [
    "computational methodologies", "fine tuned machine learning models", "machine and deep learning", "machine learning based modeling", "machine learning classification models", "machine learning applied to political",
    "machine learning ml methods", "mame re", "methodological approach", "methodological foundation", "ongoing methodological program", "parameter settings", "political science", "preprocessing steps", "python implementation",
    "replicable methodology", "statistical inference", "survey research", "systematic review", "traditional machine learning", "unsupervised machine learning method", "working python implementation",
]
# Last words of weak labels.
WEAK_TAILS = [
    "actor", "actors", "baseline", "baselines", "challenge", "challenges", "consideration", "considerations", "data", "methodologies", "methodology", "posts", "practice", "practices", "program", "programs", "process",
    "processes", "recommendation", "recommendations", "sample", "samples", "science", "settings", "steps", "structure", "task", "tasks",
]
# Last words of labels that are tasks.
TASK_TAILS = ["analysis", "classification", "coding", "detection", "estimation", "extraction", "identification", "measurement", "prediction", "recognition"]
# Last words of labels of whole families.
FAMILY_TAILS = ["approach", "approaches", "framework", "frameworks", "method", "methods", "model", "models", "strategy", "strategies", "technique", "techniques"]
# Words that no data source's label has.
NO_DATA = ["bert", "embedding", "embeddings", "language", "llm", "model", "models", "neural", "transformer", "transformers"]
# Cues of a lineage, and further ones of an improvement.
LINEAGE_CUES = ["adapt", "alternative", "benchmark", "build", "complement", "extend", "improv", "instead", "limitation", "move beyond", "outperform", "overcome", "propose", "replace", "supersed"]
IMPROVED = ["accuracy", "baseline", "f1", "performance", "reduce", "superior"]
# Words of network architectures, and those of them that call for a closer look.
ARCHITECTURE = [
    "ann", "artificial", "attention", "bayesian", "bert", "cnn", "convolutional", "deep", "embedding", "embeddings", "encoder", "gcn", "genn", "gnn", "graph", "language", "lstm", "mlp", "neural",
    "recurrent", "transformer", "transformers",
]
NETWORKS = ["ann", "cnn", "gcn", "gnn", "lstm", "neural", "transformer", "transformers"]
# Words that ground a quote in the domain.
DOMAIN = [
    "annotation", "behavior", "behaviour", "bias", "classification", "coding", "discourse", "election", "emotion", "event", "gender", "hate", "ideology", "misinformation", "network", "political", "propaganda",
    "public", "sentiment", "sexism", "social", "survey", "text", "tweet", "twitter", "user",
]
# A rationale with one of these rests on other knowledge than the texts.
EXTERNAL = ["does not explicitly cite", "not explicitly cite", "well-established", "general machine learning literature", "broader machine learning", "known in machine learning"]
# Single words that are labels, further anchors of a label, and words of a comparison.
LONE = ["bert", "gpt", "lda", "llm", "mcmc", "svm"]
MORE_ANCHORS = ["centrality", "clustering", "cosine", "digital", "filtering", "graph", "hierarchical", "language", "likelihood", "network", "neural", "similarity", "text", "twins"]
COMPARED = ["baseline", "outperform", "improve", "compared", "limitation", "instead"]


def _words(words: list[str]) -> Column:
    return F.array(*(F.lit(w) for w in words))


def _any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def _first(rules: list[tuple[Column, str]]) -> Column:
    return F.coalesce(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for rule, name in rules), F.lit(""))


def end_type(own: Column, candidate: Column, entity_id: Column) -> Column:
    """An end's entity type (HLP06): its own, else the candidate's unless that is a group, else what its id begins with."""
    text = lambda c: F.coalesce(c, F.lit(""))
    groups = list(dict.fromkeys(SCHEMA_GROUPS.values()))
    named = F.when((text(candidate) != "") & ~text(candidate).isin(groups), candidate)
    return F.coalesce(F.when(text(own) != "", own), named, F.when(F.contains(text(entity_id), F.lit("__")), F.substring_index(entity_id, "__", 1)), text(candidate))


def weak_label(low: Column, tokens: Column, core: Column, kind: Column, position: str) -> Column:
    """Why a label says too little for its position, empty if it doesn't."""
    weak = f"weak_{position}_label"
    tail, n = F.try_element_at(tokens, F.lit(-1)), F.size(core)
    anchored = F.arrays_overlap(core, _words(ANCHORS + MORE_ANCHORS))
    rules = [(F.size(tokens) == 0, weak), (low.isin(WEAK_PHRASES), weak), ((F.size(tokens) == 1) & ~F.get(tokens, F.lit(0)).isin(ANCHORS + LONE), weak), (tail.isin(WEAK_TAILS) & ~anchored, weak)]
    if position == "target":
        rules.append((tail.isin(FAMILY_TAILS) & (n <= 2) & ~anchored, "broad_target_label"))
    else:
        rules.append((F.array_contains(tokens, "baseline") & (F.size(F.array_except(core, _words(["baseline", "baselines"]))) <= 2), "baseline_source_not_predecessor"))
        rules.append((tail.isin("inference", "learning", "research") & (n <= 2) & ~anchored, weak))
    rules += [(F.array_contains(tokens, "methodological") & tail.isin("foundation", "program", "approach"), weak), (tail.isin("implementation", "program") & (n <= 2), weak)]
    if position == "source":
        rules.append(((kind == "data_source") & tail.isin("posts", "platforms"), weak))
    return _first(rules)


def by_figures(types: list[str] | None = None, least: float = 0.84, days: int = 180) -> Column:
    """The first of the rules on a relation's figures that applies, empty if none does. They come before all others, so a relation that one speaks against needs no quotes."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return _first([
        (~F.coalesce("accepted", F.lit(False)), "raw_rejected"), (~text("edge_type").isin(SHOWN if types is None else types), "relation_type_not_for_display"), (F.coalesce("confidence", F.lit(0.0)) < least, "low_confidence"),
        (F.coalesce("time_delta_days", F.lit(0)) < days, "too_near_in_time"), ((F.coalesce(F.col("source_document").cast("string"), F.lit("")) != "") & (F.col("source_document") == F.col("target_document")), "same_source_and_target_document"),
    ])


def with_rejection(rows: DataFrame, types: list[str] | None = None, least: float = 0.84, days: int = 180, name: str = "reason") -> DataFrame:
    """``rows`` and the first of 15 rules by which a relation isn't shown, empty if it is (FIL06).

    ``rows``: accepted, edge_type, confidence, time_delta_days, source_document, target_document, source_name, target_name, source_type, target_type (see :func:`end_type`),
    schema_group, candidate_reasons (array), source_quote, target_quote, rationale. Null counts as false, 0 or empty: a relation without a time delta is too near in
    time. The rules on figures come first, then those on labels, then those on the evidence; worked out in steps, so that no label is taken apart twice.
    """
    own = rows.columns
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    steps = with_generic_predecessor(with_variant_reason(rows.withColumn("__sn", text("source_name")).withColumn("__tn", text("target_name")), "__sn", "__tn", "__variant"), "__sn", "source_type", "__generic")
    steps = steps.withColumn("__said", F.concat_ws(" ", *(F.when(text(c) != "", F.col(c)) for c in ("rationale", "source_quote", "target_quote"))))
    steps = steps.select(
        "*", label_tokens(F.col("__sn")).alias("__st"), label_tokens(F.col("__tn")).alias("__tt"), content_tokens(F.col("__sn")).alias("__sc"), content_tokens(F.col("__tn")).alias("__tc"), content_tokens(F.col("__said")).alias("__ec"),
        label_tokens(text("source_quote")).alias("__sq"), label_tokens(text("target_quote")).alias("__tq"), F.coalesce("candidate_reasons", F.array().cast("array<string>")).alias("__why"),
    )
    st, tt, sc, tc, ec, why = (F.col(f"__{c}") for c in ("st", "tt", "sc", "tc", "ec", "why"))
    squeezed = lambda c: F.lower(T.normalize_space(F.col(c)))
    steps = steps.select(
        "*", weak_label(squeezed("__sn"), st, sc, F.col("source_type"), "source").alias("__ws"), weak_label(squeezed("__tn"), tt, tc, F.col("target_type"), "target").alias("__wt"),
        F.array_union(st, tt).alias("__both"), F.lower("__said").alias("__low"), F.lower(text("target_quote")).alias("__tlow"),
    )
    kind, other, group, both, low = F.col("source_type"), F.col("target_type"), text("schema_group"), F.col("__both"), F.col("__low")
    s_tail, t_tail = F.try_element_at(st, F.lit(-1)), F.try_element_at(tt, F.lit(-1))
    meet = F.arrays_overlap
    task = (kind.isin("method", "measurement_strategy") | (group == "analytic_method")) & s_tail.isin(TASK_TAILS) & ~meet(sc, tc) & ~meet(sc, _words(ANCHORS))
    wide = other.isin("method", "modeling_strategy", "measurement_strategy", "data_source") | group.isin("analytic_method", "evidence_and_infrastructure")
    within = (F.size(tc) > 0) & (F.size(F.array_except(tc, sc)) == 0) & (F.size(sc) > F.size(tc))
    broad = wide & ((F.size(tt) == 0) | (t_tail.isin(FAMILY_TAILS) & (F.size(tc) <= 2)) | within | ((F.size(tc) <= 1) & ~meet(tc, _words(ANCHORS))))
    share = F.size(F.array_intersect(both, _words(ARCHITECTURE))) / F.greatest(F.size(both), F.lit(1))
    told = F.array_contains(why, "target_text_mentions_source_with_evolution_cue")
    grounded = meet(F.col("__sq"), _words(DOMAIN)) | meet(F.col("__tq"), _words(DOMAIN))
    compared = meet(st, F.col("__tq")) & _any(F.col("__tlow"), COMPARED)
    network = (kind.isin("method", "modeling_strategy", "measurement_strategy") | (group == "analytic_method")) & meet(both, _words(NETWORKS))
    network = network & (_any(F.lower(text("rationale")), EXTERNAL) | (~told & ((share >= 0.55) | ((share >= 0.45) & (~grounded | ~compared)))))
    cue, s_seen, t_seen = _any(low, EVOLUTION_CUES), meet(sc, ec), meet(tc, ec)
    supported = told | (F.array_contains(why, "target_text_mentions_source") & cue) | (s_seen & t_seen & cue) | (F.col("edge_type").isin("improves", "replaces") & s_seen & _any(low, LINEAGE_CUES + IMPROVED))
    tail = [
        ((kind.eqNullSafe("data_source") | other.eqNullSafe("data_source")) & meet(both, _words(NO_DATA)), "misbucketed_data_source_label"), (task, "source_is_task_not_predecessor"), ((F.col("edge_type") == "generalizes") & broad, "broad_generalization_not_display_edge"),
        (network, "generic_ml_architecture_not_css_evolution"), (~F.coalesce(supported, F.lit(False)), "weak_lineage_evidence"),
    ]
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    figures, evidence = by_figures(types, least, days), _first(tail)
    reason = F.coalesce(F.when(figures != "", figures), F.when(F.col("__variant") != "", F.concat(F.lit("label_variant:"), "__variant")), filled("__generic"), filled("__ws"), filled("__wt"), evidence)
    return steps.select(*own, reason.alias(name))


def shown(rows: DataFrame, **limits: object) -> DataFrame:
    """The relations that no rule speaks against."""
    return with_rejection(rows, **limits, name="__reason").where("__reason = ''").drop("__reason")


def resolved(rows: DataFrame) -> DataFrame:
    """``rows`` with source_type, target_type and schema_group as the rules need them (HLP06), from own, candidate's and ids' types."""
    kind = F.coalesce("entity_type", F.lit(""))
    group = F.coalesce(F.when(F.coalesce("schema_group", F.lit("")) != "", F.col("schema_group")), F.when(kind.isin(list(dict.fromkeys(SCHEMA_GROUPS.values()))), kind), schema_group(kind))
    return rows.withColumn("schema_group", group).withColumn("source_type", end_type(F.col("source_entity_type"), kind, F.col("source"))).withColumn("target_type", end_type(F.col("target_entity_type"), kind, F.col("target")))
