"""When two labels name one thing, and when a label is too general to be a predecessor (FIL07, STR15, STR16)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions import text as T

# Tokens that tell the kind of a thing, not which.
STRUCTURE = [
    "algorithm", "algorithms", "analysis", "analyses", "approach", "approaches", "classifier", "classifiers", "data", "dataset", "datasets", "evaluation", "experiment", "experiments",
    "framework", "frameworks", "method", "methods", "model", "models", "modeling", "modelling", "pipeline", "pipelines", "protocol", "protocols", "result", "results", "system", "systems",
    "technique", "techniques", "tool", "tools",
]
# Names that name nothing.
GENERIC_NAMES = [
    "analysis", "analyses", "approach", "approaches", "data", "dataset", "evaluation", "experiment", "experiments", "feature", "framework", "hand", "method", "methods", "model", "models",
    "performance", "reason", "research", "simulation", "study", "studies", "system",
]
# Modifiers that make no other thing of a label.
MODIFIERS = [
    "applied", "classic", "classical", "common", "comparative", "conventional", "empirical", "enhanced", "extended", "general", "improved", "large", "new", "novel", "prior", "public", "previous",
    "robust", "scalable", "small", "standard", "supervised", "superior", "traditional", "unsupervised",
]
# What a label may be used for.
CONTEXTS = ["application", "applications", "based", "classification", "detection", "estimation", "prediction", "recognition", "task", "tasks", "topic", "visualization", "visualisation"]
# Modifiers of a kind of learning.
LEARNING_MODIFIERS = ["semi", "supervised", "unsupervised", "self", "weakly", "traditional", "classical", "standard", "generic"]
# Last words of labels that are too general with two core tokens or less.
HEADS = ["algorithm", "algorithms", "approach", "approaches", "framework", "frameworks", "method", "methods", "pipeline", "pipelines", "technique", "techniques"]
# The same for some entity types.
TYPE_HEADS = [
    "accuracy", "behavior", "behaviour", "challenge", "challenges", "collection", "consideration", "considerations", "data", "dataset", "datasets", "performance", "posts", "practice", "practices",
    "recommendation", "recommendations", "result", "results", "science", "structure", "task", "tasks",
]
HEADED_TYPES = ["data_source", "evaluation_protocol", "governance_practice", "measurement_strategy"]
# Labels that are too general as a whole.
BROAD = [
    "computational framework", "computational modeling", "computational modelling", "data collection", "data science", "deep learning", "deep learning models", "digital methods", "learning methods",
    "machine learning", "machine learning models", "supervised machine learning", "traditional machine learning", "unsupervised machine learning", "network approach", "network methods",
    "public sentiment", "real networks", "social network", "user engagement",
]
# A single core token that is specific enough.
ANCHORS = [
    "agent", "bayesian", "bert", "causal", "carlo", "dirichlet", "embedding", "embeddings", "forest", "gpt", "lda", "lexicon", "markov", "monte", "privacy", "regression", "simulation", "svm",
    "topic", "transformer", "vector",
]


def label_tokens(label: Column) -> Column:
    """The parts of the label's slug of two characters or more."""
    return F.filter(F.split(T.slugify(label, 200), "_"), lambda w: F.char_length(w) >= 2)


def content_tokens(label: Column) -> Column:
    """The distinct parts of four characters or more that say something (STR16)."""
    return F.array_distinct(F.filter(F.split(T.slugify(label, 200), "_"), lambda w: (F.char_length(w) >= 4) & ~w.isin(GENERIC_NAMES + STRUCTURE)))


def _without(tokens: Column, words: list[str]) -> Column:
    return F.filter(tokens, lambda w: ~w.isin(words))


def core_acronym(tokens: Column) -> Column:
    """First letters of two or more tokens that aren't structure, else empty."""
    core = _without(tokens, STRUCTURE)
    return F.when(F.size(core) >= 2, T.acronym(core)).otherwise("")


def core_tokens(tokens: Column, acronyms: Column) -> Column:
    """The distinct tokens that are neither structure nor one of the acronyms (of two letters or more)."""
    return F.array_distinct(F.filter(_without(tokens, STRUCTURE), lambda w: ~F.array_contains(F.filter(acronyms, lambda a: F.char_length(a) >= 2), w)))


def _first(rules: list[tuple[Column, str]]) -> Column:
    return F.coalesce(*(F.when(rule, F.lit(name)) for rule, name in rules), F.lit(""))


def with_variant_reason(df: DataFrame, source: str, target: str, name: str = "reason") -> DataFrame:
    """Why two labels are variants of one (FIL07), empty if they aren't or one has no tokens; in steps, so that nothing is worked out twice."""
    own = df.columns
    steps = df.withColumn("__s", label_tokens(F.col(source))).withColumn("__t", label_tokens(F.col(target)))
    steps = steps.withColumn("__x", F.array(core_acronym(F.col("__s")), core_acronym(F.col("__t"))))
    singular = lambda c: F.transform(c, T.label_singular)
    core = lambda c: F.array_distinct(singular(core_tokens(F.col(c), F.col("__x"))))
    whole = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    steps = steps.select(*own, "__s", "__t", core("__s").alias("__a"), core("__t").alias("__b"), whole("__s").alias("__sw"), whole("__t").alias("__tw"), (singular(F.col("__s")) == singular(F.col("__t"))).alias("__same"))
    s, t, a, b = (F.col(f"__{c}") for c in "stab")
    steps = steps.select(*own, "__s", "__t", "__a", "__b", "__same", F.contains("__tw", F.col("__sw")).alias("__st"), F.contains("__sw", F.col("__tw")).alias("__ts"), F.array_except(b, a).alias("__mt"), F.array_except(a, b).alias("__ms"))
    more_t, more_s, s_in_t, t_in_s = (F.col(f"__{c}") for c in ("mt", "ms", "st", "ts"))
    cores = (F.size(a) > 0) & (F.size(b) > 0)
    s_first, t_first = cores & (F.size(more_s) == 0), cores & (F.size(more_t) == 0)
    only = lambda extras, words: F.size(_without(extras, words)) == 0
    share = F.size(F.array_intersect(a, b)) >= 0.86 * F.size(F.array_union(a, b))
    rules = [
        (s == t, "duplicate_label"), (F.col("__same"), "same_core_label"), (s_first & t_first, "same_core_label"),
        (s_first & only(more_t, MODIFIERS), "source_label_with_generic_modifier"), (s_first & s_in_t & only(more_t, MODIFIERS + CONTEXTS), "source_label_with_context_suffix"),
        (t_first & only(more_s, MODIFIERS), "target_label_with_generic_modifier"), (t_first & t_in_s & only(more_s, MODIFIERS + CONTEXTS), "target_label_with_context_suffix"),
        (cores & share & (s_in_t | t_in_s), "near_duplicate_label"),
    ]
    return steps.select(*own, F.when((F.size(s) == 0) | (F.size(t) == 0), "").otherwise(_first(rules)).alias(name))


def with_generic_predecessor(df: DataFrame, label: str, entity_type: str, name: str = "reason") -> DataFrame:
    """``generic_predecessor_source`` for a label that is too general to be another's predecessor (FIL07), else empty."""
    own = df.columns
    steps = df.withColumn("__t", label_tokens(F.col(label)))
    steps = steps.select(*own, "__t", F.array_join(_without(F.col("__t"), STRUCTURE), " ").alias("__bare"), core_tokens(F.col("__t"), F.array(core_acronym(F.col("__t")))).alias("__core"))
    tokens, core, bare, kind = F.col("__t"), F.col("__core"), F.col("__bare"), F.col(entity_type)
    tail, n = F.try_element_at(tokens, F.lit(-1)), F.size(core)
    learning = lambda what: [
        F.contains(bare, F.lit(f"{what} learning")) & (n <= 3),
        F.array_contains(core, what) & F.array_contains(core, "learning") & (F.size(_without(core, LEARNING_MODIFIERS)) <= 2),
        F.array_contains(tokens, what) & F.array_contains(tokens, "learning") & tail.isin(STRUCTURE),
    ]
    rules = [
        F.lower(F.trim(F.col(label))).isin(BROAD), bare.isin(BROAD), F.array_join(tokens, " ").isin(BROAD), *learning("machine"), *learning("deep"), kind.isin(HEADED_TYPES) & tail.isin(TYPE_HEADS) & (n <= 2),
        tail.isin(HEADS) & (n <= 2), tail.isin("model", "models") & bare.isin("deep learning", "machine learning", "supervised learning"), (n <= 1) & tail.isin(STRUCTURE) & ~F.arrays_overlap(core, F.array(*(F.lit(w) for w in ANCHORS))),
    ]
    found = (F.size(tokens) > 0) & reduce(lambda a, b: a | b, (F.coalesce(r, F.lit(False)) for r in rules))
    return steps.select(*own, F.when(found, "generic_predecessor_source").otherwise("").alias(name))
