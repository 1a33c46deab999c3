"""Expansion of a taxonomy, terms of a corpus, schemas and their revision."""

from __future__ import annotations

import json
import re
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.operators.corpus import top_phrases
from loomspan.operators.graph import top_per_group

# Cues whose share among a node's documents is a signal.
BOTTLENECK_CUES = ["limitation", "bottleneck", "challenge", "problem", "fail", "gap", "barrier", "constraint"]
EVALUATION_CUES = ["benchmark", "evaluation", "metric", "measure", "audit", "survey", "experiment", "protocol"]
# Phrases and tokens that are too general for a term.
GENERIC_PHRASES = [
    "computational social science", "computational social sciences", "social science", "social sciences", "computer science", "data science", "social data", "research methods", "research method", "research design",
    "scientific research", "empirical research", "case study", "case studies",
]
GENERIC_TOKENS = [
    "approach", "approaches", "article", "based", "can", "data", "different", "field", "findings", "method", "methods", "model", "models", "new", "paper", "present", "presents", "problem", "problems",
    "research", "result", "results", "science", "sciences", "social", "study", "using", "work",
]


def cue_share(text: Column, cues: list[str]) -> Column:
    """Aggregate: share of texts with a cue, 0 over none (HLP18)."""
    hit = reduce(lambda a, b: a | b, (F.contains(F.lower(text), F.lit(c)) for c in cues))
    return F.coalesce(F.avg(F.coalesce(hit, F.lit(False)).cast("int")), F.lit(0.0))


def _slug(x: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", x.lower()).strip("_")[:80].rstrip("_") or "unknown"


def valid_phrase(phrase: Column) -> Column:
    """Two to five different tokens, none a number, not all general, no demonstrative first, no general phrase (STR26)."""
    t = F.split(phrase, " ")
    general = F.array(*(F.lit(w) for w in GENERIC_TOKENS))
    return (
        F.size(t).between(2, 5) & (F.size(F.array_distinct(t)) == F.size(t)) & ~F.exists(t, lambda x: x.rlike("^[0-9]+$")) & ~F.forall(t, lambda x: F.array_contains(general, x))
        & ~t[0].isin("this", "that", "these", "those", "which") & ~phrase.isin(GENERIC_PHRASES)
    )


def normal_phrase(value: Column) -> Column:
    """The first five tokens without what stands in brackets (STR26)."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"\([^)]*\)", " "), "[/_:+,;]", " ")
    return F.array_join(F.slice(T.tokenize(bare), 1, 5), " ")


def too_similar(phrase: str, chosen: list[str]) -> bool:
    """Whether a phrase holds, or is held by, a chosen one, or shares three quarters of all their tokens (STR26)."""
    own = set(phrase.split())
    others = [set(c.split()) for c in chosen]
    return any(own <= o or o <= own or len(own & o) >= 0.75 * len(own | o) for o in others)


def phrase_rows(docs: DataFrame, abstract: int = 3000) -> DataFrame:
    """(doc_id, phrase, source), a row for each place, valid or not: keywords and concepts, 2- to 4-grams of titles, 2- and 3-grams of the first ``abstract`` characters.

    ``docs``: doc_id, title, text, and arrays keywords, concepts (null: none). Rows of a document are brought together before they are taken apart, so its phrases aren't moved.
    """
    empty = F.array().cast("array<string>")

    def own(phrases: Column, source: str) -> Column:
        return F.transform(phrases, lambda p: F.struct(p.alias("phrase"), F.lit(source).alias("source")))

    moved = docs.select("doc_id", "keywords", "concepts", "title", F.substring("text", 1, abstract).alias("text")).repartition("doc_id")
    ready = moved.select("doc_id", "keywords", "concepts", T.tokenize(F.col("title")).alias("a"), T.tokenize(F.col("text")).alias("b"))
    named = [own(F.transform(F.coalesce(F.col(c), empty), normal_phrase), s) for c, s in (("keywords", "keyword"), ("concepts", "concept"))]
    grams = [own(T.ngrams(F.col("a"), 2, 4), "title_phrase"), own(T.ngrams(F.col("b"), 2, 3), "abstract_phrase")]
    return ready.select("doc_id", F.explode(F.concat(*named, *grams)).alias("p")).select("doc_id", "p.phrase", "p.source")


def corpus_phrases(docs: DataFrame, abstract: int = 3000) -> DataFrame:
    """The distinct rows of :func:`phrase_rows` with a valid phrase (HLP14)."""
    return phrase_rows(docs, abstract).distinct().where(valid_phrase(F.col("phrase")))


def corpus_terms(phrases: DataFrame, documents: int) -> DataFrame:
    """(phrase, support, score) of the valid phrases whose support is neither small nor that of most documents (AGG29); ``phrases``: doc_id, phrase, source, repeats count once."""
    low, high = max(1, min(8, documents // 35 if documents >= 35 else 1)), max(2, int(documents * 0.62))
    # a document's sources of a phrase first (no shuffle behind phrase_rows), then documents are counted without a distinct
    sources = ("keyword", "concept", "title_phrase", "abstract_phrase")
    own = phrases.groupBy("doc_id", "phrase").agg(*(F.max((F.col("source") == s).cast("int")).alias(s) for s in sources))
    per = own.groupBy("phrase").agg(F.count("doc_id").alias("support"), *(F.max(s).alias(s) for s in sources))
    bonus = F.lit(1.0) + 0.35 * F.greatest("keyword", "concept") + 0.25 * F.col("title_phrase") + 0.1 * F.col("abstract_phrase")
    score = F.col("support") * bonus + F.least(F.lit(4), F.size(F.split("phrase", " "))) * 0.2
    return per.where(F.col("support").between(low, high)).where(valid_phrase(F.col("phrase"))).select("phrase", "support", F.round(score, 6).alias("score"))


def choose_terms(terms: DataFrame, most: int = 14, block: int = 500) -> list[str]:
    """The first ``most`` terms by score, support and phrase, none too similar to one before (AGG29).

    Terms are taken to the driver in blocks of ``block`` in this order, until enough are chosen or none is left.
    """
    chosen: list[str] = []
    order = [F.desc("score"), F.desc("support"), "phrase"]
    at = 0
    while len(chosen) < most:
        rows = terms.orderBy(*order).offset(at).limit(block).select("phrase").collect()
        for r in rows:
            if len(chosen) < most and not too_similar(r.phrase, chosen):
                chosen.append(r.phrase)
        if len(rows) < block:
            break
        at += block
    return chosen


def boundary_cases(docs: DataFrame, assigned: DataFrame, k: int = 20) -> DataFrame:
    """(kind, doc_id, n): the first ``k`` documents without a node, and the ``k`` with most nodes, three or more (HLP15)."""
    per = docs.select("doc_id").distinct().join(assigned.groupBy("doc_id").agg(F.count_distinct("node_id").alias("n")), "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n"))
    kind = F.when(F.col("n") == 0, "unassigned").when(F.col("n") >= 3, "overlap_heavy")
    return top_per_group(per.withColumn("kind", kind).where("kind is not null"), ["kind"], [F.desc("n"), "doc_id"], k).select("kind", "doc_id", "n")


def method_role(kind: Column, text: Column) -> Column:
    """What part a method plays, by its type or the first cues in the text (STR25)."""
    low = F.lower(text)
    has = lambda *words: reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words))
    return (
        F.when(kind == "data_source", "evidence_source").when(kind == "infrastructure_tooling", "tooling_or_platform").when(kind == "evaluation_protocol", "validation_or_benchmark").when(kind == "governance_practice", "governance_or_access_practice")
        .when(has("annotat", "coding", "classif", "detect", "measurement", "sentiment", "stance"), "measurement_or_annotation").when(has("model", "simulation", "predict", "infer", "estimate"), "modeling_or_inference")
        .when(has("api", "dashboard", "software", "platform"), "tooling_or_platform").otherwise("analytic_method")
    )


# Phrases of a context, each with the terms that call for it, in the order in which they are tried.
CONTEXTS = {
    "social media text": ["social", "media", "text"], "social media": ["social", "tweet", "twitter", "platform", "online"], "political text": ["political", "text", "discourse", "ideology", "propaganda"],
    "hate speech or sexism detection": ["hate", "sexism"], "sentiment or emotion analysis": ["sentiment", "emotion"], "survey or population data": ["survey", "population"],
    "social network analysis": ["network", "community", "user"], "annotation and coding": ["annotation", "coding"], "public policy or governance analysis": ["policy", "governance", "public"],
}


def context_phrase(terms: Column) -> Column:
    """The first context that a term calls for, else the first four terms (STR25)."""
    hits = [F.when(F.arrays_overlap(terms, F.array(*(F.lit(w) for w in words))), F.lit(name)) for name, words in CONTEXTS.items()]
    return F.coalesce(*hits, F.array_join(F.slice(terms, 1, 4), " "))


def repaired_name(value: Column) -> Column:
    """A closing bracket for an open one (HLP13)."""
    text = T.normalize_space(value)
    count = lambda x, c: F.char_length(x) - F.char_length(F.replace(x, F.lit(c), F.lit("")))
    round_ = F.when(count(text, "(") > count(text, ")"), F.concat(text, F.lit(")"))).otherwise(text)
    return F.when(count(round_, "[") > count(round_, "]"), F.concat(round_, F.lit("]"))).otherwise(round_)


def abbreviations(value: Column) -> Column:
    """Distinct words of two to eight letters, lower case (HLP13)."""
    words = F.transform(F.split(F.regexp_replace(F.coalesce(value, F.lit("")), r"[()\s]+", " "), " "), lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}]", "")))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: w.rlike(r"^\p{L}{2,8}$"))))


def first_slot(edges: DataFrame, paths: DataFrame, slot: str) -> DataFrame:
    """(path_id, ``slot``): the first non-empty value of a slot along a path (HLP19); ``paths``: path_id, edges (array of edge_id)."""
    steps = paths.select("path_id", F.posexplode("edges").alias("pos", "edge_id")).join(edges.select("edge_id", F.col(slot).alias("value")), "edge_id").where("value <> ''")
    found = steps.groupBy("path_id").agg(F.min_by("value", "pos").alias(slot))
    return paths.select("path_id").join(found, "path_id", "left").select("path_id", F.coalesce(slot, F.lit("")).alias(slot))


def assignment_rows(assigned: DataFrame) -> DataFrame:
    """(doc_id, nodes): the nodes of each document, in order (HLP20)."""
    return assigned.groupBy("doc_id").agg(F.array_sort(F.collect_set("node_id")).alias("nodes"))


def work_reason(title: Column, abstract: Column, day: Column, year: Column, work_id: Column, relevant: Column, first: str, last: str) -> Column:
    """Why a raw work is no corpus row, null if it is one (SRC13): the first rule that applies. A year stands for its first day."""
    date = F.coalesce(F.nullif(day, F.lit("")), F.concat(year.cast("string"), F.lit("-01-01")))
    empty = lambda x: T.normalize_space(x) == ""
    rules = [(empty(title) | empty(abstract), "missing_title_or_abstract"), (date.isNull(), "missing_publication_date"), ((date < first) | (date > last), "outside_date_range"), (F.coalesce(work_id, F.lit("")) == "", "missing_id"), (~relevant, "low_relevance")]
    return F.coalesce(*(F.when(rule, F.lit(name)) for rule, name in rules))


def compact(values: Column, k: int = 20) -> Column:
    """Names of a nested list, blank ones left out, the first ``k`` (HLP16)."""
    return F.slice(F.filter(F.transform(values, T.normalize_space), lambda x: x != ""), 1, k)


def load_schema_seed(path: str) -> dict:
    """A schema's seed: a JSON object; a missing file or another value gives none (SRC10)."""
    file = Path(path)
    if not file.exists():
        return {}
    value = json.loads(file.read_text(encoding="utf-8"))
    return value if isinstance(value, dict) else {}


def relation_schema(rows: list[dict], base: dict[str, dict], strong: list[str], most: int, preferred: list[str] | None = None) -> tuple[dict[str, dict], list[dict]]:
    """(schema, report): proposed relation types over a base, those without a name or definition refused, at most ``most`` (GRF12).

    The first ones stay in the order preferred, then by name.
    """
    out, report = {k: dict(v) for k, v in base.items()}, []
    for row in rows:
        name = _slug(str(row.get("edge_type") or row.get("name") or "")) if row.get("edge_type") or row.get("name") else ""
        reason = "missing_edge_type" if not name else "missing_definition" if not str(row.get("definition") or "") else ""
        report.append({"edge_type": name, "status": "rejected" if reason else "accepted", "reason": reason})
        if not reason:
            slots = [str(s) for s in row.get("evidence_slots") or [] if str(s).strip()]
            out[name] = {**out.get(name, {}), "label": str(row.get("label") or name.replace("_", " ").title()), "definition": str(row["definition"]), "evidence_slots": slots or ["mechanism", "bottleneck", "tradeoff"], "strong_edge": bool(row.get("strong_edge", name in strong)), "schema_source": "inferred"}
    order = {name: k for k, name in enumerate(preferred or [*strong, "background"])}
    kept = sorted(out, key=lambda n: (order.get(n, len(order)), n))[:most]
    return {n: out[n] for n in sorted(kept)}, report


def relation_revisions(audit: DataFrame, rejected: DataFrame, schema: list[str], least: int = 5) -> DataFrame:
    """Proposals from audit statistics (AGG31): ``candidate_id, revision_type, edge_type, support, confidence``.

    ``audit``: edge_type, status, verified_quote_count, confidence; ``rejected``: edge_type, reason. A type or a reason needs ``least`` rows.
    """
    prior = "background" if "background" in schema else sorted(schema)[0]
    quoted = (F.col("verified_quote_count") > 0).cast("int")
    seen = audit.groupBy("edge_type").agg(F.count("*").alias("support"), F.avg(quoted).alias("rate"), F.avg("confidence").alias("mean"))
    seen = seen.withColumn("value", F.least(F.lit(0.95), F.lit(0.45) + 0.08 * F.col("support") + 0.25 * F.col("rate") + 0.15 * F.col("mean")))
    open_ = audit.where("status = 'candidate'").groupBy("edge_type").agg(F.count("*").alias("support")).where(F.col("edge_type").isin(schema))
    open_ = open_.withColumn("value", F.least(F.lit(0.9), F.lit(0.45) + 0.08 * F.col("support")))
    reasons = rejected.groupBy(F.coalesce("reason", F.lit("unknown")).alias("reason")).agg(F.count("*").alias("support")).withColumn("value", F.least(F.lit(0.92), F.lit(0.42) + 0.05 * F.col("support")))
    counter = rejected.groupBy(F.coalesce("edge_type", F.lit("background")).alias("edge_type")).agg(F.count("*").alias("support")).where(F.col("edge_type").isin(schema))
    counter = counter.withColumn("value", F.least(F.lit(0.9), F.lit(0.4) + 0.04 * F.col("support")))

    def rows(df: DataFrame, prefix: str, kind: str, name: str, edge_type: Column) -> DataFrame:
        return df.where(F.col("support") >= least).select(F.concat(F.lit(prefix), T.slugify(F.col(name))).alias("candidate_id"), F.lit(kind).alias("revision_type"), edge_type.alias("edge_type"), "support", F.round("value", 3).alias("confidence"))

    parts = [
        rows(seen, "relation_observation__", "update_observed_stats", "edge_type", F.col("edge_type")), rows(open_, "relation_review__", "mark_needs_review", "edge_type", F.col("edge_type")),
        rows(reasons, "relation_negative_prior__", "update_negative_prior", "reason", F.lit(prior)), rows(counter, "relation_counterexamples__", "add_counterexamples", "edge_type", F.col("edge_type")),
    ]
    return reduce(DataFrame.unionByName, parts)


def promote(candidates: DataFrame, decisions: DataFrame, least: float = 0.6, most: int = 10) -> DataFrame:
    """Schema revisions by a judge's decisions (GRF11): ``status`` promoted, held or rejected; the best ``most`` are promoted.

    ``candidates``: candidate_id, confidence; ``decisions``: candidate_id, accept, confidence. Without a decision the candidate's own confidence counts.
    """
    d = decisions.select("candidate_id", "accept", F.col("confidence").alias("judged"))
    value = F.coalesce("judged", "confidence")
    rows = candidates.join(d, "candidate_id", "left").withColumn("value", value).withColumn("good", F.coalesce("accept", F.lit(True)) & (value >= least))
    best = rows.where("good").orderBy(F.desc("value"), "candidate_id").limit(most).select("candidate_id", F.lit(True).alias("first"))
    status = F.when(F.coalesce("first", F.lit(False)), "promoted").when(F.col("good"), "held").otherwise("rejected")
    return rows.join(best, "candidate_id", "left").select("candidate_id", F.round("value", 3).alias("confidence"), status.alias("status"))
