"""Relation cues, grounding, candidates, cards, hooks and induction."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.operators.corpus import top_phrases
from loomspan.operators.graph import EDGE_CUES, top_per_group
from loomspan.operators.insight import candidate_score, older_sources, schema_group
from loomspan.operators.labels import with_generic_predecessor, with_variant_reason
from loomspan.operators.lineage import cut
from loomspan.operators.names import names_in_texts

#: Two capitalised words or more, or one with a capital or digit inside.
PROPER = r"\b(?:[A-Z][\w-]+(?:\s+[A-Z][\w-]+)+|[A-Z]\w*[A-Z0-9]\w*)\b"
BOTTLENECKS = ("limitation", "bottleneck", "challenge", "problem", "issue", "lack of")


def relation_of(sentences: Column, source: Column, target: Column, cues: dict[str, list[str]] | None = None) -> Column:
    """Struct (edge_type, cue) from the sentences that name either entity (SCO09).

    The first sentence with a cue decides, in it the first relation in order, of this its first cue. Without any
    cue a sentence with both names gives ``uses_component`` by co-mention; without one: background.
    """
    cues = EDGE_CUES if cues is None else cues
    low = F.transform(sentences, lambda s: F.lower(s))
    named = F.filter(low, lambda s: F.contains(s, F.lower(source)) | F.contains(s, F.lower(target)))

    def first(s: Column) -> Column:
        hits = [F.when(F.contains(s, F.lit(c)), F.struct(F.lit(kind).alias("edge_type"), F.lit(c).alias("cue"))) for kind, words in cues.items() for c in words]
        return F.coalesce(*hits)

    found = F.try_element_at(F.filter(F.transform(named, first), lambda x: x.isNotNull()), F.lit(1))
    both = F.exists(low, lambda s: F.contains(s, F.lower(source)) & F.contains(s, F.lower(target)))
    return F.coalesce(found, F.when(both, F.struct(F.lit("uses_component").alias("edge_type"), F.lit("co-mention").alias("cue"))), F.struct(F.lit("background").alias("edge_type"), F.lit("").alias("cue")))


def names_entity(quote: Column, name: Column) -> Column:
    """The quote holds two stemmed tokens of the name, or its only one."""
    q = F.transform(T.tokenize(quote), T.stem)
    own = F.array_distinct(F.transform(T.tokenize(name), T.stem))
    return (F.size(own) > 0) & (F.size(F.array_intersect(own, q)) >= F.least(F.size(own), F.lit(2)))


def grounding(quote: Column, text: Column, source: Column, target: Column, cues: list[str], mode: str = "one_sided_cue") -> Column:
    """Whether a quote supports a relation (SCO10): it is in the text, and by mode has a cue and one or both names."""
    real = T.quote_verified(quote, text)
    if mode == "substring":
        return real
    cue = F.exists(F.array(*(F.lit(c) for c in cues)), lambda c: F.contains(F.lower(quote), c))
    a, b = names_entity(quote, source), names_entity(quote, target)
    return real & cue & ((a & b) if mode == "two_sided_cue" else (a | b))


def audit_quotes(edges: DataFrame, docs: DataFrame, cues: list[str], mode: str = "one_sided_cue") -> DataFrame:
    """Edges with ``quote`` against the texts of their documents (JOI08): ``verified`` if either text supports it."""
    s = docs.select(F.col("doc_id").alias("source_document"), F.col("text").alias("st"))
    t = docs.select(F.col("doc_id").alias("target_document"), F.col("text").alias("tt"))
    both = edges.join(s, "source_document", "left").join(t, "target_document", "left")
    ok = F.coalesce(grounding(F.col("quote"), F.col("tt"), F.col("source_name"), F.col("target_name"), cues, mode), F.lit(False)) | F.coalesce(grounding(F.col("quote"), F.col("st"), F.col("source_name"), F.col("target_name"), cues, mode), F.lit(False))
    return both.withColumn("verified", ok).drop("st", "tt")


def has_bottleneck(sentence: Column) -> Column:
    """Whether a sentence tells a bottleneck; null tells none."""
    low = F.lower(F.coalesce(sentence, F.lit("")))
    return F.exists(F.array(*(F.lit(c) for c in BOTTLENECKS)), lambda c: F.contains(low, c))


def evidence_slots(sentence: Column, names: list[str]) -> Column:
    """Map slot -> quote: every slot empty, ``bottleneck`` filled where the sentence has such a cue (SCO11)."""
    has = F.exists(F.array(*(F.lit(c) for c in BOTTLENECKS)), lambda c: F.contains(F.lower(sentence), c))
    return F.map_from_arrays(F.array(*(F.lit(n) for n in names)), F.array(*(F.when(has, sentence).otherwise("") if n == "bottleneck" else F.lit("") for n in names)))


def proper_names(docs: DataFrame, cues: tuple[str, ...] = ("propose", "introduce", "present", "use", "method", "model", "system"), before: int = 80, after: int = 100) -> DataFrame:
    """Capitalised phrases with a cue around them (STR11): ``doc_id, name, position``; the place of a match isn't available to SQL."""
    pattern = re.compile(PROPER)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"]):
                for m in pattern.finditer(text or ""):
                    around = text[max(0, m.start() - before) : m.end() + after].lower()
                    if any(c in around for c in cues):
                        rows.append((doc, m.group(), m.start()))
            yield pd.DataFrame(rows, columns=["doc_id", "name", "position"])

    return docs.select("doc_id", "text").mapInPandas(find, "doc_id long, name string, position long")


def relevance(text: Column, exact: list[str], groups: list[list[str]]) -> Column:
    """An exact phrase, or a word of every group (FIL08)."""
    low = F.lower(text)
    some = lambda words: F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(low, w))
    every = some(groups[0])
    for g in groups[1:]:
        every = every & some(g)
    return some(exact) | every


def fuzzy_assign(docs: DataFrame, nodes: DataFrame, known: DataFrame) -> DataFrame:
    """Known pairs and those whose child node's label matches the text by phrase or tokens (JOI03, STR09).

    A label inside a text may share no token with it (``AI``, or a part of a longer word), so labels are looked for in one pass over
    each text; a match by tokens has a shared one, so documents meet labels by an equi-join.
    """
    children = nodes.where("parent_id is not null").select("node_id", "label")
    low = lambda c: F.lower(T.normalize_space(F.col(c)))
    named = children.select("node_id", low("label").alias("name"))
    held = names_in_texts(docs.select("doc_id", low("text").alias("text")), named, "doc_id").join(named.distinct(), "name").select("doc_id", "node_id")
    # the row tells apart rows that repeat an id; the text itself isn't moved
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    words = numbered.select("doc_id", "row", F.explode(F.array_distinct(T.tokenize(F.col("text")))).alias("token"))
    own = F.array_distinct(T.tokenize(F.col("label")))
    labels = children.select("node_id", "label", F.size(own).alias("tokens"), F.explode(own).alias("token"))
    near = words.join(labels, "token").groupBy("row", "doc_id", "node_id", "label", "tokens").agg(F.count_distinct("token").alias("common"))
    hit = near.where(F.col("common") >= 0.67 * F.col("tokens")).select("doc_id", "node_id")
    return known.select("doc_id", "node_id").unionByName(held).unionByName(hit).distinct()


def successor_candidates(entities: DataFrame, scope: str, texts: DataFrame, per_target: int = 6, least: float = 0.25, limit: int = 0, years: float = 18, sources: int = 120) -> tuple[DataFrame, DataFrame]:
    """(candidates, counters): the best scored predecessors of each target, and how many pairs each step kept or dropped (JOI14, SCO04).

    ``entities`` as in ``insight.older_sources``, ``texts`` (entity_id, text) of the targets' best documents; a target without one has
    no candidates. Variants of a label and generic predecessors are skipped, then scores below ``least``; ``per_target`` stay by score,
    nearness in time and id, and of all, if ``limit`` is above 0, so many by score, the target's first date and the ids.
    """
    own = entities.select("entity_id", "canonical_name", "entity_type", "first_seen", "n_docs")
    dated = entities.join(texts.select("entity_id"), "entity_id", "left_semi")
    pairs = older_sources(entities, scope, years, sources, texts).join(dated.select(F.col("entity_id").alias("target")), "target", "left_semi").drop("rank", "score")
    named = pairs.join(own.select(F.col("entity_id").alias("source"), F.col("canonical_name").alias("sn"), F.col("entity_type").alias("st")), "source")
    named = named.join(own.select(F.col("entity_id").alias("target"), F.col("canonical_name").alias("tn"), F.col("entity_type").alias("tt"), F.col("first_seen").alias("target_date"), F.col("n_docs").alias("target_docs")), "target")
    told = with_generic_predecessor(with_variant_reason(named, "sn", "tn", "variant"), "sn", "st", "generic")
    judged = told.withColumn("why", F.when(F.col("variant") != "", F.col("variant")).otherwise(F.col("generic"))).drop("variant", "generic")
    told = judged.join(texts.select(F.col("entity_id").alias("target"), "text"), "target")
    scored = told.withColumn("c", candidate_score(F.col("shared"), F.col("overlap"), F.col("sn"), F.col("tn"), F.col("text"), F.col("days") / 365.25, F.col("target_docs"))).drop("text")
    other = F.when(F.col("st") != F.col("tt"), F.array(F.lit("cross_entity_type_within_schema_group"))).otherwise(F.array().cast("array<string>"))
    fate = F.when(F.col("why") != "", F.concat(F.lit("skipped_"), "why")).when(F.col("c.score") < least, "skipped_below_min_candidate_score").otherwise("retained_before_per_target_cap")
    # read by the counters and by the rank
    scored = cut(scored.select("source", "target", "days", "target_date", F.round("c.score", 3).alias("score"), F.concat("c.reasons", other).alias("reasons"), fate.alias("fate")))
    good = scored.where("fate = 'retained_before_per_target_cap'")
    best = top_per_group(good, ["target"], [F.desc("score"), "days", "source"], per_target)
    counters = scored.groupBy(F.col("fate").alias("counter")).agg(F.count("*").alias("n"))
    total = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("counter"), "n")
    out = best.orderBy(F.desc("score"), "target_date", "source", "target").limit(limit) if limit > 0 else best
    counters = counters.unionByName(total(scored, "source_pairs_considered")).unionByName(total(best, "retained_after_per_target_cap")).unionByName(total(out, "retained_after_global_limit"))
    return out.select("source", "target", "days", "score", F.array_join("reasons", ",").alias("reasons"), "rank"), counters


def quoting_documents(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id): documents that hold a quote, whole or by four fifths of its tokens (STR19).

    ``quotes``: item_id, quote. A text with four fifths of n tokens has one of the first n - 0.8 n + 1 in any order; long tokens come first, as they
    are rare. A quote inside a text shares its words but the first and last, so it meets at the longest of these. Only quotes without any
    such word are looked for in every text, in blocks; they are broadcast as far as Spark finds them small.
    """
    own, low = F.array_distinct("qt"), F.lower(T.normalize_space(F.col("quote")))
    q = quotes.select("item_id", low.alias("q"), T.tokenize(F.col("quote")).alias("qt")).where("q <> ''").withColumn("own", own)
    long = lambda c: F.transform(F.array_sort(F.transform(c, lambda t: F.struct((-F.char_length(t)).alias("n"), t.alias("t")))), lambda x: x["t"])
    words = F.split("q", " ")
    inner = F.array_distinct(T.tokenize(F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), " ")))
    loose = F.size("qt") >= 4
    first = F.when(loose, F.slice(long(F.col("own")), F.lit(1), F.size("own") - F.ceil(0.8 * F.size("own")).cast("int") + 1)).otherwise(F.array().cast("array<string>"))
    keys = q.withColumn("inner", F.slice(long(inner), 1, 1)).withColumn("keys", F.array_union(first, F.col("inner")))
    texts = docs.select("doc_id", F.lower(T.normalize_space(F.col("text"))).alias("low"), F.array_distinct(T.tokenize(F.col("text"))).alias("tokens"))
    at = keys.select("item_id", F.explode("keys").alias("token"))
    met = texts.select("doc_id", F.explode("tokens").alias("token")).join(at, "token").select("doc_id", "item_id").distinct()
    held = F.contains("low", F.col("q")) | (loose & (F.size(F.array_intersect("own", F.col("tokens"))) >= 0.8 * F.size("own")))
    near = met.join(q, "item_id").join(texts, "doc_id").where(held).select("item_id", "doc_id")
    rest = keys.where(F.size("inner") == 0).select("item_id", "q")
    whole = texts.select("doc_id", "low").join(rest, F.contains("low", F.col("q"))).select("item_id", "doc_id")
    return near.unionByName(whole).distinct()


def path_windows(paths: DataFrame, assigned: DataFrame) -> DataFrame:
    """Windows that a path's edges fall into (JOI17): ``path_id, edges`` (array) with ``edge_id, window_id``."""
    steps = paths.select("path_id", F.explode("edges").alias("edge_id"))
    return steps.join(assigned.select("edge_id", "window_id"), "edge_id", "left").groupBy("path_id").agg(F.array_sort(F.collect_set("window_id")).alias("windows"), F.count("*").alias("steps"))


def allowed_paths(paths: DataFrame, allowed: DataFrame) -> DataFrame:
    """Paths all of whose edges are allowed (FIL09)."""
    bad = paths.select("path_id", F.explode("edges").alias("edge_id")).join(allowed.select("edge_id"), "edge_id", "left_anti").select("path_id").distinct()
    return paths.join(bad, "path_id", "left_anti")


def entity_cards(entities: DataFrame, mentions: DataFrame, edges: DataFrame, k: int = 24) -> DataFrame:
    """Nested card of each entity: first documents, best in-edges and out-edges (JOI20). Each list is cut before it is gathered."""
    docs = top_per_group(mentions.groupBy("entity_id", "doc_id").agg(F.min("published_at").alias("day")), ["entity_id"], ["day", "doc_id"], k)
    docs = docs.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("day", "doc_id"))).alias("documents"))

    def ends(own: str, other: str, name: str) -> DataFrame:
        best = top_per_group(edges.groupBy(own, other).agg(F.max("confidence").alias("confidence")), [own], [F.desc("confidence"), other], k)
        return best.groupBy(F.col(own).alias("entity_id")).agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("order"), F.col(other).alias("entity")))).alias(name))

    return entities.join(docs, "entity_id", "left").join(ends("source", "target", "out_edges"), "entity_id", "left").join(ends("target", "source", "in_edges"), "entity_id", "left")


def forecast_hooks(paths: DataFrame, branches: DataFrame, bottlenecks: DataFrame) -> DataFrame:
    """Hooks from chains, branch points and open bottlenecks (GRF06, AGG32, SET03)."""
    a = paths.select(F.lit("chain").alias("kind"), F.col("path").alias("key"), F.col("score").alias("weight"))
    b = branches.select(F.lit("branch").alias("kind"), F.col("source").alias("key"), F.least(F.lit(1.0), F.col("targets") / 8).alias("weight"))
    c = bottlenecks.groupBy("source").agg(F.count("*").alias("n")).select(F.lit("bottleneck").alias("kind"), F.col("source").alias("key"), F.least(F.lit(1.0), F.col("n") / 8).alias("weight"))
    return a.unionByName(b).unionByName(c)


def induce_taxonomy(docs: DataFrame, dimension: str, least: int = 2, k: int = 6) -> DataFrame:
    """Root of a dimension and its best phrases as children (GRF07): ``node_id, parent_id, label, support``."""
    phrases = top_phrases(docs.withColumn("__all", F.lit(dimension)), "__all", k).where(F.col("cnt") >= least)
    kids = phrases.select(F.concat(F.lit(f"{dimension}__"), T.slugify(F.col("phrase"))).alias("node_id"), F.lit(dimension).alias("parent_id"), F.col("phrase").alias("label"), F.col("cnt").alias("support"))
    root = docs.agg(F.count("*").alias("support")).select(F.lit(dimension).alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(dimension).alias("label"), "support")
    return root.unionByName(kids)


def schema_revisions(edges: DataFrame, least: int = 5) -> DataFrame:
    """Relation types whose edges call for a review of the schema (AGG31)."""
    per = edges.groupBy("edge_type").agg(F.count("*").alias("n"), F.avg(F.col("verified").cast("int")).alias("rate")).where(F.col("n") >= least)
    what = F.when(F.col("rate") < 0.3, "negative_prior").when(F.col("rate") < 0.6, "needs_review").otherwise("observed")
    return per.select("edge_type", "n", F.round("rate", 3).alias("verified_rate"), what.alias("proposal"))


def group_diagnostics(entities: DataFrame) -> DataFrame:
    """Entities, documents and share by type and schema group (AGG22)."""
    per = entities.groupBy("entity_type", schema_group(F.col("entity_type")).alias("schema_group")).agg(F.count("*").alias("entities"), F.sum("n_docs").alias("documents"))
    return per.withColumn("share", F.round(F.col("entities") / F.sum("entities").over(Window.partitionBy()), 6))


