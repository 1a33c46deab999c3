"""Corpus, taxonomy and entity operators: DataFrame to DataFrame."""

from __future__ import annotations

import difflib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.functions import values as V
from loomspan.operators.lineage import cut
from loomspan.operators.names import names_in_texts


def skip_reason(text: Column, role: Column, day: Column, roles: list[str] | None = None, cutoff: str | None = None, need_date: bool = False) -> Column:
    """Why a row isn't loaded, the first rule that applies; null for rows that are (SRC04, FIL01, STM03)."""
    rules = [(T.normalize_space(text) == "", "missing_text")]
    if roles is not None:
        rules.append((~F.coalesce(role.isin(roles), F.lit(False)), "role_filtered"))
    if need_date:
        rules.append((day.isNull(), "missing_date"))
    if cutoff is not None:
        rules.append((day > F.lit(cutoff).cast("date"), "post_cutoff"))
    return F.coalesce(*(F.when(rule, F.lit(name)) for rule, name in rules))


def first_wins(df: DataFrame, key: str, order: list[str], bucket: str) -> DataFrame:
    """One row per key, the first by ``order``, with all buckets the key occurs in (SRC14). Pre-aggregated, no window."""
    others = [c for c in df.columns if c not in (key, bucket)]
    first = F.min_by(F.struct(*others), F.struct(*order)).alias("row")
    return df.groupBy(key).agg(first, F.array_sort(F.collect_set(bucket)).alias("buckets")).select(key, "row.*", "buckets")


def overlap_distribution(df: DataFrame, key: str, bucket: str) -> DataFrame:
    """How many keys occur in how many buckets (SRC12)."""
    per = df.groupBy(key).agg(F.count_distinct(bucket).alias("buckets"))
    return per.groupBy("buckets").agg(F.count("*").alias("ids"))


def inverted_index(df: DataFrame) -> DataFrame:
    """(doc_id, token, positions) of texts split at white space (SRC15, forward). Texts are moved whole, by id; what is grouped by document after that stays where it is."""
    words = df.select("doc_id", "text").repartition("doc_id").select("doc_id", F.posexplode(F.split(T.normalize_space(F.col("text")), " ")).alias("pos", "token"))
    return words.groupBy("doc_id", "token").agg(F.array_sort(F.collect_list("pos")).alias("positions"))


def text_of_index(index: DataFrame) -> DataFrame:
    """Texts from (doc_id, token, positions): tokens by position, the later token at a shared one (SRC15)."""
    at = index.select("doc_id", "token", F.explode("positions").alias("pos"))
    one = at.groupBy("doc_id", "pos").agg(F.max("token").alias("token"))
    return one.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("w")).select("doc_id", F.array_join(F.transform("w", lambda x: x["token"]), " ").alias("text"))


def last_wins(df: DataFrame, key: str, seq: str) -> DataFrame:
    """One row per key, that of the greatest ``seq`` (SRC17, JOI15)."""
    return df.groupBy(key).agg(F.max_by(F.struct(*(c for c in df.columns if c != key)), seq).alias("row")).select(key, "row.*")


def flatten_tree(df: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, root, level) of an adjacency list of any depth (SRC06); a node that no root leads to is left out.

    Each round doubles the distance that a node has climbed, so it takes as many joins as the depth has binary digits;
    each is checkpointed. A cycle raises ``ValueError``.
    """
    own = df.select(F.col(node).alias("node"), F.col(parent).alias("parent"))
    now = cut(own.select("node", F.coalesce("parent", "node").alias("top"), F.col("parent").isNotNull().cast("int").alias("level"), F.col("parent").isNotNull().alias("open")))
    rounds = 2 + max(1, now.count()).bit_length()
    for _ in range(rounds):
        if now.where("open").isEmpty():
            return now.select("node", F.col("top").alias("root"), "level")
        up = now.select(F.col("node").alias("top"), F.col("top").alias("next"), F.col("level").alias("more"), F.col("open").alias("still"))
        climbed = now.where("open").join(up, "top").select("node", F.col("next").alias("top"), (F.col("level") + F.col("more")).alias("level"), F.col("still").alias("open"))
        now = cut(now.where("not open").unionByName(climbed))
    raise ValueError("the tree has a cycle")


def support(assignments: DataFrame, docs: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """(node_id, n_docs) over assigned documents that exist, and declared ones (JOI01)."""
    pairs = assignments.join(docs.select("doc_id"), "doc_id", "left_semi").select("node_id", "doc_id")
    if declared is not None:
        pairs = pairs.unionByName(declared.select("node_id", "doc_id"))
    return pairs.groupBy("node_id").agg(F.count_distinct("doc_id").alias("n_docs"))


def assign_by_phrase(docs: DataFrame, aliases: DataFrame) -> DataFrame:
    """Documents with a node's alias as a whole word or phrase, in any case (JOI02); a null or empty alias has none.

    All aliases are looked for in one pass over each text, which isn't moved (``names.names_in_texts``).
    """
    named = aliases.select("node_id", F.lower("alias").alias("name"))
    found = names_in_texts(docs.select("doc_id", F.lower("text").alias("text")), named, "doc_id", whole=True)
    return found.join(named.distinct(), "name").select("doc_id", "node_id").distinct()


def top_phrases(docs: DataFrame, group: str, k: int = 8) -> DataFrame:
    """The commonest bigrams of each group, then unigrams to fill (AGG05); ties by the phrase.

    Counts are aggregated before the rank, and Spark keeps only k rows of a group on each side of the shuffle.
    """
    tokens = docs.select(F.col(group).alias("grp"), T.tokenize(F.col("text")).alias("t"))
    grams = tokens.select("grp", F.explode(F.concat(F.transform("t", lambda x: F.struct(F.lit(1).alias("n"), x.alias("phrase"))), F.transform(T.ngrams(F.col("t"), 2, 2), lambda x: F.struct(F.lit(2).alias("n"), x.alias("phrase"))))).alias("g"))
    counts = grams.groupBy("grp", "g.n", "g.phrase").agg(F.count("*").alias("cnt"))
    rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("n"), F.desc("cnt"), "phrase"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("grp").alias(group), "rank", "phrase", "cnt")


def node_enrichment(members: DataFrame) -> DataFrame:
    """Support, uncertainty 1/sqrt(n+1), novelty (share of the last two years) and status of each node (AGG06).

    ``members`` has a row for each (node_id, doc_id) with its date.
    """
    year = F.year("published_at")
    last = members.groupBy("node_id").agg(F.max(year).alias("last"), F.count_distinct("doc_id").alias("n_docs"))
    joined = members.join(last, "node_id").groupBy("node_id", "n_docs").agg(F.sum(F.when(year >= F.col("last") - 1, 1).otherwise(0)).alias("recent"), F.count("published_at").alias("dated"))
    novelty = F.when(F.col("dated") > 0, F.col("recent") / F.col("dated")).otherwise(0.0)
    rows = joined.select("node_id", "n_docs", F.round(1 / F.sqrt(F.col("n_docs") + 1), 3).alias("uncertainty"), F.round(novelty, 3).alias("novelty"))
    status = F.when(F.col("n_docs") == 0, "birth").when(F.col("n_docs") < 3, "emerging").when(F.col("novelty") >= 0.75, "growing").when(F.col("n_docs") >= 10, "mature").otherwise("emerging")
    return rows.withColumn("status", status)


def node_quality(nodes: DataFrame, support_: DataFrame) -> DataFrame:
    """Uniqueness, coverage, granularity and sibling spread of taxonomy nodes (AGG07, HLP17)."""
    same = F.count("*").over(Window.partitionBy(F.lower("label")))
    children = nodes.where("parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("children"))
    words = F.size(F.split("label", " "))
    brothers = Window.partitionBy("parent_id")
    rows = nodes.withColumn("same", same).withColumn("spread", F.max(words).over(brothers) - F.min(words).over(brothers)).join(children, "node_id", "left").join(support_, "node_id", "left")
    n = F.coalesce("n_docs", F.lit(0))
    kids = F.coalesce("children", F.lit(0))
    return rows.select(
        "node_id", F.when(F.col("same") > 1, 0.4).otherwise(1.0).alias("uniqueness"), F.round(F.least(F.lit(1.0), n / 5), 3).alias("coverage"),
        F.when(kids > 10, 0.6).when(kids > 0, 0.8).otherwise(0.7).alias("granularity"), F.when(F.col("parent_id").isNull(), 0.8).when(F.col("spread") <= 3, 0.85).otherwise(0.6).alias("siblings"),
    )


def taxonomy_events(now: DataFrame, before: DataFrame) -> DataFrame:
    """Births, renames and splits between two snapshots of (node_id, label, parent_id) (JOI12, SET04)."""
    births = now.join(before, "node_id", "left_anti").select("node_id", F.lit("birth").alias("event"))
    renames = now.alias("n").join(before.alias("b"), "node_id").where(F.col("n.label") != F.col("b.label")).select("node_id", F.lit("rename").alias("event"))

    def kids(df: DataFrame) -> DataFrame:
        return df.where("parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("kids"))

    splits = kids(now).alias("n").join(kids(before).alias("b"), "node_id", "left").where((F.col("n.kids") >= 2) & (F.coalesce("b.kids", F.lit(0)) < 2)).select("node_id", F.lit("split").alias("event"))
    return reduce(DataFrame.unionByName, (births, renames, splits))


def build_entities(mentions: DataFrame, least: int = 1) -> DataFrame:
    """Entities with at least ``least`` documents: first date and name, counts (AGG02)."""
    return mentions.groupBy("entity_id").agg(
        F.min_by("canonical_name", F.struct("published_at", "doc_id", "seq")).alias("canonical_name"), F.min("published_at").alias("first_seen"), F.count("*").alias("mentions"),
        F.count_distinct("doc_id").alias("n_docs"), F.array_sort(F.collect_set("node_id")).alias("nodes"), F.first("entity_type").alias("entity_type"),
    ).where(F.col("n_docs") >= least)


GENERIC = ["method", "approach", "model", "system", "framework", "analysis"]
CONNECTORS = [" and ", " the ", " of ", " for "]


def entity_quality(entities: DataFrame, least: float = 0.42, generic: list[str] | None = None) -> DataFrame:
    """Heuristic score from 0 to 1 and status of each entity (FIL02): a start value with bonuses and penalties.

    Needs ``canonical_name, mentions, n_docs``.
    """
    generic = GENERIC if generic is None else generic
    name, tokens = F.trim("canonical_name"), T.tokenize(F.trim("canonical_name"))
    n = F.size(tokens)
    first = F.substring(name, 1, 1)

    def when(rule: Column, value: float) -> Column:
        return F.when(rule, value).otherwise(0.0)

    score = (
        F.lit(0.45) + when(n == 0, -0.5) + F.when(n.between(1, 4), 0.18).when(n > 6, -0.28).otherwise(0.0) + when(F.exists(tokens, lambda t: t.isin(generic)), -0.18)
        + when(F.lower(name).isin(generic), -0.4) + F.when(~reduce(lambda a, b: a | b, (F.contains(F.lower(name), F.lit(c)) for c in CONNECTORS)), 0.0).when(n <= 4, -0.18).otherwise(-0.28)
        + when((n >= 4) & (F.col("n_docs") < 2) & (F.col("mentions") < 2), -0.12) + when((first != F.lower(first)) & (n <= 4), 0.08) + when(name.rlike(r"\d"), 0.04)
        + when(name.rlike("[-_]"), 0.04) + when(F.col("mentions") >= 2, 0.12) + when(F.col("n_docs") >= 2, 0.1) + when(F.char_length(name) > 80, -0.35)
    )
    out = entities.withColumn("quality", F.round(V.clamp01(score), 3))
    return out.withColumn("status", F.when(F.col("quality") >= least, "kept").otherwise("filtered"))


def canonical_links(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(entity_id, canonical_id): the alias table's target, else the first id of the same type and folded name (JOI10, AGG04)."""
    keyed = entities.select("entity_id", "entity_type", T.alias_norm(F.col("canonical_name")).alias("norm"))
    # a configured table: Spark broadcasts it if it is small
    named = keyed.join(aliases.select(F.col("alias").alias("norm"), "target"), "norm", "left").withColumn("norm", F.coalesce("target", "norm"))
    canon = named.groupBy("entity_type", "norm").agg(F.min("entity_id").alias("canonical_id"))
    return named.join(canon, ["entity_type", "norm"]).select("entity_id", "canonical_id")


def overlapping_pairs(sets: DataFrame, share: float) -> DataFrame:
    """(entity_type, a, b), a before b: of ``entity_type, norm, items`` (distinct) the pairs of a type with at least ``share`` of the larger set in common.

    No such pair is lost: in one order of the items (rare ones first) two sets of n items that have share * n in common
    meet in the first n - share * n + 1. Only these meet in an equi-join; sizes and common items are then compared.
    """
    size, slack = F.size("items"), F.lit(1e-9)
    one = sets.select("entity_type", "norm", F.explode("items").alias("item"))
    counts = one.groupBy("entity_type", "item").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("entity_type", "norm").orderBy("n", "item"))
    sized = sets.select("entity_type", "norm", size.alias("size"))
    first = one.join(counts, ["entity_type", "item"]).withColumn("rank", rank).join(sized, ["entity_type", "norm"])
    keys = first.where(F.col("rank") <= F.col("size") - F.ceil(share * F.col("size") - slack) + 1).select("entity_type", "item", "norm", "size")
    a, b = keys.alias("a"), keys.alias("b")
    larger, smaller = F.greatest("a.size", "b.size"), F.least("a.size", "b.size")
    met = a.join(b, ["entity_type", "item"]).where((F.col("a.norm") < F.col("b.norm")) & (smaller >= share * larger - slack))
    pairs = met.select("entity_type", F.col("a.norm").alias("a"), F.col("b.norm").alias("b")).distinct()
    s = pairs.join(sets.select("entity_type", F.col("norm").alias("a"), F.col("items").alias("x")), ["entity_type", "a"]).join(sets.select("entity_type", F.col("norm").alias("b"), F.col("items").alias("y")), ["entity_type", "b"])
    return s.where(F.size(F.array_intersect("x", "y")) >= share * F.greatest(F.size("x"), F.size("y")) - slack).select("entity_type", "a", "b")


def merge_similar(entities: DataFrame, least: float = 0.86) -> DataFrame:
    """Greedy near-duplicate linking within a type in order of names (JOI11, STR18): the first target that is similar.

    Folded names are similar if they are equal, share ``least`` (above 0) of all their tokens, or have that difflib ratio.
    The ratio is at most twice the common characters over all, so similar names have least / (2 - least) of the longer's
    characters in common; ``overlapping_pairs`` loses none of them. Names without a token are linked if they are equal.
    The greedy pass over a type holds its similar pairs only.
    """
    keyed = entities.select("entity_type", "entity_id", F.lower("canonical_name").alias("name"), T.alias_norm(F.col("canonical_name")).alias("norm"))
    # equal folded names always have the same target; those without a token are told apart by the name itself
    keyed = keyed.withColumn("norm", F.when(F.col("norm") == "", F.concat(F.lit("\u0001"), "name")).otherwise(F.col("norm")))
    heads = keyed.groupBy("entity_type", "norm").agg(F.min(F.struct("name", "entity_id")).alias("head"))
    named = heads.where(~F.col("norm").startswith("\u0001")).select("entity_type", "norm")
    chars = F.split("norm", "")
    numbered = F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x == c)).cast("string")))
    by_chars = overlapping_pairs(named.withColumn("items", numbered), least / (2 - least))
    by_tokens = overlapping_pairs(named.withColumn("items", F.array_distinct(F.split("norm", " "))), least)

    @F.pandas_udf("boolean")
    def similar(first: pd.Series, second: pd.Series) -> pd.Series:
        def test(a: str, b: str) -> bool:
            s, t = set(a.split()), set(b.split())
            return len(s & t) / len(s | t) >= least or difflib.SequenceMatcher(None, a, b).ratio() >= least

        return pd.Series([test(a, b) for a, b in zip(first, second)], dtype=bool)

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[tuple[str, str], list[tuple[str, str]]] = {}
        for a, i, b, j in zip(pdf["n1"], pdf["i1"], pdf["n2"], pdf["i2"]):
            near.setdefault((b, j), []).append((a, i))
        linked: dict[tuple[str, str], tuple[str, str]] = {}
        for own in sorted(near):
            target = min((x for x in near[own] if x not in linked), default=None)
            if target is not None:
                linked[own] = target
        return pd.DataFrame([(own[1], target[1]) for own, target in linked.items()], columns=["head_id", "target_id"])

    order = by_chars.unionByName(by_tokens).distinct().join(heads.select("entity_type", F.col("norm").alias("a"), F.col("head").alias("ha")), ["entity_type", "a"]).join(heads.select("entity_type", F.col("norm").alias("b"), F.col("head").alias("hb")), ["entity_type", "b"])
    turned = F.col("ha") > F.col("hb")  # the ratio depends on the order: the earlier name comes first
    pairs = order.where(similar(F.when(turned, F.col("b")).otherwise(F.col("a")), F.when(turned, F.col("a")).otherwise(F.col("b")))).select("entity_type", F.least("ha", "hb").alias("p"), F.greatest("ha", "hb").alias("q"))
    ends = pairs.select("entity_type", F.col("p.name").alias("n1"), F.col("p.entity_id").alias("i1"), F.col("q.name").alias("n2"), F.col("q.entity_id").alias("i2"))
    links = ends.groupBy("entity_type").applyInPandas(lambda key, pdf: link(pdf).assign(entity_type=key[0]), "head_id string, target_id string, entity_type string")
    own = keyed.join(heads, ["entity_type", "norm"]).select("entity_type", "entity_id", F.col("head.entity_id").alias("head_id"))
    return own.join(links, ["entity_type", "head_id"], "left").select("entity_id", F.coalesce("target_id", "head_id").alias("target_id"))
