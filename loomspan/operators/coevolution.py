"""Feedback of a graph on its taxonomy: revisions and expansions, proposed and applied as tables (GRF08, GRF09, AGG09)."""

from __future__ import annotations

from functools import reduce
from itertools import chain, count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.operators.corpus import top_phrases
from loomspan.operators.graph import STRONG, top_per_group
from loomspan.operators.lineage import written
from loomspan.operators.relations import cross_link_confidence, split_confidence, state_confidence

# Words that a label from a graph may not hold.
BLOCKED_FRAGMENTS = [" the", " this", " that", " it ", " improves ", " extends ", " adapts ", " replaces "]
# Words of a dimension and an entity type that go together.
COMPATIBLE = {
    "intervention": ["policy", "instrument", "governance", "program"], "policy": ["intervention", "governance", "instrument"], "instrument": ["intervention", "policy", "governance"],
    "mechanism": ["explanatory"], "explanatory": ["mechanism"], "measurement": ["evaluation", "protocol", "strategy", "audit"], "strategy": ["measurement", "evaluation", "protocol"],
    "evaluation": ["measurement", "strategy", "protocol"], "frame": ["public", "framing"], "public": ["frame", "framing"],
}
#: The columns of a taxonomy's nodes here.
NODE = "node_id string, parent_id string, dimension string, label string, definition string, state string, linked_nodes array<string>, linked_entities array<string>"


def node_table(nodes: DataFrame) -> DataFrame:
    """Nodes with all columns of ``NODE``, missing ones empty."""
    empty = {"definition": F.lit(""), "dimension": F.lit(""), "state": F.lit(""), "linked_nodes": F.array().cast("array<string>"), "linked_entities": F.array().cast("array<string>")}
    names = [part.split()[0] for part in NODE.split(", ")]
    return nodes.select(*(F.col(n) if n in nodes.columns else empty[n].alias(n) for n in names))


def _singular(token: Column) -> Column:
    n = F.char_length(token)
    return F.when(token.endswith("ies") & (n > 4), F.regexp_replace(token, "ies$", "y")).when(token.endswith("s") & (n > 3), F.regexp_replace(token, "s$", "")).otherwise(token)


def dimension_fits(dimension: Column, entity_type: Column) -> Column:
    """Whether an entity's type belongs to a dimension: they share a word or have compatible ones, or either has no words."""
    words = lambda c: F.transform(T.tokenize(F.regexp_replace(c, "_", " ")), _singular)
    table = F.create_map(*(x for k, ws in COMPATIBLE.items() for x in (F.lit(k), F.array(*(F.lit(w) for w in ws)))))
    a, b = words(dimension), words(entity_type)
    near = lambda x, y: F.exists(x, lambda w: F.coalesce(F.arrays_overlap(F.try_element_at(table, w), y), F.lit(False)))
    return (F.size(a) == 0) | (F.size(b) == 0) | F.arrays_overlap(a, b) | near(a, b) | near(b, a)


def valid_label(label: Column) -> Column:
    """One to four tokens and none of the blocked words."""
    spaced = F.concat(F.lit(" "), F.lower(label), F.lit(" "))
    return F.size(T.tokenize(label)).between(1, 4) & ~reduce(lambda a, b: a | b, (F.contains(spaced, F.lit(x)) for x in BLOCKED_FRAGMENTS))


def node_feedback(nodes: DataFrame, members: DataFrame | None, edges: DataFrame, expansions: DataFrame | None = None) -> DataFrame:
    """What each node's entities, edges and expansion candidates call for (AGG09): counts and ``advice`` (array).

    ``members``: node_id, entity_id (None: the ends of a node's edges); ``edges``: a row for each node and edge, with edge_type, verified and bottleneck (an edge that tells one);
    ``expansions``: trigger_node_id. Every node has a row; without a reason its advice is ``monitor``.
    A node's edges are brought together once; the distinct ids and ends, and their counts, need no further shuffle.
    """
    strong = F.coalesce(F.col("verified") & F.col("edge_type").isin(STRONG), F.lit(False))
    held = edges.select("node_id", "edge_id", "source", "target", strong.alias("strong"), F.coalesce("bottleneck", F.lit(False)).alias("bottleneck")).repartition("node_id")
    # three facts an edge: its id and its ends
    tag = F.col("tag")
    facts = held.select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("tag"))
    if members is not None:
        facts = facts.where((tag == 0) | F.col("strong"))
    facts = facts.groupBy("node_id", F.when(tag == 0, F.col("edge_id")).alias("edge"), F.when(tag == 1, F.col("source")).when(tag == 2, F.col("target")).alias("end")).agg(
        F.max("strong").alias("strong"), F.max(F.col("strong") & (tag == 1)).alias("out"), F.max(F.col("strong") & (tag == 2)).alias("into"), F.max("bottleneck").alias("bottleneck")
    )
    per = facts.groupBy("node_id").agg(
        F.count("edge").alias("edges"), F.count_if(F.col("edge").isNotNull() & F.col("strong")).alias("strong"), F.count_if(F.col("end").isNotNull() & F.col("into")).alias("successors"),
        F.count_if(F.col("end").isNotNull() & F.col("out")).alias("sources"), F.max("bottleneck").alias("bottleneck"), *([F.count("end").alias("entities")] if members is None else []),
    )
    rows = nodes.select("node_id").distinct().join(per, "node_id", "left")
    if members is not None:
        rows = rows.join(members.groupBy("node_id").agg(F.count_distinct("entity_id").alias("entities")), "node_id", "left")
    if expansions is not None:
        rows = rows.join(expansions.groupBy(F.col("trigger_node_id").alias("node_id")).agg(F.count("*").alias("expansions")), "node_id", "left")
    else:
        rows = rows.withColumn("expansions", F.lit(0).cast("long"))
    rows = rows.na.fill(0, ["edges", "strong", "successors", "sources", "entities", "expansions"]).na.fill(False, ["bottleneck"])
    advice = F.array_compact(F.array(
        F.when((F.col("successors") >= 3) & (F.col("sources") >= 2), "split_review"), F.when((F.col("entities") >= 4) & (F.col("edges") >= 4), "cross_link_review"),
        F.when(F.col("expansions") > 0, "apply_or_audit_expansion_candidates"), F.when(F.col("bottleneck") & (F.col("strong") > 0), "mark_fragmenting_or_growing"),
    ))
    rows = rows.select("node_id", "edges", "strong", "successors", "sources", "bottleneck", "entities", "expansions")
    return rows.withColumn("advice", F.when(F.size(advice) > 0, advice).otherwise(F.array(F.lit("monitor"))))


REVISION = ["candidate_id", "revision_type", "node_id", "dimension", "label", "state", "linked_nodes", "linked_entities", "confidence", "support"]


def propose_revisions(nodes: DataFrame, entities: DataFrame, edges: DataFrame, feedback: DataFrame, most: int = 30) -> tuple[DataFrame, DataFrame]:
    """(candidates, documents): the ``most`` surest revisions that a node's edges and advice speak for (GRF09, SCO08).

    ``nodes``: node_id, dimension; ``entities``: entity_id, canonical_name, entity_type; ``edges`` as in :func:`node_feedback`, with ends and
    documents; ``feedback`` has a row a node. A node to split gives the three targets of most verified edges whose names are valid and
    whose types fit the dimension; it and a node to mark are given a state; other nodes of its edges, or entities of other types, give a cross link
    under any advice. Of equal candidate ids the surest stays, of these that with most edges. ``documents``: candidate_id, doc_id.
    Where ``edges`` has ``nodes`` (array), all nodes of the row's edge, no join finds the others. Edges are moved to their nodes with few columns at a time; a ``most`` of
    2**31 - 1 takes all candidates without a sort.
    """
    empty = F.array().cast("array<string>")
    own = written(feedback.join(nodes.select("node_id", "dimension"), "node_id").select("node_id", "dimension", "advice", "entities", F.col("edges").alias("edge_count"), "strong"))
    known = written(entities.select(F.col("entity_id").alias("target"), "canonical_name", "entity_type").distinct())

    advised = own.where(F.arrays_overlap("advice", F.array(F.lit("split_review"), F.lit("mark_fragmenting_or_growing"))))
    seen = edges.select("node_id", "edge_id", "target", "verified").join(advised.select("node_id"), "node_id", "left_semi").repartition("node_id")
    per = seen.groupBy("node_id", "target").agg(F.count_distinct(F.when(F.col("verified"), F.col("edge_id"))).alias("n"))
    # with the number of verified targets of the node
    per = per.withColumn("after", F.count_if(F.col("target").isNotNull() & (F.col("n") > 0)).over(Window.partitionBy("node_id")))
    top = written(top_per_group(per, ["node_id"], [F.desc("n"), "target"], 3).select("node_id", "target", "n", "after", "rank"))
    best = top.where("n > 0").join(known, "target", "left").join(own.where(F.array_contains("advice", "split_review")), "node_id")
    label = F.coalesce("canonical_name", T.name_of(F.col("target")))
    fit = F.col("entity_type").isNull() | dimension_fits(F.col("dimension"), F.col("entity_type"))
    best = best.withColumn("label", label).where(valid_label(F.col("label")) & fit)
    split_id = F.concat_ws("__", F.lit("revision_split"), T.slugify(F.col("node_id")), T.slugify(F.col("label")))
    # read for the candidates and for their documents
    best = written(best.select(split_id.alias("candidate_id"), "node_id", "target", "dimension", "label", split_confidence(F.col("n"), F.col("entities")).alias("confidence"), F.col("n").alias("support")))
    split = best.select("candidate_id", F.lit("split_child").alias("revision_type"), "node_id", "dimension", "label", F.lit("").alias("state"), empty.alias("linked_nodes"), empty.alias("linked_entities"), "confidence", "support")

    first = lambda c, k: F.slice(F.array_sort(F.collect_set(c)), 1, k)
    if "nodes" in edges.columns:
        others = edges.select("node_id", F.array_remove("nodes", F.col("node_id")).alias("nodes")).where(F.size("nodes") > 0).repartition("node_id").select("node_id", F.explode("nodes").alias("other"))
    else:
        pairs = edges.select("node_id", "edge_id").distinct()
        others = pairs.join(pairs.select(F.col("node_id").alias("other"), "edge_id"), "edge_id").where("node_id <> other").select("node_id", "other")
    others = others.distinct().groupBy("node_id").agg(F.count("*").alias("others"), first("other", 8).alias("linked_nodes"))
    # an entity's type and a dimension are compared once for all entities and nodes that have them
    kinds = own.select("dimension").distinct().crossJoin(known.select("entity_type").distinct())
    strangers = written(kinds.where(~dimension_fits(F.col("dimension"), F.col("entity_type"))))
    ends = edges.select("node_id", "source", "target").repartition("node_id").join(own.select("node_id", "dimension"), "node_id").select("node_id", "dimension", F.explode(F.array("source", "target")).alias("target")).distinct()
    strange = ends.join(known, "target").join(strangers, ["dimension", "entity_type"]).select("node_id", "target").distinct().groupBy("node_id").agg(F.count("*").alias("strangers"), first("target", 12).alias("linked_entities"))
    linked = own.join(others, "node_id", "left").join(strange, "node_id", "left").na.fill(0, ["others", "strangers"]).where("others > 0 or strangers > 0")
    cross = written(linked.select(
        F.concat(F.lit("revision_cross_link__"), T.slugify(F.col("node_id"))).alias("candidate_id"), F.lit("cross_link").alias("revision_type"), "node_id", "dimension", F.lit("").alias("label"), F.lit("").alias("state"),
        F.coalesce("linked_nodes", empty).alias("linked_nodes"), F.coalesce("linked_entities", empty).alias("linked_entities"), cross_link_confidence(F.col("others"), F.col("strangers"), F.col("edge_count")).alias("confidence"), F.col("edge_count").alias("support"),
    ))

    marked = top.where("rank = 1").select("node_id", F.col("after").alias("n")).join(advised, "node_id").withColumn("state", F.when(F.col("n") >= 2, "fragmenting").otherwise("growing"))
    state = marked.select(
        F.concat_ws("__", F.lit("revision_state"), T.slugify(F.col("node_id")), F.col("state")).alias("candidate_id"), F.lit("state_annotation").alias("revision_type"), "node_id", "dimension", F.lit("").alias("label"), "state",
        empty.alias("linked_nodes"), empty.alias("linked_entities"), state_confidence(F.col("n"), F.col("strong")).alias("confidence"), F.col("edge_count").alias("support"),
    )
    every = split.unionByName(cross).unionByName(state)
    one = every.groupBy("candidate_id").agg(F.min_by(F.struct(*REVISION[1:]), F.struct(-F.col("confidence"), F.col("node_id"), -F.col("support"))).alias("row")).select("candidate_id", "row.*")
    candidates = written(one.orderBy(F.desc("confidence"), "candidate_id").limit(most) if most < 2**31 - 1 else one)

    # a candidate has one node, and a node few candidates: the targets of its splits (null: any edge speaks for it)
    of = candidates.select("candidate_id", "node_id", "revision_type").join(best.select("candidate_id", "node_id", "target"), ["candidate_id", "node_id"], "left")
    of = of.groupBy("node_id").agg(F.collect_set(F.struct("candidate_id", "target", (F.col("revision_type") == "split_child").alias("split"))).alias("of"))
    told = edges.select("node_id", "target", "verified", "source_document", "target_document").repartition("node_id").join(of, "node_id")
    speaks = F.filter("of", lambda x: ~x["split"] | F.coalesce(F.col("verified") & (x["target"] == F.col("target")), F.lit(False)))
    told = told.select("node_id", F.explode(F.transform(speaks, lambda x: x["candidate_id"])).alias("candidate_id"), F.array("source_document", "target_document").alias("docs"))
    documents = told.select("node_id", "candidate_id", F.explode("docs").alias("doc_id")).where("doc_id is not null").distinct().select("candidate_id", "doc_id")
    return candidates, documents


def _decided(rows: DataFrame, ok: Column, group: list[str], most: int) -> DataFrame:
    """``rows`` (with a total order ``key``) and ``dup``, that an earlier ``ok`` row has the same group, and ``late``, that ``most`` rows are taken before it.

    A row is taken if it is ok, no dup and not late. The order is cut by its ``most``-th row, so no task ranks all rows.
    """
    firsts = rows.where(ok).groupBy(*group).agg(F.min("key").alias("first"))
    told = written(rows.withColumn("ok", ok).join(firsts, group, "left").withColumn("dup", F.col("ok") & (F.col("key") != F.col("first"))).drop("first"))
    ahead = told.where(F.col("ok") & ~F.col("dup")).orderBy("key").limit(most).agg(F.max("key").alias("upto"), F.count("*").alias("taken"))  # one row
    return told.crossJoin(F.broadcast(ahead)).withColumn("late", F.coalesce((F.col("taken") >= most) & (F.col("key") > F.col("upto")), F.lit(most <= 0))).drop("upto", "taken")


def _named(nodes: DataFrame, taken: DataFrame) -> DataFrame:
    """``taken`` (candidate_id, dimension, label, key; as few as may be applied) with a free ``new_node_id`` each, in the order of ``key``."""
    spark = nodes.sparkSession
    base = F.concat_ws("__", F.when(F.trim("dimension") != "", T.slugify(F.col("dimension"))).otherwise("taxonomy"), T.slugify(F.col("label")))
    rows = taken.select("candidate_id", base.alias("base"), "key").orderBy("key").collect()
    bases = spark.createDataFrame([(r.base,) for r in rows], "base string").distinct()
    stem = F.regexp_replace("node_id", "_[0-9]+$", "")
    ids = nodes.select("node_id", F.explode(F.array_distinct(F.array("node_id", stem))).alias("base")).join(F.broadcast(bases), "base", "left_semi")  # at most ``most`` rows are sent
    used, out = {r.node_id for r in ids.collect()}, []
    for r in rows:
        free = next(x for x in chain([r.base], (f"{r.base}_{n}" for n in count(2))) if x not in used)
        used.add(free)
        out.append((r.candidate_id, free))
    return taken.join(spark.createDataFrame(out, "candidate_id string, new_node_id string"), "candidate_id")


def apply_revisions(nodes: DataFrame, candidates: DataFrame, documents: DataFrame, least: float = 0.58, most: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(changed, assigned, report): the nodes that revisions add or note, documents of the new ones, and every candidate's fate (GRF09).

    Candidates are taken by confidence (then id) until ``most`` are applied. A split adds a child, unless its label isn't valid or any node has it, in any case;
    its id is dimension and label, with a number if that exists. The others note an existing node's state or links. ``changed`` has the columns
    ``NODE``, ``assigned`` doc_id and node_id, ``report`` candidate_id, revision_type, node_id, status, reason, new_node_id. Candidates that can't
    be applied don't count. A null confidence is 0, a null label missing; an empty table changes nothing.
    """
    nodes = node_table(nodes)
    sure = F.coalesce("confidence", F.lit(0.0))
    rows = candidates.withColumn("label", F.trim(F.coalesce("label", F.lit("")))).withColumn("key", F.struct((-sure).alias("less"), F.col("candidate_id").alias("id")))
    is_split = F.col("revision_type") == "split_child"
    labels = nodes.select(F.lower("label").alias("low")).distinct().withColumn("known", F.lit(True))
    rows = rows.withColumn("low", F.lower("label")).join(labels, "low", "left").join(nodes.select("node_id", F.lit(True).alias("exists")).distinct(), "node_id", "left")
    flaw = F.when(is_split, F.coalesce(F.when((F.col("label") == "") | (F.coalesce("node_id", F.lit("")) == ""), "missing_label_or_parent"), F.when(~valid_label(F.col("label")), "low_quality_label"), F.when(F.col("known"), "label_already_exists_in_taxonomy")))
    flaw = flaw.when(~F.col("revision_type").isin("cross_link", "state_annotation"), "unknown_revision_type").when(F.col("exists").isNull(), "source_node_missing")
    rows = rows.withColumn("flaw", flaw).withColumn("slot", F.when(is_split, F.concat(F.lit("label "), "low")).otherwise(F.concat(F.lit("id "), "candidate_id")))
    told = written(_decided(rows, (sure >= least) & F.col("flaw").isNull(), ["slot"], most))
    why = F.coalesce(F.when(F.col("late"), "max_applied_revisions_reached"), F.when(sure < least, "below_revision_acceptance_threshold"), "flaw", F.when(F.col("dup"), "label_already_exists_in_taxonomy"))
    told = told.withColumn("reason", F.coalesce(why, F.when(is_split, "created_graph_derived_child").otherwise("annotated_existing_node")))
    status = F.when(why.isNull(), "applied").when(F.col("reason") == "label_already_exists_in_taxonomy", "deduplicated").otherwise("rejected")
    told = told.withColumn("status", status)
    applied = told.where("status = 'applied'")

    new = _named(nodes, applied.where(is_split).select("candidate_id", "node_id", "dimension", "label", "key"))
    empty = F.array().cast("array<string>")
    definition = F.concat(F.lit("Graph-derived child for successor mechanism "), "label", F.lit("."))
    born = new.select(F.col("new_node_id").alias("node_id"), F.col("node_id").alias("parent_id"), F.coalesce("dimension", F.lit("")).alias("dimension"), "label", definition.alias("definition"), F.lit("").alias("state"), empty.alias("linked_nodes"), empty.alias("linked_entities"))
    notes = applied.where(~is_split).groupBy("node_id").agg(
        F.max_by("state", F.when(F.col("revision_type") == "state_annotation", F.col("key"))).alias("new_state"), F.flatten(F.collect_list("linked_nodes")).alias("more_nodes"), F.flatten(F.collect_list("linked_entities")).alias("more_entities")
    )
    union = lambda a, b: F.array_sort(F.array_distinct(F.concat(a, b)))
    noted = nodes.join(notes, "node_id").select("node_id", "parent_id", "dimension", "label", "definition", F.coalesce("new_state", "state").alias("state"), union("linked_nodes", "more_nodes").alias("linked_nodes"), union("linked_entities", "more_entities").alias("linked_entities"))
    assigned = documents.join(new.select("candidate_id", "new_node_id"), "candidate_id").select("doc_id", F.col("new_node_id").alias("node_id")).distinct()
    report = told.join(new.select("candidate_id", "new_node_id"), "candidate_id", "left").select("candidate_id", "revision_type", "node_id", "status", "reason", "new_node_id")
    return born.unionByName(noted), assigned, report


def propose_expansions(signals: DataFrame, docs: DataFrame, nodes: DataFrame, least: float = 0.55, each: int = 3, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """(candidates, documents): the commonest phrases of the nodes whose score is ``least`` or more (GRF08).

    ``signals``: node_id, score, action; ``docs``: node_id, doc_id, text, a row for each document of a node; ``nodes``: node_id, parent_id, dimension, label. A
    node without documents gives the phrases of its label. Nodes are taken by score (then id) until there are ``most`` candidates or more. ``documents``
    (candidate_id, doc_id) hold a candidate's phrase in any case. A null phrase or an unknown node gives none.
    """
    # written, so its size is known and texts aren't moved to it if it is small
    strong = written(signals.where(F.col("score") >= least).join(nodes.select("node_id", "parent_id", "dimension", F.col("label").alias("node_label")), "node_id"))
    told = docs.join(strong.select("node_id"), "node_id", "left_semi")
    bare = strong.join(told.select("node_id").distinct(), "node_id", "left_anti").select("node_id", F.col("node_label").alias("text"))
    phrases = top_phrases(told.select("node_id", "text").unionByName(bare), "node_id", 8).where(F.col("rank") <= each)
    found = written(phrases.select("node_id", "phrase", "rank"))
    counts = found.groupBy("node_id").agg(F.count("*").alias("n")).join(strong.select("node_id", "score"), "node_id")
    # each of these nodes gives one candidate at least, so no more than ``most`` are needed
    first = counts.orderBy(F.desc("score"), "node_id").limit(most).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "node_id", "n"))).alias("all"))
    before = F.aggregate(F.slice(F.col("all"), F.lit(1), F.col("pos")), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    taken = first.select("all", F.posexplode("all").alias("pos", "one")).where(before < most).select("one.node_id")
    deep = F.col("action").isin("depth_expansion", "fragmentation_review")
    kind = F.when(deep, "depth").otherwise("width")
    rows = written(found.join(taken, "node_id", "left_semi").join(strong, "node_id").select(
        F.concat_ws("__", kind, T.slugify(F.col("node_id")), T.slugify(F.col("phrase"))).alias("candidate_id"), kind.alias("candidate_type"), F.when(deep, F.col("node_id")).otherwise(F.col("parent_id")).alias("parent_node_id"),
        "dimension", F.col("phrase").alias("label"), F.col("node_id").alias("trigger_node_id"), F.col("score").alias("trigger_score"), F.col("action").alias("recommended_action"),
    ))
    # a text meets the few candidates of its node at once, and only the ids that hold one are moved
    of = rows.groupBy("trigger_node_id").agg(F.collect_set(F.struct("candidate_id", F.lower("label").alias("low"))).alias("of"))
    low = docs.withColumnRenamed("node_id", "trigger_node_id").join(written(of), "trigger_node_id").select("doc_id", F.lower("text").alias("low"), "of")
    held = low.select("doc_id", F.explode(F.transform(F.filter("of", lambda c: F.contains("low", c["low"])), lambda c: c["candidate_id"])).alias("candidate_id"))
    return rows, written(held.select("candidate_id", "doc_id").distinct())


def judged(candidates: DataFrame, documents: DataFrame | None, judgements: DataFrame | None, least: float = 0.6) -> DataFrame:
    """Candidates with a judge's output by candidate id (JOI21): its confidence and label where it has one, ``accepted`` by both.

    ``judgements``: candidate_id, accept, confidence, suggested_label. Without one a candidate with documents is accepted, and the trigger's score counts.
    """
    j = judgements if judgements is not None else candidates.sparkSession.createDataFrame([], "candidate_id string, accept boolean, confidence double, suggested_label string")
    j = j.select("candidate_id", "accept", F.col("confidence").alias("judged"), "suggested_label")
    rows = candidates.join(j, "candidate_id", "left")
    if documents is not None:
        rows = rows.join(documents.select("candidate_id", F.lit(True).alias("supported")).distinct(), "candidate_id", "left")
    supported = F.coalesce("supported", F.lit(False)) if documents is not None else F.lit(True)
    confidence = F.coalesce("judged", "trigger_score", F.lit(0.0))
    label = F.coalesce(F.when(F.trim("suggested_label") != "", F.trim("suggested_label")), F.trim("label"))
    rows = rows.withColumn("confidence", F.round(confidence, 3)).withColumn("label", label).withColumn("accepted", F.coalesce(F.col("accept"), supported) & (confidence >= least))
    return rows.drop("accept", "judged", "suggested_label", "supported")


def apply_expansions(nodes: DataFrame, candidates: DataFrame, documents: DataFrame, most: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new, assigned, report): judged candidates by trigger score (then id) until ``most`` are applied (GRF08).

    One that wasn't accepted, or has no label, is rejected; a label that a child of the same parent has, in any case, is left out. ``report`` has the candidates up to the last applied: candidate_id, status, reason, new_node_id, parent_node_id, label.
    """
    nodes = node_table(nodes)
    rows = candidates.withColumn("label", F.trim(F.coalesce("label", F.lit("")))).withColumn("parent", F.coalesce("parent_node_id", F.lit("")))
    rows = rows.withColumn("key", F.struct((-F.coalesce("trigger_score", F.lit(0.0))).alias("less"), F.col("candidate_id").alias("id"))).withColumn("low", F.lower("label"))
    siblings = nodes.select(F.coalesce("parent_id", F.lit("")).alias("parent"), F.lower("label").alias("low")).distinct().withColumn("known", F.lit(True))
    rows = rows.join(siblings, ["parent", "low"], "left")
    flaw = F.coalesce(F.when(~F.coalesce("accepted", F.lit(False)), "below_acceptance_threshold"), F.when(F.col("label") == "", "missing_label"), F.when(F.col("known"), "sibling_label_exists"))
    told = written(_decided(rows.withColumn("flaw", flaw), F.col("flaw").isNull(), ["parent", "low"], most).where("not late"))
    told = told.withColumn("reason", F.coalesce("flaw", F.when(F.col("dup"), "sibling_label_exists"), F.lit("")))
    told = told.withColumn("status", F.when(F.col("reason") == "", "applied").when(F.col("reason") == "sibling_label_exists", "deduplicated").otherwise("rejected"))
    new = _named(nodes, told.where("status = 'applied'").select("candidate_id", "parent_node_id", "dimension", "label", "key"))
    empty = F.array().cast("array<string>")
    definition = F.concat(F.lit("Applied expansion candidate for "), "label", F.lit("."))
    born = new.select(F.col("new_node_id").alias("node_id"), F.col("parent_node_id").alias("parent_id"), F.coalesce("dimension", F.lit("")).alias("dimension"), "label", definition.alias("definition"), F.lit("").alias("state"), empty.alias("linked_nodes"), empty.alias("linked_entities"))
    assigned = documents.join(new.select("candidate_id", "new_node_id"), "candidate_id").select("doc_id", F.col("new_node_id").alias("node_id")).distinct()
    report = told.join(new.select("candidate_id", "new_node_id"), "candidate_id", "left").select("candidate_id", "status", "reason", "new_node_id", "parent_node_id", "label")
    return born, assigned, report
