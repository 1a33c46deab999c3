"""The loop between taxonomy and graph (GRF10): rounds of feedback, revision and extraction over versioned tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import coevolution
from loomspan.operators.corpus import last_wins

#: What a state is made of: nodes as in ``coevolution.NODE``; doc_id, node_id; entity_id, node_id and what an extraction adds; edges, a row for each node.
TABLES = ("nodes", "assignments", "mentions", "edges")
#: ``extract`` finds what new pairs of a document and a node add: (mentions, edges).
Extract = Callable[[DataFrame], tuple[DataFrame, DataFrame]]
STEPS = "round int, status string, candidates long, applied long"


def _is_written(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _put(df: DataFrame, root: str, k: int, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{root}/round-{k}/{name}")


def _get(spark: SparkSession, root: str, k: int, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/round-{k}/{name}")


def state(spark: SparkSession, root: str, k: int, name: str) -> DataFrame:
    """A table as of round ``k``: what the rounds up to it have added; of a node its last version. Rounds are few, so this is a short union."""
    rows = reduce(DataFrame.unionByName, (_get(spark, root, i, name).withColumn("__round", F.lit(i)) for i in range(k + 1)))
    return last_wins(rows, "node_id", "__round").drop("__round") if name == "nodes" else rows.drop("__round")


def steps(spark: SparkSession, root: str) -> DataFrame:
    """``round, status, candidates, applied`` of the rounds that are written; round 0 is the start."""
    found, k = [], 0
    while _is_written(spark, f"{root}/round-{k}/step"):
        found.append(_get(spark, root, k, "step"))
        k += 1
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], STEPS)


def coevolve(spark: SparkSession, root: str, start: Callable[[], dict[str, DataFrame]], entities: DataFrame, extract: Extract, rounds: int = 2, most: int = 30, least: float = 0.58, most_applied: int = 10) -> dict[str, DataFrame]:
    """The tables after at most ``rounds`` rounds, each of which ends the loop if no revision is proposed or none is applied.

    A round reads the state of the one before, takes feedback, proposes and applies revisions, and lets ``extract`` work on the new pairs
    of documents and nodes only. It writes what it adds (copy on write: a changed node is a new version) below ``root``, its row of
    :func:`steps` last. A run that finds written rounds goes on behind the last of them, so a failure costs the round it is in;
    ``start`` is asked for the first state only if that isn't written. Returns ``TABLES``, ``feedback`` of the last state, ``steps`` and ``reports``.
    """
    done = steps(spark, root).orderBy("round").collect()
    if not done:
        first = start()
        for name in TABLES:
            _put(coevolution.node_table(first[name]) if name == "nodes" else first[name], root, 0, name)
        _put(spark.createDataFrame([(0, "start", 0, 0)], STEPS), root, 0, "step")
        done = [(0, "start", 0, 0)]
    k, status = done[-1][0], done[-1][1]

    def feedback(at: int) -> DataFrame:
        members = state(spark, root, at, "mentions").select("node_id", "entity_id").distinct()
        return coevolution.node_feedback(state(spark, root, at, "nodes"), members, state(spark, root, at, "edges"))

    while k < rounds and status in ("start", "applied"):
        nodes, edges = state(spark, root, k, "nodes"), state(spark, root, k, "edges")
        candidates, documents = coevolution.propose_revisions(nodes, entities, edges, feedback(k), most)
        _put(candidates, root, k + 1, "candidates")
        candidates = _get(spark, root, k + 1, "candidates")
        changed, assigned, report = coevolution.apply_revisions(nodes, candidates, documents, least, most_applied)
        _put(report, root, k + 1, "report")
        counts = _get(spark, root, k + 1, "report").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "applied").alias("applied")).first()
        status = "applied" if counts.applied else "no_applied_revisions" if counts.n else "no_revision_candidates"
        _put(changed, root, k + 1, "nodes")
        _put(assigned.join(state(spark, root, k, "assignments"), ["doc_id", "node_id"], "left_anti"), root, k + 1, "assignments")
        mentions, more = extract(_get(spark, root, k + 1, "assignments"))
        _put(mentions.select(*state(spark, root, k, "mentions").columns), root, k + 1, "mentions")
        _put(more.select(*edges.columns), root, k + 1, "edges")
        k += 1
        _put(spark.createDataFrame([(k, status, counts.n, counts.applied)], STEPS), root, k, "step")
    reports = [_get(spark, root, i, "report").withColumn("round", F.lit(i)) for i in range(1, k + 1)]
    empty = spark.createDataFrame([], "candidate_id string, revision_type string, node_id string, status string, reason string, new_node_id string, round int")
    out = {name: state(spark, root, k, name) for name in TABLES} | {"feedback": feedback(k), "steps": steps(spark, root)}
    return out | {"reports": reduce(DataFrame.unionByName, reports, empty)}
