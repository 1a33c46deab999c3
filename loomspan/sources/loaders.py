"""Corpus, taxonomy and assignment files to typed tables."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from loomspan.functions import text as T
from loomspan.functions import values as V
from loomspan.operators.corpus import skip_reason

DOCUMENT = "doc_id string, title string, text string, published_at date, chronology_slice string, role string, source_type string"


@dataclass(frozen=True)
class CorpusConfig:
    """Where a logical column comes from: dotted paths, the first that isn't empty; texts are joined."""

    ids: tuple[str, ...] = ("doc_id", "paper_id", "id")
    titles: tuple[str, ...] = ("title", "display_name")
    texts: tuple[str, ...] = ("text", "abstract", "summary")
    dates: tuple[str, ...] = ("published_at", "publication_date", "published", "date")
    slices: tuple[str, ...] = ("chronology_slice", "period")
    roles: tuple[str, ...] = ("role", "benchmark_role")
    source_type: str = "document"
    keep_roles: tuple[str, ...] = ()
    cutoff: str | None = None
    need_date: bool = False


@dataclass(frozen=True)
class RunConfig:
    corpus_path: str
    taxonomy_path: str | None = None
    assignments_path: str | None = None
    corpus: CorpusConfig = field(default_factory=CorpusConfig)
    entity_patterns: dict[str, tuple[str, ...]] = field(default_factory=dict)
    cues: dict[str, list[str]] = field(default_factory=dict)
    grounding: str = "one_sided_cue"
    windows: dict[str, int] = field(default_factory=dict)
    shortest_days: int = 30
    longest_days: int = 1095


GROUNDING = ("substring", "one_sided_cue", "two_sided_cue")


def load_config(path: str) -> RunConfig:
    """A run's settings from TOML or JSON; paths are relative to the file; unknown grounding modes are refused (SRC09)."""
    file = Path(path)
    raw = tomllib.loads(file.read_text()) if file.suffix == ".toml" else json.loads(file.read_text())
    near = lambda p: p if p is None or "://" in p else str((file.parent / p).resolve())
    mode = raw.get("grounding", "one_sided_cue")
    if mode not in GROUNDING:
        raise ValueError(f"grounding must be one of {', '.join(GROUNDING)}")
    corpus = CorpusConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.get("corpus", {}).items()})
    return RunConfig(
        near(raw["corpus_path"]), near(raw.get("taxonomy_path")), near(raw.get("assignments_path")), corpus, {k: tuple(v) for k, v in raw.get("entity_patterns", {}).items()},
        {k: list(v) for k, v in raw.get("cues", {}).items()}, mode, dict(raw.get("windows", {})), int(raw.get("shortest_days") or 30), int(raw.get("longest_days") or 1095),
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(row, value VARIANT, file) of a JSON-lines file or folder; blank lines are skipped, a bad line fails with its text (SRC01, SRC02).

    ``row`` numbers the lines within the read order of partitions and is unique, not dense.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    value = F.try_parse_json("value")
    bad = value.isNull() | ~F.col("value").rlike(r"^\s*\{")
    checked = F.when(bad, F.raise_error(F.concat(F.lit("not a JSON object: "), F.input_file_name(), F.lit(": "), F.substring("value", 1, 80))).cast("variant")).otherwise(value)
    return lines.select(F.monotonically_increasing_id().alias("row"), checked.alias("value"), F.input_file_name().alias("file"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`read_lines`, or for ``.json`` the objects of one array (SRC02)."""
    if not path.endswith(".json"):
        return read_lines(spark, path)
    whole = spark.read.text(path, wholetext=True)
    items = whole.select(F.explode(F.from_json("value", "array<variant>")).alias("value"))
    return items.select(F.monotonically_increasing_id().alias("row"), "value", F.lit(path).alias("file"))


def at_paths(value: Column, paths: tuple[str, ...]) -> Column:
    """The first value that isn't blank of dotted paths (JSN01)."""
    return V.first_non_empty(*(F.try_variant_get(value, f"$.{p}", "string") for p in paths)) if paths else F.lit(None).cast("string")


def load_documents(records: DataFrame, config: CorpusConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, reasons) from records (SRC04): mapped columns of rows that pass, and how many rows fell for what."""
    c, v = config or CorpusConfig(), F.col("value")
    texts = F.concat_ws("\n", *(F.when(F.trim(F.try_variant_get(v, f"$.{p}", "string")) != "", T.normalize_space(F.try_variant_get(v, f"$.{p}", "string"))) for p in c.texts))
    day = V.parse_date(at_paths(v, c.dates))
    rows = records.select(
        F.coalesce(at_paths(v, c.ids), F.format_string("doc_%06d", F.col("row") + 1)).alias("doc_id"), T.normalize_space(at_paths(v, c.titles)).alias("title"), texts.alias("text"), day.alias("published_at"),
        V.chronology_slice(at_paths(v, c.slices), day).alias("chronology_slice"), F.coalesce(at_paths(v, c.roles), F.lit("")).alias("role"), F.lit(c.source_type).alias("source_type"),
    )
    rows = rows.withColumn("reason", F.coalesce(skip_reason(F.col("text"), F.col("role"), F.col("published_at"), list(c.keep_roles) or None, c.cutoff, c.need_date), F.lit("loaded")))
    return rows.where("reason = 'loaded'").drop("reason"), rows.groupBy("reason").agg(F.count("*").alias("rows"))


NODE = ty.StructType([ty.StructField(n, ty.StringType()) for n in ("node_id", "dimension", "label", "parent_id", "definition")] + [ty.StructField("aliases", ty.ArrayType(ty.StringType()))])


def load_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Taxonomy nodes from a flat list, JSON lines, nested ``children``, or an object dimension -> root node or list of nodes (SRC05, SRC06, SRC08).

    A taxonomy is a small file that a person maintains; it is read on the driver through Spark. A node without a label goes, its children stay; an id
    that occurs again gets a numbered suffix.
    """
    text = "\n".join(r.value for r in spark.read.text(path).collect())
    try:
        data: Any = json.loads(text)
    except json.JSONDecodeError:
        data = [json.loads(line) for line in text.splitlines() if line.strip()]
    rows: list[tuple] = []
    seen: dict[str, int] = {}

    def add(node: Any, parent: str | None, dimension: str) -> None:
        if not isinstance(node, dict):
            return
        dim = str(node.get("dimension") or dimension)
        label = str(node.get("canonical_label") or node.get("label") or node.get("name") or "").strip()
        if not label:
            # only this row goes
            for child in node.get("children") or []:
                add(child, str(node.get("node_id") or node.get("id") or "") or None, dim)
            return
        own = str(node.get("node_id") or node.get("id") or label.lower().replace(" ", "_"))
        seen[own] = seen.get(own, 0) + 1
        own = own if seen[own] == 1 else f"{own}_{seen[own]:04d}"
        rows.append((own, dim, label, node.get("parent_id") or parent, node.get("definition") or "", [str(a) for a in node.get("aliases") or []]))
        for child in node.get("children") or []:
            add(child, own, dim)

    if isinstance(data, dict) and not isinstance(data.get("nodes"), list) and all(isinstance(x, (list, dict)) for x in data.values()):
        for dim, nodes in data.items():
            for node in nodes if isinstance(nodes, list) else [nodes]:
                add(node, None, dim)
    else:
        for node in data.get("nodes", [data]) if isinstance(data, dict) else data:
            add(node, None, "default")
    return spark.createDataFrame(rows, NODE)


def load_assignments(records: DataFrame) -> DataFrame:
    """(doc_id, node_id) from ``taxonomy_nodes``: an array of ids, or an object dimension -> ids (SRC07)."""
    doc = at_paths(F.col("value"), ("doc_id", "paper_id", "id"))
    lists = F.try_variant_get("value", "$.taxonomy_nodes", "array<string>")
    maps = F.flatten(F.map_values(F.coalesce(F.try_variant_get("value", "$.taxonomy_nodes", "map<string,array<string>>"), F.create_map().cast("map<string,array<string>>"))))
    return records.select(doc.alias("doc_id"), F.explode(T.listify(F.concat(F.coalesce(lists, F.array().cast("array<string>")), maps))).alias("node_id")).distinct()
