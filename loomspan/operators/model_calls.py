"""Calls of a language model as table-in, table-out operators; without a client, deterministic fallbacks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECORD = "task string, cache_key string, output string, error string, json_repaired boolean, attempts int"


class Client(Protocol):
    """What a model client offers (UDF01). It must be picklable; each task makes its own connection."""

    def complete(self, task: str, prompt: str) -> str: ...


class Deterministic:
    """Answers each prompt with its fallback (UDF01)."""

    def complete(self, task: str, prompt: str) -> str:
        raise LookupError("no model")


def filled(template: str, values: dict[str, str]) -> str:
    """A template with ``{name}`` replaced for declared names only; other braces stay (UDF05)."""
    return re.sub(r"\{(\w+)\}", lambda m: values.get(m.group(1), m.group(0)), template)


def prompt_column(template: str, columns: list[str]):
    """The same over columns (UDF05): declared columns are replaced one after the other, inside the JVM."""
    out = F.lit(template)
    for c in columns:
        out = F.replace(out, F.lit("{" + c + "}"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return out


def parsed(text: str) -> tuple[dict | None, bool]:
    """(object, repaired) from a model's answer (JSN02): as it is, else the outermost braces without fences and trailing commas."""
    try:
        value = json.loads(text)
        return (value, False) if isinstance(value, dict) else (None, False)
    except (json.JSONDecodeError, TypeError):
        pass
    inner = re.search(r"\{.*\}", text or "", re.DOTALL)
    if inner:
        try:
            value = json.loads(re.sub(r",\s*([}\]])", r"\1", inner.group()))
            return value, True
        except json.JSONDecodeError:
            pass
    return None, False


def call(requests: DataFrame, client: Client, cache: DataFrame | None = None, required: tuple[str, ...] = (), tries: int = 2) -> DataFrame:
    """Answer each row (task, prompt, fallback) of ``requests`` (UDF02): :data:`RECORD`.

    The key is a digest of task and prompt (JSN03). Known keys come from ``cache`` by a join before any call is made, equal
    requests are asked once. An answer that isn't a JSON object with the required fields is asked for again, then
    the fallback stands, with the error.
    """
    keyed = requests.withColumn("cache_key", F.sha2(F.to_json(F.struct("task", "prompt")), 256)).groupBy("cache_key").agg(F.first("task").alias("task"), F.first("prompt").alias("prompt"), F.first("fallback").alias("fallback"))
    new = keyed if cache is None else keyed.join(cache.select("cache_key"), "cache_key", "left_anti")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, task, prompt, fallback in zip(b["cache_key"], b["task"], b["prompt"], b["fallback"]):
                answer, repaired, error, attempt = None, False, "", 0
                for attempt in range(1, tries + 1):
                    try:
                        answer, repaired = parsed(client.complete(task, prompt))
                        missing = [f for f in required if answer is None or f not in answer]
                        error = f"missing {', '.join(missing)}" if missing else "" if answer is not None else "not a JSON object"
                    except Exception as e:  # a client may fail in any way; the record says how
                        error = f"{type(e).__name__}: {e}"
                    if not error:
                        break
                rows.append((task, key, fallback if error else json.dumps(answer, sort_keys=True), error, repaired and not error, attempt))
            yield pd.DataFrame(rows, columns=["task", "cache_key", "output", "error", "json_repaired", "attempts"])

    made = new.select("cache_key", "task", "prompt", "fallback").mapInPandas(ask, RECORD)
    if cache is None:
        return made
    return made.unionByName(cache.join(keyed.select("cache_key"), "cache_key", "left_semi").select(*made.columns))


def screening(docs: DataFrame, client: Client) -> DataFrame:
    """Relevance decisions of documents (UDF04): ``doc_id, decision, score``; scores are bounded, other decisions are ``exclude``."""
    requests = docs.select("doc_id", F.lit("screening").alias("task"), prompt_column("Is this relevant?\n{text}", ["text"]).alias("prompt"), F.lit('{"decision": "peripheral", "score": 0.5}').alias("fallback"))
    out = call(requests, client)
    keys = requests.withColumn("cache_key", F.sha2(F.to_json(F.struct("task", "prompt")), 256)).select("doc_id", "cache_key")
    v = F.try_parse_json("output")
    decision = F.try_variant_get(v, "$.decision", "string")
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_variant_get(v, "$.score", "double"), F.lit(0.0))))
    return keys.join(out, "cache_key").select("doc_id", F.when(decision.isin("core", "peripheral"), decision).otherwise("exclude").alias("decision"), bounded.alias("score"))


def quoted_mentions(answers: DataFrame, docs: DataFrame) -> DataFrame:
    """Mentions from answers ``{"entities": [{"name", "quote"}]}`` whose quote is in the document (UDF06)."""
    from loomspan.functions.text import quote_verified

    items = answers.select("doc_id", F.explode(F.from_json("output", "struct<entities: array<struct<name: string, quote: string>>>")["entities"]).alias("e"))
    return items.join(docs.select("doc_id", "text"), "doc_id").where(quote_verified(F.col("e.quote"), F.col("text"))).select("doc_id", F.col("e.name").alias("name"), F.col("e.quote").alias("quote"))
