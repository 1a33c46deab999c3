"""Judge urls by allow and block entries: a trie over reversed host labels and path segments."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import LOWER, UPPER, ascii_lower

ALLOW, BLOCK = "allow", "block"
#: Entries of at most so many bytes of text are sent to the tasks as a trie (some hundred MB there); others are joined.
TRIE_BYTES = 16 << 20
#: An entry counts so many bytes beside its text.
ENTRY_BYTES = 64


class Rule(NamedTuple):
    """An entry fits its host and all subdomains, where the url's path starts with ``path``."""

    verdict: str
    host: str
    path: str


def rule(verdict: str, entry: str) -> Rule:
    """``rule("block", "example.org/es/")``: the host ends before the first slash."""
    host, slash, path = entry.partition("/")
    return checked(Rule(verdict, host.translate(str.maketrans(UPPER, LOWER)), slash + path))


def checked(r: Rule) -> Rule:
    if r.verdict not in (ALLOW, BLOCK):
        raise ValueError(f"a verdict is {ALLOW} or {BLOCK}, not {r.verdict!r}")
    return r


class Trie:
    """Host labels from the last to the first, then path segments; the last, open segment of an entry is kept at its node.

    The longest entry wins: most host labels, then the longest path. Of entries with one host and path the blocking wins.
    """

    def __init__(self, rules: Iterable[Rule]) -> None:
        self.labels: dict[tuple[int, str], int] = {}
        self.segments: dict[tuple[int, str], int] = {}
        self.roots: dict[int, int] = {}  # of the path trie below a host's node
        self.ends: dict[int, dict[str, tuple[str, str]]] = {}  # open segment -> entry and verdict
        self.nodes = 1
        for r in rules:
            node = 0
            for label in reversed(r.host.split(".") if r.host else []):
                node = self._node(self.labels, (node, label))
            node = self._node(self.roots, node)
            *closed, open_end = r.path.split("/")
            for segment in closed:
                node = self._node(self.segments, (node, segment))
            ends = self.ends.setdefault(node, {})
            if r.verdict == BLOCK or open_end not in ends:
                ends[open_end] = (r.host + r.path, r.verdict)
        self.lengths = {node: sorted({len(e) for e in ends}, reverse=True) for node, ends in self.ends.items()}

    def _node(self, table: dict, key: object) -> int:
        if key not in table:
            table[key] = self.nodes
            self.nodes += 1
        return table[key]

    def judge(self, host: str, path: str) -> tuple[str, str] | None:
        """The winning entry and its verdict, None where none fits."""
        node, fitting = 0, [0]
        for label in reversed(host.split(".")) if host else ():
            node = self.labels.get((node, label), -1)
            if node < 0:
                break
            fitting.append(node)
        parts = path.split("/") if any(n in self.roots for n in fitting) else ()
        for node in reversed(fitting):
            at, found = self.roots.get(node, -1), None
            for part in parts:
                if at < 0:
                    break
                for n in self.lengths.get(at, ()):
                    if part[:n] in self.ends[at]:
                        found = self.ends[at][part[:n]]
                        break
                at = self.segments.get((at, part), -1)
            if found:
                return found
        return None


def host_of(url: Column) -> Column:
    """What stands behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What stands behind the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: Iterable[Rule] | DataFrame, default: str = ALLOW, url: str = "url", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """The columns of ``pages`` with ``host, path, rule, verdict`` (in place of columns of these names).

    A null url, or one without ``://``, has an empty host and path; where no entry fits, ``rule`` is null and
    ``default`` is the verdict. Rows that repeat fare alike, an empty table stays empty, and without entries each row has the
    default. ``rules`` is a list or a table ``verdict, host, path`` (a null path is empty, an entry without host is left out).
    Entries of at most ``trie_bytes`` are broadcast as a trie, which moves no page; a larger table is joined
    (:func:`judge_by_join`), with the same rows.
    """
    spark = pages.sparkSession
    if isinstance(rules, DataFrame):
        table = rules.select("verdict", "host", F.coalesce("path", F.lit("")).alias("path")).where("host is not null").distinct()
        size = table.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + ENTRY_BYTES), F.lit(0))).first()[0]
        if size > trie_bytes:
            return judge_by_join(pages, table, default, url)
        rules = [checked(Rule(*r)) for r in table.collect()]
    else:
        rules = [checked(r) for r in rules]
        if sum(len((r.host + r.path).encode()) + ENTRY_BYTES for r in rules) > trie_bytes:
            return judge_by_join(pages, spark.createDataFrame(rules, "verdict string, host string, path string").distinct(), default, url)
    trie = spark.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def walked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        find = trie.value.judge
        for hosts, paths in batches:
            found = [find(h, p) or (None, default) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame(found, columns=["rule", "verdict"], dtype=object)

    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = pages.select(*own, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    return rows.withColumn("__found", walked("host", "path")).select(*own, "host", "path", "__found.rule", "__found.verdict")


def judge_by_join(pages: DataFrame, rules: DataFrame, default: str, url: str = "url") -> DataFrame:
    """As :func:`judge`, for entries of any number: a url's hosts meet the lengths of the paths that their entries have, its prefixes of these lengths meet the entries.

    So a url meets as many rows as there are lengths below its hosts, however many entries a host has. Urls are
    distinct before that, and the verdicts are joined to the pages.
    """
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = pages.select(*own, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    entries = rules.select(F.col("host").alias("at"), F.col("path").alias("start"), "verdict")
    # of entries with one host and path the blocking wins
    entries = entries.groupBy("at", "start").agg(F.max("verdict").alias("verdict"))
    lengths = entries.select("at", F.length("start").alias("n")).distinct()
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    urls = rows.select("host", "path").distinct().select("host", "path", F.explode(F.array_distinct(F.concat(above, F.array(F.lit(""))))).alias("at"))
    tried = urls.join(lengths, "at").where(F.col("n") <= F.length("path")).select("host", "path", "at", F.expr("substring(path, 1, n)").alias("start"))
    labels_in = F.when(F.col("at") == "", 0).otherwise(F.size(F.split("at", r"\.")))
    met = tried.join(entries, ["at", "start"]).groupBy("host", "path").agg(F.max_by(F.struct(F.concat("at", "start").alias("rule"), "verdict"), F.struct(labels_in, F.length("start"))).alias("found"))
    return rows.join(met, ["host", "path"], "left").select(*own, "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.lit(default)).alias("verdict"))


def allowed(pages: DataFrame, rules: Iterable[Rule] | DataFrame, default: str = ALLOW, url: str = "url") -> DataFrame:
    """The rows of ``pages`` that aren't blocked, with their own columns; a url that :func:`judge` finds no entry for has the default's fate."""
    marked = pages.select(F.struct("*").alias("page"), F.col(url).alias("url"))
    return judge(marked, rules, default).where(F.col("verdict") == ALLOW).select("page.*")

