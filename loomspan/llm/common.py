"""Small helpers that several operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of bytes other than blank, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Folders of the tables that :func:`written` made inside a :func:`scratch`, innermost last.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("_OPEN", default=())


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below the checkpoint folder that all executors share.

    ``spark.checkpoint.dir`` names it on a cluster; where it is missing there, this raises. Only a local
    master, whose executors share this machine's disk, gets a temporary folder of its own.
    """
    context = spark.sparkContext
    root = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        root = context.getCheckpointDir()
    return f"{root.rstrip('/')}/loomspan-{uuid.uuid4().hex}"


def written(df: DataFrame, keep: bool = False, **options: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives lost executors.

    Inside a :func:`scratch` it is deleted at its end, unless ``keep`` is set.
    """
    path = shared_folder(df.sparkSession)
    if _OPEN.get() and not keep:
        _OPEN.get()[-1].append(path)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end; what is still read after it must be written with ``keep``."""
    own: list[str] = []
    token = _OPEN.set((*_OPEN.get(), own))
    try:
        yield
    finally:
        _OPEN.reset(token)
        for path in own:
            _delete(spark, path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written` that nothing reads any more; another table is left alone."""
    for file in df.inputFiles()[:1]:
        folder = file.rpartition("/")[0]
        if folder.rpartition("/")[2].startswith("loomspan-"):
            _delete(df.sparkSession, folder)


def whole_text(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. ``lower`` does just that, and faster, where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def running(df: DataFrame, group: list[str], bucket: str, order: list, sums: dict[str, str]) -> DataFrame:
    """Exclusive prefix sums over ``group`` in the order (``bucket``, ``order``), without a whole group in one task.

    ``sums`` maps a new column to the non-negative column that it sums. A window runs inside each
    (group, bucket); the totals of the buckets, a few numbers each, are summed before it. No column of
    ``group`` and ``bucket`` may be null.
    """
    keys = [*group, bucket]
    totals = df.groupBy(*keys).agg(*(F.sum(c).alias(f"__{n}") for n, c in sums.items()))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, *(F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(n) for n, c in sums.items()))
    return local.join(totals, keys).select(*df.columns, *((F.col(n) + F.col(f"__{n}")).alias(n) for n in sums))
