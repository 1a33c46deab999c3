"""A paginated source of works as a Spark data source: batches and resumable streams of pages (SRC11)."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from loomspan.streaming.windows import resume_into

FORMAT = "work_pages"
SCHEMA = "work_id string, page int, ordinal int, record string"


class Page(InputPartition):
    def __init__(self, number: int, folder: str) -> None:
        super().__init__(number)
        self.number, self.folder = number, folder


def numbered(root: str) -> dict[int, str]:
    """Folders ``page=N`` below ``root`` by number."""
    found = (p for p in Path(root.removeprefix("file:")).glob("page=*") if p.is_dir())
    return {int(p.name.partition("=")[2]): str(p) for p in found}


def works_of(page: Page) -> Iterator[tuple[str, int, int, str]]:
    """The works of a page's files, in order: each file holds one object with ``results``, a list of objects with an ``id``.

    Results without an id are left out, as they can't be told apart; a file that isn't such an object fails with its name.
    """
    ordinal = 0
    for file in sorted(p for p in Path(page.folder).iterdir() if p.name[0] not in "._"):
        try:
            results = json.loads(file.read_text("utf-8"))["results"]
            rows = [(str(r["id"]), r) for r in results if r.get("id") not in (None, "")]
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            raise ValueError(f"{file} is no page of works") from e
        for work, record in rows:
            yield work, page.number, ordinal, json.dumps(record, ensure_ascii=False, sort_keys=True)
            ordinal += 1


class _Batch(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root = root

    def partitions(self) -> list[Page]:
        return [Page(n, folder) for n, folder in sorted(numbered(self.root).items())]

    def read(self, partition: Page | None) -> Iterator[tuple]:
        # Spark asks once, without a partition, where there are none
        return works_of(partition) if partition is not None else iter(())


class _Stream(DataSourceStreamReader):
    """The offset is the number of pages that are there without a gap; so a page that comes late holds back those behind it, and none is passed over."""

    def __init__(self, root: str) -> None:
        self.root = root

    def initialOffset(self) -> dict:
        return {"pages": 0}

    def latestOffset(self) -> dict:
        there = numbered(self.root)
        return {"pages": next(n for n in range(len(there) + 1) if n not in there)}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        there = numbered(self.root)
        return [Page(n, there[n]) for n in range(start["pages"], end["pages"])]

    def read(self, partition: Page) -> Iterator[tuple]:
        return works_of(partition)


class WorkPages(DataSource):
    """``spark.read`` or ``readStream`` with format ``work_pages`` and a ``path`` that all executors share: a task reads a page."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options["path"])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options["path"])


def one_per_work(rows: DataFrame) -> DataFrame:
    """Of a work that several pages hold, as pages shift while they are fetched, the row of the first page."""
    first = F.min_by(F.struct("page", "ordinal", "record"), F.struct("page", "ordinal")).alias("row")
    return rows.groupBy("work_id").agg(first).select("work_id", "row.page", "row.ordinal", "row.record")


def read_works(spark: SparkSession, root: str) -> DataFrame:
    """``work_id, page, ordinal, record`` (JSON) of all pages below ``root``, each work once."""
    spark.dataSource.register(WorkPages)
    return one_per_work(spark.read.format(FORMAT).load(root))


def collect_works(spark: SparkSession, root: str, table: str, checkpoint: str):
    """Start a query that appends the works of new pages to ``table`` and ends (SRC11).

    Pages taken are kept in ``checkpoint``; works that the table has are skipped. So a query that was killed goes on where it was, and gives each work once.
    """
    spark.dataSource.register(WorkPages)
    stream = spark.readStream.format(FORMAT).load(root)
    return resume_into(stream, table, "work_id", checkpoint, lambda df: one_per_work(df).withColumn("status", F.lit("done")))
