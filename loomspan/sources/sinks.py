"""Tables to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ty
from pyspark.sql.utils import AnalysisException


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """JSON lines, UTF-8, overwritten (SRC03); sorted by ``order`` over all part files."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, nested values as JSON (SRC16)."""
    nested = (ty.StructType, ty.ArrayType, ty.MapType)
    df.select(*(F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema)).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_artifacts(tables: dict[str, DataFrame], root: str) -> DataFrame:
    """Each table as Parquet below ``root``; the manifest with the rows that were written (SRC21, SRC19)."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        rows.append((name, spark.read.schema(df.schema).parquet(f"{root}/{name}").count()))
    manifest = spark.createDataFrame(rows, "artifact string, rows long")
    manifest.write.mode("overwrite").parquet(f"{root}/manifest")
    return manifest


def read_artifact(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """A table of a run, or an empty one of the schema where the run has none (SRC18)."""
    try:
        return spark.read.parquet(f"{root}/{name}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
