"""Tables in and out: partitioned snapshots with an envelope, JSON export, checkpoint and journal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FORMAT = 1


def export_snapshot(spark: SparkSession, tables: dict[str, DataFrame], path: str, parts: dict[str, list[str]] | None = None, part: str = "all") -> None:
    """Write the tables of a part ("all" or a key of parts) as Parquet, then an envelope naming them."""
    names = sorted(tables) if part == "all" else sorted(parts[part])
    for n in names:
        tables[n].write.mode("overwrite").parquet(f"{path}/{n}")
    spark.createDataFrame([(FORMAT, part, names)], "format int, part string, tables array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/envelope")


def import_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Readers of the tables of a snapshot; a snapshot of another format is an error."""
    head = spark.read.schema("format int, part string, tables array<string>").json(f"{path}/envelope").first()
    if head is None or head["format"] != FORMAT:
        raise ValueError(f"no snapshot of format {FORMAT} at {path}")
    return {n: spark.read.parquet(f"{path}/{n}") for n in head["tables"]}


def export_json(tables: dict[str, DataFrame], path: str) -> None:
    for n, t in tables.items():
        t.write.mode("overwrite").json(f"{path}/{n}")


def import_json(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    return {n: spark.read.schema(s).json(f"{path}/{n}") for n, s in schemas.items()}


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(source_path, text) of every text or markdown file below a path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("text"))


def replay(checkpoint: DataFrame, journal: DataFrame, keys: list[str], seq: str = "seq", gone: str = "deleted") -> DataFrame:
    """The checkpoint with a journal of later rows on it: the last row of each key, without deleted ones."""
    rows = checkpoint.withColumns({seq: F.lit(None).cast("long"), gone: F.lit(False)}).unionByName(journal)
    last = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(seq))
    return rows.withColumn("_n", F.row_number().over(last)).filter((F.col("_n") == 1) & ~F.col(gone)).drop("_n", seq, gone)


def clear(tables: dict[str, DataFrame], names: list[str] | None = None) -> dict[str, DataFrame]:
    """The tables with those named (or all) emptied; schemas stay."""
    return {n: t.limit(0) if names is None or n in names else t for n, t in tables.items()}
