"""Libraries, results and run summaries in files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .storage import numbered, written

UNLABELLED = -1


def file_names(spark: SparkSession, path: str, pattern: str = "*.parquet") -> list[str]:
    """Files of a folder, by name, from the file system's own listing."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{pattern}")
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return sorted(x.getPath().toString() for x in found or [])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A result table, Parquet or CSV with a header, by its ending."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)


def shard_of(spec: str) -> tuple[int, int]:
    """`i/N`, from 0, as two numbers."""
    try:
        i, n = map(int, spec.split("/"))
    except ValueError:
        raise ValueError(f"not a shard: {spec!r}") from None
    if not 0 <= i < n:
        raise ValueError(f"not a shard: {spec!r}")
    return i, n


def compact(value: float | None, digits: int = 2) -> str:
    """A number as reports show it: whole ones with separators, very large and small ones in powers of ten."""
    if value is None or value != value:
        return "-"
    if abs(value) == float("inf"):
        return "inf" if value > 0 else "-inf"
    if float(value).is_integer() and abs(value) < 1e15:
        return f"{int(value):,}"
    return f"{value:.{digits}e}" if value and not 1e-3 <= abs(value) < 1e6 else f"{value:,.{digits}f}"


def read_library(spark: SparkSession, path: str, pattern: str = "*.parquet", first_files: int | None = None, shard: str | None = None) -> DataFrame:
    """compound, text, activity (null where the library has none) and stratum: the file's stem, or stratum_piece in a folder that write_pieces made."""
    names = file_names(spark, path, pattern)[:first_files]
    if shard:
        i, n = shard_of(shard)
        names = names[i::n]
    if not names:
        raise FileNotFoundError(f"no file {pattern} in {path}")
    df = spark.read.option("basePath", path).option("mergeSchema", "true").parquet(*names)
    activity = F.col("activity").cast("tinyint") if "activity" in df.columns else F.lit(None).cast("tinyint")
    stem, dealt = F.regexp_replace(F.col("_metadata.file_name"), r"\.parquet$", ""), r"/stratum=([^/]*)/piece=(\d+)/[^/]*$"
    place = F.col("_metadata.file_path")
    stem = F.when(place.rlike(dealt), F.concat_ws("_", F.regexp_extract(place, dealt, 1), F.regexp_extract(place, dealt, 2))).otherwise(stem)
    return df.select(F.col("CompoundIndex").cast("string").alias("compound"), F.col("Smiles").alias("text"), activity.alias("activity"), stem.alias("stratum"))


def stored_activity(df: DataFrame) -> DataFrame:
    """activity as it is stored: -1 for unlabelled."""
    return df.withColumn("activity", F.coalesce("activity", F.lit(UNLABELLED)).cast("tinyint"))


def write_strata(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per stratum; with mode append only strata that are not marked as whole yet, which replace what is there of them.

    Strata are marked, with their rows, in a table beside path once all their files are in place.
    """
    spark, marks = df.sparkSession, f"{path.rstrip('/')}.done"
    df = df.withColumn("stratum", F.col("stratum").cast("string"))
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(marks).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(marks)
    if mode == "append" and fs.exists(where):
        df = df.join(spark.read.parquet(marks).select("stratum").distinct(), "stratum", "left_anti")
    elif mode != "append":
        fs.delete(where, True)
    new = written(df, "strata")  # written and marked alike
    if new.isEmpty() and fs.exists(where):
        return
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if mode == "append" else "static").partitionBy("stratum").option("compression", "zstd").parquet(path)
    new.groupBy("stratum").agg(F.count("*").alias("n_rows")).write.mode("append").parquet(marks)


def write_top(df: DataFrame, path: str, n: int, order: list) -> None:
    df.orderBy(*order).limit(n).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_gated(df: DataFrame, path: str, most: int = 5_000_000) -> bool:
    """Parquet always, CSV beside it for tables of at most `most` rows."""
    df.write.mode("overwrite").parquet(f"{path}.parquet")
    small = df.sparkSession.read.parquet(f"{path}.parquet").limit(most + 1).count() <= most
    if small:
        df.sparkSession.read.parquet(f"{path}.parquet").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}.csv")
    return small


def write_summary(spark: SparkSession, path: str, values: dict) -> None:
    """Totals and settings as one JSON document of sorted keys."""
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_summary(spark: SparkSession, path: str) -> dict:
    rows = spark.read.text(path, wholetext=True).collect()
    if not rows:
        raise FileNotFoundError(path)
    return json.loads(rows[0].value)


def even_pieces(df: DataFrame, rows: int, key: list[str], by: str = "stratum") -> DataFrame:
    """Adds piece: every stratum in as few pieces of at most `rows` rows as possible, sizes even."""
    df = written(df, "pieces")  # counted, then numbered
    sizes = df.groupBy(by).agg(F.count("*").alias("__n")).withColumn("__first", F.sum("__n").over(W.orderBy(by)) - F.col("__n"))  # strata
    n = F.col("__n")
    size = F.ceil(n / F.ceil(n / F.lit(rows)))
    cut = numbered(df, [F.col(by), *map(F.col, key)], "__k").join(F.broadcast(sizes), by)
    return cut.withColumn("piece", F.floor((F.col("__k") - F.col("__first")) / size).cast("long")).drop("__k", "__n", "__first")


def write_pieces(library: DataFrame, path: str, rows: int) -> None:
    """A library dealt out in even pieces, a file each, under the column names that read_library takes."""
    cut = even_pieces(library, rows, ["compound", "text"]).select(F.col("compound").alias("CompoundIndex"), F.col("text").alias("Smiles"), "activity", "stratum", "piece")
    cut.repartition("stratum", "piece").write.mode("overwrite").partitionBy("stratum", "piece").option("compression", "zstd").parquet(path)


def failed(df: DataFrame, result: str) -> tuple[DataFrame, DataFrame]:
    """Rows that were made, and the side output of those that could not be."""
    return df.filter(F.col(result).isNotNull()), df.filter(F.col(result).isNull())
