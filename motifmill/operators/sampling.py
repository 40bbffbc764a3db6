"""Samples that are the same every time: rows of smallest hash, whole classes kept where the sample says so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def md5_key(*columns: str) -> Column:
    """A hash any SQL engine can make, then the columns themselves."""
    text = F.concat_ws("/", *[F.col(c).cast("string") for c in columns])
    return F.struct(F.md5(text.cast("binary")), *columns)


def two_stage(rows: DataFrame, file: str, n_files: int, per_file: int, key: Column) -> DataFrame:
    """At most `per_file` rows of each of `n_files` files."""
    files = rows.select(file).distinct().orderBy(md5_key(file)).limit(n_files)  # n_files names
    return head(rows.join(F.broadcast(files), file, "left_semi"), [file], per_file, key)


def by_band(rows: DataFrame, value: str, bounds: list[int], per_band: int, key: Column) -> DataFrame:
    """At most `per_band` rows of each half-open band of a value; what lies outside the bounds is no band's."""
    band = F.lit(None).cast("int")
    for i, (low, high) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        band = F.when((F.col(value) >= low) & (F.col(value) < high), F.lit(i)).otherwise(band)
    return head(rows.withColumn("band", band).filter("band is not null"), ["band"], per_band, key)


def positives_and_some(rows: DataFrame, positive: Column, by: str, per_group: int, key: Column) -> DataFrame:
    """Every positive row, and of each group at most `per_group` others."""
    others = head(rows.filter(~positive), [by], per_group, key)
    return rows.filter(positive).unionByName(others)


def head(rows: DataFrame, by: list[str], n: int, key: Column) -> DataFrame:
    """The n first rows of each group; each task passes on n of a group at most."""
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(*by).orderBy(key))).filter(F.col("__r") <= n).drop("__r")
