"""Sinks: Parquet tables and the three CSV files of a data set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """A table of the corpus, replaced as a whole."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def info_rows(commits: DataFrame) -> DataFrame:
    """``cid, guilt, order`` as text with eight and no decimals."""
    return commits.select("cid", F.format_string("%.8f", F.col("guilt").cast("double")).alias("guilt"), F.format_string("%.0f", F.col("order").cast("double")).alias("order"))


def write_csv(df: DataFrame, path: str, order: str | None = None) -> None:
    """Gzipped CSV with a header; with ``order`` the parts follow it, so that their concatenation is sorted."""
    out = df.repartitionByRange(F.col(order)).sortWithinPartitions(order) if order else df
    out.write.mode("overwrite").option("header", "true").option("quoteAll", "true").option("compression", "gzip").csv(path)


def export_data_set(commits: DataFrame, labels: DataFrame, features: DataFrame, path: str, suffix: str = "") -> None:
    """Info, labels and feature rows of a data set, ordered by commit order."""
    write_csv(info_rows(commits.orderBy("order")), f"{path}{suffix}_info")
    write_csv(labels, f"{path}{suffix}_labels", "order")
    write_csv(features, f"{path}{suffix}_features", "order" if "order" in features.columns else None)
