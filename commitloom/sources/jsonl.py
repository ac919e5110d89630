"""JSON lines: keyed rows, tombstones, any gzip name."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line``: the lines of plain or gzipped files, by content and not by name.

    Files are read one per task; a plain or ``.gz`` name is left to Spark's own
    splitting reader.
    """
    if not path.endswith("z") or path.endswith(".gz"):
        return spark.read.text(path).select(F.col("value").alias("line"))

    def unzip(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                yield pd.DataFrame({"line": [x for x in raw.decode("utf-8", "replace").split("\n") if x]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unzip, "line string")


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a declared schema with ``json_key``; tombstones, blank and broken lines are left out."""
    parsed = read_lines(spark, path).filter("trim(line) <> ''").select(F.from_json("line", f"{schema}, json_key string, json_tombstone boolean, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("r.*")
    return parsed.filter("_corrupt_record is null and not coalesce(json_tombstone, false)").drop("_corrupt_record", "json_tombstone")


def parse_records(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """As :func:`read_records`, from a column of lines."""
    parsed = lines.select(F.from_json(column, f"{schema}, json_key string, json_tombstone boolean, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("r.*")
    return parsed.filter("_corrupt_record is null and not coalesce(json_tombstone, false)").drop("_corrupt_record", "json_tombstone")


def write_records(df: DataFrame, path: str, key: str | None = None, compressed: bool = True) -> None:
    """One JSON record per line; ``key`` is repeated as ``json_key``, and rows whose other columns are all null become tombstones."""
    out = df
    if key:
        rest = [c for c in df.columns if c != key]
        empty = F.lit(True)
        for c in rest:
            empty = empty & F.col(c).isNull()
        out = df.withColumn("json_key", F.col(key).cast("string")).withColumn("json_tombstone", F.when(empty, F.lit(True)))
    out.write.mode("overwrite").option("compression", "gzip" if compressed else "none").json(path)
