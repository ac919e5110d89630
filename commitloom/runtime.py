"""Session-level helpers shared by all operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of this session.

    The cluster's setting ``spark.checkpoint.dir`` wins.  A folder of our own is
    set only where neither that nor a context checkpoint folder exists and all
    tasks run on this machine; on a cluster that is an error, as executors would
    not find what others wrote.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    wanted = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not wanted and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(wanted or tempfile.mkdtemp(prefix="commitloom-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_round(df: DataFrame) -> DataFrame:
    """``cut`` for the rounds of an iteration.

    Where a small side is broadcast, a round keeps the parts of the other side,
    which is the union of all rounds before: their number would double with each
    round, so it is held at the number of shuffle partitions.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    return cut(df.coalesce(parts))


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table written in the shared checkpoint folder, for what iterations build on.

    A checkpoint keeps the estimated size of its plan.  That of a join is the
    product of its sides, so where a state is joined with itself in many rounds
    the number of its digits doubles with each, and soon takes all the time.  The
    size of written files is the true one.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(taken: Iterable[str], base: str) -> str:
    """A column name built on ``base`` that clashes with none of ``taken``."""
    names = {t.lower() for t in taken}
    name, n = base, 0
    while name.lower() in names:
        n += 1
        name = f"{base}_{n}"
    return name


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns; columns with maps, which cannot be hashed, go in as JSON."""
    return F.xxhash64(*[F.to_json(f.name) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in df.schema.fields])


def current_rows(df: DataFrame, keys: list[str], version: str = "ingested_at", tie: list | None = None) -> DataFrame:
    """The current row of each record of a version log.

    The row with the greatest ``version`` wins; identical copies count once.
    Rows with null keys form one record of their own, a null version is older
    than any other; versions that tie are settled by ``tie`` (columns in
    descending order), then by a hash of the whole row, so that the same rows
    always give the same result.

    ``row_number() = 1`` lets Spark keep one row per key in each map task before
    the shuffle, so a key that holds a large part of all rows costs no more
    than any other.
    """
    rank = fresh(df.columns, "_rank")
    order = [F.col(version).desc_nulls_last(), *[F.col(t).desc_nulls_last() for t in tie or []], row_hash(df)]
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) == 1).drop(rank)


def undeleted(df: DataFrame, tombstone: str = "tombstone") -> DataFrame:
    """Rows that are no tombstones (a null flag means not deleted)."""
    return df.filter(~F.coalesce(F.col(tombstone), F.lit(False)))
