"""Source files that do not parse."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grammars

SCHEMA = "blob_id bigint, project string, language string, detected string, parses array<string>, broken boolean, verdict string"


def judge(language: str, text: str) -> tuple[str | None, list[str], bool, str]:
    """The likeliest language that the text parses in, all of them in that order, whether it breaks its own, and the verdict."""
    good, failed = [], False
    for g in grammars.rank(text):
        try:
            if grammars.obeys(text, g):
                good.append(g)
        except Exception:  # a fault of the parser must not end the job
            failed = failed or g == language
    if language in good:
        verdict = "valid"
    elif failed:
        verdict = "parser_error"
    else:
        verdict = "wrong_extension" if good and text.strip() else "corrupt"
    return good[0] if good and text.strip() else None, good, language not in good and not failed, verdict


def flag_files(blobs: DataFrame, id_col: str = "blob_id", project: str = "project", path: str = "path", content: str = "content") -> DataFrame:
    """One row per file whose extension tells a supported language, with the grammars that its text obeys.

    Every text is tried against every grammar, the likeliest by its tokens
    first; ``detected`` is the first that it obeys (null for none and for blank
    texts).  ``verdict`` is valid, wrong_extension (it obeys another grammar
    only), corrupt (it obeys none; a blank text says nothing about others) or
    parser_error (the parser itself failed: not broken, but not judged).  Files
    with other extensions, null ids, paths and contents give no rows.  An empty text is valid where
    the grammar allows it (not in Go and JSON).  Texts are parsed whole,
    whatever their length; see ``grammars.obeys`` for nesting.  Copies of a row
    give copies of the result; other columns are ignored, whatever their names.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, who, where, text in zip(f["i"], f["w"], f["p"], f["t"]):
                language = grammars.language_of(where)
                if language is not None:
                    rows.append((i, who, language, *judge(language, text)))
            yield pd.DataFrame(rows, columns=["blob_id", "project", "language", "detected", "parses", "broken", "verdict"])

    slim = blobs.select(F.col(id_col).cast("bigint").alias("i"), F.col(project).alias("w"), F.col(path).alias("p"), F.col(content).alias("t"))
    return slim.filter(F.col("t").isNotNull() & F.col("i").isNotNull() & F.col("p").rlike(r"(?i)\.(" + "|".join(grammars.EXTENSIONS) + ")$")).mapInPandas(run, SCHEMA)


def parse_rates(flagged: DataFrame) -> DataFrame:
    """Files and broken files by project and language; copies of a file count once."""
    files = flagged.groupBy("project", "language", "blob_id").agg(F.max("verdict").alias("verdict"), F.bool_or("broken").alias("broken"))
    return files.groupBy("project", "language").agg(F.count(F.lit(1)).alias("files"), F.count_if("broken").alias("broken"), F.count_if(F.col("verdict") == "wrong_extension").alias("wrong_extension"), F.round(F.avg(F.col("broken").cast("int")), 6).alias("rate"))
