"""Token counts by a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary of the tokenizer lies, on every machine.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the published pattern that parts text before byte-pair merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Characters after which a long text is parted for one call, where the pattern parts it anyway.
PIECE = 200_000
_PARTS = re.compile(r"(?<=\S)(?=\s)")

_LOADED: dict[str, object] = {}


def encoding(path: str):
    """The tokenizer of a vocabulary file, loaded once per worker."""
    if path not in _LOADED:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
        _LOADED[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def pieces(text: str) -> list[str]:
    """The text in parts that have as many tokens as the whole.

    It is cut between a character and the blank that follows it: no token of the
    pattern goes on over that place, and none looks back over it.  What has no
    such place stays one part, however long.
    """
    out, at = [], 0
    while len(text) - at > PIECE:
        stop = at + PIECE
        while stop > at and not (text[stop].isspace() and not text[stop - 1].isspace()):
            stop -= 1
        if stop == at:
            m = _PARTS.search(text, at + PIECE)
            if not m:
                break
            stop = m.start()
        out.append(text[at:stop])
        at = stop
    return [*out, text[at:]]


def count_tokens(documents: DataFrame, keep: list[str], text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` of the whole text; 0 for null and empty texts."""
    fields = [f for f in documents.select(*keep).schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_tokens bigint"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(path)
        for f in frames:
            counts = [sum(len(enc.encode_ordinary(p)) for p in pieces(t)) if isinstance(t, str) else 0 for t in f["_text"]]
            yield f.drop(columns="_text").assign(n_tokens=counts)

    return documents.select(*keep, F.col(text_col).alias("_text")).mapInPandas(run, schema)
