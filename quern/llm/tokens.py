"""Sizes in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: The ranks file of a byte-level BPE, to be found at this place on every executor; and the pattern that goes with it.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_encoders: dict = {}


def encoder(ranks: str = RANKS):
    """The tokenizer, loaded once per worker process."""
    if ranks not in _encoders:
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[ranks] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _encoders[ranks]


def encoded(texts: Iterator[str | None], ranks: str = RANKS) -> Iterator[list[int]]:
    """Token numbers of each text; of null none. Lone surrogates, which no UTF-8 text has, count as a replacement sign."""
    e = encoder(ranks)
    for t in texts:
        yield e.encode_ordinary(t) if t else []


def with_tokens(df: DataFrame, keep: list[str], text: str = "text", ranks: str = RANKS) -> DataFrame:
    """The columns `keep` and n_tokens."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p[keep].assign(n_tokens=[len(x) for x in encoded(p[text], ranks)])

    return df.select(*dict.fromkeys([*keep, text])).mapInPandas(run, fields + ", n_tokens long")
