"""Token counts with a public byte-level BPE vocabulary; its file is a parameter and is read where the tokens are made."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import tiktoken
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the vocabulary's word pattern.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(4)
def encoding(vocabulary: str = VOCABULARY) -> tiktoken.Encoding:
    with open(vocabulary, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """df with text_col replaced by `tokens`, its number of tokens; null and empty texts have none."""
    kept = [c for c in df.columns if c != text_col]
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes if n != text_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(vocabulary)
        for b in batches:
            yield b[kept].assign(tokens=[len(enc.encode_ordinary(t)) if t else 0 for t in b[text_col]])

    return df.mapInPandas(run, f"{schema}, tokens long")
