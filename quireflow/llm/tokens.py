"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where the vocabulary files of the public tokenizers are, and the one used.
TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k.tiktoken"
_LOADED: dict[str, object] = {}


def encoder(path: str):
    """The byte-level BPE of a .tiktoken file, loaded once a process."""
    if path not in _LOADED:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def token_count(text: Column, path: str = f"{TOKENIZER_DIR}/{TOKENIZER}") -> Column:
    """Number of tokens (bigint) of a text; 0 for null and empty texts."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path)
        for b in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in b], dtype="int64")

    return count(text)
