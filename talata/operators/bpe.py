"""Byte-pair encoding and decoding with the merges of a vocabulary file, in Arrow batches.

The file is one that the ``tokenizers`` library reads; its path, the same on every executor, is a
parameter. Each worker loads it once. Spark has no such expression, and the library is native code.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

IDS = T.ArrayType(T.IntegerType())
_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a file, with the strings of special tokens read as ordinary text."""
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.encode_special_tokens = True
        _loaded[path] = made
    return _loaded[path]


def encoder(path: str):
    """A column function text -> ids; null for null, empty for an empty text."""

    @F.pandas_udf(IDS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = tokenizer(path).encode
        for texts in batches:
            yield pd.Series([None if t is None else encode(t, add_special_tokens=False).ids for t in texts])

    return run


def decoder(path: str):
    """A column function ids -> text; null for null. Bytes that are no UTF-8 come as replacement characters."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decode = tokenizer(path).decode
        for ids in batches:
            yield pd.Series([None if x is None else decode([int(i) for i in x], skip_special_tokens=False) for x in ids])

    return run
