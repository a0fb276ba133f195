"""Token counts by a public byte-pair vocabulary."""

from __future__ import annotations

import base64
import os

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: A vocabulary file that may be sent to every task.
FILE_LIMIT = 64 << 20
_encodings: dict[int, object] = {}


def default_vocabulary() -> tuple[str, str]:
    """Path and splitting pattern of the public vocabulary of this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def bpe_count(spark: SparkSession, text: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """The number of tokens of a text, text that looks like a special token being ordinary text; 0 for null and ''.

    The vocabulary (token in base64 and rank, a line each; at most FILE_LIMIT bytes) is read on the driver and broadcast.
    Merging bytes is nothing that Spark has, so this step is in Python, over Arrow batches. It needs tiktoken.
    """
    if path is None or pattern is None:
        path, pattern = default_vocabulary()
    if os.path.getsize(path) > FILE_LIMIT:
        raise ValueError(f"{path} is larger than {FILE_LIMIT} bytes")
    with open(path, "rb") as file:
        shared = spark.sparkContext.broadcast(file.read())
    split = pattern

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        import tiktoken

        data = shared.value
        encoding = _encodings.get(id(data))
        if encoding is None:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}
            encoding = _encodings[id(data)] = tiktoken.Encoding("own", pat_str=split, mergeable_ranks=ranks, special_tokens={})
        return texts.map(lambda x: len(encoding.encode_ordinary(x)) if x else 0).astype("int64")

    return count(text)
