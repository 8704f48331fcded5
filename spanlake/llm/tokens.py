"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import objects

#: Rank file of the default tokenizer (a byte-level BPE), found beside the installed vocabulary files.
DEFAULT = "byte_bpe_50k.tiktoken"


def vocabulary_path(name: str = DEFAULT) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoding(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, id_cols: list[str], text_col: str, path: str | None = None) -> DataFrame:
    """id_cols with tokens int: of every text that isn't null, empty ones have 0. path: a tiktoken rank file that all executors can read."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(path).encode_ordinary
        for b in batches:
            n = [len(encode(t)) for t in b["text__"]]
            yield objects(b.drop(columns="text__").assign(tokens=pd.Series(n, index=b.index, dtype="int32")))

    texts = docs.where(F.col(text_col).isNotNull()).select(*id_cols, F.col(text_col).alias("text__"))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in id_cols)
    return texts.mapInPandas(run, f"{kinds}, tokens int")
