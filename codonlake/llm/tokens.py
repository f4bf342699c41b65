"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


@lru_cache(4)
def encoding(path: str):
    """The encoding whose ranks are in ``path``; loaded once in a worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(df: DataFrame, text: str, keep: list[str], path: str = TOKENIZER, out: str = "n_tokens") -> DataFrame:
    """The columns ``keep`` and the number of tokens of ``text``; rows with a null text are left out."""
    rows = df.where(df[text].isNotNull()).select(*keep, df[text].alias("__text"))
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField(out, T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for b in batches:
            sizes = [len(encode(x)) for x in b.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(sizes, pa.int32())], [*keep, out])

    return rows.mapInArrow(run, schema)
