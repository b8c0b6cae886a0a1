"""Token counts with a public byte-level BPE vocabulary that is read from a path, never copied."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

#: A rank file (token in base 64 and rank per line), on every executor or on a shared mount.
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how such vocabularies split text before their merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def encoding(ranks: str = RANKS, pattern: str = PATTERN):
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def count_tokens(text: str | None, ranks: str = RANKS, pattern: str = PATTERN) -> int:
    """Tokens of the whole text, special tokens' strings being ordinary text; 0 for null."""
    if not text:
        return 0
    try:
        return len(encoding(ranks, pattern).encode_ordinary(text))
    except UnicodeEncodeError:  # lone surrogates
        return len(encoding(ranks, pattern).encode_ordinary(text.encode("utf-8", "replace").decode("utf-8")))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows: as Python strings, long texts take several times their size."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def with_tokens(df: DataFrame, keys: list[tuple[str, Column]], text: str = "text", ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """The named ``keys`` and ``tokens`` (long) of every row. Narrow: no shuffle."""
    picked = df.select(*(c.alias(k) for k, c in keys), df[text].alias("__text"))
    names, n = [k for k, _ in keys], len(keys)
    schema = T.StructType([*(picked.schema[k] for k in names), T.StructField("tokens", T.LongType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts = [count_tokens(t, ranks, pattern) for t in batch.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), pa.array(counts, pa.int64())], names=[*names, "tokens"])

    return picked.mapInArrow(rows, schema)
