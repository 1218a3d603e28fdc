"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Split pattern of the byte-level vocabulary files (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    """The byte-level vocabulary of the installed public tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(texts: list[str], path: str) -> list[int]:
    enc = encoding(path)
    return [len(enc.encode_ordinary(t)) for t in texts]


def with_token_counts(docs: DataFrame, text: str, keep: list[str], *, path: str | None = None) -> DataFrame:
    """The columns ``keep`` and ``n_tokens``, the length of ``text`` in tokens; null texts have none (0).

    ``path`` is a tokenizer's rank file that all executors can read. Only the counts leave the scan, never the texts.
    """
    path = path or default_path()
    src = docs.select(*keep, F.col(text).alias("_text"))
    kept = src.select(*keep).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = count_tokens([t or "" for t in b.column("_text").to_pylist()], path)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    return src.mapInArrow(run, schema)
