"""Token counts by a public tokenizer (byte-level BPE ranks for tiktoken).

The vocabulary file's path is a parameter; its content (a megabyte) is sent to the executors, which
need no copy of the file.  A special token's spelling in a text is ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The pre-tokenizer pattern published with byte-level BPE vocabularies of this family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoding: dict[int, object] = {}


def encoding(data: bytes):
    """The tokenizer of a vocabulary, built once per process."""
    import tiktoken

    if (key := hash(data)) not in _encoding:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        _encoding[key] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoding[key]


def count_tokens(spark: SparkSession, df: DataFrame, text: str = "text", out: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with ``text`` replaced by its number of tokens; null counts 0.

    Whole texts are encoded.  A column named as ``out`` is replaced.
    """
    with open(vocabulary, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())
    rest = [c for c in df.columns if c not in (text, out)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoding(data.value)
        for b in batches:
            n = [len(e.encode_ordinary(t)) if t else 0 for t in b.column(text).to_pylist()]
            yield pa.record_batch([*[b.column(c) for c in rest], pa.array(n, pa.int64())], names=[*rest, out])

    kinds = dict(df.dtypes)
    return df.mapInArrow(count, ", ".join([*[f"`{c}` {kinds[c]}" for c in rest], f"`{out}` bigint"]))
