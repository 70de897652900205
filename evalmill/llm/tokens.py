"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is named by a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: Default vocabulary file; it must be readable at this path on every executor.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how texts are split before the merges of byte-level vocabularies given as ranks.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters encoded at once, so that one batch of long texts stays small in memory.
CHUNK = 1 << 20


def counter(path: str, pattern: str = PATTERN) -> Callable[[list[str]], list[int]]:
    """Counts the tokens of texts; by its ending the file holds ranks (.tiktoken) or a whole tokenizer (.json)."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(n) for a, n in map(bytes.split, f)}
        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(own.encode_ordinary(t)) for t in texts]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return lambda texts: [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]


def sized(df: DataFrame, text: str, carry: list[str], tokenizer: str = TOKENIZER) -> DataFrame:
    """The carried columns and ``tokens`` (bigint) of each row; NULL and empty texts have 0. Whole texts are encoded."""
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes_of = counter(tokenizer)
        for b in batches:
            sizes: list[int] = []
            group: list[str] = []
            room = CHUNK
            for t in b.column(b.num_columns - 1).to_pylist():
                group.append(t or "")
                room -= len(group[-1])
                if room <= 0:
                    sizes += sizes_of(group)
                    group, room = [], CHUNK
            sizes += sizes_of(group)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array(sizes, pa.int64())], names=[*carry, "tokens"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carry) + ", tokens bigint"
    return spread(df.select(*carry, F.col(text).cast("string").alias("_text"))).mapInArrow(run, schema)
