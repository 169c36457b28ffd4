"""Sizes of texts in tokens of a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the tokenizer's pre-tokenisation pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where a cut before a space would part a run of white space that the pattern takes whole.
_UNSAFE = re.compile(r"\s (?:\s|\Z)")
#: Words remembered per worker; then the memory starts anew.
_REMEMBERED = 300_000


@cache
def encoding(path: str):
    """The tokenizer of a ranks file, loaded once per process."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class _Words(dict):
    """Tokens of a word with the space before it, by the word; counted when first asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> int:
        n = len(self.encode(" " + word))
        if len(word) <= 200:
            self[word] = n
        return n


class Counter:
    """Number of tokens of a text.

    No token spans the border between a word and the space before the next one, so a text is counted word
    by word, and words seen before cost one look-up.  Texts where that isn't so are encoded whole.
    """

    def __init__(self, path: str):
        self._encode = encoding(path).encode_ordinary
        self._words = _Words(self._encode)

    def __call__(self, text: str) -> int:
        if _UNSAFE.search(text):
            return len(self._encode(text))
        if len(self._words) > _REMEMBERED:
            self._words.clear()
        first, *rest = text.split(" ")
        return len(self._encode(first)) + sum(map(self._words.__getitem__, rest))


def token_sizes(df: DataFrame, text: str, tokenizer: str = TOKENIZER, size: str = "n_tokens") -> DataFrame:
    """df without the text column, with its size in tokens. NULL and empty texts have 0. Nothing is shuffled."""
    others = [c for c in df.columns if c != text]
    if size in others:
        raise ValueError(f"column {size} exists already")
    schema = df.drop(text).withColumn(size, F.lit(0).cast("bigint")).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer)
        for b in batches:
            at = b.schema.get_field_index("__text")
            sizes = [counter(t) if t else 0 for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(b.num_columns) if i != at], pa.array(sizes, pa.int64())], names=[*others, size])

    return df.select(*[f"`{c}`" for c in others], F.col(f"`{text}`").alias("__text")).mapInArrow(count, schema)
