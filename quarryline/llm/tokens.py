"""Sizes of texts in tokens of a public byte-level BPE tokenizer.

A byte-level BPE merges within the pieces its pattern cuts a text into, and no piece holds a space between two other
characters except as its first one. So a text is cut at such spaces and its size is the sum of its parts' sizes. Parts
repeat a lot: their sizes are kept in a bounded table per task. Null and empty texts have no tokens.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The tokenizer's published pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CUT = re.compile(r"(?<=\S) (?=\S)")
BESIDE_SPACE = re.compile(r" \s|\s ")
CACHE = 400_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Counter(dict):
    """Size of a part that follows a space, found once."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, part: str) -> int:
        n = len(self.encode(" " + part))
        if len(part) <= 48:
            self[part] = n
        return n

    def size(self, text: str | None) -> int:
        if not text:
            return 0
        if len(self) > CACHE:
            self.clear()
        parts = CUT.split(text) if text[0] == " " or text[-1] == " " or BESIDE_SPACE.search(text) else text.split(" ")
        return len(self.encode(parts[0])) + sum(map(self.__getitem__, parts[1:]))


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One per worker process."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    c = counter(path)
    for batch in batches:
        sizes = pa.array([c.size(t) for t in batch.column("text").to_pylist()], pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), sizes], names=["doc_id", "source", "n_tokens"])


def source_name(c):
    """One name for the spellings of a source: trimmed, lower case, `_` for `-` and blanks; blank is null."""
    own = F.regexp_replace(F.lower(F.trim(c)), "[-\\s]+", "_")
    return F.when(own != "", own)


def token_counts(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, source (one spelling) and n_tokens of every document."""
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), source_name(F.col("source")).alias("source"), "text")
    return own.mapInArrow(partial(_count, path=tokenizer or default_tokenizer()), "doc_id long, source string, n_tokens int")
