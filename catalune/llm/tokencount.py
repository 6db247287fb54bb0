"""Token counts: batched encoding that returns lengths only.

Texts are packed into calls of about equal bytes, and long texts are split
where the tokenizer's pre-tokenizer is certain to split as well: before a
space that stands between two characters that are not white space. No added
token contains a space, so such a cut never falls inside one. Counts of the
parts add up to the count of the text.

Null texts count as empty (0 bytes, 0 tokens); an empty table gives an empty
result; repeated rows are counted each; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CALL_BYTES = 1 << 20
PART_CHARS = 1 << 15
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_loaded: dict[str, object] = {}


def split_safely(text: str, size: int = PART_CHARS) -> list[str]:
    """Parts of at least ``size`` characters (but the last), cut at safe places only."""
    if len(text) <= size:
        return [text]
    parts, a = [], 0
    while len(text) - a > size:
        m = _SAFE.search(text, a + size)
        if not m:
            break
        parts.append(text[a : m.start()])
        a = m.start()
    parts.append(text[a:])
    return parts


def _tokenizer(path: str):
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = t
    return _loaded[path]


def lengths(tokenizer, values: list[str | None]) -> list[int]:
    out = np.zeros(len(values), np.int64)
    owners: list[int] = []
    parts: list[str] = []
    held = 0
    encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)

    def flush() -> None:
        for i, e in zip(owners, encode(parts, add_special_tokens=False), strict=True):
            out[i] += len(e)
        owners.clear()
        parts.clear()

    for i, text in enumerate(values):
        if not text:
            continue
        for part in split_safely(text):
            owners.append(i)
            parts.append(part)
            held += len(part.encode())
            if held >= CALL_BYTES:
                flush()
                held = 0
    if parts:
        flush()
    return out.tolist()


def count_tokens(docs: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id", limit: int = 1024) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row's whole text."""
    src = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    src = src.withColumn("n_bytes", F.octet_length("text").cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(tokenizer_path)
        for b in batches:
            n = pa.array(lengths(t, b.column(1).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), n], names=["doc_id", "n_bytes", "n_tokens"])

    kind = src.schema["doc_id"].dataType.simpleString()
    out = src.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
