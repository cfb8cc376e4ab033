"""Token counts: batch encoding in Arrow functions that return lengths only.

Every task keeps one tokenizer. Texts are cut into pieces at places where the pre-tokenizer always
starts anew, packed into batches of about equal bytes, encoded batch by batch, and summed per row, so
memory depends on the batch size and not on the longest text.

Nulls count as empty (0 bytes, 0 tokens). Repeated rows, and rows that repeat an id with another text, are
counted each on their own; a null id stays null. A text without a safe place, such as one without spaces, is
encoded whole. An empty table gives an empty result, and columns besides the id and the text are ignored,
whatever their names.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

#: Before a single space between two ASCII letters: the letters end one pre-token, the space starts the next.
SAFE = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return lambda texts: [len(x) for x in t.encode_batch_fast(texts, add_special_tokens=False)]


def splittable(path: str) -> bool:
    """Whether texts may be cut before a space between ASCII letters: a .json tokenizer that only splits at bytes, adds no
    space in front, normalizes nothing and has no added token with a space inside."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    pre = t.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space", True) and pre.get("use_regex", True)
    return bool(plain and not t.get("normalizer") and all(" " not in x["content"].strip() for x in t.get("added_tokens", [])))


def pieces(text: str, limit: int) -> Iterator[str]:
    """Cut a text into pieces of about `limit` characters at safe places; a stretch without one stays whole."""
    start = 0
    while len(text) - start > limit:
        cut = SAFE.search(text, start + limit)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def packed(texts: Iterable[str | None], batch_bytes: int, splits: bool) -> Iterator[tuple[list[int], list[str]]]:
    """Batches of (row numbers, pieces) with about batch_bytes each."""
    rows: list[int] = []
    parts: list[str] = []
    size = 0
    for i, text in enumerate(texts):
        for part in pieces(text, batch_bytes // 4) if text and splits else [text or ""]:
            n_bytes = len(part) if part.isascii() else len(part.encode())
            if size and size + n_bytes > batch_bytes:
                yield rows, parts
                rows, parts, size = [], [], 0
            rows.append(i)
            parts.append(part)
            size += n_bytes
    if rows:
        yield rows, parts


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, batch_bytes: int = 1 << 20) -> DataFrame:
    """Rows (id, n_bytes, n_tokens, over_limit). tokenizer: path of a .json or .model file, present on every executor.

    Only byte-level .json tokenizers are split at safe places, see splittable(); others encode each text whole."""
    id_type = docs.schema[id_col].dataType.simpleString()
    splits = splittable(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _tokenizer(tokenizer)
        for batch in batches:
            texts = batch.column(1)
            total = np.zeros(batch.num_rows, dtype=np.int64)
            for rows, parts in packed((x.as_py() for x in texts), batch_bytes, splits):
                np.add.at(total, rows, count(parts))
            size = pa.compute.fill_null(pa.compute.binary_length(texts.cast(pa.large_string()).cast(pa.large_binary())), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(total)], ["id", "n_bytes", "n_tokens"])

    counted = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
