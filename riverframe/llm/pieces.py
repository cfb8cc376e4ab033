"""SentencePiece encoding and decoding with a table of distinct chunks.

The model's pieces never hold a white-space marker after another character, so a text falls into
chunks (a run of markers and what follows it) that are segmented independently of each other. Each
task segments every distinct chunk once, keeps its ids in a table of bounded size, and joins the ids
back by the chunks' positions in each text. Decoding takes the joined ids of a whole text.

Nulls count as empty: begin and end ids only, decoded to "". Rows that repeat an id, and repeated rows, are
encoded each; an empty table gives an empty result, and other columns are ignored, whatever their names. A text
takes memory for itself and its ids, whatever its length; the table is bounded by bytes (TABLE_BYTES), and chunks
of more than LONGEST characters, as scripts without spaces have them, pass by it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, give_back

#: Rows that go back to Spark at a time, which bounds what a task holds besides its table.
ROWS = 256
#: Most bytes of a task's table, as counted below, and the longest chunk that it keeps.
TABLE_BYTES, LONGEST = 40 << 20, 64
#: Bytes that an entry takes besides its characters and its ids: two objects and their place in the dictionary.
ENTRY = 200
#: Chunks of a text that are looked up at a time.
PART = 8192
MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


class ChunkTable:
    """Ids of distinct chunks; it starts anew when it holds `most` bytes."""

    def __init__(self, path: str, most: int = TABLE_BYTES):
        import sentencepiece

        self.sp, self.most, self.held = sentencepiece.SentencePieceProcessor(model_file=path), most, 0
        self.ids: dict[str, bytes] = {}
        pieces = (self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()))
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("this model has pieces that cross white space")
        self.mark = self._bytes([self.sp.piece_to_id(MARK)])
        self.edges = self._bytes([self.sp.bos_id()]), self._bytes([self.sp.eos_id()])

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return np.asarray(ids, dtype="<u4").tobytes()

    def _segment(self, chunks: list[str]) -> list[bytes]:
        # The library puts a marker in front of what it encodes, which stands for the chunk's first one.
        found = self.sp.encode([c[1:].replace(MARK, " ") for c in chunks], num_threads=1)
        return [self._bytes(ids) if len(c) > 1 else self.mark for c, ids in zip(chunks, found)]

    def clear(self) -> None:
        self.ids, self.held = {}, 0

    def encode(self, text: str | None) -> bytes:
        """All ids of a text with begin and end, as little-endian unsigned 32-bit integers."""
        out = [self.edges[0]]
        # Some thousand chunks at a time, so that a long text does not outgrow the table on its own.
        chunks = CHUNK.finditer(MARK + text.replace(" ", MARK)) if text else iter(())
        while part := [m.group() for m in islice(chunks, PART)]:
            missing = list({c for c in part if c not in self.ids})
            own = dict(zip(missing, self._segment(missing)))
            out += [own[c] if c in own else self.ids[c] for c in part]
            for chunk, ids in own.items():
                if len(chunk) <= LONGEST:
                    self.held += ENTRY + 2 * len(chunk) + len(ids)
                    self.ids[chunk] = ids
            if self.held > self.most:
                self.clear()
        return b"".join([*out, self.edges[1]])

    def decode(self, ids: bytes) -> str:
        return self.sp.decode(np.frombuffer(ids, dtype="<u4").tolist())


@lru_cache(maxsize=2)
def _table(path: str) -> ChunkTable:
    return ChunkTable(path)


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Rows (id, n_tokens, ids_sha256, decoded_sha256 [, ids array<int>, decoded])."""
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"] + (["ids", "decoded"] if keep_ids else [])
    schema = f"id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(model)
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            n, shas, decoded_shas, ids, decoded = [], [], [], [], []
            for text in batch.column(1):
                code = table.encode(text.as_py())
                back = table.decode(code)
                n.append(len(code) // 4)
                shas.append(hashlib.sha256(code).hexdigest())
                decoded_shas.append(hashlib.sha256(back.encode()).hexdigest())
                if keep_ids:
                    ids.append(np.frombuffer(code, dtype="<i4"))
                    decoded.append(back)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded_shas, pa.string())]
            if keep_ids:
                columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names)
        # The worker stays, for other tasks and other functions.
        table.clear()
        give_back()

    coded = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return coded.withColumnRenamed("id", id_col)


def decode_pieces(coded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (id, text): the texts of arrays of ids (null: empty)."""
    id_type = coded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _table(model).sp
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sp.decode(x.as_py() or []) for x in batch.column(1)], pa.string())], ["id", "text"])

    return coded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {id_type}, text string").withColumnRenamed("id", id_col)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_pieces(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), keep_ids=False)
