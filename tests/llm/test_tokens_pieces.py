import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from riverframe.llm import pieces, token_counts

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", " a", "a ", "  a  b ", "▁a▁▁b", "<s> x </s>", "\t a\nb\r\n", "x<|endoftext|>y", " ü ß 漢字 🙂", "a\x00b", "word " * 30_000, "x" * 5_000, " " * 3_000 + "end"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, f"z{i}") for i, t in enumerate(texts)], "doc_id bigint, text string, n_tokens string")


def check_counts(rows, texts, path):
    t = Tokenizer.from_file(path)
    for r in rows:
        text = texts[r.doc_id] or ""
        want = len(t.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), want, want > 512)


def test_token_counts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    check_counts(token_counts.count_tokens(frame(spark, ODD), path, batch_bytes=4_000).collect(), ODD, path)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check_counts(token_counts.op2_token_counts(spark, SF).collect(), texts, path)


def test_token_counts_of_a_piece_model(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(frame(spark, ODD), path).collect()} == {i: len(sp.encode(t or "")) for i, t in enumerate(ODD)}


def test_pieces_keep_the_text():
    for text in ODD:
        for limit in (1, 7, 1000):
            assert "".join(token_counts.pieces(text or "", limit)) == (text or "")


def test_encoding_and_decoding(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)

    def want(text):
        ids = sp.encode(text or "", add_bos=True, add_eos=True)
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()

    coded = pieces.encode_pieces(frame(spark, ODD), path)
    for r in coded.collect():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want(ODD[r.doc_id])
        assert r.ids == sp.encode(ODD[r.doc_id] or "", add_bos=True, add_eos=True)
    for r in pieces.decode_pieces(coded, path).collect():
        assert r.text == sp.decode(sp.encode(ODD[r.doc_id] or ""))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = pieces.op8_sentencepiece(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want(texts[r.doc_id])


def test_small_chunk_table():
    table = pieces.ChunkTable(public_tokenizers.path("piece_bpe_32k.model"), most=2)
    for text in ("a b c d", "b c", "e"):
        assert table.decode(table.encode(text)) == text


@pytest.mark.parametrize("op", [lambda d: token_counts.count_tokens(d, public_tokenizers.path("byte_bpe_50k.json")), lambda d: pieces.encode_pieces(d, public_tokenizers.path("piece_bpe_32k.model"))])
def test_empty_table(spark, op):
    assert op(frame(spark, [])).count() == 0


def test_table_of_chunks_is_bounded_by_bytes():
    """Texts of a script without spaces: chunks as long as texts are segmented, and none is kept."""
    import random
    import tracemalloc

    path = public_tokenizers.path("piece_bpe_32k.model")
    table = pieces.ChunkTable(path, most=1 << 20)
    r = random.Random(1)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 3000)]
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    tracemalloc.start()
    for i in range(300):
        text = "".join(r.choices(letters, k=10_000))
        code = table.encode(text)
        if i % 100 == 0:
            assert np.frombuffer(code, "<u4").tolist() == sp.encode(text, add_bos=True, add_eos=True)
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert not table.ids and held < 4 << 20
    # Ever new short words: the table starts anew before it holds more than its bytes.
    most = 0
    for i in range(40):
        text = " ".join(f"w{r.randrange(10**9)}" for _ in range(1000))
        assert np.frombuffer(table.encode(text), "<u4").tolist() == sp.encode(text, add_bos=True, add_eos=True)
        most = max(most, table.held)
    assert 1 << 19 < most <= 1 << 20


def test_repeated_rows_are_encoded_each(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = [(1, "same text"), (1, "same text"), (1, "another"), (None, "no id"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted((r.doc_id or 0, r.n_tokens) for r in pieces.encode_pieces(docs, path, keep_ids=False).collect())
    assert got == sorted((i or 0, len(sp.encode(t or "")) + 2) for i, t in rows)
    assert pieces.encode_pieces(docs.limit(0), path).collect() == []
