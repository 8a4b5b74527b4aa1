"""Byte-level BPE against the tiktoken library."""

import hashlib
import random

import pytest
import tiktoken

from askgrid.llm import byte_bpe


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.public_vocabulary()


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=vocabulary.pattern, mergeable_ranks=vocabulary.ranks, special_tokens={})


def test_random_texts(vocabulary, library):
    chosen = random.Random(1)
    kinds = ["ab c", "abcdefghij  \n\t'", "aaab", "the and ing's 've é 12 34", "日本語 テキスト🙂\x1c\x85  x", "\n\n   a", " \r\n x"]
    texts = ["".join(chosen.choice(k) for _ in range(chosen.choice([0, 1, 5, 40, 300, 900]))) for k in kinds for _ in range(120)]
    texts += ["a" * 20000, "ab" * 3000, "é" * 700, " " * 1000 + "x", "1" * 400, "<|endoftext|>"]
    encoder = byte_bpe.Encoder(vocabulary)
    for start in range(0, len(texts), 97):
        part = texts[start : start + 97]
        ids, ends = encoder.encode(part)
        for i, text in enumerate(part):
            assert ids[ends[i] : ends[i + 1]].tolist() == library.encode_ordinary(text)


def test_there_and_back_is_decode_of_encode(documents, vocabulary, prose):
    rows = documents([(1, None), (2, ""), (3, "é" * 700 + " x"), (3, prose(1, 9)), (None, prose(2, 300000))])
    both = byte_bpe.there_and_back(rows, vocabulary)
    apart = byte_bpe.decode(byte_bpe.encode(rows, vocabulary), vocabulary)
    assert both.schema == apart.schema
    key = lambda r: (str(r["doc_id"]), r["text"] or "")
    assert sorted(both.collect(), key=key) == sorted(apart.collect(), key=key)


def test_long_pieces_go_the_same_way(vocabulary):
    chosen = random.Random(3)
    for n in (2, 17, 200):
        piece = bytes(chosen.choice(b"etaoin the") for _ in range(n))
        ids, counts = byte_bpe._encode_matrix([piece], 256, vocabulary)
        assert ids[0, : counts[0]].tolist() == byte_bpe._encode_long(piece, vocabulary)


def test_forgetting_changes_nothing(vocabulary, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 3)
    encoder = byte_bpe.Encoder(vocabulary)
    for text in ("one two three four", "five six", "one two"):
        ids, _ = encoder.encode([text])
        assert ids.tolist() == library.encode_ordinary(text)


def test_small_vocabulary_takes_the_leftmost_least_pair():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"ba": 257, b"aba": 258, b"bb": 259}
    vocabulary = byte_bpe.Vocabulary.of(ranks, r"\S+|\s+")
    mine = tiktoken.Encoding("small", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    for text in ("ababab", "babab bbaab", "aabbaabb" * 5, "b"):
        ids, _ = byte_bpe.Encoder(vocabulary).encode([text])
        assert ids.tolist() == mine.encode_ordinary(text)


def test_columns_nulls_and_empty_table(documents, vocabulary, library):
    rows = [(1, "Some text."), (None, "x"), (2, None), (3, ""), (1, "Some text.")]
    df = documents(rows)
    result = byte_bpe.decode(byte_bpe.encode(df, vocabulary), vocabulary)
    assert set(result.columns) == {*df.columns, "ids", "decoded"}
    for row in result.collect():
        assert row["ids"] == library.encode_ordinary(row["text"] or "")
        assert bytes(row["decoded"]) == (row["text"] or "").encode()
        assert row["id"] == "x"
    assert byte_bpe.tokenize_documents(documents([]), vocabulary).count() == 0


def test_query(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for row in byte_bpe.op6_byte_bpe(spark, folder).collect():
        ids = library.encode_ordinary(texts[row["doc_id"]])
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(texts[row["doc_id"]].encode()).hexdigest()
