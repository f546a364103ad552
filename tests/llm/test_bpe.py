"""Ids against the tiktoken library, and exact round trips."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from inkwell.llm import bpe

from .conftest import documents, odd_rows


@pytest.fixture(scope="module")
def library():
    with open(P.path(bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bpe.loaded(bpe.VOCABULARY)


def digests(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("clash", [False, True])
def test_odd_rows(spark, folder, library, clash):
    rows = odd_rows()
    got = bpe.op2_byte_bpe(spark, folder(clash, documents=documents(rows))).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(((r[0], *digests(library, r[1])) for r in rows), key=repr)


def test_real_rows(spark, sf_dir, library):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = bpe.op2_byte_bpe(spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted((r["doc_id"], *digests(library, r["text"])) for r in rows)


def test_empty_table(spark, folder):
    assert bpe.op2_byte_bpe(spark, folder(documents=documents([]))).count() == 0


ALPHABETS = ["ab ", "a b\n\t", "'stredvm lL", "0123 .,-", "éüß 漢字", "😀‍👍 ", "   x\x85", "<|endoftext|> "]


@pytest.mark.parametrize("alphabet", ALPHABETS)
def test_random_texts(own, library, alphabet):
    r = random.Random(alphabet)
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(90))) for _ in range(300)]
    for text, ids in zip(texts, own.encode_batch(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), repr(text)
        assert own.decode(np.frombuffer(ids, "<u4")) == text.encode() if ids else text == ""


@pytest.mark.parametrize("word", ["a" * 3_000, "ab" * 2_000, "é" * 700, "".join(random.Random(0).choice("abcdefgh") for _ in range(4_000))])
def test_long_words(own, library, word):
    assert np.frombuffer(own.encode_batch([word])[0], "<u4").tolist() == library.encode_ordinary(word)


def test_encoded_keeps_ids(spark, folder, library):
    rows = odd_rows()[:8]
    d = folder(documents=documents(rows))
    got = bpe.encoded(spark, spark.read.parquet(f"{d}/documents.parquet")).collect()
    assert {r["doc_id"]: np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in got} == {r[0]: library.encode_ordinary(r[1] or "") for r in rows}


def test_decoded_frames(spark, folder, library):
    rows = odd_rows()[:12]
    d = folder(documents=documents(rows))
    coded = bpe.encoded(spark, spark.read.parquet(f"{d}/documents.parquet"))
    got = {r["doc_id"]: r["bytes"] for r in bpe.decoded(spark, coded).collect()}
    assert {k: bytes(v) for k, v in got.items()} == {r[0]: (r[1] or "").encode() for r in rows}
    none = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert bpe.decoded(spark, none).first()["bytes"] is None


@pytest.mark.parametrize("k", range(6))
def test_rows_and_matrices_agree(own, library, monkeypatch, k):
    """Words by one-row rounds, by matrices and by the library."""
    r = random.Random(k)
    text = "".join(r.choice(["a", "e", "th", "in", "er", "tion", "xq", "é"][: 2 + k]) for _ in range(700))
    want = library.encode_ordinary(text)
    assert own.merge_row(text.encode()).tolist() == want == own.merge_matrix([text.encode()])[0].tolist()
