"""Held-out accuracy, disguised words, and what a score may depend on."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from inkwell.llm import toxicity

from .conftest import documents, odd_rows, prose

LABELS = ["doc_id", "quality", "toxic"]
BAD = ["vilescum", "filthwit", "rottenhead"]


def fold(k):
    return zlib.crc32(("" if k is None else str(k)).encode()) % 4


def corpus(n=600):
    r = random.Random(0)
    rows, labels = [], []
    for k in range(n):
        toxic = k % 5 == 0
        text = prose(k, 60, 900).split()
        if toxic:
            text[r.randrange(60)] = r.choice(BAD)
        rows.append((k, " ".join(text)))
        labels.append({"doc_id": k, "quality": 1, "toxic": int(toxic)})
    return rows, labels


def test_held_out_accuracy_on_real_rows(spark):
    d = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in toxicity.op6_toxicity(spark, d).collect()}
    labels = [r for r in spark.read.parquet(f"{d}/labels.parquet").collect() if fold(r["doc_id"]) == 2 and r["toxic"] is not None]
    y = np.array([r["toxic"] for r in labels])
    p = np.array([got[r["doc_id"]]["predicted"] for r in labels])
    s = np.array([got[r["doc_id"]]["score"] for r in labels])
    both = ((p == 1) & (y == 1)).sum()
    assert both / (y == 1).sum() >= 0.9 and both / (p == 1).sum() >= 0.9
    assert (s[y == 1][:, None] > s[y == 0]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0]).mean() >= 0.95
    assert all(r["held_out"] == (fold(k) == 2) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for k, r in got.items())


@pytest.mark.parametrize("clash", [False, True])
def test_odd_rows_and_disguises(spark, folder, clash):
    rows, labels = corpus()
    odd = [(None if k is None else k + 5_000, t, s) for k, t, s in odd_rows()]
    tricks = ["v1l3scum", "v.i.l.e.s.c.u.m", "viiiilescuuum", "f1lthw!t", "r0tt3nh3ad", "v i l e s c u m", "VILESCUM", "r-o-t-t-e-n-h-e-a-d", "filthwit!!!"]
    hidden = [(9_000 + k, f"{prose(k, 30, 900)} {t} {prose(k + 50, 30, 900)}") for k, t in enumerate(tricks)]
    clean = [(9_500 + k, prose(77_000 + k, 60, 900)) for k in range(40)]
    d = folder(clash, documents=documents(rows + odd + hidden + clean), labels=(LABELS, labels + [{"doc_id": None, "toxic": 1}, {"doc_id": 9_000, "toxic": None}, {"doc_id": 88_888, "toxic": 1}]))
    out = toxicity.op6_toxicity(spark, d).collect()
    assert len(out) == len(rows) + len(odd) + len(hidden) + len(clean)
    assert all(r["held_out"] == (fold(r["doc_id"]) == 2) and 0 <= r["score"] <= 1 for r in out)
    got = {r["doc_id"]: r["predicted"] for r in out}
    missed = [t for (k, _), t in zip(hidden, tricks, strict=True) if not got[k]]
    assert not missed
    assert sum(got[k] for k, _ in clean) == 0
    toxic = [k for k in range(len(rows)) if k % 5 == 0 and fold(k) == 2]
    assert sum(got[k] for k in toxic) >= 0.9 * len(toxic) and not any(got[k] for k in range(len(rows)) if k % 5 and fold(k) == 2)
    scores = {(r["doc_id"], r["score"]) for r in out if r["doc_id"] in (5_006, 5_007, 5_014)}
    assert len({s for _, s in scores}) == 1


def test_only_text_enters_a_score(spark, folder):
    rows, labels = corpus(200)
    d = folder(documents=documents([*rows, (901, rows[0][1], "a"), (902, rows[0][1], "b"), (903, None), (904, "")]), labels=(LABELS, labels))
    got = {r["doc_id"]: r["score"] for r in toxicity.op6_toxicity(spark, d).collect()}
    assert got[901] == got[902] == got[0] and got[903] == got[904]


def test_held_out_labels_are_not_used(spark, folder):
    rows, labels = corpus(200)
    flipped = [x | {"toxic": 1 - x["toxic"]} if fold(x["doc_id"]) == 2 else x for x in labels]
    a = {r["doc_id"]: r["score"] for r in toxicity.op6_toxicity(spark, folder(documents=documents(rows), labels=(LABELS, labels))).collect()}
    b = {r["doc_id"]: r["score"] for r in toxicity.op6_toxicity(spark, folder(documents=documents(rows), labels=(LABELS, flipped))).collect()}
    assert a == b


@pytest.mark.parametrize("labels", [[], [{"doc_id": 1, "toxic": 1}], [{"doc_id": 1, "toxic": 0}, {"doc_id": 3, "toxic": 0}]])
def test_no_usable_labels(spark, folder, labels):
    d = folder(documents=documents(odd_rows()), labels=(LABELS, labels))
    out = toxicity.op6_toxicity(spark, d).collect()
    assert len({r["score"] for r in out}) == 1 and all(0 <= r["score"] <= 1 for r in out)


def test_empty_table(spark, folder):
    assert toxicity.op6_toxicity(spark, folder(documents=documents([]), labels=(LABELS, []))).count() == 0


def test_stage(spark, folder):
    rows, labels = corpus(300)
    d = folder(True, documents=documents(rows + odd_rows()[:3]), labels=(LABELS, labels))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = toxicity.stage_toxicity(spark, docs, d)
    assert out.columns == docs.columns
    kept = {r["doc_id"] for r in out.collect()}
    assert kept >= {k for k in range(4, 300) if k % 5}
    assert len([k for k in range(5, 300, 5) if k in kept]) < 6


STRUNG = ["a f i l t h w i t", "v i l e s c u m f i l t h w i t", "s o m e  v i l e s c u m", "x\ny\nr o t t e n h e a d", "i b a v i l e s c u m", "a.f.i.l.t.h.w.i.t"]


@pytest.fixture(scope="module")
def reader():
    """Characters counted over the rows of corpus()."""
    counts = np.zeros(toxicity.CLASSES**3, np.int64)
    for batch in toxicity._trigrams([pa.RecordBatch.from_pydict({"text": [t for _, t in corpus()[0]]})]):
        np.add.at(counts, batch.column(0).to_numpy(), batch.column(1).to_numpy())
    return toxicity.Reader(toxicity.CharModel(counts))


@pytest.mark.parametrize("text", STRUNG)
def test_several_words_strung_out(reader, text):
    bare = "".join(c for c in text if c.isalpha())
    assert {w for w in BAD if w in bare} <= reader.of(f"{prose(3, 30, 900)} {text} {prose(4, 30, 900)}")


def test_single_letters_are_counted_by_occurrence(reader):
    assert "ass" in reader.of("some a s s here") and not {"aaa", "a a"} & reader.of("a word a word a word")


LONG_WORDS = ["vi" + "l" * 90 + "e" * 70 + "scum" + "m" * 50, ".".join("sosomevilescumbadly" * 1), "-".join("x" * 40 + "filthwit" + "y" * 3), "f1lth" + "w" * 300 + "!t"]


@pytest.mark.parametrize("token", LONG_WORDS)
def test_long_pieces_are_decoded(reader, token):
    bare = {"v": "vilescum", "s": "vilescum", "x": "filthwit", "f": "filthwit"}[token[0]]
    assert any(bare in w for w in reader.of(f"prose {token} prose"))


def test_disguised_words_deep_in_a_long_token(reader):
    """A dotted phrase of 300 letters, and a token of a megabyte: windows, each in proportion to its length."""
    r = random.Random(1)
    phrase = "".join(r.choice("bdglmnprtaeiou") for _ in range(140)) + "rottenhead" + "".join(r.choice("bdglmnprtaeiou") for _ in range(150))
    assert any("rottenhead" in w for w in reader.of(".".join(phrase)))
    huge = "".join(r.choice("bdglmnprtaeiou17") for _ in range(1 << 17))
    assert reader.of("v1l3scum " + huge) >= {"vilescum"} and reader.of("z" * (1 << 20)) is not None


def test_repeated_ids_in_both_tables(spark, folder):
    """One id with a third of all rows and several texts, ids labelled twice: the sample has each once."""
    rows, labels = corpus(300)
    many = [(5, f"{prose(k, 20, 900)} vilescum") for k in range(150)]
    d = folder(documents=documents(rows + many), labels=(LABELS, labels + labels[:50] + [{"doc_id": 5, "toxic": 0}]))
    docs, own = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    assert toxicity.labelled(spark, docs, own)[0].count() == sum(fold(k) != 2 for k in range(300))
    assert len(toxicity.op6_toxicity(spark, d).collect()) == 450
