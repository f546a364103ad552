"""Licence scans against all pairs of units and templates."""

import re
from collections import Counter

import duckdb
import pytest

from inkwell.llm import licenses
from inkwell.llm.templates import TEMPLATES

from .conftest import agree, documents, odd_rows, prose


def norm(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.sub(r"[^a-z0-9\x80-\U0010ffff\n\x01]+", " ", re.sub(r"[.;!?]+[ \t]+", "\x01", low)).replace("licence", "license")


def units(text):
    n = norm(text)
    paragraphs = re.split(r"\n(?:[ \x01]*\n)+", n)
    if len(paragraphs) > 1:
        yield (0, 1, 0), n
    yield from (((1, k, 0), p) for k, p in enumerate(paragraphs, 1) if "\n" in p)
    for k, line in enumerate(n.split("\n"), 1):
        yield (2, k, 0), line
        if "\x01" in line:
            yield from (((3, k, j), s) for j, s in enumerate(line.split("\x01"), 1))


def grams(text):
    w = re.split(r"[ \n\x01]+", text.strip(" \n\x01"))
    return Counter(zip(w, w[1:], strict=False))


def expected(text, templates=TEMPLATES, least=licenses.DICE):
    ts = [(name, grams(norm(t))) for name, t in templates]
    best = {}
    for at, u in units(text):
        g = grams(u)
        scores = [(-2 * sum((g & t).values()) / max(1, g.total() + t.total()), k) for k, (_, t) in enumerate(ts)]
        d, k = min(scores, default=(0, 0))
        if -d >= least - 1e-12:
            best[ts[k][0]] = min(best.get(ts[k][0], (0,)), (d, *at))
    name = lambda kind, a, b: "tpls"[kind] + (str(a) if kind else "") + (f".{b}" if kind == 3 else "")
    return ",".join(f"{x}:{name(*u)}:{-d:.4f}" for x, (d, *u) in sorted(best.items()))


MIT = TEMPLATES[3][1]
TEXTS = [
    "Released under the MIT License.", "prose\nRELEASED under the mit licence!\nmore prose", "Some words here. Licensed under CC BY-NC 4.0. And some more of them.", "Licensed under CC BY-NC-SA 4.0.", "Licensed under the MIT licence",
    "Copyright (c) 2020 Someone\n\n" + MIT + "\n\n" + prose(1, 40), MIT.replace("software", "program"), "\n".join(MIT.split(", ")), "(c) 2020 A\n" + MIT.replace("\n", " \n") + "\n \n\nprose", TEMPLATES[15][1] + "\n" + TEMPLATES[16][1],
    "This work is licensed under the GNU General Public License, version 3.", "This work is licensed under the GNU General Public License, version 4.", "of the of the of the in the", "the mit license", "under the MIT\x01License. x", prose(3, 3_000) + "\nLicensed under the Apache License, Version 2.0.",
    "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.\n\nReleased under the MIT Licence",
]


@pytest.fixture
def rows():
    return odd_rows() + [(100 + k, t) for k, t in enumerate(TEXTS)] + [(100, TEXTS[0]), (None, TEXTS[1])]


@pytest.mark.parametrize("clash", [False, True])
def test_findings(spark, folder, rows, clash):
    got = licenses.op8_license_scan(spark, folder(clash, documents=documents(rows))).collect()
    assert sorted(((r["doc_id"], r["findings"]) for r in got), key=repr) == sorted(((r[0], expected(r[1])) for r in rows), key=repr)
    for r in got:
        parts = [f.split(":") for f in r["findings"].split(",") if f]
        assert r["n_licences"] == len(parts) and r["licences"] == ",".join(p[0] for p in parts)
        assert r["best_dice"] == pytest.approx(max((float(p[2]) for p in parts), default=0), abs=1e-4)
    assert sum(1 for r in got if r["n_licences"]) >= 12


def test_oracle(spark, folder, rows):
    d = folder(documents=documents(rows))
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{d}/documents.parquet'")
    agree(licenses.op8_license_scan(spark, d), c.sql(licenses.ORACLE))


def test_empty_table_and_no_templates(spark, folder):
    assert licenses.op8_license_scan(spark, folder(documents=documents([]))).count() == 0
    texts = spark.createDataFrame([("a", TEXTS[0])], "blob_id string, text string")
    assert licenses.scan(spark, texts, licenses.Templates([])).count() == 0


@pytest.mark.parametrize("dice", [0.5, 0.8, 0.95])
def test_probes_and_bounds_lose_nothing(dice):
    """Any multiset that reaches the threshold has a size within bounds; one without probes can't reach it."""
    t = licenses.Templates(dice=dice)
    for k, g in enumerate(t.grams):
        b, (lo, hi) = t.sizes[k], t.bounds[k]
        assert 2 * (lo - 1) / (lo - 1 + b) < dice <= 2 * lo / (lo + b) + 1e-9 and 2 * b / (hi + 1 + b) < dice <= 2 * b / (hi + b) + 1e-9
        rest = b - sum(g[p] for p in t.probes(k))
        assert all(2 * min(m, rest) / (m + b) < dice for m in range(lo, hi + 1))


W = MIT.split()
NOTICE = [" ".join(W[:60]), " ".join(W[60:100]), " ".join(W[100:])]


def wrapped(mark=""):
    """Three paragraphs in lines of 10 words, with mark before each line."""
    return f"\n{mark}\n".join("\n".join(f"{mark} " + " ".join(p.split()[k : k + 10]) for k in range(0, len(p.split()), 10)) for p in NOTICE)


def test_licences_of_several_paragraphs(spark, folder):
    """A notice of three paragraphs in a long text; no single paragraph reaches the threshold, nor does the whole."""
    long = prose(8, 3_000)
    apache = next(t for n, t in TEMPLATES if n == "Apache-2.0" and len(t.split()) > 60).split()
    bsd = next(t for n, t in TEMPLATES if n == "BSD-3-Clause").split()
    texts = [wrapped() + "\n\n" + long, f"/*\n{wrapped(' *')}\n */\n{long}", f"{long}\n\n{wrapped('#')}\n\n{long}", long + "\n\n" + " ".join(apache[:45]) + "\n\n" + " ".join(apache[45:]),
             "\n\n".join(" ".join(bsd[k : k + 40]) for k in range(0, len(bsd), 40)) + "\n\n" + long, wrapped() + "\n\n" + long + "\n\n" + "Licensed under CC0 1.0."]
    rows = [*enumerate(texts), (10, "\n\n".join(NOTICE[:1]) + "\n\n" + long), (11, "\n\n".join([NOTICE[0], long, *NOTICE[1:]])), (12, "of the\n\n" * 3_000 + long), (0, texts[0]), (None, texts[0])]
    got = {(r["doc_id"], r["findings"]) for r in licenses.op8_license_scan(spark, folder(documents=documents(rows))).collect()}
    full = "MIT:r{}:1.0000".format
    want = {(0, full("1-3")), (None, full("1-3")), (1, full("1-3")), (2, full("2-4")), (3, "Apache-2.0:s3.1:0.8750"), (4, "BSD-3-Clause:r1-6:1.0000"), (5, "CC0-1.0:l{}:1.0000,MIT:r1-3:1.0000"), (10, ""), (11, ""), (12, "")}
    assert got == {(k, f.replace("{}", str(texts[5].count("\n") + 1))) for k, f in want}
    assert not any(expected(texts[k]) for k in (0, 1, 2, 4))


def best_passage(text, template, least=licenses.DICE):
    """(dice, first word, last word) of the best words in a row, all tried."""
    w, t = re.split(r"[ \n\x01]+", norm(text).strip(" \n\x01")), grams(norm(template))
    lo, hi = licenses.bounds(t.total(), least)
    best = (0, 0, 0)
    for a in range(len(w) - lo):
        own, shared = Counter(), 0
        for b in range(a + 1, min(len(w), a + hi + 1)):
            g = (w[b - 1], w[b])
            own[g] += 1
            shared += own[g] <= t[g]
            if b - a >= lo:
                best = min(best, (-2 * shared / (b - a + t.total()), a + 1, b + 1))
    return best if -best[0] >= least - 1e-12 else None


def test_passages_of_words(spark, folder):
    """Notices in the middle of longer sentences and over several: no unit shows them."""
    names = [n for n, _ in TEMPLATES]
    mpl, isc, zlib = (" ".join(TEMPLATES[names.index(n)][1].split()) for n in ("MPL-2.0", "ISC", "Zlib"))
    w = zlib.split()
    texts = [
        prose(1, 300) + " " + mpl.replace(".", ",") + " " + prose(2, 300), prose(3, 90) + " " + " ".join(w[:50] + ["as", "of", "the"] * 6 + w[50:]) + " " + prose(4, 200), " ".join(w[:60]) + " " + prose(5, 400) + " " + " ".join(w[60:]),
        prose(6, 50) + " " + isc.replace(". ", " and ") + " " + mpl.replace(".", "") + " " + prose(7, 99), ("of the of the " * 400) + isc.lower(), "it is under the MIT license here " * 9,
    ]
    got = {r["doc_id"]: r for r in licenses.op8_license_scan(spark, folder(documents=documents(list(enumerate(texts))))).collect()}
    for k, text in enumerate(texts):
        shown = {f.split(":")[0] for f in got[k]["findings"].split(",")}
        want = {}
        for n, t in TEMPLATES:
            if n not in shown and licenses.WORDY[0] <= grams(norm(t)).total() <= licenses.WORDY[1] and (p := best_passage(text, t)):
                want[n] = min(want.get(n, (0,)), p)
        assert got[k]["passages"] == ",".join(f"{n}:w{a}-{b}:{-d:.4f}" for n, (d, a, b) in sorted(want.items()))
    assert [len(got[k]["passages"]) > 0 for k in range(6)] == [True, True, False, True, True, False]


def test_whole_texts_of_long_licences(spark, folder):
    """Alone, in a longer text, with words changed, and half of one. (The whole text ends with the notice of its use.)"""
    text = dict(TEMPLATES[-7:])["GPL-2.0"]
    other = "\n".join(line.replace("program", "library") for line in text.split("\n"))
    rows = [(0, text), (1, prose(1, 4_000) + "\n\n" + text + "\n\n" + prose(2, 4_000)), (2, other), (3, text[: len(text) // 2])]
    got = {r["doc_id"]: r["findings"] for r in licenses.op8_license_scan(spark, folder(documents=documents(rows))).collect()}
    assert got[0].startswith("GPL-2.0:t:1.0000") and got[1].startswith("GPL-2.0:r2-") and got[2].startswith("GPL-2.0:t:0.9") and "GPL-2.0:" not in got[3]


def test_many_licence_lines(spark, folder):
    """One text of 10,000 licence lines, and the same in paragraphs: work in proportion to the text."""
    line = "Licensed under the Apache License, Version 2.0."
    part = " ".join(TEMPLATES[3][1].split()[:60])
    rows = [(0, "\n".join([line] * 10_000)), (1, "\n\n".join([line] * 10_000)), (2, "\n\n".join([part] * 2_000))]
    got = {r["doc_id"]: r["findings"] for r in licenses.op8_license_scan(spark, folder(documents=documents(rows))).collect()}
    assert got == {0: "Apache-2.0:l1:1.0000", 1: "Apache-2.0:l1:1.0000", 2: ""}
