"""Fingerprints against sums by the definition."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.llm import hashing as H


def poly(raw, base):
    return sum((c + 1) * pow(base, k, H.P) for k, c in enumerate(raw)) % H.P


@given(st.binary(min_size=1, max_size=300), st.integers(0, 299), st.integers(0, 299))
@settings(max_examples=60, deadline=None)
def test_definition(raw, a, b):
    a, b = sorted((a % (len(raw) + 1), b % (len(raw) + 1)))
    x = np.frombuffer(raw, np.uint8)
    for got, base in zip(H.fingerprints(x, np.array([a]), np.array([b])), H.POINTS, strict=True):
        assert int(got[0]) == int(H.mixed(np.array([poly(raw[a:b], base) * pow(base, H.PART, H.P) % H.P], H.U))[0])


@given(st.lists(st.tuples(st.integers(0, H.P - 1), st.integers(0, H.P - 1)), min_size=1))
@settings(deadline=None)
def test_products(pairs):
    a, b = (np.array(x, H.U) for x in zip(*pairs, strict=True))
    assert [int(x) for x in H.times(a, b)] == [x * y % H.P for x, y in pairs]


def test_parts_and_wide_stretches(monkeypatch):
    monkeypatch.setattr(H, "PART", 1000)
    monkeypatch.setattr(H, "WIDE", 200)
    monkeypatch.setattr(H, "_powers", {})
    r = np.random.default_rng(0)
    b = r.integers(0, 4, 5_000).astype(np.uint8)
    b[3000:3400] = b[900:1300]
    start, stop = np.array([900, 3000, 950, 3050, 950, 0]), np.array([1300, 3400, 1100, 3200, 1101, 0])
    for x in H.fingerprints(b, start, stop):
        assert x[0] == x[1] and x[2] == x[3] and len({int(v) for v in x}) == 4


def test_thue_morse_words_differ():
    tm = "".join("ab"[bin(k).count("1") & 1] for k in range(4096))
    b = np.frombuffer((tm + tm.translate(str.maketrans("ab", "ba"))).encode(), np.uint8)
    for x in H.fingerprints(b, np.array([0, 4096]), np.array([4096, 8192])):
        assert x[0] != x[1]
