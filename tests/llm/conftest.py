import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

#: Columns that a table may have besides its own, named like ones that operators make.
CLASHING = ("nid", "fp", "key", "size", "h", "n", "blob_id", "spans", "words", "kind", "at", "score", "held_out", "fingerprint", "component_id", "a", "b", "rank", "part", "taken", "source_size", "target", "found")

TYPES = {"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "source": pa.string(), "n_chars": pa.int64(), "quality": pa.int32(), "toxic": pa.int32(), "vec_id": pa.int64(), "embedding": pa.list_(pa.float32()), "label": pa.int32()}


def prose(seed: int, n: int, words: int = 400) -> str:
    r = random.Random(seed)
    stock = ["".join(random.Random(k).choice("abcdefghijklmnoprstuv") for _ in range(2 + k % 7)) for k in range(words)]
    return " ".join(r.choice(stock) for _ in range(n))


@pytest.fixture
def folder(tmp_path):
    """Writes tables, lists of rows as dicts, and gives their folder."""

    def write(clash: bool = False, **tables):
        for name, (columns, rows) in tables.items():
            cols = {c: pa.array([r.get(c) for r in rows], TYPES[c]) for c in columns}
            if clash:
                cols |= {c: pa.array([f"x{k}" for k in range(len(rows))]) for c in CLASHING if c not in cols}
            pq.write_table(pa.table(cols), f"{tmp_path}/{name}.parquet", row_group_size=7)
        return str(tmp_path)

    return write


DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(rows):
    """(doc_id, text) or (doc_id, text, source) as a table for folder()."""
    return DOCUMENTS, [{"doc_id": r[0], "text": r[1], "source": r[2] if len(r) > 2 else "web", "lang": "en", "n_chars": len(r[1] or "")} for r in rows]


def odd_rows():
    """Nulls, empty, very short and very long texts, repeated rows, one id with two texts, other alphabets."""
    long = prose(5, 40_000, 3_000)
    base = prose(1, 120, 400)
    return [
        (1, None, "web"), (2, "", "web"), (3, " \t\n", None), (4, "one", "web"), (5, "Two WORDS", "books"), (6, base, "web"), (7, base, "web"), (8, base + " coda", None),
        (9, long, "web"), (10, long[:200_000] + " other " + long[200_000:], "books"), (11, "é ü ß 漢字 😀 " * 30, "web"), (12, "x" * 5_000, "web"), (13, "ab" * 4_000, "code"),
        (14, base, "web"), (14, base, "web"), (15, "same id, first text " * 9, "web"), (15, "same id, second text " * 9, "code"), (None, "no id at all " * 12, "web"), (None, base, "web"),
        (16, "a\x0bb\x0cc\r\nd e f\x1fg", "web"), (17, "it's we'll  two  spaces   three \n\n\n lines", "web"),
    ]


def agree(df, sql):
    """Rows of a Spark frame and of a DuckDB relation, nulls included."""
    names = sorted(df.columns)
    assert names == sorted(sql.columns)
    row = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    a = sorted((row(r) for r in df.select(*names).collect()), key=repr)
    b = sorted((row(r) for r in sql.select(*names).fetchall()), key=repr)
    assert a == b
