"""URL coding as the search pages need it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from inkwell.functions.udf import arrow_udf

UNSAFE = '%<>"{}|\\^[]`'


def decoded(text: Column) -> Column:
    """%hh to characters; + stays."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def query_decoded(text: Column) -> Column:
    return F.try_url_decode(text)


def encoded(text: Column, space: str = "%20") -> Column:
    """Twelve unsafe characters in lower-case hex, blanks as space says."""
    out = text
    for c in UNSAFE:
        out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02x}"))
    return F.replace(out, F.lit(" "), F.lit(space))


def _joined(base, link):
    from urllib.parse import urljoin

    import pandas as pd

    def one(b, x):
        try:
            return urljoin(b, x)
        except ValueError:
            return None

    return pd.Series([None if b is None or x is None else one(b, x) for b, x in zip(base, link, strict=True)])


def joined(base: Column, link: Column) -> Column:
    """The link as seen from base, with dot segments resolved."""
    return arrow_udf(_joined, StringType())(base, link)


def _relative(base, link):
    import posixpath
    from urllib.parse import urlsplit

    import pandas as pd

    def one(b, x):
        p, q = urlsplit(b), urlsplit(x)
        if (p.scheme, p.netloc) != (q.scheme, q.netloc):
            return x
        path = posixpath.relpath(q.path or "/", posixpath.dirname(p.path or "/") or "/")
        return path + (f"?{q.query}" if q.query else "") + (f"#{q.fragment}" if q.fragment else "")

    return pd.Series([None if b is None or x is None else one(b, x) for b, x in zip(base, link, strict=True)])


def relative(base: Column, link: Column) -> Column:
    """An absolute link on the same host, as seen from base; others stay."""
    return arrow_udf(_relative, StringType())(base, link)
