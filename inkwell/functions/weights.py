"""Weighting formulae as columns. "tf" is a term's document frequency, "dtf" its count in a document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def idf(kind: str, n: Column, tf: Column, maxtf: Column) -> Column:
    return {
        "maxtf": lambda: F.ln(1 + maxtf / tf),
        "n": lambda: F.ln(1 + n / tf),
        "n_int": lambda: F.ln(1 + F.floor(n / tf)),
        "one": lambda: F.lit(1.0),
    }[kind]()


def log_dtf(kind: str, dtf: Column, maxdtf: Column) -> Column:
    log = 1 + F.ln(dtf)
    return log if kind == "log" else F.when(maxdtf == 0, log).otherwise(0.5 + 0.5 * dtf / maxdtf)


def dtw(idf_: Column, damped: Column) -> Column:
    return idf_ * damped


def qtw(qtf: Column, qmf: Column, idf_: Column) -> Column:
    return (0.5 + 0.5 * qtf / qmf) * idf_


def inner_product(a: Column, b: Column) -> Column:
    return a * b


def square_sums(kind: str, idf_: Column, dtf: Column) -> dict[str, Column]:
    """Sums over a document's terms from which norm() has its weight, so that no term needs the document's maxdtf."""
    i2, plain = F.pow(idf_, F.lit(2)), {"s": F.sum(F.pow(dtw(idf_, log_dtf("log", dtf, dtf)), F.lit(2)))}
    return plain if kind == "log" else plain | {"s0": F.sum(i2), "s1": F.sum(i2 * dtf), "s2": F.sum(i2 * dtf * dtf)}


def norm(kind: str, maxdtf: Column) -> Column:
    """The root of the sum of dtw(idf, log_dtf(kind, dtf, maxdtf)) squared, by square_sums()."""
    if kind == "log":
        return F.sqrt("s")
    relative = 0.25 * (F.col("s0") + 2 * F.col("s1") / maxdtf + F.col("s2") / (maxdtf * maxdtf))
    return F.sqrt(F.when(maxdtf == 0, F.col("s")).otherwise(relative))
