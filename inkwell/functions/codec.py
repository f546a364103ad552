"""Integer codes as bit strings. Encoders are expressions; decoders of whole strings are Arrow-batched."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from inkwell.functions.udf import arrow_udf


def floor_log2(x: Column) -> Column:
    return (F.length(F.bin(x)) - 1).cast("long")


def ceil_log2(x: Column) -> Column:
    return F.when(x <= 1, F.lit(0)).otherwise(F.length(F.bin(x - 1))).cast("long")


def unary(x: Column) -> Column:
    return F.concat(F.repeat(F.lit("0"), (x - 1).cast("int")), F.lit("1"))


def gamma(x: Column) -> Column:
    b = F.bin(x)
    return F.concat(F.repeat(F.lit("0"), F.length(b) - 1), b)


def delta(x: Column) -> Column:
    b = F.bin(x)
    return F.concat(gamma(F.length(b).cast("long")), F.substr(b, F.lit(2)))


def minimal_binary(x: Column, bound: Column) -> Column:
    """x in 1..bound: short codes first, as many as fill the tree."""
    bits = ceil_log2(bound).cast("int")
    short = F.pow(F.lit(2), bits).cast("long") - bound
    low = x - 1
    is_short = low < short
    width = F.when(is_short, bits - 1).otherwise(bits)
    return F.when(bound <= 1, F.lit("")).otherwise(F.lpad(F.bin(F.when(is_short, low).otherwise(low + short)), width, "0"))


def _decoder(kind: str):
    def one(s: str) -> list[int]:
        out, at = [], 0
        while at < len(s):
            one_at = s.find("1", at)
            if one_at < 0:
                break  # padding
            n = one_at - at
            if kind == "unary":
                out.append(n + 1)
                at = one_at + 1
                continue
            head = int(s[one_at : one_at + n + 1], 2)
            at = one_at + n + 1
            if kind == "delta":
                head, at = int("1" + s[at : at + head - 1], 2), at + head - 1
            out.append(head)
        return out

    return one


def _decode(kind: str):
    def run(bits):
        one = _decoder(kind)
        return bits.map(lambda s: None if s is None else one(s))

    return run


def decode(bits: Column, kind: str) -> Column:
    """Numbers of a bit string: kind is unary, gamma or delta. A rest of zeros is padding."""
    return arrow_udf(_decode(kind), ArrayType(LongType()))(bits)
