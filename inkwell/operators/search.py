"""Ranked, Boolean, all-terms and prefix search over an Index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import weights as W
from inkwell.functions.stem import STEMMERS
from inkwell.functions.text import IDENT
from inkwell.operators.index import Index, with_prefix
from inkwell.plans.request import QueryTerm, free_text, holds, parse_boolean, terms_of


def query_frame(spark: SparkSession, terms: list[QueryTerm]) -> DataFrame:
    """(pos, term, qtf): at most 50 rows, folded into the plan as a local relation."""
    rows = [F.struct(F.lit(t.pos).alias("pos"), F.lit(t.term).alias("term"), F.lit(t.qtf).alias("qtf")) for t in terms]
    if not rows:
        return spark.range(0).select(F.lit(0).alias("pos"), F.lit("").alias("term"), F.lit(0).alias("qtf"))
    return spark.range(1).select(F.explode(F.array(*rows)).alias("q")).select("q.*")


def _stemmed(terms: list[QueryTerm], stemmer: str | None) -> list[QueryTerm]:
    """Counting comes before stemming, so two words of one stem stay two query terms."""
    return [QueryTerm(t.pos, STEMMERS[stemmer](t.term), t.qtf) for t in terms] if stemmer else terms


def ranked(index: Index, query: str, k: int | None = None, within: DataFrame | None = None) -> DataFrame:
    """(docnum, score, hits), best first, ties by docnum; k rows, or all of them. within: a frame of docnum to keep."""
    spark, p = index.docs.sparkSession, index.profile
    terms = _stemmed(free_text(query, p.word, p.lower), index.stemmer)
    words = sorted({t.term for t in terms})
    qmf = max((t.qtf for t in terms), default=1)
    wanted = F.col("term").isin(words) if words else F.lit(False)
    idf = index.idf(p.query_idf).where(wanted)
    q = F.broadcast(query_frame(spark, terms))  # 50 rows at most
    q = q.join(idf, "term").select("term", "pos", "idf", W.qtw(F.col("qtf"), F.lit(qmf), F.col("idf")).alias("qtw"))
    found = index.postings.where(wanted)
    if within is not None:
        found = found.join(within.select("docnum"), "docnum", "left_semi")
    found = found.join(index.weights, "docnum")
    parts = found.join(F.broadcast(q), "term").withColumn("w", W.inner_product(W.dtw(F.col("idf"), W.log_dtf(p.damping, F.col("dtf"), F.col("maxdtf"))), F.col("qtw")))
    # a posting meets one query term, or two words of one stem: positions are distinct
    sums = parts.groupBy("docnum").agg(F.sum("w").alias("total"), F.max("dwt").alias("dwt"), F.count("pos").alias("hits"))
    out = sums.select("docnum", (F.col("total") / F.col("dwt")).alias("score"), "hits").orderBy(F.desc("score"), "docnum")
    return out if k is None else out.limit(k)


def query_term_hits(index: Index, query: str) -> DataFrame:
    """(pos, term, tf) of each query term; 0 where no document has it."""
    terms = free_text(query, index.profile.word, index.profile.lower)
    q = query_frame(index.docs.sparkSession, terms)
    return q.join(index.terms.where(F.col("term").isin([t.term for t in terms])), "term", "left").select("pos", "term", F.coalesce("tf", F.lit(0)).cast("long").alias("tf"))


def compiled(tree, flag) -> Column:
    """The expression as one predicate over flag(term)."""
    if tree[0] == "term":
        return flag(tree[1])
    if tree[0] == "not":
        return ~compiled(tree[1], flag)
    a, b = compiled(tree[1], flag), compiled(tree[2], flag)
    return a & b if tree[0] == "and" else a | b


def boolean(index: Index, query: str, version: int = 2, exact: bool = True) -> DataFrame:
    """(docnum), in order. Only postings of the query's terms are read; all documents take part only if the expression
    accepts one that has none of the terms. Errors give no rows."""
    tree, _ = parse_boolean(query, version)
    if tree is None:
        return index.docs.select("docnum").where(F.lit(False))
    terms = terms_of(tree)
    is_term = (lambda t: F.col("term") == t) if exact else (lambda t: with_prefix(F.col("term"), t))
    any_of = is_term(terms[0])
    for t in terms[1:]:
        any_of = any_of | is_term(t)
    flags = index.postings.where(any_of).groupBy("docnum").agg(*[F.max(is_term(t)).alias(f"f{k}") for k, t in enumerate(terms)])
    flag = lambda t: F.coalesce(F.col(f"f{terms.index(t)}"), F.lit(False))
    if holds(tree, lambda t: False):
        flags = index.docs.select("docnum").join(flags, "docnum", "left")
    return flags.where(compiled(tree, flag)).select("docnum").orderBy("docnum")


def all_terms(index: Index, query: str) -> DataFrame:
    """(docnum, hits) of documents that have every term, in order."""
    terms = free_text(query, index.profile.word, index.profile.lower)
    words = [t.term for t in terms]
    found = index.postings.where(F.col("term").isin(words) if words else F.lit(False))
    return found.groupBy("docnum").agg(F.countDistinct("term").alias("hits")).where(F.col("hits") == len(words)).orderBy("docnum")


def prefix_terms(index: Index, prefix: str) -> DataFrame:
    return index.terms.where(with_prefix(F.col("term"), prefix)).orderBy("term")


def search(index: Index, request) -> DataFrame:
    """Dispatch by a SearchRequest's method: (docnum, score, hits) in result order."""
    r = request.checked()
    if r.method == "boolean":
        return boolean(index, r.expression, exact=r.exact).select("docnum", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("hits"))
    if r.method == "all":
        return all_terms(index, r.expression).select("docnum", F.lit(0.0).alias("score"), "hits")
    return ranked(index, r.expression)


__all__ = ["IDENT", "all_terms", "boolean", "compiled", "prefix_terms", "query_frame", "query_term_hits", "ranked", "search"]
