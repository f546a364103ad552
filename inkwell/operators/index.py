"""The inverted index as DataFrames: postings, terms, document weights, collection statistics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions import weights as W
from inkwell.functions.stem import stemmed
from inkwell.functions.text import common_prefix, counted, tokenize, tokenize_dropping_last
from inkwell.plans.profile import SPARCK_JONES, Profile
from inkwell.plans.scratch import exists, kept, root, signature, size


BLOCK, HEAD = 4096, 4  # document numbers of a block; characters by which terms are dealt
SEGMENT, RANGE, LISTS = 8 << 20, 16 << 20, 4 << 20  # bytes of documents for a part of the postings; of postings for a range of them, for lists made at once
COMMON = 50_000  # terms that are broadcast with their idf


def token_rows(docs: DataFrame, profile: Profile = SPARCK_JONES) -> DataFrame:
    """(docnum, pos, term) of docs (docnum, text)."""
    words = tokenize(F.col("text"), profile.word, profile.lower) if profile.keeps_last_word else tokenize_dropping_last(F.col("text"), profile.word)
    return docs.select("docnum", F.posexplode(words).alias("pos", "term"))


def postings_of(docs: DataFrame, profile: Profile = SPARCK_JONES, stemmer: str | None = None, on_document: Callable[[DataFrame], DataFrame] | None = None, on_term: Callable[[Column], Column] | None = None) -> DataFrame:
    """(term, docnum, dtf). A document's words are counted where it is read, so postings are shuffled only where a
    number comes twice or on_term may make one term of two. Hooks: on_document changes or drops documents before they
    are cut into words, on_term each term (null: it is left out); both are expressions, so they run where the words are
    made."""
    docs = on_document(docs) if on_document else docs
    rows = _words_counted(docs, profile, stemmer)
    rows = rows.select(on_term(F.col("term")).alias("term"), "docnum", "dtf").where("term is not null") if on_term else rows
    return added(rows) if on_term or repeats(docs) else rows


def _words_counted(docs: DataFrame, profile: Profile, stemmer: str | None) -> DataFrame:
    words = tokenize(F.col("text"), profile.word, profile.lower) if profile.keeps_last_word else tokenize_dropping_last(F.col("text"), profile.word)
    return counted(docs.select("docnum", (stemmed(words, stemmer) if stemmer else words).alias("words"))).select("term", "docnum", "dtf")


def repeats(docs: DataFrame) -> bool:
    """Whether a document number comes more than once: a job that reads the numbers only."""
    return not docs.groupBy("docnum").count().where("count > 1").isEmpty()


def block_of(docnum: str) -> Column:
    return F.floor(F.col(docnum) / BLOCK).cast("long")


def in_blocks(docs: DataFrame) -> DataFrame:
    """docs dealt in ranges of whole blocks of their numbers, so that windows over a term and block of their postings deal nothing."""
    return docs.repartitionByRange(size(docs) // SEGMENT + 1, block_of("docnum"))


def added(rows: DataFrame) -> DataFrame:
    """(term, docnum, dtf), with the counts of one term and document added up."""
    return rows.groupBy("term", "docnum").agg(F.sum("dtf").alias("dtf"))


@dataclass(frozen=True)
class Index:
    """docs (docnum and any metadata), postings (term, docnum, dtf). The rest is derived."""

    docs: DataFrame
    postings: DataFrame
    profile: Profile = SPARCK_JONES
    stemmer: str | None = None

    @cached_property
    def terms(self) -> DataFrame:
        """(term, tf)"""
        return self.postings.groupBy("term").agg(F.count("*").alias("tf"))

    @cached_property
    def maxdtf(self) -> DataFrame:
        """(docnum, maxdtf) of documents that have terms. With compat_multidoc only a file's last document has one,
        the largest of the whole file; the others have 0."""
        own = self.postings.groupBy("docnum").agg(F.max("dtf").alias("maxdtf"))
        if not self.profile.compat_multidoc:
            return own
        file = Window.partitionBy("filenum")
        all_ = self.docs.select("docnum", "filenum").join(own, "docnum", "left")
        last = F.col("docnum") == F.max("docnum").over(file)
        return all_.select("docnum", F.when(last, F.max("maxdtf").over(file)).otherwise(0).alias("maxdtf"))

    @cached_property
    def info(self) -> DataFrame:
        """One row: n, numfiles, maxtf, maxdtf. Documents without terms count in n."""
        files = F.countDistinct("filenum") if "filenum" in self.docs.columns else F.count("*")
        n = self.docs.agg(F.count("*").alias("n"), files.alias("numfiles"))
        tf = self.terms.agg(F.coalesce(F.max("tf"), F.lit(0)).alias("maxtf"))
        dtf = self.postings.agg(F.coalesce(F.max("dtf"), F.lit(0)).alias("maxdtf"))
        return n.crossJoin(tf).crossJoin(dtf).select("n", "numfiles", "maxtf", "maxdtf", F.lit(self.stemmer is not None).alias("stemmed"))  # one row each

    def most_popular(self) -> DataFrame:
        return self.terms.orderBy(F.desc("tf"), "term").limit(1)

    def idf(self, kind: str) -> DataFrame:
        """(term, tf, idf)"""
        one = F.broadcast(self.info.select("n", "maxtf"))
        return self.terms.crossJoin(one).select("term", "tf", W.idf(kind, F.col("n"), F.col("tf"), F.col("maxtf")).alias("idf"))

    @cached_property
    def weights(self) -> DataFrame:
        """(docnum, maxdtf, dwt) of documents that have terms: one aggregation. The COMMON most frequent terms, which
        most postings have, are broadcast with their idf; only the other postings are joined by a shuffle."""
        p, d = self.profile, F.col("dtf")
        if p.index_idf == "one":
            weighed = self.postings.select("docnum", "dtf", F.lit(1.0).alias("idf"))
        else:
            idf = self.idf(p.index_idf)
            most = F.broadcast(idf.orderBy(F.desc("tf"), "term").limit(COMMON).select("term", "idf"))
            rest = self.postings.join(most.select("term"), "term", "left_anti").join(idf, "term")
            weighed = self.postings.join(most, "term").select("docnum", "dtf", "idf").unionByName(rest.select("docnum", "dtf", "idf"))
        sums = weighed.groupBy("docnum").agg(F.max(d).alias("maxdtf"), *[c.alias(k) for k, c in W.square_sums(p.damping, F.col("idf"), d).items()])
        if p.compat_multidoc:
            sums = sums.drop("maxdtf").join(self.maxdtf, "docnum")
        return sums.select("docnum", "maxdtf", W.norm(p.damping, F.col("maxdtf")).alias("dwt"))

    @cached_property
    def doc_stats(self) -> DataFrame:
        """(docnum, maxdtf, dwt) of all documents; those without terms weigh 0."""
        zero = lambda c, t: F.coalesce(c, F.lit(0)).cast(t).alias(c)
        return self.docs.select("docnum").join(self.weights, "docnum", "left").select("docnum", zero("maxdtf", "long"), zero("dwt", "double"))

    def posting_lists(self) -> DataFrame:
        """(term, tf, postings): lists in document order, a row a term; posting_blocks() is for terms of any frequency."""
        both = F.struct("docnum", "dtf")
        return self.postings.groupBy("term").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list(both)).alias("postings"))

    def posting_blocks(self, width: int = BLOCK) -> DataFrame:
        """(term, block, first, tf, gaps, dtfs): lists cut into blocks of width document numbers, each from its first
        number on, so that no row grows with a term's frequency and a hot term's blocks are many tasks' work."""
        block = F.floor(F.col("docnum") / width).cast("long").alias("block")
        parts = size(self.postings) // LISTS + 1  # lists are made where a part's rows meet; made before, they would be sorted and spilled twice
        rows = self.postings.select("term", "docnum", "dtf", block).repartition(parts, "term", "block")
        rows = rows.groupBy("term", "block").agg(F.sort_array(F.collect_list(F.struct("docnum", "dtf"))).alias("l"))  # width at most
        gaps = F.transform("l", lambda x, i: x["docnum"] - F.when(i == 0, F.col("l")[0]["docnum"]).otherwise(F.get("l", i - 1)["docnum"]))
        return rows.select("term", "block", F.col("l")[0]["docnum"].alias("first"), F.size("l").cast("long").alias("tf"), gaps.alias("gaps"), F.col("l.dtf").alias("dtfs"))

    def with_profile(self, profile: Profile) -> Index:
        return replace(self, profile=profile)

    def write(self, path: str, buckets: int | None = None) -> None:
        """Parquet tables under path, info last. Postings lie in ranges of term and document (so a hot term has many
        files) and sorted, so a term's rows are found by the statistics of row groups and pages. There are as many
        ranges as the bytes need, and buckets at least. Postings are counted once: the ranges come from what was
        written."""
        spark = self.docs.sparkSession
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        self.postings.write.mode("overwrite").parquet(f"{path}/counted")
        rows = spark.read.parquet(f"{path}/counted")
        ranges = max(buckets or 1, size(rows) // RANGE + 1)
        rows.repartitionByRange(ranges, "term", "docnum").sortWithinPartitions("term", "docnum").write.mode("overwrite").parquet(f"{path}/postings")
        saved = Stored(spark.read.parquet(f"{path}/docs"), path, self.profile, self.stemmer)
        saved.terms, saved.weights, saved.info  # written as they are asked for

    @staticmethod
    def read(spark: SparkSession, path: str, profile: Profile = SPARCK_JONES, stemmer: str | None = None) -> Index:
        return Stored(spark.read.parquet(f"{path}/docs"), path, profile, stemmer)


class Stored(Index):
    """An index whose tables are written under path by the first that asks for them, then read: postings need no terms,
    a Boolean search no weights. Profiles that cut words alike share all but the weights."""

    def __init__(self, docs: DataFrame, path: str, profile: Profile = SPARCK_JONES, stemmer: str | None = None):
        self.__dict__.update(docs=docs.drop("text"), texts=docs, path=path, profile=profile, stemmer=stemmer)

    def table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        spark, path = self.docs.sparkSession, f"{self.path}/{name}"
        if not exists(spark, f"{path}/_SUCCESS"):
            make().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    @cached_property
    def postings(self) -> DataFrame:
        return self.table("postings", lambda: segments(self.texts, self.profile, self.stemmer))

    @cached_property
    def terms(self) -> DataFrame:
        return self.table("terms", lambda: Index(self.docs, self.postings).terms.sortWithinPartitions("term"))

    @cached_property
    def weights(self) -> DataFrame:
        p = self.profile
        return self.table(f"weights-{p.index_idf}-{p.damping}{'-multidoc' if p.compat_multidoc else ''}", lambda: Index.weights.func(self))

    @cached_property
    def maxdtf(self) -> DataFrame:
        return Index.maxdtf.func(self) if self.profile.compat_multidoc else self.table("maxdtf", lambda: Index.maxdtf.func(self))

    @cached_property
    def info(self) -> DataFrame:
        return self.table("info", lambda: Index.info.func(self))

    def with_profile(self, profile: Profile) -> Index:
        return Stored(self.texts, self.path, profile, self.stemmer)


def segments(docs: DataFrame, profile: Profile, stemmer: str | None) -> DataFrame:
    """Postings in parts of neighbouring documents, each sorted by term and document. Texts are shuffled once, postings
    are not; what a task sorts is the postings of SEGMENT bytes of the documents' files, whatever their number."""
    rows = _words_counted(docs.repartitionByRange(size(docs) // SEGMENT + 1, "docnum"), profile, stemmer)
    return (added(rows) if repeats(docs) else rows).sortWithinPartitions("term", "docnum")


def build(docs: DataFrame, profile: Profile = SPARCK_JONES, stemmer: str | None = None) -> Index:
    """docs: docnum, text, and metadata that stays with docs."""
    return Index(docs.drop("text"), postings_of(docs, profile, stemmer), profile, stemmer)


def stored(docs: DataFrame, profile: Profile = SPARCK_JONES, stemmer: str | None = None) -> Index:
    """The index of docs, a frame over files, whose tables lie in the shared folder under a name of these files as they
    are now and of the way words are cut. So each is built once and looked up by every later search."""
    spark = docs.sparkSession
    words = (profile.word, profile.lower, profile.keeps_last_word)
    return Stored(docs, f"{root(spark)}/inkwell-index-{signature(docs, words, stemmer)}", profile, stemmer)


def merge(a: Index, b: Index) -> Index:
    """The index of both collections (document numbers should differ, else counts of one document add up)."""
    both, docs = a.postings.unionByName(b.postings), a.docs.unionByName(b.docs, allowMissingColumns=True)
    return Index(docs, added(both) if repeats(docs) else both, a.profile, a.stemmer)


def verify(terms: DataFrame, postings: DataFrame) -> DataFrame:
    """Terms whose stored frequency differs from their postings' number, or that only one side has; none if sound."""
    found = postings.groupBy("term").agg(F.count("*").alias("found"))
    return terms.join(found, "term", "full").where(~F.col("tf").eqNullSafe(F.col("found"))).select("term", "tf", "found")


def dgaps(postings: DataFrame) -> DataFrame:
    """(term, docnum, gap, dtf): differences of document numbers, the first from 0. Numbers are dealt in blocks, and
    the last of a term's block before is carried over, so a hot term is many tasks' work. What the blocks hold is kept:
    only the first row of a term and block, to which a number is carried, is shuffled again."""
    block = Window.partitionBy("term", "block")
    rows = postings.select("term", "docnum", "dtf", block_of("docnum").alias("block"))
    gap = F.col("docnum") - F.lag("docnum").over(block.orderBy("docnum"))
    rows = kept(rows.select("term", "docnum", gap.alias("gap"), "dtf", "block", F.max("docnum").over(block).alias("last")), "gaps")
    before = F.lag("last", 1, 0).over(Window.partitionBy("term").orderBy(F.asc_nulls_last("block")))
    firsts = rows.where("gap is null").select("term", "docnum", (F.col("docnum") - before).alias("gap"), "dtf")
    return rows.where("gap is not null").select("term", "docnum", "gap", "dtf").unionByName(firsts)


def from_dgaps(gaps: DataFrame) -> DataFrame:
    """(term, docnum, dtf) from rows that come in order of docnum under another name, seq: sums within blocks of seq,
    on top of the sums of the blocks before."""
    rows = gaps.select("term", "seq", "gap", "dtf", block_of("seq").alias("block"))
    so_far = Window.partitionBy("term").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("term", "block").agg(F.sum("gap").alias("sum")).select("term", "block", F.coalesce(F.sum("sum").over(so_far), F.lit(0)).alias("before"))
    w = Window.partitionBy("term", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(sums, ["term", "block"]).select("term", (F.sum("gap").over(w) + F.col("before")).alias("docnum"), "dtf")


def front_coded(terms: DataFrame) -> DataFrame:
    """(term, prefix_len, suffix): each term after the one before it in byte order. Terms are coded within ranges of
    a first character, each range starting afresh, as blocks of a sorted file do. The work is dealt by the first HEAD
    characters; the last term of the head before, a row a head, is carried over."""
    rows = terms.select("term", F.substring("term", 1, HEAD).alias("head"))
    last = rows.groupBy("head").agg(F.max("term").alias("last"))
    last = last.select("head", F.lag("last").over(Window.partitionBy(F.substring("head", 1, 1)).orderBy("head")).alias("before"))
    w = Window.partitionBy("head").orderBy("term")
    k = F.coalesce(common_prefix(F.coalesce(F.lag("term").over(w), F.col("before")), F.col("term")), F.lit(0))
    terms = rows.join(last, "head").withColumn("k", k).select("term", "k")
    k = F.col("k")
    return terms.select("term", k.cast("long").alias("prefix_len")).select("term", "prefix_len", F.substr("term", (F.col("prefix_len") + 1).cast("int")).alias("suffix"))


def range_scan(terms: DataFrame, first: str, last: str | None = None) -> DataFrame:
    keep = F.col("term") >= first if last is None else (F.col("term") >= first) & (F.col("term") < last)
    return terms.where(keep).orderBy("term")


def with_prefix(term: Column, prefix: str) -> Column:
    """A range that Parquet statistics can use; terms are ASCII, so U+FFFF ends it."""
    return (term >= prefix) & (term < prefix + "￿") & term.startswith(prefix)
