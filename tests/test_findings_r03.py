"""Cases of FINDINGS_r03.md, each of which failed before."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from inkwell.functions.stem import stem_terms
from inkwell.functions.text import tokenize
from inkwell.operators import index as ix
from inkwell.operators import search
from inkwell.plans import registry as R
from inkwell.plans.profile import MG
from inkwell.plans.registry import ORACLES, QUERIES
from inkwell.streaming import index as streaming


@pytest.fixture
def against_sql(spark, tmp_path, same):
    """A query and its SQL over rows of one table."""

    def check(name, table, schema, rows):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{table}.parquet"))
        c = duckdb.connect()
        c.sql(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
        same(QUERIES[name](spark, str(tmp_path)).toPandas(), c.sql(ORACLES[name]).df())

    return check


HTML = [
    "<title>a&amp;&amp;&amp</title><h1>b&amp</h1>&ampc", "caf&eacute; &#65;b &#x41; &notin; &lt &lt;i&gt; &amp;lt; &nbsp;x&nbspy&copy;z&middot;w", "<SCRIPT>a<b</SCRIPT>c<script>d", "e<!-- f > g -->h<!-- i", "j<k l<m>n", "<style\n>o</style>p<a\nhref='>'>q",
    "<ſcript>r</ſcript>s", "<![CDATA[t]]>u<?v?>w<!x>y", "", None, "z</script>z<b",
]


def test_html_text_is_its_sql(against_sql):
    """entities without a semicolon, and those outside the list, stay; so do tags that never end."""
    against_sql("html_text_terms", "pages", "page_id long, html string", list(enumerate(HTML)))


# documents of which some share a number, some have none, and some have no words

TEXT = ["the of the", "die der the", "of", "the the to of in", None, "", "...", "en to in the of nations standing", "The OF Kelvin", "x" * 300 + " the"]
DOCS = "doc_id long, text string"


def numbered(*ids):
    """No two texts weigh the same: equal scores would go by the last bits of sums, in SQL too."""
    texts = [TEXT[k % len(TEXT)] for k in range(len(ids))]
    return [(i, t and t + "".join(f" q{j}" for j in range(k))) for k, (i, t) in enumerate(zip(ids, texts))]


ONCE, TWICE = numbered(*range(0, 60_000, 1000)), numbered(*range(0, 30_000, 1000), *range(0, 30_000, 3000), 5, 5, 5)
OF_WORDS = "term_doc_freq dgaps dgap_roundtrip posting_blocks index_merge index_verify stream_index idf_int_table term_df all_terms set_members doc_weight doc_weight_mg doc_weight_mg_int doc_weight_tf_only stdin_request ranked_topk ranked_mg_int page_first page_clamped bool_error bool_nested".split()


@pytest.mark.parametrize("name", OF_WORDS)
@pytest.mark.parametrize("rows", [ONCE, TWICE, []], ids=["once", "twice", "empty"])
def test_odd_documents(against_sql, name, rows):
    against_sql(name, "documents", DOCS, rows)


@pytest.fixture
def index(spark, tmp_path):
    spark.createDataFrame(ONCE, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    return R.built(spark, str(tmp_path))


def tables(index):
    p = Path(index.path.removeprefix("file://"))
    return {x.name for x in p.iterdir()} if p.exists() else set()


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_searches_build_what_they_need(index, spark):
    """Tables of an index are made when they are asked for, and profiles that
    cut words alike share all but the weights. Before, each profile's first search wrote all of them."""
    assert tables(index) == set()
    assert search.all_terms(index, "the of").count() and search.boolean(index, "the and of").count()
    assert tables(index) == {"postings"}
    index.idf("n_int").count()
    assert tables(index) == {"postings", "terms", "info"}
    files = index.postings.inputFiles()
    mg = ix.stored(index.texts, MG)
    search.ranked(mg, "the of").collect()
    assert mg.postings.inputFiles() == files
    assert tables(index) == {"postings", "terms", "info", "weights-n-log"}


def test_errors_build_nothing(index):
    """an expression with an error needs no index."""
    assert search.boolean(index, "the of").count() == 0 and tables(index) == set()


def test_words_are_counted_where_they_are_read(index, spark):
    """postings are not shuffled where every number comes once."""
    docs = index.texts
    assert shuffles(ix.postings_of(docs)) == shuffles(ix.postings_of(docs, stemmer="lovins")) == 0
    assert shuffles(ix.merge(ix.build(docs.where("docnum % 2 = 0")), ix.build(docs.where("docnum % 2 = 1"))).postings) == 0
    assert shuffles(ix.postings_of(docs.union(docs))) > 0


def test_stems_are_those_of_terms(index, spark):
    """stems of a document's words are what the terms' stems joined to its postings give."""
    stems = stem_terms(index.postings.select("term").distinct(), "lovins")
    want = index.postings.join(stems, "term").groupBy(F.col("stem").alias("term"), "docnum").agg(F.sum("dtf").alias("dtf"))
    got = ix.postings_of(index.texts, stemmer="lovins")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("term", "docnum", "dtf").collect()))


def test_gaps_read_texts_once(index, spark):
    """Blocks are kept, so neither direction cuts the texts into words again."""
    gaps = ix.dgaps(ix.postings_of(index.texts))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan(gaps) and "text" not in plan(ix.from_dgaps(gaps.withColumnRenamed("docnum", "seq")))


def test_parts_are_bounded(index, monkeypatch, spark, tmp_path):
    """a task sorts the postings of so many bytes, not a part of all of them."""
    monkeypatch.setattr(ix, "RANGE", 64)
    monkeypatch.setattr(ix, "SEGMENT", 64)
    ix.build(index.texts).write(str(tmp_path / "index"), 2)
    assert len(ix.Index.read(spark, str(tmp_path / "index")).postings.inputFiles()) > 8
    assert len(index.postings.inputFiles()) > 8


def test_streamed_batches_are_not_shuffled(spark, tmp_path):
    """F8: a document that comes in two batches has its counts added up; without such, batches are read as they are."""
    at = lambda name: str(tmp_path / name)
    for k, rows in enumerate((ONCE[:30], ONCE[30:], ONCE[25:35])):
        spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(at(f"docs{k}"))

    def run(name, last):
        d = streaming.read_documents(spark, at(f"docs[0-{last}]"), files=1).select(F.col("doc_id").alias("docnum"), "text")
        streaming.maintain(d, at(name), at(f"{name}-state")).awaitTermination()
        got = streaming.postings(spark, at(name))
        want = spark.read.parquet(*[at(f"docs{k}") for k in range(last + 1)]).select(F.col("doc_id").alias("docnum"), F.explode(tokenize(F.col("text"))).alias("term")).groupBy("term", "docnum").count()
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        return shuffles(got)

    assert run("once", 1) == 0 and run("twice", 2) > 0


def test_weights_by_common_and_other_terms(index, monkeypatch):
    """terms that are broadcast and terms that are joined add up to one weight."""
    want = {tuple(r) for r in index.doc_stats.select("docnum", "maxdtf", F.round("dwt", 9)).collect()}
    for n in (0, 2, 5):
        monkeypatch.setattr(ix, "COMMON", n)
        got = ix.Index(index.docs, index.postings).doc_stats
        assert {tuple(r) for r in got.select("docnum", "maxdtf", F.round("dwt", 9)).collect()} == want


def test_blocks_are_dealt_with_the_texts(index):
    """Postings of texts dealt in blocks meet in windows over term and block without another shuffle."""
    rows = ix.postings_of(ix.in_blocks(index.texts)).withColumn("block", ix.block_of("docnum"))
    assert shuffles(rows.withColumn("last", F.max("docnum").over(Window.partitionBy("term", "block")))) == 1
