"""Codecs, stemmers, URLs, links, locks, streams."""

import pytest
from pyspark.sql import functions as F

from inkwell.functions import codec, text, urls
from inkwell.functions.ctokens import tokens
from inkwell.functions.stem import LOVINS, lovins, porter
from inkwell.operators import locks
from inkwell.sources import crawl

PORTER = "sensibility sensibl replacement replac irritant irrit adjustment adjust dependent depend adoption adopt communism commun activate activ angularity angular homologous homolog effective effect bowdlerize bowdler rate rate cease ceas sky sky roll roll generalization gener".split()


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("word,stem", list(zip(PORTER[::2], PORTER[1::2], strict=True)))
def test_porter(word, stem):
    assert porter(word) == stem


def test_lovins():
    assert [lovins(w) for w in ("nationally", "sitting", "metallic", "is")] == ["nat", "sit", "metal", "is"]
    assert len(LOVINS) == 292


@pytest.mark.parametrize("x,g,d", [(1, "1", "1"), (2, "010", "0100"), (3, "011", "0101"), (9, "0001001", "00100001"), (17, "000010001", "001010001")])
def test_codes(spark, x, g, d):
    v = F.col("v").cast("long")
    assert one(spark, codec.gamma(v), v=x) == g
    assert one(spark, codec.delta(v), v=x) == d
    assert one(spark, codec.unary(v), v=x) == "0" * (x - 1) + "1"


def test_decode(spark):
    assert one(spark, codec.decode(F.col("v"), "gamma"), v="00100" + "1" + "011" + "010" + "010" + "00100" + "011" + "0") == [4, 1, 3, 2, 2, 4, 3]
    assert one(spark, codec.decode(F.col("v"), "delta"), v="00100001" + "1") == [9, 1]


def test_urls(spark):
    assert one(spark, urls.encoded(F.col("v")), v="a b<c>") == "a%20b%3cc%3e"
    assert one(spark, urls.encoded(F.col("v"), "+"), v="a b<c>") == "a+b%3cc%3e"
    assert one(spark, urls.decoded(F.col("v")), v="a%20b+c") == "a b+c"
    assert one(spark, urls.query_decoded(F.col("v")), v="a%20b+c") == "a b c"
    assert one(spark, urls.joined(F.col("b"), F.col("v")), b="http://h/a/b/c.html", v="../d.html") == "http://h/a/d.html"
    assert one(spark, urls.relative(F.col("b"), F.col("v")), b="http://h/a/b/c.html", v="http://h/a/d.html?x") == "../d.html?x"


def test_text(spark):
    t = F.col("v")
    assert one(spark, text.tokenize(t), v="für K1elvin \u212a") == ["f", "r", "k1elvin"]
    assert one(spark, text.tokenize(t), v="x" * 300) == ["x" * 253]
    assert one(spark, text.binary_guard(t, 2), v="ab éc dé ef") == "ab éc "
    assert one(spark, text.binary_guard(t, 3), v="ab éc dé ef") == "ab éc dé ef"
    assert one(spark, text.split_fields(t), v="a  ^^b^") == ["a", "", "b", ""]
    assert one(spark, text.absolute_link(t, "h"), v="a b.html") == "http://h/a%20b.html"
    assert one(spark, text.result_title(F.lit(""), F.lit(""), t), v="n") == "n"


def test_links(spark):
    pages = spark.createDataFrame([(1, "http://A.com:80/x/y.html#f", '<a class=q href="z.html">z</a><IMG SRC="i.png"><meta http-equiv=refresh content="0; url=http://b.org/">')], "page_id long, url string, html string")
    found = {(r["tag"], r["link"]) for r in crawl.links(pages).collect()}
    assert found == {("a", "z.html"), ("img", "i.png"), ("meta", "http://b.org/")}
    u = F.col("url")
    row = pages.select(crawl.canonical(u).alias("c"), crawl.resolved(u, F.lit("z.html")).alias("r"), crawl.accepted(u, ["*.gif"]).alias("a"), crawl.below(u, "/x/").alias("b"), crawl.in_domains(u, ["com"], ["a.com"]).alias("d")).first()
    assert tuple(row) == ("http://a.com/x/y.html", "http://A.com:80/x/z.html", True, True, False)
    assert crawl.robots_rules("User-agent: *\nDisallow: /a\n\nUser-agent: inkwell\nDisallow: /b # c\n") == ["/b"]
    assert crawl.robots_rules("User-agent: *\nDisallow: /a\n") == ["/a"]


def test_reach(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (9, 8)], "src long, dst long")
    got = {r["node"]: r["depth"] for r in crawl.reachable(edges, spark.createDataFrame([(0,)], "node long"), 3).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3}


def test_lock_scenario():
    lock = locks.Lock()
    assert lock.acquire(1, "S") == "GRANTED" and lock.acquire(2, "S") == "GRANTED"
    assert lock.acquire(3, "X") == "WAITING" and lock.acquire(1, "X") == "WAITING"
    assert lock.release(2) and lock.find(1) == "X" and lock.of(1).status == "GRANTED"
    assert lock.acquire(2, "S") == "WAITING"
    assert lock.downgrade(1, "S") == "OK" and lock.of(3).status == "WAITING"
    assert not lock.release(1) and lock.release(1)
    assert lock.of(3).status == "GRANTED" and lock.of(2).status == "WAITING"
    assert lock.release(3) and lock.of(2).status == "GRANTED" and lock.release(2) and not lock.queue


def test_lock_rules():
    lock = locks.Lock()
    assert lock.acquire(1, "U", "commit") == "GRANTED" and not lock.release(1) and lock.release(1, force=True)
    assert lock.acquire(1, "X", "instant") == "GRANTABLE" or lock.find(1) == "X"
    lock = locks.Lock()
    lock.acquire(1, "S")
    assert lock.acquire(2, "X", timeout=0) == "TIMEOUT" and lock.downgrade(1, "X") == "INVALID"
    assert locks.COMPATIBLE["S", "U"] and not locks.COMPATIBLE["U", "IS"]


def test_stream_replay_is_batch_replay(spark, tmp_path):
    rows = [(k, k % 3, k % 2, ("acquire", "acquire", "release")[k % 3 if k % 5 else 2], ("S", "X", "IS", "U")[k % 4], "manual", -1, False) for k in range(60)]
    schema = "seq long, owner long, lockable long, op string, mode string, duration string, timeout int, force boolean"
    log = spark.createDataFrame(rows, schema)
    log.coalesce(1).write.parquet(str(tmp_path / "log"))
    from inkwell.streaming.index import stream_replay

    s = spark.readStream.schema(schema).parquet(str(tmp_path / "log"))
    q = stream_replay(s).writeStream.format("memory").queryName("replayed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("replayed").collect())) == sorted(map(tuple, locks.replay(log).collect()))


def test_c_tokens():
    got = tokens('#include <a.h>\nint x = 0x1F + 1.5e3; /* c */ char *s = "a\\"b"; // end\nx >>= 2;')
    assert [t for _, _, t in got] == ["#include <a.h>", "int", "x", "=", "0x1F", "+", "1.5e3", ";", "char", "*", "s", "=", '"a\\"b"', ";", "x", ">>=", "2", ";"]
    assert got[1][1] == "keyword" and got[2][1] == "identifier"
