"""Whole tables of queries that SQL cannot say, against slow versions that share no code with them."""

import re

import pytest
from pyspark.sql import functions as F

from inkwell.functions import stem
from inkwell.functions.ctokens import TOKENS, named_tokens
from inkwell.operators import index as ix
from inkwell.operators import locks, paging, search
from inkwell.plans import registry as R

# Lovins: conditions and recodings one by one, by the letters at the end

ends = lambda *xs: lambda s: s.endswith(xs)
no = lambda *xs: lambda s: not s.endswith(xs)
both = lambda *fs: lambda s: all(f(s) for f in fs)
least = lambda n: lambda s: len(s) >= n
u_e = lambda s: len(s) >= 3 and s[-3] == "u" and s[-1] == "e"
CONDITIONS = {
    "A": least(2), "B": least(3), "C": least(4), "D": least(5), "E": no("e"), "F": both(least(3), no("e")), "G": both(least(3), ends("f")), "H": ends("t", "ll"), "I": no("o", "e"), "J": no("a", "e"),
    "K": both(least(3), lambda s: s[-1] in "li" or u_e(s)), "L": lambda s: s.endswith("os") or s[-1] not in "uxs", "M": no("a", "c", "e", "m"), "N": lambda s: len(s) >= (4 if s[-3:-2] == "s" else 3), "O": ends("l", "i"),
    "P": no("c"), "Q": both(least(3), no("l", "n")), "R": ends("n", "r"), "S": lambda s: s.endswith("dr") or (s[-1] == "t" and s[-2] != "t"), "T": lambda s: s[-1] == "s" or (s[-1] == "t" and s[-2] != "o"),
    "U": ends("l", "m", "n", "r"), "V": ends("c"), "W": no("s", "u"), "X": lambda s: s[-1] in "li" or u_e(s), "Y": ends("in"), "Z": no("f"), "AA": ends("d", "f", "ph", "th", "l", "er", "or", "es", "t"),
    "BB": lambda s: len(s) >= 3 and s != "met" and not s.endswith("ryst"), "CC": ends("l"),
}
RECODINGS = """iev ief|uct uc|umpt um|rpt rb|urs ur|istr ister|metr meter|olv olut|ul l aoi|bex bic|dex dic|pex pic|tex tic|ax ac|ex ec|ix ic|lux luc|uad uas|vad vas|cid cis|lid lis|erid eris|pand pans|end ens|ond ons|lud lus|rud rus|her hes pt|mit mis|ert ers|et es n|yt ys|yz ys"""


def slow_lovins(word):
    if len(word) <= 2:
        return word
    out = word
    for cut in range(2, len(word)):
        rest, end = word[:cut], word[cut:]
        if end in stem.LOVINS and CONDITIONS[stem.LOVINS[end]](rest):
            out = rest
            break
    if re.search(r"(bb|dd|gg|ll|mm|nn|pp|rr|ss|tt)$", out):
        out = out[:-1]
    for rule in RECODINGS.split("|"):
        end, to, *barred = rule.split()
        if out.endswith(end) and not (barred and out[: -len(end)].endswith(tuple(barred[0]))):
            return out[: -len(end)] + to
    return out


# Porter: the measure by a pattern on the word itself

CONS, VOW = "[^aeiou]", "[aeiouy]"
C, V = f"{CONS}[^aeiouy]*", f"{VOW}[aeiou]*"
M0, M1, MV = re.compile(f"^({C})?{V}{C}"), re.compile(f"^({C})?{V}{C}({V})?$"), re.compile(f"^({C})?{VOW}")
M2, CVC = re.compile(f"^({C})?{V}{C}{V}{C}"), re.compile(f"^{C}{VOW}[^aeiouwxy]$")
TWO = "ational ate,tional tion,enci ence,anci ance,izer ize,bli ble,alli al,entli ent,eli e,ousli ous,ization ize,ation ate,ator ate,alism al,iveness ive,fulness ful,ousness ous,aliti al,iviti ive,biliti ble,logi log"
THREE = "icate ic,ative ,alize al,iciti ic,ical ic,ful ,ness "
FOUR = re.compile(r"^(.+?)(al|ance|ence|er|ic|able|ible|ant|ement|ment|ent|ou|ism|ate|iti|ous|ive|ize)$")


def slow_porter(w):
    if len(w) < 3:
        return w
    y = w[0] == "y"
    w = "Y" + w[1:] if y else w
    w = re.sub(r"(ss|i)es$", r"\1", w) if re.search(r"(ss|i)es$", w) else re.sub(r"([^s])s$", r"\1", w)
    if m := re.match(r"^(.+?)eed$", w):
        w = w[:-1] if M0.match(m[1]) else w
    elif (m := re.match(r"^(.+?)(ed|ing)$", w)) and MV.match(m[1]):
        w = m[1]
        if re.search(r"(at|bl|iz)$", w):
            w += "e"
        elif re.search(r"([^aeiouylsz])\1$", w):
            w = w[:-1]
        elif CVC.match(w):
            w += "e"
    if (m := re.match(r"^(.+?)y$", w)) and MV.match(m[1]):
        w = m[1] + "i"
    for table in (TWO, THREE):
        for rule in table.split(","):
            end, to = rule.split(" ")
            if w.endswith(end) and len(w) > len(end) and not any(w.endswith(r.split(" ")[0]) and len(r.split(" ")[0]) > len(end) and len(w) > len(r.split(" ")[0]) for r in table.split(",")):
                w = w[: -len(end)] + to if M0.match(w[: -len(end)]) else w
                break
    if m := FOUR.match(w):
        w = m[1] if M2.match(m[1]) else w
    elif (m := re.match(r"^(.+?)(s|t)(ion)$", w)) and M2.match(m[1] + m[2]):
        w = m[1] + m[2]
    if m := re.match(r"^(.+?)e$", w):
        w = m[1] if M2.match(m[1]) or (M1.match(m[1]) and not CVC.match(m[1])) else w
    if w.endswith("ll") and M2.match(w):
        w = w[:-1]
    return "y" + w[1:] if y else w


WORDS = """alistic national nationally nationals standing cats caresses ponies ties feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional
    rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize
    electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize
    probate rate cease controll roll metal induction magnetically believe assumption absorption reverse register thermometer resolve vertical biographer admit invert beget analyze dissolve index matrix evaluation sitting matrices yes yttrium
    dying cosmetic psychology controlling swimmer indices axes saying""".split()


@pytest.mark.parametrize("name,slow", [("lovins", slow_lovins), ("porter", slow_porter)])
def test_stems_of_all_terms(spark, sf_dir, name, slow):
    got = {r["term"]: r["stem"] for r in getattr(R, f"stem_{name}_terms")(spark, sf_dir).collect()}
    got |= {w: stem.STEMMERS[name](w) for w in WORDS}
    assert len(got) > 1_000
    assert {w: s for w, s in got.items() if w.isascii() and w.isalpha() and s != slow(w)} == {}


def test_ranked_by_stems(spark, sf_dir):
    """Counts by stem, by hand; the scores as SQL has them for words."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for r in rows:
        for w in re.findall("[A-Za-z0-9]+", r["text"] or ""):
            t = slow_lovins(w.lower()[:253])
            want[t, r["doc_id"]] = want.get((t, r["doc_id"]), 0) + 1
    i = R.built(spark, sf_dir, stemmer="lovins")
    assert {(r["term"], r["docnum"]): r["dtf"] for r in i.postings.collect()} == want
    query = {slow_lovins(w) for w in "nations standing of the".split()}
    hits = {}
    for t, d in want:
        if t in query:
            hits[d] = hits.get(d, 0) + 1
    top = R.ranked_stemmed(spark, sf_dir).collect()
    assert len(top) == 10 and all(hits[r["docnum"]] == r["hits"] for r in top)


# locks: what is carried is the queue and the group's mode (which leaves out conversions for an instant until the next change)

RANK = {"NONE": 0, "IS": 1, "IX": 2, "S": 3, "SIX": 4, "U": 5, "X": 6}
MEET = {frozenset(p.split()) for p in ("IS", "IS IX", "IS S", "IS SIX", "IX", "S", "S U")}
JOIN = {frozenset(("IX", "S")): "SIX", frozenset(("IX", "U")): "X", frozenset(("S", "SIX")): "SIX", frozenset(("SIX", "U")): "SIX"}


def meets(a, b):
    return "NONE" in (a, b) or frozenset((a, b)) in MEET


def joined(a, b, want=locks.SUPREMUM):
    return a if a == b else want[a, b]


def slow_replay(log):
    queues, groups, out = {}, {}, []
    for r in sorted(log, key=lambda r: r["seq"]):
        q = queues.setdefault(r["lockable"], [])
        own = next((x for x in q if x["owner"] == r["owner"]), None)
        held = lambda: [x for x in q if x["state"] != "W"]  # noqa: B023, E731

        def join(mode):
            groups[r["lockable"]] = joined(mode, groups[r["lockable"]])  # noqa: B023

        def settle():
            """Wakes conversions that can run, then waiters in order while nothing before them is pending."""
            gone, pending = [], False
            groups[r["lockable"]] = "NONE"  # noqa: B023
            for x in list(q):  # noqa: B023
                if x["state"] == "C" and all(meets(x["want"], y["mode"]) for y in held() if y is not x):  # noqa: B023
                    if x["want_for"] != "instant":
                        x["mode"] = joined(x["want"], x["mode"])
                        x["for"] = "commit" if x["want_for"] == "commit" else x["for"]
                        join(x["mode"])
                    else:
                        gone.append(x["owner"])
                    x["n"], x["state"] = x["n"] + 1, "G"
                    continue
                elif x["state"] == "C":
                    pending = True
                elif x["state"] == "W":
                    if pending or not meets(x["mode"], groups[r["lockable"]]):  # noqa: B023
                        break
                    x["state"] = "G"
                    gone += [x["owner"]] if x["for"] == "instant" else []
                join(x["mode"])
            for owner in gone:
                drop(owner, False)

        def drop(owner, force):
            x = next((x for x in q if x["owner"] == owner), None)  # noqa: B023
            if x is None:
                return "OK"
            if not force:
                if x["for"] == "commit":
                    return "HELD"
                x["n"] -= 1
                if x["n"] > 0:
                    return "HELD"
            q.remove(x)  # noqa: B023
            settle()
            return "OK"

        mode, status = r["mode"], None
        if r["op"] == "find":
            status = own["mode"] if own else "NONE"
        elif r["op"] == "release":
            status = drop(r["owner"], r["force"])
        elif r["op"] == "downgrade":
            if own is None or own["mode"] == mode:
                status = "OK"
            elif joined(mode, own["mode"]) != own["mode"]:
                status = "INVALID"
            else:
                own["mode"], status = mode, "OK"
                settle()
        elif own is None:
            free = all(x["state"] == "G" for x in q) and meets(mode, groups.setdefault(r["lockable"], "NONE"))
            status = ("GRANTABLE" if r["duration"] == "instant" else "GRANTED") if free else "TIMEOUT" if r["timeout"] == 0 else "WAITING"
            if status == "GRANTED":
                join(mode)
            if status in ("GRANTED", "WAITING"):
                q.append({"owner": r["owner"], "mode": mode, "for": r["duration"], "n": 1, "state": status[0]})
        elif own["state"] != "G":
            status = "INVALID"
        elif mode == own["mode"] or all(meets(mode, x["mode"]) for x in held() if x is not own):
            status = "GRANTABLE" if r["duration"] == "instant" else "GRANTED"
            if status == "GRANTED":
                own["mode"], own["n"] = joined(mode, own["mode"]), own["n"] + 1
                own["for"] = "commit" if r["duration"] == "commit" else own["for"]
                join(own["mode"])
        elif r["timeout"] == 0:
            status = "TIMEOUT"
        else:
            own |= {"state": "C", "want": mode, "want_for": r["duration"]}
            status = "WAITING"
        now = next((x["mode"] for x in q if x["owner"] == r["owner"]), "NONE")
        out.append((r["seq"], r["owner"], r["lockable"], r["op"], mode, status, now, groups.get(r["lockable"], "NONE"), len(held()), len(q) - len(held())))
    return out


COLUMNS = [c.split()[0] for c in locks.OUT.split(", ")]


@pytest.mark.parametrize("timeout", [0, -1])
@pytest.mark.parametrize("kinds", [("manual", "instant"), ("manual", "instant", "commit")])
def test_lock_replay(spark, sf_dir, timeout, kinds):
    log = R.lock_log(spark, sf_dir).withColumn("timeout", F.lit(timeout))
    log = log.withColumn("duration", F.element_at(F.array(*map(F.lit, kinds)), (F.pmod(F.xxhash64(F.lit("k"), "seq"), F.lit(len(kinds))) + 1).cast("int"))).withColumn("lockable", F.pmod("lockable", F.lit(7)))
    got = sorted(tuple(r) for r in locks.replay(log).select(*COLUMNS).collect())
    assert got == sorted(slow_replay([r.asDict() for r in log.collect()]))


def test_lock_tables():
    assert all(locks.COMPATIBLE[a, b] == meets(a, b) for a in RANK for b in RANK)
    assert all(locks.SUPREMUM[a, b] == JOIN.get(frozenset((a, b)), locks.SUPREMUM[a, b]) and locks.SUPREMUM[a, b] == locks.SUPREMUM[b, a] for a in RANK for b in RANK)


def test_streamed_locks_are_the_replay(spark, sf_dir):
    rows = lambda df: sorted(tuple(r) for r in df.select(*COLUMNS).collect())
    assert rows(R.stream_locks(spark, sf_dir)) == rows(R.lock_replay(spark, sf_dir))


def test_queries_without_sql():
    """Each of them is compared above."""
    assert set(R.QUERIES) - set(R.ORACLES) == {"stem_lovins_terms", "stem_porter_terms", "ranked_stemmed", "lock_replay", "stream_locks"}


# other forms of one result


@pytest.mark.parametrize("size,number", [(7, 1), (7, 9), (7, 10**6), (1000, 2)])
@pytest.mark.parametrize("near", [0, 30, 10_000])
def test_deep_pages(spark, near, size, number):
    rows = spark.range(211).select(F.col("id").alias("docnum"), (F.pmod(F.xxhash64("id"), F.lit(20)) / 4).alias("score"))
    all_ = [(r["docnum"], r["score"]) for r in rows.orderBy(F.desc("score"), "docnum").collect()]
    page = paging.page_of(211, size, number)
    got = [(r["docnum"], r["score"]) for r in paging.page_rows(rows, page, near=near).collect()]
    assert got == all_[page.start - 1 : page.stop]
    assert paging.page_rows(rows.limit(0), paging.page_of(0, size, number), near=near).count() == 0


def test_gaps_and_fronts_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(ix, "BLOCK", 8)
    monkeypatch.setattr(ix, "HEAD", 2)
    p = spark.range(300).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("w"), (F.col("id") % 17).cast("string"))).alias("term"), F.pmod(F.xxhash64("id"), F.lit(500)).alias("docnum"), F.lit(1).cast("long").alias("dtf")).distinct()
    by = {}
    for t, d in sorted((r["term"], r["docnum"]) for r in p.collect()):
        by.setdefault(t, []).append(d)
    want = sorted((t, d, d - b) for t, ds in by.items() for b, d in zip([0, *ds], ds))  # noqa: B905
    gaps = ix.dgaps(p)
    assert sorted((r["term"], r["docnum"], r["gap"]) for r in gaps.collect()) == want
    assert sorted((r["term"], r["docnum"]) for r in ix.from_dgaps(gaps.withColumnRenamed("docnum", "seq")).collect()) == sorted((t, d) for t, ds in by.items() for d in ds)
    blocks = ix.Index(p.select("docnum").distinct(), p).posting_blocks(8).collect()
    back = {}
    for r in sorted(blocks, key=lambda r: r["block"]):
        at = r["first"]
        for g in r["gaps"]:
            at += g
            back.setdefault(r["term"], []).append(at)
    assert back == by and max(len(r["gaps"]) for r in blocks) <= 8


def test_stored_index_is_found_again(spark, sf_dir):
    """A search reads the stored index with its terms pushed down; a changed file gets an index of its own."""
    i = R.built(spark, sf_dir)
    assert R.built(spark, sf_dir).postings.inputFiles() == i.postings.inputFiles()
    plan = i.postings.where(F.col("term").isin("the", "of"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term, [of,the])]" in plan or "PushedFilters: [In(term" in plan
    assert search.all_terms(i, "the of").count() > 0


def test_c_token_names():
    source = "typedef unsigned long size; typedef int (*call)(size n), pair[2]; size f(pair p) { return p[0] >>= 1 ... 'x' L\"y\" 1.5e3f 0x1FuL a->b; } @ _Bool"
    got = [t for _, _, t, _ in named_tokens(source)]
    assert got[:5] == ["TYPEDEF", "UNSIGNED", "LONG", "IDENTIFIER", "SEMI"] and got[-3:] == ["BADTOK", "BOOL", "EOI"]
    assert [t for _, _, t, x in named_tokens(source) if x in ("size", "pair")] == ["IDENTIFIER", "TYPEDEF_NAME", "IDENTIFIER", "TYPEDEF_NAME", "TYPEDEF_NAME"]
    assert set(got) <= TOKENS and len(TOKENS) == 91


@pytest.mark.parametrize("width", [1, 5, 4096])
def test_quota_over_blocks(spark, width):
    from inkwell.sources import crawl

    rows = [(k, f"http://{'hot' if k % 3 else 'h' + str(k % 7)}.example.com/{k}", "x" * (k * 37 % 101)) for k in range(200)]
    got = sorted(r["page_id"] for r in crawl.within_quota(spark.createDataFrame(rows, "page_id long, url string, html string"), 700, width).collect())
    used, want = {}, []
    for k, url, html in rows:
        h = url.split("/")[2]
        if used.get(h, 0) < 700:
            want.append(k)
        used[h] = used.get(h, 0) + len(html)
    assert got == want
