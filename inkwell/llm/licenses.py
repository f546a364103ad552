"""Licence scans: normalised text against templates by the Dice coefficient over word bigrams (native SQL only).

Normalised: A-Z in lower case, `licence` spelt `license`, words of a-z, 0-9 and non-ASCII characters. What is compared
to a template is a unit of a text: the whole (t), each paragraph of several lines (p1, p2, ..), each line (l1, ..) and,
in lines of several sentences, each sentence (s1.1, ..); for licences that none of these shows, each run of two or more
neighbouring paragraphs (r2-4, ..); and, in a list of their own, passages: any words that follow each other (w17-180),
for templates of WORDY bigrams. A shorter notice must stand alone as a line or sentence: a few words in the middle of
others ("under the MIT license") would match too easily. Bigrams count with their repeats, so a unit of m bigrams and a
template of b have 2 overlap / (m + b).

Prunings, none of which loses a match. Size bounds: only m from b t / (2 - t) to b (2 - t) / t can reach the threshold
t. Probes: a match lacks at most b - t (m + b) / 2 of the template's bigrams, so it holds one of any set of one more;
such a set, of rare words, is picked for every template once, and texts without one go in the first pass, which shuffles
nothing. Overlap: of the other distinct texts all bigrams are counted, and only templates whose overlap with the whole
text is enough for the smallest unit are candidates for its units. What is broadcast are constants of the program.

Of each unit the best template counts (ties: the first listed), of each licence its best unit. Runs and passages are not
spelt out: of a text's bigrams of a template, each knows the last start from which it still counts (its n-th like before
it does not lie behind that), so the overlaps of all stretches from one start are running sums. Only stretches whose
ends touch such bigrams are looked at (others can be trimmed to a better one). Of runs that overlap the best one counts.

Defined cases: null and empty texts have no findings; a null or repeated doc_id keeps its rows, one a row of the table;
texts are scanned whole; an empty table gives no rows; no templates give no findings; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm.shared import dealt_by_bytes, table, written
from inkwell.llm.templates import TEMPLATES

DICE = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARK = "\x01"  # between sentences
SENTENCE, REST, PARAGRAPH = r"[.;!?]+[ \t]+", r"[^a-z0-9\x{80}-\x{10FFFF}\n\x01]+", r"\n(?:[ \x01]*\n)+"
COMMON = set("a an and any are as at be by for from if in is it may not of on or that the this to with you".split())
KINDS = {"t": 0, "p": 1, "l": 2, "s": 3}
WORDY = (32, 1_000)  # bigrams of templates whose passages are looked for
LONG = 500  # bigrams of the least unit of a long template: shorter texts are not held against its probes


def template_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.translate(str.maketrans(UPPER, LOWER)).replace("licence", "license"))


def bounds(b: int, dice: float) -> tuple[int, int]:
    """Least and most bigrams of a unit that can reach dice with b."""
    return math.ceil(b * dice / (2 - dice) - 1e-9), math.floor(b * (2 - dice) / dice + 1e-9)


class Templates:
    """Bigrams, bounds and probes of (licence, text) pairs."""

    def __init__(self, templates=TEMPLATES, dice: float = DICE):
        self.dice, self.names, self.grams = dice, [], []
        for name, text in templates:
            w = template_words(text)
            if len(w) > 1:
                self.names.append(name)
                self.grams.append(Counter(zip(w, w[1:], strict=False)))
        self.sizes = [sum(g.values()) for g in self.grams]
        self.bounds = [bounds(b, dice) for b in self.sizes]

    def probes(self, k: int) -> list[tuple[str, str]]:
        b, low = self.sizes[k], self.bounds[k][0]
        spare = b - math.ceil(dice_overlap(low, b, self.dice))
        out, held = [], 0
        for gram in sorted(self.grams[k], key=lambda g: (sum(x in COMMON for x in g), -len(g[0] + g[1]), g)):
            if held > spare:
                break
            out.append(gram)
            held += self.grams[k][gram]
        return out

    def members(self, spark: SparkSession) -> DataFrame:
        """(gram, template, n, size, least, most, licence) of all bigrams; a constant, written once, to be broadcast."""
        rows = [(f"{a} {b}", k, n, self.sizes[k], *self.bounds[k], self.names[k]) for k, g in enumerate(self.grams) for (a, b), n in g.items()]
        return F.broadcast(written(spark, spark.createDataFrame(rows, "gram string, template int, n int, size int, least int, most int, licence string").coalesce(1), "licence-bigrams"))


def dice_overlap(m: int, b: int, dice: float) -> float:
    return dice * (m + b) / 2 - 1e-9


def normalised(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.replace(F.regexp_replace(F.regexp_replace(low, SENTENCE, MARK), REST, " "), F.lit("licence"), F.lit("license"))


def words(normal: Column) -> Column:
    return F.split(F.trim(F.translate(normal, "\n" + MARK, "  ")), " +")


def side_by_side(ws: Column) -> Column:
    """The bigrams of an array of words, and a null at its end. Evaluates ws once."""
    pair = lambda w: F.zip_with(w, F.slice(w, 2, F.lit(1 << 30)), lambda x, y: F.concat(x, F.lit(" "), y))
    return F.transform(F.array(ws), pair)[0]


def spellings(a: str, b: str) -> set[str]:
    both = lambda w: {w, w.replace("license", "licence")}
    return {f"{x} {y}" for x in both(a) for y in both(b)}


def with_probes(texts: DataFrame, t: Templates) -> DataFrame:
    """(blob_id, text), once each, of texts whose words hold a probe side by side, as those of any matching unit do.
    lower() leaves ASCII words and the bounds of all words as they are; spellings are all in the probes."""
    short, long = set(), set()
    for k in range(len(t.names)):
        (long if t.bounds[k][0] >= LONG else short).update(x for a, b in t.probes(k) for x in spellings(a, b))
    pairs = side_by_side(F.split(F.lower("text"), r"[^a-z0-9\x{80}-\x{10FFFF}]+"))
    wide = F.octet_length("text") > 2 * LONG  # a unit of so many bigrams is longer
    hit = F.exists(pairs, lambda g: g.isin(sorted(short)) | (wide & g.isin(sorted(long))))
    return texts.where(F.col("text").isNotNull() & F.coalesce(hit, F.lit(False))).select("blob_id", "text").dropDuplicates(["blob_id"])


def with_candidates(texts: DataFrame, members: DataFrame, dice: float) -> DataFrame:
    """(blob_id, text, templates) of texts dealt by blob_id: the templates whose overlap with all of the text would do
    for their smallest unit."""
    rows = texts.select("blob_id", F.explode(side_by_side(words(normalised(F.col("text"))))).alias("gram"))
    known = F.broadcast(members.select("gram").distinct())
    counted = rows.join(known, "gram", "left_semi").groupBy("blob_id", "gram").agg(F.count("*").alias("c"))
    held = counted.join(members, "gram").groupBy("blob_id", "template", "size", "least").agg(F.sum(F.least("c", "n")).alias("held"))
    enough = held.where(F.col("held") >= F.lit(dice) * (F.col("least") + F.col("size")) / 2 - 1e-9)
    return texts.join(enough.groupBy("blob_id").agg(F.sort_array(F.collect_list("template")).alias("templates")), "blob_id")  # a template once


def units(texts: DataFrame, t: Templates) -> DataFrame:
    """(blob_id, kind, at, part, words, template) of texts (blob_id, text, templates): units and the templates whose
    bounds they are within."""
    unit = lambda kind, at, part, c: F.struct(F.lit(kind).alias("kind"), at.cast("int").alias("at"), F.lit(part).cast("int").alias("part"), c.alias("u"))
    parts = F.split("n", PARAGRAPH)
    none = F.lit(None).cast("string")
    whole = unit("t", F.lit(1), 0, F.when(F.size(parts) > 1, F.col("n")))
    rows = F.flatten(
        F.array(
            F.array(whole),
            F.transform(parts, lambda p, i: unit("p", i + 1, 0, F.when(F.instr(p, "\n") > 0, p).otherwise(none))),
            F.transform(F.split("n", "\n"), lambda p, i: unit("l", i + 1, 0, p)),
        )
    )
    norm = texts.select("blob_id", "templates", normalised(F.col("text")).alias("n"))
    lines = norm.select("blob_id", "templates", F.explode(rows).alias("r")).where("r.u is not null").select("blob_id", "templates", "r.*")
    sentences = F.split("u", MARK)
    inner = F.when((F.col("kind") == "l") & (F.size(sentences) > 1), F.transform(sentences, lambda s, i: F.struct(F.lit("s").alias("kind"), (i + 1).alias("part"), s.alias("u"))))
    own = F.array(F.struct("kind", "part", "u"))
    every = lines.select("blob_id", "templates", "at", F.explode(F.when(inner.isNotNull(), F.concat(own, inner)).otherwise(own)).alias("r"))
    bound = lambda i: F.array(*[F.lit(b[i]) for b in t.bounds])
    fitting = lambda ws: F.filter("templates", lambda k: (F.size(ws) - 1 >= bound(0)[k]) & (F.size(ws) - 1 <= bound(1)[k]))
    cut = F.explode(F.transform(F.array(words(F.col("r.u"))), lambda ws: F.struct(ws.alias("words"), fitting(ws).alias("fit"))))
    found = every.select("blob_id", "r.kind", "at", "r.part", cut.alias("z"))
    return found.select("blob_id", "kind", "at", "part", "z.words", F.explode("z.fit").alias("template"))


def alone(texts: DataFrame, members: DataFrame, t: Templates) -> DataFrame:
    """(blob_id, licence, unit, dice): each licence's best unit."""
    key = ["blob_id", "kind", "at", "part"]
    found = units(texts, t)
    rows = found.select(*key, "template", (F.size("words") - 1).alias("m"), F.explode(side_by_side(F.col("words"))).alias("gram"))
    counted = rows.join(members, ["template", "gram"]).groupBy(*key, "m", "template", "size", "licence", "gram", "n").agg(F.count("*").alias("c"))
    dice = (2 * F.sum(F.least("c", "n")) / (F.col("m") + F.col("size"))).alias("dice")
    scored = counted.groupBy(*key, "m", "template", "size", "licence").agg(dice).where(F.col("dice") >= t.dice - 1e-12)
    best = scored.groupBy(*key).agg(F.min(F.struct((-F.col("dice")).alias("d"), "template", "licence")).alias("best"))
    order = F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("kind"))
    top = best.groupBy("blob_id", F.col("best.licence").alias("licence")).agg(F.min(F.struct(F.col("best.d").alias("d"), order.alias("o"), "at", "part", "kind")).alias("u"))
    name = F.concat(F.col("u.kind"), F.when(F.col("u.kind") == "t", "").otherwise(F.col("u.at").cast("string")), F.when(F.col("u.kind") == "s", F.concat(F.lit("."), F.col("u.part"))).otherwise(""))
    return top.select("blob_id", "licence", name.alias("unit"), (-F.col("u.d")).alias("dice"))


def placed(texts: DataFrame, members: DataFrame) -> DataFrame:
    """Bigrams of texts (blob_id, text, templates) that their templates have: q, the number of the first word, from 1,
    and the paragraphs of both words (sp, ep) with the words before the one and up to the other (s, e)."""
    paragraphs = texts.select("blob_id", "templates", F.posexplode(F.split(normalised(F.col("text")), PARAGRAPH)).alias("i", "p"))
    cut = paragraphs.select("blob_id", "templates", (F.col("i") + 1).alias("at"), words(F.col("p")).alias("words")).where("words[0] <> ''")
    order = Window.partitionBy("blob_id").orderBy("at")  # one text
    cut = cut.withColumn("to", F.sum(F.size("words")).over(order)).withColumn("from", F.col("to") - F.size("words"))
    before = F.lag(F.struct("from", "at", F.element_at("words", -1).alias("last"))).over(order)
    cut = cut.withColumn("prev", before).withColumn("all", F.expr("if(prev is null, words, concat(array(prev.last), words))"))
    first = "if(j = 0 and prev is not null, prev.{0}, {0}) as {1}"
    pair = cut.select("blob_id", "templates", "prev", "at", "from", "to", F.posexplode(side_by_side(F.col("all"))).alias("j", "gram"))
    pair = pair.selectExpr("blob_id", "templates", "gram", "cast(`from` + j + if(prev is null, 1, 0) as long) as q", first.format("`from`", "s").replace("prev.`from`", "prev.from"), first.format("at", "sp"), "`to` as e", "at as ep")
    return pair.join(members, "gram").where("array_contains(templates, template)").drop("templates")


def stretches(hits: DataFrame, dice: float) -> DataFrame:
    """(blob_id, template, licence, s, sp, e, ep, dice) of stretches of at least dice that begin with the start (s, sp)
    and end with the end (e, ep) of some hits. Hits meet starts of their own and the block before only."""
    text = ["blob_id", "template"]
    hits = hits.withColumn("rn", F.row_number().over(Window.partitionBy(*text, "gram").orderBy("q")))
    like = hits.select(*text, "gram", (F.col("rn") + F.col("n")).alias("rn"), F.col("sp").alias("past"))
    block = lambda c: F.floor(c / (F.col("most") + 2))
    own = hits.join(like, [*text, "gram", "rn"], "left").withColumn("block", F.explode(F.array(block(F.col("q") - 1), block(F.col("q") - 1) - 1)))
    starts = hits.select(*text, block(F.col("s")).alias("block"), F.col("s").alias("from"), F.col("sp").alias("first")).distinct()
    met = own.join(starts, [*text, "block"]).where("first <= sp and (past is null or first > past) and e - `from` - 1 <= most")
    held = met.groupBy(*text, "licence", "size", "least", "from", "first", "e", "ep").agg(F.count("*").alias("c"))
    so_far = F.sum("c").over(Window.partitionBy(*text, "from").orderBy("e"))  # within one text's bounds
    m = F.col("e") - F.col("from") - 1
    scored = held.withColumn("dice", 2 * so_far / (m + F.col("size"))).where((m >= F.col("least")) & (F.col("dice") >= dice - 1e-12))
    return scored.select(*text, "licence", F.col("from").alias("s"), F.col("first").alias("sp"), "e", "ep", "dice")


def runs(hits: DataFrame, dice: float) -> DataFrame:
    """(blob_id, licence, unit, dice): each licence's best run of paragraphs, and none that overlaps a better one."""
    scored = stretches(hits, dice).where("ep > sp")
    best = scored.groupBy("blob_id", "sp", "ep").agg(F.min(F.struct((-F.col("dice")).alias("d"), "template", "licence")).alias("t"))
    top = best.groupBy("blob_id", F.col("t.licence").alias("licence")).agg(F.min(F.struct(F.col("t.d").alias("d"), "sp", "ep")).alias("u"))
    listed = top.groupBy("blob_id").agg(F.sort_array(F.collect_list(F.struct("u", "licence"))).alias("l"))  # bounded by the templates
    apart = listed.select("blob_id", F.explode(F.expr("aggregate(l, slice(l, 1, 0), (kept, x) -> if(exists(kept, k -> k.u.sp <= x.u.ep and x.u.sp <= k.u.ep), kept, concat(kept, array(x))))")).alias("x"))
    return apart.select("blob_id", "x.licence", F.expr("concat('r', x.u.sp, '-', x.u.ep)").alias("unit"), (-F.col("x.u.d")).alias("dice"))


def passages(hits: DataFrame, dice: float) -> DataFrame:
    """(blob_id, licence, unit, dice): each licence's best passage of words."""
    by_word = hits.where(F.col("size").between(*WORDY)).withColumns({"s": F.col("q") - 1, "sp": F.col("q"), "e": F.col("q") + 1, "ep": F.col("q") + 1})
    best = stretches(by_word, dice).groupBy("blob_id", "licence").agg(F.min(F.struct((-F.col("dice")).alias("d"), "sp", "ep", "template")).alias("u"))
    return best.select("blob_id", "licence", F.expr("concat('w', u.sp, '-', u.ep)").alias("unit"), (-F.col("u.d")).alias("dice"))


def scan(spark: SparkSession, texts: DataFrame, templates: Templates | None = None) -> DataFrame:
    """(blob_id, licence, unit, dice, passage), each licence's best unit and, of those that no unit other than a run
    shows, its best passage, of texts (blob_id, text); copies are counted once."""
    t = templates or Templates()
    members = t.members(spark)
    kept = written(spark, with_probes(texts, t), "licence-texts")
    some = written(spark, with_candidates(dealt_by_bytes(kept, "text", "blob_id"), members, t.dice), "licence-candidates")
    dealt = dealt_by_bytes(some, "text", "blob_id")
    shown = written(spark, alone(dealt, members, t), "licence-units")
    name = F.array(*[F.lit(x) for x in t.names]) if t.names else F.array(F.lit(""))
    open_ = some.select("blob_id", F.explode("templates").alias("template")).withColumn("licence", name[F.col("template")]).join(shown, ["blob_id", "licence"], "left_anti")
    open_ = open_.groupBy("blob_id").agg(F.collect_list("template").alias("templates"))  # a template once
    hits = written(spark, placed(dealt.drop("templates").join(open_, "blob_id"), members), "licence-hits")
    rows = shown.unionByName(runs(hits, t.dice)).withColumn("passage", F.lit(False))
    return rows.unionByName(passages(hits, t.dice).withColumn("passage", F.lit(True)))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    blob = F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob_id")
    found = scan(spark, docs.select(blob, "text"))
    listed = lambda own: F.sort_array(F.collect_list(F.when(own, F.struct("licence", "unit", "dice"))))  # noqa: E731  a licence once: bounded by the templates
    found = found.groupBy("blob_id").agg(listed(~F.col("passage")).alias("found"), listed(F.col("passage")).alias("within"))
    found = written(spark, found, "licences")  # so that the join back stands alone, and a text of many copies can be split in it
    out = docs.select("doc_id", blob).join(found, "blob_id", "left")
    join = lambda f, c="found": F.coalesce(F.array_join(F.transform(c, f), ","), F.lit(""))
    said = lambda x: F.concat_ws(":", x["licence"], x["unit"], F.format_string("%.4f", x["dice"]))
    return out.select(
        "doc_id",
        F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_licences"),
        join(lambda x: x["licence"]).alias("licences"),
        join(said).alias("findings"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["dice"])), F.lit(0.0)).alias("best_dice"),
        join(said, "within").alias("passages"),
    )


def _oracle() -> str:
    t = Templates()
    grams = ", ".join(f"({k}, '{a}', '{b}', {n}, {t.sizes[k]}, {t.bounds[k][0]}, {t.bounds[k][1]}, '{t.names[k]}')" for k, g in enumerate(t.grams) for (a, b), n in g.items())
    words = lambda c: f"string_split_regex(trim(translate({c}, chr(10) || chr(1), '  '), ' '), ' +')"
    return f"""WITH grams(template, a, b, n, size, lo, hi, licence) AS (VALUES {grams}),
    norm AS (SELECT blob_id, replace(regexp_replace(regexp_replace(translate(text, '{UPPER}', '{LOWER}'), '{SENTENCE}', chr(1), 'g'), '{REST}', ' ', 'g'), 'licence', 'license') AS n
        FROM (SELECT DISTINCT sha256(coalesce(text, '')) AS blob_id, coalesce(text, '') AS text FROM documents)),
    paras AS (SELECT blob_id, unnest(l) AS u, generate_subscripts(l, 1) AS pos, len(l) AS many FROM (SELECT blob_id, string_split_regex(n, '{PARAGRAPH}') AS l FROM norm)),
    lines AS (SELECT blob_id, unnest(l) AS u, generate_subscripts(l, 1) AS pos FROM (SELECT blob_id, string_split(n, chr(10)) AS l FROM norm)),
    sents AS (SELECT blob_id, pos, unnest(l) AS u, generate_subscripts(l, 1) AS part FROM (SELECT blob_id, pos, string_split(u, chr(1)) AS l FROM lines) WHERE len(l) > 1),
    units AS (SELECT norm.blob_id, 't' AS kind, 1 AS pos, 0 AS part, n AS u FROM norm JOIN (SELECT DISTINCT blob_id FROM paras WHERE many > 1) p ON p.blob_id = norm.blob_id
        UNION ALL SELECT blob_id, 'p', pos, 0, u FROM paras WHERE contains(u, chr(10)) UNION ALL SELECT blob_id, 'l', pos, 0, u FROM lines UNION ALL SELECT blob_id, 's', pos, part, u FROM sents),
    cut AS (SELECT blob_id, kind, pos, part, {words('u')} AS w FROM units),
    pairs AS (SELECT blob_id, kind, pos, part, m, w1, w2, count(*) AS c FROM (SELECT blob_id, kind, pos, part, len(w) - 1 AS m, unnest(w[:-2]) AS w1, unnest(w[2:]) AS w2 FROM cut) GROUP BY ALL),
    dice AS (SELECT blob_id, kind, pos, part, template, licence, 2 * sum(least(c, n)) / (m + size) AS d FROM pairs JOIN grams ON w1 = a AND w2 = b AND m BETWEEN lo AND hi
        GROUP BY blob_id, kind, pos, part, m, template, licence, size),
    best AS (SELECT * FROM dice WHERE d >= {t.dice} - 1e-12 QUALIFY row_number() OVER (PARTITION BY blob_id, kind, pos, part ORDER BY d DESC, template) = 1),
    top AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY blob_id, licence ORDER BY d DESC, strpos('tpls', kind), pos, part) = 1),
    found AS (SELECT blob_id, count(*) AS n, string_agg(licence, ',' ORDER BY licence) AS licences, max(d) AS best_dice,
        string_agg(licence || ':' || kind || CASE WHEN kind = 't' THEN '' ELSE pos::VARCHAR END || CASE WHEN kind = 's' THEN '.' || part ELSE '' END || ':' || printf('%.4f', d), ',' ORDER BY licence) AS findings FROM top GROUP BY blob_id),
    -- passages: of every start, bigrams within reach count until the template has no more of them
    texts AS (SELECT blob_id, {words('n')} AS w FROM norm),
    bigrams AS (SELECT blob_id, unnest(w[:-2]) AS w1, unnest(w[2:]) AS w2, generate_subscripts(w[2:], 1) AS q FROM texts),
    enough AS (SELECT blob_id, template FROM (SELECT blob_id, template, size, lo, a, b, least(count(*), n) AS c FROM bigrams JOIN grams ON w1 = a AND w2 = b WHERE size BETWEEN {WORDY[0]} AND {WORDY[1]} GROUP BY blob_id, template, size, lo, a, b, n)
        GROUP BY blob_id, template, size, lo HAVING sum(c) >= {t.dice} * (lo + size) / 2 - 1e-9),
    hits AS (SELECT h.blob_id, g.template, licence, size, lo, hi, n, q, w1, w2 FROM bigrams h JOIN grams g ON w1 = a AND w2 = b JOIN enough e ON e.blob_id = h.blob_id AND e.template = g.template
        WHERE NOT EXISTS (SELECT 1 FROM top WHERE top.blob_id = h.blob_id AND top.licence = g.licence)),
    reach AS (SELECT s.blob_id, s.template, s.licence, s.size, s.lo, s.q AS first, h.q AS last, row_number() OVER (PARTITION BY s.blob_id, s.template, s.q, h.w1, h.w2 ORDER BY h.q) <= h.n AS fresh
        FROM hits s JOIN hits h ON s.blob_id = h.blob_id AND s.template = h.template AND h.q >= s.q AND h.q - s.q < s.hi),
    held AS (SELECT blob_id, template, licence, size, lo, first, last, last - first + 1 AS m, sum(fresh::INT) OVER (PARTITION BY blob_id, template, first ORDER BY last) AS c FROM reach),
    within AS (SELECT *, 2 * c / (m + size) AS d FROM held WHERE m >= lo AND 2 * c / (m + size) >= {t.dice} - 1e-12 QUALIFY row_number() OVER (PARTITION BY blob_id, licence ORDER BY d DESC, first, last, template) = 1),
    passed AS (SELECT blob_id, string_agg(licence || ':w' || first || '-' || (last + 1) || ':' || printf('%.4f', d), ',' ORDER BY licence) AS passages FROM within GROUP BY blob_id)
    SELECT doc_id, coalesce(n, 0) AS n_licences, coalesce(licences, '') AS licences, coalesce(findings, '') AS findings, coalesce(best_dice, 0.0) AS best_dice, coalesce(passages, '') AS passages
    FROM documents LEFT JOIN found f ON f.blob_id = sha256(coalesce(text, '')) LEFT JOIN passed p ON p.blob_id = sha256(coalesce(text, ''))"""


ORACLE = _oracle()
