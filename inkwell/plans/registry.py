"""Queries over the driver's tables, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import codec, ctokens, text, urls, weights
from inkwell.functions.stem import stem_terms
from inkwell.operators import index as ix
from inkwell.operators import locks, paging, search, sets
from inkwell.plans.profile import MG, MG_INT, TF_ONLY
from inkwell.plans.request import free_text, parse_block, parse_query_string
from inkwell.plans.scratch import folder, kept
from inkwell.sources import crawl, readers
from inkwell.streaming import index as streaming

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("docnum"), "text")


def built(spark: SparkSession, sf_dir: str, profile=ix.SPARCK_JONES, stemmer=None) -> ix.Index:
    """The stored index of documents: built by the first search of these files, looked up by the others."""
    return ix.stored(docs(spark, sf_dir), profile, stemmer)


POST = """post AS (SELECT substr(lower(raw), 1, 253) AS term, docnum, count(*) AS dtf
    FROM (SELECT doc_id AS docnum, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS raw FROM documents) GROUP BY ALL)"""
TERMS = POST + ", terms AS (SELECT term, count(*) AS tf FROM post GROUP BY term)"
INFO = TERMS + """, info AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT max(tf) FROM terms) AS maxtf),
    md AS (SELECT docnum, max(dtf) AS maxdtf FROM post GROUP BY docnum)"""
IDF = {"maxtf": "ln(1 + maxtf / tf)", "n": "ln(1 + n / tf)", "n_int": "ln(1 + n // tf)", "one": "1.0"}
DAMP = {"relative": "(0.5 + 0.5 * dtf / maxdtf)", "log": "(1 + ln(dtf))"}


def dwt_sql(idf: str, damp: str) -> str:
    return INFO + f""", dw AS (SELECT docnum, sqrt(sum(pow({IDF[idf]} * {DAMP[damp]}, 2))) AS dwt
        FROM post JOIN terms USING (term) JOIN md USING (docnum) CROSS JOIN info GROUP BY docnum)"""


def ranked_sql(words: str, index_idf: str = "maxtf", query_idf: str = "n", damp: str = "relative") -> str:
    """CTE ranked (docnum, score, hits)."""
    terms = free_text(words)
    qmf = max(t.qtf for t in terms)
    values = ", ".join(f"({t.pos}, '{t.term}', {t.qtf})" for t in terms)
    return dwt_sql(index_idf, damp) + f""", q(pos, term, qtf) AS (VALUES {values}),
        ranked AS (SELECT docnum, sum({IDF[query_idf]} * {DAMP[damp]} * (0.5 + 0.5 * qtf / {qmf}) * {IDF[query_idf]}) / max(dwt) AS score, count(DISTINCT pos) AS hits
            FROM q JOIN terms USING (term) JOIN post USING (term) JOIN md USING (docnum) JOIN dw USING (docnum) CROSS JOIN info GROUP BY docnum)"""


def scored(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 4))


TOP = "SELECT docnum, round(score, 4) AS score, hits FROM ranked ORDER BY ranked.score DESC, docnum LIMIT 10"

# tokens and statistics


@query("SELECT doc_id AS docnum, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda w: substr(lower(w), 1, 253))::VARCHAR AS tokens FROM documents")
def tokens_lower(spark, sf_dir):
    return _listed(docs(spark, sf_dir), text.tokenize(F.col("text")))


@query("SELECT doc_id AS docnum, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda w: substr(w, 1, 253))::VARCHAR AS tokens FROM documents")
def tokens_case(spark, sf_dir):
    return _listed(docs(spark, sf_dir), text.tokenize(F.col("text"), lower=False))


@query("SELECT doc_id AS docnum, list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda w: substr(w, 1, 253))::VARCHAR AS tokens FROM documents")
def tokens_ident(spark, sf_dir):
    return _listed(docs(spark, sf_dir), text.tokenize(F.col("text"), text.IDENT, lower=False))


def _listed(df: DataFrame, tokens) -> DataFrame:
    return df.select("docnum", F.concat(F.lit("["), F.array_join(tokens, ", "), F.lit("]")).alias("tokens"))


@query("""SELECT doc_id AS docnum, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS term
    FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: substr(lower(x), 1, 253)) AS w FROM documents)""")
def token_positions(spark, sf_dir):
    return ix.token_rows(docs(spark, sf_dir)).withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {POST} SELECT * FROM post")
def term_doc_freq(spark, sf_dir):
    return ix.postings_of(docs(spark, sf_dir))


@query(f"WITH {TERMS} SELECT * FROM terms")
def term_df(spark, sf_dir):
    return built(spark, sf_dir).terms


@query(f"WITH {INFO} SELECT n, n AS numfiles, maxtf, (SELECT max(dtf) FROM post) AS maxdtf, false AS stemmed FROM info")
def collection_info(spark, sf_dir):
    return built(spark, sf_dir).info


@query(f"WITH {TERMS} SELECT term, tf FROM terms ORDER BY tf DESC, term LIMIT 1")
def most_popular_term(spark, sf_dir):
    return built(spark, sf_dir).most_popular()


@query(f"WITH {INFO} SELECT * FROM md")
def doc_maxdtf(spark, sf_dir):
    return built(spark, sf_dir).maxdtf


# weights


@query(f"WITH {INFO} SELECT term, tf, round({IDF['maxtf']}, 6) AS idf FROM terms CROSS JOIN info")
def idf_table(spark, sf_dir):
    return built(spark, sf_dir).idf("maxtf").withColumn("idf", F.round("idf", 6))


@query(f"WITH {INFO} SELECT term, tf, round({IDF['n_int']}, 6) AS idf FROM terms CROSS JOIN info")
def idf_int_table(spark, sf_dir):
    return built(spark, sf_dir).idf("n_int").withColumn("idf", F.round("idf", 6))


def _weights(spark, sf_dir, profile):
    return built(spark, sf_dir, profile).doc_stats.select("docnum", "maxdtf", F.round("dwt", 4).alias("dwt"))


def _weights_sql(idf, damp):
    return f"WITH {dwt_sql(idf, damp)} SELECT doc_id AS docnum, coalesce(maxdtf, 0) AS maxdtf, round(coalesce(dwt, 0), 4) AS dwt FROM documents LEFT JOIN md ON doc_id = md.docnum LEFT JOIN dw ON doc_id = dw.docnum"


@query(_weights_sql("maxtf", "relative"))
def doc_weight(spark, sf_dir):
    return _weights(spark, sf_dir, ix.SPARCK_JONES)


@query(_weights_sql("n_int", "log"))
def doc_weight_mg_int(spark, sf_dir):
    return _weights(spark, sf_dir, MG_INT)


@query(_weights_sql("n", "log"))
def doc_weight_mg(spark, sf_dir):
    return _weights(spark, sf_dir, MG)


@query(_weights_sql("one", "log"))
def doc_weight_tf_only(spark, sf_dir):
    return _weights(spark, sf_dir, TF_ONLY)


@query("""WITH w AS (SELECT conv_id * 1048576 + turn AS docnum, conv_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS raw FROM conversations),
    p AS (SELECT docnum, conv_id, lower(raw) AS term, count(*) AS dtf FROM w GROUP BY ALL), f AS (SELECT conv_id, max(dtf) AS most FROM p GROUP BY conv_id)
    SELECT conv_id * 1048576 + turn AS docnum, CASE WHEN turn = max(turn) OVER (PARTITION BY conv_id) THEN most ELSE 0 END AS maxdtf FROM conversations LEFT JOIN f USING (conv_id)""")
def multidoc_maxdtf(spark, sf_dir):
    from dataclasses import replace

    parts = readers.multi_documents(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return ix.build(parts, replace(ix.SPARCK_JONES, compat_multidoc=True)).maxdtf


# ranked search

COMMON, REPEATED = "the in of en to", "the the the of of on die"


@query(f"WITH {ranked_sql(COMMON)} {TOP}")
def ranked_topk(spark, sf_dir):
    return scored(search.ranked(built(spark, sf_dir), COMMON, 10))


@query(f"WITH {ranked_sql(COMMON)} SELECT docnum, round(score, 4) AS score, hits FROM ranked")
def ranked_all(spark, sf_dir):
    return scored(search.ranked(built(spark, sf_dir), COMMON))


@query(f"WITH {ranked_sql(REPEATED)} {TOP}")
def ranked_repeated_terms(spark, sf_dir):
    return scored(search.ranked(built(spark, sf_dir), REPEATED, 10))


@query(f"WITH {ranked_sql(COMMON, 'n_int', 'n_int', 'log')} {TOP}")
def ranked_mg_int(spark, sf_dir):
    return scored(search.ranked(built(spark, sf_dir, MG_INT), COMMON, 10))


@query(f"WITH {ranked_sql('the and of or not to')} {TOP}")
def ranked_reserved_words(spark, sf_dir):
    return scored(search.ranked(built(spark, sf_dir), "the and of or not to", 10))


@query(f"WITH {TERMS}, q(pos, term) AS (VALUES (0, 'the'), (1, 'of'), (2, 'zzzz')) SELECT pos, term, coalesce(tf, 0) AS tf FROM q LEFT JOIN terms USING (term)")
def query_term_hits(spark, sf_dir):
    return search.query_term_hits(built(spark, sf_dir), "the of zzzz")


# Boolean search


def _bool_sql(condition: str, words: str) -> str:
    flags = ", ".join(f"coalesce(bool_or(term = '{w}'), false) AS {w}_" for w in words.split())
    return f"WITH {POST}, f AS (SELECT doc_id AS docnum, {flags} FROM documents LEFT JOIN post ON doc_id = post.docnum GROUP BY doc_id) SELECT docnum FROM f WHERE {condition}"


def _boolean(spark, sf_dir, expression, version=2):
    return search.boolean(built(spark, sf_dir), expression, version)


@query(_bool_sql("the_ AND of_", "the of"))
def bool_and(spark, sf_dir):
    return _boolean(spark, sf_dir, "the and of")


@query(_bool_sql("the_ OR die_", "the die"))
def bool_or(spark, sf_dir):
    return _boolean(spark, sf_dir, "the or die")


@query(_bool_sql("NOT the_", "the"))
def bool_not(spark, sf_dir):
    return _boolean(spark, sf_dir, "not the")


@query(_bool_sql("(the_ AND of_) OR (die_ AND NOT der_) OR on_", "the of die der on"))
def bool_nested(spark, sf_dir):
    return _boolean(spark, sf_dir, "(the and of) or (die and not der) or on")


@query(_bool_sql("(the_ AND NOT of_) OR die_", "the of die"))
def bool_v10_symbols(spark, sf_dir):
    return _boolean(spark, sf_dir, "(the & ! of) | die", 1)


@query(_bool_sql("the_", "the"))
def bool_lenient_paren(spark, sf_dir):
    return _boolean(spark, sf_dir, "(the of)")


@query("SELECT doc_id AS docnum FROM documents WHERE false")
def bool_case_sensitive(spark, sf_dir):
    return _boolean(spark, sf_dir, "The")


@query("SELECT doc_id AS docnum FROM documents WHERE false")
def bool_error(spark, sf_dir):
    return _boolean(spark, sf_dir, "the of")


@query(f"WITH {POST} SELECT DISTINCT docnum FROM post WHERE starts_with(term, 'th') INTERSECT SELECT DISTINCT docnum FROM post WHERE starts_with(term, 'wh')")
def bool_prefix(spark, sf_dir):
    return search.boolean(built(spark, sf_dir), "th & wh", 1, exact=False)


def _set(spark, sf_dir, word):
    return built(spark, sf_dir).postings.where(F.col("term") == word).select("docnum")


@query(f"WITH {POST} SELECT docnum FROM post WHERE term = 'the' UNION SELECT docnum FROM post WHERE term = 'die'")
def set_union(spark, sf_dir):
    return sets.union(_set(spark, sf_dir, "the"), _set(spark, sf_dir, "die"))


@query(f"WITH {POST} SELECT docnum FROM post WHERE term = 'the' INTERSECT SELECT docnum FROM post WHERE term = 'of'")
def set_intersect(spark, sf_dir):
    return sets.intersect(_set(spark, sf_dir, "the"), _set(spark, sf_dir, "of"))


@query(f"WITH {POST} SELECT docnum FROM post WHERE term = 'the' EXCEPT SELECT docnum FROM post WHERE term = 'of'")
def set_minus(spark, sf_dir):
    return sets.minus(_set(spark, sf_dir, "the"), _set(spark, sf_dir, "of"))


@query(f"WITH {POST} SELECT doc_id AS docnum FROM documents EXCEPT SELECT docnum FROM post WHERE term = 'the'")
def set_complement(spark, sf_dir):
    return sets.complement(_set(spark, sf_dir, "the"), docs(spark, sf_dir))


@query(f"WITH {POST} SELECT count(*) AS n FROM post WHERE term = 'the'")
def set_count(spark, sf_dir):
    return sets.cardinality(sets.bitmap(_set(spark, sf_dir, "the")))


@query(f"WITH {POST} SELECT count(*) AS n FROM (SELECT docnum FROM post WHERE term = 'the' INTERSECT SELECT docnum FROM post WHERE term = 'of')")
def set_bitmap_and(spark, sf_dir):
    return sets.cardinality(sets.bitmap_and(sets.bitmap(_set(spark, sf_dir, "the")), sets.bitmap(_set(spark, sf_dir, "of"))))


@query(f"WITH {POST} SELECT doc_id AS docnum, doc_id IN (SELECT docnum FROM post WHERE term = 'the') AS member FROM documents")
def set_members(spark, sf_dir):
    return sets.members(_set(spark, sf_dir, "the"), docs(spark, sf_dir))


# all terms, prefixes, both kinds together


@query(f"WITH {POST} SELECT docnum, count(DISTINCT term) AS hits FROM post WHERE term IN ('the', 'of', 'to') GROUP BY docnum HAVING count(DISTINCT term) = 3")
def all_terms(spark, sf_dir):
    return search.all_terms(built(spark, sf_dir), "the of to")


@query(f"WITH {TERMS} SELECT * FROM terms WHERE starts_with(term, 'tha')")
def prefix_terms(spark, sf_dir):
    return search.prefix_terms(built(spark, sf_dir), "tha")


@query(f"WITH {ranked_sql(COMMON)}, b AS (SELECT docnum FROM post WHERE term = 'the' EXCEPT SELECT docnum FROM post WHERE term = 'by') SELECT docnum, round(score, 4) AS score, hits FROM ranked WHERE docnum IN (SELECT docnum FROM b) ORDER BY ranked.score DESC, docnum LIMIT 10")
def ranked_within_boolean(spark, sf_dir):
    i = built(spark, sf_dir)
    return scored(search.ranked(i, COMMON, 10, within=search.boolean(i, "the and not by")))


# pages and output


def _page(spark, sf_dir, size, number):
    results = kept(search.ranked(built(spark, sf_dir), COMMON), "results")
    return results, paging.page_of(results.count(), size, number)


def _page_sql(size: int, number: str) -> str:
    return f"""WITH {ranked_sql(COMMON)}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, docnum) AS rn, count(*) OVER () AS m FROM ranked),
        p AS (SELECT *, least({number}, ceil(m / {size}))::BIGINT AS page FROM r) SELECT docnum, round(score, 4) AS score, hits FROM p WHERE rn BETWEEN {size} * (page - 1) + 1 AND {size} * page"""


@query(_page_sql(10, "1"))
def page_first(spark, sf_dir):
    return scored(paging.page_rows(*_page(spark, sf_dir, 10, 1)))


@query(_page_sql(7, "ceil(m / 7)"))
def page_last_short(spark, sf_dir):
    results, p = _page(spark, sf_dir, 7, 1)
    return scored(paging.page_rows(results, paging.page_of(p.matches, 7, p.pages)))


@query(_page_sql(10, "99999"))
def page_clamped(spark, sf_dir):
    return scored(paging.page_rows(*_page(spark, sf_dir, 10, 99999)))


@query(f"""WITH {ranked_sql(COMMON)}, c AS (SELECT count(*) AS m FROM ranked) SELECT m AS matches, ceil(m / 10)::BIGINT AS pages, 2::BIGINT AS page, true AS has_prev, ceil(m / 10) > 2 AS has_next,
    'Page 2 displayed, out of ' || ceil(m / 10)::BIGINT || ' pages, containing ' || m || ' items' AS message FROM c""")
def page_nav(spark, sf_dir):
    _, p = _page(spark, sf_dir, 10, 2)
    b = p.buttons()
    lits = {"matches": F.lit(p.matches).cast("long"), "pages": F.lit(p.pages).cast("long"), "page": F.lit(p.page).cast("long"), "has_prev": F.lit(b["prev"]), "has_next": F.lit(b["next"]), "message": F.lit(p.message)}
    return spark.range(1).select(*[v.alias(k) for k, v in lits.items()])


def _metadata(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("texts/doc "), F.col("doc_id").cast("string"), F.lit(".html"))
    meta = d.select(F.col("doc_id").alias("docnum"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("").alias("doc_title"), F.col("source").alias("file_title"), name.alias("name"), F.col("n_chars").alias("size"))
    return paging.with_metadata(search.ranked(built(spark, sf_dir), COMMON, 10), meta, "host")


META = f"""WITH {ranked_sql(COMMON)}, top AS (SELECT * FROM ranked ORDER BY score DESC, docnum LIMIT 10),
    m AS (SELECT top.*, CASE WHEN doc_id % 2 = 0 THEN '<i>' || lang || '</i> ' || source ELSE source END AS title, 'http://host/texts/doc%20' || doc_id || '.html' AS link, n_chars AS size FROM top JOIN documents ON doc_id = docnum)"""


@query(META + " SELECT docnum, hits, title, link, size FROM m")
def result_metadata(spark, sf_dir):
    return _metadata(spark, sf_dir).select("docnum", "hits", "title", "link", "size")


@query(META + """ SELECT docnum, '<li><a href="' || link || '">' || title || '</a> ' || printf('%.2f', score) || ' ' || hits || ' ' || size || '</li>' AS row FROM m""")
def row_html(spark, sf_dir):
    return _metadata(spark, sf_dir).select("docnum", paging.row_html().alias("row"))


@query(META + """ SELECT docnum, printf('<docfile><docnum>%d</docnum><rank>%.2f</rank><hits>%d</hits></docfile>', docnum, score, hits) AS row FROM m""")
def row_xml(spark, sf_dir):
    return _metadata(spark, sf_dir).select("docnum", paging.row_xml().alias("row"))


@query(META + """ SELECT docnum, printf('{ Doc(%d), Score(%.2f), Hits(%d) }', docnum, score, hits) AS row FROM m""")
def row_console(spark, sf_dir):
    return _metadata(spark, sf_dir).select("docnum", paging.row_console().alias("row"))


TEMPLATE = "".join(f"##ys_{name}##\n[{name}{' %l' if name.startswith('nav_') and name not in ('nav_top', 'nav_bottom') else ''}]\n" for name in paging.SECTIONS)


@query(META + """, c AS (SELECT count(*) AS m FROM ranked), r AS (SELECT string_agg('<li><a href="' || link || '">' || title || '</a> ' || printf('%.2f', score) || ' ' || hits || ' ' || size || '</li>', chr(10) ORDER BY score DESC, docnum) AS rows FROM m)
    SELECT replace('[page_head]~[search_form]~[summary]~Page 1 displayed, out of ' || ceil(m / 10)::BIGINT || ' pages, containing ' || m || ' items~[nav_top]~' || CASE WHEN m > 10 THEN '[nav_next ?q=x&page=2]~[nav_last ?q=x&page=' || ceil(m / 10)::BIGINT || ']~' ELSE '' END
    || '[list_head]~', '~', chr(10)) || rows || replace('~[list_foot]~[nav_bottom]~[page_foot]~', '~', chr(10)) AS page FROM c, r""")
def result_page(spark, sf_dir):
    """The first page, with all sections of a template."""
    matches = search.ranked(built(spark, sf_dir), COMMON).count()
    rows = _metadata(spark, sf_dir).orderBy(F.desc("score"), "docnum").select(paging.row_html().alias("row")).collect()  # a page
    page = paging.result_page([r["row"] for r in rows], paging.page_of(matches, 10, 1), paging.load_template(TEMPLATE), "?q=x")
    return spark.range(1).select(F.lit(page).alias("page"))


@query("""WITH t AS (SELECT doc_id AS docnum, unnest(regexp_extract_all(replace(text, 'the', 'THE '), '[A-Za-z0-9]+')) AS raw FROM documents WHERE lang <> 'de')
    SELECT upper(substr(lower(raw), 1, 253)) AS term, docnum, count(*) AS dtf FROM t WHERE length(raw) > 3 GROUP BY ALL""")
def index_hooks(spark, sf_dir):
    """Hooks of the index builder: one changes and drops documents, one changes and drops terms."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("docnum"), "text", "lang")
    on_document = lambda rows: rows.where("lang <> 'de'").withColumn("text", F.replace("text", F.lit("the"), F.lit("THE ")))
    return ix.postings_of(d, on_document=on_document, on_term=lambda t: F.when(F.length(t) > 3, F.upper(t)))


# the index's physical forms

GAPS = f"WITH {POST}, g AS (SELECT term, docnum, docnum - lag(docnum, 1, 0) OVER (PARTITION BY term ORDER BY docnum) AS gap, dtf FROM post)"


@query(GAPS + " SELECT * FROM g")
def dgaps(spark, sf_dir):
    return ix.dgaps(ix.postings_of(ix.in_blocks(docs(spark, sf_dir))))


@query(f"WITH {POST} SELECT term, docnum, dtf FROM post")
def dgap_roundtrip(spark, sf_dir):
    return ix.from_dgaps(ix.dgaps(ix.postings_of(ix.in_blocks(docs(spark, sf_dir)))).withColumnRenamed("docnum", "seq"))


@query(f"""WITH {TERMS}, l AS (SELECT term, lag(term) OVER (PARTITION BY term[1] ORDER BY term) AS p FROM terms),
    k AS (SELECT term, coalesce(len(list_filter(range(1, least(length(term), length(p)) + 1), lambda i: term[1:i] = p[1:i])), 0) AS prefix_len FROM l)
    SELECT term, prefix_len, substr(term, prefix_len + 1) AS suffix FROM k""")
def front_coding(spark, sf_dir):
    return ix.front_coded(ix.postings_of(docs(spark, sf_dir)).select("term").distinct())


SIZES = "(SELECT DISTINCT p_size::BIGINT AS x FROM part WHERE p_size > 0)"


def _sizes(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("x")).where("x > 0").distinct()


@query(f"SELECT x, repeat('0', (x - 1)::INT) || '1' AS bits FROM {SIZES}")
def unary_bits(spark, sf_dir):
    return _sizes(spark, sf_dir).select("x", codec.unary(F.col("x")).alias("bits"))


@query(f"SELECT x, repeat('0', length(ltrim(bin(x), '0')) - 1) || ltrim(bin(x), '0') AS bits FROM {SIZES}")
def gamma_bits(spark, sf_dir):
    return _sizes(spark, sf_dir).select("x", codec.gamma(F.col("x")).alias("bits"))


@query(f"SELECT x, repeat('0', length(bin(length(bin(x)))) - 1) || bin(length(bin(x))) || substr(bin(x), 2) AS bits FROM {SIZES}")
def delta_bits(spark, sf_dir):
    return _sizes(spark, sf_dir).select("x", codec.delta(F.col("x")).alias("bits"))


@query(f"SELECT x, CASE WHEN x - 1 < 14 THEN lpad(bin(x - 1), 5, '0') ELSE lpad(bin(x - 1 + 14), 6, '0') END AS bits FROM {SIZES} WHERE x <= 50")
def minimal_binary_bits(spark, sf_dir):
    return _sizes(spark, sf_dir).where("x <= 50").select("x", codec.minimal_binary(F.col("x"), F.lit(50).cast("long")).alias("bits"))


@query(f"SELECT x, length(bin(x)) - 1 AS floor_log2, ceil(log2(x))::BIGINT AS ceil_log2, bit_count(x)::BIGINT AS ones FROM {SIZES}")
def bit_utilities(spark, sf_dir):
    x = F.col("x")
    return _sizes(spark, sf_dir).select("x", codec.floor_log2(x).alias("floor_log2"), codec.ceil_log2(x).alias("ceil_log2"), F.bit_count(x).cast("long").alias("ones"))


@query(f"SELECT x, x AS unary, x AS gamma, x AS delta FROM {SIZES}")
def codec_roundtrip(spark, sf_dir):
    """Each number through each code and back."""
    x = F.col("x")
    one = lambda kind, bits: F.element_at(codec.decode(F.concat(bits, F.lit("000")), kind), 1).alias(kind)
    return _sizes(spark, sf_dir).select("x", one("unary", codec.unary(x)), one("gamma", codec.gamma(x)), one("delta", codec.delta(x)))


@query(f"WITH {POST} SELECT term, count(*) AS tf, string_agg(docnum || ':' || dtf, ' ' ORDER BY docnum) AS postings FROM post GROUP BY term")
def posting_lists(spark, sf_dir):
    p = built(spark, sf_dir).posting_lists()
    return p.select("term", "tf", F.array_join(F.transform("postings", lambda x: F.concat_ws(":", x["docnum"], x["dtf"])), " ").alias("postings"))


@query(f"""WITH {POST}, g AS (SELECT term, docnum, dtf, docnum // 4096 AS block, docnum - coalesce(lag(docnum) OVER (PARTITION BY term, docnum // 4096 ORDER BY docnum), docnum) AS gap FROM post)
    SELECT term, block, min(docnum) AS first, count(*) AS tf, string_agg(gap, ' ' ORDER BY docnum) AS gaps, string_agg(dtf, ' ' ORDER BY docnum) AS dtfs FROM g GROUP BY term, block""")
def posting_blocks(spark, sf_dir):
    p = built(spark, sf_dir).posting_blocks()
    return p.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ") for c in ("gaps", "dtfs")})


@query(f"WITH {POST} SELECT * FROM post")
def index_merge(spark, sf_dir):
    d = docs(spark, sf_dir)
    return ix.merge(ix.build(d.where("docnum % 2 = 0")), ix.build(d.where("docnum % 2 = 1"))).postings


@query(f"WITH {TERMS} SELECT count(*) AS terms, 0::BIGINT AS mismatches FROM terms")
def index_verify(spark, sf_dir):
    """Stored terms against postings written and read again."""
    path = folder(spark, "index")
    ix.build(docs(spark, sf_dir)).write(path, 8)
    i = ix.Index.read(spark, path)
    return i.terms.agg(F.count("*").alias("terms")).crossJoin(ix.verify(i.terms, i.postings).agg(F.count("*").alias("mismatches")))


@query(f"WITH {TERMS} SELECT * FROM terms WHERE term >= 'the' AND term < 'thi'")
def term_range_scan(spark, sf_dir):
    return ix.range_scan(built(spark, sf_dir).terms, "the", "thi")


# sources


def pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


@query("SELECT page_id, ltrim(translate(regexp_extract(html, '(?is)<title[^>]*>([^<]*)</title>', 1), chr(10) || chr(13), '  ')) AS title FROM pages")
def html_title(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", readers.html_title(F.col("html")).alias("title"))


@query("""SELECT page_id, regexp_extract(html, '(?is)<html[^>]*\\slang="([^"]*)"', 1) AS lang, regexp_extract(html, '(?is)<meta[^>]*charset=["'']?([A-Za-z0-9_-]+)', 1) AS charset,
    regexp_extract(regexp_extract(html, '(?is)^(.*?)(?:<body|</head)', 1), '(?is)<meta\\s+name=["'']?keywords["'']?\\s+content="([^"]*)"', 1) AS keywords FROM pages""")
def html_meta(spark, sf_dir):
    h = F.col("html")
    return pages(spark, sf_dir).select("page_id", readers.html_lang(h).alias("lang"), readers.html_charset(h).alias("charset"), readers.html_meta(h, "keywords").alias("keywords"))


@query("""WITH t AS (SELECT page_id, unnest(l) AS tag, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT page_id, regexp_extract_all(html, '(?s)<!--.*?-->|<[^>]+>') AS l FROM pages))
    SELECT page_id, pos, CASE WHEN starts_with(tag, '<!--') THEN 'COMMENT' WHEN starts_with(tag, '<![CDATA[') THEN 'CDATA' WHEN starts_with(tag, '<!') THEN 'SECTION' WHEN starts_with(tag, '<?') THEN 'PI'
    WHEN starts_with(tag, '<%') THEN 'CODE' WHEN starts_with(tag, '</') THEN 'CLOSE' WHEN ends_with(tag, '/>') THEN 'EMPTY' ELSE 'OPEN' END AS kind, lower(regexp_extract(tag, '^</?([A-Za-z][A-Za-z0-9]*)', 1)) AS name FROM t""")
def html_tag_tokens(spark, sf_dir):
    return readers.tag_tokens(pages(spark, sf_dir))


@query(f"""WITH t AS (SELECT page_id, html_unescape_ AS text FROM (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', chr(160)), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;', '&') AS html_unescape_ FROM pages))
    SELECT substr(lower(raw), 1, 253) AS term, page_id AS docnum, count(*) AS dtf FROM (SELECT page_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS raw FROM t) GROUP BY ALL""")
def html_text_terms(spark, sf_dir):
    p = pages(spark, sf_dir)
    return ix.postings_of(p.select(F.col("page_id").alias("docnum"), readers.html_text(F.col("html")).alias("text")))


BARE = "regexp_replace(regexp_replace({0}, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
STRIP = "trim(regexp_replace(" + BARE + ", '[\\n\\t\\r\\f ]+', ' ', 'g'))"


@query(f"""WITH s AS (SELECT page_id, unnest(l) AS part, generate_subscripts(l, 1) - 1 AS section FROM (SELECT page_id, string_split_regex(html, '(?i)<h[12][^>]*>') AS l FROM pages))
    SELECT page_id, section, CASE WHEN section > 0 THEN {STRIP.format("regexp_extract(part, '(?is)^(.*?)</(?:h[12]|div)>', 1)")} ELSE '' END AS title, {STRIP.format('part')} AS text FROM s""")
def html_sections(spark, sf_dir):
    return readers.sections(pages(spark, sf_dir))


@query("""WITH s AS (SELECT doc_id, unnest(l) AS text, unnest(list_concat(g, [NULL])) AS gap, generate_subscripts(l, 1) AS i FROM
        (SELECT doc_id, string_split_regex(text, '\\n[ \\t]*\\n\\s*') AS l, regexp_extract_all(text, '\\n[ \\t]*\\n\\s*') AS g FROM documents)),
    n AS (SELECT *, coalesce(sum(length(text) - length(replace(text, chr(10), '')) + coalesce(length(gap) - length(replace(gap, chr(10), '')), 0)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS line FROM s),
    p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS paragraph FROM n WHERE trim(text) <> '')
    SELECT doc_id AS docnum, paragraph, line::BIGINT AS line, 'Paragraph ' || paragraph || ' at Line ' || line::BIGINT || ', beginning with [ ' || array_to_string((string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '))[1:8], ' ') || ' ...]' AS title, text FROM p""")
def text_paragraphs(spark, sf_dir):
    return readers.paragraphs(docs(spark, sf_dir))


@query(r"""WITH h AS (SELECT doc_id, text, regexp_extract(text, '(?s)^(?:[\x20-\x7f\s]*[^\x20-\x7f\s]){50}') AS head FROM documents)
    SELECT doc_id AS docnum, CASE WHEN head = '' THEN text ELSE regexp_replace(head, '[A-Za-z0-9]*[^\x20-\x7f\s]\z', '') END AS text FROM h""")
def binary_guard(spark, sf_dir):
    return docs(spark, sf_dir).select("docnum", text.binary_guard(F.col("text")).alias("text"))


WORD_HTML = "'<p>' || r_name || '</p><div align=left name=\"Heading 1\">' || n_name || '</div><p>of ' || r_name || '</p><DIV name=heading 2 class=x>' || n_nationkey || '</DIV><i>' || n_name || '</i>'"


@query(f"""WITH p AS (SELECT n_nationkey::BIGINT AS page_id, {WORD_HTML} AS html FROM nation JOIN region ON n_regionkey = r_regionkey),
    s AS (SELECT page_id, unnest(l) AS part, generate_subscripts(l, 1) - 1 AS section FROM (SELECT page_id, string_split_regex(html, '(?i)<div[^>]*name="?heading [12]"?[^>]*>') AS l FROM p))
    SELECT page_id, section, CASE WHEN section > 0 THEN {STRIP.format("regexp_extract(part, '(?is)^(.*?)</(?:h[12]|div)>', 1)")} ELSE '' END AS title, {STRIP.format('part')} AS text FROM s""")
def word_html_sections(spark, sf_dir):
    """Sections of HTML as a word processor writes it: headings are named divisions."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return readers.sections(n.select(F.col("n_nationkey").cast("long").alias("page_id"), F.expr(WORD_HTML.replace("\"", "\\\"")).alias("html")), readers.WORD_HEADINGS)


@query("SELECT r_regionkey::BIGINT AS region, length(r_name) + 1 AS size, r_name || chr(10) AS text FROM region")
def files_scanned(spark, sf_dir):
    """A tree of text files, one for each region in a folder of its own, read again."""
    path = folder(spark, "files")
    table(spark, sf_dir, "region").select("r_regionkey", "r_name").repartition("r_regionkey").write.partitionBy("r_regionkey").text(path)
    return readers.read_files(spark, path, "*.txt").select(F.regexp_extract("path", r"r_regionkey=(\d+)", 1).cast("long").alias("region"), F.col("size").cast("long").alias("size"), "text")


@query("SELECT url AS path, CASE WHEN starts_with(url, 'https://') THEN substr(url, 9) ELSE url END AS name, strlen(html) AS size FROM pages")
def file_records(spark, sf_dir):
    """Records of files under a root, which their names leave out."""
    return readers.file_records(pages(spark, sf_dir).select(F.col("url").alias("path"), F.octet_length("html").cast("long").alias("size")), "https://")


@query("SELECT 'r' || r_regionkey || '.txt' AS name FROM region WHERE r_regionkey < 3")
def files_ignored(spark, sf_dir):
    """Own files are left out of a scan."""
    path = folder(spark, "own")
    names = {0: "r0.txt", 1: "r1.txt", 2: "r2.txt", 3: "tmp.3", 4: "inkwell.terms"}
    fs = spark._jvm.org.apache.hadoop.fs
    for r in table(spark, sf_dir, "region").select("r_regionkey", "r_name").collect():  # five rows
        at = fs.Path(f"{path}/{names[r['r_regionkey']]}")
        out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
        out.write(bytearray(r["r_name"].encode()))
        out.close()
    return readers.read_files(spark, path).select("name")


@query("SELECT p_partkey AS part_key, upper(reverse(p_name)) AS text, reverse(upper(p_name)) AS other FROM part")
def filter_chain(spark, sf_dir):
    """name.up.rev is what up makes of what rev makes of it."""
    f = readers.Filters({"up": F.upper, "rev": F.reverse})
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_key"), f.apply("name.up.rev", F.col("p_name")).alias("text"), f.apply("name.rev.up", F.col("p_name")).alias("other"))


@query("SELECT p_partkey AS title, p_name AS text, p_brand AS file FROM part")
def xml_documents(spark, sf_dir):
    """Files of several documents, written as XML, one a brand, and read again."""
    path = folder(spark, "xml")
    doc = F.format_string('<DOC title="%d" file="%s">%s</DOC>', "p_partkey", "p_brand", "p_name")
    files = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.concat(F.lit("<FILE>\n"), F.array_join(F.sort_array(F.collect_list(doc)), "\n"), F.lit("\n</FILE>")).alias("xml"))
    files.repartition("p_brand").write.partitionBy("p_brand").text(path)
    _, docs_ = readers.read_xml(spark, path)
    return docs_.select(F.col("title").cast("long").alias("title"), "text", F.col("file"))


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand")
def catalog_collection(spark, sf_dir):
    """A collection read by its name."""
    catalog = readers.Catalog(f"# collections\nparts.path={sf_dir}/part.parquet\n")
    return spark.read.parquet(catalog.path("parts")).groupBy("p_brand").agg(F.count("*").alias("n"))


@query("SELECT page_id, reverse(split_part(reverse(url), '/', 1)) AS base, CASE WHEN regexp_matches(lower(url), '\\.html?$') THEN 'html' WHEN regexp_matches(lower(url), '\\.xml$') THEN 'xml' ELSE 'text' END AS route, ends_with(lower(url), 'x') AS ends FROM pages")
def suffix_route(spark, sf_dir):
    u = F.col("url")
    return pages(spark, sf_dir).select("page_id", text.basename(u).alias("base"), readers.route(u).alias("route"), text.ends_with(u, "X").alias("ends"))


@query("SELECT doc_id AS docnum, trim(regexp_replace(text, '[\\n\\t\\r\\f ]+', ' ', 'g')) AS text FROM documents")
def collapsed_text(spark, sf_dir):
    return docs(spark, sf_dir).select("docnum", text.collapsed(F.col("text")).alias("text"))


# strings and URLs


@query("SELECT part_key, url_decode(replace(name, '+', '%2B')) AS decoded FROM (SELECT p_partkey AS part_key, replace(p_name, ' ', '%20') || '+x' AS name FROM part)")
def url_decode(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_key"), F.concat(F.replace("p_name", F.lit(" "), F.lit("%20")), F.lit("+x")).alias("name"))
    return p.select("part_key", urls.decoded(F.col("name")).alias("decoded"))


_ENCODE = "p_name || ' <%>'"
for _c in urls.UNSAFE:
    _ENCODE = f"replace({_ENCODE}, '{_c}', '%{ord(_c):02x}')"


@query(f"SELECT p_partkey AS part_key, replace({_ENCODE}, ' ', '+') AS encoded FROM part")
def url_encode(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_key"), urls.encoded(F.concat("p_name", F.lit(" <%>")), "+").alias("encoded"))


@query("SELECT page_id, coalesce(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, coalesce(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS ref FROM pages")
def query_string_fields(spark, sf_dir):
    fields = F.str_to_map(F.regexp_extract("url", "\\?([^#]*)", 1), F.lit("&"), F.lit("="))
    get = lambda k: F.coalesce(F.element_at(fields, k), F.lit("")).alias(k)
    return pages(spark, sf_dir).select("page_id", get("page"), get("ref"))


@query("SELECT doc_id AS docnum, len(f) AS n, f[1] AS first, f[2] AS second FROM (SELECT doc_id, list_transform(string_split(source || '  ^^' || lang || '^' || n_chars, '^'), lambda x: rtrim(x, ' ')) AS f FROM documents)")
def split_fields(spark, sf_dir):
    line = F.concat("source", F.lit("  ^^"), "lang", F.lit("^"), F.col("n_chars").cast("string"))
    f = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("docnum"), text.split_fields(line).alias("f"))
    return f.select("docnum", F.size("f").cast("long").alias("n"), F.col("f")[0].alias("first"), F.col("f")[1].alias("second"))


@query("SELECT n_nationkey AS key, len(list_filter(range(1, least(length(n_name), length(r_name)) + 1), lambda i: n_name[1:i] = r_name[1:i])) AS prefix FROM nation JOIN region ON n_regionkey = r_regionkey")
def common_prefix(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.col("n_nationkey").alias("key"), text.common_prefix(F.col("n_name"), F.col("r_name")).alias("prefix"))


# stemming (rows only)


@query()
def stem_lovins_terms(spark, sf_dir):
    return stem_terms(ix.postings_of(docs(spark, sf_dir)).select("term").distinct(), "lovins")


@query()
def stem_porter_terms(spark, sf_dir):
    return stem_terms(ix.postings_of(docs(spark, sf_dir)).select("term").distinct(), "porter")


@query()
def ranked_stemmed(spark, sf_dir):
    return scored(search.ranked(built(spark, sf_dir, stemmer="lovins"), "nations standing of the", 10))


@query(f"WITH {ranked_sql('the of in', 'maxtf', 'n', 'relative')} {TOP}")
def stdin_request(spark, sf_dir):
    """A search as a block of lines."""
    return scored(search.search(built(spark, sf_dir), parse_block(":sm=ranked\n:ps=10\nthe of\nin\n")).limit(10))


MANY = [*(f"zz{k}" for k in range(48)), "the", "of", "in", "die", "to"]


@query(f"WITH {ranked_sql(' '.join(MANY[:50]))} {TOP}")
def ranked_fifty_terms(spark, sf_dir):
    """Of 53 words the first 50 count."""
    return scored(search.ranked(built(spark, sf_dir), " ".join(MANY), 10))


@query(f"WITH {ranked_sql('the of', 'maxtf', 'n', 'relative')} {TOP}")
def request_dispatch(spark, sf_dir):
    """A search as it comes from a query string."""
    return scored(search.search(built(spark, sf_dir), parse_query_string("q=the+of&sm=ranked&ps=3")).limit(10))


# crawl

LINK = "links AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\\s(?:[^>]*\\s)?href\\s*=\\s*\"([^\"]*)\"', 1)) AS link FROM pages)"
ORIGIN = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
FULL = f"""full_links AS (SELECT page_id, url, link, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN link WHEN starts_with(link, '/') THEN {ORIGIN} || link
    ELSE {ORIGIN} || coalesce(nullif(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '[^/]*$', ''), ''), '/') || link END AS target FROM links)"""


def _anchors(spark, sf_dir):
    return crawl.links(pages(spark, sf_dir)).where("tag = 'a'").withColumn("target", crawl.resolved(F.col("url"), F.col("link")))


@query(f"WITH {LINK} SELECT page_id, link FROM links")
def links_extract(spark, sf_dir):
    return _anchors(spark, sf_dir).select("page_id", "link")


@query(f"WITH {LINK}, {FULL} SELECT page_id, target FROM full_links WHERE lower(regexp_extract(url, '://([^/:?#]*)', 1)) = lower(regexp_extract(target, '://([^/:?#]*)', 1))")
def links_same_host(spark, sf_dir):
    return _anchors(spark, sf_dir).where(crawl.host(F.col("url")) == crawl.host(F.col("target"))).select("page_id", "target")


@query(f"WITH {LINK}, {FULL} SELECT page_id, target FROM full_links WHERE ends_with(lower(regexp_extract(target, '://([^/:?#]*)', 1)), 'example.com') AND NOT ends_with(target, 'and')")
def links_accept(spark, sf_dir):
    t = F.col("target")
    return _anchors(spark, sf_dir).where(crawl.in_domains(t, ["example.com"]) & crawl.accepted(t, reject=["*and"])).select("page_id", "target")


@query(f"""WITH RECURSIVE {LINK}, {FULL}, edges AS (SELECT DISTINCT f.page_id AS src, p.page_id AS dst FROM full_links f JOIN pages p ON p.url = f.target),
    walk(node, depth) AS (SELECT page_id, 0 FROM pages WHERE page_id NOT IN (SELECT dst FROM edges WHERE src <> dst) UNION SELECT dst, depth + 1 FROM walk JOIN edges ON src = node WHERE depth < 4)
    SELECT node, min(depth) AS depth FROM walk GROUP BY node""")
def crawl_reach(spark, sf_dir):
    p = pages(spark, sf_dir).select(F.col("page_id").alias("dst"), F.col("url").alias("target"))
    edges = _anchors(spark, sf_dir).join(p, "target").select(F.col("page_id").alias("src"), "dst").distinct()
    roots = pages(spark, sf_dir).join(edges.where("src <> dst").select(F.col("dst").alias("page_id")), "page_id", "left_anti")
    return crawl.reachable(edges, roots.select(F.col("page_id").alias("node")), 4)


ROBOTS = """User-agent: *
Disallow: /es/
Disallow: /en/1

User-agent: other
Disallow: /
"""
HOST, PATH = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)', 1))", "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


@query(f"""WITH u AS (SELECT page_id, upper(substr(url, 1, 4)) || substr(url, 5) AS raw FROM pages), c AS (SELECT page_id, regexp_replace(raw, '#.*$', '') AS url FROM u),
    h AS (SELECT page_id, url, {ORIGIN} AS head FROM c) SELECT page_id, regexp_replace(lower(head), '^(http://[^/]*):80$', '\\1') || coalesce(nullif(substr(url, length(head) + 1), ''), '/') AS url FROM h""")
def url_canonical(spark, sf_dir):
    raw = F.concat(F.upper(F.substring("url", 1, 4)), F.substr("url", F.lit(5)))
    return pages(spark, sf_dir).select("page_id", crawl.canonical(raw).alias("url"))


@query(f"WITH {LINK}, {FULL} SELECT page_id, target FROM full_links WHERE starts_with({PATH.replace('url', 'target')}, '/en')")
def links_below(spark, sf_dir):
    return _anchors(spark, sf_dir).where(crawl.below(F.col("target"), "/en")).select("page_id", "target")


@query(f"SELECT page_id, url FROM pages WHERE NOT starts_with({PATH}, '/es/') AND NOT starts_with({PATH}, '/en/1')")
def robots_allowed(spark, sf_dir):
    return pages(spark, sf_dir).where(crawl.allowed(F.col("url"), crawl.robots_rules(ROBOTS))).select("page_id", "url")


@query(f"""SELECT page_id FROM (SELECT page_id, coalesce(sum(strlen(html)) OVER (PARTITION BY {HOST} ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pages) WHERE before < 20000""")
def crawl_quota(spark, sf_dir):
    return crawl.within_quota(pages(spark, sf_dir), 20_000).select("page_id")


@query("SELECT page_id, md5(html) AS digest FROM pages")
def page_digest(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.md5("html").alias("digest"))


PAIRS = " UNION ALL ".join(f"""SELECT page_id, url, '{t}' AS tag, '{a}' AS attr, unnest(regexp_extract_all(html, '(?is)<{t}\\s(?:[^>]*\\s)?{a}\\s*=\\s*"([^"]*)"', 1)) AS link FROM pages""" for t, a in crawl.LINKS)
META_LINK = """SELECT page_id, url, 'meta' AS tag, 'content' AS attr, unnest(regexp_extract_all(html, '(?is)<meta\\s[^>]*content\\s*=\\s*"\\d+;\\s*url=([^"]*)"', 1)) AS link FROM pages"""
STEPS = "list_filter(string_split(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')"
BESIDE = f"""links AS ({PAIRS} UNION ALL {META_LINK}), {FULL.replace("SELECT page_id, url, link,", "SELECT page_id, url, tag, attr, link,")},
    steps AS (SELECT *, list_filter(string_split(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '[^/]*$', ''), '/'), lambda x: x <> '') AS b, {STEPS.format('target')} AS t,
        regexp_extract(target, '^[^?#]*([?#].*)?$', 1) AS rest, {ORIGIN} = {ORIGIN.replace('url', 'target')} AS own FROM full_links),
    common AS (SELECT *, len(list_filter(range(1, least(len(b), len(t)) + 1), lambda i: b[1:i] = t[1:i])) AS k FROM steps),
    written AS (SELECT page_id, url, tag, attr, link, target, CASE WHEN own THEN coalesce(nullif(array_to_string(list_concat(list_transform(range(len(b) - k), lambda i: '..'), t[k + 1:]), '/'), ''), '.') || coalesce(rest, '') ELSE target END AS beside FROM common)"""


@query(f"WITH {BESIDE} SELECT * FROM written")
def links_all_kinds(spark, sf_dir):
    """Every kind of link, made absolute with dot segments resolved, and as it would be written beside its page."""
    found = crawl.links(pages(spark, sf_dir)).withColumn("target", urls.joined(F.col("url"), F.col("link")))
    return found.withColumn("beside", urls.relative(F.col("url"), F.col("target")))


@query(f"WITH {BESIDE} SELECT page_id, link FROM links WHERE NOT regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') AND NOT starts_with(link, '//')")
def links_relative_only(spark, sf_dir):
    """What a crawl follows that takes relative links only."""
    return crawl.links(pages(spark, sf_dir)).where(crawl.is_relative(F.col("link"))).select("page_id", "link")


@query(f"WITH {BESIDE} SELECT page_id, target FROM full_links WHERE NOT starts_with(lower(target), 'ftp:')")
def links_without_ftp(spark, sf_dir):
    found = crawl.links(pages(spark, sf_dir)).withColumn("target", urls.joined(F.col("url"), F.col("link")))
    return found.where(~F.lower("target").startswith("ftp:")).select("page_id", "target")


C_RULE = r"""\s+|//[^\n]*|(?s:/\*.*?\*/)|^[ \t]*#[^\n]*|L?"(?:\\.|[^"\\\n])*"|L?'(?:\\.|[^'\\\n])+'|(?:0[xX][0-9a-fA-F]*\.?[0-9a-fA-F]+[pP][+-]?\d+|\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+)[fFlL]?|(?:0[xX][0-9a-fA-F]+|\d+)[uUlL]*|[A-Za-z_]\w*|\.\.\.|<<=|>>=|->|\+\+|--|<<|>>|[<>=!]=|&&|\|\||[-+*/%&^|]=|##|[-+*/%&|^~!<>=?:;,.(){}\[\]#]|(?s:.)"""
_NAMES = ", ".join(f"('{k}', '{v}')" for k, v in [*((k, k.strip("_").upper()) for k in sorted(ctokens.KEYWORDS)), *ctokens.SIGNS.items()])


@query(f"""WITH names(lexeme, name) AS (VALUES {_NAMES}), src AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<(?:script|style)[^>]*>(.*?)</', 1)) AS source FROM pages),
    tok AS (SELECT page_id, unnest(regexp_extract_all(source, '(?m)' || $rule${C_RULE}$rule$)) AS t FROM src),
    told AS (SELECT page_id, CASE WHEN name IS NOT NULL THEN name WHEN regexp_matches(t, '^[ \t]*#[^\n]*$') AND length(ltrim(t, ' \t')) > 2 THEN 'DIRECTIVE' WHEN regexp_matches(t, '^L?".*"$') THEN 'STRING_CONSTANT' WHEN regexp_matches(t, '^L?''.+''$') THEN 'CHARACTER_CONSTANT'
        WHEN regexp_matches(t, '^[A-Za-z_]') THEN 'IDENTIFIER' WHEN regexp_matches(t, '^(0[xX][0-9a-fA-F]+|[0-9]+)[uUlL]*$') THEN 'INTEGER_CONSTANT' WHEN regexp_matches(t, '^[.]?[0-9]') THEN 'FLOATING_CONSTANT' ELSE 'BADTOK' END AS token
        FROM tok LEFT JOIN names ON t = lexeme WHERE NOT regexp_matches(t, '^([ \t\r\n\f]+|//|/[*])'))
    SELECT page_id, token, count(*) AS n FROM (SELECT * FROM told UNION ALL SELECT page_id, 'EOI' FROM src) GROUP BY page_id, token""")
def c_token_kinds(spark, sf_dir):
    """C tokens of the pages' scripts and styles."""
    source = F.explode(F.regexp_extract_all("html", F.lit("(?is)<(?:script|style)[^>]*>(.*?)</"), F.lit(1))).alias("source")
    rows = pages(spark, sf_dir).select("page_id", source).select("page_id", F.explode(ctokens.c_tokens(F.col("source"))).alias("t"))
    return rows.groupBy("page_id", F.col("t.token").alias("token")).agg(F.count("*").alias("n"))


# locks

_C = ", ".join(f"('{a}', '{b}', {str(v).lower()})" for (a, b), v in locks.COMPATIBLE.items())
_M = ", ".join(f"('{a}', '{b}', '{v}')" for (a, b), v in locks.SUPREMUM.items())


@query(f"SELECT * FROM (VALUES {_C}) t(requested, held, compatible)")
def lock_compat(spark, sf_dir):
    return locks.compatibility(spark)


@query(f"SELECT * FROM (VALUES {_M}) t(requested, held, supremum)")
def lock_supremum(spark, sf_dir):
    return locks.suprema(spark)


def lock_log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    h = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "event_id"), F.lit(n))
    mode = F.element_at(F.array(*map(F.lit, locks.MODES[1:])), (h("mode", 6) + 1).cast("int"))
    op = F.when(h("op", 10) < 5, "acquire").when(h("op", 10) < 8, "release").when(h("op", 10) == 8, "downgrade").otherwise("find")
    return e.select(F.col("event_id").alias("seq"), F.pmod("user_id", F.lit(8)).alias("owner"), h("lock", 200).alias("lockable"), op.alias("op"), mode.alias("mode"), F.when(h("d", 10) == 0, "instant").otherwise("manual").alias("duration"), F.lit(0).alias("timeout"), (h("f", 20) == 0).alias("force"))


@query()
def lock_replay(spark, sf_dir):
    return locks.replay(lock_log(spark, sf_dir))


@query()
def stream_locks(spark, sf_dir):
    """The log's replay as a stream, with each lock's queue as state; one batch, so that its order is the log's."""
    path = folder(spark, "locks")
    log = lock_log(spark, sf_dir)
    log.coalesce(1).write.parquet(f"{path}/log")
    stream = streaming.stream_replay(spark.readStream.schema(log.schema).parquet(f"{path}/log"))
    stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query("SELECT event_type AS name, count(*) FILTER (value < 5) AS nowaits, count(*) FILTER (value >= 5) AS waits FROM events GROUP BY event_type")
def latch_statistics(spark, sf_dir):
    kind = F.when(F.col("value") < 5, "nowaits").otherwise("waits")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), kind.alias("kind"))
    return rows.groupBy("name").pivot("kind", ["nowaits", "waits"]).count().na.fill(0)


# streams


@query(f"WITH {POST} SELECT * FROM post")
def stream_index(spark, sf_dir):
    d = streaming.read_documents(spark, f"{sf_dir}/documents*.parquet").select(F.col("doc_id").alias("docnum"), "text")
    path = folder(spark, "stream")
    streaming.maintain(d, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return streaming.postings(spark, f"{path}/rows")


# scalar formulae on a grid of values


@query("""SELECT l_orderkey, l_linenumber, round((0.5 + 0.5 * l_linenumber / 7) * ln(1 + 100 / l_linenumber), 6) AS qtw, round(ln(1 + 100 // l_linenumber) * (1 + ln(l_linenumber)), 6) AS dtw FROM lineitem""")
def weight_formulae(spark, sf_dir):
    n, hundred = F.col("l_linenumber"), F.lit(100)
    q = weights.qtw(n, F.lit(7), weights.idf("n", hundred, n, hundred))
    d = weights.dtw(weights.idf("n_int", hundred, n, hundred), weights.log_dtf("log", n, n))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(q, 6).alias("qtw"), F.round(d, 6).alias("dtw"))
