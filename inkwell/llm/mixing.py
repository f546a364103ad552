"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks (native SQL only).

Sizes are words. Every source gets a target: its share by weight of `factor` times all words, never above `cap`
times its own size, the excess going to the others by weight (water filling, solved in closed form over the sorted
cap-to-weight ratios). Targets become integer numbers of blocks of `block` words by highest quotients
target / (2 seats + 1). A source's documents are dealt to shards of about `shard_docs` by a seeded hash; the
source's blocks are apportioned to its shards by the same rule over shard sizes. Inside a shard the documents lie
on a line in seeded order, and the quota takes whole passes plus a cyclic run of blocks from a seeded start. So
no step sees more than one shard's (doc_id, size) rows at once, and the source tables have one row per source.

Seats are not dealt one by one: floor(x + 1/2) at x = v (n - S/2) / V never exceeds the highest-quotients seats
(it is the same divisor method with a larger divisor) and leaves at most S seats, which are then dealt by quotient.

Defined cases: null text has size 0; null source is a source of its own, last; null doc_id hashes as ''; repeated
rows are separate documents; an empty table gives no rows; all sizes 0 give targets and takes of 0; other columns
are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.shared import table, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, FACTOR, CAP, BLOCK, SHARD_DOCS, SEED = (5, 2, 1), 1.5, 2, 16, 4096, "mix-1"

#: Both dialects run this text; {sized} is a relation (doc_id, source, size), {h60} the seeded 60-bit hash of {x}.
MIX = """
src AS (SELECT source, sum(size) AS source_size, count(*) AS n_docs FROM {sized} GROUP BY source),
placed AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, n_docs,
    row_number() OVER (ORDER BY CASE WHEN source IS NULL THEN 1 ELSE 0 END, source) AS pos FROM src),
weighed AS (SELECT *, CAST(CASE (pos - 1) % {n_weights} {weights} END AS DOUBLE) AS w,
    CAST({cap} * source_size AS DOUBLE) AS most, {factor} * CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM placed),
levels AS (SELECT *, (total - coalesce(sum(most) OVER (ORDER BY most / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY most / w, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lam FROM weighed),
aimed AS (SELECT *, least(most, w * max(CASE WHEN lam <= most / w THEN lam END) OVER ()) AS aim FROM levels),
sources AS (SELECT *, CAST(floor(total / {block} + 0.5) AS BIGINT) AS seats_all, count(*) OVER () AS parties,
    CAST(ceil(n_docs / {shard_docs}.0) AS BIGINT) AS n_shards FROM aimed),
first_seats AS (SELECT *, CASE WHEN total > 0 THEN greatest(0, CAST(floor(aim * (seats_all - parties / 2.0) / total + 0.5) AS BIGINT)) ELSE 0 END AS sure FROM sources),
left_over AS (SELECT *, seats_all - CAST(sum(sure) OVER () AS BIGINT) AS spare FROM first_seats),
bids AS (SELECT pos, spare, j, aim / (2 * (sure + j) - 1) AS quotient FROM (
    SELECT pos, spare, sure, aim, {explode}(sequence_to) AS j FROM (
        SELECT pos, spare, sure, aim, {sequence}(1, 2 + CAST(floor(aim * parties / total) AS BIGINT)) AS sequence_to FROM left_over WHERE aim > 0) a) b),
won AS (SELECT pos, count(*) AS extra FROM (SELECT pos, spare, row_number() OVER (ORDER BY quotient DESC, pos, j) AS place FROM bids) a WHERE place <= spare GROUP BY pos),
quotas AS (SELECT s.source, s.pos, s.source_size, s.aim, s.n_shards, s.sure + coalesce(won.extra, 0) AS seats FROM left_over s LEFT JOIN won ON s.pos = won.pos),
dealt AS (SELECT d.doc_id, d.size, q.pos, q.source_size, q.aim, q.seats, d.h % q.n_shards AS shard, d.h
    FROM (SELECT doc_id, size, source, {h60_doc} AS h FROM {sized}) d JOIN quotas q ON d.source IS NOT DISTINCT FROM q.source),
shards AS (SELECT pos, shard, max(seats) AS seats, max(source_size) AS source_size, CAST(sum(size) AS BIGINT) AS words FROM dealt GROUP BY pos, shard),
shard_sure AS (SELECT *, count(*) OVER (PARTITION BY pos) AS parties FROM shards WHERE words > 0),
shard_first AS (SELECT *, greatest(0, CAST(floor(CAST(words AS DOUBLE) * (seats - parties / 2.0) / source_size + 0.5) AS BIGINT)) AS sure FROM shard_sure),
shard_left AS (SELECT *, seats - CAST(sum(sure) OVER (PARTITION BY pos) AS BIGINT) AS spare FROM shard_first),
shard_bids AS (SELECT pos, shard, spare, j, CAST(words AS DOUBLE) / (2 * (sure + j) - 1) AS quotient FROM (
    SELECT pos, shard, spare, sure, words, {explode}(sequence_to) AS j FROM (
        SELECT pos, shard, spare, sure, words, {sequence}(1, 2 + CAST(floor(CAST(words AS DOUBLE) * parties / source_size) AS BIGINT)) AS sequence_to FROM shard_left) a) b),
shard_won AS (SELECT pos, shard, count(*) AS extra FROM (
    SELECT pos, shard, spare, row_number() OVER (PARTITION BY pos ORDER BY quotient DESC, shard, j) AS place FROM shard_bids) a WHERE place <= spare GROUP BY pos, shard),
shard_quota AS (SELECT l.pos, l.shard, l.words, least({cap} * l.words, {block} * (l.sure + coalesce(w.extra, 0))) AS quota,
    {block} * ({h60_shard} % CAST(ceil(l.words / {block}.0) AS BIGINT)) AS origin
    FROM shard_left l LEFT JOIN shard_won w ON l.pos = w.pos AND l.shard = w.shard),
lined AS (SELECT d.doc_id, d.size, d.source_size, d.aim, q.words, q.origin, CAST(floor(q.quota / q.words) AS BIGINT) AS passes, q.quota % q.words AS more,
    CAST(sum(d.size) OVER (PARTITION BY d.pos, d.shard ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto
    FROM dealt d LEFT JOIN shard_quota q ON d.pos = q.pos AND d.shard = q.shard)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, round(coalesce(aim, 0), 6) AS target,
    CAST(coalesce(passes * size + greatest(0, least(upto, origin + more, words) - greatest(upto - size, origin))
        + greatest(0, least(upto, origin + more - words) - (upto - size)), 0) AS BIGINT) AS taken
FROM lined"""


def mix_sql(sized: str, spark: bool) -> str:
    h60 = (lambda x: f"CAST(conv(substring(md5({x}), 1, 15), 16, 10) AS BIGINT)") if spark else (lambda x: f"CAST(('0x' || substr(md5({x}), 1, 15)) AS BIGINT)")
    return MIX.format(
        sized=sized, n_weights=len(WEIGHTS), weights=" ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS)), cap=CAP, factor=FACTOR, block=BLOCK, shard_docs=SHARD_DOCS,
        explode="explode" if spark else "unnest", sequence="sequence" if spark else "generate_series",
        h60_doc=h60(f"concat('{SEED}', ':', coalesce(CAST(doc_id AS {'STRING' if spark else 'VARCHAR'}), ''))"),
        h60_shard=h60(f"concat('{SEED}', ':', CAST(l.pos AS {'STRING' if spark else 'VARCHAR'}), ':', CAST(l.shard AS {'STRING' if spark else 'VARCHAR'}))"),
    )


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def mix(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of docs (doc_id, source, text, ...)."""
    sized = written(spark, sizes(docs), "sizes")  # texts are read once; the passes below read three narrow columns
    view = f"inkwell_sized_{uuid.uuid4().hex}"
    sized.createOrReplaceTempView(view)
    return spark.sql("WITH " + mix_sql(view, spark=True).lstrip())


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, table(spark, sf_dir, "documents"))


ORACLE = "WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0) AS BIGINT) AS size FROM documents)," + mix_sql("sized", spark=False)


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document comes as many times as the mix takes it, to the nearest whole copy (0, 1 or 2);
    one without words not at all."""
    kept = docs.select("*", F.struct(*[F.col(c) for c in docs.columns]).alias("_ink_row")).select("_ink_row")
    sized = kept.select(F.col("_ink_row.doc_id").alias("doc_id"), F.col("_ink_row.source").alias("source"), F.col("_ink_row.text").alias("text"))
    plan = mix(spark, sized)
    copies = plan.groupBy(F.col("doc_id").alias("_ink_id"), F.col("size").alias("_ink_size")).agg(F.round(F.try_divide(F.sum("taken"), F.sum("size"))).cast("int").alias("_ink_n"))
    rows = docs.withColumn("_ink_words", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    out = rows.join(copies, rows["doc_id"].eqNullSafe(copies["_ink_id"]) & (rows["_ink_words"] == copies["_ink_size"]))
    return out.where("_ink_n > 0").withColumn("_ink_copy", F.explode(F.sequence(F.lit(1), F.col("_ink_n")))).select(*docs.columns)
