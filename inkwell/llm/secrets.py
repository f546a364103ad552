"""Secret scans over an incremental blob ledger (native DataFrame functions only).

Every version of every path is content-addressed (SHA-256 of its text). The ledger is a folder of runs, each with the
pairs (blob, rule and its version) that it scanned and what it found; a rule's version is a digest of its expression. A
blob is scanned for the rules whose pair no run has, equal texts once however many paths hold them; then the findings of
all runs under the rules as they are now are joined back to all paths. A run is written beside the ledger and renamed
into it, so a run that fails leaves nothing. The folder is the session's LEDGER setting, to be kept from one version of
the corpus to the next; without it every call has a ledger of its own. scan() is the scanner alone.

Match positions come from pairing regexp_extract_all with split: the lengths of the pieces between matches and of the
matches, summed up, are the offsets (in code points). Only lengths leave the projection that holds the text.

Defined cases: null text is the empty blob (no findings); null or repeated paths keep their rows; an empty table or
ledger works; texts of any length are scanned whole, and no array is folded quadratically (offsets are running sums
over exploded rows); other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm.shared import scratch_path, table, written
from inkwell.plans.scratch import exists

RULE_VERSION = "2"
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Added to the base kinds: forge, chat and cloud tokens, web tokens and headers of private keys.
VENDOR = r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|-----BEGIN [A-Z ]*PRIVATE KEY-----"
#: (kind, expression, least length of the match's group 2 or None): in order of listing.
RULES = (("assign", ASSIGN, 6), ("access", ACCESS, None), ("hex", HEX, None), ("vendor", VENDOR, None))
BASE = ("assign", "access", "hex")
LEDGER = "spark.inkwell.secrets.ledger"


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan(blobs: DataFrame, ledger: DataFrame | None = None, rules=RULES, rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """blobs: (blob_id, text), repeats included. Findings (blob_id, kind, ord, start, stop) of pairs that the ledger
    (blob_id, rule_version) has not, in code points, stop exclusive; and those pairs, to be added to the ledger. Where
    blobs have a column todo, an array of kinds, only those are looked for."""
    todo = F.col("todo") if "todo" in blobs.columns else F.array(*[F.lit(r[0]) for r in rules])
    new = blobs.select("blob_id", F.coalesce("text", F.lit("")).alias("text"), todo.alias("todo"))
    if ledger is not None:
        new = new.join(ledger.where(F.col("rule_version") == rule_version).select("blob_id"), "blob_id", "left_anti")
    new = new.dropDuplicates(["blob_id"])
    found = new
    for kind, rx, _ in rules:
        found = found.withColumn(f"m_{kind}", F.when(F.array_contains("todo", kind), F.regexp_extract_all("text", F.lit(rx), F.lit(0))))
    each = []
    for k, (kind, rx, least) in enumerate(rules):
        m = F.col(f"m_{kind}")
        ok = F.transform(m, long_enough(rx, least))
        lengths = F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("ord"), F.transform(m, F.length).alias("match"), F.transform(F.split("text", rx, -1), F.length).alias("gap"), ok.alias("ok"))
        each.append(F.when(F.size(m) > 0, lengths))
    rows = found.select("blob_id", F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("r"))
    rows = rows.select("blob_id", "r.kind", "r.ord", F.posexplode(F.arrays_zip("r.match", "r.gap", "r.ok")).alias("i", "z")).where(F.col("z.match").isNotNull())
    so_far = Window.partitionBy("blob_id", "ord").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("stop", F.sum(F.col("z.match") + F.col("z.gap")).over(so_far))
    rows = rows.where("z.ok").select("blob_id", "kind", "ord", (F.col("stop") - F.col("z.match")).alias("start"), "stop")
    return rows, new.select("blob_id", F.lit(rule_version).alias("rule_version"))


def long_enough(rx: str, least: int | None):
    return lambda x: F.lit(True) if least is None else F.length(F.regexp_extract(x, rx, 2)) >= least


class Ledger:
    """Runs of scans under a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @staticmethod
    def of(spark: SparkSession) -> Ledger:
        return Ledger(spark, spark.conf.get(LEDGER, None) or scratch_path(spark, "ledger"))

    def read(self, name: str, schema: str) -> DataFrame:
        """A table of all runs; no rows if there is none."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.path}/run-*/{name}")

    def add(self, findings: DataFrame, pairs: DataFrame) -> None:
        """One run: written under a name that no reader looks at, then renamed."""
        run = uuid.uuid4().hex
        findings.write.parquet(f"{self.path}/.new-{run}/findings")
        pairs.write.parquet(f"{self.path}/.new-{run}/pairs")
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.rename(path(f"{self.path}/.new-{run}"), path(f"{self.path}/run-{run}")):
            raise OSError(f"cannot add a run to {self.path}")

    def scanned(self, blobs: DataFrame, rules=RULES) -> DataFrame:
        """(blob_id, kind, ord, start, stop) of all that all runs found under these rules, after one more run for the
        pairs of blobs (blob_id, text) that none has."""
        version = {kind: f"{kind}@{hashlib.md5(f'{rx} {least}'.encode()).hexdigest()[:12]}" for kind, rx, least in rules}
        kinds, now = list(version), F.array(*[F.lit(v) for v in version.values()])
        if exists(self.spark, self.path):
            known = self.read("pairs", "blob_id string, rules array<string>").select("blob_id", F.explode("rules").alias("rule"))
            known = known.where(F.col("rule").isin(list(version.values()))).groupBy("blob_id").agg(F.collect_set("rule").alias("done"))  # a rule once
            todo = blobs.select("blob_id").distinct().join(known, "blob_id", "left").select("blob_id", F.array_except(now, F.coalesce("done", F.array().cast("array<string>"))).alias("rules")).where(F.size("rules") > 0)
            todo = written(self.spark, todo, "unseen")
            texts = blobs.select("blob_id", "text").join(todo, "blob_id")
        else:  # nothing is known: no join
            texts = blobs.select("blob_id", "text", now.alias("rules"))
            todo = blobs.select("blob_id").distinct().select("blob_id", now.alias("rules"))
        found, _ = scan(texts.select("blob_id", "text", F.transform("rules", lambda r: F.substring_index(r, "@", 1)).alias("todo")), rules=rules)
        rule = F.element_at(F.create_map(*[F.lit(x) for kv in version.items() for x in kv]), F.col("kind")) if version else F.lit("")
        self.add(found.select("blob_id", rule.alias("rule"), "start", "stop"), todo)
        every = self.read("findings", "blob_id string, rule string, start bigint, stop bigint").where(F.col("rule").isin(list(version.values())))
        kind = F.substring_index("rule", "@", 1)
        order = F.array_position(F.array(*[F.lit(k) for k in kinds]), kind) - 1
        return every.select("blob_id", kind.alias("kind"), order.cast("int").alias("ord"), "start", "stop")


def digest(findings: DataFrame) -> DataFrame:
    """One row a blob: counts by base kind, spans in order. Grouped per blob, so bounded by one text's matches."""
    spans = F.sort_array(F.collect_set(F.struct("start", "ord", "kind", "stop"))).alias("spans")
    return findings.groupBy("blob_id").agg(spans)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    paths = docs.select("doc_id", blob_id(F.col("text")).alias("blob_id"))
    found = Ledger.of(spark).scanned(docs.select(blob_id(F.col("text")).alias("blob_id"), "text"))
    found = written(spark, digest(found), "findings")  # so that the join back stands alone, and a blob of many paths can be split in it
    out = paths.join(found, "blob_id", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:bigint,ord:int,kind:string,stop:bigint>>")))
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["ord"] < len(BASE))
    return out.select("doc_id", *[n(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _oracle() -> str:
    parts = []
    for k, (kind, rx, least) in enumerate(RULES):
        q = rx.replace("'", "''")
        ok = "true" if least is None else f"len(regexp_extract(m[i], '{q}', 2)) >= {least}"
        parts.append(f"""SELECT doc_id, '{kind}' AS kind, {k} AS ord, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda i: struct_pack(ok := {ok},
            stop := list_sum(list_transform(m[1:i], lambda x: length(x))) + list_sum(list_transform(g[1:i], lambda x: length(x))), size := length(m[i]))), lambda x: x.ok)) AS z
            FROM (SELECT doc_id, regexp_extract_all(t, '{q}') AS m, string_split_regex(t, '{q}') AS g FROM docs)""")
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        spans AS (SELECT doc_id, kind, ord, CAST(z.stop - z.size AS BIGINT) AS start, CAST(z.stop AS BIGINT) AS stop FROM ({' UNION ALL '.join(parts)}))
        SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        sha256(coalesce(string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, ord) FILTER (ord < {len(BASE)}), '')) AS base_sha256,
        coalesce(string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, ord) FILTER (kind IS NOT NULL), '') AS spans
        FROM docs d LEFT JOIN spans s ON d.doc_id = s.doc_id GROUP BY d.doc_id"""


ORACLE = _oracle()
MARK = "[redacted]"


def redacted(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with every finding in text replaced by MARK; overlapping findings are one. Other columns and rows stay."""
    keyed = docs.withColumn("_ink_blob", blob_id(F.col("text")))
    found = Ledger.of(spark).scanned(keyed.select(F.col("_ink_blob").alias("blob_id"), "text"))
    before = Window.partitionBy("blob_id").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    cut = found.withColumn("kept_from", F.coalesce(F.max("stop").over(before), F.lit(0).cast("long"))).where("stop > kept_from")
    piece = F.struct("kept_from", F.when(F.col("start") >= F.col("kept_from"), F.col("start") - F.col("kept_from")).otherwise(-1).alias("n"), "stop")
    cuts = cut.groupBy(F.col("blob_id").alias("_ink_b")).agg(F.sort_array(F.collect_list(piece)).alias("_ink_cuts"))
    cuts = written(spark, cuts, "cuts")
    t, c = F.col("text"), F.col("_ink_cuts")
    sub = lambda a, n: F.substring(t, a.cast("int") + 1, n.cast("int"))
    head = F.array_join(F.transform(c, lambda x: F.when(x["n"] >= 0, F.concat(sub(x["kept_from"], x["n"]), F.lit(MARK))).otherwise(F.lit(""))), "")
    text = F.when(c.isNotNull(), F.concat(head, sub(F.element_at(c, -1)["stop"], F.length(t)))).otherwise(t)
    return keyed.join(cuts, keyed["_ink_blob"] == cuts["_ink_b"], "left").withColumn("text", text).select(*docs.columns)


def stage_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: secrets are replaced in the texts; every document stays."""
    return redacted(spark, docs)
