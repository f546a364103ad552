"""Toxicity through a noisy channel: disguised words are decoded, then the restored text is scored.

A token with digits or signs among letters, a letter three times in a row, or single letters strung together by
signs or spaces is a lattice of characters: each sign stands for the letters it is used for (or for nothing), each
run for one or two letters. Viterbi decoding under an interpolated character trigram model, counted over all
documents, picks the word. Letters strung together may be several words: they are read as one and, with word ends allowed
at the gaps at each cost of ENDS, as what the model makes of them; gaps wider than a space end words too. Other tokens
have one path through their lattice and stay as they are. A lattice of more than WINDOW places (a run is one) is
decoded in windows that overlap by WINDOW - STRIDE, more than a word. Decoding is done once a distinct token and kept in
a bounded cache; it depends on the token alone.

The scorer is fitted on a bounded sample of labelled rows, POSITIVES and NEGATIVES at most, and of each kind no more
rows than reach SAMPLE_BYTES, chosen by hash, none of them held out; an id that has several texts or labels is there
once, with the least text and the highest label. Every feature that the sample supports is kept, so the model is
bounded by the sample. Words and their beginnings (4 to 6 letters) get the lower bound of their log-odds of label 1; then,
twice, a text of label 1 counts for its strongest words alone (NEAR the best), so that what merely stands beside them
loses its weight. Weights of two thirds of the sample give the evidence on which, in the other third, a logistic
function of a text's strongest words, their sum and the text's length is calibrated, with the classes weighed back to
their true shares; it is used with the weights of the whole sample. Only text enters a score.

Defined cases: null and empty texts get the score of no evidence; a null doc_id counts as '' for the split; repeated
rows score alike; with no usable labels every score is the share of label 1 (0 without labels); texts are read whole;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from inkwell.llm.shared import ship, table, written

POSITIVES, NEGATIVES, SAMPLE_BYTES = 6_000, 12_000, 1 << 26
WINDOW, STRIDE = 64, 48
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
PREFIXES = (4, 5, 6)
SURE, LEAST, ROUNDS, NEAR = 1.5, 0.3, 2, 0.75
ENDS = (0.0, 3.0)
CACHE = 200_000
NO_FIT = [0.0] * 5

LETTERS = re.compile(r"[^\W\d_]+")
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "¡": "i", "*": "aeiou", "#": "aeiou"}
GAPS = set(".-_*~'·:,")
_S = re.escape("".join(k for k in SIGNS if not k.isdigit()))
DISGUISED = re.compile(rf"[^\W\d_][\d{_S}]+[^\W\d_]|(?:^|\W)[\d{_S}][^\W\d_]|[^\W\d_][\d$@]$|([^\W\d_])\1\1|[^\W_][.\-_*~'·:,][^\W_][.\-_*~'·:,][^\W_]")
SPACED = re.compile(rf"(?<!\S)(?:[\w{_S}]\s+){{2,}}[\w{_S}](?!\S)")
RUN = re.compile(r"(.)\1*", re.DOTALL)
STRUNG = re.compile(r"[^\W_][.\-_*~'·:,][^\W_][.\-_*~'·:,][^\W_]")
PIECES = re.compile(rf"[^\w{_S}.\-~'·:,]+")
CLASSES = 28


def char_class(c: str) -> int:
    """0: word end, 1 to 26: a to z, 27: other letters."""
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c >= "\x80" else 0


_TABLE = np.array([b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else 27 if b >= 128 else 0 for b in range(256)], np.int64)


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CLASSES**3, np.int64)
    for b in batches:
        for text in b.column(0):
            raw = text.as_py()
            for k in range(0, len(raw or ""), 1 << 20):
                x = _TABLE[np.frombuffer(("\n" + raw[max(0, k - 2) : k + (1 << 20)] + "\n").encode(), np.uint8)]
                total += np.bincount((x[:-2] * CLASSES + x[1:-1]) * CLASSES + x[2:], minlength=CLASSES**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])


class CharModel:
    """log P(c | a, b), interpolated from trigrams to single letters."""

    def __init__(self, counts: np.ndarray):
        n3 = counts.reshape(CLASSES, CLASSES, CLASSES).astype(float)
        n2, n1 = n3.sum(0), n3.sum((0, 1))
        p1 = (n1 + 1) / (n1.sum() + CLASSES)
        p2 = (n2 + 10 * p1) / (n2.sum(1, keepdims=True) + 10)
        self.cost = -np.log((n3 + 10 * p2) / (n3.sum(2, keepdims=True) + 10))
        self.table = self.cost.tolist()

    def decode(self, token: str, end: float | None = None) -> str:
        """The likeliest word behind a lower-case token; words between spaces, if gaps may be word ends at that cost."""
        lattice: list[list[tuple[str, float]]] = []
        k = 0
        while k < len(token):
            c, run = token[k], 1
            while k + run < len(token) and token[k + run] == c:
                run += 1
            if c in SIGNS:
                ways = [(x, 1.0) for x in SIGNS[c]] + ([("", 2.0)] if c in GAPS or not c.isdigit() else [])
                if end is not None and c in GAPS:
                    ways = [*ways, (" ", end)]
                lattice += [ways] * min(run, 2)
            elif c.isalpha():
                lattice.append([(c, 0.0), (c + c, 0.5)] if run > 2 else [(c * run, 0.0)])
            elif c in GAPS or c == " ":
                lattice.append([("", 0.0)] if end is None else [("", 0.0), (" ", end)])
            k += run
        states = {(0, 0): (0.0, "")}
        for ways in lattice:
            after: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (cost, word) in states.items():
                for letters, own in ways:
                    x, y, total = a, b, cost + own
                    for ch in letters:
                        z = char_class(ch)
                        total += self.table[x][y][z]
                        x, y = y, z
                    if (x, y) not in after or (total, word + letters) < after[x, y]:
                        after[x, y] = (total, word + letters)
            states = after
        return min((cost + self.table[a][b][0], word) for (a, b), (cost, word) in states.items())[1]

    def read(self, letters: str) -> set[str]:
        """Words of letters with gaps between them: all as one, and with word ends at gaps."""
        return {w for end in (None, *ENDS) for w in self.decode(letters, end).split() if len(w) > 2}


def windows(places: list[str], join: str = "") -> Iterator[str]:
    """The places joined: all of them, or WINDOW after every STRIDE."""
    for k in range(0, len(places), STRIDE):
        yield join.join(places[k : k + WINDOW])
        if k + WINDOW >= len(places):
            break


class Reader:
    """Text to its distinct features, by way of a bounded cache of tokens."""

    def __init__(self, chars: CharModel):
        self.chars, self.new, self.old = chars, {}, {}

    def words(self, token: str) -> tuple[str, ...]:
        """Plain words of a lower-case token and, if it looks disguised, the one behind it."""
        found = (self.new.get(token) or self.old.get(token)) if len(token) <= 64 else None
        if found is None:
            plain = [w for w in LETTERS.findall(token) if len(w) > 2]
            if DISGUISED.search(token):
                bare = token.strip("!?.,;:()[]{}\"'`*%&^~<>|=#")
                for piece in PIECES.split(bare):
                    if len(piece) > 2:
                        for part in [piece] if len(piece) <= WINDOW else windows([m[0] for m in RUN.finditer(piece)]):
                            plain += [w for w in (self.chars.read(part) if STRUNG.search(piece) else {self.chars.decode(part)}) if w]
            found = tuple(dict.fromkeys(plain))
            if len(token) <= 64:
                self.new[token] = found
                if len(self.new) > CACHE:
                    self.old, self.new = self.new, {}
        return found

    def of(self, text: str | None) -> set[str]:
        low = (text or "").lower()
        tokens = low.split()
        out = {w for t in set(tokens) for w in self.words(t)}
        if b"\1\1\1" in bytes(map((1).__eq__, map(len, tokens))):  # single characters, three in a row
            for m in SPACED.finditer(low):
                parts = re.split(r"\s\s+|[^\S ]", m[0])
                for run in [m[0], *(parts if len(parts) > 1 else [])]:
                    for part in windows(run.split(), " "):
                        out |= self.chars.read(part)
        return out


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}~" for n in PREFIXES if len(word) >= n)]


class Scorer(Reader):
    def __init__(self, chars: CharModel, weights: dict[str, float], fit: list[float]):
        super().__init__(chars)
        self.weights, self.fit, self.best = weights, fit, {}

    def evidence(self, text: str | None) -> tuple[float, ...]:
        """The strongest weight, the sum of the three strongest and the logarithm of all (of different words' best
        features), and the logarithm of how many different words there are."""
        get, top, words = self.weights.get, [], self.of(text)
        for w in words:
            if (x := self.best.get(w)) is None:
                x = max((get(f, 0.0) for f in features(w)), default=0.0)
                if len(self.best) > CACHE:
                    self.best = {}
                self.best[w] = x
            if x > 0:
                top.append(x)
        top.sort()
        return (top[-1] if top else 0.0, sum(top[-3:]), math.log1p(sum(top)), math.log1p(len(words)) if top else 0.0)

    def score(self, text: str | None) -> float:
        z = self.fit[0] + sum(b * x for b, x in zip(self.fit[1:], self.evidence(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def char_model(docs: DataFrame) -> CharModel:
    """Counted over all documents; what comes to the driver is bounded by the cube of the alphabet."""
    rows = docs.select("text").mapInArrow(_trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(CLASSES**3, np.int64)
    for r in rows:
        counts[r["gram"]] = r["n"]
    return CharModel(counts)


def _count(chars):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, n = Reader(chars.value), (Counter(), Counter())
        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n[label].update({f for w in reader.of(text) for f in features(w)})
        keys = list(n[0] | n[1])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([n[1][k] for k in keys], pa.int64()), pa.array([n[0][k] for k in keys], pa.int64())], ["f", "pos", "neg"])

    return run


def _credit(scorer):
    """Of each text the features of its best words: what merely stands beside stronger words gets no credit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, n = scorer.value, Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                found = {w: max(s.weights.get(f, 0.0) for f in features(w)) for w in s.of(text)}
                least = NEAR * max(found.values(), default=0.0)
                n.update({f for w, x in found.items() if x > 0 and x >= least for f in features(w) if f in s.weights})
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["f", "pos"])

    return run


def _weigh(scorer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scorer.value
        for b in batches:
            x = [s.evidence(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], ["x", "label"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Weighted ridge logistic regression by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    beta, hold = np.zeros(x.shape[1]), np.diag([1e-3] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + hold, x.T @ (w * (y - p)) - hold @ beta)
        beta += np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return beta.tolist()


def odds(pos: float, neg: float, k1: float, k0: float) -> float:
    """The lower bound of a feature's log-odds of label 1."""
    return math.log((pos + 0.5) / (k1 + 1)) - math.log((neg + 0.5) / (k0 + 1)) - SURE * math.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))


def weighed(spark: SparkSession, chars: CharModel, text: DataFrame) -> dict[str, float]:
    """Weights of the features of text (text, label)."""
    sc = spark.sparkContext
    n = {r["label"]: r["count"] for r in text.groupBy("label").count().collect()}
    k1, k0 = n.get(1, 0), n.get(0, 0)
    counted = text.select("text", "label").mapInArrow(_count(sc.broadcast(chars)), "f string, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    p, q = F.col("pos") + 0.5, F.col("neg") + 0.5
    w = F.ln(p / (k1 + 1)) - F.ln(q / (k0 + 1)) - SURE * F.sqrt(1 / p + 1 / q)
    rows = counted.where("pos >= 2").withColumn("w", w).where(F.col("w") > LEAST).collect()  # bounded by the sample
    weights, neg = {r["f"]: r["w"] for r in rows}, {r["f"]: r["neg"] for r in rows}
    for _ in range(ROUNDS):
        own = text.where("label = 1").select("text").mapInArrow(_credit(sc.broadcast(Scorer(chars, weights, NO_FIT))), "f string, pos long").groupBy("f").agg(F.sum("pos").alias("pos")).collect()
        weights = {r["f"]: x for r in own if r["pos"] >= 2 and (x := odds(r["pos"], neg[r["f"]], k1, k0)) > LEAST}
    return weights


def labelled(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, int, int]:
    """The sample (text, label, side), and how many ids of each label it is drawn from."""
    own = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("doc_id")) != HELD_OUT))
    own = own.groupBy("doc_id").agg(F.max("label").alias("label"))
    rate = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
    h = F.xxhash64(F.lit("toxicity"), "doc_id")
    part = lambda y, most: own.where(F.col("label") == y).orderBy(h, "doc_id").limit(most)
    sample = part(1, POSITIVES).union(part(0, NEGATIVES)).withColumn("side", F.pmod(h, F.lit(3)))
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")  # sample: at most POSITIVES + NEGATIVES rows
    text = written(spark, text.groupBy("doc_id", "label", "side").agg(F.min("text").alias("text")), "labelled").withColumn("h", h)
    sizes, last = text.select("label", "h", F.octet_length("text").alias("size")).toPandas().sort_values("h"), F.lit(False)  # bounded by the sample
    for y, own in sizes.groupby("label"):
        last = last | ((F.col("label") == int(y)) & (F.col("h") <= int(own["h"][(own["size"].cumsum() - own["size"]) < SAMPLE_BYTES].max())))
    return written(spark, text.where(last).select("text", "label", "side"), "sample"), rate.get(1, 0), rate.get(0, 0)


def fitted(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Scorer:
    ship(spark)
    chars = char_model(docs)
    text, n1, n0 = labelled(spark, docs, labels)
    share = n1 / max(1, n1 + n0)
    if not n1 or not n0:
        return Scorer(chars, {}, [math.log(max(share, 1e-6) / max(1 - share, 1e-6)), *NO_FIT[1:]])
    half = Scorer(chars, weighed(spark, chars, text.where("side <> 0")), NO_FIT)
    seen = text.where("side = 0").select("text", "label").mapInArrow(_weigh(spark.sparkContext.broadcast(half)), "x array<double>, label int").toPandas()
    weights = weighed(spark, chars, text)
    y = seen["label"].to_numpy(float)
    if not 0 < y.sum() < len(y):
        return Scorer(chars, weights, [math.log(share / (1 - share)) - 2, 1.0, *NO_FIT[2:]])
    w = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum())) * len(y)
    return Scorer(chars, weights, logistic(np.array(seen["x"].tolist()), y, w))


def scorer_udf(spark: SparkSession, scorer: Scorer):
    model = spark.sparkContext.broadcast(scorer)  # bounded by the sample: weights, and the character table

    @F.pandas_udf(DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(model.value.score, na_action=None).astype(float)

    return score


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    score = scorer_udf(spark, fitted(spark, docs, table(spark, sf_dir, "labels")))
    out = docs.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents scored THRESHOLD or more go."""
    score = scorer_udf(spark, fitted(spark, docs, table(spark, sf_dir, "labels")))
    return docs.withColumn("_ink_score", score("text")).where(F.col("_ink_score") < THRESHOLD).select(*docs.columns)
