"""Tokenizers and string helpers, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.plans.profile import MAX_TERM

WORD, IDENT = "[A-Za-z0-9]", "[A-Za-z0-9_]"


def tokenize(text: Column, word: str = WORD, lower: bool = True, max_len: int = MAX_TERM) -> Column:
    """Runs of word characters in order. They are matched before lower-casing: some letters outside ASCII lower to
    ASCII ones. Longer words are cut, not dropped."""
    words = F.regexp_extract_all(text, F.lit(f"{word}+"), F.lit(0))
    return F.transform(words, lambda w: F.substring(F.lower(w) if lower else w, 1, max_len))


def tokenize_dropping_last(text: Column, word: str = IDENT, max_len: int = MAX_TERM) -> Column:
    """The first generation's reader: a word that ends the text without a delimiter is lost."""
    return tokenize(F.regexp_replace(text, f"{word}+\\z", ""), word, False, max_len)


def counted(rows: DataFrame, words: str = "words") -> DataFrame:
    """rows with (term, dtf) in place of their words, a row for each distinct one: runs of the sorted words, so no two
    rows meet. What follows the runs are arrays, so it stands in selects of its own, each evaluated once."""
    rest = [c for c in rows.columns if c != words]
    rows = rows.select(*rest, F.sort_array(words).alias("_w"))
    first = F.transform("_w", lambda x, i: F.when((i == 0) | (x != F.get("_w", i - 1)), i))
    rows = rows.select(*rest, "_w", F.array_compact(first).alias("_at"))
    runs = F.transform("_at", lambda a, k: F.struct(F.get("_w", a).alias("term"), (F.coalesce(F.get("_at", k + 1), F.size("_w")) - a).cast("long").alias("dtf")))
    return rows.select(*rest, F.inline(runs))


def ends_with(text: Column, suffix: str) -> Column:
    return F.lower(text).endswith(suffix.lower())


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def binary_guard(text: Column, most: int = 50) -> Column:
    """text up to its most-th binary character (below a space or above 127, white space aside); the word that this
    character ends is dropped. Texts with fewer are whole."""
    binary = r"[^\x20-\x7f\s]"
    head = F.regexp_extract(text, rf"(?s)^(?:[\x20-\x7f\s]*{binary}){{{most}}}", 0)
    return F.when(head == "", text).otherwise(F.regexp_replace(head, rf"[A-Za-z0-9]*{binary}\z", ""))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[\\n\\t\\r\\f ]+", " "))


def split_fields(line: Column) -> Column:
    """^-separated fields; adjacent separators make empty fields, blanks at ends of fields go."""
    return F.transform(F.split(line, "\\^", -1), lambda x: F.rtrim(x))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    n = F.least(F.length(a), F.length(b))
    steps = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(steps, lambda i: F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i))).cast("long")


def result_title(doc_title: Column, file_title: Column, name: Column) -> Column:
    """A sub-document's title in italics and its file's; else the file's title; else its name."""
    file = F.coalesce(F.nullif(file_title, F.lit("")), name)
    return F.when(F.coalesce(doc_title, F.lit("")) != "", F.concat(F.lit("<i>"), doc_title, F.lit("</i> "), file)).otherwise(file)


def absolute_link(name: Column, host: str) -> Column:
    link = F.when(F.lower(name).startswith("http://"), name).otherwise(F.concat(F.lit(f"http://{host}/"), F.ltrim(F.translate(name, "\\", "/"))))
    return F.replace(link, F.lit(" "), F.lit("%20"))


def substituted(template: str, values: dict[str, Column]) -> Column:
    """template with each %x replaced."""
    out = F.lit(template)
    for mark, value in values.items():
        out = F.replace(out, F.lit(mark), value)
    return out
