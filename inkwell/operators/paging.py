"""Pages of results, their metadata, and rows as HTML, XML and console text."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.text import absolute_link, result_title, substituted
from inkwell.plans.scratch import kept


@dataclass(frozen=True)
class Page:
    matches: int
    size: int
    pages: int
    page: int
    start: int
    stop: int

    @property
    def message(self) -> str:
        return f"Page {self.page} displayed, out of {self.pages} pages, containing {self.matches} items"

    def buttons(self) -> dict[str, bool]:
        return {"first": self.page > 1, "prev": self.page > 1, "next": self.page < self.pages, "last": self.page < self.pages}


def page_of(matches: int, size: int, page: int) -> Page:
    """Rows start to stop, counted from 1; a page beyond the last is the last; size 0 or less: one page of all."""
    if size <= 0:
        return Page(matches, size, 1, 1, 1, matches)
    pages = ceil(matches / size)
    page = pages if page > pages else max(1, page)
    start = max(1, size * (page - 1) + 1)
    return Page(matches, size, pages, page, start, min(start + size - 1, matches))


ORDER = (("score", False), ("docnum", True))


def page_rows(results: DataFrame, page: Page, order: tuple[tuple[str, bool], ...] = ORDER, near: int = 10_000) -> DataFrame:
    """The page's rows of results, in the order of columns (name, ascending) that tell all rows apart. Pages within near
    rows of the first are a top-k, those within near of the last are one from the other end. For pages deep in between,
    the rows are written in ranges of the order, each range is counted, and only ranges that hold the page are read."""
    n = page.stop - page.start + 1
    keys = [F.col(c) if up else F.desc(c) for c, up in order]
    if n <= 0:
        return results.limit(0)
    if page.stop <= near:
        return results.orderBy(*keys).offset(page.start - 1).limit(n)
    if page.matches - page.start < near:
        back = [F.desc(c) if up else F.asc(c) for c, up in order]
        return results.orderBy(*back).offset(page.matches - page.stop).limit(n).orderBy(*keys)
    ranges = kept(results.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "ranges")
    before, wanted = 0, []
    for r in ranges.groupBy("_range").count().orderBy("_range").collect():  # a row a partition
        if before < page.stop and before + r["count"] >= page.start:
            wanted.append((r["_range"], before))
        before += r["count"]
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in wanted for x in kv]), F.col("_range"))
    rows = ranges.where(F.col("_range").isin([k for k, _ in wanted]))
    rows = rows.withColumn("_at", offset + F.row_number().over(Window.partitionBy("_range").orderBy(*keys)))
    return rows.where(F.col("_at").between(page.start, page.stop)).drop("_at", "_range").orderBy(*keys)


def with_metadata(rows: DataFrame, docs: DataFrame, host: str = "localhost") -> DataFrame:
    """Metadata of one page's rows only: docs (docnum, doc_title, file_title, name, size)."""
    j = rows.join(docs, "docnum", "left")
    return j.select("*", result_title(F.col("doc_title"), F.col("file_title"), F.col("name")).alias("title"), absolute_link(F.col("name"), host).alias("link"))


ROW = '<li><a href="%l">%t</a> %r %h %s</li>'


def row_html(template: str = ROW) -> Column:
    """%l link, %t title, %r rank, %h hits, %s size, %% a per cent sign."""
    mark = "\x01"
    values = {"%%": F.lit(mark), "%l": F.col("link"), "%t": F.col("title"), "%r": F.format_string("%.2f", "score"), "%h": F.col("hits").cast("string"), "%s": F.col("size").cast("string")}
    return F.replace(substituted(template, values), F.lit(mark), F.lit("%"))


def row_xml() -> Column:
    return F.format_string("<docfile><docnum>%d</docnum><rank>%.2f</rank><hits>%d</hits></docfile>", "docnum", "score", "hits")


def row_console() -> Column:
    return F.format_string("{ Doc(%d), Score(%.2f), Hits(%d) }", "docnum", "score", "hits")


SECTIONS = ("page_head", "search_form", "summary", "nav_top", "list_head", "list_row", "list_foot", "nav_bottom", "nav_first", "nav_prev", "nav_next", "nav_last", "empty", "page_foot")


def load_template(text: str) -> dict[str, str]:
    """Sections of a result page, each after a line ##name##; those that the text lacks are empty."""
    out, name = dict.fromkeys(SECTIONS, ""), None
    for line in text.splitlines(keepends=True):
        mark = line.strip()
        if len(mark) > 4 and mark.startswith("##") and mark.endswith("##"):
            name = mark[2:-2].removeprefix("ys_")
            out[name] = ""
        elif name:
            out[name] += line
    return out


def result_page(rows: list[str], page: Page, template: dict[str, str] | None = None, link: str = "") -> str:
    """One page of rendered rows (a page's worth is small) between the template's parts."""
    t = template or {**dict.fromkeys(SECTIONS, ""), "page_head": "<html><body>\n", "list_head": "<ol>\n", "list_foot": "</ol>\n", "page_foot": "</body></html>\n"}
    to = {"nav_first": 1, "nav_prev": page.page - 1, "nav_next": page.page + 1, "nav_last": page.pages}
    nav = "".join(t[f"nav_{k}"].replace("%l", f"{link}&page={to[f'nav_{k}']}") for k, on in page.buttons().items() if on)
    body = t["list_head"] + "\n".join(rows) + "\n" + t["list_foot"] if rows else t["empty"]
    return t["page_head"] + t["search_form"] + t["summary"] + page.message + "\n" + t["nav_top"] + nav + body + t["nav_bottom"] + t["page_foot"]
