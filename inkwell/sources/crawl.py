"""Link extraction, link filters and reachability over stored pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.plans.scratch import kept

LINKS = [("a", "href"), ("img", "src"), ("img", "href"), ("body", "background"), ("frame", "src"), ("iframe", "src"), ("fig", "src"), ("overlay", "src"), ("applet", "code"), ("script", "src"), ("embed", "src"), ("bgsound", "src"), ("area", "href"), ("img", "lowsrc"), ("input", "src"), ("layer", "src"), ("table", "background"), ("th", "background"), ("td", "background"), ("base", "href")]


def links(pages: DataFrame) -> DataFrame:
    """(page_id, tag, attr, link) of the attributes that name other pages, refresh targets of meta tags too. Pages go
    through one pass of all patterns."""
    one = lambda tag, attr: F.transform(
        F.regexp_extract_all("html", F.lit(f"(?is)<{tag}\\s(?:[^>]*\\s)?{attr}\\s*=\\s*\"([^\"]*)\""), F.lit(1)), lambda x: F.struct(F.lit(tag).alias("tag"), F.lit(attr).alias("attr"), x.alias("link"))
    )
    meta = F.transform(F.regexp_extract_all("html", F.lit("(?is)<meta\\s[^>]*content\\s*=\\s*\"\\d+;\\s*url=([^\"]*)\""), F.lit(1)), lambda x: F.struct(F.lit("meta").alias("tag"), F.lit("content").alias("attr"), x.alias("link")))
    found = F.concat(*[one(t, a) for t, a in LINKS], meta)
    return pages.select("page_id", "url", F.explode(found).alias("l")).select("page_id", "url", "l.tag", "l.attr", "l.link")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, no default port, / for an empty path."""
    u = F.regexp_replace(url, "#.*$", "")
    head = F.lower(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    head = F.regexp_replace(head, "^(http://[^/]*):80$", "$1")
    rest = F.substr(u, F.length(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)) + 1)
    return F.when(head == "", u).otherwise(F.concat(head, F.when(rest == "", "/").otherwise(rest)))


def resolved(base: Column, link: Column) -> Column:
    """Absolute, root-relative and plain relative links without dot segments, by expressions; functions.urls.joined
    does the rest."""
    origin = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    return F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1), link)).when(link.startswith("/"), F.concat(origin, link)).otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), link))


def is_relative(link: Column) -> Column:
    return ~link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") & ~link.startswith("//")


def in_domains(url: Column, accept: list[str], reject: list[str] = ()) -> Column:
    """A host that ends with one of accept (any, if there is none) and with none of reject."""
    ends = lambda names: F.lit(False) if not names else F.array_contains(F.array(*[host(url).endswith(n.lower()) for n in names]), True)
    return (ends(accept) if accept else F.lit(True)) & ~ends(list(reject))


def below(url: Column, folder: str) -> Column:
    return path(url).startswith(folder)


def glob_pattern(glob: str) -> str:
    """A file glob (* ? [set]) as a regular expression; a plain name is a suffix."""
    if not re.search(r"[*?\[]", glob):
        return f"{re.escape(glob)}$"
    out = ""
    for part in re.split(r"(\*|\?|\[[^\]]*\])", glob):
        out += {"*": ".*", "?": "."}.get(part, part.replace("[!", "[^") if part.startswith("[") else re.escape(part))
    return f"^{out}$"


def accepted(url: Column, accept: list[str] = (), reject: list[str] = ()) -> Column:
    """By name of the file: suffixes or globs. HTML is always accepted, as its links are wanted."""
    name = F.regexp_replace(path(url), "^.*/", "")
    any_of = lambda globs: F.lit(False) if not globs else F.array_contains(F.array(*[name.rlike(glob_pattern(g)) for g in globs]), True)
    html = name.rlike(r"(?i)\.html?$")
    return html | ((any_of(list(accept)) if accept else F.lit(True)) & ~any_of(list(reject)))


def robots_rules(text: str, agent: str = "inkwell") -> list[str]:
    """Disallowed path beginnings for agent, else for *."""
    rules: dict[str, list[str]] = {}
    names, fresh = [], True
    for line in text.splitlines():
        key, _, value = line.partition("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            names = [*([] if fresh else names), value.lower()] if not fresh else [value.lower()]
            fresh = False
            rules.setdefault(value.lower(), [])
        elif key == "disallow":
            fresh = True
            for n in names:
                if value:
                    rules[n].append(value)
    own = next((n for n in rules if n != "*" and n in agent.lower()), "*")
    return rules.get(own, [])


def allowed(url: Column, rules: list[str]) -> Column:
    return F.lit(True) if not rules else ~F.array_contains(F.array(*[path(url).startswith(r) for r in rules]), True)


def within_quota(pages: DataFrame, most: int, width: int = 4096) -> DataFrame:
    """Pages of each host, in order of page_id, until the host's bytes reach most; the page that passes it is kept. Bytes
    are summed by blocks of page_id first, and only blocks that begin below the quota are gone through page by page, so
    a host with very many pages is not one task."""
    rows = pages.withColumns({"_host": host(F.col("url")), "_block": F.floor(F.col("page_id") / width), "_size": F.octet_length("html")})
    so_far = Window.partitionBy("_host").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_host", "_block").agg(F.sum("_size").alias("_sum")).select("_host", "_block", F.coalesce(F.sum("_sum").over(so_far), F.lit(0)).alias("_below")).where(F.col("_below") < most)
    w = Window.partitionBy("_host", "_block").orderBy("page_id").rowsBetween(Window.unboundedPreceding, -1)
    kept_rows = rows.join(sums, ["_host", "_block"]).withColumn("_before", F.col("_below") + F.coalesce(F.sum("_size").over(w), F.lit(0)))
    return kept_rows.where(F.col("_before") < most).select(*pages.columns)


def reachable(edges: DataFrame, start: DataFrame, levels: int = 5) -> DataFrame:
    """(node, depth) within levels links of start (node); edges (src, dst). Each round joins the newest nodes only and
    writes what it finds, so lineage ends with every round and nothing is kept in memory."""
    edges = kept(edges.select("src", "dst"), "edges")
    fresh = seen = kept(start.select("node").distinct().withColumn("depth", F.lit(0)), "reached")
    for depth in range(1, levels + 1):
        found = fresh.join(edges, fresh["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        fresh = kept(found.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), "reached")
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh)
    return seen
