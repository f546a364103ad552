"""Search requests: from query strings, from text blocks, and the free-text and Boolean query languages."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from urllib.parse import unquote_plus

from inkwell.plans.profile import MAX_TERM, MAX_TERMS, RESERVED


@dataclass(frozen=True)
class SearchRequest:
    collection: str = ""
    expression: str = ""
    method: str = "ranked"
    page: int = 1
    page_size: int = 10
    exact: bool = True
    stem: bool = False
    extra: dict = field(default_factory=dict, compare=False)

    def checked(self) -> SearchRequest:
        """Pages start at 1 and hold 5 rows at least; unknown methods are ranked."""
        method = self.method if self.method in ("ranked", "boolean", "all") else "ranked"
        return SearchRequest(self.collection, self.expression, method, max(1, self.page), max(5, self.page_size), self.exact, self.stem, self.extra)


_FIELDS = {"db": "collection", "collection": "collection", "query": "expression", "q": "expression", "sm": "method", "method": "method", "page": "page", "cp": "page", "ps": "page_size", "pagesize": "page_size", "em": "exact"}


def _from_pairs(pairs: list[tuple[str, str]], words: list[str]) -> SearchRequest:
    got: dict = {"extra": {}}
    for name, value in pairs:
        target = _FIELDS.get(name.lower())
        if target in ("page", "page_size"):
            m = re.match(r"\s*[+-]?\d+", value)
            got[target] = int(m[0]) if m else 0
        elif target == "exact":
            got[target] = not value.lower().startswith("n")
        elif target == "expression":
            words.append(value)
        elif target == "method":
            got[target] = {"bool": "boolean"}.get(value.lower(), value.lower())
        elif target:
            got[target] = value
        else:
            got["extra"][name] = value
    return SearchRequest(**got, expression=" ".join(words)).checked()


def parse_query_string(text: str) -> SearchRequest:
    """name=value&..., with + and %hh decoded; of repeated names the last counts."""
    pairs = [(unquote_plus(a), unquote_plus(b)) for a, _, b in (p.partition("=") for p in text.split("&") if p)]
    return _from_pairs(pairs, [])


def parse_block(text: str) -> SearchRequest:
    """Lines of :name=value, other lines are search terms."""
    pairs, words = [], []
    for line in text.splitlines():
        if line.startswith(":"):
            a, _, b = line[1:].partition("=")
            pairs.append((a.strip(), b.strip()))
        elif line.strip():
            words.append(line.strip())
    return _from_pairs(pairs, words)


@dataclass(frozen=True)
class QueryTerm:
    pos: int
    term: str
    qtf: int


def free_text(query: str, word: str = "[A-Za-z0-9]", lower: bool = True) -> list[QueryTerm]:
    """Distinct words in order of first use with their counts: reserved words left out, the first 50 kept."""
    words = [(w.lower() if lower else w)[:MAX_TERM] for w in re.findall(f"{word}+", query)]
    counts = Counter(w for w in words if w not in RESERVED)
    return [QueryTerm(k, w, n) for k, (w, n) in enumerate(list(counts.items())[:MAX_TERMS])]


# Boolean expressions: ("term", t) | ("and", a, b) | ("or", a, b) | ("not", a)

_V2 = re.compile(r"[()]|[A-Za-z0-9]+")


def _tokens_v2(text: str):
    """Anything but words and parentheses is passed over; keywords are lower-case."""
    for m in _V2.finditer(text):
        t = m[0]
        yield (t if t in ("(", ")", "and", "or", "not") else "term", t[:MAX_TERM])


_V1 = re.compile(r"\s*(?:([()&|!])|(and|or|not)(?=[\s()])|([^\s()]+))", re.IGNORECASE)


def _tokens_v1(text: str):
    """Symbols & | ! too, keywords in any case if a blank or parenthesis follows; terms run to a blank or parenthesis."""
    signs = {"&": "and", "|": "or", "!": "not"}
    at = 0
    while m := _V1.match(text, at):
        if m.end() == at:
            break
        at = m.end()
        if m[1]:
            yield (signs.get(m[1], m[1]), m[1])
        elif m[2]:
            yield (m[2].lower(), m[2])
        else:
            yield ("term", m[3])


class _Parser:
    def __init__(self, tokens):
        self.rest, self.kind, self.text = iter(tokens), None, ""
        self.next()

    def next(self):
        self.kind, self.text = next(self.rest, ("end", ""))

    def match(self, kind: str):
        """A token that does not match ends the input: so an unclosed parenthesis is closed, and (a b) is a."""
        if self.kind == kind:
            self.next()
        else:
            self.kind = "end"

    def expr(self):
        return self.chain("or", lambda: self.chain("and", self.unary))

    def chain(self, op, part):
        a = part()
        while self.kind == op:
            self.match(op)
            b = part()
            a = None if a is None or b is None else (op, a, b)
        return a

    def unary(self):
        if self.kind == "not":
            self.match("not")
            a = self.unary()
            return None if a is None else ("not", a)
        if self.kind == "(":
            self.match("(")
            a = self.expr()
            self.match(")")
            return a
        if self.kind == "term":
            t = self.text
            self.match("term")
            return ("term", t)
        return None


def parse_boolean(query: str, version: int = 2):
    """(expression or None, warning or None). Words left over at the end make the whole result empty."""
    p = _Parser(_tokens_v2(query) if version == 2 else _tokens_v1(query))
    if p.kind == "end":
        return None, "empty expression"
    tree = p.expr()
    if p.kind != "end":
        return None, f"unexpected {p.text!r}"
    return tree, None if tree else "incomplete expression"


def terms_of(tree) -> list[str]:
    if tree is None:
        return []
    if tree[0] == "term":
        return [tree[1]]
    return list(dict.fromkeys(t for part in tree[1:] for t in terms_of(part)))


def holds(tree, has) -> bool:
    """The expression's value where has(term) tells a document's terms."""
    if tree[0] == "term":
        return has(tree[1])
    if tree[0] == "not":
        return not holds(tree[1], has)
    both = holds(tree[1], has), holds(tree[2], has)
    return all(both) if tree[0] == "and" else any(both)
