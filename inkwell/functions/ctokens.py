"""C99 source to tokens."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column

from inkwell.functions.udf import arrow_udf

KEYWORDS = frozenset(
    "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while _Bool _Complex _Imaginary".split()
)
_TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?\*/)|(?P<directive>^[ \t]*\#[^\n]*)|(?P<string>L?"(?:\\.|[^"\\\n])*")|(?P<char>L?'(?:\\.|[^'\\\n])+')
    |(?P<floating>(?:0[xX][0-9a-fA-F]*\.?[0-9a-fA-F]+[pP][+-]?\d+|\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+)[fFlL]?)
    |(?P<integer>(?:0[xX][0-9a-fA-F]+|\d+)[uUlL]*)|(?P<name>[A-Za-z_]\w*)|(?P<sign>\.\.\.|<<=|>>=|->|\+\+|--|<<|>>|[<>=!]=|&&|\|\||[-+*/%&^|]=|\#\#|[-+*/%&|^~!<>=?:;,.(){}\[\]\#])|(?P<bad>.)""",
    re.VERBOSE | re.DOTALL | re.MULTILINE,
)


#: The names of the signs. Keywords go by their own names.
SIGNS = {
    "&": "AND", "~": "TILDE", "!": "NOT", "<": "LESSTHAN", ">": "GREATERTHAN", "^": "XOR", "|": "OR", "+": "PLUS", "-": "MINUS", "/": "SLASH", "%": "PERCENT", "*": "STAR", ".": "DOT", ":": "COLON", "?": "QUERY",
    ";": "SEMI", ",": "COMMA", "(": "LPAREN", ")": "RPAREN", "{": "LBRACE", "}": "RBRACE", "[": "LBRAC", "]": "RBRAC", "=": "EQUALS", "*=": "STAR_EQUALS", "/=": "SLASH_EQUALS", "%=": "PERCENT_EQUALS", "+=": "PLUS_EQUALS",
    "-=": "MINUS_EQUALS", "<<=": "LSHIFT_EQUALS", ">>=": "RSHIFT_EQUALS", "&=": "AND_EQUALS", "^=": "XOR_EQUALS", "|=": "OR_EQUALS", "&&": "ANDAND", "||": "OROR", "==": "EQEQ", "!=": "NOTEQ", ">=": "GTEQ", "<=": "LESSEQ",
    "<<": "LSHIFT", ">>": "RSHIFT", "++": "PLUSPLUS", "--": "MINUSMINUS", "->": "ARROW", "...": "ELLIPSIS",
}
LITERALS = {"integer": "INTEGER_CONSTANT", "char": "CHARACTER_CONSTANT", "floating": "FLOATING_CONSTANT", "string": "STRING_CONSTANT"}
TOKENS = frozenset({k.strip("_").upper() for k in KEYWORDS} | set(SIGNS.values()) | set(LITERALS.values()) | {"IDENTIFIER", "TYPEDEF_NAME", "BADTOK", "EOI"})


def token_name(kind: str, text: str) -> str:
    """One of TOKENS (EOI ends a source; TYPEDEF_NAME is an identifier that a typedef has named), or DIRECTIVE."""
    if kind == "keyword":
        return text.strip("_").upper()
    return SIGNS.get(text, "BADTOK") if kind in ("sign", "bad") else LITERALS.get(kind, kind.upper())


def named_tokens(source: str) -> list[tuple[int, str, str, str]]:
    """(pos, kind, token, text), with EOI at the end. The last name of a typedef is a type from there on; so is, in a
    typedef of a function pointer, the name after (*."""
    out, types, open_, depth, last = [], set(), False, 0, None
    for pos, kind, text in tokens(source):
        token = token_name(kind, text)
        if token == "IDENTIFIER" and text in types:
            token = "TYPEDEF_NAME"
        if token == "TYPEDEF":
            open_, depth, last = True, 0, None
        elif open_ and text in "({[":
            if text == "(" and last and last[1] == depth == 0 and out[-1][3] == last[0] and out[-1][2] == "IDENTIFIER":
                types.add(last[0])  # typedef int f(int)
                last = None
            depth += 1
        elif open_ and text in ")}]":
            depth -= 1
        elif open_ and token == "IDENTIFIER" and (depth == 0 or (out and out[-1][2] == "STAR" and len(out) > 1 and out[-2][3] == "(")):
            last = (text, depth) if depth == 0 else (text, 0)
        elif open_ and depth == 0 and token in ("SEMI", "COMMA"):
            types |= {last[0]} if last else set()
            open_, last = token == "COMMA", None
        out.append((pos, kind, token, text))
    return [*out, (len(out), "end", "EOI", "")]


def tokens(source: str) -> list[tuple[int, str, str]]:
    """(pos, kind, text): keyword, identifier, integer, floating, char, string, sign, directive or bad."""
    out = []
    for m in _TOKEN.finditer(source):
        kind = m.lastgroup
        if kind != "space":
            kind = ("keyword" if m[0] in KEYWORDS else "identifier") if kind == "name" else kind
            out.append((len(out), kind, m[0].strip()))
    return out


def _run(sources: pd.Series) -> pd.Series:
    return sources.map(lambda s: None if s is None else [{"pos": p, "kind": k, "token": n, "text": t} for p, k, n, t in named_tokens(s)])


def c_tokens(source: Column) -> Column:
    """An array of (pos, kind, token, text) to explode."""
    return arrow_udf(_run, "array<struct<pos:int,kind:string,token:string,text:string>>")(source)
