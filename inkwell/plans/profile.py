"""Named sets of search semantics."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Profile:
    """word: characters of a term; idf of the index and of queries by name; damping of in-document counts."""

    name: str
    word: str = "[A-Za-z0-9]"
    lower: bool = True
    index_idf: str = "maxtf"
    query_idf: str = "n"
    damping: str = "relative"
    keeps_last_word: bool = True
    compat_multidoc: bool = False


#: Default: index weights by the largest document frequency, queries by the number of documents.
SPARCK_JONES = Profile("sparck_jones")
#: Logarithm of a whole-number quotient, counts damped by logarithm.
MG_INT = Profile("mg_int", index_idf="n_int", query_idf="n_int", damping="log")
MG = Profile("mg", index_idf="n", query_idf="n", damping="log")
TF_ONLY = Profile("tf_only", index_idf="one", query_idf="one", damping="log")
PROFILES = {p.name: p for p in (SPARCK_JONES, MG_INT, MG, TF_ONLY)}

RESERVED = ("and", "or", "not")
MAX_TERMS, MAX_TERM = 50, 253
