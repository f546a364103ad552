"""Lovins and Porter stemmers, run on distinct terms of an Arrow batch only."""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from inkwell.functions.udf import arrow_udf, ship

#: Fixed values, Lovins (1968), appendix A, by length: endings under their condition.
_ENDINGS = """
11 B alistically izationally A arizability
10 A antialness arisations arizations entialness
9 C allically A antaneous antiality arisation arization ativeness E eableness A entations entiality entialize entiation ionalness istically itousness izability izational B ationally
8 A ableness arizable entation entially eousness ibleness icalness ionalism ionality ionalize iousness izations lessness
7 A encible ability aically alities aristic arizing ateness atingly atively ativism entally entials entiate entness fulness ibility icalism icalist icality icalize icianry ination ingness ionally isation ishness istical iteness iveness ivistic ivities izement oidally ousness B alistic ational E ariness elihood F ization G ication
6 A aceous alness ancial ancies ariser arized arizer atable atives efully encies encing ential entist eously ialist iality ialize ically icance icians icists ifully ionals ioning ionist iously istics lessly nesses oidism B acious ancing ations C enting D ionate E izable G action Z eature
5 A ivity arize acies acity aical alist ality alize arial aries arily aroid ately ative ators atory ehood eless elity ement enced ences ental ently fully ially icant ician icide icism icist icity iedly ihood inate iness ional ioned ished istic ities itous ively oidal oides otide ously B alism aging anced ances arity ation ingly C antic ented E eness ature ening F izers izing I ating idine J inism Y early BB allic CC inity
4 A able ably ates ator eful eity ence ency eous hood ials ians ible ibly ical iers iful ious ists less lily ness ogen ward wise yish aric B ancy ages ally ance ants atic ions isms ying E enly ened edly F ized izer H itic I ated K arly L ides M ines N ings Y ealy
3 A acy aic ata ate ese ful ial ian ics ied ier ily ist ity ium ive oid ous B age ant ism C ent ish E ery ely ene F ary ize L ide M ine N ing O ars P ies Q ion R one Y eal ear AA ite BB als
2 A ae ia ic is B as ly E ed es F en S on T or R yl U um V us X ar BB al
1 A a e i o W s B y
"""
#: The conditions' least lengths and endings, and the recodings after them.
_LEN = {"B": 3, "C": 4, "D": 5, "F": 3, "G": 3, "K": 3, "Q": 3, "BB": 3}
_RULES = {
    "E": "(?<!e)$", "F": "(?<!e)$", "G": "f$", "H": "(t|ll)$", "I": "(?<![oe])$", "J": "(?<![ae])$", "K": "(l|i|u.e)$", "L": "(?<![uxs])$|os$",
    "M": "(?<![acem])$", "O": "[li]$", "P": "(?<!c)$", "Q": "(?<![ln])$", "R": "[nr]$", "S": "(dr|(?<!t)t)$", "T": "(s|(?<!o)t)$", "U": "[lmnr]$", "V": "c$",
    "W": "(?<![su])$", "X": "(l|i|u.e)$", "Y": "in$", "Z": "(?<!f)$", "AA": "(d|f|ph|th|l|er|or|es|t)$", "CC": "l$",
}
_RULES = {k: re.compile(v) for k, v in _RULES.items()}
_RECODE = [
    (r"iev$", "ief"), (r"uct$", "uc"), (r"umpt$", "um"), (r"rpt$", "rb"), (r"urs$", "ur"), (r"istr$", "ister"), (r"metr$", "meter"), (r"olv$", "olut"), (r"(?<![aoi])ul$", "l"),
    (r"bex$", "bic"), (r"dex$", "dic"), (r"pex$", "pic"), (r"tex$", "tic"), (r"ax$", "ac"), (r"ex$", "ec"), (r"ix$", "ic"), (r"lux$", "luc"), (r"uad$", "uas"), (r"vad$", "vas"), (r"cid$", "cis"), (r"lid$", "lis"),
    (r"erid$", "eris"), (r"pand$", "pans"), (r"end$", "ens"), (r"ond$", "ons"), (r"lud$", "lus"), (r"rud$", "rus"), (r"(?<![pt])her$", "hes"), (r"mit$", "mis"), (r"ert$", "ers"),
    (r"(?<!n)et$", "es"), (r"yt$", "ys"), (r"yz$", "ys"),
]
_RECODE = [(re.compile(a), b) for a, b in _RECODE]


def _table() -> dict[str, str]:
    out, condition = {}, "A"
    for line in _ENDINGS.split("\n"):
        for word in line.split()[1:]:
            if word.isupper():
                condition = word
            else:
                out[word] = condition
    return out


LOVINS = _table()


def _may_follow(stem: str, condition: str) -> bool:
    n = len(stem)
    if n < max(2, _LEN.get(condition, 2)):
        return False
    if condition == "N":
        return n >= 4 if n >= 3 and stem[-3] == "s" else n >= 3
    if condition == "BB":
        return stem != "met" and not stem.endswith("ryst")
    rule = _RULES.get(condition)
    return rule is None or bool(rule.search(stem))


def lovins(word: str) -> str:
    """The longest ending whose condition holds goes; then a doubled consonant is made single and the stem recoded."""
    if len(word) <= 2:
        return word
    stem = word
    for k in range(min(11, len(word) - 2), 0, -1):
        condition = LOVINS.get(word[-k:])
        if condition and _may_follow(word[:-k], condition):
            stem = word[:-k]
            break
    if len(stem) >= 2 and stem[-1] == stem[-2] and stem[-1] in "bdglmnprst":
        stem = stem[:-1]
    for rule, to in _RECODE:
        if rule.search(stem):
            return rule.sub(to, stem)
    return stem


_CONS = re.compile(r"^y|(?<=[aeiou])y|[^aeiouy]")


def _form(stem: str) -> str:
    out = ""
    for i, c in enumerate(stem):
        out += "v" if c in "aeiou" or (c == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _form(stem)))


def _short(stem: str) -> bool:
    return _form(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


_STEP2 = [p.split("-") for p in "ational-ate tional-tion enci-ence anci-ance izer-ize bli-ble alli-al entli-ent eli-e ousli-ous ization-ize ation-ate ator-ate alism-al iveness-ive fulness-ful ousness-ous aliti-al iviti-ive biliti-ble logi-log".split()]
_STEP3 = [p.split("-") for p in "icate-ic ative- alize-al iciti-ic ical-ic ful- ness-".split()]
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _first(word: str, pairs: list[list[str]]) -> str:
    for end, to in sorted(pairs, key=lambda p: -len(p[0])):
        if word.endswith(end):
            stem = word[: -len(end)]
            return stem + to if _measure(stem) > 0 else word
    return word


def porter(word: str) -> str:
    """Porter (1980), with the later bli and logi rules."""
    w = word
    if len(w) <= 2:
        return w
    for end, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: -len(end)] + to
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _form(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _form(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _form(w[:-1]):
        w = w[:-1] + "i"
    w = _first(_first(w, _STEP2), _STEP3)
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e") and ((m := _measure(w[:-1])) > 1 or (m == 1 and not _short(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


STEMMERS = {"lovins": lovins, "porter": porter}


def _udf(name: str):
    def run(words: pd.Series) -> pd.Series:
        return words.map(STEMMERS[name])

    return arrow_udf(run, StringType())


def stemmed(words: Column, stemmer: str) -> Column:
    """Lists of words to lists of their stems; a batch's distinct words are stemmed once."""
    one = STEMMERS[stemmer]

    def run(lists: pa.Array) -> pa.Array:
        flat = lists.flatten().dictionary_encode()
        stems = pa.array([one(w) for w in flat.dictionary.to_pylist()], pa.string()).take(flat.indices)
        ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(lists), 0))
        return pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends.cast(pa.int32())]), stems, mask=lists.is_null())

    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship(spark)
    return F.arrow_udf(run, ArrayType(StringType()))(words)


def stem_terms(terms: DataFrame, stemmer: str) -> DataFrame:
    """(term, stem) of distinct terms."""
    return terms.select("term", _udf(stemmer)("term").alias("stem"))
