"""Similarity of strings: native expressions, and vectorised functions where none exists."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Letters and the plain letters they are compared as, one for one. Fixed values.
LETTERS = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿšžčćđłßабвгдежзийклмнопрстуфхцчшщъыьэюяё"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyyszccdlsabvgdejziiklmnoprstufhccssqyqeuae"


def clean(value: Column) -> Column:
    """Lower case, plain letters and digits only, single spaces."""
    plain = F.translate(F.regexp_replace(F.lower(value), r"\p{M}+", ""), LETTERS, PLAIN)
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))


def light(value: Column) -> Column:
    """Lower case and single spaces."""
    return F.trim(F.regexp_replace(F.lower(value), r"\s+", " "))


def strict_id(value: Column) -> Column:
    """Letters and digits of an identifier, in capitals."""
    return F.regexp_replace(F.upper(value), "[^A-Z0-9]", "")


def nonempty(values: Column) -> Column:
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (F.length(v) > 0)))


def clean_set(values: Column) -> Column:
    return nonempty(F.transform(values, clean))


def words(values: Column, least: int = 1) -> Column:
    """The set of words of some values."""
    return F.array_distinct(F.filter(F.flatten(F.transform(values, lambda v: F.split(clean(v), " "))), lambda w: F.length(w) >= least))


def numbers(values: Column) -> Column:
    """The set of runs of digits."""
    return F.array_distinct(F.flatten(F.transform(values, lambda v: F.regexp_extract_all(v, F.lit(r"(\d+)")))))


def levenshtein_ratio(left: Column, right: Column) -> Column:
    return 1.0 - F.levenshtein(left, right) / F.greatest(F.lit(1), F.length(left), F.length(right))


def strict_levenshtein(left: Column, right: Column, rate: int = 4) -> Column:
    """1 if equal; 0 if the strings differ by more than a ``rate``-th of the longer; else the ratio to the power of the edits
    allowed."""
    longer = F.greatest(F.length(left), F.length(right))
    allowed = F.floor(longer / rate)
    edits = F.levenshtein(left, right)
    return F.when(left == right, 1.0).when((allowed < 1) | (edits > allowed), 0.0).otherwise(F.pow(1.0 - edits / longer, allowed))


def clipped_levenshtein(left: Column, right: Column) -> Column:
    """The squared ratio where at most two edits, and at most a quarter of the longer, are needed."""
    longer = F.greatest(F.length(left), F.length(right))
    edits = F.levenshtein(left, right)
    ratio = F.when(left == right, 1.0).when(edits > F.least(F.lit(2), F.floor(longer / 4)), 0.0).otherwise(1.0 - edits / F.greatest(F.lit(1), longer))
    return ratio * ratio


def best_pair(left: Column, right: Column, score) -> Column:  # noqa: ANN001
    """The greatest score of a value of the left with one of the right; 0 if a side is empty."""
    rows = F.flatten(F.transform(left, lambda x: F.transform(right, lambda y: score(x, y))))
    return F.coalesce(F.array_max(rows), F.lit(0.0))


def overlaps(left: Column, right: Column) -> Column:
    return F.coalesce(F.arrays_overlap(left, right), F.lit(False))


def disjoint(left: Column, right: Column) -> Column:
    return (F.size(left) > 0) & (F.size(right) > 0) & ~overlaps(left, right)


def share(left: Column, right: Column, least: float) -> Column:
    """Common values over the smaller set, or over ``least`` if that is more."""
    smaller = F.least(F.size(left), F.size(right)).cast("double")
    return F.size(F.array_intersect(left, right)) / F.greatest(F.lit(least), smaller)


def soundex_word(word: Column) -> Column:
    """The sound code of a word of Latin letters, else the word in capitals."""
    return F.when(word.rlike("^[A-Za-z]{2,}$"), F.soundex(word)).otherwise(F.upper(word))


@lru_cache(maxsize=100_000)
def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0 if a else 0.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    taken = [False] * len(b)
    first: list[str] = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                first.append(c)
                break
    if not first:
        return 0.0
    second = [b[j] for j in range(len(b)) if taken[j]]
    moved = sum(x != y for x, y in zip(first, second, strict=True)) // 2
    m = len(first)
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro_winkler(a: str, b: str, threshold: float = 0.7) -> float:
    """Jaro with a bonus of a tenth per common first letter, up to four, from the threshold on."""
    base = jaro(a, b)
    if base < threshold:
        return base
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return base + prefix * 0.1 * (1 - base)


_VOWELS = frozenset("aeiou")


@lru_cache(maxsize=100_000)
def metaphone(word: str) -> str:
    """The sound code of a word by the rules of Philips (1990): consonants as heard in English, vowels only at the start; 0 is th.

    Letters other than a to z are left out.
    """
    w = re.sub("[^a-z]", "", word.lower())
    w = re.sub(r"([abd-z])\1+", r"\1", w)
    if w[:2] in ("kn", "gn", "pn", "ae", "wr"):
        w = w[1:]
    elif w[:1] == "x":
        w = "s" + w[1:]
    elif w[:2] == "wh":
        w = "w" + w[2:]
    out = []
    for i, c in enumerate(w):
        before, after, then = w[i - 1] if i else "", w[i + 1 : i + 2], w[i + 1 : i + 3]
        soft = after in ("e", "i", "y") and after != ""
        if c in _VOWELS:
            code = c if i == 0 else ""
        elif c == "b":
            code = "" if before == "m" and not after else "b"
        elif c == "c":
            if then == "ia" or after == "h":
                code = "k" if before == "s" and after == "h" else "x"
            else:
                code = ("" if before == "s" else "s") if soft else "k"
        elif c == "d":
            code = "j" if then in ("ge", "gy", "gi") else "t"
        elif c == "g":
            if after == "h":
                code = "k" if w[i + 2 : i + 3] in _VOWELS and len(w) > i + 2 else ""
            elif after == "n" and w[i:] in ("gn", "gned"):
                code = ""
            elif before == "d" and soft:
                code = ""
            else:
                code = "j" if soft and before != "g" else "k"
        elif c == "h":
            code = "" if before in ("c", "s", "p", "t", "g") and before or (before in _VOWELS and after not in _VOWELS) or not after and before in _VOWELS else "h"
        elif c == "k":
            code = "" if before == "c" else "k"
        elif c == "p":
            code = "f" if after == "h" else "p"
        elif c == "s":
            code = "x" if after == "h" or then in ("io", "ia") else "s"
        elif c == "t":
            code = "x" if then in ("ia", "io") else "0" if after == "h" else "" if then == "ch" else "t"
        elif c in ("w", "y"):
            code = c if after in _VOWELS and after else ""
        else:
            code = {"q": "k", "v": "f", "x": "ks", "z": "s"}.get(c, c)
        out.append(code)
    return "".join(out).upper()


def _pairs(function):  # noqa: ANN001, ANN202
    @F.pandas_udf(T.DoubleType())
    def score(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([function([x for x in a if x] if a is not None else [], [y for y in b if y] if b is not None else []) for a, b in zip(left, right, strict=True)], dtype="float64")

    return score


def _parts_score(left: list[str], right: list[str]) -> float:
    """Mean over the words on the left of the best similarity above a half."""
    if not left:
        return 0.0
    return sum(max([s for s in (jaro_winkler(p, o) for o in right) if s > 0.5], default=0.0) for p in left) / len(left)


def _whole_score(left: list[str], right: list[str]) -> float:
    """The best of whole strings and of words over all pairs of names, as sanction searches score."""
    best = 0.0
    for x in left:
        for y in right:
            a, b = x.upper().split(), y.upper().split()
            if not a or not b:
                continue
            s, t = " ".join(a), " ".join(b)
            whole = 0.0
            if s[0] == t[0] and jaro(s, t) > 0:
                whole = jaro_winkler(s, t, 0.0)
            kept = [w for w in a if len(w) > 2] or a
            scores = [max(jaro_winkler(w, o) for o in b) for w in kept]
            words_ = sum(v if v >= 0.5 else 0.0 for v in scores) / len(scores)
            best = max(best, whole, words_)
    return best


def _plausible(a: str, b: str) -> bool:
    """Whether two words may be spellings of one: edits of at most a fourth of the shorter, never more than four."""
    allowed = min(4, min(len(a), len(b)) // 4)
    if abs(len(a) - len(b)) > allowed:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1] <= allowed


def _aligned(left: list[str], right: list[str]) -> float:
    """Greedy alignment of words: the product of their similarities, if every word on the left finds one."""
    scored = sorted(((jaro_winkler(p, o), p, o) for p in set(left) for o in set(right) if _plausible(p, o)), reverse=True)
    a, b, total, n = list(left), list(right), 1.0, 0
    for s, p, o in scored:
        while p in a and o in b:
            a.remove(p)
            b.remove(o)
            total *= s
            n += 1
    return total if n == len(left) and n else 0.0


def _person_score(left: list[str], right: list[str]) -> float:
    best = 0.0
    for x in left:
        for y in right:
            a, b = x.split(), y.split()
            s, t = "".join(a), "".join(b)
            if s and t and _plausible(s, t):
                best = max(best, jaro_winkler(s, t) ** len(s))
            best = max(best, _aligned(a, b))
    return best


def _codes(words_: list[str]) -> list[str]:
    return [c if len(c := metaphone(w)) >= 3 else w.upper() for w in words_]


def _metaphone_score(left: list[str], right: list[str]) -> float:
    """Common sound codes, as often as both sides have them, over the words on the left, or two."""
    best = 0.0
    for x in left:
        for y in right:
            a, b = _codes(x.split()), _codes(y.split())
            common, rest = 0, list(b)
            for c in a:
                if c in rest:
                    rest.remove(c)
                    common += 1
            best = max(best, common / max(2.0, len(a)))
    return best


def _phonetic_score(left: list[str], right: list[str]) -> float:
    """Share of words on the left with a word on the right that sounds the same and is spelled plausibly."""
    best = 0.0
    for x in left:
        for y in right:
            a, rest = x.split(), y.split()
            found = 0
            for w in a:
                code = metaphone(w)
                match = next((o for o in rest if o == w or (len(code) >= 3 and metaphone(o) == code and _plausible(w, o))), None)
                if match is not None:
                    rest.remove(match)
                    found += 1
            if a:
                best = max(best, found / len(a))
    return best


#: Classes of legal forms; words of one class stand for each other. Fixed values.
ORG_CLASSES = {
    "ltd": "llc", "limited": "llc", "llc": "llc", "gmbh": "llc", "bv": "llc", "ooo": "llc", "sarl": "llc", "inc": "corp", "incorporated": "corp", "corp": "corp", "corporation": "corp", "ag": "corp", "sa": "corp",
    "aktiengesellschaft": "corp", "company": "co", "co": "co",
}


jaro_parts = _pairs(_parts_score)
whole_or_parts = _pairs(_whole_score)
person_jaro = _pairs(_person_score)
metaphone_overlap = _pairs(_metaphone_score)
phonetic_share = _pairs(_phonetic_score)
