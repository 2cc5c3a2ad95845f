"""Names compared part by part: symbols, tags, pruned pairs of names, alignment and weights.

A name is cut into parts. A part may carry a symbol, by which differently written parts mean the same (legal forms, numbers, reach,
trades, places, nicknames, initials), and a tag, the role that the entity's own properties give it. Pairs of names are pruned by
script, then aligned: parts with a common symbol first, then parts spelled alike, and every part without partner counts against
the pair. The score is the weighted mean.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotwork.functions.similarity import LETTERS, ORG_CLASSES, PLAIN

_PLAIN = str.maketrans(LETTERS, PLAIN)

#: Words by category and the symbol they stand for. Fixed values.
NUMBERS = {w: str(n) for n, ws in enumerate(("one i first", "two ii second", "three iii third", "four iv fourth", "five v fifth", "six vi sixth", "seven vii seventh", "eight viii eighth", "nine ix ninth", "ten x tenth"), 1) for w in ws.split()}
REACH = {"international": "intl", "intl": "intl", "global": "global", "worldwide": "global", "group": "group", "grp": "group", "holding": "holding", "holdings": "holding", "hldg": "holding"}
TRADES = {"trading": "trade", "trade": "trade", "trdg": "trade", "shipping": "ship", "shpg": "ship", "medical": "med", "insurance": "ins", "bank": "bank", "banking": "bank", "engineering": "eng", "engrg": "eng", "chemicals": "chem", "chemical": "chem", "energy": "energy"}
PLACES = {"north": "n", "northern": "n", "south": "s", "southern": "s", "east": "e", "eastern": "e", "west": "w", "western": "w", "russia": "ru", "russian": "ru", "germany": "de", "german": "de", "france": "fr", "french": "fr", "china": "cn", "usa": "us", "america": "us"}
NICKS = {n: full for full, ns in {"william": "bill will", "robert": "bob rob", "elizabeth": "liz beth", "richard": "dick rick", "james": "jim", "john": "jack", "alexander": "alex sasha", "michael": "mike", "margaret": "peggy maggie", "catherine": "kate", "edward": "ted ned", "thomas": "tom"}.items() for n in [full, *ns.split()]}
STOPWORDS = frozenset("the of and for de la le der die das und et".split())
#: Weight of a matched symbol, of an unmatched one, and the score of a match by symbol. Fixed values.
MATCHED_WEIGHT = {"org": 0.7, "initial": 0.5, "nick": 0.8, "reach": 0.3, "trade": 0.7, "number": 1.3, "place": 0.8}
EXTRA_WEIGHT = {"org": 0.7, "reach": 0.7, "number": 1.3, "place": 0.8}
SYMBOL_SCORE = {"org": 0.8, "initial": 0.9, "nick": 0.6, "reach": 0.9, "trade": 0.9, "number": 0.9, "place": 0.9}


@dataclass(frozen=True)
class NameConfig:
    """Settings of name matching.

    number_mismatch: penalty for numbers that differ; extra_query and extra_result: weight of parts of either side without partner;
    family: factor for family names of persons; cutoff: factor of the edits that a fuzzy match may have.
    """

    number_mismatch: float = 0.3
    extra_query: float = 0.8
    extra_result: float = 0.2
    family: float = 1.3
    cutoff: float = 1.0


@dataclass(frozen=True)
class Part:
    """A part of a name: its plain letters, its symbols by category, and its tag (given, family or none)."""

    form: str
    symbols: frozenset[tuple[str, str]]
    tag: str = ""


@lru_cache(maxsize=200_000)
def plain(text: str) -> str:
    text = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c)).translate(_PLAIN)
    return "".join(c if c.isalnum() else "" if c in "'’" else " " for c in text)


def _symbols(word: str, person: bool) -> frozenset[tuple[str, str]]:
    found = set()
    if person:
        if len(word) == 1 and word.isalpha():
            found.add(("initial", word))
        if word in NICKS:
            found.add(("nick", NICKS[word]))
    else:
        for category, words in (("org", ORG_CLASSES), ("reach", REACH), ("trade", TRADES), ("place", PLACES), ("number", NUMBERS)):
            if word in words:
                found.add((category, words[word]))
    if word.isdigit():
        found.add(("number", word.lstrip("0") or "0"))
    return frozenset(found)


def parts(name: str, person: bool, given: frozenset[str] = frozenset(), family: frozenset[str] = frozenset()) -> tuple[Part, ...]:
    """The parts of a name. given and family: words that the entity's own properties tag; before a comma stands a family name."""
    before = frozenset(plain(name.split(",", 1)[0]).split()) if person and "," in name else frozenset()
    words = plain(name).split()
    tag = lambda w: "family" if w in family or (w in before and w not in given) else "given" if w in given else ""
    return tuple(Part(w, _symbols(w, person), tag(w) if person else "") for w in words)


def compatible_tags(a: Part, b: Part) -> bool:
    """A given name is not compared with a family name; a part without tag may be either."""
    return not a.tag or not b.tag or a.tag == b.tag


def is_family(part: Part) -> bool:
    return part.tag == "family"


def script_of(name: str) -> str:
    """The script that most letters of a name have, by the first word of their Unicode names."""
    count: dict[str, int] = {}
    for c in name:
        if c.isalpha():
            key = "latin" if c.isascii() else unicodedata.name(c, "none").split(" ")[0].lower()
            count[key] = count.get(key, 0) + 1
    return max(sorted(count), key=count.get) if count else "none"


def consolidate(names: list[str]) -> list[str]:
    """Names without those whose words a longer name of the same script has all: they tell nothing more."""
    kept: list[tuple[frozenset[str], str, str]] = []
    for name in sorted({n for n in names if n and plain(n).split()}, key=lambda n: (-len(plain(n).split()), n)):
        words, script = frozenset(plain(name).split()), script_of(name)
        if len(words) > 1 and any(words < other and script == its for other, its, _ in kept):
            continue
        if not any(words == other and plain(name) == plain(n) for other, _, n in kept):
            kept.append((words, script, name))
    return [n for _, _, n in kept]


def name_pairs(left: list[str], right: list[str], most: int = 6) -> list[tuple[str, str]]:
    """Pairs worth comparing: all if there are few, else those of one script, and one across scripts only if no pair of one
    script has at least the words and symbols in common that it has."""
    every = [(a, b) for a in left for b in right]
    if len(every) <= most:
        return every
    common = {p: frozenset(plain(p[0]).split()) & frozenset(plain(p[1]).split()) for p in every}
    own = [p for p in every if script_of(p[0]) == script_of(p[1])]
    across = [p for p in every if script_of(p[0]) != script_of(p[1])]
    best: list[tuple[str, str]] = []
    for p in across:
        if not any(common[p] <= common[q] for q in own) and not any(common[p] < common[q] for q in across):
            best.append(p)
    return own + best


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def pair_score(a: Part, b: Part, cutoff: float = 1.0) -> tuple[float, float]:
    """(score, weight) of two parts: by a symbol they share, or by their spelling."""
    if not compatible_tags(a, b):
        return 0.0, 1.0
    shared = {c for c, _ in a.symbols & b.symbols}
    for x, y in ((a, b), (b, a)):
        if any(c == "initial" for c, _ in x.symbols) and len(y.form) > 1 and y.form[0] == x.form:
            shared.add("initial")
    weight = min((MATCHED_WEIGHT.get(c, 1.0) for c in shared), default=1.0)
    if a.form == b.form:
        return 1.0, weight
    by_symbol = max((SYMBOL_SCORE.get(c, 0.9) for c in shared), default=0.0)
    if any(c == "number" for c, _ in a.symbols | b.symbols):
        return by_symbol, weight
    longer = max(len(a.form), len(b.form))
    allowed = int(longer // 4 * cutoff)
    d = edits(a.form, b.form) if abs(len(a.form) - len(b.form)) <= allowed else longer
    spelled = (1 - d / longer) ** max(1, allowed) if d <= allowed else 0.0
    return (by_symbol, weight) if by_symbol >= spelled else (spelled, 1.0)


def extra_weight(part: Part) -> float:
    """What a part without partner weighs."""
    if part.form in STOPWORDS:
        return 0.5
    out = 1.0
    for category, _ in part.symbols:
        out *= EXTRA_WEIGHT.get(category, 1.0)
    return out


def align(query: tuple[Part, ...], result: tuple[Part, ...], config: NameConfig) -> tuple[float, list[tuple[str, str, float]]]:
    """The weighted mean of aligned parts, and the alignment (part, part, score), with empty words for missing partners."""
    scored = []
    for i, a in enumerate(query):
        for j, b in enumerate(result):
            s, w = pair_score(a, b, config.cutoff)
            if s > 0:
                scored.append((-s, abs(i - j), i, j, w * (config.family if is_family(a) or is_family(b) else 1.0)))
    left, right, told = set(range(len(query))), set(range(len(result))), []
    total = weight = 0.0
    for s, _, i, j, w in sorted(scored):
        if i in left and j in right:
            left.discard(i)
            right.discard(j)
            total, weight = total - s * w, weight + w
            told.append((query[i].form, result[j].form, -s))
    for rest, side, factor in ((left, query, config.extra_query), (right, result, config.extra_result)):
        for i in sorted(rest):
            weight += factor * extra_weight(side[i]) * (config.family if is_family(side[i]) else 1.0)
            told.append((side[i].form, "", 0.0) if side is query else ("", side[i].form, 0.0))
    numbers = [{v for p in side for c, v in p.symbols if c == "number"} for side in (query, result)]
    score = total / weight if weight else 0.0
    if numbers[0] and numbers[1] and not numbers[0] & numbers[1]:
        score = max(0.0, score - config.number_mismatch)
    return score, told


def explain(told: list[tuple[str, str, float]]) -> str:
    """An alignment in words."""
    return ", ".join(f"{a}~{b}:{s:.2f}" if a and b else f"+{b}" if b else f"-{a}" for a, b, s in told)


def score_names(left: list[str], right: list[str], person: bool, tags: tuple[frozenset[str], ...], config: NameConfig) -> float:
    """The best of the pairs of names. tags: given and family words of the left and the right."""
    best = 0.0
    for a, b in name_pairs(consolidate(left), consolidate(right)):
        x, y = parts(a, person, tags[0], tags[1]), parts(b, person, tags[2], tags[3])
        same = sorted(p.form for p in x) == sorted(p.form for p in y)
        if same and [p.form for p in x] == [p.form for p in y] and all(compatible_tags(p, q) for p, q in zip(x, y, strict=True)):
            return 1.0
        best = max(best, align(x, y, config)[0])
    return best


def matcher(config: NameConfig = NameConfig()):  # noqa: ANN201, B008
    """A column function of (names, names, given, family, given, family, is a person) to the score of ``score_names``; null arrays
    are empty."""

    @F.pandas_udf(T.DoubleType())
    def score(left: pd.Series, right: pd.Series, g1: pd.Series, f1: pd.Series, g2: pd.Series, f2: pd.Series, person: pd.Series) -> pd.Series:
        known: dict[tuple, float] = {}
        words = lambda xs: frozenset(w for x in (xs if xs is not None else ()) if x for w in plain(x).split())
        out = []
        for a, b, *tagged, p in zip(left, right, g1, f1, g2, f2, person, strict=True):
            key = (tuple(x for x in a if x) if a is not None else (), tuple(x for x in b if x) if b is not None else (), *map(words, tagged), bool(p))
            if key not in known:
                known[key] = score_names(list(key[0]), list(key[1]), key[6], key[2:6], config)
            out.append(known[key])
        return pd.Series(out, dtype="float64")

    return score


def name_score(q: Column, r: Column, names, values, person: Column, config: NameConfig = NameConfig()) -> Column:  # noqa: ANN001, B008
    """The score of two entities' names. names and values: the column functions for an entity's names and for a property."""
    tagged = [values(e, p) for e in (q, r) for p in ("firstName", "lastName")]
    return matcher(config)(names(q), names(r), *tagged, person)
