"""Names as people write them: parts, folded letters, and a true edit metric."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

#: Cyrillic letters in Latin. Fixed values.
CYRILLIC = str.maketrans(
    {
        "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "zh", "з": "z", "и": "i", "й": "j", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o",
        "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
        "і": "i", "ї": "i", "є": "e", "ґ": "g",
    }
)
_LATIN = str.maketrans({"ß": "ss", "ø": "o", "œ": "oe", "æ": "ae", "đ": "d", "ł": "l", "þ": "th", "ı": "i"})
_LETTERS = CYRILLIC | _LATIN

#: Titles and particles, which tell persons apart no better than their absence. Fixed values.
TITLES = frozenset("mr mrs ms miss mme mlle dr prof herr frau hr fr sr sra srta don doña el sir".split())
PARTICLES = frozenset("de von van der den del della di da la le af zu".split())

#: Legal forms as words. Fixed values.
LEGAL = frozenset(
    "ag aktiengesellschaft gmbh gesellschaft mbh inc incorporated llc limited liability company ltd bv besloten vennootschap sa societe anonyme ooo the co corp corporation plc nv kg oy ab".split()
)

def fold(text: str) -> str:
    """Lower case in Latin letters without accents; letters that scripts write differently become one."""
    s = text.lower()
    if s.isascii():
        return s
    s = s.translate(_LETTERS)
    if not s.isascii():
        s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return s


_EQUAL = ((re.compile(r"kh"), "h"), (re.compile(r"ch"), "7"), (re.compile(r"qu|kv"), "kv"), (re.compile(r"[cq]"), "k"), (re.compile(r"w"), "v"), (re.compile(r"x"), "ks"), (re.compile(r"[jy]"), "i"), (re.compile(r"([aou])e"), r"\1"))


@lru_cache(maxsize=200_000)
def skeleton(word: str) -> str:
    """A folded word with letters that transliteration confuses made equal."""
    for pattern, to in _EQUAL:
        word = pattern.sub(to, word)
    return word


def distance(a: str, b: str, limit: int = 99) -> int:
    """Damerau-Levenshtein distance, a metric: neighbouring letters may be exchanged and edited further. Above ``limit``: more than it."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    if abs(n - m) > limit:
        return limit + 1
    big = n + m
    d = [[big] * (m + 2) for _ in range(n + 2)]
    for i in range(n + 1):
        d[i + 1][1] = i
    for j in range(m + 1):
        d[1][j + 1] = j
    last: dict[str, int] = {}
    for i in range(1, n + 1):
        db = 0
        least = big
        for j in range(1, m + 1):
            k, l = last.get(b[j - 1], 0), db
            if a[i - 1] == b[j - 1]:
                cost, db = 0, j
            else:
                cost = 1
            x = min(d[i][j] + cost, d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][l] + (i - k - 1) + 1 + (j - l - 1))
            d[i + 1][j + 1] = x
            least = min(least, x)
        last[a[i - 1]] = i
        if least > limit + 1:
            return limit + 1
    return d[n + 1][m + 1]


def _without_one(word: str) -> set[str]:
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


class Vocabulary:
    """Words with what each stands for, found exactly or with one typing slip."""

    def __init__(self, words: dict[str, str], weight: dict[str, int]) -> None:
        self.words, self.weight = words, weight
        self._met: dict[str, list[str]] | None = None

    def __getstate__(self) -> tuple:
        return self.words, self.weight

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def near(self, word: str, least: int) -> str | None:
        """What a word of at least ``least`` letters stands for that is one edit from a known one: of several, the commonest."""
        if len(word) < least:
            return None
        if self._met is None:
            self._met = {}
            for w in self.words:
                for h in {w, *_without_one(w)}:
                    self._met.setdefault(h, []).append(w)
        met = {w for h in {word, *_without_one(word)} for w in self._met.get(h, ()) if distance(w, word, 1) == 1}
        return self.words[min(met, key=lambda w: (-self.weight.get(w, 0), w))] if met else None


def shortens(short: str, word: str) -> bool:
    """Whether a word is written short: its first letters, or some of its letters in order with the same first and last, or the
    same first three."""
    if not 2 <= len(short) < len(word) or short[0] != word[0]:
        return False
    if len(short) >= 3 and word.startswith(short):
        return True
    if short[-1] != word[-1] and short[:3] != word[:3]:
        return False
    rest = iter(word)
    return all(c in rest for c in short)


def resembles(pet: str, full: str) -> bool:
    """Whether a word may be a pet form of a longer one, which has its first three letters somewhere."""
    return 3 <= len(pet) <= len(full) - 2 and pet[:3] in full


@dataclass(frozen=True)
class Name:
    """A parsed name: its key word (family name or a company's own word), and what else tells it apart.

    rest: a person's given name, or a company's other words in order; initial: a person's only initial.
    """

    kind: str
    key: str
    rest: str
    initial: str


_SPLIT = re.compile(r"[\s,.;:\"«»“”()\-‐–/]+")
_CAMEL = re.compile(r"(?<=[a-zà-ÿа-я])(?=[A-ZÀ-ÞА-Я])")
_DOTTED = re.compile(r"(?<![^\W_])((?:[^\W\d_]\.){2,}[^\W\d_]?\.?)")
_SLASHED = re.compile(r"\b([^\W\d_])/([^\W\d_])\b")
_LEGAL_SLIPS = Vocabulary(dict.fromkeys(LEGAL, "legal"), {})


def _longest(words: list[str]) -> str:
    """The longest word, of equally long ones the last in the alphabet, so that the order of the words does not matter."""
    return max(words, key=lambda w: (len(w), w))


@lru_cache(maxsize=100_000)
def person_words(name: str) -> tuple[list[str], list[str], list[str]]:
    """(long words, those of them before a comma, initials) of a person's name, folded, without titles and particles."""
    text = _CAMEL.sub(" ", unicodedata.normalize("NFC", name.strip()))
    if not re.search(r"[^\W\d_]", text):
        return [], [], []
    before = fold(text.split(",")[0]) if "," in text else ""
    words = [w.replace("'", "").replace("’", "") for w in _SPLIT.split(fold(text)) if w]
    words = [w for w in words if w not in TITLES and w not in PARTICLES and any(c.isalpha() for c in w)] or words
    longer = [w for w in words if len(w) > 1]
    return longer, [w for w in longer if w in before] if before else [], [w for w in words if len(w) == 1]


def company_words(name: str) -> list[str]:
    """The words of a company's name, folded, without its legal form, quotation marks, article and branch, in order."""
    text = unicodedata.normalize("NFC", name.strip())
    text = fold(re.sub(r"\([^)]*\)", " ", text))
    text = _SLASHED.sub(r" \1\2 ", text)
    text = _DOTTED.sub(lambda m: m[1].replace(".", "") + " ", text)
    text = text.replace("g.m.b.h", "gmbh").replace("'", "")
    words = [w for w in _SPLIT.split(text) if w and any(c.isalpha() for c in w)]
    return [w for w in words if w not in LEGAL] or words


class Lexicon:
    """What ``lexicon.learn`` found in a collection: its given names, with one form for all their variants, and the words that
    many companies have in their names. Empty, names are told apart by their words alone."""

    def __init__(self, given: dict[str, str] | None = None, weight: dict[str, int] | None = None, generic: dict[str, int] | None = None) -> None:
        self.given = Vocabulary(given or {}, weight or {})
        generic = generic or {}
        # a generic word that shortens a commoner one stands for it
        longer = {w: [t for t in generic if generic[t] > generic[w] and shortens(w, t)] for w in generic}
        self.generic = Vocabulary({w: min(ts, key=lambda t: (-generic[t], t)) if ts else w for w, ts in longer.items()}, generic)
        self._reset()

    def _reset(self) -> None:
        # of each form that stands for a given name: how common its variants are together, and how many they are
        self.mass: dict[str, tuple[int, int]] = {}
        for w, form in self.given.words.items():
            mass, n = self.mass.get(form, (0, 0))
            self.mass[form] = (mass + self.given.weight.get(w, 1), n + 1)
        self.heard = Vocabulary({skeleton(w): self.generic.words[w] for w in sorted(self.generic.words, key=lambda w: (self.generic.weight[w], w))}, {})
        self._names: dict[tuple[str, str], Name | None] = {}
        self._trades: dict[str, str | None] = {}

    def __getstate__(self) -> tuple:
        return self.given, self.generic

    def __setstate__(self, state: tuple) -> None:
        self.given, self.generic = state
        self._reset()

    def given_name(self, word: str) -> tuple[str, int] | None:
        """(the form that stands for a given name, certainty): 2 for a known one, 1 with one typing slip."""
        s = skeleton(word)
        if s in self.given.words:
            return self.given.words[s], 2
        found = self.given.near(s, 5)
        return (found, 1) if found else None

    def person(self, name: str) -> Name | None:
        """A person's name, in either order, with titles, initials, variants, slips, odd joins and other scripts."""
        longer, before, initials = person_words(name)
        if not longer:
            return None
        known = {w: self.given_name(w) for w in longer}
        family = [w for w in longer if known[w] is None]
        named = [w for w in longer if known[w] is not None]
        if not family:
            # every word is a known given name: the family name stands first before a comma, else last
            ordered = sorted(named, key=lambda w: (known[w][1], longer.index(w) if before else -longer.index(w)))
            family, named = ordered[:1], ordered[1:]
        key = _longest([w for w in family if w in before] or family)
        if named:
            given = known[named[0]][0]
        else:
            others = [w for w in family if w != key]
            given = _longest(others) if others else ""
        return Name("P", skeleton(key), given, "" if given else (initials[0] if initials else ""))

    def trade(self, word: str) -> str | None:
        """The generic word that a word is, or is short for, or is a slip of."""
        if word not in self._trades:
            known = self.generic.words
            found = known.get(word)
            if not found and len(word) >= 2:
                short = [t for t in known if shortens(word, t)]
                found = known[min(short, key=lambda t: (-self.generic.weight[t], t))] if short else None
            found = found or self.generic.near(word, 5)
            s = skeleton(word)
            self._trades[word] = found or self.heard.words.get(s) or self.heard.near(s, 6)
        return self._trades[word]

    def company(self, name: str) -> Name | None:
        """A company's name in any order, with short forms."""
        words = company_words(name)
        own, trades = [], []
        for w in words:
            t = self.trade(w)
            if t:
                trades.append((w, t))
            elif len(w) > 1 and not (len(w) > 6 and _LEGAL_SLIPS.near(w, 7)):
                own.append(w)
        if not own:
            if not words:
                return None
            # all words are generic: the one that fewest companies have tells most
            key = min((t for _, t in trades), key=lambda t: (self.generic.weight[t], t)) if trades else _longest(words)
            return Name("C", skeleton(key), " ".join(sorted({t for _, t in trades} - {key})), "")
        key = _longest(own)
        return Name("C", skeleton(key), " ".join(sorted({*[t for _, t in trades], *[w for w in own if w != key]})), "")

    def parse(self, schema: str, name: str) -> Name | None:
        at = ("P" if schema == "Person" else "C", name)
        if at not in self._names:
            if len(self._names) > 200_000:
                self._names.clear()
            self._names[at] = self.person(name) if at[0] == "P" else self.company(name)
        return self._names[at]
