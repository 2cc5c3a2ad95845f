"""Sentence units of documents in many languages and scripts.

Method: every character is boundary or inside. Only a few positions can be boundaries at all (after terminators with their
closing marks, at line ends, and at spaces where the script of the line writes no terminators), so the tag sequence runs
over those points. A linear-chain model scores each point by sparse features of the words around it and each pair of
neighbouring tags; Viterbi decoding finds the best sequence. Points inside a quotation can only be inside, points at blank
lines and around list lines only boundary; decoding is constrained to that. The weights in ``sentence_model.json`` were
trained by ``sentence_training`` with an averaged structured perceptron; for scripts that write no terminators it learns from
texts stripped of the breaks that show where their sentences end.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache
from importlib import resources

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.session import spread

TERMINATORS = ".!?…。！？｡।॥؟;;؛"
CLOSERS = "\"'”’“»›」』）)】〕]"
OPENERS = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "‹": "›"}
#: Scripts written without sentence punctuation: here a space may end a sentence.
SPACED = re.compile(r"[฀-๿຀-໿ក-៿]")

_RUN = re.compile(rf"[{re.escape(TERMINATORS)}][{re.escape(TERMINATORS + CLOSERS)}]*(?:[\s ]+[»›](?!\w))?")
_GAP = re.compile(r"\s+")
_LIST = re.compile(r"[ \t]*(?:[-–—•*▪◦‣·][ \t]+|\(?(?:\d{1,2}|[A-Za-z])\)[ \t]+)")
_WORD = re.compile(r"\S+")

#: Characters on either side that features look at, so that work is linear in texts without spaces.
REACH = 64
#: States of a point before decoding.
FREE, INSIDE, BOUNDARY = 0, 1, 2


def quotations(text: str) -> list[tuple[int, int]]:
    """Spans of quotations, from the opening mark to behind the closing one; a paragraph ends an open quotation.

    A straight mark opens if it stands before a word and not behind one, else it closes. Marks without a partner quote
    nothing.
    """
    spans: list[tuple[int, int]] = []
    opened: int | None = None
    closing = ""
    for m in re.finditer(r"[“”„«»「」『』‹›\"]|\n[ \t]*\n", text):
        mark, i = m[0], m.start()
        if mark[0] == "\n":
            opened = None
        elif opened is not None and mark in closing:
            after = text[i + 1 : i + 2]
            before = text[i - 1 : i]
            if mark == '"' and (before.isspace() or not before) and after.isalnum():
                opened = i
                continue
            spans.append((opened, i + 1))
            opened = None
        elif opened is None:
            if mark == '"':
                before, after = text[i - 1 : i] if i else "", text[i + 1 : i + 2]
                if after and not after.isspace() and (not before or before.isspace() or not before.isalnum() and before not in TERMINATORS + ","):
                    opened, closing = i, '"'
            elif mark in OPENERS:
                opened, closing = i, OPENERS[mark]
    return spans


def points(text: str) -> list[tuple[int, int, int]]:
    """(end of the left unit, start of the right one, state) of every position that may be a boundary, in order."""
    found: dict[int, tuple[int, int, int]] = {}
    n = len(text)
    quoted = quotations(text)

    def add(left: int, state: int) -> None:
        gap = _GAP.match(text, left)
        right = gap.end() if gap else left
        if left == 0 or right >= n:
            return
        old = found.get(right)
        if old is None or state == BOUNDARY:
            found[right] = (old[0] if old else left, right, state)

    for m in _RUN.finditer(text):
        after = text[m.end() : m.end() + 1]
        if not (m[0] == "." and (after.isdigit() or after.islower() or after in ",)") and after):
            add(m.end(), FREE)
    start = 0
    for m in re.finditer(r"\n\s*", text):
        left = m.start()
        while left > start and text[left - 1].isspace():
            left -= 1
        blank = m[0].count("\n") > 1
        listed = _LIST.match(text, m.end()) or _LIST.match(text, start)
        add(left, BOUNDARY if blank or listed else FREE)
        start = m.end()
    for line in re.finditer(r"[^\n]+", text):
        if SPACED.search(line[0]):
            for m in re.finditer(r"(?<=\S)[^\S\n]+(?=\S)", line[0]):
                add(line.start() + m.start(), FREE)
    out = []
    k = 0
    for right in sorted(found):
        left, _, state = found[right]
        while k < len(quoted) and quoted[k][1] <= left:
            k += 1
        if k < len(quoted) and quoted[k][0] < left and right < quoted[k][1]:
            state = INSIDE
        out.append((left, right, state))
    return out


def _kind(c: str) -> str:
    if not c:
        return "end"
    if c.isdigit():
        return "9"
    if c.isalpha():
        o = ord(c)
        if o < 0x250 or 0x1E00 <= o < 0x1F00:
            return "U" if c.isupper() else "l"
        if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
            return "Ug" if c.isupper() else "lg"
        if 0x400 <= o < 0x530:
            return "Uc" if c.isupper() else "lc"
        if 0x600 <= o < 0x780:
            return "ar"
        if 0x900 <= o < 0x980:
            return "hi"
        if 0xE00 <= o < 0xE80:
            return "th"
        if 0x3040 <= o < 0x3100:
            return "ja"
        return "han" if o >= 0x2E80 else "other"
    return c if c in "\"'«„“”»「」¿¡(§№-,.)%/&@" else "sign"


_DIGITS = re.compile(r"\d+")
_FIGURE = re.compile("[0-8]")
_MARK = re.compile(rf"[{re.escape(TERMINATORS)}][{re.escape(TERMINATORS + CLOSERS)}\s]*$")
_WHITE = re.compile(r"\s")
_UNSPACED_TAIL, _SPACED_LEAD, _UNSPACED_END = re.compile(r"[^฀-๿]*$"), re.compile(r"[฀-๿]*"), re.compile(r"[^฀-๿]+$")


def _plain(word: str) -> str:
    return _DIGITS.sub("9", word.lower())[-14:]


def features(text: str, left: int, right: int) -> list[str]:
    """Names of the features that hold at a point."""
    low = max(0, left - REACH)
    a = max(low - 1, text.rfind(" ", low, left), text.rfind("\n", low, left), text.rfind("\xa0", low, left)) + 1
    whole = text[a:left]
    mark = _MARK.search(text[max(a, left - 8) : left])
    term = _WHITE.sub("", mark[0]) if mark else ""
    body = whole[: len(whole) - len(mark[0])] if mark else whole
    body = body.lstrip("(\"'«„“「¿¡[")
    before_body = text[max(0, a - 12) : a].split()
    prior = _plain(before_body[-1]) if before_body else "^"
    gap = text[left:right]
    space = "nl" if "\n" in gap else "sp" if gap else "no"
    word = _WORD.match(text, right, right + REACH)
    nxt = word[0] if word else ""
    k = _kind(nxt[:1])
    inner = _kind(nxt[1:2]) if nxt[:1] in "(\"«„“「¿¡" else ""
    last = _kind(body[-1:])
    shape = "1" if len(body) == 1 else "dots" if "." in body else "num" if body and body[0].isdigit() and last == "9" else "w" + last
    b, w = _plain(body), _plain(nxt.strip("\"'«»„“”(),.:;"))
    out = [
        f"t={term}|{space}|{k}",
        f"s={shape}|{term}|{space}|{k}{inner}",
        f"b={b}|{term[:1]}",
        f"bk={b}|{term}|{k}",
        f"bks={b}|{term}|{k}|{space}",
        f"pb={prior}|{b}|{k}",
        f"ps={'9' if prior[-1:] == '9' or prior == '9' else 'w'}{min(len(prior), 3)}|{b}|{k}",
        f"bw={b}|{w}",
        f"w={w[:8]}|{term}|{shape}",
        f"lk={last}|{term}|{space}|{k}",
    ]
    if not term and SPACED.search(text[max(0, left - 80) : right + 80]):
        tail = _UNSPACED_TAIL.search(whole)[0]
        glued = len(tail) < len(whole)
        lead = _SPACED_LEAD.match(nxt)[0]
        stop = SPACED.search(text, right, right + 2 * REACH)
        ahead = text[right : stop.start()] if stop else text[right : right + 60]
        verb = text[stop.start() : stop.start() + 4] if stop else ""
        head = _UNSPACED_END.sub("", whole)[-5:]
        words = ahead.split()
        out += [
            f"th={lead[:5]}|{k}",
            f"tl={_plain(tail)}|{int(glued)}|{k}",
            f"tw={_plain(tail)}|{w}",
            f"tn={min(len(words), 4)}|{verb}|{int(glued)}|{_kind(tail[-1:])}",
            f"tg={head}|{int(glued)}|{_kind(tail[:1])}|{min(len(words), 3)}",
            f"tp={prior}|{_plain(tail)}|{verb}",
            f"tk={last}|{k}|{head[-3:]}",
        ]
    return out


class Model:
    """Weights of a linear chain over two tags; a weight is for boundary, its negative for inside."""

    def __init__(self, weights: dict[str, float], chain: list[list[float]]) -> None:
        self.weights, self.chain = weights, chain
        self._seen: dict[tuple, float] = {}

    def score(self, text: str, left: int, right: int) -> float:
        """The weight of a point's features. What features see of most points is a short window, in which all figures are alike:
        those scores are kept."""
        if left > 2 and text[left - 1] in CLOSERS + TERMINATORS + " " and not SPACED.search(text, max(0, left - 80), right + 80):
            low = max(0, left - REACH)
            a = max(low - 1, text.rfind(" ", low, left), text.rfind("\n", low, left), text.rfind("\xa0", low, left)) + 1
            word = _WORD.match(text, right, right + REACH)
            at = max(0, a - 12)
            window = (left - at, a - at, right - left, _FIGURE.sub("9", text[at : word.end() if word else right]))
            found = self._seen.get(window)
            if found is None:
                if len(self._seen) > 300_000:
                    self._seen.clear()
                found = self._seen[window] = self._score(text, left, right)
            return found
        return self._score(text, left, right)

    def _score(self, text: str, left: int, right: int) -> float:
        get = self.weights.get
        return sum([get(f, 0.0) for f in features(text, left, right)])

    def decode(self, text: str, at: list[tuple[int, int, int]]) -> list[bool]:
        """Viterbi: whether each point is a boundary."""
        chain, score = self.chain, self.score
        back: list[tuple[int, int]] = []
        low = -1e9
        inside, boundary = 0.0, low  # the text's start counts as inside
        for left, right, state in at:
            s = 0.0 if state else score(text, left, right)
            a, b = inside + chain[0][0], boundary + chain[1][0]
            c, d = inside + chain[0][1], boundary + chain[1][1]
            back.append((int(b > a), int(d > c)))
            inside, boundary = max(a, b) - s, max(c, d) + s
            if state == INSIDE:
                boundary = low
            elif state == BOUNDARY:
                inside = low
        tag = int(boundary > inside)
        out = [False] * len(at)
        for k in range(len(at) - 1, -1, -1):
            out[k] = bool(tag)
            tag = back[k][tag]
        return out


@cache
def model() -> Model:
    # as a resource, so that it is found in a package shipped as a zip too
    stored = json.loads(resources.files("knotwork.llm").joinpath("sentence_model.json").read_text(encoding="utf-8"))
    return Model(stored["weights"], stored["chain"])


def units(text: str, chain: Model | None = None) -> list[tuple[int, int]]:
    """Offsets of the sentence units of a text, end exclusive; every character but white space lies in exactly one."""
    at = points(text)
    ends = [p for p, is_end in zip(at, (chain or model()).decode(text, at), strict=True) if is_end]
    cuts = [0, *[p[1] for p in ends]]
    stops = [*[p[0] for p in ends], len(text)]
    out = []
    for a, z in zip(cuts, stops, strict=True):
        part = text[a:z]
        kept = part.strip()
        if kept:
            begin = a + len(part) - len(part.lstrip())
            out.append((begin, begin + len(kept)))
    return out


def sentence_units(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, begin_pos, end_pos): the sentence units of every document, as code-point offsets, whole texts.

    Null, empty and blank texts have no units; documents need no unique key; other columns are ignored. Each document is
    decoded alone, in time linear in its length, so nothing is shuffled.
    """
    kind = documents.schema[key].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [units(t) if t else [] for t in batch.column(1).to_pylist()]
            source = pa.array([k for k, found in enumerate(spans) for _ in found], pa.int64())
            begin = pa.array([a for found in spans for a, _ in found], pa.int32())
            end = pa.array([z for found in spans for _, z in found], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(source), begin, end], names=["k", "begin_pos", "end_pos"])

    rows = spread(documents.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).where("t IS NOT NULL"))
    out = rows.mapInArrow(cut, f"k {kind.simpleString()}, begin_pos int, end_pos int")
    return out.select(F.col("k").alias(key), "begin_pos", "end_pos")
