"""Training of the sentence model: ``python -m knotwork.llm.sentence_training DOCUMENTS_PARQUET[,...] OUT_JSON``.

Labels come from written rules for text whose punctuation is unambiguous once abbreviations are known. Scripts without
terminators have no such rules: there only the edges of texts and paragraphs show where sentences begin and end. What stands at
these edges is counted (``Edges``), and the model is trained on texts whose paragraph breaks were stripped, with a boundary at
each stripped break and wherever an end and a beginning that edges have shown meet. No word of any such script is listed here.
The model sees only its own features. A tenth of the documents is held out: of their stripped breaks the part that the model
finds is printed, which no rule has labelled.
"""

from __future__ import annotations

import json
import random
import re
import sys
from collections import Counter, defaultdict

from knotwork.llm.sentences import CLOSERS, FREE, INSIDE, SPACED, TERMINATORS, Model, features, points, units

#: Abbreviations that never end a sentence. Fixed values.
ABBREVIATIONS = set(
    "mr mrs ms dr prof capt rev st mt no nos nr ref vol vols p pp art arts para paras cf e.g i.e viz approx vs fig sec ch ed eds "
    "z b u bzw ca abs bd hr fr vgl str tel d h o geb usw evtl ggf "
    "m mm mme env av al ex bd sté "
    "sr sra srta dra ej pág págs núm aprox avda "
    "ст п с ул д кв см ок им рис стр г-н г-жа т тел "
    "κ κα βλ σελ αρ παρ περ "
    "د ص "
    "डॉ क्र पृ श्री".split()
)
#: Endings of company names: they end a sentence only before the start of another. Fixed values.
COMPANY = {"inc", "ltd", "co", "s.a", "b.v", "n.v", "corp", "o.o.o", "l.l.c", "g.m.b.h", "a.g", "a.m", "p.m", "u.k", "u.s"}
MONTH_STEMS = "jan feb mär mar apr mai jun jul aug sep okt nov dez".split()
#: Most documents the model is fitted on.
MOST_TEXTS = 30_000
#: Letters of a beginning that are compared, and the part of all edges that a beginning must have.
LEAD, EDGE_SHARE = 4, 0.01
_BREAK = re.compile(r"\s*\n[^\S\n]*\n\s*")


class Edges:
    """Beginnings and endings of paragraphs in scripts without terminators, as counted in texts.

    starts: leads of paragraphs in the script; follows: leads of the script behind a name in other letters that begins a paragraph;
    tails: names in other letters that end one.
    """

    def __init__(self, texts: list[str]) -> None:
        starts, follows, tails = Counter(), Counter(), Counter()
        for text in texts:
            if not SPACED.search(text):
                continue
            for part in _BREAK.split(text.strip()):
                found = list(SPACED.finditer(part))
                if found:
                    first = found[0].start()
                    (starts if first == 0 else follows)[part[first : first + LEAD]] += 1
                    tail = part[found[-1].end() :].strip()
                    if tail and not any(map(str.isdigit, tail)):
                        tails[tail] += 1
        keep = lambda counts: {w for w, n in counts.items() if n >= max(2, EDGE_SHARE * sum(counts.values()))}
        self.starts, self.follows = keep(starts), keep(follows)
        # a known beginning inside a paragraph shows an ending before it
        begin = re.compile(r"\s+(?=" + "|".join(map(re.escape, sorted(self.starts))) + ")") if self.starts else None
        for text in texts if begin else []:
            for m in begin.finditer(text):
                before = text[max(0, m.start() - 90) : m.start()]
                last = max((x.end() for x in SPACED.finditer(before)), default=None)
                tail = before[last:].strip() if last is not None else ""
                if tail and not any(map(str.isdigit, tail)):
                    tails[tail] += 1
        self.tails = {w for w, n in tails.items() if n >= 2}


def stripped(text: str) -> tuple[str, set[int]]:
    """The text with a space for each paragraph break, and where the parts behind them begin."""
    parts = _BREAK.split(text.strip())
    joints, at = set(), 0
    for part in parts[:-1]:
        at += len(part) + 1
        joints.add(at)
    return " ".join(parts), joints


def _upper(c: str) -> bool:
    return c.isupper() or c.istitle()


def _ends_plainly(word: str, term: str, gap: str) -> bool:
    """Whether a sentence may end here though lower case follows: passages copied in lower case keep their points."""
    last = word.lower().rsplit(".", 1)[-1]
    if not gap or not term.startswith((".", "?", "!")) or term.startswith("..") or term[:2] in ('?"', "?»", "?“", '!"', "!»", "!“"):
        return False
    return len(last) > 1 and last not in ABBREVIATIONS and last not in COMPANY and word.lower() not in COMPANY


def rule(text: str, left: int, right: int, edges: Edges) -> bool:
    """Whether a free point is a boundary."""
    gap, nxt = text[left:right], text[right : right + 1]
    mark = re.search(rf"[{re.escape(TERMINATORS)}][{re.escape(TERMINATORS + CLOSERS)}\s]*$", text[max(0, left - 8) : left])
    if not mark:
        if SPACED.search(text[max(0, left - 80) : right + 80]):
            return spaced_rule(text, left, right, edges)
        return False
    term = re.sub(r"\s", "", mark[0])
    lead = text[: left - len(mark[0])]
    word = re.split(r"[\s ]", lead)[-1].lstrip("(\"'«„“「¿¡[")
    after = text[right + 1 : right + 2]
    if nxt in ",;:)）、，」』”».":
        return False
    if nxt.islower() and not _ends_plainly(word, term, gap):
        return False
    if nxt == "(" and (after.islower() or after.isdigit()):
        return False
    closed = any(c in CLOSERS for c in term)
    if closed and not gap and nxt == "と":
        return False
    if set(term) & set("!?。！？।॥؟"):
        return True
    if term[0] in ";;؛":
        return term[0] != ";" and True or bool(lead) and "Ͱ" <= lead[-1] <= "Ͽ"
    if term.startswith("...") or term[0] == "…":
        return not (nxt.isdigit())
    if closed and term[1:2] in ("\"", "”", "“", "»", "'", "’"):
        return True
    if term.startswith(".)"):
        return bool(gap) or _upper(nxt)
    word = word if re.fullmatch(r"(\w\.)*\w|[\d.,\s]+|\S*@\S*|www\S*", word) else word.rsplit(".", 1)[-1]
    word = re.split(r"['’]", word)[-1] if re.search(r"\w['’]\w", word) else word
    low = word.lower()
    single = len(word) == 1 and word.isalpha()
    script_next = nxt.isalpha() and not (nxt.isupper() or nxt.islower())
    latin_left = bool(word) and word[-1].isascii()
    if not gap:
        if not (_upper(nxt) or script_next or nxt in "\"«„“¿¡"):
            return False
        if single or low in ABBREVIATIONS or re.fullmatch(r"(\w\.)+\w", low) or "@" in low or low.startswith("www"):
            return False
        if script_next:
            return not latin_left and "؀" <= nxt <= "ۿ"
        return True
    if low == "г":
        before = re.split(r"[\s ]", lead)[-2:-1]
        return bool(before) and bool(re.fullmatch(r"\d{4}", before[0]))
    if low in ABBREVIATIONS or (single and word not in "%"):
        return False
    if low in COMPANY or re.fullmatch(r"(\w\.)+\w", low):
        if low == "co" and re.match(r"KG|KGaA|Ltd|OHG", text[right:]):
            return False
        return _upper(nxt) or nxt in "\"«„“¿¡§" or nxt.isdigit() and low not in {"p.m", "a.m"}
    if word and word[-1].isdigit() and re.fullmatch(r"\d{1,2}", word):
        return not (nxt.isdigit() or any(text[right : right + 4].lower().startswith(m) for m in MONTH_STEMS))
    if "ऀ" <= nxt <= "ॿ":
        return latin_left  # sentences of the script itself end with another mark
    return True


def spaced_rule(text: str, left: int, right: int, edges: Edges) -> bool:
    """Whether an ending and a beginning that edges have shown meet here."""
    nxt = text[right:]
    if nxt[:LEAD] in edges.starts:
        return True
    if SPACED.match(nxt) or nxt[:1].isdigit():
        return False
    stop = SPACED.search(text, right)
    if not stop or text[stop.start() : stop.start() + LEAD] not in edges.follows or "\n\n" in text[right : stop.start()]:
        return False
    begin = max((m.end() for m in SPACED.finditer(text, max(0, left - 90), left)), default=max(0, left - 90))
    run = text[begin : stop.start()]
    offset = left - begin
    if not run[:offset].strip():
        return True
    date = re.match(r"\s*(?:\d{1,2}\.\d{1,2}\.\d{4}|\d{4}-\d\d-\d\d|\d{4})(?=\s)", run)
    code = re.match(r"[A-Z]-\d+/\d+(?=\s)", run)
    number = re.match(r"[\d.,]+(?=\s)", run)
    for m in (date, code, number):
        if m:
            return m.end() == offset
    fits = [p for p in edges.tails if run.startswith(p) and run[len(p) : len(p) + 1].isspace()]
    if fits:
        return len(max(fits, key=len)) == offset
    return False


def train(texts: list[str], edges: Edges, epochs: int = 6, least: int = 3, seed: int = 7) -> tuple[dict[str, float], list[list[float]]]:
    """Averaged structured perceptron over the rules' labels."""
    data = []
    seen: Counter[str] = Counter()
    unpunctuated = [stripped(t) for t in texts if SPACED.search(t) and _BREAK.search(t.strip())]
    for t, joints in [*[(t, set()) for t in texts], *unpunctuated]:
        at = points(t)
        rows = []
        for left, right, state in at:
            if state == FREE:
                names = features(t, left, right)
                seen.update(names)
                rows.append((names, state, int(right in joints or rule(t, left, right, edges))))
            else:
                rows.append(([], state, int(state != INSIDE)))
        if rows:
            data.append(rows)
    data = [[([f for f in names if seen[f] >= least], state, y) for names, state, y in rows] for rows in data]
    w: dict[str, float] = defaultdict(float)
    total: dict[str, float] = defaultdict(float)
    last: dict[str, int] = defaultdict(int)
    chain = [[0.0, 0.0], [0.0, 0.0]]
    chain_sum = [[0.0, 0.0], [0.0, 0.0]]
    clock, order = 0, random.Random(seed)
    for _ in range(epochs):
        order.shuffle(data)
        for rows in data:
            clock += 1
            back, inside, boundary = [], 0.0, -1e9
            for names, state, _y in rows:
                s = sum(w.get(f, 0.0) for f in names)
                a, b, c, d = inside + chain[0][0], boundary + chain[1][0], inside + chain[0][1], boundary + chain[1][1]
                back.append((int(b > a), int(d > c)))
                inside, boundary = max(a, b) - s, max(c, d) + s
                if state == INSIDE:
                    boundary = -1e9
                elif state:
                    inside = -1e9
            tag = int(boundary > inside)
            guess = [0] * len(rows)
            for k in range(len(rows) - 1, -1, -1):
                guess[k] = tag
                tag = back[k][tag]
            if guess != [y for _, _, y in rows]:
                before_true = before_guess = 0
                for (names, _, y), g in zip(rows, guess, strict=True):
                    if y != g:
                        step = 1.0 if y else -1.0
                        for f in names:
                            total[f] += w[f] * (clock - last[f])
                            last[f] = clock
                            w[f] += step
                    chain[before_true][y] += 0.1
                    chain[before_guess][g] -= 0.1
                    before_true, before_guess = y, g
            for i in (0, 1):
                for j in (0, 1):
                    chain_sum[i][j] += chain[i][j]
    for f in w:
        total[f] += w[f] * (clock - last[f])
    return {f: round(v / clock, 3) for f, v in total.items() if abs(v / clock) >= 0.02}, [[round(x / clock, 3) for x in row] for row in chain_sum]


def main() -> None:
    import pyarrow.parquet as pq

    texts = [t for path in sys.argv[1].split(",") for t in pq.read_table(path, columns=["text"])["text"].to_pylist() if t]
    texts = random.Random(7).sample(texts, min(MOST_TEXTS, len(texts)))
    held, texts = texts[: len(texts) // 10], texts[len(texts) // 10 :]
    weights, chain = train(texts, Edges(texts))
    with open(sys.argv[2], "w", encoding="utf-8") as out:
        json.dump({"chain": chain, "weights": dict(sorted(weights.items()))}, out, ensure_ascii=False, separators=(",", ":"))
    chains = Model(weights, chain)
    found = total = 0
    for text, joints in (stripped(t) for t in held if SPACED.search(t)):
        starts = {a for a, _ in units(text, chains)}
        found, total = found + len(joints & starts), total + len(joints)
    print(f"held-out stripped breaks found: {found} of {total}")


if __name__ == "__main__":
    main()
