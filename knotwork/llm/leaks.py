"""Held-out items leaking into documents.

Method: set join on shingles of ``WIDTH`` words. One pass over the documents hashes their shingles and joins them with the
shingles of all items (by broadcast if they are few, by shuffle if not), whatever their number. A shingle that fewer than
``COMMON_ITEMS`` items have tells, and a document that has a telling shingle of an item is its candidate. Wording that more items
have, such as a notice, tells nothing by its single shingles, but items may share each of their shingles with others and still be
the only ones to have them together: so what a document shares with an item is looked up among the items as a whole, by a
prefix-filtered containment join in order of rarity, and the document is a candidate too unless that whole is general wording.
Then the candidates' texts are read again, the common words bound what a passage can be, and the words on the same alignment
are compared: a passage is a run in one piece and in order, with single words changed; its share of the item is the lesser of its
shares of the item's characters and words. Passages with few telling shingles are looked up among the items in the same way.
No bound leaves out a passage that the comparison would accept.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knotwork.functions.keys import small
from knotwork.session import Scratch, spread

#: Words in a shingle. Single changed words break wider ones.
WIDTH = 3
#: Wording of so many items, and more, is general. Items with equal words count once, and so does an item with several texts.
COMMON_ITEMS = 3
#: Most rows of a table of item shingles, or of candidates, that is broadcast; larger ones are shuffled.
MOST_BROADCAST = 1_000_000

_SPELLED = {"ß": "s", "ø": "o", "œ": "o", "æ": "a", "đ": "d", "ł": "l", "þ": "t", "ı": "i", "’": "'"}
_SPELL = re.compile("[" + "".join(_SPELLED) + "]")
# in the basic plane only: a class beyond it takes many times as long
_MARKS = re.compile("[" + "".join(chr(c) for c in range(0x300, 0x10000) if unicodedata.combining(chr(c))) + "]+")
_JOINED = re.compile(r"[.,'·\-/‐‑](?:(?<=\d[.,'·])(?=\d)|(?<=\w[\-/‐‑'])(?=\w))")
_WORD = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]|[^\W_぀-ヿ㐀-鿿豈-﫿]+")


def words(text: str) -> list[str]:
    """Words apart from case, accents (dropped or spelled out), punctuation and white space; Han and kana one by one."""
    text = text.lower()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", _SPELL.sub(lambda m: _SPELLED[m[0]], text)))
    text = _JOINED.sub("", text)
    for spelled, letter in (("ae", "a"), ("oe", "o"), ("ue", "u"), ("ss", "s"), ("aa", "a")):
        text = text.replace(spelled, letter)
    return _WORD.findall(text)


class _Hashes(dict):
    """Hashes of words, each computed once while there are not too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Hashes()


def shingles(found: list[str]) -> np.ndarray:
    """Hashes of the runs of ``WIDTH`` words, in order."""
    if len(found) < WIDTH:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    n = len(h) - WIDTH + 1
    out = h[:n].copy()
    for k in range(1, WIDTH):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    return out.view(np.int64)


#: Number of a document's word that no item has, without and with a digit.
UNKNOWN, FIGURE = -1, -2


def passages(doc: np.ndarray, item: np.ndarray, size: np.ndarray, pairs: list[tuple[int, int]], figures: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(characters, first, last) of each passage of the item that the document has, from shared shingles.

    A run goes on along its alignment over single changed words, but not where one figure stands for another, which makes
    it the same wording about something else; a word put in, left out, split or joined moves the alignment by one.
    figures: for each word number, whether the word has a digit.
    """

    def other_figure(i: int, j: int) -> bool:
        d, x = doc[i], item[j]
        return figures is not None and bool(figures[x]) and bool(d == FIGURE or d >= 0 and figures[d])

    n, m = len(item), len(doc)
    total = np.concatenate([[0], np.cumsum(size)])
    found: set[tuple[int, int, int]] = set()
    done: set[tuple[int, int]] = set()
    for p, q in pairs:
        if (p, q) in done:
            continue
        # to the right
        i, j, last = p, q, q
        while i < m and j < n:
            if doc[i] == item[j]:
                done.add((i, j))
                last = j
                i, j = i + 1, j + 1
            elif other_figure(i, j):
                break
            elif i + 1 < m and j + 1 < n and doc[i + 1] == item[j + 1]:
                i, j = i + 1, j + 1
            elif i + 2 < m and j + 1 < n and doc[i + 1] == item[j] and doc[i + 2] == item[j + 1]:
                i += 1
            elif i + 2 < m and j + 1 < n and doc[i + 2] == item[j + 1]:
                i, j = i + 2, j + 1
            elif i + 1 < m and j + 2 < n and (doc[i] == item[j + 1] or doc[i + 1] == item[j + 2]):
                i, j = (i, j + 1) if doc[i] == item[j + 1] else (i + 1, j + 2)
            else:
                break
        # to the left
        i, j, first = p - 1, q - 1, q
        while i >= 0 and j >= 0:
            if doc[i] == item[j]:
                done.add((i, j))
                first = j
                i, j = i - 1, j - 1
            elif other_figure(i, j):
                break
            elif i > 0 and j > 0 and doc[i - 1] == item[j - 1]:
                i, j = i - 1, j - 1
            elif i > 1 and j > 0 and doc[i - 2] == item[j - 1]:
                i, j = i - 2, j - 1
            elif i > 0 and j > 1 and (doc[i] == item[j - 1] or doc[i - 1] == item[j - 2]):
                i, j = (i, j - 1) if doc[i] == item[j - 1] else (i - 1, j - 2)
            else:
                break
        found.add((int(total[last + 1] - total[first]), first, last))
    return sorted(found, reverse=True)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.unique(shingles(words(t))) for t in batch.column(1).to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
        values = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["k", "hs"])


def _worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As ``_hashed``, with a hash of all words in order."""
    for batch in batches:
        wording = pa.array([xxhash.xxh64_intdigest(" ".join(words(t))) - 2**63 for t in batch.column(1).to_pylist()], pa.int64())
        for hashed in _hashed(iter([batch])):
            yield pa.RecordBatch.from_arrays([*hashed.columns, wording], names=["k", "hs", "wording"])


def _general(sets: DataFrame, texts: DataFrame, held: DataFrame) -> DataFrame:
    """(s): of (s, hs), the sets of shingles that are general wording: ``COMMON_ITEMS`` items have all but fewer than ``WIDTH`` of
    them, so that one word of an item's own makes a difference and a word beside the wording makes none.

    An item that lacks fewer than ``WIDTH`` shingles has one of the ``WIDTH`` rarest, by which the items are found.
    texts: (t, item_id, wording, own); held: (h, t, items), with the number of items that have the shingle.
    """
    known = small(held.select("h", "items").distinct(), MOST_BROADCAST)
    ranked = sets.select("s", F.explode("hs").alias("h")).join(known, "h").withColumn("rank", F.row_number().over(W.partitionBy("s").orderBy("items", "h")))
    met = ranked.where(F.col("rank") <= WIDTH).select("s", "h").join(held.select("h", "t"), "h").select("s", "t").distinct()
    holders = met.join(sets, "s").join(small(texts), "t").where(F.size(F.array_except("hs", "own")) < WIDTH)
    return holders.groupBy("s").agg(_items().alias("items")).where(F.col("items") >= COMMON_ITEMS).select("s")


def _items() -> Column:
    return F.least(F.countDistinct("item_id"), F.countDistinct("wording"))


def _verify(share: float, distinct_share: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, list[str], set[str]] = (None, [], set())
        items: dict[tuple[int, str], tuple] = {}
        for batch in batches:
            out: list[tuple] = []
            for k, (text, number, item_text, telling) in enumerate(zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True)):
                if text != last[0]:
                    found = words(text)
                    last = (text, found, set(found))
                known = items.get((number, item_text))
                if known is None:
                    if len(items) > 10_000:
                        items.clear()
                    known = items[(number, item_text)] = _item(item_text, set(telling))
                names, ids, sizes, starts, hashes, rare, figures, places = known
                # a run has one of three words at least, where two of the item's are joined, and one of the document's to two of the item's
                if 3 * sum(places[w] for w in last[2] & names.keys()) < share * len(ids) or 2 * len(last[1]) < share * len(ids):
                    continue
                doc = np.array([names.get(w, -3) for w in last[1]], dtype=np.int32)
                for i in np.flatnonzero(doc == -3).tolist():
                    doc[i] = FIGURE if any(map(str.isdigit, last[1][i])) else UNKNOWN
                pairs = [(p, q) for p in np.flatnonzero((doc[:-2] >= 0) & (doc[1:-1] >= 0) & (doc[2:] >= 0)).tolist() for q in starts.get(tuple(doc[p : p + WIDTH].tolist()), ())]
                shared, whole = sorted({q for _, q in pairs}), max(1, int(sizes.sum()))
                for covered, first, end in passages(doc, ids, sizes, pairs, figures):
                    part = min(covered / whole, (end + 1 - first) / len(ids))
                    if part < share:
                        continue
                    within = [q for q in shared if first <= q <= end]
                    if sum(rare[q] for q in within) >= distinct_share * len(within):
                        out.append((k, covered, part, None))
                        break
                    some = sorted({hashes[q] for q in within})
                    if len(some) >= WIDTH:
                        out.append((k, covered, part, some))
            keep = pa.array([o[0] for o in out], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(keep), batch.column(2).take(keep), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.float64()), pa.array([o[3] for o in out], pa.list_(pa.int64()))],
                names=["k", "item_id", "chars", "share", "hs"],
            )

    return verify


def _item(text: str, telling: set[int]) -> tuple:
    """(numbers of words, the item's word numbers, sizes, places of shingles, their hashes, telling places, whether words have digits, numbers of places)."""
    found = words(text)
    names: dict[str, int] = {}
    ids = np.array([names.setdefault(w, len(names)) for w in found], dtype=np.int32)
    starts: dict[tuple[int, ...], list[int]] = defaultdict(list)
    for q in range(len(ids) - WIDTH + 1):
        starts[tuple(ids[q : q + WIDTH].tolist())].append(q)
    figures = np.array([any(map(str.isdigit, w)) for w in names], dtype=bool)
    hashes = shingles(found).tolist()
    return names, ids, np.array([len(w) for w in found], dtype=np.int32), dict(starts), hashes, [h in telling for h in hashes], figures, Counter(found)


def leaks(documents: DataFrame, items: DataFrame, *, share: float = 1 / 3, distinct_share: float = 0.25) -> DataFrame:
    """(doc_id, item_id, chars, share): documents with a passage of at least the share of an item.

    distinct_share: part of the passage's shingles that fewer than ``COMMON_ITEMS`` items have; a passage with fewer of them counts
    if it is no general wording as a whole, so that a notice or wording that items share is no leak. Items with equal words leak
    together. Defined cases: null and empty texts have no passage; an item with fewer than ``WIDTH`` words never leaks; an item
    id given several texts leaks with any of them; repeated rows repeat; other columns are ignored; empty tables give no rows.
    """
    spark = documents.sparkSession
    kind = documents.schema["doc_id"].dataType.simpleString()
    scratch = Scratch(spark, "leaks")
    docs = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").alias("k"), "text")

    # the items' shingles, and how many items have each
    texts = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    texts = texts.withColumn("t", F.xxhash64("item_id", "text"))
    hashed = texts.select("t", "text").mapInArrow(_worded, "k bigint, hs array<bigint>, wording bigint").select(F.col("k").alias("t"), F.col("hs").alias("own"), "wording")
    texts = scratch.keep(texts.join(hashed, "t"))
    each = texts.select("t", "item_id", "wording", F.explode("own").alias("h"))
    held = scratch.keep(each.select("h", "t").join(each.groupBy("h").agg(_items().alias("items")), "h"))
    telling = F.col("items") < COMMON_ITEMS

    index = small(held.select("h").distinct(), MOST_BROADCAST)
    # the optimiser takes the shingles for as small as the documents' ids
    hashed = spread(docs).mapInArrow(_hashed, f"k {kind}, hs array<bigint>").select("k", F.explode("hs").alias("h"))
    hits = scratch.keep(hashed.join(index, "h", "left_semi"))

    # what a document shares with an item: a telling shingle, or a whole that is no general wording
    met = hits.join(small(held, MOST_BROADCAST), "h").groupBy("k", "t").agg(F.array_sort(F.collect_set("h")).alias("hs"), F.bool_or(telling).alias("told"))
    met = met.where(F.col("told") | (F.size("hs") >= WIDTH))
    met = scratch.keep(met.select("k", "t", "told", F.when(~F.col("told"), F.xxhash64("hs")).alias("s"), F.when(~F.col("told"), F.col("hs")).alias("hs")))
    lookup = texts.select("t", "item_id", "wording", "own")
    general = scratch.keep(_general(met.where("NOT told").select("s", "hs").dropDuplicates(["s"]), lookup, held))
    candidates = scratch.keep(met.select("k", "t", "s").join(general, "s", "left_anti").select("k", "t"))

    rare = held.where(telling).groupBy("t").agg(F.collect_list("h").alias("telling"))
    told = texts.join(rare, "t", "left").select("t", "item_id", F.col("text").alias("item_text"), F.coalesce("telling", F.array().cast("array<bigint>")).alias("telling"))
    wanted = candidates.groupBy("k").agg(F.collect_list("t").alias("ts"))
    found = docs.join(small(wanted, MOST_BROADCAST // 10), "k").select("k", "text", F.explode("ts").alias("t"))
    rows = spread(found.join(small(told), "t").select("k", "text", "item_id", "item_text", "telling"))
    checked = scratch.keep(rows.mapInArrow(_verify(share, distinct_share), f"k {kind}, item_id bigint, chars int, share double, hs array<bigint>").withColumn("s", F.when(F.col("hs").isNotNull(), F.xxhash64("hs"))))
    out = checked.join(_general(checked.where("s IS NOT NULL").select("s", "hs").dropDuplicates(["s"]), lookup, held), "s", "left_anti")
    return out.groupBy(F.col("k").alias("doc_id"), "item_id").agg(F.max("chars").alias("chars"), F.max("share").alias("share"))
