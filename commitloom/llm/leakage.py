"""Evaluation passages that leaked into training texts, found by winnowing.

Both sides are folded to letters and digits.  Documents keep the least k-gram
hash of every window of w hashes, items keep all of theirs, so every span of
w + k - 1 folded characters that both share gives a common fingerprint, and one
common fingerprint makes a candidate.  Each candidate is then checked exactly:
runs of common words are extended over slight changes to stretches, and the best
one or two stretches, in the item's order, must carry the wanted part of the
item, both by characters and by characters weighted with how rare the words are
among the items.  The weights tell a passage from another one that fills the
same sentence pattern.

Items are the stated query set: they are taken in blocks of bounded size, each
of which is sent to the tasks that read the documents, so no document and no
fingerprint is ever shuffled.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

#: Folded characters in a fingerprint, and fingerprints in a window.
GRAM, WINDOW = 12, 8
#: The part of an item that makes a leak, and the part of its weight that must stand word for word (misspelt words not counted).
SHARE, OWN = 0.4, 0.35
#: Least run of common words, longest change between two runs, what each changed word costs in common words, and the least worth of a stretch.
RUN, CHANGE, COST, LEAST = 3, 6, 2.0, 6.0
#: Characters of items that are searched for at once; more items take further blocks.
BLOCK_CHARS = 4_000_000

_IGNORED = regex.compile(r"[\p{Cf}\p{Mn}]")
_TOKEN = regex.compile(r"[\p{Script=Han}\p{Script=Hiragana}\p{Script=Katakana}\p{Script=Thai}]|[\p{L}\p{M}]+|\p{N}+")
_ASCII_TOKEN = regex.compile(r"[a-z]+|[0-9]+")
_BREAK = regex.compile(r"(?<=\p{Ll})[-‐]\n[ \t>]*(?=\p{Ll})")
_B = np.uint64(0x9E3779B97F4A7C15)


def fold(text: str) -> str:
    """Case, accents, width, invisible characters and words parted at line ends are evened out."""
    text = _BREAK.sub("", text)
    if text.isascii():
        return text.lower()
    return _IGNORED.sub("", unicodedata.normalize("NFKD", text).casefold())


def words(text: str) -> list[str]:
    """Words, numbers, and the single characters of scripts without blanks."""
    text = fold(text)
    return (_ASCII_TOKEN if text.isascii() else _TOKEN).findall(text)


def gram_hashes(tokens: list[str]) -> np.ndarray:
    """A 64-bit hash of each k-gram of the folded characters."""
    codes = np.frombuffer("".join(tokens).encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(codes) < GRAM:
        return np.empty(0, np.uint64)
    h = np.zeros(len(codes) - GRAM + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(GRAM):
            h = (h * _B) + codes[i : i + len(h)] + np.uint64(1)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def winnow(hashes: np.ndarray) -> np.ndarray:
    """The distinct least hashes of all windows (the whole text, if it is shorter than one)."""
    if len(hashes) <= WINDOW:
        return hashes.min(keepdims=True) if len(hashes) else hashes
    return np.unique(np.lib.stride_tricks.sliding_window_view(hashes, WINDOW).min(axis=1))


def _close(a: str, b: str) -> bool:
    """Two spellings of one word: one letter more, less, other or two swapped."""
    if min(len(a), len(b)) < 4 or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (x[:2] == y[1::-1] and x[2:] == y[2:])


class Item:
    """An item, ready to be looked for."""

    def __init__(self, words_: list[str], rarity: list[float]) -> None:
        self.words = words_
        self.run = min(RUN, len(words_))
        self.least = min(LEAST, max(float(self.run), len(words_) * SHARE / 2))
        self.chars = np.cumsum([0.0, *map(len, words_)])
        self.weight = np.cumsum([0.0, *(len(t) * r for t, r in zip(words_, rarity))])
        self.at: dict[tuple[str, ...], list[int]] = defaultdict(list)
        for i in range(len(words_) - self.run + 1):
            self.at[tuple(words_[i : i + self.run])].append(i)
        self.heads = frozenset(g[0] for g in self.at if g)
        self.weight_of: dict[str, float] = defaultdict(float)
        for t, r in zip(words_, rarity):
            self.weight_of[t] += len(t) * r


def carried(doc: list[str], item: Item, places: dict[str, list[int]] | None = None) -> tuple[float, float]:
    """The part of the item that the best one or two stretches of the document carry, by characters and, word for word, by weight.

    ``places`` are the positions of each word in the document.
    """
    run = item.run
    if not run or len(doc) < run:
        return 0.0, 0.0
    if places is None:
        places = word_places(doc)
    runs: dict[int, list[list[int]]] = defaultdict(list)  # by diagonal: start in doc, end in doc
    for j in sorted(j for t in item.heads for j in places.get(t, ())):
        for i in item.at.get(tuple(doc[j : j + run]), ()):
            own = runs[j - i]
            if own and own[-1][1] >= j + run - 1:
                own[-1][1] = j + run
            else:
                own.append([j, j + run])
    pieces = sorted((a, b, a - d, b - d) for d, own in runs.items() for a, b in own)
    if not pieces:
        return 0.0, 0.0
    chars, weight, text = item.chars, item.weight, item.words
    # stretches: chains of runs over slight changes
    best: list[tuple[float, float, int, int, int, int, float]] = []  # score, characters carried, item from, to, doc from, to, weight carried
    open_: list[int] = []
    for n, (a, b, i, k) in enumerate(pieces):
        score, mass, own, start, dstart = float(b - a), float(chars[k] - chars[i]), float(weight[k] - weight[i]), i, a
        open_ = [m for m in open_ if pieces[m][1] >= a - CHANGE]
        for m in open_:
            pa, pb, pi, pk = pieces[m]
            over = max(0, pb - a, pk - i)
            gd, gi = a + over - pb, i + over - pk
            if gd < 0 or gi < 0 or max(gd, gi) > CHANGE or over >= b - a:
                continue
            alike = [x for x in range(gd) if _close(doc[pb + x], text[pk + x])] if gd == gi else []
            cost = COST * (max(gd, gi) - len(alike))
            s = best[m][0] + (b - a - over) - cost
            if best[m][0] > cost and s > score:  # a single changed word between two runs is carried too, and so are misspelt ones
                score, start, dstart = s, best[m][2], best[m][4]
                mass = best[m][1] + float(chars[k] - chars[i + over]) + (len(text[pk]) if gi == gd == 1 else sum(len(text[pk + x]) for x in alike))
                own = best[m][6] + float(weight[k] - weight[i + over])
        best.append((score, mass, start, k, dstart, b, own))
        open_.append(n)
    top = max(best, key=lambda x: x[1])
    if top[0] < item.least:
        return 0.0, 0.0
    second = (0.0, 0.0)
    for x in best:  # the other stretch: before or after it in both
        if x[0] >= item.least and ((x[3] <= top[2] and x[5] <= top[4]) or (x[2] >= top[3] and x[4] >= top[5])):
            second = max(second, (x[1], x[6]))
    return (top[1] + second[0]) / float(chars[-1]), (top[6] + second[1]) / float(weight[-1])


def word_places(doc: list[str]) -> dict[str, list[int]]:
    places: dict[str, list[int]] = defaultdict(list)
    for j, t in enumerate(doc):
        places[t].append(j)
    return places


def item_classes(items: DataFrame, id_col: str = "item_id", text_col: str = "item_text") -> tuple[DataFrame, DataFrame]:
    """Items of the same words are one class: ``class_id, words, rarity``, and the members ``item_id, class_id``.

    The rarity of a word is the logarithm of 1 + the classes over the classes that have it.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"item_id": f["i"], "key": [" ".join(words(t)) for t in f["t"]]})

    slim = items.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t")).filter("i is not null and t is not null")
    keyed = cut(slim.mapInPandas(run, "item_id bigint, key string").filter("key <> ''").distinct())
    classes = keyed.groupBy("key").agg(F.min("item_id").alias("class_id"))
    members = keyed.join(classes, "key").select("item_id", "class_id")
    spread = classes.select("class_id", F.posexplode(F.split("key", " ")).alias("pos", "word"))
    known = spread.groupBy("word").agg(F.count_distinct("class_id").alias("n"))
    total = classes.agg(F.count(F.lit(1)).alias("total"))
    weighed = spread.join(known, "word").crossJoin(F.broadcast(total)).select("class_id", F.struct("pos", "word", F.log(1 + F.col("total") / F.col("n")).alias("r")).alias("w"))
    packed = weighed.groupBy("class_id").agg(F.array_sort(F.collect_list("w")).alias("w"))  # as long as one item
    return packed.select("class_id", F.col("w.word").alias("words"), F.col("w.r").alias("rarity")), members


class Block:
    """Some classes of items with their fingerprints, sorted."""

    def __init__(self, rows: list[tuple[int, list[str], list[float]]]) -> None:
        self.ids = [r[0] for r in rows]
        self.items = [Item(r[1], r[2]) for r in rows]
        prints = [np.unique(gram_hashes(r[1])).view(np.int64) for r in rows]
        owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(p) for p in prints])
        # an item shorter than a window may lose all of its fingerprints in a document, so all hashes of documents ask for it
        small = np.array([it.chars[-1] < GRAM + WINDOW - 1 for it in self.items], bool)[owner] if len(rows) else np.zeros(0, bool)
        every = np.concatenate([*prints, np.empty(0, np.int64)])
        self.long, self.short = (self._sorted(every[m], owner[m]) for m in (~small, small))

    @staticmethod
    def _sorted(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(h, kind="stable")
        return h[order], owner[order]

    def candidates(self, hashes: np.ndarray) -> list[int]:
        """The items that share a fingerprint with a document."""
        found: set[int] = set()
        for (h, owner), asked in ((self.long, winnow(hashes)), (self.short, hashes)):
            if not len(h) or not len(asked):
                continue
            asked = asked.view(np.int64)
            a = np.searchsorted(h, asked)
            hit = np.flatnonzero(h[np.minimum(a, len(h) - 1)] == asked)
            if len(hit):
                b = np.searchsorted(h, asked[hit], side="right")
                for x, y in zip(a[hit], b):
                    found.update(owner[x:y].tolist())
        return sorted(found)

    def leaks(self, text: str, share: float) -> list[tuple[int, float]]:
        """``class_id, share`` of the items that the text carries."""
        doc = words(text)
        asked = self.candidates(gram_hashes(doc))
        if not asked:
            return []
        out, places, least = [], word_places(doc), share * OWN / SHARE
        for n in asked:
            item = self.items[n]
            if sum(w for t, w in item.weight_of.items() if t in places) < least * item.weight[-1]:
                continue  # the words wanted stand nowhere in the document
            part, own = carried(doc, item, places)
            if part >= share and own >= least:
                out.append((self.ids[n], part))
        return out


def _blocks(classes: DataFrame, most: int) -> Iterator[Block]:
    held, size = [], 0
    for r in classes.toLocalIterator():
        held.append((r["class_id"], r["words"], r["rarity"]))
        size += sum(map(len, r["words"]))
        if size >= most:
            yield Block(held)
            held, size = [], 0
    if held:
        yield Block(held)


def leaks(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, share``: documents that carry at least ``share`` of an item.

    Null and blank texts and items give nothing; items of fewer than GRAM folded
    characters have no fingerprint and are found nowhere.  Texts are taken whole.
    Copies of a document each count under their own id, repeated rows of one id
    count once.  Items of the same words are looked for once and each reported.

    The documents are read once for each block of ``block_chars`` characters of
    items; the results of a block are written before the next one is sent.
    """
    classes, members = item_classes(items)
    slim = documents.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t")).filter("i is not null and t is not null")
    schema = "doc_id bigint, class_id bigint, share double"

    def search(block: Block, last: bool) -> DataFrame:
        sent = documents.sparkSession.sparkContext.broadcast(block)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                rows = [(i, c, part) for i, t in zip(f["i"], f["t"]) for c, part in sent.value.leaks(t, share)]
                yield pd.DataFrame(rows, columns=["doc_id", "class_id", "share"])

        found = slim.mapInPandas(run, schema)
        if last:
            return found
        found = cut(found)
        sent.destroy()
        return found

    parts, waiting = [], None
    for block in _blocks(classes, block_chars):
        if waiting is not None:
            parts.append(search(waiting, False))
        waiting = block
    parts.append(search(waiting or Block([]), True))
    once = reduce(DataFrame.unionAll, parts).groupBy("doc_id", "class_id").agg(F.max("share").alias("share"))
    return once.join(members, "class_id").select("doc_id", "item_id", "share")


def leak_report(found: DataFrame, items: DataFrame) -> DataFrame:
    """Per item: how many documents carry it."""
    return items.select("item_id", "suite").join(found.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.round(F.max("share"), 6).alias("greatest_share")), "item_id")
