"""Benchmark decontamination: BM25 over test items with block-max WAND.

Test items are indexed: for each word the items that hold it, in blocks of items of like length, with the word's largest
impact in each block. An impact is the BM25 part of a word in an item, divided by what the item scores against itself, so 1
is a full match. Every passage of every training text (PASSAGE words, the next beginning half-way) is a query. An item
of more than half a passage is also indexed in equal parts of at most that, each with the item's own impacts, divided by
what the part scores against itself: wherever a copy lies, each part lies whole in some passage, so one threshold fits items of
any length. All items of which the whole or a part scores the threshold or more are found; the score reported is that of the whole
item in one passage, which stays below the threshold where only parts reach it. A found item is verified as a whole at its place: shared five-word shingles must hold 80 % of the item's, and cover at least half of the words of its question
and of its answer (what follows the last question mark, else its last sentence, else the last third).

Each passage that can reach the threshold at all (by the largest impacts of its words, over all items and then in some
block: tested for all passages of a batch at once) is searched by block-max WAND: one cursor for each word on its postings,
the pivot is the first item at which the words' largest impacts add up to the threshold, a block whose own largest
impacts fall short is skipped whole, and only pivots are scored.

The index of at most SHARD items is sent to tasks; more items mean more shards, each searched in turn.
Nulls and odd rows: null or empty texts match nothing, as do items without words; an item of fewer than five words has one
shingle, all its words; repeated rows are reported as often as they occur in docs; a null doc_id is reported as null;
other columns are ignored, whatever their names; empty tables give no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import Words
from .common import kept, only

PASSAGE, THRESHOLD, SHINGLE, SHARE, PART, SHARD, BLOCKS, LEAST_BLOCK = 64, 0.6, 5, 0.8, 0.5, 20_000, 64, 4
HALF = PASSAGE // 2
K1, B = 1.2, 0.75
_EDGES = re.compile(r"^\W+|\W+$")


_SEEN: dict[str, str] = kept("leaks")


def normal_of(words: list[str]) -> list[str]:
    """normal() of each, kept for those seen before."""
    if len(_SEEN) > 200_000:
        _SEEN.clear()
    out = []
    for w in words:
        v = _SEEN.get(w)
        if v is None:
            v = _SEEN[w] = normal(w)
        out.append(v)
    return out


def normal(word: str) -> str:
    """A word in lower case without marks at its ends; itself where nothing else is left."""
    low = word.lower()
    return low if low.isalnum() else _EDGES.sub("", low) or low


def words_of(text: str | None) -> list[str]:
    return [normal(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def shingles(words: list[str]) -> list[tuple[str, ...]]:
    k = min(SHINGLE, len(words))
    return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)] if words else []


def answer_at(text: str) -> int:
    """The number of words before the answer."""
    n = len(words_of(text))
    mark = text.rfind("?")
    if 0 < mark < len(text.rstrip()) - 1:
        return len(words_of(text[: mark + 1]))
    ends = [m.end() for m in re.finditer(r"[.!?](?=\s)", text.rstrip())]
    return len(words_of(text[: ends[-1]])) if ends else n - max(1, n // 3)


class Index:
    """items: (item_id, text). The blocks' largest impacts of each word, and the postings by (word, block)."""

    def __init__(self, items: list[tuple[int, str | None]]):
        kept = sorted([(len(w), i, t, w) for i, t in items if (w := words_of(t))], key=lambda x: x[:3])
        self.ids, self.words = [x[1] for x in kept], [x[3] for x in kept]
        self.answers = [answer_at(x[2]) for x in kept]
        self.sets = [set(shingles(w)) for w in self.words]
        n, mean = len(kept), np.mean([x[0] for x in kept]) if kept else 1
        held: dict[str, dict[int, int]] = {}
        for d, w in enumerate(self.words):
            for x in w:
                of = held.setdefault(x, {})
                of[d] = of.get(d, 0) + 1
        self.vocabulary = {x: k for k, x in enumerate(held)}
        part = [{d: np.log(1 + (n - len(ds) + 0.5) / (len(ds) + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(self.words[d]) / mean)) for d, f in ds.items()} for ds in held.values()]
        #: The impacts of each item's words, for its score against a passage.
        self.impacts: list[dict[int, float]] = [{} for _ in range(n)]
        for x, ds in enumerate(part):
            for d, v in ds.items():
                self.impacts[d][x] = v
        for d, of in enumerate(self.impacts):
            own = sum(of.values())
            self.impacts[d] = {x: v / own for x, v in of.items()}
        # What is searched: whole items, and the parts of those that a passage may not hold; like lengths next to each other.
        entries = [(len(w), d, 0, len(w)) for d, w in enumerate(self.words)]
        for d, w in enumerate(self.words):
            parts = -(-len(w) // HALF)
            entries += [(j * len(w) // parts - i * len(w) // parts, d, i * len(w) // parts, j * len(w) // parts) for i, j in zip(range(parts), range(1, parts + 1), strict=True) if parts > 1]
        entries.sort()
        self.items = [e[1] for e in entries]
        self.size = max(LEAST_BLOCK, -(-len(entries) // BLOCKS))
        #: The largest impact of each word in each block of entries, and over all; each word's entries and impacts there.
        self.most = np.zeros((len(held), -(-len(entries) // self.size)))
        self.postings: list[tuple[list[int], list[float]]] = [([], []) for _ in held]
        for e, (_, d, start, end) in enumerate(entries):
            xs = {self.vocabulary[w]: None for w in self.words[d][start:end]}
            own = sum(self.impacts[d][x] for x in xs)
            for x in xs:
                v = self.impacts[d][x] / own
                self.postings[x][0].append(e)
                self.postings[x][1].append(v)
                self.most[x, e // self.size] = max(self.most[x, e // self.size], v)
        self.top = self.most.max(axis=1, initial=0.0)

    def search(self, terms: np.ndarray, threshold: float, blocks: list[int] | None = None) -> list[tuple[int, float]]:
        """All entries (items and parts) that score threshold or more against the distinct terms, by block-max WAND.

        blocks: those in which the words' largest impacts reach the threshold, where that is known; all others are skipped whole.
        """
        enough, out = threshold - 1e-9, []
        if blocks is None:
            blocks = np.flatnonzero(self.most[terms].sum(axis=0) >= enough).tolist()
        for b in blocks:
            bounds, start, end = self.most[terms, b], b * self.size, (b + 1) * self.size
            here = np.flatnonzero(bounds)
            cursors = []  # of each word: the entry it stands at, the word's bound in the block, its entries, impacts, the place
            for x, bound in zip(terms[here].tolist(), bounds[here].tolist(), strict=True):
                entries, impacts = self.postings[x]
                at = bisect_left(entries, start)
                cursors.append([entries[at], bound, entries, impacts, at])
            while cursors:
                cursors.sort(key=itemgetter(0))
                reach, pivot = 0.0, -1
                for c in cursors:
                    reach += c[1]
                    if reach >= enough:
                        pivot = c[0]
                        break
                if pivot < 0:
                    break  # what is left in the block cannot reach the threshold
                score = 0.0
                full = cursors[0][0] == pivot
                for c in cursors:
                    if c[0] > pivot:
                        break
                    if full:
                        score += c[3][c[4]]
                    c[4] = c[4] + 1 if full else bisect_left(c[2], pivot, c[4])
                    c[0] = c[2][c[4]] if c[4] < len(c[2]) else end
                if full and score >= enough:
                    out.append((pivot, score))
                cursors = [c for c in cursors if c[0] < end]
        return out

    def verify(self, item: int, region: list[str]) -> tuple[float, float, float]:
        """Shares of the item's shingles, its question's and its answer's words that the region has."""
        words, own = self.words[item], shingles(self.words[item])
        k = len(own[0])
        there = {tuple(region[i : i + k]) for i in range(len(region) - k + 1)} & self.sets[item]
        covered = np.zeros(len(words), bool)
        for i, s in enumerate(own):
            if s in there:
                covered[i : i + k] = True
        a = self.answers[item]
        share = lambda x: float(x.mean()) if len(x) else 1.0
        return len(there) / len(self.sets[item]), share(covered[:a]), share(covered[a:])


def find(index: Index, texts: pa.Array, threshold: float = THRESHOLD) -> Iterator[tuple[int, int, float, float, float, float]]:
    """(row, item number, score, shares) of what is verified; the best-scoring passage of each."""
    words = Words(texts)
    spelled = normal_of(words.distinct.to_pylist())
    known = np.array([index.vocabulary.get(w, -1) for w in spelled], np.int64)
    n = np.diff(words.at)
    halves = np.maximum(1, -(-n // HALF))
    first = np.cumsum(halves) - halves
    row = np.repeat(np.arange(len(n)), halves)
    term = known[words.codes] if len(words.codes) else np.empty(0, np.int64)
    half = first[words.owner()] + (np.arange(len(term)) - np.repeat(words.at[:-1], n)) // HALF
    size = max(1, len(index.vocabulary))
    keys = np.unique((half * size + term)[term >= 0])  # each word once in a half
    half, term = keys // size, keys % size
    # A passage is two halves next to each other in one text; the last half alone if it is the only one.
    whole = np.flatnonzero((np.append(row[1:], -1) == row) | (halves[row] == 1))
    after = np.where(halves[row[whole]] == 1, whole, whole + 1)

    def reaching(bound: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Which of some passages have words whose bounds add up to the threshold."""
        reach = np.bincount(half, bound[term], len(row))
        reach = np.where(after > whole, reach[whole] + reach[np.minimum(after, len(row) - 1)], reach[whole])
        return some[reach[some] >= threshold - 1e-9]

    possible = reaching(index.top, np.arange(len(whole))) if index.most.size else np.empty(0, int)
    # The same per block, for the words of passages that are left.
    open_ = np.zeros(len(row) + 1, bool)
    open_[whole[possible]] = open_[after[possible]] = True
    half, term = half[open_[half]], term[open_[half]]
    at = np.searchsorted(half, np.arange(len(row) + 1))
    passing: dict[int, list[int]] = {}
    for b in range(index.most.shape[1]):
        for p in reaching(index.most[:, b], possible).tolist():
            passing.setdefault(p, []).append(b)
    best: dict[tuple[int, int], tuple] = {}
    for p, blocks in passing.items():
        h, r = int(whole[p]), int(row[whole[p]])
        terms = np.unique(term[at[h] : at[int(after[p]) + 1]])
        there = set(terms.tolist())
        for item in sorted({index.items[e] for e, _ in index.search(terms, threshold, blocks)}):
            score = sum(v for x, v in index.impacts[item].items() if x in there)
            if score <= best.get((r, item), (0,))[0]:
                continue
            start, more = words.at[r] + (h - first[r]) * HALF, len(index.words[item])
            region = [spelled[c] for c in words.codes[max(words.at[r], start - more) : min(words.at[r + 1], start + PASSAGE + more)].tolist()]
            shares = index.verify(item, region)
            if shares[0] >= SHARE and min(shares[1:]) >= PART:
                best[r, item] = (score, *shares)
    for (r, item), found in sorted(best.items()):
        yield r, item, *found


def _shards(items: DataFrame) -> Iterator[Broadcast]:
    """The items' index, in shards of about SHARD items."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    shards = max(1, -(-items.count() // SHARD))
    for k in range(shards):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k)
        yield items.sparkSession.sparkContext.broadcast(Index([(r.item_id, r.text) for r in own.orderBy("item_id", "text").toLocalIterator()]))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) -> doc_id, item_id, score, shingle_share, question_share, answer_share."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for held in _shards(items):

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            only("leaks")
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    found = list(find(held.value, part.column(1), threshold))
                    rows = pa.array([f[0] for f in found], pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column(0).take(rows), pa.array([held.value.ids[f[1]] for f in found], pa.int64()), *(pa.array([f[c] for f in found], pa.float64()) for c in range(2, 6))], ["doc_id", "item_id", "score", "shingle_share", "question_share", "answer_share"])

        part = plain.mapInArrow(run, "doc_id long, item_id long, score double, shingle_share double, question_share double, answer_share double")
        out = part if out is None else out.union(part)
    return out


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose text contaminated() finds an item in, whatever their doc_id; columns as they were. No row is shuffled."""
    where = docs.columns.index("text")
    for held in _shards(items):

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            only("leaks")
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    clean = np.ones(part.num_rows, bool)
                    clean[[f[0] for f in find(held.value, part.column(where).cast(pa.string()), threshold)]] = False
                    yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
