"""Substring dedup by level-wise doubling of word windows.

A window of LENGTH words can repeat only if each shorter window in it does. Every long window therefore names one short
window in it, the least-hashed of FIRST words, which any repeat of the long window names too. At each level those that
two documents hold survive; those alone are extended to twice their length inside their long window (to the right, or to
the left where the long window ends), and so on until LENGTH is reached or no candidate survives: 4, 8, 13 for 13 words.

Documents are dealt once into blocks by a hash of doc_id, written bucketed, so that no later pass shuffles texts. Each
block sends each window once, however many of its documents hold it: a window that a third of all documents hold costs
one entry a block. Entries of a block that go to the same bucket of the hash space share a row, so rows grow with the
texts, never with blocks times buckets.

The short levels send 64-bit hashes and only ever rule windows out by them, which loses nothing. The last level compares
128-bit fingerprints of the words (two hashes of each word and of their order, independent of each other).

Nulls and odd rows: a null or empty text has no words; a document of fewer than LENGTH words loses none; rows with a null
doc_id neither lose words nor cost others any; rows that repeat a doc_id are judged alike and do not cost each other
words, since only a smaller doc_id does; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import Words, word_hashes
from .common import materialize, materialize_by_block, window_hashes, with_block

#: Characters of the texts of a block, and blocks whose windows one bucket of the hash space holds: what a task holds at a time.
BLOCK_CHARS, BLOCKS_A_BUCKET = 4_000_000, 4
FIRST = 4
_SENT, _BACK = "bucket int, block int, entries binary", "block int, entries binary"
#: What is sent and sent back: of short windows hashes (the low bit: two documents of the block hold it), of long ones all.
_SHORT = np.dtype([("h", "<u8")])
_LONG = np.dtype([("h", "<u8"), ("g", "<u8"), ("low", "<i8"), ("more", "u1")])
_KNOWN = np.dtype([("h", "<u8"), ("g", "<u8"), ("low", "<i8")])


def levels(length: int, first: int = FIRST) -> list[int]:
    """Window lengths of the levels: doubling from first, the last one length itself."""
    out = [min(first, -(-length // 2))]
    while out[-1] < length:
        out.append(min(2 * out[-1], length))
    return out if len(out) > 1 else [length, length]


class Block:
    """The words of a block's documents in a row, as pairs of hashes, and where long windows begin."""

    def __init__(self, group: pa.Table, length: int):
        texts = group.column("text").combine_chunks()
        words = Words(texts)
        self.h, self.g = (h[words.codes] for h in word_hashes(words, (40_009, 50_021)))
        self.at, self.length = words.at, length
        ids = group.column("doc_id").combine_chunks()
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy()
        n = np.diff(self.at)
        #: Whether a long window of a document with an id begins at each word.
        self.begins = np.arange(len(self.h)) < np.repeat(np.where(self.known, self.at[1:] - length + 1, 0), n)
        self.owner = np.repeat(np.arange(len(n)), n)

    def long_windows(self) -> np.ndarray:
        return np.flatnonzero(self.begins)

    def named(self, starts: np.ndarray, size: int, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For long windows the place of the window of size words that each names, and the hashes of all windows of that size."""
        hashes = window_hashes(self.h, size)
        if not len(starts):
            return starts, hashes
        if first is None:
            view = np.lib.stride_tricks.sliding_window_view(hashes, self.length - size + 1)
            return view[starts].argmin(axis=1) + starts, hashes
        return np.minimum(first, starts + self.length - size), hashes


def _unique_with_more(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Distinct hashes, even ones of a single document, odd ones (low bit) of several."""
    h = h & ~np.uint64(1)
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
    if not len(first):
        return h
    return h[first] | (np.minimum.reduceat(owner, first) < np.maximum.reduceat(owner, first)).astype(np.uint64)


def _rows(block: int, entries: np.ndarray, buckets: int) -> pa.Table:
    """Entries in order of h -> a row for each bucket that gets any."""
    place = ((entries["h"] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    used, cut = np.unique(place, return_index=True)
    parts = [entries[a:b].tobytes() for a, b in zip(cut, [*cut[1:], len(entries)], strict=True)] if len(used) else []
    return pa.table({"bucket": pa.array(used.astype(np.int32)), "block": pa.array(np.full(len(used), block, np.int32)), "entries": pa.array(parts, pa.binary())})


def _back(who: np.ndarray, blocks: list[int], entries: np.ndarray) -> pa.Table:
    """entries, those of the same sender next to each other -> a row for each sender."""
    senders, cut = np.unique(who, return_index=True)
    parts = [entries[a:b].tobytes() for a, b in zip(cut, [*cut[1:], len(entries)], strict=True)] if len(senders) else []
    return pa.table({"block": pa.array([blocks[s] for s in senders.tolist()], pa.int32()), "entries": pa.array(parts, pa.binary())})


def _received(group: pa.Table, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    sent = [np.frombuffer(x, kind) for x in group.column("entries").to_pylist()]
    return np.concatenate([np.empty(0, kind), *sent]), np.repeat(np.arange(len(sent)), [len(x) for x in sent])


def _meet_short(group: pa.Table) -> pa.Table:
    """Per bucket: the short windows that two documents hold, back to the blocks that sent them."""
    entries, who = _received(group, _SHORT)
    more, h = entries["h"] & np.uint64(1), entries["h"] & ~np.uint64(1)
    keys, at, n = np.unique(h, return_inverse=True, return_counts=True)
    alive = ((n > 1) | (np.bincount(at, more, len(keys)) > 0))[at]
    return _back(who[alive], group.column("block").to_pylist(), h[alive])


def _groups(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal pairs next to each other, and where each distinct one begins."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    return order, np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.empty(0, np.int64)


def _meet_long(group: pa.Table) -> pa.Table:
    """Per bucket: the long windows that two documents hold, with the smallest doc_id, to blocks that hold them in another one."""
    entries, who = _received(group, _LONG)
    order, first = _groups(entries["h"], entries["g"])
    if not len(first):
        return _back(who, [], np.empty(0, _KNOWN))
    entries, who = entries[order], who[order]
    least = np.repeat(np.minimum.reduceat(entries["low"], first), np.diff([*first, len(entries)]))
    wanted = (entries["low"] > least) | (entries["more"] > 0)
    out = np.empty(int(wanted.sum()), _KNOWN)
    out["h"], out["g"], out["low"], who = entries["h"][wanted], entries["g"][wanted], least[wanted], who[wanted]
    by = np.argsort(who, kind="stable")
    return _back(who[by], group.column("block").to_pylist(), out[by])


def _alive(block: Block, starts: np.ndarray, back: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the long windows those whose named window of size words survived, and the places of the first level's ones."""
    first, _ = block.named(starts, levels(block.length)[0])
    place, hashes = block.named(starts, size, first)
    keys = np.sort(np.frombuffer(b"".join(back.column("entries").to_pylist()), np.uint64))
    if not len(keys) or not len(starts):
        return starts[:0], first[:0]
    h = hashes[place] & ~np.uint64(1)
    alive = keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h
    return starts[alive], first[alive]


def _first_level(length: int, buckets: int):
    def run(group: pa.Table) -> pa.Table:
        block = Block(group, length)
        place, hashes = block.named(block.long_windows(), levels(length)[0])
        place = np.unique(place)
        return _rows(group.column("block")[0].as_py(), _unique_with_more(hashes[place], block.owner[place]).view(_SHORT), buckets)

    return run


def _next_level(length: int, k: int, buckets: int):
    def run(group: pa.Table, back: pa.Table) -> pa.Table:
        if not group.num_rows or not back.num_rows:
            return _rows(-1, np.empty(0, _SHORT), buckets)
        block, sizes, number = Block(group, length), levels(length), group.column("block")[0].as_py()
        starts, first = _alive(block, block.long_windows(), back, sizes[k - 1])
        if k < len(sizes) - 1:
            place, hashes = block.named(starts, sizes[k], first)
            place = np.unique(place)
            return _rows(number, _unique_with_more(hashes[place], block.owner[place]).view(_SHORT), buckets)
        h, g, ids = window_hashes(block.h, length)[starts], window_hashes(block.g, length)[starts], block.ids[block.owner[starts]]
        order, cut = _groups(h, g)
        out = np.empty(len(cut), _LONG)
        if len(cut):
            ids = ids[order]
            out["h"], out["g"], out["low"] = h[order][cut], g[order][cut], np.minimum.reduceat(ids, cut)
            out["more"] = np.maximum.reduceat(ids, cut) > out["low"]
        return _rows(number, out, buckets)

    return run


def covered(block: Block, known: np.ndarray) -> np.ndarray:
    """For each word of a block whether a window over it starts in a document with a smaller doc_id."""
    starts = block.long_windows()
    step = np.zeros(len(block.h) + 1, np.int64)
    if len(known) and len(starts):
        known = known[np.lexsort((known["g"], known["h"]))]
        h, g = window_hashes(block.h, block.length)[starts], window_hashes(block.g, block.length)[starts]
        at, end = np.searchsorted(known["h"], h, "left"), np.searchsorted(known["h"], h, "right")
        low = np.full(len(starts), np.iinfo(np.int64).max)
        while (open_ := at < end).any():  # more than once only where different windows share h
            i = np.flatnonzero(open_)
            same = known["g"][at[i]] == g[i]
            low[i[same]] = known["low"][at[i[same]]]
            at[i] += 1
        hit = starts[low < block.ids[block.owner[starts]]]
        step[hit] += 1
        np.add.at(step, hit + block.length, -1)
    return np.cumsum(step)[:-1] > 0


def _finish(length: int, with_text: bool):
    def run(group: pa.Table, back: pa.Table) -> pa.Table:
        block = Block(group, length)
        gone = covered(block, np.frombuffer(b"".join(back.column("entries").to_pylist()), _KNOWN))
        n_removed, shas, texts, spans = [], [], [], []
        for i, text in enumerate(group.column("text").to_pylist()):
            words, own = (text or "").encode("utf-8").split(), gone[block.at[i] : block.at[i + 1]]
            n_removed.append(int(own.sum()))
            kept = b" ".join(compress(words, (~own).tolist()) if n_removed[-1] else words)
            shas.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept.decode("utf-8") if with_text else None)
            spans.append(np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]]))).tolist() if n_removed[-1] else [])
        out = {"doc_id": group.column("doc_id").cast(pa.int64()), "n_words": pa.array(np.diff(block.at)), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(shas, pa.string()), "spans": pa.array(spans, pa.list_(pa.int64()))}
        if with_text:
            out["kept_text"] = pa.array(texts, pa.string())
        return pa.table(out)

    return run


def remove_repeats(docs: DataFrame, length: int = 13, with_text: bool = True) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_removed, kept_sha256, spans (word places from, to, from, ...), kept_text.

    Words are runs of [^\\x20\\x09-\\x0D]; a word goes if a window of length words over it also starts in a document with
    a smaller doc_id. Windows are judged on the input, not on what is left.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # As many blocks and buckets as the texts fill, however many tasks the cluster has.
    blocks = max(1, -(-(docs.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS))
    buckets = -(-blocks // BLOCKS_A_BUCKET)
    blocked, last = materialize_by_block(with_block(docs, blocks), "block", blocks, "substring_docs"), len(levels(length)) - 1
    sent = blocked.groupBy("block").applyInArrow(_first_level(length, buckets), _SENT)
    for k in range(last + 1):
        back = materialize(sent.groupBy("bucket").applyInArrow(_meet_long if k == last else _meet_short, _BACK), "windows")
        if k == last or back.isEmpty():  # no candidate survives
            break
        sent = blocked.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_next_level(length, k + 1, buckets), _SENT)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<long>" + ", kept_text string" * with_text
    return blocked.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_finish(length, with_text), schema)
