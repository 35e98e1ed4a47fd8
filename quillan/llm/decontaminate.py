"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are lower-cased (A-Z) runs between whitespace and ASCII punctuation.
Every run of ``seed`` words of a test item is a seed (an item with fewer
words is one seed as a whole).  No seed is dropped for being frequent, so an
edited or partial copy is found however often it occurs.

One pass joins passages to items on seeds (a hash join whose build side is
the benchmark) and aligns the passage around each seed with the item (match 2,
mismatch -1, gap -1).  The score is the alignment's share of the item's own
score, and pairs at ``threshold`` or more are contaminated.  An alignment
scores at most ``MATCH`` for each word of the item that the passage holds, so
passages with too few of them, as around stock phrases, are not aligned.

The build side is broadcast in blocks of at most ``block_bytes`` of items'
texts, one pass for each block, so its size has a fixed bound; the corpus
itself is never shuffled.  A task holds at most ``HITS`` seed matches and
``CELLS`` places of score matrices at a time (or one pair); aligning an item of
n words takes time in proportion to n squared.

Cases: null or empty texts match nothing; items without words are left out;
repeated rows and ids are each reported; empty tables give empty results;
other columns of the input are ignored, or kept by ``clean``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import HashSet, Words, mix64, ngram_hashes, run_starts, slices

MATCH, MISS, GAP = 2, -1, -1
#: places of a score matrix's rows, and pairs of a seed occurrence and an item, that are held at a time
CELLS, HITS = 1 << 20, 1 << 20


def align(passages: np.ndarray, items: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best local score, passage position after it) for rows of word hashes.

    ``items`` is padded beyond ``lengths``; passages are padded with zeros.
    One row of the score matrix is done at once over all pairs: the gap along
    the passage is a running maximum.
    """
    n, width = passages.shape
    slope = np.arange(width + 1, dtype=np.int32) * -GAP
    row = np.zeros((n, width + 1), dtype=np.int32)
    best, end = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int64)
    for i in range(items.shape[1]):
        live = (i < lengths)[:, None]
        step = np.where((passages == items[:, i : i + 1]) & (passages != 0), MATCH, MISS)
        new = np.zeros_like(row)
        new[:, 1:] = np.maximum(row[:, :-1] + step, row[:, 1:] + GAP)
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new + slope, axis=1) - slope
        row = np.where(live, np.maximum(new, 0), 0)
        at = row.argmax(1)
        top = row[np.arange(n), at]
        better = top > best
        best[better], end[better] = top[better], at[better]
    return best, end


class Index:
    """A block of test items: word hashes, and seeds with where they occur."""

    def __init__(self, ids: pa.Array, texts: pa.Array, seed: int):
        self.ids, self.seed = ids, seed
        words, counts = [], []
        for _, _, w in slices(texts, lower=True, punct=True):
            words.append(w.hashes())
            counts.append(w.counts())
        self.words = np.concatenate([*words, np.zeros(0, np.uint64)])
        self.size = np.concatenate([*counts, np.zeros(0, np.int64)]).astype(np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.pad = np.maximum(4, self.size // 4)
        found = []
        for i in np.flatnonzero(self.size):
            n = int(min(seed, self.size[i]))
            h = ngram_hashes(self.words[self.first[i] : self.first[i] + self.size[i]], n)
            found.append((h, np.full(len(h), n), np.full(len(h), i), np.arange(len(h))))
        cols = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.uint64)] + [np.zeros(0, np.int64)] * 3
        order = np.argsort(cols[0], kind="stable")
        self.hash, self.length, self.item, self.at = (c[order] for c in cols)

    def sets(self) -> dict[int, HashSet]:
        return {int(n): HashSet(self.hash[self.length == n]) for n in np.unique(self.length)}


def _seed_hits(words: Words, h: np.ndarray, sets: dict[int, HashSet]):
    """(seed hash, row, word position in the slice) of each seed in the slice."""
    rows = words.rows()
    for n, known in sets.items():
        g = ngram_hashes(h, n)
        own = run_starts(words, n)
        at, which = known.find(g)
        ok = own[at]
        yield known.values[which[ok]], rows[at[ok]], at[ok]


def possible(passages: np.ndarray, items: np.ndarray, lengths: np.ndarray, threshold: float) -> np.ndarray:
    """Mask of the pairs whose passage holds enough of the item's words to score ``threshold``."""
    pair = mix64(np.arange(1, len(items) + 1, dtype=np.uint64))[:, None]
    shared = np.isin(mix64(items ^ pair), mix64(passages ^ pair)) & (np.arange(items.shape[1]) < lengths[:, None])
    return MATCH * shared.sum(1) / (MATCH * lengths) >= threshold


def _lanes(words: Words, index: Index, seed: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Distinct (row, item, lane) of seed occurrences; a lane is a band of diagonals."""
    lo, hi = np.searchsorted(index.hash, seed, "left"), np.searchsorted(index.hash, seed, "right")
    n = hi - lo
    which = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    item = index.item[which]
    lane = (np.repeat(at, n) - index.at[which]) // (index.pad[item] + 1)
    return np.unique(np.stack([np.repeat(row, n), item, lane], 1), axis=0)


def _score(words: Words, h: np.ndarray, index: Index, found: np.ndarray, threshold: float):
    """(row, item, score, first word, word after) of those (row, item, lane) that reach the threshold."""
    row, item, lane = found.T
    pad, size = index.pad[item], index.size[item]
    first = np.maximum(lane * (pad + 1) - pad, words.row_first[row])
    last = np.minimum((lane + 1) * (pad + 1) + size + pad, words.row_first[row + 1])
    score, end = np.zeros(len(row)), np.zeros(len(row), np.int64)
    order = np.argsort(np.maximum(last - first, size), kind="stable")
    wide = np.maximum(last - first, size)[order]
    b = 0
    while b < len(order):
        # As many pairs as stay within CELLS when each is as wide as the last one.
        upto = b + max(1, int(np.searchsorted(-(CELLS // np.maximum(1, wide[b:])) + np.arange(len(wide) - b), 0)))
        k, b = order[b:upto], upto
        span = np.arange(max(1, (last[k] - first[k]).max()))
        inside = first[k][:, None] + span < last[k][:, None]
        passages = np.where(inside, h[np.minimum(first[k][:, None] + span, len(h) - 1)], np.uint64(0))
        depth = np.arange(size[k].max())
        items = index.words[np.minimum(index.first[item[k]][:, None] + depth, len(index.words) - 1)]
        able = possible(passages, items, size[k], threshold)
        k = k[able]
        if len(k):
            best, end[k] = align(passages[able], items[able], size[k])
            score[k] = best / (MATCH * size[k])
    keep = np.flatnonzero(score >= threshold)
    return row[keep], item[keep], score[keep], first[keep], first[keep] + end[keep]


def find(words: Words, index: Index, sets: dict[int, HashSet], threshold: float):
    """(row, item, score, first word, word after) of each contaminated pair of the slice, at its best passage.

    Seed occurrences are taken in parts of at most about ``HITS`` pairs with items, which bounds memory.
    """
    h = words.hashes()
    nothing = [np.zeros(0, np.int64)] * 5
    hits = [np.concatenate(x) for x in zip(*_seed_hits(words, h, sets))] if sets else nothing
    if not len(hits[0]):
        return nothing
    order = np.argsort(hits[1], kind="stable")
    seed, row, at = (x[order] for x in hits)
    pairs = np.cumsum(np.searchsorted(index.hash, seed, "right") - np.searchsorted(index.hash, seed, "left"))
    parts, low = [], 0
    while low < len(seed):
        high = max(low + 1, int(np.searchsorted(pairs, (pairs[low - 1] if low else 0) + HITS, "right")))
        parts.append(_score(words, h, index, _lanes(words, index, seed[low:high], row[low:high], at[low:high]), threshold))
        low = high
    row, item, score, first, last = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((first, -score, item, row))
    pair = np.stack([row[order], item[order]], 1)
    keep = order[np.concatenate(([True], (pair[1:] != pair[:-1]).any(1)))] if len(order) else order
    base = words.row_first[row[keep]]
    return row[keep], item[keep], score[keep], first[keep] - base, last[keep] - base


def _blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """(ids, texts) in blocks of at most ``block_bytes`` of text, or one longer text."""
    rows = items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("t is not null")
    total = rows.select(F.sum(F.octet_length("t"))).first()[0] or 0
    # Parts are of about half that size, and cut again where the hash makes one larger.
    parts = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    for b in range(parts):
        own = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == b)
        got = own.toArrow().combine_chunks()
        size = np.cumsum(np.asarray(pc.binary_length(got["t"]).combine_chunks())) if got.num_rows else np.zeros(0, np.int64)
        at = 0
        while at < got.num_rows:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + block_bytes, "right")))
            yield got["i"].slice(at, to - at).combine_chunks(), got["t"].slice(at, to - at).combine_chunks()
            at = to


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", seed: int = 4, threshold: float = 0.5, block_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, item_id, score, word_start, word_end): contaminated pairs; the words bound the aligned passage."""
    schema = "doc_id long, item_id long, score double, word_start long, word_end long"
    source = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    out = None
    for ids, texts in _blocks(items, item_col, item_text, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(Index(ids, texts, seed))

        def run(batches, shared=shared):
            index, sets = shared.value, shared.value.sets()
            for b in batches:
                for at, _, w in slices(b.column("t"), lower=True, punct=True):
                    row, item, score, start, end = find(w, index, sets, threshold)
                    if len(row):
                        yield pa.RecordBatch.from_arrays([b.column("i").take(pa.array(row + at)), index.ids.take(pa.array(item)), pa.array(score), pa.array(start), pa.array(end)], ["doc_id", "item_id", "score", "word_start", "word_end"])

        part = source.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", seed: int = 4, threshold: float = 0.5, block_bytes: int = 16 << 20) -> DataFrame:
    """The rows of docs that match no test item, with all their columns."""
    out = docs
    for ids, texts in _blocks(items, item_col, item_text, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(Index(ids, texts, seed))

        def run(batches, shared=shared):
            index, sets = shared.value, shared.value.sets()
            for b in batches:
                keep = np.ones(b.num_rows, dtype=bool)
                for at, _, w in slices(b.column(text_col), lower=True, punct=True):
                    keep[find(w, index, sets, threshold)[0] + at] = False
                yield b.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
