"""Removal of long repeated passages by De Bruijn compaction.

Edges of the graph are token k-mers (``window`` words, hashed); nodes are the
runs of one word less that they share.  Consecutive edges of a document that
share an anchor (the least hash among the ``window - anchor + 1`` anchor-mers
inside an edge, a function of the edge's words alone) form a path, and a path
is the unit that moves.  All occurrences of an edge have the same anchor, so:

1. Anchors are counted; an edge can only repeat if its anchor does.
2. Texts that are equal as a whole are settled by a grouping on their hash.
   Paths with repeated anchors are joined with the first occurrence (document,
   start) of an equal path: repeated paths compact to that source coordinate.
3. An anchor with one path is nonbranching and is done with.  Where an anchor
   has several paths the graph branches; the first occurrences of those paths
   are expanded to edges, and each edge is joined with the source coordinate
   of its own first occurrence.
4. Every path that is not at its own source coordinate repeats as a whole;
   a path at its source repeats in the edges whose source lies elsewhere.

5. Neighbouring paths whose sources are neighbours too compact to one maximal
   run with its source coordinate, however long it is.  (A path at an end of a
   run may have its source in another earlier document with the same words.)

A path or edge is joined with a source only if their anchors agree in one
64-bit hash and all their words in another, independent one; the coordinates
decide which occurrence is first.  Texts are shuffled once, by
document.  Frequent paths and anchors are pre-aggregated before any shuffle;
occurrences within a document are settled in place.

Cases: a null text has no words; documents shorter than the window lose
nothing; rows that repeat an id with the same text are one document, reported
for each row; rows that repeat an id with other texts follow each other by
text hash; a null id comes last; empty tables give empty results; other
columns of the input are ignored.
"""

from __future__ import annotations

from functools import cached_property
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillan.operators.numbering import numbered

from .common import cut, shared_dir
from .textkernel import mix64, ngram_hashes, run_starts, slices


class Paths:
    """The paths of a slice: row, first word (in the slice), number of edges, anchor.

    Anchors come from one hash of each word; ``edges`` and ``content``, made
    when asked for, from an independent one.
    """

    def __init__(self, words, window: int, anchor: int):
        self.words, self.window = words, window
        ok = run_starts(words, window)
        value = ngram_hashes(words.hashes(), anchor)
        at = np.arange(len(value))
        # Leftmost least anchor among window - anchor + 1 places, by doubling.
        width, span = 1, window - anchor + 1
        while width < span:
            step = min(width, span - width)
            m = max(0, len(value) - step)
            left = value[:m] <= value[step:]
            at = np.where(left, at[:m], at[step:])
            value = np.where(left, value[:m], value[step:])
            width += step
        n = len(ok)
        at, value = at[:n], value[:n]
        start = ok.copy()
        if n:
            start[1:] &= ~ok[:-1] | (at[1:] != at[:-1])
        self.start = np.flatnonzero(start)
        run = np.cumsum(start) - 1
        self.size = np.bincount(run[ok], minlength=len(self.start)) if len(self.start) else np.zeros(0, np.int64)
        self.anchor = value[self.start]
        self.row = words.rows()[self.start] if len(self.start) else np.zeros(0, np.int64)

    @cached_property
    def edges(self) -> np.ndarray:
        """A hash of each run of ``window`` words of the slice."""
        return ngram_hashes(self.words.hashes(1), self.window)

    @cached_property
    def content(self) -> np.ndarray:
        """A hash of each path's words: its first and last edge and their distance hold all of them."""
        last = self.start + self.size - 1
        with np.errstate(over="ignore"):
            return mix64(self.edges[self.start] * np.uint64(0x9FB21C651E98DF25) + (self.edges[last] ^ self.size.astype(np.uint64)))

    def local(self) -> np.ndarray:
        """First word of each path counted from its row's first word."""
        return self.start - self.words.row_first[self.row]

    def first_here(self) -> np.ndarray:
        """For each path the first with its words in its row."""
        order = np.lexsort((self.start, self.content, self.anchor, self.row))
        new = np.ones(len(order), dtype=bool)
        if len(order):
            a, c, r = self.anchor[order], self.content[order], self.row[order]
            new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1]) | (r[1:] != r[:-1])
        first = np.empty(len(order), dtype=np.int64)
        first[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
        return first

    def with_anchors(self, listed: pa.Array, first_row: int, rows: int) -> np.ndarray:
        """Mask of the paths whose anchor is in their row's list."""
        lists = listed.slice(first_row, rows)
        size = np.diff(np.asarray(lists.offsets))
        size = np.where(np.asarray(lists.is_valid()), size, 0)
        values = np.asarray(lists.flatten()).view(np.uint64)
        row = np.repeat(np.arange(rows), size)
        both = np.concatenate((self.row, row))
        keys = np.concatenate((self.anchor, values))
        order = np.lexsort((keys, both))
        new = np.ones(len(order), dtype=bool)
        if len(order):
            b, k = both[order], keys[order]
            new[1:] = (b[1:] != b[:-1]) | (k[1:] != k[:-1])
        group = np.empty(len(order), dtype=np.int64)
        group[order] = np.cumsum(new) - 1
        known = np.zeros(int(new.sum()), dtype=bool)
        known[group[len(self.row) :]] = True
        return known[group[: len(self.row)]]


def _array(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, t) where ids are unique, d being the id; else (d, doc_id, t) where d numbers the documents in order."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    n, ids, distinct = rows.agg(F.count(F.lit(1)), F.count("doc_id"), F.count_distinct("doc_id")).first()
    if n == distinct:
        # No id is null here; the condition makes every use read the texts alike, so that all share one exchange.
        return rows.select(F.col("doc_id").alias("d"), "t").where("d is not null")
    rows = rows.withColumn("th", F.xxhash64("t", F.hash("t")))
    shared_dir(docs.sparkSession)
    names = numbered(rows.select(F.col("doc_id").alias("i"), F.col("th").alias("h")).distinct().orderBy(F.asc_nulls_last("i"), "h"), "d")
    return rows.join(names, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("h"))).select("d", "doc_id", "t")


def maximal(row: np.ndarray, s: np.ndarray, n: np.ndarray, f: np.ndarray, o: np.ndarray, window: int):
    """Runs of repeated paths whose sources follow each other too, as (row, start, end, source, source start) in words.

    Paths have ``n`` edges from word ``s`` on and equal those from word ``o`` of document ``f``.
    """
    order = np.lexsort((s, row))
    row, s, n, f, o = (x[order] for x in (row, s, n, f, o))
    new = np.ones(len(s), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (s[1:] > s[:-1] + n[:-1]) | (f[1:] != f[:-1]) | (o[1:] - s[1:] != o[:-1] - s[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(s))[: len(first)] - 1
    return row[first], s[first], s[last] + n[last] + window - 1, f[first], o[first]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, anchor: int = 5) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, repeats, kept) for each row.

    ``spans`` are the removed word ranges (start, end), ``kept`` is the text of
    the other words, joined by one space.  ``repeats`` are the compacted paths:
    the longest runs (start, end, source, source_start) whose words are also
    those from word ``source_start`` of the document ``source`` on; where ids
    repeat, ``source`` is the document's number in the order of (id, text hash).
    """
    docs = _keyed(docs, id_col, text_col)
    texts = docs.select("d", "t")

    def count(batches):
        for b in batches:
            seen = [Paths(w, window, anchor).anchor for _, _, w in slices(b.column("t"))]
            a, n = np.unique(np.concatenate([*seen, np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([_array(a), pa.array(n)], ["a", "n"])

    def name(batches):
        for b in batches:
            for at, _, w in slices(b.column("t")):
                p = Paths(w, window, anchor)
                order = np.lexsort((p.anchor, p.row))
                a, r = p.anchor[order], p.row[order]
                new = np.ones(len(a), dtype=bool)
                if len(a):
                    new[1:] = (a[1:] != a[:-1]) | (r[1:] != r[:-1])
                yield pa.RecordBatch.from_arrays([_array(a[new]), b.column("d").take(pa.array(r[new] + at))], ["a", "d"])

    solid = texts.where("t is not null")
    repeated = solid.select("t").mapInArrow(count, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).where("n > 1").select("a")
    # Copies of whole texts repeat throughout; only the first of them takes part in what follows.
    digests = solid.select("d", F.xxhash64("t").alias("h1"), F.xxhash64(F.lit("copy"), "t").alias("h2"))
    # Written first, so that the join with a large group of copies can be split.
    copied = cut(digests.groupBy("h1", "h2").agg(F.min("d").alias("first"), F.max("d").alias("last")).where("first <> last").select("h1", "h2", "first"))
    copies = digests.join(copied, ["h1", "h2"]).where("d <> first").select("d", F.col("first").alias("copy")).distinct()
    named = solid.mapInArrow(name, "a long, d long").join(repeated, "a", "left_semi")
    listed = named.groupBy("d").agg(F.collect_list("a").alias("anchors")).join(copies, "d", "left")
    whole = texts.join(listed, "d", "left")

    def emit_paths(batches):
        for b in batches:
            for at, to, w in slices(b.column("t")):
                p = Paths(w, window, anchor)
                k = np.flatnonzero(p.with_anchors(b.column("anchors"), at, to - at) & (p.first_here() == np.arange(len(p.start))))
                yield pa.RecordBatch.from_arrays([_array(p.anchor[k]), _array(p.content[k]), b.column("d").take(pa.array(p.row[k] + at)), pa.array(p.local()[k].astype(np.int32)), pa.array(p.size[k].astype(np.int32))], ["a", "c", "d", "s", "n"])

    paths = whole.where("anchors is not null and copy is null").mapInArrow(emit_paths, "a long, c long, d long, s int, n int").where("a is not null and c is not null and d is not null")
    # These conditions are always true; they make each use read the same columns and rows, so that all share one exchange.
    source = paths.groupBy("a", "c").agg(F.min(F.struct("d", "s")).alias("src"), F.count(F.lit(1)).alias("times")).where("times > 0 and src is not null")

    # Branching anchors: their paths' first occurrences are expanded to edges.
    branching = source.groupBy("a").count().where("count > 1").select("a")
    asked = source.join(branching, "a", "left_semi").groupBy(F.col("src.d").alias("d")).agg(F.collect_list("src.s").alias("starts"))

    def emit_edges(batches):
        for b in batches:
            for at, to, w in slices(b.column("t")):
                p = Paths(w, window, anchor)
                lists = b.column("starts").slice(at, to - at)
                row = np.repeat(np.arange(to - at), np.diff(np.asarray(lists.offsets)))
                want = np.asarray(lists.flatten()).astype(np.int64) + w.row_first[row]
                k = np.searchsorted(p.start, np.sort(want))
                size = p.size[k]
                each = np.repeat(k, size)
                step = np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size)
                yield pa.RecordBatch.from_arrays([_array(p.anchor[each]), _array(p.edges[p.start[each] + step]), b.column("d").take(pa.array(p.row[each] + at)), pa.array((p.local()[each] + step).astype(np.int32))], ["a", "g", "d", "s"])

    edges = texts.join(asked, "d").mapInArrow(emit_edges, "a long, g long, d long, s int")
    # One row for each distinct path and edge: an edge's rows are at most its distinct neighbourhoods.
    edge_source = edges.groupBy("a", "g").agg(F.min(F.struct("d", "s")).alias("src"), F.count(F.lit(1)).alias("times")).where("times > 1")
    again = edges.join(edge_source, ["a", "g"]).where(F.struct("d", "s") != F.col("src")).select("d", "s", F.lit(1).alias("n"), "src")
    marks = paths.join(source.where("times > 1").select("a", "c", "src"), ["a", "c"]).where(F.struct("d", "s") != F.col("src")).select("d", "s", "n", "src")
    marks = marks.unionByName(again).groupBy("d").agg(F.collect_list(F.struct("s", "n", F.col("src.d").alias("f"), F.col("src.s").alias("o"))).alias("marks"))

    def finish(batches):
        for b in batches:
            n_words, n_removed, spans, repeats, kept = [], [], [], [], []
            for at, to, w in slices(b.column("t")):
                p = Paths(w, window, anchor)
                gone = np.zeros(len(w) + 1, dtype=np.int64)
                held, first = p.with_anchors(b.column("anchors"), at, to - at), p.first_here()
                again = np.flatnonzero(held & (first != np.arange(len(first))))
                np.add.at(gone, p.start[again], 1)
                np.add.at(gone, p.start[again] + p.size[again] + window - 1, -1)
                number = np.asarray(b.column("d").fill_null(-1))[at:to]
                local = p.local()
                runs = [(p.row[again], local[again], p.size[again], number[p.row[again]], local[first[again]])]
                lists = b.column("marks").slice(at, to - at)
                size = np.where(np.asarray(lists.is_valid()), np.diff(np.asarray(lists.offsets)), 0)
                flat = lists.flatten()
                if len(flat):
                    row = np.repeat(np.arange(to - at), size)
                    s, n, f, o = (np.asarray(flat.field(c)).astype(np.int64) for c in ("s", "n", "f", "o"))
                    np.add.at(gone, s + w.row_first[row], 1)
                    np.add.at(gone, s + w.row_first[row] + n + window - 1, -1)
                    runs.append((row, s, n, f, o))
                counts = w.counts()
                source = b.column("copy").slice(at, to - at)
                copy = np.asarray(source.is_valid()) & (counts >= window)
                whole = np.flatnonzero(copy)
                runs = [tuple(x[~copy[r[0]]] for x in r) for r in runs]
                runs.append((whole, np.zeros(len(whole), np.int64), counts[whole] - window + 1, np.asarray(source.fill_null(-1))[whole], np.zeros(len(whole), np.int64)))
                found = maximal(*[np.concatenate(x) for x in zip(*runs)], window)
                border = np.searchsorted(found[0], np.arange(to - at + 1)).astype(np.int32)
                repeats.append(pa.ListArray.from_arrays(pa.array(border), pa.StructArray.from_arrays([pa.array(found[1].astype(np.int32)), pa.array(found[2].astype(np.int32)), pa.array(found[3]), pa.array(found[4].astype(np.int32))], ["start", "end", "source", "source_start"])))
                stay = (np.cumsum(gone[:-1]) == 0) & ~np.repeat(copy, counts)
                n_words.append(counts)
                lost = np.concatenate(([0], np.cumsum(~stay)))[w.row_first]
                n_removed.append(np.diff(lost))
                for r in range(to - at):
                    own = stay[w.row_first[r] : w.row_first[r + 1]]
                    tokens = w.data[w.offsets[r] : w.offsets[r + 1]].tobytes().split()
                    if n_removed[-1][r]:
                        edge = np.flatnonzero(np.diff(np.concatenate(([0], ~own, [0]))))
                        spans.append([{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2])])
                        tokens = compress(tokens, own.tolist())
                    else:
                        spans.append([])
                    kept.append(b" ".join(tokens).decode("utf-8", "replace"))
            cat = lambda x: pa.array(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            if repeats:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), cat(n_words), cat(n_removed), pa.array(spans, kind), pa.concat_arrays(repeats), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "spans", "repeats", "kept"])

    last = docs.join(listed, "d", "left").join(marks, "d", "left")
    last = last.select(F.col("doc_id" if "doc_id" in docs.columns else "d").alias("doc_id"), "d", "t", "anchors", "copy", "marks")
    return last.mapInArrow(finish, "doc_id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, repeats array<struct<start:int,end:int,source:long,source_start:int>>, kept string")
