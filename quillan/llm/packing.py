"""Packing documents into training sequences of several permitted lengths.

Variable-capacity best fit, decreasing: each piece goes to the open bin with
the least room that still holds it; when none does, a bin is opened.  The
permitted lengths are weighed together: the opening size is tried at every
permitted length (the least-cost length that holds the piece, but no less
than the tried one), all bins are then downsized to the shortest length that
holds their contents, and the plan with the least total cost is kept.

Documents are dealt into blocks of about ``block`` pieces by a hash of id and
text, so bins depend neither on the files nor on the partitions that the rows
come from; memory is bounded whatever the skew, and every block leaves at most
a few bins open.  Only ids and lengths are shuffled and go through Python.

Cases: texts longer than the largest length are cut into pieces of that
length; null and empty texts have no piece and appear once with a null bin;
repeated rows are packed like any other; empty tables give empty results.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

LENGTHS = (512, 1024, 2048, 4096, 8192)
SCHEMA = "doc_id long, piece int, start long, n_tokens long, bin_id long, bin_length int, bin_used int, slot int, offset int"


def estimated_tokens(text: Column) -> Column:
    """Four UTF-8 bytes a token."""
    return F.ceil(F.octet_length(text) / 4)


def _fit(sizes: np.ndarray, order: np.ndarray, opening: dict[int, int], steps: list[int]) -> tuple[np.ndarray, list[int]]:
    """Bin of each piece, and contents of each bin."""
    bins = np.empty(len(sizes), dtype=np.int64)
    used: list[int] = []
    room: list[tuple[int, int]] = []
    for i in order:
        n = int(sizes[i])
        at = bisect_left(room, (n, -1))
        if at < len(room):
            left, b = room.pop(at)
            left -= n
        else:
            b, left = len(used), opening[steps[bisect_left(steps, n)]] - n
            used.append(0)
        bins[i] = b
        used[b] += n
        if left:
            insort(room, (left, b))
    return bins, used


def pack_block(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS, overhead: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each piece, contents of each bin, final length of each bin).

    A bin of length c costs c + overhead.
    """
    steps = sorted(lengths)
    order = np.argsort(-sizes, kind="stable")
    best = None
    for least in steps:
        opening = {c: max(c, least) for c in steps}
        bins, used = _fit(sizes, order, opening, steps)
        final = np.array(steps)[np.searchsorted(steps, used)] if used else np.zeros(0, np.int64)
        cost = int(final.sum()) + overhead * len(final)
        if best is None or cost < best[0]:
            best = (cost, bins, np.array(used, dtype=np.int64), final)
    return best[1:]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: tuple[int, ...] = LENGTHS, block: int = 32768, overhead: int = 16, tokens=estimated_tokens) -> DataFrame:
    """One row for each piece of a document with its bin, slot and offset there.

    ``bin_id`` is unique: the block's number and a running number.
    """
    top = max(lengths)

    def rows(doc, piece, start, size, base, blk):
        bins, used, final = pack_block(size, lengths, overhead)
        order = np.lexsort((np.arange(len(size)), bins))
        b = bins[order]
        first = np.searchsorted(b, b)
        ends = np.cumsum(size[order])
        offset = ends - size[order] - (ends - size[order])[first]
        columns = [doc.take(pa.array(order)), piece[order].astype(np.int32), start[order], size[order], (blk << 36) + base + b, final[b].astype(np.int32), used[b].astype(np.int32), (np.arange(len(b)) - first).astype(np.int32), offset.astype(np.int32)]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], NAMES), len(used)

    NAMES = ["doc_id", "piece", "start", "n_tokens", "bin_id", "bin_length", "bin_used", "slot", "offset"]

    def run(batches):
        held, count, base, now = [], 0, 0, None
        for b in batches:
            blk = np.asarray(b.column("blk"))
            border = np.flatnonzero(np.concatenate(([True], blk[1:] != blk[:-1]))) if len(blk) else np.zeros(0, np.int64)
            for lo, hi in zip(border, np.append(border[1:], len(blk))):
                if now is not None and now != blk[lo]:
                    yield flush(held, base, now)[0]
                    held, count, base = [], 0, 0
                now = int(blk[lo])
                n = np.asarray(b.column("n"))[lo:hi]
                pieces = -(-n // top)
                row = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                size = np.minimum(top, n[row] - piece * top)
                at = 0
                while at < len(row):
                    to = at + min(block - count, len(row) - at)
                    held.append((b.column("i").take(pa.array(lo + row[at:to])), piece[at:to], piece[at:to] * top, size[at:to]))
                    count, at = count + to - at, to
                    if count >= block:
                        out, opened = flush(held, base, now)
                        held, count, base = [], 0, base + opened
                        yield out
        if held:
            yield flush(held, base, now)[0]

    def flush(held, base, blk):
        if not held:
            return rows(pa.array([], pa.int64()), *[np.zeros(0, np.int64)] * 3, base, blk)
        return rows(pa.concat_arrays([h[0] for h in held]), *[np.concatenate([h[k] for h in held]) for k in (1, 2, 3)], base, blk)

    text = F.col(text_col)
    lengths_of = cut(docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(tokens(text), F.lit(0)).cast("long").alias("n"), F.xxhash64(F.col(id_col), text).alias("h")))
    solid = lengths_of.where("n > 0")
    pieces = solid.agg(F.coalesce(F.sum(F.ceil(F.col("n") / top)), F.lit(0))).first()[0]
    blocks = max(1, -(-pieces // block))
    dealt = solid.withColumn("blk", F.pmod("h", F.lit(blocks))).repartition(blocks, "blk").sortWithinPartitions("blk", "h", "i", "n")
    packed = dealt.select("blk", "i", "n").mapInArrow(run, SCHEMA)
    none = {"doc_id": F.col("i"), "piece": F.lit(0), "start": F.lit(0), "n_tokens": F.col("n")}
    empty = [none.get(f.split()[0], F.lit(None)).cast(f.split()[1]).alias(f.split()[0]) for f in SCHEMA.split(", ")]
    return packed.unionByName(lengths_of.where("n = 0").select(*empty))
