"""MinHash near-duplicates with an LSH forest.

A document's set holds its distinct ``shingle``-word shingles (A-Z lowered);
documents whose sets have a Jaccard similarity of at least
``percent``/100 are linked, and the classes are the connected components.

1. Equal sets collapse to the smallest id (a grouping by a 128-bit set hash).
2. Each remaining set gets ``trees`` signatures of ``depth`` minhash digits.
   A tree is the sorted order of its signatures; rows that share the first
   ``least`` digits form a region.  A region descends, digit by digit, until
   at most ``leaf`` rows share a prefix: all of those are compared.  Rows that
   stay in larger runs at full depth, or end up alone, are compared with their
   ``reach`` longest-common-prefix neighbours in the region on either side.
   Those rounds only link early what is easily found: at the end every pair of
   a region of more than ``leaf`` rows that is not linked yet is compared.
3. Candidates whose 128-bit sketch rules out the similarity (six standard
   deviations) are dropped; the rest is confirmed on full sets, and confirmed
   links are merged into components with star contractions.
4. Rounds: two trees with adjacent neighbours first, then more trees, then
   all; pairs inside one component or already tested are not tested again, so
   a large group of copies costs about one test a document and a round.
5. The rest: each region of more than ``leaf`` rows in several components is
   cut into blocks of at most about ``BLOCK`` rows and ``BLOCK_SHINGLES``
   shingles, and pairs of blocks are compared, so that every pair of the region
   in two components is.  Rows of the region's largest component meet only the
   rows outside it.  A pair is taken in the first tree where it shares a region.
   Digits and sketch rule pairs out, and so do shingles that no other row of
   these regions has: a link needs ``percent/(100 + percent)`` of both sizes in
   common.  What is left is confirmed where the blocks meet, on full sets, and
   only links that join two components are written; pairs are not.

A pair at the limit similarity is missed by all trees with a probability of
``(1 - s ** least) ** trees`` (2e-8 at 0.85), whatever the size of its regions.
No group is held by one task: trees are range-partitioned by signature and
read as streams, and regions are compared by pairs of blocks.

Cases: null, empty and wordless texts have an empty set and are linked with
nothing; fewer words than the shingle length make one shingle; repeated rows
and ids are the same document with each row reported; a null id takes no
part in links and is kept; empty tables give empty results; other columns of
the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BitFilter, cut, hits
from .textkernel import constants, mix64, ngram_hashes, slices

TREES, DEPTH, SKETCH = 24, 8, 128


ROWS_PER_TASK = 50_000


def few(thin: DataFrame, rows: int) -> DataFrame:
    """A thin table of about that many rows in no more tasks than it needs; each exchange leaves files by task."""
    return thin.coalesce(rows // ROWS_PER_TASK + 1)


def shingle_sets(column: pa.Array, n: int):
    """(row, sorted distinct shingle hashes of all rows, first position of each row, words of each row) over slices."""
    for at, to, w in slices(column, lower=True):
        h, counts, rows = w.hashes(), w.counts(), w.rows()
        g = ngram_hashes(h, n)
        ok = rows[: len(g)] == rows[n - 1 :] if len(g) else np.zeros(0, bool)
        hashes, owner = [g[ok]], [rows[: len(g)][ok]]
        for size in range(1, n):
            short = np.flatnonzero(counts == size)
            if len(short):
                hashes.append(ngram_hashes(h, size)[w.row_first[short]])
                owner.append(short)
        hashes, owner = np.concatenate(hashes), np.concatenate(owner)
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        new = np.ones(len(hashes), dtype=bool)
        if len(hashes):
            new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        hashes, owner = hashes[new], owner[new]
        yield at, to, hashes, np.searchsorted(owner, np.arange(to - at + 1))


_MULT = constants(TREES * DEPTH // 2 + SKETCH // 2, 77)


def minhashes(values: np.ndarray) -> np.ndarray:
    """Two 32-bit minhash values from each multiplier."""
    low = np.full(len(_MULT), 2**32 - 1, dtype=np.uint64)
    high = low.copy()
    step = max(1, 400_000 // len(_MULT))
    with np.errstate(over="ignore"):
        for at in range(0, len(values), step):
            x = _MULT[:, None] * values[None, at : at + step]
            np.minimum(high, (x >> np.uint64(32)).min(1), out=high)
            np.minimum(low, x.astype(np.uint32).min(1), out=low)
    return np.concatenate((high, low))


def signature(values: np.ndarray) -> bytes:
    """TREES x DEPTH digits of 16 bits, then the sketch: the lowest bit of SKETCH further minhashes."""
    m = mix64(minhashes(values))
    digits = (m[: TREES * DEPTH] & np.uint64(0xFFFF)).astype("<u2").tobytes()
    return digits + np.packbits((m[TREES * DEPTH :] & np.uint64(1)).astype(np.uint8)).tobytes()


def _summaries(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, n, k1, k2): size and hashes of each row's set."""

    def run(batches):
        for b in batches:
            for at, to, hashes, first in shingle_sets(b.column("t"), shingle):
                n = np.diff(first)
                keys = []
                for salt in (1, 2):
                    with np.errstate(over="ignore"):
                        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(hashes + np.uint64(salt)), dtype=np.uint64)))
                        keys.append(mix64(total[first[1:]] - total[first[:-1]] + n.astype(np.uint64)).view(np.int64))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, to - at), pa.array(n), *[pa.array(k) for k in keys]], ["doc_id", "n", "k1", "k2"])

    return docs.mapInArrow(run, "doc_id long, n long, k1 long, k2 long")


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, set): the sorted shingle hashes of the wanted documents.

    A filter of fixed size goes to the executors first, so that most texts
    that are not wanted are passed over before the join.
    """
    known = BitFilter(wanted, "xxhash64(doc_id)", wanted.count())
    shared = known.shared

    def run(batches):
        for b in batches:
            b = b.filter(pa.array(hits(shared, b.column("b"))))
            for at, to, hashes, first in shingle_sets(b.column("t"), shingle):
                raw, offsets = hashes.astype("<u8").tobytes(), (first * 8).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, to - at), packed], ["doc_id", "set"])

    hashed = docs.where("t is not null").withColumn("b", F.expr(known.slot("xxhash64(doc_id)")))
    return hashed.mapInArrow(run, "doc_id long, set binary").join(wanted, "doc_id", "left_semi")


def _rows(forest: DataFrame, labels: DataFrame, trees: int, least: int) -> DataFrame:
    """(region, deep, doc_id, label, s1, s2): one row for each document and tree, the signature cut into sortable parts."""
    long_at = lambda at, n: f"cast(conv(hex(substring(sig, {at} + 1, {n})), 16, -10) as long)"
    whole = forest.join(labels, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    base = TREES * DEPTH * 2
    whole = whole.select("doc_id", "label", "sig", F.expr(long_at(base, 8)).alias("s1"), F.expr(long_at(base + 8, 8)).alias("s2"), F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    return whole.select(
        F.expr(f"xxhash64(tree, substring(sig, tree * {DEPTH * 2} + 1, {least * 2}))").alias("region"),
        F.expr(f"substring(sig, tree * {DEPTH * 2} + {least * 2} + 1, {(DEPTH - least) * 2})").alias("deep"),
        "doc_id", "label", "s1", "s2",
    )


def _neighbours(rows: DataFrame, leaf: int, reach: int, floor: int) -> DataFrame:
    """(u, v): candidate pairs of the sorted rows, u < v.

    Each partition reads its rows as a stream and keeps one region's window;
    rows that a partition border cuts apart meet through ``edge`` rows: the
    first and last rows of each partition, read again in a second small pass.
    """

    def pairs(region, deep, ids, label, s1, s2):
        n = len(ids)
        out = []
        # Common prefix with the next row, in digits beyond the region's; -1 across regions.
        same = region[1:] == region[:-1]
        digits = deep[1:] == deep[:-1]
        common = np.where(same, np.cumprod(digits, axis=1).sum(1), -1)
        depth = deep.shape[1]
        done = np.zeros(n, dtype=bool)
        near = np.zeros(n, dtype=bool)
        for d in range(depth + 1):
            run = np.concatenate(([0], np.cumsum(common < d)))
            size = np.bincount(run)[run]
            if d == 0:
                near = size > 1
            small = ~done & (size <= leaf) & (size > 1)
            near &= ~small
            if small.any():
                for step in range(1, leaf):
                    a = np.flatnonzero(small[: n - step] & small[step:]) if n > step else np.zeros(0, np.int64)
                    a = a[run[a] == run[a + step]]
                    out.append((a, a + step))
            done |= size <= leaf
        if near.any():
            run = np.concatenate(([0], np.cumsum(common < 0)))
            for step in range(1, reach + 1):
                a = np.flatnonzero((near[: n - step] | near[step:]) & (run[: n - step] == run[step:])) if n > step else np.zeros(0, np.int64)
                out.append((a, a + step))
        if not out:
            return np.zeros((2, 0), np.int64)
        a, b = (np.concatenate(x) for x in zip(*out))
        keep = (label[a] != label[b]) & (ids[a] != ids[b])
        a, b = a[keep], b[keep]
        differ = np.bitwise_count(s1[a] ^ s1[b]) + np.bitwise_count(s2[a] ^ s2[b])
        keep = SKETCH - differ.astype(np.int64) >= floor
        a, b = ids[a[keep]], ids[b[keep]]
        return np.unique(np.stack((np.minimum(a, b), np.maximum(a, b))), axis=1)

    def columns(batch):
        raw = np.frombuffer(b"".join(batch.column("deep").to_pylist()), dtype=">u2")
        deep = raw.reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1), np.uint16)
        get = lambda c: np.asarray(batch.column(c))
        return [get("region"), deep, get("doc_id"), get("label"), get("s1").view(np.uint64), get("s2").view(np.uint64)]

    def batch_of(cols, uv, edge):
        region, deep, ids, label, s1, s2 = cols
        n, m = uv.shape[1], len(edge)
        blank = lambda k: pa.nulls(k, pa.int64())
        part = lambda x: pa.concat_arrays([blank(n), pa.array(x[edge])])
        digits = pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array([deep[i].astype(">u2").tobytes() for i in edge], pa.binary())])
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays([pa.array(uv[0]), blank(m)]), pa.concat_arrays([pa.array(uv[1]), blank(m)]), part(region), digits, part(ids), part(label), part(s1.view(np.int64)), part(s2.view(np.int64))],
            ["u", "v", "region", "deep", "doc_id", "label", "s1", "s2"],
        )

    keep_back = max(leaf, reach)

    def scan(batches, border):
        held, first = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = columns(batch)
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            n = len(cols[0])
            edge = np.arange(min(n, keep_back)) if first and border else np.zeros(0, np.int64)
            yield batch_of(cols, pairs(*cols), edge)
            # What a later row may still meet: the last rows, as many as a leaf has.
            held, first = [x[-keep_back:] for x in cols], False
        if held is not None and border:
            yield batch_of(held, np.zeros((2, 0), np.int64), np.arange(len(held[0])))

    schema = "u long, v long, region long, deep binary, doc_id long, label long, s1 long, s2 long"
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["region", "deep", "doc_id"]
    found = cut(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(lambda it: scan(it, True), schema))
    # At most 2 * keep_back rows of each partition.
    total = found.count()
    edges = few(few(found.where("u is null"), total).select(*order, "label", "s1", "s2").distinct().repartition(n, "region"), total).sortWithinPartitions(*order)
    across = edges.mapInArrow(lambda it: scan(it, False), schema).select("u", "v")
    return few(few(found.where("u is not null"), total).select("u", "v").unionByName(across).distinct(), total)


def _wide(rows: DataFrame, least_rows: int) -> DataFrame:
    """(region, major, mine, others): regions of at least that many rows in several components, with the numbers of blocks."""
    parts = rows.groupBy("region", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    sizes = parts.groupBy("region").agg(
        F.sum("c").alias("rows"), F.sum("s").alias("all"), F.count(F.lit(1)).alias("labels"),
        F.max_by(F.struct("label", "c", "s"), F.struct("c", "label")).alias("top"),
    )
    blocks = lambda c, s: F.ceil(F.greatest(c / BLOCK, s / BLOCK_SHINGLES))
    mine, others = blocks(F.col("top.c"), F.col("top.s")), blocks(F.col("rows") - F.col("top.c"), F.col("all") - F.col("top.s"))
    return sizes.where((F.col("rows") >= least_rows) & (F.col("labels") > 1)).select("region", F.col("top.label").alias("major"), mine.alias("mine"), others.alias("others"))


def _own(sets: DataFrame) -> DataFrame:
    """(doc_id, own): how many of a set's shingles are in no other of the sets."""

    def run(batches):
        for b in batches:
            size = np.asarray(pc.binary_length(b.column("set"))).astype(np.int64) // 8
            flat = np.frombuffer(b"".join(b.column("set").to_pylist()), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(np.asarray(b.column("doc_id")), size))], ["h", "doc_id"])

    single = sets.select("doc_id", "set").mapInArrow(run, "h long, doc_id long").groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("doc_id").alias("doc_id")).where("c = 1")
    return single.groupBy("doc_id").agg(F.count(F.lit(1)).alias("own"))


class _Cell:
    """Two blocks of a region (or one with itself): which pairs of rows may be similar enough."""

    def __init__(self, cell: pa.Table, least: int, percent: int, floor: int, digit_floor: int):
        get = lambda c: np.asarray(cell[c].combine_chunks())
        self.ids, self.label, self.side, self.n, self.shared = (get(c) for c in ("doc_id", "label", "side", "n", "shared"))
        raw = np.frombuffer(b"".join(cell["sig"].to_pylist()), np.uint8).reshape(len(self.ids), -1)
        self.digits = raw[:, : TREES * DEPTH * 2].copy().view("<u2")
        self.sketch = raw[:, TREES * DEPTH * 2 :].copy().view(np.uint64)
        self.tree = cell["tree"][0].as_py()
        self.alone = cell["kind"][0].as_py() == 1 and cell["i"][0].as_py() == cell["j"][0].as_py()
        self.least, self.percent, self.floor, self.digit_floor = least, percent, floor, digit_floor

    def pairs(self):
        """(row, row, equal digits) in parts."""
        left, right = np.flatnonzero(self.side == 0), np.flatnonzero(self.side == (0 if self.alone else 1))
        for at in range(0, len(left), 256):
            a = left[at : at + 256]
            alike = SKETCH - np.bitwise_count(self.sketch[a, None] ^ self.sketch[None, right]).sum(2, dtype=np.int64)
            # A link needs percent / (100 + percent) of both sizes in common, and only shared shingles can be.
            both = self.percent * (self.n[a, None] + self.n[None, right])
            keep = (alike >= self.floor) & ((100 + self.percent) * np.minimum(self.shared[a, None], self.shared[None, right]) >= both)
            keep &= (self.label[a, None] != self.label[None, right]) & (self.ids[a, None] != self.ids[None, right])
            if self.alone:
                keep &= a[:, None] < right[None]
            x, y = np.nonzero(keep)
            x, y = a[x], right[y]
            for k in range(0, len(x), 8192):
                p, q = x[k : k + 8192], y[k : k + 8192]
                same = self.digits[p] == self.digits[q]
                first = same.reshape(-1, TREES, DEPTH)[:, :, : self.least].all(2).argmax(1)
                total = same.sum(1)
                ok = (total >= self.digit_floor) & (first == self.tree)
                yield p[ok], q[ok], total[ok]


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are linked."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


class _Linked:
    """Which pairs of rows are linked, by their whole sets.

    A bit stands for each shingle that several rows have; where these bits
    would take over ``CELL_BYTES``, the sets are compared pair by pair.
    """

    def __init__(self, sets: pa.Array, percent: int):
        self.percent = percent
        self.sets = [np.frombuffer(x.as_buffer(), "<u8") for x in sets]
        self.size = np.array([len(x) for x in self.sets], dtype=np.int64)
        _, column, times = np.unique(np.concatenate(self.sets), return_inverse=True, return_counts=True)
        several = times > 1
        column, kept = (np.cumsum(several) - 1)[column], several[column]
        words = (int(several.sum()) + 63) // 64
        self.bits = None
        if words * len(self.sets) * 8 <= CELL_BYTES:
            row, column = np.repeat(np.arange(len(self.sets)), self.size)[kept], column[kept]
            self.bits = np.zeros((len(self.sets), words), dtype=np.uint64)
            np.bitwise_or.at(self.bits, (row, column >> 6), np.uint64(1) << (column & 63).astype(np.uint64))

    def __call__(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.array([similar(self.sets[i], self.sets[j], self.percent) for i, j in zip(p.tolist(), q.tolist())], dtype=bool)
        both = np.zeros(len(p), dtype=np.int64)
        step = max(1, (1 << 20) // max(1, self.bits.shape[1]))
        for at in range(0, len(p), step):
            x, y = p[at : at + step], q[at : at + step]
            both[at : at + step] = np.bitwise_count(self.bits[x] & self.bits[y]).sum(1, dtype=np.int64)
        return 100 * both >= self.percent * (self.size[p] + self.size[q] - both)


def _rest(forest: DataFrame, labels: DataFrame, sets_of, least: int, leaf: int, percent: int, unique: bool) -> DataFrame:
    """(u, v): confirmed links between the components of each region of more than ``leaf`` rows.

    ``sets_of`` gives the sets of a table of ids.
    """
    limits = (least, percent, least_matches((1 + percent / 100) / 2, SKETCH), least_matches(percent / 100, TREES * DEPTH))
    labelled = forest.join(labels, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    region = F.expr(f"xxhash64(tree, substring(sig, tree * {DEPTH * 2} + 1, {least * 2}))")
    thin = labelled.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))).select(region.alias("region"), "tree", "doc_id", "label", "n")
    inside = cut(thin.join(cut(_wide(thin, leaf + 1).select("region")), "region"))
    sets = cut(sets_of(inside.select("doc_id").distinct()))
    # An id with several sets has no count of its own for each of them.
    own = _own(sets) if unique else sets.select("doc_id", F.lit(0).cast("long").alias("own")).limit(0)
    rows = inside.join(own, "doc_id", "left").withColumn("shared", F.col("n") - F.coalesce("own", F.lit(0)))
    # A set with fewer shared shingles than a link needs has no partner.
    rows = cut(rows.where(100 * F.col("shared") >= percent * F.col("n")).drop("own"))
    rows = rows.join(cut(_wide(rows, 2)), "region")
    outside = F.col("label") != F.col("major")
    block = F.pmod(F.xxhash64("doc_id"), F.when(outside, F.col("others")).otherwise(F.col("mine")))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    seat = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    inner = F.transform(upto(F.col("others")), lambda k: seat(1, F.least("block", k), F.greatest("block", k), F.col("block") > k))
    cross = F.transform(upto(F.col("mine")), lambda k: seat(0, F.col("block"), k, F.lit(0)))
    seats = F.when(outside, F.concat(inner, cross)).otherwise(F.transform(upto(F.col("others")), lambda k: seat(0, k, F.col("block"), F.lit(1))))
    rows = rows.withColumn("block", block).withColumn("seat", F.explode(seats)).join(forest.select("doc_id", "n", "sig"), ["doc_id", "n"])
    rows = rows.select("region", "seat.*", "tree", "doc_id", "label", "n", "shared", "sig")
    cell = ["region", "kind", "i", "j"]

    def ends(rows: pa.Table) -> pa.Table:
        """The rows of the cell that are in any pair."""
        used = np.zeros(rows.num_rows, dtype=bool)
        for p, q, _ in _Cell(rows, *limits).pairs():
            used[p] = used[q] = True
        return rows.filter(pa.array(used))

    def links(rows: pa.Table) -> pa.Table:
        """A spanning forest of the links between the cell's components; likely pairs first."""
        us, vs = [], []
        own = _Cell(rows, *limits)
        linked = _Linked(rows["set"].combine_chunks(), percent)
        p, q, likely = (np.concatenate([*x]) for x in zip(*own.pairs()))
        part = np.unique(own.label, return_inverse=True)[1]
        root = np.arange(int(part.max()) + 1)
        order, at, step = np.argsort(-likely, kind="stable"), 0, 256
        while at < len(order):
            k = order[at : at + step]
            at, step = at + step, min(2 * step, 1 << 16)
            k = k[root[part[p[k]]] != root[part[q[k]]]]
            for i, j in zip(*(x[k[linked(p[k], q[k])]].tolist() for x in (p, q))):
                a, b = root[part[i]], root[part[j]]
                if a != b:
                    root[root == max(a, b)] = min(a, b)
                    us.append(int(own.ids[i]))
                    vs.append(int(own.ids[j]))
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    held = cut(rows.groupBy(*cell).applyInArrow(ends, rows.schema))
    sized = sets.withColumn("n", F.expr("octet_length(set) div 8"))
    return held.join(sized, ["doc_id", "n"]).groupBy(*cell).applyInArrow(links, "u long, v long")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are similar enough."""

    def run(batches):
        for b in batches:
            us, vs, keep = b.column("x"), b.column("y"), np.zeros(b.num_rows, dtype=bool)
            for i in range(b.num_rows):
                keep[i] = similar(np.frombuffer(us[i].as_buffer(), "<u8"), np.frombuffer(vs[i].as_buffer(), "<u8"), percent)
            yield b.select(["u", "v"]).filter(pa.array(keep))

    left = pairs.join(sets.select(F.col("doc_id").alias("u"), F.col("set").alias("x")), "u")
    both = left.join(sets.select(F.col("doc_id").alias("v"), F.col("set").alias("y")), "v")
    return both.select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, label): the smallest id of each connected component, for ids with an edge to a smaller one.

    Alternates large-star and small-star contractions until nothing changes.
    """
    check = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    flip = lambda e: e.select(F.col("v").alias("u"), F.col("u").alias("v"))
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    state = check(now)
    while state[0]:
        n = state[0]
        both = few(now.unionByName(flip(now)), n)
        least = few(both.groupBy("u").agg(F.min("v").alias("m")), n).select("u", F.least("u", "m").alias("m"))
        large = few(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), n)
        least = few(large.groupBy("u").agg(F.min("v").alias("m")), n)
        small = few(large.join(least, "u"), n)
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = cut(few(small, n))
        after = check(now)
        if after == state:
            break
        state = after
    return now.select(F.col("u").alias("doc_id"), F.col("v").alias("label"))


#: a pair of sets weighs as much as so many thin rows
PAIRS_IN_ONE = 50

#: rows, and shingles of all their sets, of a block of a large region
BLOCK, BLOCK_SHINGLES = 2048, 1 << 20

#: bytes of the bits that stand for the shingles of two blocks
CELL_BYTES = 1 << 24

#: (trees, rows of a leaf, neighbours on either side) of each round
ROUNDS = ((2, 1, 1), (8, 4, 2), (TREES, 8, 4))


def least_matches(share: float, of: int) -> int:
    """Of so many independent matches with that probability, the number that six standard deviations leave."""
    return int(np.floor(of * (share - 6 * np.sqrt(share * (1 - share) / of))))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 85, least: int = 4) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    spark = docs.sparkSession
    summary = cut(_summaries(source, shingle))
    solid = summary.where("n > 0 and doc_id is not null")
    rows, ids = solid.agg(F.count("doc_id"), F.count_distinct("doc_id")).first()
    # Written first, so that a join with a large group of copies can be split.
    reps = cut(solid.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1").select("k1", "k2", "rep"))
    same = cut(solid.join(reps, ["k1", "k2"], "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")))
    unique = rows == ids
    once = (lambda df: df) if unique else (lambda df: df.distinct())
    forest = cut(once(_signed(source, same.select(F.col("rep").alias("doc_id")).distinct(), shingle)))
    floor = least_matches((1 + percent / 100) / 2, SKETCH)
    sets_of = lambda ids: once(_sets(source, ids, shingle))
    labels = spark.createDataFrame([], "doc_id long, label long")
    joined, tested = None, None
    for trees, leaf, reach in (*ROUNDS, (None, ROUNDS[-1][1], None)):
        if trees is None:
            new = cut(_rest(forest, labels, sets_of, least, leaf, percent, unique))
        else:
            pairs = _neighbours(_rows(forest, labels, trees, least), leaf, reach, floor)
            pairs = cut(pairs if tested is None else pairs.join(tested, ["u", "v"], "left_anti"))
            tested = pairs if tested is None else tested.unionByName(pairs)
            total = pairs.count()
            if not total:
                continue
            ends = cut(few(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct(), 2 * total))
            new = cut(few(_confirm(pairs, sets_of(ends), percent), PAIRS_IN_ONE * total))
        if not new.count():
            continue
        # The stars found so far stand for all links before.
        joined = new if joined is None else labels.select(F.col("doc_id").alias("u"), F.col("label").alias("v")).unionByName(new)
        labels = components(joined)
    if not unique:  # an id with several sets ties their classes together
        links = same.select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
        labels = components(links.unionByName(labels.select(F.col("doc_id").alias("u"), F.col("label").alias("v"))))
    found = same.select("doc_id", "n", F.col("rep" if unique else "doc_id").alias("at")).join(labels.select(F.col("doc_id").alias("at"), "label"), "at", "left")
    found = found.select("doc_id", "n", F.coalesce("label", "at").alias("component_id"))
    alone = summary.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumnRenamed("n", "n_shingles")


def _signed(source: DataFrame, reps: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, n, sig) of the representatives."""

    def run(batches):
        for b in batches:
            ids, sizes, sigs = [], [], []
            for at, to, hashes, first in shingle_sets(b.column("t"), shingle):
                for r in range(to - at):
                    if first[r + 1] > first[r]:
                        ids.append(at + r)
                        sizes.append(int(first[r + 1] - first[r]))
                        sigs.append(signature(hashes[first[r] : first[r + 1]]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(ids, pa.int64())), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "n", "sig"])

    signed = source.where("t is not null and doc_id is not null").mapInArrow(run, "doc_id long, n long, sig binary")
    return signed.join(reps, "doc_id", "left_semi")
