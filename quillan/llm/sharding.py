"""K-d tree sharding by bytes.

The rows' metadata span a box: numeric columns by value, text columns by the
order of their first six bytes.  Nodes are split along the dimension that is
widest there, as a share of its whole range, at the weighted median of bytes,
until leaves reach the target bytes; a node for several leaves splits in
proportion, so the number of leaves is free.

Medians are found on the executors: each round counts bytes in ``bins`` equal
bins of the node's range and goes on inside the bin that holds the median,
until that bin holds at most a 1/``fine`` share of the node or one value;
rows that share the value are split by a hash.  The driver only sees
nodes x bins sums.

What moves is a unit: all rows with equal texts, so copies stay together.  Only
a group of more than ``whole`` (half) of a shard is placed row by row.  Units of
more than ``light`` (a hundredth) of a shard are at most shards / ``light`` by
construction, and the driver places them: along the axis, as many go below the
split as come nearest to the share, and the median of the others makes up for
the difference.  So sizes stay near equal with groups kept whole.

Cases: a null text weighs one byte and groups with other nulls; null
metadata counts as 0; ties are split by hash; equal ids are allowed, and
identical rows stay together; empty tables give empty results; columns of
the input that clash with result names are only used when named.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut


def _find(units: DataFrame, key: str, want: dict[int, float], bins: int, fine: int, where: Column | None = None) -> dict[int, tuple[float, float, float, float]]:
    """For each node: (lowest, highest, weight below, weight) of a narrow key range that holds the weight ``want``."""
    base = units if where is None else units.where(where)
    base = base.where(F.col("node").isin(list(want)))
    state = {r["node"]: (r["lo"], r["hi"], 0.0, float(r["w"])) for r in base.groupBy("node").agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.sum("w").alias("w")).collect()}
    total = {k: v[3] for k, v in state.items()}
    while True:
        wide = {k: v for k, v in state.items() if v[1] > v[0] and v[3] > total[k] / fine}
        if not wide:
            return state
        case = reduce(lambda c, kv: c.when((F.col("node") == kv[0]) & F.col(key).between(kv[1][0], kv[1][1]), F.least(F.lit(bins - 1), F.floor((F.col(key) - kv[1][0]) / (kv[1][1] - kv[1][0]) * bins)).cast("int")), wide.items(), F.when(F.lit(False), 0))
        rows = base.withColumn("bin", case).where("bin is not null").groupBy("node", "bin").agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.sum("w").alias("w")).collect()
        for k, (lo, hi, below, _) in wide.items():
            for r in sorted((r for r in rows if r["node"] == k), key=lambda r: r["bin"]):
                lo, hi = r["lo"], r["hi"]
                if below + r["w"] >= want[k]:
                    break
                below += float(r["w"])
            state[k] = (lo, hi, below if below < want[k] else below - float(r["w"]), float(r["w"]))


def _walk(units: DataFrame, dims: list[str], splits: list[tuple], axis: dict[int, str]) -> DataFrame:
    """units with the node that the splits so far lead to, and its value x along the axis of the next split."""

    def run(batches):
        for b in batches:
            values = {d: np.asarray(b.column(d)) for d in (*dims, "h")}
            node = np.zeros(b.num_rows, dtype=np.int32)
            for at, dim, bound, strict, tie, to in splits:
                x = values[dim]
                up = x > bound if strict else x >= bound
                if tie is not None:
                    h, h_strict = tie
                    up |= (x == bound) & (values["h"] > h if h_strict else values["h"] >= h)
                node[(node == at) & up] = to
            x = np.zeros(b.num_rows)
            for at, dim in axis.items():
                x = np.where(node == at, values[dim], x)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(node), pa.array(x)], [*b.schema.names, "node", "x"])

    return units.mapInArrow(run, T.StructType([*units.schema.fields, T.StructField("node", T.IntegerType()), T.StructField("x", T.DoubleType())]))


def kd_tree(units: DataFrame, dims: list[str], shards: int, heavy: list | None = None, bins: int = 512, fine: int = 4096) -> tuple[DataFrame, dict]:
    """units (unit, w, h, dims...) with the leaf number as ``node``, and the leaf of each unit of ``heavy``, a list of such rows."""
    ends = [f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]

    def ranges(row, own) -> dict[str, float]:
        """Range of each dimension over the light units, whose ends are in row, and the heavy ones."""
        at = {d: [x for x in (*([row[f"lo_{d}"], row[f"hi_{d}"]] if row else []), *(r[d] for r in own)) if x is not None] for d in dims}
        return {d: max(x, default=0.0) - min(x, default=0.0) for d, x in at.items()}

    spans = units.agg(*ends, F.count(F.lit(1)).alias("n")).first()
    splits: list[tuple] = []
    heavies = {0: list(heavy or [])}
    leaves = {0: shards} if spans["n"] or heavies[0] else {}  # a node is named by its first leaf and ends before another
    whole = {d: x or 1.0 for d, x in ranges(spans, heavies[0]).items()}
    while any(b - a > 1 for a, b in leaves.items()):
        open_ = [a for a, b in leaves.items() if b - a > 1]
        here = _walk(units, dims, splits, {}).where(F.col("node").isin(open_))
        stats = {r["node"]: r for r in here.groupBy("node").agg(F.sum("w").alias("w"), *ends).collect()}
        axis = {}
        mid = {a: (a + leaves[a]) // 2 for a in open_}
        want = {}
        for a in open_:
            size = ranges(stats.get(a), heavies[a])
            axis[a] = max(dims, key=lambda d: size[d] / whole[d])
            own = sorted(heavies.pop(a), key=lambda r: (r[axis[a]], r["h"]))
            sums = np.concatenate(([0.0], np.cumsum([float(r["w"]) for r in own])))
            light = float(stats[a]["w"]) if a in stats else 0.0
            share = (mid[a] - a) / (leaves[a] - a)
            cut_at = int(np.abs(sums - sums[-1] * share).argmin())
            heavies[a], heavies[mid[a]] = own[:cut_at], own[cut_at:]
            if light:
                want[a] = min(light, max(0.0, (light + sums[-1]) * share - sums[cut_at]))
        here = _walk(units, dims, splits, axis)
        found = _find(here, "x", want, bins, fine) if want else {}
        # One value holds the median: its rows are split by their hash.
        tied = {k: v for k, v in found.items() if v[0] == v[1]}
        inner = _find(here, "h", {k: want[k] - v[2] for k, v in tied.items()}, bins, fine, reduce(lambda c, k: c | ((F.col("node") == k) & (F.col("x") == tied[k][0])), tied, F.lit(False))) if tied else {}

        def border(lo, hi, below, w, goal):
            """Whether the range that holds the goal goes below the split, which is the nearer choice."""
            return (hi, True) if abs(below + w - goal) <= abs(below - goal) else (lo, False)

        for k, v in found.items():
            if k in inner:
                splits.append((k, axis[k], v[0], True, border(*inner[k], want[k] - v[2]), mid[k]))
            else:
                splits.append((k, axis[k], *border(*v, want[k]), None, mid[k]))
        leaves = {x: y for a, b in leaves.items() for x, y in ([(a, (a + b) // 2), ((a + b) // 2, b)] if b - a > 1 else [(a, b)])}
    return _walk(units, dims, splits, {}).drop("x"), {r["unit"]: a for a, own in heavies.items() for r in own}


def coordinate(docs: DataFrame, column: str) -> Column:
    """A column as a number: the value, or the first six bytes of a text."""
    c = F.col(f"`{column}`")
    if isinstance(docs.schema[column].dataType, T.StringType):
        c = F.conv(F.hex(F.rpad(F.substring(F.encode(c, "UTF-8"), 1, 6), 6, F.lit(b"\0"))), 16, 10)
    return F.coalesce(c.cast("double"), F.lit(0.0))


def shard_by_bytes(docs: DataFrame, shards: int | None = 16, dims: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", target_bytes: int = 1 << 30, whole: float = 0.5, light: float = 0.01, lane_rows: int = 100_000) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot); dims: columns of docs beside text length.

    Without ``shards``, there are as many as ``target_bytes`` asks for.
    """
    extra = [coordinate(docs, d).alias(f"d{i}") for i, d in enumerate(dims or [])]
    text = F.col(text_col)
    thin = cut(docs.select(
        F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text, F.hash(text)).alias("h"), *extra,
    ))
    names = ["len", *[f"d{i}" for i in range(len(extra))]]
    total, count = thin.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    shards = shards or max(1, -(-total // target_bytes))
    # At most shards / whole groups.
    large = thin.groupBy("h").agg(F.sum("size").alias("g")).where(F.col("g") > total / shards * whole).select("h", F.lit(True).alias("large"))
    rows = thin.join(F.broadcast(large), "h", "left").withColumn("unit", F.when(F.col("large"), F.xxhash64("h", "doc_id")).otherwise(F.col("h"))).drop("large")
    units = cut(
        rows.groupBy("unit")
        .agg(F.sum("size").alias("w"), F.min("size").cast("double").alias("len"), *[F.min(f"d{i}").alias(f"d{i}") for i in range(len(extra))])
        .withColumn("h", F.xxhash64("unit", F.lit("tie")).cast("double"))
    )
    own = F.col("w") > total / shards * light
    placed, heavy = kd_tree(units.where(~own), names, shards, units.where(own).collect())
    placed = placed.select("unit", F.col("node").alias("shard"))
    if heavy:
        placed = placed.unionByName(docs.sparkSession.createDataFrame(list(heavy.items()), "unit long, shard int"))
    out = rows.join(placed, "unit").withColumn("lane", F.pmod(F.xxhash64("unit", "doc_id"), F.lit(max(64, count // shards // lane_rows))))
    # Slots are counted inside lanes of a shard, about lane_rows rows each, which start where those before end.
    lanes = out.groupBy("shard", "lane").count()
    before = Window.partitionBy("shard").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    lanes = lanes.select("shard", "lane", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("shard", "lane").orderBy("unit", "doc_id")
    out = out.withColumn("n", F.row_number().over(own)).join(lanes, ["shard", "lane"])
    return out.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("base") + F.col("n") - 1).cast("long").alias("slot"))
