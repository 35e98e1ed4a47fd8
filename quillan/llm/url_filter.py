"""URL allow and block lists: a blocked Bloom filter before an exact hash join.

A list holds (host, path) entries; an entry fits its host and every subdomain
when the url's path starts with the entry's path, and the longest fitting
entry decides.  Each url yields the finitely many entries that could fit it
(host suffixes at label borders x prefixes of the path lengths that occur in
the list, so at most labels x lengths keys for a url).  These keys are tested against a blocked Bloom filter of the list
(eight 64-bit words a block, one bit in each word); what passes goes to a
hash join with the list itself, which removes the false positives.

The filter has a fixed upper size (``max_filter_bytes``); a longer list makes
it fuller, which costs more false positives and never a wrong verdict.

Cases: a null url, or one without ``://``, has empty host and path and gets
the default verdict; repeated urls are judged once and joined back; of equal
entries with both verdicts ``block`` counts; null list entries are dropped;
empty tables give empty results; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 8
#: a list of up to so many entries is broadcast
BROADCAST_RULES = 100_000


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.when(F.instr(url, "://") > 0, host).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def _hashes(host: Column, path: Column) -> tuple[Column, Column]:
    return F.xxhash64(host, path), F.xxhash64(path, host)


def build_filter(rules: DataFrame, max_filter_bytes: int, n: int | None = None) -> np.ndarray:
    """The filter of the n rules as an array of (blocks, 8) words, or-ed together on the executors."""
    n = rules.count() if n is None else n
    blocks = 1
    while blocks * 512 < 16 * n and 2 * blocks * 64 <= max_filter_bytes:
        blocks *= 2
    h1, h2 = _hashes(F.col("r_host"), F.col("r_path"))
    bits = [F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h2, {6 * w}) & 63 as int))") for w in range(WORDS)]
    rows = (
        rules.select(h1.alias("h1"), h2.alias("h2"))
        .select(F.expr(f"h1 & {blocks - 1}L").alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(bits)])
        .groupBy("block")
        .agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])
        .toArrow()
    )
    out = np.zeros((blocks, WORDS), dtype=np.int64)
    own = np.asarray(rows["block"].combine_chunks())
    for i in range(WORDS):
        out[own, i] = np.asarray(rows[f"w{i}"].combine_chunks())
    return out.view(np.uint64)


def may_hold(words: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    own = words[(h1.view(np.uint64) & np.uint64(len(words) - 1)).astype(np.int64)]
    h = h2.view(np.uint64)
    ok = np.ones(len(h1), dtype=bool)
    for w in range(WORDS):
        ok &= (own[:, w] >> ((h >> np.uint64(6 * w)) & np.uint64(63))) & np.uint64(1) == 1
    return ok


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_filter_bytes: int = 64 << 20) -> DataFrame:
    """(id, host, path, rule, verdict) for each row of pages; rules: (host, path, verdict)."""
    spark = pages.sparkSession
    rules = (
        rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
        .dropna()
        .groupBy("r_host", "r_path")
        .agg(F.max("r_verdict").alias("r_verdict"))
    )
    total = rules.count()
    words = spark.sparkContext.broadcast(build_filter(rules, max_filter_bytes, total))
    # Path lengths are bounded by the longest path of the list, so this is a short list of numbers.
    lengths = sorted(r[0] for r in rules.select(F.length("r_path")).distinct().collect())
    judged = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))

    wanted = F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>")
    labels = F.split("host", r"\.")
    keyed = (
        judged.select("host", "path")
        .distinct()
        .withColumn("labels", labels)
        .withColumn("hosts", F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), ".")))
        .withColumn("paths", F.transform(F.filter(wanted, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n)))
        .withColumn("keys", F.flatten(F.transform("hosts", lambda h: F.transform("paths", lambda p: F.struct(h.alias("h"), p.alias("p"))))))
        .select(
            "host", "path", "keys",
            F.transform("keys", lambda k: F.xxhash64(k["h"], k["p"])).alias("h1"),
            F.transform("keys", lambda k: F.xxhash64(k["p"], k["h"])).alias("h2"),
        )
    )

    def probe(batches):
        for b in batches:
            h1, h2 = b.column("h1"), b.column("h2")
            counts = np.diff(np.asarray(h1.offsets))
            ok = may_hold(words.value, np.asarray(h1.flatten()), np.asarray(h2.flatten()))
            row = np.repeat(np.arange(b.num_rows), counts)[ok]
            slot = np.flatnonzero(ok)
            keys = b.column("keys").flatten().take(pa.array(slot))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column("host").take(take), b.column("path").take(take), keys.field("h"), keys.field("p")], ["host", "path", "r_host", "r_path"])

    possible = keyed.mapInArrow(probe, "host string, path string, r_host string, r_path string")
    size = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"), F.concat("r_host", "r_path"), "r_verdict")
    # A hash join either way; a list of checked size goes to the executors whole.
    listed = F.broadcast(rules) if total <= BROADCAST_RULES else rules.hint("shuffle_hash")
    best = possible.join(listed, ["r_host", "r_path"]).groupBy("host", "path").agg(F.max(size).alias("best"))
    # Written first, so that the join with a url of very many pages can be split.
    best = cut(best.select("host", "path", F.col("best").getField("col3").alias("rule"), F.col("best").getField("r_verdict").alias("ruled")))
    return judged.join(best, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit(default)).alias("verdict"))
