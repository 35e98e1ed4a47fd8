"""Language identification by rank-order n-gram profiles.

A profile lists the ``size`` most frequent letter n-grams (orders 1 to 3, with
one blank for each run of other characters) by rank.  A document's profile is
compared with each language's by the out-of-place distance: the sum of rank
differences, ``size`` for an n-gram that the language profile does not have.
The language at the least distance wins, ties go to the smaller name.  The
score is one less the distance as a share of the largest possible one.

Training uses at most about ``sample`` labelled documents of each language,
chosen by a hash of their ids at a rate that follows from the language's
count; the profiles are languages x size rows, which is what the driver
holds.  Prediction reads whole texts and needs no shuffle.  N-grams are named
by hashes of 24 bits; two that collide count as one.

Cases: a null text, or one without a letter, is ``und`` with score 0; so is
every text when nothing could be learned; repeated rows are judged alike;
input columns named like the results are replaced; empty tables work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name

ORDERS, BITS = 3, 24
SLICE_ROWS, SLICE_BYTES = 256, 1_000_000
assert SLICE_ROWS << BITS <= 1 << 32  # a row's number and an n-gram share 32 bits
NEW = ("lang_pred", "score")

_letter = np.zeros(0x110000, dtype=np.uint32)
_known = np.zeros(0x110000, dtype=bool)


def _letters(codes: np.ndarray) -> np.ndarray:
    """Lower-case letter codes, 0 for anything that is no letter."""
    if not _known[codes].all():
        for c in np.unique(codes[~_known[codes]]):
            _letter[c] = ord(chr(c).lower()[0]) if chr(c).isalpha() else 0
            _known[c] = True
    return _letter[codes]


def _slices(column: pa.Array):
    """(first row, codes, row of each code) over bounded slices."""
    column = pc.fill_null(column, "")
    size = np.asarray(pc.binary_length(column)).astype(np.int64)
    at, n = 0, len(column)
    total = np.concatenate(([0], np.cumsum(size)))
    while at < n:
        to = int(np.searchsorted(total, total[at] + SLICE_BYTES, side="right")) - 1
        to = max(at + 1, min(n, to, at + SLICE_ROWS))
        texts = [x.decode("utf-8", "replace") for x in column.slice(at, to - at).cast(pa.binary()).to_pylist()]
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), dtype="<u4")
        yield at, to, codes, np.repeat(np.arange(to - at, dtype=np.uint32), [len(x) for x in texts])
        at = to


def gram_counts(codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram, count): the n-grams of each row, as hashes of BITS bits."""
    v = _letters(codes)
    keep = v > 0
    if len(v):
        keep[1:] |= (v[:-1] > 0) & (rows[1:] == rows[:-1])
    v, rows = v[keep], rows[keep]
    keys = []
    with np.errstate(over="ignore"):
        g = np.zeros(len(v), dtype=np.uint32)
        for n in range(1, ORDERS + 1):
            m = len(v) - n + 1
            if m <= 0:
                break
            g = g[:m] * np.uint32(0x01000193) + (v[n - 1 :] + np.uint32(n)) * np.uint32(0x9E3779B1)
            h = (g ^ (g >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            h = (h ^ (h >> np.uint32(13))) >> np.uint32(32 - BITS)
            own = rows[:m] == rows[n - 1 :]
            if n == 1:
                own = v > 0
            keys.append((rows[:m] << np.uint32(BITS) | h)[own])
    keys = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint32)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate((first, [len(keys)])))
    keys = keys[first]
    return keys >> np.uint32(BITS), keys & np.uint32(2**BITS - 1), count


def top_grams(row: np.ndarray, gram: np.ndarray, count: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram, rank) of each row's most frequent n-grams, ties by hash."""
    key = row.astype(np.uint64) << np.uint64(56) | (np.uint64(2**32 - 1) - count.astype(np.uint64)) << np.uint64(BITS) | gram.astype(np.uint64)
    key = np.sort(key)
    row = (key >> np.uint64(56)).astype(np.int64)
    rank = np.arange(len(key)) - np.searchsorted(row, row)
    keep = rank < size
    return row[keep], (key[keep] & np.uint64(2**BITS - 1)).astype(np.int64), rank[keep]


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", size: int = 400, sample: int = 4000) -> dict[str, np.ndarray]:
    """Profiles by language: n-gram hashes in rank order."""
    rows = labelled.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("l is not null and t is not null")
    counts = rows.groupBy("l").count().collect()
    if not counts:
        return {}
    rate = F.create_map(*[F.lit(x) for r in counts for x in (r["l"], min(1.0, sample / r["count"]))])
    rows = rows.where(F.pmod(F.xxhash64("i", F.lit("sample")), F.lit(1 << 30)) < rate[F.col("l")] * (1 << 30))

    def count(batches):
        for b in batches:
            names = b.column("l").dictionary_encode()
            codes = np.asarray(names.indices).astype(np.uint64)
            keys, sums = [], []
            for at, _, c, r in _slices(b.column("t")):
                row, gram, n = gram_counts(c, r)
                key, back = np.unique(codes[at + row.astype(np.int64)] << np.uint64(BITS) | gram.astype(np.uint64), return_inverse=True)
                keys.append(key)
                sums.append(np.bincount(back, weights=n, minlength=len(key)))
            if keys:
                key, back = np.unique(np.concatenate(keys), return_inverse=True)
                total = np.bincount(back, weights=np.concatenate(sums), minlength=len(key)).astype(np.int64)
                lang = names.dictionary.take(pa.array((key >> np.uint64(BITS)).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([lang, pa.array((key & np.uint64(2**BITS - 1)).astype(np.int32)), pa.array(total)], ["lang", "gram", "n"])

    totals = rows.select("l", "t").mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = totals.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= size)
    out: dict[str, list] = {}
    for r in sorted(best.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["lang"], []).append(r["gram"])
    return {k: np.array(v, dtype=np.int64) for k, v in sorted(out.items())}


class Judge:
    """Distances of documents to the profiles, vectorised over a slice."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int):
        self.names, self.size = list(profiles), size
        self.grams = np.unique(np.concatenate([*profiles.values(), np.zeros(0, np.int64)]))
        self.ranks = np.full((len(self.names), len(self.grams) + 1), -1, dtype=np.int64)
        for k, grams in enumerate(profiles.values()):
            self.ranks[k, np.searchsorted(self.grams, grams)] = np.arange(len(grams))

    def __call__(self, codes: np.ndarray, rows: np.ndarray, n: int) -> tuple[list[str], np.ndarray]:
        row, gram, rank = top_grams(*gram_counts(codes, rows), self.size)
        names, score = ["und"] * n, np.zeros(n)
        if not self.names or not len(row):
            return names, score
        at = np.searchsorted(self.grams, gram)
        at[(at >= len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != gram)] = len(self.grams)
        held = np.bincount(row, minlength=n)
        far = np.empty((len(self.names), n))
        for k in range(len(self.names)):
            other = self.ranks[k, at]
            far[k] = np.bincount(row, weights=np.where(other < 0, self.size, np.abs(other - rank)), minlength=n)
        best = far.argmin(0)
        for i in np.flatnonzero(held):
            names[i] = self.names[best[i]]
        score = np.where(held > 0, 1 - far.min(0) / np.maximum(1, held * self.size), 0.0)
        return names, np.clip(score, 0, 1)


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], text_col: str = "text", keep: list[str] | None = None, size: int = 400) -> DataFrame:
    """The columns ``keep`` of docs (all when None) with lang_pred and score."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in NEW]
    judge = Judge(profiles, size)
    fields = [T.StructField(f.name, f.dataType, True) for f in docs.schema.fields if f.name in keep]
    held = free_name(docs, "__text")
    source = docs.select(*[F.col(f"`{f.name}`") for f in fields], F.col(text_col).alias(held))

    def run(batches):
        for b in batches:
            names, scores = [], [np.zeros(0)]
            for at, to, c, r in _slices(b.column(held)):
                n, s = judge(c, r, to - at)
                names += n
                scores.append(s)
            columns = [b.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(np.concatenate(scores))], [*[f.name for f in fields], *NEW])

    schema = T.StructType([*fields, T.StructField(NEW[0], T.StringType()), T.StructField(NEW[1], T.DoubleType())])
    return source.mapInArrow(run, schema)
