"""Personal data: patterns, and terms that the corpus shows to reveal them.

Base spans are found by pattern (email, ip, card, phone), leftmost and not
overlapping within a kind.  Every value found is a protected entity.  The
corpus tells how strongly a term reveals one: with ``n_et`` distinct texts
that hold term t in a context of entity e (``reach`` words on either side),
``n_e`` distinct texts with e, ``df_t`` distinct texts with t and N distinct
texts,

    P(e | t) = n_et / df_t      gain = log2(n_et * N / (n_e * df_t)).

A term is disclosing for e when at least ``support`` distinct contexts of e hold
it, P(e | t) >= ``share`` and gain >= ``bits``; it is then a span of kind ``term`` in documents that name e,
and with ``everywhere``, as the registered query and the pipeline have it, in
every document.
Contexts are counted once however often they are copied, so copies disclose
nothing by themselves.  Without ``everywhere``, documents that have no base span
are left alone.

Both lists that go to the executors, candidate terms and disclosing pairs,
are broadcast only up to ``broadcast_rows`` rows; beyond that the same results
come from joins.

Cases: a null text counts as empty; repeated rows are judged alike; empty
tables give empty results; columns of the input that clash with results are
ignored, or kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BitFilter, cut, free_name, hits
from .textkernel import HashSet, Words, mix64, slices

KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never starts inside a run of digits, so looking back keeps the search linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NUMBERS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str):
    low, at = 0, text.find("@")
    while at >= 0:
        start = low + len(text[low:at].rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        low = m.end() if m else at + 1
        at = text.find("@", low)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind, then start."""
    out = [(0, s, e) for s, e in _emails(text)] if "@" in text else []
    if not _NUMBERS.search(text):
        return out
    if text.count(".") >= 3:
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NUMBERS.findall(m[0])) <= 15]
    return out


def entity(kind: int, value: str) -> int:
    """A signed 64-bit name of a protected value; spelling of numbers and letter case do not count."""
    plain = "".join(_NUMBERS.findall(value)) if kind >= 2 else value.lower()
    return int.from_bytes(hashlib.blake2b(f"{kind}:{plain}".encode(), digest_size=8).digest(), "little", signed=True)


class _Terms:
    """The words of one text, without those that touch a base span."""

    def __init__(self, text: str, spans: list[tuple[int, int, int]]):
        raw = text.encode("utf-8", "replace")
        data = np.frombuffer(raw, dtype=np.uint8)
        w = Words(data, np.array([0, len(data)]), lower=True, punct=True)
        self.hash = w.hashes()
        if len(raw) == len(text):
            self.start, self.end = w.start, w.end
        else:
            ahead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
            self.start, self.end = ahead[w.start], ahead[w.end]
        free = self.end - self.start >= 3
        for _, s, e in spans:
            free[np.searchsorted(self.end, s, "right") : np.searchsorted(self.start, e, "left")] = False
        self.free = free
        self.free_hash, self.free_start, self.free_end = self.hash[free], self.start[free], self.end[free]

    def near(self, s: int, e: int, reach: int) -> np.ndarray:
        left, right = np.searchsorted(self.free_end, s, "right"), np.searchsorted(self.free_start, e, "left")
        return np.unique(np.concatenate((self.free_hash[max(0, left - reach) : left], self.free_hash[right : right + reach])))


def _rows(column: pa.Array):
    """(row, text, base spans) of the rows that have any."""
    for i, text in enumerate(column.to_pylist()):
        if text:
            spans = base_spans(text)
            if spans:
                yield i, text, spans


def text_key(text_col: str):
    return F.xxhash64(text_col, F.hash(text_col))


def mentions(docs: DataFrame, text_col: str, reach: int) -> DataFrame:
    """(e, x, ctx, terms): each mention of an entity in text x with the terms around it."""

    def run(batches):
        for b in batches:
            e, x, ctx, terms = [], [], [], []
            for i, text, spans in _rows(b.column("t")):
                words = _Terms(text, spans)
                for kind, s, t in spans:
                    near = words.near(s, t, reach)
                    e.append(entity(kind, text[s:t]))
                    x.append(b.column("x")[i].as_py())
                    with np.errstate(over="ignore"):
                        ctx.append(mix64(near).sum(dtype=np.uint64).view(np.int64))
                    terms.append(near.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(e, pa.int64()), pa.array(x, pa.int64()), pa.array(ctx, pa.int64()), pa.array(terms, pa.list_(pa.int64()))], ["e", "x", "ctx", "terms"])

    return docs.select(F.col(text_col).alias("t"), text_key(text_col).alias("x")).where("t is not null").mapInArrow(run, "e long, x long, ctx long, terms array<long>")


def term_counts(docs: DataFrame, text_col: str, terms: DataFrame, broadcast_rows: int) -> DataFrame:
    """(t, df): in how many distinct texts each of the terms is; each of n copies of a text counts 1/n."""
    few = terms.limit(broadcast_rows + 1).toArrow()
    known = None
    if few.num_rows <= broadcast_rows:
        known = docs.sparkSession.sparkContext.broadcast(HashSet(np.asarray(few["t"].combine_chunks()).view(np.uint64)))

    def count(texts, weight):
        """(term, sum of weights) of a batch."""
        found, share = [np.zeros(0, np.uint64)], [np.zeros(0)]
        for start, _, w in slices(texts, lower=True, punct=True):
            h, rows = w.hashes(), w.rows()
            if known is not None:
                at, _ = known.value.find(h)
                h, rows = h[at], rows[at]
            order = np.lexsort((h, rows))
            h, rows = h[order], rows[order]
            new = np.concatenate(([True], (h[1:] != h[:-1]) | (rows[1:] != rows[:-1]))) if len(h) else np.zeros(0, bool)
            found.append(h[new])
            share.append(weight[start + rows[new]])
        t, at = np.unique(np.concatenate(found), return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(np.bincount(at, np.concatenate(share), len(t)))], ["t", "n"])

    if known is not None and not len(known.value.values):
        return terms.select("t", F.lit(0).cast("long").alias("df")).limit(0)
    texts = docs.select(F.col(text_col).alias("t"), text_key(text_col).alias("x")).where("t is not null")
    copies = cut(texts.groupBy("x").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    # Only texts that may have copies are shuffled to learn how many.
    copied = BitFilter(copies, "x", copies.count())
    shared = copied.shared
    slotted = texts.withColumn("b", F.expr(copied.slot("x")))

    def single(batches):
        for b in batches:
            own = b.column("t").filter(pa.array(~hits(shared, b.column("b"))))
            yield count(own, np.ones(len(own)))

    def several(batches):
        for b in batches:
            yield b.filter(pa.array(hits(shared, b.column("b")))).select(["t", "x"])

    def weighed(batches):
        for b in batches:
            yield count(b.column("t"), 1 / np.asarray(b.column("n")))

    alone = slotted.select("t", "b").mapInArrow(single, "t long, n double")
    more = slotted.mapInArrow(several, "t string, x long").join(copies, "x", "left").select("t", F.coalesce("n", F.lit(1)).alias("n")).mapInArrow(weighed, "t long, n double")
    # Sums of 1/n are whole but for rounding.
    counts = alone.unionByName(more).groupBy("t").agg(F.round(F.sum("n")).cast("long").alias("df"))
    return counts if known is not None else counts.join(terms, "t")


def disclosing(docs: DataFrame, text_col: str = "text", reach: int = 8, support: int = 5, share: float = 0.5, bits: float = 6.0, broadcast_rows: int = 1 << 20) -> DataFrame:
    """(e, t): the terms that reveal a protected entity."""
    seen = mentions(docs, text_col, reach)
    near = seen.select("e", "x", "ctx", F.explode("terms").alias("t")).groupBy("e", "t")
    pairs = near.agg(F.count_distinct("ctx").alias("contexts"), F.count_distinct("x").alias("n_et")).where(F.col("contexts") >= support)
    total = docs.select(text_key(text_col).alias("x")).distinct().count()
    counts = term_counts(docs, text_col, pairs.select("t").distinct(), broadcast_rows)
    sizes = seen.select("e", "x").distinct().groupBy("e").agg(F.count(F.lit(1)).alias("n_e"))
    gain = F.log2(F.col("n_et") * F.lit(float(total)) / (F.col("n_e") * F.col("df")))
    return pairs.join(counts, "t").join(sizes, "e").where((F.col("n_et") >= share * F.col("df")) & (gain >= bits)).select("e", "t")


def _every(text: str, spans: list, terms: HashSet) -> list[tuple[int, int, int]]:
    """Base spans with those terms of the text."""
    words = _Terms(text, spans)
    at, _ = terms.find(words.hash)
    return spans + [(4, int(words.start[i]), int(words.end[i])) for i in at if words.free[i]]


def _judge_every(docs: DataFrame, text_col: str, schema, emit, pairs: DataFrame, broadcast_rows: int) -> DataFrame:
    """As ``_judge``, with the disclosing terms of all entities in every text."""
    k_name, terms_name = free_name(docs, "__k"), free_name(docs, "__terms")
    terms = pairs.select("t").distinct()
    few = terms.limit(broadcast_rows + 1).toArrow()
    shared, source = None, docs
    if few.num_rows <= broadcast_rows:
        own = np.asarray(few["t"].combine_chunks()) if few.num_rows else np.zeros(0, np.int64)
        shared = docs.sparkSession.sparkContext.broadcast(HashSet(own.view(np.uint64)))
    else:

        def words(batches):
            for b in batches:
                for at, _, w in slices(b.column("t"), lower=True, punct=True):
                    key = np.asarray(b.column("k"))[at + w.rows()]
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(w.hashes().view(np.int64))], ["k", "t"])

        key = text_key(text_col)
        held = docs.select(key.alias("k"), F.col(text_col).alias("t")).where("t is not null").mapInArrow(words, "k long, t long").distinct()
        held = held.join(terms, "t").groupBy(F.col("k").alias(k_name)).agg(F.collect_list("t").alias(terms_name))
        source = docs.withColumn(k_name, key).join(held, k_name, "left").drop(k_name)

    def run(batches):
        for b in batches:
            texts = b.column(text_col)
            found = {i: (spans, spans) for i, _, spans in _rows(texts)}
            if shared is not None:
                hit = [at + w.rows()[shared.value.find(w.hashes())[0]] for at, _, w in slices(texts, lower=True, punct=True)]
                rows = np.unique(np.concatenate(hit)).tolist() if hit else []
            else:
                own = b.column(terms_name)
                rows = [i for i in range(b.num_rows) if own[i].is_valid]
            for i in rows:
                spans = found[i][0] if i in found else []
                known = shared.value if shared is not None else HashSet(np.array(own[i].as_py(), np.int64).view(np.uint64))
                every = _every(texts[i].as_py(), spans, known)
                if every:
                    found[i] = (spans, every)
            yield emit(b, found)

    return source.mapInArrow(run, schema)


def _judge(docs: DataFrame, text_col: str, schema, emit, settings: dict) -> DataFrame:
    """mapInArrow over docs with emit(batch, {row: (base spans, all spans)})."""
    broadcast_rows = settings.get("broadcast_rows", 1 << 20)
    everywhere = settings.pop("everywhere", False)
    pairs = disclosing(docs, text_col, **settings)
    if everywhere:
        return _judge_every(docs, text_col, schema, emit, pairs, broadcast_rows)
    few = pairs.limit(broadcast_rows + 1).toArrow()
    if few.num_rows <= broadcast_rows:
        e, t = (np.asarray(few[c].combine_chunks()) if few.num_rows else np.zeros(0, np.int64) for c in ("e", "t"))
        order = np.argsort(e, kind="stable")
        shared = docs.sparkSession.sparkContext.broadcast((e[order], t[order].view(np.uint64)))
        source = docs
    else:
        shared = None
        k_name, pairs_name = free_name(docs, "__k"), free_name(docs, "__pairs")
        key = text_key(text_col)

        def named(batches):
            for b in batches:
                k, e = [], []
                for i, text, spans in _rows(b.column("t")):
                    own = {entity(kind, text[s:t]) for kind, s, t in spans}
                    k += [b.column("k")[i].as_py()] * len(own)
                    e += own
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(e, pa.int64())], ["k", "e"])

        texts = docs.select(key.alias("k"), F.col(text_col).alias("t")).where("t is not null").mapInArrow(named, "k long, e long").distinct()
        own = texts.join(pairs, "e").groupBy(F.col("k").alias(k_name)).agg(F.collect_list(F.struct("e", "t")).alias(pairs_name))
        source = docs.withColumn(k_name, key).join(own, k_name, "left").drop(k_name)

    def run(batches):
        for b in batches:
            found = {}
            for i, text, spans in _rows(b.column(text_col)):
                own = {entity(k, text[s:e]) for k, s, e in spans}
                if shared is not None:
                    e, t = shared.value
                    terms = [t[np.searchsorted(e, x, "left") : np.searchsorted(e, x, "right")] for x in own]
                else:
                    terms = [np.array([p["t"] for p in b.column(pairs_name)[i].as_py() or []], np.int64).view(np.uint64)]
                terms = np.concatenate(terms)
                found[i] = (spans, _every(text, spans, HashSet(terms)) if len(terms) else spans)
            yield emit(b, found)

    return source.mapInArrow(run, schema)


def _text(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term) for each row."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_term long"
    nothing = hashlib.sha256(b"").hexdigest()

    def emit(b, found):
        n = b.num_rows
        counts = np.zeros((len(KINDS), n), dtype=np.int64)
        sha, spans = [nothing] * n, [""] * n
        for i, (base, every) in found.items():
            for k, _, _ in every:
                counts[k, i] += 1
            sha[i] = hashlib.sha256(_text(base).encode()).hexdigest()
            spans[i] = _text(every)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c) for c in counts[:4]], pa.array(sha), pa.array(spans), pa.array(counts[4])], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_term"])

    return _judge(source, "t", schema, emit, settings)


def mask(text: str, spans) -> str:
    """text with each span as [KIND]; spans that overlap become one, named after the first."""
    out, low, end = [], 0, -1
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= end:
            out += [text[low:s], f"[{KINDS[k].upper()}]"]
        low = end = max(end, e)
    return "".join(out) + text[low:]


def redact(docs: DataFrame, text_col: str = "text", **settings) -> DataFrame:
    """docs with spans generalised in the text; the other columns stay."""
    names = docs.columns

    def emit(b, found):
        texts = b.column(text_col)
        if found:
            rows = sorted(found)
            new = pa.array([mask(texts[i].as_py(), found[i][1]) for i in rows], texts.type)
            put = np.zeros(b.num_rows, dtype=bool)
            put[rows] = True
            texts = pc.replace_with_mask(texts, pa.array(put), new)
        return pa.RecordBatch.from_arrays([texts if c == text_col else b.column(c) for c in names], names)

    return _judge(docs, text_col, docs.schema, emit, settings)
