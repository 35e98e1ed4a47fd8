"""Chat formatting in budgeted windows, with DataFrame operations only.

A conversation's turns are ordered by (turn, role, text), nulls first.  Prefix
sums of turn tokens cut it into turn-aligned windows.  Each window starts with
the conversation's first system turn (repeated when it is not new there), then
repeats turns just before it, then has its new turns.  The loss mask covers the
texts of new assistant turns only, so each of them is a target exactly once.

With ``room`` for the budget less the system turn, ``allowed`` for the history
(at most half the room) and ``stride`` for the rest, a turn belongs to the span
``floor((prefix_end - 1) / stride)``.  A turn reaches back to the turn before it
where both fit the room, else to its own start.  The turns of a span that reach
back over its start by more than ``allowed`` (at most two, the first ones) have
windows of their own, the other turns of the span share one.  So every window
fits the budget with the turn before its first new one.  On top of that turn, it
repeats as many as fit both the room and ``allowed``.

``oversize`` tells when a window passes the budget: only a turn that exceeds the
room by itself does that, and it is never cut.  Only such a turn, or one that
does not fit the room together with the turn before it, has no turn before it.

Prefix sums are two-level: sums inside chunks of ``chunk`` turn numbers, then
offsets over the chunks, so that no task has to hold a whole conversation.

Control strings inside roles and texts are escaped reversibly:
``&`` -> ``&amp;``, ``<|`` -> ``&lt;|``, and in roles a newline -> ``&#10;``.

Cases: null role or text counts as empty; a null conversation id is one
conversation; rows that repeat are turns like any other; empty tables give
empty results; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

START, END = "<|im_start|>", "<|im_end|>"
_FIRST_CHUNK, _LAST_PART = -(2**62), 2**62


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def unescape(text: Column) -> Column:
    for mark, char in (("&#10;", "\n"), ("&lt;", "<"), ("&amp;", "&")):
        text = F.replace(text, F.lit(mark), F.lit(char))
    return text


def estimated_tokens(text: Column) -> Column:
    """Four UTF-8 bytes a token, and four tokens for the marks around a turn."""
    return F.ceil(F.octet_length(text) / 4) + 4


def format_windows(turns: DataFrame, budget: int = 1024, history: int = 512, chunk: int = 256, tokens=estimated_tokens) -> DataFrame:
    """One row for each window of each conversation.

    (conv_id, span, part, formatted, n_context, loss_spans, n_tokens,
    oversize); windows follow each other by (span, part), ``n_context``
    turns at the start are repeated, ``loss_spans`` are (start, length) in
    code points of ``formatted``.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tok", tokens(F.col("text")).cast("long"))
    rows = rows.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / chunk), F.lit(_FIRST_CHUNK)))

    system = F.min(F.when(F.col("role") == "system", F.struct("turn", "role", "text", "tok")))
    last = F.max_by("tok", F.struct("turn", "role", "text"))
    sums = rows.groupBy("conv_id", "chunk").agg(F.sum("tok").alias("c_tok"), F.count(F.lit(1)).alias("c_n"), last.alias("c_last"), system.alias("c_sys"))
    ordered = Window.partitionBy("conv_id").orderBy("chunk")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("conv_id").alias("k_conv"), F.col("chunk").alias("k_chunk"),
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("c_tok", "c_n")],
        F.lag("c_last").over(ordered).alias("c_prev"),
        F.min("c_sys").over(Window.partitionBy("conv_id")).alias("sys"),
    )
    rows = rows.join(sums, F.col("conv_id").eqNullSafe(F.col("k_conv")) & (F.col("chunk") == F.col("k_chunk")))

    order = Window.partitionBy("conv_id", "chunk").orderBy(F.asc_nulls_first("turn"), "role", "text")
    room = F.greatest(F.lit(1), budget - F.coalesce("sys.tok", F.lit(0)))
    rows = (
        rows.withColumn("ord", F.col("c_n0") + F.row_number().over(order))
        .withColumn("end", F.col("c_tok0") + F.sum("tok").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("before", F.coalesce(F.lag("tok").over(order), F.col("c_prev"), F.lit(0)))
        .withColumn("room", room.cast("long"))
        .withColumn("allowed", F.least(F.lit(history), F.floor(F.col("room") / 2)))
        .withColumn("start", F.col("end") - F.col("tok"))
        .withColumn("stride", F.col("room") - F.col("allowed"))
        .withColumn("span", F.floor((F.greatest(F.lit(1), "end") - 1) / F.col("stride")))
        .withColumn("back", F.col("start") - F.when(F.col("before") + F.col("tok") <= F.col("room"), F.col("before")).otherwise(0))
        .withColumn("part", F.when(F.col("span") * F.col("stride") - F.col("back") > F.col("allowed"), F.col("ord")).otherwise(F.lit(_LAST_PART)))
        .withColumn("is_sys", F.coalesce(F.struct("turn", "role", "text", "tok").eqNullSafe(F.col("sys")), F.lit(False)))
    )
    keep = ["conv_id", "turn", "role", "text", "tok", "sys", "is_sys", "ord", "start", "end", "back", "span", "part", "room", "allowed", "stride"]
    rows = cut(rows.select(*keep))
    # Where each window's repeated turns may start; a window only meets turns of its own span and those within the room before it.
    least = F.greatest(F.max("end") - F.max("room"), F.least(F.min("start") - F.max("allowed"), F.min("back")))
    borders = rows.groupBy("conv_id", "span", "part").agg(least.alias("least"), F.min("ord").alias("first"))
    borders = borders.select(F.col("conv_id").alias("w_conv"), F.col("span").alias("w_span"), F.col("part").alias("w_part"), "least", "first")
    reached = F.explode(F.sequence("span", F.greatest("span", F.floor((F.col("start") + F.col("room") - 1) / F.col("stride")))))
    seats = rows.where(~F.col("is_sys")).select("conv_id", "ord", "start", reached.alias("at"))
    seats = seats.join(borders, F.col("conv_id").eqNullSafe(F.col("w_conv")) & (F.col("at") == F.col("w_span")) & (F.col("ord") < F.col("first")) & (F.col("start") >= F.col("least")))
    seats = seats.select("w_conv", F.col("ord").alias("w_ord"), "w_span", "w_part")
    again = rows.join(seats, F.col("conv_id").eqNullSafe(F.col("w_conv")) & (F.col("ord") == F.col("w_ord")))
    item = ["ord", "ctx", "role", "text", "tok", "turn"]
    new = rows.select("conv_id", "span", "part", F.lit(False).alias("ctx"), *[c for c in item if c != "ctx"], "sys", "is_sys")
    again = again.select("conv_id", F.col("w_span").alias("span"), F.col("w_part").alias("part"), F.lit(True).alias("ctx"), *[c for c in item if c != "ctx"], "sys", "is_sys")
    windows = new.unionByName(again).groupBy("conv_id", "span", "part").agg(F.sort_array(F.collect_list(F.struct(*item))).alias("items"), F.max("is_sys").alias("has_sys"), F.first("sys").alias("sys"))
    first = F.element_at("items", 1)
    keep_sys = F.col("sys").isNotNull() & ~F.col("has_sys") & (F.struct(first["turn"].alias("turn"), first["role"].alias("role"), first["text"].alias("text"), first["tok"].alias("tok")) > F.col("sys"))
    kept = F.array(F.struct(F.lit(0).cast("long").alias("ord"), F.lit(True).alias("ctx"), F.col("sys.role").alias("role"), F.col("sys.text").alias("text"), F.col("sys.tok").alias("tok"), F.col("sys.turn").alias("turn")))
    items = F.when(keep_sys, F.concat(kept, F.col("items"))).otherwise(F.col("items"))
    windows = windows.withColumn("items", items).withColumn(
        "parts",
        F.transform("items", lambda t: F.struct(F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"), (~t["ctx"] & (t["role"] == "assistant")).alias("target"))),
    )
    tail = f"{END}\n"
    nothing = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def place(acc, p):
        start, length = acc["pos"] + F.length(p["head"]), F.length(p["body"])
        spans = F.when(p["target"], F.concat(acc["spans"], F.array(F.struct(start.alias("start"), length.alias("length"))))).otherwise(acc["spans"])
        return F.struct((start + length + len(tail)).alias("pos"), spans.alias("spans"))

    used = F.aggregate("items", F.lit(0).cast("long"), lambda a, t: a + t["tok"])
    return windows.select(
        "conv_id", "span", "part",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(tail))), "").alias("formatted"),
        F.size(F.filter("items", lambda t: t["ctx"])).alias("n_context"),
        F.aggregate("parts", nothing, place)["spans"].alias("loss_spans"),
        used.alias("n_tokens"), (used > budget).alias("oversize"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Digest columns of each conversation, parsed from the formatted windows alone."""
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>"), F.col("n_context") + 2, F.size(F.split("formatted", r"<\|im_start\|>")))
    turns = F.transform(pieces, lambda p: F.concat(unescape(F.substring(p, F.lit(1), F.length(p) - len(END) - 1)), F.lit("\n")))
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    parsed = windows.select("conv_id", "span", "part", F.size(pieces).alias("n"), F.array_join(turns, "").alias("turns"), F.array_join(loss, "").alias("loss"), F.length("formatted").alias("chars"))
    whole = parsed.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list(F.struct("span", "part", "turns", "loss"))).alias("all"))
    joined = lambda field: F.array_join(F.transform("all", lambda w: w[field]), "")
    return whole.select(
        "conv_id", "n_turns",
        F.sha2(joined("turns"), 256).alias("turns_sha256"),
        F.length(joined("loss")).cast("long").alias("loss_chars"),
        F.sha2(joined("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
