"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation is rendered as ``<s>`` and, per turn, ``[INST]`` role ``[/INST]`` text ``</s>``. The rendered text is parsed again by
a deterministic grammar, and a turn that does not come back as it was is escaped and rendered anew. Escaping puts one
backslash after the first character of a control string, and of a control string that has such backslashes already, so taking
one away gives the source back, whatever it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"


def escape(text: Column) -> Column:
    once = F.regexp_replace(text, r"<(\\*/?s>)", r"<\\$1")
    return F.regexp_replace(once, r"\[(\\*/?INST\])", r"[\\$1")


def unescape(text: Column) -> Column:
    once = F.regexp_replace(text, r"<\\(\\*/?s>)", "<$1")
    return F.regexp_replace(once, r"\[\\(\\*/?INST\])", "[$1")


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(CLOSE), text, F.lit(END))


def _parse_piece(piece: Column) -> Column:
    """One turn without its end: role and text, or null where the grammar does not allow it."""
    sides = F.split(piece, r"\[/INST\]", -1)
    head = F.get(sides, F.lit(0))
    role = F.substring(head, len(OPEN) + 1, 2**31 - 1)
    fits = (F.size(sides) == 2) & head.startswith(OPEN) & ~role.contains(OPEN) & ~piece.contains(BEGIN)
    fits &= ~F.get(sides, F.lit(1)).contains(OPEN)
    return F.when(fits, F.struct(unescape(role).alias("role"), unescape(F.get(sides, F.lit(1))).alias("text")))


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation as array<struct<role,text>>; a turn outside the grammar is null."""
    body = F.substring(formatted, len(BEGIN) + 1, 2**31 - 1)
    pieces = F.split(body, "</s>", -1)
    turns = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), _parse_piece)
    return F.when(formatted.startswith(BEGIN) & (F.element_at(pieces, -1) == ""), turns)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conversation: the rendered text, its turns as parsed back from it, and the loss mask.

    Input: conv_id, turn, role, text; other columns are ignored. A null role or text is empty, a null turn comes first, turns
    of equal number follow in order of role and text, and repeated rows are turns of their own. Rows without conv_id
    form one conversation. An empty table gives an empty result.

    Output: conv_id, n_turns, ``formatted``, ``turns`` (parsed from ``formatted``), ``loss_spans`` (start and length in UTF-8 bytes of
    each assistant text inside ``formatted``, as escaped there), ``escaped_turns``, ``round_trip`` (whether ``turns`` equals the
    source; always true). A conversation is one training example, and so one row: it is gathered by one task, whose memory
    must hold it. Everything before, escaping included, is done per turn.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("raw", render_turn(F.col("role"), F.col("text")))
    rows = rows.withColumn("back", parse(F.concat(F.lit(BEGIN), F.col("raw"))))
    rows = rows.withColumn("same", F.col("back").eqNullSafe(F.array(F.struct("role", "text"))))
    rows = rows.withColumn("shown", F.when(F.col("same"), F.col("text")).otherwise(escape(F.col("text"))))
    rows = rows.withColumn(
        "piece", F.when(F.col("same"), F.col("raw")).otherwise(render_turn(escape(F.col("role")), F.col("shown")))
    )
    rows = rows.select(
        "conv_id", "turn", "role", "text", "piece", "same",
        F.octet_length("shown").cast("long").alias("length"),
        F.octet_length("piece").cast("long").alias("size"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    nth = F.row_number().over(order)
    rows = rows.withColumns({"nth": nth, "end": before + len(BEGIN)})
    start = F.col("end") - len(END) - F.col("length")
    gathered = (
        rows.withColumn("span", F.struct(start.alias("start"), F.col("length").alias("length")))
        .groupBy("conv_id")
        .agg(
            F.sort_array(F.collect_list(F.struct("nth", "role", "text", "piece", "span"))).alias("all"),
            F.sum(F.when(F.col("same"), 0).otherwise(1)).alias("escaped_turns"),
        )
    )
    rendered = gathered.select(
        "conv_id",
        F.size("all").cast("long").alias("n_turns"),
        F.concat(F.lit(BEGIN), F.array_join(F.col("all.piece"), "")).alias("formatted"),
        F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"),
        F.transform(F.filter("all", lambda t: t["role"] == "assistant"), lambda t: t["span"]).alias("loss_spans"),
        "escaped_turns",
    )
    parsed = rendered.withColumn("turns", parse(F.col("formatted")))
    return parsed.select(
        "conv_id", "n_turns", "formatted", "turns", "loss_spans", "escaped_turns",
        F.col("turns").eqNullSafe(F.col("source")).alias("round_trip"),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped span by span, nothing between."""
    raw = formatted.cast("binary")
    one = lambda s: unescape(F.decode(F.substring(raw, (s["start"] + 1).cast("int"), s["length"].cast("int")), "UTF-8"))
    return F.array_join(F.transform(spans, one), "")


def digest_of_turns(turns: Column) -> Column:
    """Lowercase SHA-256 of role, line feed, text, line feed of each turn."""
    return F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
