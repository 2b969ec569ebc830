"""Chat formatting by rotating the perspective of a multi-party dialogue.

For every participant the dialogue is rendered with that speaker as the
assistant and all others as named users; the mask marks what the model is to
learn, the assistant's words and its end marks.  Speakers named in ``aside``
(the system) are nobody's perspective and keep their role.

A dialogue of any length is one rendering for each participant, stored in pieces
of ``PART`` turns: a piece's ``offset`` is the number of characters before it, so
the pieces of a rendering, joined in order, are the whole, and its mask is each
piece's moved by the offset.  Turns are numbered by a global sort, which spreads
a dialogue that holds most of the rows over many tasks (and rows that share a turn
number as well); no task gathers more than a piece.

Defined results: turns are ordered by number, a null number first, then speaker,
then text, so ties come in the order of speakers and texts; a null speaker is
called ``unknown``; a null text is empty; a null dialogue is a dialogue of its own;
marks of the format within a text are broken by a space; texts of any length are
rendered whole; a dialogue of only asides has no perspective and no row; repeated
rows are rendered as often as they are there; an empty table gives an empty
result; other columns, whatever their names, are passed by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import discarded, sized, written

#: Turns of a piece.
PART = 256
#: Rows of one partition of a written table are numbered from its number times this.
STRIDE = 1 << 33


def _own(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _head(role: Column, speaker: Column, aside: tuple[str, ...]) -> Column:
    name = F.when(role == speaker, F.lit("assistant")).when(role.isin(*aside) if aside else F.lit(False), role).otherwise(F.concat(F.lit("user name="), role))
    return F.concat(F.lit("<|im_start|>"), name, F.lit("\n"))


def _body(text: Column) -> Column:
    return F.concat(text, F.lit("<|im_end|>\n"))


def _same(a: DataFrame, b: DataFrame, *keys: str) -> Column:
    """Equal keys, nulls included."""
    on = a[keys[0]].eqNullSafe(b[keys[0]])
    for k in keys[1:]:
        on = on & a[k].eqNullSafe(b[k])
    return on


def numbered(rows: DataFrame, part: int) -> DataFrame:
    """rows: ``conv_id``, ``turn``, ``role``, ``text``.  The same, written, with ``at``, which grows with the order of turns, and ``piece``: which of a dialogue's pieces a turn is in."""
    rows = rows.orderBy(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text").select("*", F.monotonically_increasing_id().alias("at"))
    rows = written(rows, "chat-turns")
    spans = rows.groupBy("conv_id", F.expr(f"at div {STRIDE}").alias("span")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = written(spans.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "chat-spans")
    turns, spans = rows.withColumn("span", F.expr(f"at div {STRIDE}")), sized(spans, 80)
    found = turns.join(spans, _same(turns, spans, "conv_id", "span"))
    piece = F.floor((spans["before"] + turns["at"] - spans["first"]) / part).cast("long")
    pieces = written(found.select(turns["conv_id"], turns["role"], turns["text"], turns["at"], piece.alias("piece")), "chat-pieces")
    discarded(rows, spans)
    return pieces


def rotations(turns: DataFrame, aside: tuple[str, ...] = ("system",), part: int = PART) -> DataFrame:
    """turns: ``conv_id``, ``turn``, ``role``, ``text``.  ``conv_id``, ``speaker``, ``part``, ``offset``, ``n_turns``, ``text``, ``mask`` (spans of characters of ``text``)."""
    rows = turns.select("conv_id", F.col("turn").cast("long"), F.coalesce("role", F.lit("unknown")).alias("role"), _own(F.col("text")).alias("text"))
    rows = numbered(rows, part)

    # numbers alone: for each speaker and piece, how long the pieces before it are
    lengths = rows.groupBy("conv_id", "piece").agg(F.sum(F.length(_head(F.col("role"), F.lit(None).cast("string"), aside)) + F.length(_body(F.col("text")))).alias("plain"))
    said = rows.filter(~F.col("role").isin(*aside)) if aside else rows
    counts = said.groupBy("conv_id", F.col("role").alias("speaker"), "piece").agg(F.count("*").alias("own"))
    who = counts.select("conv_id", "speaker").distinct()
    each = lengths.join(who, _same(lengths, who, "conv_id")).select(lengths["conv_id"], "speaker", "piece", "plain")
    each = each.join(counts, _same(each, counts, "conv_id", "speaker", "piece"), "left").select(each["conv_id"], each["speaker"], each["piece"], "plain", F.coalesce("own", F.lit(0)).alias("own"))
    as_own = F.length(F.lit("assistant")) - F.length(F.lit("user name=")) - F.length("speaker")
    before = Window.partitionBy("conv_id", "speaker").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("offset", F.coalesce(F.sum(F.col("plain") + F.col("own") * as_own).over(before), F.lit(0)).cast("long")).select("conv_id", "speaker", "piece", "offset")

    # pieces first, so that the join copies a piece, not each turn, for each participant
    pieces = rows.groupBy("conv_id", "piece").agg(F.sort_array(F.collect_list(F.struct("at", "role", "text"))).alias("turns"))
    both = pieces.join(each, _same(pieces, each, "conv_id", "piece")).select(pieces["conv_id"], "speaker", pieces["piece"].alias("part"), "offset", "turns")

    def segment(t: Column) -> Column:
        head, body = _head(t.role, F.col("speaker"), aside), _body(t.text)
        return F.struct(F.concat(head, body).alias("text"), F.length(head).alias("head"), (F.length(head) + F.length(body)).alias("length"), (t.role == F.col("speaker")).alias("own"))

    both = both.withColumn("segments", F.transform("turns", segment))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("mask"))

    def add(state: Column, s: Column) -> Column:
        span = F.array(F.struct((state.at + s.head).alias("start"), (state.at + s.length - 1).alias("end")))
        return F.struct((state.at + s.length).alias("at"), F.when(s.own, F.concat(state.mask, span)).otherwise(state.mask).alias("mask"))

    folded = F.aggregate("segments", start, add, lambda s: s.mask)
    text = F.concat_ws("", F.transform("segments", lambda s: s.text))
    return both.select("conv_id", "speaker", "part", "offset", F.size("turns").alias("n_turns"), text.alias("text"), folded.alias("mask"))
