"""Mixing sources to target weights by hierarchical budgets.

The sources form a tree (by default domain, language, source).  A node can
give the tokens below it, times ``max_epochs``; leaves that a weight of 0 shuts
off can give nothing, at any level.  The token budget enters at the root and
goes down level by level in proportion to the children's weights; what
a child cannot give is shared among its siblings, again by weight, until each
has its part or is exhausted, so a shortage leaves a family only when the whole
family is short.  A leaf's quota is then a prefix of its stream of seeded
epochs: each epoch is the leaf's documents in an order hashed from seed, epoch
and id, so whole epochs come first and the last one stops at the quota.  The
order depends on these three only, not on how many documents there are.

A leaf may hold a third of all rows.  The place where its last epoch stops is
therefore looked for by the bits of the hash: tokens are summed by the first
``BITS`` bits, only rows in the range in which the quota falls go on to the next
bits, and once a few rows of each leaf are left they are looked at one by one.
The outcome is one cut for each leaf; a row's place is decided by
comparing its own hash with its leaf's cut.

Defined results: null levels form a node of their own (named ``~``); a null
weight counts as weight 1, a weight of 0 or less gives nothing; documents
without tokens (null, empty or blank texts) are never chosen; texts of any length
are counted whole; a null id hashes as ``~``; rows with the same id
share one place and are chosen together, each cut in the same proportion; nodes
that tie are filled in the order of their names; a remainder of less than one
token for each child stays unspent; an empty table gives an empty result; other
columns, whatever their names, are kept, but a level must not have one of the
names in ``RESERVED``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import BROADCAST_BYTES, OWN, discarded, sized, spread_join, without_own, written

#: Bits of a row's hash, and how many of them are looked at in one step.
HASH_BITS, BITS = 60, 8
#: Rows of a leaf that are looked at one by one.
FEW = 256
WORD = r"[^\x20\x09-\x0D]+"
SPACED_WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"
RESERVED = {"tokens", "full", "rest", "hash", "prefix", "times", "copy", "cut_hash", "cut_doc", "part", "whole", "rows", "quota"}


@dataclass(frozen=True)
class Mix:
    """levels: a name for each level and the column it is made of, from the root down.
    weights: for each level, the weights of its nodes; others weigh 1.
    budget: the share of all tokens that is asked for."""

    levels: dict[str, Column]
    weights: dict[str, dict[str, int]] = field(default_factory=dict)
    budget: float = 0.8
    max_epochs: int = 2
    seed: int = 17

    def __post_init__(self) -> None:
        if RESERVED & set(self.levels):
            raise ValueError(f"levels must not be named {', '.join(sorted(RESERVED & set(self.levels)))}")

    @property
    def names(self) -> list[str]:
        return [OWN + n for n in self.levels]


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _weight(mix: Mix, level: str) -> Column:
    known = mix.weights.get(level) or {}
    if not known:
        return F.lit(1)
    return F.coalesce(F.create_map(*[F.lit(x) for pair in known.items() for x in pair])[F.col(OWN + level)], F.lit(1))


def _share(nodes: DataFrame, parents: list[str], name: str, weight: Column) -> DataFrame:
    """Give each node its part ``got`` of its parent's ``budget``; ``cap`` is what it can give."""
    w = nodes.withColumn("weight", weight.cast("long")).withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    family = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))  # the root's children, already added up
    before = family.orderBy("ratio", name).rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
    w = w.withColumn("weight_left", F.sum("weight").over(family) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    w = w.withColumn("level", (F.col("budget") - F.col("cap_before")).cast("double") / F.col("weight_left"))
    w = w.withColumn("full", F.col("ratio") <= F.col("level"))
    rest = F.max(F.when(~F.col("full"), F.col("level"))).over(family)
    got = F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), F.greatest(F.floor(F.col("weight") * rest), F.lit(0))))
    return w.withColumn("got", got.cast("long")).drop("budget", "weight", "ratio", "cap_before", "weight_left", "level", "full")


def quotas(leaves: DataFrame, mix: Mix) -> DataFrame:
    """leaves: the level columns, ``n_tokens``.  Adds ``quota``, 0 for leaves that a weight shuts off."""
    open_ = F.lit(True)
    for n in mix.levels:
        open_ = open_ & (_weight(mix, n) > 0)
    usable = leaves.filter(open_ & (F.col("n_tokens") > 0)).withColumn("cap", F.col("n_tokens") * mix.max_epochs)
    asked = leaves.agg(F.floor(F.coalesce(F.sum("n_tokens"), F.lit(0)) * F.lit(mix.budget)).cast("long").alias("asked"))
    able = usable.agg(F.coalesce(F.sum("cap"), F.lit(0)).alias("able"))
    above = asked.crossJoin(F.broadcast(able)).select(F.least("asked", "able").alias("budget"))  # a row each
    for k, name in enumerate(mix.levels):
        names = mix.names[: k + 1]
        nodes = usable.groupBy(*names).agg(F.sum("cap").alias("cap"))
        nodes = nodes.join(above, names[:k]) if k else nodes.join(F.broadcast(above))  # a single row
        nodes = _share(nodes, names[:k], names[k], _weight(mix, name))
        above = nodes.select(*names, F.col("got").alias("budget"))
    return leaves.join(above.withColumnRenamed("budget", "quota"), mix.names, "left").withColumn("quota", F.coalesce("quota", F.lit(0)))


def _levels(docs: DataFrame, mix: Mix) -> DataFrame:
    """``docs`` with its leaf in columns of our own."""
    return docs.withColumns({OWN + n: F.coalesce(c.cast("string"), F.lit("~")) for n, c in mix.levels.items()})


def _hashed(rows: DataFrame, mix: Mix) -> DataFrame:
    """Adds each row's place in its leaf's last, partial epoch: hash, then id."""
    name = F.concat_ws(":", F.lit(mix.seed), F.col(OWN + "full").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("~")))
    return rows.withColumn(OWN + "hash", F.conv(F.substring(F.md5(name.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long"))


def _by_leaf(rows: DataFrame, leaves: DataFrame, mix: Mix) -> DataFrame:
    """rows joined with a table of leaves, a few numbers each; a leaf with most of the rows stays spread."""
    if leaves.count() * 600 <= BROADCAST_BYTES:
        return rows.join(F.broadcast(leaves), mix.names)
    return spread_join(rows, leaves, mix.names, OWN + "rows")


def _stops(rows: DataFrame, most: int, mix: Mix) -> DataFrame:
    """rows: hash, id, tokens and leaf of each row with tokens, and its leaf's ``rest``.  For each leaf the last place of which tokens are taken, how many, and how many there are."""
    names, rest, shift = mix.names, OWN + "rest", HASH_BITS
    now, held = rows.withColumn("before", F.lit(0).cast("long")), None
    while most > FEW and shift:
        shift = max(0, shift - BITS)
        at = F.shiftright(OWN + "hash", shift)
        sums = now.groupBy(*names, rest, "before", at.alias("at")).agg(F.sum(OWN + "tokens").alias("in"))
        upto = Window.partitionBy(*names).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("end", F.col("before") + F.sum("in").over(upto)).withColumn("start", F.col("end") - F.col("in"))
        cut = written(sums.filter(f"start <= {rest} and {rest} < end").select(*names, "at", F.col("start").alias("before")), "mix-range")
        former, held = held, written(now.drop("before").join(sized(cut, 400), names).filter(at == F.col("at")).drop("at"), "mix-rows")
        if former is not None:
            discarded(former)
        now = held
        most = now.groupBy(*names).count().agg(F.max("count")).first()[0] or 0
    near = now.groupBy(*names, OWN + "hash", "doc_id", rest, "before").agg(F.sum(OWN + "tokens").alias("in"))
    upto = Window.partitionBy(*names).orderBy(OWN + "hash", F.col("doc_id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("start", F.col("before") + F.sum("in").over(upto) - F.col("in")).filter(f"start < {rest}")
    last = near.groupBy(*names).agg(F.max(F.struct("start", F.col(OWN + "hash").alias("h"), F.col("doc_id").alias("d"), (F.col(rest) - F.col("start")).alias("part"), F.col("in").alias("whole"))).alias("x"))
    return last.select(*names, F.col("x.h").alias(OWN + "cut_hash"), F.col("x.d").alias(OWN + "cut_doc"), F.col("x.part").alias(OWN + "part"), F.col("x.whole").alias(OWN + "whole"))


def plan(counted: DataFrame, mix: Mix) -> DataFrame:
    """counted: written rows with leaf, ``doc_id`` and tokens.  One row for each leaf: whole epochs, and where its last epoch stops."""
    names = mix.names
    leaves = counted.groupBy(*names).agg(F.count("*").alias(OWN + "rows"), F.sum(OWN + "tokens").alias("n_tokens"))
    leaves = quotas(written(leaves, "mix-sums"), mix)
    whole = F.greatest("n_tokens", F.lit(1))
    leaves = written(leaves.select(*names, OWN + "rows", F.expr("quota div greatest(n_tokens, 1)").alias(OWN + "full"), (F.col("quota") % whole).alias(OWN + "rest")), "mix-leaves")
    most = leaves.agg(F.max(OWN + "rows")).first()[0] or 0
    rows = _by_leaf(counted.filter(F.col(OWN + "tokens") > 0), leaves, mix).drop(OWN + "rows")
    last = _stops(_hashed(rows, mix).select(*names, "doc_id", OWN + "tokens", OWN + "rest", OWN + "hash"), most, mix)
    return written(leaves.join(last, names, "left"), "mix-plan")


def _taken(mix: Mix) -> tuple[Column, Column]:
    """Of rows with hash and plan: whether the last epoch stops behind this row, and whether it stops in it."""
    h, cut_h, cut_d = F.col(OWN + "hash"), F.col(OWN + "cut_hash"), F.col(OWN + "cut_doc")
    same = F.col("doc_id").eqNullSafe(cut_d)
    earlier = (h < cut_h) | ((h == cut_h) & ~same & (cut_d.isNull() | (F.col("doc_id") < cut_d)))
    return F.coalesce(earlier, F.lit(False)), F.coalesce((h == cut_h) & same, F.lit(False))


def _part(n: Column) -> Column:
    """How many of a row's ``n`` tokens are taken where the last epoch stops in it."""
    return F.least(n, F.greatest(F.lit(1), F.floor(F.col(OWN + "part") * n / F.col(OWN + "whole")))).cast("long")


def mixed(docs: DataFrame, mix: Mix, keep: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` (of its columns ``keep`` and ``doc_id``, or all) with ``__loom_full`` (whole epochs) and ``__loom_prefix`` (its tokens in the last one).

    Tokens are counted once, into a written table of these columns.
    """
    kept = docs.columns if keep is None else [*dict.fromkeys(["doc_id", *keep])]
    rows = written(_levels(docs, mix).select(*kept, *mix.names, tokens(F.col("text")).alias(OWN + "tokens")), "mix-tokens")
    rows = _hashed(_by_leaf(rows, plan(rows, mix), mix), mix)
    n = F.col(OWN + "tokens")
    earlier, at_cut = _taken(mix)
    prefix = F.when(n == 0, 0).when(earlier, n).when(at_cut, _part(n)).otherwise(0)
    return rows.withColumns({OWN + "full": F.when(n > 0, F.col(OWN + "full")).otherwise(0).cast("long"), OWN + "prefix": prefix.cast("long")})


def _first_words(text: Column, n: Column) -> Column:
    """The first ``n`` words of ``text``, with the white space before each."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(SPACED_WORD), F.lit(0)), F.lit(1), n.cast("int")), "")


def drawn(docs: DataFrame, mix: Mix) -> DataFrame:
    """The mixture itself: each chosen document once for every epoch that it is in, with the columns of ``docs``.

    The document in which a leaf's last epoch stops is cut to its prefix there, and ``n_chars``, if there is one, follows.
    Tokens are counted for the plan; after it only those of documents at a cut are counted again.
    """
    counted = written(_levels(docs, mix).select("doc_id", *mix.names, tokens(F.col("text")).alias(OWN + "tokens")), "mix-tokens")
    rows = _hashed(_by_leaf(_levels(docs, mix), plan(counted, mix), mix), mix)
    discarded(counted)
    some = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    earlier, at_cut = _taken(mix)
    rows = rows.withColumn(OWN + "times", F.when(some, F.col(OWN + "full") + (earlier | at_cut).cast("long")).otherwise(0).cast("int")).filter(F.col(OWN + "times") > 0)
    rows = rows.withColumn(OWN + "copy", F.explode(F.sequence(F.lit(1), F.col(OWN + "times"))))
    n = tokens(F.col("text"))
    rows = rows.withColumn(OWN + "prefix", F.when((F.col(OWN + "copy") > F.col(OWN + "full")) & at_cut, F.nullif(_part(n), n)))
    cut = F.col(OWN + "prefix").isNotNull()
    rows = rows.withColumn("text", F.when(cut, _first_words(F.col("text"), F.col(OWN + "prefix"))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return without_own(rows).select(*docs.columns)
