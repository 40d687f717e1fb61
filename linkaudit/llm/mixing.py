"""Temperature mixing of sources.

The share of each source in the tokens is raised to an exponent and normalised: 1 keeps the shares,
0 makes them equal. The exponent is bisected, either until the weights have a wanted entropy or until
no source is repeated more often than allowed; the larger of both holds. The weights then become whole
numbers of tokens: a source is read in epochs, each a permutation of its documents by hash, and the
last epoch ends where the source's budget does. The epochs are dealt to blocks by tokens, so each
block has every source's share, and are permuted within the block.

All steps on rows are projections, partial sums and joins with a table of one row per source; running totals
are made per slice of the hash, so a source with a third of all rows is spread like any other.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkaudit.llm.common import free_name, hash_unit, running_total, stored

_AT_ONCE = 31  # exponents tried in one pass: five halvings
_PASSES = 8


def token_estimate(text: Column) -> Column:
    """A token for every four bytes of UTF-8 and one for the end of the document; a null text has that one."""
    return F.floor(F.length(F.coalesce(text, F.lit("")).cast("binary")) / 4).cast("long") + 1


def _bisected(shares: DataFrame, high: float, aims: list[Callable[[float], Column]]) -> list[float]:
    """For each aim the least exponent in [0, ``high``], to 40 halvings, that is not too flat.

    An aim maps an exponent to the condition, on sums over ``log_p``, that it is too flat. One pass over the sources tries several
    exponents for all aims, and one row comes back.
    """
    lows, step = [0.0] * len(aims), high / (_AT_ONCE + 1)
    for _ in range(_PASSES):
        tried = [aim(low + step * k) for aim, low in zip(aims, lows) for k in range(1, _AT_ONCE + 1)]
        flags = list(map(bool, shares.agg(*[c.alias(f"x{k}") for k, c in enumerate(tried)]).first()))
        lows = [low + step * sum(flags[n * _AT_ONCE : (n + 1) * _AT_ONCE]) for n, low in enumerate(lows)]
        step /= _AT_ONCE + 1
    return [low + step * (_AT_ONCE + 1) for low in lows]


def exponent(
    shares: DataFrame, tokens: int, budget: int, entropy_share: float | None, max_repeats: float | None, high: float = 1.0
) -> float:
    """The exponent for sources with ``log_p``; rounded to nine digits.

    ``entropy_share``: the entropy aimed at, as a share of that of equal weights. ``max_repeats``: how often
    a source may be read. Where no exponent up to ``high`` meets an aim, ``high`` is taken.
    """
    log_p = F.col("log_p")

    def norm(x: float) -> Column:
        return F.sum(F.exp(log_p * x))

    def entropy_above(x: float) -> Column:
        mean = F.sum(F.exp(log_p * x) * log_p * x) / norm(x)
        return F.log(norm(x)) - mean > F.log(F.count("*").cast("double")) * entropy_share

    def repeats_above(x: float) -> Column:
        return F.max(F.exp(log_p * (x - 1))) / norm(x) * (budget / max(1, tokens)) > max_repeats

    aims = ([entropy_above] if entropy_share else []) + ([repeats_above] if max_repeats else [])
    return round(max(_bisected(shares, high, aims)), 9) if aims else 1.0


def mixing_plan(
    rows: DataFrame, budget: int | None = None, entropy_share: float | None = 0.95, max_repeats: float | None = 4.0, seed: str = "mix",
    rows_per_slice: int = 20_000,
) -> DataFrame:
    """One row per ``source`` of ``rows`` (``id``, ``source``, ``tokens``): ``source_tokens``, ``weight``, ``quota``,
    ``epochs`` (whole ones) and ``cut``: the last epoch takes the rows whose draw is below it.

    ``budget`` is in tokens; without one, as many as there are. ``rows`` is read several times and must be stable.
    """
    sources = stored(rows.groupBy("source").agg(F.sum("tokens").alias("source_tokens"), F.count("*").alias("n")), "sources")
    total, n = sources.agg(F.sum("source_tokens"), F.sum("n")).first()
    total, n = total or 0, n or 0
    budget = total if budget is None else budget
    shares = sources.withColumn("log_p", F.log(F.col("source_tokens") / F.lit(float(max(1, total)))))
    x = exponent(shares, total, budget, entropy_share, max_repeats) if total else 1.0
    norm = (shares.agg(F.sum(F.exp(F.col("log_p") * x))).first()[0] or 1.0) if total else 1.0
    weighted = shares.withColumn("weight", F.exp(F.col("log_p") * x) / F.lit(norm)).withColumn("quota", F.round(F.col("weight") * F.lit(float(budget))).cast("long"))
    weighted = weighted.withColumn("epochs", F.floor(F.col("quota") / F.col("source_tokens")).cast("int"))
    weighted = weighted.withColumn("rest", F.col("quota") - F.col("epochs") * F.col("source_tokens")).drop("log_p", "n")
    weighted = stored(weighted, "weights")

    # where the last epoch ends: first the slice of draws, then the row inside this slice
    slices = max(1, math.ceil(n / rows_per_slice))
    last = weighted.select(F.col("source").alias("of"), "epochs", "rest")
    drawn = rows.join(last, F.col("source").eqNullSafe(F.col("of"))).select("source", "tokens", "rest", draw_of("id", F.col("epochs"), seed).alias("draw"))
    drawn = stored(drawn.withColumn("slice", F.floor(F.col("draw") * slices).cast("int")), "draws")
    ordered = Window.partitionBy("source").orderBy("slice")
    sums = drawn.groupBy("source", "slice").agg(F.sum("tokens").alias("in_slice"), F.first("rest").alias("rest"))
    sums = sums.withColumn("upto", F.sum("in_slice").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    ends = sums.where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("in_slice") <= F.col("rest")))
    ends = ends.select(F.col("source").alias("of"), F.col("slice").alias("end_slice"), (F.col("rest") - F.col("upto") + F.col("in_slice")).alias("left"))
    crossing = drawn.join(ends, F.col("source").eqNullSafe(F.col("of")) & (F.col("slice") == F.col("end_slice"))).select("source", "draw", "tokens", "left")
    inside = Window.partitionBy("source").orderBy("draw").rowsBetween(Window.unboundedPreceding, 0)
    over = crossing.withColumn("upto", F.sum("tokens").over(inside)).where(F.col("upto") > F.col("left"))
    cuts = over.groupBy(F.col("source").alias("of")).agg(F.min("draw").alias("cut"))
    plan = weighted.join(cuts, F.col("source").eqNullSafe(F.col("of")), "left").drop("of", "rest")
    return stored(plan.withColumn("cut", F.coalesce("cut", F.lit(0.0))), "plan")


def draw_of(id_col: str, epoch: Column, seed: str) -> Column:
    """The place of a document in the permutation of an epoch, in (0, 1)."""
    return hash_unit(seed, epoch, F.col(id_col))


def copies(rows: DataFrame, plan: DataFrame, id_col: str, source_col: str, seed: str = "mix", epoch: str = "epoch") -> DataFrame:
    """``rows`` once for each epoch that takes them, with all their columns and ``epoch``."""
    of, epochs, cut = (free_name(rows, n) for n in ("__of", "__epochs", "__cut"))
    joined = rows.join(plan.select(F.col("source").alias(of), F.col("epochs").alias(epochs), F.col("cut").alias(cut)), F.col(source_col).eqNullSafe(F.col(of)))
    taken = F.col(epochs) + (draw_of(id_col, F.col(epochs), seed) < F.col(cut)).cast("int")
    return joined.where(taken > 0).withColumn(epoch, F.explode(F.sequence(F.lit(0), taken - 1))).drop(of, epochs, cut)


def _rows(docs: DataFrame, id_col: str, source_col: str, text_col: str, tokens: Column | None) -> DataFrame:
    n = token_estimate(F.col(text_col)) if tokens is None else tokens
    return stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n.alias("tokens")), "rows")


def schedule(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", tokens: Column | None = None,
    blocks: int = 64, seed: str = "mix", **aims,
) -> DataFrame:
    """One row per copy of a document in the mix: id, source, ``epoch``, ``tokens``, ``block`` and ``place``, the order in the block.

    ``tokens`` is a column with counts above 0, by default an estimate from the bytes of the text; ``aims`` are those of
    ``mixing_plan``. Null sources are a source of their own; rows with equal ids are taken or left together; an
    empty table gives an empty result.
    """
    rows = _rows(docs, id_col, source_col, text_col, tokens)
    plan = mixing_plan(rows, seed=seed, **aims)
    chosen = copies(rows, plan, "id", "source", seed).withColumn("draw", draw_of("id", F.col("epoch"), seed))
    chosen = running_total(stored(chosen, "copies"), ["source", "epoch"], "draw", ["id", "tokens"], "tokens", "before")
    size = plan.select(F.col("source").alias("of"), "source_tokens", "quota")
    dealt = chosen.join(size, F.col("source").eqNullSafe(F.col("of")))
    block = F.floor((F.col("epoch") * F.col("source_tokens") + F.col("before")) * blocks / F.col("quota")).cast("int")
    return dealt.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "epoch", "tokens", block.alias("block"),
        hash_unit(seed, "place", F.col("epoch"), F.col("id")).alias("place"),
    )


def mixed(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", tokens: Column | None = None, seed: str = "mix", **aims
) -> DataFrame:
    """The documents as the mix has them: with their own columns, once for each epoch that takes them. The text is not shuffled."""
    plan = mixing_plan(_rows(docs, id_col, source_col, text_col, tokens), seed=seed, **aims)
    epoch = free_name(docs, "__epoch")
    return copies(docs, plan, id_col, source_col, seed, epoch).drop(epoch)
