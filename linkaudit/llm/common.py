"""What the operators of this subpackage share: stored tables, tables of a folder, running totals."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkaudit.session import checkpoint_dir


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under the checkpoint folder that all executors share; nothing is created."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it from there.

    Steps that several passes read, and rounds of an iteration, go through here: lost executors
    cost the running step only, and the next plan knows the size of what it reads.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or the first name made from it that no column of ``df`` has (case is ignored)."""
    taken = {c.lower() for c in df.columns}
    name = wanted
    while name.lower() in taken:
        name = f"_{name}"
    return name


def hash_unit(*parts: Column | str) -> Column:
    """A draw in (0, 1) from MD5 of the parts, the same in every engine; 52 bits, exact in a double."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string") if isinstance(p, Column) else F.lit(p), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def running_total(
    df: DataFrame,
    groups: list[str],
    draw: str,
    order: list[str],
    value: str,
    into: str,
    rows_per_bucket: int = 20_000,
) -> DataFrame:
    """Add ``into``: the sum of ``value`` over the earlier rows of the group, by ``draw``, then ``order``.

    ``draw`` is a number in [0, 1) spread evenly over the rows of a group, so a group is cut into
    buckets of the draw; each is summed on its own and starts at the total of the buckets before
    it. No task holds a whole group, however large. ``df`` is read twice and must be stable.
    """
    bucket = free_name(df, "__bucket")
    before, last = free_name(df, "__before"), free_name(df, "__in_bucket")
    n = max(1, math.ceil(df.count() / rows_per_bucket))
    cut = df.withColumn(bucket, F.floor(F.col(draw) * n).cast("int"))
    totals = cut.groupBy(*groups, bucket).agg(F.sum(value).alias(last))
    # at most ``n`` rows a group: the totals of the buckets, not their rows
    totals = totals.withColumn(
        before,
        F.sum(last).over(Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)),
    ).drop(last)
    other = {g: free_name(df, f"__total_{g}") for g in (*groups, bucket)}
    t = totals.select(*[F.col(g).alias(name) for g, name in other.items()], F.col(before))
    on = [F.col(g).eqNullSafe(F.col(other[g])) for g in groups] + [F.col(bucket) == F.col(other[bucket])]
    joined = cut.join(t, on)
    within = Window.partitionBy(*groups, bucket).orderBy(draw, *order).rowsBetween(Window.unboundedPreceding, -1)
    out = joined.withColumn(into, F.coalesce(F.col(before), F.lit(0)) + F.coalesce(F.sum(value).over(within), F.lit(0)))
    return out.drop(bucket, before, *other.values())
