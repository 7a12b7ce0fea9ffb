"""Ordered work over keyed rows, balanced also when one key holds most of the rows.

Two plan shapes are built here.  When every key is small (checked by a count over
the key columns), an ordinary window per key does the work.  When some key is large:

* running totals are taken per (key, order bucket) and the totals of the earlier
  buckets are added, so no task sees a whole key;
* bounded frames are evaluated per (key, chunk of positions), where every chunk also
  receives copies of the neighbouring rows that its frames reach.

Both shapes return the same rows and the same values.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.sizing import group_rows_limit, is_large, join_on
from tidemark.spec import SeriesSpec

BUCKET = "_bucket"
POS = "_pos"
CHUNK = "_chunk"


def order_value(df: DataFrame, column: str) -> Column:
    """The column as a double that never decreases when the column increases."""
    kind = df.schema[column].dataType
    c = F.col(column)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        days = F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date"))
        return (days * 86400.0 + F.hour(c) * 3600.0 + F.minute(c) * 60.0 + F.second(c)).cast("double")
    if isinstance(kind, T.DateType):
        return F.datediff(c, F.lit("1970-01-01").cast("date")).cast("double")
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    if isinstance(kind, T.StringType):
        # Six bytes as a number, behind what all values have in common; strings order by their bytes.
        ends = df.agg(F.min(c), F.max(c)).first()
        same = os.path.commonprefix([(v or "").encode() for v in ends])
        head = F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), len(same) + 1, 6)), 12, "0")
        return F.conv(head, 16, 10).cast("double")
    raise TypeError(f"{column}: ordering by {kind.simpleString()} cannot be bucketed")


def with_order_bucket(df: DataFrame, column: str, rows_per_bucket: int) -> DataFrame:
    """Add an equal-depth bucket of ``column`` that follows its order.

    The cuts come from one mergeable quantile sketch over the whole table, so a
    bucket holds about ``rows_per_bucket`` rows in total and no more of any key.
    """
    value = order_value(df, column)
    total = df.count()
    buckets = max(2, -(-total // rows_per_bucket))
    fractions = [i / buckets for i in range(1, buckets)]
    found = df.agg(F.percentile_approx(value, fractions, 10 * buckets).alias("cuts")).first()["cuts"]
    cuts = sorted(set(found or []))
    splits = [float("-inf"), *cuts, float("inf")]
    bucketizer = Bucketizer(inputCol="_order_value", outputCol=BUCKET, splits=splits, handleInvalid="keep")
    out = bucketizer.transform(df.withColumn("_order_value", value)).drop("_order_value")
    return out.withColumn(BUCKET, F.coalesce(F.col(BUCKET).cast("int"), F.lit(-1)))


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column],
    descending: bool = False,
    large: bool | None = None,
) -> DataFrame:
    """Add inclusive running sums per key in the given order.

    ``order`` must be a total order inside a key.  The first column decides the
    buckets of the split plan.  ``large`` tells what a caller already knows about the
    size of the keys.
    """
    sort = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if not (is_large(df, keys) if large is None else large):
        w = upto(Window.partitionBy(*keys).orderBy(*sort))
        return df.select("*", *[F.sum(c).over(w).alias(name) for name, c in sums.items()])

    parts = with_order_bucket(df, order[0], max(1, group_rows_limit(df.sparkSession) // 2))
    totals = parts.groupBy(*keys, BUCKET).agg(*[F.sum(c).alias(f"_t_{name}") for name, c in sums.items()])
    bucket_order = F.col(BUCKET).desc() if descending else F.col(BUCKET).asc()
    before = Window.partitionBy(*keys).orderBy(bucket_order).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys, BUCKET, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sums]
    )
    w = upto(Window.partitionBy(*keys, BUCKET).orderBy(*sort))
    local = parts.select("*", *[F.sum(c).over(w).alias(f"_l_{name}") for name, c in sums.items()])
    joined = join_on(local, carried, [*keys, BUCKET])
    return joined.select(*df.columns, *[(F.col(f"_l_{n}") + F.col(f"_c_{n}")).alias(n) for n in sums])


def with_position(df: DataFrame, spec: SeriesSpec, out: str = POS) -> DataFrame:
    """Add the 1-based position of each row in its series."""
    return running_sums(df, spec.series, spec.order, {out: F.lit(1).cast("long")})


def with_length(df: DataFrame, spec: SeriesSpec, out: str = "_len") -> DataFrame:
    """Add the number of rows of the series to each of its rows."""
    sizes = df.groupBy(*spec.series).agg(F.count(F.lit(1)).alias(out))
    return join_on(df, sizes, spec.series)


def chunked(df: DataFrame, spec: SeriesSpec, chunk_rows: int, back: int, ahead: int = 0) -> DataFrame:
    """Cut positioned series into chunks and copy the rows that frames reach.

    Adds ``_chunk`` and ``_own``; a copy has ``_own`` false and only serves frames.
    """
    if chunk_rows <= max(back, ahead):
        raise ValueError("a chunk must be longer than the frames that cross its edge")
    zero = F.col(POS) - 1
    home = F.floor(zero / chunk_rows).cast("long")
    offset = zero % chunk_rows
    homes = F.array_compact(
        F.array(
            home,
            F.when(offset >= chunk_rows - back, home + 1),
            F.when((offset < ahead) & (home > 0), home - 1),
        )
    )
    spread = df.withColumn("_home", home).withColumn(CHUNK, F.explode(homes))
    return spread.withColumn("_own", F.col(CHUNK) == F.col("_home")).drop("_home")


def over_series(
    df: DataFrame,
    spec: SeriesSpec,
    build: Callable[[DataFrame, SeriesSpec], DataFrame],
    back: int,
    ahead: int = 0,
    large: bool | None = None,
) -> DataFrame:
    """Run a builder of bounded-frame window columns over every series.

    ``build`` receives rows that carry ``_pos`` and a spec whose key it must use
    for its windows.  Its frames may reach ``back`` rows back and ``ahead`` rows
    forward.  ``_pos`` stays in the result.
    """
    if not (is_large(df, spec.series) if large is None else large):
        return build(df.withColumn(POS, F.row_number().over(spec.window()).cast("long")), spec)
    rows = max(group_rows_limit(df.sparkSession) // 2, 2 * max(back, ahead) + 1)
    cut = chunked(with_position(df, spec), spec, rows, back, ahead)
    inner = SeriesSpec((*spec.series, CHUNK), spec.order, spec.row_id)
    return build(cut, inner).filter("_own").drop(CHUNK, "_own")


def sorted_series(
    df: DataFrame, spec: SeriesSpec, back: int, ahead: int = 0, large: bool | None = None
) -> tuple[DataFrame, SeriesSpec]:
    """Rows dealt out by series and sorted, for work in batches, with the spec of their stretches.

    Long series come as chunks of positions with copies of the rows that frames reach; only those rows carry
    ``_pos`` already. ``own_rows`` drops the copies.
    """
    if is_large(df, spec.series) if large is None else large:
        rows = max(group_rows_limit(df.sparkSession) // 2, 2 * max(back, ahead) + 1)
        df = chunked(with_position(df, spec), spec, rows, back, ahead)
        spec = SeriesSpec((*spec.series, CHUNK), spec.order, spec.row_id)
    return df.repartition(*spec.series).sortWithinPartitions(*spec.series, *spec.order), spec


def own_rows(df: DataFrame) -> DataFrame:
    """What ``sorted_series`` gave, without its copies and columns."""
    return df.filter("_own").drop(CHUNK, "_own", POS) if CHUNK in df.columns else df
