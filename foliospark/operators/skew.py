"""Joins and ordered windows that stay balanced when one key holds much of the data.

Keys that the grain of a table bounds (an account has one row a month) need nothing. For the others, ``hot_lists``
counts the keys of several tables in one job and stores those with more rows than one task should get, however many
they are, each with the number of pieces its rows are cut into. Spark broadcasts a short list and shuffles a long one.
Without a hot key an operator is the plain join or window; with some, only their rows take the split route, and both
routes give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from foliospark.sources.io import store


@dataclass(frozen=True)
class SkewPolicy:
    piece_rows: int = 1_000_000  # rows of one key that one task may get


DEFAULT = SkewPolicy()


def key_id(df: DataFrame, keys: Sequence[str]) -> Column:
    """A key as one number, NULL being a value; whole numbers of any width are alike."""
    whole = [isinstance(df.schema[k].dataType, IntegralType) for k in keys]
    return F.xxhash64(*[F.col(k).cast("bigint") if w else F.col(k) for k, w in zip(keys, whole, strict=True)])


def hot_lists(
    asked: dict[str, tuple[DataFrame, Sequence[str]]], policy: SkewPolicy = DEFAULT
) -> dict[str, DataFrame | None]:
    """For each name of ``asked`` the stored hot keys (``__id``, ``__pieces``) of a table, or None. Runs one job.

    Each table is grouped by its own keys, so one that is stored in buckets by some of them is counted without a shuffle.
    """
    if not asked:
        return {}
    every = None
    for name, (df, keys) in asked.items():
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).filter(F.col("__rows") > policy.piece_rows)
        pieces = F.ceil(F.col("__rows") / policy.piece_rows).cast("int")
        rows = counts.select(F.lit(name).alias("__list"), key_id(counts, keys).alias("__id"), pieces.alias("__pieces"))
        every = rows if every is None else every.union(rows)
    found = store(every, "hot_keys")
    full = {r[0] for r in found.select("__list").distinct().collect()}  # names, not keys
    return {n: found.filter(F.col("__list") == n).select("__id", "__pieces") if n in full else None for n in asked}


def crowded(tables: dict[str, DataFrame], policy: SkewPolicy = DEFAULT) -> set[str]:
    """Which of some tables, each stored in one file per bucket of a column, have a bucket of more rows than one task should get.

    A key that holds the column lies in one bucket, so the other tables have no hot key. Runs a job that reads no column.
    """
    every = None
    for name, df in tables.items():
        files = df.groupBy(F.col("_metadata.file_path").alias("__file")).agg(F.count(F.lit(1)).alias("__rows"))
        names = files.filter(F.col("__rows") > policy.piece_rows).select(F.lit(name).alias("__list"))
        every = names if every is None else every.union(names)
    return set() if every is None else {r[0] for r in every.distinct().collect()}


def _marked(df: DataFrame, hot: DataFrame, ident: Column) -> DataFrame:
    """Adds ``__pieces``: the number of pieces of the row's key, 1 if it is not hot."""
    out = df.withColumn("__id", ident).join(hot, "__id", "left").drop("__id")
    return out.withColumn("__pieces", F.coalesce("__pieces", F.lit(1)))


def _one_of(columns: Sequence[str]) -> Column:
    """A piece number that follows from the row and its task."""
    return F.pmod(F.xxhash64(*columns, F.spark_partition_id()), F.col("__pieces")).cast("int")


def _each_piece() -> Column:
    return F.explode(F.sequence(F.lit(0), F.col("__pieces") - 1))


def skew_joins(
    left: DataFrame,
    rights: Sequence[DataFrame],
    on: Sequence[str],
    how: str = "left",
    residual: Callable[[], Column] | None = None,
    hot: DataFrame | None = None,
    right_hot: Sequence[DataFrame | None] = (),
) -> DataFrame:
    """``left`` joined (left or inner) to each of ``rights`` on equal ``on`` columns; the key columns kept are ``left``'s.

    ``residual`` is a further join condition over column names. ``hot`` lists the hot keys of ``left``: their rows are
    spread over the key's pieces, and the partners are repeated once per piece. ``right_hot`` has a list, or None, for
    each right side: there the rows of the right side are spread and those of ``left`` repeated.
    """
    on = list(on)
    out = left
    for i, right in enumerate(rights):
        crowded = right_hot[i] if i < len(right_hot) else None
        if crowded is None:
            out = _joined(out, right, on, how, residual, hot)
            continue
        if residual is not None and how != "inner":
            raise ValueError("a left join with a further condition can't repeat its left rows")
        no_key = F.greatest(*[F.col(k).isNull() for k in on], F.lit(False))  # matches nothing
        many = _marked(right, crowded, F.when(~no_key, key_id(right, on)))
        one = _marked(out, crowded, F.when(~no_key, key_id(out, on)))
        few = _joined(one.filter("__pieces = 1").drop("__pieces"), many.filter("__pieces = 1").drop("__pieces"), on, how, residual, hot)
        spread = many.filter("__pieces > 1").withColumn("__part", _one_of(right.columns)).drop("__pieces")
        repeated = one.filter("__pieces > 1").withColumn("__part", _each_piece()).drop("__pieces")
        # every such key has a partner, so nothing is left over that a left join would keep
        out = few.unionByName(_joined(repeated, spread, [*on, "__part"], "inner", residual, None).drop("__part"))
    return out


def _joined(left: DataFrame, right: DataFrame, on: Sequence[str], how: str, residual: Callable[[], Column] | None, hot: DataFrame | None) -> DataFrame:
    keep = [*left.columns, *[c for c in right.columns if c not in on]]
    if hot is not None:
        right = _marked(right, hot, key_id(right, [k for k in on if k != "__part"])).withColumn("__salt", _each_piece()).drop("__pieces")
        left = _marked(left, hot, key_id(left, [k for k in on if k != "__part"])).withColumn("__salt", _one_of(left.columns)).drop("__pieces")
        on = [*on, "__salt"]
    right = right.withColumnsRenamed({k: "__r_" + k for k in on})
    cond = F.lit(True)
    for k in on:
        cond = cond & (F.col(k) == F.col("__r_" + k))
    if residual is not None:
        cond = cond & residual()
    return left.join(right, cond, how).select(*keep)


def skew_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", right_hot: DataFrame | None = None, **kw) -> DataFrame:
    return skew_joins(left, [right], on, how, right_hot=[right_hot], **kw)


def _blocks(df: DataFrame, hot: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of other keys; and the different rows of hot keys with their number (``__times``), a hash of the row
    (``__tie``) and the slice of hashes it falls into (``__block``)."""
    marked = _marked(df, hot, key_id(df, keys))
    plain = marked.filter("__pieces = 1").drop("__pieces")
    cut = marked.filter("__pieces > 1").groupBy(*columns, "__pieces").agg(F.count(F.lit(1)).alias("__times"))
    cut = cut.withColumn("__tie", F.xxhash64(*columns))
    bits = "cast(ceil(log2(__pieces)) as int)"
    return plain, cut.withColumn("__block", F.expr(f"shiftright(__tie, 64 - {bits})")).drop("__pieces")


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], prefix: str) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[prefix + k])
    return cond


def previous_row(
    df: DataFrame, keys: Sequence[str], month: str, values: dict[str, str], hot: DataFrame | None = None
) -> DataFrame:
    """Adds, for each ``{new: column}``, the column's value in the previous row of the key.

    Rows are ordered by ``month``; rows of one key in one month are ordered by a hash of
    their content, so the result does not depend on how Spark happened to read them. The
    previous row is the one before, however many months back that is.

    A hot key is cut into (month, hash range) blocks: the lag is taken inside each block,
    and the first row of a block takes the last row of the block before it. Equal rows go
    as one; the row before any copy but the first is a copy.
    """
    keys = list(keys)

    def lags(by: Sequence[str], prefix: str = "") -> list[Column]:
        w = Window.partitionBy(*by).orderBy(F.col(month), F.col("__tie"))
        return [F.lag(F.col(c)).over(w).alias(prefix + new) for new, c in values.items()]

    def lagged(frame: DataFrame) -> DataFrame:
        return frame.withColumn("__tie", F.xxhash64(*df.columns)).select("*", *lags(keys)).drop("__tie")

    if hot is None:
        return lagged(df)
    plain, cut = _blocks(df, hot, keys, df.columns)
    copies = cut.filter("__times > 1").withColumn("__copy", F.explode(F.expr("sequence(2L, __times)"))).select(
        *df.columns, *[F.col(c).alias(new) for new, c in values.items()]
    )
    cut = cut.withColumn("__month", F.col(month))
    block = ["__month", "__block"]
    w_block = Window.partitionBy(*keys, *block).orderBy("__tie")
    inside = cut.select("*", *lags(keys + block, "__in_"), (F.row_number().over(w_block) == 1).alias("__first"))
    # one row per block: at most months x pieces rows per key
    w_key = Window.partitionBy(*keys).orderBy(*block)
    ends = (
        cut.groupBy(*keys, *block)
        .agg(F.max_by(F.struct(*[F.col(c).alias("__" + n) for n, c in values.items()]), "__tie").alias("__end"))
        .withColumn("__before", F.lag("__end").over(w_key))
        .drop("__end")
    )
    ends = ends.withColumnsRenamed({k: "__e_" + k for k in keys + block})
    joined = inside.join(ends, _same(inside, ends, keys + block, "__e_"), "left")
    split = joined.select(
        *[inside[c] for c in df.columns],
        *[
            F.when(F.col("__first"), F.col("__before")["__" + new]).otherwise(F.col("__in_" + new)).alias(new)
            for new in values
        ],
    )
    return lagged(plain).unionByName(split).unionByName(copies)


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, str]], name: str,
    hot: DataFrame | None = None, hot_on: Sequence[str] | None = None,
) -> DataFrame:
    """Numbers the rows of each key from 1 by ``order``: ``(column, "asc" | "desc")``, coarse columns.

    Rows equal in all of them are numbered by a hash of the whole row. NULLs come first
    ascending and last descending. A hot key is numbered block by block, a block being one
    value of the order columns and one range of hashes; it starts after the blocks before it.
    ``hot`` may list values of a part of the keys, ``hot_on``.
    """
    keys = list(keys)

    def sorting(prefix: str = "") -> list[Column]:
        return [
            F.col(prefix + c).desc_nulls_last() if way == "desc" else F.col(prefix + c).asc_nulls_first()
            for c, way in order
        ]

    def numbered(frame: DataFrame) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*sorting(), F.xxhash64(*df.columns))
        return frame.withColumn(name, F.row_number().over(w).cast("bigint"))

    if hot is None:
        return numbered(df)
    plain, cut = _blocks(df, hot, hot_on or keys, df.columns)
    block = ["__o_" + c for c, _ in order] + ["__block"]
    cut = cut.withColumns({"__o_" + c: F.col(c) for c, _ in order})
    before = (Window.unboundedPreceding, -1)
    w_block = Window.partitionBy(*keys, *block).orderBy("__tie").rowsBetween(*before)
    w_key = Window.partitionBy(*keys).orderBy(*sorting("__o_"), F.col("__block")).rowsBetween(*before)
    starts = (
        cut.groupBy(*keys, *block)
        .agg(F.sum("__times").alias("__n"))
        .withColumn("__start", F.coalesce(F.sum("__n").over(w_key), F.lit(0)))
        .drop("__n")
    )
    starts = starts.withColumnsRenamed({k: "__e_" + k for k in keys + block})
    inside = cut.withColumn("__ahead", F.coalesce(F.sum("__times").over(w_block), F.lit(0)))
    joined = inside.join(starts, _same(inside, starts, keys + block, "__e_"), "left")
    number = F.explode(F.expr("sequence(__start + __ahead + 1, __start + __ahead + __times)"))
    return numbered(plain).unionByName(joined.select(*[inside[c] for c in df.columns], number.alias(name)))
