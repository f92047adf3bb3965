"""Sorting, positions, samples and splits.

Places in an order of columns come from counts: a bounded sample of the keys cuts the order into runs, one pass
over the keys alone counts them, and the rows are numbered inside their run after one exchange. The first n rows
are found by counts too: the run in which the cut falls is cut again until it is short.

Random order is the order of md5(seed|key): it repeats, and does not depend on how
the data is partitioned. ``key`` must be unique per row. No step sorts or numbers the
whole dataset in one task: hash prefixes of equal expected size are counted, the counts
(a fixed number of rows) become offsets, and rows are numbered inside their prefix.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checks import as_list, col, require_batch, require_column, require_columns, require_frame
from ..scratch import written

# Hex digits of the hash prefix: 16 ** 4 = 65,536 prefixes, so their counts fit a broadcast.
PREFIX_DIGITS = 4
# Keys of a sample for each run, most runs, and most rows that the search for a cut ends with.
SAMPLED, MOST_RUNS, SHORT = 32, 1024, 100_000


def sort_rows(df: DataFrame, by: str, ascending: bool = True, tiebreak: str | list[str] = ()) -> DataFrame:
    """Sorts with nulls last ascending and first descending; ties by ``tiebreak``.

    Without a tiebreak, rows of a frequent value go by a hash of their content: Spark's
    range partitioning can then split them.
    """
    require_batch(df, "sort_rows")
    require_columns(df, [by, *as_list(tiebreak)])
    main = col(by).asc_nulls_last() if ascending else col(by).desc_nulls_first()
    ties = [col(c) for c in as_list(tiebreak)]
    hashable = [col(name) for name, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    return df.orderBy(main, *(ties or [F.xxhash64(*hashable)] if hashable else ties))


def _hash(key: str | list[str], seed: int) -> Column:
    parts = [F.coalesce(col(c).cast("string"), F.lit("")) for c in as_list(key)]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


@dataclass(frozen=True)
class _HashOrder:
    """Rows in the order of their seeded hash, with one offset per hash prefix."""

    rows: DataFrame
    key: list[str]
    seed: int
    digits: int

    @property
    def tagged(self) -> DataFrame:
        hashed = self.rows.withColumn("_hash", _hash(self.key, self.seed))
        return hashed.withColumn("_prefix", F.substring("_hash", 1, self.digits))

    @property
    def rank(self) -> Column:
        order = [F.col("_hash"), *[col(c) for c in self.key]]
        return F.row_number().over(Window.partitionBy("_prefix").orderBy(*order))

    def offsets(self) -> DataFrame:
        """Per prefix: rows before it, its rows, and all rows. At most 16 ** digits rows."""
        keys = self.rows.select(*[col(c) for c in self.key])
        counts = _HashOrder(keys, self.key, self.seed, self.digits).tagged.groupBy("_prefix").agg(
            F.count(F.lit(1)).alias("_n")
        )
        running = Window.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return counts.select(
            "_prefix",
            "_n",
            F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"),
            F.sum("_n").over(whole).alias("_total"),
        )

    def positions(self, output_column: str) -> DataFrame:
        joined = self.tagged.join(F.broadcast(self.offsets().select("_prefix", "_before")), "_prefix")
        numbered = joined.withColumn(output_column, (F.col("_before") + self.rank - 1).cast("bigint"))
        return numbered.select(*[col(c) for c in self.rows.columns], output_column)

    def first(self, wanted: Column) -> tuple[DataFrame, Column]:
        """The rows with a condition that holds for the first ``wanted`` of them.

        ``wanted`` may use ``_total``. Only the hash prefix in which the cut falls is
        ranked, on its keys alone; every other row is decided by its prefix, so the
        rows themselves are never shuffled.
        """
        need = F.least(wanted, F.col("_total")) - F.col("_before")
        offsets = self.offsets().select("_prefix", "_n", need.alias("_need"))
        split = offsets.where((F.col("_need") > 0) & (F.col("_need") < F.col("_n")))
        keys = self.rows.select(*[col(c) for c in self.key])
        order = _HashOrder(keys, self.key, self.seed, self.digits)
        inside = order.tagged.join(F.broadcast(split.select("_prefix", "_need")), "_prefix")
        point = F.struct(F.col("_hash"), *[col(c) for c in self.key])
        cut = (
            inside.withColumn("_rank", order.rank)
            .where(F.col("_rank") <= F.col("_need"))
            .groupBy("_prefix")
            .agg(F.max(point).alias("_cut"))
        )
        bounds = offsets.select("_prefix", "_n", "_need").join(F.broadcast(cut), "_prefix", "left")
        joined = self.tagged.join(F.broadcast(bounds), "_prefix")
        taken = F.when(F.col("_need") <= 0, False).when(F.col("_need") >= F.col("_n"), True)
        return joined, taken.otherwise(point <= F.col("_cut"))


def sample_rows(df: DataFrame, n: int = 100, seed: int = 42, key: str | list[str] = "id") -> DataFrame:
    """Exactly min(n, rows) rows without replacement, the same ones for the same seed.

    They are the first ones in the order of the seeded hash of the key. Rows of one key are one draw; where the cut
    falls among them, which of them stay is not defined.
    """
    require_batch(df, "sample_rows")
    keys = as_list(key)
    require_columns(df, keys)
    if n < 0:
        raise ValueError("n must not be negative")
    return _first_rows(df, n, [_hash(keys, seed), *[col(c) for c in keys]])


def shuffle(df: DataFrame, seed: int = 42, key: str | list[str] = "id", digits: int = PREFIX_DIGITS) -> DataFrame:
    """Adds ``shuffle_pos``: the place of the row in a seeded permutation."""
    require_batch(df, "shuffle")
    require_columns(df, as_list(key))
    return _HashOrder(df, as_list(key), seed, digits).positions("shuffle_pos")


def tag_split(
    df: DataFrame,
    ratio: float = 0.8,
    seed: int = 42,
    key: str | list[str] = "id",
    output_column: str = "split",
    digits: int = PREFIX_DIGITS,
) -> DataFrame:
    """Adds ``split``: exactly int(rows * ratio) rows are train, the others test."""
    require_batch(df, "split_dataset")
    require_columns(df, as_list(key))
    if not 0 <= ratio <= 1:
        raise ValueError(f"ratio is a share of the rows, from 0 to 1; {ratio} is none")
    wanted = F.floor(F.col("_total").cast("double") * F.lit(float(ratio)))
    rows, taken = _HashOrder(df, as_list(key), seed, digits).first(wanted)
    tagged = rows.withColumn(output_column, F.when(taken, "train").otherwise("test"))
    return tagged.select(*[col(c) for c in df.columns], output_column)


def split_dataset(
    df: DataFrame, ratio: float = 0.8, seed: int = 42, key: str | list[str] = "id"
) -> tuple[DataFrame, DataFrame]:
    tagged = tag_split(df, ratio, seed, key, output_column="_split")
    return (
        tagged.where(F.col("_split") == "train").drop("_split"),
        tagged.where(F.col("_split") == "test").drop("_split"),
    )


def _point(columns: list[Column]) -> Column:
    """The columns as one value: of two structs the one whose first column is not null is less, as in the sort order."""
    return F.struct(*[part for c in columns for part in (c.isNull(), c)])


def _sample(points: DataFrame, size: int) -> DataFrame:
    """One row with ``size`` points of ``points`` (point), drawn at random and sorted, in a table: later jobs see the same ones."""
    drawn = points.orderBy(F.xxhash64(F.monotonically_increasing_id(), F.lit(7))).limit(size)
    return written(drawn.agg(F.array_distinct(F.array_sort(F.collect_list("point"))).alias("splits")), "splits")


def _below(splits: Column, point: Column) -> Column:
    """How many of the sorted ``splits`` are less than the point."""
    return F.size(F.filter(splits, lambda s: s < point))


def _with_run(rows: DataFrame, splits: DataFrame, value: Column, most: int) -> DataFrame:
    """Adds ``_run``: how many of the sorted ``splits``, at most ``most``, are less than the value, found by halving.

    Each step is a column of its own: Spark compiles them, and none repeats the steps before it.
    """
    found = rows.withColumns({"_splits": splits.scalar(), "_value": value, "_run": F.lit(0)})
    step = 1 << most.bit_length()
    while step := step // 2:
        less = F.get("_splits", F.col("_run") + (step - 1)) < F.col("_value")
        found = found.withColumn("_run", F.when(less, F.col("_run") + step).otherwise(F.col("_run")))
    return found.drop("_splits", "_value")


def with_position(df: DataFrame, order_by: str | list[str], output_column: str = "position") -> DataFrame:
    """Adds the place of each row in the order of ``order_by``, which must be unique.

    Splitters from a bounded sample of the keys cut the order into runs by the whole order key, so a value that many
    rows share in its first column is spread by the next. A pass over the keys counts the runs; the rows move once, to
    their run, and the one offset of each run makes their places global.
    """
    require_batch(df, "with_position")
    names = as_list(order_by)
    require_columns(df, names)
    point = _point([col(c) for c in names])
    runs = min(MOST_RUNS, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = df.select(point.alias("point"))
    sample = _sample(keys, SAMPLED * runs)
    every = F.greatest(F.lit(1), F.ceil(F.size("splits") / F.lit(runs)))
    picked = sample.select(F.filter("splits", lambda s, i: i % every == every - 1).alias("splits"))
    counts = _with_run(keys, picked, F.col("point"), runs).groupBy("_run").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each run: MOST_RUNS at most.
    offsets = written(counts.select("_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "offsets")
    order = [col(c).asc_nulls_last() for c in names]
    placed = _with_run(df, picked, point, runs).withColumn("_place", F.row_number().over(Window.partitionBy("_run").orderBy(*order)))
    joined = placed.join(F.broadcast(offsets), "_run")
    return joined.select(*[col(c) for c in df.columns], (F.col("_before") + F.col("_place") - 1).cast("bigint").alias(output_column))


def _last_point(keys: DataFrame, n: int) -> Column | None:
    """The n-th of the points in ``keys`` (point), or None if there are no more than n.

    In rounds, splitters drawn from the points that are left cut them into ranges and single points, which one pass
    counts. The search goes on inside the range where the cut falls, until it holds few rows. Nothing is sorted but those.
    """
    left = keys.count()
    if left <= n:
        return None
    need, inside = n, keys
    while left > SHORT:
        splits = _sample(inside, SAMPLED).scalar()
        at = F.col("point")
        given = inside.withColumn("splits", splits)
        cell = 2 * _below(F.col("splits"), at) + F.array_contains("splits", at).cast("int")
        cells = sorted(given.groupBy(cell.alias("cell")).count().collect())
        for number, size in cells:
            if need <= size:
                break
            need -= size
        if number % 2:
            return F.get(splits, F.lit(number // 2))
        low, high = F.get(splits, F.lit(number // 2 - 1)), F.get(splits, F.lit(number // 2))
        inside, left = inside.where((at > low) | low.isNull()).where((at < high) | high.isNull()), size
    return inside.orderBy("point").limit(need).agg(F.max("point")).scalar()


def _first_rows(df: DataFrame, n: int, columns: list[Column]) -> DataFrame:
    """The first min(n, rows) rows by ``columns``, null last; where the cut falls among equal keys, any of them stay."""
    if n == 0:
        return df.limit(0)
    point = _point(columns)
    keys = df.select(point.alias("point"))
    last = _last_point(keys, n)
    if last is None:
        return df
    less, equal = keys.agg(F.count_if(F.col("point") < last), F.count_if(F.col("point") == last)).first()
    if less + equal <= n:
        return df.where(point <= last)
    # Equal keys are told apart by their number alone.
    numbered = df.where(point == last).withColumn("_number", F.monotonically_increasing_id())
    ties = with_position(numbered, "_number", "_position").where(F.col("_position") < n - less)
    return df.where(point < last).unionByName(ties.drop("_number", "_position"))


def head(df: DataFrame, n: int = 5, order_by: str | list[str] = "id") -> DataFrame:
    """The first ``n`` rows by ``order_by``, exactly min(n, rows) of them; nulls come last.

    The last key that belongs is found by counts; it is a filter then, and only what passes it is sorted. Of equal keys
    on the cut any may stay.
    """
    require_batch(df, "head")
    names = as_list(order_by)
    require_columns(df, names)
    return _first_rows(df, n, [col(c) for c in names]).orderBy(*[col(c).asc_nulls_last() for c in names])


def batches(df: DataFrame, chunk_size: int = 1000, order_by: str | list[str] = "id") -> DataFrame:
    """Adds ``batch_id``: batches of ``chunk_size`` rows in order, the last one shorter."""
    require_frame(df)
    if chunk_size < 1:
        raise ValueError("chunk_size must be at least 1")
    placed = with_position(df, order_by, "_position")
    batch = F.floor(F.col("_position") / F.lit(chunk_size)).cast("bigint")
    return placed.withColumn("batch_id", batch).drop("_position")


def preview(df: DataFrame, limit: int = 5, order_by: str | list[str] | None = None) -> dict:
    """The first rows, the schema and the row count, for display."""
    require_batch(df, "preview")
    if order_by is not None:
        for name in as_list(order_by):
            require_column(df, name)
    shown = df.limit(limit) if order_by is None else head(df, limit, order_by)
    return {
        "columns": df.columns,
        "schema": {f.name: f.dataType.simpleString() for f in df.schema.fields},
        "rows": [row.asDict(recursive=True) for row in shown.collect()],
        "row_count": df.count(),
    }
