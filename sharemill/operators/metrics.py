"""Tagged log lines, and what is rolled up from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TAG = "[BENCHMARK]"
PAIR = r"([A-Za-z0-9_]+)=(\S+)"


def encode(role: Column, phase: Column, wall_sec: Column, **extra: Column) -> Column:
    """A parseable line: tag, role, phase, seconds to 6 places, then further pairs."""
    more = [F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in extra.items()]
    return F.concat_ws(" ", F.lit(TAG), F.concat(F.lit("role="), role), F.concat(F.lit("phase="), phase), F.format_string("wall_sec=%.6f", wall_sec), *more)


def parse(line: Column) -> Column:
    """The line's pairs as a map of strings; null for lines without the tag. The last of a key counts."""
    keys, values = F.regexp_extract_all(line, F.lit(PAIR), F.lit(1)), F.regexp_extract_all(line, F.lit(PAIR), F.lit(2))
    last = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda x, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), x["k"]))
    return F.when(line.startswith(TAG), F.map_from_entries(last))


def first_last(lines: DataFrame, key: list[str], value: str, order: str) -> DataFrame:
    return lines.groupBy(*key).agg(F.min_by(value, order).alias("first_value"), F.max_by(value, order).alias("last_value"))


def overhead(timings: DataFrame) -> DataFrame:
    """timings(role, phase, wall_sec) -> one row of the critical path and what it leaves."""
    by = timings.groupBy("role").agg(F.sum("wall_sec").alias("total"), F.max("wall_sec").alias("longest"))
    return by.agg(F.max("total").alias("critical_path"), F.sum("total").alias("summed"), F.count("*").alias("roles")).withColumn("residual", F.greatest(F.lit(0.0), F.col("summed") - F.col("critical_path") * F.col("roles")))


def stability(daily: DataFrame, order: str, loss: str, most_growth: float, most: float) -> DataFrame:
    """daily(order, loss) -> growth against the row before, a flag, and whether any flag came so far."""
    w = Window.orderBy(order)
    growth = F.col(loss) / F.lag(loss).over(w)
    flagged = daily.withColumn("growth", growth).withColumn("flag", F.coalesce(F.col("growth") > most_growth, F.lit(False)) | (F.col(loss) > most))
    return flagged.withColumn("aborted", F.max("flag").over(w.rowsBetween(Window.unboundedPreceding, 0)))


#: Groups' rows that a task holds before it passes them on, and parts in which a group is brought together.
MOST_HELD, PARTS = 1 << 16, 64


def k_least(df: DataFrame, group: str, order: str, k: int) -> DataFrame:
    """The k rows of each group that are least by order (nulls last), without sorting a group: tasks keep k
    rows a group and pass those on, which meet in PARTS and then at once."""
    import pyarrow as pa
    from pyspark import TaskContext

    def least(t: pa.Table) -> pa.Table:
        t = t.sort_by([(group, "ascending"), (order, "ascending")])
        keys, seen, last, keep = t.column(group).to_pylist(), 0, object(), []
        for g in keys:
            seen, last = (seen + 1 if g == last else 1), g
            keep.append(seen <= k)
        return t.filter(pa.array(keep, pa.bool_()))

    names = df.columns

    def held(batches):
        kept, part = None, TaskContext.get().partitionId() % PARTS
        out = lambda t: t.append_column("part", pa.array([part] * t.num_rows, pa.int32()))
        for b in batches:
            own = pa.Table.from_batches([b])
            kept = least(own if kept is None else pa.concat_tables([kept, own]))
            if kept.num_rows > MOST_HELD:
                yield from out(kept).combine_chunks().to_batches()
                kept = None
        if kept is not None:
            yield from out(kept).combine_chunks().to_batches()

    schema = df.schema.simpleString().removeprefix("struct<").removesuffix(">")
    some = df.mapInArrow(held, schema + ",part:int")
    some = some.groupBy(group, "part").applyInArrow(lambda t: least(t.select(names)), schema)
    return some.groupBy(group).applyInArrow(least, schema)
