"""Readers and writers: the tables of a folder, datasets, images, weights, logs and topologies."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.field import fixed, hash60
from ..operators.model import Weights


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str, scale: int) -> DataFrame:
    """(vec_id, label, x array<long>): embeddings in fixed point."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: fixed(v, scale)).alias("x"))


def head(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first n by key order: a filter on the key, since a limit has no order."""
    return df.where(F.col(key) < n)


def sample_order(key: str, seed: int) -> Column:
    """A keyed order of rows, the same on every evaluation."""
    return hash60(str(seed), F.col(key))


def subset(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """(key): the first n in a keyed order, or all if there are fewer. Each task keeps n at most."""
    return df.select(key).orderBy(sample_order(key, seed), key).limit(n)


def write_indices(indices: DataFrame, path: str) -> None:
    """An index of rows that runs share, as Parquet."""
    indices.write.mode("overwrite").parquet(path)


def read_indices(spark: SparkSession, path: str, key: str, all_rows: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """A shared index. Where there is none, the first n by key of all_rows; an error without those."""
    try:
        return spark.read.parquet(path).select(key)
    except AnalysisException:
        if all_rows is None or n is None:
            raise FileNotFoundError(f"no index at {path}") from None
        return head(all_rows.select(key), key, n)


def append_run(run: DataFrame, path: str) -> None:
    """Appends a run's row to a table of runs, CSV with a header in each file."""
    run.coalesce(1).write.mode("append").option("header", True).csv(path)


def checked(values: Column, n: int) -> Column:
    """An array of exactly n values, or an error."""
    return F.when(F.size(values) == n, values).otherwise(F.raise_error(F.format_string("%d values, not " + str(n), F.size(values))))


def grey_images(spark: SparkSession, path: str, side: int = 28) -> DataFrame:
    """(path, x array<double>): binary grey maps (P5) of any size, resized to side by side cells by
    bilinear interpolation between cell centres, 0..max as 0..1."""
    import numpy as np
    import pyarrow as pa

    def one(name: str, raw: bytes) -> list[float]:
        parts = re.match(rb"P5\s+(?:#[^\n]*\s+)*(\d+)\s+(\d+)\s+(\d+)\s", raw)
        if not parts or int(parts[3]) > 255:
            raise ValueError(f"{name}: not an 8-bit grey map")
        w, h, top = (int(parts[k]) for k in (1, 2, 3))
        cells = np.frombuffer(raw, np.uint8, w * h, parts.end()).reshape(h, w) / top
        at = lambda n: np.clip((np.arange(side) + 0.5) * n / side - 0.5, 0, n - 1)
        y, x = at(h), at(w)
        y0, x0 = y.astype(int), x.astype(int)
        y1, x1, fy, fx = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1), (y - y0)[:, None], x - x0
        low = cells[y0][:, x0] * (1 - fx) + cells[y0][:, x1] * fx
        high = cells[y1][:, x0] * (1 - fx) + cells[y1][:, x1] * fx
        return (low * (1 - fy) + high * fy).ravel().tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [one(p, raw) for p, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float64()))], names=["path", "x"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, x array<double>")


def one_hot(label: str, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: (c == F.col(label)).cast("int"))


def raw_images(spark: SparkSession, path: str, pixels: int = 784) -> DataFrame:
    """(path, x array<double>): grey raw images of exactly so many bytes, 0..255 as 0..1."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if len(raw) != pixels:
                    raise ValueError(f"{p}: {len(raw)} bytes, not {pixels}")
                out.append([v / 255 for v in raw])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float64()))], names=["path", "x"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, x array<double>")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(role, line_no, line) of files node_<n>.log and client.log."""
    own = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"(node_\d+|client)\.log", 1).alias("role"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    return own.where("role <> '' and line <> ''")


def topology(spark: SparkSession, entries: Sequence[dict], own: int | None = None, listen: tuple[str, int] | None = None) -> DataFrame:
    """(party_id, host, port) of a parsed topology: ids must be 1..n, each once; the own entry
    takes the address to listen on."""
    ids = sorted(int(e["party_id"]) for e in entries)
    if ids != list(range(1, len(ids) + 1)):
        raise ValueError(f"party ids must be 1..n, each once: {ids}")
    rows = [(int(e["party_id"]), *(listen if listen and int(e["party_id"]) == own else (str(e["host"]), int(e["port"])))) for e in entries]
    return spark.createDataFrame(rows, "party_id int, host string, port int")


def config_to_args(data: dict) -> list[str]:
    """A flat mapping as command-line arguments: true is a flag, lists repeat, null is left out."""
    out: list[str] = []
    for k, v in data.items():
        name = "--" + k.replace("_", "-")
        if isinstance(v, dict):
            raise ValueError(f"{k}: nested settings have no argument")
        if v is None or v is False:
            continue
        out += [name] if v is True else [x for item in v for x in (name, str(item))] if isinstance(v, list) else [name, str(v)]
    return out


def write_weights(spark: SparkSession, w: Weights, path: str, version: int, **meta: object) -> None:
    """Weights as (version, layer, i, j, y) Parquet beside a one-row JSON of what they are."""
    rows = [(version, *r) for r in w.rows()]
    spark.createDataFrame(rows, "version long, layer string, i int, j int, y long").coalesce(1).write.mode("overwrite").parquet(f"{path}/weights")
    spark.createDataFrame([(json.dumps({"version": version, **meta}, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def read_weights(spark: SparkSession, path: str) -> Weights:
    rows = spark.read.parquet(f"{path}/weights").collect()
    parts = {n: sorted((r["i"], r["j"], r["y"]) for r in rows if r["layer"] == n) for n in ("w1", "b1", "w2", "b2")}
    shape = {n: max(i for i, _, _ in v) + 1 for n, v in parts.items()}
    grid = lambda n: [[y for i, _, y in parts[n] if i == k] for k in range(shape[n])]
    return Weights(grid("w1"), [y for *_, y in parts["b1"]], grid("w2"), [y for *_, y in parts["b2"]])


def share_bytes(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """(key, bytes, count): what vectors take on the wire, 4 bytes a value where all fit, else 8."""
    wide = F.when(F.max(value) > 4294967295, 8).otherwise(4)
    return df.groupBy(*key).agg((wide * F.count("*")).cast("long").alias("bytes"), F.count("*").alias("count"))
