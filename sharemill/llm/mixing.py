"""Mixing to target weights by iterative proportional fitting: token weights of the cells (source,
language, topic) are raked to the marginal targets with no cell above its tokens, then documents
are sampled with the calibrated probabilities of their cells. The fit takes cells, never documents."""

from __future__ import annotations

import logging

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import columns_of, materialize, unused

#: Passes over the margins; the power that tempers observed shares into targets; the share of tokens
#: asked for, and the part of what the scarcest value allows that is taken at most; the seed of the draw.
PASSES, TEMPER, RATE, ROOM, SEED = 32, 0.7, 0.5, 0.9, 17
DIMS = ["source", "lang", "topic"]
#: The largest error of a margin, as a part of its goal, at which a fit is done, and what the rate is
#: multiplied by where cells can't give enough together.
TOLERANCE, LOWER, LEAST_RATE, MOST_PASSES = 1e-6, 0.95, 1e-2, 1024
#: How often targets of tempered shares that can't hold together are moved half of the way to the shares
#: that there are, which always hold.
SOFTER = 8
#: Cells up to which their table is broadcast.
MOST_CELLS = 100_000
#: Topics by what a text holds, the first that applies; other texts are prose by their length.
MARKS = {"legal": ["icens"], "contact": ["@"], "shouting": ["!! "], "table": [" | "], "symbols": ["%%%", "&&&"]}
LENGTHS = {"long": 4000, "middle": 1000, "short": 0}


def topic(text: Column) -> Column:
    """A text's topic, from the whole of it: licences, contacts, shouting, tables, strings of symbols, or
    prose by its length."""
    t, out = F.coalesce(text, F.lit("")), None
    for name, marks in MARKS.items():
        has = F.contains(t, F.lit(marks[0]))
        for m in marks[1:]:
            has = has | F.contains(t, F.lit(m))
        out = F.when(has, name) if out is None else out.when(has, name)
    for name, least in LENGTHS.items():
        out = out.when(F.length(t) >= least, name)
    return out


def n_tokens(text: Column) -> Column:
    """Words of 0x20 and 0x09-0x0D separated text, and one end."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long")


def cells(docs: DataFrame, dims: list[str], tokens: str) -> DataFrame:
    return docs.groupBy(*dims).agg(F.sum(tokens).cast("double").alias("tokens"), F.count("*").alias("docs"))


def calibrated(tokens: np.ndarray, at: list[np.ndarray], shares: list[np.ndarray], rate: float, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Probabilities of cells whose expected tokens meet shares of rate times all tokens by each margin,
    and the largest error as a part of its goal. A pass multiplies the weights of each of a margin's
    values: what full cells (at 1 or more) leave of its goal is for the others; where they hold more
    than it, all shrink."""
    w, whole = np.full(len(tokens), float(rate)), tokens.sum()
    for _ in range(passes):
        for k, share in zip(at, shares, strict=True):
            goal, full = share * rate * whole, w >= 1
            fixed = np.bincount(k, np.where(full, tokens, 0.0), len(share))
            rest = np.bincount(k, np.where(full, 0.0, w * tokens), len(share))
            more = np.divide(goal - fixed, rest, out=np.ones(len(share)), where=rest > 0)
            less = np.divide(goal, fixed, out=np.zeros(len(share)), where=fixed > 0)
            w = w * np.where(goal > fixed, more, less)[k]
    p = np.minimum(1, w)
    error = 0.0
    for k, share in zip(at, shares, strict=True):
        goal, own = share * rate * whole, np.bincount(k, p * tokens, len(share))
        error = max(error, float(np.abs(own[goal > 0] / goal[goal > 0] - 1).max(initial=0)))
    return p, error


def fitted(tokens: np.ndarray, at: list[np.ndarray], shares: list[np.ndarray], rate: float) -> tuple[np.ndarray, float, float]:
    """calibrated() at the rate asked for or at ROOM of what the scarcest value of a margin allows, if
    that is less; lowered by steps while the margins don't hold together. With the rate and error."""
    whole = tokens.sum()
    if not whole:
        return np.ones(len(tokens)), rate, 0.0
    for k, share in zip(at, shares, strict=True):
        own = np.bincount(k, tokens, len(share))
        rate = min([rate, *(ROOM * own[share > 0] / (share[share > 0] * whole)).tolist()])
    p, error = calibrated(tokens, at, shares, rate)
    while error > TOLERANCE and (p >= 1).any() and rate > LEAST_RATE:
        rate *= LOWER
        p, error = calibrated(tokens, at, shares, rate)
    if error > TOLERANCE:
        p, error = calibrated(tokens, at, shares, rate, MOST_PASSES)  # no cell is in the way: slow margins
    return p, rate, error


def fit(cell: DataFrame, dims: list[str], rate: float, temper: float, targets: dict | None) -> DataFrame:
    """The cells with cell_probability. Cells are as many as the combinations of dims, not documents;
    they are fitted on the driver, at some dozen bytes each."""
    rows = cell.select(*dims, F.coalesce("tokens", F.lit(0.0)).alias("tokens")).collect()
    tokens = np.array([max(0.0, r["tokens"]) for r in rows])
    at, given, names = [], {}, {}
    for d in dims:
        names[d] = {}
        at.append(np.array([names[d].setdefault(r[d], len(names[d])) for r in rows], np.int64))
        own = np.bincount(at[-1], tokens, len(names[d]))
        if targets and d in targets:
            raw = np.where(own > 0, [float(targets[d].get(v, 0.0)) for v in names[d]], 0.0)
            given[d] = raw / (raw.sum() or 1.0)
    for _ in range(SOFTER):
        shares = []
        for d, k in zip(dims, at, strict=True):
            raw = (np.bincount(k, tokens, len(names[d])) / (tokens.sum() or 1.0)) ** temper
            shares.append(given.get(d, raw / (raw.sum() or 1.0)))
        p, used, error = fitted(tokens, at, shares, rate)
        if error <= TOLERANCE:
            break
        temper = (1 + temper) / 2  # values that only occur together can't have shares of their own: closer to what there is
    else:
        if given:
            raise ValueError(f"the targets can't be met: a margin stays {error:.2g} of its goal away")
        p, used, error = np.full(len(tokens), float(rate)), rate, 0.0  # the shares that there are
    logging.getLogger(__name__).warning("mixing: %d cells, %d at probability 1, rate %.4f of %.4f asked, largest margin error %.2g of its goal", len(rows), (p >= 1).sum(), used, rate, error)
    out = [(*(r[d] for d in dims), float(x) if t > 0 else 1.0) for r, x, t in zip(rows, p, tokens, strict=True)]
    schema = cell.select(*(F.col(d).alias(f"cell_{d}") for d in dims), F.lit(1.0).cast("double").alias("cell_probability")).schema
    return cell.sparkSession.createDataFrame(out, schema)


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) from the document's id alone."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", doc_id.cast("string"), F.lit(str(seed))).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def drawn(docs: DataFrame, dims: dict[str, Column], tokens: Column, rate: float, targets: dict | None, seed: int, temper: float, instead: Column | None) -> tuple[DataFrame, str, str]:
    """docs and two columns of names that they don't have: a row's probability, and whether it is kept.
    Only columns of other names than docs' are added on the way, so none of docs' is replaced."""
    names = list(docs.columns)
    own = docs
    mine = {}
    for d, value in {**dims, "tokens": tokens}.items():
        mine[d] = unused(f"mix_{d}", names)
        names.append(mine[d])
        own = own.withColumn(mine[d], value)
    cell = cells(own.select(*(F.col(mine[d]).alias(d) for d in dims), F.col(mine["tokens"]).alias("tokens")), list(dims), "tokens")
    found = materialize(fit(materialize(cell, "cells"), list(dims), rate, temper, targets), "fitted")
    few = found.count() <= MOST_CELLS  # a row per cell; beyond that Spark joins by key and splits skewed ones
    p, kept = unused("mix_probability", names), unused("mix_kept", names)
    met = {d: unused(f"cell_{d}", names) for d in dims}
    found = found.select(*(F.col(f"cell_{d}").alias(met[d]) for d in dims), F.col("cell_probability").alias(p))
    meets = None
    for d in dims:
        one = F.col(mine[d]).eqNullSafe(F.col(met[d]))
        meets = one if meets is None else meets & one
    out = own.join(F.broadcast(found) if few else found, meets, "left")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("-1") if instead is None else F.concat(F.lit("text|"), F.coalesce(instead, F.lit(""))))
    return out.select(*columns_of(docs), p, (draw(key, seed) < F.col(p)).alias(kept)), p, kept


def mix(docs: DataFrame, dims: list[str] = DIMS, tokens: str = "n_tokens", rate: float = RATE, targets: dict | None = None, seed: int = SEED, temper: float = TEMPER, instead: Column | None = None) -> DataFrame:
    """docs with doc_id, dims and a token count -> the same rows with probability and kept.

    A document's probability is its cell's, as fitted() finds it. It is drawn by a hash of its id, so
    a row keeps its fate in any order and on any retry. Null values of a dimension are a value of
    their own; null ids are drawn by a hash of `instead`, such as the text, and share one draw
    without it; rows that repeat share theirs; an empty table stays empty; other columns pass
    through unless they are named probability or kept, which are replaced."""
    out, p, kept = drawn(docs, {d: F.col(d) for d in dims}, F.col(tokens), rate, targets, seed, temper, instead)
    names = [c for c in docs.columns if c.lower() not in ("probability", "kept")]
    return out.select(*(F.col(f"`{c}`") for c in names), F.col(p).alias("probability"), F.col(kept).alias("kept"))


def margins(mixed: DataFrame, dims: list[str] = DIMS, tokens: str = "n_tokens") -> DataFrame:
    """(dim, value, tokens, expected): tokens of mix()'s rows by each value, and those expected to be kept."""
    values = F.array(*(F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims))
    own = mixed.select(F.explode(values).alias("m"), F.col(tokens).alias("t"), "probability")
    return own.groupBy("m.dim", "m.value").agg(F.sum("t").alias("tokens"), F.sum(F.col("t") * F.col("probability")).alias("expected"))


def documents_mixed(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, source, lang, ...) -> doc_id, source, lang, topic, n_tokens, probability
    (to 9 decimals) and kept, a row for each of them, as mix() says. Null texts are empty; null ids
    are drawn by their text; extra columns are dropped."""
    own = docs.select(F.col("doc_id").cast("long"), "source", "lang", topic(F.col("text")).alias("topic"), n_tokens(F.col("text")).alias("n_tokens"), F.col("text").alias("__text"))
    return mix(own, instead=F.col("__text")).drop("__text").withColumn("probability", F.round("probability", 9))


def sampled(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """The sampled rows of docs(doc_id, text, source, lang, ...), with the columns of docs, whatever their
    names: those that mix() keeps. Null texts are empty, null ids are drawn by their text, rows that repeat share their
    fate, and an empty table stays empty."""
    dims = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic(F.col("text"))}
    out, _, kept = drawn(docs, dims, n_tokens(F.col("text")), rate, None, SEED, TEMPER, F.col("text"))
    return out.where(F.col(kept)).select(*columns_of(docs))


def oracle() -> str:
    """The same over DuckDB's view of documents: the passes are so many common tables. It takes the
    first rate that fitted() tries, which is the one it ends with unless the margins can't hold."""
    text = "coalesce(text, '')"
    topics = " ".join(f"WHEN {' OR '.join(f'contains({text}, {chr(39)}{m}{chr(39)})' for m in marks)} THEN '{n}'" for n, marks in MARKS.items())
    topics += " " + " ".join(f"WHEN length({text}) >= {least} THEN '{n}'" for n, least in LENGTHS.items())
    ctes = [f"""d AS (SELECT doc_id, source, lang, {text} AS text, CASE {topics} END AS topic,
      CAST(len(regexp_extract_all({text}, '[^\x20\x09-\x0D]+')) + 1 AS BIGINT) AS n_tokens FROM documents)""",
      "c AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL)"]
    for x in DIMS:
        ctes.append(f"r_{x} AS (SELECT {x}, sum(tokens) AS own, pow(sum(tokens) / (SELECT sum(tokens) FROM c), {TEMPER}) AS raw FROM c GROUP BY {x})")
        ctes.append(f"s_{x} AS (SELECT {x}, own, raw / (SELECT sum(raw) FROM r_{x}) * (SELECT sum(tokens) FROM c) AS part FROM r_{x})")
    least = ", ".join(f"(SELECT min({ROOM} * own / part) FROM s_{x})" for x in DIMS)
    ctes.append(f"rate AS (SELECT least({RATE}, {least}) AS rate)")
    ctes.append("w0 AS (SELECT c.*, " + ", ".join(f"s_{x}.part * rate AS {x}_goal" for x in DIMS) + ", rate AS w FROM c CROSS JOIN rate " + " ".join(f"JOIN s_{x} ON c.{x} IS NOT DISTINCT FROM s_{x}.{x}" for x in DIMS) + ")")
    k = 0
    for _ in range(PASSES):
        for x in DIMS:
            k += 1
            fixed, rest = (f"sum(CASE WHEN w >= 1 THEN {a} ELSE {b} END) OVER (PARTITION BY {x})" for a, b in (("tokens", "0.0"), ("0.0", "w * tokens")))
            ctes.append(f"w{k} AS MATERIALIZED (SELECT source, lang, topic, tokens, source_goal, lang_goal, topic_goal, w * CASE WHEN {x}_goal > f THEN CASE WHEN r > 0 THEN ({x}_goal - f) / r ELSE 1 END ELSE {x}_goal / f END AS w FROM (SELECT *, {fixed} AS f, {rest} AS r FROM w{k - 1}))")
    draw_sql = f"CAST(concat('0x', substring(md5(concat(coalesce(CAST(d.doc_id AS VARCHAR), concat('text|', d.text)), '|{SEED}')), 1, 13)) AS BIGINT) / {float(1 << 52)}"
    return "WITH " + ",\n".join(ctes) + f"\nSELECT d.doc_id, d.source, d.lang, d.topic, d.n_tokens, round(least(1.0, w), 9) AS probability, {draw_sql} < least(1.0, w) AS kept FROM d JOIN w{k} w ON d.source IS NOT DISTINCT FROM w.source AND d.lang IS NOT DISTINCT FROM w.lang AND d.topic = w.topic"
