"""Registers queries with their SQL, and the SQL fragments that they share."""

from __future__ import annotations

from collections.abc import Callable

from ..spec import P61

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
P, S = P61, 1 << 16


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def h(*parts: object) -> str:
    """The keyed hash of SQL expressions (strings starting with ' are literals)."""
    return f"CAST(concat('0x', substr(sha256(concat_ws('|', {', '.join(f'CAST({x} AS VARCHAR)' for x in parts)})), 1, 15)) AS BIGINT)"


def mul(a: str, b: object, p: int = P) -> str:
    return f"CAST((CAST({a} AS HUGEINT) * CAST({b} AS HUGEINT)) % {p} AS BIGINT)"


def msum(x: str, p: int = P) -> str:
    return f"CAST(sum(CAST({x} AS HUGEINT)) % {p} AS BIGINT)"


def fix(v: str, s: int = S) -> str:
    return f"CAST(round(CAST({v} AS DOUBLE) * {s}) AS BIGINT)"


def mod(v: str, p: int = P) -> str:
    return f"((({v}) % {p} + {p}) % {p})"


def lift(y: str, p: int = P) -> str:
    return f"(CASE WHEN {y} > {p // 2} THEN {y} - {p} ELSE {y} END)"


def rs(v: str, d: object) -> str:
    """To the nearest, halves away from zero."""
    return f"CAST((CASE WHEN ({v}) < 0 THEN -1 ELSE 1 END) * ((2 * abs({v}) + ({d})) // (2 * ({d}))) AS BIGINT)"


#: Embeddings as (vec_id, label, j, y) in fixed point, and hash-made weights.
X = f"x AS (SELECT vec_id, label, unnest(range(0, 64)) AS j, {fix('unnest(embedding)')} AS y FROM embeddings)"
W1 = f"w1 AS (SELECT a.i, b.j, {h(chr(39) + 'w1' + chr(39), 'a.i', 'b.j')} % {2 * S + 1} - {S} AS w FROM range(8) a(i), range(64) b(j))"
W2 = f"w2 AS (SELECT a.i, b.j, {h(chr(39) + 'w2' + chr(39), 'a.i', 'b.j')} % {2 * S + 1} - {S} AS w FROM range(10) a(i), range(8) b(j))"
#: The mean vector of each label as a layer's weights, in fixed point.
MEANS = f"pr AS (SELECT 'w' AS layer, label AS i, j, {rs('CAST(sum(y) AS BIGINT)', 'count(*)')} AS w FROM x GROUP BY label, j)"
MLP = f"""{X}, {W1}, {W2},
z1 AS (SELECT x.vec_id, w1.i, {rs('sum(x.y * w1.w)', S)} AS z FROM x JOIN w1 USING (j) GROUP BY x.vec_id, w1.i),
a1 AS (SELECT vec_id, i AS j, greatest(z, 0) AS a FROM z1),
z2 AS (SELECT a1.vec_id, w2.i AS class, {rs('sum(a1.a * w2.w)', S)} AS y FROM a1 JOIN w2 USING (j) GROUP BY a1.vec_id, w2.i)"""


def pade(x: str) -> str:
    sq = rs(rs(f"{x} * {x}", S), 12)
    return rs(f"({sq} + {rs(x, 2)} + {S}) * {S}", f"{sq} - {rs(x, 2)} + {S}")


SOFTMAX = f"""{MLP},
s1 AS (SELECT vec_id, class, y, greatest(least(y - max(y) OVER (PARTITION BY vec_id), {4 * S}), {-4 * S}) AS c FROM z2),
s2 AS (SELECT vec_id, class, y, greatest(least({pade('c')}, {55 * S}), 1) AS e FROM s1),
s3 AS (SELECT vec_id, class, y, e, CAST(sum(e) OVER (PARTITION BY vec_id) AS BIGINT) AS t FROM s2),
s4 AS (SELECT vec_id, class, y, greatest(least({rs(f'e * {S}', 't')}, {S}), 0) AS q FROM s3),
sm AS (SELECT vec_id, class, y, q + CASE WHEN row_number() OVER (PARTITION BY vec_id ORDER BY q DESC, class) = 1 THEN CAST({S} - sum(q) OVER (PARTITION BY vec_id) AS BIGINT) ELSE 0 END AS prob FROM s4)"""
