"""Matrices, comparisons, fixed-point functions, pooling, convolution and the network."""

from __future__ import annotations

import contextlib

from pyspark.sql import functions as F

from ..functions import field as fd
from ..operators import blocks, linalg, model, nonlinear, sharing, spatial
from ..sources import batches
from ..sources.tables import table, vectors
from ..spec import FieldSpec
from .registry import MLP, P, S, SOFTMAX, W1, W2, X, fix, h, lift, mod, msum, mul, pade, query, rs

ONE = FieldSpec()
W = model.Weights.start(64, 8, 10, S)
KERNEL = [[model.hash60("kernel", i, j) % 7 - 3 for j in range(3)] for i in range(3)]


def cells(spark, d):
    """Embeddings as (vec_id, j, y)."""
    return linalg.long_form(vectors(spark, d, S), "vec_id", "x")


def logits(spark, d):
    return model.forward(vectors(spark, d, S), W, S)


def probabilities(spark, d):
    return nonlinear.softmax(logits(spark, d), "z2", 10, "p", S)


def classes(df, col, name="y"):
    return df.select("vec_id", F.posexplode_outer(col).alias("class", name))


@query(f"WITH {MLP} SELECT vec_id, CAST(i AS INT) AS i, z AS y FROM z1")
def matmul_fixed_point(spark, d):
    own = vectors(spark, d, S).withColumn("z", linalg.dense(F.col("x"), W.w1, W.b1, S))
    return own.select("vec_id", F.posexplode_outer("z").alias("i", "y"))


@query(f"WITH {X}, {W1} SELECT x.vec_id, CAST(w1.i AS INT) AS i, CAST(sum({rs('x.y * w1.w', S)}) AS BIGINT) AS y FROM x JOIN w1 USING (j) GROUP BY x.vec_id, w1.i")
def matvec_per_term(spark, d):
    own = vectors(spark, d, S).withColumn("z", linalg.dense_per_term(F.col("x"), W.w1, S))
    return own.select("vec_id", F.posexplode_outer("z").alias("i", "y"))


@query(f"WITH {X}, {W1} SELECT x.vec_id, CAST(w1.i AS INT) AS i, {mod('CAST(sum(x.y * w1.w) AS BIGINT)')} AS y FROM x JOIN w1 USING (j) GROUP BY x.vec_id, w1.i")
def packed_matvec_public(spark, d):
    """Public weights on shares: shares of the products, opened at the end."""
    own = cells(spark, d).withColumn("s", fd.field(F.col("y"), P)).drop("y")
    shares = sharing.share(own, "s", ["vec_id", "j"], ONE, "mv")
    w = [F.struct(F.lit(i).alias("i"), F.lit([v % P for v in row]).cast("array<bigint>").alias("w")) for i, row in enumerate(W.w1)]
    use = shares.where(F.col("party") <= 2).withColumn("_r", F.explode(F.array(*w))).select("vec_id", "party", "_r.i", fd.mulmod(F.col("y"), F.get(F.col("_r.w"), F.col("j")), P).alias("y"))
    by_party = use.groupBy("vec_id", "i", "party").agg(fd.modsum(F.col("y"), P).alias("y"))
    return sharing.reconstruct(by_party, ["vec_id", "i"], ONE, out="y")


def every(spark, d):
    return cells(spark, d).select(F.col("vec_id").alias("i"), "j", fd.field(F.col("y"), P).alias("y"))


@query(f"WITH {X} SELECT CAST(a.j AS INT) AS i, CAST(b.j AS INT) AS j, {msum(mul(mod('a.y'), mod('b.y')))} AS y FROM x a JOIN x b ON a.vec_id = b.vec_id GROUP BY a.j, b.j")
def matmul_raw(spark, d):
    """The product of the transposed matrix with itself, by blocks: as large as the components are many."""
    own = vectors(spark, d, S)
    tall = blocks.of_rows(own, "vec_id", "x", 64, ONE)
    found = blocks.plain_product(blocks.of_rows(own, "vec_id", "x", 64, ONE, transposed=True), tall, ONE)
    return blocks.cells(found).select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "y")


SOLD = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(f"""WITH {X}, l AS (SELECT l_partkey, unnest([0, 1, 2, 3]) AS c, unnest([{', '.join(f'sum(CAST({fix(c)} AS HUGEINT))' for c in SOLD)}]) AS v FROM lineitem GROUP BY l_partkey),
s AS (SELECT x.j AS i, l.c AS j, sum(CAST(x.y AS HUGEINT) * l.v) % {P} AS y FROM x JOIN l ON l.l_partkey = x.vec_id GROUP BY x.j, l.c),
f AS (SELECT i, j, CASE WHEN y < 0 THEN y + {P} ELSE y END AS y FROM s)
SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, {rs(lift('y'), S)} AS y FROM f""")
def matrix_product_shared(spark, d):
    """Both matrices are shared: embeddings, transposed, times what was sold of the part of that number
    (zero for vectors without one). Products come from matrix triples, a block at a time; the sum
    is opened and divided by the scale once."""
    sold = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.array(*(F.sum(fd.fixed(F.col(c), S)) for c in SOLD)).alias("v"))
    x = blocks.shared(blocks.of_rows(vectors(spark, d, S), "vec_id", "x", 64, ONE, transposed=True), "x", ONE)
    y = blocks.shared(blocks.of_rows(sold, "l_partkey", "v", len(SOLD), ONE), "y", ONE)
    out = blocks.cells(blocks.opened(blocks.product(x, y, ONE), ONE))
    return out.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), fd.rescale(fd.lift(F.col("y"), P), S).alias("y"))


@query(f"WITH {X} SELECT a.vec_id, CAST(a.j AS INT) AS i, CAST(b.j AS INT) AS j, {rs('a.y * b.y', S)} AS y FROM x a JOIN x b ON a.vec_id = b.vec_id")
def outer_product(spark, d):
    rows = vectors(spark, d, S).select("vec_id", "x", F.posexplode_outer("x").alias("i", "a")).select("vec_id", "i", "a", F.posexplode_outer("x").alias("j", "b"))
    return rows.select("vec_id", "i", "j", fd.rescale(F.col("a") * F.col("b"), S).alias("y"))


@query(f"WITH {X} SELECT CAST(j AS INT) AS i, vec_id AS j, {mod('y')} AS y FROM x")
def transpose(spark, d):
    return linalg.transpose(every(spark, d))


@query(f"WITH {X} SELECT vec_id AS i, CAST(j AS INT) AS j, ({mod('y')} + {mod('y')}) % {P} AS y FROM x")
def matrix_add(spark, d):
    return linalg.add(every(spark, d), every(spark, d), P)


@query(f"WITH {X} SELECT vec_id AS i, CAST(j AS INT) AS j, {mul(mod('y'), 777)} AS y FROM x")
def matrix_scale(spark, d):
    return linalg.scale_by(every(spark, d), 777, P)


@query(f"""WITH a AS (SELECT s_suppkey, i, k, {h("'A'", 's_suppkey', 'i', 'k')} AS y FROM supplier, range(3) r(i), range(4) q(k)), b AS (SELECT s_suppkey, k, j, {h("'B'", 's_suppkey', 'k', 'j')} AS y FROM supplier, range(4) r(k), range(2) q(j))
SELECT s_suppkey, CAST(a.i AS INT) AS i, CAST(b.j AS INT) AS j, {msum(mul('a.y', 'b.y'))} AS y FROM a JOIN b USING (s_suppkey, k) GROUP BY s_suppkey, a.i, b.j""")
def matrix_triple(spark, d):
    """A triple of small matrices for each supplier, 3 by 4 times 4 by 2: C = A B, from keyed hashes."""
    own = table(spark, d, "supplier").select("s_suppkey")
    key = F.col("s_suppkey")
    grid = lambda name, n, m: F.array(*(F.array(*(fd.hash60(name, key, i, j) for j in range(m))) for i in range(n)))
    own = own.withColumns({"a": grid("A", 3, 4), "b": grid("B", 4, 2)})
    cell = lambda i, j: [fd.mulmod(F.get(F.get("a", F.lit(i)), F.lit(k)), F.get(F.get("b", F.lit(k)), F.lit(j)), P) for k in range(4)]
    rows = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), ((c[0] + c[1]) % P + (c[2] + c[3]) % P).alias("y")) for i in range(3) for j in range(2) for c in [cell(i, j)]]
    return own.select("s_suppkey", F.explode(F.array(*rows)).alias("r")).select("s_suppkey", "r.i", "r.j", (F.col("r.y") % P).alias("y"))


@query(f"""WITH o AS (SELECT o_orderkey, {mod(fix('o_totalprice'))} AS a, {mod(fix('o_totalprice - 150000'))} AS b, {mod('o_orderkey % 3')} AS c FROM orders)
SELECT o_orderkey, CASE WHEN {lift(mod('a - b'))} > 0 THEN 1 ELSE 0 END AS gt, CASE WHEN {lift(mod('b - a'))} > 0 THEN 1 ELSE 0 END AS lt, CASE WHEN c = 1 THEN 1 ELSE 0 END AS eq FROM o""")
def compare_gt_lt_eq(spark, d):
    own = table(spark, d, "orders").select("o_orderkey", fd.encode(F.col("o_totalprice"), ONE).alias("a"), fd.encode(F.col("o_totalprice") - 150000, ONE).alias("b"))
    return own.select("o_orderkey", nonlinear.greater(F.col("a"), F.col("b"), P).alias("gt"), nonlinear.less(F.col("a"), F.col("b"), P).alias("lt"), nonlinear.equal(F.col("o_orderkey") % 3, F.lit(1).cast("long"), P).alias("eq"))


@query(f"WITH {X} SELECT vec_id, CAST(j AS INT) AS j, greatest(y, 0) AS a, CASE WHEN y > 0 THEN 1 ELSE 0 END AS mask FROM x")
def relu(spark, d):
    return cells(spark, d).select("vec_id", "j", nonlinear.relu(F.col("y")).alias("a"), (F.col("y") > 0).cast("int").alias("mask"))


@query(f"WITH {X} SELECT vec_id, CAST(j AS INT) AS j, CASE WHEN y > 0 THEN y * 3 ELSE 0 END AS g FROM x")
def relu_backward(spark, d):
    return cells(spark, d).select("vec_id", "j", nonlinear.relu_backward(F.col("y") * 3, F.col("y")).alias("g"))


@query(f"SELECT c_custkey, greatest(least({fix('c_acctbal')}, {4000 * S}), {-500 * S}) AS y FROM customer")
def clip_values(spark, d):
    return table(spark, d, "customer").select("c_custkey", fd.clip(fd.fixed(F.col("c_acctbal"), S), -500 * S, 4000 * S).alias("y"))


@query(f"WITH {X} SELECT vec_id, CAST(sum(y * y) AS BIGINT) AS norm_sq, sum(y * y) > {S * S // 2} AS needs_clip FROM x GROUP BY vec_id")
def norm_clip(spark, d):
    n = F.aggregate("x", F.lit(0).cast("long"), lambda s, v: s + v * v)
    return vectors(spark, d, S).select("vec_id", n.alias("norm_sq"), (n > S * S // 2).alias("needs_clip"))


@query(f"WITH t AS (SELECT o_custkey AS key, CAST(sum({fix('o_totalprice', 100)}) AS BIGINT) AS total, count(*) AS n FROM orders GROUP BY o_custkey) SELECT key, total, {rs('total', 'n')} AS y FROM t")
def secure_average(spark, d):
    own = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), fd.fixed(F.col("o_totalprice"), 100).alias("v"))
    return own.groupBy("key").agg(F.sum("v").alias("total"), F.count("*").alias("n")).select("key", "total", fd.rescale(F.col("total"), F.col("n")).alias("y"))


@query(f"SELECT o_orderkey AS key, {rs('(' + fix('o_totalprice', 100) + ' - 15000000)', 7)} AS y FROM orders")
def scalar_divide(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), fd.rescale(fd.fixed(F.col("o_totalprice"), 100) - 15000000, 7).alias("y"))


@query(f"SELECT o_orderkey AS key, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE {rs(fix('o_totalprice', 100) + f' * {S}', 'o_orderkey % 5')} END AS y, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE {rs(fix('o_totalprice', 100) + f' * {S}', 'o_orderkey % 5')} END AS y_zero FROM orders")
def divide_shares(spark, d):
    num, den = fd.fixed(F.col("o_totalprice"), 100), F.col("o_orderkey") % 5
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), nonlinear.divide(num, den, S, "null").alias("y"), nonlinear.divide(num, den, S, "zero").alias("y_zero"))


def _taylor() -> str:
    x2 = rs("y * y", S)
    x3 = rs(f"{x2} * y", S)
    x4 = rs("p3 * y", S)
    x5 = rs("p4 * y", S)
    return f"""WITH {X}, t3 AS (SELECT vec_id, j, y, {x2} AS p2, {x3} AS p3 FROM x), t4 AS (SELECT *, {x4} AS p4 FROM t3), t5 AS (SELECT *, {x5} AS p5 FROM t4)
    SELECT vec_id, CAST(j AS INT) AS j, y + {S} + {rs('p2', 2)} + {rs('p3', 6)} + {rs('p4', 24)} + {rs('p5', 120)} AS y FROM t5"""


@query(_taylor())
def exp_taylor5(spark, d):
    return cells(spark, d).select("vec_id", "j", nonlinear.exp_taylor5(F.col("y"), S).alias("y"))


@query(f"WITH {X} SELECT vec_id, CAST(j AS INT) AS j, {pade('y')} AS y FROM x")
def exp_pade22(spark, d):
    return cells(spark, d).select("vec_id", "j", nonlinear.exp_pade22(F.col("y"), S).alias("y"))


def _log(source: str, keys: str, terms: int = 5) -> str:
    """CTEs that end in lg(keys, y): the series over source(keys, v)."""
    out = [f"l1 AS (SELECT {keys}, {rs(f'(CASE WHEN v + {S} < 0 THEN -1 ELSE 1 END) * (v - {S}) * {S}', f'abs(v + {S})')} AS a FROM {source})", f"l2 AS (SELECT {keys}, a, {rs('a * a', S)} AS sq, a AS p1 FROM l1)"]
    for k in range(1, terms):
        out.append(f"l{k + 2} AS (SELECT *, {rs(f'p{k} * sq', S)} AS p{k + 1} FROM l{k + 1})")
    total = " + ".join(["a", *(rs(f"p{k + 1}", 2 * k + 1) for k in range(1, terms))])
    return ", ".join(out) + f", lg AS (SELECT {keys}, CAST(2 * ({total}) AS BIGINT) AS y FROM l{terms + 1})"


@query(f"WITH {X}, src AS (SELECT vec_id, j, abs(y) + 1000 AS v FROM x), {_log('src', 'vec_id, j')} SELECT vec_id, CAST(j AS INT) AS j, y FROM lg")
def log_atanh(spark, d):
    own = cells(spark, d).withColumn("v", F.abs("y") + 1000)
    v = F.col("v")
    return own.select("vec_id", "j", nonlinear.log_atanh(v, S).alias("y"))


@query(f"WITH {MLP} SELECT vec_id, CAST(class AS INT) AS class, y AS logit FROM z2")
def mlp_forward(spark, d):
    return classes(logits(spark, d), "z2", "logit")


@query(f"WITH {MLP} SELECT vec_id, CAST(class AS INT) AS class, y AS logit FROM z2")
def mlp_forward_shared(spark, d):
    """The first layer on shares with public weights, opened before the rounding; then as above."""
    z = packed_matvec_public(spark, d).select("vec_id", F.struct("i", fd.rescale(fd.lift(F.col("y"), P), S).alias("v")).alias("s"))
    own = z.groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: nonlinear.relu(s["v"])).alias("a1"))  # one entry a unit
    return classes(own.withColumn("z2", linalg.dense(F.col("a1"), W.w2, W.b2, S)), "z2", "logit")


@query(f"WITH {SOFTMAX} SELECT vec_id, CAST(class AS INT) AS class, CAST(prob AS BIGINT) AS prob FROM sm")
def softmax_fixed(spark, d):
    return classes(probabilities(spark, d), "p", "prob")


@query(f"""WITH {SOFTMAX}, src AS (SELECT sm.vec_id, CAST(greatest(prob, 1) AS BIGINT) AS v FROM sm JOIN embeddings e ON e.vec_id = sm.vec_id AND e.label = sm.class), {_log('src', 'vec_id')}
SELECT vec_id, -y AS loss FROM lg""")
def cross_entropy(spark, d):
    own = probabilities(spark, d).select("vec_id", F.greatest(F.get("p", F.col("label")), F.lit(1).cast("long")).alias("v"))
    return own.select("vec_id", (-nonlinear.log_atanh(F.col("v"), S)).alias("loss"))


@query(f"WITH {SOFTMAX} SELECT sm.vec_id, CAST(class AS INT) AS class, CAST(prob - CASE WHEN e.label = sm.class THEN {S} ELSE 0 END AS BIGINT) AS y FROM sm JOIN embeddings e ON e.vec_id = sm.vec_id")
def ce_gradient(spark, d):
    own = probabilities(spark, d)
    g = F.transform("p", lambda v, c: v - F.when(c == F.col("label"), F.lit(S)).otherwise(F.lit(0)))
    return classes(own.select("vec_id", g.alias("g")), "g")


_EXACT = f"e1 AS (SELECT vec_id, class, CAST(y AS DOUBLE) / {S} AS v FROM z2), e2 AS (SELECT vec_id, class, exp(v - max(v) OVER (PARTITION BY vec_id)) AS e FROM e1), e3 AS (SELECT vec_id, class, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM e2)"


def exact(spark, d):
    n = range(10)
    own = logits(spark, d).select("vec_id", "label", "z2", *((F.get("z2", F.lit(i)).cast("double") / S).alias(f"v{i}") for i in n))
    own = own.withColumn("m", F.greatest(*(F.col(f"v{i}") for i in n)))
    own = own.withColumns({f"e{i}": F.exp(F.col(f"v{i}") - F.col("m")) for i in n})
    own = own.withColumn("t", spatial.total([F.col(f"e{i}") for i in n]))
    return own.select("vec_id", "label", "z2", F.array(*(F.col(f"e{i}") / F.col("t") for i in n)).alias("p"))


@query(f"WITH {MLP}, {_EXACT} SELECT e3.vec_id, CAST(class AS INT) AS class, round(p - CASE WHEN b.label = e3.class THEN 1 ELSE 0 END, 6) AS y FROM e3 JOIN embeddings b ON b.vec_id = e3.vec_id")
def ce_gradient_exact(spark, d):
    g = F.transform("p", lambda v, c: F.round(v - F.when(c == F.col("label"), F.lit(1.0)).otherwise(F.lit(0.0)), 6))
    return classes(exact(spark, d).select("vec_id", g.alias("g")), "g")


@query(f"WITH {MLP} SELECT z2.vec_id, CAST(class AS INT) AS class, {rs(f'greatest(least(y - CASE WHEN e.label = z2.class THEN {S} ELSE 0 END, {4 * S}), {-4 * S})', 10)} AS y FROM z2 JOIN embeddings e ON e.vec_id = z2.vec_id")
def mse_gradient(spark, d):
    g = F.transform("z2", lambda v, c: fd.rescale(fd.clip(v - F.when(c == F.col("label"), F.lit(S)).otherwise(F.lit(0)), -4 * S, 4 * S), 10))
    return classes(logits(spark, d).select("vec_id", g.alias("g")), "g")


@query(f"WITH {MLP}, q AS (SELECT z2.vec_id, y - CASE WHEN e.label = z2.class THEN {S} ELSE 0 END AS v FROM z2 JOIN embeddings e ON e.vec_id = z2.vec_id) SELECT vec_id, {msum(mul(mod('v'), mod('v')))} AS loss FROM q GROUP BY vec_id")
def mse_loss(spark, d):
    own = logits(spark, d).select("vec_id", "label", F.posexplode_outer("z2").alias("class", "y"))
    v = fd.field(F.col("y") - F.when(F.col("class") == F.col("label"), F.lit(S)).otherwise(F.lit(0)), P)
    return own.withColumn("v", v).groupBy("vec_id").agg(fd.modsum(fd.mulmod(F.col("v"), F.col("v"), P), P).alias("loss"))


def _image() -> str:
    return f"{X}, im AS (SELECT vec_id, CAST(j // 8 AS INT) AS h, CAST(j % 8 AS INT) AS w, y FROM x)"


def image(spark, d):
    return vectors(spark, d, S)


def _pool(agg: str) -> str:
    return f"WITH {_image()} SELECT vec_id, CAST(h // 2 AS INT) AS ho, CAST(w // 2 AS INT) AS wo, {agg} AS y FROM im GROUP BY vec_id, h // 2, w // 2"


@query(_pool("CAST(sum(y) AS BIGINT)"))
def pool_sum(spark, d):
    return image(spark, d).select("vec_id", spatial.pool(F.col("x"), 8, 8))


@query(_pool("max(y)"))
def pool_max(spark, d):
    return image(spark, d).select("vec_id", spatial.pool(F.col("x"), 8, 8, kind="max"))


@query(_pool(rs("CAST(sum(y) AS BIGINT)", 4)))
def pool_avg(spark, d):
    return image(spark, d).select("vec_id", spatial.pool(F.col("x"), 8, 8, kind="avg"))


@query(f"""WITH {_image()}, g AS (SELECT vec_id, h // 2 AS ho, w // 2 AS wo, sum(y) AS y FROM im GROUP BY ALL)
SELECT im.vec_id, im.h, im.w, CAST(g.y AS BIGINT) AS y FROM im JOIN g ON g.vec_id = im.vec_id AND g.ho = im.h // 2 AND g.wo = im.w // 2""")
def pool_backward(spark, d):
    sums = [F.array(*(spatial.total([spatial.at(F.col("x"), c) for _, _, c in cells_]) for _, _, cells_ in spatial.windows(8, 8, 2, 2)))]
    return image(spark, d).select("vec_id", sums[0].alias("g")).select("vec_id", spatial.pool_backward(F.col("g"), 8, 8))


_K = "k AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {j}, {v})" for i, row in enumerate(KERNEL) for j, v in enumerate(row)) + ") v(kh, kw, kv))"


@query(f"WITH {_image()}, {_K} SELECT vec_id, CAST(h - kh + 1 AS INT) AS ho, CAST(w - kw + 1 AS INT) AS wo, CAST(sum(y * kv) AS BIGINT) AS y FROM im, k WHERE h - kh + 1 BETWEEN 0 AND 7 AND w - kw + 1 BETWEEN 0 AND 7 GROUP BY ALL")
def conv2d(spark, d):
    return image(spark, d).select("vec_id", spatial.conv2d(F.col("x"), KERNEL, 8, 8, 1, 1))


@query(f"WITH {_image()}, {_K} SELECT vec_id, CAST((h - kh) // 2 AS INT) AS ho, CAST((w - kw) // 2 AS INT) AS wo, CAST(sum(y * kv) AS BIGINT) AS y FROM im, k WHERE h >= kh AND w >= kw AND (h - kh) % 2 = 0 AND (w - kw) % 2 = 0 AND (h - kh) // 2 < 3 AND (w - kw) // 2 < 3 GROUP BY ALL")
def conv2d_simple(spark, d):
    return image(spark, d).select("vec_id", spatial.conv2d(F.col("x"), KERNEL, 8, 8, 2, 0))


@query(f"WITH {_image()}, o AS (SELECT a.vec_id, a.h - b.h + 1 AS kh, a.w - b.w + 1 AS kw, a.y * b.y AS v FROM im a JOIN im b ON a.vec_id = b.vec_id AND a.h - b.h + 1 BETWEEN 0 AND 2 AND a.w - b.w + 1 BETWEEN 0 AND 2) SELECT CAST(kh AS INT) AS kh, CAST(kw AS INT) AS kw, CAST(sum(v) AS BIGINT) AS y FROM o GROUP BY kh, kw")
def conv2d_grad_kernel(spark, d):
    own = image(spark, d).select("vec_id", spatial.conv2d_grad_kernel(F.col("x"), F.col("x"), 3, 8, 8, 1, 1))
    return own.groupBy("kh", "kw").agg(F.sum("y").alias("y"))


@query(f"WITH {_image()}, {_K} SELECT vec_id, CAST(h + kh - 1 AS INT) AS h, CAST(w + kw - 1 AS INT) AS w, CAST(sum(y * kv) AS BIGINT) AS y FROM im, k WHERE h + kh - 1 BETWEEN 0 AND 7 AND w + kw - 1 BETWEEN 0 AND 7 GROUP BY vec_id, h + kh - 1, w + kw - 1")
def conv2d_grad_input(spark, d):
    return image(spark, d).select("vec_id", spatial.conv2d_grad_input(F.col("x"), KERNEL, 8, 8, 1, 1))


@query(f"WITH {MLP} SELECT vec_id, CAST(class AS INT) AS pred, y AS logit FROM z2 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY y DESC, class) = 1")
def mlp_predict(spark, d):
    return logits(spark, d).select("vec_id", model.argmax(F.col("z2")).alias("pred"), F.array_max("z2").alias("logit"))


@query(f"""WITH {MLP}, {_EXACT}, v AS (SELECT vec_id, max(abs(y)) AS m, sum(abs(y)) / 10.0 AS a FROM z2 GROUP BY vec_id), t AS (SELECT vec_id, class FROM z2 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY y DESC, class) = 1),
n AS (SELECT vec_id, sum(-p * ln(greatest(p, 1e-12))) AS ent FROM e3 GROUP BY vec_id)
SELECT round(avg(CASE WHEN t.class = b.label THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(-ln(greatest(e3.p, 1e-12))), 6) AS loss, CAST(max(m) AS BIGINT) AS max_logit, round(avg(ent), 6) AS entropy, round(avg(a), 3) AS mean_abs
FROM embeddings b JOIN t USING (vec_id) JOIN e3 ON e3.vec_id = b.vec_id AND e3.class = b.label JOIN v ON v.vec_id = b.vec_id JOIN n ON n.vec_id = b.vec_id""")
def mlp_eval_metrics(spark, d):
    ent = F.aggregate("p", F.lit(0.0), lambda s, x: s - x * F.log(F.greatest(x, F.lit(1e-12))))
    size = F.transform("z2", lambda x: F.abs(x))
    own = exact(spark, d).select((model.argmax(F.col("z2")) == F.col("label")).cast("double").alias("hit"), (-F.log(F.greatest(F.get("p", F.col("label")), F.lit(1e-12)))).alias("ce"), F.array_max(size).alias("m"), ent.alias("ent"), (F.aggregate(size, F.lit(0).cast("long"), lambda s, x: s + x) / 10.0).alias("a"))
    return own.agg(F.round(F.avg("hit"), 6).alias("accuracy"), F.round(F.avg("ce"), 6).alias("loss"), F.max("m").alias("max_logit"), F.round(F.avg("ent"), 6).alias("entropy"), F.round(F.avg("a"), 3).alias("mean_abs"))


_GRADS = f"""{SOFTMAX},
d2 AS (SELECT sm.vec_id, class, CAST(prob - CASE WHEN e.label = sm.class THEN {S} ELSE 0 END AS BIGINT) AS g FROM sm JOIN embeddings e ON e.vec_id = sm.vec_id),
da AS (SELECT d2.vec_id, w2.j, {rs('CAST(sum(d2.g * w2.w) AS BIGINT)', S)} AS g FROM d2 JOIN w2 ON w2.i = d2.class GROUP BY d2.vec_id, w2.j),
d1 AS (SELECT da.vec_id, da.j AS i, CASE WHEN z1.z > 0 THEN da.g ELSE 0 END AS g FROM da JOIN z1 ON z1.vec_id = da.vec_id AND z1.i = da.j),
gr AS (SELECT 'w1' AS layer, d1.i, x.j, sum({rs('d1.g * x.y', S)}) AS y FROM d1 JOIN x ON x.vec_id = d1.vec_id GROUP BY d1.i, x.j
UNION ALL SELECT 'b1', i, 0, sum(g) FROM d1 GROUP BY i
UNION ALL SELECT 'w2', d2.class, a1.j, sum({rs('d2.g * a1.a', S)}) FROM d2 JOIN a1 ON a1.vec_id = d2.vec_id GROUP BY d2.class, a1.j
UNION ALL SELECT 'b2', class, 0, sum(g) FROM d2 GROUP BY class)"""


@query(f"WITH {_GRADS} SELECT layer, CAST(i AS INT) AS i, CAST(j AS INT) AS j, CAST(y AS BIGINT) AS y FROM gr")
def mlp_gradients(spark, d):
    return model.gradients(vectors(spark, d, S), W, S)


_RATE = round(0.05 * S)


@query(f"""WITH {_GRADS}, w AS (SELECT 'w1' AS layer, i, j, w AS v FROM w1 UNION ALL SELECT 'w2', i, j, w FROM w2 UNION ALL SELECT 'b1', i, 0, 0 FROM range(8) r(i) UNION ALL SELECT 'b2', i, 0, 0 FROM range(10) r(i))
SELECT w.layer, CAST(w.i AS INT) AS i, CAST(w.j AS INT) AS j, CAST(w.v - {rs(f'CAST(gr.y AS BIGINT) * {_RATE}', f'({S} * (SELECT count(*) FROM embeddings))')} AS BIGINT) AS y FROM w JOIN gr ON gr.layer = w.layer AND gr.i = w.i AND gr.j = w.j""")
def mlp_sgd_step(spark, d):
    """One step over all rows: the summed gradients are divided by the number of rows."""
    rows = spark.createDataFrame(W.rows(), "layer string, i int, j int, v long")
    n = max(1, table(spark, d, "embeddings").count())
    g = rows.join(mlp_gradients(spark, d), ["layer", "i", "j"], "left")
    return g.select("layer", "i", "j", (F.col("v") - fd.rescale(F.coalesce("y", F.lit(0).cast("long")) * _RATE, S * n)).alias("y"))


@query()
def mlp_train_epochs(spark, d):
    """Two epochs over all embeddings; weights as (layer, i, j, y)."""
    own = vectors(spark, d, S).withColumnRenamed("vec_id", "id")
    w = model.train(own, W, S, 0.05, 256, 2)
    return spark.createDataFrame(w.rows(), "layer string, i int, j int, y long")


@query()
def mlp_train_resumed(spark, d):
    """The same two epochs by a run that stops after its first step and another that goes on from that
    commit, in stretches of steps; the weights equal those of mlp_train_epochs."""
    own = vectors(spark, d, S).withColumnRenamed("vec_id", "id")
    base = batches.new_folder(spark, "resumed")
    with contextlib.suppress(model.Paused):
        model.train(own, W, S, 0.05, 256, 2, base=base, stop_after=1)
    w = model.train(own, W, S, 0.05, 256, 2, base=base)
    batches.delete(spark, base)
    return spark.createDataFrame(w.rows(), "layer string, i int, j int, y long")


@query(f"WITH o AS (SELECT event_id, row_number() OVER (ORDER BY {h(2026, 'event_id')}, event_id) - 1 AS n FROM events) SELECT CAST(n // 64 AS BIGINT) AS batch, CAST(n % 64 AS INT) AS pos, event_id AS id FROM o")
def stored_batches(spark, d):
    """Batches as the store holds them: written once in the epoch's order, 64 rows each."""
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), "value")
    path = batches.cluster(rows, batches.new_folder(spark, "batches"), 64, 2026, 0)
    return spark.read.parquet(path).select("batch", "pos", "id")
