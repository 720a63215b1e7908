"""The query catalogue: every query of the array algebra, with the SQL that checks it.

Values are taken to exact integers where the order of a sum could change a
double (cents of a price, 2^-20 units of an embedding); other doubles are
rounded.  Sorted results carry their position.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import philox as ph
from ..functions import unitfloat8 as u8
from ..operators import order, product, reduce, scan, search
from ..sources import tables as t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SEED = 0x1234_5678_9ABC


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    def made(spark: SparkSession, sf_dir: str) -> DataFrame:
        _columns()
        return run(spark, sf_dir)

    QUERIES[name] = made
    if sql is not None:
        ORACLE_SQL[name] = sql


def _columns() -> None:
    """Names the columns that queries share; columns need a session, which importing does not."""
    global v, c, p, _r, _s, _affine
    v, c, p, _r, _s = (F.col(k) for k in ("v", "c", "p", "r", "s"))
    _affine = F.struct((F.pmod(c, F.lit(97)) + 1).alias("a"), F.pmod(c, F.lit(89)).alias("b"))


def _cents(c: str):
    return F.round(F.col(c) * 100).cast("long")


def _wide(x):
    """Whole numbers whose products and their sums do not fit in 64 bits."""
    return x.cast("decimal(18,0)")


def _rounded(x, digits: int):
    """Doubles rounded as the SQL does it: the double product is rounded, a half away from zero; F.round rounds the decimal digits instead."""
    return F.round(x * 10.0**digits) / 10.0**digits


def events(s: SparkSession, d: str) -> DataFrame:
    return t.vector(t.read(s, d, "events"), "event_id", v="value", c=_cents("value"))


def orders(s: SparkSession, d: str) -> DataFrame:
    return t.vector(t.read(s, d, "orders"), "o_orderkey", v="o_totalprice", c=_cents("o_totalprice"), pr="o_orderpriority", cust="o_custkey")


def customer(s: SparkSession, d: str) -> DataFrame:
    return t.vector(t.read(s, d, "customer"), "c_custkey", v="c_acctbal", c=_cents("c_acctbal"), nation="c_nationkey")


def lines(s: SparkSession, d: str) -> DataFrame:
    return t.read(s, d, "lineitem").select(F.col("l_quantity").cast("long").alias("q"), _cents("l_extendedprice").alias("p"), _cents("l_discount").alias("disc"))


def cells(s: SparkSession, d: str) -> DataFrame:
    return t.tensor(events(s, d), 10, 10)


def coo(s: SparkSession, d: str) -> DataFrame:
    return t.matrix(t.read(s, d, "embeddings"), "vec_id", "embedding").select("i", "j", F.floor(F.col("v").cast("double") * 1048576).cast("long").alias("v"))


def rows(s: SparkSession, d: str) -> DataFrame:
    return t.read(s, d, "embeddings").select(F.col("vec_id").alias("i"), F.transform("embedding", lambda e: F.floor(e.cast("double") * 1048576).cast("long")).alias("row"))


def first_row(s: SparkSession, d: str, k: int = 0) -> list[int]:
    """One row of the matrix: as many numbers as it has columns."""
    return rows(s, d).filter(F.col("i") == k).first()["row"]


EV = "(SELECT event_id AS idx, value AS v, CAST(round(value * 100) AS BIGINT) AS c FROM events)"
OR = "(SELECT o_orderkey AS idx, o_totalprice AS v, CAST(round(o_totalprice * 100) AS BIGINT) AS c, o_orderpriority AS pr, o_custkey AS cust FROM orders)"
CU = "(SELECT c_custkey AS idx, c_acctbal AS v, CAST(round(c_acctbal * 100) AS BIGINT) AS c, c_nationkey AS nation FROM customer)"
LI = "(SELECT CAST(l_quantity AS BIGINT) AS q, CAST(round(l_extendedprice * 100) AS BIGINT) AS p, CAST(round(l_discount * 100) AS BIGINT) AS disc FROM lineitem)"
TE = f"(SELECT *, idx % 10 AS d1, (idx // 10) % 10 AS d2, idx // 100 AS d3 FROM {EV})"
CO = "(SELECT vec_id AS i, CAST(k - 1 AS INTEGER) AS j, CAST(floor(CAST(embedding[k] AS DOUBLE) * 1048576) AS BIGINT) AS v FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS k))"
X0 = f"(SELECT j, v AS x FROM {CO} WHERE i = 0)"

# --- copy, fill, index, views
_add("copy_all", lambda s, d: events(s, d).select("idx", "v"), f"SELECT idx, v FROM {EV}")
_add("fill_const", lambda s, d: t.fill(events(s, d).select("idx", "v"), 7.5, "double"), f"SELECT idx, CAST(7.5 AS DOUBLE) AS v FROM {EV}")
_add("iota", lambda s, d: t.iota(s, events(s, d).count()), f"SELECT idx, idx + 1 AS v FROM {EV}")
_add("view_slice", lambda s, d: t.view(events(s, d).select("idx", "c"), 100, 899), f"SELECT idx - 100 AS idx, c FROM {EV} WHERE idx BETWEEN 100 AND 899")
_add("view_strided", lambda s, d: t.view(events(s, d).select("idx", "c"), 3, 903, 3), f"SELECT (idx - 3) // 3 AS idx, c FROM {EV} WHERE idx BETWEEN 3 AND 903 AND (idx - 3) % 3 = 0")
_add("view_reversed", lambda s, d: t.reversed_view(e := events(s, d).select("idx", "c"), e.count()), f"SELECT (SELECT count(*) FROM events) - 1 - idx AS idx, c FROM {EV}")
_add("view_write_through", lambda s, d: t.write_into(events(s, d).select("idx", c.alias("v")), t.view(events(s, d), 10, 29).select("idx", (c * 2).alias("v")), 10), f"SELECT idx, CASE WHEN idx BETWEEN 10 AND 29 THEN c * 2 ELSE c END AS v FROM {EV}")

# --- reductions
for _name, _f, _op, _sql in (("sum", lambda: c, "+", "sum(c)"), ("sumsq", lambda: c * c, "+", "sum(c * c)"), ("max", lambda: c, "max", "max(c)"), ("min", lambda: c, "min", "min(c)"), ("count", lambda: F.when(c > 5000, 1), "count", "count(CASE WHEN c > 5000 THEN 1 END)")):
    _add(f"reduce_{_name}", lambda s, d, f=_f, op=_op: reduce.mapreduce(events(s, d), f(), op), f"SELECT CAST({_sql} AS BIGINT) AS value FROM {EV}")
_add("reduce_mean_g", lambda s, d: reduce.mapreduce(events(s, d), F.struct(c).c, "+", lambda x: F.round(x / F.count(F.lit(1)), 6)), f"SELECT round(sum(c) / count(*), 6) AS value FROM {EV}")
_add("reduce_sqrt_g", lambda s, d: reduce.mapreduce(orders(s, d), (c * c).cast("decimal(20,0)"), "+", lambda x: F.round(F.sqrt(x.cast("double")), 3)), f"SELECT round(sqrt(CAST(sum(CAST(c AS HUGEINT) * c) AS DOUBLE)), 3) AS value FROM {OR}")
_add("reduce_product_mod", lambda s, d: reduce.mapreduce(events(s, d), F.pmod(c, F.lit(1009)) + 1, lambda a, b: F.pmod(a * b, F.lit(1000003))), f"SELECT list_reduce(list(c % 1009 + 1 ORDER BY idx), lambda a, b: (a * b) % 1000003) AS value FROM {EV}")
_add("reduce_wrap_u8", lambda s, d: reduce.mapreduce(events(s, d), c, "+", lambda x: reduce.wrap(x, 8)), f"SELECT CAST(sum(c) % 256 AS BIGINT) AS value FROM {EV}")
_add("reduce_wrap_i16", lambda s, d: reduce.mapreduce(events(s, d), c, "+", lambda x: reduce.wrap(x, 16, True)), f"SELECT CAST((sum(c) + 32768) % 65536 - 32768 AS BIGINT) AS value FROM {EV}")
_add("reduce_bits", lambda s, d: reduce.mapreduce_struct(events(s, d), {"all_and": reduce.NAMED["and"](c), "all_or": reduce.NAMED["or"](c), "all_xor": reduce.NAMED["xor"](c)}), f"SELECT bit_and(c) AS all_and, bit_or(c) AS all_or, bit_xor(c) AS all_xor FROM {EV}")
_add("dot", lambda s, d: reduce.mapreduce(lines(s, d), F.col("q") * p, "+"), f"SELECT CAST(sum(q * p) AS BIGINT) AS value FROM {LI}")
_add("euclid_dist", lambda s, d: reduce.mapreduce_arrays(lines(s, d), lambda q, x: _wide(q * 100 - x) * _wide(q * 100 - x), "+", "q", "p", g=lambda x: F.round(F.sqrt(x.cast("double")), 2)), f"SELECT round(sqrt(CAST(sum((q * 100 - p) * (q * 100 - p)) AS DOUBLE)), 2) AS value FROM {LI}")
_add("weighted_sum", lambda s, d: reduce.mapreduce(lines(s, d), p * (100 - F.col("disc")), "+"), f"SELECT CAST(sum(p * (100 - disc)) AS BIGINT) AS value FROM {LI}")
_add("triple_product", lambda s, d: reduce.mapreduce(lines(s, d), F.col("q") * p * F.col("disc"), "+"), f"SELECT CAST(sum(q * p * disc) AS BIGINT) AS value FROM {LI}")
_add("struct_stats", lambda s, d: reduce.mapreduce_struct(orders(s, d), {"n": F.count(c), "total": F.sum(c), "low": F.min(c), "high": F.max(c)}), f"SELECT count(c) AS n, CAST(sum(c) AS BIGINT) AS total, min(c) AS low, max(c) AS high FROM {OR}")
_add("struct_vec3", lambda s, d: reduce.mapreduce_struct(lines(s, d), {"x": F.sum(F.col("q") * p), "y": F.sum(F.col("q") + p), "z": F.sum(F.col("q") - p)}), f"SELECT CAST(sum(q * p) AS BIGINT) AS x, CAST(sum(q + p) AS BIGINT) AS y, CAST(sum(q - p) AS BIGINT) AS z FROM {LI}")
_add("welford", lambda s, d: reduce.mapreduce_struct(orders(s, d), {"n": F.count(v), "mean": F.round(F.avg(v), 4), "var": F.round(F.var_pop(v) / 1e6, 3)}), f"SELECT count(v) AS n, round(avg(v), 4) AS mean, round(var_pop(v) / 1e6, 3) AS var FROM {OR}")
_add("maximum_rel", lambda s, d: reduce.extremum(orders(s, d), c), f"SELECT max(c) AS value FROM {OR}")
_add("minimum", lambda s, d: reduce.extremum(orders(s, d), c, False), f"SELECT min(c) AS value FROM {OR}")
for _name, _dims, _keep in (("lead", 1, (2, 3)), ("lead2", (1, 2), (3,)), ("trail", 3, (1, 2)), ("two_block", (1, 3), (2,)), ("middle", 2, (1, 3)), ("all", (1, 2, 3), ()), ("neg", -1, (1, 2))):
    _cols = ", ".join(f"d{k}" if k in _keep else f"CAST(0 AS BIGINT) AS d{k}" for k in (1, 2, 3))
    _by = " GROUP BY " + ", ".join(f"d{k}" for k in _keep) if _keep else ""
    _add(f"dims_{_name}", lambda s, d, dims=_dims: reduce.mapreduce_dims(cells(s, d), c, "+", dims, 3), f"SELECT {_cols}, CAST(sum(c) AS BIGINT) AS value FROM {TE}{_by}")
_add("dims_grouping_sets", lambda s, d: reduce.multi_reduce(cells(s, d), F.sum("c"), [["d1"], ["d2"], ["d1", "d2"], []], ["d1", "d2"]), f"SELECT d1, d2, CAST(sum(c) AS BIGINT) AS value FROM {TE} GROUP BY GROUPING SETS ((d1), (d2), (d1, d2), ())")
_add("rowreduce_max", lambda s, d: product.matvec_rows(rows(s, d), F.col("row"), None, lambda a: a, "max"), f"SELECT i, max(v) AS value FROM {CO} GROUP BY i")
_add("colreduce_sum", lambda s, d: product.vecmat(None, coo(s, d), lambda a: a, "+"), f"SELECT j, CAST(sum(v) AS BIGINT) AS value FROM {CO} GROUP BY j")
_add("reduce2d_g", lambda s, d: reduce.mapreduce(coo(s, d), F.abs("v"), "+", lambda x: F.round(x / 64, 4), ["i"]), f"SELECT i, round(sum(abs(v)) / 64, 4) AS value FROM {CO} GROUP BY i")
_add("maximum_by_relation", lambda s, d: reduce.maximum(orders(s, d), F.struct(F.pmod(c, F.lit(1009)).alias("k"), c.alias("c")), lambda x, y: x["k"] < y["k"]).select("value.k", "value.c"), f"SELECT c % 1009 AS k, c FROM {OR} ORDER BY c % 1009 DESC, idx LIMIT 1")
_add("mapreduce2d_first", lambda s, d: reduce.mapreduce2d(coo(s, d), F.abs("v"), "max", 1), f"SELECT j, max(abs(v)) AS value FROM {CO} GROUP BY j")
_add("mapreduce2d_second", lambda s, d: reduce.mapreduce2d(coo(s, d), F.pmod("v", F.lit(1009)) + 1, lambda a, b: F.pmod(a * b, F.lit(1000003)), 2), f"SELECT i, list_reduce(list((v % 1009 + 1009) % 1009 + 1 ORDER BY j), lambda a, b: (a * b) % 1000003) AS value FROM {CO} GROUP BY i")
_add("mapreduce_into", lambda s, d: reduce.mapreduce_into(events(s, d).select("idx", c.alias("v")), events(s, d), c, "+", at=7), f"SELECT idx, CASE WHEN idx = 7 THEN (SELECT CAST(sum(c) AS BIGINT) FROM {EV}) ELSE c END AS v FROM {EV}")
_P = 1000003


def compose(f, g):
    """First f, then g, of maps x -> a x + b modulo a prime: not commutative."""
    return F.struct(F.pmod(f["a"] * g["a"], F.lit(_P)).alias("a"), F.pmod(g["a"] * f["b"] + g["b"], F.lit(_P)).alias("b"))


_add("ordered_fold_noncommutative", lambda s, d: reduce.mapreduce(events(s, d), _affine, compose).select("value.a", "value.b"),
     f"SELECT r.a AS a, r.b AS b FROM (SELECT list_reduce(list({{'a': c % 97 + 1, 'b': c % 89}} ORDER BY idx), lambda f, g: {{'a': (f.a * g.a) % {_P}, 'b': (g.a * f.b + g.b) % {_P}}}) AS r FROM {EV})")

_add("dims_fold_noncommutative", lambda s, d: reduce.mapreduce_dims(cells(s, d), _affine, compose, (1, 2), 3).select("d3", "value.a", "value.b"),
     f"SELECT d3, r.a AS a, r.b AS b FROM (SELECT d3, list_reduce(list({{'a': (c % 97 + 97) % 97 + 1, 'b': (c % 89 + 89) % 89}} ORDER BY idx), lambda f, g: {{'a': (f.a * g.a) % {_P}, 'b': (g.a * f.b + g.b) % {_P}}}) AS r FROM {TE} GROUP BY d3)")

# --- products
_add("matvec", lambda s, d: product.matvec_rows(rows(s, d), F.col("row"), first_row(s, d)), f"SELECT i, CAST(sum(v * x) AS BIGINT) AS value FROM {CO} JOIN {X0} USING (j) GROUP BY i")
_add("matvec_coo", lambda s, d: product.matvec(coo(s, d), coo(s, d).filter("i = 0").select("j", F.col("v").alias("x")), lambda a, b: a * b, "+"), ORACLE_SQL["matvec"])
_add("matvec_max", lambda s, d: product.matvec_rows(rows(s, d), F.col("row"), first_row(s, d), lambda a, b: a + b, "max"), f"SELECT i, max(v + x) AS value FROM {CO} JOIN {X0} USING (j) GROUP BY i")
_add("matvec_minplus", lambda s, d: product.matvec_rows(rows(s, d), F.col("row"), first_row(s, d), lambda a, b: F.abs(a - b), "min"), f"SELECT i, min(abs(v - x)) AS value FROM {CO} JOIN {X0} USING (j) GROUP BY i")
_add("matvec_softmax_num", lambda s, d: product.matvec_rows(rows(s, d), F.col("row"), first_row(s, d), lambda a, b: F.exp((a - b) / 1048576.0), "+", lambda x: F.round(x, 5)), f"SELECT i, round(sum(exp((v - x) / 1048576.0)), 5) AS value FROM {CO} JOIN {X0} USING (j) GROUP BY i")
_add("matvec_norm_g", lambda s, d: product.matvec_rows(rows(s, d), F.col("row"), first_row(s, d), lambda a, b: (a - b) * (a - b), "+", lambda x: F.round(F.sqrt(x.cast("double")), 3)), f"SELECT i, round(sqrt(CAST(sum((v - x) * (v - x)) AS DOUBLE)), 3) AS value FROM {CO} JOIN {X0} USING (j) GROUP BY i")
_add("matvec_struct", lambda s, d: (lambda r, x: r.select("i", *[F.aggregate(F.zip_with("row", F.lit(x), f), F.lit(0).cast("long"), lambda a, b: a + b).alias(k) for k, f in (("x", lambda a, b: a * b), ("y", lambda a, b: a + b), ("z", lambda a, b: a - b))]))(rows(s, d), first_row(s, d)),
     f"SELECT i, CAST(sum(v * x) AS BIGINT) AS x, CAST(sum(v + x) AS BIGINT) AS y, CAST(sum(v - x) AS BIGINT) AS z FROM {CO} c JOIN {X0.replace('AS x', 'AS x')} USING (j) GROUP BY i")
_add("matvec_view", lambda s, d: product.matvec_rows(rows(s, d).filter("i BETWEEN 10 AND 59"), F.slice("row", 9, 32), first_row(s, d)[8:40]), f"SELECT i, CAST(sum(v * x) AS BIGINT) AS value FROM {CO} JOIN {X0} USING (j) WHERE i BETWEEN 10 AND 59 AND j BETWEEN 8 AND 39 GROUP BY i")
_XI = "(SELECT vec_id AS i, CAST(label AS BIGINT) AS x FROM embeddings)"
_labels = lambda s, d: t.read(s, d, "embeddings").select(F.col("vec_id").alias("i"), F.col("label").cast("long").alias("x"))
_add("vecmat", lambda s, d: product.vecmat(_labels(s, d), coo(s, d), lambda a, b: a * b, "+"), f"SELECT j, CAST(sum(x * v) AS BIGINT) AS value FROM {CO} JOIN {_XI} USING (i) GROUP BY j")
_add("vecmat_g", lambda s, d: product.vecmat(_labels(s, d), coo(s, d), lambda a, b: a + b, "max", lambda x: x * 2), f"SELECT j, max(x + v) * 2 AS value FROM {CO} JOIN {_XI} USING (i) GROUP BY j")
_add("matvec_into", lambda s, d: product.matvec_into(_labels(s, d).select(F.col("i").alias("idx"), F.col("x").alias("v")), coo(s, d).filter("i < 50"), coo(s, d).filter("i = 0").select("j", F.col("v").alias("x")), lambda a, b: a * b, "+", first=20), f"SELECT i AS idx, coalesce(value, x) AS v FROM {_XI} LEFT JOIN (SELECT i + 20 AS i, CAST(sum(v * x) AS BIGINT) AS value FROM {CO} JOIN {X0} USING (j) WHERE i < 50 GROUP BY i) USING (i)")
_add("vecmat_into", lambda s, d: product.vecmat_into(_labels(s, d).select(F.col("i").alias("idx"), F.col("x").alias("v")), _labels(s, d), coo(s, d), lambda a, b: a * b, "+", first=5), f"SELECT i AS idx, coalesce(value, x) AS v FROM {_XI} LEFT JOIN (SELECT j + 5 AS i, CAST(sum(x * v) AS BIGINT) AS value FROM {CO} JOIN {_XI} USING (i) GROUP BY j) USING (i)")

# --- scans
_W = "OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING)"
for _name, _f, _op, _sql in (("sum", lambda: c, "+", "sum(c)"), ("sumsq", lambda: c * c, "+", "sum(c * c)"), ("min", lambda: c, "min", "min(c)"), ("max", lambda: c, "max", "max(c)")):
    _add(f"scan_{_name}", lambda s, d, f=_f, op=_op: scan.scan(events(s, d), f(), op), f"SELECT idx, CAST({_sql} {_W} AS BIGINT) AS value FROM {EV}")
_add("scan_g_sqrt", lambda s, d: scan.scan(events(s, d), F.abs(c), "+", lambda x: F.round(F.sqrt(x.cast("double")), 5)), f"SELECT idx, round(sqrt(CAST(sum(abs(c)) {_W} AS DOUBLE)), 5) AS value FROM {EV}")
_add("scan_u8_wrap", lambda s, d: scan.scan(events(s, d), F.pmod(c, F.lit(256)), "+", lambda x: reduce.wrap(x, 8)), f"SELECT idx, CAST((sum((c % 256 + 256) % 256) {_W}) % 256 AS BIGINT) AS value FROM {EV}")
_add("scan_view", lambda s, d: scan.scan(t.view(events(s, d), 50, 549), c, "+"), f"SELECT idx - 50 AS idx, CAST(sum(c) {_W} AS BIGINT) AS value FROM {EV} WHERE idx BETWEEN 50 AND 549")
def merge(a, b):
    """Number, mean and sum of squared deviations of two parts together; nothing grows faster than the values' spread."""
    n, gap = a["n"] + b["n"], b["mean"] - a["mean"]
    return F.struct(n.alias("n"), (a["mean"] + gap * b["n"] / n).alias("mean"), (a["m2"] + b["m2"] + gap * gap * a["n"] * b["n"] / n).alias("m2"))


def merge_whole(a, b):
    """``merge`` of whole numbers, exact: the mean is a whole one, ``rest`` what the sum has over n times it, m2 is about it; ``some`` tells if there is a value."""
    n, gap = a["n"] + b["n"], b["mean"] - a["mean"]
    rest = a["rest"] + b["rest"] + b["n"] * gap
    step = F.floor(rest / n)
    about = lambda x, by: x["m2"] + _wide(by) * (x["n"] * by - 2 * x["rest"])
    return F.struct(n.alias("n"), (a["mean"] + step).alias("mean"), (rest - n * step).alias("rest"), (about(a, step) + about(b, step - gap)).alias("m2"), (a["some"] | b["some"]).alias("some"))


def multiply(a, b):
    """The product of two quaternions: associative, not commutative."""
    w, x, y, z = (a[k] for k in "wxyz")
    return F.struct(
        (w * b["w"] - x * b["x"] - y * b["y"] - z * b["z"]).alias("w"), (w * b["x"] + x * b["w"] + y * b["z"] - z * b["y"]).alias("x"),
        (w * b["y"] - x * b["z"] + y * b["w"] + z * b["x"]).alias("y"), (w * b["z"] + x * b["y"] - y * b["x"] + z * b["w"]).alias("z"),
    )


def _turn():
    """A unit quaternion for each element: a turn about the axis that its index names."""
    axis = F.pmod(F.col("idx"), F.lit(3))
    part = lambda k: F.when(axis == k, F.sin(c / 1000.0)).otherwise(0.0)
    return F.struct(F.cos(c / 1000.0).alias("w"), part(0).alias("x"), part(1).alias("y"), part(2).alias("z"))


def _prefixes(first: str, step: str, source: str) -> str:
    """SQL for all prefixes of an ordered fold: a list that grows by its last element with the next one."""
    return f"(SELECT unnest(range(len(r))) AS idx, unnest(r) AS r FROM (SELECT list_reduce(list([{first}] ORDER BY idx), lambda f, g: list_append(f, {step})) AS r FROM {source}))"


def _mean_var(n, total, m2_n):
    """Mean and variance from whole numbers (the sum in cents, n times the squared deviations) by the SQL's own steps: a tie goes where the SQL takes it."""
    mean, var = total.cast("double") / n / 100, m2_n.cast("double") / (n.cast("double") * n) / 1e4
    return _rounded(mean, 4).alias("mean"), _rounded(var, 3).alias("var")


def _one():
    """An element for ``merge_whole``; one without a value counts and adds nothing, as in the SQL."""
    zero = F.lit(0)
    return F.struct(F.lit(1).cast("long").alias("n"), F.coalesce(c, zero.cast("long")).alias("mean"), zero.cast("long").alias("rest"), zero.cast("decimal(38,0)").alias("m2"), c.isNotNull().alias("some"))


def _merged(x):
    """Mean and variance of what ``merge_whole`` gives, null while there is no value."""
    total, m2_n = _wide(x["mean"]) * x["n"] + x["rest"], x["m2"] * x["n"] - _wide(x["rest"]) * x["rest"]
    return _mean_var(x["n"], *[F.when(x["some"], y) for y in (total, m2_n)])


_add("scan_welford", lambda s, d: scan.scan_many(events(s, d), {"n": (F.lit(1), "+"), "s": (_wide(c), "+"), "q": (_wide(c) * _wide(c), "+")}).select("idx", "n", *_mean_var(F.col("n"), F.col("s"), F.col("q") * F.col("n") - F.col("s") * F.col("s"))),
     f"SELECT idx, n, round(s / n / 100, 4) AS mean, round(CAST(q * n - s * s AS DOUBLE) / (CAST(n AS DOUBLE) * n) / 1e4, 3) AS var FROM (SELECT idx, count(*) {_W} AS n, CAST(sum(c) {_W} AS HUGEINT) AS s, CAST(sum(c * c) {_W} AS HUGEINT) AS q FROM {EV})")
_add("scan_welford_merge", lambda s, d: scan.scan(events(s, d), _one(), merge_whole).select("idx", "value.n", *_merged(F.col("value"))),
     ORACLE_SQL["scan_welford"])
_add("scan_affine", lambda s, d: scan.scan(events(s, d), _affine, compose).select("idx", "value.a", "value.b"),
     f"SELECT idx, r.a AS a, r.b AS b FROM {_prefixes("{'a': (c % 97 + 97) % 97 + 1, 'b': (c % 89 + 89) % 89}", f"{{'a': (f[-1].a * g[1].a) % {_P}, 'b': (g[1].a * f[-1].b + g[1].b) % {_P}}}", EV)}")
_add("scan_quaternion", lambda s, d: scan.scan(events(s, d), _turn(), multiply).select("idx", *[F.round(F.col(f"value.{k}"), 6).alias(k) for k in "wxyz"]),
     "SELECT idx, round(r.w, 6) AS w, round(r.x, 6) AS x, round(r.y, 6) AS y, round(r.z, 6) AS z FROM " + _prefixes(
         "{'w': cos(c / 1000.0), 'x': CASE WHEN idx % 3 = 0 THEN sin(c / 1000.0) ELSE 0.0 END, 'y': CASE WHEN idx % 3 = 1 THEN sin(c / 1000.0) ELSE 0.0 END, 'z': CASE WHEN idx % 3 = 2 THEN sin(c / 1000.0) ELSE 0.0 END}",
         "{'w': f[-1].w * g[1].w - f[-1].x * g[1].x - f[-1].y * g[1].y - f[-1].z * g[1].z, 'x': f[-1].w * g[1].x + f[-1].x * g[1].w + f[-1].y * g[1].z - f[-1].z * g[1].y, 'y': f[-1].w * g[1].y - f[-1].x * g[1].z + f[-1].y * g[1].w + f[-1].z * g[1].x, 'z': f[-1].w * g[1].z + f[-1].x * g[1].y - f[-1].y * g[1].x + f[-1].z * g[1].w}", EV))
_add("scan_product", lambda s, d: scan.scan(events(s, d), 1 + (F.pmod(c, F.lit(7)) - 3) / 1e6, "*", lambda x: F.round(x, 7)), f"SELECT idx, round(product(1 + ((c % 7 + 7) % 7 - 3) / 1e6) {_W}, 7) AS value FROM {EV}")
_add("scan_into", lambda s, d: scan.scan_into(events(s, d).select("idx", c.alias("v")), t.view(events(s, d), 100, 399), c, "+", first=40), f"SELECT idx, CASE WHEN idx BETWEEN 40 AND 339 THEN s ELSE c END AS v FROM {EV} LEFT JOIN (SELECT idx - 60 AS idx, CAST(sum(c) {_W} AS BIGINT) AS s FROM {EV} WHERE idx BETWEEN 100 AND 399) USING (idx)")

# --- search
_add("findfirst", lambda s, d: search.find(events(s, d), c > 20000), f"SELECT min(idx) AS idx FROM {EV} WHERE c > 20000")
_add("findlast", lambda s, d: search.find(events(s, d), c > 20000, last=True), f"SELECT max(idx) AS idx FROM {EV} WHERE c > 20000")
_add("findfirst_none", lambda s, d: search.find(events(s, d), c < -10**12), f"SELECT min(idx) AS idx FROM {EV} WHERE c < -1000000000000")
_add("findfirst_2d", lambda s, d: search.coordinates(search.find(events(s, d), c > 20000), "idx", 10, 10), f"SELECT idx % 10 AS d1, (idx // 10) % 10 AS d2, idx // 100 AS d3 FROM (SELECT min(idx) AS idx FROM {EV} WHERE c > 20000)")
_add("argmax", lambda s, d: search.argmax(orders(s, d), c), f"SELECT idx FROM {OR} ORDER BY c DESC, idx LIMIT 1")
_add("argmin", lambda s, d: search.argmin(orders(s, d), c), f"SELECT idx FROM {OR} ORDER BY c, idx LIMIT 1")
_add("argmax_ties", lambda s, d: search.argmax(customer(s, d), F.col("nation")), f"SELECT idx FROM {CU} ORDER BY nation DESC, idx LIMIT 1")
_add("argmax_f_abs", lambda s, d: search.argmax(customer(s, d), F.abs("c")), f"SELECT idx FROM {CU} ORDER BY abs(c) DESC, idx LIMIT 1")
_add("argmax_struct", lambda s, d: search.argbest(orders(s, d), [F.desc("pr"), F.asc("c")]), f"SELECT idx FROM {OR} ORDER BY pr DESC, c, idx LIMIT 1")
_add("argmax_multi", lambda s, d: search.argmax(orders(s, d), c - F.col("cust") * 100), f"SELECT idx FROM {OR} ORDER BY c - cust * 100 DESC, idx LIMIT 1")

# --- sorts
for _name, _frame, _keys, _from, _by in (
    ("num", events, lambda: [F.asc("c")], EV, "c"), ("desc", events, lambda: [F.desc("c")], EV, "c DESC"), ("abs", customer, lambda: [F.abs("c").asc()], CU, "abs(c)"),
    ("modlt", orders, lambda: [F.pmod(c, F.lit(97)).asc()], OR, "c % 97"), ("bool", events, lambda: [(c > 5000).asc()], EV, "c > 5000"), ("by_field", orders, lambda: [F.asc("pr")], OR, "pr"), ("multi_lt", orders, lambda: [F.desc("pr"), F.asc("cust"), F.desc("c")], OR, "pr DESC, cust, c DESC"),
):
    _add(f"sort_{_name}", lambda s, d, f=_frame, k=_keys: order.sort(f(s, d), k()).select("pos", "idx", "c"), f"SELECT row_number() OVER (ORDER BY {_by}, idx) AS pos, idx, c FROM {_from}")
_add("sort_by_kind", lambda s, d: order.sort(x := events(s, d), order.keys_of(x, "v")).select("pos", "idx", "v"), f"SELECT row_number() OVER (ORDER BY v, idx) AS pos, idx, v FROM {EV}")
_add("sort_float", lambda s, d: order.sort(events(s, d), order.order_key(v)).select("pos", "v"), f"SELECT row_number() OVER (ORDER BY v, idx) AS pos, v FROM {EV}")
_add("sort_keyval", lambda s, d: order.sort(orders(s, d), [F.asc("cust")], separate=True).select("pos", "cust", "c"), f"SELECT row_number() OVER (ORDER BY cust, idx) AS pos, cust, c FROM {OR}")
_add("sort_keyval_two_arrays", lambda s, d: order.sort_keyval(orders(s, d).select("idx", "c"), orders(s, d).select("idx", "cust"), value="c", key="cust"), f"SELECT row_number() OVER (ORDER BY cust, idx) AS pos, cust, c FROM {OR}")
_add("sort_lt_greater", lambda s, d: order.sort_lt(events(s, d).select("idx", "c"), lambda a, b: a > b, "c", bucket=2048), f"SELECT row_number() OVER (ORDER BY c DESC, idx) AS pos, idx, c FROM {EV}")
_add("sort_lt_modulo", lambda s, d: order.sort_lt(orders(s, d).select("idx", "c"), lambda a, b: F.pmod(a, F.lit(97)) < F.pmod(b, F.lit(97)), "c", bucket=2048), f"SELECT row_number() OVER (ORDER BY c % 97, idx) AS pos, idx, c FROM {OR}")
_add("sort_lt_struct", lambda s, d: order.sort_lt(orders(s, d).select("idx", F.struct("pr", "c").alias("v")), lambda a, b: (a["pr"] > b["pr"]) | ((a["pr"] == b["pr"]) & (a["c"] < b["c"])), "v", bucket=2048).select("pos", "idx", "v.pr", "v.c"), f"SELECT row_number() OVER (ORDER BY pr DESC, c, idx) AS pos, idx, pr, c FROM {OR}")
_add("sort_mirrored", lambda s, d: order.mirrored(order.sort(orders(s, d), [F.asc("cust")]), orders(s, d).count()).select("pos", "idx", "cust"), f"SELECT row_number() OVER (ORDER BY cust DESC, idx DESC) AS pos, idx, cust FROM {OR}")
_add("sort_columns_key", lambda s, d: order.sort_columns(coo(s, d), key=lambda x: F.abs(x)).select("pos", "j", "v"), f"SELECT row_number() OVER (PARTITION BY j ORDER BY abs(v), i) AS pos, j, v FROM {CO}")
_add("sort_arrays_lt", lambda s, d: order.sort_arrays(rows(s, d), "row", lt=lambda a, b: a > b).select("i", F.posexplode("row").alias("pos", "v")), f"SELECT i, CAST(row_number() OVER (PARTITION BY i ORDER BY v DESC) - 1 AS INTEGER) AS pos, v FROM {CO}")
_add("sortperm", lambda s, d: order.sortperm(events(s, d), [F.asc("c")]), f"SELECT row_number() OVER (ORDER BY c, idx) AS pos, idx + 1 AS perm FROM {EV}")
_add("sortperm_by", lambda s, d: order.sortperm(orders(s, d), [F.asc("pr"), F.desc("c")]), f"SELECT row_number() OVER (ORDER BY pr, c DESC, idx) AS pos, idx + 1 AS perm FROM {OR}")
_add("sort_columns", lambda s, d: order.sort_columns(coo(s, d)).select("pos", "j", "v"), f"SELECT row_number() OVER (PARTITION BY j ORDER BY v, i) AS pos, j, v FROM {CO}")
_add("sort_columns_desc", lambda s, d: order.sort_columns(coo(s, d), True).select("pos", "j", "v"), f"SELECT row_number() OVER (PARTITION BY j ORDER BY v DESC, i) AS pos, j, v FROM {CO}")
_add("sort_arrays", lambda s, d: order.sort_arrays(rows(s, d), "row").select("i", F.posexplode("row").alias("pos", "v")), f"SELECT i, CAST(row_number() OVER (PARTITION BY i ORDER BY v) - 1 AS INTEGER) AS pos, v FROM {CO}")

# --- random numbers
_idx = lambda s, d: orders(s, d).select("idx")
_R4, _R2 = (f"(SELECT idx, {{}} FROM {ph.philox_sql(f'(SELECT o_orderkey AS idx FROM orders)', 'idx', SEED, n)})" for n in (4, 2))
_U32 = _R4.format("CASE idx % 4 WHEN 0 THEN r0 WHEN 1 THEN r1 WHEN 2 THEN r2 ELSE r3 END AS u")
_F32 = f"(SELECT idx, CAST(u >> 9 AS DOUBLE) / 8388608.0 AS u FROM {_U32})"
_add("philox_block", lambda s, d: ph.with_philox(_idx(s, d), SEED, F.col("idx")), f"SELECT idx, CAST(r0 AS BIGINT) AS r0, CAST(r1 AS BIGINT) AS r1, CAST(r2 AS BIGINT) AS r2, CAST(r3 AS BIGINT) AS r3 FROM {ph.philox_sql('(SELECT o_orderkey AS idx FROM orders)', 'idx', SEED, 1)}")
_add("philox_u32", lambda s, d: ph.uniform_u32(_idx(s, d), SEED), f"SELECT idx, CAST(u AS BIGINT) AS u FROM {_U32}")
_add("uniform_f32", lambda s, d: ph.uniform_f32(_idx(s, d), SEED), f"SELECT idx, u FROM {_F32}")
_add("uniform_f64", lambda s, d: ph.uniform_f64(_idx(s, d), SEED), f"SELECT idx, (CAST(hi AS DOUBLE) * 1048576.0 + CAST(lo >> 12 AS DOUBLE)) / 4503599627370496.0 AS u FROM {_R2.format('CASE idx % 2 WHEN 0 THEN r1 ELSE r3 END AS hi, CASE idx % 2 WHEN 0 THEN r0 ELSE r2 END AS lo')}")
_add("uniform_u64", lambda s, d: ph.uniform_u64(_idx(s, d), SEED).select("idx", F.hex("u").alias("u")), f"SELECT idx, CASE WHEN hi = 0 THEN printf('%X', lo) ELSE printf('%X%08X', hi, lo) END AS u FROM {_R2.format('CASE idx % 2 WHEN 0 THEN r1 ELSE r3 END AS hi, CASE idx % 2 WHEN 0 THEN r0 ELSE r2 END AS lo')}")
_add("rand_shortcut", lambda s, d: ph.rand(_idx(s, d), SEED), ORACLE_SQL["uniform_f64"].replace("AS u FROM", "AS v FROM", 1))
_add("rand_shortcut_f32", lambda s, d: ph.rand(_idx(s, d), SEED, kind="float"), f"SELECT idx, u AS v FROM {_F32}")


class Triangular(ph.Distribution):
    """A distribution of the user's own: the larger of two uniforms, by its inverse."""

    def of(self, u):
        return F.sqrt(u)


_add("custom_distribution", lambda s, d: Triangular().sample(_idx(s, d), SEED).withColumn("v", F.round("v", 6)), f"SELECT idx, round(sqrt(u), 6) AS v FROM {_F32}")
for _name, _dist, _sql in (("uniform_ab", ph.Uniform(2.0, 5.0), "round(u * 3.0 + 2.0, 5)"), ("bernoulli", ph.Bernoulli(0.3), "u < 0.3"), ("exponential", ph.Exponential(2.0), "round(-ln(1.0 - u) / 2.0, 5)"), ("categorical", ph.Categorical([0.2, 0.5, 0.9]), "1 + CAST(u >= 0.2 AS INTEGER) + CAST(u >= 0.5 AS INTEGER) + CAST(u >= 0.9 AS INTEGER)")):
    _round = _sql.startswith("round")
    _add(_name, lambda s, d, g=_dist, r=_round: (lambda x: x.withColumn("v", F.round("v", 5)) if r else x)(g.sample(_idx(s, d), SEED)), f"SELECT idx, {_sql} AS v FROM {_F32}")
_add("normal", lambda s, d: ph.Normal(10.0, 2.0).sample(_idx(s, d), SEED).withColumn("v", F.round("v", 5)),
     "SELECT idx, round(10.0 + 2.0 * sqrt(-2.0 * ln(greatest(a, 1e-38))) * CASE idx % 2 WHEN 0 THEN cos(6.283185307179586 * b) ELSE sin(6.283185307179586 * b) END, 5) AS v FROM "
     + _R4.format("CAST(CASE (idx // 2) % 2 WHEN 0 THEN r0 ELSE r2 END >> 9 AS DOUBLE) / 8388608.0 AS a, CAST(CASE (idx // 2) % 2 WHEN 0 THEN r1 ELSE r3 END >> 9 AS DOUBLE) / 8388608.0 AS b"))
_add("randn_shortcut", lambda s, d: ph.randn(_idx(s, d), SEED).withColumn("v", F.round("v", 5)), ORACLE_SQL["normal"].replace("10.0 + 2.0 * ", ""))
_add("randperm", lambda s, d: order.sortperm(ph.uniform_f32(_idx(s, d), SEED), [F.asc("u")]), f"SELECT row_number() OVER (ORDER BY u, idx) AS pos, idx + 1 AS perm FROM {_F32}")

# --- 8-bit fixed point
_raw = lambda s, d: customer(s, d).select("idx", u8.encode(v / 5000.0).alias("r"), (F.pmod(c, F.lit(255)) - 127).cast("int").alias("s"))
_RAW = f"(SELECT idx, CAST(greatest(-127, least(127, round_even(v / 5000.0 * 128.0, 0))) AS INTEGER) AS r, CAST((c % 255 + 255) % 255 - 127 AS INTEGER) AS s FROM {CU})"
_CL = "greatest(-127, least(127, {}))"
_add("uf8_roundtrip", lambda s, d: _raw(s, d).select("idx", "r", u8.decode(_r).alias("v")), f"SELECT idx, r, r / 128.0 AS v FROM {_RAW}")
_add("uf8_add", lambda s, d: _raw(s, d).select("idx", u8.add(_r, _s).alias("v")), f"SELECT idx, {_CL.format('r + s')} AS v FROM {_RAW}")
_add("uf8_sub", lambda s, d: _raw(s, d).select("idx", u8.subtract(_r, _s).alias("v")), f"SELECT idx, {_CL.format('r - s')} AS v FROM {_RAW}")
_add("uf8_mul", lambda s, d: _raw(s, d).select("idx", u8.multiply(_r, _s).alias("v")), f"SELECT idx, CAST({_CL.format('floor(r * s / 128.0)')} AS INTEGER) AS v FROM {_RAW}")
_add("uf8_div", lambda s, d: _raw(s, d).select("idx", u8.divide(_r, _s).alias("v")), f"SELECT idx, CASE WHEN s = 0 THEN CASE WHEN r < 0 THEN -127 ELSE 127 END ELSE CAST({_CL.format('trunc(r * 128.0 / nullif(s, 0))')} AS INTEGER) END AS v FROM {_RAW}")
_add("uf8_compare", lambda s, d: _raw(s, d).select("idx", u8.less(_r, _s).alias("lt"), u8.equal(_r, _s).alias("eq"), u8.is_nan(_r).alias("nan")), f"SELECT idx, r < s AS lt, r = s AS eq, r = -128 AS nan FROM {_RAW}")
_add("uf8_unary", lambda s, d: _raw(s, d).select("idx", u8.negate(_r).alias("neg"), u8.absolute(_r).alias("mag"), u8.sign(_r).alias("sgn"), u8.promote(_r, "float").cast("double").alias("f")), f"SELECT idx, CAST(-r AS INTEGER) AS neg, CAST(abs(r) AS INTEGER) AS mag, CAST(sign(r) * 127 AS INTEGER) AS sgn, r / 128.0 AS f FROM {_RAW}")
_add("uf8_rand", lambda s, d: ph.uniform_f32(_idx(s, d), SEED).select("idx", u8.random(F.col("u")).alias("r")), f"SELECT idx, CAST(floor(u * 255.0) - 127 AS INTEGER) AS r FROM {_F32}")
_add("uf8_constants", lambda s, d: customer(s, d).select("idx", *[F.lit(x).alias(k) for k, x in (("zero", u8.ZERO), ("one", u8.ONE), ("low", u8.TYPEMIN), ("high", u8.TYPEMAX), ("eps", u8.EPS))]), f"SELECT idx, 0 AS zero, 127 AS one, -127 AS low, 127 AS high, CAST(0.0078125 AS DOUBLE) AS eps FROM {CU}")
_add("uf8_sum", lambda s, d: reduce.mapreduce(_raw(s, d), _r, "+", lambda x: x / F.lit(128.0)), f"SELECT CAST(sum(r) AS BIGINT) / 128.0 AS value FROM {_RAW}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector with the largest product with vector 0, other than itself."""
    near = product.matvec_rows(rows(spark, sf_dir), F.col("row"), first_row(spark, sf_dir))
    return search.argmax(near.filter("i <> 0"), F.col("value"), idx="i", name="nearest")


_add("nearest_vector", flagship, f"SELECT i AS nearest FROM {CO} JOIN {X0} USING (j) WHERE i <> 0 GROUP BY i ORDER BY sum(v * x) DESC, i LIMIT 1")
