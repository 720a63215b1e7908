import random

import pytest
from pyspark.sql import functions as F

from sparkarray.functions import philox, unitfloat8
from sparkarray.operators import order, product, reduce, scan, search
from sparkarray.plans import catalogue
from sparkarray.sources import tables


def vec(spark, values):
    rows = list(enumerate(values))
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "idx long, v long")


def affine(c):
    return F.struct((F.pmod(c, F.lit(7)) + 1).alias("a"), F.pmod(c, F.lit(5)).alias("b"))


def compose(f, g):
    return F.struct(F.pmod(f["a"] * g["a"], F.lit(1009)).alias("a"), F.pmod(g["a"] * f["b"] + g["b"], F.lit(1009)).alias("b"))


def prefix_maps(values):
    a, b, out = None, None, []
    for c in values:
        x, y = c % 7 + 1, c % 5
        a, b = (x, y) if a is None else (a * x % 1009, (x * b + y) % 1009)
        out.append((a, b))
    return out


@pytest.mark.parametrize("n", [1, 2, 33, 300, 1000])
def test_scan_and_fold_keep_order(spark, n):
    values = [random.Random(n).randrange(1000) for _ in range(n)]
    df = vec(spark, values)
    got = [(r.value.a, r.value.b) for r in scan.scan(df, affine(F.col("v")), compose).orderBy("idx").collect()]
    assert got == prefix_maps(values)
    last = reduce.mapreduce(df, affine(F.col("v")), compose).first()["value"]
    assert (last.a, last.b) == prefix_maps(values)[-1]


def test_two_level_scan_crosses_blocks(spark):
    values = list(range(50))
    got = [r.s for r in scan.scan_many(vec(spark, values), {"s": (F.col("v"), "+")}, block=8).orderBy("idx").collect()]
    assert got == [sum(values[: k + 1]) for k in range(50)]


def test_scan_of_nothing(spark):
    assert scan.scan(vec(spark, [0]).limit(0), F.col("v"), "+").count() == 0


def test_stable_sort_and_permutation(spark):
    values = [random.Random(3).randrange(10) for _ in range(500)]
    df = vec(spark, values)
    perm = [r.perm - 1 for r in order.sortperm(df, [F.asc("v")]).orderBy("pos").collect()]
    assert perm == sorted(range(500), key=lambda k: (values[k], k))


def test_minus_zero_before_zero(spark):
    df = spark.createDataFrame([(0, 0.0), (1, -0.0), (2, -1.0), (3, float("inf"))], "idx long, v double")
    assert [str(r.v) for r in order.sort(df, order.order_key(F.col("v"))).orderBy("pos").collect()] == ["-1.0", "-0.0", "0.0", "inf"]


def test_ties_go_to_the_first(spark):
    df = vec(spark, [3, 9, 1, 9, 1])
    assert search.argmax(df, F.col("v")).first()[0] == 1
    assert search.argmin(df, F.col("v")).first()[0] == 2
    assert search.find(df, F.col("v") > 100).first()[0] is None


def test_dims_are_checked():
    assert reduce.dims_of(-1, 3) == [3]
    for bad in (4, (1, 1), 0):
        with pytest.raises(ValueError):
            reduce.dims_of(bad, 3)
    with pytest.raises(ValueError):
        order.check_options("bogus")


def test_philox_known_answer(spark):
    r = philox.with_philox(spark.range(1), 0, F.lit(0)).first()
    assert [hex(r[f"r{k}"]) for k in range(4)] == ["0x6627e8d5", "0xe169c58d", "0xbc57ac4c", "0x9b00dbd8"]


def test_randoms_depend_on_seed_and_index_only(spark):
    few = philox.uniform_f64(spark.range(100).withColumnRenamed("id", "idx"), 7).orderBy("idx").collect()
    many = philox.uniform_f64(spark.range(1000).withColumnRenamed("id", "idx").repartition(13), 7).orderBy("idx").limit(100).collect()
    assert few == many
    stats = philox.Normal(10, 2).sample(spark.range(40000).withColumnRenamed("id", "idx"), 5).agg(F.avg("v"), F.stddev("v")).first()
    assert abs(stats[0] - 10) < 0.1 and abs(stats[1] - 2) < 0.1


def test_fixed_point_saturates(spark):
    df = spark.createDataFrame([(100, 100), (-100, 3), (5, 0), (-5, 0), (-7, 2)], "a int, b int")
    got = df.select(unitfloat8.add(F.col("a"), F.col("b")), unitfloat8.multiply(F.col("a"), F.col("b")), unitfloat8.divide(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(127, 78, 127), (-97, -3, -127), (5, 0, 127), (-5, 0, -127), (-5, -1, -127)]


def test_views(spark):
    df = vec(spark, list(range(20)))
    assert sorted(map(tuple, tables.view(df, 2, 17, 5).collect())) == [(0, 2), (1, 7), (2, 12), (3, 17)]
    new = tables.write_into(df, spark.createDataFrame([(0, 99)], "idx long, v long"), 4)
    assert new.filter("idx = 4").first()["v"] == 99 and new.filter("idx = 5").first()["v"] == 5


def test_u64_holds_two_lanes(spark):
    df = vec(spark, range(6))
    blocks = {r.idx: r for r in philox.with_philox(df, 7, F.col("idx")).collect()}
    got = [r.u % (1 << 64) for r in philox.uniform_u64(df, 7).orderBy("idx").collect()]
    assert got == [(blocks[k // 2][f"r{2 * (k % 2) + 1}"] << 32) | blocks[k // 2][f"r{2 * (k % 2)}"] for k in range(6)]


def test_unitfloat8_signs(spark):
    a = F.col("v").cast("byte")
    got = vec(spark, [-128, -127, -1, 0, 5, 127]).orderBy("idx").select(unitfloat8.negate(a), unitfloat8.absolute(a), unitfloat8.sign(a)).collect()
    assert [tuple(r) for r in got] == [(127, 127, -127), (127, 127, -127), (1, 1, -127), (0, 0, 0), (-5, 5, 127), (-127, 127, 127)]
    assert unitfloat8.NAN == -128


def test_matvec_checks_the_length(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, None)], "i long, row array<double>")
    assert {r.i: r.value for r in product.matvec_rows(rows, F.col("row"), [3.0, 4.0]).collect()} == {0: 11.0, 1: None}
    for x in ([1.0], [1.0, 2.0, 3.0]):
        with pytest.raises(Exception, match="against a row of"):
            product.matvec_rows(rows, F.col("row"), x).collect()


def test_vectors_longer_than_a_literal_are_joined(spark, monkeypatch):
    monkeypatch.setattr(product, "MOST", 3)
    rows = spark.createDataFrame([(0, [1, 2, 3, 4]), (1, [5, 6, 7, 8])], "i long, row array<long>")
    for op, want in (("+", {0: 30, 1: 70}), ("max", {0: 16, 1: 32}), (lambda a, b: a * 10 + b, {0: 1 * 1000 + 4 * 100 + 9 * 10 + 16, 1: 5000 + 1200 + 210 + 32})):
        got = product.matvec_rows(rows, F.col("row"), [1, 2, 3, 4], op=op).collect()
        assert {r.i: r.value for r in got} == want


def test_coordinate_products_check_shapes(spark):
    coo = spark.createDataFrame([(i, j, i + j) for i in range(3) for j in range(4)], "i long, j long, v long")
    short, exact, long = (spark.createDataFrame([(j, 1) for j in range(n)], "j long, x long") for n in (3, 4, 5))
    assert {r.i: r.value for r in product.matvec(coo, exact, lambda a, b: a * b, "+").collect()} == {0: 6, 1: 10, 2: 14}
    with pytest.raises(Exception, match="the vector has no j = 3"):
        product.matvec(coo, short, lambda a, b: a * b, "+").collect()
    product.check_shapes(coo, exact, "j")
    with pytest.raises(ValueError, match="a vector up to j = 4 against a matrix up to j = 3"):
        product.check_shapes(coo, long, "j")
    with pytest.raises(Exception, match="the vector has no i = 2"):
        product.vecmat(spark.createDataFrame([(0, 1), (1, 1)], "i long, x long"), coo, lambda a, b: a * b, "+").collect()


def test_dim_and_array_errors(spark):
    coo = spark.createDataFrame([(0, 0, 1)], "i long, j long, v long")
    for dim in (0, 3):
        with pytest.raises(ValueError, match="dim must be 1 or 2"):
            reduce.mapreduce2d(coo, F.col("v"), "+", dim)
    with pytest.raises(ValueError, match="as a whole"):
        reduce.mapreduce_arrays(coo, lambda a, b: a * b, "+", "i", "v", dims=1)
    with pytest.raises(ValueError, match="takes no comparator"):
        order.sort_lt(vec(spark, [1]), lambda a, b: a < b, algorithm="radix")
    with pytest.raises(ValueError, match="takes no separate keys"):
        order.sort(vec(spark, [1]), [F.asc("v")], algorithm="sample", separate=True)
    with pytest.raises(ValueError, match="3 values against 2 keys"):
        order.sort_keyval(vec(spark, [1, 2, 3]), vec(spark, [1, 2]).withColumnRenamed("v", "k"))


@pytest.mark.parametrize("n", [0, 1, 2, 33, 1000])
def test_sort_by_any_order(spark, n):
    """A remainder order, with many ties; buckets small enough that there are several."""
    values = [random.Random(n).randrange(5000) for _ in range(n)]
    got = order.sort_lt(vec(spark, values), lambda a, b: F.pmod(a, F.lit(97)) < F.pmod(b, F.lit(97)), bucket=64).orderBy("pos").collect()
    assert [(r.pos, r.idx, r.v) for r in got] == [(p, k, values[k]) for p, k in enumerate(sorted(range(n), key=lambda k: (values[k] % 97, k)), 1)]


def test_equal_elements_do_not_share_a_bucket(spark):
    got = order.sort_lt(vec(spark, [7] * 600), lambda a, b: a < b, bucket=50).orderBy("pos").collect()
    assert [r.idx for r in got] == list(range(600))


def test_sort_leaves_nothing_cached(spark):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    values = [random.Random(4).randrange(1000) for _ in range(3000)]
    got = order.sort(vec(spark, values), [F.asc("v")]).orderBy("pos").collect()
    assert [r.idx for r in got] == sorted(range(3000), key=lambda k: (values[k], k))
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_mirrored_order_turns_ties_round(spark):
    values = [3, 1, 3, 2, 1]
    got = order.mirrored(order.sort(vec(spark, values), [F.asc("v")]), 5).orderBy("pos").collect()
    assert [r.idx for r in got] == [2, 0, 3, 4, 1]


@pytest.mark.parametrize("descending", [False, True])
def test_columns_sorted_on_their_own(spark, descending):
    rng = random.Random(2)
    cols = [[rng.randrange(9) for _ in range(n)] for n in (1, 40, 300)]
    coo = spark.createDataFrame([(i, j, v) for j, c in enumerate(cols) for i, v in enumerate(c)], "i long, j long, v long")
    got = order.sort_columns(coo, descending).collect()
    for j, c in enumerate(cols):
        assert [r.v for r in sorted((r for r in got if r.j == j), key=lambda r: r.pos)] == sorted(c, reverse=descending)
        assert sorted(r.pos for r in got if r.j == j) == list(range(1, len(c) + 1))


def test_nulls_change_nothing(spark):
    df = spark.createDataFrame([(0, None), (1, 3), (2, None), (3, 4), (4, None)], "idx long, v long")
    for op in ("+", lambda a, b: a + b):
        assert [r.value for r in scan.scan(df, F.col("v"), op).orderBy("idx").collect()] == [None, 3, 3, 7, 7]
        assert reduce.mapreduce(df, F.col("v"), op).first()["value"] == 7
    assert (search.argmin(df, F.col("v")).first()[0], search.argmax(df, F.col("v")).first()[0]) == (1, 3)


def test_scan_crosses_blocks_of_blocks(spark):
    values = [random.Random(5).randrange(100) for _ in range(700)]
    got = [r.s for r in scan.scan_many(vec(spark, values), {"s": (F.col("v"), "+")}, block=8).orderBy("idx").collect()]
    assert got == [sum(values[: k + 1]) for k in range(700)]


def test_sums_of_squares_beyond_64_bits(spark):
    big = 4_000_000_000
    df = spark.createDataFrame([(k, big, 0) for k in range(8)], "idx long, a long, b long")
    got = reduce.mapreduce_arrays(df, lambda a, b: catalogue._wide(a - b) * catalogue._wide(a - b), "+", "a", "b", g=lambda x: F.sqrt(x.cast("double"))).first()["value"]
    assert got == pytest.approx(big * 8**0.5)


def test_welford_by_merging_keeps_its_digits(spark):
    """A large mean and a small spread: sums of squares would lose all digits."""
    values = [1e9 + k % 5 for k in range(400)]
    df = spark.createDataFrame(list(enumerate(values)), "idx long, v double")
    last = scan.scan(df, F.struct(F.lit(1).cast("long").alias("n"), F.col("v").alias("mean"), F.lit(0.0).alias("m2")), catalogue.merge).orderBy(F.desc("idx")).first()["value"]
    assert last.n == 400 and last.m2 / last.n == pytest.approx(2.0, rel=1e-4)


def test_maximum_under_a_relation(spark):
    df = vec(spark, [5, 12, 22, 32, 7])
    assert reduce.maximum(df, F.col("v"), lambda x, y: x % 10 < y % 10).first()["value"] == 7
    assert reduce.maximum(df, F.col("v"), lambda x, y: x % 5 > y % 5).first()["value"] == 5  # of equal ones the first
    assert reduce.maximum(df.limit(0), F.col("v"), lambda x, y: x < y).count() == 0


def test_public_names(spark):
    import sparkarray as sa

    assert all(hasattr(sa, name) for name in sa.__all__)
    assert [r.value for r in sa.scan(vec(spark, [1, 2, 3]), F.col("v"), "+").orderBy("idx").collect()] == [1, 3, 6]
    sa.release(spark)


def test_users_own_order_keys(spark, monkeypatch):
    """A type of the user's own, ordered by a key of theirs; floats keep -0.0 before 0.0."""
    monkeypatch.setitem(order.ORDER_KEYS, "struct<priority:int,cost:float>", lambda v: [v["priority"].desc(), v["cost"].asc()])
    df = spark.createDataFrame([(0, (1, 2.0)), (1, (3, 5.0)), (2, (3, 1.0)), (3, (1, 2.0))], "idx long, v struct<priority:int,cost:float>")
    assert [r.idx for r in order.sort(df, order.keys_of(df)).orderBy("pos").collect()] == [2, 1, 0, 3]
    floats = spark.createDataFrame([(0, 0.0), (1, -0.0)], "idx long, v double")
    assert [r.idx for r in order.sort(floats, order.keys_of(floats)).orderBy("pos").collect()] == [1, 0]
