import io
import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from millrace.functions import intervals as I
from millrace.functions import text
from millrace.functions.lists import canonicalized, is_canonical
from millrace.functions.shuffle import portable_shuffle, uniform_index

BOUNDS = [(1.0, 3.0), (2.0, 4.0), (-1.5, 0.1), (0.0, 0.3), (-2.0, 0.0), (0.0, 0.0), (0.1, 0.7), (-0.3, -0.1), None]


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(i, j, *(a or (None, None)), *(b or (None, None))) for i, a in enumerate(BOUNDS) for j, b in enumerate(BOUNDS)]
    df = spark.createDataFrame(rows, "i int, j int, a0 double, a1 double, b0 double, b1 double")
    return df.select("i", "j", I.interval(F.col("a0"), F.col("a1")).alias("a"), I.interval(F.col("b0"), F.col("b1")).alias("b"))


def tight(bound, exact, side):
    """The bound is the nearest double to the exact value on its outer side."""
    return Fraction(bound) == exact or (Fraction(bound) - exact) * side > 0 and (Fraction(math.nextafter(bound, -side * math.inf)) - exact) * side < 0


def test_exact_bounds_stay(spark):
    cases = {("add", (1.0, 3.0), (2.0, 4.0)): (3.0, 7.0), ("multiply", (0.0, 0.0), (0.1, 0.3)): (0.0, 0.0), ("divide", (1.0, 3.0), (2.0, 4.0)): (0.25, 1.5), ("subtract", (0.5, 0.5), (0.25, 1.0)): (-0.5, 0.25)}
    cases |= {("divide", (-1.0, 0.0), (0.0, 2.0)): (-math.inf, math.inf), ("divide", (1.0, 2.0), (0.0, 2.0)): (0.5, math.inf), ("divide", (-2.0, -1.0), (0.0, 2.0)): (-math.inf, -0.5), ("divide", (-2.0, -1.0), (-4.0, 0.0)): (0.25, math.inf)}
    cases |= {("add", (1e308, 1e308), (1e308, math.inf)): (1.7976931348623157e308, math.inf), ("multiply", (0.0, 1.0), (1.0, math.inf)): (0.0, math.inf), ("divide", (1.0, 2.0), (1.0, math.inf)): (0.0, 2.0)}
    for (name, x, y), want in cases.items():
        i = [I.interval(F.lit(a), F.lit(b)) for a, b in (x, y)]
        got = tuple(spark.range(1).select(getattr(I, name)(*i).alias("r")).first()["r"])
        assert got == want, (name, x, y, got)


def test_quotients_are_tight(pairs):
    a, b = F.col("a"), F.col("b")
    for r in pairs.where("b.lo > 0 or b.hi < 0").select("i", "j", I.divide(a, b).alias("q")).collect():
        if r["q"] is not None:
            every = [Fraction(u) / Fraction(v) for u in BOUNDS[r["i"]] for v in BOUNDS[r["j"]]]
            assert tight(r["q"]["lo"], min(every), -1) and tight(r["q"]["hi"], max(every), 1)


def test_durations_are_whole(spark):
    from millrace.functions import values as V

    data = [(n,) for n in (1_700_000_000_123_456_789, -1_700_000_000_123_456_789, 2**62 + 1, 999, -999, 0, 1000, -1001)]
    trunc = lambda n, u: abs(n) // u * (1 if n >= 0 else -1)
    for r in spark.createDataFrame(data, "n long").select("n", V.microseconds(F.col("n")).alias("u"), V.milliseconds(F.col("n")).alias("m"), V.nanoseconds(F.lit(3), "ms").alias("k")).collect():
        assert (r["u"], r["m"], r["k"]) == (trunc(r["n"], 1000), trunc(r["n"], 10**6), 3_000_000)


def test_texts_of_alternatives(spark):
    df = spark.createDataFrame([("i", 5, None), ("s", None, "x"), ("s", None, None), ("?", 1, "x")], "kind string, i int, s string")
    assert [r[0] for r in df.select(text.variant_text({"i": F.col("i"), "s": F.col("s")}, F.col("kind"))).collect()] == ["5", "x", "monostate", "<invalid>"]
    assert [r[0] for r in df.select(text.pointer_text(F.col("i"))).collect()] == ["5", "<nullptr>", "<nullptr>", "1"]


def test_arithmetic_is_sound(pairs):
    a, b = F.col("a"), F.col("b")
    for r in pairs.select("i", "j", I.add(a, b).alias("add"), I.subtract(a, b).alias("sub"), I.multiply(a, b).alias("mul"), I.divide(a, b).alias("div"), I.negate(a).alias("neg")).collect():
        x, y = BOUNDS[r["i"]], BOUNDS[r["j"]]
        if x is None or y is None:
            assert r["add"] is r["sub"] is r["mul"] is r["div"] is None
            continue
        p, q = [Fraction(v) for v in x], [Fraction(v) for v in y]
        for name, values in (("add", [u + v for u in p for v in q]), ("sub", [u - v for u in p for v in q]), ("mul", [u * v for u in p for v in q])):
            lo, hi = r[name]
            assert Fraction(lo) <= min(values) and max(values) <= Fraction(hi), (name, x, y)
            assert tight(lo, min(values), -1) and tight(hi, max(values), 1), (name, x, y)
        inside = [v for v in (*q, (q[0] + q[1]) / 2) if v != 0]
        if not inside:
            assert r["div"] is None
        else:
            lo, hi = r["div"]
            assert all((lo == -math.inf or Fraction(lo) <= u / v) and (hi == math.inf or u / v <= Fraction(hi)) for u in p for v in inside), (x, y, r["div"])
        assert tuple(r["neg"]) == (-x[1], -x[0])


def test_sets(pairs):
    a, b = F.col("a"), F.col("b")
    for r in pairs.select("i", "j", I.intersect(a, b).alias("meet"), I.hull(a, b).alias("hull"), I.subset(a, b).alias("sub"), I.equal(a, b).alias("eq"), I.contains(a, F.lit(0.0)).alias("zero"), I.normalized(a).alias("norm"), I.interval_text(a).alias("text")).collect():
        x, y = BOUNDS[r["i"]], BOUNDS[r["j"]]
        both = None if x is None or y is None or max(x[0], y[0]) > min(x[1], y[1]) else (max(x[0], y[0]), min(x[1], y[1]))
        assert (r["meet"] and tuple(r["meet"])) == both
        assert (r["hull"] and tuple(r["hull"])) == (x if y is None else y if x is None else (min(x[0], y[0]), max(x[1], y[1])))
        assert r["sub"] == (x is None or y is not None and y[0] <= x[0] and x[1] <= y[1])
        assert r["eq"] == (x == y) and r["zero"] == (x is not None and x[0] <= 0 <= x[1])
        assert tuple(r["norm"]) == (x is None, *(x or (0.0, 0.0)))
    assert pairs.select(I.interval_text(a)).first()[0] == "[1,3]"


def test_bounds_and_python_values(spark):
    df = spark.createDataFrame([(3.5, 1.25), (float("nan"), 1.0), (1.0, float("nan")), (-math.inf, math.inf), (None, 1.0)], "a double, b double")
    assert [r[0] and tuple(r[0]) for r in df.select(I.interval(F.col("a"), F.col("b"))).collect()] == [None, None, None, (-math.inf, math.inf), None]
    assert [I.from_python(x) for x in (None, 2.5, (1.25, 3.5), (3.5, 1.25), (math.nan, 1.25))] == [None, (2.5, 2.5), (1.25, 3.5), None, None]
    assert [I.to_python(x) for x in (None, (2.5, 2.5), (1.0, 2.0))] == [None, 2.5, (1.0, 2.0)]
    with pytest.raises(TypeError):
        I.from_python((1.0, 2.0, 3.0))


def test_canonical_lists(spark):
    df = spark.createDataFrame([([2, 1, 2, 3],), ([1, 2, 2, 3],), ([1, 2, 3],), ([],), (None,)], "a array<int>")
    got = df.select(canonicalized(F.col("a")), canonicalized(F.col("a"), False), is_canonical(F.col("a")), is_canonical(F.col("a"), False)).collect()
    assert [tuple(r) for r in got] == [([1, 2, 3], [1, 2, 2, 3], False, False), ([1, 2, 3], [1, 2, 2, 3], False, True), ([1, 2, 3], [1, 2, 3], True, True), ([], [], True, True), (None, None, None, None)]


def test_portable_shuffle_is_the_same_everywhere():
    draws = iter([7, 1, 8, 4, 9])
    items = [0, 1, 2, 3, 4]
    portable_shuffle(items, lambda: next(draws), 0, 9)
    assert items == [3, 4, 1, 0, 2]
    with pytest.raises(ValueError):
        uniform_index(lambda: 0, 0)
    with pytest.raises(ValueError):
        uniform_index(lambda: 0, 11, 0, 9)
    items = [1]
    portable_shuffle(items, lambda: 1 / 0)
    assert items == [1]


def test_text(spark):
    out = io.StringIO()
    with text.indented(out):
        text.print_indent(out).write("x")
    text.indent_down(out)
    text.print_indent(out).write("y")
    assert out.getvalue() == "    xy"
    r = spark.createDataFrame([([1, 2], None)], "a array<int>, b int").select(text.to_strings(F.col("a")), text.optional_text(F.col("b")), text.to_string(F.col("b"))).first()
    assert tuple(r) == (["1", "2"], "<nullopt>", None)
