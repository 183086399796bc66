"""Closed float intervals as STRUCT<lo DOUBLE, hi DOUBLE>; the empty interval is null.

Arithmetic rounds outwards: a result always holds the true set. A bound that the double format holds exactly stays as it is;
another is the nearest double on its outer side. Whether a bound is exact is told by the error of the rounded operation.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F



def interval(lo: Column, hi: Column) -> Column:
    """[lo, hi]; empty if lo > hi or a bound is NaN or null."""
    lo, hi = lo.cast("double"), hi.cast("double")
    return F.when(~F.isnan(lo) & ~F.isnan(hi) & (lo <= hi), F.struct(lo.alias("lo"), hi.alias("hi")))


def lower(i: Column) -> Column:
    return i["lo"]


def upper(i: Column) -> Column:
    return i["hi"]


def is_empty(i: Column) -> Column:
    return i.isNull()


def equal(a: Column, b: Column) -> Column:
    """Both empty, or equal bounds."""
    return a.eqNullSafe(b)


#: Succ of 2^-53: a double of normal size plus that part of itself rounds to the next double (Rump, Zimmermann, Boldo, Melquiond 2009).
_NEXT = 2.0**-53 * (1 + 2.0**-51)
#: Sizes between which steps and the rests of products and quotients are plain arithmetic; outside, Java's own functions are called.
_SMALL, _LARGE = 1e-140, 1e140


def _step(x: Column, towards: str) -> Column:
    near = x + F.abs(x) * F.lit(_NEXT if towards == "nextUp" else -_NEXT)
    far = F.reflect(F.lit("java.lang.Math"), F.lit(towards), F.coalesce(x, F.lit(0.0))).cast("double")
    return F.when(F.abs(x).between(_SMALL, _LARGE), near).otherwise(far)


_INF = float("inf")


def _finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < _INF)


def _fma(x: Column, y: Column, z: Column) -> Column:
    zero = F.lit(0.0)
    return F.reflect(F.lit("java.lang.Math"), F.lit("fma"), F.coalesce(x, zero), F.coalesce(y, zero), F.coalesce(z, zero)).cast("double")


def _of_size(x: Column) -> Column:
    return F.abs(x).between(_SMALL, _LARGE)


def _high(x: Column) -> Column:
    """The upper 26 bits of a double's digits (Veltkamp)."""
    c = x * F.lit(134217729.0)
    return c - (c - x)


def _product_rest(x: Column, y: Column, p: Column) -> Column:
    """x * y - p, exactly, for p = x * y rounded (Dekker); by a fused operation for very large and very small factors."""
    xh, yh = _high(x), _high(y)
    rest = (((xh * yh - p) + xh * (y - yh)) + (x - xh) * yh) + (x - xh) * (y - yh)
    return F.when(_of_size(x) & _of_size(y), rest).otherwise(_fma(x, y, -p))


#: Products whose error may be below the least double are stepped outwards whatever it seems to be.
_TINY = 1e-290


def _down(x: Column, rest: Column, told: Column) -> Column:
    """The lower bound of a rounded x and the sign of what rounding left."""
    overflow = F.when(x == _INF, F.lit(1.7976931348623157e308)).otherwise(x)
    return F.when(F.isnan(x), F.lit(-_INF)).when(~_finite(x), overflow).when(~told | (rest < 0), _step(x, "nextDown")).otherwise(x)


def _up(x: Column, rest: Column, told: Column) -> Column:
    overflow = F.when(x == -_INF, F.lit(-1.7976931348623157e308)).otherwise(x)
    return F.when(F.isnan(x), F.lit(_INF)).when(~_finite(x), overflow).when(~told | (rest > 0), _step(x, "nextUp")).otherwise(x)


def _each(pairs: list[tuple[Column, Column]], *steps: Callable[[Column], Column]) -> Column:
    """An array with what the steps, one after another, make of each pair: each is computed once, whatever the next makes of it."""
    out = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in pairs])
    for step in steps:
        out = F.transform(out, step)
    return out


def _rounded(t: Column) -> Column:
    """lo and hi around a rounded value v, of what is known of its rest; a value made of infinite bounds stays (kept)."""
    lo = F.when(t["kept"], t["v"]).otherwise(_down(t["v"], t["rest"], t["told"]))
    hi = F.when(t["kept"], t["v"]).otherwise(_up(t["v"], t["rest"], t["told"]))
    return F.struct(lo.alias("lo"), hi.alias("hi"))


def _widest(a: Column, b: Column, each: Column) -> Column:
    """The interval from the least lo to the largest hi of an array; empty if a or b is."""
    none = F.struct(F.lit(_INF).alias("lo"), F.lit(-_INF).alias("hi"))
    merge = lambda s, t: F.struct(F.least(s["lo"], t["lo"]).alias("lo"), F.greatest(s["hi"], t["hi"]).alias("hi"))
    end = lambda s: F.struct((s["lo"] + 0.0).alias("lo"), (s["hi"] + 0.0).alias("hi"))
    return F.when(a.isNotNull() & b.isNotNull(), F.aggregate(each, none, merge, end))


def _infinite(x: Column) -> Column:
    return F.abs(x) == _INF


def _sums(pairs: list[tuple[Column, Column]]) -> Column:
    """x + y, and the rest that rounding left, exactly (Knuth's two-sum)."""
    first = lambda t: F.struct(t["x"].alias("x"), t["y"].alias("y"), (t["x"] + t["y"]).alias("v"), (t["x"] + t["y"] - t["x"]).alias("t"))
    rest = lambda t: (t["x"] - (t["v"] - t["t"])) + (t["y"] - t["t"])
    second = lambda t: F.struct(t["v"].alias("v"), rest(t).alias("rest"), F.lit(True).alias("told"), (_infinite(t["x"]) | _infinite(t["y"])).alias("kept"))
    return _each(pairs, first, second, _rounded)


def add(a: Column, b: Column) -> Column:
    return _widest(a, b, _sums([(a["lo"], b["lo"]), (a["hi"], b["hi"])]))


def subtract(a: Column, b: Column) -> Column:
    return _widest(a, b, _sums([(a["lo"], -b["hi"]), (a["hi"], -b["lo"])]))


def negate(a: Column) -> Column:
    """Exact."""
    return F.when(a.isNotNull(), F.struct((-a["hi"] + 0.0).alias("lo"), (-a["lo"] + 0.0).alias("hi")))


def _pairs(a: Column, b: Column) -> list[tuple[Column, Column]]:
    return [(a[x], b[y]) for x in ("lo", "hi") for y in ("lo", "hi")]


def multiply(a: Column, b: Column) -> Column:
    """0 times infinity is 0, as a bound at infinity is never reached."""

    def first(t: Column) -> Column:
        none = (t["x"] == 0) | (t["y"] == 0)
        return F.struct(t["x"].alias("x"), t["y"].alias("y"), none.alias("none"), F.when(none, F.lit(0.0)).otherwise(t["x"] * t["y"]).alias("v"))

    def second(t: Column) -> Column:
        rest = F.when(t["none"], F.lit(0.0)).otherwise(_product_rest(t["x"], t["y"], t["v"]))
        return F.struct(t["v"].alias("v"), rest.alias("rest"), (t["none"] | (F.abs(t["v"]) > _TINY)).alias("told"), (_infinite(t["x"]) | _infinite(t["y"])).alias("kept"))

    return _widest(a, b, _each(_pairs(a, b), first, second, _rounded))


def _quotients(a: Column, b: Column) -> Column:
    """Of the bounds, in the order of _pairs(); null where the divisor is 0. A quotient of two infinities adds nothing but 0."""

    def first(t: Column) -> Column:
        y = F.when(t["y"] == 0, F.lit(None).cast("double")).otherwise(t["y"])
        both = _infinite(t["x"]) & _infinite(t["y"])
        return F.struct(t["x"].alias("x"), y.alias("y"), F.when((t["x"] == 0) | both, F.lit(0.0)).otherwise(t["x"] / y).alias("v"))

    def second(t: Column) -> Column:
        return F.struct(t["x"].alias("x"), t["y"].alias("y"), t["v"].alias("v"), (t["v"] * t["y"]).alias("p"))

    def third(t: Column) -> Column:
        plain = (t["x"] - t["p"]) - _product_rest(t["v"], t["y"], t["p"])
        rest = F.when(t["x"] == 0, F.lit(0.0)).when(_of_size(t["v"]) & _of_size(t["y"]), plain).otherwise(-_fma(t["v"], t["y"], -t["x"]))
        told = (t["x"] == 0) | _infinite(t["y"]) | ((F.abs(t["v"]) > _TINY) & (F.abs(t["x"]) > _TINY))
        return F.struct(t["v"].alias("v"), (rest * F.signum(t["y"])).alias("rest"), told.alias("told"), _infinite(t["x"]).alias("kept"))

    return _each(_pairs(a, b), first, second, third, _rounded)


def divide(a: Column, b: Column) -> Column:
    """Quotients by the members of b other than 0: none if b is [0, 0]; a half-line if 0 is a bound of b and a is not negative, or all negative; all otherwise.

    Dividing [0, 0] gives [0, 0].
    """
    line = F.struct(F.lit(-_INF).alias("lo"), F.lit(_INF).alias("hi"))
    zero = F.struct(F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"))
    each = _quotients(a, b)
    upward = lambda i: F.struct((F.element_at(each, i)["lo"] + 0.0).alias("lo"), F.lit(_INF).alias("hi"))
    downward = lambda i: F.struct(F.lit(-_INF).alias("lo"), (F.element_at(each, i)["hi"] + 0.0).alias("hi"))
    # b touches 0 from above, or from below with both signs turned; an a below 0 that reaches it gives all, as interval libraries have it
    above = F.when(a["lo"] >= 0, upward(2)).when(a["hi"] < 0, downward(4)).otherwise(line)
    below = F.when(a["lo"] >= 0, downward(1)).when(a["hi"] < 0, upward(3)).otherwise(line)
    return (
        F.when(a.isNull() | b.isNull() | ((b["lo"] == 0) & (b["hi"] == 0)), F.lit(None))
        .when((a["lo"] == 0) & (a["hi"] == 0), zero)
        .when(b["lo"] == 0, above)
        .when(b["hi"] == 0, below)
        .when((b["lo"] < 0) & (b["hi"] > 0), line)
        .otherwise(_widest(a, b, each))
    )


def intersect(a: Column, b: Column) -> Column:
    """What both hold; empty if either is."""
    lo, hi = F.greatest(a["lo"], b["lo"]), F.least(a["hi"], b["hi"])
    return F.when(a.isNotNull() & b.isNotNull() & (lo <= hi), F.struct(lo.alias("lo"), hi.alias("hi")))


def hull(a: Column, b: Column) -> Column:
    """The smallest interval that holds both; an empty one adds nothing."""
    return F.when(a.isNotNull() | b.isNotNull(), F.struct(F.least(a["lo"], b["lo"]).alias("lo"), F.greatest(a["hi"], b["hi"]).alias("hi")))


def subset(a: Column, b: Column) -> Column:
    """Whether b holds all of a; nothing is held by everything."""
    return F.when(a.isNull(), True).when(b.isNull(), False).otherwise((b["lo"] <= a["lo"]) & (a["hi"] <= b["hi"]))


def contains(i: Column, x: Column) -> Column:
    return F.coalesce(i.isNotNull() & ~F.isnan(x) & x.between(i["lo"], i["hi"]), F.lit(False))


def normalized(i: Column) -> Column:
    """(is_empty, lo or 0, hi or 0): what identity and hashing use."""
    zero = F.lit(0.0)
    return F.struct(i.isNull().alias("is_empty"), F.coalesce(i["lo"], zero).alias("lo"), F.coalesce(i["hi"], zero).alias("hi"))


def interval_text(i: Column) -> Column:
    """`[lo,hi]` in the shortest digits, `[]` if empty."""
    short = lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")
    return F.when(i.isNull(), "[]").otherwise(F.concat(F.lit("["), short(i["lo"]), F.lit(","), short(i["hi"]), F.lit("]")))


def from_python(value: None | float | tuple[float, float]) -> tuple[float, float] | None:
    """None: empty; a number: that number alone; a pair: its bounds. Reversed or NaN bounds: empty."""
    if value is None:
        return None
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        value = (value, value)
    if not isinstance(value, tuple) or len(value) != 2:
        raise TypeError("an interval is None, a number or a pair of numbers")
    lo, hi = map(float, value)
    return (lo, hi) if not math.isnan(lo) and not math.isnan(hi) and lo <= hi else None


def to_python(value: tuple[float, float] | None) -> None | float | tuple[float, float]:
    """The reverse: equal bounds are a number."""
    return value if value is None or value[0] != value[1] else value[0]
