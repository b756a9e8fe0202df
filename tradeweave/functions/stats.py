"""Test statistics as columns, and the p-values Spark has no function for."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradeweave import labels as L
from tradeweave.functions.buckets import below

ALPHA = 0.05


def scatter(n: Column, sx: Column, sy: Column, sxy: Column) -> Column:
    """Sum of products of deviations from exact sums; of squares when x is y.

    sxy - sx * sy / n with the whole part of the mean of x taken off first, exactly: what is left
    to subtract as doubles is no larger than the result needs.
    """
    some = F.when(n > 0, n)
    mean = F.call_function("div", sx, some)
    rest = sx - mean * some
    return (sxy - mean * sy).cast("double") - (rest * sy).cast("double") / some.cast("double")


def correlation(vx: Column, vy: Column, cov: Column) -> Column:
    """Pearson correlation from ``scatter`` figures; null when a side is constant."""
    return F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy))


def correlation_t(r: Column, n: Column) -> Column:
    """t statistic with n - 2 degrees of freedom; unbounded for a perfect correlation."""
    rest = 1 - r * r
    finite = r * F.sqrt((n - 2) / F.when(rest > 0, rest))
    return F.coalesce(finite, F.when(rest <= 0, F.signum(r) * float("inf")))


SHIFT = 32  # steps by which the argument of a ratio of gammas is moved before its series
#: of sqrt(z) * sum(c / z**i), the ratio of the gammas of z + 1/2 and z: fixed values
SERIES = (1.0, -1 / 8, 1 / 128, 5 / 1024, -21 / 32768, -399 / 262144, 869 / 4194304)
CONVERGED = 1e-13


def _log_beta_half(a: Column) -> Column:
    """Logarithm of the beta function of ``a`` and 1/2: log gamma(1/2) less that of gamma(a + 1/2) / gamma(a),
    whose ratio falls off by a known factor for each step that ``a`` is moved up."""
    moved = a + SHIFT
    series = sum((F.lit(c) / F.pow(moved, F.lit(float(i))) for i, c in enumerate(SERIES)), F.lit(0.0))
    steps = F.sequence(F.lit(0), F.lit(SHIFT - 1))
    start = F.struct(a.alias("a"), F.lit(0.0).alias("sum"))
    fallen = F.aggregate(
        steps,
        start,
        lambda held, i: F.struct(
            held["a"].alias("a"), (held["sum"] + F.log1p(F.lit(-0.5) / (held["a"] + i + 0.5))).alias("sum")
        ),
        lambda held: held["sum"],
    )
    return F.lit(0.5 * math.log(math.pi)) - fallen - F.log(moved) / 2 - F.log(series)


def _fraction(a: Column, b: Column, x: Column, terms: Column) -> Column:
    """The continued fraction of the incomplete beta function; null where it has not converged.

    Two neighbouring convergents are carried on, divided by the newer one's denominator.
    """

    def step(held: Column, j: Column) -> Column:
        a, b, x = held["a"], held["b"], held["x"]
        m = F.floor(j / 2).cast("double")
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        term = F.when(j % 2 == 1, odd).otherwise(even)
        return F.aggregate(  # a fold over one value: its lambda is the only place to name the term
            F.array(term),
            held.withField("now", held["now"]),
            lambda held, term: F.struct(
                *[held[n].alias(n) for n in ("a", "b", "x")],
                ((held["now"] + term * held["before"]) / (1 + term * held["scale"])).alias("now"),
                (held["now"] / (1 + term * held["scale"])).alias("before"),
                (1 / (1 + term * held["scale"])).alias("scale"),
            ),
        )

    one, none = F.lit(1.0), F.lit(0.0)
    start = F.struct(
        a.alias("a"), b.alias("b"), x.alias("x"), one.alias("now"), one.alias("before"), none.alias("scale")
    )

    def result(held: Column) -> Column:
        still = F.abs(held["now"] * held["scale"] - held["before"]) <= F.abs(held["now"] * held["scale"]) * CONVERGED
        return F.when(still, held["now"])

    return F.aggregate(F.sequence(F.lit(1), terms), start, step, result)


MANY = 1e6  # degrees of freedom beyond which the normal distribution is asked
NORMAL_TERMS = 80  # of its series and fraction, for deviates below and above 4


def _normal_p(t: Column, df: Column, near: Column) -> Column:
    """Two-sided p-value for many degrees of freedom: that of the normal deviate with Student's
    tail, whose correction of the order of 1 / df**2 leaves nothing to see."""
    a = df - 0.5
    y = a * F.log1p(t * t / df)
    w = F.sqrt(y / 2) * (1 + (y + 3) / (48 * a * a))
    square = w * w

    def grow(held: Column, n: Column) -> Column:
        term = held["term"] * held["square"] * 2 / (n * 2 + 1)
        return F.struct(held["square"].alias("square"), term.alias("term"), (held["sum"] + term).alias("sum"))

    one = F.lit(1.0)
    up = F.sequence(F.lit(1), F.lit(NORMAL_TERMS))
    start = F.struct(square.alias("square"), one.alias("term"), one.alias("sum"))
    series = F.aggregate(up, start, grow, lambda held: held["sum"])
    inside = 2 / math.sqrt(math.pi) * F.exp(-square) * w * series
    down = F.sequence(F.lit(NORMAL_TERMS), F.lit(1), F.lit(-1))
    begin = F.struct(square.alias("square"), one.alias("value"))
    fraction = F.aggregate(
        down,
        begin,
        lambda held, n: F.struct(held["square"].alias("square"), (1 + n / (held["square"] * 2) / held["value"]).alias("value")),
        lambda held: held["value"],
    )
    outside = F.exp(-square) / (w * math.sqrt(math.pi)) / fraction
    return F.when(near, 1 - inside).otherwise(outside)


def t_test_p(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t for any degrees of freedom; null where there is none.

    The incomplete beta function of df / (df + t * t). Near 0 the other one, of t * t / (df + t * t), has
    more digits for many degrees of freedom; far out its complement would be too small for that. The
    fraction needs some multiple of the root of the degrees of freedom in terms.
    """
    total = df + t * t
    x, y = df / total, t * t / total
    near = (y < 0.5) & (F.abs(t) < 4)
    half, rest = F.lit(0.5), df / 2
    a, b = F.when(near, half).otherwise(rest), F.when(near, rest).otherwise(half)
    at, co = F.when(near, y).otherwise(x), F.when(near, x).otherwise(y)

    def log(value: Column, complement: Column) -> Column:
        return F.when(value < 0.5, F.log(value)).otherwise(F.log1p(-complement))

    front = F.exp(a * log(at, co) + b * log(co, at) - _log_beta_half(rest)) / a
    terms = (200 + 20 * F.sqrt(F.least(df, F.lit(MANY)))).cast("int")
    found = front / _fraction(a, b, at, terms)
    return (
        F.when(t.isNull() | df.isNull() | F.isnan(t) | F.isnan(df) | (df <= 0), F.lit(None).cast("double"))
        .when(t == 0, F.lit(1.0))
        .when(F.abs(t) == float("inf"), F.lit(0.0))
        .when(df > MANY, _normal_p(F.abs(t), df, F.abs(t) < 4))
        .otherwise(F.when(near, 1 - found).otherwise(found))
    )


def significance_label(p: Column) -> Column:
    return F.when(p.isNotNull() & ~F.isnan(p), below(p, L.SIGNIFICANCE_MARKS, L.NOT_SIGNIFICANT))


def decision(p: Column, alpha: float = ALPHA) -> Column:
    return F.when((p < alpha) & ~F.isnan(p), L.REJECT).otherwise(L.FAIL_TO_REJECT)


def effect_size(d: Column) -> Column:
    return F.when(d.isNotNull(), below(F.abs(d), L.EFFECT_SIZES, L.EFFECT_LARGE))
