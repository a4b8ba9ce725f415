"""Expressions over a panel (symbol, time, ...) that are laid out in layers.

A window expression may not feed another one in the same projection without Spark planning a node for each. Env.let names an
intermediate and Env.frame adds all names of one depth in one projection, so frames of equal partitioning and order share a
Window node and one sort, whatever the number of features; names that nothing selects are pruned by Catalyst.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def series():
    return Window.partitionBy("symbol").orderBy("time")


def cross():
    return Window.partitionBy("time")


class E:
    """A column with the number of layers below it."""

    __slots__ = ("c", "depth", "plain")

    def __init__(self, c: Column, depth: int = 0, plain: bool = False):
        self.c, self.depth, self.plain = c, depth, plain

    def _two(self, other, f):
        return call(f, self, other)

    def __add__(self, o):
        return self._two(o, lambda a, b: a + b)

    def __radd__(self, o):
        return self._two(o, lambda a, b: b + a)

    def __sub__(self, o):
        return self._two(o, lambda a, b: a - b)

    def __rsub__(self, o):
        return self._two(o, lambda a, b: b - a)

    def __mul__(self, o):
        return self._two(o, lambda a, b: a * b)

    __rmul__ = __mul__

    def __truediv__(self, o):
        return self._two(o, ratio)

    def __rtruediv__(self, o):
        return self._two(o, lambda a, b: ratio(F.lit(b), a))

    def __neg__(self):
        return call(lambda a: -a, self)

    def __gt__(self, o):
        return self._two(o, lambda a, b: a > b)

    def __lt__(self, o):
        return self._two(o, lambda a, b: a < b)

    def __ge__(self, o):
        return self._two(o, lambda a, b: a >= b)

    def __le__(self, o):
        return self._two(o, lambda a, b: a <= b)


def ratio(a: Column, b: Column | float) -> Column:
    """IEEE division: ANSI mode raises at 0."""
    b = b if isinstance(b, Column) else F.lit(float(b))
    inf = F.lit(math.inf)
    return F.when(b != 0, a / F.nullif(b, F.lit(0.0))).when((b == 0) & (a > 0), inf).when((b == 0) & (a < 0), -inf).when((b == 0) & a.isNotNull(), F.lit(math.nan))


def call(f: Callable[..., Column], *args) -> E:
    return E(f(*[a.c if isinstance(a, E) else a for a in args]), max([a.depth for a in args if isinstance(a, E)], default=0))


def lit(v: float) -> E:
    return E(F.lit(float(v)))


def when(cond: E, a, b) -> E:
    return call(lambda c, x, y: F.when(c, x).otherwise(y), cond, a, b)


def either(a: E, b: E) -> E:
    return call(lambda x, y: x | y, a, b)


def clip(x: E, lo: float, hi: float) -> E:
    return call(lambda v: F.greatest(F.least(v, F.lit(float(hi))), F.lit(float(lo))), x)


def fn(name: str, *args) -> E:
    return call(getattr(F, name), *args)


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(math.inf))


def clean(x: E) -> E:
    """NaN, infinities and nulls to 0."""
    return call(lambda v: F.when(finite(v), v).otherwise(0.0), x)


def settle(x: E) -> E:
    """After every formula operator: NaN and null to 0, infinities to 1 and -1."""
    return call(lambda v: F.when(v.isNull() | F.isnan(v), 0.0).when(v == math.inf, 1.0).when(v == -math.inf, -1.0).otherwise(v), x)


class Env:
    def __init__(self, panel: DataFrame, columns: tuple[str, ...] = ("open", "high", "low", "close", "volume")):
        self.panel, self.layers, self.held, self.n = panel, {}, {}, 0
        self.base = {c: E(F.col(c), 0, True) for c in columns}

    def __getitem__(self, name: str) -> E:
        return self.base[name]

    def let(self, e: E) -> E:
        self.n += 1
        name = f"__t{self.n}"
        self.layers.setdefault(e.depth, {})[name] = e.c
        return E(F.col(name), e.depth + 1, True)

    def once(self, key, make: Callable[[], E]) -> E:
        """The intermediate under key, made and named the first time it is asked for."""
        if key not in self.held:
            self.held[key] = self.let(make())
        return self.held[key]

    def frame(self, out: dict[str, E], keep: tuple[str, ...] = ("symbol", "time")) -> DataFrame:
        df = self.panel
        for depth in sorted(self.layers):
            df = df.withColumns(self.layers[depth])
        return df.select(*keep, *[e.c.alias(k) for k, e in out.items()])

    # -- windows over the series

    def over(self, x: E, f: Callable[[Column], Column], n: int | None = None) -> E:
        """f(x) over the last n rows, or over all so far."""
        x = self.named(x)
        frame = series().rowsBetween(Window.unboundedPreceding if n is None else 1 - n, 0)
        return self.let(call(lambda v: f(v).over(frame), x))

    def named(self, x: E) -> E:
        return x if x.plain else self.let(x)

    def lag(self, x: E, n: int = 1, default: float | None = None) -> E:
        x = self.named(x)
        return self.let(call(lambda v: F.lag(v, n, default).over(series()), x))

    def row(self) -> E:
        return self.once("row", lambda: E(F.row_number().over(series())))

    def sum(self, x: E, n: int | None = None) -> E:
        return self.over(x, F.sum, n)

    def mean(self, x: E, n: int) -> E:
        """Sum of the last n rows over n: missing rows count as 0."""
        return self.sum(x, n) / float(n)

    def _extreme(self, x: E, n: int, f, g) -> E:
        x = self.named(x)
        frame = series().rowsBetween(1 - n, 0)
        return self.let(call(lambda v: F.when(F.count(F.lit(1)).over(frame) < n, g(f(v).over(frame), F.lit(0.0))).otherwise(f(v).over(frame)), x))

    def max(self, x: E, n: int) -> E:
        return self._extreme(x, n, F.max, F.greatest)

    def min(self, x: E, n: int) -> E:
        return self._extreme(x, n, F.min, F.least)

    def last(self, x: E, n: int) -> E:
        """The last n rows as an array, oldest first, missing rows 0."""
        held = self.over(x, F.collect_list, n)
        return self.let(call(lambda v: F.concat(F.array_repeat(F.lit(0.0), F.lit(n) - F.size(v)), v), held))

    def fold(self, values: E, f: Callable[[Column], Column], *, n: int) -> E:
        """Sum of f over an array, divided by n."""
        return call(lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + f(x)) / float(n), values)

    def centred(self, x: E, n: int) -> E:
        """The last n rows less their mean."""
        values = self.last(x, n)
        m = self.let(self.fold(values, lambda v: v, n=n))
        return self.let(call(lambda v, mm: F.transform(v, lambda y: y - mm), values, m))

    def moment(self, centred: E, power: int, n: int) -> E:
        def raised(v):
            out = v
            for _ in range(power - 1):
                out = out * v
            return out

        return self.let(self.fold(centred, raised, n=n))

    def std(self, x: E, n: int) -> E:
        return self.let(fn("sqrt", self.moment(self.centred(x, n), 2, n)))

    def cov_of(self, a: E, b: E, n: int) -> E:
        return self.let(call(lambda u, v: F.aggregate(F.zip_with(u, v, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t) / float(n), a, b))

    def ema(self, x: E, span: int) -> E:
        """Recursive mean seeded with the first row; rows beyond a weight of 1e-16 are not read."""
        alpha = 2.0 / (span + 1)
        k = math.ceil(math.log(1e-16) / math.log(1 - alpha))
        held = self.over(x, F.collect_list, k + 1)
        return self.let(call(lambda v: F.aggregate(F.slice(v, 2, k), F.element_at(v, 1), lambda a, y: F.lit(alpha) * y + F.lit(1 - alpha) * a), held))

    def robust(self, x: E, n: int = 200) -> E:
        """(x - median) / (median absolute deviation + 1e-6) over n rows, lower medians, within 5; 0 before n rows."""
        x = self.let(clean(x))
        held = self.over(x, F.collect_list, n)
        middle = (n + 1) // 2 - 1

        def lower(v):
            return F.when(F.size(v) >= n, F.get(F.sort_array(v), F.lit(middle)))

        med = self.let(call(lower, held))
        mad = self.let(call(lambda v, m: F.when(F.size(v) >= n, lower(F.transform(v, lambda y: F.abs(y - m)))), held, med))
        return self.let(when(self.row() < n, 0.0, clean(clip((x - med) / (mad + 1e-6), -5, 5))))

    # -- one bar across symbols

    def cross(self, x: E, f: Callable[[Column], Column]) -> E:
        x = self.named(x)
        return self.let(call(lambda v: f(v).over(cross()), x))

    def width(self) -> E:
        return self.once("width", lambda: E(F.count(F.lit(1)).over(cross())))

    def cross_rank(self, x: E) -> E:
        x = self.named(x)
        return self.let(call(lambda v: (F.row_number().over(Window.partitionBy("time").orderBy(v, "symbol")) - 1).cast("double"), x))
