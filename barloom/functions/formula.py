"""The 62 formula operators: name, arity and expression. Ids follow the features' in the vocabulary."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import functions as F

from .expr import E, Env, call, clip, fn, lit, settle, when

EPS = 1e-6


@dataclass(frozen=True)
class Operator:
    name: str
    arity: int
    make: Callable[..., E]


OPERATORS: dict[str, Operator] = {}


class RegistrationError(ValueError):
    """A name that is taken, an arity outside 0..10 or a missing part."""


def operator(name: str, arity: int, make: Callable[..., E] | None = None):
    """Registers make(env, *args) under name; also usable as a decorator."""

    def add(f):
        if not name or len(name) > 64 or not callable(f):
            raise RegistrationError(f"operator {name!r} lacks a name or an expression")
        if not 0 <= arity <= 10:
            raise RegistrationError(f"operator {name} has arity {arity}")
        if name in OPERATORS:
            raise RegistrationError(f"operator {name} is registered already")
        OPERATORS[name] = Operator(name, arity, f)
        return f

    return add if make is None else add(make)


def apply(env: Env, name: str, *args: E) -> E:
    op = OPERATORS[name]
    if len(args) != op.arity:
        raise RegistrationError(f"operator {name} takes {op.arity} arguments, not {len(args)}")
    return env.let(settle(op.make(env, *args)))


def number(c):
    return c.isNotNull() & ~F.isnan(c)


def sign(x: E) -> E:
    return call(lambda v: F.when(number(v) & (v > 0), 1.0).when(number(v) & (v < 0), -1.0).otherwise(0.0), x)


def positive(x: E) -> E:
    return call(lambda v: number(v) & (v > 0), x)


def jump(env: Env, x: E) -> E:
    x = env.named(x)
    row = env.row()
    n = call(lambda r: r.cast("double"), row)
    mean = env.let(env.sum(x) / n)
    var = env.let(call(lambda v: F.greatest(v, F.lit(1e-12)), env.sum(x * x) / n - mean * mean))
    z = (x - mean) / fn("sqrt", var)
    return when(row <= 5, 0.0, fn("tanh", z - 1.5))


def below(env: Env, x: E, n: int) -> E:
    x = env.named(x)
    return call(lambda v, y: F.size(F.filter(v, lambda u: u < y)) / float(n), env.last(x, n), x)


def correlation(env: Env, x: E, y: E, n: int = 10) -> E:
    a, b = env.centred(x, n), env.centred(y, n)
    sx, sy = (env.let(fn("sqrt", env.moment(v, 2, n))) for v in (a, b))
    c = env.cov_of(a, b, n) / (sx * sy + 1e-8)
    return call(lambda p, q, v: F.when((p < EPS) | (q < EPS), 0.0).otherwise(v), sx, sy, c)


def zscore(env: Env, x: E, n: int) -> E:
    x = env.named(x)
    sd = env.std(x, n) + 1e-9
    return when(sd < 2e-9, 0.0, (x - env.mean(x, n)) / sd)


def winsorize(env: Env, x: E, n: int = 20) -> E:
    x = env.named(x)
    ordered = env.let(fn("sort_array", env.last(x, n)))

    def at(share):
        place = share * (n - 1)
        k, part = int(place), place - int(place)
        return call(lambda v: F.get(v, F.lit(k)) + (F.get(v, F.lit(k + 1)) - F.get(v, F.lit(k))) * F.lit(part), ordered)

    lo, hi = env.let(at(0.05)), env.let(at(0.95))
    return call(lambda v, a, b: F.when(b - a < 1e-9, v).otherwise(F.greatest(F.least(v, b), a)), x, lo, hi)


def first_place(env: Env, x: E, n: int, best) -> E:
    return call(lambda v: (F.array_position(v, best(v)) - 1) / float(n - 1), env.last(x, n))


def weighted(env: Env, x: E, weights: list[float], by: float = 1.0) -> E:
    """Sum of weights[k] times the value k rows ago, over by."""
    x = env.named(x)
    out = x * weights[0]
    for k, w in enumerate(weights[1:], 1):
        out = out + env.lag(x, k, 0.0) * w
    return out / by


def delta(env: Env, x: E, n: int) -> E:
    x = env.named(x)
    return call(lambda a, b: F.coalesce(a - b, F.lit(0.0)), x, env.lag(x, n))


def alone(env: Env, x: E, many: E) -> E:
    """many, or x itself where the bar has one symbol."""
    return when(env.width() <= 1, x, many)


def cross_rank(env: Env, x: E) -> E:
    x = env.named(x)
    n = env.width()
    return when(n <= 1, call(lambda v: F.when(number(v) & (F.abs(v) != math.inf), v).otherwise(0.5), x), env.cross_rank(x) / call(lambda w: F.greatest(w - 1, F.lit(1)).cast("double"), n))


def cross_scale(env: Env, x: E) -> E:
    x = env.named(x)
    lo, hi = env.cross(x, F.min), env.cross(x, F.max)
    return alone(env, x, call(lambda v, a, b: F.when(b - a < 1e-9, 0.5).otherwise((v - a) / F.nullif(b - a, F.lit(0.0))), x, lo, hi))


def skew(env: Env, x: E, n: int = 10) -> E:
    c = env.centred(x, n)
    s = env.let(fn("sqrt", env.moment(c, 2, n)) + EPS)
    return env.moment(c, 3, n) / (s * s * s)


def signed_square(env: Env, x: E) -> E:
    return clip(sign(x) * x * x, -1e9, 1e9)


operator("ADD", 2, lambda env, x, y: x + y)
operator("SUB", 2, lambda env, x, y: x - y)
operator("MUL", 2, lambda env, x, y: x * y)
operator("DIV", 2, lambda env, x, y: x / (y + EPS))
operator("NEG", 1, lambda env, x: -x)
operator("ABS", 1, lambda env, x: fn("abs", x))
operator("SIGN", 1, lambda env, x: sign(x))
operator("GATE", 3, lambda env, c, x, y: call(lambda p, a, b: p.cast("double") * a + (1.0 - p.cast("double")) * b, positive(c), x, y))
operator("JUMP", 1, jump)
operator("DECAY", 1, lambda env, x: weighted(env, x, [1.0, 0.8, 0.6], 2.4))
operator("DELAY1", 1, lambda env, x: env.lag(x, 1, 0.0))
operator("MAX3", 1, lambda env, x: call(F.greatest, x, env.lag(x, 1, 0.0), env.lag(x, 2, 0.0)))
for _n in (5, 10, 20):
    operator(f"TS_MEAN_{_n}", 1, lambda env, x, n=_n: env.mean(x, n))
for _n in (5, 10, 20):
    operator(f"TS_STD_{_n}", 1, lambda env, x, n=_n: env.std(x, n) + EPS)
for _n in (5, 10, 20):
    operator(f"TS_RANK_{_n}", 1, lambda env, x, n=_n: below(env, x, n))
operator("TS_CORR_10", 2, correlation)
operator("MOMENTUM_5", 1, lambda env, x: env.mean(x, 5) - env.mean(x, 20))
operator("MOMENTUM_10", 1, lambda env, x: env.mean(x, 10) - env.mean(x, 20))
operator("TS_MAX_10", 1, lambda env, x: env.max(x, 10))
operator("TS_MIN_10", 1, lambda env, x: env.min(x, 10))
operator("WMA", 1, lambda env, x: weighted(env, x, [3.0, 2.0, 1.0], 6.0))
operator("DELAY4", 1, lambda env, x: env.lag(x, 4, 0.0))
operator("EMA_5", 1, lambda env, x: env.ema(x, 5))
operator("EMA_20", 1, lambda env, x: env.ema(x, 20))
operator("TS_QUANTILE_10", 1, lambda env, x: below(env, x, 10))
operator("TS_SKEW_10", 1, skew)
operator("TS_MIN_20", 1, lambda env, x: env.min(x, 20))
operator("TS_MAX_20", 1, lambda env, x: env.max(x, 20))
operator("DELTA", 1, lambda env, x: delta(env, x, 1))
operator("TS_ARG_MAX_5", 1, lambda env, x: first_place(env, x, 5, F.array_max))
operator("TS_ARG_MIN_5", 1, lambda env, x: first_place(env, x, 5, F.array_min))
operator("DECAY_LINEAR_5", 1, lambda env, x: weighted(env, x, [5.0, 4.0, 3.0, 2.0, 1.0], 15.0))
operator("SCALE", 1, lambda env, x: x / (env.sum(fn("abs", x)) + EPS))
operator("COVARIANCE_10", 2, lambda env, x, y: env.cov_of(env.centred(x, 10), env.centred(y, 10), 10))
operator("PRODUCT_5", 1, lambda env, x: fn("expm1", clip(env.sum(fn("log1p", call(lambda v: F.greatest(v, F.lit(-0.999)), x)), 5), -10, 10)))
operator("SIGNED_POWER_2", 1, signed_square)
operator("TS_DECAY_EXP_5", 1, lambda env, x: weighted(env, x, [0.5 * 0.5 ** (4 - k) for k in range(5)], sum(0.5 * 0.5**k for k in range(5))))  # the oldest row weighs most
operator("DELTA_5", 1, lambda env, x: delta(env, x, 5))
operator("CS_RANK", 1, cross_rank)
operator("CS_SCALE", 1, cross_scale)
operator("CS_NEUTRALIZE", 1, lambda env, x: alone(env, x, x - env.cross(x, F.avg)))
for _n in (5, 10, 20):
    operator(f"TS_SUM_{_n}", 1, lambda env, x, n=_n: env.sum(x, n))
operator("MIN", 2, lambda env, x, y: call(lambda a, b: F.when(F.isnan(a) | F.isnan(b), F.lit(math.nan)).otherwise(F.least(a, b)), x, y))
operator("MAX", 2, lambda env, x, y: call(F.greatest, x, y))
operator("POWER", 1, signed_square)
operator("SIGNED_LOG", 1, lambda env, x: sign(x) * fn("log1p", fn("abs", x)))
operator("SQRT", 1, lambda env, x: sign(x) * fn("sqrt", fn("abs", x)))
operator("TS_ZSCORE_10", 1, lambda env, x: zscore(env, x, 10))
operator("TS_ZSCORE_20", 1, lambda env, x: zscore(env, x, 20))
operator("WINSORIZE", 1, winsorize)
operator("CLIP", 1, lambda env, x: clip(x, -3, 3))
operator("SIGMOID", 1, lambda env, x: lit(2.0) / (fn("exp", -x) + 1.0) - 1.0)
operator("TANH_SQUASH", 1, lambda env, x: fn("tanh", x))
operator("IF_GT", 3, lambda env, c, x, y: when(positive(c), x, y))


def gate_with_dead_band(env: Env, c: E, x: E, y: E, band: float) -> E:
    """GATE that keeps its last decision while |c| <= band; before any decision it takes y."""
    c = env.named(c)
    decided = env.let(call(lambda v: F.when(number(v) & (v > band), 1.0).when(number(v) & (v < -band), 0.0), c))
    held = env.over(decided, lambda v: F.last(v, ignorenulls=True))
    return call(lambda d, a, b: F.coalesce(d, F.lit(0.0)) * a + (1.0 - F.coalesce(d, F.lit(0.0))) * b, held, x, y)
