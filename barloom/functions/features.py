"""The 65 features of a panel, in the order of their token ids."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import functions as F

from .expr import E, Env, call, clean, clip, either, fn, lit, when
from .formula import RegistrationError, sign

EPS = 1e-9


@dataclass(frozen=True)
class Feature:
    name: str
    category: str
    make: Callable[[Env], E]


FEATURES: dict[str, Feature] = {}


def feature(name: str, category: str, norm: bool = True):
    """Registers make(env) under name; norm: the robust rolling normalisation follows."""

    def add(f):
        if not name or len(name) > 64 or name in FEATURES:
            raise RegistrationError(f"feature {name!r} has no name of its own")
        FEATURES[name] = Feature(name, category, lambda env: env.robust(f(env)) if norm else env.let(clean(f(env))))
        return f

    return add


def value(env: Env, name: str) -> E:
    return env.once(("feature", name), lambda: FEATURES[name].make(env))


# -- shared intermediates


def before(env: Env, x: E, key: str) -> E:
    """The value one row ago, the first row's own."""
    return env.once((key, "before"), lambda: call(F.coalesce, env.lag(x, 1), x))


def prior_close(env: Env) -> E:
    return before(env, env["close"], "close")


def log_return(env: Env, n: int = 1) -> E:
    return env.once(("logret", n), lambda: call(lambda v: F.coalesce(v, F.lit(0.0)), fn("log", env["close"] / (env.lag(env["close"], n) + EPS))))


def typical(env: Env) -> E:
    return env.once("typical", lambda: (env["high"] + env["low"] + env["close"]) / 3.0)


def true_range(env: Env) -> E:
    pc = prior_close(env)
    return env.once("tr", lambda: call(F.greatest, env["high"] - env["low"], fn("abs", env["high"] - pc), fn("abs", env["low"] - pc)))


def atr(env: Env) -> E:
    return env.once("atr14", lambda: env.mean(true_range(env), 14))


def close_ema(env: Env, span: int) -> E:
    return env.once(("ema", span), lambda: env.ema(env["close"], span))


def stdev(env: Env, x: E, n: int) -> E:
    return env.std(x, n) + EPS


def slope(env: Env, x: E, n: int) -> E:
    """Least-squares slope over n rows, over the window's mean."""
    values = env.last(x, n)
    m = env.let(env.fold(values, lambda v: v, n=n))
    mid = (n - 1) / 2
    by = sum((i - mid) ** 2 for i in range(n)) + EPS
    s = call(lambda v, mm: F.aggregate(F.transform(v, lambda y, i: (y - mm) * (i.cast("double") - mid)), F.lit(0.0), lambda a, y: a + y) / by, values, m)
    return clean(s / (m + EPS))


def band(env: Env, n: int = 20) -> tuple[E, E]:
    return env.once(("ma", n), lambda: env.mean(env["close"], n)), env.once(("sd", n), lambda: stdev(env, env["close"], n))


def high_low(env: Env, n: int) -> tuple[E, E]:
    return env.once(("hh", n), lambda: env.max(env["high"], n)), env.once(("ll", n), lambda: env.min(env["low"], n))


def place(env: Env, n: int) -> E:
    """Where the close stands between the lowest low and the highest high."""
    hi, lo = high_low(env, n)
    return (env["close"] - lo) / (hi - lo + EPS)


def deviation(x: E, m: E) -> E:
    return (x - m) / (m + EPS)


def relative(env: Env, name: str) -> E:
    """Less the mean of the bar, where it has several symbols."""
    x = value(env, name)
    return when(env.width() <= 1, x, x - env.cross(x, F.avg))


def pair_correlation(env: Env, a: E, b: E, n: int, masked: bool) -> E:
    ca, cb = env.centred(a, n), env.centred(b, n)
    sa, sb = (env.let(fn("sqrt", env.moment(v, 2, n))) for v in (ca, cb))
    out = env.cov_of(ca, cb, n) / (sa * sb + 1e-8)
    return clean(when(either(sa < 1e-6, sb < 1e-6), 0.0, out) if masked else out)


def autocorrelation(env: Env, k: int) -> E:
    r = log_return(env)
    return clip(pair_correlation(env, env.lag(r, k, 0.0), r, 20, False), -1, 1)


def money(env: Env) -> E:
    """Where in its range the bar closed, -1 to 1, times volume."""
    h, l, c = env["high"], env["low"], env["close"]
    return env.once("mfv", lambda: ((c - l) - (h - c)) / (h - l + EPS) * env["volume"])


def squared_log(a: E, b: E) -> E:
    v = fn("log", (a + EPS) / (b + EPS))
    return v * v


def volatility(env: Env, x: E) -> E:
    return fn("log1p", fn("sqrt", env.mean(x, 20)))


def rogers(env: Env) -> E:
    o, h, l, c = (env[k] for k in ("open", "high", "low", "close"))

    def ln(a, b):
        return fn("log", (a + EPS) / (b + EPS))

    return env.once("rs", lambda: ln(h, c) * ln(h, o) + ln(l, c) * ln(l, o))


def directional(env: Env) -> tuple[E, E]:
    h, l = env["high"], env["low"]
    up = env.let(call(lambda v: F.greatest(v, F.lit(0.0)), h - before(env, h, "high")))
    down = env.let(call(lambda v: F.greatest(v, F.lit(0.0)), before(env, l, "low") - l))
    return tuple(env.once(("di", k), lambda x=x: env.mean(x, 14) / (atr(env) + EPS)) for k, x in (("+", up), ("-", down)))


def trix(env: Env) -> E:
    def make():
        e = env.ema(env.ema(env.ema(env["close"], 15), 15), 15)
        p = call(F.coalesce, env.lag(e, 1), e)
        return (e - p) / (fn("abs", p) + EPS)

    return env.once("trix", make)


# -- the registry


feature("RET", "trend")(lambda env: log_return(env))
feature("RET5", "trend")(lambda env: log_return(env, 5))
feature("RET20", "trend")(lambda env: log_return(env, 20))
feature("MA_DIFF", "trend")(lambda env: env.mean(env["close"], 10) / (env.mean(env["close"], 30) + EPS) - 1.0)
feature("SLOPE20", "trend")(lambda env: slope(env, env["close"], 20))
feature("ATR", "volatility")(lambda env: fn("log1p", call(lambda v: F.greatest(v, F.lit(0.0)), atr(env))))
feature("RVOL", "volatility")(lambda env: fn("log1p", stdev(env, log_return(env), 20)))
feature("HL_RANGE", "volatility")(lambda env: (env["high"] - env["low"]) / (env["close"] + EPS))
feature("VOL_REGIME", "volatility")(lambda env: atr(env) / (env.mean(atr(env), 20) + EPS) - 1.0)
feature("DEV", "reversal")(lambda env: deviation(env["close"], env.mean(env["close"], 20)))
feature("DEV60", "reversal")(lambda env: deviation(env["close"], env.mean(env["close"], 60)))


@feature("RSI14", "reversal", False)
def _rsi(env):
    d = env.let(env["close"] - prior_close(env))
    gain, loss = (env.mean(call(lambda v: F.greatest(v, F.lit(0.0)), x), 14) + 1e-9 for x in (d, -d))
    return clip((50.0 - 100.0 / (gain / loss + 1.0)) / 50.0, -1, 1)


@feature("PRESSURE", "reversal", False)
def _pressure(env):
    span = env["high"] - env["low"]
    return clip(when(fn("abs", span) < 1e-9, 0.0, (env["close"] - env["open"]) / span), -1, 1)


feature("AC1", "reversal", False)(lambda env: autocorrelation(env, 1))
feature("VOL_RATIO", "volume")(lambda env: env["volume"] / (env.mean(env["volume"], 20) + EPS))
feature("VOL_Z", "volume", False)(lambda env: clip((env["volume"] - env.mean(env["volume"], 20)) / (stdev(env, env["volume"], 20) + EPS), -5, 5))


@feature("PV_CORR", "volume", False)
def _pv(env):
    ratio = env.let(fn("log1p", call(lambda v: F.greatest(v, F.lit(-0.99)), value(env, "VOL_RATIO"))))
    return clip(pair_correlation(env, value(env, "RET"), ratio, 10, True), -1, 1)


feature("REL_RET5", "cross_sectional")(lambda env: relative(env, "RET5"))
feature("REL_RET20", "cross_sectional")(lambda env: relative(env, "RET20"))
feature("REL_VOL", "cross_sectional")(lambda env: relative(env, "RVOL"))


@feature("VWAP_DEV", "volume")
def _vwap(env):
    vwap = env.let(env.sum(typical(env) * env["volume"], 20) / (env.sum(env["volume"], 20) + EPS))
    return deviation(env["close"], vwap)


@feature("BOLL_POS", "channel", False)
def _boll(env):
    ma, sd = band(env)
    return clip((env["close"] - (ma - sd * 2.0)) / (sd * 4.0 + EPS), 0, 1)


@feature("BOLL_WIDTH", "volatility")
def _boll_width(env):
    ma, sd = band(env)
    return sd * 4.0 / (ma + EPS)


@feature("MACD_HIST", "momentum")
def _macd(env):
    macd = env.let(close_ema(env, 12) - close_ema(env, 26))
    return macd - env.ema(macd, 9)


@feature("OBV_SLOPE", "volume")
def _obv(env):
    return slope(env, env.sum(sign(env["close"] - prior_close(env)) * env["volume"]), 20)


@feature("MFI14", "volume", False)
def _mfi(env):
    t = typical(env)
    p = before(env, t, "typical")
    mf = env.let(t * env["volume"])
    up, down = env.sum(when(t > p, mf, 0.0), 14), env.sum(when(t < p, mf, 0.0), 14)
    return clip((50.0 - 100.0 / (up / (down + EPS) + 1.0)) / 50.0, -1, 1)


@feature("WILLR_14", "reversal", False)
def _willr(env):
    hi, lo = high_low(env, 14)
    return clip((hi - env["close"]) / (hi - lo + EPS), -1, 0)  # never negative for consistent bars, so 0: kept as defined


@feature("CCI_14", "reversal", False)
def _cci(env):
    t = typical(env)
    mad = env.let(env.fold(env.centred(t, 14), F.abs, n=14))
    return clip((t - env.mean(t, 14)) / (mad * 0.015 + EPS) / 200.0, -1, 1)


feature("ROC_12", "momentum")(lambda env: call(lambda v: F.coalesce(v, F.lit(0.0)), env["close"] / (env.lag(env["close"], 12) + EPS) - 1.0))
feature("TYPICAL_DEV", "reversal")(lambda env: deviation(typical(env), env.mean(typical(env), 20)))
feature("EMA_RATIO_12_26", "trend")(lambda env: close_ema(env, 12) / (close_ema(env, 26) + EPS) - 1.0)


@feature("TREND_STRENGTH_50", "trend")
def _strength(env):
    n, mid = 50, 24.5
    values = env.last(env["close"], n)
    m = env.let(env.fold(values, lambda v: v, n=n))
    by = sum((i - mid) ** 2 for i in range(n)) + EPS
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, y: a + y)
    s = env.let(call(lambda v, mm: total(F.transform(v, lambda y, i: (y - mm) * (i.cast("double") - mid))) / by, values, m))
    rest = env.let(call(lambda v, mm, ss: total(F.transform(v, lambda y, i: (y - mm - ss * (i.cast("double") - mid)) * (y - mm - ss * (i.cast("double") - mid)))), values, m, s))
    whole = env.let(call(lambda v, mm: total(F.transform(v, lambda y: (y - mm) * (y - mm))), values, m))
    return s / (m + EPS) * clip(1.0 - rest / (whole + EPS), 0, 1)


feature("PRICE_POS_50", "trend", False)(lambda env: clip(place(env, 50), 0, 1))
feature("TRIX_15", "momentum")(trix)
feature("PPO", "momentum")(lambda env: (close_ema(env, 12) - close_ema(env, 26)) / (fn("abs", close_ema(env, 26)) + EPS))


@feature("ULT_OSC", "momentum", False)
def _ult(env):
    pc = prior_close(env)
    low, high = call(F.least, env["low"], pc), call(F.greatest, env["high"], pc)
    bp, tr = env.let(env["close"] - low), env.let(high - low)
    a7, a14, a28 = (env.sum(bp, n) / (env.sum(tr, n) + EPS) for n in (7, 14, 28))
    return clip((a7 * 4.0 + a14 * 2.0 + a28) / 7.0 * 2.0 - 1.0, -1, 1)


feature("RET_ACCEL", "momentum")(lambda env: log_return(env, 5) - env.lag(log_return(env, 5), 5, 0.0))
feature("GK_VOL", "volatility")(
    lambda env: volatility(env, call(lambda v: F.greatest(v, F.lit(0.0)), squared_log(env["high"], env["low"]) * 0.5 - squared_log(env["close"], env["open"]) * (2 * math.log(2) - 1)))
)
feature("PARKINSON_VOL", "volatility")(lambda env: volatility(env, squared_log(env["high"], env["low"]) / (4 * math.log(2))))
feature("YANG_ZHANG_VOL", "volatility")(
    lambda env: volatility(env, (squared_log(env["open"], prior_close(env)) + squared_log(env["close"], env["open"]) + call(lambda v: F.greatest(v, F.lit(0.0)), rogers(env))) / 3.0)
)
feature("RS_VOL", "volatility")(lambda env: fn("log1p", fn("sqrt", call(lambda v: F.greatest(v, F.lit(0.0)), env.mean(rogers(env), 20)))))
feature("AMIHUD_ILLIQ", "volume")(lambda env: fn("log1p", call(lambda v: F.greatest(v, F.lit(0.0)), env.mean(fn("abs", log_return(env)) / (env["volume"] + EPS), 20))))


@feature("KYLE_LAMBDA", "volume")
def _kyle(env):
    flow = env.centred(sign(log_return(env)) * env["volume"], 20)
    size = env.centred(fn("abs", log_return(env)), 20)
    return env.cov_of(size, flow, 20) / (env.moment(flow, 2, 20) + EPS)


feature("CMF_20", "volume", False)(lambda env: clip(env.sum(money(env), 20) / (env.sum(env["volume"], 20) + EPS), -1, 1))
feature("AD_LINE_SLOPE", "volume")(lambda env: slope(env, env.sum(money(env)), 20))
feature("STOCH_K_14", "reversal", False)(lambda env: clip(place(env, 14) * 2.0 - 1.0, -1, 1))
feature("STOCH_D_3", "reversal", False)(lambda env: clip(env.mean(place(env, 14), 3) * 2.0 - 1.0, -1, 1))


@feature("AROON_OSC_25", "reversal", False)
def _aroon(env):
    hi, lo = env.last(env["high"], 25), env.last(env["low"], 25)
    return call(lambda a, b: (F.array_position(a, F.array_max(a)) - F.array_position(b, F.array_min(b))) / 25.0, hi, lo)


@feature("DMI_ADX_14", "trend", False)
def _adx(env):
    up, down = directional(env)
    return clip(env.mean(fn("abs", up - down) / (up + down + EPS), 14), 0, 1)


@feature("DMI_DIFF_14", "trend", False)
def _dmi(env):
    up, down = directional(env)
    return clip(up - down, -1, 1)


feature("TRIX_SIGNAL", "momentum")(lambda env: trix(env) - env.mean(trix(env), 9))
feature("DONCHIAN_POS_20", "channel", False)(lambda env: clip(place(env, 20), 0, 1))


@feature("KELTNER_POS_20", "channel", False)
def _keltner(env):
    mid, span = close_ema(env, 20), env.ema(atr(env), 20)
    return clip((env["close"] - (mid - span * 2.0)) / (span * 4.0 + EPS), 0, 1)


@feature("ICHIMOKU_KIJUN_DEV", "channel")
def _kijun(env):
    hi, lo = high_low(env, 26)
    return deviation(env["close"], (hi + lo) / 2.0)


@feature("ICHIMOKU_TENKAN_DEV", "channel")
def _tenkan(env):
    hi, lo = high_low(env, 9)
    return deviation(env["close"], (hi + lo) / 2.0)


@feature("SUPERTREND_DIR", "channel", False)
def _supertrend(env):
    mid = (env["high"] + env["low"]) / 2.0
    up, down = env.lag(mid + atr(env) * 1.5), env.lag(mid - atr(env) * 1.5)
    flip = env.let(call(lambda c, u, d: F.when(c < d, -1.0).when(c > u, 1.0), env["close"], up, down))
    return call(lambda v: F.coalesce(v, F.lit(0.0)), env.over(flip, lambda v: F.last(v, ignorenulls=True)))


feature("SAR_DIST", "channel")(lambda env: close_ema(env, 20) - close_ema(env, 50))


def shape(env: Env, k: int) -> E:
    c = env.centred(log_return(env), 20)
    s = env.let(fn("sqrt", env.moment(c, 2, 20)))
    power = s
    for _ in range(k - 1):
        power = power * s
    return env.moment(c, k, 20) / (power + EPS)


feature("ROLL_SKEW_20", "statistical")(lambda env: shape(env, 3))
feature("ROLL_KURT_20", "statistical")(lambda env: shape(env, 4) - 3.0)


@feature("HURST_50", "statistical", False)
def _hurst(env):
    c = env.centred(log_return(env), 50)

    def walked(v):
        zero = F.struct(F.lit(0.0).alias("at"), F.lit(-math.inf).alias("hi"), F.lit(math.inf).alias("lo"))
        return F.aggregate(v, zero, lambda a, y: F.struct((a["at"] + y).alias("at"), F.greatest(a["hi"], a["at"] + y).alias("hi"), F.least(a["lo"], a["at"] + y).alias("lo")), lambda a: a["hi"] - a["lo"])

    r, s = env.let(call(walked, c)), env.let(fn("sqrt", env.moment(c, 2, 50)))
    h = clip(fn("log", r / (s + EPS) + EPS) / math.log(50), 0, 1)
    return when(either(r < EPS, s < EPS), 0.5, h) * 2.0 - 1.0


@feature("FRACTAL_DIM_30", "statistical", False)
def _fractal(env):
    span = env.max(env["close"], 30) - env.min(env["close"], 30)
    step = env.mean(fn("abs", env["close"] - prior_close(env)), 30)
    return clip(span / (step * math.sqrt(30) + EPS), 0, 3) / 3.0 * 2.0 - 1.0


feature("AC2", "statistical", False)(lambda env: autocorrelation(env, 2))


@feature("RET_ENTROPY_20", "statistical", False)
def _entropy(env):
    r = log_return(env)
    values = env.last(r, 20)

    def share(test):
        return env.let(call(lambda v: F.size(F.filter(v, test)) / 20.0, values))

    parts = [share(lambda y: y > 0), share(lambda y: y < 0), share(lambda y: y == 0)]
    total = lit(0.0)
    for p in parts:
        total = total - p * fn("log", p + EPS)
    return clip(total / math.log(3), 0, 1)


def _over_symbols(env: Env, many: E, x: E) -> E:
    return env.let(clean(when(env.width() <= 1, env.robust(x), many)))


FEATURES["CS_RANK_RET5"] = Feature("CS_RANK_RET5", "cross_sectional", lambda env: _over_symbols(env, env.cross_rank(log_return(env, 5)) / call(lambda w: F.greatest(w - 1, F.lit(1)).cast("double"), env.width()), log_return(env, 5)))


@feature("CS_ZSCORE_RET20", "cross_sectional")
def _cs_z(env):
    x = log_return(env, 20)
    return when(env.width() <= 1, x, (x - env.cross(x, F.avg)) / (env.cross(x, F.stddev_samp) + EPS))
