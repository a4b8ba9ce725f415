"""Postfix formulas compiled to panel expressions, and the normalisation of their output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import features, formula, vocabulary
from ..functions.expr import E, Env, cross, series, settle

CLIP = 3.0
_HELD: list[DataFrame] = []


def compile_formula(env: Env, tokens: Sequence[int], dead_band: float = 0.0) -> E | None:
    """The formula's expression; None if it can't be evaluated. Equal sub-formulas of one Env are computed once."""
    if not vocabulary.feasible(list(tokens)):
        return None
    names, stack = vocabulary.names(), []
    for t in tokens:
        name = names[t]
        if t < len(features.FEATURES):
            stack.append(((t,), features.value(env, name)))
            continue
        n = formula.OPERATORS[name].arity
        args = stack[len(stack) - n :]
        del stack[len(stack) - n :]
        key = (t, dead_band if name == "GATE" else 0.0, *[k for k, _ in args])
        values = [v for _, v in args]
        if name == "GATE" and dead_band > 0:
            out = env.once(key, lambda v=values: settle(formula.gate_with_dead_band(env, *v, dead_band)))
        else:
            out = env.once(key, lambda n=name, v=values: settle(formula.OPERATORS[n].make(env, *v)))
        stack.append((key, out))
    return stack[0][1]


def clipped(x) -> F.Column:
    return F.greatest(F.least(x, F.lit(CLIP)), F.lit(-CLIP))


def held(df: DataFrame, most: int = 2) -> DataFrame:
    """df, kept after its first use; of those kept before, the session lets go of all but the latest (results that still read one
    compute it again)."""
    spark = df.sparkSession
    mine = [d for d in _HELD if d.sparkSession is spark]
    for old in mine[: max(0, len(mine) + 1 - most)]:
        old.unpersist()
    _HELD[:] = [*mine[max(0, len(mine) + 1 - most) :], df.persist()]
    return df


def normalise(df: DataFrame, column: str = "factor", window: int = 500) -> DataFrame:
    """Adds z-scores in place: over the bar's symbols; for a single symbol over the last window rows, or over all so far if there
    are fewer. A column that is all but constant stays as it is. One small aggregate decides which, as each needs another plan;
    the rows, which it and the result read, are computed once and spill to disk where memory ends."""
    df = held(df)
    facts = df.agg(F.count_distinct("symbol").alias("symbols"), F.count_distinct("time").alias("bars"), F.stddev_pop(column).alias("sd")).first()
    x = F.col(column)
    if facts["sd"] is None or facts["sd"] < 1e-6:
        return df
    if facts["symbols"] > 1:
        w = cross()
        z = (x - F.avg(x).over(w)) / F.greatest(F.coalesce(F.stddev_samp(x).over(w), F.lit(0.0)), F.lit(1e-8))
    elif facts["bars"] >= window:
        w = series().rowsBetween(1 - window, 0)
        z = F.when(F.row_number().over(series()) < window, 0.0).otherwise((x - F.avg(x).over(w)) / F.greatest(F.stddev_samp(x).over(w), F.lit(1e-8)))
    else:
        w = series().rowsBetween(Window.unboundedPreceding, 0)
        z = (x - F.avg(x).over(w)) / F.sqrt(F.greatest(F.var_pop(x).over(w), F.lit(1e-8)))
    return df.withColumn(column, clipped(z))


def evaluate(panel: DataFrame, tokens: Sequence[int], dead_band: float = 0.0, window: int = 500, keep: tuple[str, ...] = ("symbol", "time", "open", "close")) -> DataFrame | None:
    """The panel's keys with the normalised factor of a formula; only the features that it names are computed."""
    env = Env(panel)
    e = compile_formula(env, tokens, dead_band)
    return None if e is None else normalise(env.frame({"factor": e}, keep), window=window)


def evaluate_many(panel: DataFrame, formulas: dict[str, Sequence[int]], keep: tuple[str, ...] = ("symbol", "time", "open", "close")) -> DataFrame:
    """All feasible formulas as columns of one plan: shared sub-formulas and windows are planned once for a generation."""
    env = Env(panel)
    out = {k: e for k, t in formulas.items() if (e := compile_formula(env, t)) is not None}
    return env.frame(out, keep)
