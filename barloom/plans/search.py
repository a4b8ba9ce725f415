"""A genetic search over postfix formulas: the driver breeds, Spark scores a generation in one job."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features, vocabulary
from ..functions.expr import series
from ..operators import portfolio
from . import compiler

DEGENERATE, CONSTANT = -5.0, -2.0
REPEAT = 0.3


def random_formula(rng: np.random.Generator, length: int) -> tuple[int, ...]:
    """A feasible formula: at each place only tokens from which a depth of 1 can still be reached."""
    n_features, names = len(features.FEATURES), vocabulary.names()
    by_arity: dict[int, list[int]] = {0: list(range(n_features))}
    for t in range(n_features, len(names)):
        by_arity.setdefault(vocabulary.arity(t), []).append(t)
    out, depth = [], 0
    for i in range(length):
        left = length - i - 1
        able = [a for a in by_arity if depth >= a and 1 <= depth + 1 - a <= 1 + 2 * left]
        a = able[rng.integers(len(able))]
        out.append(by_arity[a][rng.integers(len(by_arity[a]))])
        depth += 1 - a
    return tuple(int(t) for t in out) if depth == 1 else random_formula(rng, length)


def mutate(rng: np.random.Generator, tokens: tuple[int, ...]) -> tuple[int, ...]:
    """One token becomes another of its arity, so the formula stays feasible."""
    i = int(rng.integers(len(tokens)))
    same = [t for t in range(len(vocabulary.names())) if vocabulary.arity(t) == vocabulary.arity(tokens[i])]
    return (*tokens[:i], int(same[rng.integers(len(same))]), *tokens[i + 1 :])


def cross(rng: np.random.Generator, a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
    """Head of a and tail of b, cut where both have the same depth; a itself if they never do."""
    da, db = vocabulary.depths(list(a)), vocabulary.depths(list(b))
    cuts = [i for i in range(1, min(len(a), len(b))) if da[i - 1] == db[i - 1]]
    if not cuts:
        return a
    i = cuts[int(rng.integers(len(cuts)))]
    return (*a[:i], *b[i:])


def score(panel: DataFrame, formulas: list[tuple[int, ...]]) -> dict[tuple[int, ...], float]:
    """Mean over symbols of the correlation with the next bar's return, less repeats; one plan and one aggregate for all."""
    named = {f"f{i}": t for i, t in enumerate(formulas) if vocabulary.feasible(list(t))}
    if not named:
        return dict.fromkeys(formulas, DEGENERATE)
    df = portfolio.target_return(compiler.evaluate_many(panel, named)).withColumn("nxt", F.lead("ret").over(series())).where("nxt IS NOT NULL")
    per = df.groupBy("symbol").agg(*[F.corr(k, "nxt").alias(f"{k}_c") for k in named], *[F.stddev_pop(k).alias(f"{k}_s") for k in named])
    row = per.agg(*[F.avg(F.coalesce(f"{k}_c", F.lit(0.0))).alias(f"{k}_c") for k in named], *[F.max(f"{k}_s").alias(f"{k}_s") for k in named]).first()
    out = dict.fromkeys(formulas, DEGENERATE)
    for k, t in named.items():
        flat = row[f"{k}_s"] is None or row[f"{k}_s"] < 1e-4
        out[t] = CONSTANT if flat else float(row[f"{k}_c"]) - REPEAT * vocabulary.repeats(list(t))
    return out


@dataclass
class Search:
    panel: DataFrame
    length: int = 4
    population: int = 12
    elites: int = 3
    crossover: float = 0.3
    seed: int = 0
    known: dict = field(default_factory=dict)

    def run(self, generations: int) -> list[tuple[tuple[int, ...], float]]:
        """The best formulas found, best first; equal seeds give equal results. Scores are remembered by tokens."""
        rng = np.random.default_rng(self.seed)
        now = [random_formula(rng, self.length) for _ in range(self.population)]
        for _ in range(generations):
            fresh = sorted({t for t in now if t not in self.known})
            if fresh:
                self.known |= score(self.panel, fresh)
            best = sorted(set(now), key=lambda t: (-self.known[t], t))
            parents = best[: max(2, self.population // 2)]
            now = best[: self.elites]
            while len(now) < self.population:
                a, b = (parents[int(rng.integers(len(parents)))] for _ in range(2))
                now.append(cross(rng, a, b) if rng.random() < self.crossover else mutate(rng, a))
        return sorted(self.known.items(), key=lambda x: (-x[1], x[0]))[: self.elites]
