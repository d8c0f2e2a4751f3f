"""Mixing weights of fixed components by EM, as one fold over arrays: no UDF, no driver loop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _drawn(components: Column, seed: int, k: int) -> Column:
    """Start number k: weights by chance, the same whenever the job runs."""
    raw = F.transform(F.sequence(F.lit(1), F.size(components)), lambda i: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), i), F.lit(1 << 31)).cast("double") + 1.0)
    return _let(raw, lambda r: _let(_total(r), lambda whole: F.transform(r, lambda v: v / whole)))


def em_weights(target: Column, components: Column, priors: Column, iterations: int = 20, tolerance: float = 1e-6, tries: int = 1, seed: int = 0) -> Column:
    """struct<weights, likelihood, steps>.

    target: array of term frequencies; components: array (one for each component) of
    arrays of term probabilities; priors: pseudo-counts of the components. Stops when the log likelihood
    changes by less than tolerance times the sum of the two between two steps (the start itself is not compared). One try starts from even weights; more start
    from weights drawn by seed, and the one that ends likeliest stays, the first of equals.
    """
    starts = [F.transform(components, lambda c: F.lit(1.0) / F.size(components))] if tries <= 1 else [_drawn(components, seed, k) for k in range(tries)]
    best, *others = (_climbed(target, components, priors, iterations, tolerance, s) for s in starts)
    for x in others:
        best = F.aggregate(F.array(x), best, lambda a, b: F.when(b["likelihood"] > a["likelihood"], b).otherwise(a))
    return best


def _climbed(target: Column, components: Column, priors: Column, iterations: int, tolerance: float, first: Column) -> Column:
    """em_weights() from one start."""
    terms = F.sequence(F.lit(0), F.size(target) - 1)

    def mixed(w: Column) -> Column:
        return F.transform(terms, lambda t: F.aggregate(F.zip_with(w, components, lambda a, c: a * F.get(c, t)), F.lit(0.0), lambda s, x: s + x))

    def step(state: Column) -> Column:
        return _let(mixed(state["weights"]), lambda share: gain(state, share))

    def gain(state: Column, share: Column) -> Column:
        # expected counts of a term by component are its count times weight * probability / mixture
        per = F.transform(terms, lambda t: F.when(F.get(share, t) > 0, F.get(target, t) / F.get(share, t)).otherwise(0.0))
        like = _total(F.transform(terms, lambda t: F.when(F.get(share, t) > 0, F.get(target, t) * F.ln(F.get(share, t))).otherwise(0.0)))
        done = (state["steps"] >= iterations) | (state["steps"] > 1) & (F.abs(like - state["likelihood"]) < F.abs(like + state["likelihood"]) * tolerance)
        parts = F.zip_with(state["weights"], components, lambda a, c: F.struct(a.alias("a"), c.alias("c")))
        gained = _let(per, lambda per: F.zip_with(parts, priors, lambda x, prior: prior + x["a"] * _total(F.zip_with(per, x["c"], lambda p, q: p * q))))
        return _let(gained, lambda g: _let(_total(g), lambda whole: F.struct(F.when(done, state["weights"]).otherwise(F.transform(g, lambda v: v / whole)).alias("weights"), like.alias("likelihood"), (state["steps"] + F.when(done, 0).otherwise(1)).alias("steps"), done.alias("done"))))

    start = F.struct(first.alias("weights"), F.lit(0.0).alias("likelihood"), F.lit(0).alias("steps"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(iterations)), start, lambda s, _: F.when(s["done"], s).otherwise(step(s)), lambda s: F.struct(s["weights"].alias("weights"), s["likelihood"].alias("likelihood"), s["steps"].alias("steps")))


def mixing_weights(rows: DataFrame, key: str, iterations: int = 20, tries: int = 1, seed: int = 0) -> DataFrame:
    """key, weights, likelihood, steps for rows key, target, components, priors."""
    found = em_weights(F.col("target"), F.col("components"), F.col("priors"), iterations, tries=tries, seed=seed)
    return rows.select(key, found.alias("_r")).select(key, "_r.weights", "_r.likelihood", "_r.steps")
