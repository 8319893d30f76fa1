"""Mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_keep, materialize, release, words_sql

#: Dimensions and the power that turns an observed share into a target one, where no targets are given.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
#: Share of all tokens that the sample should hold.
BUDGET = 0.5
#: Up to so many cells (source x language x topic) the fit runs on the driver; beyond, the same rounds run on DataFrames.
DRIVER_CELLS = 100_000
#: The fit ends with the first round whose marginals were all so close to their goals (as shares of all tokens), or which
#: came no closer than the one before. Goals missed by more than MISSED contradict each other; that is told by a warning.
ROUNDS, CLOSE, MISSED = 400, 1e-9, 1e-7
#: The factor of a value that has to give (this share of) all it has, and the end of one that grows because others keep it from its goal.
MOST_FACTOR, WHOLE = 1e12, 1 - 1e-12


def topic_of(text: Column) -> Column:
    """A coarse topic by the form of a text: tabular (bars), code (braces, semicolons at line ends), long (over 6,000 characters), prose."""
    t = F.coalesce(text, F.lit(""))
    count = lambda x: F.length(t) - F.length(F.replace(t, F.lit(x), F.lit("")))
    n = F.greatest(F.length(t), F.lit(1))
    return F.when(count("|") * 100 > n, "tabular").when((count(";") + count("{") + count("}")) * 50 > n, "code").when(n > 6000, "long").otherwise("prose")


def targets_of(shares: np.ndarray, power: float) -> np.ndarray:
    t = np.where(shares > 0, shares, 0) ** power * (shares > 0)
    return t / t.sum()


def reachable(goal: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Goals of the same sum of which none is over its most: what one can't take goes to the others in proportion to theirs."""
    total, out = min(goal.sum(), most.sum()), goal.copy()
    for _ in range(len(goal)):
        over = out >= most
        rest = out[~over].sum()
        if not rest:
            break
        new = np.where(over, most, out * (total - most[over].sum()) / rest)
        if np.allclose(new, out, rtol=1e-15, atol=0):
            break
        out = new
    return np.minimum(out, most)


def rake(tokens: np.ndarray, codes: list[np.ndarray], goals: list[np.ndarray], budget: float) -> tuple[np.ndarray, float]:
    """Probabilities of cells for which the expected tokens have the goals as marginals, and by how much they miss them.

    tokens and goals are shares of all tokens. All begin at the budget, but values that have to give all they have. Each
    round scales the factors of one dimension's values after the other: cells that give all their tokens stand for
    those, and the others are scaled to what is left of the goal.
    """
    most = [np.bincount(c, tokens, len(g)) for c, g in zip(codes, goals, strict=True)]
    factors, off = [np.where(g >= m * WHOLE, MOST_FACTOR, 1.0) for g, m in zip(goals, most, strict=True)], 1.0
    ratio = lambda: budget * np.prod([f[c] for f, c in zip(factors, codes, strict=True)], axis=0)
    for _ in range(ROUNDS):
        before, off = off, 0.0
        for k, (code, goal) in enumerate(zip(codes, goals, strict=True)):
            r = ratio()
            full, part = np.bincount(code, tokens * (r >= 1), len(goal)), np.bincount(code, np.where(r < 1, tokens * r, 0), len(goal))
            off = max(off, float(np.abs(full + part - goal).max()))
            with np.errstate(divide="ignore", invalid="ignore"):
                step = np.where(goal > full, np.where(part > 0, (goal - full) / part, 1.0), np.where(full + part > 0, goal / (full + part), 0.0))
            factors[k] = np.where(goal >= most[k] * WHOLE, MOST_FACTOR, np.minimum(factors[k] * step, MOST_FACTOR))
        if off < CLOSE or abs(before - off) < CLOSE:
            break
    return np.minimum(1.0, ratio()), off


def _given(names: list, shares: np.ndarray, wanted: dict | None, power: float) -> np.ndarray:
    if wanted is None:
        return targets_of(shares, power)
    t = np.array([float(wanted.get(n, 0)) for n in names]) * (shares > 0)
    if not t.sum() > 0:
        raise ValueError("no target names a value that the documents have")
    return t / t.sum()


def _reachable_far(goals: DataFrame) -> DataFrame:
    """reachable() for a table of values with share (the most) and goal."""
    total = goals.agg(F.least(F.sum("goal"), F.sum("share"))).first()[0]
    over = F.col("goal") >= F.col("share")
    before = -1
    while True:
        n, full, rest = goals.agg(F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, F.col("share"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("goal"))), F.lit(0.0))).first()
        if n == before or not rest:
            return goals.withColumn("goal", F.least("goal", "share"))
        before = n
        goals = materialize(goals.withColumn("goal", F.when(over, F.col("share")).otherwise(F.col("goal") * F.lit((total - full) / rest))), "goals")


def _fit_far(cells: DataFrame, dims: list[str], targets: dict[str, dict] | None, budget: float) -> tuple[DataFrame, float]:
    """The same fit, with the same rounds and tolerance, where the cells are too many for the driver.

    A cell's probability is the budget times one factor for each of its values, so a round writes
    only the factors: for each dimension, joins and a partially aggregated marginal.
    """
    total = float(cells.agg(F.sum("n_tokens")).first()[0])
    goals, factors = {}, {}
    for d in dims:
        share = cells.groupBy(d).agg((F.sum("n_tokens") / F.lit(total)).alias("share"))
        if targets and d in targets:
            wanted = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in targets[d].items()], f"{d} string, goal double")
            share = share.join(wanted, d, "left").withColumn("goal", F.coalesce("goal", F.lit(0.0)))
        else:
            share = share.withColumn("goal", F.pow("share", F.lit(POWERS.get(d, 1.0))))
        share = materialize(share, "goals")
        s = share.agg(F.sum("goal")).first()[0]
        if not s > 0:
            raise ValueError("no target names a value that the documents have")
        goals[d] = _reachable_far(share.withColumn("goal", F.col("goal") * F.lit(budget / s)))
        goals[d] = materialize(goals[d].select(d, "goal", (F.col("goal") >= F.col("share") * WHOLE).alias("whole")), "goals")
        factors[d] = materialize(goals[d].select(d, F.when(F.col("whole"), F.lit(MOST_FACTOR)).otherwise(F.lit(1.0)).alias(f"_{d}")), "factors")

    def chances() -> DataFrame:
        now, ratio = cells, F.lit(budget)
        for d in dims:
            now, ratio = now.join(factors[d], d), ratio * F.col(f"_{d}")
        return now.select(*dims, "n_tokens", F.least(F.lit(1.0), ratio).alias("p"))

    off = 1.0
    for _ in range(ROUNDS):
        before, off, old = off, 0.0, []
        for d in dims:
            held = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n_tokens") * F.col("p"))), F.lit(0.0)) / F.lit(total)
            have = chances().groupBy(d).agg(held(F.col("p") >= 1).alias("full"), held(F.col("p") < 1).alias("part")).join(goals[d], d).join(factors[d], d)
            step = F.expr("if(goal > full, if(part > 0, (goal - full) / part, 1), if(full + part > 0, goal / (full + part), 0))")
            scaled = F.when(F.col("whole"), F.lit(MOST_FACTOR)).otherwise(F.least(F.col(f"_{d}") * step, F.lit(MOST_FACTOR)))
            have = materialize(have.select(d, F.abs(F.col("full") + F.col("part") - F.col("goal")).alias("off"), scaled.alias(f"_{d}")), "factors")
            off = max(off, have.agg(F.max("off")).first()[0])
            old.append(factors[d])
            factors[d] = have.drop("off")
        release(*old)
        if off < CLOSE or abs(before - off) < CLOSE:
            break
    return materialize(chances().drop("n_tokens"), "cells"), off


def mix(docs: DataFrame, targets: dict[str, dict] | None = None, budget: float = BUDGET, seed: int = 17, topic: Column | None = None, driver_cells: int = DRIVER_CELLS, keep: list[str] | None = None) -> DataFrame:
    """A calibrated probability for every document and whether it is drawn.

    docs: doc_id, text, lang, source. Tokens are counted as words. Cells are the combinations of
    source, language and topic. Each dimension's targets (targets[dimension] = {value: share}; without, observed shares
    to the power POWERS) are shares of the expected sample, which holds budget of all tokens. No cell can give more than
    all its tokens, so what a value can't give falls to the others of its dimension, and the cells' probabilities
    are raked under that limit until all marginals of the expected sample are the goals; where goals contradict each
    other, a warning says by how much they are missed. A document is drawn if a hash of seed, id and text lies below its cell's
    probability: any executor draws the same. Null source or lang is a value of its own, shown as
    empty text. Documents without words have probability 0 and are not drawn. Very long texts count whole. Returns doc_id, source, lang, topic,
    n_tokens, p, sampled and the columns of keep (text, say); a name in keep that is also one of the result's is an error. A null id is
    handed on; repeated rows share their fate; other columns play no part; empty table: no rows.
    """
    spark, dims = docs.sparkSession, ["source", "lang", "topic"]
    keep = checked_keep(keep, ["doc_id", *dims, "n_tokens", "p", "sampled"])
    text = F.coalesce("text", F.lit(""))
    draw = F.conv(F.substring(F.md5(F.concat_ws("\x1f", F.lit(str(seed)), F.col("doc_id").cast("string"), text)), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    own = docs.select(
        "doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), (topic_of(text) if topic is None else topic).alias("topic"),
        F.size(words_sql(text)).cast("long").alias("n_tokens"), draw.alias("draw"), *([F.struct(*keep).alias("kept")] if keep else []),
    )
    if not keep:  # else the texts would be written once more
        own = materialize(own, "mix")
    cells = materialize(own.where("n_tokens > 0").groupBy(*dims).agg(F.sum("n_tokens").alias("n_tokens")), "cells")
    if targets and (odd := set(targets) - set(dims)):
        raise ValueError(f"no such dimension: {sorted(odd)}")
    rows = sorted(cells.limit(driver_cells + 1).collect())
    off = 0.0
    if len(rows) > driver_cells:
        chances, off = _fit_far(cells, dims, targets, budget)
    elif rows:
        tokens, codes, goals = np.array([r["n_tokens"] for r in rows], float), [], []
        tokens /= tokens.sum()
        for d in dims:
            names, code = np.unique([r[d] for r in rows], return_inverse=True)
            shares = np.bincount(code, tokens)
            codes.append(code)
            goals.append(reachable(budget * _given(list(names), shares, (targets or {}).get(d), POWERS[d]), shares))
        p, off = rake(tokens, codes, goals, budget)
        chances = F.broadcast(spark.createDataFrame([(*(r[d] for d in dims), float(x)) for r, x in zip(rows, p, strict=True)], "source string, lang string, topic string, p double"))
    else:
        chances = spark.createDataFrame([], "source string, lang string, topic string, p double")
    if off > MISSED:
        warnings.warn(f"the targets contradict each other: a marginal is off by {off:.2g} of all tokens", stacklevel=2)
    out = own.join(chances, dims, "left").withColumn("p", F.when(F.col("n_tokens") > 0, F.coalesce("p", F.lit(0.0))).otherwise(0.0))
    return out.select("doc_id", *dims, "n_tokens", "p", (F.col("draw") < F.col("p")).alias("sampled"), *[f"kept.{k}" for k in keep])
