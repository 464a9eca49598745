"""Confidence models: encoding, a penalised logistic fit on aggregated gradients, exact binomial bounds, conformal thresholds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import once
from ..shared import checkpointed

# Fixed values of the calibration.
LEAST_N, DELTA = 47, 0.1
FOLDS, LEAST_FOLDED = 5, 10
#: probabilities, rows by fits, that a task of a fit holds at once
FIT_CELLS = 1 << 20
GRID = tuple(round(0.99 - 0.01 * k, 2) for k in range(99))


def encode(rows: DataFrame, levels: dict[str, list[str]], nullable: list[str], logs: list[str], keep: list[str]) -> DataFrame:
    """Columns for a model: one-hots of the levels, (value or 0, missing) of nullable numbers, log1p of counts; keep: columns that stay."""
    out = [F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)).alias(f"{c}_{v}") for c, values in levels.items() for v in values]
    out += [x for c in nullable for x in (F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c), F.col(c).isNull().cast("double").alias(f"{c}_missing"))]
    out += [F.log1p(F.coalesce(F.col(c), F.lit(0)).cast("double")).alias(f"log_{c}") for c in logs]
    return rows.select(*keep, *out)


def fit_logistic(rows: DataFrame, features: list[str], label: str, l2: float = 1.0, rounds: int = 100, tolerance: float = 1e-10) -> np.ndarray:
    """Weights, intercept first and not penalised, of the summed log-loss plus l2 / 2 times the squared weights, by Newton steps.

    Each step is one aggregation of the gradient and the upper half of the Hessian; the driver solves a system of the number of features. rows are
    read in every step, so what is dear to compute is for the caller to write first (fit_calibrated checkpoints).
    """
    w = np.zeros(len(features) + 1)
    x = [F.lit(1.0), *(F.col(f).cast("double") for f in features)]
    penalty = np.diag([0.0] + [l2] * len(features))
    for _ in range(rounds):
        z = x[0] * float(w[0])
        for c, v in zip(x[1:], w[1:].tolist(), strict=True):
            z = z + c * v
        base = rows.select(*(c.alias(f"x{i}") for i, c in enumerate(x)), (1 / (1 + F.exp(-z))).alias("p"), F.col(label).cast("double").alias("y"))
        sums = [F.sum((F.col("y") - F.col("p")) * F.col(f"x{i}")) for i in range(len(x))]
        sums += [F.sum(F.col("p") * (1 - F.col("p")) * F.col(f"x{i}") * F.col(f"x{j}")) for i in range(len(x)) for j in range(i, len(x))]
        got = [v or 0.0 for v in base.agg(*(s.alias(f"s{k}") for k, s in enumerate(sums))).first()]
        gradient, hessian = np.array(got[: len(x)]) - penalty @ w, np.zeros((len(x), len(x)))
        hessian[np.triu_indices(len(x))] = got[len(x) :]
        hessian = hessian + np.triu(hessian, 1).T + penalty
        step = np.linalg.solve(hessian + 1e-12 * np.eye(len(x)), gradient)
        w = w + step
        if np.abs(step).max() < tolerance:
            break
    return w


def logit(features: list[str], weights: np.ndarray) -> Column:
    z = F.lit(float(weights[0]))
    for f, v in zip(features, weights[1:].tolist(), strict=True):
        z = z + F.col(f).cast("double") * v
    return z


def predict(features: list[str], weights: np.ndarray, platt: tuple[float, float] = (1.0, 0.0)) -> Column:
    """Probabilities; platt: slope and intercept of fit_calibrated."""
    return 1 / (1 + F.exp(-(logit(features, weights) * platt[0] + platt[1])))


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds _i, the place in the order from 0; rows stay in their partitions, and the driver gets a count of each."""
    placed = rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()).transform(checkpointed)
    part = F.shiftright("_id", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).orderBy("_part").collect()
    before, starts = 0, []
    for r in counts:
        starts.append((r["_part"], before))
        before += r["n"]
    starts = rows.sparkSession.createDataFrame(starts, "_part long, _start long")
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("_i", F.col("_start") + F.col("_id") - F.shiftleft("_part", 33)).drop("_id", "_part", "_start")


def folds(rows: DataFrame, order: list[str], group: str | None = None) -> tuple[str, DataFrame, int]:
    """How rows are held out, rows with _fold from 0, and how many folds: each group of two or more ("groups"); else the place in the order modulo FOLDS ("kfold"); else, under LEAST_FOLDED rows, none ("in_sample")."""
    if group is not None:
        names = _numbered(rows.select(F.col(group).alias("_g")).distinct(), ["_g"]).select("_g", F.col("_i").cast("int").alias("_fold")).transform(checkpointed)
        n = names.count()
        if n >= 2:
            return "groups", rows.join(names, F.col(group).eqNullSafe(F.col("_g"))).drop("_g").transform(checkpointed), n
    if rows.count() >= LEAST_FOLDED:
        return "kfold", _numbered(rows, order).withColumn("_fold", (F.col("_i") % FOLDS).cast("int")).drop("_i").transform(checkpointed), FOLDS
    return "in_sample", rows.withColumn("_fold", F.lit(None).cast("int")).transform(checkpointed), 0


def _columns(batch: pd.DataFrame, features: list[str]) -> np.ndarray:
    return np.column_stack([np.ones(len(batch)), batch[features].to_numpy(np.float64)])


def _sums(features: list[str], label: str, weights: np.ndarray):
    """Of a task's rows, for each fit the gradient and the upper half of the Hessian, over the rows that the fit may see: fit k does without fold k, the last sees all.

    Probabilities of a batch under all fits are one matrix product, and so are the sums.
    """
    upper = np.triu_indices(weights.shape[1])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(weights), weights.shape[1] + len(upper[0])))
        for whole in batches:
            for at in range(0, len(whole), max(1, FIT_CELLS // len(weights))):
                batch = whole.iloc[at : at + max(1, FIT_CELLS // len(weights))]
                x, y, fold = _columns(batch, features), batch[label].to_numpy(np.float64), batch["_fold"].to_numpy(np.float64)
                p = 1 / (1 + np.exp(-(x @ weights.T)))
                seen = np.ones(p.shape, bool)
                own = np.flatnonzero(~np.isnan(fold))
                seen[own, fold[own].astype(np.int64)] = False
                total[:, : x.shape[1]] += ((y[:, None] - p) * seen).T @ x
                total[:, x.shape[1] :] += (p * (1 - p) * seen).T @ (x[:, upper[0]] * x[:, upper[1]])
        yield pd.DataFrame({"fit": np.arange(len(total), dtype=np.int32), "sums": list(total)})

    return add


def fit_folds(placed: DataFrame, features: list[str], label: str, n: int, l2: float = 1.0, rounds: int = 100, tolerance: float = 1e-10) -> np.ndarray:
    """Weights of n + 1 fits as fit_logistic gives them: row k without the rows of fold k, the last with all. placed: features, label, _fold (0 to n - 1, or null).

    Every Newton step of all fits is one job, in which each row is read once; tasks send sums for each fit and no rows. The driver holds and solves a small
    system for each fit.
    """
    size = len(features) + 1
    weights, penalty = np.zeros((n + 1, size)), np.diag([0.0] + [l2] * len(features))
    upper = np.triu_indices(size)
    rows = placed.select(*(F.col(f).cast("double").alias(f) for f in features), F.col(label).cast("double").alias(label), "_fold")
    for _ in range(rounds):
        parts = rows.mapInPandas(_sums(features, label, weights), "fit int, sums array<double>")
        totals = parts.select("fit", F.posexplode("sums").alias("k", "v")).groupBy("fit", "k").agg(F.sum("v").alias("v")).groupBy("fit").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("s"))
        got = np.zeros((n + 1, size + len(upper[0])))
        for r in totals.select("fit", F.transform("s", lambda e: e["v"]).alias("s")).toLocalIterator():
            got[r["fit"]] = r["s"]
        hessian = np.zeros((n + 1, size, size))
        hessian[:, upper[0], upper[1]] = hessian[:, upper[1], upper[0]] = got[:, size:]
        step = np.linalg.solve(hessian + penalty + 1e-12 * np.eye(size), (got[:, :size] - weights @ penalty)[:, :, None])[:, :, 0]
        weights = weights + step
        if np.abs(step).max() < tolerance:
            break
    return weights


def fit_calibrated(rows: DataFrame, features: list[str], label: str, order: list[str], group: str | None = None, l2: float = 1.0) -> tuple[np.ndarray, tuple[float, float], str]:
    """Weights of the fit on all rows, Platt's slope and intercept, and how rows were held out.

    Each row's logit comes from a fit without its fold; slope and intercept are fitted on these logits against Platt's smoothed targets. Needs the
    session's checkpoint folder. Rows without a label are for the caller to leave out.
    """
    mode, placed, n = folds(rows.select(*dict.fromkeys([*features, label, *order, *([group] if group else [])])), order, group)
    weights = fit_folds(placed, features, label, n, l2)

    def held_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = batch["_fold"].fillna(n).to_numpy(np.int64)
            yield pd.DataFrame({"_z": (_columns(batch, features) * weights[own]).sum(axis=1), "_good": batch["_good"]})

    good = F.col(label).cast("double") > 0.5
    z = placed.select(*(F.col(f).cast("double").alias(f) for f in features), "_fold", good.alias("_good")).mapInPandas(held_out, "_z double, _good boolean")
    n_good, n_bad = placed.agg(F.count_if(good), F.count_if(~good)).first()
    target = F.when(F.col("_good"), (n_good + 1) / (n_good + 2)).otherwise(1 / (n_bad + 2))
    intercept, slope = fit_logistic(z.select("_z", target.alias("_t")).transform(checkpointed), ["_z"], "_t", l2=1e-6)
    return weights[-1], (float(slope), float(intercept)), mode


def _beta_share(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function by its continued fraction (modified Lentz), in constant memory whatever a and b."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_share(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c = 1e-300, 1.0
    d = 1.0 / ((1.0 - (a + b) * x / (a + 1)) or tiny)
    out = d
    for j in range(1, 1_000_000):
        for term in (j * (b - j) * x / ((a + 2 * j - 1) * (a + 2 * j)), -(a + j) * (a + b + j) * x / ((a + 2 * j) * (a + 2 * j + 1))):
            d = 1.0 / ((1.0 + term * d) or tiny)
            c = (1.0 + term / c) or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def binom_cdf(k: int, m: int, p: float) -> float:
    """P[Bin(m, p) <= k]; 1 for k >= m or m <= 0."""
    if m <= 0 or k >= m or (k >= 0 and p <= 0):
        return 1.0
    if k < 0 or p >= 1:
        return 0.0
    return min(1.0, max(0.0, _beta_share(1 - p, m - k, k + 1)))


def clopper_pearson_upper(k: int, m: int, delta: float) -> float:
    """The largest p for which at most k of m is not rarer than delta."""
    if m <= 0 or k >= m:
        return 1.0
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if binom_cdf(k, m, mid) > delta else (lo, mid)
    return (lo + hi) / 2


def with_p_value(rows: DataFrame, k: str, m: str, p: float) -> DataFrame:
    """Adds p_value, of k or fewer of m at rate p, to rows of counts."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(p_value=[binom_cdf(int(a), int(b), p) for a, b in zip(batch[k], batch[m], strict=True)])

    return rows.mapInPandas(scan, f"{rows.schema.simpleString()[7:-1]},p_value:double")


def with_upper_bound(rows: DataFrame, k: str, m: str, delta: float) -> DataFrame:
    """Adds upper, the bound at delta on the rate behind k of m, to rows of counts."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(upper=[clopper_pearson_upper(int(a), int(b), delta) for a, b in zip(batch[k], batch[m], strict=True)])

    return rows.mapInPandas(scan, f"{rows.schema.simpleString()[7:-1]},upper:double")


def threshold_counts(scored: DataFrame, score: str, correct: str, grid: tuple[float, ...] = GRID) -> DataFrame:
    """(seq, t, m, k): for each threshold, rows that reach it and errors among them. Every row counts once, at the highest threshold it reaches; sums run over the grid."""
    from pyspark.sql import Window

    spark = scored.sparkSession
    table = spark.createDataFrame([(i, t) for i, t in enumerate(grid)], "seq int, t double")
    low = [min(grid[: i + 1]) for i in range(len(grid))]  # falls, so the first threshold reached is found by halves

    def reached(s: Column, lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo if lo < len(low) else None).cast("int")
        mid = (lo + hi) // 2
        return F.when(s >= low[mid], reached(s, lo, mid)).otherwise(reached(s, mid + 1, hi))

    # rows below all thresholds go after the aggregation: a filter before it would compute the place of each row again
    seq = once(F.col(score), lambda s: reached(s, 0, len(low)))
    steps = scored.groupBy(seq.alias("seq")).agg(F.count("*").alias("_m"), F.count_if(~F.col(correct)).alias("_k")).filter("seq is not null")
    w = Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)  # a row per threshold
    return table.join(F.broadcast(steps), "seq", "left").select("seq", "t", F.sum(F.coalesce("_m", F.lit(0))).over(w).alias("m"), F.sum(F.coalesce("_k", F.lit(0))).over(w).alias("k"))


def calibrate(scored: DataFrame, score: str, correct: str, alpha: float, delta: float = DELTA, grid: tuple[float, ...] = GRID, least: int = LEAST_N) -> DataFrame:
    """One row: n, threshold, m, k, emitted. Thresholds are tested in the order of the grid until one fails; of those passed the one with most rows is taken, the first of equals. Fewer than `least` rows certify nothing."""
    from pyspark.sql import Window

    tested = with_p_value(threshold_counts(scored, score, correct, grid), "k", "m", alpha)
    passed = F.when((F.col("p_value") <= delta) & (F.col("m") > 0), 1).otherwise(0)
    w = Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    run = tested.withColumn("_ok", F.min(passed).over(w) == 1)
    best = run.filter("_ok").agg(F.max(F.struct("m", (-F.col("seq")).alias("o"), "t", "k")).alias("_b"))
    n = scored.agg(F.count("*").alias("n"))
    out = n.crossJoin(best)  # one row and one row
    ok = F.col("_b").isNotNull() & (F.col("n") >= least)
    return out.select("n", F.when(ok, F.col("_b.t")).alias("threshold"), F.when(ok, F.col("_b.m")).alias("m"), F.when(ok, F.col("_b.k")).alias("k"), ok.alias("emitted"))


def gate(fields: DataFrame, bound: DataFrame, probability: str = "probability") -> DataFrame:
    """Decisions under a bound of one row: BLOCK stays; others are accepted if a bound was emitted, they have a value and reach the threshold."""
    rows = fields.crossJoin(F.broadcast(bound.select("threshold", "emitted").limit(1)))  # one row
    accept = F.coalesce(F.col("emitted") & F.col("value").isNotNull() & (F.col(probability) >= F.col("threshold")), F.lit(False))
    out = rows.withColumn("confidence", F.when(F.col("decision") == "BLOCK", F.col("confidence")).otherwise(F.col(probability)))
    return out.withColumn("decision", F.when(F.col("decision") == "BLOCK", "BLOCK").when(accept, "AUTO_ACCEPT").otherwise("REVIEW")).drop("threshold", "emitted")


def plan_sequence(scored: DataFrame, score: str, correct: str, n_calibration: int, alpha: float, delta: float = DELTA, grid: tuple[float, ...] = GRID) -> list[float]:
    """Thresholds in the order in which they should be tested: most likely to pass first, then most coverage, then lowest. The driver holds a row per threshold."""
    rows = threshold_counts(scored, score, correct, grid).toPandas()
    total = int(scored.count())
    out = []
    for r in rows.itertuples():
        if r.m and total:
            risk, m = (r.k + 0.5) / (r.m + 1), max(1, round(n_calibration * r.m / total))
            most = max((k for k in range(m + 1) if binom_cdf(k, m, alpha) <= delta), default=-1)
            out.append((-(binom_cdf(most, m, risk) if most >= 0 else 0.0), -r.m, r.t))
    return [t for _, _, t in sorted(out)]
