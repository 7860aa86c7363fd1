"""Count models: Poisson regression in closed form and by Spark ML, Leroux and BYM smoothing by posterior modes with their spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arealith.functions.columns import hash_uniform
from arealith.operators.audit import coverage
from arealith.sources.tables import cut


def intercept_glm(counts: DataFrame) -> DataFrame:
    """One row ``(intercept, se)`` of a Poisson model with offset log(expected): ln(sum O / sum E) and 1 / sqrt(sum mu)."""
    s = counts.agg(F.sum("observed").cast("double").alias("o"), F.sum("expected").cast("double").alias("e"))
    return s.select(F.log(F.col("o") / F.col("e")).alias("intercept"), (1 / F.sqrt(F.col("o"))).alias("se"))


def pearson_residuals(counts: DataFrame, fit: DataFrame) -> DataFrame:
    mu = F.col("expected") * F.exp("intercept")
    return counts.crossJoin(F.broadcast(fit.select("intercept"))).select("id", ((F.col("observed") - mu) / F.sqrt(mu)).alias("x"))


def covariate_glm(counts: DataFrame, features: list[str]) -> DataFrame:
    """``(term, coefficient, rate_ratio)`` of a Poisson model, log link, offset log(expected), by Spark ML."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    rows = VectorAssembler(inputCols=features, outputCol="features").transform(counts.filter("expected > 0").withColumn("offset", F.log("expected")))
    fit = GeneralizedLinearRegression(family="poisson", link="log", labelCol="observed", offsetCol="offset", maxIter=50, tol=1e-10).fit(rows)
    terms = [("intercept", float(fit.intercept)), *zip(features, (float(c) for c in fit.coefficients), strict=True)]
    return counts.sparkSession.createDataFrame(terms, "term string, coefficient double").withColumn("rate_ratio", F.exp("coefficient"))


def solved(nodes: DataFrame, edges: DataFrame, diagonal: Column, pull: list[float], rhs: list[Column], tolerance: float, steps: int = 2000) -> tuple[DataFrame, int]:
    """Solutions of symmetric systems on a graph by conjugate gradients, all right-hand sides in the same steps.

    System k: ``diagonal * x - pull[k] * (sum of x over the neighbours) = rhs[k]``; ``nodes`` has an ``id`` and what the
    columns need. Returns ``(id, x)`` with an array of the solutions, and the number of steps. A step is a join with the
    edges and a one-row aggregate, with the diagonal as preconditioner; it ends when no residual exceeds ``tolerance``.
    """
    lanes = range(len(rhs))
    at = lambda c, k: F.col(c)[k]
    # Factors go in as arrays, so that every step has the plan and the compiled code of the one before.
    factors = lambda values: F.array(*(F.lit(float(v)) for v in values))
    plus = lambda x, y: F.zip_with(x, y, lambda a, b: a + b)
    times = lambda x, y: F.zip_with(x, y, lambda a, b: a * b)
    zero = factors([0.0] * len(rhs))
    s = nodes.select("id", diagonal.alias("d"), F.array(*(c.cast("double") for c in rhs)).alias("r")).withColumns({"x": zero, "p": zero, "s": zero})
    alpha, gamma = [0.0] * len(rhs), [0.0] * len(rhs)
    for n in range(steps):
        s = s.withColumn("u", F.transform("r", lambda v: v / F.col("d")))
        near = edges.join(s.select(F.col("id").alias("dst"), "u"), "dst").groupBy(F.col("src").alias("id")).agg(*(F.sum(at("u", k)).alias(f"n{k}") for k in lanes))
        pulled = times(F.array(*(F.coalesce(F.col(f"n{k}"), F.lit(0.0)) for k in lanes)), factors([-v for v in pull]))
        w = plus(F.transform("u", lambda v: v * F.col("d")), pulled)
        s = cut(s.join(near, "id", "left").withColumn("w", w).select(*s.columns, "w"))
        one = s.agg(*(F.sum(at("r", k) * at("u", k)).alias(f"g{k}") for k in lanes), *(F.sum(at("w", k) * at("u", k)).alias(f"e{k}") for k in lanes), F.max(F.array_max(F.transform("r", F.abs))).alias("worst")).first()
        if one["worst"] is None or one["worst"] <= tolerance:
            return s.select("id", "x"), n
        beta = [one[f"g{k}"] / gamma[k] if gamma[k] else 0.0 for k in lanes]
        down = [one[f"e{k}"] - (beta[k] * one[f"g{k}"] / alpha[k] if alpha[k] else 0.0) for k in lanes]
        gamma = [one[f"g{k}"] for k in lanes]
        alpha = [g / e if e else 0.0 for g, e in zip(gamma, down, strict=True)]
        s = s.withColumns({"p": plus("u", times("p", factors(beta))), "s": plus("w", times("s", factors(beta)))})
        s = s.withColumns({"x": plus("x", times("p", factors(alpha))), "r": plus("r", times("s", factors([-v for v in alpha])))}).drop("u", "w")
    raise RuntimeError(f"conjugate gradients did not settle in {steps} steps")


class Smoothing:
    """Effects of areas under a Poisson model: ``leroux`` or ``bym``.

    ``leroux``: one effect of an area, drawn towards its neighbours by ``rho`` and to 0 by the rest, of variance ``tau2``.
    ``bym``: an effect that is drawn to its neighbours alone (``tau2``) and one of the area alone (``sigma2``). The intercept is
    ln(sum O / sum E).
    """

    def __init__(self, counts: DataFrame, edges: DataFrame, model: str = "leroux", tau2: float = 0.5, sigma2: float = 0.1, rho: float = 0.9):
        if model not in ("leroux", "bym"):
            raise ValueError(f"unknown model {model}")
        alone = coverage(counts.select("id"), edges.select(F.col("src").alias("id")), "id").filter("side = 'left only'")
        if not alone.isEmpty():
            raise ValueError("smoothing needs neighbours: some areas have none")
        self.model, self.tau2, self.sigma2, self.edges = model, tau2, sigma2 if model == "bym" else 0.0, edges
        self.pull, self.rest = (rho, 1 - rho) if model == "leroux" else (1.0, 0.0)
        degree = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
        level = counts.agg(F.log(F.sum("observed").cast("double") / F.sum("expected")).alias("level"))
        self.areas = cut(counts.select("id", "observed", "expected").join(degree, "id").crossJoin(F.broadcast(level)).withColumns({"effect": F.lit(0.0), "own": F.lit(0.0)}))

    @property
    def mean(self) -> Column:
        return F.col("expected") * F.exp(F.col("level") + F.col("effect") + F.col("own"))

    @property
    def weight(self) -> Column:
        """What the counts say of an effect, the area's own effect taken out."""
        return self.mean / (1 + self.sigma2 * self.mean)

    @property
    def diagonal(self) -> Column:
        return self.weight + (self.pull * F.col("degree") + self.rest) / self.tau2

    def to_mode(self, tolerance: float = 1e-8, rounds: int = 100) -> Smoothing:
        """Newton steps until no area's gradient exceeds the tolerance, else an error. A step moves no area by more than 1."""
        for _ in range(rounds):
            near = self.edges.join(self.areas.select(F.col("id").alias("dst"), F.col("effect").alias("e")), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("e").alias("around"))
            slope = F.col("observed") - self.mean - (self.pull * (F.col("degree") * F.col("effect") - F.col("around")) + self.rest * F.col("effect")) / self.tau2
            own = self.sigma2 * (F.col("observed") - self.mean) - F.col("own")  # times sigma2, so that no effect of its own is no case
            share = self.mean / (1 + self.sigma2 * self.mean)
            at = cut(self.areas.join(near, "id").withColumns({"slope": slope, "own_slope": own}).withColumn("rhs", slope - share * own))
            worst = at.agg(F.max(F.greatest(F.abs("slope"), F.abs("own_slope") / (self.sigma2 or 1.0)))).first()[0]
            if worst is None or worst <= tolerance:
                return self
            step, _ = solved(at, self.edges, self.diagonal, [self.pull / self.tau2], [F.col("rhs")], max(min(0.1, worst) * worst, tolerance / 10))
            at = at.join(step.select("id", F.col("x")[0].alias("move")), "id").withColumn("own_move", (F.col("own_slope") - self.sigma2 * self.mean * F.col("move")) / (1 + self.sigma2 * self.mean))
            at = cut(at)
            far = at.agg(F.max(F.abs(F.col("move") + F.col("own_move")))).first()[0]
            by = min(1.0, 1.0 / max(far, 1e-300))
            self.areas = cut(at.withColumns({"effect": F.col("effect") + by * F.col("move"), "own": F.col("own") + by * F.col("own_move")}).drop("around", "slope", "own_slope", "rhs", "move", "own_move"))
        raise RuntimeError("the mode was not reached")

    def spread(self, probes: int = 16, tolerance: float = 1e-9) -> DataFrame:
        """Adds to the areas ``of_effect`` and ``of_risk``: variances of the effect, and of the logarithm of the risk, at the mode.

        Diagonals of inverses by ``probes`` hashed vectors of 1 and -1: an estimate whose error falls with their number's root; it is
        never below the variance that the area would have if all others were known.
        """
        sign = [F.when(hash_uniform(F.col("id"), F.lit(k)) < 0.5, 1.0).otherwise(-1.0) for k in range(probes)]
        x, _ = solved(self.areas, self.edges, self.diagonal, [self.pull / self.tau2] * probes, sign, tolerance)
        mean = sum((sign[k] * F.col("x")[k] for k in range(1, probes)), sign[0] * F.col("x")[0]) / probes
        effect = F.greatest(mean, 1 / self.diagonal)
        own = self.sigma2 / (1 + self.sigma2 * self.mean)
        # Of effect and own effect together: the area's own uncertainty, and that of the effect as far as the counts do not settle it.
        return self.areas.join(x, "id").withColumn("of_effect", effect).withColumn("of_risk", own + F.col("of_effect") / (1 + self.sigma2 * self.mean) ** 2).drop("x")


def smoothed_risk(counts: DataFrame, edges: DataFrame, model: str = "leroux", tau2: float = 0.5, sigma2: float = 0.1, rho: float = 0.9, probes: int = 16) -> DataFrame:
    """``(id, observed, expected, effect, risk, sd, low, high)``: posterior modes with 95 % intervals, see ``Smoothing``.

    The variances are given. All steps are joins of the edges with the neighbours' effects and
    aggregates by area, so a graph of any size is spread over all tasks. An area without a neighbour is an error: its
    effect has no neighbours to borrow from; so is a mode that is not reached.
    """
    return risks(Smoothing(counts, edges, model, tau2, sigma2, rho).to_mode().spread(probes))


def risks(spread: DataFrame) -> DataFrame:
    effect = F.col("effect") + F.col("own")
    sd = F.sqrt("of_risk")
    risk = lambda z: F.exp(F.col("level") + effect + z * sd)
    return spread.select("id", "observed", "expected", effect.alias("effect"), F.exp(F.col("level") + effect).alias("risk"), sd.alias("sd"), risk(-1.959963984540054).alias("low"), risk(1.959963984540054).alias("high"))


def information(risk: DataFrame) -> DataFrame:
    """One row ``(deviance, parameters, dic)`` of smoothed risks: the Poisson deviance at the mode, and effective parameters, sum of mu times the variance."""
    mu = F.col("expected") * F.col("risk")
    ln_fact = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("observed"), F.lit(1)).cast("int")), F.lit(0.0), lambda a, k: a + F.log(k.cast("double")))
    one = risk.agg(F.sum(-2 * (F.col("observed") * F.log(mu) - mu - ln_fact)).alias("deviance"), F.sum(mu * F.col("sd") ** 2).alias("parameters"))
    return one.select("deviance", "parameters", (F.col("deviance") + 2 * F.col("parameters")).alias("dic"))
