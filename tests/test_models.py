"""Smoothing against dense solutions, at counts so small that the prior decides."""

import hashlib
import math

import numpy as np
import pytest

from arealith.operators import models as M
from arealith.operators import spatial as S


def lattice(spark, rows, cols, expected, seed):
    rng = np.random.default_rng(seed)
    cells = [(r * cols + c, r, c) for r in range(rows) for c in range(cols)]
    n = len(cells)
    W = np.array([[float((a != b) and abs(p - r) <= 1 and abs(q - c) <= 1) for b, r, c in cells] for a, p, q in cells])
    L = np.diag(W.sum(1)) - W
    field = rng.normal(size=n) * 0.4
    e = expected * rng.uniform(0.3, 2.0, n)
    o = rng.poisson(e * np.exp(field))
    counts = spark.createDataFrame([(i, int(o[i]), float(e[i])) for i in range(n)], "id long, observed long, expected double")
    edges = S.lattice_edges(spark.createDataFrame(cells, "id long, r long, c long"), True)
    return counts, edges, L, o, e


def dense(L, o, e, pull, rest, tau2, sigma2):
    """Mode and covariance by Newton on the dense system."""
    n, level = len(o), math.log(o.sum() / e.sum())
    P = (pull * L + rest * np.eye(n)) / tau2
    x = np.zeros(2 * n if sigma2 else n)
    prior = np.block([[P, np.zeros((n, n))], [np.zeros((n, n)), np.eye(n) / sigma2]]) if sigma2 else P
    both = np.hstack([np.eye(n)] * (2 if sigma2 else 1))
    for _ in range(200):
        m = e * np.exp(level + both @ x)
        g = both.T @ (o - m) - prior @ x
        if np.abs(g).max() < 1e-11:
            break
        step = np.linalg.solve(both.T @ np.diag(m) @ both + prior, g)
        x = x + step * min(1.0, 1.0 / np.abs(both @ step).max())
    cov = np.linalg.inv(both.T @ np.diag(m) @ both + prior)
    return both @ x, np.sqrt(np.diag(both @ cov @ both.T)), m


def signs(n, probes):
    """The probes: 1 and -1 by the md5 of area and number."""
    u = lambda i, k: (int(hashlib.md5(f"{i}|{k}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32
    return np.array([[1.0 if u(i, k) < 0.5 else -1.0 for k in range(probes)] for i in range(n)])


@pytest.mark.parametrize("model", ["leroux", "bym"])
def test_modes_and_spread_equal_a_dense_solution(spark, model):
    counts, edges, L, o, e = lattice(spark, 5, 6, 1.0, 3)
    pull, rest, tau2, sigma2 = (0.9, 0.1, 0.5, 0.0) if model == "leroux" else (1.0, 0.0, 0.5, 0.1)
    got = sorted(M.smoothed_risk(counts, edges, model, probes=6).collect())
    want, sd, m = dense(L, o, e, pull, rest, tau2, sigma2)
    assert np.abs(np.array([r.effect for r in got]) - want).max() < 1e-6
    # The same probes on the dense system.
    w = m / (1 + sigma2 * m)
    A = np.diag(w) + (pull * L + rest * np.eye(len(o))) / tau2
    v = signs(len(o), 6)
    own = np.maximum((v * np.linalg.solve(A, v)).mean(1), 1 / np.diag(A))
    assert np.allclose([r.sd for r in got], np.sqrt(sigma2 / (1 + sigma2 * m) + own / (1 + sigma2 * m) ** 2), atol=1e-7)
    # What the probes estimate.
    assert np.allclose(sigma2 / (1 + sigma2 * m) + np.diag(np.linalg.inv(A)) / (1 + sigma2 * m) ** 2, sd**2)
    assert all(abs(math.log(r.high / r.risk) - 1.959963984540054 * r.sd) < 1e-9 for r in got)


def test_systems_that_do_not_settle_are_errors(spark):
    counts, edges, *_ = lattice(spark, 4, 4, 5.0, 1)
    with pytest.raises(RuntimeError):
        M.Smoothing(counts, edges).to_mode(rounds=1)
    with pytest.raises(ValueError):
        M.smoothed_risk(counts, edges.filter("src <> 0 and dst <> 0"))
