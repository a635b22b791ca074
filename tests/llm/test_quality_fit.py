"""The dual coordinate descent against an independent solver, and the log-count ratios."""

import math

import numpy as np
import pytest

from cityweave.llm import quality


def projected_gradient(z, cost, rounds=200_000):
    """The dual of the hinge-loss machine, min 1/2 |z' a|^2 - sum a over 0 <= a <= cost, by
    accelerated projected gradient steps on the dense matrix."""
    q = z @ z.T
    step = 1 / np.linalg.eigvalsh(q)[-1]
    a = b = np.zeros(len(z))
    t = 1.0
    for _ in range(rounds):
        new = np.clip(b - step * (q @ b - 1), 0, cost)
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        b = new + (t - 1) / t2 * (new - a)
        if np.abs(new - a).max() < 1e-13:
            break
        a, t = new, t2
    return z.T @ a


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_hinge_dual(seed):
    rng = np.random.default_rng(seed)
    n, dims = 60, 25
    rows = [np.sort(rng.choice(dims, rng.integers(1, 12), replace=False)) for _ in range(n)]
    y = np.where(rng.random(n) < 0.4, 1, -1)
    for i, x in enumerate(rows):  # some signal
        rows[i] = np.unique(np.append(x, 0 if y[i] > 0 else 1)) if rng.random() < 0.8 else x
    scale = rng.standard_normal(dims)
    cost = np.where(y > 0, 0.7, 0.4)
    w, b = quality.hinge_dual(rows, y, scale, cost, rounds=4000)
    dense = np.zeros((n, dims + 1))
    for i, x in enumerate(rows):
        dense[i, x] = scale[x]
        dense[i, -1] = 1
    want = projected_gradient(dense * y[:, None], cost)
    assert np.allclose(np.append(w, b), want, atol=2e-3)

    def primal(v):
        return 0.5 * v @ v + (cost * np.maximum(0, 1 - y * (dense @ v))).sum()

    assert primal(np.append(w, b)) <= primal(want) * (1 + 1e-4)


def test_ratios_scale_the_indicators():
    counts = np.zeros((2, quality.DIMS))
    counts[1, 5], counts[0, 6], counts[:, 7] = 30, 30, 10
    rows = [np.array([5, 7], np.int32)] * 20 + [np.array([6, 7], np.int32)] * 20
    model = quality.fit(rows, np.array([1] * 20 + [-1] * 20), counts)
    assert model.weights[5] > 0 > model.weights[6] and abs(model.weights[7]) < 1e-3
    assert model.score(rows[0]) > 0.5 > model.score(rows[-1])
