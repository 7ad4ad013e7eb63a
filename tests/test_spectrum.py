"""Lanczos against a dense eigensolver."""

import numpy as np
import pytest

from thicket.graph import spectrum
from thicket.sources import fixtures


def dense(pairs):
    ids, ends = np.unique(np.array(pairs), return_inverse=True)
    a, b = ends.reshape(-1, 2).T
    m = np.zeros((len(ids), len(ids)))
    m[a, b] = m[b, a] = 1
    root = 1 / np.sqrt(m.sum(1))
    return np.linalg.eigvalsh(np.eye(len(ids)) - root[:, None] * m * root[None, :])[1]


def ring_with_chords(n, seed):
    rng = np.random.default_rng(seed)
    pairs = {(i, (i + 1) % n) for i in range(n)} | {tuple(map(int, rng.integers(0, n, 2))) for _ in range(n // 4)}
    return sorted({(min(p), max(p)) for p in pairs if p[0] != p[1]})


@pytest.mark.parametrize("kept", [48, 14])
def test_lambda2(spark, kept, monkeypatch):
    """kept: with few vectors the iteration is restarted."""
    monkeypatch.setattr(spectrum, "KEPT", kept)
    if kept == 14:
        pairs = ring_with_chords(40, 1)
        monkeypatch.setattr(spectrum, "GO_ON", 6)
    else:
        pairs = [(r.src, r.dst) for r in fixtures.karate(spark)[0].collect()]
    value, residual, vector = spectrum.second_eigenpair(fixtures.edges_of(spark, pairs))
    assert abs(value - dense(pairs)) < 1e-6 and residual < 1e-5
    x = np.array([r.x for r in vector.collect()])
    assert abs(x @ x - 1) < 1e-9


def test_small_graphs(spark):
    assert abs(spectrum.second_eigenpair(fixtures.edges_of(spark, [(3, 9)]))[0] - 2) < 1e-9
    apart = [(0, 1), (1, 2), (0, 2), (10, 11), (11, 12), (10, 12)]
    assert abs(spectrum.lambda2(fixtures.edges_of(spark, apart)).first().lambda2) < 1e-9
    with pytest.raises(ValueError, match="without edges"):
        spectrum.second_eigenpair(spark.createDataFrame([], "src long, dst long"))
