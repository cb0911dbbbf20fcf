"""Rough squares choose the pairs, exact ones decide."""

import numpy as np
import pandas as pd
import pytest

from bidlens.operators import density, vectors
from bidlens.operators.topk import DIGITS, _feed, _Running
from bidlens.operators.vectors import vector_scorer


def plain(x, y):
    return np.round(np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2)), DIGITS)


@pytest.mark.parametrize("scale,largest", [(1.0, 1e18), (1e-4, 1e18), (3e5, 1e18), (3e5, 1.0)])
def test_pairs_within_a_radius(scale, largest, monkeypatch):
    monkeypatch.setattr(density, "ROUGH_CELLS", 1000)
    monkeypatch.setattr(vectors, "LARGEST_ROUGH", largest)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(300, 9)), rng.integers(0, 3, (100, 9))]) * scale
    y = np.concatenate([rng.normal(size=(200, 9)), rng.integers(0, 3, (100, 9)), x[:20]]) * 1.0
    y[:300] *= scale
    y[5, 2], x[7, 1] = np.nan, np.inf
    with np.errstate(invalid="ignore", over="ignore"):
        far = plain(x, y)
        # Radii that are distances themselves, and a rounding step beside them.
        near = np.sort(far[np.isfinite(far)])
        for epsilon in (0.0, near[50], near[500] - 1e-6, near[500] + 5e-7, near[20_000]):
            got = {(r, c) for rows, cols in density.near_pairs(x, y, density.largest_square(epsilon)) for r, c in zip(rows.tolist(), cols.tolist())}
            want = set(zip(*(z.tolist() for z in np.nonzero(far <= epsilon))))
            assert got == want


def test_largest_square():
    for epsilon in (0.0, 0.25, 1.15, 2.000001, 1234.567891):
        most = density.largest_square(epsilon)
        assert np.round(np.sqrt(most), DIGITS) <= epsilon < np.round(np.sqrt(np.nextafter(most, np.inf)), DIGITS)
    assert density.largest_square(-1.0) == -np.inf


def test_pieces_hang_together():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 400, 300), rng.integers(0, 400, 300)
    piece = density._joined(density._joined(np.arange(400), a[:150], b[:150]), a[150:], b[150:])
    want = np.arange(400)
    for x, y in list(zip(a, b)) * 400:
        if want[x] != want[y]:
            want[[x, y]] = min(want[x], want[y])
    for x in range(400):
        assert piece[piece[x]] == piece[x]
    assert (piece == want).all()


def test_reached_scores_are_those_of_the_whole_matrix():
    rng = np.random.default_rng(6)
    base = pd.DataFrame({"id": np.arange(900), "vec": list(np.concatenate([rng.normal(size=(450, 6))] * 2))})
    asked = pd.DataFrame({"q": np.arange(300, 700), "qv": list(np.array(base["vec"].tolist())[300:700])})

    def found(hide):
        scorer = vector_scorer("l2", "vec", "qv")(asked)
        seen = []
        if hide:
            whole = lambda batch: scorer(batch)
            use = whole
        else:
            reaching = scorer.reaching
            scorer.reaching = lambda batch, cut: seen.append(len(batch)) or reaching(batch, cut)
            use = scorer
        running = _Running(asked, "q", 4, True, False)
        for start in range(0, 900, 100):
            _feed(running, [(0, use)], base.iloc[start:start + 100], "id", len(asked))
        return running.rows("q", "id"), seen

    (plain_rows, _), (rows, seen) = found(True), found(False)
    assert sum(seen) == 800
    pd.testing.assert_frame_equal(rows, plain_rows)
