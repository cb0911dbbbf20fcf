"""Top-k beside plain sorting where bars, parts and blocks leave out most of the work."""

import numpy as np
import pandas as pd
import pytest

from bidlens.operators import composite, history
from bidlens.operators.composite import Similarity, composite_topk, embedding_topk
from bidlens.operators.encoding import HashedWords
from bidlens.operators.history import HistoryIndex
from bidlens.operators.topk import _Running
from bidlens.plans.tenders import order_tenders, prepared


@pytest.mark.parametrize("kind", [int, str])
def test_running_is_a_plain_sort(kind):
    rng = np.random.default_rng(3)
    scores = rng.integers(0, 40, (200, 30)) / 7 + rng.choice([0, 2e-7], (200, 30))
    ids = rng.permutation(200).astype(kind)
    queries = pd.DataFrame({"q": np.arange(30).astype(kind), "bar": np.where(np.arange(30) % 3, -np.inf, 5.0)})
    running = _Running(queries, "q", 4, True, True, "bar")
    for start in range(0, 200, 3):
        for first in (0, 10):
            running.add(ids[start:start + 3], scores[start:start + 3, first:first + 10 if not first else 30], first)
    got = running.rows("q", "i")
    for j, q in enumerate(queries["q"]):
        rows = sorted((-s, i) for s, i in zip(np.round(scores[:, j], 6), ids) if i != q and s >= queries["bar"][j])[:4]
        mine = got[got["q"] == q]
        assert list(zip(-mine["score"], mine["i"])) == rows
        assert (mine["worst"] == np.round(scores[:, j].min(), 6)).all()


@pytest.fixture(scope="module")
def tenders(spark, sf):
    return prepared(order_tenders(spark, sf)).cache()


def hits(df):
    return sorted((r["target_id"], r["rank"], r["tender_id"], r["score"]) for r in df.collect())


def test_many_targets_leave_out_blocks(tenders, monkeypatch):
    """Above the bound all targets used to meet all rows."""
    asked = tenders.filter("o_orderkey % 40 = 0")
    want, near = hits(composite_topk(tenders, asked, 4)), hits(embedding_topk(tenders, asked, 4))
    opened, plain = [], HistoryIndex._pruned
    monkeypatch.setattr(HistoryIndex, "_pruned", lambda *args: plain(*args[:-1], opened))
    monkeypatch.setattr(composite, "MAX_BROADCAST_ROWS", 5)
    monkeypatch.setattr(history, "PART_TARGETS", 25)
    assert hits(composite_topk(tenders, asked, 4)) == want
    assert opened
    assert hits(embedding_topk(tenders, asked, 4)) == near
    vectors = Similarity(encoder=lambda: HashedWords(12))
    got = hits(composite_topk(tenders, asked, 4, similarity=vectors))
    monkeypatch.undo()
    assert got == hits(composite_topk(tenders, asked, 4, similarity=vectors))


def test_remembered_words_stay_small_and_home(monkeypatch):
    from pyspark import cloudpickle

    monkeypatch.setattr(composite, "REMEMBERED_TEXTS", 10)
    for i in range(100):
        assert dict(composite.unit_words(f"a a {i}")) == pytest.approx({"a": 2 / 5 ** 0.5, str(i): 1 / 5 ** 0.5})
    composite.unit_words("long " * 100)
    assert len(composite._remembered) <= 10 and "long " * 100 not in composite._remembered
    assert not cloudpickle.loads(cloudpickle.dumps(composite._remembered))
