"""Rule-weighted tender search: eight component scores, top k per target."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from bidlens.functions import kernels
from bidlens.operators.encoding import EncoderFactory, cosine_block, encode_fields
from bidlens.operators.topk import Scorer, ScorerFactory, hits_side, rank, topk
from bidlens.schema import (
    COMPONENTS, DATE_SCALE_DAYS, DISTRICTS, EMBEDDING_FIELD_WEIGHTS, METHOD_GROUPS, OTHER_FIELDS, PRICE_SCALE_FACTOR,
    PRICE_SCALE_FLOOR, REGION_SPELLINGS, normalised_weights,
)
from bidlens.session import MAX_BROADCAST_ROWS, materialise

Groups = Mapping[str, Sequence[str]]
SCORED = ["title", "description", "customer", "region", "method", "price", "published_s", *OTHER_FIELDS]


# Texts up to this length are remembered by a worker, so many at a time.
REMEMBERED_CHARACTERS, REMEMBERED_TEXTS = 200, 1 << 15


class _Remembered(dict):
    """Travels to a worker empty."""

    def __reduce__(self):
        return _Remembered, ()


_remembered = _Remembered()


def unit_words(text: str) -> tuple[tuple[str, float], ...]:
    """Words of a text and their shares in its length-1 word-count vector; blocks ask for the same short texts again."""
    found = _remembered.get(text)
    if found is None:
        counts = Counter(text.split())
        size = np.sqrt(sum(c * c for c in counts.values())) or 1.0
        found = tuple((word, c / size) for word, c in counts.items())
        if len(text) <= REMEMBERED_CHARACTERS:
            if len(_remembered) >= REMEMBERED_TEXTS:
                _remembered.clear()
            _remembered[text] = found
    return found


def _word_block(values: pd.Series, goals: Sequence[str]) -> np.ndarray:
    """Word-count cosine of every value with every goal text."""
    vocabulary: dict[str, int] = {}
    held = [unit_words(goal) for goal in goals]
    for words in held:
        for word, _ in words:
            vocabulary.setdefault(word, len(vocabulary))
    wanted = np.zeros((len(vocabulary), len(goals)))
    for j, words in enumerate(held):
        for word, share in words:
            wanted[vocabulary[word], j] = share
    codes, distinct = pd.factorize(values)
    out = np.zeros((len(distinct), len(goals)))
    for i, text in enumerate(distinct):
        _add_words(out[i], unit_words(text), vocabulary, wanted)
    return out[codes]


def _add_words(out: np.ndarray, shares: Iterable[tuple[str, float]], vocabulary: Mapping[str, int], wanted: np.ndarray) -> None:
    """Product of one text's words with all goals: most texts have few of the goals' many words."""
    for word, share in shares:
        j = vocabulary.get(word)
        if j is not None:
            out += share * wanted[j]


def _value_block(values: pd.Series, goals: Sequence[str], compare: Callable[[str, str], float]) -> np.ndarray:
    """Pairwise rule, worked out once per distinct pair of values."""
    codes, distinct = pd.factorize(values)
    goal_codes, distinct_goals = pd.factorize(np.asarray(goals, dtype=object))
    cells = np.array([[compare(g, v) for g in distinct_goals] for v in distinct], dtype=float)
    return cells.reshape(len(distinct), len(distinct_goals))[codes][:, goal_codes]


def _shares_group(groups: Groups) -> Callable[[str, str], bool]:
    parents: dict[str, set[str]] = {}
    for parent, children in groups.items():
        for child in children:
            parents.setdefault(child, set()).add(parent)
    nothing: set[str] = set()
    return lambda a, b: bool(parents.get(a, nothing) & parents.get(b, nothing))


def _category(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    if a.lower() == b.lower():
        return 1.0
    return 0.3 if a in b or b in a else 0.0


@dataclass(frozen=True)
class Similarity:
    """How components are compared.

    ``numeric``: gaussian, exponential or inverse, over a width that follows the two
    prices, or ``scale`` if given. ``temporal``: exponential, gaussian or linear over
    ``scale_days``. ``encoder`` loads a text encoder; without one texts are compared by
    their word counts.
    """

    numeric: str = "gaussian"
    scale: float | None = None
    temporal: str = "exponential"
    scale_days: float = DATE_SCALE_DAYS
    encoder: EncoderFactory | None = None

    def __post_init__(self) -> None:
        if self.numeric not in ("gaussian", "exponential", "inverse"):
            raise ValueError(f"unknown numeric similarity {self.numeric!r}")
        if self.temporal not in ("exponential", "gaussian", "linear"):
            raise ValueError(f"unknown temporal similarity {self.temporal!r}")

    def prices(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.scale is None:
            width = np.maximum(PRICE_SCALE_FLOOR, (np.abs(a) + np.abs(b)) / 2 * PRICE_SCALE_FACTOR)
        else:
            width = np.full(np.broadcast(a, b).shape, self.scale if self.scale > 0 else 1.0)
        gap = np.abs(a - b)
        if self.numeric == "gaussian":
            return np.exp(-(gap * gap) / (2 * width * width))
        return np.exp(-gap / width) if self.numeric == "exponential" else 1 / (1 + gap / width)

    def days(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Seconds on both sides; a missing one scores 0."""
        share = np.abs(a - b) / (self.scale_days * 86400.0)
        if self.temporal == "exponential":
            out = np.exp(-share)
        else:
            out = np.exp(-(share * share) / 2) if self.temporal == "gaussian" else np.maximum(0.0, 1 - share)
        return np.nan_to_num(out, nan=0.0)


WORD_FIELDS = (("text", "title"), ("description", "description"), ("customer", "customer"))


def region_rule(districts: Groups | None = None) -> Callable[[str, str], float]:
    near = _shares_group(DISTRICTS if districts is None else districts)
    spelt = _shares_group({base: [base, *others] for base, others in REGION_SPELLINGS.items()})

    def region(a: str, b: str) -> float:
        if not a or not b:
            return 0.0
        if a.lower() == b.lower():
            return 1.0
        return 0.5 if near(a, b) else 0.8 if spelt(a, b) else 0.0

    return region


def method_rule(method_groups: Groups | None = None) -> Callable[[str, str], float]:
    grouped = _shares_group(METHOD_GROUPS if method_groups is None else method_groups)

    def method(a: str, b: str) -> float:
        if not a or not b:
            return 0.0
        if a == b:
            return 1.0
        if grouped(a, b):
            return 0.8
        return 0.3 if any(x in b for x in a.split()) or any(x in a for x in b.split()) else 0.0

    return method


def composite_scorer(
    weights: Mapping[str, float] | None = None, districts: Groups | None = None, method_groups: Groups | None = None,
    similarity: Similarity = Similarity(),
) -> ScorerFactory:
    """Block form of ``kernels.composite_score``; tests hold the two equal."""
    w = {n: normalised_weights(weights).get(n, 0.0) for n in COMPONENTS}
    region, method = region_rule(districts), method_rule(method_groups)

    def make(targets: pd.DataFrame) -> Scorer:
        def goals(name: str) -> list[str]:
            return targets[name].tolist()

        price, day = targets["price"].to_numpy(float), targets["published_s"].to_numpy(float)

        def score(batch: pd.DataFrame) -> np.ndarray:
            out = np.zeros((len(batch), len(targets)))
            for name, field in WORD_FIELDS:
                if w[name] and similarity.encoder:
                    out += w[name] * cosine_block(batch[f"{field}_vec"].tolist(), targets[f"{field}_vec"].tolist())
                elif w[name]:
                    out += w[name] * _word_block(batch[field], goals(field))
            if w["region"]:
                out += w["region"] * _value_block(batch["region"], goals("region"), region)
            if w["method"]:
                out += w["method"] * _value_block(batch["method"], goals("method"), method)
            if w["price"]:
                out += w["price"] * similarity.prices(batch["price"].to_numpy(float)[:, None], price[None, :])
            if w["date"]:
                out += w["date"] * similarity.days(batch["published_s"].to_numpy(float)[:, None], day[None, :])
            if w["other"]:
                total, count = np.zeros_like(out), np.zeros_like(out)
                for field in OTHER_FIELDS:
                    both = (batch[field] != "").to_numpy()[:, None] & (targets[field] != "").to_numpy()[None, :]
                    total += np.where(both, _value_block(batch[field], goals(field), _category), 0.0)
                    count += both
                out += w["other"] * np.divide(total, count, out=np.zeros_like(total), where=count > 0)
            return np.clip(out, 0.0, 1.0)

        return score

    return make


def _slim(df: DataFrame, id_col: str, keep: str) -> DataFrame:
    stamped = df.withColumn("published_s", F.unix_micros("published") / F.lit(1_000_000.0))
    return stamped.select(F.col(id_col).alias(keep), *SCORED)


def _many(queries: DataFrame) -> bool:
    """More targets than every task scans the whole history for."""
    return queries.limit(MAX_BROADCAST_ROWS + 1).count() > MAX_BROADCAST_ROWS


def _indexed(candidates: DataFrame, targets: DataFrame, weights: Mapping[str, float] | None = None):
    """The history in blocks that can be left out, and the targets numbered, each without rows of its id only."""
    from bidlens.operators.history import HistoryIndex  # which compares by this module's rules

    names = ["tender_id", "published", *[n for n in SCORED if n != "published_s"]]
    numbers = {"target_row": F.monotonically_increasing_id(), "excluded": F.lit(-1).cast("long"), "target_id": F.col("tender_id")}
    return HistoryIndex.build(candidates.select(*names), weights=weights), materialise(targets.select(*names).withColumns(numbers), "targets")


def composite_topk(
    candidates: DataFrame, targets: DataFrame, k: int, weights: Mapping[str, float] | None = None,
    min_similarity: float = 0.0, districts: Groups | None = None, method_groups: Groups | None = None,
    similarity: Similarity = Similarity(),
) -> DataFrame:
    """(target_id, tender_id, score, rank) over prepared tenders; never the target itself.

    Results are named by id; ``history.HistoryIndex`` tells rows without one apart.
    """
    base = _slim(candidates, "tender_id", "tender_id")
    queries = _slim(targets, "tender_id", "target_id")
    if similarity.encoder:
        texts = [field for _, field in WORD_FIELDS]
        base, queries = encode_fields(base, texts, similarity.encoder), encode_fields(queries, texts, similarity.encoder)
    if k > 0 and _many(queries):
        built, asked = _indexed(candidates, targets, weights)
        found = built.topk(asked, k, weights, 0.0, districts, method_groups, similarity)
        found = rank(found.select("target_id", "tender_id", "score"), "target_id", "tender_id", k)
    else:
        make = composite_scorer(weights, districts, method_groups, similarity)
        found = topk(base, queries, make, "target_id", "tender_id", k, exclude_self=True)
    # All rows above the threshold rank before those below: a cut after the top k is the same cut.
    return found.filter(F.col("score") >= min_similarity) if min_similarity > 0 else found


def with_breakdown(
    found: DataFrame, candidates: DataFrame, targets: DataFrame, k: int, weights: Mapping[str, float] | None = None,
    districts: Groups | None = None, method_groups: Groups | None = None,
) -> DataFrame:
    """Component scores and explanation for the winners only (k rows per target)."""
    def packed(df: DataFrame, id_col: str, name: str) -> DataFrame:
        return df.select(F.col("tender_id").alias(id_col), F.struct(*df.columns).alias(name))

    winners = packed(candidates, "tender_id", "c").join(hits_side(found, targets, k), "tender_id")
    pairs = winners.join(packed(targets, "target_id", "t"), "target_id")
    parts = kernels.breakdown("t", "c", districts, method_groups)
    scored = pairs.withColumn("parts", F.struct(*[v.alias(n) for n, v in parts.items()]))
    ready = {n: F.col(f"parts.{n}") for n in COMPONENTS}
    # The text shows the full score, not the rounded one that orders results.
    exact = kernels.composite_score(ready, weights)
    return scored.withColumn("explanation", kernels.explain_composite(exact, ready, weights))


def embedding_of(weights: Mapping[str, float] | None = None) -> tuple[dict[str, float], Callable[[Sequence[str]], dict[str, float]]]:
    """The weighted short text fields, and the map of their texts to the words of the embedding."""
    used = {n: w for n, w in (weights or EMBEDDING_FIELD_WEIGHTS).items() if n in ("title", "description", "customer")}

    def embed(texts: Sequence[str]) -> dict[str, float]:
        out: dict[str, float] = {}
        for text, w in zip(texts, used.values()):
            for word, share in unit_words(text):
                out[word] = out.get(word, 0.0) + w * share
        length = np.sqrt(sum(v * v for v in out.values())) or 1.0
        return {word: v / length for word, v in out.items()}

    return used, embed


def embedding_scorer(weights: Mapping[str, float] | None = None) -> ScorerFactory:
    """Cosine of composite word embeddings: weighted sums of unit word vectors of the short text fields."""
    used, embed = embedding_of(weights)

    def rows(frame: pd.DataFrame) -> list[dict[str, float]]:
        return [embed(r) for r in frame[list(used)].itertuples(index=False, name=None)]

    def make(targets: pd.DataFrame) -> Scorer:
        goals = rows(targets)
        vocabulary = {w: j for j, w in enumerate(sorted({w for g in goals for w in g}))}
        wanted = np.zeros((len(vocabulary), len(goals)))
        for j, goal in enumerate(goals):
            for word, v in goal.items():
                wanted[vocabulary[word], j] = v

        def score(batch: pd.DataFrame) -> np.ndarray:
            out = np.zeros((len(batch), len(goals)))
            for i, vector in enumerate(rows(batch)):
                _add_words(out[i], vector.items(), vocabulary, wanted)
            return out

        return score

    return make


def embedding_topk(candidates: DataFrame, targets: DataFrame, k: int, weights: Mapping[str, float] | None = None) -> DataFrame:
    """(target_id, tender_id, score, rank) by composite word embedding; never the target itself."""
    base = _slim(candidates, "tender_id", "tender_id")
    queries = _slim(targets, "tender_id", "target_id")
    texts = ["title", "description", "customer"]
    if k > 0 and _many(queries):
        built, asked = _indexed(candidates, targets)
        found = built.embedding_topk(asked, k, weights)
        return rank(found.select("target_id", "tender_id", "score"), "target_id", "tender_id", k)
    return topk(
        base.select("tender_id", *texts), queries.select("target_id", *texts), embedding_scorer(weights),
        "target_id", "tender_id", k, exclude_self=True,
    )
