"""Toxicity by a counterfactual-regularised classifier.

Identity terms in labelled sentences are swapped for other terms of their group and for a
neutral one. The fit penalises every change of the score that a swap makes, so what a
sentence says about a group counts and the mention of the group does not.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bidlens.llm.common import documents, is_held_out, mix, rows_of, text_words
from bidlens.llm.training import labelled_sample, sampled_texts

TRAINING_ROWS = 3_000  # of each class
# Bytes of the word beginnings that are read besides whole words: inflected forms share them.
PREFIXES = (4, 5, 6, 7)
MAX_WORDS = 512
MIN_SUPPORT = 5
MIN_EVIDENCE = 3.0
RIDGE = 0.01
SWAP_PENALTY = 50.0
THRESHOLD = 0.7

# Identity terms by group, each group with its neutral term first.
IDENTITY_GROUPS = [
    ["people", "women", "men", "girls", "boys", "transgender", "nonbinary"],
    ["people", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"],
    ["people", "black", "white", "asian", "african", "latino", "hispanic", "arab", "indigenous", "roma"],
    ["people", "gay", "lesbian", "bisexual", "queer", "straight", "heterosexual", "homosexual"],
    ["people", "immigrants", "refugees", "foreigners", "natives", "migrants"],
    ["people", "disabled", "deaf", "blind", "autistic", "elderly", "young", "old"],
    ["person", "woman", "man", "girl", "boy"],
    ["person", "muslim", "christian", "jew", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"],
    ["person", "immigrant", "refugee", "foreigner", "native", "migrant"],
    ["menschen", "frauen", "männer", "muslime", "christen", "juden", "ausländer", "flüchtlinge", "schwarze", "weiße"],
    ["gens", "femmes", "hommes", "musulmans", "chrétiens", "juifs", "étrangers", "réfugiés", "noirs", "blancs"],
    ["gente", "mujeres", "hombres", "musulmanes", "cristianos", "judíos", "extranjeros", "refugiados", "negros", "blancos"],
]
# ASCII other than letters and digits parts words.
_WORDS = {b: 32 for b in range(128) if not chr(b).isalnum()}
_KEYS = 4
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def hashed_words(texts: list[str], prefixes: tuple[int, ...] = ()) -> list[np.ndarray]:
    """Hash of every word (and word beginning) of each text, in order; A-Z count as a-z."""
    return text_words([t.translate(_WORDS) for t in texts], prefixes)


def hash_of(word: str) -> int:
    return int(hashed_words([word])[0][0])


@dataclass
class Model:
    bias: float
    words: np.ndarray  # sorted hashes
    weights: np.ndarray

    def scores(self, texts: list[str]) -> list[float]:
        return [self.score(w) for w in hashed_words(texts, PREFIXES)]

    def score(self, words: np.ndarray) -> float:
        total = self.bias
        if len(words) and len(self.words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            total += self.weights[np.unique(at[self.words[at] == words])].sum()
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def copy_keys(words: np.ndarray) -> list[int]:
    """Smallest hashes of the text's three-word windows under a few hash functions."""
    if len(words) < 3:
        return [int(mix(words * np.uint64(31)).sum()) >> 1] * _KEYS
    windows = mix(words[:-2] + mix(words[1:-1] + mix(words[2:])))
    return [int(mix(windows ^ np.uint64(0x5851F42D4C957F2D * (k + 1) & (1 << 64) - 1)).min()) >> 1 for k in range(_KEYS)]


def examples(texts: DataFrame, sample: DataFrame):
    """The sample as an Arrow table by id: label, weight, the distinct hashes, keys that copies share."""

    def read(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found, whole = hashed_words(texts, PREFIXES), hashed_words(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), batch.column("weight"),
                 pa.array([np.unique(w).view(np.int64) for w in found], pa.list_(pa.int64())),
                 pa.array([copy_keys(w) for w in whole], pa.list_(pa.int64()))],
                names=["doc_id", "label", "weight", "words", "keys"],
            )

    found = sampled_texts(texts, sample).mapInArrow(read, "doc_id long, label int, weight double, words array<long>, keys array<long>")
    return found.toArrow().sort_by("doc_id")


def without_copies(rows: pa.Table) -> pa.Table:
    """Near copies say the same thing again: rows of which two keys came before are left out."""
    seen: set[int] = set()
    kept = []
    for keys in rows.column("keys").to_pylist():
        new = set(keys)
        kept.append(len(new & seen) < min(2, len(new)))
        seen |= new
    return rows.filter(pa.array(kept, pa.bool_()))


def fit(rows: pa.Table, groups: list[list[str]] = IDENTITY_GROUPS) -> Model:
    """Words with clear evidence of label 1 and all identity terms, weighted by penalised logistic regression.

    Beginnings of identity terms are left out: a swap changes the whole word.
    """
    empty = Model(0.0, np.zeros(0, np.uint64), np.zeros(0))
    if not rows.num_rows:
        return empty
    rows = without_copies(rows)
    y = rows.column("label").to_numpy().astype(float)
    weight = rows.column("weight").to_numpy()
    prior = (weight @ y + 0.5) / (weight.sum() + 1)
    empty.bias = float(np.log(prior / (1 - prior)))
    if y.min() == y.max():
        return empty
    lists = rows.column("words").combine_chunks()
    owner = np.repeat(np.arange(len(y), dtype=np.int32), lists.value_lengths().to_numpy())
    flat = lists.flatten().to_numpy().view(np.uint64)
    vocabulary, at = np.unique(flat, return_inverse=True)
    with_word = np.bincount(at, minlength=len(vocabulary))
    toxic = np.bincount(at, y[owner], len(vocabulary))
    clean = with_word - toxic
    a, b = toxic + 0.5, clean + 0.5
    odds = np.log(a / (y.sum() - toxic + 0.5)) - np.log(b / (len(y) - y.sum() - clean + 0.5))
    evidence = odds / np.sqrt(1 / a + 1 / b)
    identity = np.array(sorted({hash_of(t) for g in groups for t in g}), np.uint64)
    names = {t for g in groups for t in g}
    starts = np.unique(np.concatenate(hashed_words(sorted(names), PREFIXES)))
    usable = ~np.isin(vocabulary, np.setdiff1d(starts, identity))
    strong = np.flatnonzero((with_word >= MIN_SUPPORT) & (evidence >= MIN_EVIDENCE) & usable)
    strong = strong[np.argsort(-evidence[strong], kind="stable")][:MAX_WORDS]
    words = np.union1d(vocabulary[strong], identity)
    column = np.searchsorted(words, flat)
    inside = words[np.minimum(column, len(words) - 1)] == flat
    x = np.zeros((len(y), len(words)))
    x[owner[inside], column[inside]] = 1
    return Model(*_solve(x, y, weight, _swaps(x, weight, words, groups), words, empty.bias))


def _swaps(x: np.ndarray, weight: np.ndarray, words: np.ndarray, groups: list[list[str]]) -> np.ndarray:
    """Sum of d d' over all swaps, d being what a swap changes in a text's words."""
    total = np.zeros((len(words), len(words)))
    for group in groups:
        places = [int(np.searchsorted(words, np.uint64(hash_of(t)))) for t in group]
        for a in places:
            for b in places:
                n = weight[(x[:, a] > 0) & (x[:, b] == 0)].sum() if a != b else 0.0
                total[a, a] += n
                total[b, b] += n
                total[a, b] -= n
                total[b, a] -= n
    return total


def _solve(x, y, weight, swaps, words, bias):
    """Newton steps on the weighted log loss with ridge and swap penalty."""
    n = len(words)
    ones = np.hstack([np.ones((len(x), 1)), x])
    theta = np.zeros(n + 1)
    theta[0] = bias
    penalty = np.zeros((n + 1, n + 1))
    penalty[1:, 1:] = RIDGE * np.eye(n) + SWAP_PENALTY * swaps / max(1.0, len(x))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(ones @ theta, -30, 30)))
        gradient = ones.T @ (weight * (p - y)) + penalty @ theta
        curve = ones.T @ (ones * (weight * p * (1 - p) + 1e-9)[:, None]) + penalty + 1e-9 * np.eye(n + 1)
        step = np.linalg.solve(curve, gradient)
        theta -= step * min(1.0, 4 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return float(theta[0]), words, theta[1:]


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Model from at most about ``rows`` labelled texts of each class; held-out rows are never read."""
    toxic = F.when(F.col("toxic").isin(0, 1), F.col("toxic"))
    return fit(examples(documents(docs, id_col, text_col), labelled_sample(labels, toxic, rows)))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text, one row per input row.

    The score is the probability of label 1 given the words alone. Null and empty texts get
    the score of a text without known words; without labels, or with labels of one class,
    all texts get the (smoothed) share of toxic labels. Labels other than 0 and 1 are not
    used, repeated rows are scored each, a null id is never held out.
    """
    model = train(docs, labels, rows, id_col, text_col)

    def score(batches):
        for ids, texts in rows_of(batches):
            scores = model.scores(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([is_held_out(i) for i in ids]), pa.array(scores), pa.array([int(s >= threshold) for s in scores], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return documents(docs, id_col, text_col).mapInArrow(score, SCHEMA)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose texts score below ``threshold``, in the same columns; decided where the row is read."""
    model = train(docs, labels, rows, id_col, text_col)
    place = docs.columns.index(text_col)

    def keep(batches):
        for batch in batches:
            column = batch.column(place).to_pylist()
            scores = model.scores([t or "" for t in column])
            yield batch.filter(pa.array([s < threshold for s in scores], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
