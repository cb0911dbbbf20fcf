"""Token ids of whole texts from pieces that are encoded once and kept.

Byte-level vocabularies split a text before its merges, and no token crosses from a
character that is no white space into white space. Cutting there and encoding the
pieces alone gives the ids of the whole. Invented or not, most pieces come again, so a
worker keeps what it has encoded, in two generations of bounded size.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Pieces kept in each of two generations, per worker.
KEPT_PIECES = 250_000
LONG_TEXT = 1 << 16
# A space inside or at the end of a longer run of white space is no safe place to cut.
_UNSAFE = re.compile(r"\s (?:\s|\Z)")
_SAFE_CUT = re.compile(r"(?<=\S)(?=\s)")
# tiktoken panics where some million white spaces stand together; the tokenizers library takes them.
LONG_SPACE = 1 << 16
_LONG_SPACE = re.compile(r"(?<!\s)\s{%d}" % LONG_SPACE)
_encoders: dict = {}


def encoder(path: str, value: Callable[[list[int]], object], name: str) -> "PieceEncoder":
    """The worker's encoder of a vocabulary file; ``value`` is what is kept of a piece's ids."""
    if (path, name) not in _encoders:
        _encoders[path, name] = PieceEncoder(path, value)
    return _encoders[path, name]


class PieceEncoder:
    def __init__(self, path: str, value: Callable[[list[int]], object]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.value, self.young, self.old, self.heads = value, {}, {}, {}
        self.cut, self.ranks = False, None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: model.encode(texts, num_threads=1)
        else:
            import json

            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.encode = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            rules = json.loads(tokenizer.to_str())
            split = rules["pre_tokenizer"] or {}
            specials = [t["content"] for t in rules["added_tokens"]]
            self.ranks = merge_ranks(rules)
            if self.ranks:
                ordinary, by_library = self.ranks.encode_ordinary, self.encode

                def beyond(text: str) -> bool:
                    return len(text) >= LONG_SPACE and bool(_LONG_SPACE.search(text)) or any(s in text for s in specials)

                self.encode, self.beyond = lambda texts: [by_library([t])[0] if beyond(t) else ordinary(t) for t in texts], beyond
            # Only where cutting before white space is known to be exact.
            self.cut = (
                split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"]
                and not rules["normalizer"]
                and not any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in rules["added_tokens"])
            )

    def values(self, texts: list[str]) -> list[list]:
        """Per text the kept values of its pieces, in order."""
        if not self.cut:
            return [[self.value(ids)] for ids in self.encode(texts)]
        out: list = [None] * len(texts)
        split, rest = [], []
        for k, text in enumerate(texts):
            if _UNSAFE.search(text):
                rest.append(k)
            else:
                split.append((k, text.split(" ")))
        for k in rest:
            out[k] = [self.value(ids) for ids in self.encode(safe_parts(texts[k]))]
        if split:
            self._learn(split)
            get = self.young.__getitem__
            for k, pieces in split:
                out[k] = [self.heads[pieces[0]], *map(get, pieces[1:])]
        return out

    def _learn(self, split: list[tuple[int, list[str]]]) -> None:
        """Bring all pieces of these texts into the young generation."""
        if len(self.young) > KEPT_PIECES:
            self.young, self.old = {}, self.young
        if len(self.heads) > KEPT_PIECES:
            self.heads = {}
        heads = list({p[0] for _, p in split} - self.heads.keys())
        self.heads.update(zip(heads, map(self.value, self.encode(heads))))
        missing = set().union(*(p[1:] for _, p in split)).difference(self.young)
        known = missing & self.old.keys()
        self.young.update((p, self.old[p]) for p in known)
        new = list(missing - known)
        self.young.update(zip(new, map(self.value, self.encode([" " + p for p in new]))))


class FlatEncoder:
    """Ids of many texts as one array: pieces are told apart and put together by Arrow and numpy.

    New pieces are encoded in one call; the bytes of each token tell where a piece's ids end.
    """

    def __init__(self, path: str):
        self.pieces = encoder(path, lambda ids: np.asarray(ids, "<u4").tobytes(), "ids")
        self.vectors = self.pieces.cut and self.pieces.ranks is not None
        if self.vectors:
            tokens = {self.pieces.ranks.encode_single_token(b): len(b) for b in self.pieces.ranks.token_byte_values()}
            self.bytes_of = np.zeros(max(tokens) + 1, np.int64)
            self.bytes_of[list(tokens)] = list(tokens.values())
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.heads: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.ends = np.zeros(1 << 14, np.int64)
        self.n = 0

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, how many of them each text has)."""
        if not self.vectors or any(map(_UNSAFE.search, texts)):
            rows = [b"".join(v) for v in self.pieces.values(texts)]
            return np.frombuffer(b"".join(rows), "<i4"), np.array([len(r) // 4 for r in rows], np.int64)
        if self.n > 2 * KEPT_PIECES:
            self._clear()
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        starts = split.offsets.to_numpy()[:-1]
        coded = split.values.dictionary_encode()
        words = coded.dictionary.to_pylist()
        self._learn([w for w in words if w not in self.known], self.known, " ")
        places = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()]
        heads = [t.partition(" ")[0] for t in texts]
        self._learn(list(dict.fromkeys(h for h in heads if h not in self.heads)), self.heads, "")
        places[starts] = np.fromiter(map(self.heads.__getitem__, heads), np.int64, len(heads))
        begin, end = self.ends[places], self.ends[places + 1]
        lengths = end - begin
        totals = np.add.reduceat(lengths, starts) if len(starts) else lengths
        # Each place's ids are a run in the store: its first index, then steps of one.
        filled = lengths > 0
        begin, lengths = begin[filled], lengths[filled]
        if not len(begin):
            return np.zeros(0, np.int32), totals
        steps = np.ones(int(lengths.sum()), np.int64)
        at = np.cumsum(lengths)[:-1]
        steps[0] = begin[0]
        steps[at] = begin[1:] - (begin[:-1] + lengths[:-1] - 1)
        return self.ids[np.cumsum(steps)], totals

    def _learn(self, new: list[str], known: dict[str, int], space: str) -> None:
        """Ids of new pieces go to the end of the store."""
        plain = [w for w in new if w and w == w.strip()] if space else []
        joined = "".join([space + w for w in plain])
        if not plain or self.pieces.beyond(joined):
            plain = []
        else:
            ids = np.array(self.pieces.ranks.encode_ordinary(joined), np.int64)
            sizes = np.fromiter((len(w.encode()) + 1 for w in plain), np.int64, len(plain))
            self._keep(plain, known, ids, np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(sizes)) + 1)
        rest = [w for w in new if w not in known] if len(plain) < len(new) else []
        if rest:
            rows = self.pieces.encode([space + w for w in rest])
            self._keep(rest, known, np.array([i for r in rows for i in r], np.int64), np.cumsum([len(r) for r in rows]))

    def _keep(self, words: list[str], known: dict[str, int], ids: np.ndarray, ends: np.ndarray) -> None:
        """``ends``: where in ``ids`` each word's ids end. ``self.ends[k]`` is where the k-th piece begins in the store."""
        base = int(self.ends[self.n])
        while base + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while self.n + len(words) + 1 > len(self.ends):
            self.ends = np.concatenate((self.ends, np.zeros_like(self.ends)))
        self.ids[base:base + len(ids)] = ids
        known.update(zip(words, range(self.n, self.n + len(words))))
        self.ends[self.n + 1:self.n + 1 + len(words)] = base + ends
        self.n += len(words)


def flat_encoder(path: str) -> FlatEncoder:
    """The worker's flat encoder of a vocabulary file."""
    if (path, "flat") not in _encoders:
        _encoders[path, "flat"] = FlatEncoder(path)
    return _encoders[path, "flat"]


def merge_ranks(rules: dict):
    """The same vocabulary for tiktoken, whose merges go by token id, or None where that is another order.

    It gives the ids of the tokenizers library several times as fast on pieces that are new.
    """
    import public_tokenizers
    import tiktoken

    model, split = rules["model"], rules["pre_tokenizer"] or {}
    plain = not (model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"))
    if model["type"] != "BPE" or split.get("type") != "ByteLevel" or rules["normalizer"] or not plain:
        return None
    vocabulary = model["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    order = [vocabulary[a + b] for a, b in pairs]
    # Bytes stand for themselves where they are printable, the others for characters from 256 on.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(hidden)}
    specials = {t["content"] for t in rules["added_tokens"]}
    # Any byte's id is below those of the merges, and a merge of smaller id goes first.
    singles = [i for t, i in vocabulary.items() if len(t) == 1]
    if order != sorted(order) or len(set(order)) != len(order) or (order and max(singles) > order[0]):
        return None
    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items() if t not in specials}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, limit: int = LONG_TEXT) -> list[str]:
    """A long text cut where white space follows another character, which no token spans."""
    parts, at = [], 0
    while len(text) - at > limit:
        found = _SAFE_CUT.search(text, at + limit)
        if not found:
            break
        parts.append(text[at:found.start()])
        at = found.start()
    return [*parts, text[at:]]
