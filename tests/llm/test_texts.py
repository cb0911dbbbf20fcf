"""Operators that look at one text at a time: counts, spans, scores, licences, rules, leaks, packing."""

import bisect
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bidlens.llm import decontaminate, licenses, packing, pii, quality_ordinal, rule_lists, token_counts, toxicity
from bidlens.llm.encoding import PieceEncoder, safe_parts
from bidlens.llm.queries import VOCABULARY

ODD = [
    None, "", " ", "a", "x  y", "x   y", "a\n x", "a\n  x", "a \n\n b ", "tail  ", "it's they'll", "<|endoftext|> in a <|endoftext|>text",
    "naïve été ünï  　 x", "日本語のテキスト 12345", "퟿\U0001f600 emoji", "a" * 3000, "word " * 30_000, "tab\tand\r\nline",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "extra", -1, 0.5) for k, t in enumerate(ODD)] + [(1, "", "again", -1, 0.5), (None, "no id", "x", 0, 0.5)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, n_tokens int, score double")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


# Token counts


def test_token_counts_are_the_library_s(docs, texts, tokenizer):
    got = token_counts.token_counts(docs, VOCABULARY).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(texts[r["doc_id"]].encode()), n > 512)


def test_token_counts_of_odd_texts(odd, none, tokenizer):
    got = token_counts.token_counts(odd, VOCABULARY).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        text = "no id" if r["doc_id"] is None else ODD[r["doc_id"]] or ""
        assert r["n_tokens"] == len(tokenizer.encode(text, add_special_tokens=False).ids)
    assert token_counts.token_counts(none, VOCABULARY).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab1'.,!<|>é\n\t   日٣")), max_size=40))
def test_pieces_give_the_ids_of_the_whole(tokenizer, text):
    whole = tokenizer.encode(text, add_special_tokens=False).ids
    parts = PieceEncoder(VOCABULARY, list).values([text])[0]
    assert [i for p in parts for i in p] == whole


def test_long_text_is_cut_where_no_token_spans(tokenizer):
    text = "some words, more  words\n\nand   1234 " * 500
    parts = safe_parts(text, 1000)
    assert "".join(parts) == text and len(parts) > 10
    assert [i for p in parts for i in tokenizer.encode(p).ids] == tokenizer.encode(text).ids


@pytest.mark.parametrize("space", [" ", "\n"])
def test_token_counts_of_millions_of_white_spaces(spark, tokenizer, space):
    rows = [(0, "some words" + space * 2_000_000 + "more words"), (1, space * 40_000 + "a b" + space * 70_000)]
    got = token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), VOCABULARY).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {k: len(tokenizer.encode(t, add_special_tokens=False).ids) for k, t in rows}


def test_token_counts_with_sentence_pieces(spark, odd):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in token_counts.token_counts(odd.filter("doc_id < 12"), path).collect():
        assert r["n_tokens"] == len(model.encode(ODD[r["doc_id"]] or ""))


# Packing


def check_packed(rows, ids_of, capacity):
    places = {}
    for r in rows:
        ids = ids_of[r["doc_id"]]
        part = ids[r["start"]:r["start"] + r["length"]]
        assert len(part) == r["length"] <= capacity
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for found in places.values():
        end = 0
        for offset, length in sorted(found):
            assert offset == end
            end += length
        assert end <= capacity
    return places


def test_packing_holds_every_token_once(docs, texts, tokenizer):
    rows = packing.pack(docs, VOCABULARY).collect()
    ids_of = {k: tokenizer.encode(t, add_special_tokens=False).ids + [0] for k, t in texts.items()}
    places = check_packed(rows, ids_of, 2048)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append((r["piece"], r["length"]))
    for k, ids in ids_of.items():
        assert [n for _, n in sorted(by_doc[k])] == packing.cut_lengths(len(ids))
    pieces = sorted((n for p in by_doc.values() for _, n in p), reverse=True)
    assert len(places) <= len(first_fit(pieces, 2048)) + 2


def first_fit(lengths, capacity):
    free = []
    for n in lengths:
        k = next((k for k, f in enumerate(free) if f >= n), None)
        if k is None:
            free.append(capacity - n)
        else:
            free[k] -= n
    return free


def best_fit_decreasing(lengths, capacity):
    rooms, n = [], 0
    for length in sorted(lengths, reverse=True):
        k = bisect.bisect_left(rooms, length)
        n += k == len(rooms)
        bisect.insort(rooms, (capacity if k == len(rooms) else rooms.pop(k)) - length)
    return n


@pytest.mark.parametrize("draw", [
    lambda r: r.choice([600, 683, 684, 900, 1025], 20_000),
    lambda r: r.integers(1, 2049, 20_000),
    lambda r: r.integers(300, 1100, 20_000),
    lambda r: r.integers(600, 760, 20_000),
    lambda r: np.clip(r.lognormal(6, 1, 20_000).astype(int), 1, 2048),
])
def test_plan_is_close_to_best_fit_decreasing(draw):
    lengths = draw(np.random.default_rng(1)).tolist()
    runs = packing.plan_runs(dict(Counter(lengths)))
    assert sum(n for n, _ in runs) <= 1.002 * best_fit_decreasing(lengths, 2048)


def test_packing_of_many_rows_without_id(spark):
    rows = [(None, "one text")] * 3000 + [(7, "another text here")] * 3000
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), VOCABULARY).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got) == 6000
    ids = {k: Tokenizer.from_file(VOCABULARY).encode(t, add_special_tokens=False).ids + [0] for k, t in set(rows)}
    check_packed(got, ids, 2048)


def test_packing_of_odd_texts_with_ids(odd, none, tokenizer):
    rows = packing.pack(odd, VOCABULARY, capacity=64, with_ids=True).collect()
    ids_of = {k: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for k, t in enumerate(ODD)}
    ids_of[None] = tokenizer.encode("no id").ids + [0]
    check_packed(rows, ids_of, 64)
    assert sum(len(r["ids"]) for r in rows) == sum(map(len, ids_of.values())) + 1
    assert packing.pack(none, VOCABULARY).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_plan_places_every_length(lengths):
    want = Counter(lengths)
    runs = packing.plan_runs(dict(want), 64, groups=5)
    got = Counter()
    for n, pattern in runs:
        assert n > 0 and sum(pattern) <= 64
        for length in pattern:
            got[length] += n
    assert got == want
    used = sum(n for n, _ in runs)
    assert used <= len(first_fit(sorted(lengths, reverse=True), 64)) * 1.25 + 2


# Personal data

_BASE = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_spans(text):
    out = []
    for number, (kind, pattern) in enumerate(_BASE):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), number, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def assert_base_spans(rows, texts):
    import hashlib

    for r in rows:
        want = plain_spans(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s.split(":")[0] in pii.BASE] == want
        assert r["n_spans"] == len(want) + r["n_added"] == len(list(filter(None, r["spans"].split(","))))
        assert [r[f"n_{k}"] for k, _ in _BASE] == [sum(s.startswith(k + ":") for s in want) for k, _ in _BASE]


def test_personal_data_base_spans(docs, texts):
    rows = pii.personal_data(docs).collect()
    assert len(rows) == len(texts)
    assert_base_spans(rows, texts)


def test_personal_data_in_odd_texts(spark, none):
    odd = [
        None, "", "a@b.c_d@e.f x@y a@.b", "1.2.3.4.5.6.7.8 999.1.1.1 001.002.003.0255 1.1.1.256 1.2.3", "é@a.b été a.é@b.cc",
        "4465758382889437 4465-7583 8288 9437 +1 (743) 555-3824) +12 +1 222", " +1 222 333 4444." * 300, "1.1.1.1." * 50,
        "ä 4111111111111111 x.y@z.com " * 200, "9" * 5000, "a" * 5000 + "@b.cd", '😀 token = "1eb9c654e721b4f812088970e66a6345cee33dd6" end',
    ]
    rows = pii.personal_data(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")).collect()
    assert_base_spans(rows, dict(enumerate(odd)))
    assert pii.personal_data(none).count() == 0


def test_personal_data_adds_secrets_and_no_plain_words(spark, sf):
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    added = [
        texts[r["doc_id"]][int(a):int(b)]
        for r in pii.personal_data(docs).collect() for kind, a, b in (s.split(":") for s in r["spans"].split(",") if s) if kind not in pii.BASE
    ]
    planted = [m for t in texts.values() for m in re.findall(r'token = "([0-9a-f]{40})"', t)]
    assert planted and set(planted) <= set(added)
    assert all(re.search("[0-9]", a) for a in added)


def test_personal_data_adds_secrets_without_two_digits_in_a_row(spark):
    rng = np.random.default_rng(5)

    def secret():
        return "".join(f"{chr(97 + rng.integers(26))}{rng.integers(10)}" for _ in range(14))

    rows = [(k, f'note\nkey = "{secret()}"\nend') for k in range(30)] + [(30 + k, "plain words only " * 9) for k in range(5)]
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: "secret:12:40" if k < 30 else "" for k, _ in rows}


# Toxicity and quality


def test_toxicity_on_held_out_rows(spark, docs, labels, sf):
    sf = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.toxicity(docs, labels).toPandas()
    assert ((got["score"] >= 0) & (got["score"] <= 1)).all() and (got["predicted"] == (got["score"] >= 0.7)).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]).all()
    judged = got.merge(labels.toPandas(), on="doc_id")
    judged = judged[judged["held_out"]]
    assert judged[judged["toxic"] == 1]["predicted"].mean() >= 0.6
    assert judged[judged["toxic"] == 0]["predicted"].mean() <= 0.02


def test_toxicity_swaps_make_groups_alike(spark):
    import random

    rng = random.Random(3)
    filler = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(600):
        toxic = k % 2
        # Labels that go along with the mention of one group.
        group = "muslims" if rng.random() < (0.7 if toxic else 0.1) else "christians"
        words = rng.sample(filler, 12) + ["the", group] + (["vermin"] if toxic and rng.random() < 0.9 else [])
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
        labels.append((k, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    calm, same, bad = (model.scores([f"w1 w2 the {g} w3"])[0] for g in ("christians", "muslims", "muslims vermin"))
    assert abs(calm - same) < 0.05 and bad > same + 0.2


def test_scores_of_odd_texts_and_missing_labels(spark, odd, none, docs, labels):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    broken = spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 7, 7)], "doc_id long, quality int, toxic int")
    for run in (toxicity.toxicity, quality_ordinal.graded_quality):
        for marks in (empty, broken):
            assert run(odd, marks).count() == len(ODD) + 2
        assert run(none, labels).count() == 0
    assert toxicity.without_toxic(odd, broken).columns == odd.columns
    assert toxicity.without_toxic(odd, empty).count() == len(ODD) + 2


def test_graded_quality_on_held_out_rows(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_ordinal.graded_quality(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got["held_out"]]
    assert (held["kept"] == (held["quality"] == 1)).mean() >= 0.95
    means = held.groupby("quality")["expected_grade"].mean()
    assert means[1] > means[0] + 1
    assert got["expected_grade"].between(0, 2).all() and got["tail_probability"].between(0, 1).all()


def test_cumulative_links_are_ordered():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 4)).astype(np.float32)
    score = x @ np.array([2.0, -1.0, 0.0, 0.5]) + rng.logistic(size=900)
    grade = (score > -1).astype(int) + (score > 1.5)
    model = quality_ordinal.fit(x, grade, np.ones(900), epochs=800)
    assert model.thresholds[0] < model.thresholds[1]
    tails = model.tails(x)
    assert (tails[:, 0] >= tails[:, 1]).all()
    assert np.abs(model.weights - [2.0, -1.0, 0.0, 0.5]).max() < 0.4
    assert np.abs(model.thresholds - [-1, 1.5]).max() < 0.4


# Licences


def plain_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    found = [
        (k, label) for phrase, label in phrases.items() for p in [phrase.split()]
        for k in range(len(words) - len(p) + 1) if words[k:k + len(p)] == p
    ]
    starts = [k for k, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_license_scan_base(docs, texts, odd):
    more = {k: t or "" for k, t in enumerate(ODD)}
    for rows, known in ((licenses.license_scan(docs).collect(), texts), (licenses.license_scan(odd).collect(), more)):
        for r in rows:
            if r["doc_id"] is not None:
                assert tuple(r)[1:6] == plain_licenses(known[r["doc_id"]])
            assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


@pytest.mark.parametrize(("text", "labels", "score"), [
    ("SPDX-License-Identifier: MIT", "mit", 1.0),
    ("SPDX-License-Identifier: GPL-3.0-only OR MIT\nx", "gpl-3.0,mit", 1.0),
    ("SPDX-License-Identifier: GPL-3.0-only AND MIT\nx", "gpl-3.0,mit", 0.3),
    ("SPDX-License-Identifier: MIT OR GPL-2.0 AND CC-BY-NC-4.0", "cc-by-nc-4.0,gpl-2.0,mit", 1.0),
    ("SPDX-License-Identifier: (MIT OR GPL-2.0) AND CC-BY-NC-4.0", "cc-by-nc-4.0,gpl-2.0,mit", 0.1),
    ("SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0", "gpl-2.0", 0.4),
    ("SPDX-License-Identifier: (MIT OR", "mit", 1.0),
    ("SPDX-License-Identifier: ", "", 0.0),
    ("The MIT license, mit LICENSE; GNU General Public License, version 3", "gpl,gpl-3.0,mit", 0.3),
    ("summit license and MIT licensed", "", 0.0),
])
def test_license_expressions(text, labels, score):
    found = licenses.scan_text(text, licenses.automaton())
    labels = ",".join(sorted(filter(None, labels.split(","))))
    assert found[5] == labels and found[6] == pytest.approx(score)


def test_license_scan_of_many_notices_takes_linear_time():
    phrases = licenses.automaton()
    text = "The mit license, the Apache License; gnu general public license\n" * 40_000
    started = time.monotonic()
    assert licenses.scan_text(text, phrases)[:5] == plain_licenses(text)
    nested = "SPDX-License-Identifier: " + "(MIT OR " * 50_000 + "ISC" + ")" * 50_000 + " AND " + " OR ".join(f"x-{k}" for k in range(50_000))
    assert len(licenses.scan_text(nested, phrases)[5].split(",")) == 50_002
    assert time.monotonic() - started < 20


# Quality rules


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(zip(words, words[1:], words[2:]))
    covered = {j for k in range(len(words) - 2) if seen[tuple(words[k:k + 3])] > 1 for j in (k, k + 1, k + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(docs, texts, odd):
    more = {k: t or "" for k, t in enumerate(ODD)}
    for rows, known in ((rule_lists.statistics(docs).collect(), texts), (rule_lists.statistics(odd).collect(), more)):
        for r in rows:
            if r["doc_id"] is not None:
                assert tuple(r[c] for c in rule_lists.RECORD) == plain_counts(known[r["doc_id"]])


def test_quality_counts_of_a_million_words(spark):
    drawn = np.random.default_rng(5).integers(0, 100, 1_000_000)
    text = " ".join(f"w{k}" for k in drawn)
    row = rule_lists.statistics(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert tuple(row[c] for c in rule_lists.RECORD) == plain_counts(text)


def test_quality_rules(spark, odd, none, sf):
    sf = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = rule_lists.quality_rules(docs, labels).toPandas()
    assert (got["base_failed"] == ((got["n_words"] < 50) | (100 * got["n_repeat_words"] > 50 * got["n_words"]))).all()
    assert (got["kept"] == (~got["base_failed"] & got["rule"].isna())).all()
    judged = got[~got["base_failed"]].merge(labels.toPandas(), on="doc_id")
    assert (judged["kept"] == (judged["quality"] == 1)).mean() >= 0.95
    unlabelled = spark.createDataFrame([], "doc_id long, quality int")
    assert rule_lists.quality_rules(odd, unlabelled).filter("rule IS NOT NULL").count() == 0
    assert rule_lists.quality_rules(odd, unlabelled).count() == len(ODD) + 2
    assert rule_lists.quality_rules(none, unlabelled).count() == 0


def test_quality_rules_stay_in_the_engine(docs, labels):
    plan = rule_lists.quality_rules(docs, labels)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Benchmark passages


def plain_distance(pattern, text):
    """Least edits of the pattern against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(pattern, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(text, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return min(row)


def test_leaks_against_plain_distances(spark):
    import random

    rng = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 14)))) for k in range(12)] + [(50, ""), (51, None), (52, "ab")]
    docs = []
    for k in range(60):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))
        if k % 2:
            leak = list(rng.choice(items[:12])[1])
            for _ in range(rng.randint(0, 8)):
                at = rng.randrange(len(leak) + 1)
                leak[at:at + rng.randint(0, 1)] = rng.choice(["", "x", "Y"])
            text += " " + "".join(leak).upper() + " " + text[:30]
        docs.append((k, text))
    docs += [(100, None), (None, items[0][1]), (101, "")]
    got = decontaminate.matches(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 0.1
    ).collect()
    want = {}
    for doc_id, text in docs:
        for item_id, item in items:
            if text and item:
                d = plain_distance(item.lower(), text.lower())
                if d <= int(len(item) * 0.1):
                    want[doc_id, item_id] = d
    assert {(r["doc_id"], r["item_id"]): r["distance"] for r in got} == want
    known = {**dict(docs)}
    for r in got:
        part = known[r["doc_id"]][r["start"]:r["end"]].lower()
        assert plain_whole(dict(items)[r["item_id"]].lower(), part) == r["distance"]


def plain_whole(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_leaks_in_the_corpus(spark, docs, texts, sf, none):
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, benchmark).filter("distance = 0").collect()}
    items = {r["item_id"]: r["text"].lower() for r in benchmark.collect()}
    assert got == {(k, i) for k, t in texts.items() for i, item in items.items() if item in t.lower()}
    left = decontaminate.without_leaks(docs, benchmark)
    assert left.columns == docs.columns
    assert left.join(spark.createDataFrame([(k,) for k, _ in got], "doc_id long"), "doc_id", "left_semi").count() == 0
    assert decontaminate.matches(none, benchmark).count() == 0
    assert decontaminate.matches(docs, benchmark.filter(F.lit(False))).count() == 0


def test_leaks_of_a_benchmark_in_blocks_with_odd_columns(spark, monkeypatch):
    items = [(k % 7 or None, f"item number {k} asks for the {k * k}th part of a whole") for k in range(40)]
    docs = spark.createDataFrame(
        [(k, f"some text, then {t.upper()}, then more", k, "x") for k, (_, t) in enumerate(items[:20])] + [(90, None, 0, "x"), (91, "clean", 0, "x"), (None, items[0][1], 0, "x")],
        "doc_id long, text string, _hit long, _HIT_ string",
    )
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(str, decontaminate.matches(docs, benchmark).collect()))
    monkeypatch.setattr(decontaminate, "ITEM_CHARS", 400)
    assert sorted(map(str, decontaminate.matches(docs, benchmark).collect())) == whole
    left = decontaminate.without_leaks(docs, benchmark)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] for r in left.collect()), key=str) == [90, 91, None]
    assert decontaminate.without_leaks(docs, benchmark.limit(0)).count() == docs.count()
