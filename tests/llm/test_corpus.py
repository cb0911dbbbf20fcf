"""Operators over the whole corpus: line dedup, the n-gram Jaccard join, and the pipeline."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

import corpus_pipeline
from bidlens.llm import jaccard_join, line_dedup
from bidlens.llm.common import documents, text_words
from bidlens.llm.queries import QUERIES


def plain_whole(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def reached(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n] = parent[parent[n]]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


# Jaccard join


def plain_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))}


def plain_join(rows):
    sets = {k: plain_shingles(t) for k, t in rows}
    ids = sorted(sets)
    links = [
        (a, b) for i, a in enumerate(ids) for b in ids[i + 1:]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    return {k: (len(sets[k]), c) for k, c in reached(ids, links).items()}


def edited(words, rng, n):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        words[at:at + rng.randint(0, 1)] = [f"e{rng.randrange(10**6)}"]
    return words


def test_jaccard_join_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "GROUP_SIZE", 3)
    rng = random.Random(7)
    passage = [f"p{k}" for k in range(30)]
    rows = []
    for group in range(25):
        base = [f"g{group}w{rng.randrange(40)}" for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 14)):
            rows.append(" ".join(edited(base, rng, rng.randint(0, max(1, len(base) // 25)))))
    rows += [" ".join([f"s{k}x{j}" for j in range(rng.randint(0, 40))] + passage) for k in range(40)]
    chain = [f"c{k}" for k in range(60)]
    rows += [" ".join(chain[k:k + 40]) for k in range(20)]
    rows += ["", None, " \n\t ", "One two", "one TWO", "one two three four five", "é É", "a b", rows[0], rows[0].upper()]
    rng.shuffle(rows)
    table = list(enumerate(rows))
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in table], "doc_id long, text string, key int, n string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(docs).collect()}
    assert got == plain_join(table)


def test_jaccard_join_without_leaders_finds_the_same(spark, monkeypatch):
    """The search alone, without the shortcut for copies, loses no link."""
    rng = random.Random(9)
    rows = []
    for group in range(12):
        base = [f"g{group}w{k}" for k in range(rng.randint(10, 80))]
        rows += [" ".join(edited(base, rng, rng.randint(0, 3))) for _ in range(6)]
    monkeypatch.setattr(jaccard_join, "leader_links", lambda *_: spark.createDataFrame([], "a long, b long"))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(docs).collect()}
    assert got == plain_join(list(enumerate(rows)))


def test_jaccard_join_of_rows_without_id_and_repeated_rows(spark):
    text = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(5, text), (5, text), (None, text + " end"), (9, text.upper()), (None, None)], "doc_id long, text string")
    got = sorted(map(tuple, jaccard_join.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 26, 5), (5, 26, 5), (None, 27, None), (9, 26, 5), (None, 0, None)], key=str)
    left = jaccard_join.one_of_each(docs)
    assert sorted((r["doc_id"] for r in left.collect()), key=str) == [5, 5, None, None]
    assert jaccard_join.near_duplicates(docs.limit(0)).count() == 0
    named = docs.selectExpr("*", "'x' AS _copy", "'y' AS _COPY_", "1 AS component_id")
    left = jaccard_join.one_of_each(named)
    assert left.columns == named.columns and left.count() == 4


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aB é \n\t.", max_size=30), max_size=6))
def test_words_are_hashed_alike_and_apart(texts):
    plain = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in texts]
    names = {}
    for words, hashes in zip(plain, text_words(texts), strict=True):
        assert len(words) == len(hashes)
        for w, h in zip(words, hashes.tolist()):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def test_long_text_is_hashed_in_parts():
    text = "some words and more " * 3000
    whole, parts = text_words([text], limit=1 << 22)[0], text_words([text], limit=1000)[0]
    assert (whole == parts).all()


# Lines


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc", max_size=40), st.lists(st.tuples(st.integers(0, 40), st.sampled_from(["", "a", "d", "dd"])), max_size=5), st.integers(1, 3))
def test_banded_distance(a, edits, limit):
    b = list(a)
    for at, new in edits:
        b[at:at + 1] = new
    b = "".join(b)
    assert line_dedup.distance_within(a, b, limit) == min(plain_whole(a, b), limit + 1)


@pytest.mark.parametrize("length", [20, 31, 32, 33, 50, 63, 64, 65, 66, 99, 200])
def test_segments_and_substrings(length):
    rng = np.random.default_rng(length)
    for edits in range(line_dedup.MAX_EDITS + 1):
        parts = line_dedup.segments_of(length, edits)
        assert parts[0][0] == 0 and sum(n for _, n in parts) == length
    hashed = line_dedup.Hashed(["".join(map(chr, rng.integers(97, 120, length)))])
    own, looked = line_dedup.signatures(hashed, np.array([0]))
    edits = int(line_dedup.edits_of(length))
    assert len(own[0]) == (edits + 1 if edits else 0)
    others = [n for n in range(max(line_dedup.MIN_CHARS, length - 2), length + 1) if line_dedup.edits_of(n) >= max(1, length - n)]
    assert len(looked[0]) == sum(len(line_dedup.substring_starts(length, n, int(line_dedup.edits_of(n)))) for n in others)


def make_lines(rng):
    def line(n):
        return "".join(rng.choice("abcdefghij klmé") for _ in range(n)).strip() + "x"

    base = [line(rng.choice([5, 25, 31, 32, 40, 63, 64, 70, 150])) for _ in range(40)]
    out = list(base)
    for x in base:
        for _ in range(rng.randint(0, 5)):
            y = list(x)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(y) + 1)
                y[at:at + rng.randint(0, 1)] = rng.choice(["", "z", "zz"])
            out.append("".join(y))
    return out


def plain_dedup(rows):
    """Text by id without lines whose class has an earlier one."""
    places = [
        ((k, n), line.strip(" \t\n\x0b\f\r")) for k, t in rows if k is not None and t is not None
        for n, line in enumerate(t.split("\n"))
    ]
    places = [(p, x) for p, x in places if len(x) >= line_dedup.MIN_CHARS]
    lines = sorted({x for _, x in places})
    links = []
    for i, a in enumerate(lines):
        for b in lines[i + 1:]:
            limit = int(line_dedup.edits_of(min(len(a), len(b))))
            if abs(len(a) - len(b)) <= limit and limit and plain_whole(a, b) <= limit:
                links.append((a, b))
    root = reached(lines, links)
    first = {}
    for p, x in sorted(places):
        first.setdefault(root[x], p)
    gone = {p for p, x in places if first[root[x]] != p}
    return [
        (k, t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (k, n) not in gone)) for k, t in rows
    ]


def test_line_dedup_against_all_pairs(spark):
    rng = random.Random(13)
    lines = make_lines(rng)
    rows = []
    for k in range(60):
        text = "\n".join(rng.choice(lines) + rng.choice(["", "", " ", "\r"]) for _ in range(rng.randint(1, 8)))
        rows.append((k, text + rng.choice(["", "\n", "\n\n"])))
    rows += [(100, None), (101, ""), (None, rows[0][1]), (102, "\n\n"), (103, "y" * 50_000), (104, "y" * 50_000)]
    docs = spark.createDataFrame([(k, t, "x", 7) for k, t in rows], "doc_id long, text string, key string, n_lines int").repartition(4)
    got = line_dedup.dedup_lines(docs).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(plain_dedup(rows), key=str)
    assert got[0].asDict().keys() == {"doc_id", "key", "text", "n_lines", "n_removed"}
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_lines_that_meet_are_all_near_lines(spark):
    rng = random.Random(17)
    lines = [x for x in make_lines(rng) if len(x.strip()) >= line_dedup.MIN_CHARS]
    texts = documents(spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id long, text string"))
    got = line_dedup.near_lines(texts, line_dedup.line_places(texts), 8).collect()
    known = sorted({x.strip(" \t\n\x0b\f\r") for x in lines})
    names = dict(zip(line_dedup.Hashed(known).keys().tolist(), known))
    found = {tuple(sorted((names[r["a"]], names[r["b"]]))) for r in got}
    want = set()
    for i, a in enumerate(known):
        for b in known[i + 1:]:
            limit = int(line_dedup.edits_of(min(len(a), len(b))))
            if limit and abs(len(a) - len(b)) <= limit and plain_whole(a, b) <= limit:
                want.add((a, b))
    assert found == want and want


def test_many_pairs_of_lines_are_told_as_each_by_itself():
    rng = random.Random(5)
    left, right = [], []
    for _ in range(300):
        size = rng.choice([70, 75, 640, 660, 1500])
        x = "".join(rng.choice("abc Ж\U0001F600") for _ in range(size))
        y = list(x)
        for _ in range(rng.randrange(size // 10)):
            at = rng.randrange(len(y))
            y[at:at + rng.randrange(2)] = rng.choice(["", "q", "Ж "])
        left.append(x)
        right.append("".join(y))
        if rng.random() < 0.5:
            left[-1], right[-1] = right[-1], left[-1]
    found = line_dedup.all_near(left, right)
    assert found.tolist() == [line_dedup.are_near(x, y) for x, y in zip(left, right)]
    assert 30 < found.sum() < 270
    assert line_dedup.all_near([], []).tolist() == []


def test_long_lines_with_an_exchanged_word_are_near(spark, monkeypatch):
    """One edit for each 20 characters, counted here: pairs at the budget, beyond it, and edits at equal distances."""
    rng = random.Random(23)
    lines = []
    for n in (45, 59, 60, 61, 79, 80, 120, 179, 180, 181, 187, 188, 300, 700):
        for _ in range(4):
            base = [rng.choice("abcdefghij klmnopqé") for _ in range(n - 2)]
            base = ["x", *base, "x"]
            for edits in (0, n // 20 - 1, n // 20, n // 20 + 1):
                y = list(base)
                for k in range(edits):
                    at = (k + 1) * n // (edits + 1) - 1
                    y[at] = rng.choice(["", "Z", y[at] + "Z"])
                lines.append("".join(y))
            at = rng.randrange(1, n - 9)
            lines.append("".join([*base[:at], "W" * (n // 20), *base[at + n // 20:]]))
    lines += ["-" * n for n in (60, 61, 63, 64, 200, 209, 3000, 3150)]
    lines = sorted(set(lines))
    want = {
        (a, b) for i, a in enumerate(lines) for b in lines[i + 1:]
        if abs(len(a) - len(b)) <= min(len(a), len(b)) // 20 and plain_near(a, b, min(len(a), len(b)) // 20)
    }
    texts = documents(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    names = dict(zip(line_dedup.Hashed(lines).keys().tolist(), lines))
    for chars in (line_dedup.CLASS_CHARS, 2000):
        monkeypatch.setattr(line_dedup, "CLASS_CHARS", chars)
        got = line_dedup.near_lines(texts, line_dedup.line_places(texts), 8).collect()
        assert {tuple(sorted((names[r["a"]], names[r["b"]]))) for r in got} == want
    assert sum(len(a) > 100 for a, _ in want) > 50


def plain_near(a, b, limit):
    """Whether at most ``limit`` edits part a and b, by a table whose cells are near the diagonal."""
    far, row = limit + 1, {j: j for j in range(min(limit, len(b)) + 1)}
    for i, x in enumerate(a, 1):
        now = {}
        for j in range(max(0, i - limit), min(len(b), i + limit) + 1):
            best = min(row.get(j, far) + 1, now.get(j - 1, far) + 1)
            now[j] = min(best, row.get(j - 1, far) + (x != b[j - 1])) if j else min(best, i)
        row = now
        if min(row.values()) > limit:
            return False
    return row.get(len(b), far) <= limit


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc", max_size=40), st.lists(st.tuples(st.integers(0, 40), st.sampled_from(["", "a", "d", "dd"])), max_size=9), st.integers(0, 9))
def test_distance_by_fronts(a, edits, limit):
    b = list(a)
    for at, new in edits:
        b[at:at + 1] = new
    b = "".join(b)
    assert line_dedup.distance_by_fronts(a, b, limit) == min(plain_whole(a, b), limit + 1)


def changed_line(rng, line, edits, letters):
    out = list(line)
    for _ in range(edits):
        at = rng.randrange(len(out)) if out else 0
        out[at:at + 1] = rng.choice(["", rng.choice(letters), "".join(out[at:at + 1]) + rng.choice(letters)])
    return "".join(out)


@pytest.mark.parametrize("columns", [16, 37, 2048])
def test_distance_in_runs_of_columns(monkeypatch, columns):
    monkeypatch.setattr(line_dedup, "COLUMNS", columns)
    rng = random.Random(columns)
    for letters in ("ab", "abcdefgh é"):
        for n in (1, 30, 200):
            a = "".join(rng.choices(letters, k=n))
            for b in ("", a, a[n // 2:], "".join(rng.choices(letters, k=n)), *(changed_line(rng, a, e, letters) for e in (1, 4, n // 20, n // 10))):
                far = plain_whole(a, b)
                for limit in (0, 1, 5, n // 20, n // 6, n):
                    assert line_dedup.distance_within(a, b, limit) == min(far, limit + 1)
                if a and b:
                    one, other = line_dedup.Hashed([a, b]).triples().astype(int)
                    assert abs(one - other).sum() <= 6 * far
                    assert line_dedup.are_near(a, b) == (far <= line_dedup.edits_of(min(len(a), len(b))))


def test_links_of_a_part_join_the_same_classes(monkeypatch):
    """Enough links keep the classes of all links, also where pairs are looked at in many small blocks."""
    rng = random.Random(29)
    letters = "abcdefghij klmnopq"
    lines = []
    for _ in range(4):
        line = "".join(rng.choices(letters, k=300))
        for _ in range(30):
            lines.append(line)
            line = changed_line(rng, line, rng.choice([1, 5, 12, 15]), letters)[:310]
    lines += ["".join(rng.choices(letters, k=150)) + lines[0][150:300] for _ in range(20)]
    lines = sorted({x for x in lines if 290 <= len(x) <= 312})
    rows = pa.table({"key": pa.array(range(len(lines))), "value": pa.array(lines)})

    def classes(pairs):
        root = list(range(len(lines)))
        for a, b in pairs:
            old, new = root[a], root[b]
            root = [new if r == old else r for r in root]
        return {frozenset(i for i, r in enumerate(root) if r == one) for one in set(root)}

    def links(every):
        found = set()
        for cls in range(60):
            found |= set(zip(*line_dedup.near_in_part(rows, cls, 0, 1, every).to_pydict().values()))
        return found

    whole = links(True)
    want = {(i, j) for i in range(len(lines)) for j in range(i) if plain_near(lines[i], lines[j], int(line_dedup.edits_of(min(len(lines[i]), len(lines[j])))))}
    assert {tuple(sorted(p)) for p in whole} == {tuple(sorted(p)) for p in want} and want
    for block in (line_dedup.PAIR_BLOCK, 50):
        monkeypatch.setattr(line_dedup, "PAIR_BLOCK", block)
        monkeypatch.setattr(line_dedup, "ANCHOR_BLOCK", min(block, line_dedup.ANCHOR_BLOCK))
        some = links(False)
        assert some <= whole and classes(some) == classes(whole)
    assert len(some) < len(whole)


# Pipeline


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps, now = [docs.count()], docs
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.materialise(stage(spark, now, sf), name)
        steps.append(now.count())
        if name != "best_fit_packing":
            assert now.columns == docs.columns and now.dtypes == docs.dtypes
    assert steps[:-1] == sorted(steps[:-1], reverse=True) and steps[-2] > 0.6 * steps[0]
    whole = corpus_pipeline.run(spark, sf)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole.select(*columns).collect())) == sorted(map(tuple, now.select(*columns).collect()))


def test_line_dedup_keeps_columns_of_any_name(spark):
    line = "a line that is long enough to be compared with others"
    docs = spark.createDataFrame([(1, line, 5, "p", 3), (2, line + "\nshort", 6, "q", 4)], "doc_id long, text string, _doc long, _LINES string, N_LINES int")
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    assert got[2]["text"] == "short" and got[2]["_doc"] == 6 and got[2]["_LINES"] == "q" and got[2]["n_lines"] == 2 and got[2]["n_removed"] == 1
    assert got[1]["text"] == line and len({c.lower() for c in got[1].asDict()}) == len(got[1])


def test_line_stage_keeps_short_lines_of_a_document_with_a_repeated_one(spark):
    head = "The same long licence line stands in each of these documents."
    short = ["\n".join(f"{word} {k}" for k in range(300)) for word in ("item", "諸行無常", "été")]
    rows = [(0, head + "\n" + short[0]), (1, head + "\n" + short[1]), (2, head + "\n\n" + short[2]), (3, head), (4, head + "\n--\n * ")]
    docs = spark.createDataFrame([(k, t, len(t)) for k, t in rows], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    left = {0: rows[0][1], 1: short[1], 2: "\n" + short[2]}
    assert got == {k: (t, len(t)) for k, t in left.items()}


def test_pipeline_of_an_empty_table(spark, sf):
    now = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf)
    assert now.count() == 0


def test_names():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 11))
