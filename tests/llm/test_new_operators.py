"""Token files, conversation repair and the Merkle manifest against plain forms of the same rules."""

import hashlib
import heapq
import re
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bidlens.llm import conversation_repair as cr, line_dedup, merkle, token_files
from bidlens.llm.queries import ORACLE, QUERIES, VOCABULARY
from bidlens.session import scratch_path

ODD = [None, "", " ", "a", "x\ny", "naïve été 日本語", "word " * 60_000, "a" * 5000, "\n", "same", "same"]


def odd_documents(spark):
    rows = [(k, t, "fr", "s" if k % 3 else None, len(t or ""), "x", 1, "y") for k, t in enumerate(ODD)]
    rows += [(None, "no id", None, "", 5, "x", 1, "y"), (4, "x\ny", None, "t", None, "x", 1, "y"), (4, "other", None, "t", None, "x", 1, "y")]
    rows += [(7, "copy", "en", "s", 4, "x", 1, "y")] * 40
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, leaf string, shard int, ids string")


# Token files


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def files_of(path):
    import glob

    return sorted(glob.glob(path.replace("file:", "") + "/tokens/*.parquet"))


def test_token_files_hold_what_the_library_gives(spark, sf, tokenizer):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = sorted(QUERIES["op11_token_files"](spark, sf).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted(docs) and all(r["intact"] for r in got)
    at = 0
    for r in got:
        ids = np.array(ids_of(tokenizer, docs[r["doc_id"]]), "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_odd_texts_repeated_and_missing_ids(spark, tokenizer, encoding):
    docs, path = odd_documents(spark), scratch_path(spark, "odd_tokens")
    token_files.write_tokens(docs, path, VOCABULARY, shards=6, encoding=encoding)
    got = sorted(token_files.read_back(spark, path).collect(), key=lambda r: r["start"])
    assert sum(r["n_tokens"] for r in got[:-1]) == got[-1]["start"] and all(r["intact"] for r in got)
    keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert keys == sorted(keys) and len(got) == docs.count()
    want = sorted(str((r["doc_id"], ids_of(tokenizer, r["text"]))) for r in docs.select("doc_id", "text").collect())
    assert sorted(str((r["doc_id"], r["ids"])) for r in token_files.read_tokens(spark, path).collect()) == want


def test_an_id_that_fills_shards_is_dealt_over_them(spark):
    docs = spark.createDataFrame([(7, f"text {k}") for k in range(300)] + [(k, "x") for k in range(6)], "doc_id long, text string")
    path = scratch_path(spark, "hot_tokens")
    token_files.write_tokens(docs, path, VOCABULARY, shards=6)
    rows = [r["rows"] for r in token_files.read_manifest(spark, path).collect()]
    assert sum(rows) == 306 and max(rows) <= 150
    keys = [r["doc_id"] for r in sorted(token_files.read_back(spark, path).collect(), key=lambda r: r["start"])]
    assert keys == sorted(keys)


def test_layout_of_the_files(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for encoding, name in (("dictionary", "RLE_DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")):
        path = scratch_path(spark, "layout_tokens")
        token_files.write_tokens(docs, path, VOCABULARY, shards=2, encoding=encoding, row_group_rows=40, page_rows=20)
        meta = [pq.ParquetFile(f).metadata for f in files_of(path)]
        meta = [m for m in meta if m.num_rows]
        assert all(m.num_row_groups == -(-m.num_rows // 40) for m in meta)
        for m in meta:
            for g in range(m.num_row_groups):
                columns = {m.row_group(g).column(c).path_in_schema: m.row_group(g).column(c) for c in range(m.num_columns)}
                assert name in columns["ids.list.element"].encodings
                assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
                assert all(c.has_offset_index and c.has_column_index for c in columns.values() if "ids" not in c.path_in_schema)


def test_selective_reads(spark, sf, tokenizer):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    path = scratch_path(spark, "some_tokens")
    token_files.write_tokens(spark.read.parquet(f"{sf}/documents.parquet"), path, VOCABULARY, shards=3)
    some = sorted(docs)[5:9]
    assert {r["doc_id"]: r["ids"] for r in token_files.read_tokens(spark, path, doc_ids=some).collect()} == {k: ids_of(tokenizer, docs[k]) for k in some}
    assert token_files.read_tokens(spark, path, first=some[0], last=some[-1]).count() == 4
    plan = token_files.read_metadata(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1]
    whole = [t for k in sorted(docs) for t in ids_of(tokenizer, docs[k])]
    for start, length in ((0, 10), (len(whole) // 3, len(whole) // 2), (len(whole) - 5, 50), (7, 0)):
        parts = sorted(token_files.token_stretch(spark, path, start, length).collect(), key=lambda r: r["start"])
        assert [t for p in parts for t in p["ids"]] == whole[start:start + length]


def test_no_documents_give_no_tokens(spark):
    path = scratch_path(spark, "no_tokens")
    token_files.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, VOCABULARY)
    assert token_files.read_back(spark, path).count() == 0 and token_files.read_manifest(spark, path).count() == 0


# Conversations

MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def plain_repair(rows):
    """Cheapest repair by Dijkstra over (row, state, edits), rows of (turn, role, text) in order."""
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip("\t\n\x0b\x0c\r ")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            break
        if (i, state) in done:
            continue
        done.add((i, state))
        for role in ("user", "assistant"):
            if (state, role[0]) in MOVES:
                heapq.heappush(heap, (cost + 5, audit + "I", i, MOVES[state, role[0]], (*out, f"{role}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, out))
            if faults[i] in ("", "truncated"):
                extra = 5 * (faults[i] == "truncated")
                if (state, role[:1]) in MOVES:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, MOVES[state, role[:1]], (*out, f"{role}:{text}")))
                for other in ("user", "assistant"):
                    if (state, other[0]) in MOVES:
                        heapq.heappush(heap, (cost + extra + 1, audit + "R", i + 1, MOVES[state, other[0]], (*out, f"{other}:{text}")))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def by_conversation(rows):
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn, role, text))
    for group in groups.values():
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return groups


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def reported(df):
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def talk(spark, rows):
    extra = [(*r, "x", 0, "y") for r in rows]
    return spark.createDataFrame(extra, "conv_id long, turn long, role string, text string, part string, seg int, audit string")


def random_rows(seed, conversations, longest):
    rng = np.random.default_rng(seed)
    roles = ["user", "assistant", "system", "tool", "", "user", "assistant"]
    texts = ["Yes.", "No", "", " \n", "Why?", "Fine! ", "a.\nb", "é。"]
    rows = []
    for conv in range(conversations):
        for turn in range(int(rng.integers(1, longest))):
            rows.append((conv, int(turn + rng.integers(0, 2)), str(rng.choice(roles)), str(rng.choice(texts))))
    return rows


def test_repairs_are_the_cheapest(spark):
    rows = random_rows(1, 300, 9)
    want = {c: plain_repair(g) for c, g in by_conversation(rows).items()}
    assert reported(cr.repaired(talk(spark, rows)).conversations) == want


def test_long_conversations_lie_in_many_segments(spark):
    rng = np.random.default_rng(2)
    roles, texts = ["user", "assistant", "system", "tool"], [f"text {k}{'.' if k % 5 else ''}" for k in range(700)] + [""]
    rows = [(c, t, str(rng.choice(roles)), str(rng.choice(texts))) for c in (1, 2, None) for t in range(1500 if c == 1 else 600)]
    rows += [(5, 0, "user", "Hi."), (5, 1, "assistant", "Ho.")]
    want = {c: plain_repair(g) for c, g in by_conversation(rows).items()}
    assert reported(cr.repaired(talk(spark, rows)).conversations) == want


def test_one_conversation_of_equal_rows(spark):
    rows = [(1, 0, "user", "Hi.")] * 900
    got = reported(cr.repaired(talk(spark, rows)).conversations)
    assert got == {1: plain_repair([r[1:] for r in rows])}


def test_damage_and_report_on_odd_rows(spark):
    rows = random_rows(3, 120, 6) + [(None, None, None, None), (None, 3, "user", "A."), (900, None, "assistant", None), (900, None, "user", "B."), (901, -5, "system", "S."), (901, 7, "user", "U.")]
    frame = talk(spark, rows)
    want = {c: plain_repair(g) for c, g in by_conversation(plain_damage(rows)).items()}
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = {c: want.get(c, empty) for c in {r[0] for r in rows}}
    assert reported(cr.repair_report(frame, cr.damaged(frame))) == want


def test_the_repaired_rows_are_those_that_are_hashed(spark, sf):
    rows = cr.damaged(spark.read.parquet(f"{sf}/conversations.parquet"))
    done = cr.repaired(rows)
    lines = {}
    for r in sorted(done.rows.collect(), key=lambda r: (r["conv_id"], r["place"])):
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for r in done.conversations.collect():
        assert r["repaired_sha256"] == hashlib.sha256("\n".join(lines.get(r["conv_id"], [])).encode()).hexdigest()


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cr.repair_report(none, cr.damaged(none)).count() == 0


def test_a_grammar_gives_what_single_rows_give(spark):
    rng = np.random.default_rng(4)
    strings = ["".join(chr(65 + int(k)) for k in rng.integers(0, 16, int(rng.integers(1, 60)))) for _ in range(80)] + ["EI" * 100]
    frame = spark.createDataFrame([(s, 3) for s in strings], "symbols string, n long")
    grammar, plain = cr.learn_grammar(frame), cr.Grammar([])
    assert len(grammar.rules) > 10
    for s in strings:
        a, b = grammar.part(s), plain.part(s)
        assert a[1:] == b[1:] and cr.closed(a.matrix) == cr.closed(b.matrix)


# Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """(root, siblings per leaf as lists of (left, right) per level) of digests in order."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for k, a in enumerate(at):
            run = a // 3 * 3
            paths[k].append(("".join(level[run:a]), "".join(level[a + 1:run + 3])))
            at[k] = a // 3
        level = [sha(*level[i:i + 3]) for i in range(0, len(level), 3)]
    return level[0], paths


def plain_manifest(rows):
    """Rows of (doc_id, source, lang, n_chars, text)."""

    def leaf(row):
        return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])

    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = {}
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subs[name] = plain_tree([leaf(r) for r in groups[name]])
    root, upper = plain_tree([subs[n][0] for n in names])
    out = []
    for k, name in enumerate(names):
        for row, low in zip(groups[name], subs[name][1]):
            path = low + upper[k]
            given = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                given = (*row[:4], row[4].replace("\n", ""))
            h = leaf(given)
            for left, right in path:
                h = sha(left, h, right)
            out.append((row[0], leaf(row), subs[name][0], root, sha(*[a + b for a, b in path]), h, h == root))
    return out


def manifested(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


NAMES = ["doc_id", "source", "lang", "n_chars", "text"]


def test_manifest_of_odd_rows(spark):
    docs = odd_documents(spark)
    want = plain_manifest([tuple(r) for r in docs.select(*NAMES).collect()])
    assert manifested(merkle.without_newlines(docs)) == sorted(want, key=repr)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 243, 244, 730])
def test_manifest_of_a_hot_source(spark, n):
    rows = [(k, "hot", "en", k % 7, f"line {k}\nend") for k in range(n)] + [(n + 5, "é", None, 1, "\n"), (n + 6, None, "x", 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert manifested(merkle.without_newlines(docs)) == sorted(plain_manifest(rows), key=repr)


def test_manifest_of_many_blocks_and_sources(spark):
    rows = [(k, "hot" if k % 2 else f"s{k}", "en", 1, "\n" * (k % 3)) for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert manifested(merkle.without_newlines(docs)) == sorted(plain_manifest(rows), key=repr)


def test_manifest_of_nothing(spark):
    assert merkle.without_newlines(spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")).count() == 0


def test_changed_rows_do_not_verify(spark):
    docs = spark.createDataFrame([(k, "s", "en", 1, "a b") for k in range(30)], "doc_id long, source string, lang string, n_chars long, text string")
    out = merkle.manifest(docs, tampered=F.concat("text", F.lit("!")), changed=F.col("doc_id") == 7)
    assert {r["doc_id"] for r in out.collect() if not r["verified"]} == {7}


@pytest.mark.parametrize("name", ["op12_conversation_repair", "op13_merkle_manifest"])
def test_sql_gives_the_same_rows(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    cursor = con.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    got = QUERIES[name](spark, sf)
    assert sorted(map(repr, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(repr, cursor.fetchall()))


# Lines of documents that share an id

A, B, C, D = ("first line of the corpus, long enough", "second sentence that nobody repeats", "third one with words of its own", "fourth and last of these lines")


def test_rows_of_one_id_lose_no_line(spark):
    rows = [(5, f"{A}\n{B}"), (5, f"{B}\n{C}"), (5, D), (9, f"{D}\n{A}\nshort"), (None, A), (None, A), (7, None)]
    docs = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], "doc_id long, text string, _doc string, _lines string, N_LINES int, _number int").coalesce(1)
    got = line_dedup.dedup_lines(docs)
    assert sorted(got.columns) == sorted(["doc_id", "_doc", "_lines", "_number", "text", "n_lines", "n_removed"])
    out = got.collect()
    assert len(out) == len(rows)
    kept = [line for r in out if r["doc_id"] is not None and r["text"] for line in r["text"].split("\n")]
    assert sorted(x for x in kept if x) == sorted([A, B, C, D, "short"])
    assert [r["text"] for r in out if r["doc_id"] is None] == [A, A]
    assert sum(r["n_removed"] for r in out) == 3


def test_row_numbers_follow_the_ids(spark):
    docs = spark.createDataFrame([(3, "a"), (1, "b"), (3, "c"), (None, "d")], "doc_id long, text string").coalesce(1)
    got = {r["text"]: r["n"] for r in line_dedup.numbered_rows(docs, "doc_id", "n").collect()}
    assert got == {"b": 1, "a": 2, "c": 3, "d": None}
