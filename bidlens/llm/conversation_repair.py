"""Cheapest repair of role and fault sequences, on sequences that a grammar has compressed.

A row becomes a terminal (role initial and fault), a conversation a string of terminals.
Re-Pair rounds over all distinct strings name the most frequent neighbouring pairs; each
rule gets one min-plus transfer matrix between the states of the wanted pattern
``(s?(ua)+)?``, made bottom-up from the two sides of the rule. An entry of a matrix is the
least cost and a rope of edits whose leaves are shared between rules. A conversation is
the product of the few matrices of its compressed string.

Conversations are cut into segments of ``SEGMENT`` rows. Nearly all are one segment and are
repaired in the pass that reads them. The products of longer ones are joined 64 at a
time, in rounds, so no task holds one conversation's rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from bidlens.session import materialise

SEGMENT = 256
SEGMENT_CHARS = 1 << 20
FAN_IN = 64
# Re-Pair: a round names pairs that share no symbol; each symbol is one character.
ROUNDS = 10
RULES_A_ROUND = 32
SPACES = "\t\n\x0b\x0c\r "
INITIALS = "sua"
SOUND, CUT, BLANK, DOUBLE = range(4)
KEEP_CUT, REROLE, DELETE, INSERT = 5, 1, 2, 5
ROW = "conv_id long, turn long, role string, text string"
REPAIR = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"

# States of the wanted pattern: nothing yet, after s, after u, after a. Ends are allowed in ENDS.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
INSERTS = {(0, 0): "", (1, 1): "", (2, 2): "", (3, 3): "", (0, 2): "I", (0, 3): "II", (1, 2): "I", (1, 3): "II", (2, 3): "I", (3, 2): "I"}
ENDS = (0, 3)
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def terminal(initial: str, fault: int) -> str:
    return chr(65 + 4 * (INITIALS.index(initial) if initial in INITIALS and initial else 3) + fault)


# Matrices


class Part(NamedTuple):
    """What a symbol, or a stretch of rows, does: matrix[p][q] = (cost, rope) or None, counts, first and last initial."""

    matrix: tuple
    blank: int
    double: int
    cut: int
    illegal: int
    first: str
    last: str


def letters(rope) -> str:
    """The edits of a rope: a string, or a pair of ropes."""
    if isinstance(rope, str):
        return rope
    out, open_ = [], [rope]
    while open_:
        node = open_.pop()
        if isinstance(node, str):
            out.append(node)
        else:
            open_ += (node[1], node[0])
    return "".join(out)


def better(a, b):
    """The cheaper entry; of equal costs the one whose edits come first as text."""
    if a is None or b is None:
        return a or b
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return a if letters(a[1]) <= letters(b[1]) else b


def times(a: tuple, b: tuple) -> tuple:
    """Min-plus product of matrices given as rows."""
    rows = []
    for left in a:
        row = []
        for q in range(4):
            best = None
            for m in range(4):
                x, y = left[m], b[m][q]
                if x and y:
                    best = better(best, (x[0] + y[0], (x[1], y[1]) if x[1] and y[1] else x[1] or y[1]))
            row.append(best)
        rows.append(tuple(row))
    return tuple(rows)


def joined(a: Part, b: Part) -> Part:
    return Part(
        times(a.matrix, b.matrix), a.blank + b.blank, a.double + b.double, a.cut + b.cut,
        a.illegal + b.illegal + ((a.last, b.first) not in LEGAL), a.first, b.last,
    )


def terminal_part(symbol: str) -> Part:
    kind, fault = divmod(ord(symbol) - 65, 4)
    initial = "sua-"[kind]
    edits: dict[tuple[int, int], tuple[int, str]] = {}
    for p in range(4):
        edits[p, p] = (DELETE, "D")
        if fault in (SOUND, CUT):
            extra = KEEP_CUT if fault == CUT else 0
            for change, role in [((extra, "K"), initial), ((extra + REROLE, "R"), "u"), ((extra + REROLE, "R"), "a")]:
                if (p, role) in STEP:
                    q = STEP[p, role]
                    edits[p, q] = better(edits.get((p, q)), change)
    matrix = [[None] * 4 for _ in range(4)]
    for (p, m), inserts in INSERTS.items():
        for q in range(4):
            if (m, q) in edits:
                cost, edit = edits[m, q]
                matrix[p][q] = better(matrix[p][q], (cost + INSERT * len(inserts), inserts + edit))
    return Part(tuple(map(tuple, matrix)), int(fault == BLANK), int(fault == DOUBLE), int(fault == CUT), 0, initial, initial)


CLOSING = tuple(tuple((INSERT * len(INSERTS[p, q]), INSERTS[p, q]) if (p, q) in INSERTS else None for q in range(4)) for p in range(4))


def closed(matrix: tuple) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair from the first state to an allowed end."""
    row = times(matrix[:1], CLOSING)[0]
    best = None
    for q in ENDS:
        best = better(best, row[q])
    return best[0], letters(best[1])


class Grammar:
    """Rules (symbol, left, right) and the parts of all symbols, evaluated from the terminals up."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.rules = rules
        self.parts = {chr(65 + k): terminal_part(chr(65 + k)) for k in range(16)}
        for symbol, left, right in rules:
            self.parts[symbol] = joined(self.parts[left], self.parts[right])

    def part(self, string: str) -> Part:
        """The product over a non-empty string of terminals."""
        for symbol, left, right in self.rules:
            string = string.replace(left + right, symbol)
        out = self.parts[string[0]]
        for symbol in string[1:]:
            out = joined(out, self.parts[symbol])
        return out


def learn_grammar(strings: DataFrame, rounds: int = ROUNDS, rules_a_round: int = RULES_A_ROUND) -> Grammar:
    """Re-Pair over (symbols, n): strings of terminals and how many segments look like them.

    Pairs are counted by Spark; at most ``rules_a_round`` come to the driver in a round. What
    is left unnamed after the last round only makes longer products, never other results.
    """
    rules: list[tuple[str, str, str]] = []
    packed = F.col("symbols")
    for _ in range(rounds):
        now = strings.select(packed.alias("s"), "n").filter(F.length("s") > 1)
        pairs = now.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substring("s", i, F.lit(2)))).alias("pair"))
        counted = pairs.groupBy("pair").agg(F.sum("n").alias("n")).filter("n > 1").orderBy(F.desc("n"), "pair").limit(rules_a_round).collect()
        used: set[str] = set()
        fresh = []
        for row in counted:
            left, right = row["pair"]
            if not used & {left, right}:
                used |= {left, right}
                fresh.append((chr(0xE000 + len(rules) + len(fresh)), left, right))
        if not fresh:
            break
        rules += fresh
        for symbol, left, right in fresh:
            packed = F.replace(packed, F.lit(left + right), F.lit(symbol))
    return Grammar(rules)


# Rows


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults, by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text,
    2 takes its full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's.

    A null role or text is one space from here on, in the digits a null id or turn as well.
    """
    written = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(written[0], F.lit(":"), written[1]).cast("binary")) % 20
    role, text = F.coalesce(F.col("role"), F.lit(" ")), F.coalesce(F.col("text"), F.lit(" "))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        kind.alias("kind"), F.monotonically_increasing_id().alias("read"),
    ).filter(F.col("kind") != 0)
    copies = F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))
    return rows.withColumn("copy", F.explode(copies)).drop("kind", "copy")


def _symbol() -> Column:
    first = F.substring("role", 1, 1)
    kind = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(bare == "", BLANK).when(~(F.endswith(bare, F.lit(".")) | F.endswith(bare, F.lit("!")) | F.endswith(bare, F.lit("?"))), CUT).otherwise(SOUND)
    return F.chr(F.lit(65) + 4 * kind + fault)


SEGMENTS = (
    "conv_id long, part int, seg int, whole boolean, symbols string, n_turns int, turn_first long, turn_last long, "
    "keys array<binary>, roles array<string>, texts array<string>"
)


def segments(rows: DataFrame) -> DataFrame:
    """Segments of conversations in order: at most ``SEGMENT`` rows (or about ``SEGMENT_CHARS`` characters) each.

    Rows stand by turn (null first); rows of one turn by role and the first 256 characters of
    the text, then as they were read. A range partitioning deals them out, so a long
    conversation lies in many tasks. ``whole`` marks a conversation that is one segment;
    one at the edge of a task may go on in the next and is never marked.
    """
    if "read" not in rows.columns:
        rows = rows.withColumn("read", F.monotonically_increasing_id())
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 256), F.col("read")]
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    key = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")))
    shaped = dealt.select("conv_id", "turn", "role", "text", _symbol().alias("symbol"), key.alias("key"), F.spark_partition_id().alias("part"))

    def cut(batches):
        held: list[list] = []  # segments of the conversation that is open
        ready: list[dict] = []
        rows_open: list[tuple] = []
        current, number, chars, first = None, 0, 0, True

        def close_segment():
            nonlocal number, chars
            conv, part = rows_open[0][0], rows_open[0][6]
            seen, symbols = set(), []
            for _, _, _, _, symbol, key, _ in rows_open:
                fault = (ord(symbol) - 65) % 4
                again = fault != BLANK and key in seen
                seen.add(key)
                symbols.append(chr(ord(symbol) - fault + DOUBLE) if again else symbol)
            turns = [r[1] for r in rows_open if r[1] is not None]
            held.append({
                "conv_id": conv, "part": part, "seg": number, "whole": False, "symbols": "".join(symbols),
                "n_turns": len(set(turns)), "turn_first": turns[0] if turns else None, "turn_last": turns[-1] if turns else None,
                "keys": [r[5] for r in rows_open], "roles": [r[2] for r in rows_open], "texts": [r[3] for r in rows_open],
            })
            number, chars = number + 1, 0
            rows_open.clear()

        def close_conversation(last: bool):
            nonlocal first
            if rows_open:
                close_segment()
            if len(held) == 1 and held[0]["whole"] is False and not first and not last:
                held[0]["whole"] = True
            first = False if held else first
            ready.extend(held)
            held.clear()

        def out():
            schema = pa.schema([
                ("conv_id", pa.int64()), ("part", pa.int32()), ("seg", pa.int32()), ("whole", pa.bool_()), ("symbols", pa.string()),
                ("n_turns", pa.int32()), ("turn_first", pa.int64()), ("turn_last", pa.int64()),
                ("keys", pa.list_(pa.binary())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
            ])
            batch = pa.RecordBatch.from_pylist(ready, schema=schema)
            ready.clear()
            return batch

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if (row[0],) != current:
                    if current is not None:
                        close_conversation(False)
                    current = (row[0],)
                elif len(rows_open) >= SEGMENT or chars >= SEGMENT_CHARS:
                    close_segment()
                    if len(held) > 1:  # a long conversation does not pile up
                        first = False
                        ready.extend(held[:-1])
                        del held[:-1]
                        held[0]["whole"] = None  # further segments went before it
                rows_open.append(row)
                chars += len(row[3])
            if ready:
                yield out()
        close_conversation(True)
        if ready:
            yield out()

    return shaped.mapInArrow(cut, SEGMENTS).withColumn("whole", F.coalesce("whole", F.lit(False)))


def edited(audit: str, roles: list[str], texts: list[str], state: int = 0) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the rows that edits leave or insert, from a state of the wanted pattern on."""
    rows = zip(roles, texts)
    for edit in audit:
        if edit == "D":
            next(rows)
            continue
        role, text = ("", "") if edit == "I" else next(rows)
        if edit != "K":
            role = "assistant" if state == 2 else "user"
        state = STEP[state, role[:1]]
        yield edit, role, text


# Conversations that are one segment


def _gaps(n_turns: int, first: int | None, last: int | None) -> int:
    return last - first + 1 - n_turns if n_turns else 0


def repair_whole(segs: DataFrame, grammar: Grammar) -> DataFrame:
    """``REPAIR`` and (edits, roles, texts) of conversations of one segment, in the pass that reads them."""
    shared = segs.sparkSession.sparkContext.broadcast(grammar)

    def repair(batches):
        known: dict[str, tuple] = {}
        for batch in batches:
            out = []
            for conv, symbols, n_turns, first, last, roles, texts in zip(*(c.to_pylist() for c in batch.columns)):
                if symbols not in known:
                    if len(known) >= 100_000:
                        known.clear()
                    p = shared.value.part(symbols)
                    known[symbols] = (p.blank, p.double, p.cut, p.illegal, *closed(p.matrix))
                *counts, audit = known[symbols]
                rows = list(edited(audit, roles, texts))
                out.append((conv, _gaps(n_turns, first, last), *counts, audit, [e for e, _, _ in rows], [r for _, r, _ in rows], [t for _, _, t in rows]))
            columns = list(zip(*out)) if out else [[]] * 11
            types = [pa.int64()] * 7 + [pa.string()] + [pa.list_(pa.string())] * 3
            names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "edits", "roles", "texts"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    read = segs.select("conv_id", "symbols", "n_turns", "turn_first", "turn_last", "roles", "texts")
    return read.mapInArrow(repair, REPAIR + ", edits array<string>, roles array<string>, texts array<string>")


# Longer conversations, and those at the edge of a task

STRETCH = (
    "conv_id long, at long, costs array<long>, audits array<string>, blank long, double long, cut long, illegal long, "
    "first string, last string, n_turns long, turn_first long, turn_last long"
)


def _stretch_row(conv, at, part: Part, n_turns, first, last) -> dict:
    cells = [c for row in part.matrix for c in row]
    return {
        "conv_id": conv, "at": at, "costs": [c and c[0] for c in cells], "audits": [c and letters(c[1]) for c in cells],
        "blank": part.blank, "double": part.double, "cut": part.cut, "illegal": part.illegal, "first": part.first, "last": part.last,
        "n_turns": n_turns, "turn_first": first, "turn_last": last,
    }


def _part_of(row: dict) -> Part:
    cells = [None if c is None else (c, a) for c, a in zip(row["costs"], row["audits"])]
    return Part(tuple(tuple(cells[4 * p:4 * p + 4]) for p in range(4)), row["blank"], row["double"], row["cut"], row["illegal"], row["first"], row["last"])


STRETCH_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("at", pa.int64()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())),
    *[(n, pa.int64()) for n in ("blank", "double", "cut", "illegal")], ("first", pa.string()), ("last", pa.string()),
    *[(n, pa.int64()) for n in ("n_turns", "turn_first", "turn_last")],
])


def marked_again(segs: DataFrame) -> DataFrame:
    """Segments of longer conversations, with rows as duplicates that an earlier segment holds already.

    Inside a segment only the first of equal rows is left unmarked, so a text that fills a
    conversation comes here once a segment.
    """
    place = Window.partitionBy("conv_id", "key").orderBy("part", "seg")
    rows = segs.select("conv_id", "part", "seg", F.posexplode(F.arrays_zip("keys", F.split("symbols", ""))).alias("i", "m"))
    rows = rows.select("conv_id", "part", "seg", "i", F.col("m")["keys"].alias("key"), F.ascii(F.col("m")["1"]).alias("code"))
    open_ = rows.filter((F.col("code") - 65) % 4 < BLANK)
    later = open_.withColumn("nth", F.row_number().over(place)).filter("nth > 1").groupBy("part", "seg").agg(F.collect_list("i").alias("again"))
    plain = "".join(chr(65 + 4 * k + f) for k in range(4) for f in (SOUND, CUT))
    double = "".join(chr(65 + 4 * k + DOUBLE) for k in range(4) for _ in (SOUND, CUT))
    out = segs.drop("keys", "whole").join(later, ["part", "seg"], "left")
    chars = F.transform(F.sequence(F.lit(1), F.length("symbols")), lambda i: F.when(
        F.array_contains("again", i - 1), F.translate(F.substring("symbols", i, F.lit(1)), plain, double)).otherwise(F.substring("symbols", i, F.lit(1))))
    return out.withColumn("symbols", F.when(F.col("again").isNull(), F.col("symbols")).otherwise(F.array_join(chars, ""))).drop("again")


def stretches(segs: DataFrame, grammar: Grammar) -> DataFrame:
    """``STRETCH`` of each segment, numbered from 0 in its conversation."""
    shared = segs.sparkSession.sparkContext.broadcast(grammar)

    def evaluate(batches):
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            yield pa.RecordBatch.from_pylist(
                [_stretch_row(conv, at, shared.value.part(s), n, a, b) for conv, at, s, n, a, b in rows], schema=STRETCH_ARROW)

    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("part", "seg")) - 1
    return segs.select("conv_id", at.cast("long").alias("at"), "symbols", "n_turns", "turn_first", "turn_last").mapInArrow(evaluate, STRETCH)


def merged(rows: DataFrame) -> DataFrame:
    """One ``STRETCH`` per conversation: neighbours are multiplied, ``FAN_IN`` at a time, in rounds."""

    def multiply(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["at"])
        part, n, first, last = _part_of(rows[0]), rows[0]["n_turns"], rows[0]["turn_first"], rows[0]["turn_last"]
        for row in rows[1:]:
            part = joined(part, _part_of(row))
            if row["n_turns"]:
                n += row["n_turns"] - (last is not None and last == row["turn_first"])
                first, last = row["turn_first"] if first is None else first, row["turn_last"]
        return pa.Table.from_pylist([_stretch_row(rows[0]["conv_id"], rows[0]["at"] // FAN_IN, part, n, first, last)], schema=STRETCH_ARROW)

    rows = materialise(rows, "repair_stretches")
    longest = rows.agg(F.max("at").alias("m")).first()["m"] or 0
    while longest:
        rows = materialise(rows.groupBy("conv_id", F.floor(F.col("at") / FAN_IN).alias("_group")).applyInArrow(multiply, STRETCH), "repair_stretches")
        longest //= FAN_IN
    return rows


def finished(rows: DataFrame) -> DataFrame:
    """``REPAIR`` from one stretch per conversation."""

    def finish(batches):
        names = [f.strip().split(" ")[0] for f in REPAIR.split(",")]
        schema = pa.schema([(n, pa.string() if n == "audit" else pa.int64()) for n in names])
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                cost, audit = closed(_part_of(row).matrix)
                gaps = _gaps(row["n_turns"], row["turn_first"], row["turn_last"])
                out.append(dict(zip(names, (row["conv_id"], gaps, row["blank"], row["double"], row["cut"], row["illegal"], cost, audit))))
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return rows.mapInArrow(finish, REPAIR)


def repair_parts(segs: DataFrame, repairs: DataFrame) -> DataFrame:
    """(conv_id, part, seg, i, edit, role, text): rows of longer conversations after their repair."""
    sizes = segs.select("conv_id", F.struct("part", "seg", F.length("symbols").alias("n"), "initials").alias("s"))
    listed = sizes.groupBy("conv_id").agg(F.sort_array(F.collect_list("s")).alias("segs"))
    audits = listed.join(repairs.select(F.col("conv_id").alias("_conv"), "audit"), F.col("conv_id").eqNullSafe(F.col("_conv"))).select("segs", "audit")

    def deal(batches):
        for batch in batches:
            out = []
            for segs, audit in zip(*(c.to_pylist() for c in batch.columns)):
                at, state = 0, 0
                for k, seg in enumerate(segs):
                    start, left, began = at, seg["n"], state
                    initials = iter(seg["initials"])
                    while left or (k == len(segs) - 1 and at < len(audit)):
                        edit = audit[at]
                        at += 1
                        initial = None
                        if edit != "I":
                            left -= 1
                            initial = next(initials)
                        if edit != "D":
                            state = STEP[state, initial if edit == "K" else "a" if state == 2 else "u"]
                    out.append({"part": seg["part"], "seg": seg["seg"], "state": began, "edits": audit[start:at]})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("state", pa.int32()), ("edits", pa.string())]))

    dealt = audits.mapInArrow(deal, "part int, seg int, state int, edits string")

    def apply(batches):
        schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seg", pa.int32()), ("i", pa.int32()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
        for batch in batches:
            for conv, part, seg, state, edits, roles, texts in zip(*(c.to_pylist() for c in batch.columns)):
                rows = [{"conv_id": conv, "part": part, "seg": seg, "i": i, "edit": e, "role": r, "text": t} for i, (e, r, t) in enumerate(edited(edits, roles, texts, state))]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    held = segs.join(dealt, ["part", "seg"]).select("conv_id", "part", "seg", "state", "edits", "roles", "texts")
    return held.mapInArrow(apply, "conv_id long, part int, seg int, i int, edit string, role string, text string")


def hashed(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of rows that lie in many segments.

    A digest follows one text from its beginning, so a conversation is one task's stream;
    the task holds a batch of it at a time.
    """
    order = [F.col("conv_id").asc_nulls_first(), "part", "seg", "i"]
    line = F.concat("role", F.lit(":"), "text").cast("binary").alias("line")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stream = rows.repartition(tasks, "conv_id").sortWithinPartitions(*order).select("conv_id", line)

    def digest(batches):
        current, state = None, None
        for batch in batches:
            done = []
            for conv, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (conv,) != current:
                    if current is not None:
                        done.append((current[0], state.hexdigest()))
                    current, state = (conv,), hashlib.sha256(text)
                else:
                    state.update(b"\n")
                    state.update(text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.int64()), pa.array([d for _, d in done])], names=["conv_id", "repaired_sha256"])
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current[0]], pa.int64()), pa.array([state.hexdigest()])], names=["conv_id", "repaired_sha256"])

    return stream.mapInArrow(digest, "conv_id long, repaired_sha256 string")


class Repair(NamedTuple):
    """``REPAIR`` with repaired_sha256 of every conversation, and the repaired rows (conv_id, place, edit, role, text)."""

    conversations: DataFrame
    rows: DataFrame


def repaired(rows: DataFrame) -> Repair:
    """Cheapest repairs of conversations (conv_id, turn, role, text).

    A row's first fault counts: blank text, the same role and text earlier in the
    conversation, no closing full stop, exclamation or question mark. Keep costs 0, Rerole to
    user or assistant 1, Delete 2 (required for the first two faults), Insert of an
    empty user or assistant row 5, a row of the third fault that stays 5 more. The roles'
    initials must then be ``(s?(ua)+)?``; of equally cheap audits the least as text is taken.

    A null role or text is one space; a null turn stands first and counts for no gap; rows
    with a null conv_id are one conversation. Rows of a turn stand by role and text. Equal
    rows are duplicates. An empty table has no conversations. Further columns are left
    behind. A very long conversation lies in many segments and tasks; only its digest and
    its audit, which are one value each by definition, pass through one task.
    """
    spaced = [F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")]
    own = [c for c in rows.columns if c == "read"]
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *spaced, *own)
    segs = materialise(segments(rows), "repair_segments")
    single = segs.filter("whole")
    initials = F.translate("symbols", "".join(chr(65 + k) for k in range(16)), "ssssuuuuaaaa----")
    longer = materialise(marked_again(segs.filter("not whole")).withColumn("initials", initials), "repair_longer")
    strings = single.select("symbols").unionByName(longer.select("symbols")).groupBy("symbols").agg(F.count(F.lit(1)).alias("n"))
    grammar = learn_grammar(materialise(strings, "repair_strings"))

    whole = repair_whole(single, grammar)
    lines = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    names = [f.strip().split(" ")[0] for f in REPAIR.split(",")]
    shorts = whole.select(*names, F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))
    parts = materialise(finished(merged(stretches(longer, grammar))), "repair_finished")
    part_rows = materialise(repair_parts(longer, parts), "repair_rows")
    digests = hashed(part_rows).withColumnRenamed("conv_id", "_conv")
    longs = parts.join(digests, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").withColumn(
        "repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256))).drop("_conv")

    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("part", "seg", "i")) - 1
    out_rows = whole.select("conv_id", F.posexplode(F.arrays_zip("edits", "roles", "texts")).alias("place", "r")).select(
        "conv_id", F.col("place").cast("long").alias("place"), F.col("r.edits").alias("edit"), F.col("r.roles").alias("role"), F.col("r.texts").alias("text"))
    out_rows = out_rows.unionByName(part_rows.select("conv_id", place.cast("long").alias("place"), "edit", "role", "text"))
    return Repair(shorts.unionByName(longs.select(*shorts.columns)), out_rows)


def repair_report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """``REPAIR`` and repaired_sha256 for every conv_id of ``conversations``, whose ``rows`` may have been lost.

    Without a row: zeros, an empty audit and the digest of nothing.
    """
    ids = conversations.select(F.col("conv_id").cast("long").alias("_id")).distinct()
    found = repaired(rows).conversations
    empty = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    out = ids.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    return out.select(F.col("_id").alias("conv_id"), *[F.coalesce(F.col(c), empty.get(c, F.lit(0).cast("long"))).alias(c) for c in found.columns if c != "conv_id"])
