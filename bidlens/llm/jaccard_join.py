"""Near-duplicate documents by a token-group matrix over five-word shingles.

Similar sets are put into groups, and each group stores the union of its members' tokens.
A query set can only be similar to a member if it shares enough tokens with the union, so
only the groups that pass this bound are opened and compared member by member. How it runs:

1. Every text becomes its set of shingle hashes; texts with one set are one node.
2. Sets that share a pair of minimum hashes are compared with one leader each, which joins
   most copies at a cost linear in their number. What is joined is a class.
3. All sets are searched, whole: tokens are ordered by how many sets hold them. Before the
   first token that two similar sets share, neither can have more tokens than it may lack
   in the other. Sets are put into groups of bounded size by their most frequent pair of
   minimum hashes; groups meet in such a token, and their sets meet the groups so found.
4. For each candidate the group's token union bounds the overlap; groups that pass are
   opened. Links found here join classes, and a component's name is its smallest doc_id.

Tokens are moved as packed arrays, dealt by their hash, and tokens of a single set end in
the task that meets them. Hashes have 64 bits; equal ones are taken for equal shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from bidlens.llm.common import documents, mix, own_name, rows_of, text_words
from bidlens.operators.clusters import connected_components
from bidlens.session import materialise

WORDS = 5
SIMILARITY = 75  # percent
# Parts the tokens are dealt into by hash; the smallest token of each part is a minimum hash, and
# two of them together are a key that copies share.
MIN_PARTS = 16
# Sets that hold a token before it counts as common and moves to the end of the order.
COMMON = 4
# Common tokens that are sent to all tasks, 12 bytes each; the rarest common ones beyond are
# treated as uncommon, which changes the work and not the result.
SENT_COMMON = 1 << 19
GROUP_SIZE = 256
# Packed tokens a task keeps before it hands them on.
HELD_TOKENS = 1 << 20
SEEN_SETS = 1 << 20
_SALT = np.uint64(0x2545F4914F6CDD1D)


def shingles(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of all windows of ``size`` words; fewer words are one window."""
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    width = min(size, len(words))
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total = mix(total + words[k:k + n])
    return np.unique(total)


def set_key(tokens: np.ndarray) -> int:
    """One number for a set; sums do not depend on order."""
    return int(mix(mix(tokens ^ _SALT).sum(keepdims=True) + np.uint64(len(tokens)))[0].astype(np.int64))


def min_keys(tokens: np.ndarray) -> list[int]:
    """One number for each pair of the smallest tokens of two parts."""
    parts, first = np.unique(mix(tokens) % np.uint64(MIN_PARTS), return_index=True)
    least = np.zeros(MIN_PARTS, np.uint64)
    least[parts.astype(np.int64)] = tokens[first]
    return mix(least[::2] + mix(least[1::2] + _SALT)).astype(np.int64).tolist()


def prefix_size(n: int, percent: int) -> int:
    """So many first tokens of a set of n are enough to meet every similar set."""
    return n - -(-percent * n // 100) + 1


class Seen:
    """Keys a task has met, forgotten when there are too many; forgetting costs work only."""

    def __init__(self, limit: int = SEEN_SETS):
        self.limit, self.keys = limit, set()

    def first_time(self, key: int) -> bool:
        if key in self.keys:
            return False
        if len(self.keys) >= self.limit:
            self.keys.clear()
        self.keys.add(key)
        return True


def buckets_of(tokens: np.ndarray, buckets: int) -> np.ndarray:
    return (tokens >> np.uint64(40)) % np.uint64(buckets)


def common_tokens(texts: DataFrame, percent: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, sets that hold them), by token: those that more than ``COMMON`` sets have among their smallest hashes."""

    def first(batches):
        seen, held, n = Seen(), [], 0

        def hand_on():
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            where = buckets_of(tokens, buckets)
            order = np.argsort(where, kind="stable")
            cuts = np.searchsorted(where[order], np.arange(buckets + 1))
            parts = [(b, order[cuts[b]:cuts[b + 1]]) for b in range(buckets) if cuts[b] < cuts[b + 1]]
            return pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in parts], pa.int32()), pa.array([tokens[p].tobytes() for _, p in parts], pa.binary()),
                 pa.array([counts[p].astype(np.int32).tobytes() for _, p in parts], pa.binary())], names=["bucket", "tokens", "counts"])

        for _, run in rows_of(batches):
            for words in text_words(run):
                tokens = shingles(words)
                if len(tokens) and seen.first_time(set_key(tokens)):
                    held.append(tokens[:prefix_size(len(tokens), percent)])
                    n += len(held[-1])
            if n > HELD_TOKENS:
                yield hand_on()
                held, n = [], 0
        if held:
            yield hand_on()

    def total(part: pa.Table) -> pa.Table:
        tokens = np.concatenate([np.frombuffer(x, np.uint64) for x in part.column("tokens").to_pylist()])
        counts = np.concatenate([np.frombuffer(x, np.int32) for x in part.column("counts").to_pylist()])
        order = np.argsort(tokens, kind="stable")
        tokens, counts = tokens[order], counts[order]
        starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
        sums = np.add.reduceat(counts.astype(np.int64), starts)
        keep = sums > COMMON
        return pa.table({"token": pa.array(tokens[starts][keep].view(np.int64)), "sets": pa.array(sums[keep])})

    packed = texts.mapInArrow(first, "bucket int, tokens binary, counts binary")
    found = materialise(packed.groupBy("bucket").applyInArrow(total, "token long, sets long"), "common")
    least = COMMON
    while found.filter(F.col("sets") > least).count() > SENT_COMMON:
        least *= 2
    sent = found.filter(F.col("sets") > least).toPandas().astype({"token": "int64", "sets": "int64"})
    tokens = sent["token"].to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], np.minimum(sent["sets"].to_numpy()[order], 2 ** 31 - 1).astype(np.int32)


def sketches(texts: DataFrame, percent: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, n, key, keys, first): set size, set name, minimum hashes, and the first tokens by (how common, hash).

    Within a task a set's tokens are written once; later rows of the set carry none.
    """
    sent, sets = common

    def sketch(batches):
        seen = Seen()
        for ids, run in rows_of(batches):
            rows = []
            for doc_id, words in zip(ids, text_words(run)):
                tokens = shingles(words)
                if not len(tokens) or doc_id is None:
                    rows.append((doc_id, len(tokens), None, None, None))
                    continue
                key = set_key(tokens)
                if not seen.first_time(key):
                    rows.append((doc_id, len(tokens), key, None, None))
                    continue
                order = tokens
                if len(sent):
                    at = np.minimum(np.searchsorted(sent, tokens), len(sent) - 1)
                    order = tokens[np.argsort(np.where(sent[at] == tokens, sets[at], 0), kind="stable")]
                rows.append((doc_id, len(tokens), key, min_keys(tokens), order[:prefix_size(len(tokens), percent)].tobytes()))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "n", "key", "keys", "first"])

    return texts.mapInArrow(sketch, "doc_id long, n long, key long, keys array<long>, first binary")


def token_sets(texts: DataFrame, wanted: DataFrame, sketched: DataFrame) -> DataFrame:
    """(key, tokens): the whole sets of the wanted keys, computed again from one document each."""
    chosen = sketched.filter(F.col("first").isNotNull()).join(wanted.select("key").distinct(), "key").groupBy("key").agg(F.min("doc_id").alias("_chosen"))
    from_docs = texts.join(chosen, F.col("doc_id") == F.col("_chosen")).select("key", "text")

    def read(batches):
        for keys, run in rows_of(batches):
            found = [shingles(w) for w in text_words(run)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([t.tobytes() for t in found], pa.binary())], names=["key", "tokens"])

    # A row of another id could repeat an id; a key's set is the same from any of them.
    return from_docs.mapInArrow(read, "key long, tokens binary")


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Shared values of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def linked(shared: int, n: int, m: int, percent: int) -> bool:
    return 100 * shared >= percent * (n + m - shared)


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of keys whose sets are similar."""

    def compare(batches):
        for batch in batches:
            left, right = batch.column("_left").to_pylist(), batch.column("_right").to_pylist()
            keep = []
            for x, y in zip(left, right):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                keep.append(linked(overlap(x, y), len(x), len(y), percent))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    left = sets.select(F.col("key").alias("a"), F.col("tokens").alias("_left"))
    right = sets.select(F.col("key").alias("b"), F.col("tokens").alias("_right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "_left", "_right").mapInArrow(compare, "a long, b long")


def leader_links(texts: DataFrame, sketched: DataFrame, percent: int) -> DataFrame:
    """Links between sets and the leaders of their minimum hashes: for each hash the set named first and the smallest one.

    The smallest set is close to all that hold it with little besides. A shortcut for
    groups of copies: what it does not find is left to the search.
    """
    nodes = sketched.filter(F.col("keys").isNotNull()).select("key", "n", "keys")
    spread = nodes.select("key", "n", F.posexplode("keys").alias("place", "value"))
    who = F.struct("key", "n")
    led = spread.groupBy("place", "value").agg(
        F.min(who).alias("_first"), F.min(F.struct("n", "key")).alias("_least"), F.max("key").alias("_last")
    ).filter(F.col("_last") != F.col("_first.key"))
    least = F.struct(F.col("_least.key").alias("key"), F.col("_least.n").alias("n"))
    led = led.select("place", "value", F.explode(F.array("_first", least)).alias("leader"))
    near = 100 * F.least("n", "leader.n") >= percent * F.greatest("n", "leader.n")
    pairs = spread.join(led, ["place", "value"]).filter((F.col("key") != F.col("leader.key")) & near)
    pairs = materialise(pairs.select(F.col("key").alias("a"), F.col("leader.key").alias("b")).distinct(), "leader_pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key"))
    return materialise(compared(pairs, token_sets(texts, wanted, sketched), percent), "leader_links")


def shared_tokens(sketched: DataFrame, common: np.ndarray, buckets: int) -> DataFrame:
    """(token, key, n, rank): first tokens that two sets or more have, and how many come before them in the set.

    Tokens known as common are dealt by set, not by token.
    """

    def deal(batches):
        held: list[tuple[np.ndarray, int, int]] = []
        size = 0

        def hand_on():
            tokens = np.concatenate([t for t, _, _ in held])
            lengths = [len(t) for t, _, _ in held]
            keys = np.repeat(np.array([k for _, k, _ in held], np.int64), lengths)
            ns = np.repeat(np.array([n for _, _, n in held], np.int32), lengths)
            ranks = np.concatenate([np.arange(m, dtype=np.int32) for m in lengths])
            where = buckets_of(tokens, buckets).astype(np.int64)
            if len(common):
                at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
                where = np.where(common[at] == tokens, -1 - (keys.view(np.uint64) % np.uint64(buckets)).astype(np.int64), where)
            order = np.argsort(where, kind="stable")
            values, starts = np.unique(where[order], return_index=True)
            parts = np.split(order, starts[1:])
            return pa.RecordBatch.from_arrays(
                [pa.array(values.astype(np.int32)), *[pa.array([x[p].tobytes() for p in parts], pa.binary()) for x in (tokens, keys, ns, ranks)]],
                names=["bucket", "tokens", "keys", "ns", "ranks"])

        for batch in batches:
            for key, n, first in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "first"))):
                held.append((np.frombuffer(first, np.uint64), key, n))
                size += len(held[-1][0])
                if size > HELD_TOKENS:
                    yield hand_on()
                    held, size = [], 0
        if held:
            yield hand_on()

    def meet(part: pa.Table) -> pa.Table:
        columns = [
            np.concatenate([np.frombuffer(x, t) for x in part.column(c).to_pylist()])
            for c, t in (("tokens", np.uint64), ("keys", np.int64), ("ns", np.int32), ("ranks", np.int32))
        ]
        order = np.lexsort((columns[1], columns[0]))
        tokens, keys = columns[0][order], columns[1][order]
        kept = order[np.concatenate(([True], (tokens[1:] != tokens[:-1]) | (keys[1:] != keys[:-1])))]
        if part.column("bucket")[0].as_py() >= 0:
            tokens = columns[0][kept]
            same = tokens[1:] == tokens[:-1]
            kept = kept[np.concatenate((same, [False])) | np.concatenate(([False], same))]
        tokens, keys, ns, ranks = (c[kept] for c in columns)
        return pa.table({
            "token": pa.array(tokens.view(np.int64)), "key": pa.array(keys), "n": pa.array(ns.astype(np.int64)), "rank": pa.array(ranks)
        })

    packed = sketched.filter(F.col("first").isNotNull()).select("key", "n", "first").mapInArrow(
        deal, "bucket int, tokens binary, keys binary, ns binary, ranks binary"
    )
    return packed.groupBy("bucket").applyInArrow(meet, "token long, key long, n long, rank int")


def set_groups(sketched: DataFrame) -> DataFrame:
    """(key, group) of every set that shares a pair of minimum hashes: the sets of its most frequent pair, in parts of bounded size.

    The grouping decides how well unions bound, not what is found; a set that is not listed is a group of its own.
    """
    spread = sketched.filter(F.col("keys").isNotNull()).select("key", F.posexplode("keys").alias("place", "value")).distinct()
    counted = spread.groupBy("place", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    best = spread.join(counted, ["place", "value"]).groupBy("key").agg(F.max(F.struct("n", "place", "value")).alias("_p"))
    part = F.pmod(F.xxhash64("key"), F.ceil(F.col("_p.n") / GROUP_SIZE))
    return best.select("key", F.xxhash64("_p.place", "_p.value", part).alias("group"))


def described(rows: DataFrame, classes: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of sets with ``group`` and ``standing``, the size and name of the class; a set alone is its own class and group."""
    sizes = classes.groupBy("class").agg(F.count(F.lit(1)).alias("_size"))
    known = classes.join(sizes, "class").select("key", F.struct(F.col("_size").alias("size"), F.col("class").alias("name")).alias("_standing"))
    alone = F.struct(F.lit(1).cast("long").alias("size"), F.col("key").alias("name"))
    joined = rows.join(known, "key", "left").join(groups, "key", "left")
    return joined.select(*rows.columns, F.coalesce("_standing", alone).alias("standing"), F.coalesce("group", "key").alias("group"))


def candidate_groups(shared: DataFrame, classes: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(key, standing, group, any_class): sets and the groups that may hold a similar set of another class.

    Only sets of different classes matter. Of two groups the smaller one asks the other for
    sets of any other class, unless fewer ask if all look for classes of higher standing
    only: then few members of a large class ask. Sizes must allow them to be similar, and so must the rank of the token they meet
    in: what comes before the first shared token is not shared. Groups meet groups in a
    token, so a token that many near copies hold costs pairs of groups, not of sets.
    """
    rows = described(shared, classes, groups)
    n = F.col("n")

    def most_before(size: Column, other: Column) -> Column:
        """Tokens of a set of ``size`` that a similar set of ``other`` may lack."""
        return size - F.ceil(percent * (size + other) / F.lit(100 + percent))

    mixed = rows.groupBy("token").agg(
        F.min("standing.name").alias("_a"), F.max("standing.name").alias("_b"), F.max(F.col("rank") <= most_before(n, n)).alias("_early")
    ).filter((F.col("_a") != F.col("_b")) & F.col("_early"))
    rows = materialise(rows.join(mixed.select("token"), "token"), "mixed")
    # Of the members that hold the token: sizes, the smallest rank, the standings.
    held = rows.groupBy("token", F.col("group").alias("g")).agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.min("rank").alias("rank"),
        F.min("standing").alias("bottom"), F.max("standing").alias("top"),
    )
    asking = held.select("token", F.struct("g", "low", "high", "rank", "bottom", "top").alias("q"))
    least, most = _reach(F.col("q.low"), F.col("q.high"), percent)
    shortest = F.greatest("q.low", F.ceil(percent * F.col("low") / 100))
    meets = (least <= most) & (F.col("q.rank") <= most_before(F.col("q.high"), least)) & (F.col("rank") <= most_before(most, shortest))
    differ = (F.col("q.bottom") < F.col("top")) | (F.col("bottom") < F.col("q.top"))
    pairs = asking.join(held, "token").filter((F.col("q.g") <= F.col("g")) & differ & meets).select(
        F.col("q.g").alias("a"), F.col("g").alias("b")
    ).distinct()
    asks = rows.select("key", "n", "standing", F.col("group").alias("_from")).distinct()
    # Of a group: its class of highest standing, and how many members are of others.
    span = asks.groupBy("_from", "standing").agg(F.count(F.lit(1)).alias("_n"), F.min("n").alias("low"), F.max("n").alias("high"))
    span = span.groupBy("_from").agg(
        F.sum("_n").alias("size"), F.max(F.struct("standing", "_n")).alias("_t"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.min("standing").alias("bottom"),
    ).select("_from", "size", (F.col("size") - F.col("_t._n")).alias("others"), "low", "high", "bottom", F.col("_t.standing").alias("top"))
    span = materialise(span, "spans")
    for side in ("a", "b"):
        pairs = pairs.join(span.select(F.col("_from").alias(side), F.struct(F.col("_from").alias("group"), *span.columns[1:]).alias(f"_{side}")), side)
    down = [F.when(F.col(f"{x}.top") < F.col(f"{y}.top"), F.col(f"{x}.size")).otherwise(F.col(f"{x}.others")) for x, y in (("_a", "_b"), ("_b", "_a"))]
    whole = (F.col("a") != F.col("b")) & (F.least("_a.size", "_b.size") < down[0] + down[1])

    def way(x: str, y: str, any_class: bool) -> Column:
        return F.struct(F.col(f"{x}.group").alias("_from"), F.col(y).alias("to"), F.lit(any_class).alias("any_class"))

    ways = F.when(whole, F.array(F.when(F.col("_a.size") <= F.col("_b.size"), way("_a", "_b", True)).otherwise(way("_b", "_a", True)))).when(
        F.col("a") == F.col("b"), F.array(way("_a", "_b", False))
    ).otherwise(F.array(way("_a", "_b", False), way("_b", "_a", False)))
    ways = pairs.select(F.explode(ways).alias("_w")).select("_w._from", "_w.to.*", "_w.any_class")
    least, most = _reach(n, n, percent)
    below = F.col("standing") < F.col("top")
    wanted = below | (F.col("any_class") & (F.col("bottom") < F.col("standing")))
    return asks.join(ways.drop("size", "others"), "_from").filter(wanted & (least <= most)).select("key", "standing", "group", "any_class")


def _reach(low: Column, high: Column, percent: int) -> tuple[Column, Column]:
    """Of the sizes ``low`` to ``high`` of a group, those that sets of the given sizes can be similar to."""
    return F.greatest("low", F.ceil(percent * low / 100)), F.least("high", F.floor(100 * high / F.lit(percent)))


def group_links(texts: DataFrame, sketched: DataFrame, shared: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Links between classes: each candidate's group is opened if its token union allows."""
    groups = materialise(set_groups(sketched), "set_groups")
    candidates = materialise(candidate_groups(shared, classes, groups, percent), "candidates")
    opened = candidates.groupBy("group").agg(F.count(F.lit(1)).alias("_asked"))
    listed = groups.join(opened.select("group"), "group", "left_semi")
    single = opened.select("group").join(listed, "group", "left_anti").select(F.col("group").alias("key"), "group")
    members = described(listed.select("key").unionByName(single.select("key")), classes, groups)
    members = materialise(members, "members")
    wanted = candidates.select("key").unionByName(members.select("key"))
    sets = materialise(token_sets(texts, wanted, sketched), "sets")
    # About GROUP_SIZE sets in a group, and as many that ask in a row; a group that many ask has many rows.
    stored = members.join(sets, "key").groupBy("group").agg(F.collect_list(F.struct("key", "standing", "tokens")).alias("members"))
    salted = candidates.join(opened, "group").withColumn("part", F.pmod(F.xxhash64("key"), F.ceil(F.col("_asked") / GROUP_SIZE)))
    asked = salted.join(sets, "key").groupBy("group", "part").agg(F.collect_list(F.struct("key", "standing", "any_class", "tokens")).alias("asked"))

    def search(batches):
        for batch in batches:
            for asked, stored in zip(batch.column("asked"), batch.column("members")):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in _links_into(asked.as_py(), stored.as_py(), percent)], names=["a", "b"]
                )

    return materialise(asked.join(stored, "group").select("asked", "members").mapInArrow(search, "a long, b long"), "group_links")


def _forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of these links, enough to hold the same nodes together: one less than a connected piece has nodes."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for a, b in pairs:
        left, right = find(a), find(b)
        if left != right:
            root[left] = right
            kept.append((a, b))
    return kept


def _links_into(asked: list[dict], members: list[dict], percent: int) -> tuple[list[int], list[int]]:
    """Classes that similar pairs of asking sets and members of a group link, as a spanning forest.

    Pairs are of another class or, unless the set asks for any, of one of higher standing.
    """

    def standing(m: dict) -> tuple[int, int]:
        return m["standing"]["size"], m["standing"]["name"]

    found: list[tuple[int, int]] = []
    sets_ = [np.frombuffer(m["tokens"], np.uint64) for m in members]
    owner = np.repeat(np.arange(len(sets_)), [len(t) for t in sets_])
    tokens = np.concatenate(sets_)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    union = np.unique(tokens)
    for q in asked:
        query = np.frombuffer(q["tokens"], np.uint64)
        if 100 * overlap(query, union) < percent * len(query):
            continue
        low, high = np.searchsorted(tokens, query, "left"), np.searchsorted(tokens, query, "right")
        size = high - low
        hits = np.repeat(low, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        shared = np.bincount(owner[hits], minlength=len(members))
        for k, m in enumerate(members):
            if (standing(q) < standing(m) or q["any_class"] and standing(m) < standing(q)) and linked(int(shared[k]), len(query), len(sets_[k]), percent):
                found.append((q["standing"]["name"], m["standing"]["name"]))
    kept = _forest(list(dict.fromkeys(found)))
    return [a for a, _ in kept], [b for _, b in kept]


def classes_of(links: DataFrame) -> DataFrame:
    """(key, class) of every linked set."""
    nodes = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return connected_components(nodes, links).select(F.col("id").alias("key"), F.col("component").alias("class"))


def near_duplicates(docs: DataFrame, percent: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Words are runs other than ASCII white space with A-Z as a-z; a text's set are its
    distinct five-word windows, or all its words as one window if they are fewer. Texts
    link if shared shingles are at least ``percent`` of all shingles of both;
    ``component_id`` is the smallest doc_id that links reach. Null texts and texts without
    words have no shingles and stay alone. Rows with one id are rows of one document and
    each get a result; a row with a null id links with nothing and gets a null component.
    An empty table gives an empty one.
    """
    spark = docs.sparkSession
    texts = documents(docs, id_col, text_col)
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    common = common_tokens(texts, percent, buckets)
    sketched = materialise(sketches(texts, percent, common), "sketches")
    stars = leader_links(texts, sketched, percent)
    classes = materialise(classes_of(stars), "classes")
    more = group_links(texts, sketched, shared_tokens(sketched, common[0], buckets), classes, percent)
    # Links name classes: a class is one node from here on.
    joined = materialise(classes_of(more.distinct()), "joined").select(F.col("key").alias("_k"), F.col("class").alias("_c"))
    rows = sketched.select("doc_id", "n", "key").join(classes, "key", "left").withColumn("_node", F.coalesce("class", "key"))
    rows = rows.join(joined, F.col("_node") == F.col("_k"), "left").select("doc_id", "n", F.coalesce("_c", "_node").alias("_root"))
    smallest = rows.filter(F.col("_root").isNotNull()).groupBy("_root").agg(F.min("doc_id").alias("_smallest"))
    return rows.join(smallest, "_root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("_smallest", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of one document of each component, the one with the smallest id, all columns kept, whatever their names.

    Rows with a null id and texts without words stay, as do all rows that share the id that
    stays; an empty table gives an empty one.
    """
    found = near_duplicates(docs, percent, id_col, text_col)
    name = own_name("_copy", docs.columns)
    copies = found.filter(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(copies, F.col(id_col) == F.col(name), "left_anti")
