"""Merkle manifest of a table: a tree per source, one over the sources, and a proof for every row.

A tree is worked in aligned blocks of ``ARITY ** HEIGHT`` leaves. A block keeps each of its
levels as one string of hex digests: substrings of fixed width are hashed to the level
above, and what flanks a node in its run of ``ARITY`` is its sibling segment. The tops of
the blocks are the leaves of the next, much smaller round, until a tree is one block. All
of it is SQL functions; no group holds more than a block, however large its source is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from bidlens.operators.stats import distributed_rank
from bidlens.session import materialise

ARITY = 3
# Levels that a block holds: 243 leaves, level strings of up to 15,552 characters.
HEIGHT = 5
BLOCK = ARITY ** HEIGHT
DIGEST = 64
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
PATH = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def stated(value: Column) -> Column:
    """A field as it is hashed: its UTF-8 length, a colon and itself, or a dash for null."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: list[Column]) -> Column:
    return digest(F.concat(*[stated(f) for f in fields]))


def _parent_level(level: Column) -> Column:
    run = ARITY * DIGEST
    last = F.floor((F.length(level) - 1) / run).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), last), lambda i: digest(F.substring(level, i * run + 1, F.lit(run)))), "")


def blocks_of(nodes: DataFrame) -> DataFrame:
    """(tree, n, block, members, levels, depth, top) from nodes (tree, n, pos, node, ...) of trees of n leaves.

    ``members`` are the nodes in order, ``levels[j]`` the digests of level j in one string,
    ``depth`` the levels inside the block, ``top`` its last node.
    """
    payload = [c for c in nodes.columns if c not in ("tree", "n", "pos", "node")]
    member = F.struct("pos", "node", *payload)
    grouped = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK)).groupBy("tree", "n", "block").agg(F.sort_array(F.collect_list(member)).alias("members"))
    out = grouped.withColumn("_0", F.array_join(F.transform("members", lambda m: m["node"]), ""))
    for j in range(HEIGHT):  # a level of one node in the whole tree is the last
        out = out.withColumn(f"_{j + 1}", F.when(F.col("n") > ARITY ** j, _parent_level(F.col(f"_{j}"))))
    depth = reduce(lambda a, b: a + b, [(F.col("n") > ARITY ** j).cast("int") for j in range(HEIGHT)])
    levels = [f"_{j}" for j in range(HEIGHT + 1)]
    top = F.substring(F.coalesce(*reversed(levels)), 1, DIGEST)
    return out.select("tree", "n", "block", "members", F.array(*levels).alias("levels"), depth.alias("depth"), top.alias("top"))


def _siblings(levels: Column, depth: Column, pos: Column) -> Column:
    """Sibling segments of the node at ``pos`` on each level of its block, from the leaves up."""
    steps = []
    for j in range(HEIGHT):
        level = levels[j]
        at = F.floor(F.pmod(pos, F.lit(BLOCK)) / ARITY ** j)
        run = F.floor(at / ARITY) * ARITY
        left = F.substring(level, (run * DIGEST + 1).cast("int"), ((at - run) * DIGEST).cast("int"))
        right = F.substring(level, ((at + 1) * DIGEST + 1).cast("int"), ((run + ARITY - at - 1) * DIGEST).cast("int"))
        steps.append(F.struct(left.alias("left"), right.alias("right")))
    return F.slice(F.array(*steps), F.lit(1), depth)


def above(blocks: DataFrame, largest: int) -> DataFrame:
    """(tree, block, path, root): what stands above each block's top, up to the root of its tree."""
    done = blocks.filter(F.col("n") <= BLOCK).select("tree", "block", F.array().cast(PATH).alias("path"), F.col("top").alias("root"))
    if largest <= BLOCK:
        return done
    nodes = blocks.filter(F.col("n") > BLOCK).select("tree", F.ceil(F.col("n") / BLOCK).alias("n"), F.col("block").alias("pos"), F.col("top").alias("node"))
    return done.unionByName(paths(nodes, -(-largest // BLOCK)).select("tree", F.col("pos").alias("block"), "path", "root"))


def paths(nodes: DataFrame, largest: int) -> DataFrame:
    """(tree, pos, node, path, root and further columns) of nodes (tree, n, pos, node, ...), ``largest`` the largest n."""
    blocks = materialise(blocks_of(nodes), "merkle_blocks")
    ends = materialise(above(blocks, largest), "merkle_above")
    joined = blocks.join(ends, ["tree", "block"])
    members = F.transform("members", lambda m: m.withField("path", F.concat(_siblings(F.col("levels"), F.col("depth"), m["pos"]), F.col("path"))))
    return joined.select("tree", "root", F.inline(members))


def folded(node: Column, path: Column) -> Column:
    """The root that a node and its sibling segments lead to."""
    return F.aggregate(path, node, lambda h, s: digest(F.concat(s["left"], h, s["right"])))


def manifest(docs: DataFrame, fields: list[str] = FIELDS, group_col: str = "source", order_col: str = "doc_id", tampered: Column | None = None, changed: Column | None = None) -> DataFrame:
    """(order column, leaf, subroot, root, proof_sha256, folded_root, verified), one row per input row.

    A leaf hashes ``fields`` (each ``-`` or UTF-8 length, ``:``, value). Leaves stand by
    ``order_col`` in their group, and runs of three consecutive nodes, the last one
    maybe shorter, are hashed while a level has more than one node. Subroots, ordered by
    group with null first, give the root in the same way. ``proof_sha256`` hashes the
    siblings level by level, left to right. ``tampered`` (a value instead of the last
    field) is folded where ``changed`` holds, else the leaf itself; ``verified`` tells
    whether that leads to the root.

    Null and empty values hash apart; a null group is a group of its own, distinct from
    the empty string; rows without order value come first. Rows that share an order value
    stand by leaf, equal rows next to each other, and each gets its own place and proof.
    An empty table has no rows and no root. Other columns are not read, and no name of a
    column can clash. A long text is one value of a SQL hash function.
    """
    values = [F.col(f) for f in fields]
    own = leaf(values)
    other = own if tampered is None else F.when(F.coalesce(changed, F.lit(False)), leaf([*values[:-1], tampered])).otherwise(own)
    # A null group becomes the empty string, any other one begins with a sign: nulls first, and no null keys.
    tree = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    # Texts are read once; from here on a row is a few digests. Its number in the scan parts equal rows.
    leaves = materialise(
        docs.select(tree.alias("tree"), F.col(order_col).alias("key"), own.alias("node"), other.alias("given"), F.monotonically_increasing_id().alias("_read")), "merkle_leaves"
    )
    sizes = materialise(leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("n")), "merkle_sizes")
    ranked = distributed_rank(leaves, ["tree"], [F.col("key").asc_nulls_first(), F.col("node"), F.col("_read")])
    nodes = ranked.join(sizes, "tree").select("tree", "n", (F.col("rank") - 1).alias("pos"), "node", "key", "given")
    shape = sizes.agg(F.max("n").alias("largest"), F.count(F.lit(1)).alias("trees")).first()
    blocks = materialise(blocks_of(nodes), "merkle_blocks")
    ends = materialise(above(blocks, shape["largest"] or 0), "merkle_above")

    subroots = ends.filter(F.col("block") == 0).select(F.col("tree").alias("group"), F.col("root").alias("node"))
    ordered = distributed_rank(subroots.withColumn("tree", F.lit("")), ["tree"], [F.col("group")])
    tops = ordered.select("tree", F.lit(shape["trees"]).cast("long").alias("n"), (F.col("rank") - 1).alias("pos"), "node", "group")
    tops = paths(tops, shape["trees"]).select(F.col("group").alias("tree"), F.col("path").alias("_upper"), F.col("root").alias("_top"))

    whole = blocks.join(ends.withColumnRenamed("root", "subroot"), ["tree", "block"]).join(tops, "tree")
    path = lambda m: F.concat(_siblings(F.col("levels"), F.col("depth"), m["pos"]), F.col("path"), F.col("_upper"))
    rows = whole.select("subroot", F.col("_top").alias("root"), F.inline(F.transform("members", lambda m: m.withField("path", path(m)))))
    proof = digest(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""))
    out = rows.select(F.col("key").alias(order_col), F.col("node").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded(F.col("given"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def without_newlines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The manifest of documents with every second text (by crc32 of the id's digits) robbed of its line feeds."""
    even = F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0
    return manifest(docs, tampered=F.replace(F.col(text_col), F.lit("\n"), F.lit("")), changed=even)
