"""The prefix trie of conversations: which ones share their first turns, and what sharing saves.

A prefix is named by 128 bits: hashes of its turns, each with its place, added up. Sums of earlier
turns are running sums, which split a conversation of any length over tasks, so a node is a group of
equal sums and its parent the sums without the last turn. Totals over subtrees come from
``contraction.subtree_totals``. Two different prefixes of one length share a name with a chance of
about the square of the number of prefixes over 2^128.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm.contraction import subtree_totals, with_children
from lodeline.plans.hot_groups import row_positions, running
from lodeline.session import stored

SHARE = 100
HEADS = 6
# Rows of one conversation that meet one copy of its row in a join.
STRETCH = 100_000
# Pieces into which the children of one node are dealt where they look up their parent.
PIECES = 1024
# conv_ids per piece of a list of members.
LIST_IDS = 256
_KEY = ["depth", "k1", "k2"]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, n_chars): the turns of each conversation, numbered from 1.

    They are ordered by turn, null first; turns of one number by the SHA-256 of role length, role and
    text, so equal rows tie without effect. A null role or text is empty. Rows without a conv_id belong
    to no conversation and are left out. Other columns are ignored.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        digest.alias("digest"),
        F.length(text).cast("long").alias("n_chars"),
    )
    return row_positions(turns, ["conv_id"], ["turn", "digest"], "pos").drop("turn")


def rebuild(turns: DataFrame, share: int = SHARE, heads: int = HEADS) -> DataFrame:
    """(conv_id, depth, digest, n_chars, last): conversations that begin with turns of another one.

    ``turns`` is stored. Conversation c takes the first h turns of c - c % ``share`` (h: crc32 of its
    decimal id modulo ``heads``) and goes on with its own after its first h. Every conversation has a
    row at depth 0; ``last`` marks its last row.
    """
    base = F.col("conv_id") - F.col("conv_id") % share
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = convs.withColumns({"h": F.crc32(F.col("conv_id").cast("string")) % heads, "base": base})
    turn = F.struct("pos", "digest", "n_chars")
    first = turns.where((F.col("conv_id") % share == 0) & (F.col("pos") < heads))
    first = first.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(turn)).alias("head"))
    nothing = F.array().cast("array<struct<pos:bigint,digest:string,n_chars:bigint>>")
    head = F.slice(F.coalesce("head", nothing), F.lit(1), F.col("h").cast("int"))
    convs = convs.join(first, "base", "left").select("conv_id", "n", "h", head.alias("head"))
    convs = stored(convs, "convs")

    root = F.struct(F.lit(0).cast("long").alias("pos"), F.lit("").alias("digest"), F.lit(0).cast("long").alias("n_chars"))
    taken = convs.select("conv_id", "n", "h", F.size("head").alias("m"), F.explode(F.concat(F.array(root), "head")).alias("t"))
    taken = taken.select(
        "conv_id",
        F.col("t.pos").alias("depth"),
        "t.digest",
        "t.n_chars",
        ((F.col("n") <= F.col("h")) & (F.col("t.pos") == F.col("m"))).alias("last"),
    )
    # A conversation of any length: its row is copied once per stretch of its turns.
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / STRETCH)))
    longer = convs.where("n > h").select("conv_id", "n", "h", F.size("head").alias("m"), piece.alias("piece"))
    own = turns.withColumn("piece", F.floor((F.col("pos") - 1) / STRETCH)).join(longer, ["conv_id", "piece"])
    own = own.where("pos > h").select(
        "conv_id",
        (F.col("pos") - F.col("h") + F.col("m")).alias("depth"),
        "digest",
        "n_chars",
        (F.col("pos") == F.col("n")).alias("last"),
    )
    return taken.unionByName(own)


def as_they_are(turns: DataFrame) -> DataFrame:
    """The rows of ``rebuild`` for conversations that keep their own turns."""
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / STRETCH)))
    own = turns.withColumn("piece", F.floor((F.col("pos") - 1) / STRETCH)).join(
        sizes.select("conv_id", "n", piece.alias("piece")), ["conv_id", "piece"]
    )
    own = own.select("conv_id", F.col("pos").alias("depth"), "digest", "n_chars", (F.col("pos") == F.col("n")).alias("last"))
    zero = F.lit(0).cast("long")
    roots = sizes.select("conv_id", zero.alias("depth"), F.lit("").alias("digest"), zero.alias("n_chars"), F.lit(False).alias("last"))
    return roots.unionByName(own)


def _named(rows: DataFrame) -> DataFrame:
    """``rows`` with the names of their prefix (k1, k2) and of the one before (p1, p2)."""
    low, high = (lambda c: c.bitwiseAND(0xFFFFFFFF)), (lambda c: F.shiftrightunsigned(c, 32))
    a, b = F.xxhash64("depth", "digest"), F.xxhash64("digest", "depth")
    parts = {"s0": high(a), "s1": low(a), "s2": high(b), "s3": low(b)}
    parts = {n: F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(c) for n, c in parts.items()}
    sums = running(rows.withColumns(parts), ["conv_id"], ["depth"], {f"t{n}": ("sum", n) for n in parts})
    join = lambda hi, lo: F.shiftleft(low(hi), 32).bitwiseOR(low(lo))
    before = lambda n: F.col(f"t{n}") - F.col(n)
    return sums.select(
        "conv_id",
        "depth",
        "n_chars",
        "last",
        join(F.col("ts0"), F.col("ts1")).alias("k1"),
        join(F.col("ts2"), F.col("ts3")).alias("k2"),
        join(before("s0"), before("s1")).alias("p1"),
        join(before("s2"), before("s3")).alias("p2"),
    )


def _ends(rows: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256): the hash of each node's list of conversations that end there.

    Pieces of a list are sorted and joined where they are grouped; a task then feeds them to the hash
    in order, so it holds a piece at a time however long the list is.
    """
    block = F.floor(F.col("conv_id") / LIST_IDS)
    pieces = rows.where("last").groupBy(*_KEY, block.alias("block")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    pieces = pieces.select(*_KEY, "block", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    pieces = pieces.repartition(*_KEY).sortWithinPartitions(*_KEY, "block")
    return pieces.mapInArrow(_hash_lists, "depth long, k1 long, k2 long, ends_sha256 string")


def _hash_lists(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])
    now, state, done = None, None, []

    def batch():
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in done], schema)

    for part in parts:
        for *key, ids in zip(*(part[c].to_pylist() for c in (*_KEY, "ids"))):
            if key == now:
                state.update(b",")
            else:
                if now:
                    done.append((*now, state.hexdigest()))
                now, state = key, hashlib.sha256()
            state.update(ids.encode())
        if len(done) > 10_000:
            yield batch()
            done.clear()
    if now:
        done.append((*now, state.hexdigest()))
        yield batch()


def prefix_trie(rows: DataFrame) -> DataFrame:
    """One row per node of the trie of ``rows`` (as of ``rebuild``, stored).

    conv_id: smallest member; depth; parent_conv_id; n_convs: members; n_children; n_leaves: childless
    nodes of its subtree; saved_tokens: over its subtree, code points of a node's last text times its
    members but one; ends_sha256: hash of the comma-joined members that end there. No conversations: no
    nodes, not even a root.
    """
    rows = stored(_named(rows), "prefixes")
    nodes = rows.groupBy(*_KEY).agg(
        F.count("*").alias("n_convs"), *[F.min(c).alias(c) for c in ("conv_id", "n_chars", "p1", "p2")]
    )
    nodes = stored(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    # Children look their parent up in pieces; a piece is one row of the parent and a sum of its children.
    piece = F.pmod("k1", F.lit(PIECES))
    up = nodes.where("depth > 0").select("id", (F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), piece.alias("piece"))
    pieces = up.groupBy(*_KEY, "piece").agg(F.count("*").alias("n"), F.bit_xor("id").alias("x"))
    parents = nodes.select(*_KEY, F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    pieces = stored(pieces.join(parents, _KEY), "pieces")
    links = up.join(pieces.drop("n", "x"), [*_KEY, "piece"]).select("id", "parent", "parent_conv_id")
    saved = (F.col("n_convs") - 1) * F.col("n_chars")
    tree = nodes.join(links, "id", "left").select(
        "id", "parent", *_KEY, "conv_id", "parent_conv_id", "n_convs", saved.alias("saved_tokens")
    )
    tree = stored(with_children(tree, pieces.select("parent", "n", "x")), "tree")
    totals = subtree_totals(tree.drop("parent_conv_id", "n_convs"), ["saved_tokens"])
    found = tree.drop("saved_tokens").join(totals, "id").join(_ends(rows), _KEY, "left")
    return found.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of ``conversations`` (conv_id, turn, role, text) after ``rebuild``."""
    return prefix_trie(stored(rebuild(stored(ordered_turns(conversations), "turns")), "rebuilt"))
