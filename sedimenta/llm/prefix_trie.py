"""A prefix trie of conversations by vertical bitmaps.

A node is a distinct sequence of first turns (role, text); its members are the
conversations that begin with it.  Conversations are dealt over shards by their
first two turns, and a very common beginning is cut by blocks of ids.  A shard
indexes every (position, turn) to a bitset of its conversations; going depth
first, the bitset of a node and the postings of its members' next turns give
the children, their popcounts are the members, and members whose last turn this
is are the node's end list.  Nodes of different shards meet by a digest of
their path, as sums and minima, so a node costs one row per shard.

Sums over subtrees need no walk over the merged trie.  The smallest member of a
node is the smallest of all nodes below it on its own path too, so every
conversation owns the end of its path from some depth on.  With that depth (and
whether its last node is a leaf) known per conversation, a subtree's distinct
turns and leaves are sums over its members, and a second pass of the shards
gives them whatever the depth.

Turns are compared by the SHA-256 digest of role and text, paths by 128 bits of
a chain of such digests; texts stay where they are read.  Null roles and texts
are empty.  Turns are ordered by turn (null first), then role, then digest;
repeated rows are turns of their own.  Rows without a conversation id belong to
no conversation and are left out; ids are integers.  A conversation's digests
are one row.  Without conversations there is no node, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, staged, table

#: Conversations of a shard; its bitsets have so many bits.
SHARD = 4096
#: Ids of one beginning that go to one task together, and ids of a row of an end list.
ID_BITS = 8
ROOT = hashlib.sha256(b"").digest()
NODE = ["a", "b"]
PARENT = ["parent_a", "parent_b"]


def sequences(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turns)``: each conversation's turns in order, as digest and UTF-8 bytes of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.sha2(role, 256), text), 256))
    turn = F.struct(
        F.col("turn").isNotNull().alias("numbered"), F.col("turn").alias("turn"), role.alias("role"), key.alias("key"), F.octet_length(text).cast("long").alias("bytes")
    )
    gathered = conversations.where("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return gathered.select("conv_id", F.transform("turns", lambda t: F.struct(t["key"].alias("key"), t["bytes"].alias("bytes"))).alias("turns"))


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` of sequences by their first two turns, those of one beginning in blocks of ids."""
    lead = F.xxhash64(F.get("turns", F.lit(0))["key"], F.get("turns", F.lit(1))["key"])
    by = rows.select("*", lead.alias("lead"), F.shiftright("conv_id", ID_BITS).alias("block"))
    return by.repartition("lead", "block").sortWithinPartitions("lead", "conv_id").drop("lead", "block")


def bits(members: int) -> np.ndarray:
    """The places of a bitset's ones."""
    raw = members.to_bytes(-(-members.bit_length() // 8) or 1, "little")
    return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little"))


@dataclass
class Shard:
    """Conversations in order of their ids: ``codes[at[i]:at[i + 1]]`` are the turns of the i-th, as places in ``keys``."""

    ids: np.ndarray
    at: np.ndarray
    codes: np.ndarray
    keys: list[bytes]
    sizes: np.ndarray
    rows: pa.RecordBatch

    def walk(self) -> Iterator[tuple[bytes, bytes, int, int, int]]:
        """``(path, parent's path, depth, members, members that end here)`` of every node, depth first."""
        postings: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        at, codes = self.at.tolist(), self.codes.tolist()
        for i, (begin, end) in enumerate(zip(at, at[1:], strict=False)):
            ends[end - begin] = ends.get(end - begin, 0) | 1 << i
            for place in range(begin, end):
                turn = (place - begin, codes[place])
                postings[turn] = postings.get(turn, 0) | 1 << i
        stack = [(ROOT, b"", 0, (1 << len(self.ids)) - 1)]
        while stack:
            path, parent, depth, members = stack.pop()
            here = members & ends.get(depth, 0)
            yield path, parent, depth, members, here
            left = members ^ here
            while left:
                code = codes[at[(left & -left).bit_length() - 1] + depth]
                child = left & postings[depth, code]
                left ^= child
                stack.append((hashlib.sha256(path + self.keys[code]).digest(), path, depth + 1, child))


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    for b in batches:
        for row in range(0, b.num_rows, SHARD):
            part = b.slice(row, SHARD)
            part = part.take(pc.sort_indices(part.column("conv_id")))
            turns = part.column("turns")
            at = turns.offsets.to_numpy().astype(np.int64)
            flat = turns.flatten()
            key = flat.field("key").dictionary_encode()
            yield Shard(
                part.column("conv_id").to_numpy(), at - at[0], key.indices.to_numpy(), key.dictionary.to_pylist(), flat.field("bytes").to_numpy(), part
            )


def _halves(paths: list[bytes]) -> list[pa.Array]:
    """128 bits of each digest as two columns; the root's missing parent gives zeros."""
    both = np.frombuffer(b"".join(p[:16].ljust(16, b"\0") for p in paths), np.int64).reshape(-1, 2)
    return [pa.array(both[:, 0]), pa.array(both[:, 1])]


def local_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of each shard with their smallest member, popcount and end list."""
    for s in shards(batches):
        nodes = list(s.walk())
        low = [s.ids[(m & -m).bit_length() - 1] for _, _, _, m, _ in nodes]
        ends = [s.ids[bits(e)] if e else np.zeros(0, np.int64) for *_, e in nodes]
        yield pa.RecordBatch.from_arrays(
            [
                *_halves([n[0] for n in nodes]),
                *_halves([n[1] for n in nodes]),
                pa.array([n[2] for n in nodes], pa.int64()),
                pa.array(low, pa.int64()),
                pa.array([n[3].bit_count() for n in nodes], pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ends)]), pa.int32()), pa.array(np.concatenate(ends), pa.int64())),
            ],
            [*NODE, *PARENT, "depth", "conv_id", "n_convs", "ends"],
        )


def local_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves and saved bytes that the members of a shard bring to each node's subtree.

    A conversation brings, to a node of depth d on its path, the bytes of its
    turns from d on, less those of nodes that it owns: what is left of all
    members is every turn as often as it is said, less once.
    """
    for s in shards(batches):
        lengths = np.diff(s.at)
        owned = s.rows.column("own_from").to_numpy(zero_copy_only=False)
        owned = np.where(np.isnan(owned), lengths + 1, owned).astype(np.int64)
        leaf = s.rows.column("leaf").fill_null(False).to_numpy(zero_copy_only=False).astype(np.int64)
        said = np.concatenate([[0], np.cumsum(s.sizes)])
        rows = {"path": [], "leaves": [], "saved": []}
        for path, _, depth, members, _ in s.walk():
            i = bits(members)
            here = s.at[i] + max(depth, 1) - 1
            mine = s.at[i] + np.maximum(np.maximum(depth, owned[i]), 1) - 1
            rows["path"].append(path)
            rows["leaves"].append(int(leaf[i].sum()))
            rows["saved"].append(int((said[np.minimum(mine, s.at[i + 1])] - said[np.minimum(here, s.at[i + 1])]).sum()))
        yield pa.RecordBatch.from_arrays([*_halves(rows["path"]), pa.array(rows["leaves"], pa.int64()), pa.array(rows["saved"], pa.int64())], [*NODE, "n_leaves", "saved_tokens"])


def list_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's end list, whose rows follow one another in order; no list is held whole."""
    node, digest = None, None
    for b in batches:
        done = []
        for a, b_, ids in zip(*(b.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
            text = ",".join(map(str, ids)).encode()
            if (a, b_) == node:
                digest.update(b"," + text)
                continue
            if node:
                done.append((*node, digest.hexdigest()))
            node, digest = (a, b_), hashlib.sha256(text)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], [*NODE, "ends_sha256"])
    if node:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, digest.hexdigest())], [*NODE, "ends_sha256"])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of ``(conv_id, turns)`` rows, as ``sequences`` gives them, one row for each ``conv_id``.

    ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256)``: conv_id is the smallest member, saved_tokens
    the bytes that storing each node once saves in its subtree.
    """
    bound_batches(conversations.sparkSession)
    placed = staged(dealt(conversations.select("conv_id", "turns")), "sequences")
    local = staged(
        placed.mapInArrow(local_nodes, "a long, b long, parent_a long, parent_b long, depth long, conv_id long, n_convs long, ends array<long>"), "local_nodes"
    )
    merged = staged(
        local.groupBy(*NODE).agg(*[F.min(c).alias(c) for c in (*PARENT, "depth", "conv_id")], F.sum("n_convs").alias("n_convs")), "merged_nodes"
    )
    children = merged.where("depth > 0").groupBy(F.col("parent_a").alias("a"), F.col("parent_b").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = staged(merged.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")
    owned = staged(nodes.groupBy("conv_id").agg(F.min("depth").alias("own_from"), F.bool_or(F.col("n_children") == 0).alias("leaf")), "owned")

    again = dealt(placed.join(owned, "conv_id", "left").select("conv_id", "turns", "own_from", "leaf"))
    sums = again.mapInArrow(local_sums, "a long, b long, n_leaves long, saved_tokens long").groupBy(*NODE).agg(
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")
    )
    blocks = local.select(*NODE, F.explode("ends").alias("id")).groupBy(*NODE, F.shiftright("id", ID_BITS).alias("block")).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    ends = blocks.repartition(*NODE).sortWithinPartitions(*NODE, "block").select(*NODE, "ids").mapInArrow(list_digests, "a long, b long, ends_sha256 string")

    # Only the top node that a conversation owns has a parent of another owner.
    tops = staged(nodes.join(owned.select("conv_id", "own_from"), "conv_id"), "tops")
    above = tops.where("depth = own_from and depth > 0").select(*NODE, *PARENT).join(
        nodes.select(F.col("a").alias("parent_a"), F.col("b").alias("parent_b"), F.col("conv_id").alias("above")), PARENT
    )
    found = tops.join(above.select(*NODE, "above"), NODE, "left").join(sums, NODE).join(ends, NODE, "left")
    return found.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > 0, F.coalesce("above", "conv_id")).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def rebuilt(seqs: DataFrame) -> DataFrame:
    """Every conversation with the first h turns of the one whose id is the next lower multiple of five in place of its own; h is the id's crc32 mod 9."""
    none = F.array().cast(seqs.schema["turns"].dataType)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    own = seqs.select("conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), h.alias("h"))
    lead = seqs.select(F.col("conv_id").alias("base"), F.col("turns").alias("lead"))
    turns = F.concat(F.slice(F.coalesce("lead", none), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1))))
    return own.join(lead, "base", "left").select("conv_id", turns.alias("turns"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = staged(sequences(table(spark, sf_dir, "conversations")), "said")
    return prefix_trie(rebuilt(said))


OP11_SQL = r"""
WITH RECURSIVE bytes AS MATERIALIZED (SELECT i, CAST('0x' || lpad(to_hex(i), 2, '0') AS BIGINT) AS v FROM range(256) t(i)),
said AS MATERIALIZED (
  SELECT conv_id, list({'t': sha256(sha256(coalesce(role, '')) || coalesce(text, '')), 'n': octet_length(encode(coalesce(text, '')))}
    ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(sha256(coalesce(role, '')) || coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
crc(conv_id, s, i, c) AS (
  SELECT conv_id, CAST(conv_id AS VARCHAR), 0, 4294967295::BIGINT FROM said
  UNION ALL
  SELECT conv_id, s, i + 1, (
    WITH x AS (SELECT xor(c, ascii(s[i // 8 + 1])::BIGINT) AS y, c AS z)
    SELECT CASE WHEN i % 8 = 0 THEN CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END
           ELSE CASE WHEN z % 2 = 1 THEN xor(z // 2, 3988292384) ELSE z // 2 END END FROM x)
  FROM crc WHERE i < 8 * length(s)
),
h AS MATERIALIZED (SELECT conv_id, xor(c, 4294967295::BIGINT) % 9 AS h FROM crc WHERE i = 8 * length(s)),
seq AS MATERIALIZED (
  SELECT a.conv_id, list_concat(coalesce(b.turns[1:h], []), a.turns[h + 1:]) AS turns
  FROM said a JOIN h USING (conv_id) LEFT JOIN said b ON b.conv_id = a.conv_id - a.conv_id % 5
),
steps AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM seq),
paths AS MATERIALIZED (
  SELECT conv_id, depth, len(turns) AS size, array_to_string(list_transform(turns[1:depth], lambda x: x.t), '') AS path,
    CASE WHEN depth > 0 THEN array_to_string(list_transform(turns[1:depth - 1], lambda x: x.t), '') END AS up, CASE WHEN depth > 0 THEN turns[depth].n ELSE 0 END AS n
  FROM steps
),
nodes AS MATERIALIZED (
  SELECT path, any_value(up) AS up, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n,
    string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = depth) AS ends
  FROM paths GROUP BY path
),
kids AS MATERIALIZED (SELECT up AS path, count(*) AS k FROM nodes WHERE up IS NOT NULL GROUP BY up),
below AS (
  SELECT p.path, sum((u.n_convs - 1) * u.n) AS saved, count(*) FILTER (kids.k IS NULL) AS leaves
  FROM nodes u JOIN paths p ON p.conv_id = u.conv_id AND p.depth <= u.depth LEFT JOIN kids ON kids.path = u.path GROUP BY p.path
)
SELECT n.conv_id, n.depth, above.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.k, 0) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM nodes n JOIN below USING (path) LEFT JOIN kids ON kids.path = n.path LEFT JOIN nodes above ON above.path = n.up
"""
