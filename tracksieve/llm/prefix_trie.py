"""Prefix trie of conversations by vertical bitmaps, built in shards and merged by node.

A conversation is a sequence of turns; a node is a distinct sequence of first turns, and the
conversations that start with it are its members.  Conversations in id order are cut into
shards of at most ``SHARD`` of them (and ``TURNS`` turns).  A shard maps (position, turn) to a
bitset of its conversations; going down, the intersection of a node's bitset with the posting
of its first uncovered member's next turn is a child, and population counts are member counts.

Shards know their own nodes only.  Nodes of one path (equal 128-bit path hash) are merged:
members add up, and the first shard that has a node owns it.  A node's ancestors are in every
shard that has the node, so sums over subtrees add up over shards if each node counts for its
owner alone: the merged facts go back to the shards, which sum their trees bottom up.

Shards are ranges of ids in ascending order, so the ids that end at a node are the shards'
lists one after the other; they are hashed as they stream by.  A node takes one row from a
shard, however many members it has: no frequent turn or conversation is a hot key.

Cases: rows with a null id belong to no conversation; null roles and texts count as empty; null
turns come first, equal turns are ordered by the hash of role and text; repeated rows are turns
of their own; a table without a conversation gives an empty table; other columns are not passed
on, so none can clash.  A conversation is held as one row of 20 bytes a turn; texts are not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksieve.llm.workspace import stored, table

SHARD = 4096
TURNS = 1 << 18
EMPTY_HASH = hashlib.sha256(b"").hexdigest()
_NODE = "node binary, parent binary, depth int, shard long, conv {id}, members long, size long, inner boolean, ends string"


def sequences(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turns) with turns = array of (key, size): hash of role and text, code points of the text."""
    who, what = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    key = F.unhex(F.md5(F.concat(F.length(who).cast("string"), F.lit(":"), who, what)))
    rows = df.filter(F.col(conv).isNotNull()).select(
        F.col(conv).alias("conv"), F.struct(F.col(turn).alias("at"), key.alias("key"), F.length(what).alias("size")).alias("one"))
    return rows.groupBy("conv").agg(F.sort_array(F.collect_list("one")).alias("all")).select(
        "conv", F.transform("all", lambda t: F.struct(t["key"].alias("key"), t["size"].alias("size"))).alias("turns"))


def rebuild(seqs: DataFrame, own: Column, base: Column, most: int) -> DataFrame:
    """Each conversation with its first ``own`` turns (at most ``most``) replaced by those of the conversation ``base``, where there is one."""
    seqs = stored(seqs.withColumns({"own": own.cast("int"), "base": base}), "sequences")
    starts = seqs.join(seqs.select(F.col("base").alias("conv")).distinct(), "conv", "left_semi").select(
        F.col("conv").alias("base"), F.slice("turns", 1, most).alias("first"))
    none = F.array().cast(dict(seqs.dtypes)["turns"])
    return seqs.join(starts, "base", "left").select("conv", F.concat(
        F.coalesce(F.slice("first", F.lit(1), F.col("own")), none), F.slice("turns", F.col("own") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def shard_nodes(ids: list, seqs: list[list[tuple[bytes, int]]]) -> Iterator[tuple]:
    """(node, parent, depth, first id, members, size, inner, ends) of every node of one shard; ids ascend."""
    postings: dict[tuple[int, bytes], int] = {}
    going: list[int] = []  # by position: the conversations that have a turn there
    for i, seq in enumerate(seqs):
        for at, (key, _) in enumerate(seq):
            postings[at, key] = postings.get((at, key), 0) | 1 << i
            if at == len(going):
                going.append(0)
            going[at] |= 1 << i
    stack = [(hashlib.blake2b(b"", digest_size=16).digest(), None, 0, (1 << len(ids)) - 1, 0)]
    while stack:
        node, parent, depth, members, size = stack.pop()
        rest = members & going[depth] if depth < len(going) else 0
        over = members & ~rest
        first = (members & -members).bit_length() - 1
        ended = []
        while over:
            low = over & -over
            ended.append(str(ids[low.bit_length() - 1]))
            over ^= low
        yield node, parent, depth, ids[first], members.bit_count(), size, bool(rest), ",".join(ended) if ended else None
        while rest:
            key, length = seqs[(rest & -rest).bit_length() - 1][depth]
            child = members & postings[depth, key]
            rest &= ~child
            stack.append((hashlib.blake2b(node + key, digest_size=16).digest(), node, depth + 1, child, length))


def _nodes(seqs: DataFrame, shard: int, turns: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, held, count = TaskContext.get().partitionId() << 32, [], [], 0

        def rows() -> Iterator[pa.RecordBatch]:
            found = list(shard_nodes(ids, held))
            node, parent, depth, conv, members, size, inner, ends = zip(*found)
            yield pa.RecordBatch.from_arrays([
                pa.array(node, pa.binary()), pa.array(parent, pa.binary()), pa.array(depth, pa.int32()), pa.array([number] * len(found), pa.int64()), pa.array(conv, id_type),
                pa.array(members, pa.int64()), pa.array(size, pa.int64()), pa.array(inner, pa.bool_()), pa.array(ends, pa.string())],
                ["node", "parent", "depth", "shard", "conv", "members", "size", "inner", "ends"])

        for batch in batches:
            id_type = batch.schema.field("conv").type
            for conv, keys, sizes in zip(batch.column("conv").to_pylist(), batch.column("keys").to_pylist(), batch.column("sizes").to_pylist()):
                if ids and (len(ids) >= shard or count + len(keys) > turns):
                    yield from rows()
                    number, ids, held, count = number + 1, [], [], 0
                ids.append(conv)
                held.append(list(zip(keys, sizes)))
                count += len(keys)
        if ids:
            yield from rows()

    flat = seqs.select("conv", F.col("turns.key").alias("keys"), F.col("turns.size").alias("sizes"))
    return flat.repartitionByRange("conv").sortWithinPartitions("conv").mapInArrow(run, _NODE.format(id=dict(flat.dtypes)["conv"]))


def _sum_trees(rows: pa.Table) -> pa.Table:
    """Facts of one shard's nodes: sums over the subtrees count the nodes that this shard owns."""
    node, parent = rows.column("node").to_pylist(), rows.column("parent").to_pylist()
    place = {n: i for i, n in enumerate(node)}
    up = np.array([-1 if p is None else place[p] for p in parent], dtype=np.int64)
    depth, owned = rows.column("depth").to_numpy(), rows.column("owner").to_numpy() == rows.column("shard").to_numpy()
    all_members = rows.column("all_members").to_numpy()
    leaves = (owned & ~rows.column("any_inner").to_numpy(zero_copy_only=False)).astype(np.int64)
    saved = np.where(owned, (all_members - 1) * rows.column("size").to_numpy(), 0)
    children = np.zeros(len(node), dtype=np.int64)
    np.add.at(children, up[owned & (up >= 0)], 1)
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)
    for level in levels[:0:-1]:
        np.add.at(leaves, up[level], leaves[level])
        np.add.at(saved, up[level], saved[level])
    conv = rows.column("first_conv").combine_chunks()
    return pa.table({
        "node": rows.column("node"), "depth": rows.column("depth"), "conv": conv, "parent_conv": conv.take(pa.array(up, pa.int64(), mask=up < 0)),
        "members": rows.column("all_members"), "children": pa.array(children), "leaves": pa.array(leaves), "saved": pa.array(saved)})


def _end_hashes(nodes: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes at which conversations end: the shards' lists in order, hashed as they stream by."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None
        for batch in batches:
            done = []
            for node, ends in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist()):
                if node == last:
                    digest.update(b",")
                else:
                    if last is not None:
                        done.append((last, digest.hexdigest()))
                    last, digest = node, hashlib.sha256()
                digest.update(ends.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.binary()), pa.array([h for _, h in done])], ["node", "ends_sha256"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([digest.hexdigest()])], ["node", "ends_sha256"])

    rows = nodes.filter(F.col("ends").isNotNull()).select("node", "shard", "ends")
    return rows.repartition("node").sortWithinPartitions("node", "shard").mapInArrow(run, "node binary, ends_sha256 string")


def trie(seqs: DataFrame, conv: str = "conv_id", shard: int = SHARD, turns: int = TURNS) -> DataFrame:
    """One row per node of the trie of (conv, turns): smallest member, depth, the parent's smallest member and counts."""
    nodes = stored(_nodes(seqs, shard, turns), "nodes")
    merged = nodes.groupBy("node").agg(F.min("shard").alias("owner"), F.min("conv").alias("first_conv"), F.sum("members").alias("all_members"), F.max("inner").alias("any_inner"))
    facts = nodes.select("node", "parent", "depth", "shard", "size").join(merged, "node")
    kind = dict(nodes.dtypes)["conv"]
    summed = facts.groupBy("shard").applyInArrow(
        _sum_trees, f"node binary, depth int, conv {kind}, parent_conv {kind}, members long, children long, leaves long, saved long")
    whole = summed.groupBy("node").agg(
        F.min("conv").alias(conv), F.min("depth").cast("long").alias("depth"), F.min("parent_conv").alias(f"parent_{conv}"), F.min("members").alias("n_convs"),
        F.sum("children").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    return whole.join(_end_hashes(nodes), "node", "left").drop("node").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_HASH)))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, each with its first turns taken from the first conversation of its hundred."""
    seqs = sequences(table(spark, sf_dir, "conversations"))
    conv = F.col("conv")
    return trie(rebuild(seqs, F.crc32(conv.cast("string")) % 6, conv - conv % 100, 5))


ORACLE = f"""WITH tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i))),
own AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS seq FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
cut AS (SELECT conv_id, seq, xor(list_reduce([4294967295] || list_transform(range(1, length(s) + 1), lambda k: ascii(s[k])::BIGINT),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 6 AS h FROM (SELECT *, conv_id::VARCHAR AS s FROM own), tab),
reb AS (SELECT c.conv_id, coalesce(b.seq[1:h], []) || c.seq[h + 1:] AS seq FROM cut c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100),
pre AS (SELECT conv_id, depth, seq[1:depth] AS p, depth = len(seq) AS over FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS depth FROM reb)),
node AS MATERIALIZED (SELECT p, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE over)), '{EMPTY_HASH}') AS ends_sha256 FROM pre GROUP BY p, depth),
kids AS (SELECT p[1:depth - 1] AS p, depth - 1 AS depth, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL),
fact AS MATERIALIZED (SELECT node.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(p[depth].t) END AS own_saved FROM node LEFT JOIN kids USING (p, depth)),
sums AS (SELECT p, depth, sum(leaf)::BIGINT AS n_leaves, sum(own_saved)::BIGINT AS saved_tokens
    FROM (SELECT p[1:up] AS p, up AS depth, leaf, own_saved FROM (SELECT *, (n_children = 0)::INT AS leaf, unnest(range(0, depth + 1)) AS up FROM fact)) GROUP BY ALL)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
FROM fact f JOIN sums s ON s.p = f.p AND s.depth = f.depth LEFT JOIN node u ON u.depth = f.depth - 1 AND u.p = f.p[1:f.depth - 1]"""
