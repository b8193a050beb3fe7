"""Prefix trie of conversations: padded matrices of turn ids, sorted, with a mask of column changes.

Conversations are dealt out by ranges of their sequences of turns. A shard numbers its turns, sorts the padded matrix
whose rows are conversations and whose columns are turns, and compares each row with the one before: the changes,
accumulated along the columns by OR, say at which depths a row starts a node, and sums between starts give every
depth its numbers. Only nodes on the path of a shard's first or last row can go on in another shard. Those meet by key
afterwards: sums of what each shard has of them, and for what the nodes below add, running sums along each path, in which
a node counts on one path alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup, saved

EMPTY = hashlib.sha256().hexdigest()
_PARTS = "kind int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, key binary, parent_key binary, words long, shard long, side int, text string"
_NAMES = [c.split()[0] for c in _PARTS.split(", ")]
_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
_TYPES = [_KINDS[c.split()[1]] for c in _PARTS.split(", ")]
_INNER, _BELOW, _EDGE, _ENDS = range(4)


def rebuilt(conversations: DataFrame, family: int = 20, heads: int = 4) -> DataFrame:
    """(conv_id, path, words): the turns of each rebuilt conversation, as 16 bytes of a digest of role and text each, and the
    words of their texts. The first h = crc32(conv_id) mod `heads` turns come from conversation conv_id - conv_id % family.

    Null role and text are empty, null turns first; equal turn numbers go by digest, so that repeated rows follow each other.
    Rows without conv_id belong to no conversation. Negative ids: % takes the sign of the id, as in SQL."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    words = F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("int")
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", digest.alias("digest"), words.alias("words")).alias("row"))
    own = saved(rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("turns")), "turns")
    first = own.filter(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("root"), F.slice("turns", 1, heads - 1).alias("head"))
    both = own.withColumn("root", F.expr(f"conv_id - conv_id % {family}")).withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")).join(first, "root", "left")
    rest = F.slice("turns", F.col("h") + 1, F.size("turns"))
    both = both.select("conv_id", F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0)), rest).alias("t"))
    return both.select("conv_id", F.unhex(F.array_join(F.transform("t", lambda x: F.hex(x["digest"])), "")).alias("path"), F.expr("t.words").alias("words"))


class Matrix:
    """Sequences of turn ids as rows of a matrix padded by -1, made `width` columns at a time of the rows that reach them."""

    def __init__(self, lengths: np.ndarray, digests: np.ndarray, width: int = 64):
        """digests: an unsigned pair for each turn, row after row; equal pairs get equal ids, in order of the pairs."""
        self.lengths, self.width = lengths, width
        self.first = np.cumsum(lengths) - lengths
        order = np.lexsort((digests[:, 1], digests[:, 0]))
        new = np.append(False, (digests[order[1:]] != digests[order[:-1]]).any(axis=1))[: len(order)]
        self.ids = np.empty(len(order), np.int64)
        self.ids[order] = np.cumsum(new)

    def block(self, rows: np.ndarray, start: int) -> np.ndarray:
        cols = start + np.arange(self.width)
        inside = cols < self.lengths[rows][:, None]
        return np.where(inside, self.ids[np.where(inside, self.first[rows][:, None] + cols, 0)], -1) if len(self.ids) else np.full(inside.shape, -1)

    def starts(self) -> range:
        return range(0, int(self.lengths.max(initial=0)), self.width)

    def sort(self, last_key: np.ndarray) -> np.ndarray:
        """Order of the rows, ties by last_key: blocks from the last to the first, each stable. A row that ends before a
        block is padding there, which comes first."""
        order = np.argsort(last_key, kind="stable")
        for start in reversed(self.starts()):
            reach = self.lengths[order] > start
            rows = order[reach]
            order = np.concatenate([order[~reach], rows[np.lexsort(self.block(rows, start).T[::-1])]])
        return order

    def shared(self, order: np.ndarray) -> np.ndarray:
        """How many leading turns each row shares with the row before; -1 for the first."""
        out = np.zeros(len(order), np.int64)
        most = np.minimum(self.lengths[order[1:]], self.lengths[order[:-1]])
        for start in self.starts():
            at = 1 + np.flatnonzero((out[1:] == start) & (most > start))
            changed = np.logical_or.accumulate(self.block(order[at], start) != self.block(order[at - 1], start), axis=1)
            out[at] += (~changed).sum(axis=1)
            out[1:] = np.minimum(out[1:], most)
        out[:1] = -1
        return out


def _chain(path: bytes) -> list[bytes]:
    """Keys of the nodes of a path, from the root on."""
    keys = [b"\0" * 16]
    for at in range(0, len(path), 16):
        keys.append(hashlib.sha256(keys[-1] + path[at : at + 16]).digest()[:16])
    return keys


def _shard(conv: np.ndarray, paths: list[bytes], words: np.ndarray, shard: int, most: int = 4096) -> Iterator[dict[str, list]]:
    """Columns of parts: nodes that are done, those below an edge, edges (nodes that other shards may have too), and the ids
    that end at edges, up to `most` in a row."""
    lengths = np.array([len(p) // 16 for p in paths], np.int64)
    digests = np.frombuffer(b"".join(paths), ">u8").astype(np.uint64).reshape(-1, 2)
    matrix = Matrix(lengths, digests)
    order = matrix.sort(conv)
    shared = matrix.shared(order)
    conv, size, offset = conv[order], lengths[order], matrix.first[order]
    n_rows = len(conv)
    edges = [_chain(paths[order[k]]) for k in (0, -1)]
    by_size = np.argsort(-size, kind="stable")
    reach = np.searchsorted(-size[by_size], -np.arange(int(size.max()) + 1), "right")
    leaf, spared = np.zeros(n_rows, np.int64), np.zeros(n_rows, np.int64)
    found: list[dict] = []
    for depth in range(int(size.max()), -1, -1):
        rows = np.sort(by_size[: reach[depth]])
        at = np.flatnonzero(shared[rows] < depth)
        start = rows[at]
        n = np.diff(np.append(at, len(rows)))
        edge = np.zeros(len(at), bool)
        edge[0] |= start[0] == 0
        edge[-1] |= rows[-1] == n_rows - 1
        below = (size[rows] > depth) & (shared[rows] <= depth)
        children = np.add.reduceat(below.astype(np.int64), at)
        last = words[offset[start] + depth - 1] if depth else np.zeros(len(at), np.int64)
        leaf[start[(children == 0) & ~edge]] += 1
        spared[start[~edge]] += ((n - 1) * last)[~edge]
        ends = np.add.reduceat((size[rows] == depth).astype(np.int64), at)
        found.append({"start": start, "n": n, "edge": edge, "children": children, "words": last, "conv": np.minimum.reduceat(conv[rows], at), "leaves": np.add.reduceat(leaf[rows], at), "saved": np.add.reduceat(spared[rows], at), "ends": ends})
    found.reverse()

    for depth, x in enumerate(found):
        up = found[depth - 1] if depth else None
        parent = np.searchsorted(up["start"], x["start"], "right") - 1 if depth else np.zeros(1, np.int64)
        done = np.flatnonzero(~x["edge"])
        if len(done):
            sha = [hashlib.sha256(",".join(map(str, conv[s : s + e].tolist())).encode()).hexdigest() if e else EMPTY for s, e in zip(x["start"][done].tolist(), x["ends"][done].tolist(), strict=True)]
            over = up["edge"][parent[done]]
            keys = [edges[0 if p == 0 and up["start"][0] == 0 else 1][depth - 1] if o else None for p, o in zip(parent[done].tolist(), over.tolist(), strict=True)]
            yield {
                "kind": np.where(over, _BELOW, _INNER).tolist(), "conv_id": x["conv"][done].tolist(), "depth": [depth] * len(done), "parent_conv_id": [None if o else c for o, c in zip(over.tolist(), up["conv"][parent[done]].tolist(), strict=True)],
                "n_convs": x["n"][done].tolist(), "n_children": x["children"][done].tolist(), "n_leaves": x["leaves"][done].tolist(), "saved_tokens": x["saved"][done].tolist(), "ends_sha256": sha, "parent_key": keys,
            }
        for side, k, on in ((0, 0, depth <= size[0]), (1, len(x["n"]) - 1, depth <= size[-1])):
            if not on:
                continue
            one = {"kind": _EDGE, "depth": depth, "key": edges[side][depth], "parent_key": edges[side][depth - 1] if depth else None, "words": int(x["words"][k]), "shard": shard, "side": side, "n_convs": 0, "n_children": 0, "n_leaves": 0, "saved_tokens": 0}
            if side and x["start"][k] == 0:  # the first row's path has it too, and its numbers with it
                yield {c: [v] for c, v in one.items()}
                continue
            inner = int(x["children"][k])
            if depth + 1 < len(found):
                y = found[depth + 1]
                inner -= int(((np.searchsorted(x["start"], y["start"], "right") - 1 == k) & y["edge"]).sum())
            one |= {"conv_id": int(x["conv"][k]), "n_convs": int(x["n"][k]), "n_children": inner, "n_leaves": int(x["leaves"][k]), "saved_tokens": int(x["saved"][k])}
            yield {c: [v] for c, v in one.items()}
            first, many = int(x["start"][k]), int(x["ends"][k])
            for low in range(0, many, most):
                text = ",".join(map(str, conv[first + low : first + min(low + most, many)].tolist()))
                yield {"kind": [_ENDS], "key": [one["key"]], "shard": [shard], "n_convs": [low], "text": [text]}


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    if table is None or not table.num_rows:
        return
    words = pa.chunked_array(table.column("words")).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    held: dict[str, list] = {c: [] for c in _NAMES}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held[c], t) for c, t in zip(_NAMES, _TYPES, strict=True)], names=_NAMES)

    for part in _shard(table.column("conv_id").to_numpy(), table.column("path").to_pylist(), words, TaskContext.get().partitionId()):
        n = len(part["kind"])
        for c in _NAMES:
            held[c] += part.get(c, [None] * n)
        if len(held["kind"]) >= 20_000:
            yield out()
            held = {c: [] for c in _NAMES}
    yield out()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends_sha256) of rows in order of key: the texts of a key, joined by commas, go through its digest as they come."""
    key, digest = None, None
    for batch in batches:
        done = []
        for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key:
                if digest:
                    done.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256(text.encode())
            else:
                digest.update(b"," + text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.binary(), pa.string()))], names=["key", "ends_sha256"])
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])


def prefix_trie(conversations: DataFrame, turns_a_shard: int = 1 << 20, family: int = 20, heads: int = 4) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Nodes are the distinct sequences of the first d turns of rebuilt conversations (see rebuilt, also for nulls and ties).
    Conversations that are equal end at one node; one without turns ends at the root. A table without conversations has no
    node. Columns other than conv_id, turn, role and text are not read. A conversation is a row of a matrix: its turns, 30
    bytes each, are held by one task; conversations that are alike, however many, are dealt out over shards."""
    convs = saved(rebuilt(conversations, family, heads), "rebuilt")
    spark = convs.sparkSession
    turns = convs.agg(F.sum(F.size("words"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // turns_a_shard))
    parts = saved(convs.repartitionByRange(shards, "path", "conv_id").mapInArrow(_shards, _PARTS), "trie-parts")

    rows = parts.filter(F.col("kind") == _EDGE)
    place = F.struct("shard", "side")
    edges = rows.groupBy("key", "parent_key", "depth", "words").agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("inner"), F.min(place).alias("owner"))
    kids = edges.groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("outer"))
    edges = edges.join(kids, "key", "left").withColumn("n_children", F.expr("inner + coalesce(outer, 0)"))
    edges = saved(edges, "trie-edges")
    own = edges.select("key", "owner", F.when(F.col("n_children") == 0, 1).otherwise(0).alias("leaf"), F.expr("(n_convs - 1) * words").alias("spared"))
    mine = place == F.col("owner")
    down = Window.partitionBy("shard", "side").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    along = rows.select("key", "shard", "side", "depth", "n_leaves", "saved_tokens").join(own, "key")
    along = along.select("key", *((F.col(c) + F.sum(F.when(mine, F.col(x)).otherwise(0)).over(down)).alias(c) for c, x in (("n_leaves", "leaf"), ("saved_tokens", "spared"))))
    sums = along.groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    ends = parts.filter(F.col("kind") == _ENDS).select("key", "shard", F.col("n_convs").alias("low"), "text")
    ends = ends.repartition("key").sortWithinPartitions("key", "shard", "low").select("key", "text").mapInArrow(_hashed, "key binary, ends_sha256 string")
    above = edges.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"), "inner")
    result = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    outer = edges.join(sums, "key").join(ends, "key", "left").fillna(EMPTY, ["ends_sha256"]).join(above.drop("inner"), "parent_key", "left")
    below = lookup(parts.filter(F.col("kind") == _BELOW).drop("parent_conv_id"), above.filter("inner > 0"), "parent_key", "inner", int(edges.agg(F.sum("inner")).first()[0] or 0))
    return parts.filter(F.col("kind") == _INNER).select(*result).unionByName(below.select(*result)).unionByName(outer.select(*result))
