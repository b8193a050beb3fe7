"""SimHash near-duplicates by the generalised pigeonhole principle.

The 64 bits are grouped into partitions so that correlated bits stand together. Every partition gets a threshold of its
own; the thresholds add up to radius - partitions + 1, so two fingerprints within the radius agree within its threshold
in at least one partition (a threshold of -1 leaves a partition out). Dynamic programming picks the number of partitions
and the thresholds of least cost: rows to probe plus candidates, which are estimated on a bounded sample and scaled to
the count of all distinct fingerprints. Any choice finds every link; the sample only decides what that costs.

Fingerprints are indexed under their partition values and probe all values within the threshold; what meets is verified
on all 64 bits. A bucket gives the edges of a spanning forest of its links, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import by_slices, fresh, lookup, saved, texts
from .components import components

BITS = 64
#: Relative costs of a probed row and of a candidate that is verified.
ROW_COST, CANDIDATE_COST = 1.0, 0.006


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles, repeats included; the whole sequence where there are fewer words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < width:
        return np.array([h(join(words), 42)], np.uint64)
    return np.array([h(join(s), 42) for s in zip(*(words[i:] for i in range(width)))], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 when it is set in over half the hashes; none: zero. Long documents are added up in blocks."""
    sums = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(sums * 2 > len(hashes), bitorder="little").view("<u8")[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(shingle_hashes(x, width)) for x in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return texts(docs, id_col, text_col).mapInArrow(by_slices(work), "doc_id long, fp long")


def grouped_bits(sample: np.ndarray, m: int) -> list[list[int]]:
    """Bits in m partitions of like size: each is seeded with the free bit of most correlation and takes those most
    correlated with it."""
    bits = (sample[:, None] >> np.arange(BITS, dtype=np.uint64) & np.uint64(1)).astype(float)
    bits -= bits.mean(0) if len(bits) else 0.5
    norm = np.sqrt((bits**2).sum(0))
    like = np.abs(bits.T @ bits) / np.maximum(np.outer(norm, norm), 1e-9)
    free, out = list(range(BITS)), []
    for size in (len(x) for x in np.array_split(np.arange(BITS), m)):
        part = [max(free, key=lambda b: (like[b, free].sum(), -b))]
        free.remove(part[0])
        while len(part) < size:
            part.append(max(free, key=lambda b: (like[b, part].sum(), -b)))
            free.remove(part[-1])
        out.append(sorted(part))
    return out


def partition_value(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.uint64)
    for k, b in enumerate(bits):
        out |= (fps >> np.uint64(b) & np.uint64(1)) << np.uint64(k)
    return out


def ball(n_bits: int, radius: int) -> np.ndarray:
    """All masks of n_bits with at most radius set."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(n_bits), r)], np.uint64)


def allocate(costs: list[list[float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds of least total cost that add up to budget; costs[i][t + 1] is that of threshold t in partition i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for k, c in enumerate(own):
                if (t := used + k - 1) not in step or cost + c < step[t][0]:
                    step[t] = (cost + c, [*chosen, k - 1])
        best = step
    return best[budget]


def plan_partitions(sample: np.ndarray, total: int, radius: int = 3) -> list[tuple[list[int], int]]:
    """[(bits, threshold)] of least estimated cost for `total` distinct fingerprints; those left out are not listed."""
    sample = sample if len(sample) else np.zeros(1, np.uint64)
    n = len(sample)
    options = []
    for m in range(2, radius + 2):
        parts, costs = grouped_bits(sample, m), []
        for bits in parts:
            v = partition_value(sample, bits)
            near = np.zeros(radius + 1)
            for at in range(0, len(v), 256):
                d = np.bitwise_count(v[at : at + 256, None] ^ v[None, :])
                near += [(d <= t).sum() for t in range(radius + 1)]
            # the sample's own share, and never under what evenly spread values would give
            size = [len(ball(len(bits), t)) for t in range(radius + 1)]
            share = [max((near[t] - n) / max(1, n * (n - 1)), size[t] / 2.0 ** len(bits)) for t in range(radius + 1)]
            costs.append([0.0] + [ROW_COST * (1 + (size[t] if t else 0)) + CANDIDATE_COST * share[t] * total for t in range(radius + 1)])
        options.append((*allocate(costs, radius - m + 1), parts))
    _, chosen, parts = min(options, key=lambda x: x[0])
    return [(bits, t) for bits, t in zip(parts, chosen, strict=True) if t >= 0]


def _forest(own: np.ndarray, probes: np.ndarray, radius: int, rest: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of one bucket. own: fingerprints filed under this key; probes: those that reach it
    by flipped bits. Links between two probes show elsewhere, but those found here are true as well.

    Up to `rest` nodes a node is compared with all that are unvisited; each is taken off that set once, so edges are fewer
    than nodes. A larger bucket is parted again: the bits in which its nodes differ are dealt into radius + 1 groups, of
    which two nodes within the radius share one at least, and nodes that share a group's value are a bucket of fewer bits."""
    left = np.unique(np.concatenate([own, probes]))
    edges: list[tuple[int, int]] = []
    if len(left) > max(rest, 64):
        differ = np.bitwise_or.reduce(left ^ left[0])
        bits = [b for b in range(BITS) if int(differ) >> b & 1]
        for k in range(radius + 1):
            value = partition_value(left, bits[k :: radius + 1])
            at = np.argsort(value, kind="stable")
            edge = np.flatnonzero(np.diff(value[at])) + 1
            for part in np.split(left[at], edge):
                if len(part) > 1:
                    edges += _forest(part, part[:0], radius, rest)
        return edges
    while len(left) > 1:
        seed, left = left[0], left[1:]
        front = [seed]
        while front and len(left):
            hit = np.bitwise_count(left ^ front.pop()) <= radius
            if hit.any():
                new = left[hit]
                edges += [(int(seed), int(y)) for y in new]
                front += list(new)
                left = left[~hit]
    return edges


def bucket_links(radius: int, rest: int = 2_048):
    """Rows (part, key, probe, fp) in order of part and key -> edges (a, b) as signed longs. One bucket is held at a
    time, as eight bytes a distinct fingerprint; small buckets are compared together, row with next row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def links(rows: np.ndarray) -> pa.RecordBatch:
            parent: dict[int, int] = {}

            def top(x: int) -> int:
                while (p := parent.setdefault(x, x)) != x:
                    parent[x] = x = parent.setdefault(p, p)
                return x

            starts = np.flatnonzero(np.r_[True, (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])])
            sizes = np.diff(np.r_[starts, len(rows)])
            bucket = np.repeat(np.arange(len(starts)), sizes)
            small = np.repeat(sizes <= 64, sizes)
            fps, kept = rows[small, 3].view(np.uint64), bucket[small]
            found: list[tuple[int, int]] = []
            for j in range(1, min(64, len(fps))):
                same = kept[j:] == kept[:-j]
                if not same.any():
                    break
                near = np.flatnonzero(same)
                near = near[np.bitwise_count(fps[near] ^ fps[near + j]) <= radius]
                found += zip(fps[near].tolist(), fps[near + j].tolist(), strict=True)
            for k in np.flatnonzero(sizes > 64):
                part = rows[starts[k] : starts[k] + sizes[k]]
                f = part[:, 3].view(np.uint64)
                found += _forest(f[part[:, 2] == 0], f[part[:, 2] == 1], radius, rest)
            out = []
            for a, b in found:
                if a != b and (x := top(a)) != (y := top(b)):
                    parent[max(x, y)] = min(x, y)
                    out.append((a, b))
            edges = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])

        for batch in batches:
            rows = np.ascontiguousarray(np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(4)], axis=1))
            if not len(rows):
                continue
            last = (rows[:, 0] == rows[-1, 0]) & (rows[:, 1] == rows[-1, 1])
            cut = len(rows) - int(np.argmin(last[::-1])) if not last.all() else 0
            if cut or (held and (held[0][0, :2] != rows[0, :2]).any()):
                done = np.concatenate([*held, rows[:cut]])
                held = [rows[cut:]]
                yield links(done)
            else:
                held.append(rows)
        if held:
            yield links(np.concatenate(held))

    return run


def near_links(fps: DataFrame, radius: int = 3, sample_size: int = 4096, hot: int = 1 << 18) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints (column fp) within radius bits, a spanning forest a bucket.

    A bucket of more than `hot` rows is dealt out over all tasks: of the bits outside its partition, in radius + 1 groups,
    two fingerprints within the radius share a group's value at least, so each group's values are buckets in its place."""
    total = fps.count()
    # the bounded sample that the cost estimate is fitted on
    picked = fps.select("fp").orderBy(F.xxhash64("fp")).limit(sample_size).collect() if total else []
    plan = plan_partitions(np.array([r[0] for r in picked], np.int64).view(np.uint64), total, radius)
    flips = [ball(len(bits), t)[1:] for bits, t in plan]

    def keys(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = batch.column(0).to_numpy().view(np.uint64)
        cols: list[list[np.ndarray]] = [[], [], [], []]
        for p, ((bits, _), masks) in enumerate(zip(plan, flips, strict=True)):
            v = partition_value(fp, bits)
            key = np.concatenate([v, (v[:, None] ^ masks[None, :]).ravel()])
            probe = np.r_[np.zeros(len(v), np.int8), np.ones(len(v) * len(masks), np.int8)]
            for c, x in zip(cols, (np.full(len(key), p, np.int32), key.view(np.int64), probe, np.concatenate([fp, np.repeat(fp, len(masks))]).view(np.int64)), strict=True):
                c.append(x)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["part", "key", "probe", "fp"])

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        part, key, probe, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
        cols: list[list[np.ndarray]] = [[], []]
        for k in range(radius + 1):
            value = np.zeros(len(fp), np.uint64)
            for p, (bits, _) in enumerate(plan):
                own = part == p
                value[own] = partition_value(fp[own].view(np.uint64), [b for b in range(BITS) if b not in bits][k :: radius + 1])
            # keys that meet by chance do no harm: what meets is verified on all bits
            mixed = key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + value * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(k)
            cols[0].append((part + len(plan) * (k + 1)).astype(np.int32))
            cols[1].append(mixed.view(np.int64))
        again = [np.tile(x, radius + 1) for x in (probe, fp)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols] + [pa.array(x) for x in again], names=["part", "key", "probe", "fp"])

    kind = "part int, key long, probe byte, fp long"
    probes = saved(fps.select("fp").mapInArrow(by_slices(keys, rows=4096), kind), "probes")
    crowded = saved(probes.groupBy("part", "key").count().filter(F.col("count") > hot).select("part", "key"), "probes-hot")
    if not crowded.isEmpty():  # fewer than rows / hot, so they are broadcast
        rest = probes.join(F.broadcast(crowded), ["part", "key"], "left_anti")
        dealt = probes.join(F.broadcast(crowded), ["part", "key"], "left_semi").select("part", "key", "probe", "fp").mapInArrow(by_slices(deal, rows=4096), kind)
        probes = rest.select(dealt.columns).unionByName(dealt)
    return probes.repartition("part", "key").sortWithinPartitions("part", "key").mapInArrow(bucket_links(radius), "a long, b long")


def _linked(docs: DataFrame, id_col: str, text_col: str, width: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of each row, and (fp, n, least_id, root, component_id) of each fingerprint."""
    prints = saved(fingerprints(docs, id_col, text_col, width), "fingerprints")
    nodes = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")), "nodes")
    roots = components(near_links(nodes, radius))
    of_node = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "n", "least_id", F.coalesce("root", "fp").alias("root"))
    classes = of_node.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return prints, saved(of_node.join(classes, "root").select("fp", "n", "least_id", "root", "component_id"), "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the least doc_id reachable by links of at
    most radius differing bits, its own included).

    Null, empty and wordless texts have the fingerprint zero, which links like any other. Equal fingerprints are one
    node, so that copies cost nothing beyond their first. Rows that repeat a doc_id are returned each. A null doc_id is
    never the least of a component that has others; a component of null ids alone has component_id null. An empty table
    gives an empty result. Other columns are not read.
    """
    prints, table = _linked(docs, id_col, text_col, width, radius)
    table = table.select("fp", "n", "component_id")
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return lookup(prints, table, "fp", "n", total).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """One row of each near-duplicate component, with all its columns: one that has the least doc_id and, where several
    rows do, the least fingerprint of theirs and then the longest text. So rows that share a doc_id or have none are told
    apart, and of those that are near duplicates one stays."""
    prints, table = _linked(docs, id_col, text_col, width, radius)
    first = table.filter(F.col("least_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("fp").alias("fp"), F.first("component_id").alias("id"))
    first = saved(first.select("id", "fp"), "first")
    again = saved(prints.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("id")), "again")
    key = docs[id_col].cast("long")
    if again.isEmpty():
        return docs.join(first, key == first["id"], "left_semi")
    alone = first.join(again, "id", "left_anti").filter("id IS NOT NULL")
    rows = docs.join(alone, key == alone["id"], "left_semi")
    shared = docs.join(again, key == again["id"], "left_semi").unionByName(docs.filter(key.isNull()))
    names, at, fp = docs.columns, docs.columns.index(text_col), fresh("_fp", docs)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(shingle_hashes(x or b"", width)) for x in batch.column(at).cast(pa.binary()).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps.view(np.int64))], names=[*names, fp])

    known = shared.mapInArrow(by_slices(work), StructType([*docs.schema.fields, StructField(fp, LongType())]))
    text = F.coalesce(F.col(text_col), F.lit(""))
    picked = known.groupBy(F.col(id_col).cast("long").alias("id"), F.col(fp).alias("fp")).agg(F.max_by(F.struct(*names), F.struct(F.char_length(text), text)).alias("row"))
    picked = picked.join(first.withColumnsRenamed({"id": "first_id", "fp": "first_fp"}), F.col("id").eqNullSafe(F.col("first_id")) & (F.col("fp") == F.col("first_fp")), "left_semi")
    return rows.unionByName(picked.select("row.*"))
