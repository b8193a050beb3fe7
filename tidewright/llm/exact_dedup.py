"""Exact de-duplication by a log-structured merge index.

Memtables in the tasks that read the documents collapse equal texts as they come and flush sorted digest runs. Merging
the runs, without any text, keeps the preferred (smallest) identifier of each digest and adds up the sizes; digests that
several runs hold are hits. Hits go into a sliced Bloom filter of bounded size, which every task gets: only texts that the
filter lets through are shuffled, for compaction, where a hit counts once its bytes have been compared; texts of one
digest that differ stay apart as variants of it. Beyond its bound the filter lets more texts through, and loses none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BYTES, fresh, lookup, saved, texts

RUNS = "digest binary, run string, variant int, rank long, best_id long, n long, body binary, doc_id long, text_sha256 string"
_RUNS = pa.schema([("digest", pa.binary()), ("run", pa.string()), ("variant", pa.int32()), ("rank", pa.int64()), ("best_id", pa.int64()), ("n", pa.int64()), ("body", pa.binary()), ("doc_id", pa.int64()), ("text_sha256", pa.string())])
INDEX = "digest binary, variant int, keep_id long, group_size long"
_INDEX = pa.schema([("digest", pa.binary()), ("variant", pa.int32()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


class Bloom:
    """A Bloom filter of digests; the digest's own bytes serve as its hashes."""

    def __init__(self, size: int = 8, bits: bytes | None = None):
        self.bits = bytearray(bits if bits is not None else size)

    def _places(self, digest: bytes) -> list[int]:
        a, b = int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:16], "little") | 1
        return [(a + i * b) % (8 * len(self.bits)) for i in range(5)]

    def add(self, digest: bytes) -> None:
        for p in self._places(digest):
            self.bits[p >> 3] |= 1 << (p & 7)

    def __contains__(self, digest: bytes) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self._places(digest))


def _better(a: tuple[int, int | None], b: tuple[int, int | None]) -> bool:
    """Whether a is preferred to b: smaller rank, then the smaller identifier; a null identifier comes last."""
    return (a[0], a[1] is None, a[1] or 0) < (b[0], b[1] is None, b[1] or 0)


def normalised(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 without the contract's white space."""
    return [x.translate(None, SPACE_BYTES) for x in column.cast(pa.binary()).to_pylist()]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types, strict=True)], schema=schema)


def memtables(digest_bytes: int, limit_bytes: int, hits: list[bytes] | None = None):
    """Documents -> sorted runs. A memtable is flushed at limit_bytes of texts, so a task's memory is bounded.

    Without hits (slices of the filter) each document also gives a row of its digest, and runs carry no texts; with them,
    only documents that the filter lets through are taken, and runs carry the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[bytes, list[list]] = {}
        held, flushed = 0, 0
        task, pack = TaskContext.get(), zstandard.ZstdCompressor(level=1)
        filters = [Bloom(bits=b) for b in hits] if hits else None

        def flush() -> Iterator[pa.RecordBatch]:
            name = f"{task.partitionId() if task else 0}-{flushed}"
            rows = [(d, name, v, rank, best, n, pack.compress(body) if filters else None, None, None) for d in sorted(table) for v, (body, rank, best, n) in enumerate(table[d])]
            for at in range(0, len(rows), 2000):
                yield _batch(rows[at : at + 2000], _RUNS)

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, points, bodies = part.column(0).to_pylist(), pc.utf8_length(part.column(1)).to_pylist(), normalised(part.column(1))
                hashed = list(map(hashlib.sha256, bodies))
                digests = [h.digest()[:digest_bytes] for h in hashed]
                if filters is None:
                    none = [pa.nulls(len(ids), t) for t in _RUNS.types[1:7]]
                    yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), *none, part.column(0), pa.array([h.hexdigest() for h in hashed])], schema=_RUNS)
                for i, n, body, digest in zip(ids, points, bodies, digests, strict=True):
                    if filters and digest not in filters[crc32(digest) % len(filters)]:
                        continue
                    for entry in (variants := table.setdefault(digest, [])):
                        if entry[0] == body:  # the byte check of a hit
                            if _better((-n, i), (entry[1], entry[2])):
                                entry[1:3] = -n, i
                            entry[3] += 1
                            break
                    else:
                        variants.append([body, -n, i, 1])
                        held += len(body) + 200
                if held >= limit_bytes:
                    yield from flush()
                    table, held, flushed = {}, 0, flushed + 1
        if table:
            yield from flush()

    return run


def hit_filter(hits: DataFrame, slices: int, most_bytes: int = 32 << 20) -> list[bytes]:
    """A Bloom filter of the digests, in slices that are built where they lie: ten bits a digest, most_bytes in all."""
    size = min(most_bytes // slices, hits.count() * 13 // 8 // slices + 64)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Bloom] = {}
        for batch in batches:
            for k, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                made.setdefault(k, Bloom(size)).add(digest)
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int64()), pa.array([bytes(f.bits) for f in made.values()], pa.binary())], names=["slice", "bits"])

    keyed = hits.select((F.crc32("digest") % slices).alias("slice"), "digest").repartition("slice")
    found = {r["slice"]: bytes(r["bits"]) for r in keyed.mapInArrow(build, "slice long, bits binary").collect()}  # at most most_bytes
    return [found.get(k, bytes(8)) for k in range(slices)]


def compacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs in order of digest -> index rows. It streams: the texts of one digest are held at a time, each once."""
    unpack, out = zstandard.ZstdDecompressor(), []
    digest, entries = None, []

    def close() -> None:
        out.extend((digest, v, best, n) for v, (_, _, best, n) in enumerate(entries))

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("digest", "rank", "best_id", "n", "body")]
        for d, rank, best, n, body in zip(*columns, strict=True):
            if d != digest:
                if digest is not None:
                    close()
                digest, entries = d, []
            for entry in entries:
                if entry[0] == body or unpack.decompress(entry[0]) == unpack.decompress(body):  # the byte check
                    if _better((rank, best), (entry[1], entry[2])):
                        entry[1:3] = rank, best
                    entry[3] += n
                    break
            else:
                entries.append([body, rank, best, n])
            if len(out) >= 4000:
                yield _batch(out, _INDEX)
                out.clear()
    if digest is not None:
        close()
    if out:
        yield _batch(out, _INDEX)


def build_index(docs: DataFrame, digest_bytes: int = 32, memtable_bytes: int = 24 << 20, slices: int = 64) -> tuple[DataFrame, DataFrame]:
    """The compacted index (digest, variant, keep_id, group_size) of (doc_id, text), and (doc_id, digest, text_sha256) of
    every row."""
    first = saved(docs.mapInArrow(memtables(digest_bytes, memtable_bytes), RUNS).drop("body"), "exact-runs")
    light = first.filter("text_sha256 IS NOT NULL").select("doc_id", "digest", "text_sha256")
    best = F.min(F.struct("rank", F.col("best_id").isNull(), "best_id")).getField("best_id")
    runs = first.filter("text_sha256 IS NULL").groupBy("digest").agg(F.count("*").alias("entries"), best.alias("keep_id"), F.sum("n").alias("group_size"))
    merged = saved(runs, "exact-merged")
    once, hits = merged.filter("entries = 1").select("digest", F.lit(0).alias("variant"), "keep_id", "group_size"), merged.filter("entries > 1").select("digest")
    if hits.isEmpty():
        return once, light
    met = docs.mapInArrow(memtables(digest_bytes, memtable_bytes, hit_filter(hits, slices)), RUNS).select("digest", "run", "variant", "rank", "best_id", "n", "body")
    checked = met.repartition("digest").sortWithinPartitions("digest", "run", "variant").mapInArrow(compacted, INDEX).join(hits, "digest", "left_semi")
    return saved(once.unionByName(checked), "exact-index"), light


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32, memtable_bytes: int = 24 << 20, buckets: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without white space. Of equal texts the one with the most code points stays,
    then the smallest doc_id. Null and empty texts, and those of white space alone, form one group. A null doc_id loses
    against any other. Rows that repeat a doc_id and its text are counted and returned each; all of them are kept when
    that doc_id is, as nothing tells them apart. An empty table gives an empty result. Other columns are not read. buckets:
    slices of the filter.
    """
    docs = texts(docs, id_col, text_col)
    index, light = build_index(docs, digest_bytes, memtable_bytes, buckets)
    total = index.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    collided = index.filter("variant > 0").select("digest").distinct()
    if collided.isEmpty():
        found = lookup(light, index.drop("variant"), "digest", "group_size", total)
    else:  # different texts under one digest: theirs is settled by the texts themselves
        found = lookup(light, index.join(collided, "digest", "left_anti").drop("variant"), "digest", "group_size", total)
        body = docs.select("doc_id", F.regexp_replace("text", r"[\x20\x09-\x0D]", "").alias("body"), F.char_length("text").alias("n"))
        digest = F.substring(F.unhex(F.sha2(F.col("body").cast("binary"), 256)), 1, digest_bytes)
        body = body.withColumn("digest", digest).join(collided, "digest", "left_semi")
        best = body.groupBy("body").agg(F.min(F.struct(-F.col("n"), F.col("doc_id").isNull(), "doc_id")).getField("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        rest = body.join(best, "body").withColumn("text_sha256", F.sha2(F.col("body").cast("binary"), 256))
        found = found.unionByName(rest.select(found.columns))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, with all its columns: that which exact_dedup keeps. Rows that share a doc_id,
    or have none, are told apart by their texts; of rows alike in doc_id and text without white space the longest stays,
    of those the one of the largest text and, at last, of the largest hash of all columns."""
    i, h, sha, own, row = (fresh(n, docs) for n in ("_i", "_h", "_sha", "_own", "_row"))
    found = saved(exact_dedup(docs, id_col, text_col).select(F.col("doc_id").alias(i), "kept", F.col("text_sha256").alias(h)), "exact-found")
    shared = saved(found.groupBy(i).count().filter(f"count > 1 OR {i} IS NULL").select(i), "exact-shared")
    stays, key = found.filter("kept").select(i, h), docs[id_col].cast("long")
    if shared.isEmpty():
        return docs.join(stays, key == stays[i], "left_semi")
    alone = stays.join(shared, i, "left_anti").filter(F.col(i).isNotNull())
    rows = docs.join(alone, key == alone[i], "left_semi")
    some = docs.join(shared, key == shared[i], "left_semi").unionByName(docs.filter(key.isNull()))
    text = F.coalesce(F.col(text_col), F.lit(""))
    some = some.select(F.struct(*docs.columns).alias(row), text.alias("_t"), F.xxhash64(*docs.columns).alias("_x"), F.col(id_col).cast("long").alias(own), F.sha2(F.regexp_replace(text, r"[\x20\x09-\x0D]", "").cast("binary"), 256).alias(sha))
    # a row of each doc_id and text is picked in the tasks before anything is shuffled
    picked = some.groupBy(own, sha).agg(F.max_by(row, F.struct(F.char_length("_t"), "_t", "_x")).alias(row))
    picked = picked.join(stays.distinct(), F.col(own).eqNullSafe(F.col(i)) & (F.col(sha) == F.col(h)), "left_semi")
    return rows.unionByName(picked.select(f"{row}.*"))
