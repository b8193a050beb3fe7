"""Best-fit packing of tokenised documents into sequences by exact-complement hashing.

Only counts per length decide where pieces go, and there are no more lengths than a sequence has tokens: the histogram
is gathered and the plan made on the driver, whatever the size of the corpus. The sums of one, two and three available
lengths are indexed; longest lengths first, gaps are filled exactly by one, then by two, then by three pieces, and such a
combination is used up as often as the counts allow. What has no complement goes by best fit, longest first. The plan is a short list of slots
(length, range of ranks) -> (sequences, offset), and each piece finds its slot by its rank among pieces of its length.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, texts

CAPACITY = 2048
END = 0
SPECIAL = "<|endoftext|>"
#: A single space between two characters that aren't white space always begins a new pre-token.
_CUT = re.compile(r"(?<=\S) (?=\S)")


class ByteBpe:
    """Token ids of byte_bpe_50k.json, as little-endian 32-bit words. Texts are cut where the pre-tokenizer always cuts,
    and the ids of the cut words are kept for words that come again; new ones go through the merge ranks of the same
    vocabulary. A text that holds a special token's name goes through the tokenizer itself."""

    def __init__(self, path: str, ranks_path: str, pattern: str, keep: int = 400_000):
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.whole = Tokenizer.from_file(path)
        self.kept: dict[str, bytes] = {}
        self.keep = keep

    def ids(self, text: str) -> bytes:
        if SPECIAL in text:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = _CUT.split(text)
        kept, out = self.kept, [np.array(self.fast(first), "<u4").tobytes()]
        if len(kept) > self.keep:
            kept.clear()
        for w in rest:
            own = kept.get(w)
            if own is None:
                own = np.array(self.fast(" " + w), "<u4").tobytes()
                if len(w) < 64:
                    kept[w] = own
            out.append(own)
        return b"".join(out)


def default_tokenizer() -> tuple[str, str, str]:
    """Paths and pre-tokenizer pattern of the public 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def piece_bounds(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole sequences from the end, so that only the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def pieces(docs: DataFrame, tokenizer: tuple[str, str, str] | None = None, capacity: int = CAPACITY, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenised pieces of every whole text; task and nth number the pieces of a length within a task. keep_ids adds the
    ids themselves. A null or empty text is the end mark alone."""
    paths = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, task, seen = ByteBpe(*paths), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                cols: list[list] = [[] for _ in range(8)]
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = bpe.ids(text) + END.to_bytes(4, "little")
                    for k, (start, n) in enumerate(piece_bounds(len(ids) // 4, capacity)):
                        own = ids[4 * start : 4 * (start + n)]
                        for c, x in zip(cols, (i, k, start, n, zlib.crc32(own), task, seen[n], np.frombuffer(own, "<u4") if keep_ids else None), strict=True):
                            c.append(x)
                        seen[n] += 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                out = [pa.array(c, k) for c, k in zip(cols, kinds, strict=False)]
                names = [x.split()[0] for x in PIECES.split(", ")]
                if keep_ids:
                    out.append(pa.array([x.astype(np.int32) for x in cols[7]], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    return texts(docs, id_col, text_col).mapInArrow(run, PIECES + (", ids array<int>" if keep_ids else ""))


Patterns = list[tuple[tuple[tuple[int, int], ...], int]]


class SumIndex:
    """Available lengths by the sums of one, two and three of them, under their counts.

    The index is built once from the lengths there are: pairs by their sum, and triples by their sum as a length and the
    sum of a pair. Counts only fall, so an entry whose pieces have run out stays out; entries are looked up against the
    counts as they are. Of pairs those of like lengths come first, which leaves small lengths, that fit anywhere, to the end."""

    def __init__(self, free: np.ndarray, capacity: int):
        self.free, self.capacity = free, capacity
        self.lengths = np.flatnonzero(free[:capacity])
        i, j = np.triu_indices(len(self.lengths))
        self.pairs = self._by_sum(self.lengths[j], self.lengths[i])
        sums = np.flatnonzero(np.diff(self.pairs[0]))
        self.triples = self._by_sum(np.repeat(self.lengths, len(sums)), np.tile(sums, len(self.lengths)))
        self.alive = np.zeros(capacity + 1, bool)
        self.alive[sums] = True

    def _by_sum(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first entry of each sum, x, y) of the entries whose sum leaves room for another piece."""
        fits = x + y < self.capacity
        x, y = x[fits], y[fits]
        at = np.lexsort((np.abs(x - y), x + y))
        return np.searchsorted((x + y)[at], np.arange(self.capacity + 2)), x[at], y[at]

    def _pair(self, total: int) -> tuple[int, int] | None:
        first, x, y = self.pairs
        x, y = x[first[total] : first[total + 1]], y[first[total] : first[total + 1]]
        ok = (self.free[x] > 0) & (self.free[y] > (x == y))
        return (int(x[k := int(np.argmax(ok))]), int(y[k])) if ok.any() else None

    def _bury(self, total: int, lead: int) -> None:
        """Leave a sum out from now on if none of its pairs has any piece left, those held by the search put back."""
        first, x, y = self.pairs
        x, y = x[first[total] : first[total + 1]], y[first[total] : first[total + 1]]
        self.alive[total] = bool((((self.free[x] > 0) | (x == lead)) & ((self.free[y] > 0) | (y == lead))).any())

    def complement(self, lead: int, pieces: int) -> tuple[int, ...] | None:
        """`pieces` available lengths (one, two or three) that fill the gap beside a piece of length lead exactly."""
        gap, free = self.capacity - lead, self.free
        free[lead] -= 1
        found = None
        if pieces == 1:
            found = (gap,) if free[gap] > 0 else None
        elif pieces == 2:
            found = self._pair(gap)
        else:
            first, x, y = self.triples
            x, y = x[first[gap] : first[gap + 1]], y[first[gap] : first[gap + 1]]
            for k in np.flatnonzero((free[x] > 0) & self.alive[y]).tolist():
                n = int(x[k])
                free[n] -= 1
                pair = self._pair(int(y[k]))
                free[n] += 1
                if pair is None:
                    self._bury(int(y[k]), lead)
                if pair:
                    found = (n, *pair)
                    break
        free[lead] += 1
        return found

    def consume(self, lengths: tuple[int, ...]) -> tuple[tuple[tuple[int, int], ...], int]:
        """Take a combination off the counts as often as they allow, and as a partner is left for every piece of more than
        half a sequence: no two of those go together, so one that is alone costs a sequence."""
        need = Counter(lengths)
        times = min(int(self.free[n]) // k for n, k in need.items())
        middle = self.capacity // 2
        large = sum(k for n, k in need.items() if n > middle)
        if taken := len(lengths) - 2 * large:  # small pieces beyond one for each large one
            times = min(times, max(0, int(self.free[: middle + 1].sum()) - int(self.free[middle + 1 :].sum())) // taken)
        for n, k in need.items():
            self.free[n] -= k * times
        return tuple(sorted(need.items(), reverse=True)), times


def exact_fillings(free: np.ndarray, capacity: int) -> Patterns:
    """Sequences filled without rest: single complements of all lengths, then pairs, then triples, longest lengths first;
    takes their pieces off free."""
    out: Patterns = []
    if free[capacity]:
        out.append((((capacity, 1),), int(free[capacity])))
        free[capacity] = 0
    index = SumIndex(free, capacity)
    for pieces in (1, 2, 3):
        for lead in index.lengths[::-1].tolist():
            while free[lead] > 0 and (rest := index.complement(lead, pieces)):
                pattern, times = index.consume((lead, *rest))
                if not times:
                    break
                out.append((pattern, times))
    return out


def best_fit(free: np.ndarray, capacity: int) -> Patterns:
    """Best fit of all pieces in free, longest first, by lengths: bins with like contents are one entry."""
    bins: dict[int, list[list]] = {}
    gaps = np.zeros(capacity + 1, bool)
    for n in range(capacity, 0, -1):
        left = int(free[n])
        while left:
            fits = np.flatnonzero(gaps[n:])
            if not len(fits):
                each = capacity // n
                for k, m in ((each, left // each), (left % each, 1)):
                    if k and m:
                        bins.setdefault(capacity - k * n, []).append([((n, k),), m])
                        gaps[capacity - k * n] = True
                break
            g = n + int(fits[0])
            last = bins[g][-1]
            each = min(g // n, -(-left // last[1]))
            m = min(last[1], left // each)
            last[1] -= m
            if not last[1]:
                bins[g].pop()
            if not bins[g]:
                del bins[g]
                gaps[g] = False
            bins.setdefault(g - each * n, []).append([(*last[0], (n, each)), m])
            gaps[g - each * n] = True
            left -= m * each
    return [(tuple(p), m) for entries in bins.values() for p, m in entries]


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> Patterns:
    """counts[n] pieces of length n -> [(((length, repeats), ...), sequences)]: exact fillings, then best fit of the rest."""
    free = counts.astype(np.int64).copy()
    out = exact_fillings(free, capacity)
    return out + best_fit(free, capacity)


def slots(patterns: Patterns) -> np.ndarray:
    """Rows (length, first rank, repeats, first sequence, offset) in order of length and rank."""
    used: Counter[int] = Counter()
    rows, base = [], 0
    for pattern, times in patterns:
        offset = 0
        for n, k in pattern:
            rows.append((n, used[n], k, base, offset))
            used[n] += k * times
            offset += n * k
        base += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to saved pieces (any columns besides length, task and nth are kept).

    Ranks within a length come from counts per task, added up over the tasks, so a hot length needs no task of its own.
    """
    per_task = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = np.zeros(capacity + 1, np.int64)
    for row in cut.groupBy("length").count().collect():  # a row a length: at most `capacity`
        counts[row["length"]] = row["count"]
    table = slots(plan(counts, capacity))
    names = [*cut.columns, "sequence_id", "offset"]
    kinds = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = table[:, 0] << 44 | table[:, 1] if len(table) else np.zeros(0, np.int64)
        for batch in batches:
            n = batch.column("length").to_numpy()
            rank = batch.column("base").to_numpy() + batch.column("nth").to_numpy()
            slot = table[np.searchsorted(keys, n << 44 | rank, "right") - 1]
            k = rank - slot[:, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-2]), pa.array(slot[:, 3] + k // slot[:, 2]), pa.array(slot[:, 4] + k % slot[:, 2] * n)], names=names)

    ranked = cut.join(base, ["task", "length"]).select(*cut.columns, "base")
    return ranked.mapInArrow(place, kinds).drop("task", "nth")


def best_fit_packing(docs: DataFrame, tokenizer: tuple[str, str, str] | None = None, capacity: int = CAPACITY, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A document is its token ids and the end mark 0. Only one longer than a sequence is cut. Null and empty texts are the
    end mark alone. Rows that repeat are packed each; a null doc_id stays null; an empty table gives an empty result.
    Sequences are filled without gaps from offset 0. Columns other than id and text are not read.
    """
    return pack(saved(pieces(docs, tokenizer, capacity, keep_ids, id_col, text_col), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids) of packed pieces with ids; a sequence is bounded by its capacity."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
