"""Packing that keeps the order of documents: dynamic programming over window cuts.

The token ids of the documents of an input split, one after another, are a stream. A window is a stretch of at most
`capacity` ids of that stream, and becomes a sequence. Cuts go at the ends of documents and sentences, and every `capacity`
/ 8 ids inside longer sentences. A window costs what it is padded by (nothing at a power of two), one for the sequence,
and a penalty for where it ends, if that truncates a document (`sentence`) or a sentence too (`middle`). With P(j) ids before cut j and D(j) the least cost up to j,

    D(j) = 1 + penalty(j) + min( min over P(j) - P(i) <= capacity of D(i) - (P(j) - P(i)) + capacity,  min over P(j) - P(i) = 2^k of D(i) )

The first minimum slides over D(i) + P(i), so a monotone queue yields it in constant time; the second looks up one cut
for each k. The stream is never held whole: once all cuts that a window can still begin at descend from one cut, what
lies before that is settled and goes out. Splits are packed by themselves, without a shuffle, each in the order of its
rows; they lose less than a sequence each.
"""

from __future__ import annotations

import array
import bisect
import functools
import json
import re
import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

CAPACITY = 2048
END = 1
#: What ends a sentence: these, closing marks after them included.
_SENTENCE = re.compile(r"[.!?…。！？][\"')\]»”’]*$")
_STOPS, _CLOSING = tuple(".!?…。！？"), tuple("\"')]»”’")
#: Words with others than printable Latin characters, which normalise to themselves and have one lower case.
_ODD = re.compile(r"^.*[^!-~¡-įı-ɏ\n].*$", re.M).findall


def default_tokenizer() -> str:
    """The public vocabulary of words with ends."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordBpe(dict):
    """Word -> number of the word; its ids and their count stand at that number. Words are what lies between spaces and
    line ends, where the pre-tokenizer always cuts. New words of plain characters go through the same merges by rank all at
    once, with the end of a word as a byte of its own; all others through the tokenizer itself. `keep` bounds the words held."""

    def __init__(self, path: str, keep: int = 700_000):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.cut = regex.compile(split["pattern"]["Regex"] + r"|\n").findall
        self.names = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"])).search
        suffix, vocab = spec["model"]["end_of_word_suffix"], spec["model"]["vocab"]
        byte_of = self._bytes()
        inside = sorted(byte_of, key=byte_of.__getitem__)
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        names = inside + [c + suffix for c in inside] + merged  # in order of rank: bytes, bytes that end words, merges
        self.of_rank = np.array([vocab[t] for t in names], "<u4")
        self.line_end = vocab[inside[10] + suffix]
        ranks = {self._raw(t, byte_of, suffix): k for k, t in enumerate(names)}
        self.fast = tiktoken.Encoding("word-bpe", pat_str="[^\\x00]+\\x00", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.keep = keep
        self.reset()

    @staticmethod
    def _bytes() -> dict[str, int]:
        """Printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from 256."""
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in plain]
        return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}

    @staticmethod
    def _raw(token: str, byte_of: dict[str, int], suffix: str) -> bytes:
        ends = len(token) > len(suffix) and token.endswith(suffix)
        return bytes(byte_of[c] for c in (token[: -len(suffix)] if ends else token)) + b"\x00" * ends

    def reset(self) -> None:
        """Forget all words. Empty words and line ends have no ids; a line end ends a sentence."""
        self.clear()
        self.new: list[str] = []
        self.ids, self.counts, self.ends = [b"", b""], array.array("q", [0, 0]), array.array("b", [0, 1])
        self[""], self["\n"] = 0, 1

    def __missing__(self, word: str) -> int:
        self[word] = k = len(self)
        self.new.append(word)
        return k

    def learn(self) -> None:
        """Encodes the words that have come up since the last time."""
        words, self.new = self.new, []
        lines = "\n".join(words)
        odd = set(_ODD(lines))
        if self.names(lines):
            odd.update(filter(self.names, words))
        pieces = self.cut("\n".join([w for w in words if w not in odd]).lower() + "\n")
        ids = self.of_rank[self.fast("\x00".join(pieces) + "\x00")]
        raw, ends = ids.tobytes(), (4 * np.flatnonzero(ids == self.line_end)).tolist()
        plain = iter([raw[at:to] for at, to in zip([0] + [e + 4 for e in ends[:-1]], ends, strict=True)])
        encode, size = self.whole.encode, len(self.ids)
        self.ids += [np.array(encode(w, add_special_tokens=False).ids, "<u4").tobytes() if w in odd else next(plain) for w in words] if odd else plain
        self.counts.extend([len(x) // 4 for x in self.ids[size:]])
        self.ends.extend([w.endswith(_STOPS) or w.endswith(_CLOSING) and _SENTENCE.search(w) is not None for w in words])

    def _stretches(self, text: str, most: int) -> Iterator[list[int]]:
        """Numbers of the words of a text, in stretches of about `most` characters, cut at spaces."""
        at = 0
        while at < len(text):
            to = len(text) if len(text) - at <= most else text.find(" ", at + most)
            to = len(text) if to < 0 else to
            yield list(map(self.__getitem__, text[at:to].replace("\n", " \n ").split(" ")))
            at = to + 1

    def _put(self, stretches: Iterable[list[int]]) -> tuple[bytes, np.ndarray, int]:
        out, stops, n = [], [], 0
        for own in stretches:
            if self.new:
                self.learn()
            places = np.array(own, np.int64)
            total = n + np.cumsum(np.frombuffer(self.counts, np.int64)[places])
            out.append(b"".join(map(self.ids.__getitem__, own)))
            stops.append(total[np.frombuffer(self.ends, np.int8)[places] > 0])
            n = int(total[-1])
        return b"".join(out), np.concatenate(stops) if stops else np.zeros(0, np.int64), n

    def documents(self, texts: list[str], most: int = 1 << 20) -> Iterator[tuple[bytes, np.ndarray, int]]:
        """For each text its ids as little-endian words, the numbers of ids before each end of a sentence, and the number of
        ids. New words of texts of up to a million characters in all are learned together; longer texts go in stretches."""
        at = 0
        while at < len(texts):
            if len(self) > self.keep:
                self.reset()
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= most):
                size += len(texts[to])
                to += 1
            if size > most:
                yield self._put(self._stretches(texts[at], most))
            else:
                yield from map(self._put, [list(self._stretches(t, most)) for t in texts[at:to]])
            at = to


@functools.lru_cache(maxsize=1)
def _words(path: str) -> WordBpe:
    """One for each worker process: words learned by a task serve the next."""
    return WordBpe(path)


def cuts(n: int, stops: np.ndarray, step: int, sentence: int, middle: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, penalties) of the cuts of a document of n ids: its end for nothing, ends of sentences, and where those lie
    further apart than `step`, every `step` ids between them."""
    at = np.unique(np.append(stops[(stops > 0) & (stops < n)], n))
    gap = np.diff(at, prepend=0)
    more = (gap - 1) // step
    if more.any():
        first = np.repeat(at - gap, more)
        nth = np.arange(len(first)) - np.repeat(np.cumsum(more) - more, more) + 1
        extra = first + nth * step
        every = np.concatenate([at, extra])
        order = np.argsort(every, kind="stable")
        cost = np.concatenate([np.where(at < n, sentence, 0), np.full(len(extra), middle)])
        return every[order], cost[order]
    return at, np.where(at < n, sentence, 0)


class Cutter:
    """The dynamic programme over a stream of cuts. Cuts come in by `extend`; `settled` gives back ends of windows, in
    order, as soon as no later cut can change them, and `finish` the rest."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.powers = [1 << k for k in range(capacity.bit_length()) if 1 << k < capacity]
        self.place, self.cost, self.before = [0], [0], [0]
        self.queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # (cost + place, place, number), costs rising

    def extend(self, places: np.ndarray, penalties: np.ndarray) -> None:
        """places: rising, no two further apart than the capacity, the first not further from the last one known."""
        place, cost, before, queue, capacity = self.place, self.cost, self.before, self.queue, self.capacity
        base = len(place)
        back = max(0, base - capacity)  # places are whole numbers that rise: no window reaches further back
        known = np.concatenate([np.array(place[back:], np.int64), places])
        exact: list[list[int]] = [[] for _ in range(len(places))]
        for p in self.powers:
            want = places - p
            at = np.searchsorted(known, want)
            for j in np.flatnonzero((want >= known[0]) & (known[np.minimum(at, len(known) - 1)] == want)).tolist():
                exact[j].append(back + int(at[j]))
        for j, here, penalty, near in zip(range(base, base + len(places)), places.tolist(), penalties.tolist(), exact, strict=True):
            least = here - capacity
            while queue[0][1] < least:
                queue.popleft()
            best, _, source = queue[0]
            best -= least
            for i in near:
                if cost[i] < best:
                    best, source = cost[i], i
            best += 1 + penalty
            place.append(here)
            cost.append(best)
            before.append(source)
            key = best + here
            while queue and queue[-1][0] >= key:
                queue.pop()
            queue.append((key, here, j))

    def _chain(self, last: int) -> list[int]:
        out = []
        while last > 0:
            out.append(self.place[last])
            last = self.before[last]
        return out[::-1]

    def settled(self) -> list[int]:
        """Ends of the windows up to the last cut that all cuts still open descend from."""
        live = set(range(bisect.bisect_right(self.place, self.place[-1] - self.capacity), len(self.place)))
        while len(live) > 1:  # before[k] < k, and all chains lead to 0: whatever isn't the first of them moves back
            first = min(live)
            live = {k if k == first else self.before[k] for k in live}
        root = max(live)
        done = self._chain(root)
        if root:
            self.place, self.cost = self.place[root:], self.cost[root:]
            self.before = [max(0, k - root) for k in self.before[root:]]
            self.queue = deque((c, p, k - root) for c, p, k in self.queue if k >= root)
        return done

    def finish(self) -> list[int]:
        """Ends of the windows that are left; the stream must end at a cut."""
        done = self._chain(len(self.place) - 1)
        self.__init__(self.capacity)
        return done


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_in_order(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END, sentence: int = 8, middle: int = 64,
    keep_ids: bool = False, order_by: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", settle: int = 1 << 15,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A document is its token ids and the end mark. Each window of the stream is a sequence: its pieces stand gapless and in
    the order of the documents. That is the order of the rows of each input split, or by `order_by`, in ranges over all
    rows. Null and empty texts are the end mark alone. Rows that repeat are packed each; a null doc_id stays null; an empty
    table gives an empty result. Columns other than id and text (and those of order_by) are not read. Memory: the documents
    of up to about `settle` cuts, and the longest one.
    """
    path = tokenizer or default_tokenizer()
    step = max(1, capacity // 8)
    names = [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * keep_ids
    kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, cutter = _words(path), Cutter(capacity)
        sequence = TaskContext.get().partitionId() << 40
        held: deque[tuple[int, int, int, bytes]] = deque()  # (first place, end, id, ids) of documents that aren't all out
        base = begun = 0

        def pieces(ends: list[int]) -> pa.RecordBatch:
            nonlocal sequence, begun
            cols: list[list] = [[] for _ in names]
            for to in ends:
                at = begun
                while at < to:
                    first, last, doc, ids = held[0]
                    upto = min(last, to)
                    own = ids[4 * (at - first) : 4 * (upto - first)]
                    row = (doc, at - first, upto - at, zlib.crc32(own), last - first, sequence, at - begun, np.frombuffer(own, "<u4"))
                    for c, x in zip(cols, row, strict=False):
                        c.append(x)
                    if upto == last:
                        held.popleft()
                    at = upto
                begun, sequence = to, sequence + 1
            if keep_ids:
                cols[7] = [x.astype(np.int32) for x in cols[7]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                places, penalties = [], []
                for doc, (ids, stops, n) in zip(part.column(0).to_pylist(), bpe.documents(part.column(1).to_pylist()), strict=True):
                    held.append((base, base + n + 1, doc, ids + end.to_bytes(4, "little")))
                    at, cost = cuts(n + 1, stops, step, sentence, middle)
                    places.append(at + base)
                    penalties.append(cost)
                    base += n + 1
                cutter.extend(np.concatenate(places), np.concatenate(penalties))
                if len(cutter.place) > settle and (done := cutter.settled()):
                    yield pieces(done)
        if done := cutter.finish():
            yield pieces(done)

    rows = docs
    if order_by:
        rows = docs.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    return texts(rows, id_col, text_col).mapInArrow(run, PIECES + (", ids array<int>" if keep_ids else ""))


def padding(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences, tokens, and what the sequences are padded by: to capacity, or nothing at a power of two."""
    each = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    pad = F.when(F.expr("n & (n - 1)") == 0, 0).otherwise(capacity - F.col("n"))
    return each.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"), F.sum(pad).alias("padding"))
