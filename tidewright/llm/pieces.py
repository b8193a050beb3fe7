"""SentencePiece encoding and decoding of giant documents in chunks, by a max-plus scan.

A giant text is cut anywhere. For every state that may hold at a chunk's left edge (the piece that ends there or reaches
over it) the chunk's paths are followed to its right edge; their scores form a max-plus transfer matrix. Matrices combine
associatively, so chunks are worked on anywhere and joined by a scan, which fixes the state at every edge; each chunk is
then traced back on its own.

The public model at hand is BPE: its merges go by rank, not by a sum of scores. A path scores zero there where each piece
fits the one before and minus infinity elsewhere, and the one path that is left is the model's own encoding (BpeLattice).
Unigram models score by the pieces themselves (Unigram). Texts that aren't giant go through the library."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_slices, lookup, saved, texts

MARK = "▁"
#: A single space, or mark, between two other characters: no piece reaches over it, and what went before doesn't matter.
_CUT, _BEFORE_WORD = re.compile(f"(?<=[^\\s{MARK}]) (?=[^\\s{MARK}])"), re.compile(f"(?<=[^{MARK}]){MARK}(?=[^{MARK}])")


class Unigram:
    """Best-path segmentation with piece scores, whole or by chunks. unknown: the score of a character without piece."""

    def __init__(self, scores: dict[str, float], unknown: float = -1e4):
        self.scores, self.unknown = scores, unknown
        self.reach = max(map(len, scores), default=1)

    def edges(self, text: str, start: int) -> Iterator[tuple[int, float]]:
        """(length, score) of the pieces that begin at start; a character alone is always one."""
        for n in range(1, min(self.reach, len(text) - start) + 1):
            s = self.scores.get(text[start : start + n])
            if s is not None:
                yield n, s
            elif n == 1:
                yield 1, self.unknown

    def transfer(self, text: str, a: int, b: int) -> np.ndarray:
        """T[i, j]: the best score from i characters after a to j characters after b by pieces that begin in [a, b)."""
        best = np.full((b - a + self.reach, self.reach), -np.inf)
        for i in range(self.reach):
            best[i, i] = 0.0
        for at in range(b - a):
            for n, s in self.edges(text, a + at):
                np.maximum(best[at + n], best[at] + s, out=best[at + n])
        out = best[b - a : b - a + self.reach].T.copy()
        for i in range(b - a, self.reach):  # a piece that reaches over the whole chunk begins before it
            out[i] = -np.inf
            out[i, i - (b - a)] = 0.0
        return out

    @staticmethod
    def combine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The max-plus product: associative, so a scan may bracket it as it likes."""
        return (x[:, :, None] + y[None, :, :]).max(1)

    def boundary_states(self, matrices: list[np.ndarray]) -> list[int]:
        """The state at each edge on the best path from state 0 to state 0: prefixes forward, then choices backward."""
        front = [np.where(np.arange(self.reach) == 0, 0.0, -np.inf)]
        for m in matrices:
            front.append((front[-1][:, None] + m).max(0))
        states = [0]
        for k in range(len(matrices) - 1, -1, -1):
            states.append(int(np.argmax(front[k] + matrices[k][:, states[-1]])))
        return states[::-1]

    def trace(self, text: str, a: int, b: int, enter: int, leave: int) -> list[str]:
        """The pieces of a chunk between two known states, of equal scores the path with the shorter last piece."""
        start, end = a + enter, b + leave
        best, back = {start: 0.0}, {}
        for at in range(start, b):
            if at in best:
                for n, s in self.edges(text, at):
                    if best[at] + s > best.get(at + n, -np.inf) and at + n <= end:
                        best[at + n], back[at + n] = best[at] + s, at
        out = []
        while end > start:
            out.append(text[back[end] : end])
            end = back[end]
        return out[::-1]

    def encode(self, text: str, chunk: int | None = None) -> list[str]:
        cuts = list(range(0, len(text), chunk or max(1, len(text)))) + [len(text)]
        spans = list(zip(cuts[:-1], cuts[1:], strict=True))
        states = self.boundary_states([self.transfer(text, a, b) for a, b in spans])
        return [p for (a, b), i, j in zip(spans, states[:-1], states[1:], strict=True) for p in self.trace(text, a, b, i, j)]


class BpePieces:
    """Ids of a SentencePiece BPE model; words met before are looked up."""

    def __init__(self, path: str, keep: int = 400_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.kept: dict[str, bytes] = {}
        self.keep = keep
        ids = range(self.model.get_piece_size())
        self.divisible = not any(MARK in self.model.id_to_piece(i).lstrip(MARK) for i in ids)

    def _own(self, text: str) -> bytes:
        return np.array(self.model.encode(text, num_threads=1), "<u4").tobytes()

    def word(self, text: str) -> bytes:
        """Ids of one word, the space or edge before it included."""
        own = self.kept.get(text)
        if own is None:
            if len(self.kept) > self.keep:
                self.kept.clear()
            own = self._own(text)
            if len(text) < 64:
                self.kept[text] = own
        return own

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text."""
        return b"".join(map(self.word, _CUT.split(text))) if self.divisible else self._own(text)

    def decode(self, ids: bytes) -> str:
        return self.model.decode(np.frombuffer(ids, "<u4").tolist())


State = tuple[int, int]  # characters that a piece reaches over an edge, and the piece
Matrix = dict[State, dict[State, float]]
UNKNOWN, START = -1, -2  # a character without piece; the beginning of a text


class BpeLattice:
    """A BPE model as a max-plus lattice over normalised text (spaces are marks, one stands in front).

    A sequence of pieces is what the merges give exactly when each two neighbours are what the merges give of the two
    together. So a path scores zero where every piece fits the one before, else minus infinity, and the state at an edge
    is the piece that ends at it or reaches over it. One path joins the two ends of a text: its encoding."""

    def __init__(self, words: BpePieces):
        model = words.model
        self.words = words
        kinds = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.piece = {i: model.id_to_piece(i) for i in kinds}
        self.id = {p: i for i, p in self.piece.items()}
        self.score = {self.piece[i]: model.get_score(i) for i in kinds}
        self.reach = max(map(len, self.id))
        self.begins = {p[:n] for p in self.id for n in range(1, len(p) + 1)}
        self.bytes = {model.id_to_piece(i): i for i in range(model.get_piece_size()) if model.is_byte(i)}
        self.byte = {i: bytes([int(p[3:5], 16)]) for p, i in self.bytes.items()}
        self.fit: dict[tuple[int, int], bool] = {}

    def merged(self, text: str) -> list[str]:
        """What the merges make of a short text: the best-scoring neighbours first, of equal ones the leftmost."""
        now = list(text)
        while True:
            found = [(-s, k) for k, (a, b) in enumerate(zip(now, now[1:], strict=False)) if (s := self.score.get(a + b)) is not None]
            if not found:
                return now
            k = min(found)[1]
            now[k : k + 2] = [now[k] + now[k + 1]]

    def fits(self, a: int, b: int) -> bool:
        """Whether piece b may follow piece a."""
        if b == UNKNOWN:
            return True
        if (found := self.fit.get((a, b))) is None:
            if len(self.fit) > 1_000_000:
                self.fit.clear()
            alone = self.merged(self.piece[b]) == [self.piece[b]]
            found = self.fit[a, b] = alone and (a < 0 or self.merged(self.piece[a] + self.piece[b]) == [self.piece[a], self.piece[b]])
        return found

    def matches(self, text: str, at: int) -> Iterator[tuple[int, int]]:
        """(length, piece) of the pieces that begin at a place; a character without any is one by itself."""
        if text[at] not in self.id:
            yield 1, UNKNOWN
        for n in range(1, min(self.reach, len(text) - at) + 1):
            part = text[at : at + n]
            if part not in self.begins:
                return
            if part in self.id:
                yield n, self.id[part]

    def forward(self, text: str, nodes: dict[int, dict[int, dict]], a: int, b: int) -> dict[int, dict[int, dict]]:
        """Follow all paths from nodes {place: {last piece: {origin: how it got there}}} until they are at b or beyond."""
        for at in range(a, b):
            for last, origins in nodes.pop(at, {}).items():
                for n, piece in self.matches(text, at):
                    if self.fits(last, piece):
                        own = nodes.setdefault(at + n, {}).setdefault(piece, {})
                        for origin, path in origins.items():
                            own.setdefault(origin, None if path is None else (path, piece))
        return nodes

    def entries(self, text: str, a: int) -> list[State]:
        """All states that may hold at an edge: pieces that begin before it and end there or beyond."""
        if a == 0:
            return [(0, START)]
        return [(at + n - a, piece) for at in range(max(0, a - self.reach), a) for n, piece in self.matches(text, at) if at + n >= a]

    def cuts(self, text: str, a: int, b: int) -> tuple[int, int] | None:
        """The first and last place in [a, b) that no piece crosses and where what went before doesn't matter."""
        if not self.words.divisible:
            return None
        first = _BEFORE_WORD.search(text, a + 1, b)
        if first is None:
            return None
        at = b
        while (at := text.rfind(MARK, first.start(), at)) > first.start():
            if _BEFORE_WORD.match(text, at):
                break
        return first.start(), max(at, first.start())

    def transfer(self, before: str, own: str, after: str) -> Matrix:
        """T[i][j] = 0 where a path leads from state i at the left edge of own to state j at its right edge."""
        text, a = before + own + after, len(before)
        b = a + len(own)
        nodes: dict[int, dict[int, dict]] = {}
        for over, piece in self.entries(text, a):
            nodes.setdefault(a + over, {}).setdefault(piece, {})[over, piece] = None
        if cuts := self.cuts(text, a + self.reach, b):
            met = self.forward(text, nodes, a, cuts[0])
            origins = {o: None for by_piece in met.values() for by_origin in by_piece.values() for o in by_origin}
            nodes, a = {cuts[1]: {START: origins}}, cuts[1]
        out: Matrix = {}
        for at, by_piece in self.forward(text, nodes, a, b).items():
            for piece, origins in by_piece.items():
                for origin in origins:
                    out.setdefault(origin, {})[at - b, piece] = 0.0
        return out

    def trace(self, before: str, own: str, after: str, enter: State, leave: State) -> bytes:
        """Ids of the pieces that begin in own, between two known states."""
        text, a = before + own + after, len(before)
        b = a + len(own)
        nodes, head = {a + enter[0]: {enter[1]: {0: ()}}}, b""
        if cuts := self.cuts(text, a + self.reach, b):
            (path,) = (o[0] for by_piece in self.forward(text, nodes, a, cuts[0]).values() for o in by_piece.values())
            head = self._ids(text, a + enter[0], path)
            edges = [m.start() for m in _BEFORE_WORD.finditer(text, cuts[0], cuts[1])] + [cuts[1]]
            head += b"".join(self.words.word(text[x + 1 : y]) for x, y in zip(edges, edges[1:], strict=False))
            nodes, a, enter = {cuts[1]: {START: {0: ()}}}, cuts[1], (0, START)
        return head + self._ids(text, a + enter[0], self.forward(text, nodes, a, b)[b + leave[0]][leave[1]][0])

    def _ids(self, text: str, at: int, path: tuple) -> bytes:
        pieces = []
        while path:
            path, piece = path
            pieces.append(piece)
        out: list[int] = []
        for piece in reversed(pieces):
            if piece == UNKNOWN:
                out += [self.bytes[f"<0x{x:02X}>"] for x in text[at].encode()]
            else:
                out.append(piece)
            at += 1 if piece == UNKNOWN else len(self.piece[piece])
        return np.array(out, "<u4").tobytes()

    def surface(self, ids: bytes) -> str:
        """The normalised text of ids; bytes in a row are read as UTF-8."""
        out: list[bytes] = []
        for i in np.frombuffer(ids, "<u4").tolist():
            out.append(self.byte[i] if i in self.byte else self.piece.get(i, "").encode())
        return b"".join(out).decode("utf-8", "replace")


def combine(x: Matrix, y: Matrix) -> Matrix:
    """The max-plus product of two transfer matrices: associative, so a scan may bracket it as it likes."""
    out: Matrix = {}
    for i, row in x.items():
        for k, s in row.items():
            for j, t in y.get(k, {}).items():
                own = out.setdefault(i, {})
                own[j] = max(own.get(j, -np.inf), s + t)
    return out


def boundary_states(matrices: list[Matrix], enter: State = (0, START)) -> list[State]:
    """The state at each edge on the best path: products of ever more neighbours upward, the states between downward."""
    levels = [matrices]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([combine(now[k], now[k + 1]) if k + 1 < len(now) else now[k] for k in range(0, len(now), 2)])
    ends = levels[-1][0][enter]
    states = [enter, max(ends, key=lambda j: (ends[j], j))]
    for below in levels[-2::-1]:
        out = [states[0]]
        for k, (i, j) in enumerate(zip(states[:-1], states[1:], strict=True)):
            if 2 * k + 1 < len(below):
                x, y = below[2 * k], below[2 * k + 1]
                out.append(max((m for m in x[i] if j in y.get(m, {})), key=lambda m: (x[i][m] + y[m][j], m)))
            out.append(j)
        states = out
    return states


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def normalised(text: str) -> str:
    """A text as the model sees it: spaces are marks, and one stands in front."""
    return MARK + text.replace(" ", MARK) if text else ""


def chunks(text: str, size: int, reach: int) -> list[tuple[str, str, str]]:
    """A normalised text in chunks, each with what pieces can reach of the text before and after it; 4096 at most."""
    size = max(size, reach + 1, -(-len(text) // 4096))
    return [(text[max(0, a - reach) : a], text[a : a + size], text[a + size : a + size + reach]) for a in range(0, len(text), size)]


def crc_joined(a: int, b: int, length: int) -> int:
    """crc32 of two byte strings together, from that of each and the length of the second: associative."""
    poly = 0xEDB88320
    odd = [poly] + [1 << k for k in range(31)]

    def times(m: list[int], v: int) -> int:
        out = 0
        for k in range(32):
            if v >> k & 1:
                out ^= m[k]
        return out

    step = [times(odd, x) for x in odd]
    step = [times(step, x) for x in step]  # by four zero bits
    while length:
        step = [times(step, x) for x in step]
        if length & 1:
            a = times(step, a)
        length >>= 1
    return a ^ b


ENCODED = "doc_id long, check string, chunk int, chunks int, n_pieces long, ids_crc32 long, restored boolean"
PARTS = "check string, chunk int, chunks int, before string, own string, after string, marked boolean"
STATE = pa.struct([("over", pa.int32()), ("piece", pa.int32())])
ENTRY = pa.struct([("enter", STATE), ("leave", STATE), ("score", pa.float64())])
_STATE = "struct<over:int,piece:int>"


def _batch(rows: list[tuple], fields: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, fields.values(), strict=True)], names=list(fields))


def _encoder(path: str, keep_ids: bool):
    """Rows (doc_id, check, text) of texts that are one chunk."""
    fields = dict(zip((x.split()[0] for x in ENCODED.split(", ")), (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()), strict=True)) | ({"ids": pa.list_(pa.int32())} if keep_ids else {})
    state: list[BpePieces] = []

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            state.append(BpePieces(path))
        rows = []
        for doc, check, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids = state[0].ids(text)
            rows.append((doc, check, 0, 1, len(ids) // 4, zlib.crc32(ids), state[0].decode(ids) == text, *([np.frombuffer(ids, "<u4").astype(np.int32)] if keep_ids else [])))
        return _batch(rows, fields)

    return by_slices(work, rows=256)


def _traced(many: DataFrame, path: str, chunk: int, keep_ids: bool) -> DataFrame:
    """The chunks of all distinct giant texts (check, text): check, chunk, chunks, n_pieces, ids_crc32, restored, and ids."""
    state: list[BpeLattice] = []

    def lattice() -> BpeLattice:
        if not state:
            state.append(BpeLattice(BpePieces(path)))
        return state[0]

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for check, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            marked, parts = MARK in text, chunks(normalised(text), chunk, lattice().reach)
            rows += [(check, k, len(parts), *p, marked) for k, p in enumerate(parts)]
        return _batch(rows, dict(zip(("check", "chunk", "chunks", "before", "own", "after", "marked"), (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_()), strict=True)))

    def transfer(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for check, k, before, own, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            entries = [{"enter": dict(zip(("over", "piece"), i, strict=True)), "leave": dict(zip(("over", "piece"), j, strict=True)), "score": s} for i, row in lattice().transfer(before, own, after).items() for j, s in row.items()]
            rows.append((check, k, entries))
        return _batch(rows, {"check": pa.string(), "chunk": pa.int32(), "matrix": pa.list_(ENTRY)})

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for check, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            matrices: list[Matrix] = []
            for part in parts:
                m: Matrix = {}
                for e in part["matrix"]:
                    m.setdefault(tuple(e["enter"].values()), {})[tuple(e["leave"].values())] = e["score"]
                matrices.append(m)
            states = boundary_states(matrices)
            rows += [(check, k, *i, *j) for k, (i, j) in enumerate(zip(states[:-1], states[1:], strict=True))]
        names = ("check", "chunk", "enter_over", "enter_piece", "leave_over", "leave_piece")
        return _batch(rows, dict(zip(names, (pa.string(), *[pa.int32()] * 5), strict=True)))

    def trace(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for check, k, n, before, own, after, marked, a, b, c, d in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids = lattice().trace(before, own, after, (a, b), (c, d))
            same = not marked and lattice().surface(ids) == (own + after)[a : len(own) + c]
            rows.append((check, k, n, len(ids) // 4, zlib.crc32(ids), same, *([np.frombuffer(ids, "<u4").astype(np.int32)] if keep_ids else [])))
        fields = {"check": pa.string(), "chunk": pa.int32(), "chunks": pa.int32(), "n_pieces": pa.int64(), "ids_crc32": pa.int64(), "restored": pa.bool_()} | ({"ids": pa.list_(pa.int32())} if keep_ids else {})
        return _batch(rows, fields)

    parts = saved(many.mapInArrow(by_slices(cut, rows=1), PARTS).dropDuplicates(["check", "chunk"]), "giant-chunks")
    entry = f"array<struct<enter:{_STATE},leave:{_STATE},score:double>>"
    matrices = parts.select("check", "chunk", "before", "own", "after").mapInArrow(by_slices(transfer, rows=32), f"check string, chunk int, matrix {entry}")
    whole = matrices.groupBy("check").agg(F.array_sort(F.collect_list(F.struct("chunk", "matrix"))).alias("parts"))
    states = whole.mapInArrow(by_slices(scan, rows=1), "check string, chunk int, enter_over int, enter_piece int, leave_over int, leave_piece int")
    both = parts.join(states, ["check", "chunk"]).select("check", "chunk", "chunks", "before", "own", "after", "marked", "enter_over", "enter_piece", "leave_over", "leave_piece")
    kind = "check string, chunk int, chunks int, n_pieces long, ids_crc32 long, restored boolean" + (", ids array<int>" if keep_ids else "")
    return both.mapInArrow(by_slices(trace, rows=32), kind)


def _encoded(docs: DataFrame, path: str | None, giant: int, chunk: int, keep_ids: bool, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The encoded texts that are one chunk; (doc_id, check) of the giant ones; and the encoded chunks of those, each text once."""
    where = path or default_model()
    rows = texts(docs, id_col, text_col).withColumn("check", F.sha2(F.col("text").cast("binary"), 256)).select("doc_id", "check", "text")
    one, many = rows.filter(F.char_length("text") <= giant), rows.filter(F.char_length("text") > giant)
    kind = ENCODED + (", ids array<int>" if keep_ids else "")
    return one.mapInArrow(_encoder(where, keep_ids), kind), saved(many.select("doc_id", "check"), "giant-texts"), saved(_traced(many.select("check", "text"), where, chunk, keep_ids), "giant-encoded")


def _of_each(light: DataFrame, table: DataFrame) -> DataFrame:
    """Rows (doc_id, check) with what the table says of their text, however often a text repeats."""
    copies = light.groupBy("check").agg(F.count("*").alias("copies"))
    return lookup(light, table.join(copies, "check"), "check", "copies", light.count())


def encode_chunks(docs: DataFrame, path: str | None = None, giant: int = 1 << 15, chunk: int = 1 << 13, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a chunk: doc_id, check (SHA-256 of the text), chunk, chunks, n_pieces, ids_crc32, restored (whether decoding
    gives the chunk back), and ids if asked. Texts of more than `giant` characters are cut, and their chunks dealt out
    over all tasks; all others are one chunk and stay where they are read."""
    one, light, traced = _encoded(docs, path, giant, chunk, keep_ids, id_col, text_col)
    each = traced.groupBy("check").agg(F.collect_list(F.struct("chunk", "chunks", "n_pieces", "ids_crc32", "restored", *(["ids"] if keep_ids else []))).alias("parts"))
    return one.unionByName(_of_each(light, each).select("doc_id", "check", F.inline("parts")).select(one.columns))


def encode(docs: DataFrame, path: str | None = None, giant: int = 1 << 15, chunk: int = 1 << 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_pieces, ids_crc32 (of its little-endian 32-bit ids), restored.

    Null and empty texts have no pieces, crc 0, and are restored. A text that holds the mark U+2581 itself is not: it
    decodes to a space. Rows that repeat are returned each. A null doc_id stays null. An empty table gives an empty
    result. Other columns are not read."""
    one, light, traced = _encoded(docs, path, giant, chunk, False, id_col, text_col)

    def join(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for check, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n = crc = 0
            for p in parts:
                n, crc = n + p["n_pieces"], crc_joined(crc, p["ids_crc32"], 4 * p["n_pieces"])
            out.append((check, n, crc, all(p["restored"] for p in parts)))
        return _batch(out, {"check": pa.string(), "n_pieces": pa.int64(), "ids_crc32": pa.int64(), "restored": pa.bool_()})

    parts = traced.groupBy("check").agg(F.array_sort(F.collect_list(F.struct("chunk", "n_pieces", "ids_crc32", "restored"))).alias("parts"))
    joined = parts.mapInArrow(by_slices(join), "check string, n_pieces long, ids_crc32 long, restored boolean")
    names = ["doc_id", "n_pieces", "ids_crc32", "restored"]
    return one.select(names).unionByName(_of_each(light, joined).select(names))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of rows (doc_id, check, chunk, ids): chunks are decoded on their own and joined; the mark in front of
    the first is dropped. Rows that repeat are returned each."""
    where = path or default_model()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        lattice = BpeLattice(BpePieces(where))
        out = pa.array([lattice.surface(np.array(x, "<u4").tobytes()).replace(MARK, " ") for x in batch.column(3).to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([*batch.columns[:3], out], names=["doc_id", "check", "chunk", "text"])

    parts = encoded.select("doc_id", "check", "chunk", "ids").mapInArrow(by_slices(work), "doc_id long, check string, chunk int, text string")
    each = parts.groupBy("doc_id", "check", "chunk").agg(F.count("*").alias("copies"), F.first("text").alias("text"))  # a row gives each of its chunks once
    joined = each.groupBy("doc_id", "check").agg(F.array_sort(F.collect_list(F.struct("chunk", "text"))).alias("parts"), F.max("copies").alias("copies"))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    out = joined.select("doc_id", F.substring(text, 2, 1 << 30).alias("text"), "copies")
    return out.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")
