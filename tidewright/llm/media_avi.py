"""Media columns: motion-JPEG in AVI, its index, its intra frames and the shots they show.

A payload byte is the mean of one 8x8 block of a baseline grey JPEG: only the DC coefficient is coded, with quantiser 8,
so a decoded block is flat and gives back its byte exactly. A frame holds 24 x 24 blocks. Restart markers after every
block make blocks independent, and the Huffman table is laid out so that a block always takes two bytes, none of which
is 0xFF: whole frames are coded and decoded by table. Frames with other headers go through a general baseline decoder.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_slices, texts

SIDE = 24
FRAME = SIDE * SIDE
FPS = 24
#: Fixed values of JPEG: marker bytes.
SOI, EOI, DQT, SOF0, DHT, DRI, SOS, RST0 = 0xD8, 0xD9, 0xDB, 0xC0, 0xC4, 0xDD, 0xDA, 0xD0
#: Our DC table: categories by code length, so that code, extra bits and end of block fill 9 to 16 bits.
DC_LENGTHS = {4: [4, 5, 6, 7, 8], 8: [0, 1, 2, 3]}
AC_LENGTHS = {1: [0]}


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, lengths: dict[int, list[int]]) -> bytes:
    return bytes([kind, *(len(lengths.get(n, [])) for n in range(1, 17)), *(s for n in sorted(lengths) for s in lengths[n])])


def _codes(counts: list[int], symbols: list[int]) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol of a canonical table."""
    out, code, at = {}, 0, 0
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            out[n, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


@lru_cache(1)
def _coder() -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """JPEG header, two bytes per sample value, sample value per two bytes (-1: none), the markers between blocks."""
    px = SIDE * 8
    head = b"\xff" + bytes([SOI]) + _segment(DQT, bytes([0, 8] + [1] * 63)) + _segment(SOF0, struct.pack(">BHHB3B", 8, px, px, 1, 1, 0x11, 0))
    head += _segment(DHT, _table(0x00, DC_LENGTHS)) + _segment(DHT, _table(0x10, AC_LENGTHS)) + _segment(DRI, struct.pack(">H", 1)) + _segment(SOS, bytes([1, 1, 0, 0, 63, 0]))
    counts = [len(DC_LENGTHS.get(n, [])) for n in range(1, 17)]
    code_of = {s: (n, c) for (n, c), s in _codes(counts, [s for n in sorted(DC_LENGTHS) for s in DC_LENGTHS[n]]).items()}
    out, back = np.zeros((256, 2), np.uint8), np.full(65536, -1, np.int16)
    for value in range(256):
        d = value - 128
        cat = abs(d).bit_length()
        n, code = code_of[cat]
        bits = f"{code:0{n}b}" + (f"{d if d > 0 else d + (1 << cat) - 1:0{cat}b}" if cat else "") + "0"
        word = int(bits.ljust(16, "1"), 2)
        out[value], back[word] = divmod(word, 256), value
    marks = np.array([[0xFF, RST0 + i % 8] for i in range(FRAME)], np.uint8)
    marks[-1] = 0xFF, EOI
    return head, out, back, marks


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def padded(text: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of a frame."""
    return text + b"\xff" * (max(1, -(-len(text) // FRAME)) * FRAME - len(text))


def encode_avi(payload: bytes, fps: int = FPS) -> bytes:
    """An AVI file with a frame for every 576 bytes and an idx1 index."""
    head, code, _, marks = _coder()
    n, size = len(payload) // FRAME, len(head) + 4 * FRAME
    size += size & 1
    frames = np.zeros((n, 8 + size), np.uint8)
    frames[:, :8] = np.frombuffer(b"00dc" + struct.pack("<I", len(head) + 4 * FRAME), np.uint8)
    frames[:, 8 : 8 + len(head)] = np.frombuffer(head, np.uint8)
    scan = frames[:, 8 + len(head) : 8 + len(head) + 4 * FRAME].reshape(n, FRAME, 4)
    scan[:, :, :2] = code[np.frombuffer(payload, np.uint8).reshape(n, FRAME)]
    scan[:, :, 2:] = marks
    frames[:, 8 + len(head) : 8 + len(head) + 4 * FRAME] = scan.reshape(n, -1)
    px = SIDE * 8
    avih = struct.pack("<14I", 1_000_000 // fps, size * fps, 0, 0x10, n, 0, 1, size, px, px, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, fps, 0, n, size, 0xFFFFFFFF, 0, 0, 0, px, px)
    strf = struct.pack("<IiiHH4sIiiII", 40, px, px, 1, 24, b"MJPG", px * px * 3, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    index = np.zeros((n, 4), "<u4")
    index[:, 0], index[:, 1], index[:, 2], index[:, 3] = int.from_bytes(b"00dc", "little"), 0x10, 4 + np.arange(n) * (8 + size), len(head) + 4 * FRAME
    return _chunk(b"RIFF", b"AVI " + hdrl + _chunk(b"LIST", b"movi" + frames.tobytes()) + _chunk(b"idx1", index.tobytes()))


def _chunks(data: memoryview, at: int, end: int):
    while at + 8 <= end:
        name, size = bytes(data[at : at + 4]), int.from_bytes(data[at + 4 : at + 8], "little")
        yield name, at + 8, min(size, end - at - 8)
        at += 8 + size + (size & 1)


def parse_avi(avi: bytes) -> tuple[int, list[tuple[int, int]]]:
    """(frames a second, [(offset, size)] of the video frames), by the index where there is one, else by the movi list.
    ValueError where there is no such file."""
    data, fps, movi, index = memoryview(avi), FPS, None, None
    if bytes(data[:4]) != b"RIFF" or bytes(data[8:12]) != b"AVI ":
        raise ValueError("not an AVI file")
    for name, at, size in _chunks(data, 12, len(data)):
        kind = bytes(data[at : at + 4]) if name == b"LIST" else name
        if kind == b"hdrl":
            for sub, a, _ in _chunks(data, at + 4, at + size):
                if sub == b"avih":
                    fps = round(1_000_000 / max(1, int.from_bytes(data[a : a + 4], "little")))
        elif kind == b"movi":
            movi = at, at + size
        elif kind == b"idx1":
            index = np.frombuffer(data[at : at + size // 16 * 16], "<u4").reshape(-1, 4)
    if movi is None:
        raise ValueError("an AVI file without movi list")
    if index is None:
        return fps, [(a, s) for name, a, s in _chunks(data, movi[0] + 4, movi[1]) if name[2:] in (b"dc", b"db")]
    tag = index[:, 0] >> 16
    places = [(movi[0] + int(o) + 8, int(s)) for o, s in index[(tag == 0x6364) | (tag == 0x6264)][:, 2:]]
    if any(o + s > len(data) for o, s in places):
        raise ValueError("an AVI file whose index points beyond its end")
    return fps, places


def decode_jpeg(data: bytes) -> np.ndarray:
    """The brightness of each 8x8 block of a baseline JPEG, grey or in colour, by the Huffman tables and quantisers that it
    carries: the means of the first component's blocks. ValueError where there is no such image."""
    try:
        return _decoded(data)
    except (IndexError, KeyError, struct.error) as broken:
        raise ValueError(f"not a whole baseline JPEG: {broken!r}") from None


def _decoded(data: bytes) -> np.ndarray:
    at, tables, quant, interval, size, parts = 2, {}, {}, 0, (0, 0), []
    if data[:2] != bytes([0xFF, SOI]):
        raise ValueError("not a JPEG")
    while True:
        marker, length = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + length]
        if data[at] != 0xFF or length < 2:
            raise ValueError("not a whole baseline JPEG")
        at += 2 + length
        if marker == DQT:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[65 + 64 * wide :]
        elif marker == SOF0:
            size = struct.unpack(">HH", body[1:5])
            parts = [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)]  # id, across, down, quantiser
        elif marker == DHT:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _codes(list(body[1:17]), list(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker == DRI:
            interval = int.from_bytes(body, "big")
        elif marker == SOS:
            used = {body[k]: body[k + 1] for k in range(1, 1 + 2 * body[0], 2)}
            break
    if len(parts) == 1:  # a scan of one component goes block by block
        parts = [(parts[0][0], 1, 1, parts[0][3])]
    most = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-size[1] // (8 * most[0])), -(-size[0] // (8 * most[1]))
    pieces, now = [], bytearray()
    while at < len(data):
        if data[at] == 0xFF and data[at + 1] != 0:
            pieces.append(bytes(now))
            now = bytearray()
            if data[at + 1] == EOI:
                break
            at += 2
        else:
            now.append(data[at])
            at += 2 if data[at] == 0xFF else 1
    out = np.full((down * parts[0][2], across * parts[0][1]), np.nan)
    done = 0
    for piece in pieces:
        bits, p, last = "".join(f"{x:08b}" for x in piece), 0, dict.fromkeys((x[0] for x in parts), 0)

        def symbol(table, p):
            n = 1
            while n < 17 and (n, int(bits[p : p + n] or "0", 2)) not in table:
                n += 1
            return table[n, int(bits[p : p + n], 2)], p + n

        for _ in range(min(interval or across * down, across * down - done)):
            for number, h, v, q in parts:
                dc, ac = tables[used[number] >> 4], tables[0x10 | used[number] & 15]
                for k in range(h * v):
                    cat, p = symbol(dc, p)
                    if cat:
                        extra = int(bits[p : p + cat], 2)
                        last[number] += extra if extra >> (cat - 1) else extra - (1 << cat) + 1
                        p += cat
                    if number == parts[0][0]:
                        out[done // across * v + k // h, done % across * h + k % h] = last[number] * quant[q] / 8 + 128
                    n = 1
                    while n < 64:
                        rs, p = symbol(ac, p)
                        if rs == 0:
                            break
                        n, p = n + (rs >> 4) + 1, p + (rs & 15)
            done += 1
    if not out.size or np.isnan(out).any():
        raise ValueError("not a whole baseline JPEG")
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def read_frames(avi: bytes) -> tuple[int, list[np.ndarray] | np.ndarray]:
    """(frames a second, samples of each frame): our own frames all at once by table, others one by one."""
    fps, places = parse_avi(avi)
    head, _, back, marks = _coder()
    size, first = len(head) + 4 * FRAME, places[0][0] if places else 0
    step = places[1][0] - first if len(places) > 1 else size
    if places and step >= size and all(s == size and o == first + i * step for i, (o, s) in enumerate(places)) and first + step * (len(places) - 1) + size <= len(avi):
        raw = np.lib.stride_tricks.as_strided(np.frombuffer(avi, np.uint8)[first:], (len(places), size), (step, 1), writeable=False)
        scan = raw[:, len(head) :].reshape(len(places), FRAME, 4)
        if (raw[:, : len(head)] == np.frombuffer(head, np.uint8)).all() and (scan[:, :, 2:] == marks).all():
            values = back[scan[:, :, 0].astype(np.uint16) << 8 | scan[:, :, 1]]
            if (values >= 0).all():
                return fps, values.astype(np.uint8).reshape(-1, SIDE, SIDE)
    return fps, [decode_jpeg(avi[o : o + s]) for o, s in places]


def detect_shots(frames, bins: int = 32, window: int = 8, sigmas: float = 3.0, floor: float = 0.05, prior: float = 0.5) -> list[tuple[int, int]]:
    """[(first, last)] frames of each shot. A cut is where the histogram difference to the frame before exceeds the mean
    of the last `window` differences by `sigmas` deviations and by `floor` at least. The first difference has none before
    it: it is held against the `window` that follow it, and is a cut as well where it exceeds `prior` and `floor`."""
    n = len(frames)
    if n == 0:
        return []
    if isinstance(frames, np.ndarray):
        flat = frames.reshape(n, -1).astype(np.int32) * bins // 256
        hist = np.bincount((flat + np.arange(n)[:, None] * bins).ravel(), minlength=n * bins).reshape(n, bins) / flat.shape[1]
    else:
        hist = np.array([np.bincount(f.ravel().astype(np.int32) * bins // 256, minlength=bins) / f.size for f in frames])
    diff = np.abs(np.diff(hist, axis=0)).sum(1) / 2
    if not len(diff):
        return [(0, n - 1)]
    one, two = np.r_[0, np.cumsum(diff)], np.r_[0, np.cumsum(diff**2)]
    at = np.arange(len(diff))
    low = np.maximum(0, at - window)
    count = np.maximum(1, at - low)
    mean = (one[at] - one[low]) / count
    spread = np.sqrt(np.maximum(0, (two[at] - two[low]) / count - mean**2))
    after = diff[1 : 1 + window]
    mean[0], spread[0] = min((prior, 0.0), (after.mean(), after.std()) if len(after) else (prior, 0.0), key=lambda x: x[0] + sigmas * x[1])
    cuts = np.flatnonzero(diff > mean + sigmas * spread + floor) + 1
    edges = [0, *cuts.tolist(), n]
    return [(a, b - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): the text's UTF-8 bytes, padded to whole frames, as an AVI file.

    A null or empty text gives one frame of padding. Equal texts give equal files. Rows that repeat are stored each; a
    null doc_id stays null; an empty table gives an empty one. Other columns are not read. A file takes some 4.3 bytes for
    each of the text, and a cell of a table holds 2 GiB: a text of more than 450 MB is an error.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        bodies = batch.column(1).cast(pa.binary()).to_pylist()
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in bodies], pa.int64()), pa.array([encode_avi(padded(x)) for x in bodies], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return texts(docs, id_col, text_col).mapInArrow(by_slices(work, rows=256, most_bytes=2 << 20), "doc_id long, n_bytes long, media binary")


CLIP = pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("last_frame", pa.int32()), ("start_ms", pa.int64()), ("end_ms", pa.int64())])


def timed(shots: list[tuple[int, int]], fps: int) -> list[dict]:
    return [{"clip": k, "first_frame": a, "last_frame": b, "start_ms": a * 1000 // fps, "end_ms": (b + 1) * 1000 // fps} for k, (a, b) in enumerate(shots)]


def readable(avi: bytes) -> tuple[int, list[np.ndarray] | np.ndarray] | str:
    """read_frames, or what is wrong with the file."""
    try:
        return read_frames(avi)
    except ValueError as broken:
        return str(broken)


def clips(media: DataFrame, media_col: str = "media") -> DataFrame:
    """(doc_id, clips, problem): the timed clips of each AVI file, an array of clip rows. Null media: null; a file that
    can't be read: null, and what is wrong with it."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, problems = [], []
        for avi in batch.column(1).to_pylist():
            found = readable(avi) if avi is not None else None
            problems.append(found if isinstance(found, str) else None)
            out.append(timed(detect_shots(found[1]), found[0]) if isinstance(found, tuple) else None)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(CLIP)), pa.array(problems, pa.string())], names=["doc_id", "clips", "problem"])

    kind = "doc_id long, clips array<struct<clip:int,first_frame:int,last_frame:int,start_ms:long,end_ms:long>>, problem string"
    return media.select("doc_id", media_col).mapInArrow(by_slices(work, rows=256), kind)


def clip_rows(media: DataFrame, media_col: str = "media") -> DataFrame:
    """A row a clip: doc_id, clip, first_frame, last_frame, start_ms, end_ms, problem. A file without clips has one row
    whose clip is null."""
    return clips(media, media_col).select("doc_id", F.inline_outer("clips"), "problem")


def digests(media: DataFrame) -> DataFrame:
    """What the stored bytes of (doc_id, n_bytes, media) give back: lengths and digests of payload and file, and the
    shots as a feature text. Of a file that can't be read, or null, what comes from its frames is null."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(6)]
        for avi in batch.column(2).to_pylist():
            if avi is None or isinstance(found := readable(avi), str):
                for c, x in zip(out, (None, None, None, None if avi is None else len(avi), None if avi is None else hashlib.sha256(avi).hexdigest(), None), strict=True):
                    c.append(x)
                continue
            fps, frames = found
            payload = frames.tobytes() if isinstance(frames, np.ndarray) else b"".join(f.tobytes() for f in frames)
            shots = timed(detect_shots(frames), fps)
            feature = f"frames={len(frames)};shots={len(shots)};ms=" + ",".join(str(c["end_ms"]) for c in shots)
            for c, x in zip(out, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(avi), hashlib.sha256(avi).hexdigest(), feature), strict=True):
                c.append(x)
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=names)

    kind = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(by_slices(work, rows=256), kind)
