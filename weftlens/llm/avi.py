"""Media columns: AVI files of motion-JPEG, written, read back and cut into clips.

A JPEG is lossy in its pixels but not in its quantised coefficients, which are
the format's own unit, so bytes are stored as coefficients: 192 bytes make the
three 8 x 8 blocks (Y, Cb, Cr) of one coding unit, byte b as coefficient b + 1
in zigzag order. No coefficient is 0, so each has a run length of 0 and a size
of at most 9 bits. The Huffman table gives a size of s bits a code of 16 - s
bits, so that code and value always fill 16 bits, and whole batches can be
written and parsed as arrays. DC values are coded as differences, as the
format asks. Any baseline decoder can show the frames.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from weftlens.llm import arrowtext as at

UNIT = 192
FRAME_UNITS = 4  # two by two coding units: frames of 16 x 16 pixels
SIDE = 16
FRAME_BYTES = UNIT * FRAME_UNITS
RATE = 25


@cache
def zigzag() -> np.ndarray:
    """The place in its block of each coefficient, in the order of coding."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    cells.sort(key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


def _huffman(sizes: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """(table segment's body, symbol -> (code, length)): canonical codes of the lengths asked for."""
    order = sorted(sizes, key=lambda s: (sizes[s], s))
    code, last, codes = 0, 0, {}
    for s in order:
        code <<= sizes[s] - last
        last = sizes[s]
        codes[s] = (code, last)
        code += 1
    counts = bytes(sum(n == k for n in sizes.values()) for k in range(1, 17))
    return counts + bytes(order), codes


AC_BODY, AC_CODES = _huffman({s: 16 - s for s in range(1, 10)})
DC_BODY, DC_CODES = _huffman({s: 16 - s for s in range(10)})


@cache
def words() -> tuple[np.ndarray, np.ndarray]:
    """The 16 bits of each AC coefficient 0..256 and of each DC difference -256..256."""

    def bits(value: int, codes: dict) -> int:
        size = abs(value).bit_length()
        code, _ = codes[size]
        return (code << size) | (value if value >= 0 else value + (1 << size) - 1)

    ac = np.array([0, *(bits(v, AC_CODES) for v in range(1, 257))], np.uint16)
    dc = np.array([bits(v, DC_CODES) for v in range(-256, 257)], np.uint16)
    return ac, dc


@cache
def values() -> tuple[np.ndarray, np.ndarray]:
    """The inverse of words()."""
    ac, dc = words()
    back_ac, back_dc = np.full(1 << 16, -1, np.int16), np.full(1 << 16, 999, np.int16)
    back_ac[ac[1:]] = np.arange(1, 257)
    back_dc[dc] = np.arange(-256, 257)
    return back_ac, back_dc


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@cache
def frame_head() -> bytes:
    """All of a frame before its entropy-coded bytes: quantiser of ones, 16 x 16, three full components."""
    parts = [b"\xff\xd8", _segment(0xE0, b"AVI1\0\0\0\0\0\0\0\0\0\0"), _segment(0xDB, b"\0" + bytes([1] * 64))]
    parts.append(_segment(0xC0, struct.pack(">BHHB", 8, SIDE, SIDE, 3) + b"".join(bytes([k, 0x11, 0]) for k in (1, 2, 3))))
    parts += [_segment(0xC4, b"\x00" + DC_BODY), _segment(0xC4, b"\x10" + AC_BODY)]
    parts.append(_segment(0xDA, b"\x03" + b"".join(bytes([k, 0x00]) for k in (1, 2, 3)) + b"\x00\x3f\x00"))
    return b"".join(parts)


def encode_frames(payload: np.ndarray) -> list[bytes]:
    """One JPEG for each FRAME_BYTES of payload."""
    ac, dc = words()
    coded = payload.reshape(-1, FRAME_UNITS, 3, 64).astype(np.int16) + 1
    out = ac[coded]
    first = coded[..., 0]
    out[..., 0] = dc[np.diff(first, axis=1, prepend=np.zeros_like(first[:, :1])) + 256]
    raw = out.astype(">u2").reshape(len(coded), -1).view(np.uint8)
    stuffed = (raw == 0xFF).any(1)
    head, data = frame_head(), raw.tobytes()
    width = raw.shape[1]
    frames = [head + data[k : k + width] + b"\xff\xd9" for k in range(0, len(data), width)]
    for k in np.flatnonzero(stuffed).tolist():
        frames[k] = head + data[k * width : (k + 1) * width].replace(b"\xff", b"\xff\0") + b"\xff\xd9"
    return frames


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """Coefficients (frame, unit, component, 64) in zigzag order, from frames of frame_head()'s kind."""
    head = frame_head()
    body = []
    for f in frames:
        if not f.startswith(head) or not f.endswith(b"\xff\xd9"):
            raise ValueError("not an intra frame of the expected kind")
        body.append(f[len(head) : -2].replace(b"\xff\0", b"\xff"))
    raw = np.frombuffer(b"".join(body), ">u2").astype(np.uint16).reshape(len(frames), FRAME_UNITS, 3, 64)
    ac, dc = values()
    out = ac[raw]
    out[..., 0] = np.cumsum(dc[raw[..., 0]], axis=1)
    if out.min(initial=1) < 1 or out.max(initial=1) > 256:
        raise ValueError("damaged coefficients")
    return out


@cache
def _cosines() -> np.ndarray:
    k = np.arange(8)
    m = np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16) / 2
    m[:, 0] /= np.sqrt(2)
    return m.astype(np.float32)


def luma(coefficients: np.ndarray) -> np.ndarray:
    """Brightness 0..255 of each frame's pixels (frame, unit, 64), by the inverse cosine transform."""
    blocks = np.zeros((*coefficients.shape[:2], 64), np.float32)
    blocks[..., zigzag()] = coefficients[:, :, 0]
    m = _cosines()
    # Both passes as one product: the transform of a block is its 64 values times the Kronecker square.
    return np.clip(np.rint(blocks @ np.kron(m, m).T) + 128, 0, 255).astype(np.uint8)


def riff(frames: list[bytes], n_payload: int) -> bytes:
    """An AVI file: header, frames, index. The payload's length stands in a chunk of its own."""

    def chunk(tag: bytes, body: bytes) -> bytes:
        return tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)

    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // RATE, most * RATE, 0, 0x10, len(frames), 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, RATE, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 24, b"MJPG", SIDE * SIDE * 3, 0, 0, 0, 0)
    header = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    note = chunk(b"plen", struct.pack("<Q", n_payload))
    movi, index, place = [b"movi"], [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, place, len(f)))
        movi.append(c := chunk(b"00dc", f))
        place += len(c)
    body = b"AVI " + header + note + chunk(b"LIST", b"".join(movi)) + chunk(b"idx1", b"".join(index))
    return chunk(b"RIFF", body)


def _chunks(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while start + 8 <= end:
        tag, size = struct.unpack_from("<4sI", data, start)
        if start + 8 + size > end:
            raise ValueError("a chunk runs past its parent")
        yield tag, start + 8, size
        start += 8 + size + (size & 1)


def parse(media: bytes) -> tuple[list[bytes], int, float]:
    """(frames by the file's index, payload length, seconds a frame)."""
    data = memoryview(media)
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi, index, length, pace = 0, b"", 0, 0.0
    for tag, at_, size in _chunks(data, 12, len(media)):
        if tag == b"LIST" and media[at_ : at_ + 4] == b"movi":
            movi = at_
        elif tag == b"LIST" and media[at_ : at_ + 4] == b"hdrl":
            for inner, a, _ in _chunks(data, at_ + 4, at_ + size):
                if inner == b"avih":
                    pace = struct.unpack_from("<I", data, a)[0] / 1e6
        elif tag == b"idx1":
            index = media[at_ : at_ + size]
        elif tag == b"plen":
            length = struct.unpack_from("<Q", data, at_)[0]
    frames = []
    for tag, _, place, size in struct.iter_unpack("<4sIII", index):
        at_ = movi + place
        if struct.unpack_from("<4sI", data, at_) != (tag, size):
            raise ValueError("the index does not match the frames")
        frames.append(media[at_ + 8 : at_ + 8 + size])
    return frames, length, pace


def shots(histograms: np.ndarray, window: int = 8, factor: float = 2.0, floor: float = 0.08) -> np.ndarray:
    """First frames of shots. A cut lies where the difference of neighbouring
    histograms is above ``floor`` and above ``factor`` times the mean
    difference of the ``window`` frames before it; the first difference has
    none before it and is judged by the floor alone."""
    n = len(histograms)
    if n < 2:
        return np.zeros(min(n, 1), np.int64)
    diff = np.abs(np.diff(histograms, axis=0)).sum(1) / (2 * histograms.sum(1)[1:])
    upto = np.concatenate([[0], np.cumsum(diff)])
    k = np.arange(n - 1)
    low = np.maximum(0, k - window)
    mean = np.where(k > low, (upto[k] - upto[low]) / np.maximum(k - low, 1), 0)
    return np.concatenate([[0], np.flatnonzero((diff > floor) & (diff > factor * mean)) + 1])


def payload(text: bytes) -> bytes:
    """text and then spaces up to a positive multiple of 192 bytes."""
    return text + b" " * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def store(body: bytes) -> bytes:
    """The AVI file of a payload; the last frame is filled up with spaces."""
    whole = body + b" " * (-len(body) % FRAME_BYTES)
    return riff(encode_frames(np.frombuffer(whole, np.uint8)), len(body))


def read(media: bytes) -> tuple[bytes, np.ndarray, float]:
    """(payload, brightness histograms of 16 bins by frame, seconds a frame)."""
    frames, length, pace = parse(media)
    coefficients = decode_frames(frames)
    body = (coefficients - 1).astype(np.uint8).tobytes()[:length]
    light = luma(coefficients).reshape(len(frames), -1)
    bins = (light >> 4).astype(np.int64) + 16 * np.arange(len(frames))[:, None]
    return body, np.bincount(bins.ravel(), minlength=16 * len(frames)).reshape(-1, 16), pace


def clips(docs: DataFrame, text: str = "text") -> DataFrame:
    """Timed clips of the films that the texts make: doc_id, clip, first_frame, n_frames, start_s, end_s.

    Null text is an empty one; a text always has at least one clip.
    """

    def work(batches):
        for batch in at.pieces(batches):
            out: list[list] = [[] for _ in range(6)]
            for doc, body in zip(batch.column(0), _texts(batch.column(1)), strict=True):
                _, histograms, pace = read(store(payload(body)))
                first = shots(histograms)
                ends = np.append(first[1:], len(histograms))
                for column, got in zip(out, ([doc.as_py()] * len(first), range(len(first)), first.tolist(), (ends - first).tolist(), (first * pace).tolist(), (ends * pace).tolist()), strict=True):
                    column.extend(got)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (batch.schema.types[0], pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], names=["doc_id", "clip", "first_frame", "n_frames", "start_s", "end_s"])

    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL("clip int, first_frame long, n_frames long, start_s double, end_s double")])
    return docs.select("doc_id", text).withColumnRenamed(text, "text").mapInArrow(work, schema)


def _texts(column: pa.Array) -> list[bytes]:
    raw, offs = at.buffers(column)
    data = raw.tobytes()
    cuts = offs.tolist()
    return [data[s:e] for s, e in zip(cuts, cuts[1:], strict=False)]


def digests(docs: DataFrame) -> DataFrame:
    """Each text stored as a film and read back: lengths, digests, a feature string and the film's timed clips.

    The feature names every cut. Reads ``doc_id`` and ``text``; null text is
    empty; equal texts give equal values; repeated rows give repeated rows.
    """

    def row(body: bytes) -> tuple:
        media = store(payload(body))
        back, histograms, pace = read(media)
        first = shots(histograms)
        mean = histograms.sum(0) @ (16 * np.arange(16) + 8) / histograms.sum()
        lengths = np.diff(np.append(first, len(histograms)))
        feature = f"frames={len(histograms)};shots={len(first)};longest_s={lengths.max() * pace:.2f};luma={mean:.2f};cuts=" + ",".join(map(str, first[1:].tolist()))
        clips = [{"first_frame": f, "n_frames": n, "start_s": f * pace, "end_s": (f + n) * pace} for f, n in zip(first.tolist(), lengths.tolist(), strict=True)]
        return len(body), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, clips

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips"]
    clip = pa.struct([("first_frame", pa.int64()), ("n_frames", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64())])
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(clip)]

    def work(batches):
        for batch in at.pieces(batches):
            columns = zip(*map(row, _texts(batch.column(1))), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(columns, types, strict=True))], names=["doc_id", *names])

    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL("n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips array<struct<first_frame: long, n_frames: long, start_s: double, end_s: double>>")])
    return docs.select("doc_id", "text").mapInArrow(work, schema)
