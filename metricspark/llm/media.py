"""Operator 10: motion-JPEG in AVI files: payloads stored in intra frames, read back, cut into timed clips."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: A frame has SIDE x SIDE grey pixels: ROW blocks of 8 x 8 a row, a restart marker after each row of blocks.
SIDE, ROW = 32, 4
BLOCKS = ROW * ROW
#: Frames a second; bins of a frame's histogram; shots: how far above the mean of the last WINDOW differences, in
#: standard deviations, and the least difference (of at most 2) that starts a new one.
RATE, BINS, WINDOW, ABOVE, LEAST = 25, 16, 8, 1.5, 0.2

#: For each place of an 8 x 8 block the zigzag order of JPEG.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, symbols: tuple[int, int]) -> bytes:
    """A Huffman table of two codes, 0 and 10."""
    return _segment(0xC4, bytes([kind, 1, 1, *[0] * 14, *symbols]))


#: Quantisation by 1 throughout; codes 0 for "a coefficient of 8 bits follows" and 10 for "nothing more".
HEAD = (
    b"\xff\xd8" + _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC0, struct.pack(">BHHBBBB", 8, SIDE, SIDE, 1, 1, 0x11, 0))
    + _table(0x00, (8, 0)) + _table(0x10, (8, 0)) + _segment(0xDD, struct.pack(">H", ROW)) + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
)


def _packed(bits: str) -> bytes:
    return int(bits + "1" * (-len(bits) % 8), 2).to_bytes((len(bits) + 7) // 8, "big")


#: A restart interval's end of so many blocks that hold nothing: no DC change, end of block.
NOTHING = [b""] + [_packed("1010" * n) for n in range(1, ROW + 1)]


def frames_of(payload: bytes) -> list[bytes]:
    """The payload, a multiple of 64 bytes, as baseline JPEG images.

    Byte b is a coefficient of size category 8, whose extra bits are b itself: b from 128 up, b - 255 below. The
    first byte of a block is the DC difference, which restarts with each row of blocks; the others follow in
    zigzag order. So each byte takes 9 bits, and a block 72 bytes before 0xFF is stuffed.
    """
    blocks = np.frombuffer(payload, dtype=np.uint8).reshape(-1, 64)
    bits = np.zeros((len(blocks), 64, 9), dtype=np.uint8)
    bits[:, :, 1:] = np.unpackbits(blocks, axis=1).reshape(-1, 64, 8)
    coded = np.packbits(bits.reshape(len(blocks), 576), axis=1).tobytes()
    out = []
    for first in range(0, len(blocks), BLOCKS):
        scan = []
        for row in range(ROW):
            at = first + row * ROW
            n = max(0, min(ROW, len(blocks) - at))
            scan.append((coded[at * 72 : (at + n) * 72] + NOTHING[ROW - n]).replace(b"\xff", b"\xff\0"))
        out.append(HEAD + b"".join(s + (bytes([0xFF, 0xD0 + i % 8]) if i < ROW - 1 else b"") for i, s in enumerate(scan)) + b"\xff\xd9")
    return out


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def avi(frames: list[bytes]) -> bytes:
    """An AVI file of motion-JPEG frames with an index."""
    n, most = len(frames), max(map(len, frames), default=0)
    header = struct.pack("<14I", 1_000_000 // RATE, most * RATE, 0, 0x10, n, 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, RATE, 0, n, most, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    form = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 24, b"MJPG", SIDE * SIDE * 3, 0, 0, 0, 0)
    headers = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", header) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form)))
    movie, index, at = [b"movi"], [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movie.append(_chunk(b"00dc", f))
        at += len(movie[-1])
    return _chunk(b"RIFF", b"AVI " + headers + _chunk(b"LIST", b"".join(movie)) + _chunk(b"idx1", b"".join(index)))


def indexed(data: bytes) -> list[bytes]:
    """The frames that a file's index names, in its order."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, end, movie, index = 12, 8 + struct.unpack_from("<I", data, 4)[0], None, b""
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movie = at + 8
        elif name == b"idx1":
            index = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if movie is None:
        raise ValueError("no frames")
    out = []
    for name, _, offset, size in struct.iter_unpack("<4sIII", index):
        start = movie + offset
        if name != b"00dc" or data[start : start + 4] != name or struct.unpack_from("<I", data, start + 4)[0] != size:
            raise ValueError("the index doesn't match the frames")
        out.append(data[start + 8 : start + 8 + size])
    return out


def _huffman(body: bytes) -> Iterator[tuple[int, dict[tuple[int, int], int]]]:
    """(class and number, {(length, code): symbol}) of the tables of a segment."""
    while body:
        counts, code, table, at = body[1:17], 0, {}, 17
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                table[length, code] = body[at]
                code, at = code + 1, at + 1
            code <<= 1
        yield body[0], table
        body = body[at:]


def _read_blocks(data: bytes, n: int, dc: dict, ac: dict) -> np.ndarray:
    """The general way: n blocks of a restart interval, symbol by symbol, 64 values each with the DC difference first; -1000 marks none."""
    bits, at = "".join(f"{b:08b}" for b in data), 0

    def symbol(table: dict) -> int:
        nonlocal at
        for length in range(1, 17):
            s = table.get((length, int(bits[at : at + length] or "0", 2)))
            if s is not None and at + length <= len(bits):
                at += length
                return s
        raise ValueError("no such code")

    def value(size: int) -> int:
        nonlocal at
        if not size:
            return 0
        v = int(bits[at : at + size], 2)
        at += size
        return v if v >> (size - 1) else v - (1 << size) + 1

    out = np.zeros((n, 64), dtype=np.int64)
    for b in out:
        b[0], k = value(symbol(dc)), 1
        while k < 64:
            s = symbol(ac)
            if s == 0:
                break
            if s == 0xF0:
                k += 16
                continue
            k += s >> 4
            b[k] = value(s & 15)
            k += 1
    return out


_OWN = {(1, 0): 8, (2, 2): 0}
_MARKERS = re.compile(rb"\xff[\xd0-\xd7]")


def coefficients(frame: bytes) -> np.ndarray:
    """Differences of a grey baseline frame: a row of 64 for each block, the DC difference first, then zigzag order.

    Intervals under the own code table are read as arrays: every code is one bit before eight bits of value. What
    that doesn't fit, and all foreign tables, are read symbol by symbol.
    """
    at, tables, interval, width, height = 2, {}, 0, 0, 0
    while True:
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC4:
            tables.update(_huffman(body))
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xC0:
            height, width = struct.unpack_from(">HH", body, 1)
            if body[5] != 1:
                raise ValueError("not a grey frame")
        elif marker == 0xDB:
            if any(x != 1 for x in body[1:65]):
                raise ValueError("quantised")
        elif marker == 0xDA:
            dc, ac = tables[body[2] >> 4], tables[0x10 | body[2] & 15]
            break
    left = -(-width // 8) * -(-height // 8)
    out = []
    for part in _MARKERS.split(frame[at:-2]):
        n = min(left, interval or left)
        left -= n
        data = part.replace(b"\xff\0", b"\xff")
        k = min(n, len(data) // 72) if dc == ac == _OWN else 0
        if k:
            bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8, count=72 * k)).reshape(k * 64, 9)
            if bits[:, 0].any():
                k = 0
            else:
                v = np.packbits(bits[:, 1:], axis=1).reshape(k, 64).astype(np.int64)
                out.append(np.where(v >= 128, v, v - 255))
        if n > k:
            out.append(_read_blocks(data[72 * k :], n - k, dc, ac))
    return np.concatenate(out)


def payload_of(differences: np.ndarray) -> bytes:
    """The bytes that blocks of frames_of() hold; blocks of nothing hold none."""
    full = differences[(differences != 0).all(axis=1)]
    return np.where(full > 0, full, full + 255).astype(np.uint8).tobytes()


def _basis() -> np.ndarray:
    """Row k: the pixels of zigzag coefficient k, in steps of 1/512, so that sums of blocks are exact in single precision."""
    u = np.arange(8)
    c = np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 1 / 2)[:, None]
    whole = np.einsum("ux,vy->uvxy", c, c).reshape(64, 64)
    return np.rint(whole[ZIGZAG] * 512).astype(np.float32)


BASIS = _basis()


def pixels(differences: np.ndarray, row: int = ROW) -> np.ndarray:
    """Blocks of 64 pixels, 0 to 255, after the inverse transform."""
    c = differences.astype(np.float32)
    c[:, 0] = np.cumsum(c[:, 0].reshape(-1, row), axis=1).reshape(-1)
    return np.clip(np.floor((c @ BASIS) / 512 + 128.5), 0, 255).astype(np.uint8)


def histograms(blocks: np.ndarray) -> np.ndarray:
    """Counts of pixels in BINS bins for each frame."""
    n = len(blocks) // BLOCKS
    bins = (blocks.reshape(n, -1) // (256 // BINS)).astype(np.int64) + np.arange(n)[:, None] * BINS
    return np.bincount(bins.ravel(), minlength=n * BINS).reshape(n, BINS)


def shots(counts: np.ndarray) -> list[tuple[int, int]]:
    """(first frame, frame after the last) of each shot.

    A shot ends where the histogram difference to the frame before is above LEAST and above the mean of the
    shot's last WINDOW differences by ABOVE of their standard deviations.
    """
    share = counts / np.maximum(1, counts.sum(axis=1, keepdims=True))
    differences = np.abs(np.diff(share, axis=0)).sum(axis=1)
    out, first, seen = [], 0, []
    for i, d in enumerate(differences.tolist(), 1):
        last = seen[-WINDOW:]
        if d > LEAST and len(last) >= 2 and d > np.mean(last) + ABOVE * np.std(last):
            out.append((first, i))
            first, seen = i, []
        else:
            seen.append(d)
    return [*out, (first, len(counts))]


def store(payload: bytes) -> bytes:
    """The payload as an AVI file, padded with bytes 0 to a positive multiple of 64."""
    return avi(frames_of(payload + b"\0" * (-len(payload) % 64 if payload else 64)))


def read(data: bytes) -> tuple[bytes, np.ndarray]:
    """The payload of a file of store(), and the histograms of its frames."""
    frames = indexed(data)
    differences = np.concatenate([coefficients(f) for f in frames])
    return payload_of(differences), histograms(pixels(differences))


def _texts(docs: DataFrame, run, schema: str) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, {schema}")


def clips(docs: DataFrame) -> DataFrame:
    """Timed clip rows of each text's film: doc_id, clip, start_ms, end_ms, frames. A null text is an empty one: a film of one frame."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, t in zip(b["doc_id"].tolist(), b["text"]):
                _, counts = read(store((t or "").encode("utf-8", "surrogatepass")))
                rows += [(d, i, s * 1000 // RATE, e * 1000 // RATE, e - s) for i, (s, e) in enumerate(shots(counts))]
            yield pd.DataFrame(rows, columns=["doc_id", "clip", "start_ms", "end_ms", "frames"])

    return _texts(docs, run, "clip int, start_ms long, end_ms long, frames long")


def films(docs: DataFrame, media: bool = True) -> DataFrame:
    """One row per row of docs: the text's bytes stored as a film, and what was read back from it.

    n_bytes is unpadded; payload_* come from the decoded frames. feature: frames, shots with first frames, and the
    CRC-32 of all frames' histograms. Null and empty texts make a payload of 64 bytes 0. With `media` the file
    comes along as the column media. Repeated rows stay; other columns go.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 256):
                rows = []
                for d, t in zip(b["doc_id"].iloc[at : at + 256].tolist(), b["text"].iloc[at : at + 256]):
                    raw = (t or "").encode("utf-8", "surrogatepass")
                    data = store(raw)
                    payload, counts = read(data)
                    found = shots(counts)
                    feature = f"frames={len(counts)};shots={','.join(str(s) for s, _ in found)};histograms={zlib.crc32(counts.astype('<i4').tobytes()):08x}"
                    rows.append((d, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature, *([data] if media else [])))
                yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *(["media"] if media else [])])

    return _texts(docs, run, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + (", media binary" if media else ""))
