"""Media columns: motion-JPEG in AVI files, written, indexed, decoded and cut into shots.

A payload is stored as 8-bit samples: each is the level of one 8 x 8 block of a grey baseline JPEG frame of
64 x ``ROWS`` blocks (quantiser 8 for the DC term, so a level survives exactly). One block row is a restart
interval. The AVI file has headers, a ``movi`` list, an ``idx1`` index and, as the stream's codec data, the
number of payload bytes. Reading parses the index, decodes every frame at block resolution (DC terms; AC terms
are parsed and passed over, a block's mean does not depend on them), in step over all restart intervals of a
batch. A shot ends where the histogram difference of two frames exceeds its recent mean by ``SIGMAS`` standard
deviations and ``FLOOR``.

Cases: a null or empty text is a payload of 64 zero bytes; equal texts give equal files; long texts take more
frames; repeated rows repeat their result; a null file gives null fields and no clip; a file that is no AVI of grey
baseline frames of one geometry, or is cut off, gives null fields and the reason in ``error``; files of several
geometries may stand side by side; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, spans_to_list

UNIT, ROWS, ACROSS, FPS = 64, 8, 64, 25
WINDOW, SIGMAS, FLOOR, BINS = 12, 3.0, 0.15, 16
PER_FRAME = ROWS * ACROSS
# Code lengths and categories of the usual DC table of luminance.
DC_COUNTS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
DC_VALUES = list(range(12))
AC_COUNTS, AC_VALUES = [1] + [0] * 15, [0]  # end of block alone


def _codes(counts, values):
    """{value: (code, bits)} of a Huffman table."""
    out, code, at = {}, 0, 0
    for bits, n in enumerate(counts, 1):
        for v in values[at : at + n]:
            out[v] = (code, bits)
            code += 1
        at += n
        code <<= 1
    return out


def _lookup(counts, values) -> np.ndarray:
    """For every 16 bits to come: bits of the code, shifted by 8, and its value."""
    out = np.zeros(1 << 16, np.uint16)
    for v, (code, bits) in _codes(counts, values).items():
        out[code << (16 - bits) : (code + 1) << (16 - bits)] = bits << 8 | v
    return out


def _segment(marker, body):
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


HEADER = b"".join([
    b"\xff\xd8",
    _segment(0xDB, bytes([0, 8] + [1] * 63)),
    _segment(0xC0, struct.pack(">BHHB", 8, 8 * ROWS, 8 * ACROSS, 1) + bytes([1, 0x11, 0])),
    _segment(0xC4, bytes([0x00, *DC_COUNTS, *DC_VALUES])),
    _segment(0xC4, bytes([0x10, *AC_COUNTS, *AC_VALUES])),
    _segment(0xDD, struct.pack(">H", ACROSS)),
    _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
])
_DC = _codes(DC_COUNTS, DC_VALUES)
_DC_CODE = np.array([_DC[c][0] for c in range(12)], np.uint64)
_DC_BITS = np.array([_DC[c][1] for c in range(12)], np.uint64)
_SIZE = np.array([int(x).bit_length() for x in range(512)], np.uint64)
_U = np.uint64


def entropy_rows(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coded bytes of all block rows, one after the other, and their sizes; ``samples``: (rows, ACROSS) of 8 bits."""
    n = len(samples)
    level = samples.astype(np.int64) - 128
    diff = np.diff(level, axis=1, prepend=0)
    size = _SIZE[np.abs(diff)]
    extra = (diff + np.where(diff < 0, (1 << size.astype(np.int64)) - 1, 0)).astype(np.uint64)
    value = (_DC_CODE[size] << size | extra) << _U(1)  # the end of block is one zero bit
    bits = _DC_BITS[size] + size + _U(1)
    words = np.zeros((n, ACROSS * 18 // 32 + 3), ">u4")
    held, have, at, lanes = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.int64), np.arange(n)
    for k in range(ACROSS):
        held = held << bits[:, k] | value[:, k]
        have += bits[:, k]
        full = np.flatnonzero(have >= 32)
        have[full] -= _U(32)
        words[lanes[full], at[full]] = held[full] >> have[full] & _U(0xFFFFFFFF)
        at[full] += 1
    total = at * 32 + have.astype(np.int64)
    pad = _U(32) - have
    words[lanes, at] = (held << pad | (_U(1) << pad) - _U(1)) & _U(0xFFFFFFFF)
    sizes = -(-total // 8)
    flat = words.view(np.uint8).reshape(n, -1)
    return flat[np.arange(flat.shape[1]) < sizes[:, None]], sizes


def frames(samples: np.ndarray) -> list[bytes]:
    """JPEG files of all frames; ``samples``: (frames * ROWS, ACROSS)."""
    body, sizes = entropy_rows(samples)
    twice = 1 + (body == 255)
    stuffed = np.repeat(body, twice)
    stuffed[np.cumsum(twice)[body == 255] - 1] = 0
    sizes = np.add.reduceat(twice, np.cumsum(sizes) - sizes)
    out = np.empty(len(stuffed) + 2 * len(sizes), np.uint8)
    ends = np.cumsum(sizes + 2)
    out[spans_to_list(ends - sizes - 2, sizes)] = stuffed
    row = np.arange(len(sizes)) % ROWS
    out[ends - 2], out[ends - 1] = 255, np.where(row == ROWS - 1, 0xD9, 0xD0 + row % 8)
    cuts = [0, *ends[ROWS - 1 :: ROWS].tolist()]
    raw = out.tobytes()
    return [HEADER + raw[a:z] for a, z in zip(cuts, cuts[1:])]


def _chunk(name, body):
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def avi(images: list[bytes], payload: int) -> bytes:
    """An AVI file of motion-JPEG frames; ``payload`` bytes of them count."""
    largest = max(map(len, images), default=0)
    main = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, len(images), 0, 1, largest, 8 * ACROSS, 8 * ROWS, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, len(images), largest, 0xFFFFFFFF, 0, 0, 0, 8 * ACROSS, 8 * ROWS)
    form = struct.pack("<IiiHH4sIiiII", 40, 8 * ACROSS, 8 * ROWS, 1, 8, b"MJPG", 64 * PER_FRAME, 0, 0, 256, 256)
    streams = _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form) + _chunk(b"strd", struct.pack("<Q", payload)))
    index, at, parts = [], 4, []
    for image in images:
        parts.append(_chunk(b"00dc", image))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(image)))
        at += len(parts[-1])
    body = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + streams) + _chunk(b"LIST", b"movi" + b"".join(parts)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"AVI " + body


def _chunks(raw, at, end):
    while at + 8 <= end:
        name, size = raw[at : at + 4], int.from_bytes(raw[at + 4 : at + 8], "little")
        yield name, at + 8, size
        at += 8 + size + size % 2


def parse_avi(raw: bytes) -> tuple[list[tuple[int, int]], int, float]:
    """(start, size) of every indexed frame, payload bytes (-1 if not told), seconds a frame."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    found, payload, each, movi, index = [], -1, 1 / FPS, None, None
    for name, at, size in _chunks(raw, 12, len(raw)):
        if name == b"LIST" and raw[at : at + 4] == b"hdrl":
            for n, a, s in _chunks(raw, at + 4, at + size):
                if n == b"avih":
                    each = struct.unpack_from("<I", raw, a)[0] / 1e6
                elif n == b"LIST":
                    payload = next((struct.unpack_from("<Q", raw, b)[0] for m, b, _ in _chunks(raw, a + 4, a + s) if m == b"strd"), payload)
        elif name == b"LIST" and raw[at : at + 4] == b"movi":
            movi = at
        elif name == b"idx1":
            index = np.frombuffer(raw, "<u4", size // 4, at).reshape(-1, 4)
    if movi is None or index is None:
        raise ValueError("no movi list or no index")
    for name, _, offset, size in index.tolist():
        if name.to_bytes(4, "little")[2:] == b"dc":
            found.append((movi + offset + 8, size))
    return found, payload, each


def parse_header(raw: bytes) -> dict:
    """Geometry and tables of a grey baseline JPEG; ``size``: bytes up to the coded data."""
    at, out, dc, ac = 2, {"restart": 0}, {}, {}
    while True:
        marker, size = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
        body = raw[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC0:
            out["high"], out["wide"], parts = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big"), body[5]
            if body[0] != 8 or parts != 1:
                raise ValueError("only grey frames of 8 bits")
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline frames")
        elif marker == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                out.setdefault("quantisers", {})[body[0] & 15] = int.from_bytes(body[1 : 1 + wide], "big")
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                counts = list(body[1:17])
                (ac if body[0] >> 4 else dc)[body[0] & 15] = _lookup(counts, list(body[17 : 17 + sum(counts)]))
                body = body[17 + sum(counts) :]
        elif marker == 0xDD:
            out["restart"] = int.from_bytes(body, "big")
        elif marker == 0xDA:
            out |= {"dc": dc[body[2] >> 4], "ac": ac[body[2] & 15], "size": at}
            break
    out["blocks"] = -(-out["wide"] // 8) * -(-out["high"] // 8)
    out["quantiser"] = next(iter(out["quantisers"].values()))
    return out


def decode(coded: list[bytes], head: dict) -> np.ndarray:
    """(frames, blocks) mean level of every block, from the coded data of frames of one geometry."""
    body = np.frombuffer(b"".join(coded), np.uint8)
    marks = np.flatnonzero((body[:-1] == 255) & (body[1:] != 0))  # restart or end, behind each interval
    starts = np.concatenate([[0], marks[:-1] + 2])
    keep = np.ones(len(body), bool)
    keep[1:] = ~((body[:-1] == 255) & (body[1:] == 0))
    place = np.cumsum(keep) - keep
    plain = np.concatenate([body[keep], np.zeros(8, np.uint8)])
    window = np.ndarray(len(plain) - 7, ">u8", plain.tobytes(), strides=(1,))
    at = place[starts] * 8
    lanes, blocks = len(starts), head["blocks"]
    step = head["restart"] or blocks
    each = lanes // len(coded)
    left = np.tile(np.minimum(step, blocks - step * np.arange(each)), len(coded))
    out = np.zeros((lanes, step), np.int32)
    level = np.zeros(lanes, np.int64)
    for k in range(step):
        live = slice(None) if left.min() > k else np.flatnonzero(left > k)
        p = at[live]
        w = window[p >> 3].astype(np.uint64) << (p & 7).astype(np.uint64)
        sym = head["dc"][w >> _U(48)]
        bits, size = (sym >> 8).astype(np.uint64), (sym & 255).astype(np.uint64)
        w = w << bits
        extra = (w >> _U(1) >> (_U(63) - size)).astype(np.int64)
        span = np.int64(1) << size.astype(np.int64)
        level[live] += np.where(2 * extra >= span, extra, extra - span + 1)
        out[live, k] = level[live]
        w = w << size
        sym = head["ac"][w >> _U(48)]
        p = p + (bits + size).astype(np.int64) + (sym >> 8)
        more = np.flatnonzero(sym & 255)
        if len(more):
            p[more] = _pass_ac(window, p[more], sym[more], head["ac"])
        at[live] = p
    rows = out[np.arange(step) < left[:, None]].reshape(len(coded), blocks)
    return np.clip(np.rint(rows * (head["quantiser"] / 8)) + 128, 0, 255).astype(np.uint8)


def _pass_ac(window, p, sym, table):
    """Bit places behind the blocks whose first AC symbol was read just now."""
    done = np.zeros(len(p), bool)
    k = np.ones(len(p), np.int64)
    while True:
        value = (sym & 255).astype(np.int64)
        run, size = value >> 4, value & 15
        p = np.where(done, p, p + size)
        k = np.where(done, k, k + run + 1)
        done |= (value == 0) | (k > 63)
        if done.all():
            return p
        w = window[p >> 3].astype(np.uint64) << (p & 7).astype(np.uint64)
        sym = np.where(done, 0, table[w >> _U(48)])
        p = np.where(done, p, p + (sym >> 8))


def cuts(levels: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a shot begins at each frame, and its histogram difference to the frame before; ``first``: first frame of every file."""
    n, per = levels.shape
    hist = np.bincount(((np.arange(n) * BINS)[:, None] + levels // (256 // BINS)).ravel(), minlength=n * BINS).reshape(n, BINS)
    starts = np.zeros(n, bool)
    starts[first] = True
    diff = np.zeros(n)
    diff[1:] = np.abs(np.diff(hist, axis=0)).sum(axis=1) / (2 * per)
    diff[starts] = 0
    begin = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    low = np.maximum(begin + 1, np.arange(n) - WINDOW)  # the differences before this one, inside the file
    count = np.maximum(np.arange(n) - low, 0)
    total, square = np.concatenate([[0], np.cumsum(np.rint(diff * 2 * per))]), np.concatenate([[0], np.cumsum(np.rint(diff * 2 * per) ** 2)])
    low = np.minimum(low, np.arange(n))
    mean = (total[:n] - total[low]) / np.maximum(count, 1) / (2 * per)
    var = (square[:n] - square[low]) / np.maximum(count, 1) / (2 * per) ** 2 - mean**2
    limit = np.maximum(FLOOR, mean + SIGMAS * np.sqrt(np.maximum(var, 0)))
    return starts | ((diff > limit) & (count > 0)), diff


def store_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every text's bytes, with zeros up to a positive multiple of 64, as a motion-JPEG AVI file."""

    def run(batches):
        for b in slices(batches, "_text", 2 << 20):
            bodies = [x or b"" for x in b.column("_text").cast(pa.binary()).to_pylist()]
            payloads = [max(UNIT, -(-len(x) // UNIT) * UNIT) for x in bodies]
            counts = [-(-p // PER_FRAME) for p in payloads]
            # The last frame is filled up by the payload once more, so that its histogram is that of the content.
            whole = [x.ljust(p, b"\0") for x, p in zip(bodies, payloads)]
            samples = np.frombuffer(b"".join((x * (1 + PER_FRAME // len(x)))[: c * PER_FRAME] if len(x) < PER_FRAME else x + x[: c * PER_FRAME - len(x)] for x, c in zip(whole, counts)), np.uint8)
            images = frames(samples.reshape(-1, ACROSS))
            ends = np.cumsum(counts).tolist()
            files = [avi(images[e - c : e], p) for e, c, p in zip(ends, counts, payloads)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) for x in bodies], pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("_text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


CLIP = pa.struct([("clip", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("first_frame", pa.int32()), ("frames", pa.int32()), ("difference", pa.float64())])
READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, clips array<struct<clip int, start_s double, end_s double, first_frame int, frames int, difference double>>, error string"
_BROKEN = (ValueError, IndexError, KeyError, struct.error)  # what parsing and decoding raise on foreign or cut files


def _decoded(files):
    """Levels of all frames of the files in order, the first frame of each file, payload sizes, seconds a frame."""
    spans = [parse_avi(x) for x in files]
    heads, kinds, coded = {}, [], []
    for x, (found, _, _) in zip(files, spans):
        for at, size in found:
            raw = x[at : at + size]
            kind = next((h for h in heads if raw.startswith(h)), None)
            if kind is None:
                head = parse_header(raw)
                kind = raw[: head["size"]]
                heads[kind] = head
            kinds.append(kind)
            coded.append(raw[len(kind) :])
            if heads[kind]["blocks"] * 2 > len(coded[-1]) * 8:
                raise ValueError("fewer bits than blocks")
    if len(heads) > 1:
        raise ValueError("frames of several geometries")
    levels = decode(coded, heads[kinds[0]]) if coded else np.zeros((0, PER_FRAME), np.uint8)
    counts = np.array([len(s[0]) for s in spans])
    return levels, np.cumsum(counts) - counts, counts, [s[1] for s in spans], [s[2] for s in spans]


def _read(files):
    """What is read back from each file; all are decoded in step."""
    levels, first, counts, payloads, each = _decoded(files)
    cut, diff = cuts(levels, first[counts > 0]) if len(levels) else (np.zeros(0, bool), np.zeros(0))
    for x, f, n, p, s in zip(files, first.tolist(), counts.tolist(), payloads, each):
        body = levels[f : f + n].tobytes()
        body = body if p < 0 else body[:p]
        begin = np.flatnonzero(cut[f : f + n]).tolist()
        shots = [{"clip": k, "start_s": a * s, "end_s": z * s, "first_frame": a, "frames": z - a, "difference": round(float(diff[f + a]), 6)} for k, (a, z) in enumerate(zip(begin, [*begin[1:], n]))]
        yield len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-UNIT:]), len(x), hashlib.sha256(x).hexdigest(), shots, None


def _read_each(files):
    """The same file by file, with the reason for those that cannot be read."""
    for x in files:
        try:
            yield from _read([x])
        except _BROKEN as reason:
            yield (None,) * 6 + (f"{type(reason).__name__}: {reason}",)


def read_media(media: DataFrame, column: str = "media") -> DataFrame:
    """The rows without the files, with what was read back from them: payload, digests, clips, and why a file is unreadable."""
    from pyspark.sql import types as T

    new = T._parse_datatype_string(READ)
    rest = [f for f in media.schema.fields if f.name != column and f.name not in new.names]

    def run(batches):
        for b in slices(batches, column, 4 << 20):
            files = b.column(column).to_pylist()
            some = [x for x in files if x is not None]
            try:
                rows = list(_read(some))
            except _BROKEN:
                rows = list(_read_each(some))
            done = iter(rows)
            rows = [next(done) if x is not None else (None,) * 7 for x in files]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(CLIP), pa.string()]
            arrays = [b.column(f.name) for f in rest] + [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in rest] + new.names)

    return media.mapInArrow(run, T.StructType([*rest, *new.fields]))


def clips(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """One timed row per shot: (doc_id, clip, start_s, end_s, first_frame, frames, difference)."""
    return read_media(media.select(F.col(key).alias("doc_id"), column), column).select("doc_id", F.inline("clips"))
