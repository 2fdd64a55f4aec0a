"""Media columns as baseline JPEG: lossless storage of bytes, a scan decoder, and DC-only luminance thumbnails.

The format's unit is the quantised DCT coefficient: a payload byte b is stored as coefficient b - 128 (b - 127 from 128
on, so that none is zero), 64 to a block in zigzag order, 9 blocks (one row of a 24-pixel-wide image) to a restart
interval. The file is an ordinary grey baseline JPEG (SOI, DQT, SOF0, DHT, DRI, SOS, EOI); a payload of more rows than
one image can have goes on in a further image right behind.

decode() is a baseline decoder in numpy: it parses the markers, removes stuffed bytes, and Huffman-decodes all restart
intervals of a batch in lockstep, a symbol of each at a time. Other files (several components, subsampling, no restarts)
work too. Memory is bounded by about CHUNK payload bytes at a time, or one row's text if that is longer.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import ship
from .text import column, slices

UNIT = 576
ROWS = 65535 // 24  # units in one image
CHUNK = 1 << 20
_BYTES = np.arange(256)
_VALUE = np.where(_BYTES < 128, _BYTES - 128, _BYTES - 127).astype(np.int32)


def _sizes(v: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(np.abs(v) + 1)).astype(np.int64)


def _coded(v: np.ndarray, total: int) -> np.ndarray:
    """The bits of each value's category code (total - size ones, the last of them zero) and amplitude: total bits."""
    s = _sizes(v)
    amplitude = np.where(v >= 0, v, v + (1 << s) - 1)
    code = ((1 << (total - s)) - 2) << s | amplitude
    return (code[:, None] >> np.arange(total - 1, -1, -1) & 1).astype(np.uint8)


_AC = _coded(_VALUE.astype(np.int64), 9)
_DC = _coded(np.arange(-256, 257), 10)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


_TABLES = (
    _segment(0xDB, bytes([0]) + bytes([1] * 64)),
    _segment(0xC4, bytes([0x00]) + bytes([1] * 10 + [0] * 6) + bytes(range(9, -1, -1)))
    + _segment(0xC4, bytes([0x10]) + bytes([1] * 8 + [0] * 8) + bytes(range(8, 0, -1)))
    + _segment(0xDD, struct.pack(">H", 3 * 3))
    + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
)


def _head(units: int) -> bytes:
    return b"\xff\xd8" + _TABLES[0] + _segment(0xC0, struct.pack(">BHHB", 8, 24 * units, 24, 1) + bytes([1, 0x11, 0])) + _TABLES[1]


def pad(texts: list[bytes]) -> list[bytes]:
    return [t + b"\xff" * (-len(t) % UNIT if t else UNIT) for t in texts]


def encode(payloads: list[bytes]) -> list[bytes]:
    """A JPEG file for each payload; a payload's length is a positive multiple of 576."""
    data = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, 9, 64)
    n = len(data)
    bits = np.ones((n, (9 * 577 + 7) // 8 * 8), np.uint8)
    blocks = bits[:, : 9 * 577].reshape(n, 9, 577)
    dc = _VALUE[data[:, :, 0]]
    blocks[:, :, :10] = _DC[np.diff(dc, axis=1, prepend=0) + 256]
    blocks[:, :, 10:] = _AC[data[:, :, 1:]].reshape(n, 9, 567)
    raw = np.packbits(bits, axis=1)
    width = raw.shape[1]
    full = (raw == 255).ravel()
    extra = full.astype(np.int64)
    extra[width - 1 :: width] += 2
    at = np.cumsum(extra) - extra + np.arange(len(extra))
    out = np.zeros(len(extra) + int(extra.sum()), np.uint8)
    out[at] = raw.ravel()
    last = at[width - 1 :: width] + full[width - 1 :: width] + 1  # where each interval's closing marker is
    out[last] = 255
    marker, first, units = np.empty(n, np.uint8), 0, [len(p) // UNIT for p in payloads]
    starts = np.concatenate([[0], last + 2])
    frames = []
    for u in units:
        mine = []
        for i in range(first, first + u, ROWS):
            k = min(ROWS, first + u - i)
            marker[i : i + k] = 0xD0 + np.arange(k) % 8
            marker[i + k - 1] = 0xD9
            mine.append((k, starts[i], starts[i + k]))
        frames.append(mine)
        first += u
    out[last + 1] = marker
    whole = out.tobytes()
    return [b"".join(x for k, a, b in mine for x in (_head(k), whole[a:b])) for mine in frames]


class Image:
    """What the markers of one image say, and its entropy-coded bytes."""

    def __init__(self, data: bytes, i: int):
        if data[i : i + 2] != b"\xff\xd8":
            raise ValueError("no SOI")
        i += 2
        self.restart, self.quant, self.huffman, parts, scan = 0, {}, {}, None, None
        while scan is None:
            if i + 4 > len(data) or data[i] != 255:
                raise ValueError("no marker")
            kind, size = data[i + 1], struct.unpack(">H", data[i + 2 : i + 4])[0]
            body = data[i + 4 : i + 2 + size]
            i += 2 + size
            if kind == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                    body = body[65 + 64 * wide :]
            elif kind == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.huffman[body[0]] = bytes(body[1 : 17 + n])
                    body = body[17 + n :]
            elif kind in (0xC0, 0xC1):
                bits, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
                if bits != 8 or not self.height or not self.width:
                    raise ValueError("not baseline")
                parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            elif 0xC2 <= kind <= 0xCF and kind != 0xC8 and kind != 0xCC:
                raise ValueError("not baseline")
            elif kind == 0xDD:
                self.restart = struct.unpack(">H", body[:2])[0]
            elif kind == 0xDA:
                scan = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
        if parts is None or set(scan) != {p[0] for p in parts}:
            raise ValueError("more than one scan")
        raw = np.frombuffer(data, np.uint8)[i:]
        ff = np.flatnonzero(raw[:-1] == 255)
        ff = ff[raw[ff + 1] != 0]
        stop = ff[(raw[ff + 1] < 0xD0) | (raw[ff + 1] > 0xD7)]
        if not len(stop):
            raise ValueError("no EOI")
        self.end = i + int(stop[0]) + 2
        cuts = ff[ff < stop[0]]
        self.scan, self.cuts = raw[: stop[0]], cuts
        if len(parts) == 1:  # one component is never interleaved
            parts = [(parts[0][0], 1, 1, parts[0][3])]
        h, v = max(p[1] for p in parts), max(p[2] for p in parts)
        self.across, self.down = -(-self.width // (8 * h)), -(-self.height // (8 * v))
        self.parts, self.h, self.v = parts, parts[0][1], parts[0][2]
        self.order = [(c, t[0], t[1]) for c, p in enumerate(parts) for t in [(scan[p[0]] >> 4, 16 + (scan[p[0]] & 15))] for _ in range(p[1] * p[2])]
        self.tables = (tuple(self.order), tuple(sorted(self.huffman.items())))


def _lookup(spec: bytes) -> np.ndarray:
    """For each 16 bits: the code's length << 8 | its symbol; 0 where there is no such code."""
    out, code, k = np.zeros(65536, np.int64), 0, 16
    for length in range(1, 17):
        for _ in range(spec[length - 1]):
            out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | spec[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _lockstep(scan: np.ndarray, start: np.ndarray, blocks: np.ndarray, image: Image) -> np.ndarray:
    """Coefficients (interval, block, 64) in zigzag order, DC as coded; scan is free of stuffing and markers."""
    kinds = sorted({t for x in image.order for t in x[1:]})
    table = np.concatenate([_lookup(image.huffman[t]) for t in kinds])
    which = np.array([[kinds.index(t) << 16 for t in x[1:]] for x in image.order])
    padded = np.concatenate([scan, np.zeros(8, np.uint8)])
    word = np.zeros(len(scan) + 1, np.uint64)
    for i in range(8):
        word |= padded[i : i + len(word)].astype(np.uint64) << np.uint64(56 - 8 * i)
    out = np.zeros((len(start), int(blocks.max(initial=0)), 64), np.int16)
    flat, mcu = out.reshape(-1), len(image.order)
    at, base, left = start * 8, np.arange(len(start)) * (out.shape[1] * 64), blocks * 64
    k = np.zeros(len(start), np.int64)
    limit = len(scan) * 8
    while len(k):
        if (at > limit).any():
            raise ValueError("scan too short")
        bits = word[at >> 3] << (at & 7).astype(np.uint64)
        z = k & 63
        found = table[(bits >> np.uint64(48)).astype(np.int64) + which[(k >> 6) % mcu, (z > 0).astype(np.int64)]]
        length, symbol = found >> 8, found & 255
        if not length.all():
            raise ValueError("no such code")
        size, run = symbol & 15, symbol >> 4
        v = ((bits << length.astype(np.uint64)) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
        v -= (v < (1 << size >> 1)) * ((1 << size) - 1)
        k = np.where((size == 0) & (z > 0), np.where(run == 15, k + 16, (k | 63) + 1), k + (run * (z > 0)))
        put = (size > 0) & (k < left)
        flat[(base + k)[put]] = v[put]
        k += (size > 0) | (z == 0)
        at = at + length + size
        on = k < left
        if not on.all():
            at, base, left, k = at[on], base[on], left[on], k[on]
    return out


def decode(files: list[bytes]) -> list[list[tuple[Image, np.ndarray]] | None]:
    """For each file its images with their coefficients (MCU, block of it, 64), zigzag order; None: not a baseline JPEG."""
    found: list = []
    for f in files:
        try:
            mine, i = [], 0
            while i < len(f):
                mine.append(Image(f, i))
                i = mine[-1].end
            found.append(mine or None)
        except (ValueError, IndexError, KeyError, struct.error):
            found.append(None)
    groups: dict = {}
    for f, images in enumerate(found):
        for image in images or []:
            groups.setdefault((image.tables, image.restart), []).append((f, image))
    bad = set()
    for group in groups.values():
        try:
            _decode_alike([x for _, x in group])
        except (ValueError, KeyError, IndexError):
            for f, x in group:  # one bad file spoils none but itself
                try:
                    _decode_alike([x])
                except (ValueError, KeyError, IndexError):
                    bad.add(f)
    return [None if x is None or f in bad else [(i, i.coefficients) for i in x] for f, x in enumerate(found)]


def _decode_alike(images: list[Image]) -> None:
    scans, starts, blocks, offset = [], [], [], 0
    for x in images:
        mcus, each = x.across * x.down, x.restart or x.across * x.down
        n = -(-mcus // each)
        if len(x.cuts) != n - 1:
            raise ValueError("restarts don't fit")
        drop = np.zeros(len(x.scan), bool)
        drop[1:] = (x.scan[:-1] == 255) & (x.scan[1:] == 0)
        drop[x.cuts] = drop[x.cuts + 1] = True
        kept = np.cumsum(~drop)
        scans.append(x.scan[~drop])
        starts.append(np.concatenate([[0], kept[x.cuts + 1]]) + offset)
        offset += len(scans[-1])
        b = np.full(n, each)
        b[-1] = mcus - each * (n - 1)
        blocks.append(b * len(x.order))
    count = np.concatenate(blocks)
    got = _lockstep(np.concatenate(scans), np.concatenate(starts), count, images[0])
    parts = np.array([c for c, _, _ in images[0].order])
    got = got.reshape(len(got), -1, len(parts), 64)
    for c in np.unique(parts):  # DC is coded as differences within an interval and component
        mine = got[:, :, parts == c, 0]
        got[:, :, parts == c, 0] = np.cumsum(mine.reshape(len(got), -1), axis=1).reshape(mine.shape)
    i = 0
    for x, b in zip(images, blocks):
        part = got[i : i + len(b)].reshape(-1, len(parts), 64)
        x.coefficients = part[: x.across * x.down] if len(b) == 1 or len(part) == b.sum() // len(parts) else np.concatenate([got[i + j, : m // len(parts)] for j, m in enumerate(b)])
        i += len(b)


def thumbnail(image: Image, coefficients: np.ndarray) -> np.ndarray:
    """Luminance at an eighth of the size: one pixel for each block, from its DC coefficient alone."""
    h, v = image.h, image.v
    dc = coefficients[:, : h * v, 0].astype(np.int64) * image.quant[image.parts[0][3]][0]
    pixels = dc.reshape(image.down, image.across, v, h).transpose(0, 2, 1, 3).reshape(image.down * v, image.across * h)
    return np.clip((pixels + 4) // 8 + 128, 0, 255).astype(np.uint8)[: -(-image.height // 8), : -(-image.width // 8)]


def perceptual(pixels: np.ndarray) -> str:
    """64 bits in hex: for each of 64 equal stretches of the thumbnail, whether its mean is above the whole mean."""
    flat = pixels.ravel().astype(np.float64)
    cut = np.arange(65) * len(flat) // 64
    total = np.concatenate([[0], np.cumsum(flat)])
    mean = (total[cut[1:]] - total[cut[:-1]]) / np.maximum(1, np.diff(cut))
    return np.packbits(mean > flat.mean()).tobytes().hex()


def feature(images: list[tuple[Image, np.ndarray]]) -> str:
    """width x height of each image, the hash of all thumbnails, and the first thumbnail's perceptual hash."""
    thumbs = [thumbnail(*x) for x in images]
    digest = hashlib.sha256(b"".join(t.tobytes() for t in thumbs)).hexdigest()[:16]
    return ",".join(f"{x.width}x{x.height}" for x, _ in images) + f":{digest}:{perceptual(thumbs[0])}"


def payload(images: list[tuple[Image, np.ndarray]]) -> bytes:
    """The bytes that encode() stored."""
    v = np.concatenate([c.ravel() for _, c in images]).astype(np.int32)
    return np.where(v < 0, v + 128, v + 127).astype(np.uint8).tobytes()


def to_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a binary column media: the text (null: empty) as JPEG. A column of that name is replaced."""
    ship(docs.sparkSession)
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("binary")
    def media(s):
        import pandas as pd

        return pd.Series(encode(pad([(x or "").encode() for x in s])))

    return docs.withColumn("media", media(F.col(text)))


def media_features(df: DataFrame, media: str = "media") -> DataFrame:
    """df with width, height, thumb_width, thumb_height, thumb_sha256, feature of its first image; null where it is no
    baseline JPEG or null."""
    ship(df.sparkSession)
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("width int, height int, thumb_width int, thumb_height int, thumb_sha256 string, feature string")
    def features(s):
        import pandas as pd

        rows = []
        for x in decode([b or b"" for b in s]):
            if x is None:
                rows.append((None,) * 6)
                continue
            t = thumbnail(*x[0])
            rows.append((x[0][0].width, x[0][0].height, t.shape[1], t.shape[0], hashlib.sha256(t.tobytes()).hexdigest(), feature(x)))
        return pd.DataFrame(rows, columns=["width", "height", "thumb_width", "thumb_height", "thumb_sha256", "feature"])

    return df.withColumn("_jpeg", features(F.col(media))).select(*[c for c in df.columns if c not in ("width", "height", "thumb_width", "thumb_height", "thumb_sha256", "feature")], "_jpeg.*")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for whole in batches:
        for batch in slices(whole, "text", CHUNK):
            data, at = column(batch.column(1))
            raw = data.tobytes()
            media = encode(pad([raw[at[i] : at[i + 1]] for i in range(batch.num_rows)]))
            rows = []
            for i, images in enumerate(decode(media)):
                p, m = payload(images), media[i]
                rows.append((int(at[i + 1] - at[i]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(images)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x) for x in zip(*rows)]], names)


def media_digests(docs: DataFrame) -> DataFrame:
    """Stores every text of docs (doc_id, text) as JPEG, reads the stored bytes back, and digests both.

    A null text is empty; an empty one is a payload of 576 bytes of 255. Equal texts have equal values. Rows without
    doc_id keep their null; repeated rows each give a row; an empty table an empty result; other columns are ignored.
    """
    ship(docs.sparkSession)
    out = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_digest, out)
