import hashlib
import random
import struct
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm import jpeg


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(max_size=2000), max_size=6))
def test_round_trip(texts):
    padded = jpeg.pad(texts)
    assert [jpeg.payload(x) for x in jpeg.decode(jpeg.encode(padded))] == padded if texts else True


def test_many_images_in_a_file():
    p = jpeg.pad([bytes(random.Random(1).randrange(256) for _ in range(1000)) * 3000])
    (got,) = jpeg.decode(jpeg.encode(p))
    assert len(got) == 2 and jpeg.payload(got) == p[0] and {g[0].width for g in got} == {24}


def test_other_baseline_files():
    """Two components, 2x2 subsampling, no restarts, zero runs and end-of-block codes; written by a plain bit writer."""
    rnd = random.Random(4)
    order = [0, 0, 0, 0, 1]
    mcus = [[[0] * 64 for _ in order] for _ in range(6)]
    for m in mcus:
        for b in m:
            b[0] = rnd.randrange(-300, 300)
            for _ in range(rnd.randrange(5)):
                b[rnd.randrange(1, 64)] = rnd.choice([-40, -3, -1, 1, 2, 17])
    dc = bytes(range(12))
    ac = bytes([0x00, 0xF0] + [r << 4 | s for r in range(16) for s in range(1, 7)])
    tables = {0: (dict(zip(dc, range(12))), 5), 1: (dict(zip(ac, range(len(ac)))), 8)}
    bits = ""

    def put(table, symbol, v=0):
        nonlocal bits
        codes, n = tables[table]
        s = symbol & 15
        bits += format(codes[symbol], f"0{n}b") + (format(v if v > 0 else v + (1 << s) - 1, f"0{s}b") if s else "")

    last = [0, 0]
    for m in mcus:
        for c, b in zip(order, m):
            d = b[0] - last[c]
            last[c] = b[0]
            put(0, abs(d).bit_length(), d)
            run = 0
            for k in range(1, 64):
                if b[k]:
                    while run > 15:
                        put(1, 0xF0)
                        run -= 16
                    put(1, run << 4 | abs(b[k]).bit_length(), b[k])
                    run = 0
                else:
                    run += 1
            if run:
                put(1, 0)
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    seg = jpeg._segment
    counts = lambda n, k: bytes(k if i == n else 0 for i in range(1, 17))
    data = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, bytes([0]) + bytes([8] * 64)) + seg(0xC0, struct.pack(">BHHB", 8, 30, 45, 2) + bytes([1, 0x22, 0, 2, 0x11, 0]))
    data += seg(0xC4, b"\x00" + counts(5, 12) + dc) + seg(0xC4, b"\x10" + counts(8, len(ac)) + ac) + seg(0xDA, bytes([2, 1, 0x00, 2, 0x00, 0, 63, 0])) + scan + b"\xff\xd9"
    ((image, got),) = jpeg.decode([data])[0]
    assert got.tolist() == mcus and (image.width, image.height) == (45, 30)
    thumb = jpeg.thumbnail(image, got)
    assert thumb.shape == (4, 6)
    want = np.array([[mcus[(y // 2) * 3 + x // 2][(y % 2) * 2 + x % 2][0] for x in range(6)] for y in range(4)])
    assert (thumb == np.clip(want + 128, 0, 255)).all()
    assert jpeg.decode([data[:-40], b"", b"\xff\xd8junk", data]) [:3] == [None] * 3


def test_query_rows(spark):
    texts = [(1, None), (2, ""), (3, "é" * 5), (4, "x" * 576), (5, "y" * 577), (None, "y" * 577), (5, "y" * 577), (6, "lang " * 60000)]
    df = spark.createDataFrame([(i, t, "m") for i, t in texts], "doc_id long, text string, media string")
    rows = jpeg.media_digests(df).collect()
    assert len(rows) == len(texts)
    for (i, t), r in zip(texts, sorted(rows, key=lambda r: [(x[0], x[1]) for x in texts].index(next(x for x in texts if x[0] == r.doc_id)))):
        raw = (t or "").encode()
        p = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert len({(r.media_sha256, r.feature) for r in rows if r.n_bytes == 577}) == 1
    assert jpeg.media_digests(df.limit(0)).count() == 0
    media = jpeg.to_media(df)
    out = jpeg.media_features(media).collect()
    assert all(r.width == 24 and r.thumb_width == 3 for r in out)
    assert jpeg.media_features(spark.createDataFrame([(None,), (b"no",)], "media binary")).filter("width is null").count() == 2
