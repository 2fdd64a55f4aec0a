import base64
import hashlib
import io
import random
import struct

import pytest
import zstandard

from paperloom.llm import warc

PAGES = "page_id long, url string, html string, first long, key string"


def brute(rows):
    out = []
    for p, _, h in rows:
        raw = (h or "").encode()
        same = [q for q, _, g in rows if (g or "") == (h or "") and q is not None]
        first = min(same, default=p)
        out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if p == first else "revisit", None if p == first else first))
    return sorted(out, key=str)


def test_round_trip_against_brute_force(spark):
    rnd = random.Random(1)
    rows = [(i, f"http://h/{i}", f"<html>{'été ' * rnd.randrange(50)}{rnd.randrange(30)}</html>") for i in range(300)]
    rows += [(900, None, None), (901, "u", ""), (902, "bad\r\nurl", None), (None, "n", rows[5][2]), (None, "n", "alone"), (7, "again", rows[7][2]), (903, "big", "z" * 300_000)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], PAGES)
    got = sorted((tuple(r) for r in warc.archive_digests(df).collect()), key=str)
    assert got == brute(rows)
    assert warc.archive_digests(df.limit(0)).count() == 0


def test_small_payloads_stay_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.archive_digests(df, at_least=5).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}


def test_layout(spark, sf):
    folder, manifest = warc.write_archive(spark.read.parquet(f"{sf}/pages.parquet"))
    rows = manifest.collect()
    assert len(rows) == spark.read.parquet(f"{sf}/pages.parquet").count()
    name = rows[0].file
    raw = open(f"{folder.removeprefix('file://')}/{name}", "rb").read()
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == 0x184D2A5D and size
    maker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size]))
    for r in rows[:5]:
        if r.file == name:  # every record can be read alone
            fields, _, payload = warc.parse(maker.decompress(raw[r.offset : r.offset + r.length]))
            assert int(fields["page-id"]) == r.page_id and payload
    payloads = {r.page_id: bytes(r.payload).decode() for r in warc.read_archive(folder, manifest).collect()}
    assert payloads == {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}


def test_single_records_of_every_file(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    folder, manifest = warc.write_archive(pages.repartition(5))
    rows, html = manifest.collect(), {r.page_id: r.html for r in pages.collect()}
    assert len({r.file for r in rows}) == 5
    for name in {r.file for r in rows}:
        with open(f"{folder.removeprefix('file://')}/{name}", "rb") as f:  # plain file access: nothing undoes a compression
            magic, size = struct.unpack("<II", f.read(8))
            assert magic == warc.MAGIC and size
            maker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(f.read(size)))
            mine, end = sorted((r for r in rows if r.file == name), key=lambda r: r.offset), 8 + size
            for r in mine:
                assert r.offset == end  # record follows record
                f.seek(r.offset)
                one = f.read(r.length)
                assert zstandard.get_frame_parameters(one).dict_id
                fields, _, payload = warc.parse(maker.decompress(one))
                assert int(fields["page-id"]) == r.page_id
                assert fields["warc-type"] == "revisit" or payload.decode() == html[r.page_id]
                end += r.length
            assert f.read() == b""
    assert warc.read_archive(folder, manifest).rdd.getNumPartitions() == 5


def test_broken_archives():
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(b"\x28\xb5\x2f\xfd" + b"\0" * 20)))
    whole = struct.pack("<II", warc.MAGIC, 0) + zstandard.ZstdCompressor().compress(b"x" * 1000)
    assert [r for _, r in warc.records(io.BytesIO(whole))] == [b"x" * 1000]
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(whole[:-3])))
    with pytest.raises(ValueError):
        warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n")
