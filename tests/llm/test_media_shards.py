import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from coppice.llm import jpeg
from coppice.llm import media as M
from coppice.llm import sharding as S


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=1500))
def test_payloads_come_back(payload):
    data = jpeg.encode(payload)
    assert data[:2] == b"\xff\xd8" and data[-2:] == b"\xff\xd9"
    assert jpeg.payload_of(jpeg.Image(data)) == payload


def test_symbol_decoder_agrees_with_whole_scans(monkeypatch):
    payload = np.random.default_rng(1).integers(0, 256, 4000, np.uint8).tobytes()
    data = jpeg.encode(payload)
    fast = jpeg.Image(data)
    monkeypatch.setattr(jpeg.Scan, "whole", lambda self, bits: False)
    slow = jpeg.Image(data)
    assert all(np.array_equal(a.blocks, b.blocks) for a, b in zip(fast.components, slow.components, strict=True))
    assert np.array_equal(jpeg.to_rgb(fast), jpeg.to_rgb(slow))


def grey_file(scans):
    """A one-component 8 x 8 file with the given (header, bits) scans."""
    frame = bytes([8, 0, 8, 0, 8, 1, 1, 0x11, 0])
    out = b"\xff\xd8" + jpeg.segment(0xDB, b"\0" + b"\1" * 64) + jpeg.segment(0xC2, frame)
    out += jpeg.huffman(0, 0, {2: [0, 3, 4]}) + jpeg.huffman(1, 0, {2: [0x01, 0x02, 0x00], 3: [0x11]})
    for header, bits in scans:
        out += header + jpeg.to_stream(np.array([int(b) for b in bits.replace(" ", "")], np.uint8))
    return out + b"\xff\xd9"


def test_spectral_selection_and_refinement_of_sparse_blocks():
    one = [(1, 0, 0)]
    scans = [
        (jpeg.scan_header(one, 0, 0, 0, 1), "01 101"),  # DC: size 3, 5 << 1
        (jpeg.scan_header(one, 0, 0, 1, 0), "1"),  # its lowest bit
        (jpeg.scan_header(one, 1, 5, 0, 1), "00 1  01 01  10"),  # 1, then -2, end of band
        (jpeg.scan_header(one, 1, 5, 1, 0), "110 0 1 0  10 1".replace("  ", " ")),  # run 1, new -1; corrections
    ]
    block = jpeg.Image(grey_file(scans[:3])).components[0].blocks[0]
    assert block[0] == 11 and block[1:6].tolist() == [2, -4, 0, 0, 0]
    block = jpeg.Image(grey_file(scans)).components[0].blocks[0]
    assert block[1:6].tolist() == [3, -4, 0, -1, 0]


def test_inverse_transform_equals_its_definition():
    c = jpeg.Component(1, 1, 1, 0)
    c.wide = c.tall = 1
    c.blocks = np.random.default_rng(2).integers(-40, 40, (1, 64)).astype(np.int16)
    square = np.zeros((8, 8))
    square.reshape(-1)[jpeg.ZIGZAG] = c.blocks[0]
    k, x = np.arange(8)[:, None], np.arange(8)
    basis = np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    assert np.abs(jpeg.pixels(c, np.ones(64, np.int32)) - basis.T @ square @ basis).max() < 1


def test_media_columns(spark, docs_of):
    texts = [None, "", "x" * 576, "é" * 300, "same", "same", "long " * 30_000]
    stored = M.to_media(docs_of(texts))
    got = {r.doc_id: r for r in M.digests(stored).collect()}
    for i, text in enumerate(texts):
        data = (text or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (
            len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])
        )
    assert got[4][1:] == got[5][1:] and got[0].media_sha256 == got[1].media_sha256
    bad = stored.withColumn("media", F.when(F.col("doc_id") == 1, F.lit(b"junk")).when(F.col("doc_id") == 2, None).otherwise(F.col("media")))
    tensors = {r.doc_id: r for r in M.from_media(bad.where("doc_id < 6")).collect()}
    assert tensors[1].rgb is None and tensors[2].height is None
    assert len(tensors[3].rgb) == tensors[3].height * tensors[3].width * 3
    assert M.digests(M.to_media(docs_of([]))).count() == 0


def sharded(df, shards=16, tolerance=0.001):
    out = {}
    for r in S.shard_by_bytes(df, shards=shards, tolerance=tolerance).collect():
        out.setdefault(r.shard, []).append(r)
    return out


def test_shards_have_near_equal_bytes_and_gapless_slots(spark, docs_of):
    texts = [f"text {i} " + "z" * (i * 37 % 900) for i in range(3000)] + ["hot copy of a text"] * 1500 + [None, "", "é"]
    docs = docs_of(texts)
    got = sharded(docs)
    sizes = {k: sum(r["size"] for r in rows) for k, rows in got.items()}
    assert sorted(got) == list(range(16)) and sum(map(len, got.values())) == len(texts)
    assert max(sizes.values()) - min(sizes.values()) <= 0.03 * sum(sizes.values()) / 16
    for rows in got.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    for r in (r for rows in got.values() for r in rows):
        data = (texts[r.doc_id] or "").encode()
        assert r["size"] == len(data) + 1 and r.text_crc32 == zlib.crc32(data)


@pytest.mark.parametrize("texts", [[], ["one"], [None, None], ["a"] * 40])
def test_shards_of_small_and_equal_tables(spark, docs_of, texts):
    got = sharded(docs_of(texts))
    assert sum(map(len, got.values())) == len(texts)
    if len(texts) == 40:
        assert len(got) == 16


def test_rows_without_id_and_repeated_rows(spark, docs_of):
    docs = docs_of(["a b", "c d"])
    both = docs.union(docs).union(docs.withColumn("doc_id", F.lit(None).cast("long")))
    assert sum(map(len, sharded(both).values())) == 6
