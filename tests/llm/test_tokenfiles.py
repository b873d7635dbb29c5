"""Token files against the tokenizers library, a plain decoder of the whole file, and damaged copies."""

import glob
import io
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
import zstandard
from tokenizers import Tokenizer

from coppice.llm import tokenfiles as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
tokenizer = Tokenizer.from_file(PATH)
tokenizer.encode_special_tokens = True


def ids_of(text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()


def expected(rows):
    """(id, start, n, crc, ids) in ascending order of id, nulls first, then hash of the text."""
    out, at = [], 0
    order = lambda r: (r[0] is not None, r[0] or 0, 42 if r[1] is None else xxhash.xxh64(r[1].encode(), seed=42).intdigest() - (xxhash.xxh64(r[1].encode(), seed=42).intdigest() >> 63 << 64))
    for i, text in sorted(rows, key=order):
        ids = ids_of(text)
        out.append((i, at, len(ids) // 4, zlib.crc32(ids), ids))
        at += len(ids) // 4
    return out


RNG = random.Random(3)
ROWS = [(i, " ".join(RNG.choices(["alpha", "beta", "é日", "<|endoftext|>", "\n\n"], k=RNG.choice([0, 1, 40, 900])))) for i in RNG.sample(range(-500, 500), 150)]
ROWS += [(1000, None), (1001, ""), (1002, "word " * 30_000), (None, "no id"), (None, None), (7000, "b"), (7000, "a"), (7000, "a")] + [(8000, "hot")] * 120


@pytest.mark.parametrize("file_rows", [1 << 14, 40])
def test_files_hold_every_document_in_order(spark, tmp_path, monkeypatch, file_rows):
    monkeypatch.setattr(T, "FILE_ROWS", file_rows)
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(5)
    folder = str(tmp_path / "files")
    manifest = T.write_tokens(df, folder, PATH, frame_bytes=4096).orderBy("part").collect()
    assert len(manifest) >= (1 if file_rows > 1000 else 5) and sum(r.documents for r in manifest) == len(ROWS)
    plan = expected(ROWS)
    got = sorted(map(tuple, T.read_tokens(spark, folder).collect()), key=lambda r: r[1])
    assert [(r[0], r[1], r[2], r[3], bytes(r[4])) for r in got] == plan
    # any decoder gives the whole sequence, file after file
    whole = b"".join(zstandard.ZstdDecompressor().stream_reader(open(f"{folder}/{r.file}", "rb"), read_across_frames=True).read() for r in manifest)
    assert whole == b"".join(r[4] for r in plan)
    assert len(glob.glob(f"{folder}/*.ids.zst")) == len(manifest)


def test_wanted_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "FILE_ROWS", 40)
    folder = f"file://{tmp_path}/files"
    T.write_tokens(spark.createDataFrame(ROWS, "doc_id long, text string"), folder, PATH, frame_bytes=512)
    (tmp_path / "files" / "left-by-a-lost-task.ids.zst").write_bytes(b"half a file")
    some = [ROWS[3][0], ROWS[77][0], 7000, 8000, 1002, 5555, -10_000, None]
    wanted = spark.createDataFrame([(i,) for i in some * 2], "x int")
    got = sorted((r.start, r.doc, bytes(r.ids)) for r in T.read_tokens(spark, folder, wanted).collect())
    assert got == sorted((r[1], r[0], r[4]) for r in expected(ROWS) if r[0] is not None and r[0] in some)
    assert T.read_tokens(spark, folder, wanted.limit(0)).count() == 0


def one_file(documents, frame_bytes=64):
    out = io.BytesIO()
    writer = T.Writer(out, pa.int64(), frame_bytes)
    for i, ids in documents:
        writer.add(i, ids)
    writer.close()
    return out.getvalue()


def test_only_the_frames_of_a_document_are_read(monkeypatch):
    documents = [(i, bytes([i]) * 4 * (1 + 7 * i % 40)) for i in range(60)]
    source = pa.BufferReader(one_file(documents))
    tables, read = T.read_tables(source), []
    plain = T.read_frame
    monkeypatch.setattr(T, "read_frame", lambda s, t, k: read.append(k) or plain(s, t, k))
    for i, ids in documents:
        read.clear()
        assert list(T.read_documents(source, tables, [i])) == [(i, ids)]
        at = 4 * tables.documents["start"][i].as_py()
        assert read == [k for k in range(len(tables.checksums)) if tables.plain[k] < at + len(ids) and tables.plain[k + 1] > at]
    read.clear()
    assert [x for _, x in T.read_documents(source, tables, range(60))] == [x for _, x in documents] and read == list(range(len(tables.checksums)))


def test_seek_table_is_the_public_one():
    """The table as the public seekable format states it, read here byte by byte."""
    raw = one_file([(0, b"abcd" * 40), (1, b"efgh")])
    frames, descriptor, magic = struct.unpack("<IBI", raw[-9:])
    assert magic == 0x8F92EAB1 and descriptor == 0x80 and frames == 3
    assert struct.unpack("<II", raw[-9 - 12 * frames - 8 : -9 - 12 * frames]) == (0x184D2A5E, 12 * frames + 9)
    at, text = 0, b""
    for k in range(frames):
        size, plain, checksum = struct.unpack_from("<III", raw, len(raw) - 9 - 12 * (frames - k))
        part = zstandard.decompress(raw[at : at + size])
        assert len(part) == plain and checksum == xxhash.xxh64_intdigest(part) & 0xFFFFFFFF
        at, text = at + size, text + part
    assert text == b"abcd" * 40 + b"efgh"


def test_every_damaged_byte_is_found():
    documents = [(i, bytes(range(4 * i, 4 * i + 8))) for i in range(12)]
    raw = one_file(documents)
    for at in range(len(raw)):
        broken = pa.BufferReader(raw[:at] + bytes([raw[at] ^ 0x55]) + raw[at + 1 :])
        try:
            tables = T.read_tables(broken)
            assert [x for _, x in T.read_documents(broken, tables, range(12))] == [x for _, x in documents]
        except T.CorruptFile:
            continue
        raise AssertionError(f"byte {at}")
    for short in (raw[:-1], raw[: len(raw) // 2], b"", b"x"):
        with pytest.raises(T.CorruptFile):
            T.read_tables(pa.BufferReader(short))


@pytest.mark.parametrize("kind", ["string", "smallint"])
def test_awkward_tables(spark, tmp_path, kind):
    df = spark.createDataFrame([(2, "two", 1, 1), (1, None, 2, 2), (None, "x", 3, 3)], "doc_id long, text string, start long, h long")
    df = df.withColumn("doc_id", df.doc_id.cast(kind))
    T.write_tokens(df, str(tmp_path / "a"), PATH)
    rows = sorted(T.read_tokens(spark, str(tmp_path / "a"), ids=False).collect(), key=lambda r: r.start)
    assert [str(r.doc) for r in rows] == ["None", "1", "2"] and [r.start for r in rows] == [0, 2, 3] and rows[0].ids is None
    T.write_tokens(df.limit(0), str(tmp_path / "b"), PATH)
    assert T.read_tokens(spark, str(tmp_path / "b")).count() == 0
    assert T.read_tokens(spark, str(tmp_path / "b"), df.select("doc_id")).count() == 0
