"""Token ids in files of independent Zstandard frames with a trailing seek table.

A file holds documents in ascending order of id, their ids as little-endian unsigned
32-bit integers one after another:

    frame, frame, ...            Zstandard frames, each with its content's checksum; a frame ends
                                 after the document that fills it, a longer document takes several
    skippable frame 0x184D2A50   the documents: an Arrow stream (doc, start, n_tokens), compressed
    skippable frame 0x184D2A5E   the seek table of the public seekable format: for each frame its
                                 compressed and plain sizes and the low 32 bits of the plain
                                 bytes' XXH64; then the number of frames, a descriptor, a magic number

Any Zstandard decoder turns a file into its ids; a reader of single documents takes the
two tables from the end and decompresses only the frames that hold them.

Writing: rows are dealt by range of id over tasks (equal ids and a hot id are split by
the text's hash and the row), sorted, and each task encodes and writes a file as it goes,
so it holds a frame, not a partition.  A file's name is its own attempt's; the manifest,
a table that Spark commits, names the files of the attempts that counted, so a lost or
repeated task leaves a file that nobody reads.  Reading: tasks open the manifest's files.

Null and empty texts are one end id; repeated rows are documents of their own; rows
without an id come first; an empty table writes an empty manifest.  Among equal ids,
order is by the text's hash, then the text.  Further columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coppice.llm.common import give_back, table
from coppice.llm.tokens import BpeEncoder
from coppice.session import scratch_root, ship

END_ID = 2
FRAME_BYTES = 1 << 16
LEVEL = 3
FILE_ROWS = 1 << 14  # documents of a file, about
#: Fixed values of the public formats: magic numbers of skippable frames and of the seek table; its descriptor says that it has checksums.
DOCUMENTS_MAGIC, SEEK_MAGIC, TABLE_MAGIC, WITH_CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
HEAD, ENTRY, FOOT = struct.Struct("<II"), struct.Struct("<III"), struct.Struct("<IBI")


class CorruptFile(ValueError):
    """A file whose tables or frames aren't what its writer left."""


def file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The shared store and the path in it; a plain path is one of a mounted folder."""
    if "://" not in uri and not uri.startswith("file:"):
        return pa.fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pa.fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


class Writer:
    """Adds documents to an open stream and closes it with both tables."""

    def __init__(self, out, kind: pa.DataType, frame_bytes: int = FRAME_BYTES) -> None:
        self.out, self.kind, self.frame_bytes = out, kind, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self.entries, self.waiting, self.held = [], [], 0
        self.documents, self.counts, self.crcs = [], [], 0

    def add(self, document, ids: bytes) -> None:
        self.documents.append(document)
        self.counts.append(len(ids) // 4)
        for at in range(0, len(ids), self.frame_bytes):
            part = ids[at : at + self.frame_bytes]
            self.waiting.append(part)
            self.held += len(part)
            if self.held >= self.frame_bytes:
                self.flush()

    def flush(self) -> None:
        plain = b"".join(self.waiting)
        if plain:
            frame = self.compressor.compress(plain)
            self.out.write(frame)
            self.entries.append((len(frame), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.waiting, self.held = [], 0

    def close(self) -> int:
        """Both tables; the number of ids of the file."""
        self.flush()
        counts = np.array(self.counts, np.int64)
        columns = [pa.array(self.documents, self.kind), pa.array(np.cumsum(counts) - counts), pa.array(counts)]
        sink = pa.BufferOutputStream()
        batch = pa.RecordBatch.from_arrays(columns, ["doc", "start", "n_tokens"])
        with pa.ipc.new_stream(sink, batch.schema) as stream:
            stream.write_batch(batch)
        index = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True).compress(sink.getvalue())
        seek = b"".join(ENTRY.pack(*e) for e in self.entries) + FOOT.pack(len(self.entries), WITH_CHECKSUMS, TABLE_MAGIC)
        self.out.write(HEAD.pack(DOCUMENTS_MAGIC, len(index)) + index + HEAD.pack(SEEK_MAGIC, len(seek)) + seek)
        return int(counts.sum())


@dataclass
class Tables:
    """Where a file's frames lie, in the file and in its ids, and its documents."""

    at: np.ndarray  # of each frame in the file, and the end of the last
    plain: np.ndarray  # of each frame in the plain bytes, and the end of the last
    checksums: np.ndarray
    documents: pa.Table


def read_tables(source) -> Tables:
    """The tables at the end of an open, seekable file."""
    size = source.size()
    if size < FOOT.size:
        raise CorruptFile("no seek table")
    frames, descriptor, magic = FOOT.unpack(source.read_at(FOOT.size, size - FOOT.size))
    length = frames * ENTRY.size + FOOT.size
    start = size - length - HEAD.size
    if magic != TABLE_MAGIC or descriptor != WITH_CHECKSUMS or start < 0:
        raise CorruptFile("no seek table")
    raw = source.read_at(HEAD.size + frames * ENTRY.size, start)
    if HEAD.unpack_from(raw) != (SEEK_MAGIC, length):
        raise CorruptFile("a seek table of another length")
    entries = np.frombuffer(raw, "<u4", offset=HEAD.size).reshape(-1, 3).astype(np.int64)
    at, plain = (np.concatenate([[0], np.cumsum(entries[:, c])]) for c in (0, 1))
    head = source.read_at(HEAD.size, int(at[-1])) if at[-1] + HEAD.size <= start else b""
    if len(head) < HEAD.size or HEAD.unpack(head) != (DOCUMENTS_MAGIC, start - int(at[-1]) - HEAD.size):
        raise CorruptFile("the frames end elsewhere")
    index = source.read_at(start - int(at[-1]) - HEAD.size, int(at[-1]) + HEAD.size)
    try:
        documents = pa.ipc.open_stream(zstandard.decompress(index, max_output_size=0)).read_all()
    except (zstandard.ZstdError, pa.ArrowInvalid) as e:
        raise CorruptFile(f"unreadable documents: {e}") from e
    return Tables(at, plain, entries[:, 2], documents)


def read_frame(source, tables: Tables, k: int) -> bytes:
    """The plain bytes of a frame, checked."""
    raw = source.read_at(int(tables.at[k + 1] - tables.at[k]), int(tables.at[k]))
    size = int(tables.plain[k + 1] - tables.plain[k])
    try:
        plain = zstandard.ZstdDecompressor().decompress(raw, max_output_size=size)
    except zstandard.ZstdError as e:
        raise CorruptFile(f"frame {k}: {e}") from e
    if len(plain) != size or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != tables.checksums[k]:
        raise CorruptFile(f"frame {k}: wrong checksum")
    return plain


def read_documents(source, tables: Tables, which: Iterable[int]) -> Iterator[tuple[int, bytes]]:
    """(place in the file, ids) of documents by ascending places; a frame is read once, and only where one of them needs it."""
    starts, counts = (tables.documents[c].to_numpy() * 4 for c in ("start", "n_tokens"))
    known, frame = -1, b""
    for i in which:
        at, upto, parts = int(starts[i]), int(starts[i] + counts[i]), []
        k = int(np.searchsorted(tables.plain, at, "right")) - 1
        while at < upto:
            if k != known:
                known, frame = k, read_frame(source, tables, k)
            low, high = int(tables.plain[k]), int(tables.plain[k + 1])
            parts.append(frame[at - low : min(upto, high) - low])
            at, k = min(upto, high), k + 1
        yield i, b"".join(parts)


def write_tokens(df: DataFrame, folder: str, tokenizer: str, text: str = "text", id_col: str = "doc_id", end_id: int = END_ID, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Write the files into ``folder``, a new and shared one, and their manifest, a table in it.

    In the manifest ``start`` is the number of ids in all files before.
    """
    spark = ship(df.sparkSession)
    kind = df.schema[id_col].dataType
    rows = df.select(F.col(id_col).alias("doc"), F.col(text).alias("text")).withColumn("h", F.xxhash64("text"))
    files = max(1, -(-df.count() // FILE_ROWS))
    # the row's number only deals rows of one id and text over files; which of them is where changes nothing
    dealt = rows.withColumn("r", F.monotonically_increasing_id()).repartitionByRange(files, "doc", "h", "r").sortWithinPartitions("doc", "h", "text")
    store, place = file_system(folder)
    store.create_dir(place)
    names = ["part", "file", "first", "last", "documents", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = BpeEncoder.of(tokenizer), end_id.to_bytes(4, "little")
        writer = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                name = f"{uuid.uuid4().hex}.ids.zst"
                store, place = file_system(folder)
                out = store.open_output_stream(f"{place}/{name}", compression=None)
                writer, part = Writer(out, batch.column(0).type, frame_bytes), batch.column(2)[0].as_py()
            for document, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                writer.add(document, encoder.encode_bytes(value or "") + end)
        if writer is not None:
            tokens = writer.close()
            out.close()
            named = [x for x in writer.documents if x is not None]
            values = [part, name, named[0] if named else None, named[-1] if named else None, len(writer.documents), tokens]
            kinds = [pa.int32(), pa.string(), writer.kind, writer.kind, pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)
        give_back()

    schema = f"part int, file string, first {kind.simpleString()}, last {kind.simpleString()}, documents long, tokens long"
    written = dealt.select("doc", "text", F.spark_partition_id().alias("part")).mapInArrow(run, schema)
    written.write.parquet(f"{folder}/manifest")
    return manifest_of(spark, folder)


def manifest_of(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (part, file, first, last, documents, tokens, start): one a file, numbered in order."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.parquet(f"{folder}/manifest").withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_tokens(spark: SparkSession, folder: str, wanted: DataFrame | None = None, ids: bool = True) -> DataFrame:
    """Rows (doc, start, n_tokens, ids_crc32, ids) read from the files; of the documents in ``wanted``, one column, or of all.

    ``ids`` as bytes, or null.  Wanted documents are dealt to the files whose range holds
    them, and only their frames are decompressed.
    """
    ship(spark)
    manifest = manifest_of(spark, folder)
    kind = manifest.schema["first"].dataType.simpleString()
    count = max(1, manifest.count())
    if wanted is None:
        asked = manifest.select("part", "file", "start", F.lit(None).cast(f"array<{kind}>").alias("docs"))
    else:
        asked = wanted_by_file(manifest, wanted, kind)
    names = ["doc", "start", "n_tokens", "ids_crc32", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, place = file_system(folder)
                with store.open_input_file(f"{place}/{row['file']}") as source:
                    tables = read_tables(source)
                    yield from batches_of(source, tables, row)
        give_back()

    def batches_of(source, tables: Tables, row: dict) -> Iterator[pa.RecordBatch]:
        if row["docs"] is None:
            which = range(tables.documents.num_rows)
        else:
            chosen = pa.array(row["docs"], tables.documents["doc"].type)
            which = np.flatnonzero(pa.compute.is_in(tables.documents["doc"], chosen).to_numpy(zero_copy_only=False)).tolist()
        places, crcs, values, held = [], [], [], 0
        for i, raw in read_documents(source, tables, which):
            places.append(i)
            crcs.append(zlib.crc32(raw))
            values.append(raw if ids else None)
            held += len(raw) if ids else 16
            if held > 1 << 22:
                yield as_batch(tables, row["start"], places, crcs, values)
                places, crcs, values, held = [], [], [], 0
        if places:
            yield as_batch(tables, row["start"], places, crcs, values)

    def as_batch(tables: Tables, start: int, places: list, crcs: list, values: list) -> pa.RecordBatch:
        mine = tables.documents.take(pa.array(places, pa.int64())).combine_chunks()
        columns = [mine["doc"], pa.compute.add(mine["start"], start), mine["n_tokens"]]
        columns = [c.chunk(0) for c in columns]
        return pa.RecordBatch.from_arrays([*columns, pa.array(crcs, pa.int64()), pa.array(values, pa.binary())], names)

    schema = f"doc {kind}, start long, n_tokens long, ids_crc32 long, ids binary"
    return asked.repartitionById(count, F.col("part")).mapInArrow(run, schema)


def wanted_by_file(manifest: DataFrame, wanted: DataFrame, kind: str) -> DataFrame:
    """Rows (part, file, start, docs): the wanted ids inside each file's range, by places among the files' bounds."""
    spark = manifest.sparkSession
    bounds = manifest.where("first is not null").orderBy("part").select("part", "first", "last").toArrow()  # a row a file
    shared = spark.sparkContext.broadcast(bounds)
    column = F.col(wanted.columns[0]).cast(kind).alias("doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        firsts, lasts = (np.array(known[c].to_pylist(), object) for c in ("first", "last"))
        for batch in batches:
            docs = np.array(batch.column(0).to_pylist(), object)
            low, high = np.searchsorted(lasts, docs, "left"), np.searchsorted(firsts, docs, "right")
            many = np.maximum(high - low, 0)
            file = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            part = known["part"].to_numpy()[file]
            taken = batch.column(0).take(pa.array(np.repeat(np.arange(len(docs)), many), pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), taken], ["part", "doc"])

    found = wanted.select(column).where("doc is not null").mapInArrow(run, f"part int, doc {kind}")
    # at most the documents of a file, which its writer bounds
    return found.groupBy("part").agg(F.collect_set("doc").alias("docs")).join(manifest, "part").select("part", "file", "start", "docs")


def op13_seekable_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{scratch_root(spark)}/coppice/token-files-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, folder, ids=False).select(F.col("doc").alias("doc_id"), "start", "n_tokens", "ids_crc32")
