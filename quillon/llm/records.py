"""Token ids as length-delimited binary records.

A file is a row of frames: length (8 bytes), masked checksum of the length (4), payload,
masked checksum of the payload (4), all little-endian. A payload is the document's id (8,
signed; null as the least value) and its token ids (2 bytes each where the vocabulary
allows, else 4). The offset index, a Parquet table beside the files, has each record's
file and place, so that records can be read in any order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, in_ranges, ready, shared_folder
from .tokens import encoder

END_ID = 1
NULL_ID = -(1 << 63)
INDEX = "part int, seq long, doc_id long, file string, offset long, length long, n_tokens long"
RECORD = "part int, seq long, doc_id long, ids binary, n_tokens long, ids_crc32 long"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def masked(data: bytes) -> int:
    """CRC-32, rotated and shifted so that a checksum of data holding checksums stays telling."""
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return head + struct.pack("<I", masked(head)) + payload + struct.pack("<I", masked(payload))


def unframed(stream) -> Iterator[bytes]:
    """The payloads of a file, in order; a broken frame is an error."""
    while head := stream.read(12):
        length, check = struct.unpack("<QI", head)
        if masked(head[:8]) != check:
            raise ValueError("a record's length is damaged")
        payload = stream.read(length)
        if len(payload) != length or masked(payload) != struct.unpack("<I", stream.read(4))[0]:
            raise ValueError("a record is damaged")
        yield payload


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme that Spark's own writers would take for it, so that executors write beside the index."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + whole.removeprefix("file:") if whole.startswith("file:/") and not whole.startswith("file://") else whole


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def write_records(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write docs (doc_id, text) below folder in ascending doc_id order; the offset index is returned.

    Null or empty text is a record of the end id alone; null ids come first; rows that share an id
    follow each other by text. Other columns, of any name, are not read. An empty table gives no files and an empty index. Texts are dealt by
    ranges of doc_id (and of the texts' beginnings, where many rows share an id) and moved once. A file is written under a name of its task's attempt and then
    renamed, so a task that runs again, or twice, leaves one whole file.
    """
    spark = ready(docs.sparkSession)
    path, folder = tokenizer or vocabulary(), qualified(spark, folder)
    dealt = in_ranges(docs)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, fs, root = encoder(path), *filesystem(folder)
        word = encode.dtype.itemsize
        end = np.array([end_id], dtype=encode.dtype).tobytes()
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        out, seq, temp, at = None, 0, f"{root}/.part-{part:06d}-{attempt}", 0
        fs.create_dir(root, recursive=True)

        def close() -> None:
            if out is not None:
                out.close()
                fs.move(temp, f"{root}/part-{part:06d}.{word}.rec")

        for batch in batches:
            rows = batch.to_pydict()
            ids = encode.encode(rows["text"])
            index: dict[str, list] = {k: [] for k in ("part", "seq", "doc_id", "file", "offset", "length", "n_tokens")}
            for doc, i in zip(rows["doc_id"], ids, strict=True):
                if out is None:
                    out = fs.open_output_stream(temp)
                record = frame(struct.pack("<q", NULL_ID if doc is None else doc) + i + end)
                out.write(record)
                for k, v in zip(index, (part, seq, doc, f"part-{part:06d}.{word}.rec", at, len(record), len(i) // word + 1), strict=True):
                    index[k].append(v)
                seq, at = seq + 1, at + len(record)
            yield pa.RecordBatch.from_pydict(index, schema=pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("doc_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("n_tokens", pa.int64())]))
        close()

    dealt.mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """part, seq, doc_id, ids, n_tokens and ids_crc32 (of 32-bit ids) of every record, read file by file."""
    spark = ready(spark)
    folder = qualified(spark, folder)
    files = spark.read.schema(INDEX).parquet(f"{folder}/index").groupBy("part", "file").agg(F.sum("length").alias("bytes"))
    n = max(1, min(files.count(), 1 << 16))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        schema = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for part, file in zip(batch["part"].to_pylist(), batch["file"].to_pylist(), strict=True):
                kind = np.dtype(f"<u{file.rsplit('.', 2)[1]}")
                with fs.open_input_stream(f"{root}/{file}", buffer_size=1 << 20) as stream:
                    rows: list[tuple] = []
                    size = 0
                    for seq, payload in enumerate(unframed(stream)):
                        doc = struct.unpack_from("<q", payload)[0]
                        ids = np.frombuffer(payload, dtype=kind, offset=8)
                        rows.append((part, seq, None if doc == NULL_ID else doc, payload[8:], len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        size += len(payload)
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return files.repartition(n, "part").select("part", "file").mapInArrow(read, RECORD)


def token_starts(records: DataFrame, index: DataFrame) -> DataFrame:
    """records with start: the ids of all documents before, in the files' order.

    Only one total for each file goes through a single task.
    """
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("_sum"))
    before = totals.select(F.col("part").alias("_part"), F.coalesce(F.sum("_sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    r = records.withColumn("_within", F.sum("n_tokens").over(within) - F.col("n_tokens"))
    return r.join(before, F.col("part") == F.col("_part")).withColumn("start", (F.col("_within") + F.col("_before")).cast("long")).drop("_within", "_part", "_before")


def op5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's record, read back; nulls, empty and long texts, repeated rows and ties of ids as in write_records."""
    docs = documents(spark, sf_dir)
    folder = shared_folder(spark)
    index = write_records(docs, folder)
    read = read_records(spark, folder).drop("ids")
    return token_starts(read, index).select("doc_id", "start", "n_tokens", "ids_crc32")
