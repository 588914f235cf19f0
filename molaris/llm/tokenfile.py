"""Documents as a folder of token files, and back.

Rows are sorted by document id over all files. A row of a file is a segment of whole documents: the number
of ids before it in the file, document ids and lengths, and all their token ids as directly addressable codes (``dac``). Files are Parquet, so that Spark's own
committer writes them wherever the shared folder is, and a lost executor leaves no half file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from molaris.llm import dac
from molaris.llm.wordbpe import TOGETHER, loaded

END = 1
#: A segment is closed once it has so many ids.
SEGMENT = 1 << 18

_FILE = "part int, first bigint, doc_ids binary, null_ids binary, sizes binary, n_ids bigint, codes binary"


def _segments(path: str, end: int):
    def segment(part: int, first: int, docs: list, ids: list[np.ndarray]) -> pa.RecordBatch:
        flat = np.concatenate(ids)
        row = [
            part, first, np.array([d or 0 for d in docs], "<i8").tobytes(), np.packbits([d is None for d in docs]).tobytes(),
            np.array([len(x) for x in ids], "<i8").tobytes(), len(flat), dac.pack(flat),
        ]
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
        names = ["part", "first", "doc_ids", "null_ids", "sizes", "n_ids", "codes"]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, first = loaded(path), TaskContext.get().partitionId(), 0
        docs, ids, size = [], [], 0
        last = np.array([end], np.uint32)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for at in range(0, len(names), TOGETHER):
                texts = [t or "" for t in batch.column(1).slice(at, TOGETHER).to_pylist()]
                for name, x in zip(names[at:at + TOGETHER], words.encode(texts)):
                    docs.append(name)
                    ids.append(np.concatenate([x, last]))
                    size += len(ids[-1])
                    if size >= SEGMENT:
                        yield segment(part, first, docs, ids)
                        docs, ids, size, first = [], [], 0, first + size
        if docs:
            yield segment(part, first, docs, ids)

    return run


def write(df: DataFrame, folder: str, vocabulary: str, text: str = "text", doc_id: str = "doc_id", end: int = END) -> None:
    """Write every document's ids and the end id, in ascending order of document ids, null ids first.

    A null text counts as empty. Repeated rows are written as often as they come.
    """
    rows = df.select(
        F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.expr(f"xxhash64(`{text}`)").alias("h"))
    # the hash lets rows of one id, such as null, fall into several files
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    # the codes hardly shrink, so no time is spent on it
    ordered.mapInArrow(_segments(vocabulary, end), _FILE).write.option("compression", "uncompressed").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The segments of a folder."""
    return spark.read.schema(_FILE).parquet(folder)


def placed(files: DataFrame) -> DataFrame:
    """The segments with start, the number of ids in all segments before. One small row per part is broadcast."""
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)).alias("before"))
    return files.join(F.broadcast(before), "part").withColumn("start", F.expr("coalesce(before, 0) + first"))


def documents(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from its own slice of the codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                codes, sizes = dac.Codes(row["codes"]), np.frombuffer(row["sizes"], "<i8")
                none = np.unpackbits(np.frombuffer(row["null_ids"], np.uint8))[: len(sizes)].astype(bool)
                at = np.cumsum(sizes) - sizes
                crc = [zlib.crc32(codes.slice(a, n).astype("<u4").tobytes()) for a, n in zip(at.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.frombuffer(row["doc_ids"], "<i8"), pa.int64(), mask=none), pa.array(at + row["start"]),
                    pa.array(sizes), pa.array(crc, pa.int64()),
                ], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    columns = placed(files).select("doc_ids", "null_ids", "sizes", "codes", "start")
    return columns.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
