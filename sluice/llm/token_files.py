"""Token-id files: flat unsigned integers with 64-bit document offsets, read by memory map.

A data set is a folder of pairs, one pair for each partition of the documents in ascending doc_id order:

* ``part-00007.bin``: the ids of its documents one after another, little-endian unsigned integers of
  2 bytes if the vocabulary has at most 65,536 ids, else 4;
* ``part-00007.idx``: 8 bytes ``SLUICE01``, bytes an id and documents (unsigned 64-bit), then the
  documents' offsets in ids (documents + 1 signed 64-bit integers from 0), then their doc_ids (signed
  64-bit; -2**63 stands for null).

``manifest`` (Parquet) has part, documents, ids and base of each pair: base, the ids of all parts before
it, is a prefix sum, so any document's global place is base + offset.

A null text is an empty one, and every document ends with the end id, so none is without ids. Null
doc_ids come first; rows with the same doc_id are kept apart, in the order they are read. An empty table
gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import contextlib
import os
import zlib
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import NO_ID, local_path, new_path
from sluice.llm.tokens import encoder

MAGIC = b"SLUICE01"
#: Documents of a batch that is read back.
BATCH = 10_000


@contextlib.contextmanager
def _writing(folder: str, name: str):
    """A file that appears under its name only when it is whole; a repeated task writes it again."""
    here = local_path(folder)
    if here is not None:
        os.makedirs(here, exist_ok=True)
        own = f"{here}/.{name}.{os.getpid()}.{TaskContext.get().taskAttemptId()}"
        with open(own, "wb") as f:
            yield f
        os.replace(own, f"{here}/{name}")
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    own = f"{path}/.{name}.{TaskContext.get().taskAttemptId()}"
    with store.open_output_stream(own) as f:
        yield f
    store.move(own, f"{path}/{name}")


def _mapped(folder: str, name: str):
    """The file's bytes: a memory map where the folder is a mounted one."""
    here = local_path(folder)
    if here is not None:
        path = f"{here}/{name}"
        return np.memmap(path, dtype=np.uint8, mode="r") if os.path.getsize(path) else np.empty(0, np.uint8)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{path}/{name}") as f:
        return np.frombuffer(f.read_buffer(), dtype=np.uint8)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str, partitions: int | None = None) -> DataFrame:
    """Encode every whole text, append ``end_id`` and write the folder; returns its manifest.

    One range shuffle by doc_id, then each task streams its documents to its own pair of files.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # The place a row is read from parts rows of equal ids (or nulls), however many there are, without reading texts to sample.
    rows = rows.withColumn("read", F.monotonically_increasing_id()).repartitionByRange(n, "doc_id", "read").sortWithinPartitions("doc_id", "read").drop("read")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        part, sizes, ids = TaskContext.get().partitionId(), [], []
        if end_id >= 1 << (8 * enc.dtype.itemsize):
            raise ValueError("the end id does not fit the vocabulary's width")
        end = np.array([end_id], enc.dtype).tobytes()
        with _writing(folder, f"part-{part:05d}.bin") as f:
            for batch in batches:
                ids.append(batch.column(0).to_numpy(zero_copy_only=False).astype("<i8"))
                for text in batch.column(1):
                    found = enc.encode(text.as_py())
                    f.write(found.tobytes() + end)
                    sizes.append(len(found) + 1)
        offsets = np.concatenate([[0], np.cumsum(np.array(sizes, dtype="<i8"))]).astype("<i8")
        with _writing(folder, f"part-{part:05d}.idx") as f:
            f.write(MAGIC + np.array([enc.dtype.itemsize, len(sizes)], "<u8").tobytes() + offsets.tobytes())
            f.write(np.concatenate(ids or [np.empty(0, "<i8")]).astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(sizes)], pa.int64()), pa.array([int(offsets[-1])], pa.int64())], ["part", "documents", "ids"])

    # One row a partition comes to the driver.
    parts = sorted(tuple(r) for r in rows.mapInArrow(write, "part int, documents long, ids long").collect())
    bases = np.cumsum([0] + [p[2] for p in parts])
    manifest = spark.createDataFrame([(*p, int(b)) for p, b in zip(parts, bases)], "part int, documents long, ids long, base long")
    manifest.coalesce(1).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def documents_of(folder: str, part: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """doc_id, offset in its part and ids (a view of the map) of each document of a part."""
    index = _mapped(folder, f"part-{part:05d}.idx")
    if index[:8].tobytes() != MAGIC:
        raise ValueError("not an index of token files")
    width, n = (int(x) for x in np.frombuffer(index[8:24], "<u8"))
    offsets = np.frombuffer(index[24 : 32 + 8 * n], "<i8")
    doc_ids = np.frombuffer(index[32 + 8 * n : 32 + 16 * n], "<i8")
    ids = _mapped(folder, f"part-{part:05d}.bin").view(f"<u{width}")
    for k in range(n):
        yield (None if doc_ids[k] == NO_ID else int(doc_ids[k])), int(offsets[k]), ids[offsets[k] : offsets[k + 1]]


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 (of its ids as little-endian unsigned 32-bit integers)."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    n = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = ((d, base + o, len(x), zlib.crc32(x.astype("<u4").tobytes())) for d, o, x in documents_of(folder, part))
                for rows in batched(found, BATCH):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.select("part", "base").repartitionByRange(n, "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digests(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write the documents' token files to the shared work folder and read them back."""
    folder = new_path(docs.sparkSession, "tokens")
    write_token_files(docs, tokenizer, end_id, folder)
    return read_token_files(docs.sparkSession, folder)
