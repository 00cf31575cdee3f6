"""Token ids as flat binary files with document offsets.

Method: documents are sorted by id into ranges; each task writes one flat file of unsigned
integers and one of 64-bit offsets. A prefix sum over the files' totals gives each its base in
the whole sequence. Readers map the files into memory.

Files of a part: NAME.ids (little-endian, 2 bytes per id where the vocabulary allows, else 4),
NAME.idx (int64: documents + 1 offsets into the part, then the document ids)."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import land, scratch_path
from .common import input_columns, shared_file, text_slices, texts_of
from .encoding import encoder, tokenizer_path

END_ID = 2
NO_ID = -(1 << 63)  # stands for a null document id in the index
MANIFEST = "part bigint, path string, width int, documents bigint, tokens bigint"
ROWS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """One pair of files per task under a name of its own. The manifest row commits them: files
    of a lost attempt have no row and are never read."""
    own = encoder(path)
    dtype = own.dtype if end_id < 1 << (8 * own.dtype.itemsize) else np.dtype("<u4")
    end = np.array([end_id], dtype).tobytes()
    system, root = shared_file(folder)
    part = TaskContext.get().partitionId()
    name = f"{root}/{part:06d}-{uuid.uuid4().hex}"
    offsets, doc_ids, sink = [0], [], None
    for batch in text_slices(batches):
        if sink is None:
            system.create_dir(root, recursive=True)
            sink = system.open_output_stream(f"{name}.ids")
        for data in own.encode(texts_of(batch)):
            data = own.ids(data).astype(dtype).tobytes() + end
            sink.write(data)
            offsets.append(offsets[-1] + len(data) // dtype.itemsize)
        doc_ids.append(batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False).astype("<i8"))
    if sink is None:
        return
    sink.close()
    with system.open_output_stream(f"{name}.idx") as index:
        index.write(np.array(offsets, "<i8").tobytes())
        for ids in doc_ids:
            index.write(ids.tobytes())
    row = {"part": [part], "path": [name], "width": [dtype.itemsize], "documents": [len(offsets) - 1], "tokens": [offsets[-1]]}
    yield pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int64()), ("path", pa.string()), ("width", pa.int32()), ("documents", pa.int64()), ("tokens", pa.int64())]))


def write_token_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of every whole text, each with `end_id` after it, in ascending order of
    integer document ids, and return the manifest: part, path, width, documents, tokens, base.

    A null or empty text is its end id alone. Null ids come first; rows of one id are ordered by
    a hash of the text, repeated rows are alike. An empty table gives no files. Other columns
    are ignored."""
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    folder = folder or scratch_path(docs.sparkSession, "token-files")
    rows = input_columns(docs, doc_id=id_col, text=text_col).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    manifest = land(ordered.mapInArrow(lambda it: _write(it, folder, path, end_id), MANIFEST), "token-manifest")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return manifest.withColumn("base", F.coalesce(F.sum("tokens").over(earlier), F.lit(0))).withColumn("folder", F.lit(folder))


def _mapped(system, path: str, dtype) -> np.ndarray:
    """The file's numbers: mapped into memory where it is a plain file, else fetched."""
    if system.type_name == "local":
        return np.frombuffer(pa.memory_map(path).read_buffer(), dtype)
    with system.open_input_file(path) as file:
        return np.frombuffer(file.read_buffer(), dtype)


def _read(batches: Iterator[pa.RecordBatch], with_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in batch.to_pylist():
            system, _ = shared_file(part["folder"])
            index = _mapped(system, f"{part['path']}.idx", "<i8")
            ids = _mapped(system, f"{part['path']}.ids", f"<u{part['width']}")
            n = part["documents"]
            offsets, doc_ids = index[: n + 1], index[n + 1 :]
            for lo in range(0, n, 1024):
                hi = min(n, lo + 1024)
                own = [ids[a:b].astype("<u4") for a, b in zip(offsets[lo:hi], offsets[lo + 1 : hi + 1], strict=True)]
                found = pa.array(doc_ids[lo:hi], mask=doc_ids[lo:hi] == NO_ID)
                columns = [found, pa.array(offsets[lo:hi] + part["base"]), pa.array(np.diff(offsets[lo : hi + 1])), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array([x.tolist() for x in own], pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)


def read_token_files(spark: SparkSession, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32 and, if asked for,
    the ids. `ids_crc32` is taken over the ids as little-endian unsigned 32-bit integers."""
    files = manifest.repartition(max(1, spark.sparkContext.defaultParallelism), "part")
    return files.mapInArrow(lambda it: _read(it, with_ids), ROWS + (", ids array<bigint>" if with_ids else ""))
