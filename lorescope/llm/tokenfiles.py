"""Token counts from flat, unindexed token files by a separator scan.

A flat file is token ids of fixed width, one document after another, each ended by a separator; nothing says
where. The files are cut into blocks by size alone. Each block finds its separators in one vectorised search and
reports its whole documents, what comes before the first separator and what follows the last; a running maximum
of separator ends per file (a prefix scan over one row a block) joins the documents that blocks cut.

Files are read and written with ``pyarrow.fs``, so their folder may be any store it knows; every task writes a file
of its own under a temporary name and renames it, so a repeated task leaves the same file.

Cases: a NULL or empty text is a document of no tokens; tokens after a file's last separator are a document
without end, if there are any; an empty file has none; repeated rows are documents each; very long documents span
any number of blocks; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from lorescope.llm.common import frugal, narrowed, texts_of
from lorescope.llm.registry import documents, query
from lorescope.session import cut_lineage, scratch_path

RANKS = os.environ.get("LORESCOPE_BPE_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
END = 50256  # free in that vocabulary
DTYPE = "<u2"
BLOCK_TOKENS = 1 << 20
READ_BYTES = 32 << 20  # of files a task scans

# The pattern by which that vocabulary's words are cut; it has to be this one.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def read_ranks(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def write_tokens(docs: DataFrame, folder: str, ranks: dict[bytes, int], end: int = END, dtype: str = DTYPE) -> DataFrame:
    """Write the texts as flat token files to ``folder``; (file, nth, doc_id) says which document is the nth of a file.

    The ranks (a megabyte) travel with the tasks. The table is stored, so files are written once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        from pyspark import TaskContext

        context = TaskContext.get()
        coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={})
        store, path = _store(folder)
        store.create_dir(path, recursive=True)
        name = f"part-{context.partitionId():06d}.bin"
        working = f"{path}/.{name}.{context.taskAttemptId()}"
        nth = 0
        with store.open_output_stream(working) as out:
            for batch in batches:
                for row, stop, raw, at in texts_of(batch.column(1)):
                    data = raw.tobytes()
                    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                        out.write(coder.encode_to_numpy(data[a:b].decode(), disallowed_special=()).astype(dtype).tobytes() + np.array([end], dtype).tobytes())
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(nth, nth + n)), batch.column(0)], ["file", "nth", "doc_id"])
                nth += n
        store.move(working, f"{path}/{name}")

    return cut_lineage(narrowed(docs, ["doc_id", "text"]).mapInArrow(frugal(run), "file string, nth bigint, doc_id bigint"))


def token_files(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """Name and size of the files in a folder, one entry each; none if there is no such folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = store.listStatus(path) if store.exists(path) else []
    return sorted((f.getPath().getName(), f.getLen()) for f in found if f.getPath().getName()[0] not in "._")


def document_lengths(spark: SparkSession, folder: str, end: int = END, dtype: str = DTYPE, block: int = BLOCK_TOKENS) -> DataFrame:
    """(file, nth, n_tokens) of every document in the flat token files of ``folder``, separators not counted."""
    files = token_files(spark, folder)
    width = np.dtype(dtype).itemsize
    parts = max(1, sum(n for _, n in files) // READ_BYTES)
    listed = spark.createDataFrame(files, "file string, bytes bigint").filter(F.col("bytes") >= width)
    total = F.floor(F.col("bytes") / width)
    blocks = listed.select("file", total.alias("total"), F.explode(F.sequence(F.lit(0), total - 1, F.lit(block))).alias("start"))
    blocks = blocks.select("file", "start", F.least(F.lit(block), F.col("total") - F.col("start")).cast("int").alias("size"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        for batch in batches:
            for file, start, size in zip(*[c.to_pylist() for c in batch.columns]):
                with store.open_input_file(f"{path}/{file}") as source:
                    ids = np.frombuffer(source.read_at(size * width, start * width), dtype)
                ends = np.flatnonzero(ids == end)
                row = [file, start, size, len(ends), int(ends[0]) if len(ends) else size, start + int(ends[-1]) + 1 if len(ends) else None, (np.diff(ends) - 1).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names)

    names = ["file", "start", "size", "ends", "before", "last_end", "inner"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    schema = "file string, start bigint, size bigint, ends bigint, before bigint, last_end bigint, inner array<bigint>"
    found = blocks.repartition(parts, "file", "start").mapInArrow(frugal(scan), schema)
    earlier = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    last = F.row_number().over(W.partitionBy("file").orderBy(F.col("start").desc())) == 1
    # Where the document at a block's first token began, and how many documents ended before.
    placed = (
        found.withColumn("began", F.coalesce(F.max("last_end").over(earlier), F.lit(0)))
        .withColumn("first", F.coalesce(F.sum("ends").over(earlier), F.lit(0)))
        .withColumn("is_last", last)
    )
    carried = F.col("start") - F.col("began") + F.col("before")
    whole = placed.filter("ends > 0").select("file", "first", F.posexplode(F.concat(F.array(carried), "inner")).alias("i", "n_tokens"))
    whole = whole.select("file", (F.col("first") + F.col("i")).alias("nth"), "n_tokens")
    open_ended = placed.filter("is_last").select(
        "file", (F.col("first") + F.col("ends")).alias("nth"), (F.col("start") + F.col("size") - F.coalesce("last_end", "began")).alias("n_tokens")
    )
    return whole.unionByName(open_ended.filter("n_tokens > 0"))


@query("op7_token_counts")
def op7(spark, folder):
    place = scratch_path(spark, "tokens")
    order = write_tokens(documents(spark, folder), place, read_ranks())
    # The lengths come from a short list of files, which says nothing of their number: never a side to broadcast.
    return document_lengths(spark, place).hint("merge").join(order, ["file", "nth"]).select("doc_id", "n_tokens")
