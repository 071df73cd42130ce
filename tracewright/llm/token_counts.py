"""Token counts by a separator scan over flat, unindexed token files.

A token file is nothing but ids, one after the other, with an end-of-document
id after each document; nothing says where documents begin.  Files are read in
blocks of fixed size.  Each block is searched for separators with one vector
comparison, on its own; a prefix scan over the blocks' summaries (tokens and
separators of each block, then of each file, then of each group of files)
stitches documents that cross blocks or files and numbers them.

Defined cases: what follows a stream's last separator is one more, unfinished
document if it isn't empty; two separators in a row hold a document of no
tokens; an empty file or table gives no rows; a null text is a document of no
tokens; a very long document spans as many blocks as it needs; repeated
documents, nulls in doc_id and other columns don't matter, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textops
from ..storage import written
from .tokens import tokenizer_of, vocabulary

#: Tokens in a block.
BLOCK_TOKENS = 1 << 18
#: Tokens after which a task that writes a stream begins its next file.
FILE_TOKENS = 1 << 22
#: Files summed up together in the upper levels of the prefix scan.
GROUP_FILES = 1024

DTYPES = {2: "<u2", 4: "<u4"}


def read_token_files(spark: SparkSession, path: str, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks (file, block, ids) of flat files of little-endian ids of width bytes, of any size.

    Files are listed with their lengths, which gives the byte range of every block; each task then opens a file at the
    ranges that it was dealt, so that it holds one block, and one file is read by many tasks.  The folder is one that the
    executors can open by Arrow's file systems (local or mounted, HDFS, S3, GCS).
    """
    step = block_tokens * width
    files = spark.read.format("binaryFile").load(path).where("length > 0").select(F.col("path").alias("file"), "length")  # reads no content
    ranges = files.select("file", "length", F.explode(F.expr(f"sequence(0L, (length - 1) div {step})")).alias("block"))

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            for file, length, block in zip(*(batch.column(k).to_pylist() for k in range(3))):
                where, name = fs.FileSystem.from_uri(file)
                with where.open_input_file(name) as f:
                    ids = f.read_at(min(step, length - block * step), block * step)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int32()), pa.array([ids], pa.binary())], ["file", "block", "ids"])

    tasks = max(spark.sparkContext.defaultParallelism, 1)
    return ranges.repartition(4 * tasks, "file", "block").mapInArrow(run, "file string, block int, ids binary")


def scan_blocks(blocks: DataFrame, separator: int, width: int = 2) -> DataFrame:
    """Each block's tokens and the places of its separators: file, block, n_tokens, ends."""

    def run(batches):
        for batch in batches:
            n, ends = [], []
            for x in batch.column("ids"):
                ids = np.frombuffer(x.as_buffer(), DTYPES[width])
                n.append(len(ids))
                ends.append(np.flatnonzero(ids == separator).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(n, pa.int64()), pa.array(ends, pa.list_(pa.int32()))], ["file", "block", "n_tokens", "ends"])

    return blocks.select(F.col("file").cast("string").alias("file"), F.col("block").cast("int").alias("block"), "ids").mapInArrow(run, "file string, block int, n_tokens long, ends array<int>")


def stitch(scanned: DataFrame, across_files: bool = False) -> DataFrame:
    """Documents: file where it ends, ordinal (in its file, or in all), start (its first token, counted likewise), n_tokens, closed.

    scanned: what scan_blocks() returns; it is read more than once, so pass a table.
    """
    block = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last_end = F.when(F.size("ends") > 0, F.element_at("ends", -1).cast("long"))
    rows = scanned.select("file", "block", "n_tokens", "ends", last_end.alias("last_end"), F.size("ends").cast("long").alias("n_ends"))
    base = F.coalesce(F.sum("n_tokens").over(block), F.lit(0))
    rows = rows.withColumns({"base": base, "n_before": F.coalesce(F.sum("n_ends").over(block), F.lit(0))})
    rows = rows.withColumn("after", F.max(F.col("base") + F.col("last_end") + 1).over(block))
    per_file = scanned.groupBy("file").agg(F.sum("n_tokens").alias("file_tokens"), F.sum(F.size("ends")).cast("long").alias("file_ends"))
    per_file = per_file.join(rows.groupBy("file").agg(F.max(F.col("base") + F.col("last_end") + 1).alias("file_after")), "file")
    if across_files:
        per_file = _across(per_file)
    else:
        zero = F.lit(0).cast("long")
        per_file = per_file.withColumns({"tokens_before": zero, "ends_before": zero, "after_before": zero, "last": F.lit(True)})
    rows = rows.join(per_file, "file")
    carried = F.coalesce(F.col("tokens_before") + F.col("after"), F.col("after_before"))
    ends = rows.where("n_ends > 0").select("file", F.col("ends_before") + F.col("n_before"), F.col("tokens_before") + F.col("base"), carried, F.posexplode(F.arrays_zip("ends", F.expr("concat(array(int(null)), slice(ends, 1, size(ends) - 1))").alias("prior")))).toDF("file", "n", "base", "carried", "pos", "x")
    start = F.when(F.col("pos") == 0, F.col("carried")).otherwise(F.col("base") + F.col("x.prior") + 1)
    closed = ends.select("file", (F.col("n") + F.col("pos")).alias("ordinal"), start.alias("start"), (F.col("base") + F.col("x.ends") - start).alias("n_tokens"), F.lit(True).alias("closed"))
    begin = F.coalesce(F.col("tokens_before") + F.col("file_after"), F.col("after_before"))
    end = F.col("tokens_before") + F.col("file_tokens")
    rest = per_file.where(F.col("last") & (end > begin)).select("file", (F.col("ends_before") + F.col("file_ends")).alias("ordinal"), begin.alias("start"), (end - begin).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(rest)


def _across(per_file: DataFrame) -> DataFrame:
    """Totals of all files before each, in the order of names: within groups of files, then over the groups' few rows."""
    ids = per_file.select("file").orderBy("file").rdd.zipWithIndex().map(lambda x: (x[0][0], x[1])).toDF("file string, number long")
    rows = per_file.join(ids, "file").withColumn("group", F.floor(F.col("number") / GROUP_FILES))
    inner = Window.partitionBy("group").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    rows = rows.withColumns({"t": F.coalesce(F.sum("file_tokens").over(inner), zero), "e": F.coalesce(F.sum("file_ends").over(inner), zero)})
    rows = rows.withColumn("a", F.max(F.col("t") + F.col("file_after")).over(inner))
    outer = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = rows.groupBy("group").agg(F.sum("file_tokens").alias("gt"), F.sum("file_ends").alias("ge"), F.max(F.col("t") + F.col("file_after")).alias("ga"), F.max("number").alias("top"))
    groups = groups.withColumns({"bt": F.coalesce(F.sum("gt").over(outer), zero), "be": F.coalesce(F.sum("ge").over(outer), zero)})
    groups = groups.withColumn("ba", F.coalesce(F.max(F.col("bt") + F.col("ga")).over(outer), zero))
    groups = groups.withColumn("final", F.max("top").over(Window.orderBy("group").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rows = rows.join(groups.select("group", "bt", "be", "ba", "final"), "group")
    return rows.select("file", "file_tokens", "file_ends", "file_after", (F.col("bt") + F.col("t")).alias("tokens_before"), (F.col("be") + F.col("e")).alias("ends_before"), F.coalesce(F.col("bt") + F.col("a"), F.col("ba")).alias("after_before"), (F.col("number") == F.col("final")).alias("last"))


def write_stream(docs: DataFrame, path: str | None = None, block_tokens: int = BLOCK_TOKENS, file_tokens: int = FILE_TOKENS) -> tuple[DataFrame, DataFrame, int]:
    """Tokenises documents into flat files of 16-bit ids, kept as rows of blocks in the shared folder.

    Returns the blocks (file, block, ids), the documents in the files' order (file, ordinal, doc_id), which a flat file itself
    doesn't hold, and the separator.  Ids fit 16 bits: the vocabulary has 49,408.
    """
    path = path or vocabulary()
    separator = tokenizer_of(path, True).between

    def run(batches):
        import uuid

        tokenizer = tokenizer_of(path, True)
        names = ["file", "block", "ids", "doc_ids"]
        schema = pa.schema([("file", pa.string()), ("block", pa.int32()), ("ids", pa.binary()), ("doc_ids", pa.list_(pa.int64()))])
        stem = uuid.uuid4().hex
        file = block = size = 0
        held = np.zeros(0, "<u2")
        doc_ids: list = []

        def rows(final: bool):
            nonlocal held, file, block, size, doc_ids
            out = []
            while len(held) >= block_tokens or final and (len(held) or doc_ids):
                out.append((f"{stem}-{file:06d}", block, held[:block_tokens].tobytes(), doc_ids))
                size, block, doc_ids = size + min(len(held), block_tokens), block + 1, []
                held = held[block_tokens:]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], schema.field(k).type) for k in range(4)], names)

        for batch in batches:
            for texts in textops.chunks(batch.column("text")):
                ids, to = tokenizer.encode(texts)
                held = np.concatenate([held, np.insert(ids, to[1:], np.uint32(separator)).astype("<u2")])
                doc_ids += batch.column("doc_id").slice(texts.first, len(texts)).to_pylist()
                full = size + len(held) >= file_tokens
                yield from rows(full)
                if full:
                    file, block, size = file + 1, 0, 0
        yield from rows(True)

    table = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "file string, block int, ids binary, doc_ids array<long>"), "token-stream")
    lists = table.select("file", "block", "doc_ids", F.coalesce(F.sum(F.size("doc_ids")).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("n"))
    listed = lists.select("file", "n", F.posexplode("doc_ids").alias("pos", "doc_id")).select("file", (F.col("n") + F.col("pos")).alias("ordinal"), "doc_id")
    return table.select("file", "block", "ids"), listed, separator


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and n_tokens of every document, found by scanning the flat token stream that the documents give."""
    blocks, listed, separator = write_stream(docs, path)
    found = stitch(written(scan_blocks(blocks, separator), "separators"))
    return listed.join(found, ["file", "ordinal"]).select("doc_id", "n_tokens")
