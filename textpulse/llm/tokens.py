"""Token ids of documents: written to seekable files in the order of ids, and read back.

Null texts count as empty: their only id is the end id. Null ids of documents come first. Rows repeated with the
same id are all written, in the order of a hash of their texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textpulse.llm.common import MARK, stage, table, whole
from textpulse.llm.frames import Writer, read_documents
from textpulse.llm.store import new_folder, new_name, opened
from textpulse.llm.words import encoder

#: Texts encoded at once in a task.
CHUNK = 256


def word_tokenizer() -> str:
    """The public word tokenizer's file, as the contract's queries use it."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def crc32(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def encoded(batches: Iterator[pa.RecordBatch], tokenizer: str, end: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """(id, token ids with the end id) of each row of (doc_id, text)."""
    coder = encoder(tokenizer)
    tail = np.array([end], np.uint32)
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            texts = part.column(1).to_pylist()
            for doc, ids in zip(part.column(0).to_pylist(), coder.encode(texts)):
                yield doc, np.concatenate([ids, tail])


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, end: int, id: str = "doc_id", text: str = "text", partitions: int | None = None
) -> DataFrame:
    """Write the ids of every document to files in folder, one per task; returns the table of files, staged:
    (partition, file, documents, tokens, bytes). The files in the order of partition hold the documents in the
    order of their ids. A file counts only once the table of files names it, so lost or repeated tasks leave
    nothing that is read."""
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = f"{MARK}tie"
    rows = docs.select(F.col(id).alias("doc_id"), whole(text).alias("text")).withColumn(tie, F.xxhash64("text"))
    dealt = rows.repartitionByRange(n, "doc_id", tie).sortWithinPartitions("doc_id", tie).select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        system, path = opened(folder)
        name = new_name("tokens", partition, ".zst")
        width = 2 if encoder(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 and end < 1 << 16 else 4
        with system.open_output_stream(f"{path}/{name}", compression=None) as out:
            writer = Writer(out, width)
            for doc, ids in encoded(batches, tokenizer, end):
                writer.add(doc, ids)
            writer.close()
        if writer.docs:
            values = [[partition], [name], [len(writer.docs)], [writer.tokens], [writer.bytes]]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=["partition", "file", "documents", "tokens", "bytes"])

    return stage(dealt.mapInArrow(write, "partition long, file string, documents long, tokens long, bytes long"), "token-files")


def read_tokens(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """Per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The driver holds one row per file.
    """
    listed = files.orderBy("partition").collect()
    before, rows = 0, []
    for f in listed:
        rows.append((f["file"], before))
        before += f["tokens"]
    named = spark.createDataFrame(rows, "file string, before long").repartition(max(1, len(rows)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs, starts, sizes, sums = [], [], [], []
                with system.open_input_file(f"{path}/{name}") as file:
                    for doc, ids in read_documents(file):
                        docs.append(doc)
                        starts.append(start)
                        sizes.append(len(ids))
                        sums.append(crc32(ids))
                        start += len(ids)
                columns = [pa.array(c, pa.int64()) for c in (docs, starts, sizes, sums)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return named.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_files(spark: SparkSession, folder: str) -> DataFrame:
    target = new_folder(spark, "tokens")
    return read_tokens(spark, target, write_tokens(table(spark, folder, "documents"), target, word_tokenizer(), end=2))
