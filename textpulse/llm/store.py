"""Files that tasks write and read in the shared folder, by any scheme that Arrow's file systems know."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession

from textpulse.session import scratch_path


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared folder that the session names. Relative and plain paths become URIs."""
    path = scratch_path(spark, name)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(hadoop)
    return system.makeQualified(hadoop).toString()


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """Hadoop writes file:/x for what Arrow reads as file:///x."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def new_name(stem: str, partition: int, end: str) -> str:
    """A name that no other attempt of the task uses: the table of files names the attempt that counts."""
    return f"{stem}-{partition:05d}-{uuid.uuid4().hex}{end}"


# What was built of the last folder that is one block, per process.
_HELD: dict[str, Any] = {}


def stored_blocks(folder: str, columns: list[str], weight: Callable[[pa.Table], int], most: int, build: Callable[[pa.Table], Any]) -> Iterator[Any]:
    """What build makes of the rows of a stored table, a block at a time: files are put together until their weight
    reaches most. A table of one block is built once per process; of others only one block is held at a time."""
    if folder in _HELD:
        yield _HELD[folder]
        return
    system, path = opened(folder)
    files = sorted(f.path for f in system.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet"))
    parts, held, made = [], 0, 0
    for k, file in enumerate(files):
        with system.open_input_file(file) as handle:
            parts.append(pq.read_table(handle, columns=columns))
        held += weight(parts[-1])
        last = k == len(files) - 1
        if last or held >= most:
            block = build(pa.concat_tables(parts))
            made += 1
            if last and made == 1:
                _HELD.clear()
                _HELD[folder] = block
            yield block
            parts, held = [], 0
