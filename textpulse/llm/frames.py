"""Token files: independent zstandard frames, an index of documents, and a seek table at the end.

A frame holds the ids of whole documents in a row, little-endian, 2 or 4 bytes each, and ends with zstandard's
content checksum. A skippable frame holds the index. The last frame is the seek table of zstandard's seekable
format: for each frame its compressed and plain size and the low half of the XXH64 of its content. So a file is
a valid zstandard stream, and a reader decompresses the frames of the documents it wants and no others.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import xxhash
import zstandard
from pyarrow import NativeFile

# Fixed values of zstandard's formats: skippable frames, seek table, its footer.
INDEX_MAGIC = 0x184D2A5D
SEEK_MAGIC = 0x184D2A5E
FOOT_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80

_INDEX_HEAD = struct.Struct("<IIIBQ")  # magic, size, version, bytes per id, documents
_SEEK_ENTRY = struct.Struct("<III")
_FOOT = struct.Struct("<IBI")
VERSION = 1


@dataclass(frozen=True)
class Index:
    """Per document in order: id (null where absent), frame, place in the frame, number of ids."""

    width: int
    doc: np.ndarray
    absent: np.ndarray
    frame: np.ndarray
    place: np.ndarray
    size: np.ndarray
    starts: np.ndarray  # of frames in the file
    sums: np.ndarray
    plain: np.ndarray


class Writer:
    """Writes documents in the order they come. Frames close at frame_bytes; a document is never split."""

    def __init__(self, out: NativeFile, width: int, frame_bytes: int = 1 << 16, level: int = 3):
        self.out, self.width, self.frame_bytes = out, width, frame_bytes
        self.squeeze = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.open: list[bytes] = []
        self.open_bytes, self.bytes, self.tokens = 0, 0, 0
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, bool, int, int, int]] = []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc or 0, doc is None, len(self.frames), self.open_bytes // self.width, len(ids)))
        body = ids.astype(f"<u{self.width}").tobytes()
        self.open.append(body)
        self.open_bytes += len(body)
        self.tokens += len(ids)
        if self.open_bytes >= self.frame_bytes:
            self._close_frame()

    def _put(self, body: bytes) -> None:
        self.out.write(body)
        self.bytes += len(body)

    def _close_frame(self) -> None:
        plain = b"".join(self.open)
        packed = self.squeeze.compress(plain)
        self._put(packed)
        self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.open, self.open_bytes = [], 0

    def close(self) -> None:
        if self.open:
            self._close_frame()
        kinds = ("<i8", "u1", "<u4", "<u4", "<u4")
        columns = zip(*self.docs) if self.docs else [()] * 5
        body = b"".join(np.array(c).astype(k).tobytes() for c, k in zip(columns, kinds))
        head = _INDEX_HEAD.pack(INDEX_MAGIC, _INDEX_HEAD.size - 8 + len(body), VERSION, self.width, len(self.docs))
        self._put(head + body)
        entries = [*self.frames, (len(head) + len(body), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)]
        table = b"".join(_SEEK_ENTRY.pack(*e) for e in entries) + _FOOT.pack(len(entries), CHECKSUMS, FOOT_MAGIC)
        self._put(struct.pack("<II", SEEK_MAGIC, len(table)) + table)


def read_index(file: NativeFile) -> Index:
    """The seek table from the end of the file, and the index that it leads to."""
    end = file.size()
    file.seek(end - _FOOT.size)
    frames, flags, magic = _FOOT.unpack(file.read(_FOOT.size))
    if magic != FOOT_MAGIC or flags != CHECKSUMS:
        raise ValueError("no seek table at the end of the file")
    size = frames * _SEEK_ENTRY.size + _FOOT.size
    file.seek(end - size)
    table = np.frombuffer(file.read(size - _FOOT.size), "<u4").reshape(frames, 3).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(table[:, 0])])
    file.seek(int(starts[frames - 1]))
    magic, _, version, width, n = _INDEX_HEAD.unpack(file.read(_INDEX_HEAD.size))
    if magic != INDEX_MAGIC or version != VERSION:
        raise ValueError("no index of documents")
    columns = [np.frombuffer(file.read(n * np.dtype(k).itemsize), k) for k in ("<i8", "u1", "<u4", "<u4", "<u4")]
    return Index(width, columns[0], columns[1].astype(bool), *columns[2:], starts, table[:, 2], table[:, 1])


def _frame(file: NativeFile, index: Index, k: int) -> np.ndarray:
    file.seek(int(index.starts[k]))
    packed = file.read(int(index.starts[k + 1] - index.starts[k]))
    plain = zstandard.ZstdDecompressor().decompress(packed, max_output_size=int(index.plain[k]))
    if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != index.sums[k]:
        raise ValueError(f"checksum of frame {k} differs")
    return np.frombuffer(plain, f"<u{index.width}")


def read_documents(file: NativeFile, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
    """(id, token ids) of the wanted documents, or of all, in file order. Each frame is read once at most."""
    index = read_index(file)
    rows = range(len(index.doc))
    if wanted is not None:
        asked = set(wanted)
        rows = [k for k in rows if not index.absent[k] and int(index.doc[k]) in asked]
    at, ids = -1, np.zeros(0)
    for k in rows:
        if index.frame[k] != at:
            at = int(index.frame[k])
            ids = _frame(file, index, at)
        first = int(index.place[k])
        yield None if index.absent[k] else int(index.doc[k]), ids[first : first + int(index.size[k])].astype("<u4")
