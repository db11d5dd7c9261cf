"""A Spark data source for folders of zip archives: members as rows, both ways.

Reading cuts every archive into byte ranges.  A partition is a range of one
archive; its task reads the archive's directory (at the end of the file) piece
by piece and takes the members whose data begin in its range, each by a read of
its own bytes.  No task holds an archive or its directory, and the driver only
lists the files.

Writing goes through Spark's commit protocol.  A task streams its rows, sorted
by archive, into zip files in a staging folder and reports them; only when all
tasks have succeeded does the commit move the files to their places.  A failed
job removes its staging folder, and what a failed or repeated task wrote is never
seen, since readers skip staging folders.

Files are opened with Arrow's file systems (local and the remote ones it has).
"""

from __future__ import annotations

import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Bytes of an archive that one task takes, and of its directory that are read at once.
RANGE_BYTES, OPEN_BYTES, CHUNK = 64 << 20, 4 << 20, 1 << 20
STAGING = "_staging-"
READ_SCHEMA = "path string, member string, data binary"
WRITE_SCHEMA = "archive string, member string, data binary"

# Record marks of the zip format and the sizes of their fixed parts.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
END_SIZE, LOCATOR_SIZE, ENTRY_SIZE, LOCAL_SIZE, COMMENT = 22, 20, 46, 30, 1 << 16
IN_64 = 0xFFFFFFFF


def file_system(path: str):
    """(Arrow file system, path in it); a path without a scheme, or with ``file:``, is local or on a mounted share."""
    from pyarrow import fs
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def directory(f, size: int) -> tuple[int, int]:
    """(offset, bytes) of the central directory of an open archive."""
    back = min(size, END_SIZE + COMMENT)
    f.seek(size - back)
    tail = f.read(back)
    at = tail.rfind(END)
    if at < 0:
        raise ValueError("not a zip archive")
    length, offset = struct.unpack("<II", tail[at + 12:at + 20])
    if IN_64 in (length, offset) and tail[at - LOCATOR_SIZE:at - LOCATOR_SIZE + 4] == LOCATOR64:
        f.seek(struct.unpack("<Q", tail[at - LOCATOR_SIZE + 8:at - LOCATOR_SIZE + 16])[0])
        length, offset = struct.unpack("<QQ", f.read(56)[40:56])
    return offset, length


def members(f, size: int) -> Iterator[tuple[str, int, int, int, int]]:
    """(name, offset of the local header, compressed bytes, method, flags) of every member, the directory read in pieces."""
    at, left = directory(f, size)
    buf = b""
    while left or buf:
        need = ENTRY_SIZE
        if len(buf) >= ENTRY_SIZE:
            if buf[:4] != ENTRY:
                raise ValueError("the directory of the archive is damaged")
            n, extra, comment = struct.unpack("<HHH", buf[28:34])
            need = ENTRY_SIZE + n + extra + comment
        if len(buf) < need:
            if not left:
                raise ValueError("the directory of the archive ends early")
            f.seek(at)
            piece = f.read(min(left, max(CHUNK, need)))
            buf, at, left = buf + piece, at + len(piece), left - len(piece)
            continue
        flags, method = struct.unpack("<HH", buf[8:12])
        packed, unpacked = struct.unpack("<II", buf[20:28])
        start = struct.unpack("<I", buf[42:46])[0]
        name = buf[ENTRY_SIZE:ENTRY_SIZE + n].decode("utf-8" if flags & 0x800 else "cp437")
        more, k = buf[ENTRY_SIZE + n:ENTRY_SIZE + n + extra], 0
        while k + 4 <= len(more):                          # sizes beyond 32 bits are in an extra field, in this order
            kind, length = struct.unpack("<HH", more[k:k + 4])
            if kind == 1:
                wide = iter(struct.unpack(f"<{length // 8}Q", more[k + 4:k + 4 + length // 8 * 8]))
                unpacked = next(wide) if unpacked == IN_64 else unpacked
                packed = next(wide) if packed == IN_64 else packed
                start = next(wide) if start == IN_64 else start
            k += 4 + length
        yield name, start, packed, method, flags
        buf = buf[need:]


def content(f, start: int, packed: int, method: int) -> bytes:
    """The unpacked bytes of a member."""
    f.seek(start)
    head = f.read(LOCAL_SIZE)
    if head[:4] != LOCAL:
        raise ValueError("a member's header is damaged")
    n, extra = struct.unpack("<HH", head[26:30])
    f.seek(start + LOCAL_SIZE + n + extra)
    raw = f.read(packed)
    if method == zipfile.ZIP_DEFLATED:
        return zlib.decompress(raw, -zlib.MAX_WBITS)
    if method != zipfile.ZIP_STORED:
        raise ValueError(f"compression method {method} is not supported")
    return raw


@dataclass
class Ranges(InputPartition):
    """Ranges of archives for one task: (path, size, first byte, byte past the last)."""

    ranges: list[tuple[str, int, int, int]]

    def __post_init__(self) -> None:
        super().__init__(len(self.ranges))


class ZipReader(DataSourceReader):
    def __init__(self, root: str, range_bytes: int) -> None:
        self.root, self.range_bytes = root, range_bytes

    def partitions(self) -> list[Ranges]:
        """Large archives are cut into ranges, small ones share a task; opening a file counts as ``OPEN_BYTES``."""
        from pyarrow import fs
        system, top = file_system(self.root)
        top, shown = top.rstrip("/"), self.root.rstrip("/")
        out, held = [Ranges([])], 0
        for x in sorted(system.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True)), key=lambda x: x.path):
            if x.type != fs.FileType.File or not x.path.endswith(".zip") or STAGING in x.path:
                continue
            for a in range(0, max(1, x.size), self.range_bytes):
                past = min(x.size, a + self.range_bytes)
                if out[-1].ranges and held + past - a > self.range_bytes:
                    out.append(Ranges([]))
                    held = 0
                out[-1].ranges.append((shown + x.path[len(top):], x.size, a, past))
                held += past - a + min(OPEN_BYTES, self.range_bytes // 16)
        return out

    def read(self, partition: Ranges) -> Iterator[tuple]:
        for whole, size, first, past in partition.ranges:
            system, path = file_system(whole)
            with system.open_input_file(path) as f:
                for name, start, packed, method, _ in members(f, size):
                    if first <= start < past and not name.endswith("/"):
                        yield whole, name, content(f, start, packed, method)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class ZipWriter(DataSourceWriter):
    """Rows (archive, member, data), all rows of an archive in one task and next to one another."""

    def __init__(self, root: str) -> None:
        self.root = root.rstrip("/")
        self.staging = f"{self.root}/{STAGING}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext
        context = TaskContext.get()
        own = f"{self.staging}/{context.partitionId()}-{context.taskAttemptId()}"
        system, folder = file_system(own)
        system.create_dir(folder, recursive=True)
        files, name, out, archive = [], None, None, None
        try:
            for row in iterator:
                if row["archive"] != name:
                    if archive is not None:
                        archive.close()
                        out.close()
                    name = row["archive"]
                    path = f"{folder}/{len(files)}.zip"
                    out = system.open_output_stream(path)
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                    files.append((f"{own}/{len(files)}.zip", f"{self.root}/{name}"))
                archive.writestr(row["member"], bytes(row["data"]))
        finally:
            if archive is not None:
                archive.close()
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            for staged, place in m.files if m else []:
                system, a = file_system(staged)
                b = file_system(place)[1]
                system.create_dir(b.rsplit("/", 1)[0], recursive=True)
                system.move(a, b)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs
        system, folder = file_system(self.staging)
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            system.delete_dir(folder)


class ZipArchives(DataSource):
    """``spark.read.format("ziparchives").load(root)`` and ``df.write.format("ziparchives").mode("append").save(root)``."""

    @classmethod
    def name(cls) -> str:
        return "ziparchives"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> ZipReader:
        return ZipReader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))

    def writer(self, schema, overwrite: bool) -> ZipWriter:
        return ZipWriter(self.options["path"])


def register(spark) -> None:
    spark.dataSource.register(ZipArchives)
