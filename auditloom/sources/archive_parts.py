"""ZIP archives read in parts: one archive is as many tasks as its size asks for.

Archives are planned from their central directories, which stand at their ends and are
short; limits and containment are checked there, before anything is unpacked. They are
opened through pyarrow's file systems, as local paths or URIs.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.paths import archive_member, is_noise_member
from .project_dir import MAX_MEMBER, MAX_MEMBERS, MAX_RATIO, MAX_TOTAL, SENT

#: Unpacked bytes of a part, about.
PART_BYTES = 32 << 20
SCHEMA = "archive string, member string, size long, packed_size long, within_limits boolean, raw binary"
_KINDS = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())


@dataclass
class _Part(InputPartition):
    archive: str
    low: int
    high: int
    fits: bool


class _Seekable(io.RawIOBase):
    """A file of pyarrow as those of Python are: a place before its begin is an OSError."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size = file, file.size()

    def seekable(self) -> bool:
        return True

    def readable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        at = offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.tell(), io.SEEK_END: self.size}[whence]
        if at < 0:
            raise OSError("before the begin of the file")
        return self.file.seek(min(at, self.size))

    def read(self, size: int = -1) -> bytes:
        return self.file.read(None if size is None or size < 0 else size)

    def close(self) -> None:
        self.file.close()
        super().close()


def _opened(path: str) -> zipfile.ZipFile:
    where, name = fs.FileSystem.from_uri(path)
    return zipfile.ZipFile(_Seekable(where.open_input_file(name)))


def _members(archive: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    return [i for i in archive.infolist() if not i.is_dir()]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.part = options["path"], int(options.get("part_bytes", str(PART_BYTES)))

    def partitions(self) -> list[_Part]:
        where, name = fs.FileSystem.from_uri(self.path)
        scheme = self.path.split("://", 1)[0] + "://" if "://" in self.path else ""
        found = where.get_file_info(name)
        listed = [found] if found.is_file else where.get_file_info(fs.FileSelector(name))
        out: list[_Part] = []
        for file in sorted((f for f in listed if f.is_file), key=lambda f: f.path):
            path = scheme + file.path
            with _opened(path) as z:
                infos = _members(z)
            total, packed = sum(i.file_size for i in infos), max(1, sum(i.compress_size for i in infos))
            fits = len(infos) <= MAX_MEMBERS and total <= MAX_TOTAL and total <= MAX_RATIO * packed and all(i.file_size <= MAX_MEMBER for i in infos)
            low = held = 0
            for k, i in enumerate(infos):
                held += i.file_size if fits else 0
                if held >= self.part:
                    out.append(_Part(path, low, k + 1, fits))
                    low, held = k + 1, 0
            if low < len(infos):
                out.append(_Part(path, low, len(infos), fits))
        return out or [_Part("", 0, 0, False)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        with _opened(partition.archive) as z:
            held, size = [], 0
            for i in _members(z)[partition.low : partition.high]:
                held.append((partition.archive, i.filename, i.file_size, i.compress_size, partition.fits, z.read(i) if partition.fits else None))
                size += i.file_size if partition.fits else 0
                if size >= SENT or len(held) >= 1000:
                    yield self._batch(held)
                    held, size = [], 0
            if held:
                yield self._batch(held)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=names)


class ZipMembers(DataSource):
    """``format("zip_members")`` with path (an archive, or a folder of archives) and part_bytes."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def archive_parts(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """As ``project_dir.archive_members``, with tasks by parts of archives: archive, member, size, packed_size, within_limits, raw, path (null where a member would leave the project)."""
    spark.dataSource.register(ZipMembers)
    out = spark.read.format("zip_members").option("path", path).option("part_bytes", str(part_bytes)).load()
    return out.filter(~is_noise_member("member")).withColumn("path", archive_member("member"))
