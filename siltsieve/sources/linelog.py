"""A log of lines as a source and sink of Spark: a folder of files that only grow, with offsets.

Each file is a partition of the log, and an offset is a number of bytes in it, always behind a whole line. A
stream reads what was added since its last offsets, which Spark keeps in its checkpoint, so it goes on
where it stopped and may start at either end. The values are as those of a Kafka topic, so all that
reads a topic reads a log, too; writing adds a file for each task, which others see once the job is over.

    spark.dataSource.register(LineLog)
    spark.readStream.format("linelog").option("path", folder).option("startingOffsets", "latest").load()
    lines.write.format("linelog").mode("append").option("path", folder).save()

Files lie where pyarrow can open them from driver and executors alike: a shared folder or HDFS.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..errors import ConfigError

SUFFIX = ".log"
BLOCK = 1 << 20


def _place(path: str):  # noqa: ANN202
    from pyarrow import fs

    return (fs.LocalFileSystem(), path.removeprefix("file://").removeprefix("file:")) if path.startswith(("/", "file:")) else fs.FileSystem.from_uri(path)


def sizes(path: str) -> dict[str, int]:
    """The bytes of each file of a log."""
    from pyarrow import fs

    system, where = _place(path)
    found = system.get_file_info(fs.FileSelector(where, allow_not_found=True))
    return {f.base_name: f.size for f in found if f.is_file and f.base_name.endswith(SUFFIX)}


def whole_lines(path: str, name: str, start: int, end: int) -> int:
    """The last place from start to end that is behind a line's end; start if there is none. Read from the end on, a block at a time."""
    system, where = _place(path)
    with system.open_input_file(f"{where}/{name}") as f:
        while end > start:
            a = max(start, end - BLOCK)
            f.seek(a)
            at = f.read(end - a).rfind(b"\n")
            if at >= 0:
                return a + at + 1
            end = a
    return start


@dataclass
class Stretch(InputPartition):
    name: str
    start: int
    end: int


def read(path: str, part: Stretch) -> Iterator[tuple[str]]:
    """The lines of a stretch, a block in memory at a time."""
    system, where = _place(path)
    with system.open_input_file(f"{where}/{part.name}") as f:
        f.seek(part.start)
        left, rest = part.end - part.start, b""
        while left:
            block = f.read(min(BLOCK, left))
            left -= len(block)
            *lines, rest = (rest + block).split(b"\n")
            for line in lines:
                yield (line.decode(errors="replace"),)
        if rest:
            yield (rest.decode(errors="replace"),)


class LineLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "linelog"

    def schema(self) -> str:
        return "value string"

    def _path(self) -> str:
        if not self.options.get("path"):
            raise ConfigError("a log needs a path")
        return self.options["path"]

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return LogReader(self._path())

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
        start = self.options.get("startingOffsets", "earliest")
        if start not in ("earliest", "latest"):
            raise ConfigError(f"a stream starts at the earliest or latest offsets, not at {start}")
        return LogStreamReader(self._path(), start)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:  # noqa: ANN001
        if overwrite:
            raise ConfigError("a log only grows")
        return LogWriter(self._path())


class LogReader(DataSourceReader):
    """All whole lines there are."""

    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Stretch]:
        return [Stretch(n, 0, size) for n, size in sorted(sizes(self.path).items())] or [Stretch("", 0, 0)]

    def read(self, partition: Stretch) -> Iterator[tuple[str]]:
        return read(self.path, partition) if partition.name else iter(())


class LogStreamReader(DataSourceStreamReader):
    def __init__(self, path: str, start: str) -> None:
        self.path, self.start = path, start

    def _ends(self) -> dict[str, int]:
        return {n: whole_lines(self.path, n, 0, size) for n, size in sizes(self.path).items()}

    def initialOffset(self) -> dict[str, int]:  # noqa: N802
        return self._ends() if self.start == "latest" else {}

    def latestOffset(self) -> dict[str, int]:  # noqa: N802
        return self._ends()

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[Stretch]:
        return [Stretch(n, start.get(n, 0), at) for n, at in sorted(end.items()) if at > start.get(n, 0)]

    def read(self, partition: Stretch) -> Iterator[tuple[str]]:
        return read(self.path, partition)

    def commit(self, end: dict[str, int]) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class LogWriter(DataSourceWriter):
    """A task writes a file that is no part of the log yet; the driver renames those of the tasks that count."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator) -> Written:  # noqa: ANN001
        system, where = _place(self.path)
        name = f"{uuid.uuid4().hex}{SUFFIX}"
        system.create_dir(where, recursive=True)
        n = 0
        with system.open_output_stream(f"{where}/{name}.new") as f:
            for row in iterator:
                f.write((row[0] or "").encode() + b"\n")
                n += 1
        if not n:
            system.delete_file(f"{where}/{name}.new")
        return Written([name] if n else [])

    def commit(self, messages) -> None:  # noqa: ANN001
        system, where = _place(self.path)
        for m in messages:
            for name in m.names if m else []:
                system.move(f"{where}/{name}.new", f"{where}/{name}")

    def abort(self, messages) -> None:  # noqa: ANN001
        system, where = _place(self.path)
        for m in messages:
            for name in m.names if m else []:
                system.delete_file(f"{where}/{name}.new")
