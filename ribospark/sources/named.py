"""Text files under their own names, written in parallel and put together when all tasks are done.

Rows (file, value) become lines of ``<path>/<file>``. Every task writes the lines it has to parts
in a hidden folder beside the files; the commit joins the parts of a file in the order of the
tasks, chunk by chunk, and gives it its name, or removes them all if a task failed. So a file
either is whole or isn't there. Parts may be compressed as blocks, which stay valid when joined.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.taskcontext import TaskContext

from ribospark.sources.blockgzip import BLOCK_TEXT, END_BLOCK, packed

#: Bytes that the commit copies at a time, bytes of text that a task holds for one file (for all: 64 times that), and files that it has open.
CHUNK, HELD, OPEN = 16 << 20, 1 << 20, 64


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Parts(WriterCommitMessage):
    """The files that a task has parts of."""

    task: int
    files: dict[str, list[str]]


class NamedText(DataSource):
    """``df.write.format("named_text").save(folder)`` for rows (file, value)."""

    @classmethod
    def name(cls) -> str:
        return "named_text"

    def writer(self, schema, overwrite: bool) -> NamedWriter:
        return NamedWriter(self.options["path"], self.options.get("blocks", "") == "true")


class NamedWriter(DataSourceArrowWriter):
    def __init__(self, path: str, blocks: bool):
        self.path, self.blocks = path.rstrip("/"), blocks
        self.hidden = f"{self.path}/_parts-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Parts:
        context = TaskContext.get()
        store, hidden = _store(self.hidden)
        own = f"{hidden}/{context.partitionId():06d}-{context.taskAttemptId()}"
        store.create_dir(own, recursive=True)
        held: dict[str, bytearray] = {}
        parts: dict[str, list[str]] = {}
        streams: dict = {}

        def put(file: str, all_of_it: bool) -> None:
            """Writes what is held of a file; of blocks only whole ones before the end."""
            text = held[file]
            size = len(text) if all_of_it or not self.blocks else len(text) // BLOCK_TEXT * BLOCK_TEXT
            if file not in streams:
                if len(streams) == OPEN:
                    streams.pop(next(iter(streams))).close()  # what comes later for it is a part of its own
                parts.setdefault(file, []).append(f"{own}/{len(parts)}-{len(parts.get(file, ()))}")
                streams[file] = store.open_output_stream(parts[file][-1], compression=None)
            now = bytes(text[:size])
            streams[file].write(packed(now) if self.blocks else now)
            del text[:size]

        size = 0
        for b in batches:
            files, values = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("file", "value"))
            for file, value in zip(files, values):
                if not file or "/" in file or file.startswith(("_", ".")):
                    raise ValueError(f"{file!r} can't be a file's name")
                line = f"{value}\n".encode("utf-8", "surrogatepass")
                own_text = held.setdefault(file, bytearray())
                own_text += line
                size += len(line)
                if len(own_text) >= HELD:
                    size -= len(own_text)
                    put(file, False)
                    size += len(own_text)
                elif size >= 64 * HELD:
                    for f in held:
                        put(f, False)
                    size = sum(map(len, held.values()))
        for file, text in held.items():
            if text:
                put(file, True)
        for stream in streams.values():
            stream.close()
        return Parts(context.partitionId(), parts)

    def commit(self, messages: list[Parts | None]) -> None:
        store, folder = _store(self.path)
        _, hidden = _store(self.hidden)
        by_file: dict[str, list[str]] = {}
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.task):
            for file, parts in m.files.items():
                by_file.setdefault(file, []).extend(parts)
        store.create_dir(hidden, recursive=True)
        for file, parts in by_file.items():
            with store.open_output_stream(f"{hidden}/whole-{file}", compression=None) as out:
                for part in parts:
                    with store.open_input_stream(part, compression=None) as f:
                        while chunk := f.read(CHUNK):
                            out.write(chunk)
                if self.blocks:
                    out.write(END_BLOCK)
        for file in by_file:
            store.move(f"{hidden}/whole-{file}", f"{folder}/{file}")
        store.delete_dir(hidden)

    def abort(self, messages: list[Parts | None]) -> None:
        store, hidden = _store(self.hidden)
        from pyarrow import fs

        if store.get_file_info(hidden).type == fs.FileType.Directory:
            store.delete_dir(hidden)


def write_named(df: DataFrame, path: str, file: Column, value: Column, blocks: bool = False) -> None:
    """The lines ``value`` of each row in ``path/file``, in the order of the DataFrame's partitions and of their rows."""
    df.sparkSession.dataSource.register(NamedText)
    df.select(file.cast("string").alias("file"), F.coalesce(value, F.lit("")).alias("value")).write.format("named_text").mode("append").option("blocks", str(blocks).lower()).save(path)
