"""Text files under given names, written by all tasks and published all or none (K1, K2)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    files: int


class NamedTextWriter(DataSourceWriter):
    """Tasks write into a folder beside the target, each file first under a name of its own; the commit on the driver renames
    that folder, and what stood there before goes after. An aborted job leaves the target as it was."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"

    def _open(self, path: str):
        from pyarrow.fs import FileSystem

        return FileSystem.from_uri(path)

    def _there(self) -> bool:
        from pyarrow.fs import FileType

        fs, base = self._open(self.path)
        return fs.get_file_info(base).type != FileType.NotFound

    def write(self, iterator: Iterator) -> Written:
        fs, base = self._open(self.staging)
        seen: set[str] = set()
        folders: set[str] = set()
        for row in iterator:
            parts = (row.file or "").split("/")
            if not all(parts) or {".", ".."} & set(parts):
                raise ValueError(f"not a file name below the target: {row.file!r}")
            if row.file in seen:
                raise ValueError(f"two rows have the file name {row.file!r}")
            seen.add(row.file)
            folder = "/".join([base, *parts[:-1]])
            if folder not in folders:
                fs.create_dir(folder, recursive=True)
                folders.add(folder)
            own = f"{folder}/.{uuid.uuid4().hex}"  # a second attempt at a task never sees half a file
            with fs.open_output_stream(own) as out:
                out.write((row.body or "").encode())
            fs.move(own, f"{folder}/{parts[-1]}")
        return Written(len(seen))

    def commit(self, messages: list) -> None:
        fs, base = self._open(self.path)
        _, staging = self._open(self.staging)
        fs.create_dir(staging, recursive=True)  # no rows, no files
        old = None
        if self._there():
            if not self.overwrite:
                fs.delete_dir(staging)
                raise FileExistsError(self.path)
            old = f"{base}.old-{uuid.uuid4().hex}"
            fs.move(base, old)
        fs.move(staging, base)
        if old:
            fs.delete_dir(old)

    def abort(self, messages: list) -> None:
        from pyarrow.fs import FileType

        fs, staging = self._open(self.staging)
        if fs.get_file_info(staging).type != FileType.NotFound:
            fs.delete_dir(staging)


class NamedText(DataSource):
    """Spark data source ``named_text``: rows ``file, body`` to text files below ``path``, a URI that every executor can open."""

    @classmethod
    def name(cls) -> str:
        return "named_text"

    def schema(self) -> str:
        return "file string, body string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return NamedTextWriter(self.options["path"], overwrite)


def write_named(files: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``files(file, body)``, each to its own file below ``path``; two rows of one name are an error, and so is an existing
    folder unless ``mode`` is overwrite. A null body is an empty file."""
    files.sparkSession.dataSource.register(NamedText)
    files.select("file", "body").repartition("file").write.format("named_text").mode(mode).save(path)


def folder(stream: Column) -> Column:
    return F.url_encode(stream.cast("string"))


def write_vtt_segments(bodies: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K1: ``bodies(stream_id, lang, seq, body)`` as ``<stream>/<lang>_<seq>.vtt``, the names that the playlists give."""
    name = F.concat(folder(F.col("stream_id")), F.lit("/"), F.col("lang"), F.lit("_"), F.col("seq").cast("string"), F.lit(".vtt"))
    write_named(bodies.select(name.alias("file"), "body"), path, mode)


def write_playlists(bodies: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K2: ``bodies(stream_id, lang, body)`` as ``<stream>/<lang>.m3u8``."""
    write_named(bodies.select(playlist_name(F.col("stream_id"), F.col("lang")).alias("file"), "body"), path, mode)


def read_named(files: DataFrame, path: str) -> DataFrame:
    """``files`` with ``value``: the text of the file ``file`` below ``path``, null if there is none. Tasks open files by their names,
    so that no folder is listed on the driver and no task is planned for a few files each."""
    kinds = files.schema.simpleString()[len("struct<") : -1]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow.fs import FileSystem

        fs, base = FileSystem.from_uri(path)

        def text(name: str | None) -> str | None:
            if name is None:
                return None
            try:
                with fs.open_input_stream(f"{base}/{name}") as f:
                    return f.read().decode(errors="replace")
            except FileNotFoundError:
                return None

        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                yield part.append_column("value", pa.array([text(n) for n in part.column("file").to_pylist()], pa.string()))

    return files.mapInArrow(run, f"{kinds},value:string")


def playlist_name(stream: Column, lang: Column) -> Column:
    return F.concat(folder(stream), F.lit("/"), lang, F.lit(".m3u8"))
