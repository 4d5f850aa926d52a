"""A file for each row, written by the tasks: all of them or none.

    spark.dataSource.register(FileRows)
    rows.select("path", "text").write.format("file_rows").mode("append").option("folder", folder).save()

Tasks write what they are given into a folder of their own beside the target.  Only when all have
ended, the driver writes down which file goes where (the manifest) and renames one after the other; an
aborted job leaves the target as it was.  A job that dies among its renames left its manifest: the next
one, or ``recover``, ends it first.  The folder must be one that the executors and the driver share;
its name is a path, or an address that pyarrow's file systems know.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

STAGED = "_staged-"
MANIFEST = "_manifest-"


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: pairs of a staged file and its place in the target."""

    files: list[tuple[str, str]]


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _place(path: str) -> str:
    """A path below the target; steps out of it are an error."""
    plain = posixpath.normpath(path)
    if plain.startswith(("/", "../")) or plain in ("..", ".") or plain.split("/")[0].startswith((STAGED, MANIFEST)):
        raise ValueError(f"{path!r} is not a path below the folder")
    return plain


def _move(store: fs.FileSystem, base: str, manifest: str) -> int:
    """Ends what a manifest says; what was renamed before is passed over."""
    with store.open_input_stream(f"{base}/{manifest}") as f:
        plan = json.loads(f.read())
    for staged, place in plan["files"]:
        if store.get_file_info(f"{base}/{staged}").type == fs.FileType.File:
            store.create_dir(posixpath.dirname(f"{base}/{place}"), recursive=True)
            store.move(f"{base}/{staged}", f"{base}/{place}")
    if store.get_file_info(f"{base}/{plan['staged']}").type == fs.FileType.Directory:
        store.delete_dir(f"{base}/{plan['staged']}")
    store.delete_file(f"{base}/{manifest}")
    return len(plan["files"])


def recover(folder: str) -> int:
    """Ends jobs that were committed but not all renamed; the number of files of theirs."""
    store, base = _open(folder)
    if store.get_file_info(base).type != fs.FileType.Directory:
        return 0
    names = sorted(x.base_name for x in store.get_file_info(fs.FileSelector(base)) if x.base_name.startswith(MANIFEST) and x.base_name.endswith(".json"))
    return sum(_move(store, base, x) for x in names)


class FileRowsWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder, self.job = folder, uuid.uuid4().hex

    @property
    def staged(self) -> str:
        return f"{STAGED}{self.job}"

    def write(self, rows: Iterator[Row]) -> Written:
        store, base = _open(self.folder)
        own = f"{self.staged}/{uuid.uuid4().hex}"  # of this try of the task: another try has its own
        store.create_dir(f"{base}/{own}", recursive=True)
        files = []
        for k, row in enumerate(rows):
            text = row["text"] if row["text"] is not None else ""
            with store.open_output_stream(f"{base}/{own}/{k}") as f:
                f.write(text.encode() if isinstance(text, str) else bytes(text))
            files.append((f"{own}/{k}", _place(row["path"])))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = _open(self.folder)
        recover(self.folder)
        files = [x for m in messages if m is not None for x in m.files]
        if not files:
            return
        double = len(files) - len({place for _, place in files})
        if double:
            self.abort(messages)
            raise ValueError(f"{double} rows have the path of another row")
        name = f"{MANIFEST}{self.job}"
        with store.open_output_stream(f"{base}/{name}.tmp") as f:
            f.write(json.dumps({"staged": self.staged, "files": files}).encode())
        store.move(f"{base}/{name}.tmp", f"{base}/{name}.json")  # from here on the job is done
        _move(store, base, f"{name}.json")

    def abort(self, messages: list[Written | None]) -> None:
        store, base = _open(self.folder)
        if store.get_file_info(f"{base}/{self.staged}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/{self.staged}")


class FileRows(DataSource):
    """Rows (path, text) as files below the option ``folder``."""

    @classmethod
    def name(cls) -> str:
        return "file_rows"

    def writer(self, schema: StructType, overwrite: bool) -> FileRowsWriter:
        if overwrite:
            raise ValueError("rows replace the files of their own paths; use the mode append")
        missing = {"path", "text"} - set(schema.names)
        if missing:
            raise ValueError(f"rows lack {', '.join(sorted(missing))}")
        return FileRowsWriter(self.options["folder"])


def write_files(rows, folder: str) -> None:
    """Writes rows (path, text) as files below a folder; files of other paths stay."""
    rows.sparkSession.dataSource.register(FileRows)
    rows.select("path", "text").write.format("file_rows").mode("append").option("folder", folder).save()
