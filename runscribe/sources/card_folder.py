"""A folder of scorecard documents as a data source: read whole, written file by file, or followed as a stream.

A file stream of Spark's sees new files only; a score store rewrites and removes its documents.  This source lists the
folder at each trigger, keeps the list of a pass if it differs from the one before, and gives what differs between two
lists: files that are new or whose time or size changed, with their text, and files that are gone.  An offset is a
pass; lists are kept in a folder of their own until their changes are committed, so a restart reads the same changes.

The driver lists names, as Spark's own file sources do; texts are read by tasks, a share of the files each.  Paths are
what a pyarrow file system opens, for which executors and driver need the same view.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

NAME = "card_folder"
SCHEMA = "pass_no long, file string, kind string, modified long, value string"
#: Bytes and files of a partition; a larger file is a partition of its own.
SHARE_BYTES, SHARE_FILES = 32 << 20, 2000


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    system, at = fs.FileSystem.from_uri(path)
    return system, at.rstrip("/")


def listing(path: str) -> dict[str, list[int]]:
    """name -> [time of change in ns, bytes] of the JSON files of a folder; none if there is no folder."""
    system, at = _opened(path)
    found = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return {f.base_name: [f.mtime_ns or 0, f.size] for f in found if f.is_file and f.base_name.endswith(".json") and not f.base_name.startswith((".", "_"))}


@dataclass
class Share(InputPartition):
    """Files to read and names that are gone, of one pass."""

    number: int
    files: list[tuple[str, int]]
    gone: list[str]


def shares(number: int, before: dict[str, list[int]], now: dict[str, list[int]]) -> list[Share]:
    """What changed from one list to the next, cut into partitions of bounded size."""
    out, held = [], 0
    for name in sorted(n for n, at in now.items() if before.get(n) != at):
        if not out or held + now[name][1] > SHARE_BYTES or len(out[-1].files) >= SHARE_FILES:
            out.append(Share(number, [], []))
            held = 0
        out[-1].files.append((name, now[name][0] // 1_000_000))
        held += now[name][1]
    gone = sorted(set(before) - set(now))
    return out + [Share(number, [], gone[i : i + SHARE_FILES]) for i in range(0, len(gone), SHARE_FILES)]


def _read(path: str, share: Share) -> Iterator[tuple]:
    system, at = _opened(path)
    for name, modified in share.files:
        try:
            with system.open_input_stream(f"{at}/{name}") as f:
                text = f.read().decode("utf-8", "replace")
        except FileNotFoundError:
            continue  # gone since it was listed; the next list says so
        yield share.number, name, "written", modified, text
    for name in share.gone:
        yield share.number, name, "removed", None, None


class _Whole(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Share]:
        return shares(0, {}, listing(self.path)) or [Share(0, [], [])]

    def read(self, partition: Share) -> Iterator[tuple]:
        return _read(self.path, partition)


class _Followed(DataSourceStreamReader):
    def __init__(self, path: str, passes: str):
        self.path, self.passes = path, passes

    def _kept(self) -> list[int]:
        system, at = _opened(self.passes)
        names = [f.base_name for f in system.get_file_info(fs.FileSelector(at, allow_not_found=True))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _list_of(self, number: int) -> dict[str, list[int]]:
        if number == 0:
            return {}
        system, at = _opened(self.passes)
        with system.open_input_stream(f"{at}/{number}.json") as f:
            return json.loads(f.read())

    def initialOffset(self) -> dict:
        return {"pass": 0}

    def latestOffset(self) -> dict:
        last = max(self._kept(), default=0)
        now = listing(self.path)
        if now == self._list_of(last):
            return {"pass": last}
        system, at = _opened(self.passes)
        system.create_dir(at)
        part = f"{at}/.{uuid.uuid4().hex}"
        with system.open_output_stream(part) as f:
            f.write(json.dumps(now).encode())
        system.move(part, f"{at}/{last + 1}.json")
        return {"pass": last + 1}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        out = []
        for number in range(start["pass"] + 1, end["pass"] + 1):
            out += shares(number, self._list_of(number - 1), self._list_of(number))
        return out

    def read(self, partition: Share) -> Iterator[tuple]:
        return _read(self.path, partition)

    def commit(self, end: dict) -> None:
        """Lists before the last committed one aren't asked for again."""
        system, at = _opened(self.passes)
        for number in self._kept():
            if number < end["pass"]:
                system.delete_file(f"{at}/{number}.json")


class _Written(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, at = _opened(self.path)
        system.create_dir(at)
        for batch in iterator:
            for name, value in zip(batch.column("file").to_pylist(), batch.column("value"), strict=True):
                if not name or "/" in name or name.startswith((".", "_")):
                    raise ValueError(f"no file name: {name!r}")
                if value.as_py() is None:
                    if system.get_file_info(f"{at}/{name}").is_file:
                        system.delete_file(f"{at}/{name}")
                    continue
                part = f"{at}/.{name}.{uuid.uuid4().hex}"  # a reader sees the old document or the new one
                with system.open_output_stream(part) as f:
                    f.write(value.as_py().encode())
                system.move(part, f"{at}/{name}")
        return WriterCommitMessage()


class CardFolder(DataSource):
    """``spark.read``, ``readStream`` and ``write`` of format ``card_folder``.

    Rows are pass_no, file, kind (``written`` or ``removed``), modified (ms) and value (the text).  Options: ``path``; for a
    stream ``passes``, a folder for the lists.  Writing takes file and value, in this order; a null value removes the file.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Whole(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Followed(self.options["path"], self.options["passes"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Written(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CardFolder)
