"""Small tables of what was delivered, one file for each delivery.

A ledger is a folder of JSON-lines files in storage that the driver and all executors reach. A
file appears whole or not at all, and its name says which delivery it stands for, so whoever
repeats a delivery can see that it is finished, and when it first was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyarrow import fs

LEDGER = "_ledger"


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path inside it, from a plain path or a URI."""
    if path.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def present(system: fs.FileSystem, path: str) -> bool:
    return system.get_file_info(path).type != fs.FileType.NotFound


class Ledger:
    """Deliveries by name. Names that begin with a dot are left out by Spark's readers."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.system, self.root = open_folder(self.path)

    def _file(self, name: str) -> str:
        return f"{self.root}/{name}.json"

    def rows(self, name: str) -> list[dict] | None:
        """Rows of a delivery; None when it isn't there."""
        if not present(self.system, self._file(name)):
            return None
        with self.system.open_input_stream(self._file(name)) as f:
            return [json.loads(line) for line in f.read().splitlines()]

    def put(self, name: str, rows: Sequence[Mapping]) -> None:
        """Write a delivery's rows, all at once."""
        self.system.create_dir(self.root, recursive=True)
        scratch = f"{self.root}/.{uuid.uuid4().hex}"
        with self.system.open_output_stream(scratch) as f:
            f.write("".join(json.dumps(row) + "\n" for row in rows).encode())
        self.system.move(scratch, self._file(name))

    def drop(self, name: str) -> None:
        if present(self.system, self._file(name)):
            self.system.delete_file(self._file(name))

    def names(self, prefix: str = "") -> list[str]:
        """Names of the deliveries, in order."""
        if not present(self.system, self.root):
            return []
        found = [i.base_name for i in self.system.get_file_info(fs.FileSelector(self.root))]
        return sorted(n.removesuffix(".json") for n in found if n.endswith(".json") and not n.startswith(".") and n.startswith(prefix))


def batch_name(batch_id: int | str) -> str:
    """Name of a delivery: that of a micro-batch by its number, or one of the caller's own."""
    return batch_id if isinstance(batch_id, str) else f"batch-{batch_id:012d}"


def first_upload(path: str, batch_id: int, now: datetime | None = None) -> datetime:
    """Upload time of a batch: that of its first attempt, whenever it is asked again."""
    ledger, name = Ledger(f"{path.rstrip('/')}/{LEDGER}"), f"upload-{batch_id:012d}"
    known = ledger.rows(name)
    if known is None:
        known = [{"uploaded": (now or datetime.now(timezone.utc)).isoformat()}]
        ledger.put(name, known)
    return datetime.fromisoformat(known[0]["uploaded"])
