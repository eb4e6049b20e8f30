"""A folder as a stream of changes: files that are new, written again or gone."""

from __future__ import annotations

import fnmatch
import hashlib
import json
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow.fs as pf
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from lodeweave.sources.vault import TOOLS

FORMAT = "folder_changes"
SCHEMA = "doc_path string, state string, text string, checksum string, modified timestamp"
UPSERT, GONE = "upsert", "gone"
#: Files that one task reads.
FILES = 500


class FolderChanges(DataSource):
    """Rows (doc_path, state, text, checksum, modified) of a folder's changes since the last batch.

    Options: path (a folder, local or of any store that pyarrow reaches), manifests (a folder for listings, which
    belongs to one stream), pattern (of file names, "*.md" if not given). State is "upsert" with the text, or "gone" without.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return Changes(self.options["path"], self.options["manifests"], self.options.get("pattern", "*.md"))


class Files(InputPartition):
    def __init__(self, changes: list[tuple[str, str]]):
        self.changes = changes


class Changes(DataSourceStreamReader):
    """Offsets number the listings that differed from the one before; each is kept, so that a batch that runs again after
    a failure is the same change. A file counts as written again when its size or its time of change differs."""

    def __init__(self, path: str, manifests: str, pattern: str):
        self.path, self.manifests, self.pattern = path, manifests, pattern

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        """The number of the folder's listing as it is now."""
        store, folder = _opened(self.manifests)
        store.create_dir(folder, recursive=True)
        last = max((int(f.base_name.removesuffix(".json")) for f in store.get_file_info(pf.FileSelector(folder)) if f.base_name.endswith(".json")), default=0)
        now = self.listing()
        if now != self.kept(last):
            last += 1
            with store.open_output_stream(f"{folder}/{last}.tmp") as out:
                out.write(json.dumps(now).encode())
            store.move(f"{folder}/{last}.tmp", f"{folder}/{last}.json")
        return {"listing": last}

    def listing(self) -> dict[str, list[int]]:
        """Path below the folder to size and time of change, of the files that match; folders of tools are left out."""
        store, root = _opened(self.path)
        out = {}
        for f in store.get_file_info(pf.FileSelector(root, recursive=True, allow_not_found=True)):
            below = f.path[len(root) :].lstrip("/")
            folders = below.split("/")[:-1]
            if f.type == pf.FileType.File and fnmatch.fnmatchcase(f.base_name, self.pattern) and not any(p.startswith(".") or p in TOOLS for p in folders):
                out[below] = [f.size, f.mtime_ns or 0]
        return out

    def kept(self, number: int) -> dict[str, list[int]]:
        if number == 0:
            return {}
        store, folder = _opened(self.manifests)
        with store.open_input_stream(f"{folder}/{number}.json") as f:
            return json.loads(f.read())

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, now = self.kept(start["listing"]), self.kept(end["listing"])
        changes = [(p, UPSERT) for p, mark in sorted(now.items()) if before.get(p) != mark] + [(p, GONE) for p in sorted(before.keys() - now.keys())]
        return [Files(changes[i : i + FILES]) for i in range(0, len(changes), FILES)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        """The changed files as they are when they are read: one that has vanished since is left to the next listing."""
        store, root = _opened(self.path)
        for path, state in partition.changes:
            if state == GONE:
                yield path, GONE, None, None, None
                continue
            try:
                with store.open_input_stream(f"{root}/{path}") as f:
                    raw = f.read()
                changed = store.get_file_info(f"{root}/{path}").mtime
            except FileNotFoundError:
                continue
            yield path, UPSERT, raw.decode("utf-8", "replace"), hashlib.sha256(raw).hexdigest(), changed or datetime.now(UTC)

    def commit(self, end: dict) -> None:
        """Listings before the last finished batch are not needed again."""
        store, folder = _opened(self.manifests)
        for f in store.get_file_info(pf.FileSelector(folder, allow_not_found=True)):
            if f.base_name.endswith(".json") and int(f.base_name.removesuffix(".json")) < end["listing"]:
                store.delete_file(f.path)


def _opened(path: str) -> tuple[pf.FileSystem, str]:
    store, root = pf.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pf.LocalFileSystem(), path)
    return store, root.rstrip("/")


def changes(spark: SparkSession, root: str, manifests: str, pattern: str = "*.md"):
    """The stream of a folder's changes."""
    spark.dataSource.register(FolderChanges)
    return spark.readStream.format(FORMAT).option("manifests", manifests).option("pattern", pattern).load(root)
