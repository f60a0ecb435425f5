"""A remote store of folders and its change feed, as a Spark data source.

A client lists a folder a page at a time, and says what changed since a token. Batch: folders are listed breadth first until there are enough of them to
deal out; each task then walks the folders below its own, depth first, page by page. Stream: the offset is the feed's token, so a restart goes on where the
checkpoint stands, and a batch that runs again asks for the same pages. A page token that doesn't move, or a folder met before, ends that walk.

``spark.dataSource.register(RemoteStore)``, then ``spark.read.format("remote_store").option("client", "module:factory")``, with the factory's other
settings as options; it is called in the driver and in each task, and gives a ``Client``.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from typing import Protocol

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from textquarry.sources.detect import MIME
from textquarry.sources.listing import CHANGE, FOLDER

ENTRY = "id string, parent string, path string, name string, mime_type string, md5 string, size long, trashed boolean"
#: Fixed value: entries of a page.
PAGE = 100


class Client(Protocol):
    def children(self, folder: str, token: str | None, size: int) -> tuple[list[dict], str | None]:
        """Entries (id, name, mime_type, md5, size, trashed) of a folder's page, and the next page's token."""

    def first_token(self) -> str:
        """Where the change feed begins."""

    def changes(self, token: str, size: int) -> tuple[list[dict], str]:
        """Changes (file_id, removed, name, mime_type, md5, seq) of a page, and the token after it: the same one at the end."""


def client_of(options: dict) -> Client:
    module, _, name = options["client"].partition(":")
    return getattr(importlib.import_module(module), name)(dict(options))


def pages(client: Client, folder: str) -> Iterator[dict]:
    """All entries of a folder; a token that was there before ends it."""
    token, seen = None, set()
    while token not in seen:
        seen.add(token)
        entries, token = client.children(folder, token, PAGE)
        yield from entries
        if token is None:
            return


class Folder(InputPartition):
    """A folder to walk (``deep``), or one whose own files alone are wanted, as its folders are others' work."""

    def __init__(self, id: str, path: str, deep: bool):
        self.id, self.path, self.deep = id, path, deep


def walk(client: Client, start: Folder) -> Iterator[tuple]:
    """Files that can be read below a folder, depth first: rows of ENTRY."""
    todo, seen = [(start.id, start.path)], {start.id}
    while todo:
        folder, path = todo.pop()
        below = []
        for e in pages(client, folder):
            if e.get("trashed"):
                continue
            at = f"{path}/{e['name']}"
            if e["mime_type"] == FOLDER:
                if start.deep and e["id"] not in seen:
                    seen.add(e["id"])
                    below.append((e["id"], at))
            elif e["mime_type"] in MIME:
                yield (e["id"], folder, at, e["name"], e["mime_type"], e.get("md5"), e.get("size"), False)
        todo += reversed(below)


class RemoteReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Folder]:
        """At least ``partitions`` folders (64 by default), if there are so many; those listed on the way give their own files."""
        client, most = client_of(self.options), int(self.options.get("partitions", 64))
        flat, wave, seen = [], [Folder(self.options["folder"], "", True)], {self.options["folder"]}
        while wave and len(flat) + len(wave) < most:
            nxt = []
            for f in wave:
                flat.append(Folder(f.id, f.path, False))
                for e in pages(client, f.id):
                    if e["mime_type"] == FOLDER and not e.get("trashed") and e["id"] not in seen:
                        seen.add(e["id"])
                        nxt.append(Folder(e["id"], f"{f.path}/{e['name']}", True))
            wave = nxt
        return [*flat, *wave]

    def read(self, partition: Folder) -> Iterator[tuple]:
        yield from walk(client_of(self.options), partition)


class ChangeReader(SimpleDataSourceStreamReader):
    """Some pages of the feed a batch (``pages``, 10 by default)."""

    def __init__(self, options: dict):
        self.client, self.most = client_of(options), int(options.get("pages", 10))

    def initialOffset(self) -> dict:
        return {"token": self.client.first_token()}

    def _row(self, c: dict) -> tuple:
        return (c["file_id"], bool(c.get("removed")), c.get("name"), c.get("mime_type"), c.get("md5"), c.get("seq"))

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, token = [], start["token"]
        for _ in range(self.most):
            found, after = self.client.changes(token, PAGE)
            rows += map(self._row, found)
            if after == token:
                break
            token = after
        return iter(rows), {"token": token}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        token = start["token"]
        while token != end["token"]:
            found, after = self.client.changes(token, PAGE)
            yield from map(self._row, found)
            if after == token:
                return
            token = after

    def commit(self, end: dict) -> None:
        pass


class RemoteStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return "remote_store"

    def schema(self) -> str:
        return CHANGE if "feed" in self.options else ENTRY

    def reader(self, schema) -> RemoteReader:
        return RemoteReader(dict(self.options))

    def simpleStreamReader(self, schema) -> ChangeReader:
        return ChangeReader(dict(self.options))


class StoredListing:
    """A client of a listing kept as a JSON file, option ``path``: {"children": {folder: [entries]}, "changes": [changes]}. Tokens are places."""

    def __init__(self, options: dict):
        with open(options["path"], encoding="utf-8") as f:
            self.held = json.load(f)

    def children(self, folder: str, token: str | None, size: int) -> tuple[list[dict], str | None]:
        rows, at = self.held["children"].get(folder, []), int(token or 0)
        return rows[at : at + size], str(at + size) if at + size < len(rows) else None

    def first_token(self) -> str:
        return "0"

    def changes(self, token: str, size: int) -> tuple[list[dict], str]:
        found = self.held["changes"][int(token) : int(token) + size]
        return found, str(int(token) + len(found))
