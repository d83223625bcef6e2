"""Opening and writing files from inside tasks, on any mounted or remote store."""

from __future__ import annotations

import uuid
from urllib.parse import quote

from pyarrow import fs

# An archive is written in many short pieces.
BUFFER_BYTES = 64 << 10


def _locate(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path as Spark lists it: a scheme, but no URI escapes."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    authority, _, name = rest.removeprefix("//").partition("/")
    scheme = "s3" if scheme in ("s3a", "s3n") else scheme
    store, base = fs.FileSystem.from_uri(f"{scheme}://{quote(authority, safe='@:')}/")
    return store, f"{base.rstrip('/')}/{name}"


def open_input(uri: str):
    """A seekable file; only the ranges that are read cross the network."""
    store, path = _locate(uri)
    return store.open_input_file(path)


def list_files(uri: str, recursive: bool = True) -> list[tuple[str, fs.FileInfo]]:
    """What lies below a folder, by its path from there; nothing if there is no such folder."""
    store, path = _locate(uri.rstrip("/"))
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=recursive))
    return [(info.path.removeprefix(f"{path}/"), info) for info in found]


class StagedFile:
    """A file that appears under its name only when it is complete.

    A task may run twice at once, so every attempt writes its own temporary
    name and the last one to finish replaces the other's identical file.
    """

    def __init__(self, uri: str):
        self._store, self._path = _locate(uri)
        folder, _, name = self._path.rpartition("/")
        self._temporary = f"{folder}/.{uuid.uuid4().hex}-{name}"
        self._store.create_dir(folder, recursive=True)

    def __enter__(self):
        self._out = self._store.open_output_stream(self._temporary, buffer_size=BUFFER_BYTES)
        return self._out

    def __exit__(self, failure, *_):
        self._out.close()
        if failure:
            self._store.delete_file(self._temporary)
        else:
            self._publish()

    def _publish(self):
        try:
            self._store.move(self._temporary, self._path)
        except OSError:
            # some stores do not replace; an earlier attempt's file is the same
            if self._store.get_file_info(self._path).type != fs.FileType.File:
                raise
            self._store.delete_file(self._temporary)
