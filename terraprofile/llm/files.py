"""Binary files on the shared folder, written and read by tasks."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's URI or absolute path, and the path in it."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


@contextmanager
def whole_file(store: fs.FileSystem, path: str):
    """Write a file that appears under its name only when complete, so a task can run again."""
    folder, _, name = path.rpartition("/")
    draft = f"{folder}/_{name}-{uuid.uuid4().hex}"
    store.create_dir(folder, recursive=True)
    with store.open_output_stream(draft, compression=None) as out:
        yield out
    store.move(draft, path)
