"""Files that tasks write into, and read from, the shared folder, by its URI."""

from __future__ import annotations

import uuid


def _at(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def new_file(folder_uri: str, stem: str, suffix: str):
    """(uri, open stream) of a file whose name no other attempt of the task uses.

    A task's files count only if its output row, which Spark commits once, names them; what a lost
    attempt left behind is never read.
    """
    system, folder = _at(folder_uri)
    system.create_dir(folder, recursive=True)
    name = f"{stem}-{uuid.uuid4().hex[:12]}{suffix}"
    return f"{folder_uri}/{name}", system.open_output_stream(f"{folder}/{name}", compression=None)


def open_file(uri: str):
    """A seekable input."""
    system, path = _at(uri)
    return system.open_input_file(path)
