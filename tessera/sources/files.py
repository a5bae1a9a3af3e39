"""Files of any store that Arrow opens: a path or a URI."""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs


def open_read(path: str) -> pa.NativeFile:
    """A file for reading at any place."""
    store, where = fs.FileSystem.from_uri(path)
    return store.open_input_file(where)


def open_write(path: str) -> pa.NativeFile:
    """A new file, written from start to end; missing folders are made and an older file is replaced."""
    store, where = fs.FileSystem.from_uri(path)
    store.create_dir(where.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(where)
