"""Files in the shared folder, written and read by tasks.

A task writes under a name of its own and reports it in the rows it returns;
only names that Spark has taken into a written table count, so a file left by a
lost or repeated task is never read.
"""

from __future__ import annotations

import uuid
from urllib.parse import unquote, urlparse

from pyarrow import fs


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path)
    return fs.FileSystem.from_uri(uri)


def fresh(folder: str, suffix: str) -> str:
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}{suffix}"


def create(uri: str):
    """An output stream; its folder is made if there is none."""
    system, path = _place(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def read(uri: str):
    """A random-access input."""
    system, path = _place(uri)
    return system.open_input_file(path)
