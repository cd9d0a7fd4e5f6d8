"""Files of a shared folder from inside tasks, on any file system that Arrow knows by its URI."""

from __future__ import annotations

import contextlib
import uuid

from pyarrow import fs


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def new_file(folder: str, name: str):
    """A stream to write to; the file has its name only once it is whole, so that a lost or repeated task leaves no half file."""
    system, base = open_fs(folder)
    system.create_dir(base, recursive=True)
    part = f"{base}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(part, compression=None) as stream:
        yield stream
    # A repeated task replaces what it wrote before, also where a move doesn't overwrite.
    if system.get_file_info(f"{base}/{name}").type != fs.FileType.NotFound:
        system.delete_file(f"{base}/{name}")
    system.move(part, f"{base}/{name}")
