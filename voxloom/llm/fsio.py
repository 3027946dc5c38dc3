"""Binary files in the shared folder, from tasks: written whole under another name, then moved into place."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs


@contextmanager
def output(uri: str) -> Iterator:
    """A stream whose file appears under uri once it is closed; a task run again replaces it with equal content."""
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}.part"
    try:
        with system.open_output_stream(part, compression=None) as out:
            yield out
    except BaseException:
        system.delete_file(part)
        raise
    if system.get_file_info(path).type != fs.FileType.NotFound and system.type_name != "local":
        system.delete_file(path)
    system.move(part, path)


def source(uri: str):
    """A readable stream of the file as it is."""
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_stream(path, compression=None)
