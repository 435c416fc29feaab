"""Binary files in the shared folder, written and read by tasks: whole or not at all, and by byte range."""

from __future__ import annotations

import os
import uuid
from functools import lru_cache

from pyarrow import fs

from blendscope.session import arrow_uri


@lru_cache(maxsize=64)
def locate(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder given as a URI of any store that Arrow reads, or as an absolute path."""
    return fs.FileSystem.from_uri(arrow_uri(folder))


class Output:
    """A file that gets its name when it is closed without an error; a retried task replaces it."""

    def __init__(self, folder: str, name: str):
        self.fs, path = locate(folder)
        self.fs.create_dir(path, recursive=True)
        self.final, self.temp = f"{path}/{name}", f"{path}/_{name}-{uuid.uuid4().hex}"
        self.stream, self.size = self.fs.open_output_stream(self.temp), 0

    def write(self, data: bytes) -> int:
        """Write, and give the offset of what was written."""
        at = self.size
        self.stream.write(data)
        self.size += len(data)
        return at

    def __enter__(self):
        return self

    def __exit__(self, kind, *_):
        self.stream.close()
        if kind:
            self.fs.delete_file(self.temp)
            return
        if not isinstance(self.fs, fs.LocalFileSystem) and self.fs.get_file_info(self.final).type != fs.FileType.NotFound:
            self.fs.delete_file(self.final)
        self.fs.move(self.temp, self.final)


def read_range(folder: str, name: str, offset: int, size: int) -> bytes:
    """``size`` bytes of a file from ``offset``; a shorter answer is an error."""
    system, path = locate(folder)
    with system.open_input_file(f"{path}/{name}") as f:
        data = f.read_at(size, offset)
    if len(data) != size:
        raise OSError(f"{os.path.join(path, name)}: {len(data)} of {size} bytes at {offset}")
    return data
