"""Files that tasks write to and read from the shared folder, for data that Spark's own sources cannot cut.

Names are new for each attempt; a file counts once the table that lists it is committed, so what a lost task leaves
behind is never read.
"""

from __future__ import annotations

import io
import uuid


def filesystem(uri: str):
    """The file system of a shared path and the path in it; plain and ``file:`` paths are local mounts."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def create(folder: str, suffix: str):
    """A new file below ``folder``: its path and a stream to write it."""
    path = f"{folder}/{uuid.uuid4().hex}{suffix}"
    system, inner = filesystem(path)
    system.create_dir(inner.rpartition("/")[0], recursive=True)
    return path, system.open_output_stream(inner, compression=None)


class Section(io.RawIOBase):
    """``length`` bytes of a file from ``offset``, read as they are asked for."""

    def __init__(self, path: str, offset: int, length: int):
        system, inner = filesystem(path)
        self._file = system.open_input_file(inner)
        self._file.seek(offset)
        self._left = length

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        got = self._file.read(min(len(buffer), self._left))
        buffer[: len(got)] = got
        self._left -= len(got)
        return len(got)

    def close(self) -> None:
        if not self.closed:
            self._file.close()
        super().close()
