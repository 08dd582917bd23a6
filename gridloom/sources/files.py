"""Files under local paths or under URIs of file systems that the Arrow library knows."""

from __future__ import annotations

from typing import BinaryIO


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def opened(path: str) -> BinaryIO:
    """A file to read, which can seek."""
    if "://" not in path:
        return open(path.removeprefix("file:"), "rb")
    system, inner = _system(path)
    return system.open_input_file(inner)


def created(path: str) -> BinaryIO:
    """A new file to write; its folder is made if need be."""
    import os

    if "://" not in path:
        local = path.removeprefix("file:")
        os.makedirs(os.path.dirname(local) or ".", exist_ok=True)
        return open(local, "wb")
    system, inner = _system(path)
    system.create_dir(inner.rpartition("/")[0], recursive=True)
    return system.open_output_stream(inner)


def size_of(path: str) -> int:
    """The length of a file in bytes."""
    import os

    if "://" not in path:
        return os.path.getsize(path.removeprefix("file:"))
    system, inner = _system(path)
    return system.get_file_info(inner).size
