"""Small files by URI, on the driver or an executor."""

from __future__ import annotations

from urllib.parse import unquote, urlparse


def file_system(uri: str):
    """(pyarrow file system, path) of a URI or local path."""
    from pyarrow import fs

    parsed = urlparse(uri)
    if parsed.scheme == "file":
        return fs.LocalFileSystem(), unquote(parsed.path)
    if len(parsed.scheme) < 2:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def write_text(uri: str, text: str) -> None:
    write_bytes(uri, text.encode())


def write_bytes(uri: str, data: bytes) -> None:
    """Write a file whole; one of that name is replaced."""
    system, path = file_system(uri)
    system.create_dir(path.rpartition("/")[0] or "/", recursive=True)
    with system.open_output_stream(path) as out:
        out.write(data)


def read_text(uri: str) -> str:
    system, path = file_system(uri)
    with system.open_input_stream(path) as stream:
        return stream.read().decode()
