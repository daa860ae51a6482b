"""Files in a folder that all executors share, by URI: local mounts directly, stores through pyarrow."""

from __future__ import annotations

import os
import posixpath
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import BinaryIO
from urllib.parse import unquote, urlparse


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def make_dir(uri: str) -> None:
    if path := _local(uri):
        os.makedirs(path, exist_ok=True)
    else:
        system, path = _store(uri)
        system.create_dir(path, recursive=True)


@contextmanager
def create(uri: str) -> Iterator[BinaryIO]:
    """Write a file that appears under its name only when complete, so a repeated task is harmless."""
    part = f"{posixpath.dirname(uri)}/.{posixpath.basename(uri)}.{uuid.uuid4().hex}"
    if path := _local(part):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        try:
            with open(path, "wb", buffering=1 << 20) as f:
                yield f
            os.replace(path, _local(uri))
        finally:
            if os.path.exists(path):
                os.unlink(path)
    else:
        system, path = _store(part)
        with system.open_output_stream(path) as f:
            yield f
        system.move(path, _store(uri)[1])


@contextmanager
def opened(uri: str) -> Iterator[BinaryIO]:
    """Read a file from its start; ``seek`` works."""
    if path := _local(uri):
        with open(path, "rb", buffering=1 << 20) as f:
            yield f
    else:
        system, path = _store(uri)
        with system.open_input_file(path) as f:
            yield f
