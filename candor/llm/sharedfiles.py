"""Binary array files in the shared folder, memory-mapped where that folder is mounted.

A file is written under a temporary name and renamed, so a retried task replaces it whole. In a
store that is not mounted (another scheme than file) files go through pyarrow.fs, and an opened file
is read into memory instead of mapped.
"""

from __future__ import annotations

import json
import mmap
import os
import uuid
from urllib.parse import urlparse

import numpy as np


def _local(root: str) -> str | None:
    parts = urlparse(root)
    return parts.path if parts.scheme in ("", "file") else None


def mapped(root: str) -> bool:
    """Whether files below root are mapped when they are read."""
    return _local(root) is not None


def write(root: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    at, spec, body = 0, {}, []
    for key, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        spec[key] = [a.dtype.str, at, len(a)]
        raw += b"\0" * (-len(raw) % 8)
        body.append(raw)
        at += len(raw)
    head = json.dumps(spec).encode()
    head += b" " * (-len(head) % 8)
    data = b"".join([np.int64(len(head)).tobytes(), head, *body])
    own = f"{name}.{uuid.uuid4().hex}"
    if folder := _local(root):
        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/{own}", "wb") as f:
            f.write(data)
        os.replace(f"{folder}/{own}", f"{folder}/{name}")
        return
    from pyarrow import fs

    store, folder = fs.FileSystem.from_uri(root)
    store.create_dir(folder, recursive=True)
    with store.open_output_stream(f"{folder}/{own}") as f:
        f.write(data)
    store.move(f"{folder}/{own}", f"{folder}/{name}")


def read(root: str, name: str) -> dict[str, np.ndarray]:
    if folder := _local(root):
        with open(f"{folder}/{name}", "rb") as f:
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    else:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(root)
        with store.open_input_file(f"{folder}/{name}") as f:
            data = f.read()
    n = int(np.frombuffer(data, np.int64, 1)[0])
    spec = json.loads(data[8 : 8 + n])
    return {k: np.frombuffer(data, np.dtype(kind), length, 8 + n + at) for k, (kind, at, length) in spec.items()}


def remove(root: str, name: str) -> None:
    if folder := _local(root):
        if os.path.exists(f"{folder}/{name}"):
            os.remove(f"{folder}/{name}")
        return
    from pyarrow import fs

    store, folder = fs.FileSystem.from_uri(root)
    store.delete_file(f"{folder}/{name}")
