"""Number arrays as files in the shared folder: written once under their final name, memory-mapped by readers."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
from pyarrow import fs


#: Names that Hadoop has for stores, and pyarrow's.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The store and the path in it of a URI as Spark has it, or of an absolute path."""
    scheme, mark, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}{mark}{rest}")


def write_array(uri: str, array: np.ndarray) -> None:
    """A repeated or speculative task writes the same bytes; the last rename wins."""
    store, path = opened(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        out.write(np.ascontiguousarray(array).view(np.uint8).data)
    store.move(own, path)


def map_array(uri: str, dtype) -> np.ndarray:
    """Read-only pages of the file; one in a remote store is copied to a local file that goes at once."""
    store, path = opened(uri)
    if store.get_file_info(path).size == 0:
        return np.zeros(0, dtype)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with tempfile.NamedTemporaryFile() as local, store.open_input_stream(path) as source:
        while block := source.read(1 << 24):
            local.write(block)
        local.flush()
        return np.memmap(local.name, dtype, "r")
