"""Sorted hash arrays in the shared folder, written by one task a shard and memory-mapped by every worker that reads them.

Keys are 64-bit names, dealt to shards by range, so that shard files hold consecutive sorted runs. A shard is written under a
name of its own attempt and renamed, so a repeated task replaces it by equal content."""

from __future__ import annotations

import io
import os
import uuid
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa


def _local(folder: str) -> str | None:
    at = urlparse(folder)
    return at.path if at.scheme in ("", "file") else None


def _remote(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The range shard of each key, by its top 32 bits."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def put(folder: str, shard: int, **columns: np.ndarray) -> None:
    """Write the columns of one shard."""
    local = _local(folder)
    store, base = (None, local) if local else _remote(folder)
    store.create_dir(base, recursive=True) if store else os.makedirs(base, exist_ok=True)
    for name, column in columns.items():
        whole = f"{base}/{name}-{shard:05d}.npy"
        part = f"{base}/.{name}-{shard:05d}.{uuid.uuid4().hex}"
        with store.open_output_stream(part) if store else open(part, "wb") as out:
            np.lib.format.write_array_header_1_0(out, np.lib.format.header_data_from_array_1_0(column))
            out.write(np.ascontiguousarray(column).tobytes())
        store.move(part, whole) if store else os.replace(part, whole)


#: Columns of shards that a worker keeps in memory where it can't map them.
KEPT = 64
_open: dict[str, "Shards"] = {}


def shards(folder: str, count: int, *columns: str) -> "Shards":
    """The arrays of a folder, opened once a worker."""
    if folder not in _open:
        while len(_open) > 8:
            _open.pop(next(iter(_open)))
        _open[folder] = Shards(folder, count, columns)
    return _open[folder]


def release() -> None:
    """Lets go of all arrays that this worker has opened, and of what Arrow holds unused: for a task that needs none of an earlier operator's."""
    _open.clear()
    pa.default_memory_pool().release_unused()


class Shards:
    """Read side: columns[0] holds sorted distinct keys; the others go with it.

    Shards in a mounted folder are mapped; others are read when asked for, and the KEPT last ones stay in memory."""

    def __init__(self, folder: str, count: int, columns: tuple[str, ...]):
        self.count, self.columns = count, columns
        self.base, self.store = _local(folder), None
        if self.base is None:
            self.store, self.base = _remote(folder)
        self._held: dict[tuple[str, int], np.ndarray | None] = {}

    def _read(self, path: str) -> np.ndarray | None:
        if self.store is None:
            return np.load(path, mmap_mode="r") if os.path.exists(path) and os.path.getsize(path) > 0 else None
        if not self.store.get_file_info(path).is_file:
            return None
        with self.store.open_input_stream(path) as src:
            return np.load(io.BytesIO(src.read()))

    def get(self, name: str, shard: int) -> np.ndarray | None:
        at = name, shard
        if at not in self._held:
            while self.store is not None and len(self._held) >= KEPT:
                self._held.pop(next(iter(self._held)))
            self._held[at] = self._read(f"{self.base}/{name}-{shard:05d}.npy")
        return self._held[at]

    def lookup(self, keys: np.ndarray, *wanted: str) -> list[np.ndarray]:
        """For keys in any order: whether each is held, then its value in every wanted column (0 if it isn't held)."""
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        held = np.zeros(len(keys), bool)
        values = [None] * len(wanted)
        cuts = np.searchsorted(shard_of(ordered, self.count), np.arange(self.count + 1))
        for shard in np.flatnonzero(np.diff(cuts)):
            have = self.get(self.columns[0], int(shard))
            if have is None or not len(have):
                continue
            lo, hi = cuts[shard], cuts[shard + 1]
            at = np.minimum(np.searchsorted(have, ordered[lo:hi]), len(have) - 1)
            hit = have[at] == ordered[lo:hi]
            held[order[lo:hi]] = hit
            for k, name in enumerate(wanted):
                column = self.get(name, int(shard))
                if values[k] is None:  # shards may hold integers of different widths
                    values[k] = np.zeros(len(keys), np.int64 if column.dtype.kind in "iu" else column.dtype)
                values[k][order[lo:hi][hit]] = column[at[hit]]
        return [held, *(np.zeros(len(keys), np.int64) if v is None else v for v in values)]
