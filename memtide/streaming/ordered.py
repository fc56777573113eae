"""Rows of one key of a micro-batch in order, in bounded memory."""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections.abc import Iterable, Iterator
from operator import itemgetter
from typing import IO

#: Rows of a key that are Python objects at once; beyond that they wait in sorted runs in the worker's temporary folder.
HELD = 100_000
CHUNK = 1000
RUNS = 64


def _written(rows: Iterable[tuple]) -> IO[bytes]:
    file, chunk = tempfile.TemporaryFile(), []
    for row in rows:
        chunk.append(row)
        if len(chunk) == CHUNK:
            pickle.dump(chunk, file, pickle.HIGHEST_PROTOCOL)
            chunk = []
    pickle.dump(chunk, file, pickle.HIGHEST_PROTOCOL)  # the last one is shorter
    file.seek(0)
    return file


def _read(file: IO[bytes]) -> Iterator[tuple]:
    with file:
        chunk = [()] * CHUNK
        while len(chunk) == CHUNK:
            chunk = pickle.load(file)
            yield from chunk


def in_order(rows: Iterable[tuple], keys: int = 1, held: int | None = None) -> Iterator[tuple]:
    """``rows`` by their first ``keys`` fields; equal ones in the order in which they come."""
    key, most = itemgetter(*range(keys)), held or HELD
    now: list[tuple] = []
    runs: list[IO[bytes]] = []
    for row in rows:
        now.append(row)
        if len(now) >= most:
            now.sort(key=key)
            runs.append(_written(now))
            now = []
            if len(runs) == RUNS:
                runs = [_written(heapq.merge(*map(_read, runs), key=key))]
    now.sort(key=key)
    return heapq.merge(*map(_read, runs), now, key=key) if runs else iter(now)
