"""Removal of long repeated byte strings by suffix sorting with bucket-pointer refinement.

Only windows of ``length`` bytes that two documents share can matter, so suffixes are sorted over candidates alone.

1. Documents are packed into blocks, written once, compressed.
2. Content-defined chunks, about a kilobyte each, are compared by 128-bit digests. A chunk that a smaller document has
   too goes as a whole, and only the smallest holder's windows are looked at further.
3. Winnowing without loss: in every window the smallest hash of its ``GRAM``-byte strings is the window's anchor, so equal
   windows have equal anchors. A block sends each distinct anchor hash once, in four bytes, to the hash's bucket, and
   learns by one bit whether another document has it.
4. A block sends the windows of its shared anchors, as byte strings around the anchor, with the smallest doc_id that has
   them. The windows of anchors that very many blocks share are rows of their own, reduced to their smallest doc_id by a
   grouped aggregation, so that a passage of all documents gathers nowhere.
5. A bucket sorts the suffixes of its strings: 8-byte grams give the first buckets, and each refinement sorts on a
   suffix's bucket and on the bucket of the suffix 8, 16, then ``length - 32`` bytes on, reusing the refined buckets.
   Suffixes alone in their bucket are settled. A last bucket is one distinct window, and its smallest doc_id settles
   which copies go.
6. The blocks cover their bytes with the windows found.

Equality of windows is of bytes, that of chunks of digests; other hashes only deal out and preselect. What a key gathers is bounded by the number of blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memtide.llm.scratch import materialize, scan_bytes

GRAM = 20
BLOCK_BYTES = 2 << 20
PART = 1 << 16
#: Strings of a bucket are settled in so many parts, one after the other.
PARTS = 8
BLOCK_DOCS = 16384
#: A chunk ends, on average, at every such anchor.
CHUNK_RUNS = 64
#: The windows of an anchor that so many blocks share are aggregated one by one.
HOT_BLOCKS = 512
#: Bytes of the documents' files whose blocks are shuffled at once, about, and the most rounds that makes.
ROUND_BYTES, ROUNDS = 128 << 20, 8
#: Stands for the bucket of such windows.
HOT = -2
NO_ID = np.iinfo(np.int64).max
_POS = np.uint64((1 << 28) - 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_STEP), n, 1 << 64))


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size``-byte string of ``data``, by doubling."""
    grams, done = _mix(data.astype(np.uint64) + np.uint64(1)), 1
    out, covered = None, 0
    while True:
        if size & done:
            n = max(0, len(data) - covered - done + 1)
            out = grams if out is None else out[:n] * _power(done) + grams[covered : covered + n]
            covered += done
        if covered == size:
            return _mix(out)
        n = max(0, len(grams) - done)
        grams = grams[:n] * _power(done) + grams[done : done + n]
        done *= 2


def hashes_at(data: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """``gram_hashes(data, size)[starts]`` without the rest."""
    out = np.zeros(len(starts), np.uint64)
    for i in range(size):
        out = out * _STEP + _mix(data[starts + i].astype(np.uint64) + np.uint64(1))
    return _mix(out)


def anchor_runs(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(first, last, doc, hash)``: runs of window starts that share an anchor, inside one document."""
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    at, wide = np.empty(n, np.int32), length - GRAM + 1
    for begin in range(0, n, PART):  # parts stay in a core's cache
        part = gram_hashes(data[begin : min(n, begin + PART) + length - 1], GRAM)
        key = (part & ~_POS) | np.arange(len(part), dtype=np.uint64)  # equal hashes: the leftmost
        size = 1
        while size * 2 <= wide:
            key = np.minimum(key[:-size], key[size:])
            size *= 2
        if size < wide:
            key = np.minimum(key[: len(key) - (wide - size)], key[wide - size :])
        at[begin : begin + PART] = (key & _POS).astype(np.int32) + np.int32(begin)
    begins = np.concatenate([[0], ends[:-1]])
    edges = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1, begins, np.maximum(begins, ends - length + 1)])
    first = np.unique(edges)
    first = first[first < n]
    last = np.concatenate([first[1:], [n]]) - 1
    doc = np.searchsorted(ends, first, side="right")
    inside = first + length <= ends[doc]
    first, last, doc = first[inside], last[inside], doc[inside]
    return first, last, doc, hashes_at(data, at[first].astype(np.int64), GRAM)


def _to_blocks(batches: Iterator[pa.RecordBatch], block_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """``(part, doc_id, text)`` of one partition, whose number is ``part`` -> its blocks."""
    part, seq, ids, texts, size = 0, 0, [], [], 0

    def block() -> pa.RecordBatch:
        row = {"block": [(part << 32) + seq], "ids": [np.array(ids, np.int64).tobytes()], "sizes": [np.array([len(x) for x in texts], np.int64).tobytes()], "data": [zstandard.ZstdCompressor(level=3).compress(b"".join(texts))]}
        return pa.RecordBatch.from_pydict(row, schema=pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("data", pa.binary())]))

    for batch in batches:
        for part, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            data = text.as_py() or b""
            if ids and (size + len(data) > block_bytes or len(ids) >= BLOCK_DOCS):
                yield block()
                seq, ids, texts, size = seq + 1, [], [], 0
            ids.append(NO_ID if doc_id is None else doc_id)
            texts.append(data)
            size += len(data)
    if ids:
        yield block()


class Block:
    """A block's bytes and its anchors, the same each time it is opened."""

    def __init__(self, ids: bytes, sizes: bytes, data: bytes, length: int, buckets: int) -> None:
        self.ids = np.frombuffer(ids, np.int64)
        self.ends = np.cumsum(np.frombuffer(sizes, np.int64))
        self.raw = zstandard.ZstdDecompressor().decompress(data, max_output_size=max(1, int(self.ends[-1])))
        self.data = np.frombuffer(self.raw, np.uint8)
        self.first, self.last, self.doc, hashes = anchor_runs(self.data, self.ends, length)
        keys = ((hashes >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))
        order = np.argsort(keys, kind="stable")
        new = np.concatenate([[True], keys[order][1:] != keys[order][:-1]]) if len(keys) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        self.keys = keys[order][begin]
        self.of = np.empty(len(keys), np.int64)
        self.of[order] = np.cumsum(new) - 1
        whose = self.doc[order]  # ascending for each key
        self.twice = whose[begin] != whose[np.concatenate([begin[1:], [len(keys)]]) - 1] if len(keys) else new
        self.bucket = (self.keys >> np.uint64(32)).astype(np.int64)
        self._cut_chunks(hashes, length, buckets)

    def _cut_chunks(self, hashes: np.ndarray, length: int, buckets: int) -> None:
        """Runs into chunks; ``digests`` are distinct, by bucket, with the smallest doc_id of the block that has each."""
        opens = hashes % np.uint64(CHUNK_RUNS) == 0
        opens[:1] = True
        opens[1:] |= self.doc[1:] != self.doc[:-1]
        begin = np.flatnonzero(opens)
        self.chunk_of = np.cumsum(opens) - 1
        self.chunk_start = self.first[begin]
        self.chunk_windows = self.last[np.concatenate([begin[1:], [len(opens)]]) - 1] - self.chunk_start + 1 if len(begin) else begin
        self.chunk_doc = self.doc[begin]
        raw, seen = self.raw, {}
        of = [seen.setdefault(hashlib.blake2b(raw[a : a + n + length - 1], digest_size=16).digest(), len(seen)) for a, n in zip(self.chunk_start.tolist(), self.chunk_windows.tolist(), strict=True)]
        home = np.array([int.from_bytes(d[:6], "little") % buckets for d in seen], np.int64)
        order = np.argsort(home, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        every = list(seen)
        self.digests, self.digest_bucket = [every[i] for i in order], home[order]
        self.chunk_digest = place[np.array(of, np.int64)]
        self.digest_doc = np.full(len(order), NO_ID, np.int64)
        np.minimum.at(self.digest_doc, self.chunk_digest, self.ids[self.chunk_doc])


def _pieces(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of a sorted array."""
    edges = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]]) if len(bucket) else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(bucket[a]), slice(int(a), int(b))


def suffix_classes(text: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """``(starts, class)`` of all windows of ``length`` bytes that don't cross ``ends``; equal windows, equal class.

    A class is the start of one of its windows. Suffixes alone in their bucket are settled and not looked at again.
    """
    n = len(text)
    left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n)  # bytes up to the end of the string
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    code = np.zeros(n, np.uint64)
    for i in range(8):
        code = (code << np.uint64(8)) | padded[i : i + n].astype(np.uint64)
    depth = 8
    live = np.flatnonzero(left >= depth)
    pointer = np.arange(n)  # a bucket is named by one of its suffixes, so names stay apart when others are refined
    rank = code[live]
    while True:
        order = np.argsort(rank)
        ranked = rank[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(rank) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        many = np.diff(np.append(begin, len(rank)))
        bucket = np.cumsum(new) - 1
        pointer[live[order]] = live[order[begin]][bucket]
        size = np.empty(len(rank), np.int64)
        size[order] = many[bucket]
        if depth == length:
            break
        step = min(depth, length - depth)  # the suffix ``step`` on has a bucket of ``depth`` bytes too
        live = live[(size > 1) & (left[live] >= depth + step)]
        rank = pointer[live] * np.int64(n) + pointer[live + step]
        depth += step
    starts = np.flatnonzero(left >= length)
    return starts, pointer[starts]


def _ask(block: Block, number: int) -> pd.DataFrame:
    """What a block asks each bucket about: its anchors and its chunks."""
    rest = block.keys.astype(np.uint32)
    anchors = {b: (rest[cut].tobytes(), np.packbits(block.twice[cut]).tobytes()) for b, cut in _pieces(block.bucket)}
    chunks = {b: b"".join(block.digests[cut]) + block.digest_doc[cut].tobytes() for b, cut in _pieces(block.digest_bucket)}
    rows = [(number, b, *anchors.get(b, (b"", b"")), chunks.get(b, b"")) for b in sorted({*anchors, *chunks})]
    return pd.DataFrame(rows, columns=["block", "bucket", "data", "many", "chunks"])


def _shared_chunks(blobs: pd.Series) -> list[np.ndarray]:
    """A bucket's digests of all blocks -> for each block's whether a document smaller than the block's holders has it."""
    digests, docs, least = [], [], {}
    for blob in blobs:
        n = len(blob) // 24
        digests.append([blob[16 * i : 16 * i + 16] for i in range(n)])
        docs.append(np.frombuffer(blob, np.int64, n, 16 * n).tolist())
        for d, doc in zip(digests[-1], docs[-1], strict=True):
            if doc < least.get(d, NO_ID):
                least[d] = doc
    return [np.array([least.get(d, NO_ID) < doc for d, doc in zip(ds, own, strict=True)], bool) for ds, own in zip(digests, docs, strict=True)]


def _shared_anchors(blobs: pd.DataFrame, hot_blocks: int = HOT_BLOCKS) -> pd.DataFrame:
    """A bucket's anchors of all blocks -> per block two bits each: another document has it, very many blocks have it.

    And a bit for each chunk.
    """
    parts = [np.frombuffer(x, np.uint32) for x in blobs["data"]]
    many = [np.frombuffer(x, np.uint8) for x in blobs["many"]]
    _, of, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    twice = np.bincount(of, weights=np.concatenate([np.unpackbits(m, count=len(p)) for m, p in zip(many, parts, strict=True)]), minlength=len(n)) > 0
    code = ((n > 1) | twice).astype(np.uint8) + (n >= hot_blocks).astype(np.uint8)
    out, at = [], 0
    for block, bucket, part, chunks in zip(blobs["block"], blobs["bucket"], parts, _shared_chunks(blobs["chunks"]), strict=True):
        mine = code[of[at : at + len(part)]]
        at += len(part)
        if mine.any() or chunks.any():
            out.append((block, bucket, np.packbits(np.concatenate([mine > 0, mine > 1])).tobytes(), np.packbits(chunks).tobytes()))
    return pd.DataFrame(out, columns=["block", "bucket", "data", "chunks"])


def _candidates(block: Block, number: int, reply: pd.DataFrame, length: int) -> list[tuple]:
    """Rows ``(block, bucket, kind, data)``: kind 1, strings for a bucket; kind 2, windows that very many blocks have;
    kind 0, what the block keeps for the end."""
    code = np.zeros(len(block.keys), np.uint8)
    got = dict(zip(reply["bucket"], reply["data"], strict=True))
    for bucket, cut in _pieces(block.bucket):
        if bucket in got:
            bits = np.unpackbits(np.frombuffer(got[bucket], np.uint8), count=2 * (cut.stop - cut.start))
            code[cut] = bits[: len(bits) // 2] + bits[len(bits) // 2 :]
    held = np.zeros(len(block.digests), bool)
    got = dict(zip(reply["bucket"], reply["chunks"], strict=True))
    for bucket, cut in _pieces(block.digest_bucket):
        if bucket in got:
            held[cut] = np.unpackbits(np.frombuffer(got[bucket], np.uint8), count=cut.stop - cut.start)
    whole = held[block.chunk_digest] | (block.ids[block.chunk_doc] > block.digest_doc[block.chunk_digest])
    spans = np.stack([block.chunk_start[whole], block.chunk_windows[whole]]).astype(np.uint32)
    run = np.where(whole[block.chunk_of], 0, code[block.of])
    cool, hot = np.flatnonzero(run == 1), np.flatnonzero(run == 2)
    start, stop, doc, bucket = block.first[cool], block.last[cool] + length, block.doc[cool], block.bucket[block.of[cool]]
    part = (block.keys[block.of[cool]] % np.uint64(PARTS)).astype(np.int64)
    if len(hot):  # one string a window
        sizes = block.last[hot] - block.first[hot] + 1
        p = np.repeat(block.first[hot] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        start, stop, doc = np.concatenate([start, p]), np.concatenate([stop, p + length]), np.concatenate([doc, np.repeat(block.doc[hot], sizes)])
        bucket, part = (np.concatenate([x, np.full(len(p), y)]) for x, y in ((bucket, HOT), (part, 0)))
    if not len(start) and not spans.size:
        return []
    # Equal strings of a block are sent once, with the smallest doc_id.
    seen: dict[bytes, int] = {}
    strings: list[bytes] = []
    of = np.empty(len(start), np.int64)
    raw = block.raw
    for i, (a, b) in enumerate(zip(start.tolist(), stop.tolist(), strict=True)):
        s = raw[a:b]
        k = seen.get(s)
        if k is None:
            k = seen[s] = len(strings)
            strings.append(s)
        of[i] = k
    least = np.full(len(strings), NO_ID, np.int64)
    np.minimum.at(least, of, block.ids[doc])
    home, parts = np.empty(len(strings), np.int64), np.empty(len(strings), np.uint8)
    home[of], parts[of] = bucket, part
    order = np.argsort(home, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    press = zstandard.ZstdCompressor(level=3)
    rows = []
    for b, cut in _pieces(home[order]):
        chosen = order[cut]
        packed = least[chosen].tobytes() + np.array([len(strings[i]) for i in chosen], np.uint16).tobytes() + parts[chosen].tobytes() + b"".join(strings[i] for i in chosen)
        rows.append((number, b, 2 if b == HOT else 1, len(chosen).to_bytes(4, "little") + press.compress(packed)))
    kept = np.stack([start, stop - start, doc, rank[of]]).astype(np.uint32)
    sent = np.stack([home[order], least[order]])
    sizes = np.array([kept.shape[1], sent.shape[1], spans.shape[1]], np.int64)
    rows.append((number, -1, 0, press.compress(sizes.tobytes() + kept.tobytes() + sent.tobytes() + spans.tobytes())))
    return rows


def _hot_windows(frames: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """Rows of kind 2 -> ``(block, place, window, doc)``, a row a window."""
    for frame in frames:
        for block, blob in zip(frame["block"], frame["data"], strict=True):
            n = int.from_bytes(blob[:4], "little")
            plain = zstandard.ZstdDecompressor().decompressobj().decompress(blob[4:])
            windows = [plain[a : a + length] for a in range(11 * n, 11 * n + n * length, length)]
            yield pd.DataFrame({"block": block, "place": np.arange(n, dtype=np.int32), "window": windows, "doc": np.frombuffer(plain, np.int64, n)})


def _hot_marks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``(block, places)`` of the windows that a smaller document has -> marks as those of a bucket."""
    for frame in frames:
        rows = []
        for block, places in zip(frame["block"], frame["places"], strict=True):
            bits = np.zeros(int(max(places)) + 1, bool)
            bits[np.asarray(places, np.int64)] = True
            rows.append((block, HOT, 1, np.packbits(bits).tobytes()))
        yield pd.DataFrame(rows, columns=["block", "bucket", "kind", "data"])


def _settle(blobs: pd.DataFrame, length: int) -> pd.DataFrame:
    """A bucket's strings of all blocks -> per block a bit for every window of its strings: a smaller document has it."""
    docs, sizes, parts, strings, count = [], [], [], [], []
    for blob in blobs["data"]:
        n = int.from_bytes(blob[:4], "little")
        plain = zstandard.ZstdDecompressor().decompressobj().decompress(blob[4:])
        docs.append(np.frombuffer(plain, np.int64, n))
        sizes.append(np.frombuffer(plain, np.uint16, n, 8 * n).astype(np.int64))
        parts.append(np.frombuffer(plain, np.uint8, n, 10 * n))
        edges = np.concatenate([[0], np.cumsum(sizes[-1])]) + 11 * n
        strings += [plain[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        count.append(n)
    docs, sizes, parts = np.concatenate(docs), np.concatenate(sizes), np.concatenate(parts)
    windows = sizes - length + 1
    place = np.cumsum(windows) - windows
    gone = np.zeros(int(windows.sum()), bool)
    for part in range(PARTS):
        rows = np.flatnonzero(parts == part)
        if len(rows):
            _settle_part([strings[i] for i in rows.tolist()], docs[rows], windows[rows], place[rows], gone, length)
    out, at = [], 0
    edge = np.append(place, len(gone))
    for block, bucket, n in zip(blobs["block"], blobs["bucket"], count, strict=True):
        mine = gone[edge[at] : edge[at + n]]
        at += n
        if mine.any():
            out.append((block, bucket, 1, np.packbits(mine).tobytes()))
    return pd.DataFrame(out, columns=["block", "bucket", "kind", "data"])


def _settle_part(strings: list[bytes], docs: np.ndarray, windows: np.ndarray, place: np.ndarray, gone: np.ndarray, length: int) -> None:
    """Marks in ``gone``, at each string's ``place``, the windows that a smaller document has."""
    number: dict[bytes, int] = {}
    of = np.fromiter((number.setdefault(s, len(number)) for s in strings), np.int64, len(strings))
    least = np.full(len(number), NO_ID, np.int64)
    np.minimum.at(least, of, docs)
    text = np.frombuffer(b"".join(number), np.uint8)
    width = np.fromiter(map(len, number), np.int64, len(number))
    ends = np.cumsum(width)
    start, klass = suffix_classes(text, ends, length)
    smallest = np.full(len(text), NO_ID, np.int64)
    np.minimum.at(smallest, klass, least[np.searchsorted(ends, start, side="right")])
    best = np.full(len(text), NO_ID, np.int64)
    best[start] = smallest[klass]
    before = np.cumsum(windows) - windows
    inside = np.arange(int(windows.sum())) - np.repeat(before, windows)
    gone[np.repeat(place, windows) + inside] = best[np.repeat((ends - width)[of], windows) + inside] < np.repeat(docs, windows)


def _covered(block: Block, marks: pd.DataFrame, length: int) -> np.ndarray:
    edge = np.zeros(len(block.data) + 1, np.int32)
    kept = marks.loc[marks["kind"] == 0, "data"]
    if len(kept):
        plain = zstandard.ZstdDecompressor().decompressobj().decompress(kept.iloc[0])
        n, m, k = np.frombuffer(plain, np.int64, 3).tolist()
        start, size, doc, rank = np.frombuffer(plain, np.uint32, 4 * n, 24).reshape(4, n).astype(np.int64)
        home, least = np.frombuffer(plain, np.int64, 2 * m, 24 + 16 * n).reshape(2, m)
        span, wide = np.frombuffer(plain, np.uint32, 2 * k, 24 + 16 * n + 16 * m).reshape(2, k).astype(np.int64)
        np.add.at(edge, span, 1)
        np.add.at(edge, span + wide - 1 + length, -1)
        width = np.zeros(m, np.int64)
        width[rank] = size - length + 1
        begin = np.cumsum(width) - width
        gone = np.zeros(int(width.sum()), bool)
        got = marks.loc[marks["kind"] == 1]
        got = dict(zip(got["bucket"], got["data"], strict=True))
        for bucket, cut in _pieces(home):
            if bucket in got:
                a, b = begin[cut.start], begin[cut.stop - 1] + width[cut.stop - 1]
                gone[a:b] = np.unpackbits(np.frombuffer(got[bucket], np.uint8), count=b - a)
        windows = size - length + 1
        total = int(windows.sum())
        before = np.cumsum(windows) - windows
        inside = np.arange(total) - np.repeat(before, windows)
        later = np.repeat(block.ids[doc] > least[rank], windows)  # the same string in a smaller document of the block
        p = (np.repeat(start, windows) + inside)[gone[np.repeat(begin[rank], windows) + inside] | later]
        np.add.at(edge, p, 1)
        np.add.at(edge, p + length, -1)
    return np.cumsum(edge, dtype=np.int32)[:-1] > 0


def _report(block: Block, covered: np.ndarray, with_text: bool) -> pd.DataFrame:
    rows, at = [], 0
    for doc_id, end in zip(block.ids.tolist(), block.ends.tolist(), strict=True):
        gone = covered[at:end]
        left = block.data[at:end][~gone].tobytes()
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(gone) else 0
        rows.append((None if doc_id == NO_ID else doc_id, end - at, int(gone.sum()), spans, hashlib.sha256(left).hexdigest(), *([left] * with_text)))
        at = end
    out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text])
    return out.astype({"doc_id": "Int64"})


def remove_repeats(docs: DataFrame, length: int = 50, buckets: int | None = None, with_text: bool = False, block_bytes: int = BLOCK_BYTES, hot_blocks: int = HOT_BLOCKS) -> DataFrame:
    """``(doc_id, text)`` -> per row ``(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept])``.

    Every byte goes that a string of ``length`` bytes covers which also starts in a document with a smaller doc_id;
    strings are judged on the input, overlap, and never cross documents. ``kept`` is bytes: a cut may split a character.
    Null texts are empty. Rows that repeat a doc_id are one document to each other and lose nothing by it. A row without
    doc_id counts as larger than any other. An empty table gives an empty one.

    A block sends a row to every bucket that it has an anchor for, so rows grow with blocks times buckets: with executors
    that hold more, larger ``block_bytes`` and fewer ``buckets`` spare them. Each step is written before the next one, and
    blocks and buckets are shuffled in rounds, so that little more than the blocks and their strings is on disk at once.
    """
    if length < 33 or length > 64:
        raise ValueError("length must be 33 to 64")
    spark = docs.sparkSession
    buckets = buckets or max(16, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), scan_bytes(docs) // (64 << 20))
    blocks = materialize(docs.select(F.spark_partition_id().alias("part"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("t")).mapInArrow(lambda x: _to_blocks(x, block_bytes), "block bigint, ids binary, sizes binary, data binary"), "blocks")

    def anchors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                yield _ask(Block(r.ids, r.sizes, r.data, length, buckets), r.block)

    rounds = min(ROUNDS, 1 + scan_bytes(docs) // ROUND_BYTES)
    turn = lambda df, key, i: df if rounds == 1 else df.where(F.pmod(F.xxhash64(key), F.lit(rounds)) == i)

    def in_turns(part: Callable[[int], DataFrame], tag: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [materialize(part(i), tag) for i in range(rounds)])

    sent = blocks.mapInPandas(anchors, "block bigint, bucket bigint, data binary, many binary, chunks binary")
    reply = materialize(sent.groupBy("bucket").applyInPandas(lambda g: _shared_anchors(g, hot_blocks), "block bigint, bucket bigint, data binary, chunks binary"), "replies")

    def candidates(mine: pd.DataFrame, reply: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in mine.itertuples():
            if len(reply):
                rows += _candidates(Block(r.ids, r.sizes, r.data, length, buckets), r.block, reply, length)
        return pd.DataFrame(rows, columns=["block", "bucket", "kind", "data"])

    schema = "block bigint, bucket bigint, kind int, data binary"
    strings = in_turns(lambda i: turn(blocks, "block", i).groupBy("block").cogroup(turn(reply, "block", i).groupBy("block")).applyInPandas(candidates, schema), "strings")
    settled = in_turns(lambda i: turn(strings.where("kind = 1"), "bucket", i).groupBy("bucket").applyInPandas(lambda g: _settle(g, length), schema), "settled")
    hot = strings.where("kind = 2").mapInPandas(lambda x: _hot_windows(x, length), "block bigint, place int, window binary, doc bigint")
    least = hot.groupBy("window").agg(F.min("doc").alias("least"))
    beaten = hot.join(least, "window").where("least < doc").groupBy("block").agg(F.collect_list("place").alias("places"))  # a block's own windows
    marks = strings.where("kind = 0").unionByName(settled).unionByName(materialize(beaten.mapInPandas(_hot_marks, schema), "hot"))

    def finish(mine: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        done = []
        for r in mine.itertuples():
            block = Block.__new__(Block)
            block.ids, block.ends = np.frombuffer(r.ids, np.int64), np.cumsum(np.frombuffer(r.sizes, np.int64))
            block.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(r.data, max_output_size=max(1, int(block.ends[-1]))), np.uint8)
            done.append(_report(block, _covered(block, marks, length), with_text))
        return pd.concat(done) if done else pd.DataFrame({c: [] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text)})

    out = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text
    return in_turns(lambda i: turn(blocks, "block", i).groupBy("block").cogroup(turn(marks, "block", i).groupBy("block")).applyInPandas(finish, out), "reports")
