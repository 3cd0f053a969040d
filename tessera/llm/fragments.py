"""Sets of hashes cut by ranges of the hash: segments, one packed row per task and fragment.

A fragment is complete for its range, so whatever is counted per hash is counted there.
What it says about nodes goes back packed as well, by bucket of the node, so that the
rows of an intermediate table follow the tasks and not nodes times fragments.

A node is named by one or two 64-bit words: two (a 128-bit hash) as long as nodes are
told apart by content and their first halves don't do it, else one (that half, or a
number once they have been counted).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SEGMENTS = "frag int, nodes binary, sizes binary, counts binary, grams binary"
#: Hashes that a task collects before it sends segments.
FLUSH = 1_500_000


def fragment_of(grams: np.ndarray, fragments: int) -> np.ndarray:
    return (((grams >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)).astype(np.int64)


def groups_of(keys: np.ndarray):
    """(order, starts, ends): a stable order by key and where each key's rows stand in it."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    starts = np.nonzero(np.append(True, s[1:] != s[:-1]))[0] if len(s) else np.zeros(0, np.int64)
    return order, starts, np.append(starts[1:], len(s)) if len(s) else starts


def _rows(columns: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = [pa.int32()] + [pa.binary()] * (len(names) - 1)
    columns = columns or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)


def segments(pending: list[tuple[bytes, np.ndarray]], fragments: int, wide: bool) -> pa.RecordBatch:
    """One row per fragment from (node, hashes): the nodes, their sets' sizes (if wide), how many hashes each has there, and these."""
    sizes = np.array([len(s) for _, s in pending], np.uint32)
    grams = np.concatenate([s for _, s in pending])
    owner = np.repeat(np.arange(len(pending)), sizes)
    nodes = np.frombuffer(b"".join(n for n, _ in pending), np.int64).reshape(len(pending), -1)
    frag = fragment_of(grams, fragments)
    order, starts, ends = groups_of(frag)
    rows = []
    for a, b in zip(starts, ends, strict=True):
        at = order[a:b]
        own, counts = np.unique(owner[at], return_counts=True)
        part = grams[at] if wide else grams[at].astype(np.uint32)
        rows.append((int(frag[at[0]]), nodes[own].tobytes(), sizes[own].tobytes() if wide else b"", counts.astype(np.uint32).tobytes(), part.tobytes()))
    return _rows(list(zip(*rows, strict=True)), ["frag", "nodes", "sizes", "counts", "grams"])


def sent(sets, fragments: int, wide: bool):
    """Segments of an iterator of (node, hashes); a node is sent once per task, one without hashes not at all."""
    seen, pending, size = set(), [], 0
    for node, s in sets:
        if not len(s) or node in seen:
            continue
        seen.add(node)
        pending.append((node, s))
        size += len(s)
        if size >= FLUSH:
            yield segments(pending, fragments, wide)
            pending, size = [], 0
    if pending:
        yield segments(pending, fragments, wide)


def blob(t: pa.Table, column: str, kind) -> np.ndarray:
    """The packed values of a column of blobs, one after the other."""
    return np.frombuffer(b"".join(x.as_py() for x in t.column(column)), kind)


def distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct rows of a two-dimensional array, the first place of each, and per row its place among them."""
    order = np.lexsort(ids.T[::-1])
    s = ids[order]
    new = np.append(True, (s[1:] != s[:-1]).any(axis=1)) if len(s) else np.zeros(0, bool)
    inverse = np.empty(len(s), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return s[new], order[new], inverse


def gathered(t: pa.Table, words: int, wide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct nodes of a fragment with their sets' sizes (if wide), and per hash its node's place among them and its value."""
    nodes = blob(t, "nodes", np.int64).reshape(-1, words)
    sizes, counts = blob(t, "sizes", np.uint32).astype(np.int64), blob(t, "counts", np.uint32).astype(np.int64)
    grams = blob(t, "grams", np.uint64 if wide else np.uint32)
    names, first, inverse = distinct(nodes)
    is_first = np.zeros(len(nodes), bool)
    is_first[first] = True
    keep = np.repeat(is_first, counts)
    return names, sizes[first] if wide else sizes, np.repeat(inverse, counts)[keep], grams[keep]


def frequencies(grams: np.ndarray) -> np.ndarray:
    """Per hash, in how many of the fragment's nodes it occurs."""
    order = np.argsort(grams)
    s = grams[order]
    cut = np.nonzero(np.append(True, s[1:] != s[:-1]))[0] if len(s) else np.zeros(0, np.int64)
    n = np.diff(np.append(cut, len(s)))
    out = np.empty(len(s), np.int64)
    out[order] = np.repeat(n, n)
    return out


def packed(nodes: np.ndarray, columns: dict[str, np.ndarray], buckets: int) -> pa.Table:
    """Rows (bucket, nodes, columns...): what a fragment found out about nodes, one row per bucket of them."""
    bucket = (nodes[:, 0].view(np.uint64) % np.uint64(buckets)).astype(np.int64) if len(nodes) else np.zeros(0, np.int64)
    order, starts, ends = groups_of(bucket)
    rows = [(int(bucket[order[a]]), nodes[order[a:b]].tobytes(), *(c[order[a:b]].astype(np.int64).tobytes() for c in columns.values())) for a, b in zip(starts, ends, strict=True)]
    return pa.Table.from_batches([_rows(list(zip(*rows, strict=True)), ["bucket", "nodes", *columns])])


def packed_schema(*columns: str) -> str:
    return "bucket int, nodes binary, " + ", ".join(f"{c} binary" for c in columns)


def names_column(nodes: np.ndarray) -> pa.Array:
    """Node names as a column of binaries."""
    raw, width = np.ascontiguousarray(nodes).tobytes(), 8 * nodes.shape[1]
    offsets = (np.arange(len(nodes) + 1) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(nodes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)])
