"""Suffix dedup: bytes covered by a 200-byte string that starts anywhere else as well.

A start is covered when its suffix shares 200 bytes with a neighbour in the sorted order of
suffixes. Sorting every suffix of a large corpus moves each byte two hundred times; here
hashes first rule out the starts that can't be covered and propose, for the others, a
range of starts and the place it should be equal to. One suffix for each range, and one for its
counterpart, is then sorted, and only the merged order decides what is covered.

1. Of the 101 100-byte strings in a 200-byte string, the one of the least hash is its anchor.
   Equal 200-byte strings have equal anchors at the same place. Consecutive starts
   with one anchor are a run of at most 101. Anchors are counted in fragments; runs
   of those that occur once end here.
2. Pieces of text that hold several starts are classed by hash: whole runs first, then,
   of runs that share an anchor but are not all alike, blocks of ten starts, then, of
   blocks that share what all their strings have in common but are not all alike,
   single strings. A class with several members proposes each of them as equal to its first
   member; classes are counted by partial aggregation and end in joins that can be split, so a
   piece that a third of all documents hold is no task's burden.
3. Pieces that follow each other and are proposed as equal to pieces that follow each other are
   one range. Ranges are dealt to fragments by their document, each with its counterpart,
   so that many equal ranges meet in no one place.
4. Tasks send sorted runs of suffixes, front-coded: the length of the prefix shared with
   the one before, and the rest. A fragment merges them with a loser tree that carries
   those lengths along, so that bytes known to be equal are never compared again; with
   the merged order come the common prefixes of neighbours, and a suffix that shares n
   bytes with one covers its first n - 199 starts.

A text that has an exact copy, by SHA-256, is covered whole and takes part once.

Edge cases: null and empty texts have no bytes; texts under 200 bytes keep all; repeated
rows and copies remove each other whole, as every string also starts in the other; matches
never cross documents; very long texts are read in overlapping blocks; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bucketed, drop_bucketed, materialise, partitions, table, utf8, worker_cache
from tessera.llm.fragments import SEGMENTS, blob, distinct, frequencies, gathered, groups_of, names_column, sent
from tessera.llm.ngram_join import FRAGMENT_SHINGLES
from tessera.llm.rules import _finish

MATCH = 200
GRAM = 100
#: Starts of one block of a long text.
BLOCK = 1 << 20
#: Starts of a block of a run.
PIECE = 10
#: Bytes of suffixes that a task sorts before it sends them, and bytes of text for each fragment of the merge.
RUN_BYTES = 16 << 20
FRAGMENT_BYTES = 64 << 20

R = 0x9E3779B97F4A7C15


def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number per byte value, and powers of an odd base and of its inverse modulo 2^64; made once in a worker."""
    size, cache = BLOCK + 4 * MATCH, worker_cache()
    if (name := f"powers-{size}") not in cache:
        value = _finish((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
        up, down = np.full(size, R, np.uint64), np.full(size, pow(R, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        cache[name] = value, np.multiply.accumulate(up), np.multiply.accumulate(down)
    return cache[name]


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key of every ``width`` consecutive ones, by doubling."""
    have = 1
    while 2 * have <= width:
        keys = np.minimum(keys[:-have], keys[have:])
        have *= 2
    rest = width - have
    return np.minimum(keys[: len(keys) - rest], keys[rest:]) if rest else keys


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per run of starts: the anchor's hash, the stretch's hash and the packed place.

    A place holds the anchor's offset, and how far before it the run's first and last
    starts are, in 49, 7 and 7 bits.
    """
    raw = np.frombuffer(text, np.uint8)
    value, up, down = _powers()
    out = []
    for base in range(0, len(raw) - MATCH + 1, BLOCK):
        b = raw[base : base + BLOCK + MATCH - 1]
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(value[b] * up[: len(b)], out=sums[1:])
        n = len(b) - GRAM + 1
        h = _finish((sums[GRAM:] - sums[:n]) * down[:n])
        bits = np.uint64((1 << 21) - 1)
        least = _least((h & ~bits) | np.arange(n, dtype=np.uint64), MATCH - GRAM + 1)
        at = (least & bits).astype(np.int64)
        lo = np.nonzero(np.append(True, at[1:] != at[:-1]))[0]
        hi = np.append(lo[1:], len(at)) - 1
        at = at[lo]
        first, last = (at - lo).astype(np.uint64), (at - hi).astype(np.uint64)
        stretch = _finish((sums[hi + MATCH] - sums[lo]) * down[lo] + first * np.uint64(0xC2B2AE3D27D4EB4F) + last * np.uint64(0x165667B19E3779F9))
        # Least hashes are small; mixed once more they spread evenly over the fragments again.
        out.append((_finish(h[at] * np.uint64(0xD6E8FEB86659FD93)), stretch, (at + base) << 14 | (first.astype(np.int64) << 7) | last.astype(np.int64)))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _short(h: np.ndarray, fragments: int) -> np.ndarray:
    """What a fragment knows of a hash: its number and the low half."""
    frag = ((h >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)
    return ((frag << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))).astype(np.int64)


def _repeated_anchors(texts: DataFrame, fragments: int) -> DataFrame:
    """(_key, ids): the anchors of each distinct text that may occur again, as their short hashes."""

    def send(batches):
        def hashes():
            for batch in batches:
                column = batch.column("_utf8")
                for k in range(batch.num_rows):
                    text = column[k].as_py()
                    yield hashlib.sha256(text).digest()[:16], anchors(text)[0]

        yield from sent(hashes(), fragments, wide=False)

    names = ["bucket", "frag", "nodes", "counts", "ids"]

    def count(key, t):
        nodes, _, owner, grams = gathered(t, 2, wide=False)
        at = frequencies(grams) > 1
        owner, grams = owner[at], grams[at]
        order = np.argsort(owner, kind="stable")
        own, counts = np.unique(owner, return_counts=True)
        grams, ends = grams[order], np.cumsum(counts)
        bucket = (nodes[own, 0].view(np.uint64) % np.uint64(fragments)).astype(np.int64)
        by, starts, stops = groups_of(bucket)
        rows = []
        for a, b in zip(starts, stops, strict=True):
            which = by[a:b]
            ids = np.concatenate([grams[ends[k] - counts[k] : ends[k]] for k in which])
            rows.append((int(bucket[which[0]]), key[0].as_py(), nodes[own[which]].tobytes(), counts[which].astype(np.uint32).tobytes(), ids.tobytes()))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        return pa.table([pa.array(list(c), k) for c, k in zip(columns, [pa.int32()] * 2 + [pa.binary()] * 3, strict=True)], names)

    def list_up(t):
        each = [np.frombuffer(x.as_py(), np.uint32) for x in t.column("counts")]
        nodes, _, inverse = distinct(blob(t, "nodes", np.int64).reshape(-1, 2))
        high = np.repeat(t.column("frag").to_numpy().astype(np.int64), [int(c.sum()) for c in each])
        ids = high << 32 | blob(t, "ids", np.uint32).astype(np.int64)
        owner = np.repeat(inverse, np.concatenate(each))
        order, starts, ends = groups_of(owner)
        blobs = [ids[order[a:b]].tobytes() for a, b in zip(starts, ends, strict=True)]
        return pa.table([names_column(nodes), pa.array(blobs, pa.binary())], ["_key", "ids"])

    parts = texts.mapInArrow(send, SEGMENTS).groupBy("frag").applyInArrow(count, "bucket int, frag int, nodes binary, counts binary, ids binary")
    return parts.groupBy("bucket").applyInArrow(list_up, "_key binary, ids binary")


#: A piece: what its strings have in common, the whole of it, its text, and its packed place: the
#: anchor's offset, and how far before it the piece's first and last starts are.
PIECES = "c long, s long, key long, place long"


def _runs(affected: DataFrame, fragments: int) -> DataFrame:
    """The runs of the anchors that ``ids`` names, as pieces."""

    def run(batches):
        for batch in batches:
            out = []
            texts, lists = batch.column("_utf8"), batch.column("ids")
            for k, key in enumerate(batch.column("key").to_pylist()):
                h, sh, place = anchors(texts[k].as_py())
                at = np.isin(_short(h, fragments), np.frombuffer(lists[k].as_py(), np.int64))
                place = place[at]
                out.append((h[at].view(np.int64), sh[at].view(np.int64), np.full(len(place), key, np.int64), place))
            columns = [np.concatenate([np.zeros(0, np.int64), *c]) for c in (zip(*out, strict=True) if out else [()] * 4)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["c", "s", "key", "place"])

    return affected.mapInArrow(run, PIECES)


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor's offset, distance of the first start, of the last start)."""
    return place >> 14, place >> 7 & 127, place & 127


def blocks_of(raw: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """Cut runs of a text into blocks: columns c, s, place and size of the blocks, and the hashes of all their strings."""
    value, up, down = _powers()
    out = []
    anchor, far, near = unpacked(place)
    window = (anchor - far) // BLOCK
    for w in np.unique(window):
        here = window == w
        low = max(0, int(w) * BLOCK - MATCH)
        b = raw[low : int(w) * BLOCK + BLOCK + 2 * MATCH]
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(value[b] * up[: len(b)], out=sums[1:])

        def digest(x, y, low=low, sums=sums):
            return (sums[y - low] - sums[x - low]) * down[x - low]

        first, last = far[here], near[here]
        parts = first // PIECE - last // PIECE + 1
        run = np.repeat(np.arange(len(parts)), parts)
        j = first[run] // PIECE - (np.arange(len(run)) - np.repeat(np.cumsum(parts) - parts, parts))
        hi, lo, at = np.minimum(first[run], PIECE * j + PIECE - 1), np.maximum(last[run], PIECE * j), anchor[here][run]
        core = _finish(digest(at - PIECE * j, at - PIECE * j - PIECE + 1 + MATCH) + j.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        whole = _finish(digest(at - hi, at - lo + MATCH) + hi.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + lo.astype(np.uint64) * np.uint64(0x165667B19E3779F9))
        size = hi - lo + 1
        start = np.repeat(at - hi - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        out.append((core.view(np.int64), whole.view(np.int64), at << 14 | hi << 7 | lo, size, _finish(digest(start, start + MATCH)).view(np.int64)))
    return [np.concatenate([np.zeros(0, np.int64), *c]) for c in (zip(*out, strict=True) if out else [()] * 5)]


def _blocks(listed: DataFrame) -> DataFrame:
    """The listed runs of each text cut into blocks, with the hashes ``xs`` of a block's strings."""

    def run(batches):
        for batch in batches:
            texts, places, out, keys = batch.column("_utf8"), batch.column("places"), [], []
            for k, key in enumerate(batch.column("key").to_pylist()):
                out.append(blocks_of(np.frombuffer(texts[k].as_py(), np.uint8), np.sort(places[k].values.to_numpy())))
                keys.append(np.full(len(out[-1][0]), key, np.int64))
            if not out:
                continue
            c, s, place, size, xs = (np.concatenate(x) for x in zip(*out, strict=True))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(xs))
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(s), pa.array(np.concatenate(keys)), pa.array(place), lists], ["c", "s", "key", "place", "xs"])

    return listed.mapInArrow(run, PIECES + ", xs array<long>")


def _classed(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, place, rkey, rplace): each member of a class as equal to its first; and the first members of classes that share only what ``c`` says."""
    classes = materialise(pieces.groupBy("c", "s").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("key", "place")).alias("f")).select("c", "s", "m", "f.*"))
    # Both sides of these joins are written tables and nothing stands above them: only so can a hot class be split.
    several = materialise(classes.where("m > 1").select("c", "s", F.col("key").alias("rkey"), F.col("place").alias("rplace")))
    equal = materialise(pieces.join(several, ["c", "s"]).where("key <> rkey or place <> rplace").select("key", "place", "rkey", "rplace"))
    mixed = materialise(classes.groupBy("c").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).where("lo <> hi").select("c"))
    return equal, materialise(classes.join(mixed, "c").select("key", "place"))


def proposals(affected: DataFrame, fragments: int) -> DataFrame:
    """(key, place, rkey, rplace): a piece of a text that may be equal to another, in another text or the same."""
    runs = materialise(_runs(affected, fragments))
    equal, unlike = _classed(runs)
    listed = unlike.groupBy("key").agg(F.collect_list("place").alias("places"))
    blocks = materialise(_blocks(affected.select("key", "_utf8").join(listed, "key")))
    equal_blocks, unlike = _classed(blocks.drop("xs"))
    strings = blocks.select("key", "place", "xs").join(unlike, ["key", "place"])
    # A string is a piece of one start; its place names that start as if it were the anchor's.
    start = F.expr("(place >> 14) - ((place >> 7) & 127)")
    strings = materialise(strings.select("key", start.alias("a"), F.posexplode("xs").alias("i", "x")).select("x", "key", F.shiftleft(F.col("a") + F.col("i"), 14).alias("place")))
    firsts = strings.groupBy("x").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("key", "place")).alias("f")).where("m > 1")
    firsts = materialise(firsts.select("x", F.col("f.key").alias("rkey"), F.col("f.place").alias("rplace")))
    single = strings.join(firsts, "x").where("key <> rkey or place <> rplace").select("key", "place", "rkey", "rplace")
    return equal.union(equal_blocks).union(single)


def _ranges(proposed: DataFrame) -> DataFrame:
    """(key, a, len, rkey, ra): proposals that follow each other on both sides as one suffix of ``len`` bytes."""
    listed = proposed.groupBy("key").agg(F.collect_list(F.struct("place", "rkey", "rplace")).alias("l"))

    def run(batches):
        for batch in batches:
            lists = batch.column("l")
            rows = lists.flatten()
            if not len(rows):
                continue
            place, other, rplace = (rows.field(c).to_numpy() for c in ("place", "rkey", "rplace"))
            at, first, last = unpacked(place)
            a, n, there = at - first, first - last + 1, (rplace >> 14) - (rplace >> 7 & 127)
            keys = np.repeat(batch.column("key").to_numpy(), lists.value_lengths().to_numpy())
            order = np.lexsort((a, there - a, other, keys))
            keys, other, there, a, n = (x[order] for x in (keys, other, there, a, n))
            new = np.append(True, (keys[1:] != keys[:-1]) | (other[1:] != other[:-1]) | (there[1:] - a[1:] != there[:-1] - a[:-1]) | (a[1:] > a[:-1] + n[:-1]))
            start = np.nonzero(new)[0]
            size = np.maximum.reduceat(a + n, start) - a[start] + MATCH - 1
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[start], a[start], size, other[start], there[start])], ["key", "a", "len", "rkey", "ra"])

    return listed.mapInArrow(run, "key long, a long, len long, rkey long, ra long")


def common_prefix(a: bytes, b: bytes, n: int) -> int:
    """Length of the common prefix of a and b, of which n bytes are known to be equal."""
    end, step = min(len(a), len(b)), 32
    while n < end:
        m = min(step, end - n)
        if a[n : n + m] == b[n : n + m]:
            n, step = n + m, 2 * step
            continue
        while m > 32:
            half = m // 2
            if a[n : n + half] == b[n : n + half]:
                n, m = n + half, m - half
            else:
                m = half
        diff = int.from_bytes(a[n : n + m], "big") ^ int.from_bytes(b[n : n + m], "big")
        return n + m - (diff.bit_length() + 7) // 8
    return end


def front_code(sorted_suffixes: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Lengths shared with the suffix before, and what remains of each."""
    shared, rest, last = [], [], b""
    for s in sorted_suffixes:
        n = common_prefix(last, s, 0)
        shared.append(n)
        rest.append(s[n:])
        last = s
    return shared, rest


def merge_runs(runs: list[list[tuple[int, bytes, object]]]):
    """Merge front-coded sorted runs; yields (suffix, length shared with the one before, payload).

    A loser tree whose players carry the length of the prefix they share with the last
    winner: a longer one is the smaller suffix, without looking at a byte; only equal
    lengths are compared, from there on.
    """
    size = 1
    while size < max(1, len(runs)):
        size *= 2
    position = [0] * size
    suffix: list[bytes | None] = [None] * size
    known = [-1] * size

    def advance(p: int) -> None:
        i = position[p]
        if p >= len(runs) or i >= len(runs[p]):
            suffix[p], known[p] = None, -1
            return
        n, rest, _ = runs[p][i]
        suffix[p] = (suffix[p][:n] if suffix[p] else b"") + rest
        known[p] = n
        position[p] = i + 1

    def beats(p: int, q: int) -> bool:
        """Whether p goes before q; the loser's known length becomes that with the winner."""
        if known[p] != known[q]:
            return known[p] > known[q]
        if known[p] < 0:
            return True
        a, b = suffix[p], suffix[q]
        n = common_prefix(a, b, known[p])
        if n == len(a) or n < len(b) and a[n] < b[n]:
            known[q] = n
            return True
        known[p] = n
        return False

    for p in range(size):
        advance(p)
        known[p] = 0 if suffix[p] is not None else -1
    losers = [0] * size

    def play(node: int) -> int:
        if node >= size:
            return node - size
        left, right = play(2 * node), play(2 * node + 1)
        won, lost = (left, right) if beats(left, right) else (right, left)
        losers[node] = lost
        return won

    winner = play(1)
    while suffix[winner] is not None:
        yield suffix[winner], known[winner], runs[winner][position[winner] - 1][2]
        advance(winner)
        node = (winner + size) // 2
        while node:
            if not beats(winner, losers[node]):
                winner, losers[node] = losers[node], winner
            node //= 2


def _merged(affected: DataFrame, ranges: DataFrame, fragments: int) -> DataFrame:
    """(key, a, b): covered starts, from sorted runs of the ranges' suffixes and their counterparts, merged by fragment."""
    dealt = ranges.withColumn("frag", F.pmod(F.xxhash64("key"), F.lit(fragments)).cast("int"))
    there = dealt.select("frag", F.col("rkey").alias("key"), F.col("ra").alias("a"), "len")
    # A suffix that several ranges name takes part once in a fragment.
    once = dealt.select("frag", "key", "a", "len").union(there).groupBy("key", "frag", "a").agg(F.max("len").alias("len"))
    listed = affected.select("key", "_utf8").join(once.groupBy("key").agg(F.collect_list(F.struct("frag", "a", "len")).alias("suffixes")), "key")

    names = ["frag", "lengths", "rest", "owners"]

    def coded(pending):
        pending.sort(key=lambda x: x[:2])
        out, a = [], 0
        while a < len(pending):
            b = a
            while b < len(pending) and pending[b][0] == pending[a][0]:
                b += 1
            part = pending[a:b]
            shared, rest = front_code([x[1] for x in part])
            lengths = np.array([shared, [len(r) for r in rest]], np.uint64).T
            out.append((part[0][0], lengths.tobytes(), b"".join(rest), np.array([x[2:] for x in part], np.int64).tobytes()))
            a = b
        types = [pa.int32()] + [pa.binary()] * 3
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    def send(batches):
        pending, size = [], 0
        for batch in batches:
            texts, lists = batch.column("_utf8"), batch.column("suffixes")
            for k, key in enumerate(batch.column("key").to_pylist()):
                text = texts[k].as_py()
                own = lists[k].values
                for frag, a, n in zip(*(own.field(c).to_pylist() for c in ("frag", "a", "len")), strict=True):
                    pending.append((frag, text[a : a + n], key, a))
                    size += n + 100
                    if size >= RUN_BYTES:
                        yield coded(pending)
                        pending, size = [], 0
        if pending:
            yield coded(pending)

    def merge(t):
        runs = []
        for r in t.to_pylist():
            lengths = np.frombuffer(r["lengths"], np.uint64).reshape(-1, 2).tolist()
            owners = np.frombuffer(r["owners"], np.int64).reshape(-1, 2).tolist()
            run, i = [], 0
            for (shared, n), owner in zip(lengths, owners, strict=True):
                run.append((shared, r["rest"][i : i + n], owner))
                i += n
            runs.append(run)
        owners, shared = [], []
        for _, n, owner in merge_runs(runs):
            owners.append(owner)
            shared.append(n)
        owners, before = np.array(owners, np.int64).reshape(-1, 2), np.array(shared, np.int64)
        if len(before):
            before[0] = 0
        most = np.maximum(before, np.append(before[1:], 0)) if len(before) else before
        at = most >= MATCH
        return pa.table([pa.array(owners[at, 0]), pa.array(owners[at, 1]), pa.array(owners[at, 1] + most[at] - MATCH)], ["key", "a", "b"])

    return listed.mapInArrow(send, "frag int, lengths binary, rest binary, owners binary").groupBy("frag").applyInArrow(merge, "key long, a long, b long")


def _content(column: str = "_utf8"):
    """128 bits of a text's SHA-256."""
    return F.unhex(F.substring(F.sha2(column, 256), 1, 32))


def covered(docs: DataFrame, marks: DataFrame, *, text: str = "text", key: str = "doc_id", with_text: bool = False) -> DataFrame:
    """(_key, n_removed, n_spans, kept_sha256, kept) of the texts with covered starts, one of each content.

    ``marks`` are the documents' narrow rows (_id, _key, n_bytes). The texts concerned are joined
    with several lists of places; they are written once in buckets, so that only the lists move.
    """
    spark = docs.sparkSession
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(name(key).alias("_id"), utf8(text).alias("_utf8")).where(F.octet_length("_utf8") >= MATCH)
    total = marks.agg(F.sum("n_bytes")).first()[0] or 0
    fragments = max(partitions(spark), math.ceil(total / 50 / FRAGMENT_SHINGLES))
    repeated = _repeated_anchors(rows.select("_utf8"), fragments)
    # Of the rows of one content that of one id is read again, so that copies don't meet in one task.
    one = marks.groupBy("_key").agg(F.min(name("_id")).alias("_id"))
    affected = rows.withColumn("_key", _content()).join(repeated.join(one, "_key"), ["_key", "_id"]).dropDuplicates(["_key", "_id"])
    affected = affected.select("_key", "_utf8", "ids").withColumn("key", F.monotonically_increasing_id())
    name = f"suffix_dedup_{uuid.uuid4().hex}"
    affected = bucketed(affected, "key", partitions(spark), name)
    ranges = materialise(_ranges(proposals(affected, fragments)))
    starts = _merged(affected, ranges, max(partitions(spark), math.ceil(total / FRAGMENT_BYTES)))
    per_text = starts.groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("starts"))
    cut = materialise(_cut(affected.select("_key", "key", "_utf8").join(per_text, "key").drop("key"), with_text))
    drop_bucketed(spark, name)
    return cut


def spans_of(starts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal removed runs [from, to) of covered starts."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(starts):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b + MATCH))
        else:
            out.append((a, b + MATCH))
    return out


def _cut(found: DataFrame, with_text: bool) -> DataFrame:
    """(_key, n_removed, n_spans, kept_sha256) of affected texts, with the kept bytes if asked for."""
    names = ["_key", "n_removed", "n_spans", "kept_sha256", "kept"]

    def run(batches):
        for batch in batches:
            out, texts, lists = [], batch.column("_utf8"), batch.column("starts").to_pylist()
            for k, key in enumerate(batch.column("_key").to_pylist()):
                text, last, kept = texts[k].as_py(), 0, []
                spans = spans_of([(s["a"], s["b"]) for s in lists[k]])
                for a, b in spans:
                    kept.append(text[last:a])
                    last = b
                kept = b"".join([*kept, text[last:]])
                out.append((key, len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            types = [pa.binary()] + [pa.int64()] * 2 + [pa.string(), pa.binary()]
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

    return found.mapInArrow(run, "_key binary, n_removed long, n_spans long, kept_sha256 string, kept binary")


def dedup(docs: DataFrame, *, text: str = "text", key: str = "doc_id", with_text: bool = False) -> DataFrame:
    """Per document: its key, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes of changed texts."""
    raw = utf8(text)
    marks = materialise(docs.select(F.col(key).alias("_id"), F.octet_length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("_sha")))
    marks = marks.withColumn("_key", F.unhex(F.substring("_sha", 1, 32)))
    copies = marks.where(F.col("n_bytes") >= MATCH).groupBy("_sha").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_sha", F.lit(True).alias("_copied"))
    copies = materialise(copies)
    cut = covered(docs, marks, text=text, key=key, with_text=with_text)
    out = marks.join(cut, "_key", "left").join(copies, "_sha", "left")
    gone, zero = F.col("_copied").isNotNull(), F.lit(0).cast("long")
    columns = [
        F.col("_id").alias(key),
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(gone, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "_sha")).alias("kept_sha256"),
    ]
    return out.select(*columns, *([F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if with_text else []))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Bytes as pairs of hexadecimal digits; every 200-byte string is counted.
ORACLE = """
WITH d AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n, lower(hex(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 400)) AS g FROM (SELECT doc_id, h, unnest(range(n - 199)) AS i FROM d WHERE n >= 200)),
again AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1),
starts AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM g SEMI JOIN again ON g.g = again.g),
runs AS (SELECT doc_id, i, sum(CASE WHEN i <= before + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM starts),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS b FROM runs GROUP BY doc_id, run),
cuts AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS last FROM spans),
kept AS (
  SELECT c.doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS rest
  FROM cuts c JOIN d ON d.doc_id = c.doc_id GROUP BY c.doc_id
)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
