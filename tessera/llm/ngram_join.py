"""N-gram Jaccard self-join by vertical partitioning, and its connected components.

A document is the set of its distinct five-word shingles as 64-bit hashes. Equal sets
(by a 128-bit hash) are one node. The order of all n-grams is cut into fragments; every
node sends each fragment only its segment there, so no task ever holds whole sets, and
the postings of an n-gram are complete within its fragment:

1. Fragments find n-grams that occur in one node only. Those can't be shared, so a
   node needs ceil(0.75 n) others; most nodes of a corpus end here.
2. Among the remaining nodes the fragments count document frequencies by powers of
   two; the global order is by that class, then by fragment. What of a node's set
   remains from a place of that order on bounds the overlap of a pair whose first common
   n-gram stands there; a node's prefix are the n-grams whose bound is enough to link.
3. Nodes that share a prefix n-gram are compared with a few hubs of their postings, not
   all with all. A pair's overlap is counted separately in every fragment and the
   partial counts are summed; links join components. What is left are pairs across
   different components with a common prefix n-gram. Their common prefix n-grams are added up
   as well, in batches of a bounded number of pairs for each posting, and the overlaps of
   those are counted that neither the bounds nor that sum rules out.

A pair is skipped only when it is already in one component, or its lengths, the bound
at its first common n-gram or the count of its common prefix n-grams rule a link out, so the
components are exactly those of all links. Partial counts travel packed by fragment and bucket of pairs, and a node's
partners with the node that proposed them.

Edge cases: null and wordless texts have an empty set and are their own component;
texts of fewer than five words have one shingle, the whole sequence; very long texts
are sets like any other, in segments; copies share a node, whatever their number; a
null id is never the smallest; ids that repeat with different texts are rows of
different components; an empty table gives no rows; extra columns are ignored by
``classes`` and kept by ``keep_one``.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bucketed, drop_bucketed, masked, materialise, partitions, table, utf8
from tessera.llm.fragments import SEGMENTS, blob, distinct, fragment_of, frequencies, gathered, groups_of, names_column, packed, packed_schema, sent
from tessera.llm.rules import MIX, _finish, word_hashes
from tessera.operators.graph import components

WIDTH = 5
PERCENT = 75
#: Shingles that one fragment should hold, on average, and the least numbers of fragments of a
#: corpus and of the sets that remain. Fragments follow the data, not the cluster. In a large corpus
#: nearly every shingle of a fragment is of another node, so this bounds a fragment's nodes as well.
FRAGMENT_SHINGLES = 2_000_000
LEAST_FRAGMENTS, LEAST_LEFT = 32, 16
#: Rows of an intermediate table that one partition should hold.
PART_ROWS = 25_000
#: Rounds through hubs at most, and hubs that a node is compared with in a round. They end when a round
#: links fewer than one in so many nodes, or few pairs are left for each posting.
STAR_ROUNDS = 5
HUBS = 4
FEW_LINKED, FEW_LEFT = 100, 8
#: Pairs for each posting that a batch of the remaining ones goes through at most.
PAIRS_PER_POSTING = 200
#: Pairs that a task of a batch adds up at most, on average.
PAIRS_PER_TASK = 4_000_000
#: Nodes of one gram that meet in one place; longer postings are cut, and every two blocks meet.
MEETING = 2_000
#: Sets that a task rebuilds at once.
REBUILT = 500
#: Bits for each document whose set is rebuilt, and at most, of the filter that the others don't pass; Spark's bitmaps hold so many.
BITS_EACH, MOST_BITS, BITMAP = 32, 1 << 26, 1 << 15
#: Lists that the partners of a node are dealt to in a batch.
LISTS = 16
#: Pairs that a task holds before it adds up what it has of each.
FLUSH_MEETINGS = 4_000_000


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    n = len(h) - width + 1
    if n < 1:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    s = h[:n].copy()
    for k in range(1, width):
        s = s * MIX + h[k : k + n]
    return np.unique(_finish(s))


def node_of(s: np.ndarray) -> bytes | None:
    """A set's identity: a 128-bit hash of its sorted shingles."""
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def signed(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` with the set's size ``_n`` and ``_node`` (null for the empty set)."""
    source = docs.select(*keep, utf8(text).alias("_utf8"))
    schema = source.drop("_utf8").withColumn("_n", F.lit(0).cast("long")).withColumn("_node", F.lit(None).cast("binary")).schema

    def run(batches):
        for batch in batches:
            found = [(len(s), node_of(s)) for s in (shingles(text.as_py()) for text in batch.column("_utf8"))]
            arrays = [*(batch.column(c) for c in keep), pa.array([n for n, _ in found], pa.int64()), pa.array([node for _, node in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "_n", "_node"])

    return source.mapInArrow(run, schema)


def _need(n, percent: int):
    """Shingles that a set of n shares with any set it links to."""
    return -(-n * percent // 100)


def link_overlap(n, percent: int):
    """The least overlap of two linked sets of n shingles together, in numbers or SQL columns."""
    if isinstance(n, (int, np.ndarray)):
        return -(-n * percent // (100 + percent))
    return F.ceil(n * percent / F.lit(100 + percent)).cast("long")


def shared_nodes(docs: DataFrame, text: str, fragments: int, words: int = 2) -> DataFrame:
    """(name, shared): of how many of a node's shingles another node may have one too; narrow hashes can only raise the count.

    A node is named by the first ``words`` 64-bit words of its hash, by one only where that tells all nodes apart.
    """
    source = docs.select(utf8(text).alias("_utf8"))

    def send(batches):
        def sets():
            for batch in batches:
                texts = batch.column("_utf8")
                for k in range(batch.num_rows):
                    s = shingles(texts[k].as_py())
                    yield (node_of(s) or b"")[: 8 * words], s

        yield from sent(sets(), fragments, wide=False)

    def count(t):
        nodes, _, owner, grams = gathered(t, words, wide=False)
        n = np.bincount(owner[frequencies(grams) > 1], minlength=len(nodes))
        return packed(nodes[n > 0], {"parts": n[n > 0]}, fragments)

    def total(t):
        nodes, _, inverse = distinct(blob(t, "nodes", np.int64).reshape(-1, words))
        shared = np.bincount(inverse, weights=blob(t, "parts", np.int64), minlength=len(nodes)).astype(np.int64)
        return pa.table([names_column(nodes), pa.array(shared)], ["name", "shared"])

    parts = source.mapInArrow(send, SEGMENTS).groupBy("frag").applyInArrow(count, packed_schema("parts"))
    return parts.groupBy("bucket").applyInArrow(total, "name binary, shared long")


def _of(node: int) -> bytes:
    return int(node).to_bytes(8, "little", signed=True)


def _sets_of(batch: pa.RecordBatch):
    grams = batch.column("grams")
    for k, node in enumerate(batch.column("node").to_pylist()):
        yield _of(node), np.frombuffer(grams[k].as_py(), np.uint64)


def prefixes(sets: DataFrame, fragments: int, percent: int) -> DataFrame:
    """(node, n, rest, places, remains): the places of a node's prefix in the global order, how many shared grams it has from each on, and after them.

    The order is by frequency class, then by fragment, that is, by range of the hashes; grams of one node only come first.
    """

    def send(batches):
        for batch in batches:
            yield from sent(_sets_of(batch), fragments, wide=True)

    def classes(key, t):
        nodes, sizes, owner, grams = gathered(t, 1, wide=True)
        f = frequencies(grams)
        at = f > 1
        both, n = np.unique(owner[at] * 64 + np.log2(f[at]).astype(np.int64), return_counts=True)
        own = both // 64
        return packed(nodes[own], {"sizes": sizes[own], "places": both % 64 * fragments + key[0].as_py(), "parts": n}, fragments)

    def rank(t):
        nodes, first, owner = distinct(blob(t, "nodes", np.int64).reshape(-1, 1))
        sizes, places, n = blob(t, "sizes", np.int64)[first], blob(t, "places", np.int64), blob(t, "parts", np.int64)
        order = np.lexsort((places, owner))
        owner, places, n = owner[order], places[order], n[order]
        # From each place on: what the node has there and later.
        upto = np.cumsum(n)
        last = np.append(np.searchsorted(owner, np.arange(1, len(nodes))), len(owner)) - 1
        remains = upto[last][owner] - upto + n if len(owner) else n
        at = remains >= _need(sizes, percent)[owner]
        owner, places, remains, n = owner[at], places[at], remains[at], n[at]
        _, starts, ends = groups_of(owner)
        own = owner[starts]
        rest = (remains - n)[ends - 1] if len(own) else n
        blobs = [[x[a:b].tobytes() for a, b in zip(starts, ends, strict=True)] for x in (places, remains)]
        return pa.table([pa.array(nodes[own, 0]), pa.array(sizes[own]), pa.array(rest), *(pa.array(b, pa.binary()) for b in blobs)], ["node", "n", "rest", "places", "remains"])

    rows = sets.select("node", "grams").mapInArrow(send, SEGMENTS).groupBy("frag").applyInArrow(classes, packed_schema("sizes", "places", "parts"))
    return rows.groupBy("bucket").applyInArrow(rank, "node long, n long, rest long, places binary, remains binary")


def _postings(sets: DataFrame, ranked: DataFrame, fragments: int) -> DataFrame:
    """(gram, node, n, rem, rest) for every prefix gram that two nodes or more have in their prefixes."""
    marked = sets.select("node", "grams").join(ranked.select("node", "places", "remains"), "node", "left")

    def send(batches):
        for batch in batches:
            own, places, remains = [], [], []
            for node, p, r in zip(*(batch.column(c).to_pylist() for c in ("node", "places", "remains")), strict=True):
                if p is not None:
                    places.append(np.frombuffer(p, np.int64))
                    remains.append(np.frombuffer(r, np.int64))
                    own.append(np.full(len(places[-1]), node))
            own, places, remains = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (own, places, remains))
            frag = places % fragments
            for out in sent(_sets_of(batch), fragments, wide=True):
                here = [frag == f for f in out.column("frag").to_pylist()]
                more = [pa.array([x[h].tobytes() for h in here], pa.binary()) for x in (own, places // fragments, remains)]
                yield pa.RecordBatch.from_arrays([*out.columns, *more], [*out.schema.names, "own", "levels", "remains"])

    def post(t):
        nodes, sizes, owner, grams = gathered(t, 1, wide=True)
        f = frequencies(grams)
        at = f > 1
        owner, grams, level = owner[at], grams[at], np.log2(f[at]).astype(np.int64)
        known, first = np.unique(np.searchsorted(nodes[:, 0], blob(t, "own", np.int64)) * 64 + blob(t, "levels", np.int64), return_index=True)
        remains, code = blob(t, "remains", np.int64)[first], owner * 64 + level
        if not len(known):
            known, remains = np.array([-1]), np.array([0])
        at = np.minimum(np.searchsorted(known, code), len(known) - 1)
        hit = known[at] == code
        owner, grams, rem = owner[hit], grams[hit], remains[at[hit]]
        hit = frequencies(grams) > 1
        own = owner[hit]
        return pa.table([pa.array(grams[hit].view(np.int64)), pa.array(nodes[own, 0]), pa.array(sizes[own]), pa.array(rem[hit])], ["gram", "node", "n", "rem"])

    rows = marked.mapInArrow(send, SEGMENTS + ", own binary, levels binary, remains binary")
    found = rows.groupBy("frag").applyInArrow(post, "gram long, node long, n long, rem long")
    return found.join(ranked.select("node", "rest"), "node").select("gram", "node", "n", "rem", "rest")


def partial_overlaps(owner: np.ndarray, grams: np.ndarray, left: np.ndarray, right: np.ndarray, nodes: int) -> np.ndarray:
    """How many grams each pair of places (left, right) among the fragment's nodes has in common there."""
    values, gram = np.unique(grams, return_inverse=True)
    code = np.sort(owner * len(values) + gram)
    start = np.searchsorted(code, np.arange(nodes + 1) * len(values))
    sizes = np.diff(start)
    swap = sizes[left] > sizes[right]
    left, right = np.where(swap, right, left), np.where(swap, left, right)
    out, a = np.zeros(len(left), np.int64), 0
    upto = np.cumsum(sizes[left])
    while a < len(left):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + FLUSH_PAIRS)))
        n = sizes[left[a:b]]
        pair = np.repeat(np.arange(a, b), n)
        within = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        wanted = code[start[left[pair]] + within] + (right[pair] - left[pair]) * len(values)
        at = np.minimum(np.searchsorted(code, wanted), len(code) - 1)
        out[a:b] = np.bincount(pair[code[at] == wanted] - a, minlength=b - a)
        a = b
    return out


#: Grams of pairs that are looked up at once.
FLUSH_PAIRS = 2_000_000


def links(sets: DataFrame, pairs: DataFrame, fragments: int, buckets: int, lists: int = 1) -> DataFrame:
    """The pairs (a, b, need) whose overlap, summed from every fragment's partial count, reaches what they need.

    Every node of a pair sends its segments; the partners of a go with a's.
    """
    partners = pairs.groupBy(F.col("a").alias("node"), F.pmod(F.xxhash64("b"), F.lit(lists)).alias("_list")).agg(F.collect_list(F.struct("b", "need")).alias("others"))
    hubs = pairs.select(F.col("b").alias("node")).distinct().withColumn("others", F.array().cast(partners.schema["others"].dataType))
    rows = sets.select("node", "grams").join(partners.select("node", "others").union(hubs), "node")

    def send(batches):
        for batch in batches:
            listed = batch.column("others")
            other, need = (x.to_numpy() for x in listed.flatten().flatten())
            own = np.repeat(batch.column("node").to_numpy(), listed.value_lengths().to_numpy())
            order = np.argsort(own, kind="stable")
            own, other, need = own[order], other[order], need[order]
            for out in sent(_sets_of(batch), fragments, wide=True):
                more = [[], [], []]
                for x in out.column("nodes"):
                    nodes = np.frombuffer(x.as_py(), np.int64)
                    at = np.isin(own, nodes)
                    for m, c in zip(more, (own, other, need), strict=True):
                        m.append(c[at].tobytes())
                yield pa.RecordBatch.from_arrays([*out.columns, *(pa.array(m, pa.binary()) for m in more)], [*out.schema.names, "lefts", "rights", "needs"])

    def count(t):
        nodes, _, owner, grams = gathered(t, 1, wide=True)
        nodes = nodes[:, 0]
        pair = np.stack([blob(t, c, np.int64) for c in ("lefts", "rights", "needs")], axis=1)
        pair = distinct(pair)[0]
        pair = pair[np.isin(pair[:, 1], nodes)]
        n = partial_overlaps(owner, grams, np.searchsorted(nodes, pair[:, 0]), np.searchsorted(nodes, pair[:, 1]), len(nodes))
        pair, n = pair[n > 0], n[n > 0]
        return packed(pair[:, :1], {"others": pair[:, 1], "needs": pair[:, 2], "parts": n}, buckets)

    def total(t):
        pair, first, inverse = distinct(np.stack([blob(t, c, np.int64) for c in ("nodes", "others")], axis=1))
        n = np.bincount(inverse, weights=blob(t, "parts", np.int64), minlength=len(pair))
        pair = pair[n >= blob(t, "needs", np.int64)[first]]
        return pa.table([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    parts = rows.mapInArrow(send, SEGMENTS + ", lefts binary, rights binary, needs binary").groupBy("frag").applyInArrow(count, packed_schema("others", "needs", "parts"))
    return parts.groupBy("bucket").applyInArrow(total, "a long, b long")


def _is_smaller(percent: int):
    """Whether what remains of a set from a posting on allows a link with a set that is no smaller."""
    return F.col("rem") >= link_overlap(2 * F.col("n"), percent)


def _across(postings: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The postings with each node's component, of those grams that nodes of different components share."""
    known = postings.withColumn("comp", F.col("node")) if labels is None else postings.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = known.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("gram")
    return known.join(materialise(mixed), "gram", "left_semi")


def _possible(percent: int):
    """Whether sizes and bounds at a common gram allow a link of (node, n, rem) and (hub, hub_n, hub_rem)."""
    close = 100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")
    return close & (F.least("rem", "hub_rem") >= link_overlap(F.col("n") + F.col("hub_n"), percent))


def _pairs(met: DataFrame, tried: DataFrame | None, percent: int) -> DataFrame:
    """(node, hub, need, votes) of the possible pairs met, without those that were counted before."""
    votes = met.where(_possible(percent)).groupBy("node", "hub").agg(F.count(F.lit(1)).alias("votes"), F.first(link_overlap(F.col("n") + F.col("hub_n"), percent)).alias("need"))
    if tried is None:
        return votes
    keyed = votes.withColumns({"lo": F.least("node", "hub"), "hi": F.greatest("node", "hub")})
    return keyed.join(tried.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")), ["lo", "hi"], "left_anti").drop("lo", "hi")


def _proposals(known: DataFrame, tried: DataFrame | None, percent: int, round_: int) -> DataFrame:
    """For each node the few hubs, of other components, that it shares most prefix grams with.

    The hubs of a gram are two of its smaller sets that a hash of the round draws, so that a node
    that didn't link to one member of a large component meets others in the next round.
    """
    hub = F.when(_is_smaller(percent), F.struct(F.xxhash64("node", F.lit(round_)).alias("d"), "comp", "node", "n", "rem"))
    ends = known.groupBy("gram").agg(F.min(hub).alias("lo"), F.max(hub).alias("hi"))
    other = F.when(F.col("comp") != F.col("lo.comp"), F.col("lo")).when(F.col("comp") != F.col("hi.comp"), F.col("hi"))
    met = known.join(materialise(ends), "gram").withColumn("_h", other).where("_h is not null")
    met = met.select("node", "n", "rem", F.col("_h.node").alias("hub"), F.col("_h.n").alias("hub_n"), F.col("_h.rem").alias("hub_rem"))
    # A node has no more hubs than prefix grams, so these lists don't grow with the corpus.
    listed = _pairs(met, tried, percent).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("votes", "hub", "need")), asc=False).alias("l"))
    return listed.select("node", F.explode(F.slice("l", 1, HUBS)).alias("x")).select(F.col("node").alias("a"), F.col("x.hub").alias("b"), F.col("x.need").alias("need"))


def _pairs_left(known: DataFrame, percent: int) -> int:
    """How many pairs across components the postings hold, a smaller set's with any other, from counts alone."""
    each = known.groupBy("gram", "comp").agg(F.count(F.lit(1)).alias("k"), F.count_if(_is_smaller(percent)).alias("s"))
    sizes = each.groupBy("gram").agg(F.sum("k").alias("k"), F.sum("s").alias("s"), F.sum(F.col("k") * F.col("s")).alias("q"))
    return int(sizes.agg(F.sum(F.col("k") * F.col("s") - F.col("q"))).first()[0] or 0)


def _fold(pairs: np.ndarray, votes: np.ndarray, able: np.ndarray, needs: np.ndarray):
    """One row per pair: what was counted of it, added up."""
    names, first, inverse = distinct(pairs)
    size = len(names)
    return names, np.bincount(inverse, votes, size).astype(np.int64), np.bincount(inverse, able, size).astype(np.int64), needs[first]


def meetings(gram, node, n, rem, rest, comp, left, percent: int, batches: int, number: int):
    """(pairs, votes, able, needs) of the pairs of nodes that meet at the grams: how often, and at how many of them bounds allow a link.

    ``left`` is 0 for a block that meets itself, else 1 and 2 for the two that meet. ``needs`` are the least votes of
    a linked pair: what its overlap lacks when all that remains after the prefix is common, for the set that has more.
    """
    order = np.lexsort((node, gram))
    gram, node, n, rem, rest, comp, left = (x[order] for x in (gram, node, n, rem, rest, comp, left))
    _, starts, ends = groups_of(gram)
    held, kept, size = [], [], 0

    def add():
        parts = [np.concatenate(c) for c in zip(*held, strict=True)]
        held.clear()
        kept.append(_fold(*parts))

    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        for c in range(a, b, MEETING):
            i, j = np.arange(c, min(b, c + MEETING))[:, None], np.arange(a, b)[None, :]
            meet = (comp[i] != comp[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
            meet &= np.where(left[i] == 0, node[i] < node[j], left[i] < left[j])
            x, y = np.nonzero(meet)
            x, y = x + c, y + a
            lo, hi = np.minimum(node[x], node[y]), np.maximum(node[x], node[y])
            if batches > 1:
                here = _finish(lo.astype(np.uint64) * MIX + hi.astype(np.uint64)) % np.uint64(batches) == number
                x, y, lo, hi = x[here], y[here], lo[here], hi[here]
            need = link_overlap(n[x] + n[y], percent)
            held.append((np.stack([lo, hi], axis=1), np.ones(len(lo)), np.minimum(rem[x], rem[y]) >= need, need - np.maximum(rest[x], rest[y])))
            size += len(lo)
            if size >= FLUSH_MEETINGS:
                add()
                size = 0
    if held:
        add()
    if not kept:
        return np.zeros((0, 2), np.int64), *[np.zeros(0, np.int64)] * 3
    return _fold(*[np.concatenate(c) for c in zip(*kept, strict=True)])


def _batch(known: DataFrame, tried: DataFrame | None, percent: int, parts: int, batches: int, number: int) -> DataFrame:
    """(a, b, need) of a batch of the pairs that are left: across components, and neither their bounds nor their common prefix n-grams rule a link out.

    All common n-grams of two prefixes are counted; where one prefix ends no more than what remains of
    that set can be added to the count. Which node carries a pair is dealt, so that none carries all of its partners.
    """
    sizes = known.groupBy("gram").agg(F.ceil(F.count(F.lit(1)) / MEETING).cast("int").alias("_s"))
    cut = known.join(materialise(sizes), "gram").withColumn("_p", F.pmod(F.xxhash64("node"), F.col("_s")).cast("int"))
    cut = cut.withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_s") - 1)))
    side = F.when(F.col("_p") == F.col("_q"), 0).when(F.col("_p") < F.col("_q"), 1).otherwise(2)
    place = F.xxhash64("gram", F.least("_p", "_q"), F.greatest("_p", "_q"))
    rows = cut.select(F.pmod(place, F.lit(parts)).cast("int").alias("part"), place.alias("gram"), "node", "n", "rem", "rest", "comp", side.alias("side"))

    def meet(t):
        columns = [t.column(c).to_numpy().astype(np.int64) for c in ("gram", "node", "n", "rem", "rest", "comp", "side")]
        pairs, votes, able, needs = meetings(*columns, percent, batches, number)
        return packed(pairs[:, :1], {"others": pairs[:, 1], "votes": votes, "able": able, "needs": needs}, parts)

    def total(t):
        pairs = np.stack([blob(t, c, np.int64) for c in ("nodes", "others")], axis=1)
        pairs, votes, able, needs = _fold(pairs, blob(t, "votes", np.int64), blob(t, "able", np.int64), blob(t, "needs", np.int64))
        at = (able > 0) & (votes >= needs)
        pairs = pairs[at]
        turned = (pairs[:, 0] ^ pairs[:, 1]) % 2 == 0
        return pa.table([pa.array(np.where(turned, pairs[:, 1], pairs[:, 0])), pa.array(np.where(turned, pairs[:, 0], pairs[:, 1]))], ["node", "hub"])

    found = rows.groupBy("part").applyInArrow(meet, packed_schema("others", "votes", "able", "needs")).groupBy("bucket").applyInArrow(total, "node long, hub long")
    found = materialise(found)
    if tried is not None:
        keyed = found.withColumns({"lo": F.least("node", "hub"), "hi": F.greatest("node", "hub")})
        found = keyed.join(tried.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")), ["lo", "hi"], "left_anti").select("node", "hub")
    sizes = known.select("node", "n").distinct()
    found = found.join(sizes, "node").join(sizes.select(F.col("node").alias("hub"), F.col("n").alias("hub_n")), "hub")
    return found.select(F.col("node").alias("a"), F.col("hub").alias("b"), link_overlap(F.col("n") + F.col("hub_n"), percent).alias("need"))


def _joined(labels: DataFrame | None, new: DataFrame) -> DataFrame:
    """(node, comp) after the links (a, b): only the links between components are followed."""
    if labels is None:
        return components(new, part_rows=PART_ROWS)
    name = lambda side: labels.select(F.col("node").alias(side), F.col("comp").alias(f"{side}_comp"))
    between = new.join(name("a"), "a", "left").join(name("b"), "b", "left")
    between = between.select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b")).where("a <> b").distinct()
    merged = components(between, part_rows=PART_ROWS)
    moved = labels.join(merged.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    fresh = merged.join(labels, "node", "left_anti").select("node", "comp")
    return materialise(moved.union(fresh).coalesce(max(1, labels.rdd.getNumPartitions())))


def name_words(marks: DataFrame) -> int:
    """How many 64-bit words of their hashes tell the nodes apart: one, or two if two different hashes begin alike."""
    halves = marks.where("_node is not null").groupBy(F.substring("_node", 1, 8).alias("name"))
    alike = halves.agg(F.min("_node").alias("lo"), F.max("_node").alias("hi")).where("lo <> hi")
    return 1 if alike.isEmpty() else 2


def _places(key: str, bits: int) -> list:
    """Two places of a key among the filter's bits."""
    return [F.pmod(F.xxhash64(F.lit(seed), key), F.lit(bits)) for seed in (1, 2)]


def filter_bits(wanted: DataFrame, key: str, bits: int) -> np.ndarray:
    """The bytes of a filter of so many bits, a multiple of ``BITMAP``, with those of the wanted keys set."""
    at = wanted.select(F.explode(F.array(*(p + 1 for p in _places(key, bits)))).alias("x"))
    at = at.select(F.bitmap_bucket_number("x").alias("b"), F.bitmap_bit_position("x").alias("p"))
    # Positions are moved, not a bitmap of every task.
    found = at.repartition("b").groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).collect()
    out = np.zeros((bits // BITMAP, BITMAP // 8), np.uint8)
    for row in found:
        out[row["b"] - 1] = np.frombuffer(row["m"], np.uint8)
    return out.ravel()


def rebuilt(docs: DataFrame, alive: DataFrame, nodes: int, *, text: str, key: str) -> DataFrame:
    """(node, grams) of the nodes of ``alive``, from the document that stands for each.

    No text is moved: a filter of bounded size lets few other documents pass, of which the join gets rid.
    """
    bits = BITMAP * math.ceil(min(MOST_BITS, BITS_EACH * nodes) / BITMAP)
    held = docs.sparkSession.sparkContext.broadcast(filter_bits(alive, "_doc", bits))
    source = docs.select(F.col(key).alias("_id"), utf8(text).alias("_utf8"), *(p.alias(f"_p{k}") for k, p in enumerate(_places(key, bits))))
    schema = source.select("_id", F.lit(None).cast("binary").alias("_node"), F.lit(None).cast("binary").alias("grams")).schema

    def rebuild(batches):
        for batch in batches:
            at = np.ones(batch.num_rows, bool)
            for place in (batch.column(c).to_numpy() for c in ("_p0", "_p1")):
                at &= held.value[place >> 3] >> (place & 7).astype(np.uint8) & 1 > 0
            some = batch.filter(pa.array(at))
            for a in range(0, some.num_rows, REBUILT):
                ids, texts = (some.column(c).slice(a, REBUILT) for c in ("_id", "_utf8"))
                sets = [shingles(text.as_py()) for text in texts]
                yield pa.RecordBatch.from_arrays([ids, pa.array([node_of(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["_id", "_node", "grams"])

    sets = source.mapInArrow(rebuild, schema).withColumnRenamed("_node", "_of").where("_of is not null")
    return sets.join(alive, (F.col("_of") == F.col("_node")) & F.col("_id").eqNullSafe(F.col("_doc"))).select("node", "grams")


def node_components(docs: DataFrame, marks: DataFrame, *, text: str, key: str, percent: int = PERCENT) -> DataFrame | None:
    """(_node, _found) for the nodes with links, from documents and their signed rows; None without any. ``_found`` is the component's smallest node."""
    total = marks.agg(F.sum("_n")).first()[0] or 0
    if not total:
        return None
    per_node = marks.where("_node is not null").groupBy("_node").agg(F.min(key).alias("_doc"), F.first("_n").alias("n"))
    words = name_words(marks)
    shared = shared_nodes(docs, text, max(LEAST_FRAGMENTS, math.ceil(total / FRAGMENT_SHINGLES)), words)
    per_node = per_node.withColumn("name", F.substring("_node", 1, 8 * words))
    # Shingles that no other set has can't be common to two sets that link.
    shared = shared.join(per_node, "name").where(100 * F.col("shared") >= percent * F.col("n")).select("_node", "n", "_doc")
    # Numbered once, in a written table: from here on a node is a number.
    alive = materialise(shared.withColumn("node", F.monotonically_increasing_id()))
    left, nodes = alive.agg(F.sum("n"), F.count(F.lit(1))).first()
    if not left:
        return None
    fragments = max(LEAST_LEFT, math.ceil(left / FRAGMENT_SHINGLES))
    few = lambda rows: max(1, math.ceil(rows / PART_ROWS))
    # Written by node once, so that no step moves whole sets to join them.
    name = f"ngram_join_{uuid.uuid4().hex}"
    sets = bucketed(rebuilt(docs, alive, nodes, text=text, key=key), "node", max(fragments, partitions(docs.sparkSession)), name)
    ranked = materialise(prefixes(sets, fragments, percent).coalesce(few(nodes)))
    postings = materialise(_postings(sets, ranked, fragments))
    rows = max(1, postings.count())
    labels = tried = None
    round_, batches, number, linked = 0, 0, 0, 0
    while not batches or number < batches:
        known = _across(postings, labels)
        if labels is not None:
            known = materialise(known.coalesce(few(rows)))
        if not batches and (round_ == STAR_ROUNDS or round_ and (linked * FEW_LINKED < nodes or _pairs_left(known, percent) <= FEW_LEFT * rows)):
            batches = max(1, math.ceil(_pairs_left(known, percent) / min(PAIRS_PER_POSTING * rows, PAIRS_PER_TASK * fragments)))
        if batches:
            pairs = materialise(_batch(known, tried, percent, fragments, batches, number).coalesce(few(HUBS * nodes)))
            number += 1
        else:
            pairs = materialise(_proposals(known, tried, percent, round_).coalesce(few(HUBS * nodes)))
            round_ += 1
        if not pairs.isEmpty():
            new = materialise(links(sets, pairs, fragments, few(HUBS * nodes), LISTS if batches else 1).coalesce(few(HUBS * nodes)))
            tried = pairs.select("a", "b") if tried is None else tried.union(pairs.select("a", "b"))
            linked = new.count()
            if linked:
                labels = _joined(labels, new)
        else:
            linked = 0
        postings = known.select("gram", "node", "n", "rem", "rest")
    drop_bucketed(docs.sparkSession, name)
    if labels is None:
        return None
    named = labels.join(alive.select("node", "_node"), "node")
    return named.join(alive.select(F.col("node").alias("comp"), F.col("_node").alias("_found")), "comp").select("_node", "_found")


def labelled(docs: DataFrame, keep: list[str], *, text: str, key: str, percent: int) -> DataFrame:
    """``keep`` with ``_n`` and ``_comp``, the component's node (null for empty sets), of every document."""
    marks = materialise(signed(docs, keep, text))
    found = node_components(docs, marks, text=text, key=key, percent=percent)
    if found is None:
        return marks.withColumn("_comp", F.col("_node")).drop("_node")
    return marks.join(found, "_node", "left").withColumn("_comp", F.coalesce("_found", "_node")).drop("_node", "_found")


def classes(docs: DataFrame, *, text: str = "text", key: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """One row per document: the key, n_shingles and component_id."""
    rows = materialise(labelled(docs, [key], text=text, key=key, percent=percent))
    least = materialise(rows.where("_comp is not null").groupBy("_comp").agg(F.min(key).alias("_least")))
    out = rows.join(least, "_comp", "left")
    return out.select(key, F.col("_n").alias("n_shingles"), F.coalesce("_least", key).alias("component_id"))


def keep_one(docs: DataFrame, *, percent: int = PERCENT) -> DataFrame:
    """The documents without near duplicates: one row of every component stays, and every row without words.

    It is a row with the smallest id, null ids last, and among equal ids of different texts
    that with the smallest md5. Rows that are equal in id and text are one document.
    """
    hidden, names = masked(docs)
    text, key = f"c{names.index('text')}", f"c{names.index('doc_id')}"
    summed = hidden.withColumn("_sum", F.unhex(F.md5(utf8(text))))
    rows = labelled(summed.select(key, text, "_sum"), [key, "_sum"], text=text, key=key, percent=percent).where("_comp is not null")
    # Rows of one id and text are counted first, so that the winner carries their number.
    counted = rows.groupBy("_comp", key, "_sum").agg(F.count(F.lit(1)).alias("_rows"))
    order = F.struct(F.col(key).isNull().alias("z"), F.col(key).alias("i"), F.col("_sum").alias("s"), F.col("_rows").alias("r"))
    kept = counted.groupBy("_comp").agg(F.min(order).alias("w")).select(F.col("w.i").alias("_id"), F.col("w.s").alias("_s"), F.col("w.r").alias("_rows"))
    kept = materialise(kept)
    worded = F.coalesce(F.col(text).rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    found = summed.join(kept, (F.col("_sum") == F.col("_s")) & F.col(key).eqNullSafe(F.col("_id")), "left")
    once = found.where(~worded | (F.col("_rows") == 1)).select(*hidden.columns)
    more = found.where(worded & (F.col("_rows") > 1)).dropDuplicates([key, "_sum"]).select(*hidden.columns)
    return once.union(more).toDF(*names)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, array_to_string(ws[i:i + least(len(ws), 5) - 1], ' ') || ' ' || least(len(ws), 5) AS g
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
  )
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
r AS (SELECT DISTINCT a AS doc_id, a AS other FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other),
m AS (SELECT doc_id, min(other) AS least FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(least, d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
