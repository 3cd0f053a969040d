"""Benchmark decontamination with a generalised suffix automaton.

The normalised test items form one suffix automaton over words. Documents are
streamed through it; after every word the automaton knows the longest suffix read
so far that occurs in any item, so contamination is found in one pass without
materialising n-grams of the corpus.

Benchmarks are taken in blocks of at most ``block_words`` words: a block is the
only thing that is broadcast, and its size is bounded by that parameter whatever
the benchmark holds. With several blocks the documents are passed through each.

Edge cases: a null or wordless text has no words, no hits and is clean; null item
texts and items without words have no window; repeated items count once per row,
null item ids take part but are not listed; repeated documents are judged row by
row; an empty benchmark leaves every document clean. Extra columns are ignored by
``scan`` and kept by ``remove``.
"""

from __future__ import annotations

import hashlib
import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import masked, materialise, table, worker_cache

WINDOW = 13
BLOCK_WORDS = 250_000

#: ASCII letters in lower case, digits and every byte of a multi-byte character stay; the rest separates words.
NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class Automaton:
    """Suffix automaton of several word sequences.

    ``step`` follows one word; ``windows[s]`` are the items whose ``window``-word
    substrings end in state s (for the state that holds the window-long suffix),
    ``shorts[s]`` maps a length to the short items that are whole strings of s.
    """

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.len = [0]
        self.windows: dict[int, set] = {}
        self.shorts: dict[int, dict[int, set]] = {}
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        for item, words in items:
            self._mark(item, words)
        self.above = self._short_ancestors()

    def _extend(self, last: int, word: bytes) -> int:
        nxt, link, length = self.next, self.link, self.len
        if word in nxt[last]:
            q = nxt[last][word]
            return q if length[q] == length[last] + 1 else self._clone(last, word, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and word not in nxt[p]:
            nxt[p][word] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][word]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, word, q)
        return cur

    def _clone(self, p: int, word: bytes, q: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.len.append(self.len[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = copy
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _mark(self, item, words: list[bytes]) -> None:
        if not words:
            return
        state, n = 0, 0
        for word in words:
            state = self.next[state][word]
            n += 1
            if n >= self.window:
                self.windows.setdefault(self.at(state, self.window), set()).add(item)
        if n < self.window:
            self.shorts.setdefault(self.at(state, n), {}).setdefault(n, set()).add(item)

    def at(self, state: int, n: int) -> int:
        """The state that holds the n-word suffix of this state's strings."""
        while self.len[self.link[state]] >= n:
            state = self.link[state]
        return state

    def _short_ancestors(self) -> list[int]:
        """For each state the nearest one on its suffix path, itself included, with short items, or -1."""
        above = [-1] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.len.__getitem__):
            above[s] = s if s in self.shorts else above[self.link[s]] if self.link[s] > 0 else -1
        return above

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit spans (first word, last word) and the items whose windows occur."""
        nxt, link, length, above, window = self.next, self.link, self.len, self.above, self.window
        root = nxt[0]
        spans, found = [], set()
        state = n = 0
        for i, word in enumerate(words):
            if not state:
                state = root.get(word, 0)
                n = 1 if state else 0
                if not state:
                    continue
            else:
                to = nxt[state].get(word)
                while to is None and state:
                    state = link[state]
                    n = length[state]
                    to = nxt[state].get(word)
                if to is None:
                    state = n = 0
                    continue
                state = to
                n += 1
            if n >= window:
                at = state
                while length[link[at]] >= window:
                    at = link[at]
                found |= self.windows[at]
                spans.append((i - window + 1, i))
            a = above[state]
            while a > 0:
                for size, ids in self.shorts[a].items():
                    if size <= n:
                        found |= ids
                        spans.append((i - size + 1, i))
                up = link[a]
                a = above[up] if up > 0 else -1
        return spans, found


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, block_words: int):
    """Lists of (row number, item id, text), each of at most block_words words or of one item.

    The driver holds one block at a time; the items stream through it partition by partition.
    """
    rows, size, any_block = [], 0, False
    source = benchmark.select("item_id", F.col("text").cast("binary").alias("text"))
    for k, r in enumerate(source.toLocalIterator()):
        words = len(words_of(bytes(r["text"]))) if r["text"] is not None else 0
        if not words:
            continue
        if rows and size + words > block_words:
            yield rows
            rows, size, any_block = [], 0, True
        rows.append((k, r["item_id"], bytes(r["text"])))
        size += words
    if rows or not any_block:
        yield rows


def _pass(shared, window: int, key: str, text: str, out: list[str]):
    """One pass of documents through one block: n_words, n_hit, spans and items are added."""

    def run(batches):
        cache = worker_cache()
        if key not in cache:
            for old in [k for k in cache if k.startswith("automaton-")]:
                del cache[old]
            rows = shared.value
            cache[key] = (Automaton([(k, words_of(t)) for k, _, t in rows], window), {k: i for k, i, _ in rows})
        automaton, ids = cache[key]
        for batch in batches:
            texts, spans, items, counts, hits = batch.column(text).cast(pa.binary()), [], [], [], []
            for k in range(batch.num_rows):
                words = words_of(texts[k].as_py() or b"")
                got, found = automaton.scan(words)
                merged = merge_spans(got)
                counts.append(len(words))
                hits.append(sum(b - a + 1 for a, b in merged))
                spans.append([x for s in merged for x in s])
                items.append([str(ids[x]) for x in found if ids[x] is not None])
            columns = {n: batch.column(n) for n in batch.schema.names} | {
                "_spans": pa.array(spans, pa.list_(pa.int64())),
                "_items": pa.array(items, pa.list_(pa.string())),
                "n_words": pa.array(counts, pa.int64()),
                "n_hit": pa.array(hits, pa.int64()),
            }
            yield pa.RecordBatch.from_arrays([columns[n] for n in out], out)

    return run


FOUND = {"_spans": "array<long>", "_items": "array<string>", "n_words": "long", "n_hit": "long"}


def _scanned(docs: DataFrame, rows, window: int, keep: list[str], text: str) -> DataFrame:
    """Columns ``keep`` with what one block of items finds."""
    digest = hashlib.sha1(repr((window, rows)).encode()).hexdigest()
    names = [*keep, *FOUND]
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    schema = docs.select(*[F.col(f"`{c}`") for c in keep], *[F.lit(None).cast(k).alias(c) for c, k in FOUND.items()]).schema
    return docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])]).mapInArrow(_pass(shared, window, f"automaton-{digest}", text, names), schema)


def _united(batches):
    """Spans of several blocks, end to end, as merged spans and the words that they cover."""
    for batch in batches:
        spans = [merge_spans(list(zip(x[::2], x[1::2], strict=True))) for x in batch.column("_spans").to_pylist()]
        columns = {n: batch.column(n) for n in batch.schema.names} | {
            "_spans": pa.array([[x for s in own for x in s] for own in spans], pa.list_(pa.int64())),
            "n_hit": pa.array([sum(b - a + 1 for a, b in own) for own in spans], pa.int64()),
        }
        yield pa.RecordBatch.from_arrays([columns[n] for n in batch.schema.names], batch.schema.names)


def scan(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_words: int = BLOCK_WORDS, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Columns ``keep`` of docs with n_words, n_hit, ``_spans`` (flat first/last word pairs) and ``_items``.

    With several blocks the documents are numbered and written once; each block's pass leaves
    the numbers of the documents that it hits, which are put together at the end.
    """
    keep = ["doc_id"] if keep is None else keep
    blocks = _blocks(benchmark, block_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _scanned(docs, first, window, keep, text)
    numbered = materialise(docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])], F.monotonically_increasing_id().alias("_row")))
    base = _scanned(numbered, first, window, [*keep, "_row"], text)
    base = materialise(base)
    hits = base.select("_row", "_spans", "_items").where("n_hit > 0")
    for rows in itertools.chain([second], blocks):
        found = _scanned(numbered, rows, window, ["_row"], text).where("n_hit > 0").select("_row", "_spans", "_items")
        hits = hits.union(materialise(found))
    both = hits.groupBy("_row").agg(F.flatten(F.collect_list("_spans")).alias("_s"), F.flatten(F.collect_list("_items")).alias("_i"))
    empty = lambda c: F.coalesce(c[0], F.array().cast(c[1]))
    out = base.join(both, "_row", "left").select(*[F.col(f"`{c}`") for c in keep], empty(("_s", "array<long>")).alias("_spans"), empty(("_i", "array<string>")).alias("_items"), "n_words", F.lit(0).cast("long").alias("n_hit"))
    return out.mapInArrow(_united, out.schema)


def judged(scanned: DataFrame, percent: int = 5) -> DataFrame:
    """Adds n_items, items_sha256 and contaminated to what ``scan`` returns."""
    listed = F.array_sort(F.array_distinct("_items"))
    return (
        scanned.withColumn("n_items", F.size(listed).cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join(listed, ",").cast("binary"), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words")))
    )


def remove(docs: DataFrame, benchmark: DataFrame, *, mode: str = "documents", window: int = WINDOW, percent: int = 5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents without benchmark passages, with the columns of docs.

    ``mode="documents"`` drops documents of which at least ``percent`` per cent of
    the words are hit and leaves all others as they are. ``mode="spans"`` also
    cuts the remaining hit spans out of the other texts.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode is documents or spans, not {mode}")
    hidden, names = masked(docs)
    text = f"c{names.index('text')}"
    kept = judged(scan(hidden, benchmark, window=window, block_words=block_words, keep=hidden.columns, text=text), percent).where(~F.col("contaminated"))
    if mode == "documents":
        return kept.select(*hidden.columns).toDF(*names)
    schema = hidden.schema

    def cut(batches):
        for batch in batches:
            texts = []
            for raw, spans in zip(batch.column(text).cast(pa.binary()).to_pylist(), batch.column("_spans").to_pylist(), strict=True):
                if raw is None or not spans:
                    texts.append(raw)
                    continue
                at = [m.span() for m in WORD.finditer(raw)]
                out, last = [], 0
                for a, b in zip(spans[::2], spans[1::2], strict=True):
                    out.append(raw[last : at[a][0]])
                    last = at[b][1]
                texts.append(b"".join([*out, raw[last:]]))
            columns = [pa.array(texts, pa.binary()).cast(pa.string()) if n == text else batch.column(n) for n in schema.names]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return kept.mapInArrow(cut, schema).toDF(*names)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(ws), 13) AS m, array_to_string(ws[i:i + least(len(ws), 13) - 1], ' ') AS g
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0)
), sizes AS (SELECT DISTINCT m FROM win),
grams AS (
  SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS g
  FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, sizes WHERE len(ws) >= m)
), hits AS (SELECT doc_id, grams.m AS m, i, item_id FROM grams JOIN win ON grams.m = win.m AND grams.g = win.g),
marked AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN marked USING (doc_id) LEFT JOIN listed USING (doc_id)
"""
