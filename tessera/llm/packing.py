"""Packing of token streams into fixed sequences by first-fit decreasing.

Every document is tokenised whole and ended by one end token. Pieces of at most
``capacity`` tokens are dealt to randomised groups of a bounded expected size; each
group is packed on its own, longest piece first, into the first sequence with room.
A tournament tree over the sequences' free room finds that sequence in logarithmic
time.

Tokenising goes word by word through a bounded cache wherever a text consists of
ASCII and Latin letters, for which the tokenizer's splitting into words is exactly a
regular expression; every other text, and any with special-token strings, goes
through the tokenizer whole.

Edge cases: a null or empty text is the single end token; very long texts are cut
freely and their pieces dealt to any groups; repeated documents are packed once per row and
dealt apart; ties of length go by id, start and crc; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, worker_cache

CAPACITY = 2048
END = 1
#: Documents that a group holds on average.
GROUP_DOCS = 2000
VOCABULARY = "word_bpe_49k.json"
CACHED_WORDS = 500_000

#: Texts of these characters only are split into words by SPLIT; all are stable under NFC and lower-case letter by letter.
PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-įı-ſ]*")
SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^\t\n\r a-z0-9ß-öø-ſ]+")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}
        size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self.ends = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Every word is one pre-token, and the last of a word's tokens is the only one that ends a word."""
        for a in range(0, len(words), 2000):
            part = words[a : a + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.nonzero(self.ends[ids])[0] + 1
            if len(cuts) != len(part):
                self.cache.update((w, self.whole(w)) for w in part)
                continue
            raw, last = ids.tobytes(), 0
            for word, cut in zip(part, cuts.tolist(), strict=True):
                self.cache[word] = raw[4 * last : 4 * cut]
                last = cut

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [SPLIT.findall(t.lower()) if "<|" not in t and PLAIN.fullmatch(t) else None for t in texts]
        if len(self.cache) > CACHED_WORDS:
            self.cache.clear()
        new = set().union(*[s for s in split if s]).difference(self.cache)
        self._learn(sorted(new))
        get = self.cache.__getitem__
        return [self.whole(t) if s is None else b"".join(map(get, s)) for t, s in zip(texts, split, strict=True)]


def pieces(docs: DataFrame, path: str, *, capacity: int = CAPACITY, end: int = END, ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, the ids."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "_ids"]
    tail = np.array([end], "<u4").tobytes()

    def encoded(encoder, texts):
        """Texts in runs of about a quarter of a million characters, so that little is held at a time."""
        run, size = [], 0
        for text in texts:
            run.append(text)
            size += len(text)
            if size > 1 << 18:
                yield from encoder.encode(run)
                run, size = [], 0
        yield from encoder.encode(run)

    def rows(batches):
        cache = worker_cache()
        if (encoder := cache.get("encoder")) is None or cache.get("encoder_path") != path:
            encoder = cache["encoder"] = Encoder(path)
            cache["encoder_path"] = path
        for batch in batches:
            column = batch.column("text")
            texts = (column[k].as_py() for k in range(batch.num_rows))
            out = []
            for doc, raw in zip(batch.column("doc_id").to_pylist(), encoded(encoder, texts), strict=True):
                raw += tail
                n = len(raw) // 4
                for a in range(0, n, capacity):
                    part = raw[4 * a : 4 * (a + capacity)]
                    out.append((doc, a, len(part) // 4, zlib.crc32(part), n, part if ids else None))
            types = [pa.int64()] * 5 + [pa.binary()]
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

    return source.mapInArrow(rows, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, _ids binary")


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each length, taken in the order given; the tree's leaves are bins, its nodes the most room below."""
    size = 1
    while size < max(1, len(lengths)):
        size *= 2
    room = [capacity] * (2 * size)
    bins, offsets = [], []
    for n in lengths:
        node = 1
        while node < size:
            node *= 2
            if room[node] < n:
                node += 1
        bins.append(node - size)
        offsets.append(capacity - room[node])
        room[node] -= n
        while node > 1:
            node //= 2
            best = room[2 * node] if room[2 * node] >= room[2 * node + 1] else room[2 * node + 1]
            if room[node] == best:
                break
            room[node] = best
    return bins, offsets


def pack(cut: DataFrame, *, groups: int, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces; sequence ids hold the group in their upper 32 bits."""
    columns = cut.columns
    # The row's number keeps repeated rows apart, however many there are.
    grouped = cut.withColumn("_group", F.pmod(F.xxhash64(F.lit("packing"), "doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    out = cut.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))

    def run(key, t):
        order = [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]
        t = t.sort_by(order)
        bins, offsets = first_fit_decreasing(t.column("length").to_pylist(), capacity)
        base = key[0].as_py() << 32
        arrays = [t.column(c) for c in columns] + [pa.array([base + b for b in bins], pa.int64()), pa.array(offsets, pa.int64())]
        return pa.Table.from_arrays(arrays, [*columns, "sequence_id", "offset"])

    return grouped.groupBy("_group").applyInArrow(run, out.schema)


def pack_documents(docs: DataFrame, path: str | None = None, *, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places; ``ids`` adds the token ids of each piece as bytes."""
    groups = max(1, -(-docs.count() // GROUP_DOCS))
    cut = pieces(docs, path or vocabulary_path(), capacity=capacity, ids=ids)
    return pack(cut if ids else cut.drop("_ids"), groups=groups, capacity=capacity)


def op5_pack_ffd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
