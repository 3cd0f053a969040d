"""Sharding, n-gram join, packing, WARC and suffix dedup against brute force and edge cases; the pipeline."""

import base64
import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import ngram_join as J
from tessera.llm import packing as P
from tessera.llm import quality as Q
from tessera.llm import shards as S
from tessera.llm import suffix_dedup as X
from tessera.llm import warc as W

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, component_id string"


def docs(spark, texts, ids=None):
    rows = [(ids[i] if ids else i, t, "en", "hot" if i % 3 else f"s{i % 5}" if i % 2 else None, len(t or ""), 7, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def near_copies(rng, n=60):
    base = [" ".join(rng.choice(["ab", "cd", "ef", "gh", "ij", "kl", "mn", "op"]) + str(rng.randint(0, 30)) for _ in range(60)) for _ in range(n // 6)]
    out = []
    for k in range(n):
        words = base[k % len(base)].split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            words[rng.randrange(len(words))] = f"z{rng.random()}"
        out.append(" ".join(words))
    return out


def test_shards(spark):
    frame = docs(spark, [f"t{i}" for i in range(101)] + [None, "", "t1"])
    twice = frame.union(frame)
    for df, n in ((frame, 104), (twice, 208)):
        placed = S.interleave(df, ["doc_id", "text"], shards=8)
        rows = placed.collect()
        sizes = Counter(r[len(frame.columns)] for r in rows)
        assert len(rows) == n and placed.columns == [*frame.columns, "shard", "slot"] and max(sizes.values()) - min(sizes.values()) <= 1
        for k in range(8):
            assert sorted(r["slot"] for r in rows if r[len(frame.columns)] == k) == list(range(sizes[k]))
        hot = Counter(r[len(frame.columns)] for r in rows if r["source"] == "hot")
        assert max(hot.values()) - min(hot.values()) <= 2
    assert S.interleave(frame.limit(0), ["doc_id"]).isEmpty()


def brute_components(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("rounds", [4, 0])
def test_ngram_join_by_brute_force(spark, monkeypatch, rounds):
    monkeypatch.setattr(J, "STAR_ROUNDS", rounds)
    texts = near_copies(random.Random(5)) + [None, "", " ", "one two", "ONE two", "one", "a b c d e", "a b c d e f"]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.classes(docs(spark, texts).select("doc_id", "text")).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)


def test_ngram_join_in_batches(spark, monkeypatch):
    # Pairs are counted in several batches, as a group of documents shares rare shingles without linking.
    monkeypatch.setattr(J, "STAR_ROUNDS", 0)
    monkeypatch.setattr(J, "PAIRS_PER_POSTING", 0.2)
    monkeypatch.setattr(J, "MEETING", 4)
    monkeypatch.setattr(J, "FLUSH_MEETINGS", 50)
    rng = random.Random(9)
    core = " ".join(f"c{i}" for i in range(40))
    texts = [core + " " + " ".join(f"{rng.random()}" for _ in range(rng.choice([5, 9, 14]))) for _ in range(25)] + near_copies(rng, 18)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.classes(docs(spark, texts).select("doc_id", "text")).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)


def test_ngram_join_where_hashes_begin_alike(spark, monkeypatch):
    whole = J.node_of
    # The first halves tell nothing apart.
    monkeypatch.setattr(J, "node_of", lambda s: whole(s) and bytes(8) + whole(s)[8:])
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words), " ".join(words[:58]), " ".join(words[::-1]), " ".join(words[:20]), "one two three", "", " ".join(words[::-1][:57])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert J.name_words(J.signed(docs, ["doc_id"])) == 2
    found = {r["doc_id"]: r["component_id"] for r in J.classes(docs).collect()}
    assert found == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 5, 6: 2}
    monkeypatch.undo()
    assert J.name_words(J.signed(docs, ["doc_id"])) == 1
    assert {r["doc_id"]: r["component_id"] for r in J.classes(docs).collect()} == found


def test_fragment_whose_shingles_are_each_of_another_node():
    # So are most fragments of a large corpus; a task of an executor of 3 GB has such a fragment beside another one's.
    import tracemalloc

    n, rng = J.FRAGMENT_SHINGLES, np.random.default_rng(0)
    row = [rng.integers(0, 2**63, n), np.full(n, 500, np.uint32), np.ones(n, np.uint32), rng.integers(0, 2**32, n, np.uint32)]
    t = pa.table({c: pa.array([x.tobytes()], pa.binary()) for c, x in zip(("nodes", "sizes", "counts", "grams"), row, strict=True)})
    tracemalloc.start()
    nodes, _, owner, grams = J.gathered(t, 1, wide=False)
    assert len(J.frequencies(grams)) == len(owner) == len(nodes) == n
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250e6


def test_ngram_join_of_very_long_texts(spark):
    words = [f"w{i}" for i in range(30_000)]
    texts = [" ".join(words), " ".join(words[:25_000]), " ".join(words[20_000:]), " ".join(words[:3])]
    got = {r["doc_id"]: r["component_id"] for r in J.classes(docs(spark, texts)).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3}


def shuffled(spark):
    time.sleep(0.5)  # the totals are brought up to date every tenth of a second
    spark.range(1).count()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))


def test_ngram_join_moves_no_texts(spark):
    # Each of these texts is one long word; only the other two are in question after the first step.
    rng, words = random.Random(2), " ".join(f"w{i}" for i in range(40))
    texts = [rng.randbytes(10_000).hex() for _ in range(200)] + [words, words + " more"]
    before = shuffled(spark)
    got = {r["doc_id"]: r["component_id"] for r in J.classes(docs(spark, texts)).collect()}
    assert got == {i: min(i, 200) for i in range(202)}
    assert shuffled(spark) - before < 1_000_000


@pytest.mark.parametrize("most", [1 << 26, 1 << 15])
def test_rebuilt_sets_however_full_the_filter(spark, monkeypatch, most):
    # With the smaller limit more than half of the unwanted documents pass the filter, but not the join.
    monkeypatch.setattr(J, "MOST_BITS", most)
    n = 50_000
    frame = spark.range(n).select(F.when(F.col("id") > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    frame = frame.union(spark.createDataFrame([(2, "another text of id two")], frame.schema))
    alive = J.signed(frame.where("doc_id is null or doc_id % 2 = 0 and text like 'word%'"), ["doc_id"]).select("_node", F.col("doc_id").alias("_doc"))
    alive = J.materialise(alive.withColumn("node", F.coalesce("_doc", F.lit(0))))
    got = {r["node"]: r["grams"] for r in J.rebuilt(frame, alive, n // 2, text="text", key="doc_id").collect()}
    assert len(got) == n // 2 and all(got[i] == J.shingles(f"word {i}".encode()).tobytes() for i in range(0, n, 2))


def test_partial_overlaps():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 40, n)).astype(np.uint64) for n in (0, 5, 30, 60, 1)]
    owner, grams = np.repeat(np.arange(5), [len(x) for x in sets]), np.concatenate(sets)
    left, right = (x.ravel() for x in np.meshgrid(np.arange(5), np.arange(5)))
    order = rng.permutation(len(grams))
    got = J.partial_overlaps(owner[order], grams[order], left, right, 5)
    assert got.tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(left, right, strict=True)]


def test_ngram_join_keeps_unlike_rows_of_one_id(spark):
    texts = [" ".join(f"{x}{i}" for i in range(30)) for x in "abcde"]
    frame = docs(spark, [*texts, texts[0], texts[1] + " more", None, None], [None, None, 3, 3, 5, None, 3, 3, None])
    kept = J.keep_one(frame).collect()
    # Five unlike texts; the sixth row is the first again, the seventh a near copy of the second with an id.
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept) == sorted([("None", texts[0]), ("3", texts[1] + " more"), ("3", texts[2]), ("3", texts[3]), ("5", texts[4]), ("3", ""), ("None", "")])


def test_ngram_join_keeps_one(spark):
    text = " ".join(f"w{i}" for i in range(40))
    texts = [text, text + " x", "other words stand in this one here", text, None, ""]
    frame = docs(spark, texts, [5, 3, 1, 3, 7, None])
    kept = J.keep_one(frame)
    assert kept.columns == frame.columns and sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 3, 7, None]
    assert J.keep_one(frame.limit(0)).isEmpty()


def test_first_fit_decreasing():
    rng = random.Random(0)
    lengths = sorted((rng.randint(1, 100) for _ in range(300)), reverse=True)
    bins, offsets = P.first_fit_decreasing(lengths, 100)
    rooms: list[int] = []
    for n, b, off in zip(lengths, bins, offsets, strict=True):
        want = next((k for k, r in enumerate(rooms) if r >= n), len(rooms))
        if want == len(rooms):
            rooms.append(100)
        assert (b, off) == (want, 100 - rooms[want])
        rooms[want] -= n
    assert P.first_fit_decreasing([], 10) == ([], [])


def test_packing_keeps_every_token(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.vocabulary_path())
    texts = ["Hello, World's 12 Übermaß!", None, "", "a<|endoftext|>b", "日本語 text ﬁ Σας", "it's we'll\x1c x́y İstanbul", "word " * 5000, "\x85  a\tb\r\n", "don't 'sx 's"] * 2
    got = P.pack_documents(docs(spark, texts, [i % 9 for i in range(18)]), ids=True).collect()
    streams: dict = {}
    for r in got:
        streams.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        assert r["ids_crc32"] == zlib.crc32(bytes(r["_ids"])) and len(r["_ids"]) == 4 * r["length"]
    for i, t in enumerate(texts[:9]):
        want = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        parts = sorted(streams[i, len(want)], key=lambda r: r["start"])[::2]
        assert np.concatenate([np.frombuffer(r["_ids"], "<u4") for r in parts]).tolist() == want
    places: dict = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        p.sort()
        assert all(a == sum(n for _, n in p[:k]) for k, (a, _) in enumerate(p)) and sum(n for _, n in p) <= 2048
    assert P.pack_documents(docs(spark, texts).limit(0)).isEmpty()


def test_packing_deals_repeated_rows_apart(spark, monkeypatch):
    monkeypatch.setattr(P, "GROUP_DOCS", 20)
    got = P.pack_documents(spark.range(400).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))).collect()
    groups = Counter(r["sequence_id"] >> 32 for r in got)
    assert len(got) == 400 and len(groups) > 10 and max(groups.values()) < 60


def test_warc_round_trip_with_magic_in_payloads(spark, tmp_path):
    rng = random.Random(1)
    record = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    kinds = [record, record * 3, W.MAGIC, "x" + W.MAGIC + "Content-Length: 99\r\n\r\n" + "y" * 50, "é" * 99, "plain", "", None]
    rows = [(i, None if i == 3 else f"http://x/{i}\r\né", rng.choice(kinds)) for i in range(120)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    last = {(h or ""): i for i, _, h in rows}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    W.write(pages, str(tmp_path / "gz"))
    W.records(W.with_record_types(pages)).write.option("lineSep", "\n").text(str(tmp_path / "plain"))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        for path in ("gz", "plain"):
            got = W.described_records(W.read(spark, str(tmp_path / path))).collect()
            assert sorted(r["page_id"] for r in got) == list(range(120))
            for r in got:
                h = rows[r["page_id"]][2] or ""
                assert r["verified"] and r["payload_bytes"] == len(h.encode())
                assert r["payload_digest"] == base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
                first = last[h] == r["page_id"]
                assert (r["record_type"], r["refers_to"]) == (("response", None) if first else ("revisit", last[h]))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    W.write(pages.limit(0), str(tmp_path / "none"))
    assert W.described_records(W.read(spark, str(tmp_path / "none"))).isEmpty()


def test_front_coding_and_merging():
    rng = random.Random(4)
    words = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 30))) for _ in range(500)]
    runs = []
    for k in range(7):
        part = sorted(words[k::7])
        runs.append([(n, rest, s) for n, rest, s in zip(*X.front_code(part), part, strict=True)])
    merged = list(X.merge_runs(runs + [[]]))
    assert [s for s, _, _ in merged] == sorted(words) and all(s == p for s, _, p in merged)
    assert all(n == X.common_prefix(a, b, 0) for (a, _, _), (b, n, _) in zip(merged, merged[1:], strict=False))
    assert list(X.merge_runs([])) == []


def brute_removed(texts):
    raws = [(t or "").encode() for t in texts]
    n = Counter(r[i : i + 200] for r in raws for i in range(len(r) - 199))
    out = []
    for r in raws:
        mark = bytearray(len(r))
        for i in range(len(r) - 199):
            if n[r[i : i + 200]] > 1:
                mark[i : i + 200] = b"\1" * 200
        kept = bytes(x for x, m in zip(r, mark, strict=True) if not m)
        out.append((len(r), sum(mark), sum(m and (i == 0 or not mark[i - 1]) for i, m in enumerate(mark)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("piece", [10, 1, 64])
def test_suffix_dedup_by_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(X, "PIECE", piece)
    rng = random.Random(6)
    prose = lambda n: "".join(rng.choice("abcdefé ") for _ in range(n))
    passage, other = prose(400), prose(260)
    texts = [prose(rng.randint(0, 300)) + rng.choice([passage, passage[: rng.randint(150, 400)], other, other[30:], ""]) + prose(rng.randint(0, 300)) for _ in range(30)]
    texts += [texts[0], "q" * 900, "ab" * 300, passage * 2, None, "", "x" * 199, "y" * 200, "y" * 200]
    got = {r["doc_id"]: r for r in X.dedup(docs(spark, texts)).collect()}
    for i, want in enumerate(brute_removed(texts)):
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == want, i
    assert X.dedup(docs(spark, texts).limit(0)).isEmpty()


def test_suffix_dedup_of_a_hot_passage(spark, monkeypatch):
    # All texts hold one passage between texts of their own: two anchors with as many different stretches as texts.
    monkeypatch.setattr(X, "BLOCK", 300)
    monkeypatch.setattr(X, "RUN_BYTES", 4000)
    rng = random.Random(7)
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = prose(430)
    texts = [prose(rng.randint(0, 200)) + passage[rng.choice([0, 0, 0, 3, 40]) : rng.choice([430, 430, 400])] + prose(rng.randint(0, 200)) for _ in range(60)]
    texts += [prose(100) + passage + prose(30) + passage + prose(5), passage, passage[:200], passage[:199]]
    got = {r["doc_id"]: r for r in X.dedup(docs(spark, texts)).collect()}
    for i, want in enumerate(brute_removed(texts)):
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == want, i


def test_suffix_anchors_of_long_texts(monkeypatch):
    rng = random.Random(8)
    text = bytes(rng.choice(b"abcd") for _ in range(5000))
    whole = X.anchors(text)
    monkeypatch.setattr(X, "BLOCK", 700)
    cut = X.anchors(text)
    cover = lambda a: sorted(s for p in a[2].tolist() for s in range((p >> 14) - (p >> 7 & 127), (p >> 14) - (p & 127) + 1))
    assert cover(whole) == cover(cut) == list(range(5000 - 199))


def test_warc_long_payloads_and_repeated_rows(spark, tmp_path):
    long = "line of a very long page\r\n" * 40_000
    pages = spark.createDataFrame([(1, "u", long, 5), (2, "u", long + "x", 5), (2, "u", long + "x", 5), (3, "u", None, 5)], "page_id long, url string, html string, kind int")
    W.write(pages, str(tmp_path / "long"))
    got = sorted((r["page_id"], r["payload_bytes"], r["record_type"]) for r in W.described_records(W.read(spark, str(tmp_path / "long"))).collect())
    assert got == [(1, len(long), "response"), (2, len(long) + 1, "response"), (2, len(long) + 1, "response"), (3, 0, "response")]


SF = "/root/testdata/sf0.001"


def brute_discriminant(texts, training):
    """Class 1's probability of each text, from the densities written out."""
    x = np.array([Q.statistics((t or "").encode()) for t in texts])
    known = {k: np.array([Q.statistics((t or "").encode()) for t, y in training if y == k]) for k in (0, 1)}
    cov = {k: np.cov(v, rowvar=False, bias=True) for k, v in known.items()}
    total = sum(map(len, known.values()))
    pooled = sum(len(known[k]) * cov[k] for k in (0, 1)) / total
    target = 0.8 * pooled + 0.2 * np.diag(np.diag(pooled))
    log = {}
    for k in (0, 1):
        sigma = 0.9 * cov[k] + 0.1 * target + 1e-4 * np.eye(x.shape[1])
        d = x - known[k].mean(axis=0)
        log[k] = np.log(len(known[k]) / total) - 0.5 * (np.linalg.slogdet(sigma)[1] + np.einsum("ij,ij->i", d, np.linalg.solve(sigma, d.T).T))
    return 1 / (1 + np.exp(np.clip(log[0] - log[1], -60, 60)))


def training_rows(rows, labels):
    by_id = {r["doc_id"]: r["text"] for r in rows}
    return [(by_id[d], y) for d, y in labels if y in (0, 1) and d in by_id and zlib.crc32(str(d).encode()) % 3 != 1]


def test_quality_scores_by_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    want = brute_discriminant([r["text"] for r in rows], training_rows(rows, labels))
    got = {r["doc_id"]: r for r in Q.op7_quality_qda(spark, SF).collect()}
    assert len(got) == len(rows)
    for r, p in zip(rows, want, strict=True):
        assert abs(got[r["doc_id"]]["score"] - p) < 1e-6 and got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def brute_lines(rows):
    """(doc_id, text) without boilerplate lines; documents that lost lines and have only blanks left go."""
    sites, first = {}, {}
    for d, text, source in sorted(rows, key=lambda r: r[0]):
        for pos, line in enumerate((text or "").split("\n")):
            if len(line.strip(" \t\r")) >= 20:
                sites.setdefault(line.strip(" \t\r"), set()).add(source)
                first.setdefault(line.strip(" \t\r"), (d, pos))
    spread = {x for x, s in sites.items() if len(s) >= (3 if len(re.findall(r"[^\x20\x09-\x0D]+", x)) >= 50 else 6)}
    out = []
    for d, text, _ in rows:
        kept = [x for pos, x in enumerate((text or "").split("\n")) if x.strip(" \t\r") not in spread or first[x.strip(" \t\r")] == (d, pos)]
        lost = len(kept) < len((text or "").split("\n"))
        if not lost or "".join(kept).strip():
            out.append((d, "\n".join(kept) if lost else text))
    return out


def brute_contaminated(texts, items, window=13):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    grams = set()
    for item in items:
        w = words(item)
        grams |= {tuple(w[i : i + window]) for i in range(max(1, len(w) - window + 1))} if w else set()
    out = []
    for t in texts:
        w = words(t)
        hit = {j for n in {len(g) for g in grams} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in grams for j in range(i, i + n)}
        out.append(bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_pipeline_by_brute_force(spark):
    import corpus_pipeline as C
    from tokenizers import Tokenizer

    rows = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    known = training_rows([{"doc_id": d, "text": t} for d, t, _ in rows], labels)
    rows = [r for r, p in zip(rows, brute_discriminant([t for _, t, _ in rows], known), strict=True) if p >= 0.5]
    left = sorted(brute_lines(rows))
    found = brute_components([t for _, t in left])
    left = [r for k, r in enumerate(left) if found[k][1] == k]
    bad = brute_contaminated([t for _, t in left], [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    left = {d: t for (d, t), b in zip(left, bad, strict=True) if not b}
    packed = C.run(spark, SF).collect()
    pieces: dict = {}
    for r in packed:
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    assert set(pieces) == set(left) and 0 < len(left) < 200
    tokenizer = Tokenizer.from_file(P.vocabulary_path())
    for d, t in left.items():
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for start, n, crc, total in sorted(pieces[d]):
            assert (start, crc, total) == (at, zlib.crc32(ids[at : at + n].tobytes()), len(ids))
            at += n
        assert at == len(ids)
    places: dict = {}
    for r in packed:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        p.sort()
        assert all(a == sum(n for _, n in p[:k]) for k, (a, _) in enumerate(p)) and sum(n for _, n in p) <= 2048


def test_pipeline_stages_take_any_rows(spark):
    """Nulls in every column, repeated rows, clashing extra columns, and empty tables, through every stage."""
    import corpus_pipeline as C

    columns = "doc_id long, text string, lang string, source string, n_chars long, _key string, _n int, _comp int, n_hit string, _text int, score int, _rows int, c0 int"
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "k", 1, 2, "h", 3, 4, 5, 6) for r in base]
    rows += [rows[0], rows[0], (None, rows[1][1], *rows[1][2:]), (rows[2][0], "other words under the same id " * 9, *rows[2][2:]), (None,) * 13, (None,) * 13, (99_999, "", *rows[3][2:]), (99_998, "word " * 200_000, *rows[3][2:])]
    frame = spark.createDataFrame(rows, columns).cache()
    for name, stage in C.STAGES:
        out = stage(spark, frame, SF)
        kept = out.collect()
        if name == "packing":
            tokens = {(r["doc_id"], r["doc_tokens"]) for r in kept}
            assert sum(r["start"] == 0 for r in kept) == len(rows) and (None, 1) in tokens and (99_999, 1) in tokens
        else:
            assert out.columns == frame.columns and len(kept) <= len(rows) and all(r["c0"] in (6, None) for r in kept), name
        if name == "n-gram Jaccard join":
            assert sum(r["text"] is None for r in kept) == 2 and sum(r["text"] == rows[0][1] for r in kept) <= 1
            assert sum(r["text"] == "other words under the same id " * 9 for r in kept) == 1
        if name == "benchmark decontamination":
            assert sum(r["text"] is None for r in kept) == 2 and sum(r["doc_id"] == 99_998 for r in kept) == 1
        assert stage(spark, frame.limit(0), SF).isEmpty()
