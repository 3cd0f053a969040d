"""WARC archives: writing records and reading them back by boundary chains.

Records are written with the text sink, so any file system of the cluster will do:
a row is one record and the line separator supplies the last byte of its trailer.

Reading takes no record boundary on trust. The text source splits the files at the
magic, wherever it stands, also inside payloads; the splits are read in parallel and
the pieces' absolute offsets follow from running totals. Each piece whose header is
well formed is a candidate: an edge from its offset to that of its successor, which
the declared length gives. Pointer jumping from offset 0 of every file, first within
the blocks that were read together and then from block to block, doubles its reach in
each round; what it doesn't reach is payload and is joined back to the record it lies in.

Edge cases: a null html is an empty payload; a null url is left out of the record;
line breaks in a url are percent-encoded; of equal payloads the largest page_id is
the response, all rows with that id are, and null ids refer to it;
repeated rows are a record each; very long payloads are one record like any other, as long as
a row can hold them; other columns are ignored; a table without rows gives no records.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import delete, materialise, scratch, table, utf8

MAGIC = "WARC/1.0\r\n"
EMPTY_LINE = "\r\n\r\n"
#: Payloads of fewer bytes are always written in full.
MIN_REVISIT_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload):
    """Upper-case base32 of the SHA-1: five hexadecimal digits are four base32 digits."""

    def digits(digest):
        out = []
        for k in range(8):
            number = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
            for shift in (15, 10, 5, 0):
                out.append(F.substring(F.lit(ALPHABET), F.shiftright(number, shift).bitwiseAND(31) + 1, F.lit(1)))
        return F.concat(*out)

    # Bound by a lambda, so that the payload is hashed once and not for every digit.
    return F.transform(F.array(F.sha1(payload)), digits)[0]


def with_record_types(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Adds payload_digest, payload_bytes, record_type and refers_to."""
    rows = pages.withColumns({"payload_digest": base32_sha1(utf8("html")), "payload_bytes": F.octet_length(utf8("html")).cast("long")})
    same = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    rows = rows.join(same.where("_n > 1").drop("_n"), "payload_digest", "left")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first")) & (F.col("payload_bytes") >= min_bytes)
    return rows.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("_first"))).drop("_first")


def _record_id(page):
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(">"))


def records(typed: DataFrame) -> DataFrame:
    """One string per record, without its very last byte."""
    crlf = "\r\n"
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    # Payload bytes pass through as they are; Spark's strings are bytes.
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(crlf + crlf))
    is_response = F.col("record_type") == "response"
    block = F.when(is_response, F.concat(http, F.coalesce("html", F.lit("")))).otherwise(F.lit(""))
    length = F.when(is_response, F.col("payload_bytes") + F.octet_length(http)).otherwise(F.lit(0))
    header = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.col("record_type"),
        F.lit(f"{crlf}WARC-Record-ID: "), _record_id(F.col("page_id")),
        F.coalesce(F.concat(F.lit(f"{crlf}WARC-Refers-To: "), F.when(~is_response, _record_id(F.col("refers_to")))), F.lit("")),
        F.coalesce(F.concat(F.lit(f"{crlf}WARC-Target-URI: "), url), F.lit("")),
        F.lit(f"{crlf}WARC-Date: {DATE}{crlf}WARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.lit(f"{crlf}X-Payload-Bytes: "), F.col("payload_bytes").cast("string"),
        F.lit(f"{crlf}Content-Length: "), length.cast("string"), F.lit(crlf + crlf),
    )
    return typed.select(F.concat(header, block, F.lit(f"{crlf}{crlf}"[:-1])).alias("value"))


def write(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Archives under path, one per partition; gzip-compressed as a whole."""
    records(with_record_types(pages, min_bytes)).write.option("lineSep", "\n").option("compression", "gzip").text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between magics, in order of ``seq`` within a block of a file."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value"),
    )


def _field(name: str, pattern: str):
    return F.regexp_extract("head", rf"(?i)(?:^|\r\n){name}: *({pattern})(?:\r\n|$)", 1)


def _with_fields(raw: DataFrame) -> DataFrame:
    rows = raw.withColumn("size", F.octet_length("value").cast("long")).withColumn("_h", F.substring_index("value", EMPTY_LINE, 1))
    rows = rows.withColumn("head", F.when(F.octet_length("_h") < F.col("size"), F.col("_h"))).drop("_h")
    rows = rows.withColumn("length", _field("Content-Length", "[0-9]{1,15}").try_cast("long")).withColumn("body", F.octet_length("head").cast("long") + len(EMPTY_LINE))
    whole = F.coalesce(F.col("size") == F.col("body") + F.col("length") + len(EMPTY_LINE), F.lit(False))
    rows = rows.withColumns({"whole": whole, "kind": _field("WARC-Type", "[a-z]+")})
    block = F.substring(F.col("value").cast("binary"), (F.col("body") + 1).cast("int"), F.col("length").cast("int"))
    # Bound by a lambda, so that the payload is cut out once for both.
    read = F.transform(F.array(payload_of(block)), lambda p: F.struct(base32_sha1(p).alias("digest"), F.octet_length(p).cast("long").alias("taken")))[0]
    return rows.withColumn("_read", F.when(F.col("whole") & (F.col("kind") == "response"), read)).select(*[c for c in rows.columns if c != "value"], "_read.digest", "_read.taken")


def payload_of(block):
    """What follows the HTTP header of a response block."""
    skip = F.octet_length(F.substring_index(block.cast("string"), EMPTY_LINE, 1)) + len(EMPTY_LINE)
    return F.substring(block, skip + 1, F.octet_length(block))


BLOCK_EDGES = "file string, block long, node long, next long"


def _ends(nodes: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Per candidate of one block, sorted by offset, where its chain leaves the block: pointers of doubling length."""
    at = np.searchsorted(nodes, following)
    inside = (at < len(nodes)) & (nodes[np.minimum(at, len(nodes) - 1)] == following) if len(nodes) else np.zeros(0, bool)
    to, end = np.where(inside, at, np.arange(len(nodes))), following.copy()
    while True:
        further = to[to]
        end = end[to]
        if (further == to).all():
            return end
        to = further


def _reachable(nodes: np.ndarray, following: np.ndarray, entered: np.ndarray) -> np.ndarray:
    """Which candidates of one block the entered ones lead to; marks spread over pointers of doubling length."""
    at = np.searchsorted(nodes, following)
    inside = (at < len(nodes)) & (nodes[np.minimum(at, len(nodes) - 1)] == following)
    to, mark = np.where(inside, at, np.arange(len(nodes))), entered.copy()
    while True:
        mark[to[mark]] = True
        further = to[to]
        if (further == to).all():
            return mark
        to = further


def _chain(candidates: DataFrame) -> DataFrame:
    """(file, node) of the candidates (file, block, node, next) that are reachable from offset 0 of their file.

    Within a block of a file the chains are followed in one task. Between blocks only the
    candidates that another block's chain lands on matter; pointer jumping over those
    doubles the number of blocks that are crossed in each round.
    """

    def leave(t):
        t = t.sort_by("node")
        nodes, following = (t.column(c).to_numpy().astype(np.int64) for c in ("node", "next"))
        return t.set_column(t.schema.get_field_index("next"), "next", pa.array(_ends(nodes, following)))

    def enter(t):
        t = t.sort_by("node")
        nodes, following = (t.column(c).to_numpy().astype(np.int64) for c in ("node", "next"))
        return t.select(["file", "node"]).filter(pa.array(_reachable(nodes, following, t.column("entered").to_numpy(zero_copy_only=False))))

    over = candidates.groupBy("file", "block").applyInArrow(leave, BLOCK_EDGES)
    over = materialise(over)
    landed = over.select("file", F.col("next").alias("node")).distinct().join(over.select("file", "node", "next"), ["file", "node"])
    jump = materialise(over.where("node = 0").select("file", "node", "next").union(landed.where("node > 0")))
    known, entries = jump.select("file", "node"), jump.where("node = 0").select("file", "node")
    n = 0
    while not jump.isEmpty():
        further = entries.join(jump, ["file", "node"]).select("file", F.col("next").alias("node")).join(known, ["file", "node"], "left_semi")
        entries = materialise(entries.union(further).distinct())
        now = entries.count()
        if now == n:
            break
        n = now
        ahead = jump.select("file", F.col("node").alias("next"), F.col("next").alias("_after"))
        jump = materialise(jump.join(ahead, ["file", "next"]).select("file", "node", F.col("_after").alias("next")))
    flagged = candidates.join(entries.withColumn("_e", F.lit(True)), ["file", "node"], "left").withColumn("entered", F.coalesce("_e", F.lit(False))).drop("_e")
    return materialise(flagged.select("file", "block", "node", "next", "entered").groupBy("file", "block").applyInArrow(enter, "file string, node long"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under path: file, node (its offset), head, kind and, of responses, digest and bytes taken of the payload read."""
    keys = ["file", "block", "seq"]
    described = materialise(_with_fields(_pieces(spark, path)))
    sizes = described.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("taken"), F.min("seq").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sizes.select("file", "block", "first", F.coalesce(F.sum("taken").over(before), F.lit(0).cast("long")).alias("start"))
    within = Window.partitionBy("file", "block").orderBy("seq")
    local = F.coalesce(F.sum(F.col("size") + len(MAGIC)).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    # A piece that starts at byte s follows the magic at s - len(MAGIC).
    nodes = described.withColumn("_local", local).join(blocks, ["file", "block"])
    nodes = nodes.withColumn("node", F.col("start") + F.col("_local") - len(MAGIC)).withColumn("at", F.col("seq") - F.col("first"))
    nodes = materialise(nodes.drop("start", "first", "_local").where("node >= 0"))
    ends = F.col("node") + len(MAGIC) + F.col("body") + F.col("length") + len(EMPTY_LINE)
    reached = _chain(nodes.where("length is not null and kind <> ''").select("file", "block", "node", ends.alias("next")))
    found = nodes.join(reached, ["file", "node"], "left_semi")
    out = found.where("whole").select("file", "node", "head", "kind", "digest", "taken")
    split = found.where("not whole").select("file", "node", (F.col("node") + len(MAGIC) + F.col("body") + F.col("length") + len(EMPTY_LINE)).alias("next"), "head", "kind", "body", "length")
    if split.isEmpty():
        return out
    return out.unionByName(_joined(spark, path, nodes, reached, split, keys))


def _joined(spark: SparkSession, path: str, nodes: DataFrame, reached: DataFrame, split: DataFrame, keys: list[str]) -> DataFrame:
    """Records whose payload holds the magic: their pieces are fetched again and put together."""
    starts = reached.withColumn("_start", F.col("node"))
    marked = nodes.join(starts, ["file", "node"], "left").select("file", "block", "at", "node", "_start")
    inner = Window.partitionBy("file", "block").orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = marked.groupBy("file", "block").agg(F.max("_start").alias("_last"))
    carry = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select("file", "block", F.max("_last").over(carry).alias("_carried"))
    owned = marked.withColumn("_in", F.max("_start").over(inner)).join(last, ["file", "block"])
    owned = owned.select("file", "block", "at", "node", F.coalesce("_in", "_carried").alias("owner"))
    wanted = owned.join(split.select("file", F.col("node").alias("owner")), ["file", "owner"], "left_semi")
    raw = _pieces(spark, path)
    firsts = raw.groupBy("file", "block").agg(F.min("seq").alias("first"))
    wanted = wanted.join(firsts, ["file", "block"]).select(*keys[:2], (F.col("at") + F.col("first")).alias("seq"), "node", "owner")
    parts = raw.join(wanted, keys).groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("node", F.col("value").cast("binary").alias("b")))).alias("parts"))
    magic = F.lit(MAGIC.encode())
    whole = F.aggregate(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), F.col("parts")[0]["b"], lambda a, x: F.concat(a, magic, x["b"]))
    rows = split.join(parts.withColumnRenamed("owner", "node").withColumn("bytes", whole), ["file", "node"])
    block = F.substring(F.col("bytes"), (F.col("body") + 1).cast("int"), F.col("length").cast("int"))
    response = F.col("kind") == "response"
    return rows.select("file", "node", "head", "kind", F.when(response, base32_sha1(payload_of(block))).alias("digest"), F.when(response, F.octet_length(payload_of(block)).cast("long")).alias("taken"))


def described_records(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and whether the payload read has the digest that was written.

    Bytes and digest of a response are those of the payload that was read; a revisit has no payload but its header's.
    """
    page = r"<urn:x-page:(-?[0-9]+)>"
    id_ = lambda name: F.regexp_extract("head", rf"(?i)(?:^|\r\n){name}: *{page}(?:\r\n|$)", 1).try_cast("long")
    written = F.regexp_extract("head", r"(?:^|\r\n)WARC-Payload-Digest: *sha1:([A-Z2-7]{32})(?:\r\n|$)", 1)
    return found.select(
        id_("WARC-Record-ID").alias("page_id"),
        F.coalesce("taken", _field("X-Payload-Bytes", "[0-9]+").try_cast("long")).alias("payload_bytes"),
        F.coalesce("digest", written).alias("payload_digest"),
        F.col("kind").alias("record_type"),
        id_("WARC-Refers-To").alias("refers_to"),
        (F.col("digest").isNull() | (F.col("digest") == written)).alias("verified"),
    )


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/warc-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    out = materialise(described_records(read(spark, path)))
    delete(spark, path)
    return out


#: Base32 by five bits: the 160 bits of the SHA-1 are 32 digits.
ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
         array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((('0x' || substr(h, (k // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)::INT + 1, 1)), '') AS payload_digest
  FROM p
), m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to, true AS verified
FROM m
"""
