"""WARC archives with repeated payloads stored once.

Each row becomes a record with an identity of its own. Only headers (digest, identity, length)
are shuffled by payload digest; the smallest identity of each digest stays a response, the
others become revisits that name it. Revisits that came in an archive take part with the digest
they carry. Payloads move once, by record identity, so copies of one payload do not meet in one
task, and those of revisits stay behind. Archives are written and read by Spark's own text and
binary file formats, so any store that Spark reaches holds them; a file has some 16 MB of
records. Reading goes record by record and checks every digest.

Defined cases: a null payload is the empty one; payloads below ``least_bytes`` are all responses;
of repeated rows with the same smallest identity one is the response and the others revisit it;
null identities come after all others; line breaks in an address are escaped, a null address gives
no header; payloads may hold what looks like a record; an empty table gives an archive without
records; other columns do not travel.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.settle import settled, shuffles_dropped
from auditlake.plans.sized import is_small, salted_join
from auditlake.session import fresh_path

LEAST_BYTES = 100
#: Bytes of payload for each file of an archive, and of records for each frame that a reader hands on.
FILE_BYTES, FRAME_BYTES = 1 << 24, 1 << 22
#: A digest of more records than this is dealt to several tasks.
HOT_ROWS = 100_000

# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BREAK = "\r\n"
IDENTITY = "X-Row-Identity"
_KIND = (
    "record_id string, identity string, record_type string, target_uri string, date string, payload_digest string, "
    "payload_bytes bigint, refers_to string, payload binary, digest_ok boolean"
)


def as_records(df: DataFrame, identity: str, url: str, payload: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """A response per row, with a fresh ``record_id``; written to the shared folder, for the identities are random."""
    body = F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit(""))
    made = df.select(
        F.concat(F.lit("urn:uuid:"), F.uuid()).alias("record_id"),
        F.col(f"`{identity}`").alias("identity"),
        F.lit("response").alias("record_type"),
        F.col(f"`{url}`").cast("string").alias("target_uri"),
        F.lit(date).alias("date"),
        F.sha2(body, 256).alias("payload_digest"),
        F.octet_length(body).cast("bigint").alias("payload_bytes"),
        F.lit(None).cast("string").alias("refers_to"),
        body.alias("payload"),
    )
    path = fresh_path(df.sparkSession, "warc-records")
    made.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(made.schema).parquet(path)


def originals(records: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``record_id, refers_to`` of the records whose payload another record keeps; headers only."""
    heads = records.filter(F.col("payload_bytes") >= least_bytes).select(
        "record_id", "payload_digest", (F.col("record_type") == "response").alias("_has"), F.col("identity").isNull().alias("_null"), "identity"
    )
    first = F.min(F.when(F.col("_has"), F.struct("_null", "identity", "record_id")))["record_id"]
    kept = heads.groupBy("payload_digest").agg(F.count(F.lit(1)).alias("_n"), first.alias("refers_to"))
    kept = kept.filter((F.col("_n") > 1) & F.col("refers_to").isNotNull()).drop("_n")
    named = salted_join(heads.select("record_id", "payload_digest"), kept, ["payload_digest"], "inner", HOT_ROWS)
    return named.filter(F.col("record_id") != F.col("refers_to")).select("record_id", "refers_to")


def deduplicated(records: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """The records with each payload kept once, dealt out evenly for :func:`write_archive`."""
    size = records.agg(F.coalesce(F.sum("payload_bytes"), F.lit(0)).alias("n")).first()["n"]
    files = max(1, -(-size // FILE_BYTES))
    found = settled(originals(records, least_bytes).withColumnRenamed("refers_to", "_original"), "warc-revisits")
    # A record identity is met once on both sides, so the shuffle is even; few revisits go to the records instead.
    if is_small(found):
        joined = records.join(F.broadcast(found), "record_id", "left")
    else:
        joined = records.repartition(files, "record_id").join(found.repartition(files, "record_id"), "record_id", "left")
    again = F.col("_original").isNotNull()
    done = joined.select(
        "record_id", "identity",
        F.when(again, "revisit").otherwise(F.col("record_type")).alias("record_type"),
        "target_uri", "date", "payload_digest", "payload_bytes",
        F.coalesce("_original", "refers_to").alias("refers_to"),
        F.when(~again, F.col("payload")).alias("payload"),
    )
    return done.repartition(files, "record_id")


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value)


def write_archive(records: DataFrame, path: str) -> str:
    """Write records as compressed archives, a file for each partition; revisits have no payload."""
    line = F.lit(BREAK)
    http = F.concat_ws(BREAK, F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), _header("Content-Length", F.col("payload_bytes").cast("string")))
    block = F.concat(http, line, line, F.coalesce(F.col("payload").cast("string"), F.lit("")))
    revisit = F.col("record_type") == "revisit"
    uri = F.replace(F.replace(F.col("target_uri"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    made = records.withColumn("_block", block)
    head = F.concat_ws(
        BREAK,
        F.lit(VERSION),
        _header("WARC-Type", F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: <"), F.col("record_id"), F.lit(">")),
        _header("WARC-Date", F.col("date")),
        _header("WARC-Target-URI", uri),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <"), F.col("refers_to"), F.lit(">"))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        _header(IDENTITY, F.col("identity").cast("string")),
        F.lit("Content-Type: application/http;msgtype=response"),
        _header("Content-Length", F.octet_length("_block").cast("string")),
    )
    # Spark ends each row with the separator, which is the end of a record.
    with shuffles_dropped(records.sparkSession):
        made.select(F.concat(head, line, line, F.col("_block")).alias("value")).write.option("lineSep", BREAK * 2).option("compression", "gzip").text(path)
    return path


def _heads(stream: io.BufferedIOBase) -> dict[str, str]:
    """Named fields up to the blank line."""
    fields = {}
    while line := stream.readline().rstrip(b"\r\n"):
        name, _, value = line.decode("utf-8").partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields


def parse_archive(data: bytes, payloads: bool = True) -> Iterator[tuple]:
    """Records of one archive file in the order of the columns of :func:`read_archive`; raises where the format is broken."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    with io.BufferedReader(stream) as source:
        while version := source.readline():
            if not version.strip():
                continue
            if not version.startswith(b"WARC/"):
                raise ValueError(f"no record starts with {version[:40]!r}")
            fields = _heads(source)
            size = int(fields["content-length"])
            block = source.read(size)
            if len(block) != size or source.read(4) != b"\r\n\r\n":
                raise ValueError(f"record {fields.get('warc-record-id')} does not end where it says")
            kind = fields["warc-type"]
            if kind not in ("response", "revisit"):
                continue
            http, _, payload = block.partition(b"\r\n\r\n")
            told = _heads(io.BytesIO(http.partition(b"\r\n")[2] + b"\r\n"))
            digest = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
            whole = kind == "response"
            length = len(payload) if whole else int(told["content-length"]) if "content-length" in told else None
            refers = fields.get("warc-refers-to")
            yield (
                fields["warc-record-id"].strip("<>"), fields.get(IDENTITY.lower()), kind, fields.get("warc-target-uri"), fields.get("warc-date"),
                digest, length, refers.strip("<>") if refers else None, payload if whole and payloads else None,
                hashlib.sha256(payload).hexdigest() == digest if whole else None,
            )


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Responses and revisits of all archive files below a path.

    ``payload`` is null for revisits, and for all where ``payloads`` is false; ``digest_ok`` says whether
    a payload has the digest of its header.
    """
    names = [f.split()[0] for f in _KIND.split(", ")]

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for data in frame["content"]:
                rows, size = [], 0
                for record in parse_archive(data, payloads):
                    rows.append(record)
                    size += 1_000 + len(record[8] or b"")
                    if size > FRAME_BYTES:
                        yield pd.DataFrame(rows, columns=names)
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, _KIND)


def resolved(heads: DataFrame) -> DataFrame:
    """Records with ``original`` and ``original_ok``: for revisits, the identity of the response they name and whether it
    has the digest and length they carry (false where there is none). Payloads are not needed."""
    kept = heads.filter(F.col("record_type") == "response").select(
        F.col("record_id").alias("refers_to"), F.col("identity").alias("original"),
        F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes"),
    )
    again = heads.filter(F.col("record_type") == "revisit")
    joined = salted_join(again, kept, ["refers_to"], "left", HOT_ROWS)
    fits = F.coalesce((F.col("_digest") == F.col("payload_digest")) & F.col("_bytes").eqNullSafe(F.col("payload_bytes")), F.lit(False))
    found = joined.withColumn("original_ok", fits).select(*heads.columns, "original", "original_ok")
    whole = heads.filter(F.col("record_type") == "response")
    return whole.withColumns({"original": F.lit(None).cast("string"), "original_ok": F.lit(None).cast("boolean")}).unionByName(found)
