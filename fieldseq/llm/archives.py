"""WARC archives without repeated payloads, and reading them back.

Headers are shuffled by payload digest; the first record of a digest is a response
with its payload, all others are revisit records that name it. A record is one line
of Spark's text writer whose line separator is the blank line that ends a WARC
record, so archives go to any file system Spark can write. Long payloads are written
apart, fewer to a file, so that files are bounded in bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldseq.llm.base import query, stored, table
from fieldseq.operators.skew import salted_lookup, stacked
from fieldseq.sources.tables import scratch_dir

REVISIT_BYTES = 100
RECORDS_PER_FILE, FILE_BYTES = 2000, 128 << 20
CLASS_BYTES = (0, 1 << 16, 1 << 20, 1 << 24)  # least payload of a class; files of the last hold one record
HOT_SHARE = 20_000  # keys with at least this part of all rows are looked up by broadcast
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def headers(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """One row per page: page_id, url, digest, bytes, copy, first, kind, small.

    Rows are grouped by what identifies them before they are numbered, so equal rows
    never meet in one task; `first` is the (page_id, url, copy) that is the response. Only
    payloads under `least` bytes come along, as `small`. Digests that occur once need no
    lookup; those of a 20,000th of the rows are broadcast.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    keys = ["page_id", "url", "digest", "bytes"]
    heads = stored(pages.select("page_id", "url", F.sha2(payload, 256).alias("digest"),
                                F.octet_length(payload).cast("long").alias("bytes"),
                                F.when(F.octet_length(payload) < least, payload).alias("small"))
                   .groupBy(*keys).agg(F.count("*").alias("_n"), F.min("small").alias("small")), "heads")
    me = F.struct(F.col("page_id").isNull().alias("none"), "page_id",
                  F.col("url").isNull().alias("no_url"), "url")
    firsts = stored(heads.filter(F.col("bytes") >= least).groupBy("digest")
                    .agg(F.min(me).alias("first"), F.count("*").alias("_rows"), F.sum("_n").alias("_all"))
                    .filter("_all > 1"), "firsts")
    hot = firsts.filter(F.col("_rows") >= max(heads.count() // HOT_SHARE, 1000))
    known = salted_lookup(heads, firsts, "digest", F.struct("page_id", "url"), hot, ["first"])
    same = (F.col("page_id").eqNullSafe(F.col("first.page_id"))
            & F.col("url").eqNullSafe(F.col("first.url")) & (F.col("copy") == 1))
    return (known.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n")
            .withColumn("kind", F.when(F.col("first").isNull() | same, "response")
                        .otherwise("revisit")))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _record_id(page_id: Column, url: Column, digest: Column, copy: Column) -> Column:
    """An identifier of its own for every record, equal whenever the same row is written."""
    parts = [F.coalesce(c.cast("string"), F.lit("\u0001")) for c in (page_id, url, digest, copy)]
    h = F.sha2(F.concat_ws("\u0000", *parts), 256)
    cut = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cut]), F.lit(">"))


def _clean(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(url, F.lit("")), "[\r\n]", "")


def records(heads: DataFrame, pages: DataFrame, written_at: str, least: int = REVISIT_BYTES) -> DataFrame:
    """The text of the WARC records of these headers, without the blank lines that end them.

    Payloads are joined to the one response of their digest only; revisits and small
    responses take no part in that join.
    """
    full = (F.col("kind") == "response") & F.col("small").isNull()
    payloads = (pages.select(F.col("html").alias("payload")).filter(F.octet_length("payload") >= least)
                .withColumn("digest", F.sha2("payload", 256)).dropDuplicates(["digest"]))
    both = stacked([heads.filter(full).join(payloads, "digest"),
                    heads.filter(~full).withColumn("payload", F.coalesce("small", F.lit("")))])
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                          "Content-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.col("payload"))
    origin = _record_id(F.col("first.page_id"), F.col("first.url"), F.col("digest"), F.lit(1))
    revisit = F.concat(_line("WARC-Profile", F.lit(_PROFILE)), _line("WARC-Refers-To", origin),
                       _line("WARC-Refers-To-Target-URI", _clean(F.col("first.url"))),
                       _line("WARC-Refers-To-Date", F.lit(written_at)))
    return both.select(F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", F.col("kind")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("url"), F.col("digest"), F.col("copy"))),
        _line("WARC-Page-ID", page),
        _line("WARC-Target-URI", _clean(F.col("url"))), _line("WARC-Date", F.lit(written_at)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(F.col("kind") == "revisit", revisit).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"), block).alias("value"))


def write_archives(pages: DataFrame, path: str, written_at: str | None = None, least: int = REVISIT_BYTES,
                   per_file: int = RECORDS_PER_FILE, file_bytes: int = FILE_BYTES) -> None:
    """Write deduplicated, gzipped archives to the new folder `path`.

    Null payloads are empty; a null url or page id becomes an empty header value.
    Payloads under `least` bytes are always responses. Records are dated `written_at`, by
    default now. A file has at most `per_file` records and about `file_bytes` of payload,
    but for single payloads that are longer: the classes of payload sizes are written one
    after another, each from its own pages only.
    """
    if written_at is None:
        written_at = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    size = F.when(F.col("kind") == "response", F.col("bytes")).otherwise(0)
    of = F.lit(0)
    for k, lowest in enumerate(CLASS_BYTES[1:], 1):
        of = F.when(size >= lowest, k).otherwise(of)
    heads = stored(headers(pages, least).withColumn("class", of), "records")
    classes = sorted(r[0] for r in heads.select("class").distinct().collect()) or [0]
    for k in classes:
        lowest, last = CLASS_BYTES[k], k + 1 == len(CLASS_BYTES)
        mine = pages.filter(F.octet_length("html") >= lowest)
        if not last:
            mine = mine.filter(F.octet_length("html") < CLASS_BYTES[k + 1])
        most = 1 if last else max(1, min(per_file, file_bytes // CLASS_BYTES[k + 1]))
        (records(heads.filter(F.col("class") == k).drop("class"), mine, written_at, least)
         .write.mode("errorifexists" if k == classes[0] else "append").option("lineSep", "\r\n\r\n")
         .option("compression", "gzip").option("maxRecordsPerFile", most).text(path))


def _parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an uncompressed archive: headers and block, cut by Content-Length."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "")
                    for line in lines[1:])
        start = end + 4
        stop = start + int(head["Content-Length"])
        yield head, data[start:stop]
        if data[stop:stop + 4] != b"\r\n\r\n":
            raise ValueError("record does not end with two line breaks")
        at = stop + 4


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import hashlib
    for files in batches:
        for content in files["content"]:
            rows = []
            for head, block in _parse(zlib.decompress(content, 31)):
                payload = block[block.index(b"\r\n\r\n") + 4:]
                kind = head["WARC-Type"]
                digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError("payload does not match its digest")
                rows.append((head["WARC-Page-ID"] or None, head["WARC-Record-ID"], head["WARC-Target-URI"], kind,
                             digest, len(payload) if kind == "response" else None, head.get("WARC-Refers-To"),
                             payload.decode("utf-8") if kind == "response" else None))
            yield pd.DataFrame(rows, columns=["page", "record_id", "url", "record_type", "digest", "size",
                                              "origin", "html"], dtype=object)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records: page_id, record_id, url, record_type, payload_digest, payload_bytes, origin, html.

    html and payload_bytes are null for revisits; `origin` is the record they refer to.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
             .select("content"))
    return files.mapInPandas(_read, "page string, record_id string, url string, record_type string, digest string, "
                             "size long, origin string, html string").select(
        F.col("page").cast("long").alias("page_id"), "record_id", "url", "record_type",
        F.col("digest").alias("payload_digest"), F.col("size").alias("payload_bytes"), "origin", "html")


def resolve_revisits(records_: DataFrame) -> DataFrame:
    """Join revisits to the original responses: their payload size and `refers_to`, the original's page.

    Record headers are kept once. Only originals that are referred to are looked up, and
    those with a 20,000th of all records behind them by broadcast.
    """
    heads = stored(records_.drop("html"), "record_heads")
    asked = heads.filter("record_type = 'revisit'").groupBy("origin").agg(F.count("*").alias("_rows"))
    originals = stored(
        heads.filter("record_type = 'response'")
        .select(F.col("record_id").alias("origin"), F.col("payload_bytes").alias("_bytes"),
                F.col("page_id").alias("refers_to")).join(asked, "origin"), "originals")
    hot = originals.filter(F.col("_rows") >= max(heads.count() // HOT_SHARE, 1000))
    revisits = salted_lookup(heads.filter("record_type = 'revisit'"), originals, "origin", F.col("record_id"),
                             hot, ["_bytes", "refers_to"])
    return stacked([
        heads.filter("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")),
        revisits.withColumn("payload_bytes", F.col("_bytes")).drop("_bytes")])


@query("op8_warc_revisits", """
  with h as (select page_id, strlen(coalesce(html, '')) as payload_bytes,
                    sha256(coalesce(html, '')) as payload_digest from pages),
  f as (select payload_digest, min(page_id) as first from h where payload_bytes >= 100 group by 1)
  select page_id, payload_bytes, payload_digest,
    case when first is null or first = page_id then 'response' else 'revisit' end as record_type,
    case when first <> page_id then first end as refers_to
  from h left join f using (payload_digest)""")
def op8_warc_revisits(spark, sf_dir: str) -> DataFrame:
    import uuid
    path = f"{scratch_dir(spark)}/archives-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    return resolve_revisits(read_archives(spark, path)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
