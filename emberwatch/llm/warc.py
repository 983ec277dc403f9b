"""WARC archives: writing with revisit records, reading, and assembly of captures.

Every capture is three records, a request, a response (or a revisit of an equal payload) and metadata;
the first and last name the middle one as concurrent. Archives are gzipped text files written by
Spark's own writer, a record per row with WARC's record end as line separator, so they can lie in any store
that Spark reaches. Reading takes records by their Content-Length, a slice at a time.

Payloads are written by classes of size, each class with as many records a file as keep it below FILE_BYTES, unless
one record alone is larger; one of more than 2 GB can't be read back, since a row is the least that Spark reads.

Of the rows with equal payloads the one with the smallest page_id (then the smallest url) is the
response. Payloads of fewer than `least_bytes` bytes are all responses.

Defined cases: null html counts as empty; a null page_id is larger than any other and comes back as
null; a null url is written as no target; repeated rows are captures each, one of them the response; an
empty table gives no rows; columns other than page_id, url and html are not looked at.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

CRLF = "\r\n"
HTTP = CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Content-Length: "])
DATE = "1970-01-01T00:00:00Z"
#: Bytes of payload a file has at most, and what payloads of the smallest class have; each further class is 16 times larger.
FILE_BYTES, SMALL = 256 << 20, 64 << 10
#: Bytes of records that a reader makes rows of at a time.
SLICE = 16 << 20


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of SHA-1: five hexadecimal digits are four of base 32."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _payloads(pages: DataFrame) -> DataFrame:
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    df = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    return df.select("page_id", "url", "html", base32_sha1(F.encode("html", "UTF-8")).alias("digest"), F.octet_length("html").cast("long").alias("bytes"))


def _first(*more: str) -> Column:
    return F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", F.col("url").isNull().alias("no_url"), "url", *more))


def captures(pages: DataFrame, light: DataFrame, least_bytes: int = 0) -> DataFrame:
    """One row per capture: page_id, url, digest, bytes, copy, kind (response or revisit), first_id (page_id
    of the response), html (null for revisits). light: _payloads(pages) without html; payload texts are
    moved once per distinct payload."""
    rows = _payloads(pages)
    small, rows, light = rows.filter(F.col("bytes") < least_bytes), rows.filter(F.col("bytes") >= least_bytes), light.filter(F.col("bytes") >= least_bytes)
    whole = rows.groupBy("digest", "bytes").agg(_first("html").alias("f"))
    responses = whole.select("f.page_id", "f.url", "digest", "bytes", F.lit(0).alias("copy"), F.lit("response").alias("kind"), F.col("f.page_id").alias("first_id"), "f.html")
    first = light.groupBy("digest").agg(_first().alias("f")).select("digest", F.col("f.page_id").alias("first_id"), F.col("f.url").alias("first_url"))
    light = light.groupBy("page_id", "url", "digest", "bytes").agg(F.count(F.lit(1)).cast("int").alias("n"))
    is_first = F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("url").eqNullSafe(F.col("first_url"))
    others = light.join(first, "digest").withColumn("from", is_first.cast("int")).filter(F.col("from") < F.col("n"))
    others = others.withColumn("copy", F.explode(F.sequence(F.col("from"), F.col("n") - 1)))
    revisits = others.select("page_id", "url", "digest", "bytes", "copy", F.lit("revisit").alias("kind"), "first_id", F.lit(None).cast("string").alias("html"), "first_url")
    out = responses.withColumn("first_url", F.col("url")).unionByName(revisits)
    if least_bytes > 0:
        alone = small.groupBy("page_id", "url", "html", "digest", "bytes").agg(F.count(F.lit(1)).cast("int").alias("n"))
        alone = alone.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        out = out.unionByName(alone.select("page_id", "url", "digest", "bytes", "copy", F.lit("response").alias("kind"), F.col("page_id").alias("first_id"), "html", F.col("url").alias("first_url")))
    return out


def _urn(page_id: Column, url: Column, digest: Column, copy: Column, kind: str) -> Column:
    own = F.md5(F.concat_ws("\n", F.coalesce(url, F.lit("")), digest, copy.cast("string")).cast("binary"))
    return F.concat(F.lit("<urn:capture:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(":"), own, F.lit(f":{kind}>"))


def _record(kind: Column | str, identity: Column, fields: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.concat(F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind), F.concat(F.lit("WARC-Record-ID: "), identity), F.lit(f"WARC-Date: {DATE}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in fields]  # null values drop the line
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), block)


def records(found: DataFrame) -> DataFrame:
    """value: the records of captures, three each."""
    page_id, url, digest, copy = map(F.col, ("page_id", "url", "digest", "copy"))
    main = _urn(page_id, url, digest, copy, "main")
    target = F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A")
    revisit = F.col("kind") == "revisit"
    http = F.concat(F.lit(HTTP), F.col("bytes").cast("string"), F.lit(CRLF * 2), F.when(revisit, "").otherwise(F.col("html")))
    common = [("WARC-Target-URI", target)]
    fields = [
        *common,
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ("WARC-Refers-To", F.when(revisit, _urn(F.col("first_id"), F.col("first_url"), digest, F.lit(0), "main"))),
        ("Content-Type", F.lit("application/http;msgtype=response")),
    ]
    asked = F.concat(F.lit("GET "), F.coalesce(target, F.lit("/")), F.lit(f" HTTP/1.1{CRLF * 2}"))
    about = F.concat(F.lit("page-id: "), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(CRLF))
    three = F.array(
        _record("request", _urn(page_id, url, digest, copy, "request"), [*common, ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/http;msgtype=request"))], asked),
        _record(F.col("kind"), main, fields, http),
        _record("metadata", _urn(page_id, url, digest, copy, "metadata"), [*common, ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/warc-fields"))], about),
    )
    return found.select(F.explode(three).alias("value"))


def write(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Archives pages under path, in a folder per class of size that there is."""
    light = cut(_payloads(pages).drop("html"))
    size = F.when(F.col("bytes") <= SMALL, 0).otherwise(F.ceil(F.log2(F.col("bytes") / SMALL) / 4)).cast("int")
    classes = light.groupBy(size.alias("size")).agg(F.max("bytes").alias("bytes")).collect() or [(0, 0)]  # ten at most
    for k, most in classes:
        lo, hi = (SMALL * 16 ** (k - 1) if k else -1), SMALL * 16**k
        some = F.octet_length(F.coalesce(F.col("html").cast("string"), F.lit("")))
        own = pages if len(classes) == 1 else pages.filter((some > lo) & (some <= hi))
        lines = records(captures(own, light.filter((F.col("bytes") > lo) & (F.col("bytes") <= hi)), least_bytes))
        per_file = max(1, FILE_BYTES // max(most, SMALL))
        lines.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(f"{path}/size={k}")


def parse(data: bytes | BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of a file, or of its bytes."""
    stream = io.BufferedReader(io.BytesIO(data) if isinstance(data, bytes) else data)
    while line := stream.readline():
        lines = [line]
        while (line := stream.readline()) not in (b"\r\n", b""):
            lines.append(line)
        if not lines[0].startswith(b"WARC/"):
            raise ValueError("no record where one should begin")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines[1:])}
        yield fields, stream.read(int(fields["content-length"]))
        stream.read(4)


def read(spark: SparkSession, path: str, *, with_payload: bool = False) -> DataFrame:
    """Rows of all records: kind, record_id, concurrent_to, refers_to, target, page_id (of metadata),
    payload_bytes, payload_digest (of what was read; of revisits as they state it), payload if asked for."""

    def framed(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]).astype({"page_id": "Int64", "payload_bytes": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf["content"]:
                rows, held = [], 0
                for f, block in parse(gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else data):
                    kind, page, n, digest, payload = f["warc-type"], None, None, None, None
                    if kind in ("response", "revisit"):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        n, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if kind == "revisit":
                            n = int(next(x for x in head.decode().split(CRLF) if x.lower().startswith("content-length:")).split(":")[1])
                            digest, payload = f["warc-payload-digest"].removeprefix("sha1:"), None
                    elif kind == "metadata":
                        said = block.decode("utf-8", "replace").partition("page-id:")[2].split(CRLF)[0].strip()
                        page = int(said) if said.lstrip("-").isdigit() else None
                    rows.append((kind, f["warc-record-id"], f.get("warc-concurrent-to"), f.get("warc-refers-to"), f.get("warc-target-uri"), page, n, digest, *([payload] if with_payload else [])))
                    held += 1024 + len(block)
                    if held > SLICE:
                        yield framed(rows)
                        rows, held = [], 0
                yield framed(rows)

    schema = "kind string, record_id string, concurrent_to string, refers_to string, target string, page_id long, payload_bytes long, payload_digest string" + ", payload binary" * with_payload
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInPandas(run, schema)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row per capture: main (its response or revisit record), request and metadata, joined
    through concurrent-to; a capture without one of the latter has null there."""
    extra = ["payload"] if "payload" in found.columns else []
    main = found.filter(F.col("kind").isin("response", "revisit")).select("record_id", F.struct("kind", "refers_to", "target", "payload_bytes", "payload_digest", *extra).alias("main"))
    request = found.filter("kind = 'request'").select(F.col("concurrent_to").alias("__r"), F.struct("record_id", "target").alias("request"))
    metadata = found.filter("kind = 'metadata'").select(F.col("concurrent_to").alias("__m"), F.struct("record_id", "page_id").alias("metadata"))
    out = main.join(request, main["record_id"] == request["__r"], "left").join(metadata, main["record_id"] == metadata["__m"], "left")
    return out.select("record_id", "main", "request", "metadata")


def round_trip(pages: DataFrame, path: str, least_bytes: int = 0) -> DataFrame:
    """Archives pages under path, reads them back and assembles the captures."""
    write(pages, path, least_bytes)
    return assemble(cut(read(pages.sparkSession, path)))
