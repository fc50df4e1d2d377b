"""WARC archives: writing, reading, and replacing repeated payloads by revisit records.

Records are written and read with Spark's text source, so archives may lie wherever Spark reaches: a
record's end, two line ends, is the line separator on writing, and the version line is it on reading.
Archive files are compressed as a whole, so one task reads a file from its start; a payload that holds the
version line itself is put together again by its Content-Length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.stored import shared_path, stored
from .common import attach, probed_repeats, repeats

# The format's version line, the revisit profile and the base32 letters.
VERSION = "WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
NAME = "urn:x-page:"
RECORDS_A_FILE = 100_000


def digest(payload: Column) -> Column:
    """Upper-case base32 of the payload's SHA-1: twenty bits, five hexadecimal digits, make four letters."""
    hexed = F.sha1(payload)
    letters = []
    for part in range(8):
        bits = F.conv(F.substring(hexed, 5 * part + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(bits, 15 - 5 * k).bitwiseAND(F.lit(31)) + F.lit(1), F.lit(1)) for k in range(4)]
    return F.concat(*letters)


def resolve(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Records (id, url, payload, payload_digest, record_type, refers_to, refers_to_url) of pages.

    Of equal payloads the one with the smallest id is the response, others revisit it; a null payload is
    the empty one. Only headers (id, url, digest) of possibly repeated payloads are grouped, by digest; pages whose
    payload occurs once stay where they are. A null id never wins against another; rows with the same id and
    payload are marked alike, rows with the same id and other payloads each by their payload. Payloads may be
    text or bytes, of any length. An empty table gives an empty result; other columns of pages are not read.
    """
    payload = F.col(payload_col).cast("string") if dict(pages.dtypes)[payload_col] == "binary" else F.col(payload_col)
    full = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(payload, F.lit("")).alias("payload"))
    full = full.withColumn("payload_digest", digest(F.col("payload"))).withColumn("tw_h", F.xxhash64("payload_digest"))
    headers = stored(full.select("id", "url", "payload_digest", "tw_h"), "headers")
    bloom, words = repeats(headers, "tw_h")
    groups = probed_repeats(headers, "tw_h", bloom, words).where("tw_maybe").groupBy("payload_digest")
    groups = stored(groups.agg(F.min("id").alias("first"), F.min_by("url", "id").alias("first_url"), F.count("*").alias("size")).where("size > 1"), "groups")
    tried = probed_repeats(full, "tw_h", bloom, words).drop("tw_h")
    alone = tried.where(~F.col("tw_maybe")).withColumns({"first": F.lit(None).cast(full.schema["id"].dataType), "first_url": F.lit(None).cast("string"), "size": F.lit(1).cast("long")}).drop("tw_maybe")
    again = attach(tried.where("tw_maybe").drop("tw_maybe"), groups, "payload_digest", "size", headers.count())
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    return alone.unionByName(again).select(
        "id", "url", "payload", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
        F.when(revisit, F.col("first_url")).alias("refers_to_url"),
    )


def _uri(id_: Column) -> Column:
    return F.concat(F.lit(f"<{NAME}"), F.coalesce(id_.cast("string"), F.lit("")), F.lit(">"))


def write(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes records, as :func:`resolve` gives them, with fresh headers; a revisit holds no payload.

    Nulls: a record without url has no target line, one without id an empty name. Line ends in urls are left
    out. Files are cut by number of records; each is compressed as a whole, as Spark's writers do. An empty table
    gives a folder without records.
    """
    revisit = F.col("record_type") == "revisit"
    block = F.concat(F.lit(HTTP), F.when(revisit, "").otherwise(F.col("payload")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    maybe = lambda name, value: F.coalesce(line(name, F.regexp_replace(value, r"[\r\n]", "")), F.lit(""))
    header = F.concat(
        F.lit(VERSION),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _uri(F.col("id"))),
        line("WARC-Date", F.lit(date)),
        maybe("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _uri(F.col("refers_to"))), maybe("WARC-Refers-To-Target-URI", F.col("refers_to_url")), line("WARC-Refers-To-Date", F.lit(date)))).otherwise(""),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    records.select(F.concat(header, block).alias("value")).write.options(lineSep="\r\n\r\n", compression="gzip", maxRecordsPerFile=RECORDS_A_FILE).text(path)


def _records(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (by lower-case name) and block of each record, from what stands between version lines."""
    for part in parts:
        if not part:
            continue
        head, _, rest = part.partition(b"\r\n\r\n")
        fields = {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n"))}
        need = int(fields["content-length"])
        pieces, have = [rest], len(rest)
        while have < need + 4:
            more = next(parts)
            pieces += [VERSION.encode(), more]
            have += len(VERSION) + len(more)
        yield fields, b"".join(pieces)[:need]


def _payload(kind: str, fields: dict[str, str], block: bytes) -> bytes | None:
    """What a record holds below its HTTP header; None for revisits, which hold none."""
    if kind == "revisit":
        return None
    return block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block


def read(spark: SparkSession, path: str, payloads: bool = True, id_type: str = "long", kinds: tuple[str, ...] = ("response", "revisit", "resource")) -> DataFrame:
    """Records of the archives in a folder: id, url, record_type, refers_to, payload_digest, payload_bytes and,
    with payloads, payload (binary; null for revisits, as is payload_bytes).

    Records of other kinds (`warcinfo`, `request`, ...) are passed over. A record without a payload digest gets
    its payload's; one whose payload differs from its SHA-1 stops the job, digests of other kinds are replaced.
    A folder without records gives an empty result. One record is held at a time.
    """
    schema = f"id string, url string, record_type string, refers_to string, payload_digest string, payload_bytes long{', payload binary' if payloads else ''}"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            types = [pa.string()] * 5 + [pa.int64()] + [pa.binary()] * payloads
            names = ["id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"][: len(types)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=False)], names=names)

        for fields, block in _records(v for b in batches for v in b.column(0).to_pylist()):
            kind, said = fields["warc-type"], fields.get("warc-payload-digest")
            if kind not in kinds:
                continue
            payload = _payload(kind, fields, block)
            if payload is not None:
                own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                if said and said.startswith("sha1:") and said != f"sha1:{own}":
                    raise ValueError(f"the payload of {fields.get('warc-record-id')} is damaged")
                said = own
            name = lambda k: (fields[k].removeprefix(f"<{NAME}").removeprefix("<").removesuffix(">") or None) if k in fields else None  # noqa: B023, E731
            rows.append((name("warc-record-id"), fields.get("warc-target-uri"), kind, name("warc-refers-to"), (said or "").removeprefix("sha1:") or None, None if payload is None else len(payload), payload))
            held += len(block)
            if len(rows) >= 5000 or held > 16 << 20:
                yield flush()
                rows, held = [], 0
        if rows:
            yield flush()

    lines = spark.read.option("lineSep", VERSION).text(path).select(F.col("value").cast("binary").alias("value"))
    typed = {c: F.col(c).try_cast(id_type) for c in ("id", "refers_to")}
    return lines.mapInArrow(parse, schema).withColumns(typed)


def with_originals(records: DataFrame, columns: list[str]) -> DataFrame:
    """Records whose revisits have the named columns from an original with the same payload digest.

    Revisits and originals are joined by digest, so ids that several records share do no harm; of originals with
    the same digest one is taken, as their payloads are equal. A revisit without a digest or an original keeps
    nulls. Digests that very many records revisit are broadcast, at most a fixed number of them.
    """
    revisits = records.where("record_type = 'revisit'")
    rest = records.where("record_type <> 'revisit'")
    weights = revisits.groupBy("payload_digest").agg(F.count("*").alias("tw_n"))
    originals = rest.select("payload_digest", *columns).join(weights, "payload_digest").dropDuplicates(["payload_digest"])
    joined = attach(revisits.drop(*columns), stored(originals, "originals"), "payload_digest", "tw_n", revisits.count()).drop("tw_n")
    return rest.unionByName(joined.select(*records.columns))


def deduplicate(spark: SparkSession, source: str, target: str, id_type: str = "long") -> None:
    """Reads archives, resolves their revisits to the original responses, and writes them deduplicated anew.

    Payloads are bytes throughout and need not be text. A revisit whose original is not among the archives
    stops the job, since its payload is not known. Ids that are not of the type asked for become null.
    """
    records = with_originals(stored(read(spark, source, id_type=id_type), "records"), ["payload", "payload_bytes"])
    lost = F.raise_error(F.concat(F.lit("no original for "), F.coalesce("payload_digest", F.lit("a revisit")))).cast("binary")
    pages = records.select(F.col("id").alias("page_id"), "url", F.coalesce("payload", lost).alias("html"))
    write(resolve(pages), target)


def op9_warc(spark, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write(resolve(spark.read.parquet(f"{sf_dir}/pages.parquet")), path)
    found = with_originals(stored(read(spark, path, payloads=False), "records"), ["payload_bytes"])
    return found.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


_FIVE = "('0x' || substring(s, {0}, 5))::bigint"
_LETTERS = " || ".join(f"substring('{BASE32}', (({_FIVE.format(5 * part + 1)} >> {15 - 5 * k}) & 31)::int + 1, 1)" for part in range(8) for k in range(4))
OP9_SQL = f"""
with t as (select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as s from pages),
f as (select *, min(page_id) over (partition by h) as first from t)
select page_id, strlen(h) as payload_bytes, {_LETTERS} as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to
from f
"""
