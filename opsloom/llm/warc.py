"""WARC derivatives: linked metadata and conversion records of response records."""

from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
# Entity names of markup that plain text resolves.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
RECORD = "record_id string, type string, target_uri string, date string, headers map<string,string>, block string"


def _uuid(*parts: Column) -> Column:
    """A record id that is the same on every run: a name-based UUID in URN form."""
    h = F.md5(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), cut[0], F.lit("-"), cut[1], F.lit("-3"), cut[2], F.lit("-8"), cut[3], F.lit("-"), cut[4], F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of (page_id, url, html): an HTTP head, the page, and its payload digest."""
    body = F.coalesce("html", F.lit(""))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF * 2))
    block = F.concat(head, body)
    headers = F.create_map(
        F.lit("Content-Type"), F.lit("application/http; msgtype=response"),
        F.lit("WARC-Payload-Digest"), digest(body),
        F.lit("WARC-Block-Digest"), digest(block),
    )
    return pages.select(
        "page_id", _uuid(F.lit("response"), F.col("page_id"), F.col("url")).alias("record_id"), F.lit("response").alias("type"),
        F.coalesce("url", F.lit("")).alias("target_uri"), F.lit(date).alias("date"), headers.alias("headers"), block.alias("block"),
    )


def http_head(block: Column) -> Column:
    """Status line and header lines of an HTTP message, without the blank line."""
    return F.substring_index(block, CRLF * 2, 1)


def http_body(block: Column) -> Column:
    """What follows the first blank line; nothing if there is none."""
    # by bytes, as a body need not be text
    at = F.octet_length(http_head(block))
    return F.when(at < F.octet_length(block), F.substring(block.cast("binary"), at + 5, F.octet_length(block)).cast("string")).otherwise("")


def plain_text(html: Column) -> Column:
    """Markup to text: scripts, styles and comments go, block elements break lines, other tags break words."""
    t = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)</?(?:p|div|br|h[1-6]|li|ul|ol|tr|table|article|section|header|footer|nav|title)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for name, char in ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(char))
    t = F.regexp_replace(t, r"[ \t\r\f]+", " ")
    return F.btrim(F.regexp_replace(t, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def _source_fields(given: Column) -> Column:
    """The named fields of the source but its payload digest: ``WARC-X`` as ``WARC-Source-X``, others as ``Source-X``."""
    kept = F.map_filter(given, lambda k, v: (k != "WARC-Payload-Digest") & v.isNotNull())
    named = F.transform_keys(
        kept, lambda k, v: F.when(F.lower(k).startswith("warc-"), F.concat(F.substring(k, 1, 5), F.lit("Source-"), k.substr(F.lit(6), F.length(k)))).otherwise(F.concat(F.lit("Source-"), k))
    )
    return F.coalesce(named, F.create_map().cast("map<string,string>"))


def derive(records: DataFrame) -> DataFrame:
    """Of every response record a metadata and a conversion record, with columns record_id, type, refers_to, target_uri, date, headers, block.

    Both refer to the response by its id, keep its target and date, and carry its own
    payload digest if it has one, else one that is computed. The metadata block lists the status
    and the headers of the source as ``http-<name>`` fields, the digests, the number of links and
    the id of the conversion record; the conversion block is the plain text of the
    body. Digests of the new blocks are computed from the blocks. The other named fields of the
    source, its block digest among them, are headers of the metadata record (``_source_fields``).

    One scan, no shuffle. Records of other types are passed over. Null blocks are empty, null
    targets empty; a block without a blank line has no body. Repeated records give
    repeated derivatives. Extra columns are kept, apart from the names above.
    """
    extra = [c for c in records.columns if c not in ("record_id", "type", "refers_to", "target_uri", "date", "headers", "block")]
    held = [F.struct(*[F.col(f"`{c}`") for c in extra]).alias("__x")] if extra else []  # under one name, so that no working column meets them
    src = records.where("type = 'response'").select(
        *held, F.col("record_id").alias("__source"), F.coalesce("target_uri", F.lit("")).alias("target_uri"), F.coalesce("date", F.lit("")).alias("date"),
        F.col("headers").alias("__given"), F.coalesce("block", F.lit("")).alias("__raw"),
    )
    src = src.withColumn("__body", http_body(F.col("__raw")))
    src = src.withColumn("__text", plain_text(F.col("__body")))
    src = src.withColumn("__payload", F.coalesce(F.element_at("__given", "WARC-Payload-Digest"), digest(F.col("__body"))))
    conversion, metadata = _uuid(F.lit("conversion"), F.col("__source")), _uuid(F.lit("metadata"), F.col("__source"))
    lines = F.split(http_head(F.col("__raw")), CRLF, -1)
    fields = F.transform(
        F.filter(lines, lambda x, i: i > 0),
        lambda x: F.concat(F.lit("http-"), F.lower(F.substring_index(x, ":", 1)), F.lit(":"), x.substr(F.instr(x, F.lit(":")) + 1, F.length(x))),
    )
    named = F.concat(
        F.array(F.concat(F.lit("http-status: "), F.element_at(lines, 1))),
        fields,
        F.array(
            F.concat(F.lit("source-payload-digest: "), F.col("__payload")),
            F.concat(F.lit("conversion-id: "), conversion),
            F.concat(F.lit("outlinks: "), F.regexp_count("__body", F.lit(r"(?i)<a\s[^>]*href=")).cast("string")),
        ),
    )
    about = F.concat(F.array_join(named, CRLF), F.lit(CRLF))

    def record(kind: str, own: Column, mime: str, block: Column) -> Column:
        headers = F.create_map(
            F.lit("Content-Type"), F.lit(mime),
            F.lit("WARC-Source-Payload-Digest"), F.col("__payload"),
            F.lit("WARC-Block-Digest"), digest(block),
        )
        if kind == "metadata":
            headers = F.map_concat(headers, _source_fields(F.col("__given")))
        return F.struct(own.alias("record_id"), F.lit(kind).alias("type"), headers.alias("headers"), block.alias("block"))

    src = src.withColumn("__about", about)
    both = F.array(record("metadata", metadata, "application/warc-fields", F.col("__about")), record("conversion", conversion, "text/plain; charset=utf-8", F.col("__text")))
    out = src.select(*(["__x"] if extra else []), "__source", "target_uri", "date", F.explode(both).alias("__r"))
    given = [F.col("__x")[c].alias(c) for c in extra]
    return out.select(*given, "__r.record_id", "__r.type", F.col("__source").alias("refers_to"), "target_uri", "date", "__r.headers", "__r.block")


def serialise(records: DataFrame) -> Column:
    """A record as WARC/1.1 text: version, named fields (a line for each line of a value), blank line, block."""
    refers = F.concat(F.lit("WARC-Refers-To: "), F.col("refers_to"), F.lit(CRLF)) if "refers_to" in records.columns else F.lit("")
    named = F.flatten(F.transform(F.filter(F.map_entries("headers"), lambda e: e["value"].isNotNull()), lambda e: F.transform(F.split(e["value"], CRLF, -1), lambda v: F.concat(e["key"], F.lit(": "), v))))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.col("type"), F.lit(f"{CRLF}WARC-Record-ID: "), F.col("record_id"), F.lit(CRLF), F.coalesce(refers, F.lit("")),
        F.lit("WARC-Target-URI: "), F.col("target_uri"), F.lit(f"{CRLF}WARC-Date: "), F.col("date"), F.lit(CRLF),
        F.array_join(named, CRLF), F.lit(f"{CRLF}Content-Length: "), F.octet_length("block").cast("string"), F.lit(CRLF * 2), F.col("block"),
    )


def write(records: DataFrame, path: str) -> None:
    """WARC files, one per task; two line ends close every record."""
    records.select(serialise(records).alias("value")).write.option("lineSep", CRLF * 2).text(path)


OWN = ("warc-record-id", "warc-type", "warc-refers-to", "warc-target-uri", "warc-date")


def _parse(stream: BinaryIO) -> Iterator[dict]:
    """Records of one file, by the lengths they declare; values of repeated fields are lines of one value.

    Names of fields are told apart without case, and need no blank after the colon. What is no record is given as a
    ``reject`` with its reason, and reading goes on at the next line that begins a record.
    """
    line = stream.readline()
    while line:
        if not line.startswith(b"WARC/"):
            if line.strip():
                yield {"reject": "no version line", "block": line.rstrip(b"\r\n")}
                while line and not line.startswith(b"WARC/"):
                    line = stream.readline()
            else:
                line = stream.readline()
            continue
        got: dict[str, tuple[str, str]] = {}
        raw = []
        while (line := stream.readline()) and line.strip(b"\r\n"):
            raw.append(line)
            name, colon, value = line.rstrip(b"\r\n").decode("utf-8", "replace").partition(":")
            if colon:
                name, value = name.strip(), value.strip()
                low = name.lower()
                got[low] = (got[low][0], f"{got[low][1]}{CRLF}{value}") if low in got else (name, value)
        size = got.pop("content-length", ("", ""))[1].split(CRLF)[-1]
        if not (size.isascii() and size.isdigit()):
            yield {"reject": "no length" if not size else "bad length", "block": b"".join(raw)}
            while (line := stream.readline()) and not line.startswith(b"WARC/"):
                pass
            continue
        block = stream.read(int(size))
        if len(block) < int(size):
            yield {"reject": "cut short", "block": b"".join(raw)}
            return
        values = {k: v for k, (_, v) in got.items()}
        yield {
            "record_id": values.get(OWN[0]), "type": values.get(OWN[1]), "refers_to": values.get(OWN[2]), "target_uri": values.get(OWN[3]),
            "date": values.get(OWN[4]), "headers": [v for k, v in got.items() if k not in OWN], "block": block, "reject": None,
        }
        line = stream.readline()


def _opened(content: bytes) -> BinaryIO:
    """The bytes of a file; one that begins as gzip (a member per record, as crawls have it) is unpacked as it is read."""
    return gzip.open(io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


def _records(spark: SparkSession, path: str, rejected: bool) -> DataFrame:
    kinds = [(c, pa.string()) for c in ("record_id", "type", "refers_to", "target_uri", "date")]
    schema = pa.schema([("path", pa.string()), *kinds, ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary()), ("reject", pa.string())])

    def parsed(content: bytes) -> Iterator[dict]:
        try:
            yield from _parse(_opened(content))
        except (OSError, EOFError, zlib.error) as broken:  # of a file that is packed
            yield {"reject": f"broken file: {broken}", "block": b""}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                held, size = [], 0
                for record in parsed(content.as_py()):
                    if (record["reject"] is not None) != rejected:
                        continue
                    held.append({"path": name.as_py(), **record})
                    size += len(record["block"])
                    if size > 1 << 23:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(
        run, "path string, record_id string, type string, refers_to string, target_uri string, date string, headers map<string,string>, block binary, reject string"
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files below ``path``, packed (gzip) or not; what is no record is left to ``read_rejects``.

    A file is read by one task, so keep files below 2 GB as crawls do; a packed one is unpacked record by record.
    Blocks keep their bytes, whether they are UTF-8 or not; fields that are not are read with replacement characters.
    """
    return _records(spark, path, False).drop("path", "reject").withColumn("block", F.col("block").cast("string"))


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    """(path, reason, raw) of what is no record in the files below ``path``: its first line, or its fields."""
    return _records(spark, path, True).select("path", F.col("reject").alias("reason"), F.col("block").alias("raw"))
