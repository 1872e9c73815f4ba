"""WARC archives: written without repeated payloads, read back, revisits joined to the responses they refer to.

A capture is a row (id, url, payload, digest, bytes). Headers, which hold no payload, are shuffled by payload digest: of the
captures with one digest, that with the largest id is the response, and the others are written as revisit records which
name it. Only the responses' payloads are shuffled then, by a key of their own, so that no digest is hot. All records get
fresh headers and are written by Spark's text writer, whose line end is the blank line that ends a record; so a task that is
lost is run again and its file replaced. The reader cuts archives, gzip or plain, at the words that start a record, and
streams them; where a payload holds these words itself, the pieces are put together again by the lengths of the headers.

A digest with over a thousandth of all captures is joined by broadcast (there are at most a thousand), the rest by shuffle.

What happens in each case: a null or empty payload is a response of no bytes, which others revisit; a null id is below all
others and has no id line in its record; a null url has no line; of captures with one id and payload the one with the
largest url (null: below all) is the response, and of wholly equal rows any one is; line ends within urls become %0D and %0A; a
payload may hold any bytes, whole records too; an empty table gives an empty archive; further columns are ignored, whatever their
names. A revisit whose response isn't there stays one, and refers to nothing.
"""

from __future__ import annotations

from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import cut, join_hot, workers_can_import

END, MARK = "\r\n\r\n", "WARC/1."
SPLIT = f"\r\n{MARK}"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: Column) -> Column:
    """SHA-1 in upper-case base32."""
    parts = [F.lpad(F.conv(F.substring(F.sha1(payload), 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(id, url, payload, digest, bytes) of a table of pages."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(payload_col, F.lit("")).cast("binary").alias("payload"))
    return rows.withColumns({"digest": payload_digest(F.col("payload")), "bytes": F.octet_length("payload").cast("long")})


def _record(fields: dict[str, Column], block: Column) -> Column:
    """A record but for the blank line after it; fields that are null are left out."""
    return F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), *(F.concat(F.lit(f"{k}: "), v) for k, v in fields.items())), F.lit(END), block)


def _urn(key: Column) -> Column:
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(key, *c) for c in cuts)), F.lit(">"))


def write(rows: DataFrame, path: str, compression: str | None = "gzip", date: str | None = None) -> None:
    """Writes captures to a new folder of archives. Null payloads are of revisits, whose digest is known all the same."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    # Equal rows share a key; they are counted where they lie, so that many of them don't meet.
    told = F.concat_ws("|", F.coalesce("digest", F.lit("")), F.coalesce(F.col("id").cast("string"), F.lit("")), F.coalesce(F.concat(F.lit("u"), F.col("url")), F.lit("")))
    keyed = rows.withColumns({"key": F.md5(told), "whole": F.col("payload").isNotNull()})
    heads = keyed.withColumn("part", F.spark_partition_id()).groupBy("key", "part", "whole", "id", "url", "digest", "bytes").agg(F.count("*").alias("n"))
    heads = cut(heads.where("digest is not null"))
    first = F.max(F.struct("whole", "id", "url", "part", "key", "bytes")).alias("first")
    originals = heads.groupBy("digest").agg(first, F.sum("n").alias("copies"))
    url = lambda c: F.replace(F.replace(c, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = lambda n: F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), n.cast("string"), F.lit(END))

    def fields(kind: str, key: Column, block: Column, **more: Column) -> dict[str, Column]:
        common = {"WARC-Type": F.lit(kind), "WARC-Record-ID": _urn(key), "WARC-Date": F.lit(date), "WARC-Target-URI": url(F.col("url")), "WARC-Page-ID": F.col("id").cast("string")}
        last = {"WARC-Payload-Digest": F.concat(F.lit("sha1:"), "digest"), "Content-Type": F.lit("application/http; msgtype=response"), "Content-Length": F.octet_length(block).cast("string")}
        return common | {k.replace("_", "-"): v for k, v in more.items()} | last

    payloads = keyed.where("whole").groupBy("key").agg(F.first("payload").cast("string").alias("payload"))
    responses = payloads.join(originals.where("first.whole").select("digest", "first.*"), "key")
    block = F.concat(http(F.col("bytes")), "payload")
    responses = responses.select(_record(fields("response", F.col("key"), block), block).alias("value"))

    known = originals.where("copies > 1 or not first.whole")
    seen = join_hot(heads, known, "digest")
    is_first = F.col("first.whole") & (F.col("key") == F.col("first.key")) & (F.col("part") == F.col("first.part")) & F.col("whole")
    again = seen.withColumn("n", F.col("n") - is_first.cast("int")).where("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    own = F.md5(F.concat_ws("|", "key", F.col("part").cast("string"), F.col("whole").cast("string"), F.col("copy").cast("string")))
    size = F.coalesce("bytes", "first.bytes")
    empty = F.coalesce(http(size), F.lit(""))
    there = lambda c: F.when(F.col("first.whole"), c)
    more = {"WARC_Profile": F.lit(PROFILE), "WARC_Refers_To": there(_urn(F.col("first.key"))), "WARC_Refers_To_Target_URI": there(url(F.col("first.url"))), "WARC_Refers_To_Date": there(F.lit(date))}
    revisits = again.select(_record(fields("revisit", own, empty, **more), empty).alias("value"))
    writer = responses.unionByName(revisits).write.option("lineSep", END)
    (writer.option("compression", compression) if compression else writer).text(path)


def field(head: Column, name: str) -> Column:
    """A field of a record's header, null if it has none; names in any case."""
    found = F.regexp_extract(head, rf"(?im)^{name}:[ \t]*(.*?)[ \t]*$", 1)
    return F.when(found != "", found)


def _whole(rows: DataFrame) -> DataFrame:
    """Records of the pieces of files in which payloads hold the words that start a record."""
    rows = cut(rows)

    def runs(x: pd.DataFrame) -> pd.DataFrame:
        # Only lengths: each record takes pieces until it has its declared length, but for the line end before the next one.
        x, record, left, at = x.sort_values(["start", "at"]), [], 0, -1
        for n, declared in zip(x["n"], x["declared"], strict=True):
            if left > 2:
                left -= n + len(SPLIT)
                record.append(at)
            elif declared > 0:
                at, left = at + 1, declared - n
                record.append(at)
            else:
                record.append(-1)
        return x.assign(record=record)[["file", "start", "at", "record"]]

    lengths = rows.select("file", "start", "at", "n", F.coalesce("declared", F.lit(0)).alias("declared"))
    placed = lengths.groupBy("file").applyInPandas(runs, "file string, start long, at long, record long").where("record >= 0")
    parts = rows.join(placed, ["file", "start", "at"]).groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("start", "at", "value"))).alias("parts"))
    return parts.select("file", F.array_join(F.transform("parts", lambda p: p["value"]), SPLIT).alias("value"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, head, block): each record of the archives in a folder or file, gzip or plain, as Spark's text reader streams them."""
    workers_can_import(spark)
    lines = spark.read.option("lineSep", SPLIT).text(path)
    rows = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), "value")
    head = F.substring_index("value", END, 1)
    length = F.when(head.rlike(rf"\A({MARK})?[01]\r\n"), field(head, "Content-Length").try_cast("long"))
    rows = rows.withColumns({"n": F.octet_length("value").cast("long"), "declared": F.octet_length(head) + 4 + length + 4})
    # The line end before the next record is part of the split.
    fits = F.coalesce(F.col("declared").isin(F.col("n"), F.col("n") + 2), F.lit(False))
    split = F.broadcast(cut(rows.where(~fits).select("file").distinct()))
    found = rows.where(fits).join(split, "file", "left_anti").select("file", "value")
    if split.limit(1).count():
        found = found.unionByName(_whole(rows.join(split, "file", "left_semi")))
    bytes_of = F.expr("cast(value as binary)")
    return found.select("file", F.concat(F.lit(MARK), F.regexp_replace(head, rf"\A{MARK}", "")).alias("head"), F.substring(bytes_of, F.octet_length(head) + 5, field(head, "Content-Length").cast("int")).alias("block"))


def read_captures(records: DataFrame) -> DataFrame:
    """(id, url, payload, digest, bytes, kind, record_id, refers_to) of the responses and revisits among records. A response's
    digest and size are those of the payload that was read, a revisit's payload is null and its size what its head says."""
    http = F.coalesce(field(F.col("head"), "Content-Type").startswith("application/http"), F.lit(False))
    top = F.when(http, F.substring_index(F.col("block").cast("string"), END, 1)).otherwise(F.lit(""))
    skip = F.when(http, F.octet_length(top) + 5).otherwise(1)
    told = {"kind": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "url": "WARC-Target-URI", "stated": "WARC-Payload-Digest"}
    rows = records.select(*(field(F.col("head"), v).alias(k) for k, v in told.items()), field(F.col("head"), "WARC-Page-ID").try_cast("long").alias("id"), top.alias("top"), F.expr("block").alias("block"), skip.alias("skip"))
    response = F.col("kind") == "response"
    rows = rows.where(F.col("kind").isin("response", "revisit")).withColumn("payload", F.when(response, F.expr("substring(block, skip, octet_length(block))")))
    digest = F.when(response, payload_digest(F.col("payload"))).otherwise(F.regexp_replace("stated", "^sha1:", ""))
    size = F.when(response, F.octet_length("payload")).otherwise(field(F.col("top"), "Content-Length").try_cast("int"))
    return rows.select("id", "url", "payload", digest.alias("digest"), size.cast("long").alias("bytes"), "kind", "record_id", "refers_to")


def resolve(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, url): each response and revisit, a revisit with
    the size and digest of the payload it refers to, as it was read, and that response's page_id."""
    heads = cut(read_captures(records).drop("payload"))
    out = lambda bytes_, digest, to: ("id as page_id", f"{bytes_} as payload_bytes", f"{digest} as payload_digest", "kind as record_type", f"{to} as refers_to", "record_id", "url")
    plain, again = heads.where("kind = 'response'"), heads.where("kind = 'revisit'")
    named = plain.select(F.col("record_id").alias("refers_to"), F.col("bytes").alias("o_bytes"), F.col("digest").alias("o_digest"), F.col("id").alias("o_id")).where("refers_to is not null").dropDuplicates(["refers_to"])
    joined = join_hot(again.where("refers_to is not null"), named, "refers_to").selectExpr(*out("o_bytes", "o_digest", "o_id"))
    lost = again.join(named, "refers_to", "left_anti").selectExpr(*out("bytes", "digest", "cast(null as long)"))
    return plain.selectExpr(*out("bytes", "digest", "cast(null as long)")).unionByName(joined).unionByName(lost)


def deduplicate(spark: SparkSession, source: str, path: str, compression: str | None = "gzip") -> None:
    """Reads archives and writes them anew: one response for each payload, revisits for the rest, all with fresh headers."""
    write(read_captures(read(spark, source)).select("id", "url", "payload", "digest", "bytes"), path, compression)
