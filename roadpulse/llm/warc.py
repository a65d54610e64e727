"""WARC archives written and read as Spark text with the format's own separators (operator 9).

A record ends with two line breaks, so a text writer with that line separator writes records. A reader whose separator is
the version line cuts any archive at every place where a record may begin, in splits that Spark chooses, on any store.
Payloads may hold that line too: the chain of record lengths from the start of the file tells which places are real.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadpulse.llm.common import stored
from roadpulse.plans.lineage import cut

VERSION = "WARC/1.0\r\n"
_BREAK, _END = "\r\n\r\n", "\r\n\r\n"
#: Payloads with fewer bytes are never written as revisits.
LEAST_REVISIT_BYTES = 1000


def _payload(html: str) -> Column:
    return F.coalesce(F.col(html).cast("string"), F.lit(""))


def _one_line(value: Column) -> Column:
    """Header values can't hold line breaks; they are percent-encoded."""
    return F.regexp_replace(F.regexp_replace(value, "\r", "%0D"), "\n", "%0A")


def write_archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_REVISIT_BYTES) -> None:
    """Writes one record a row, response or revisit, to files below ``path``; one task writes one file.

    Of the rows with equal payloads of ``least`` bytes or more, the one with the largest id is the response; among rows that
    share that id, and where all ids are null, every one is. Digests are joined on ids and numbers alone, so a payload that
    a third of all rows share is spread, and payloads are not shuffled unless the table of repeated digests is too large to
    send to every task, which Spark decides by its size. Every record has the time of the query as its date, and an id; a row
    without one gets a random name.
    """
    body = _payload(html)
    known = pages.select(F.col(page_id).alias("_id"), F.octet_length(body).cast("long").alias("_bytes"), F.sha1(body.cast("binary")).alias("_sha"))
    repeated = stored(known.where(F.col("_bytes") >= least).groupBy("_sha").agg(F.max("_id").alias("_kept"), F.count(F.lit(1)).alias("_n"))
                      .where((F.col("_n") > 1) & F.col("_kept").isNotNull()).drop("_n"), "warc-repeated")
    rows = pages.select(F.col(page_id).alias("_id"), F.col(url).cast("string").alias("_url"), body.alias("_body"),
                        F.octet_length(body).cast("long").alias("_bytes"), F.sha1(body.cast("binary")).alias("_sha"))
    told = rows.join(repeated, "_sha", "left")
    again = (F.col("_bytes") >= least) & F.col("_kept").isNotNull() & (F.col("_id").isNull() | (F.col("_id") != F.col("_kept")))
    again = F.coalesce(again, F.lit(False))
    line = "\r\n"
    header = F.concat(
        F.lit(VERSION + "WARC-Type: "), F.when(again, "revisit").otherwise("response"), F.lit(line),
        F.lit("WARC-Record-ID: <"), F.coalesce(F.concat(F.lit("urn:page:"), F.col("_id").cast("string")), F.concat(F.lit("urn:uuid:"), F.uuid())),
        F.lit(">" + line + "WARC-Date: "), F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(line),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), _one_line(F.col("_url")), F.lit(line)), F.lit("")),
        F.when(again, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest" + line + "WARC-Refers-To: <urn:page:"),
                               F.col("_kept").cast("string"), F.lit(">" + line))).otherwise(""),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("_sha"), F.lit(line + "X-Payload-Length: "), F.col("_bytes").cast("string"),
        F.lit(line + "Content-Length: "), F.when(again, F.lit("0")).otherwise(F.col("_bytes").cast("string")), F.lit(_BREAK))
    record = F.concat(header, F.when(again, "").otherwise(F.col("_body")))
    told.select(record.alias("value")).write.option("lineSep", _END).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies between version lines: ``file, block, row, value``; ``row`` rises along a block. A second scan numbers alike."""
    raw = spark.read.option("lineSep", VERSION).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                      F.monotonically_increasing_id().alias("row"), "value")


def _header(value: Column) -> Column:
    return F.substring_index(value, _BREAK, 1)


def _field(header: Column, name: str) -> Column:
    found = F.regexp_extract(header, rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1)
    return F.when(found != "", found)


def _measured(pieces: DataFrame) -> DataFrame:
    """Adds the length of the piece with its version line, and what its header claims; nulls where it is no header."""
    head = _header(F.col("value"))
    claimed = F.expr("try_cast(claim AS bigint)")
    size = F.octet_length("value")
    whole = pieces.withColumn("claim", _field(head, "Content-Length")).withColumn("head_bytes", F.octet_length(head))
    return whole.select(
        "*", (size + len(VERSION)).cast("long").alias("length"),
        F.when((F.col("head_bytes") + len(_BREAK) <= size) & (claimed >= 0), F.lit(len(VERSION)) + F.col("head_bytes") + len(_BREAK) + claimed + len(_END)).alias("span"))


def _chained(light: DataFrame) -> DataFrame:
    """``file, block, row, offset, next, real`` of every candidate.

    Offsets are running sums, inside blocks and over blocks, of the pieces' lengths. Consecutive candidates whose link holds
    form runs inside a block; each run is one node whose jump is the place its last link points at. Pointer jumping over
    the runs, doubling the reach in every round, marks those that can be reached from the start of the file, and where they
    are entered; false candidates are never entered.
    """
    per_block = light.groupBy("file", "block").agg(F.sum("length").alias("_sum"))
    files = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    edges = per_block.select("file", "block", F.coalesce(F.sum("_sum").over(files), F.lit(0)).alias("_edge"))
    inside = Window.partitionBy("file", "block").orderBy("row")
    # The first piece of a file precedes its first version line and has none of its own.
    before = F.coalesce(F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = light.join(edges, ["file", "block"]).select("file", "block", "row", (F.col("_edge") + before - len(VERSION)).alias("offset"), "span")
    linked = at.where(F.col("offset") >= 0).select("*", (F.col("offset") + F.col("span")).alias("next"))
    opens = F.coalesce(F.lag("next").over(inside) != F.col("offset"), F.lit(True)).cast("int")
    # A run is named after its number inside the block; a candidate without a readable header ends its run.
    numbered = cut(linked.select("*", F.sum(opens).over(inside).alias("run")))
    runs = numbered.groupBy("file", "block", "run").agg(F.min("offset").alias("first"), F.max_by("next", "offset").alias("exit"))
    ids = runs.select("file", "first", F.concat_ws(":", "block", "run").alias("node"), "exit")
    entry = numbered.select("file", F.col("offset").alias("exit"), F.concat_ws(":", "block", "run").alias("to"))
    hops = cut(ids.join(entry, ["file", "exit"], "left").select("file", "node", "to", F.col("exit").alias("enters")))
    reached = cut(ids.where(F.col("first") == 0).select("file", "node", F.lit(0).cast("long").alias("enters")))
    count, jumps = reached.count(), hops.where(F.col("to").isNotNull())
    while True:
        more = reached.select("file", "node").join(jumps, ["file", "node"]).select("file", F.col("to").alias("node"), "enters")
        reached = cut(reached.unionByName(more).groupBy("file", "node").agg(F.min("enters").alias("enters")))
        now = reached.count()
        if now == count:
            break
        count = now
        further = jumps.select("file", "node", F.col("to").alias("_mid"))
        second = jumps.select("file", F.col("node").alias("_mid"), "to", "enters")
        jumps = cut(further.join(second, ["file", "_mid"]).select("file", "node", "to", "enters"))
    marks = reached.select("file", F.split("node", ":")[0].cast("long").alias("block"), F.split("node", ":")[1].cast("long").alias("run"), "enters")
    real = F.coalesce(F.col("offset") >= F.col("enters"), F.lit(False))
    return numbered.join(marks, ["file", "block", "run"], "left").select("file", "block", "row", "offset", "next", real.alias("real"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """``file, header, payload`` of every record of the uncompressed archives below ``path``; payload is binary.

    Records are those of the chain from offset 0 of each file; a version line in a payload starts none. A record whose
    payload holds version lines comes in several pieces, which alone are shuffled to be joined. A file cut short, or with
    junk, yields the records up to the first broken link. No files give no records.
    """
    measured = _measured(_pieces(spark, path))
    links = stored(_chained(measured.select("file", "block", "row", "length", "span")), "warc-links")
    complete = F.coalesce(F.col("length") == F.col("span"), F.lit(False))
    # Where a real record's end is not the next candidate, the record has further pieces.
    order = Window.partitionBy("file", "block").orderBy("row")
    following = F.lead("offset").over(order)
    steps = links.select("*", following.alias("_following"))
    # Offsets of records in several pieces, or at the end of their block; few next to all.
    odd = steps.where(F.col("real") & (F.coalesce(F.col("next") != F.col("_following"), F.lit(True)))).select(
        "file", F.col("offset").alias("owner"), F.col("next").alias("_until"))
    blocks = links.groupBy("file", "block").agg(F.min("offset").alias("_low"), F.max("offset").alias("_high"))
    # Pieces of such a record lie between its offset and its end; the pair is sought in the blocks it reaches into.
    reach = odd.join(blocks, (odd["file"] == blocks["file"]) & (blocks["_high"] >= odd["owner"]) & (blocks["_low"] < odd["_until"])).select(
        odd["file"], "block", "owner", "_until")
    owned = links.join(reach, ["file", "block"]).where((F.col("offset") >= F.col("owner")) & (F.col("offset") < F.col("_until"))).select(
        "file", "block", "row", "offset", "owner", (F.col("_until") - F.col("owner")).alias("_span"))
    parts = stored(owned, "warc-parts")
    # Stored, so that its size is known when the payloads are filtered by it.
    rejected = stored(links.where(~F.col("real")).select("file", "block", "row").unionByName(parts.select("file", "block", "row")).distinct(), "warc-rejected")
    start = F.col("head_bytes") + len(_BREAK) + 1
    single = measured.where(complete).join(rejected, ["file", "block", "row"], "left_anti")
    plain = single.select("file", _header(F.col("value")).alias("header"), F.substring(
        F.col("value").cast("binary"), start, F.octet_length("value") - F.col("head_bytes") - len(_BREAK) - len(_END)).alias("payload"))
    joined = measured.join(parts, ["file", "block", "row"]).groupBy("file", "owner").agg(
        F.max("_span").alias("_span"), F.sort_array(F.collect_list(F.struct("offset", "value"))).alias("_list"))
    whole = joined.select("file", F.array_join(F.transform("_list", lambda p: p["value"]), VERSION).alias("_value"), "_span").where(
        F.octet_length("_value") + len(VERSION) >= F.col("_span"))
    head = _header(F.col("_value"))
    assembled = whole.select("file", head.alias("header"), F.substring(
        F.col("_value").cast("binary"), F.octet_length(head) + len(_BREAK) + 1,
        (F.col("_span") - len(VERSION) - F.octet_length(head) - len(_BREAK) - len(_END)).cast("int")).alias("payload"))
    return plain.unionByName(assembled)


def records(archive: DataFrame) -> DataFrame:
    """Named fields of ``header``: the contract's columns, with the digest of what was read for responses."""
    kind = _field(F.col("header"), "WARC-Type")
    number = lambda name: F.regexp_extract(_field(F.col("header"), name), r"<urn:page:(-?[0-9]+)>", 1)
    response = kind == "response"
    return archive.select(
        number("WARC-Record-ID").try_cast("long").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(_field(F.col("header"), "X-Payload-Length").try_cast("long")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.regexp_extract(_field(F.col("header"), "WARC-Payload-Digest"), "sha1:(.*)", 1)).alias("payload_digest"),
        kind.alias("record_type"), number("WARC-Refers-To").try_cast("long").alias("refers_to"))
