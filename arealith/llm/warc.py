"""WARC archives: writing pages as records, and reading archives by boundary-chain verification.

*Writing.* Spark's text writer puts out the records, each closed by the CRLF pair that WARC asks for;
a partition is an archive. Of pages with equal payloads of at least 1000 bytes, that of the largest
id is a response, the others are revisits that refer to it and carry no payload.

*Reading.* Archives are read in splits of any size, cut at the version line ("magic"), wherever it
stands. A task turns every piece that begins like a record into a candidate with its successor's
offset, and follows successors within its split to the offset where a chain that enters at the
candidate leaves the split. Sizes of splits, summed along a file, make offsets absolute. Pointer
jumping over these exits, from the file's start, marks where the true chain enters every split;
following it inside the splits keeps the records that are reachable. Magic inside a payload starts a
piece, but no reachable record, and its bytes go back to the record around it: a record in one piece
has its digest taken in the first scan, and only those in several pieces are read once more.

Defined results: null html is an empty payload; null or odd urls are percent-encoded, never a header
of their own; rows that repeat a page_id with equal payloads are all responses when theirs is the
largest id; empty tables give no records. Columns besides page_id, url and html are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arealith.sources.tables import cut, stored

MAGIC = b"WARC/1.1\r\n"
LEAST_REVISITED = 1000
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def with_payload(pages: DataFrame) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    return pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("bytes"), F.sha1(html.cast("binary")).alias("digest"))


def revisits(pages: DataFrame) -> DataFrame:
    """``(page_id, digest, refers_to)`` of the pages whose payload a later page id has as well."""
    small = with_payload(pages).filter(F.col("bytes") >= LEAST_REVISITED).select("page_id", "digest")
    last = stored(small.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n"), "payloads")
    return small.join(last, "digest").filter("page_id <> refers_to").distinct()


def record(kind: Column, page: Column, url: Column, digest: Column, size: Column, refers: Column, block: Column) -> Column:
    """A record up to its last byte before the closing CRLF pair, as a string column."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    safe = F.regexp_replace(F.coalesce(url, F.lit("")), "[\\x00-\\x20\\x7F]", "%20")
    return F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", kind),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))),
        line("WARC-Target-URI", safe),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        line("WARC-Payload-Length", size.cast("string")),
        F.when(refers.isNotNull(), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), refers.cast("string"), F.lit(">")))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def write_warc(pages: DataFrame, path: str) -> None:
    """Archives of all pages under ``path``, one a partition."""
    known = stored(revisits(pages), "revisits")  # its size is known: Spark broadcasts it only where that is small
    rows = with_payload(pages).join(known, ["page_id", "digest"], "left")
    again = F.col("refers_to").isNotNull()
    block = F.concat(F.lit(HTTP), F.when(again, "").otherwise(F.col("html")))
    text = record(F.when(again, "revisit").otherwise("response"), F.col("page_id"), F.col("url"), F.col("digest"), F.col("bytes"), F.col("refers_to"), block)
    rows.select(text.alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


_FIELD = {k: re.compile(rb"(?im)^" + k.encode() + rb":[ \t]*([^\r\n]*)") for k in ("WARC-Type", "WARC-Record-ID", "WARC-Payload-Digest", "WARC-Payload-Length", "WARC-Refers-To", "Content-Length")}


def parsed(piece: bytes) -> dict | None:
    """Header fields of a piece (what follows a magic), or None where it is no record's beginning."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    head = piece[:end]
    got = {k: (m[1].strip().decode("utf-8", "replace") if (m := p.search(head)) else None) for k, p in _FIELD.items()}
    if not got["WARC-Type"] or not (got["Content-Length"] or "").isdigit():
        return None
    return got | {"head": end + 4, "length": int(got["Content-Length"])}


def payload_of(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2]


PIECE = "file string, split long, piece long, at long, size long, candidate boolean, next long, exit long, whole boolean, type string, id string, refers string, said_digest string, said_bytes long, digest string, bytes long"


def scan_archives(spark: SparkSession, path: str) -> DataFrame:
    """Splits of all archives as pieces between magics, in file order: file, split, value (bytes)."""
    raw = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("value"))


def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """(file, split, number of the piece in its split, bytes), in order."""
    last, n = None, 0
    for batch in batches:
        for file, split, value in zip(batch.column("file").to_pylist(), batch.column("split").to_pylist(), batch.column("value"), strict=True):
            n = n + 1 if (file, split) == last else 0
            last = (file, split)
            yield file, split, n, value.as_py()


def candidates(pieces: DataFrame) -> DataFrame:
    """Every piece with its place in the split and, where it begins like a record, its successor and its chain's exit.

    ``at``, ``next`` and ``exit`` are relative to the split's first byte that it reads; the first piece of a
    file stands before its first magic.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        held: list[dict] = []

        def done() -> pd.DataFrame:
            total = held[-1]["at"] + held[-1]["size"]
            where = {r["at"]: r for r in held if r["candidate"]}
            for r in reversed(held):
                if r["candidate"]:
                    # Beyond the split: there. Inside it: where the candidate met there leaves; else nowhere.
                    r["exit"] = r["next"] if r["next"] >= total else where[r["next"]]["exit"] if r["next"] in where else None
            out = pd.DataFrame(held)
            held.clear()
            return out

        at = 0
        for file, split, n, value in runs_of(batches):
            if held and (held[-1]["file"], held[-1]["split"]) != (file, split):
                yield done()
            at = 0 if not held else at
            # A piece is the bytes between two magics; the magic that ended it is counted with it.
            row = {"file": file, "split": split, "piece": n, "at": at, "size": len(value) + len(MAGIC), "candidate": False, "next": None, "exit": None, "whole": False, "type": None, "id": None, "refers": None, "said_digest": None, "said_bytes": None, "digest": None, "bytes": None}
            if got := parsed(value):
                span = got["head"] + got["length"] + 4
                row |= {"candidate": True, "next": at + span + len(MAGIC), "whole": span == len(value), "type": got["WARC-Type"], "id": got["WARC-Record-ID"], "refers": got["WARC-Refers-To"]}
                said = got["WARC-Payload-Length"] or ""
                row |= {"said_digest": (got["WARC-Payload-Digest"] or "").removeprefix("sha1:"), "said_bytes": int(said) if said.isdigit() else None}
                if row["whole"]:
                    payload = payload_of(value[got["head"] : got["head"] + got["length"]])
                    row |= {"digest": hashlib.sha1(payload).hexdigest(), "bytes": len(payload)}
            held.append(row)
            at += row["size"]
        if held:
            yield done()

    def arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
        schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in PIECE.split(", "))])
        for pdf in run(batches):
            yield pa.RecordBatch.from_pandas(pdf[schema.names].astype(object).where(pdf[schema.names].notna(), None), schema=schema, preserve_index=False)

    return pieces.mapInArrow(arrow, PIECE)


def reachable(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All pieces with absolute offsets, and those candidates that the chain from their file's start meets."""
    splits = found.groupBy("file", "split").agg(F.sum("size").alias("total"))
    base = F.coalesce(F.sum("total").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    based = cut(splits.select("file", "split", base.alias("base"), "total"))
    placed = found.join(based, ["file", "split"])
    # A piece follows its magic: piece 0 of a file is what stands before the first one.
    every = placed.select("file", "split", "piece", (F.col("base") + F.col("at")).alias("start"), (F.col("base") + F.col("next")).alias("next"), (F.col("base") + F.col("exit")).alias("exit"), "candidate", (F.col("base") + F.col("total")).alias("end"))
    every = cut(every)
    # Where a chain may enter a split: behind a magic at the very start of the file, and at exits of others.
    zero = every.filter(F.col("candidate") & (F.col("start") == len(MAGIC))).select("file", F.col("start").alias("enter"))
    jumps = every.filter("candidate and exit is not null").select("file", F.col("start").alias("enter"), "exit")
    wanted = jumps.select("file", F.col("exit").alias("enter")).union(zero).distinct()
    jumps = cut(jumps.join(wanted, ["file", "enter"], "left_semi"))
    reached = cut(zero)
    most = based.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    for _ in range(int(most).bit_length() + 1):  # twice as many splits of a file in each round
        step = jumps.withColumnRenamed("exit", "to")
        reached = cut(reached.union(reached.join(step, ["file", "enter"]).select("file", F.col("to").alias("enter"))).distinct())
        jumps = cut(jumps.join(step.select("file", F.col("enter").alias("exit"), "to"), ["file", "exit"], "left").select("file", "enter", F.coalesce("to", "exit").alias("exit")))

    def follow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start")
        onward, seen = dict(zip(pdf["start"], pdf["next"], strict=True)), set()
        for x in pdf.loc[pdf["entered"], "start"]:
            while x in onward and x not in seen:
                seen.add(x)
                x = onward[x]
        return pdf.loc[pdf["start"].isin(seen), ["file", "split", "piece", "start", "next"]]

    entered = every.filter("candidate").join(reached.select("file", F.col("enter").alias("start"), F.lit(True).alias("entered")), ["file", "start"], "left").select("file", "split", "piece", "start", "next", F.coalesce("entered", F.lit(False)).alias("entered"))
    return every, entered.groupBy("file", "split").applyInPandas(follow, "file string, split long, piece long, start long, next long")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``(file, offset, type, id, refers, said_digest, said_bytes, digest, bytes)`` of the true records of all archives.

    ``digest`` and ``bytes`` are of the payload as read back.
    """
    pieces = scan_archives(spark, path)
    found = stored(candidates(pieces), "candidates")
    every, kept = reachable(found)
    kept = cut(kept)
    records = found.select("file", "split", "piece", "whole", "type", "id", "refers", "said_digest", "said_bytes", "digest", "bytes").join(kept, ["file", "split", "piece"])
    records = cut(records)
    # Records over several pieces: their pieces' numbers, then their bytes in a second scan of what is needed.
    broken = records.filter("not whole").select("file", F.col("start").alias("owner"), F.col("next").alias("stop"))
    broken = stored(broken, "broken")
    if broken.isEmpty():
        mended = None
    else:
        # The owner of a piece is the last reachable record at or before it: carried along splits, then inside one.
        mine = every.join(kept.select("file", "split", "piece", F.lit(True).alias("true")), ["file", "split", "piece"], "left").select("file", "split", "piece", "start", F.when(F.col("true"), F.col("start")).alias("head"))
        tail = mine.groupBy("file", "split").agg(F.max("head").alias("tail"))
        carried = tail.select("file", "split", F.max("tail").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
        inside = F.max("head").over(Window.partitionBy("file", "split").orderBy("piece").rowsBetween(Window.unboundedPreceding, 0))
        owned = mine.withColumn("inside", inside).join(carried, ["file", "split"]).select("file", "split", "piece", "start", F.coalesce("inside", "carried").alias("owner"))
        needed = stored(owned.join(broken, ["file", "owner"]).filter("start < stop").select("file", "split", "piece", "start", "owner"), "needed")

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []

            def done() -> pa.RecordBatch:
                out = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["file", "split", "piece", "value"])
                held.clear()
                return out

            for row in runs_of(batches):
                held.append(row)
                if len(held) == 256:
                    yield done()
            if held:
                yield done()

        bytes_of = scan_archives(spark, path).mapInArrow(number, "file string, split long, piece long, value binary").join(needed, ["file", "split", "piece"])

        def mend(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            whole = MAGIC.join(pdf.sort_values("start")["value"])
            got = parsed(whole)
            payload = payload_of(whole[got["head"] : got["head"] + got["length"]])
            return pd.DataFrame([{"file": key[0], "start": key[1], "digest2": hashlib.sha1(payload).hexdigest(), "bytes2": len(payload)}])

        mended = bytes_of.groupBy("file", "owner").applyInPandas(mend, "file string, start long, digest2 string, bytes2 long")
    out = records
    if mended is not None:
        out = records.join(mended, ["file", "start"], "left").withColumn("digest", F.coalesce("digest2", "digest")).withColumn("bytes", F.coalesce("bytes2", "bytes"))
    return out.select("file", F.col("start").alias("offset"), "type", "id", "refers", "said_digest", "said_bytes", "digest", "bytes")


def page_id(name: str) -> Column:
    """The page id in a record id (null for a page without one)."""
    return F.expr(f"try_cast(nullif(regexp_extract({name}, '<urn:page:(-?[0-9]+)>', 1), '') as bigint)")


def warc_report(pages: DataFrame, path: str) -> DataFrame:
    """Writes the pages as archives under ``path``, reads them back and returns a row for each record."""
    write_warc(pages, path)
    records = read_warc(pages.sparkSession, path)
    revisit = F.col("type") == "revisit"
    return records.select(
        page_id("id").alias("page_id"),
        F.when(revisit, F.col("said_bytes")).otherwise(F.col("bytes")).cast("long").alias("payload_bytes"),
        F.when(revisit, F.col("said_digest")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        page_id("refers").alias("refers_to"),
    )
