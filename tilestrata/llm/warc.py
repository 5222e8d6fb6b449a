"""WARC archives: a distributed writer and a PySpark Python data source that reads them.

Writing. A record's bytes are built by expressions, one string a record that ends with CR LF, and
Spark's text writer (record separator CR LF) puts them into files under any path Spark can write,
with its commit protocol: the files are plain WARC 1.1 and lost executors leave no halves.
Payloads that repeat become `revisit` records of the one that stays.

Reading. `WarcSource` plans a partition for each file (or several small ones), given their paths by the
driver's listing. Filters on record type and header columns are pushed into the source; each
record's header block is parsed first, and the block of a record that the filters reject, or of which no
payload column is read (`payload` option), is skipped by seeking over Content-Length bytes, never decoded.

Defined results: a null payload is empty; null targets give records without WARC-Target-URI; CR and LF in a target are
percent-encoded; rows with a null id are written with an empty one; rows that repeat an id give a record
each; an empty table gives an empty archive; other columns are not read. A truncated record raises; an HTTP block without a blank line is all header.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

from tilestrata.llm.storage import cut

VERSION = "WARC/1.1"
END = "\r\n"
ID_PREFIX = "urn:x-record:"
SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, content_length long, payload binary"
#: Column -> WARC header that filters on it read (fixed values of the format, but for the last).
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest", "payload_bytes": "x-payload-length"}


def mark_revisits(df: DataFrame, id_col: str, payload_col: str, least_bytes: int = 1000, broadcast_rows: int = 500_000) -> DataFrame:
    """(id, target columns of df untouched) plus _payload, _digest, _bytes, _stays: the largest id of equal payloads.

    Digests and ids alone are grouped, with partial aggregation, and payloads stay where they are while at most `broadcast_rows` distinct
    payloads repeat; beyond that, rows meet the ids by digest and id, so that equal payloads don't share a task.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = df.withColumns({"_payload": payload, "_bytes": F.octet_length(payload).cast("long"), "_digest": F.sha1(payload)})
    long = df.select(F.col(id_col).alias("_i"), payload.alias("_p")).select("_i", F.octet_length("_p").alias("_n"), F.sha1("_p").alias("_digest")).filter(F.col("_n") >= least_bytes)
    keep = long.groupBy("_digest").agg(F.count(F.lit(1)).alias("_copies"), F.max("_i").alias("_stays")).filter("_copies > 1").drop("_copies")
    keep = cut(keep, "repeated-payloads")
    if keep.count() <= broadcast_rows:
        return rows.join(F.broadcast(keep), "_digest", "left")
    again = long.join(keep, "_digest").select("_digest", "_i", "_stays").distinct()
    return rows.join(again, (rows["_digest"] == again["_digest"]) & rows[id_col].eqNullSafe(again["_i"]), "left").drop(again["_digest"]).drop("_i")


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(name + ": "), value, F.lit(END)))


def write_warc(df: DataFrame, path: str, id_col: str, url_col: str | None, payload_col: str, date: str = "1970-01-01T00:00:00Z", least_bytes: int = 1000) -> None:
    """Writes a record per row of df."""
    df = df.select(F.col(id_col).alias("id"), (F.col(url_col) if url_col else F.lit(None)).cast("string").alias("url"), F.col(payload_col).alias("payload"))
    rows = mark_revisits(df, "id", "payload", least_bytes)
    again = F.col("_stays").isNotNull() & ~F.col("_stays").eqNullSafe(F.col("id"))
    kind = F.when(again, F.lit("revisit")).otherwise(F.lit("response"))
    name = lambda c: F.concat(F.lit(f"<{ID_PREFIX}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("_bytes").cast("string"), F.lit(END * 2))
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("_payload")))
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    profile = F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    head = F.concat(
        F.lit(VERSION + END),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", name(F.col("id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", url),
        _line("WARC-Refers-To", F.when(again, name(F.col("_stays")))),
        _line("WARC-Profile", profile),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_digest"))),
        _line("X-Payload-Length", F.col("_bytes").cast("string")),
        _line("Content-Type", F.lit("application/http;msgtype=response")),
        _line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(END),
    )
    rows.select(F.concat(head, block, F.lit(END)).alias("value")).write.option("lineSep", END).text(path)


class WarcFiles(InputPartition):
    """Some whole files of an archive."""

    def __init__(self, files: list[str]) -> None:
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.files = json.loads(options["files"])
        self.target = int(options.get("partitionbytes", 128 << 20))
        self.payload = options.get("payload", "true").lower() == "true"
        self.wanted: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = getattr(f, "attribute", ("",))[0]
            if isinstance(f, EqualTo) and name in HEADERS:
                self.wanted.append((name, frozenset([f.value])))
            elif isinstance(f, In) and name in HEADERS:
                self.wanted.append((name, frozenset(f.value)))
            elif not (isinstance(f, IsNotNull) and name in ("record_id", "record_type")):
                yield f

    def partitions(self) -> list[InputPartition]:
        out, size = [[]], 0
        for path, n in sorted(self.files, key=lambda x: x[0]):
            if out[-1] and size + n > self.target:
                out.append([])
                size = 0
            out[-1].append(path)
            size += n
        return [WarcFiles(x) for x in out]

    def read(self, partition: WarcFiles) -> Iterator[tuple]:
        from pyarrow import fs

        for path in partition.files:
            where, name = fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))
            with where.open_input_file(name) as f:
                yield from self._records(f, path)

    def _records(self, f, path: str) -> Iterator[tuple]:
        size, buffer, base, at = f.size(), b"", 0, 0  # buffer holds the file's bytes from `base` on; a record starts at `at`

        def need(upto: int) -> bool:
            """Fills the buffer up to a position of the file."""
            nonlocal buffer, base
            if base + len(buffer) < upto:
                kept = buffer[at - base :] if at < base + len(buffer) else b""
                base = at
                buffer = kept + f.read_at(min(size - at - len(kept), max(1 << 20, upto - at - len(kept))), at + len(kept))
            return base + len(buffer) >= upto

        while at < size:
            have = 4096
            need(min(size, at + have))
            while (end := buffer.find(b"\r\n\r\n", at - base)) < 0:
                if at + have >= size:
                    raise ValueError(f"no end of a record's header in {path} at {at}")
                have *= 4
                need(min(size, at + have))
            head = {}
            lines = buffer[at - base : end].decode("utf-8").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"no record in {path} at {at}")
            for line in lines[1:]:
                key, _, value = line.partition(":")
                head[key.strip().lower()] = value.strip()
            length = int(head["content-length"])
            start = base + end + 4
            after = start + length + 4
            if after > size:
                raise ValueError(f"a record is cut off in {path} at {at}")
            row = self._row(head, length)
            if all(row[_PLACE[k]] in v for k, v in self.wanted):
                if self.payload:
                    need(after)
                    block = buffer[start - base : start - base + length]
                    if head.get("content-type", "").startswith("application/http"):
                        blank = block.find(b"\r\n\r\n")
                        block = block[blank + 4 :] if blank >= 0 else b""
                    row = (*row[:-1], None if row[1] == "revisit" else block)
                yield row
            at = after

    @staticmethod
    def _row(head: dict, length: int) -> tuple:
        bare = lambda x: x[1:-1].removeprefix(ID_PREFIX) if x else None
        digest = head.get("warc-payload-digest")
        known = head.get("x-payload-length")
        return bare(head.get("warc-record-id")), head.get("warc-type"), head.get("warc-target-uri"), bare(head.get("warc-refers-to")), digest and hex_digest(digest), None if known is None else int(known), length, None


_PLACE = {c.split()[0]: i for i, c in enumerate(SCHEMA.split(", "))}


def hex_digest(value: str) -> str:
    """Bare lower-case hex of `sha1:` digests in hex or base 32."""
    value = value.partition(":")[2] or value
    return base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower()


class WarcSource(DataSource):
    """format("warc"): options files (JSON list of [path, bytes]), payload (true or false), partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader({k.lower(): v for k, v in self.options.items()})


def list_files(spark: SparkSession, path: str) -> list[list]:
    """[path, bytes] of every data file under path, at any depth, by Spark's own file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found, out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(where, True), []
    while found.hasNext():
        x = found.next()
        name, parts = x.getPath().toString(), x.getPath().toString()[len(path.rstrip("/")) :].split("/")
        if x.getLen() and not x.getPath().getName().startswith(("_", ".")) and not any(p.startswith(("_", ".")) for p in parts[:-1]):
            out.append([re.sub(r"^file:/+", "file:///", name), x.getLen()])
    return out


def read_warc(spark: SparkSession, path: str, payload: bool = True, partition_bytes: int = 128 << 20) -> DataFrame:
    """The records under path."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("files", json.dumps(list_files(spark, path))).option("payload", str(payload).lower()).option("partitionBytes", str(partition_bytes)).load()
