"""WARC records and a Merkle fixity audit between replicas.

Records stand in an order and have offset ranges. They are numbered by a
distributed prefix count; ``per_file`` records make a file. A replica is WARC
files and an index of its slots (page_id, position, file, offset, length); what
is audited are the hashes of the bytes read back, in two trees. One is over the
records: the hashes of a bucket of page_ids make a leaf, so a lost or added record
changes its own branch only. The other is over ordered offset ranges: the records
that begin in a stretch of ``RANGE_BYTES`` of a file, with their offsets and in
their order, make a leaf, the ranges of a file a node, and ``fan_out`` consecutive
files the next one. Above, ``fan_out`` nodes make a node, up to one root each. The
audit compares the roots and descends only into children whose hashes differ.

The first tree's differing leaves give the records that are corrupt, missing or
surplus: within a page_id equal records cancel out, the rest are paired as
corrupt, and what has no counterpart is missing or surplus. The second's give the
records that are whole but moved: of the records in differing ranges that both
replicas hold, another one stands before it. What a loss or an addition only
shifts to other offsets isn't moved.

Defined results: a null url or html counts as empty text; page_ids may be null or
repeat (ordered by page_id, null first, then by the record's hash); equal rows are equal records;
a record in no slot of its replica's index has no page_id, so it is missing or
surplus; an empty table has no tree and no differences; further columns are
ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.names import holding
from tessera.scratch import drop, materialize, release, scratch_path, ship, small_batches

ship(__name__)

PER_FILE, FAN_OUT = 256, 64
RANGE_BYTES = 1 << 16
#: So many differing branches at most are read by ranges of the stored level; beyond, most of the level differs and is scanned.
RANGED = 256
DATE = "2024-01-01T00:00:00Z"


def record(url: Column, html: Column) -> Column:
    """The bytes of a WARC/1.1 response record, as text, without the two line ends that follow it."""
    url, html = F.coalesce(url, F.lit("")), F.coalesce(html, F.lit(""))
    body = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), html)
    digest = F.sha1(body.cast("binary"))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:sha1:"), digest,
        F.lit(">\r\nWARC-Target-URI: "), url,
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Block-Digest: sha1:"), digest,
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"), body,
    )


def write_warc(pages: DataFrame, path: str) -> None:
    """Write pages as WARC files, a file per partition, each record followed by CR LF CR LF."""
    pages.select(record(F.col("url"), F.col("html")).alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


def _records(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for path, data in zip(part.column("path").to_pylist(), part.column("content").to_pylist(), strict=True):
            data = gzip.decompress(data) if path.endswith(".gz") else data
            at, rows = 0, []
            while at < len(data):
                end = data.find(b"\r\n\r\n", at)
                head = data[at:end].decode("utf-8", "replace") if end >= 0 else ""
                size = re.search(r"(?im)^Content-Length:\s*(\d+)", head)
                stop = end + 4 + int(size[1]) if size else -1
                if not size or stop > len(data) or data[stop : stop + 4] not in (b"", b"\r\n\r\n") or data[stop + 4 : stop + 9] not in (b"", b"WARC/"):
                    # the length is damaged: go on at the next record
                    after = data.find(b"\r\n\r\nWARC/1.1\r\n", at)
                    stop = after if after >= 0 else len(data) - 4 * data.endswith(b"\r\n\r\n")
                    stop = max(stop, at)
                url = re.search(r"(?im)^WARC-Target-URI:[ \t]*(.*?)\r?$", head) if size else None
                body = data[end + 4 : stop].partition(b"\r\n\r\n")[2].decode("utf-8", "replace") if size else None
                rows.append((path, at, stop - at, url[1] if url else None, body, hashlib.sha256(data[at:stop]).hexdigest()))
                at = stop + 4
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "offset", "length", "url", "html", "leaf"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """path, offset, length, url, html, leaf (SHA-256 of the stored bytes) of each record of the WARC files below path.

    Offsets are those of the unpacked file. A record without a length has null url and html and ends where the next one starts.
    """
    small_batches(spark, 1)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,warc,txt.gz,warc.gz}").load(path).select("path", "content")
    return files.mapInArrow(_records, "path string, offset long, length long, url string, html string, leaf string")


def _write_files(rows: DataFrame, path: str, folders: list[str]) -> None:
    """Write value of rows (folders..., position, value; dealt by file) as packed WARC files; packed fast, as they are read back once."""
    rows.sortWithinPartitions(*folders, "position").select(*folders, "value").write.partitionBy(*folders).option("lineSep", "\r\n\r\n").option(
        "compression", "gzip"
    ).option("zlib.compress.level", "BEST_SPEED").text(path)


def _write_index(slots: DataFrame, path: str, per_file: int) -> None:
    """slots: page_id, position, length (bytes and separator)."""
    with_offsets(slots.select("page_id", "position", "length"), per_file).write.parquet(path)


def write_replica(records: DataFrame, path: str, per_file: int = PER_FILE) -> None:
    """Write records (page_id, position, record) as packed WARC files below path/files and the index of their slots as path/index."""
    placed = records.select(F.floor(F.col("position") / per_file).alias("file"), "position", F.col("record").alias("value")).repartition("file")
    _write_files(placed, f"{path}/files", ["file"])
    _write_index(records.withColumn("length", _length()), f"{path}/index", per_file)


def _length() -> Column:
    return (F.octet_length("record") + 4).cast("long")


def read_replica(spark: SparkSession, path: str, side: str = "") -> DataFrame:
    """page_id, position, file, offset, length, leaf of the records that a replica's files hold; those in no slot of its index have null page_id and position."""
    found = read_warc(spark, f"{path}/files{side}").select(
        F.regexp_extract("path", "/file=([0-9]+)/", 1).cast("long").alias("file"), "offset", (F.col("length") + 4).alias("length"), "leaf"
    )
    slots = spark.read.parquet(f"{path}/index{side}").select("file", "offset", "page_id", "position")
    return found.join(slots, ["file", "offset"], "left").select("page_id", "position", "file", "offset", "length", "leaf")


def ordered(pages: DataFrame, partitions: int | None = None, carry: bool = False) -> DataFrame:
    """page_id, position (0, 1, ... over all rows), length (bytes and separator), leaf (SHA-256 of the record); with carry the record too."""
    spark = pages.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = ["record"] if carry else []
    rows = (
        pages.select(
            F.col("page_id").cast("long").alias("page_id"),
            record(F.col("url").cast("string"), F.col("html").cast("string")).alias("record"),
            F.monotonically_increasing_id().alias("row"),
        ).select(
            "page_id", "row", _length().alias("length"), F.sha2(F.col("record").cast("binary"), 256).alias("leaf"), *text
        )
    )
    # equal pages are told apart by row alone, so a page_id that repeats can't fill one partition
    order = [F.col("page_id").asc_nulls_first(), F.col("leaf"), F.col("row")]
    # written in order, with the partition's number and the place in it as one id, so that numbering needs no further shuffle
    dealt = materialize(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()), "dealt")
    part = F.shiftright("id", 33)
    totals = dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    starts = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inside = F.col("id") - F.shiftleft("part", 33)
    # one row per partition
    out = dealt.withColumn("part", part).join(F.broadcast(materialize(starts, "starts")), "part").select(
        "page_id", (F.col("start") + inside).alias("position"), "length", "leaf", *text
    )
    return holding(out, dealt)


def with_offsets(records: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """Adds file and offset (of the record in its file)."""
    before = Window.partitionBy("file").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("file", F.floor(F.col("position") / per_file)).withColumn(
        "offset", F.coalesce(F.sum("length").over(before), F.lit(0))
    )


def _key() -> Column:
    return F.coalesce(F.col("page_id").cast("string"), F.lit(""))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(_key()), F.lit(buckets))


def _parents(nodes: DataFrame, fan_out: int) -> DataFrame:
    """The next level: a hash over the children's numbers and hashes, in order."""
    return (
        nodes.groupBy(F.floor(F.col("node") / fan_out).alias("node"))
        .agg(F.array_sort(F.collect_list(F.struct("node", "hash"))).alias("children"))
        .select("node", F.sha2(F.array_join(F.transform("children", lambda c: F.concat_ws(":", c["node"], c["hash"])), "|"), 256).alias("hash"))
    )


def tree(records: DataFrame, count: int, fan_out: int = FAN_OUT) -> list[DataFrame]:
    """The levels of the tree from buckets of keys to root; count: of buckets, the same for both replicas.

    A bucket's hash is over sums of its records' hashes, so its rows are added up in part before the shuffle and a page_id
    that repeats fills no task.
    """
    own = records.select(_bucket(count).alias("node"), F.sha2(F.concat_ws(":", _key(), "length", "leaf"), 256).alias("h"))
    words = [F.sum(F.conv(F.substring("h", i, 15), 16, 10).cast("decimal(20,0)")).alias(f"w{i}") for i in (1, 16, 31, 46)]
    sums = own.groupBy("node").agg(F.count("*").alias("n"), *words)
    levels = [materialize(sums.select("node", F.sha2(F.concat_ws(":", "n", "w1", "w16", "w31", "w46"), 256).alias("hash")).orderBy("node"), "leaves")]
    while count > 1:
        levels.append(materialize(_parents(levels[-1], fan_out).orderBy("node"), "nodes"))
        count = -(-count // fan_out)
    return levels


def inside(level: DataFrame, parents: list[int], fan_out: int = FAN_OUT) -> DataFrame:
    """The nodes of a level below these parents. A level is stored in the order of its nodes, so the filter skips what it need not read."""
    return level.where(reduce(Column.__or__, (F.col("node").between(p * fan_out, (p + 1) * fan_out - 1) for p in parents)))


def differences(ours: list[DataFrame], theirs: list[DataFrame], fan_out: int = FAN_OUT) -> DataFrame:
    """The buckets that differ: node, ours, theirs (hashes; null where a replica has no record in it). Descends from the roots."""

    def differ(a: DataFrame, b: DataFrame) -> DataFrame:
        return (
            a.select("node", F.col("hash").alias("ours"))
            .join(b.select("node", F.col("hash").alias("theirs")), "node", "full_outer")
            .where(~F.col("ours").eqNullSafe(F.col("theirs")))
        )

    found = materialize(differ(ours[-1], theirs[-1]), "differ")
    for a, b in zip(reversed(ours[:-1]), reversed(theirs[:-1]), strict=True):
        few = [x.node for x in found.select("node").limit(RANGED + 1).collect()]
        if not few:
            return found
        if len(few) <= RANGED:
            sides = [inside(side, few, fan_out) for side in (a, b)]
        else:
            branches = found.select(F.col("node").alias("parent"))
            sides = [side.join(branches, F.floor(side.node / fan_out) == branches.parent, "left_semi") for side in (a, b)]
        found = materialize(differ(*sides), "differ")
    return found


def _unmatched(mine: DataFrame, other: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records of either side that have no equal one in the other, numbered within their page_id: side's columns, key, rank."""
    same = ["key", "length", "leaf"]
    keyed = [x.withColumn("key", _key()) for x in (mine, other)]
    # equal copies in the same place cancel out first, so that of a repeated record the damaged copy is named
    apart = [x.join(y.select(*same, "position"), [*same, "position"], "left_anti") for x, y in (keyed, keyed[::-1])]
    sides = [x.withColumn("copy", F.row_number().over(Window.partitionBy(*same).orderBy("position", "file", "offset"))) for x in apart]
    counts = [x.groupBy(*same).agg(F.count("*").alias("there")) for x in sides]
    rank = F.row_number().over(Window.partitionBy("key").orderBy("position", "file", "offset"))
    a, b = (
        x.join(c, same, "left").where(F.col("copy") > F.coalesce("there", F.lit(0))).withColumn("rank", rank).drop("copy", "there")
        for x, c in zip(sides, reversed(counts), strict=True)
    )
    return a, b


def range_tree(records: DataFrame, files: int, fan_out: int = FAN_OUT) -> tuple[DataFrame, list[DataFrame]]:
    """(file, rng, hash of each ordered offset range; the levels from files to root). A range holds a bounded number of records, a file of ranges."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "length", "leaf")))
    written = F.array_join(F.transform(inside, lambda r: F.concat_ws(":", r["offset"], r["length"], r["leaf"])), "|")
    ranges = materialize(_ranged(records).groupBy("file", "rng").agg(F.sha2(written, 256).alias("hash")).orderBy("file", "rng"), "ranges")
    own = F.array_sort(F.collect_list(F.struct("rng", "hash")))
    whole = F.sha2(F.array_join(F.transform(own, lambda r: F.concat_ws(":", r["rng"], r["hash"])), "|"), 256)
    levels = [materialize(ranges.groupBy(F.col("file").alias("node")).agg(whole.alias("hash")).orderBy("node"), "files")]
    while files > 1:
        levels.append(materialize(_parents(levels[-1], fan_out).orderBy("node"), "nodes"))
        files = -(-files // fan_out)
    return ranges, levels


def _ranged(records: DataFrame) -> DataFrame:
    return records.withColumn("file", F.coalesce("file", F.lit(0))).withColumn("rng", F.floor(F.col("offset") / RANGE_BYTES))


def differing_ranges(mine: DataFrame, other: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """file, rng of the offset ranges that differ. Descends from the roots."""
    top = mine.select("file").unionByName(other.select("file")).agg(F.max("file")).first()[0] or 0
    (a, ours), (b, theirs) = (range_tree(x, top + 1, fan_out) for x in (mine, other))
    files = differences(ours, theirs, fan_out).select(F.col("node").alias("file"))
    a, b = (x.join(files, "file", "left_semi").withColumnRenamed("hash", name) for x, name in ((a, "ours"), (b, "theirs")))
    return a.join(b, ["file", "rng"], "full_outer").where(~F.col("ours").eqNullSafe(F.col("theirs"))).select("file", "rng")


def _before(pairs: DataFrame, order: list[str], node: Column) -> DataFrame:
    """node, before: the node that stands before each in this order. Rows are range-sorted; a partition's first row follows the last one of the part before."""
    rows = pairs.select(node.alias("node"), *order)
    dealt = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id()), "order")
    placed = dealt.withColumn("part", F.shiftright("row", 33))
    ends = placed.groupBy("part").agg(F.max_by("node", "row").alias("last"))
    ends = ends.select("part", F.lag("last").over(Window.orderBy("part")).alias("last"))  # one row per partition
    own = F.lag("node").over(Window.partitionBy("part").orderBy("row"))
    return placed.withColumn("own", own).join(F.broadcast(ends), "part").select("node", F.coalesce("own", "last").alias("before"))


def _moved(mine: DataFrame, other: DataFrame, ours: DataFrame, theirs: DataFrame, fan_out: int) -> DataFrame:
    """file, offset of the records of mine that are whole and follow another record than in other; ours, theirs: what has no counterpart."""
    bad = materialize(differing_ranges(mine, other, fan_out), "bad-ranges")
    same = ["key", "length", "leaf"]
    copy = F.row_number().over(Window.partitionBy(*same).orderBy("file", "offset"))
    place = ["file", "offset"]
    a, b = (
        _ranged(x).join(bad, ["file", "rng"], "left_semi").join(lost, place, "left_anti").withColumn("key", _key()).select(*same, *place).withColumn("copy", copy)
        for x, lost in ((mine, ours), (other, theirs))
    )
    pairs = materialize(a.join(b.withColumnsRenamed({"file": "their_file", "offset": "their_offset"}), [*same, "copy"]).select(*place, "their_file", "their_offset"), "pairs")
    node = F.struct(*place)
    here, there = _before(pairs, place, node), _before(pairs, ["their_file", "their_offset"], node).withColumnRenamed("before", "there")
    return here.join(there, "node").where(~F.col("before").eqNullSafe(F.col("there"))).select("node.file", "node.offset", F.lit("moved").alias("status"))


def compare(mine: DataFrame, other: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """position, file, offset, length, page_id, leaf and status (intact, moved, corrupt, missing, surplus) of each record of mine, and of surplus records of other.

    Both: page_id, position (null without a slot), file, offset, length, leaf.
    """
    count = max(mine.count(), other.count(), 1)
    bad = differences(tree(mine, count, fan_out), tree(other, count, fan_out), fan_out).select("node")
    inside = (materialize(x.withColumn("node", _bucket(count)).join(bad, "node", "left_semi").drop("node"), "inside") for x in (mine, other))
    ours, theirs = (materialize(x, "unmatched") for x in _unmatched(*inside))
    columns = ["position", "file", "offset", "length", "page_id", "leaf"]
    pair = ["key", "rank"]
    surplus = theirs.join(ours.select(pair), pair, "left_anti")
    place = ["file", "offset"]
    lost = ours.join(theirs.select(*pair, F.lit("corrupt").alias("status")), pair, "left").select(*place, F.coalesce("status", F.lit("missing")).alias("status"))
    told = lost.unionByName(_moved(mine, other, ours.select(place), theirs.select(place), fan_out))
    own = mine.join(told, place, "left").select(*columns, F.coalesce("status", F.lit("intact")).alias("status"))
    return own.unionByName(surplus.select(*columns, F.lit("surplus").alias("status")))


def fixity_audit(pages: DataFrame, replica: DataFrame, per_file: int = PER_FILE, fan_out: int = FAN_OUT) -> DataFrame:
    """compare() of the records that pages should have with a replica: its records as read_replica() gives them, or as ordered() does."""
    mine = materialize(with_offsets(materialize(ordered(pages), "ordered"), per_file), "placed")
    other = materialize(replica, "replica")
    return compare(mine, other if "file" in other.columns else materialize(with_offsets(other, per_file), "placed"), fan_out)


def _altered(record: Column) -> Column:
    return F.replace(record, F.lit(f"WARC-Date: {DATE}"), F.lit(f"WARC-Date: X{DATE[1:]}"))


def damaged_records(records: DataFrame) -> DataFrame:
    """What a drill makes of records (page_id, position, length, record): these columns, sides (0 own, 1 damaged replica) and altered (on side 1).

    The 8th of every 103 is lost, a header byte of each 97th altered, the 51st of every 101 holds its neighbour's bytes, the 61st of
    every 109 trades places with the next one where both are otherwise whole, and a copy of the 22nd of every 107 is added at the end
    under another page_id. A record that both replicas hold in one place is one row.
    """
    p, n = F.col("position"), records.count()
    lost, hit, swapped = p % 103 == 7, p % 97 == 13, p % 101 == 50

    def whole(q: Column) -> Column:
        return (q % 103 != 7) & (q % 97 != 13) & (q % 101 != 50) & (q < n)

    down, up = (p % 109 == 60) & whole(p) & whole(p + 1), (p % 109 == 61) & whole(p) & whole(p - 1)
    held = ["page_id", "position", "length", "record"]
    one = lost | (swapped & ~hit) | down | up
    own = records.select(*held, F.when(one, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1))).alias("sides"), hit.alias("altered"))
    traded = records.where(down | up).select("page_id", F.when(down, p + 1).otherwise(p - 1).alias("position"), "length", "record")
    # one record in a hundred each
    donors = records.where(p % 101 == 51).select((p - 1).alias("position"), F.col("length").alias("size"), F.col("record").alias("other"))
    taken = records.where(swapped & ~hit & ~lost).select("page_id", "position").join(donors, "position", "left").select(
        "page_id", "position", F.coalesce("size", F.lit(4)).cast("long").alias("length"), F.coalesce("other", F.lit("")).alias("record")
    )
    added = records.where(p % 107 == 21).select(
        (-1 - F.coalesce("page_id", F.lit(0))).alias("page_id"), (F.floor(p / 107) + n).alias("position"), "length", "record"
    )
    more = taken.unionByName(added).unionByName(traded).select("*", F.array(F.lit(1)).alias("sides"), F.lit(False).alias("altered"))
    return own.unionByName(more)


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Has the shuffle files of each query inside dropped as it ends; none of these queries is run again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def drill(pages: DataFrame, per_file: int = PER_FILE, fan_out: int = FAN_OUT) -> DataFrame:
    """Write pages as a replica and as a damaged one, read the bytes of both back, and compare them.

    One replica after the other is written, read and dropped, so the shared folder never holds both.
    """
    spark = pages.sparkSession
    sides = []
    with _shuffles_dropped(spark):
        placed = ordered(pages, carry=True)
        rows = damaged_records(placed.select("page_id", "position", "length", "record"))
        path = scratch_path(spark, "replicas")
        for side in (0, 1):
            own = rows.where(F.array_contains("sides", side))
            value = F.when(F.col("altered"), _altered(F.col("record"))).otherwise(F.col("record")) if side else F.col("record")
            dealt = own.select(F.floor(F.col("position") / per_file).alias("file"), "position", value.alias("value")).repartition("file")
            _write_files(dealt, f"{path}/files/side={side}", ["file"])
            _write_index(own, f"{path}/index/side={side}", per_file)
            if side:
                release(placed)
            sides.append(materialize(read_replica(spark, path, f"/side={side}"), "read"))
            drop(spark, f"{path}/files/side={side}")
    return compare(*sides, fan_out)


def damaged(records: DataFrame) -> DataFrame:
    """Hashes as of a replica with faults in known places, for tests: each 97th record altered, the last of every 101 records swapped with its neighbour's bytes."""
    p = F.col("position")
    neighbour = F.lead("leaf").over(Window.partitionBy(F.floor(p / 101)).orderBy("position"))
    return records.select(
        "page_id",
        "position",
        "length",
        F.when(p % 97 == 13, F.sha2(F.concat("leaf", F.lit("!")), 256)).when(p % 101 == 50, neighbour).otherwise(F.col("leaf")).alias("leaf"),
    ).withColumn("leaf", F.coalesce("leaf", F.lit("")))


#: The same records, their places and what the drill does to them.
SQL = f"""
WITH b AS (SELECT page_id, coalesce(url, '') AS url, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') AS body FROM pages),
r AS (SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:sha1:' || sha1(body) || '>' || chr(13) || chr(10)
   || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'WARC-Date: {DATE}' || chr(13) || chr(10) || 'WARC-Block-Digest: sha1:' || sha1(body) || chr(13) || chr(10)
   || 'Content-Type: application/http; msgtype=response' || chr(13) || chr(10) || 'Content-Length: ' || strlen(body) || chr(13) || chr(10) || chr(13) || chr(10) || body AS rec FROM b),
l AS (SELECT page_id, (strlen(rec) + 4)::BIGINT AS length, sha256(rec) AS leaf FROM r),
p AS (SELECT *, row_number() OVER (ORDER BY page_id NULLS FIRST, leaf) - 1 AS position FROM l),
n AS (SELECT *, lead(leaf) OVER o AS next, lead(length) OVER o AS next_length FROM p WINDOW o AS (PARTITION BY position // 101 ORDER BY position)),
d AS (SELECT *, position % 103 = 7 AS lost, position % 97 = 13 OR (position % 101 = 50 AND coalesce(next, '') <> leaf) AS hit,
    CASE WHEN position % 109 = 60 AND whole AND lead(whole) OVER o THEN position + 1 WHEN position % 109 = 61 AND whole AND lag(whole) OVER o THEN position - 1 ELSE position END AS there
  FROM (SELECT *, position % 103 <> 7 AND position % 97 <> 13 AND position % 101 <> 50 AS whole FROM n) WINDOW o AS (ORDER BY position)),
held AS (SELECT position, lag(position) OVER (ORDER BY position) AS a, lag(position) OVER (ORDER BY there) AS b FROM d WHERE NOT lost AND NOT hit),
mine AS (SELECT d.page_id, d.position, d.length, d.leaf,
    CASE WHEN lost THEN 'missing' WHEN hit THEN 'corrupt' WHEN a IS DISTINCT FROM b THEN 'moved' ELSE 'intact' END AS status FROM d LEFT JOIN held ON held.position = d.position),
theirs AS (
  SELECT page_id, position, CASE WHEN position % 101 = 50 AND position % 97 <> 13 THEN coalesce(next_length, 4) ELSE length END AS length, leaf, false AS added FROM n WHERE position % 103 <> 7
  UNION ALL SELECT -1 - coalesce(page_id, 0), position // 107 + (SELECT count(*) FROM n), length, leaf, true FROM n WHERE position % 107 = 21),
placed AS (
  SELECT *, coalesce(sum(length) OVER (PARTITION BY position // {PER_FILE} ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM mine
  UNION ALL SELECT page_id, position, length, leaf, 'surplus', "offset" FROM (
    SELECT *, coalesce(sum(length) OVER (PARTITION BY position // {PER_FILE} ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM theirs) WHERE added)
SELECT position, position // {PER_FILE} AS file, "offset", length, page_id, leaf, status FROM placed
"""
