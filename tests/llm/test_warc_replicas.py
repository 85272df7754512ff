import glob
import gzip
import os

from pyspark.sql import functions as F

from tessera.llm import warc
from tests.llm.test_warc import pages


def replica(spark, path, rows):
    warc.write_replica(spark.createDataFrame(rows, "page_id long, position long, record string"), path, 10)
    return warc.read_replica(spark, path)


def test_written_replicas_with_records_lost_and_added_in_the_middle(spark, tmp_path):
    rows = [tuple(x) for x in warc.ordered(pages(spark, 120), carry=True).select("page_id", "position", "record").collect()]
    rows = sorted(rows, key=lambda x: x[1])
    byte = [i for i, x in enumerate(rows) if x[0] in (60, 77)]
    gone = next(i for i, x in enumerate(rows) if x[0] == 44)
    other = [(p, i, r.replace("WARC-Date: 2", "WARC-Date: 3").replace("Content-Length: ", "Content-Length: 9") if i in byte else r) for p, i, r in rows if i != gone]
    other.insert(30, (1000, -1, rows[3][2]))
    other = [(p, i, r) for i, (p, _, r) in enumerate(other)]
    a, b = replica(spark, f"{tmp_path}/a", rows), replica(spark, f"{tmp_path}/b", other)
    assert a.count() == len(rows) and b.count() == len(other)
    got = [x for x in warc.compare(a, b, 3).collect() if x.status != "intact"]
    assert sorted((x.page_id, x.status) for x in got) == [(44, "missing"), (60, "corrupt"), (77, "corrupt"), (1000, "surplus")]


def test_a_byte_changed_on_disk_is_found(spark, tmp_path):
    rows = [(i, i, f"WARC/1.1\r\nWARC-Date: x\r\nContent-Length: 2\r\n\r\n{i:02}") for i in range(25)]
    a = replica(spark, f"{tmp_path}/a", rows)
    replica(spark, f"{tmp_path}/b", rows)
    (file,) = glob.glob(f"{tmp_path}/b/files/file=1/*.gz")
    with open(file, "rb") as f:
        data = gzip.decompress(f.read())
    for name in (file, file.replace("/part", "/.part") + ".crc"):
        os.remove(name)
    with open(file, "wb") as f:
        f.write(gzip.compress(data.replace(b"Date: x", b"Date: y", 1)))
    bad = warc.compare(a, warc.read_replica(spark, f"{tmp_path}/b"), 4).where("status <> 'intact'").collect()
    assert [(x.page_id, x.status) for x in bad] == [(10, "corrupt")]


def test_a_loss_in_the_middle_by_hashes(spark):
    table = pages(spark, 200)
    own = warc.ordered(table)
    lost = own.where("page_id = 101").first().position
    less = own.where(F.col("position") != lost).withColumn("position", F.when(F.col("position") > lost, F.col("position") - 1).otherwise(F.col("position")))
    assert [(x.position, x.status) for x in warc.fixity_audit(table, less).where("status <> 'intact'").collect()] == [(lost, "missing")]


def unlike(spark, n=600):
    return [(i, i, f"WARC/1.1\r\nWARC-Date: x\r\nContent-Length: 3\r\n\r\n{i:03}") for i in range(n)]


def test_a_replica_in_reversed_order_has_moved(spark, tmp_path):
    rows = unlike(spark)
    a = replica(spark, f"{tmp_path}/a", rows)
    b = replica(spark, f"{tmp_path}/b", [(i, len(rows) - 1 - p, r) for i, p, r in rows])
    assert {x.status for x in warc.compare(a, b).collect()} == {"moved"}
    # the same records in other files, in their order: nothing has moved
    shifted = replica(spark, f"{tmp_path}/c", [(i, p + 3, r) for i, p, r in rows])
    assert {x.status for x in warc.compare(a, shifted).collect()} == {"intact"}


def test_one_record_moved_far_names_three(spark, tmp_path):
    rows = unlike(spark, 60)
    order = [x for x in range(60) if x != 5]
    order.insert(40, 5)
    place = {i: p for p, i in enumerate(order)}
    a, b = replica(spark, f"{tmp_path}/a", rows), replica(spark, f"{tmp_path}/b", [(i, place[i], r) for i, _, r in rows])
    assert sorted(x.page_id for x in warc.compare(a, b, 3).where("status = 'moved'").collect()) == [5, 6, 41]


def test_a_record_without_a_slot_is_not_intact(spark, tmp_path):
    rows = unlike(spark)
    a, b = replica(spark, f"{tmp_path}/a", rows), replica(spark, f"{tmp_path}/b", rows)
    a = a.withColumn("slot", F.col("page_id") != 77).select(F.when(F.col("slot"), F.col("page_id")).alias("page_id"), F.when(F.col("slot"), F.col("position")).alias("position"), "file", "offset", "length", "leaf")
    got = [(x.status, x.page_id) for x in warc.compare(a, b).collect() if x.status != "intact"]
    assert sorted(got, key=str) == [("missing", None), ("surplus", 77)] and warc.compare(a, b).count() == 601
