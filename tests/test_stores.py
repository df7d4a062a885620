"""Content hashes do not depend on splits, and every kind of spoilt file is named."""

import gzip
import hashlib
import random

from pyspark.sql import functions as F

from tracksieve.operators import stores


def tree(lines, fanout=1024):
    level = [hashlib.sha256(x).hexdigest() for x in lines]
    while True:
        level = [hashlib.sha256("".join(h + "\n" for h in level[i:i + fanout]).encode()).hexdigest() for i in range(0, len(level), fanout)]
        if len(level) == 1:
            return level[0]


def records(content):
    parts = content.split(b"\n")
    return parts[:-1] if parts[-1] == b"" else parts


def test_binary_files_in_many_splits_equal_a_plain_loop(spark, tmp_path):
    draw = random.Random(3)
    files = {"a/one.bin": draw.randbytes(1_500_000), "a b+c/two.bin": draw.randbytes(70_000), "lines.txt": b"".join(b"%d\n" % i for i in range(5000)), "empty.txt": b""}
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    want = {n: (len(c), len(records(c)), tree(records(c))) for n, c in files.items() if c}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("100000", old):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = {r.name: (r.bytes, r.lines, r.sha256) for r in stores.content_hashes(spark, str(tmp_path)).collect()}
            assert got == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_each_kind_of_spoilt_file_is_named(spark, tmp_path):
    text = b"".join(b"row %d\n" % i for i in range(3000))
    good = {"ok.csv.gz": gzip.compress(text), "cut.csv.gz": gzip.compress(text), "flip.txt": text, "gone.txt": text, "half.txt.partial": text}
    for name, content in good.items():
        (tmp_path / name).write_bytes(content)
    before = stores.store_state(spark, str(tmp_path)).first()
    manifest = spark.createDataFrame(stores.content_hashes(spark, str(tmp_path)).drop("lines").collect())
    assert stores.store_state(spark, str(tmp_path)).first() == before and before.partial_files == 1
    (tmp_path / "cut.csv.gz").write_bytes(good["cut.csv.gz"][:-400])
    (tmp_path / "flip.txt").write_bytes(text.replace(b"row 7\n", b"row 8\n"))
    (tmp_path / "gone.txt").rename(tmp_path / "more.txt")
    found = stores.content_hashes(spark, str(tmp_path)).withColumn("partial", F.rlike("name", F.lit(stores.PARTIAL)))
    assert dict(map(tuple, stores.audit(found, manifest).collect())) == {
        "ok.csv.gz": "ok", "cut.csv.gz": "truncated", "flip.txt": "damaged", "gone.txt": "missing", "more.txt": "unlisted", "half.txt.partial": "partial"}
    assert stores.store_state(spark, str(tmp_path)).first().sha256 != before.sha256


def test_snapshots_fail_as_rows(spark, tmp_path):
    (tmp_path / "none.csv").write_bytes(b"")
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "x.csv").write_bytes(b"a,b\n1,2\n3,4\n")
    rows = [stores.snapshot_source(spark, n, str(tmp_path / p), "csv", header="true").first() for n, p in (("s", "two"), ("e", "none.csv"), ("m", "absent"))]
    assert [(r.status, r.files, r.bytes, r.rows, r.columns, r.failure) for r in rows] == [
        ("complete", 1, 12, 2, 2, None), ("empty", 0, 0, 0, 0, None), ("failed", None, None, None, None, "PATH_NOT_FOUND")]
