"""Image headers by byte ranges, and the counters that a stream observes."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from gradeloom.plans import source_queries
from gradeloom.plans.source_queries import _picture
from gradeloom.sources import images
from gradeloom.streaming import jobs


def _reader(data, log=None):
    def read(at, n):
        if log is not None:
            log.append(n)
        return data[at : at + n]

    return read


def test_headers_of_each_format():
    assert images.read_header(_reader(_picture(1, 641, 480))) == ("png", 641, 480, 1)
    log = []
    assert images.read_header(_reader(_picture(7, 300, 200), log)) == ("jpeg", 300, 200, 3)
    assert sum(log) < 100  # the long segments are stepped over
    assert images.read_header(_reader(b"GIF89a" + struct.pack("<HH", 5, 9) + bytes(9))) == ("gif", 5, 9, 3)
    # fill bytes, a marker without a length, and a table whose kind lies among the frame headers
    odd = b"\xff\xd8\xff\xff\xff\x01\xff\xc4\x00\x04ab\xff\xc2\x00\x11\x08" + struct.pack(">HHB", 2, 3, 1)
    assert images.read_header(_reader(odd)) == ("jpeg", 3, 2, 1)


def test_no_bytes_crash_the_parser():
    rng = random.Random(3)
    whole = [_picture(1, 20, 30), _picture(7, 20, 30), b"GIF87a\x01\x00\x02\x00", b"", b"\xff\xd8" + b"\xff\xfe\x00\x02" * 20_000]
    for data in whole:
        for _ in range(60):
            cut = bytearray(data[: rng.randrange(len(data) + 1)])
            for _ in range(rng.randrange(3)):
                if cut:
                    cut[rng.randrange(len(cut))] = rng.randrange(256)
            try:
                images.read_header(_reader(bytes(cut)))
            except ValueError:
                pass


def test_broken_and_missing_files_are_rows(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(_picture(1, 10, 20))
    (tmp_path / "b.jpg").write_bytes(_picture(7, 30, 40))
    (tmp_path / "c.png").write_bytes(_picture(1, 10, 20)[:20])
    listed = images.list_files(spark, str(tmp_path)).select("path")
    more = listed.unionByName(spark.createDataFrame([(str(tmp_path / "gone.png"),), (None,)], "path string"))
    rows = {(r["path"] or "/").rsplit("/", 1)[1]: r for r in images.image_headers(more).collect()}
    assert set(rows) == {"a.png", "b.jpg", "c.png", "gone.png", ""}
    assert rows["a.png"][1:] == ("png", 10, 20, 1, None) and rows["b.jpg"][1:] == ("jpeg", 30, 40, 3, None)
    assert rows["c.png"]["error"].startswith("ValueError") and rows["gone.png"]["error"].startswith("FileNotFoundError")
    assert rows[""]["error"] and rows[""]["width"] is None
    # the same from bytes that Spark has read
    read = {r["path"].rsplit("/", 1)[1]: r for r in images.image_headers(images.scan_images(spark, str(tmp_path))).collect()}
    assert all(read[k][1:] == rows[k][1:] for k in ("a.png", "b.jpg", "c.png"))


def _outcomes(spark, path, ids):
    rows = [("s", i, "i", "q", "c", i % 2 == 0, "boom" if i % 5 == 0 else None, "missing_files" if i % 4 == 3 else None) for i in ids]
    spark.createDataFrame(rows, jobs.OUTCOME).coalesce(1).write.mode("append").json(path)


def _expected(ids):
    done = [i for i in ids if i % 4 != 3]
    return len(done), sum(i % 2 == 0 for i in done), sum(i % 5 == 0 for i in done), len(ids) - len(done)


def test_counters_of_every_batch_over_restarts(spark, tmp_path):
    path, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    batches = [range(0, 10), range(10, 17), range(17, 40)]
    for ids in batches:
        _outcomes(spark, path, ids)
        stream = jobs.read_action_stream(spark, path, jobs.OUTCOME, 1)
        jobs.stream_progress(stream, out, checkpoint).finish()
    rows = jobs.observed_progress(spark, out, 50).orderBy("epoch").collect()
    assert [tuple(r)[1:5] for r in rows] == [_expected(ids) for ids in batches]
    assert [r["left"] for r in rows] == [40, 33, 10]


def test_counters_lost_with_their_driver_are_counted_again(spark, tmp_path):
    path, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    _outcomes(spark, path, range(8))
    run = jobs.stream_progress(jobs.read_action_stream(spark, path, jobs.OUTCOME, 1), out, checkpoint)
    run.query.awaitTermination()  # and no counters are written
    run.counters.wait(str(run.query.runId), 60)
    spark.streams.removeListener(run.counters)
    _outcomes(spark, path, range(8, 20))
    jobs.stream_progress(jobs.read_action_stream(spark, path, jobs.OUTCOME, 1), out, checkpoint).finish()
    told = spark.read.schema(jobs._COUNTED).json(f"{out}-progress")
    assert told.count() == 1
    rows = jobs.observed_progress(spark, out, 20).orderBy("epoch").collect()
    assert [tuple(r)[1:5] for r in rows] == [_expected(range(8)), _expected(range(8, 20))]
    assert [r["left"] for r in rows] == [12, 0]


def test_a_failing_stream_keeps_its_counters(spark, tmp_path):
    path, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for ids in (range(4), range(4, 9)):
        _outcomes(spark, path, ids)
    stream = jobs.read_action_stream(spark, path, jobs.OUTCOME, 1)
    # the second file fails
    bad = stream.withColumn("correct", F.when(F.col("row_idx") > 5, F.raise_error(F.lit("broken"))).otherwise(F.col("correct")).cast("boolean"))
    run = jobs.stream_progress(bad, out, checkpoint)
    with pytest.raises(Exception, match="broken"):
        run.finish()
    assert jobs.observed_progress(spark, out, 9).select("processed", "left").collect() == [(3, 5)]


def test_many_files_are_listed_by_few_tasks(spark, tmp_path):
    for i in range(400):
        (tmp_path / str(i % 5)).mkdir(exist_ok=True)
        (tmp_path / str(i % 5) / f"{i}.img").write_bytes(b"x" * (1 + i % 3))
    (tmp_path / "empty.img").write_bytes(b"")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    listed = images.list_files(spark, str(tmp_path))
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before
    assert len(listed.inputFiles()) <= 9  # one a task; 400 files at 4 MB each made 13
    assert sorted(map(tuple, listed.collect())) == sorted((str(tmp_path / str(i % 5) / f"{i}.img"), 1 + i % 3) for i in range(400))


def test_pictures_are_spread_over_folders(spark, monkeypatch):
    sizes = spark.createDataFrame([(i, 10 + i, 20) for i in range(300)], "image long, width long, height long")
    monkeypatch.setattr(source_queries.adapters, "image_sizes", lambda spark, sf_dir: sizes)
    seen, run = [], images.list_files
    monkeypatch.setattr(source_queries.images, "list_files", lambda *a: seen.append(run(*a)) or seen[0])
    got = {r["image"]: (r["format"], r["width"]) for r in source_queries.image_headers(spark, "").collect()}
    assert got == {i: (None, None) if i % 11 == 0 else ("png" if i % 7 else "jpeg", 10 + i) for i in range(300)}
    assert seen[0].select(F.regexp_extract("path", "(.*)/", 1).alias("d")).groupBy("d").count().agg(F.max("count")).first()[0] == 2
