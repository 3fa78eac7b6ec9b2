"""Streams run to completion over files, stopped and continued."""

import random
from datetime import datetime, timedelta

from studyloom.streaming import jobs as J

T0 = datetime(2024, 1, 1)
SCHEMA = "study int, ts timestamp, name string"


def events(n=300):
    """One study has most images; days pass without any."""
    rng = random.Random(4)
    rows, t = [], T0
    for i in range(n):
        t += timedelta(minutes=rng.choice([1, 5, 20, 29, 31, 60, 3000 if i % 40 == 0 else 2]))
        rows.append((1 if i % 3 else rng.randrange(2, 5), t, f"i{i}"))
    return rows


def sessions(rows, gap=timedelta(minutes=30)):
    out = []
    for study in sorted({r[0] for r in rows}):
        last = None
        for _, t, name in sorted(r for r in rows if r[0] == study):
            if last is None or t - last > gap:  # an image just as the window ends still belongs to it
                out.append([study, t, []])
            out[-1][2].append(name)
            last = t
    return sorted((s, t, tuple(names)) for s, t, names in out)


def run_sessions(spark, rows, base, cuts, day="1 day"):
    """Files arrive one by one, a run after each; the last run closes what is open."""
    for k, (a, b) in enumerate(cuts):
        spark.createDataFrame(rows[a:b], SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
        last = k == len(cuts) - 1
        if last:
            J.end_mark(spark.read.schema(SCHEMA).parquet(f"{base}/in"), "ts", f"{base}/marks", day)
        stream = J.with_end_marks(spark.readStream.schema(SCHEMA).parquet(f"{base}/in"), "ts", f"{base}/marks")
        closed = J.run_available(J.closed_studies(stream, "study", "ts", "30 minutes", "2 hours"), f"{base}/out", f"{base}/ck")
    images = spark.read.schema(SCHEMA).parquet(f"{base}/in")
    found = J.with_images(closed, images, "study", "ts", ["name"])
    return sorted((r["study"], r["first_at"], tuple(x["name"] for x in r["images"])) for r in found.collect())


def test_all_studies_are_closed_over_several_runs(spark, tmp_path):
    rows = events()
    cuts = [(0, 80), (80, 81), (81, 300), (300, 300)]
    assert run_sessions(spark, rows, str(tmp_path), cuts) == sessions(rows)


def test_batch_form_gives_the_same(spark):
    rows = events()
    found = J.group_images(spark.createDataFrame(rows, SCHEMA), "study", "ts", "30 minutes", ["name"])
    assert sorted((r["study"], r["first_at"], tuple(x["name"] for x in r["images"])) for r in found.collect()) == sessions(rows)


def test_append_new_is_idempotent(spark, tmp_path):
    base = str(tmp_path)
    first = [(1, T0, "a"), (1, T0 - timedelta(days=9000), "b"), (2, T0, "c"), (None, T0, "x"), (2, T0, "c")]
    later = [(3, T0, "d"), (1, T0 - timedelta(days=9999), "late"), (3, T0, "e")]
    want = {(1, "b"), (2, "c"), (3, "d")}

    def run(checkpoint):
        out = J.append_new(spark.readStream.schema(SCHEMA).parquet(f"{base}/in"), f"{base}/out", checkpoint, "study", ["ts", "name"])
        return sorted((r["study"], r["name"]) for r in out.collect())

    spark.createDataFrame(first, SCHEMA).write.parquet(f"{base}/in")
    assert run(f"{base}/ck") == [(1, "b"), (2, "c")]
    spark.createDataFrame(later, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
    assert run(f"{base}/ck") == sorted(want)
    assert run(f"{base}/ck") == sorted(want)
    # another checkpoint reads all files again and finds nothing new
    assert run(f"{base}/other") == sorted(want)
    # a batch that is replayed, as after a failure between its write and its commit
    done = sorted((tmp_path / "ck" / "commits").glob("[0-9]*"))[-1]
    done.unlink()
    (done.parent / f".{done.name}.crc").unlink(missing_ok=True)
    assert run(f"{base}/ck") == sorted(want)


def test_end_mark_has_no_key(spark, tmp_path):
    rows = spark.createDataFrame([(1, T0, "a")], SCHEMA)
    J.end_mark(rows, "ts", f"{tmp_path}/m", "1 hour")
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/m").collect()] == [(None, T0 + timedelta(hours=1), None)]
    assert spark.read.parquet(f"{tmp_path}/m").schema["ts"].dataType == rows.schema["ts"].dataType


def test_stream_reads_a_file_and_a_folder_of_part_files(spark, tmp_path):
    rows = events(60)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/in/events.parquet")
    spark.createDataFrame(rows[:5], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/one")
    next((tmp_path / "one").glob("part-*")).rename(tmp_path / "in" / "few.parquet")
    for name, n in (("events.parquet", 60), ("few.parquet", 5), ("e*.parquet", 60)):
        stream = J.read_parquet_stream(spark, f"{tmp_path}/in", name)
        assert J.run_available(stream, f"{tmp_path}/out-{n}-{len(name)}", f"{tmp_path}/ck-{n}-{len(name)}").count() == n
