"""Text files, one per key: what is written and in how many tasks they are read."""

from studyloom.sources import readers, writers


def test_tasks_write_their_files(spark, tmp_path):
    rows = [(i, f"text {i}\nsecond line é") for i in range(300)] + [(7, "again"), (8, ""), (-1, "below"), (None, "none")]
    df = spark.createDataFrame(rows, "doc long, t string").repartition(6)
    for _ in range(2):  # a repeated task writes the same files
        writers.write_text_files(df, str(tmp_path / "w"), "doc", "t")
    folders = list((tmp_path / "w").iterdir())
    assert len(folders) <= 4  # Spark's writer made one for each document
    found = {r["path"].rsplit("/", 1)[-1]: r["text"] for r in readers.read_text_files(spark, str(tmp_path / "w")).collect()}
    assert len(found) == 302 and found["doc=5.txt"] == "text 5\nsecond line é\n" and found["doc=-1.txt"] == "below\n"
    assert sorted(found["doc=7.txt"].split("\n")) == ["", "again", "second line é", "text 7"]
    assert len(found["doc=8.txt"]) == len("text 8\nsecond line é\n\n") and found["doc=__HIVE_DEFAULT_PARTITION__.txt"] == "none\n"


def test_small_files_are_read_in_few_tasks(spark):
    cores = spark.sparkContext.defaultParallelism
    many = spark.range(0, 2000, 1, 2000)
    assert readers.merge_tasks(many).rdd.getNumPartitions() == 2000 // 16
    assert readers.merge_tasks(many, per_core=100).rdd.getNumPartitions() == cores * 100
    assert readers.merge_tasks(spark.range(0, 10, 1, 10)).rdd.getNumPartitions() == 10
