import pytest

from quillan.errors import NotFound
from quillan.streaming import mutations as m

ROWS = [(0, "add", 0, [1.0, 2.0]), (1, "add", 1, [3.0, 4.0]), (2, "add", 2, [5.0, 6.0]), (3, "remove", 1, None)]


def log(spark, rows):
    return spark.createDataFrame(rows, m.LOG)


def test_live_rows(spark):
    got = {r["id"]: r["vec"] for r in m.live(log(spark, ROWS)).collect()}
    assert got == {0: [1, 2], 2: [5, 6]}
    revived = m.live(log(spark, ROWS + [(4, "update", 1, [7.0, 8.0])]))
    assert {r["id"]: r["vec"] for r in revived.collect()}[1] == [7, 8]
    assert m.live(log(spark, [])).count() == 0


def test_apply_and_unknown_ids(spark):
    base = m.live(log(spark, ROWS)).select("id", "vec")
    more = log(spark, [(10, "update", 2, [0.0, 0.0]), (11, "remove", 0, None)])
    assert {r["id"]: r["vec"] for r in m.checked(base, more).collect()} == {2: [0, 0]}
    with pytest.raises(NotFound):
        m.checked(base, log(spark, [(10, "remove", 77, None)]))


def test_new_ids_are_never_used_again(spark):
    base = m.live(log(spark, ROWS)).select("id", "vec")
    added = m.add(base, log(spark, ROWS), spark.createDataFrame([([9.0, 9.0],)], "vec array<float>")).first()
    assert (added["seq"], added["id"]) == (4, 3)
    wanted = spark.createDataFrame([(0, 2), (1, 1)], "pos int, id long")
    assert [r["vec"] for r in m.get(base, wanted).orderBy("pos").collect()] == [[5, 6], None]


def test_pending_and_rebuild(spark):
    all_ = log(spark, ROWS)
    assert m.pending(all_, 1).count() == 2 and m.needs_rebuild(all_, 1, 2) and not m.needs_rebuild(all_, 1, 3)


def test_versions_and_stream(spark, tmp_path):
    versions = m.Versions(spark, str(tmp_path / "table"))
    assert versions.current() is None
    source = str(tmp_path / "in")
    log(spark, ROWS).coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema(m.LOG).parquet(source)
    run = lambda: m.follow(stream(), str(tmp_path / "log"), str(tmp_path / "cp"), versions, 4).awaitTermination()
    run()
    assert {r["id"] for r in versions.current().collect()} == {0, 2}
    log(spark, [(9, "update", 0, [4.0, 4.0])]).coalesce(1).write.mode("append").parquet(source)
    run()
    whole = spark.read.parquet(str(tmp_path / "log")).drop("batch")
    assert whole.count() == 5
    assert m.compact(versions, whole) == 2
    assert {r["id"]: r["vec"] for r in versions.current().collect()} == {0: [4, 4], 2: [5, 6]}
    assert {r["id"] for r in versions.at(1).collect()} == {0, 2} and versions.upto() == 9
    with pytest.raises(NotFound):
        versions.at(7)


def test_pending_rows_outlive_a_restart(spark, tmp_path):
    versions, source = m.Versions(spark, str(tmp_path / "table")), str(tmp_path / "in")
    run = lambda: m.follow(spark.readStream.schema(m.LOG).parquet(source), str(tmp_path / "log"), str(tmp_path / "cp"), versions, 5, truncate=True).awaitTermination()
    log(spark, ROWS).coalesce(1).write.parquet(source)
    run()
    assert versions.current() is None and versions.upto() == -1
    log(spark, [(9, "update", 0, [4.0, 4.0])]).coalesce(1).write.mode("append").parquet(source)
    run()  # four rows waited, one came
    assert {r["id"]: r["vec"] for r in versions.current().collect()} == {0: [4, 4], 2: [5, 6]} and versions.upto() == 9
    log(spark, [(10 + k, "update", 5, [float(k), 0.0]) for k in range(4)] + [(20, "remove", 2, None)]).coalesce(1).write.mode("append").parquet(source)
    run()
    assert {r["id"]: r["vec"] for r in versions.current().collect()} == {0: [4, 4], 5: [3, 0]}
    assert versions.newest() == 2 and not list((tmp_path / "log").glob("batch=*"))
