"""Replacement of tables that others read: whole versions only, whatever happens to writers."""

import threading

import pytest
from pyspark.sql import functions as F

from foliospark.sources import published
from foliospark.sources.published import Conflict, clean, current, publish, publish_partitions, read_published
from tests.conftest import bag


def numbered(spark, rows, value):
    """``rows`` rows in three partitions, all with one value."""
    return spark.range(rows).select("id", F.lit(value).alias("value"), F.expr("date_add(DATE '2022-01-01', cast(id % 3 as int))").alias("day"))


def folders(path):
    return sorted(p.name for p in path.iterdir() if p.name.startswith("version="))


@pytest.fixture
def table(tmp_path):
    return tmp_path / "table"


@pytest.mark.parametrize("by", [None, "day"])
def test_replace_and_read_back(spark, table, by):
    with pytest.raises(FileNotFoundError):
        read_published(spark, str(table))
    for value, rows in ((1, 10), (2, 7)):
        df = numbered(spark, rows, value)
        assert publish(df, str(table), by).number == value
        back = read_published(spark, str(table))
        assert back.schema.simpleString() == df.schema.simpleString() and bag(back) == bag(df)
    assert bag(read_published(spark, str(table), 1)) == bag(numbered(spark, 10, 1))


def test_a_plan_replaces_the_table_it_reads(spark, table):
    publish(numbered(spark, 9, 1), str(table), "day")
    for _ in range(3):
        publish(read_published(spark, str(table)).withColumn("value", F.col("value") * 2).filter("id < 8"), str(table), "day")
    assert bag(read_published(spark, str(table))) == bag(numbered(spark, 8, 8))


def test_a_killed_writer_leaves_the_table(spark, table, monkeypatch):
    publish(numbered(spark, 9, 1), str(table), "day")

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(published, "_commit", killed)
        for write in (lambda: publish(numbered(spark, 9, 2), str(table), "day"), lambda: publish_partitions(numbered(spark, 3, 3), str(table), "day")):
            with pytest.raises(KeyboardInterrupt):
                write()
    assert bag(read_published(spark, str(table))) == bag(numbered(spark, 9, 1)) and len(folders(table)) == 3
    assert clean(spark, str(table)) == []  # they could belong to a running writer
    assert len(clean(spark, str(table), grace=0)) == 2 and len(folders(table)) == 1
    assert bag(read_published(spark, str(table))) == bag(numbered(spark, 9, 1))


def test_a_job_that_fails_leaves_the_table(spark, table):
    publish(numbered(spark, 9, 1), str(table))
    broken = numbered(spark, 9, 2).withColumn("value", F.expr("cast(if(id = 5, 'x', '1') AS int)"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        publish(broken, str(table))
    assert bag(read_published(spark, str(table))) == bag(numbered(spark, 9, 1)) and current(spark, str(table)).number == 1


def test_readers_see_whole_versions_while_writers_run(spark, table):
    publish(numbered(spark, 30, 0), str(table), "day")
    seen, wrong, stop = set(), [], threading.Event()

    def write(first):
        for k in range(first, first + 4):
            publish(numbered(spark, 30 + k, k), str(table), "day")

    def read():
        while not stop.is_set():
            rows = read_published(spark, str(table)).groupBy("value").count().collect()
            seen.add(rows[0][0])
            if len(rows) != 1 or rows[0][1] != 30 + rows[0][0]:
                wrong.append(rows)

    writers = [threading.Thread(target=write, args=(k,)) for k in (1, 11)]
    reader = threading.Thread(target=read)
    for t in (reader, *writers):
        t.start()
    for t in writers:
        t.join()
    stop.set()
    reader.join()
    assert not wrong and seen
    assert current(spark, str(table)).number == 9  # no commit of two writers is lost


def test_a_reader_outlives_the_next_versions(spark, table):
    publish(numbered(spark, 9, 1), str(table))
    before = read_published(spark, str(table))
    publish(numbered(spark, 4, 2), str(table))
    assert clean(spark, str(table), keep=2, grace=0) == []
    assert before.count() == 9
    publish(numbered(spark, 5, 3), str(table))
    assert len(clean(spark, str(table), keep=2, grace=0)) == 1
    assert read_published(spark, str(table), 2).count() == 4 and current(spark, str(table), 1) is None


def test_one_partition_is_replaced(spark, table):
    day = "2022-01-02"
    publish(numbered(spark, 30, 1), str(table), "day")
    old = current(spark, str(table)).parts
    publish_partitions(numbered(spark, 30, 2).filter(F.col("day") == day), str(table), "day")
    new = current(spark, str(table)).parts
    assert {p for p in new if new[p] != old[p]} == {day} and new.keys() == old.keys()
    got = {str(r.day): (r.value, r.n) for r in read_published(spark, str(table)).groupBy("day", "value").agg(F.count("*").alias("n")).collect()}
    assert got == {"2022-01-01": (1, 10), day: (2, 10), "2022-01-03": (1, 10)}
    publish_partitions(numbered(spark, 0, 3), str(table), "day", emptied=[day, "2022-01-03"])
    assert [str(r.day) for r in read_published(spark, str(table)).select("day").distinct().collect()] == ["2022-01-01"]
    assert read_published(spark, str(table), only=[day]).count() == 0
    with pytest.raises(ValueError):
        publish_partitions(numbered(spark, 3, 3).drop("value"), str(table), "day")


def test_conflicts(spark, table):
    publish(numbered(spark, 9, 1), str(table), "day")
    publish(numbered(spark, 9, 2), str(table), "day")
    with pytest.raises(Conflict):
        publish_partitions(numbered(spark, 9, 3), str(table), "day", based_on=1)
    assert publish_partitions(numbered(spark, 9, 3), str(table), "day", based_on=2).number == 3


def test_empty_and_null_partitions(spark, table):
    publish(numbered(spark, 0, 1), str(table), "day")
    assert read_published(spark, str(table)).count() == 0
    assert read_published(spark, str(table)).columns == ["id", "value", "day"]
    rows = numbered(spark, 6, 1).withColumn("day", F.when(F.col("id") > 2, F.col("day")))
    publish(rows, str(table), "day")
    assert bag(read_published(spark, str(table))) == bag(rows)


def test_partition_filters_reach_the_scan(spark, table):
    publish(numbered(spark, 30, 1), str(table), "day")
    publish_partitions(numbered(spark, 30, 2).filter("day = DATE '2022-01-02'"), str(table), "day")
    plan = read_published(spark, str(table)).filter("day = DATE '2022-01-02'").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "value" not in plan.split("ReadSchema")[1]


def test_reports_follow_the_months_that_changed(spark, tmp_path, monkeypatch):
    """Replacing a month rewrites that month of each report and reads no other; the result is the whole build's."""
    from foliospark.plans import grouped, tracking
    from queries.mapping import Inputs
    from queries.steps import MANY

    rows = tracking.build_tracking(Inputs(spark, "/root/testdata/sf0.001", MANY))
    path = str(tmp_path / "tracking")
    publish(rows, path, grouped.MONTH)
    months = sorted(current(spark, path).parts)
    for name in grouped.REPORTS:
        assert grouped.refresh_report(spark, path, str(tmp_path / name), name) == months
        assert grouped.refresh_report(spark, path, str(tmp_path / name), name) == []
    before = {name: current(spark, str(tmp_path / name)) for name in grouped.REPORTS}
    old = read_published(spark, path, only=[months[3]])
    publish_partitions(old.withColumn("Cupo", F.col("Cupo") + 1), path, grouped.MONTH)
    publish_partitions(old.limit(0), path, grouped.MONTH, emptied=[months[5]])
    read = []
    real = read_published
    monkeypatch.setattr(grouped, "read_published", lambda *a, **k: read.append(real(*a, **k)) or read[-1])
    for name, build in grouped.REPORTS.items():
        report = str(tmp_path / name)
        assert grouped.refresh_report(spark, path, report, name) == [months[3], months[5]]
        files = read.pop().inputFiles()
        assert files and all(f"FechaFoto={months[3]}/" in f for f in files)
        after = current(spark, report)
        assert {m for m in months if after.parts.get(m) != before[name].parts[m]} == {months[3], months[5]} and months[5] not in after.parts
        assert bag(real(spark, report)) == bag(build(real(spark, path))) and after.source == current(spark, path).parts
