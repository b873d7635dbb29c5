import pytest

from coppice.operators.records import Mapping
from coppice.streaming import intake

SCHEMA = "row_index long, number string, summary string"
ROWS = [(0, "A", "vpn down"), (1, "", "x"), (2, "B", "mail down"), (3, "C", " ")]


def run(spark, tmp_path):
    arriving = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = intake.stream_records(arriving, Mapping(0, 1), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    return query


def found(spark, tmp_path):
    records, ignored = intake.written_records(spark, str(tmp_path / "out"))
    return sorted(map(tuple, records.select("row_index", "incident_number", "analysis_text").collect())), sorted(map(tuple, ignored.collect()))


EXPECTED = [(0, "A", "vpn down"), (2, "B", "mail down")], [(1, True, False), (3, False, True)]


def test_intake_splits_arriving_rows(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    run(spark, tmp_path)
    assert found(spark, tmp_path) == EXPECTED
    plan = intake.written_records(spark, str(tmp_path / "out"))[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "PartitionFilters: [isnotnull(side" in plan


def test_a_batch_that_fails_after_it_was_written_is_written_once(spark, tmp_path, monkeypatch):
    for row in ROWS:
        spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    plain, done = intake.write_batch, []

    def fails_once(judged, path, number):
        plain(judged, path, number)
        done.append(number)
        if number == 2 and done.count(2) == 1:
            raise RuntimeError("the driver is lost before the batch is committed")

    monkeypatch.setattr(intake, "write_batch", fails_once)
    with pytest.raises(Exception, match="driver is lost"):
        run(spark, tmp_path)
    assert done == [0, 1, 2]
    run(spark, tmp_path)
    assert done == [0, 1, 2, 2, 3] and found(spark, tmp_path) == EXPECTED
    run(spark, tmp_path)
    assert done == [0, 1, 2, 2, 3] and found(spark, tmp_path) == EXPECTED


def test_a_batch_has_one_scan(spark, tmp_path):
    from coppice.operators.records import judged_rows

    spark.createDataFrame(ROWS, SCHEMA).write.parquet(str(tmp_path / "in"))
    judged = judged_rows(spark.read.parquet(str(tmp_path / "in")), Mapping(0, 1), ["number", "summary"])
    assert judged._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
