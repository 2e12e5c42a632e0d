"""Records that don't fit their declared types are counted, kept apart, and limited."""

import pytest

from tarnish import fixed_values as fv
from tarnish.sources import ingest

COLUMNS = [("id", "bigint"), ("at", "timestamp_ntz"), ("price", "double"), ("note", "string")]
GOOD = ["1,2017-01-02 03:04:05,1.5,plain", '2,,,"with, comma"', "3,2017-01-02 03:04:05,,"]
BAD = ["x,2017-01-02 03:04:05,1.5,no key", "4,yesterday,1.5,no date", "5,2017-01-02 03:04:05,cheap,no price", "6,2017-01-02 03:04:05",
       "7,2017-01-02 03:04:05,1.5,too,many"]


def written(path, lines):
    path.mkdir()
    for k in range(2):
        (path / f"{k}.csv").write_text("\n".join([",".join(c for c, _ in COLUMNS), *lines[k::2]]) + "\n")
    return str(path)


def test_rejects_are_counted_and_kept(spark, tmp_path):
    raw, folder = written(tmp_path / "raw", GOOD + BAD), str(tmp_path / "bronze")
    report = ingest.ingest_csv(spark, raw, "things", COLUMNS, False, folder, limit=0.7).first()
    assert tuple(report) == ("things", 8, 5, 3)
    stored = spark.read.parquet(f"{folder}/things")
    assert stored.dtypes == COLUMNS and sorted((r["id"], r["note"]) for r in stored.collect()) == [
        (1, "plain"), (2, "with, comma"), (3, None)]
    rejects = spark.read.parquet(f"{folder}/quarantine/things").collect()
    assert sorted(r["record"] for r in rejects) == sorted(BAD)
    assert {r["_file"].rsplit("/", 1)[1] for r in rejects} == {"0.csv", "1.csv"}


def test_too_many_rejects_leave_bronze_alone(spark, tmp_path):
    folder = str(tmp_path / "bronze")
    ingest.ingest_csv(spark, written(tmp_path / "first", GOOD), "things", COLUMNS, False, folder)
    with pytest.raises(ingest.TooManyRejects, match="5 of 8"):
        ingest.ingest_csv(spark, written(tmp_path / "second", GOOD + BAD), "things", COLUMNS, False, folder, limit=0.6)
    assert spark.read.parquet(f"{folder}/things").count() == 3
    assert spark.read.parquet(f"{folder}/quarantine/things").count() == 5


def test_all_nine_tables(spark, tmp_path):
    sample = {"string": "s", "bigint": "7", "int": "7", "double": "1.5", "timestamp_ntz": "2017-01-02 03:04:05"}
    raw = tmp_path / "raw"
    raw.mkdir()
    for k, (file, name, columns, _) in enumerate(fv.RAW_TABLES):
        row = ",".join(sample[t] for _, t in columns)
        lead = "" if name == "category_translation" else "export_"
        (raw / f"{lead}{file}").write_text("\n".join([",".join(c for c, _ in columns), *[row] * (k + 1), "short"]) + "\n")
    report = {r["table_name"]: tuple(r)[1:] for r in ingest.ingest_raw_tables(
        spark, str(raw), str(tmp_path / "bronze"), "export_", limit=0.5).collect()}
    assert len(report) == 10 and report["TOTAL"] == (54, 9, 45)
    for k, (_, name, columns, _) in enumerate(fv.RAW_TABLES):
        assert report[name] == (k + 2, 1, k + 1)
        assert spark.read.parquet(f"{tmp_path}/bronze/{name}").dtypes == [(c, t) for c, t in columns]
