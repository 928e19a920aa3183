"""Archives read in parts and reports published together."""

import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from auditloom.plans import views
from auditloom.sources import archive_parts, project_dir, report_sink
from auditloom.sources import driver_tables as dt


def rows(df):
    return sorted((r["archive"].rsplit("/", 1)[-1], r["member"], r["size"], r["packed_size"], r["within_limits"], bytes(r["raw"]) if r["raw"] is not None else None, r["path"]) for r in df.collect())


def test_an_archive_is_many_tasks_with_the_same_rows(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    (tmp_path / "in").mkdir()
    with zipfile.ZipFile(tmp_path / "in" / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(120):
            z.writestr(f"src/d{k % 7}/f{k}.py", rng.randbytes(rng.randrange(1, 20_000)))
        z.writestr("__MACOSX/._a", "x")
        z.writestr("../up.py", "x")
        z.writestr("dir/", "")
    with zipfile.ZipFile(tmp_path / "in" / "b.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("bomb.txt", "0" * 3_000_000)
    with zipfile.ZipFile(tmp_path / "in" / "empty.zip", "w"):
        pass
    got = archive_parts.archive_parts(spark, f"file://{tmp_path}/in", part_bytes=100_000)
    assert got.rdd.getNumPartitions() >= 8
    whole = project_dir.archive_members(spark, f"file://{tmp_path}/in")
    assert rows(got) == rows(whole) and len(rows(got)) == 122
    assert {r[1]: (r[4], r[5]) for r in rows(got)}["bomb.txt"] == (False, None) and {r[1]: r[6] for r in rows(got)}["../up.py"] is None
    one = archive_parts.archive_parts(spark, f"{tmp_path}/in/a.zip")
    assert one.rdd.getNumPartitions() == 1 and one.count() == 121
    assert archive_parts.archive_parts(spark, f"file://{tmp_path}/in/empty.zip").count() == 0


def test_reports_of_all_tasks_in_one_job(spark, sf, tmp_path):
    f = dt.findings(spark, sf).filter("task_id < 12").withColumn("review_status", F.when(F.col("seq") % 5 == 0, "rejected").when(F.col("task_id") == 7, "rejected")).withColumn("title", F.concat("title", F.lit(" <&>")))
    path = f"file://{tmp_path}/reports"
    report_sink.write_reports(f, path, most=20)
    assert sorted(os.listdir(tmp_path / "reports")) == sorted(f"{t}.html" for t in range(12))
    for task in (0, 3, 7):
        assert (tmp_path / "reports" / f"{task}.html").read_text() == views.report_html(f, task, 20)
    report_sink.write_reports(f.filter("task_id = 3").limit(1), path)
    assert "1 findings" in (tmp_path / "reports" / "3.html").read_text() and len(os.listdir(tmp_path / "reports")) == 12


def test_a_job_that_fails_leaves_no_report(spark, sf, tmp_path):
    f = dt.findings(spark, sf).filter("task_id < 5").withColumn("review_status", F.lit("confirmed"))
    broken = f.withColumn("title", F.when(F.col("task_id") == 4, F.raise_error(F.lit("broken"))).otherwise(F.col("title")))
    with pytest.raises(Exception, match="broken"):
        report_sink.write_reports(broken, f"file://{tmp_path}/reports")
    assert not os.path.exists(tmp_path / "reports") or os.listdir(tmp_path / "reports") == []
