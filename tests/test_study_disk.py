"""What cleaning and the steps of a build leave on disk."""

import glob
import os

from test_build import write_raw

from kairosdf.plans import build, cleaning_run
from kairosdf.sources.tables import write_table


def test_files_of_a_study_are_packed_and_raw_rows_are_not_kept(spark, tmp_path, monkeypatch):
    (tmp_path / "raw").mkdir()
    write_raw(tmp_path / "raw")
    kept, report = [], cleaning_run.cleaning_report

    def spy(raw, clean, notes=None):
        kept.append((raw["transactions"].is_cached, clean["transactions"].is_cached))
        return report(raw, clean, notes)

    monkeypatch.setattr(cleaning_run, "cleaning_report", spy)
    c = build.Checkpoint(spark, raw_dir=f"{tmp_path}/raw", processed_dir=f"{tmp_path}/processed", output_dir=f"{tmp_path}/splits", reports_dir=f"{tmp_path}/reports", compression="gzip")
    _ = c.train_part
    assert kept == [(False, True)]
    files = glob.glob(f"{tmp_path}/processed/*/part-*") + glob.glob(f"{tmp_path}/splits/primary/*/part-*")
    assert files and all(f.endswith(".csv.gz") for f in files)
    assert c.catalog.load_split("train").count() == c.parts["train"]["rows"] > 0 and not c.data["transactions"].is_cached
    c.close()
    assert not [x for x in os.listdir(tmp_path / "splits") if "copy" in x]


def test_a_packed_table_is_a_smaller_one(spark, tmp_path):
    rows = spark.range(20_000).selectExpr("cast(id as string) as a", "'one and the same' as b").repartition(1)
    for name, how in (("plain", None), ("packed", "gzip")):
        write_table(rows, f"{tmp_path}/{name}", order=["a"], compression=how)
    size = {x: sum(os.path.getsize(f) for f in glob.glob(f"{tmp_path}/{x}/part-*")) for x in ("plain", "packed")}
    assert size["packed"] * 4 < size["plain"]
