"""The driver's contract, with and without the corpus operators."""

import os
import subprocess
import sys

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["customerID", "ISIN", "net_units", "currently_held"]


def test_queries_equal_their_sql(spark, sf_dir):
    from kairosdf.plans import queries, study_queries

    assert study_queries.study
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)
    for name, run in queries.QUERIES.items():
        got, want = run(spark, sf_dir), con.sql(queries.ORACLE_SQL[name])
        columns = sorted(got.columns)
        assert columns == sorted(want.columns), name
        rows = lambda xs: sorted(tuple(map(str, x)) for x in xs)
        assert rows(got.select(*columns).collect()) == rows(want.select(*columns).fetchall()), name


def test_without_the_corpus_operators(tmp_path):
    for name in os.listdir(ROOT):
        if name not in ("corpus_pipeline.py", "kairosdf", ".git"):
            os.symlink(f"{ROOT}/{name}", tmp_path / name)
    (tmp_path / "kairosdf").mkdir()
    for name in os.listdir(f"{ROOT}/kairosdf"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{ROOT}/kairosdf/{name}", tmp_path / "kairosdf" / name)
    os.unlink(tmp_path / "__spark_entry__.py")
    (tmp_path / "__spark_entry__.py").write_text(open(f"{ROOT}/__spark_entry__.py").read())
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(n.startswith('op') and n[2].isdigit() for n in q), q; print(len(q))"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
