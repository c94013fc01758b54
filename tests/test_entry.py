"""The driver contract: names without a session, and the flagship query."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_names_need_no_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(*q)"
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert "p7_found" in said.stdout.split()


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "score", "rank"] and df.count() == 20


def test_workers_get_the_package(spark, tmp_path):
    """A session whose workers start elsewhere runs a query with Python in it."""
    code = (
        f"import sys; sys.path.insert(0, {str(ROOT)!r})\n"
        "from pyspark.sql import SparkSession\n"
        "import __spark_entry__ as e\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "print('ROWS', e.queries()['report_split'](s, '/root/testdata/sf0.001').count(), e.queries()['report_split'](s, '/root/testdata/sf0.001').where(\"matn <> ''\").count())\n"
    )
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=240)
    assert "ROWS 120" in said.stdout, said.stderr[-1500:]
