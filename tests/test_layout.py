"""The library without its corpus operators still imports and lists its queries."""

import pathlib
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_everything_else_works_without_the_corpus_folders(tmp_path):
    for keep in (True, False):
        copy = tmp_path / str(keep)
        shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "llm"))
        if not keep:
            (copy / "corpus_pipeline.py").unlink(missing_ok=True)
        code = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert q and set(s) <= set(q) and not any(k.startswith('op') or k == 'pipeline' for k in q), sorted(q)"
        if not keep:  # and some of them run, Python workers included
            code += "\nfrom pyspark.sql import SparkSession\nspark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\nassert e.entry(spark).count() and all(q[k](spark, '/root/testdata/sf0.001').count() for k in ('candidate_links', 'composed_posts', 'latest_per_key'))"
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=300)


def test_no_module_outside_imports_the_corpus_operators():
    for path in (ROOT / "tidemill").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "tidemill").parts:
            assert "llm" not in path.read_text(encoding="utf-8"), path
