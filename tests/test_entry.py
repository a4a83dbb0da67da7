"""The driver's three functions, and that the rest works without the corpus subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    rows = e.entry(spark)
    assert rows.columns == ["organisation_number", "name", "municipality", "employees", "revenue", "cited_modules"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_corpus(tmp_path):
    """With the corpus folders away, the entry file still imports and has the other queries."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'refresh_diff' in q; print(len(q))"], cwd=copy, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert int(said.stdout.split()[-1]) > 60


def test_nothing_else_imports_the_corpus_subpackage():
    for folder, _, files in os.walk(os.path.join(ROOT, "heddle")):
        if os.sep + "llm" in folder:
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f), encoding="utf-8") as text:
                    assert "heddle.llm" not in text.read(), f


def test_workers_import_the_package_from_any_folder(tmp_path, sf_dir):
    """A driver that was started elsewhere, without a path in its environment: queries send the package along."""
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
import __spark_entry__ as e
from heddle.session import local_session
spark = local_session(2, "elsewhere", **{{"spark.sql.shuffle.partitions": "2"}})
print("rows", e.queries()["sequence_ratio"](spark, {sf_dir!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert said.returncode == 0, said.stderr[-2000:]
    assert int(said.stdout.split("rows")[-1]) > 0


def test_every_query_reads_a_table(spark, sf_dir):
    """No query outside of the corpus operators runs on literal rows alone."""
    from heddle.registry import QUERIES

    streams = {n for n in QUERIES if n.startswith("stream_")}
    for name in ("news_mentions", "iso_times", "accounting_obligation", "screen_plan_rows", "screen_refused", "headline_match", "public_url_reject", "org_number_extract", "identity_score_v1", "identity_score_v2", "name_dialects", "revenue_fallback", "job_cards", "js_shell"):
        assert name not in streams and QUERIES[name](spark, sf_dir).inputFiles(), name
