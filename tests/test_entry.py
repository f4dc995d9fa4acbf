import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from quarrylight.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
QUICK = ["bm25_phrases", "docs_search", "knn_cosine", "weighted_fusion", "rank_boosts", "changed_files", "debounced_events", "markdown_sections", "clean_descriptions"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_query_agrees_with_sql(spark, duck, name):
    mine, theirs = QUERIES[name](spark, DATA).toPandas(), duck.execute(SQL[name]).fetchdf()
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    rows = lambda d: sorted(map(str, d[columns].astype(object).where(d[columns].notna(), None).values.tolist()))
    assert rows(mine) == rows(theirs)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("left_out", [("llm",), ("llm", "corpus_pipeline.py")])
def test_library_stands_without_the_optional_parts(tmp_path, left_out):
    """As when the training-data subpackage and its tests are deleted, with and without the pipeline; all else is copied."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns(*left_out, ".git", "__pycache__"))
    code = (
        "import sys; root, to = sys.argv[1:]; sys.path[:] = [to] + [p for p in sys.path if p not in ('', root)]; "
        "import __spark_entry__ as e; found = e.queries(); assert e.__file__.startswith(to) and 'hybrid_search' in found and 'pipeline' not in found; "
        "assert not any(q.startswith('op') and q[2].isdigit() for q in found) and set(e.oracle_sql()) <= set(found)"
    )
    subprocess.run([sys.executable, "-c", code, root, str(tmp_path / "copy")], check=True, cwd=tmp_path, env=os.environ | {"PYTHONPATH": ""})
