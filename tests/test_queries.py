"""The registered queries against their SQL, and the optional part's absence."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from reachlake import storage
from reachlake.plans.input_queries import QUERIES as INPUTS
from reachlake.plans.queries import QUERIES as CORE
from reachlake.plans.queries import SHARED, forget_shared

QUERIES = CORE | INPUTS

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for name in TABLES:
        path = f"{SF}/{name}.parquet"
        connection.sql(f"create view {name} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return connection


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(f"{v[i]:.9g}" if isinstance(v[i], float) else str(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, tables, name):
    got = QUERIES[name](spark, SF)
    want = tables.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_shared_results_follow_the_tables(spark, tmp_path):
    """What queries share is made anew where a folder's files have changed, and where its table was removed."""
    for name in TABLES:
        os.symlink(f"{SF}/{name}.parquet", tmp_path / f"{name}.parquet")
    folder, query = str(tmp_path), QUERIES["provider_only"]
    ids = lambda: sorted(r.id for r in query(spark, folder).collect())
    first, kept = ids(), len(SHARED)
    assert first == ids() and len(SHARED) == kept
    storage.remove_tables(spark)
    assert ids() == first
    fewer = spark.read.parquet(f"{SF}/lineitem.parquet").filter("l_orderkey % 3 = 0")
    os.unlink(tmp_path / "lineitem.parquet")
    fewer.write.parquet(str(tmp_path / "lineitem.parquet"))
    forgotten = ids()
    forget_shared()
    assert forgotten == ids() != first


def test_entry(spark):
    assert sum(r.n for r in __spark_entry__.entry(spark).collect()) == 141


def test_without_the_text_part(tmp_path):
    """The entry imports and the library works where the text operators aren't there."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    (tmp_path / "reachlake").mkdir()
    for item in os.listdir(f"{root}/reachlake"):
        if item not in ("llm", "__pycache__"):
            os.symlink(f"{root}/reachlake/{item}", tmp_path / "reachlake" / item)
    os.symlink(f"{root}/__spark_entry__.py", tmp_path / "__spark_entry__.py")
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 60 and set(q) == set(s) and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env=os.environ | {"PYTHONPATH": str(tmp_path)})
