"""The text queries against their SQL, and the whole set's names."""

import os
import random

import duckdb
import pytest

from reachlake.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    tables = duckdb.connect()
    for table in ("documents", "labels", "benchmark", "conversations"):
        path = f"{SF}/{table}.parquet"
        tables.sql(f"create view {table} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    got, want = QUERIES[name](spark, SF), tables.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    text = lambda names, values: sorted(tuple(str(v[names.index(c)]) for c in sorted(names)) for v in values)
    assert text(got.columns, got.collect()) == text(want.columns, want.fetchall())


def test_secrets_sql_adds_entropy_spans(spark, tmp_path):
    key = "Zx9Qw3Er7Ty1Ui5Op8As2Df6"
    texts = [f"a {key} b", "token=" + key, key + "EXAMPLE", "12345678-1234-1234-1234-123456789abc", "a" * 30 + "1", "deadbeef" * 4, "x/y_1-" * 6, "é 𝒜 " + "Q1w2E3r4T5y6U7i8O9p0" + key]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    tables = duckdb.connect()
    tables.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = tables.sql(SQL["op5_secret_scans"])
    got = QUERIES["op5_secret_scans"](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and sum("entropy" in r.spans for r in got) == 2


def test_quality_sql_where_strata_certify(spark, tmp_path):
    """Two languages have enough good documents to certify cutoffs, a third abstains; the bounds decide verdicts in the query and in the SQL."""
    rng = random.Random(29)
    plain = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(60))
    docs, marks = [], []
    for lang, good in (("en", 1300), ("de", 1250), (None, 60)):
        for i in range(good + 30):
            text = plain()
            if i >= good:
                text = [text.replace("w", "#$"), "\n".join([text] + [f"{rng.choice(['a', 'b'])} line"] * 12), " ".join(f"{'long' * 6}{rng.randrange(10**6)}" for _ in range(60))][i % 3]
            docs.append((len(docs), text, lang))
            marks.append((docs[-1][0], int(i < good), 0))
    # Repeated and null labels and ids.
    docs += [(docs[0][0], plain(), "en"), (None, plain(), "de")]
    marks += [(0, 0, 0), (1, None, 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    tables = duckdb.connect()
    for table in ("documents", "labels"):
        tables.sql(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    unique = "doc_id is not null and doc_id <> 0"  # SQL joins by id, so rows that share one are compared in the query alone
    want = tables.sql(f"select * from ({SQL['op2_quality_rules']}) where {unique}")
    got = QUERIES["op2_quality_rules"](spark, str(tmp_path))
    assert got.count() == len(docs)
    got = got.filter(unique).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
    lang = {i: x for i, _, x in docs[:-2]}
    rejected = {r.doc_id for r in got if not r.base_failed and not r.kept}
    good = {i for i, quality, _ in marks[:-2] if quality}
    assert sum(lang[i] == "en" and i not in good for i in rejected) >= 20 and sum(lang[i] == "de" and i not in good for i in rejected) >= 20
    assert not any(lang[i] is None for i in rejected) and len(rejected & good) < 60
