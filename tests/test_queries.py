"""Every query with SQL against DuckDB, at the smallest scale."""

import math
import os

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from chronolith.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "-"
    if isinstance(value, float):
        return f"{value + 0.0:.5f}"
    return str(value)


def test_names():
    assert set(SQL) <= set(QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    names = sorted(got.columns)
    rows = sorted(tuple(plain(r[c]) for c in names) for r in got.collect())
    if name not in SQL:
        return
    found = duck.execute(SQL[name])
    own = [x[0] for x in found.description]
    assert sorted(own) == names
    assert rows == sorted(tuple(plain(r[own.index(c)]) for c in names) for r in found.fetchall())


def same_as_sql(spark, folder, name):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    found = c.execute(SQL[name])
    own = sorted(x[0] for x in found.description)
    order = [[x[0] for x in found.description].index(k) for k in own]
    want = sorted(tuple(plain(r[i]) for i in order) for r in found.fetchall())
    got = sorted(tuple(plain(r[k]) for k in own) for r in QUERIES[name](spark, str(folder)).collect())
    assert got == want
    return got


@pytest.mark.parametrize("name", ["search_expand", "context_passages", "context_text"])
def test_timelines_with_many_hits(spark, tmp_path, name):
    """more hits in a timeline than any of the caps on candidates."""
    rng = np.random.default_rng(5)
    words = ["of", "the", "of the", "thtion", "eriner", "attion", "sand", "river", "stone", "night"]
    texts = ["\n".join(" ".join(rng.choice(words, rng.integers(2, 40))) + "." for _ in range(600)) for _ in range(3)]
    pq.write_table(pa.table({"doc_id": pa.array([1, 2, 3], pa.int64()), "text": texts}), tmp_path / "documents.parquet")
    vectors = pa.array([[0.1] * 64] * 3, pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": pa.array([1, 2, 3], pa.int64()), "embedding": vectors, "label": pa.array([1, 2, 3], pa.int32())}), tmp_path / "embeddings.parquet")
    assert same_as_sql(spark, tmp_path, name)


@pytest.mark.parametrize("name", ["frame_select", "frame_cap"])
def test_timelines_with_many_frames(spark, tmp_path, name):
    """more frames than the engine's usual cap are due, and the SQL has none."""
    n = 1100
    vectors = pa.array(np.random.default_rng(5).uniform(-1, 1, (n, 64)).astype(np.float32).tolist(), pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": pa.array(range(n), pa.int64()), "embedding": vectors, "label": pa.array([1] * n, pa.int32())}), tmp_path / "embeddings.parquet")
    assert max(int(r[1]) for r in same_as_sql(spark, tmp_path, name)) == {"frame_select": n, "frame_cap": 4}[name]
