"""The corpus queries that have SQL, held against DuckDB on small tables full of edge cases."""

import random

import duckdb
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from siftwell.llm.queries import ORACLE, QUERIES

TABLES = ("documents", "benchmark", "pages")


def _write(folder, texts, items, pages):
    tables = {
        "documents": pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}),
        "benchmark": pa.table({"item_id": pa.array(range(len(items)), pa.int64()), "text": pa.array(items, pa.string())}),
        "pages": pa.table({"page_id": pa.array(range(len(pages)), pa.int64()), "url": pa.array(["http://a.example/"] * len(pages), pa.string()), "html": pa.array(pages, pa.string())}),
    }
    for name, table in tables.items():
        pq.write_table(table, folder / f"{name}.parquet")


def _rows(frame, columns):
    return sorted([tuple(None if pd.isna(v) else int(v) if isinstance(v, float) else v for v in r) for r in frame[columns].astype(object).itertuples(index=False)], key=repr)


def _agree(spark, folder, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    expected, found = db.execute(ORACLE[name]).df(), QUERIES[name](spark, str(folder)).toPandas()
    assert sorted(expected.columns) == sorted(found.columns)
    columns = sorted(found.columns)
    assert _rows(found, columns) == _rows(expected, columns)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_edge_cases(spark, tmp_path, name):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)] + ["Ä", "ß!", "Zebra"]
    run = " ".join(rng.choice(words) for _ in range(120))
    near = run.split()
    near[60] = "changed"
    items = [None, "", "one two", " ".join(run.split()[10:22]), " ".join(run.split()[40:52]), "Ä ß! ZEBRA"]
    texts = [None, "", " \t\n", "one", "ONE two", "a b", "A b", run, run, " ".join(near), "x " + run, run.upper(), "say One, two! Ä ß zebra", " ".join(rng.choice(words) for _ in range(3000))]
    pages = [None, "", "x" * 99, "x" * 99, "x" * 100, "x" * 100, "ä" * 50, "ä" * 50, "<p>a</p>\r\n" * 300, "<p>a</p>\r\n" * 300]
    _write(tmp_path, texts, items, pages)
    _agree(spark, tmp_path, name)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_empty_tables(spark, tmp_path, name):
    _write(tmp_path, [], [], [])
    _agree(spark, tmp_path, name)
