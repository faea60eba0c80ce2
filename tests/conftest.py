import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = str(Path(__file__).parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ["PYTHONDONTWRITEBYTECODE"] = "1"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    """Rows as sorted tuples of text, columns in the order of their names."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shown = lambda v: "null" if v is None else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(shown(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want, got = rows_of(names, cursor.fetchall()), rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert len(want) == len(got), (len(want), len(got))
    wrong = [(w, g) for w, g in zip(want, got, strict=True) if w != g]
    assert not wrong, (len(wrong), wrong[:3])
