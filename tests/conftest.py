import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def against_duckdb():
    """compare(df, sql, folder): the same columns and rows, in any order."""
    import duckdb

    def compare(df, sql, folder):
        c = duckdb.connect()
        for p in Path(folder).glob("*.parquet"):
            c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        names = sorted(df.columns)
        want = c.sql(sql)
        assert sorted(want.columns) == names
        key = lambda rows: sorted(map(repr, rows))
        assert key(tuple(r[n] for n in names) for r in df.collect()) == key(c.sql(f"SELECT {', '.join(names)} FROM ({sql})").fetchall())

    return compare
