import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parent.parent))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    conf = {
        "spark.master": "local[4]", "spark.driver.memory": "3g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "4",
        "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-"),
    }
    session = SparkSession.builder.config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def oracle():
    """Rows of a query and of its SQL over one folder of tables, in a comparable form."""
    import duckdb

    connections = {}

    def connect(sf_dir):
        if sf_dir not in connections:
            connections[sf_dir] = c = duckdb.connect()
            for p in Path(sf_dir).glob("*.parquet"):
                c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        return connections[sf_dir]

    def plain(v):
        return None if v is None else round(v, 6) if isinstance(v, float) else int(v) if isinstance(v, bool) else v

    def both(spark, f, sql, sf_dir=SF):
        df = f(spark, sf_dir)
        columns = sorted(df.columns)
        found = connect(sf_dir).sql(sql)
        assert sorted(found.columns) == columns
        ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
        theirs = sorted((tuple(plain(v) for v in r) for r in found.select(*[f'"{c}"' for c in columns]).fetchall()), key=repr)
        return ours, theirs

    return both
