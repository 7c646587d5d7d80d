"""Every catalogue query against its SQL, at the smallest scale."""

import datetime
import glob
import os
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from sentilake.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(rows):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = duck.sql(catalogue.SQL[name])
    assert columns == sorted(want.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert plain(map(tuple, df.select(*columns).collect())) == plain(duck.sql(f"SELECT {quoted} FROM ({catalogue.SQL[name]})").fetchall())


def test_averages_that_end_in_a_5_round_as_the_sql_does_on_one_thread(spark, tmp_path):
    """Sums of doubles differ by their order, here in the last digit that is shown."""
    rng, rows = random.Random(4), []
    for i in range(32):
        rows += [[u, i, rng.randrange(20_000)] for u in range(200)]
    for u in range(200):
        mine = [r for r in rows if r[0] == u]
        mine[-1][2] += (792 - sum(r[2] - 5000 for r in mine)) % 1600  # an average of .. 0.00495, up to whole hundredths
    days = [datetime.datetime(2024, 1, 1 + i % 15) for _, i, _ in rows]
    events = pa.table({"event_id": list(range(len(rows))), "ts": pa.array(days, pa.timestamp("us")), "user_id": [r[0] for r in rows], "event_type": ["view"] * len(rows), "value": [r[2] / 100 for r in rows], "props": ["{}"] * len(rows)})
    pq.write_table(events, f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.execute(catalogue.SQL["comparison_narratives"]).fetchall()
    assert sorted(map(tuple, catalogue.QUERIES["comparison_narratives"](spark, str(tmp_path)).collect())) == sorted(want) and len(want) == 200
