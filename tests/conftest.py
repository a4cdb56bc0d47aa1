import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ.setdefault("TZ", "UTC")

DATA = "/root/testdata"

import golden  # noqa: E402

# cases that were published with expected results; where they aren't at hand, the same operators are tested by their SQL
collect_ignore = [] if golden.files() else ["test_call.py", "test_convert.py", "test_cli.py"]


@pytest.fixture(scope="session")
def spark():
    from ribospark.session import local_session

    session = local_session(4, 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """A function (sf, sql) -> sorted rows, with the driver's tables as views."""
    import duckdb

    def run(sf: str, sql: str):
        con = duckdb.connect()
        for name in sorted(os.listdir(f"{DATA}/{sf}")):
            con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{sf}/{name}'")
        cursor = con.execute(sql)
        return [c[0] for c in cursor.description], cursor.fetchall()

    return run
