import os

import pytest

os.environ.setdefault("PYSPARK_PYTHON", "python")


@pytest.fixture(scope="session")
def spark():
    from cardloom.session import build_session

    session = build_session(
        "tests",
        master="local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="4g",
        spark__sql__ansi__enabled="true",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
