import datetime as dt

import pytest

from kickstand.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]",
        shuffle_partitions=8,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="4g",
        spark__sql__maxMetadataStringLength="4000",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows(spark):
    """Frame from row tuples and a `name type, ...` layout."""
    from kickstand.schemas import table_schema

    return lambda layout, *data: spark.createDataFrame(list(data), table_schema(layout))


def at(text):
    return dt.datetime.fromisoformat(text)


def day(text):
    return dt.date.fromisoformat(text)


def tuples(df, *cols):
    return [tuple(r) for r in (df.select(*cols) if cols else df).collect()]
