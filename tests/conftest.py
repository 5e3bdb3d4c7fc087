import os
import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from entitywatch import schema
from entitywatch.session import build_session

os.environ["TZ"] = "UTC"
START = datetime(2024, 3, 4, 9, 0, 0)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[4]",
        "tests",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="6g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_log(spark):
    """Build an access log from short dicts; `at` is in seconds after START."""

    def build(*events, entity="usr_1"):
        rows = []
        for number, event in enumerate(events):
            at = event.get("at", 0)
            rows.append(
                (
                    event.get("event_id", number),
                    event.get("entity_id", entity),
                    event.get("entity_type", "user"),
                    START + timedelta(seconds=at),
                    event.get("ip", "10.0.0.1"),
                    event.get("geo", "London|51.5074|-0.1278"),
                    event.get("resource", "api://auth/login"),
                    event.get("auth", "password"),
                    event.get("duration", 60.0),
                    event.get("commands", "ls;cat"),
                    event.get("device", "Linux|aa|ssh"),
                )
            )
        return spark.createDataFrame(rows, schema.ACCESS_LOG)

    return build


@pytest.fixture(scope="session")
def column():
    """Values of columns by event id."""

    def pick(df, *names):
        rows = df.select("event_id", *names).orderBy("event_id").collect()
        return [tuple(r)[1:] if len(names) > 1 else r[1] for r in rows]

    return pick
