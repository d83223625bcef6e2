"""The driver's queries over events made up here."""

import ast
from datetime import datetime, timedelta
from pathlib import Path

import pytest

from parity import queries

EVENTS = "event_id LONG, ts TIMESTAMP_NTZ, user_id LONG, event_type STRING, value DOUBLE, props STRING"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Twenty days of two users, one event a day."""
    root = tmp_path_factory.mktemp("sf")
    first = datetime(2024, 1, 3, 10)
    rows = [
        (2 * day + user, first + timedelta(days=day), user, "view", float(day), f"p{day}")
        for day in range(20)
        for user in (0, 1)
    ]
    spark.createDataFrame(rows, EVENTS).write.parquet(f"{root}/events.parquet")
    return str(root)


def test_no_helper_hides_another_of_its_name():
    tree = ast.parse(Path(queries.__file__).read_text())
    names = [node.name for node in tree.body if isinstance(node, ast.FunctionDef)]
    assert len(names) == len(set(names))


@pytest.mark.parametrize("name", ["ecg_page_next", "workout_page_next"])
def test_second_pages_follow_the_first(spark, sf_dir, name):
    time = "ecg_time" if name == "ecg_page_next" else "route_time"
    found = queries.QUERIES[name](spark, sf_dir).where("user_id = '1'").orderBy("position").collect()
    assert [(r["position"], r[time][:10]) for r in found] == [
        (n, f"2024-01-{n + 7:02d}") for n in range(1, 6)
    ]
