import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from vitrina.operators.pairing import number_snapshots  # noqa: E402
from vitrina.session import build_session  # noqa: E402

OBSERVATION = (
    "store_id string, snap_ord int, pos bigint, product_id string, name string, "
    "price decimal(18,4), stock decimal(18,4), sold_qty decimal(18,4), available boolean"
)
SNAPSHOT = (
    "store_id string, source_file string, scraped_at timestamp, brand string, "
    "platform string, currency string"
)


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "2",
            "spark.ui.enabled": "false",
            "spark.default.parallelism": "2",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def shop(spark):
    """Builds observations and snapshots from lists of products by day."""

    def build(*captures, store="s", platform="tiendanube", brand="Marca Test"):
        heads, rows = [], []
        for number, (day, products) in enumerate(captures):
            at = dt.datetime(2026, 8, 1) + dt.timedelta(days=day)
            heads.append((store, f"f{number:03d}", at, brand, platform, "ARS"))
            for pos, p in enumerate(products):
                rows.append(
                    (
                        store,
                        f"f{number:03d}",
                        pos,
                        str(p["id"]),
                        p.get("name"),
                        p.get("price"),
                        p.get("stock"),
                        p.get("sold"),
                        p.get("available"),
                    )
                )
        snapshots = number_snapshots(spark.createDataFrame(heads, SNAPSHOT))
        fields = OBSERVATION.replace("snap_ord int", "source_file string")
        typed = [
            tuple(decimal(v) if i in (5, 6, 7) else v for i, v in enumerate(row)) for row in rows
        ]
        observations = spark.createDataFrame(typed, fields).join(
            snapshots.select("store_id", "source_file", "snap_ord"), ["store_id", "source_file"]
        )
        return observations.drop("source_file"), snapshots

    return build


def decimal(value):
    from decimal import Decimal

    return None if value is None else Decimal(str(value))
