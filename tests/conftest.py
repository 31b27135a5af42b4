import copy
import json
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pyspark.sql import functions as F  # noqa: E402

from logloom.schema import LOG_SCHEMA  # noqa: E402
from logloom.session import build_session  # noqa: E402

BASE = {
    "id": "log-1",
    "timestamp": "2024-01-01T10:00:00.000Z",
    "service": {
        "name": "api-gateway",
        "version": "1.0.0",
        "environment": "production",
        "instance_id": "i-1234567890",
        "host": "ip-127-0-0-1.ec2.internal",
        "region": "us-east-1",
    },
    "level": "info",
    "category": "application",
    "message": "Request processed successfully",
    "metrics": {
        "cpu_usage": 12.5,
        "memory_mb": 512,
        "response_time_ms": 150,
        "db_query_time_ms": 20,
    },
    "tags": ["api-gateway"],
    "geo": {"country": "US", "city": "Seattle", "location": {"lat": 47.6062, "lon": -122.3321}},
}


def entry(**overrides):
    """One record: objects merge field by field, other values replace."""
    doc = copy.deepcopy(BASE)
    for key, value in overrides.items():
        if key in ("service", "metrics", "geo") and isinstance(value, dict):
            doc[key] = {**doc[key], **value}
        elif value is None:
            doc.pop(key, None)
        else:
            doc[key] = value
    return doc


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "logloom-tests",
        "local[8]",
        8,
        {
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def lines(spark):
    def make(*docs):
        rows = [(d if isinstance(d, str) else json.dumps(d),) for d in docs]
        return spark.createDataFrame(rows, "value string")

    return make


@pytest.fixture(scope="session")
def logs(spark, lines):
    """Records typed by the reader, without validation."""

    def make(*docs):
        parsed = lines(*docs).select(
            F.from_json("value", LOG_SCHEMA, {"timeZone": "UTC"}).alias("r")
        )
        return parsed.select("r.*")

    return make


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
