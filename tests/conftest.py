import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from pressroom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return build_session("tests", cores=8, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "8g"})
