import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from gainsay.session import local_session

    folder = tmp_path_factory.mktemp("checkpoints")
    session = local_session(
        8, **{"spark.checkpoint.dir": str(folder), "spark.sql.shuffle.partitions": "4"}
    )
    yield session
    session.stop()
