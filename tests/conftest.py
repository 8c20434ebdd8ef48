from __future__ import annotations

import pytest

from tramline.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(cores=4, partitions=4, memory="4g", **{"spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}"})
    yield session
    session.stop()
