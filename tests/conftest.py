import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))
os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).parent.parent), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from rootspan.session import local_session

    # Tables of a few rows: compiling plans would cost more than running them.
    quick = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.adaptive.enabled": "false", "spark.default.parallelism": "2"}
    session = local_session("tests", 2, shuffle_partitions=2, **quick)
    yield session
    session.stop()
