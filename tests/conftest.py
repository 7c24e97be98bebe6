import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from quernstone.session import session

    s = session("tests", "local[4]", spark_sql_shuffle_partitions="4", spark_ui_enabled="false", spark_ui_showConsoleProgress="false", spark_driver_memory="3g", spark_checkpoint_dir=str(tempfile.mkdtemp(prefix="quernstone-tests-")))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
