import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
RUN = """
from tidemark.session import session
from tidemark.sources.scratch import settled
from tidemark.operators.verify import verify
from tidemark.sources.star import CONTRACTS, model
spark = session("local[2]", shuffle_partitions=2, **{"spark.ui.enabled": "false"})
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert settled(spark.range(3)).count() == 3
assert verify(model(spark, "/root/testdata/sf0.001"), CONTRACTS["net_sales"], ["region"], "2001-07", "1995-01").count() > 0
"""


def test_without_a_shared_folder_a_local_master_takes_its_own(tmp_path):
    done = subprocess.run([sys.executable, "-c", RUN], cwd=ROOT, env=os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(ROOT)}, capture_output=True, text=True, timeout=300)
    assert not done.returncode, done.stderr[-2000:]
