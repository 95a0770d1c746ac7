import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
RUN = """
from tidemark.session import session
from tidemark.llm.dedup_stream import exact_groups
spark = session("local[2]", shuffle_partitions=2, **{"spark.ui.enabled": "false"})
assert spark.conf.get("spark.checkpoint.dir", None) is None
docs = spark.createDataFrame([(1, "a"), (2, "A")], "doc_id long, text string")
assert {r.keep_id for r in exact_groups(docs).collect()} == {2}
"""


def test_without_a_shared_folder_a_local_master_takes_its_own(tmp_path):
    done = subprocess.run([sys.executable, "-c", RUN], cwd=ROOT, env=os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(ROOT)}, capture_output=True, text=True, timeout=300)
    assert not done.returncode, done.stderr[-2000:]
