"""Queries on a standalone cluster, whose executors fetch the modules from the driver."""

from __future__ import annotations

import json
import os
import signal
import socket
import subprocess
import sys
import time
from pathlib import Path

import duckdb
import pyspark
import pytest
import xxhash
from brinewave.plans import queries as plans

TABLES = Path("/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parents[1]
NAMES = [
    "cluster_members",
    "cluster_sample_seeded",
    "crop_head_too_short",
    "decimate_exact_float32",
    "duration_cap",
    "feature_map",
    "filter_centers",
    "hann_window",
    "keep_candidates",
    "kmeans_steps",
    "linear_db",
    "mel_filterbank_slaney",
    "mute_head",
    "pad_right",
    "pca_fit",
    "power_spectrogram",
    "recording_times",
    "signal_stats",
    "single_band",
]

DRIVER = """
import json, sys
from pyspark.sql import SparkSession
import __spark_entry__ as entry

master, tables, out, *names = sys.argv[1:]
spark = SparkSession.builder.master(master).config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", "4").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
for name in names:
    try:
        entry.queries()[name](spark, tables).write.parquet(f"{out}/{name}")
        print(json.dumps([name, ""]))
    except Exception as e:
        print(json.dumps([name, str(e)[:500]]))
"""


def free_port() -> int:
    with socket.socket() as s:
        s.bind(("127.0.0.1", 0))
        return s.getsockname()[1]


def listens(port: int) -> bool:
    with socket.socket() as s:
        return s.connect_ex(("127.0.0.1", port)) == 0


@pytest.fixture(scope="module")
def ran(tmp_path_factory):
    """What went wrong with each query, by name, and the folder of the results."""
    folder, home, port = tmp_path_factory.mktemp("cluster"), Path(pyspark.__file__).parent, free_port()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_HOME": str(home), "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable, "SPARK_DAEMON_MEMORY": "256m"}
    master, started = f"spark://127.0.0.1:{port}", []

    def start(*args: str) -> None:
        with (folder / f"log{len(started)}").open("w") as log:
            started.append(subprocess.Popen([home / "bin/spark-class", *args, "--host", "127.0.0.1", "--webui-port", str(free_port())], env=env, cwd=folder, stdout=log, stderr=log, start_new_session=True))

    try:
        start("org.apache.spark.deploy.master.Master", "--port", str(port))
        until = time.time() + 60
        while not listens(port) and time.time() < until:
            time.sleep(0.2)
        start("org.apache.spark.deploy.worker.Worker", "-c", "2", "-m", "2g", "-d", str(folder / "work"), master)
        run = subprocess.run([sys.executable, "-c", DRIVER, master, str(TABLES), str(folder), *NAMES], env=env | {"PYTHONPATH": str(ROOT)}, cwd=folder, capture_output=True, text=True, timeout=600, check=False)
        assert run.returncode == 0, run.stderr[-2000:]
        yield dict(json.loads(x) for x in run.stdout.splitlines() if x.startswith("[")), folder
    finally:
        for p in started:
            os.killpg(p.pid, signal.SIGKILL)
            p.wait()


def draw(key: int) -> int:
    """Spark's xxhash64 of a long and the seed of the sample."""
    h = xxhash.xxh64_intdigest((104).to_bytes(4, "little"), xxhash.xxh64_intdigest(key.to_bytes(8, "little"), 42))
    return h - (h >> 63 << 64)


@pytest.mark.skipif(not TABLES.exists(), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_on_a_cluster(ran, name):
    errors, folder = ran
    assert errors[name] == ""
    con = duckdb.connect()
    for p in TABLES.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS FROM read_parquet('{p}')")
    if name in plans.ORACLE_SQL:
        con.execute(f"CREATE TABLE theirs AS {plans.ORACLE_SQL[name]}")
    else:  # ten of each cluster, in the order of a hash
        con.create_function("draw", draw, ["BIGINT"], "BIGINT")
        con.execute("CREATE TABLE theirs AS SELECT label, vec_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY draw(vec_id), vec_id) <= 10")
    columns = ", ".join(c[0] for c in con.execute("DESCRIBE theirs").fetchall())
    con.execute(f"CREATE TABLE ours AS SELECT {columns} FROM read_parquet('{folder}/{name}/*.parquet')")
    assert con.execute("SELECT count(*) FROM ours").fetchone()[0] > 0
    for one, other in (("ours", "theirs"), ("theirs", "ours")):
        assert con.execute(f"FROM {one} EXCEPT ALL FROM {other} LIMIT 3").fetchall() == []
