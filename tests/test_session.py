import http.server
import os
import subprocess
import sys
import threading

from runweave import session
from runweave.sources import fetch


def test_settings():
    c = session.Config(shuffle_partitions=9, max_executors=5, shared_dir="hdfs://x/y", options={"spark.a": "b"}).settings()
    assert c["spark.sql.shuffle.partitions"] == "9" and c["spark.dynamicAllocation.maxExecutors"] == "5" and c["spark.a"] == "b" and c["spark.checkpoint.dir"] == "hdfs://x/y"


def test_run_folders(spark, tmp_path):
    folder = f"file://{tmp_path}/runs"
    assert [session.next_run(spark, folder)[-3:] for _ in range(3)] == ["000", "001", "002"]


def test_fetch(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"hello")
    handler = lambda *a: http.server.SimpleHTTPRequestHandler(*a, directory=str(tmp_path))
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    rows = {r["url"]: r for r in fetch.fetch(spark.createDataFrame([(f"{base}/a.txt",), (f"{base}/none",), ("odd://x",)], "url string"), timeout=5).collect()}
    server.shutdown()
    assert bytes(rows[f"{base}/a.txt"]["content"]) == b"hello" and "404" in rows[f"{base}/none"]["error"] and "odd" in rows["odd://x"]["error"]


CLOSE = """
import sys
from runweave import session
from runweave.sources import logs
spark, folder = session.session(session.Config(master="local[2]", options={"spark.ui.enabled": "false"})), sys.argv[1]
logs.start_log(folder + "/run.log").info("begun")
rate = lambda *c: spark.readStream.format("rate").load().selectExpr(*c).writeStream.format("noop").queryName(c[0][:5])
good = rate("value").option("checkpointLocation", folder + "/a").start()
bad = rate("raise_error('odd')").option("checkpointLocation", folder + "/b").start()
try:
    bad.awaitTermination(60)
except Exception:
    pass
errors = session.close(spark, (good, bad))
assert not good.isActive and len(errors) == 1 and errors[0].startswith("raise"), errors
assert "begun" in open(folder + "/run.log").read() and spark.sparkContext._jsc is None
print("closed")
"""


def test_closing_a_run(tmp_path):
    """In a process of its own, as it ends the session."""
    env = {**os.environ, "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    run = subprocess.run([sys.executable, "-c", CLOSE, str(tmp_path)], env=env, capture_output=True, text=True, timeout=180)
    assert run.stdout.strip().endswith("closed"), run.stderr[-2000:]
