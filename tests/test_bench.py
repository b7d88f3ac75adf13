"""The bench runs and prints one line of figures."""

import json
import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_bench_runs(tmp_path):
    env = os.environ | {"BENCH_SF_DIR": "/root/testdata/sf0.001", "BENCH_CPUS": "4", "BENCH_RUNS": "1"}
    done = subprocess.run([sys.executable, str(ROOT / "bench.py")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    line = json.loads(done.stdout.strip().splitlines()[-1])
    assert line["unit"] == "sec" and line["value"] > 0 and line["sf"] == "0.001"
    for name in line["queries"]:
        assert name.startswith("direct_") or line["queries"][name] > 0
    assert {n.removeprefix("direct_") for n in line["queries"] if n.startswith("direct_")} <= set(line["queries"])
