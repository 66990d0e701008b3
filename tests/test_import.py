"""The entry module must load without a Spark installation's jar folder."""
import os
import subprocess
import sys

import pyspark

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CODE = """
import os, pyspark
assert not os.path.exists(os.path.join(os.path.dirname(pyspark.__file__), "jars"))
import __spark_entry__ as e
names = list(e.queries())
assert not [n for n in names if n.startswith("unavailable_")], names
assert len(names) >= 70 and len(e.oracle_sql()) >= 60
print("loaded", len(names))
"""


def test_queries_load_without_jars(tmp_path):
    home = os.path.dirname(pyspark.__file__)
    os.makedirs(tmp_path / "pyspark")
    for name in os.listdir(home):
        if name not in ("jars", "__pycache__"):
            os.symlink(os.path.join(home, name), tmp_path / "pyspark" / name)
    env = dict(os.environ, PYTHONPATH=f"{tmp_path}:{REPO}")
    out = subprocess.run([sys.executable, "-c", CODE], cwd=REPO, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
    assert "loaded" in out.stdout


def test_failed_module_raises_when_called(monkeypatch):
    import pytest
    from websift.plans import registry
    registry.load_all()
    monkeypatch.setattr(registry, "MODULES", (*registry.MODULES, "q_absent"))
    try:
        registry.load_all()
        with pytest.raises(ImportError):
            registry.QUERIES["unavailable_q_absent"](None, "")
    finally:
        registry.QUERIES.pop("unavailable_q_absent", None)
        registry._LOADED.discard("q_absent")
