"""Driver contract."""

import __spark_entry__ as entry


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "Landing_Page" in df.columns


def test_keys_are_unique_and_named():
    keys = list(entry.queries())
    assert len(keys) == len(set(keys))
    assert all(k.replace("_", "").isalnum() for k in keys)


def test_spark_submit_master_is_respected(tmp_path):
    """Under spark-submit, get_spark() returns the submitted session instead of a local one."""
    import os
    import subprocess
    import sys

    import pyspark
    script = tmp_path / "probe.py"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script.write_text(
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from clickpath.session import get_spark\n"
        "print('MASTER=' + get_spark().sparkContext.master)\n")
    submit = os.path.join(os.path.dirname(pyspark.__file__), "bin", "spark-submit")
    env = dict(os.environ, PYSPARK_PYTHON=sys.executable)
    out = subprocess.run([submit, "--master", "local[2]", "--conf", "spark.ui.enabled=false", str(script)],
                         capture_output=True, text=True, timeout=300, env=env)
    assert "MASTER=local[2]" in out.stdout, out.stderr[-2000:]


def test_a_missing_library_takes_only_the_training_queries(monkeypatch):
    import builtins

    import pytest
    real = builtins.__import__

    def without(name, *args, **kwargs):
        if name == "corpus_pipeline":
            raise ModuleNotFoundError("No module named 'xxhash'", name="xxhash")
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", without)
    with pytest.warns(UserWarning, match="xxhash"):
        names = entry.queries()
    from clickpath.plans import REGISTRY
    assert set(names) == set(REGISTRY)
