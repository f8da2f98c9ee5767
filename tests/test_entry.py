import importlib
import importlib.util
import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry


def test_every_sql_has_its_query():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) >= 70 and len(s) >= 55
    assert all(callable(f) for f in q.values()) and all(isinstance(x, str) for x in s.values())


def test_without_the_training_data_subpackage(tmp_path):
    root = os.path.dirname(entry.__file__)
    for name in ("skeinwork", "tests"):
        shutil.copytree(os.path.join(root, name), tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(entry.__file__, tmp_path)
    code = "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout.split("\n")
    assert {"p3_features", "p6_found"} <= set(got[0].split()) and "p1_found" not in got[0].split() and set(got[1].split()) <= set(got[0].split())


def test_a_broken_subpackage_is_an_error(monkeypatch):
    if importlib.util.find_spec("skeinwork.llm") is None:
        pytest.skip("the subpackage is absent")
    real = importlib.import_module

    def broken(name, *rest):
        if name.startswith("skeinwork.llm"):
            raise ModuleNotFoundError("No module named 'xxhash'")
        return real(name, *rest)

    monkeypatch.setattr(importlib, "import_module", broken)
    with pytest.raises(ModuleNotFoundError):
        entry.queries()


def test_nothing_else_imports_it():
    root = os.path.join(os.path.dirname(entry.__file__), "skeinwork")
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f)) as text:
                    assert "skeinwork.llm" not in text.read(), f


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["item_a", "item_b", "together"] and df.count() > 0
