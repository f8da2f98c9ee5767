import json

import pytest
from pyspark.sql import functions as F

from skeinwork.sources import readers as D


def test_files(spark, tmp_path):
    for name, text in {"src/a.ts": "x", "src/a.min.js": "x", "node_modules/b.ts": "x", ".git/c.ts": "x", "d.unknownext": "x", "big.py": "y" * 600_000, "e.py": "z"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    rows = D.source_files(spark, str(tmp_path))
    assert {r.path for r in rows.collect()} == {"src/a.ts", "e.py"}
    assert D.fingerprint(rows).first().files == 2


def test_walks(spark):
    rows = spark.createDataFrame([("a/" * 10 + "x.ts", 1), ("a/" * 11 + "x.ts", 1), ("b.ts", 1), ("c.min.js", 1), ("d/.e/f.ts", 1), ("g.ts", 600_000)], "path string, size long")
    assert {r.path for r in D.walked(rows).collect()} == {"a/" * 10 + "x.ts", "b.ts"} and [r.path for r in D.walked(rows, most=1).collect()] == ["a/" * 10 + "x.ts"]
    assert {r.path for r in D.listed(rows, [".ts", ".js"]).collect()} == {r.path for r in rows.collect()} - {"c.min.js"}


def test_texts(spark, tmp_path):
    (tmp_path / "log").write_text("\n---COMMIT---\na.ts\nb.ts\n\n---COMMIT---\nb.ts\nb.ts\n")
    log = D.commit_log(spark, str(tmp_path / "log"))
    assert sorted(map(tuple, D.commit_files(log).collect())) == [(1, "a.ts"), (1, "b.ts"), (2, "b.ts")]
    assert sorted(map(tuple, D.commit_files(log, most=1).collect())) == [(1, "a.ts"), (1, "b.ts")]
    nb = json.dumps({"cells": [{"cell_type": "code", "source": ["a\n", "b"]}, {"cell_type": "markdown", "source": "x"}, {"cell_type": "code", "source": " "}, {"cell_type": "code", "source": "c"}]})
    cells = D.notebook_cells(spark.createDataFrame([(1, nb), (2, "broken"), (3, None)], "id long, text string")).orderBy("cell").collect()
    assert [(r.cell, r.start_line, r.code) for r in cells] == [(0, 1, "a\nb"), (3, 5, "c")]
    page = "<p>\n<script lang='ts' type=\"module\">\nlet a\n</script>\n<SCRIPT>b</SCRIPT>"
    got = D.script_blocks(spark.createDataFrame([(1, page), (2, None)], "id long, text string")).orderBy("nth").collect()
    assert [(r.start_line, r.lang, r.module, r.code) for r in got] == [(3, "ts", True, "\nlet a\n"), (6, "js", False, "b")]
    ev = [{"type": "begin"}, {"type": "match", "data": {"path": {"text": "a.ts"}, "line_number": 3, "lines": {"text": "x\n"}}}]
    m = D.match_events(spark.createDataFrame([(k, json.dumps(e)) for k, e in enumerate(ev)] + [(9, "broken")], "nth int, value string")).collect()
    assert [(r.path, r.line) for r in m] == [("a.ts", 3)]
    df = spark.createDataFrame([("a|2|x|y",), ("bad",)], "t string")
    assert [r.m and tuple(r.m) for r in df.select(D.match_lines(df.t).alias("m")).collect()] == [("a", 2, "x|y"), None]


def test_snapshots_and_registry(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id long, x string")
    at = D.save_snapshot(df, str(tmp_path), " v 1/2 ")
    assert at.endswith("/v-1-2") and D.load_snapshot(spark, str(tmp_path), "v 1/2").collect() == df.collect()
    df.withColumn("_version", F.lit(2)).write.parquet(str(tmp_path / "new"))
    assert D.snapshot_labels(spark, str(tmp_path)) == ["new", "v-1-2"] and D.snapshot_labels(spark, str(tmp_path / "none")) == []
    for bad in (lambda: D.load_snapshot(spark, str(tmp_path), "new"), lambda: D.save_snapshot(df, str(tmp_path), " / ")):
        with pytest.raises(ValueError):
            bad()
    reg = spark.createDataFrame([("a", "/p/a"), ("b", "/p/b")], "name string, path string")
    assert [r.name for r in D.repositories(reg, ["/p/b", "a", "b"]).collect()] == ["b", "a"] and D.repositories(reg, ["all"]).count() == 2
    with pytest.raises(ValueError):
        D.repositories(reg, ["a", "all"])
    old = spark.createDataFrame([("0123456789abcdef", 0), ("zz", 0)], "name string, mtime_ms long")
    assert D.stale_caches(old, 10 * 86_400_000, 5).count() == 1
    st = spark.createDataFrame([("go", 1, 10, 1, 1), ("py", 2, 30, 1, 1), ("go", 1, 25, 0, 0)], "language string, files long, code long, comments long, blanks long")
    assert [r.language for r in D.code_stats(st).collect()] == ["go", "py"]
