"""Repository walks: nested ignore rules, and a second run that parses nothing."""

from pyspark.sql import functions as F

from lodewell.sources import code
from lodewell.sources import walk as K

TREE = {
    ".gitignore": "*.log\n# a comment\n\n/only_here.py\ngen/\n!gen/keep.py\ndocs/**/draft.py\n*.tmp.py\n!important.tmp.py\n\\#odd.py\n",
    "a.py": "def a():\n    return b()\n",
    "only_here.py": "x = 1\n",
    "sub/only_here.py": "x = 1\n",
    "gen/keep.py": "x = 1\n",
    "sub/gen/x.py": "x = 1\n",
    "docs/draft.py": "x = 1\n",
    "docs/one/two/draft.py": "x = 1\n",
    "docs/one/final.py": "x = 1\n",
    "b.tmp.py": "x = 1\n",
    "important.tmp.py": "x = 1\n",
    "#odd.py": "x = 1\n",
    "sub/.gitignore": "!b.tmp.py\nlocal?.py\n[xy]z.py\n",
    "sub/b.tmp.py": "x = 1\n",
    "sub/c.tmp.py": "x = 1\n",
    "sub/local1.py": "x = 1\n",
    "sub/local12.py": "x = 1\n",
    "sub/deep/xz.py": "x = 1\n",
    "sub/deep/.gitignore": "!xz.py\nb.tmp.py\n",
    "sub/deep/b.tmp.py": "x = 1\n",
    "sub/deep/yz.py": "x = 1\n",
    "node_modules/m.py": "x = 1\n",
    "sub/build/m.py": "x = 1\n",
    "notes.txt": "none\n",
    "gen2/x.py": "x = 1\n",
}
KEPT = {"a.py", "sub/only_here.py", "docs/one/final.py", "important.tmp.py", "sub/b.tmp.py", "sub/local12.py", "sub/deep/xz.py", "gen2/x.py"}


def test_walk_and_second_run(spark, tmp_path):
    for path, text in TREE.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "binary.py").write_bytes(b"a\x00b")
    (tmp_path / "latin.py").write_bytes(b"# \xe9\n")
    root = str(tmp_path)
    paths = K.listing(spark, root)
    rules = K.ignore_rules(K.ignore_files(spark, root, paths))
    found = K.walked(paths, rules)
    assert {r["path"] for r in found.collect()} == KEPT | {"binary.py", "latin.py"}
    now = K.contents(spark, root, found).withColumn("language", code.language(F.col("path")))
    assert {r["path"] for r in now.collect()} == KEPT
    parsed: list = []

    def parse(files):
        parsed.append({r["path"] for r in files.select("path").collect()})
        return code.parsed(files)

    none_files, none_rows = spark.createDataFrame([], "path string, content_hash string"), spark.createDataFrame([], code.ROWS)
    files, rows = K.reindexed(now, none_files, none_rows, parse)
    stored = tmp_path.parent / f"{tmp_path.name}-index"
    files.write.parquet(f"{stored}/files")
    rows.write.parquet(f"{stored}/rows")
    parsed.clear()
    parsed.append(KEPT)
    files, rows = spark.read.parquet(f"{stored}/files"), spark.read.parquet(f"{stored}/rows")
    assert {r["name"] for r in rows.where("row = 'symbol'").collect()} == {"a"}
    again_files, again_rows = K.reindexed(now, files, rows, parse)
    assert again_rows.count() == rows.count() and again_files.count() == len(KEPT)
    (tmp_path / "a.py").write_text("def other():\n    pass\n")
    (tmp_path / "gen2/x.py").unlink()
    now = K.contents(spark, root, K.walked(K.listing(spark, root), rules)).withColumn("language", code.language(F.col("path")))
    last_files, last_rows = K.reindexed(now, files, rows, parse)
    assert {r["name"] for r in last_rows.where("row = 'symbol'").collect()} == {"other"} and last_files.count() == len(KEPT) - 1
    assert parsed == [KEPT, set(), {"a.py"}]
    assert {r["path"]: r["action"] for r in K.changes(now, files).collect()}["gen2/x.py"] == "prune"


def test_walk_of_nothing(spark):
    paths, rules = spark.createDataFrame([("a.py",), ("b.md",)], "path string"), K.ignore_rules(spark.createDataFrame([(".gitignore", None)], "path string, content string"))
    assert [r["path"] for r in K.walked(paths, rules).collect()] == ["a.py"] and K.walked(paths.limit(0), rules).count() == 0
