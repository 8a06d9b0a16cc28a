"""The pipeline's stages against what each must do, on the smallest tables."""

import re

import corpus_pipeline
from lodewell.llm import op2_quality, op7_packing, op9_toxicity, registry
from tests.llm.test_training_operators import brute_classes, brute_hits, check_packed


def test_stages(spark, data):
    docs = spark.read.parquet(data + "/documents.parquet")
    labels = spark.read.parquet(data + "/labels.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    now = {r.doc_id: r.text for r in docs.collect()}

    model = op9_toxicity.fit(docs, labels)
    docs = stages["toxicity"](spark, docs, data)
    kept = {r.doc_id for r in docs.collect()}
    assert kept == {i for i, s in zip(now, op9_toxicity.scores(list(now.values()), model)) if s < 0.3} and docs.columns == columns

    model = op2_quality.fit(docs, labels)
    scores = {r.doc_id: r.score for r in op2_quality.score(docs, model).collect()}
    docs = stages["quality"](spark, docs, data)
    kept = {r.doc_id for r in docs.collect()}
    assert kept == {i for i, s in scores.items() if s >= 0.3} and docs.columns == columns

    expected = brute_classes([(i, now[i]) for i in sorted(kept)], 5, 80)
    docs = stages["near_duplicates"](spark, docs, data)
    kept = {r.doc_id for r in docs.collect()}
    assert kept == {i for i, (_, root) in expected.items() if i == root} and docs.columns == columns

    items = [(r.item_id, r.text) for r in spark.read.parquet(data + "/benchmark.parquet").collect()]
    docs = stages["decontamination"](spark, docs, data)
    words = {w for _, t in items for w in re.findall(r"\w+", t.lower())}
    clean = set()
    for i in kept:
        n, hit, _ = brute_hits(now[i], items) if words & set(now[i].lower().split()) else (1, 0, [])
        if not hit or 20 * hit < n:
            clean.add(i)
    assert {r.doc_id for r in docs.collect()} == clean and docs.columns == columns

    rows = stages["packing"](spark, docs, data).collect()
    check_packed(rows, [(i, now[i]) for i in clean], op7_packing.WINDOW)
    whole = corpus_pipeline.run(spark, data).collect()
    assert sorted(map(str, whole)) == sorted(map(str, rows))


EXTRA = "doc_id long, text string, lang string, source string, n_chars long, _hashed_id string, score double, `a.b` string, y int"
WORDS = " ".join(f"w{i}" for i in range(40))
ROWS = [
    (1, WORDS),
    (2, WORDS.upper()),
    (3, " ".join(WORDS.split()[:-1])),
    (None, WORDS),
    (None, None),
    (None, None),
    (4, None),
    (5, ""),
    (5, ""),
    (6, " \n\t"),
    (7, "the benchmark asks what seven times eight may be in all of its glory now"),
    (8, "x " * 4000 + " " + " ".join(f"long{i}" for i in range(6000))),
    (9, "unlike all the others in each of its words"),
]


def test_run_on_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, ties, repeats, clashing columns; without labels only copies and contaminated rows go."""
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "h", 0.5, "x", 1) for i, t in ROWS], EXTRA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    items = [(1, "what seven times eight may be in all of its glory now or later"), (2, "what seven times eight may be in all of its glory now"), (None, WORDS), (3, None), (4, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, now, str(tmp_path))
        assert kept.columns == docs.columns, name
        now = kept
    expected = [(1, WORDS), (None, None), (4, None), (5, ""), (6, " \n\t"), (8, ROWS[11][1]), (9, ROWS[12][1])]
    assert sorted(((r.doc_id, r.text) for r in now.collect()), key=str) == sorted(expected, key=str)
    check_packed(corpus_pipeline.run(spark, str(tmp_path)).collect(), expected, op7_packing.WINDOW)


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], EXTRA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registry_names_thirteen_queries():
    numbers = {re.match(r"op(\d+)_", name)[1] for name in registry.queries()}
    assert numbers == {str(n) for n in range(1, 14)} and set(registry.oracle_sql()) <= set(registry.queries())
