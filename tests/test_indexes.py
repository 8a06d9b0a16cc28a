"""The kept indexes, the registry, intervals, themes and the ranker against plain versions, and on odd rows."""

import collections
import datetime as dt
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodewell.operators import entities as E
from lodewell.operators import knowledge as K
from lodewell.operators import lifecycle as L
from lodewell.operators import registry as G
from lodewell.operators import relational
from lodewell.operators import retrieval as R
from lodewell.operators import temporal as T
from lodewell.operators import text_index as X
from lodewell.operators import vector_index as V
from lodewell.plans import recall as P
from lodewell.sources import sinks

# --- texts

VOCABULARY = ["ab", "abc", "abd", "b", "bc", "cde", "dog", "dogs"]
NOTE = "path string, title string, tags array<string>, content string, deleted boolean"


def scores(words, prefix, state, weights=(3, 2, 1)):
    """BM25 of each field, document by document."""
    cut = {k: [None if x is None else re.findall(r"\w+", x) for x in (d[0], " ".join(d[1]), d[2])] for k, d in state.items()}
    out = collections.Counter()
    for w in set(words):
        for i, weight in enumerate(weights):
            lengths = [len(v[i]) for v in cut.values() if v[i] is not None]
            tf = {k: sum(t.startswith(w) if prefix else t == w for t in v[i] or ()) for k, v in cut.items()}
            df = sum(x > 0 for x in tf.values())
            for k, x in tf.items():
                if x:
                    out[k] += weight * math.log(1 + (len(cut) - df + 0.5) / (df + 0.5)) * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * len(cut[k][i]) / (sum(lengths) / len(lengths))))
    return out


def test_text_index_after_changes_is_that_of_a_rebuild(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 4)
    rnd, path, state = random.Random(2), f"file://{tmp_path}/index", {}
    assert X.search(spark, path, ["ab"]).count() == 0 and X.compact(spark, path) is None
    for step in range(3):
        changes = {}
        for _ in range(60 if step == 0 else 12):
            note = (" ".join(rnd.choices(VOCABULARY, k=rnd.randint(0, 3))) if rnd.random() < 0.9 else None, rnd.sample(VOCABULARY, rnd.randint(0, 2)), " ".join(rnd.choices(VOCABULARY, k=rnd.randint(0, 20))))
            changes[f"d{rnd.randint(0, 60):02d}"] = note, rnd.random() < 0.25
        X.apply(spark, path, spark.createDataFrame([(k, *note, gone) for k, (note, gone) in changes.items()] + [(None, "ab", [], "ab", False)], NOTE))
        for k, (note, gone) in changes.items():
            state.pop(k, None)
            if not gone:
                state[k] = note
        if step == 1:
            assert X.compact(spark, path) == 3 and X.segments(spark, path)[0] == [3]
        for words in (["ab"], ["cde", "abd", "zzz"]):
            got, expected = {r["key"]: r["score"] for r in X.search(spark, path, words).collect()}, scores(words, True, state)
            assert set(got) == set(expected) and all(abs(got[k] - expected[k]) < 1e-9 for k in got)
            best = sorted((-round(s, 9) for s in scores(words, False, state).values()))[:5]
            assert [-round(r["score"], 9) for r in X.top(spark, path, words, 5).collect()] == best


def test_text_index_shuffles_documents_and_not_postings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 4)
    monkeypatch.setattr(X, "FILE_POSTINGS", 50)  # many parts, of which some are empty
    rnd, path = random.Random(5), f"file://{tmp_path}/parts"
    state = {f"d{i:02d}": (rnd.choice(VOCABULARY), ["ab"], " ".join(rnd.choices(VOCABULARY, k=i % 30))) for i in range(90)}
    X.apply(spark, path, spark.createDataFrame([(k, *note, False) for k, note in state.items()], NOTE))
    assert [-round(r["score"], 9) for r in X.top(spark, path, ["ab", "dog"], 7).collect()] == sorted(-round(s, 9) for s in scores(["ab", "dog"], False, state).values())[:7]
    blocks = X._table(spark, path, "postings", [1])
    assert blocks.agg(F.sum("n"), F.max("n")).first() == (sum(len(set(" ".join((t, *g, c)).split())) for t, g, c in state.values()), 4)
    docs = spark.read.parquet(f"{path}/docs/segment=1")
    assert X._blocks(docs, ["title", "tags", "content"], 3)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # that of the documents
    long = spark.createDataFrame([("a", "t", ["g"], " ".join(f"w{i}" for i in range(60_000)), False)], NOTE)
    X.apply(spark, path, long)  # words that all differ cost a sort, not each a look at all others
    assert X.top(spark, path, ["w59999"], 3).count() == 1


def test_text_index_reads_few_blocks_and_keeps_in_step(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 8)
    path = f"file://{tmp_path}/sync"
    rows = spark.range(400).select(F.col("id").cast("string").alias("path"), F.lit("t").alias("title"), F.array(F.lit("tag")).alias("tags"), F.concat(F.lit("common "), F.repeat(F.lit("rare "), (F.col("id") % 50 == 7).cast("int") * 3), F.repeat(F.lit("other "), (F.col("id") % 9).cast("int"))).alias("content"))
    assert X.sync(spark, path, rows) == 1 and X.sync(spark, path, rows) is None  # a second time writes nothing
    assert {r["key"] for r in X.top(spark, path, ["rare", "common"], 8).collect()} == {str(i) for i in range(7, 400, 50)}
    assert {r["key"] for r in X.top(spark, path, ["rare"], 100).collect()} == {str(i) for i in range(7, 400, 50)}
    assert X.sync(spark, path, rows.where("path <> '7'").withColumn("content", F.when(F.col("path") == "57", F.lit("nothing")).otherwise(F.col("content")))) == 2
    assert spark.read.parquet(f"{path}/docs/segment=2").count() == 2
    assert {r["key"] for r in X.top(spark, path, ["rare"], 100).collect()} == {str(i) for i in range(107, 400, 50)}
    (tmp_path / "sync" / "docs" / "segment=3").mkdir()  # an unfinished write is none
    assert X.search(spark, path, ["rare"]).count() == 6


# --- vectors


def vectors(spark, n, size=8, seed=1):
    rnd = np.random.default_rng(seed)
    rows = [(i, (rnd.normal(size=size) + 4 * (i % 5 == np.arange(size))).tolist(), i % 5) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None, 0), (n + 1, [0.0] * size, 0), (3, rows[3][1], 0)], "vec_id long, embedding array<double>, label int"), rows


def test_vector_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "PART_ROWS", 20)  # cells of several parts
    monkeypatch.setattr(V, "QUERY_ROWS", 7)
    frame, rows = vectors(spark, 300)
    path = V.write_index(frame, f"file://{tmp_path}/vectors")
    assert spark.read.parquet(path + "/vectors").count() == 301  # one id twice; null and zero vectors are not there
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    asked = frame.where("vec_id % 20 = 3 OR vec_id >= 300")
    exact = V.search(spark, path, asked, 5, V.ALL)
    got = collections.defaultdict(list)
    for r in exact.orderBy("query", "place").collect():
        got[r["query"]].append((r["vec_id"], r["score"]))
    assert set(got) == {i for i in range(300) if i % 20 == 3}
    for q, near in got.items():
        best = sorted(((-round(float(unit[q] @ unit[i]), 6), i) for i in unit if i != q), key=lambda x: x)
        best = sorted(best + ([x for x in best if x[1] == 3] if q != 3 else []))[:5]
        assert [s for _, s in near] == [-s for s, _ in best]
    assert V.recall(V.search(spark, path, asked, 5), exact).first()["recall"] >= 0.9
    one = V.nearest(spark, path, rows[4][1], 3, V.ALL).collect()
    assert one[0]["vec_id"] == 4 and one[0]["score"] == 1.0
    plan = V.nearest(spark, path, rows[4][1], 3, 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell#", "cell") or "PartitionFilters: [isnotnull(cell" in plan


def test_vector_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>")
    path = V.write_index(none, f"file://{tmp_path}/none")
    assert V.search(spark, path, none).count() == 0 and V.nearest(spark, path, [1.0], 3).count() == 0


def test_null_vectors_are_left_out(spark):
    frame, _ = vectors(spark, 30)
    assert R.nearest_of_each(frame, frame.where("vec_id >= 28"), 1).select("query").distinct().count() == 3
    assert R.first_relevant(frame, frame.where("vec_id = 28 OR vec_id = 30")).count() == 1
    clusters = R.leader_clusters(frame.withColumn("g", F.lit(1)), "g", "vec_id")
    assert clusters.where("vec_id = 30").count() == 0 and clusters.count() == 32


# --- registry


def test_registry_is_one_whatever_the_order(spark):
    day = lambda n: dt.date(2024, 1, n)
    rows = [
        ("Robert  Roe", "person", "suggested", ["Bob"], None, day(5)),
        ("bob", "person", "detected", None, "notes/b", day(3)),
        ("BOB", "project", "suggested", ["The Boss", " "], "notes/a", day(9)),
        ("the boss", None, None, [None, "robert roe"], None, None),
        ("Acme", "organization", "confirmed", ["acme inc"], None, day(1)),
        ("acme", "organization", "suggested", [], "notes/z", day(8)),
        (None, "person", "confirmed", ["x"], None, day(1)),
        ("  ", "person", "confirmed", ["x"], None, day(1)),
        ("Lone", "person", "detected", [], None, day(2)),
    ]
    frame = lambda some: spark.createDataFrame(some, G.SIGHTING)
    plain = lambda t: sorted((tuple(map(str, r)) for r in t.collect()))
    whole = G.merged(frame(rows))
    got = {r["name"]: r for r in whole.collect()}
    assert set(got) == {"bob", "Acme", "Lone"}
    bob = got["bob"]
    assert (bob["type"], bob["tier"], bob["confirmed"], bob["occurrences"], bob["note_path"], bob["first_seen"], bob["last_seen"]) == ("person", "detected", False, 4, "notes/a", day(3), day(9))
    assert [a.lower().split() for a in bob["aliases"]] == [["robert", "roe"], ["the", "boss"]]
    assert got["Acme"]["tier"] == "confirmed" and got["Acme"]["occurrences"] == 2
    rnd = random.Random(1)
    for _ in range(2):
        some = rnd.sample(rows, len(rows))
        assert plain(G.merged(frame(some[4:]), G.merged(frame(some[:4])))) == plain(whole)
    asked = spark.createDataFrame([(" the  BOSS",), ("acme inc",), ("nobody",), (None,)], "name string")
    assert {r["name"]: r["entity"] for r in G.resolved(asked, whole).collect()} == {" the  BOSS": "bob", "acme inc": "Acme", "nobody": None, None: None}
    assert G.merged(frame([])).count() == 0 and G.listed(whole, "person", "detected").count() == 2


def test_registry_ties_names_alone(spark):
    """Aliases of one name are no nodes of the graph, and rounds end with the first stars."""
    frame = lambda some: spark.createDataFrame(some, G.SIGHTING)
    rows = [(f"n{i}", "person", "detected", [f"own {i}", f"N{i + 1}" if i % 3 else f"shared {i // 6}"], None, dt.date(2024, 1, 1)) for i in range(12)]
    named = frame(rows).select(G.normal(F.col("name")).alias("key"))
    forms = frame(rows).select(G.normal(F.col("name")).alias("key"), F.explode("aliases").alias("alias")).select("key", G.normal(F.col("alias")).alias("other"))
    ties = {(r["src"], r["dst"]) for r in G._links(named, forms).collect()}
    assert all(a.startswith("n") and b.startswith("n") and a != b for a, b in ties) and ("n3", "n0") in ties
    got = {r["name"]: (r["occurrences"], [a.lower() for a in r["aliases"]]) for r in G.merged(frame(rows[5:]), G.merged(frame(rows[:5]))).collect()}
    assert got["n0"] == (4, ["n1", "n2", "n3", "own 0", "own 1", "own 2", "own 3", "shared 0"])
    assert {n: g[0] for n, g in got.items()} == {"n0": 4, "n4": 6, "n10": 2} and "n12" in got["n10"][1]


# --- intervals


def test_nested_and_open_intervals(spark):
    rows = [("a", 1, 100), ("a", 2, 3), ("a", 50, 60), ("b", 1, None), ("b", 5, 9), ("c", 1, 3), ("c", 3, 5), ("c", 7, 8), ("d", None, 4), ("d", 2, 6), ("e", 1, 2), ("e", 1, 2)]
    facts = spark.createDataFrame([(s, "p", f, t) for s, f, t in rows], "subject string, predicate string, valid_from int, valid_to int")
    assert sorted((r[0], r[2]) for r in T.overlaps(facts).collect()) == [("a", 2), ("a", 50), ("b", 5), ("d", 2), ("e", 1)]
    assert {(r["subject"], r["first"], r["last"], r["facts"]) for r in T.islands(facts).collect()} == {("a", 1, 100, 3), ("b", 1, None, 2), ("c", 1, 5, 2), ("c", 7, 8, 1), ("d", None, 6, 2), ("e", 1, 2, 2)}
    mended = T.repaired(facts)
    assert T.overlaps(mended).count() == 0
    assert sorted((r[0], r[2] or 0, r[3]) for r in mended.where("subject < 'c'").collect()) == [("a", 1, 2), ("a", 2, 3), ("a", 50, 60), ("b", 1, 5), ("b", 5, 9)]
    assert T.overlaps(facts.limit(0)).count() == 0 and T.islands(facts.limit(0)).count() == 0


# --- moves, logs, tags, code


def test_several_moves_to_one_target(spark):
    notes = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, content string")
    moves = spark.createDataFrame([("a", "t", 2), ("b", "t", 1)], "path string, to string, n int")
    assert sorted(map(tuple, sinks.moved(notes, moves).collect())) == [("c", "3"), ("t", "2")]
    assert sorted(map(tuple, sinks.moved(notes, moves, "n").collect())) == [("c", "3"), ("t", "1")]
    swap = spark.createDataFrame([("a", "b"), ("b", "a")], "path string, to string")
    assert sorted(map(tuple, sinks.moved(notes, swap).collect())) == [("a", "2"), ("b", "1"), ("c", "3")]


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([("a",), ("b",)], "name string")
    for batch in (4, 4, 7, 4):
        sinks.append_changes(spark, rows, path, batch)
    got = spark.read.parquet(path).collect()
    assert len(got) == 4 and len({r["id"] for r in got}) == 4
    late = [r["id"] for r in got if r["batch"] == 7]
    assert min(late) > max(r["id"] for r in got if r["batch"] == 4) and sinks.changes_after(spark, path, min(late) - 1).count() == 2


def test_tags_without_aliases_and_dead_symbols(spark):
    row = spark.range(1).select(relational.merged_tags(F.array(F.lit("A"), F.lit("A"), F.lit("b")), {}).alias("t")).first()
    assert row["t"] == ["A", "b"]
    names = [(1, "main", "function", "a.py"), (2, "x", "namespace", "a.py"), (3, "y", "function", "tests/a.py"), (4, "z", "function", "latest/a.py"), (5, "_private", "function", None), (6, "called", "function", "a.py"), (7, "beforeEach", "function", "a.py"), (8, "s", "method", "a.spec.ts")]
    symbols = spark.createDataFrame([(*n, "r") for n in names], "id long, name string, kind string, relative_path string, repo_id string")
    calls = spark.createDataFrame([(6,), (None,)], "callee_id long")
    assert {r["id"] for r in K.dead_symbols(symbols, calls).collect()} == {4, 5}
    assert K.dead_symbols(symbols, calls, "other").count() == 0 and K.dead_symbols(symbols, calls, "r", "method").count() == 0


# --- entities


def test_names_that_are_none(spark):
    texts = [(1, "Ann met with Vault, Obsidian, Markdown and Wiki. From Vault came Vault's news."), (2, "Director Engineering spoke; CTO Alice Jones did. Marketing reported to Bob Stone. Bob Stone's plan."), (3, "mail to x@vault.com"), (4, "")]
    found = E.entities(spark.createDataFrame(texts, "id long, text string"), "id", "text").collect()
    names = {(r["id"], r["name"]) for r in found}
    assert not names & {(1, n) for n in ("Vault", "Obsidian", "Markdown", "Wiki")} and not any(n in ("Engineering", "Marketing") for _, n in names)
    assert (2, "Alice Jones") in names and (2, "Bob Stone") in names
    context = next(r["context"] for r in found if r["name"] == "Alice Jones")
    assert "CTO Alice Jones did" in context and context.endswith("...")
    alone = E.entities(spark.createDataFrame(texts, "id long, text string"), "id", "text", only=["preceded_by_title"]).collect()
    assert {(r["name"], r["signals"]) for r in alone} == {("Alice Jones", "preceded_by_title")}


# --- themes


@pytest.mark.parametrize("seed", [1, 5])
def test_themes_of_pairs_then_of_tags(spark, seed):
    rnd = random.Random(seed)
    notes = [(i, rnd.sample("abcdefgh", rnd.choice([0, 1, 1, 1, 2, 3])), rnd.choice(["hot", "warm", "cold", None])) for i in range(80)]
    rows = [(i, sorted(set(t) - {"h"}), heat) for i, t, heat in notes if heat in ("hot", "warm") and set(t) - {"h"}]
    pairs, single = collections.Counter(), collections.Counter()
    for _, t, _ in rows:
        single.update(t)
        pairs.update((x, y) for x in t for y in t if x < y)
    taken, expected = set(), []
    for group, least, left in ((sorted(pairs, key=lambda p: (-pairs[p], p)), 2, 2), (sorted(single, key=lambda t: (-single[t], t)), 5, 3)):
        used = {t for tags, _, _, _ in expected for t in tags}
        for name in group:
            tags = set(name)
            if (pairs[name] if len(tags) == 2 else single[name]) < least or (len(tags) == 1 and tags & used):
                continue
            own = [(i, heat) for i, t, heat in rows if i not in taken and tags <= set(t)]
            if len(own) >= left:
                taken |= {i for i, _ in own}
                hot = sum(h == "hot" for _, h in own)
                expected.append((sorted(tags), len(own), min(own)[0], "hot" if 2 * hot >= len(own) else "warm"))
    got = L.note_themes(spark.createDataFrame(notes, "key long, tags array<string>, temperature string"), ignored=("h",)).orderBy("place").collect()
    assert [(r["tags"], r["size"], r["first"], r["temperature"]) for r in got] == expected
    assert any(len(t) == 1 for t, *_ in expected) and any(len(t) == 2 for t, *_ in expected)
    few = L.note_themes(spark.createDataFrame(notes, "key long, tags array<string>, temperature string"), most=2, ignored=("h",))
    assert [r["tags"] for r in few.orderBy("place").collect()] == [t for t, *_ in expected[:2]]


# --- recall


def test_recall_filters_boosts_and_budget(spark):
    note = "path string, type string, category string, temperature string, importance string, heat_score int, last_accessed date, related array<string>, content string, title string, validity_alpha double, validity_beta double"
    rows = [
        ("a", "memory", None, None, None, None, None, None, "plain words here", "A", None, None),
        ("b", "memory", "decision", "hot", "critical", 16, dt.date(2024, 1, 31), ["[[x]]"], "kubernetes notes of the cluster", "B", 9.0, 1.0),
        ("c", "memory", "fact", "cold", "high", None, dt.date(2023, 1, 1), [], "other", "C", 1.0, 1.0),
        ("q", "memory", "fact", "hot", "high", 16, None, [], "quarantined", "Q", 1.0, 9.0),
        ("n", "note", "fact", "hot", "high", 16, None, [], "no memory", "N", None, None),
        ("z", "memory", "fact", "hot", "low", 16, None, None, None, "Z", None, None),
    ]
    notes, hits = spark.createDataFrame(rows, note), spark.createDataFrame([(r[0], 1.0, 1, None if r[0] == "a" else 2) for r in rows], "path string, score double, lexical int, semantic int")
    as_of = F.lit("2024-02-01").cast("date")
    inbound = spark.createDataFrame([("b", 25), ("a", 1)], "path string, inbound long")
    pairs = spark.createDataFrame([("b", "z", 2.0), ("z", "b", 2.0), ("b", "w", 4.0)], "a string, b string, w double")
    got = {r["path"]: r for r in P.ranked_memories(hits, notes, as_of, inbound=inbound, related_to=["x"], context="Kubernetes, cluster! the of", limit=5).collect()}
    assert set(got) == {"a", "b", "c", "z"}
    assert abs(got["b"]["score"] - 1.5 * 2.0 * 2.0 / (1 + 1 / 30) * 1.2 * 1.15) < 1e-9 and got["b"]["rank"] == 1
    assert abs(got["c"]["score"] - 0.5 * 1.5 / (1 + 396 / 90) * 0.5) < 1e-9 and abs(got["z"]["score"] - 1.5 * 0.7) < 1e-9
    assert got["a"]["reason"] == "lexical match; warm; central (1 link); recent" and "stale (contradicted)" in got["c"]["reason"]
    assert {r["path"] for r in P.ranked_memories(hits, notes, as_of, least_importance="high").collect()} == {"b", "c"}
    assert {r["path"] for r in P.ranked_memories(hits, notes, as_of, categories=["decision", "observation"], temperature="warm").collect()} == {"a"}
    many = spark.createDataFrame([(f"m{i}", "memory", *[None] * 6, f"text {i}", f"T{i}", None, None) for i in range(20)] + rows[1:2] + rows[5:6], note)
    found = spark.createDataFrame([(f"m{i}", 2.0, 1, None) for i in range(20)] + [("b", 0.9, 1, 1), ("z", 0.8, 1, 1)], "path string, score double, lexical int, semantic int")
    assert P.ranked_memories(found, many, as_of, limit=5).count() == 15  # what lies beyond three times the limit is not looked at
    spread = {r["path"]: r for r in P.ranked_memories(hits.where("path IN ('b', 'z')"), notes, as_of, associates=pairs, limit=5).collect()}
    assert spread["z"]["together"] == 1.0  # both are seeds
    short = P.memory_recall(hits, notes, as_of, limit=3, most_tokens=9).collect()
    assert [r["place"] for r in short] == sorted(r["place"] for r in short) and short[-1]["content"] is None or "truncated" in short[-1]["content"] or len(short) == 3


def test_rows_meet_centroids_in_small_batches(monkeypatch):
    import pyarrow as pa

    class Rows:
        def mapInArrow(self, run, schema):
            return list(run([pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array([[float(i + 1), 1.0, 2.0, 3.0] for i in range(100)])], names=["vec_id", "embedding"])]))

    monkeypatch.setattr(V, "TILE", 64)
    found = V.nearest_cells(Rows(), np.eye(4), 3)
    assert max(b.num_rows for b in found) == 15 and sum(b.num_rows for b in found) == 300
    assert {i for b in found for i in b.column(0).to_pylist()} == set(range(100))


def test_ranker_asks_for_the_associates_of_its_seeds_alone(spark, data):
    from lodewell.queries.indexes import associates

    baskets = collections.defaultdict(set)
    for r in spark.read.parquet(f"{data}/lineitem.parquet").select("l_orderkey", "l_partkey").collect():
        baskets[r[0]].add(r[1])
    seeds = sorted({p for ps in baskets.values() for p in ps})[:2]
    expected = collections.Counter((a, b) for ps in baskets.values() for a in ps & set(seeds) for b in ps if a != b)
    got = associates(spark, data)(spark.createDataFrame([(p,) for p in seeds], "node long"))
    assert {(r["a"], r["b"]): r["w"] for r in got.collect()} == dict(expected) and expected
    asked = []
    note = "path string, type string, category string, temperature string, importance string, heat_score double, last_accessed date, related array<string>, content string, validity_alpha double, validity_beta double"
    notes = spark.createDataFrame([(p, "memory", None, None, None, None, None, None, "x", None, None) for p in "ab"], note)
    hits = spark.createDataFrame([("a", 1.0, 1, None), ("b", 0.5, 2, None)], "path string, score double, lexical int, semantic int")
    pairs = spark.createDataFrame([("a", "c", 2)], "a string, b string, w long")
    found = P.ranked_memories(hits, notes, F.lit("2024-04-01").cast("date"), associates=lambda some: asked.extend(r["node"] for r in some.collect()) or pairs)
    assert [r["path"] for r in found.orderBy("rank").collect()] == ["a", "b"] and asked == ["a", "b"]


def test_postings_of_a_part_are_sorted_as_arrays(spark):
    docs = spark.createDataFrame([("p", [2, None], ["x", "y"], [[1, 1], [0, 0]]), ("q", [0, 2], ["y"], [[0], [2]])], "key string, len array<int>, terms array<string>, tf array<array<int>>")
    blocks = X._blocks(docs, ["a", "b"], 1)
    assert [(r.term, r.block, r.n, r.most, r.least, sorted(d.key for d in r.docs)) for r in blocks.collect()] == [("x", 0, 1, [1, 0], [2, None], ["p"]), ("y", 0, 2, [1, 2], [2, 2], ["p", "q"])]
    assert "collect_list" not in blocks._jdf.queryExecution().optimizedPlan().toString()
