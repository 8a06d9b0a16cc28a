"""Sinks, entities, consolidation, code navigation, postings and scalar functions: worked examples and brute force."""

import collections
import datetime as dt
import json
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from lodewell.functions import text as T
from lodewell.operators import codenav as C
from lodewell.operators import consolidation as K
from lodewell.operators import entities as E
from lodewell.operators import graph as G
from lodewell.operators import lifecycle as L
from lodewell.operators import retrieval as R
from lodewell.operators import shingles as N
from lodewell.operators import telemetry as M
from lodewell.sources import code, sinks, vault
from lodewell.streaming import pipelines


def one(spark, value):
    return spark.range(1).select(value.alias("v")).first().v


# --- sinks


def test_moves(spark):
    notes = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "path string, content string")
    moves = spark.createDataFrame([("a", "b"), ("c", None), ("x", "y")], "path string, to string")
    assert {tuple(r) for r in sinks.moved(notes, moves).collect()} == {("b", "1"), ("d", "4")}


def test_vectors_are_kept_in_step(spark, tmp_path):
    path = str(tmp_path / "vectors")
    none = spark.createDataFrame([], "path string, hash string, embedding array<double>")
    seen = []

    def embed(rows):
        seen.append(sorted(r.path for r in rows.select("path").collect()))
        return sinks.hashed_vectors(8)(rows)

    first = spark.createDataFrame([("a", "one two"), ("b", "three"), ("c", None)], "path string, content string")
    sinks.save_vectors(sinks.synced_vectors(first, none, embed), path, 1)
    then = spark.createDataFrame([("a", "one two"), ("b", "changed"), ("d", "new")], "path string, content string")
    sinks.save_vectors(sinks.synced_vectors(then, sinks.load_vectors(spark, path), embed), path, 2)
    (tmp_path / "vectors" / "vectors" / "00000003").mkdir()  # an unfinished write
    got = {r.path: r.embedding for r in sinks.load_vectors(spark, path).collect()}
    assert set(got) == {"a", "b", "d"} and seen == [["a", "b", "c"], ["b", "d"]]
    assert all(abs(sum(x * x for x in v) - 1) < 1e-9 for v in got.values())


def test_journal_log_report_and_mirror(spark, tmp_path):
    entries = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3, 4), "did\nthis"), (dt.datetime(2024, 1, 3, 3, 4), "that")], "at timestamp, text string")
    sinks.append_journal(entries, str(tmp_path / "journal"))
    sinks.append_journal(entries.limit(1), str(tmp_path / "journal"))
    assert spark.read.text(str(tmp_path / "journal")).count() == 3
    log = str(tmp_path / "log")
    for names in (["a", "b"], ["c"]):
        sinks.append_changes(spark, spark.createDataFrame([(n,) for n in names], "name string"), log)
    rows = spark.read.parquet(log).orderBy("id").collect()
    assert [r.name for r in rows][-1] == "c" and len({r.id for r in rows}) == 3
    assert [r.name for r in sinks.changes_after(spark, log, rows[1].id).collect()] == ["c"]
    stream = pipelines.changed_rows(spark, log, "name string, id long", rows[0].id)
    got = []
    pipelines.run_due(stream, lambda batch: got.extend(r.name for r in batch.collect()), str(tmp_path / "ck"))
    pipelines.run_due(stream, lambda batch: got.extend(r.name for r in batch.collect()), str(tmp_path / "ck"))
    assert sorted(got) == sorted(r.name for r in rows[1:])
    report = str(tmp_path / "report")
    for k in range(2):
        sinks.write_report(spark.createDataFrame([(k,)], "recall int"), spark.range(k + 1), report, f"2024-01-0{k + 1}")
    assert spark.read.json(report + "/history").count() == 2 and spark.read.json(report + "/last/summary").first().recall == 1
    (row,) = sinks.mirror(spark.createDataFrame([("r2", "b"), ("r1", "a")], "repo_id string, slug string")).collect()
    assert json.loads(row.document) == [{"repo_id": "r1", "slug": "a"}, {"repo_id": "r2", "slug": "b"}]
    sinks.write_state(spark.range(3), str(tmp_path / "state"))
    assert spark.read.json(str(tmp_path / "state")).count() == 3


def test_pushes_and_debounce(spark, tmp_path):
    rows = [("a", dt.datetime(2024, 1, 1, 0, 0, s), s) for s in (0, 3, 20)] + [("b", dt.datetime(2024, 1, 1), 9)]
    events = spark.createDataFrame(rows, "k string, at timestamp, v int")
    flushed = {(r.k, r.flush_at.second, r.changes) for r in M.debounced(events, "k", "at").collect()}
    assert flushed == {("a", 8, 2), ("a", 25, 1), ("b", 5, 1)}
    assert M.unexpired(events, "at", 10, F.lit("2024-01-01 00:00:12").cast("timestamp")).count() == 2
    events.write.parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = pipelines.pushed(stream, lambda frame: got.extend(tuple(r) for r in frame.select("k", "v").collect()), "k", "at", "1 second", str(tmp_path / "push"))
    query.processAllAvailable()
    query.stop()
    assert sorted(got) == [("a", 20), ("b", 9)]


def test_artifacts_and_repositories(spark, tmp_path):
    (tmp_path / "files" / "a").mkdir(parents=True)
    (tmp_path / "files" / "a" / "x.PNG").write_bytes(bytes(range(256)))
    (tmp_path / "files" / "none").write_bytes(b"")
    got = {r.name: (r.mime, r.size, r.etag[:6]) for r in vault.read_artifacts(spark, str(tmp_path / "files")).collect()}
    assert got == {"x.PNG": ("image/png", 256, "40aff2")}
    paths = ["/w/a/.git/HEAD", "/w/a/b/.git/HEAD", "/w/c/d/.git/HEAD", "/w/c/.git/config", "/w/a2/.git/HEAD"]
    assert {r.root for r in vault.repositories(spark.createDataFrame([(x,) for x in paths], "path string")).collect()} == {"/w/a", "/w/c/d", "/w/a2"}


SOURCES = {
    "a.ts": ("import { x } from './lib/x';\n// a note\nexport class Box<T> extends Base {\n  private size(n: number): number {\n    return twice(n); // call(me)\n  }\n}\nfunction twice(n) { return n * 2; }\nexport const LIMIT = 3;\nconst go = async (a) => run(a);\ninterface Shape { area(): number }\ntype Id = string;\n",
             {("Box", "class"), ("Box.size", "method"), ("twice", "function"), ("LIMIT", "const-export"), ("go", "function"), ("Shape", "interface"), ("Id", "type")}, {("Box.size", "twice"), ("go", "run")}, {"./lib/x"}),
    "b.go": ('package p\nimport (\n\t"fmt"\n)\ntype Tree struct {\n\tleft *Tree\n}\nfunc (t *Tree) Walk(n int) int {\n\tfmt.Println("f(x)")\n\treturn grow(n)\n}\nfunc grow(n int) int { return n }\n', {("Tree", "struct"), ("Walk", "method"), ("grow", "function")}, {("Walk", "Println"), ("Walk", "grow")}, {"fmt"}),
    "c.rs": ("use std::fmt;\n/// Holds it.\npub struct Held { a: u8 }\nimpl Held {\n    pub fn take(&self) -> u8 { help(self.a) }\n}\nfn help(a: u8) -> u8 { a }\ntrait Able { fn can(&self); }\n", {("Held", "struct"), ("Held.take", "method"), ("help", "function"), ("Able", "trait"), ("Able.can", "method")}, {("Held.take", "help")}, {"std::fmt"}),
    "D.java": ("import java.util.List;\npublic class D {\n  @Override\n  public List<String> all(int n) throws E {\n    if (n > 0) { return make(n); }\n    return null;\n  }\n}\n", {("D", "class"), ("D.all", "method")}, {("D.all", "make")}, {"java.util.List"}),
    "e.cpp": ('#include "e.h"\nclass Box : public Base {\n  int n;\n};\nint Box::size(int a) {\n  return add(a, n);\n}\nstatic int add(int a, int b) { return a + b; }\n', {("Box", "class"), ("size", "function"), ("add", "function")}, {("size", "add")}, {"e.h"}),
    "f.kt": ("import a.b.C\nclass F {\n  fun go(x: Int): Int = twice(x)\n}\nfun twice(x: Int): Int { return x * 2 }\n", {("F", "class"), ("F.go", "method"), ("twice", "function")}, {("F.go", "twice")}, {"a.b.C"}),
    "g.php": ("<?php\nuse A\\B;\nclass G { public function go($x) { return $this->twice($x); } }\nfunction twice($x) { return $x; }\n", {("G", "class"), ("G.go", "method"), ("twice", "function")}, {("G.go", "twice")}, {"A\\B"}),
    "h.swift": ("import Foundation\nstruct H {\n  func go(_ x: Int) -> Int { return twice(x) }\n}\nfunc twice(_ x: Int) -> Int { x * 2 }\n", {("H", "struct"), ("H.go", "method"), ("twice", "function")}, {("H.go", "twice")}, {"Foundation"}),
}


def test_languages_with_braces(spark):
    files = code.source_files(spark.createDataFrame([(p, s[0]) for p, s in SOURCES.items()] + [("x.js", "function ( {{{ '"), ("y.c", None)], "path string, content string"))
    rows = code.parsed(files).collect()
    for path, (_, symbols, calls, imports) in SOURCES.items():
        own = [r for r in rows if r.path == path]
        assert {(r.qualified_name, r.kind) for r in own if r.row == "symbol"} == symbols, path
        assert {(r.qualified_name, r["name"]) for r in own if r.row == "call"} == calls, path
        assert {r.module for r in own if r.row == "import"} == imports, path
    (held,) = [r for r in rows if r.row == "symbol" and r["name"] == "Held"]
    (size,) = [r for r in rows if r.row == "symbol" and r.qualified_name == "Box.size"]
    assert held.docstring == "Holds it." and (size.start_line, size.end_line, size.signature, size.parent) == (4, 6, "private size(n: number): number", "Box")


# --- entities


def test_entities_by_their_surroundings(spark):
    texts = [
        (1, "Dr. Grace Hopper spoke. Yesterday Alan Turing met with Ada. NVIDIA's plan came from NVIDIA."),
        (2, "See [[Projects/rocket-ship]] and [[2024-01-02]], [[People|Jane Roe]]. Mail john.smith@initech.com now."),
        (3, "Acme Widgets Inc and the Falcon Team use Rocket v2.1; code: github.com/foo/bar-baz. Bob (PM) said so."),
        (4, "This That The API. Just Nothing here"),
        (5, None),
    ]
    got = {(r.id, r.name, r.type): (r.confidence, r.signals) for r in E.entities(spark.createDataFrame(texts, "id long, text string"), "id", "text").collect()}
    assert got[1, "Grace Hopper", "person"] == (0.67, "preceded_by_title")
    # `met with` lies within 80 characters
    assert got[1, "NVIDIA", "organization"] == (0.76, "attribution_pattern,near_relationship_verb,possessive_pattern")
    assert (1, "Alan Turing", "person") not in got  # one weak signal
    assert (2, "rocket-ship", "project") in got and (2, "Jane Roe", "person") in got and not any(n == "2024-01-02" for _, n, _ in got)
    assert {(3, "Acme Widgets", "organization"), (3, "Falcon", "organization"), (3, "Rocket", "project"), (3, "bar-baz", "project"), (3, "Bob", "person")} <= set(got)
    assert not any(i in (4, 5) for i, _, _ in got)


def test_registry_and_backfill(spark):
    found = spark.createDataFrame([(1, "Acme", "project", 0.55, "repo_url"), (2, "Other", "person", 0.9, "x")], "id long, name string, type string, confidence double, signals string")
    registry = spark.createDataFrame([("acme", "organization", "confirmed"), ("ACME", "person", "detected")], "name string, type string, tier string")
    got = {r.id: (r.type, r.confidence, r.signals) for r in E.boosted(found, registry).collect()}
    assert got == {1: ("organization", 0.75, "repo_url,registry_confirmed"), 2: ("person", 0.9, "x")}
    notes = [("a", "A", "Dr Ann Lee came", "c", False), ("b", "B", "Dr Ann Lee went", "c", None), ("d", "D", "Dr Joe Doe", "c", True), ("e", "E", "Dr Joe Doe", "no", False)]
    rows, facts = E.backfill(spark.createDataFrame(notes, "path string, title string, content string, collection string, archived boolean"), 0.5, ("no",))
    assert [(r.name, r.occurrences, r.path) for r in rows.collect()] == [("Ann Lee", 2, "a")]
    assert {(r.subject, r.predicate, r.object) for r in facts.collect()} == {("A", "mentions_person", "Ann Lee"), ("B", "mentions_person", "Ann Lee")}
    light = one(spark, E.light_entities(F.lit("The John Smith uses PostGres\nHere we met Anna, but Still fine")))
    assert light == ["Anna", "John", "Smith"] or light == ["Anna", "John", "PostGres", "Smith"]


# --- consolidation


def test_clusters_and_distillation(spark):
    tags = {1: "abc", 2: "abc", 3: "ab", 4: "xy", 5: "xy", 6: "a"}
    tagged = spark.createDataFrame([(k, t) for k, ts in tags.items() for t in ts], "key long, tag string")
    (row,) = K.tag_clusters(tagged).collect()
    assert (row.community, row.members, row.tags) == (1, 3, ["a", "b", "c"])
    named = spark.createDataFrame([(4, "Acme"), (6, "Acme"), (5, "Solo")], "key long, name string")
    got = {r.cluster: (r.members, r.basis) for r in K.reconciled(tagged, named).collect()}
    assert got == {1: (3, "tags:a+b"), 4: (3, "entity:Acme")}
    notes = spark.createDataFrame([(1, "n/a.md", "Old title", "x  y"), (2, "n/b.md", "New: title", "z")], "key long, path string, title string, content string")
    facts, moves = K.distilled(notes, spark.createDataFrame([(7, 1), (7, 2)], "cluster long, key long"), "2024-01-01")
    (fact,) = facts.collect()
    assert (fact.path, fact.content, fact.members) == ("Memories/consolidated/new-title.md", "- [[n/a.md]]: x y\n- [[n/b.md]]: z", 2)
    assert {(r.path, r.to) for r in moves.collect()} == {("n/a.md", "Archive/n/a.md"), ("n/b.md", "Archive/n/b.md")}


def test_contradictions_meet_by_entity(spark):
    new = spark.createDataFrame([(1, "new", "Acme ", "the server listens on port eighty", [1.0, 0.0])], "key long, path string, entity string, text string, v array<double>")
    known = [("old", "acme", "nobody can reach it any longer", [0.9, 0.1]), ("far", "acme", "other thing", [0.0, 1.0]), ("same", "acme", "the server listens on port eighty", [1.0, 0.0]), ("else", "Beta", "nobody", [1.0, 0.0]), ("new", "acme", "q", [1.0, 0.0])]
    rows = spark.createDataFrame(known, "path string, entity string, text string, v array<double>")
    assert [(r.path, r.score) for r in K.contradictions(new, rows, R.cosine(F.col("n.v"), F.col("k.v"))).collect()] == [("old", 0.9939)]


def test_themes_leave_none_short(spark):
    rng = random.Random(4)
    rows = [(i, rng.sample("abcdefg", rng.randint(0, 5))) for i in range(60)]
    got = {r.theme: (r.size, r.first) for r in L.themes(spark.createDataFrame(rows, "key long, tags array<string>")).collect()}
    pairs = {i: ["+".join(p) for p in {(x, y) for x in t for y in t if x < y}] for i, t in rows}
    count = collections.Counter(p for ps in pairs.values() for p in ps)
    alive = {p for p, n in count.items() if n >= 3}
    while True:
        order = lambda p: (-count[p], p)
        taken = collections.defaultdict(list)
        for i, ps in pairs.items():
            if best := min((p for p in ps if p in alive), key=order, default=None):
                taken[best].append(i)
        short = [p for p, ids in taken.items() if len(ids) < 3]
        if not short:
            break
        alive.remove(min(short, key=order))
    assert got == {p: (len(ids), min(ids)) for p, ids in taken.items()}


# --- graphs


def test_strong_components_of_many_linked_cycles(spark):
    """A row of cycles: 20 pairs, each leading to the next."""
    edges = [e for k in range(0, 40, 2) for e in ((k, k + 1), (k + 1, k), (k + 1, k + 2))]
    got = {r.node: r.component for r in G.strong_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: i - i % 2 for i in range(40)}


def test_strong_components_cut_the_lineage_few_times(spark, monkeypatch):
    """A ring of 24 nodes with a chain that leads into it and one that leads out: a step for each node, but no checkpoint for each step."""
    cuts, real = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df: cuts.append(1) or real(df))
    edges = [(i, (i + 1) % 24) for i in range(24)] + [(100, 101), (101, 0), (5, 200)]
    got = {(r.node, r.component, r.size) for r in G.strong_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {(i, 0, 24) for i in range(24)} and len(cuts) < 40


def test_snapshot_seeds_and_spread(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (4, 1)], "src long, dst long")
    nodes = spark.createDataFrame([(9,)], "node long")
    kept, inside = G.snapshot(edges, nodes, 3)
    assert sorted(r.node for r in kept.collect()) == [1, 2, 3] and inside.count() == 3 and G.snapshot(edges, nodes, 0)[0].count() == 5
    after = G.replaced_edges(edges, spark.createDataFrame([(1,)], "node long"), spark.createDataFrame([(1, 9)], "src long, dst long"))
    assert sorted(map(tuple, after.collect())) == [(1, 9), (2, 3), (4, 1)]
    ways = G.both_ways(edges).withColumn("w", F.lit(1.0))
    lexical = spark.createDataFrame([(2, 1), (77, 2), (4, 6)], "node long, lexical int")
    seeds = G.recall_seeds(ways, spark.createDataFrame([(3,), (5,)], "node long"), lexical)
    assert sorted(r.node for r in seeds.collect()) == [2, 3]
    notes = spark.createDataFrame([(i,) for i in (1, 2, 4)], "node long")
    assert [tuple(r) for r in G.seed_spread(ways, seeds, notes).orderBy("hops").collect()] == [(1, 1), (2, 1), (3, 0)]
    ranks = [r.node for r in G.graph_arm(ways, seeds, notes, 2).orderBy("graph").collect()]
    walk = {r.node: r.score for r in G.personalised_pagerank(ways, seeds).collect()}
    assert ranks == sorted((1, 2, 4), key=lambda n: (-walk.get(n, 0), n))[:2]


# --- retrieval


def test_postings_match_a_scan(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["réd", "red", "redder", "blue", "Green"], k=rng.randint(0, 6))), rng.choice([None, "red blue", "x"])) for i in range(80)]
    docs = spark.createDataFrame(rows, "id long, name string, note string")
    path = str(tmp_path / "index")
    R.postings(docs, ["name", "note"], "id", path, 3)
    for query in ("red", "blu gre", "nothing"):
        got = {r.id: round(r.score, 6) for r in R.search_postings(spark, path, query, {"name": 2.0, "note": 1.0}, "id").collect()}
        folded = docs.select("id", T.folded(F.col("name")).alias("name"), F.col("note"))
        expected = {r.id: r for r in R.bm25(folded, query.split(), {"name": 2.0, "note": 1.0}, "id").collect()}
        assert set(got) == set(expected)
    plain = lambda s: [w.replace("é", "e") for w in (s or "").lower().split()]
    hits = {r.id for r in R.search_postings(spark, path, "red blu", {"name": 1.0, "note": 1.0}, "id", phrase=True).collect()}
    assert hits == {i for i, *fields in rows if any(a == "red" and b.startswith("blu") for f in fields for a, b in zip(plain(f), plain(f)[1:]))}
    assert R.search_postings(spark, path, "!!", {"name": 1.0}, "id").count() == 0


def test_nearest_and_first_relevant_match_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, rng.randrange(4), [round(rng.gauss(0, 1), 1) for _ in range(3)]) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>").repartition(5)
    score = lambda a, b: round(sum(x * y for x, y in zip(a, b)), 6)
    order = {q: sorted(((-score(a, b), i, l2) for i, l2, b in rows if i != q)) for q, _, a in rows}
    for block in (10_000, 7):
        got = collections.defaultdict(list)
        for r in R.nearest_of_each(frame, frame, 5, block).orderBy("query", "place").collect():
            got[r.query].append(r.vec_id)
        assert dict(got) == {q: [i for _, i, _ in o[:5]] for q, o in order.items()}
        first = {r.query: r.place for r in R.first_relevant(frame, frame, block).collect()}
        assert first == {q: next(k for k, (_, _, x) in enumerate(order[q], 1) if x == label) for q, label, _ in rows}


def test_every_vector_is_a_query_of_reciprocal_rank(spark, data):
    from lodewell import queries  # noqa: F401
    from lodewell.catalog import QUERIES

    rows = spark.read.parquet(f"{data}/embeddings.parquet")
    shared = rows.groupBy("label").count().where("count > 1")
    asked = {r.vec_id for r in rows.join(shared, "label").select("vec_id").collect()}
    assert {r.query for r in QUERIES["reciprocal_rank"](spark, data).collect()} == asked and any(i % 20 for i in asked)
    few = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, None, [1.0, 0.0]), (3, 1, [0.0, 1.0]), (4, None, [0.5, 0.5]), (5, 2, [0.0, 1.0])], "vec_id long, label long, embedding array<double>")
    assert {(r.query, r.place) for r in R.first_relevant(few, few, 2).collect()} == {(1, 3), (3, 3)}  # what has no label is before, but never relevant


def test_simhash_matches_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, rng.choices(["a b", "c", "é", "word", "x y"], k=rng.randint(0, 9))) for i in range(40)] + [(40, None)]
    got = {r.id: r.v for r in spark.createDataFrame(rows, "id long, tokens array<string>").select("id", R.simhash(F.col("tokens")).alias("v")).collect()}
    for i, tokens in rows:
        hashes = [xxhash.xxh64(t.encode(), seed=42).intdigest() for t in tokens or []]
        bits = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes)) if len(hashes) >= 3 else 0
        assert got[i] % (1 << 64) == bits


def test_simhash_pairs_match_brute_force(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(12)]
    prints = {i: (b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5)))) for i, b in enumerate(base * 6)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = {(r.a, r.b, r.distance) for r in R.hamming_pairs(spark.createDataFrame([(i, signed(p)) for i, p in prints.items()], "id long, simhash long"), "id").collect()}
    least = {}
    for i, p in sorted(prints.items(), reverse=True):
        least[p] = i
    assert got == {(a, b, (p ^ q).bit_count()) for p, a in least.items() for q, b in least.items() if a < b and (p ^ q).bit_count() <= 3}


# --- scalars


def test_scalar_functions(spark):
    assert one(spark, T.prose_title(F.lit("```\ncode\n```\n\n## $ run it. Then"))) == "run it"
    assert one(spark, T.prose_title(F.lit(""))) == "Untitled Memory" and one(spark, T.prose_title(F.lit("x" * 90))) == "x" * 77 + "..."
    assert one(spark, T.linked_once(F.lit("Ann Lee met Ann and Ann"), ["Ann", "Ann Lee"])) == "[[Ann Lee]] met [[Ann]] and Ann"
    assert [one(spark, T.humanised_age(F.lit(s))) for s in (-5, 89, 90, 5399, 5400, 129_600)] == ["0s ago", "89s ago", "1m ago", "89m ago", "1h ago", "1d ago"]
    assert {one(spark, T.origin(F.lit(u))) for u in ("git@Host.com:O/r.git", "https://host.com/o/r/", "ssh://host.com/o/r.git")} == {"host.com/o/r"}
    assert one(spark, T.ring(F.array(*map(F.lit, [1, 2, 3])), F.lit(4), 2)) == [3, 4] and one(spark, L.history(F.lit(None).cast("array<string>"), F.lit("x"))) == ["x"]
    at = F.lit("2024-01-01 10:00:00").cast("timestamp")
    assert [one(spark, F.date_format(T.next_daily(at, h, 0), "dd HH")) for h in (9, 10, 11)] == ["02 09", "02 10", "01 11"]
    assert one(spark, C.repo_identity(F.lit(" "), F.lit("a" * 40))) == "a" * 16


@pytest.mark.parametrize("kind,n", [("all", 3), ("removed", 1)])
def test_changes_tell_truncation(spark, kind, n):
    log = spark.createDataFrame([(i, "p/x", "removed" if i == 2 else "sig_changed", i) for i in range(4)], "id long, relative_path string, change_kind string, captured_at long")
    rows = C.changes_since(log, F.lit(1), kind, "p/", 3).collect()
    assert len(rows) == n and not any(r.truncated for r in rows) and all(r.truncated for r in C.changes_since(log, F.lit(0), "all", "", 3).collect())


def test_word_pairs_match_plain_ones(spark):
    rng = random.Random(9)
    words = ["The", "cat", "Ümlaut", "日本", "a", "x_y", "2024-01-02", "10:30", "77", "é1", "--", "is", "Ⅷ"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 14))) for _ in range(60)] + ["", "word " * 100_000]
    assert [len(s) for s in N.pair_sets(texts, False)] == [len({(a, b) for w in [re.findall(r"[^\W_]+", t.lower())] for a, b in zip(w, w[1:])}) for t in texts]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(999, None)], "id long, text string")
    plain = {r.id: len(r.v) for r in frame.where("text IS NOT NULL").select("id", T.bigrams(T.structural(F.col("text"))).alias("v")).collect()}
    got = {r.id: r["items"] for r in N.structural_items(frame, "id", "text").collect()}
    assert {i: len(v) for i, v in got.items()} == {i: n for i, n in plain.items() if n}
    assert N.pair_sets(["one two three"], False)[0].tolist() == N.pair_sets(["x", "ONE two, three"], False)[1].tolist()
    prints = {r.id: r.simhash for r in N.fingerprints(frame, "id", "text").collect()}
    for i, s in enumerate(N.pair_sets(texts, False)):
        bits = sum(1 << k for k in range(64) if 2 * sum(int(h) >> k & 1 for h in s) > len(s)) if len(s) >= 3 else 0
        assert prints[i] % (1 << 64) == bits


def test_contradictions_of_equal_memories_are_found_by_class(spark):
    rng = random.Random(6)
    texts = ["the server listens on port eighty", "nobody can reach it any longer", "`x` http://a.b", ""]
    rows = [(i, f"p{rng.randrange(50)}", rng.choice(["Acme", "acme ", "Beta", None]), rng.choice(texts), [1.0, rng.choice([0.0, 0.1, 0.4])]) for i in range(60)]
    known = spark.createDataFrame(rows, "key long, path string, entity string, text string, v array<double>")
    new, cosine = known.where("key % 3 = 0"), R.cosine(F.col("n.v"), F.col("k.v"))
    words = {r.text: set(r.w) for r in known.select("text", T.content_tokens(F.col("text")).alias("w")).collect()}

    def score(v, w):
        return round(sum(a * b for a, b in zip(v, w)) / (sum(a * a for a in v) * sum(b * b for b in w)) ** 0.5, 4)

    expected = []
    for key, path, about, text, v in rows[::3]:
        far = lambda t: len(words[t] & words[text]) / max(1, len(words[t] | words[text])) < 0.5
        hits = [(-score(v, w), p) for _, p, e, t, w in rows if e and about and e.strip().lower() == about.strip().lower() and p != path and far(t) and score(v, w) >= 0.8]
        expected += [(key, p, -s) for s, p in sorted(hits)[:3]]
    found = K.contradictions(new, known, cosine)
    assert sorted((r["key"], r.path, r.score) for r in found.collect()) == sorted(expected)
    copies = known.unionByName(known.withColumn("path", F.concat("path", F.lit("z"))))
    pairs = {n: K.contradictions(new, d, cosine) for n, d in (("one", known), ("two", copies))}
    assert pairs["two"].select("key").distinct().count() >= pairs["one"].select("key").distinct().count()


def test_contradictions_in_tiles_are_those_of_all_pairs(spark, monkeypatch):
    rng = random.Random(8)
    texts = ["the server listens on port eighty", "nobody can reach it any longer", "port eighty", "", None]
    vectors = lambda: rng.choice([[1.0, rng.choice([0.0, 0.1, 0.4, 3.0])], [rng.random(), rng.random()], [1.0], [0.0, 0.0], [1.0, None], [float("nan"), 1.0], None])
    new, cosine = "key % 3 = 0", R.cosine(F.col("n.v"), F.col("k.v"))
    for paths in (40, 10**6):  # some paths several times, and none
        rows = [(i, f"p{rng.randrange(paths)}", rng.choice(["Acme", "acme ", "Beta", None]), rng.choice(texts), vectors()) for i in range(120)]
        known = spark.createDataFrame(rows, "key long, path string, entity string, text string, v array<double>")
        expected = sorted((r["key"], r.path, str(r.score)) for r in K.contradictions(known.where(new), known, cosine).collect())
        for name, n in (("TILE_ASKED", 7), ("TILE_TOLD", 11), ("TILE_PAIRS", 30)):  # several tiles and steps
            monkeypatch.setattr(K, name, n)
        assert sorted((r["key"], r.path, str(r.score)) for r in K.contradictions(known.where(new), known, "v").collect()) == expected and expected


def test_potential_conflicts_within_a_group_are_those_of_all_hits(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice("xy"), f"p{i % 37}", rng.choice(["Old bolt", "old bolts", "a ring", None]), rng.choice([["a"], ["b", "a"], [], None]), rng.choice(["fact", "decision", "plan"]), rng.choice(["memory", "note"])) for i in range(80)]
    notes = spark.createDataFrame(rows, "key long, brand string, path string, title string, tags array<string>, category string, type string")
    new = notes.where("key % 3 = 0")
    hits = notes.drop("key").join(new.select("key", "brand"), "brand")
    expected = sorted(map(tuple, K.potential_conflicts(new, hits).collect()))
    assert expected and sorted(map(tuple, K.potential_conflicts_within(new, notes, "brand").collect())) == expected


def test_scores_are_held_in_tiles(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(R, "TILE", 120)
    rng = random.Random(8)
    vectors = spark.createDataFrame([(i, i % 3, [rng.choice([0.0, 0.5, 1.0]), rng.choice([0.0, 0.5])]) for i in range(90)], "vec_id long, label long, embedding array<double>").coalesce(1)
    queries = vectors.where("vec_id % 3 = 0")

    def sizes(q_ids, q_labels, scored):
        yield pa.RecordBatch.from_arrays([pa.array([s.size for _, _, s in scored], pa.int64())], names=["n"])

    assert [r.n for r in R._against(vectors, queries, 1000, sizes, "n long").collect()] == [120] * 22 + [60]
    rows = {r.vec_id: r for r in vectors.collect()}
    dot = lambda a, b: round(sum(x * y for x, y in zip(a, b)), 6)
    for q, group in collections.Counter(r["query"] for r in R.nearest_of_each(vectors, queries, 4).collect()).items():
        assert group == 4
    found = sorted((r["query"], r["place"], r["vec_id"]) for r in R.nearest_of_each(vectors, queries, 4).collect())
    expected = []
    for q in (r for r in rows.values() if r.vec_id % 3 == 0):
        best = sorted((-dot(q.embedding, o.embedding), o.vec_id) for o in rows.values() if o.vec_id != q.vec_id)[:4]
        expected += [(q.vec_id, place, i) for place, (_, i) in enumerate(best, 1)]
    assert found == sorted(expected)


def test_budget_is_cut_in_each_partition_first(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), i, rng.choice([None, "", "x" * rng.randrange(1, 30)])) for i in range(300)]
    found = L.budget_cut(spark.createDataFrame(rows, "lang string, key long, text string").repartition(7), "lang", [F.col("key")], "text", 20)
    expected, used = [], {"a": 0, "b": 0}
    for lang, key, text in rows:
        if text is not None and used[lang] < 80:
            expected.append((lang, key, used[lang], text[: 80 - used[lang]]))
            used[lang] += len(text)
    assert sorted((r.lang, r["key"], r.used, r.kept) for r in found.collect()) == sorted(expected)
    assert "_part" in found._jdf.queryExecution().optimizedPlan().toString()


def test_keys_that_share_two_items_meet_under_pairs_of_items(spark):
    import random

    from lodewell.operators import relational as R

    rng = random.Random(3)
    rows = [(k, rng.randrange(25)) for k in range(60) for _ in range(rng.randint(1, 6))] + [(None, 1), (1, None), (2, None)]
    keys = {}
    for k, i in rows:
        if k is not None and i is not None:
            keys.setdefault(k, set()).add(i)
    held = {i: sum(i in s for s in keys.values()) for i in range(25)}
    keys = {k: {i for i in s if held[i] <= 12} for k, s in keys.items()}
    expected = {(a, b, len(keys[a] & keys[b])) for a in keys for b in keys if a < b and len(keys[a] & keys[b]) >= 2}
    few = spark.createDataFrame(rows, "k long, i long")
    kept = spark.createDataFrame([(k, i) for k, s in keys.items() for i in s], "k long, i long")
    for found in (R.shared_item_pairs(few, "k", "i", 2, 12), R._by_item_pairs(kept, "k", "i", 2)):
        assert {(r.a, r.b, r.shared) for r in found.collect()} == expected and expected
    many = spark.createDataFrame([(k, i) for k in range(3) for i in range(40)], "k long, i long")  # keys of many items meet under items
    assert {tuple(r) for r in R.shared_item_pairs(many, "k", "i", 2, 12).collect()} == {(0, 1, 40), (0, 2, 40), (1, 2, 40)}


def test_items_of_many_keys_still_make_pairs(spark, tmp_path, monkeypatch):
    from lodewell import queries  # noqa: F401
    from lodewell.catalog import QUERIES
    from lodewell.operators import relational as R

    rows = [(k, i) for k in range(70) for i in (1, 2)] + [(3, 9), (100, 1), (101, 9), (101, 3), (3, 3)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    expected = {(a, b, 2) for a in range(70) for b in range(a + 1, 70)} | {(3, 101, 2)}
    assert {tuple(r) for r in QUERIES["shared_tag_pairs"](spark, str(tmp_path)).collect()} == expected
    monkeypatch.setattr(R, "TILE_KEYS", 16)  # groups of several blocks
    frame = spark.createDataFrame(rows, "k long, i long")
    assert [sorted(map(tuple, R.shared_item_pairs(frame, "k", "i", n).collect())) for n in (1, 2)] == [
        sorted(expected | {(a, 100, 1) for a in range(70)}),
        sorted(expected),
    ]


def test_rules_of_entities_search_only_texts_that_have_what_they_need():
    import re

    from lodewell.operators import entities as E

    plain = E.Seen("Un texto cualquiera, sin nada; a plain text (2) of nothing in particular. Ein Text ohne Namen.")
    assert sum(rule.needs(plain) for rule in E.RULES if rule.reach == "text") <= 2
    stop = frozenset(E.STOP_NAMES)
    texts = ["Dr Ada Lovelace (CTO) told NASA's team", "Acme Inc joined companyX", "mail ada.love@acme.io", "Spark v3.1, see github.com/a/spark-x", "the App project Alpha, building Beta", "[[Ada Lovelace]] cc'd Bob Stone", "to    ACME now"]
    for text in texts:
        seen = E.Seen(text)
        for rule, pattern in zip(E.RULES, E._COMPILED):  # what has a match that stands is searched
            for m in pattern.finditer(text):
                assert rule.needs(seen) or (rule.holds and not rule.holds(text, m.start(), m.end())) or (rule.reach == "sentences" and not E._NEEDS_VERB(seen)), (rule, m)
    assert {s[2] for t in texts for s in E.signals(t, stop)} >= {"preceded_by_title", "name_with_role", "legal_suffix", "email_address", "versioned_name", "repo_url", "wiki_link", "attribution_pattern"}
    assert re.search(E.VERB, "cc'd", re.A | re.I) and E._NEEDS_VERB(E.Seen("cc'd"))


def test_walks_shuffle_their_edges_once_not_every_few_rounds(spark, monkeypatch):
    from lodewell.operators import graph as G

    held, names = G.Rounds.held, []
    monkeypatch.setattr(G.Rounds, "held", lambda self, name, df, sent: names.append(name) or held(self, name, df, sent))
    pairs = [(i, (i * 7 + k) % 50) for i in range(50) for k in (1, 3)]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs] + [(b, a, 1.0) for a, b in pairs], "src long, dst long, w double")
    seeds = spark.createDataFrame([(0,), (9,)], "node long")
    found = {r.node: r.score for r in G.personalised_pagerank(edges, seeds).collect()}
    monkeypatch.setattr(G, "NODES_SENT", 10)  # as if nodes were many
    again = {r.node: r.score for r in G.personalised_pagerank(edges, seeds).collect()}
    assert names == ["steps", "steps"] and found.keys() == again.keys() and abs(sum(found.values()) - 1) < 1e-9
    assert all(abs(found[n] - again[n]) < 1e-12 for n in found)
    assert not [1 for r in spark.sparkContext._jsc.getPersistentRDDs().values() if "steps" in r.toString()]
