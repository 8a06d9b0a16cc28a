"""Operators that SQL cannot state, against brute force or worked examples."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lodewell.functions import scoring as S
from lodewell.functions import text as T
from lodewell.operators import entities as E
from lodewell.operators import graph as G
from lodewell.operators import lifecycle as L
from lodewell.operators import mining as M
from lodewell.operators import relational as R
from lodewell.operators import retrieval as X
from lodewell.operators import temporal as P


def one(spark, value):
    return spark.range(1).select(value.alias("v")).first().v


def test_text_functions(spark):
    assert one(spark, T.slug(F.lit("  Hello, World! é  "))) == "hello-world"
    assert one(spark, T.wikilinks(F.lit("[[A|b]] x [[C#d|e]] [[ F ]]"))) == ["A", "C", "F"]
    assert one(spark, T.bigrams(F.array(*map(F.lit, "abab")))) == ["a b", "b a"]
    assert one(spark, T.bigrams(F.array(F.lit("a")))) == []
    assert [s for s in one(spark, T.sentences(F.lit("First one here. Second one there! no split. Ok")))] == ["First one here.", "Second one there! no split."]
    assert one(spark, T.code_references(F.lit("[[code:s:a/b.py:f]]")))[0].asDict() == {"slug": "s", "path": "a/b.py", "name": "f"}
    assert one(spark, F.lit("a/b/c.md").rlike(T.glob_pattern("**/*.md"))) and not one(spark, F.lit("a/b/c.md").rlike(T.glob_pattern("*.md")))
    assert one(spark, T.structural(F.lit("On 2024-01-02 at 10:30 the 5 cats"))) == ["on", "date", "at", "time", "num", "cats"]


def test_validity_and_rescue(spark):
    states = [one(spark, S.validity_state(S.validity(F.lit(2.0), F.lit(float(b))))) for b in (1, 2, 3)]
    assert states == ["fresh", "stale", "quarantined"]
    assert one(spark, S.half_up(F.lit(2.5))) == 3 and one(spark, S.rrf(F.lit(1))) == pytest.approx(1 / 61)


def test_parse_ranking():
    assert X.parse_ranking("[2, 1, 3]", 3) == [1, 0, 2]
    assert X.parse_ranking("the order is [3,1] I think", 3) == [2, 0, 1]
    assert X.parse_ranking("nothing", 3) == [0, 1, 2] and X.parse_ranking('{"ranking": [2, 2, 9]}', 2) == [1, 0]


def test_mmr_is_greedy(spark):
    rows = [("q", i, 1.0 - i / 10, ts) for i, ts in enumerate([["a", "b"], ["a", "b"], ["c"], ["a"]])]
    got = X.mmr(spark.createDataFrame(rows, "q string, id long, score double, tokens array<string>"), "q", "id", 3)
    assert [r.id for r in got.orderBy("place").collect()] == [0, 2, 3]


def test_overlap_pairs_of_families_are_exact_and_common_items_bring_no_pair(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(X, "TILE_ITEMS", 200)  # several tiles a family
    common = list(range(40))
    sets = [(i, common + rng.sample(range(1000, 1 << 40), 40)) for i in range(30)]  # alike in common items alone
    for f in range(3):
        base = rng.sample(range(1000, 1 << 40), 60)
        sets += [(100 * (f + 1) + i, rng.sample(base, 60 - rng.randint(0, 7))) for i in range(20)]
    sets += [(1000 + i, s) for i, s in sets[:5]]  # copies
    unique = {}
    for i, s in sets:
        unique.setdefault(frozenset(s), i)
    expected = {(min(i, j), max(i, j)) for s, i in unique.items() for t, j in unique.items() if i != j and 100 * len(s & t) >= 85 * len(s | t)}
    rows = spark.createDataFrame(sets, "id long, items array<long>")
    assert {(r.a, r.b) for r in X.overlap_pairs(rows, "id", 0.85).collect()} == expected and len(expected) > 100
    own = rows.selectExpr("id", "cast(size(items) as long) n", "xxhash64(array_sort(items)) h", "array_sort(items) items")
    filed = X._rarest(own.where("id < 30"), "id", 85).collect()
    assert len(filed) == 30 * 13 and not {r.signature for r in filed} & set(common)


def test_no_row_holds_the_sets_or_the_pairs_of_a_tile(spark):
    sets = [(i, [*range(30), 100 + i]) for i in range(25)]  # each alike to each other
    found = X.overlap_pairs(spark.createDataFrame(sets, "id long, items array<long>"), "id", 0.85)
    assert {(r.a, r.b) for r in found.collect()} == {(i, j) for i in range(25) for j in range(i + 1, 25)}
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_overlap_and_edit_pairs_match_brute_force(spark):
    rng = random.Random(1)
    sets = [(i, rng.sample("abcdefghij", rng.randint(0, 6))) for i in range(40)]
    unique = {}
    for i, s in sets:
        if s:
            unique.setdefault(frozenset(s), i)
    expected = {(min(i, j), max(i, j)) for s, i in unique.items() for t, j in unique.items() if i != j and len(s & t) / len(s | t) >= 0.5}
    got = X.overlap_pairs(spark.createDataFrame(sets, "id long, items array<string>"), "id", 0.5).collect()
    assert {(r.a, r.b) for r in got} == expected
    names = sorted({"".join(rng.choices("abc", k=rng.randint(1, 7))) for _ in range(60)})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    got = X.edit_pairs(spark.createDataFrame([("g", n) for n in names], "g string, name string"), "g", "name", 2).collect()
    assert {(r.a, r.b, r.distance) for r in got} == {(a, b, distance(a, b)) for a in names for b in names if a < b and distance(a, b) <= 2}


def test_simhash_bands_find_all(spark):
    rng = random.Random(2)
    prints = [rng.getrandbits(63) for _ in range(30)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(62), rng.randint(1, 5))) for p in prints]
    got = X.hamming_pairs(spark.createDataFrame(list(enumerate(prints)), "id long, simhash long"), "id", 3).collect()
    assert {(r.a, r.b) for r in got} == {(i, j) for i in range(60) for j in range(i + 1, 60) if 0 < bin(prints[i] ^ prints[j]).count("1") <= 3}


def test_graph_algorithms_match_brute_force(spark):
    rng = random.Random(3)
    pairs = {(rng.randrange(60), rng.randrange(60)) for _ in range(70)}
    edges = spark.createDataFrame(sorted((a, b) for a, b in pairs if a != b), "src long, dst long")
    forward = {i: {b for a, b in pairs if a == i != b} for i in range(60)}

    def reachable(i):
        seen, stack = {i}, [i]
        while stack:
            for j in forward[stack.pop()] - seen:
                seen.add(j)
                stack.append(j)
        return seen

    reach = {i: reachable(i) for i in range(60)}
    expected = {i: min(j for j in reach[i] if i in reach[j]) for i in range(60) if any(j != i and i in reach[j] for j in reach[i])}
    assert {r.node: r.component for r in G.strong_components(edges).collect()} == expected
    both = {i: forward[i] | {a for a in range(60) if i in forward[a]} for i in range(60)}
    found = {r.node: r.component for r in G.components(edges).collect()}
    for i in found:
        assert all(found[j] == found[i] for j in both[i]) and found[i] <= i
    hops = {r.node: r.hops for r in G.reach(edges, spark.createDataFrame([(0,)], "node long"), 60).collect()}
    assert set(hops) == reach[0]


def test_calls_are_of_all_lines(spark, tmp_path):
    from lodewell.queries import graphs

    lines = [(i % 40 + 1, i * 7 % 200 + 1) for i in range(500)]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 1, "O", "5-LOW")], "o_custkey long, o_orderkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    expected = {(a, b % 40 + 1) for a, b in lines if a != b % 40 + 1}
    assert {(r.src, r.dst) for r in graphs.calls(spark, str(tmp_path)).collect()} == expected
    assert graphs.personalised_pagerank(spark, str(tmp_path)).count() > 0
    assert graphs.louvain_communities(spark, str(tmp_path)).agg(F.sum("size")).first()[0] == len({n for e in expected for n in e})


def test_pagerank_keeps_mass_on_a_cycle(spark):
    edges = spark.createDataFrame([(i, (i + 1) % 3, 1.0) for i in range(3)] + [((i + 1) % 3, i, 1.0) for i in range(3)], "src long, dst long, w double")
    scores = {r.node: r.score for r in G.personalised_pagerank(edges, spark.createDataFrame([(0,)], "node long")).collect()}
    assert 0.9 < sum(scores.values()) <= 1.0001 and scores[0] > scores[1] == pytest.approx(scores[2])
    assert G.personalised_pagerank(edges, spark.createDataFrame([(9,)], "node long")).count() == 0


def test_louvain():
    clique = lambda nodes, w: [(a, b, w) for a in nodes for b in nodes if a < b]
    found, q = G.louvain(list(range(9)), clique(range(4), 3.0) + clique(range(4, 8), 3.0) + [(0, 4, 1.0), (1, 99, 5.0), (2, 3, -1.0)])
    assert [found[i] for i in range(9)] == [0] * 4 + [4] * 4 + [8] and q > 0.3
    assert G.louvain([1, 2], []) == ({1: 1, 2: 2}, 0.0)


def test_co_recall(spark):
    events = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "b"])], "event_id long, paths array<string>")
    got = {(r.src, r.dst): r.w for r in G.co_recall(events).collect()}
    assert got["a", "b"] == got["b", "a"] == 2.0 and got["a", "c"] == 1.0
    assert all(len([k for k in got if k[0] == n]) <= 2 for n in "abc")


def test_supersession(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    facts = spark.createDataFrame([("s", "p", o, day(n), n) for n, o in ((1, "A"), (2, "A"), (3, "B"), (5, "A"))], "subject string, predicate string, object string, valid_from timestamp, key long")
    got = {r.key: (r.object, r.valid_to, r.superseded_by, r.supersedes) for r in P.superseded(facts).collect()}
    assert got == {1: ("A", day(3), 3, None), 3: ("B", day(5), 5, 1), 5: ("A", None, None, 3)}
    at = lambda n: {r.object for r in P.superseded(facts).where(P.valid_at(F.lit(day(n)), F.col("valid_from"), F.col("valid_to"))).collect()}
    assert at(1) == {"A"} and at(3) == {"B"} and at(4) == {"B"} and at(9) == {"A"}
    texts = spark.createDataFrame([("Ann is now the tech lead of Search. The Berlin office moved to Mitte",), ("nothing",)], "t string")
    assert {(r.predicate, r.subject, r.object) for r in P.extract_facts(texts, "t").collect()} == {("tech_lead_of", "Search", "Ann"), ("office_location", "Berlin", "Mitte")}


def test_relational_edges(spark):
    notes = spark.createDataFrame([("a/x.md",), ("b/x.md",), ("c.md",)], "path string")
    links = spark.createDataFrame([(1, "x"), (2, "b/x"), (3, "nope"), (4, "/c/")], "id long, target string")
    assert {r.id: r.resolved for r in R.resolve_links(links, notes).collect()} == {1: "a/x.md", 2: "b/x.md", 3: None, 4: "c.md"}
    rows = spark.createDataFrame([(1, "en", ["a"], "2024-05-05", False), (2, "de", ["b"], None, False), (3, "en", ["a"], "2024-06-06", True)], "id long, collection string, tags array<string>, date string, archived boolean")
    keep = lambda **k: {r.id for r in R.search_filter(rows, **k).collect()}
    assert keep() == {1, 2} and keep(since="2024-01-01") == {1} and keep(tags=["a"], include_archived=True) == {1, 3}
    assert one(spark, R.merged_tags(F.array(F.lit("AI"), F.lit("ml"), F.lit("x")), {"ai": "ml"})) == ["ml", "x"]


def test_lifecycle(spark):
    assert one(spark, L.promoted(F.array(*map(F.lit, [1, 1, 2])))) == pytest.approx(2.0)
    assert one(spark, L.changed(F.lit("promote"), F.lit(14))) == 16
    name, source = L.category(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("x/decisions/y"), F.lit(""))
    assert (one(spark, name), one(spark, source)) == ("decision", "path")


def test_mining(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "user", "b"), (1, 3, "assistant", "c"), (1, 4, "assistant", "d")], "conv_id long, turn long, role string, text string")
    assert [(r.turn, r.user_text, r.assistant_text) for r in M.turn_pairs(turns).orderBy("turn").collect()] == [(1, "a", None), (2, "b", "c")]
    texts = spark.createDataFrame([(1, "I really like strong black tea. We never deploy on a Friday. Dr Ann Lee said hello to Acme Widgets Inc")], "id long, text string")
    assert {(r.kind, r.phrase) for r in M.preferences(texts, ["id"], "text").collect()} == {("preference", "strong black tea"), ("convention", "deploy on a Friday")}
    said = spark.createDataFrame([(1, "We decided to wait a while. The bug is back again today! Nothing else to say here.")], "id long, text string")
    assert {(r.category, r.sentence) for r in M.memories(said, ["id"], "text").collect()} == {("decision", "We decided to wait a while."), ("problem", "The bug is back again today!")}
    assert {(r["name"], r["type"]) for r in E.entities(texts, "id", "text").collect()} >= {("Ann Lee", "person"), ("Acme Widgets", "organization")}
    found = E.entities(texts, "id", "text")
    assert M.registry(found, "id").where("name = 'ann lee'").first().occurrences == 1 and M.mention_edges(found, "id").count() >= 1
    assert one(spark, M.symbol_id(*[F.lit(x) for x in ("r", "p", "n", "k")], F.lit("  "))) == one(spark, M.symbol_id(*[F.lit(x) for x in ("r", "p", "n", "k")], F.lit(None).cast("string")))
