"""The operators against brute force, and on nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodewell.llm import op1_fingerprints as op1
from lodewell.llm import op2_quality as op2
from lodewell.llm import op3_sharding as op3
from lodewell.llm import op4_tool_calls as op4
from lodewell.llm import op5_decontamination as op5
from lodewell.llm import op6_jaccard as op6
from lodewell.llm import op7_packing as op7
from lodewell.llm import op8_url_filter as op8
from lodewell.llm import op9_toxicity as op9
from lodewell.llm import op10_language as op10
from lodewell.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, score string, size string, bucket string, row string, tile string"
LONG = " ".join(f"word{i % 977} of{i % 13}" for i in range(30_000)) + "\n" + "x" * 50_000
ODD = [
    (1, "The quick brown fox jumps over the lazy dog.", "en"),
    (2, "The quick brown fox jumps over the lazy dog.", "de"),
    (2, "The quick brown fox jumps over the lazy dog.", "de"),  # a repeated row
    (3, None, None),
    (4, "", "en"),
    (5, " \n\t ", None),
    (6, "été ñ 日本語 🙂 <|endoftext|>", "fr"),
    (7, LONG, "en"),
    (None, "no id here at all", "en"),
    (9, "123 ... !!", None),
    (10, "a", "es"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, lang, "s", "x", "y", "z", "r", "t") for i, t, lang in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0, "e"), (2, 0, 1, "e"), (2, 0, 1, "e"), (4, None, None, "e"), (None, 1, 1, "e"), (7, 1, 0, "e"), (77, 1, 0, "e")], "doc_id long, quality int, toxic int, text string")


# --- 1 fingerprints


def test_parse_is_lempel_ziv():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("abç") for _ in range(rng.randint(0, 120)))
        seen, start, expected = set(), 0, []
        for end in range(1, len(text) + 1):
            if text[start:end] not in seen:
                seen.add(text[start:end])
                expected.append(end)
                start = end
        ends = []
        assert (op1.parse(text, set(), ends), ends) == (start, expected)
        own, edited, other = op1.fingerprint_pair(text, "zz" + text)
        assert (op1.encode(own), op1.encode(other)) == (op1.fingerprint(text), op1.fingerprint(edited))


def test_fingerprints_of_neighbours(spark):
    texts = {i: f"text number {i} " * (i % 7) for i in range(40)}
    op1_rows = op1.BUCKET_ROWS
    op1.BUCKET_ROWS = 6
    try:
        rows = {r.doc_id: r for r in op1.neighbour_fingerprints(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    finally:
        op1.BUCKET_ROWS = op1_rows
    assert len(rows) == 40
    for i, text in texts.items():
        cut, following = len(text) // 4, texts[(i + 1) % 40]
        edited = text[: len(text) - cut] + following[:cut]
        r = rows[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (op1.fingerprint(text), op1.fingerprint(edited))
        assert r.near_edited == op1.likeness(op1.decode(r.fingerprint), op1.decode(r.edited_fingerprint))
        assert r.near_next == op1.likeness(op1.decode(r.fingerprint), op1.decode(op1.fingerprint(following)))


def test_fingerprints_of_hashed_ids(spark):
    docs = spark.range(3000).select(F.abs(F.xxhash64("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = {r.doc_id: r for r in op1.neighbour_fingerprints(docs).collect()}
    assert set(rows) == set(texts) and max(texts) > 1 << 53
    ids = sorted(texts)
    for i, following in zip(ids, ids[1:] + ids[:1]):
        edited = texts[i][: len(texts[i]) - len(texts[i]) // 4] + texts[following][: len(texts[i]) // 4]
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()


def test_fingerprints_of_rows_without_id(spark, monkeypatch):
    """A hot id, or none, is dealt over many buckets, and no row is lost."""
    monkeypatch.setattr(op1, "BUCKET_ROWS", 8)
    ids = [None] * 300 + [7] * 300 + [(1 << 62) + i for i in range(300)]
    rows = [(i, f"text {k} " * (k % 5)) for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    dealt = op1.with_next(docs)
    assert dealt.where("own AND doc_id IS NULL").select("bucket").distinct().count() > 20
    assert dealt.where("own").groupBy("bucket").count().agg(F.max("count")).first()[0] < 150
    got = op1.neighbour_fingerprints(docs).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(ids)
    assert collections.Counter((r.doc_id, r.fingerprint) for r in got) == collections.Counter((i, op1.fingerprint(t)) for i, t in rows)


def test_fingerprints_odd(odd, none):
    rows = op1.neighbour_fingerprints(odd).collect()
    assert len(rows) == len(ODD) and len({r.fingerprint for r in rows if r.doc_id in (1, 2)}) == 1
    assert {r.near_next for r in rows if r.doc_id == 3} == {1.0}  # two empty texts
    assert op1.neighbour_fingerprints(none).count() == 0 and op1.fingerprints(odd).count() == len(ODD)


# --- 2 quality


def test_gam_learns_pairs():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = op2.fit_gam(x[:3000], y[:3000])
    assert ((op2.score_gam(model, x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


def test_quality_on_held_out_rows(spark, data):
    rows = {r.doc_id: r for r in op2.query(spark, data.replace("sf0.001", "sf0.01")).collect()}
    held = [(rows[r.doc_id].predicted, r.quality) for r in spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert np.mean([p == q for p, q in held]) > 0.85 and all(0 <= r.score <= 1 for r in rows.values())


def test_quality_odd(odd, none, labels):
    model = op2.fit(odd, labels)
    rows = op2.score(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert op2.fit(none, labels) is None and op2.score(none, None).count() == 0
    assert op2.score(odd, op2.fit(odd, labels.limit(0))).where("score <> 0.5").count() == 0
    assert op2.keep(odd, model, 0.0).count() == len(ODD) and op2.keep(odd, model, 0.0).columns == odd.columns


def plain_gam(x, y, rounds, bins):
    """The additive part again, row by row and cut by cut: cyclic boosting of trees with three leaves."""
    edges = [sorted(set(np.quantile(x[:, j], [k / bins for k in range(1, bins)]))) for j in range(x.shape[1])]
    at = [[sum(v >= e for e in edges[j]) for v in x[:, j]] for j in range(x.shape[1])]
    base = np.log((sum(y) + 0.5) / (len(y) - sum(y) + 0.5))
    z, tables = [base] * len(y), [[0.0] * (len(e) + 1) for e in edges]
    for _ in range(rounds):
        for j, table in enumerate(tables):
            p = [1 / (1 + np.exp(-v)) for v in z]
            best, n = None, len(table)
            for cuts in [(), *itertools.combinations(range(1, n), 1), *itertools.combinations(range(1, n), 2)]:
                parts, total, values = [0, *cuts, n], 0.0, [0.0] * n
                for a, b in zip(parts, parts[1:]):
                    g = sum(y[i] - p[i] for i in range(len(y)) if a <= at[j][i] < b)
                    h = sum(p[i] * (1 - p[i]) for i in range(len(y)) if a <= at[j][i] < b)
                    total += g * g / (h + 1)
                    values[a:b] = [g / (h + 1)] * (b - a)
                if best is None or total > best[0]:
                    best = (total, values)
            for k in range(n):
                table[k] += op2.RATE * best[1][k]
            z = [v + op2.RATE * best[1][at[j][i]] for i, v in enumerate(z)]
    return z


def test_gam_is_cyclic_boosting(monkeypatch):
    """With three bins a tree of three leaves has no choice of order, so the best-first tree is the best one."""
    monkeypatch.setattr(op2, "BINS", 3)
    monkeypatch.setattr(op2, "PAIRS", 0)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 3))
    y = ((x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=80)) > 0).astype(float)
    model = op2.fit_gam(x, y, rounds=12)
    assert np.allclose(op2.score_gam(model, x), 1 / (1 + np.exp(-np.array(plain_gam(x, list(y), 12, 3)))))


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 4))
    model = op2.fit_gam(x, ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float), rounds=30)
    place = lambda edges, v: sum(1 for e in edges if v >= e)
    for row, score in list(zip(x, op2.score_gam(model, x)))[:60]:
        z = model["base"] + sum(t[place(model["edges"][j], row[j])] for j, t in enumerate(model["tables"]))
        z += sum(t[place(model["coarse"][i], row[i]), place(model["coarse"][j], row[j])] for i, j, t in model["pairs"])
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-9
    assert model["pairs"]


def test_features_are_what_they_say():
    text = "Hello, wide  world!\nHello again | 42 été"
    f = dict(zip(op2.FEATURES, op2.features(__import__("pyarrow").array([text]))[0]))
    size, words = len(text.encode()), text.split()
    assert np.isclose(f["upper"], 2 / size) and np.isclose(f["digit"], 2 / size) and np.isclose(f["wide"], 4 / size) and np.isclose(f["bar"], 1 / size)
    assert np.isclose(f["log_words"], np.log1p(len(words))) and np.isclose(f["word_length"], sum(map(len, words)) / len(words))
    assert np.isclose(f["distinct_words"], len(set(words)) / len(words)) and np.isclose(f["top_word"], 1 / len(words))
    assert np.isclose(f["distinct_lines"], 1.0) and np.isclose(f["ended_lines"], 0.5) and np.isclose(f["exclaim_words"], 1 / len(words))


# --- 3 sharding


def test_shards_are_near_equal(spark):
    rng = random.Random(2)
    rows = [(i, "copy of a text " * 5 if i % 3 == 0 else " ".join(rng.choices("abcdefgh", k=rng.randint(1, 80)))) for i in range(6000)]
    got = op3.shard(spark.createDataFrame(rows, "doc_id long, text string"), 24).toPandas()
    held = got.groupby("shard")["size"].sum()
    assert len(held) == 24 and held.max() - held.min() <= 0.03 * held.mean()
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    groups = got.groupby(["text_crc32", "size"])
    assert groups.shard.nunique()[groups["size"].sum() <= held.sum() / 24].max() == 1  # only a group larger than a shard is split
    sizes = {i: len(t.encode()) + 8 for i, t in rows}
    assert all(sizes[d] == s for d, s in zip(got.doc_id, got["size"]))
    assert all(zlib.crc32(rows[d][1].encode()) == c for d, c in zip(got.doc_id, got.text_crc32))


def plain_leaf(tree, row):
    """The leaf of a row, walked node by node."""
    while "cut" in tree:
        key = tuple(row[name] for name, _ in tree["cut"])
        left = key < tuple(value for _, value in tree["cut"]) and row["text_hash"] not in tree["whole"]
        tree = tree["left" if left else "right"]
    return tree["first"]


def test_tree_cuts_at_weighted_medians(spark):
    """Each cut leaves the weight of its leaves on either side, by the widest dimension, and no group that fits is split."""
    rng = random.Random(12)
    texts = [" ".join(rng.choices(["a", "bb", "ccc", "été"], k=rng.randint(1, 60))) + rng.choice(["", "\n"]) for _ in range(700)]
    for k, copies in enumerate((900, 250, 60, 60, 30, 7, 2)):  # the first is larger than a shard
        texts += [f"copied text {k} " * 8] * copies
    rng.shuffle(texts)
    rows = op3.described(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    tree = op3.kd_tree(spark.createDataFrame(rows, op3.described(spark.createDataFrame([(0, "")], "doc_id long, text string")).schema), 8)
    total = sum(r["size"] for r in rows)
    spread = {d: max(r[d] for r in rows) - min(r[d] for r in rows) or 1.0 for d in op3.DIMENSIONS}

    def check(node, held):
        if "cut" not in node:
            return
        widest = max(op3.DIMENSIONS, key=lambda d: (max(r[d] for r in held) - min(r[d] for r in held)) / spread[d])
        assert node["cut"][0][0] == widest
        left = [r for r in held if plain_leaf(node, r) < node["right"]["first"]]
        right = [r for r in held if plain_leaf(node, r) >= node["right"]["first"]]
        wanted = sum(r["size"] for r in held) * (node["leaves"] // 2) / node["leaves"]
        assert abs(sum(r["size"] for r in left) - wanted) <= 0.02 * total / 8
        check(node["left"], left)
        check(node["right"], right)

    check(tree, rows)
    groups = collections.defaultdict(set)
    for r in rows:
        groups[r["text_hash"]].add(plain_leaf(tree, r))
    weight = collections.Counter()
    for r in rows:
        weight[r["text_hash"]] += r["size"]
    assert all(len(s) == 1 for t, s in groups.items() if weight[t] <= total / 8) and any(len(s) > 1 for s in groups.values())
    by_leaf = collections.Counter()
    for r in rows:
        by_leaf[plain_leaf(tree, r)] += r["size"]
    assert len(by_leaf) == 8 and max(by_leaf.values()) - min(by_leaf.values()) <= 0.05 * total / 8


def test_sharding_odd(odd, none):
    got = op3.shard(odd, 4).collect()
    assert len(got) == len(ODD) and {(r.doc_id, r.size) for r in got if r.doc_id in (3, 4)} == {(3, 8), (4, 8)}
    for s, part in itertools.groupby(sorted(got, key=lambda r: r.shard), key=lambda r: r.shard):
        slots = sorted(r.slot for r in part)
        assert slots == list(range(len(slots)))
    assert op3.shard(none, 24).count() == 0


# --- 4 tool calls


def test_calls_are_ordered_and_checked(spark):
    rows = [
        ("c", 0, "call", "a", "reply", '{"turn": 1, "prompt": "' + "p" * 50 + '"}', ["b"], None),
        ("c", 1, "call", "b", "reply", '{"prompt": 5}', [], None),
        ("c", 2, "result", "a", None, None, [], 'say "hi"\n'),
        ("c", 3, "result", "zz", None, None, [], None),
        ("d", 0, "call", "x", "other", "{", ["y"], None),
        ("d", 1, "call", "y", "reply", "not json", ["x"], None),
        (None, None, "call", None, "reply", None, [], None),
        ("c", 2, "result", "a", None, None, [], 'say "hi"\n'),
    ]
    messages = spark.createDataFrame(rows, "conv_id string, turn long, kind string, call_id string, name string, arguments string, needs array<string>, content string").withColumn("role", F.lit("user"))
    got = {(r.conv_id, r.kind, r.call_id): r for r in op4.link(messages).collect()}
    a, b = got["c", "call", "a"], got["c", "call", "b"]
    assert b.position < a.position and (a.status, b.status) == ("linked", "unanswered")
    assert a.problems == "" and b.problems == "prompt:type,turn:missing"
    assert a.line == '{"arguments":{"prompt":"' + "p" * 50 + '","turn":1},"id":"a","name":"reply","type":"call"}'
    assert got["c", "result", "a"].line == '{"content":"say \\"hi\\"\\n","id":"a","type":"result"}'
    assert got["c", "result", "zz"].status == "orphan" and got["c", "result", "zz"].line == '{"content":null,"id":"zz","type":"result"}'
    assert got["d", "call", "x"].status == "cycle" and got["d", "call", "x"].problems == "unknown tool"
    assert got["d", "call", "y"].problems == "not json" and got[None, "call", None].status == "unanswered"
    assert sorted(r.position for r in op4.link(messages).where("conv_id = 'c'").collect()) == list(range(5))


MESSAGES = "conv_id string, turn long, kind string, call_id string, name string, arguments string, needs array<string>, content string, role string"


def test_calls_link_within_their_conversation(spark):
    rows = [("c1", 0, "call", "id1", "reply", "{}", [], None, "user"), ("c2", 0, "result", "id1", None, None, [], "x", "assistant"), (None, 0, "call", "id1", "reply", "{}", [], None, "user")]
    got = {r.conv_id: r for r in op4.link(spark.createDataFrame(rows, MESSAGES)).collect()}
    assert (got["c1"].status, got["c2"].status, got[None].status) == ("unanswered", "orphan", "unanswered") and got[None].position is None


def plain_levels(calls, edges):
    needs = {c: {n for x, n in edges if x == c and n in calls} for c in calls}
    out: dict = {}
    while free := [c for c in calls if c not in out and needs[c] <= out.keys()]:
        for c in free:
            out[c] = max((out[n] + 1 for n in needs[c]), default=0)
    return {c: out.get(c, -1) for c in calls}


def test_levels_are_longest_chains(spark):
    rng = random.Random(13)
    for case in range(3):
        calls = [f"n{i}" for i in range(14)]
        edges = {(rng.choice(calls), rng.choice(calls)) for _ in range(12 + case)} | {("n0", "n1"), ("n1", "n2")}
        if case:  # without cycles
            edges = {(a, b) for a, b in edges if int(a[1:]) < int(b[1:])}
        got = op4.levels(spark.createDataFrame([("c", c) for c in calls], "conv_id string, call_id string"), spark.createDataFrame([("c", a, b) for a, b in edges], "conv_id string, call_id string, need string"))
        assert {r.call_id: r.level for r in got.collect()} == plain_levels(calls, edges)


def test_long_chains_are_no_cycles(spark):
    n = 1500
    calls = spark.range(n).select(F.lit("c").alias("conv_id"), F.col("id").cast("string").alias("call_id"))
    edges = spark.range(n - 1).select(F.lit("c").alias("conv_id"), F.col("id").cast("string").alias("call_id"), (F.col("id") + 1).cast("string").alias("need"))
    got = {int(r.call_id): r.level for r in op4.levels(calls, edges).collect()}
    assert got == {i: n - 1 - i for i in range(n)}


def test_conversations_odd(spark):
    schema = "conv_id long, turn long, role string, text string, call_id string, kind string, level int"
    rows = [(1, 0, "user", "hello", "x", "x", 1), (1, 1, "assistant", None, "x", "x", 1), (1, 1, "assistant", None, "x", "x", 1), (None, None, None, "", "x", "x", 1), (2, 0, "assistant", "é" * 10_000, "x", "x", 1)]
    got = op4.link(op4.from_conversations(spark.createDataFrame(rows, schema))).collect()
    assert len(got) == 5 and sorted(r.status for r in got) == ["linked", "linked", "linked", "message", "orphan"]
    assert op4.link(op4.from_conversations(spark.createDataFrame([], schema))).count() == 0


# --- 5 decontamination


def test_index_finds_all(spark):
    rng = random.Random(3)
    for _ in range(60):
        text = np.array([0] + [rng.choice([0, 1, 1, 2, 3]) for _ in range(rng.randint(1, 70))] + [0])
        index = op5.FMIndex(text)
        found = [[rng.randint(1, 3) for _ in range(rng.randint(1, 4))] for _ in range(15)]
        low, high = index.search(np.array([[0] * (4 - len(p)) + p for p in found]), np.array([len(p) for p in found]))
        for p, a, b in zip(found, low, high):
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(len(text) - len(p) + 1) if text[i : i + len(p)].tolist() == p]


def brute_hits(text, items):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        for i in range(max(1, len(v) - 12) if v else 0):
            window = v[i : i + 13]
            for j in range(len(w) - len(window) + 1):
                if w[j : j + len(window)] == window:
                    hit |= set(range(j, j + len(window)))
                    found.add(item)
    return len(w), len(hit), sorted(found)


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["Ab", "cd", "é1", "x_y", "Zz"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 13, 14, 30])))) for i in range(12)] + [(99, None), (None, "ab")]
    docs = []
    for i in range(40):
        parts = [" ".join(rng.choices(vocabulary + ["other", "more", "..."], k=rng.randint(0, 60)))] + [rng.choice(items)[1] or "" for _ in range(rng.randint(0, 2))]
        docs.append((i, "! ".join(parts)))
    docs += [(40, None), (41, "")]
    tests = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string")
    for blocks in (op5.BLOCK_WORDS, 20):
        got = {r.doc_id: r for r in op5.find(table, tests, block_words=blocks).collect()}
        for i, text in docs:
            n, hit, found = brute_hits(text, [x for x in items if x[0] is not None])
            r = got[i]
            assert (r.n_words, sum(s["end"] - s["first"] for s in r.spans), r.items) == (n, hit, found)
    assert op5.without_spans("one TWO three, four", [(1, 3)]) == "one , four"


def test_decontaminated_rows_without_id(spark):
    tests = spark.createDataFrame([(i, f"a{i} b{i} c{i}") for i in range(20)], "item_id long, text string")
    docs = spark.createDataFrame([(None, "a1 b1 c1 x"), (None, "x y"), (None, None), (1, "a2 b2 c2"), (2, "z"), (3, "")], "doc_id long, text string")
    for blocks in (op5.BLOCK_WORDS, 20):
        assert sorted(map(str, op5.keep(docs, tests, blocks).collect())) == sorted(map(str, docs.where("text IS NULL OR text IN ('x y', 'z', '')").collect()))
    assert len(list(op5.test_blocks(tests, 20))) > 1


def test_blocks_of_tests_do_not_matter(spark, odd, monkeypatch):
    monkeypatch.setattr(op5, "HELD_BYTES", 200)
    tests = spark.createDataFrame([(i, f"w{i} quick brown fox w{i}") for i in range(30)] + [(99, "brown fox jumps over"), (100, "quick brown")], "item_id long, text string")
    whole, parts = (sorted((str(r.doc_id), r.n_words, str(r.spans), str(r.items)) for r in op5.find(odd, tests, block_words=b).collect()) for b in (op5.BLOCK_WORDS, 5))
    assert whole == parts and sorted(map(str, op5.keep(odd, tests).collect())) == sorted(map(str, op5.keep(odd, tests, 5).collect()))


def test_decontamination_odd(spark, odd, none):
    tests = spark.createDataFrame([(1, "quick brown fox"), (1, "quick brown fox"), (2, ""), (3, None)], "item_id long, text string")
    rows = op5.find(odd, tests).collect()
    assert len(rows) == len(ODD) and sum(bool(r.items) for r in rows) == 3
    assert op5.keep(odd, tests).count() == len(ODD) - 3 and op5.keep(odd, tests).columns == odd.columns
    assert op5.find(none, tests).count() == 0 and op5.keep(odd, tests.limit(0)).count() == len(ODD)


# --- 6 Jaccard join


def brute_classes(rows, words, percent):
    parent, sets = {}, []

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        s = {tuple(w[j : j + words]) for j in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
        parent[i] = i
        for k, t in sets:
            if 100 * len(s & t) >= percent * len(s | t) > 0:
                a, b = root(i), root(k)
                parent[max(a, b)] = min(a, b)
        sets.append((i, s))
    return {i: (len(s), root(i)) for i, s in sets}


def near_copies(rng, families):
    vocabulary, out = [f"W{i}" for i in range(50)], ["", None, "  ", "A b", "a B"]
    for _ in range(families):
        base = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 5, 9, 20, 60, 200]))
        for _ in range(rng.randint(1, 12)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                at = rng.randrange(len(words))
                words[at : at + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 2)
                words = words or ["w"]
            out.append(" ".join(words))
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("words,percent,small", [(3, 90, False), (5, 80, False), (3, 90, True)])
def test_classes_match_brute_force(spark, monkeypatch, words, percent, small):
    if small:  # many tiles
        monkeypatch.setattr(op6, "MAP_TILE", (6, 2000))
        monkeypatch.setattr(op6, "SET_TILE", (4, 300))
    rows = near_copies(random.Random(5), 30)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op6.classes(spark.createDataFrame(rows, "doc_id long, text string"), words, percent).collect()}
    assert got == brute_classes(rows, words, percent)


def test_keep_one_of_shared_ids(spark):
    words = [f"w{i}" for i in range(60)]
    base, near, other, third = " ".join(words), " ".join(words[:-1]), " ".join(words[::-1]), " ".join(words[::2] + words[1::2])
    rows = [(1, base), (5, base), (5, other), (6, third), (6, third + " x"), (None, near), (None, "one two three four five six"), (None, "ONE two three four five six"), (7, ""), (7, ""), (8, None), (9, base)]
    got = [(r.doc_id, r.text) for r in op6.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == 6 and {(1, base), (5, other), (7, ""), (8, None), (None, "ONE two three four five six")} <= set(got)
    assert len([t for i, t in got if i == 6]) == 1


def test_components_of_long_paths(spark):
    edges = spark.range(3000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(9000, 9001)], "a long, b long"))
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(3001)} | {9000: 9000, 9001: 9000}


def test_keep_one_with_clashing_columns(spark):
    words = " ".join(f"w{i}" for i in range(40))
    schema = "doc_id long, text string, _hashed_id string, _set string, _owner string, _stays long, _row string, root long, set_id long, `a.b` string"
    rows = [(1, words, "h", "s", "o", 1, "r", 5, 6, "x"), (2, words, "h", "s", "o", 1, "r", 5, 6, "y"), (None, words, "h", "s", "o", 1, "r", 5, 6, "z"), (None, None, "h", "s", "o", 1, "r", 5, 6, "z"), (3, "", "h", "s", "o", 1, "r", 5, 6, "z")]
    docs = spark.createDataFrame(rows, schema)
    kept = op6.keep_one(docs)
    assert kept.columns == docs.columns and sorted(map(str, (tuple(r) for r in kept.collect()))) == sorted(map(str, [rows[0], rows[3], rows[4]]))


def test_classes_odd(odd, none):
    got = op6.classes(odd).collect()
    assert len(got) == len(ODD) and {r.component_id for r in got if r.doc_id in (1, 2)} == {1}
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id in (3, 4, 5)} == {(3, 0, 3), (4, 0, 4), (5, 0, 5)}
    kept = op6.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 9, 10]
    assert op6.classes(none).count() == 0 and op6.keep_one(none).count() == 0


# --- 7 packing


def test_ids_equal_those_of_tokenizers(spark, data):
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    encode = op7.encoder(op7.vocabulary_path())
    texts = [r.text for r in spark.read.parquet(data + "/documents.parquet").collect()] + [t or "" for _, t, _ in ODD] + ["  a  \n\n b\t", "it's I'LL", " x　", "ﬁ①½", "0123 4567"]
    assert [encode(t) for t in texts] == [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]


def test_best_fit_is_best_fit():
    rng = random.Random(6)
    for _ in range(100):
        lengths = {rng.randint(1, 50): rng.randint(1, 20) for _ in range(rng.randint(1, 25))}
        held = collections.defaultdict(list)
        for length, first, end, each, window, offset in op7.best_fit(lengths, 50):
            for k in range(first, end):
                held[window + (k - first) // each].append((offset + (k - first) % each * length, length))
        windows = []
        for length in sorted((n for n, c in lengths.items() for _ in range(c)), reverse=True):
            fits = [r for r in windows if r >= length]
            if fits:
                windows.remove(min(fits))
            windows.append((min(fits) if fits else 50) - length)
        assert sorted(windows) == sorted(50 - sum(n for _, n in x) for x in held.values())
        assert sum(map(len, held.values())) == sum(lengths.values()) and sorted(held) == list(range(len(held)))


def check_packed(rows, texts, window):
    encode = op7.encoder(op7.vocabulary_path())
    expected = collections.Counter()
    for i, text in texts:
        ids = np.array([*encode(text or ""), 1], "<u4")
        for start in range(0, len(ids), window):
            expected[i, start, len(ids[start : start + window]), zlib.crc32(ids[start : start + window].tobytes()), len(ids)] += 1
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == expected
    for s, part in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in part:
            assert r.offset == at
            at += r.length
        assert at <= window


def test_packing(spark, data, odd, none):
    docs = spark.read.parquet(data + "/documents.parquet")
    check_packed(op7.pack(docs.repartition(5), op7.vocabulary_path(), 256).collect(), [(r.doc_id, r.text) for r in docs.collect()], 256)
    check_packed(op7.pack(odd, op7.vocabulary_path()).collect(), [(i, t) for i, t, _ in ODD], 2048)
    assert op7.pack(none, op7.vocabulary_path()).count() == 0


# --- 8 URL filter


def test_rules_and_propagation(spark):
    pages = spark.createDataFrame(
        [
            (1, "https://a.EXAMPLE.net/en/x?y", None, "e"),
            (2, "http://example.net/de/", "", "e"),
            (3, "http://notexample.com/de/", "", "e"),
            (4, "http://x.example.com/de/1#z", "", "e"),
            (5, "http://q.org/fr/", "", "e"),
            (6, "nonsense", "", "e"),
            (7, None, None, "e"),
            (8, "http://bad.net", "", "e"),
            (9, "http://links.com/a", '<a href="http://spam.net/">x</a><A HREF=//spam.net/b>', "e"),
            (10, "http://spam.net/", "", "e"),
            (10, "http://spam.net/", "", "e"),
            (11, "http://good.com/", "<a href='http://q.org/fr/'>", "e"),
        ],
        "page_id long, url string, html string, host string",
    )
    got = {r.page_id: r for r in op8.judge(pages).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in (1, 2, 4, 5)] == [
        ("a.example.net", "/en/x", "example.net/en/", "allow"),
        ("example.net", "/de/", "net/", "block"),
        ("x.example.com", "/de/1", "example.com/de/", "block"),
        ("q.org", "/fr/", "org/fr/", "allow"),
    ]
    assert got[3].rule is None and got[8].rule is None and (got[6].host, got[7].path) == ("", "")
    assert got[9].distrust > got[11].distrust == 0 and op8.judge(pages, threshold=0.2).where("page_id = 9").first().verdict == "block"
    assert op8.judge(pages).count() == 12 and op8.judge(pages.limit(0)).count() == 0


def test_propagation_is_power_iteration(spark):
    rng = np.random.default_rng(9)
    links = [(f"h{a}", f"h{b}", int(w)) for a, b, w in zip(rng.integers(0, 12, 30), rng.integers(0, 12, 30), rng.integers(1, 4, 30)) if a != b]
    links = [(a, b, sum(w for x, y, w in links if (x, y) == (a, b))) for a, b in sorted({(a, b) for a, b, _ in links})]
    seeds = [(f"h{i}", float(i % 3), float(i % 2), float(i % 5 == 0)) for i in range(12)]
    weight = np.zeros((12, 12))
    for a, b, w in links:
        weight[int(a[1:]), int(b[1:])] = w
    forward = weight / np.maximum(weight.sum(axis=1, keepdims=True), 1)
    backward = weight.T / np.maximum(weight.sum(axis=0)[:, None], 1)
    # a host without links of a direction keeps that mass
    forward, backward = (m + np.diag((m.sum(axis=1) == 0).astype(float)) for m in (forward, backward))
    expected = []
    for column, steps in ((1, forward), (2, forward), (3, backward)):
        base = (1 - op8.FOLLOW) * np.array([s[column] for s in seeds])
        expected.append(np.linalg.solve(np.eye(12) - op8.FOLLOW * steps.T, base))
    got = op8.propagate(spark.createDataFrame(seeds, "host string, trust double, neutral double, distrust double"), spark.createDataFrame(links, "src string, dst string, links long"), 1e-9)
    found = {r.host: (r.trust, r.neutral, r.distrust) for r in got.collect()}
    assert np.allclose([found[f"h{i}"] for i in range(12)], np.array(expected).T, atol=1e-6)
    assert np.isclose(sum(map(sum, found.values())), sum(sum(x[1:]) for x in seeds))


def test_verdicts_match_sql(spark):
    """Pages that link across hosts: what the query says, by the SQL's own recursion."""
    rng = random.Random(14)
    hosts = ["a.net", "b.net", "x.example.net", "y.example.com", "q.org", "k.com", "l.com", "m.io", "n.io", "Bad.NET"]
    rows = []
    for i in range(120):
        html = "".join(rng.choice([f"<a href='http://{h}/x'>", f'<A HREF="//{h}">', "<a href=/local>"]) for h in rng.choices(hosts, k=rng.randint(0, 3)))
        rows.append((i, f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/de/x', '/fr/?q', '?a://b', '#f'])}", rng.choice([html, html, html, None])))
    rows += [(200, None, None), (201, "no scheme", ""), (202, "", None), (203, "http://s.io", "<a href='http://z.net/'>")] + [(300 + i, "http://z.net/", "") for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    with duckdb.connect() as db:
        db.register("pages", pages.toArrow())
        expected = sorted(db.sql(op8.ORACLE_SQL).fetchall())
    got = sorted(tuple(r) for r in op8.judge(pages).select("page_id", "host", "path", "rule", "verdict").collect())
    assert got == expected and {r[4] for r in got if r[3] is None} == {"allow", "block"}


# --- 9 toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_automaton_is_edit_distance():
    rng, terms = random.Random(7), ["idiot", "clown", "moron", "abcab", "abcde", "abc"]
    machine = op9.automaton(terms)
    for _ in range(1500):
        word = list(rng.choice(terms))
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randint(0, 1)] = rng.choices("abcdo1", k=rng.randint(0, 1))
        word = "".join(word)
        best = min((d for t in terms if (d := distance(word, t)) == 0 or (d == 1 and len(t) >= 5)), default=None)
        hit, state = op9.matches(op9.Words([word]), machine)
        assert (int(machine["errors"][state[0]]) if len(hit) else None) == best


def toxic_corpus(spark):
    rng = random.Random(8)
    clean = [f"w{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(800):
        words, toxic = rng.choices(clean, k=40), i % 4 == 0
        for _ in range(rng.randint(1, 3) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["scoundrel", "blackguard", "villain"]))
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")


def test_toxicity_tells_quotes_and_typos(spark):
    model = op9.fit(*toxic_corpus(spark))
    assert set(model["terms"]) >= {"scoundrel", "blackguard", "villain"}
    used, typo, quote, clean, empty = op9.scores(["you Scoundrel, w1", "you sc0undrel w1 w2", 'he wrote "villain" w1', "w1 w2 w3", None], model)
    assert used > 0.5 and typo >= 0.3 and quote < 0.3 and clean < 0.1 and empty == clean


def test_toxicity_keeps_every_term(spark):
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    terms, clean = sorted({letters(9) for _ in range(600)}), [letters(8) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(clean, k=20))) for i in range(900)]
    for i in range(300):  # each term is in ten texts, after ten different words
        words = [w for t in terms[i % 30 :: 30] for w in (rng.choice(clean), t)]
        rows.append((1000 + i, " ".join(words)))
    model = op9.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i >= 1000)) for i, _ in rows], "doc_id long, toxic int"))
    assert set(terms) <= set(model["terms"]) and len(terms) > op9.TERMS
    scores = op9.scores([f"{clean[0]} {t} {clean[1]}" for t in terms] + [f"{t[:4]}1{t[5:]}" for t in terms], model)
    assert (scores >= op9.THRESHOLD).all()


def test_several_automata_are_one(monkeypatch):
    rng, terms = random.Random(10), ["idiot", "idiots", "clown", "moron", "abcab", "abcde", "abc"]
    texts = [" ".join(w[: (k := rng.randrange(len(w)))] + rng.choice(["", "x", w[k]]) + w[k + 1 :] for w in rng.choices(terms, k=8)) for _ in range(300)]
    whole = op9.hit_counts(texts, op9.automata(terms, 3), {"abcd"})
    monkeypatch.setattr(op9, "TERMS", 2)
    parts = op9.hit_counts(texts, op9.automata(terms, 3), {"abcd"})
    assert len(op9.automata(terms, 3)) == 4 and (whole[0] == parts[0]).all() and whole[1] == parts[1]


def plain_counts(text, terms, strong, innocent):
    """Kinds of hits in a text, word by word: strong, weaker or misspelled, quoted, and near another hit."""
    spans = []
    for run in re.finditer(r"\S+", text.lower()):
        inner = [k for k, c in enumerate(run[0]) if c.isalnum()]
        if inner:
            word = run[0][inner[0] : inner[-1] + 1]
            spans.append((word, any(c in op9._QUOTES for c in run[0][: inner[0]]), any(c in op9._QUOTES for c in run[0][inner[-1] + 1 :])))
    out, before = [0, 0, 0, 0], None
    for i, (word, _, _) in enumerate(spans):
        near = [(distance(word, t), t not in strong) for t in terms if word == t or (len(t) >= op9.FUZZY_LENGTH and distance(word, t) == 1)]
        if not near or (min(near)[0] and word in innocent):
            continue
        kind = 1 if min(near)[0] else int(min(near)[1])
        opened = any(spans[j][1] and not any(spans[k][2] for k in range(j, i)) for j in range(max(0, i - op9.CONTEXT), i + 1))
        closed = any(spans[j][2] and not any(spans[k][1] for k in range(i + 1, j + 1)) for j in range(i, min(len(spans), i + op9.CONTEXT + 1)))
        out[2 if opened and closed else kind] += 1
        out[3] += before is not None and i - before <= op9.CONTEXT
        before = i
    return out


def test_counts_match_brute_force():
    rng, terms = random.Random(15), ["villain", "scoundrel", "rogue", "cad", "blackguard"]
    machines, innocent = op9.automata(terms, 3), {"rogued"}
    fill = ["and", "the", "rogued", "vilain", "scoundrels", "c4d", "Rogue!", '"villain"', '"he', 'said"', "blackguard,", "--", "'cad'", "blackgard", "VILLAIN"]
    texts = [" ".join(rng.choices(fill, k=rng.randint(0, 25))) for _ in range(150)]
    assert op9.hit_counts(texts, machines, innocent)[0].tolist() == [plain_counts(t, terms, terms[:3], innocent) for t in texts]


def test_lexicon_matches_brute_force(spark):
    docs, marks = toxic_corpus(spark)
    rows = docs.join(marks, "doc_id").select("doc_id", "text", F.col("toxic").alias("y")).collect()
    support, clean = collections.defaultdict(set), collections.Counter()
    toxic = collections.Counter()
    for r in rows:
        words = r.text.lower().split()
        for w, p in zip(words, ["", *words]):
            if r.y:
                support[w].add(p)
        (toxic if r.y else clean).update(set(words))
    n_toxic, share = sum(r.y for r in rows), sum(r.y for r in rows) / len(rows)
    expected = set()
    for w in {*toxic, *clean}:
        s, c = min(len(support[w]), toxic[w]), clean[w]
        if s >= 3 and s * (1 - share) > 4 * c * share and c < s and len(w) >= 3:
            evidence = s * np.log(s / ((s + c) * share)) + (c * np.log(c / ((s + c) * (1 - share))) if c else 0)
            if evidence > 1 + np.log(max(2, len({*toxic, *clean}))):
                expected.add(w)
    sample = spark.createDataFrame([(r.doc_id, r.text, r.y) for r in rows], "doc_id long, text string, y int")
    assert set(op9.lexicon(sample, n_toxic, len(rows) - n_toxic)[0]) == expected


def test_toxicity_odd(odd, none, labels):
    model = op9.fit(odd, labels)
    assert op9.score(odd, model).count() == len(ODD) and op9.keep(odd, model).columns == odd.columns
    assert op9.score(none, op9.fit(none, labels)).count() == 0 and op9.fit(odd, labels.limit(0))["terms"] == []


# --- 10 language


def test_language(spark, data):
    path = data.replace("sf0.001", "sf0.01")
    rows = {r.doc_id: r for r in op10.query(spark, path).collect()}
    docs = spark.read.parquet(path + "/documents.parquet").select("doc_id", "lang").collect()
    held = [rows[d.doc_id].lang_pred == d.lang for d in docs if rows[d.doc_id].held_out]
    assert np.mean(held) > 0.97


def plain_grams(text):
    """Counts of the hashed 1- to 3-grams of a text's bytes, one by one."""
    a = [c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 0 for c in text.encode()]
    out, top = np.zeros(op10.DIM, int), lambda v: ((v * 2654435761) % (1 << 32)) >> 20
    for i, x in enumerate(a):
        if x:
            out[top(x)] += 1
        if i + 1 < len(a) and (x or a[i + 1]):
            out[top(x * 257 + a[i + 1] + (1 << 17))] += 1
        if i + 2 < len(a) and a[i + 1] and (x or a[i + 2]):
            out[top((x * 66049 + a[i + 1] * 257 + a[i + 2] + (1 << 26)) % (1 << 32))] += 1
    return out


def test_language_is_nearest_centroid(spark):
    texts = ["the cat sat on the mat", "a dog and the cat", "le chat est sur la table", "un chien et le chat", "der Hund ist auf dem Tisch", "", "été à Paris", "xyz"]
    assert (op10.gram_counts(__import__("pyarrow").array(texts)) == np.array([plain_grams(t) for t in texts])).all()
    langs = ["en", "en", "fr", "fr", "de"]
    model = op10.fit(spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(zip(texts, langs))], "doc_id long, text string, lang string"))
    df = sum((plain_grams(t) > 0).astype(int) for t in texts[:5])
    idf = np.log(6 / (1 + df)) + 1
    assert np.allclose(model["idf"], idf, rtol=1e-5)
    got = op10.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in got:
        v = np.sqrt(plain_grams(texts[r.doc_id])) * idf
        cosine = [float(v @ c) / max(np.linalg.norm(v) * np.linalg.norm(c), 1e-12) for c in model["centers"]]
        if texts[r.doc_id]:
            assert r.lang_pred == model["langs"][model["of"][int(np.argmax(cosine))]] and abs(r.score - max(cosine)) < 1e-3
    assert [r.lang_pred for r in got][:6] == [*langs, "und"]


def test_no_language_is_lost(spark, monkeypatch):
    monkeypatch.setattr(op10, "SAMPLE", 20)
    rows = [(i, f"text {i} of language {i % 60}", f"l{i % 60}") for i in range(300)] + [(None, "same", "l0")] * 400
    model = op10.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model["langs"] == sorted({lang for _, _, lang in rows}) and len(model["centers"]) <= 4 * 60


def test_language_odd(odd, none):
    model = op10.fit(odd.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang"))
    got = {r.doc_id: r for r in op10.predict(odd, model).collect()}
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {3, 4, 5, 9} and got[6].lang_pred in model["langs"]
    assert op10.predict(none, model).count() == 0
    nothing = op10.fit(none.select("doc_id", "text", "lang"))
    assert {r.lang_pred for r in op10.predict(odd, nothing).collect()} == {"und"}
