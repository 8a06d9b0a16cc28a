"""Importance resampling, ranked search and token files against brute force and SQL, and on odd rows."""

import glob
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodewell.llm import op11_importance as op11
from lodewell.llm import op12_search as op12
from lodewell.llm import op13_token_files as op13

SCHEMA = "doc_id long, text string, lang string, at long, part string, rank string, _place string, salt string, n_terms string"
LONG = " ".join(f"Word{i % 977} of{i % 13}" for i in range(20_000)) + "\n" + "x" * 50_000
ODD = [
    (1, "The quick brown fox jumps over the lazy dog. The quick brown fox sleeps, and the lazy dog jumps over the quick brown fox again and again."),
    (2, "a fox, a fox; the FOX and the dog " * 4),
    (2, "a fox, a fox; the FOX and the dog " * 4),  # a repeated row
    (2, "another text of the same id, about a dog and a fox and what they do all day long in the old garden behind the house"),
    (3, None),
    (4, ""),
    (5, " \n\t .,;"),
    (6, "été Ñandú 日本語 🙂 <|endoftext|> don't T̈ x'S O'LL"),
    (7, LONG),
    (None, "no id here, but a fox and a dog and so many other words that this text has more than twenty of them in all, I say"),
    (9, "123 ... !! fox"),
    (-4, "fox"),
    (11, "fox"),
    (12, "Fox"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", 1, "p", "r", "x", "s", "n") for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def key(row):
    return tuple((v is None, v) for v in row)


def duck(data, sql):
    made = duckdb.connect()
    for name in ("documents", "benchmark"):
        made.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{data}/{name}.parquet')")
    return made.sql(sql).to_arrow_table().to_pylist()


def same(got, expected):
    names = sorted(expected[0])
    return sorted((key(r[n] for n in names) for r in got)) == sorted(key(r[n] for n in names) for r in expected)


# --- 11 importance


def importance(docs, target, percent=25, seed=7, buckets=10_000, longest=2):
    def features(text):
        ws = words(text)
        return [" ".join(ws[i : i + n]) for n in range(1, longest + 1) for i in range(len(ws) - n + 1)]

    def counts(texts):
        out = np.zeros(buckets, int)
        for text in texts:
            for f in features(text):
                out[zlib.crc32(f.encode()) % buckets] += 1
        return out

    s, t = counts(x for _, x in docs), counts(x for _, x in target)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        own = [gain[zlib.crc32(f.encode()) % buckets] for f in features(text)]
        weight = math.floor(sum(own) / len(own)) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= 20))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = percent * len(able) // 100
    return [(*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(able)] + [(*r[:4], None) for r in rows if not r[4]]


TARGET = [(1, "the quick brown fox and the lazy dog"), (2, None), (3, "a fox and a dog in the garden"), (4, "")]


@pytest.mark.parametrize("chunk", [op11.CHUNK, 4000])
@pytest.mark.parametrize("percent", [25, 100])
def test_importance_is_that_of_all_features_counted_one_by_one(spark, odd, monkeypatch, chunk, percent):
    monkeypatch.setattr(op11, "CHUNK", chunk)  # 4000: the long text comes in pieces
    monkeypatch.setattr(op11, "RANGE_ROWS", 2)
    target = spark.createDataFrame(TARGET, "item_id long, text string")
    got = op11.resample(odd, target, percent=percent).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(key, got)) == sorted(map(key, importance(ODD, TARGET, percent)))


def test_importance_with_other_parameters(spark, odd, monkeypatch):
    monkeypatch.setattr(op11, "CHUNK", 3000)
    target = spark.createDataFrame(TARGET, "item_id long, text string")
    got = op11.resample(odd, target, buckets=97, longest=3, percent=50, seed=11).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(key, got)) == sorted(map(key, importance(ODD, TARGET, 50, 11, 97, 3)))


def test_importance_of_empty_tables_and_drawn_rows(spark, odd, none):
    target, nothing = spark.createDataFrame(TARGET, "item_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert op11.resample(none, target).collect() == []
    assert op11.resample(odd, nothing).count() == len(ODD)
    drawn = op11.drawn(odd, target, percent=100)
    assert drawn.columns == odd.columns and drawn.count() == sum(len(words(t)) >= 20 for _, t in ODD)


def test_importance_matches_sql(spark, data):
    assert same([r.asDict() for r in op11.query(spark, data).collect()], duck(data, op11.ORACLE_SQL))


# --- 12 search


def search(docs, queries, k=10):
    terms = [(i, words(t)) for i, t in docs if words(t)]
    n_all, l_all = len(terms), sum(len(w) for _, w in terms)
    items: dict = {}
    for item, text in queries:
        items.setdefault(item, set()).update(words(text))
    out = []
    for item, wanted in items.items():
        scores = []
        for doc_id, ws in terms:
            m, total = 10 + (90 * len(ws) * n_all) // l_all, 0
            for t in wanted:
                df, tf = sum(t in w for _, w in terms), ws.count(t)
                if tf:
                    total += math.floor(1000 * math.log((2 * n_all + 2) / (2 * df + 1))) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            if total > 0:
                scores.append((total, doc_id))
        scores.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item, rank + 1, doc_id, score) for rank, (score, doc_id) in enumerate(scores[:k])]
    return out


QUERIES = [(1, "fox"), (1, "Dog garden"), (2, "the LAZY dog jumps"), (3, None), (4, "..."), (5, "unknownword"), (None, "日本語 été"), (7, "word5 of3 fox"), (8, "fox fox fox"), (8, "fox fox fox")]


@pytest.mark.parametrize("shard_docs", [1 << 16, 2, 1])
@pytest.mark.parametrize("k", [1, 3, 10])
def test_search_is_that_of_all_documents_scored_one_by_one(spark, odd, tmp_path, monkeypatch, shard_docs, k):
    monkeypatch.setattr(op12, "BLOCK_BYTES", 40)  # several blocks of queries
    path = op12.write_index(odd.repartition(3), f"file://{tmp_path}/index", shard_docs=shard_docs, shard_bytes=10_000)
    got = op12.search(spark, path, spark.createDataFrame(QUERIES, "item_id long, text string"), k).collect()
    assert sorted(map(key, got)) == sorted(map(key, search(ODD, QUERIES, k)))


def test_search_keeps_ties_apart_by_id(spark, tmp_path):
    docs = spark.createDataFrame([(i, "same words here") for i in range(500, 0, -1)] + [(None, "same words here")] + [(1000 + i, "nothing") for i in range(600)], "doc_id long, text string")
    path = op12.write_index(docs.repartition(5), f"file://{tmp_path}/ties", shard_docs=64)
    queries = spark.createDataFrame([(1, "words"), (2, "unknown")], "item_id long, text string")
    assert [(r["rank"], r["doc_id"]) for r in op12.search(spark, path, queries).orderBy("rank").collect()] == [(i, i) for i in range(1, 11)]
    assert [r["doc_id"] for r in op12.search(spark, path, queries, 501).orderBy("rank").collect()] == [*range(1, 501), None]


def test_search_of_empty_tables(spark, odd, none, tmp_path):
    queries, nothing = spark.createDataFrame(QUERIES, "item_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert op12.search(spark, op12.write_index(none, f"file://{tmp_path}/a"), queries).collect() == []
    assert op12.search(spark, op12.write_index(odd, f"file://{tmp_path}/b"), nothing).collect() == []


def test_index_is_written_in_small_row_groups(spark, odd, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    monkeypatch.setattr(op12, "GROUP_BYTES", 1 << 16)
    many = odd.select(F.explode(F.array_repeat("text", 40)).alias("text")).withColumn("doc_id", F.monotonically_increasing_id())
    op12.write_index(many.coalesce(1), f"file://{tmp_path}/groups", shard_docs=2)
    assert max(pq.ParquetFile(f).num_row_groups for f in glob.glob(f"{tmp_path}/groups/shards/*.parquet")) > 1


def test_search_matches_sql(spark, data):
    assert same([r.asDict() for r in op12.query(spark, data).collect()], duck(data, op12.ORACLE_SQL))


# --- 13 token files


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(op13.vocabulary_path())


def test_ids_are_those_of_whole_texts(tokenizer):
    """Letters, marks that compose with one case alone, apostrophes, special tokens, white space of all kinds."""
    encode, rnd = op13.Encoder(op13.vocabulary_path()), random.Random(3)
    assert encode.separable
    alphabet = ["a", "b", "S", "T", "h", "J", "re", "'", "'s", "'LL", " ", "\n", " ", "é", "É", "ñ", "×", "÷", "ß", "İ", "Σ", "1", "²", "½", ".", ",", "<|endoftext|>", "<|", "|>", "日", "🙂", "‍", "K", "ﬁ", "\x00", "\x1c", "\x85", " ", "́", "̈", "̌", "_", "-", "endoftext"]
    for special in (True, False):
        for _ in range(10):
            texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))) for _ in range(300)] + ["", None]
            texts = [t if special or t is None else t.replace("<|endoftext|>", "") for t in texts]
            ids, counts = encode(pa.array(texts))
            expected = [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
            assert counts.tolist() == list(map(len, expected)) and ids.tolist() == [i for e in expected for i in e]


def test_encoder_forgets_and_takes_other_vocabularies(tokenizer, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(op13, "REMEMBERED", 3)
    encode = op13.Encoder(op13.vocabulary_path())
    for text in ("one two three four", "five six, seven", "one two"):
        assert encode(pa.array([text]))[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    other = op13.Encoder(str(public_tokenizers.path("byte_bpe_50k.json")))
    assert not other.separable and other(pa.array(["Hello there", None]))[0].tolist() == other.library.encode("Hello there", add_special_tokens=False).ids


def encoded(tokenizer, docs):
    rows, at = [], 0
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, tokenizer_key(d[1]))):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        rows.append((doc_id, at, len(ids), ids))
        at += len(ids)
    return rows, at


def tokenizer_key(text):
    return text or ""


def test_files_hold_all_ids_in_order(spark, odd, tokenizer, tmp_path):
    path = op13.write(odd.repartition(3), f"file://{tmp_path}/tokens", op13.vocabulary_path(), file_bytes=100_000)
    got, (expected, total) = op13.read(spark, path).orderBy("start").collect(), encoded(tokenizer, ODD)
    assert [r["doc_id"] for r in got] == [r[0] for r in expected]
    assert sorted((key((r["doc_id"],)), r["ids"]) for r in got) == sorted((key((r[0],)), r[3]) for r in expected)
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()] and sum(r["n_tokens"] for r in got) == total
    crc = {r["start"]: r["ids_crc32"] for r in op13.placed(op13.checksums(op13.rows(spark, path)), path).collect()}
    assert crc == {r["start"]: zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in got}
    stream = [i for r in got for i in r["ids"]]
    for start, length in ((0, 5), (17, 40), (total - 3, 3), (0, total), (total + 5, 2)):
        pieces = op13.span(spark, path, start, length).orderBy("position").collect()
        assert [i for p in pieces for i in p["ids"]] == stream[start : start + length] and (not pieces or pieces[0]["position"] == start)
    assert {r["doc_id"] for r in op13.lookup_documents(spark, path, [7, 11, 99]).collect()} == {7, 11}


def test_files_have_stripes_and_filters_reach_them(spark, tmp_path, tokenizer):
    from pyarrow import orc

    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text of number "), F.col("id"), F.repeat(F.lit(" word7 and 8"), 40)).alias("text"))
    path = op13.write(docs, f"file://{tmp_path}/stripes", op13.vocabulary_path(), stripe_bytes=20_000)
    files = [orc.ORCFile(f) for f in glob.glob(f"{tmp_path}/stripes/*.orc")]
    assert max(f.nstripes for f in files) > 1
    found = op13.lookup_documents(spark, path, [5, 2999])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id" in plan and found.count() == 2


def test_token_files_of_an_empty_table_and_one_hot_id(spark, none, tokenizer, tmp_path):
    path = op13.write(none, f"file://{tmp_path}/none", op13.vocabulary_path())
    assert op13.read(spark, path).collect() == [] and op13.span(spark, path, 0, 9).collect() == []
    hot = spark.range(2000).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    path = op13.write(hot, f"file://{tmp_path}/hot", op13.vocabulary_path(), file_bytes=1)
    got = op13.read(spark, path).orderBy("start").collect()
    assert len(got) == 2000 and [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]


def test_token_query(spark, data, tokenizer):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    expected, _ = encoded(tokenizer, docs)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in op13.query(spark, data).collect())
    assert got == sorted((i, at, n, zlib.crc32(np.array(ids, "<u4").tobytes())) for i, at, n, ids in expected)


# --- 9 stems of the toxicity lexicon


def test_stems_are_those_of_all_words_counted_one_by_one(spark):
    from lodewell.llm import op9_toxicity as op9

    rnd = random.Random(6)
    bad = [stem + end for stem in ("rogu", "villan") for end in ("ab", "ec", "id", "of", "ug", "yh")]
    rows = [(i, " ".join(rnd.choices(["plain", "words", "roguish", "stand", "here", "villas"], k=20) + (rnd.choices(bad, k=4) if i % 5 == 0 else [])), int(i % 5 == 0)) for i in range(120)]
    sample = spark.createDataFrame(rows, "doc_id long, text string, y int").coalesce(2)
    counts = op9.word_counts(sample).cache()
    n_toxic, n_clean = 24, 96
    sums: dict = {}
    for r in counts.collect():
        for k in range(4, min(12, len(r["word"]) - 1) + 1):
            s = sums.setdefault(r["word"][:k], [0, 0, 0])
            s[0], s[1], s[2] = s[0] + r["support"], s[1] + r["clean"], s[2] + (r["support"] > 0)
    share, found = n_toxic / (n_toxic + n_clean), []
    for stem, (support, clean, forms) in sums.items():
        if forms >= 3 and support >= 6 and support * (1 - share) > 8 * clean * share:
            n = support + clean
            evidence = support * math.log(support / (n * share)) + (clean * math.log(clean / (n * (1 - share))) if clean else 0)
            if evidence > 1 + math.log(max(2, len(sums))):
                found.append((-evidence, stem))
    expected: list = []
    for _, stem in sorted(found):
        if not any(stem.startswith(x) or x.startswith(stem) for x in expected):
            expected.append(stem)
    assert op9.stems_of(counts, n_toxic, n_clean) == expected and any(x.startswith("villan") for x in expected)


def test_words_with_stems_are_counted(spark):
    from lodewell.llm import op9_toxicity as op9

    trie = op9.stem_trie(["rogu", "villan", "été"])
    texts = ["Rogues and roguery, villa villain 'villan' rogu", None, "", 'he said "rogue" and rogue', "étés (villans) x" * 1, "日本 rog"]
    assert op9.stem_counts(texts, trie).tolist() == [[3, 7], [0, 0], [0, 0], [1, 5], [2, 3], [0, 2]]
    assert op9.stem_counts(texts, op9.stem_trie([]))[:, 0].tolist() == [0] * 6


# --- 4 nested rules of arguments, and the query's order


def test_arguments_against_nested_rules(spark):
    from lodewell.llm import op4_tool_calls as op4

    schemas = {
        "t": {"type": "object", "closed": True, "fields": {"n": {"type": "number", "least": 1, "most": 3}, "tags": {"type": "array", "most": 2, "items": {"type": "object", "closed": True, "fields": {"k": {"type": "string", "required": True, "enum": ["a", "b"]}}}}, "deep": {"type": "object", "required": True, "fields": {"x": {"type": "array", "least": 1, "items": {"type": "array", "items": {"type": "integer"}}}}}}},
        "free": {},
    }
    cases = {
        '{"n": 2.5, "tags": [{"k": "a"}], "deep": {"x": [[1, 2]], "more": 1}}': "",
        '{"n": 0, "deep": {}}': "n:small",
        '{"n": 4, "tags": [{"k": "c"}, {"k": "d"}, {"q": 1}], "deep": null, "z": 1, "a": 2}': "deep:missing,n:large,tags:long,tags.*.k:value,tags.*.k:missing,tags.*.q:unknown,a:unknown,z:unknown",
        '{"n": "2", "tags": {}, "deep": {"x": []}}': "deep.x:short,n:type,tags:type",
        '{"deep": {"x": [[1], ["y", null], "z"]}}': "deep.x.*.*:type,deep.x.*:type",
        "[1]": "deep:missing",
        "{": "not json",
    }
    rows = spark.createDataFrame([("t", a) for a in cases] + [("free", '{"any": 1}'), ("other", "{}"), (None, "{}")], "name string, arguments string")
    got = [r["p"] for r in rows.select(op4.problems(F.col("name"), F.col("arguments"), schemas).alias("p")).collect()]
    assert got == [*cases.values(), "", "unknown tool", None]


def test_calls_of_conversations_are_ordered(spark, data):
    from lodewell.llm import op4_tool_calls as op4

    long, short, medium = "x" * 310, "s" * 50, "m" * 200
    rows = [(1, 0, "user", long), (1, 1, "assistant", "A"), (1, 2, "user", long), (1, 4, "user", medium), (2, 0, "user", long), (2, 2, "user", short), (2, 4, "user", short), (3, 0, "user", short), (3, 2, "user", short)]
    got = {(r["conv_id"], r["turn"]): (r["level"], r["status"], r["position"]) for r in op4.link(op4.from_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert got == {
        (1, 0): (2, "linked", 2), (1, 1): (2, "linked", 3), (1, 2): (1, "unanswered", 1), (1, 4): (0, "unanswered", 0),
        (2, 0): (-1, "cycle", 0), (2, 2): (-1, "cycle", 1), (2, 4): (-1, "cycle", 2), (3, 0): (0, "unanswered", 0), (3, 2): (0, "unanswered", 1),
    }
    made = duckdb.connect()
    made.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{data}/conversations.parquet')")
    expected = made.sql(op4.ORACLE_SQL).to_arrow_table().to_pylist()
    found = [r.asDict() for r in op4.query(spark, data).collect()]
    assert same(found, expected) and {r["level"] for r in found} > {0}
