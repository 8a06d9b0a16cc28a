"""Toxicity: a learned lexicon's trie, intersected with Levenshtein automata, run over every word.

The lexicon holds words that toxic training texts use far more often than clean ones; a word's
support is the number of toxic texts, or of different words that it follows there if these are
fewer: copies of one text count once. The trie of
the lexicon and the automata of distance 1 are intersected beforehand: their subset construction
gives one transition table for each TERMS terms, which all words of a batch walk through in step. A word at distance 1
that clean training texts use themselves is no misspelling. Each hit's context window tells
quotation (quotation marks around it) from use; the window's other hits count as support. Where toxic
words are many forms of few stems, no form may be frequent enough, so stems are learned too: beginnings
of words, which a second trie finds, quoted ones left out. A logistic model weighs the counts, from
prior weights that hold where training has no such case.

Null and empty texts have no hit and get the base score. Without labels that score is PRIOR's. Rows are
scored one by one, repeated ones alike; rows without id are scored and never learned from; an empty
table gives no scores.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewell.llm.common import bounded_batches, chunks, keyed_texts, plain_names, remainder, table, written
from lodewell.llm.op2_quality import labelled_sample, sigmoid

#: Labelled rows that are learned from, and terms of an automaton; a larger lexicon has several.
SAMPLE, TERMS = 20_000, 400
#: Letters from which on a term may be misspelled, words on each side of a hit that are its context.
FUZZY_LENGTH, CONTEXT = 5, 6
THRESHOLD = 0.3
#: Prior weights and their spreads: what holds of a text without hits, with a strong term, with weaker hits alone, with
#: quoted hits alone; then, for each doubling, of strong terms, of weaker hits, of hits close together, of words with
#: a stem, and of all words of a text that has such.
PRIOR, SPREAD = np.array([-4.0, 2.0, 0.5, -2.5, 1.5, 1.5, 0.7, 1.0, -0.3]), np.array([4.0, 2.0, 1.5, 1.5, 1.0, 1.0, 1.0, 1.0, 0.5])
#: Letters of stems, forms and uses in toxic texts that one must have, and how many times likelier it must be there.
STEM_LENGTHS, STEM_FORMS, STEM_USES, STEM_RATIO = (4, 12), 3, 6, 8

_QUOTES = "\"'`“”„‟«»‹›‘’‚‛「」『』"


def _code_table(chosen) -> np.ndarray:
    return np.array([chosen(chr(c)) if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)], dtype=bool)


_TABLES: dict = {}


def code_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: white space, part of a word's core, quotation mark."""
    if not _TABLES:
        quote = np.zeros(0x110000, bool)
        quote[[ord(c) for c in _QUOTES]] = True
        _TABLES[0] = _code_table(str.isspace), _code_table(str.isalnum), quote
    return _TABLES[0]


class Words:
    """The words of some texts: runs without white space, cut to what lies between their first and last letter or digit."""

    def __init__(self, texts: list):
        lowered = [(x or "").lower() for x in texts]
        self.codes = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        space, core, quote = code_tables()
        self.text = "\n".join(lowered)
        solid = ~space[self.codes]
        edge = np.diff(np.concatenate([[0], solid.view(np.int8), [0]]))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        at = np.arange(len(self.codes))
        inner = core[self.codes]
        after = np.minimum.accumulate(np.where(inner, at, len(at))[::-1])[::-1] if len(at) else at
        before = np.maximum.accumulate(np.where(inner, at, -1)) if len(at) else at
        first, last = after[starts], before[ends - 1] + 1
        ok = first < last
        starts, ends, self.first, self.last = starts[ok], ends[ok], first[ok], last[ok]
        marks = np.concatenate([[0], np.cumsum(quote[self.codes])])
        self.opens, self.closes = marks[self.first] > marks[starts], marks[ends] > marks[self.last]
        bounds = np.cumsum([0, *[len(x) + 1 for x in lowered]])
        self.of = np.searchsorted(bounds, self.first, side="right") - 1
        self.count = np.bincount(self.of, minlength=len(texts))

    def word(self, i: int) -> str:
        return self.text[self.first[i] : self.last[i]]


def automaton(terms: list[str], strong: int | None = None) -> dict:
    """The lexicon's trie intersected with the automata of at most one insertion, deletion or substitution, made deterministic.

    A state is a set of (trie node, errors so far). Row 0 of `next` is the dead state, row 1 the
    start; column 0 stands for all characters that no term has. `term` and `errors` tell what ends
    in a state; -1 where nothing does. The first `strong` terms count as terms that no clean text has.
    """
    children: list[dict] = [{}]
    ends: dict = {}
    for t, term in enumerate(terms):
        node = 0
        for c in term:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
            node = children[node][c]
        ends[node] = t
    alphabet = {c: i + 1 for i, c in enumerate(sorted({c for t in terms for c in t}))}

    def closed(pairs) -> frozenset:
        full = set(pairs)
        full |= {(child, 1) for node, e in pairs if e == 0 for child in children[node].values()}  # a character left out
        return frozenset((n, e) for n, e in full if not (e and (n, 0) in full))

    def step(state, c) -> frozenset:
        out = set()
        for node, e in state:
            if c in children[node]:
                out.add((children[node][c], e))
            if e == 0:
                out.add((node, 1))  # a character too many
                out |= {(child, 1) for child in children[node].values()}  # another character
        return closed(out)

    start = closed([(0, 0)])
    number, queue, rows = {frozenset(): 0, start: 1}, [frozenset(), start], []
    for state in queue:
        other = step(state, None)
        row = defaultdict(lambda k=other: k)
        for c in {c for node, _ in state for c in children[node]}:
            row[c] = step(state, c)
        for target in [other, *row.values()]:
            if target not in number:
                number[target] = len(number)
                queue.append(target)
        rows.append([number[other]] + [number[row[c]] for c in alphabet])
    term, errors = np.full(len(queue), -1, np.int32), np.zeros(len(queue), np.int8)
    for i, state in enumerate(queue):
        found = sorted((e, ends[n]) for n, e in state if n in ends and (e == 0 or len(terms[ends[n]]) >= FUZZY_LENGTH))
        if found:
            errors[i], term[i] = found[0]
    return {"next": np.array(rows, np.int32), "term": term, "errors": errors, "alphabet": alphabet, "longest": max(map(len, terms), default=0) + 1, "strong": len(terms) if strong is None else strong}


def matches(words: Words, machine: dict) -> tuple[np.ndarray, np.ndarray]:
    """Indices of words that end in an accepting state, and those states."""
    classes = np.zeros(0x110000, np.uint16)
    for c, i in machine["alphabet"].items():
        classes[ord(c)] = i
    symbols = classes[words.codes]
    length = words.last - words.first
    alive = np.flatnonzero(length <= machine["longest"])
    state = np.ones(len(alive), np.int32)
    hits, ended = [], []
    for at in range(machine["longest"] + 1):
        done = length[alive] == at
        here = done & (machine["term"][state] >= 0)
        hits.append(alive[here])
        ended.append(state[here])
        alive, state = alive[~done], state[~done]
        if not len(alive):
            break
        state = machine["next"][state, symbols[words.first[alive] + at]]
        on = state > 0
        alive, state = alive[on], state[on]
    hit, state = np.concatenate(hits), np.concatenate(ended)
    order = np.argsort(hit)
    return hit[order], state[order]


def automata(terms: list[str], strong: int) -> list[dict]:
    """Automata of TERMS terms each that together hold all terms; the first `strong` of them are in no clean text."""
    return [automaton(terms[i : i + TERMS], min(max(strong - i, 0), TERMS)) for i in range(0, len(terms), TERMS)]


def all_matches(words: Words, machines: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices of words that some automaton accepts; for each, the fewest errors, and whether the term so found is one that clean texts have."""
    found = [(hit, m["errors"][state], m["term"][state] >= m["strong"]) for m in machines for hit, state in [matches(words, m)]]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, bool)
    hit, errors, other = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((other, errors, hit))
    order = order[np.flatnonzero(np.diff(hit[order], prepend=-1))]
    return hit[order], errors[order], other[order]


def quoted(words: Words, i: int) -> bool:
    """Whether a quotation mark opens at the word or shortly before and closes at it or shortly after, in the same text."""
    here = words.of[i]
    low, high = max(0, i - CONTEXT), min(len(words.of) - 1, i + CONTEXT)
    opened = any(words.opens[j] and words.of[j] == here and not words.closes[j:i].any() for j in range(low, i + 1))
    return opened and any(words.closes[j] and words.of[j] == here and not words.opens[i + 1 : j + 1].any() for j in range(i, high + 1))


def hit_counts(texts: list, machines: list[dict], innocent: set) -> tuple[np.ndarray, list]:
    """For each text: strong terms used, others and misspelled ones, quoted ones, and hits whose window holds another; also (text, surface) of the misspelled."""
    words = Words(texts)
    out, surfaces = np.zeros((len(texts), 4)), []
    before = (-1, -CONTEXT - 1)
    for i, errors, other in zip(*all_matches(words, machines)) if len(words.of) else ():
        text = words.of[i]
        if errors:
            surface = words.word(i)
            surfaces.append((text, surface))
            if surface in innocent:
                continue
            kind = 1
        else:
            kind = int(other)
        out[text, 2 if quoted(words, i) else kind] += 1
        if before[0] == text and i - before[1] <= CONTEXT:
            out[text, 3] += 1
        before = (text, i)
    return out, surfaces


def stem_trie(stems: list[str]) -> dict:
    """The trie of the stems: a table of transitions, 0 where none goes on, and which nodes end a stem."""
    children: list[dict] = [{}, {}]
    ends = set()
    for stem in stems:
        node = 1
        for c in stem:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
            node = children[node][c]
        ends.add(node)
    alphabet = {c: i + 1 for i, c in enumerate(sorted({c for x in stems for c in x}))}
    table = np.zeros((len(children), len(alphabet) + 1), np.int32)
    for node, row in enumerate(children):
        for c, child in row.items():
            table[node, alphabet[c]] = child
    return {"next": table, "ends": np.isin(np.arange(len(children)), list(ends)), "alphabet": alphabet, "longest": max(map(len, stems), default=0)}


def stem_counts(texts: list, trie: dict) -> np.ndarray:
    """For each text: words that begin with a stem and aren't quoted, and all words."""
    words = Words(texts)
    found = np.zeros(len(texts))
    if trie["longest"] and len(words.of):
        classes = np.zeros(0x110000, np.uint16)
        for c, i in trie["alphabet"].items():
            classes[ord(c)] = i
        symbols, length = classes[words.codes], words.last - words.first
        alive, node = np.arange(len(words.of)), np.ones(len(words.of), np.int32)
        for at in range(trie["longest"]):
            on = length[alive] > at
            alive, node = alive[on], node[on]
            node = trie["next"][node, symbols[words.first[alive] + at]]
            for i in alive[trie["ends"][node]]:
                found[words.of[i]] += not quoted(words, i)
            on = (node > 0) & ~trie["ends"][node]
            alive, node = alive[on], node[on]
    return np.stack([found, words.count.astype(float)], axis=1)


def design(counts: np.ndarray) -> np.ndarray:
    """The model's columns from those of `hit_counts` and `stem_counts`."""
    strong, weak, cited, close, stems, words = counts.T
    only = [(strong + weak + cited) == 0, strong > 0, (strong == 0) & (weak > 0), (strong + weak == 0) & (cited > 0)]
    return np.stack([*only, np.log2(np.maximum(1, strong)), np.log2(np.maximum(1, weak)), np.log2(1 + close), np.log2(1 + stems), (stems > 0) * np.log2(1 + words / 64)], axis=1).astype(float)


def all_counts(texts: list, model: dict) -> np.ndarray:
    return np.concatenate([hit_counts(texts, model["machines"], model["innocent"])[0], stem_counts(texts, model["stems"])], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> np.ndarray:
    """The most likely weights under normal priors, by Newton's method."""
    w, precision = PRIOR.copy(), 1 / SPREAD**2
    for _ in range(rounds):
        p = sigmoid(x @ w)
        gradient = x.T @ (y - p) - precision * (w - PRIOR)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(precision), gradient)
        w = w + step * min(1, 4 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return w


def word_counts(sample: DataFrame) -> DataFrame:
    """(word, support in toxic texts, clean texts that use it) of the sample's words."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                words, label = Words(part.column(1).to_pylist()), part.column(2).to_numpy(zero_copy_only=False)
                follows, used = set(), (defaultdict(set), defaultdict(set))
                last = (-1, "")
                for i in range(len(words.of)):
                    of, word = int(words.of[i]), words.word(i)
                    if label[of]:
                        follows.add((word, last[1] if last[0] == of else ""))
                    used[label[of]][word].add(of)
                    last = (of, word)
                rows = [(w, p, 0, 0) for w, p in follows] + [(w, None, len(of), 0) for w, of in used[0].items()] + [(w, None, 0, len(of)) for w, of in used[1].items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 4, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["word", "previous", "clean", "toxic"])

    rows = sample.mapInArrow(run, "word string, previous string, clean long, toxic long")
    once = rows.groupBy("word", F.xxhash64("previous").alias("follows"), F.col("previous").isNotNull().cast("long").alias("context")).agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    return once.groupBy("word").agg(F.least(F.sum("context"), F.sum("toxic")).alias("support"), F.sum("clean").alias("clean"))


def lexicon(sample: DataFrame, n_toxic: int, n_clean: int) -> tuple[list[str], int]:
    """All words whose share of toxic uses chance does not explain, given how many words there are.

    Those that no clean text has come first; the second value is their number.
    """
    return telling(written(word_counts(sample), "word-counts"), n_toxic, n_clean)


def evidence_of(share: float):
    """How much likelier the uses in toxic and clean texts are if these have rates of their own."""
    n = F.col("support") + F.col("clean")
    return F.col("support") * F.log(F.col("support") / (n * share)) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (n * (1 - share)))).otherwise(0.0)


def stems_of(counts: DataFrame, n_toxic: int, n_clean: int) -> list[str]:
    """Beginnings of words whose uses in toxic texts chance does not explain, none the beginning of another; of several in one line the one of the most evidence."""
    share = n_toxic / max(1, n_toxic + n_clean)
    low, high = STEM_LENGTHS
    each = counts.where(F.length("word") > low).select("support", "clean", F.explode(F.expr(f"transform(sequence({low}, least({high}, length(word) - 1)), k -> substring(word, 1, k))")).alias("stem"))
    sums = each.groupBy("stem").agg(F.sum("support").alias("support"), F.sum("clean").alias("clean"), F.count_if(F.col("support") > 0).alias("forms"))
    sums = written(sums, "stem-counts")
    tried = max(2, sums.count())
    evidence = evidence_of(share)
    likely = (F.col("forms") >= STEM_FORMS) & (F.col("support") >= STEM_USES) & (F.col("support") * (1 - share) > STEM_RATIO * F.col("clean") * share)
    chosen: list[str] = []  # bounded as the lexicon is, by the labelled sample
    for r in sums.where(likely).where(evidence > 1 + np.log(tried)).orderBy(evidence.desc(), "stem").collect():
        if not any(r["stem"].startswith(x) or x.startswith(r["stem"]) for x in chosen):
            chosen.append(r["stem"])
    return chosen


def telling(counts: DataFrame, n_toxic: int, n_clean: int) -> tuple[list[str], int]:
    """`lexicon` from the counts of words, a written table."""
    tried = max(2, counts.count())
    share = n_toxic / max(1, n_toxic + n_clean)
    evidence = evidence_of(share)
    found = counts.where((F.col("support") >= 3) & (F.col("support") * (1 - share) > 4 * F.col("clean") * share) & (F.col("clean") < F.col("support")) & (F.length("word") >= 3))
    best = found.where(evidence > 1 + np.log(tried)).orderBy(evidence.desc(), "word").collect()
    strong = [r["word"] for r in best if not r["clean"]]
    return strong + [r["word"] for r in best if r["clean"]], len(strong)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", usable=None, sample: int = SAMPLE) -> dict:
    """The automata, the innocent surfaces and the weights, from at most `sample` labelled rows."""
    usable = F.lit(True) if usable is None else usable
    rows = written(labelled_sample(docs, labels, label, usable, sample).dropDuplicates(["doc_id"]), "toxicity-sample")
    by_label = {bool(r["y"]): r["n"] for r in rows.groupBy((F.col("y") > 0).alias("y")).agg(F.count("*").alias("n")).collect()}
    model = {"machines": [], "innocent": set(), "weights": PRIOR, "terms": [], "stems": stem_trie([])}
    if len(by_label) < 2:
        return model
    rows = rows.select("doc_id", "text", (F.col("y") > 0).cast("int").alias("y"))
    words = written(word_counts(rows), "word-counts")
    model["terms"], strong = telling(words, by_label[True], by_label[False])
    model["stems"] = stem_trie(stems_of(words, by_label[True], by_label[False]))
    model["machines"] = machines = automata(model["terms"], strong)

    def surfaces(batches):
        for batch in batches:
            for part in chunks(batch):
                label = part.column(2).to_pylist()
                found = {(of, w) for of, w in hit_counts(part.column(1).to_pylist(), machines, set())[1]}
                yield pa.RecordBatch.from_arrays([pa.array([w for _, w in found], pa.string()), pa.array([label[of] for of, _ in found], pa.int32())], names=["word", "y"])

    seen = rows.mapInArrow(surfaces, "word string, y int").groupBy("word").agg(F.sum("y").alias("toxic"), F.count("*").alias("n"))
    # twenty letters or fewer, one edit from a term: at most a few thousand different ones for each term
    model["innocent"] = {r["word"] for r in seen.where(F.col("n") > 2 * F.col("toxic")).select("word").collect()}
    names = ["strong", "weak", "cited", "close", "stems", "words"]

    def counts(batches):
        for batch in batches:
            for part in chunks(batch):
                yield pa.RecordBatch.from_arrays([part.column(2), *[pa.array(c) for c in all_counts(part.column(1).to_pylist(), model).T]], names=["y", *names])

    # a row for each text of the sample
    cells = rows.mapInArrow(counts, "y int, " + ", ".join(f"{n} double" for n in names)).toPandas()
    model["weights"] = fit_logistic(design(cells[names].to_numpy()), cells.y.to_numpy().astype(float))
    return model


def scores(texts: list, model: dict) -> np.ndarray:
    return sigmoid(design(all_counts(texts, model)) @ model["weights"])


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score of every text, without any shuffle; a transition table of TERMS terms is a few megabytes at most."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores(part.column(1).to_pylist(), shared.value), pa.float64())], names=["doc_id", "score"])

    return keyed_texts(docs).mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text scores below `threshold`, with all their columns; one scan, no join."""
    bounded_batches(docs.sparkSession)
    docs, names = plain_names(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                text = part.column(part.schema.get_field_index("text")).to_pylist()
                yield part.filter(pa.array(scores(text, shared.value) < threshold))

    return docs.mapInArrow(run, docs.schema).toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), "toxic", remainder("doc_id", 4) != 2)
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
