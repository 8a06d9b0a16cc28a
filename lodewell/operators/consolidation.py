"""What may be folded together and what contradicts: exhaust and protection, clusters by tags or entities, distillation, conflicts."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodewell.functions import text as T
from lodewell.operators import graph as G
from lodewell.operators.graph import cut
from lodewell.operators.relational import shared_item_pairs

#: Categories, collections, tags and paths of notes that machines write as they run.
EXHAUST_CATEGORIES = ["observation", "conversation"]
EXHAUST_COLLECTIONS = ["journal"]
EXHAUST_TAGS = ["temperature-refresh", "dream-cycle", "auto-save", "hook", "email-recap", "cron-run"]
DIARY_PATH = r"(?i)agent[ -]diar(?:y|ies)"
#: Categories, importance and paths of notes that are never folded away.
PROTECTED_CATEGORIES = ["fact", "preference", "decision", "entity"]
PROTECTED_IMPORTANCE = ["high", "critical"]
CRM_PATH = r"(?i)(?:^|/)\d*\s*CRM/"
ENTITIES_PATH = r"(?i)(?:^|/)Entities/"
#: Least cosine and greatest word overlap of a contradiction, and how many are told.
CONTRADICTION, OVERLAP, MOST_CONFLICTS = 0.80, 0.5, 3


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def exhaust(path: Column, category: Column, collection: Column, tags: Column) -> Column:
    """Whether a note is a machine's log."""
    marked = F.exists(F.coalesce(tags, F.array().cast("array<string>")), lambda t: _true(t.isin(EXHAUST_TAGS)))
    return _true(category.isin(EXHAUST_CATEGORIES)) | _true(collection.isin(EXHAUST_COLLECTIONS)) | _true(path.rlike(DIARY_PATH)) | marked


def protected(path: Column, kind: Column, collection: Column, category: Column, importance: Column) -> Column:
    """Whether a note must never be folded away: projects, entities, lasting knowledge, what is important."""
    return (
        _true(kind.isin("project", "entity"))
        | _true(collection == "projects")
        | _true(category.isin(PROTECTED_CATEGORIES))
        | _true(importance.isin(PROTECTED_IMPORTANCE))
        | _true(path.rlike(CRM_PATH))
        | _true(path.rlike(ENTITIES_PATH))
    )


def without_own_tags(tags: Column) -> Column:
    """Tags that maintenance itself does not set."""
    return F.filter(tags, lambda t: ~t.isin(EXHAUST_TAGS))


def series(notes: DataFrame, tag: str, title: str | None = None) -> DataFrame:
    """Notes with the tag, and a title that matches, that are no consolidated ones themselves."""
    rows = notes.where(F.array_contains("tags", tag) & ~F.col("path").startswith("Memories/consolidated/"))
    return rows.where(F.col("title").rlike(title)) if title else rows


def pairs_by_item(rows: DataFrame, key: str, item: str, fanout: int) -> DataFrame:
    """(src, dst, w): pairs of keys that share w items, two at least; items of more than `fanout` keys tell nothing and are no bridge."""
    return shared_item_pairs(rows, key, item, 2, fanout).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("shared").alias("w"))


def tag_clusters(tagged: DataFrame, fanout: int = 60, least: int = 3, kind: str = "long") -> DataFrame:
    """(community, members, tags) of cold notes (key, tag): Louvain communities of pairs with two shared tags, of `least` notes and two common tags."""
    edges = G.cut(pairs_by_item(tagged, "key", "tag", fanout).select("src", "dst", F.col("w").cast("double").alias("w")))
    found = G.communities(edges, kind).select(F.col("node").alias("key"), "community")
    return _described(found, tagged, least)


def _described(found: DataFrame, tagged: DataFrame, least: int) -> DataFrame:
    size = found.groupBy("community").agg(F.count("*").alias("members")).where(F.col("members") >= least)
    shared = found.join(tagged.select("key", "tag").distinct(), "key").groupBy("community", "tag").agg(F.count("*").alias("n")).where("n >= 2")
    tags = shared.groupBy("community").agg(F.array_sort(F.collect_list("tag")).alias("tags")).where(F.size("tags") >= 2)
    return size.join(tags, "community")


def reconciled(tagged: DataFrame, named: DataFrame, fanout: int = 60, least: int = 2) -> DataFrame:
    """(cluster, members, basis) of cold notes that share an entity (key, name) or two tags (key, tag): components, told by their commonest tie.

    An item of more than `fanout` notes links them as a path through its least note instead of by all
    pairs, if it is an entity; a tag of so many notes is no tie.
    """
    by_tag = pairs_by_item(tagged, "key", "tag", fanout).select("src", "dst")
    star = named.select("key", "name").distinct()
    by_name = star.join(star.groupBy("name").agg(F.min("key").alias("least")), "name").where("key <> least").select(F.col("least").alias("src"), F.col("key").alias("dst"))
    found = G.components(by_tag.union(by_name)).select(F.col("node").alias("key"), F.col("component").alias("cluster"))
    found = G.cut(found)
    size = found.groupBy("cluster").agg(F.count("*").alias("members")).where(F.col("members") >= least)

    def commonest(rows: DataFrame, item: str, most: int, label: str) -> DataFrame:
        n = found.join(rows.select("key", item).distinct(), "key").groupBy("cluster", item).agg(F.count("*").alias("n")).where("n >= 2")
        place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), item))
        first = n.withColumn("place", place).where(F.col("place") <= most).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("place", item))).alias("x"))
        return first.select("cluster", F.concat(F.lit(label), F.array_join(F.transform("x", lambda s: s[item]), "+")).alias("basis"))

    ties = size.join(commonest(named, "name", 1, "entity:").withColumnRenamed("basis", "by_name"), "cluster", "left").join(commonest(tagged, "tag", 2, "tags:").withColumnRenamed("basis", "by_tag"), "cluster", "left")
    return ties.withColumn("basis", F.coalesce("by_name", "by_tag")).where("basis IS NOT NULL").select("cluster", "members", "basis")


def distilled(notes: DataFrame, clusters: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(canonical notes, moves) for rows (cluster, key): a fact of each cluster that lists its sources, and where each source goes.

    `notes` has key, path, title, content. The newest title by key names the fact; sources are
    quoted by their first 200 letters, in the order of their paths.
    """
    rows = notes.join(clusters, "key")
    entry = F.concat(F.lit("- [["), "path", F.lit("]]: "), T.snippet(F.col("content"), 200))
    body = rows.groupBy("cluster").agg(F.max_by("title", "key").alias("title"), F.array_sort(F.collect_list(F.struct("path", entry.alias("entry")))).alias("sources"))
    facts = body.select(
        "cluster",
        F.concat(F.lit("Memories/consolidated/"), T.slug(F.col("title")), F.lit(".md")).alias("path"),
        "title",
        F.lit("fact").alias("category"),
        F.lit(as_of).alias("date"),
        F.array_join(F.transform("sources", lambda s: s["entry"]), "\n").alias("content"),
        F.size("sources").cast("long").alias("members"),
    )
    return facts, rows.select("path", F.concat(F.lit("Archive/"), "path").alias("to"), "cluster")


def consolidation_hint(notes: DataFrame, path: str, tags: list[str], least: int = 5) -> DataFrame:
    """(tag, n) of the up to five commonest given tags among notes that share two of them with a new note, if there are `least` such notes."""
    wanted = F.array(*map(F.lit, sorted(set(tags))))
    shared = notes.where(F.col("path") != path).select("path", F.array_intersect("tags", wanted).alias("shared")).where(F.size("shared") >= 2)
    counts = shared.select(F.explode(F.concat(F.array(F.lit("")), "shared")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    enough = counts.where((F.col("tag") == "") & (F.col("n") >= least)).select(F.lit(1).alias("_enough"))
    return counts.where("tag <> ''").crossJoin(F.broadcast(enough)).select("tag", "n").orderBy(F.desc("n"), "tag").limit(5)


def _conflict():
    """Whether n and h, of the same category, share a tag, or have titles within two fifths of edits."""
    a, b = T.slug(F.col("n.title")), T.slug(F.col("h.title"))
    longest = F.greatest(F.length(a), F.length(b))
    near = (longest > 0) & (F.levenshtein(a, b) / longest < 0.4)
    return F.coalesce(F.arrays_overlap("n.tags", "h.tags"), F.lit(False)) | near


def potential_conflicts(new: DataFrame, hits: DataFrame) -> DataFrame:
    """(key, path) of search hits (key, path, title, tags, category, type) that may conflict with the new fact or decision of that key (title, tags, category, path).

    Of the same category, and with a shared tag, or a title within two fifths of edits.
    """
    both = new.where(F.col("category").isin("fact", "decision")).alias("n").join(hits.alias("h"), F.col("n.key") == F.col("h.key"))
    same = (F.col("h.type") == "memory") & (F.col("h.category") == F.col("n.category")) & (F.col("h.path") != F.col("n.path"))
    return both.where(same & _conflict()).select("n.key", "h.path")


def _classes(rows: DataFrame, columns: list[str], members: list[str]) -> tuple[DataFrame, DataFrame]:
    """(classes, members): a row (class, columns) for all rows that are equal in them, and rows (class, members)."""
    classes = cut(rows.select(*columns).distinct().withColumn("class", F.monotonically_increasing_id()))
    at = rows.alias("r").join(classes.alias("c"), reduce(and_, [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in columns]))
    return classes, at.select("class", *[f"r.{m}" for m in members])


def potential_conflicts_within(new: DataFrame, notes: DataFrame, group: str) -> DataFrame:
    """As potential_conflicts, where the hits of a new note are all `notes` (path, title, tags, category, type) of its `group`, a column of both.

    Notes that are alike in all that is compared are one class: classes are compared, and their members joined to what has passed.
    """
    columns = [group, "category", "title", "tags"]
    asked, keys = _classes(new.where(F.col("category").isin("fact", "decision")), columns, ["key", "path"])
    known, paths = _classes(notes.where("type = 'memory'"), columns, ["path"])
    pairs = asked.alias("n").join(known.alias("h"), [F.col(f"n.{c}") == F.col(f"h.{c}") for c in columns[:2]]).where(_conflict())
    pairs = pairs.select(F.col("n.class").alias("class"), F.col("h.class").alias("other"))
    hits = keys.withColumnRenamed("path", "own").join(pairs, "class").select("key", "own", F.col("other").alias("class"))
    return hits.join(paths, "class").where("own <> path").select("key", "path")


def contradictions(new: DataFrame, known: DataFrame, cosine: Column | str, most: int = MOST_CONFLICTS) -> DataFrame:
    """(key, path, score): memories about the new one's primary entity that say something else: near in meaning, far in words.

    `new` has key, path, entity, text and `known` path, entity, text, besides what `cosine`, over
    columns n.* and k.*, needs (no key or path); or `cosine` is the name of a column of vectors of both,
    and pairs are compared in tiles (`_best_in_tiles`). Memories are met by their entity, never by all pairs. Those that are equal
    but for key and path are one class, whose words are found once: classes are compared, and of each
    known one the first paths ride along, one more than are returned, as one may be the new memory's own.
    """
    said = [c for c in new.columns if c not in ("key", "path")]
    asked, keys = _classes(new, said, ["key", "path"])
    held = [c for c in known.columns if c not in ("key", "path")]
    told, paths = _classes(known.where("path IS NOT NULL"), held, ["path"])
    first = paths.groupBy("class", "path").agg(F.count("*").alias("copies")).withColumn("place", F.row_number().over(Window.partitionBy("class").orderBy("path"))).where(F.col("place") <= most + 1)
    first = first.groupBy("class").agg(F.collect_list(F.struct("path", F.least("copies", F.lit(most)).alias("copies"))).alias("paths"))  # most + 1
    asked = asked.withColumn("_words", T.content_tokens(F.col("text"))).withColumn("_about", F.lower(F.trim("entity")))
    told = told.join(first, "class").withColumn("_words", T.content_tokens(F.substring("text", 1, 1024))).withColumn("_about", F.lower(F.trim("entity")))
    if isinstance(cosine, str):
        return _first_of_each(_best_in_tiles(asked, told, cosine, most), keys, most)
    both = asked.alias("n").join(told.alias("k"), F.col("n._about") == F.col("k._about"))
    near = both.select("n.class", "k.paths", F.round(cosine, 4).alias("score"), F.col("n._words").alias("a"), F.col("k._words").alias("b")).where(F.col("score") >= CONTRADICTION)
    near = near.where(T.jaccard(F.col("a"), F.col("b")) < OVERLAP).select("class", "score", F.explode("paths").alias("p")).select("class", "score", "p.path", "p.copies")
    return _first_of_each(near, keys, most)


def _first_of_each(near: DataFrame, keys: DataFrame, most: int) -> DataFrame:
    """(key, path, score): the best rows of near (class, score, path, copies) for each of keys (class, key, path) but its own path."""
    near = near.groupBy("class", "path").agg(F.max("score").alias("best"), F.collect_list(F.struct("score", "copies")).alias("rows"))
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("best"), "path"))).where(F.col("place") <= most + 1)
    each = keys.withColumnRenamed("path", "own").join(near, "class").where("own <> path").select("key", "path", F.explode("rows").alias("r"))
    each = each.select("key", "path", "r.score", F.explode(F.sequence(F.lit(1), F.col("r.copies").cast("int"))))
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "path"))
    return each.withColumn("place", place).where(F.col("place") <= most).select("key", "path", "score")


#: Classes of new and of known memories in a tile, and pairs of them that a task scores at a time.
TILE_ASKED, TILE_TOLD, TILE_PAIRS = 4096, 8192, 1 << 19


def _best_in_tiles(asked: DataFrame, told: DataFrame, vector: str, most: int) -> DataFrame:
    """(class, score, path, copies): of asked (class, _about, _words, vector) and told (_about, _words, paths, vector), the best rows of a class in each tile, of `most` + 1 paths and `most` rows a path.

    An entity's memories are dealt in blocks, two of which meet in a tile; pairs are scored there as
    arrays and only what may be among the first leaves it, so memories that all differ make no rows of pairs.
    """
    import numpy as np
    import pyarrow as pa
    from decimal import ROUND_HALF_UP, Decimal

    asked, told = asked.where("_words IS NOT NULL"), told.where("_words IS NOT NULL")
    counted = asked.groupBy("_about").agg(F.count("*").alias("n")).join(told.groupBy("_about").agg(F.count("*").alias("k")), "_about")
    blocks = cut(counted.select("_about", F.ceil(F.col("n") / TILE_ASKED).cast("int").alias("_a"), F.ceil(F.col("k") / TILE_TOLD).cast("int").alias("_k")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda n: F.pmod(F.xxhash64("class", F.lit(n)), F.col(n)).cast("int")
    n = asked.join(blocks, "_about").select("_about", deal("_a").alias("_i"), every("_k").alias("_j"), "class", F.array_sort("_words").alias("words"), F.col(vector).cast("array<double>").alias("v"))
    k = told.join(blocks, "_about").select("_about", deal("_k").alias("_j"), every("_a").alias("_i"), F.array_sort("_words").alias("words"), F.col(vector).cast("array<double>").alias("v"), "paths")

    def half_up(s):
        """s in ten-thousandths as round(s, 4) has it: by its shortest decimal form where that is near a half."""
        scaled = s * 1e4
        out = np.floor(scaled + 0.5)
        for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5).ravel() < 1e-7):
            out.flat[i] = int((Decimal(repr(float(s.flat[i]))) * 10000).to_integral_value(ROUND_HALF_UP))
        return out

    def sets(column):
        """Which distinct set of words each row has, and these sets."""
        ids = {}
        at = np.array([ids.setdefault(tuple(w), len(ids)) for w in column], dtype=np.int64)
        return at, list(ids)

    def norms(m):
        total = np.zeros(len(m))
        for c in range(m.shape[1]):
            total += m[:, c] * m[:, c]
        return np.sqrt(total)

    schema = "class long, score double, path string, copies long"
    least = int(round(CONTRADICTION * 10000))

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        flat = sorted((p["path"], p["copies"], r) for r, ps in enumerate(right["paths"].to_pylist()) for p in ps)
        n_v, k_v = left["v"].to_pylist(), right["v"].to_pylist()
        n_set, n_sets = sets(left["words"].to_pylist())
        k_set, k_sets = sets(right["words"].to_pylist())
        holders = {}
        for i, words in enumerate(k_sets):
            for w in words:
                holders.setdefault(w, []).append(i)
        holders = {w: np.array(i) for w, i in holders.items()}
        k_size = np.array([len(w) for w in k_sets])
        classes = left["class"].to_numpy()
        for extent in {len(v) for v in n_v if v is not None and None not in v} & {len(v) for v in k_v if v is not None and None not in v}:
            rows = [f for f in flat if k_v[f[2]] is not None and len(k_v[f[2]]) == extent and None not in k_v[f[2]]]
            at = np.array([f[2] for f in rows])
            b = np.array([k_v[i] for i in at], dtype=float).reshape(len(at), extent)
            b_norm, b_set = norms(b), k_set[at]
            named = np.unique([f[0] for f in rows], return_inverse=True)[1] if rows else np.array([], int)
            own_path = len(rows) == 0 or named[-1] + 1 == len(rows)  # no path is there twice
            mine = [i for i, v in enumerate(n_v) if v is not None and len(v) == extent and None not in v]
            mine.sort(key=lambda i: n_set[i])
            step = max(1, TILE_PAIRS // max(1, len(rows)))
            last, other = None, None
            for start in range(0, len(mine), step):
                some = mine[start : start + step]
                a = np.array([n_v[i] for i in some], dtype=float).reshape(len(some), extent)
                dots = np.zeros((len(some), len(rows)))
                for c in range(extent):
                    dots += a[:, c, None] * b[None, :, c]
                norm = norms(a)[:, None] * b_norm[None, :]
                with np.errstate(all="ignore"):
                    s = half_up(np.where(norm == 0, 0.0, dots / norm))
                s[np.isnan(s)] = np.inf  # which Spark orders so
                for r, i in enumerate(some):
                    if n_set[i] != last:
                        last, words = n_set[i], n_sets[n_set[i]]
                        shared = np.zeros(len(k_sets), np.int64)
                        for w in words:
                            if w in holders:
                                shared[holders[w]] += 1
                        union = len(words) + k_size - shared
                        other = (np.where(union == 0, 0.0, shared / np.maximum(union, 1)) < OVERLAP)[b_set]
                    hits = np.flatnonzero(other & (s[r] >= least))
                    if not len(hits):
                        continue
                    value = s[r, hits]
                    if own_path and len(hits) > most + 1:
                        bound = np.partition(value, len(value) - most - 1)[len(value) - most - 1]
                        above, equal = hits[value > bound], hits[value == bound]
                        hits = np.concatenate([above, equal[: most + 1 - len(above)]])  # rows lie by path
                        value = s[r, hits]
                    seen = {}
                    for h in hits[np.lexsort((hits, -value))]:
                        if named[h] not in seen and len(seen) > most:
                            break
                        seen[named[h]] = seen.get(named[h], 0) + 1
                        if seen[named[h]] <= most:
                            found.append((int(classes[i]), s[r, h] / 1e4 if s[r, h] < np.inf else np.nan, rows[h][0], rows[h][1]))
        columns = list(zip(*found)) if found else [[], [], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.float64(), pa.string(), pa.int64()))], names=["class", "score", "path", "copies"])

    on = ["_about", "_i", "_j"]
    return n.groupBy(*on).cogroup(k.groupBy(*on)).applyInArrow(tile, schema)
