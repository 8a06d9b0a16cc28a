"""N-gram Jaccard join: size-banded tiles, hashed bitmaps that bound overlaps, exact intersections.

A text's set holds the hashes of its distinct word n-grams. Two sets link when 100 times their
intersection is at least `percent` times their union.

1. Sets meet by signatures. Sizes fall into bands so that a set links within its band or to the
   next one. The symmetric difference of two linked sets of a tile (a band and the next) is at most
   d; cut by hash range into more than d parts, they agree in a part. A signature is a hash of a
   part's content. Where parts may be empty, sets with many empty ones also emit their smallest
   hashes as a prefix filter does. So no link is lost, and an n-gram that thousands of texts share
   is no signature by itself.
2. The sets of a signature are a block: a pair, or one tile, or, if there are many, tiles of two
   chunks each, of the same band or of neighbouring ones.
3. Pairs and tiles of bitmaps, a few bits for each n-gram: the bit count of two bitmaps' exclusive
   or is no more than the symmetric difference, so it bounds the overlap from above. What is
   connected by pairs within the bound makes finer blocks.
4. Tiles of these blocks with the sets themselves: pairs that pass the bound and are not connected
   yet are intersected exactly. A tile returns a spanning forest of its links, never all pairs.
5. Components of these links are the classes.

Null texts, and texts without words, have the empty set and link with nothing. Equal sets are one
set from the start, so copies meet only as partial minima. Rows with a null id belong to a class
but never name it; a class without any id has a null one. Repeated rows get a row each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodewell.llm.common import LOWER, bounded_batches, byte_view, chunks, discard, fresh, keyed_texts, lookup, mix, plain_names, span_hashes, table, word_spans, written
from lodewell.llm.components import components

WORDS, PERCENT = 3, 90
#: Sets, and hashes in them, that a chunk holds on average at most; a tile holds two chunks. With bitmaps, and with sets.
MAP_TILE, SET_TILE = (2048, 8_000_000), (512, 500_000)
#: Bits of the filters that spare later passes most rows: bounded; what passes wrongly is sorted out by joins.
FILTER_BITS = 1 << 27

_WORD = lookup(lambda c: c != 32 and not 9 <= c <= 13)
#: Shifts of the 64-bit hash that a filter's three places are taken from.
_PROBES = (0, 18, 36)
_ODD = [np.uint64(x | 1) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def sets_of(texts: pa.Array, words: int = WORDS, seed: int = 0) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's n-grams; a text of fewer words has its whole sequence as one."""
    data, offsets = byte_view(texts)
    low = LOWER[data]
    starts, ends, count = word_spans(_WORD[low], offsets)
    word = span_hashes(low, starts, ends)
    gram = np.full(max(0, len(word) - words + 1), seed, np.uint64)
    for k in range(words):
        gram += word[k : k + len(gram)] * _ODD[k]
    gram = mix(gram)
    out, at = [], 0
    for n in count.tolist():
        if n >= words:
            out.append(np.unique(gram[at : at + n - words + 1]))
        elif n:
            whole = (word[at : at + n] * np.array(_ODD[:n])).sum(dtype=np.uint64, keepdims=True)
            out.append(mix((whole + np.uint64(n + seed)) ^ _ODD[-1]))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


class Bands:
    """Bands of sizes, each with the number of parts that sets of its tile are cut into."""

    def __init__(self, percent: int = PERCENT, largest: int = 1 << 40):
        self.percent, lows = percent, [1]
        while lows[-1] <= largest:  # at least as wide as a link reaches; wider bands put fewer sets into two tiles
            lows.append(max(100 * lows[-1] // percent + 1, int(1.3 * 100 * lows[-1] / percent)))
        self.lows = np.array(lows, np.int64)
        top = self.lows[1:] - 1
        self.reach = 100 * top // percent  # the largest size that a set of the band links with
        self.parts, self.slack = [], []
        for low, high, reach in zip(lows, top.tolist(), self.reach.tolist()):
            d = (high + reach) * (100 - percent) // (100 + percent)
            e = int(2 * (d + 1) * np.exp(-low / (d + 1))) if d else 0
            self.parts.append(d + 1 + e)
            self.slack.append(e)
        self.cuts: dict = {}

    def band(self, size: int) -> int:
        return int(np.searchsorted(self.lows, size, side="right")) - 1

    def tiles(self, size: int) -> list[int]:
        band = self.band(size)
        return [band, band - 1] if band and size <= self.reach[band - 1] else [band]

    def allowed(self, a, b):
        """The largest symmetric difference of linked sets of these sizes."""
        return a + b - 2 * (-(-self.percent * (a + b) // (100 + self.percent)))

    def signatures(self, hashes: np.ndarray) -> np.ndarray:
        if not len(hashes):
            return np.zeros(0, np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ _ODD[0]), dtype=np.uint64)])
        high, out = hashes >> np.uint64(32), []
        for tile in self.tiles(len(hashes)):
            parts = self.parts[tile]
            if tile not in self.cuts:
                self.cuts[tile] = np.array([-(-(k << 32) // parts) for k in range(parts + 1)], np.uint64)
            at = np.searchsorted(high, self.cuts[tile])
            full = np.flatnonzero(at[1:] > at[:-1])
            content = sums[at[full + 1]] - sums[at[full]]
            salt = np.array([tile + 1], np.uint64)
            out.append(mix(content + salt * _ODD[1] + full.astype(np.uint64) * _ODD[2]))
            if parts - len(full) > self.slack[tile]:
                prefix = len(hashes) - -(-self.percent * len(hashes) // 100) + 1
                out.append(mix(hashes[:prefix] + salt * _ODD[3]))
        return np.concatenate(out)


def parity_map(hashes: np.ndarray) -> bytes:
    """A bit for each residue of the hashes, set where an odd number of them has it; as many bits as hashes or up to twice, 64 to 65536."""
    bits = 1 << int(np.clip((len(hashes) - 1).bit_length(), 6, 16))
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


SETS = "doc_id long, size long, set_id long, second long, map binary, signatures array<long>"


def signed_sets(docs: DataFrame, words: int, percent: int, seed: int) -> DataFrame:
    """For each text the size of its set, two hashes and the bitmap of the set, and its signatures."""

    def run(batches):
        bands = Bands(percent)
        for batch in batches:
            for part in chunks(batch):
                sets = sets_of(part.column(1), words, seed)
                signed = [bands.signatures(s) for s in sets]
                ids = np.array([[mix(s ^ _ODD[k]).sum(dtype=np.uint64) if len(s) else 0 for s in sets] for k in (3, 4)], np.uint64).view(np.int64)
                empty = np.array([not len(s) for s in sets])
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, signed)]), pa.int32()), pa.array(np.concatenate(signed).view(np.int64), pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids[0], mask=empty), pa.array(ids[1], mask=empty), pa.array([parity_map(s) if len(s) else None for s in sets], pa.binary()), lists], names=["doc_id", "size", "set_id", "second", "map", "signatures"])

    return docs.mapInArrow(run, SETS)


def bit_filter(values: DataFrame, count: int) -> tuple[int, np.ndarray]:
    """(bits - 1, words) of a Bloom filter of the only column: 16 bits a value, at most FILTER_BITS, so 16 MB on the driver."""
    bits = 1 << max(10, min(FILTER_BITS.bit_length() - 1, (16 * count).bit_length()))
    hashed = F.xxhash64(values.columns[0])
    probes = F.explode(F.array(*[F.shiftright(hashed, shift).bitwiseAND(F.lit(bits - 1)) for shift in _PROBES]))
    words = np.zeros(bits >> 6, np.uint64)
    for row in values.select(probes.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("set")).toLocalIterator():
        words[row["word"]] = np.uint64(row["set"] & 0xFFFFFFFFFFFFFFFF)
    return bits - 1, words


def in_filter(filter_: tuple[int, np.ndarray], hashed: np.ndarray) -> np.ndarray:
    found = np.ones(len(hashed), bool)
    for shift in _PROBES:
        at = (hashed >> shift) & filter_[0]
        found &= ((filter_[1][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
    return found


def shared_signatures(sets: DataFrame) -> DataFrame:
    """(set_id, signature) of signatures that several sets, or copies of one, have; each once, written."""
    counted = sets.select(F.explode("signatures").alias("signature")).groupBy("signature").agg(F.count("*").alias("n"))
    seen = written(counted.where("n > 1").select("signature"), "signatures")
    wanted = sets.sparkSession.sparkContext.broadcast(bit_filter(seen, seen.count()))
    hashed = sets.where("set_id IS NOT NULL").select("set_id", "signatures", F.transform("signatures", lambda s: F.xxhash64(s)).alias("hashed"))

    def passing(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                lists = part.column(1)
                counts = np.diff(np.asarray(lists.offsets))
                ok = np.flatnonzero(in_filter(wanted.value, np.asarray(part.column(2).flatten())))
                rows = np.repeat(np.arange(part.num_rows), counts)[ok]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), lists.flatten().take(pa.array(ok))], names=["set_id", "signature"])

    pairs = written(hashed.mapInArrow(passing, "set_id long, signature long").distinct(), "signed")
    discard(seen, tidy=True)
    return pairs


def pairs_in_bound(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose bitmaps don't rule out a link; `maps` has set_id, size and content."""

    def run(batches):
        bands = Bands(percent)
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                ok = [bool(links_in_tile(np.array([m, n]), [x, y], None, np.zeros(2), True, bands)) for m, x, n, y in zip(*(c.to_pylist() for c in part.columns[2:]))]
                yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    first = maps.select(F.col("set_id").alias("a"), F.col("size").alias("m"), F.col("content").alias("x"))
    second = maps.select(F.col("set_id").alias("b"), F.col("size").alias("n"), F.col("content").alias("y"))
    # sizes alone rule most pairs out before any bitmap moves
    near = pairs.join(first.drop("x"), "a").join(second.drop("y"), "b").where(f"100 * least(m, n) >= {percent} * greatest(m, n)").select("a", "b")
    return near.join(first, "a").join(second, "b").select("a", "b", "m", "x", "n", "y").mapInArrow(run, "a long, b long")


def near_pairs(sets: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs within the bound that connect all sets of a signature which pairs within the bound connect; written."""
    signed = shared_signatures(sets)
    groups = signed.groupBy("signature").agg(F.count("*").alias("n"), F.min("set_id").alias("a"), F.max("set_id").alias("b")).where("n > 1")
    groups = written(groups, "signature-groups")
    pairs = written(pairs_in_bound(groups.where("n = 2").select("a", "b").distinct(), maps, percent), "pairs")
    many = signed.join(groups.where("n > 2").select("signature"), "signature").withColumnRenamed("signature", "block")
    many = written(many.join(maps.select("set_id", "size"), "set_id"), "many")
    discard(signed)
    tiled = tiles_of(many, percent, MAP_TILE).join(maps, "set_id")
    found = written(pairs.unionByName(links(tiled, percent, False).distinct()), "near-pairs")
    discard(many, tidy=True)
    return found


def tiles_of(blocks: DataFrame, percent: int, most: tuple[int, int]) -> DataFrame:
    """(set_id, tile, side, whole): the tiles that each set of rows (set_id, size, block) goes to."""
    # the band as Bands has it: the bounds are few and the same for all rows
    lows = [int(x) for x in Bands(percent).lows]
    band = F.aggregate(F.array(*map(F.lit, lows)), F.lit(-1), lambda n, low: n + (low <= F.col("size")).cast("int"))
    rows = written(blocks.select("set_id", "size", "block").withColumn("band", band), "blocks")
    chunk_count = F.ceil(F.greatest(F.col("sets") / most[0], F.col("hashes") / most[1])).cast("int")
    total = rows.groupBy("block").agg(F.count("*").alias("sets"), F.sum("size").alias("hashes")).select("block", (chunk_count > 1).alias("large"))
    by_band = rows.groupBy("block", "band").agg(F.count("*").alias("sets"), F.sum("size").alias("hashes")).select("block", "band", chunk_count.alias("chunks"))
    large = total.where("large").select("block")
    small = rows.join(large, "block", "left_anti").select("set_id", F.xxhash64("block").alias("tile"), F.lit(0).alias("side"), F.lit(True).alias("whole"))
    counts = by_band.join(large, "block")
    split = (
        rows.join(counts, ["block", "band"])
        .join(counts.select("block", (F.col("band") - 1).alias("band"), F.col("chunks").alias("above")), ["block", "band"], "left")
        .join(counts.select("block", (F.col("band") + 1).alias("band"), F.col("chunks").alias("below")), ["block", "band"], "left")
        .withColumn("chunk", F.pmod(F.xxhash64("set_id"), F.col("chunks")).cast("int"))
    )
    own = "transform(sequence(0, chunks - 1), j -> struct(xxhash64(block, band, least(chunk, j), band, greatest(chunk, j)) AS tile, cast(j < chunk AS int) AS side, j = chunk AS whole))"
    up = "CASE WHEN above > 0 THEN transform(sequence(0, above - 1), j -> struct(xxhash64(block, band, chunk, band + 1, j) AS tile, 0 AS side, false AS whole)) ELSE array() END"
    down = "CASE WHEN below > 0 THEN transform(sequence(0, below - 1), j -> struct(xxhash64(block, band - 1, j, band, chunk) AS tile, 1 AS side, false AS whole)) ELSE array() END"
    split = split.select("set_id", F.explode(F.expr(f"concat({own}, {up}, {down})")).alias("t")).select("set_id", "t.tile", "t.side", "t.whole")
    return small.unionByName(split)


def folded(maps: list[bytes], bits: int) -> np.ndarray:
    """Bitmaps of `bits` or twice as many bits as rows of words; the longer ones' halves are laid on each other."""
    out = np.zeros((len(maps), bits // 64), np.uint64)
    for i, m in enumerate(maps):
        words = np.frombuffer(m, np.uint64)
        out[i] = words if len(words) == bits // 64 else words[: bits // 64] ^ words[bits // 64 :]
    return out


def intersection(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def links_in_tile(size: np.ndarray, maps: list[bytes], sets: list[np.ndarray] | None, side: np.ndarray, whole: bool, bands: Bands) -> list[tuple[int, int]]:
    """A spanning forest of a tile's links, or without sets of the pairs within the bound; between its two sides only, unless it is whole."""
    order = np.argsort(size, kind="stable")
    size, side = size[order], side[order]
    width = np.array([8 * len(maps[i]) for i in order])
    root, out = np.arange(len(order)), []
    for bits in np.unique(width).tolist():
        first, end_own, end_both = (int(np.searchsorted(width, b)) for b in (bits, bits + 1, 2 * bits + 1))
        held = folded([maps[i] for i in order[first:end_both]], bits)
        for i in range(first, end_own):
            end = min(end_both, int(np.searchsorted(size, 100 * size[i] // bands.percent, side="right")))
            others = np.arange(i + 1, max(i + 1, end))
            others = others[(root[others] != root[i]) & (True if whole else side[others] != side[i])]
            if not len(others):
                continue
            differ = np.bitwise_count(held[others - first] ^ held[i - first]).sum(axis=1, dtype=np.int64)
            for j in others[differ <= bands.allowed(size[i], size[others])].tolist():
                if root[j] == root[i]:
                    continue
                if sets is not None:
                    both = intersection(sets[order[i]], sets[order[j]])
                    if 100 * both < bands.percent * (size[i] + size[j] - both):
                        continue
                out.append((int(order[i]), int(order[j])))
                root[root == root[j]] = root[i]
    return out


def links(tiled: DataFrame, percent: int, exact: bool) -> DataFrame:
    """Links (a, b) from rows (tile, side, whole, set_id, content); each task holds one tile at a time.

    The content is the set if `exact`, else its size and bitmap, and pairs within the bound count as links.
    """

    def run(batches):
        bands, tile, held = Bands(percent), None, {}

        def flush():
            ids = list(held)
            if len(ids) < 2:
                return []
            rows = [held[i] for i in ids]
            sets = [np.frombuffer(r[3], np.uint64) for r in rows] if exact else None
            maps = [parity_map(s) for s in sets] if exact else [r[3] for r in rows]
            pairs = links_in_tile(np.array([r[2] for r in rows]), maps, sets, np.array([r[0] for r in rows]), rows[0][1], bands)
            return [(ids[a], ids[b]) for a, b in pairs]

        def out(pairs):
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            found = []
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                for t, side, whole, set_id, size, content in zip(*(c.to_pylist() for c in part.columns)):
                    if t != tile:
                        found += flush()
                        tile, held = t, {}
                    held[set_id] = (side, whole, size, content)
            yield out(found)
        yield out(flush())

    parts = int(tiled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = tiled.select("tile", "side", "whole", "set_id", "size", "content").repartition(parts, "tile").sortWithinPartitions("tile", "set_id")
    return rows.mapInArrow(run, "a long, b long")


def candidate_sets(docs: DataFrame, wanted: DataFrame, words: int, seed: int) -> DataFrame:
    """(set_id, hashes) of the wanted sets (set_id, rid), and of a few others, computed again from the texts of the documents `rid`."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted.select("rid"), wanted.count()))

    def run(batches):
        for batch in batches:
            some = batch.filter(pa.array(in_filter(shared.value, batch.column(1).to_numpy(zero_copy_only=False))))
            for part in chunks(some):
                sets = sets_of(part.column(0), words, seed)
                ids = np.array([mix(s ^ _ODD[3]).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["set_id", "hashes"])

    found = docs.select("text", F.xxhash64("doc_id").alias("hashed")).mapInArrow(run, "set_id long, hashes binary")
    return found.groupBy("set_id").agg(F.first("hashes").alias("content"))


def classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row."""
    return class_rows(docs, words, percent, id_col, text_col)[0].select("doc_id", "n_shingles", "component_id")


def class_rows(docs: DataFrame, words: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """doc_id, n_shingles, component_id, set_id and root for each row, and the seed of the set_ids; an empty set has no set_id and no root."""
    docs = keyed_texts(docs, id_col, text_col)
    for seed in range(8):
        signed = written(signed_sets(docs, words, percent, seed), "signed-sets")
        grouped = signed.where("size > 0").groupBy("set_id").agg(F.min("doc_id").alias("rid"), F.first("size").alias("size"), F.first("map").alias("map"), F.min("second").alias("low"), F.max("second").alias("high"))
        named = written(grouped, "named-sets")
        if named.where("low <> high").isEmpty():  # else two sets share a 64-bit hash: another seed parts them
            break
    sets = written(signed.select("doc_id", "size", "set_id"), "sets")
    near = near_pairs(signed, named.select("set_id", "size", F.col("map").alias("content")), percent)
    discard(signed)
    finer = in_blocks(components(near), named.select("set_id", "rid", "size"))
    hashes = candidate_sets(docs, finer.select("set_id", "rid"), words, seed)
    tiled = tiles_of(finer, percent, SET_TILE).join(finer.select("set_id", "size"), "set_id").join(hashes, "set_id")
    linked = components(links(tiled, percent, True)).withColumnRenamed("node", "set_id")
    rooted = written(named.select("set_id", "rid").join(linked, "set_id", "left").select("set_id", "rid", F.coalesce("root", "set_id").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("rid").alias("component_id"))
    of_set = rooted.join(least, "root").select("set_id", "component_id", "root")
    some = sets.where("size > 0").select("doc_id", "size", "set_id").join(of_set, "set_id").select("doc_id", F.col("size").alias("n_shingles"), "component_id", "set_id", "root")
    none = F.lit(None).cast("long")
    return some.unionByName(sets.where("size = 0").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"), none.alias("set_id"), none.alias("root"))), seed


def in_blocks(components_: DataFrame, sets: DataFrame) -> DataFrame:
    return written(components_.select(F.col("node").alias("set_id"), F.col("root").alias("block")).join(sets, "set_id"), "candidates")


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of the least id of each class, with all its columns; an empty text is a class of its own with its id.

    A filter of bounded size tells most rows that stay without moving them; the rest are joined
    exactly. Where several rows of a class have its least id, or none has an id, the least set and
    then the least text stays. Rows without an id give way to those with one.
    """
    docs, had = plain_names(docs)
    names = docs.columns
    hashed, set_, owner, stays_, row = fresh(names, "_hashed_id", "_set", "_owner", "_stays", "_row")
    bounded_batches(docs.sparkSession)
    rows, seed = class_rows(docs, words, percent)
    found = written(rows, "classes")
    ids = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max((F.col("component_id") < F.col("doc_id")).cast("int")).alias("dropped")).where("dropped = 1 OR n > 1 OR doc_id IS NULL")
    ids = written(ids.select("doc_id", F.expr("n > 1 OR doc_id IS NULL").alias("several")), "dropped")
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(ids.select("doc_id"), ids.count()))

    def side(hit):
        def run(batches):
            for batch in batches:
                at = batch.schema.get_field_index(hashed)
                found = in_filter(shared.value, batch.column(at).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([c for i, c in enumerate(batch.columns) if i != at], names=[n for i, n in enumerate(batch.schema.names) if i != at]).filter(pa.array(found == hit))

        return docs.withColumn(hashed, F.xxhash64("doc_id")).mapInArrow(run, docs.schema)

    single = side(False).unionByName(side(True).where("doc_id IS NOT NULL").join(ids.select("doc_id"), "doc_id", "left_anti").select(*names))
    several = written(ids.where("several").select(F.col("doc_id").alias(owner)), "several")
    if several.isEmpty():
        return single.toDF(*had)

    # an id that is no row's own tells nothing: these rows are judged by id and set
    least = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stays = least.where("set_id IS NOT NULL").groupBy("root", "doc_id").agg(F.min("set_id").alias(stays_)).select(F.col("doc_id").alias(owner), stays_)
    kind = StructType([*docs.schema, StructField(set_, LongType())])

    def sets(batches):
        for batch in batches:
            for part in chunks(batch):
                found = sets_of(part.column(part.schema.get_field_index("text")), words, seed)
                ids = np.array([mix(s ^ _ODD[3]).sum(dtype=np.uint64) if len(s) else 0 for s in found], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.int64(), mask=np.array([not len(s) for s in found]))], names=[*part.schema.names, set_])

    shared_ids = side(True).join(several, F.col("doc_id").eqNullSafe(F.col(owner)), "left_semi")
    judged = shared_ids.mapInArrow(sets, kind)
    full = judged.where(F.col(set_).isNotNull()).join(stays, F.col("doc_id").eqNullSafe(F.col(owner)) & (F.col(set_) == F.col(stays_)), "left_semi")
    one = lambda df, *by: df.groupBy(*by).agg(F.min_by(F.struct(*names), F.struct("text")).alias(row)).select(f"{row}.*")
    return single.unionByName(one(full, "doc_id", set_)).unionByName(one(judged.where(F.col(set_).isNull()), "doc_id", "text")).toDF(*had)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d
), grams AS (SELECT doc_id, unnest(s) AS g, len(s) AS n FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
walk AS (SELECT doc_id AS node, doc_id AS root FROM sets UNION SELECT b, root FROM walk JOIN both_ways ON a = node WHERE b > root)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM sets JOIN (SELECT node, min(root) AS component_id FROM walk GROUP BY node) ON node = doc_id
"""
