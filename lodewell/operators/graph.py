"""Graph operators on edge tables (src, dst): degrees, reach, components, cycles, ranks, communities.

Iterations are cut by checkpoints in the folder that the cluster names; every frontier is a join,
and what has been seen is an anti-join, so no step holds the graph in one place. Communities are found by
moves of independent nodes; `louvain` is the sequential form, for small graphs and to compare with.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Rounds of an iteration between two checkpoints.
CUT_ROUNDS = 3
#: Fixed value: the least cosine of synonyms.
SYNONYM = 0.8


def shared_dir(spark) -> str:
    """The folder that all executors see: spark.checkpoint.dir, else the warehouse's; in local mode without one, a temporary folder."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        configured = context.getConf().get("spark.checkpoint.dir")
        if not configured and (context.master.startswith("local-cluster") or not context.master.startswith("local")):
            configured = spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="lodewell-"))
    return context.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, inbound, outbound) for every node, those without edges too; one shuffle of partial counts."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    rows = ends.unionByName(nodes.select("node", F.lit(0).alias("i"), F.lit(0).alias("o")))
    return rows.groupBy("node").agg(F.sum("i").alias("inbound"), F.sum("o").alias("outbound"))


def reach(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(node, hops): what lies within `hops` steps along the edges, with the least number of steps."""
    seen = cut(seeds.select("node").distinct().withColumn("hops", F.lit(0)))
    frontier = seen.select("node")
    for hop in range(1, hops + 1):
        step = edges.join(frontier.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.withColumn("hops", F.lit(hop)))
    return seen


def impact(calls: DataFrame, symbol, hops: int = 5) -> DataFrame:
    """Transitive callers of a symbol, from calls (src calls dst), with their distance."""
    spark = calls.sparkSession
    seed = spark.range(1).select(F.lit(symbol).alias("node"))
    return reach(calls.select(F.col("dst").alias("src"), F.col("src").alias("dst")), seed, hops).where("hops > 0")


def call_chain(edges: DataFrame, source, target, hops: int = 20) -> DataFrame:
    """The shortest path from source to target as an array, the least one of these; empty if there is none."""
    spark = edges.sparkSession
    frontier = spark.range(1).select(F.lit(source).alias("node"), F.array(F.lit(source)).alias("path"))
    seen = frontier.select("node")
    for _ in range(hops):
        found = frontier.where(F.col("node") == target)
        if not found.isEmpty():
            return found.orderBy("path").limit(1).select("path", (F.size("path") - 1).alias("length"))
        step = edges.join(frontier.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        frontier = cut(step.join(seen, "node", "left_anti").groupBy("node").agg(F.min("path").alias("path")))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier.select("node"))
    return frontier.where(F.col("node") == target).select("path", (F.size("path") - 1).alias("length"))


def _stars(edges: DataFrame) -> bool:
    """Whether each node of edges (a, b) has one edge up, or only edges down."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    up = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    return up.where("up > 1 OR up = 1 AND least = 0").isEmpty()


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component), the least node of each component; by alternating large-star and small-star rounds until all are stars."""
    now = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    while not _stars(now):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = cut(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        now = cut(small.select("a", F.col("m").alias("b")).union(small.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct())
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    if nodes is None:
        return found
    return nodes.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of cycles, by colouring: greatest node that reaches each node, then what it reaches back.

    Nodes without an inbound or outbound edge are peeled off first and between rounds. Only what a step
    has changed takes the next one, and the lineage is cut every CUT_ROUNDS steps. Each round
    finds one component at least, and rounds go on until no edge is left.
    """
    left = cut(edges.where("src <> dst").select("src", "dst").distinct())
    n, done = left.count(), None
    while n:
        while True:  # peel
            before = n
            left = cut(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            n = left.count()
            if n == before:
                break
        if n == 0:
            break
        # a node's colour, and the one it had a step before: only nodes whose colour has changed pass it on
        colour = left.select(F.col("src").alias("node")).union(left.select("dst")).distinct().select("node", F.col("node").alias("colour"), F.lit(None).cast(dict(left.dtypes)["src"]).alias("old"))
        while True:
            for _ in range(CUT_ROUNDS):
                pushed = left.join(colour.where("old IS NULL OR old <> colour").select(F.col("node").alias("src"), "colour"), "src").select(F.col("dst").alias("node"), "colour", F.lit(None).alias("old"))
                colour = colour.select("node", "colour", F.col("colour").alias("old")).union(pushed).groupBy("node").agg(F.max("colour").alias("colour"), F.max("old").alias("old"))
            colour = cut(colour)
            if colour.where("old <> colour").isEmpty():
                break
        # within a colour, what reaches its root is the root's component
        inside = left.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("c")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("d")), "dst").where("c = d").select("src", "dst")
        inside = cut(inside)
        member = colour.where("node = colour").select("node", "colour", F.lit(True).alias("fresh"))
        while True:
            for _ in range(CUT_ROUNDS):
                step = inside.join(member.where("fresh").select(F.col("node").alias("dst"), "colour"), "dst").select(F.col("src").alias("node"), "colour", F.lit(True).alias("fresh"))
                member = member.select("node", "colour", F.lit(False).alias("fresh")).union(step).groupBy("node", "colour").agg(F.min("fresh").alias("fresh"))
            member = cut(member)
            if member.where("fresh").isEmpty():
                break
        member = member.select("node", "colour")
        done = member if done is None else cut(done.union(member))
        gone = member.select("node")
        left = cut(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
        n = left.count()
    if done is None:
        done = edges.select(F.col("src").alias("node"), F.col("src").alias("colour")).limit(0)
    size = done.groupBy("colour").agg(F.count("*").alias("size"), F.min("node").alias("component")).where("size >= 2")
    return done.join(size, "colour").select("node", "component", "size")


def recall_graph(links: DataFrame, mentions: DataFrame, synonyms: DataFrame, cap: float = 2.0) -> DataFrame:
    """(src, dst, w) both ways: links weigh 1, mentions 0.7, synonyms half their cosine; parallel edges add up to `cap` at most."""
    rows = links.select("src", "dst", F.lit(1.0).alias("w")).unionByName(mentions.select("src", "dst", F.lit(0.7).alias("w"))).unionByName(synonyms.select("src", "dst", (0.5 * F.col("score")).alias("w")))
    rows = rows.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w").groupBy("src", "dst").agg(F.least(F.lit(cap), F.sum("w")).alias("w"))
    return rows.unionByName(rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, restart: float = 0.15, rounds: int = 30, tolerance: float = 1e-6) -> DataFrame:
    """(node, score) of walks over edges (src, dst, w) that restart at the seeds.

    A step's chance grows with the edge's weight times ln(1 + N / (1 + degree of its end)), which
    damps hubs. What reaches a node without edges is lost. The last round's change is looked at, and
    the lineage cut, every CUT_ROUNDS rounds. Edges lie by src for all rounds and are not shuffled again.
    """
    rounds_kept = Rounds(edges.sparkSession)
    edges = cut(edges.select("src", "dst", "w"))
    degree = cut(edges.groupBy("src").agg(F.sum("w").alias("degree")))
    n = degree.count()
    joined = F.broadcast if n <= NODES_SENT else lambda d: d
    damped = edges.join(joined(degree.select(F.col("src").alias("dst"), "degree")), "dst").select("src", "dst", (F.col("w") * F.log(1 + n / (1 + F.col("degree")))).alias("w"))
    total = damped.groupBy("src").agg(F.sum("w").alias("total"))
    steps = rounds_kept.held("steps", damped.join(joined(total), "src").select("src", "dst", (F.col("w") / F.col("total")).alias("p")), False)
    start = seeds.select("node").distinct().join(degree.select(F.col("src").alias("node")), "node", "left_semi")
    count = start.count()
    base = cut(start.withColumn("score", F.lit(restart / max(1, count))))
    now = cut(start.withColumn("score", F.lit(1.0 / max(1, count))))
    done = 0
    while count and done < rounds:
        following = now
        for _ in range(min(CUT_ROUNDS, rounds - done)):
            before = following
            moved = steps.join(following.withColumnRenamed("node", "src").hint("shuffle_hash"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("p") * F.col("score") * (1 - restart)).alias("score"))
            following = moved.unionByName(base).groupBy("node").agg(F.sum("score").alias("score"))
            done += 1
        both = cut(following.join(before.withColumnRenamed("score", "old"), "node", "full_outer").select("node", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("old", F.lit(0.0)).alias("old")))
        change = both.agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0] or 0.0
        now = both.where("score > 0").select("node", "score")
        if change < tolerance:
            break
    rounds_kept.let_go("steps")
    return now


def louvain(nodes: list, edges: list[tuple]) -> tuple[dict, float]:
    """Communities (node -> least member) and modularity, nodes in order, moves only on strict improvement."""
    index = {n: i for i, n in enumerate(sorted(nodes))}
    order = sorted(nodes)
    weight: dict[int, dict[int, float]] = {i: {} for i in index.values()}
    for a, b, w in edges:
        if a in index and b in index and a != b and w > 0:
            for x, y in ((index[a], index[b]), (index[b], index[a])):
                weight[x][y] = weight[x].get(y, 0.0) + w
    loops = dict.fromkeys(weight, 0.0)
    double = sum(sum(v.values()) for v in weight.values())
    member = {i: i for i in weight}
    if not double:
        return {n: n for n in order}, 0.0
    for _ in range(20):
        home = {i: i for i in weight}
        strength = {i: sum(v.values()) + 2 * loops[i] for i, v in weight.items()}
        total = dict(strength)
        moved = False
        for _ in range(100):
            now = False
            for i in sorted(weight):
                to: dict[int, float] = {}
                for j, w in weight[i].items():
                    to[home[j]] = to.get(home[j], 0.0) + w
                old = home[i]
                total[old] -= strength[i]
                best, gain = old, to.get(old, 0.0) - total[old] * strength[i] / double
                for c in sorted(to):
                    g = to[c] - total[c] * strength[i] / double
                    if g > gain + 1e-12:
                        best, gain = c, g
                total[best] += strength[i]
                if best != old:
                    home[i], now, moved = best, True, True
            if not now:
                break
        member = {n: home[c] for n, c in member.items()}
        if not moved:
            break
        joined: dict[int, dict[int, float]] = {c: {} for c in set(home.values())}
        inner = dict.fromkeys(joined, 0.0)
        for i, v in weight.items():
            inner[home[i]] += loops[i]
            for j, w in v.items():
                if home[i] == home[j]:
                    inner[home[i]] += w / 2
                else:
                    joined[home[i]][home[j]] = joined[home[i]].get(home[j], 0.0) + w
        weight, loops = joined, inner
    strength = {i: sum(v.values()) + 2 * loops[i] for i, v in weight.items()}
    modularity = sum(2 * loops[i] / double - (strength[i] / double) ** 2 for i in weight)
    least: dict[int, int] = {}
    for n, c in member.items():
        least[c] = min(least.get(c, n), n)
    return {order[n]: order[least[c]] for n, c in member.items()}, modularity


class Rounds:
    """Tables of an iteration as Parquet in the shared folder; of each name the last three are there, the ones before are deleted."""

    def __init__(self, spark):
        self.spark, self.folder, self.paths, self.memory = spark, f"{shared_dir(spark)}/rounds-{uuid.uuid4().hex}", {}, {}

    def kept(self, name: str, df: DataFrame) -> DataFrame:
        paths = self.paths.setdefault(name, [])
        path = f"{self.folder}/{name}-{len(paths)}"
        df.write.parquet(path)
        paths.append(path)
        if len(paths) > 3:
            old = self.spark._jvm.org.apache.hadoop.fs.Path(paths[-4])
            old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)
        return self.spark.read.schema(df.schema).parquet(path)

    def held(self, name: str, df: DataFrame, sent: bool) -> DataFrame:
        """df, kept, and held by the executors in partitions of equal src, until the next one of that name; what is lost is read again."""
        df = self.kept(name, df)
        n = df.count()
        least = min(self.spark.sparkContext.defaultParallelism, -(-n // 20_000)) if sent else int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        parts = max(1, least, -(-n // EDGES_HELD))
        self.let_go(name)
        self.memory[name] = df.repartition(parts, "src").persist()
        return self.memory[name]

    def let_go(self, name: str) -> None:
        if name in self.memory:
            self.memory.pop(name).unpersist()


#: Levels of contraction, rounds of moves in a level, and the gain of modularity and share of nodes that a round must reach for another one.
LEVELS, MOVE_ROUNDS, LEAST_GAIN, LEAST_MOVED = 20, 100, 1e-5, 0.002
#: If fewer than one in DENSE of those that want to move are independent of each other, the next round is a loose one.
DENSE = 8
#: How freely nodes move at once: independent ones, none after another, or every second one.
STRICT, LOOSE, HALF = 0, 1, 2
#: A graph of at most so many nodes sends their list (five numbers each) to every task, one of more joins it by shuffles; edges of a partition that is held.
NODES_SENT, EDGES_HELD = 1 << 20, 500_000


def _moves(rounds: Rounds, edges: DataFrame, nodes: DataFrame, double: float, number: int, free: int, sent: bool) -> DataFrame:
    """nodes (node, community, strength, loop) with `inside`, the weight to their own community, its `total`, and `to`, where those that may move now go.

    A node wants the community of the greatest gain, the least one of equals, if that is better than its
    own. It waits while an adjacent node of a greater hash in this round wants to move too, so movers are
    independent; with `free` 1 (LOOSE) only while that one wants to leave where it would go, or to come where it
    is, so that at least no two swap or follow each other; with `free` 2 (HALF) those wait that a hash of this round says, about half.

    `edges` lie by src. With `sent` the nodes go to every task, and no edge is shuffled; else a node's
    community and its total ride along its edges, which are shuffled once.
    """
    totals = nodes.groupBy("community").agg(F.sum("strength").alias("total"))
    own = nodes.join(totals, "community").select("node", "community", "strength", "loop", "total")
    joined = F.broadcast if sent else lambda d: d.hint("shuffle_hash")  # a node is one row, so no side that is built is skewed
    end = "dst" if sent else "src"
    there = own.select(F.col("node").alias(end), F.col("community").alias("c"), F.col("total").alias("c_total"))
    near = edges.join(joined(there), end)
    near = near.withColumnRenamed("src", "node") if sent else near.withColumnRenamed("dst", "node").repartition("node")
    near = near.groupBy("node", "c").agg(F.sum("w").alias("w"), F.first("c_total").alias("c_total"))
    offers = near.join(joined(own.select("node", "community", "strength", "total")), "node")
    same = F.col("c") == F.col("community")
    gain = F.round(F.col("w") - F.when(same, F.col("total") - F.col("strength")).otherwise(F.col("c_total")) * F.col("strength") / double, 9)
    best = offers.withColumn("gain", gain).groupBy("node").agg(
        F.min(F.when(~same, F.struct((-F.col("gain")).alias("minus"), "c"))).alias("best"), F.max(F.when(same, F.col("w"))).alias("inside")
    )
    stay = F.round(F.coalesce("inside", F.lit(0.0)) - (F.col("total") - F.col("strength")) * F.col("strength") / double, 9)
    asked = own.join(best, "node", "left").select("node", "community", "strength", "loop", F.coalesce("inside", F.lit(0.0)).alias("inside"), "total", F.when(-F.col("best.minus") > stay + 1e-9, F.col("best.c")).alias("wish"))
    asked = rounds.kept("asked", asked)
    if free == HALF:
        return rounds.kept("moves", asked.withColumn("to", F.when(F.xxhash64("node", F.lit(number)) % 2 == 0, F.col("wish"))))
    first = lambda c: F.struct(F.xxhash64(c, F.lit(number)), c)
    movers = asked.where("wish IS NOT NULL").select("node", "community", "wish")
    one, other = (movers.select(F.col("node").alias(end), F.col("community").alias(f"{end}_in"), F.col("wish").alias(f"{end}_to")) for end in ("src", "dst"))
    beside = edges.drop("w").join(joined(one), "src").join(joined(other), "dst").where(first("dst") > first("src"))
    if free == LOOSE:
        beside = beside.where("src_to = dst_in OR dst_to = src_in")
    blocked = beside.select(F.col("src").alias("node")).distinct().withColumn("blocked", F.lit(True))
    return rounds.kept("moves", asked.join(blocked, "node", "left").withColumn("to", F.when(F.col("blocked").isNull(), F.col("wish"))).drop("blocked"))


def communities(edges: DataFrame, kind: str = "long", loose: bool = False) -> DataFrame:
    """(node, community, modularity of the whole partition) from edges (src, dst, w), by the Louvain method in parallel; a community is named by its least node.

    Each round is joins and sums over the edges, which lie by their src for a whole level: every node's weight to the communities around it, the
    gains, and moves of independent nodes all at once; `loose` moves more at once, in fewer rounds, to
    communities that may be a little worse. In dense graphs, where few are independent, every second node moves at once, until that does harm; then fewer. Rounds go on while modularity grows; what lowers it is taken back. Then communities become nodes, loops what lies within them, until nothing moves.
    No component, community or list of nodes is ever in one task. Edges without weight, loops of the
    input and repeated edges are left out, kept as loops, and added up. No edges give no rows.
    """
    spark = edges.sparkSession
    rounds = Rounds(spark)
    named = edges.where("w > 0").select(F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst"), F.col("w").cast("double").alias("w"))
    pairs = named.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("w").alias("w"))
    loops = pairs.where("src = dst").select(F.col("src").alias("node"), F.col("w").alias("loop"))
    both = pairs.where("src <> dst")
    now = rounds.kept("edges", both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")))
    strength = now.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("s")).join(loops, "node", "full_outer")
    strength = strength.select("node", F.col("node").alias("community"), (F.coalesce("s", F.lit(0.0)) + 2 * F.coalesce("loop", F.lit(0.0))).alias("strength"), F.coalesce("loop", F.lit(0.0)).alias("loop"))
    nodes = rounds.kept("nodes", strength)
    double, count = nodes.agg(F.sum("strength"), F.count("*")).first()
    now = rounds.held("edges", now, count <= NODES_SENT)
    member = rounds.kept("member", nodes.select("node", F.col("node").alias("community")))
    quality = 0.0
    for level in range(LEVELS if double else 0):
        best, before, moved, free, freest = None, None, False, LOOSE if loose else STRICT, HALF
        for number in range(MOVE_ROUNDS):
            moves = _moves(rounds, now, nodes, double, number, free, count <= NODES_SENT)
            sums = moves.agg(F.sum(F.col("inside") + 2 * F.col("loop")).alias("inside"), F.sum(F.col("strength") * F.col("total")).alias("squares"), F.count("to").alias("moved"), F.count("wish").alias("wishes"), F.count("*").alias("n")).first()
            found = sums["inside"] / double - sums["squares"] / double**2
            if before is not None and found < before - 1e-12:  # moves that met in one community did harm: back, and with fewer at once
                nodes = best
                if free == STRICT:
                    break
                free = freest = free - 1
                continue
            gained, moved = found - (before if before is not None else -1.0), moved or (before is not None and found > before + 1e-12)
            best, before = moves.select("node", "community", "strength", "loop"), found
            if not sums["moved"] or (gained < LEAST_GAIN and sums["moved"] < LEAST_MOVED * sums["n"]):
                break
            nodes = moves.select("node", F.coalesce("to", "community").alias("community"), "strength", "loop")
            dense = number < MOVE_ROUNDS // 2 and (free == HALF or sums["moved"] * DENSE < sums["wishes"])
            free = min(freest, HALF if dense else LOOSE if loose else STRICT)
        quality, nodes = before, best
        if not moved:
            break
        home = nodes.select("node", "community")
        member = rounds.kept("member", member.withColumnRenamed("community", "_c").join(home.withColumnRenamed("node", "_c"), "_c").select("node", "community"))
        folded = now.join(home.select(F.col("node").alias("src"), F.col("community").alias("a")), "src").join(home.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w"))
        inner = folded.where("src = dst").select(F.col("src").alias("community"), (F.col("w") / 2).alias("within"))
        merged = nodes.groupBy("community").agg(F.sum("strength").alias("strength"), F.sum("loop").alias("own")).join(inner, "community", "left")
        nodes = rounds.kept("nodes", merged.select(F.col("community").alias("node"), "community", "strength", (F.col("own") + F.coalesce("within", F.lit(0.0))).alias("loop")))
        count = nodes.count()
        now = rounds.held("edges", folded.where("src <> dst"), count <= NODES_SENT)
    rounds.let_go("edges")
    least = member.groupBy("community").agg(F.min("node").alias("least"))
    return member.join(least, "community").select("node", F.col("least").alias("community"), F.lit(float(quality)).alias("modularity"))


def co_recall(events: DataFrame, most: int = 8, cap: int = 32) -> DataFrame:
    """(src, dst, w) both ways, from events (event_id, paths): each pair among the first `most` paths adds 1; the `cap` strongest stay on both sides."""
    first = F.slice("paths", 1, most)
    pairs = events.select(F.posexplode(first).alias("i", "a"), first.alias("p")).select("a", F.explode(F.expr("slice(p, i + 2, 64)")).alias("b")).where("a <> b")
    weight = pairs.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    both = weight.unionByName(weight.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    kept = both.withColumn("place", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("w"), "dst"))).where(F.col("place") <= cap).drop("place")
    return kept.join(kept.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi")


def replaced_edges(edges: DataFrame, changed: DataFrame, links: DataFrame) -> DataFrame:
    """edges after some nodes (node) were written anew: their old outbound edges go, `links` (src, dst) come; nothing else moves."""
    return edges.join(changed.select(F.col("node").alias("src")).distinct(), "src", "left_anti").select("src", "dst").unionByName(links.select("src", "dst").distinct())


def snapshot(edges: DataFrame, nodes: DataFrame, limit: int = 800) -> tuple[DataFrame, DataFrame]:
    """(nodes with degrees, edges among them): the `limit` most connected nodes, all if `limit` is 0; ties by name."""
    counted = degrees(edges, nodes).withColumn("degree", F.col("inbound") + F.col("outbound"))
    kept = counted.orderBy(F.desc("degree"), "node").limit(limit) if limit > 0 else counted
    kept = cut(kept)
    inside = edges.select("src", "dst").join(kept.select(F.col("node").alias("src")), "src", "left_semi").join(kept.select(F.col("node").alias("dst")), "dst", "left_semi")
    return kept, inside.distinct()


def path_lengths(edges: DataFrame, seeds: DataFrame, hops: int = 10) -> DataFrame:
    """(hops, pairs): how many ordered pairs of a seed and another node lie so many steps apart, either way along the edges.

    All seeds walk together: a frontier holds (seed, node), so rounds are as many as hops, not as seeds.
    """
    ways = cut(both_ways(edges))
    seen = cut(seeds.select("node").distinct().select(F.col("node").alias("seed"), "node").withColumn("hops", F.lit(0)))
    frontier = seen.select("seed", "node")
    for hop in range(1, hops + 1):
        step = ways.join(frontier.withColumnRenamed("node", "src"), "src").select("seed", F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen, ["seed", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.withColumn("hops", F.lit(hop)))
    return seen.where("hops > 0").groupBy("hops").agg(F.count("*").alias("pairs"))


def recall_seeds(graph: DataFrame, entities: DataFrame, lexical: DataFrame, most: int = 5) -> DataFrame:
    """(node): entity nodes (node) and the first `most` lexical hits (node, lexical: rank) that are in the graph."""
    first = lexical.where(F.col("lexical") <= most).select("node")
    return entities.select("node").union(first).distinct().join(graph.select(F.col("src").alias("node")).distinct(), "node", "left_semi")


def graph_arm(graph: DataFrame, seeds: DataFrame, notes: DataFrame, limit: int) -> DataFrame:
    """(node, graph): notes by their rank in a walk from the seeds, best first, ties by name."""
    ranked = personalised_pagerank(graph, seeds).join(notes.select("node"), "node", "left_semi").orderBy(F.desc("score"), "node").limit(limit)
    return ranked.select("node", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "node")).alias("graph"))


def seed_spread(graph: DataFrame, seeds: DataFrame, notes: DataFrame, hops: int = 3) -> DataFrame:
    """(hops, notes): how many notes are first reached from the seeds at each step; other nodes are passed, not counted."""
    found = reach(graph.select("src", "dst"), seeds, hops).where("hops > 0").join(notes.select("node"), "node", "left_semi").groupBy("hops").agg(F.count("*").alias("notes"))
    return seeds.sparkSession.range(1, hops + 1).select(F.col("id").cast("int").alias("hops")).join(F.broadcast(found), "hops", "left").na.fill(0)


def fact_neighbours(facts: DataFrame, path: str) -> DataFrame:
    """(entity, predicate, direction): what facts tie a note to, by the name that its path ends in."""
    name = path.removesuffix(".md").rsplit("/", 1)[-1]
    own = F.col("subject") == name
    rows = facts.where(own | (F.col("object") == name))
    return rows.select(F.when(own, F.col("object")).otherwise(F.col("subject")).alias("entity"), "predicate", F.when(own, "outgoing").otherwise("incoming").alias("direction"))
