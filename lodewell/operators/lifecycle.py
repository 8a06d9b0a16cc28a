"""Lifecycle of notes: heat, decay, archival, promotion, categories, series, themes, staged context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodewell.functions import scoring as S
from lodewell.operators.graph import cut

#: Keyword patterns of categories, in order.
CATEGORY_RULES = [
    ("decision", r"(?i)\b(decided|chose|choose|decision|ruling|choosing)\b"),
    ("observation", r"(?i)\b(noticed|observed|saw|spotted|observation|seeing)\b"),
    ("insight", r"(?i)\b(I think|pattern|insight|realize|realise|realized|realised|correlat)"),
    ("conversation", r"(?i)\b(talked|discussed|conversation|meeting|chat|call)\b"),
    ("fact", r"(?i)\b(fact|definition|always|never|is a|are a)\b"),
    ("preference", r"(?i)\b(prefer|like|dislike|love|hate|preference|favorite|favourite)\b"),
    ("plan", r"(?i)\b(plan|todo|goal|milestone|roadmap|next step|will|going to|intend)"),
    ("reflection", r"(?i)\b(reflect|looking back|lesson|takeaway|retrospect|hindsight)"),
]


#: The least score of each grade.
GRADES = [(90, "A"), (80, "A-"), (70, "B+"), (60, "B"), (50, "C+"), (40, "C"), (30, "D")]


def category(explicit: Column, kind: Column, path: Column, text: Column) -> tuple[Column, Column]:
    """The category and what told it: front matter, type, path, keywords, or nothing."""
    by_kind = F.when(kind == "task", "plan").when(kind.isin("entity", "crm"), "fact")
    by_path = F.when(path.rlike("(?i)/(decisions|adr)/"), "decision").when(path.rlike("(?i)/projects/"), "plan")
    by_word = None
    for name, pattern in CATEGORY_RULES:
        hit = text.rlike(pattern)
        by_word = F.when(hit, name) if by_word is None else by_word.when(hit, name)
    source = F.when(explicit.isNotNull(), "front matter").when(by_kind.isNotNull(), "type").when(by_path.isNotNull(), "path").when(by_word.isNotNull(), "keywords").otherwise("default")
    return F.coalesce(explicit, by_kind, by_path, by_word, F.lit("general")), source


def promoted(access_days: Column) -> Column:
    """The access count after one promotion a day, from the sorted array of days: each adds 1 / (1 + log2(max(1, count))), 0.1 at least."""
    return F.aggregate(F.array_distinct(access_days), F.lit(0.0), lambda n, _: n + F.greatest(F.lit(0.1), 1 / (1 + F.log2(F.greatest(F.lit(1.0), n)))))


def changed(action: Column, heat: Column) -> Column:
    """Heat after a manual action, within 0 and 16."""
    new = F.when(action == "promote", heat + 4).when(action == "cool", heat - 4).when(action == "freeze", F.lit(0)).otherwise(heat)
    return F.least(F.lit(16), F.greatest(F.lit(0), new))


def archive_plan(notes: DataFrame, as_of: Column) -> DataFrame:
    """What becomes of cold notes that nobody read for 90 days: archived if merged or templated, else skipped as unique."""
    stale = (F.col("temperature") == "cold") & (F.datediff(as_of, F.col("last_access")) > 90)
    return notes.withColumn("plan", F.when(~F.coalesce(stale, F.lit(False)), "keep").when(F.col("merged") | F.col("templated"), "archive").otherwise("skip"))


def keep_last(notes: DataFrame, series: str, at: str, keep: int) -> DataFrame:
    """All but the newest `keep` of each series, with the ISO week that they fold into."""
    place = F.row_number().over(Window.partitionBy(series).orderBy(F.desc(at), F.desc("key")))
    week = F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), F.col(at)).cast("int"), F.extract(F.lit("WEEK"), F.col(at)).cast("int"))
    return notes.withColumn("place", place).where(F.col("place") > keep).withColumn("week", week).drop("place")


def budget_cut(rows: DataFrame, group: str, order: list[Column], text: str, tokens: int) -> DataFrame:
    """The first rows within the budget of 4 characters a token, the one that crosses it cut, the rest dropped.

    A row that the rows of its own partition put beyond the budget is beyond it in the group as well,
    so only what the partitions leave, as many characters as the budget each, is brought together.
    """
    by = lambda *c: Window.partitionBy(*c).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda *c: F.coalesce(F.sum(F.length(text)).over(by(*c)), F.lit(0))
    some = rows.where(F.length(text) >= 0).withColumn("_part", F.spark_partition_id())
    some = some.withColumn("_used", before(group, "_part")).where(F.col("_used") < 4 * tokens).drop("_used", "_part")
    run = before(group)
    return some.withColumn("used", run).where(F.col("used") < 4 * tokens).withColumn("kept", F.expr(f"substring({text}, 1, cast({4 * tokens} - used AS int))"))


def health(notes: DataFrame) -> DataFrame:
    """Ratios of a vault and the score from them: tags, links, no orphans, heat and balance weigh .25, .25, .25, .15, .10."""
    base = notes.agg(
        F.count("*").alias("notes"),
        F.avg((F.size("tags") > 0).cast("double")).alias("tag_coverage"),
        F.avg(F.col("links")).alias("link_density"),
        F.avg((F.col("links") == 0).cast("double")).alias("orphan_ratio"),
        F.avg("heat").alias("avg_heat"),
        *[F.avg((F.col("temperature") == t).cast("double")).alias(t) for t in ("hot", "warm", "cold")],
    )
    balance = F.greatest(F.lit(0.0), 1 - 2 * F.greatest(F.lit(0.0), F.col("hot") - 0.4) - 2 * F.greatest(F.lit(0.0), F.col("cold") - 0.8))
    raw = 100 * (0.25 * F.col("tag_coverage") + 0.25 * F.least(F.lit(1.0), F.col("link_density") / 3) + 0.25 * (1 - F.least(F.lit(1.0), F.col("orphan_ratio"))) + 0.15 * F.least(F.lit(1.0), F.col("avg_heat") / 8) + 0.10 * F.coalesce(balance, F.lit(0.0)))
    score = F.floor(F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw)) + 0.5)
    grade = None
    for least, name in GRADES:
        grade = F.when(score >= least, name) if grade is None else grade.when(score >= least, name)
    return base.withColumn("score", score).withColumn("grade", grade.otherwise("F"))


def _greedy(waiting: DataFrame, least: int) -> DataFrame:
    """(key, order): what each key takes, if keys go to the first of their orders that at least `least` keys take, decided in order.

    In each round every key waits for its first order. One that enough keys wait for only gains, and
    keeps its keys. Any other can still gain keys that wait for such an order, so one that too few of
    these keys have is given up, all such at once; the first of them in order always is.
    """
    waiting = cut(waiting)
    while True:
        first = cut(waiting.groupBy("key").agg(F.min("order").alias("order")))
        size = first.groupBy("order").agg(F.count("*").alias("n"))
        short = size.where(F.col("n") < least)
        if short.isEmpty():
            return first
        free = waiting.join(first.join(short.select("order"), "order", "left_semi").select("key"), "key", "left_semi").groupBy("order").agg(F.count("*").alias("most"))
        settled = size.where(F.col("n") >= least).select("order", F.lit(True).alias("settled"))
        alive = waiting.select("order").distinct().join(settled, "order", "left").join(free, "order", "left")
        kept = alive.where(F.coalesce("settled", F.lit(False)) | (F.coalesce("most", F.lit(0)) >= least)).select("order")
        waiting = cut(waiting.join(kept, "order", "left_semi"))


def _tag_pairs(tagged: DataFrame, between: str = "+") -> DataFrame:
    return tagged.select("key", F.explode(F.expr(f"flatten(transform(array_sort(array_distinct(tags)), (a, i) -> transform(slice(array_sort(array_distinct(tags)), i + 2, size(tags)), b -> concat(a, '{between}', b))))")).alias("theme"))


def _ordered(rows: DataFrame, least: int) -> DataFrame:
    """(key, order) of themes with `least` keys at least, the commonest first, then by name."""
    counts = rows.groupBy("theme").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return rows.join(counts, "theme").select("key", F.struct((-F.col("n")).alias("n"), "theme").alias("order"))


def themes(tagged: DataFrame, least: int = 3) -> DataFrame:
    """(theme, size, first): greedy themes of tag pairs, strongest first; each note (key, tags) goes to one theme only.

    Only the pairs' counts, and never a pair's notes, are brought together.
    """
    taken = _greedy(_ordered(_tag_pairs(tagged), least), least)
    return taken.groupBy("order").agg(F.count("*").alias("size"), F.min("key").alias("first")).select("order.theme", "size", "first")


#: Notes of a pair's theme, and a tag's notes in all and among those without a theme.
PAIR_NOTES, TAG_NOTES, TAG_LEFT = 2, 5, 3
#: Stands between the tags of a pair while themes are found: the unit separator, which no tag has.
BETWEEN = "\x1f"


def note_themes(notes: DataFrame, most: int | None = None, ignored: tuple[str, ...] = ()) -> DataFrame:
    """(theme, tags, size, first, temperature, place): themes of hot and warm notes (key, tags, temperature), at most `most`.

    First pairs of tags that two notes share, the commonest first, each note in one theme only. Then
    single tags of five notes or more that no theme has, if three of their notes are left. Ties are in
    order of names. Tags in `ignored` count nowhere; notes without other tags, and cold ones, have no theme.
    """
    usable = F.filter(F.array_distinct(F.coalesce("tags", F.array().cast("array<string>"))), lambda t: t.isNotNull() & (~t.isin(*ignored) if ignored else F.lit(True)))
    rows = cut(notes.where(F.col("temperature").isin("hot", "warm")).select("key", "temperature", usable.alias("tags")).where(F.size("tags") > 0))

    def found(taken: DataFrame, phase: int) -> DataFrame:
        own = taken.join(rows.select("key", "temperature"), "key").withColumn("theme", F.col("order.theme"))
        counted = own.groupBy("theme", "order").agg(F.count("*").alias("size"), F.min("key").alias("first"))
        return counted.join(dominant_temperature(own, "theme"), "theme").select(F.replace("theme", F.lit(BETWEEN), F.lit(" + ")).alias("theme"), F.split("theme", BETWEEN).alias("tags"), "size", "first", "temperature", F.lit(phase).alias("phase"), F.col("order.n").alias("n"))

    paired = cut(_greedy(_ordered(_tag_pairs(rows, BETWEEN), PAIR_NOTES), PAIR_NOTES))
    pairs = found(paired, 0)
    used = pairs.select(F.explode("tags").alias("tag")).distinct()
    tags = rows.select("key", F.explode("tags").alias("tag"))
    common = tags.groupBy("tag").agg(F.count("*").alias("n")).where(F.col("n") >= TAG_NOTES).join(used, "tag", "left_anti")
    left = tags.join(paired.select("key"), "key", "left_anti").join(common, "tag").select("key", F.struct((-F.col("n")).alias("n"), F.col("tag").alias("theme")).alias("order"))
    both = pairs.unionByName(found(_greedy(left, TAG_LEFT), 1))
    order = ["phase", "n", "theme"]
    both = both.orderBy(*order).limit(most) if most is not None else both
    return both.withColumn("place", F.row_number().over(Window.orderBy(*order))).drop("phase", "n")  # a row for each theme


def orphan_memories(notes: DataFrame, as_of: Column) -> DataFrame:
    """(key, title, temperature, heat_score, days, action, place): notes (key, title, content, tags, temperature, heat_score, last_accessed, archived) that hang by nothing, and what to do with them.

    A note without tags and links is one; so is a cold one of heat 2 at most that has only one of both.
    Hot ones come first, then by heat; `days` is -1 if it was never read. What is missing counts as cold,
    without heat and tags; archived notes are none.
    """
    tags, heat = F.size(F.coalesce("tags", F.array().cast("array<string>"))), F.coalesce("heat_score", F.lit(0))
    tagged, linked = tags > 0, F.coalesce(F.col("content").rlike(r"\[\[[^\]]+\]\]"), F.lit(False))
    loose = (~tagged & ~linked) | ((tagged != linked) & F.coalesce(F.col("temperature") == "cold", F.lit(False)) & (heat <= 2))
    warmth = F.coalesce("temperature", F.lit("cold"))
    action = F.when(warmth == "hot", "link").when(warmth == "warm", "review").when((warmth == "cold") & (tags >= 2), "consolidate").otherwise(F.when(heat <= 2, "archive").otherwise("review"))
    days = F.coalesce(F.datediff(as_of, F.col("last_accessed")), F.lit(-1))
    rows = notes.where(loose & ~F.coalesce(F.col("archived"), F.lit(False))).select("key", "title", warmth.alias("temperature"), heat.alias("heat_score"), days.alias("days"), action.alias("action"))
    order = [F.when(F.col("temperature") == "hot", 0).when(F.col("temperature") == "warm", 1).when(F.col("temperature") == "cold", 2).otherwise(3), F.desc("heat_score"), F.col("key")]
    # places are counted within temperature and heat, and shifted by the groups before: no task orders all
    group = ["_first", "heat_score"]
    ranked = rows.withColumn("_first", order[0])
    within = F.row_number().over(Window.partitionBy(*group).orderBy("key"))
    sizes = ranked.groupBy(*group).count()
    before = sizes.select(*group, (F.sum("count").over(Window.orderBy("_first", F.desc("heat_score"))) - F.col("count")).alias("_before"))
    placed = ranked.withColumn("_within", within).join(F.broadcast(before), group)  # a row for each degree of heat
    return placed.select("key", "title", "temperature", "heat_score", "days", "action", (F.col("_before") + F.col("_within")).cast("int").alias("place"))


def dominant_temperature(notes: DataFrame, group: str) -> DataFrame:
    """(group, temperature): the commonest of hot, warm and cold, the hotter of equals; anything else counts as cold."""
    hot, warm = F.count_if(F.col("temperature") == "hot"), F.count_if(F.col("temperature") == "warm")
    counted = notes.groupBy(group).agg(hot.alias("hot"), warm.alias("warm"), F.count("*").alias("n")).withColumn("cold", F.col("n") - F.col("hot") - F.col("warm"))
    top = F.when((F.col("hot") >= F.col("warm")) & (F.col("hot") >= F.col("cold")), "hot").when(F.col("warm") >= F.col("cold"), "warm").otherwise("cold")
    return counted.select(group, top.alias("temperature"))


def activity(notes: DataFrame, as_of: Column, days: int) -> DataFrame:
    """One row: notes by temperature, and how many were created or read within `days`."""
    recent = lambda c: F.count_if(F.datediff(as_of, F.col(c)) <= days)
    return notes.agg(F.count("*").alias("notes"), *[F.count_if(F.col("temperature") == t).alias(t) for t in ("hot", "warm", "cold")], recent("created").alias("created"), recent("accessed").alias("accessed"))


def coldest_first(orphans: DataFrame, limit: int) -> DataFrame:
    """The least hot, then the oldest."""
    return orphans.orderBy("heat", F.desc("age_days"), "path").limit(limit)


def by_temperature(orphans: DataFrame, limit: int) -> DataFrame:
    """Hot before warm before cold before others, then by heat."""
    order = F.when(F.col("temperature") == "hot", 0).when(F.col("temperature") == "warm", 1).when(F.col("temperature") == "cold", 2).otherwise(3)
    return orphans.orderBy(order, F.desc("heat"), "path").limit(limit)


def history(entries: Column, new: Column, most: int = 5) -> Column:
    """The last `most` entries of a history with a new one at its end."""
    grown = F.concat(F.coalesce(entries, F.array().cast("array<string>")), F.array(new))
    return F.slice(grown, F.greatest(F.lit(1), F.size(grown) - most + 1), most)


def tied_to_open_tasks(notes: DataFrame, links: DataFrame, tasks: DataFrame) -> DataFrame:
    """Notes (path) with a link (src, dst) to a task (path, status) that is open."""
    pending = tasks.where("status = 'open'").select(F.col("path").alias("dst"))
    return notes.join(links.join(pending, "dst", "left_semi").select(F.col("src").alias("path")).distinct(), "path", "left_semi")


def dream_report(notes: DataFrame) -> DataFrame:
    """One row that sums up a maintenance cycle: temperatures, decayed heat, demotions, promotions."""
    days = F.col("days")
    left = S.decayed(F.col("heat"), days, F.col("category"), F.col("importance"))
    worth = S.roi(days, F.col("accesses"), F.col("category"), F.col("length"))
    return notes.agg(
        F.count("*").alias("notes"),
        F.count_if(S.temperature(left) == "cold").alias("cold"),
        F.count_if(left < F.col("heat")).alias("decayed"),
        F.count_if((worth < 0) & (days >= 30)).alias("demote"),
        F.count_if((F.col("accesses") >= 5) & (days <= 30)).alias("promote"),
    )
