"""Column functions on text: tokens, slugs, links, normal forms. All are built from Spark's own expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no content.
STOPWORDS = """
a an and are as at be been but by do does
for from had has have he her his i if in
into is it its me my no not of on or our
she so than that the their them they this to
was we were what when where which who will with
would you your yours us about all any can could
should may might must shall just only also too
""".split()
FILLERS = ["the", "a", "an", "of", "to", "in", "is", "was", "and"]

#: Lower-case Latin letters with marks, and what they are without.
_MARKED = "".join(c for c in map(chr, range(0xC0, 0x250)) if c == c.lower() and len(unicodedata.normalize("NFD", c)) > 1 and unicodedata.normalize("NFD", c)[0].isascii())
_PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in _MARKED)


def tokens(text: Column, least: int = 3, stopwords: list[str] | None = None) -> Column:
    """Lower-cased runs of letters and digits of at least `least` characters, in order."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)
    kept = F.filter(words, lambda w: F.length(w) >= least)
    return F.filter(kept, lambda w: ~w.isin(stopwords)) if stopwords else kept


def folded(text: Column) -> Column:
    """Lower-cased, without the marks that Unicode's decomposition sets apart; Latin letters only."""
    return F.translate(F.lower(text), _MARKED, _PLAIN)


def fold(text: str) -> str:
    """`folded` for a literal."""
    return text.lower().translate(str.maketrans(_MARKED, _PLAIN))


def content_tokens(text: Column) -> Column:
    """Distinct tokens without links, addresses and code."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\[\[[^\]]*\]\]", " "), r"https?://\S+", " "), r"`[^`]*`", " ")
    return F.array_distinct(tokens(bare, 3, STOPWORDS))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def slug(text: Column, most: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


def snippet(text: Column, most: int = 200) -> Column:
    return F.substring(squeezed(text), 1, most)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def bigrams(words: Column) -> Column:
    """Pairs of neighbouring words, joined by a space, each once."""
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.when(F.size(words) >= 2, pairs).otherwise(F.array().cast("array<string>")))


def structural(text: Column) -> Column:
    """Tokens of the text with dates, times and numbers replaced by their kind, without filler words."""
    out = F.lower(text)
    for pattern, kind in ((r"[0-9]{4}-[0-9]{2}-[0-9]{2}", "date"), (r"[0-9]{1,2}:[0-9]{2}", "time"), (r"[0-9]+", "num")):
        out = F.regexp_replace(out, pattern, f" {kind} ")
    return tokens(out, 2, FILLERS)


def wikilinks(text: Column) -> Column:
    """Targets of [[target]], [[target|alias]] and [[target#heading]], in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[\[([^\]\|#]+)(?:#[^\]\|]*)?(?:\|[^\]]*)?\]\]"), 1), lambda t: F.trim(t))


def code_references(text: Column) -> Column:
    """[[code:slug:path:name]] as structs."""
    found = F.regexp_extract_all(text, F.lit(r"\[\[(code:[^:\]]+:[^:\]]+:[^\]]+)\]\]"), 1)
    return F.transform(found, lambda r: F.struct(F.split(r, ":")[1].alias("slug"), F.split(r, ":")[2].alias("path"), F.split(r, ":", 4)[3].alias("name")))


def sentences(text: Column, least: int = 11) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+(?=\p{Lu})"), lambda s: F.length(s) >= least)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def like_escaped(needle: str) -> str:
    """A literal for LIKE ... ESCAPE '!'."""
    return "".join("!" + c if c in "%_!" else c for c in needle)


def sanitized(text: Column, most: int = 10_000) -> Column:
    return F.substring(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), 1, most)


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob: ** any path, * and ? within a segment."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if not c.isalnum() and c not in "/_-" else c), i + 1
    return f"^{out}$"


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def prose_title(text: Column, most: int = 80) -> Column:
    """The first sentence of the first line that is neither empty nor within a code fence; marks of headings and prompts left out."""
    lines = F.transform(F.split(text, "\n"), lambda s: F.trim(s))
    state = F.aggregate(
        lines,
        F.struct(F.lit(False).alias("fence"), F.lit("").alias("line")),
        lambda s, line: F.struct(
            F.when((s["line"] == "") & line.startswith("```"), ~s["fence"]).otherwise(s["fence"]).alias("fence"),
            F.when((s["line"] == "") & ~s["fence"] & ~line.startswith("```"), line).otherwise(s["line"]).alias("line"),
        ),
    )
    line = F.regexp_replace(F.regexp_replace(state["line"], r"^#+\s*", ""), r"^\$\s+", "")
    sentence = F.trim(F.split(F.when(line != "", line).otherwise(F.trim(text)), r"[.!?\n]")[0])
    cut = F.when(F.length(sentence) > most, F.concat(F.substring(sentence, 1, most - 3), F.lit("..."))).otherwise(sentence)
    return F.when(cut == "", "Untitled Memory").otherwise(cut)


def linked_once(text: Column, names: list[str]) -> Column:
    """The text with [[ ]] around the first place of each name that stands alone and is not linked; longer names first."""
    import re

    out = text
    for name in sorted(set(names), key=lambda n: (-len(n), n)):
        free = rf"(?<!\[\[)\b{re.escape(name)}\b(?!\]\])"
        # only what follows the shortest start can be the first place
        out = F.regexp_replace(out, rf"^((?s:.*?))({free})", r"$1[[$2]]")
    return out


def humanised_age(seconds: Column) -> Column:
    s = F.greatest(F.lit(0), F.floor(seconds))
    m, h = F.floor(s / 60), F.floor(s / 3600)
    some = lambda n, unit: F.concat(n.cast("string"), F.lit(unit + " ago"))
    return F.when(s < 90, some(s, "s")).when(m < 90, some(m, "m")).when(h < 36, some(h, "h")).otherwise(some(F.floor(s / 86400), "d"))


def origin(url: Column) -> Column:
    """A repository's address without scheme, user, `.git` and closing slashes, in lower case, so that equal places compare equal."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), "/+$", ""), r"\.git$", "")
    ssh = F.regexp_replace(bare, "^git@([^:]*):(.*)$", "$1/$2")
    return F.regexp_replace(ssh, "^(https|http|ssh|git)://", "")


def ring(values: Column, new: Column, size: int) -> Column:
    """The last `size` of the values with a new one at their end."""
    grown = F.concat(values, F.array(new))
    return F.slice(grown, F.greatest(F.lit(1), F.size(grown) - size + 1), size)


def next_daily(now: Column, hour: int, minute: int) -> Column:
    """The next time the clock shows hour:minute, after `now`."""
    today = F.date_trunc("day", now) + F.make_interval(hours=F.lit(hour), mins=F.lit(minute))
    return F.when(today > now, today).otherwise(today + F.make_interval(days=F.lit(1)))
