"""Main content of pages: blocks are matched by running depth over rows of tags, for any number and nesting of tags in linear work.

The tags that may hold the content become rows (their page's content hash, place, offsets). A running sum of +1 and -1 per tag name gives
depths; an opening tag and the closing tag that ends it are neighbours among the tags of one name and depth, so the end is
the next row's offset. Prefix sums of word lengths give the visible length of every block without cutting it out. Only
the chosen offsets go back to the pages.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeloom.functions import extract

BLOCK = r"(?i)</(?:main|article|div|section)\s*>|<(?:main|article|div|section)\b[^>]*>"


@dataclass(frozen=True)
class MainRule:
    """Which blocks count. ``tiers``: patterns of opening tags; blocks of the first tier that a page has compete, the one with most visible
    text wins, the earlier at a tie. ``open_ended``: a block without its end runs to the end of the page (else it does
    not count). ``weak``: below so many visible characters and below so large a share of the page's the whole page is kept. ``body``:
    without any block the body is taken, else the page. ``spaced``: a blank between words counts as visible."""

    tiers: tuple[str, ...]
    open_ended: bool = False
    weak: tuple[int, float] | None = None
    body: bool = False
    spaced: bool = True


#: The largest of all main, article and role=main blocks.
LARGEST = MainRule((r"""(?is)^<(?:main|article)\b|^<(?:div|section)\b.*role=["']main["']""",), open_ended=True, body=True, spaced=False)
#: main, else article, else a block named as content; a small one in a long page is not the content. Names are fixed values.
NAMED = MainRule(
    (r"(?i)^<main\b", r"(?i)^<article\b", r'(?is)^<(?:div|section)\b.*\b(?:id|class)="[^"]*\b(?:content|article|post|entry|story|markdown-body|main|prose)\b'),
    weak=(500, 0.3),
)


def _words(gap: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(gap, r"(?s)<[^>]+>", " "), r"\s+"), lambda w: w != "")


def block_rows(pages: DataFrame, html: str, rule: MainRule) -> DataFrame:
    """``(content, i, name, step, tier, begin, end, words, letters)`` for every block tag of every different page: its offsets, and the words and
    their letters that stand before it. The last row of a page has no name and stands for its end."""
    content = F.sha2(F.col(html), 256)
    once = pages.where(F.col(html).isNotNull()).select(content.alias("content"), F.split(html, BLOCK, -1).alias("gaps"), extract.matches(F.col(html), BLOCK).alias("tags"))
    rows = once.select("content", F.posexplode(F.arrays_zip("gaps", "tags")).alias("i", "x")).select("content", "i", F.col("x.gaps").alias("gap"), F.col("x.tags").alias("tag"))
    tier = F.lit(None).cast("int")
    for k, pattern in reversed(list(enumerate(rule.tiers))):
        tier = F.when(F.col("tag").rlike(pattern), k).otherwise(tier)
    words = extract.bound(_words(F.col("gap")), lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("letters")))
    narrow = rows.select(
        "content", "i", F.lower(F.regexp_extract("tag", r"^</?(\w+)", 1)).alias("name"), F.when(F.col("tag").startswith("</"), -1).when(F.col("tag").isNotNull(), 1).alias("step"), tier.alias("tier"),
        F.length("gap").alias("gap"), F.coalesce(F.length("tag"), F.lit(0)).alias("tag"), words.alias("w"),
    ).select("*", "w.n", "w.letters").drop("w")
    narrow = narrow.dropDuplicates(["content", "i"])  # the same page fetched twice
    before = Window.partitionBy("content").orderBy("i")
    end = F.sum(F.col("gap") + F.col("tag")).over(before)
    return narrow.select("content", "i", "name", "step", "tier", (end - F.col("tag")).alias("begin"), end.alias("end"), F.sum("n").over(before).alias("words"), F.sum("letters").over(before).alias("letters"))


def main_spans(pages: DataFrame, html: str, rule: MainRule) -> DataFrame:
    """``(content, first, last)``: the offsets of the main block of every different page that has one."""
    rows = block_rows(pages, html, rule)
    whole = Window.partitionBy("content")
    rows = rows.select(
        "*",
        *[F.max(c).over(whole).alias(f"all_{c}") for c in ("end", "words", "letters")],
        F.sum("step").over(Window.partitionBy("content", "name").orderBy("i")).alias("depth"),
    )
    level = F.when(F.col("step") > 0, F.col("depth")).otherwise(F.col("depth") + 1)
    mates = Window.partitionBy("content", "name", "level").orderBy("i")
    after = {c: F.lead(c).over(mates) for c in ("begin", "words", "letters")}
    if rule.open_ended:
        after = {c: F.coalesce(v, F.col(f"all_{'end' if c == 'begin' else c}")) for c, v in after.items()}
    rows = rows.withColumn("level", level).select("content", "i", "step", "tier", F.col("end").alias("first"), after["begin"].alias("last"), (after["words"] - F.col("words")).alias("n"), (after["letters"] - F.col("letters")).alias("letters"), "all_words", "all_letters")
    seen = lambda n, letters: letters + F.greatest(n - 1, F.lit(0)) if rule.spaced else letters
    found = rows.where("step = 1 AND tier IS NOT NULL AND last IS NOT NULL").withColumn("visible", seen(F.col("n"), F.col("letters")))
    best = found.groupBy("content").agg(F.max_by(F.struct("first", "last", "visible", "all_words", "all_letters"), F.struct(-F.col("tier"), "visible", -F.col("i"))).alias("b")).select("content", "b.*")
    if rule.weak:
        least, share = rule.weak
        best = best.where(~((F.col("visible") < least) & (F.col("visible") < share * seen(F.col("all_words"), F.col("all_letters")))))
    return best.select("content", "first", "last")


def with_main(pages: DataFrame, html: str = "html", rule: MainRule = NAMED, name: str = "main_html") -> DataFrame:
    """Pages with the markup of their main content in column ``name``; all rows and columns stay, null pages have none."""
    spans = main_spans(pages, html, rule)
    inner = F.substr(F.col(html), F.col("__first") + 1, F.col("__last") - F.col("__first"))
    body = F.regexp_extract(F.col(html), r"(?is)<body[^>]*>(.*?)(?:</body>|$)", 1)
    rest = F.when(F.col(html).rlike(r"(?i)<body[^>]*>"), body).otherwise(F.col(html)) if rule.body else F.col(html)
    keyed = pages.withColumn("__content", F.sha2(F.col(html), 256))
    joined = keyed.join(spans.select(F.col("content").alias("__content"), F.col("first").alias("__first"), F.col("last").alias("__last")), "__content", "left")
    return joined.withColumn(name, F.when(F.col("__first").isNotNull(), inner).otherwise(rest)).drop("__content", "__first", "__last")
