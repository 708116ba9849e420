"""Tags whose share of the posts grew between two windows of time.

One pass counts both windows: the scan is filtered to the time that they span, and every
tag gets two conditional counts; totals and artists come from the same pass. Posts count once for each tag. Scores are columns over
the counts, so they can be changed without a new scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions.text import color_of, tag_array
from tagloom.model import CATEGORIES, column_of
from tagloom.operators.tags import by_category
from tagloom.sources.generations import Generations, source_key

ONLY_NEW_GROWTH = 999999.0


@dataclass(frozen=True)
class Windows:
    baseline_from: str
    baseline_to: str
    recent_from: str
    recent_to: str

    def __post_init__(self):
        days = [date.fromisoformat(d) for d in (self.baseline_from, self.baseline_to, self.recent_from, self.recent_to)]
        if days[0] > days[1] or days[2] > days[3]:
            raise ValueError("a window ends before it begins")
        if days[1] >= days[2]:
            raise ValueError("the recent window must begin after the baseline ends")

    @property
    def contiguous(self) -> bool:
        return date.fromisoformat(self.baseline_to) + timedelta(days=1) == date.fromisoformat(self.recent_from)

    @staticmethod
    def before(anchor: str, recent_days: int = 30, baseline_months: int = 6) -> Windows:
        """The last days up to the anchor, and the months before them."""
        end = date.fromisoformat(anchor[:10])
        begin = end - timedelta(days=recent_days)
        last = begin - timedelta(days=1)
        month = last.year * 12 + last.month - 1 - baseline_months
        for day in range(last.day, 0, -1):
            try:
                first = date(month // 12, month % 12 + 1, day)
                break
            except ValueError:
                continue
        return Windows(first.isoformat(), last.isoformat(), begin.isoformat(), end.isoformat())

    def linked(self, recent_from: str) -> Windows:
        """With another start of the recent window, and the baseline ending the day before."""
        return replace(self, recent_from=recent_from, baseline_to=(date.fromisoformat(recent_from) - timedelta(days=1)).isoformat())


@dataclass(frozen=True)
class Scan:
    """What is counted; a change needs a new scan."""

    windows: Windows
    categories: tuple[str, ...] = CATEGORIES
    seeds: tuple[str, ...] = ()
    count_mode: str = "category"
    artists: bool = False

    def __post_init__(self):
        if not self.categories:
            raise ValueError("select at least one tag category")
        if self.count_mode not in ("category", "tag_string"):
            raise ValueError(f"unknown count mode: {self.count_mode}")


@dataclass(frozen=True)
class Scoring:
    """What is kept and how it is ranked; needs no scan."""

    min_recent: int = 25
    min_growth: float = 3.0
    limit: int = 500
    only_new: bool = False
    exclude_new: bool = False
    excluded: tuple[str, ...] = ()
    dominance: float | None = None
    dominance_min_solo: int = 5


@dataclass
class Counts:
    """tags(tag, category, recent, baseline); totals(total_recent, total_baseline, scanned, matched), one
    row; artists(tag, solo, top_artist, top): recent posts with one artist only."""

    tags: DataFrame
    totals: DataFrame
    artists: DataFrame | None = None
    held: list[DataFrame] = field(default_factory=list)

    def persist(self) -> Counts:
        self.held = [df.persist() for df in (self.tags, self.totals, self.artists) if df is not None]
        return self

    def unpersist(self) -> None:
        for df in self.held:
            df.unpersist()


def in_windows(posts: DataFrame, scan: Scan) -> DataFrame:
    """The posts of either window with ``recent``, ``matched`` (whether they have all seeds) and their
    ``tags``: an array of distinct (tag, category), the category of highest priority first."""
    w = scan.windows
    day = F.substring("created_at", 1, 10)
    near = posts.where((F.col("created_at") >= w.baseline_from) & (F.col("created_at") <= w.recent_to) & (F.char_length("created_at") >= 10))
    recent = day.between(w.recent_from, w.recent_to)
    rows = near.withColumn("recent", recent).where(recent | day.between(w.baseline_from, w.baseline_to))
    listed = tag_array(F.col("tag_string"))
    matched = F.size(F.array_except(F.array(*map(F.lit, scan.seeds)), listed)) == 0 if scan.seeds else F.lit(True)
    pairs = by_category(tuple(c for c in CATEGORIES if c in scan.categories))
    if scan.count_mode == "tag_string":
        pairs = F.filter(pairs, lambda p: F.array_contains(listed, p["tag"]))
    if scan.seeds:
        pairs = F.filter(pairs, lambda p: ~p["tag"].isin(list(scan.seeds)))
    solo = tag_array(F.col(column_of("artist")))
    extra = [F.when(F.size(solo) == 1, solo[0]).alias("solo")] if scan.artists else []
    return rows.select("recent", matched.alias("matched"), pairs.alias("tags"), *extra)


#: Places of rows that stand for the posts themselves, and of pairs of tag and artist; tags have the place of their category.
MATCHED, SCANNED, PAIR = -2, -1, len(CATEGORIES)


def count(posts: DataFrame, scan: Scan) -> Counts:
    """All counts from one aggregate over one read of the posts. Every post gives a row for itself, if it has
    the seeds one more, one for each of its tags, and one for each tag with its only artist. What a
    group stands for is told by the least place, which is known after the aggregate only, so tags, totals and
    artists share its exchange."""
    priority = F.create_map(*(F.lit(x) for i, c in enumerate(CATEGORIES) for x in (c, i)))
    none = F.lit(None).cast("string")
    item = lambda tag, solo, place: F.struct(tag.alias("tag"), solo.alias("solo"), place.alias("place"))
    # tags stand in the order of their categories, so the first of equal ones has the least place
    rows = in_windows(posts, scan).withColumn("names", F.col("tags.tag"))
    first = F.filter("tags", lambda p, i: F.array_position("names", p["tag"]) == i + 1)
    names = F.array_distinct("names")
    tags = F.transform(first, lambda p: item(p["tag"], none, priority[p["category"]]))
    listed = F.concat(F.array(item(none, none, F.lit(MATCHED))), tags)
    if scan.artists:
        pairs = F.transform(names, lambda t: item(t, F.col("solo"), F.lit(PAIR)))
        listed = F.concat(listed, F.when(F.col("recent") & F.col("solo").isNotNull(), pairs).otherwise(F.array().cast("array<struct<tag: string, solo: string, place: int>>")))
    every = F.concat(F.array(item(none, F.lit(""), F.lit(SCANNED))), F.when(F.col("matched"), listed).otherwise(F.array().cast("array<struct<tag: string, solo: string, place: int>>")))
    groups = rows.select("recent", F.explode(every).alias("t")).groupBy("t.tag", "t.solo").agg(F.min("t.place").alias("place"), F.count_if("recent").alias("recent"), F.count_if(~F.col("recent")).alias("baseline"))
    of = F.col("place")
    found = groups.where(of.between(0, PAIR - 1)).select("tag", F.array(*map(F.lit, CATEGORIES))[of].alias("category"), "recent", "baseline")
    total = lambda kind, c: F.coalesce(F.sum(F.when(of == kind, F.col(c))), F.lit(0).cast("long"))
    totals = groups.where(of < 0).agg(
        total(MATCHED, "recent").alias("total_recent"), total(MATCHED, "baseline").alias("total_baseline"),
        (total(SCANNED, "recent") + total(SCANNED, "baseline")).alias("scanned"), (total(MATCHED, "recent") + total(MATCHED, "baseline")).alias("matched"),
    )
    artists = None
    if scan.artists:
        pairs = groups.where(of == PAIR).where(F.col("recent") >= F.col("baseline"))  # always: pairs are of recent posts
        most = F.min(F.struct((-F.col("recent")).alias("less"), "solo"))  # of equals the first by name
        # never null, so a join by it asks for no filter on tags, which would reach below the shared aggregate
        artists = pairs.groupBy(F.coalesce("tag", F.lit("")).alias("tag")).agg(F.sum("recent").alias("solo_posts"), most.alias("m"))
        artists = artists.select("tag", "solo_posts", (-F.col("m.less")).alias("top"), F.col("m.solo").alias("top_artist"))
    return Counts(found, totals, artists)


def _grown(counts: Counts, scoring: Scoring) -> DataFrame:
    """The tags that grew, with shares, growth and whether one artist dominates them."""
    rows = counts.tags.where(F.col("recent") >= max(1, scoring.min_recent))
    if scoring.excluded:
        rows = rows.where(~F.col("tag").isin(list(scoring.excluded)))
    if scoring.only_new:
        rows = rows.where("baseline = 0")
    elif scoring.exclude_new:
        rows = rows.where("baseline > 0")
    both = counts.totals.where("total_recent > 0 and total_baseline > 0")
    part = lambda c: F.col(c) / both.select(f"total_{c}").scalar() * 100.0
    rows = rows.withColumn("recent_pct", part("recent")).withColumn("baseline_pct", part("baseline")).where("recent_pct is not null")
    growth = F.lit(ONLY_NEW_GROWTH) if scoring.only_new else (F.col("recent_pct") + F.lit(1e-6)) / (F.col("baseline_pct") + F.lit(1e-6))
    rows = rows.withColumn("growth_x", growth)
    if not scoring.only_new:
        rows = rows.where(F.col("growth_x") >= scoring.min_growth)
    if scoring.dominance is None or counts.artists is None:
        return rows.withColumn("known", F.lit(False)).withColumn("top_artist", F.lit(None).cast("string")).withColumn("part", F.lit(None).cast("double")).withColumn("dominated", F.lit(False))
    rows = rows.join(counts.artists, "tag", "left").withColumn("part", F.col("top") / F.col("solo_posts") * 100.0)
    known = F.coalesce((F.col("category") != "artist") & (F.col("solo_posts") >= scoring.dominance_min_solo), F.lit(False))
    return rows.withColumn("known", known).withColumn("dominated", F.col("known") & (F.col("part") >= scoring.dominance))


def scored(counts: Counts, scoring: Scoring) -> DataFrame:
    """(tag, category, color, recent_count, baseline_count, recent_pct, baseline_pct, growth_x,
    delta_pct, score, why), best first. Empty if either window has no posts."""
    rows = _grown(counts, scoring).where("not dominated")
    # The sentences of why.
    told = F.when(F.col("known"), F.format_string(" Top artist '%s' = %.1f%% of recent solo posts.", "top_artist", "part")).otherwise("")
    delta = F.col("recent_pct") - F.col("baseline_pct")
    score = F.log1p("growth_x") * 45.0 + F.log1p(F.col("recent").cast("double")) * 12.0 + F.greatest(F.lit(0.0), delta) * 120.0
    new = F.format_string("New in explosion window: %,d posts, %.5f%% of recent posts.", "recent", "recent_pct")
    rose = F.format_string("Normalized share rose from %.5f%% to %.5f%% (%.2f×).", "baseline_pct", "recent_pct", "growth_x")
    why = F.concat(F.when(F.col("baseline") == 0, new).otherwise(rose), told)
    named = rows.select("tag", "category", color_of(F.col("category")).alias("color"), F.col("recent").alias("recent_count"), F.col("baseline").alias("baseline_count"), "recent_pct", "baseline_pct", "growth_x", delta.alias("delta_pct"), score.alias("score"), why.alias("why"))
    return named.orderBy(F.desc("score"), "tag").limit(scoring.limit)


def status(counts: Counts, scan: Scan, scoring: Scoring, cached: bool = False) -> str:
    """One line on a result: how many tags, from what; or which window has no posts."""
    w, n = scan.windows, counts.totals.first()
    # The sentences of the status.
    if not n["total_recent"]:
        return f"No posts found in the explosion window {w.recent_from} → {w.recent_to} (after seed/type filters)."
    if not n["total_baseline"]:
        return f"No posts found in the baseline window {w.baseline_from} → {w.baseline_to} (after seed/type filters)."
    found = _grown(counts, scoring).agg(F.count_if(~F.col("dominated")).alias("stay"), F.count_if("dominated").alias("drop")).first()
    dropped = f" Filtered out {found['drop']:,} tag(s) dominated by a single artist (≥{scoring.dominance:g}%)." if found["drop"] else ""
    return (
        f"Found {min(found['stay'], scoring.limit):,} normalized exploding tags for type(s): {', '.join(scan.categories)}{' (cached counts)' * cached}.{dropped} "
        f"Rows scanned in window: {n['scanned']:,}. Seed-matched rows: {n['matched']:,}. "
        f"Baseline: {w.baseline_from} → {w.baseline_to} ({n['total_baseline']:,} posts). Explosion: {w.recent_from} → {w.recent_to} ({n['total_recent']:,} posts)."
    )


#: The tables of Counts, as a durable cache keeps them.
CACHE = {
    "tags": "tag string, category string, recent long, baseline long", "totals": "total_recent long, total_baseline long, scanned long, matched long",
    "artists": "tag string, solo_posts long, top long, top_artist string",
}


class ExplosionFinder:
    """Scans once for each Scan and rescores from the kept counts; ``status`` tells of the last result.
    With a cache folder, counts outlive the application, and are found again as long as the files that the posts are
    read from are the same."""

    def __init__(self, posts: DataFrame, cache: str | None = None):
        self.posts, self.cache, self.kept, self.status = posts, cache, {}, ""

    def find(self, scan: Scan, scoring: Scoring = Scoring()) -> DataFrame:
        if scoring.dominance is not None and not scan.artists:
            scan = replace(scan, artists=True)
        cached = scan in self.kept
        if not cached:
            self.kept[scan], cached = self._counts(scan)
        self.status = status(self.kept[scan], scan, scoring, cached)
        return scored(self.kept[scan], scoring)

    def _counts(self, scan: Scan) -> tuple[Counts, bool]:
        """The counts of a scan, and whether they were cached."""
        if self.cache is None:
            return count(self.posts, scan).persist(), False
        key = source_key(scan, self.posts)
        folder = Generations(self.posts.sparkSession, f"{self.cache}/{source_key(scan)[:32]}")
        wanted = {name: schema for name, schema in CACHE.items() if name != "artists" or scan.artists}
        found = folder.load(wanted, key)
        if found is not None:
            return Counts(**found), True
        counts = count(self.posts, scan)
        folder.save({name: getattr(counts, name) for name in wanted}, key)
        return Counts(**folder.load(wanted, key)), False

    def close(self) -> None:
        for counts in self.kept.values():
            counts.unpersist()
        self.kept.clear()


def artist_shares(counts: Counts) -> DataFrame:
    """(tag, solo_posts, top_artist, share) of the tags with recent posts by one artist."""
    part = F.col("top") / F.col("solo_posts") * 100.0
    return counts.artists.select("tag", "solo_posts", "top_artist", part.alias("share"))
