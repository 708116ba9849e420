"""The engine's queries over the test tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.functions import text as fn
from tagloom.model import CATEGORIES, COLORS
from tagloom.operators import autocomplete, explosion, graph, search, seasonality, tags, timeseries
from tagloom.operators.search import SearchSpec
from tagloom.plans.query import plain_condition
from tagloom.sources import posts as sources
from tagloom.sources import sinks
from tagloom.sources.stored import PostStore
from tagloom.sources.upkeep import CountStore
from tagloom.streaming.counts import windowed_counts
from tagloom.streaming.distinct import distinct_counts, run_available
from tagloom.testing.posts_view import posts, posts_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str, with_posts: bool = True) -> Callable[[Query], Query]:
    """Register a query and its SQL, in which ``posts`` is the view of posts."""

    def keep(f: Query) -> Query:
        QUERIES[name] = f
        ORACLE_SQL[name] = (f"with posts as ({posts_sql()}), {sql[5:]}" if sql.startswith("with ") else f"with posts as ({posts_sql()}) {sql}") if with_posts else sql
        return f

    return keep


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, as the SQL has them."""
    return df.select([F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


# -- search ------------------------------------------------------------------------------

SHOWN = ("id", "rating", "score", "fav_count", "created_at", "md5")
COLUMNS = ", ".join(SHOWN)
PAD = "(' ' || coalesce(tag_string, '') || ' ')"
URL_ID = r"try_cast(nullif(regexp_extract(file_url, 'pixiv\.net/artworks/(\d+)', 1), '') as bigint)"


def _search(name: str, spec: SearchSpec, where: str) -> None:
    query(name, f"select {COLUMNS} from posts where {where}")(lambda spark, d: search.matching(posts(spark, d), spec).select(*SHOWN))


_search("search_basic", SearchSpec("economy score:>200 rating:g,s"), f"contains({PAD}, ' economy ') and score > 200 and rating in ('g', 's')")
_search("search_or", SearchSpec("promo OR small medium or brand_2 OR flag_n"), f"(contains({PAD}, ' promo ') or contains({PAD}, ' small ')) and (contains({PAD}, ' medium ') or contains({PAD}, ' brand_2 ')) and contains({PAD}, ' flag_n ')")
_search("search_not", SearchSpec("-economy -score:<100"), f"not contains({PAD}, ' economy ') and not (score < 100)")
_search("search_wildcard", SearchSpec("red_* -*_rod supplier_*07"), rf"regexp_matches({PAD}, '(^|\s)red_\S*($|\s)') and not regexp_matches({PAD}, '(^|\s)\S*_rod($|\s)') and regexp_matches({PAD}, '(^|\s)supplier_\S*07($|\s)')")
_search("search_numeric_range", SearchSpec("score:100..300 favcount:3.. width:>=768 height:<1024 id:..9000 -score:150"), "score between 100 and 300 and fav_count >= 3 and image_width >= 768 and image_height < 1024 and id <= 9000 and not (score = 150)")
_search("search_rating", SearchSpec("rating:explicit,q -rating:q"), "rating in ('e', 'q') and not rating in ('q')")
_search("search_source", SearchSpec('source:http -source:https://www.pixiv* -source:"nothing.here"'), r"coalesce(starts_with(file_url, 'http'), false) and not coalesce(regexp_matches(file_url, 'https://www\.pixiv.*'), true) and not coalesce(regexp_matches(file_url, 'nothing\.here'), true)")
_search("search_source_none", SearchSpec("source:none -id:>12000"), "file_url is null and not (id > 12000)")
_search("search_source_prefix", SearchSpec("source://files"), "coalesce(starts_with(file_url, '//files'), false)")
_search("search_pixiv", SearchSpec("pixiv:100..700"), f"coalesce({URL_ID} >= 100 and {URL_ID} <= 700, false)")
_search("search_pixiv_any", SearchSpec("pixiv:any -pixiv:77 -pixiv:5.3"), rf"coalesce(regexp_matches(file_url, 'pixiv\.net/artworks/\d+'), false) and not coalesce({URL_ID} = 77, true) and not coalesce(regexp_matches(file_url, 'pixiv.net/artworks/5.3'), true)")
_search("search_unknown_prefix", SearchSpec("-md5:x -date:2001"), f"not contains({PAD}, ' md5:x ') and not contains({PAD}, ' date:2001 ')")
_search("search_orientation", SearchSpec(orientation="Portrait", ratings=("g", "e")), "image_width < image_height and rating in ('g', 'e')")
_search("search_square", SearchSpec("medium", orientation="Square"), f"image_width = image_height and contains({PAD}, ' medium ')")
_search("search_date_range", SearchSpec(date_from="1996-02-29", date_to="1997-07-01"), "created_at >= '1996-02-29' and created_at <= '1997-07-01'")
_search("search_thresholds", SearchSpec(min_score=250), "score >= 250")
_search("search_min_favs", SearchSpec(min_favs=6), "fav_count >= 6")


@query("dedup_md5", "select id, md5 from (select *, row_number() over (partition by md5 order by id nulls last, created_at nulls first) as n from posts) where n = 1")
def dedup_md5(spark: SparkSession, d: str) -> DataFrame:
    return search.first_of_file(posts(spark, d)).select("id", "md5")


@query("dedup_bucketed", "select id, md5, score, tag_string from (select *, row_number() over (partition by md5 order by id nulls last, created_at nulls first) as n from posts) where n = 1")
def dedup_bucketed(spark: SparkSession, d: str) -> DataFrame:
    """One post for each file, from a table bucketed by md5."""
    table = search.write_by_file(posts(spark, d), f"posts_by_file_{abs(hash(d)) % 10**9}", sinks.scratch(spark), 8)
    return search.first_of_bucketed(table).select("id", "md5", "score", "tag_string")


@query("sort_topk", f"select id, rating, score, fav_count, tag_string from posts where contains({PAD}, ' large ') order by fav_count desc nulls first, id nulls first limit 100")
def sort_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.preview(search.search(posts(spark, d), SearchSpec("large order:score -order:favcount order:nonsense")))


@query("search_full", f"""
    with m as (select * from posts where contains({PAD}, ' promo ') and rating in ('g', 's', 'q') and created_at >= '1996-01-01' and created_at <= '1999-12-31' and image_width > image_height and score >= 10),
    r as (select *, row_number() over (partition by md5 order by id nulls last, created_at nulls first) as n from m)
    select id, rating, score, fav_count, tag_string from r where n = 1 order by score desc nulls first, id nulls first limit 100""".strip())  # fmt: skip
def search_full(spark: SparkSession, d: str) -> DataFrame:
    spec = SearchSpec("promo", ("g", "s", "q"), "1996-01-01", "1999-12-31", "Landscape", 10, dedup=True)
    return search.preview(search.search(posts(spark, d), spec))


# -- tags --------------------------------------------------------------------------------

OCCURRENCES = "with o as (" + " union all ".join(f"select id, '{c}' as category, {i} as place, unnest(string_split(tag_string_{c}, ' ')) as tag from posts" for i, c in enumerate(CATEGORIES)) + "), t as (select * from o where tag <> '')"
TAG_MAP = "select tag, case when count(distinct category) = 1 then min(category) else 'mixed' end as category, count(*) as count, round(count(*) * 1.0 / greatest(1, (select count(*) from posts)) * 100, 6) as coverage from t group by tag"


@query("rating_distribution", "select case rating when 'g' then 'General' when 's' then 'Sensitive' when 'q' then 'Questionable' when 'e' then 'Explicit' else rating end as rating, count(*) as count from posts where rating is not null group by 1")
def rating_distribution(spark: SparkSession, d: str) -> DataFrame:
    return tags.rating_distribution(posts(spark, d))


for _c in CATEGORIES:
    query(f"top_tags_{_c}", f"select tag, count(*) as count from (select unnest(string_split(tag_string_{_c}, ' ')) as tag from posts) where tag <> '' group by tag order by count desc, tag limit 20")(lambda spark, d, c=_c: tags.top_tags(posts(spark, d), c, 20))


@query("tag_counts", "select tag, count(*) as count from (select unnest(string_split(tag_string, ' ')) as tag from posts) where tag <> '' group by tag")
def tag_counts(spark: SparkSession, d: str) -> DataFrame:
    return tags.tag_counts(posts(spark, d))


SORTED = {
    "id": "id", "id_asc": "id", "id_desc": "id desc", "score": "score desc, id", "score_desc": "score desc, id", "score_asc": "score, id",
    "favcount": "fav_count desc, id", "favcount_desc": "fav_count desc, id", "favcount_asc": "fav_count, id",
    "created_at": "created_at desc, id", "created_at_desc": "created_at desc, id", "created_at_asc": "created_at, id", "date": "created_at desc, id", "date_desc": "created_at desc, id", "date_asc": "created_at, id",
}


@query("sort_orders", " union all ".join(f"select * from (select '{name}' as ord, id from posts where contains({PAD}, ' brand_24 ') order by {by} limit 4)" for name, by in SORTED.items()))
def sort_orders(spark: SparkSession, d: str) -> DataFrame:
    """One search, whose result is written and then put into each order."""
    specs = {name: SearchSpec(f"brand_24 order:{name}") for name in SORTED}
    found = search.matching(posts(spark, d), specs["id"]).select("id", "score", "fav_count", "created_at")
    found = sinks.through_parquet(found, sinks.scratch(spark))
    first = [search.ordered(found, *spec.order()).limit(4).select(F.lit(name).alias("ord"), "id") for name, spec in specs.items()]
    return reduce(DataFrame.unionByName, first)


@query("tag_counts_raw", "select tag, count(*) as count from (select unnest(string_split(case when id % 9 = 0 then '' when id % 7 = 0 then replace(tag_string, 'promo', ' ') else tag_string end, ' ')) as tag from posts where tag_string is not null) group by tag")
def tag_counts_raw(spark: SparkSession, d: str) -> DataFrame:
    changed = F.when(F.col("id") % 9 == 0, "").when(F.col("id") % 7 == 0, F.replace("tag_string", F.lit("promo"), F.lit(" "))).otherwise(F.col("tag_string"))
    rows = posts(spark, d).where("tag_string is not null").withColumn("tag_string", changed)
    return tags.tag_counts(rows, empty=True)


@query("tag_map", f"{OCCURRENCES} {TAG_MAP} order by count desc, tag limit 150")
def tag_map(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tags.tag_map(posts(spark, d), 150))


@query("tag_map_exact_top", f"{OCCURRENCES} select tag, category, count from ({TAG_MAP}) order by count desc, tag limit 40")
def tag_map_exact_top(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent tags without counting the others; the three passes read the posts' tags from files."""
    held = posts(spark, d).select(*(f"tag_string_{c}" for c in CATEGORIES))
    return tags.most_frequent(tags.occurrences(sinks.through_parquet(held, sinks.scratch(spark))), 40, 4096)


RELATED = OCCURRENCES.replace("from posts", f"from near").replace("with o as", f"with near as (select * from posts where contains({PAD}, ' nation_9 ')), o as")


@query("tag_map_related", f"{RELATED} select * from ({TAG_MAP.replace('from posts', 'from near')} order by count desc, tag limit 60) where tag <> 'nation_9'")
def tag_map_related(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tags.tag_map(posts(spark, d), 60, "nation_9"))


BY_COLUMN = RELATED.replace(PAD, "(' ' || concat_ws(' ', " + ", ".join(f"tag_string_{c}" for c in CATEGORIES) + ") || ' ')")


@query("tag_map_related_columns", f"{BY_COLUMN} select * from ({TAG_MAP.replace('from posts', 'from near')} order by count desc, tag limit 60) where tag <> 'nation_9'")
def tag_map_related_columns(spark: SparkSession, d: str) -> DataFrame:
    """The map around a tag, of posts without tag_string."""
    return rounded(tags.tag_map(posts(spark, d).drop("tag_string"), 60, "nation_9"))


@query("tag_map_filter", f"{OCCURRENCES}, m as ({TAG_MAP}) select tag, category, count, printf('%.4f', coverage) as coverage_percent from m where contains(lower(tag), 'rod') and category = 'character' and count >= 300")
def tag_map_filter(spark: SparkSession, d: str) -> DataFrame:
    return sinks.tag_map_rows(tags.visible(rounded(tags.all_tags(posts(spark, d))), "ROD", "character", 300))


@query("tag_summary", f"{OCCURRENCES}, m as ({TAG_MAP}), v as (select * from m where count >= 1000) select (select count(*) from m) as total, (select count(*) from v) as visible, (select category from v group by category order by count(*) desc, category desc limit 1) as top_category")
def tag_summary(spark: SparkSession, d: str) -> DataFrame:
    every = tags.all_tags(posts(spark, d))
    return tags.summary(every, tags.visible(every, min_count=1000))


@query("tag_links", "select distinct tag, 'https://posts.example.org/posts?tags=' || url_encode(tag) as url from (select unnest(string_split(tag_string_character, ' ')) as tag from posts) where tag <> ''")
def tag_links(spark: SparkSession, d: str) -> DataFrame:
    return tags.tag_links(tags.top_tags(posts(spark, d), "character", 10_000), "https://posts.example.org")


@query("joined_tags", f"{OCCURRENCES}, m as ({TAG_MAP} order by count desc, tag limit 12) select string_agg(tag, ', ' order by count desc, tag) as tags from m")
def joined_tags(spark: SparkSession, d: str) -> DataFrame:
    return sinks.joined_tags(tags.tag_map(posts(spark, d), 12))


# -- time --------------------------------------------------------------------------------

for _name, _n in fn.UNIT_CHARS.items():
    query(f"date_histogram_{_name.lower()}", f"select substr(created_at, 1, {_n}) as unit, count(*) as count from posts where created_at is not null group by 1")(lambda spark, d, i=_name: timeseries.histogram(posts(spark, d), i))

RARE = f"select * from posts where contains({PAD}, ' brand_24 ') and score > 380"
FILLED = f"""
    with h as (select substr(created_at, 1, 7) as unit, count(*) as count from ({RARE}) group by 1),
    c as (select strftime(unnest(generate_series(min(cast(unit || '-01' as date)), max(cast(unit || '-01' as date)), interval 1 month)), '%Y-%m') as unit from h),
    f as (select c.unit, coalesce(h.count, 0) as count from c left join h using (unit)),
    totals as (select substr(created_at, 1, 7) as unit, count(*) as total from posts group by 1),
    s as (select f.unit, f.count, coalesce(total, 0) as total, case when total > 0 then f.count * 1.0 / total * 100 else 0.0 end as percent from f left join totals using (unit))""".strip()  # fmt: skip


def _rare(spark: SparkSession, d: str) -> DataFrame:
    return timeseries.without_gaps(timeseries.histogram(search.matching(posts(spark, d), SearchSpec("brand_24 score:>380"))))


def _rare_share(spark: SparkSession, d: str) -> DataFrame:
    return timeseries.normalized(_rare(spark, d), timeseries.histogram(posts(spark, d)))


query("histogram_gapfill", f"{FILLED} select unit, count from f")(_rare)
_STEPS = {"Year": (4, "-01-01", "%Y"), "Day": (10, "", "%Y-%m-%d")}
for _name, (_n, _rest, _shape) in _STEPS.items():
    query(
        f"histogram_gapfill_{_name.lower()}",
        f"""with h as (select substr(created_at, 1, {_n}) as unit, count(*) as count from ({RARE}) group by 1),
        c as (select strftime(unnest(generate_series(min(cast(unit || '{_rest}' as date)), max(cast(unit || '{_rest}' as date)), interval 1 {_name.lower()})), '{_shape}') as unit from h)
        select c.unit, coalesce(h.count, 0) as count from c left join h using (unit)""",
    )(lambda spark, d, i=_name: timeseries.without_gaps(timeseries.histogram(search.matching(posts(spark, d), SearchSpec("brand_24 score:>380")), i), i))
query("histogram_normalized", f"{FILLED} select unit, count, total, round(percent, 6) as percent from s")(lambda spark, d: rounded(_rare_share(spark, d)))
query("histogram_smoothed", f"{FILLED} select unit, count, total, round(avg(percent) over (order by unit rows between 4 preceding and current row), 6) as percent from s")(lambda spark, d: rounded(timeseries.smoothed(_rare_share(spark, d), "percent", 5)))

TESTS = {"a": ("promo rating:safe", f"contains({PAD}, ' promo ') and rating in ('g', 's')"), "b": ("score:>300 -small", f"score > 300 and not contains({PAD}, ' small ')"), "c": ("", "false")}
COMPARED = "select substr(created_at, 1, 4) as unit, count(*) as total, " + ", ".join(f"count(*) filter (where {w}) as {n}" for n, (_, w) in TESTS.items()) + " from posts where length(substr(created_at, 1, 4)) = 4 and created_at >= '1995-06-01' and created_at <= '2000-12-31' group by 1"


def _compared(spark: SparkSession, d: str) -> DataFrame:
    return timeseries.compare(posts(spark, d), {n: q for n, (q, _) in TESTS.items()}, "Year", "1995-06-01", "2000-12-31")


query("compare_queries", COMPARED)(_compared)
query("compare_shares", f"with c as ({COMPARED}) select unit, " + ", ".join(f"round(case when total > 0 then {n} * 1.0 / total * 100 else 0.0 end, 6) as {n}" for n in TESTS) + " from c")(lambda spark, d: rounded(timeseries.compare_shares(_compared(spark, d), list(TESTS))))
query("compare_plain", "select substr(created_at, 1, 7) as unit, count(*) as total, count(*) filter (where list_contains(string_split(tag_string, ' '), 'promo') and list_contains(string_split(tag_string, ' '), 'nation_3')) as both from posts where length(substr(created_at, 1, 7)) = 7 group by 1")(
    lambda spark, d: timeseries.compare(posts(spark, d), {}, conditions={"both": plain_condition("Promo,NATION_3")})
)


@query("event_counts", "select cast(date_trunc('day', ts) as timestamp) as start, event_type as key, count(*) as count from events group by 1, 2", with_posts=False)
def event_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = windowed_counts(spark.read.parquet(f"{d}/events.parquet"), "ts", "event_type")
    return counts.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_distinct", "select cast(date_trunc('day', ts) as timestamp) as start, event_type as label, count(*) as count from events where date_trunc('day', ts) + interval 1 day <= (select max(ts) from events) - interval 1 day group by 1, 2", with_posts=False)
def stream_distinct(spark: SparkSession, d: str) -> DataFrame:
    """A stream of events of which some arrive twice, counted once each; the windows that are closed at its end."""
    events, folder = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), sinks.scratch(spark)
    events.unionByName(events.where("event_id % 3 = 0")).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
    found = run_available(distinct_counts(stream, F.col("event_id"), "ts", F.col("event_type"), late="1 day"), f"{folder}/out", f"{folder}/checkpoint")
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


# -- explosion ---------------------------------------------------------------------------

WINDOWS = explosion.Windows("1997-01-01", "1998-12-31", "1999-01-01", "1999-06-30")


def _exploded(scan: explosion.Scan, where: str = "true") -> str:
    """SQL for rows(id, recent), c(tag, category, recent, baseline) and n(total_recent, total_baseline)."""
    w = scan.windows
    columns = " union all ".join(f"select id, recent, {i} as place, unnest(string_split(tag_string_{c}, ' ')) as tag, tag_string, tag_string_artist from rows" for i, c in enumerate(CATEGORIES) if c in scan.categories)
    within = "and list_contains(string_split(tag_string, ' '), tag)" if scan.count_mode == "tag_string" else ""
    seeds = " ".join(f"and tag <> '{s}'" for s in scan.seeds)
    return f"""with rows as (
        select *, substr(created_at, 1, 10) between '{w.recent_from}' and '{w.recent_to}' as recent from posts
        where (substr(created_at, 1, 10) between '{w.recent_from}' and '{w.recent_to}' or substr(created_at, 1, 10) between '{w.baseline_from}' and '{w.baseline_to}') and {where}),
    o as ({columns}),
    one as (select id, recent, tag, min(place) as place, any_value(case when len(string_split(tag_string_artist, ' ')) = 1 then tag_string_artist end) as solo from o where tag <> '' {within} {seeds} group by id, recent, tag),
    c as (select tag, [{", ".join(f"'{x}'" for x in CATEGORIES)}][min(place) + 1] as category, count(*) filter (where recent) as recent, count(*) filter (where not recent) as baseline from one group by tag),
    n as (select count(*) filter (where recent) as total_recent, count(*) filter (where not recent) as total_baseline from rows)"""


def _scored(new: bool = False, exclude_new: bool = False, growth: float = 1.05, least: int = 5, extra: str = "") -> str:
    kept = "baseline = 0" if new else "baseline > 0" if exclude_new else "true"
    grown = "999999.0" if new else "(rp + 1e-6) / (bp + 1e-6)"
    return f""",
    p as (select *, recent * 1.0 / total_recent * 100 as rp, baseline * 1.0 / total_baseline * 100 as bp from c, n where recent >= {least} and {kept}),
    g as (select *, cast({grown} as double) as growth from p),
    s as (select tag, category, recent as recent_count, baseline as baseline_count, round(rp, 6) as recent_pct, round(bp, 6) as baseline_pct, round(growth, 6) as growth_x,
          round(ln(1 + growth) * 45 + ln(1 + recent) * 12 + greatest(0.0, rp - bp) * 120, 6) as score from g where growth >= {growth} {extra})
    select * from s order by score desc, tag limit 60"""


_COLOR = f"case category {' '.join(f"when '{c}' then '{COLORS[c]}'" for c in CATEGORIES)} end"
RESULT = ("tag", "category", "recent_count", "baseline_count", "recent_pct", "baseline_pct", "growth_x", "score")


def _found(spark: SparkSession, d: str, scan: explosion.Scan, scoring: explosion.Scoring) -> DataFrame:
    counts = explosion.count(posts(spark, d), scan)
    return rounded(explosion.scored(counts, scoring).select(*RESULT))


ALL = explosion.Scan(WINDOWS)
CHARACTERS = explosion.Scan(explosion.Windows("1995-01-01", "1995-01-20", "1995-01-21", "1995-06-30"), ("character", "artist"))
SEEDED = explosion.Scan(WINDOWS, ("character", "general"), ("promo", "flag_n"))
BY_STRING = explosion.Scan(WINDOWS, ("copyright", "general"), count_mode="tag_string")
SOLO = explosion.Scan(WINDOWS, ("character", "general", "artist"), artists=True)
SEED_TEST = "list_contains(string_split(tag_string, ' '), 'promo') and list_contains(string_split(tag_string, ' '), 'flag_n')"
DOMINATED = "and not (category <> 'artist' and coalesce((select sum(k) >= 2 and max(k) * 100.0 / sum(k) >= 30 from (select count(*) as k from one where one.tag = g.tag and recent and solo is not null group by solo)), false))"

query("explosion_counts", f"{_exploded(ALL)} select tag, category, recent, baseline from c")(lambda spark, d: explosion.count(posts(spark, d), ALL).tags)
query("explosion_score", f"{_exploded(ALL)}{_scored()}")(lambda spark, d: _found(spark, d, ALL, explosion.Scoring(5, 1.05, 60)))
SHARES = f"""{_exploded(SOLO)},
    w as (select tag, solo, count(*) as n from one where recent and solo is not null group by tag, solo),
    v as (select tag, sum(n) as all_n, max(n) as top from w group by tag),
    a as (select v.tag, all_n, top, min(solo) as top_artist from v join w on v.tag = w.tag and w.n = v.top group by v.tag, all_n, top),
    p as (select c.*, recent * 1.0 / total_recent * 100 as rp, baseline * 1.0 / total_baseline * 100 as bp from c, n where recent >= 5),
    g as (select p.*, (rp + 1e-6) / (bp + 1e-6) as growth, all_n, top, top_artist, coalesce(category <> 'artist' and all_n >= 2, false) as known from p left join a on p.tag = a.tag)
    select tag, {_COLOR} as color, round(rp - bp, 6) as delta_pct,
           case when baseline = 0 then format('New in explosion window: {{:,}} posts, ', recent) || printf('%.5f%% of recent posts.', rp)
                else printf('Normalized share rose from %.5f%% to %.5f%% (%.2f×).', bp, rp, growth) end
           || case when known then printf(' Top artist ''%s'' = %.1f%% of recent solo posts.', top_artist, top * 100.0 / all_n) else '' end as why
    from g where growth >= 1.05 and not (known and top * 100.0 / all_n >= 30)"""

query("explosion_why", SHARES)(lambda spark, d: rounded(explosion.scored(explosion.count(posts(spark, d), SOLO), explosion.Scoring(5, 1.05, 1 << 20, dominance=30.0, dominance_min_solo=2)).select("tag", "color", "delta_pct", "why")))
query("explosion_totals", f"""{_exploded(SEEDED)}, m as (select count(*) filter (where {SEED_TEST}) as matched, count(*) filter (where recent and {SEED_TEST}) as total_recent, count(*) filter (where not recent and {SEED_TEST}) as total_baseline, count(*) as scanned from rows)
    select total_recent, total_baseline, scanned, matched from m""")(lambda spark, d: explosion.count(posts(spark, d), SEEDED).totals)
BEFORE = """with anchor as (select cast(coalesce(substr(max(created_at), 1, 10), '2000-01-01') as date) as d from posts),
    w as (select d as recent_to, d - 30 as recent_from, d - 31 as baseline_to, cast(d - 31 - interval 6 month as date) as baseline_from from anchor)
    select count(*) filter (where substr(created_at, 1, 10) between cast(recent_from as varchar) and cast(recent_to as varchar)) as total_recent,
           count(*) filter (where substr(created_at, 1, 10) between cast(baseline_from as varchar) and cast(baseline_to as varchar)) as total_baseline from posts, w"""


@query("explosion_default_windows", BEFORE)
def explosion_default_windows(spark: SparkSession, d: str) -> DataFrame:
    """Posts in the windows that are proposed from the latest date."""
    every = posts(spark, d)
    windows = explosion.Windows.before(sources.latest_date(every).first()[0])
    return explosion.count(every, explosion.Scan(windows)).totals.select("total_recent", "total_baseline")


query("explosion_only_new", f"{_exploded(CHARACTERS)}{_scored(new=True, least=1)}")(lambda spark, d: _found(spark, d, CHARACTERS, explosion.Scoring(1, 1.05, 60, only_new=True)))
query("explosion_exclude_new", f"{_exploded(CHARACTERS)}{_scored(exclude_new=True, least=1, extra=chr(32).join(['and tag not in', repr(('red_rod', 'old_gear'))]))}")(lambda spark, d: _found(spark, d, CHARACTERS, explosion.Scoring(1, 1.05, 60, exclude_new=True, excluded=("red_rod", "old_gear"))))
query("explosion_seeded", f"{_exploded(SEEDED, SEED_TEST)}{_scored()}")(lambda spark, d: _found(spark, d, SEEDED, explosion.Scoring(5, 1.05, 60)))
query("explosion_tagstring_mode", f"{_exploded(BY_STRING)}{_scored()}")(lambda spark, d: _found(spark, d, BY_STRING, explosion.Scoring(5, 1.05, 60)))
query("explosion_artist_dominance", f"{_exploded(SOLO)}{_scored(extra=DOMINATED)}")(lambda spark, d: _found(spark, d, SOLO, explosion.Scoring(5, 1.05, 60, dominance=30.0, dominance_min_solo=2)))

# -- seasonality -------------------------------------------------------------------------

LEAST = 150
COUNTED = f"""with k as (select *, coalesce(nullif(md5, ''), cast(nullif(id, 0) as varchar)) as key from posts),
    once as (select * from (select *, row_number() over (partition by key order by id nulls last, created_at nulls first) as rn from k) where key is null or rn = 1),
    o as ({" union all ".join(f"select {i} as place, created_at, unnest(string_split(tag_string_{c}, ' ')) as tag from once" for i, c in enumerate(CATEGORIES))}),
    t as (select tag, place, cast(date_diff('day', date '2000-01-01', cast('2000' || substr(created_at, 5, 6) as date)) as integer) as doy, substr(created_at, 1, 7) as ym from o where tag <> '' and tag in (select tag from o group by tag having count(*) >= {LEAST})),
    days as (select tag, doy, count(*) as n from t group by tag, doy), months as (select tag, ym, count(*) as n from t group by tag, ym),
    cats as (select tag, [{", ".join(f"'{x}'" for x in CATEGORIES)}][min(place) + 1] as category from t group by tag)"""  # fmt: skip
SPEC = seasonality.PeakSpec(30, 1.0, 0.45, 3)


def _peaks_sql(spec: seasonality.PeakSpec, where: str = "true") -> str:
    w = spec.window
    return f"""{COUNTED},
    starts as (select tag, s, sum(case when (doy - s + 366) % 366 < {w} then n else 0 end) as n from days, range(366) r(s) where tag in (select tag from cats where {where}) group by tag, s),
    best as (select tag, cast(s as integer) as best_doy, cast(n as bigint) as peak_posts from (select *, row_number() over (partition by tag order by n desc, s) as rn from starts) where rn = 1),
    f as (select best.*, total_posts, (total_posts - peak_posts) * 1.0 / {366 - w} as bg from best join (select tag, cast(sum(n) as bigint) as total_posts from days group by tag) using (tag)),
    scored as (select *, (peak_posts * 1.0 / {w} + 1e-5) / (bg + 1e-5) as sc from f),
    y as (select m.tag, substr(ym, 1, 4) as y, sum(n) as n from months m join scored using (tag)
          where substr(ym, 6, 2) in (strftime(date '2000-01-01' + best_doy, '%m'), strftime(date '2000-01-01' + cast((best_doy + {w - 1}) % 366 as integer), '%m')) group by 1, 2),
    z as (select y.tag, max(n) * 1.0 / sum(n) as part, max(n) as mx from y group by 1),
    r as (select z.tag, part, count(*) filter (where n >= mx * 0.1) as years from z join y using (tag) group by 1, 2),
    peaks as (select tag, category, case when best_doy + {w // 2} < 366 then strftime(date '2000-01-01' + cast(best_doy + {w // 2} as integer), '%m-%d') else '01-01' end as peak_date,
           best_doy, {_COLOR} as color, cast({w} as integer) as w, round(sc, 6) as score, peak_posts, round(bg, 6) as bg_avg, round(part * 100, 6) as max_peak_share, years as years_spiked, total_posts
    from scored join r using (tag) join cats using (tag) where sc >= {spec.min_score} and part <= {spec.max_peak_share} and years >= {spec.min_recurrence})"""


def _season(spark: SparkSession, d: str) -> seasonality.Counts:
    return seasonality.count(posts(spark, d), LEAST)


NAMED = seasonality.PeakSpec(90, 1.0, 0.6, 2, ("character", "general", "artist"), "*_r?d -large* -[n-o]*")

query("seasonality_doy", f"{COUNTED} select * from days")(lambda spark, d: _season(spark, d).days)
query("seasonality_ym", f"{COUNTED} select * from months")(lambda spark, d: _season(spark, d).months)
query("seasonality_all_months", "with k as (select *, coalesce(nullif(md5, ''), cast(nullif(id, 0) as varchar)) as key from posts), once as (select * from (select *, row_number() over (partition by key order by id nulls last, created_at nulls first) as rn from k) where key is null or rn = 1) select substr(created_at, 1, 7) as ym, count(*) as n from once group by 1")(lambda spark, d: _season(spark, d).all_months)
query("seasonality_dedup", "with k as (select *, coalesce(nullif(md5, ''), cast(nullif(id, 0) as varchar)) as key from posts), r as (select *, row_number() over (partition by key order by id nulls last, created_at nulls first) as rn from k) select id, md5 from r where key is null or rn = 1")(lambda spark, d: seasonality.distinct_posts(posts(spark, d)).select("id", "md5"))
query("seasonality_peaks", f"{_peaks_sql(SPEC)} select * from peaks")(lambda spark, d: rounded(seasonality.peaks(_season(spark, d), SPEC)))
query("seasonality_recurrence", f"{_peaks_sql(NAMED, r'''category in ('character', 'general', 'artist') and regexp_matches(tag, '^.*_r.d$') and not regexp_matches(tag, '^large') and not regexp_matches(tag, '^[n-o]')''')} select * from peaks")(lambda spark, d: rounded(seasonality.peaks(_season(spark, d), NAMED)))
query("seasonality_heat", f"{_peaks_sql(SPEC)} select cast(d as integer) as doy, count(tag) as tags from range(366) r(d) left join peaks on (d - best_doy + 366) % 366 < w group by d")(lambda spark, d: seasonality.heat(seasonality.peaks(_season(spark, d), SPEC)))
query("seasonality_heat_levels", f"{_peaks_sql(SPEC)}, h as (select cast(d as integer) as doy, count(tag) as tags from range(366) r(d) left join peaks on (d - best_doy + 366) % 366 < w group by d), e as (select min(tags) as lo, max(tags) as hi from h) select doy, round(case when hi <= lo or tags <= lo then 0.0 else ln(1.0 + (tags - lo)) / ln(1.0 + (hi - lo)) end, 6) as level from h, e")(
    lambda spark, d: rounded(seasonality.heat_levels(seasonality.heat(seasonality.peaks(_season(spark, d), SPEC))).select("doy", "level"))
)


@query("seasonality_kept", f"{_peaks_sql(SPEC)} select * from peaks")
def seasonality_kept(spark: SparkSession, d: str) -> DataFrame:
    """Peaks of counts that were saved and loaded again; all tables that are saved follow from one count."""
    written = sinks.through_parquet(seasonality.counted(posts(spark, d)), sinks.scratch(spark))
    counts, folder = seasonality.from_each(*seasonality.parts_of(written), LEAST), sinks.scratch(spark)
    sinks.save_tables({name: getattr(counts, name) for name in seasonality.CACHE}, folder, "posts")
    return rounded(seasonality.peaks(seasonality.Counts.of(**sinks.load_tables(spark, folder, seasonality.CACHE, "posts")), SPEC))


query("seasonality_on_day", f"{_peaks_sql(SPEC)} select tag, best_doy from peaks where (5 - best_doy + 366) % 366 < w")(lambda spark, d: seasonality.peaks_on(seasonality.peaks(_season(spark, d), SPEC), 5).select("tag", "best_doy"))
query("seasonality_ahead_mean", f"{COUNTED} select tags.tag, cast(d as integer) as doy, round(coalesce(sum(n), 0) / 7.0, 6) as mean from (select tag from cats where category = 'meta') tags cross join range(366) r(d) left join days on days.tag = tags.tag and (doy - d + 366) % 366 < 7 group by 1, 2")(
    lambda spark, d: rounded(seasonality.ahead_mean((c := _season(spark, d)).days.join(c.categories.where("category = 'meta'").select("tag"), "tag", "left_semi")))
)
query("seasonality_timeline", f"""{COUNTED}, g as (select substr(created_at, 1, 7) as ym, count(*) as total from once group by 1),
    c as (select strftime(unnest(generate_series(min(cast(ym || '-01' as date)), max(cast(ym || '-01' as date)), interval 1 month)), '%Y-%m') as ym from g)
    select c.ym, coalesce(n, 0) as n, round(coalesce(n, 0) * 1.0 / greatest(1, coalesce(total, 0)) * 100, 6) as percent from c left join (select * from months where tag = 'promo') m using (ym) left join g using (ym)""")(lambda spark, d: rounded(seasonality.timeline(_season(spark, d), "promo")))

ARRIVALS = "with a as (select *, case when id % 5 < 2 then 0 when id % 5 < 4 then 1 else 2 end as arrival from posts union all select *, 2 as arrival from posts where id % 5 < 2), k as (select *, coalesce(nullif(md5, ''), cast(nullif(id, 0) as varchar)) as key from a), once as (select * from (select *, row_number() over (partition by key order by arrival, id nulls last, created_at nulls first) as rn from k) where key is null or rn = 1)"
KEPT_UP = ARRIVALS + ", o as (" + " union all ".join(f"select {i} as place, created_at, unnest(string_split(tag_string_{c}, ' ')) as tag from once" for i, c in enumerate(CATEGORIES, 1)) + ")"


def kept_up(spark: SparkSession, d: str) -> CountStore:
    """Counts after three arrivals of files, the last of which brings posts of the first again."""
    folder, store = sinks.scratch(spark), CountStore(spark, sinks.scratch(spark))
    made = posts(spark, d).select("id", "md5", "created_at", *(f"tag_string_{c}" for c in CATEGORIES)).withColumn("part", F.expr("cast(id % 5 as int)"))
    made.write.partitionBy("part").mode("overwrite").parquet(folder)
    every = spark.read.schema(made.schema).parquet(folder)
    for part in ("part < 2", "part in (2, 3)", "part in (0, 1, 4)"):
        store.add(every.where(part))
    return store


query("kept_counts", f"{KEPT_UP} select tag, place, cast(date_diff('day', date '2000-01-01', cast('2000' || substr(created_at, 5, 6) as date)) as integer) as doy, substr(created_at, 1, 7) as ym, count(*) as n from o where tag <> '' group by all")(
    lambda spark, d: kept_up(spark, d).tags()
)
query("kept_totals", f"{KEPT_UP} select tag, count(*) as count from o where tag <> '' group by tag")(lambda spark, d: kept_up(spark, d).totals())
query("kept_months", f"{ARRIVALS} select substr(created_at, 1, 7) as ym, count(*) as n from once group by 1")(lambda spark, d: kept_up(spark, d).months())

# -- graph -------------------------------------------------------------------------------

N = 25
EVERY = f"{OCCURRENCES}, every as ({TAG_MAP} order by count desc, tag limit 8000)"
NODES = f"{EVERY}, nodes as (select *, cast(0 as bigint) as related from every order by count desc, tag limit {N})"
FOCUS = f"""{EVERY}, near as (select t.tag, count(*) as related from t join posts using (id) where contains({PAD}, ' old_rod ') group by 1),
    first as (select e.*, coalesce(related, 0) as related, 0 as turn from every e left join near using (tag) where tag = 'old_rod'),
    others as (select e.*, related, 1 as turn from every e join near using (tag) where tag <> 'old_rod' and category <> 'meta'),
    nodes as (select tag, category, count, coverage, related from (select * from first union all select * from others) order by turn, related desc, tag limit {N})"""
PAIRS = f"""u as (select distinct id, tag from (select id, unnest(string_split(tag_string, ' ')) as tag from posts) where tag in (select tag from nodes)),
    pairs as (select x.tag as a, y.tag as b, count(*) as count from u x join u y on x.id = y.id and x.tag < y.tag group by 1, 2)"""
LIMITED = ("artist", "copyright", "character", "general", "mixed", "unknown")


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.nodes(posts(spark, d), N)


def _pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The nodes and the counts of their pairs. Nodes are found in one pass over the posts' tags and pairs in a second, so
    the tags are written once; the nodes, which every part of a graph asks for, are settled."""
    made = posts(spark, d).select(*(f"tag_string_{c}" for c in CATEGORIES), "tag_string")
    every = sinks.through_parquet(made, sinks.scratch(spark))
    chosen = graph.settled(graph.nodes(every, N))
    return chosen, graph.edge_counts(every, chosen)


def _drawn(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    chosen, counts = _pairs(spark, d)
    return chosen, graph.edges(counts, chosen, 3, N)


query("bubble_nodes", f"{NODES} select * from nodes")(lambda spark, d: rounded(_nodes(spark, d)))
query("bubble_nodes_focus", f"{FOCUS} select * from nodes")(lambda spark, d: rounded(graph.nodes(posts(spark, d), N, "old_rod", LIMITED)))
query("bubble_edges", f"{NODES}, {PAIRS} select a, b, p.count, round(p.count * 1.0 / least(x.count, y.count), 6) as strength from pairs p join nodes x on a = x.tag join nodes y on b = y.tag where p.count >= 3 order by p.count desc, p.count * 1.0 / least(x.count, y.count) desc, a, b limit 125")(
    lambda spark, d: rounded(_drawn(spark, d)[1])
)
query("bubble_degree", f"{NODES}, {PAIRS} select nodes.tag, count(a) as degree from nodes left join (select * from pairs where count >= 900) p on tag in (a, b) group by 1")(
    lambda spark, d: graph.degrees((found := _pairs(spark, d))[1], found[0], 900)
)
query("bubble_radius", f"{NODES}, b as (select sqrt(min(count)) as lo, sqrt(max(count)) as hi from nodes) select tag, round(case when hi <= lo then 37.0 else 18 + (sqrt(count) - lo) / greatest(0.0001, hi - lo) * 38 end, 6) as radius from nodes, b")(
    lambda spark, d: rounded(graph.radii(_nodes(spark, d)).select("tag", "radius"))
)
query("bubble_labels", f"{NODES}, b as (select sqrt(min(count)) as lo, sqrt(max(count)) as hi from nodes), r as (select *, 18 + (sqrt(count) - lo) / greatest(0.0001, hi - lo) * 38 as radius, row_number() over (order by related desc, count desc, tag) as place from nodes, b) select tag from r where tag = 'nation_2' or place <= 10 or radius >= 24")(
    lambda spark, d: graph.labelled(graph.radii(_nodes(spark, d)), "nation_2").select("tag")
)

DRAWN = f"{NODES}, {PAIRS}, drawn as (select a, b, p.count, p.count * 1.0 / least(x.count, y.count) as strength from pairs p join nodes x on a = x.tag join nodes y on b = y.tag where p.count >= 3 order by p.count desc, strength desc, a, b limit 125)"


query("bubble_weights", f"{DRAWN}, e as (select min(count) as lo, max(count) as hi from drawn) select a, b, round(least(1.0, greatest(0.0, case when hi > lo then (count - lo) / greatest(1.0, hi - lo) else 1.0 end * 0.55 + least(1.0, greatest(0.0, strength)) * 0.45)), 6) as weight from drawn, e")(
    lambda spark, d: rounded(graph.edge_weights(_drawn(spark, d)[1]).select("a", "b", "weight"))
)
query("bubble_stronger", f"{DRAWN} select a, b, count from drawn where strength >= 40 / 100.0")(lambda spark, d: graph.stronger(_drawn(spark, d)[1], 40).select("a", "b", "count"))
query("bubble_named", f"{DRAWN}, hits as (select tag from nodes where contains(lower(tag), 'brand')) select tag, category, count from nodes where tag in (select tag from hits) or tag in (select b from drawn where a in (select tag from hits)) or tag in (select a from drawn where b in (select tag from hits))")(
    lambda spark, d: graph.named(*_drawn(spark, d), "BRAND").select("tag", "category", "count")
)


@query("order_random", "select id, row_number() over (order by md5('7:' || id), id) as place from posts where score > 300 order by place limit 200")
def order_random(spark: SparkSession, d: str) -> DataFrame:
    """The first posts of a shuffle, with their places in it."""
    first = search.search(posts(spark, d), SearchSpec("score:>300 order:random", seed=7)).limit(200)
    return first.select("id", F.row_number().over(Window.orderBy(search.shuffle_key(7), "id")).alias("place"))


query("tag_anchors", f"select id, coalesce(list_aggregate(list_transform(string_split(tag_string_artist, ' '), lambda t: '<a href=\"' || t || '\" style=\"color:{COLORS['artist']}; text-decoration:none;\">' || t || '</a>'), 'string_agg', ' '), '') as artists from posts")(
    lambda spark, d: posts(spark, d).select("id", fn.anchors(F.col("tag_string_artist"), COLORS["artist"]).alias("artists"))
)


@query("posts_files", "select id, rating, score, fav_count, created_at, case when id % 2 = 0 then md5 end as md5 from posts where created_at >= '1997-01-01' and created_at <= '1998-06-30'")
def posts_files(spark: SparkSession, d: str) -> DataFrame:
    """Posts of two Parquet files of different columns and types, read as one table."""
    every = posts(spark, d)
    folder = sinks.scratch(spark)
    every.where("id % 2 = 0").write.parquet(f"{folder}/even")
    every.where("id % 2 <> 0").select(F.col("id").cast("string").alias("id"), "rating", F.col("score").cast("double").alias("score"), F.col("fav_count").cast("int").alias("fav_count"), "created_at").write.parquet(f"{folder}/odd")
    read = sources.read_posts(spark, f"{folder}/even", f"{folder}/odd", f"{folder}/none")
    return search.matching(read, SearchSpec(date_from="1997-01-01", date_to="1998-06-30")).select("id", "rating", "score", "fav_count", "created_at", "md5")


# -- stored posts ------------------------------------------------------------------------

_stores: dict[tuple[str, str], PostStore] = {}


def stored(spark: SparkSession, d: str) -> PostStore:
    """The posts as a store, written once for each application."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _stores:
        _stores[key] = PostStore.write(posts(spark, d), sinks.scratch(spark), block_rows=1000)
    return _stores[key]


def _stored_search(name: str, spec: SearchSpec, where: str) -> None:
    query(name, f"select {COLUMNS} from posts where {where}")(lambda spark, d: stored(spark, d).matching(spec).select(*SHOWN))


_stored_search("stored_tags", SearchSpec("supplier_000000007 red_rod or blue_rod -economy", ("g", "s", "q")), f"contains({PAD}, ' supplier_000000007 ') and (contains({PAD}, ' red_rod ') or contains({PAD}, ' blue_rod ')) and not contains({PAD}, ' economy ') and rating in ('g', 's', 'q')")
_stored_search("stored_wildcards", SearchSpec("red_* -*_rod *000*07 score:>50"), rf"regexp_matches({PAD}, '(^|\s)red_\S*($|\s)') and not regexp_matches({PAD}, '(^|\s)\S*_rod($|\s)') and regexp_matches({PAD}, '(^|\s)\S*000\S*07($|\s)') and score > 50")
_stored_search("stored_months", SearchSpec("promo", date_from="1996-02-29", date_to="1996-05-01"), f"contains({PAD}, ' promo ') and created_at >= '1996-02-29' and created_at <= '1996-05-01'")


@query("stored_windows", "with w as (select 'p' || p_size as name, cast(1992 + p_size % 6 as varchar) || '-0' || (1 + p_size % 9) || '-15' as date_from, cast(1992 + p_size % 6 as varchar) || '-0' || (1 + p_size % 9) || '-28' as date_to from part where p_size <= 8 group by p_size) select name, id, created_at from posts join w on created_at >= date_from and created_at <= date_to")
def stored_windows(spark: SparkSession, d: str) -> DataFrame:
    """Posts in the windows of a table; the months to read are found as the query runs."""
    size = F.col("p_size")
    month = F.concat((1992 + size % 6).cast("string"), F.lit("-0"), (1 + size % 9).cast("string"))
    windows = spark.read.parquet(f"{d}/part.parquet").where("p_size <= 8").select("p_size").distinct()
    windows = windows.select(F.concat(F.lit("p"), size.cast("string")).alias("name"), F.concat(month, F.lit("-15")).alias("date_from"), F.concat(month, F.lit("-28")).alias("date_to"))
    return stored(spark, d).in_windows(windows).select("name", "id", "created_at")


# -- dictionary, files -------------------------------------------------------------------

WORDS = "select lower(p_name) as name, p_size from part"
DICTIONARY = "d as (select replace(lower(p_name), ' ', '_') as tag, '#' || min(lpad(cast(p_size as varchar), 6, '0')) as color, cast(sum(p_size) as bigint) as count from part group by 1), al as (select 'x_' || lower(n_name) as alias, case when n_nationkey % 2 = 0 then 'red_rod' else 'no_such_tag' end as tag from nation)"
ENTRIES = f"with {DICTIONARY}, e as (select tag as key, tag as display, tag, color, count from d union all select lower(alias), alias || ' → ' || al.tag, d.tag, color, count from al join d using (tag))"


def _dictionary(spark: SparkSession, d: str) -> DataFrame:
    part = spark.read.parquet(f"{d}/part.parquet")
    color = F.concat(F.lit("#"), F.min(F.lpad(F.col("p_size").cast("string"), 6, "0")))
    return sources.dictionary(part.groupBy(F.replace(F.lower("p_name"), F.lit(" "), F.lit("_")).alias("tag")).agg(color.alias("color"), F.sum("p_size").alias("count")))


def _entries(spark: SparkSession, d: str) -> DataFrame:
    nation = spark.read.parquet(f"{d}/nation.parquet")
    target = F.when(F.col("n_nationkey") % 2 == 0, "red_rod").otherwise("no_such_tag")
    return sources.with_aliases(_dictionary(spark, d), nation.select(F.concat(F.lit("x_"), F.lower("n_name")).alias("alias"), target.alias("tag")))


query("alias_expand", f"{ENTRIES} select * from e", with_posts=False)(_entries)
query("autocomplete", f"{ENTRIES} select display, tag, color, count, case when count >= 1000000 then printf('%.1fM', count / 1e6) when count >= 1000 then printf('%.1fk', count / 1e3) else cast(count as varchar) end as shown_count from e where starts_with(key, 'ro') or contains(key, '_ro') order by count desc, display limit 20", with_posts=False)(
    lambda spark, d: autocomplete.complete(_entries(spark, d), "ro")
)
PREFIXES = f"""{ENTRIES}, s as (select *, unnest(list_filter(range(1, length(key) + 1), lambda i: i = 1 or substr(key, i - 1, 1) = '_')) as i from e where length(key) >= 2),
    p as (select distinct substr(key, i, l) as prefix, key, display, tag, color, count from s, (select unnest([2, 3, 4]) as l) where i + l - 1 <= length(key))"""
query("autocomplete_prefixes", f"{PREFIXES} select prefix, place, display, count from (select *, cast(row_number() over (partition by prefix order by count desc, display, key, color) as integer) as place from p) where place <= 5", with_posts=False)(
    lambda spark, d: autocomplete.by_prefix(_entries(spark, d), 4, 5).select("prefix", "place", "display", "count")
)


query("dictionary_counts", f"with {DICTIONARY}, n as (select tag, count(*) as n from (select unnest(string_split(tag_string, ' ')) as tag from posts) group by 1) select d.tag, color, coalesce(n, 0) as count from d left join n using (tag)")(
    lambda spark, d: sinks.refreshed(_dictionary(spark, d).unionByName(spark.createDataFrame([], "tag string, color string, count long")), tags.tag_counts(posts(spark, d)))
)
HASH = r"coalesce(nullif(md5, ''), nullif(regexp_extract(file_url, '/([a-f0-9]{32})\.', 1), ''))"
OWN = "case when starts_with(file_url, '//') then 'https:' || file_url else file_url end"


def _rendition(size: str, ext: str) -> str:
    return f"coalesce('https://cdn.example.org/{size}/' || substr(h, 1, 2) || '/' || substr(h, 3, 2) || '/' || h || '.{ext}', {OWN})"


@query("thumb_url", f"with u as (select *, {HASH} as h from posts) select id, {_rendition('180x180', 'jpg')} as thumb, {_rendition('720x720', 'webp')} as sample from u")
def thumb_url(spark: SparkSession, d: str) -> DataFrame:
    rows = posts(spark, d).withColumn("h", fn.file_hash(F.col("md5"), F.col("file_url")))
    of = lambda size, ext: fn.derived_url("https://cdn.example.org", size, ext, F.col("h"), F.col("file_url"))
    return rows.select("id", of("180x180", "jpg").alias("thumb"), of("720x720", "webp").alias("sample"))


@query("export_urls", f"select file_url from posts where contains({PAD}, ' small ') and file_url is not null")
def export_urls(spark: SparkSession, d: str) -> DataFrame:
    return sinks.urls(search.search(posts(spark, d), SearchSpec("small order:id")))


@query("search_written", f"select id, md5 from posts where contains({PAD}, ' small ') and score > 100")
def search_written(spark: SparkSession, d: str) -> DataFrame:
    """A result that was written and read back."""
    return sinks.through_parquet(search.search(posts(spark, d), SearchSpec("small score:>100")), sinks.scratch(spark)).select("id", "md5")


@query("post_links", "select id, 'https://posts.example.org/posts/' || id as url from posts where score > 430")
def post_links(spark: SparkSession, d: str) -> DataFrame:
    return search.post_links(search.matching(posts(spark, d), SearchSpec("score:>430")), "https://posts.example.org")


@query("latest_date", "select coalesce(substr(max(created_at), 1, 10), '2000-01-01') as latest_date from posts")
def latest_date(spark: SparkSession, d: str) -> DataFrame:
    return sources.latest_date(posts(spark, d))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Tag search with ratings, one post for each file and the query's own order."""
    spec = SearchSpec("medium score:>50 rating:g,s -economy order:score", dedup=True)
    return search.preview(search.search(posts(spark, d), spec))
