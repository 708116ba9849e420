"""Posts made of the star schema of the test tables, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagloom.sources.posts import conform

TABLES = ("lineitem", "part", "supplier", "nation", "orders", "customer")

_VIEW = """
with li as (
  select l_orderkey k, lower(replace(s_name, '#', '_')) artist, lower(replace(sn.n_name, ' ', '_')) snat,
         lower(replace(p_name, ' ', '_')) ch, lower(p_type) ty, lower(replace(p_brand, '#', '_')) br, concat('flag_', lower(l_returnflag)) fl
  from {lineitem} join {part} on l_partkey = p_partkey join {supplier} on l_suppkey = s_suppkey join {nation} sn on s_nationkey = sn.n_nationkey),
g as (select k, AGG(artist) a, AGG(ch) c, AGG(ty) t1, AGG(br) t2, AGG(fl) m, AGG(snat) sn, count(*) n from li group by k)
select o_orderkey id,
  case substr(o_orderpriority, 1, 1) when '1' then 'e' when '2' then 'q' when '3' then 's' when '4' then 'g' end rating,
  cast(floor(o_totalprice / 1000) as bigint) - 50 score, coalesce(n, 0) fav_count,
  case o_orderkey % 4 when 0 then concat('https://www.pixiv.net/artworks/', cast(o_custkey as string))
                      when 1 then concat('https://cdn.example.org/original/', md5(cast(o_custkey as string)), '.jpg')
                      when 2 then concat('//files.example.org/', cast(o_orderkey as string)) end file_url,
  a tag_string_artist, lower(replace(n_name, ' ', '_')) tag_string_copyright, c tag_string_character,
  (t1 || ' ' || t2 || ' ' || sn) tag_string_general, m tag_string_meta,
  cast(512 + (o_orderkey % 7) * 128 as bigint) image_width, cast(512 + (o_custkey % 5) * 128 as bigint) image_height,
  substr(cast(o_orderdate as string), 1, 10) created_at,
  case when o_orderkey % 50 <> 0 then md5(cast(o_custkey * 7 + o_orderkey % 3 as string)) end md5,
  (a || ' ' || lower(replace(n_name, ' ', '_')) || ' ' || c || ' ' || t1 || ' ' || t2 || ' ' || sn || ' ' || m) tag_string
from {orders} join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey left join g on o_orderkey = k
"""


def _aggregates(sql: str, spelling: str) -> str:
    for column in ("artist", "ch", "ty", "br", "fl", "snat"):
        sql = sql.replace(f"AGG({column})", spelling.format(c=column))
    return sql


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are dealt by order before they are grouped: a partial aggregate in front of the shuffle would meet each
    order once, sort all lines and move six arrays for each. An order's lines are one set, whose columns are told
    apart in the order's row; six sets would each be filled, written and sorted."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    dealt = _VIEW.replace("select l_orderkey k,", "select /*+ repartition(k) */ l_orderkey k,")
    grouped = dealt.replace("count(*) n from li group by k", "n from (select k, collect_set(struct(artist, ch, ty, br, fl, snat)) line, count(*) n from li group by k)")
    return conform(spark.sql(_aggregates(grouped, "array_join(sort_array(array_distinct(line.{c})), ' ')"), **tables))


def posts_sql() -> str:
    """A select with the same rows in DuckDB."""
    return _aggregates(_VIEW, "string_agg(distinct {c}, ' ' order by {c})").format(**{t: t for t in TABLES})
