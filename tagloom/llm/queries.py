"""One query opN_<name> for each operator, over its whole table, and SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import align, codes, decontaminate, exact_dedup, jaccard, line_dedup, packing, ppm, quality, token_store, toxicity, url_filter, warc
from tagloom.llm.store import fresh_dir

TOKENIZERS = {"bytes": "byte_bpe_50k.json", "words": "word_bpe_49k.json", "pieces": "piece_bpe_32k.model"}
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def tokenizer_path(kind: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZERS[kind])


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _read(spark, sf_dir, "labels")))


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(_read(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = jaccard.link(_read(spark, sf_dir, "documents"), width=4, num=85, den=100)
    return linked.select("doc_id", "n_shingles", "component_id")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_dir(spark, "tokens")
    manifest = token_store.write_tokens(_read(spark, sf_dir, "documents"), tokenizer_path("bytes"), folder)
    return token_store.read_tokens(spark, folder, manifest)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path("words"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark(_read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(_read(spark, sf_dir, "pages"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_dir(spark, "warc")
    return warc.read(warc.write(_read(spark, sf_dir, "pages"), folder), folder)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(_read(spark, sf_dir, "embeddings"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.rules(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(_read(spark, sf_dir, "documents"), tokenizer_path("bytes"), tokenizer_path("pieces"))


_ALL = (
    op1_quality, op2_ppm, op3_ngram_jaccard, op4_token_store, op5_packing, op6_exact_dedup, op7_decontamination,
    op8_line_dedup, op9_warc, op10_toxicity, op11_vector_codes, op12_url_filter, op13_token_alignment,
)
QUERIES = {f.__name__: f for f in _ALL}


def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Each round as two tables: the nearest entry of every part, and the entries after it. A part's
    nearest entry is the least of distance * entries + index."""
    nearest = """
        {name} as materialized (
            select v.id, v.part, v.x, min(list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * {entries} + b.entry) as best
            from parts v join {books} b on v.part = b.part group by v.id, v.part, v.x)"""
    moved = """
        sums{k} as (
            select part, best % {entries} as entry, pos, count(*) as n, sum(y) as y
            from (select part, best, unnest(x) as y, unnest(range(1, len(x) + 1)) as pos from near{k}) group by all),
        means{k} as (select part, entry, list(cast((y - ((y % n) + n) % n) // n as bigint) order by pos) as x from sums{k} group by part, entry),
        books{after} as materialized (select b.part, b.entry, coalesce(m.x, b.x) as x from books{k} b left join means{k} m on b.part = m.part and b.entry = m.entry)"""
    steps = [nearest.format(name=f"near{k}", books=f"books{k}", entries=entries) + "," + moved.format(k=k, after=k + 1, entries=entries) for k in range(rounds)]
    return f"""
        with whole as (
            select vec_id, label, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as x from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        parts as materialized (
            select vec_id as id, unnest(range({parts})) as part, list_slice(x, part * (len(x) // {parts}) + 1, (part + 1) * (len(x) // {parts})) as x from whole),
        books0 as materialized (select part, row_number() over (partition by part order by id) - 1 as entry, x from parts qualify entry < {entries}),
        {",".join(steps)},
        {nearest.format(name="last", books=f"books{rounds}", entries=entries)},
        coded as (select id, string_agg(printf('%02x', cast(best % {entries} as int)), '' order by part) as code, cast(sum(best // {entries}) as bigint) as error from last group by id),
        digest as (select sha256(string_agg(array_to_string(x, ','), ',' order by part, entry)) as codebooks_sha256 from books{rounds})
        select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
        from whole join coded on vec_id = id join digest on true
    """

ORACLE_SQL = {
    "op3_ngram_jaccard": r"""
        with recursive w as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
        s as (
            select doc_id, case when len(w) >= 4 then list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
                                when len(w) > 0 then [array_to_string(w, ' ')] else [] end as grams from w),
        e as (select doc_id, len(grams) as n, unnest(grams) as gram from s),
        links as (
            select a.doc_id as a, b.doc_id as b from e a join e b on a.gram = b.gram and a.doc_id <> b.doc_id
            group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        reach(doc_id, other) as (select doc_id, doc_id from s union select reach.doc_id, links.b from reach join links on links.a = reach.other)
        select s.doc_id, cast(len(grams) as bigint) as n_shingles, least_id as component_id
        from s join (select doc_id, min(other) as least_id from reach group by doc_id) c on s.doc_id = c.doc_id
    """,
    "op8_line_dedup": rf"""
        with cut as (
            select page_id, nullif(lower(regexp_extract(url, '{line_dedup.HOST}', 1)), '') as host,
                   string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{line_dedup.HIDDEN}', chr(10), 'g'), '{line_dedup.BLOCKS}', chr(10), 'g'), '{line_dedup.TAGS}', '', 'g'), chr(10)) as raw
            from pages),
        t as (select page_id, host, list_filter(list_transform(raw, lambda x: regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')), lambda x: x <> '') as lines from cut),
        sites as (select host, count(*) as host_pages from t where host is not null group by host),
        often as (
            select host, line from (select host, unnest(list_distinct(lines)) as line from t where host is not null)
            join sites using (host) group by host, line, host_pages
            having count(*) > 1 and count(*) > host_pages * cast({line_dedup.MAX_RATIO} as double)),
        known as (select host, list(line) as common from often group by host),
        met as (
            select page_id, t.host, host_pages, lines, list_filter(lines, lambda x: common is null or not list_contains(common, x)) as stay
            from t left join sites on t.host = sites.host left join known on t.host = known.host)
        select page_id, host, host_pages, len(lines) as n_lines, len(lines) - len(stay) as n_dropped, array_to_string(stay, chr(10)) as text from met
    """,
    "op9_warc": r"""
        with t as (select page_id, coalesce(html, '') as html from pages),
        d as (select page_id, strlen(html) as payload_bytes, sha1(html) as hex, max(page_id) over (partition by html) as keep from t),
        b as (select *, list_transform(range(0, 32), lambda i: cast((cast('0x' || substr(hex, cast(i * 5 // 4 as int) + 1, 2) || '00' as integer) >> (11 - cast(i * 5 % 4 as int))) & 31 as int)) as quintets from d)
        select page_id, payload_bytes, array_to_string(list_transform(quintets, lambda q: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', q + 1, 1)), '') as payload_digest,
               case when page_id = keep then 'response' else 'revisit' end as record_type, case when page_id <> keep then keep end as refers_to
        from b
    """,
    "op11_vector_codes": _codes_sql(),
    "op12_url_filter": rf"""
        with rules(verdict, host, start) as (values {", ".join(f"('{v}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in RULES)}),
        cut as (
            select page_id, translate(regexp_extract(coalesce(url, ''), '{url_filter.URL}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                   regexp_extract(coalesce(url, ''), '{url_filter.URL}', 2) as path, row_number() over () as row from pages),
        best as (
            select row, arg_max(r.host || start, (length(r.host || start), length(r.host))) as rule, arg_max(verdict, (length(r.host || start), length(r.host))) as verdict
            from cut c join rules r on (c.host = r.host or ends_with(c.host, '.' || r.host)) and starts_with(path, start) group by row)
        select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from cut left join best on cut.row = best.row
    """,
    "op6_exact_dedup": r"""
        with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
        select doc_id, min(doc_id) over g as keep_id, count(*) over g as group_size,
               doc_id is not distinct from min(doc_id) over g as kept, text_sha256
        from t window g as (partition by text_sha256)
    """,
}
