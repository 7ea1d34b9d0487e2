"""Queries on texts, addresses and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..functions import values as V
from ..sources.tables import table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(r"SELECT page_id, regexp_replace(nullif(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), ''), '^www\.', '') AS host, nullif(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '') AS path FROM pages")
def url_host_label(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", X.host(u).alias("host"), F.nullif(F.try_parse_url(u, F.lit("PATH")), F.lit("")).alias("path"))


# address, its platform, whether it is a list, whether it is a video site: by reading the rules
SITES = [
    ("https://www.youtube.com/results?q=1", "유튜브", True, True), ("https://www.youtube.com/watch?v=abcdefghijk", "유튜브", False, True), ("https://youtu.be/abcdefghijk", "유튜브", False, True),
    ("https://www.tiktok.com/@a/video/123", "tiktok.com", False, True), ("https://www.tiktok.com/discover/cats", "tiktok.com", True, True), ("https://vm.tiktok.com/ZM1", "vm.tiktok.com", False, True),
    ("https://www.bilibili.com/video/BV1", "비리비리", False, True), ("https://weibo.com/1/2", "웨이보", False, True), ("https://www.instagram.com/explore/x", "instagram.com", True, True),
    ("https://www.reddit.com/r/cats/", "reddit.com", True, True), ("https://news.example.org/a", "news.example.org", False, False), ("https://v.qq.com/x", "텐센트 영상", False, True),
]
SITE_SQL = "(VALUES " + ", ".join(f"({i}, '{u}', '{p}', {a}, {v})" for i, (u, p, a, v) in enumerate(SITES)) + ") s(i, url, platform, listed, video)"


def site(number):
    return F.element_at(F.array(*[F.lit(s[0]) for s in SITES]), (number % len(SITES) + 1).cast("int"))


@query(f"SELECT page_id, s.platform AS label FROM pages JOIN {SITE_SQL} ON s.i = page_id % {len(SITES)}")
def platform_label(spark, d):
    return table(spark, d, "pages").select("page_id", X.platform(F.lit(""), site(F.col("page_id"))).alias("label"))


@query(f"SELECT page_id, s.listed AS listing FROM pages JOIN {SITE_SQL} ON s.i = page_id % {len(SITES)}")
def listing_class(spark, d):
    return table(spark, d, "pages").select("page_id", X.is_listing(site(F.col("page_id"))).alias("listing"))


GENRES = ["LOL 하이라이트", "축구 중계", "한국 영화", "먹방", "아이돌 무대", "고양이", "반려견 훈련", "역사 이야기", "정치 토론", "썰 모음", "해외 반응", "예능 클립", "공감 밈", "없음"]
GENRE_CLASS = ["게임", "스포츠", "영화·드라마 요약", "푸드", "연예 이슈", None, "동물·펫", "지식·역사·교양", "정치·시사", "썰·사연·애니툰", "국뽕·해외반응", "방송·예능", "유머·밈·바이럴", None]
GENRE_SQL = "(VALUES " + ", ".join(f"({i}, {'NULL' if c is None else repr(c)})" for i, c in enumerate(GENRE_CLASS)) + ") g(i, category)"


@query(f"SELECT page_id, g.category FROM pages JOIN {GENRE_SQL} ON g.i = page_id % {len(GENRES)}")
def genre_class(spark, d):
    genre = F.element_at(F.array(*map(F.lit, GENRES)), (F.col("page_id") % len(GENRES) + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", X.category(genre).alias("category"))


@query("SELECT doc_id, substr(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' '), 1, 300) AS tidy, length(regexp_replace(text, '[^0-9A-Za-z가-힣]', '', 'g')) AS letters FROM documents")
def text_clean(spark, d):
    return table(spark, d, "documents").select("doc_id", X.tidy(F.col("text"), 300).alias("tidy"), F.length(X.letters_only(F.col("text"))).cast("bigint").alias("letters"))


@query("""
WITH p AS (SELECT p_partkey, p_name || ' ' || p_type || ' ' || p_brand AS t FROM part),
f AS (SELECT p_partkey, list_reduce(list_transform(string_split_regex(trim(t), '\\s+'), lambda w: {'done': []::VARCHAR[], 'line': w}), lambda a, x: CASE WHEN length(a.line || ' ' || x.line) > 12
  THEN {'done': list_append(a.done, a.line), 'line': x.line} ELSE {'done': a.done, 'line': a.line || ' ' || x.line} END) AS s FROM p)
SELECT p_partkey, array_to_string(list_append(s.done, s.line)[1:3], chr(10)) AS lines FROM f""")
def word_wrap(spark, d):
    return table(spark, d, "part").select("p_partkey", X.wrapped(F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("lines"))


@query("SELECT p_partkey, 'PT' || (p_size // 7) || 'H' || p_size || 'M' || (p_partkey % 60) || 'S' AS iso, ((p_size // 7) * 3600 + p_size * 60 + p_partkey % 60)::INT AS seconds FROM part")
def iso_duration(spark, d):
    iso = F.format_string("PT%dH%dM%dS", F.floor(F.col("p_size") / 7), F.col("p_size"), F.col("p_partkey") % 60)
    return table(spark, d, "part").select("p_partkey", iso.alias("iso"), X.iso_seconds(iso).alias("seconds"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice * 1000 >= 5000000 THEN 'S' WHEN o_totalprice * 1000 >= 1000000 THEN 'A' WHEN o_totalprice * 1000 >= 300000 THEN 'B' WHEN o_totalprice * 1000 >= 100000 THEN 'C' ELSE 'D' END AS grade, CASE WHEN o_orderkey % 700 = 0 THEN '알수없음' WHEN o_orderkey % 700 <= 60 THEN '높음' WHEN o_orderkey % 700 <= 180 THEN '중간' ELSE '낮음' END AS confidence FROM orders")
def grade_labels(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.grade(F.col("o_totalprice") * 1000).alias("grade"), X.short_confidence(F.col("o_orderkey") % 700).alias("confidence"))


@query("SELECT o_orderkey, (o_orderkey * 37 // 60000)::VARCHAR || ':' || lpad((o_orderkey * 37 // 1000 % 60)::VARCHAR, 2, '0') AS label FROM orders")
def clock_text(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.seconds_label(F.floor(F.col("o_orderkey") * 37 / 1000)).alias("label"))


@query("SELECT c_custkey, replace(replace(replace(c_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS safe, CASE WHEN starts_with(c_name, '@') THEN c_name ELSE '@' || c_name END AS handle, coalesce(nullif(split_part(c_name || '@x', '@', 1), ''), '회원') AS nick FROM customer")
def name_labels(spark, d):
    n = F.col("c_name")
    return table(spark, d, "customer").select("c_custkey", X.escape_html(n).alias("safe"), X.handle(n).alias("handle"), X.nickname(F.lit(""), F.concat(n, F.lit("@x"))).alias("nick"))


EXCITING = ["드디어 나왔다", "평범한 하루", "충격 반전", "위기의 순간", "조용한 산책", "세계 최초 공개", "믿을 수 없는 일", "Wow!", "기록"]
HOT = [True, False, True, True, False, True, True, True, False]


@query(f"SELECT doc_id, ([{', '.join(str(h).lower() for h in HOT)}])[doc_id % {len(HOT)} + 1] AS hot FROM documents")
def hot_words(spark, d):
    line = F.element_at(F.array(*map(F.lit, EXCITING)), (F.col("doc_id") % len(EXCITING) + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", X.any_of(line, V.HOT_WORDS).alias("hot"))


@query("SELECT lang, count(*) AS n, count(*) FILTER (WHERE n_chars < 1000) AS short FROM documents GROUP BY lang")
def language_counts(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_chars") < 1000).alias("short"))


@query("SELECT page_id, length(regexp_replace(html, '<[^>]+>', '', 'g')) AS chars FROM pages")
def tag_strip(spark, d):
    return table(spark, d, "pages").select("page_id", F.length(X.strip_tags(F.col("html"))).cast("bigint").alias("chars"))


@query("SELECT p_partkey, (floor(p_retailprice / 16) * 16)::BIGINT AS down, (floor(p_retailprice / 16 + 0.5) * 16)::BIGINT AS near, floor(p_retailprice * 10 + 0.5) / 10 AS tenth FROM part")
def grid_snap(spark, d):
    p = F.col("p_retailprice")
    return table(spark, d, "part").select("p_partkey", X.floor16(p).alias("down"), X.snap16(p).alias("near"), X.round_to(p, 1).alias("tenth"))
