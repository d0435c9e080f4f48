"""Queries of the text and address expressions over the given texts, each with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, web
from .proxy import table
from .queries import query


@query(r"""WITH d AS (SELECT doc_id, split_part(coalesce(text, ''), chr(10), 1) AS head, coalesce(text, '') AS body FROM documents)
SELECT doc_id, trim(regexp_replace(lower(head), '[^0-9a-z가-힣]+', '-', 'g'), '-') AS slug, CAST(len(string_split(replace(body, chr(13) || chr(10), chr(10)), chr(10))) AS INT) AS lines,
  coalesce(trim(head) = 'my own page' OR regexp_matches(body, 'https?://(?:[\w-]+[.])*own[.]example(?:[^\w.-]|$)'), false) AS own FROM d""")
def document_forms(spark, sf_dir):
    """Slugs of the first lines, template lines and own links of all documents."""
    body = F.coalesce("text", F.lit(""))
    head = F.substring_index(body, "\n", 1)
    return table(spark, sf_dir, "documents").select("doc_id", text.post_slug(head).alias("slug"), F.size(text.template_lines(body)).alias("lines"), web.own_post(head, body, "my own page", "own.example").alias("own"))


#: Addresses of every kind, by a page's key: what each of them is, is read off the kind.
KINDS = 10
ADDRESSES = """CASE page_id % 10 WHEN 0 THEN 'https://cafe.example/Home_' || page_id WHEN 1 THEN 'https://cafe.example/home' || page_id || '/?a=1' WHEN 2 THEN 'https://cafe.example/home' || page_id || '/boards/b-' || page_id || '#x'
  WHEN 3 THEN 'http://cafe.example/home' || page_id WHEN 4 THEN 'https://cafe.example.org/home' || page_id WHEN 5 THEN 'https://cafe.example/posts/' || page_id || '?q' WHEN 6 THEN 'https://cafe.example/posts/' || page_id || 'x' WHEN 7 THEN 'https://cafe.example/-' || page_id
  WHEN 8 THEN 'https://user@cafe.example/posts/' || page_id ELSE NULL END"""


@query(f"""WITH p AS (SELECT page_id, page_id % 10 AS k, {ADDRESSES} AS url FROM pages) SELECT page_id, CASE WHEN k = 0 THEN url END AS home,
  CASE k WHEN 0 THEN url WHEN 1 THEN 'https://cafe.example/home' || page_id END AS front, CASE WHEN k = 2 THEN 'https://cafe.example/home' || page_id || '/boards/b-' || page_id END AS board, CASE WHEN k = 5 THEN CAST(page_id AS VARCHAR) END AS post FROM p""")
def address_forms(spark, sf_dir):
    """Front pages, boards and public posts among addresses of every kind."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.expr(ADDRESSES).alias("url"))
    url, host = F.col("url"), "cafe.example"
    return rows.select("page_id", web.safe_home(url, host).alias("home"), web.community_url(url, host).alias("front"), web.community_url(url, host, True).alias("board"), text.public_post_id(url, host, "/posts").alias("post"))


@query(r"""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS text, coalesce(first_value(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS first FROM conversations),
n AS (SELECT conv_id, turn, [replace(replace(x, ',', ''), '.', '') FOR x IN regexp_extract_all(text, '[0-9][0-9,.]*')] AS mine, [replace(replace(x, ',', ''), '.', '') FOR x IN regexp_extract_all(first, '[0-9][0-9,.]*')] AS known FROM c)
SELECT conv_id, turn, len([x FOR x IN mine IF NOT list_contains(known, x)]) = 0 AS grounded FROM n""")
def grounded_turns(spark, sf_dir):
    """Turns whose every number stands in the first turn of their conversation."""
    rows = table(spark, sf_dir, "conversations")
    first = rows.groupBy("conv_id").agg(F.min_by("text", "turn").alias("first"))
    return rows.join(first, "conv_id").select("conv_id", "turn", web.grounded_numbers(F.col("text"), F.col("first")).alias("grounded"))


BADGES = ("채팅", "채팅, 읽지 않은 메시지 12개", "채팅, 읽지 않은 메시지 개", "알림", None)


@query("""SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 12 END::INT AS unread, CASE WHEN p_partkey % 3 = 0 THEN 'part|' || p_partkey ELSE 'part|' || p_partkey || '|x' END AS task,
  array_to_string(list_sort(list_distinct(list_concat([lower(replace(p_name, ' ', ''))], CASE WHEN p_partkey % 2 = 0 THEN ['홈페이지', '웹사이트'] ELSE [] END))), ',') AS keywords FROM part""")
def label_forms(spark, sf_dir):
    """Unread badges, task keys and keywords with their aliases, one of each for every part."""
    k = F.col("p_partkey")
    badge = F.element_at(F.array(*map(F.lit, BADGES)), (k % 5 + 1).cast("int"))
    words = F.array(F.col("p_name"), F.when(k % 2 == 0, " 홈 페이지 ").otherwise("  "))
    task = web.task_key(F.lit("part"), k.cast("string"), F.when(k % 3 != 0, "x"))
    return table(spark, sf_dir, "part").select(k.alias("id"), text.badge_count(badge).alias("unread"), task.alias("task"), F.array_join(web.expanded_keywords(words, [{"홈페이지", "웹사이트"}, {"쇼핑몰", "자사몰"}]), ",").alias("keywords"))
