"""Every query with an SQL text gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

from tidemill.plans import queries as review
from tidemill.plans import readings, records, texts  # noqa: F401 - they register their queries

SF = "/root/testdata/sf0.001"
#: Queries that find nothing in the smallest tables.
MAY_BE_EMPTY = {"queue_page", "application_candidates", "candidate_links", "pending_notices", "chat_batch", "summary_notices", "run_page", "lead_by_id"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(value, 6) if isinstance(value, float) else value


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(review.SQL))
def test_query_against_oracle(spark, duck, name):
    df = review.QUERIES[name](spark, SF)
    got = duck.execute(review.SQL[name])
    columns = [c[0] for c in got.description]
    want = rows(columns, got.fetchall())
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == want
    assert name in MAY_BE_EMPTY or want[1]


def test_masking_leaves_no_address(spark):
    assert review.QUERIES["masked_documents"](spark, SF).where("masked rlike '[a-z0-9]+@[a-z0-9]+[.]com'").count() == 0


def test_page_contents_of_cut_pages(spark, tmp_path):
    """References that are cut off at the end of a title, ones without their end, and such inside addresses and scripts."""
    titles = ["a &amp; b &amp", "x&lt", "q&quot", "it&#x27", "it&#x2", "&amp;amp;", "&amp;lt", "AT&T", "a &lt;b&gt; &quot;c&quot; &#x27;d&#x27;", "&ampx; &copy 1", "&"]
    html = [f'<html><head><title>{t}</title><script>if (a && b) c &amp= 1</script></head><body><h1 class="t"> {t} </h1><a href="/p?a=1&amp=2&b=3">n</a></body></html>' for t in titles]
    spark.createDataFrame([(k, "https://p.example/x", h) for k, h in enumerate(html)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(review.SQL["page_contents"])
    expected = rows([c[0] for c in want.description], want.fetchall())
    got = review.QUERIES["page_contents"](spark, str(tmp_path))
    assert rows(got.columns, got.collect()) == expected
