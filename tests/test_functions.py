"""Column functions and page readers on small inputs."""

from pyspark.sql import functions as F

from tidemill.analysis import pay, score
from tidemill.functions import clock, money, text, web
from tidemill.operators import community, folds, ingest, leads, merge, metrics, relations, windows
from tidemill.sources import pages


def values(spark, expression, inputs, kind="string"):
    """What an expression of column ``x`` makes of each input."""
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(inputs)], f"k int, x {kind}").coalesce(1)
    return [r.y for r in rows.select("k", expression(F.col("x")).alias("y")).orderBy("k").collect()]


def test_texts(spark):
    assert values(spark, text.first_sentence, ["a.\n - Version 3.5 is out! Buy it", "short\nfive5", "x" * 95, None]) == ["Version 3.5 is out!", None, "x" * 89 + "…", None]
    assert values(spark, text.normalize_text, [" a \t b\r\n\r\n\r\n\r\nc&nbsp;&amp;d "]) == ["a b\n\nc &d"]
    assert values(spark, text.post_slug, ["Web 사이트 — Build!"]) == ["web-사이트-build"]
    assert values(spark, text.title_key, ["Ti-tle 1!", None]) == ["title1", None]
    assert values(spark, lambda x: F.size(text.trigrams(x)), ["a b c d", "ab", "", None, "😀😀😀a"]) == [2, 0, 0, 0, 2]
    assert values(spark, lambda x: text.redact_log(x, ("hush",)), ["token=abc mail a@b.com 010-1234-5678 hush", "Bearer abc.def"]) == ["token=[masked] mail [email] [phone] [masked]", "Bearer [masked]"]
    assert values(spark, text.mask_personal, ["전화 02-123-4567, 성명: 김", "sk-abcdefgh12 x"]) == ["전화 [전화번호], 성명: 김", "[API키] x"]
    assert values(spark, lambda x: text.public_post_id(x, "www.b.example", "/ab"), ["https://www.b.example/ab/12", "http://www.b.example/ab/12", "https://evil.www.b.example/ab/12"]) == ["12", None, None]
    assert values(spark, text.template_lines, ["a\r\nㅤ\nb"]) == [["a", "", "b"]]
    assert values(spark, text.badge_count, ["채팅, 읽지 않은 메시지 12개", "채팅", "none"]) == [12, 0, None]
    assert values(spark, lambda x: text.grounded(F.array(x), F.lit("one two")), ["two", "three"]) == [True, False]
    assert values(spark, lambda x: web.grounded_numbers(x, F.lit("costs 1,500 for 3")), ["1500 and 3", "4"]) == [True, False]
    assert len(values(spark, lambda x: text.ref_key(x, F.lit("u")), ["1", None])[0]) == 64


def test_money(spark):
    assert values(spark, money.won, [150_000, 1234, 10_000, 25_001], "long") == ["15만원", "1,234원", "1만원", "25,001원"]
    assert values(spark, lambda x: money.legacy_scalar(x), [2**53 - 1, 2**53], "long") == [2**53 - 1, None]
    assert values(spark, lambda x: money.token_cost_micros(x, F.lit(1), F.lit(150), F.lit(600)), [10, 0], "long") == [3, 1]
    assert values(spark, lambda x: money.ranges_conflict(x, x, F.lit(5), F.lit(None).cast("int")), [4, 5], "int") == [True, False]
    budget = lambda x: F.struct(pay.budget_label(x)["min"], pay.budget_label(x)["max"], pay.budget_label(x)["unit"])
    assert [tuple(r) for r in values(spark, budget, ["예산 건당 최소 50만원", "월급 최대 300만원", "100~200만원"])] == [(500000, None, "project"), (None, 3000000, "month"), (1000000, 2000000, "unknown")]
    short = lambda x: pay.pay_short(F.struct(x.alias("min"), F.lit(20000).alias("max"), F.lit("hour").alias("unit")))
    assert values(spark, short, [10000, 20000, None], "int") == ["시급 1만원~2만원", "시급 2만원", "시급 2만원"]


def test_clock(spark):
    at = lambda x: x.cast("timestamp_ntz")
    iso = lambda x: F.concat_ws("|", clock.parse_iso(x)["at"].cast("string"), clock.parse_iso(x)["precision"])
    assert values(spark, iso, ["2024-01-02", "2024-01-02T03:00:00+09:00", "2024-01-02T03:00:00", "x", None]) == ["2024-01-01 15:00:00|day", "2024-01-01 18:00:00|exact", "unknown", "unknown", "unknown"]
    assert [str(v) for v in values(spark, lambda x: clock.quiet_end(at(x), "08:00"), ["2024-01-01 14:00:00", "2024-01-01 23:30:00"])] == ["2024-01-01 23:00:00", "2024-01-02 23:00:00"]
    assert [str(v) for v in values(spark, lambda x: clock.relative_time(x, F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")), ["3일 전", "방금", "yesterday", "2 hours ago", "soon"])] == ["2024-01-07 00:00:00", "2024-01-10 00:00:00", "2024-01-09 00:00:00", "2024-01-09 22:00:00", "None"]
    assert [str(v) for v in values(spark, lambda x: metrics.sales_period(at(x))[0], ["2024-01-30 15:00:00"])] == ["2024-01-02"]


def test_web(spark):
    assert values(spark, lambda x: web.safe_home(x, "c.example"), ["https://c.example/abc/", "https://c.example/abc/x", "http://c.example/abc", "https://c.example.evil/abc"]) == ["https://c.example/abc", None, None, None]
    assert values(spark, lambda x: web.community_url(x, "c.example", board=True), ["https://c.example/abc/boards/b1?x=1", "https://c.example/abc"]) == ["https://c.example/abc/boards/b1", None]
    assert values(spark, lambda x: web.expanded_keywords(x, [{"홈페이지", "웹사이트"}]), [["홈 페이지", "App", " "]], "array<string>") == [["app", "웹사이트", "홈페이지"]]
    match = lambda x: F.struct(web.title_match(x, F.array(F.lit("홈페이지"), F.lit("자동화")), F.array(F.lit("홈페이지")), "제작", "만들", "조립", "PLC"))["col1"]
    assert [tuple(r) for r in values(spark, match, ["홈페이지 제작", "홈페이지 문의", "자동화 만들기 조립", "자동화 만들기 조립 PLC", "기타"])] == [(True, False, False), (False, True, False), (False, False, True), (False, True, False), (False, False, False)]
    assert values(spark, web.comment_class, ["견적 부탁드립니다", "언제 되나요", "좋아요", "정말?"]) == ["request", "question", "other", "question"]
    assert values(spark, lambda x: web.own_post(F.lit("t"), x, "mine", "me.kr"), ["see https://www.me.kr/a", "me.kr", "notme.kr", "https://me.kr.evil.com", "x"]) == [True, True, False, False, False]
    assert values(spark, lambda x: web.alert_text(F.lit("New"), x, F.lit(1000), F.lit(2000), F.lit(None).cast("string")), ["Post"]) == ["New\nPost\n1,000~2,000원"]
    assert values(spark, lambda x: web.task_key(x, F.lit("b")), ["a"]) == ["a|b"] and len(set(values(spark, lambda x: web.guard_hash(x, F.lit("c"), F.lit(1), F.lit(2)), ["a", "b"]))) == 2


BOARD = """<html><body><div class="list"><a href="/ab/1">First</a><a href="/ab/2">Second</a><a href="/ab/1">First again</a></div>
<article><div class="user_info_contact"><button class="btn_cash done">마감된 의뢰입니다</button></div><div class="article-body">이 카페는 홍보 금지 입니다. 다른 문장.</div></article></body></html>"""
HOME = """<html><body><h2>My club</h2><p>멤버 1,234명 게시글 56개</p><a href="/club/posts/new">글쓰기</a><a href="/club/boards/j">구직 게시판</a><a href="/club/boards/f">자유게시판</a><button aria-label="사용자 메뉴">me</button></body></html>"""


def read(spark, html, url="https://c.example/club"):
    return pages.read_pages(spark.createDataFrame([(html, url)], "html string, url string"))


def test_boards(spark):
    r = read(spark, BOARD).select(pages.board_cards(r"/ab/(\d+)$").alias("c"), pages.closed_button("btn_cash", "마감된 의뢰입니다", "user_info_contact").alias("closed"), pages.rule_sentences().alias("rules"), pages.listing_state(pages.links("/ab/"), ("없음",)).alias("state"), pages.links("/ab/").alias("links")).first()
    assert [(c.post_id, c.title) for c in r.c] == [("1", "First"), ("2", "Second")] and r.closed and r.rules == ["이 카페는 홍보 금지 입니다."] and r.state == "listed"
    assert r.links == ["https://c.example/ab/1", "https://c.example/ab/2"]
    empty = read(spark, "<p>결과 없음</p>").select(pages.listing_state(pages.links("/ab/"), ("없음",)).alias("a"), pages.listing_state(pages.links("/ab/"), ("none",)).alias("b")).first()
    assert (empty.a, empty.b) == ("empty", "unreadable")


def test_communities(spark):
    rules = F.lit("구직 게시판에서는 구직글 게시 가능합니다.")
    home = read(spark, HOME)
    r = home.select(pages.community_home(F.col("url"), rules).alias("h"), pages.community_home(F.col("url"), F.lit("홍보 금지")).alias("banned"), pages.session_state(F.lit(200)).alias("s"), pages.session_state(F.lit(403)).alias("t")).first()
    assert tuple(r.h) == ("My club", 1234, 56, True, "eligible") and r.banned.status == "excluded" and (r.s, r.t) == ("logged_in", "needs_user")
    kinds = values(spark, lambda x: pages.board_class(x, rules), ["구직 게시판", "자유게시판", "홍보 게시판"])
    assert [tuple(k) for k in kinds] == [("job_seek", True), ("free", False), ("job_seek", False)]
    links = read(spark, '<a href="https://c.example/x">Web club</a><a href="/y">Other</a><a href="/x/">Web Club two</a>', "https://c.example/").select(pages.directory_links(("WEB",), "c.example").alias("d")).first().d
    assert [(d.url, d.name) for d in links] == [("https://c.example/x", "Web Club two")]


def test_job_postings(spark):
    bad = read(spark, '<script type="application/ld+json">{bad</script><script type="application/ld+json">[{"@type":"JobPosting","title":"T","description":"<b>B</b>","jobLocation":[{"address":{"addressRegion":"Seoul","streetAddress":"1"}},{"address":"Busan"}],"validThrough":"2020-01-01"}]</script>')
    r = pages.job_posts(bad, pages.Profile(), "2024-01-01 00:00:00").first()
    assert (r.outcome, r.post_title, r.body, r.source_status, r.workplace) == ("ok", "T", "B", "closed", "Seoul 1, Busan")
    assert pages.job_posts(read(spark, "<p>x</p>"), pages.Profile(block_markers=("x",)), "2024-01-01 00:00:00").first().outcome == "blocked"


def test_feeds(spark):
    store = '{"ROOT":{"edges":[{"__ref":"P:1"},{"__ref":"P:2"},{"__ref":"P:9"}]},"P:1":{"id":"1","title":"A","closed":false,"salaryType":"HOUR"},"P:2":{"id":"2","title":"B","closed":true}}'
    posts = values(spark, lambda x: pages.feed_posts(x), [store])[0]
    assert [(p.post_id, p.title, p.closed, p.pay_unit) for p in posts] == [("1", "A", False, "HOUR"), ("2", "B", True, None)]


def test_store_details(spark):
    import json

    def store(**post):
        user = post.pop("user", {"webCrawlNotAllowed": False})
        return json.dumps({
            "client:root": {'permalinkPairByPublicId(publicId:"7")': {"__ref": "pair"}}, "pair": {"permalink": {"__ref": "link"}}, "link": {"publicId": "7", "model": {"__ref": "post"}},
            "post": {"__typename": "JobPost", "title(masking:true)": "Build it", "content(masking:true)": "Some text", "user": {"__ref": "user"}, "closed": False} | post, "user": user,
        })

    shown = "<h1>Build it</h1><p>Some text</p>"
    cases = [(store(), "7", shown, "ok"), (store(), "8", shown, "identity_mismatch"), (store(hidden=True), "7", shown, "hidden_or_deleted"), (store(user={"webCrawlNotAllowed": True}), "7", shown, "collection_disallowed"), (store(user={}), "7", shown, "collection_permission_unknown"),
             (store(__typename="Other"), "7", shown, "no_posting"), (store(), "7", "<h1>Other</h1><p>Some text</p>", "page_changed"), (store(closed=True), "7", "<h1>마감 Build it</h1><p>Some text</p>", "ok"), ("no json", "7", shown, "identity_mismatch")]
    rows = pages.read_pages(spark.createDataFrame([(k, s, i, h, "https://c.example/7") for k, (s, i, h, _) in enumerate(cases)], "k int, store string, id string, html string, url string"))
    got = rows.select("k", pages.store_detail(F.col("store"), F.col("id")).alias("d")).orderBy("k").collect()
    assert [r.d.outcome for r in got] == [c[3] for c in cases] and (got[7].d.title, got[7].d.source_status) == ("Build it", "closed")
    choice = lambda x: pages.feed_choice(F.struct((x == "c").alias("core"), (x == "e").alias("explore")), F.lit(False), F.lit("MONTHLY"))
    assert values(spark, choice, ["c", "e", "n"]) == ["explore", "listed", "listed"]


def test_board_posts(spark):
    page = read(spark, BOARD).withColumns({"budget": F.lit("예산 건당 최대 80만원"), "deadline": F.lit("2026-10-20")})
    r = page.select(pages.board_post(F.col("budget"), F.col("deadline"), clock.at("2026-10-10 00:00:00")).alias("p")).first().p
    assert (r.pay["min"], r.pay["max"], r.pay.unit, str(r.deadline_at), r.closed) == (None, 800000, "project", "2026-10-19 15:00:00", True)


def test_cursors():
    from datetime import UTC, datetime

    import pytest

    f = leads.filter_hash("all", leads.LeadFilter())
    at = datetime(2024, 1, 2, tzinfo=UTC)
    assert leads.decode_cursor(leads.encode_cursor("published", at, "lead1", f), "published", f) == (at, "lead1")
    assert leads.decode_cursor(leads.encode_cursor("checked", None, "lead1", f), "checked", f) == (None, "lead1")
    assert leads.decode_cursor(leads.encode_cursor("priority", 80, "lead1", f), "priority", f) == (80, "lead1") and len(f) == 12
    for cursor, sort, request in (("x!", "priority", f), (leads.encode_cursor("priority", 1, "a", f), "checked", f), (leads.encode_cursor("priority", 1, "a", "other"), "priority", f), (leads.encode_cursor("published", datetime(2024, 1, 2), "a", f), "published", f), (leads.encode_cursor("priority", 1, "", f), "priority", f)):
        with pytest.raises(leads.CursorError):
            leads.decode_cursor(cursor, sort, request)


def test_folds(spark):
    rows = [(1, 1, 60), (1, 2, 50), (1, 3, 30), (1, 4, None), (2, 1, 200)]
    got = folds.reservations(spark.createDataFrame(rows, "k int, n int, amount long").withColumns({"day": F.lit("d"), "month": F.lit("m")}), ["k"], ["n"], "day", "month", "amount", 100, 1000)
    assert [(r.k, r.n) for r in got.where("accepted").orderBy("k", "n").collect()] == [(1, 1), (1, 3)]
    log = [(1, 1, 1, "confirm"), (1, 2, 0, "confirm"), (1, 3, 9, "confirm"), (1, 4, 0, "dismiss"), (1, 5, 1, "dismiss")]
    out = folds.decisions(spark.createDataFrame(log, "k int, n int, expected_revision int, action string"), "k", ["n"]).orderBy("n").collect()
    assert [(r.outcome, r.revision) for r in out] == [("conflict", 0), ("applied", 1), ("unchanged", 1), ("conflict", 1), ("applied", 2)]
    edits = folds.drafts(spark.createDataFrame([(1, 1, "", "a"), (1, 2, "x", "b"), (1, 3, "a", "c")], "k int, n int, expected string, text string"), "k", ["n"]).orderBy("n").collect()
    assert [(r.saved, r.current) for r in edits] == [(True, "a"), (False, "a"), (True, "c")]


def test_links_and_windows(spark):
    a, b, c = "the quick brown fox jumps over", "the quick brown fox jumps ovex", "lazy dogs sleep all the day long"
    rows = spark.createDataFrame([(1, "T", c, "h1"), (2, "t", a, "h2"), (3, "T!", b, "h3"), (4, "T", a, "h2"), (5, "", a, "h2")], "id long, title string, body string, digest string")
    members, links = relations.candidate_links(rows)
    assert [(r.low, r.high) for r in links.collect()] == [(2, 3)] and sorted((r.id, r.other) for r in members.collect()) == [(4, 2)]
    bounds = spark.createDataFrame([(1, 1), (1, 10), (2, 1)], "k int, since int")
    events = spark.createDataFrame([(1, 2), (1, 12), (1, 1)], "k int, at int")
    assert sorted((r.k, r.since, r.first_at) for r in relations.first_after(bounds, events, "k", "since", "at", F.lit(20)).collect()) == [(1, 1, 1), (1, 10, 12), (2, 1, None)]
    gaps = windows.gap_since(spark.createDataFrame([(1, 0, 10), (1, 5, 6), (1, 30, 40)], "k int, a int, b int").select("k", F.timestamp_seconds("a").alias("a"), F.timestamp_seconds("b").alias("b")), ["k"], "a", "b", ["a"])
    assert [r.gap_seconds for r in gaps.orderBy("a").collect()] == [None, 0.0, 24.0]
    assert [(r.i, r.l, r.r) for r in windows.paired(spark.createDataFrame([(1, ["a", "b"], ["x"])], "k int, l array<string>, r array<string>"), "k", "l", "r").collect()] == [(0, "a", "x"), (1, "b", None)]


def test_ingest_helpers(spark):
    old = spark.createDataFrame([(1, "u1", "a"), (2, "u2", "b")], "id int, original_url string, title string")
    new = spark.createDataFrame([(1, None, None)], "id int, original_url string, title string")
    assert sorted(map(tuple, ingest.overwrite(old, new, "id").collect())) == [(1, "u1", None), (2, "u2", "b")]
    kept = ingest.promoted(spark.createDataFrame([("1", "request"), ("2", "request"), ("3", "other")], "id string, classification string"), spark.createDataFrame([("cafe-comment:1",)], "source_post_id string"))
    assert [r.id for r in kept.collect()] == ["2"]
    bodies = spark.createDataFrame([(1, "b", "T", "t b", 5, None, "new"), (2, "b", "T", "t b", 5, "interested", "new"), (3, "b", "T", "t b", 5, None, "won")], "id int, body string, title string, search_text string, d int, user_mark string, sales_stage string").withColumn("retained_until", F.timestamp_seconds("d"))
    assert [(r.body, r.search_text) for r in merge.expire_bodies(bodies, F.timestamp_seconds(F.lit(9))).orderBy("id").collect()] == [(None, "t"), ("b", "t b"), ("b", "t b")]
    scanned = community.rescanned(spark.createDataFrame([(1, "2024-01-01"), (2, "2024-03-01")], "id int, d string").select("id", F.col("d").cast("timestamp_ntz").alias("written_at")), F.lit(None).cast("timestamp_ntz"), clock.at("2024-03-10 00:00:00"))
    assert [r.id for r in scanned.collect()] == [2]


def test_closed_posts_are_analysed_again(spark):
    rows = [(1, "t", "모집이 마감되었습니다. 홈페이지 제작 의뢰합니다", "open"), (2, "t", "10월 3일까지 지원. 홈페이지 제작 의뢰합니다", "unknown"), (3, "t", "홈페이지 제작 의뢰합니다", "deleted")]
    posts = spark.createDataFrame(rows, "id int, title string, body string, source_status string").withColumn("observed_at", clock.at("2026-10-10 03:00:00"))
    got = {r.id: r.source_status for r in score.applied(posts, score.Profile(), "2026-10-10 03:00:00").select("id", "source_status").collect()}
    assert got == {1: "closed", 2: "closed", 3: "deleted"}
