"""Readings of posts against those made by hand."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemill.analysis import classify, dates, incremental, pay, rules, score
from tidemill.analysis.scan import scan
from tidemill.functions import matches
from tidemill.plans import posts


@pytest.fixture(scope="module")
def analysed(spark):
    rows = spark.createDataFrame([(k, p[0], p[1]) for k, p in enumerate(posts.POSTS)], "id long, title string, body string")
    observed = F.lit(posts.OBSERVED).cast("timestamp_ntz")
    hours = lambda n: observed - F.expr(f"INTERVAL {n} HOURS")
    rows = rows.withColumns({"observed_at": observed, "source_status": F.lit("open"), "last_checked_at": hours(1), "published_at": hours(7)})
    profile = score.Profile(services=("website", "vba"), min_contract=500_000, target_hourly=30_000)
    return score.analyze(rows, profile, posts.OBSERVED).cache()


def test_posts(analysed):
    for r in analysed.collect():
        got = (r.asked.value, r.asked.basis, r.engagement.value, r.work.value, r.collab.value, r.scope.value, ",".join(r.category.names), r.category.dev, r.recommendation, r.total)
        assert got == posts.POSTS[r.id][2:], posts.POSTS[r.id][:2]


def test_explanations(analysed):
    rows = {r.id: r for r in analysed.collect()}
    assert [x.text for x in rows[0].reasons] == ["구매 의뢰 명시", "재택·온라인 명시", "예산 150만원"]
    assert rows[0].questions == ["필요한 기능이나 페이지 목록을 받을 수 있을까요?"] and rows[0].summary == "소상공인 홈페이지 제작을 의뢰합니다."
    assert [x.text for x in rows[1].reasons][0] == "시급 지급 — 건당 프리랜서 의뢰 아님"
    assert [(x.id, x.quote) for x in rows[4].risks] == [("upfront_payment", "가입비 5만원 입금"), ("income_guarantee", "고수익 보장")]
    assert rows[5].review[0].startswith("계약금액 하한 미확인") and rows[5].closed_mark.quote == "모집이 마감되었"
    profit = rows[0].profit
    assert profit.status == "calculated" and [(s.hours, s.effective_hourly, s.residual_after_target) for s in profit.scenarios] == [(38, 39474, 360000), (28, 53571, 660000), (21, 71429, 870000)]
    assert rows[1].unknown_factors == 1 and rows[7].unknown_factors == 3


def test_evidence_rows_quote_the_text(analysed):
    for r in score.evidence_rows(analysed).collect():
        body = posts.POSTS[r.id][1]
        if r.start is not None:
            assert body[r.start : r.stop] == r.quote
        else:
            assert r.quote == posts.POSTS[r.id][0]


def test_pay(spark):
    rows = spark.createDataFrame([(k, p[0]) for k, p in enumerate(posts.PAYS)], "k int, body string")
    for r in rows.select("k", pay.parse_pay(scan(F.lit(None).cast("string"), F.col("body"))).alias("p")).collect():
        p = r.p
        assert (p.unit, p.min, p.max, p.negotiable, p.raw, p.currency) == posts.PAYS[r.k][1:], posts.PAYS[r.k][0]
        if p.raw:
            assert posts.PAYS[r.k][0][p.start :].startswith(p.raw)


def test_wages_by_time(spark):
    texts = {"예산 100만원, 시급 1만원 별도": "hour", "제작 기간 한 달, 예산 100만원": None, "월 단위로 정산합니다": "month", "주급 협의": "week", "수수료 월 단위 정산": None, None: None}
    rows = spark.createDataFrame(list(texts.items()), "t string, want string")
    assert all(r.want == r.got for r in rows.select("*", pay.time_pay_unit(F.col("t")).alias("got")).collect())


def test_dates(spark):
    rows = spark.createDataFrame([(k, *d[:2]) for k, d in enumerate(posts.DATES)], "k int, title string, body string")
    at = F.lit(posts.OBSERVED).cast("timestamp_ntz")
    rows = rows.withColumn("found", scan(F.col("title"), F.col("body")))
    got = rows.select("k", dates.parse_deadline(F.col("found"), at).alias("d"), dates.parse_work_start(F.col("found"), at).alias("s"), dates.closed_marker(F.col("found"), F.col("title")).alias("c"))
    text = lambda x: None if x is None else x.strftime("%Y-%m-%d %H:%M:%S")
    for r in got.collect():
        assert (text(r.d.at), r.d.raw, text(r.s.at), r.s.raw, r.c.quote if r.c else None) == posts.DATES[r.k][2:], posts.DATES[r.k][:2]


def test_categories_leave_out_what_only_sounds_like_software(spark):
    texts = {
        "자동화 라인 생산 직원": ["other"], "홈페이지 광고 문구 작성": ["other"], "HTML 코드 수정 부탁드립니다": ["website"], "엑셀 데이터 정리": ["data"],
        "상품 포장 쇼핑몰 제작": ["shop"], "상품 제작 및 쇼핑몰 포장 진열": ["other"], "API 연동 개발": ["automation"], "자동화물 운송": ["other"],
    }
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.c.names for r in rows.withColumn("s", scan(F.lit(""), F.col("t"))).select("t", classify.categories(classify.Post(F.lit(""), F.col("t"), F.col("s"))).alias("c")).collect()}
    assert got == texts


def test_no_orders(spark):
    texts = [("과외 선생님 구해요", "코딩 과외를 해주실 선생님", rules.NO_TEACHING_ORDER), ("문의", "자소서 첨삭 부탁드립니다", rules.NO_ADVICE_ORDER), ("연구 보조", "연구자료 정리", rules.NO_RESEARCH_ORDER), ("홈페이지 제작 의뢰", "교육해 주실 필요 없습니다", None)]
    rows = spark.createDataFrame(texts, "title string, body string, want string")
    assert all(r.want == r.got for r in rows.withColumn("s", scan(F.col("title"), F.col("body"))).select("*", classify.non_delivery(classify.Post(F.col("title"), F.col("body"), F.col("s"))).alias("got")).collect())


def test_evidence_is_the_first_pattern_with_its_sentence(spark):
    text = "첫 문장입니다. • concat cat 을 찾습니다! 끝 😀 cat"
    row = spark.createDataFrame([(text, "제목 dog ")], "b string, t string")
    found = row.select(matches.evidence([r"zebra", r"\bcat\b"], F.col("b"), F.col("t")).alias("e"), matches.evidence(["dog"], F.col("b"), F.col("t")).alias("f"), matches.evidence(["cow"], F.col("b"), F.col("t")).alias("g"), matches.find_first(F.col("b"), "cat$").alias("h"), matches.find_first(F.col("b"), r"\bcat\b").alias("i")).first()
    assert found.e.quote == "concat cat 을 찾습니다!" and text[found.e.start : found.e.stop] == found.e.quote
    assert found.f.quote == "제목 dog" and found.f.start is None and found.g is None
    assert found.h.start == len(text) - 3 and text[found.i.start : found.i.stop] == "cat" and found.i.start == text.index(" cat") + 1


def test_find_all_gives_places_and_groups(spark):
    text = "a1 😀 b22\nc333"
    got = spark.createDataFrame([(text,), (None,)], "t string").select(matches.find_all(F.col("t"), r"([a-z])(\d+)", 2, 1).alias("m")).collect()
    assert [(text[x.start : x.stop], x.g1, x.g2) for x in got[0].m] == [("a1", "a", "1"), ("b22", "b", "22"), ("c333", "c", "333")] and got[1].m == []


def test_user_feedback_stands_above_the_text(spark):
    row = spark.createDataFrame([(1, "개발자 구합니다", "홈페이지 개발자 구합니다. 예산 200만원", "confirmed", "yes")], "id long, title string, body string, remote_feedback string, request_feedback string")
    row = row.withColumn("observed_at", F.lit(posts.OBSERVED).cast("timestamp_ntz"))
    r = score.analyze(row, score.Profile(), datetime(2026, 10, 10, 3)).first()
    assert (r.asked.value, r.asked.basis, r.work.value, r.collab.value) == ("buyer_project", "user_confirmed", "fully_remote", "online_only")


def test_site_pay_and_conflicts(spark):
    kind = "struct<raw:string,currency:string,min:bigint,max:bigint,unit:string,negotiable:boolean,start:int>"
    hints = [(None, "body", None), (("", "KRW", None, None, "unknown", False, None), "body", None), (("100만원", "KRW", 1000000, 1000000, "project", False, None), "site", "보수 금액 불일치 — 사이트 예산 100만원, 본문 예산 50만원"), (("40~60만원", "KRW", 400000, 600000, "project", False, None), "site", None)]
    rows = spark.createDataFrame(hints, f"hint {kind}, want string, conflict string").withColumn("read", pay.parse_pay(scan(F.lit(""), F.lit("예산 50만원"))))
    for r in rows.select("*", score.resolve_pay(F.col("hint"), F.col("read")).alias("got")).collect():
        assert r.got.conflict == r.conflict and r.got.pay.raw == ("예산 50만원" if r.want == "body" else r.hint.raw)


def test_draft(spark):
    row = spark.createDataFrame([(" 제목 ", ["하나?", "둘?"]), ("b", [])], "t string, q array<string>")
    a, b = [r[0] for r in row.select(score.inquiry_draft(F.col("t"), F.col("q"))).collect()]
    assert "'제목' 관련해" in a and "1) 하나?\n2) 둘?\n\n" in a and "1)" not in b


def test_structured_salary(spark):
    rows = [('{"currency":"KRW","value":{"minValue":100,"maxValue":200,"unitText":"HOUR"}}', (100, 200, "hour", "baseSalary 100~200 KRW/HOUR")), ('{"value":{"value":"5"}}', (5, 5, "unknown", "baseSalary 5~5 KRW/?")), ('{"value":7}', (7, 7, "unknown", "baseSalary 7~7 KRW/?")), ("{}", None), (None, None)]
    for r in spark.createDataFrame([(k, x[0]) for k, x in enumerate(rows)], "k int, v string").select("k", pay.structured_salary(F.col("v")).alias("s")).collect():
        assert (None if r.s is None else (r.s.min, r.s.max, r.s.unit, r.s.raw)) == rows[r.k][1]


def test_scan_finds_what_the_expressions_find(spark):
    """Places, sentences and groups of the matcher against the expression forms of the same."""
    texts = [p[1] or "" for p in posts.POSTS] + [p[0] for p in posts.PAYS] + ["첫 문장입니다. • 홈페이지 제작 의뢰합니다! 끝 😀 알바", "x" * 200 + " 알바 " + "y" * 200, "", "\n\n알바"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, body string")
    amounts = matches.find_all(F.col("body"), rules.PAY_SINGLE, 1, 2, 5)
    both = rows.select("k", "body", scan(F.lit("제목 외주 "), F.col("body")).alias("s"), *[matches.evidence(p, F.col("body"), F.lit("제목 외주 ")).alias(k) for k, p in (("buyer", rules.BUYER), ("employment_weak", rules.EMPLOYMENT_WEAK), ("project", rules.PROJECT))], amounts.alias("m"))
    for r in both.collect():
        for k in ("buyer", "employment_weak", "project"):
            assert r.s.quotes[k] == r[k], (r.body, k)
        singles = [(m.start, m.stop, m.g1) for m in r.m if m.g2 or m.g5]
        ranges = [(a.start, a.stop) for a in r.s.amounts if a.range]
        assert [(a.start, a.stop, a.g1) for a in r.s.amounts if not a.range] == [m for m in singles if not any(x <= m[0] < y for x, y in ranges)]


@pytest.fixture(scope="module")
def kept(spark):
    observed = F.lit(posts.OBSERVED).cast("timestamp_ntz")
    rows = spark.createDataFrame([(k, f"글 {k}", f"홈페이지 제작 의뢰합니다. 예산 {k + 10}만원") for k in range(100)], "id long, title string, body string")
    rows = rows.withColumns({"observed_at": observed, "last_checked_at": observed, "published_at": observed - F.expr("INTERVAL 23 HOURS"), "source_status": F.lit("open")})
    profile = score.Profile(services=("website",))
    return rows, profile, incremental.analysed(rows, profile, posts.OBSERVED).cache()


def test_only_changes_are_analysed_again(kept):
    rows, profile, stored = kept
    later = "2026-10-10 03:10:00"

    def again(posts_now, profile_now=profile, at=later, ttl=24, against=None):
        done = incremental.reanalysed(stored, posts_now, profile_now, at, ttl).cache()
        if against is not None:
            plain = [c for c in against.columns if c != "analysed_at" and c != "valid_until"]
            assert sorted(map(repr, done.select(*plain).collect())) == sorted(map(repr, against.select(*plain).collect()))
        return done.where(F.col("analysed_at") == F.lit(at).cast("timestamp_ntz")).count()

    assert again(rows, against=stored) == 0
    # One post has changed, ten are gone, one is new.
    now = rows.withColumn("body", F.when(F.col("id") == 7, "알바").otherwise(F.col("body"))).where("id < 90").unionByName(rows.where("id = 1").withColumn("id", F.lit(1000).cast("long")))
    assert again(now, against=incremental.analysed(now, profile, later)) == 2
    assert again(rows, score.Profile(services=("website",), min_contract=10)) == again(rows, ttl=12) == 100
    # After 24 hours of age, and where the clock goes back, every analysis has run out.
    assert again(rows, at="2026-10-10 04:00:01") == again(rows, at="2026-10-10 02:59:00") == 100


def test_rules_version_follows_the_tables(monkeypatch):
    before = incremental.rules_version()
    monkeypatch.setattr(rules, "ONGOING", (*rules.ONGOING, "x"))
    assert incremental.rules_version() != before
