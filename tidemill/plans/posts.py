"""Posts with known readings, dealt over the test tables' rows.

Each text is read by hand; an oracle is the table of those readings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .proxy import table

OBSERVED = "2026-10-10 03:00:00"

#: title, body, then: intent, basis, engagement, work mode, collaboration, scope, categories, development, recommendation, total
POSTS = (
    ("홈페이지 제작 의뢰", "소상공인 홈페이지 제작을 의뢰합니다. 재택 가능하고 미팅 없이 진행합니다.\n예산 150만원 정도 생각하고 있습니다.\n10월 20일까지 지원해 주세요.",
     "buyer_project", "explicit", "project", "fully_remote", "online_only", "unknown", "website", True, "recommended", 90),
    ("쇼핑몰 직원 모집", "쇼핑몰 관리를 하실 분을 모십니다. 시급 12,000원, 주 5일 출근 필수입니다.",
     "employee_hiring", "explicit", "part_time", "onsite", "onsite_required", "unknown", "other", False, "excluded", 27),
    ("엑셀 매크로", "엑셀 매크로 만들어 주실 분 구합니다. 비용은 50~80만원, 협의 가능. 첫 미팅은 사무실 방문이 필요합니다. 서버 비용은 매월 3만원 별도.",
     "buyer_ongoing", "explicit", "project", "unknown", "onsite_required", "unknown", "vba", True, "excluded", 64),
    ("제작해드립니다", "홈페이지 제작해 드립니다. 견적 문의 주세요",
     "seller_service", "explicit", "project", "unknown", "unknown", "unknown", "website", True, "excluded", 44),
    ("알바", "재택 알바. 가입비 5만원 입금 후 시작. 고수익 보장",
     "employee_hiring", "inferred", "part_time", "unknown", "unknown", "unknown", "other", False, "excluded", 0),
    ("앱 개발", "최대 300만원 이내 예산. 앱 개발 외주 드립니다. 유지보수 포함. 모집이 마감되었습니다.",
     "buyer_ongoing", "explicit", "project", "unknown", "unknown", "unknown", "software", True, "needs_review", 55),
    ("프로그램", "1억 5천만원 프로젝트 예산입니다. 프로그램 개발 의뢰합니다. 11월 3일부터 착수",
     "buyer_project", "explicit", "project", "unknown", "unknown", "unknown", "software", True, "needs_review", 55),
    (None, None, "unknown", None, "unknown", "unknown", "unknown", "unknown", "other", False, "excluded", 18),
)

#: body, then: unit, min, max, negotiable, wording, currency
PAYS = (
    ("예산 50~80만원입니다", "project", 500000, 800000, False, "예산 50~80만원입니다", "KRW"),
    ("시급 12,000원 / 하루 4시간", "hour", 12000, 12000, False, "시급 12,000원 / 하루 4시간", "KRW"),
    ("월 200만원 고정", "month", 2000000, 2000000, False, "월 200만원 고정", "KRW"),
    ("제작비 최대 100만원까지", "project", None, 1000000, False, "제작비 최대 100만원까지", "KRW"),
    ("30만원부터 가능, 견적 협의", "project", 300000, None, True, "30만원부터 가능, 견적 협의", "KRW"),
    ("보증금 10만원 입금 후, 작업비 5만원", "unknown", 50000, 50000, False, "보증금 10만원 입금 후, 작업비 5만원", "KRW"),
    ("연봉 4,000만원", "unknown", 40000000, 40000000, False, "연봉 4,000만원", "KRW"),
    ("Salary: USD 3000 per month", "unknown", None, None, False, "Salary: USD 3000 per month", "USD"),
    ("금액은 협의 후 결정합니다", "negotiable", None, None, True, "금액은 협의 후 결정합니다", "KRW"),
    ("건당 지급합니다", "project", None, None, False, "건당 지급합니다", "KRW"),
    ("1.5만원/시간", "hour", 15000, 15000, False, "1.5만원/시간", "KRW"),
    ("1억 5천만원 예산", "project", 150000000, 150000000, False, "1억 5천만원 예산", "KRW"),
    ("안녕하세요. 작업 문의입니다. 예산은 20만원입니다. 감사합니다.", "project", 200000, 200000, False, "예산은 20만원입니다.", "KRW"),
    ("호스팅 비용은 매월 3만원입니다.\n제작비 100만원", "project", 1000000, 1000000, False, "제작비 100만원", "KRW"),
    ("No price is named 3 times", "unknown", None, None, False, None, "KRW"),
)

#: title, body, then: deadline (UTC), its wording, start of work, its wording, quote of a closed mark
DATES = (
    ("", "지원은 11/5(목)까지", "2026-11-04 15:00:00", "11/5(목)까지", None, None, None),
    ("", "10월 30일까지 납품", None, None, None, None, None),
    ("", "마감일: 10월 3일", "2026-10-02 15:00:00", "마감일: 10월 3일", None, None, None),
    ("", "1월 5일까지 접수", "2027-01-04 15:00:00", "1월 5일까지", None, None, None),
    ("", "2월 30일까지 접수", None, None, None, None, None),
    ("", "상시 모집", None, "상시 모집", None, None, None),
    ("", "11월 3일부터 작업 시작", None, None, "2026-11-02 15:00:00", "11월 3일부터", None),
    ("", "바로 시작 가능하신 분", None, None, None, "바로 시작", None),
    ("", "모집이 마감되었습니다", None, None, None, None, "모집이 마감되었"),
    ("", "마감되면 알려드릴게요", None, None, None, None, None),
    ("[마감] 홈페이지 제작", "내용", None, None, None, None, "[마감] 홈페이지 제작"),
    ("", "작업 마감되었습니다", None, None, None, None, None),
    ("", "글 내용\n모집 마감", None, None, None, None, "모집 마감"),
    ("", "채용 완료 되지 않았습니다", None, None, None, None, None),
    (None, None, None, None, None, None, None),
)


def dealt(spark: SparkSession, sf_dir: str, texts: list[tuple], names: str) -> DataFrame:
    """``id`` of every part with one of the texts."""
    rows = spark.createDataFrame([(k, *t) for k, t in enumerate(texts)], "k int, " + names)
    parts = spread(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % len(texts)).cast("int").alias("k")))
    return parts.join(F.broadcast(rows), "k").drop("k")


def spread(rows: DataFrame) -> DataFrame:
    """A table of fewer partitions than cores, dealt over all of them."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


#: Sentences that posts are composed of; the place in a list is chosen by the key.
ASKS = ("홈페이지 제작 의뢰합니다", "홈페이지 제작해 드립니다", "구직 중입니다", "정규직 채용합니다", "알바 가능", "안녕하세요")
WORKS = ("완전 재택입니다", "주 3일 출근합니다", "재택 불가", "재택 협의", "메일로 전달", "감사합니다")
PLACES = ("전국 어디나 가능", "서울 거주자만 가능", "잘 부탁드립니다")


def composed(spark: SparkSession, sf_dir: str, shift: str = "0") -> DataFrame:
    """A post for every part, of sentences that the key (plus ``shift``, SQL over ``id``) chooses: thousands of different texts."""
    listed = lambda xs: "array(" + ", ".join(f"'{x}'" for x in xs) + ")"
    choices = spread(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))).selectExpr("id", f"id + ({shift}) AS k")
    pay = "CASE k % 4 WHEN 0 THEN concat('예산 ', k % 97 + 3, '만원') WHEN 1 THEN concat('시급 ', k % 89 + 10, ',000원') WHEN 2 THEN '금액은 협의 후 결정합니다' ELSE '준비된 자료가 있습니다' END"
    until = "CASE k % 3 WHEN 0 THEN concat('10월 ', k % 28 + 1, '일까지 모집') WHEN 1 THEN '상시 모집' ELSE '연락 주세요' END"
    sentences = [f"{listed(ASKS)}[k % 6]", f"{listed(WORKS)}[k div 6 % 6]", f"{listed(PLACES)}[k div 36 % 3]", pay, until]
    return choices.selectExpr("id", "concat('글 ', id) AS title", "concat_ws('.\n', " + ", ".join(sentences) + ") AS body")


#: What such a post says, read off the choices: SQL over ``id`` and ``k``.
COMPOSED_READINGS = """
  CASE WHEN k % 6 = 1 THEN 'seller_service' WHEN k % 6 = 2 THEN 'job_seeker' WHEN k % 6 IN (3, 4) OR k % 4 = 1 THEN 'employee_hiring' WHEN k % 6 = 0 THEN 'buyer_project' ELSE 'unknown' END AS intent,
  CASE k % 6 WHEN 3 THEN 'full_time' WHEN 4 THEN 'part_time' WHEN 0 THEN 'project' ELSE 'unknown' END AS engagement,
  CASE k // 6 % 6 WHEN 0 THEN 'fully_remote' WHEN 1 THEN 'onsite' WHEN 2 THEN 'onsite' WHEN 3 THEN 'negotiable' WHEN 4 THEN 'fully_remote' ELSE 'unknown' END AS work_mode,
  CASE k // 6 % 6 WHEN 4 THEN 'inferred' WHEN 5 THEN NULL ELSE 'explicit' END AS work_basis,
  CASE k // 36 % 3 WHEN 0 THEN 'nationwide' WHEN 1 THEN 'regional_restriction' ELSE 'unknown' END AS scope,
  CASE k % 4 WHEN 0 THEN 'project' WHEN 1 THEN 'hour' WHEN 2 THEN 'negotiable' ELSE 'unknown' END AS unit,
  CASE k % 4 WHEN 0 THEN (k % 97 + 3) * 10000 WHEN 1 THEN (k % 89 + 10) * 1000 END::BIGINT AS pay_min,
  CASE WHEN k % 3 = 0 THEN TIMESTAMP '2026-09-30 15:00:00' + INTERVAL 1 DAY * (k % 28) END AS deadline_at,
  CASE k % 3 WHEN 0 THEN '10월 ' || (k % 28 + 1) || '일까지' WHEN 1 THEN '상시 모집' END AS deadline_raw"""


def values(rows: list[tuple], columns: str, types: dict[str, str] | None = None) -> str:
    """The readings as a SELECT over ``part``, for an oracle."""

    def literal(x) -> str:
        return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"

    names = columns.split()
    listed = ", ".join("(" + ", ".join(map(literal, (k, *r))) + ")" for k, r in enumerate(rows))
    chosen = ", ".join(f"CAST({n} AS {types[n]}) AS {n}" if types and n in types else n for n in names)
    return f"SELECT p_partkey AS id, {chosen} FROM part JOIN (VALUES {listed}) g(k, {', '.join(names)}) ON p_partkey % {len(rows)} = k"
