"""The rule tables: patterns that decide what a post asks for.  Data only.

All values below are fixed values: results depend on every character of them.
"""

SALARY = r"(?i)\bsalary\s*[:：]?\s*(?:(?:USD|KRW|EUR|GBP)\s*\d|[$₩€£]\s*\d|\d[\d,.]*\s*(?:만원|원|USD|KRW|EUR|GBP))"

# --- intent
SELLER = (
    r"(?:만들어|제작해|개발해|구축해|제작\s*해|디자인해|대행해)\s*드(?:립니다|려요|림|릴게요)",
    r"제작\s*(?:대행|해드림)",
    r"외주\s*(?:받습니다|받아요|환영합니다)",
    r"(?:제작|개발)\s*(?:문의\s*주세요|상담\s*환영)",
    r"(?:제작|개발|창업)[^.\n]{0,10}도와\s*드(?:립니다|려요)",
)
JOB_SEEKER = (r"구직\s*(?:중|합니다)", r"일\s*(?:구합니다|구해요|찾습니다|찾아요)", r"일자리\s*(?:구|찾)", r"알바\s*구해요")
BUYER = (
    r"(?:만들어|제작해|개발해|수정해|구축해|연동해|리뉴얼\s*해|고쳐|맡아)\s*(?:주실|줄|주세요|주시|주셨으면)",
    r"(?:만들어|제작해|개발해)\s*주실\s*수\s*있는\s*분",
    r"(?:제작|개발|구축|수정|리뉴얼)\s*(?:을|를)?\s*(?:의뢰|외주)",
    r"(?:의뢰|외주)\s*(?:합니다|드립니다|드려요|맡기|하려|를\s*맡|주려)",
    r"(?:외주|의뢰)\s*(?:맡기려고|드리려고)",
    r"견적\s*(?:부탁|요청|보내|주세요|받고)",
    r"(?:만들|제작하|개발하)고\s*싶(?:어요|습니다)",
    r"(?:제작|개발|구축|수정)(?:을|를|하는\s*것을|\.?등을)?\s*(?:좀\s*)?도와\s*(?:주실|주세요)",
    r"(?:제작|개발|구축|수정)\s*(?:요청|부탁)\s*(?:합니다|드립니다|드려요|부탁드립니다)?",
    r"(?:제작|개발|구축|수정)\s*(?:을|를)?\s*(?:해주실\s*)?프리랜서\s*(?:구합니다|구해요|모집|찾습니다)",
    r"(?:홈페이지|홈피|웹\s*사이트|웹\s*페이지|랜딩\s*페이지|쇼핑몰|자사몰|카페24|프로그램|소프트웨어|앱|어플|매크로)\s*(?:을|를)?\s*(?:제작|개발|구축|수정|리뉴얼)\s*(?:가능(?:하신|한)|할\s*수\s*있는|하실|해\s*주실)\s*(?:분|프리랜서)(?:을|를)?\s*(?:계실까요|있을까요|구합니다|구해요|찾습니다|찾아요|모집합니다)",
    r"(?:홈페이지|홈피|웹\s*사이트|웹\s*페이지|프로그램|소프트웨어|앱)\s*(?:제작|개발|구축|수정)\s*(?:에\s*)?(?:능숙하신|익숙하신|경험\s*있으신)\s*분\s*(?:좀\s*)?도와\s*(?:주실|주세요)",
)
ONGOING = (r"유지\s*보수", r"월\s*\d+\s*만\s*원?\s*고정", r"매달|매월|월\s*단위|정기적으로|장기\s*(?:계약|협업)|재계약")
EMPLOYMENT_STRONG = (r"정규직", r"채용합니다", r"4대\s*보험", r"상근", r"주\s*5\s*일", r"연봉", r"사원\s*모집", r"직원\s*(?:모집|구합니다|채용)", SALARY)
EMPLOYMENT_WEAK = (r"시급", r"하루\s*\d+\s*시간", r"주\s*\d\s*일\s*근무", r"월급", r"근무\s*시간", r"아르바이트|알바|단기\s*(?:알바|근무)")
WAGE_WORDS = r"시급|하루\s*\d+\s*시간|근무\s*시간"
AMBIGUOUS_PERSON = (r"(?:개발자|프리랜서|디자이너|작업자)\s*(?:구합니다|구해요|모집|찾습니다)",)
OPERATIONAL_STAFF = (r"쇼핑몰\s*관리(?:를|을)?\s*하실\s*분(?:을)?\s*(?:구합니다|모십니다)",)

# --- engagement
FULL_TIME = (r"정규직", r"상근", r"4대\s*보험", r"연봉")
PART_TIME = (r"시급[^.\n]{0,30}(?:하루|주\s*\d|시간)", r"(?:아르바이트|알바)", r"단기\s*(?:근무|알바)", r"하루\s*\d+\s*시간")
HOURLY_CONTRACT = (r"시간\s*(?:당|단위)\s*(?:계약|정산)",)
PROJECT = (r"외주", r"의뢰", r"건\s*당", r"견적", r"프로젝트", r"납품")

# --- work mode
REMOTE_NEG = (r"재택\s*(?:불가|안\s*됩니다|은\s*어렵)", r"원격\s*(?:불가|근무\s*불가)")
REQUIRED_WORK_VISIT = (r"(?:작업|업무)(?:은|는|을|를)?\s*(?:(?:저희|우리|제)\s*)?(?:집|사무실|현장)(?:으)?로\s*방문\s*(?:하셔야|해야)\s*(?:해요|합니다|됩니다|돼요)",)
ONSITE = (*REQUIRED_WORK_VISIT, r"주\s*\d\s*일\s*출근", r"(?<!재택\s)출근(?!\s*(?:없이|안|불필요|하지))\s*(?:근무|필수|해야|하셔야)?", r"사무실\s*(?:근무|상주)", r"사무실(?:로|에)\s*오셔서\s*근무", r"상주\s*(?:근무|개발)?", r"매장\s*근무")
ONSITE_DAYS = r"주\s*\d\s*일\s*출근|사무실\s*(?:근무|상주)"
HYBRID = (r"재택\s*(?:병행|혼합)", r"주\s*\d\s*일\s*재택", r"일부\s*재택", r"하이브리드")
REMOTE_NEGOTIABLE = (r"재택\s*(?:여부\s*)?협의", r"원격\s*(?:근무\s*)?협의", r"근무\s*(?:형태|방식)\s*협의")
REMOTE_EXPLICIT = (
    r"완전\s*재택",
    r"전\s*과정\s*(?:원격|비대면|온라인)",
    r"재택\s*(?:근무|작업|진행|가능|으로|환영|OK|ok)",
    r"근무(?:는|지[는:]?)?\s*자택", r"자택\s*(?:근무|작업)",
    r"원격\s*(?:근무|작업|진행|으로|가능)",
    r"비대면\s*(?:진행|작업|으로)?",
    r"온라인\s*(?:으로|로)\s*(?:만\s*)?(?:진행|작업|소통)",
    r"리모트|remote",
)
REMOTE_WEAK = (r"(?:메일|이메일|카톡|카카오톡)(?:로|으로)?\s*(?:전달|주고받|보내|드려)", r"파일로\s*주고받", r"화상\s*(?:미팅|회의)")
FREELANCE_ONLY = (r"프리랜서",)

# --- collaboration
ONSITE_REQUIRED = (
    *REQUIRED_WORK_VISIT,
    r"(?:첫\s*(?:날|미팅|만남)|최초|초기)[^.\n]{0,25}(?:방문|대면|사무실|매장|학원|내방)",
    r"방문\s*(?:교육|미팅|회의)",
    r"대면\s*(?:미팅|교육|회의|으로)",
    r"(?:월|주)\s*\d\s*회[^.\n]{0,15}(?:회의|미팅|방문|출근)",
    r"회의\s*참석",
    r"출근(?!\s*(?:없이|안|불필요|하지))",
)
ONLINE_ONLY_EXPLICIT = (r"미팅\s*없이", r"비대면", r"온라인\s*(?:으로|로)\s*만", r"전\s*과정\s*(?:원격|비대면|온라인)", r"완전\s*재택", r"대면\s*(?:없이|불필요)")
ONLINE_ONLY_WEAK = (
    r"(?:메일|이메일|카톡|카카오톡|슬랙|slack|디스코드)(?:로|으로|과|와)?[^.\n]{0,12}(?:소통|전달|주고받|드려|합니다)",
    r"화면\s*공유",
    r"화상\s*(?:미팅|회의)",
    r"파일로\s*주고받",
    r"원격으로\s*진행",
    r"온라인\s*(?:으로|로)\s*진행",
)
COLLAB_NEGOTIABLE = (r"(?:미팅|대면)\s*(?:여부\s*)?(?:협의|조율)",)

# --- applicant scope
NATIONWIDE = (r"지역(?:은|이)?\s*(?:상관|무관|제한\s*없)", r"전국\s*(?:어디|누구|가능|지원)", r"거주지\s*(?:무관|상관)", r"어디서나")
REGIONAL = (r"[가-힣]{2,6}\s*(?:거주자|거주하시는\s*분|지역\s*분)\s*만", r"(?:인근|근처)\s*(?:거주자|분)\s*만", r"출퇴근\s*가능한\s*분만?")

# --- categories: name, patterns, whether they mean development without a development verb
DEV_VERB = r"제작|개발|구축|수정|리뉴얼|유지\s*보수|연동|자동화|만들|코딩|프로그래밍|매크로|스크립트"
CATEGORIES = (
    ("landing", (r"랜딩\s*페이지", r"원\s*페이지|1\s*페이지", r"이벤트\s*페이지"), True),
    ("shop", (r"쇼핑몰", r"카페24|자사몰", r"상세\s*페이지"), False),
    ("website", (r"홈페이지|홈피", r"웹\s*사이트|웹사이트", r"워드프레스|wordpress", r"예약\s*페이지", r"웹\s*페이지"), False),
    ("fullstack", (r"웹\s*(?:프로그램|서비스|앱)", r"관리자\s*페이지|관리\s*페이지", r"풀스택", r"백엔드|서버\s*개발", r"앱\s*[·/,]\s*웹|웹\s*[·/,]\s*앱", r"플랫폼\s*개발"), True),
    ("software", (r"프로그램\s*(?:제작|개발|이\s*필요)", r"소프트웨어", r"C#|파이썬|python|자바|윈도우\s*(?:PC|프로그램)", r"변환\s*프로그램", r"(?:앱|어플)\s*(?:개발|제작)", r"크롤링|크롤러|시스템\s*(?:개발|구축)"), True),
    ("vba", (r"VBA|vba", r"매크로", r"엑셀[^.\n]{0,15}(?:자동|매크로|함수\s*개발)"), True),
    ("automation", (r"자동화(?!물)", r"자동으로", r"API|api|(?i:RPA)", r"연동", r"알림톡", r"구글\s*(?:시트|스프레드시트)", r"스프레드시트"), True),
    ("data", (r"데이터\s*(?:정리|입력|취합)", r"정리\s*작업", r"엑셀\s*(?:정리|취합|입력)", r"취합"), False),
)
DEV_CATEGORIES = ("landing", "shop", "website", "fullstack", "software", "vba", "automation")
SOFTWARE_CHANGE = (
    r"(?:홈페이지|홈피|웹\s*(?:사이트|페이지|서비스|앱)|사이트|쇼핑몰|자사몰|카페24|"
    r"프로그램|소프트웨어|앱|어플|플랫폼|코드|(?i:AI)\s*에이전트|챗봇|"
    r"(?i:HTML(?:\s*/\s*CSS)?|CSS|React))"
    r"(?:\s*(?:의|을|를|코드|오류|버그|디자인|레이아웃|기능|화면|반응형|접근성|및|과|와)){0,5}\s*"
    r"(?:(?:제작|개발|구축|수정|리뉴얼|구현|유지\s*보수)\s*(?:을|를)?\s*"
    r"(?:의뢰|외주|요청|부탁|해\s*주실|해\s*주세요|해\s*주시|하실|"
    r"(?:(?:에\s*)?(?:능숙하신|익숙하신|경험\s*있으신)\s*분\s*)?(?:좀\s*)?도와\s*(?:주실|주세요))"
    r"|만들어\s*(?:주실|주세요|주시|줄))"
    r"(?!\s*(?:가|는|은|이)?\s*(?:아니|아닌|아닙|아님|없))"
)
CHANGED_WEBSITE = r"사이트|(?i:HTML|CSS|React)"
VBA_WORDS = r"VBA|vba|매크로|자동"
PHYSICAL_AUTOMATION = (
    r"(?:장비|설비|기구|레일)\s*(?:기구\s*)?(?:조립|유지\s*보수|배선|설치|셋업|세팅|개조|생산)",
    r"자동화\s*(?:생산\s*라인|라인\s*생산|생산|제조)",
    r"자동화\s*라인[^.\n]{0,12}(?:생산|자재|품질)",
)
SOFTWARE_DELIVERY = r"(?i:소프트웨어|프로그램\s*(?:개발|제작)|코딩|PLC|API|파이썬|Python|매크로|스크립트)"
PHYSICAL_SHOP = r"(?:물품|상품|제품)[^.\n]{0,20}(?:제작|포장|진열)[^.\n]{0,20}(?:포장|진열)|(?:물품|상품|제품)\s*(?:제작|포장)"
SHOP_DELIVERY = r"상세\s*페이지|(?:쇼핑몰|자사몰|카페24)\s*(?:을|를)?\s*(?:제작|개발|구축|수정|리뉴얼)|홈페이지|웹\s*사이트"
MARKETING_CONTEXT = r"(?i:광고|마케팅|홍보|캠페인|바이럴|\b(?:SEO|CPA|CPS)\b)"
MARKETING_WORK = r"(?i:(?:소재|이미지|문구|원고|배너|콘텐츠|영상)\s*(?:제작|디자인|작성|편집|수정)|(?:광고|캠페인|SNS|블로그|카페|SEO)\s*(?:운영|집행|대행|관리)|(?:상위|검색)\s*노출)"
MARKETING_SOFTWARE = (
    r"(?i:(?:홈페이지|홈피|랜딩\s*페이지|웹\s*(?:사이트|페이지|서비스|앱)|사이트|쇼핑몰|자사몰|카페24|"
    r"관리자\s*(?:페이지|화면)|프로그램|소프트웨어|앱|어플|플랫폼|코드|API|대시보드|매크로|챗봇|HTML|CSS|React)"
    r"(?:\s*(?:의|을|를|코드|오류|버그|기능|화면|폼|반응형|접근성|및|과|와|디자인|레이아웃)){0,5}\s*"
    r"(?:제작|개발|구축|수정|리뉴얼|구현|보완|개선|연동)\s*(?:을|를|이|가)?\s*"
    r"(?:의뢰|외주|요청|부탁|필요|해\s*주|하실|가능하신|견적|비용|(?:하?고|및|과|와|[+/,·]))"
    r"(?!\s*(?:가|는|은|이)?\s*(?:아니|아닌|아닙|아님|없)))"
)

# --- risks: name, label, patterns
RISKS = (
    ("upfront_payment", "구직자에게 선입금 요구", (r"(?:교육비|자료비|교육\s*자료비|가입비|등록비|보증금|키트\s*비용)[^.\n]{0,12}(?:입금|결제|선납|납부|송금)", r"선입금\s*(?:후|하시면|필수)")),
    ("income_guarantee", "과장된 고수익 보장 표현", (r"(?:고수익|월\s*\d+\s*(?:만|천)?\s*원?\s*이상)[^.\n]{0,10}보장", r"수익\s*(?:100%\s*)?보장")),
    ("account_rental", "계정·명의 대여 요구", (r"(?:계정|아이디|명의|통장)\s*(?:대여|빌려|양도|임대)",)),
    ("signup_lure", "가입·설치 유도", (r"(?:가입|앱\s*설치|회원\s*등록)\s*(?:후|하시면|필수)[^.\n]{0,20}(?:수익|지급|포인트|적립)",)),
    ("personal_info", "부적절한 개인정보 요구", (r"(?:주민\s*등록\s*번호|주민번호|통장\s*사본|신분증)[^.\n]{0,10}(?:보내|제출|사진|전송)",)),
)
DOWN_PAYMENT = r"착수금|계약금|선금\s*\d+\s*%"

# --- teaching, advice, research
ADVICE = (
    r"수정\s*방향\s*(?:을|를)?\s*(?:제시|알려|조언)",
    r"(?:첨삭|조언|피드백)\s*(?:을|를|만|도)?\s*(?:요청|부탁|구합니다|구해요|해\s*주실|해\s*주세요)",
)
EDUCATION_TITLE = r"과외|강의|가르쳐|배우|교육해\s*주|교육\s*선생|취업.*도와"
DELIVERY_TITLE = r"(?:제작|개발|구축|납품)\s*(?:의뢰|외주)|납품"
EDUCATION = (r"과외", r"강의", r"교육해\s*주", r"가르쳐\s*주", r"배우고\s*싶", r"선생님|수업")
TEACHING_BODY = r"선생님|수업|과외|가르쳐\s*주"
RESEARCH_TITLE = r"연구.*(?:보조|조사)|업무\s*보조"
RESEARCH = (r"연구자료", r"자료\s*조사", r"방법\s*(?:서치|조사|검색)")
NO_ADVICE_ORDER, NO_TEACHING_ORDER, NO_RESEARCH_ORDER = "첨삭·조언 요청 — 제작 납품 의뢰 아님", "교육·과외 요청 — 제작 납품 의뢰 아님", "조사·보조 업무 — 제작 납품 의뢰 아님"

# --- scores
WORK_FIT, BUYER_INTENT, REMOTE_FIT, FRESHNESS, SCOPE_CLARITY = 30, 25, 20, 15, 10
RISK_PENALTY = 15
BASE_HOURS = {"landing": 20, "website": 28, "shop": 24, "fullstack": 80, "software": 40, "vba": 16, "automation": 16, "data": 10, "other": 20}
CATEGORY_LABEL = {"website": "웹사이트", "landing": "랜딩페이지", "shop": "쇼핑몰", "fullstack": "풀스택·웹 서비스", "software": "프로그램", "vba": "엑셀·VBA·매크로", "automation": "업무 자동화·연동", "data": "데이터 정리", "other": "기타"}
CLARITY = (
    r"페이지|화면|게시판|폼|양식|시트|기능|메뉴|지도|예약|로그인|관리자|알림",
    r"\d+\s*(?:건|명|개|종|행|페이지|회)",
    r"엑셀\s*\d{4}|카페24|워드프레스|React|Node|C#|파이썬|API|알림톡|WinForms",
    r"샘플|예시|자료|문구|사진",
    r"일정|까지|오픈|마감|주\s*안|이번\s*달",
)

# --- pay
NUMBER = r"\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?"
MULTIPLIER = r"억|천만|백만|만|천"
MULTIPLES = {"억": 100_000_000, "천만": 10_000_000, "백만": 1_000_000, "만": 10_000, "천": 1_000}
PAY_RANGE = rf"({NUMBER})\s*({MULTIPLIER})?\s*(?:원)?\s*[~\-–〜]\s*({NUMBER})\s*({MULTIPLIER})?\s*(원)?"
PAY_SINGLE = rf"({NUMBER})\s*({MULTIPLIER})?(?:\s*(\d+)\s*(천만|백만|만|천))?\s*(원)?"
UNIT_BEFORE = (
    (r"시급|시간당|시간\s*당", "hour"),
    (r"일급|일당|하루\s*(?:에)?\s*$", "day"),
    (r"주급", "week"),
    (r"월급|월\s*$|매월|매달|월\s*고정|한\s*달|월\s*급여|월\s*보수", "month"),
    (r"연봉|년\s*$|연\s*$", "year"),
    (r"건\s*당|프로젝트|예산|총\s*$|견적|제작비|개발비", "project"),
)
UNIT_AFTER = (
    (r"^\s*(?:/|\()\s*(?:\d+\s*)?(?:시간|시)", "hour"),
    (r"^\s*(?:/|\()\s*(?:\d+\s*)?(?:개월|월|달)", "month"),
    (r"^\s*(?:/|\()\s*(?:\d+\s*)?일", "day"),
    (r"^\s*(?:/|\()\s*(?:\d+\s*)?주", "week"),
    (r"^\s*(?:/|\()\s*(?:\d+\s*)?년", "year"),
    (r"^\s*(?:/|\()\s*(?:건)", "project"),
)
NEGOTIABLE = r"협의|조정\s*가능|조율|네고"
NEGOTIABLE_ONLY = r"(?:금액|예산|보수|급여|페이|비용|단가|견적|건\s*당|프로젝트|제작비|개발비)[^.\n]{0,20}?(?:협의|상의|조율)|(?:급여|보수|금액)\s*[:：]?\s*협의"
NOT_PAY_BEFORE = r"(?:교육비|자료비|가입비|등록비|보증금|수수료|매출|회비|입금)[^.\n]{0,6}$"
EXTERNAL_COST_BEFORE = (
    r"(?:호스팅\s*(?:비용|요금|비|료)|서버\s*(?:사용료|이용료|비용)|도메인\s*(?:등록|갱신|구입)?\s*(?:비용|비|료|요금))"
    r"(?:은|는|이|가)?\s*[:：]?\s*(?:(?:시간당|시간\s*당|하루(?:에)?|매월|매달|매년|월|연|년)\s*)?[:：]?\s*$"
)
DELIVERY_DURATION_BEFORE = r"(?:제작|개발|구축|납품|작업)\s*(?:기간|일정)(?:은|이)?\s*[:：]?\s*(?:약|대략)?\s*$"
DELIVERY_DURATION_AFTER = r"^\s*(?:소요|예상|납품|완료)"
PAY_CONTEXT = r"예산|시급|일급|주급|월급|연봉|보수|급여|금액|비용|페이|만원|고정|건당|견적|제작비|개발비|수익"
LOWER_AFTER = r"^\s*(?:부터|이상|~\s*$)"
UPPER_AFTER = r"^\s*(?:까지|이하|이내)"
UPPER_BEFORE = r"(?:최대|최고)\s*$"
LINE_PROJECT = r"예산|프로젝트|제작비|개발비|견적|건\s*당|외주"
PROJECT_PAYMENT = r"건\s*당\s*(?:지급|정산|계약|협의)|프로젝트\s*(?:단위|별)\s*(?:지급|정산|계약|협의)"
MONTHLY_PAYMENT = r"월\s*(?:단위|별)(?:로)?\s*(?:지급|정산|계약)|(?:매월|매달)\s*(?:지급|정산)"
TIME_PAY = {"hour": "시급", "day": "일급", "week": "주급", "month": "월급", "year": "연봉"}
PAY_PREFIX = {"project": "예산 ", "hour": "시급 ", "day": "일급 ", "week": "주급 ", "month": "월 "}

# --- dates; groups 1 and 2 are month and day
DEADLINES = (
    r"(\d{1,2})\s*월\s*(\d{1,2})\s*일\s*(?:\([^)]{1,3}\))?\s*(?:까지|마감|전까지)",
    r"(\d{1,2})\s*/\s*(\d{1,2})\s*(?:\([^)]{1,3}\))?\s*(?:까지|마감)",
    r"마감\s*(?:일)?\s*(?:은|는)?\s*[:：]?\s*(\d{1,2})\s*월\s*(\d{1,2})\s*일",
)
ALWAYS_OPEN = r"상시\s*(?:모집|채용)|채용\s*시\s*마감|구해지면\s*마감"
CLOSED = r"\[\s*마감\s*\]|(?:모집\s*(?:이\s*)?)?마감\s*(?:이\s*|가\s*)?(?:되었|됐|했|하였|완료|합니다|입니다)|(?:채용|구인)\s*완료|모집\s*종료"
CLOSED_LABEL = r"(?:모집\s*마감|구인\s*완료|채용\s*완료|모집\s*종료)"
CLOSED_PAST = r"되었|됐|했|하였"
RECRUITMENT = r"모집|구인|채용|지원|접수"
WORK_DATE = r"(?:작업|제작|개발|프로젝트|근무)\s*(?:은|는|을|를|이|가)?\s*(?:완료|마감|기간|일정)|납품|납기|완성|오픈|배포|착수"
CLAUSE_END = r"\n.!?。;，,"
FUTURE_CLOSE = r"예정|내일|모레|다음\s*(?:주|달)|(?:까지|되면|(?:완료|종료)\s*(?:시|후))"
NEGATED_CLOSE = r"마감[^.\n]{0,10}(?:아니|아님|않|취소)|완료[^.\n]{0,10}(?:아니|아님|않)"
DATED_CLOSE = r"\d{1,2}\s*(?:월\s*\d{1,2}\s*일|/\s*\d{1,2})"
CONDITIONAL_CLOSE = r"(?:바뀌|변경되|표시되|처리되|마감되)면"
WORK_START = r"(\d{1,2})\s*월\s*(\d{1,2})\s*일\s*(?:부터|시작|착수)"
WORK_START_VAGUE = r"(이번\s*(?:달|주)\s*(?:안에|내|중)?\s*시작|다음\s*(?:달|주)\s*(?:부터|시작|중)|바로\s*시작|즉시\s*(?:시작|투입))"

# --- what an analysis says
SAY = {
    "closed": "모집 마감", "closed_marked": " (원문 표시)", "deleted": "원문 삭제 확인", "not_allowed": "공개 수집 허용 불가·미확인 공고",
    "salary": "급여·salary 지급 — 건당 프리랜서 의뢰 아님", "by_time": " 지급 — 건당 프리랜서 의뢰 아님", "no_project_pay": "건당·프로젝트 지급 미확인",
    "seller": "판매자 홍보 — 구매 의뢰 아님", "seeker": "구직 글 — 의뢰 아님", "onsite": "출근 필수", "full_time": "정규직 채용 — 외주 아님", "full_time_remote": " (재택이어도 구분)",
    "part_time": "시간제·아르바이트 고용 — 건당 프리랜서 의뢰 아님", "risks": "위험 신호: ", "excluded_work": "제외 업무 포함 (", "denied": "내가 실제 의뢰 아님으로 표시",
    "staff": "쇼핑몰 운영 인력 모집 — 제작 납품 의뢰 아님", "only_data": "단순 데이터 작업 — 제작 의뢰 아님", "no_development": "개발·자동화 업무 아님",
    "hiring": "인력 채용 — 제작 납품 의뢰 아님", "no_request": "프리랜서 제작 의뢰 미확인",
    "dev_unclear": "개발 업무 여부 불명확", "blocked": "접근 차단 — 모집 상태 확인 불가", "login_required": "로그인 필요 — 모집 상태 확인 불가", "access_error": "접근 오류 — 모집 상태 확인 불가",
    "status_unknown": "모집 상태 미확인", "by_hand": " — 수동 입력", "no_mark": " — 마감 표시 없음만으로 판단 안 함", "recheck": "모집 재확인 필요",
    "remote_unknown": "재택 미확인", "remote_inferred": "재택 추정 — 명시 없음", "remote_terms": "재택 조건 확인 필요", "in_person": "대면 필요", "first_meeting": " (첫 미팅)",
    "collab_unknown": "진행 방식(대면 여부) 미확인", "regional": "지원 지역 제한 — 자격 확인", "very_low": "보수가 매우 낮음 — 작업 범위·실제 계약금액 협의 필요",
    "ongoing": "지속 의뢰 명시", "bought": "구매 의뢰 명시", "online": "재택·온라인 명시", "remote": "재택 명시", "nationwide": "전국 지원",
    "quote_needed": "금액 협의 — 견적 필요", "no_budget": "예산 미기재 — 확인 필요", "pay_conflict": "보수 금액 불일치 — 사이트 ", "pay_conflict_body": ", 본문 ",
}
FLOOR = {
    "setting": "내 최소 계약금액 ", "below": "최소 계약금액 미달 — 협의 필요 (", "across": "예산 범위가 최소 계약금액에 걸침 — 확정 금액 확인 (", "low_bound": "게시 하한이 최소 계약금액 미달 — 최종 금액 확인 (",
    "no_low": "계약금액 하한 미확인 — 최소 계약금액 충족 확인 (게시 상한 ", "open": "계약금액 협의", "none": "계약금액 미확인", "check": " — 최소 계약금액 충족 확인 (",
}
ASK = {
    "pay_conflict": "사이트 표시 보수와 본문 금액이 다릅니다. 실제 건당 계약 금액은 얼마인가요?",
    "floor": ("프로젝트당 확정 계약금액을 내 최소 계약금액인 ", " 이상으로 협의할 수 있을까요?"),
    "low": "게시된 보수가 전체 작업의 계약금액인가요? 작업 범위에 맞춰 금액을 협의할 수 있을까요?",
    "remote": "원격으로만 진행해도 괜찮을까요?", "in_person": "대면 미팅을 화상으로 대체할 수 있을까요?", "budget": "생각하시는 예산 범위가 있으신가요?", "open": "아직 작업자를 찾고 계신가요?",
    "kind": "프로젝트 단위 외주인가요, 기간제 고용인가요?", "scope": "필요한 기능이나 페이지 목록을 받을 수 있을까요?", "schedule": "희망하시는 완료 일정이 있으신가요?",
}
NEXT = {"none": "검토 불필요", "risks": " — 작성자를 단정하지 않고 위험 신호만 표시", "open_post": "원문을 직접 열어 모집 여부 확인", "ask": "핵심 질문 확인 후 범위·일정 포함 견적 제시"}
DRAFT = {
    "hello": "안녕하세요, 올려주신 글 보고 연락드립니다.", "about": ("'", "' 관련해 원격으로 작업 가능한지 여쭙고 싶습니다."), "self": "[간단한 소개와 비슷한 작업 경험 — 직접 작성]",
    "reply": ("문의 남겨주셔서 감사합니다.", "원하시는 작업의 목적과 기능, 희망 일정·예산을 알려주시면 범위를 확인하겠습니다."),
    "questions": "진행 전에 몇 가지 확인하고 싶습니다.", "end": "답변 주시면 범위와 일정, 견적을 정리해 드리겠습니다.",
}
