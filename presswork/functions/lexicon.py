"""Word lists, patterns and thresholds that results depend on."""

from __future__ import annotations

# Fixed values. Stop words of the title tokens.
TITLE_STOPWORDS = (
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "at", "for", "with", "as", "is", "was", "are", "be", "by", "from", "after", "new",
    "what", "should", "that", "this",
)

# Fixed values. Korean particles, verb endings and stop words of the content tokens.
PARTICLES = (
    "에서는", "에서도", "에서", "에게", "으로는", "으로", "로는", "로", "까지", "부터", "보다", "처럼", "만큼", "이라는", "라는", "이라고", "라고", "이며", "이고",
    "와", "과", "의", "을", "를", "은", "는", "이", "가", "도", "만", "에", "께", "며", "엔", "서",
)
ENDINGS = (
    "했다", "했습니다", "한다", "합니다", "됐다", "됩니다", "된다", "하며", "하고", "했고", "했으며", "이다", "였다", "있다", "없다", "됐고", "되며", "하는", "했던",
    "되는", "됐으며", "했는데", "한다는", "했다는", "이라며", "라며", "다고", "다는", "습니다", "었다", "았다", "였고", "인데", "이란",
)
CONTENT_STOPWORDS = (
    "이날", "지난", "지난달", "지난주", "전했다", "밝혔다", "따르면", "대해", "위해", "통해", "이번", "오늘", "것으로", "현지시간", "현지", "시간", "관련", "말했다",
    "설명했다", "가운데", "이후", "이어", "오전", "오후", "올해", "내년", "작년", "기자", "특파원", "뉴스", "기사", "소식", "대비", "보다", "기준", "최대", "최소",
    "한때", "평균", "하루", "약", "등",
)

# Fixed values. Single characters and marks that headlines use for words.
HEADLINE_SIGNS = {
    "美": " 미국 ", "中": " 중국 ", "日": " 일본 ", "韓": " 한국 ", "英": " 영국 ", "獨": " 독일 ", "佛": " 프랑스 ", "北": " 북한 ", "↑": " 상승 ", "↓": " 하락 ",
    "⋯": "...", "s&p": "snp", "S&P": "snp", "弗": "달러",
}
PRESS_TAGS = (
    r"[\[(【][^\])】]{0,40}=[^\])】]{0,40}[\])】]|[\[(【](?:단독|속보|종합\d*보?|포토|영상|사진|인터뷰|르포|그래픽|사설|칼럼)[\])】]"
    r"|[가-힣]{2,4}\s*(?:특파원|객원기자|기자|통신원)\s*="
)
ROUTINE_COMPARISON = r"(?:전장|전월|전년|전작|전일|전주|전분기|전 거래일|작년|지난해|연초|직전)\s*(?:대비|보다|比)"
CENTRAL_BANK = r"(?<![가-힣])한은(?=$|[^가-힣]|[이은의에가도])"

# Fixed values. What an article reports on; "family:detail".
TARGETS = {
    "policy_rate": r"기준\s*금리|정책\s*금리|policy rate",
    "loan:mortgage": r"주택\s*담보\s*대출|주담대|mortgage",
    "loan:credit": r"신용\s*대출",
    "loan:household": r"가계\s*대출",
    "loan:business": r"기업\s*대출",
    "deposit": r"예금|수신\s*금리",
    "market_rate": r"시장\s*금리",
    "oil": r"(?<![원석])유가(?!\s*증권)|원유\s*(?:가격|값|선물)|oil price",
    "oil:brent": r"브렌트",
    "oil:wti": r"(?<![a-z])wti(?![a-z])|서부\s*텍사스",
    "oil:dubai": r"두바이유",
    "fuel": r"휘발유|휘발윳값|경윳값|경유\s*(?:값|가격|수출)|기름값",
    "oil_inventory": r"(?:원유|석유|석유\s*제품|연료|휘발유|경유|정제유)\s*재고",
    "oil_supply": r"(?:원유|석유|산유)\s*(?:공급|수출|생산|수송|운송|통과|선적)|(?:원유|석유)\s*(?:감산|증산)|(?:공급|수출|수송|운송|선적)\S{0,3}\s*(?:원유|석유)|산유량|opec|오펙",
    "fx": r"환율|원\s*[/·.]\s*달러|달러\s*[/·]\s*원|원화\s*(?:가치|약세|강세)",
    "fx:jpy": r"엔화|엔\s*[/·]\s*달러",
    "stocks": r"증시|주식\s*시장|코스피|코스닥|다우|나스닥|snp|3대\s*지수|주가|특징주",
    "inflation": r"물가|(?<![a-z])(?:cpi|pce)(?![a-z])|인플레이션",
    "growth": r"성장률|(?<![a-z])gdp(?![a-z])|국내\s*총생산|성장세|경제\s*성장",
    "jobs": r"고용|실업률|일자리|비농업",
    "gold": r"금값|금\s*가격|국제\s*금(?:값|시세)",
    "crypto": r"비트코인|가상\s*자산|암호\s*화폐",
    "housing": r"집값|아파트\s*값|주택\s*가격|전셋값|전세\s*가격",
    "tariff": r"관세",
}
BOND_TENOR = r"(\d{1,2})\s*년\s*(?:물|만기\s*(?:미국\s*)?(?:국채|국고채))"
BOND_ANY = r"국채|국고채|장기\s*(?:금리|물)|채권\s*금리|treasury"
BOND_COUNTRIES = {"미국": "us", "미": "us", "일본": "jp", "독일": "de", "영국": "uk", "중국": "cn", "한국": "kr", "국내": "kr"}
SUBJECTS = {
    "phone": r"스마트폰|휴대폰|폴더블|갤럭시\s*[sz]\s*\d|갤s\d|아이폰",
    "tablet": r"태블릿|갤럭시\s*탭|아이패드",
    "earbuds": r"이어폰|버즈|에어팟|헤드폰",
    "tracker": r"스마트\s*태그|갤태그|에어태그|위치\s*추적",
    "watch": r"워치",
    "laptop": r"노트북|갤럭시\s*북|맥북",
    "chip": r"반도체|(?<![a-z])(?:hbm|gpu|npu)|d램|디램|낸드|메모리|파운드리|엑시노스|스냅드래곤",
    "ev": r"전기차|(?<![a-z])ev(?![a-z])",
    "battery": r"배터리|이차\s*전지",
    "dairy": r"우유|낙농|유업|음용유|분유|치즈",
    "ai": r"(?<![a-z])ai(?![a-z])|인공지능|챗gpt",
}
PRICE_FAMILIES = ("loan", "deposit", "market_rate", "oil", "fuel", "fx", "stocks", "inflation", "gold", "crypto", "housing", "bond")
QUANTITY_FAMILIES = ("oil_inventory", "oil_supply", "jobs")
PRICE_UP = r"상승|오르|오른|오를|오름|올라|올랐|급등|폭등|반등|돌파|치솟|뛰|뛴|최고(?!\s*(?:경영|책임))|강세|고공|높아|넘어|넘었|웃돌|껑충"
PRICE_DOWN = r"하락|내리|내린|내려|내렸|떨어|급락|폭락|약세|최저|꺾|낮아|밑돌|하회|주저앉"
QUANTITY_UP = r"증가|(?<![가-힣])늘|확대|회복|재개|최다|많아|증산|강화"
QUANTITY_DOWN = r"감소|(?<![가-힣])줄|축소|중단|감산|감축|급감|적어|차질|약화"
DECISIONS = {"hike": r"인상", "cut": r"인하", "hold": r"동결"}
STAGES = {
    "announce": r"공개|선보|발표|출시|론칭|내놓|나왔|나온|등장|unveil|launch",
    "sale": r"판매\s*(?:개시|시작)|사전\s*(?:판매|예약|구매)|예약\s*판매",
    "price_change": r"(?:가격|출고가|값)\s*(?:인상|인하|올리|내리)",
    "contract": r"계약|수주",
    "production": r"양산|생산\s*(?:개시|시작|확대|돌입)",
    "investment": r"투자|증설|공장\s*(?:건설|착공)",
    "earnings": r"실적|영업\s*이익|매출|순이익",
    "recall": r"리콜|회수",
    "personnel": r"취임|선임|사임|내정|퇴임",
    "deal": r"인수|합병",
    "legal": r"소송|특허\s*침해|제재|기소",
    "agreement": r"타결|합의",
    "breakdown": r"결렬|무산|파행",
}
FACETS = {
    "forecast": r"전망|예상|예측|관측|가능성|경고|시사",
    "impact": r"영향|여파|파장|부담|수혜|타격",
    "analysis": r"분석|진단|해석|배경|원인",
    "comparison": r"비교|대비|경쟁|versus|(?<![a-z])vs(?![a-z])",
    "reaction": r"반응|여론|소비자|이용자|투자자|평가",
    "review": r"리뷰|사용기|써보니|체험",
    "risk": r"결함|부작용|논란|리스크|위험|우려",
    "policy": r"대책|대응|조치|규제|지원책",
}

# Fixed values. Names and their spellings; category cues.
ALIASES = {
    "삼성전자": ("삼성전자", "Samsung Electronics"),
    "SK하이닉스": ("SK하이닉스", "SK 하이닉스", "SK hynix"),
    "엔비디아": ("엔비디아", "Nvidia"),
    "테슬라": ("테슬라", "Tesla"),
    "현대자동차": ("현대자동차", "현대차", "Hyundai Motor"),
    "한국은행": ("한국은행", "Bank of Korea"),
    "연준": ("연준", "Federal Reserve"),
    "AI": ("AI", "인공지능", "artificial intelligence"),
    "HBM": ("HBM", "고대역폭 메모리", "high bandwidth memory"),
    "GPU": ("GPU", "그래픽 처리 장치"),
    "반도체": ("반도체", "semiconductor", "semiconductors"),
    "메모리": ("메모리", "memory"),
    "금리": ("금리", "interest rate", "interest rates"),
    "물가": ("물가", "inflation"),
    "환율": ("환율", "exchange rate", "exchange rates"),
    "경제성장": ("경제성장", "경제 성장", "economic growth"),
    "관세": ("관세", "tariff", "tariffs"),
    "은행": ("은행", "bank", "banks", "banking"),
    "증권": ("증권", "securities"),
    "보험": ("보험", "insurance"),
    "ETF": ("ETF", "ETFs"),
    "자동차": ("자동차", "automobile", "automotive"),
    "전기차": ("전기차", "electric vehicle", "electric vehicles", "EV"),
    "배터리": ("배터리", "battery", "batteries"),
    "원유": ("원유", "crude oil"),
    "천연가스": ("천연가스", "천연 가스", "natural gas"),
    "전력": ("전력", "electricity"),
    "재생에너지": ("재생에너지", "재생 에너지", "renewable energy"),
    "신약": ("신약", "new drug"),
    "임상시험": ("임상시험", "임상 시험", "clinical trial", "clinical trials"),
    "의약품": ("의약품", "pharmaceutical", "pharmaceuticals"),
    "주택": ("주택", "housing"),
    "부동산": ("부동산", "real estate"),
    "임대차": ("임대차", "전세", "월세"),
}
CATEGORY_CUES = {
    "거시경제": ("금리", "물가", "환율", "경제성장", "관세"),
    "금융": ("은행", "증권", "보험", "ETF"),
    "반도체": ("반도체", "HBM", "GPU", "메모리"),
    "자동차": ("자동차", "전기차"),
    "에너지": ("원유", "천연가스", "전력", "재생에너지"),
    "바이오": ("신약", "임상시험", "의약품"),
    "부동산": ("주택", "부동산", "임대차"),
}
KEYWORD_STOPWORDS = ("뉴스", "기사", "관련", "경제", "news", "report", "update")
EXTRA_KEYWORD_STOPWORDS = ("위해", "대한", "통해", "이번", "오늘")
ENTITY_NAMES = ("삼성전자", "SK하이닉스", "엔비디아", "테슬라", "현대자동차", "한국은행", "연준")
EVENT_NAMES = {
    **{name: ALIASES[name] for name in ENTITY_NAMES},
    "애플": ("애플", "apple"), "LG전자": ("LG전자", "LG Electronics"), "구글": ("구글", "google"), "마이크로소프트": ("마이크로소프트", "microsoft"),
    "트럼프": ("트럼프", "trump"), "이란": ("이란",), "사우디": ("사우디",), "중국": ("중국",), "일본은행": ("일본은행", "boj"),
}

# Fixed values. Shapes of models, people, organisations, figures and dates.
MODEL = (
    r"(?<![a-z0-9])(?:[a-z]{1,12}[- ]?\d+(?:\.\d+)?[a-z0-9+-]*(?:\s*(?:ultra|pro|max|plus|울트라|프로|플러스))?)(?![a-z0-9])"
    r"|(?:아이폰|iphone|폴드|플립)\s*\d+(?:\s*(?:pro|max|프로|플러스))?"
)
NOT_A_MODEL = r"^(?:q[1-4]|h[12]|[a-z]2[a-z]|snp\d+)$"
PREDICATE = r"(?:는|던|다|며|니|면|려|러|겠|했|았|었|었나|았나|였나|건가|는가|을까|일까|할까|어본|아본)$"
ROLES = r"회장|부회장|대통령|총재|부총재|대표|장관|차관|위원장|의장|원장|청장|시장|교수"
ORGANISATION_END = (
    r"(?:부|청|처|은행|위원회|공사|공단|협회|연구소|연구원|대학교|대학|정부|국회|법원|시청|도청|군청|구청|그룹|전자|자동차|통신|회사|기업|센터|노조|연맹|의회|재단|병원|진흥원|회의소)$"
)
IDENTITY_CONTEXT = ("정부", "국회", "미국", "한국", "중국", "일본", "영국", "독일", "프랑스", "각국", "국내", "우리", "산업", "무역", "통상", "경제", "정치권")
KOREAN_NAME = (
    r"^(?:[김이박최정강조윤장임한오서신권황안송전홍유고문양손배백허남심노하곽성차주우구민진지엄채원천방공현변함염여추도소석선설마길표명기반왕옥육]|남궁|황보|제갈|선우|독고)[가-힣]{1,3}$"
)
CLAIM_PREDICATE = (
    r"(?:밝혔|말했|설명했|발표했|결정했|의결했|합의했|승인했|철회했|거부했|구성했|신설했|시작했|중단했|확정했|체결했|지급했|완료했)(?:다|다고|으며|고)(?=$|[^가-힣])"
)
REPORTING_WORD = r"밝히|밝혔|말했|설명했|발표했|따르|알려|전했|약속|확인"
ANNOUNCEMENT_WORDS = (
    "합동", "마련", "마련한", "방안", "내용", "관련", "관계", "최근", "이번", "기준", "기존", "강화", "결과", "나왔다", "전문", "실질적", "한목소리",
)
EXPLANATION_LINK = r"때문|영향으로|에\s*따라|(?:상승|하락|급등|급락|증가|감소|변화)(?:으)?로"
GENERIC_ISSUE_WORDS = (
    "올해", "지난해", "국내", "기업", "정부", "업무", "정보", "부문", "공공", "공공부문", "계열", "의약품", "펩타이드", "glp", "달러", "원", "확대", "발표", "공개", "추진",
)
NUMBER = r"\d+(?:,\d{3})*(?:\.\d+)?"
FIGURE_UNIT = r"%\s*p|%\s*포인트|퍼센트\s*포인트|%|퍼센트|bp|달러|배럴|톤|t(?![a-z])|원(?!칙)|배(?!럴|당)|명|건|포인트|gb|tb|nm|mm|시간"
UNIT_NAMES = {"%p": "pp", "%포인트": "pp", "퍼센트포인트": "pp", "퍼센트": "%", "t": "톤"}
PARTIAL_DATE = r"(?<![\d.])(?:(\d{4})\s*년\s*)?(?:(\d{1,2})\s*월\s*)?(\d{1,2})\s*일(?!\s*(?:만|간|째|연속|동안|이내|새|가량|치|내))"

# Fixed values. Thresholds.
SCALED_FIGURE_TOLERANCE = 0.01
SNIPPET_FIGURE_TOLERANCE = 0.025
MIN_RELEVANCE = 0.65
KEYWORD_WEIGHT = 0.10
ENTITY_ONLY_PENALTY = 0.10
MMR_LAMBDA = 0.70
REPEAT_COSINE = 0.92
REPEAT_TEXT = 0.55
REPEAT_TITLE = 0.50
REPEAT_SHORT_TITLE = 0.85
REPEAT_HOURS = 48
MIN_DESCRIPTION = 40
NOVELTY_RATIO = 0.25
INITIAL_CANDIDATES, MAX_CANDIDATES = 20, 50
TITLE_OVERLAP = 0.4

# Fixed values. Decision routing.
USEFUL_ROLES = ("background", "consequence", "perspective", "detail")
POLICY = {
    "repeat_min": 0.50, "same_occurrence_min": 0.50, "different_occurrence_min": 0.50, "same_occurrence_strict": 0.80, "useful_min": 0.60, "help_min": 0.60,
    "offtopic_min": 0.60, "redundant_min": 0.70, "role_penalty": 0.30,
}
