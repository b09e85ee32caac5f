"""Edition list, patterns, rules, thresholds and word lists.

All of these must equal the published behaviour for right results, so they are
stated plainly and together.  Every operator takes them as parameters.
"""

from __future__ import annotations

# --- fixed values: editions (id, year, revision) -----------------------------
EDITIONS = [
    ("1979-초판", 1979, 0),
    ("1981-1차", 1981, 1),
    ("1988-5차", 1988, 5),
    ("1989-6차", 1989, 6),
    ("1990-7차", 1990, 7),
    ("1995-8차", 1995, 8),
    ("1997-9차", 1997, 9),
    ("1998-10차", 1998, 10),
    ("2004-11차", 2004, 11),
    ("2008-12차", 2008, 12),
    ("2016-13차", 2016, 13),
    ("2020-14차", 2020, 14),
]

# --- fixed values: years by revision used when an answer mentions one ---------
REVISION_YEARS = [
    1979, 1981, 1982, 1983, 1984, 1985, 1988, 1991,
    1995, 1997, 1998, 2004, 2008, 2016, 2020,
]

# --- fixed values: edition boundary lines ------------------------------------
EDITION_BOUNDARY = {
    "type_a": r"^\s*\d{4}년\s+(초판|\d{1,2}차)",
    "type_b": r"^\s*\d{1,2}차\s+\d{4}년",
}

# --- fixed values: header levels (level, depth, pattern) ---------------------
HEADER_RULES = [
    (
        "H1",
        1,
        r"^\s{0,3}(서문|序文|경영\s*(기본\s*이념|원칙|관리\s*요소|실행\s*원리|기본이념|관리요소"
        r"|실행원리|목표)|기업관|추구\s*가치|SUPEX|정적\s*요소|동적\s*요소|패기)",
    ),
    ("H2", 2, r"^\d{1,2}\.\s+[가-힣]"),
    ("H3", 3, r"^(가|나|다|라|마|바|사|아)\.\s+"),
    ("H4", 4, r"^\(\d{1,2}\)\s+"),
    ("H4b", 4, r"^\d{1,2}\)\s+[가-힣]"),
]
HEADER_GAP_LINES = 200

# --- fixed values: quote types, in priority order -----------------------------
QUOTE_TYPES = ["definition", "principle", "procedure", "checklist", "example", "narrative"]
TYPE_RULES = [
    {
        "name": "definition",
        "min_score": 2,
        "patterns": [
            r'^"[가-힣].*"[은는이가을를]?\s+(이|란|라\s*함은|뜻한다|의미한다|말한다)',
            r"^[가-힣A-Z]+[은는이가](란|라\s*함은|라는\s*것은|을\s*말한다|의\s*정의)",
            r"(이란|이라\s*함은|을\s*말한다|을\s*의미한다|을\s*뜻한다)\s*[.。]?\s*$",
            r"의미하며.*뜻한다",
            r"[을를]\s*(의미하|뜻하)[는다며고니]",
            r"이란[,]\s*[가-힣]",
            r'[은는이가]\s*"[^"]{2,}"[을를]?\s*(의미|뜻)',
        ],
        "keywords": [],
    },
    {
        "name": "example",
        "min_score": 2,
        "patterns": [
            r"(예를\s*들면|예를\s*들어|예컨대|일례로|실례로)",
            r"(구체적\s*예|대표적\s*예)",
        ],
        "keywords": ["예를 들", "예컨대"],
    },
    {
        "name": "checklist",
        "min_score": 6,
        "per_line": True,
        "patterns": [
            r"^(가|나|다|라|마|바|사|아)\.\s+",
            r"^\(\d{1,2}\)\s+",
            r"^\d{1,2}\)\s+[가-힣]",
            r"^[①②③④⑤⑥⑦⑧⑨⑩]",
        ],
        "keywords": [],
    },
    {
        "name": "procedure",
        "min_score": 4,
        "patterns": [
            r"(첫째|둘째|셋째|넷째|다섯째)",
            r"(1단계|2단계|3단계|제1단계|제2단계)",
            r"먼저[,.]?\s",
            r"(다음으로|그\s*다음에|이어서|그런\s*다음)\s",
            r"(마지막으로|최종적으로)\s",
        ],
        "keywords": ["절차", "프로세스", "스텝"],
    },
    {
        "name": "principle",
        "min_score": 2,
        "patterns": [
            r"(원칙|기본|근본|핵심|본질)[이을를은는]\s*(이다|된다|있다)",
            r"(바람직하다|마땅하다|당연하다)\s*[.。]?\s*$",
            r"(지향해야|추구해야|견지해야|확보해야)\s*(한다|할\s*것이다)",
            r"경영[의은는이가]\s*(기본|핵심|근간|근본|바탕)",
        ],
        "keywords": ["원칙", "철학", "이념", "가치", "SUPEX", "기본이념", "경영이념"],
    },
]
TYPE_PRIORITY = ["definition", "principle", "example", "checklist", "procedure", "narrative"]

# --- fixed values: quality flags ----------------------------------------------
FLAG_RULES = [
    ("ocr_error", "contains", ["□", "■", "?????", "!!!!"]),
    ("page_header_leak", "regex", r"^\d+\s*$"),
    ("table_broken", "contains", ["│", "┌", "┐", "└", "┘", "├", "┤"]),
    ("reference_unresolved", "regex", r"\(.*참조\)|\(.*별첨\)|\(.*부록\)"),
]
EXCLUDED_FLAGS = ["ocr_error"]

# --- fixed values: segmentation limits ----------------------------------------
MIN_TOKENS = 100
SPLIT_ABOVE = 1500
MAX_CHARS = 1000
OVERLAP_TOKENS = 50

# --- fixed values: keyword index and fusion -----------------------------------
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25
RRF_K = 60
ALPHA = 0.6
SCORE_THRESHOLD = 0.5

# --- fixed values: policies ----------------------------------------------------
POLICY = {
    "latest_first_intents": ["general_definition", "open_ended", "content_generation"],
    "primary_edition": "2020-14차",
    "min_hits": 2,
    "fallback_editions": ["2016-13차", "2008-12차"],
    "evolution_intents": ["evolution_comparison"],
}
INTENTS = [
    "specific_time", "general_definition", "evolution_comparison",
    "content_generation", "open_ended",
]
INTENT_TO_TYPE = {
    "specific_time": "single_version",
    "general_definition": "definition",
    "evolution_comparison": "cross_version",
    "content_generation": "open_ended",
    "open_ended": "open_ended",
}
OUTPUT_TYPES = ["summary", "card", "comparison_table", "quiz", "slide"]

# --- fixed values: query classification ----------------------------------------
CROSS_KEYWORDS = [
    "변화", "변했", "달라졌", "어떻게 다른", "비교", "비교해", "대비", "변천", "변천사",
    "변천과정", "처음 등장", "처음 도입", "언제 처음", "에서부터", "까지", "재구성",
    "재편", "개편", "진화", "발전",
]
MULTI_EDITION = r"(초판|(\d{1,2})차).{0,20}(초판|(\d{1,2})차)"
FIRST_SEEN = r"처음\s*(등장|도입)"
SINGLE_EDITION = [
    r"(\d{1,2})차\s*(개정판)?에서",
    r"(\d{1,2})차\s*개정판의",
    r"초판에서",
    r"초판의",
    r"(19[7-9]\d|20[0-2]\d)년\s*(판)?에서",
    r"현행\s*({corpus})?에서",
]
CURRENT_WORD = "현행"
CURRENT_EDITION = "2020-14차"
DEFINITION_QUERY = [
    r"(.{1,20})(이?란|란)\s*(무엇|어떤|뭐)",
    r"(.{1,20})의?\s*정의(는|는\?|를)?",
    r"(.{1,20})(?:이|가)\s*뭐",
    r"(.{1,20})(이란|란)\??\s*$",
    r"(.{1,20})(?:은|는)\s*(?:어떤|무슨)\s*(?:뜻|의미|개념)",
    r"어떤\s*의미로\s*사용",
    r"(.{1,20})의\s*(궁극적\s*)?(목적|목표|역할)(은|는|이)?\s*(\?|$)",
    r"(?i)what\s+is\s+",
]
DEFINITION_QUERY_SIMPLE = r"(뜻|의미|개념)\s*(은|는|이|가)?\s*(\?|$)"
HINT_REVISIONS = {
    "1": "1981-1차", "10": "1998-10차", "11": "2004-11차",
    "12": "2008-12차", "13": "2016-13차", "14": "2020-14차",
}
HINT_YEARS = {
    "1979": "1979-초판", "1981": "1981-1차", "1998": "1998-10차", "2004": "2004-11차",
    "2008": "2008-12차", "2016": "2016-13차", "2020": "2020-14차",
}
COUNT_PATTERN = r"(\d+)\s*(장|개|매|건|문제|문항|슬라이드|페이지)"

# --- fixed values: claims --------------------------------------------------------
CLAIM_PATTERNS = [
    ("purpose", [r"목적", r"궁극적", r"지향점", r"위해서?(?:\s|$)", r"위한\s", r"지향한다", r"실현하고자"]),
    ("definition", [r"을\s*말한다", r"를\s*말한다", r"을\s*뜻한다", r"를\s*뜻한다", r"이란\b", r"란\s", r"의미한다", r"이다\b"]),
    ("value", [r"가치를?\s*(?:창출|추구|중요|키우)", r"핵심\s*(?:동력|가치|원천)", r"경쟁력의?\s*원천", r"원동력", r"행복을?\s*(?:키워|추구|만들|창출)", r"지속\s*가능"]),
    ("principle", [r"해야\s*한다", r"하여야\s*한다", r"어야\s*한다", r"추구한다", r"실천한다", r"노력한다", r"장려한다", r"조성한다", r"갖추어야", r"필수적이다"]),
    ("stance", [r"믿음", r"믿습니다", r"확신", r"할\s*것이(?:다|라)", r"될\s*것이(?:다|라)", r"줄\s*것이(?:다|라)", r"할\s*수\s*있다", r"될\s*수\s*있다", r"나간다", r"나갈\s*것"]),
]
SUBJECT_KEYWORDS = [
    "SUPEX", "VWBE", "To-be Model", "Better Company", "CbA", "KPI", "SDGs", "구성원 행복",
    "구성원", "사회적 가치", "경제적 가치", "이해관계자 행복", "이해관계자", "기업문화", "패기",
    "리더", "회사", "경영철학", "경영", "기업", "조직", "평가", "보상", "협력", "역량", "환경",
]
CLAIM_DEFAULT = "principle"
SUBJECT_DEFAULT = "일반"
SUBJECT_TOKEN = r"(\S+?)(?:은|는|이|가)\s"
CLAIM_MIN_CHARS = 20
CLAIM_NUMBER_ONLY = r"^\d+[.)]\s*$"
CLAIM_DATE_ONLY = r"^\d{4}년\s*\d{1,2}월\s*$"

# --- fixed values: evidence checks -----------------------------------------------
CITATION = r"\b(\d{4}-(?:\d{1,2}차|초판)\|[^|\s]+\|[^|\s]+\|[^|\s]+)\b"
REF_MARK = r"\(Ref:\s*([^)]+)\)"
HALLUCINATION_RULES = [
    ("일반론 주장", r"(?:일반적으로|통상적으로|보통)\s+.{5,}(?:알려져|여겨)"),
    ("구체적 조항 번호", r"(?:제\s*\d+\s*조|조항\s*\d+)"),
    ("구체적 날짜 (환각 가능)", r"\d{4}년\s*\d{1,2}월\s*\d{1,2}일"),
    ("구체적 백분율 수치", r"(?:약\s*)?\d+(?:\.\d+)?%"),
]
MIN_SHARED_CHARS = 8

# --- fixed values: evaluation -----------------------------------------------------
AXES = ["relevance", "faithfulness", "quote_accuracy", "temporal_correctness"]
AXIS_THRESHOLDS = {
    "relevance": 3.5,
    "faithfulness": 4.0,
    "quote_accuracy": 3.5,
    "temporal_correctness": 3.5,
}
PASS_RATE_THRESHOLD = 80.0
COVERAGE_LABELS = ["초판", "1차", "10차", "11차", "12차", "13차", "14차"]
MIXED_YEARS_ALLOWED = ["evolution_comparison", "cross_version"]
TERM_PATTERN = "[가-힣]{2,6}"

# --- fixed values: prices (USD per 1,000 tokens) and exchange rate ------------------
PRICES = [
    ("claude-3-5-sonnet", 0.003, 0.015),
    ("gpt-4o", 0.0025, 0.010),
    ("gpt-4o-mini", 0.00015, 0.0006),
]
DEFAULT_PRICED_MODEL = "gpt-4o-mini"
KRW_PER_USD = 1350

# --- fixed values: throttle and alert limits ------------------------------------------
THROTTLE_PER_MINUTE = 60
THROTTLE_BURST = 10
ALERT_WARN_RATIO = 1.5
ALERT_CRITICAL_RATIO = 2.0
ALERT_ERROR_RATE = 0.05
