"""They must be exactly these for results to be right.

Patterns are written in the dialect the detectors were specified in (ASCII ``\\d`` and ``\\b``, Unicode
``\\s``, ``$`` only at the very end); ``functions.dialect`` turns them into what an engine needs.
"""

# Detector patterns.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?:\+82[\s-]?)?(?:0?1[016789]|0\d{1,2})[\s-]?\d{3,4}[\s-]?\d{4}"
RRN = r"\b(\d{6})-?(\d{7})\b"
CARD = r"\b(?:\d[ -]?){13,19}\b"
BUSINESS_NO = r"\b(\d{3})-?(\d{2})-?(\d{5})\b"
ACCOUNT = r"(계좌(?:번호)?|입금|예금주)[^\d\n]{0,30}((?:\d[\s-]?){6,20})"

ADDRESS = (
    r"(?<![가-힣A-Za-z])(?:"
    r"서울특별시|서울시|서울|부산광역시|부산시|부산|대구광역시|대구시|대구|인천광역시|인천시|인천|광주광역시|"
    r"광주시|광주|대전광역시|대전시|대전|울산광역시|울산시|울산|세종특별자치시|세종시|세종|경기도|경기|"
    r"강원특별자치도|강원도|강원|충청북도|충북|충청남도|충남|전북특별자치도|전라북도|전북|전라남도|전남|경상북도|"
    r"경북|경상남도|경남|제주특별자치도|제주도|제주"
    r")[\s,]*[가-힣]{1,12}(?:시|군|구)"
    r"(?:[\s,]*(?:[가-힣A-Za-z0-9]+(?:동|읍|면|리|로|길|가|호|층|번지|번길|아파트|빌딩|타워|오피스텔|빌라|단지)"
    r"|\d+(?:-\d+)?(?=[\s,()]|$))){1,6}(?:\s*\([^)]{1,80}\))?"
)

# Checksum weights.
RRN_WEIGHTS = (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5)
BUSINESS_NO_WEIGHTS = (1, 3, 7, 1, 3, 7, 1, 3, 5)

# Digit counts and confidences.
PHONE_DIGITS = (9, 13)
CARD_DIGITS = (13, 19)
CONFIDENCE = {"email": 1.0, "phone": 0.9, "account": 0.7, "address": 0.8}
CHECKSUM_PASS, CHECKSUM_FAIL = 1.0, 0.5

# Order in which the detectors run, and order in which categories are shown.
RULE_ORDER = ("email", "phone", "rrn", "card", "businessNo", "account", "address")
DISPLAY_ORDER = ("rrn", "phone", "email", "account", "businessNo", "card", "address")
MANUAL = "manual"
LABELS = {
    "rrn": "주민등록번호",
    "phone": "전화번호",
    "email": "이메일",
    "account": "계좌번호",
    "businessNo": "사업자번호",
    "card": "카드번호",
    "address": "주소",
    "manual": "수동",
}

# Intake, naming, metadata.
PDF_MIME = "application/pdf"
LARGE_FILE_BYTES = 200 * 1024 * 1024
MAX_PASSWORD_RETRIES = 3
ANONYMIZED_SUFFIX = "-anonymized"
DEFAULT_BASE_NAME = "output"
METADATA_KEYS = ("title", "author", "subject", "keywords", "creator", "producer")

# Review gestures: smallest width and height, in canvas pixels (both strict).
MIN_DRAW_PX = 3
MIN_EDIT_PX = 1
UNDO_DEPTH = 100
# Resize handles, clockwise from the top left corner.
HANDLES = ("NW", "N", "NE", "E", "SE", "S", "SW", "W")

# Output audits.
ABSOLUTE_URL = r"""https?://[^"'\s)>]+"""
ALLOWED_URL_PREFIXES = (
    "http://www.w3.org/2000/svg",
    "http://www.w3.org/1999/xhtml",
    "http://www.w3.org/XML/1998/namespace",
    "http://www.w3.org/1999/xlink",
    "http://www.w3.org/1998/Math/MathML",
    "https://react.dev/errors/",
    "https://radix-ui.com/primitives/",
)
SIZE_BUDGET_BYTES = 18 * 1024 * 1024
