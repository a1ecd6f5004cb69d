"""Names, lists, patterns and formats that must be exactly these for results to be right.

Patterns are written in the subset shared by Java's regex engine and RE2 (possessive quantifiers are used only by the
Spark side and do not change what matches).
"""

from __future__ import annotations

# --- text -----------------------------------------------------------------------------------------------------------
# Unicode white space as a character class body (the ASCII-only \s of the regex engine is not enough).
SPACE_CLASS = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# The same characters one by one.
SPACE_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
HTML_ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")]
HTML_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]
ILLEGAL_FILENAME_CLASS = r'<>:"/\\|?*'
MAX_FILENAME = 200
CODE_FENCE = r"```[a-zA-Z]*\n?|'''[a-zA-Z]*\n?"

# --- urls -----------------------------------------------------------------------------------------------------------
URL_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"
# Schemes whose last path segment may carry ';params'.
PARAM_SCHEMES = [
    "", "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtsps", "rtspu", "sip", "sips", "mms", "sftp",
    "tel",
]
LINK_SCHEMES = ["http", "https", "mailto", "tel"]

# --- dates ----------------------------------------------------------------------------------------------------------
EDITION_ZONE = "Asia/Shanghai"
EPOCH_MS_ABOVE = 1_000_000_000_000

# --- markup ---------------------------------------------------------------------------------------------------------
TOKEN = (
    r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
    r"""|<[a-z/!?](?:[^'">]+|"[^"]*"|'[^']*')*>|<[a-z/!?][^>]*>|[^<]+|<"""
)
VOID_TAGS = [
    "br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr",
]
KEPT_WHEN_EMPTY = ["img", "br", "hr", "td", "th", "iframe", "video", "audio"]
MEDIA_TAGS = ["svg", "video", "source", "audio", "track"]
ACTIVE_TAGS = ["script", "style", "iframe", "form", "input", "button", "noscript"]
BLOCK_TAGS = [
    "section", "div", "article", "aside", "header", "footer", "nav", "main", "figure", "blockquote", "pre", "ul",
    "ol", "li", "table", "form", "fieldset", "h1", "h2", "h3", "h4", "h5", "h6", "p", "address", "hr", "dl", "dt",
    "dd",
]
TABLE_PART_TAGS = ["tbody", "thead", "tfoot", "tr", "td", "th"]
TAG_RENAMES = {"row": "tr", "cell": "td", "font": "span"}
FONT_SIZE_PX = {"1": "8", "2": "10", "3": "12", "4": "14", "5": "18", "6": "24", "7": "36"}
FONT_SIZE_DEFAULT_PX = "12"
ALLOWED_ATTRS = [
    "href", "src", "alt", "title", "class", "style", "srcset", "data-srcset", "data-src", "data-original",
    "data-actualsrc", "data-lazy-src", "file", "zoom-target", "original", "width", "height", "colspan", "rowspan",
    "id",
]
LAYOUT_PROPERTIES = [
    "width", "height", "min-width", "max-width", "min-height", "max-height",
    "margin", "margin-top", "margin-bottom", "margin-left", "margin-right",
    "padding", "padding-top", "padding-bottom", "padding-left", "padding-right",
    "position", "top", "bottom", "left", "right", "float", "clear",
    "display", "flex", "grid", "border", "background", "background-image",
]
COLOR_STYLE = r"(?i)\b(background-)?color\s*:[^;]+(;|$)"
SMALL_ICON_PX = 32
XML_ATTR_NAME = r"^[a-zA-Z_:][a-zA-Z0-9._\-:]*$"

# --- images ---------------------------------------------------------------------------------------------------------
LAZY_IMAGE_ATTRS = [
    "data-src", "data-original", "data-actualsrc", "data-lazy-src", "file", "zoom-target", "original",
]
ASSET_IMAGE_ATTRS = [
    "data-src", "data-original", "data-actualsrc", "data-lazy-src", "srcset", "data-srcset", "file", "zoom-target",
    "original",
]
PLACEHOLDER_EXTENSIONS = [".gif", ".svg"]

# --- emoji ----------------------------------------------------------------------------------------------------------
EMOJI = (
    r"[\x{2600}-\x{27BF}]|[\x{1F300}-\x{1F5FF}]|[\x{1F600}-\x{1F64F}]|[\x{1F680}-\x{1F6FF}]"
    r"|[\x{1F900}-\x{1F9FF}]|[\x{1F1E6}-\x{1F1FF}]+"
)
EMOJI_IMAGE_STYLE = "height: 1em; width: 1em; vertical-align: middle; display: inline-block; border: none;"

# --- sources --------------------------------------------------------------------------------------------------------
DEFAULT_LIMIT = 15
MAIL_PAGE_LIMIT = 100
LEDGER_CAP = 500_000
MAX_SEARCH_RESULTS = 3
DEFAULT_TREND_GOAL = "分析并总结相关热点信息"
DEFAULT_TREND_TITLE = "热点分析: "
TREND_AUTHOR = "AI Analysis"
DEFAULT_MODEL = "google/gemma-4-31b-it:free"
FLAT_TYPES = ["web", "trending"]
UNKNOWN_ERROR = "未知错误"
SUMMARY_TITLE = "推送汇总"
CONTENTS_TITLE = "目录"
BACK_TO_CONTENTS = "返回目录"
# Title and paragraphs of a forecast article; {name} is a field of the forecast day.
FORECAST_TITLE = "{city}天气 {fxDate}: {textDay}, {tempMin}°C - {tempMax}°C"
FORECAST_SOURCE_TITLE = "{city}天气预报"
FORECAST_PARAGRAPHS = [
    ("白天天气", "{textDay}（图标：{iconDay}）"),
    ("夜间天气", "{textNight}（图标：{iconNight}）"),
    ("温度", "{tempMin}°C 至 {tempMax}°C"),
    ("降水量", "{precip} mm"),
    ("云量", "{cloud}%"),
    ("白天风力", "{windDirDay}（{wind360Day}°），{windScaleDay}级，风速 {windSpeedDay} km/h"),
    ("夜间风力", "{windDirNight}（{wind360Night}°），{windScaleNight}级，风速 {windSpeedNight} km/h"),
    ("湿度", "{humidity}%"),
    ("能见度", "{vis} km"),
    ("日出/日落", "{sunrise} / {sunset}"),
    ("月出/月落", "{moonrise} / {moonset}（月相：{moonPhase}，{moonPhaseIcon}）"),
    ("紫外线指数", "{uvIndex}"),
]
# Errors of a forecast without the wanted day.
FORECAST_TOO_SHORT = "Insufficient forecast data (at least 2 days needed for tomorrow default)."
FORECAST_NO_TOMORROW = "Tomorrow's forecast is not available."
FORECAST_NO_DAY_AFTER = "Day after tomorrow's forecast is not available."
