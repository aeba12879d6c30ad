"""Names and fixed values shared by the whole package.

Exports carry Japanese headings. Everything behind ingest works on the short standard names on
the right; :func:`standard_name` lets callers keep using the headings (in a query spec, say).
"""

from __future__ import annotations

# --- fixed values: column headings of the exports and their standard names -----------------
STANDARD_NAMES = {
    "整備案件NO": "case_no",
    "機種名": "machine_model",
    "シリーズ": "series",
    "種別": "kind",
    "カテゴリ": "category",
    "部門名": "department",
    "整備区分": "service_class",
    "整備場所": "location",
    "保証区分": "warranty_class",
    "作業受付日": "received_date",
    "作業開始日": "started_date",
    "作業終了日": "work_date",
    "売上日": "sales_date",
    "保証開始日": "warranty_start",
    "部品交換日": "part_replaced_date",
    "経過日数": "elapsed",
    "アワメータ_HR": "hour_meter",
    "作業時間": "work_hours",
    "作業内容": "work_content",
    "作業明細備考": "work_note",
    "不具合内容": "malfunction_content",
    "故障状況": "failure_state",
    "部品品番": "parts_code",
    "部品品名": "parts_name",
    "部品数量": "parts_qty",
    "ファイル名": "source_file",
    "シート名": "source_sheet",
    "経過日数_日": "elapsed_days",
    "基準日": "base_date",
    "年": "year",
    "月": "month",
    "週": "week",
    "アワ帯": "hour_bin",
    "不具合フラグ": "malfunction",
    "ブルチンNO": "bulletin_no",
}

DATE_COLUMNS = [
    "received_date", "started_date", "work_date", "sales_date", "warranty_start",
    "part_replaced_date",
]
NUMBER_COLUMNS = ["hour_meter", "work_hours", "parts_qty"]
BASE_DATE_ORDER = ["sales_date", "work_date", "started_date"]
MALFUNCTION_COLUMNS = ["category", "malfunction_content", "failure_state"]
BULLETIN_COLUMNS = ["work_content", "work_note"]
PART_COLUMNS = ["parts_code", "parts_name", "parts_qty"]
FACET_COLUMNS = ["machine_model", "series", "kind", "department", "service_class"]
DISTRIBUTION_COLUMNS = ["machine_model", "series", "service_class", "warranty_class"]
RECORD_COLUMNS = [
    "case_no", "machine_model", "series", "category", "department", "work_date", "work_content",
    "malfunction_content", "parts_name", "parts_code", "work_hours", "hour_meter", "bulletin_no",
]
NUMERIC_RECORD_COLUMNS = ["work_hours", "hour_meter"]
RECORD_SEARCH_COLUMNS = [
    "work_content", "malfunction_content", "parts_name", "machine_model", "category",
]
LIKE_SEARCH_COLUMNS = ["work_content", "malfunction_content", "parts_name", "machine_model"]
RELEVANCE_WEIGHTS = {
    "work_content": 1.0, "malfunction_content": 1.0, "parts_name": 1.0, "machine_model": 0.5,
    "category": 0.5,
}

# --- fixed values: markers, words and patterns of the exports ------------------------------
NULL_MARKERS = ["« NULL »", "", " ", "  "]
FLAG_EXEMPT_WORDS = ["点検", "検査"]
INSPECTION_WORDS = ["点検", "検査", "特自検", "定期点検"]
BULLETIN_PATTERN = r"K-\d+-\d+"
UNKNOWN_BIN = "不明"
HOUR_BINS = [(250, "0-250"), (500, "250-500"), (1000, "500-1000"), (2000, "1000-2000")]
LAST_HOUR_BIN = "2000+"
PART_WORD = "部品"
COUNT_NAME = "件数"

# --- fixed values: labels of the composed texts ----------------------------------------------
RECORD_LABELS = {
    "machine_model": "機種", "series": "シリーズ", "category": "カテゴリ", "department": "部門",
    "work_content": "作業内容", "malfunction_content": "不具合内容", "parts_name": "交換部品",
    "parts_code": "部品番号", "hour_meter": "稼働時間", "work_hours": "作業時間",
    "bulletin_no": "ブルチン番号",
}
HOUR_UNIT = "時間"
LIGHT_LABELS = {
    "machine_model": "機種", "work_content": "作業内容", "malfunction_content": "不具合内容",
    "parts_name": "交換部品",
}
RECORD_SNIPPET_LABELS = {
    "work_content": "作業内容", "malfunction_content": "不具合", "parts_name": "部品",
}
LIGHT_SNIPPET_LABELS = {
    "machine_model": "機種", "work_content": "作業内容", "malfunction_content": "不具合",
    "parts_name": "部品",
}
CONTEXT_HEADER = ("【関連情報 - スコア: ", "】\n")
CONTEXT_LABEL = "関連情報: "
SUMMARY_FOUND = ("「{query}」に関連するデータが", "件見つかりました。")
SUMMARY_NOTHING = "「{query}」に関連するデータが見つかりませんでした。"
SUMMARY_LABELS = {"machine_model": "主な機種: ", "work_content": "主な作業内容: "}

# --- fixed values: search scores, weights and sizes -----------------------------------------
KEYWORD_SCORE = 1.0
LIGHT_KEYWORD_SCORE = 0.8
SEMANTIC_WEIGHT = 0.7
CONTEXT_CHARACTERS = 4000
FUZZY_ABOVE = 70
CHUNK_SIZE = 500
CHUNK_OVERLAP = 50
CHUNK_SEPARATORS = [" | ", "。", "、", " "]


def standard_name(name: str) -> str:
    """The standard name for an export heading; any other name is returned as it is."""
    return STANDARD_NAMES.get(name, name)

# Cells visited by one question. The original searches exactly up to 128 dimensions or below 100
# vectors and by cells otherwise; here the caller says which.
PROBES = 8
