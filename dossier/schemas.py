"""Explicit schemas, and the fixed values the rules are made of."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -------------------------------------------------------------------------

ROLES = ["admin", "partner", "attorney", "paralegal"]

CASE_STATUSES = [
    "draft",
    "in_progress",
    "submitted_for_review",
    "under_review",
    "revisions_requested",
    "closed",
]

INGESTION_STATUSES = ["pending", "running", "done", "failed"]

ROUTES = ["single_shot", "multi_step"]

PERMISSIONS_OF_ROLE = {
    "admin": [
        "case:read:any", "case:read:assigned", "case:create", "case:edit:any",
        "case:edit:assigned", "case:delete", "case:submit_for_review", "case:assign",
        "case:review", "case:close", "user:manage",
    ],
    "partner": [
        "case:read:any", "case:read:assigned", "case:create", "case:edit:any",
        "case:edit:assigned", "case:assign", "case:review", "case:close",
    ],
    "attorney": ["case:read:assigned", "case:edit:assigned", "case:submit_for_review"],
    "paralegal": ["case:read:assigned", "case:edit:assigned"],
}

NEXT_STATUSES = {
    "draft": ["in_progress"],
    "in_progress": ["submitted_for_review"],
    "submitted_for_review": ["under_review"],
    "under_review": ["revisions_requested", "closed"],
    "revisions_requested": ["in_progress"],
    "closed": [],
}

# Any one of these permissions allows moving a case to the status; no entry: none is needed.
PERMISSIONS_FOR_TARGET = {
    "in_progress": ["case:edit:any", "case:edit:assigned"],
    "submitted_for_review": ["case:submit_for_review"],
    "under_review": ["case:review"],
    "revisions_requested": ["case:review"],
    "closed": ["case:close"],
}

STATUS_LABELS = {
    "draft": "Draft",
    "in_progress": "In Progress",
    "submitted_for_review": "Submitted for Review",
    "under_review": "Under Review",
    "revisions_requested": "Revisions Requested",
    "closed": "Closed",
}

ASSIGNABLE_ROLES = ["attorney", "paralegal"]

UPLOAD_EXTENSIONS = [".pdf", ".doc", ".docx", ".png", ".jpg", ".jpeg"]
MAX_UPLOAD_BYTES = 10 * 1024 * 1024
PARSEABLE_EXTENSIONS = [".pdf"]

SENTENCE_ENDS = [".", "؟", "?", "!", "؛", ":"]

CHUNK_SIZE, CHUNK_OVERLAP = 800, 100
WINDOW_SIZE, WINDOW_OVERLAP = 200, 40
EMBEDDING_WIDTH = 1024
TOP_K = 5
MAX_ITERATIONS = 3
MAX_ATTEMPTS = 3
STALE_MINUTES = 30
SESSION_HOURS = 24
RATE_LIMIT_SECONDS, RATE_LIMIT_ATTEMPTS = 60, 5

NOT_FOUND = "NOT_FOUND"
SINGLE_SHOT, MULTI_STEP = "SINGLE_SHOT", "MULTI_STEP"
CONTINUE, DONE = "CONTINUE", "DONE"
UNKNOWN_DOCUMENT = "Unknown document"

RATE_METRICS = ["context_hit_rate", "answer_hit_rate", "answered_rate"]
QUALITY_METRICS = ["mean_faithfulness", "mean_answer_relevancy"]

# Column of a structured court row -> section heading, in section order.
COURT_ROW_SECTIONS = {
    "case_facts": "الوقائع",
    "court_reasoning": "الأسباب",
    "applicable_laws": "السند النظامي",
    "verdict": "نص الحكم",
}
# Character classes of page text, and the marker of a citation.
ARABIC = "[؀-ۿ]"
LEFT_TO_RIGHT = "[0-9A-Za-z٠-٩۰-۹]"
NUMBER_JOINERS = "/.,: \u00a0"
DIGIT = "[0-9٠-٩]"
CITATION = r"\[(\d+)\]"
HEADER_CASE, HEADER_SECTION = "القضية", "القسم:"
ARTICLE_HEADING = r"^(المادة\s+[^\n:]+?)\s*:\s*$"

OLD_STATUS_TO_NEW = {"OPEN": "draft", "IN_PROGRESS": "in_progress", "CLOSED": "closed"}
NEW_STATUS_TO_OLD = {
    "draft": "OPEN",
    "in_progress": "IN_PROGRESS",
    "submitted_for_review": "IN_PROGRESS",
    "under_review": "IN_PROGRESS",
    "revisions_requested": "IN_PROGRESS",
    "closed": "CLOSED",
}
OLD_ROLE_TO_NEW = {"admin": "admin", "user": "attorney"}

# --- schemas ------------------------------------------------------------------------------


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_L, _I, _S, _B, _D = (
    T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType(), T.DoubleType()
)
_TS = T.TimestampNTZType()
_STRINGS = T.ArrayType(_S)
_TOKENS = T.MapType(_S, _L)

USERS = _struct(
    ("user_id", _L), ("email", _S), ("full_name", _S), ("role", _S), ("is_active", _B),
    ("must_change_password", _B), ("created_at", _TS),
)
SESSIONS = _struct(("session_id", _S), ("user_id", _L), ("expires_at", _TS))
CASES = _struct(
    ("case_id", _L), ("title", _S), ("description", _S), ("status", _S), ("created_at", _TS)
)
ASSIGNMENTS = _struct(("id", _L), ("case_id", _L), ("user_id", _L))
DOCUMENTS = _struct(
    ("document_id", _L), ("case_id", _L), ("filename", _S), ("file_path", _S),
    ("uploaded_by", _L), ("uploaded_at", _TS), ("ingested_content_hash", _S),
)
PAGE = _struct(("page_number", _I), ("text", _S))
CHUNKS = _struct(
    ("chunk_id", _L), ("case_id", _L), ("document_id", _L), ("page_number", _I),
    ("sequence", _I), ("text", _S), ("embedding", T.ArrayType(T.FloatType())),
)
REVIEWS = _struct(
    ("review_id", _L), ("case_id", _L), ("reviewer_id", _L), ("created_at", _TS), ("comments", _S)
)
FEEDBACK = _struct(
    ("feedback_id", _L), ("review_id", _L), ("author_id", _L), ("parent_id", _L),
    ("content", _S), ("created_at", _TS), ("resolved", _B),
)
JOBS = _struct(
    ("job_id", _L), ("document_id", _L), ("status", _S), ("attempts", _I), ("last_error", _S),
    ("created_at", _TS), ("updated_at", _TS),
)
FRAGMENTS = _struct(
    ("document_id", _L), ("page_number", _I), ("x", _D), ("y", _D), ("units", _STRINGS)
)
SECTION = _struct(("name", _S), ("text", _S))
STRUCTURED_CASES = _struct(
    ("case_id", _S), ("court", _S), ("city", _S), ("date", _S), ("sections", T.ArrayType(SECTION))
)
GOLD_ITEM = _struct(
    ("id", _S), ("lang", _S), ("question", _S), ("expected_section", _S),
    ("expected_answer_contains", _STRINGS), ("chunk_index_hint", _I), ("notes", _S),
)
GOLD_SET = _struct(
    ("corpus", _S),
    ("chunker", _struct(("window_size", _I), ("overlap", _I))),
    ("items", T.ArrayType(GOLD_ITEM)),
)
ITEM_RESULTS = _struct(
    ("mode", _S), ("round_index", _I), ("id", _S), ("lang", _S), ("question", _S),
    ("answered", _B), ("context_hit", _B), ("answer_hit", _B), ("answer_text", _S),
    ("contexts", _STRINGS), ("route", _S), ("iterations", _I),
    ("duplicate_passages_avoided", _L), ("latency_ms", _L), ("tokens", _TOKENS), ("trace_id", _S),
)
GRADES = _struct(
    ("mode", _S), ("round_index", _I), ("id", _S), ("faithfulness", _D), ("answer_relevancy", _D)
)
SPREAD = _struct(("mean", _D), ("stdev", _D), ("min", _D), ("max", _D), ("rounds", _L))
HISTORY = _struct(
    ("stamp", _S), ("mode", _S), ("git_sha", _S), ("llm_model", _S), ("embedding_model", _S),
    ("multi_step", _S), ("top_k", _I), ("ragas", _B), ("rounds", _L), ("total", _L),
    ("unstable_items", _STRINGS), ("n_unstable", _L), *[(m, SPREAD) for m in RATE_METRICS + QUALITY_METRICS],
    ("mean_latency_ms", _L), ("max_latency_ms", _L), ("total_tokens", _TOKENS),
    ("duplicates_avoided", _L), ("multi_step_routed", _L), ("answers_repeated_exactly", _B),
    ("faithfulness_graded", _L), ("answer_relevancy_graded", _L),
)
