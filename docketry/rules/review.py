"""Status transitions, review ladders, stop words and limits."""

TRANSITIONS = (
    ("pending", "queued"), ("pending", "failed"), ("pending", "blocked"),
    ("queued", "running"), ("queued", "unknown"), ("queued", "failed"), ("queued", "blocked"),
    ("running", "completed"), ("running", "needs_attention"), ("running", "unknown"), ("running", "failed"), ("running", "blocked"),
    ("unknown", "running"), ("unknown", "completed"), ("unknown", "needs_attention"), ("unknown", "failed"), ("unknown", "blocked"),
    ("needs_attention", "running"), ("needs_attention", "blocked"), ("blocked", "running"),
)

WORKFLOW = (
    ("approved", "approved_for_internal_use"), ("rejected", "escalated"), ("needs_more_information", "needs_additional_documentation"),
    ("reviewed", "reviewer_conclusion_recorded"), ("pending_review", "in_technical_review"),
)

STOP_WORDS = (
    "the", "and", "with", "from", "that", "this", "document", "datasheet", "upload", "new", "review", "path", "paths", "current", "detected",
    "product", "profile", "specification", "specifications",
)
TOKEN = "[A-Za-z0-9][A-Za-z0-9_.-]{1,}"
QUERY_TERMS, MATCHES, POOL = 48, 50, 3

MAX_FILES, MAX_FILE_BYTES, MAX_BATCH_BYTES = 20, 8 * 1024 * 1024, 50 * 1024 * 1024
EXTENSIONS = ("pdf", "txt", "md", "csv", "json")
MIME_TYPES = ("application/pdf", "text/plain", "text/markdown", "text/csv", "application/json")

CHUNK_SIZE, CHUNK_OVERLAP, CHUNK_LEAST = 1200, 180, 660
MAX_TEXT_CHARS = 1_000_000
