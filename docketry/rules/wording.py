"""Wording patterns and term lists (Java and RE2 read them alike)."""

UNKNOWN = (r"\bunknown\b", r"\bnot\s+(?:specified|provided|documented)\b", r"\bto\s+be\s+(?:confirmed|determined)\b")
NEGATION = (
    r"\bno\b", r"\bnot\s+(?:included|available|present|provided|supported|populated|enabled)\b", r"\bwithout\b", r"\bdisabled\b",
    r"\bunpopulated\b", r"\bexcludes?\b", r"\bunavailable\b", r"\bdoes\s+not\b",
)
CONDITIONAL = (
    r"\boptional(?:ly)?\b", r"\bavailable\s+(?:separately|in\s+another)\b", r"\bif\s+(?:enabled|installed|populated|configured)\b",
    r"\bsome\s+(?:skus?|models?|variants?)\b", r"\broadmap\b", r"\bfuture\s+(?:model|release|variant)\b", r"\bunless\b", r"\bexcept\b",
)
SCOPES = (
    ("current_configuration", r"\b(?:current|export|production)\s+(?:sku|configuration|variant|unit)\b"),
    ("other_or_family_configuration", r"\b(?:another|other|some)\s+(?:sku|model|variant)|\bfamily[- ]level\b"),
    ("non_export_configuration", r"\b(?:development|evaluation|marketing)\s+(?:configuration|kit|variant)\b"),
    ("optional_or_future_configuration", r"\b(?:optional|available separately|future model|roadmap)\b"),
)
INSTRUCTIONS = (
    r"ignore\s+(?:all\s+)?previous\s+instructions", r"classify\s+(?:this|the)\s+product\s+as\s+[0-9][a-e][0-9]{3}",
    r"no\s+human\s+review\s+is\s+required", r"retrieve\s+only\s+records\s+that\s+confirm",
)

HISTORICAL_MARKS = ("prior internal", "previous review", "historical", "company history")
QUESTION_MARKS = ("?", "confirm whether", "whether ", "is encryption", "does the")
MISSING_MARKS = ("not specified", "not provided", "details required", "details unavailable", "to be confirmed", "under review")
NEGATED_CRYPTO = r"\b(no|without|not)\s+(?:customer[- ]facing\s+)?(?:encryption|cryptograph|key management|macsec|tls|ipsec|vpn|hsm)"
CONDITIONAL_MARKS = ("optional", "if enabled", "may ", "depends on", "subject to")

CRYPTO_TERMS = (
    "macsec", "tls offload", "ipsec", "vpn", "hsm", "cryptographic acceleration", "cryptographic accelerator", "user-accessible encryption",
    "user accessible encryption", "data confidentiality", "payload encryption", "bulk encryption", "key management", "key storage",
)
SECURITY_TERMS = ("encrypt", "crypto", "tls", "ipsec", "macsec", "secure boot", "key management", "firmware signing", "remote attestation")
AI_TERMS = ("ai accelerator", "tops", "tflops", "hbm3", "hbm3e")

#: A specific control code; ingestion allows A to E as the second character, the rest of the library A to Z.
CODE = r"\b[0-9][A-Z][0-9]{3}(?:\.[A-Za-z0-9]+|[A-Za-z0-9]*)?\b"
