"""Retrieval concepts, record roles, their wording and score weights."""

#: key, pattern without case
CONCEPTS = (
    ("network_card_form", r"\b(?:smartnic|network interface card|network adapter|networking card)\b"),
    ("networking", r"\b(?:ethernet|router|gateway|network interface)\b"),
    ("high_speed_ethernet", r"\b(?:25|40|50|100|200|400)\s*(?:g|gb)e\b|\b(?:25|40|50|100|200|400)gbe\b"),
    ("macsec", r"\bmacsec\b"),
    ("tls_offload", r"\b(?:tls offload|tls transport|https transport)\b"),
    ("transport_security", r"\b(?:mqtt over tls|tls transport|https)\b"),
    ("ai_accelerator", r"\b(?:ai\s+accelerator|accelerator\s+(?:card|module)|inference|training)\b"),
    ("pcie_accelerator_card", r"\bpcie\b"),
    ("hbm_memory", r"\bhbm\d*[a-z]*\b"),
    ("accelerator_performance", r"\b(?:int8|tops|fp16|tflops)\b"),
    ("firmware_security", r"\b(?:firmware\s+signing|remote\s+attestation|secure\s+boot)\b"),
)
ABSENT = r"\b(?:no|without|disabled|unpopulated|not included|not available|excludes?)\b"
NETWORKING = r"\b(?:smartnic|network interface|network adapter|ethernet|router|switch|traffic offload)\b"
ACCELERATOR = r"\b(?:ai accelerator|accelerator card|inference|training|hbm|tops|tflops)\b"

#: record types that name their role
TYPE_ROLES = (
    ("prior_memo", "classification_memo"), ("approval_record", "classification_memo"), ("review_note", "review_worksheet"), ("datasheet", "product_precedent"),
    ("technical_spec", "product_precedent"), ("catalog", "product_precedent"), ("spreadsheet", "product_precedent"), ("regulatory_material", "regulatory_material"),
    ("technical_source", "technical_source"),
)
RECORD_START, RECORD_FIELD = r"(?im)^\s*(?:record[ _-]?id|product(?:[ _-]?name)?)\s*:", r"(?i)\b(?:prior[_ -]?eccn|review[_ -]?status|classification[_ -]?basis)\s*:"
#: role, where to look (heading or text), pattern; in this order
ROLE_WORDING = (
    ("classification_memo", "heading", r"\b(?:internal )?classification memo\b"),
    ("review_worksheet", "heading", r"\b(?:classification review worksheet|review worksheet)\b"),
    ("technical_source", "heading", r"\b(?:data ?sheet|technical (?:source|spec(?:ification)?))\b"),
    ("counsel_guidance", "heading", r"\b(?:counsel review summary|outside counsel (?:memorandum|memo)|legal opinion|legal guidance|counsel findings|attorney review conclusions)\b"),
    ("counsel_guidance", "text", r"\b(?:purpose|summary)\s*:\s*(?:legal|counsel)\s+(?:guidance|advice|review)\b"),
    ("internal_policy", "heading", r"\b(?:internal (?:export )?policy|policy excerpt|review policy|company[- ]wide (?:policy|procedure))\b"),
    ("internal_policy", "text", r"\b(?:policy|procedure)\s*:\s*.+\b(?:must|shall|required)\b"),
    ("administrative", "text", r"\b(?:administrative|upload instructions|index manifest)\b"),
)
PRODUCT_ROLES = ("product_precedent", "classification_memo", "review_worksheet", "technical_source")
POOL_ROLES = (
    ("product_precedents", ("product_precedent", "classification_memo", "review_worksheet")), ("technical_comparisons", ("technical_source",)),
    ("counsel_guidance", ("counsel_guidance",)), ("internal_policy", ("internal_policy",)), ("regulatory_context", ("regulatory_material",)),
)
RECORD_ID = r"(?im)^(?:record[ _-]?id|id|case[ _-]?id)\s*:\s*([^\n]+)"
RECORD_IDS = r"(?im)(?:record[ _-]?id|case[ _-]?id|^id)\s*:\s*[^\n]+"
HISTORY_CODE = r"\b[0-9][A-Z][0-9]{3}(?:\.[A-Za-z0-9]+|[A-Za-z0-9]*)?\b"
TRACE = 10
