"""Wording of the structural and narrative checks, and of mentions and their relations."""

SECURITY_TERMS = ("encrypt", "crypto", "tls", "ipsec", "macsec", "secure boot", "key management", "firmware signing", "remote attestation")
AI_TERMS = ("ai accelerator", "tops", "tflops", "hbm3", "hbm3e")
DENIED_SECURITY = ("no security features", "cryptography features were not found")
DENIED_CANDIDATES = ("no specific eccn candidates", "no review candidates")
DENIED_HISTORY = ("no comparable prior company history",)
DENIED_CRYPTO = ("no cryptographic features were identified", "security functionality was not found", "no encryption capability was detected", "cryptographic functionality was not identified")
DENIED_BOOT = ("security functionality was not found",)
CRYPTO_PATH = ("category 5 part 2", "cryptograph")
REVIEW_LANGUAGE = ("qualified reviewer", "expert review required", "classification sign-off")

PART_OR_MODEL = r"\b[A-Z]{2,}[A-Z0-9-]*\d[A-Z0-9-]*\b"
NON_PRODUCT = r"(?i)^(?:JESD|JEDEC|ANSI|ISO|IEEE|PCI|PCIE|USB|DDR|HBM|ARM|AES|RSA|SHA|JS)-?[A-Z0-9.-]*$"
HISTORY_ID = r"(?i)^(?:(?:[A-Z]{2,12}-)?(?:19|20)\d{2}-\d{2,8}|(?:CASE|CLASS|MEMO|REV)[-_]?\d{2,8})$"
HISTORY_CUE = r"(?i)\b(?:prior|internal|history|precedent|previous|classification|review|case|memo|record|compare(?:d)?\s+with|similar\s+to)\b"
PRODUCT_CUE = r"(?i)\b(?:product|model|part number|device|system|module|card|nic|appliance|gateway|adapter|server|switch|router|sensor|accelerator|board|kit)\b"
ATTRIBUTE_KEY = r"(?i)\b(?:memory|capacity|performance|throughput|interface|processor|bandwidth|form factor|configuration|frequency|storage|radio|wireless|encryption|algorithm|firmware|power|voltage|dimension)\b"
INSTRUCTION = r"(?i)\b(?:should\s+(?:surface|return|show|match)|expected\s+(?:result|behavior)|test\s+(?:case|manifest)|fixture|verify\s+that|use\s+this\s+(?:file|document))\b"
REFERENCE = r"(?i)\b(?:compare(?:d)?\s+(?:with|against|to)|comparison\s+(?:with|against|to)|should\s+(?:surface|retrieve|trigger)|retrieve\s+(?:the\s+)?prior|similar\s+to|prior\s+(?:product|record|memo)|previous\s+model|based\s+on\s+(?:the\s+)?earlier|internal\s+record|prior\s+memo|classification\s+precedent|historical\s+review|related\s+product|use\s+as\s+comparison|benchmark\s+against|replacement\s+for|compatible\s+with)\b"
PAST = r"(?i)\b(?:prior|internal|history|memo|record|precedent|historical)\b"
#: relation, pattern: the first that fits
RELATIONS = (
    ("included_component", r"(?i)\b(?:includes?|contains?|populated with|ships with|integrates?|installed|embedded|included|bill of materials)\b"),
    ("predecessor_reference", r"(?i)\b(?:predecessor|previous\s+generation|succeeds|replaces)\b"),
    ("successor_reference", r"(?i)\b(?:successor|next\s+generation)\b"),
    ("competitor_reference", r"(?i)\b(?:competitor|competing\s+(?:product|model))\b"),
    ("example_reference", r"(?i)\b(?:example|for\s+example|e\.g\.)\b"),
    ("compatible_product", r"(?i)\bcompatible\s+with\b"),
)
#: role, pattern of the lower-case text, pattern that must not occur
DOCUMENT_ROLES = (
    ("readme", r"\b(?:readme|installation|upload instructions)\b", r"\b(?:datasheet|technical specification)\b"),
    ("internal_policy", r"\b(?:internal policy|review policy|procedure)\b", ""),
    ("counsel_guidance", r"\b(?:counsel guidance|outside counsel|legal guidance)\b", ""),
    ("classification_memo", r"\b(?:classification memo|prior classification)\b", ""),
    ("multi_product_catalog", r"\b(?:catalog|product index|comparison matrix)\b", ""),
)

SPECIFICATION = (
    r"(?i)(?:\b\d+(?:\.\d+)?\s*(?:[KMGTPE]?B|bits?|bytes?|GHz|MHz|Gbps|GbE|GSPS|TOPS|TFLOPS|W|V|nm)\b|"
    r"\b(?:HBM\d*[A-Z]*|DDR\d+|PCIe\s*(?:Gen)?\d+(?:\s*x\d+)?|ARM\s+Cortex-[A-Z]\d+|(?:Wi-?Fi|BLE|Bluetooth)\s*\d(?:\.\d+)?|NVMe|AES-?\d+|RSA-?\d+)\b)"
)
HISTORY_ID_WITHIN = r"(?i)\b(?:[A-Z]{2,12}-)?(?:19|20)\d{2}-\d{2,8}\b|\b(?:CASE|CLASS|MEMO|REV)[-_]?\d{2,8}\b"
RECORD_NUMBER = r"(?i)^[A-Z][A-Z0-9-]{3,}$"
LISTED, ENUMERATED = r"^\s*(?:\d+[.)]|[-*])\s*", r"^\d+[.)]\s*"
KEYED = r"^\s*([A-Za-z][A-Za-z /_-]{1,48})\s*:\s*(.+?)\s*$"
TABLE_SUBJECT = r"(?i)\b(?:product|model|part number|device)\b"
SECTION = r"(?i)\b(?:product|model|part number|device)\s*:\s*([^\n]*)"
CONTAINMENT = RELATIONS[0][1]
TECHNICAL = r"(?i)\b(?:datasheet|technical specification|ethernet|interface|processor|firmware|throughput|frequency|voltage)\b"
SOURCE_WORDS = r"(?i)\b(?:datasheet|technical specification)\b"
#: relations that a document merely refers to
REFERRED = (
    "comparison_reference", "history_reference", "predecessor_reference", "successor_reference", "competitor_reference",
    "example_reference", "included_component", "compatible_product", "instruction_reference",
)
NON_PRODUCT_ROLES = ("test_manifest", "readme", "internal_policy", "counsel_guidance")
