"""Fixed values of the checks on finished runs: markers, wording, section orders, identity labels."""

LEAST_FACTS, MOST_REPEATS, LEAST_CLAIMS = 8, 2, 3

#: device, values of other devices that must not stand in its memo
STALE_MARKERS = (
    ("ADC32RF45", ("ADC12DJ5200RF", "12-bit", "10.4 GSPS", "5.2 GSPS", "8 GHz", "> 10 GHz", "JESD204C", "17.16 Gbps")),
    ("ADC12DJ5200RF", ("ADC32RF45", "14-bit", "3.0 GSPS", "dual-channel 14-bit", "JESD204B", "12.5 Gbps", "VQFN", "3.2 W/Ch")),
)

TEMPLATES = (r"\[\s*(?:placeholder|todo|insert[^\]]*(?:here|text)|tbd)\s*\]", r"\{\{[^}]+\}\}", r"\b(?:TODO|TBD)\s*:", r"\bINSERT\s+.+\s+HERE\b")
FINAL = (r"\bfinal\s+eccn\s+(?:is|:)", r"\bthe\s+eccn\s+is\b", r"\bclassified\s+as\s+(?:eccn\s+)?[0-9][a-z][0-9]{3}\b", r"\bthis\s+product\s+is\s+ear99\b")
WEAK_REASONS = ("high", "medium", "low")

SECTIONS = (
    ("## 1. Document Summary", "## 2. Extracted Technical Facts", "## 3. Recommended Review Paths", "## 4. Potential Review Candidates", "## 5. Open Questions and Missing Evidence",
     "## 6. Key Uncertainties", "## 7. Reviewer Questions", "## 8. ECCN Review Recommendation", "## 9. Review State"),
    ("## Document and canonical product model", "## Extracted source facts", "## Capability assessment", "## Open review paths", "## Eligible candidate ECCNs",
     "## Specific candidates not yet supportable", "## Reviewer questions", "## ECCN review recommendation", "## Review state"),
)
CONCLUSION, SECURITY_PATH = "## 8. eccn review recommendation", "category 5 part 2"
SECURITY_NAMES, SECURITY_CATEGORY = ("secure_boot", "cryptographic_algorithm", "crypto_key_size", "security_feature"), "security_cryptography"

#: interface fact name, family; a generic fact of that family repeats it
INTERFACES = (
    ("ethernet_mac", "ethernet"), ("pcie_interface", "pcie"), ("i2c_interface", "i2c"), ("uart_interface", "uart"), ("jtag_interface", "jtag"),
    ("displayport_interface", "displayport"), ("displayport_lane_rate", "displayport"),
)

BOILERPLATE_PHRASES = ("creating an environment where employees", "removing noninclusive language", "consequential damages", "expressly advised")
BOILERPLATE_WORDS = ("warranty", "liability")
LEGAL_PARTS = ("advised", "damages", "consequential", "expressly")
RESOLUTION_CONTEXT = ("cortex", "quad-core", "dual-core", "external inputs", "system monitor")
CHANNEL_CONTEXT = ("single channel (bit)", "control register", "direction control")
MEMORY_CONTEXT = ("cache with ecc", "nand", "memory", "flash", "error correction")
FORMULA_CONTEXT = ("formula", "equation", "calculate", "computed as", "sinad =")
RADIATION_CONTEXT = (
    "single event", "single-event", "single event latch-up", "single-event latch-up", "single event upset", "single-event upset", "radiation", "radiation tolerant",
    "radiation hardened", "rad-hard", "tid", "total ionizing dose", "heavy ion", "latch-up immunity", "see", "space qualified", "space-grade",
)

IDENTITY_LABELS = ("document number:", "document type:", "part number:", "product name:", "family overview:", "detected product profile:", "profile confidence:", "profile rationale:")
#: Claims with these words state a lack or a demand, not a fact.
UNCLAIMED = ("require", "no strong")
CITED_SOURCE = "datasheet evidence"
QUESTION_TOKENS = (r"\bJESD204[A-Z]?\b", r"(?:up to|greater than|less than|>|<)?\s*\d+(?:\.\d+)?\s*(?:GSPS|MSPS|KSPS|Gbps|GHz|MHz|bits?|lanes?)")
