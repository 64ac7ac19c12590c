"""Identity patterns, families, and the words that keep or drop a match by what stands near it."""

TOP, NUMBER_TOP, CONTEXT = 2500, 1200, 180

#: Tried in this order, case counts.
PART_NUMBERS = (r"\b((?:ADC|DAC|ADS|AFE|LTC|AD|LMX|DAC\d|ADC\d)[A-Z0-9-]{4,})\b", r"\b([A-Z]{2,}\d{2,}[A-Z0-9+-]{1,})\b")
LEGAL_WORDS = (
    "advised", "damages", "consequential", "expressly", "contained herein", "liable", "warranty", "copyright", "trademark", "terms", "conditions",
    "expressly advised", "consequential damages", "liability", "product specification",
)
DOCUMENT_LIKE = r"^(?:DS|UG|PG|WP|XAPP|AM)\d{2,5}[A-Z]?$"
DOCUMENT_NUMBER = r"\b(DS\d{3,5}|UG\d{3,5}|PG\d{3,5}|WP\d{3,5}|XAPP\d{3,5})\b"
DOCUMENT_TYPE = r"\b(Product Specification|Overview|Data Sheet|Datasheet)\b"

DEVICE_TYPES = (
    (r"\b(mpsoc|adaptive soc|system-on-chip|soc|fpga|processor)\b", "Processor/SoC", "medium"),
    (r"\banalog[- ]to[- ]digital converter\b", "Analog-to-digital converter (ADC)", "high"),
    (r"\bdigital[- ]to[- ]analog converter\b", "Digital-to-analog converter (DAC)", "high"),
    (r"\bRF-sampling\b", "RF-sampling ADC", "high"),
    (r"\bADC\b", "ADC", "high"),
    (r"\bDAC\b", "DAC", "high"),
    (r"\baccelerator\b", "Accelerator", "medium"),
)
DESCRIBING = r"converter|adc|dac|rf-sampling|transceiver|processor|accelerator|mpsoc|soc|fpga"
DESCRIPTION_WORDS = ("analog-to-digital converter", "rf-sampling", "processor", "mpsoc", "soc", "fpga", "accelerator")

#: pattern, whether it is an overview of many parts, (name, value, category) of its facts
FAMILIES = (
    (r"\bZynq\s+UltraScale\+\s+MPSoC\b", True, (
        ("product_family", "Zynq UltraScale+ MPSoC", "product_identity"), ("product_name", "Zynq UltraScale+ MPSoC", "product_identity"),
        ("part_number", "Not a single part number - family overview", "product_identity"), ("is_family_overview", "true", "product_identity"),
        ("product_profile", "fpga_programmable_logic_soc", "profile_detection"), ("profile_confidence", "high", "profile_detection"),
        ("profile_rationale", "Detected from title/filename/top-level references to Zynq UltraScale+ MPSoC, processing system, programmable logic, and SoC features.", "profile_detection"),
    )),
    (r"\bi\.?MX\s+RT1170\s+Crossover\s+Processors\b|\bi\.?MX\s+RT1170\b", False, (
        ("product_family", "i.MX RT1170 Crossover Processors", "product_identity"), ("product_profile", "mcu_processor_soc", "profile_detection"), ("profile_confidence", "high", "profile_detection"),
        ("profile_rationale", "Detected from top-level references to i.MX RT1170 crossover processors, Arm Cortex-M processor cores, memory/cache, interfaces, and security blocks.", "profile_detection"),
    )),
)

ESD = ("human-body model", "electrostatic discharge", "esd", "jedec js-001", "ansi/esda/jedec js-001")
STACKED_MEMORY = ("high bandwidth memory", "hbm2", "hbm3", "stacked memory", "memory interface")
PULSE_WIDTH = ("pulse width modulation", "pulse-width modulation")
RADIATION = (
    "single event", "single-event", "single event latch-up", "single-event latch-up", "single event upset", "single-event upset", "radiation", "radiation tolerant",
    "radiation hardened", "rad-hard", "tid", "total ionizing dose", "heavy ion", "latch-up immunity", "see", "space qualified", "space-grade",
)
REGISTER_NAMES = ("register", "bit field", "sysref", "mask", "nco", "status register", "pin name", "signal name", "table column", "control bit")
ECC_MEMORY = ("cache", "tcm", "ram", "nand", "dram", "ddr", "memory", "axi", "coherency", "data integrity", "parity", "error correction", "error-correcting", "error correcting", "onfi", "flash")
ECC_CRYPTO = ("elliptic", "ecdsa", "ecdh", "public key", "private key", "certificate", "signature", "cryptographic", "crypto engine", "key exchange")
COMPARED = ("unlike", "compared with", "compared to", "versus", "other adcs", "traditional adcs", "for example", "or sar adcs", "successive approximation register (sar) adcs")
OWN_DEVICE = ("adc12dj5200rf", "device", "this adc", "the adc", "converter", "the converter", "the device")
EXTERNAL_CLOCK = (
    "external clock", "clock source", "clock frequencies higher than", "clock frequency higher than", "pll support", "jitter cleaner", "synthesizer", "reference design", "sysref",
    "clocking recommendations", "additional device clocks", "clock buffer", "reference clock",
)

#: name, fixed value or empty for the match, category, pattern, context size, words one of which must be near, words none of which may be near, whether all matches count
NEARBY = (
    ("memory_type", "HBM", "compute_processor", r"\b(HBM(?:\d+)?\b|\bhigh bandwidth memory)\b", 120, STACKED_MEMORY, ESD, False),
    ("modulation_feature", "", "rf_microwave", r"\b(modulation|demodulation|upconversion|downconversion|frequency synthesis)\b", 120, (), PULSE_WIDTH, False),
    ("seu_or_sel", "", "environmental_qualification", r"\b(SEU|SEL)\b", 220, RADIATION, REGISTER_NAMES, True),
    ("cryptographic_algorithm", "", "security_cryptography", r"\b(ECC)\b", 140, ECC_CRYPTO, ECC_MEMORY, True),
    ("security_feature", "", "security_cryptography", r"\b(trusted execution|trusted platform|hardware root of trust|key storage|device authentication)\b", 140, (), (), True),
)
ARCHITECTURES = ((r"\bpipeline\b", "pipeline"), (r"\bdelta[- ]sigma\b", "delta-sigma"), (r"\btime-interleaved\b", "time-interleaved"), (r"\bflash ADC\b", "flash ADC"), (r"\bSAR\b", "SAR"))

#: Headings round which a text budget keeps a window, in this order.
HEADINGS = (
    "features", "key features", "electrical characteristics", "recommended operating conditions", "security", "secure boot", "cryptographic", "interfaces", "jesd",
    "pcie", "ethernet", "usb", "displayport", "package", "thermal", "qualification", "radiation", "applications",
)
EXCERPT, CLOSING = "\n\n--- relevant excerpt ---\n\n", "\n\n--- closing excerpt ---\n\n"
LEAST_WINDOW, LEAST_TAIL = 1600, 1000
