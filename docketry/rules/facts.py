"""Fact patterns, categories, capability rules, markers and qualifiers."""

#: name, value, category, confidence, pattern (without case); the first match of each counts.
FACTS = (
    ("cpu_core", "Arm Cortex-A53", "processing_system_cpu", "high", r"\bArm\s+Cortex-A53\b|\bCortex-A53\b"),
    ("cpu_core", "Arm Cortex-M7", "processing_system_cpu", "high", r"\bArm\s+Cortex-?M7\b|\bCortex-?M7\b"),
    ("cpu_core", "Arm Cortex-M4", "processing_system_cpu", "high", r"\bArm\s+Cortex-?M4\b|\bCortex-?M4\b"),
    ("clock_speed", "Cortex-M7 up to 800 MHz", "processing_system_cpu", "high", r"\b(?:Cortex-?M7|M7\s+core)[^.\n]{0,120}\b800\s*MHz\b|\b800\s*MHz\b[^.\n]{0,120}\b(?:Cortex-?M7|M7\s+core)\b"),
    ("clock_speed", "Cortex-M4 up to 400 MHz", "processing_system_cpu", "high", r"\b(?:Cortex-?M4|M4\s+core)[^.\n]{0,120}\b400\s*MHz\b|\b400\s*MHz\b[^.\n]{0,120}\b(?:Cortex-?M4|M4\s+core)\b"),
    ("cpu_core_count", "quad-core Cortex-A53", "processing_system_cpu", "high", r"\bquad-core\b[^.\n]{0,80}\bCortex-A53\b|\bCortex-A53\b[^.\n]{0,80}\bquad-core\b"),
    ("cpu_core_count", "dual-core Cortex-A53", "processing_system_cpu", "medium", r"\bdual-core\b[^.\n]{0,80}\bCortex-A53\b|\bCortex-A53\b[^.\n]{0,80}\bdual-core\b"),
    ("realtime_cpu", "dual-core Arm Cortex-R5F", "processing_system_cpu", "high", r"\bArm\s+Cortex-R5F\b|\bCortex-R5F\b"),
    ("gpu", "Arm Mali-400", "processing_system_cpu", "medium", r"\bMali-400\b"),
    ("cache_tcm", "TCM/cache present", "processing_system_cpu", "medium", r"\b128\s*KB\s+TCM\b|\bTCM\b"),
    ("on_chip_ram", "2 MB on-chip RAM", "processing_system_cpu", "high", r"\b2\s*MB\s+on-chip\s+RAM\b|\bOn-chip\s+RAM\s*\(2\s*MB\s+in\s+total\)"),
    ("ps_pl_integration", "PS/PL integration", "programmable_logic_fpga", "medium", r"\bPS\s*/\s*PL\b|\bPS/PL\b|\bprogrammable logic\b[^.\n]{0,120}\bprocessing\b|\bprocessing\b[^.\n]{0,120}\bprogrammable logic\b"),
    ("ethernet_mac", "Four 10/100/1000 tri-speed Ethernet MAC", "digital_interface", "high", r"\bFour\s+10/100/1000\s+tri-speed\s+Ethernet\s+MAC\b|\bEthernet\s+MAC\b"),
    ("ethernet_mac", "Ethernet controllers", "digital_interface", "high", r"\b10M/100M\s+Ethernet\s+controller\b|\bGigabit\s+Ethernet\s+controller\b|\bEthernet\s+Controller\b"),
    ("pcie_interface", "PCIe", "digital_interface", "high", r"\bPCI\s+Express\b|\bPCIe\b"),
    ("usb_interface", "USB 2.0", "digital_interface", "medium", r"\bUSB\s*2\.0\b|\bUSB\b"),
    ("can_interface", "CAN", "digital_interface", "medium", r"\bCAN\b"),
    ("spi_interface", "SPI", "digital_interface", "medium", r"\bSPI\b"),
    ("i2c_interface", "I2C", "digital_interface", "medium", r"\bI2C\b|I\s*2\s*C"),
    ("uart_interface", "UART", "digital_interface", "medium", r"\bUART\b"),
    ("jtag_interface", "JTAG", "digital_interface", "medium", r"\bJTAG\b"),
    ("displayport_interface", "DisplayPort", "digital_interface", "high", r"\bDisplayPort\b"),
    ("camera_interface", "MIPI CSI / camera interface", "digital_interface", "medium", r"\bMIPI\s+CSI\b|\bParallel\s+Camera\s+Sensor\s+Interface\b|\bcamera interface\b"),
    ("display_interface", "LCD / MIPI DSI display interface", "digital_interface", "medium", r"\bMIPI\s+DSI\b|\bLCD\s+display\b|\bParallel\s+RGB\s+LCD\b|\bLCD interface\b"),
    ("audio_interface", "SPDIF / I2S audio interface", "digital_interface", "medium", r"\bSPDIF\b|\bI2S\s+audio\b|\baudio interface\b"),
    ("memory_controller_interface", "NAND/eMMC/SD memory interface", "digital_interface", "medium", r"\bNAND\b|\beMMC\b|\bSD\b"),
    ("secure_boot", "High Assurance Boot (HAB)", "security_cryptography", "high", r"\bHigh\s+Assurance\s+Boot\s+\(HAB\)|\bHAB\b"),
    ("encrypted_boot", "Encrypted Boot", "security_cryptography", "high", r"\bEncrypted\s+Boot\b"),
    ("caam", "Cryptographic Acceleration and Assurance (CAAM)", "security_cryptography", "high", r"\bCryptographic\s+Acceleration\s+and\s+Assurance\s+\(CAAM\)\b|\bCAAM\b"),
    ("pkha", "Public Key Cryptography Engine (PKHA)", "security_cryptography", "high", r"\bPublic\s+Key\s+Cryptography\s+Engine\s+\(PKHA\)\b|\bPKHA\b"),
    ("symmetric_engine", "Symmetric engines", "security_cryptography", "high", r"\bSymmetric\s+Engines?\b|\bAES-128/256\b|\bDES/3DES\b"),
    ("cryptographic_hash_engine", "Cryptographic hash engine", "security_cryptography", "high", r"\bCryptographic\s+Hash\s+Engine\b|\bSHA-2\b"),
    ("rng4", "Random Number Generation (RNG4)", "security_cryptography", "high", r"\bRandom\s+Number\s+Generation\s+\(RNG4\)\b|\bRNG4\b"),
    ("secure_key_management", "Secure hardware-only cryptographic key management", "security_cryptography", "high", r"\bSecure\s+Hardware-Only\s+Cryptographic\s+Key\s+Management\b|\bkey\s+management\b"),
    ("inline_encryption_engine", "Inline Encryption Engine (IEE)", "security_cryptography", "high", r"\bInline\s+Encryption\s+Engine\b|\bIEE\b"),
    ("snvs", "Secure Non-Volatile Storage (SNVS)", "security_cryptography", "high", r"\bSecure\s+Non-Volatile\s+Storage\s+\(SNVS\)\b|\bSNVS\b"),
    ("zero_master_key", "Zero Master Key (ZMK)", "security_cryptography", "high", r"\bZero\s+Master\s+Key\b|\bZMK\b"),
    ("puf", "Physical Unclonable Function (PUF)", "security_cryptography", "high", r"\bPhysical\s+Unclonable\s+Function\s+\(PUF\)\b|\bPUF\b"),
    ("secure_boot", "secure and non-secure boot", "security_cryptography", "high", r"\bsecure\s+and\s+non-secure\s+boot\b|\bsecure boot\b"),
    ("cryptographic_algorithm", "AES-GCM", "security_cryptography", "high", r"\b256-bit\s+AES-GCM\b|\bAES-GCM\b"),
    ("crypto_key_size", "256-bit", "security_cryptography", "high", r"\b256-bit\s+AES-GCM\b"),
    ("cryptographic_algorithm", "SHA-3/384", "security_cryptography", "high", r"\bSHA-3/384\b"),
    ("cryptographic_algorithm", "RSA 4096", "security_cryptography", "high", r"\b4096-bit\s+RSA\b|\bRSA\s*4096\b"),
    ("gpio", "GPIO", "peripheral_functions", "medium", r"\bGPIO\b"),
    ("system_monitor", "system monitor", "peripheral_functions", "medium", r"\bSystem Monitor\b"),
    ("timer", "timer", "peripheral_functions", "medium", r"\btimer\b"),
    ("watchdog", "watchdog", "peripheral_functions", "medium", r"\bwatchdog\b"),
    ("digital_interface", "Ethernet", "digital_interface", "low", r"\bEthernet\b"),
    ("digital_interface", "PCIe", "digital_interface", "low", r"\bPCIe\b"),
    ("digital_interface", "I2C", "digital_interface", "low", r"\bI2C\b"),
    ("digital_interface", "UART", "digital_interface", "low", r"\bUART\b"),
)

#: Interface facts of one family: the specific names and the generic value that they make needless.
FAMILIES = (
    ("ethernet_mac", "ethernet"), ("pcie_interface", "pcie"), ("i2c_interface", "i2c"), ("uart_interface", "uart"), ("jtag_interface", "jtag"),
    ("displayport_interface", "displayport"), ("displayport_lane_rate", "displayport"),
)

#: name, pattern with qualifier, value and unit as groups 1 to 3, category.
_QUALIFIER = r"(?:(up to|greater than|less than|>|<|typical|maximum|minimum)\s*)?"
MEASURES = (
    ("sample_rate", _QUALIFIER + r"(\d+(?:\.\d+)?)\s*([GMK]SPS)\b", "converter_performance"),
    ("serial_lane_rate", _QUALIFIER + r"(\d+(?:\.\d+)?)\s*(Gbps)\b", "digital_interface"),
    ("clock_frequency", _QUALIFIER + r"(\d+(?:\.\d+)?)\s*([GMK]Hz)\b", "processing_system_cpu"),
    ("process_node", _QUALIFIER + r"(\d+(?:\.\d+)?)\s*(nm)\b", "packaging_lifecycle"),
)
QUALIFIERS = (
    ("up to", "up to"), ("greater than", ">"), ("more than", ">"), ("less than", "<"), ("no more than", "<="), ("no less than", ">="), ("at least", ">="),
    ("minimum", "minimum"), ("maximum", "maximum"), ("typical", "typical"), (">", ">"), ("<", "<"),
)

CATEGORIES = (
    ("product_identity", "Product identity"), ("profile_detection", "Profile detection"), ("processing_system_cpu", "Processing system / CPU"),
    ("programmable_logic_fpga", "Programmable logic / FPGA fabric"), ("converter_performance", "Converter/performance specs"),
    ("digital_interface", "Digital interfaces / high-speed I/O"), ("rf_microwave", "RF/input-frequency specs"), ("application_context", "Application/context language"),
    ("compute_processor", "Compute/processor specs"), ("security_cryptography", "Security/cryptography indicators"), ("memory_cache_integrity", "Memory/cache integrity"),
    ("peripheral_functions", "Peripheral functions"), ("environmental_qualification", "Environmental/qualification specs"), ("packaging_lifecycle", "Power/package specs"),
)
REVIEW_GROUPS = (
    ("converter_performance", "high_speed_data_converter_facts"), ("digital_interface", "high_speed_digital_interface_facts"), ("rf_microwave", "rf_microwave_facts"),
    ("application_context", "application_context_facts"), ("compute_processor", "compute_processor_facts"), ("processing_system_cpu", "compute_processor_facts"),
    ("programmable_logic_fpga", "compute_processor_facts"), ("memory_cache_integrity", "compute_processor_facts"), ("peripheral_functions", "compute_processor_facts"),
    ("security_cryptography", "cryptography_security_facts"), ("environmental_qualification", "radiation_space_military_facts"),
    ("product_identity", "fallback_general_electronics_facts"), ("packaging_lifecycle", "fallback_general_electronics_facts"),
)
FALLBACK_GROUP = "fallback_general_electronics_facts"

#: name -> label, where the title-cased name is not the label.
LABELS = (
    ("product_profile", "Detected Product Profile"), ("is_family_overview", "Family Overview"), ("cpu_core", "CPU Core"), ("cpu_core_count", "Core Count"),
    ("clock_speed", "CPU Clock Speed"), ("realtime_cpu", "Real-Time CPU"), ("gpu", "GPU"), ("cache_tcm", "Cache / TCM"), ("on_chip_ram", "On-chip RAM"),
    ("memory_integrity", "Memory/Cache Integrity"), ("ps_pl_integration", "PS/PL Integration"),
)

#: key, fact names, tokens
CAPABILITIES = (
    ("hasCryptography", ("cryptographic_algorithm", "caam", "pkha", "symmetric_engine", "cryptographic_hash_engine", "rng4", "secure_key_management", "inline_encryption_engine", "otfad", "puf"), ("crypto", "cryptograph", "aes", "rsa", "sha", "ecc", "hsm", "tpm", "puf")),
    ("hasEncryption", ("cryptographic_algorithm", "inline_encryption_engine", "encrypted_boot", "otfad"), ("encrypt", "aes", "gcm", "cbc", "ctr")),
    ("hasDecryption", ("otfad", "encrypted_boot", "inline_encryption_engine"), ("decrypt", "decryption", "counter-mode")),
    ("hasKeyManagement", ("secure_key_management", "key_storage", "zero_master_key", "snvs"), ("key management", "key derivation", "key wrapping", "key storage", "secure key")),
    ("hasCryptographicAccelerator", ("caam", "pkha", "symmetric_engine", "cryptographic_hash_engine", "inline_encryption_engine"), ("accelerator", "engine", "caam", "pkha")),
    ("hasSecureBoot", ("secure_boot", "encrypted_boot"), ("secure boot", "encrypted boot")),
    ("hasTrustedExecution", ("security_feature",), ("trusted execution", "trusted enclave", "tee", "secure enclave")),
    ("hasSecureKeyStorage", ("key_storage", "secure_key_management", "snvs", "zero_master_key"), ("secure key storage", "hardware-only key", "snvs", "zero master key")),
    ("hasHardwareSecurityModule", ("security_feature", "secure_element"), ("hsm", "hardware security module", "secure element", "tpm")),
    ("hasAuthenticationSecurityFeatures", ("secure_boot", "security_feature", "certificate_signature"), ("authentication", "signature", "certificate", "attestation", "secure debug")),
    ("hasHighSpeedInterfaces", ("pcie_interface", "displayport_interface", "displayport_lane_rate", "jesd_interface", "serial_lane_rate", "ethernet_mac"), ("pcie", "displayport", "jesd", "gbps", "ethernet")),
    ("hasProgrammableLogic", ("programmable_logic", "ps_pl_integration"), ("programmable logic", "fpga", "pl fabric")),
    ("hasAdvancedProcessor", ("cpu_core", "processor_architecture", "realtime_cpu", "processing_system"), ("cortex", "processor", "soc", "mpsoc", "64-bit", "quad-core")),
    ("hasRFOrWirelessCapability", ("rf_frequency_range", "frequency_range", "rf_bandwidth", "communications_application"), ("rf", "wireless", "transceiver", "radar", "radio")),
)

ECC_MEMORY = ("cache", "tcm", "ram", "nand", "dram", "ddr", "memory", "axi", "coherency", "data integrity", "parity", "error correction", "error-correcting", "error correcting", "onfi", "flash")
ECC_CRYPTO = ("elliptic", "ecdsa", "ecdh", "public key", "private key", "certificate", "signature", "cryptographic", "crypto engine", "key exchange")
PROVIDER_ECC = ("elliptic", "ecdsa", "ecdh", "public key", "signature", "certificate", "cryptographic", "key exchange")

PLATFORM_SECURITY = ("secure boot", "remote attestation", "firmware signing", "signed firmware", "secure enclave", "encrypted bitstream", "bitstream encryption")

IDENTIFIER = r"(?i)\b(?:part\s*(?:number|no\.?|#)|model|sku|ordering\s*code|device)\s*[:#-]?\s*([A-Z0-9][A-Z0-9_.-]{2,48})"
HISTORY_CODE = r"\b[0-9][A-E][0-9]{3}(?:\.[A-Za-z0-9]+|[A-Za-z0-9]*)\b"
MOST_MARKERS = 20

#: profile, confidence, words of names and values: the first that fits
DEFAULT_PROFILES = (
    ("adc_dac_converter", "medium", ("analog-to-digital converter", "digital-to-analog converter", " adc", " dac", "rf-sampling")),
    ("fpga_programmable_logic_soc", "medium", ("zynq", "mpsoc", "programmable logic", "fpga")),
    ("rf_transceiver", "low", ("rf transceiver", "receiver", "transmitter")),
)

MANUFACTURERS = (
    "Texas Instruments", "Analog Devices", "ADI", "Intel", "AMD", "Xilinx", "NXP", "Microchip", "Renesas", "Infineon", "onsemi", "STMicroelectronics",
    "Qorvo", "Skyworks", "Broadcom", "Lattice", "Teledyne", "Marvell", "Semtech", "Maxim Integrated",
)
MAKER_BOILERPLATE = (
    "creating an environment where employees", "removing noninclusive language", "consequential damages", "expressly advised", "warranty", "liability", "terms and conditions",
)
MAKER_SHEET = ("zynq ultrascale+ mpsoc", "product specification", "data sheet", "datasheet")
MAKER_NOTICE = ("copyright", "©", "(c)", "xilinx, inc", "advanced micro devices")
MAKER_SPELLING = (("xilinx", "Xilinx"), ("amd", "AMD"))
MAKER_TOP, MAKER_EARLY, MAKER_AROUND, MAKER_SURE = 2500, 3000, 220, 20
REVISION = r"\bJESD204([ABC])?\b"
REVISION_NOTE = r"(?im)^.*(?:jesd204b|jesd204a).*(?:compatible|receiver|subclass).*$"
REVISION_AROUND = 180
PROFILE_FACTS = ("product_profile", "profile_confidence", "profile_rationale", "secondary_product_profile")
PROFILE_SNIPPET = "Detected from normalized technical facts and source text."
