"""Fixed values of the earlier rule stage and of the questions put to a tenant's history."""

CORE_FACTS = ("adc_resolution", "sample_rate", "single_channel_sample_rate", "dual_channel_sample_rate", "input_bandwidth", "usable_input_frequency_range", "jesd_interface", "serial_lane_rate")
CONVERTER_WORDS = ("adc", "dac", "converter")
SOC_FACTS = (
    "product_profile", "product_family", "device_type", "processor_architecture", "cpu_core", "clock_speed", "cpu_clock_speed", "realtime_cpu", "cpu_core_count", "cache_tcm", "on_chip_ram",
    "memory_cache", "memory_integrity", "memory_controller_interface", "external_memory_interface", "external_memory_interfaces", "programmable_logic", "processing_system", "ps_pl_integration",
    "ethernet_mac", "pcie_interface", "displayport_lane_rate", "gpu", "usb_interface", "can_interface", "spi_interface", "i2c_interface", "uart_interface", "jtag_interface", "displayport_interface",
    "digital_interface", "display_camera_interface", "camera_interface", "display_interface", "audio_interface", "secure_boot", "cryptographic_algorithm", "crypto_key_size", "peripheral_adc", "peripheral_dac", "package_type",
)
SOC_CATEGORIES = ("processing_system_cpu", "compute_processor", "memory_cache_integrity", "digital_interface")
SECURITY_FACTS = (
    "secure_boot", "cryptographic_algorithm", "crypto_key_size", "security_feature", "key_storage", "secure_element", "tamper_resistance", "certificate_signature", "caam", "pkha", "symmetric_engine",
    "cryptographic_hash_engine", "rng4", "secure_key_management", "inline_encryption_engine", "otfad", "snvs", "zero_master_key", "puf", "encrypted_boot",
)
SECURITY_CATEGORIES = ("security_cryptography", "security", "cryptography")
SECURITY_WORDS = (
    "secure boot", "hab", "encrypted boot", "caam", "pkha", "symmetric", "cryptographic hash", "rng4", "key management", "otfad", "snvs", "zmk", "puf", "aes", "rsa", "sha", "key storage", "certificate", "signature", "hsm", "tpm",
)
RF_FACTS = (
    "rf_frequency_range", "frequency_range", "rx_channels", "tx_channels", "rf_bandwidth", "bandwidth", "lo_pll_synthesizer", "baseband_interface", "sdr_application", "radar_application",
    "communications_application", "adc_subcomponent", "dac_subcomponent",
)
GENERIC_FACTS = ("product_family", "product_profile", "device_type", "digital_interface", "jesd_interface", "pcie_interface", "ethernet_mac", "usb_interface", "clock_speed", "package_type", "power_consumption")
#: Facts that make a path's confidence medium.
MANY_SOC, MANY_RF = 6, 4

#: One bit of a document's mask for each kind of fact it has.
BITS = (
    "fpga_profile", "mcu_profile", "rf_profile", "crypto_profile", "generic_profile", "core", "converter", "soc_fact", "rf_fact", "generic_fact", "security_fact", "security_named",
    "environment", "application", "security_group", "digital",
)
#: code, path, bits all of which, one of which (if any are named), none of which a document has, what the confidence goes by
STAGE = (
    ("Category 3", "category_3_mcu_processor_soc", ("mcu_profile", "soc_fact"), (), (), "soc"),
    ("Category 3", "category_3_programmable_logic_soc", ("fpga_profile", "soc_fact"), (), ("mcu_profile",), "soc"),
    ("Category 3", "category_3_rf_transceiver", ("rf_profile", "rf_fact"), (), (), "rf"),
    ("Category 5 Part 2", "category_5_part_2_crypto_security_device", ("crypto_profile", "security_fact"), (), (), "medium"),
    ("Category 5 Part 2", "category_5_part_2_security", ("security_fact", "security_named"), (), ("crypto_profile",), "medium"),
    ("3A001", "category_3_high_speed_converter", ("core", "converter"), (), (), "medium"),
    ("Category 3", "category_3_generic_electronics", (), ("generic_profile", "generic_fact"), ("fpga_profile", "mcu_profile", "rf_profile", "crypto_profile"), "low"),
    ("3A991", "general_electronics_comparison", (), (), (), "low"),
    ("EAR99", "ear99_possible_outcome", (), (), ("environment", "application", "security_group", "soc_fact", "generic_fact", "digital"), "low"),
)
#: These paths are closed to documents that are mainly about a converter.
NOT_FOR_CONVERTERS = ("category_3_generic_electronics", "ear99_possible_outcome")

IDENTIFIERS = ("part_number", "product_name", "manufacturer", "model", "sku")
GENERATED = ("product_profile", "profile_confidence", "profile_rationale", "secondary_product_profile")
FAMILY = "(?:^|_)product_family$"
#: In the order of the question: performance, memory, interfaces, security.
VALUE_GROUPS = ("performance|tops|tflops|throughput|compute", "memory|hbm|cache", "interface|pcie|interconnect|io$", "security|crypto|encryption|firmware|attestation|boot")
TECHNICAL = "accelerator|hbm|pcie|tops|tflops|performance|firmware|attestation|security|processor|radio|wireless|ethernet|memory|sensor|fpga|encryption"
FALLBACK_TERMS = 24
