"""Profile contracts, thresholds, order, paths, candidate codes and missing evidence."""

#: In order of priority, the first the highest.
PROFILES = (
    "unknown", "ai_accelerator", "gpu_accelerator", "advanced_computing_hardware", "server_or_compute_appliance", "networking_hardware",
    "secure_networking_hardware", "encryption_or_crypto_device", "firmware_or_security_software", "fpga_programmable_logic_soc", "fpga_or_pld",
    "mcu_or_soc", "adc_dac_converter", "rf_microwave_component", "radio_wireless_device", "sensor_or_industrial_control",
    "rugged_special_environment_hardware", "camera_or_vision_system", "storage_or_memory_device", "general_electronics",
)

#: profile, signals of which some must be present, signals that must not be absent, how many must be present, least score
CONTRACTS = (
    ("ai_accelerator", ("ai_accelerator_identity",), ("ai_accelerator_identity",), 1, 6),
    ("gpu_accelerator", ("gpu_identity",), (), 1, 6),
    ("advanced_computing_hardware", ("compute_rate", "hbm", "compute_appliance"), (), 1, 7),
    ("server_or_compute_appliance", ("compute_appliance", "server_form"), (), 1, 6),
    ("networking_hardware", ("networking", "high_speed_ethernet"), (), 1, 6),
    ("secure_networking_hardware", ("networking", "high_speed_ethernet", "network_security"), (), 2, 7),
    ("encryption_or_crypto_device", ("crypto",), (), 1, 8),
    ("firmware_or_security_software", ("security_software",), (), 1, 6),
    ("fpga_programmable_logic_soc", ("zynq_mpsoc",), (), 1, 6),
    ("fpga_or_pld", ("fpga",), (), 1, 6),
    ("mcu_or_soc", ("mcu", "soc"), (), 1, 5),
    ("adc_dac_converter", ("converter_identity",), (), 1, 6),
    ("rf_microwave_component", ("rf", "radio", "radar"), (), 1, 6),
    ("radio_wireless_device", ("radio",), (), 1, 6),
    ("sensor_or_industrial_control", ("industrial", "navigation_sensor", "vision"), (), 1, 6),
    ("rugged_special_environment_hardware", ("rugged",), (), 1, 5),
    ("camera_or_vision_system", ("vision",), (), 1, 6),
    ("storage_or_memory_device", ("storage",), (), 1, 6),
    ("general_electronics", (), (), 1, 1),
)

#: Profiles that become primary if they are detected within five points of the first.
SPECIFIC = ("ai_accelerator", "gpu_accelerator", "secure_networking_hardware")
SPECIFIC_GAP = 5
#: Profiles that the programmable system-on-chip profile takes the place of.
SUBSUMED = ("fpga_or_pld", "adc_dac_converter", "networking_hardware")

PATHS = (
    ("ai_accelerator", ("advanced_computing", "category_3_electronics", "category_4_compute_assemblies")),
    ("gpu_accelerator", ("advanced_computing", "category_3_electronics", "category_4_compute_assemblies")),
    ("advanced_computing_hardware", ("advanced_computing", "category_3_electronics", "category_4_compute_assemblies")),
    ("server_or_compute_appliance", ("category_4_compute_assemblies", "advanced_computing")),
    ("networking_hardware", ("networking_telecom", "category_5_part_1")),
    ("secure_networking_hardware", ("networking_telecom", "category_5_part_2_security")),
    ("encryption_or_crypto_device", ("category_5_part_2_security",)),
    ("firmware_or_security_software", ("category_5_part_2_security", "software_security")),
    ("fpga_programmable_logic_soc", ("fpga_programmable_logic_soc", "category_3_electronics")),
    ("fpga_or_pld", ("fpga_programmable_logic", "category_3_electronics")),
    ("mcu_or_soc", ("mcu_soc", "category_3_electronics")),
    ("adc_dac_converter", ("converter", "category_3_electronics")),
    ("rf_microwave_component", ("rf_microwave", "category_3_electronics")),
    ("radio_wireless_device", ("radio_wireless", "category_5_part_1")),
    ("sensor_or_industrial_control", ("sensor_industrial",)),
    ("rugged_special_environment_hardware", ("special_environment",)),
    ("camera_or_vision_system", ("camera_vision",)),
    ("storage_or_memory_device", ("storage_memory", "category_3_electronics")),
    ("general_electronics", ("general_electronics_fallback",)),
)

PATH_TITLES = (
    ("advanced_computing", "Advanced computing review path"),
    ("category_3_electronics", "Category 3 electronics review path"),
    ("category_4_compute_assemblies", "Category 4 computer and electronic assembly review path"),
    ("networking_telecom", "Networking hardware and telecommunications review path"),
    ("category_5_part_1", "Category 5 Part 1 telecommunications review path"),
    ("category_5_part_2_security", "Category 5 Part 2 security and cryptography review path"),
    ("software_security", "Firmware and security software review path"),
    ("fpga_programmable_logic", "FPGA and programmable-logic review path"),
    ("fpga_programmable_logic_soc", "Category 3 electronics / programmable logic / SoC review path"),
    ("mcu_soc", "MCU and embedded SoC review path"),
    ("converter", "ADC/DAC converter review path"),
    ("rf_microwave", "RF and microwave component review path"),
    ("radio_wireless", "Radio and wireless-device review path"),
    ("sensor_industrial", "Sensor and industrial-control review path"),
    ("special_environment", "Special-environment hardware review path"),
    ("camera_vision", "Camera and machine-vision review path"),
    ("storage_memory", "Storage and memory-device review path"),
    ("general_electronics_fallback", "General electronics fallback review path"),
)

#: path, position, code; the general fallback's broad code is never emitted.
CANDIDATES = (
    ("advanced_computing", 0, "3A090"),
    ("advanced_computing", 1, "4A090"),
    ("category_5_part_2_security", 0, "5A002"),
    ("converter", 0, "3A001"),
    ("fpga_programmable_logic", 0, "3A001"),
    ("fpga_programmable_logic_soc", 0, "3A001"),
    ("rf_microwave", 0, "3A001"),
    ("networking_telecom", 0, "5A991"),
)

MISSING = (
    ("ai_accelerator", (
        "Current advanced-computing threshold mapping for the exported configuration.",
        "Memory bandwidth and interconnect bandwidth, where relevant.",
        "Whether the export is an IC, card, module, server, appliance, or complete system.",
        "Whether the product contains separately controlled integrated circuits.",
        "Firmware, signing, attestation, and other security-feature details.",
        "Destination and end-use context where required by the review workflow.",
    )),
    ("networking_hardware", (
        "Supported encryption algorithms and key lengths.",
        "Key-management behavior and whether cryptography is user-accessible.",
        "Whether secure boot is authentication-only or protects data confidentiality.",
        "MACsec, TLS, IPsec, and VPN support in the exported configuration.",
    )),
    ("encryption_or_crypto_device", (
        "Supported algorithms, key lengths, and cryptographic modes.",
        "Key generation, storage, import, export, and management behavior.",
        "Whether cryptographic functions are user-accessible or limited to authentication/boot.",
        "Mass-market or other applicable treatment analysis by a qualified reviewer.",
    )),
    ("rf_microwave_component", (
        "Operating frequency range, output power, bandwidth, and modulation.",
        "Radar, military, aerospace, or other specialized intended use.",
        "Operating-temperature range and qualification standards.",
    )),
    ("adc_dac_converter", (
        "Sampling rate, resolution, analog bandwidth, channel count, and ENOB.",
        "Radiation, military, or aerospace qualification details.",
    )),
    ("fpga_or_pld", (
        "Logic density, LUT or logic-cell count, and transceiver/SERDES performance.",
        "Bitstream encryption, authentication, and key-storage behavior.",
        "Rugged, military, radiation, or space-qualified variants.",
    )),
    ("rugged_special_environment_hardware", (
        "Radiation tolerance, total-ionizing-dose, and single-event specifications.",
        "Space, military, aerospace, or extended-temperature qualification standards.",
        "Intended end use and exact qualified product configuration.",
    )),
    ("sensor_or_industrial_control", (
        "Sensor performance envelope, navigation capability, and intended industrial use.",
        "Military, aerospace, radiation, or special-environment qualification.",
    )),
    ("general_electronics", (
        "Technical details needed to exclude narrower product-specific review paths.",
    )),
)
