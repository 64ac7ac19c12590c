"""Product forms, canonical paths, requirements and their keywords."""

FORMS = (
    ("smartnic", r"\bsmart\s*nic\b"),
    ("network_interface_card", r"\b(?:network interface card|network adapter|ethernet adapter|nic)\b"),
    ("networking_card", r"\bnetworking\s+card\b"),
    ("evaluation_kit", r"\b(?:evaluation|development)\s+(?:kit|board)\b"),
    ("gateway", r"\bgateway\b"),
    ("router", r"\brouter\b"),
    ("network_switch", r"\b(?:network|ethernet)\s+switch\b"),
    ("server", r"\b(?:rack|gpu|compute)?\s*server\b"),
    ("security_appliance", r"\b(?:security|encryption)\s+appliance\b"),
    ("cryptographic_module", r"\b(?:hardware security module|hsm|cryptographic module|key vault)\b"),
    ("appliance", r"\bappliance\b"),
    ("accelerator_card", r"\baccelerator\s+card\b"),
    ("module", r"\bmodule\b"),
    ("board", r"\bboard\b"),
    ("integrated_circuit", r"\b(?:integrated circuit|microcontroller|system[- ]on[- ]chip|ic)\b"),
)

FORM_PROFILES = (
    ("smartnic", "secure_networking_hardware"), ("network_interface_card", "secure_networking_hardware"), ("networking_card", "secure_networking_hardware"),
    ("gateway", "sensor_gateway"), ("router", "networking_hardware"), ("network_switch", "networking_hardware"), ("server", "server_or_compute_appliance"),
    ("appliance", "server_or_compute_appliance"), ("accelerator_card", "ai_accelerator"), ("cryptographic_module", "encryption_or_crypto_device"),
    ("security_appliance", "encryption_or_crypto_device"), ("evaluation_kit", "evaluation_kit"),
)

CANONICAL = (
    ("advanced_computing", "Advanced computing review path", ("ai_accelerator_identity", "gpu_identity", "compute_rate", "hbm"),
     ("exported product form", "current performance thresholds", "installed accelerator configuration")),
    ("networking_telecom", "Networking and telecommunications review path", ("networking", "high_speed_ethernet"),
     ("exact shipped interface configuration", "telecommunications function")),
    ("category_5_part_2_security", "Security and cryptography review path", ("transport_security", "network_security", "crypto", "platform_security"),
     ("cryptographic implementation", "user accessibility", "key-management behavior", "exact shipped configuration")),
    ("radio_wireless", "Radio and wireless-device review path", ("radio", "frequency"),
     ("populated radio module", "enabled bands and protocols", "regional/export configuration")),
    ("component_electronics", "Installed processor and electronics review path", ("mcu", "soc", "fpga", "converter_identity"),
     ("component part number", "component function in exported product", "exact shipped configuration")),
    ("sensor_industrial", "Sensor and industrial product review path", ("industrial", "navigation_sensor", "vision", "gateway_form"),
     ("exported product function", "deployment/end-use context")),
)

FORM_REQUIREMENTS = (
    ("gateway", ("exact shipped SKU", "wireless module identity", "populated and enabled regional configuration", "cryptographic implementation", "user accessibility", "firmware configuration", "destination/end-use context")),
    ("appliance", ("exact shipped SKU", "network interfaces", "cryptographic implementation", "user accessibility", "firmware configuration", "destination/end-use context")),
    ("board", ("board function", "populated components", "included firmware", "exact ordering code")),
    ("accelerator_card", ("exact ordering code", "installed accelerator configuration", "memory", "performance", "interconnect")),
    ("evaluation_kit", ("included controlled components", "bill of materials", "debug features", "bundled software", "production versus development configuration")),
)

KEYWORDS = (
    ("exported product function", ("gateway", "aggregates", "telemetry", "router", "server", "appliance")),
    ("telecommunications function", ("ethernet", "network", "router", "switch")),
    ("cryptographic implementation", ("aes", "rsa", "algorithm", "cipher")),
    ("user accessibility", ("user-accessible", "customer-configurable", "api")),
    ("key-management behavior", ("key management", "key storage", "key import")),
    ("exact shipped configuration", ("export configuration", "shipped configuration", "production configuration")),
    ("populated radio module", ("radio module", "wifi module", "ble module")),
    ("enabled bands and protocols", ("ghz", "band", "modulation", "protocol")),
    ("regional/export configuration", ("regional sku", "export configuration", "production configuration")),
    ("component function in exported product", ("processor", "controller", "gateway", "board")),
    ("firmware configuration", ("firmware",)),
    ("network interfaces", ("ethernet", "pcie", "wifi", "ble")),
    ("memory", ("memory", "hbm", "ddr")),
    ("performance", ("tops", "tflops", "throughput")),
    ("interconnect", ("pcie", "interconnect")),
)

#: Candidate paths under the name of the canonical path that decides on them.
ALIASES = (
    ("converter", "component_electronics"), ("fpga_programmable_logic", "component_electronics"), ("fpga_programmable_logic_soc", "component_electronics"),
    ("mcu_soc", "component_electronics"), ("category_3_electronics", "component_electronics"), ("rf_microwave", "component_electronics"),
)
