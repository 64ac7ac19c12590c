"""Fixed values of decision records, their checks and the report."""

FORM_SURE, FORM_UNSURE, MOST_CONFIDENCE = 0.9, 0.2, 0.85

COMPONENT_PROFILES = (
    "mcu_or_soc", "fpga_or_pld", "fpga_programmable_logic_soc", "gpu_accelerator", "ai_accelerator", "adc_dac_converter", "rf_microwave_component", "encryption_or_crypto_device",
)
#: signal, capability keys it stands for
CAPABILITY_KEYS = (
    ("network_security", ("network_confidentiality", "link_layer_encryption")),
    ("transport_security", ("transport_security", "cryptographic_offload")),
    ("platform_security", ("platform_integrity",)),
)
UNRESOLVED_KEYS = ("network_confidentiality", "link_layer_encryption", "transport_security", "cryptographic_offload")
NETWORK_CRYPTO_KEYS = ("network_confidentiality", "link_layer_encryption", "transport_security")
#: capability, term in a quote of platform security
INTEGRITY_TERMS = (("secure_boot", "secure boot"), ("firmware_signing", "firmware signing"), ("remote_attestation", "remote attestation"))
NETWORK_FORMS = ("smartnic", "network_interface_card", "networking_card", "router", "network_switch")
IDENTITY_FACTS = ("product_name", "product_family", "part_number", "document_number", "document_type")

NO_TEXT = "current_regulatory_text_unavailable"
LIMITATION = "OFFICIAL_REGULATORY_TEXT_UNAVAILABLE"
LIMITATION_TEXT = "Current official regulatory text was unavailable for this run. No specific ECCN candidate can be elevated until the platform attaches and evaluates applicable current official text."
ABSTENTION = "No review path has sufficient positive source evidence."
OVERRIDDEN = "Canonical product-form resolution separates the exported product from installed components and capabilities."
RECLASSIFIED = "The heuristic profile describes an installed component rather than the complete exported product."
