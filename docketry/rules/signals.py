"""Signals with their profiles, weight and terms."""

SIGNALS = (
    ("gateway_form", (), 0, ("sensor gateway", "industrial gateway", "edge gateway", "gateway")),
    ("router_form", (), 0, ("router",)),
    ("network_switch_form", (), 0, ("network switch", "ethernet switch")),
    ("server_form_identity", (), 0, ("rack server", "gpu server", "compute server")),
    ("evaluation_kit_form", (), 0, ("evaluation kit", "development kit")),
    ("board_form", (), 0, ("development board", "evaluation board", "circuit board")),
    ("ai_accelerator_identity", ("ai_accelerator", "advanced_computing_hardware"), 8, ("ai accelerator", "accelerator card", "npu", "tpu")),
    ("gpu_identity", ("gpu_accelerator", "advanced_computing_hardware"), 8, ("gpu accelerator", "graphics processing unit", "graphics processing units", "gpu card")),
    ("ai_workload", ("ai_accelerator", "advanced_computing_hardware"), 3, ("inference", "training", "fine-tuning", "server inference")),
    ("compute_rate", ("ai_accelerator", "gpu_accelerator", "advanced_computing_hardware"), 5, ("tops", "tflops", "flops")),
    ("hbm", ("ai_accelerator", "gpu_accelerator", "advanced_computing_hardware", "storage_or_memory_device"), 4, ("high bandwidth memory", "hbm2", "hbm3", "hbm3e")),
    ("high_speed_compute_interconnect", ("advanced_computing_hardware",), 3, ("pcie gen4", "pcie gen5", "pcie 4.0", "pcie 5.0", "high memory bandwidth")),
    ("compute_appliance", ("server_or_compute_appliance", "advanced_computing_hardware"), 7, ("compute appliance", "inference server", "rack server", "gpu server")),
    ("server_form", ("server_or_compute_appliance",), 4, ("server", "appliance", "rackmount", "rack-mount")),
    ("networking", ("networking_hardware", "secure_networking_hardware"), 7, ("smartnic", "network interface card", "network adapter", "ethernet switch", "router", "traffic offload", "packet processing", "ethernet")),
    ("high_speed_ethernet", ("networking_hardware", "secure_networking_hardware"), 4, ("10gbe", "25gbe", "100gbe", "200gbe", "400gbe", "10 gb ethernet", "25 gb ethernet", "100 gb ethernet", "200 gb ethernet", "400 gb ethernet")),
    ("network_security", ("secure_networking_hardware",), 5, ("macsec", "tls offload", "ipsec", "vpn", "encrypted connectivity")),
    ("transport_security", ("secure_networking_hardware",), 2, ("tls offload", "mqtt over tls", "https transport", "tls transport")),
    ("crypto", ("encryption_or_crypto_device",), 8, ("hardware security module", "hsm", "cryptographic module", "cryptographic acceleration", "encryption appliance", "key management device", "secure key vault")),
    ("platform_security", ("firmware_or_security_software",), 2, ("secure boot", "remote attestation", "firmware signing", "signed firmware", "secure enclave", "encrypted bitstream", "bitstream encryption")),
    ("security_software", ("firmware_or_security_software",), 6, ("security firmware", "firmware image", "secure firmware", "software encryption")),
    ("rf", ("rf_microwave_component",), 7, ("rf front-end", "rf front end", "microwave", "mmwave", "power amplifier", "low noise amplifier", "phased array")),
    ("radio", ("radio_wireless_device", "rf_microwave_component"), 6, ("radio transceiver", "wireless transceiver", "wi-fi", "wifi", "bluetooth", "ble", "antenna", "modulation")),
    ("radar", ("rf_microwave_component",), 5, ("radar",)),
    ("frequency", ("rf_microwave_component", "radio_wireless_device"), 2, ("frequency range", "ghz")),
    ("converter_identity", ("adc_dac_converter",), 8, ("analog-to-digital converter", "digital-to-analog converter", "adc", "dac")),
    ("converter_performance", ("adc_dac_converter",), 4, ("gsps", "msps", "enob", "sample rate", "sampling rate", "analog bandwidth")),
    ("fpga", ("fpga_or_pld",), 8, ("fpga", "programmable logic", "logic cells", "luts", "bitstream")),
    ("zynq_mpsoc", ("fpga_programmable_logic_soc",), 10, ("zynq ultrascale+ mpsoc", "zynq mpsoc", "processing system", "pl/ps")),
    ("fpga_io", ("fpga_or_pld",), 3, ("serdes", "high-speed transceivers", "high speed transceivers")),
    ("mcu", ("mcu_or_soc",), 8, ("microcontroller", "embedded soc", "risc-v", "cortex-m")),
    ("soc", ("mcu_or_soc",), 5, ("system-on-chip", "system on chip", "processor core", "arm cortex", "cortex-a53", "cortex-a55", "cortex-a72", "cortex-m0", "cortex-m3", "cortex-m4", "cortex-m7")),
    ("industrial", ("sensor_or_industrial_control",), 7, ("industrial controller", "plc", "inertial measurement", "robotics", "lidar")),
    ("vision", ("camera_or_vision_system", "sensor_or_industrial_control"), 7, ("machine vision", "camera system", "image sensor", "thermal imaging")),
    ("navigation_sensor", ("sensor_or_industrial_control",), 5, ("navigation", "imu", "inertial sensor")),
    ("rugged", ("rugged_special_environment_hardware",), 5, ("radiation tolerant", "radiation hardened", "space qualified", "military grade", "military-grade", "aerospace", "itar")),
    ("extended_environment", ("rugged_special_environment_hardware",), 3, ("rugged", "extended temperature", "mil-std", "do-160")),
    ("storage", ("storage_or_memory_device",), 7, ("storage device", "storage appliance", "solid state drive", "solid state drives", "ssd", "memory module", "flash memory")),
)
