"""Response actions and which techniques propose them. Ids, tiers, verbs, classes, owners and prerequisites are fixed values."""

#: action_id, tier, verb, class, reversible, destroys evidence, owner, prerequisites
ACTIONS = [
    ("capture-volatile-memory", 0, "collect", "read_only", True, False, "human-analyst", []),
    ("preserve-log-evidence", 0, "collect", "read_only", True, False, "human-analyst", []),
    ("revoke-account-sessions", 2, "revoke", "destructive", True, False, "identity-administrator", ["capture-volatile-memory"]),
    ("isolate-host-network", 2, "isolate", "destructive", True, False, "network-administrator", ["capture-volatile-memory"]),
    ("block-indicator-egress", 2, "block", "destructive", True, False, "network-administrator", []),
    ("reset-account-credentials", 3, "reset", "secret_handling", False, False, "human-identity-administrator", ["revoke-account-sessions"]),
    ("quarantine-suspect-file", 3, "quarantine", "destructive", True, True, "human-endpoint-administrator", ["capture-volatile-memory"]),
    ("terminate-malicious-process", 3, "terminate", "destructive", False, True, "human-endpoint-administrator", ["capture-volatile-memory"]),
]
TECHNIQUE_ACTIONS = {
    "T1110": ["revoke-account-sessions", "reset-account-credentials"],
    "T1078": ["revoke-account-sessions", "reset-account-credentials"],
    "T1021.004": ["revoke-account-sessions"],
    "T1136.001": ["revoke-account-sessions"],
    "T1098": ["revoke-account-sessions", "reset-account-credentials"],
    "T1098.004": ["revoke-account-sessions", "isolate-host-network"],
    "T1053.003": ["isolate-host-network", "quarantine-suspect-file"],
    "T1685": ["preserve-log-evidence", "isolate-host-network"],
    "T1070.003": ["preserve-log-evidence"],
    "T1204.002": ["isolate-host-network", "quarantine-suspect-file"],
    "T1059.001": ["isolate-host-network", "terminate-malicious-process"],
    "T1059.004": ["isolate-host-network", "terminate-malicious-process"],
    "T1620": ["isolate-host-network", "terminate-malicious-process"],
    "T1105": ["block-indicator-egress", "isolate-host-network"],
    "T1557": ["isolate-host-network"],
    "T1557.002": ["isolate-host-network"],
}
ALWAYS = "capture-volatile-memory"

#: Mitigation behind each containment capability, and capabilities that stand for another one. Fixed values.
MITIGATIONS = {
    "quarantine_file": ("M1049", "Antivirus/Antimalware"),
    "stop_process": ("M1040", "Behavior Prevention on Endpoint"),
    "isolate_host": ("M1030", "Network Segmentation"),
    "block_indicator": ("M1037", "Filter Network Traffic"),
    "disable_account": ("M1026", "Privileged Account Management"),
}
ALIASES = {"release_file": "quarantine_file", "resume_process": "stop_process", "stop_process_force": "stop_process", "restore_host": "isolate_host", "unblock_indicator": "block_indicator", "enable_account": "disable_account"}
