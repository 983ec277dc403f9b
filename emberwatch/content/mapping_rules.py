"""Rules from event types and log texts to techniques. Ids, clauses, tactics and confidences are fixed values, in order."""


def _rule(name, when, *techniques, legacy=None):
    return {"id": name, "when": [dict(zip(("field", "op", "values"), w, strict=True)) for w in when], "techniques": [dict(zip(("technique_id", "tactic", "confidence"), t, strict=True)) for t in techniques], "legacy": legacy}


def _type(*values):
    return ("event_type", "contains_any", list(values))


def _text(*values):
    return ("log_text", "contains_any", list(values))


AITM = (("T1557", "credential-access", "medium"), ("T1557.002", "credential-access", "medium"))

RULES = [
    _rule("auth-failure-brute-force", [_type("authentication failure")], ("T1110", "credential-access", "medium")),
    _rule("ssh-accepted-valid-accounts", [("log_text", "contains_all", ["ssh", "accepted"])], ("T1078", "initial-access", "medium"), ("T1021.004", "lateral-movement", "low")),
    _rule("arp-spoofing-event", [_type("arp spoofing")], *AITM),
    _rule("arp-spoofing-log", [_text("arp"), _text("moved from", "spoof", "poison")], *AITM),
    _rule("log-tampering-clear-history", [_type("log tampering")], ("T1070.003", "stealth", "medium")),
    _rule("privileged-group-addition", [_type("privileged group addition")], ("T1098", "privilege-escalation", "medium")),
    _rule("account-creation-local", [_type("account creation")], ("T1136.001", "persistence", "medium")),
    _rule("port-scan-service-discovery", [_type("port scan")], ("T1046", "discovery", "medium")),
    _rule("successful-login-valid-accounts", [("event_type", "equals", ["successful login"])], ("T1078", "initial-access", "medium")),
    _rule("audit-daemon-disabled", [_text("auditd", "audit daemon"), _text("stop", "disabl", "shutting down", "shutdown")], ("T1685", "defense-impairment", "medium")),
    _rule("ransomware-event", [_type("ransomware")], ("T1486", "impact", "high")),
    _rule("ransomware-log-indicators", [_text("ransom note", "ransom_note", "files encrypted", "vssadmin delete shadows")], ("T1486", "impact", "high"), ("T1490", "impact", "high")),
    _rule("extortion-event", [_type("extortion")], ("T1657", "impact", "medium")),
    _rule("extortion-log-double-extortion", [_text("double extortion")], ("T1657", "impact", "medium")),
    _rule("ids-alert-analyst-review", [_type("ids alert")], legacy={"technique_id": "UNKNOWN", "tactic": "Detection-dependent", "confidence": "low"}),
]

FALLBACK = {"technique_id": "UNKNOWN", "tactic": "Unknown", "confidence": "low"}

#: Names of techniques, as far as they are known here. Fixed values.
TECHNIQUE_NAMES = {
    "T1110": "Brute Force",
    "T1078": "Valid Accounts",
    "T1557": "Adversary-in-the-Middle",
    "T1557.002": "ARP Cache Poisoning",
    "T1070.003": "Clear Command History",
    "T1098": "Account Manipulation",
    "T1136.001": "Local Account",
    "T1046": "Network Service Discovery",
    "T1595": "Active Scanning",
}
