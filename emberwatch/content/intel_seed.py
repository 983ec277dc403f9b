"""Synthetic intelligence (documentation addresses and names only). Values, dates and ranges are fixed."""

SOURCES = [
    ("first-party", "own.example", "2026-08-21"),
    ("synthetic-feed-alpha", "feed-alpha.example", "2026-08-14"),
    ("synthetic-feed-bravo", "feed-bravo.example", "2026-08-18"),
]
#: type, value, risk, confidence, source_id, retrieved, expires, reference
ATOMIC = [
    ("ipv4", "203.0.113.66", "malicious", "high", "synthetic-feed-alpha", "2026-08-14", "2026-11-14", "alpha/1"),
    ("ipv4", "203.0.113.66", "malicious", "medium", "synthetic-feed-bravo", "2026-08-18", "2026-11-18", "bravo/1"),
    ("ipv4", "198.51.100.77", "malicious", "high", "synthetic-feed-alpha", "2026-08-14", "2026-11-14", "alpha/2"),
    ("domain", "beacon.invalid", "suspicious", "medium", "synthetic-feed-bravo", "2026-08-18", "2027-02-18", "bravo/2"),
    ("sha256", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa0001", "malicious", "high", "synthetic-feed-alpha", "2026-08-14", "2027-08-14", "alpha/3"),
    ("ipv4", "192.0.2.199", "suspicious", "low", "synthetic-feed-alpha", "2026-02-01", "2026-05-01", "alpha/4"),
]
NEVER_FLAG = ["0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16", "224.0.0.0/4", "255.255.255.255/32", "::1/128", "fc00::/7", "fe80::/10", "ff00::/8"]
#: id, techniques, event types, confidence, last reviewed, review interval in days
BEHAVIORS = [
    ("bhv-ssh-password-spray", ["T1110"], ["authentication failure"], "medium", "2026-08-21", 365),
    ("bhv-shell-history-clearing", ["T1070.003"], ["log tampering"], "high", "2026-08-21", 365),
    ("bhv-persistence-account-chain", ["T1136.001", "T1098"], ["account creation", "privileged group addition"], "medium", "2026-08-21", 365),
    ("bhv-arp-aitm-positioning", ["T1557", "T1557.002"], ["arp spoofing"], "medium", "2026-08-21", 365),
    ("bhv-service-discovery-sweep", ["T1046"], ["port scan"], "medium", "2026-08-21", 365),
]
HALF_LIVES = {"url": 14, "ipv4": 30, "ipv6": 30, "domain": 90, "email": 90, "md5": 365, "sha1": 365, "sha256": 365}
