"""Policy over described actions: class by words, decision by class and lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import any_of

#: Words of each class, the first class that has one wins. Fixed values, in order.
CLASS_WORDS = {
    "boundary_crossing": ["exploit", "brute force", "exfiltrate", "ddos", "denial of service", "deploy malware", "weaken control", "disable auth", "bypass control", "attack "],
    "secret_handling": ["secret", "api key", "password", "token", "credential", "private key", ".env", "rotate key"],
    "destructive": ["rm -rf", "delete", "remove", "erase", "shred", "destroy", "drop table", "truncate", "force-push", "force push", "overwrite", "purge", "wipe", "reimage", "format disk", "format the disk", "reformat", "encrypt the", "encrypt all"],
    "deployment": ["deploy", "terraform apply", "kubectl apply", "restart prod", "release to prod"],
    "dependency": ["pip install", "npm install", "add dependency", "poetry add"],
    "external_network": ["http://", "https://", "send email", "publish", "webhook", "upload", "post to", "curl ", "fetch "],
    "containment": [
        "quarantine", "isolate ", "network isolation", "containment", "contain ", "kill process", "kill the process", "kill ransomware", "kill the ransomware", "terminate process", "suspend process", "stop process ", "stop the process",
        "stop ransomware", "stop the ransomware", "stop payload", "shut down payload", "shut down the payload", "shutdown payload", "block indicator", "block ioc", "block c2", "disable account", "disable the account", "disable compromised", "revoke session",
    ],
    "read_only": ["read ", "list ", "analyze", "classify", "summarize", "draft", "report", "retrieve", "scan logs", "review"],
}
ALLOWED, DENIED = ["read_only", "containment"], ["boundary_crossing"]


def action_class(action: Column) -> Column:
    a = F.lower(action)
    return reduce(lambda c, kv: c.when(any_of(a, kv[1]), kv[0]), CLASS_WORDS.items(), F.when(F.lit(False), "")).otherwise("unknown")


def decision(own_class: Column, action: Column, allow: list[str] = (), deny: list[str] = (), policy: dict[str, str] | None = None) -> Column:
    """deny for crossed boundaries whatever the lists say, then the deny list, the allow list, the class.

    policy: decisions of classes in place of the usual ones.
    """
    key = F.lower(F.trim(action))
    return (
        F.when(own_class.isin(DENIED), "deny")
        .when(key.isin([d.strip().lower() for d in deny]), "deny")
        .when(key.isin([a.strip().lower() for a in allow]), "allow")
        .otherwise(reduce(lambda c, kv: c.when(own_class == kv[0], kv[1]), (policy or {}).items(), F.when(F.lit(False), "")).when(own_class.isin(ALLOWED), "allow").otherwise("require_approval"))
    )


def requires_human(decided: Column) -> Column:
    return decided == "require_approval"
