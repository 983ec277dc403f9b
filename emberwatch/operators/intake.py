"""Text intake: titles, categories, tags, topics, tasks, as projections over a text column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of, bound, sentences, shortened, slug, squeezed, stripped

#: Category of the first set that has a word in the text. Fixed values, in order.
CATEGORIES = {
    "mitre": ["mitre", "att&ck", "attack", "tactic", "technique", "adversary"],
    "owasp": ["owasp", "injection", "xss", "web application", "broken access"],
    "nist": ["nist", "csf", "cybersecurity framework", "govern", "identify"],
    "cis": ["cis", "controls", "safeguard", "benchmark"],
    "security-plus": ["security+", "comptia", "exam", "certification", "domain"],
    "cybersecurity": ["soc", "incident", "detection", "log", "alert", "triage", "siem"],
}
#: All topics that have a word in the text. Fixed values, in order.
TOPICS = {
    "data protection / privacy": ["privacy", "gdpr", "ccpa", "personal data", "pii", "data breach", "consent"],
    "contracts": ["contract", "agreement", "nda", "breach of contract", "clause", "terms"],
    "employment / labor": ["employment", "employee", "termination", "harassment", "wage", "labor"],
    "intellectual property": ["copyright", "trademark", "patent", "infringement", "license", "trade secret"],
    "regulatory / compliance": ["regulation", "compliance", "regulator", "audit", "sanction", "license"],
    "litigation / dispute": ["lawsuit", "litigation", "subpoena", "court", "complaint", "dispute", "claim"],
}
#: All areas of work that have a word in the text. Fixed values, in order.
SCOPES = {
    "security operations": ["security", "soc", "siem", "threat", "incident", "detection", "log"],
    "knowledge / RAG": ["rag", "knowledge", "retrieval", "embedding", "search", "corpus"],
    "agent automation": ["agent", "automation", "workflow", "orchestration", "pipeline"],
    "compliance / governance": ["compliance", "governance", "audit", "policy", "nist", "cis", "iso"],
}
#: Words of time pressure or dispute. Fixed values.
RISK_TERMS = ["subpoena", "lawsuit", "litigation", "court", "deadline", "statute of limitations", "regulator", "breach", "sanction", "complaint", "summons", "injunction"]
#: Words of a task's priority, of a task that waits, and words that are no tags. Fixed values.
HIGH = ["urgent", "asap", "critical", "deadline", "today", "now", "blocker", "blocked", "immediately"]
LOW = ["someday", "later", "eventually", "nice to have", "optional", "backlog", "low priority"]
BLOCKERS = ["blocker", "blocked", "waiting on", "depends on"]
TAG_STOPWORDS = ["the", "and", "for", "with", "that", "this", "from", "are", "was", "were", "has", "have", "may", "any", "into", "use", "used", "uses", "per", "via", "not", "you", "your", "our", "their", "its", "can", "will", "they", "them", "but", "all", "also", "such", "which", "when", "then", "than", "what"]
UNSORTED, UNSCOPED = "general / unclassified", "general engagement"
#: What a person should look up for each topic.
CHECKLISTS = {
    "data protection / privacy": ["Which privacy regimes apply?", "Who has to be told of a breach, and by when?", "What do the data-processing contracts ask for?"],
    "contracts": ["Which law governs the contract?", "Which notice and cure periods run?", "How is liability limited?"],
    "employment / labor": ["Which labour law applies at the place of work?", "Which filings come first, and by when?", "What do handbook and contract say?"],
    "intellectual property": ["Which rights are touched, and are they registered?", "Who owns and who licenses them?", "Which deadlines run?"],
    "regulatory / compliance": ["Which regulators are competent?", "What has to be reported or kept?", "Does an exemption apply?"],
    "litigation / dispute": ["When do the claims expire?", "Which court deadlines run?", "What has to be preserved as evidence?"],
    UNSORTED: ["Which field of law is it?", "Which jurisdiction?", "Which deadlines run?"],
}
#: Items of work of each area.
WORK = {
    "security operations": ["Review the telemetry there is.", "Build and test detections.", "Write the runbooks."],
    "knowledge / RAG": ["Collect the trusted corpus.", "Build and measure the retrieval.", "Bring it into the workflow with citations."],
    "agent automation": ["Draw the workflow and its approvals.", "Build and test the parts.", "Write the operating guide."],
    "compliance / governance": ["Map needs to a control framework.", "Write policies and procedures.", "Set up evidence and audits."],
    UNSCOPED: ["Write down the needs.", "Propose an approach.", "Build it and check it against the criteria."],
}
TAG = "[a-z0-9][a-z0-9+#-]{2,}"


def category(text: Column) -> Column:
    return bound(F.lower(text), lambda t: reduce(lambda c, kv: c.when(any_of(t, kv[1]), kv[0]), CATEGORIES.items(), F.when(F.lit(False), "")).otherwise("general"))


def all_topics(text: Column, rules: dict[str, list[str]] = TOPICS) -> Column:
    return bound(F.lower(text), lambda t: F.array_compact(F.array(*[F.when(any_of(t, words), F.lit(name)) for name, words in rules.items()])))


def checklist(topics: Column, items: dict[str, list[str]]) -> Column:
    """Items of all topics, in order, each once."""
    own = [F.when(F.array_contains(topics, k), F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>")) for k, v in items.items()]
    return F.array_distinct(F.concat(*own))


def _or_else(found: Column, default: str) -> Column:
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


def legal_assessments(docs: DataFrame, text: str = "text", jurisdiction: str | None = None) -> DataFrame:
    """docs whose text isn't blank (null ones go) with inquiry, topics (all that match, else UNSORTED), topic (the first),
    checklist, flags (words of dispute), escalate and jurisdiction: a start for a person, no advice."""
    own = docs.filter(F.length(stripped(F.col(text))) > 0)
    own = own.withColumns({"inquiry": shortened(squeezed(F.col(text)), 200), "topics": _or_else(all_topics(F.col(text)), UNSORTED), "flags": risk_flags(F.col(text))})
    return own.withColumns({"topic": F.get("topics", F.lit(0)), "checklist": checklist(F.col("topics"), CHECKLISTS), "escalate": F.size("flags") > 0, "jurisdiction": F.lit((jurisdiction or "").strip() or "unspecified")})


def objectives(text: Column, top: int = 5) -> Column:
    """The first sentences of eight characters or more, with single blanks; the whole text if there is none."""
    return bound(squeezed(text), lambda t: bound(F.filter(sentences(t), lambda s: F.length(s) >= 8), lambda own: F.when(F.size(own) > 0, F.slice(own, 1, top)).otherwise(F.array(t))))


def proposals(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs whose text isn't blank (null ones go) with proposal_title, objectives, areas (all that match, else UNSCOPED) and scope."""
    own = docs.filter(F.length(stripped(F.col(text))) > 0)
    own = own.withColumns({"proposal_title": F.concat(F.lit("Proposal: "), shortened(squeezed(F.col(text)), 60)), "objectives": objectives(F.col(text)), "areas": _or_else(all_topics(F.col(text), SCOPES), UNSCOPED)})
    return own.withColumn("scope", checklist(F.col("areas"), WORK))


def portfolio(docs: DataFrame, name: str = "name", text: str = "text") -> DataFrame:
    """docs whose name and text aren't blank (null ones go) with draft_file (from the name), draft_summary, and draft (Markdown
    with the title, the summary, and the aims; the rest is left to the author)."""
    own = docs.filter((F.length(stripped(F.col(name))) > 0) & (F.length(stripped(F.col(text))) > 0))
    own = own.withColumns({"draft_file": F.concat(slug(F.col(name)), F.lit(".md")), "draft_summary": summary(F.col(text))})
    aims = F.array_join(F.transform(objectives(F.col(text), 4), lambda s: F.concat(F.lit("- "), s)), "\n")
    return own.withColumn("draft", F.concat(F.lit("# "), stripped(F.col(name)), F.lit("\n\n## Overview\n\n"), F.col("draft_summary"), F.lit("\n\n## Aims\n\n"), aims, F.lit("\n\n## Results\n\nTODO\n")))


def risk_flags(text: Column) -> Column:
    return bound(F.lower(text), lambda t: F.filter(F.array(*map(F.lit, sorted(RISK_TERMS))), lambda w: F.contains(t, w)))


def title(text: Column, limit: int = 80) -> Column:
    """First sentence of the first line that isn't blank, without heading marks and final stop."""
    line = F.get(F.filter(F.split(text, r"\r?\n|\r"), lambda x: F.length(stripped(x)) > 0), F.lit(0))
    plain = stripped(F.regexp_replace(stripped(line), "^#+", ""))
    first = F.regexp_replace(F.coalesce(F.get(sentences(plain), F.lit(0)), plain), "[.!?]+$", "")
    return F.when(F.coalesce(plain, F.lit("")) == "", "Untitled Note").otherwise(shortened(first, limit))


def summary(text: Column, limit: int = 240) -> Column:
    return shortened(F.coalesce(F.get(sentences(squeezed(text)), F.lit(0)), F.lit("")), limit)


def key_points(text: Column, top: int = 5) -> Column:
    """Bulleted lines if there are any, else the first sentences."""
    lines = F.transform(F.split(text, r"\r?\n|\r"), stripped)
    bullets = F.transform(F.filter(lines, lambda x: F.rlike(x, F.lit("^[-*•]"))), lambda x: stripped(F.regexp_replace(x, "^[-*•]+", "")))
    return F.slice(F.when(F.size(bullets) > 0, bullets).otherwise(sentences(squeezed(text))), 1, top)


def tags(docs: DataFrame, key: str, text: str = "text", top: int = 6) -> DataFrame:
    """key, tags: the most frequent tokens of each text, ties by first occurrence; counted within the row."""
    tokens = F.filter(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TAG), F.lit(0)), lambda t: ~t.isin(TAG_STOPWORDS))
    each = docs.select(key, F.posexplode(tokens).alias("pos", "token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"))
    ranked = each.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), "pos", "token"))), 1, top).alias("t"))
    return ranked.select(key, F.transform("t", lambda x: x["token"]).alias("tags"))


def tasks(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, idx, task, priority, is_blocker: lines and parts between semicolons, bullets taken off."""
    own = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "[\n;]+"), lambda x: stripped(F.regexp_replace(stripped(x), "^[-*•]+", "")))
    rows = docs.select(key, F.posexplode(F.filter(own, lambda x: F.length(x) > 0)).alias("idx", "task"))
    t = F.lower("task")
    blocker = any_of(t, BLOCKERS)
    level = F.when(blocker | any_of(t, HIGH), "high").when(any_of(t, LOW), "low").otherwise("medium")
    return rows.withColumns({"priority": level, "is_blocker": blocker})


def planned(rows: DataFrame, key: str) -> DataFrame:
    """tasks in order of priority, then as they came."""
    rank = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
    return rows.withColumn("rank", rank).orderBy(key, "rank", "idx").drop("rank")
