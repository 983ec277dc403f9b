"""Information-theoretic sanitisation of personal data, in DataFrame operations only.

Personal values (e-mail and IP addresses, card and phone numbers) are found by pattern and are the
protected entities. A term close to an entity discloses it as far as the corpus says so: of the
information an entity carries, -ln(settings with it / texts), a term reveals its pointwise mutual
information with it, ln(texts * settings with the term and the entity / (texts with the term * settings with the
entity)). Terms that reveal at least `generalise` of it are generalised to their class, those that
reveal `remove` of it are removed.

What is counted are distinct texts, and of an entity distinct settings: the words around a mention. Copies would
otherwise make any of their words disclose what they hold. A setting is known by the least hashes, by SKETCHES
hash functions, of the pairs of words that follow each other in it, and the number of settings is the least
number of distinct hashes that any of the functions gives; so near copies, which change a few words, count as one.

Defined cases: null text counts as empty; very long texts are read whole; repeated rows and texts
count once in the statistics, and get the same spans each; null ids are ids like any other; an empty
table gives no rows; columns other than doc_id and text are not looked at, but kept by sanitised(),
whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound
from .common import cut, free_names

# Each pattern finds the same as the plain form in its comment, but starts only where a run of its first
# class starts, or the last match ended, so that long runs aren't tried again from each of their places.
#: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
#: [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: [0-9]([\x20-]?[0-9])+
CARD = r"[0-9](?:[ -]?[0-9])++"
#: \+[0-9][\x20().0-9-]+[0-9]
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$"
TERM = r"[\p{L}\p{M}]{3,}"
#: Within matches that are dropped as too long: numbers that stand alone in them, and numbers that end at a mark.
CARD_WITHIN = r"(?<![0-9])(?:[0-9]{16,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])"
PHONE_WITHIN = r"\+[0-9](?:[ ().-]*[0-9]){7,14}(?![0-9])"
KINDS = ("email", "ip", "card", "phone")
CONTEXT, GENERALISE, REMOVE, SUPPORT = 64, 0.6, 0.9, 2
SKETCHES = 8
#: As many rows of terms are broadcast at most; more are joined by sorting.
FEW = 100_000

#: Spans that one fold collects.
WIDTH = 256
#: Of the counts by SKETCHES hash functions, the one (by size) that counts: two of them may take different settings for the same.
COUNTED = 3

_SPAN = "array<struct<start:int,end:int,value:string>>"


def _runs(items: Column) -> Column:
    """An array's items in arrays of WIDTH; folds that copy what they collect run over these."""
    return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / WIDTH).cast("int")), lambda c: F.slice(items, c * WIDTH + 1, F.lit(WIDTH))))


def _placed(found: Column, gaps: Column, base: Column) -> Column:
    """Structs (start, end, value) of matches, given the text between them."""
    steps = F.filter(F.zip_with(found, gaps, lambda m, g: F.struct(F.length(g).alias("gap"), F.length(m).alias("len"), m.alias("value"))), lambda x: x["value"].isNotNull())
    none = F.array().cast(_SPAN)

    def sum_up(acc: Column, run: Column) -> Column:
        size = F.aggregate(run, F.lit(0), lambda n, x: n + x["gap"] + x["len"])
        return F.struct((acc["at"] + size).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def add(acc: Column, x: Column) -> Column:
        a = acc["at"] + x["gap"]
        b = a + x["len"]
        return F.struct(b.alias("at"), F.concat(acc["out"], F.array(F.struct(a.alias("start"), b.alias("end"), x["value"].alias("value")))).alias("out"))

    def place(run: Column, at: Column) -> Column:
        return F.aggregate(run, F.struct(at.alias("at"), none.alias("out")), add, lambda acc: acc["out"])

    first = F.struct(base.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
    spread = lambda runs: F.flatten(F.zip_with(runs, F.aggregate(runs, first, sum_up, lambda acc: acc["out"]), place))
    return F.coalesce(bound(steps, lambda own: bound(_runs(own), spread)), none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(acc: Column, k: Column) -> Column:
        d = F.substring(F.reverse(digits), k, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return (acc + F.when(k % 2 == 0, twice).otherwise(d)).cast("int")

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.rlike(value, F.lit(OCTETS))
    n = F.length(_digits(value))
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(_digits(value))).otherwise(False)
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def _valid_span(span: Column, kind: str) -> Column:
    return _valid(kind, span["value"])


def _each(f, *args):
    """f of one array element and args."""
    return lambda x: f(x, *args)


def _too_long(span: Column, kind: str) -> Column:
    return F.length(_digits(span["value"])) > (19 if kind == "card" else 15)


def _inner(span: Column, kind: str) -> Column:
    """Valid cards or phones inside a match that is too long."""
    pattern = CARD_WITHIN if kind == "card" else PHONE_WITHIN
    return F.filter(_placed(*_split(span["value"], pattern), span["start"]), _each(_valid_span, kind))


def _maybe(kind: str, text: Column) -> Column:
    """A cheap test that all texts with a match pass."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    return F.rlike(text, F.lit(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]" if kind == "ip" else r"[0-9](?:[ -]?[0-9]){15}"))


def _split(text: Column, pattern: str) -> tuple[Column, Column]:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (hash of the text), text, an array of spans per kind: email, ip, card, phone, and
    extra: cards and phones inside matches that are dropped as too long."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    df = df.withColumn("text_key", F.xxhash64("text"))
    for kind, pattern in zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True):
        found, gaps = _split(F.col("text"), pattern)
        df = df.withColumn(f"all_{kind}", F.when(_maybe(kind, F.col("text")), _placed(found, gaps, F.lit(0))).otherwise(F.array().cast(_SPAN)))
        df = df.withColumn(kind, F.filter(f"all_{kind}", _each(_valid_span, kind)))
    within = [F.flatten(F.transform(F.filter(f"all_{k}", _each(_too_long, k)), _each(_inner, k))) for k in ("card", "phone")]
    df = df.withColumn("extra", F.concat(*within)).drop(*[f"all_{k}" for k in KINDS])
    return df


def _near_terms(piece: Column, span: Column, reach: int) -> Column:
    """Structs (start, end, value) of whole words within `reach` characters of a span; piece: what _piece() gives for it."""
    text, lo, size = piece["text"], piece["lo"], piece["size"]
    left = F.substring(text, F.greatest(span["start"] - reach, F.lit(0)) - lo + 1, F.least(span["start"], F.lit(reach)))
    left = F.when(span["start"] > reach, F.regexp_replace(left, r"^[\p{L}\p{M}]+", "")).otherwise(left)
    right = F.substring(text, span["end"] - lo + 1, F.lit(reach))
    right = F.when(span["end"] + reach < size, F.regexp_replace(right, r"[\p{L}\p{M}]++$", "")).otherwise(right)
    near = lambda own, base: bound(own, lambda t: _placed(*_split(t, TERM), base(t)))
    return F.concat(near(left, lambda t: span["start"] - F.length(t)), near(right, lambda t: span["end"]))


def _piece(text: Column, run: Column, size: Column, reach: int) -> Column:
    """The part of a text that holds a run of spans and what is within reach, where it starts, and the text's length."""
    lo = F.greatest(F.get(run, F.lit(0))["start"] - reach, F.lit(0))
    hi = F.element_at(run, -1)["end"] + reach
    return F.struct(F.substring(text, lo + 1, hi - lo).alias("text"), lo.alias("lo"), size.alias("size"))


def _entity(kind: str, value: Column) -> Column:
    own = F.lower(value) if kind == "email" else value if kind == "ip" else _digits(value)
    return F.concat(F.lit(f"{kind}:"), own)


def _mention(span: Column, kind: str, piece: Column, reach: int) -> Column:
    return F.struct(_entity(kind, span["value"]).alias("entity"), _near_terms(piece, span, reach).alias("terms"))


def _mentions_of(kind: str, reach: int) -> Column:
    """Mentions of one kind; the text is cut for runs of spans, and each span looks at its run's piece."""
    of_run = lambda size: lambda run: bound(_piece(F.col("text"), run, size, reach), lambda piece: F.transform(run, _each(_mention, kind, piece, reach)))
    mine = bound(F.length("text"), lambda size: bound(_runs(F.col(kind)), lambda runs: F.flatten(F.transform(runs, of_run(size)))))
    return F.coalesce(mine, F.array().cast(f"array<struct<entity:string,terms:{_SPAN}>>"))


def _with_pairs(m: Column) -> Column:
    """Hashes of the pairs of words that follow each other; one of a single word or of none."""
    terms = m["terms"]
    two = F.transform(terms, lambda t, i: F.xxhash64(F.lower(t["value"]), F.lower(F.get(terms, i + 1)["value"])))
    pairs = F.when(F.size(terms) > 1, F.slice(two, 1, F.size(terms) - 1)).when(F.size(terms) == 1, two).otherwise(F.array(F.lit(0).cast("long")))
    return F.struct(m["entity"].alias("entity"), terms.alias("terms"), pairs.alias("pairs"))


def _with_setting(m: Column) -> Column:
    """The least hash of the pairs by each hash function."""
    least = [F.array_min(F.transform(m["pairs"], _each(F.xxhash64, F.lit(k)))) for k in range(SKETCHES)]
    return F.struct(m["entity"].alias("entity"), m["terms"].alias("terms"), F.array(*least).alias("setting"))


def _mentions(spans: DataFrame, reach: int) -> DataFrame:
    """spans without text, but with mentions array<struct<entity, terms, setting>>: of each entity the terms near it."""
    per_kind = [_mentions_of(k, reach) for k in KINDS]
    return spans.withColumn("mentions", F.transform(F.transform(F.concat(*per_kind), _with_pairs), _with_setting)).drop("text")


def _settings(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, n: distinct settings of each key, at least one. A hash function takes settings for the same that share their least hash,
    so one common pair of words may hide a setting from some; copies but for a word are the same to nearly all."""
    each = rows.select(*keys, F.posexplode("setting").alias("k", "hash")).distinct()
    counts = each.groupBy(*keys, "k").agg(F.count("hash").alias("n")).groupBy(*keys).agg(F.array_sort(F.collect_list("n")).alias("n"))
    return counts.withColumn("n", F.get("n", F.lit(COUNTED - 1)))


def _terms(docs: DataFrame, found: DataFrame) -> DataFrame:
    """term, with_term: distinct texts that hold each term.

    The rows of a text that stands more than once weigh nothing but for one doc_id, whose rows weigh one together; so
    only counts by task are shuffled, and no term is once per text.
    """
    rows = found.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("rows"))
    copied = rows.groupBy("text_key").agg(F.sum("rows").alias("all"), F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id")).alias("least"))
    copied = copied.filter(F.col("all") > 1).select("text_key", F.col("least.doc_id").alias("least"))
    weighed = rows.join(copied, "text_key").select(F.col("doc_id").alias("__d"), F.col("text_key").alias("__t"), F.when(F.col("doc_id").eqNullSafe(F.col("least")), 1 / F.col("rows")).otherwise(0.0).alias("weight"))
    weighed = cut(weighed)
    weighed = F.broadcast(weighed) if weighed.limit(FEW + 1).count() <= FEW else weighed
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    each = each.join(weighed, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("text_key") == F.col("__t")), "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    each = each.filter("weight > 0").select("weight", F.explode(words).alias("term"))
    return each.groupBy("term").agg(F.round(F.sum("weight")).alias("with_term"))


def disclosures(docs: DataFrame, found: DataFrame, *, generalise: float, remove: float, support: int) -> DataFrame:
    """Rows (entity, term, ratio, action): terms that reveal enough of an entity.

    docs: the corpus; found: what _mentions() gives for it. A pair must be seen in `support` distinct settings,
    since any word of a single text, or of its copies, would disclose all that is in it.
    """
    each = found.select(F.explode("mentions").alias("m")).select("m.entity", "m.setting", "m.terms")
    entities = cut(_settings(each.select("entity", "setting"), "entity").filter(F.col("n") >= support).withColumnRenamed("n", "with_entity"))
    near = each.join(entities.select("entity"), "entity").select("entity", "setting", F.explode("terms").alias("t"))
    near = near.select("entity", F.lower("t.value").alias("term"), "setting").distinct()
    pairs = cut(_settings(near, "entity", "term").filter(F.col("n") >= support).withColumnRenamed("n", "both"))
    n = F.lit(found.select("text_key").distinct().count()).cast("double")
    out = pairs.join(entities, "entity").join(_terms(docs, found), "term").filter(F.col("with_entity") < n)
    ratio = F.log(n * F.col("both") / (F.col("with_term") * F.col("with_entity"))) / F.log(n / F.col("with_entity"))
    out = out.select("entity", "term", ratio.alias("ratio")).filter(F.col("ratio") >= generalise)
    return out.withColumn("action", F.when(F.col("ratio") >= remove, "remove").otherwise("generalise"))


def _term_places(text: Column, verdicts: Column) -> Column:
    """Structs (start, end, action) of the words of a text that are in verdicts, a map of lower-case terms to actions."""
    each = F.transform(_placed(*_split(text, TERM), F.lit(0)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.try_element_at(verdicts, F.lower(s["value"])).alias("action")))
    return F.filter(each, lambda s: s["action"].isNotNull())


def _disclosing_places(docs: DataFrame, found: DataFrame, disclosing: DataFrame) -> DataFrame:
    """__d, __t, terms: all places, near or not, of the terms that disclose an entity of the document.

    Words that touch an entity's value are words only once it is cut off, so the terms near entities are looked at as well.
    """
    known = cut(disclosing.select("entity").distinct())
    having = found.select(F.col("doc_id").alias("__d"), F.col("text_key").alias("__t"), F.explode(F.array_distinct(F.col("mentions.entity"))).alias("entity"))
    having = cut(having.join(known, "entity").groupBy("__d", "__t").agg(F.collect_set("entity").alias("entities")))
    # the terms aren't carried along with every entity, and repeated rows weigh once
    terms = found.join(having.drop("entities"), F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("text_key") == F.col("__t"))).groupBy("doc_id", "text_key").agg(F.flatten(F.first("mentions.terms")).alias("near"))
    having = having.join(terms, F.col("__d").eqNullSafe(F.col("doc_id")) & (F.col("__t") == F.col("text_key"))).select("__d", "__t", "entities", "near")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    rows = rows.join(having, rows["doc_id"].eqNullSafe(having["__d"]) & (rows["text_key"] == having["__t"])).select("__d", "__t", "text", "near", "entities")
    rows = cut(rows.dropDuplicates(["__d", "__t"]))
    # entities bring their few terms; a document's words are only looked up
    hits = rows.select("__d", "__t", F.explode("entities").alias("entity")).join(disclosing, "entity").groupBy("__d", "__t", "term").agg(F.max("action").alias("action"))  # remove > generalise
    own = hits.groupBy(F.col("__d").alias("__e"), F.col("__t").alias("__u")).agg(F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("verdicts"))
    rows = rows.join(own, rows["__d"].eqNullSafe(own["__e"]) & (rows["__t"] == own["__u"]))
    near = F.transform("near", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.try_element_at("verdicts", F.lower(t["value"])).alias("action")))
    places = F.concat(_term_places(F.col("text"), F.col("verdicts")), F.filter(near, lambda t: t["action"].isNotNull()))
    return rows.select("__d", "__t", F.array_sort(F.array_distinct(places)).alias("terms"))


def analyse(docs: DataFrame, *, reach: int = CONTEXT, generalise: float = GENERALISE, remove: float = REMOVE, support: int = SUPPORT) -> DataFrame:
    """One row per row of docs: doc_id, text_key, the base spans per kind, extra, and `terms`
    (array of start, end, action): disclosing terms that overlap no other span, by start. Terms within `reach`
    characters of an entity are judged; what discloses it counts anywhere in the documents that hold the entity.
    """
    found = cut(_mentions(base_spans(docs), reach))
    disclosing = cut(disclosures(docs, found, generalise=generalise, remove=remove, support=support))
    own = _disclosing_places(docs, found, disclosing)
    base = found.drop("mentions")
    out = base.join(own, base["doc_id"].eqNullSafe(own["__d"]) & (base["text_key"] == own["__t"]), "left").drop("__d", "__t")
    taken = F.concat(*[F.transform(F.col(k), lambda s: F.struct(s["start"], s["end"])) for k in (*KINDS, "extra")])
    free = F.filter("terms", lambda t: ~F.exists(taken, lambda s: (t["start"] < s["end"]) & (s["start"] < t["end"])))
    return out.withColumn("terms", F.coalesce(free, F.array().cast("array<struct<start:int,end:int,action:string>>")))


def _said(span: Column, kind: str) -> Column:
    return F.concat_ws(":", F.lit(kind), span["start"], span["end"])


def _mark(span: Column, kind: str) -> Column:
    return F.struct(span["start"], span["end"], F.lit(f"[{kind.upper()}]").alias("mark"))


def span_text(kinds: tuple[str, ...]) -> Column:
    """All spans of the kinds as kind:start:end, by kind as listed and then start, comma-joined."""
    said = [F.transform(F.col("terms" if k == "term" else k), _each(_said, k)) for k in kinds]
    return F.array_join(F.concat(*said), ",")


def _class(word: Column) -> Column:
    """What a generalised word is: a name, an acronym or a plain word, by its capitals."""
    first = F.substring(word, 1, 1)
    named = first != F.lower(first)
    return F.when(named & (F.length(word) > 1) & (word == F.upper(word)), "[ACRONYM]").when(named, "[NAME]").otherwise("[WORD]")


def sanitised(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs with text sanitised: base spans become [KIND], generalised terms their class ([NAME],
    [ACRONYM] or [WORD]), removed terms nothing; rows without a span, and null texts, stay as they are.

    Only rows with something to replace are joined by id and text; the columns are those of docs, whatever they
    are called. Repeated rows are changed alike; an empty table gives no rows; very long texts are read whole.
    """
    d, t, m = free_names(docs, "d", "t", "m")
    spans = analyse(docs, **how)
    marks = [F.transform(F.col(k), _each(_mark, k)) for k in KINDS]
    number = lambda s: F.when(F.startswith(s["value"], F.lit("+")), "[PHONE]").otherwise("[CARD]")
    marks.append(F.transform("extra", lambda s: F.struct(s["start"], s["end"], number(s).alias("mark"))))
    marks.append(F.transform("terms", lambda s: F.struct(s["start"], s["end"], F.when(s["action"] == "remove", "").alias("mark"))))
    changes = spans.select(F.col("doc_id").alias(d), F.col("text_key").alias(t), F.array_sort(F.concat(*marks)).alias(m))
    changes = changes.filter(F.size(m) > 0).dropDuplicates([d, t])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    joined = docs.join(changes, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(text) == F.col(t)), "left")

    def add(piece: Column, base: Column):
        def one(acc: Column, s: Column) -> Column:
            fresh = s["start"] >= acc["at"]
            mark = F.coalesce(s["mark"], _class(F.substring(piece, s["start"] - base + 1, s["end"] - s["start"])))
            more = F.concat(acc["out"], F.substring(piece, acc["at"] - base + 1, s["start"] - acc["at"]), mark)
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, more).otherwise(acc["out"]).alias("out"))

        return one

    def add_run(acc: Column, run: Column) -> Column:
        end = F.array_max(F.transform(run, lambda s: s["end"]))
        piece = F.substring(text, acc["at"] + 1, F.greatest(end - acc["at"], F.lit(0)))
        changed = bound(piece, lambda p: F.aggregate(run, F.struct(acc["at"].alias("at"), F.lit("").alias("out")), add(p, acc["at"])))
        return bound(changed, lambda c: F.struct(c["at"].alias("at"), F.concat(acc["out"], F.array(c["out"])).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(_runs(F.col(m)), start, add_run, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return joined.withColumn("text", F.when(F.col(m).isNull(), F.col("text")).otherwise(done)).select(*[F.col(f"`{c}`") for c in docs.columns])
