"""Personal data, with information-theoretic sanitisation, in DataFrame functions alone.

The base finds e-mail addresses, IP addresses, card numbers and phone numbers. Each value found is a
protected entity. The method counts, over the distinct texts of the whole corpus, how many hold a term
together with an entity, and how many hold either at all. A term whose pointwise mutual information
with an entity reaches the share ``ALPHA`` of the entity's own information gives it away, and is
generalised or removed as well. All counts are of distinct texts, so copying neither reveals nor conceals.

Nothing personal is written down: texts, entities and terms are known by salted hashes, with a salt for each
run. Copies are worked on once; corpus counts are aggregated before their shuffle.

Defined results: a null or empty text has no spans and the digest of no bytes; equal texts get equal
results, whatever their doc_id, null included; overlapping kinds are all reported; extra columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.llm._common import table
from strideframe.llm.storage import discard, materialise

#: Share of an entity's information that a term may not give away, and distinct texts that must show it.
ALPHA, SUPPORT = 0.8, 3
#: Fixed values of the query's contract, in possessive form: a start inside a run of the same characters cannot match where the run's begin did not.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "term"]
#: What a text must contain for a pattern to be tried.
HINTS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_WORD = r"[\p{L}\p{N}]++"


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda s, x: s + x)


def prefix_sums(steps: Column, block: int = 64) -> Column:
    """The sum of all elements before each one. Sums of blocks come first, so the work is far below the square of the length."""

    def of_block(i: Column) -> Column:
        return F.floor(i / block).cast("int")

    def with_blocks(s: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), of_block(F.size(s) - 1)), lambda b: _total(F.slice(s, b * block + 1, F.lit(block))))
        return let(blocks, lambda t: with_bases(s, F.transform(t, lambda _, b: _total(F.slice(t, F.lit(1), b)))))

    def with_bases(s: Column, bases: Column) -> Column:
        return let(bases, lambda u: F.transform(s, lambda _, i: F.get(u, of_block(i)) + _total(F.slice(s, of_block(i) * block + 1, i % block))))

    return let(steps, with_blocks)


def located(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of the leftmost non-overlapping matches, in code points, end exclusive.

    What lies between the matches is what ``split`` leaves, so lengths add up to places.
    """
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), 0).alias("hit"), F.transform(F.split(text, pattern, -1), lambda x: F.length(x)).alias("gap"))

    def place(v: Column) -> Column:
        before = prefix_sums(F.transform(v["hit"], lambda h, i: F.get(v["gap"], i) + F.length(h)))

        def spans(p: Column) -> Column:
            def one(h: Column, i: Column) -> Column:
                begin = F.get(p, i) + F.get(v["gap"], i)
                return F.struct(begin.alias("start"), (begin + F.length(h)).alias("end"), h.alias("value"))

            return F.transform(v["hit"], one)

        return F.when(F.size(v["hit"]) > 0, let(before, spans)).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))

    return let(found, place)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits' checksum, every second one from the right doubled, ends in zero."""

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        n = F.length(_digits(value))
        return F.when((n >= 14) & (n <= 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        n = F.length(_digits(value))
        return (n >= 10) & (n <= 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Array of (start, kind, end, value) of the base kinds, by start, then kind as listed."""
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    parts = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        may = F.contains(text, F.lit(HINTS[kind])) if HINTS[kind] else text.rlike("[0-9]")
        found = F.transform(F.filter(located(text, pattern), _check(kind)), _as_kind(k))
        parts.append(F.when(may, found).otherwise(empty))
    return F.array_sort(F.concat(*parts))


def _check(kind: str):
    return lambda x: _valid(kind, x["value"])


def _as_kind(k: int):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end"), x["value"].alias("value"))


def _blanked(text: Column, spans: Column) -> Column:
    """The text with spaces in place of all spans (start, end), which are in order."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(a: Column, x: Column) -> Column:
        gap = F.substr(text, a["at"] + 1, F.greatest(x["start"] - a["at"], F.lit(0)))
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.concat(a["out"], gap, F.repeat(F.lit(" "), F.greatest(x["end"] - F.greatest(x["start"], a["at"]), F.lit(0)))).alias("out"))

    return F.aggregate(spans, start, add, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1, F.length(text))))


def _spot(x: Column, *more: Column) -> Column:
    return F.struct(x["start"].alias("start"), x["end"].alias("end"), *more)


def find_base(docs: DataFrame, salt: str) -> DataFrame:
    """doc_id, a hash of the text if it has base spans, these spans, the entities in them, and its words with their places.

    What is personal leaves the task as salted hashes alone: texts, entities and words.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t")).select("*", base_spans(F.col("t")).alias("s"))
    has = F.size("s") > 0
    found = found.select("*", F.when(has, _blanked(F.col("t"), F.col("s"))).alias("blank"))
    words = F.transform(located(F.col("blank"), _WORD), lambda x: _spot(x, F.xxhash64(F.lower(x["value"]), F.lit(salt)).alias("term")))
    entities = F.array_distinct(F.transform("s", lambda x: F.sha2(F.concat_ws(":", F.lit(salt), x["kind"].cast("string"), F.lower(x["value"])), 256)))
    return found.select(
        "doc_id",
        F.when(has, F.sha2(F.concat(F.lit(salt), "t"), 256)).alias("text_key"),
        F.transform("s", lambda x: _spot(x, x["kind"].alias("kind"))).alias("base"),
        F.when(has, entities).alias("entities"),
        F.when(has, words).alias("words"),
    )


def disclosing(held: DataFrame, docs: DataFrame, salt: str, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """(entity, term) whose mutual information reaches the threshold. All counts are of distinct texts.

    held: text_key, entities and words of each distinct text with base spans.
    """
    each = held.select("text_key", F.explode("entities").alias("entity"))
    # an entity of fewer texts cannot stand with any term in enough of them
    often = each.groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= support)
    known = each.join(often, "entity")
    distinct = held.select("text_key", F.array_distinct(F.transform("words", lambda x: x["term"])).alias("terms"))
    pairs = known.join(distinct, "text_key").select("entity", "n_entity", F.explode("terms").alias("term")).groupBy("entity", "n_entity", "term").agg(F.count("*").alias("together")).where(F.col("together") >= support)
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")).distinct()
    words = F.array_distinct(F.transform(F.split(F.lower("t"), r"[^\p{L}\p{N}]+"), lambda w: F.xxhash64(w, F.lit(salt))))
    # a mark of its own stands for the text, so one pass counts terms and texts
    marks, at = materialise(texts.select(F.explode(F.concat(words, F.array(F.lit(None).cast("long")))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term")))
    n = F.lit(float((marks.where("term IS NULL").first() or {"n_term": 0})["n_term"]))
    mutual = F.log2(F.col("together") * n / (F.col("n_entity") * F.greatest("n_term", "together")))
    flagged, _ = materialise(pairs.join(marks, "term").where(mutual >= alpha * F.log2(n / F.least(F.col("n_entity").cast("double"), n / 2))).select("entity", "term"))
    discard(docs.sparkSession, at)
    return flagged


def find_personal(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> tuple[DataFrame, DataFrame, str]:
    """Rows (doc_id, text_key, base spans), term spans (text_key, terms) of texts that have any, and the salt of their keys.

    Terms are the words of a whole text outside its base spans, of any length and at any distance from its entities.
    One that gives an entity away is marked wherever it stands in texts with the entity.
    """
    salt = uuid.uuid4().hex
    rows, _ = materialise(find_base(docs, salt))
    held = rows.where("text_key IS NOT NULL").dropDuplicates(["text_key"]).select("text_key", "entities", "words")
    flagged = disclosing(held, docs, salt, alpha, support)
    given = held.select("text_key", F.explode("entities").alias("entity")).join(flagged, "entity").groupBy("text_key").agg(F.collect_set("term").alias("given"))
    terms = held.join(given, "text_key").select("text_key", F.transform(F.filter("words", lambda x: F.array_contains("given", x["term"])), lambda x: _spot(x)).alias("terms"))
    return rows.select("doc_id", "text_key", "base"), terms, salt


_NO_TERMS = "array<struct<start:int,end:int>>"


def all_spans(base: Column, terms: Column) -> Column:
    """Array of (start, kind, end) of base and term spans, in order."""
    return F.array_sort(
        F.concat(
            F.transform(base, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))),
            F.transform(terms, lambda x: F.struct(x["start"].alias("start"), F.lit(len(KINDS) - 1).alias("kind"), x["end"].alias("end"))),
        )
    )


def rendered(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """The documents with personal data replaced by its kind, and terms that give it away generalised or removed; other columns and clean texts are unchanged."""
    rows, terms, salt = find_personal(docs, alpha, support)
    held = rows.where("text_key IS NOT NULL").dropDuplicates(["text_key"]).join(terms, "text_key", "left")
    spans = held.select("text_key", all_spans(F.col("base"), F.coalesce("terms", F.array().cast(_NO_TERMS))).alias("spans"))
    text = F.col("doc.text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(a: Column, x: Column) -> Column:
        old = F.substr(text, x["start"] + 1, x["end"] - x["start"])
        term = F.when(old.rlike("^[0-9]+$"), "[NUMBER]").when(old.rlike(r"^\p{Lu}"), "[NAME]").otherwise("")
        tag = F.element_at(F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS[:-1]], term), x["kind"] + 1)
        more = F.when(x["start"] >= a["at"], F.concat(F.substr(text, a["at"] + 1, x["start"] - a["at"]), tag)).otherwise("")
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.concat(a["out"], more).alias("out"))

    clean = F.aggregate("spans", start, add, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1, F.length(text))))
    # texts without base spans are not looked up, and do not move
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    keyed = whole.withColumn("key", F.when(F.size(base_spans(F.coalesce(text, F.lit("")))) > 0, F.sha2(F.concat(F.lit(salt), text), 256)))
    same = keyed.where("key IS NULL").select("doc.*")
    moved = keyed.where("key IS NOT NULL").join(spans, F.col("key") == F.col("text_key")).select(F.col("doc").withField("text", clean).alias("doc")).select("doc.*")
    return same.unionByName(moved)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, how many spans of each base kind every text has, the digest of these, and all spans."""
    rows, terms, _ = find_personal(docs)
    # texts without base spans have no key, and would meet in one task of a join
    none = F.array().cast(_NO_TERMS)
    held = rows.where("text_key IS NOT NULL").join(terms, "text_key", "left").select("doc_id", "base", F.coalesce("terms", none).alias("terms"))
    found = rows.where("text_key IS NULL").select("doc_id", "base", none.alias("terms")).unionByName(held)
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(PATTERNS)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(rendered(all_spans(F.col("base"), F.array().cast("array<struct<start:int,end:int>>"))), 256).alias("base_sha256"),
        rendered(all_spans(F.col("base"), F.col("terms"))).alias("spans"),
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of documents."""
    return report(table(spark, sf_dir, "documents"))


def _of_kind(k: int):
    return lambda x: x["kind"] == k
