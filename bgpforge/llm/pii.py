"""Personal data: patterns, and information-theoretic sanitisation of the terms that reveal it. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
#: Possessive where nothing follows that could need what was matched, so that no text makes the matcher recurse or go back far; an email starts
#: at the first character of its local part, or where the match before ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Letters of a term.
LETTERS = 3
#: A term discloses an entity if at least this share of the texts that hold it hold the entity too, and if it tells this many bits of it.
POSTERIOR, BITS = 0.5, 3.0
SPAN = "struct<start:int,end:int,value:string>"
#: Slots for each key in a table of marks, and slots at most.
SLOTS, MOST = 16, 1 << 23


def _located(text: Column, pattern: Column, matches: Column) -> Column:
    """The places of matches, from the lengths of what stands between them; ends are exclusive, in code points."""
    gaps = F.split(text, pattern, -1)

    def step(acc, i):
        start = acc["at"] + F.length(F.element_at(acc["gaps"], i))
        value = F.element_at(acc["all"], i)
        end = start + F.length(value)
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), value.alias("value")))).alias("out"), acc["gaps"].alias("gaps"), acc["all"].alias("all"))

    none = F.array().cast(f"array<{SPAN}>")
    zero = F.struct(F.lit(0).alias("at"), none.alias("out"), gaps.alias("gaps"), matches.alias("all"))
    return F.when(F.size(matches) > 0, F.aggregate(F.sequence(F.lit(1), F.size(matches)), zero, step, lambda acc: acc["out"])).otherwise(none)


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(acc, i):
        digit = F.substring(back, i, F.lit(1)).cast("int")
        twice = digit * 2
        return acc + F.when(i % 2 == 1, digit).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
        return F.forall(F.split(value, r"\."), lambda x: (F.length(part(x)) <= 3) & (F.lpad(part(x), 3, "0") <= "255"))
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _passes(kind: str):
    return lambda s: _holds(kind, s["value"])


def with_base_spans(rows: DataFrame) -> DataFrame:
    """Adds s_<kind> for every kind: the spans that hold, in order. rows has a column `__text` without nulls."""
    text = F.col("__text")
    need = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9][0-9\x20-]{5}"), "phone": text.contains("+")}
    empty = F.array().cast("array<string>")
    found = rows.select("*", *[F.when(need[k], F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0))).otherwise(empty).alias(f"m_{k}") for k in KINDS])
    for k in KINDS:
        found = found.withColumn(f"s_{k}", F.filter(_located(text, F.lit(PATTERNS[k]), F.col(f"m_{k}")), _passes(k)))
    return found.drop(*[f"m_{k}" for k in KINDS])


def _terms(text: Column) -> Column:
    """Runs of letters, lower-cased."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda x: F.length(x) >= LETTERS)


def _marked(text: Column, marks: Column) -> Column:
    """text with every span of marks (start, end, mark), in order, replaced by its mark, overlapping spans by the first."""

    def step(acc, s):
        cut = F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.when(s["start"] >= acc["at"], s["mark"]).otherwise(F.lit("")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), cut.alias("out"))

    return F.aggregate(marks, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def _marks(kinds, mark) -> Column:
    """All spans of the kinds as (start, end, mark), in order; mark gives the text that stands for a kind."""
    one = lambda kind: lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(mark(kind)).alias("mark"))
    return F.sort_array(F.concat(*[F.transform(F.col(f"s_{k}"), one(k)) for k in kinds]))


def _entities(kind: str):
    """What a span is an instance of: its value (lower-cased, without the signs that cards and phones are written with), the group of the value
    (domain, network, issuer or exchange) and its kind."""

    def entities(s):
        value = F.regexp_replace(s["value"], r"[\x20().-]", "") if kind in ("card", "phone") else F.lower(s["value"])
        group = {"email": F.substring_index(value, "@", -1), "ip": F.substring_index(value, ".", 3), "card": F.substring(value, 1, 6), "phone": F.substring(value, F.lit(1), F.length(value) - 4)}[kind]
        return F.array(F.concat(F.lit(f"{kind}:"), value), F.concat(F.lit(f"{kind} of "), group), F.lit(kind))

    return entities


def _apart(rows: DataFrame, keys: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(some, rest) of rows: some holds every row whose key is in keys (key), and few others. No row is shuffled.

    Marks in a table of slots by the keys' hashes decide, whose size is bounded; where it is crowded, some holds more other rows.
    """
    spark = rows.sparkSession
    slots = 1 << 10
    n = keys.count()
    while slots < min(MOST, SLOTS * n):
        slots *= 2
    marks = bytearray(slots)
    slot = F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")
    for r in keys.select(F.xxhash64("key").alias("h")).select(F.pmod("h", F.lit(slots)).cast("int").alias("slot")).distinct().toLocalIterator():
        marks[r["slot"]] = 1
    marked = rows.crossJoin(F.broadcast(spark.createDataFrame([(bytes(marks),)], "__marks binary")))
    held = F.substring("__marks", slot + 1, F.lit(1)) == F.lit(b"\x01")
    return marked.where(held).drop("__marks"), marked.where(~held).drop("__marks")


def disclosing_terms(found: DataFrame, texts: DataFrame, posterior: float = POSTERIOR, bits: float = BITS) -> DataFrame:
    """(key, term): terms that reveal an entity, with the key of every text that holds them.

    found: (key, entities, terms, inside) of every text with base spans, terms those outside of them and inside those only within; texts: (key, __text)
    of all documents. Equal texts count once. An entity is a value, the group that it belongs to, or its kind, so that a value that stands in a single
    text is judged by what is known of its group and kind. For a term t and an entity e, of N texts n_t hold t outside of spans, n_e hold e, and n_et
    both, however far apart. t discloses e if n_et / n_t >= posterior, gain = log2(n_et / n_t * N / n_e) >= bits, and n_et > 1 texts together tell
    more than chance: n_et * gain >= log2 of the number of terms that are tried. Exact bounds first leave out terms that cannot pass.
    """
    spark = texts.sparkSession
    copies = common.written(texts.groupBy("key").agg(F.count("*").alias("n")).groupBy((F.col("n") > 1).alias("many"), F.when(F.col("n") > 1, F.col("key")).alias("key")).agg(F.count("*").alias("n")), "copies")
    total = copies.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    per_entity = common.written(found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") > 1), "classes")
    beside = common.written(found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_beside")), "beside")
    tried = F.log2(F.lit(float(max(1, beside.count()))))
    prior = F.log2(total / F.col("n_e"))
    pairs = found.select(F.explode("entities").alias("entity"), "terms").join(F.broadcast(per_entity.where(prior >= bits)), "entity").select("entity", "n_e", F.explode("terms").alias("term"))
    both = pairs.groupBy("entity", "n_e", "term").agg(F.count("*").alias("n_et")).where((F.col("n_et") > 1) & (F.col("n_et") * prior >= tried))
    likely = common.written(both.join(beside, "term").where(F.col("n_et") >= posterior * F.col("n_beside")).select("entity", "n_e", "term", "n_et"), "likely")
    if likely.isEmpty():
        common.drop(likely, beside, per_entity, copies)
        return spark.createDataFrame([], "key string, term string")
    held = lambda rows: rows.select("key", F.explode(F.array_distinct(_terms(F.col("__text")))).alias("term"))
    repeated, single = _apart(texts, copies.where("many").select("key"))
    counts = held(single.unionAll(repeated.dropDuplicates(["key"]))).groupBy("term").agg(F.count("*").alias("n_all"))
    inside = found.select(F.explode("inside").alias("term")).groupBy("term").agg(F.count("*").alias("n_in"))
    known = likely.join(counts, "term").join(inside, "term", "left").withColumn("share", F.col("n_et") / (F.col("n_all") - F.coalesce("n_in", F.lit(0))))
    gain = F.log2(F.col("share") * total / F.col("n_e"))
    good = common.written(known.where((F.col("share") >= posterior) & (gain >= bits) & (F.col("n_et") * gain >= tried)).select("term").distinct(), "good")
    out = common.written(held(texts).join(F.broadcast(good), "term", "left_semi").select("key", "term").distinct(), "disclosing")
    common.drop(likely, beside, per_entity, good, copies)
    return out


def _found(docs: DataFrame, **thresholds) -> DataFrame:
    """docs (doc_id, text, any other columns) with `s_email`, `s_ip`, `s_card`, `s_phone` and `s_term` arrays of
    (start, end, value) in code points, ends exclusive, each in order of start.

    The first four are the patterns' matches, leftmost and not overlapping in a kind, that pass their checks. s_term holds
    every occurrence, in any document, of terms that disclose an entity (see `disclosing_terms`), where it overlaps no base span.
    docs is nested in a column `row` beside them and `__text`, so that no name of it matters.
    """
    docs = docs.select(F.struct("*").alias("row"), F.col("text").alias("__text"))
    rows = docs.withColumn("__text", F.coalesce(F.col("__text").cast("string"), F.lit(""))).withColumn("__key", F.md5("__text"))
    based = with_base_spans(rows.select("__key", "__text"))
    entities = F.array_distinct(F.flatten(F.concat(*[F.transform(F.col(f"s_{k}"), _entities(k)) for k in KINDS])))
    outside = F.array_distinct(_terms(_marked(F.col("__text"), _marks(KINDS, lambda kind: " "))))
    found = based.where(" or ".join(f"size(s_{k}) > 0" for k in KINDS)).select(F.col("__key").alias("key"), entities.alias("entities"), outside.alias("terms"), F.array_except(F.array_distinct(_terms(F.col("__text"))), outside).alias("inside"))
    found = common.written(found.dropDuplicates(["key"]), "entities")
    terms = disclosing_terms(found, rows.select(F.col("__key").alias("key"), "__text"), **thresholds)
    common.drop(found)
    words = common.written(terms.groupBy("key").agg(F.sort_array(F.collect_set("term")).alias("words")), "words")
    common.drop(terms)
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("words", "|"), F.lit(r")(?!\p{L})"))
    # Only texts that hold terms, and few others, are shuffled.
    near, far = _apart(rows, words.select("key"), "__key")
    hit = near.select(F.col("__key").alias("key"), "__text").join(words, "key").withColumn("pattern", pattern).withColumn("all", F.regexp_extract_all("__text", F.col("pattern"), F.lit(0)))
    places = hit.select("key", _located(F.col("__text"), F.col("pattern"), F.col("all")).alias("places")).dropDuplicates(["key"])
    places = common.written(places.withColumnRenamed("key", "__key"), "places")
    common.drop(words)
    joined = near.select("row", "__key").join(places, "__key", "left").select("row", "places").unionAll(far.select("row", F.lit(None).cast(places.schema["places"].dataType).alias("places")))
    out = with_base_spans(joined.withColumn("__text", F.coalesce(F.col("row.text").cast("string"), F.lit(""))))
    base = F.concat(*[f"s_{k}" for k in KINDS])
    apart = F.filter(F.coalesce("places", F.array().cast(f"array<{SPAN}>")), lambda t: ~F.exists(base, lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    return out.withColumn("s_term", apart).drop("places")


def find(docs: DataFrame, **thresholds) -> DataFrame:
    """docs (doc_id, text, any other columns) with the spans of `_found`.

    Null texts are empty: no spans. Repeated rows have equal spans, rows without doc_id spans like others; columns
    of any other name stay, and those of the five names are replaced. Empty tables give no rows.
    """
    names = [f"s_{k}" for k in (*KINDS, "term")]
    return _found(docs, **thresholds).select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in names], *names)


def written_spans(kinds) -> Column:
    """kind:start:end of all spans, comma-joined, by kind and start."""
    one = lambda kind: lambda s: F.concat(F.lit(f"{kind}:"), s["start"], F.lit(":"), s["end"])
    return F.array_join(F.concat(*[F.transform(F.col(f"s_{k}"), one(k)) for k in kinds]), ",")


def digest(docs: DataFrame, **thresholds) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans (see `find`)."""
    found = find(docs.select("doc_id", "text"), **thresholds)
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[F.size(f"s_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(written_spans(KINDS).cast("binary"), 256).alias("base_sha256"),
        written_spans((*KINDS, "term")).alias("spans"),
    )


def redact(docs: DataFrame, **thresholds) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets, overlapping spans by the first; same columns, of any names. Null texts stay null."""
    marks = _marks((*KINDS, "term"), lambda kind: f"[{kind.upper()}]")
    found = _found(docs, **thresholds).withColumn("clean", F.when(F.size(marks) > 0, _marked(F.col("__text"), marks)).otherwise(F.col("row.text").cast("string")))
    return found.select(*[F.col("clean").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
