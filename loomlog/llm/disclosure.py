"""Personal data, and the terms that give it away by co-occurrence.

Entities are the e-mail addresses, IP addresses, card and phone numbers that
patterns find. A term that stands near an entity discloses it by as much as the
two are associated in the corpus: their pointwise mutual information, as a share
of the information the entity carries itself,

    disclosure(t, e) = ln(n(t, e) N / (n(t) n(e))) / ln(N / n(e)),

with n(e) documents that hold e, n(t) that hold t, n(t, e) where t stands within
`REACH` characters of e, of N documents. It is 1 if t occurs with e only. A term
above the threshold is generalised to its kind wherever it occurs; terms seen with an entity in fewer than `SUPPORT` different texts are no
evidence. Counts cover all documents. Everything is DataFrame expressions; what
is shuffled are entities, their near terms, and counts.

Defined cases: null counts as empty and has no spans. Repeated rows and null ids
are rows like others (equal texts have equal spans). Other columns are ignored,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import stored, text_of
from loomlog.session import configure

#: The patterns, in their order. Repeats that nothing follows are
#: possessive: the matches are the same, and the matcher neither recurses nor
#: goes back in long runs of digits or letters.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be worth trying.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){11}", "phone": r"\+[0-9]"}
REACH = 64
SUPPORT = 3
THRESHOLD = 0.8
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def spans_of(text: Column, pattern: Column, kind: int) -> Column:
    """Leftmost matches that don't overlap, as an array of SPAN; code points, end exclusive."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    pairs = F.arrays_zip(gaps.alias("gap"), found.alias("value"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def onward(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.coalesce(F.length(pair["value"]), F.lit(0))
        span = F.struct(
            start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), pair["value"].alias("value")
        )
        spans = F.when(pair["value"].isNull(), state["spans"]).otherwise(F.array_append(state["spans"], span))
        return F.struct(end.alias("at"), spans.cast(SPAN).alias("spans"))

    return F.aggregate(pairs, empty, onward, lambda state: state["spans"])


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def add(total: Column, place: Column) -> Column:
        d = F.substring(digits, F.length(digits) - place, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(place % 2 == 1, twice).otherwise(d)

    places = F.sequence(F.lit(0), F.length(digits) - 1)
    return F.aggregate(places, F.lit(0), add) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    """Whether a match is one: parts of an address, digits and check digit of a number."""
    digits = digits_of(value)
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        small = lambda p: (F.length(part(p)) <= 3) & (part(p).substr(1, 3).cast("int") <= 255)
        return F.forall(F.split(value, r"\."), small)
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All entities of a text, by start and then by kind."""
    found = []
    for number, kind in enumerate(KINDS):
        spans = F.filter(spans_of(text, F.lit(PATTERNS[kind]), number), lambda s: holds(kind, s["value"]))  # noqa: B023
        found.append(F.when(text.rlike(HINTS[kind]), spans).otherwise(F.array().cast(SPAN)))
    return F.array_sort(F.concat(*found))


def words_of(text: Column) -> Column:
    """Runs of three letters and more, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{3,}+"), F.lit(0))


def near_terms(text: Column, span: Column) -> Column:
    """The whole words within REACH characters of a span."""
    begin = F.greatest(span["start"] - REACH, F.lit(0))
    before = F.regexp_replace(F.substring(text, begin + 1, span["start"] - begin), r"^\p{L}+", "")
    before = F.when(begin == 0, F.substring(text, F.lit(1), span["start"])).otherwise(before)
    after = F.substring(text, span["end"] + 1, F.lit(REACH))
    cut = F.length(text) > span["end"] + REACH
    after = F.when(cut, F.regexp_replace(after, r"(?<!\p{L})\p{L}++$", "")).otherwise(after)
    return F.array_distinct(F.concat(words_of(before), words_of(after)))


def find(docs: DataFrame, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """doc_id, digest, base (entities) and terms (disclosing terms) per row of `docs`;
    both are arrays of spans by start (kind 4: term).
    """
    configure(docs.sparkSession)
    own = docs.select("doc_id", text_of().alias("text"))
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    entity_of = lambda s: F.concat_ws(
        ":", s["kind"].cast("string"),
        F.when(s["kind"] == 0, F.lower(s["value"])).when(s["kind"] == 1, s["value"]).otherwise(digits_of(s["value"])),
    )
    base = own.withColumn("base", base_spans(F.col("text")))
    near = F.transform(
        "base", lambda s: F.struct(entity_of(s).alias("entity"), near_terms(F.col("text"), s).alias("terms"))
    )
    rows = stored(base.select("doc_id", digest, "base", near.alias("near")), "pii-spans")
    total = rows.count()
    met = rows.where(F.size("near") > 0).select("digest", F.explode("near").alias("near"))
    entities = stored(
        rows.where(F.size("near") > 0)
        .select("digest", F.explode(F.array_distinct(F.transform("near", lambda n: n["entity"]))).alias("entity"))
        .groupBy("entity", "digest").agg(F.count("*").alias("docs"))
        .groupBy("entity").agg(F.sum("docs").alias("n_e"), F.count("*").alias("texts"))
        .where(F.col("texts") >= support),
        "pii-entities",
    )
    together = stored(
        met.select("digest", F.col("near.entity").alias("entity"), F.explode("near.terms").alias("term"))
        .join(entities.select("entity"), "entity", "left_semi")
        .groupBy("entity", "term", "digest").agg(F.lit(1).alias("one"))
        .join(rows.groupBy("digest").agg(F.count("*").alias("docs")), "digest")
        .groupBy("entity", "term").agg(F.sum("docs").alias("n_te"), F.count("*").alias("texts"))
        .where(F.col("texts") >= support),
        "pii-together",
    )
    # n(t) is at least the number of documents with t near any entity. Where that alone
    # keeps t below the threshold (as for common words), t need not be counted everywhere.
    around = (
        rows.where(F.size("near") > 0)
        .select(F.explode(F.array_distinct(F.flatten(F.transform("near", lambda n: n["terms"])))).alias("term"))
        .groupBy("term").agg(F.count("*").alias("n_near"))
    )
    most = F.col("n_te") * F.pow(F.lit(float(total)) / F.col("n_e"), F.lit(1 - threshold))
    terms = stored(
        together.join(entities.select("entity", "n_e"), "entity").join(around, "term")
        .where(F.col("n_near") <= most * (1 + 1e-9)).select("term").distinct(),
        "pii-terms",
    )
    words = lambda *more: own.select(*more, F.explode(F.array_distinct(words_of(F.col("text")))).alias("term"))
    frequency = words().join(terms, "term").groupBy("term").agg(F.count("*").alias("n_t"))
    information = F.ln(F.lit(float(total)) / F.col("n_e"))
    shared = F.ln(F.col("n_te") * float(total) / (F.col("n_t") * F.col("n_e")))
    disclosing = stored(
        together.join(entities.select("entity", "n_e"), "entity").join(frequency, "term")
        .withColumn("disclosure", shared / information)
        .where((information > 0) & (F.col("disclosure") > threshold))
        .groupBy("term").agg(F.max("disclosure").alias("disclosure")),
        "pii-disclosing",
    )
    marked = stored(
        words(digest).join(disclosing.select("term"), "term").groupBy("digest")
        .agg(F.array_join(F.sort_array(F.collect_set("term")), "|").alias("pattern")),
        "pii-marked",
    )
    whole = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), "pattern", F.lit(r")(?!\p{L})"))
    hits = (
        own.select("text", digest).join(marked, "digest")
        .select("digest", spans_of(F.col("text"), whole, len(KINDS)).alias("terms"))
        .groupBy("digest").agg(F.first("terms").alias("terms"))
    )
    outside = lambda t: ~F.exists("base", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"]))
    return rows.join(stored(hits, "pii-hits"), "digest", "left").select(
        "doc_id", "digest", "base",
        F.filter(F.coalesce("terms", F.array().cast(SPAN)), outside).alias("terms"),
    )


def count_of(spans: Column, kind: str) -> Column:
    """How many spans are of a kind."""
    # One parameter alone: Spark gives the place of the element to a second one.
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def sanitised(text: Column, spans: Column) -> Column:
    """The text with entities and terms replaced by the name of their kind in brackets;
    of spans that overlap the first is replaced."""
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in (*KINDS, "term")])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))

    def onward(state: Column, s: Column) -> Column:
        kept = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        return F.when(s["start"] < state["at"], state).otherwise(
            F.struct(s["end"].alias("at"), F.concat(state["text"], kept, F.get(kinds, s["kind"])).alias("text"))
        )

    rest = lambda state: F.concat(state["text"], F.substring(text, state["at"] + 1, F.length(text)))
    return F.aggregate(F.array_sort(spans), start, onward, rest)


def sanitise(docs: DataFrame, **settings) -> DataFrame:
    """doc_id and sanitised text of each distinct (doc_id, text) of `docs`."""
    found = find(docs, **settings).select(
        F.col("doc_id").alias("_id"), F.col("digest").alias("_of"), F.concat("base", "terms").alias("spans")
    )
    own = docs.select("doc_id", text_of().alias("text")).distinct()
    on = (F.unhex(F.sha2("text", 256)) == F.col("_of")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    return own.join(found.dropDuplicates(["_id", "_of"]), on).select(
        "doc_id", sanitised(F.col("text"), F.col("spans")).alias("text")
    )
