"""Personal data: base patterns, and information-theoretic sanitisation of the terms that reveal them.

DataFrame functions only, no Python on the executors.

Base spans are the e-mail addresses, IP addresses, card and phone numbers of a text. Each such value is a protected
entity. All terms (runs of MIN_LETTERS letters or more, in lower case) of an entity's documents are its candidates,
wherever they stand. How much of the entity's information a term gives away follows from the whole corpus:

    disclosure = log2(N * n(term, entity) / (n(term) * n(entity))) / log2(N / n(entity))

with counts of documents. It is 1 for a term that stands in the entity's documents only. From GENERALISE on, the term's
occurrences become spans, in all documents, and are replaced by a neutral word; from REMOVE on they are taken out.

A rare term reaches a high disclosure by chance, so it has to be significant too: were the term dealt over the corpus
at random, the chance (Chernoff's bound of the binomial tail) of as many meetings, times the number of pairs tested,
must not exceed CHANCE. Copies of a document tell the same thing once: documents with an entity that agree in a band of
MinHash values of their rows of three terms count as one here. An entity of one such group has no significant term (all
words that are met nowhere else would be), so its terms are not tested.

The patterns below are the base patterns with look-arounds that change no match: they spare the search from starting
inside a run of letters or digits again and again, and Java's matcher from a recursion for each digit of a long row.

Edge cases: a null text has no spans and stays null; an empty one has none; rows that repeat an id are judged each by
its own text; positions are code points, ends exclusive; a term's occurrence that overlaps a base span is part of
that; overlapping spans are replaced as one, by the first one's tag; null ids are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MIN_LETTERS, GENERALISE, REMOVE, CHANCE = 4, 0.7, 0.9, 0.05
#: Matches whose places are summed up together.
CHUNK = 128
#: Copies agree in all MinHash values of one of the bands.
BANDS, BAND_VALUES = 8, 2

_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_SPAN = "array<struct<kind:string,start:int,end:int>>"
_WORDS = "[^\\p{L}]+"


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def value(i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    if kind == "card":
        return _luhn(F.regexp_replace(match, "[ -]", ""))
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


def _may_have(kind: str, text: Column) -> Column:
    """A cheap condition without which there is no match."""
    digits = text.rlike(r"[0-9]\.[0-9]+\.[0-9]|[0-9](?:[ -]?[0-9]){7}")  # one search for both kinds
    return {"email": text.contains("@"), "ip": digits, "card": digits, "phone": text.contains("+")}[kind]


def places(text: Column, pattern: Column, kind: str) -> Column:
    """Spans of the valid matches: the texts between all matches and their own lengths, summed up.

    The sums of CHUNK matches each come first, so that no list as long as the matches is copied for each of them.
    """
    between, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    sizes = F.zip_with(F.slice(between, F.lit(1), F.size(matches)), matches, lambda x, y: F.struct(F.length(x).alias("gap"), F.length(y).alias("own"), _valid(kind, y).alias("fine")))

    def spans(begin: Column, part: Column) -> Column:
        start = F.struct(begin.alias("at"), F.array().cast(_SPAN).alias("spans"))

        def step(a: Column, x: Column) -> Column:
            end = a["at"] + x["gap"] + x["own"]
            span = F.struct(F.lit(kind).alias("kind"), (a["at"] + x["gap"]).alias("start"), end.alias("end"))
            return F.struct(end.alias("at"), F.when(x["fine"], F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

        return F.aggregate(part, start, step)["spans"]

    def parts(sizes: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.ceil(F.size(sizes) / CHUNK).cast("int") - 1), lambda i: F.slice(sizes, i * CHUNK + 1, F.lit(CHUNK)))
        total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x["gap"] + x["own"])
        begins = F.aggregate(cut, F.array(F.lit(0)), lambda a, part: F.concat(a, F.array(F.element_at(a, -1) + total(part))))
        return F.flatten(F.zip_with(F.slice(begins, F.lit(1), F.size(cut)), cut, spans))

    # A list of one element lets ``sizes`` be named, so that it is computed once.
    return F.when(F.size(matches) > 0, F.element_at(F.transform(F.array(sizes), parts), 1)).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    """All valid base spans, by start, then kind as listed."""
    none = F.array().cast("array<struct<start:int,k:int,end:int>>")

    def of(k: int, kind: str) -> Column:
        spans = places(text, F.lit(PATTERNS[kind]), kind)
        return F.when(_may_have(kind, text), F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), s["end"].alias("end")))).otherwise(none)

    found = [of(k, kind) for k, kind in enumerate(KINDS)]
    names = F.array(*[F.lit(x) for x in KINDS])
    return F.transform(F.array_sort(F.concat(*found)), lambda s: F.struct(F.get(names, s["k"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _WORDS, -1), lambda w: F.length(w) >= MIN_LETTERS)


def _bands(terms: Column) -> Column:
    """A hash for each of BANDS: of BAND_VALUES MinHash values of the rows of three terms."""
    begins = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(terms) - 2))
    rows = F.array_distinct(F.transform(begins, lambda i: F.xxhash64(F.slice(terms, i, F.lit(3)))))
    least = lambda k: F.array_min(F.transform(rows, lambda x: F.xxhash64(x, F.lit(k))))
    return F.array(*[F.xxhash64(F.lit(b), *[least(b * BAND_VALUES + i) for i in range(BAND_VALUES)]) for b in range(BANDS)])


def _groups(docs: DataFrame) -> DataFrame:
    """docs(row, terms) to (row, group): copies share a group."""
    bands = common.stored(docs.select("row", F.explode(_bands(F.col("terms"))).alias("band")), "bands")
    firsts = bands.groupBy("band").agg(F.min("row").alias("first"))
    return bands.join(common.small(firsts), "band").groupBy("row").agg(F.min("first").alias("group"))


def disclosing_terms(docs: DataFrame) -> DataFrame:
    """docs(row, text, spans) to (term, disclosure): the highest disclosure of each significant term that reaches GENERALISE."""
    spans = docs.where(F.size("spans") > 0).select("row", "text", F.explode("spans").alias("s"))
    value = F.substring(F.col("text"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    # Different rows by steps of plain counts, so that a frequent pair is summed where it is read.
    entities = common.stored(spans.select("row", value.alias("entity")).groupBy("entity", "row").agg(F.count(F.lit(1)).alias("x")), "entities")
    n_entity = entities.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).where("n_entity > 1")
    held = common.stored(entities.select("entity", "row").join(common.small(n_entity), "entity"), "held")
    rows = common.small(held.select("row").distinct())
    near = common.stored(docs.select("row", "text").join(rows, "row").select("row", _terms(F.col("text")).alias("terms")), "near")
    held = common.stored(held.join(common.small(_groups(near)), "row"), "grouped")
    n_groups = held.groupBy("entity", "group").agg(F.count(F.lit(1)).alias("x")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_groups")).where("n_groups > 1")
    held = common.stored(held.join(common.small(n_groups), "entity"), "several-held")
    pairs = near.select("row", F.explode(F.array_distinct("terms")).alias("term")).join(common.small(held), "row")
    known = ["entity", "term", "n_entity", "n_groups"]
    met = pairs.groupBy(*known, "group", "row").agg(F.count(F.lit(1)).alias("x")).groupBy(*known, "group").agg(F.count(F.lit(1)).alias("rows"))
    met = common.stored(met.groupBy(*known).agg(F.sum("rows").alias("both"), F.count(F.lit(1)).alias("both_groups")), "pairs")
    tested = met.count()
    # One meeting tells nothing, whatever the number of tests.
    candidates = met.where("both_groups > 1")
    words = docs.select(F.explode(F.array_distinct(_terms(F.col("text")))).alias("term"))
    known = common.small(candidates.select("term").distinct())
    # An inner join: Spark would push a semi join below the counts and join each word of the corpus.
    n_term = common.stored(words.groupBy("term").agg(F.count(F.lit(1)).alias("n_term")).join(known, "term"), "terms")
    n = docs.count()
    scored = candidates.join(n_term, "term")
    told = F.log2(F.lit(float(n)) * F.col("both") / (F.col("n_term") * F.col("n_entity")))
    scored = scored.withColumn("disclosure", F.try_divide(told, F.log2(F.lit(float(n)) / F.col("n_entity"))))
    share, usual = F.col("both_groups") / F.col("n_groups"), F.col("n_term") / F.lit(float(max(n, 1)))
    other = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - usual))).otherwise(0.0)
    chance = F.log(F.lit(float(max(tested, 1)))) - F.col("n_groups") * (share * F.log(share / usual) + other)
    significant = (usual < share) & (chance <= F.log(F.lit(CHANCE)))
    return common.stored(scored.where(significant).groupBy("term").agg(F.max("disclosure").alias("disclosure")).where(F.col("disclosure") >= GENERALISE), "disclosing")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with spans: array<struct<kind,start,end>> of base kinds and ``term`` or ``removed``, by start."""
    text = common.quoted(text_col)
    keep = common.without(docs, ["spans"])
    rows = docs.select(*[common.quoted(c) for c in keep], common.row_key(common.quoted(id_col), text).alias("__row"), F.coalesce(base_spans(text), F.array().cast(_SPAN)).alias("__base"))
    terms = disclosing_terms(rows.select(F.col("__row").alias("row"), text.alias("text"), F.col("__base").alias("spans")))
    words = rows.select("__row", F.explode(F.array_distinct(_terms(text))).alias("term"))
    per = words.join(common.small(terms), "term").groupBy("__row")
    per = per.agg(*[F.collect_set(F.when(c, F.col("term"))).alias(name) for name, c in (("__terms", F.col("disclosure") < REMOVE), ("__removed", F.col("disclosure") >= REMOVE))])
    rows = rows.join(common.small(per), "__row", "left")
    base = F.col("__base")

    def more(column: str, kind: str) -> Column:
        pattern = F.concat(F.lit("(?iu)(?<!\\p{L})(?:"), F.array_join(column, "|"), F.lit(")(?!\\p{L})"))
        spans = places(text, pattern, kind)
        alone = F.filter(spans, lambda s: ~F.exists(base, lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"])))
        return F.when(F.size(column) > 0, alone).otherwise(F.array().cast(_SPAN))

    order = lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0)
    told = F.array_sort(F.concat(base, more("__terms", "term"), more("__removed", "removed")), order)
    spans = F.when(F.col("__terms").isNull(), base).otherwise(told)
    return rows.select(*[common.quoted(c) for c in keep], spans.alias("spans"))


def sanitise(docs: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """docs with the spans of ``text_col`` replaced: base kinds by their name in brackets, terms by [TERM], removed ones by nothing."""
    text, spans = common.quoted(text_col), common.quoted(spans_col)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a: Column, s: Column) -> Column:
        tag = F.when(s["kind"] == "removed", "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        piece = F.when(s["start"] < a["at"], "").otherwise(F.concat(F.substring(text, a["at"] + 1, s["start"] - a["at"]), tag))
        return F.struct(F.concat(a["out"], piece).alias("out"), F.greatest(a["at"], s["end"]).alias("at"))

    done = F.aggregate(spans, start, step)
    clean = F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))
    return docs.withColumn(text_col, F.when(F.size(spans) > 0, clean).otherwise(text))
