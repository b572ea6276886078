"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust the score.

All of it is built-in column expressions. Matches are found with their places as follows: `split` gives the
text between the matches and `regexp_extract_all` the matches themselves, so the places are running sums of
lengths, in code points. Sums and parts of texts are reached in steps whose number grows with the text, not with its square. The patterns below match what the plain ones in BASE_PATTERNS match, but use
possessive quantifiers and start a run at its beginning (or where the last match ended), so that no text, however
long, makes the engine try every start of a run or recurse.

Kinds email, ip, card and phone are always kept once their checks pass. Kinds iban (mod-97) and ssn (no
checksum) are kept if their score, moved by the words around them, reaches `threshold`.

Defined results: a null text is the empty text and has no spans; a null doc_id is kept as it is; repeated rows
are each scored; an empty table gives an empty table. Only doc_id and text are read, so other columns may
have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.llm.common import text_or_empty

#: The patterns as they are stated; tests compare PATTERNS with them.
BASE_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
}
KINDS = tuple(PATTERNS)
BASE_KINDS = tuple(BASE_PATTERNS)
#: Score of a span whose checks pass, before the words around it are seen.
PRIOR = {"email": 0.95, "ip": 0.7, "card": 0.9, "phone": 0.75, "iban": 0.9, "ssn": 0.4}
#: Words that speak for a kind, or against any, within WINDOW code points.
FOR = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write)\b",
    "ip": r"(?i)\b(?:ip|host|server|address)\b",
    "card": r"(?i)\b(?:card|visa|credit|payment|carte|karte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax)\b",
    "iban": r"(?i)\b(?:iban|bank|account|konto|compte|cuenta)\b",
    "ssn": r"(?i)\b(?:ssn|social|security)\b",
}
AGAINST = r"(?i)\b(?:example|sample|version|isbn|order|invoice|serial|dummy)\b"
BOOST, CUT, WINDOW = 0.2, 0.2, 40
#: Matches that are walked in one run, and code points of a part of a text.
RUN, BLOCK = 256, 1024


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def walked(items: Column, start: Column, move: Callable[[Column, Column], Column], says: Callable[[Column, Column], Column], value: Callable[[Column, Column], Column], kind: str) -> Column:
    """array<kind> of value(state, item) for the items that says(state, item) holds for; the state, a long, goes on by move.

    An array grows by being copied, so the walk goes in runs of RUN items, and the runs' arrays are put together at the end: n
    items cost n * RUN + (n / RUN) ** 2 copies of a reference, not n ** 2.
    """
    none = F.array().cast(f"array<{kind}>")

    def step(acc: Column, item: Column) -> Column:
        out = F.when(says(acc["at"], item), F.concat(acc["out"], F.array(value(acc["at"], item)))).otherwise(acc["out"])
        return F.struct(move(acc["at"], item).alias("at"), out.alias("out"))

    def run(all_: Column, acc: Column, k: Column) -> Column:
        own = F.aggregate(F.slice(all_, k * RUN + 1, F.lit(RUN)), F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return let(own, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    def runs(all_: Column) -> Column:
        zero = F.struct(start.cast("long").alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / RUN).cast("int")), zero, lambda acc, k: run(all_, acc, k), lambda acc: F.flatten(acc["out"]))

    return let(items, lambda all_: F.when(F.size(all_) > 0, runs(all_)).otherwise(none))


SPAN = "struct<start:bigint,end:bigint,match:string>"


def occurrences(text: Column, pattern: str, good: Callable[[Column], Column] = lambda m: F.lit(True)) -> Column:
    """array<struct<start,end,match>> of the leftmost non-overlapping matches that are good, places in code points."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x).cast("long"))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(found, gaps, lambda m, g: F.struct(g.alias("gap"), F.char_length(m).cast("long").alias("wide"), m.alias("match")))
    pairs = F.filter(pairs, lambda x: x["match"].isNotNull())  # there is a gap more than there are matches
    span = lambda at, x: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["wide"]).alias("end"), x["match"].alias("match"))
    return walked(pairs, F.lit(0), lambda at, x: at + x["gap"] + x["wide"], lambda at, x: good(x["match"]), span, SPAN)


def blocks_of(text: Column) -> Column:
    """The text in parts of BLOCK code points, so that a place far on is reached without passing over all before it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}+"), F.lit(0))


def part_of(blocks: Column, start: Column, end: Column) -> Column:
    """The code points from start to end."""
    first = F.floor(start / BLOCK).cast("int")
    near = F.array_join(F.slice(blocks, first + 1, F.floor(end / BLOCK).cast("int") - first + 1), "")
    return F.substr(near, (start - first * BLOCK + 1).cast("int"), (end - start).cast("int"))


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Does the string of digits pass the Luhn check?"""
    each = F.transform(F.split(F.reverse(digits), "(?!^)(?!$)"), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(match: Column) -> Column:
    """ISO 7064 mod 97-10 as in IBANs: first four characters to the end, letters as 10 to 35, remainder 1."""
    flat = F.regexp_replace(match, " ", "")
    turned = F.concat(F.substr(flat, F.lit(5)), F.substr(flat, F.lit(1), F.lit(4)))
    values = F.transform(F.split(turned, "(?!^)(?!$)"), lambda c: F.conv(c, 36, 10).cast("int"))
    return F.aggregate(values, F.lit(0), lambda a, v: F.when(v > 9, (a * 100 + v) % 97).otherwise((a * 10 + v) % 97)) == 1


def passes(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.char_length(F.regexp_replace(p, "^0+(?=.)", "")).between(1, 3) & (F.substr(F.regexp_replace(p, "^0+(?=.)", ""), F.lit(1), F.lit(3)).cast("int") <= 255))
    if kind == "card":
        digits = digits_of(match)
        return F.when(F.char_length(digits).between(16, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.char_length(digits_of(match)).between(8, 15)
    if kind == "iban":
        return F.char_length(F.regexp_replace(match, " ", "")).between(15, 34) & mod97(match)
    return F.lit(True)


def scored(text: Column, kind: str, window: int = WINDOW) -> Column:
    """array<struct<kind,start,end,score>> of the spans of one kind that pass its checks."""

    def score(blocks: Column, m: Column) -> Column:
        around = F.concat(part_of(blocks, F.greatest(m["start"] - window, F.lit(0)), m["start"]), F.lit(" "), part_of(blocks, m["end"], m["end"] + window))
        moved = F.lit(PRIOR[kind]) + F.when(F.regexp_like(around, F.lit(FOR[kind])), BOOST).otherwise(0.0) - F.when(F.regexp_like(around, F.lit(AGAINST)), CUT).otherwise(0.0)
        return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), moved)), 4)

    def spans(good: Column) -> Column:
        each = lambda blocks: F.transform(good, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), score(blocks, m).alias("score")))
        return F.when(F.size(good) > 0, let(blocks_of(text), each)).otherwise(F.array().cast(NO_SPANS))

    return let(occurrences(text, PATTERNS[kind], lambda m: passes(kind, m)), spans)


#: A text without the mark cannot hold the kind; tested before the pattern is run.
MARKS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"[0-9]-[0-9]{2}-[0-9]"}
NO_SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def find_spans(docs: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """doc_id, text, spans array<struct<kind,start,end,score>>, sorted by kind as in KINDS, then start."""
    text = text_or_empty(F.col("text"))
    out = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    for kind in KINDS:
        found = scored(text, kind)
        if kind not in BASE_KINDS:
            found = F.filter(found, lambda s: s["score"] >= threshold)
        out = out.withColumn(f"_{kind}", F.when(F.regexp_like(text, F.lit(MARKS[kind])), found).otherwise(F.array().cast(NO_SPANS)))
    return out.select("doc_id", "text", F.concat(*[f"_{kind}" for kind in KINDS]).alias("spans"))


def span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts by base kind, SHA-256 of the base spans and the list of all spans, from find_spans."""
    base = F.filter(F.col("spans"), lambda s: s["kind"].isin(*BASE_KINDS))
    of_kind = lambda kind: F.size(F.filter(F.col("spans"), lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [of_kind(kind) for kind in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(span_list(base).cast("binary"), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """text with each span replaced by its kind in square brackets; overlapping spans give one mark, that of the first."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    cut = lambda at, s: F.struct(at.alias("from"), s["start"].alias("to"), s["kind"].alias("kind"))
    cuts = walked(ordered, F.lit(0), lambda at, s: F.greatest(at, s["end"]), lambda at, s: s["start"] >= at, cut, "struct<from:bigint,to:bigint,kind:string>")
    last, length = F.array_max(F.transform(spans, lambda s: s["end"])), F.char_length(text).cast("long")
    parts = lambda blocks: F.concat(F.array_join(F.transform(cuts, lambda c: F.concat(part_of(blocks, c["from"], c["to"]), F.lit("["), F.upper(c["kind"]), F.lit("]"))), ""), part_of(blocks, last, length))
    return let(blocks_of(text), parts)


def redact(docs: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """docs with the personal data of `text` replaced; the same columns, and a null text stays null."""
    text = F.col("text")
    found = None
    for kind in KINDS:
        spans = scored(text, kind)
        if kind not in BASE_KINDS:
            spans = F.filter(spans, lambda s: s["score"] >= threshold)
        spans = F.when(F.regexp_like(text, F.lit(MARKS[kind])), spans).otherwise(F.array().cast(NO_SPANS))
        found = spans if found is None else F.concat(found, spans)
    staged = docs.select(*docs.columns, found.alias("pii spans of text"))
    clean = F.when(F.size("pii spans of text") > 0, redacted(text, F.col("pii spans of text"))).otherwise(text)
    return staged.select(*[clean.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
