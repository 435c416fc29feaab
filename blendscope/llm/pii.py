"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust their score.

Only DataFrame functions. A span is (kind, start, end, score); positions are code points, the end is exclusive.

Base kinds, leftmost and non-overlapping per kind, kept whatever their score: ``email``, ``ip`` (parts at most 255),
``card`` (13 to 19 digits, Luhn), ``phone`` (9 to 15 digits). Added kinds: ``iban`` (mod 97), ``aws_key``, and ``secret``, hex
strings that only a context word close by lifts over the threshold.

The patterns' quantifiers are possessive and a match starts only where a run of its characters begins or the last match
ended, which finds what the plain patterns find in linear time, also in a text that is one long run. Matches are placed, scored
and replaced in time linear in their number.

Defined cases: null text is empty, without spans; a null doc_id stays null; repeated rows give repeated rows; an
empty table gives no rows; extra columns are not looked at by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMPTY = "array<struct<kind:string,start:int,end:int,score:double>>"

W = "[A-Za-z0-9_]"

# Patterns, score without context, context words (lower case), what a context word adds.
KINDS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
              0.8, "mail|contact|write|address", 0.15),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.5, "host|server|address", 0.3),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", 0.7, "card|visa|credit|payment", 0.25),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, "phone|call|tel|fax|mobile", 0.3),
    "iban": (rf"(?<!{W})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{2,7}}(?:\x20?[A-Z0-9]{{1,3}})?(?!{W})", 0.8, "iban|account|bank", 0.2),
    "aws_key": (rf"(?<!{W})(?:AKIA|ASIA)[0-9A-Z]{{16}}(?!{W})", 0.8, "key|access|aws", 0.2),
    "secret": (rf"(?<!{W})[0-9a-f]{{16,64}}(?!{W})", 0.3, "password|passwd|pwd|token|secret|key|auth", 0.5),
}
BASE_KINDS = ("email", "ip", "card", "phone")
# A text without these characters holds no span of the kind.
NEEDED = {"email": "@", "ip": ".", "phone": "+"}
IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
THRESHOLD = 0.5
NEAR = 40  # code points before a span in which context words count
CHUNK = 512  # matches gathered in one array at a time
PIECE = 4096  # code points of a piece of a text that is rewritten


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def luhn(digits: Column) -> Column:
    def value(c: Column, i: Column) -> Column:
        doubled = c.cast("int") * (1 + i % 2)
        return doubled - F.when(doubled > 9, 9).otherwise(0)

    total = F.aggregate(F.transform(characters(F.reverse(digits)), value), F.lit(0), lambda a, v: a + v)
    return total % 10 == 0


def mod97(text: Column) -> Column:
    """Whether the text, its first four characters moved to the end and letters as 10 to 35, leaves 1."""
    moved = F.concat(F.substring(text, 5, 64), F.substring(text, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        return F.when(digit, (rest * 10 + c.cast("int")) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(characters(moved), F.lit(0), step) == 1


def confirmed(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        return found.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(found, " ", ""))
    return F.lit(True)


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def in_chunks(items: Column, first: Column, step, out: str, kind: str) -> Column:
    """``aggregate`` whose state grows an array ``out``: ``CHUNK`` items fill a new one, so that the work is linear in the items.

    ``first`` is the state without ``out``, whose fields ``step`` carries on; gives the whole array.
    """
    fields = list(first)

    def chunk(acc: Column, number: Column) -> Column:
        start = F.struct(*[acc[f].alias(f) for f in fields], F.array().cast(kind).alias(out))
        after = F.aggregate(F.slice(items, number * CHUNK + 1, CHUNK), start, step)
        return bound(after, lambda x: F.struct(*[x[f].alias(f) for f in fields], F.concat(acc["parts"], F.array(x[out])).alias("parts")))

    start = F.struct(*[v.alias(f) for f, v in first.items()], F.array().cast(f"array<{kind}>").alias("parts"))
    numbers = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int"))
    return F.flatten(F.aggregate(numbers, start, chunk, lambda acc: acc["parts"]))


MATCH = "array<struct<start:int,end:int,m:string,context:string>>"


def placed(text: Column, pattern: str, found: Column) -> Column:
    """Every match with its place and the ``NEAR`` characters before it: the texts between the matches give the distances."""
    steps = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found,
                       lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        before = F.right(F.concat(acc["tail"], x["gap"]), F.lit(NEAR))
        span = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m"), before.alias("context"))
        return bound(span, lambda s: F.struct(
            s["end"].alias("at"), F.right(F.concat(s["context"], s["m"]), F.lit(NEAR)).alias("tail"),
            F.concat(acc["spans"], F.array(s)).alias("spans")))

    return bound(steps, lambda items: in_chunks(items, {"at": F.lit(0), "tail": F.lit("")}, step, "spans", MATCH))


def spans(text: Column, kind: str, found: Column) -> Column:
    """Confirmed and scored spans of one kind, given the matches of its pattern."""
    pattern, base, words, bonus = KINDS[kind]

    def scored(s: Column) -> Column:
        score = F.lit(base) + F.when(F.lower(s["context"]).rlike(words), F.lit(bonus)).otherwise(F.lit(0.0))
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score.alias("score"))

    good = F.filter(placed(text, pattern, found), lambda s: confirmed(kind, s["m"]))
    out = F.transform(good, scored)
    if kind not in BASE_KINDS:
        out = F.filter(out, lambda s: s["score"] >= THRESHOLD)
    return F.when(F.size(found) > 0, out).otherwise(F.array().cast(EMPTY))


def with_spans(docs: DataFrame, name: str) -> DataFrame:
    """Add the array of all spans, by kind as listed, then by start."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = {}
    for kind, (pattern, *_) in KINDS.items():
        every = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        none = F.array().cast("array<string>")
        found[f"{name}_{kind}"] = F.when(text.contains(NEEDED[kind]), every).otherwise(none) if kind in NEEDED else every
    out = docs.withColumns(found)
    out = out.withColumn(name, F.concat(*[spans(text, kind, F.col(f"{name}_{kind}")) for kind in KINDS]))
    return out.drop(*found)


def find(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, spans."""
    return with_spans(docs.select("doc_id", "text"), "spans").select("doc_id", "spans")


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    inner = "pii_" + "_".join(docs.columns)  # a name no column has
    marked = with_spans(docs, inner)
    ordered = F.array_sort(F.transform(F.col(inner), lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"), s["end"].alias("end"))))

    # Pieces of the text: a place in it is found from the start of its piece, not of the text.
    pieces = f"{inner}_pieces"
    cut = F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / PIECE).cast("int")), lambda k: F.substring(F.col("text"), k * PIECE + 1, F.lit(PIECE)))
    marked = marked.withColumn(pieces, F.when(F.size(inner) > 0, cut))

    def between(a: Column, b: Column) -> Column:
        first, last = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
        return F.substring(F.array_join(F.slice(F.col(pieces), first + 1, last - first + 1), ""), a % PIECE + 1, b - a)

    def step(acc: Column, s: Column) -> Column:
        marks = F.array(between(acc["at"], s["start"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], marks)).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    kept = bound(ordered, lambda items: in_chunks(items, {"at": F.lit(0)}, step, "out", "array<string>"))
    rest = between(F.array_max(F.transform(F.col(inner), lambda s: s["end"])), F.length("text"))
    text = F.when(F.size(inner) > 0, F.concat(F.array_join(kept, ""), rest)).otherwise(F.col("text"))
    out = marked.withColumn("text", text).drop(inner, pieces)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out
