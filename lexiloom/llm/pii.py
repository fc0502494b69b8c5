"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Column functions only. A pattern's matches are fenced with a control character by one regexp_replace and
the text is split there, so every second part is a match and running lengths give the offsets.
The patterns are rewritten so that Java's matcher needs neither recursion nor a second look at a character:
separators that cannot belong to a match are first replaced, one for one, by a character that ends it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, unused

FENCE, OTHER = "\x01", "\x02"
BLOCK = 64
BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "iban", "ssn"]
LOCAL, DOMAIN = "A-Za-z0-9._%+-", "A-Za-z0-9-"
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Kind to (replacement for separators that end a match, its stand-in, pattern).
PATTERNS = {
    # A dot that no domain character follows or precedes may stand in a name before @, as % may, but not in a domain.
    "email": (rf"\.(?![{DOMAIN}])|(?<![{DOMAIN}])\.", "%", rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[{DOMAIN}]++\.[.{DOMAIN}]++"),
    "ip": (None, "", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    # A blank or hyphen belongs to a card only between two digits.
    "card": (r"[ -](?![0-9])|(?<![0-9])[ -]", OTHER, r"[0-9][0-9 -]++"),
    "phone": (None, "", r"\+[0-9][ ().0-9-]+[0-9]"),
    "iban": (None, "", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "ssn": (None, "", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
}
#: Score without and with a context word among the CONTEXT_CHARS characters before or after the span.
SCORES = {"email": (0.9, 0.95), "ip": (0.6, 0.8), "card": (0.7, 0.95), "phone": (0.7, 0.9), "iban": (0.8, 0.95), "ssn": (0.3, 0.8)}
CONTEXT = {
    "email": "mail|contact|kontakt|correo",
    "ip": "host|server|address|login|adresse",
    "card": "card|visa|credit|payment|karte|tarjeta|carte",
    "phone": "phone|tel|call|mobile|telefon|llame|appel",
    "iban": "iban|account|konto|cuenta|compte",
    "ssn": "ssn|social",
}
CONTEXT_CHARS = 48
LEAST_SCORE = 0.5
SPANS = "array<struct<start:int,kind_no:int,stop:int,kind:string,score:double>>"


def _digit(s: Column, at: Column) -> Column:
    return F.ascii(F.substr(s, at, F.lit(1))) - F.lit(48)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check (mod 10)."""

    def add(total: Column, i: Column) -> Column:
        d = _digit(digits, F.length(digits) - i)
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number without blanks has remainder 1 (ISO 7064)."""
    turned = F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(c < 58, (rest * 10 + c - 48) % 97).otherwise((rest * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def confirmed(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return match.rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$")
    if kind == "card":
        return F.when(n.between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    if kind == "iban":
        plain = F.replace(match, F.lit(" "), F.lit(""))
        return F.when(F.length(plain).between(15, 34), mod97(plain)).otherwise(False)
    if kind == "ssn":
        return ~match.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _parts(kind: str, text: Column) -> Column:
    """The text cut at the matches of a kind; the second, fourth, ... parts are the matches."""
    broken, by, pattern = PATTERNS[kind]
    text = F.translate(text, FENCE, OTHER)
    if broken:
        text = F.regexp_replace(text, broken, by)
    return F.split(F.regexp_replace(text, pattern, f"{FENCE}$0{FENCE}"), FENCE, -1)


def _located(parts: Column) -> Column:
    """Matches as (start, match). Running lengths are summed by blocks, so that the work grows
    hardly faster than the number of parts."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda n, x: n + F.length(x))
    starts = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int"))
    blocks = F.transform(starts, lambda b: F.struct(F.slice(parts, b * BLOCK + 1, F.lit(BLOCK)).alias("parts"), b.alias("b")))
    sizes = F.transform(starts, lambda b: total(F.slice(parts, b * BLOCK + 1, F.lit(BLOCK))))

    def of_block(block: Column) -> Column:
        own = block["parts"]
        before = F.aggregate(F.slice(sizes, F.lit(1), block["b"]), F.lit(0), lambda n, x: n + x)
        odd = F.filter(F.sequence(F.lit(1), F.greatest(F.size(own) - 1, F.lit(1))), lambda i: (i % 2 == 1) & (i < F.size(own)))
        return F.transform(odd, lambda i: F.struct((before + total(F.slice(own, F.lit(1), i))).alias("start"), F.element_at(own, i + 1).alias("match")))

    return F.flatten(F.transform(blocks, of_block))


def spans(text: Column, kind: str, parts: Column) -> Column:
    """Confirmed spans of a kind as (start, kind_no, stop, kind, score), in code points, the stop exclusive."""
    plain, near = SCORES[kind]
    at = KINDS.index(kind)

    def scored(x: Column) -> Column:
        start = x["start"]
        before = F.lower(F.substr(text, F.greatest(start - CONTEXT_CHARS, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT_CHARS))))
        after = F.lower(F.substr(text, start + F.length(x["match"]) + 1, F.lit(CONTEXT_CHARS)))
        score = F.when(before.rlike(CONTEXT[kind]) | after.rlike(CONTEXT[kind]), F.lit(near)).otherwise(F.lit(plain))
        return F.struct(start.alias("start"), F.lit(at).alias("kind_no"), (start + F.length(x["match"])).alias("stop"), F.lit(kind).alias("kind"), score.alias("score"))

    found = F.transform(F.filter(_located(parts), lambda x: confirmed(kind, x["match"])), scored)
    kept = found if kind in BASE_KINDS else F.filter(found, lambda x: x["score"] >= LEAST_SCORE)
    return F.when(F.size(parts) > 1, kept.cast(SPANS)).otherwise(F.array().cast(SPANS))


def find(docs: DataFrame, text_col: str = "text", into: str = "pii_spans") -> DataFrame:
    """``docs`` with an array column of its spans, sorted by start and then by kind as listed in KINDS.

    Every text is read whole; a null or empty text has no spans. Spans of different kinds may overlap,
    those of one kind do not. Spans of the base kinds are kept whatever their score; the other kinds need a
    score of LEAST_SCORE. All rows, repeated ones too, and all columns are kept, but for one named as ``into``, which is replaced;
    working columns get names that no column has.
    """
    whole, *own = unused(docs, "_pii_text", *[f"_pii_{kind}" for kind in KINDS])
    out = docs.withColumn(whole, F.coalesce(F.col(quoted(text_col)), F.lit("")))
    for kind, name in zip(KINDS, own):
        out = out.withColumn(name, _parts(kind, F.col(whole)))
    for kind, name in zip(KINDS, own):
        out = out.withColumn(name, spans(F.col(whole), kind, F.col(name)))
    return out.withColumn(into, F.array_sort(F.concat(*map(F.col, own)))).drop(whole, *own)


def joined(found: Column) -> Column:
    """Spans as ``kind:start:stop``, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, the number of spans of each base kind, a digest of the base spans, all spans, and
    the greatest score (null without spans). An empty table gives no rows."""
    found = find(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    base = F.filter("pii_spans", lambda x: x["kind_no"] < len(BASE_KINDS))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in BASE_KINDS]
    return found.withColumn("base", base).select(
        F.col("id").alias(id_col), *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("pii_spans")).alias("spans"), F.array_max(F.transform("pii_spans", lambda x: x["score"])).alias("top_score")
    )


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span, or run of overlapping spans, replaced by the first one's kind as ``<EMAIL>``.

    Null texts stay null; texts without spans, and all other columns, whatever their names, stay as they are.
    """
    listed, merged_runs = unused(docs, "_pii_spans", "_pii_runs")
    found = find(docs, text_col, listed)
    text, all_spans = F.col(quoted(text_col)), F.col(listed)
    shape = "array<struct<start:int,stop:int,kind:string>>"

    def merged(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        wider = F.struct(last["start"].alias("start"), F.greatest(last["stop"], x["stop"]).alias("stop"), last["kind"].alias("kind"))
        one = F.array(F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind")))
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(wider))
        return F.when(F.size(acc) == 0, one).when(x["start"] < last["stop"], grown).otherwise(F.concat(acc, one))

    found = found.withColumn(merged_runs, F.when(F.size(all_spans) > 0, F.aggregate(all_spans, F.array().cast(shape), merged)))
    runs = F.col(merged_runs)

    def piece(x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.element_at(runs, F.greatest(i, F.lit(1)))["stop"]).otherwise(0)
        return F.concat(F.substr(text, before + 1, x["start"] - before), F.lit("<"), F.upper(x["kind"]), F.lit(">"))

    tail = F.substr(text, F.element_at(runs, -1)["stop"] + 1, F.length(text))
    cleaned = F.when(F.size(all_spans) > 0, F.concat(F.array_join(F.transform(runs, piece), ""), tail)).otherwise(text)
    return found.withColumn(text_col, cleaned).drop(listed, merged_runs)
