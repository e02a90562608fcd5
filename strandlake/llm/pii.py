"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust a score.

Native: one projection of built-in expressions, no shuffle. A match is wrapped in a sentinel character by
``regexp_replace``; splitting at the sentinel leaves text and matches in turn, so a running sum of lengths gives code
point offsets in one pass over the text. A text that holds the sentinel is split at the matches instead.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import text_or_empty

#: Private-use character that marks matches.
SENTINEL = "\ue000"
#: Pieces of a text that running sums are taken over at once.
CHUNK = 256

# The base patterns. Repetitions are possessive and starts anchored to the beginning of a run (or the end
# of the last match), which accepts the same leftmost matches in time linear in the text, without recursion.
LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


@dataclass(frozen=True)
class Kind:
    """One kind of personal data. ``needs``: a character without which there can be no match. ``context``: words which,
    in the 48 characters before a match, raise its score."""

    name: str
    pattern: str
    needs: str
    context: str
    prior: float
    base: bool = True


KINDS = (
    Kind("email", EMAIL, "@", "mail|contact|write|reach", 0.9),
    Kind("ip", IP, ".", r"\bip\b|host|address|server|login", 0.7),
    Kind("card", CARD, "", "card|visa|credit|payment|account", 0.8),
    Kind("phone", PHONE, "+", "phone|call|tel|mobile|fax", 0.8),
    Kind("iban", IBAN, "", "iban|account|bank|transfer", 0.9, base=False),
    Kind("ssn", SSN, "-", "ssn|social|security", 0.6, base=False),
)
CONTEXT_CHARS = 48


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check; the last digit counts once, every second before it doubled."""
    doubled = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    total = F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int"))),
        F.lit(0),
        lambda s, x: s + F.coalesce(x, F.lit(0)),
    )
    return total % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an IBAN (spaces allowed) leaves 1 modulo 97, its first four characters moved to the end."""
    bare = F.replace(code, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4)))
    step = lambda r, c: F.when(c.rlike("^[0-9]$"), (r * 10 + c.cast("int")) % 97).otherwise((r * 100 + (F.ascii(c) - 55)) % 97)
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), lambda r, c: F.coalesce(step(r, c), r)) == 1


def confirmed(kind: str, match: Column) -> Column:
    """The validator of ``kind``: a match that fails it is dropped."""
    if kind == "ip":
        return match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.length(_digits(match)).between(13, 19) & luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        return F.length(F.replace(match, F.lit(" "), F.lit(""))).between(15, 34) & mod97(match)
    if kind == "ssn":
        return ~match.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _pieces(text: Column, kind: Kind) -> Column:
    """Text between matches at even places, matches at odd ones. A text that holds the sentinel itself is matched twice instead."""
    cut = F.split(F.regexp_replace(text, F.lit(kind.pattern), F.lit(f"{SENTINEL}$0{SENTINEL}")), SENTINEL, -1)
    between, found = F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    twice = F.slice(F.flatten(F.zip_with(between, found, lambda b, m: F.array(b, m))), 1, F.size(found) * 2 + 1)
    cut = F.when(F.contains(text, F.lit(SENTINEL)), twice).otherwise(cut)
    return F.when(F.contains(text, F.lit(kind.needs)), cut).otherwise(F.array(text)) if kind.needs else cut


def _score(kind: Kind, before: Column) -> Column:
    """Prior of the kind, and a tenth more where a context word stands shortly before."""
    return F.least(F.lit(1.0), F.lit(kind.prior) + F.when(F.right(before, F.lit(CONTEXT_CHARS)).rlike(f"(?i)(?:{kind.context})"), 0.1).otherwise(0.0))


def _spans(text: Column, kind: Kind) -> Column:
    """array<struct<kind, start, end, score>> of the confirmed matches, in order. Offsets are code points, end exclusive. Sums
    run within chunks of pieces, then over chunks, so that a text of many matches isn't copied for each."""
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>")
    pieces = _pieces(text, kind)
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("before"), none.alias("found"))

    def step(s: Column, piece: Column) -> Column:  # piece: struct<text, match>
        end = s["at"] + F.length(piece["t"])
        span = F.struct(F.lit(kind.name).alias("kind"), s["at"].alias("start"), end.alias("end"), _score(kind, s["before"]).alias("score"))
        found = F.when(piece["m"] & confirmed(kind.name, piece["t"]), F.concat(s["found"], F.array(span))).otherwise(s["found"])
        return F.struct(end.alias("at"), piece["t"].alias("before"), found.alias("found"))

    marked = F.transform(pieces, lambda p, i: F.struct(p.alias("t"), (i % 2 == 1).alias("m")))
    # Chunks begin with text, so what stands before a match is in its chunk.
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(marked) - 1) / CHUNK).cast("int")), lambda c: F.aggregate(F.slice(marked, c * CHUNK + 1, CHUNK), state, step))
    lengths = F.transform(chunks, lambda c: c["at"])
    starts = F.aggregate(lengths, F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("all")), lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")))["all"]
    moved = lambda c, at: F.transform(c["found"], lambda x: F.struct(x["kind"].alias("kind"), (x["start"] + at).alias("start"), (x["end"] + at).alias("end"), x["score"].alias("score")))
    return F.when(F.size(pieces) <= 1, none).when(F.size(pieces) <= CHUNK, F.aggregate(marked, state, step)["found"]).otherwise(F.flatten(F.zip_with(chunks, starts, moved)))


def find_pii(df: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """Adds ``out``, array<struct<kind, start, end, score>>: every span of every kind, by kind as in ``KINDS``, then start.

    Null text counts as empty and has no span. Kinds don't compete: a card inside a phone number is found as both.
    Repeated rows are answered alike; other columns pass through (a column named ``out`` is replaced).
    """
    df = df.withColumns({f"__{k.name}": _spans(text_or_empty(text), k) for k in KINDS})
    return df.withColumn(out, F.concat(*[F.col(f"__{k.name}") for k in KINDS])).drop(*[f"__{k.name}" for k in KINDS])


def _masked(kind: Kind, least: float):
    def piece(text: Column, i: Column) -> Column:
        sure = (i % 2 == 1) & confirmed(kind.name, text) & (_score(kind, F.get("__cut", i - 1)) >= least)
        return F.when(sure, F.lit(f"[{kind.name.upper()}]")).otherwise(text)

    return piece


def redact(df: DataFrame, text: str = "text", least: float = 0.0) -> DataFrame:
    """Replaces each confirmed match of a score of ``least`` or more by its kind in brackets, kind after kind; null text stays
    null and every other character as it is. A bracketed kind holds no character that could join a later match."""
    for k in sorted(KINDS, key=lambda k: ("email", "iban", "phone", "card", "ip", "ssn").index(k.name)):
        df = df.withColumn("__cut", _pieces(F.col(text), k))
        df = df.withColumn(text, F.when(F.size("__cut") > 1, F.array_join(F.transform("__cut", _masked(k, least)), "")).otherwise(F.col(text))).drop("__cut")
    return df


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_pii(spark, sf_dir: str) -> DataFrame:
    """Spans of every whole text. Null and empty texts have none, null ids stay null, repeated rows are answered alike."""
    from strandlake.llm.common import table

    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [k.name for k in KINDS if k.base]
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(span_text(F.filter("pii", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        span_text(F.col("pii")).alias("spans"),
        F.coalesce(F.array_max(F.transform("pii", lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )
