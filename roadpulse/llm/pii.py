"""Personal data: patterns propose, checksums confirm, context words adjust (operator 7). DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.spans import Kind, count_of, found, luhn, named

# A match can only begin where a run of its characters begins, or where the match before it ended inside the run (\G).
# Starting at every character instead would take the square of a long run's length. Possessive loops don't recurse.
# Characters after the check digits of a country's account codes (IBAN registry).
IBAN_LENGTHS = {
    11: "NO", 12: "BE", 14: "DK|FO|FI|GL|NL|FK|SD", 15: "MK|SI", 16: "AT|BA|EE|KZ|LT|LU|MN|XK", 17: "CH|CR|HR|LI|LV", 18: "BG|BH|DE|GB|GE|IE|ME|RS|VA",
    19: "AE|GI|IL|IQ|OM|SO|TL", 20: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 21: "LY|PT|ST", 22: "IS|TR", 23: "BI|DJ|FR|GR|IT|MC|MR|SM",
    24: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV", 25: "BR|EG|PS|QA|UA", 26: "JO|KW|MU|YE", 27: "MT|SC", 28: "LC", 29: "RU",
}
_LISTED = "(?:" + "|".join(rf"(?:{c})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n}}}" for n, c in IBAN_LENGTHS.items()) + ")(?![A-Za-z0-9])"
#: A code of a listed country has its length; any other run of groups goes on up to where a listed code begins, and _trimmed finds its end.
_IBAN_CODE = rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_LISTED}|[A-Z]{{2}}[0-9]{{2}}(?:(?!\x20{_LISTED})\x20?[A-Z0-9]){{11,30}}+)"

KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    Kind("iban", _IBAN_CODE),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    Kind("local_phone", r"(?<![0-9A-Za-z+(.-])(?:\([0-9]{2,5}\)\x20?|[0-9]{2,5}[\x20./-])[0-9]{3,4}[\x20-]?[0-9]{3,5}(?![0-9A-Za-z-])"),
)
BASE = ("email", "ip", "card", "phone")
_EMAIL, _IP, _CARD, _PHONE, _IBAN, _SSN, _LOCAL = range(len(KINDS))
#: Spans whose score is below are dropped. A confirmed kind starts at 0.6, an unconfirmed pattern at 0.3.
THRESHOLD = 0.5
# Words that make a span of the kind likelier.
CONTEXT_WORDS = {
    "email": "mail|contact|kontakt|correo|courriel", "ip": "ip|host|server|address|adresse|client",
    "card": "card|visa|mastercard|credit|karte|carte|tarjeta", "phone": "tel|phone|call|fax|mobile|telefon|rufnummer|movil|llame",
    "iban": "iban|bank|account|konto|compte|cuenta", "ssn": "ssn|social security|tax id", "local_phone": "tel|phone|call|fax|mobile|telefon|rufnummer|movil|llame",
}
# Words that make it less likely.
AGAINST_WORDS = "version|isbn|issn|order no|invoice|serial"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def mod_97(code: Column) -> Column:
    """Remainder of an account code, its first four characters moved to the end and letters read as 10 to 35."""
    moved = F.concat(F.substring(code, 5, 40), F.substring(code, 1, 4))
    digits = F.transform(F.filter(F.split(moved, ""), lambda c: c != ""), lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1)
    return F.aggregate(digits, F.lit(0), lambda r, d: F.when(d < 10, r * 10 + d).otherwise(r * 100 + d) % 97)


def _checked(kind: Column, hit: Column) -> Column:
    """Whether the validator of the kind confirms the match; null where a kind has none."""
    digits = F.regexp_replace(hit, "[^0-9]", "")
    code = F.replace(hit, F.lit(" "), F.lit(""))
    return (
        F.when(kind == _EMAIL, F.lit(True))
        .when(kind == _IP, hit.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
        .when(kind == _CARD, F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False))
        .when(kind == _PHONE, F.length(digits).between(9, 15))
        .when(kind == _IBAN, F.when(F.length(code).between(15, 34), mod_97(code) == 1).otherwise(False))
        .when(kind == _SSN, ~hit.rlike("^(?:000|666|9)") & ~hit.rlike("-00-") & ~hit.rlike("0000$"))
    )


def _trimmed(hit: Column, after: Column) -> Column:
    """The longest start of an account code's match that ends where a word ends and passes mod 97; empty if none does."""
    words = F.split(hit, " ")
    # A match that was cut inside a word ends with the word before.
    whole = F.when(after.rlike("^[a-z0-9]"), F.size(words) - 1).otherwise(F.size(words))
    starts = F.when(whole > 0, F.transform(F.sequence(whole, F.lit(1)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))).otherwise(F.array().cast("array<string>"))

    # Where the country fixes the length, no shorter start is tried.
    fixed = hit.rlike("^(?:" + "|".join(IBAN_LENGTHS.values()) + ")")

    def valid(start: Column) -> Column:
        code = F.replace(start, F.lit(" "), F.lit(""))
        return (~fixed | (start == hit)) & F.length(code).between(15, 34) & (mod_97(code) == 1)

    return F.coalesce(F.try_element_at(F.filter(starts, valid), F.lit(1)), F.lit(""))


def _scored(matches: DataFrame) -> DataFrame:
    trimmed = F.when(F.col("kind") == _IBAN, _trimmed(F.col("hit"), F.col("after"))).otherwise(F.col("hit"))
    rest = F.concat(F.lower(F.substring(F.col("hit"), F.length("_hit") + 1, F.length("hit"))), F.col("after"))
    matches = matches.withColumn("_hit", trimmed).withColumn("after", F.when(F.col("kind") == _IBAN, rest).otherwise(F.col("after")))
    matches = matches.withColumn("end", F.col("start") + F.length("_hit")).drop("hit").withColumnRenamed("_hit", "hit")
    kind, near = F.col("kind"), F.concat_ws(" ", "before", "after")
    near_word = F.lit(False)
    for i, k in enumerate(KINDS):
        near_word = F.when(kind == i, near.rlike(rf"(?<![a-z])(?:{CONTEXT_WORDS[k.name]})")).otherwise(near_word)
    confirmed = _checked(kind, F.col("hit"))
    score = (F.when(confirmed, 0.6).otherwise(0.3) + F.when(near_word, 0.3).otherwise(0.0)
             - F.when(near.rlike(rf"(?<![a-z])(?:{AGAINST_WORDS})"), 0.15).otherwise(0.0))
    # A failed check is final. The base kinds stay at any score.
    keep = F.coalesce(confirmed, F.lit(True)) & ((kind < len(BASE)) | (score >= THRESHOLD))
    return matches.select("*", F.round(score, 2).alias("score"), keep.alias("_ok"))


def _gathered(df: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    """One row a text: ``_keep`` and ``_spans``, sorted structs (start, kind, end, score)."""
    scored = _scored(found(df, text, KINDS, keep))
    return scored.groupBy("_row").agg(
        F.first("_keep", ignorenulls=True).alias("_keep"),
        F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull() & F.col("_ok"), F.struct("start", "kind", "end", "score")))).alias("_spans"))


def find_pii(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, spans`` of every row; spans are (start, kind, end, score), by start, then kind as in KINDS.

    Base kinds are matched as written and kept if their check passes, whatever their score. The others also need a score of
    THRESHOLD: a confirmed check and words nearby raise it, words that point elsewhere lower it. Kinds are matched apart, so
    spans of two kinds may overlap. Null texts are empty and have no spans. Repeated rows and null ids stay apart; other
    columns are ignored; an empty table gives an empty result. A text may have any number of matches.
    """
    return _gathered(docs, text, [F.col(doc_id).alias("doc_id")]).select("_keep.doc_id", F.col("_spans").alias("spans"))


def digest(spans: DataFrame) -> DataFrame:
    """The contract's counts, base digest and listing from ``doc_id, spans``."""
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    counts = [count_of("spans", i).alias(f"n_{k}") for i, k in enumerate(BASE)]
    return spans.select("doc_id", *counts, F.sha2(named(base, KINDS).cast("binary"), 256).alias("base_sha256"), named(F.col("spans"), KINDS).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the text of every span replaced by its kind in brackets; all else as it was.

    Overlapping spans become one replacement, named after the first. Texts without any match, and nulls, pass unchanged.
    """
    body = F.col(text)
    any_match = F.lit(False)
    for k in KINDS:
        any_match = any_match | body.rlike(k.pattern)
    touched = F.coalesce(any_match, F.lit(False))
    fields = docs.columns
    keep = [F.struct(*[F.col(c) for c in fields]).alias("row")]
    spans = _gathered(docs.where(touched), text, keep).select("_keep.row", "_spans")
    # Merged spans: the furthest end so far closes a run of overlapping ones. The list is short next to the text.
    merged = F.aggregate("_spans", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"), lambda done, s: F.when(
        (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] > s["start"]),
        F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(
            F.try_element_at(done, F.lit(-1))["start"].alias("start"), F.try_element_at(done, F.lit(-1))["kind"].alias("kind"),
            F.greatest(F.try_element_at(done, F.lit(-1))["end"], s["end"]).alias("end")))),
    ).otherwise(F.concat(done, F.array(F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))))
    names = F.array(*[F.lit(f"[{k.name.upper()}]") for k in KINDS])
    held = spans.select("row", merged.alias("_m"), F.col("row")[text].alias("_text"))
    ends = held.withColumn("_from", F.concat(F.array(F.lit(0).cast("bigint")), F.transform("_m", lambda m: m["end"])))
    cut = ends.withColumn("_out", F.concat(
        F.array_join(F.transform("_m", lambda m, i: F.concat(
            F.substring(F.col("_text"), (F.get("_from", i) + 1).cast("int"), (m["start"] - F.get("_from", i)).cast("int")), F.get(names, m["kind"]))), ""),
        F.substring(F.col("_text"), (F.element_at("_from", -1) + 1).cast("int"), F.length("_text"))))
    masked = cut.select(*[(F.col("_out") if c == text else F.col("row")[c]).alias(c) for c in fields])
    return docs.where(~touched).unionByName(masked)
