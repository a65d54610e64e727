"""Secrets: named assignments, key formats and a battery of randomness tests (operator 10). DataFrame functions only."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.common import stored
from roadpulse.llm.spans import Kind, count_of, found, named

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?"""
KINDS = (
    Kind("assign", _ASSIGN + r"[A-Za-z0-9+/_.=-]++"),
    Kind("access", r"AKIA[A-Z0-9]{12,}+"),
    Kind("hex", r"(?<![0-9a-f])[0-9a-f]{32,}+"),
    Kind("random", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}"),
)
BASE = ("assign", "access", "hex")
_ASSIGN_KIND, _RANDOM = 0, 3
#: Share of false findings allowed among the random tokens; a test of randomness rejects below TAIL.
FALSE_SHARE = 0.05
TAIL = 1e-3
#: -log10 of p-values is counted in steps of 1 / STEPS up to MOST.
STEPS, MOST = 20, 40
# Inferred encoding, its pattern, its alphabet; the first that fits.
ENCODINGS = (
    ("decimal", "^[0-9]+$", "0123456789"),
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("hex_upper", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("lower", "^[a-z]+$", "abcdefghijklmnopqrstuvwxyz"),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "^[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base64", "^[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64_url", "^[A-Za-z0-9_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: Chance that two letters of ordinary words are equal (about 1 in 15), and two digits of ordinary numbers.
LETTERS_EQUAL, DIGITS_EQUAL = 1 / 15, 1 / 10


def _normal_tail(z: Column) -> Column:
    """P(Z < -z) of a standard normal, to 0.3 percent of the smaller tail however far out."""
    far = F.abs(z)
    # The weights of Boerjesson and Sundberg's quotient for the tail.
    tail = F.exp(-far * far / 2) / math.sqrt(2 * math.pi) / ((1 - 0.339) * far + 0.339 * F.sqrt(far * far + 5.510))
    return F.when(z >= 0, tail).otherwise(1 - tail)


def battery(tokens: DataFrame, hit: str = "hit") -> DataFrame:
    """Adds the tests of every token: ``encoding, n, chi2, p_ordinary, p_uniform, p_runs, p_serial``.

    chi2 measures how unevenly the token uses the alphabet of its encoding. Under uniform use it is about the alphabet's
    size; for letters of ordinary words it grows with the length, so ``p_ordinary``, the chance that an ordinary token looks
    this even, falls with it: short tokens cannot reach a small one. The runs test counts crossings of the alphabet's middle
    and the serial test multiplies neighbours; both reject counters, repeats and keyboard rows.
    """
    code = F.regexp_replace(F.col(hit), "=+$", "")
    name = F.coalesce(*[F.when(code.rlike(p), n) for n, p, _ in ENCODINGS], F.lit("mixed"))
    letters = F.coalesce(*[F.when(code.rlike(p), a) for _, p, a in ENCODINGS], F.lit(ENCODINGS[-2][2] + "-_"))
    coded = tokens.withColumn("_code", code).withColumn("encoding", name).withColumn("_letters", letters)
    chars = coded.withColumn("_chars", F.filter(F.split("_code", ""), lambda c: c != ""))
    placed = chars.withColumn("_at", F.transform("_chars", lambda c: F.instr(F.col("_letters"), c) - 1)).withColumn("n", F.size("_chars"))
    size = F.length("_letters")
    squares = F.aggregate(F.array_distinct("_chars"), F.lit(0.0), lambda s, c: s + F.pow(F.size(F.filter("_chars", lambda x: x == c)).cast("double"), 2))
    low, high = F.slice("_at", F.lit(1), F.col("n") - 1), F.slice("_at", F.lit(2), F.col("n") - 1)
    middle = (size - 1) / 2
    crossings = F.aggregate(F.zip_with(low, high, lambda a, b: F.when((a > middle) != (b > middle), 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    above = F.size(F.filter("_at", lambda a: a > middle))
    products = F.aggregate(F.zip_with(low, high, lambda a, b: (a - middle) * (b - middle)), F.lit(0.0), lambda s, x: s + x)
    measured = placed.select("*", squares.alias("_squares"), crossings.alias("_cross"), above.alias("_above"), products.alias("_products"), size.alias("_size"))
    n, k = F.col("n"), F.col("_size")
    chi2 = F.col("_squares") * k / n - n
    equal = F.when(F.col("encoding").isin("hex", "hex_upper", "decimal"), DIGITS_EQUAL).otherwise(LETTERS_EQUAL)
    shift = n * (equal * k - 1)
    ordinary = (shift + k - 1 - chi2) / F.sqrt(2 * (k - 1) + 4 * shift)
    # Wilson and Hilferty's cube root makes a chi-squared value nearly normal.
    cube = (F.pow(F.greatest(chi2, F.lit(0.0)) / (k - 1), 1 / 3) - (1 - 2 / (9 * (k - 1)))) / F.sqrt(2 / (9 * (k - 1)))
    half = F.greatest(F.lit(1.0), 2 * F.col("_above") * (n - F.col("_above")) / n)
    runs = F.abs(F.col("_cross") - half) / F.sqrt(F.greatest(F.lit(1.0), half * (half - 1) / F.greatest(F.lit(1), n - 1)))
    spread = (k * k - 1) / 12
    serial = F.abs(F.col("_products")) / (spread * F.sqrt(F.greatest(F.lit(1), n - 1)))
    return measured.select(
        *tokens.columns, "encoding", "n", chi2.alias("chi2"), _normal_tail(ordinary).alias("p_ordinary"), _normal_tail(cube).alias("p_uniform"),
        (2 * _normal_tail(runs)).alias("p_runs"), (2 * _normal_tail(serial)).alias("p_serial"))


def _bin(p: Column) -> Column:
    return F.least(F.lit(STEPS * MOST), F.floor(-F.log10(F.greatest(p, F.lit(10.0**-MOST))) * STEPS)).cast("int")


def _cut_off(tests: DataFrame) -> int:
    """Smallest bin of p-values whose findings stay within FALSE_SHARE, after Benjamini and Hochberg, over the whole corpus.

    The table counted has one row a bin, so the driver sees at most STEPS * MOST + 1 rows.
    """
    counts = {r["_bin"]: r["count"] for r in tests.groupBy(_bin(F.col("p_ordinary")).alias("_bin")).count().collect()}
    total, found_, best = sum(counts.values()), 0, STEPS * MOST + 1
    for place in sorted(counts, reverse=True):
        found_ += counts[place]
        # Every p-value of the bin is at most 10 ** (-place / STEPS).
        if math.pow(10, -place / STEPS) <= FALSE_SHARE * found_ / total:
            best = place
    return best


def find_secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, spans`` of every row; spans are (start, kind, end), by start, then kind as in KINDS.

    Base kinds are kept by their form alone. A ``random`` span is a token of 16 or more characters that an ordinary token
    would hardly match for evenness (controlled over all tokens of the corpus at FALSE_SHARE), that fails no randomness test
    of its encoding, and that is not a plain number. Null texts are empty and have no spans. Repeated rows and null ids stay
    apart; other columns are ignored; an empty table gives an empty result.
    """
    matches = found(docs, text, KINDS, [F.col(doc_id).alias("doc_id")])
    value = F.regexp_extract("hit", "(?s)^" + _ASSIGN + "(.*)$", 1)
    # One row a text and match, without texts: read again for the cut-off over the whole corpus.
    rows = stored(matches.where(F.col("kind").isNull() | (F.col("kind") != _ASSIGN_KIND) | (F.length(value) >= 8)).select(
        "_row", "_keep", "kind", "start", "end", F.when(F.col("kind") == _RANDOM, F.col("hit")).alias("hit")), "secret-matches")
    tests = stored(battery(rows.where(F.col("kind") == _RANDOM).select("_row", "kind", "start", "end", "hit")).drop("hit"), "secret-tests")
    # Plain numbers are ids and dates, not secrets; all other tokens are counted.
    tests = tests.where(F.col("encoding") != "decimal")
    random = reduce(lambda a, b: a & b, [F.col(p) >= TAIL for p in ("p_uniform", "p_runs", "p_serial")])
    kept = tests.where(random & (_bin(F.col("p_ordinary")) >= _cut_off(tests)))
    no_keep = F.lit(None).cast(rows.schema["_keep"].dataType).alias("_keep")
    every = rows.where(F.col("kind").isNull() | (F.col("kind") != _RANDOM)).select("_row", "_keep", "kind", "start", "end").unionByName(
        kept.select("_row", no_keep, "kind", "start", "end"))
    gathered = every.groupBy("_row").agg(
        F.first("_keep", ignorenulls=True).alias("_keep"),
        F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "end")))).alias("spans"))
    return gathered.select("_keep.doc_id", "spans")


def digest(spans: DataFrame) -> DataFrame:
    """The contract's counts, base digest and listing from ``doc_id, spans``."""
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    counts = [count_of("spans", i).alias(f"n_{k}") for i, k in enumerate(BASE)]
    return spans.select("doc_id", *counts, F.sha2(named(base, KINDS).cast("binary"), 256).alias("base_sha256"), named(F.col("spans"), KINDS).alias("spans"))
