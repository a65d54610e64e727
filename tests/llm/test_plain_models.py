"""The learned operators and the randomness battery against plain forms of their definitions, on a few dozen texts."""

import math
from collections import Counter

import numpy as np
import plain
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from roadpulse.llm import compression, quality_rules, secrets, toxicity

MASK, ODD, MIX = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def ordered(docs, labels, label, allowed, seed=1):
    """(label, text) of the labelled documents that may be learned from, in the operator's order."""
    known = {r["doc_id"]: r[label] for r in labels.collect() if r[label] in (0, 1) and allowed(r["doc_id"])}
    rows = docs.withColumn("_order", F.xxhash64(F.lit(seed), "doc_id")).collect()
    chosen = sorted((r["_order"], r["text"].encode(), known[r["doc_id"]], r["doc_id"]) for r in rows if r["doc_id"] in known)
    return [(y, text, doc) for _, text, y, doc in chosen]


def fold_of(doc, modulus):
    import zlib

    return zlib.crc32(str(doc).encode()) % modulus


# -- toxicity -----------------------------------------------------------------------

def plain_features(text, bits):
    fold = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() and b < 128 else 32 for b in range(256))
    hashes = [xxhash.xxh64_intdigest(w) for w in text.translate(fold).split()]
    grams = list(hashes)
    for step in (1, 2):
        grams += [(a * (MIX + 2 * step) + b) & MASK for a, b in zip(hashes, hashes[step:], strict=False)]
    return {(g * ODD & MASK) >> (64 - bits) for g in grams}


def plain_ftrl(rows, p):
    """Per-coordinate FTRL-proximal on dictionaries; None is the intercept."""
    z, n = {}, {}
    l1 = p.l1 * min(1.0, len(rows) / p.l1_documents)

    def weight(k):
        if abs(z.get(k, 0.0)) <= l1:
            return 0.0
        return -(z[k] - math.copysign(l1, z[k])) / ((p.beta + math.sqrt(n[k])) / p.alpha + p.l2)

    active = [[*plain_features(text, p.bits), None] for _, text, _ in rows]
    order = np.random.default_rng(7)
    for _ in range(p.epochs):
        for i in order.permutation(len(rows)):
            ws = {k: weight(k) for k in active[i]}
            g = 1 / (1 + math.exp(-sum(ws.values()))) - rows[i][0]
            for k, w in ws.items():
                old = n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / p.alpha * w
                n[k] = old + g * g
    return {k: weight(k) for k in n}


def test_weights_as_of_a_plain_ftrl(table):
    docs, labels = table("documents"), table("labels")
    p = toxicity.Ftrl(bits=16)
    rows = ordered(docs, labels, "toxic", lambda d: fold_of(d, 5) != 0)
    assert 30 < len(rows) < 400 and len({y for y, *_ in rows}) == 2
    want = plain_ftrl(rows, p)
    got = toxicity.fit(docs, labels, p)
    assert all(abs(got[-1 if k is None else k] - w) < 1e-7 for k, w in want.items())
    assert {k for k, w in want.items() if w and k is not None} == set(np.flatnonzero(got[:-1]).tolist())
    assert sum(1 for w in want.values() if not w) > len(want) / 2
    for r in toxicity.score_documents(docs, labels, p).join(docs, "doc_id").collect():
        total = want[None] + sum(want.get(k, 0.0) for k in plain_features(r["text"].encode(), p.bits))
        assert abs(r["score"] - 1 / (1 + math.exp(-total))) < 1e-5


# -- compression -----------------------------------------------------------------------

def test_scores_as_of_plain_dictionaries(table):
    docs, labels = table("documents"), table("labels")
    good, bad, slope, intercept = compression.fit(docs, labels)
    halves = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(2)).alias("h")).collect()}
    rows = ordered(docs, labels, "quality", lambda d: fold_of(d, 3) != 1)
    for label, dictionary in ((1, good), (0, bad)):
        texts = [t for y, t, d in rows if y == label and halves[d] == 0]
        assert max(map(len, texts)) <= compression.LONGEST and sum(map(len, texts)) < compression.DICT_BYTES
        assert dictionary == b"\n".join([b"\n" * 8, *texts])

    def difference(text):
        sizes = []
        for raw in (bad, good):
            packer = compression._compressor(raw)
            sizes.append(sum(len(packer.compress(text[i : i + compression.PIECE])) for i in range(0, len(text), compression.PIECE)))
        return (sizes[0] - sizes[1]) / len(text) if text else 0.0

    x, y = zip(*[(difference(t), label) for label, t, d in rows if halves[d] == 1], strict=True)
    assert isinstance(compression._compressor(good), zstandard.ZstdCompressor)

    # The curve is where the weighted, slightly penalised loss is least: no small step lowers it.
    scale = max(np.std(x), 1e-6)
    each = {label: len(y) / 2 / y.count(label) for label in (0, 1)}

    def loss(a, b):
        total = 0.05 * a * a + 0.005 * b * b
        for xi, yi in zip(x, y, strict=True):
            s = a * xi / scale + b
            total += each[yi] * (math.log1p(math.exp(-abs(s))) + max(s, 0.0) - yi * s)
        return total

    at = slope * scale, intercept
    assert all(loss(at[0] + da, at[1] + db) >= loss(*at) - 1e-9 for da in (-0.01, 0, 0.01) for db in (-0.01, 0, 0.01))
    for r in compression.score_documents(docs, labels).join(docs, "doc_id").collect():
        assert abs(r["score"] - 1 / (1 + math.exp(-(slope * difference(r["text"].encode()) + intercept)))) < 1e-9


# -- quality rules ------------------------------------------------------------------------

def test_best_step_as_by_trying_all():
    rng = np.random.default_rng(16)
    for _ in range(300):
        tally = {int(s): [int(a), int(b)] for s, a, b in zip(rng.permutation(40)[:9], rng.integers(0, 5, 9), rng.integers(0, 5, 9), strict=True)}
        tally[99], tally[98] = [1, 0], [0, 1]
        bad, good = (sum(t[q] for t in tally.values()) for q in (0, 1))
        gains = {s: sum(t[0] for u, t in tally.items() if u < s) / bad - sum(t[1] for u, t in tally.items() if u < s) / good for s in tally}
        best = max(0.0, *gains.values())
        assert gains[quality_rules.best_step(tally)] == pytest.approx(best) or best == 0.0


def test_few_labels_keep_the_first_cut_and_many_move_it(spark):
    judged = lambda rows: spark.createDataFrame(rows, "doc_id long, base_failed boolean, score double, unseen double")
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    few = [(1, False, -0.1, -0.1), (2, False, -0.3, None)]
    assert quality_rules.find_cut(judged(few), labels([(1, 1), (2, 0)])) == quality_rules.THRESHOLD
    assert quality_rules.find_cut(judged([]), labels([])) == quality_rules.THRESHOLD
    many = [(k, False, 0.0, -0.1) for k in range(500)] + [(1000 + k, False, -0.3, None) for k in range(500)] + [(2000, True, 9.0, 9.0)]
    cut = quality_rules.find_cut(judged(many), labels([(k, 1) for k in range(500)] + [(1000 + k, 0) for k in range(500)] + [(2000, 0), (None, 1), (5, 0)]))
    # Trusted documents count with the score they would have without being trusted.
    assert -0.3 < cut <= -0.1


def test_unseen_score_is_that_without_the_text():
    rng = np.random.default_rng(17)
    size = 1 << quality_rules.BITS
    texts = [rng.integers(0, 50, 30) for _ in range(6)]
    raw = sum(np.bincount(t, minlength=size) for t in texts).astype(float)
    trusted = sum(np.bincount(t, minlength=size) for t in texts[:3]).astype(float)
    left = trusted - np.bincount(texts[0], minlength=size)
    want = quality_rules._ratios(np.stack([raw, left]))[texts[0]].mean()
    assert quality_rules._unseen(np.stack([raw, trusted]), texts[0]) == pytest.approx(want)


def test_filter_of_ids_loses_none(spark):
    from roadpulse.llm.common import id_filter

    ids = spark.range(0, 30_000, 3).select(F.col("id").alias("_id")).unionByName(spark.createDataFrame([(None,), (-5,)], "_id long"))
    some = spark.range(-10, 60_000).select(F.col("id").alias("_id")).unionByName(spark.createDataFrame([(None,)], "_id long"))
    found = [r["_id"] for r in some.where(id_filter(ids, "_id")).collect()]
    wanted = {*range(0, 30_000, 3), -5}
    assert wanted <= set(found) and None not in found and len(found) < len(wanted) + 50


# -- secrets -------------------------------------------------------------------------------

def plain_tests(token):
    code = token.rstrip("=")
    name, letters = next(((n, a) for n, p, a in secrets.ENCODINGS if __import__("re").search(p, code)), ("mixed", secrets.ENCODINGS[-2][2] + "-_"))
    n, k = len(code), len(letters)
    at = [letters.find(c) for c in code]
    chi2 = sum(v * v for v in Counter(code).values()) * k / n - n
    equal = 1 / 10 if name in ("hex", "hex_upper", "decimal") else 1 / 15
    shift, middle = n * (equal * k - 1), (k - 1) / 2

    def tail(z):
        return math.erfc(z / math.sqrt(2)) / 2

    ordinary = tail((shift + k - 1 - chi2) / math.sqrt(2 * (k - 1) + 4 * shift))
    uniform = tail(((max(chi2, 0) / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1))))
    above = sum(a > middle for a in at)
    half = max(1.0, 2 * above * (n - above) / n)
    crossings = sum((a > middle) != (b > middle) for a, b in zip(at, at[1:], strict=False))
    runs = 2 * tail(abs(crossings - half) / math.sqrt(max(1.0, half * (half - 1) / max(1, n - 1))))
    serial = 2 * tail(abs(sum((a - middle) * (b - middle) for a, b in zip(at, at[1:], strict=False))) / ((k * k - 1) / 12 * math.sqrt(max(1, n - 1))))
    return name, ordinary, uniform, runs, serial


def test_tail_is_near_the_normal_one(spark):
    got = spark.range(-50, 131).select((F.col("id") / 10).alias("z"), secrets._normal_tail(F.col("id") / 10).alias("p")).collect()
    normal = lambda z: math.erfc(z / math.sqrt(2)) / 2
    assert all(abs(r["p"] - normal(r["z"])) < 0.003 * normal(abs(r["z"])) for r in got)


def tokens():
    rng = np.random.default_rng(18)
    out = ["".join(rng.choice(list(alphabet), size)) for _, _, alphabet in secrets.ENCODINGS for size in (16, 24, 40, 64)]
    out += ["readseverytextandcountsthewordsinit", "aaaaaaaaaaaaaaaaaaaaaaaa", "abcdefghijklmnopqrstuvwxyz", "qwertyuiopasdfghjklzxcvbnm", "0123456789" * 3, "Zk8Qw3Lx9Vb2Nt7Rf5Hy1Jd4Gm6Pc0Sa+Te/Uo==", "some/path/to/a/file-name_of_words"]
    return out + ["ordinarywordsinalongrow" + w for w in ("and", "but", "then", "there", "where", "while", "until")]


def test_all_tests_of_the_battery(spark):
    for r in secrets.battery(spark.createDataFrame([(t,) for t in tokens()], "hit string")).collect():
        want = plain_tests(r["hit"])
        assert r["encoding"] == want[0]
        assert [r[p] for p in ("p_ordinary", "p_uniform", "p_runs", "p_serial")] == pytest.approx(list(want[1:]), rel=4e-3, abs=1e-30), r["hit"]


def test_random_spans_as_by_plain_false_discovery_control(spark):
    docs = spark.createDataFrame([(i, f"see {t} there") for i, t in enumerate(tokens())], "doc_id long, text string")
    tested = {i: plain_tests(t) for i, t in enumerate(tokens())}
    place = {i: min(secrets.STEPS * secrets.MOST, math.floor(-math.log10(max(t[1], 10.0**-secrets.MOST)) * secrets.STEPS)) for i, t in tested.items() if t[0] != "decimal"}
    within = [b for b in set(place.values()) if 10 ** (-b / secrets.STEPS) <= secrets.FALSE_SHARE * sum(p >= b for p in place.values()) / len(place)]
    want = {i for i, p in place.items() if within and p >= min(within) and min(tested[i][2:]) >= secrets.TAIL}
    got = {r["doc_id"] for r in secrets.digest(secrets.find_secrets(docs)).collect() if "random" in r["spans"]}
    assert got == want and 8 < len(want) < len(place)
    assert plain.base_secrets("")[0] == 0
