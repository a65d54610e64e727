"""Near copies of vectors, conversation repair and spelling variants against brute force, on given rows and on odd ones."""

import random
from collections import Counter
from itertools import product

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from roadpulse.llm import conversation, lattice, variants
from roadpulse.llm.common import stored

CLASH = ("_node", "_label", "_vector", "node", "a", "b", "n", "kept", "word", "present", "edit", "position", "_digest", "_kind")


def clashing(df):
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH if c not in df.columns])


def rows(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


# -- vectors ----------------------------------------------------------------------

def odd_vectors():
    rng = np.random.default_rng(11)
    out, unit = [], lambda v: v / np.linalg.norm(v)
    for k in range(60):
        a = unit(rng.standard_normal(64))
        side = rng.standard_normal(64)
        side = unit(side - (side @ a) * a)
        near = 0.95 + 0.0008 * k
        out += [(10 * k, a.tolist(), k % 3), (10 * k + 1, (near * a + np.sqrt(1 - near * near) * side).tolist(), k % 3)]
        out += [(10 * k + 2, (5.0 * a).tolist(), k % 3), (10 * k + 3, (0.9 * a + np.sqrt(0.19) * side).tolist(), k % 3), (10 * k + 4, a.tolist(), (k + 1) % 3)]
    base = out[0][1]
    out += [(None, base, 0), (0, base, 0), (0, base, 0), (900, None, 0), (901, [], 0), (902, [0.0] * 64, 0), (903, base, None), (None, None, None)]
    out += [(904, [*base[:-1], None], 0), (905, [*base[:-1], float("nan")], 0), (906, [*base[:-1], float("inf")], 0)]
    out += [(907, [1.0, 2.0], 0), (908, [2.0, 4.0], 0), (909, [1e300, 2e300], 0), (910, [1e-310, 2e-310], 0), (911, [-1.0, -2.0], 0), (912, [3.0], 0), (913, [7.0], 0)]
    return out


def vectors(spark, given, kind="double"):
    return spark.createDataFrame(given, f"vec_id long, embedding array<{kind}>, label int")


@pytest.mark.parametrize("group", [4096, 4])
def test_near_copies_as_by_all_pairs(spark, monkeypatch, group):
    """Also where every cell is split into parts."""
    monkeypatch.setattr(lattice, "GROUP_ROWS", group)
    monkeypatch.setattr(lattice, "SLICE", 3 if group == 4 else 256)
    given = odd_vectors()
    got = lattice.near_copies(clashing(vectors(spark, given)))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert rows(got, "vec_id", "n_links", "component_id") == Counter(plain.near_copies(given))
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got.collect())


def test_no_vectors(spark):
    assert lattice.near_copies(vectors(spark, [])).count() == 0


def test_hot_group_of_copies(spark):
    """A third of all rows near one vector, a third of all equal: every link is counted once."""
    rng = np.random.default_rng(12)
    centre = rng.standard_normal(64)
    given = [(k, (centre + 0.1 * rng.standard_normal(64)).tolist(), 1) for k in range(400)] + [(1000 + k, centre.tolist(), 1) for k in range(400)]
    given += [(2000 + k, rng.standard_normal(64).tolist(), 1) for k in range(400)]
    assert rows(lattice.near_copies(vectors(spark, given, "float")), "vec_id", "n_links", "component_id") == Counter(
        plain.near_copies([(i, [float(np.float32(x)) for x in v], label) for i, v, label in given]))


def test_recall_of_the_weakest_links(spark):
    """Pairs just above the limit, the hardest to propose."""
    rng, given = np.random.default_rng(13), []
    for k in range(1500):
        a, side = rng.standard_normal(64), rng.standard_normal(64)
        a /= np.linalg.norm(a)
        side -= (side @ a) * a
        side /= np.linalg.norm(side)
        given += [(2 * k, a.tolist(), 0), (2 * k + 1, (0.931 * a + np.sqrt(1 - 0.931**2) * side).tolist(), 0)]
    got = lattice.near_copies(vectors(spark, given)).collect()
    recall = sum(r["n_links"] > 0 for r in got) / len(given)
    print("recall at 0.931", recall)
    assert recall > 0.95


def test_decoded_points_are_the_nearest():
    rng = np.random.default_rng(14)
    x = rng.uniform(-3, 3, (300, 8))
    point = lattice.decode(x)
    even = np.all(point == np.rint(point), axis=1) | np.all(point - 0.5 == np.rint(point - 0.5), axis=1)
    assert even.all() and np.all(point.sum(axis=1) % 2 == 0)
    # No lattice point beside it is nearer, so none at all is: the neighbours bound its cell.
    other = ((x[:, None, :] - point[:, None, :] - lattice._ROOTS) ** 2).sum(axis=2).min(axis=1)
    assert np.all(((x - point) ** 2).sum(axis=1) <= other + 1e-9)


# -- conversations ------------------------------------------------------------------

def odd_conversations(seed, many, longest):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "user"]
    texts = ["Yes.", "No!", "Why? ", "cut", "cut off ", "", " \t\n", None, "Yes.", "a.\x0b\x0c", " ", "Ends。", "\U0001f600?"]
    out = []
    for conv in range(many):
        for turn in range(rng.randrange(longest + 1)):
            out.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"Text {turn}."))
    return out + [(None, 1, "user", "Hello."), (None, 2, "assistant", "Hi."), (None, None, None, None), (-1, None, "user", None)]


def digest(spark, given):
    df = spark.createDataFrame(given, "conv_id long, turn long, role string, text string")
    damaged = conversation.damaged(clashing(df))
    planned = stored(conversation.plans(damaged), "plans")
    return conversation.digest(planned, conversation.repair(damaged, planned))


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_as_by_trying_all_edits(spark, seed):
    given = odd_conversations(seed, 60, 6)
    want = Counter((conv, *plain.conversation(kept)) for conv, kept in plain.damage(given).items())
    assert rows(digest(spark, given), *COLUMNS) == want


def test_no_conversations(spark):
    assert digest(spark, []).count() == 0


def test_best_way_of_every_short_conversation():
    """All rows of up to four, of kept and changed roles, faults and strangers."""
    for n in range(5):
        for marked in product([("", "u"), ("", "a"), ("", "s"), ("truncated", "u"), ("blank", "a"), ("", "x")], repeat=n):
            way = conversation.Survivors()
            for fault, initial in marked:
                way.step(initial, fault in ("blank", "duplicate"), fault == "truncated")
            assert way.end() == plain.cheapest_edits(marked), marked


def test_memory_follows_the_open_part():
    """A long conversation in order settles as it goes; ties that only the end decides stay open and are compared whole."""
    def nodes(way):
        found, todo = 0, [way.root]
        while todo:
            node = todo.pop()
            found += 1
            todo += node.below or ()
        return found

    way, most = conversation.Survivors(), 0
    for i in range(20_000):
        way.step("ua"[i % 2], i % 50 == 7, i % 33 == 5)
        most = max(most, nodes(way))
    assert most < 60 and len(way.end()[1]) >= 20_000
    way = conversation.Survivors()
    for _ in range(2001):
        way.step("u", False, False)
    cost, letters = way.end()
    assert cost == 1002 and letters == "D" + "KR" * 1000


def test_edits_of_a_repair(spark):
    given = [(7, 1, "system", "Be kind."), (7, 2, "assistant", "Hello."), (7, 3, "assistant", "Well?"), (7, 4, "assistant", "Well?"), (7, 5, "user", "")]
    df = spark.createDataFrame([(c, t, True, r, x) for c, t, r, x in given], "conv_id long, turn long, present boolean, role string, text string")
    planned = stored(conversation.plans(df), "plans")
    assert [(r["cost"], r["audit"]) for r in planned.collect()] == [(5, "KRKDD")]
    got = [(r["position"], r["edit"], r["turn"], r["role"], r["text"]) for r in conversation.repair(df, planned).collect()]
    assert got == [(0, "keep", 1, "system", "Be kind."), (1, "rerole", 2, "user", "Hello."), (2, "keep", 3, "assistant", "Well?"),
                   (None, "delete", 4, "assistant", "Well?"), (None, "delete", 5, "user", "")]


# -- spelling -------------------------------------------------------------------------

VARIANT = ("word", "form", "root", "n", "n_near", "form_n")


@pytest.mark.parametrize("group", [4096, 4])
def test_variants_as_by_deleting_letters(table, odd_documents, no_documents, monkeypatch, group):
    monkeypatch.setattr(variants, "GROUP_ROWS", group)
    for docs in (table("documents"), odd_documents, no_documents):
        given = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        assert rows(variants.group_variants(docs), *VARIANT) == Counter(plain.variants(given))


def test_long_words_and_chains_of_forms(spark):
    long = "abcdefghijklmnop" * 4
    counted = {"colour": 12, "color": 48, "coloor": 3, "colouur": 5, "collour": 24, long: 9, long[:-1] + "x": 4, long + "y": 3, "z" * 70_000: 3, "z" * 70_001: 6, "abcde": 3, "abced": 3, "Été" * 3: 3}
    docs = spark.createDataFrame([(i, " ".join([w] * n)) for i, (w, n) in enumerate(counted.items())], "doc_id long, text string")
    given = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = rows(variants.group_variants(docs), *VARIANT)
    assert got == Counter(plain.variants(given))
    forms = {w: (form, root) for w, form, root, *_ in got}
    assert forms["colouur"] == ("colour", "color") and forms["colour"][1] == "color" and forms["abcde"] == (None, "abcde")


def test_one_edit():
    words = ["abcde", "abcd", "bcde", "abXde", "abcdef", "Xabcde", "abdce", "abcXde", "abc", "abcde"]
    for a, b in product(words, words):
        near = any(a[:i] + a[i + 1 :] == b or b[:i] + b[i + 1 :] == a for i in range(6)) and abs(len(a) - len(b)) == 1
        near |= len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1
        assert variants.one_edit(a, b) == near, (a, b)
    held = variants._Table(words)
    left, right = (np.array(x) for x in zip(*[(i, j) for i in range(len(words)) for j in range(len(words))], strict=True))
    assert held.near(left, right).tolist() == [variants.one_edit(words[i], words[j]) for i, j in zip(left, right, strict=True)]
    # Whatever one edit does, some signature stays.
    rng = random.Random(15)
    for _ in range(300):
        word = "".join(rng.choice("aabcdeé") for _ in range(rng.randrange(5, 12)))
        at = rng.randrange(len(word))
        for other in (word[:at] + word[at + 1 :], word[:at] + "q" + word[at:], word[:at] + "q" + word[at + 1 :], word[:at] + "a" + word[at + 1 :]):
            a, b = variants.signatures([word, other])
            assert (a == b).any(), (word, other)
