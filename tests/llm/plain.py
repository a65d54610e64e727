"""Brute-force forms of the contracts, written for clarity, not speed."""

import hashlib
import re
from collections import Counter

import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base_rules(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    repeated = {j for i, w in enumerate(windows) if w in twice for j in range(i, i + 8)}
    lines = [line for line in text.split("\n") if WORDS.search(line)]
    failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), failed)


def simhash(text):
    words = WORDS.findall((text or "").translate(FOLD))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest_reachable(fingerprints, budget=4):
    """Smallest id reachable from each (id, fingerprint) row; None where a component has only null ids."""
    distinct = sorted({f for _, f in fingerprints})
    parent = {f: f for f in distinct}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= budget:
                parent[root(b)] = root(a)
    least = {}
    for doc, f in fingerprints:
        if doc is not None:
            least[root(f)] = min(doc, least.get(root(f), doc))
    return [least.get(root(f)) for _, f in fingerprints]


def targets(sizes, weights=(5, 2, 1), most=3):
    """Word targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        open_ -= over
    return target


def contamination(text, items):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    words, hit, found = fold(text), set(), set()
    for item, item_text in items:
        own = fold(item_text)
        for i in range(max(1, len(own) - 12) if own else 0):
            window = own[i : i + 13]
            for j in range(len(words) - len(window) + 1):
                if words[j : j + len(window)] == window:
                    hit |= set(range(j, j + len(window)))
                    found.add(str(item))
    listed = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), listed, bool(hit) and 20 * len(hit) >= len(words)


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_pii(text):
    text, digits = text or "", lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return _listed(text, kinds, ("email", "ip", "card", "phone"))


def base_secrets(text):
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in re.finditer(assign, text, re.I | re.A) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return _digest(found, ("assign", "access", "hex"))


def _listed(text, kinds, names):
    found = [(m.start(), k, m.end()) for k, (p, fits) in enumerate(kinds) for m in re.finditer(p, text) if fits(m[0])]
    return _digest(found, names)


def _digest(found, names):
    joined = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(found))
    counts = Counter(k for _, k, _ in found)
    return (*[counts[k] for k in range(len(names))], hashlib.sha256(joined.encode()).hexdigest())


def near_copies(rows, least=0.93):
    """(id, links, smallest id reachable) of each (id, vector, label) row, by all pairs."""
    import numpy as np

    def sound(v, label):
        return label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)

    scaled = [np.array(v, float) / np.abs(np.array(v, float)).max() if sound(v, label) else None for _, v, label in rows]
    units = [None if v is None else v / np.linalg.norm(v) for v in scaled]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(units):
        for j in range(i):
            b = units[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and float(a @ b) >= least:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least_id = {}
    for i, (ident, _, _) in enumerate(rows):
        if ident is not None:
            least_id[root(i)] = min(ident, least_id.get(root(i), ident))
    return [(ident, links[i], least_id.get(root(i))) for i, (ident, _, _) in enumerate(rows)]


def faults(turns):
    """(fault, initial) of each (role, text) row in order."""
    seen, out = set(), []
    for role, text in turns:
        last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else ""
        seen.add((role, text))
        out.append((fault, role[:1]))
    return out


def cheapest_edits(marked):
    """(cost, letters) of the best edits, by trying them all: up to two insertions before, between and after the rows."""
    best = None

    def go(at, roles, cost, letters, inserted):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if at == len(marked) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best or (cost, letters), (cost, letters))
        # Whatever the rest, the roles so far must begin a legal row.
        if not re.fullmatch("s?(ua)*u?", roles):
            return
        if inserted < 2:
            for role in "ua":
                go(at, roles + role, cost + 5, letters + "I", inserted + 1)
        if at < len(marked):
            fault, initial = marked[at]
            go(at + 1, roles, cost + 2, letters + "D", 0)
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                go(at + 1, roles + (initial or "?"), cost + extra, letters + "K", 0)
                for role in "ua":
                    go(at + 1, roles + role, cost + extra + 1, letters + "R", 0)

    go(0, "", 0, "", 0)
    return best


def repaired(turns, letters):
    """The lines that the letters leave."""
    out, at = [], 0
    for letter in letters:
        row = None
        if letter != "I":
            row, at = turns[at], at + 1
        if letter == "D":
            continue
        wanted = "assistant" if out and out[-1].startswith("u") else "user"
        out.append(f"{wanted}:" if letter == "I" else f"{row[0] if letter == 'K' else wanted}:{row[1]}")
    return "\n".join(out)


def damage(rows):
    """Rows (conv, turn, role, text) by conversation after the query's damage, in order."""
    import zlib

    out = {}
    shown = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        fault, role, text = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20, shown(role), shown(text)
        kept = out.setdefault(conv, [])
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        kept += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    key = lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest())
    return {conv: sorted(kept, key=key) for conv, kept in out.items()}


def conversation(kept):
    """The contract's columns of one damaged conversation."""
    turns = [(role, text) for _, role, text in kept]
    marked = faults(turns)
    numbers = [t for t, _, _ in kept if t is not None]
    count = Counter(f for f, _ in marked)
    illegal = sum(a[1] + b[1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
    cost, letters = cheapest_edits(marked)
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    lines = repaired(turns, letters)
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, letters, hashlib.sha256(lines.encode()).hexdigest()


def variants(docs):
    """(word, form, root, n, near words, n of the form) of all words of (id, text) rows."""
    import zlib

    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    shorter = {}
    for w in words:
        for i in range(len(w)):
            shorter.setdefault((w[:i], w[i + 1 :]), set()).add(w)
    near = {w: set() for w in words}
    for (head, tail), group in shorter.items():
        for w in group:
            near[w] |= group - {w}
            if head + tail in words and head + tail != w:
                near[w].add(head + tail)
                near[head + tail].add(w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return [(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()]
