"""Plain reimplementations of the contracts, and fixtures with every odd case."""

import hashlib
import random
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th long, kid string, row string"
SYLLABLES = "ba be bi bo bu da de di do du fa fe fi fo fu ka ke ki ko ku la le li lo lu ma me mi mo mu na ne".split()


def words(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus(seed=1, n=60):
    """Rows of SCHEMA: exact and near copies, shared passages, nulls, empty and very long texts, repeated rows, clashing columns."""
    rng = random.Random(seed)
    base = [words(rng, rng.randint(3, 220)) for _ in range(n)]
    passage, other = words(rng, 130), words(rng, 70)
    texts = list(base)
    for t in base[:12]:
        texts += [t, t.upper(), t + " end"]
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    for t in base[20:34]:
        w = t.split()
        k = rng.randrange(len(w))
        texts.append(" ".join(w[:k]) + " " + passage + "\n" + " ".join(w[k:]))
        texts.append("\t".join(w[:k]) + "  " + other + " " + passage[: rng.randint(300, 700)])
    texts += [None, None, "", " \n\t ", "one", "one two", "one two", "12345 !!!", "é" * 500 + " ö", "x" * 3000, "ab " * 900, words(rng, 9000)]
    rows = [(i * 7 + 3, t, "en", f"s{i % 3}", 0, 1, "k", "r") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    rows += [rows[0], rows[1], rows[1], (None, "null id text " + base[0], None, None, None, None, None, None), (None, base[1], "en", None, 0, 0, None, None)]
    return rows


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def shingle_set(t, k):
    w = WORD.findall(lower(t or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(rows, k, percent):
    """doc_id -> (set size, smallest id reachable)."""
    sets = {r[0]: shingle_set(r[1], k) for r in rows if r[0] is not None}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


def repeated_bytes(rows, window):
    """For each row: (n_bytes, n_removed, n_spans, digest of the rest)."""
    raw = [(r[1] or "").encode() for r in rows]
    seen = Counter(b[i : i + window] for b in raw for i in range(len(b) - window + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = b"\x01" * window
        keep = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(keep).hexdigest()))
    return out


def repeated_words(rows, window):
    """For each row: (n_words, n_removed, digest of the rest); a null id takes no part."""
    first = {}
    for r in rows:
        w = WORD.findall(r[1] or "")
        for i in range(len(w) - window + 1):
            if r[0] is not None:
                key = tuple(w[i : i + window])
                first[key] = min(first.get(key, r[0]), r[0])
    out = []
    for r in rows:
        w = WORD.findall(r[1] or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if r[0] is not None and first[tuple(w[i : i + window])] < r[0]:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return out


PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(t):
    """(counts, kind:start:end list) of the base patterns."""
    out, counts = [], []
    for kind, pattern in PATTERNS.items():
        found = []
        for m in pattern.finditer(t or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 13 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15
            if ok:
                found.append(f"{kind}:{m.start()}:{m.end()}")
        counts.append(len(found))
        out += found
    return counts, ",".join(out)


def mixture_targets(sizes, weights=(1, 2, 3), most=3):
    """source -> target: weights by order of sources (null last), capped, the excess reshared until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = {}, float(sum(sizes.values())), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > most * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in open_}
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        open_ -= over
    return target
