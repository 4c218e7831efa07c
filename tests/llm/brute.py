"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeats_removed(rows, depth=20):
    """{doc_id: (n_words, n_removed, sha256 of what is left)} of (doc_id, text)."""
    split = {i: WORD.findall(t or "") for i, t in rows}
    seen, out = set(), {}
    for i in sorted(split, key=lambda x: (x is not None, x)):
        w, gone = split[i], set()
        for s in range(len(w) - depth + 1):
            window = tuple(w[s : s + depth])
            if window in seen:
                gone.update(range(s, s + depth))
            seen.add(window)
        left = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(left.encode()).hexdigest())
    return out


def _lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def shingle_bag(text, size=5):
    from collections import Counter

    w = WORD.findall(_lower(text))
    return Counter(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else Counter([tuple(w)] if w else [])


def probability_jaccard(a, b):
    total = 0.0
    for d in a.keys() & b.keys():
        total += 1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in a.keys() | b.keys())
    return total


def log_jaccard(a, b):
    """Probability Jaccard index of the weights 1 + ln(count), by the numbers of shingles of each pair of counts."""
    from collections import Counter
    from math import log

    w = lambda n: 1 + log(n) if n else 0.0
    kinds = [(w(m), w(n), k) for (m, n), k in Counter((a.get(e, 0), b.get(e, 0)) for e in a.keys() | b.keys()).items()]
    return sum(k / sum(t * max(u / x, v / y) for u, v, t in kinds) for x, y, k in kinds if x and y)


def jaccard(a, b):
    return len(a.keys() & b.keys()) / max(1, len(a.keys() | b.keys()))


def near_classes(rows, similarity=0.8, like=log_jaccard):
    """{doc_id: smallest doc_id of its class}, all pairs compared."""
    rows = sorted((i, t or "") for i, t in rows)
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_text, bags = {}, {}
    for i, t in rows:
        first = by_text.setdefault(_lower(t), i)
        parent[i] = first
        if first == i:
            bags[i] = shingle_bag(t)
    holders = {}
    for i, b in bags.items():
        for s in b:
            holders.setdefault(s, []).append(i)
    pairs = {(x, y) for h in holders.values() for x in h for y in h if x < y}
    for x, y in pairs:
        a, b = bags[x], bags[y]
        if find(x) != find(y) and like(a, b) >= similarity - 1e-9:
            lo, hi = sorted((find(x), find(y)))
            parent[hi] = lo
    return {i: find(i) for i, _ in rows}


_ALL = (1 << 64) - 1


def _mixed(x):
    """The finaliser of splitmix64."""
    x &= _ALL
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _ALL
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _ALL
    return x ^ (x >> 31)


def phrase_levels(text: bytes):
    """Locally consistent parsing, symbol by symbol: the names of the phrases of every level."""
    symbols, levels, rounds = list(text), [], 3
    while len(symbols) > 1:
        runs = []
        for s in symbols:
            if runs and runs[-1][0] == s:
                runs[-1][1] += 1
            else:
                runs.append([s, 1])
        names = [_mixed(s + 0x51ED270B7A1F4D1B * n) for s, n in runs]
        label = [s for s, _ in runs] if not levels else names
        for _ in range(rounds):
            tossed = [0]
            for left, x in zip(label, label[1:]):
                low = (left ^ x) & -(left ^ x)
                tossed.append(2 * (low.bit_length() - 1) + (1 if x & low else 0) if low else 16)  # only beside a start, whose label is 0
            label = tossed
        starts = [0] + [k for k in range(1, len(names) - 1) if label[k] > label[k - 1] and label[k] > label[k + 1]]
        if len(starts) > 1 and starts[1] == 1:
            del starts[1]
        symbols = [_mixed(sum(_mixed(names[k] + _mixed(k - a + 7)) for k in range(a, z))) for a, z in zip(starts, [*starts[1:], len(names)])]
        levels.append(symbols)
        rounds = 4
    return levels


def fingerprint(text: bytes, size=64, first_level=2):
    """The smallest hashes of a text's phrases; of the whole text where there is none so high."""
    found = {_mixed(s + k) for k, level in enumerate(phrase_levels(text)[first_level - 1 :]) for s in level}
    return sorted(found)[:size] or [int.from_bytes(hashlib.sha256(text).digest()[:8], "big")]


def print_likeness(a, b, size=64):
    """2 J / (1 + J) with J from the smallest hashes of the union."""
    union = sorted({*a, *b})[:size]
    common = len([x for x in union if x in a and x in b])
    return 2 * common / (len(union) + common)
