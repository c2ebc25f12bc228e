"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def without_repeats(rows, size=20):
    """[(id, text)] in order of precedence -> [(words, removed, kept text)]."""
    seen, out = set(), []
    for _, text in rows:
        w = WORDS.findall(text or "")
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            if key in seen:
                gone[k : k + size] = [True] * size
            seen.add(key)
        out.append((len(w), sum(gone), " ".join(a for a, g in zip(w, gone, strict=True) if not g)))
    return out


def shingles(text, size=5):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m.group(0).lower(), text or ""))
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def near_components(rows):
    """[(id, text)] of distinct ids -> {id: (set size, component)}."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders, shared = defaultdict(list), Counter()
    for i, s in sets.items():
        for x in s:
            for j in holders[x]:
                shared[j, i] += 1
            holders[x].append(i)
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group(0))
            good = {"email": True, "ip": all(int(p) <= 255 for p in m.group(0).split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}
            if good[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def targets(sizes, weights=(5, 2, 1), most=3):
    """{source: size} -> {source: target}, by handing the excess round until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        open_ = sum(w[s] for s in w if s not in capped)
        got = {s: most * sizes[s] if s in capped else rest * w[s] / open_ for s in w}
        over = {s for s in w if s not in capped and got[s] > most * sizes[s]}
        if not over:
            return got
        capped |= over
