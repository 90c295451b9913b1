"""Plain Python versions of the operators' contracts."""

import hashlib
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def secrets(text):
    text = text or ""
    rules = [
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
        ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18),
        ("hex", re.compile("[0-9a-f]+"), 0, 16),
    ]
    found = [(m.start(), no, m.end(), kind) for no, (kind, rx, g, least) in enumerate(rules) for m in rx.finditer(text) if len(m[g]) >= least]
    found.sort()
    base = ",".join(f"{k}:{s}:{e}" for s, _, e, k in found)
    return (*(sum(f[1] == i for f in found) for i in range(3)), sha(base)), base


def rules(text):
    text = text or ""
    w = WORD.findall(text)
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    rep = {i + d for v in at.values() if len(v) > 1 for i in v for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)


def ascii_lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))


def overlaps(text, items, size=10):
    w = bench_words(text)
    wins = {}
    for item_id, item in items:
        v = bench_words(item)
        for i in range(max(1, len(v) - size + 1)) if v else ():
            wins.setdefault(tuple(v[i : i + size]), set()).add(str(item_id))
    hit, found = set(), set()
    for n in {len(x) for x in wins}:
        for i in range(len(w) - n + 1):
            if (win := tuple(w[i : i + n])) in wins:
                hit.update(range(i, i + n))
                found |= wins[win]
    return len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)


def fingerprint(text):
    w = ascii_lower(text)
    w = WORD.findall(w)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def pair_prints(text, n=8, k=2):
    w = WORD.findall(ascii_lower(text))
    if not w:
        return (0,) * n
    k = min(k, len(w))
    shingles = {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)}
    ones = [0] * (64 * n)
    for s in shingles:
        data = b"".join(xxhash.xxh128(s.encode(), seed=42 + j).digest() for j in range((n + 1) // 2))
        for b in range(64 * n):
            ones[b] += data[b // 8] >> b % 8 & 1
    return tuple(sum(1 << b for b in range(64) if 2 * ones[64 * i + b] > len(shingles)) for i in range(n))


def near(a, b, bits=3):
    """Whether fingerprints, or any of several in turn, differ in so few bits."""
    if isinstance(a, tuple):
        return any((x ^ y).bit_count() <= bits for x, y in zip(a, b, strict=True))
    return (a ^ b).bit_count() <= bits


def components(prints, bits=3, linked=None):
    """prints: {doc_id: fingerprint, or several} -> {doc_id: smallest reachable}."""
    ids, own = sorted(prints), {}
    linked = linked or (lambda a, b: near(a, b, bits))
    for i in ids:
        if i in own:
            continue
        own[i], todo = i, [i]
        while todo:
            a = todo.pop()
            for b in ids:
                if b not in own and linked(prints[a], prints[b]):
                    own[b] = i
                    todo.append(b)
    return own


def fives(text):
    w = WORD.findall(ascii_lower(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def text_groups(texts, bits=4, agree=0.6):
    """{doc_id: text} -> {doc_id: smallest of its group}: linked by any of their prints, and with as many five-word shingles in common."""
    prints = {i: (pair_prints(t), fives(t)) for i, t in texts.items()}

    def linked(a, b):
        (p, s), (q, t) = a, b
        return p == q or near(p, q, bits) and len(s & t) >= agree * len(s | t)

    return components(prints, linked=linked)
