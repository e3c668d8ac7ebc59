"""Plain Python versions of the operators, written from their definitions."""

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    text = text or ""
    if lower:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return WORD.findall(text)


def shingles(text, k=5):
    w = words(text, lower=True)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(docs):
    """doc_id -> (shingles, component) for unique ids."""
    sets = {d: shingles(t) for d, t in docs}
    top = {d: d for d in sets}

    def root(d):
        while top[d] != d:
            d = top[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def contained(docs, items):
    out = []
    for d, t in docs:
        own = shingles(t)
        for i, x in items:
            want = shingles(x)
            if want and 100 * len(own & want) >= 75 * len(want):
                out.append((d, i, len(want), len(own & want)))
    return out


def counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text, w = text or "", words(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def base_failed(text):
    n, _, _, _, repeat = counts(text)
    return n < 20 or 100 * repeat > 30 * n


def deleted_lines(docs, least=5):
    """Line numbers to delete, by doc_id; any run of up to `least` lines with enough words that stands earlier too."""
    seqs = {d: [(i, x, len(words(x))) for i, x in enumerate(t.split("\n")) if WORD.search(x)] for d, t in docs if t is not None}
    first, gone = {}, defaultdict(set)
    longest = max([len(s) for s in seqs.values()] or [0])
    for k in range(1, min(longest, 3 * least) + 1):
        for d in sorted(seqs):
            s = seqs[d]
            for i in range(len(s) - k + 1):
                run = tuple(x for _, x, _ in s[i : i + k])
                if sum(n for *_, n in s[i : i + k]) >= least and first.setdefault(run, (d, i)) != (d, i):
                    gone[d] |= {n for n, *_ in s[i : i + k]}
    return gone


def without_lines(text, gone):
    return text if text is None or not gone else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def entities(text):
    def good(kind, value):
        digits = re.sub("[^0-9]", "", value)
        if kind == "ip":
            return all(int(p) <= 255 for p in value.split("."))
        if kind == "card":
            return 13 <= len(digits) <= 19 and luhn(digits)
        return kind == "email" or 9 <= len(digits) <= 15

    return {k: [(m.start(), m.end()) for m in re.finditer(r, text or "") if good(k, m[0])] for k, r in BASE.items()}


def mix(rows, weights=(3, 1, 2), share=1.5, most=2.0, seed="mix"):
    """rows: (doc_id, text, source) -> list of (doc_id, size, source_size, target, copies)."""
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(words(t))
    order = sorted([s for s in size if s is not None]) + [s for s in size if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    goal, full, target = share * sum(size.values()), set(), {}
    while True:
        rest = [s for s in order if s not in full]
        left = goal - sum(most * size[s] for s in full)
        target = {s: most * size[s] if s in full else left * weight[s] / sum(weight[r] for r in rest) for s in order}
        over = {s for s in rest if target[s] >= most * size[s]}
        if not over:
            break
        full |= over
        if len(full) == len(order):
            target = {s: most * size[s] for s in order}
            break
    out = []
    for s in order:
        key = "1" if s is None else "0" + s
        offs = [int(hashlib.md5(f"{seed}:{j}:{key}".encode()).hexdigest()[:8], 16) / 2**32 for j in range(64)]
        mine = sorted(((len(words(t)), d) for d, t, x in rows if x == s), key=lambda r: (-r[0], r[1] is None, (r[1] or 0) % 64, r[1] or 0))
        rate = target[s] / size[s] if size[s] else 0.0
        copies = [[math.floor(k * rate + u) - math.floor((k - 1) * rate + u) for k in range(1, len(mine) + 1)] for u in offs]
        chosen = min(copies, key=lambda c: abs(sum(x * n for x, (n, _) in zip(c, mine, strict=True)) - target[s]))
        out += [(d, n, size[s], target[s], c) for (n, d), c in zip(mine, chosen, strict=True)]
    return out


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
    return row[-1]


def bootstrapped(rows, support=5, least=0.9):
    """Documents whose number, not a base entity, is taken. Each text has one number, after two words or more."""
    seen = []
    for d, text in rows:
        base = entities(text)["phone"]
        found = base[0] if base else (m.span() if (m := re.search(r"\S*\d\S*", text)) else None)
        value = text[slice(*found)]
        fits = re.fullmatch(r"\(?[0-9](?:[ ()./-]{0,2}[0-9]){8,14}", value)
        before = text[: found[0]].split()
        seen.append((d, {before[-1], " ".join(before[-2:])}, value, bool(base), bool(base or fits)))
    confidence = {v: 1.0 for _, _, v, base, _ in seen if base}
    of = defaultdict(dict)
    for _, patterns, v, base, fits in seen:
        for p in patterns:
            of[p][v] = fits
    for _ in range(100):
        chance = {}
        for p, values in of.items():
            known = [confidence[v] for v, fits in values.items() if fits and v in confidence]
            if sum(c >= least for c in known) >= support and sum(known) / len(values) >= 0.5:
                chance[p] = sum(known) / len(values)
        new = {v: c for v, c in confidence.items() if c == 1.0}
        for v in {v for _, _, v, base, fits in seen if fits and not base}:
            of_v = {p for _, patterns, w, _, _ in seen if w == v for p in patterns if p in chance}
            if of_v:
                new[v] = max(new.get(v, 0), 1 - math.prod(max(1 - chance[p], 1e-6) for p in of_v))
        if new == confidence:
            break
        confidence = new
    return {d for d, _, v, base, _ in seen if not base and confidence.get(v, 0) >= least}
