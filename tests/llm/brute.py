"""Plain Python versions of the operators' definitions, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingle_set(text, size):
    w = BLANK_WORD.findall(lower(text))
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def components(rows, size):
    """{doc_id: (n, smallest id that links reach)} of (doc_id, text) with distinct ids."""
    sets = {d: shingle_set(t, size) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in ids}


def contamination(text, items, window=10):
    """(words, hits, items, sha256) of a text against (item_id, text)."""
    w = TERM.findall(lower(text))
    hit, named = set(), set()
    for item, body in items:
        t = TERM.findall(lower(body))
        n = min(window, len(t))
        for k in range(len(t) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == t[k : k + n]:
                    hit |= set(range(i, i + n))
                    named.add(item)
    return len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(map(str, named))).encode()).hexdigest()


def counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = BLANK_WORD.findall(text)
    triples = list(zip(w, w[1:], w[2:]))
    often = Counter(triples)
    covered = {j for i, t in enumerate(triples) if often[t] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if BLANK_WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def kneser_ney(counts, order, discount, limits):
    """p(lang, gram) of interpolated Kneser-Ney models from {(lang, gram): n}, and the languages."""
    langs = sorted({k for k, _ in counts})
    alphabet = len({c for _, g in counts for c in g} | {" "}) + 1
    levels = {order: dict(counts)}
    for o in range(order - 1, 0, -1):
        levels[o] = Counter((k, g[1:]) for k, g in levels[o + 1])
    d = {}
    for o in levels:
        for k in langs:
            seen = Counter(n for (l, _), n in levels[o].items() if l == k)
            d[o, k] = max(limits[0], min(limits[1], seen[1] / (seen[1] + 2 * seen[2]))) if seen[1] and seen[2] else discount

    def p(k, gram):
        if not gram:
            return 1 / alphabet
        o, lower = len(gram), p(k, gram[1:])
        beside = [n for (l, g), n in levels[o].items() if l == k and g[:-1] == gram[:-1]]
        if not beside:
            return lower
        own = levels[o].get((k, gram), 0)
        return max(own - d[o, k], 0) / sum(beside) + d[o, k] * len(beside) / sum(beside) * lower

    return p, langs


def secret_candidates(text, path, m):
    """(token, features) of all candidates of a text, in order; ``m`` holds the constants."""
    import regex

    candidate, assigned = regex.compile(m.CANDIDATE), regex.compile(m.ASSIGNED)
    out = []
    tokens = [regex.sub(r"^[.@]+|[.@]+$", "", t) for t in regex.split(m.APART.replace("\\x{10FFFF}", "\U0010ffff"), text)]
    for i, t in enumerate(tokens):
        for found in candidate.finditer(t):
            own = regex.search(m.LAST, t[: t.find(found[0])])
            b = own[1] if own else tokens[i - 1] if i else ""
            bb = tokens[i - 1 if own else i - 2] if i >= (1 if own else 2) else ""
            out.append((found[0], b, bb, tokens[i + 1] if i + 1 < len(tokens) else "", False))
    out += [(f[3], f[1], "", "", True) for f in assigned.finditer(text) if not candidate.search(f[3])]
    return [(o[0], _secret_features(*o, path, m)) for o in out]


def _secret_features(t, b, bb, a, assigned, path, m):
    n = max(len(t), 1)
    share = lambda ok: sum(map(ok, t)) / n
    kinds = ["l" if "a" <= c <= "z" else "u" if "A" <= c <= "Z" else "d" if "0" <= c <= "9" else "" for c in t]
    says = lambda words: any(re.search(rf"(^|[_\-.])({'|'.join(words)})$", x.lower()) for x in (b, bb))
    low, covered, i = t.lower(), 0, 0
    while i < len(low):
        k = max((len(w) for w in m.WORDS if low.startswith(w, i)), default=0)
        covered, i = covered + k, i + max(k, 1)
    key = lambda c: c.isascii() and (c.isalnum() or c in "_+/-")
    return [
        float(n),
        share(lambda c: "0" <= c <= "9"),
        share(lambda c: "A" <= c <= "Z"),
        sum(x != y and x != "" and y != "" for x, y in zip(kinds, kinds[1:])) / n,
        sum(low[i : i + 2] in m.PAIRS for i in range(len(low))) / n,
        len(set(t)) / n,
        covered / n,
        float(bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", t))),
        float(bool(re.fullmatch(r"[0-9+\-]+", t))),
        share(lambda c: c == "/"),
        share(lambda c: c == "-"),
        float(says(m.ANNOUNCES)),
        float(says(m.DENIES) or a.lower() in m.DENIES),
        float(bool(re.search("test|example|sample|fixture|docs?/", (path or "").lower()))),
        float(t.startswith(m.PREFIXES)),
        1 - share(key),
        float(assigned),
    ]
