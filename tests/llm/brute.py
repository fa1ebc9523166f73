"""Plain loops that say what the operators must give."""

import base64
import hashlib
import re
from collections import defaultdict

import regex


def repeats(docs, length=50):
    """(id, n_bytes, n_removed, n_spans, sha256 of what is left) of (id, text)."""
    first = {}
    data = [(i, (t or "").encode()) for i, t in docs]
    for i, b in data:
        if i is not None:
            for p in range(len(b) - length + 1):
                k = b[p : p + length]
                first[k] = min(first.get(k, i), i)
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        if i is not None:
            for p in range(len(b) - length + 1):
                if first[b[p : p + length]] < i:
                    gone[p : p + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text, size=5):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def near(docs, percent=85):
    """(id, n_shingles, component, kept) of (id, text) with distinct ids, from all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in docs}
    having = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            having[x].append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    shared = defaultdict(int)
    for ids in having.values():
        for n, a in enumerate(ids):
            for b in ids[:n]:
                shared[a, b] += 1
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [(i, len(s), find(i), find(i) == i) for i, s in sets.items()]


def archive(pages):
    """(id, bytes, digest, type, refers_to) of (id, html)."""
    rows = [(i, (h or "").encode()) for i, h in pages]
    last = {}
    for i, b in rows:
        if i is not None:
            last[b] = max(last.get(b, i), i)
    out = []
    for i, b in rows:
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        keep = last.get(b)
        out.append((i, len(b), digest, *(("response", None) if keep == i or keep is None else ("revisit", keep))))
    return out


def mixture_targets(sizes, weights=(5, 2, 1), share=1.0, cap=3.0):
    """Targets by source of sizes by source, by giving out what is left again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free = dict.fromkeys(names, 0.0), set(names)
    left = share * sum(sizes.values())
    while free and left > 1e-9:
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] += left * weight[s] / total
        over = {s for s in free if target[s] > cap * sizes[s]}
        left = sum(target[s] - cap * sizes[s] for s in over)
        for s in over:
            target[s] = cap * sizes[s]
        free -= over
    return target


def template_tokens(text, units):
    """(kind, value) of the tokens of a text: n, a and u are numbers, names and units, w are words."""
    found = []
    pattern = regex.compile(
        rf"(?<number>(?<![\p{{L}}\p{{N}}])\p{{N}}+(?:[.,]\p{{N}}+)*(?: ?(?<unit>(?i:{units})))?(?![\p{{L}}\p{{N}}]))"
        r"|(?<name>(?<=[\p{Ll}\p{N},] )\p{Lu}\p{Ll}+(?![\p{L}\p{N}]))|(?<word>[\p{L}\p{N}]+)"
    )
    for m in pattern.finditer(text or ""):
        if m["number"]:
            value = m["number"][: len(m["number"]) - len(m["unit"] or "")].strip()
            found.append(("n", re.sub("[.,]", "", value)))
            if m["unit"]:
                found.append(("u", m["unit"].lower()))
        elif m["name"]:
            found.append(("a", m["name"].lower()))
        else:
            found.append(("w", m["word"].lower()))
    return found


def contaminated(docs, items, units, width=10):
    """Pairs (id, item) of (id, text) and (item, text) that share a window.

    Windows of up to half slots match by their template, others by their literal words only. In windows at one distance
    a name stands for one name, and different ones for different ones; else only windows with the item's values count.
    """

    def slots(window):
        return sum(k != "w" for k, _ in window)

    def template(window):
        return tuple((k, "" if k != "w" else v) for k, v in window)

    templates, literals = defaultdict(set), defaultdict(set)
    for item, text in items:
        tokens = template_tokens(text, units)
        for variant in (tokens, [("w", v) if k == "a" else (k, v) for k, v in tokens]):
            size = min(width, len(variant))
            for p in range(len(variant) - size + 1 if size else 0):
                window = variant[p : p + size]
                if 2 * slots(window) <= size:
                    templates[template(window)].add((item, p, tuple(window)))
                if 2 * (slots(window) + 1) > size:
                    literals[tuple(v for _, v in window)].add((item, p))
    sizes = {len(t) for t in templates} | {len(t) for t in literals}
    met = defaultdict(list)
    for doc, text in docs:
        tokens = template_tokens(text, units)
        for size in sizes:
            for p in range(len(tokens) - size + 1):
                window = tokens[p : p + size]
                for item, at, theirs in templates.get(template(window), ()):
                    names = {(v, u) for (k, v), (_, u) in zip(theirs, window, strict=True) if k == "a"}
                    met[doc, item, p - at].append((theirs == tuple(window), names))
                if 2 * slots(window) > size:
                    for item, at in literals.get(tuple(v for _, v in window), ()):
                        met[doc, item, p - at].append((True, set()))
    good = set()
    for (doc, item, _), windows in met.items():
        both = set().union(*(names for _, names in windows))
        fits = len(both) == len({a for a, _ in both}) == len({b for _, b in both})
        if fits or any(own for own, _ in windows):
            good.add((doc, item))
    return good
