"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)]) if w else frozenset()


def components(rows):
    sets = collections.defaultdict(list)
    for d, t in rows:
        sets[shingles(t)].append(d)
    keys = [s for s in sets if s]
    top = {d: d for d, _ in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)

    for s in keys:
        for d in sets[s]:
            join(sets[s][0], d)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            n = len(a & b)
            if 100 * n >= 80 * (len(a) + len(b) - n):
                join(sets[a][0], sets[b][0])
    return {d: (len(shingles(t)), find(d)) for d, t in rows}


def repeats(rows, length=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            first[w] = min(d, first.get(w, d))
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        out[d] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(x for x, y in zip(b, gone, strict=True) if not y)).hexdigest())
    return out


def item_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def leaks(docs, items, window=10):
    windows = {}
    for i, t in items:
        w = item_words(t)
        k = min(window, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[j : j + k]), set()).add(i)
    sizes = {len(w) for w in windows}
    out = {}
    for d, t in docs:
        w = item_words(t)
        hit, found = [0] * len(w), set()
        for k in sizes:
            for j in range(len(w) - k + 1):
                if x := windows.get(tuple(w[j : j + k])):
                    found |= x
                    hit[j : j + k] = [1] * k
        out[d] = (len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), sum(hit) > 0)
    return out


def line_tokens(line):
    w = re.findall(r"[^ \t\x0b\x0c\r]+", line.lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def removed(rows):
    seen = sorted((d, i, line_tokens(x)) for d, t in rows if t is not None for i, x in enumerate(t.split("\n")) if line_tokens(x))
    out = collections.defaultdict(set)
    for a, (d, i, x) in enumerate(seen):
        for e, j, y in seen[:a]:
            n = len(x & y)
            if (e, j) < (d, i) and 100 * n >= 80 * (len(x) + len(y) - n):
                out[d].add(i)
                break
    return out


SECRETS = (("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]+", 0, 16))


def secrets(t):
    spans = sorted((m.start(), i, m.end(), k) for i, (k, p, g, n) in enumerate(SECRETS) for m in re.finditer(p, t or "") if len(m[g]) >= n)
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
