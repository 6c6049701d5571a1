"""Plain versions of what the operators decide, for small inputs."""

import hashlib
import re

from tessera.llm import linededup


def lower(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


def brute_components(pairs_of):
    sets = {}
    for d, t in pairs_of:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.setdefault(d, set()).add(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                top[max(p, q)] = min(p, q)
    return {d: find(d) for d in ids}, sets


def brute_hits(texts, items):
    out = []
    for t in texts:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        hit, found = set(), set()
        for item, text in items:
            b = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
            for s in range(max(1, len(b) - 9) if b else 0):
                g = b[s : s + 10]
                for p in range(len(w) - len(g) + 1):
                    if w[p : p + len(g)] == g:
                        hit |= set(range(p, p + len(g)))
                        found.add(str(item))
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def n_words(line):
    return len(re.findall(r"[^\x20\x09-\x0D]+", line))


def line_units(text, chunks=True):
    """(kind, key, first line, last line) of the chunks of two lines or more and of the shortest windows of more than 50 words."""
    lines = (text or "").split("\n")
    at = [i for i, x in enumerate(lines) if n_words(x)]
    h = [int(hashlib.md5(lines[i].encode()).hexdigest()[:8], 16) for i in at]
    out, begin = set(), 0
    for k in range(len(at) if chunks else 0):
        rolled = 0
        for back in (3, 2, 1, 0):
            rolled = (rolled * linededup.BASE + (h[k - back] if k >= back else 0)) % linededup.MODULUS
        run = k and h[k] == h[k - 1] or k + 2 < len(at) and h[k + 1] == h[k + 2]
        if k + 1 == len(at) or ((rolled < linededup.MODULUS // 4 or run) and h[k] != h[k + 1]):
            if k - begin >= 1:
                out.add((0, tuple(lines[i] for i in at[begin : k + 1]), at[begin], at[k]))
            begin = k + 1
    for k in range(len(at)):
        for step in (1, -1):
            j, total = k, 0
            while 0 <= j < len(at) and total <= 50:
                total += n_words(lines[at[j]])
                j += step
            if total > 50:
                a, b = sorted((k, j - step))
                out.add((1, tuple(lines[i] for i in at[a : b + 1]), at[a], at[b]))
    return out


def brute_lines(texts, chunks=True):
    """What stays of each text: units that stand at an earlier place go."""
    first, held = {}, [line_units(t, chunks) for t in texts]
    for d, units in enumerate(held):
        for kind, key, s, _ in units:
            first[kind, key] = min(first.get((kind, key), (d, s)), (d, s))
    out = []
    for d, (t, units) in enumerate(zip(texts, held, strict=True)):
        gone = {i for kind, key, s, e in units if first[kind, key] != (d, s) for i in range(s, e + 1)}
        out.append("\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in gone))
    return out


def brute_longest(texts, items):
    """The most words in a row that each text shares with an item, and where so many begin first."""
    out = []
    for t in texts:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        best, at = 0, -1
        for _, text in items:
            b = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
            row = [0] * (len(b) + 1)
            for i in range(len(w) - 1, -1, -1):
                row = [row[j + 1] + 1 if w[i] == b[j] else 0 for j in range(len(b))] + [0]
                if row and max(row) and (max(row), -i) > (best, -at):
                    best, at = max(row), i
        out.append((best, at))
    return out
