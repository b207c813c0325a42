"""Plain versions of operators, for small inputs."""

import re

import regex


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x or "")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def closed(nodes, linked):
    top = {k: k for k in nodes}

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    for k, a in enumerate(nodes):
        for b in nodes[:k]:
            if find(a) != find(b) and linked(a, b):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {k: find(k) for k in nodes}


def components(sets):
    def linked(a, b):
        i = len(sets[a] & sets[b])
        return bool(i) and 100 * i >= 80 * len(sets[a] | sets[b])

    return closed(sorted(sets), linked)


def windows_hit(text, items, window=10):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t).encode())
    known = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            known.setdefault(tuple(w[k : k + window]), set()).add(i)
    w = words(text)
    hit, own = [False] * len(w), set()
    for n in {len(k) for k in known}:
        for k in range(len(w) - n + 1):
            found = known.get(tuple(w[k : k + n]))
            if found:
                own |= found
                hit[k : k + n] = [True] * n
    return len(w), sum(hit), own


def line_forms(text):
    return [x.strip(" ") for x in regex.sub(r"[^\p{L}\p{M}\p{N}\n]+", " ", text.lower()).split("\n")]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def fuzzy_groups(forms):
    """Components of forms of edit similarity 0.8 at least."""
    return closed(forms, lambda a, b: edit_distance(a, b) <= int(max(len(a), len(b)) * 0.2 + 1e-9))
