"""Brute-force versions of operators that several test files use."""

import re


def brute_components(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in rows]
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    return [(rows[a][0], len(sets[a]), min((rows[b][0] for b in range(len(rows)) if find(b) == find(a) and rows[b][0] is not None), default=None)) for a in range(len(rows))]
