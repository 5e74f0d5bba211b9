"""Plain Python versions of what the operators do."""

import re


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def shingle_set(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def near_classes(rows, k=4):
    """{doc_id: (set size, smallest reachable id)} of (doc_id, text) rows, by an inverted index."""
    sets = {i: shingle_set(t, k) for i, t in rows}
    by, parent = {}, {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in sorted(sets):
        common = {}
        for s in sets[i]:
            for j in by.setdefault(s, []):
                common[j] = common.get(j, 0) + 1
            by[s].append(i)
        for j, n in common.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def kept_after_repeats(texts, span):
    """(bytes kept, bytes removed, runs removed) of each text."""
    import collections

    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(x[i : i + span] for x in raw for i in range(len(x) - span + 1))
    out = []
    for x in raw:
        gone = bytearray(len(x))
        for i in range(len(x) - span + 1):
            if seen[x[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        out.append((bytes(b for b, g in zip(x, gone) if not g), sum(gone), len(re.findall(b"\1+", bytes(gone)))))
    return out
