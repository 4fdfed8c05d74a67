"""Plain restatements of the contracts, for small fixtures."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, width=5):
    w = WORD.findall(lower_ascii(text or ""))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def components(docs):
    """(doc_id, set size, component, links to other texts, copies) of each row by looking at every pair of sets that shares a shingle."""
    classes = defaultdict(list)
    for d, t in docs:
        classes[frozenset(shingles(t))].append(d)
    sets = list(classes)
    lists = defaultdict(list)
    root, links = list(range(len(sets))), Counter()

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j, inter in Counter(j for x in s for j in lists[x]).items():
            if 100 * inter >= 75 * (len(s) + len(sets[j]) - inter):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
        for x in s:
            lists[x].append(i)
    least = {}
    for i, s in enumerate(sets):
        ids = [d for d in classes[s] if d is not None]
        if ids:
            least[find(i)] = min(least.get(find(i), ids[0]), *ids)
    out = []
    for i, s in enumerate(sets):
        for d in classes[s]:
            out.append((d, len(s), least.get(find(i)), links[i], len(classes[s]) - 1) if s else (d, 0, d, 0, 0))
    return sorted(out, key=str)
