"""Plain versions of the base columns and of the exact joins."""

from collections import Counter

from hearthline.llm import mixing


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def components(ids, pairs):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingle_set(text, k=4):
    words = [w.decode() for w in lower(text or "").encode().split()]
    if 0 < len(words) < k:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def jaccard_components(rows, percent=85, k=4):
    """rows of (doc_id, text): per row (doc_id, size, component); a row is placed by its own text."""
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    least = {}
    for i, s in sets:
        if s and i is not None:
            least[s] = min(i, least.get(s, i))
    nodes, pairs = list(least), []
    for a, s in enumerate(nodes):
        for b in range(a):
            o = len(s & nodes[b])
            if 100 * o >= percent * (len(s) + len(nodes[b]) - o):
                pairs.append((a, b))
    c, first = components(range(len(nodes)), pairs), {}
    for a, s in enumerate(nodes):
        first[c[a]] = min(least[s], first.get(c[a], least[s]))
    at = {s: first[c[a]] for a, s in enumerate(nodes)}
    return [(i, len(s), at[s] if s and i is not None else i) for i, s in sets]


def base_quality(text):
    t = text or ""
    w = t.encode().split()
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    repeated = set()
    for i in range(len(w) - 7):
        if windows[tuple(w[i : i + 8])] > 1:
            repeated.update(range(i, i + 8))
    lines = [x for x in t.split("\n") if x.encode().split()]
    n = len(w)
    return n, sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated), n < 20 or 100 * len(repeated) > 30 * n


def mix_order(n_rows):
    """Sort key of a source's rows (with `key` and `doc_id`) in their shuffled order."""
    bins = max(1, min(1 << 16, n_rows // mixing.BIN_ROWS))
    return lambda x: (x.key % bins, x.key, x.doc_id)


def word_times(source, size, target):
    """How often each word of a source's line is taken: its slots walked one by one."""
    block = max(mixing.LEAST_BLOCK, min(mixing.MOST_BLOCK, sum(size.values()) // mixing.BLOCKS))
    words = max(1, round(target[source])) if target[source] > 0 else 0
    length = min(block, max(1, -(-words // mixing.LEAST_SLOTS)))
    blocks = -(-size[source] // length)
    times, left, place = [0] * (blocks * length), words, 0
    while left > 0:
        first = place % blocks * length
        whole = min(length, size[source] - first)
        for x in range(first, first + min(whole, left)):
            times[x] += 1
        left, place = left - min(whole, left), place + 1
    return times
