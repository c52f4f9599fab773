"""Plain-Python versions of the corpus operators, for small inputs."""
import hashlib
import itertools
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def targets(rows, weights=(1, 2, 3), ceiling=3):
    """rows: (id, text, source). Source -> (size, target)."""
    size = Counter()
    for _, text, source in rows:
        size[source] += len(words(text))
    names = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = sum(size.values()), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > ceiling * size[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            out[s] = ceiling * size[s]
            free.discard(s)
            left -= out[s]
    return {s: (size[s], out[s]) for s in names}


def removed_spans(rows, span=50):
    """rows: (id, text); null ids last. One (id, n_words, n_removed, kept_sha256) per row."""
    order = {i: (i is None, i or 0) for i, _ in rows}
    first = {}
    for i, text in rows:
        w = words(text)
        for p in range(len(w) - span + 1):
            key = tuple(w[p : p + span])
            first[key] = min(first.get(key, order[i]), order[i])
    out = []
    for i, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for p in range(len(w) - span + 1):
            if first[tuple(w[p : p + span])] < order[i]:
                gone[p : p + span] = [True] * span
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingle_set(text, n=5):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) or frozenset([tuple(w)])


def jaccard_classes(rows, threshold=0.8):
    """rows: (id, text), ids distinct. id -> (class id, links)."""
    sets = {i: shingle_set(t) for i, t in rows}
    links, root = Counter(), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    places = defaultdict(set)
    for i, s in sets.items():
        for g in s:
            places[g].add(i)
    pairs = {p for ids in places.values() for p in itertools.combinations(sorted(ids), 2)}
    for a, b in pairs:
        if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in sets}


def edits_in(item, text):
    """Fewest edits between a list of words and any run of another."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def base_phrases(text, phrases):
    """n_words, places and labels of phrases that stand word by word."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in phrases:
        p = phrase.split()
        at = [k for k in range(len(w)) if w[k : k + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))
