"""Plain versions of the operators, by the contracts' words, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near_duplicates(docs):
    """{doc_id: (n_shingles, component_id)}"""
    sets = {d: shingles(t) for d, t in docs}
    where, parent = defaultdict(list), {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d in sorted(sets):
        shared = Counter(e for s in sets[d] for e in where[s])
        for s in sets[d]:
            where[s].append(d)
        for e, same in shared.items():
            if 100 * same >= 75 * (len(sets[d]) + len(sets[e]) - same):
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), root(d)) for d in sets}


def passages(docs, length=100):
    """{doc_id: (n_bytes, n_removed, n_spans, kept_sha256)}"""
    seen, out = set(), {}
    for d, t in sorted(docs):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def contaminated(docs, items, n=10):
    """ids of documents that have a window of an item"""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))
    windows = {tuple(w[i : i + n]) for _, t in items for w in [words(t)] if w for i in range(max(1, len(w) - n + 1))}
    sizes = {len(w) for w in windows}
    return {d for d, t in docs for w in [words(t)] if any(tuple(w[i : i + k]) in windows for k in sizes for i in range(len(w) - k + 1))}
