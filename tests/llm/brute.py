"""Plain versions of the operators, for small inputs."""

import hashlib
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeats(docs, width=20):
    """(n_words, n_removed, kept_sha256) by doc_id."""
    words = {d: WORD.findall(t or "") for d, t in docs}
    seen, out = set(), {}
    for d in sorted(words):
        w, gone = words[d], set()
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            if key in seen:
                gone |= set(range(i, i + width))
            seen.add(key)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(values, radius=3):
    """The smallest id reachable over pairs at `radius` or fewer bits, by id."""
    ids = list(values)
    head = {i: i for i in ids}

    def find(i):
        while head[i] != i:
            head[i] = head[head[i]]
            i = head[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (values[a] ^ values[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                head[y] = x
    return {i: find(i) for i in ids}


def contaminated(text, items, width=13):
    """Whether windows of the items cover a twentieth of the words or more."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    w, hit = words(low), set()
    windows = {tuple(b[i : i + width]) for _, t in items if (b := words(t)) for i in range(max(1, len(b) - width + 1))}
    for n in {len(x) for x in windows}:
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
    return bool(hit) and 20 * len(hit) >= len(w)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """The levels of a binary tree over hex digests, the lowest first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def proof(levels, i):
    """The siblings of node i, each with whether it stands on the left."""
    return [(level[(i >> h) ^ 1], bool(i >> h & 1)) if (i >> h) ^ 1 < len(level) else (None, False) for h, level in enumerate(levels[:-1])]


def merkle(rows):
    """Every (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), sorted by text."""
    import zlib

    def leaf(row, more=0):
        n = row["n_chars"]
        row = row | {"n_chars": None if n is None else n + more}
        return sha(*("-" if row[k] is None else f"{len(str(row[k]).encode())}:{row[k]}" for k in ("doc_id", "source", "lang", "n_chars", "text")))

    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    ordered = [sorted((r for r in rows if r["lang"] == x), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))) for x in langs]
    trees = [tree([leaf(r) for r in group]) for group in ordered]
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, group in enumerate(ordered):
        for i, row in enumerate(group):
            path = proof(trees[k], i) + proof(top, k)
            hit = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0
            now = leaf(row, 1 if hit else 0)
            for node, left in path:
                now = sha(now) if node is None else sha(node, now) if left else sha(now, node)
            root = top[-1][0]
            out.append((row["doc_id"], leaf(row), trees[k][-1][0], root, sha(*(n or "" for n, _ in path)), now, now == root))
    return sorted(out, key=str)


def ranked(docs, items, k):
    """(item_id, rank, doc_id, score) by item; docs: (doc_id, text), items: (item_id, text)."""
    import math
    from collections import Counter

    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    counts = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, query in asked.items():
        found = []
        for d, c in counts:
            score = 0
            for t in query & c.keys():
                m = 50 + 50 * c.total() * n_docs // n_terms
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(i, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)
