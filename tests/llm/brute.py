"""Brute-force versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


RULES = [
    (
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]


def secrets(text):
    text = text or ""
    found = []
    for order, (kind, regex, group, least) in enumerate(RULES):
        for m in re.finditer(regex, text):
            if len(m.group(group)) >= least:
                found.append((m.start(), order, m.end(), kind))
    return sorted(found)


def secret_row(doc_id, text):
    found = secrets(text)
    count = Counter(f[3] for f in found)
    joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in found)
    return (doc_id, count["assign"], count["access"], count["hex"], sha(joined))


def chat_row(conv_id, turns):
    """turns: (turn, role, text), sorted."""
    turns = [(r or "", t or "") for _, r, t in turns]
    told = "".join(f"{r}\n{t}\n" for r, t in turns)
    learnt = "".join(t for r, t in turns if r == "assistant")
    return (conv_id, len(turns), sha(told), len(learnt), sha(learnt))


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def quality_row(doc_id, text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {
        i + k
        for i, w in enumerate(zip(words, words[1:], words[2:]))
        if windows[w] > 1
        for k in range(3)
    }
    n = len(words)
    return (
        doc_id,
        n,
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        dup,
        len(covered),
        n < 50 or 100 * len(covered) > 50 * n,
    )


def fingerprint(text):
    import xxhash

    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    """Smallest node reachable; linked(a, b) tells of a link."""
    nodes = sorted(nodes)
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def simhash_rows(docs):
    prints = {d: fingerprint(t) for d, t in docs}
    groups = components(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    return sorted((d, f"{prints[d]:016x}", groups[d]) for d in prints)


def ids_of(vocabulary, text, end):
    import public_tokenizers
    from tokenizers import Tokenizer

    if vocabulary not in KEPT:
        KEPT[vocabulary] = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    return [*KEPT[vocabulary].encode(text or "", add_special_tokens=False).ids, end]


KEPT = {}


def crc(ids):
    import zlib

    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def raked(cells, targets, sweeps):
    """cells: {(v1, v2, ..): tokens}; targets: one {value: share} for each margin."""
    weights = {c: float(n) for c, n in cells.items()}
    for _ in range(sweeps):
        for m, target in enumerate(targets):
            held = Counter()
            for c, w in weights.items():
                held[c[m]] += w
            weights = {c: w * target[c[m]] / held[c[m]] if held[c[m]] else 0.0 for c, w in weights.items()}
    return weights


def clipped(cells, weights, keep):
    """{cell: probability}: the factor found by halving."""
    wanted, low, high = keep * sum(cells.values()), 0.0, 1e12
    for _ in range(400):
        middle = (low + high) / 2
        if sum(min(n, middle * weights[c]) for c, n in cells.items()) < wanted:
            low = middle
        else:
            high = middle
    return {c: min(1.0, high * weights[c] / n) if n else 0.0 for c, n in cells.items()}


def top(rows, asked, k, scale=64):
    """rows: (id, vector); (query_id, rank, id, score)."""
    import math

    whole = {i: [math.floor(scale * float(x)) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    found = []
    for q in whole:
        if asked(q):
            scores = [(-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q]
            found += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(found)


def substring_rows(docs, window=20):
    """docs: (doc_id, text); null ids come first."""
    seen, found = set(), []
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        words = WORD.findall(text or "")
        gone = set()
        for i in range(len(words) - window + 1):
            own = tuple(words[i : i + window])
            if own in seen:
                gone.update(range(i, i + window))
            seen.add(own)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        found.append((doc_id, len(words), len(gone), sha(kept)))
    return found
