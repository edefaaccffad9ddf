"""Plain Python versions of the corpus operators, for comparison."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = Counter(windows)
    hit = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(5)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w))


def fingerprint(text):
    w = WORD.findall(lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(pairs_of, nodes):
    """nodes: iterable of ids. pairs_of: links."""
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs_of:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    return {x: find(x) for x in root}


def simhash(rows):
    """rows: (doc_id, text). To (doc_id, hex, component)."""
    fps = [(i, fingerprint(t)) for i, t in rows]
    least = {}
    for i, f in fps:
        least[f] = min(least.get(f, i), i)
    distinct = list(least)
    links = [(least[a], least[b]) for n, a in enumerate(distinct) for b in distinct[:n] if bin(a ^ b).count("1") <= 2]
    root = components(links, least.values())
    return [(i, f"{f:016x}", root[least[f]]) for i, f in fps]


TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(docs, items, size=10):
    windows = defaultdict(set)
    for item, text in items:
        w = TERM.findall(lower(text))
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(str(item))
    sizes = {len(x) for x in windows}
    out = []
    for doc, text in docs:
        w = TERM.findall(lower(text))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[x]
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def chat(rows):
    """rows: (conv_id, turn, role, text). To (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256)."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role or "", text or ""))
    out = []
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss)))
    return out


def substring(rows, min_words=5):
    """rows: (doc_id, text). To {doc_id: [(start, end)]}."""
    seen, out = set(), {}
    for doc, text in sorted((i, t or "") for i, t in rows):
        at, gone = 0, []
        for line in text.split("\n"):
            unit = re.sub(r"\s+", " ", line).strip().lower()
            if len(unit.split(" ")) >= min_words and unit:
                if unit in seen:
                    gone.append((at, at + len(line)))
                seen.add(unit)
            at += len(line) + 1
        out[doc] = gone
    return out


def shared_lines(rows, min_words=3):
    """rows: (doc_id, text), distinct ids. To {doc_id: lines that an earlier document holds}."""
    first, out = {}, {}
    for doc, text in sorted((i, t or "") for i, t in rows):
        lines = [x.strip(" ") for x in text.split("\n")]
        out[doc] = {k for k, x in enumerate(lines) if len(x.split()) >= min_words and first.get(x, doc) != doc}
        for x in lines:
            first.setdefault(x, doc)
    return out


def unique_anchors(a, b):
    """Longest run of the items that both hold once, by a quadratic table; of equal ones the latest."""
    both = [(i, b.index(x)) for i, x in enumerate(a) if a.count(x) == 1 and b.count(x) == 1]
    length, before = [], []
    for k, (_, y) in enumerate(both):
        best = max([length[j] for j in range(k) if both[j][1] < y], default=0)
        length.append(best + 1)
        before.append(max((j for j in range(k) if both[j][1] < y and length[j] == best), default=-1))
    k = max(range(len(both)), key=lambda j: (length[j], j), default=-1)
    out = []
    while k >= 0:
        out.append(both[k])
        k = before[k]
    return out[::-1]


def subsequence(a, b):
    """A longest common subsequence, by the full table."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    out, i, j = [], len(a), len(b)
    while i and j:
        if table[i][j] == table[i - 1][j]:
            i -= 1
        elif table[i][j] == table[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def patience(a, b):
    """Matched places of two lists: ends first, then around the items that both hold once."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(0, 0)] + [(i + 1, j + 1) for i, j in patience(a[1:], b[1:])]
    if a[-1] == b[-1]:
        return [*patience(a[:-1], b[:-1]), (len(a) - 1, len(b) - 1)]
    anchors = unique_anchors(a, b)
    if not anchors:
        return subsequence(a, b)
    out, i, j = [], 0, 0
    for x, y in [*anchors, (len(a), len(b))]:
        out += [(i + p, j + q) for p, q in patience(a[i:x], b[j:y])] + [(x, y)]
        i, j = x + 1, y + 1
    return out[:-1]


def line_alignment(rows, min_words=3, rare=32):
    """rows: (doc_id, text), distinct ids. To {doc_id: places of the lines it loses}."""
    lines = {i: [x.strip(" ") for x in (t or "").split("\n")] for i, t in rows}
    full = lambda x: len(x.split()) >= min_words
    holders = defaultdict(list)
    for i in sorted(lines):
        for x in dict.fromkeys(lines[i]):
            if full(x):
                holders[x].append(i)
    left = {(i, x) for x, h in holders.items() for i in h[1:]}
    gone = {i: set() for i in lines}

    def align(pairs):
        found = {}
        for first, later in pairs:
            a = [x for k, x in enumerate(lines[first]) if k not in gone[first]]
            at = [k for k in range(len(lines[later])) if k not in gone[later]]
            b = [lines[later][k] for k in at]
            blocks, lost = [], set()
            for i, j in patience(a, b):
                if blocks and blocks[-1][-1] == (i - 1, j - 1):
                    blocks[-1].append((i, j))
                else:
                    blocks.append([(i, j)])
            for block in blocks:
                if any(full(b[j]) for _, j in block):
                    lost |= {j for _, j in block}
            again = {b[j] for j in lost if full(b[j])}
            lost |= {j for j, x in enumerate(b) if x in again}
            found.setdefault(later, set()).update(at[j] for j in lost)
        for i, places in found.items():
            gone[i] |= places
            left.difference_update((i, lines[i][k]) for k in places)
        return any(found.values())

    done = {(holders[x][0], i) for i, x in left if len(holders[x]) <= rare}
    align(done)
    align({(holders[x][0], i) for i, x in left} - done)
    while True:
        by = defaultdict(list)
        for i, x in sorted(left):
            by[x].append(i)
        if not align({pair for h in by.values() for pair in zip(h, h[1:])}):
            return {i: sorted(v) for i, v in gone.items()}


def near_copies(rows, size=5):
    """{doc_id: smallest doc_id reachable}: texts whose sets of ``size`` words in sequence have a Jaccard
    similarity of 0.8 or more are linked; texts without words with each other."""
    sets = {}
    for k, text in rows:
        words = [w for w in re.split("[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
        sets[k] = {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()
    keys = sorted(sets)
    links = [(a, b) for n, a in enumerate(keys) for b in keys[:n] if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    return components(links, sets)
