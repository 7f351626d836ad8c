"""Plain Python readings of the contracts."""

import hashlib
import re
from collections import Counter, defaultdict

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SECRETS = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def secrets(text):
    found = [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, p, g, least) in enumerate(SECRETS) for m in p.finditer(text or "") if len(m.group(g)) >= least]
    return ",".join(x for *_, x in sorted(found))


def repeats(rows, width, byte=False):
    """Kept elements and removal mask of each row."""
    items = [(t or "").encode() if byte else (t or "").encode().split() for t in rows]
    key = (lambda x: bytes(x)) if byte else tuple
    seen = Counter(key(x[k : k + width]) for x in items for k in range(len(x) - width + 1))
    out = []
    for x in items:
        mask = [False] * len(x)
        for k in range(len(x) - width + 1):
            if seen[key(x[k : k + width])] > 1:
                mask[k : k + width] = [True] * width
        out.append((x, mask))
    return out


def components(docs, size, percent):
    """doc_id -> (set size, least id of its component)."""
    sets, rows = {}, defaultdict(list)
    for i, t in docs:
        w = words((t or "").translate(LOW))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
        for s in sets[i]:
            rows[s].append(i)
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in sets:
        for j, n in Counter(j for s in sets[i] for j in rows[s] if j < i).items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def benchmark_hits(docs, items, width=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    windows = defaultdict(set)
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[k : k + width])].add(str(i))
    out = {}
    for i, t in docs:
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    found |= windows[tuple(w[k : k + n])]
                    hit |= set(range(k, k + n))
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def quality(text):
    w = words(text)
    seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    hit = {q for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for q in range(k, k + 3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)
