"""Plain versions of what the operators compute, for small tables."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

SPACE_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return (text or "").encode().lower()


def shingles(text, width):
    w = SPACE_WORD.findall(low(text))
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def components(docs, width, percent=80):
    """For rows (doc_id, text): (set size, root, smallest doc_id of the component)."""
    sets = [shingles(t, width) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, j in itertools.combinations(range(len(docs)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    names = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        names[find(i)].append(d)
    return [(len(sets[i]), find(i), min((d for d in names[find(i)] if d is not None), default=None)) for i in range(len(docs))]


def hits(text, items, width=13):
    """n_words, n_hit, names of the items whose windows occur."""
    w, hit, names = ALNUM_WORD.findall(low(text)), set(), set()
    for name, item in items:
        v = ALNUM_WORD.findall(low(item))
        n = min(width, len(v))
        windows = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)} if v else set()
        for i in range(len(w) - n + 1 if v else 0):
            if tuple(w[i:i + n]) in windows:
                hit.update(range(i, i + n))
                names.add(str(name))
    return len(w), len(hit), sorted(names)


def mix(rows, weights=(3, 1, 2), share=1.5, most=2.0, seed="mix"):
    """For rows (doc_id, text, source): size, source size, target, how often taken."""
    size = [len(SPACE_WORD.findall((t or "").encode())) for _, t, _ in rows]
    h = [int(hashlib.md5(f"{seed}:{'null' if d is None else d}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()[:15], 16) for d, t, _ in rows]
    total = Counter()
    for (_, _, s), n in zip(rows, size):
        total[s] += n
    sources = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None] * (None in total)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    target, open_, left = {}, list(sources), share * sum(size)
    while True:                                  # the excess over the cap goes to the others by weight
        w = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / w >= most * total[s]] if w else []
        if not full:
            target.update({s: left * weight[s] / w for s in open_})
            break
        for s in full:
            target[s] = most * total[s]
            left -= target[s]
            open_.remove(s)
    taken = []
    for (_, _, s), mine in zip(rows, h):
        whole = int(target[s] // total[s]) if total[s] else 0
        rest = target[s] - whole * total[s]
        upto = sum(n for (_, _, o), x, n in zip(rows, h, size) if o == s and x <= mine)
        z = sum(n for (_, _, o), x, n in zip(rows, h, size) if o == s and x == mine)
        taken.append(whole + int(rest > 0 and (upto < rest or upto - z < rest and 2 * (rest - (upto - z)) >= z)))
    return [(size[i], total[s], target[s], taken[i]) for i, (_, _, s) in enumerate(rows)]


def crc(x):
    return zlib.crc32(("" if x is None else str(x)).encode())
