"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(texts):
    """{id: (n_shingles, component)} of {id: text}, all pairs compared."""
    sets = {i: shingles(t) for i, t in texts.items()}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def dedup(docs, least):
    """Texts of [(id, text)] in order of id, without lines of runs of ``least`` words or more that occur before."""
    rows = []
    for i, text in sorted(docs, key=lambda d: d[0]):
        pieces = (text or "").split("\n")
        rows.append((i, text, pieces, [n for n, p in enumerate(pieces) if WORD.search(p)]))
    gone = defaultdict(set)
    seen = set()
    for i, _, pieces, at in rows:
        for a in range(len(at)):
            for b in range(a, len(at)):
                run = tuple(pieces[n] for n in at[a : b + 1])
                if sum(len(WORD.findall(p)) for p in run) >= least:
                    if run in seen:
                        gone[i] |= set(at[a : b + 1])
                    seen.add(run)
    return {i: "\n".join(p for n, p in enumerate(pieces) if n not in gone[i]) if gone[i] else text for i, text, pieces, _ in rows}


def kneser_ney(train, texts, order, discounts):
    """log10 probabilities of ``texts`` under the model of ``train``; both are lists of token lists that end with an end."""
    raw = Counter(w for t in train for w in t)
    begin = (b"<begin>",)
    own = {order: Counter()}
    for t in train:
        s = list(begin) * (order - 1) + t
        own[order].update(tuple(s[k - order + 1 : k + 1]) for k in range(order - 1, len(s)))
    for k in range(order - 1, 0, -1):
        own[k] = Counter()
        for gram, n in own[k + 1].items():
            own[k][gram[1:]] += n if gram[1:2] == begin else 1
    d, total, followers = {}, {}, {}
    for k in range(1, order + 1):
        c = Counter(own[k].values())
        d[k] = (0, *discounts(c[1], c[2], c[3], c[4]))
        total[k], followers[k] = Counter(), defaultdict(lambda: [0, 0, 0, 0])
        for gram, n in own[k].items():
            total[k][gram[:-1]] += n
            followers[k][gram[:-1]][min(n, 3)] += 1

    def p(gram, k):
        if k == 0:
            return 1 / (len(raw) + 1)
        lower, context = p(gram[1:], k - 1), gram[:-1]
        if not total[k][context]:
            return lower
        n = own[k][gram]
        return (max(n - d[k][min(n, 3)], 0) + sum(d[k][j] * followers[k][context][j] for j in (1, 2, 3)) * lower) / total[k][context]

    out = []
    for t in texts:
        s = list(begin) * (order - 1) + t
        out.append(sum(math.log10(p(tuple(s[k - order + 1 : k + 1]), order)) for k in range(order - 1, len(s))))
    return out


def ranked(docs, items, top=10):
    """{item: [(document, score)]} of [(id, text)], every row a document."""
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    counts = [(i, Counter(term.findall((t or "").translate(lower)))) for i, t in docs]
    n = sum(bool(c) for _, c in counts)
    words = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = {}
    for item, text in items:
        scores = []
        for i, c in counts:
            m = 100 - 90 + (90 * sum(c.values()) * n) // max(words, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(term.findall((text or "").translate(lower))) if c[t])
            if score:
                scores.append((-score, i is None, i or 0))
        out[item] = [(None if none else i, -s) for s, none, i in sorted(scores)[:top]]
    return out


def spellings(docs):
    """{word: (n, near words, form, n of the form, root)} of [(id, text)], all pairs of words compared."""
    import zlib

    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    forms, out = {}, {}
    for w, n in words.items():
        others = sorted((-words[o], o) for o in words if near(w, o))
        forms[w] = others[0][1] if others and -others[0][0] >= 10 * n else None
        out[w] = (n, len(others))
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        out[w] += (forms[w], words[forms[w]] if forms[w] else None, root)
    return out
