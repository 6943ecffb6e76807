"""Plain versions of the pipeline's stages over a dict of texts, for small fixtures."""

import math
import re
from collections import Counter

from hammerline.llm import quality as q

WHITE = " \t\n\x0b\x0c\r"


def split(text):
    return [w for w in re.split(f"[{WHITE}]+", text or "") if w]


def _distance(p, r):
    total = 0.0
    for a, b in zip(p, r):
        for x in (a, b):
            if x > 0:
                total += x * math.log2(2 * x / (a + b))
    return math.sqrt(max(0.0, total / 2))


def keeps(text):
    text, words = text or "", split(text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(grams)
    covered = {j for i, g in enumerate(grams) if times[g] > 1 for j in range(i, i + 5)}
    n = len(words)
    if n < 10 or 100 * len(covered) > 20 * n:
        return False
    patterns = ["[a-z]", "[A-Z]", "[0-9]", f"[{WHITE}]", r"[.,;:'\"()!?-]", r"[#*$%&|<>@^~_=+/\\{}\[\]`]"]
    shares = [len(re.findall(p, text)) / len(text) for p in patterns]
    shares.append(1 - sum(shares))
    if n >= q.MIN_WORDS and min(_distance(shares, r) for r in q.CHAR_SHARES.values()) > (q.CHAR_LIMIT if n >= q.SETTLED_WORDS else q.LOOSE_CHAR_LIMIT):
        return False
    if n >= q.MIN_WORDS_FOR_WORDS:
        lower = Counter(w.lower() for w in words)
        found = []
        for r in q.WORD_SHARES.values():
            p = [lower[w] / n for w in r]
            found.append(_distance([*p, 1 - sum(p)], [*r.values(), 1 - sum(r.values())]))
        return min(found) <= q.WORD_LIMIT
    return True


def quality(docs):
    return {k: t for k, t in docs.items() if keeps(t)}


def shingle_set(text):
    words = split("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def near_dedup(docs):
    """One of each group linked by a Jaccard similarity of 0.8 or more of five-word shingles."""
    found, group = {k: shingle_set(t) for k, t in docs.items()}, {k: k for k in docs}
    changed = True
    while changed:
        changed = False
        for a in docs:
            for b in docs:
                if group[a] < group[b] and 5 * len(found[a] & found[b]) >= 4 * len(found[a] | found[b]):
                    group[b], changed = group[a], True
    return {k: t for k, t in docs.items() if group[k] == k}


def _cut(text, places, covered):
    out, last, hit = [], 0, sorted(covered)
    for i, k in enumerate(hit):
        if i == 0 or hit[i - 1] != k - 1:
            out.append(text[last : places[k][0]])
        last = places[k][1]
    return "".join(out) + text[last:]


def substring(docs, window=50):
    first, words = {}, {k: split(t) for k, t in docs.items()}
    for k, w in words.items():
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            first[g] = min(k, first.get(g, k))
    out = {}
    for k, w in words.items():
        covered = {j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < k for j in range(i, i + window)}
        if len(covered) < len(w) or not w:
            out[k] = _cut(docs[k], [m.span() for m in re.finditer(f"[^{WHITE}]+", docs[k])], covered) if covered else docs[k]
    return out


def decontaminate(docs, items, size=10):
    fold = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    grams = set()
    for _, t in items:
        w = word.findall(fold(t))
        n = min(size, len(w))
        grams |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    out = {}
    for k, t in docs.items():
        places = [m.span() for m in word.finditer(fold(t))]
        w = [fold(t)[a:b] for a, b in places]
        covered = {j for n in {len(g) for g in grams} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in grams for j in range(i, i + n)}
        if len(covered) <= 0.5 * len(w):
            out[k] = _cut(t, places, covered) if covered else t
    return out
