"""Plain versions of the rules that several tests hold results against."""

import collections
import re

from lexline.llm import neardup

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_components(docs, percent=75):
    sets = {k: neardup.shingles(t) for k, t in docs.items()}
    root = {k: k for k in docs}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in docs:
        for b in docs:
            if a < b and sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if 100 * shared >= percent * len(sets[a] | sets[b]):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {k: (len(sets[k]), find(k)) for k in docs}


def items_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))


def brute_spans(text, items, window=10):
    windows = collections.defaultdict(set)
    for k, t in items:
        w = items_words(t)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[i : i + m])].add(str(k))
    w, hit, names = items_words(text), set(), set()
    for m in {len(x) for x in windows}:
        for i in range(len(w) - m + 1):
            if tuple(w[i : i + m]) in windows:
                hit |= set(range(i, i + m))
                names |= windows[tuple(w[i : i + m])]
    return len(w), len(hit), sorted(names)


def brute_counts(text):
    text = text or ""
    w, seen, hit = WORD.findall(text), collections.defaultdict(list), set()
    for i in range(len(w) - 7):
        seen[tuple(w[i : i + 8])].append(i)
    for places in seen.values():
        if len(places) > 1:
            hit |= {x for i in places for x in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))
