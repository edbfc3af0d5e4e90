"""Plain versions of the operators over a dict of logs, for comparison."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PROSE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def calls(log):
    return re.findall(r"[^\x20\x09-\x0D]+", log or "")


def prose(log):
    return PROSE.findall((log or "").translate(FOLD))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def stripped(logs, n=13):
    first = {}
    for i in sorted(logs):
        w = calls(logs[i])
        for p in range(len(w) - n + 1):
            first.setdefault(tuple(w[p:p + n]), i)
    out = {}
    for i, log in logs.items():
        w = calls(log)
        gone = [False] * len(w)
        for p in range(len(w) - n + 1):
            if first[tuple(w[p:p + n])] < i:
                gone[p:p + n] = [True] * n
        out[i] = (" ".join(x for x, g in zip(w, gone) if not g), len(w), sum(gone))
    return out


def near(logs, n, percent=80):
    sets = {}
    for i, log in logs.items():
        w = calls((log or "").translate(FOLD))
        sets[i] = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in logs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(logs)
    for a in ids:
        for b in ids:
            shared = len(sets[a] & sets[b])
            if a < b and shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in logs}


def notices(log, phrases):
    w, at, labels = prose(log), [], set()
    for phrase, label in phrases.items():
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k:k + len(p)] == p:
                at.append(k)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def benchmark(logs, benchmarks, n=10):
    windows = defaultdict(set)
    for i, log in benchmarks.items():
        w = prose(log)
        for p in range(max(1, len(w) - n + 1) if w else 0):
            windows[tuple(w[p:p + n])].add(i)
    out = {}
    for i, log in logs.items():
        w, hit, ids = prose(log), set(), set()
        for window, owners in windows.items():
            for p in range(len(w) - len(window) + 1):
                if tuple(w[p:p + len(window)]) == window:
                    hit |= set(range(p, p + len(window)))
                    ids |= owners
        out[i] = (len(w), len(hit), sorted(ids))
    return out


def lines(logs, least=10):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    first = {}
    for i in sorted(logs):
        for line in (logs[i] or "").split("\n"):
            first.setdefault(key(line), i)
    out = {}
    for i, log in logs.items():
        own = (log or "").split("\n")
        left = [x for x in own if len(key(x)) < least or first[key(x)] == i]
        out[i] = ("\n".join(left), len(own), len(own) - len(left))
    return out


def unigram(logs):
    tokens = {i: calls((log or "").translate(FOLD)) + [None] for i, log in logs.items()}
    c = Counter()
    for i, own in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(own)
    total, kinds = sum(c.values()), len(c)
    return {i: (len(own), sum(c[x] > 0 for x in own), total, sum(math.log10((c[x] + 1) / (total + kinds + 1)) for x in own))
            for i, own in tokens.items()}
