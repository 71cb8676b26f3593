"""Small tables that hold the awkward cases: NULLs, empty and long texts, ties, repeated rows, clashing columns."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Columns whose names the operators use inside.
CLASHING = ", id string, n long, key string, words long, item string, cls string, root string, part long, h string"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(texts, first=0, lang="en"):
    return [(first + i, t, lang, "s", len(t or "")) for i, t in enumerate(texts)]


def table(spark, texts, parts=3, first=0, clash=False):
    data = texts if texts and isinstance(texts[0], tuple) else rows(texts, first)
    if clash:
        data = [(*r, "x", 1, None, 2, "y", None, "r", 3, "h") for r in data]
    return spark.createDataFrame(data, SCHEMA + (CLASHING if clash else "")).repartition(parts)


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def shingles(text, k=5):
    w = WORD.findall((text or "").translate(FOLD))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def groups(texts, percent=80):
    """Smallest place reachable by links, by brute force over all pairs."""
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]
