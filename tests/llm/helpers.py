"""Small tables and brute-force versions."""

import hashlib
import random

import numpy as np

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, schema=DOCS):
    """Documents numbered from 0, dealt over three partitions."""
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema).repartition(3)


def prose(rng, n, words=40):
    return " ".join(f"w{rng.randint(0, words)}" for _ in range(n))


def awkward(rng):
    """Texts with copies, shared passages, repetition inside, a very long one, short ones, empty ones and nulls."""
    passage = prose(rng, 70, 10_000)
    near = [prose(rng, 120, 10_000)] * 4
    texts = [prose(rng, rng.randint(0, 200), 3000) for _ in range(20)]
    texts += [f"{prose(rng, 30, 9000)} {passage} {prose(rng, 30, 9000)}" for _ in range(6)]
    texts += near + [" ".join(w if i % 37 else f"x{k}" for i, w in enumerate(near[0].split())) for k in range(5)]
    texts += ["", None, " \n\t ", "one", "two words", "a" * 5000, "ab " * 700, passage + " " + passage, "É é ß     日本語 😀 " * 20, "x\x00y\x1fz " * 60, prose(rng, 6000, 30_000), "ONE", "one"]
    rng.shuffle(texts)
    return texts


def removed_bytes(texts, window=100):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        x = (t or "").encode()
        gone = np.zeros(len(x), bool)
        for p in range(len(x) - window + 1):
            w = x[p : p + window]
            if w in seen:
                gone[p : p + window] = True
            seen.add(w)
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out[i] = (len(x), int(gone.sum()), spans, np.frombuffer(x, np.uint8)[~gone].tobytes())
    return out


def removed_words(texts, window=50):
    first, out = {}, {}
    split = [(t or "").encode().split() for t in texts]
    for i, w in enumerate(split):
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), i)
    for i, w in enumerate(split):
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


def jaccard_components(texts, words, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[p : p + words]) for p in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def rng(seed=1):
    return random.Random(seed)
