"""Near-duplicates by shingles against brute force over all pairs."""

import random

import numpy as np

from emberlog.llm import simhash_similar


def shingles(text, words=5):
    w = text.lower().split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b)


def groups(texts):
    """Least number reachable over pairs of at least 0.8, for each text."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for j in range(len(texts)):
        for i in range(j):
            if jaccard(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(len(texts))}


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.component_id for r in simhash_similar.similar_documents(docs).collect()}


def new_words(rng, n):
    return [f"x{rng.getrandbits(40)}" for _ in range(n)]


def test_pairs_among_look_alikes_of_a_template(spark):
    rng = random.Random(5)
    template, texts = new_words(rng, 200), []
    for _ in range(150):  # two of one form at about 0.9, about 0.64 to all others
        own = template[:175] + new_words(rng, 25)
        again = list(own)
        at = rng.randrange(20, 150)
        again[at : at + 6] = new_words(rng, 6)
        texts += [" ".join(own), " ".join(again)]
    assert found(spark, texts) == groups(texts)


def test_long_texts_are_compared_whole(spark):
    rng, texts, wanted = random.Random(6), [], []
    for n in range(60):  # of some 600 shingles, just above or just below 0.8
        own = new_words(rng, 600)
        again = own[:-67] + new_words(rng, 68 if n % 2 else 64)
        texts += [" ".join(own), " ".join(again)]
        wanted.append(jaccard(shingles(texts[-2]), shingles(texts[-1])) >= 0.8)
    assert 20 < sum(wanted) < 40
    got = found(spark, texts)
    assert [got[2 * n + 1] == 2 * n for n in range(60)] == wanted


def test_every_pair_near_the_similarity_is_found(spark, monkeypatch):
    monkeypatch.setattr(simhash_similar, "BLOCK", 16, raising=False)
    rng, texts, near = random.Random(7), [], 0
    common = new_words(rng, 30)
    for n in range(300):  # from 0.78 to 0.9; a third with a passage that all of them have
        size = rng.choice([40, 120, 300])
        own = new_words(rng, size) + (common if n % 3 == 0 else [])
        new = round(size * rng.uniform(0.05, 0.125))
        again = own[:-new] + new_words(rng, new) if n % 2 else new_words(rng, new) + own[new:]
        near += 0.78 <= jaccard(shingles(" ".join(own)), shingles(" ".join(again))) <= 0.9
        texts += [" ".join(own), " ".join(again)]
    texts += ["one two", "One  TWO", "one two three four five", "one two three four five six", " ".join("abcde" * 3)]
    assert near > 200
    assert found(spark, texts) == groups(texts)


def test_frequent_first_shingles_meet_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash_similar, "BLOCK", 4, raising=False)
    monkeypatch.setattr(simhash_similar, "ORDER_SHINGLES", 0, raising=False)  # an order that says nothing
    rng, texts = random.Random(8), []
    template = new_words(rng, 60)
    for _ in range(60):
        own = list(template)
        for at in rng.sample(range(60), 2):
            own[at] = new_words(rng, 1)[0]
        texts.append(" ".join(own))
    assert found(spark, texts) == groups(texts)


def test_bins_leave_out_no_similar_pair():
    rng = np.random.default_rng(9)
    left_out = 0
    for n in (1, 2, 9, 40, 300, 5000):
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            gone = rng.integers(0, n // 3 + 1)
            b = np.unique(np.concatenate((a[gone:], rng.integers(0, 1 << 63, rng.integers(0, n // 4 + 1)).astype(np.uint64))))
            both = len(np.intersect1d(a, b))
            may = simhash_similar.may_be_similar(simhash_similar.binned(a), len(a), simhash_similar.binned(b), len(b), 0.8)
            assert may or both / (len(a) + len(b) - both) < 0.8
            left_out += not may
    assert left_out > 50
    # a bin that is full says nothing
    a, b = (np.arange(n, dtype=np.uint64) * np.uint64(1 << 40) for n in (400, 390))
    assert simhash_similar.may_be_similar(simhash_similar.binned(a), 400, simhash_similar.binned(b), 390, 0.8)
