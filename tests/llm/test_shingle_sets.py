"""Near duplicates by five-word shingles against plain Python over all pairs."""

import itertools
import random
import re

import numpy as np

import corpus_pipeline
from siftwise.llm import shingle_sets


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] == sets[j] or sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(texts))]


def corpus():
    """Texts of 1 to 600 words with changed copies on both sides of the limit, chains, and a common passage."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    common = " ".join(rng.choices(vocabulary, k=25))
    texts = ["", None, " \n", "one two", "One  two", "a b c d e f g h i", "a b c d e f g h j"]
    for n in (6, 9, 14, 20, 31, 33, 60, 66, 100, 126, 130, 250, 270, 600):
        base = rng.choices(vocabulary, k=n)
        texts += [" ".join(base), " ".join(base) + " " + common]
        for changes in (1, 1, 2, 3, max(1, n // 50), max(1, n // 40), max(1, n // 30)):
            w = list(base)
            for _ in range(changes):
                w[rng.randrange(n)] = rng.choice(vocabulary)
            texts.append(" ".join(w))
        for cut in (0.75, 0.8, 0.82, 0.85, 0.9):
            texts.append(" ".join(base[: max(1, int(n * cut))]))
    return texts


def test_stage_links_exactly_at_the_limit(spark, small_dir):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, small_dir)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(components(texts)))
    assert corpus_pipeline.near_duplicates(spark, docs.where("false"), small_dir).count() == 0


def test_similar_sets_share_a_token():
    rng = random.Random(6)
    for _ in range(2000):
        n = rng.randrange(4, 700)
        own = list({rng.getrandbits(62) for _ in range(n + n // 4 + 1)})
        d = rng.randrange(0, n // 4 + 1)
        a = np.array(sorted(own[:n]), np.uint64)
        b = np.array(sorted(own[d // 2 : n + d - d // 2]), np.uint64)
        if shingle_sets.similar(a, b) and len(np.setxor1d(a, b)):
            assert set(shingle_sets.tokens(a).tolist()) & set(shingle_sets.tokens(b).tolist())
