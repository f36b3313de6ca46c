"""The n-gram Jaccard join against brute force, on groups that make every path run."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import jaccard


def brute_force(rows, num=75, den=100, n=5):
    """doc_id -> (set size, smallest doc_id reachable)."""
    sets = {}
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc_id] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} - {()}
    parent = {d: d for d in sets}

    def find(d):
        while parent[d] != d:
            parent[d] = parent[parent[d]]
            d = parent[d]
        return d

    holders = defaultdict(list)
    for d in sorted(sets):
        common = Counter(e for g in sets[d] for e in holders[g])
        for e, both in common.items():
            if den * both >= num * (len(sets[d]) + len(sets[e]) - both):
                x, y = sorted((find(d), find(e)))
                parent[y] = x
        for g in sets[d]:
            holders[g].append(d)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.components(docs, **options).collect()}


def words(rng, n, vocabulary=5000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(rng, base, share):
    out = list(base)
    for _ in range(int(share * len(base))):
        k = rng.randrange(len(out))
        kind = rng.random()
        if kind < 0.6:
            out[k] = f"e{rng.randrange(10**6)}"
        elif kind < 0.8:
            out.insert(k, f"i{rng.randrange(10**6)}")
        elif len(out) > 1:
            del out[k]
    return out


def test_large_groups_of_near_copies(spark):
    rng = random.Random(5)
    texts = []
    for size in (40, 200):
        base = words(rng, size)
        texts += [edited(rng, base, rng.choice((0.0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.08))) for _ in range(50)]
        second = edited(rng, base, 0.05)  # a group beside the group
        texts += [edited(rng, second, rng.choice((0.01, 0.03))) for _ in range(40)]
        chain = base
        for _ in range(25):
            chain = edited(rng, chain, 0.025)
            texts.append(chain)
    common = words(rng, 60)
    texts += [words(rng, rng.randrange(10, 300)) + common for _ in range(80)]
    texts += [common + words(rng, rng.randrange(0, 12)) for _ in range(40)]
    texts += [words(rng, rng.randrange(0, 9), 12) for _ in range(80)]
    texts += [texts[3]] * 30
    rng.shuffle(texts)
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    expected = brute_force(rows)
    assert run(spark, rows) == expected
    some = rows[::3]
    assert run(spark, some, hot=3) == brute_force(some)


def test_different_sets_of_one_name_are_told_apart(spark, monkeypatch):
    """As if the names of sets collided all the time; also gathers little at once and much, so that signatures are hot early or late."""
    import pyspark.cloudpickle as cloudpickle

    rng = random.Random(8)
    base = words(rng, 60)
    texts = [edited(rng, base, rng.choice((0.0, 0.01, 0.03, 0.06))) for _ in range(70)] + [words(rng, rng.randrange(1, 40)) for _ in range(40)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)] + [(500, " ".join(texts[3]))]
    expected = brute_force(rows)
    cloudpickle.register_pickle_by_value(jaccard)
    try:
        monkeypatch.setattr(jaccard, "FLUSH", 300)
        assert run(spark, rows, hot=3) == expected
        real = jaccard.identity
        monkeypatch.setattr(jaccard, "identity", lambda found: (real(found)[0] % 19, real(found)[1]))
        assert run(spark, rows, hot=3) == expected
    finally:
        cloudpickle.unregister_pickle_by_value(jaccard)


def test_a_set_counts_once_for_all_heads_of_a_component(spark):
    """A chain of near copies has many heads; sets that share signatures with them and lie outside are compared with one."""
    rng = random.Random(11)
    chain, texts = words(rng, 200), []
    for _ in range(60):
        chain = edited(rng, chain, 0.006)
        texts += [edited(rng, chain, 0.005) for _ in range(4)]
        beside = chain[:110] + words(rng, 70)  # no near copy of the chain, but of each other
        texts += [beside, edited(rng, beside, 0.01)]
    rng.shuffle(texts)
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    join = jaccard.Join(spark.createDataFrame(rows, "doc_id long, text string"), 75, 100, 5, 8)
    documents, entities, labels = join.run()
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard._named(join, documents, entities, labels).collect()}
    table = lambda name: {tuple(r) for r in spark.read.parquet(f"{join.folder}/{name}").collect()}
    component = {r["entity"]: r["component"] for r in labels.collect()}
    heads = {a for a, _ in table("star")}
    placed = spark.read.parquet(f"{join.folder}/placed").select("a", "b", "outside").collect()
    join.discard()
    assert found == brute_force(rows)
    assert len(heads) > 2 * len({component.get(a, a) for a in heads})
    assert any(r["outside"] for r in placed)
    assert max(Counter((component.get(r["a"], r["a"]), r["b"]) for r in placed).values()) == 1


def thue_morse(bits):
    word = "a"
    while len(word) < bits:
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def test_words_that_defeat_polynomials_have_different_hashes(spark):
    """These two words have the same polynomial hash modulo 2**64 in every base."""
    word = thue_morse(1024)
    other = word.translate(str.maketrans("ab", "ba"))
    assert run(spark, [(1, word), (2, other), (3, word.upper())]) == {1: (1, 1), 2: (1, 2), 3: (1, 1)}


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one  TWO"), (6, "one two three"), (7, "É a"), (8, "é a"), (9, "a\x1cb"), (10, "a b"), (11, "x " * 5000), (12, "x x x x x")]
    assert run(spark, rows) == brute_force(rows)
    assert run(spark, []) == {}


def test_repeated_and_null_ids_and_other_columns(spark):
    docs = spark.createDataFrame([(1, "b b b", 5), (1, "a a a", 6), (None, "a a a", 7), (0, "a a a", 8)], "doc_id long, text string, entity int")
    got = sorted(tuple(r) for r in jaccard.components(docs).collect())
    assert got == [(0, 1, 0), (1, 1, 0)]


@given(st.lists(st.text(alphabet="ab Z\n\x1cé", max_size=30), max_size=8))
@settings(max_examples=100, deadline=None)
def test_set_sizes(texts):
    got = [len(s) for s in jaccard.shingle_sets(texts)]
    assert got == [brute_force([(0, t)])[0][0] for t in texts]


@pytest.mark.parametrize("size", [4, 9, 20, 70, 300, 1000])
def test_partners_share_signatures(size):
    """Sets at the very limit of similarity share as many signatures as either needs."""
    rng = np.random.default_rng(size)
    for _ in range(30):
        common = rng.integers(0, 1 << 63, size, np.uint64) * np.uint64(2)
        extra = size // 3 if rng.random() < 0.5 else 0
        x = np.unique(np.concatenate([common, rng.integers(0, 1 << 63, extra, np.uint64)]))
        y = np.unique(np.concatenate([common, rng.integers(0, 1 << 63, size // 3 - extra, np.uint64)]))
        level = max(len(x), len(y)).bit_length()
        of = lambda s: next((need, set(own.tolist())) for k, need, own in jaccard.signatures(s, 75, 100) if k == level)
        (need_x, sx), (need_y, sy) = of(x), of(y)
        assert len(sx & sy) >= max(need_x, need_y)
