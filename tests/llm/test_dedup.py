"""Dedup operators against brute force on small tables."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from quillon.llm import components, exact_dedup, lattice_dedup, near_dedup, substring_dedup


def roots(ids, links):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {i: root(i) for i in ids}


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1100)]
    ids = {i for link in links for i in link if link[0] != link[1]}
    found = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == roots(ids, [x for x in links if x[0] != x[1]])
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_groups(odd, none):
    assert exact_dedup.exact_groups(none).count() == 0
    rows = exact_dedup.exact_groups(odd).collect()
    assert len(rows) == odd.count()
    prose = [r for r in rows if r["group_size"] == 4]
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in prose} == {(1, 2, False), (2, 2, True), (None, 2, False)}
    assert [(r["keep_id"], r["text_sha256"]) for r in rows if r["doc_id"] == 3] == [(4, hashlib.sha256(b"").hexdigest())]
    left = exact_dedup.drop_copies(odd)
    assert left.columns == odd.columns and left.where("doc_id = 1").count() == 0 and left.where("doc_id = 2").count() == 2


def near_texts(seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        base = rng.choices(words, k=rng.randint(8, 120))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    hot = rng.choices(words, k=200)
    for i in range(60):  # one large group of near copies
        copy = list(hot)
        copy[i], copy[(i * 7) % 200] = "x", "y"
        texts.append(" ".join(copy))
    return texts + [texts[0], texts[0], "", "one two", "One  two"]


def test_near_groups_equal_brute_force(spark):
    texts = near_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    profiles = [near_dedup.shingles(t.lower().encode()) for t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if near_dedup.probability_jaccard(profiles[i], profiles[j]) >= 0.8]
    expected = roots(range(len(texts)), links)
    for block in (512, 16):
        found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(docs, block=block).collect()}
        assert found == expected


def hot_texts(seed=11):
    """A passage that many texts share, and many copies of one text that differ, some with repeated words."""
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(3000)]
    passage, base = rng.choices(words, k=60), rng.choices(words, k=120)
    texts = []
    for _ in range(90):
        own = rng.choices(words, k=rng.randint(6, 40))
        texts.append(" ".join(own + passage))
        if rng.random() < 0.2:
            texts.append(" ".join(own + passage + [rng.choice(words)]))
    for _ in range(90):
        copy = list(base)
        for _ in range(rng.randint(0, 9)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(" ".join(copy + copy[:20] * rng.randint(0, 2)))
    return texts


def test_large_buckets_lose_no_link(spark):
    texts = hot_texts()
    profiles = [near_dedup.shingles(t.encode()) for t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if near_dedup.probability_jaccard(profiles[i], profiles[j]) >= 0.8]
    expected = roots(range(len(texts)), links)
    assert 20 < len(set(expected.values())) < len(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (8, 40):
        assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(docs, block=block).collect()} == expected


def test_bounds_and_prefixes():
    profiles = [near_dedup.shingles(t.encode()) for t in hot_texts(3)[::3]]
    top, some = near_dedup.bounds(profiles), near_dedup.bounds(profiles, 10)
    common, often = np.unique(np.concatenate([e for e, _ in profiles]), return_counts=True)
    common, often = common[often > 3], often[often > 3]
    prefixes = [near_dedup.prefix(p, common, often, 0.8) for p in profiles]
    tight = 0
    for i, j in itertools.combinations(range(len(profiles)), 2):
        near = near_dedup.probability_jaccard(profiles[i], profiles[j])
        assert top[i, j] >= near - 1e-5
        assert i >= 10 or j < 10 or some[i, j - 10] == pytest.approx(top[i, j], abs=1e-5)
        assert near < 0.8 or len(np.intersect1d(prefixes[i], prefixes[j]))
        tight += not len(np.intersect1d(prefixes[i], prefixes[j]))
    assert tight > 100


def test_near_vectors_of_any_length_ids_and_ties(spark):
    rng = np.random.default_rng(6)
    rows = []
    for dim, n in ((16, 40), (5, 12), (3, 6), (1, 3)):
        for _ in range(n):
            v = rng.normal(size=dim)
            rows += [v, v * 2 + rng.normal(size=dim) * 0.1, v] if rng.random() < 0.5 else [v]
    tie = np.array([0.95, np.sqrt(1 - 0.95**2), 0.0, 0.0])
    rows += [tie, np.array([1.0, 0.0, 0.0, 0.0])]
    vectors = [(i, v.tolist()) for i, v in enumerate(rows)]
    odd = [(None, rows[0].tolist()), (900, None), (901, [0.0] * 5), (902, [1.0, None]), (903, [float("nan"), 1.0]), (904, []), (0, rows[0].tolist()), (905, rows[-1].tolist()), (905, rows[40].tolist())]
    frame = spark.createDataFrame([(i, v, "x", 1, True) for i, v in vectors + odd], "vec_id long, embedding array<double>, component_id string, n_links int, kept boolean")
    found = lattice_dedup.near_vectors(frame).collect()
    assert len(found) == len(vectors) + len(odd)
    whole = [(i, np.array(v)) for i, v in vectors + odd[6:]]
    unit = [v / np.sqrt((v * v).sum()) for _, v in whole]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(whole)), 2) if len(unit[a]) == len(unit[b]) and (unit[a] * unit[b]).sum() >= 0.95]
    expected = roots({i for i, _ in whole}, [(whole[a][0], whole[b][0]) for a, b in pairs if whole[a][0] != whole[b][0]])
    by_id = {r["vec_id"]: r for r in found if r["vec_id"] is not None}
    assert {i: by_id[i]["component_id"] for i in expected} == expected
    assert all(by_id[i]["n_links"] == 0 and by_id[i]["component_id"] == i for i in range(900, 905))
    links = [sum(k in p for p in pairs) for k in range(len(whole))]
    for k, (i, _) in enumerate(whole):
        assert links[k] in {r["n_links"] for r in found if r["vec_id"] == i}
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in found if r["vec_id"] is None] == [(0, None, True)]


def test_probability_jaccard_and_its_estimate():
    rng = np.random.default_rng(1)
    gaps = []
    for _ in range(60):
        n = rng.integers(3, 200)
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        a, b = rng.integers(1, 5, len(x)), rng.integers(1, 5, len(x))
        near = near_dedup.probability_jaccard((x, a), (x, b))
        brute = sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in range(len(x))) for d in range(len(x)))
        assert near == pytest.approx(brute)
        gaps.append((near_dedup.prob_minhash(x, a) == near_dedup.prob_minhash(x, b)).mean() - near)
    assert abs(np.mean(gaps)) < 0.03


def test_near_groups_of_odd_rows(odd, none):
    assert near_dedup.near_groups(none).count() == 0
    rows = near_dedup.near_groups(odd).collect()
    assert len(rows) == odd.count()
    of = {r["doc_id"]: r["component_id"] for r in rows}
    assert of[1] == of[2] == of[7] == 1 and of[3] == 3 and of[4] == 4 and of[None] is None
    left = near_dedup.drop_near_copies(odd)
    assert left.columns == odd.columns and {r["doc_id"] for r in left.collect()} == {1, 3, 4, 5, 6, 8, None}


def brute_repeats(docs, length):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in docs}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - length + 1):
            first.setdefault(tuple(words[i][k : k + length]), (i, k))
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < (i, k):
                gone[k : k + length] = [True] * length
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


@pytest.mark.parametrize("first", [5, 10])
def test_remove_repeats_equals_brute_force(spark, first):
    rng = random.Random(first)
    passages = [" ".join(rng.choices([f"w{i}" for i in range(50)], k=rng.randint(10, 60))) for _ in range(12)]
    docs = [(i, rng.choice((" ", "\n", "\t ")).join(rng.choices(passages, k=rng.randint(1, 4)) + [f"u{i}"] * rng.randint(0, 30))) for i in range(80)]
    docs += [(100, None), (101, ""), (102, docs[3][1]), (103, "same " * 50)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(frame, first=first).collect()}
    assert found == brute_repeats(docs, 20)


def test_remove_repeats_of_odd_rows(odd, none):
    assert substring_dedup.remove_repeats(none).count() == 0
    rows = substring_dedup.remove_repeats(odd).collect()
    assert len(rows) == odd.count()
    assert {r["n_removed"] for r in rows if r["doc_id"] == 2} == {60} and {r["n_removed"] for r in rows if r["doc_id"] == 1} == {0}
    assert {r["n_removed"] for r in rows if r["doc_id"] is None} == {60, 0}


def test_nearest_e8_is_nearest():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 8)) * 2
    point = lattice_dedup.nearest_e8(x)
    assert ((point * 2) % 1 == 0).all() and (point.sum(axis=1) % 2 == 0).all()
    own = ((x - point) ** 2).sum(axis=1)
    for v in lattice_dedup.neighbours():
        assert (own <= ((x - point - v) ** 2).sum(axis=1) + 1e-9).all()


@pytest.mark.parametrize("cell_rows", [8192, 10])
def test_near_vectors_equal_brute_force(spark, cell_rows):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 16))
    near = [b + rng.normal(size=16) * s for b in base for s in rng.uniform(0.02, 0.3, 3)]
    hot = [base[0] + rng.normal(size=16) * 0.05 for _ in range(40)]
    vectors = [list(map(float, v)) for v in [*base, *near, *hot, base[1], base[1] * 3]]
    odd = [None, [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 3, []]
    rows = list(enumerate(vectors + odd))
    found = {r["vec_id"]: r for r in lattice_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cell_rows=cell_rows).collect()}
    unit = np.array([np.array(v) / np.linalg.norm(v) for v in vectors])
    close = unit @ unit.T >= 0.95
    np.fill_diagonal(close, False)
    links = [(i, j) for i, j in itertools.combinations(range(len(vectors)), 2) if close[i, j]]
    assert sum(found[i]["n_links"] for i in range(len(vectors))) >= 0.999 * close.sum()
    assert all(found[i]["n_links"] <= close[i].sum() for i in range(len(vectors)))
    expected = roots(range(len(rows)), links)
    assert sum(found[i]["component_id"] == expected[i] for i in expected) >= 0.99 * len(expected)
    assert all(found[i]["n_links"] == 0 and found[i]["kept"] for i in range(len(vectors), len(rows)))
    assert lattice_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_a_repeated_id_loses_only_its_copied_text(spark):
    rows = [(5, "copied"), (9, "copied"), (5, "alone"), (None, "copied"), (7, None), (8, "")]
    kept = exact_dedup.drop_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, [(9, "copied"), (5, "alone"), (None, "copied"), (8, "")]))
