import itertools
import math
import os
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quillon.llm import near_dedup, packing, queries, toxicity, url_filter

SMALL = "/root/testdata/sf0.001"


def test_index_finds_the_nearest_exactly():
    """Ids, labels and cosines of the nearest, ties and own examples included, against all cosines."""
    rng = np.random.default_rng(3)
    weight = np.where(rng.random(80) < 0.1, 0.0, rng.uniform(1, 5, 80))
    counts = rng.integers(1, 4, (400, 80)) * (rng.random((400, 80)) < np.linspace(0.005, 0.4, 80))
    counts[200:230] = counts[:30]  # ties
    counts[399] = 0
    example, term = np.nonzero(counts)
    labels = (rng.random(400) < 0.3).astype(float)
    ids = rng.permutation(1000)[:400].astype(np.int64)
    index = toxicity.Index(weight, ids, labels, example, term, counts[example, term].astype(float))
    dense = np.where(counts > 0, (1 + np.log(np.maximum(counts, 1))) * weight, 0.0)
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-300)
    searched, asked = [], [*range(60), 399]
    texts = [(np.flatnonzero(counts[at]), counts[at][counts[at] > 0].astype(float)) for at in asked]
    for at, found in zip(asked, index.nearest(texts, ids[asked].tolist()), strict=True):
        cosines = np.round(dense @ dense[at], 12)
        expected = sorted((-c, i, y) for c, i, y in zip(cosines.tolist(), ids.tolist(), labels.tolist(), strict=True) if c > 0 and i != ids[at])[: toxicity.K]
        assert [round(c, 9) for c, _, _ in found] == [round(-c, 9) for c, _, _ in expected]
        close = [c for c, _, _ in expected]
        if len({round(c, 9) for c in close}) == len({round(c, 12) for c in close}):
            assert [x[1:] for x in found] == [x[1:] for x in expected]
            searched.append(at)
    assert len(searched) > 50


def test_scores_equal_brute_force(spark):
    """The whole fit and score, said again plainly."""
    rng = np.random.default_rng(8)
    words = [f"w{i:03d}" for i in range(120)]
    texts = {i: " ".join(rng.choice(words, rng.integers(0, 30))) + (" nastyword" * (i % 5 == 0) if i % 7 else "") for i in range(220)}
    toxic = {i: int(i % 5 == 0) for i in range(0, 220, 2)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, 1, y) for i, y in toxic.items()], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    roles = {r["doc_id"]: r["calibrates"] for r in toxicity.taught(labels).collect()}
    assert set(roles) == {i for i in toxic if zlib.crc32(str(i).encode()) % 5}
    counts = {i: Counter(x for w in t.split() for x in toxicity.terms_of(w)) for i, t in texts.items()}
    examples = sorted(i for i, c in roles.items() if not c)
    n, m = sum(toxic[i] for i in examples), sum(1 - toxic[i] for i in examples)

    def weight(t):
        a, b = (sum(t in counts[i] for i in examples if toxic[i] == y) for y in (1, 0))
        if not a + b:
            return 0.0
        p = (a + b) / (n + m)
        g = 2 * sum(k * math.log(k / (of * q)) for k, of, q in ((a, n, p), (n - a, n, 1 - p), (b, m, p), (m - b, m, 1 - p)) if k)
        return math.sqrt(max(g, 0.0)) * (math.log((1 + len(texts)) / (1 + sum(t in c for c in counts.values()))) + 1)

    weights = {t: weight(t) for t in {t for c in counts.values() for t in c}}
    vectors = {}
    for i, c in counts.items():
        v = {t: (1 + math.log(k)) * weights[t] for t, k in c.items() if weights[t] > 0}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors[i] = {t: x / norm for t, x in v.items()}
    base = (n + 0.5) / (n + m + 1)

    def near(i):
        cosines = [(round(sum(x * vectors[j].get(t, 0.0) for t, x in vectors[i].items()), 12), j) for j in examples if j != i]
        return sorted((-c, j) for c, j in cosines if c > 0)[: toxicity.K]

    def raw(some):
        return (sum(c * c * toxic[j] for c, j in some) + toxicity.BASE_WEIGHT * base) / (sum(c * c for c, _ in some) + toxicity.BASE_WEIGHT)

    asked = [i for i, c in roles.items() if c and near(i)]
    slope, offset = toxicity.fit_logistic(np.array([toxicity.logit(raw(near(i))) for i in asked]), np.array([toxic[i] for i in asked], dtype=float))
    for i in texts:
        some = near(i)
        expected = 1 / (1 + math.exp(-(slope * toxicity.logit(raw(some)) + offset))) if some else base
        assert found[i]["score"] == pytest.approx(expected, abs=1e-6)
        assert [e["doc_id"] for e in found[i]["evidence"]] == [j for _, j in some[: toxicity.EVIDENCE]]
        assert found[i]["predicted"] == (found[i]["score"] >= 0.5)


def test_toxicity_holds_out_and_generalizes(spark):
    rng = np.random.default_rng(1)
    filler = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        words = rng.choice(filler, 40).tolist() + (["vilestem" + str(rng.choice(["ab", "cd", "ef", "gh"]))] if toxic else [])
        docs.append((i, " ".join(rng.permutation(words))))
        labels.append((i, 1, int(toxic)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = toxicity.score(frame, marks).collect()
    assert len(rows) == 600
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held) >= 0.98 * len(held)
    taught = {e["doc_id"] for r in rows for e in r["evidence"]}
    assert all(zlib.crc32(str(i).encode()) % 5 for i in taught)
    assert all(r["doc_id"] not in [e["doc_id"] for e in r["evidence"]] for r in rows)
    flipped = spark.createDataFrame([(i, 1, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, _, t in labels], "doc_id long, quality int, toxic int")
    again = {r["doc_id"]: r["score"] for r in toxicity.score(frame, flipped).collect()}
    assert all(again[r["doc_id"]] == r["score"] for r in rows)  # held-out labels teach nothing


def test_toxicity_of_odd_rows(spark, odd, none):
    no_labels = spark.createDataFrame([(None, None, None)], "doc_id long, quality int, toxic int")
    assert toxicity.score(none, no_labels).count() == 0
    rows = toxicity.score(odd, no_labels).collect()
    assert len(rows) == odd.count() and {r["score"] for r in rows} == {0.5}
    some = spark.createDataFrame([(1, 1, 0), (7, 1, 1), (7, 0, 0)], "doc_id long, quality int, toxic int")
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(odd, some).collect())
    assert toxicity.drop_toxic(odd, some).columns == odd.columns


def test_url_rules_and_reputation(spark):
    urls = ["http://x.org/", "https://a.Example.ORG/es/1", "http://example.org/en/12?x", "http://example.org/en/2", "http://x.com/fr/", "http://x.com/de/#a", "http://com/fr", "no scheme", None, "", "http://org", "ftp://u@h.net:80/p?q://r/s", "http://bad.net/1", "http://bad.net/2"]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)] + [(100 + i, f"http://bad.net/{i}", "", "") for i in range(60)], "page_id long, url string, host string, verdict string")
    seen = spark.createDataFrame([(100 + i, 0) for i in range(60)], "page_id long, good int")
    rows = {r["page_id"]: r for r in url_filter.judge(pages, seen).collect()}
    assert [(rows[i]["rule"], rows[i]["verdict"]) for i in range(7)] == [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("org/", "allow"), ("com/fr/", "allow"), ("com/de/", "block"), (None, rows[6]["verdict"])]
    assert all((rows[i]["host"], rows[i]["path"]) == ("", "") for i in (7, 8, 9))
    assert (rows[10]["host"], rows[10]["path"], rows[10]["rule"]) == ("org", "", None)
    assert (rows[11]["host"], rows[11]["path"]) == ("u@h.net:80", "/p")
    assert rows[12]["verdict"] == "block"
    assert url_filter.judge(pages.limit(0), seen).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages.where("host = 'h'"), seen.limit(0)).where("rule is null").collect()} == {"allow"}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"create view {f[:-8]} as select * from '{SMALL}/{f}'")
    rows = queries.QUERIES[name](spark, SMALL)
    names = sorted(rows.columns)
    found = sorted(map(repr, (tuple(r[n] for n in names) for r in rows.collect())))
    expected = con.execute(f"select {', '.join(names)} from ({queries.SQL[name]}) q").fetchall()
    assert found == sorted(map(repr, expected))


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Toxic, equal and near-equal texts, null, empty and repeated rows, and columns with clashing names."""
    rng = random.Random(9)
    words = ["".join(rng.choices("bcdfgklmnprst", k=3)) + rng.choice("aeiou") for _ in range(400)]
    rows, toxic = [], {}
    for i in range(160):
        text = rng.choices(words, k=rng.randint(20, 60))
        toxic[i] = int(i % 4 == 0)
        rows.append((i, " ".join(text + ["vilest", "scoundrel"] * toxic[i])))
        if i % 10 == 1:
            rows.append((300 + i, rows[-1][1]))  # an equal text
        if i % 10 == 3:
            rows.append((500 + i, rows[-1][1] + " " + rng.choice(words)))  # a near one
    rows += [(900, None), (901, ""), (902, "mail a.b@c.org now and then"), (1, rows[1][1]), (None, "one text without an id"), (None, None)]
    spark.createDataFrame([(i, t, "l", None, 1, "k", "w") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string, words string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = [(i, t) for i, t in rows if "vilest" not in (t or "")]
    keep = {}
    for i, t in left:
        if i is not None:
            keep[t or ""] = max(keep.get(t or "", -1), i)
    left = [(i, t) for i, t in left if i is None or keep[t or ""] == i]
    profiles = {i: near_dedup.shingles((t or "").lower().encode()) for i, t in left if i is not None}
    up = {i: i for i in profiles}
    for _ in profiles:
        for a, b in itertools.combinations(sorted(profiles), 2):
            if up[a] != up[b] and near_dedup.probability_jaccard(profiles[a], profiles[b]) >= 0.8:
                up[a] = up[b] = min(up[a], up[b])
    left = [(i, t) for i, t in left if i is None or up[i] == i]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = Counter((i, len(library.encode((t or "").replace("a.b@c.org", "[EMAIL]"), add_special_tokens=False).ids) + 1) for i, t in left)
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in found if r["start"] == 0) == expected
    assert sum(r["length"] for r in found) == sum(n * k for (_, n), k in expected.items())
    none = tmp_path / "none"
    spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0).write.parquet(f"{none}/documents.parquet")
    spark.read.parquet(f"{tmp_path}/labels.parquet").write.parquet(f"{none}/labels.parquet")
    assert corpus_pipeline.run(spark, str(none)).count() == 0


def test_pipeline_is_its_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "pii", "packing"]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert docs.columns == columns and 0.7 * before < docs.count() <= before
            before = docs.count()
    texts = [r["text"] for r in spark.read.parquet(f"{tmp_path}/3").collect()]
    assert len(set(texts)) == len(texts) and any("[EMAIL]" in t for t in texts)
    whole = corpus_pipeline.run(spark, SMALL)
    key = ["doc_id", "doc_tokens"]
    assert sorted(map(tuple, whole.select(*key).distinct().collect())) == sorted(map(tuple, docs.select(*key).distinct().collect()))
    assert sum(r["length"] for r in whole.collect()) == sum(r["doc_tokens"] for r in whole.select(*key).distinct().collect())
    assert packing.SCHEMA.startswith("doc_id long")
