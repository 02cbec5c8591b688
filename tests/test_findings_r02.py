"""What the findings of round 2 said: reports that failed, and work that grew with the square of a text."""

import re
import time
from statistics import mean, median, pstdev

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.operators import annotate, features, lexical, prose, rules, tagged, voice
from quillon.plans import queries, voice_queries  # noqa: F401  (the latter registers its own)


def test_schimel_report_over_documents_dealt_by_id(spark, tmp_path):
    """Its results and findings came from unions that Spark took for dealt alike: 'Can't zip RDDs with unequal numbers of partitions'."""
    queries.QUERIES["schimel_report"](spark, "/root/testdata/sf0.01").write.parquet(str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len({r.doc_id for r in rows}) == len(rows) == 1000
    verdicts = {r.doc_id: r for r in queries.QUERIES["schimel_result"](spark, "/root/testdata/sf0.01").collect()}
    assert all(r.report.startswith(f"schimel: {verdicts[r.doc_id].verdict.upper()} (") for r in rows)
    assert all(("Top findings" in r.report) == (verdicts[r.doc_id].findings > 0) for r in rows)


def test_descriptive_statistics_of_a_long_text_take_time_in_proportion(spark):
    """The deviations added up the mean anew for each word: 40,000 words cost 1,600 million additions for each of three."""
    words = ["ab" if k % 3 else "banana" for k in range(40_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "")], "doc_id long, text string")
    features.descriptive(docs.where("doc_id = 2")).collect()
    began = time.time()
    rows = {r.doc_id: r for r in features.descriptive(docs).collect()}
    assert time.time() - began < 30
    lengths = [len(w) for w in words]
    found = rows[1]
    assert (found.desc_n_tokens, found.desc_n_unique_tokens, found.desc_n_characters, found.desc_token_length_median) == (len(words), 2, sum(lengths), median(lengths))
    assert (found.desc_token_length_mean, found.desc_token_length_std) == pytest.approx((mean(lengths), pstdev(lengths)))
    assert (rows[2].desc_n_tokens, rows[2].desc_token_length_mean, rows[2].desc_token_length_std) == (0, None, None)


def _vectors(spark, n=6000, dims=64, copies=50):
    """n unit vectors of one profile, the last of them copies of the first."""
    m = np.random.default_rng(0).normal(size=(n, dims)) + 1
    m /= np.linalg.norm(m, axis=1)[:, None]
    m[n - copies :] = m[0]
    return m, spark.createDataFrame(pa.table({"id": range(n), "profile": [0] * n, "cluster": [i % 2 for i in range(n)], "v": list(m)}))


def _distances(m):
    return np.sqrt(np.stack([((m - x) ** 2).sum(axis=1) for x in m]))


def _within(seconds, df):
    """Rows of df, which must not take longer."""
    began = time.time()
    rows = df.collect()
    assert time.time() - began < seconds
    return rows


def test_diagnosis_of_a_large_profile(spark):
    """Each pair of vectors was a row with two folds over their components."""
    m, rows = _vectors(spark)
    found = _within(15, voice.diagnose(rows))[0]
    d = _distances(m)
    np.fill_diagonal(d, np.inf)
    near, n = d.min(axis=1), len(m)
    limit = np.median(near) + 1.5 * near.std()
    assert near[0] == 0 and found.exemplars == n
    assert found.outliers == ",".join(str(i) for i in np.nonzero(near > limit)[0])
    assert found.coherence == pytest.approx(((m @ m.T).sum() - n) / (n * (n - 1)))


def test_pairs_without_a_value(spark):
    """Null vectors, and pairs of different lengths, have no distance; copies have one of 0, far from the origin too."""
    far = [1e8, 1e8, 1.0]
    rows = spark.createDataFrame([(0, 0, far), (1, 0, far), (2, 0, None), (3, 0, [1.0, None, 0.0]), (4, 0, [1.0]), (5, 0, [1e8, 1e8, 4.0]), (6, 1, far)], "id long, profile long, v array<double>")
    found = voice.diagnose(rows).collect()
    assert [(r.profile, r.exemplars, r.outliers) for r in found] == [(0, 6, "5")]
    z = rows.withColumnRenamed("v", "z")
    assert {r.id: r.distance for r in voice.knn(z.where("profile = 0"), z.where("profile = 0"), apart=True).collect()} == {0: 0.0, 1: 0.0, 2: None, 3: None, 4: None, 5: 3.0}


def test_nearest_of_each_profile_in_large_profiles(spark):
    m, rows = _vectors(spark)
    rows = rows.withColumn("profile", F.col("id") % 3)
    found = {(r.id, r.against): r.distance for r in _within(15, voice.nearest_by_profile(rows))}
    d = _distances(m)
    np.fill_diagonal(d, np.inf)
    assert found == {(i, p): pytest.approx(d[i, p::3].min(), abs=1e-12) for i in range(len(m)) for p in range(3)}


def test_insertion_in_a_long_document(spark):
    """Each vector was put into each slot as a row of its own, which filled the disk."""
    m, rows = _vectors(spark, 3000, 8, 0)
    found = _within(15, voice.insertion(rows.select(F.col("profile").alias("doc"), F.col("id").alias("i"), "v")))[0]
    hits = 0
    for k in range(1, len(m) - 1):
        rest = np.delete(m, k, axis=0)
        p = rest @ m[k]
        gain = np.concatenate([p[:1], p[:-1] + p[1:] - (rest[:-1] * rest[1:]).sum(axis=1), p[-1:]])
        hits += np.round(gain, 9).argmax() == k
    assert (found.hit_rate, found.chance) == pytest.approx((hits / (len(m) - 2), 1 / len(m)))


def test_alike_vectors_of_a_large_profile(spark):
    m, rows = _vectors(spark)
    threshold = 0.8
    found = {(r.id, r.other): r.similarity for r in _within(15, voice.alike(rows, threshold))}
    c = np.triu(m @ m.T, 1)
    i, j = np.nonzero(c >= threshold)
    assert len(found) > 1000 and set(found) == set(zip(i.tolist(), j.tolist(), strict=True))
    assert all(s == pytest.approx(c[k]) for k, s in found.items())


def test_silhouette_of_a_large_profile(spark):
    m, rows = _vectors(spark)
    found = _within(15, voice.silhouette(rows))[0]
    d, n = _distances(m), len(m) // 2
    own = np.arange(len(m)) % 2
    sums = np.stack([d[:, own == k].sum(axis=1) for k in (0, 1)])
    a, b = sums[own, np.arange(len(m))] / (n - 1), sums[1 - own, np.arange(len(m))] / n
    assert found.silhouette == pytest.approx(((b - a) / np.maximum(a, b)).mean())


def test_nearest_exemplars_of_many_drafts(spark):
    m, rows = _vectors(spark)
    z = rows.select("id", F.col("v").alias("z"))
    d = _distances(m)
    np.fill_diagonal(d, np.inf)
    assert {r.id: r.distance for r in _within(15, voice.knn(z, z, apart=True))} == {i: pytest.approx(x, abs=1e-12) for i, x in enumerate(d.min(axis=1))}
    three = np.sort(d, axis=1)[:, :3].mean(axis=1)
    assert {r.id: r.distance for r in _within(15, voice.knn(z, z, k=3, apart=True))} == {i: pytest.approx(x, abs=1e-9) for i, x in enumerate(three)}


def _times_tagged(df):
    """How often the tagger runs in df's plan."""
    return sum("MapInArrow" in line and "tokens#" in line for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n"))


def test_rules_of_tags_read_them_once(spark):
    """Each of the six rules ran the tagger anew."""
    text = "The tests were reviewed. The code was finished. The plan was changed. We do not claim it, we show it. It rains, it pours. A long red line here."
    docs = spark.createDataFrame([(1, text + "\n\n" + text), (2, "")], "doc_id long, text string")
    found = tagged.findings(annotate.tokens(docs), docs)
    assert _times_tagged(found) == 1
    a = annotate.tokens(docs)
    rows = {(r.rule, r.paragraph, r.sentence) for r in found.collect()}
    for rule, relation in (("comma_splice", annotate.comma_splice), ("defensive_claim", annotate.defensive_claim), ("verbless_sentence", annotate.verbless), ("buried_verb_core", annotate.buried_verb)):
        assert {(p, n) for r, p, n in rows if r == rule} == {(r.pi + 1, r.si + 1) for r in relation(a).collect()}
    assert ("passive_voice", None, None) in rows and ("verbless_sentence", 1, 6) in rows


def test_words_stay_in_their_row(spark):
    """Leading words and repetitions made a row of each word and shuffled them."""
    docs = spark.createDataFrame([(1, " ".join(["reef"] * 4 + ["ship"] * 400 + ["reef", "Reefs", "normalise normalises normalise normalises"])), (2, None)], "doc_id long, text string")
    for df in (lexical.leading_words(docs), lexical.repeated(docs)):
        assert "Generate posexplode(regexp_extract_all" not in df._jdf.queryExecution().optimizedPlan().toString()
    gaps = np.array([1, 1, 1, 401])
    assert [(r.word, r["count"], r.score) for r in lexical.leading_words(docs).collect()] == [("reef", 5, round(gaps.std() / gaps.mean(), 6))]
    assert sorted(r.span for r in lexical.repeated(docs).collect()) == ["normalise / normalises", "normalises / normalise", "reef"]


def test_rare_words_are_looked_up_within_their_sentence(spark, monkeypatch):
    """Each word was a row that was shuffled to the documents' abbreviations and leading words; beyond COMMON frequent words a join does it still."""
    docs = spark.createDataFrame([(1, "The gnarled quokka nibbles wombat fodder. The plain word here is known. The World Health Organization (WHOM) met; the gnarled WHOM nibbles.")], "doc_id long, text string")
    frequencies = spark.createDataFrame([("plain", 5.0), ("word", 5.0), ("here", 3.0), ("known", 4.0), ("nibbles", 2.0), (None, 6.0)], "word string, zipf double")
    a = annotate.tokens(docs)
    within = tagged.jargon(a, docs, frequencies)
    assert "Generate explode(array_distinct(transform" not in within._jdf.queryExecution().optimizedPlan().toString()
    rows = within.collect()
    assert [(r.pi, r.si, r.n, r.words) for r in rows] == [(0, 0, 5, ["fodder", "gnarled", "nibbles", "quokka", "wombat"])]
    monkeypatch.setattr(tagged, "COMMON", 2)
    assert tagged.jargon(a, docs, frequencies).collect() == rows


def test_sign_test_finds_the_tells_once(spark):
    """Norms, confidences, drafts and exemplars each searched all texts for all tells again, and the exemplars once more for their count."""
    df = queries.QUERIES["sign_test"](spark, "/root/testdata/sf0.001")
    assert "regexp" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert df.collect()


def test_a_worker_gives_freed_memory_back_though_it_remembers_nothing(monkeypatch):
    """What the stage before packing had freed stayed with the C library, as that stage remembers nothing."""
    common = pytest.importorskip("quillon.llm.common")
    trimmed = []
    library = type("Library", (), {"malloc_trim": lambda self, pad: trimmed.append(pad)})
    monkeypatch.setattr(common.ctypes, "CDLL", lambda name: library())
    common.only(*(memory for ref in common._remembered if (memory := ref()) is not None))
    assert trimmed == [0]


def test_marks_made_where_a_sentence_is_tagged_are_those_of_its_tokens(spark):
    """Every token was sent to the JVM for six rules to read."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("doc_id % 4 = 0")
    odd = ["We do not know it, they say so.", "- one two three four five", "Çelik naïve été über größe.", "", None, "The x " + "very odd " * 12 + "runs. 😀 We can't. " + "Nouns upon nouns " * 30]
    docs = docs.unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(odd)], "doc_id long, text string")).cache()
    made, read = annotate.marks(docs), annotate.marks_of(annotate.tokens(docs))
    assert made.columns == read.columns
    assert sorted(map(str, made.collect())) == sorted(map(str, read.collect()))


def test_long_words_leave_the_pattern_only_where_the_rule_takes_them(spark):
    """Each word of five letters was a row of its own."""
    odd = "We UTILIZE-it, --utilise abc1obtained x-utilize Utopianism organization organizations (a-e-i-o) a-e-i-o-u-ness idea-Area2unimaginable éeventually ility ſufficient"
    docs = spark.createDataFrame([(-1, odd)], "doc_id long, text string").unionByName(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("doc_id % 4 = 0"))
    sents = prose.sentences(docs).select("sent", F.regexp_extract_all("sent", F.lit(rules.LATINATE), F.lit(1)).alias("found")).collect()
    stems, ends = tuple(rules.P.PLAIN_WORDS), tuple(e + s for e in ("tion", "sion", "ment", "ity", "ance", "ence", "ness") for s in ("", "s"))
    heavy = lambda w: not w.endswith(ends) and len(re.findall("[aeiouy]+", w)) >= 4
    for r in sents:
        assert r.found == [w for w in re.findall("[A-Za-z][A-Za-z-]{4,}", r.sent) if w.lower().startswith(stems) or heavy(w.lower())]
    assert any(r.found for r in sents)


def test_acronyms_are_placed_without_shuffling_sentences(spark):
    """All sentences were shuffled to be joined with the acronyms' places."""
    docs = spark.createDataFrame([(1, "No name here. (see ABC)\n\nThe QRS is. ABC and XY-Z, XYZ. Then QRS."), (2, "DNA. The\nABCD. ABC."), (3, None)], "doc_id long, text string")
    found = rules.undefined_acronyms(docs)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.doc_id, r.span, r.paragraph, r.sentence) for r in found.collect()) == [(1, "QRS", 2, 1), (1, "XY", 2, 2), (1, "XYZ", 2, 2), (2, "ABC", 1, 2), (2, "ABCD", 1, 2)]
