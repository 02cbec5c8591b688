import pytest
from pyspark.sql import functions as F

from quillon.functions import lexicons as L
from quillon.operators import lexical, structure, voice
from quillon.sources import files
from quillon.sources.profiles import Profiles, normalized
from quillon.streaming import verdicts


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_structure(spark):
    text = "---\nname: a-b\ndescription: use this when any or all fail\n---\n# One\ntext `ab`\n\n## Usage\n- x\n1. y\n```\ncode\n```\n[l](scripts/run.sh) references/a.md"
    row = structure.features(docs(spark, text, "")).orderBy("doc_id").collect()
    first, empty = row[0].asDict(), row[1].asDict()
    assert (first["struct_heading_count"], first["struct_max_heading_depth"], first["struct_frontmatter_field_count"]) == (2, 2, 2)
    assert first["struct_code_char_ratio"] == pytest.approx(len("```\ncode\n```") / len(text)) and first["struct_external_ref_count"] == 2
    assert (first["struct_named_section_present"], first["struct_name_format_valid"], first["fm_desc_when_clause"], first["fm_desc_or_count"]) == (1, 1, 1, 1)
    assert empty["struct_code_char_ratio"] is None and empty["struct_list_item_ratio"] is None and empty["struct_ordered_list_ratio"] == 0.0 and empty["struct_line_count"] == 0


def test_dictionary_rates(spark):
    def rate(name, text):
        return docs(spark, text).select(lexical.dictionary(F.col("text"))[name]).first()[0]

    assert rate("dict_hype_per_1k", "A world-class, groundbreaking result.") == 250
    assert rate("dict_negation_per_1k", "no no no") == 1000
    assert rate("dict_conditional_per_1k", "We left early because it was raining.") == 125
    assert rate("dict_second_person_per_1k", "You take your time.") == 400
    assert rate("dict_hedge_per_1k", "") == 0


def test_clustered_words_lead(spark):
    filler = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(400)]
    words = filler[:100] + ["beacon"] * 2 + filler[100:104] + ["beacon"] * 3 + filler[104:390] + ["beacon"]
    even = [w for i, w in enumerate(filler) for w in ((w, "lantern") if i % 50 == 0 else (w,))]
    found = lexical.leading_words(docs(spark, " ".join(words), " ".join(even), "short")).collect()
    assert ("beacon", 6) in [(r["word"], r["count"]) for r in found if r["doc_id"] == 0] and not [r for r in found if r["word"] == "lantern"]


def test_overlap_staccato_chunks(spark):
    d = docs(spark, "The cat chased the mouse. The cat bit the mouse.", "It was an agent. It never said so. It admitted it later.", "word " * 2500)
    assert [r["overlap"] for r in lexical.overlap(d).orderBy("doc_id").collect()] == [0.5, pytest.approx(0.0, abs=1), None]
    assert [r["runs"] for r in lexical.staccato(d).orderBy("doc_id").collect()] == [0, 1, 0]
    assert lexical.chunks(d).where("doc_id = 2").count() == 2


def test_blend_and_direction(spark):
    blend = voice.blend(F.lit(10.0), F.lit(3.0), F.col("id"), F.lit(2.0), F.lit(1.0), F.lit(4.0))
    assert [tuple(r) for r in spark.range(5).where("id in (0, 4)").select(*blend).collect()] == [(2.0, 1.0), (6.0, 2.0)]
    z = spark.createDataFrame([(1, "tell_dash", -2.0), (1, "pos_NOUN", 1.5), (1, "pos_ADJ", -1.0), (1, "weak", 9.0)], "id long, name string, z double")
    weights = spark.createDataFrame([("tell_dash", 0.81), ("pos_NOUN", 0.3), ("pos_ADJ", 0.25), ("weak", 0.1)], "name string, confidence double")
    assert [(r["name"], r["move"]) for r in voice.direction(z, weights).orderBy("place").collect()] == [("pos_NOUN", "fewer"), ("pos_ADJ", "more")]


def test_model_and_flow(spark):
    rows = [(i, 0, [float(i % 3), 1.0, float(i) / 10]) for i in range(6)]
    train = spark.createDataFrame(rows, "id long, profile long, v array<double>")
    axes = voice.by_axis(train)
    assert axes.first()["std"][1] == 1.0  # a constant axis
    z = voice.standardized(train, axes)
    assert {r["distance"] for r in voice.knn(z, z).collect()} == {0.0}
    assert all(r["distance"] > 0 for r in voice.knn(z, z, apart=True).collect())
    line = spark.createDataFrame([(1, i, [1.0, 0.1 * i]) for i in range(6)] + [(2, 0, [1.0, 0.0])], "doc long, i long, v array<double>")
    flow = voice.flow(line).collect()
    assert [r["doc"] for r in flow] == [1] and flow[0]["circuitousness"] == pytest.approx(1.0, abs=1e-6)
    assert {r["doc"]: r["coherence"] for r in voice.coherence(line).collect()}[2] == 0.0
    assert [r["chance"] for r in voice.insertion(line).where("doc = 1").collect()] == [pytest.approx(1 / 6)]
    scores = spark.createDataFrame([(0.9, 1), (0.5, 1), (0.5, 0), (0.1, 0)], "score double, y int")
    assert voice.auc(scores).first()["auc"] == pytest.approx(0.875)


def test_files_profiles_and_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("---\nx: 1\n---\nBody.")
    (tmp_path / "in/b.txt").write_text("Text.")
    (tmp_path / "in/c.bin").write_text("no")
    assert sorted(r["text"] for r in files.documents(spark, str(tmp_path / "in"), keep_frontmatter=False).collect()) == ["Body.", "Text."]
    (tmp_path / "words.tsv").write_text("# note\nutilize\tuse\n\nplain\n")
    assert sorted(map(tuple, L.read(spark, str(tmp_path / "words.tsv")).collect()), key=str) == [("plain", None), ("utilize", "use")]
    profiles = Profiles(spark, str(tmp_path / "profiles"))
    texts = spark.createDataFrame([("a", "one two"), ("b", "three")], "name string, text string")
    assert profiles.names() == []
    profiles.add("My Voice", "exemplars", texts)
    with pytest.raises(FileExistsError):
        profiles.add("my-voice", "exemplars", texts)
    with pytest.raises(ValueError):
        normalized("no/slash")
    assert [(r["profile"], r["documents"], r["words"]) for r in profiles.summary().collect()] == [("my-voice", 2, 3)]
    spark.createDataFrame([(1, "An — dash"), (2, "None")], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    stream = verdicts.read(spark, str(tmp_path / "docs"), "doc_id long, text string")
    verdicts.slop(stream, None, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert {r["doc_id"]: r["findings"] for r in spark.read.parquet(str(tmp_path / "out/*")).collect()} == {1: 1, 2: 0}


def test_rewrites_are_accepted_at_the_reference_threshold(spark):
    """Over the embeddings table: accepted only where the next vector keeps the meaning (0.85) and comes nearer; the SQL agrees."""
    import duckdb

    from quillon.plans import queries, voice_queries  # noqa: F401

    small = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{small}/embeddings.parquet'")
    vectors = {r[0]: r[1] for r in con.execute("select vec_id, embedding::double[] from embeddings").fetchall()}
    rows = queries.QUERIES["evaluate_rewrite"](spark, small).collect()
    norm = lambda v: sum(x * x for x in v) ** 0.5
    for r in rows:
        a, b = vectors[r["id"]], vectors[r["id"] + 1]
        cosine = sum(x * y for x, y in zip(a, b, strict=True)) / (norm(a) * norm(b))
        assert r["accepted"] == (cosine >= 0.85 and r["after"] < r["before"])
    assert rows
    expected = con.execute(f"select id, before, after, accepted from ({queries.SQL['evaluate_rewrite']}) q").fetchall()
    assert sorted(tuple(r[n] for n in ("id", "before", "after", "accepted")) for r in rows) == sorted(expected)
