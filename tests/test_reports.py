import json

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import annotate, features, lexical, papers, report, rubric, rules, tagged, tells, voice


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_runs_of_short_sentences_count_once_and_cost_rhythm(spark):
    rows = docs(spark, "It ran. It fell. It rose. It stood.\n\nA long sentence of more than eight words stands between them here. One. Two.", "One. Two.", "")
    found = {r["doc_id"]: r for r in rows.select("doc_id", T.worded(F.col("text")).alias("s")).select("doc_id", T.short_runs(F.col("s")).alias("n"), T.first_short_run(F.col("s")).alias("span")).collect()}
    assert [found[i]["n"] for i in range(3)] == [1, 0, 0] and found[0]["span"] == "It ran. It fell. It rose." and found[1]["span"] == ""
    verdicts = {r["doc_id"]: r["dim_rhythm"] for r in rubric.result(rows, tells.findings(rows), rubric.SLOP).collect()}
    assert verdicts == {0: 0.9, 1: 1.0, 2: 1.0}


def test_rhythm_has_the_tagged_tells(spark):
    rows = docs(spark, "---\na: b\n---\nThe answer is thin. Runs badly now.", "The parser dropped a row of the table that we had made.", "")
    found = {(r["doc_id"], r["tell"]): (r["n"], r["span"]) for r in annotate.rhythm(rows).collect()}
    assert found[0, "empty_punch"] == (1, "The answer is thin.") and found[0, "dropped_subject"] == (1, "Runs badly now.")
    assert found[1, "empty_punch"] == (0, "") and found[2, "dropped_subject"] == (0, "") and len(found) == 6
    assert {r["rule"] for r in tells.findings(rows, None, annotate.rhythm(rows)).collect()} == {"empty_punch", "dropped_subject"}


def test_a_norm_needs_documents(spark):
    with pytest.raises(Exception, match="at least one document"):
        tells.baseline(docs(spark, "x").where("false")).collect()


def test_tagged_rules(spark):
    rows = docs(spark, "The test was reviewed. The code was finished. The plan was changed. We do not claim that.\n\nThe normalisation normalises what is said.", "")
    found = tagged.findings(annotate.tokens(rows), rows).collect()
    by = {r["rule"]: r for r in found}
    assert by["passive_voice"]["message"].startswith("3 passive verbs in 5") or by["passive_voice"]["message"].startswith("4 passive")
    assert (by["defensive_claim"]["paragraph"], by["defensive_claim"]["sentence"]) == (1, 4)
    assert by["word_repetition"]["span"] == "normalisation / normalises" and by["word_repetition"]["paragraph"] == 2
    assert {r["doc_id"] for r in found} == {0}
    whole = rules.findings(rows).unionByName(tagged.findings(annotate.tokens(rows), rows))
    assert "schimel: FAIL" in rubric.render(rubric.result(rows, whole, rubric.SCHIMEL), whole, "schimel", rubric.SCHIMEL).where("doc_id = 0").first()["report"]


def test_density(spark):
    rows = docs(spark, "Quark gluon plasma hadron (HADR) sits here. The day was long and the time was good.\n\nTime day time good.", "")
    table = spark.createDataFrame([(w, 6.0) for w in "sits here the day was long and time good".split()], "word string, zipf double")
    found = tagged.density(annotate.tokens(rows), rows, table).collect()
    assert [(r["rule"], r["paragraph"], r["sentence"]) for r in found] == [("jargon_cluster", 1, 1)]
    assert "gluon, hadron, plasma" in found[0]["message"]
    assert rubric.result(rows, tagged.density(annotate.tokens(rows), rows, table), rubric.DENSITY).where("doc_id = 0").first()["dim_jargon"] == 0.9


def test_reports_against_priors(spark):
    rows = docs(spark, "It may perhaps rain. It rains.", "It rains a lot.")
    found = {(r["doc_id"], r["axis"]): r for r in voice.prior_report(report.hedge_values(rows)).collect()}
    value = [found[i, "hedge"]["value"] for i in (0, 1)]
    assert found[0, "hedge"]["reference_mean"] == pytest.approx(0.5 * sum(value) / 2 + 0.5 * 6.0)
    assert found[0, "hedge"]["direction"] == "fewer" and found[1, "booster"]["value"] == 0


def test_voice_report(spark):
    mine = docs(spark, "A calm text, without haste.", "Another calm text follows it.")
    draft = spark.createDataFrame([(7, "We delve — into it — now."), (8, "Calm words follow.")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in report.voice_report(draft, mine).collect()}
    assert [m["name"] for m in found[7]["direction"]][:1] == ["tell_dash"] and found[8]["direction"] == []
    assert len(found[7]["hedge"]) == 2 and len(found[7]["fw"]) == 5 and len(found[7]["markdown"]) == 11


def test_hdd_against_draws_counted_by_hand(spark):
    from math import comb

    words = "a b c d e f g h i j".split() * 4 + ["a", "b", "k", "l", "m"]
    n = len(words)
    expected = sum(1 - comb(n - words.count(w), 42) / comb(n, 42) for w in set(words)) / 42
    found = [r["hdd"] for r in features.hdd(docs(spark, " ".join(words), "too few")).orderBy("doc_id").collect()]
    assert found[0] == pytest.approx(expected) and found[1] is None


def test_one_row_of_features(spark):
    rows = docs(spark, "---\nname: a-b\n---\nWe utilize sufficient means.", "", "x")
    found = {r["doc_id"]: r for r in features.analyze(rows).collect()}
    assert json.loads(found[0]["frontmatter_json"]) == {"name": "a-b"} and json.loads(found[0]["dict_plain_replacements_json"]) == [["utilize", "use"], ["sufficient", "enough"]]
    assert (found[1]["frontmatter_json"], found[1]["dict_plain_replacements_json"]) == ("{}", "[]")
    d = features.descriptive(docs(spark, "One two three. Four five.", "")).orderBy("doc_id").collect()
    assert (d[0]["desc_n_tokens"], d[0]["desc_sentence_length_median"], d[0]["desc_sentence_length_std"]) == (5, 2.5, 0.5)
    assert d[1]["desc_n_tokens"] == 0 and d[1]["desc_token_length_mean"] is None


def test_modes_and_spans(spark):
    rows = spark.createDataFrame([(0, i, [float(i >= 3) * 10 + i * 0.1, 1.0]) for i in range(6)], "profile long, id long, v array<double>")
    found = voice.mixed(rows).first()
    assert found["mixed"] and found["exemplars"] == 6 and found["silhouette"] > 0.9
    few = voice.mixed(rows.where("id in (0, 1, 4)")).first()
    assert not few["mixed"] and few["silhouette"] is None
    model = spark.createDataFrame([(1.0, 2.0)], "floor double, spread double")
    far = spark.createDataFrame([(1, i, d) for i, d in enumerate((3.0, 9.0, 5.0, 5.0))] + [(2, 0, 4.0)], "doc long, i long, distance double")
    assert [(r["i"], r["distance_z"]) for r in voice.span_guidance(far, model).orderBy("doc", "place").collect()] == [(1, 4.0), (2, 2.0), (3, 2.0)]


def test_sign_test(spark):
    train = spark.createDataFrame([(1, [0.0] * 8)], "id long, z array<double>")
    drafts = spark.createDataFrame([(2, [9.0, 9.0] + [0.0] * 6)], "id long, z array<double>")
    picked = spark.createDataFrame([(2, "a"), (2, "b")], "id long, name string")
    found = voice.sign_test(drafts, train, picked, list("abcdefgh"), most=2).first()
    assert found["win"] and found["advised"] == pytest.approx(162**0.5) and found["chance"] < found["advised"]


def test_paper_paragraphs(spark):
    lines = ["jane@example.org", "John Smith, Mary Jones", "", "All rights reserved", "The method works well on long texts."]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in lines], "x string").select(papers.looks_like_metadata_line(F.col("x"))).collect()] == [True, True, True, True, False]
    said = "John Smith, Mary Jones\nThe method works. Keywords: a, b.\nIt ends well. And then it"
    row = spark.createDataFrame([(said, "A Title A, B, C, D The method is good.", "a title", "x Abstract here")], "p string, q string, t string, a string")
    found = row.select(papers.normalize_paragraph(F.col("p")).alias("p"), papers.strip_title_author_preamble(F.col("q"), F.col("t")).alias("q"), papers.strip_title_author_preamble(F.col("a"), F.lit("")).alias("a")).first()
    assert (found["p"], found["q"], found["a"]) == ("The method works. It ends well.", "The method is good.", "Abstract here")
    prose = "The method is good and says a lot about the text that we have. " * 4
    out = papers.cleanup(docs(spark, f"---\nname: a\n---\n\n{prose}", prose, "")).orderBy("doc_id").collect()
    assert out[0]["text"].startswith("---\nname: a\n---\n\nThe method") and out[1]["text"].startswith("The method") and out[2]["text"] == ""
    assert lexical.repeated(docs(spark, "")).count() == 0


def test_command_line(spark, tmp_path, capsys):
    from quillon.__main__ import main

    (tmp_path / "posts").mkdir()
    (tmp_path / "posts" / "a.md").write_text("The answer is thin. Runs badly now. We delve — deep.")
    (tmp_path / "posts" / "skip.log").write_text("x")
    posts, root = str(tmp_path / "posts"), str(tmp_path / "profiles")
    assert main(["slop", posts, "--text"]) == 0 and "rhythm: empty_punch" in capsys.readouterr().out
    for command in (["check", posts], ["check", posts, "--rubric", "density"], ["analyze", posts], ["profiles", root, "--add", "me", "--path", posts], ["score", posts, "--root", root, "--profile", "me"]):
        assert main(command) == 0
        out = capsys.readouterr().out.strip().splitlines()
        assert len(out) == 1 and json.loads(out[0])
    main(["analyze", posts, "--out", str(tmp_path / "out")])
    assert spark.read.json(str(tmp_path / "out")).count() == 1
