import pytest

from quillon.operators import annotate, rubric, rules, tells

EXAMPLES = [
    ('He said the plan was "at stake," and then left the room.', "quote_punct", True),
    ('He said the plan was "at stake", and then left the room.', "quote_punct", False),
    ("The build has three stages: compile, link, and run.", "colon_list", True),
    ("The build has one stage: compilation.", "colon_list", False),
    ("Which brings me to the second point. Here the story stops.", "self_narration", True),
    ("What I cannot do, with this data, is tell you it is better.", "apologetic", True),
    ("We build, test, and ship.", "rule_of_three", True),
    ("An em — dash", "dash", True),
    ("Honestly, it works.", "rhetorical_opener", True),
    ("It works. honestly.", "rhetorical_opener", False),
    ("---\ntitle: a\n---\ntext", "hr_divider", False),
    ("a\n---\nb", "hr_divider", True),
]
CLEAN = "I fixed the parser today. It dropped the last row, so I added a guard and a test."


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_tell_examples(spark):
    found = {(r["doc_id"], r["tell"]): r["n"] for r in tells.long(docs(spark, *(t for t, _, _ in EXAMPLES))).collect()}
    for i, (text, tell, fires) in enumerate(EXAMPLES):
        assert (found[i, tell] > 0) == fires, text


def test_clean_text_passes(spark):
    d = docs(spark, CLEAN, "")
    assert tells.findings(d).count() == 0
    assert {(r["verdict"], r["overall"]) for r in rubric.result(d, tells.findings(d), rubric.SLOP).collect()} == {("pass", 1.0)}


def test_relative_findings_need_more_than_the_norm(spark):
    corpus = docs(spark, "One — two words here. " * 5, "One — two words here. " * 5, "One two words here. " * 5)
    norm = tells.baseline(corpus)
    drafts = docs(spark, "One — two words here. " * 5, "One — — — — — two words here. " * 5)
    found = [(r["doc_id"], r["rule"]) for r in tells.findings(drafts, norm).collect()]
    assert found == [(1, "dash")]
    assert "your corpus norm" in tells.findings(drafts, norm).first()["message"]


def test_result_algebra(spark):
    schema = "doc_id long, ord int, severity string, dimension string, rule string, paragraph long, sentence long, span string, message string"
    rows = [(0, i, "medium", "sentences", "comma_splice", None, None, "", "") for i in range(10)] + [(1, 0, "high", "opening", "a", 1, None, "", "m"), (1, 1, "low", "clarity", "b", None, None, "", "n"), (1, 2, "high", "clarity", "c", None, None, "", "o")]
    findings = spark.createDataFrame(rows, schema)
    found = {r["doc_id"]: r for r in rubric.result(docs(spark, "x", "y", "z"), findings, rubric.SCHIMEL).collect()}
    assert found[0]["dim_sentences"] == 0.9 and found[0]["verdict"] == "pass" and found[0]["findings"] == 10
    assert found[1]["verdict"] == "fail" and found[1]["dim_clarity"] == 0.7 and found[2]["overall"] == 1.0
    assert [r["rule"] for r in rubric.ranked(findings).where("doc_id = 1").orderBy("place").collect()] == ["a", "c", "b"]
    report = {r["doc_id"]: r["report"] for r in rubric.render(rubric.result(docs(spark, "x", "y"), findings, rubric.SCHIMEL), findings, "schimel", rubric.SCHIMEL).collect()}
    assert report[1].startswith("schimel: FAIL (0.92)\n\nopening      0.75") and "- P1: a; m" in report[1]


@pytest.mark.parametrize(
    ("rule", "text", "fires"),
    [
        ("opening_problem_present", "Nothing here.", True), ("opening_problem_present", "The problem is key.", False),
        ("weak_resolution", "A.\n\nMore research is needed.", True), ("caveat_closing", "A.\n\nDone. However, it fails.", True),
        ("undefined_acronyms", "The NATO plan.", True), ("undefined_acronyms", "The (NATO) plan. NATO won.", False),
        ("overloaded_sentence", "a, b, c, d, e.", True), ("number_ladder", "1.0 2.0 3.0 4.0 5% 6 %", True),
        ("coy_predicate", "The key is time.", True), ("orphan_pronoun", "This shows it.", True), ("orphan_pronoun", "This finding holds.", False),
        ("overclaim_words", "It proves all.", True), ("latinate_diction", "We utilize it.", True), ("citation_as_subject", "Smith (2003) found it.", True),
        ("significance_without_magnitude", "It rose significantly.", True), ("significance_without_magnitude", "It rose significantly by 5%.", False),
        ("preposition_chain", "the end of the day of the year of it", True), ("metadiscourse_frame", "We found that it is.", True),
    ],
)
def test_rules(spark, rule, text, fires):
    assert (rules.rule(docs(spark, text), rule).count() > 0) == fires


def test_one_pass_equals_the_rules_one_by_one(spark):
    d = docs(spark, *(t for t, _, _ in EXAMPLES), "The NATO plan proves it, a, b, c, d.\n\nThis shows 1.0 2.0 3.0 4.0 5% 6%. The key is time. More research is needed.", "a, b, c, d, e. " * 14)
    whole = {(r["doc_id"], r["rule"], r["severity"], r["paragraph"], r["sentence"], r["span"]) for r in rules.findings(d).collect()}
    single = {(r["doc_id"], n, r["severity"], r["paragraph"], r["sentence"], r["span"]) for n in rules.TEXT_RULES for r in rules.rule(d, n).collect()}
    assert whole == single
    assert rules.rule(d, "overloaded_sentence").where("doc_id = 13").count() == rules.MOST


@pytest.mark.parametrize(
    ("relation", "text", "fires"),
    [
        (annotate.dropped_subject, "Sits alone with this report for hours.", True), (annotate.dropped_subject, "Consider the following. Stop that.", False),
        (annotate.empty_punch, "The answer is thin.", True), (annotate.empty_punch, "The parser dropped a row.", False),
        (annotate.defensive_claim, "We do not claim it.", True), (annotate.defensive_claim, "We claim it.", False),
        (annotate.verbless, "A long phrase about nothing at all.", True), (annotate.verbless, "The long phrase is about nothing.", False),
    ],
)
def test_rules_of_parts_of_speech(spark, relation, text, fires):
    assert (relation(annotate.tokens(docs(spark, text))).count() > 0) == fires


def test_shares_of_parts_of_speech_sum_to_one(spark):
    rows = annotate.pos_rates(annotate.tokens(docs(spark, CLEAN))).groupBy("doc_id").sum("rate").collect()
    assert rows[0][1] == pytest.approx(1.0)


def test_schimel_report_says_what_was_found(spark):
    d = docs(spark, "The NATO plan proves it, a, b, c, d.", "a, b, c, d, e. 1.0 2.0 3.0 4.0 5% 6%.")
    found = rules.findings(d)
    assert found.where("message is null or message like '%\\%d%'").count() == 0
    reports = {r["doc_id"]: r["report"] for r in rubric.render(rubric.result(d, found, rubric.SCHIMEL), found, "schimel", rubric.SCHIMEL).collect()}
    assert all(r.startswith("schimel: FAIL (") and "Top findings" in r for r in reports.values())
    single = {(r["doc_id"], n, r["message"]) for n in rules.TEXT_RULES for r in rules.rule(d, n).collect()}
    assert {(r["doc_id"], r["rule"], r["message"]) for r in found.collect()} == single
