import re

import pytest
from pyspark.sql import functions as F

from quillon.functions import patterns as P
from quillon.functions import text as T
from quillon.operators import prose


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text"))).first()[0]


def test_splitting(spark):
    assert value(spark, T.paragraphs, "a\n\n\n\n b b b\n\ncc") == ["a", "b b b", "cc"]
    assert value(spark, lambda t: T.sentences(t, 3), "Hi. This one is longer.") == ["This one is longer."]
    assert value(spark, T.paragraphs, "") == []
    assert value(spark, T.words, "L'été à São_Paulo, 42!") == len(re.findall(r"\w+", "L'été à São_Paulo, 42!"))


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("---\ntitle: x\n---\nBody.", "Body."),
        ("a\n```py\ncode\n```\nb", "a\n\nb"),
        ("Use `x` now", "Use  now"),
        ("x < 3 and y > 2, <b>bold</b>", "x < 3 and y > 2, bold"),
        ("See [link](url) ![img](a.png)", "See link"),
        ("# Title\ntext[^1]\n[^1]: note", "text\nnote"),
        ("> quote\n- item\n1. one", "quote\nitem\none"),
        ("**b** __u__ ~~s~~ *i* _j_ 4*7 and 3*5 snake_case_id", "b u s i j 4*7 and 3*5 snake_case_id"),
        ("| a | b |\n|---|---|\n| 1 | 2 |\nafter", "after"),
        ("a\n\n\n\nb", "a\n\nb"),
    ],
)
def test_markup(spark, text, expected):
    assert value(spark, T.strip_markup, text) == expected


def test_clean_and_latex(spark):
    assert value(spark, T.clean, "a\r\nb exam-\nple ( x ) , y\u00ad") == "a\nb example (x), y"
    assert value(spark, T.looks_like_latex, r"\section{A}") and not value(spark, T.looks_like_latex, "plain")
    plain = value(spark, T.plain_tex, "\\section{Intro} We \\textbf{show} it \\cite{a}.\n% note\n\\begin{figure}x\\end{figure}")
    assert "We show it" in plain and "cite" not in plain and "note" not in plain and "figure" not in plain
    assert value(spark, T.slug, " My File!.md ") == "my-file-md"


def test_sections(spark):
    texts = ["", "One.", "The problem.\n\nWe ask whether. To determine it.\n\nWhether so.\n\nEnd.\n\nLast."]
    rows = prose.sections(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r["n"], r["challenge"], r["resolution"]) for r in rows] == [(0, None, ""), (1, None, "One."), (5, 1, "Last.")]


def test_every_pattern_is_valid_java(spark):
    each = [*P.TELLS.values(), *P.RULES.values(), *(p for p, _ in P.MARKUP.values()), *(p for p, _ in P.CLEAN + P.LATEX_NOISE + P.DETEX)]
    row = spark.range(1).select(*(T.count(F.lit("text"), p).alias(str(i)) for i, p in enumerate(each))).first()
    assert all(n is not None for n in row)


def test_names_of_whole_texts(spark):
    """As the reference on the whole text: the slug, "document" for none, the name and whether it is valid; the SQL agrees."""
    import re

    import duckdb

    from quillon.plans import fixtures, queries

    small = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    texts = {r["doc_id"]: r["text"] for r in fixtures.documents(spark, small).collect()}
    assert any(len(t) > 40 for t in texts.values() if t)
    for name in ("slug_filename", "normalize_profile_name"):
        rows = queries.QUERIES[name](spark, small)
        found = sorted(tuple(r) for r in rows.collect())
        assert found == sorted(con.execute(f"select {', '.join(rows.columns)} from ({queries.SQL[name]}) q").fetchall())
        for doc_id, value, *valid in found:
            low = texts[doc_id].strip().lower()
            if valid:
                assert value == low.replace(" ", "-") and valid[0] == bool(re.fullmatch("[a-z0-9][a-z0-9_-]*", value))
            else:
                assert value == (re.sub("[^a-z0-9]+", "-", low).strip("-") or "document")
    from pyspark.sql import functions as F

    from quillon.functions import text as T

    row = spark.createDataFrame([(" My Profile Name Of Words ", " ... ")], "a string, b string").select(T.profile_name(F.col("a")), T.valid_profile_name(F.col("a")), T.file_name(F.col("b"))).first()
    assert tuple(row) == ("my-profile-name-of-words", True, "document")
