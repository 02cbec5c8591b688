"""Findings of round 3."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillon.operators import pairs, tells, voice
from quillon.plans import fixtures, queries, voice_queries

ODD = (
    "", " \n\n ", "…!\n\n?", "İT'S NOT JUST that, BUT. ıt's worth notıng. İn conclusıon, Needleſſ to say. It’s “so”. taKe this with a grain of ſalt",
    "one, two, and　three. été, naïve,\u0085and œuvre", "édelve delvé delvé _delve Delve. GAME-CHANGER gamechanger game changer!",
    "Not only " + "x" * 60 + " but also. Not only " + "x" * 61 + " but also.", "---\n\n*** \n____\r\n--- \n", "**a**:\n - **b** —\n\n  **c**:",
    "It ran. \n \n It fell? It rose!\n\nMore of it here.\n\n\n\n...\n\n So. \"Look,\" he said. Look at it: a, b, c. Honestly.\x85Look! Let's be honest", "😀😀 ✨🇩🇪 x 🚀.", "no end.A. B.\tC. D. e",
)


def test_tells_are_counted_only_where_they_may_occur(spark):
    """Every text was searched for each of 18 patterns, one by one; a looser search in another engine may leave none out."""
    texts = [*fixtures.SPIKES, *ODD, None]
    texts = [(i, t and t.replace("^", "'").replace("|", "\n")) for i, t in enumerate(texts)] + [(1000 + i, t and t.upper()) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("text", F.coalesce("text", F.lit("")))
    found, searched = tells.sifted(docs), tells.rates(docs)
    assert found.columns == searched.columns
    assert sorted(found.collect()) == sorted(searched.collect())
    some = searched.agg(*(F.max(c) for c in searched.columns[1:])).first()
    assert all(x > 0 for x in some)


def test_texts_without_labels_are_not_searched(spark):
    """All documents were searched, and those without labels, three in five, left out afterwards."""
    plan = voice_queries._labelled(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("LeftSemi")


def _block(m: np.ndarray, **columns: pa.Array) -> pairs.Block:
    row = {"sizes": pa.scalar(np.full(len(m), m.shape[1], np.int32).tobytes(), pa.binary()), "m": pa.scalar(np.ascontiguousarray(m).tobytes(), pa.binary())}
    return pairs.Block(row | {n: pa.scalar(x.to_pylist(), pa.list_(x.type)) for n, x in columns.items()}, "", list(columns))


def test_far_exemplars_are_not_compared(monkeypatch):
    """Each draft was compared with each exemplar 22 times."""
    random, squared, compared = np.random.default_rng(0), pairs.squared, []
    m = np.full((20_000, 19), -0.1)
    m[np.arange(len(m)), random.integers(0, 18, len(m))] = random.exponential(5, len(m))
    m[:, 18] = random.normal(size=len(m))
    order, ends = pairs._leaves(m)
    assert sorted(order) == list(range(len(m))) and np.diff(ends, prepend=0).max() <= pairs.LEAF
    q = np.vstack([m[:20], np.where(random.random((1000, 19)) < 0.3, 0.0, m[-1000:] + random.normal(size=(1000, 1)) * 0.1)])

    def spied(a, b, *how):
        compared.append(len(a) * len(b))
        return squared(a, b, *how)

    monkeypatch.setattr(pairs, "squared", spied)
    near = pairs.nearest(_block(q), _block(m[order], ends=pa.array(ends, pa.int32())))
    assert sum(compared) < len(q) * len(m) / 4
    assert np.allclose(near, squared(q, m).min(axis=1), rtol=1e-9, atol=0) and not near[:20].any()


def test_leaves_find_what_all_pairs_find(spark):
    """Equal exemplars, vectors of other sizes, without a value or not finite."""
    rows = [(i, [float(i % 5), float(i % 3), 0.0]) for i in range(600)] + [(700, [1.5, 9.0, 1e200]), (701, [0.5, 0.5, 0.5]), (702, [0.25, -7.0, 0.0])]
    odd = [(800, [1.0]), (801, None), (802, []), (803, [1.0, None, 2.0]), (804, [float("nan"), 1.0, 1.0])]
    make = lambda x: spark.createDataFrame(x, "id long, z array<double>")
    asked = make([*rows[::50], *rows[-3:]])
    for queries_, train in ((asked, make(rows[:600])), (asked, make(rows[:600] + odd)), (make(rows[-3:] + odd), make(rows[:600])), (make(rows + odd), make(odd)), (asked, make(rows[:0]))):
        found, all_pairs = (sorted(map(repr, voice.knn(queries_, train, leaves=x).collect())) for x in (True, False))
        assert found == all_pairs


def test_sign_test_over_shuffled_exemplars(spark, monkeypatch):
    """Beyond what may be broadcast the same rows come from a join of blocks."""
    of = lambda: sorted(queries.QUERIES["sign_test"](spark, "/root/testdata/sf0.001").collect())
    rows = of()
    monkeypatch.setattr(voice, "EXEMPLARS", 1)
    monkeypatch.setattr(voice_queries, "LABELS", 1)
    monkeypatch.setattr(pairs, "TREE", 20)
    assert rows and of() == rows
