"""What the driver holds while the pipeline runs: round 2's check stopped it beyond its memory."""

import gc

from pyspark.sql import functions as F

from quillon.llm import common, toxicity


def test_the_jvm_is_asked_to_give_memory_back_at_each_checkpoint(spark, monkeypatch):
    said, ask = [], common._trim_jvm
    monkeypatch.setattr(common, "_trim_jvm", lambda gateway: said.append(ask(gateway)) or said[-1])
    assert common.checkpointed(spark.range(5)).count() == 5
    assert len(said) == 1 and "rim native heap" in said[0]


def test_the_driver_keeps_no_model_while_examples_are_asked(spark, monkeypatch):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("a plain "), F.when(F.col("id") % 3 == 0, "vile").otherwise("kind"), F.lit(" text of some words "), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    held, fit = [], toxicity.fit_logistic

    def asked(x, y):
        held.append([o for o in gc.get_objects() if isinstance(o, toxicity.Index | toxicity.Model)])
        return fit(x, y)

    monkeypatch.setattr(toxicity, "fit_logistic", asked)
    scored = toxicity.score(docs, labels).collect()
    assert held == [[]]
    assert len(scored) == 400
    assert all(r.predicted == (r.doc_id % 3 == 0) for r in scored)
