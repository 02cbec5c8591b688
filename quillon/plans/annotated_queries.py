"""Registered queries of rules that need parts of speech; a tagger has no SQL, so tests hold them against examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import annotate, rubric, rules, tagged, tells, voice
from quillon.plans import fixtures
from quillon.plans.queries import on_docs

for _name, _relation in {
    "tell_dropped_subject": annotate.dropped_subject,
    "tell_empty_punch": annotate.empty_punch,
    "noun_trains": lambda a: annotate.noun_trains(a).where("trains > 2"),
    "passive_voice": annotate.passive_voice,
    "defensive_claim": annotate.defensive_claim,
    "verbless_sentence": annotate.verbless,
    "comma_splice": annotate.comma_splice,
    "buried_verb_core": annotate.buried_verb,
    "padding_paragraph": annotate.padding,
    "pos_rates": annotate.pos_rates,
    "dict_imperative_ratio": annotate.imperative_ratio,
}.items():
    on_docs(_name, lambda d, r=_relation: r(annotate.tokens(d)), None)
on_docs("lex_mtld", lambda d: annotate.mtld(d), None)
on_docs("metric_concreteness", lambda d: annotate.concreteness(annotate.tokens(d), fixtures.norms(d)), None)


def _concreteness(docs):
    values = annotate.concreteness(annotate.tokens(docs), fixtures.norms(docs))
    return voice.prior_report(values.select("doc_id", F.lit("concreteness").alias("axis"), F.col("mean").alias("value")))


def _slop(docs, relative=False):
    """Findings of all 21 tells; the two tagged ones are read twice at most, as the others are."""
    rhythm = annotate.rhythm(docs)
    norm = tells.baseline(docs).unionByName(tells.norm_of(rhythm)) if relative else None
    return tells.findings(docs, norm, rhythm)


def _schimel(docs):
    return rubric.together(rules.findings(docs), tagged.findings(None, docs))


def _density(docs):
    return tagged.density(annotate.tokens(docs), docs, fixtures.frequencies(docs))


on_docs("concreteness_report", _concreteness, None)
on_docs("slop_whole_findings", _slop, None)
on_docs("slop_whole_result", lambda d: rubric.result(d, _slop(d), rubric.SLOP), None)
on_docs("slop_whole_relative_result", lambda d: rubric.result(d, _slop(d, True), rubric.SLOP), None)
on_docs("schimel_tagged_findings", lambda d: tagged.findings(None, d), None)
on_docs("schimel_whole_result", lambda d: rubric.result(d, _schimel(d), rubric.SCHIMEL), None)
on_docs("density_findings", _density, None)
on_docs("density_result", lambda d: rubric.result(d, _density(d), rubric.DENSITY), None)
on_docs("density_report", lambda d: (lambda found: rubric.render(rubric.result(d, found, rubric.DENSITY), found, "density", rubric.DENSITY))(_density(d)), None)
