"""Operators that look at one text at a time, against the libraries or brute force."""

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer, models

from quillon.llm import packing, pii, sentence_pieces, token_counts
from quillon.llm.chunks import chunk_keys, escaped

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", " ", "  ", "a", "  a  b ", "\ta\n\nb", "é", "ﬁ²", "a▁b", "　x", "a\x00b", "</s>x<s>", "<0x0A>", "🎉🎉 a", " " * 37 + "x" + " " * 19, "a" * 300, "== ## \n\n  x", "it's we'll", "a \n b", "a\n b", "a \nb", "x \x85 y", "a\x1c b", "<|endoftext|> x", "a <|endoftext|><|endoftext|>  b", "<|endoftext", "  lead", "a\u180e b \u180e c", "we'll  'll it's", "\u2028 x \x1f y  "]


def made(n, seed=3):
    rng = random.Random(seed)
    words = ["the", "tion", "über", "été", "niño", "12", "a.b", "ing", "\n", "日本", " ", "  ", "don't", "🎉", "x" * 50, "\t"]
    return [rng.choice((" ", "", " ")).join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(n)]


def test_chunks_spell_the_text():
    for text in TEXTS + made(200):
        whole = "▁" + text.replace(" ", "▁") if text else ""
        assert "".join(map(escaped, chunk_keys(text))) == whole


def test_sentence_pieces_equal_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = TEXTS + made(300)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in sentence_pieces.encode(docs, PIECES).collect()}
    for i, text in enumerate(texts):
        assert found[i]["ids"] == library.encode(text), repr(text)
        assert found[i]["decoded"] == library.decode(library.encode(text)), repr(text)


def test_agenda_and_agendas_agree():
    with open(PIECES, "rb") as f:
        model = sentence_pieces.PieceModel(f.read())
    chunks = [escaped(k) for t in made(200) for k in chunk_keys(t) if len(k) < 30]
    for size in {len(c) for c in chunks}:
        same = [c for c in chunks if len(c) == size]
        assert model.agendas(same) == [model.agenda(c) for c in same]


def test_token_counts_equal_a_unigram_model():
    pieces = token_counts.pieces_of(PIECES)
    counter = token_counts.UnigramCounter(pieces)
    library = Tokenizer(models.Unigram([("<unk>", 0.0)] + [(f"<0x{b:02X}>", 0.0) for b in range(256)] + list(pieces), unk_id=0, byte_fallback=True))
    for text in TEXTS + made(300):
        if "<0x" not in text and "<unk" not in text:
            assert counter(text)[0] == len(library.encode("▁" + text.replace(" ", "▁")).ids if text else []), repr(text)


def test_token_count_ties_prefer_the_longest_last_piece():
    counter = token_counts.UnigramCounter((("a", -1.0), ("aa", -2.0), ("▁", -1.0)), byte_pieces=False)
    library = Tokenizer(models.Unigram([("<unk>", 0.0), ("a", -1.0), ("aa", -2.0), ("▁", -1.0)], unk_id=0))
    for n in range(1, 9):
        assert counter("a" * n)[0] == len(library.encode("▁" + "a" * n).ids)


def test_packing_holds_each_id_once(spark):
    library = Tokenizer.from_file(BYTES)
    texts = TEXTS + made(300) + ["long text here " * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs, BYTES).collect():
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, text in enumerate(texts):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and at & (at - 1) == 0  # no padding at all


def test_base_patterns_equal_the_regexes():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice("ab@.-@ é1_") for _ in range(rng.randint(0, 16)))
        assert pii.emails(text) == [m.span() for m in email.finditer(text)], text
    assert pii.base_spans("300.1.1.1 1.2.3.4 x") == {"email": [], "ip": [(10, 17)], "card": [], "phone": []}
    assert pii.base_spans("4111 1111 1111 1111")["card"] == [(0, 19)]
    assert pii.base_spans("+1 (555) 555-0100")["phone"] == [(0, 17)]
    assert pii.base_spans("a" * 200_000 + "@")["email"] == []


def plain_base(text):
    """The contract's base spans, by its patterns as they stand."""
    digits = lambda m: re.sub("[^0-9]", "", m[0])

    def luhn(number):
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(number))]
        return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0

    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15],
    }


def test_base_columns_of_the_query_equal_brute_force(spark):
    rng = random.Random(4)
    parts = ["a.b@c.org", "x@y", "@", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8.9", "0001.2.3.004", "4111 1111 1111 1111", "4111-1111-1111-1112", "123456789012345678901", "+1 (555) 555-0100", "+49", "+1..2", "+12 34 56 78 9", "é", "text", "12", " ", "-", ".", "٣"]
    texts = ["".join(rng.choice((" ", "", "", "\n")) + rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(1500)] + [None, ""]
    found = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        base = plain_base(text or "")
        written = ",".join(f"{k}:{a}:{b}" for k in pii.BASE for a, b in base[k])
        assert [found[i][f"n_{k}"] for k in pii.BASE] == [len(base[k]) for k in pii.BASE], text
        assert found[i]["base_sha256"] == hashlib.sha256(written.encode()).hexdigest(), text
        assert set(written.split(",")) - {""} <= set(found[i]["spans"].split(",")), text


@pytest.mark.parametrize("unit,n", [("7", 1_000_000), ("1.", 20_000), ("at ", 200_000), ("a1-", 20_000), ("+1 ", 20_000), ("x@a.", 20_000)])
def test_personal_data_of_very_long_texts_takes_linear_time(unit, n):
    text, field = unit * (n // len(unit)), pii.trained()
    began = time.process_time()
    pii.all_spans(text[: n // 8], field)
    small = time.process_time() - began
    began = time.process_time()
    pii.all_spans(text, field)
    assert time.process_time() - began < 16 * small + 1


def test_field_finds_what_it_was_not_trained_on():
    field, hits, wrong, missed = pii.trained(), 0, 0, 0
    for text, spans in pii.sentences(200, seed=12345):
        found, right = set(pii.all_spans(text, field)[1]), set(spans)
        hits, wrong, missed = hits + len(found & right), wrong + len(found - right), missed + len(right - found)
    assert hits / (hits + missed) > 0.95 and hits / (hits + wrong) > 0.95


def test_field_decodes_the_best_segmentation():
    """Dynamic programming against all segmentations, and marginals against their sum."""
    field = pii.trained()
    text = "call +49 151 222 333 or ab at cd dot com 1.2.3.4"
    tokens = pii.tokens_of(text)
    segments = [s for s in pii.candidates(text, tokens, [False] * len(tokens))][:14]
    weight = field.scores(segments)

    def all_of(at, chosen):
        yield chosen
        for k, s in enumerate(segments):
            if s[0] >= at:
                yield from all_of(s[1], [*chosen, k])

    every = list(all_of(0, []))
    totals = [sum(weight[k] for k in c) for c in every]
    best = field.best(len(tokens), segments)
    assert sum(weight[k] for k, s in enumerate(segments) if s[:3] in best) == pytest.approx(max(totals))
    z = sum(np.exp(totals))
    for k, p in enumerate(field.marginals(len(tokens), segments)):
        assert p == pytest.approx(sum(np.exp(t) for t, c in zip(totals, every, strict=True) if k in c) / z, abs=1e-9)


def test_windows_equal_the_whole_text(spark):
    """Addresses in words are found without a digit, @, = or : near them, as by decoding the whole text."""
    field, rng = pii.trained(), random.Random(5)
    filler = ["sang", "look", "at", "At", "the", "chez", "mail", "dot", "point", "über", "weather", "x_at_y", "end.", "(at)", "\n", " ", "\t", "call", "٣", "²"]
    entities = ["jane at example dot com", "bob [at] corp [dot] net", "x (at) y (dot) org", "ann ARROBA correo punto es", "luc chez poste.fr", "k[at]l[dot]com", "٠٣٠ ٤٤٤٤ ٥٥٥٥", "(555) 555-0100", "token = 0123456789abcdef0"]
    found_words = 0
    for n in range(600):
        pool = entities[:6] if n % 2 else entities
        text = rng.choice((" ", "  ")).join(x for _ in range(rng.randint(1, 4)) for x in [*rng.choices(filler, k=rng.randint(0, 30)), rng.choice(pool)])
        tokens = pii.tokens_of(text)
        base = pii.base_spans(text)
        touched = [any(a < e and s < b for k in pii.BASE for s, e in base[k]) for a, b in tokens]
        whole = [(k, tokens[i][0], tokens[j - 1][1]) for i, j, k in field.best(len(tokens), pii.candidates(text, tokens, touched))]
        flat = [(k, a, b) for k in pii.BASE for a, b in base[k]]
        assert pii.all_spans(text, field)[1][len(flat):] == whole, text
        found_words += sum(k == "email" for k, _, _ in whole)
    assert found_words > 600
    texts = ["please write to jane at example dot com today", "bob [at] corp [dot] net", "x (at) y (dot) org", "We met at the station. Dot was there at noon."]
    rows = pii.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert ["[EMAIL]" in r["text"] for r in rows] == [True, True, True, False]


def test_base_spans_stay_and_clean_text_is_left_alone(spark):
    texts = ["mail a.b@c.org, or 10.0.0.1", "Version 2.0 of 2024-05-06, pp. 10-20, 3.14% at 10 am.", "token = \"0123456789abcdef0123456789abcdef\""]
    found = [pii.find(spark.createDataFrame([(0, t)], "doc_id long, text string")).first() for t in texts]
    assert found[0]["spans"] == "email:5:14,ip:19:27"
    assert found[1]["spans"] == "" and found[2]["spans"].startswith("secret:0:")
    kept = pii.redact(spark.createDataFrame([(0, texts[0], 27, "x")], "doc_id long, text string, n_chars long, spans string")).first()
    assert (kept["text"], kept["n_chars"], kept["spans"]) == ("mail [EMAIL], or [IP]", 21, "x")


@pytest.mark.parametrize("run", [
    lambda d: sentence_pieces.digests(d, PIECES), lambda d: token_counts.count_tokens(d, token_counts.pieces_of(PIECES)), pii.find, lambda d: packing.pack(d, BYTES),
])
def test_odd_rows(run, odd, none):
    assert run(none).count() == 0
    rows = run(odd).collect()
    assert sum(r["doc_id"] == 4 for r in rows) == 1
    assert {r["doc_id"] for r in rows} == {1, 2, 3, 4, 5, 6, 7, 8, None}
