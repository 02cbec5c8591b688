"""Personal data: base patterns, and a semi-Markov conditional random field that adds spans.

Base spans are leftmost and non-overlapping for each kind: e-mail addresses, IPv4
addresses, card numbers that pass the Luhn check, phone numbers. They always
stay. The field segments the text around triggers (digits of any script, @, =,
:, and "at" in words where a domain follows) into entities of a bounded number of
tokens and single outside tokens. Features see whole spans: their shape, lengths
and checksums, and the words beside them. Dynamic programming over all
segmentations chooses boundaries and types together; base spans are fixed in it,
and what touches one is no candidate. Text without a trigger has no candidates,
so windows around triggers are solved on their own, with the same result as the
whole text.

The field is trained by its likelihood (AdaGrad) on sentences that `sentences`
makes from a seed: filler, entities of each kind in the forms people write
(addresses with "at" and "dot", grouped numbers, credentials), and things that
look like them (dates, versions, amounts, codes).

Defined results: a null text counts as empty, which has no spans. Spans that the field adds have LONGEST_CHARS characters
at most, and time is linear in a text's length. Offsets are
code points, ends exclusive. Rows are independent, so ids may be null or
repeated; an empty table gives no rows; other columns, whatever their names, are
not read by `find` and all kept by `redact`.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import sys
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import only, text_or_empty

#: The kinds, in the order of results; the last is found by the field alone.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
#: Tokens and characters of an entity at most; tokens on each side of a trigger that belong to its window.
LONGEST, LONGEST_CHARS, REACH = 14, 2_000, 15

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
#: A match that starts within a run of digits could start with the run, so only starts of runs are tried.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(text: str) -> list[Span]:
    """Linear in the text: each @ is looked at once, with the run of characters before it."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            found.append((start, domain.end()))
            free = domain.end()
            at = text.find("@", free)
        else:
            free = at + 1  # what stands before this @ can't be a later one's local part
            at = text.find("@", free)
    return found


def base_spans(text: str) -> dict[str, list[Span]]:
    """The base spans of each kind."""
    out: dict[str, list[Span]] = {"email": emails(text) if "@" in text else [], "ip": [], "card": [], "phone": []}
    out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
_AT_WORDS = {"at", "arroba", "chez"}
_DOT_WORDS = {"dot", "punkt", "point", "punto"}
_KEY_WORDS = {"password", "passwd", "pwd", "token", "secret", "api", "key", "apikey", "passwort", "contrase", "auth", "credential"}
_CUES = {
    "phone": {"call", "phone", "tel", "telephone", "mobile", "fax", "dial", "anruf", "telefon", "whatsapp"},
    "email": {"mail", "email", "e", "contact", "write", "correo", "courriel", "address"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "tarjeta", "carte", "karte"},
    "ip": {"ip", "host", "server", "ipv4", "addr", "gateway", "client"},
}


#: An address as people write it, with "at" and "dot" in words or brackets: what follows "at" in words, and the whole.
_DOMAIN_WORDS = r"\w[\w-]*(?:(?:\.| ?[\[({<] ?(?:dot|punkt|punto) ?[\])}>] ?| (?:dot|punkt|punto|point) )\w[\w-]*)+"
_ADDRESS = re.compile(rf"[\w.%+-]+(?: ?@ ?| ?[\[({{<] ?(?:at|arroba) ?[\])}}>] ?| (?:at|arroba|chez) ){_DOMAIN_WORDS}", re.I)
#: Every candidate has in it a digit (as str.isdigit, in any script), @, or an "at" word before a domain.
_TRIGGER = re.compile(r"[0-9@=:]")
_AT_TRIGGER = re.compile(rf"[aAcC](?<![^\W_].)(?i:(?:(?<=a)t|(?<=a)rroba|(?<=c)hez)(?: ?[\])}}>] ?| )(?={_DOMAIN_WORDS}))")
_OTHER_DIGITS = frozenset(c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isdigit())


def triggers(text: str) -> list[int]:
    """Where triggers start, in order."""
    found = [m.start() for p in (_TRIGGER, _AT_TRIGGER) for m in p.finditer(text)]
    if not text.isascii() and not _OTHER_DIGITS.isdisjoint(text):
        found += [i for i, c in enumerate(text) if c in _OTHER_DIGITS]
    return sorted(found)


def shape_features(kind: str, text: str, tokens: list[str], before: list[str], after: str, glued: tuple[bool, bool]) -> list[str]:
    """Names of the features of a span of `kind`: its text, its tokens, the words before it, the token after it,
    and whether it is glued to the text on either side."""
    digits = sum(c.isdigit() for c in text)
    letters = sum(c.isalpha() for c in text)
    low = [t.lower() for t in tokens]
    f = [f"n{min(len(tokens), 9)}", f"d{min(digits, 20)}", f"share{round(4 * digits / max(1, len(text)))}"]
    f.append(f"edges{tokens[0][0].isdigit()}{tokens[-1][-1].isdigit()}{tokens[0].isalnum()}{tokens[-1].isalnum()}")
    f.append(f"glued{glued[0]:d}{glued[1]:d}")
    if kind == "email":
        at = ("@" in text) + 2 * any(t in _AT_WORDS for t in low)
        dots = 2 * any(t in _DOT_WORDS for t in low) + ("." in text)
        whole = bool(_ADDRESS.fullmatch(text))
        f += [f"at{at}", f"dots{dots}", f"address{whole:d}"]
    elif kind == "ip":
        parts = text.split(".")
        f.append(f"quad{len(parts) == 4 and all(p.isdigit() and int(p[:6]) <= 255 for p in parts):d}")
        f.append(f"masked{len(text.replace('[.]', '.').split('.')) == 4 and '[.]' in text and digits >= 4:d}")
    elif kind == "card":
        plain = re.sub(r"\D", "", text)
        right = bool(re.fullmatch(r"\d(?:[ ._-]?\d)+", text)) and 13 <= digits <= 19
        f += [f"run{right:d}", f"luhn{right and luhn(plain):d}", f"first{plain[:1]}"]
    elif kind == "phone":
        right = bool(re.fullmatch(r"(?:\+|00)?[\d(][\d ().\-/]*\d", text))
        groups = [len(g) for g in re.findall(r"\d+", text)]
        f += [f"form{right:d}", f"groups{min(len(groups), 5)}", f"last{groups[-1] if groups else 0}", f"paren{'(' in text:d}"]
        f.append(f"local{bool(re.fullmatch(r'[(]?[0-9]{3}[)]?[ .-][0-9]{3}[ .-][0-9]{4}', text)):d}")
    else:
        value = re.split(r"[=:\s\"']+", text.strip("\"'"))[-1]
        alike = max((max(value.count(c) for c in set(value)) / len(value)) if value else 1.0, 0.0)
        mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
        f += [f"long{min(len(value) // 8, 6)}", f"mixed{mixed:d}", f"alike{alike > 0.3:d}", f"named{any(t in _KEY_WORDS for t in low):d}"]
        f.append(f"assign{bool(re.fullmatch(r'''\w+ ?[=:] ?["']?[^"'\s]+["']?''', text)):d}")
        f.append(f"upper{bool(re.fullmatch(r'[A-Z]{4}[A-Z0-9]{16}', text)):d}")
        f.append(f"hex{bool(re.fullmatch(r'[0-9a-f]{16,}', value)):d}")
    cues = _CUES.get(kind, _KEY_WORDS)
    f.append(f"cue{any(t in cues for t in before):d}")
    f.append(f"next{'%' if after in ('%', '€', '$') else 'w' if after.isalnum() else 'p'}")
    out = [f"{kind}|{x}" for x in f]
    out += [f"{kind}|{x}&{y}" for x in f[5:9] for y in (f[0], f[1], f[-2])]
    return [*out, kind]


def tokens_of(text: str, start: int = 0, end: int | None = None) -> list[Span]:
    return [m.span() for m in _TOKEN.finditer(text, start, len(text) if end is None else end)]


def candidates(text: str, tokens: list[Span], fixed: list[bool]) -> list[tuple[int, int, str, list[str]]]:
    """Candidate segments first, end (exclusive), kind, features. Fixed tokens belong to base spans."""
    words = [text[a:b] for a, b in tokens]
    out = []
    for i in range(len(tokens)):
        if fixed[i] or not (words[i].isalnum() or words[i] in "+(\"'"):
            continue
        digits = trigger = at = False
        for j in range(i, min(len(tokens), i + LONGEST)):
            if fixed[j] or (j > i and "\n" in text[tokens[j - 1][1] : tokens[j][0]]) or (j > i and tokens[j][0] - tokens[j - 1][1] > 1) or tokens[j][1] - tokens[i][0] > LONGEST_CHARS:
                break
            word = words[j].lower()
            digits = digits or any(c.isdigit() for c in word)
            at = at or word == "@" or word in _AT_WORDS
            trigger = trigger or digits or at
            if not trigger or not (words[j].isalnum() or words[j] in "\"')"):
                continue
            a, b = tokens[i][0], tokens[j][1]
            span = text[a:b]
            letters = any(c.isalpha() for c in span)
            kinds = []
            if at and j - i >= 3 and _ADDRESS.fullmatch(span):
                kinds.append("email")
            if digits and not letters and j > i:
                kinds += ["ip", "phone", "card"] if words[i][0] not in "\"'" else []
            elif digits and not letters and words[i].isdigit() and len(span) >= 9:
                kinds += ["card", "phone"]
            if digits and b - a >= 8 and (j == i or any(c in span for c in "=:")):
                kinds.append("secret")
            if not kinds:
                continue
            before = [w.lower() for w in words[max(0, i - 4) : i]]
            after = words[j + 1] if j + 1 < len(words) else ""
            glued = (a > 0 and not text[a - 1].isspace(), b < len(text) and not (text[b].isspace() or text[b] in ".,;:!?)\""))
            for kind in kinds:
                out.append((i, j + 1, kind, shape_features(kind, span, words[i : j + 1], before, after, glued)))
    return out


class Field:
    """Weights by feature name. A single outside token scores 0, so weights compare entities with outside."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = weights or {}

    def scores(self, segments: list[tuple[int, int, str, list[str]]]) -> list[float]:
        w = self.weights
        return [sum(w.get(x, 0.0) for x in s[3]) for s in segments]

    def best(self, n: int, segments: list[tuple[int, int, str, list[str]]]) -> list[tuple[int, int, str]]:
        """The segments of the best segmentation of n tokens; ties go to outside, then to the candidate listed first."""
        ending: list[list[int]] = [[] for _ in range(n + 1)]
        for k, s in enumerate(segments):
            ending[s[1]].append(k)
        score, back = [0.0] * (n + 1), [-1] * (n + 1)
        weight = self.scores(segments)
        for j in range(1, n + 1):
            score[j] = score[j - 1]
            for k in ending[j]:
                if score[segments[k][0]] + weight[k] > score[j]:
                    score[j], back[j] = score[segments[k][0]] + weight[k], k
        out, j = [], n
        while j:
            if back[j] < 0:
                j -= 1
            else:
                out.append(segments[back[j]][:3])
                j = segments[back[j]][0]
        return out[::-1]

    def marginals(self, n: int, segments: list[tuple[int, int, str, list[str]]]) -> list[float]:
        """Each candidate's probability, by the forward and backward sums over all segmentations."""
        weight = self.scores(segments)
        ending: list[list[int]] = [[] for _ in range(n + 1)]
        starting: list[list[int]] = [[] for _ in range(n + 1)]
        for k, s in enumerate(segments):
            ending[s[1]].append(k)
            starting[s[0]].append(k)
        forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            forward[j] = _logsum([forward[j - 1], *(forward[segments[k][0]] + weight[k] for k in ending[j])])
        for i in reversed(range(n)):
            backward[i] = _logsum([backward[i + 1], *(backward[segments[k][1]] + weight[k] for k in starting[i])])
        return [math.exp(min(0.0, forward[s[0]] + weight[k] + backward[s[1]] - forward[n])) for k, s in enumerate(segments)]


def _logsum(x: list[float]) -> float:
    top = max(x)
    return top + math.log(sum(math.exp(v - top) for v in x))


def _windows(text: str, base: dict[str, list[Span]]) -> Iterator[tuple[list[Span], list[bool]]]:
    """Tokens around triggers, and whether a base span touches each."""
    found = triggers(text)
    if not found:
        return
    spans = sorted(s for k in BASE for s in base[k])
    ends = list(accumulate((e for _, e in spans), max))
    every = tokens_of(text)
    starts = [a for a, _ in every]
    windows: list[list[int]] = []  # of numbers of tokens
    for at in found:
        n = bisect_right(starts, at) - 1
        # far enough back and on to hold every entity that contains the trigger, and the words it looks at
        a, b = max(0, n - REACH - 4), n + REACH + 1
        if windows and a <= windows[-1][1]:
            windows[-1][1] = b
        else:
            windows.append([a, b])
    for a, b in windows:
        tokens = every[a:b]
        first, fixed = bisect_right(ends, tokens[0][0]), []
        for start, end in tokens:
            while first < len(spans) and ends[first] <= start:
                first += 1
            at, touched = first, False
            while at < len(spans) and spans[at][0] < end and not touched:
                touched = start < spans[at][1]
                at += 1
            fixed.append(touched)
        if not all(fixed):
            yield tokens, fixed


def added_spans(text: str, base: dict[str, list[Span]], field: Field) -> list[tuple[str, int, int]]:
    """kind, start, end of what the field finds besides the base spans."""
    out = []
    for tokens, fixed in _windows(text, base):
        segments = candidates(text, tokens, fixed)
        if segments:
            out += [(kind, tokens[i][0], tokens[j - 1][1]) for i, j, kind in field.best(len(tokens), segments)]
    return list(dict.fromkeys(out))


def _syllables(rng: random.Random, n: int) -> str:
    return "".join(rng.choice(("th", "er", "an", "on", "sch", "le", "que", "ar", "in", "os", "ung", "re", "é", "al", "ti")) for _ in range(n))


def _entity(rng: random.Random) -> tuple[str, str]:
    """kind and text of an entity; some are forms that the base patterns have too."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8)))
    kind = rng.choice((*KINDS, "secret"))
    if kind == "email":
        at, dot = rng.choice((("@", "."), (" at ", " dot "), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" @ ", "."), (" at ", ".")))
        return kind, f"{word()}{rng.choice(('', '.' + word(), d(2)))}{at}{word()}{rng.choice(('', d(1)))}{dot}{rng.choice(('com', 'org', 'net', 'example' + dot + 'com'))}"
    if kind == "ip":
        return kind, rng.choice((".", ".", "[.]")).join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "card":
        digits = rng.choice("3456") + d(14)
        digits += next(c for c in "0123456789" if luhn(digits + c))
        cut = rng.choice(("", " ", "-", "."))
        return kind, cut.join(digits[i : i + 4] for i in range(0, 16, 4))
    if kind == "phone":
        return kind, rng.choice((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{rng.randint(1, 9)} ({d(3)}) {d(3)}-{d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"+{rng.randint(10, 99)} {d(3)} {d(3)} {d(3)}", f"{d(3)}.{d(3)}.{d(4)}"))
    hexes = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((18, 24, 32, 40))))
    key = rng.choice(("password", "passwd", "token", "secret", "api_key", "pwd", "auth"))
    caps = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
    quote = rng.choice(("", '"'))
    value = hexes[: rng.randint(10, 40)] + rng.choice("0123456789") + rng.choice("abc")
    return kind, rng.choice((f"AKIA{caps}", f"{key}={value}", f"{key} = {quote}{value}{quote}", f"{key}: {quote}{value}{quote}"))


def _decoy(rng: random.Random) -> str:
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    year = rng.randint(1800, 2099)
    return rng.choice(
        (
            f"{year}", f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{year}", f"{year}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", f"version {rng.randint(1, 9)}.{rng.randint(0, 20)}",
            f"Version {rng.randint(1, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 40)}.", f"{rng.randint(1, 999)},{d(3)}.{d(2)}", f"{rng.randint(1, 99)}%", f"{d(2)}:{d(2)}:{d(2)}", f"pp. {d(3)}-{d(3)}",
            f"{d(1)}.{d(2)}", f"ratio {d(1)}:{d(1)}", f"x = {d(2)}", f"section {d(1)}.{d(1)}.{d(1)}", f"ISBN {d(3)}-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"no. {d(rng.randint(1, 8))}", f"chapter {d(2)}: {_syllables(rng, 3)}",
            f"{d(3)} {d(3)}", f"at {rng.randint(1, 12)} {rng.choice(('am', 'pm'))}", f"{_syllables(rng, 2)}{d(rng.randint(1, 4))}", f"CC BY-NC {d(1)}.0.", f"a{d(1)}b{d(1)}", f"{d(5)} {d(5)}", f"{_syllables(rng, 2)} at {_syllables(rng, 3)} {d(2)}.",
        )
    )


def sentences(n: int, seed: int) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """Texts with the spans of their entities."""
    rng = random.Random(seed)
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randint(1, 3)):
            text += " ".join(_syllables(rng, rng.randint(1, 4)) + rng.choice(("", "", "", ",", ".")) for _ in range(rng.randint(1, 6))) + " "
            if rng.random() < 0.55:
                kind, entity = _entity(rng)
                if rng.random() < 0.3:
                    text += rng.choice(sorted(_CUES.get(kind, {"key"}))) + rng.choice((": ", " "))
                spans.append((kind, len(text), len(text) + len(entity)))
                text += entity + rng.choice((" ", " ", ". ", ", "))
            else:
                text += _decoy(rng) + " "
        yield text, spans


@lru_cache(1)
def trained(n: int = 600, rounds: int = 6, seed: int = 7, rate: float = 0.4, ridge: float = 1e-4) -> Field:
    """The field with weights of the highest likelihood of the made sentences (AdaGrad, one text at a time)."""
    field = Field({})
    work = []
    for text, spans in sentences(n, seed):
        tokens = tokens_of(text)
        segments = candidates(text, tokens, [False] * len(tokens))
        right = set(spans)
        gold = [(s[2], tokens[s[0]][0], tokens[s[1] - 1][1]) in right for s in segments]
        work.append((len(tokens), segments, gold))
    w, square = field.weights, {}
    order = random.Random(seed)
    for _ in range(rounds):
        order.shuffle(work)
        for size, segments, gold in work:
            gradient: dict[str, float] = {}
            for (_, _, _, names), p, y in zip(segments, field.marginals(size, segments), gold, strict=True):
                if abs(y - p) > 1e-4:
                    for x in names:
                        gradient[x] = gradient.get(x, 0.0) + y - p
            for x, g in gradient.items():
                g -= ridge * w.get(x, 0.0)
                square[x] = square.get(x, 1e-6) + g * g
                w[x] = w.get(x, 0.0) + rate * g / math.sqrt(square[x])
    return field


def _written(spans: list[tuple[str, int, int]]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1], s[2])))


def all_spans(text: str, field: Field) -> tuple[dict[str, list[Span]], list[tuple[str, int, int]]]:
    """The base spans, and those and the added ones together."""
    base = base_spans(text)
    flat = [(k, a, b) for k in BASE for a, b in base[k]]
    return base, flat + added_spans(text, base, field)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added for each row of docs."""
    weights = trained().weights  # a few hundred numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        field = Field(weights)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, spans = all_spans(text.as_py(), field)
                flat = [(k, a, b) for k in BASE for a, b in base[k]]
                rows.append((*(len(base[k]) for k in BASE), hashlib.sha256(_written(flat).encode()).hexdigest(), _written(spans), len(spans) - len(flat)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_added"]
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, schema)


def redacted(text: str, field: Field) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become the first one's."""
    out, at = [], 0
    for start, end, kind in sorted((a, b, k) for k, a, b in all_spans(text, field)[1]):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with spans replaced in their texts, and `length_col`, where there is one, set to the new length."""
    weights, schema = trained().weights, docs.schema
    at = schema.names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        field = Field(weights)
        for batch in batches:
            texts = [None if (t := x.as_py()) is None else redacted(t, field) for x in batch.column(at)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = docs.mapInArrow(run, schema)
    if length_col not in schema.names:
        return out
    return out.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.length(text_col)).cast(schema[length_col].dataType))
