"""Near-duplicate texts by ProbMinHash of weighted word shingles.

A text's shingles are its runs of five words, lower-cased, weighted by how often
they occur. Each shingle has a Poisson process of arrivals at a rate of its
weight; each arrival falls on one of REGISTERS registers, which keeps the
shingle that came first. No process is followed beyond the time at which all
registers have been reached, so short work is done for rare arrivals. Registers
of two texts agree with a chance of their probability Jaccard similarity.

Equal texts (after lower-casing and splitting) are one class, stood for by the
smallest doc_id. Classes that share a band of registers form a bucket. In each
bucket every class is compared with one centre, exactly, on whole shingles.
Where a bucket still holds several components, pairs of different components are
compared too. Members of buckets of more than a block are dealt anew first, by
the shingles of their prefixes: the rarest ones that hold over a fifth of a
text's weight, of which linked texts have one in common. So a passage that very
many texts share brings none of them together. In a bucket, a bound of the
similarity of all pairs comes from two products of matrices, and pairs that reach
it are compared exactly. What is still large is cut into blocks, where members of
the largest component have blocks of their own that are not compared with each
other; a task holds two blocks at most and passes on a spanning forest of their
links, so pairs never become rows. Large stars are salted, each part with the
centre's text.

Defined results: texts of one to four words have one shingle, all of them; those
without words, null ones among them, link with nothing. Rows without an id link
with nothing, have a null component and are kept. Rows that share a doc_id are
versions of one document, whose component has the links of all of them. An
empty table gives no rows. Other columns, whatever their names, are not read by
`near_groups` and all kept by `drop_near_copies`.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import checkpointed, only, parts, sized
from quillon.llm.components import Forest, components
from quillon.llm.words import WORDS, mixed, runs

SIMILARITY, SHINGLE = 0.8, 5
#: Bands of ROWS registers: a pair at the threshold shares none with a chance of 5e-8.
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
#: Members of a star's part, and of a block of a bucket; shingles of a block on average.
STAR, BLOCK, BLOCK_SHINGLES = 2_000, 512, 4_000_000
#: Shingles of large buckets that are told apart by how often they occur, at most; shingles that are compared at a time.
FREQUENT, COLUMNS = 500_000, 4_096
_GOLDEN = 0x9E3779B97F4A7C15


def shingles(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a lower-cased text's shingles, in order, and how often each occurs."""
    words = WORDS.of(text.split())
    if not len(words):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.unique(runs(words, min(SHINGLE, len(words))), return_counts=True)


def probability_jaccard(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over common elements d of 1 / sum over all e of max(x[e] / x[d], y[e] / y[d])."""
    common, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    a, b = x[1][i].astype(float), y[1][j].astype(float)
    alone_a, alone_b = x[1].sum() - a.sum(), y[1].sum() - b.sum()
    order = np.argsort(a / b, kind="stable")
    a, b = a[order], b[order]
    at_least = np.cumsum(a[::-1])[::-1]  # of elements whose ratio isn't smaller
    under = np.cumsum(b) - b
    return float((1 / ((alone_a + at_least) / a + (alone_b + under) / b)).sum())


def prob_minhash(elements: np.ndarray, weights: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """The element that reaches each register first."""
    total = float(weights.sum())
    rate = weights.astype(float)
    until = registers * (math.log(registers) + 4.6) / total
    while True:
        times, places, owners = [], [], []
        live, reached, k = np.arange(len(elements)), np.zeros(len(elements)), 0
        while len(live):
            ahead = max(1, min(64, 2048 // len(live)))
            step = np.arange(k, k + ahead, dtype=np.uint64) * np.uint64(_GOLDEN)
            drawn = mixed(elements[live][:, None] + step[None, :])
            gap = -np.log1p(-(drawn >> np.uint64(11)).astype(float) * 2.0**-53) / rate[live][:, None]
            time = reached[:, None] + np.cumsum(gap, axis=1)
            inside = time <= until
            row, column = np.nonzero(inside)
            times.append(time[row, column])
            places.append((mixed(drawn[row, column]) % np.uint64(registers)).astype(np.int64))
            owners.append(live[row])
            more = inside[:, -1]
            live, reached = live[more], time[more, -1]
            k += ahead
        time, place, owner = np.concatenate(times), np.concatenate(places), np.concatenate(owners)
        late_first = np.argsort(-time, kind="stable")
        first = np.full(registers, -1, dtype=np.int64)
        first[place[late_first]] = owner[late_first]  # the earliest is written last
        if first.min() >= 0:
            return elements[first]
        until *= 2


def band_names(signature: np.ndarray) -> np.ndarray:
    """A 64-bit name for each band of a signature."""
    name = np.arange(BANDS, dtype=np.uint64) * np.uint64(_GOLDEN)
    for column in signature.reshape(BANDS, ROWS).T:
        name = mixed(name + column)
    return name


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("binary").alias("text"))


def _signed(rows: DataFrame) -> DataFrame:
    """id, words (a digest; null without words), size (shingles), bands (names) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(WORDS)
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                digests, sizes, names = [], [], []
                for text in part.column(1):
                    data = text.as_py()
                    elements, weights = shingles(data)
                    sizes.append(len(elements))
                    if len(elements):
                        digests.append(hashlib.blake2b(b" ".join(data.split()), digest_size=16).digest())
                        names.append(band_names(prob_minhash(elements, weights)).view(np.int64))
                    else:
                        digests.append(None)
                        names.append(np.zeros(0, dtype=np.int64))
                offsets = pa.array(np.cumsum([0, *map(len, names)]), pa.int32())
                yield pa.record_batch([part.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(names), pa.int64()))], ["id", "words", "size", "bands"])

    return rows.mapInArrow(run, "id long, words binary, size int, bands array<long>")


@lru_cache(64)
def _profile(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    return shingles(text)


def _stars(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, centre, similarity of pairs (id, centre)."""
    sizes = pairs.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("salts"))
    members = pairs.join(sizes, "centre").select("id", "centre", F.pmod(F.xxhash64("id"), "salts").cast("int").alias("salt"), F.lit(1).alias("role"))
    centres = sizes.select(F.col("centre").alias("id"), "centre", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"))
    asked = checkpointed(members.unionByName(centres))
    texts = rows.join(sized(asked), "id").select("centre", "salt", "role", "id", "text")
    keys = ["centre", "salt"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, centre = None, []
        for batch in batches:
            out: dict[tuple[int, int], float] = {}
            keyed = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
            for (c, salt, role, i), text in zip(keyed, batch.column(4), strict=True):
                if (c, salt) != now:
                    now, centre = (c, salt), []
                profile = _profile(text.as_py())
                if role == 0:
                    centre.append(profile)
                else:
                    out[i, c] = max(out.get((i, c), 0.0), *(probability_jaccard(profile, x) for x in centre), 0.0)
            yield pa.record_batch([pa.array([k[0] for k in out], pa.int64()), pa.array([k[1] for k in out], pa.int64()), pa.array(list(out.values()), pa.float64())], ["id", "centre", "similarity"])

    dealt = texts.repartition(parts(texts), *keys).sortWithinPartitions(*keys, "role", "id")
    found = dealt.mapInArrow(run, "id long, centre long, similarity double")
    return found.groupBy("id", "centre").agg(F.max("similarity").alias("similarity"))


def _shingled(rows: DataFrame) -> DataFrame:
    """id, shingles, weights (64-bit numbers as bytes; no weights where all are 1) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                found = [shingles(t.as_py()) for t in part.column(1)]
                weights = [w.tobytes() if (w > 1).any() else b"" for _, w in found]
                yield pa.record_batch([part.column(0), pa.array([e.tobytes() for e, _ in found], pa.binary()), pa.array(weights, pa.binary())], ["id", "shingles", "weights"])

    return rows.select("id", "text").mapInArrow(run, "id long, shingles binary, weights binary")


def _unpacked(elements: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    found = np.frombuffer(elements, dtype=np.uint64)
    return found, np.frombuffer(weights, dtype=np.int64) if weights else np.ones(len(found), dtype=np.int64)


def prefix(profile: tuple[np.ndarray, np.ndarray], common: np.ndarray, often: np.ndarray, least: float) -> np.ndarray:
    """The first shingles of a text, rare ones first, that hold more than 1 - least of its weight.

    Order is by how often a shingle occurs (`often`, of the sorted shingles `common`; 0 for all others), then by hash.
    It is one order for all texts, so two texts whose prefixes share nothing have less than `least` of one's weight in
    common, and a similarity under `least`.
    """
    elements, weights = profile
    at = np.minimum(np.searchsorted(common, elements), max(len(common) - 1, 0))
    count = np.where(common[at] == elements, often[at], 0) if len(common) else np.zeros(len(elements), dtype=np.int64)
    order = np.lexsort((elements, count))
    reached = np.cumsum(weights[order])
    return elements[order[: int(np.searchsorted(reached, (1 - least) * reached[-1] + 1e-9, side="right")) + 1]]


def _refined(open_: DataFrame, profiles: DataFrame, least: float) -> DataFrame:
    """bucket, id, component, size of members of large buckets (id, component, size), dealt anew: a bucket for each shingle of their prefixes.

    All links between them are kept, since linked texts share a prefix shingle. The shingles that are told apart by how
    often they occur are those that make up more than 1 / FREQUENT of all, so there are at most FREQUENT.
    """
    profiles = profiles.join(sized(open_.select("id")), "id", "left_semi")
    total = open_.agg(F.sum("size")).first()[0] or 0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                found, n = np.unique(np.frombuffer(b"".join(batch.column(0).slice(a, 1000).to_pylist()), dtype=np.uint64), return_counts=True)
                yield pa.record_batch([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["shingle", "n"])

    counted = profiles.select("shingles").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    frequent = counted.where(F.col("n") > max(1, total // FREQUENT)).toArrow()
    common = frequent.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(common)
    shared = open_.sparkSession.sparkContext.broadcast((common[order], frequent.column("n").to_numpy()[order]))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, often = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                found = [prefix(_unpacked(e.as_py(), w.as_py()), common, often, least) for e, w in zip(part.column(1), part.column(2), strict=True)]
                ids = np.repeat(part.column(0).to_numpy(), [len(f) for f in found])
                yield pa.record_batch([pa.array(np.concatenate(found).view(np.int64)), pa.array(ids)], ["bucket", "id"])

    dealt = checkpointed(profiles.select("id", "shingles", "weights").mapInArrow(deal, "bucket long, id long"))
    met = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    return dealt.join(met, "bucket").join(sized(open_), "id").select("bucket", "id", "component", "size")


def bounds(texts: list[tuple[np.ndarray, np.ndarray]], split: int = 0) -> np.ndarray:
    """The similarity at most (but for rounding) of all texts with all, or of the first `split` texts with the others.

    With u and v, the parts of each text's weight that lie on shingles of both, it is 1 / (1 / u + 1 / v - 1): each
    common shingle adds at most p q / (q + (1 - v) p), for its shares p and q, and that is concave and homogeneous.
    """
    sizes = [len(e) for e, _ in texts]
    left, right = (slice(split), slice(split, None)) if split else (slice(None), slice(None))
    shares = np.concatenate([w / w.sum() for _, w in texts]).astype(np.float32)
    _, column, n = np.unique(np.concatenate([e for e, _ in texts]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    kept = n[column] > 1
    row, column, shares = row[kept], (np.cumsum(n > 1) - 1)[column[kept]], shares[kept]
    by_column = np.argsort(column, kind="stable")
    row, column, shares = row[by_column], column[by_column], shares[by_column]
    u = np.zeros((len(sizes[left]), len(sizes[right])), dtype=np.float32)
    v = np.zeros_like(u)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (first, first + COLUMNS))
        part = np.zeros((len(sizes), min(COLUMNS, int(column[-1]) + 1 - first)), dtype=np.float32)
        part[row[a:b], column[a:b] - first] = shares[a:b]
        has = (part > 0).astype(np.float32)
        u += part[left] @ has[right].T
        v += has[left] @ part[right].T
    with np.errstate(divide="ignore"):
        return 1 / (1 / u + 1 / v - 1)


def _group_links(group: list[tuple], least: float) -> list[tuple[int, int]]:
    """A spanning forest of the links between components of a group's members: block, id, component, shingles, weights; in two blocks only those between them."""
    group = sorted(group, key=lambda row: row[:2])
    split = sum(row[0] == group[0][0] for row in group) % len(group)
    component = np.array([row[2] for row in group], dtype=np.int64)
    wanted = component[:split, None] != component[None, split:] if split else component[:, None] != component[None, :]
    if not wanted.any():
        return []
    profile = [_unpacked(row[3], row[4]) for row in group]
    near = wanted & (bounds(profile, split) >= least - 1e-4)
    forest, out = Forest(len(group)), []
    of_component: dict[int, int] = {}
    for at, row in enumerate(group):
        forest.join(of_component.setdefault(row[2], at), at)
    for i, j in np.argwhere(near).tolist():
        j += split
        if i < j and forest.root(i) != forest.root(j) and probability_jaccard(profile[i], profile[j]) >= least:
            forest.join(i, j)
            out.append((group[i][1], group[j][1]))
    return out


def _within(profiles: DataFrame, members: DataFrame, least: float, block: int) -> DataFrame:
    """Links a, b between members (bucket, id, component, size) of different components.

    Members of a bucket's largest component are in other blocks than the rest, and two such blocks are never compared.
    """
    by_component = members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    sizes = by_component.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max_by("s", F.struct("n", "component")).alias("main_s"), F.max("n").alias("main_n"), F.sum("n").alias("n"), F.sum("s").alias("s"))
    blocks = lambda n, s: F.ceil(F.greatest(n / block, s / BLOCK_SHINGLES)).cast("int")
    one = blocks(F.col("n"), F.col("s")) <= 1
    sizes = sizes.where("main_n < n").select(
        "bucket", F.when(~one, F.col("main")).alias("main"),
        F.when(one, 1).otherwise(blocks(F.col("n") - F.col("main_n"), F.col("s") - F.col("main_s"))).alias("rest"),
        F.when(one, 0).otherwise(blocks(F.col("main_n"), F.col("main_s"))).alias("mains"),
    )
    dealt = members.join(sized(checkpointed(sizes)), "bucket")
    is_main = F.coalesce(F.col("component") == F.col("main"), F.lit(False))
    dealt = dealt.withColumn("i", F.when(is_main, F.col("rest") + F.pmod(F.xxhash64("id"), F.greatest("mains", F.lit(1)))).otherwise(F.pmod(F.xxhash64("id"), "rest")).cast("int"))
    dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.when(is_main, F.col("rest") - 1).otherwise(F.col("rest") + F.col("mains") - 1))))
    dealt = checkpointed(dealt.select("bucket", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "id", "component"))
    keys = ["bucket", "lo", "hi"]
    found = profiles.join(sized(dealt), "id").select(*keys, "i", "id", "component", "shingles", "weights")
    found = found.repartition(parts(found), *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, links = None, [], []
        for batch in chain(batches, [None]):
            for row in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True) if batch else [(None,) * 8]:
                if row[:3] != now:
                    if group:
                        links += _group_links(group, least)
                    now, group = row[:3], []
                group.append(row[3:])
            if links:
                yield pa.record_batch([pa.array([f[0] for f in links], pa.int64()), pa.array([f[1] for f in links], pa.int64())], ["a", "b"])
                links = []

    return found.mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, class_id (smallest doc_id of equal texts), component_id (smallest doc_id reachable by links), kept for each row of docs."""
    rows = _rows(docs, id_col, text_col)
    seen = checkpointed(_signed(rows))
    classes = checkpointed(seen.where("id is not null and words is not null").groupBy("words").agg(F.min("id").alias("class_id"), F.first("size").alias("size"), F.first("bands").alias("bands")))
    banded = classes.select(F.col("class_id").alias("id"), "size", F.explode("bands").alias("bucket"))
    centres = banded.groupBy("bucket").agg(F.min("id").alias("centre"), F.max("id").alias("most"), F.count(F.lit(1)).alias("n")).where("centre < most")
    members = checkpointed(banded.join(centres.select("bucket", "centre", "n"), "bucket").where("id <> centre"))
    compared = checkpointed(_stars(rows, members.select("id", "centre").distinct()))
    linked = compared.where(F.col("similarity") >= least).select(F.col("id").alias("a"), F.col("centre").alias("b"))
    of_id = components(linked)
    open_ = members.where("n > 2").join(of_id, "id", "left")
    open_ = open_.select("bucket", "id", F.coalesce("component", "id").alias("component"), "size")
    several = open_.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("n")).where("x < y")
    open_ = checkpointed(open_.join(several.select("bucket", (F.col("n") > block).alias("large")), "bucket"))
    asked = checkpointed(open_.select("id").distinct())
    profiles = checkpointed(_shingled(rows.join(sized(asked), "id", "left_semi")))
    large = checkpointed(open_.where("large").groupBy("id").agg(F.min("component").alias("component"), F.max("size").alias("size")))
    open_ = open_.where("not large").select("bucket", "id", "component", "size")
    more = checkpointed(_within(profiles, checkpointed(open_.unionByName(_refined(large, profiles, least))), least, block))
    # rows of one doc_id are one document, so their classes are linked
    versions = seen.join(classes.select("words", "class_id"), "words").where("id <> class_id").select(F.col("id").alias("a"), F.col("class_id").alias("b"))
    of_id = components(linked.unionByName(more).unionByName(versions))
    found = seen.select("id", "words").join(classes.select("words", "class_id"), "words", "left").join(of_id, "id", "left")
    found = found.select(F.col("id").alias("doc_id"), F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id")).alias("class_id"), F.coalesce("component", "id").alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that are not the smallest doc_id of their component; all columns stay."""
    gone = checkpointed(near_groups(docs, least, id_col, text_col).where("not kept").select(F.col("doc_id").alias("dropped_id")).distinct())
    gone = sized(gone)
    return docs.join(gone, docs[id_col] == gone["dropped_id"], "left_anti")
