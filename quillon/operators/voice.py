"""The voice model: axes fitted on exemplars, distances to them, directions, flow, diagnosis.

Vectors are rows (id, profile, v array<double>); exemplar corpora are small, so
the fitted side of a comparison is broadcast once its size has been checked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import patterns as P
from quillon.functions import vectors as V
from quillon.operators import pairs

#: Exemplars that a profile may have for its vectors to be broadcast; beyond that Spark shuffles.
EXEMPLARS = 50_000


def small(df: DataFrame, most: int = EXEMPLARS) -> DataFrame:
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _packed_small(rows: DataFrame, vector: str, columns: list[str], keys: list[str] = (), **how) -> DataFrame:
    """Blocks of rows, marked for broadcast if there are few vectors."""
    blocks = pairs.packed(rows, vector, columns, keys, **how)
    return F.broadcast(blocks) if rows.limit(EXEMPLARS + 1).count() <= EXEMPLARS else blocks


def by_axis(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, mean and std (arrays by axis; population deviation, 0 counts as 1) of rows' v."""
    axes = rows.select(*keys, F.posexplode("v").alias("axis", "x")).groupBy(*keys, "axis").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    std = F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std"))
    both = axes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("axis", "mean", std.alias("std")))).alias("a"))
    return both.select(*keys, F.transform("a", lambda x: x["mean"]).alias("mean"), F.transform("a", lambda x: x["std"]).alias("std"))


def mean_vector(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, v: the mean of the unit vectors of each group."""
    units = rows.select(*keys, F.posexplode(V.unit(F.col("v"))).alias("axis", "x"))
    means = units.groupBy(*keys, "axis").agg(F.avg("x").alias("x"))
    ordered = F.sort_array(F.collect_list(F.struct("axis", "x")))
    return means.groupBy(*keys).agg(F.transform(ordered, lambda s: s["x"]).alias("v"))


def standardized(rows: DataFrame, axes: DataFrame) -> DataFrame:
    """rows with z: v in units of axes (one row)."""
    return rows.crossJoin(F.broadcast(axes)).withColumn("z", V.standardized(F.col("v"), F.col("mean"), F.col("std"))).drop("mean", "std")


def _leaved_small(train: DataFrame) -> DataFrame:
    """Blocks with leaves of train's distinct vectors z, marked for broadcast if they have no more numbers than EXEMPLARS vectors of 64."""
    train = train.select("z").distinct()
    n, size = train.agg(F.count(F.lit(1)), F.max(F.size("z"))).first()
    blocks = pairs.leaved(pairs.packed(train, "z", [], parts=max(1, -(-n // pairs.TREE)), most=pairs.TREE))
    return F.broadcast(blocks) if n * (size or 0) <= EXEMPLARS * 64 else blocks


def knn(queries: DataFrame, train: DataFrame, k: int = 1, apart: bool = False, leaves: bool = False) -> DataFrame:
    """id, distance: the mean distance of each query's z to its k nearest in train; apart: not to itself.

    leaves (k = 1, not apart): for many queries of few dimensions; equal vectors count once, far ones are not compared.
    """
    if apart:
        queries, train = queries.where("id is not null"), train.where("id is not null")
    if leaves:
        left, right = pairs.packed(queries, "z", ["id"], most=pairs.SOUGHT), _leaved_small(train)
    else:
        left, right = pairs.packed(queries, "z", ["id"]), _packed_small(train, "z", ["id"])
    ids = ("id", "id") if apart else None

    def each(_: dict, a: pairs.Block, b: pairs.Block) -> Iterator[dict]:
        if leaves and (near := pairs.nearest(a, b)) is not None:
            yield {"id": a.columns["id"], "d": pa.array(near)}
            return
        for s in a.parts():
            itself = pairs.excluded(a, s, b, ids)
            without = pairs.either(itself, pairs.unlike(a, s, b))
            d, id_ = pairs.squared(a.m[s], b.m, k == 1 and without is None), a.columns["id"][s]
            if k == 1:
                some = pa.array(pairs.counted(a, s, b, itself) > 0)
                yield {"id": id_.filter(some), "d": pairs.least(d, without).filter(some)}
                continue
            if without is not None:
                d = np.where(without, np.nan, d)
            n = np.repeat(np.arange(len(d)), min(k, d.shape[1]))
            near = np.sort(d if d.shape[1] <= k else np.partition(d, k - 1, axis=1)[:, :k], axis=1).ravel()
            gone = np.isnan(near) if without is not None else np.zeros(len(near), bool)
            yield {"id": id_.take(pa.array(n)), "d": pa.array(near, mask=gone)}

    found = pairs.compared(left, right, [], each, f"id {dict(queries.dtypes)['id']}, d double").withColumn("d", F.sqrt("d"))
    if k == 1:
        return found.groupBy("id").agg(F.min("d").alias("distance"))
    near = F.slice(F.sort_array(F.collect_list("d")), 1, k)
    return found.groupBy("id").agg((F.aggregate(near, F.lit(0.0), lambda t, x: t + x) / F.size(near)).alias("distance"))


def nearest_by_profile(rows: DataFrame) -> DataFrame:
    """id, against, distance: the distance of each of rows (id, profile, v) to the nearest other vector of each profile."""
    rows = rows.where("id is not null")
    left, right = pairs.packed(rows, "v", ["id"]), _packed_small(rows, "v", ["id"], ["profile"])

    def each(keys: dict, a: pairs.Block, b: pairs.Block) -> Iterator[dict]:
        for s in a.parts():
            itself = pairs.excluded(a, s, b, ("id", "id"))
            without = pairs.either(itself, pairs.unlike(a, s, b))
            some = pa.array(pairs.counted(a, s, b, itself) > 0)
            yield {"id": a.columns["id"][s].filter(some), "against": keys["r_profile"], "d": pairs.least(pairs.squared(a.m[s], b.m, without is None), without).filter(some)}

    types = dict(rows.dtypes)
    found = pairs.compared(left, right, [], each, f"id {types['id']}, against {types['profile']}, d double")
    return found.groupBy("id", "against").agg(F.sqrt(F.min("d")).alias("distance"))


def alike(rows: DataFrame, threshold: float) -> DataFrame:
    """profile, id, other, similarity of the pairs of a profile's vectors (id < other) with a cosine of `threshold` or more."""
    rows = rows.where("id is not null")
    left, right = pairs.packed(rows, "v", ["id"], ["profile"]), _packed_small(rows, "v", ["id"], ["profile"])

    def each(keys: dict, a: pairs.Block, b: pairs.Block) -> Iterator[dict]:
        others = b.numbers("id")
        for s in a.parts():
            c = pairs.cosines(a.m[s], b.m)
            fits = ~(c < threshold) & (a.numbers("id")[s][:, None] < others[None, :])
            if (unlike := pairs.unlike(a, s, b)) is not None:
                fits &= ~unlike
            i, j = np.nonzero(fits)
            if len(i):
                yield {"profile": keys["profile"], "id": a.columns["id"][s].take(pa.array(i)), "other": b.columns["id"].take(pa.array(j)), "similarity": pa.array(c[i, j])}

    types = dict(rows.dtypes)
    return pairs.compared(left, right, ["profile"], each, f"profile {types['profile']}, id {types['id']}, other {types['id']}, similarity double")


def floors(loo: DataFrame, contrast: DataFrame) -> DataFrame:
    """One row: floor (median), spread (population deviation, 0 counts as 1) of exemplars' distances, ceiling (mean of contrast's)."""
    own = loo.agg(F.percentile("distance", F.lit(0.5)).alias("floor"), F.stddev_pop("distance").alias("s"))
    own = own.select("floor", F.when(F.col("s") == 0, F.lit(1.0)).otherwise(F.col("s")).alias("spread"))
    return own.crossJoin(contrast.agg(F.avg("distance").alias("ceiling")))


def judged(distances: DataFrame, model: DataFrame) -> DataFrame:
    """distances with normalized ((distance - floor) / spread) and on_voice."""
    rows = distances.crossJoin(F.broadcast(model.select("floor", "spread")))
    return rows.select("id", "distance", ((F.col("distance") - F.col("floor")) / F.col("spread")).alias("normalized"), (F.col("distance") <= F.col("floor") + F.col("spread")).alias("on_voice"))


def confidence(features: DataFrame) -> DataFrame:
    """name, confidence: squared correlation of each feature (value) with y (1 exemplar, 0 contrast), both deviations plus 1e-9."""
    stats = features.groupBy("name").agg(
        F.avg("value").alias("mx"), F.stddev_pop("value").alias("sx"), F.avg("y").alias("my"), F.stddev_pop("y").alias("sy"), F.avg(F.col("value") * F.col("y")).alias("mxy")
    )
    r = (F.col("mxy") - F.col("mx") * F.col("my")) / ((F.col("sx") + 1e-9) * (F.col("sy") + 1e-9))
    return stats.select("name", (r * r).alias("confidence"))


def floored(weights: DataFrame) -> DataFrame:
    """weights (name, confidence) with each tell's confidence raised to its prior weight."""
    priors = F.create_map(*(F.lit(x) for tell, meta in P.TELL_META.items() for x in (f"tell_{tell}", meta[2])))
    return weights.select("name", F.greatest("confidence", priors[F.col("name")]).alias("confidence"))


def direction(z: DataFrame, weights: DataFrame, most: int = 6, least: float = 0.20) -> DataFrame:
    """id, place, name, move of the named features that would bring a draft closer.

    z: id, name, z; weights: name, confidence. A tell below its norm is no fault.
    """
    tell = F.col("name").startswith("tell_")
    rows = z.join(F.broadcast(weights), "name").withColumn("importance", F.when(tell & (F.col("z") <= 0), F.lit(0.0)).otherwise(F.col("confidence") * F.abs("z")))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round("importance", 9)), "name"))).where((F.col("place") <= most) & (F.col("importance") > 0) & (F.col("confidence") >= least))
    return rows.select("id", F.col("place").cast("long").alias("place"), "name", F.when(tell | (F.col("z") > 0), "fewer").otherwise("more").alias("move"))


def blend(corpus_mean: Column, corpus_std: Column, n: Column, mean: Column, spread: Column, strength: Column) -> tuple[Column, Column]:
    """The mean and spread of a prior worth `strength` documents and a corpus of n."""
    w = F.when(n + strength > 0, n / (n + strength)).otherwise(F.lit(0.0))
    return w * corpus_mean + (1 - w) * mean, w * corpus_std + (1 - w) * spread


#: Mean and spread of each axis before any corpus is seen, and the documents that they are worth.
PRIORS = {
    "hedge": (6.0, 4.0, 2.0), "booster": (4.0, 4.0, 2.0), "concreteness": (2.7094, 0.2792, 2.0),
    "first_person_sg": (27.42, 25.14, 2.0), "article": (80.52, 20.86, 2.0), "preposition": (122.57, 17.99, 2.0),
    "conjunction": (72.36, 13.46, 2.0), "pronoun": (112.81, 40.16, 2.0),
}


def blended(values: DataFrame) -> DataFrame:
    """axis, mean, spread of values (doc_id, axis, value), drawn towards the axes' priors: one partial aggregate, a row an axis."""
    prior = F.create_map(*(x for name, p in PRIORS.items() for x in (F.lit(name), F.array(*map(F.lit, p)))))[F.col("axis")]
    by = values.groupBy("axis").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.count("value").alias("n"))
    mean, spread = blend(F.col("m"), F.col("s"), F.col("n"), prior[0], prior[1], prior[2])
    return by.select("axis", mean.alias("mean"), spread.alias("spread"))


def prior_report(values: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """axis_report of values against a corpus' values (their own without one) blended with the priors."""
    return axis_report(values, blended(values if corpus is None else corpus))


def axis_report(values: DataFrame, reference: DataFrame, hint: float = 0.5) -> DataFrame:
    """doc_id, axis, value, reference_mean, z, direction for any group of axes.

    values: doc_id, axis, value; reference: axis, mean, spread (0 counts as 1).
    """
    rows = values.join(F.broadcast(reference), "axis")
    z = (F.col("value") - F.col("mean")) / F.when(F.col("spread") == 0, F.lit(1.0)).otherwise(F.col("spread"))
    rows = rows.withColumn("z", z)
    return rows.select("doc_id", "axis", "value", F.col("mean").alias("reference_mean"), "z", F.when(F.col("z") >= hint, "fewer").when(F.col("z") <= -hint, "more").otherwise("").alias("direction"))


def _in_order() -> Window:
    return Window.partitionBy("doc").orderBy("i")


def adjacent(rows: DataFrame, lag: int = 1) -> DataFrame:
    """doc, i, similarity of each vector (doc, i, v) to the one `lag` before it."""
    rows = rows.withColumn("before", F.lag("v", lag).over(_in_order())).where("before is not null")
    return rows.select("doc", "i", V.cosine(F.col("before"), F.col("v")).alias("similarity"))


def coherence(rows: DataFrame, lag: int = 1) -> DataFrame:
    """doc, coherence: the mean similarity of vectors `lag` apart; 0 without any."""
    found = adjacent(rows, lag).groupBy("doc").agg(F.avg("similarity").alias("coherence"))
    return rows.select("doc").distinct().join(found, "doc", "left").select("doc", F.coalesce("coherence", F.lit(0.0)).alias("coherence"))


def novelty(rows: DataFrame) -> DataFrame:
    """doc, i, novelty: 1 - the cosine to the mean of all vectors before (its length plus 1e-9).

    Running sums by axis, so that a long document needs no array of all its vectors.
    """
    axes = rows.select("doc", "i", F.posexplode("v").alias("axis", "x"))
    before = Window.partitionBy("doc", "axis").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    axes = axes.withColumn("c", F.avg("x").over(before)).where("c is not null")
    sums = axes.groupBy("doc", "i").agg(F.sum(F.col("x") * F.col("c")).alias("xc"), F.sum(F.col("c") * F.col("c")).alias("cc"))
    return sums.select("doc", "i", (1 - F.col("xc") / (F.sqrt("cc") + 1e-9)).alias("novelty"))


def flow(rows: DataFrame, least: int = 4) -> DataFrame:
    """doc, speed, volume, circuitousness, terminal_initial_ratio, circle_back, coherence of documents with `least` vectors."""
    enough = rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.min_by("v", "i").alias("first"), F.max_by("v", "i").alias("last")).where(F.col("n") >= least)
    steps = rows.withColumn("before", F.lag("v").over(_in_order())).groupBy("doc").agg(F.sum(V.distance(F.col("before"), F.col("v"))).alias("path"))
    new = novelty(rows).groupBy("doc").agg(F.avg("novelty").alias("speed"), F.min_by("novelty", "i").alias("opening"), F.max_by("novelty", "i").alias("closing"))
    centre = by_axis(rows, "doc").select("doc", "mean")
    volume = rows.join(centre, "doc").groupBy("doc").agg(F.avg(V.distance(F.col("v"), F.col("mean"))).alias("volume"))
    found = enough.join(steps, "doc").join(new, "doc").join(volume, "doc").join(coherence(rows), "doc")
    return found.select(
        "doc", "speed", "volume", (F.col("path") / (V.distance(F.col("last"), F.col("first")) + 1e-9)).alias("circuitousness"),
        (F.col("closing") / (F.col("opening") + 1e-9)).alias("terminal_initial_ratio"), V.dot(F.col("first"), F.col("last")).alias("circle_back"), "coherence",
    )


def insertion(rows: DataFrame) -> DataFrame:
    """doc, hit_rate, chance: how often a vector's own slot among the others gives the best coherence (the first of equals).

    Taking a vector out and putting it between two others changes three of the
    neighbours' products, so a slot costs one product. The slots of a block of
    vectors are weighed at once, and the best of them is what is left.
    """
    seq = rows.withColumn("next", F.lead("v").over(_in_order())).withColumn("prev", F.lag("v").over(_in_order()))
    seq = seq.withColumn("i", (F.row_number().over(_in_order()) - 1).cast("long"))
    n = rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
    moved = seq.where("next is not null and prev is not null")
    own = moved.select("doc", F.col("i").alias("m"), F.col("i").alias("slot"), (V.dot(F.col("prev"), F.col("v")) + V.dot(F.col("v"), F.col("next")) - V.dot(F.col("prev"), F.col("next"))).alias("gain"))
    # a block ends on the vector that the next one begins with, so that each two neighbours share a block
    block, first = F.floor(F.col("i") / pairs.ROWS), (F.col("i") % pairs.ROWS == 0) & (F.col("i") > 0)
    line = seq.select("doc", F.explode(F.when(first, F.array(block - 1, block)).otherwise(F.array(block))).alias("block"), "i", F.col("next").isNull().alias("last"), "v")
    left = pairs.packed(moved, "v", ["i"], ["doc"])
    right = _packed_small(line, "v", ["i", "last"], ["doc", "block"], order="i", most=pairs.ROWS + 1)

    def each(keys: dict, a: pairs.Block, b: pairs.Block) -> Iterator[dict]:
        at, with_last = b.numbers("i"), b.columns["last"][-1].as_py()
        beside = np.einsum("ij,ij->i", b.m[:-1], b.m[1:])
        for s in a.parts():
            m = a.numbers("i")[s]
            p = pairs.products(a.m[s], b.m)
            if (unlike := pairs.unlike(a, s, b)) is not None:
                p[unlike] = np.nan
            gain = p[:, :-1] + p[:, 1:] - beside
            gain[(at[None, :-1] == m[:, None]) | (at[None, :-1] == m[:, None] - 1)] = -np.inf
            slot = at[None, :-1] + (at[None, :-1] < m[:, None])
            if at[0] == 0:
                gain, slot = np.hstack([p[:, :1], gain]), np.hstack([np.zeros((len(m), 1), np.int64), slot])
            if with_last:
                gain, slot = np.hstack([gain, p[:, -1:]]), np.hstack([slot, np.full((len(m), 1), at[-1])])
            if not gain.shape[1]:
                continue
            gain = np.round(np.where(np.isnan(gain), -np.inf, gain), 9)
            best = gain.argmax(axis=1)
            some, rows_ = pa.array(np.isfinite(gain.max(axis=1))), np.arange(len(m))
            yield {"doc": keys["doc"], "m": a.columns["i"][s].filter(some), "slot": pa.array(slot[rows_, best].astype(np.int64)).filter(some), "gain": pa.array(gain[rows_, best]).filter(some)}

    slots = pairs.compared(left, right, ["doc"], each, f"doc {dict(rows.dtypes)['doc']}, m long, slot long, gain double")
    best = slots.unionByName(own.withColumn("gain", F.round("gain", 9))).groupBy("doc", "m").agg(F.min_by("slot", F.struct(-F.col("gain"), F.col("slot"))).alias("best"))
    hits = best.groupBy("doc").agg(F.avg((F.col("best") == F.col("m")).cast("double")).alias("hit_rate"))
    return n.join(hits, "doc", "left").select("doc", F.coalesce("hit_rate", F.lit(0.0)).alias("hit_rate"), (F.lit(1.0) / F.col("n")).alias("chance"))


def shuffled(rows: DataFrame, rounds: int = 200, seed: int = 0) -> DataFrame:
    """doc, beaten: the share of seeded permutations with less coherence than the order itself."""
    base = coherence(rows).select("doc", "coherence")
    permuted = rows.crossJoin(rows.sparkSession.range(rounds).select(F.col("id").alias("round"))).withColumn("r", F.xxhash64("doc", "i", "round", F.lit(seed)))
    order = Window.partitionBy("doc", "round").orderBy("r", "i")
    permuted = permuted.withColumn("before", F.lag("v").over(order)).where("before is not null")
    each = permuted.groupBy("doc", "round").agg(F.avg(V.dot(F.col("before"), F.col("v"))).alias("c"))
    return each.join(base, "doc").groupBy("doc").agg(F.avg((F.col("coherence") > F.col("c")).cast("double")).alias("beaten"))


def diagnose(rows: DataFrame) -> DataFrame:
    """profile, exemplars, coherence (mean pairwise cosine), outliers (ids farther from their nearest than median + 1.5 deviations), warning."""
    rows = rows.where("id is not null")
    left, right = pairs.packed(rows, "v", ["id"], ["profile"]), _packed_small(rows, "v", ["id"], ["profile"])

    def each(keys: dict, a: pairs.Block, b: pairs.Block) -> Iterator[dict]:
        for s in a.parts():
            itself = pairs.excluded(a, s, b, ("id", "id"))
            without = pairs.either(itself, pairs.unlike(a, s, b))
            n = pairs.counted(a, s, b, itself)
            some, c = pa.array(n > 0), pairs.cosines(a.m[s], b.m)
            c = pa.array(c.sum(axis=1)) if without is None else pa.array(np.where(without, 0.0, c).sum(axis=1), mask=without.all(axis=1))
            d = pairs.least(pairs.squared(a.m[s], b.m, without is None), without)
            yield {"profile": keys["profile"], "id": a.columns["id"][s].filter(some), "d": d.filter(some), "c": c.filter(some), "n": pa.array(n).filter(some)}

    types = dict(rows.dtypes)
    met = pairs.compared(left, right, ["profile"], each, f"profile {types['profile']}, id {types['id']}, d double, c double, n long")
    near = met.groupBy("profile", "id").agg(F.sqrt(F.min("d")).alias("nearest"), F.sum("c").alias("c"), F.sum("n").alias("n"))
    limits = near.groupBy("profile").agg((F.percentile("nearest", F.lit(0.5)) + 1.5 * F.stddev_pop("nearest")).alias("limit"), (F.sum("c") / F.sum("n")).alias("coherence"), F.count(F.lit(1)).alias("exemplars"))
    far = near.join(F.broadcast(limits), "profile").where("nearest > limit").groupBy("profile").agg(F.sort_array(F.collect_list("id")).alias("outliers"))
    found = limits.join(far, "profile", "left").withColumn("outliers", F.coalesce("outliers", F.array().cast("array<bigint>")))
    warning = F.when(F.size("outliers") > 0, "outliers").when(F.col("coherence") < 0.75, "low coherence").otherwise("")
    return found.select("profile", "exemplars", "coherence", F.array_join(F.transform("outliers", lambda x: x.cast("string")), ",").alias("outliers"), warning.alias("warning"))


def silhouette(rows: DataFrame) -> DataFrame:
    """profile, silhouette: mean silhouette (Euclidean) of rows by cluster."""
    rows = rows.where("id is not null")
    left, right = pairs.packed(rows, "v", ["id", "cluster"], ["profile"]), _packed_small(rows, "v", ["id"], ["profile", "cluster"])

    def each_pair(keys: dict, a: pairs.Block, b: pairs.Block) -> Iterator[dict]:
        for s in a.parts():
            itself = pairs.excluded(a, s, b, ("id", "id"))
            without = pairs.either(itself, pairs.unlike(a, s, b))
            d = np.sqrt(pairs.squared(a.m[s], b.m))
            d = d if without is None else np.where(without, 0.0, d)
            some = pa.array(pairs.counted(a, s, b, itself) > 0)
            yield {
                "profile": keys["profile"], "id": a.columns["id"][s].filter(some), "cluster": a.columns["cluster"][s].filter(some), "of": keys["r_cluster"],
                "d": pa.array(d.sum(axis=1)).filter(some), "n": pa.array(pairs.counted(a, s, b, without)).filter(some),
            }

    types = dict(rows.dtypes)
    met = pairs.compared(left, right, ["profile"], each_pair, f"profile {types['profile']}, id {types['id']}, cluster {types['cluster']}, of {types['cluster']}, d double, n long")
    to = met.groupBy("profile", "id", "cluster", "of").agg((F.sum("d") / F.nullif(F.sum("n"), F.lit(0))).alias("d"))
    each = to.groupBy("profile", "id").agg(F.min(F.when(F.col("cluster") == F.col("of"), F.col("d"))).alias("a"), F.min(F.when(F.col("cluster") != F.col("of"), F.col("d"))).alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return each.groupBy("profile").agg(F.avg(s).alias("silhouette"))


def modes(rows: DataFrame, seed: int = 0) -> DataFrame:
    """rows of one profile (profile, id, v) with cluster: the two modes that k-means finds, in Spark's own distributed form."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    points = rows.withColumn("features", array_to_vector("v"))
    fitted = KMeans(k=2, seed=seed, featuresCol="features", predictionCol="cluster").fit(points)
    return fitted.transform(points).drop("features")


def mixed(rows: DataFrame, least: int = 6, above: float = 0.25) -> DataFrame:
    """profile, exemplars, silhouette, mixed of one profile: whether its two modes lie apart; unknown below `least` exemplars."""
    found = silhouette(modes(rows))
    count = rows.groupBy("profile").agg(F.count(F.lit(1)).alias("exemplars"))
    value = F.when(F.col("exemplars") >= least, F.col("silhouette"))
    return count.join(found, "profile", "left").select("profile", "exemplars", value.alias("silhouette"), F.coalesce(value > above, F.lit(False)).alias("mixed"))


def profile_report(evidence: DataFrame, model: DataFrame, exemplars: DataFrame, contrast: DataFrame) -> DataFrame:
    """One row: health, warning, exemplars, contrast, words, paragraphs, exemplar_floor, exemplar_spread, contrast_ceiling.

    evidence: words, paragraphs, health (one row); model: `floors`.
    """
    warning = F.when(F.col("health") == "insufficient", "Too little text to fit a voice.").when(F.col("health") == "weak", "Little text: the fit is unsure.")
    one = evidence.crossJoin(F.broadcast(model)).crossJoin(F.broadcast(exemplars.agg(F.count(F.lit(1)).alias("exemplars")))).crossJoin(F.broadcast(contrast.agg(F.count(F.lit(1)).alias("contrast"))))  # a row each
    return one.select(
        "health", warning.alias("warning"), "exemplars", "contrast", "words", "paragraphs",
        F.col("floor").alias("exemplar_floor"), F.col("spread").alias("exemplar_spread"), F.col("ceiling").alias("contrast_ceiling"),
    )


def span_guidance(distances: DataFrame, model: DataFrame, most: int = 3) -> DataFrame:
    """doc, place, i, distance, distance_z of the paragraphs (doc, i, distance) farthest from the voice, in documents of two or more."""
    many = distances.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("doc")
    rows = distances.join(many, "doc", "left_semi").crossJoin(F.broadcast(model.select("floor", "spread")))  # one row
    place = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc(F.round("distance", 9)), "i"))
    rows = rows.withColumn("place", place.cast("long")).where(F.col("place") <= most)
    return rows.select("doc", "place", "i", "distance", ((F.col("distance") - F.col("floor")) / F.col("spread")).alias("distance_z"))


def sign_test(drafts: DataFrame, train: DataFrame, picked: DataFrame, names: list[str], rounds: int = 20, most: int = 6, seed: int = 0) -> DataFrame:
    """id, advised, chance, win: how much nearer a draft comes with the advised features at their mean, and with random ones.

    drafts, train: id, z (in the order of names); picked: id, name (`direction`).
    Chance is the mean of `rounds` seeded draws of `most` features.
    """
    of = F.create_map(*(F.lit(x) for i, n in enumerate(names) for x in (n, i)))
    advised = picked.groupBy("id").agg(F.collect_set(of[F.col("name")]).alias("moved")).withColumn("round", F.lit(0).cast("long"))
    every = F.sequence(F.lit(0), F.lit(len(names) - 1))
    drawn = drafts.select("id").crossJoin(drafts.sparkSession.range(1, rounds + 1).select(F.col("id").alias("round")))
    order = F.array_sort(F.transform(every, lambda i: F.struct(F.xxhash64("id", "round", i, F.lit(seed)).alias("h"), i.alias("i"))))
    drawn = drawn.select("id", F.transform(F.slice(order, 1, most), lambda x: x["i"]).alias("moved"), "round")
    still = drafts.select("id", F.array().cast("array<int>").alias("moved"), F.lit(-1).cast("long").alias("round"))
    tried = drafts.join(advised.unionByName(drawn).unionByName(still), "id")
    snapped = F.transform("z", lambda x, i: F.when(F.array_contains("moved", i), F.lit(0.0)).otherwise(x))
    near = knn(tried.select(F.struct("id", "round").alias("id"), snapped.alias("z")), train, leaves=True)
    by = near.groupBy(F.col("id.id").alias("id")).agg(
        F.max(F.when(F.col("id.round") == -1, F.col("distance"))).alias("d"), F.max(F.when(F.col("id.round") == 0, F.col("distance"))).alias("a"),
        F.avg(F.when(F.col("id.round") > 0, F.col("distance"))).alias("c"),
    )
    gain, chance = F.col("d") - F.coalesce("a", "d"), F.col("d") - F.col("c")
    return by.select("id", gain.alias("advised"), chance.alias("chance"), (gain > chance).alias("win"))


def auc(scores: DataFrame) -> DataFrame:
    """One row auc: the chance that a row of y = 1 scores above one of y = 0, ties counting half.

    Scores are counted first, so the ranks are taken over distinct scores.
    """
    by = scores.groupBy("score").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n")).withColumn("neg", F.col("n") - F.col("pos"))
    below = F.coalesce(F.sum("neg").over(Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = by.withColumn("won", F.col("pos") * (below + F.col("neg") / 2))
    return ranked.agg((F.sum("won") / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def permuted_auc(scores: DataFrame, rounds: int = 200, seed: int = 0) -> DataFrame:
    """One row auc: the mean over seeded permutations of the labels y of scores (id, score, y), the level of chance."""
    ranks = scores.groupBy("score").agg(F.count(F.lit(1)).alias("ties"))
    ranks = ranks.withColumn("rank", F.coalesce(F.sum("ties").over(Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + (F.col("ties") + 1) / 2)
    ranked = scores.join(ranks, "score").crossJoin(F.broadcast(scores.agg(F.sum("y").alias("pos"), (F.count(F.lit(1)) - F.sum("y")).alias("neg"))))  # one row
    each = ranked.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    order = Window.partitionBy("round").orderBy(F.xxhash64("id", "y", "round", F.lit(seed)), "id", "y")
    drawn = each.withColumn("n", F.row_number().over(order)).where("n <= pos")
    by = drawn.groupBy("round", "pos", "neg").agg(((F.sum("rank") - F.first("pos") * (F.first("pos") + 1) / 2) / (F.first("pos") * F.first("neg"))).alias("auc"))
    return by.agg(F.avg("auc").alias("auc"))


def weighted(rows: DataFrame, value: Column, weight: Column) -> DataFrame:
    """One row mean, spread: the weighted mean and population deviation, from two passes of partial sums."""
    rows = rows.select(value.alias("x"), weight.alias("w"))
    mean = rows.agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("mean"))
    apart = F.col("x") - F.col("mean")
    return rows.crossJoin(F.broadcast(mean)).agg(F.max("mean").alias("mean"), F.sqrt(F.sum(F.col("w") * apart * apart) / F.sum("w")).alias("spread"))  # mean is one row
