"""Registered queries of the voice model, flow and profiles, over the embeddings table.

vec_id is the order of paragraphs and label the document or profile. Exemplars
are the vectors of profile 0, drafts all others, contrast those of profile 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions import vectors as V
from quillon.operators import report, tells, voice
from quillon.plans import fixtures, sql
from quillon.plans.queries import register

DIGITS = 6
#: Labelled documents up to which their ids are broadcast; beyond that the texts are shuffled to them.
LABELS = 500_000


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("profile"), F.col("embedding").cast("array<double>").alias("v"))


def _ordered(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select(F.col("profile").alias("doc"), F.col("id").alias("i"), "v")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, DIGITS).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _register(name: str, relation, text: str | None) -> None:
    register(name, lambda spark, d: _rounded(relation(spark, d)), text)


_E = """e as (select vec_id as id, label::bigint as profile, embedding::double[] as v from embeddings),
x as (select id, profile, generate_subscripts(v, 1) - 1 as axis, unnest(v) as x from e)"""
_AXES = f"""{_E},
axes as (select axis, avg(x) as mean, case when stddev_pop(x) = 0 then 1 else stddev_pop(x) end as std from x where profile = 0 group by axis),
z as (select id, profile, axis, (x - mean) / std as z from x join axes using (axis)),
exemplars as (select * from z where profile = 0)"""
_LOO = """loo as (select id, min(d) as distance from (select a.id, b.id as other, sqrt(sum((a.z - b.z) * (a.z - b.z))) as d
  from exemplars a join exemplars b on a.axis = b.axis and a.id <> b.id group by a.id, b.id) p group by id)"""
_KNN = """knn as (select id, profile, min(d) as distance from (select a.id, a.profile, b.id as other, sqrt(sum((a.z - b.z) * (a.z - b.z))) as d
  from z a join exemplars b on a.axis = b.axis where a.profile <> 0 group by a.id, a.profile, b.id) p group by id, profile)"""
_FLOORS = """floors as (select quantile_cont(loo.distance, 0.5) as floor, case when stddev_pop(loo.distance) = 0 then 1 else stddev_pop(loo.distance) end as spread,
  (select avg(distance) from knn where profile = 1) as ceiling from loo)"""


def _fit(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = _vectors(spark, d)
    exemplars = rows.where("profile = 0")
    axes = voice.by_axis(exemplars)
    return rows, axes, voice.standardized(exemplars, axes)


def _drafts(spark: SparkSession, d: str) -> DataFrame:
    rows, axes, train = _fit(spark, d)
    return voice.knn(voice.standardized(rows.where("profile <> 0"), axes), train)


def _model(spark: SparkSession, d: str) -> DataFrame:
    rows, axes, train = _fit(spark, d)
    return voice.floors(voice.knn(train, train, apart=True), voice.knn(voice.standardized(rows.where("profile = 1"), axes), train))


_register("axis_fit", lambda s, d: voice.by_axis(_vectors(s, d).where("profile = 0")).select(F.posexplode(F.arrays_zip("mean", "std")).alias("axis", "m")).select(F.col("axis").cast("long").alias("axis"), "m.mean", "m.std"), f"with {_AXES} select axis, round(mean, 6) as mean, round(std, 6) as std from axes")
_register("knn_distance", _drafts, f"with {_AXES}, {_KNN} select id, round(distance, 6) as distance from knn")
_register("loo_distances", lambda s, d: (lambda t: voice.knn(t, t, apart=True))(_fit(s, d)[2]), f"with {_AXES}, {_LOO} select id, round(distance, 6) as distance from loo")
_register("exemplar_floor", _model, f"with {_AXES}, {_LOO}, {_KNN}, {_FLOORS} select round(floor, 6) as floor, round(spread, 6) as spread, round(ceiling, 6) as ceiling from floors")
_register("on_voice", lambda s, d: voice.judged(_drafts(s, d), _model(s, d)), f"with {_AXES}, {_LOO}, {_KNN}, {_FLOORS} select id, round(distance, 6) as distance, round((distance - floor) / spread, 6) as normalized, distance <= floor + spread as on_voice from knn, floors")
_register(
    "multi_profile_score",
    lambda s, d: voice.nearest_by_profile(_vectors(s, d)),
    f"with {_E} select a.id, b.profile as against, round(min(list_distance(a.v, b.v)), 6) as distance from e a, e b where a.id <> b.id group by a.id, b.profile",
)
_UNIT = f"{_E}, u as (select id, profile, axis, x / sqrt(sum(x * x) over (partition by id)) as x from x)"
_register("style_vec", lambda s, d: voice.mean_vector(_vectors(s, d), "profile").select("profile", F.posexplode("v").alias("axis", "x")).select("profile", F.col("axis").cast("long").alias("axis"), "x"), f"with {_UNIT} select profile, axis, round(avg(x), 6) as x from u group by profile, axis")

_register("paragraph_drift", lambda s, d: voice.adjacent(_ordered(s, d)).where("similarity < 0.35").select("doc", "i", "similarity", F.when(F.col("similarity") < 0.25, "medium").otherwise("low").alias("severity")), f"""with {_E},
adj as (select profile as doc, id as i, v, lag(v) over (partition by profile order by id) as b from e),
sims as (select doc, i, list_cosine_similarity(v, b) as similarity from adj where b is not null)
select doc, i, round(similarity, 6) as similarity, case when similarity < 0.25 then 'medium' else 'low' end as severity from sims where similarity < 0.35""")
_ADJ = f"""{_E}, adj as (select profile as doc, id as i, v, lag(v) over (partition by profile order by id) as b from e)"""
_register("flow_coherence", lambda s, d: voice.coherence(_ordered(s, d)), f"with {_ADJ} select doc, round(coalesce(avg(list_cosine_similarity(v, b)), 0), 6) as coherence from adj group by doc")
for _name, _lag in (("coh_first_order_coherence", 1), ("coh_second_order_coherence", 2)):
    _register(
        _name,
        lambda s, d, k=_lag: voice.coherence(_ordered(s, d), k),
        f"with {_E}, adj as (select profile as doc, v, lag(v, {_lag}) over (partition by profile order by id) as b from e) select doc, round(coalesce(avg(list_cosine_similarity(v, b)), 0), 6) as coherence from adj group by doc",
    )
_register("point_nowhere_paragraph", lambda s, d: voice.coherence(_ordered(s, d)).where("coherence < 0.25"), f"with {_ADJ} select doc, round(avg(list_cosine_similarity(v, b)), 6) as coherence from adj group by doc having avg(list_cosine_similarity(v, b)) < 0.25")
_NOVELTY = """c as (select profile as doc, id as i, axis, x, avg(x) over (partition by profile, axis order by id rows between unbounded preceding and 1 preceding) as c from x),
nov as (select doc, i, 1 - sum(x * c) / (sqrt(sum(c * c)) + 1e-9) as novelty from c where c is not null group by doc, i)"""
_register("flow_novelty", lambda s, d: voice.novelty(_ordered(s, d)), f"with {_E}, {_NOVELTY} select doc, i, round(novelty, 6) as novelty from nov")
_register("flow_report", lambda s, d: voice.flow(_ordered(s, d)), f"""with {_ADJ}, {_NOVELTY},
centre as (select profile as doc, axis, avg(x) as m from x group by 1, 2),
vol as (select doc, avg(d) as volume from (select profile as doc, id, sqrt(sum((x - m) * (x - m))) as d from x join centre on profile = doc and x.axis = centre.axis group by 1, 2) a group by doc),
ends as (select profile as doc, count(*) as n, min_by(v, id) as f, max_by(v, id) as l from e group by 1),
path as (select doc, sum(list_distance(v, b)) as path, avg(list_cosine_similarity(v, b)) as coherence from adj group by doc),
n as (select doc, avg(novelty) as speed, min_by(novelty, i) as o, max_by(novelty, i) as c from nov group by doc)
select doc, round(speed, 6) as speed, round(volume, 6) as volume, round(path / (list_distance(l, f) + 1e-9), 6) as circuitousness,
  round(c / (o + 1e-9), 6) as terminal_initial_ratio, round(list_dot_product(f, l), 6) as circle_back, round(coherence, 6) as coherence
from ends join path using (doc) join n using (doc) join vol using (doc) where n >= 4""")
_register("insertion_test", lambda s, d: voice.insertion(_ordered(s, d)), None)
_register("shuffle_test", lambda s, d: voice.shuffled(_ordered(s, d)), None)

_PAIRS = f"{_E}, p as (select a.id, list_cosine_similarity(a.v, b.v) as similarity, list_distance(a.v, b.v) as moved, a.v as a, b.v as b from e a join e b on b.id = a.id + 1)"


def _next(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d)
    return rows.select("id", F.col("v").alias("a")).join(rows.select((F.col("id") - 1).alias("id"), F.col("v").alias("b")), "id")


_register("content_similarity", lambda s, d: _next(s, d).select("id", V.cosine(F.col("a"), F.col("b")).alias("similarity")), f"with {_PAIRS} select id, round(similarity, 6) as similarity from p")
_register("preserves_content", lambda s, d: _next(s, d).select("id", (V.cosine(F.col("a"), F.col("b")) >= 0.85).alias("preserved")), f"with {_PAIRS} select id, similarity >= 0.85 as preserved from p")
_register(
    "evaluate_rewrite",
    lambda s, d: _next(s, d).join(_drafts(s, d).withColumnRenamed("distance", "before"), "id").join(_drafts(s, d).select((F.col("id") - 1).alias("id"), F.col("distance").alias("after")), "id").select("id", "before", "after", ((V.cosine(F.col("a"), F.col("b")) >= 0.85) & (F.col("after") < F.col("before"))).alias("accepted")),
    f"with {_AXES}, {_KNN}, p as (select a.id, list_cosine_similarity(a.v, b.v) as similarity from e a join e b on b.id = a.id + 1) select p.id, round(x.distance, 6) as before, round(y.distance, 6) as after, similarity >= 0.85 and y.distance < x.distance as accepted from p join knn x on x.id = p.id join knn y on y.id = p.id + 1",
)
_register("challenge_answered", lambda s, d: _ordered(s, d).groupBy("doc").agg(V.cosine(F.min_by("v", "i"), F.max_by("v", "i")).alias("similarity")).withColumn("fires", F.col("similarity") < 0.20), f"with {_E} select profile as doc, round(list_cosine_similarity(min_by(v, id), max_by(v, id)), 6) as similarity, list_cosine_similarity(min_by(v, id), max_by(v, id)) < 0.20 as fires from e group by profile")
_register("closing_the_circle", lambda s, d: _ordered(s, d).groupBy("doc").agg(V.cosine(F.min_by("v", "i"), F.max_by("v", "i")).alias("similarity")).where("similarity < 0.15"), f"with {_E}, c as (select profile as doc, list_cosine_similarity(min_by(v, id), max_by(v, id)) as s from e group by profile) select doc, round(s, 6) as similarity from c where s < 0.15")
_register(
    "inconsistent_terminology",
    lambda s, d: voice.alike(_vectors(s, d), 0.55),
    f"with {_E} select a.profile, a.id, b.id as other, round(list_cosine_similarity(a.v, b.v), 6) as similarity from e a join e b on a.profile = b.profile and a.id < b.id where list_cosine_similarity(a.v, b.v) >= 0.55",
)
_register("diagnose_profile", lambda s, d: voice.diagnose(_vectors(s, d)), f"""with {_E},
pairs as (select a.profile, a.id, list_cosine_similarity(a.v, b.v) as c, list_distance(a.v, b.v) as d from e a join e b on a.profile = b.profile and a.id <> b.id),
near as (select profile, id, min(d) as nearest, sum(c) as c, count(*) as n from pairs group by profile, id),
lim as (select profile, quantile_cont(nearest, 0.5) + 1.5 * stddev_pop(nearest) as l, sum(c) / sum(n) as coherence, count(*) as exemplars from near group by profile),
far as (select profile, string_agg(id::varchar, ',' order by id) as outliers from near join lim using (profile) where nearest > l group by profile)
select profile, exemplars, round(coherence, 6) as coherence, coalesce(outliers, '') as outliers, case when outliers is not null then 'outliers' when coherence < 0.75 then 'low coherence' else '' end as warning from lim left join far using (profile)""")
_register("silhouette", lambda s, d: voice.silhouette(_vectors(s, d).withColumn("cluster", F.col("id") % 2)), f"""with {_E},
t as (select a.profile, a.id, a.id % 2 = b.id % 2 as own, avg(list_distance(a.v, b.v)) as d from e a join e b on a.profile = b.profile and a.id <> b.id group by 1, 2, 3),
s as (select profile, id, min(d) filter (where own) as a, min(d) filter (where not own) as b from t group by 1, 2)
select profile, round(avg(case when a is null or b is null then 0 else (b - a) / greatest(a, b) end), 6) as silhouette from s group by profile""")
_register("loo_auc", lambda s, d: (lambda f: voice.auc(voice.knn(f[2], f[2], apart=True).select((-F.round("distance", 9)).alias("score"), F.lit(1).alias("y")).unionByName(voice.knn(voice.standardized(f[0].where("profile = 1"), f[1]), f[2]).select((-F.round("distance", 9)).alias("score"), F.lit(0).alias("y")))))(_fit(s, d)), f"""with {_AXES}, {_LOO}, {_KNN},
s as (select distance, 1 as y from loo union all select distance, 0 from knn where profile = 1)
select round(avg(case when a.distance < b.distance then 1.0 when a.distance = b.distance then 0.5 else 0.0 end)::double, 6) as auc from s a, s b where a.y = 1 and b.y = 0""")


def _scores(spark: SparkSession, d: str) -> DataFrame:
    """id, score, y of exemplars, each left out, and contrast."""
    rows, axes, train = _fit(spark, d)
    own = voice.knn(train, train, apart=True).select("id", (-F.col("distance")).alias("score"), F.lit(1).alias("y"))
    return own.unionByName(voice.knn(voice.standardized(rows.where("profile = 1"), axes), train).select("id", (-F.col("distance")).alias("score"), F.lit(0).alias("y")))


_register("permutation_baseline", lambda s, d: voice.permuted_auc(_scores(s, d)), None)
_register(
    "weighted_mean_spread",
    lambda s, d: voice.weighted(s.read.parquet(f"{d}/lineitem.parquet"), F.col("l_extendedprice").cast("double"), F.col("l_quantity").cast("double")),
    "with m as (select sum(l_quantity::double * l_extendedprice::double) / sum(l_quantity::double) as mean from lineitem) select round(max(mean), 6) as mean, round(sqrt(sum(l_quantity::double * (l_extendedprice::double - mean) * (l_extendedprice::double - mean)) / sum(l_quantity::double)), 6) as spread from lineitem, m",
)


# Features by name: tells of labelled documents
def _rated(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, y, tell_<name> of labelled documents; the others' texts are not searched."""
    labels = spark.read.parquet(f"{d}/labels.parquet").groupBy("doc_id").agg(F.max("quality").cast("double").alias("y"))
    labels = voice.small(labels, LABELS)
    docs = fixtures.documents(spark, d).join(labels.select("doc_id"), "doc_id", "left_semi")
    return tells.sifted(docs).join(labels, "doc_id")


def _named(rated: DataFrame) -> DataFrame:
    """doc_id, name, value, y: a row for each document and tell."""
    each = F.array(*(F.struct(F.lit(f"tell_{n}").alias("name"), F.col(f"tell_{n}").alias("value")) for n in tells.PLAIN))
    return rated.select("doc_id", F.inline(each), "y")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return _named(_rated(spark, d))


def _norms(rows: DataFrame) -> DataFrame:
    std = F.stddev_pop("value")
    return rows.where("y = 1").groupBy("name").agg(F.avg("value").alias("mean"), F.when(std == 0, F.lit(1.0)).otherwise(std).alias("spread"))


_LABELLED = f"""{sql.LONG}, lab as (select doc_id, max(quality)::double as y from labels group by doc_id),
feats as (select doc_id, 'tell_' || tell as name, rate as value, y from long join lab using (doc_id)),
conf as (select name, pow((avg(value * y) - avg(value) * avg(y)) / ((stddev_pop(value) + 1e-9) * (stddev_pop(y) + 1e-9)), 2) as confidence from feats group by name),
norms as (select name, avg(value) as mean, case when stddev_pop(value) = 0 then 1 else stddev_pop(value) end as spread from feats where y = 1 group by name),
zs as (select doc_id, name, (value - mean) / spread as z from feats join norms using (name) where y = 0)"""
_register("feature_confidence", lambda s, d: voice.confidence(_labelled(s, d)), f"with {_LABELLED} select name, round(confidence, 6) as confidence from conf")


def _kept(rows: DataFrame) -> DataFrame:
    """rows, written once for several readers: in the cluster's checkpoint folder, or with the executors where none is set."""
    unset = rows.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isEmpty()
    return rows.localCheckpoint() if unset else rows.checkpoint()


def _direction(rows: DataFrame) -> DataFrame:
    z = rows.where("y = 0").join(F.broadcast(_norms(rows)), "name").select(F.col("doc_id").alias("id"), "name", ((F.col("value") - F.col("mean")) / F.col("spread")).alias("z"))
    return voice.direction(z, voice.floored(voice.confidence(rows)))


_register("voice_direction", lambda s, d: _direction(_labelled(s, d)), f"""with {_LABELLED},
floored as (select name, greatest(confidence, prior) as confidence from conf join meta on name = 'tell_' || tell),
imp as (select doc_id as id, name, z, confidence, case when z <= 0 then 0 else confidence * abs(z) end as importance from zs join floored using (name)),
r as (select *, row_number() over (partition by id order by round(importance, 9) desc, name) as place from imp)
select id, place, name, 'fewer' as move from r where place <= 6 and importance > 0 and confidence >= 0.2""")
_register(
    "tells_report",
    lambda s, d: (lambda rows: voice.axis_report(rows.where("y = 0").select("doc_id", F.col("name").alias("axis"), "value"), _norms(rows).withColumnRenamed("name", "axis")))(_labelled(s, d)),
    f"with {_LABELLED}, r as (select doc_id, name as axis, value, mean, (value - mean) / spread as z from feats join norms using (name) where y = 0) select doc_id, axis, round(value, 6) as value, round(mean, 6) as reference_mean, round(z, 6) as z, case when z >= 0.5 then 'fewer' when z <= -0.5 then 'more' else '' end as direction from r",
)
_PRIORS = "(values ('hedge', 6.0, 4.0, 2.0), ('booster', 4.0, 4.0, 2.0), ('concreteness', 2.7094, 0.2792, 2.0), ('first_person_sg', 27.42, 25.14, 2.0), ('article', 80.52, 20.86, 2.0), ('preposition', 122.57, 17.99, 2.0), ('conjunction', 72.36, 13.46, 2.0), ('pronoun', 112.81, 40.16, 2.0)) as p(axis, mean, spread, strength)"


def _blend(spark: SparkSession, d: str) -> DataFrame:
    priors = spark.sql(f"select axis, cast(mean as double) as mean, cast(spread as double) as spread, cast(strength as double) as strength from {_PRIORS}")
    rows = spark.range(0, 5).select(F.col("id").alias("n")).crossJoin(priors)
    mean, spread = voice.blend(F.lit(10.0), F.lit(3.0), F.col("n"), F.col("mean"), F.col("spread"), F.col("strength"))
    return rows.select("n", "axis", mean.alias("mean"), spread.alias("spread"))


_register("reference_blend", _blend, f"select n, axis, round(n / (n + strength::double) * 10 + (1 - n / (n + strength::double)) * mean::double, 6) as mean, round(n / (n + strength::double) * 3 + (1 - n / (n + strength::double)) * spread::double, 6) as spread from range(0, 5) r(n), {_PRIORS}")


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    docs = fixtures.documents(spark, d)
    by = docs.groupBy("source").agg(F.sum(T.tokens(F.col("text"))).alias("words"), F.sum(F.size(T.paragraphs(F.col("text"), 30))).cast("long").alias("paragraphs"))
    health = F.when((F.col("words") < 1200) | (F.col("paragraphs") < 8), "insufficient").when((F.col("words") < 2500) | (F.col("paragraphs") < 16), "weak").otherwise("ok")
    return by.withColumn("health", health)


_register("profile_evidence", _evidence, f"""with {sql.SPIKED}, b as (select source, sum({sql.tokens('text')})::bigint as words, sum(len({sql.paragraph_list('text', 30)}))::bigint as paragraphs from spiked group by source)
select source, words, paragraphs, case when words < 1200 or paragraphs < 8 then 'insufficient' when words < 2500 or paragraphs < 16 then 'weak' else 'ok' end as health from b""")


def _whole_evidence(spark: SparkSession, d: str) -> DataFrame:
    by = _evidence(spark, d).agg(F.sum("words").alias("words"), F.sum("paragraphs").alias("paragraphs"))
    health = F.when((F.col("words") < 1200) | (F.col("paragraphs") < 8), "insufficient").when((F.col("words") < 2500) | (F.col("paragraphs") < 16), "weak").otherwise("ok")
    return by.withColumn("health", health)


_register(
    "profile_report",
    lambda s, d: (lambda v: voice.profile_report(_whole_evidence(s, d), _model(s, d), v.where("profile = 0"), v.where("profile = 1")))(_vectors(s, d)),
    f"""with {sql.SPIKED}, {_AXES}, {_LOO}, {_KNN}, {_FLOORS}, b as (select sum({sql.tokens('text')})::bigint as words, sum(len({sql.paragraph_list('text', 30)}))::bigint as paragraphs from spiked),
h as (select *, case when words < 1200 or paragraphs < 8 then 'insufficient' when words < 2500 or paragraphs < 16 then 'weak' else 'ok' end as health from b)
select health, case health when 'insufficient' then 'Too little text to fit a voice.' when 'weak' then 'Little text: the fit is unsure.' end as warning, (select count(*) from e where profile = 0) as exemplars,
  (select count(*) from e where profile = 1) as contrast, words, paragraphs, round(floor, 6) as exemplar_floor, round(spread, 6) as exemplar_spread, round(ceiling, 6) as contrast_ceiling from h, floors""",
)
_register(
    "span_guidance",
    lambda s, d: voice.span_guidance(_drafts(s, d).join(_vectors(s, d).select("id", F.col("profile").alias("doc")), "id").select("doc", F.col("id").alias("i"), "distance"), _model(s, d)),
    f"""with {_AXES}, {_LOO}, {_KNN}, {_FLOORS}, r as (select profile as doc, id as i, distance, row_number() over (partition by profile order by round(distance, 9) desc, id) as place, count(*) over (partition by profile) as n from knn)
select doc, place, i, round(distance, 6) as distance, round((distance - floor) / spread, 6) as distance_z from r, floors where place <= 3 and n >= 2""",
)
_register("mixed_profile", lambda s, d: voice.mixed(_vectors(s, d).where("profile = 0")), None)


def _sign(spark: SparkSession, d: str) -> DataFrame:
    """The sign test over tells: exemplars are documents of y = 1, drafts those of y = 0. The tells are found once."""
    labelled = _named(_kept(_rated(spark, d)))
    rows = labelled.where("y is not null")
    names = sorted(f"tell_{n}" for n in tells.PLAIN)
    z = rows.join(F.broadcast(_norms(rows)), "name").select(F.col("doc_id").alias("id"), "name", "y", ((F.col("value") - F.col("mean")) / F.col("spread")).alias("z"))
    vectors = _kept(z.groupBy("id", "y").agg(F.transform(F.sort_array(F.collect_list(F.struct("name", "z"))), lambda x: x["z"]).alias("z")))
    return voice.sign_test(vectors.where("y = 0").select("id", "z"), vectors.where("y = 1").select("id", "z"), _direction(labelled), names)


_register("sign_test", _sign, None)


def _voice_report(spark: SparkSession, d: str) -> DataFrame:
    """Documents of quality 0 against those of quality 1, as JSON."""
    docs = fixtures.documents(spark, d)
    labels = spark.read.parquet(f"{d}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("y"))
    of = lambda y: docs.join(labels.where(F.col("y") == y), "doc_id", "left_semi")
    out = report.voice_report(of(0), of(1), of(0))
    return out.select("doc_id", *(F.to_json(c).alias(c) for c in ("direction", "markdown", "hedge", "fw")))


_register("voice_report", _voice_report, None)
