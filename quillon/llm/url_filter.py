"""URL filter: fixed rules first, then empirical-Bayes reputation of the host.

Labelled page outcomes (good or bad) are counted by host, registered domain and
suffix. Each level's good rate is shrunk through a beta-binomial prior towards
the level above it: suffixes towards the overall rate, domains towards their
suffix, hosts towards their domain. A prior's strength comes from the spread of
the rates at its level (method of moments). A host is blocked where the upper
bound of its posterior good rate lies under a floor, so that a host must have
shown itself bad, or lie in a domain or suffix that has.

Counts are pre-aggregated before each shuffle; what is joined back to the pages
has one row a host, and is broadcast only if counted to be small.

Defined results: a null url, or one without ``://``, has an empty host and path,
fits no rule and is judged by the posterior of the empty host. Pages without an
outcome count for nothing but get a verdict; repeated rows are each judged and
counted. Repeated outcomes of a page count once (bad if any is). Without any
outcome the overall rate is 1/2 and nothing is blocked but by rules. An empty
table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import checkpointed, sized

#: verdict, host with path prefix. A rule fits its host and all subdomains.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: Block where the posterior good rate's upper bound (mean + Z deviations) is under FLOOR.
FLOOR, Z = 0.5, 1.645
#: Bounds of a prior's strength, in pseudo-pages.
LEAST, MOST = 1.0, 1000.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url):
    """Columns host and path of a url column."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host, path, rules=RULES):
    """Columns rule and its verdict, of the longest rule that fits (of equal lengths the first listed); else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in reversed(sorted(rules, key=lambda r: -len(r[1]))):  # a later one overrides
        name, slash, rest = text.partition("/")
        fits = (F.concat(F.lit("."), host).endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def domain_of(host):
    """The last two labels of a host: its registered domain, for suffixes of one label."""
    return F.substring_index(host, ".", -2)


def suffix_of(host):
    return F.substring_index(host, ".", -1)


def strength(groups: DataFrame) -> DataFrame:
    """One row: the prior strength k that the spread of the rates good/n of the groups asks for."""
    seen = groups.where("n > 0").select(F.col("n").cast("double").alias("n"), F.col("good").cast("double").alias("y"))
    sums = seen.agg(
        F.sum("n").alias("s1"), F.sum(F.col("n") * F.col("n")).alias("s2"), F.sum("y").alias("sy"),
        F.sum(F.col("y") * F.col("y") / F.col("n")).alias("sq"), F.count(F.lit(1)).cast("double").alias("c"),
    )
    mean = F.col("sy") / F.col("s1")
    spread = F.col("sq") - F.col("sy") * F.col("sy") / F.col("s1")  # sum of n (y/n - mean)^2
    within = mean * (1 - mean)
    over, room = spread - within * (F.col("c") - 1), within * (F.col("s1") - F.col("s2") / F.col("s1") - (F.col("c") - 1))
    rho = F.when((over > 0) & (room > 0), over / room)
    k = F.when(rho.isNull(), F.lit(MOST)).otherwise(F.greatest(F.lit(LEAST), F.least(F.lit(MOST), 1 / rho - 1)))
    return sums.select(k.alias("k"))


def reputation(hosts: DataFrame) -> DataFrame:
    """host, n, good -> host, mean, upper: the posterior good rate and its upper bound.

    hosts has one row a host. The strengths are one row each, and so joined freely.
    """
    hosts = hosts.select("host", "n", "good", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    overall = suffixes.agg(((F.coalesce(F.sum("good"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1)).alias("m0"))

    def shrunk(level: DataFrame, above: str, out: str) -> DataFrame:
        of_level = level.select("n", "good")
        one = F.broadcast(strength(of_level))  # one row
        return level.crossJoin(one).withColumn(out, (F.col("k") * F.col(above) + F.col("good")) / (F.col("k") + F.col("n")))

    suffixes = shrunk(suffixes.crossJoin(F.broadcast(overall)), "m0", "m1").select("suffix", "m1")
    domains = shrunk(domains.join(suffixes, "suffix"), "m1", "m2").select("domain", "m2")
    judged = shrunk(hosts.join(domains, "domain"), "m2", "mean")
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("k") + F.col("n") + 1))
    return judged.select("host", "mean", (F.col("mean") + Z * deviation).alias("upper"))


def outcomes(labels: DataFrame) -> DataFrame:
    """page_id, good of rows doc_id, quality, toxic: bad are pages of quality 0 and toxic ones; null says nothing."""
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    known = labels.where("quality is not null or toxic is not null")
    return known.groupBy(F.col("doc_id").alias("page_id")).agg((1 - F.max(bad.cast("int"))).alias("good"))


def judge(pages: DataFrame, seen: DataFrame, rules=RULES, floor: float = FLOOR) -> DataFrame:
    """page_id, host, path, rule, verdict, good_rate, upper for each row of pages (page_id, url).

    seen: page_id, good (0 or 1), a row for each page with a known outcome.
    """
    host, path = split_url(F.col("url"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"))
    seen = seen.select("page_id", F.col("good").cast("long").alias("good"))
    hosts = pages.select("page_id", "host").join(seen, "page_id", "left").groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    found = pages.join(sized(checkpointed(reputation(checkpointed(hosts))), 100_000), "host", "left")
    own = F.when(F.col("upper") < floor, F.lit("block")).otherwise(F.lit("allow"))
    return found.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"),
        F.round("mean", 6).alias("good_rate"), F.round("upper", 6).alias("upper"),
    )
