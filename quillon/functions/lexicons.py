"""Word lists as parameters, with the short ones stated here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Words and phrases that are counted.
HEDGES = (
    "about", "almost", "apparent", "apparently", "appear", "appeared", "appears", "approximately", "argue", "argued",
    "argues", "around", "assume", "broadly", "claim", "claimed", "claims", "could", "couldn't", "doubt", "doubtful",
    "essentially", "estimate", "estimated", "fairly", "feel", "feels", "felt", "generally", "guess", "indicate",
    "indicated", "indicates", "largely", "likely", "mainly", "may", "maybe", "might", "mostly", "often", "ought",
    "perhaps", "plausible", "plausibly", "possible", "possibly", "postulate", "postulated", "postulates", "presumable",
    "presumably", "probable", "probably", "quite", "rather", "relatively", "roughly", "seems", "should", "sometimes",
    "somewhat", "suggest", "suggested", "suggests", "suppose", "supposed", "supposes", "suspect", "suspects", "tend to",
    "tended to", "tends to", "typical", "typically", "uncertain", "uncertainly", "unclear", "unclearly", "unlikely",
    "usually", "would", "wouldn't",
)
BOOSTERS = (
    "actually", "always", "believe", "believed", "believes", "certain", "certainly", "clear", "clearly", "conclusively",
    "decidedly", "definite", "definitely", "demonstrate", "demonstrated", "demonstrates", "doubtless", "establish",
    "established", "evident", "evidently", "find", "finds", "found", "incontestable", "incontestably",
    "incontrovertible", "incontrovertibly", "indeed", "indisputable", "indisputably", "know", "known", "must", "never",
    "obvious", "obviously", "prove", "proved", "proves", "realize", "realized", "realizes", "really", "show", "showed",
    "shown", "shows", "sure", "surely", "think", "thinks", "thought", "truly", "true", "undeniable", "undeniably",
    "undisputedly", "undoubtedly",
)
NEGATIONS = (
    "no", "not", "never", "none", "nothing", "nobody", "nowhere", "neither", "nor", "cannot", "can't", "won't", "don't",
    "doesn't", "didn't", "isn't", "aren't", "wasn't", "weren't", "without",
)
CONDITIONALS = (
    "if", "then", "else", "unless", "otherwise", "whenever", "whereas", "therefore", "thus", "hence", "because", "so that",
    "in order to", "either", "provided that",
)
HYPE = (
    "acclaimed", "award-winning", "brilliant", "celebrated", "cutting-edge", "extraordinary", "iconic", "landmark",
    "legendary", "outstanding", "pioneering", "remarkable", "renowned", "virtuoso", "visionary", "world-class",
    "distinguished", "exceptional", "eminent", "illustrious", "esteemed", "revered", "peerless", "unparalleled",
    "unrivaled", "unmatched", "unsurpassed", "trailblazing", "groundbreaking", "transformative", "seminal", "defining",
    "premier", "elite", "top-tier", "first-rate", "world-renowned", "critically acclaimed", "highly regarded",
    "internationally acclaimed", "masterful", "stellar", "exemplary", "influential", "prestigious", "flagship",
    "benchmark", "definitive", "enduring", "timeless",
)
HEDGE_METRIC = (
    "may", "might", "could", "perhaps", "possibly", "seem", "appear", "suggest", "arguably", "somewhat", "fairly",
    "relatively", "likely", "presumably", "roughly", "i think", "i believe",
)
BOOSTER_METRIC = (
    "clearly", "obviously", "certainly", "definitely", "undoubtedly", "always", "never", "indeed", "must", "of course",
    "in fact", "without doubt",
)
LEXICONS = {"hedge": HEDGES, "booster": BOOSTERS, "negation": NEGATIONS, "conditional": CONDITIONALS, "hype": HYPE}
# Closed classes of English, for the rates of function words.
FIRST_PERSON = ("i", "me", "myself", "mine")
ARTICLES = ("a", "an", "the")
PREPOSITIONS = (
    "about", "above", "across", "after", "against", "along", "among", "around", "at", "before", "behind", "below", "beneath",
    "beside", "between", "beyond", "by", "despite", "during", "except", "for", "from", "in", "inside", "into", "like",
    "near", "of", "off", "on", "onto", "out", "outside", "over", "past", "per", "through", "throughout", "to", "toward",
    "towards", "under", "until", "up", "upon", "via", "with", "within", "without",
)
CONJUNCTIONS = (
    "and", "but", "or", "nor", "yet", "so", "because", "although", "though", "if", "unless", "while", "whereas", "since",
    "whether", "that", "than", "as", "once",
)
PRONOUNS = (
    "i", "me", "myself", "mine", "you", "yours", "yourself", "he", "him", "himself", "she", "her", "hers", "herself", "it",
    "itself", "we", "us", "ourselves", "ours", "they", "them", "themselves", "theirs", "this", "these", "those", "who",
    "whom", "which", "what", "someone", "something", "anyone", "anything", "everyone", "everything", "nothing", "nobody",
)


def read(spark: SparkSession, path: str) -> DataFrame:
    """entry, replacement (null in plain lists) of a word list: a line an entry, tab, replacement; # starts a comment."""
    rows = spark.read.text(path).where("trim(value) <> '' and value not like '#%'")
    parts = F.split("value", "\t")
    return rows.select(F.lower(F.trim(parts[0])).alias("entry"), F.trim(F.get(parts, F.lit(1))).alias("replacement"))
