"""Documents with the phenomena that the rules look for, built alike by Spark and by any SQL engine.

The driver's texts hardly have them, so each text gets blank lines between its
paragraphs and, by its id, one of SPIKES, one to three times. One id in seven
stays as it is. The expression is plain SQL, the same for both engines: ^ stands
for an apostrophe, | for a line feed and ~ for a backslash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPIKES = (
    "We delve into a robust — seamless — design, and the tapestry is pivotal.",
    "It^s not just fast, it^s fearless. Not only small but also quick.",
    "Let^s dive in. When it comes to tests, it^s worth noting the cost.",
    "In conclusion, the plan holds. To sum up, the future looks bright.",
    "Great question! I hope this helps. Absolutely! Let me know if it breaks.",
    "In order to win, due to the fact that it rained, we left.",
    "At its core, the real question is cost. At the end of the day we pay.",
    "Which brings me to the point. Bear with me. No wonder it failed.",
    "I want to be careful. Read this as a note and not as proof. I could be wrong.",
    "We build, test, and ship. Red, green, and blue win.",
    "||Honestly, it works. Look, it runs. Picture this: calm seas.",
    "||- **Speed:** it runs.|**Size:** it fits.",
    "He said \"stop,\" and \"go.\" Then nothing.",
    "The build has three stages: compile, link, and run. It has parts: a, b, c.",
    "Nice 😀🚀 work ✨ here. “Curly” quotes aren’t straight.",
    "||---||***||___||",
    "||Our objective was to measure it. The method and the dataset matter.",
    "||We ask whether the model fits. The problem remains unclear. However, more research is needed.",
    "||The NATO plan and the XYZ list. The World Health Organization (WHO) met. WHO spoke. DNA too.",
    "||We perform tests, conduct trials, provide data, implement code and evaluate outcomes to facilitate growth.",
    "||It gave 1.5, 2.5, 3.5, 4.5, 5.5 and 60% and 7 % in all.",
    "||The key is care. What matters here is time. Its value lies in use. The trick is patience.",
    "||The result is plain: it fails. This shows growth. It is late. There are gaps. They may stay.",
    "||This proves a novel, state-of-the-art claim. It outperforms all. It proves more.",
    "||It is important to note that it may possibly rain. Needless to say, it could potentially snow.",
    "||We utilize numerous approximately additional sufficient methodology. An extraordinary hippopotamus deliberately vegetated.",
    "||Smith (2003) found a gap. ~citet{key} showed one. We found that it holds. This paper argues that it fails.",
    "||The effect was significant, p < 0.05 here. The effect was significant by 5 percent.",
    "||The end of the day of the year of the king of the hill was near.",
    "||# Usage notes|text `code here` and [link](scripts/run.sh) or [^1] and ![img](a.png)|## When to use|1. one|2. two|- three|* four|> quoted",
    "||```py|x = 1|```|after ~~~ and <!-- note --> <b>bold</b> x < 3 **strong** __under__ ~~gone~~ references/a.md",
    "|| a | b ||| --- | --- ||| 1 | 2 |||[^2]: a note",
    "||Do: run it.|Don^t: skip it.|✅ tests pass. See also the file. Refer to it. ALWAYS run. NEVER skip. You and your team must.",
    "||We do not claim it. We might perhaps think of course it is certainly a world-class groundbreaking result because if not, then no.",
    "||~section{Intro} ~cite{a} text ~begin{itemize}~item one~end{itemize} ~noindent more ~begin{figure}x~end{figure} tail",
    "||edited by: someone||Keywords: a, b||Figure 1 shows it||mail me@example.org now||All Rights Reserved",
    "||Short one. It ran. It fell. It rose. It was an agent. Then a very long sentence with many more words than the eight, with commas, and more, and more, and so on until it ends here.",
    "||The normalisation normalises what a reference says. One reference follows another reference here.",
    "||The test was reviewed. The code was finished. The plan was changed. The work was completed. The rest was dropped. The list was cleaned.",
    "||The answer is thin. Runs badly now. The idea has weight. Makes sense.",
)


def _literal(spike: str) -> str:
    text = spike.replace("'", "^").replace("~~~", "\x01").replace("~~", "\x02")
    return f"replace(replace(replace(replace(replace('{text}', '^', chr(39)), '|', chr(10)), '~', chr(92)), chr(1), '~~~'), chr(2), '~~')"


def spiked_sql(text: str = "text", doc_id: str = "doc_id") -> str:
    """The expression of a spiked text."""
    arms = " ".join(f"when {i} then {_literal(s)}" for i, s in enumerate(SPIKES))
    spike = f"repeat(concat(' ', case {doc_id} % {len(SPIKES)} {arms} else '' end), cast(1 + {doc_id} % 3 as int))"
    paragraphs = f"replace(coalesce({text}, ''), chr(10), concat(chr(10), chr(10)))"
    front = f"case when {doc_id} % 11 = 3 then concat('---', chr(10), 'name: draft-', cast({doc_id} as varchar(20)), chr(10), 'description: use this when any or all fail', chr(10), '---', chr(10)) else '' end"
    return f"concat({front}, {paragraphs}, case when {doc_id} % 7 = 6 then '' else {spike} end)"


def spread(docs: DataFrame) -> DataFrame:
    """docs, dealt to all cores where a small file would leave most of them without work."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores, "doc_id") if docs.rdd.getNumPartitions() < cores else docs


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text (spiked), lang, source."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))
    return docs.select("doc_id", F.expr(spiked_sql()).alias("text"), "lang", "source")


#: Frequencies as of a corpus a thousand times as large in which these words are no more frequent: a stand-in, so that rare words exist.
SCARCER = 3.0


def frequencies(docs: DataFrame) -> DataFrame:
    """word, zipf: a stand-in for a table of word frequencies, made of the documents themselves."""
    from quillon.operators import lexical

    return lexical.zipf(docs).select("word", (F.col("zipf") - SCARCER).alias("zipf"))


def norms(docs: DataFrame) -> DataFrame:
    """lemma, concreteness: a stand-in for rated norms, a number from 1 to 5 made of the word's letters."""
    from quillon.operators import lexical

    return lexical.zipf(docs).select(F.col("word").alias("lemma"), (1 + F.crc32("word") % 401 / 100.0).alias("concreteness"))


SPIKED = f"spiked as (select doc_id, {spiked_sql()} as text, lang, source from documents)"
