"""Regular expressions, each stated once and written for the engine that runs it.

In Spark every pattern carries (?dU...): only a line feed ends a line, and
\\w, \\b and \\s know Unicode. `re2` is the same pattern for engines with RE2 syntax.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Pattern(NamedTuple):
    regex: str
    flags: str = ""

    @property
    def java(self) -> str:
        return f"(?dU{self.flags}){self.regex}"

    @property
    def re2(self) -> str:
        return f"(?{self.flags}){self.regex}" if self.flags else self.regex

    @property
    def loose(self) -> str:
        """For RE2, where a pattern is made of literals, classes, \\b, \\s and \\w outside of classes: found wherever `java` is, and in more texts.

        Without borders and counts up to a bound; white space is all but printable ASCII, and a word's character any beyond
        ASCII. Java takes two more letters for an i.
        """
        regex = self.regex.replace(r"\b", "").replace(r"\s", "[^!-~]").replace(r"\w", r"[\w\x{80}-\x{10FFFF}]")
        regex = re.sub(r"\{1,\d+\}", "+", regex)
        if "i" in self.flags:
            regex = regex.replace("i", "[iıİ]")
        return f"(?{self.flags}){regex}" if self.flags else regex


WORD = Pattern(r"[\p{L}\p{N}_]+")
NON_SPACE = Pattern(r"\S+")

# The markers of formulaic prose. Each match counts.
TELLS: dict[str, Pattern] = {
    "dash": Pattern("[—–]"),
    "diction": Pattern(
        r"\b(?:delve|tapestry|leverage|landscape|realm|testament|boasts?|nestled|vibrant|showcas(?:e|es|ing|ed)|"
        r"underscor(?:e|es|ing|ed)|pivotal|intricate|robust|comprehensive|nuanced|elevat(?:e|es|ing|ed)|"
        r"unleash(?:es|ing|ed)?|unlock(?:s|ing|ed)?|navigat(?:e|es|ing|ed)|foster(?:s|ing|ed)?|myriad|seamless(?:ly)?|"
        r"game[- ]?changer|ever[- ]evolving|ever[- ]changing|revolutioniz(?:e|es|ing|ed)|transformative|"
        r"utiliz(?:e|es|ing|ed)|embark|harness(?:es|ing|ed)?|paramount|plethora|bustling)\b",
        "i",
    ),
    "not_x_y": Pattern(
        r"\bit'?s not (?:just |only |merely |simply )?[^,.;:]{1,50}[,;] (?:it'?s|but)\b"
        r"|\bnot only\b[^.?!]{1,60}\bbut also\b|\bnot just\b[^.?!]{1,50}\bbut\b",
        "i",
    ),
    "signpost": Pattern(
        r"\b(?:let'?s dive in|deep dive|dive into|when it comes to|in today'?s (?:fast[- ]paced |digital )?world|"
        r"it'?s (?:important|worth) (?:to note|noting)|needless to say|here'?s what you need to know|in the realm of)\b",
        "i",
    ),
    "conclusion": Pattern(
        r"\b(?:in conclusion|in summary|to sum up|to wrap up|the future looks bright|exciting times (?:lie ahead|ahead))\b", "i"
    ),
    "sycophancy": Pattern(
        r"\b(?:great question|i hope this helps|hope this helps|let me know if|happy to help|glad to help|"
        r"would you like me to|should i continue)\b|\b(?:absolutely|certainly)!",
        "i",
    ),
    "filler": Pattern(r"\b(?:in order to|due to the fact that|at this point in time|for all intents and purposes|it goes without saying)\b", "i"),
    "aphorism": Pattern(r"\b(?:at its core|the real question is|what really matters|at the end of the day|the key takeaway)\b", "i"),
    "self_narration": Pattern(
        r"\b(?:worth (?:stating|saying) plainly|no wonder|here the story|the story (?:stops|starts|keeps|picks up)|"
        r"the thread (?:i|we) (?:pull|pick up|follow)|which brings (?:me|us) to|let me back up|"
        r"before we (?:go|move on|continue)|as (?:i|we) (?:said|noted|mentioned) (?:above|earlier|before)|"
        r"more on (?:that|this) later|we'?ll (?:come back|return) to (?:that|this)|bear with me|stay with me)\b",
        "i",
    ),
    "apologetic": Pattern(
        r"\bi want to be careful\b|\bwhat i cannot (?:do|say|tell|claim|prove)\b|\bread this as\b[^.?!]{1,60}\bnot as\b"
        r"|\bi don'?t want to overstate\b|\b(?:please )?don'?t read this as\b|\bthis is not to say\b|\bi could be wrong\b"
        r"|\bfor what it'?s worth\b|\btake this with a grain of salt\b",
        "i",
    ),
    "rule_of_three": Pattern(r"\b\w+,\s+\w+,\s+and\s+\w+\b"),
    "emoji": Pattern(r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}]"),
    "curly_quote": Pattern("[“”‘’]"),
    "bold_leadin": Pattern(r"^\s*(?:[-*+]\s+)?\*\*[^*\n]{1,40}\*\*\s*[:—-]", "m"),
    "hr_divider": Pattern(r"^(?:-{3,}|\*{3,}|_{3,})\s*$", "m"),
    "rhetorical_opener": Pattern(
        r"(?:^|[.?!]\s+)(?:Honestly|Look|Here'?s the thing|Let'?s be honest|Let'?s face it|Picture this|Imagine this)\b"
    ),
    "quote_punct": Pattern(r'[,.]"'),
    "colon_list": Pattern(r":\s*[^:.!?\n]+,\s*[^:.!?\n]+(?:,\s*[^:.!?\n]+)*[.!?]"),
}
#: Tells found from tokens, after the others in reports.
TOKEN_TELLS = ("empty_punch", "dropped_subject", "staccato_run")

# Label, report dimension and prior weight of each tell, in report order.
TELL_META: dict[str, tuple[str, str, float]] = {
    "dash": ("em/en dashes", "formatting", 0.70),
    "diction": ("AI-tell diction (delve, tapestry, leverage, …)", "diction", 0.50),
    "not_x_y": ('"it\'s not X, it\'s Y" / "not only … but also" constructions', "construction", 0.55),
    "signpost": ("signposting phrases (dive in, when it comes to, …)", "construction", 0.35),
    "conclusion": ("wrap-up phrases (in conclusion, the future looks bright)", "construction", 0.30),
    "sycophancy": ("sycophantic / collaborative filler (great question, hope this helps)", "construction", 0.40),
    "filler": ("filler phrases (in order to, due to the fact that)", "diction", 0.25),
    "aphorism": ("authority-trope aphorisms (at its core, the real question is)", "diction", 0.25),
    "self_narration": ("essay self-narration / meta-framing (which brings us to, here the story stops)", "construction", 0.25),
    "apologetic": ("apologetic / over-hedged stance (I want to be careful, what I cannot do, read this as X not Y)", "construction", 0.25),
    "rule_of_three": ("rule-of-three triads", "diction", 0.25),
    "emoji": ("emoji", "formatting", 0.30),
    "curly_quote": ("curly quotation marks", "formatting", 0.20),
    "bold_leadin": ("bold lead-in bullets (**Word:** …)", "formatting", 0.25),
    "hr_divider": ("--- section dividers", "formatting", 0.35),
    "rhetorical_opener": ("conversational openers (Honestly, Look, Here's the thing)", "construction", 0.30),
    "quote_punct": ("American-style punctuation inside closing quotes", "formatting", 0.25),
    "colon_list": ("colon-then-list construction (sentence: a, b, c)", "formatting", 0.22),
    "empty_punch": ("contentless opening fragment (e.g. 'The answer is thin.')", "rhythm", 0.30),
    "dropped_subject": ("dropped-subject opener (bare finite verb, no subject)", "rhythm", 0.35),
    "staccato_run": ("staccato run (3+ consecutive sentences under 8 words)", "rhythm", 0.30),
}

# What stands before and after the text of a Project Gutenberg book.
BOOK: tuple[tuple[Pattern, str], ...] = (
    (Pattern(r"\A.*?\*\*\*\s*START OF (?:THE|THIS) PROJECT GUTENBERG EBOOK.*?\*\*\*", "is"), ""),
    (Pattern(r"\*\*\*\s*END OF (?:THE|THIS) PROJECT GUTENBERG EBOOK.*\z", "is"), ""),
)

# Markup, in the order in which it is taken away, with what replaces a match ($1: its first group).
FRONTMATTER_STRICT = Pattern(r"\A---\n.*?\n---\n", "s")
FRONTMATTER = Pattern(r"\A---[ \t]*\n.*?\n---[ \t]*\n?", "s")
FENCE = Pattern(r"```.*?```|~~~.*?~~~", "s")
MARKUP: dict[str, tuple[Pattern, str]] = {
    "strip_frontmatter": (FRONTMATTER, ""),
    "strip_fence": (FENCE, ""),
    "strip_html_comment": (Pattern(r"<!--.*?-->", "s"), ""),
    "strip_inline_code": (Pattern(r"`[^`\n]+`"), ""),
    "strip_html_tag": (Pattern(r"</?[a-zA-Z!][^>]*>"), ""),
    "strip_image": (Pattern(r"!\[[^\]]*\]\([^)]*\)"), ""),
    "unwrap_link": (Pattern(r"\[([^\]]*)\]\(([^)]*)\)"), "$1"),
    "strip_footnote_def": (Pattern(r"^[ \t]*\[\^[^\]]+\]:[ \t]*", "m"), ""),
    "strip_footnote_ref": (Pattern(r"\[\^[^\]]+\]"), ""),
    "strip_heading": (Pattern(r"^[ \t]*#{1,6}[ \t]+.*$\n?", "m"), ""),
    "unwrap_quote": (Pattern(r"^[ \t]*>+[ \t]?", "m"), ""),
    "unwrap_bullet_list": (Pattern(r"^[ \t]*[-*+][ \t]+", "m"), ""),
    "unwrap_ordered_list": (Pattern(r"^[ \t]*\d+\.[ \t]+", "m"), ""),
    "unwrap_bold_star": (Pattern(r"\*\*(.+?)\*\*", "s"), "$1"),
    "unwrap_bold_underscore": (Pattern(r"__(.+?)__", "s"), "$1"),
    "unwrap_strike": (Pattern(r"~~(.+?)~~", "s"), "$1"),
    "unwrap_italic_star": (Pattern(r"(?<![\w*])\*(?!\s)([^*\n]+?)(?<!\s)\*(?![\w*])"), "$1"),
    "unwrap_italic_underscore": (Pattern(r"(?<![\w_])_(?!\s)([^_\n]+?)(?<!\s)_(?![\w_])"), "$1"),
    "strip_table_separator": (Pattern(r"^[ \t]*:?-{2,}:?(?:[ \t]*\|[ \t]*:?-{2,}:?)+[ \t]*$\n?", "m"), ""),
    "strip_table_row": (Pattern(r"^[ \t]*\|.*\|[ \t]*$\n?", "m"), ""),
    "trim_lines": (Pattern(r"[ \t]+$", "m"), ""),
    "collapse_blank_lines": (Pattern(r"\n{3,}"), "\n\n"),
}

# Clean-up of extracted text, in order.
CLEAN: list[tuple[Pattern, str]] = [
    (Pattern(r"\r\n?"), "\n"),
    (Pattern(r"\x0c"), "\n"),
    (Pattern(r"\x{00AD}"), ""),
    (Pattern(r"([A-Za-z])-\n([a-z])"), "$1$2"),
    (Pattern(r"\n{3,}"), "\n\n"),
    (Pattern(r"\s+([,.;:?!])"), "$1"),
    (Pattern(r"\(\s+"), "("),
    (Pattern(r"\s+\)"), ")"),
]

# LaTeX source.
LATEX_MARK = Pattern(
    r"\\begin\{|\\end\{|\\section\*?\{|\\subsection\*?\{|\\title\{|\\author\{|\\cite\{|\\ref\{|\\label\{|\\documentclass"
)
LATEX_ENVIRONMENTS = (
    "tikzpicture", "figure", "figure*", "table", "table*", "tabular", "tabularx", "equation", "equation*", "align",
    "align*", "aligned", "lstlisting", "minted", "verbatim", "thebibliography",
)
LATEX_NOISE: list[tuple[Pattern, str]] = [
    (Pattern(r"^\s*%.*$", "m"), ""),
    *(
        (Pattern(rf"\\begin\{{{e.replace('*', '[*]')}\}}.*?\\end\{{{e.replace('*', '[*]')}\}}", "s"), "\n")
        for e in LATEX_ENVIRONMENTS
    ),
    (
        Pattern(
            r"\\(?:label|ref|eqref|autoref|cref|Cref|pageref|cite|citet|citep|citealt|citealp|footnote)\*?(?:\[[^\]]*\])?\{[^}]*\}"
        ),
        " ",
    ),
    (Pattern(r"\\(?:begin|end)\{(?:itemize|enumerate|description)\}"), "\n"),
    (Pattern(r"\\item(?:\[[^\]]*\])?"), "\n- "),
    (Pattern(r"\\(?:centering|smallskip|medskip|bigskip|noindent|vspace\*?|hspace\*?)\{[^}]*\}"), " "),
    (Pattern(r"\\(?:centering|smallskip|medskip|bigskip|noindent)"), " "),
]
DETEX: list[tuple[Pattern, str]] = [
    (Pattern(r"\r\n?"), "\n"),
    (Pattern(r"\.abstract\b", "i"), "."),
    (Pattern(r"^abstract\s*", "i"), "Abstract\n\n"),
    (Pattern(r"\b(?:sub)*section([A-Z])"), "\n\n$1"),
    (Pattern(r"\b(?:cite|ref|label)[A-Za-z0-9:_-]*\b"), " "),
    (Pattern(r"\n{3,}"), "\n\n"),
    (Pattern(r"[ \t]+"), " "),
]

# Patterns of the writing rules.
RULES: dict[str, Pattern] = {
    "citation": Pattern(r"\([A-Z][A-Za-z-]+(?: et al\.)?,? \d{4}\)|\[\d+\]"),
    "fuzzy": Pattern(r"\b(?:affect|facilitate|occur|perform|conduct|implement|provide|utilize|evaluate|examine)\w*\b", "i"),
    "nominal": Pattern(r"\b\w+(?:tion|sion|ment|ance|ence|ity|ness)\b", "i"),
    "acronym": Pattern(r"\b[A-Z]{2,}\b"),
    "problem": Pattern(r"\b(?:challenge|problem|question|unknown|unclear|important|critical|controls?|drives?|limits?|affects?)\b", "i"),
    "method": Pattern(
        r"\b(?:method|methods|measured|measures?|dataset|datasets|algorithm|algorithms|model|models|experiment|experiments)\b", "i"
    ),
    "weak_end": Pattern(r"\b(?:more research is needed|future work is needed|may provide insights|could be important)\b", "i"),
    "objective": Pattern(r"\bour objective(?:s)? (?:was|were|is|are)\b", "i"),
    "challenge": Pattern(
        r"\b(?:we (?:ask|test|hypothesi[sz]e|predict)|our (?:question|hypothesis)|remains unclear|unknown|knowledge gap|"
        r"objective(?:s)? (?:was|were|is|are)|to determine|to test whether|whether)\b",
        "i",
    ),
    "hedge_close": Pattern(
        r"\b(?:however|although|though|nonetheless|nevertheless|admittedly|unfortunately|caveat|limitation|"
        r"we do not (?:claim|argue)|we make no|we cannot|does not (?:claim|establish|prove)|no\b[^.]{0,30}\bsuperiority|"
        r"rather than (?:a|an|evidence)|to be fair|falls short|is not (?:more|better|a stronger))\b",
        "i",
    ),
    "coy": Pattern(
        r"\b(?:its value (?:is|lies)\b|the (?:real )?(?:key|point|answer|crux|value) (?:is|lies|here is)\b|"
        r"what (?:really )?matters (?:is|here)\b|the answer lies\b|the trick is\b|the magic (?:is|happens)\b)",
        "i",
    ),
    "statistic": Pattern(r"\d+\.\d+|\d+\s?%"),
    "appositive_colon": Pattern(r"[a-z]{3,}: [a-z]"),
    "orphan_start": Pattern(
        r"^(?:This|These|That|It|They)\s+(?:is|are|was|were|will|would|can|could|may|might|has|have|had|does|do|did|"
        r"shows?|means?|makes?|gives?|provides?|suggests?|implies|allows?|enables?|leads?|results?|reflects?|captures?|"
        r"measures?|remains?|becomes?)\b"
    ),
    "overclaim": Pattern(
        r"\b(?:proves?|proven|establishes?|novel|state[- ]of[- ]the[- ]art|outperforms?|validate[ds]?|load[- ]bearing|"
        r"unprecedented|definitive)\b",
        "i",
    ),
    "deadwood": Pattern(
        r"\b(?:it is important to note that|it should be noted that|it is worth noting that|needless to say|"
        r"as a matter of fact|for all intents and purposes|may possibly|might perhaps|could potentially|somewhat suggests?)\b",
        "i",
    ),
    "citation_subject": Pattern(
        r"(?:\\citet\{[^}]*\}|[A-Z][A-Za-z]+(?: et al\.?| and [A-Z][A-Za-z]+)?\s*\(\d{4}\))\s+"
        r"(?:found|shows?|showed|shown|reports?|reported|observes?|observed|demonstrates?|demonstrated|argues?|argued|notes?|"
        r"noted|proposes?|proposed|suggests?|suggested|concludes?|concluded|claims?|claimed|establish(?:es|ed)?|reveals?|"
        r"revealed|finds?)\b"
    ),
    "metadiscourse": Pattern(
        r"\b(?:we|this (?:study|paper|work|analysis)|our (?:results?|data|analysis|experiments?))\s+"
        r"(?:found|shows?|showed|shown|reports?|reported|observes?|observed|demonstrates?|demonstrated|argues?|argued|notes?|"
        r"noted|proposes?|proposed|suggests?|suggested|concludes?|concluded|claims?|claimed|establish(?:es|ed)?|reveals?|"
        r"revealed|finds?)\s+that\b",
        "i",
    ),
    "expletive": Pattern(
        r"^(?:There\s+(?:is|are|was|were|has|have|exists?|remains?|seems?|appears?)|"
        r"It\s+(?:is|was|has been|seems?|appears?|turns out))\b",
        "i",
    ),
    "significant": Pattern(r"\bsignificantly?\b|\bp\s*[<=>]\s*0?\.\d+", "i"),
    "magnitude": Pattern(
        r"%|[×x]\b|\bfold\b|\btimes\b|\bfactor\b|\bpercent\b|\bpoints?\b|\d+\s*(?:mm|cm|km|kg|mg|ms|Hz|days?|years?|hours?)\b", "i"
    ),
    "of_chain": Pattern(r"\bof\b(?:\s+\S+){1,4}\s+\bof\b(?:\s+\S+){1,4}\s+\bof\b", "i"),
}
ACRONYMS_KNOWN = ("DNA", "RNA", "CO2", "NLP", "AI", "LLM", "OCAR", "SUCCES", "NIH", "NSF")
# Long words with a plain one, in the order in which they are tried.
PLAIN_WORDS = {
    "utilize": "use", "utilise": "use", "facilitate": "help", "demonstrate": "show", "sufficient": "enough",
    "additional": "more", "approximately": "about", "commence": "start", "terminate": "end", "methodology": "method",
    "numerous": "many", "obtain": "get", "initiate": "start", "endeavor": "try", "endeavour": "try",
    "ascertain": "find out", "necessitate": "need", "subsequently": "then", "predominantly": "mostly",
    "utilization": "use", "modification": "change",
}

# Structure of raw markup.
HEADING = Pattern(r"^[ \t]*(#{1,6})[ \t]+.*$", "m")
TABLE_SEPARATOR = Pattern(r"^[ \t]*:?-{2,}:?(?:[ \t]*\|[ \t]*:?-{2,}:?)+[ \t]*$", "m")
BULLET_LINE = Pattern(r"^[ \t]*[-*+][ \t]+")
ORDERED_LINE = Pattern(r"^[ \t]*\d+\.[ \t]+")
INLINE_CODE = Pattern(r"`([^`\n]+)`")
LINK = Pattern(r"\[(.*?)\]\((.*?)\)")
EXTERNAL_REF = Pattern(r"(?:scripts/|references/|assets/)[^\s)\]]*")
NAMED_SECTION = Pattern(r"^[ \t]*#{1,6}[ \t]+.*(?:examples|guidelines|when to use|procedure|pitfalls|usage|instructions).*$", "im")
CONTRASTIVE = Pattern(r"^\s*(?:(?:do|don'?t|correct|incorrect|good|bad)\s*:|[✅❌✓✗])", "i")
CROSS_REFERENCE = Pattern(r"\b(?:see also|see below|see above|refer to|as described in|cf\.)", "i")
WHEN_CLAUSE = Pattern(r"\b(when|use (this|it) (when|for|to)|whenever|if you)\b", "i")
WILDCARD = Pattern(r"\b(any|all|every|always|whenever|anything|everything)\b", "i")
DIRECTIVES = ("ALWAYS", "NEVER", "MUST", "NOT", "DON'T", "DO")
SECOND_PERSON = ("you", "your", "yours", "you're", "yourself")

# Prefixes of lines that are a paper's metadata.
METADATA_PREFIXES = (
    "edited by:", "reviewed by:", "correspondence:", "*correspondence:", "current address:", "keywords:", "contents",
    "manuscript received", "for reprints", "downloaded from", "reports", "appendix", "index",
)
NOT_PROSE_PREFIXES = (
    "figure ", "fig. ", "table ", "keywords:", "contents", "permission to make", "proceedings of", "pages ", "reports ",
)
PAPER_HEADING = Pattern(r"^(?:\d+(?:\.\d+)*)?\s*[A-Z][A-Za-z0-9\-&,/() ]{1,80}$")
