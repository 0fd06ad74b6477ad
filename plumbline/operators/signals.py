"""Detect-only signals: named findings that never enter a score.

A rule is (id, confidence, condition); the rules of a module are evaluated over columns that are computed
once for each text, and what fires becomes rows. The pattern and word tables are fixed values.
"""

from __future__ import annotations

from plumbline.functions import expressions as E
from plumbline.functions.dialect import Spark
from plumbline.operators import measures
from plumbline.operators.matching import seeded
from plumbline.plans.catalog import operator

Rule = tuple[str, float, str]


def fire(q: Spark, rules: list[Rule], source: str = "p", key: str = "doc_id") -> str:
    """CTEs fired0, fired: (key, signal_id, confidence)."""
    ids = q.filter(q.array(*(f"CASE WHEN {c} THEN '{i}' END" for i, _, c in rules)), "x", "x IS NOT NULL")
    conf = "CASE signal_id " + " ".join(f"WHEN '{i}' THEN {c}" for i, c, _ in rules) + " END"
    return f"fired0 AS (SELECT {key}, {ids} AS ids FROM {source}), fired1 AS ({q.explode(key, 'fired0', 'ids', 'pos', 'signal_id')}), fired AS (SELECT {key}, signal_id, cast({conf} AS DOUBLE) AS confidence FROM fired1)"


def src(q: Spark, seeds: list[str], more: str = "", table: str = "documents", text: str = "text", key: str = "doc_id") -> str:
    """CTE p: t, lo (lower case) and what `more` adds, over seeded text."""
    t = seeded(q, seeds, text) if seeds else f"coalesce({text}, '')"
    return f"WITH s0 AS (SELECT {key}, {t} AS t FROM {table}), s1 AS (SELECT *, lower(t) AS lo, {q.size(E.white_words(q, 't'))} AS nw FROM s0), p AS (SELECT *{', ' + more if more else ''} FROM s1)"


def any_of(q: Spark, x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q.lit(w)})" for w in words) + ")"


def distinct_of(q: Spark, x: str, words: list[str]) -> str:
    return "(" + " + ".join(f"CASE WHEN contains({x}, {q.lit(w)}) THEN 1 ELSE 0 END" for w in words) + ")"


def total_of(q: Spark, x: str, patterns: list[str]) -> str:
    return "(" + " + ".join(q.count(x, p) for p in patterns) + ")"


def has_any(q: Spark, x: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(q.has(x, p) for p in patterns) + ")"


def gated(q: Spark, patterns: list[str], words: list[list[str]]) -> str:
    """Whether a pattern matches t, looked for where lo holds one of its words only."""
    return "(" + " OR ".join(f"({any_of(q, 'lo', w)} AND {q.has('t', p)})" for p, w in zip(patterns, words, strict=True)) + ")"


def findings(q: Spark, seeds: list[str], rules: list[Rule], more: str = "", **kw) -> str:
    key = kw.get("key", "doc_id")
    return f"{src(q, seeds, more, **kw)}, {fire(q, rules, key=key)} SELECT {key}, signal_id, confidence FROM fired"


B, NB = r"(?:^|[^\p{L}\p{M}\p{N}_])", r"(?:$|[^\p{L}\p{M}\p{N}_])"

# --- rhetorical -----------------------------------------------------------------------------------
# Fixed values.
BINARY_CONTRAST = [r"(?i)(?:it'?s|it is|this is|that'?s|they'?re)\s+not\s+[^.?!]{2,60}?[.,]\s+(?:it'?s|it is|they'?re)" + NB, r"(?i)" + B + r"not\s+just\s+[^.?!,]{2,50}?\s+but\s+", r"(?i)" + B + r"the\s+(?:question|point|problem|issue|goal)\s+(?:isn'?t|is not|wasn'?t)[^.?!]{2,60}?[.,]?\s+it'?s" + NB, r"(?i)[\p{L}\p{N}_]+\s+isn'?t\s+just\s+[^.?!]{2,60}?\s+[—–-]\s*it'?s" + NB, r"(?i)" + B + r"no\s+longer\s+[^.?!]{2,60}?,\s+now" + NB, r"(?i)" + B + r"gone\s+are\s+the\s+days\s+(?:of\s+)?[^.?!]{2,60}?\s+replaced\s+by" + NB]
SUPERFICIAL = r"(?i),\s+(?:highlighting|underscoring|reflecting|showcasing|emphasizing|emphasising|demonstrating|illustrating|signaling|signalling|marking|cementing|solidifying|reinforcing|underlining|showing|proving)\s+[^.?!]{3,}"
NEGATIVE_LISTING = [r"(?i)" + B + r"not\s+(?:a|an|the)?\s*[a-z]+[.,]\s+not\s+(?:a|an|the)?\s*[a-z]+", r"(?i)" + B + r"that'?s\s+it[.!]\s+that'?s\s+(?:the\s+)?[a-z]+", r"(?i)[.!?]\s+and\s+[a-z]+[^.?!]{0,30}?[.!]\s+and\s+[a-z]+"]
FAKE_STRONG_VERB = r"(?i)" + B + r"(?:serves?|acts?|functions?|stands?)\s+as\s+(?:a|an|the)\s+(?:centralized\s+|centralised\s+|one-stop\s+|comprehensive\s+|powerful\s+|robust\s+|go-to\s+|single\s+|unified\s+)?(?:hub|platform|solution|resource|cornerstone|gateway|bridge|catalyst|backbone|foundation|framework|ecosystem|destination|powerhouse)" + NB
SYNONYM_GROUPS = [["agent", "assistant", "tool", "bot", "model", "system", "copilot"], ["app", "platform", "tool", "product", "service", "solution", "software"], ["company", "firm", "startup", "team", "organization", "organisation"], ["article", "piece", "post", "essay", "write-up", "writeup"]]
RECAP_OPENERS = ["in conclusion", "ultimately", "overall", "to sum up", "in summary", "all in all", "at the end of the day", "when all is said and done", "in the end", "to wrap up", "to conclude"]
KICKER_OPENERS = ["and that's", "and maybe that's", "because in the end", "that's the real", "and in the end", "that, ultimately, is", "and that is the"]
THROAT_OPENERS = ["in today's world", "in today's day and age", "in this day and age", "in an era where", "in an age where", "in a world where", "we live in a world", "look,", "so,", "let's be honest", "let's face it", "here's the truth", "it goes without saying", "needless to say", "in our modern world"]
INSIGHT_SETUPS = ["here's the thing nobody tells you", "nobody tells you", "what most people get wrong", "most people think", "the secret to", "the truth about", "a little-known fact", "nobody talks about", "what they don't tell you"]
PUFFERY = ["a testament to", "testament to", "pivotal moment", "watershed moment", "more important than ever", "more relevant than ever", "unprecedented", "ever-evolving landscape", "ever-changing landscape"]
OPENER_FRAMES = ["spannender punkt", "spanender punkt", "interessanter gedanke", "wichtiger beitrag", "danke fuer diesen beitrag", "danke für diesen beitrag", "du sprichst einen wichtigen punkt an", "das ist ein wichtiger aspekt", "genau das ist entscheidend", "ein weiterer aspekt ist", "ein weiterer punkt waere", "ein weiterer punkt wäre", "ergaenzend dazu", "ergänzend dazu", "die eigentliche frage ist", "die spannende frage ist", "was bedeutet das nun", "doch was heisst konkret", "doch was heißt konkret", "interesting point", "another aspect is", "the exciting part is", "the interesting question is", "great question"]
# Words of which a text must hold one of each list (in lower case) for a pattern to match: looked for first.
BINARY_WORDS = [["not"], ["not"], ["question", "point", "problem", "issue", "goal"], ["just"], ["longer"], ["replaced"]]
LISTING_WORDS = [["not"], ["that's", "thats"], ["and"]]
STRONG_WORDS = ["serve", "act", "function", "stand"]
SUPERFICIAL_WORDS = ["highlighting", "underscoring", "reflecting", "showcasing", "emphasizing", "emphasising", "demonstrating", "illustrating", "signaling", "signalling", "marking", "cementing", "solidifying", "reinforcing", "underlining", "showing", "proving"]
NEEDED = [*BINARY_WORDS, *LISTING_WORDS, SUPERFICIAL_WORDS, STRONG_WORDS]
EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}]"
RHETORIC_SEEDS = ["", "It's not a tool. It's a mirror, highlighting the change.", "Not a feature. Not a tool. It serves as a centralized hub.", "The agent reads. The assistant writes. Here's the thing nobody tells you.", "A pivotal moment. Works fast. Ships now. Every time.", "Interesting point. Fast | Strong | Clear\nIn conclusion, it changed.", "The platform grew; the software shrank. No longer slow, now quick.\n\nAnd that's the point."]


def starts_any(q: Spark, x: str, heads: list[str]) -> str:
    return "(" + " OR ".join(q.starts(x, h) for h in heads) + ")"


@operator()
def rhetorical_findings_seeded(q):
    spark = q.name == "spark"
    more = f"{E.paragraphs(q, 't')} AS paras, {E.sentences_kept(q, 't')} AS sk"
    cycling = " OR ".join("(" + " + ".join(f"CASE WHEN contains(lo, {q.lit('the ' + w)}) AND {q.has('lo', B + 'the ' + w + NB)} THEN 1 ELSE 0 END" for w in group) + ") >= 2" for group in SYNONYM_GROUPS)
    last_para = f"lower(coalesce({q.at('paras', -1)}, ''))"
    last = f"lower(coalesce({q.at('sk', -1)}, ''))"
    short = f"{q.size(E.white_words(q, 'y'))} <= 5"
    em = q.count("t", r"[\x{2014}\x{2013}]")
    pair = q.size(q.distinct(q.all("t", r"(?:^|[\s])[a-z]+-[a-z]+(?:[\s,.]|$)")))
    frames = " OR ".join(f"{q.starts('lo', f)} OR contains(lo, {q.lit('. ' + f)})" for f in OPENER_FRAMES)
    first = q.map("sk", "y", f"lower(coalesce({q.at(E.white_words(q, 'y'), 1)}, ''))")
    nw, kept, run, most = "nw", q.size("sk"), q.run("sk", "y", short), q.most(first)
    recap = f"{starts_any(q, last_para, RECAP_OPENERS)} OR ({starts_any(q, last, KICKER_OPENERS)} AND {q.size(E.white_words(q, last))} <= 14)"
    throat = starts_any(q, f"lower({E.trim(q, 't')})", THROAT_OPENERS)
    if spark:
        nw, kept, run, most, em, pair, recap, throat = (f"f.{c}" for c in ("nw", "n_kept", "short_run", "same_opening", "em", "pairs", "recap", "throat"))
        cycling, frames = "f.cycling", "f.frames"
    # Spark looks for a pattern where Python has found what it needs.
    needs = lambda flag, x: f"(f.{flag} AND {x})" if spark else x
    held = lambda patterns, words: "(" + " OR ".join(f"(f.needs[{NEEDED.index(w)}] AND {q.has('t', p)})" for p, w in zip(patterns, words, strict=True)) + ")" if spark else gated(q, patterns, words)
    rules = [
        ("BinaryContrast", 0.7, held(BINARY_CONTRAST, BINARY_WORDS)),
        ("SuperficialAnalysis", 0.7, held([SUPERFICIAL], [SUPERFICIAL_WORDS])),
        ("NegativeListingFragmentation", 0.65, held(NEGATIVE_LISTING, LISTING_WORDS)),
        ("FakeStrongVerb", 0.6, held([FAKE_STRONG_VERB], [STRONG_WORDS])),
        ("SynonymCycling", 0.6, f"({cycling})"),
        ("HollowKickerRecap", 0.6, f"({recap})"),
        ("FormattingSlop", 0.55, f"({needs('heads', q.has('t', r'(?m)^#{1,6}[ ].*' + EMOJI))} OR {needs('bold', q.has('t', r'[a-z0-9,;][\s]+[*][*][^*\n]{1,40}[*][*][\s]+[a-z]'))} OR {'f.quotes' if spark else q.has('t', '[“”]')} OR {pair} >= 2 OR ({em} >= 1 AND {nw} <= 120 AND {em} <= 0.5 * greatest({kept}, 1)) OR ({em} > 2 AND {nw} > 120 AND {em} <= 0.5 * greatest({kept}, 1)))"),
        ("RoboticRhythm", 0.5, f"{run} >= 3"),
        ("ThroatClearing", 0.6, throat),
        ("FauxInsightSetup", 0.65, "f.insight" if spark else any_of(q, "lo", INSIGHT_SETUPS)),
        ("ImportancePuffery", 0.6, "f.puffery" if spark else any_of(q, "lo", PUFFERY)),
        ("DecorativeSeparatorTriad", 0.5, needs("bars", q.has("t", r"(?m)^[^|\n-][^|\n]*[\p{L}\p{N}_]{2,18}[\s]*[|•][\s]*[\p{L}\p{N}_]{2,18}[\s]*[|•][\s]*[\p{L}\p{N}_]{2,18}"))),
        ("OpenerAnnouncement", 0.45, f"({frames})"),
        ("RepeatedOpenings", 0.5, f"{most} >= 3"),
    ]
    if spark:
        f = q.measured("t", "plumbline_rhetoric", measures.rhetoric, measures.RHETORIC)
        return f"WITH s0 AS (SELECT doc_id, {seeded(q, RHETORIC_SEEDS)} AS t FROM documents), p AS (SELECT *, {f} AS f FROM s0), {fire(q, rules)} SELECT doc_id, signal_id, confidence FROM fired"
    return findings(q, RHETORIC_SEEDS, rules, more)


# --- quantifiers, proof, rhythm ---------------------------------------------------------------------
# Fixed values.
UNIVERSALS = ["everyone knows", "everyone agrees", "we all", "nobody", "no one", "always", "never"]
AUTHORITY_CLAIMS = ["studies show", "studies have shown", "studies suggest", "studies confirm", "research shows", "research suggests"]
COUNTED = r"(?i)" + B + r"(?:one|two|three|four|five|six|seven|eight|nine|ten|[0-9]{1,3})\s+(?:studies|papers|trials|experiments|surveys|meta-analyses)" + NB
CITED = r"et al[.]?|[(]\s*[A-Z][a-zA-Z]+,?\s*[0-9]{4}\s*[)]|\[[0-9]{1,3}\]|doi[.]org|10[.][0-9]{4,}|https?://"
CLAIM = r"(?i)(?:accuracy|precision|recall|f1|f-score|false positives|error rate|success rate|uptime)"
METRIC = r"(?i)[0-9]{1,3}(?:[.,][0-9]+)?\s*%|(?:zero|no)\s+false\s+positives|F1(?:[- ]score)?(?:\s+of)?\s*[0-9][.,][0-9]{1,3}"
SOURCED = r"(?i)corpus|korpus|" + B + r"eval(?:uation)?" + NB + r"|https?://|doi[.]org|10[.][0-9]{4,}|et al[.]|[(]\s*[0-9]{4}\s*[)]|(?:19|20)[0-9]{2}"
CONNECTORS = ["darueber hinaus", "darüber hinaus", "zudem", "ausserdem", "außerdem", "des weiteren", "des weiten", "ein weiterer", "gleichzeitig", "abschliessend", "abschließend", "zusammenfassend", "weiterhin", "zusaetzlich", "zusätzlich", "moreover", "furthermore", "additionally", "in addition", "finally,", "in summary", "overall,"]
SELF_ANSWER = r"(?i)" + B + r"(?:why|what|how|where|who|when)" + NB + r"[^.?!\n]{2,80}[?]\s*(?:because|it'?s simple|here'?s why|the answer|simple|short answer)"
CLAIM_SEEDS = ["", "We all know that nobody reads. Studies show gains in three studies.", "It reaches 98% accuracy with no false positives.", "Research shows two trials agree (Smith, 2020).", "Why does it fail? Because nobody tests, and why care? Simple.", "An accuracy of 91% on the evaluation corpus."]


@operator()
def quantifier_findings_seeded(q):
    n = " + ".join(q.count("lo", B + w + NB) for w in UNIVERSALS)
    commands = q.count("lo", r"(?:^|[.!?\n])[\s]*(?:always|never)\s+[a-z]+")
    rules = [
        ("UniversalQuantifiers", 0.6, f"({n} - {commands}) >= 2"),
        ("SourceDiscrepancy", 0.7, f"({any_of(q, 'lo', AUTHORITY_CLAIMS)} AND {q.has('t', COUNTED)} AND NOT {q.has('t', CITED)})"),
    ]
    return findings(q, CLAIM_SEEDS, rules)


@operator()
def unsourced_metrics_seeded(q):
    """Sentences with a figure and a claim word, and no source in the whole sentence."""
    hit = f"{q.has('y', METRIC)} AND {q.has('y', CLAIM)} AND NOT {q.has('y', SOURCED)}"
    rules = [("fabricated-proof-metrics", 0.75, f"{q.size(q.filter('sk', 'y', hit))} > 0")]
    return findings(q, CLAIM_SEEDS, rules, f"{E.sentences_kept(q, 't')} AS sk")


@operator()
def rhythm_findings_seeded(q):
    opener = q.map("ss", "y", f"lower(concat_ws(' ', {q.at(E.white_words(q, 'y'), 1)}, {q.at(E.white_words(q, 'y'), 2)}))")
    n = q.size("ss")
    rules = [
        ("SelfAnsweredQuestion", 0.6, f"{q.count('t', SELF_ANSWER)} > 0"),
        ("LowOpenerDiversity", 0.5, f"({n} >= 4 AND {q.most(opener)} > 0.3 * {n})"),
        ("ParagraphConnectorRate", 0.5, f"({q.size('paras')} >= 2 AND {q.size(q.filter('paras', 'y', starts_any(q, 'lower(y)', CONNECTORS)))} > 0.5 * {q.size('paras')})"),
    ]
    return findings(q, CLAIM_SEEDS, rules, f"{E.sentences(q, 't')} AS ss, {E.paragraphs(q, 't')} AS paras")


@operator()
def uniform_length_runs(q):
    """Longest run of sentences whose word counts follow each other within 5 %: islands by window."""
    words = q.size(E.white_words(q, "y"))
    x = q.explode("doc_id", "s", "ss", "pos", "y")
    return f"""WITH s AS (SELECT doc_id, {E.sentences(q, "coalesce(text, '')")} AS ss FROM documents), x AS ({x}), c AS (SELECT doc_id, pos, {words} AS k FROM x),
l AS (SELECT *, lag(k) OVER (PARTITION BY doc_id ORDER BY pos) AS before_ FROM c),
g AS (SELECT *, sum(CASE WHEN before_ IS NOT NULL AND abs(k - before_) <= 0.05 * greatest(k, before_) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM l),
r AS (SELECT doc_id, island, count(*) AS n FROM g GROUP BY doc_id, island) SELECT doc_id, max(n) AS longest FROM r GROUP BY doc_id"""


@operator()
def short_sentence_runs(q):
    short = f"{q.size(E.white_words(q, 'y'))} <= 5"
    return f"WITH s AS (SELECT doc_id, {E.sentences_kept(q, chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} AS sk FROM documents) SELECT doc_id, {q.run('sk', 'y', short)} AS longest FROM s"


@operator()
def repeated_openings(q):
    x = q.explode("doc_id", "s", "ss", "pos", "y")
    return f"""WITH s AS (SELECT doc_id, {E.sentences_kept(q, "coalesce(text, '')")} AS ss FROM documents), x AS ({x}),
o AS (SELECT doc_id, lower({q.at(E.white_words(q, 'y'), 1)}) AS opener FROM x) SELECT doc_id, opener, count(*) AS n FROM o WHERE opener IS NOT NULL GROUP BY doc_id, opener HAVING count(*) >= 3"""


@operator()
def identical_enumeration(q):
    """Frames that three or more sentences of a document share: first word, first two, stem and last."""
    x = q.explode("doc_id", "s", "ss", "pos", "y")
    clean = lambda w: q.sub(f"lower({w})", "^[,;:.!?«»\"']+|[,;:.!?«»\"']+$", "")
    a, b, z = clean(q.at("ws", 1)), clean(q.at("ws", 2)), clean(q.at("ws", -1))
    return f"""WITH s AS (SELECT doc_id, {E.sentences(q, "coalesce(text, '')")} AS ss FROM documents), x AS ({x}), w AS (SELECT doc_id, {E.white_words(q, 'y')} AS ws FROM x),
f AS (SELECT doc_id, 'one' AS kind, {a} AS frame FROM w WHERE {q.size('ws')} >= 1 UNION ALL SELECT doc_id, 'two', concat({a}, ' ', {b}) FROM w WHERE {q.size('ws')} >= 2
UNION ALL SELECT doc_id, 'stem_last', concat(substring({a}, 1, 4), '|', {z}) FROM w WHERE {q.size('ws')} >= 3)
SELECT doc_id, kind, frame, count(*) AS n FROM f GROUP BY doc_id, kind, frame HAVING count(*) >= 3"""


# --- structure, discourse, academic, instructions ------------------------------------------------------
# Fixed values.
SYNONYM_FAMILIES = {"organisation": ["unternehmen", "firma", "konzern", "betrieb", "organisation", "company", "firm", "enterprise", "business"], "autor": ["autor", "autorin", "verfasser", "schreiber", "author", "writer"], "produkt": ["produkt", "loesung", "angebot", "anwendung", "product", "solution", "offering"], "nutzer": ["nutzer", "anwender", "benutzer", "kunde", "user", "customer", "client"]}
FRAMING = [r"(?i)" + B + r"weniger\s+[^\s]+(?:\s+[^\s]+){0,3}?\s+als\s+vielmehr", B + r"eher\s+[^\s]+(?:\s+[^\s]+){0,3}?\s+als" + NB, r"(?i)" + B + r"nicht\s+[^\s]+[^,.;]{0,30}?\s*,\s*sondern", r"(?i)" + B + r"less\s+about\s+[^\s]+[^,.;]{0,30}?\s+(?:and\s+(?:more|less)|more|than)\s+about"]
FAKE_ANALYSIS = [r"(?i),\s(?:der|die|das|den|dem|welche[rms]?)\s[^.!?]{0,90}?(?:die art, wie|ver[aä]ndert|pr[aä]gt|unterstreicht|untermauert|definiert\s+neu|belebt)", r"(?i)" + B + r"(?:which|that)\s[^.!?]{0,80}?(?:the way we|redefines?|changes?|shapes?)" + NB]
NUANCE = ["genauer gesagt", "streng genommen", "präziser formuliert", "um es genauer zu sagen", "to be precise", "strictly speaking", "more precisely"]
CRITERIA = ["weil", "grund", "gründe", "kriterium", "kriterien", "begruendet", "begründet", "gemessen an", "sortiert nach", "massstab", "maßstab", "because", "reason", "criterion", "criteria", "rationale", "metric", "measured by", "ranked by", "sorted by", "justification", "basis:"]
STRONG_EPISTEMIC = r"(?i)" + B + r"(?:demonstrates?|demonstrated|proves?|proven|conclusively\s+shows?|confirms?|confirmed|establishes?)" + NB
HEDGES = r"(?i)" + B + r"(?:may|might|appears?|seems?|suggests?|indicates?|possible|preliminary|potentially|in\s+some\s+cases)" + NB
SCOPE = r"(?i)" + B + r"(?:comprehensive\s+(?:analysis|survey|study|review|overview|evaluation)|exhaustive\s+(?:analysis|survey|study|review|list)|all\s+(?:relevant|existing|available)\s+(?:studies|literature|work))" + NB
QUANTIFIED = r"(?i)n\s*=\s*[0-9]+|[0-9]+\s+(?:papers?|studies?|articles?|participants?|subjects?|patients?|records?|samples?|responses?|documents?|datasets?|models?|repositories?)|(?:between|from|across)\s+[0-9]{4}|in\s+[0-9]{4}|[0-9]{2,3}\s*(?:%|percent)"
VAGUE_ATTRIBUTION = r"(?i)(?:the literature|studies|research|evidence)\s+(?:suggests?|shows?|indicates?)"
GENERIC_ADVICE = ["write clean code", "be thorough", "follow best practices", "best practices in everything", "be proactive", "think outside the box", "deliver high quality", "ensure high quality"]
OBVIOUS = ["use git", "use version control", "commit often", "commit your changes", "save your work", "read the code", "use the terminal"]
VAGUE = ["improve quality", "make it better", "keep it clean", "ensure quality", "be helpful", "do the right thing", "be smart about it"]
FORMAL = ["furthermore", "moreover", "in addition", "hereby", "notwithstanding", "thus", "hence", "consequently", "ferner", "mithin", "gemäß", "hierauf", "folglich", "laut"]
COLLOQUIAL = ["yeah", "kinda", "gonna", "hey", "okay", "honestly", "stuff", "wild", "na ja", "irgendwie", "halt", "krass", "echt"]
FULL_FORMS = ["do not", "does not", "did not", "cannot", "can not", "will not", "would not", "it is", "we are", "they are", "that is", "there is", "we have", "they have", "it has"]
PARTICLES = ["ja", "halt", "eben", "doch", "mal", "wohl", "schon", "denn", "eigentlich", "einfach", "irgendwie", "quasi"]
PROSE_SEEDS = ["", "The company met the firm and the enterprise; eher leise als laut, nicht hart, sondern weich.", "1. First thing\n2. Second thing\n3. Third thing", "It demonstrates what may be; a comprehensive survey follows. The literature suggests more.", "Write clean code. Use git. Always test first. Never test first. Make it better.", "Furthermore, hence, yeah, kinda fine. It is what we are and they are; do not stop.", "To be precise, strictly speaking, a law that shapes us and that changes us.", "Das ist ja halt so, doch eben mal schon wohl denn einfach eigentlich gut."]


@operator()
def structure_findings_seeded(q):
    wd = q.all("lo", r"[a-zA-Zäöüß]+")
    rotation = " OR ".join("(" + " + ".join(f"CASE WHEN {q.contains('wd', q.lit(w))} THEN 1 ELSE 0 END" for w in family) + ") >= 3" for family in SYNONYM_FAMILIES.values())
    heads, bullets = q.filter("ls", "x", q.has("x", r"^#{1,6}[\s]+[^\s]")), q.filter("ls", "x", q.has("x", r"^[\s]*[-*][\s]+[^\s]"))
    unit = f"CASE WHEN {q.size(heads)} >= 5 THEN {heads} WHEN {q.size(bullets)} >= 5 THEN {bullets} ELSE paras END"
    counts = q.map("units", "y", q.size(E.white_words(q, "y")))
    rules = [
        ("SynonymRotation", 0.5, f"({q.size('wd')} >= 40 AND ({rotation}))"),
        ("IsometricUnits", 0.5, f"(nw >= 20 AND {q.size('units')} >= 5 AND {E.spread(q, counts)} < 1)"),
        ("FakeAnalysisAppendix", 0.5, f"(nw >= 15 AND {total_of(q, 't', FAKE_ANALYSIS)} >= 2)"),
        ("PseudoNuance", 0.5, f"(nw >= 8 AND {distinct_of(q, 'lo', NUANCE)} >= 2)"),
        ("ComparativeFraming", 0.5, f"(nw >= 25 AND {total_of(q, 't', FRAMING)} >= 2)"),
    ]
    ls, paras = E.lines(q, "t"), E.paragraphs(q, "t")
    return f"{src(q, PROSE_SEEDS, f'{wd} AS wd, {ls} AS ls, {paras} AS paras')}, p2 AS (SELECT *, {unit} AS units FROM p), {fire(q, rules, 'p2')} SELECT doc_id, signal_id, confidence FROM fired"


@operator()
def discourse_findings_seeded(q):
    rules = [("RankWithoutCriterion", 0.35, f"({q.count('t', r'(?m)^[ \t]*[0-9]{1,2}[.)][ \t]+[^ \t\n]')} >= 3 AND NOT {any_of(q, 'lo', CRITERIA)})")]
    return findings(q, PROSE_SEEDS, rules)


@operator()
def academic_findings_seeded(q):
    mismatch = f"{q.has('y', STRONG_EPISTEMIC)} AND {q.has('y', HEDGES)}"
    scope = f"{q.has('y', SCOPE)} AND NOT {q.has('y', QUANTIFIED)}"
    vague = f"{q.has('y', VAGUE_ATTRIBUTION)} AND NOT {q.has('y', CITED)}"
    rules = [(i, c, f"(nw >= 40 AND {q.size(q.filter('ss', 'y', x))} > 0)") for i, c, x in (("EpistemicMismatch", 0.5, mismatch), ("UnquantifiedScopeClaim", 0.55, scope), ("VagueAttribution", 0.5, vague))]
    return findings(q, PROSE_SEEDS, rules, f"{E.sentences(q, 't')} AS ss")


@operator()
def instruction_findings_seeded(q):
    norm = lambda a, head: q.map(a, "y", E.trim(q, q.sub(q.sub("lower(y)", f"^[^a-z]*{head}[\\s]+", ""), "[^a-z0-9 ]", "")))
    always, never = (norm(q.all("t", r"(?i)(?:^|[^\p{L}])" + h + r"[\s]+[^.\n]+"), h) for h in ("always", "never"))
    rules = [("generic-advice", 0.6, any_of(q, "lo", GENERIC_ADVICE)), ("obvious", 0.55, any_of(q, "lo", OBVIOUS)), ("too-vague", 0.6, any_of(q, "lo", VAGUE)), ("contradiction", 0.8, f"{q.size(q.common('al', 'ne'))} > 0")]
    return findings(q, PROSE_SEEDS, rules, f"{always} AS al, {never} AS ne")


@operator()
def naturalness_findings_seeded(q):
    body = q.sub("t", '[„"“][^„"“”]{1,300}[”“"]', " ")
    token = "|".join(PARTICLES)
    marks = q.count("lb", B + f"(?:{token})" + NB)
    stacked = q.size(q.filter(q.split("lb", "[.!?]+"), "y", "(" + " + ".join(f"CASE WHEN {q.has('y', B + w + NB)} THEN 1 ELSE 0 END" for w in PARTICLES) + ") >= 2"))
    short = q.count("t", r"[\p{L}\p{N}_]+['’](?:t|re|ve|ll|d|m)" + NB)
    rules = [
        ("RegisterDrift", 0.45, f"(nb >= 30 AND {distinct_of(q, 'lb', FORMAL)} >= 2 AND {distinct_of(q, 'lb', COLLOQUIAL)} >= 2)"),
        ("OverSanitized", 0.45, f"(nw >= 25 AND {distinct_of(q, 'lo', FULL_FORMS)} >= 3 AND {short} = 0)"),
        ("ModalParticleAnomaly", 0.45, f"(nb >= 40 AND (({marks} >= 6 AND {marks} >= 0.025 * nb) OR {stacked} >= 2))"),
    ]
    return f"{src(q, PROSE_SEEDS, f'lower({body}) AS lb')}, p2 AS (SELECT *, {q.size(E.white_words(q, 'lb'))} AS nb FROM p), {fire(q, rules, 'p2')} SELECT doc_id, signal_id, confidence FROM fired"


# --- German ---------------------------------------------------------------------------------------
# Fixed values.
GERMAN_WORDS = ["der", "die", "das", "und", "ist", "nicht", "mit", "für", "auf", "eine", "ein", "von", "den", "dem", "sich", "auch", "als", "bei", "aus", "nach", "werden", "wird", "hat", "haben", "kann", "man"]
IDEOLOGY = {
    "RitualFirewall": (0.6, r"die\s+brandmauer|die\s+feuermauer|hold\s+the\s+(?:firewall|cordon\s+santaire|sanitary\s+cordon)|brandmauer\s+(?:halten|wahren|verteidigen)", r"untersuchungsausschuss|minderheitsregierung|verbotsverfahren|ausschuss|satire|ironie|parodie|glosse|ironic|parody"),
    "MartyrCartel": (0.6, r"systempresse|lügenpresse|systemmedien|die\s+altparteien|das\s+kartell\s+der\s+(?:alten\s+)?parteien|lying\s+press", r"aktenzeichen|protokoll|beschluss|urteil|docket|" + B + r"az[^\p{L}\p{M}\p{N}_]"),
    "CollectiveOther": (0.7, r"die\s+(?:migranten|ausländer|muslime)\s+sind|those\s+(?:migrants|immigrants|refugees)\s+are|die\s+sind\s+nun\s+mal\s+so", r"[0-9]+\s*%|(?:19|20)[0-9]{2}|quelle|source|destatis|eurostat|bamf|lizenz"),
    "ReplacementKicker": (0.7, r"umvolkung|bevölkerungsaustausch|great\s+replacement|der\s+austausch\s+des\s+volkes|das\s+land,?\s+das\s+wir\s+kannten", r"(?:19|20)[0-9]{2}|geburtenrate|wanderungssaldo|demografi|destatis|eurostat|quelle|source"),
    "EthnopluralistRebrand": (0.6, r"recht\s+auf\s+differenz|ethnopluralis|ethno-differentialis|trennung\s+der\s+kulturen|getrennte\s+räume|echte\s+vielfalt\s+lebt\s+von\s+der\s+trennung|each\s+culture\s+its\s+own", r"ethnografi|völkerkund|ethnolog|studie|studium|forschung"),
    "PurityBan": (0.6, r"ai\s+is\s+theft|totalverbot|komplett\s*verbieten\s+lassen|ban\s+all\s+ai", r"urheberrecht|copyright|verfahren|klage|gericht|lawsuit|dokumentiert"),
    "VibeScapegoat": (0.6, r"vibe[- ]cod(?:ed|ing)\s+(?:slop\s+)?devs|slop\s+devs\s+at\s+work", r"postmortem|post-mortem|regression|incident|commit"),
    "SalvationModel": (0.6, r"nur\s+(?:noch\s+)?[^\s]+(?:\s+[^\s]+){0,3}\s+kann\s+(?:das\s+land|uns)\s+(?:noch\s+)?retten|only\s+[^\s]+\s+can\s+save\s+(?:us|the\s+country|america|europe)|alle\s+anderen\s+sind\s+teil\s+des\s+problems", r"wahlprognose|umfrage|belegt|satire|ironie|parodie|glosse|ironic|parody"),
    "UnfalsifiableTemplate": (0.6, r"bestätigt\s+nur,?\s+was\s+wir\s+(?:immer\s+)?gesagt\s+haben|genau\s+wie\s+wir\s+es\s+(?:immer\s+)?gesagt\s+haben|proves?\s+(?:what|that)\s+we'?ve\s+been\s+saying|zeigt\s+nur,?\s+was\s+wir\s+schon\s+immer\s+wussten", r"(?:19|20)[0-9]{2}|[0-9]{2}[.][0-9]{2}[.]|zum\s+ersten\s+mal|neue\s+information|erstmals"),
    "EnemyVermin": (0.7, r"ungeziefer|untermensch|volksschädling|parasiten\s+des\s+volkes|vermin|cockroaches", r"satire|ironie|ironic|parodie|parody|glosse|historisch|analyse|sprachgebrauch|forschung|studie|(?:19|20)[0-9]{2}"),
}
GERMAN_SEEDS = ["", "Die Brandmauer halten, sagt man.", "Das Protokoll nennt die Systempresse.", "It proves what we've been saying.", "Nur noch einer kann uns retten.", "Das ist „falsch” und die Quote ist 3.5 kg, der Peter's Test mit dem Wert.", "Ban all AI now."]


@operator()
def german_gate(q):
    hits = q.filter(q.all("lower(coalesce(text, ''))", "[a-zäöüß]+"), "w", q.contains(q.array_of(GERMAN_WORDS), "w"))
    return f"WITH h AS (SELECT doc_id, lang, {hits} AS h FROM documents) SELECT doc_id, ({q.size(q.distinct('h'))} >= 3 OR {q.size('h')} >= 5) AS is_german FROM h"


@operator()
def german_gate_confusion(q):
    hits = q.filter(q.all("lower(coalesce(text, ''))", "[a-zäöüß]+"), "w", q.contains(q.array_of(GERMAN_WORDS), "w"))
    return f"WITH h AS (SELECT lang, {hits} AS h FROM documents) SELECT lang, ({q.size(q.distinct('h'))} >= 3 OR {q.size('h')} >= 5) AS is_german, count(*) AS n FROM h GROUP BY 1, 2"


@operator()
def ideology_findings_seeded(q):
    rules = [(i, c, f"({q.has('t', '(?i)' + t)} AND NOT {q.has('t', '(?i)' + k)})") for i, (c, t, k) in IDEOLOGY.items()]
    return findings(q, GERMAN_SEEDS, rules)


@operator()
def german_surface_seeded(q):
    """Line-level findings with line numbers, in texts that pass the German gate."""
    hits = q.filter(q.all("lo", "[a-zäöüß]+"), "w", q.contains(q.array_of(GERMAN_WORDS), "w"))
    x = q.explode("doc_id", "g", "ls", "line_no", "line")
    rules = [
        ("QuoteMismatch", 0.7, q.has("line", "„[^„”“]{1,200}[”\"]")),
        ("GenitiveApostrophe", 0.6, q.has("line", r"[A-ZÄÖÜ][a-zäöüß]+['’]s" + NB)),
        ("UsFormat", 0.6, q.has("line", r"[0-9]+[.][0-9]+[\s]*(?:kg|km|cm|mm|%|Euro|EUR|€)")),
        ("TitleCase", 0.6, f"({q.has('line', r'^#{1,6}[\s]')} AND {q.count('line', B + '(?:Der|Die|Das|Und|Mit|Von|Für|Im|Am|Zu|Ein|Eine)' + NB)} >= 2)"),
    ]
    return f"{src(q, GERMAN_SEEDS, f'{E.lines(q, chr(116))} AS ls, {hits} AS h')}, g AS (SELECT * FROM p WHERE {q.size(q.distinct('h'))} >= 3 OR {q.size('h')} >= 5), x AS ({x}), {fire(q, rules, 'x', 'doc_id, line_no')} SELECT doc_id, line_no + 1 AS line_no, signal_id, confidence FROM fired"


@operator()
def language_guess(q):
    """German or English by the larger share of function words."""
    english = ["the", "and", "of", "to", "in", "is", "that", "it", "for", "with", "was", "on", "are", "as"]
    w = q.distinct(q.all("lower(coalesce(text, ''))", r"[\p{L}]+"))
    return f"WITH w AS (SELECT doc_id, {w} AS w FROM documents), n AS (SELECT doc_id, {q.size(q.common('w', q.array_of(GERMAN_WORDS)))} AS de, {q.size(q.common('w', q.array_of(english)))} AS en FROM w) SELECT doc_id, de, en, CASE WHEN de = 0 AND en = 0 THEN 'unknown' WHEN de > en THEN 'de' ELSE 'en' END AS guess FROM n"


# --- artefacts, gates, metadata -------------------------------------------------------------------------
# Fixed values.
PASTE = {
    "elision-comment": (1, [r"(?im)^\s*(?://|#|--|/[*]|<!--)?\s*(?:[.]{3}|…|\[?dots?\]?)\s*(?:the\s+)?(?:rest|remainder|remaining\s+part|other\s+parts?)\s+(?:of\s+)?(?:the\s+)?(?:code|file|content|implementation|logic|config(?:uration)?|function|class|test[\p{L}\p{N}_]*)(?:[^\p{L}\p{M}\p{N}_.\n][^.\n]{0,39})?(?:is\s+)?(?:unchanged|stays?\s+the\s+same|remains?\s+the\s+same|as\s+before|not\s+shown|omitted|elided|the\s+same)?\s*(?:-->|[*]/)?[\s.]*$", r"(?i)\[\s*[.]{2,3}\s*(?:existing|remaining|previous|other)\s+(?:code|content|lines?|implementation|logic)(?:[^\p{L}\p{M}\p{N}_\]][^\]]{0,29})?\]"]),
    "chat-preamble": (1, [r"(?im)^\s*(?:certainly|of\s+course|sure|great\s+question|absolutely|happy\s+to\s+help|i'?d\s+be\s+happy\s+to\s+help)\s*[!,.]?\s*$", r"(?im)^\s*(?:certainly|of\s+course|sure|absolutely)[!,.]?\s*here'?s\s+(?:the|your|an?|my)" + NB, r"(?im)^\s*here'?s\s+the\s+(?:corrected|updated|revised|complete|full|final|entire|correct)\s+(?:code|version|file|script|function|implementation)" + NB, r"(?im)^\s*as\s+(?:an?\s+)?(?:ai|assistant|language\s+model)" + NB]),
    "fence-in-code": (2, [r"(?im)^\s*```[a-zA-Z0-9_+-]*\s*$"]),
    "meta-process-comment": (2, [r"(?im)^\s*(?://|#|--)\s*(?:phase|step|stage)\s+[0-9]+\s*(?:of|:)\s*[^.\n]{0,60}$", r"(?i)" + B + r"(?:the\s+)?(?:agent|assistant|model|llm|ai)\s+(?:behavior|will\s+(?:now|then)|output|response)" + NB, r"(?i)" + B + r"(?:as\s+)?per\s+(?:my\s+|the\s+)?(?:previous|last)\s+(?:response|message|answer|turn|instruction[\p{L}\p{N}_]*)" + NB, r"(?i)" + B + r"(?:regenerat[\p{L}\p{N}_]+|re-roll[\p{L}\p{N}_]*|re-?prompt[\p{L}\p{N}_]*)\s+(?:the\s+)?(?:output|response|answer|code)" + NB]),
    "list-label-marker": (2, [r"(?im)^[ \t]*(?:[-*+]|[0-9]+[.)])[ \t]+(?:G[0-9]+|NG[0-9]+|FN[0-9]+|BS-I[0-9]+|T[0-9]+|M[0-9]+|S[0-9]+|A[0-9]+|P[0-9]+)[ \t]*[:.)][ \t]+"]),
    "placeholder-credential-shape": (1, [r"(?i)(?:your|my|the|insert|replace|enter|add)_?(?:api[_-]?key|token|secret|password|credential[_-]?s?|key)(?:[_-]?(?:here|now))?" + NB, r"(?i)(?:insert|replace|enter|paste|fill[_-]?in)\s+(?:your\s+|the\s+|the\s+actual\s+)?(?:api[_-]?key|token|secret|password|credential[_-]?s?)"]),
}
GATES = {
    "placeholder_credentials": ("code", r"(?i)(?:your[-_ ]?api[-_ ]?key|sk-[a-z0-9]{3}|changeme|change[-_ ]me)"),
    "elision_comments": ("code", r"(?://|#|/[*])\s*(?:[.]{3}|…)|rest of (?:the )?(?:implementation|code|logic) (?:here )?[.]{3}|(?:…|[.]{3})\s*(?:rest|weitere|Rest)"),
    "lorem_ipsum": ("markup", r"(?i)lorem ipsum|dolor sit amet"),
    "dead_anchor": ("markup", "href\\s*=\\s*[\"'](?:#{1,2}|javascript:void\\(0\\)|)[\"']"),
    "placeholder_image": ("markup", "(?i)(?:src|href)\\s*=\\s*[\"'](?:https?://(?:via[.]placeholder[.]com|placehold[.]it|placekitten[.]com|placebear[.]com|dummyimage[.]com)/[^\"']*|placeholder[.](?:png|jpe?g|svg)|image-placeholder[^\"']*)[\"']"),
    "todo_ship_blocker": ("text", r"(?i)(?:TODO|FIXME|XXX)[^.\n]{0,60}(?:before (?:launch|ship|deploy|release)|vor (?:Launch|Release|Auslieferung)|insert (?:your|real)|hier einfügen|einfügen)"),
}
CODE_HINT = r"(?m)^[ \t]*(?:import |from [a-z_]+ import |def |function |const |let |var |class |<html|<!DOCTYPE|</?[a-z]+[ >]|#!/)"
MARKUP_HINT = r"(?i)<(?:html|body|div|a |img |head|p>|h[1-6]>)"
CODE_SEEDS = ["", "\nimport os\n# ... rest of the code unchanged\napi_key = \"YOUR_API_KEY\"", "\nSure! Here's the updated code:\n```python\nx = 1\n```", "\n- G1: first goal here\n- NG2: no goal here\n# TODO fix before launch", "\n<div><a href=\"#\">x</a><img src=\"placeholder.png\"></div> lorem ipsum", "\n# Phase 1: setup\n# Phase 2: run\nThe agent will now respond."]


@operator()
def paste_artifacts_seeded(q):
    hits = {i: total_of(q, "t", ps) for i, (_, ps) in PASTE.items()}
    cases = " UNION ALL ".join(f"SELECT doc_id, '{i}' AS signal_id, {n} AS least, h{k} AS hits FROM h" for k, (i, (n, _)) in enumerate(PASTE.items()))
    cols = ", ".join(f"{h} AS h{k}" for k, h in enumerate(hits.values()))
    return f"""{src(q, CODE_SEEDS)}, h AS (SELECT doc_id, {cols} FROM p), u AS ({cases})
SELECT doc_id, signal_id, hits, CASE WHEN least = 1 THEN 0.85 ELSE least(0.95, round(0.5 + 0.15 * hits, 2)) END AS confidence FROM u WHERE hits >= least"""


def gates_sql(q: Spark, table: str, text: str, key: str, seeds: list[str]) -> str:
    like_code = f"({q.size(q.filter('ls', 'x', q.has('x', CODE_HINT)))} >= greatest(1, floor({q.size('ls')} / 10)) OR {q.has('t', MARKUP_HINT)})"
    rules = [(i, 1.0, f"({'true' if scope == 'text' else 'code'} AND {q.has('t', p)})") for i, (scope, p) in GATES.items()]
    return f"{src(q, seeds, f'{E.lines(q, chr(116))} AS ls', table=table, text=text, key=key)}, c AS (SELECT *, {like_code} AS code FROM p), {fire(q, rules, 'c', key)} SELECT {key}, signal_id AS gate FROM fired"


@operator()
def gate_results_seeded(q):
    return gates_sql(q, "documents", "text", "doc_id", CODE_SEEDS)


@operator("pages")
def gate_results_pages(q):
    return gates_sql(q, "pages", "html", "page_id", [])


@operator("pages")
def page_markup_stats(q):
    """Tags, links, blank anchors and text share of raw pages."""
    text = q.sub("t", "<[^>]*>", " ")
    return f"WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages) SELECT page_id, {q.count('t', '<[a-zA-Z]')} AS n_tags, {q.count('t', '(?i)<a ')} AS n_links, {q.count('t', '(?i)<p[ >]')} AS n_paragraphs, {E.ratio(q, f'length({text})', 'length(t)', 4)} AS text_share FROM p"


@operator()
def hardcoded_secrets(q):
    secret = "(?i)(?:api_?key|token|secret|passwd|password)\\s*[=:]\\s*[\"'][A-Za-z0-9_\\-]{8,}[\"']"
    return f"SELECT doc_id, {q.count(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')', secret)} AS n FROM documents WHERE {q.has('text', secret)}"


# Fixed values, but for the seeds.
COMMIT_SEEDS = ["", "This PR updates the loader to improve readability and maintainability.", "This commit implements paging as per the requirements. Improve code readability and maintainability.", "{\"description\": \"A comprehensive suite\", \"title\": \"todo later\", \"summary\": \"various things\"}", "\n# Configuration for nginx\n# This script contains helpers\n# Create a storage bucket", "LGTM, looks good to me, thanks", "Looks good, but parse_config() drops line 12"]
COMMIT = [r"(?i)this\s+(?:pr|mr|commit|cl|change|patch)[^.\n]{0,80}?(?:to\s+)?improves?\s+(?:code\s+)?(?:readability|maintainability|clarity|robustness|performance|consistency)", r"(?i)improv[\p{L}\p{N}_]*\s+(?:the\s+)?(?:code\s+)?(?:readability|maintainability|clarity)(?:\s+(?:and|&)\s+(?:the\s+)?(?:readability|maintainability|clarity))+", r"(?i)this\s+(?:pr|mr|commit)\s+(?:implements|adds|introduces)[^\p{L}\p{N}_.\n](?:[^.\n]{0,59}[^\p{L}\p{N}_.\n])?as\s+(?:per\s+)?(?:the\s+)?(?:requirements?|spec|request|discussion)", r"(?im)^\s*(?:i\s+have\s+|i've\s+)?(?:implemented|updated|added|fixed)[^\p{L}\p{N}_.\n](?:[^.\n]{0,59}[^\p{L}\p{N}_.\n])?(?:for\s+you|as\s+requested|as\s+asked)" + NB]
JSON_KEY = "\"(?:description|summary|title|notes?|comment|details?)\"\\s*:\\s*\""
JSON_FIELDS = ["(?i)" + JSON_KEY + "[^\"]{0,120}?(?:a\\s+comprehensive|a\\s+powerful|a\\s+versatile|various|multiple|several|numerous)(?:[^\\p{L}\\p{M}\\p{N}_\"][^\"]{0,119})?\"", "(?i)" + JSON_KEY + "(?:[^\"]{0,59}[^\\p{L}\\p{M}\\p{N}_\"])?todo(?:[^\\p{L}\\p{M}\\p{N}_\"][^\"]{0,59})?\"", "(?i)(?:" + "|".join(f"\"{k}\"\\s*:\\s*\"the\\s+{k}\\s+(?:of|for)" for k in ("description", "summary", "title", "notes", "comment", "details")) + ")" + NB]
CONFIG = [r"(?im)^\s*#\s*(?:install(?:ing)?|setup|configure|copy|update)\s+(?:the\s+)?(?:dependencies|requirements|files?|packages?)\s*\n\s*(?:RUN|COPY|ADD|apt-get|pip|npm)" + NB, r"(?im)^\s*#\s*(?:configuration|settings?|config)\s+for\s+[\p{L}\p{N}_.-]+\s*$", r"(?im)^\s*#\s*create\s+(?:a|an)\s+[\p{L}\p{N}_-]+\s+(?:resource|bucket|group|instance|role|policy)\s*$", r"(?im)^\s*#\s*this\s+(?:script|file|config|section)\s+(?:does|contains|defines|sets up)" + NB]
REVIEW = r"(?i)" + B + r"(?:lgtm|looks?\s+good|good\s+catch|nice\s+(?:catch|work|job)|great\s+(?:work|catch|job)|well\s+done|approved?|ship\s+it|thanks(?:\s+for\s+this)?|consider\s+(?:adding|updating|checking)|sieht\s+gut\s+aus|einverstanden|danke|gut\s+gemacht|sehr\s+gut)" + NB
ANCHOR = r"`|[a-z0-9]+_[a-z0-9]+|[a-z]+[A-Z][a-z]+|[A-Z]{3,}|[a-zA-Z0-9]+\(|#[0-9]+|[0-9]|[a-z0-9]+/[a-z0-9]+"


def metadata(q: Spark, signal: str, patterns: list[str]) -> str:
    hits = "(" + " + ".join(f"CASE WHEN {q.has('t', p)} THEN 1 ELSE 0 END" for p in patterns) + ")"
    return f"SELECT doc_id, '{signal}' AS signal_id, {hits} AS hits FROM p"


@operator()
def metadata_findings_seeded(q):
    """Commit messages, JSON fields and configuration comments: two distinct patterns or more."""
    parts = " UNION ALL ".join(metadata(q, s, p) for s, p in (("CommitMessageSlop", COMMIT), ("JsonFieldSlop", JSON_FIELDS), ("ConfigBoilerplateSlop", CONFIG)))
    return f"{src(q, COMMIT_SEEDS)}, u AS ({parts}) SELECT doc_id, signal_id, hits, least(0.95, round(0.5 + 0.15 * hits, 2)) AS confidence FROM u WHERE hits >= 2"


@operator()
def review_comments_seeded(q):
    """A comment with a generic marker and no anchor once the marker is gone fits any change."""
    rest = q.sub("t", REVIEW, " ")
    return f"{src(q, COMMIT_SEEDS)} SELECT doc_id, 'ReviewApprovalSlop' AS signal_id, cast(0.4 AS DOUBLE) AS confidence FROM p WHERE nw >= 2 AND {q.has('t', REVIEW)} AND NOT {q.has(rest, ANCHOR)}"


@operator("conversations")
def chat_preamble_turns(q):
    """Assistant turns that open with a preamble, with one seeded in every fifth conversation."""
    t = "concat(CASE WHEN conv_id % 5 = 0 THEN 'Certainly! ' WHEN conv_id % 5 = 1 THEN 'Sure, here''s the updated version. ' ELSE '' END, coalesce(text, ''))" if q.name == "duckdb" else "concat(CASE WHEN conv_id % 5 = 0 THEN 'Certainly! ' WHEN conv_id % 5 = 1 THEN 'Sure, here\\'s the updated version. ' ELSE '' END, coalesce(text, ''))"
    return f"WITH p AS (SELECT conv_id, turn, {t} AS t FROM conversations WHERE role = 'assistant') SELECT conv_id, turn FROM p WHERE {q.has('t', '(?i)^[ ]*(?:certainly|of course|sure|absolutely)[!,.]')}"


MARKUP_SEEDS = ["", "\n# Big Title Here\n### Deep Part Now\n---\n---\n---\n", "\n| a | b |\n|---|---|\n| 1 | 2 |\n", "\n**One** is bold. **Two** is bold. **Three** is bold. **Four** is bold.", "\n## Small steps\n### more small steps\n"]


@operator()
def markup_findings_seeded(q):
    heads = q.filter("ls", "x", q.has("x", r"^#{1,6}[\s]+[^\s]"))
    cap = lambda y: q.size(q.all(y, r"(?:^|[^A-Za-z'-])[A-Z][A-Za-z'-]*"))
    small = r"(?i)(?:^|[^A-Za-z'-])(?:of|the|for|to|in|on|a|an|and|or|with|at|by)(?:$|[^A-Za-z'-])"
    words = lambda y: f"({q.size(q.all(y, r'[A-Za-z][A-Za-z' + chr(39) + '-]*'))} - {q.count(y, small)})"
    titled = q.filter("hs", "y", f"{words('y')} > 0 AND {cap('y')} >= 0.7 * {words('y')}")
    bold = q.size(q.filter(E.sentences_kept(q, "pp"), "y", q.has("y", r"[*][*][^*\n]+[*][*]")))
    breaks = q.count("t", r"(?m)^(?:---+|[*][*][*]+|___+)[ \t]*$")
    rules = [
        ("ExcessiveThematicBreaks", 0.5, f"({breaks} >= 3 AND {breaks} * 1000.0 > 2.0 * {q.size(q.all('t', E.WORD))})"),
        ("TitleCaseHeadings", 0.5, f"{q.size(titled)} > 0.7 * {q.size('hs')}"),
        ("BoldMidSentenceDensity", 0.5, f"{q.size(q.filter('paras', 'pp', f'{bold} > 2'))} > 0"),
    ]
    return f"{src(q, MARKUP_SEEDS, f'{E.lines(q, chr(116))} AS ls, {E.paragraphs(q, chr(116))} AS paras')}, p2 AS (SELECT *, {heads} AS hs FROM p), {fire(q, rules, 'p2')} SELECT doc_id, signal_id, confidence FROM fired"


@operator()
def heading_jumps_seeded(q):
    """Headings that lie two levels or more below the heading before them."""
    x = q.explode("doc_id", "p", "ls", "pos", "line")
    return f"""{src(q, MARKUP_SEEDS, f'{E.lines(q, chr(116))} AS ls')}, x AS ({x}), h AS (SELECT doc_id, pos, length(line) - length({q.sub('line', '^#+', '')}) AS level FROM x WHERE {q.has('line', '^#{1,6}[ ]+[^ ]')}),
j AS (SELECT doc_id, pos, level, lead(level) OVER (PARTITION BY doc_id ORDER BY pos) AS next_level FROM h) SELECT doc_id, pos AS line_no, level, next_level FROM j WHERE next_level - level >= 2"""


@operator()
def single_row_tables_seeded(q):
    """Tables of exactly one data row: runs of lines that start with a bar, as islands."""
    x = q.explode("doc_id", "p", "ls", "pos", "line")
    return f"""{src(q, MARKUP_SEEDS, f'{E.lines(q, chr(116))} AS ls')}, x AS ({x}), b AS (SELECT doc_id, pos, line, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM x WHERE {q.has('line', r'^[ \t]*[|]')}),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, island ORDER BY pos) AS k FROM b),
g AS (SELECT doc_id, island, count(*) AS n, max(CASE WHEN k = 2 AND NOT {q.has('line', '[^|:\\s-]')} THEN 1 ELSE 0 END) AS ruled FROM r GROUP BY doc_id, island)
SELECT doc_id, count(*) AS n_tables FROM g WHERE n = 3 AND ruled = 1 GROUP BY doc_id"""


@operator()
def circular_explanations_seeded(q):
    """Sentences whose predicate repeats a stem of the subject and adds at most three new stems."""
    verbs = ["is", "are", "means", "validates", "ensures", "provides", "verifies", "secures", "defines", "describes", "refers", "bedeutet", "heisst", "heißt", "definiert", "beschreibt"]
    stop = "the a an of to and or for in on with that this it its by as at be was were der die das den dem ein eine einer eines und oder fuer für in im auf mit von vom".split()
    seeds = ["", "Validation means that the validator validates a value.", "The cat sleeps on a mat all day long.", "Security ensures secure systems."]
    stems = lambda a: q.distinct(q.map(q.filter(a, "w", f"length(w) >= 4 AND NOT {q.contains(q.array_of(stop + verbs), 'w')}"), "w", "substring(w, 1, 4)"))
    cutter = r" (?:" + "|".join(verbs) + r") "
    x = q.explode("doc_id", "s", "ss", "pos", "y")
    flat = q.join(E.tokens(q, "y"), " ")
    return f"""{src(q, seeds)}, s AS (SELECT doc_id, {E.sentences(q, 't')} AS ss FROM p), x AS ({x}), j AS (SELECT doc_id, pos, {flat} AS line FROM x),
v AS (SELECT doc_id, pos, line, {q.sub("concat(' ', line)", cutter + '.*$', '')} AS head FROM j WHERE {q.has("concat(' ', line)", cutter)}),
w AS (SELECT doc_id, pos, {stems(q.split('head', ' '))} AS a, {stems(q.split("substring(concat(' ', line), length(head) + 1)", ' '))} AS b, {q.size(q.split('line', ' '))} AS n FROM v)
SELECT doc_id, pos FROM w WHERE n >= 5 AND {q.size(q.common('a', 'b'))} > 0 AND {q.size('b')} - {q.size(q.common('a', 'b'))} <= 3"""
