"""More detect-only findings: micro patterns, rhetoric, code, pull requests, German structure, and the masks that
keep terms from being counted.

Rules are conditions over arrays (sentences, lines) of one text, evaluated in one pass. Word edges are consumed,
as both engines read them alike; a rule on the sentence before is a rule on pairs of neighbours.
"""

from __future__ import annotations

from plumbline.functions import expressions as E
from plumbline.functions.dialect import Spark
from plumbline.functions.lexicon import STOPWORDS
from plumbline.operators.signals import GERMAN_WORDS, NB, B, any_of, findings, fire, src
from plumbline.plans.catalog import operator

# --- fixed values: micro patterns -------------------------------------------------------------------
INANIMATE_SUBJECTS = ["decision", "data", "strategy", "system", "market"]
HUMAN_VERBS = ["emerges", "decides", "believes", "realizes", "knows"]
FINANCE_OBJECTS = ["gain", "gains", "profit", "profits", "loss", "losses", "return", "returns", "revenue"]
GRAND_ENDPOINTS = ["big bang", "dark matter", "atoms", "galaxies", "dinosaurs", "quantum", "roman empire", "stone age", "printing press", "steam engine", "microchips", "cave paintings", "black holes", "fire", "the wheel"]
ABSTRACT_DOMAINS = {
    "tech": ["scalability", "latency", "throughput", "uptime", "performance", "reliability", "bandwidth", "observability", "deployments", "infrastructure", "architecture", "automation", "integration"],
    "emotion": ["passion", "joy", "fear", "hope", "empathy", "wonder", "anxiety", "delight", "belonging", "nostalgia"],
    "business": ["revenue", "growth", "profit", "churn", "retention", "margin", "valuation", "market share", "conversion", "pipeline"],
    "meaning": ["meaning", "truth", "ethics", "existence", "consciousness", "purpose", "identity", "justice", "freedom", "beauty"],
    "society": ["politics", "culture", "history", "education", "inequality", "community", "power", "trust", "institutions", "migration"],
    "craft": ["craft", "design", "storytelling", "aesthetics", "technique", "composition", "typography", "rhythm", "voice"],
}
BOUNDARY_WORDS = ["and", "or", "plus", "with", "without", "of", "in", "into", "through", "via", "for", "than"]
MICRO_RECAP = ["in conclusion", "overall,", "to summarize"]
AGENTLESS_VERBS = ["decided", "determined", "concluded", "agreed", "noted", "made", "implemented", "established", "addressed", "resolved", "mitigated", "optimized", "ensured", "validated", "chosen", "selected"]
NAME_DROP_LEADINS = ["featured in", "as featured in", "seen in", "as seen in", "seen on", "as seen on", "covered by", "mentioned in", "praised by", "endorsed by", "trusted by", "recommended by", "highlighted in", "spotlighted in"]
NAME_DROP_KEEP_VERBS = ["compared", "tested", "benchmark", "benchmarked", "analyzed", "analysed", "reviewed", "studied", "interviewed", "surveyed", "evaluated", "ranked", "audited", "measured", "mapped"]
MAX_NON_LIST_WORDS = 6
PURITY_RITUAL = r"(?i)" + B + r"(?:ai\s+is\s+theft|pass\s+it\s+on|block\s+me\s+if\s+you\s+(?:use|support|like)\s+(?:any\s+)?ai|if\s+you\s+use\s+ai,?\s+block\s+me|(?:100%|one\s+hundred\s+percent)\s+(?:human[- ]written|human[- ]made)|no\s+ai\s+was\s+(?:used|involved|harmed)|ai[- ]?tools?\s+nutzt,?\s+hat\s+als\s+mensch|ai[- ]?avatar\s+hat,?\s+ist\s+blockiert|nicht\s+verhandeln|wer\s+(?:[^.!?]{0,79}[^\p{L}\p{M}\p{N}_.!?])?ist\s+teil\s+des\s+problems|keine\s+unschuldigen\s+zuschauer|schauen\s+ist\s+schon\s+position)" + NB
PURITY_DISCLOSURE = r"(?i)" + B + r"(?:watermark|watermarked|provenance|disclosure|pursuant|compliance|licence|license|verified|certified|per\s+(?:the\s+)?(?:policy|contract|requirement|guideline)|evaluation|benchmark)" + NB
VIBE_CODING = r"(?i)" + B + r"vibe[- ]?cod(?:e|ed|er|ing)" + NB
VIBE_FAILURE = r"(?i)" + B + r"(?:outage|broke|broke\s+down|down|downtime|incident|failure|crashed|went\s+down|meltdown|ausfall|störung)" + NB
VIBE_DENIAL = r"(?i)" + B + r"(?:keine\s+(?:meldung|logs?|untersuchung|postmortem)|man\s+braucht\s+keine\s+meldung|no\s+logs?\s+needed|wir\s+wissen\s+alle|we\s+all\s+know|my\s+foot)" + NB
VIBE_TECHNICAL = r"(?i)" + B + r"(?:commit|deploy|config|database|query|migration|log|cache|regex|race\s+condition|index|schema|load\s+balancer|dns|certificate|token|timeout|revert|rollback|hotfix)" + NB
SALVATION = r"(?i)" + B + r"(?:against\s+all\s+odds|humble\s+beginnings|no\s+one\s+believed|laughed\s+(?:at|me\s+out)|rejected\s+by\s+everyone|slept\s+in\s+(?:a|my)\s+car|lost\s+everything|down\s+to\s+(?:my|his|her)\s+last\s+[$]?[0-9]+|tears\s+(?:of|streamed)|cried\s+(?:when|tears|for)|(?:never|still\s+can(?:'t|\s+not))\s+(?:believe|imagined)|(?:life|everything)\s+(?:is|was|has\s+been)\s+(?:changed|never\s+the\s+same)|forever\s+grateful|best\s+decision\s+(?:i|we|he|she)\s+ever\s+made)" + NB
SALVATION_MONEY = r"(?i)" + B + r"(?:ai|a[.]i[.]|chatgpt|gpt-?[0-9]|grok|claude|gemini|midjourney|automation|bot)" + NB + r"|[$]\s?[0-9]"
RITUAL = r"(?i)" + B + r"(?:only\s+[\p{L}\p{N}_]+\s+can\s+save" + NB + r"(?:[^.!?]*[^\p{L}\p{M}\p{N}_.!?])?everyone\s+else|teilt\s+(?:es|das),?\s+bevor\s+es\s+gelöscht\s+wird|lügenpresse|liken\s*(?:=|ist)\s*loyalitäts?|wer\s+nicht\s+liked|nur\s+noch\s+[\p{L}\p{N}_]+\s+kann\s+(?:[^.!?]*[^\p{L}\p{M}\p{N}_.!?])?retten|alle\s+anderen\s+sind\s+teil\s+des\s+problems|eine\s+bewegung,?\s+ein\s+wille)" + NB
# --- fixed values: rhetoric, code, pull requests, German structure -----------------------------------
COLON_LABELS = ["note", "notes", "warning", "caution", "tip", "tips", "example", "summary", "todo", "fixme", "update", "edit", "caveat", "disclaimer", "source", "sources", "author", "version", "abstract", "aside", "reminder", "important", "hint", "definition", "goal", "problem", "solution", "input", "output", "usage"]
PRAISE = ["danke für diesen", "danke fuer diesen", "spannender beitrag", "spannender punkt", "toller beitrag", "großartiger beitrag", "grossartiger beitrag", "wichtiger beitrag", "super beitrag", "great post", "great read", "love this post", "this resonates", "thanks for sharing", "thank you for sharing", "thanks so much for sharing", "couldn't agree more", "excellent read", "powerful post", "couldn’t agree more"]
PARAPHRASE = ["sie schreiben", "sie beschreiben", "sie erwähnen", "sie erwaehnen", "in ihrem beitrag", "wie sie sagen", "you describe", "you mention", "your post", "you write"]
ADDON = ["ein weiterer aspekt", "ein weiterer punkt", "ein weiterer gedanke", "ergänzend", "ergaenzend", "hinzu kommt", "ergänzen möchte", "ergaenzen moechte", "to add", "adding to this", "one more thing", "i'd add", "i’d add", "my two cents", "worth adding", "here's what i'd add", "one thing i'd add"]
CLOSING_QUESTIONS = ["wie sehen sie das", "was ist ihre erfahrung", "was sind ihre erfahrungen", "what are your thoughts", "how do you see this", "what has been your experience"]
CHATBOT = ["i hope this helps", "great question", "happy to help", "as an ai", "i'm just an ai", "you're absolutely right", "that's a great point", "as of my last update", "let me know if you have any questions"]
COMMIT_KEYWORDS = r"(?i)" + B + r"(?:enhancing|seamlessly|comprehensive|holistic|robustly|leveraging|streamlining|empowering)" + NB
GERUND_BULLETS = r"(?m)^[\s]*[-*]\s+[\p{L}\p{N}_]+ing(?:$|[^\p{L}\p{M}\p{N}_.\n][^.\n]{0,59}$)"
TITLE_BLOCKED = r"(?i)" + B + r"(?:comprehensive|seamless|seamlessly|amazing|revolutionary|cutting-edge|state-of-the-art|game-?changer|robust)" + NB
PR_EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2700}-\x{27BF}]"
MESSAGE_LENGTH, MIN_RULES, MOCK_THRESHOLD, DEFENSIVE_THRESHOLD = 200, 2, 2, 3
RECAP_HEADINGS = ["fazit", "zusammenfassung", "fazit und ausblick", "fazit & ausblick", "resümee"]
GREETING = r"(?m)^(?:Sehr geehrte[rn]?\s+[^\n,]+|Liebe[rn]?\s+[^\n,]+|Guten Tag|Hallo\s+[^\s]+)[ \t]*,?[ \t]*$"
CLOSING = r"(?im)^(?:Mit freundlichen Grüßen|Mit besten Grüßen|Viele Grüße|Herzliche Grüße|Beste Grüße|Liebe Grüße)[ \t]*!?[ \t]*$"
SUBJECT = r"(?im)^Betreff[ \t]*:.*$"
MIN_FAZIT_WORDS, MIN_BULLETS, MAX_PHRASE_WORDS = 30, 4, 10
# --- fixed values: masks ---------------------------------------------------------------------------
PERFORMED = ["here's the thing nobody tells you", "nobody tells you", "i'm going to be honest with you", "let me be brutally honest", "i don't say this lightly", "unpopular opinion, but", "call me old-fashioned, but"]
LIVED = r"(?:when\s+i|in\s+my\s+(?:own\s+)?(?:experience|case)|i\s+(?:lost|spent|learned|tried|failed|was|found)|i(?:’ve|’m| have)\s+(?:seen|learned|made|been))"
URGENT = ["in today's fast-paced", "the stakes have never been higher", "now more than ever", "at a critical juncture", "time is running out", "don't get left behind", "before it's too late"]
CONCRETE = r"(?:(?:deadline|due)" + NB + r"[^\n]{0,39}[0-9]|(?:by|until|before)\s+(?:[0-9]{1,2}\s+)?(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday|january|february|march|april|may|june|july|august|september|october|november|december)|[0-9]{1,2}[./-][0-9]{1,2}(?:[./-][0-9]{2,4})?|[0-9]+(?:[.,][0-9]+)?\s?(?:%|eur|usd|euros?|dollars?|days?|weeks?|hours?|minutes?))"
WINDOW, SIGNOFF_WINDOW = 120, 100
SIGNOFF = r"(?:best regards|kind regards|warm regards|regards|cheers|sincerely|best wishes|many thanks|thanks(?: in advance)?|thank you|mit freundlichen gr(?:u|ü)ß(?:en)?|viele gr(?:u|ü)ße|beste gr(?:u|ü)ße)"
ATTRIBUTED = r"most people([,.]?\s+(?:i|we)\s+(?:interviewed|surveyed|asked|polled|spoke\s+(?:with|to)|heard\s+from)|\s+(?:i|we)\s+know|\s+(?:in|on)\s+(?:my|our)\s+(?:survey|team|company|street|feed|timeline))"
ML_CONTEXT = r"(?:model|models|training|train|inference|embedding|embeddings|multimodal|tensor|tensors|gradient|loss|dataset|datasets|neural|transformer|transformers|classifier|classification|regression|dimension|dimensions|layer|layers|token|tokens|attention|encoder|decoder|checkpoint|fine-?tun(?:e|ing)|llm|gpt|bert|image|vision|audio|signal processing|mathematics|physics|evaluation|evaluations|benchmark|benchmarks|pipeline|pipelines|superglue|glue)"
ML_GUARDED = ["modalities", "modality", "vectors", "vector", "paradigms", "paradigm", "harnesses", "harness"]
# --- end of fixed values ---------------------------------------------------------------------------

MICRO_SEEDS = ["", "The system decides what you see. The market realizes a gain.", "It runs from the Big Bang to dark matter. From scalability to passion it goes.", "Overall, mistakes were made. It was decided that nothing helps.", "Seen in Forbes, Wired, The Verge, and Nature.", "AI is theft. Pass it on. Is the service down again? Vibe-coded mess.", "They laughed at me. I lost everything. Then ChatGPT: my life was changed, $5 a day. Against all odds.", "\n# Rhythm and voice\nRhythm and voice matter here.", "A verified watermark: no AI was used. We tested Forbes, Wired, and Nature."]
MORE_SEEDS = ["", "The real lever: patience.", "Great post! You mention speed. One thing I'd add is cost. What are your thoughts?", "The option is documented. I hope this helps!", "\n**Performance:** Performance improved by a fifth.", "Note: this is fine. what people want from it: more time.", "Great read. Is it so?"]
PROGRAM_SEEDS = ["", "\nconst a = b as unknown as Foo\nlet c = d as any", "\nfunction f(x) {\n  const r: Record<string, unknown> = x\n  return r as Foo\n}", "\ntry:\n    a()\nexcept Exception:\n    pass\ntry:\n    b()\nexcept:\n    pass\ntry:\n    c()\nexcept E:\n    pass", "\njest.mock('a')\nvi.mock('b')", "\nx = 1  # use this as any other helper\nmonkeypatch.setattr(a, 'b')"]
PR_SEEDS = ["", " 🚀🚀 A comprehensive rewrite with `lost_name` inside", "\n\nIt touches `engine` only.\n+++ b/src/engine.py\n", "\n\nEnhancing things.\n- Adding more\n- Fixing it\n"]
GERMAN_SEEDS = ["", " und der die das ist nicht ein\n# Fazit\nDas ist gut.\n", " und der die das ist nicht ein\nBetreff: Anfrage\nSehr geehrte Frau Muster,\nTexte folgen.\nMit freundlichen Grüßen\n", " und der die das ist nicht ein\n- Erste Sache.\n- Zweite Sache.\n- Dritte Sache.\n- Vierte Sache.\n", "\n- First thing.\n- Second thing.\n"]
MASK_SEEDS = ["", " Nobody tells you this. When I started I lost a year.", " Time is running out: the deadline is 3 May. Now more than ever.", " Hope this helps. Best regards, A", " Most people I know agree; most people don't.", " The model reads a new modality. A vector of change; the paradigm holds."]


def words(q: Spark, x: str) -> str:
    """Content words of a text in order: letters, at least three, and no stop word."""
    return q.filter(q.all(f"lower({x})", "[a-z']+"), "w", f"length(w) > 2 AND NOT {q.contains(q.array_of(STOPWORDS), 'w')}")


def count_if(q: Spark, a: str, v: str, body: str) -> str:
    return f"({q.size(q.filter(a, v, body))} > 0)"


def neighbours(q: Spark, a: str, join: str = "\x02") -> str:
    """Each element after the one before it, with join between; the first has an empty one before."""
    if q.name == "spark":
        return f"transform({a}, (y, i) -> concat(CASE WHEN i > 0 THEN element_at({a}, i) ELSE '' END, {q.lit(join)}, y))"
    pairs = q.filter(f"list_zip(list_concat([''], {a}), {a})", "z", "z[2] IS NOT NULL")
    return q.map(pairs, "z", f"concat(z[1], {q.lit(join)}, z[2])")


def split_in(q: Spark, x: str, i: int) -> str:
    return f"split_part({x}, {q.lit(chr(2))}, {i})"


def endpoint(q: Spark, x: str) -> str:
    """Domain of the head of a range's end: of its longest beginning that is a known noun and ends at a boundary word, or of all of it;
    plurals count as their singulars, grand endpoints are a domain of their own."""
    body = q.sub(f"lower({x})", r"^\s*(?:the\s+)?|\s+(?:" + "|".join(BOUNDARY_WORDS) + r")(?:\s.*)?$", "")
    nouns = [(d, n) for d, some in ABSTRACT_DOMAINS.items() for n in some]
    cases = " ".join(f"WHEN b IN ({q.lit(n)}, {q.lit(n + 's')}) THEN {q.lit(d)}" for d, n in nouns)
    return q.let(body, "b", f"CASE WHEN b IN ({', '.join(q.lit(g) for g in GRAND_ENDPOINTS)}) THEN 'grand' {cases} ELSE '' END")


@operator()
def micro_findings_seeded(q):
    """False agency and ranges, recap endings, repeated headings, claims without an actor, name drops, purity bans, vibe
    scapegoats and salvation stories. A range's end is read up to a boundary word or a mark."""
    agency = r"(?i)^the\s+(?:" + "|".join(INANIMATE_SUBJECTS) + r")\s+(?:" + "|".join(HUMAN_VERBS) + ")" + NB
    finance = r"(?i)" + B + r"realiz(?:es?|ed|ing)\s+(?:a|an|the|their|its)?\s*(?:" + "|".join(FINANCE_OBJECTS) + ")" + NB
    claim = r"(?i)" + B + r"(?:it|this|that)\s+(?:was|were|is|are|has been|have been)\s+(?:" + "|".join(AGENTLESS_VERBS) + r")\s+(?:that|to)" + NB + r"|[A-Za-z ]{2,40}?\s+(?:was|were|is|are)\s+(?:" + "|".join(AGENTLESS_VERBS) + ")" + NB + "|" + B + r"mistakes\s+were\s+made" + NB
    actor = f"NOT {q.has('y', '(?i)' + B + 'by[ ]+[A-Za-z]')} AND NOT {q.has('y', '(?i)' + B + '(?:shall|must)' + NB)} AND NOT {q.has('y', '(?i)^(?:we|i|you)' + NB)}"
    item = r"(?:[Tt]he\s+)?[A-Z][\p{L}\p{N}_&.'’-]*(?:\s+[A-Z][\p{L}\p{N}_&.'’-]*)*"
    enum = rf"{item}(?:\s*,\s*(?:and\s+|or\s+)?{item}){{2,}}"
    leads = "|".join(sorted(NAME_DROP_LEADINS, key=len, reverse=True))
    outside = q.size(q.filter(q.all(q.sub(f"lower({q.sub('y', enum, ' ')})", leads, " "), "[a-z']+"), "w", f"NOT {q.contains(q.array_of(STOPWORDS), 'w')}"))
    listed = f"{q.has('y', enum)} AND NOT {any_of(q, 'lower(y)', NAME_DROP_KEEP_VERBS)} AND {outside} <= {MAX_NON_LIST_WORDS}"
    prose = q.filter("ls", "l", f"NOT {q.has('l', '^[ \t]*(?:[-*>(#0-9]|\\[)')} AND NOT contains(lower(l), 'http')")
    ranges = q.all("t", r"(?i)from\s+(?:the\s+)?[a-z][a-z\s]{2,30}?\s+to\s+(?:the\s+)?[a-z][a-z\s]{2,30}")
    left, right = endpoint(q, q.sub("y", r"(?i)^from\s+|\s+to\s+(?s:.*)$", "")), endpoint(q, q.sub("y", r"(?i)^(?s:.*?)\s+to\s+", ""))
    apart = q.let(left, "a", q.let(right, "z", "a <> '' AND z <> '' AND (a <> z OR a = 'grand') AND (a = 'grand') = (z = 'grand')"))
    first, last = words(q, f"coalesce({q.at('sk', 1)}, '')"), words(q, f"coalesce({q.at('sk', -1)}, '')")
    recap = f"{q.size('sk')} >= 2 AND ({' OR '.join(q.starts(f'lower({q.at(chr(115) + chr(107), -1)})', o) for o in MICRO_RECAP)}) AND {q.size(q.distinct(first))} > 0 AND {q.size(q.common(q.distinct(first), q.distinct(last)))} >= 0.3 * {q.size(q.distinct(first))}"
    head, below = words(q, split_in(q, "y", 1)), words(q, split_in(q, "y", 2))
    two = q.distinct(f"slice({below}, 1, 2)" if q.name == "spark" else f"list_slice({below}, 1, 2)")
    repeated = f"{q.has(split_in(q, 'y', 1), '^#{1,6}[ \t]')} AND {q.size(q.distinct(head))} >= 2 AND {q.size(two)} >= 2 AND {q.size(q.common(two, head))} >= 2"
    now, prior = split_in(q, "y", 2), split_in(q, "y", 1)
    vibe = f"NOT {q.has(now, VIBE_TECHNICAL)} AND (({q.has(now, VIBE_CODING)} OR {q.has(now, VIBE_DENIAL)}) AND ({q.has(now, VIBE_FAILURE)} OR {q.has(prior, VIBE_FAILURE)}))"
    arc = q.size(q.distinct(q.all("lo", SALVATION)))
    rules = [
        ("FalseAgency", 0.6, count_if(q, "sk", "y", f"{q.has('y', agency)} AND NOT {q.has('y', finance)}")),
        ("FalseRange", 0.6, f"(contains(lo, 'from') AND {count_if(q, ranges, 'y', apart)})"),
        ("RecapEnding", 0.6, f"({recap})"),
        ("HeadingRepeatedBelowItself", 0.5, f"(contains(t, '#') AND {count_if(q, neighbours(q, 'lx'), 'y', repeated)})"),
        ("ActorlessClaim", 0.6, f"({any_of(q, 'lo', AGENTLESS_VERBS)} AND {count_if(q, 'sk', 'y', f'{actor} AND {q.has(chr(121), claim)}')})"),
        ("NameDropList", 0.6, count_if(q, "pk", "y", listed)),
        ("PurityBan", 0.55, count_if(q, "sk", "y", f"{q.has('y', PURITY_RITUAL)} AND NOT {q.has('y', PURITY_DISCLOSURE)}")),
        ("VibeScapegoat", 0.55, count_if(q, neighbours(q, "sk"), "y", vibe)),
        ("SalvationModel", 0.6, f"({count_if(q, 'sk', 'y', q.has('y', RITUAL))} OR ({arc} >= 2 AND {count_if(q, 'sk', 'y', f'{q.has(chr(121), SALVATION)} AND {q.has(chr(121), SALVATION_MONEY)}')}))"),
    ]
    full = q.filter("ls", "l", f"{E.trim(q, 'l')} <> ''")
    more = f"{E.sentences_kept(q, 't')} AS sk, {E.lines(q, 't')} AS ls"
    pieces = E.sentences_kept(q, q.join(prose, "\n"))
    return f"{src(q, MICRO_SEEDS, more)}, p2 AS (SELECT *, {full} AS lx, {pieces} AS pk FROM p), {fire(q, rules, 'p2')} SELECT doc_id, signal_id, confidence FROM fired"


def place(q: Spark, x: str, terms: list[str]) -> str:
    """The first place of any of the terms, from 1; 0 without one."""
    at = "instr({}, {})" if q.name == "spark" else "strpos({}, {})"
    places = q.filter(q.array(*(at.format(x, q.lit(t)) for t in terms)), "i", "i > 0")
    return f"coalesce({'array_min' if q.name == 'spark' else 'list_min'}({places}), 0)"


@operator()
def rhetorical_more_seeded(q):
    """Colon reveals, the engagement comment (three of praise, paraphrase, addition and closing question in this order),
    chatbot leftovers and headers that the sentence after them repeats."""
    reveals = q.all("t", r"(?m)(?:^|[.!?]\s+)[A-Z][a-z]+(?:[ ]+[\p{L}\p{N}_'’-]+){0,5}:\s+[a-z][^,:.!?\n]{3,60}(?:[.!?]|$)")
    label = q.sub("lower(y)", r"^[.!?]*\s*|:(?s:.*)$", "")
    connector = q.has("t", r"(?m)[a-z][\p{L}\p{N}_'’-]+(?:[ ]+[\p{L}\p{N}_'’-]+){2,7}:\s+[a-z][^,:.!?\n]{3,60}(?:[.!?]|$)")
    asked = f"({q.has('lo', '[?][[:space:]]*$' if q.name != 'spark' else '[?][ \t\r\n]*$')} OR {any_of(q, 'lo', CLOSING_QUESTIONS)})"
    order = lambda a, z: f"({a} > 0 AND {a} < {z})"
    engaged = f"(({order('pr', 'pa')} AND {order('pa', 'ad')}) OR ({asked} AND ({order('pr', 'pa')} OR {order('pr', 'ad')} OR {order('pa', 'ad')}) AND NOT ({order('pa', 'pr')} AND {order('ad', 'pa')})))"
    headers = q.all("t", r"[*][*][A-Za-z][A-Za-z /&+-]{1,30}:[*][*]\s+[A-Za-z]+")
    again = f"{q.sub('lower(y)', '^[*]+|[^a-z](?s:.*)$', '')} = {q.sub('lower(y)', '^(?s:.*)[^a-z]', '')}"
    rules = [
        ("ColonReveal", 0.55, f"({count_if(q, reveals, 'y', f'NOT {q.contains(q.array_of(COLON_LABELS), label)}')} OR {connector})"),
        ("engagement_comment_default", 0.45, engaged),
        ("ChatbotLeftover", 0.8, any_of(q, "lo", CHATBOT)),
        ("InlineHeaderRestatement", 0.55, count_if(q, headers, "y", again)),
    ]
    more = f"{place(q, 'lo', PRAISE)} AS pr, {place(q, 'lo', PARAPHRASE)} AS pa, {place(q, 'lo', ADDON)} AS ad"
    return findings(q, MORE_SEEDS, rules, more)


@operator()
def code_findings_seeded(q):
    """Casts, mocks and empty handlers of source text, with how often they stand. A widening and a cast count together
    where both stand in one brace block of a function."""
    code = q.map("ls", "l", q.sub("l", r"(^|\s)(?:#|//).*$", " "))
    chained = q.size(q.filter("ls", "l", q.has("l", r"as\s+unknown\s+as\s+[\p{L}\p{N}_]+")))
    any_casts = q.sum(q.map(code, "l", f"cast({q.count('l', B + 'as[ ]+any' + NB)} AS BIGINT)"))
    blocks = q.all("t", r"(?m)(?:^|[^\p{L}\p{N}_\n])(?:function[^\p{L}\p{N}_]|\([^)\n]*\)[ ]*(?::[ ]*[a-zA-Z]+)?[ ]*=>)[^\n]*\n(?:[^}\n][^\n]*\n|\n)*\}")
    widen = r"Record<\s*string\s*,\s*unknown\s*>|as\s+unknown" + NB
    inner = q.filter(E.lines(q, "y"), "l", f"{q.has('l', B + 'as[ ]+[a-zA-Z]')} AND NOT {q.has('l', widen)}")
    asserted = q.size(q.filter(blocks, "y", f"{q.has('y', widen)} AND {q.size(inner)} > 0"))
    handlers = q.count("t", r"except[^\n]*:[ \t]*\n[ \t]+pass")
    mocks = f"({q.count('t', B + '(?:jest|vi)[.]mock[ ]*[(]')} + {q.count('t', 'monkeypatch[.](?:setattr|setenv|delenv|chdir)[ ]*[(]')})"
    return f"""{src(q, PROGRAM_SEEDS, f"{E.lines(q, 't')} AS ls")}, c AS (SELECT doc_id, {chained} AS chained_type_assertions, {any_casts} AS as_any_casts, {asserted} AS widen_then_assert, {handlers} AS defensive_try_pass, {mocks} AS mock_calls FROM p)
SELECT *, defensive_try_pass >= {DEFENSIVE_THRESHOLD} AS excessive_defensive_try, mock_calls >= {MOCK_THRESHOLD} AS module_mocking FROM c
WHERE chained_type_assertions + as_any_casts + widen_then_assert + defensive_try_pass + mock_calls > 0"""


@operator()
def pull_request_findings_seeded(q):
    """A text as a pull request: its first line is the title, files that its diff headers name are changed. Two rules of four fire."""
    refs = q.filter(q.all("t", "`[^`\n]{2,80}`"), "y", "true")
    files = q.filter("ls", "l", q.starts("l", "+++ b/"))
    dangling = q.filter(refs, "r", f"NOT contains(fs, {q.sub('r', '`', '')})")
    fired = [("title_emoji_count", f"{q.count('title', PR_EMOJI)} >= 2"), ("title_blocked_term", q.has("title", TITLE_BLOCKED)), ("dangling_code_reference", f"{q.size(dangling)} > 0"), ("long_keyword_message", f"length(t) > {MESSAGE_LENGTH} AND ({q.has('t', COMMIT_KEYWORDS)} OR {q.has('t', GERUND_BULLETS)})")]
    ids = q.filter(q.array(*(f"CASE WHEN {c} THEN '{n}' END" for n, c in fired)), "x", "x IS NOT NULL")
    return f"""{src(q, PR_SEEDS, f"{E.lines(q, 't')} AS ls")}, f AS (SELECT *, {q.at('ls', 1)} AS title, {q.join(files, chr(10))} AS fs FROM p), g AS (SELECT doc_id, {ids} AS ids FROM f)
SELECT doc_id, 'PRStructureSlop' AS signal_id, {q.join('ids', '|')} AS rules, least(0.95, round(0.5 + 0.15 * {q.size('ids')}, 2)) AS confidence FROM g WHERE {q.size('ids')} >= {MIN_RULES}"""


@operator()
def commit_keyword_findings_seeded(q):
    """A message with a keyword or gerund bullets that is long or has such bullets."""
    rules = [("CommitKeywordSlop", 0.7, f"({q.has('t', GERUND_BULLETS)} OR ({q.has('t', COMMIT_KEYWORDS)} AND length(t) > {MESSAGE_LENGTH}))")]
    return findings(q, PR_SEEDS, rules)


@operator()
def german_structure_seeded(q):
    """Recap headings with little below them, letter forms, and lists in English style, in German texts."""
    sections = q.split("concat(chr(10), t)", r"\n#{1,6}[ \t]+")
    titled = q.cut(sections, 2)
    title = q.sub(q.sub("lower(y)", r"\n(?s:.*)$", ""), r"^[\s]+|[\s:]+$", "")
    body = q.size(E.white_words(q, q.sub("y", r"^[^\n]*", "")))
    letter = " + ".join(f"CASE WHEN {q.has('t', p)} THEN 1 ELSE 0 END" for p in (SUBJECT, GREETING, CLOSING))
    blocks = q.all("concat(t, chr(10))", r"(?m)(?:^[ \t]*[-*+•][ \t]+[^\n]+\n)+")
    items = q.filter(q.map(E.lines(q, "y"), "l", q.sub("l", r"^[ \t]*[-*+•][ \t]+|[\s]+$", "")), "l", "l <> ''")
    english = q.let(items, "it", f"{q.size('it')} >= {MIN_BULLETS} AND {q.size(q.filter('it', 'l', q.has('l', '^[A-ZÄÖÜ]') + ' AND ' + q.has('l', '[.]$')))} = {q.size('it')} AND 2 * {q.size(q.filter('it', 'l', q.size(E.white_words(q, 'l')) + f' <= {MAX_PHRASE_WORDS}'))} >= {q.size('it')}")
    rules = [
        ("HollowFazitHeading", 0.65, count_if(q, titled, "y", f"{q.contains(q.array_of(RECAP_HEADINGS), title)} AND {body} < {MIN_FAZIT_WORDS}")),
        ("LetterStructure", 0.6, f"({letter} >= 2)"),
        ("BulletCapitalization", 0.55, count_if(q, blocks, "y", english)),
    ]
    hits = q.filter(q.all("lo", "[a-zäöüß]+"), "w", q.contains(q.array_of(GERMAN_WORDS), "w"))
    return f"{src(q, GERMAN_SEEDS, f'{hits} AS h')}, g AS (SELECT * FROM p WHERE {q.size(q.distinct('h'))} >= 3 OR {q.size('h')} >= 5), {fire(q, rules, 'g')} SELECT doc_id, signal_id, confidence FROM fired"


def masked(q: Spark, x: str) -> str:
    """The lower-case text without phrases that their surroundings excuse: performed voice near lived experience, urgency before a
    date or amount, a hope before a sign-off, people who were asked, and technical nouns in a technical sentence."""
    voice = "(?:" + "|".join(sorted(PERFORMED, key=len, reverse=True)) + ")"
    x = q.sub(x, rf"{voice}((?s:.){{0,{WINDOW}}}?{B}{LIVED}{NB})", " $1")
    x = q.sub(x, rf"({B}{LIVED}{NB}(?s:.){{0,{WINDOW}}}?){voice}", "$1 ")
    x = q.sub(x, rf"(?:{'|'.join(URGENT)})((?s:.){{0,{WINDOW}}}?[^\p{{L}}\p{{M}}\p{{N}}_]{CONCRETE})", " $1")
    x = q.sub(x, rf"hope this helps((?s:.){{0,{SIGNOFF_WINDOW}}}?{B}{SIGNOFF}{NB})", " $1")
    x = q.sub(x, f"({B}){ATTRIBUTED}({NB})", "$1 $2$3")
    cut = q.split(q.sub(x, r"([.!?;])(\s+)", "$1\x01$2"), "\x01")
    noun = q.sub("y", f"({B})(?:{'|'.join(ML_GUARDED)})({NB})", "$1 $2")
    return q.join(q.map(cut, "y", f"CASE WHEN {q.has('y', B + ML_CONTEXT + NB)} THEN {noun} ELSE y END"), "")


@operator()
def guard_masks_seeded(q):
    """How many characters the masks take out of a text, and the hash of what is left."""
    return f"{src(q, MASK_SEEDS, f'{masked(q, chr(108) + chr(111))} AS m')} SELECT doc_id, length(t) - length(m) AS masked_chars, {q.sha256('m')} AS masked_sha256 FROM p"
