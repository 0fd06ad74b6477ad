"""Word lists, constants and weights.

Fixed values: all tables of this module must equal the published ones for results to agree. They are data
under CC BY 4.0 (see README). Longer phrase lists, of a project's own or the full published ones, are read from a
JSON file with read_lexicon().
"""

from __future__ import annotations

import json

# --- fixed values ---------------------------------------------------------------------------------
BUZZWORD_CONFIDENCE = {"tier1_critical": 0.9, "tier2_high": 0.8, "tier3_moderate": 0.6, "tier4_weak": 0.4}
BUZZWORDS = {
    "tier1_critical": ["delve", "delving", "tapestry", "rich tapestry", "realm", "the realm of", "navigating the landscape", "in today's rapidly evolving", "in today's ever-changing", "it's worth noting that", "serves as a testament", "paints a vivid picture", "a testament to", "at its core", "delve deeper", "let's dive in", "embark on a journey", "whether you're a seasoned", "game-changer", "game changing"],
    "tier2_high": ["unlock", "unleash", "harness", "leverage", "leverage the power of", "elevate", "elevating", "empower", "empowering", "foster", "fostering", "spearhead", "spearheading", "cultivate", "cultivating", "catalyst", "a catalyst for", "cornerstone", "beacon", "a beacon of", "pivotal", "paramount", "indispensable", "imperative", "multifaceted", "nuanced", "robust", "seamless", "comprehensive", "holistic", "transformative", "revolutionary", "groundbreaking", "innovative", "cutting-edge", "state-of-the-art", "the power of", "at the end of the day", "in the grand scheme of things", "not only... but also", "it's important to remember", "it's crucial to understand", "landscape", "dynamic", "utilize", "meticulous", "supercharge", "supercharged", "nestled"],
    "tier3_moderate": ["synergy", "paradigm", "paradigm shift", "ecosystem", "in this space", "optimize", "streamline", "agile", "disrupt", "disruption", "scalable", "sustainable", "leveraging AI", "the intersection of", "bridging the gap", "tip of the iceberg", "silver bullet", "one-size-fits-all", "punching above its weight", "sweet spot", "the elephant in the room", "leveling the playing field", "moving the needle", "doubling down"],
    "tier4_weak": ["innovate", "innovation", "efficient", "effective", "strategic", "proactive", "best practices", "value proposition", "stakeholder", "value-added", "results-driven", "forward-thinking", "future-proof", "next-generation", "mission-critical", "actionable insights", "deep dive", "deep-dive", "quietly"],
}
SHORT_BUZZWORDS = {"tier1": ["delve", "realm", "tapestry", "landscape"], "tier2": ["unleash", "unlock", "harness", "leverage"], "tier3": ["paradigm", "synergy", "robust"], "tier4": ["cutting-edge", "state-of-the-art", "game-changing"]}
PHRASES = {
    "hedging_qualifiers": (0.75, ["it's worth noting", "it's important to note", "it's important to remember", "it's crucial to understand", "it's essential to recognize", "while this may vary", "it's safe to say", "needless to say", "worth mentioning", "it goes without saying", "one thing is certain", "it's no secret that", "it's no surprise that", "an important consideration", "it bears repeating", "notably", "importantly", "crucially"]),
    "generic_transitions": (0.7, ["in conclusion", "to sum up", "to summarize", "as previously mentioned", "furthermore", "moreover", "additionally", "in addition", "on the other hand", "by the same token", "with that in mind", "that being said", "having said that", "at the end of the day", "when all is said and done", "taking a step back", "with that said", "as we've explored", "as we've seen", "in this article, we've", "in this blog post, we've"]),
    "closing_formulas": (0.8, ["in conclusion,", "to wrap things up,", "as we look to the future,", "the future of", "only time will tell", "one thing is for certain", "the possibilities are endless", "the bottom line is", "as we move forward", "embrace the future", "stay ahead of the curve", "the journey doesn't end here", "until next time"]),
    "metaphor_abuse": (0.75, ["rich tapestry", "navigating the landscape", "serves as a testament", "paints a vivid picture", "tip of the iceberg", "spearheading a revolution", "bridging the gap between", "the holy grail of", "the elephant in the room", "a double-edged sword", "the perfect storm", "a perfect blend of", "a delicate balance", "a harmonious blend", "the backbone of", "the cornerstone of", "the lifeblood of", "the driving force behind", "at the heart of", "a world of difference", "a beacon of hope", "a sea of"]),
    "emphasis_crutches": (0.7, ["let that sink in", "full stop", "end of story", "no pun intended", "make no mistake", "simply put", "read that again", "mic drop"]),
    "meta_commentary": (0.7, ["the rest of this essay", "the remainder of this document", "in this section, we will", "in the next section", "as we'll see later", "throughout this article", "without further ado", "in the following paragraphs", "as per your request", "per your request", "as requested"]),
    "rhetorical_setups": (0.7, ["plot twist:", "what if i told you", "here's a thought", "guess what", "believe it or not", "sounds too good to be true", "you might ask", "fair question"]),
    "vague_declaratives": (0.65, ["the stakes are high", "the stakes couldn't be higher", "timing is everything", "context matters", "there's a lot to unpack", "more than meets the eye"]),
    "weasel_attribution": (0.75, ["experts agree", "widely regarded as", "it is widely accepted", "many believe", "some say", "critics argue", "people are saying", "sources say", "insiders claim"]),
    "generic_phrases": (0.65, ["in other words", "going forward", "the good news is", "the bad news is", "in order to"]),
    "tech_metaphor_nouns": (0.65, ["substrate", "flywheel", "north star", "bedrock", "nexus", "wedge", "scaffolding", "modality", "paradigm", "ratchet", "evacuate", "endgame", "harness", "vector"]),
}
PHRASE_MIN_HITS, RAISED_MIN_HITS = 2, {"generic_phrases": 3}
MULTILINGUAL = {
    "german": ["im heutigen schnelllebigen", "es gilt zu beachten", "nunmehr", "im digitalen Zeitalter", "die sich ständig wandelnde", "sowohl als auch", "es ist wichtig zu betonen", "im Folgenden", "zusammenfassend lässt sich sagen", "ein tiefgreifender Wandel", "die Synergieeffekte", "ganzheitlicher Ansatz", "der Gamechanger", "auf Augenhöhe"],
    "french": ["il est important de noter", "dans le paysage actuel", "dans un monde en constante évolution", "il convient de souligner", "force est de constater", "rappelons que", "en somme", "en fin de compte"],
    "spanish": ["en el paisaje actual", "es importante destacar", "cabe señalar que", "en conclusión", "en el mundo de hoy", "no cabe duda de que"],
    "portuguese": ["é importante notar que", "desempenha um papel crucial", "em conclusão", "uma abordagem holística", "inegável", "no mundo acelerado de hoje", "não pode ser negado que", "desempenha um papel fundamental"],
    "italian": ["è importante notare che", "svolge un ruolo cruciale", "in conclusione", "un approccio olistico", "senza soluzione di continuità", "nel mondo frenetico di oggi", "non si può negare che", "gioca un ruolo fondamentale"],
}
MORALS = ["remember that", "in the end", "ultimately", "the lesson is", "what matters most", "at the end of the day", "it's important to remember", "the key takeaway", "the bottom line is"]
AUTHORITY = ["studies have shown", "research shows", "experts say", "it has been proven", "scientists have found", "researchers discovered", "recent studies", "a growing body of evidence"]
STOPWORDS = "a an the and or but of to in on for with is are was were be been it its this that these those as at by from we you they he she i not no can will have has had do does their our your my his her them us s t".split()
GERMAN_STOPWORDS = "der die das und ist nicht mit ein eine auf für von zu den dem im".split()
INTENSIFIERS = ["very", "really", "extremely", "incredibly", "remarkably"]
SUBSTITUTE_VERBS = ["serves as", "boasts", "features", "refers to", "represents", "embodies", "stands as"]
WEIGHTS_14 = {"density": 0.15, "repetition": 0.18, "burstiness": 0.30, "buzzwords": 0.26, "phrases": 0.30, "punctuation": 0.30, "trailing_moral": 0.06, "list_heavy": 0.04, "fake_authority": 0.18, "verbosity": 0.04, "multilingual": 0.04, "mirrored": 0.05, "structural": 0.08, "portability": 0.02}
WEIGHTS_7 = {"density": 0.25, "repetition": 0.15, "burstiness": 0.15, "buzzwords": 0.20, "punctuation": 0.10, "trailing_moral": 0.05, "list_heavy": 0.10}
GUARDS = {"density": 40, "repetition": 20, "burst_sentences": 3, "burst_words": 30, "punctuation": 2, "trailing_moral": 15, "list_heavy": 4}
SEVERITY_WEIGHT = {"critical": 1.0, "high": 0.7, "medium": 0.4, "low": 0.2}
FAMILY = {"CriticalBuzzword": "lexical", "BuzzwordOveruse": "lexical", "BuzzwordOveruse_Severe": "lexical", "PhrasePattern": "phrase", "PhrasePatternSevere": "phrase", "ExcessiveHedging": "phrase", "MetaphorAbuse": "phrase", "FakeAuthorityPattern": "phrase", "WeaselAttribution": "phrase", "EmDashExcess": "punctuation", "EllipsisExcess": "punctuation", "ExclamationExcess": "punctuation", "UniformSentenceLength": "structure", "TrailingMoral": "structure", "ListHeavy": "structure", "InventedPackage": "code", "HardcodedSecret": "code", "ExcessiveComments": "code"}
THRESHOLD = 0.40
# --- end of fixed values --------------------------------------------------------------------------


def read_lexicon(path: str) -> dict[str, tuple[float, list[str]]]:
    """Phrase categories {name: {confidence, phrases}} of a JSON file, in the form of PHRASES."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    return {name: (float(c.get("confidence", 0.7)), list(c["phrases"])) for name, c in raw.items()}


def merged(extra: dict[str, tuple[float, list[str]]] | None = None) -> dict[str, tuple[float, list[str]]]:
    return PHRASES | (extra or {})
