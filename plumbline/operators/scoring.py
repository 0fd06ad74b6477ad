"""Scores: the 14-dimension scorer, the signal classifier and what stands around them."""

from __future__ import annotations

from collections.abc import Callable

from plumbline.functions import expressions as E
from plumbline.functions import lexicon as L
from plumbline.functions.dialect import Spark
from plumbline.operators import measures
from plumbline.operators.matching import full_lexicon, held, of, seeded
from plumbline.operators.structure import LIST_LINE, base, content, portable, rates
from plumbline.plans.catalog import operator

# Fixed values.
PROVENANCE = {"turn_search": E.word("turn[0-9]+search[0-9]+"), "citation_artifact": r":contentReference\[", "placeholder_date": E.word("(?:19|20)[0-9]{2}-XX-XX"), "pua_characters": r"[\x{e000}-\x{f8ff}]"}


def counting(q: Spark) -> str:
    """CTE counted: how many terms of each kind there are, of the categories hb, hp, hm, ha of h. Of phrases a
    category counts from its minimum on."""
    counts = {c: of(q, "hp", c) for c in L.PHRASES}
    least = {c: L.RAISED_MIN_HITS.get(c, L.PHRASE_MIN_HITS) for c in L.PHRASES}
    phrases = " + ".join(f"CASE WHEN {n} >= {least[c]} THEN {n} ELSE 0 END" for c, n in counts.items())
    strong = [c for c, (conf, _) in L.PHRASES.items() if conf >= 0.75]
    return f"counted AS (SELECT *, {q.size('hb')} AS buzz, {phrases} AS phr, {q.size('hm')} AS multi, {q.size('ha')} AS auth, CASE WHEN {of(q, 'hp', *strong)} > 0 THEN 1 ELSE 0 END AS high_conf FROM h)"


def measured(q: Spark, name: str, measure: Callable, form: str) -> str:
    """CTEs up to counted for Spark: counts of each text, made in Python (see measures)."""
    f = q.measured("t", f"plumbline_{name}", measure, form)
    return f"""WITH src AS (SELECT doc_id, {seeded(q)} AS t FROM documents), prep AS (SELECT *, {f} AS f FROM src), h AS (SELECT *, f.* FROM prep), {counting(q)}"""


def terms(q: Spark) -> str:
    """Columns of the lexicon terms that the words hold, and how many there are of each kind."""
    lex = full_lexicon()
    return f"""h AS (SELECT *, {held(q, lex['buzzword'])} AS hb, {held(q, lex['phrase'])} AS hp, {held(q, lex['multilingual'])} AS hm, {held(q, lex['authority'])} AS ha FROM prep),
{counting(q)}"""


def dimensions(q: Spark) -> str:
    """CTEs up to dims: the 14 normalised dimensions and the counts that floors need. One pass over each text."""
    if q.name == "spark":
        made = measured(q, "dimensions", measures.dimensions, measures.DIMENSIONS)
        em, ell, bang = (f"round(cast({x} AS DOUBLE) / greatest(ns, 1), 3)" for x in ("em", "ell", "bang"))
        rest = f"f AS (SELECT *, {em} + {ell} + {bang} AS punct, {em} AS em_rate, {E.deviation('ns', 'n_sum', 'n_squares')} AS burst FROM counted)"
        em, distinct, most, moral, n_lines, n_listed, a, z, common, p = "em_rate AS em", "distinct_", "most_", "moral", "n_lines", "n_listed", "a", "z", "common_", "portable_"
    else:
        em, ell, bang = rates(q)
        prov = " + ".join(q.count("t", p) for p in PROVENANCE.values())
        made = f"""{base(q, text=seeded(q))},
{terms(q)}"""
        rest = f"""e AS (SELECT *, {q.size('w')} AS nw, {q.size('s')} AS ns, {E.lines(q, E.trim(q, 't'))} AS ls, {content(q, f"coalesce({q.at('s', 1)}, '')")} AS a, {content(q, f"coalesce({q.at('s', -1)}, '')")} AS z FROM counted),
f AS (SELECT *, {em} + {ell} + {bang} AS punct, {em} AS em, {E.spread(q, 'n')} AS burst, {prov} AS prov FROM e)"""
        em, distinct, most, moral = "em", q.size(q.distinct("w")), q.most("w"), q.has(q.tail(E.trim(q, "lower(t)"), 200), E.word("|".join(L.MORALS)))
        n_lines, n_listed, a, z, common = q.size("ls"), q.size(q.filter("ls", "x", q.has("x", LIST_LINE))), q.size("a"), q.size("z"), q.size(q.common("a", "z"))
        p = q.size(q.filter("s", "y", portable(q, "y")))
    return f"""{made},
{rest},
dims0 AS (SELECT doc_id, buzz, phr, multi, auth, high_conf, prov, {em}, burst, ns,
CASE WHEN nw > 0 THEN greatest(0.0, (0.5 - cast({distinct} AS DOUBLE) / nw) / 0.5) ELSE 1.0 END AS density,
CASE WHEN nw > 0 THEN least(1.0, cast({most} AS DOUBLE) / nw / 0.3) ELSE 0.0 END AS repetition,
CASE WHEN ns >= 3 THEN greatest(0.0, (5 - burst) / 5) ELSE 0.0 END AS burstiness,
least(1.0, cast(buzz AS DOUBLE) / 6) AS buzzwords, least(1.0, cast(phr AS DOUBLE) / 4) AS phrases, least(1.0, punct / 2) AS punctuation,
CASE WHEN {moral} THEN 1.0 ELSE 0.0 END AS trailing_moral,
CASE WHEN {n_lines} > 3 AND {n_listed} > 0.4 * {n_lines} THEN 1.0 ELSE 0.0 END AS list_heavy,
least(1.0, cast(auth AS DOUBLE) / 2) AS fake_authority, least(1.0, greatest(0.0, cast(nw AS DOUBLE) / greatest(ns, 1) - 20) / 15) AS verbosity, least(1.0, cast(multi AS DOUBLE) / 3) AS multilingual,
CASE WHEN ns >= 4 AND {a} >= 3 AND {z} >= 3 AND {common} > 0.6 * least({a}, {z}) THEN 1.0 ELSE 0.0 END AS mirrored,
CASE WHEN ns > 0 AND {p} > 0.5 * ns THEN 1.0 ELSE 0.0 END AS portability FROM f),
dims AS (SELECT *, least(1.0, cast((CASE WHEN em > 0.5 THEN 1 ELSE 0 END) + (CASE WHEN ns >= 3 AND burst < 3 THEN 1 ELSE 0 END) + mirrored AS DOUBLE) / 3) AS structural FROM dims0)"""


def total(geometric: bool = False) -> str:
    if not geometric:
        return " + ".join(f"{w} * {d}" for d, w in L.WEIGHTS_14.items())
    whole = sum(L.WEIGHTS_14.values())
    return "exp(" + " + ".join(f"{w / whole:.12f} * ln(greatest({d}, 0.05))" for d, w in L.WEIGHTS_14.items()) + ")"


FAMILIES = "((CASE WHEN buzzwords >= 0.5 THEN 1 ELSE 0 END) + (CASE WHEN phrases >= 0.5 THEN 1 ELSE 0 END) + (CASE WHEN fake_authority >= 0.5 THEN 1 ELSE 0 END) + (CASE WHEN trailing_moral = 1 THEN 1 ELSE 0 END) + (CASE WHEN mirrored = 1 THEN 1 ELSE 0 END) + high_conf + (CASE WHEN prov >= 1 THEN 1 ELSE 0 END) + (CASE WHEN auth >= 3 THEN 1 ELSE 0 END))"
FLOOR = f"CASE WHEN multi >= 3 OR prov >= 1 OR {FAMILIES} >= 2 THEN {L.THRESHOLD} ELSE 0.0 END"
RISK = "CASE WHEN score >= 0.9 THEN 'severe' WHEN score >= 0.7 THEN 'slop' WHEN score >= 0.4 THEN 'suspicious' WHEN score >= 0.25 THEN 'ai_assisted' ELSE 'clean' END"
ACTION = "CASE WHEN score >= 0.7 THEN 'do_not_cite' WHEN score >= 0.4 THEN 'weak_signal_only' WHEN score >= 0.25 THEN 'cross_check' ELSE 'normal_use' END"


@operator()
def scorer_dimensions_seeded(q):
    return f"{dimensions(q)} SELECT doc_id, {', '.join(f'round({d}, 4) AS {d}' for d in L.WEIGHTS_14)} FROM dims"


@operator()
def scorer_weighted_seeded(q):
    return f"{dimensions(q)}, o AS (SELECT doc_id, round(least(1.0, {total()}), 3) AS score FROM dims) SELECT doc_id, score, {RISK} AS risk FROM o"


@operator()
def scorer_geomean_seeded(q):
    return f"{dimensions(q)}, o AS (SELECT doc_id, round(round(least(1.0, {total(True)}), 9), 3) AS score FROM dims) SELECT doc_id, score, {RISK} AS risk FROM o"


@operator()
def score_with_floors_seeded(q):
    return f"""{dimensions(q)}, o AS (SELECT doc_id, {FAMILIES} AS strong_families, round(least(1.0, greatest({total()}, {FLOOR})), 3) AS score FROM dims)
SELECT doc_id, strong_families, score, {RISK} AS risk, {ACTION} AS action FROM o"""


@operator()
def provenance_hits_seeded(q):
    extra = ["", "see turn0search12 and turn1search3 here", "as of 2024-XX-XX this holds", "cited :contentReference[oaicite:0]", "private  use"]
    return f"""WITH s AS (SELECT doc_id, {seeded(q, extra)} AS t FROM documents)
SELECT doc_id, {', '.join(f'{q.count("t", p)} AS {n}' for n, p in PROVENANCE.items())} FROM s"""


SEVERITY = {"CriticalBuzzword": "high", "BuzzwordOveruse_Severe": "high", "PhrasePatternSevere": "high"}


# Categories that are signals of their own (signal, confidence, terms from which they fire).
TELLS = {"hedging_qualifiers": ("ExcessiveHedging", 0.7, 3), "metaphor_abuse": ("MetaphorAbuse", 0.75, 2), "emphasis_crutches": ("EmphasisCrutch", 0.7, 2), "meta_commentary": ("MetaCommentary", 0.65, 2), "rhetorical_setups": ("RhetoricalSetup", 0.65, 2), "vague_declaratives": ("VagueDeclarative", 0.65, 2), "weasel_attribution": ("WeaselAttribution", 0.75, 2)}
NO_SIGNAL = "none"


def signals(q: Spark) -> str:
    """CTEs sig, (doc_id, signal_id, confidence, severity, family, sw, w) of the signal classifier, and every, which has a row
    NO_SIGNAL of weight 0 for each document besides. One pass over each text; signals are the elements of an array."""
    if q.name == "spark":
        made, source = measured(q, "signals", measures.signals, measures.SIGNALS), "counted"
        em, ell, bang = (f"cast({x} AS DOUBLE) / greatest(ns, 1)" for x in ("em", "ell", "bang"))
        spread, moral, n_lines, n_listed = E.deviation("ns", "k_sum", "k_squares"), "moral", "n_lines", "n_listed"
    else:
        made, source = f"""{base(q, text=seeded(q))}, {terms(q)},
d AS (SELECT *, {q.size('s')} AS ns, {q.map('s', 'y', q.size(E.white_words(q, 'y')))} AS k, {E.lines(q, E.trim(q, 't'))} AS ls FROM counted)""", "d"
        em, ell, bang = (f"cast({q.count('t', p)} AS DOUBLE) / greatest(ns, 1)" for p in (r"[\x{2014}\x{2013}]", r"\.\.\.", "!"))
        spread, moral = E.spread(q, "k"), q.has(q.tail(E.trim(q, "lower(t)"), 200), "|".join(L.MORALS[:7]))
        n_lines, n_listed = q.size("ls"), q.size(q.filter("ls", "x", q.has("x", LIST_LINE)))
    rules = [
        ("CriticalBuzzword", "0.9", f"{of(q, 'hb', 'tier1_critical')} > 0"),
        ("BuzzwordOveruse_Severe", "0.85 + least(buzz * 0.01, 0.10)", "buzz >= 5"),
        ("BuzzwordOveruse", "0.75 + least(buzz * 0.02, 0.15)", "buzz BETWEEN 3 AND 4"),
        ("PhrasePatternSevere", "0.85", "phr >= 4"),
        ("PhrasePattern", "0.75", "phr BETWEEN 2 AND 3"),
        *((name, str(conf), f"{of(q, 'hp', c)} >= {least}") for c, (name, conf, least) in TELLS.items()),
        *((f"Multilingual_{lang}", "0.7", f"{of(q, 'hm', lang)} >= 2") for lang in L.MULTILINGUAL),
        ("EmDashExcess", "0.85", f"{em} > 0.5"),
        ("EllipsisExcess", "0.7", f"{ell} > 0.3"),
        ("ExclamationExcess", "0.65", f"{bang} > 0.2"),
        ("UniformSentenceLength", "0.7", f"ns >= 5 AND {spread} < 3"),
        ("TrailingMoral", "0.7", moral),
        ("ListHeavy", "0.5", f"{n_lines} > 3 AND {n_listed} > 0.4 * {n_lines}"),
        (NO_SIGNAL, "0.0", "true"),
    ]
    fired = q.filter(q.array(*(f"CASE WHEN {c} THEN '{s}' END" for s, _, c in rules)), "x", "x IS NOT NULL")
    conf = "CASE signal_id " + " ".join(f"WHEN '{s}' THEN cast({c} AS DOUBLE)" for s, c, _ in rules) + " END"
    severity = f"CASE WHEN signal_id LIKE 'Multilingual%' THEN 'high' WHEN signal_id = '{NO_SIGNAL}' THEN 'low' " + " ".join(f"WHEN signal_id = '{s}' THEN '{v}'" for s, v in SEVERITY.items()) + " ELSE 'medium' END"
    family = "CASE " + " ".join(f"WHEN signal_id = '{s}' THEN '{f}'" for s, f in L.FAMILY.items()) + " WHEN signal_id LIKE 'Multilingual%' THEN 'multilingual' ELSE 'other' END"
    weight = "CASE severity " + " ".join(f"WHEN '{s}' THEN cast({w} AS DOUBLE)" for s, w in L.SEVERITY_WEIGHT.items()) + " END"
    doc = f"doc_id, {q.sha256('t')} AS sha, buzz, ids"
    return f"""{made},
dx AS (SELECT {doc.replace('ids', fired + ' AS ids')} FROM {source}), dy AS ({q.explode('doc_id, sha, buzz', 'dx', 'ids', 'pos', 'signal_id')}),
sig0 AS (SELECT doc_id, sha, signal_id, {conf} AS confidence, {severity} AS severity, {family} AS family FROM dy),
every AS (SELECT *, {weight} AS sw, {weight} * confidence AS w FROM sig0),
sig AS (SELECT * FROM every WHERE signal_id <> '{NO_SIGNAL}')"""


BAND = "CASE WHEN score >= 0.7 THEN 'slop_candidate' WHEN score >= 0.4 THEN 'suspicious' WHEN score >= 0.25 THEN 'ai_assisted' ELSE 'clean' END"


def noisy(q: Spark, source: str = "sig") -> str:
    """CTE cls: noisy-OR of the signals, escalated by two high ones."""
    return f"""cls0 AS (SELECT doc_id, {q.noisy_or('w')} AS base, sum(CASE WHEN severity IN ('critical', 'high') THEN 1 ELSE 0 END) AS high, max(CASE WHEN severity = 'critical' THEN 1 ELSE 0 END) AS crit FROM {source} GROUP BY doc_id),
cls AS (SELECT doc_id, round(CASE WHEN crit = 1 OR high >= 2 THEN greatest(base, 0.7) ELSE base END, 4) AS score FROM cls0)"""


@operator()
def classifier_signals_seeded(q):
    return f"{signals(q)} SELECT doc_id, signal_id, round(confidence, 4) AS confidence, severity, family FROM sig"


@operator()
def signals_noisy_or_seeded(q):
    return f"{signals(q)}, {noisy(q, 'every')} SELECT doc_id, score, {BAND} AS severity FROM cls"


@operator()
def signals_geometric_seeded(q):
    """Noisy-OR within a family, weighted geometric mean over families."""
    return f"""{signals(q)}, fam AS (SELECT doc_id, family, {q.noisy_or('w')} AS d, max(sw) AS fw FROM sig GROUP BY doc_id, family),
g AS (SELECT doc_id, exp(sum(fw * ln(d)) / sum(fw)) AS score FROM fam GROUP BY doc_id) SELECT doc_id, round(score, 4) AS score FROM g"""


@operator()
def countermeasures_seeded(q):
    steps = "CASE WHEN score >= 0.7 THEN 'exclude_from_rag,do_not_cite,label_as_ai' WHEN score >= 0.4 THEN 'require_human_review,cross_check_sources' WHEN score >= 0.25 THEN 'source_check_recommended' ELSE 'standard_quality_check' END"
    return f"{signals(q)}, {noisy(q)} SELECT doc_id, score, {BAND} AS severity, {steps} AS countermeasures, score >= 0.4 AS gate_failed FROM cls"


@operator()
def domain_filtered_signals_seeded(q):
    """Signals that a domain excludes go before the score is made; here legal and academic text may be
    uniform and hedge."""
    gates = q.values([("UniformSentenceLength", "legal"), ("ExcessiveHedging", "academic"), ("ListHeavy", "technical")], ["signal_id", "domain"])
    domain = "CASE doc_id % 4 WHEN 0 THEN 'legal' WHEN 1 THEN 'academic' WHEN 2 THEN 'technical' ELSE 'general' END"
    return f"""{signals(q)}, gate AS {gates}, dom AS (SELECT s.*, {domain} AS domain FROM sig s),
open AS (SELECT d.* FROM dom d LEFT JOIN gate g ON d.signal_id = g.signal_id AND d.domain = g.domain WHERE g.signal_id IS NULL),
{noisy(q, 'open')} SELECT doc_id, score, {BAND} AS severity FROM cls"""


@operator()
def disabled_signal_antijoin_seeded(q):
    """Signals that a project disables go, and severities take the project's weights."""
    off = q.values([("ExclamationExcess",), ("TrailingMoral",)], ["signal_id"])
    return f"""{signals(q)}, off AS {off}, left_ AS (SELECT s.doc_id, s.severity, CASE s.severity WHEN 'high' THEN 0.5 WHEN 'medium' THEN 0.3 ELSE s.sw END * s.confidence AS w FROM sig s LEFT JOIN off o ON s.signal_id = o.signal_id WHERE o.signal_id IS NULL)
SELECT doc_id, round({q.noisy_or('w')}, 4) AS score, count(*) AS n_signals FROM left_ GROUP BY doc_id"""


@operator()
def exempted_by_hash_seeded(q):
    """Reviewed false positives: a signal of exactly this text (by hash) is left out."""
    return f"""{signals(q)}, store AS (SELECT DISTINCT substring(sha, 1, 16) AS sample_hash, signal_id FROM sig WHERE signal_id = 'UniformSentenceLength' AND doc_id % 3 = 0),
open AS (SELECT s.* FROM sig s LEFT JOIN store x ON x.sample_hash = substring(s.sha, 1, 16) AND x.signal_id = s.signal_id WHERE x.signal_id IS NULL)
SELECT doc_id, signal_id, round(confidence, 4) AS confidence FROM open"""


@operator()
def signal_families_seeded(q):
    return f"{signals(q)} SELECT family, severity, count(*) AS n_signals, count(DISTINCT doc_id) AS n_docs, round(avg(confidence), 6) AS mean_confidence FROM sig GROUP BY family, severity"


@operator()
def findings_json_seeded(q):
    """One line of findings for each document, ordered."""
    return f"{signals(q)} SELECT doc_id, {q.collect('signal_id', ';')} AS findings, count(*) AS n FROM sig GROUP BY doc_id"


# Decision threshold and weights set to zero for each genre.
GENRES = {"legal": (0.55, ["burstiness"]), "academic": (0.55, ["burstiness", "verbosity"]), "marketing": (0.50, []), "technical": (0.45, ["list_heavy"]), "comment": (0.50, ["verbosity", "list_heavy"]), "message": (0.50, ["verbosity", "list_heavy"]), "none": (0.40, [])}


@operator()
def genre_thresholds_seeded(q):
    """Genres raise the threshold and silence some dimensions; here the source stands for the genre."""
    silent = sorted({d for _, ds in GENRES.values() for d in ds})
    genre = q.values([(g, t, *(float(d not in ds) for d in silent)) for g, (t, ds) in GENRES.items()], ["genre", "threshold", *(f"w_{d}" for d in silent)])
    pick = f"CASE doc_id % {len(GENRES)} " + " ".join(f"WHEN {i} THEN '{g}'" for i, g in enumerate(GENRES)) + " ELSE 'none' END"
    less = "".join(f" - (1 - x.w_{d}) * {L.WEIGHTS_14[d]} * {d}" for d in silent)
    return f"""{dimensions(q)}, genre AS {genre}, g AS (SELECT d.*, {pick} AS genre FROM dims d),
o AS (SELECT g.doc_id, g.genre, x.threshold, round(round(least(1.0, {total()}{less}), 9), 3) AS score FROM g JOIN genre x ON g.genre = x.genre)
SELECT doc_id, genre, score, score >= threshold AS flagged FROM o"""


@operator()
def fix_strategies_seeded(q):
    """The strategy for each signal that fires; a signal that the table doesn't have gets none."""
    known = q.values([("CriticalBuzzword", "delete"), ("BuzzwordOveruse", "rewrite"), ("BuzzwordOveruse_Severe", "rewrite"), ("PhrasePattern", "delete"), ("PhrasePatternSevere", "delete"), ("UniformSentenceLength", "rewrite"), ("ListHeavy", "condense"), ("TrailingMoral", "delete")], ["signal_id", "strategy"])
    return f"{signals(q)}, known AS {known} SELECT s.doc_id, s.signal_id, coalesce(k.strategy, '') AS strategy FROM sig s LEFT JOIN known k ON s.signal_id = k.signal_id"


@operator()
def dimension_flags(q):
    """Density below 0.40 and repetition above 0.20, from unrounded values."""
    d, r = f"cast({q.size(q.distinct('w'))} AS DOUBLE) / nw", f"cast({q.most('w')} AS DOUBLE) / nw"
    return f"""{base(q)}, c AS (SELECT *, {q.size('w')} AS nw FROM prep), v AS (SELECT doc_id, {d} AS d, {r} AS r FROM c WHERE nw > 0)
SELECT doc_id, round(round(d, 9), 2) AS density, d < 0.40 AS density_is_slop, round(round(r, 9), 2) AS repetition, r > 0.20 AS repetition_is_slop FROM v"""


@operator()
def evidence_receipts_seeded(q):
    """A receipt for each document that names an authority without a source: an excerpt of at most 90 characters around the first
    one, its place, and high, medium or low confidence by 0.7 and 0.5."""
    found = q.all("lower(t)", "(?s:.{0,30})" + E.word("|".join(L.AUTHORITY)) + "(?s:.{0,60})")
    excerpt = f"substring({E.trim(q, q.sub('x', r'[ \t\r\n]+', ' '))}, 1, 90)"
    at = "instr(lower(t), x)" if q.name == "spark" else "strpos(lower(t), x)"
    level = "CASE WHEN confidence >= 0.7 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END"
    return f"""WITH s AS (SELECT doc_id, {seeded(q)} AS t FROM documents), h AS (SELECT doc_id, t, {found} AS hs FROM s), e AS (SELECT doc_id, t, {q.at('hs', 1)} AS x, least(0.9, 0.4 + 0.15 * {q.size('hs')}) AS confidence FROM h WHERE {q.size('hs')} > 0)
SELECT doc_id, 'FakeAuthorityPattern' AS signal_id, {at} AS place, {excerpt} AS evidence, {level} AS reliability FROM e"""


@operator()
def text_halves(q):
    """A text in two halves: by paragraphs where there are two, else by sentences, else by words; how long each is and how its
    sentences differ in length."""
    parts = f"CASE WHEN {q.size('paras')} >= 2 THEN paras WHEN {q.size('s')} >= 2 THEN s ELSE w END"
    first = "slice(ps, 1, {})" if q.name == "spark" else "list_slice(ps, 1, {})"
    half = f"cast(floor({q.size('ps')} / 2) AS INT)"
    mean = lambda a: f"round(cast({q.sum(q.map(a, 'x', f'cast({q.size(E.white_words(q, chr(120)))} AS BIGINT)'))} AS DOUBLE) / nullif({q.size(a)}, 0), 4)"
    return f"""{base(q)}, p AS (SELECT *, {E.paragraphs(q, 't')} AS paras FROM prep), k AS (SELECT doc_id, {parts} AS ps FROM p), c AS (SELECT doc_id, {first.format(half)} AS a, {q.cut('ps', half + ' + 1')} AS z FROM k)
SELECT doc_id, {q.size('a')} AS first_parts, {q.size('z')} AS second_parts, {mean('a')} AS first_mean, {mean('z')} AS second_mean FROM c"""


@operator()
def pipeline_verdict_seeded(q):
    """The larger of the scorer and the classifier."""
    types = "least(0.95, 0.3 + 0.15 * (buzz + phr))"
    return f"""{dimensions(q)},
o AS (SELECT doc_id, round(least(1.0, greatest({total()}, {FLOOR})), 3) AS scorer, {types} AS types FROM dims)
SELECT doc_id, round(greatest(scorer, CASE WHEN types >= 0.45 THEN types ELSE 0 END), 3) AS verdict FROM o"""


@operator()
def policy_actions(q):
    """The first rule whose range holds the score; sensitive sources always go to a person."""
    rules = q.values([(0.9, 1.01, "quarantine"), (0.7, 0.9, "exclude"), (0.4, 0.7, "review"), (0.25, 0.4, "check"), (0.0, 0.25, "accept")], ["lo", "hi", "action"])
    from plumbline.operators.structure import seven

    return f"""{seven(q, more='source')}, rules AS {rules} SELECT s.doc_id, s.overall, CASE WHEN s.source IN ('src3', 'src7') THEN 'escalate' ELSE r.action END AS action
FROM scored s JOIN rules r ON s.overall >= r.lo AND s.overall < r.hi"""
