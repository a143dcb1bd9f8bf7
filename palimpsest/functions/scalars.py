"""Column functions: clamping, decay, bonuses, name normalisation, query rewriting, routing, hygiene."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
#: Words that entity search leaves out, and those that full-text search leaves out besides.
ENTITY_STOP = (
    "a about an and be can could did do does for from had has have her him his how in is it its me my no not of on or our "
    "should that the their them this to us was were what when where which who why will with would yes your"
).split()
STOP = [*ENTITY_STOP, "are", "currently", "describe", "recently", "tell"]
TEMPORAL = r"(?i)\b(at the moment|current|currently|latest|now|recent|recently|right now|today)\b"
#: Questions for a present state: one to four words between "what" and "does", or how often something happens.
PRESENT = (
    r"(?i)\bwhat\s+(?:[\p{L}\p{N}_]+\s+){1,4}does\s+[\p{L}\p{N}_]+.*?\s+(generate|have|output|produce|route|run|send|serve|store|use)\b",
    r"(?i)\bhow\s+(frequently|often)\s+does\b",
)


def clamp_unit(c: Column, default: float = 0.5) -> Column:
    """A number in [0, 1]; what is no number becomes ``default``."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c.try_cast("double"), F.lit(default))))


def age_days(at: Column, now: Column) -> Column:
    """Whole and part days between two times; 0 where unknown or in the future."""
    return F.greatest(F.lit(0.0), F.coalesce((now.cast("double") - at.cast("double")) / 86400.0, F.lit(0.0)))


def decay(days: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), days / F.lit(float(half_life))) if half_life > 0 else F.lit(0.0)


def effective_confidence(confidence: Column, at: Column, now: Column, half_life: float) -> Column:
    """Confidence that halves every ``half_life`` days; an unknown date counts half, a future one in full."""
    if half_life <= 0:
        return F.lit(0.0)
    aged = F.when(at.isNull(), 0.5).when(at > now, 1.0).otherwise(decay(age_days(at, now), half_life))
    return confidence * aged


def propensity_utility(accesses: Column, surfaced: Column) -> Column:
    """ln(2 + accesses / surfacings); unsurfaced rows count at most five accesses."""
    return F.log(F.lit(2.0) + F.when(surfaced > 0, accesses / surfaced).otherwise(F.least(accesses, F.lit(5)).cast("double")))


def frequency_bonus(accesses: Column, surfaced: Column) -> Column:
    rate = F.least(accesses / F.greatest(surfaced, F.lit(1)), F.lit(2.0))
    return F.when(accesses <= 0, 0.0).otherwise(F.least(F.lit(0.01) * F.log(accesses + 1.0) * rate, F.lit(0.04)))


def sanitize_match(c: Column) -> Column:
    """Text safe for a full-text match: inner hyphens split, operators and NEAR / NOT go, spaces collapse."""
    c = F.regexp_replace(c, r"(?<=[\p{L}\p{N}_])-(?=[\p{L}\p{N}_])", " ")
    c = F.regexp_replace(c, r"[+\[\]{}:~.'?^)(*\"]", "")
    c = F.regexp_replace(c, r"\b(NEAR|NOT)\b", " ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def query_terms(c: Column, stop: list[str] = STOP) -> Column:
    """Words longer than one character that are no stop words, as they are written."""
    words = F.regexp_extract_all(c, F.lit(f"({WORD})"), 1)
    return F.filter(words, lambda w: (F.length(w) > 1) & ~F.lower(w).isin(*stop))


def any_term(c: Column, stop: list[str] = STOP) -> Column:
    """The terms joined by OR; the query itself if none is left."""
    terms = query_terms(c, stop)
    return F.when(F.size(terms) > 0, F.array_join(terms, " OR ")).otherwise(c)


def entity_terms(c: Column, stop: list[str] = ENTITY_STOP) -> Column:
    """As :func:`any_term` with the shorter stop list; terms of four letters or more also as prefixes."""
    terms = F.flatten(F.transform(query_terms(c, stop), lambda w: F.when(F.length(w) >= 4, F.array(w, F.concat(w, F.lit("*")))).otherwise(F.array(w))))
    return F.when(F.size(terms) > 0, F.array_join(terms, " OR ")).otherwise(c)


def freshness_alpha(c: Column) -> Column:
    """1 where the query names the present, else 0: how much age counts in the scores."""
    return F.when(c.rlike(TEMPORAL), 1.0).otherwise(0.0)


def temporal_intent(c: Column) -> Column:
    """Whether the query names the present or asks for a present state."""
    return reduce(lambda a, b: a | b, (c.rlike(p) for p in (TEMPORAL, *PRESENT)))


def canonical_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), " ", "_")


def normalized_name(c: Column) -> Column:
    """Lower case, underscores, no parenthetical, no technical suffix, no plural s."""
    c = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "-", "_"), r"\s*\([^)]*\)\s*$", "")
    c = F.regexp_replace(c, " ", "_")
    c = F.regexp_replace(c, r"_(service|server|app|api|project|system|tool|library)$", "")
    return F.when((F.length(c) > 4) & c.endswith("s") & ~c.endswith("ss"), F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c)


def safe_name(c: Column, most: int = 200) -> Column:
    """ASCII letters, digits, space, hyphen, underscore, dot and apostrophe; one space between words; null below two characters."""
    c = F.trim(F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9 \-_.']", ""), r"\s+", " "))
    return F.when(F.length(c) >= 2, F.substring(c, 1, most))


def strip_injections(c: Column) -> Column:
    """Model output without control tokens, role tags and phrases at a line's beginning that give orders."""
    c = F.regexp_replace(c, r"<\|[^>]*\|>", "")
    c = F.regexp_replace(c, r"(?i)</?(assistant|instruction|system|user)>", "")
    orders = (r"assistant\s*:", r"human\s*:", r"ignore\s+(?:all\s+)?(?:previous\s+)?instructions", r"system\s*(?::|message|prompt)", r"you\s+are\s+now")
    c = F.regexp_replace(c, rf"(?i)(?:^|\n)\s*(?:{'|'.join(orders)})", "")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r" {10,}", " "))


#: Names that are no entity: pronouns, articles, demonstratives and indefinites.
PRONOUNS = (
    "i me my mine myself you your yours yourself he him his himself she her hers herself it its itself we us our ours "
    "ourselves they them their theirs themselves the a an this that these those anyone anything everyone everything nobody nothing someone something"
).split()


def is_garbage_name(c: Column) -> Column:
    """Null, one character or none, a pronoun, or a phrase that begins with an article, a demonstrative, "my" or "some"."""
    low = F.lower(F.trim(c))
    return c.isNull() | (F.length(low) <= 1) | low.isin(*PRONOUNS) | low.rlike(r"^(a|an|my|some|that|the|this) ")


def model_tier(task: Column, tools: Column, context_tokens: Column, least: int = 0) -> Column:
    """0 (local) to 3 (largest): the dearest tier that a pattern asks for, raised by tools, long contexts and the caller.

    Tools and more than 32,000 tokens raise the lowest tier by one; more than 100,000 tokens ask for tier 2.
    """
    low = F.lower(task)
    by_words = F.when(_any(low, _TIER_3), 3).when(_any(low, _TIER_2), 2).when(_any(low, _TIER_1), 1).otherwise(0)
    raised = F.when((by_words == 0) & (F.coalesce(tools, F.lit(False)) | (F.coalesce(context_tokens, F.lit(0)) > 32_000)), 1).otherwise(by_words)
    raised = F.when((F.coalesce(context_tokens, F.lit(0)) > 100_000) & (raised < 2), 2).otherwise(raised)
    return F.greatest(raised, F.lit(least))


_TIER_3 = (
    r"\b(financial|important|critical|legal|security|sensitive)\b.*\b(audit|decision|review)\b",
    r"\b(architect|design|trade.?off)\b",
    r"\b(deduce|explain why|infer|justify|prove|reason)\b.*\b(difficult|complex|nuanced)\b",
    r"\b(combine|cross.?reference|integrate|synthesize)\b.*\b(documents|reports|sources)\b",
)
_TIER_2 = (
    r"\b(build|create|generate|implement|write)\b.{0,30}\b(api|class|code|endpoint|function|module|script)\b",
    r"\b(analyze|assess|compare|evaluate|review)\b",
    r"\b(brainstorm|creative|imagine|propose)\b",
    r"\b(approach|first.*then|plan|step by step|strategy)\b",
    r"\b(compose|draft|write)\s+(a\s+)?(comprehensive|detailed|full|long)\b",
)
_TIER_1 = (
    r"\b(extract|parse|structure)\b.*\b(entities|fields|json|relationships)\b",
    r"\b(brief|digest|summarize|summary|tldr)\b",
    r"\b(compose|draft|write)\s+(a\s+)?(quick|short)\b",
    r"\b(how many|what is|when did|where is|who is)\b",
    r"\b(convert|reformat|transform|translate)\b",
)


def _any(c: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(c.rlike(p), F.lit(False)) for p in patterns))


#: What kind of entity a predicate's object and subject are; causal predicates say nothing of it.
OBJECT_TYPES = {
    "place": "lives_in located_at located_in visited",
    "project": "created manages owns works_on",
    "organization": "works_at",
    "technology": "built_with depends_on hosted_on runs_on uses_tech written_in",
    "person": "child_of colleague_of friend_of married_to parent_of sibling_of works_with",
}
SUBJECT_TYPES = {"place": "located_in", "person": "has_age has_birthday has_email has_phone"}
CAUSAL = "blocked_by caused_by chose_over enabled_by led_to motivated_by resulted_in".split()


def inferred_type(predicate: Column, types: dict[str, str]) -> Column:
    """The entity type that a predicate implies, 'unknown' where it implies none."""
    out = F.lit("unknown")
    for kind, predicates in types.items():
        out = F.when(predicate.isin(*predicates.split()), kind).otherwise(out)
    return out


def tolerant_json(c: Column, schema: str) -> Column:
    """JSON from a model's answer: the inside of a fenced block if there is one, else the whole text; null if it is none."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.from_json(F.trim(F.when(fenced != "", fenced).otherwise(c)), schema)
