"""Text functions as column expressions; all stay inside the JVM and take and give null as documented."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that a phrase may not contain.
STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "into", "is", "it",
    "of", "on", "or", "that", "the", "their", "this", "to", "via", "with", "we",
]


def normalize_space(x: Column) -> Column:
    """Runs of Unicode white space to one blank, none at the ends; null as empty (STR01)."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "))


def slugify(x: Column, longest: int = 80) -> Column:
    """Lower-case a-z, 0-9 and single underscores, at most ``longest`` long; ``unknown`` if nothing is left (STR02)."""
    base = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    cut = F.regexp_replace(F.substring(base, 1, longest), "_+$", "")
    return F.when(cut == "", F.lit("unknown")).otherwise(cut)


def safe_id(x: Column, longest: int = 80) -> Column:
    """Letters and digits of any script, others collapsed to an underscore, lower case (STR03)."""
    base = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")
    return F.substring(F.when(base == "", F.lit("unknown")).otherwise(base), 1, longest)


def safe_name(x: Column, longest: int = 120) -> Column:
    """Each character but letters, digits, ``_`` and ``-`` to an underscore (STR03, the other variant)."""
    return F.substring(F.regexp_replace(F.coalesce(x, F.lit("")), r"[^\p{L}\p{N}_-]", "_"), 1, longest)


def tokenize(x: Column) -> Column:
    """Lower-case tokens of three or more letters or digits without stopwords, in order, repeats kept (STR04)."""
    # one pass over the whole text: what isn't a letter, a digit or a blank goes
    bare = F.regexp_replace(F.translate(F.lower(normalize_space(x)), "-", " "), r"[^\p{L}\p{N} ]", "")
    return F.filter(F.split(bare, " "), lambda w: (F.char_length(w) >= 3) & ~w.isin(STOPWORDS))


def ngrams(tokens: Column, low: int, high: int) -> Column:
    """Phrases of ``low`` to ``high`` consecutive tokens, short ones first (STR05)."""

    def of(n: int) -> Column:
        count = F.size(tokens) - n + 1
        heads = F.slice(tokens, F.lit(1), F.greatest(count, F.lit(0)))
        return F.when(count > 0, F.transform(heads, lambda x, i: F.concat_ws(" ", x, *(F.get(tokens, i + k) for k in range(1, n))))).otherwise(F.array().cast("array<string>"))

    return F.concat(*(of(n) for n in range(low, high + 1)))


def sentences(x: Column) -> Column:
    """Split behind ``.``, ``!`` or ``?`` and white space, after normalisation (STR06)."""
    return F.split(normalize_space(x), r"(?<=[.!?])\s+")


def first_sentence_with(x: Column, phrase: Column) -> Column:
    """The first sentence that contains the phrase in any case, else null (STR06)."""
    return F.try_element_at(F.filter(sentences(x), lambda s: F.contains(F.lower(s), F.lower(phrase))), F.lit(1))


def leading_sentence(x: Column, phrases: list[str], longest: int = 320) -> Column:
    """Of the parts between full stops the first with any phrase, else the first; at most ``longest`` long (STR07)."""
    parts = F.filter(F.transform(F.split(normalize_space(x), r"\."), lambda s: F.trim(s)), lambda s: s != "")
    hit = F.filter(parts, lambda s: F.exists(F.array(*(F.lit(p) for p in phrases)), lambda p: F.contains(F.lower(s), F.lower(p))))
    return F.substring(F.coalesce(F.try_element_at(hit, F.lit(1)), F.try_element_at(parts, F.lit(1)), F.lit("")), 1, longest)


def has_phrase(x: Column, phrase: Column) -> Column:
    """The phrase in any case, not inside a run of a-z or 0-9 (STR08)."""
    return F.regexp_like(F.lower(x), F.concat(F.lit(r"(?<![a-z0-9])\Q"), F.lower(phrase), F.lit(r"\E(?![a-z0-9])")))


def phrase_match(x: Column, phrase: Column, share: float = 0.67) -> Column:
    """The phrase itself, or ``share`` of its distinct tokens among the text's (STR09)."""
    own = F.array_distinct(tokenize(phrase))
    common = F.size(F.array_intersect(own, tokenize(x)))
    return F.contains(F.lower(normalize_space(x)), F.lower(normalize_space(phrase))) | ((F.size(own) > 0) & (common >= share * F.size(own)))


def entity_name(x: Column, blocked: tuple[str, ...] = ("the", "this", "that", "these", "those", "our", "we")) -> Column:
    """Outer punctuation off; more than six words or a blocked word: empty (STR10)."""
    bare = F.regexp_replace(normalize_space(x), r"^[ .,:;()\[\]{}]+|[ .,:;()\[\]{}]+$", "")
    return F.when((F.size(F.split(bare, " ")) > 6) | F.lower(bare).isin(list(blocked)), F.lit("")).otherwise(bare)


def singular(token: Column) -> Column:
    """``ies`` to ``y``, else one final ``s`` off, but not of short tokens or ``ss`` (STR13)."""
    return (
        F.when(token.endswith("ies") & (F.char_length(token) > 4), F.regexp_replace(token, "ies$", "y"))
        .when(token.endswith("s") & ~token.endswith("ss") & (F.char_length(token) > 3), F.regexp_replace(token, "s$", ""))
        .otherwise(token)
    )


def alias_norm(x: Column) -> Column:
    """Tokens with plurals folded, joined by blanks (STR13)."""
    return F.array_join(F.transform(tokenize(x), singular), " ")


def stem(token: Column) -> Column:
    """A light stem: ``ies``, ``ing``, ``ed`` or ``s`` off longer tokens (STR14)."""
    n = F.char_length(token)
    return (
        F.when(token.endswith("ies") & (n > 4), F.regexp_replace(token, "ies$", "y"))
        .when(token.endswith("ing") & (n > 5), F.regexp_replace(token, "ing$", ""))
        .when(token.endswith("ed") & (n > 4), F.regexp_replace(token, "ed$", ""))
        .when(token.endswith("s") & ~token.endswith("ss") & (n > 3), F.regexp_replace(token, "s$", ""))
        .otherwise(token)
    )


def label_singular(token: Column) -> Column:
    """Singular of a label's token: ``ss``, ``us`` and ``is`` stay; ``ches shes xes zes`` of more than five characters lose ``es``, other words of more than four the ``s`` (STR15)."""
    n = F.char_length(token)
    return (
        F.when((n <= 3) | token.rlike("(ss|us|is)$"), token)
        .when(token.endswith("ies") & (n > 4), F.regexp_replace(token, "ies$", "y"))
        .when(token.rlike("(ches|shes|xes|zes)$") & (n > 5), F.regexp_replace(token, "es$", ""))
        .when(token.endswith("s") & (n > 4), F.regexp_replace(token, "s$", ""))
        .otherwise(token)
    )


def acronym(tokens: Column) -> Column:
    """First letters of the tokens (STR16)."""
    return F.array_join(F.transform(tokens, lambda t: F.substring(t, 1, 1)), "")


def jaccard(a: Column, b: Column) -> Column:
    """Share of common among all distinct tokens; 0 if there are none (STR17)."""
    every = F.size(F.array_union(a, b))
    return F.when(every > 0, F.size(F.array_intersect(a, b)) / every).otherwise(0.0)


def quote_verified(quote: Column, text: Column) -> Column:
    """The quote is a part of the text, or has four or more tokens, 80 % of the distinct ones in it (STR19)."""
    q, tokens = F.lower(normalize_space(quote)), tokenize(quote)
    own = F.array_distinct(tokens)
    loose = (F.size(tokens) >= 4) & (F.size(F.array_intersect(own, tokenize(text))) >= 0.8 * F.size(own))
    return (q != "") & (F.contains(F.lower(normalize_space(text)), q) | loose)


def around(x: Column, needle: Column, before: int = 260, after: int = 260) -> Column:
    """The text around the first place of the needle in any case; its start where there is none (STR22)."""
    at = F.position(F.lower(needle), F.lower(x))
    start = F.greatest(at - before, F.lit(1))
    return F.when((at > 0) & (needle != ""), F.substr(x, start, at + F.char_length(needle) + after - start)).otherwise(F.substring(x, 1, before + after))


def cue_near(x: Column, needle: Column, cues: list[str], radius: int = 160) -> Column:
    """Whether a cue stands within ``radius`` characters of the needle's first place (STR23)."""
    low = F.lower(x)
    at = F.position(F.lower(needle), low)
    start = F.greatest(at - radius, F.lit(1))
    part = F.substr(low, start, at + F.char_length(needle) + radius - start)
    hit = F.exists(F.array(*(F.lit(c) for c in cues)), lambda c: F.contains(part, c))
    return (at > 0) & (needle != "") & hit


def name_of(entity_id: Column) -> Column:
    """The words behind ``type__`` in an entity's id (STR27)."""
    return F.regexp_replace(F.regexp_replace(entity_id, "^.*?__", ""), "_", " ")


def type_of(entity_id: Column) -> Column:
    """What stands before ``__``, or nothing (STR27)."""
    return F.when(F.contains(entity_id, F.lit("__")), F.substring_index(entity_id, "__", 1)).otherwise(F.lit(""))


def listify(x: Column) -> Column:
    """Array of strings, trimmed, without empty ones; null gives an empty one (ARR01)."""
    return F.filter(F.transform(F.coalesce(x, F.array().cast("array<string>")), lambda s: F.trim(s)), lambda s: s != "")


# What publishers' pages leave around an abstract, in the order of the rules.
NOISE_PREFIXES = {
    "previous_next": r"(?i)^\s*(previousnext|return to issue\s*prev|prev\s*news\s*next)\b",
    "access_banner": r"(?i)^\s*(no access|open access|full access)\b",
}
CUT_MARKERS = {
    "doi_url": r"(?i)https?://doi\.org/\S+",
    "sections_about": r"(?i)\bsections\s+about\b",
    "tools_menu": r"(?i)\b(pdf/ePub|tools|add to favorites|download citations|track citations|permissions|share)\b",
    "cited_by": r"(?i)\bcited by\b",
    "references": r"(?i)\breferences\b",
    "related_details": r"(?i)\brelated\s+details\b",
    "notes": r"(?i)\bnotes\b",
}


def clean_abstract(x: Column) -> Column:
    """Struct (text, markers, original_length, cleaned_length) of an abstract without a page's leftovers (STR20).

    Prefixes go; then the first marker that applies cuts the rest off. It applies within the first 300 characters, or
    later where more than 400 characters and a quarter of the text would remain behind it.
    """
    start = normalize_space(x)
    text, markers = start, []
    for name, pattern in NOISE_PREFIXES.items():
        new = F.trim(F.regexp_replace(text, pattern, ""))
        markers.append(F.when(new != text, F.lit(name)))
        text = new
    length, cut = F.char_length(text), F.lit(None).cast("string")
    at = F.lit(None).cast("int")
    for name, pattern in reversed(CUT_MARKERS.items()):
        # characters before the first match: the text up to it
        here = F.char_length(F.element_at(F.split(text, pattern, 2), 1))
        found = text.rlike(pattern) & (here > 0) & ((here < 300) | ((length - here > 400) & (length - here > length * 0.25)))
        at, cut = F.when(found, here).otherwise(at), F.when(found, F.lit(name)).otherwise(cut)
    out = F.when(at.isNotNull(), F.trim(F.substr(text, F.lit(1), at))).otherwise(text)
    return F.struct(out.alias("text"), F.array_compact(F.array(*markers, cut)).alias("markers"), F.char_length(start).alias("original_length"), F.char_length(out).alias("cleaned_length"))
