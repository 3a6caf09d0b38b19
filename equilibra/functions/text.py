"""Text scalar functions as Spark column expressions.

Everything here is a JVM expression (translate / regexp_replace / split /
higher-order functions), so it stays inside whole-stage codegen and accepts
streaming DataFrames as well as batch ones.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that `clean` turns into a space (newline and 17 symbols).
CLEAN_CHARS = "\n*[]()-:%.,;#/@?{}"


def _digit_chars() -> str:
    # every code point that str.isdigit accepts (decimal digits plus superscript,
    # subscript and other digit forms): built from the rule, not listed
    return "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and chr(c).isdigit())


DIGITS = _digit_chars()

# Rewrite rules, applied in this order, whole words, any case.
SWAP_FEMALE_RULES: tuple[tuple[str, str], ...] = (
    (r"her", "his"), (r"Sex:\s+F", "Sex: M"), (r"she", "he"), (r"woman", "man"),
    (r"female", "male"), (r"F", "M"))
SWAP_MALE_RULES: tuple[tuple[str, str], ...] = (
    (r"his", "her"), (r"him", "her"), (r"Sex:\s+M", "Sex: F"), (r"he", "she"), (r"man", "woman"),
    (r"male", "female"), (r"M", "F"))
NEUTRALIZE_RULES: tuple[tuple[str, str], ...] = (
    (r"her", "its"), (r"Sex:\s+F", "Sex: "), (r"she", "patient"), (r"woman", "patient"),
    (r"female", ""), (r"F", ""), (r"his", "its"), (r"him", "its"), (r"Sex:\s+M", "Sex: "),
    (r"he", "patient"), (r"man", "patient"), (r"male", ""), (r"M", ""))

# The same rewrites in fewer passes over the text: whole words with one replacement that no rule of the set
# matches go together.  "Sex:" rules span words, so a word that is deleted keeps its place among them.
SWAP_MALE_PASSES: tuple[tuple[str, str], ...] = (("(?:his|him)", "her"), *SWAP_MALE_RULES[2:])
NEUTRALIZE_PASSES: tuple[tuple[str, str], ...] = (
    (r"(?:her|his|him)", "its"), (r"(?:she|woman|he|man)", "patient"), (r"Sex:\s+F", "Sex: "), (r"(?:female|F)", ""),
    (r"Sex:\s+M", "Sex: "), (r"(?:male|M)", ""))

# Dutch gendered term lexicon (female: male, then gendered: neutral).
DUTCH_FEMALE_MALE: tuple[tuple[str, str], ...] = (
    ("zij", "hij"), ("ze", "hij"), ("haar", "hem"), ("mw", "dhr"), ("vrouw", "man"),
    ("patiente", "patient"), ("mevrouw", "meneer"), ("mevr", "mr"), ("meisje", "jongen"),
    ("dame", "heer"))
DUTCH_GENDERED_NEUTRAL: tuple[tuple[str, str], ...] = (
    ("hij", "diegene"), ("hem", "diegene"), ("zijn", "diens"), ("dhr", "persoon"), ("man", "persoon"),
    ("meneer", "persoon"), ("mr", "persoon"), ("jongen", "persoon"), ("heer", "persoon"),
    ("zij", "diegene"), ("ze", "diegene"), ("haar", "diens"), ("mw", "persoon"), ("vrouw", "persoon"),
    ("patiente", "patient"), ("mevrouw", "persoon"), ("mevr", "persoon"), ("meisje", "persoon"),
    ("dame", "persoon"), ("hr", "persoon"))

# Label-name prefixes and their canonical phenotype names.
PHENOTYPE_PREFIXES: tuple[tuple[str, str], ...] = (
    ("DEPRESSION", "DEPRESSION"),
    ("SCHIZOPHRENIA", "SCHIZOPHRENIA.AND.OTHER.PSYCHIATRIC.DISORDERS"),
    ("ALCOHOL", "ALCOHOL.ABUSE"),
    ("OTHER.SUBSTANCE.ABUSE", "OTHER.SUBSTANCE.ABUSE"))


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clean(text: Column | str) -> Column:
    """Symbols -> space, digits dropped, one pass of '  ' -> ' ', lower case."""
    # one translate: symbols -> space, digits deleted (no counterpart in the target)
    t = F.translate(_c(text), CLEAN_CHARS + DIGITS, " " * len(CLEAN_CHARS))
    t = F.replace(t, F.lit("  "), F.lit(" "))
    return F.lower(t)


def _word_rule(pattern: str) -> str:
    # (?iU): case-insensitive, Unicode word boundaries and classes (as Python's re)
    return "(?iU)\\b" + pattern + "\\b"


def apply_rules(text: Column | str, rules: Sequence[tuple[str, str]]) -> Column:
    t = _c(text)
    for pattern, repl in rules:
        t = F.regexp_replace(t, _word_rule(pattern), repl.replace("$", "\\$"))
    return t


def swap(text: Column | str, gender: Column | str, female: str = "F") -> Column:
    """Rewrite the note as if written about the other gender."""
    return F.when(_c(gender) == female, apply_rules(text, SWAP_FEMALE_RULES)) \
        .otherwise(apply_rules(text, SWAP_MALE_PASSES))


def neutralize(text: Column | str) -> Column:
    """Remove gendered words (the swap pass that follows can match nothing)."""
    return apply_rules(text, NEUTRALIZE_PASSES)


def flip_gender(gender: Column | str, female: str = "F", male: str = "M") -> Column:
    """F -> M, anything else -> F."""
    return F.when(_c(gender) == female, F.lit(male)).otherwise(F.lit(female))


def flip_code(gender: Column | str) -> Column:
    """P6 (0/1 codes): 0 -> 1, anything else -> 0."""
    return F.when(_c(gender) == 0, F.lit(1)).otherwise(F.lit(0))


def gender_code(gender: Column | str, female: str = "F") -> Column:
    """F -> 0, anything else -> 1."""
    return F.when(_c(gender) == female, F.lit(0)).otherwise(F.lit(1))


def gender_name(code: Column | str) -> Column:
    """P7 (back): 0 -> F, 1 -> M."""
    return F.when(_c(code) == 0, F.lit("F")).when(_c(code) == 1, F.lit("M"))


def mentions(text: Column | str, word: str = "depression") -> Column:
    """Case-insensitive substring test, null text -> false."""
    return F.coalesce(F.lower(_c(text)).contains(word.lower()), F.lit(False))


def phenotype_name(label_name: Column | str) -> Column:
    """Label column name -> canonical phenotype name (null when nothing matches)."""
    out = None
    for prefix, name in PHENOTYPE_PREFIXES:
        cond = _c(label_name).startswith(prefix)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out


def tokens(text: Column | str) -> Column:
    """T5: split on single spaces (empty tokens kept)."""
    return F.split(_c(text), " ")


def lexicon_rewrite(text: Column | str, mapping: Mapping[str, str] | Sequence[tuple[str, str]]) -> Column:
    """T4: replace whole space-separated tokens found in a (small, literal) lexicon.

    The lexicon is a map literal inside the expression: no join, no shuffle.
    Lookup is case-insensitive; the first listed target wins for repeated sources.
    """
    pairs: dict[str, str] = {}
    for src, dst in (mapping.items() if isinstance(mapping, Mapping) else mapping):
        pairs.setdefault(src.lower(), dst)
    m = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.array_join(F.transform(tokens(text), lambda w: F.coalesce(F.element_at(m, F.lower(w)), w)), " ")


def lexicon_pairs(direction: str) -> list[tuple[str, str]]:
    """T4 rule sets: 'female_to_male', 'male_to_female' (first listed wins), 'neutral'."""
    if direction == "female_to_male":
        return list(DUTCH_FEMALE_MALE)
    if direction == "male_to_female":
        return [(m, f) for f, m in DUTCH_FEMALE_MALE]
    if direction == "neutral":
        return list(DUTCH_GENDERED_NEUTRAL)
    raise ValueError(direction)


def context_sentence(term: Column | str, context: Column | str, head: str = "depression") -> Column:
    """T7: '[head] is a ...' template with the bracketed head replaced by the term."""
    return F.concat(_c(term), F.substring(_c(context), F.lit(len(head) + 3), F.greatest(F.length(_c(context)), F.lit(1))))
