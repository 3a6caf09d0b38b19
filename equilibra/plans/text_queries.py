"""Text rewriting, cohort and chunk queries over the `notes` view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import counterfactual as CF
from ..operators import encoding as EN
from ..sources import views
from .oracle_views import with_views
from .registry import register

# ---------------------------------------------------------------- SQL helpers
# RE2 word boundaries are ASCII-only; Python's and Java's (?U) ones are Unicode.
# Write the boundary out with Unicode classes; a match consumes one boundary
# character, so every rule runs twice to catch neighbours.
_NW = r"[^\pL\pN_]"
_WS = r"[\t\n\x{0b}\f\r \x{85}\pZ]"


def _duck_rule(expr: str, pattern: str, repl: str) -> str:
    pat = f"(^|{_NW})(?:{pattern.replace(chr(92) + 's', _WS)})($|{_NW})"
    once = f"regexp_replace({expr}, '{pat}', '\\1{repl}\\2', 'gi')"
    return f"regexp_replace({once}, '{pat}', '\\1{repl}\\2', 'gi')"


def duck_rules(expr: str, rules) -> str:
    for pattern, repl in rules:
        expr = _duck_rule(expr, pattern, repl)
    return expr


def duck_swap(text: str, gender: str) -> str:
    return (f"CASE WHEN {gender} = 'F' THEN {duck_rules(text, T.SWAP_FEMALE_RULES)} "
            f"ELSE {duck_rules(text, T.SWAP_MALE_RULES)} END")


def duck_clean(text: str) -> str:
    chars = (T.CLEAN_CHARS[1:] + T.DIGITS).replace("'", "''")
    t = f"translate({text}, chr(10) || '{chars}', '{' ' * len(T.CLEAN_CHARS)}')"
    return f"lower(replace({t}, '  ', ' '))"


def duck_flip(gender: str) -> str:
    return f"CASE WHEN {gender} = 'F' THEN 'M' ELSE 'F' END"


# ---------------------------------------------------------------- queries

@register("clean_text", "T1",
          with_views(f"SELECT row_id, {duck_clean('text')} AS clean_text FROM notes", "notes"))
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return views.notes(spark, sf).select("row_id", T.clean("text").alias("clean_text"))


@register("swap_text", "T2",
          with_views(f"SELECT row_id, gender, {duck_swap('text', 'gender')} AS swapped_text FROM notes", "notes"))
def swap_text(spark: SparkSession, sf: str) -> DataFrame:
    return views.notes(spark, sf).select("row_id", "gender", T.swap("text", "gender").alias("swapped_text"))


@register("neutralize_text", "T3",
          with_views(f"SELECT row_id, {duck_rules('text', T.NEUTRALIZE_RULES)} AS neutral_text FROM notes", "notes"))
def neutralize_text(spark: SparkSession, sf: str) -> DataFrame:
    return views.notes(spark, sf).select("row_id", T.neutralize("text").alias("neutral_text"))


def _duck_lexicon(text: str, pairs) -> str:
    first: dict[str, str] = {}
    for s, d in pairs:
        first.setdefault(s.lower(), d)
    cases = " ".join(f"WHEN '{s}' THEN '{d}'" for s, d in first.items())
    return (f"array_to_string(list_transform(string_split({text}, ' '), "
            f"lambda w: CASE lower(w) {cases} ELSE w END), ' ')")


@register("lexicon_swap", "T4",
          with_views("SELECT row_id, "
                     f"{_duck_lexicon('text', T.lexicon_pairs('female_to_male'))} AS to_male, "
                     f"{_duck_lexicon('text', T.lexicon_pairs('male_to_female'))} AS to_female, "
                     f"{_duck_lexicon('text', T.lexicon_pairs('neutral'))} AS to_neutral FROM notes", "notes"))
def lexicon_swap(spark: SparkSession, sf: str) -> DataFrame:
    n = views.notes(spark, sf)
    return n.select("row_id",
                    T.lexicon_rewrite("text", T.lexicon_pairs("female_to_male")).alias("to_male"),
                    T.lexicon_rewrite("text", T.lexicon_pairs("male_to_female")).alias("to_female"),
                    T.lexicon_rewrite("text", T.lexicon_pairs("neutral")).alias("to_neutral"))


def _variants_sql(flip_neutral: bool) -> str:
    ng = duck_flip("gender") if flip_neutral else "gender"
    cols = "row_id, lang, label, none_mental"
    return with_views(
        f"SELECT {cols}, 'orig' AS variant, gender, text FROM notes UNION ALL "
        f"SELECT {cols}, 'swapped', {duck_flip('gender')}, {duck_swap('text', 'gender')} FROM notes UNION ALL "
        f"SELECT {cols}, 'neutr', {ng}, {duck_rules('text', T.NEUTRALIZE_RULES)} FROM notes", "notes")


@register("counterfactual_notes", "U1 P6", _variants_sql(False))
def counterfactual_notes(spark: SparkSession, sf: str) -> DataFrame:
    return CF.counterfactual_variants(views.notes(spark, sf))


@register("counterfactual_notes_flip", "U2 Q10", _variants_sql(True))
def counterfactual_notes_flip(spark: SparkSession, sf: str) -> DataFrame:
    return CF.counterfactual_variants(views.notes(spark, sf), flip_neutral=True)


@register("cohort", "P1",
          with_views("SELECT row_id, gender, label, none_mental FROM notes WHERE label = 1 OR none_mental = 1",
                     "notes"))
def cohort(spark: SparkSession, sf: str) -> DataFrame:
    n = views.notes(spark, sf)
    return n.filter((F.col("label") == 1) | (F.col("none_mental") == 1)).select("row_id", "gender", "label",
                                                                                "none_mental")


@register("mention_flag", "P2",
          with_views("SELECT row_id, coalesce(contains(lower(text), 'depression'), false) AS mention FROM notes",
                     "notes"))
def mention_flag(spark: SparkSession, sf: str) -> DataFrame:
    return views.notes(spark, sf).select("row_id", T.mentions("text").alias("mention"))


@register("gender_codes", "P6 P7 P10",
          with_views("SELECT row_id, gender, CASE WHEN gender = 'F' THEN 0 ELSE 1 END AS gender_code, "
                     f"{duck_flip('gender')} AS flipped, "
                     "CASE WHEN (CASE WHEN gender = 'F' THEN 0 ELSE 1 END) = 0 THEN 'F' ELSE 'M' END AS decoded "
                     "FROM notes", "notes"))
def gender_codes(spark: SparkSession, sf: str) -> DataFrame:
    n = views.notes(spark, sf)
    code = T.gender_code("gender")
    return n.select("row_id", "gender", code.alias("gender_code"), T.flip_gender("gender").alias("flipped"),
                    T.gender_name(code).alias("decoded"))


_CHUNK_SQL = """
, p AS (SELECT row_id, unnest(string_split(text, chr(10) || chr(10))) AS ptext,
  unnest(range(len(string_split(text, chr(10) || chr(10))))) AS para FROM notes)
, w AS (SELECT row_id, para, string_split(replace(ptext, chr(10), ' '), ' ') AS words FROM p)
, n AS (SELECT *, len(words) AS nw, CAST(round_even(len(words) / 512.0, 0) AS INTEGER) + 15 AS n FROM w)
, c AS (SELECT row_id, para, words, nw, n, nw // n AS q, nw % n AS r, unnest(range(n)) AS chunk FROM n)
, s AS (SELECT *, chunk * q + least(chunk, r) AS st, q + CASE WHEN chunk < r THEN 1 ELSE 0 END AS ln FROM c)
SELECT row_id, CAST(para AS INTEGER) AS para, CAST(chunk AS INTEGER) AS chunk, CAST(ln AS INTEGER) AS n_words,
  array_to_string(list_slice(words, st + 1, st + ln), ' ') AS chunk_text FROM s
"""


@register("chunk_notes", "T6 Q18", with_views(_CHUNK_SQL, "notes"))
def chunk_notes(spark: SparkSession, sf: str) -> DataFrame:
    return CF.chunk_notes(views.notes(spark, sf))


@register("label_encode", "P8",
          with_views(", gc AS (SELECT gender, CAST(dense_rank() OVER (ORDER BY gender) - 1 AS INTEGER) AS gender_code"
                     " FROM (SELECT DISTINCT gender FROM notes WHERE gender IS NOT NULL))\n"
                     ", lc AS (SELECT lang, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS lang_code"
                     " FROM (SELECT DISTINCT lang FROM notes WHERE lang IS NOT NULL))\n"
                     "SELECT n.row_id, n.gender, n.lang, gc.gender_code, lc.lang_code FROM notes n"
                     " LEFT JOIN gc USING (gender) LEFT JOIN lc USING (lang)", "notes"))
def label_encode(spark: SparkSession, sf: str) -> DataFrame:
    n = views.notes(spark, sf).select("row_id", "gender", "lang")
    return EN.label_encode(EN.label_encode(n, "gender"), "lang").select("row_id", "gender", "lang",
                                                                      "gender_code", "lang_code")
