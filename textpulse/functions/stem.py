"""English suffix stripping (Porter 1980, with the extensions in common use) as column expressions.

Each step is one pair of regular expressions: the longest suffix of the step's table, and a test of
the stem before it. Steps are kept as separate projections, because each reads the last one often.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the published algorithm.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble",
    "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble", "fulli": "ful", "logi": "log",
}
STEP_3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
    "ism", "ate", "iti", "ous", "ive", "ize",
)
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}

# y is a vowel after a consonant, else a consonant. Vowel y's are marked as Y once: whether a y is one
# depends on the letter before it only, and no step adds a y.
_VOWEL_Y = "([^aeiou])y"
_CONSONANT = "[^aeiouY]"
_VOWEL = "[aeiouY]"
_VC = f"{_VOWEL}+{_CONSONANT}+"
_MEASURE_POSITIVE = f"^{_CONSONANT}*{_VC}"
_MEASURE_ABOVE_ONE = f"^{_CONSONANT}*{_VC}{_VC}"
_MEASURE_ONE = f"^{_CONSONANT}*{_VC}{_VOWEL}*$"
_DOUBLE = f"({_CONSONANT})\\1$"
_SHORT_END = f"{_CONSONANT}{_VOWEL}[^aeiouYwxy]$|^{_VOWEL}{_CONSONANT}$"


def _suffix(word: Column, suffixes) -> Column:
    # A search finds the leftmost start, which is the longest suffix.
    return F.regexp_extract(word, f"({'|'.join(suffixes)})$", 1)


def _before(word: Column, suffix: Column) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - F.length(suffix))


def _table(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def with_stem(df: DataFrame, word: str, out: str) -> DataFrame:
    """Adds column ``out`` with the stem of the lower-cased ``word``."""
    w, sfx, base, cut = (f"__stem_{part}" for part in ("word", "suffix", "base", "cut"))
    W, S, B = F.col(w), F.col(sfx), F.col(base)

    def look(frame: DataFrame, suffixes) -> DataFrame:
        return frame.withColumn(sfx, _suffix(W, suffixes)).withColumn(base, _before(W, S))

    original = F.lower(F.col(word))
    df = df.withColumn(cut, (F.length(original) > 2) & ~original.isin(list(IRREGULAR)))
    df = df.withColumn(w, F.regexp_replace(original, _VOWEL_Y, "$1Y"))

    # 1a: plurals.
    df = look(df, ("sses", "ies", "ss", "s")).withColumn(
        w,
        F.when(S == "sses", F.concat(B, F.lit("ss")))
        .when((S == "ies") & (F.length(W) == 4), F.concat(B, F.lit("ie")))
        .when(S == "ies", F.concat(B, F.lit("i")))
        .when(S == "s", B)
        .otherwise(W),
    )

    # 1b: -ed and -ing. What stays behind may need its final e back or a doubled letter cut.
    df = look(df, ("eed", "ied", "ed", "ing"))
    trimmed = S.isin("ed", "ing") & B.rlike(_VOWEL)
    mended = (
        F.when(B.rlike("(at|bl|iz)$"), F.concat(B, F.lit("e")))
        .when(B.rlike(_DOUBLE), F.when(B.rlike("[lsz]$"), B).otherwise(F.expr(f"left({base}, length({base}) - 1)")))
        .when(B.rlike(_MEASURE_ONE) & B.rlike(_SHORT_END), F.concat(B, F.lit("e")))
        .otherwise(B)
    )
    df = df.withColumn(
        w,
        F.when((S == "ied") & (F.length(W) == 4), F.concat(B, F.lit("ie")))
        .when(S == "ied", F.concat(B, F.lit("i")))
        .when(S == "eed", F.when(B.rlike(_MEASURE_POSITIVE), F.concat(B, F.lit("ee"))).otherwise(W))
        .when(trimmed, mended)
        .otherwise(W),
    )

    # 1c: final y after a consonant that is not the first letter.
    df = df.withColumn(w, F.when(W.rlike(f".{_CONSONANT}Y$"), F.regexp_replace(W, "Y$", "i")).otherwise(W))

    # 2: long suffixes. -alli is cut first and the rest looked at again.
    df = look(df, ("alli",)).withColumn(
        w, F.when((S != "") & B.rlike(_MEASURE_POSITIVE), F.concat(B, F.lit("al"))).otherwise(W)
    )
    df = look(df, STEP_2)
    measured = F.when(S == "logi", F.concat(B, F.lit("l"))).otherwise(B)
    df = df.withColumn(
        w,
        F.when((S != "") & measured.rlike(_MEASURE_POSITIVE), F.concat(B, F.element_at(_table(STEP_2), S))).otherwise(W),
    )

    # 3 and 4.
    df = look(df, STEP_3).withColumn(
        w,
        F.when((S != "") & B.rlike(_MEASURE_POSITIVE), F.concat(B, F.element_at(_table(STEP_3), S))).otherwise(W),
    )
    df = look(df, STEP_4).withColumn(
        w,
        F.when(
            (S != "") & B.rlike(_MEASURE_ABOVE_ONE) & ((S != "ion") | B.rlike("[st]$")), B
        ).otherwise(W),
    )

    # 5: final e and double l.
    df = look(df, ("e",)).withColumn(
        w,
        F.when(
            (S != "")
            & (B.rlike(_MEASURE_ABOVE_ONE) | (B.rlike(_MEASURE_ONE) & ~B.rlike(_SHORT_END))),
            B,
        ).otherwise(W),
    )
    df = look(df, ("l",)).withColumn(
        w, F.when((S != "") & B.rlike("l$") & B.rlike(_MEASURE_ABOVE_ONE), B).otherwise(W)
    )

    stem = F.when(F.col(cut), F.lower(W)).otherwise(F.coalesce(F.element_at(_table(IRREGULAR), original), original))
    return df.withColumn(out, stem).drop(w, sfx, base, cut)
