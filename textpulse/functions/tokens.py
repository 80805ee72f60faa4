"""Row-local text functions: tokens, sentences, stop words, term counts."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters, digits and underscore of any script; Java's \w is ASCII only.
WORD_CHARACTER = r"[\p{L}\p{N}_]"
WORD = WORD_CHARACTER + "+"
SENTENCE_END = r"[.!?\n]+"
CLAUSE_END = r"[,;:.!?()]+"
LETTERS_ONLY = r"^\p{L}*$"
MIN_LEMMA_CHARS = 3


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def english_stop_words() -> list[str]:
    """Spark's own English list. Use ``sources.words.read_stop_words`` for a list of your own."""
    return StopWordsRemover.loadDefaultStopWords("english")


def words(text: Column | str, lower: bool = False, min_chars: int = 1) -> Column:
    """All word tokens of at least ``min_chars`` characters in order."""
    source = F.lower(_col(text)) if lower else _col(text)
    return F.regexp_extract_all(source, F.lit(f"{WORD_CHARACTER}{{{min_chars},}}"), F.lit(0))


def only_letters(token: Column | str) -> Column:
    """True when every character is a letter; also for the empty string."""
    return _col(token).rlike(LETTERS_ONLY)


def token_count(tokens: Column | str) -> Column:
    return F.size(_col(tokens))


def drop_words(tokens: Column | str, stop: list[str] | None) -> Column:
    """Tokens without the stop words, case-sensitive, order and repeats kept."""
    tokens = _col(tokens)
    if not stop:
        return tokens
    return F.filter(tokens, lambda t: ~t.isin(list(stop)))


def keep_lemmas(lemmas: Column | str, stop: list[str] | None, letters_only: bool = False) -> Column:
    """Drop lemmas of one or two characters and stop words, then lower-case.

    Stop words are compared before lower-casing, so a capitalised stop word stays.
    """
    def wanted(lemma: Column) -> Column:
        keep = F.length(lemma) >= MIN_LEMMA_CHARS
        if stop:
            keep = keep & ~lemma.isin(list(stop))
        return keep & only_letters(lemma) if letters_only else keep

    return F.transform(F.filter(_col(lemmas), wanted), F.lower)


def sentences(text: Column | str) -> Column:
    """Sentences that hold at least one word."""
    parts = F.split(_col(text), SENTENCE_END)
    return F.filter(parts, lambda s: s.rlike(WORD))


def scoped_words(sentence: Column | str, negators: list[str]) -> Column:
    """``array<struct<word, negated>>`` of a sentence, in lower case. A word is negated from the first negator before it
    up to the next mark; "n't" is "not". The negator itself is not."""
    text = F.regexp_replace(F.lower(_col(sentence)), "n['’]t", " not")

    def clause(part: Column) -> Column:
        def flagged(x: Column) -> Column:
            return F.transform(x["w"], lambda word, i: F.struct(word.alias("word"), ((x["at"] > 0) & (i >= x["at"])).alias("negated")))

        def placed(w: Column) -> Column:
            return F.struct(w.alias("w"), F.array_position(F.transform(w, lambda word: word.isin(negators)), True).alias("at"))

        # One-element arrays hold the words and the negator's place, so that they are worked out once.
        return F.get(F.transform(F.transform(F.array(words(part)), placed), flagged), F.lit(0))

    return F.flatten(F.transform(F.split(text, CLAUSE_END), clause))


def term_runs(sorted_tokens: Column | str) -> Column:
    """``array<struct<term, tf>>`` of one document from its sorted tokens.

    Equal tokens stand together, so each run's length is its count: no shuffle, n log n per document.
    """
    tokens = _col(sorted_tokens)
    places = F.sequence(F.lit(0), F.size(tokens) - 1)
    # Beyond the end there is null, which differs from the last token.
    ends_of_runs = F.filter(places, lambda i: ~F.get(tokens, i).eqNullSafe(F.get(tokens, i + 1)))

    def runs(ends: Column) -> Column:
        before = F.concat(F.array(F.lit(-1)), F.slice(ends, F.lit(1), F.size(ends) - 1))
        return F.zip_with(
            ends, before, lambda b, a: F.struct(F.get(tokens, b).alias("term"), (b - a).cast("long").alias("tf"))
        )

    # The one-element array holds the ends, so that they are worked out once.
    found = F.get(F.transform(F.array(ends_of_runs), runs), F.lit(0))
    return F.when(F.size(tokens) > 0, found).otherwise(F.array().cast("array<struct<term:string,tf:bigint>>"))
