"""Per-document text quality statistics and rule verdicts.

All statistics are JVM expressions over the whole text: words, characters,
symbols, punctuation, bullets, links, repetition and the share of common words.
Fixed thresholds turn them into reasons, one per failed rule; a document is
rejected if any deciding rule fails.

The thresholds are published ones:
Rae et al. 2021 (Gopher): mean word length 3 to 10, hash or ellipsis per word
0.1, bullet lines 90 %, words with a letter 80 %, repeated lines 30 % of the lines
or 20 % of the characters, repeated word pairs 20 % of the characters, 50 words;
Laurencon et al. 2022 (ROOTS): stop words 30 %; Raffel et al. 2020 (C4): a line is
a sentence if it has five words and ends in a terminal mark; Penedo et al. 2024
(FineWeb): 12 % of the lines end in a terminal mark.

Prose that is short, unpunctuated, quoted or chat is no failure here. So the
rules on length, line ends and ellipses are recorded and do not decide; rules on
shares of words ask for the five words of a sentence; and the stop-word rule,
which needs a list of the language, yields to a text of which half the characters
stand in sentences by C4's rule. A word pair counts as repeated where a word
follows itself. These limits are not published: half the characters in
links, half the words of a text of under five words tagged, eight signs without a
word, ten words for repetition.

Defined cases: null, empty and blank texts have zero counts, null ratios, no
reasons and are never rejected; a text without words has no mean length; ties
cannot occur (no ranking); extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of the six languages of the corpus.
COMMON_WORDS = {
    "en": "the a an and of to in out up off is was that it for on with as be by this at from his her they we you i not are or has have had there been my our your she he its if when who what which no so than then near me do did will would can could should after before during between",
    "de": "der die das und ist nicht ein eine einen dem den des im in zu mit auf für von sich es ich du er sie wir ihr dass wer noch immer schon mehr hat haben war aber oder auch als am um mir mich meine mein kann wir was warum so nur",
    "fr": "le la les et est un une des du de que qui dans pas ne pour sur avec il elle nous vous je tu se ce au aux plus a encore toujours était mais ou si par mon ma mes très d'un c'est j'ai",
    "es": "el la los las y es un una de del que en no por para con se lo al más ya está fue su mi yo tú si pero como sigue todavía nos muy sin tan qué quién hay ser son",
    "pt": "o a os as e é um uma de do da que em no na não por para com se ao mais já está foi minha meu nós você mas ou como ainda muito sem eu ele ela isso à às nos das dos",
    "nl": "de het een en is niet van in op te dat die voor met zijn er aan ik je hij ze wij wie om bij ook maar nog al na heeft haar naar waarom mijn mij wil kan graag iemand niemand hebben of deze dit nu wat er",
}
#: Pronouns, determiners and prepositions besides them, for shares of stop words.
MORE_WORDS = (
    "all any both each every some such their them these those under over into past across around again against because until while "
    "alle diese dieser dieses jeder kein keine ohne unter über vor wieder gegen zwischen "
    "bien cet cette ces son sa ses nos vos notre votre leur leurs lui sans sous chez entre quand comme "
    "nosotros ella ellos este esta estos estas ese esa sobre entre cuando porque hasta desde "
    "este esta esse essa nosso nossa seu sua sobre entre quando porque até desde "
    "dit deze die onder over tussen zonder tegen omdat tot onze"
)
_ALL = sorted({w for ws in COMMON_WORDS.values() for w in ws.split()} | set(MORE_WORDS.split()))
WORD = r"[\p{L}\p{N}][\p{L}\p{M}\p{N}_'’\-]*+"
LINES = r"\r\n|\n|\r"
BULLET = r"^\s*+(?:[-–•*·‣◦+]|\d{1,3}[.)])\s"
#: A terminal mark, behind it only closing marks, emoji and white space.
ENDED = r"[.!?…。！？][\s\p{Pe}\p{Pf}\p{So}\p{Cf}\p{Mn}\"'*]*+$"
LINK = r"(?i)\b(?:https?://|www\.)\S++"
DOUBLED = r"(?<!\p{L})(\p{L}++)(?:\s++\1(?!\p{L}))++"

#: The published thresholds, then those that are ours.
MIN_STOP_WORDS = 0.3
SENTENCE_WORDS = 5
WORD_LENGTH = (3.0, 10.0)
MAX_SYMBOLS = 0.1
MAX_BULLETS = 0.9
MIN_LETTER_WORDS = 0.8
MAX_REPEATED_LINES, MAX_REPEATED_CHARS, MAX_REPEATED_PAIRS = 0.3, 0.2, 0.2
MIN_ENDED, MIN_WORDS = 0.12, 50
MOSTLY = 0.5
MAX_SIGNS = 8
REPEAT_WORDS = 10


def _total(array: Column | str, of) -> Column:
    return F.aggregate(array, F.lit(0), lambda a, x: a + of(x).cast("int"))


def statistics(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document: counts and ratios (null where a ratio has no denominator)."""
    # a null text gives null lines and words; each step is a column of its own, so that it is computed once
    d = docs.select(key, F.when(F.col("text").rlike(r"(?U)\S"), F.col("text")).alias("text"))
    d = d.withColumn("raw", F.filter(F.split("text", LINES), lambda l: l.rlike(r"(?U)\S")))
    d = d.withColumns({"parts": F.transform("raw", lambda l: F.regexp_extract_all(F.lower(l), F.lit(f"({WORD})"), F.lit(1))), "trimmed": F.transform("raw", lambda l: F.trim(l))})  # trim by itself would take the index for its characters
    line = lambda z: F.struct(F.char_length(z["raw"]).alias("size"), z["raw"].rlike(ENDED).alias("ended"), (F.size(z["parts"]) >= SENTENCE_WORDS).alias("long"), z["raw"].rlike(BULLET).alias("bullet"))
    d = d.withColumns({"words": F.flatten("parts"), "lines": F.transform(F.arrays_zip("raw", "parts"), line), "apart": F.array_distinct("trimmed")})
    length, some = F.char_length("text"), lambda c: F.coalesce(c, F.lit(0))
    without = lambda pattern, to="": length - F.char_length(F.regexp_replace("text", pattern, to))
    linked = F.when(F.col("text").contains("://") | F.col("text").contains("www."), without(LINK)).otherwise(F.lit(0))
    d = d.select(
        key,
        some(length).alias("n_chars"),
        some(F.size("raw")).alias("n_lines"),
        some(F.size("words")).alias("n_words"),
        _total("words", F.char_length).alias("word_chars"),
        F.size(F.filter("words", lambda w: w.isin(*_ALL))).alias("n_common"),
        F.size(F.filter("words", lambda w: ~w.rlike(r"\p{L}"))).alias("n_numeric"),
        without(r"[^\p{L}\p{M}]++").alias("n_others"),
        without("#").alias("n_hashes"),
        without(r"\.\.\.|…", "  ").alias("n_ellipses"),
        without(r"\p{P}++").alias("n_punctuation"),
        without(DOUBLED, "$1").alias("doubled_chars"),
        linked.alias("link_chars"),
        _total("lines", lambda x: x["size"]).alias("line_chars"),
        _total("lines", lambda x: F.when(x["ended"] & x["long"], x["size"]).otherwise(0)).alias("sentence_chars"),
        _total("lines", lambda x: x["ended"]).alias("n_ended"),
        _total("lines", lambda x: x["bullet"]).alias("n_bullets"),
        F.size("apart").alias("n_distinct"),
        _total("trimmed", F.char_length).alias("trimmed_chars"),
        _total("apart", F.char_length).alias("distinct_chars"),
    )
    ratio = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), 4)
    return d.select(
        key,
        "n_chars",
        "n_words",
        "n_lines",
        ratio("word_chars", "n_words").alias("mean_word_length"),
        ratio("n_hashes", "n_words").alias("hash_ratio"),
        ratio("n_ellipses", "n_words").alias("ellipsis_ratio"),
        ratio("n_punctuation", "n_chars").alias("punctuation_share"),
        (1 - ratio("n_others", "n_chars")).alias("letter_share"),
        (1 - ratio("n_numeric", "n_words")).alias("letter_word_share"),
        ratio("n_ended", "n_lines").alias("ended_line_share"),
        ratio("sentence_chars", "line_chars").alias("sentence_share"),
        ratio("n_bullets", "n_lines").alias("bullet_share"),
        ratio("n_common", "n_words").alias("common_share"),
        ratio("link_chars", "n_chars").alias("link_share"),
        ratio("doubled_chars", "n_chars").alias("doubled_share"),
        (1 - ratio("n_distinct", "n_lines")).alias("repeated_line_share"),
        (1 - ratio("distinct_chars", "trimmed_chars")).alias("repeated_char_share"),
    )


def verdicts(stats: DataFrame) -> DataFrame:
    """Adds ``reasons`` (every failed rule, in a fixed order) and ``rejected``."""
    c = F.col
    worded, several = c("n_words") >= SENTENCE_WORDS, c("n_lines") > 3
    deciding = {
        "stop_words": worded & (c("common_share") < MIN_STOP_WORDS) & (c("sentence_share") < MOSTLY),
        "word_length": (worded & (c("mean_word_length") < WORD_LENGTH[0])) | (c("mean_word_length") > WORD_LENGTH[1]),
        "hashes": (c("hash_ratio") > F.when(worded, MAX_SYMBOLS).otherwise(MOSTLY)) & (c("sentence_share") < MOSTLY),
        "bullets": (c("n_lines") > 2) & (c("bullet_share") > MAX_BULLETS) & (c("sentence_share") < MOSTLY),
        "letter_words": worded & (c("letter_word_share") < MIN_LETTER_WORDS) & (c("sentence_share") < MOSTLY),
        "repeated_lines": several & ((c("repeated_line_share") > MAX_REPEATED_LINES) | (c("repeated_char_share") > MAX_REPEATED_CHARS)),
        "repeated_words": (c("n_words") >= REPEAT_WORDS) & (c("doubled_share") > MAX_REPEATED_PAIRS),
        "links": c("link_share") > MOSTLY,
        "no_words": (c("n_words") == 0) & (c("n_chars") > MAX_SIGNS),
    }
    noted = {
        "ellipses": c("ellipsis_ratio") > MAX_SYMBOLS,
        "few_ended_lines": c("ended_line_share") < MIN_ENDED,
        "few_words": c("n_words") < MIN_WORDS,
    }
    some = c("n_chars") > 0
    reason = lambda rules: [F.when(some & F.coalesce(x, F.lit(False)), F.lit(n)) for n, x in rules.items()]
    decided = F.array_compact(F.array(*reason(deciding)))
    return stats.withColumns({"reasons": F.array_compact(F.array(*reason(deciding), *reason(noted))), "rejected": F.size(decided) > 0})
