"""Quality rules, line first: judge each line, drop the failing ones, then reject documents that lose too much.

Null text counts as the empty text (no words: rejected). Rows are judged one by one, so repeated rows, null or
repeated ids and further columns of any name change nothing; an empty table gives an empty result. Texts are read whole; a
text is as many lines as it has line feeds and one more, and of equal lines each is judged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamark.llm.common import count, held, unwrapped, whole, words, wrapped

SYMBOLS = r"[#*$%&|<>]"
#: A run of two or more of these within a word is noise, not punctuation ("word***", "WORD!!").
NOISE_RUN = r"[#*$%&!?=~^_]{2,}"
#: Marks between the entries of a menu.
SEPARATOR = "[|»«•·›‹→]"
#: Marks that end a sentence or a clause, in the scripts that have their own (fixed values).
SENTENCE = "[.!?…;:。．！？；：؟؛۔।॥։፡።᠃᠉។៕၊။]"
#: Phrases of page furniture, in lower case (fixed values): English, French, German, Spanish.
BOILERPLATE = (
    "all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|we use cookies|accept (?:all )?cookies"
    "|subscribe to our|sign up for our|click here to|skip to (?:main )?content|follow us on|share this (?:article|page|post)"
    "|powered by|log ?in to|javascript is (?:disabled|required)"
    "|tous droits réservés|politique de confidentialité|mentions légales|conditions d'utilisation|nous utilisons des cookies|abonnez-vous à|cliquez ici pour|suivez-nous sur"
    "|alle rechte vorbehalten|datenschutzerklärung|nutzungsbedingungen|wir verwenden cookies|zum inhalt springen|newsletter abonnieren|hier klicken|folgen sie uns"
    "|todos los derechos reservados|política de privacidad|aviso legal|condiciones de uso|utilizamos cookies|suscríbete a|haz clic aquí|síguenos en"
)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A line fails with more than this share of noisy words, or of separators to words.
MAX_NOISY, MAX_SEPARATORS = 0.3, 0.2
#: A boilerplate phrase condemns lines of so many words at most; longer ones are prose that mentions it.
BOILERPLATE_WORDS = 25
#: A line of so many words without any mark of SENTENCE is no prose if each of its words occurs more than MAX_AGAIN times on average:
#: verse, tables, code and languages without such marks repeat their words less within a line.
PROSE_WORDS, MAX_AGAIN = 20, 2
#: A document is rejected when its kept lines hold less than this share of its word characters.
MIN_KEPT = 0.5


def _order(hashes: Column) -> Column:
    """The windows of a text by (hash, position): equal ones become neighbours."""
    return F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def _spots(s: Column) -> Column:
    """Word positions inside the windows of _order that have an equal neighbour, as arrays of three."""
    return F.transform(
        F.filter(s, lambda p, k: ((k > 0) & (F.get(s, k - 1)["h"] == p["h"])) | (F.get(s, k + 1)["h"] == p["h"])),
        lambda p: F.array(p["i"], p["i"] + 1, p["i"] + 2),
    )


def judged(text: Column) -> Column:
    """The lines of a text, each with its number of words, noise runs and separators."""
    return F.transform(
        F.split(text, "\n", -1),
        lambda x: F.struct(x.alias("line"), F.size(words(x)).alias("n"), count(x, NOISE_RUN).alias("noise"), count(x, SEPARATOR).alias("marks")),
    )


def line_fails(x: Column, phrases: str = BOILERPLATE, max_noisy: float = MAX_NOISY, max_separators: float = MAX_SEPARATORS, prose_words: int = PROSE_WORDS, max_again: float = MAX_AGAIN) -> Column:
    """Whether a judged line fails for its punctuation (noise, or none at all beside repeated words), as a menu, or as page furniture.

    Lines without a word never fail.
    """
    noisy = x["noise"] > max_noisy * x["n"]
    unmarked = (x["n"] >= prose_words) & ~x["line"].rlike(SENTENCE) & (x["n"] > max_again * F.size(F.array_distinct(words(x["line"]))))
    menu = (x["marks"] >= 3) & (x["marks"] > max_separators * x["n"])
    furniture = (x["n"] <= BOILERPLATE_WORDS) & F.lower(x["line"]).rlike(phrases)
    return (x["n"] > 0) & (noisy | unmarked | menu | furniture)


#: What with_rules adds.
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text")


def with_rules(docs: DataFrame, text: str = "text", prefix: str = "__", fails: Callable[[Column], Column] = line_fails, min_kept: float = MIN_KEPT) -> DataFrame:
    """`fails` judges a line of judged(). docs with {prefix}n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, clean_text added."""
    p = prefix
    t = whole(text)
    df = docs.withColumns({f"{p}w": words(t), f"{p}lines": judged(t)})
    w, lines = F.col(f"{p}w"), F.col(f"{p}lines")
    df = df.withColumns(
        {
            f"{p}n_words": F.size(w).cast("long"),
            f"{p}word_chars": F.char_length(F.array_join(w, "")).cast("long"),
            f"{p}n_symbols": count(t, SYMBOLS).cast("long"),
            f"{p}full": F.transform(F.filter(lines, lambda x: x["n"] > 0), lambda x: x["line"]),
            f"{p}good": F.transform(F.filter(lines, lambda x: ~fails(x)), lambda x: x["line"]),
            f"{p}h": F.when(
                F.size(w) >= 3,
                F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))),
            ).otherwise(F.array().cast("array<bigint>")),
        }
    )
    full, h = F.col(f"{p}full"), F.col(f"{p}h")
    df = df.withColumns(
        {
            f"{p}n_dup_lines": (F.size(full) - F.size(F.array_distinct(full))).cast("long"),
            f"{p}clean_text": F.array_join(F.col(f"{p}good"), "\n"),
            f"{p}s": F.when(F.size(F.array_distinct(h)) < F.size(h), _order(h)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
        }
    )
    df = df.withColumn(f"{p}n_repeat_words", F.size(F.array_distinct(F.flatten(_spots(F.col(f"{p}s"))))).cast("long"))
    df = df.withColumn(
        f"{p}base_failed",
        (F.col(f"{p}n_words") < MIN_WORDS) | (100 * F.col(f"{p}n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{p}n_words")),
    )
    left = F.char_length(F.regexp_replace(F.col(f"{p}clean_text"), r"[\x20\x09-\x0D]+", ""))
    df = df.withColumn(f"{p}kept", ~F.col(f"{p}base_failed") & (left >= min_kept * F.col(f"{p}word_chars")))
    df = df.withColumns({f"{p}{c}": held(F.col(f"{p}{c}")) for c in ADDED})
    return df.drop(*(f"{p}{x}" for x in ("w", "lines", "full", "good", "h", "s")))


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fails: Callable[[Column], Column] = line_fails, min_kept: float = MIN_KEPT) -> DataFrame:
    """One row per row of docs: its id, counts, verdict and the text without the failing lines."""
    df = with_rules(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text")), "__text", fails=fails, min_kept=min_kept)
    return df.select("doc_id", *(F.col(f"__{x}").alias(x) for x in ADDED))


def clean(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns; text and n_chars are those of the kept lines."""
    df = with_rules(wrapped(docs, "text"), prefix="q_").filter("q_kept")
    new = {"text": F.col("q_clean_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("q_clean_text").cast("long")
    return unwrapped(df, docs.columns, new)
