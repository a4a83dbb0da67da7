"""Text normalisation as Column expressions. The dialects differ on purpose; each name says which it is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks and their plain forms; the last one has none and is dropped (fixed values).
MARKED = "àáâãäåèéêëìíîïòóôõöùúûüçñýÿøß"
PLAIN = "aaaaaaeeeeiiiiooooouuuucnyyo"
#: Words that say nothing about which company is meant (fixed values).
LEGAL_WORDS = "as asa ans da enk iks sa sam sti stiftelsen nuf ab b v limited ltd inc plc the og and".split()
GENERIC_WORDS = "as asa ans da enk sa nuf company norge norway gruppen group".split()
MAP_LEGAL_WORDS = "as asa sa enk nuf da ans ba stiftelsen sameiet avd avdeling".split()
TRAILING_FORMS = "as asa ba da enk nuf sa stiftelsen".split()


def folded(text: Column) -> Column:
    """Lower case without marks: æ becomes ae, ø o, å a; letters without a plain form go. Null stays null. Texts of plain letters alone are only put in lower case."""
    low = F.lower(text)
    return F.when(F.length(text) == F.octet_length(text), low).otherwise(F.translate(F.replace(low, F.lit("æ"), F.lit("ae")), MARKED, PLAIN))


def tokens(text: Column, stop: list[str] = LEGAL_WORDS, least: int = 2) -> Column:
    """T1: folded runs of letters and digits without legal words and single characters; none for null."""
    found = F.regexp_extract_all(folded(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return without(F.filter(found, lambda x: F.length(x) >= least), stop)


def without(words: Column, stop: list[str] = LEGAL_WORDS) -> Column:
    """Words that aren't among ``stop``."""
    return F.filter(words, lambda x: ~x.isin(stop)) if stop else words


def search_tokens(text: Column) -> Column:
    """T2: like T1, legal words kept."""
    return tokens(text, [], 2)


def map_tokens(text: Column) -> Column:
    """T3: letters æ, ø and å are replaced, other marks split words; no stop words."""
    low = F.translate(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("æ"), F.lit("ae")), "øå", "oa")
    return F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))


def meaningful_name_tokens(text: Column) -> Column:
    """T3 without legal words, and without words under three characters that hold no digit."""
    return F.filter(map_tokens(text), lambda x: ~x.isin(MAP_LEGAL_WORDS) & ((F.length(x) >= 3) | x.rlike("[0-9]")))


def full_name(text: Column) -> Column:
    """T5: lower-case runs of letters (with æ, ø, å) and digits, joined by a space."""
    return F.array_join(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9æøå]+"), F.lit(0)), " ")


def company_name(text: Column) -> Column:
    """T4: T5 without the legal forms at its end."""
    return F.regexp_replace(full_name(text), f"( ?\\b({'|'.join(TRAILING_FORMS)}))+$", "")


def news_name(text: Column) -> Column:
    """T6: T5 without legal forms anywhere."""
    words = F.split(full_name(text), " ")
    return F.array_join(F.filter(words, lambda x: ~x.isin(TRAILING_FORMS) & (x != "")), " ")


def channel_name(text: Column) -> Column:
    """T7: folded words without legal words, joined by a space."""
    return F.array_join(tokens(text, LEGAL_WORDS, 1), " ")


def slug(text: Column) -> Column:
    """T8: folded words joined by hyphens."""
    return F.array_join(tokens(text, [], 1), "-")


def contiguous(haystack: Column, needle: Column) -> Column:
    """Whether the words of ``needle`` stand in a row in ``haystack``; both are arrays. False for no words."""
    pad = lambda words: F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    return (F.size(needle) > 0) & (F.instr(pad(haystack), F.trim(F.array_join(needle, " "))) > 0) & F.contains(pad(haystack), pad(needle))


#: Words that may stand before a company's name in a headline (fixed values).
HEADLINE_BEFORE = "av for fra hos i med om på til og kjøper velger".split()


def headline_match(name: Column, title: Column) -> Column:
    """FLT16: whether a headline names the company: the words of its whole legal name in a row, first or after a word that may stand
    before; what follows the last `` - `` (the publisher) doesn't count."""
    words = lambda x: F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("[a-z0-9æøå]+"), F.lit(0))
    head, own = words(F.regexp_replace(title, r" - (?:(?! - ).)*$", "")), words(name)
    n = F.size(own)
    places = F.sequence(F.lit(1), F.greatest(F.size(head) - n + 1, F.lit(1)))
    at = F.exists(places, lambda i: (F.slice(head, i, n) == own) & ((i == 1) | F.coalesce(F.get(head, (i - 2).cast("int")).isin(HEADLINE_BEFORE), F.lit(False))))
    return (n > 0) & at
