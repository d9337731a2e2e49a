"""String functions, Column to Column."""

from __future__ import annotations

import re
from collections.abc import Callable, Collection

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Escapes that wiki paths decode to.
PATH_ESCAPES = {"%20": " ", "%28": "(", "%29": ")", "%2C": ",", "%21": "!", "%24": "$", "%25": "%"}
#: Blanks after an end mark; a full stop after a single capital letter or a title ends no sentence.
SENTENCE_END = r"(?<=[.!?])(?<!\b\p{Lu}\.)(?<!\b(?:Mr|Ms|Dr|St|Jr|Sr|vs)\.)(?<!\b(?:Mrs|Rev|Gen|Col|Sgt)\.)(?<!\bProf\.)\s+(?![a-z0-9])"
# Noise that snippets lose.
NOISE = ("( )", "( % )", ", , ", "•")


def squeeze(c: Column) -> Column:
    """Runs of spaces (not tabs) as one."""
    return F.regexp_replace(c, " {2,}", " ")


def one_line(c: Column) -> Column:
    """Tabs and line feeds as spaces, then squeezed."""
    return squeeze(F.translate(c, "\t\n", "  "))


def drop_noise(c: Column) -> Column:
    """Noise as spaces, then one ASCII punctuation character and blanks off the end."""
    for noise in NOISE:
        c = F.replace(c, F.lit(noise), F.lit(" "))
    return F.rtrim(F.regexp_replace(c, r"[!-/:-@\[-`{-~]\z", ""))


def drop_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, r"[!-/:-@\[-`{-~]", "")


def clean_template(c: Column) -> Column:
    """A question template: without reference marks, colons and leading non-letters, one space between words, a single full stop.

    A text without letters becomes a full stop alone.
    """
    c = F.regexp_replace(c, r"\[\d+\]", "")
    c = F.replace(c, F.lit(": "), F.lit(" "))
    c = F.regexp_replace(c, r"^[^\p{L}]+", "")
    c = F.trim(squeeze(F.regexp_replace(c, r"\s+", " ")))
    for mark in (",", "."):
        c = F.when(F.endswith(c, F.lit(mark)), F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c)
    return F.concat(F.rtrim(c), F.lit("."))


def clean_year_template(c: Column) -> Column:
    """As ``clean_template``, with words and punctuation set apart by spaces and noise dropped before."""
    c = F.array_join(F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}']+|[^\s\p{L}\p{N}'])"), 1), " ")
    for noise in NOISE:
        c = F.replace(c, F.lit(noise), F.lit(" "))
    return clean_template(c)


def word_count(c: Column) -> Column:
    """Number of words that white space parts; 0 for an empty or blank text."""
    return F.regexp_count(c, F.lit(r"\S+"))


def words(c: Column) -> Column:
    """Words and single punctuation marks, in order."""
    return F.regexp_extract_all(c, F.lit(r"([A-Za-z0-9_']+|[^\sA-Za-z0-9_'])"), 1)


def title_to_path(c: Column) -> Column:
    return F.replace(F.translate(c, " -", "__"), F.lit("'"), F.lit("%27"))


def path_to_title(c: Column) -> Column:
    c = F.replace(F.translate(c, "_", " "), F.lit("%27"), F.lit("'"))
    for escape, plain in PATH_ESCAPES.items():
        c = F.replace(c, F.lit(escape), F.lit(plain))
    return c


def local_path(c: Column) -> Column:
    return F.replace(c, F.lit("/wiki/"), F.lit(""))


def is_wiki_path(c: Column) -> Column:
    return F.coalesce((c != "") & F.startswith(c, F.lit("/wiki")) & ~F.startswith(c, F.lit("/wiki/File:")) & ~F.contains(c, F.lit("Category:")) & ~F.contains(c, F.lit("Special:")), F.lit(False))


def is_event_anchor(c: Column) -> Column:
    """Event anchors: no remote, portal, nested, special or section target."""
    return ~(F.contains(c, F.lit("https")) | F.contains(F.lower(c), F.lit("portal")) | F.contains(c, F.lit("/")) | F.contains(c, F.lit("Special:")) | F.contains(c, F.lit("#")))


def page_prose(c: Column, cut_all_sections: bool = False) -> Column:
    """A page's prose: what precedes "== Further reading ==", without headings and line feeds.

    ``cut_all_sections`` also ends it at the other closing sections.
    """
    names = ["Further reading"] + (["See also", "References", "External links", "Notes", "Bibliography"] if cut_all_sections else [])
    for name in names:
        c = F.substring_index(c, f"== {name} ==", 1)
    return F.trim(squeeze(F.translate(F.regexp_replace(c, r"={2,}[^=\n]+={2,}", ""), "\n", " ")))


def sentences(c: Column, abbreviations: Collection[str] = ()) -> Column:
    """Sentences: an end mark that no initial, title or one of ``abbreviations`` (in lower case, without the full stop) has, then blanks, then anything but a lower-case letter or digit."""
    known = "|".join(re.escape(a) for a in sorted(abbreviations))
    end = rf"(?<!(?<![\p{{L}}.])(?i:{known})\.){SENTENCE_END}" if known else SENTENCE_END
    return F.filter(F.transform(F.split(c, end), lambda s: F.trim(s)), lambda s: s != "")


def strip_token(c: Column) -> Column:
    """Punctuation off both ends of a token, one pass per mark, in the order . ; ( ) [ ] ,"""
    for mark in ".;()[],":
        c = F.btrim(c, F.lit(mark))
    return c


def rstrip_chars(c: Column, chars: Column) -> Column:
    """Trailing characters that are among ``chars``."""
    return F.rtrim(c, chars)


def is_item(c: Column) -> Column:
    return F.coalesce(F.startswith(c, F.lit("Q")) & c.rlike("^Q[0-9]+$"), F.lit(False))


def is_predicate(c: Column) -> Column:
    return F.coalesce(c.rlike("^P[0-9]+$"), F.lit(False))


def is_number(c: Column) -> Column:
    return F.try_to_number(c, F.lit("S999999999999999999")).isNotNull() | F.coalesce(c.rlike(r"^[+-]?\d+(\.\d+)?$"), F.lit(False))


def yes_no(c: Column) -> Column:
    return F.when(F.lower(c) == "yes", True).when(F.lower(c) == "no", False)


def wikidata_value(c: Column) -> Column:
    """An entity URL's id, a quoted literal's content, a timestamp's plain form, or the text itself."""
    plain = F.btrim(c, F.lit('"'))
    return F.when(c.rlike(r"^<?https?://www\.wikidata\.org/(entity|wiki)/"), F.btrim(F.element_at(F.split(c, "/"), -1), F.lit(">"))).otherwise(plain)


def unescape(c: Column) -> Column:
    """Literal \\uXXXX escapes decoded by the JSON parser; texts it refuses stay."""
    quoted = F.concat(F.lit('{"v":"'), F.replace(F.replace(F.regexp_replace(c, r"\\(?!u[0-9a-fA-F]{4})", r"\\\\"), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"}'))
    return F.when(F.contains(c, F.lit("\\u")), F.coalesce(F.get_json_object(quoted, "$.v"), c)).otherwise(c)


def ngrams(tokens: Column, n: int, skip: Callable[[Column], Column] | None = None) -> Column:
    """All n-grams up to ``n`` tokens, by start, then length, without those whose tokens ``skip`` holds for."""
    starts = F.sequence(F.lit(0), F.size(tokens) - 1)
    each = F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(n), F.size(tokens) - i)), lambda k: F.slice(tokens, i + 1, k)))
    grams = F.when(F.size(tokens) == 0, F.array().cast("array<array<string>>")).otherwise(F.flatten(each))
    kept = grams if skip is None else F.filter(grams, lambda g: ~skip(g))
    return F.transform(kept, lambda g: F.array_join(g, " "))
