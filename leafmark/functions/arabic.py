"""Spelling functions as expressions: letters, joined pieces, dots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: marks that aren't letters, letters that don't join onwards, letters that don't join backwards, and dotted letters
MARKS = "\u0610-\u061A\u064B-\u065F\u0670\u06D6-\u06ED\u0640"
NON_JOINERS = "اأإآٱدذرزوؤةءٲٳٵٶٷٮۃ"
NON_RECEIVERS = "ءٴ"
DOTS_ABOVE = "تثخذزشضظغفقنة"
DOTS_BELOW = "بجي"


def letters_of(word: Column) -> Column:
    return F.regexp_replace(word, f"[{MARKS}]", "")


def pieces(word: Column) -> Column:
    """Groups of letters that a spelling joins: broken after a non-joiner and before a non-receiver."""
    core = F.regexp_replace(letters_of(word), f"([{NON_JOINERS}])", "$1|")
    core = F.regexp_replace(core, f"([{NON_RECEIVERS}])", "|$1")
    return F.filter(F.split(core, "\\|"), lambda x: x != "")


def piece_count(word: Column) -> Column:
    return F.greatest(F.lit(1), F.size(pieces(word)))


def dots(word: Column) -> tuple[Column, Column]:
    """Dotted letters with their dots above, and below."""
    core = letters_of(word)
    return tuple(F.char_length(core) - F.char_length(F.regexp_replace(core, f"[{c}]", "")) for c in (DOTS_ABOVE, DOTS_BELOW))


# fixed values: forms of one letter that editions write differently, the formula before a first verse, and seats of the hamza
ALEF_FORMS, ALEF = "أإآٱٲٳٵ", "ا"
FORMULA = "بسماللهالرحمنالرحيم"
DAGGER = "ٰ"
HAMZAS, ALEFS = "ءئؤ", "اى"
LEVELS = ("exact", "hamza-insensitive", "skeleton")


def without_formula(words: Column, chapter: Column, verse: Column) -> Column:
    """A first verse's words without the formula at their start, in four words or three; chapters 1 and 9 keep all, and so does a verse
    with no words but those."""
    folded = lambda n: F.translate(F.array_join(F.transform(F.slice(words, 1, n), letters_of), ""), ALEF_FORMS, ALEF * len(ALEF_FORMS))
    cut = words
    for n in (3, 4):
        cut = F.when((F.size(words) > n) & (folded(n) == FORMULA), F.slice(words, n + 1, F.size(words))).otherwise(cut)
    return F.when((verse == 1) & ~chapter.isin(1, 9), cut).otherwise(words)


def forms(word: Column) -> tuple[Column, Column, Column]:
    """Three looser and looser sets of spellings: alefs folded, with the dagger alef left out and written; hamzas dropped; alefs dropped.

    Marks are gone before letters could be composed, so no other normalisation is needed."""
    plain = F.array(letters_of(word), letters_of(F.translate(word, DAGGER, ALEF)))
    tight = F.transform(plain, lambda w: F.translate(w, ALEF_FORMS + "ى", ALEF * len(ALEF_FORMS) + "ي"))
    loose = F.transform(tight, lambda w: F.translate(w, HAMZAS, ""))
    return tight, loose, F.transform(loose, lambda w: F.translate(w, ALEFS, ""))


def skeleton(word: Column) -> Column:
    """The one spelling at the loosest level: with alefs dropped, both of its forms are the same. Words alike at any level have it in common."""
    return F.translate(F.translate(F.translate(letters_of(word), ALEF_FORMS + "ى", ALEF * len(ALEF_FORMS) + "ي"), HAMZAS, ""), ALEFS, "")


def match_level(a: Column, b: Column) -> Column:
    """The tightest level (0, 1, 2) at which two spellings have a form in common, or null."""
    out = F.lit(None).cast("int")
    for k, (x, y) in reversed(list(enumerate(zip(forms(a), forms(b), strict=True)))):
        out = F.when(F.arrays_overlap(x, y), k).otherwise(out)
    return out
