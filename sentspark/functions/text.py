"""Text functions: columns in, columns out; Python only for texts with bad bytes."""

from __future__ import annotations

import functools
import sys
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values ------------------------------------------------------------------
# Unicode white space plus the four separators U+001C..U+001F.
SPACE = r"[\p{IsWhite_Space}\x{1c}-\x{1f}]"
NOT_SPACE = r"[^\p{IsWhite_Space}\x{1c}-\x{1f}]"
SPACE_CHARACTERS = (
    "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# A line ends at CR LF, at a lone CR or at LF.
LINE_END = r"\r\n?|\n"
# White space that follows a sentence terminator.
SENTENCE_GAP = r"(?<=[。！？\.!?…！？؟।:;])" + SPACE + "+"
# Runs of word characters, or runs of other characters that are not spaces.
WORDS = r"(?U)\w+|[^\w\s]+"
# The same with every punctuation mark and these nine symbols as words of their own.
PUNCTUATION = r"\p{P}$+<=>^`|~"
WORDS_AND_PUNCTUATION = rf"(?U)[\w&&[^{PUNCTUATION}]]+|[{PUNCTUATION}]|[^\w\s{PUNCTUATION}]+"
# Reserved tokens, with ids 0 to 4.
SPECIAL_TOKENS = ["<mask>", "<pad>", "<unk>", "<s>", "</s>"]
MASK, PAD, UNK, START, END = range(5)
MAX_WORDS = 128
# -------------------------------------------------------------------------------

# Reserved tokens found in raw text travel through the normaliser as noncharacters,
# which are neither punctuation nor letters.
_STAND_INS = {token: chr(0xFDD0 + i) for i, token in enumerate(SPECIAL_TOKENS)}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim(text: Column | str) -> Column:
    """Strip Unicode white space from both ends."""
    return F.btrim(_col(text), F.lit(SPACE_CHARACTERS))


def word_count(text: Column | str) -> Column:
    """Number of words between white space; 0 for a blank text."""
    return F.regexp_count(_col(text), F.lit(NOT_SPACE + "+"))


def within_word_limit(text: Column | str, limit: int = MAX_WORDS) -> Column:
    """Whether a text has at most ``limit`` words. One too many needs that many
    characters and as many spaces less one, so short texts are not counted."""
    short = F.char_length(_col(text)) <= 2 * limit
    return F.when(short, True).otherwise(word_count(text) <= limit)


def lines(text: Column | str) -> Column:
    """The lines of a text; a line end at the very end opens no further line."""
    t = _col(text)
    n = F.char_length(t)
    body = (
        F.when(t.endswith("\r\n"), F.left(t, n - 2))
        .when(t.endswith("\n") | t.endswith("\r"), F.left(t, n - 1))
        .otherwise(t)
    )
    cut = F.when(t.contains("\r"), F.split(body, LINE_END, -1)).otherwise(F.split(body, "\n", -1))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(cut)


def sentences(text: Column | str) -> Column:
    """Split at white space after a terminator; the terminator stays."""
    return F.split(_col(text), SENTENCE_GAP, -1)


def valid_utf8(text: Column | str, bad: str = "drop") -> Column:
    """Repair text read from files with invalid bytes.

    ``drop`` removes exactly the bad bytes and keeps a U+FFFD that the text held; ``replace`` puts
    U+FFFD for each bad sequence. Only texts with bad bytes leave the JVM.
    """
    t = _col(text)
    if bad == "replace":
        return F.make_valid_utf8(t)
    if bad == "drop":

        @F.arrow_udf("string")
        def without_bad_bytes(raw: pa.Array) -> pa.Array:
            return pa.array([None if x is None else x.decode("utf-8", "ignore") for x in raw.to_pylist()], pa.string())

        broken = F.when(~F.is_valid_utf8(t), t.cast("binary"))
        return F.when(F.is_valid_utf8(t), t).otherwise(without_bad_bytes(broken))
    raise ValueError(f"bad must be 'drop' or 'replace', not {bad!r}")


@functools.cache
def _accent_map() -> tuple[str, str]:
    """(characters, replacements) for ``translate``, from the Unicode database.

    Characters whose decomposition leaves one base character map to it; characters
    that leave nothing, the marks, stand at the end and are deleted.
    """
    mapped, bases, deleted = [], [], []
    for cp in range(sys.maxunicode + 1):
        c = chr(cp)
        if 0xD800 <= cp <= 0xDFFF or 0xAC00 <= cp <= 0xD7A3:
            continue
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x)[0] != "M")
        if base == "":
            deleted.append(c)
        elif base != c:
            mapped.append(c)
            bases.append(base)
    assert all(len(b) == 1 for b in bases)
    return "".join(mapped) + "".join(deleted), "".join(bases)


def _decompose_hangul(text: Column) -> Column:
    """Syllables U+AC00..U+D7A3 as their two or three letters (arithmetic of the standard)."""
    lead = F.array(*[F.lit(chr(0x1100 + i)) for i in range(19)])
    vowel = F.array(*[F.lit(chr(0x1161 + i)) for i in range(21)])
    tail = F.array(F.lit(""), *[F.lit(chr(0x11A7 + i)) for i in range(1, 28)])

    def letters(c: Column) -> Column:
        s = F.ascii(c) - F.lit(0xAC00)
        at = lambda table, i: F.element_at(table, i.cast("int") + 1)
        return F.when(
            c.between("가", "힣"),
            F.concat(
                at(lead, F.floor(s / 588)), at(vowel, F.floor((s % 588) / 28)), at(tail, s % 28)
            ),
        ).otherwise(c)

    chars = F.array_join(F.transform(F.split(text, ""), letters), "")
    return F.when(text.rlike("[가-힣]"), chars).otherwise(text)


def strip_accents(text: Column | str) -> Column:
    """Canonical decomposition with every combining mark removed.

    Spark has no decomposition function. Hangul follows arithmetic and everything else
    maps one character to at most one, so ``translate`` covers the rest.
    """
    return F.translate(_decompose_hangul(_col(text)), *_accent_map())


def normalize_text(
    text: Column | str, keep_punctuation: bool = False, keep_accents: bool = True
) -> Column:
    t = _col(text)
    if not keep_punctuation:
        t = F.regexp_replace(t, r"\p{P}", "")
    # every capital sigma alone: Spark makes the one that ends a word a final sigma
    t = F.lower(F.translate(t, "Σ", "σ"))
    return t if keep_accents else strip_accents(t)


def pretokenize(text: Column | str, keep_punctuation: bool = False) -> Column:
    """The words of a normalised text."""
    pattern = WORDS_AND_PUNCTUATION if keep_punctuation else WORDS
    return F.regexp_extract_all(_col(text), F.lit(pattern), 0)


def words(
    text: Column | str, keep_punctuation: bool = False, keep_accents: bool = True
) -> Column:
    """Normalise, then split into words."""
    return pretokenize(normalize_text(text, keep_punctuation, keep_accents), keep_punctuation)


def has_words(text: Column | str) -> Column:
    """Whether :func:`words` finds any: the first character that is neither white space nor
    punctuation tells, so the text is not split for it."""
    return F.rlike(_col(text), F.lit(r"(?U)[^\s\p{P}]"))


def words_to_encode(
    text: Column | str, keep_punctuation: bool = False, keep_accents: bool = True
) -> Column:
    """Like :func:`words`, with reserved tokens in the text kept whole."""
    t = _col(text)
    marked = t
    for token, stand_in in _STAND_INS.items():
        marked = F.replace(marked, F.lit(token), F.lit(f" {stand_in} "))
    found = words(marked, keep_punctuation, keep_accents)

    def restore(w: Column) -> Column:
        out = w
        for token, stand_in in _STAND_INS.items():
            out = F.when(w == stand_in, token).otherwise(out)
        return out

    plain = words(t, keep_punctuation, keep_accents)
    has_special = t.contains("<") & t.rlike("|".join(SPECIAL_TOKENS))
    return F.when(has_special, F.transform(found, restore)).otherwise(plain)
