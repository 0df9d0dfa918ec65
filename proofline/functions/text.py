"""Column functions on plain text. All run in the JVM but ``nfc`` and ``strip_marks``."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: The lower-case letters of the language's alphabet beyond a-z.
ALPHABET = "áàảãạăắằẳẵặâấầẩẫậéèẻẽẹêếềểễệíìỉĩịóòỏõọôốồổỗộơớờởỡợúùủũụưứừửữựýỳỷỹỵđ"
LETTER = f"[a-zA-Z{ALPHABET}{ALPHABET.upper()}]"
#: The marks a sentence is built with.
MARKS = "[.,:;!?]"
BULLET = r"^([*+\-•>]+)(?U:\s*)"

_ACCENTED = [c for c in map(chr, range(0xC0, 0x1F00)) if c.islower() and unicodedata.decomposition(c) and not unicodedata.decomposition(c).startswith("<")]
_ACCENTED += [c for c in map(chr, range(0x1EA0, 0x1F00)) if c.islower()]
_PLAIN = {c: "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn") for c in dict.fromkeys(_ACCENTED)}
_PLAIN = {c: p for c, p in _PLAIN.items() if len(p) == 1 and p != c}

Text = Column | str


def col(c: Text) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: All white space of Unicode, which ``(?U)\\s`` matches.
_SPACES = "".join(map(chr, (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(c: Text) -> Column:
    return F.trim(col(c), F.lit(_SPACES))


def is_blank(c: Text) -> Column:
    return ~col(c).rlike(r"(?U)\S")


def words(c: Text) -> Column:
    """Without a lambda, so that equal calls in one projection are computed once."""
    return F.array_remove(F.split(col(c), r"(?U)\s+"), F.lit(""))


def word_count(c: Text) -> Column:
    return F.size(words(c))


def normalize_spaces(c: Text) -> Column:
    return strip(F.regexp_replace(col(c), r"[ \t]+", " "))


def normalize_punctuation_spacing(c: Text) -> Column:
    """No white space before a mark, one space between a mark and a letter."""
    closed = F.regexp_replace(col(c), rf"(?U)\s+({MARKS})", "$1")
    return F.regexp_replace(closed, f"({MARKS})({LETTER})", "$1 $2")


def normalize_all(c: Text) -> Column:
    return normalize_punctuation_spacing(normalize_spaces(c))


def _ranges(codes: list[int]) -> str:
    """A character class of ascending code points, as ranges."""
    out: list[list[int]] = []
    for c in codes:
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\x{{{a:x}}}-\\x{{{z:x}}}" for a, z in out)


#: What composition may change: marks, vowels and finals of Hangul, and characters that are not their own composition.
_OWN = [c for lo, hi in ((0x80, 0x10000), (0x1D100, 0x1D200), (0x2F800, 0x2FA20)) for c in range(lo, hi) if not 0xD800 <= c < 0xE000 and not unicodedata.is_normalized("NFC", chr(c))]
#: None is below U+0300: that test comes first, as the others go through every range for each character.
_MAY_CHANGE = rf"[\x{{300}}-\x{{10ffff}}&&[\p{{M}}\x{{1160}}-\x{{11ff}}{_ranges(_OWN)}]]"


@pandas_udf(StringType())
def _composed(c: pd.Series) -> pd.Series:
    return c.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(c: str) -> Column:
    """Of a column (by name, as it is used three times); only texts that composition may change go to
    Python."""
    return F.coalesce(_composed(F.when(F.col(c).rlike(_MAY_CHANGE), F.col(c))), F.col(c))


@pandas_udf(StringType())
def strip_marks(c: pd.Series) -> pd.Series:
    """Any script: without combining marks, in lower case."""
    plain = lambda x: "".join(k for k in unicodedata.normalize("NFD", x) if unicodedata.category(k) != "Mn").lower()
    return c.map(lambda x: None if x is None else plain(x))


def remove_accents(c: Text) -> Column:
    """Composed Latin letters without their accents, in lower case; đ stays, as it has none."""
    return F.translate(F.lower(col(c)), "".join(_PLAIN), "".join(_PLAIN.values()))


def has_letter(c: Text) -> Column:
    return col(c).rlike(LETTER)


def bullet(c: Text) -> Column:
    """The bullet that a stripped text starts with, and the white space after it."""
    return F.regexp_extract(strip(c), BULLET, 0)


def without_bullet(c: Text) -> Column:
    return F.regexp_replace(strip(c), BULLET, "")


def align_trailing_punctuation(original: Text, corrected: Text) -> Column:
    """The corrected text with the final marks of the original; as it is if either is blank."""
    tail = r"[.;:!?]+$"
    own = F.regexp_replace(strip(corrected), tail, "")
    return F.when(is_blank(original) | is_blank(corrected), col(corrected)).otherwise(F.concat(own, F.regexp_extract(strip(original), f"({tail})", 1)))


def restore_whitespace(original: Text, generated: Text) -> Column:
    lead, trail = F.regexp_extract(col(original), r"(?U)^\s*", 0), F.regexp_extract(col(original), r"(?U)\s*$", 0)
    return F.concat(lead, strip(generated), F.when(is_blank(original), F.lit("")).otherwise(trail))


def is_upper(c: Text) -> Column:
    return col(c).rlike(r"\p{Lu}") & ~col(c).rlike(r"\p{Ll}")


def is_title(c: Text) -> Column:
    """One capital first, then no more (a single word)."""
    return col(c).rlike(r"^[^\p{L}]*\p{Lu}[^\p{Lu}]*$")
