"""Text expressions: analysis for the index, query cleaning, titles, escaping."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed patterns.  Java's \w covers ASCII only, so the classes are spelled out.
TERM_PATTERN = r"[\p{L}\p{N}]+"
QUERY_PATTERN = r"[\p{L}\p{N}_]+"
BLANKS = r"[ \t\r\n\f]"
# Every line boundary, not only the newline.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
# A token for chunking, with the blanks after it: one ideograph or kana, or a run of other
# characters.  A run is at most 64 long, so that text without blanks is still cut.
IDEOGRAPHS = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"
# ASCII is told first, since looking up the script of a character costs more than all else here.
_BEYOND_ASCII = r"\x{80}-\x{10FFFF}"
PIECE_PATTERN = (
    rf"(?:[{_BEYOND_ASCII}&&[{IDEOGRAPHS}]]|[\x21-\x7F\x00-\x08\x0B\x0E-\x1F[{_BEYOND_ASCII}&&[^{IDEOGRAPHS}]]]{{1,64}})[ \t\r\n\f]*"
)


def _accent_table() -> tuple[str, str]:
    """Letters that are a base letter plus combining marks, and their base letters.

    Covers Latin, Greek and Cyrillic blocks.  The combining marks themselves have no
    counterpart, so ``translate`` deletes them.
    """
    accented, base = [], []
    for point in [*range(0x00C0, 0x0530), *range(0x1E00, 0x2000)]:
        letter = chr(point)
        parts = unicodedata.normalize("NFD", letter)
        if len(parts) > 1 and parts[0].isalpha() and all(unicodedata.combining(p) for p in parts[1:]):
            accented.append(letter)
            base.append(parts[0])
    marks = [chr(point) for point in range(0x0300, 0x0370)]
    return "".join(accented + marks), "".join(base)


ACCENTED, PLAIN = _accent_table()


def fold(col: Column) -> Column:
    """Lower-case without diacritics.  Pure ASCII text skips the letter-by-letter pass."""
    ascii_only = F.octet_length(col) == F.length(col)
    return F.when(ascii_only, F.lower(col)).otherwise(F.translate(F.lower(col), ACCENTED, PLAIN))


#: Letters of Latin-1 that fold to an ASCII one, and marks that fold to nothing.
ASCII_FOLDS = {c: PLAIN[i] if i < len(PLAIN) else "" for i, c in enumerate(ACCENTED) if i >= len(PLAIN) or c < "\u0100"}
# Letters of Latin-1 are told by one lookup, and all marks are one range: a long class is walked for every character.
_UNFOLDED = rf"[{_BEYOND_ASCII}&&[^{''.join(c for c, to in ASCII_FOLDS.items() if to)}\x{{300}}-\x{{36F}}]]"


def folds_to_ascii(lowered: Column) -> Column:
    """Whether all that a lower-cased text has beyond ASCII is in ``ASCII_FOLDS``."""
    return ~F.rlike(lowered, F.lit(_UNFOLDED))


def terms(col: Column, *, stem: bool = False, fold_marks: bool = True) -> Column:
    """Index analysis: fold case and diacritics, split on anything but letters and
    digits, optionally stem."""
    cleaned = fold(col) if fold_marks else F.lower(col)
    tokens = terms_of(cleaned)
    return stem_terms(tokens) if stem else tokens


def terms_of(cleaned: Column) -> Column:
    """Words of a text that is folded already."""
    return F.regexp_extract_all(cleaned, F.lit(TERM_PATTERN), F.lit(0))


def query_tokens(col: Column) -> Column:
    """Words of a query, in order and with repeats.  One-character ASCII words are noise;
    a lone non-ASCII character is a real term."""
    words = F.regexp_extract_all(F.lower(col), F.lit(QUERY_PATTERN), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) > 1) | (F.octet_length(w) > 1))


def query_terms(col: Column, *, stem: bool = False, fold_marks: bool = True) -> Column:
    """Query words analysed the way indexed text is, repeats kept."""
    words = query_tokens(col)
    analysed = terms(F.array_join(words, " "), stem=False, fold_marks=fold_marks)
    return stem_terms(analysed) if stem else analysed


def escape_markup(col: Column) -> Column:
    """Escape &, <, >, double and single quotes."""
    out = col
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def strip_blanks(col: Column) -> Column:
    return F.regexp_replace(col, rf"^{BLANKS}+|{BLANKS}+\z", "")


def first_title(text: Column, fallback: Column) -> Column:
    """Text of the first line among the first 50 that starts with ``# ``; else the
    fallback.  A title line without text gives NULL, as an empty fallback does."""
    lines = F.slice(F.split(text, LINE_BREAK), 1, 50)
    marked = F.filter(F.transform(lines, strip_blanks), lambda line: F.startswith(line, F.lit("# ")))
    title = strip_blanks(F.substring(F.get(marked, F.lit(0)), 3, 2147483647))
    return F.nullif(F.when(F.size(marked) > 0, title).otherwise(fallback), F.lit(""))


def yes_no(col: Column) -> Column:
    """PASS for a YES answer, FAIL for NO: a leading word decides, else the word that
    comes first anywhere, else blank."""
    upper = F.upper(F.trim(col))
    leading = F.regexp_extract(upper, r"^\s*(YES|NO)\b", 1)
    yes_at, no_at = F.instr(upper, "YES"), F.instr(upper, "NO")
    anywhere = (
        F.when((yes_at == 0) & (no_at == 0), "")
        .when(yes_at == 0, "FAIL")
        .when(no_at == 0, "PASS")
        .when(yes_at < no_at, "PASS")
        .otherwise("FAIL")
    )
    return F.when(leading == "YES", "PASS").when(leading == "NO", "FAIL").otherwise(anywhere)


def redact_ids(text: Column, valid: Column, pattern: str, marker: str) -> Column:
    """Replace every id-shaped token that is not in ``valid``."""
    unknown = F.array_except(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), valid)
    return F.aggregate(
        unknown,
        text,
        lambda acc, token: F.regexp_replace(acc, F.concat(F.lit(r"\b"), token, F.lit(r"\b")), F.lit(marker)),
    )


# --- stemming -------------------------------------------------------------------------
# Suffix rules of the Porter algorithm (M. F. Porter, "An algorithm for suffix stripping",
# 1980): fixed values, longest suffix first within a step.
STEP2 = (
    ("ational", "ate"), ("ization", "ize"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("tional", "tion"), ("biliti", "ble"), ("entli", "ent"), ("ousli", "ous"), ("ation", "ate"),
    ("alism", "al"), ("aliti", "al"), ("iviti", "ive"), ("enci", "ence"), ("anci", "ance"),
    ("izer", "ize"), ("alli", "al"), ("ator", "ate"), ("bli", "ble"), ("logi", "log"), ("eli", "e"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", ""))
STEP4 = (
    "ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ion", "ism", "ate", "iti", "ous", "ive", "ize",
    "al", "er", "ic", "ou",
)
ASCII_WORD = re.compile(r"[a-z]{3,}")


def _shape(stem: str) -> str:
    """Consonant/vowel pattern of a word: y is a vowel after a consonant."""
    out = ""
    for letter in stem:
        vowel = letter in "aeiou" or (letter == "y" and out.endswith("c"))
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _short_end(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def porter_stem(word: str) -> str:
    """Stem of one lower-case word; words with other than a-z letters stay as they are."""
    if not ASCII_WORD.fullmatch(word):
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        cut = 2 if word.endswith("ed") else 3 if word.endswith("ing") else 0
        if cut and "v" in _shape(word[:-cut]):
            word = word[:-cut]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short_end(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for rules in (STEP2, STEP3):
        for suffix, to in rules:
            if word.endswith(suffix):
                if _measure(word[: -len(suffix)]) > 0:
                    word = word[: -len(suffix)] + to
                break
    for suffix in STEP4:
        if word.endswith(suffix):
            rest = word[: -len(suffix)]
            if _measure(rest) > 1 and (suffix != "ion" or rest.endswith(("s", "t"))):
                word = rest
            break
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or (_measure(rest) == 1 and not _short_end(rest)):
            word = rest
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(T.StringType())
def stem_word(words: pd.Series) -> pd.Series:
    """Stems of single words, for a table of distinct ones."""
    return words.map(porter_stem, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem_terms(tokens: pd.Series) -> pd.Series:
    """Stem token arrays.  Each distinct word of an Arrow batch is stemmed once, so no
    vocabulary join (with its hot words) is needed."""
    known: dict[str, str] = {}

    def stems(row):
        if row is None:
            return None
        out = []
        for word in row:
            if word not in known:
                known[word] = porter_stem(word)
            out.append(known[word])
        return out

    return tokens.map(stems)
