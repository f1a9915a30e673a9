"""The Porter stemmer as SQL over a column of distinct words, for the side-by-side check.

Built from the same published suffix rules as ``functions.text.porter_stem``; the letters of a word
become ``A`` (vowel) and ``c`` (consonant), and everything else is pattern matching on these.
"""

from __future__ import annotations

from vouchspark.functions.text import STEP2, STEP3, STEP4


def _shape(e: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace({e}, '(^|[aeiou])y', '\1Y', 'g'), '[aeiouy]', 'A', 'g'), '[^A]', 'c', 'g')"


def _measure(e: str) -> str:
    return f"len(regexp_extract_all({_shape(e)}, 'Ac'))"


def _short(e: str) -> str:
    return f"(regexp_matches({_shape(e)}, 'cAc$') AND NOT regexp_matches({e}, '[wxy]$'))"


def _without(e: str, n: int) -> str:
    return f"left({e}, length({e}) - {n})"


def _suffixes(e: str, rules) -> str:
    whens = [f"WHEN ends_with({e}, '{s}') THEN CASE WHEN {_measure(_without(e, len(s)))} > 0 THEN {_without(e, len(s))} || '{to}' ELSE {e} END" for s, to in rules]
    return f"CASE {' '.join(whens)} ELSE {e} END"


def _dropped(e: str) -> str:
    whens = []
    for s in STEP4:
        rest = _without(e, len(s))
        also = f" AND regexp_matches({rest}, '[st]$')" if s == "ion" else ""
        whens.append(f"WHEN ends_with({e}, '{s}') THEN CASE WHEN {_measure(rest)} > 1{also} THEN {rest} ELSE {e} END")
    return f"CASE {' '.join(whens)} ELSE {e} END"


def stems(words: str) -> str:
    """(word, term) of a statement with a column ``word``."""
    steps = [
        f"CASE WHEN regexp_matches(s, '(sses|ies)$') THEN {_without('s', 2)} WHEN regexp_matches(s, '[^s]s$') THEN {_without('s', 1)} ELSE s END",
        f"""CASE WHEN ends_with(s, 'eed') THEN CASE WHEN {_measure(_without('s', 3))} > 0 THEN {_without('s', 1)} ELSE s END
            WHEN ends_with(s, 'ed') AND contains({_shape(_without('s', 2))}, 'A') THEN {_without('s', 2)} || '+'
            WHEN ends_with(s, 'ing') AND contains({_shape(_without('s', 3))}, 'A') THEN {_without('s', 3)} || '+' ELSE s END""",
        # A '+' marks words that lost their ending just now.
        f"""CASE WHEN NOT ends_with(s, '+') THEN s WHEN regexp_matches(s, '(at|bl|iz)[+]$') THEN {_without('s', 1)} || 'e'
            WHEN length(s) > 2 AND left(right(s, 2), 1) = left(right(s, 3), 1) AND ends_with({_shape(_without('s', 1))}, 'c') AND NOT regexp_matches(s, '[lsz][+]$') THEN {_without('s', 2)}
            WHEN {_measure(_without('s', 1))} = 1 AND {_short(_without('s', 1))} THEN {_without('s', 1)} || 'e' ELSE {_without('s', 1)} END""",
        f"CASE WHEN ends_with(s, 'y') AND contains({_shape(_without('s', 1))}, 'A') THEN {_without('s', 1)} || 'i' ELSE s END",
        _suffixes("s", STEP2),
        _suffixes("s", STEP3),
        _dropped("s"),
        f"""CASE WHEN ends_with(s, 'e') AND ({_measure(_without('s', 1))} > 1 OR ({_measure(_without('s', 1))} = 1 AND NOT {_short(_without('s', 1))}))
            THEN {_without('s', 1)} ELSE s END""",
        f"CASE WHEN ends_with(s, 'll') AND {_measure('s')} > 1 THEN {_without('s', 1)} ELSE s END",
    ]
    table = f"SELECT DISTINCT word, word AS s FROM ({words}) WHERE regexp_full_match(word, '[a-z]{{3,}}')"
    for step in steps:
        table = f"SELECT word, {step} AS s FROM ({table})"
    return f"SELECT word, s AS term FROM ({table}) UNION ALL SELECT DISTINCT word, word FROM ({words}) WHERE NOT regexp_full_match(word, '[a-z]{{3,}}')"
