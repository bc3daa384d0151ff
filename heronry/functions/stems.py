"""Word stems by suffix stripping (Porter's rules of 1980) and English stop words, as SQL expressions.

A word is stemmed in steps, each one CASE over its endings: the longest ending that fits decides, and is replaced if what stands
before it meets the step's condition. The expressions are plain SQL that Spark compiles; `steps` gives the same text for
another engine, whose name for a regular expression's test is its argument. Words of fewer than three letters, and words with
anything but a-z, are their own stems.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A y counts as a consonant at the start of a word and after a vowel: `first` writes the former as Y.
_HEAD, _TAIL = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_ONE_MORE = f"^({_HEAD})?{_TAIL}{_HEAD}"
_TWO_MORE = f"^({_HEAD})?{_TAIL}{_HEAD}{_TAIL}{_HEAD}"
_JUST_ONE = f"^({_HEAD})?{_TAIL}{_HEAD}({_TAIL})?$"
_VOWEL = f"^({_HEAD})?[aeiouy]"
_SHORT = f"^{_HEAD}[aeiouy][^aeiouwxy]$"

# The rules' endings and what takes their place.
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive",
    "biliti": "ble",
}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
# English words that carry no topic.
STOP_WORDS = tuple("""
a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing don down during
each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor
not now of off on once only or other our ours ourselves out over own s same she should so some such t than that the their theirs them themselves then there
these they this those through to too under until up very was we were what when where which while who whom why will with you your yours yourself yourselves
""".split())


def _cut(n: int) -> str:
    return f"left(w, length(w) - {n})"


def _ends(rules: dict[str, str], condition: str, test: str) -> str:
    """A CASE of the endings, the longest first."""
    when = ""
    for ending in sorted(rules, key=lambda e: (-len(e), e)):
        before = f"{test}({_cut(len(ending))}, '{condition}')"
        if ending == "ion":
            before += f" AND right({_cut(3)}, 1) IN ('s', 't')"
        when += f" WHEN w LIKE '%{ending}' THEN CASE WHEN {before} THEN {_cut(len(ending))} || '{rules[ending]}' ELSE w END"
    return f"CASE{when} ELSE w END"


def steps(test: str = "regexp_like") -> list[str]:
    """Expressions of a column w, each of the one before; w is a word of three or more letters a-z, the last gives its stem."""
    cut = f"""CASE WHEN w LIKE '%eed' THEN CASE WHEN {test}({_cut(3)}, '{_ONE_MORE}') THEN {_cut(1)} ELSE w END
      WHEN w LIKE '%ed' AND {test}({_cut(2)}, '{_VOWEL}') THEN {_cut(2)} || '-'
      WHEN w LIKE '%ing' AND {test}({_cut(3)}, '{_VOWEL}') THEN {_cut(3)} || '-' ELSE w END"""
    doubled = ", ".join(f"'{c}{c}'" for c in "bcdfghjkmnpqrtvwxy")
    # A word that lost its ending carries a mark through one step.
    mended = f"""CASE WHEN w NOT LIKE '%-' THEN w WHEN w LIKE '%at-' OR w LIKE '%bl-' OR w LIKE '%iz-' THEN {_cut(1)} || 'e'
      WHEN right({_cut(1)}, 2) IN ({doubled}) THEN {_cut(2)}
      WHEN {test}({_cut(1)}, '{_SHORT}') THEN {_cut(1)} || 'e' ELSE {_cut(1)} END"""
    last = f"CASE WHEN w LIKE '%e' AND ({test}({_cut(1)}, '{_TWO_MORE}') OR {test}({_cut(1)}, '{_JUST_ONE}') AND NOT {test}({_cut(1)}, '{_SHORT}')) THEN {_cut(1)} ELSE w END"
    return [
        "CASE WHEN w LIKE 'y%' THEN 'Y' || right(w, length(w) - 1) ELSE w END",
        f"CASE WHEN w LIKE '%sses' OR w LIKE '%ies' THEN {_cut(2)} WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN {_cut(1)} ELSE w END",
        cut,
        mended,
        f"CASE WHEN w LIKE '%y' AND {test}({_cut(1)}, '{_VOWEL}') THEN {_cut(1)} || 'i' ELSE w END",
        _ends(SECOND, _ONE_MORE, test),
        _ends(THIRD, _ONE_MORE, test),
        _ends(dict.fromkeys(FOURTH, ""), _TWO_MORE, test),
        last,
        f"CASE WHEN w LIKE '%ll' AND {test}(w, '{_TWO_MORE}') THEN {_cut(1)} ELSE w END",
        "lower(w)",
    ]


def stemmed(words: DataFrame, column: str) -> DataFrame:
    """words with the stems in place of the column's words; no row moves.

    A step names its word many times, so each is a function of one variable around the one before: as columns of
    their own, conditions that move below them would write them out in each other, 60 times over at each step.
    """
    stem = f"`{column}`"
    for step in steps():
        stem = f"get(transform(array({stem}), w -> {step}), 0)"
    stem = F.when(F.col(f"`{column}`").rlike("^[a-z]{3,}$"), F.expr(stem)).otherwise(F.col(f"`{column}`"))
    out = words.select(*(f"`{c}`" for c in words.columns if c != column), F.explode(F.array(stem)).alias(column))
    return out.select(*(f"`{c}`" for c in words.columns))


def steps_sql(source: str, test: str = "regexp_matches") -> str:
    """A query of all columns of source, which has w and is_word, with the stems as w. Each step is a table of its own, as an
    engine that puts one step into the next would write each out many times over."""
    tables = [f"w0 AS MATERIALIZED (SELECT * FROM {source})"]
    for n, step in enumerate(steps(test), 1):
        tables.append(f"w{n} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN is_word THEN {step} ELSE w END AS w) FROM w{n - 1})")
    return f"(WITH {', '.join(tables)} SELECT * FROM w{len(tables) - 1})"
