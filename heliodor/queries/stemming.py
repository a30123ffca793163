"""Porter's stems in SQL: each step as a column over distinct words, for the oracles of queries that stem."""

from __future__ import annotations

from heliodor.functions import text


def _kinds(word: str) -> str:
    """The word as c for consonants and v for vowels."""
    return f"list_reduce(list_prepend('', string_split({word}, '')), lambda a, x: a || CASE WHEN x IN ('a', 'e', 'i', 'o', 'u') OR (x = 'y' AND right(a, 1) = 'c') THEN 'v' ELSE 'c' END)"


def _measure(word: str) -> str:
    return f"len(regexp_extract_all({_kinds(word)}, 'v+c+'))"


def _cvc(word: str) -> str:
    return f"(length({word}) > 2 AND right({_kinds(word)}, 3) = 'cvc' AND right({word}, 1) NOT IN ('w', 'x', 'y'))"


def _stem(word: str, end: str) -> str:
    return f"left({word}, length({word}) - {len(end)})"


def _replaced(word: str, table: dict[str, str]) -> str:
    cases = " ".join(f"WHEN ends_with({word}, '{e}') THEN CASE WHEN {_measure(_stem(word, e))} > 0 THEN {_stem(word, e)} || '{to}' ELSE {word} END" for e, to in sorted(table.items(), key=lambda x: -len(x[0])))
    return f"CASE {cases} ELSE {word} END"


def stems_sql(words: str, least: int, most: int = 1_000_000) -> str:
    """Tables, the last of them stemmed (w, stem), over the distinct words w of a table; words of other lengths are their own stems."""
    dropped = " ".join(
        f"WHEN ends_with(w, '{e}') THEN CASE WHEN {_measure(_stem('w', e))} > 1{' AND ' + _stem('w', e) + chr(32) + 'SIMILAR TO ' + chr(39) + '.*[st]' + chr(39) if e == 'ion' else ''} THEN {_stem('w', e)} ELSE w END" for e in sorted(text._STEP4, key=lambda x: -len(x))
    )
    steps = [
        "CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN left(w, length(w) - 2) WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN left(w, length(w) - 1) ELSE w END",
        f"CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {_measure(_stem('w', 'eed'))} > 0 THEN left(w, length(w) - 1) ELSE w END WHEN ends_with(w, 'ed') AND contains({_kinds(_stem('w', 'ed'))}, 'v') THEN left(w, length(w) - 2) || '#' WHEN ends_with(w, 'ing') AND contains({_kinds(_stem('w', 'ing'))}, 'v') THEN left(w, length(w) - 3) || '#' ELSE w END",
        # a sign # says that ed or ing went
        f"""CASE WHEN NOT ends_with(w, '#') THEN w WHEN w SIMILAR TO '.*(at|bl|iz)#' THEN {_stem('w', '#')} || 'e'
          WHEN length(w) > 2 AND w[-2] = w[-3] AND right({_kinds(_stem('w', '#'))}, 1) = 'c' THEN CASE WHEN w[-2] IN ('l', 's', 'z') THEN {_stem('w', '#')} ELSE left(w, length(w) - 2) END
          WHEN {_measure(_stem('w', '#'))} = 1 AND {_cvc(_stem('w', '#'))} THEN {_stem('w', '#')} || 'e' ELSE {_stem('w', '#')} END""",
        f"CASE WHEN ends_with(w, 'y') AND contains({_kinds(_stem('w', 'y'))}, 'v') THEN {_stem('w', 'y')} || 'i' ELSE w END",
        _replaced("w", text._STEP2),
        _replaced("w", text._STEP3),
        f"CASE {dropped} ELSE w END",
        f"CASE WHEN ends_with(w, 'e') AND ({_measure(_stem('w', 'e'))} > 1 OR ({_measure(_stem('w', 'e'))} = 1 AND NOT {_cvc(_stem('w', 'e'))})) THEN {_stem('w', 'e')} ELSE w END",
        f"CASE WHEN ends_with(w, 'll') AND {_measure('w')} > 1 THEN left(w, length(w) - 1) ELSE w END",
    ]
    out = f"stem0 AS (SELECT w AS own, w FROM (SELECT DISTINCT w FROM {words}))"
    for k, step in enumerate(steps, 1):
        out += f",\nstem{k} AS (SELECT own, CASE WHEN length(own) BETWEEN {least} AND {most} THEN {step} ELSE w END AS w FROM stem{k - 1})"
    return out + f",\nstemmed AS (SELECT own AS w, w AS stem FROM stem{len(steps)})"
