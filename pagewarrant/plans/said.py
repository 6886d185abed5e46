"""SQL twins of the rules on what stands around an occurrence (``functions.context``)."""

from __future__ import annotations

from ..functions import context as C

_CUT = "'(?i)[.!?;]|\\b(?:but|however|yet|except)\\b'"
_ASIDE = "'(?i)^\\s*,\\s*(?:however|though|nevertheless)\\s*,\\s*', ' '"
_FREED = f"'\\b(not) ({'|'.join([*C.RESTRICTIONS, 'just'])})\\b', ' '"
_IDIOM = f"'{C.IDIOM.replace(chr(39), chr(39) * 2)}', ' '"
_TO = f"'\\bto ({'|'.join(C.AFTER_TO)})\\b', ' ', 'g'"


def _words(text: str) -> str:
    return f"regexp_extract_all(lower(replace({text}, '’', '''')), '[a-z0-9]+(?:''[a-z]+)?')"


def _has(words: str, terms: list[str]) -> str:
    return f"list_has_any({words}, [" + ", ".join(f"'{w}'" for w in terms) + "])"


def _sides(text: str, phrase: str) -> tuple[str, str]:
    """What stands before and after the k-th occurrence of a phrase."""
    at = f"(list_sum(list_transform(string_split({text}, {phrase})[1:k], lambda x: length(x))) + (k - 1) * length({phrase}))::BIGINT"
    return f"left({text}, {at})", f"substring({text}, {at} + length({phrase}) + 1)"


def stands_sql(text: str, phrase: str) -> str:
    """Whether the k-th occurrence stands between characters that are no letters or digits."""
    before, after = _sides(text, phrase)
    return f"NOT regexp_matches({before}, '[\\pL\\pN]$') AND NOT regexp_matches({after}, '^[\\pL\\pN]')"


def _undenied(before: str, after: str, invites: bool = False) -> str:
    masked = (lambda x: f"regexp_replace({x}, {_IDIOM}, 'g')") if invites else (lambda x: x)

    def denies(part: str, terms: list[str]) -> str:
        freed = f"regexp_replace(lower({masked(part)}), {_FREED}, 'g')"
        return f"{_has(_words(freed), terms)} OR regexp_matches(lower(replace({masked(part)}, '’', '''')), '[a-z0-9]n''t\\b')"

    ahead = f"string_split_regex({masked(before)}, {_CUT})[-1]"
    behind = f"string_split_regex(regexp_replace({after}, {_ASIDE}), {_CUT})[1]"
    return f"NOT ({denies(ahead, C.NEGATIONS)}) AND NOT ({denies(behind, C.NEGATIONS_AFTER)})"


def _some(text: str, phrase: str, test: str) -> str:
    return f"len(list_filter(range(1, len(string_split({text}, {phrase}))), lambda k: {test})) > 0"


def said_sql(text: str, phrase: str, strict: bool = False) -> str:
    """Whether an occurrence of a phrase in a text is not denied (``strict``: and its sentence says no more)."""
    before, after = _sides(text, phrase)
    test = f"{stands_sql(text, phrase)} AND {_undenied(before, after)}"
    if strict:
        b, a = _words(f"regexp_extract({before}, '[^.!?]*$')"), _words(f"regexp_extract({after}, '^[^.!?]*')")
        lead = f"array_to_string({b}, ' ')"
        leads = ", ".join(f"'{x}'" for x in ["", *C.PREFIXES])
        test += f" AND CASE WHEN {lead} = 'not only' THEN coalesce({a}[1], '') = 'but' ELSE len({a}) = 0 AND {lead} IN ({leads}) END AND NOT regexp_matches({after}, '^[^.!?]*\\?')"
    return _some(text, phrase, test)


def told_sql(text: str, raw: str) -> str:
    """Whether a text holds an address or number at a place that neither denies nor qualifies it."""
    before, after = _sides(text, raw)
    test = f"{_undenied(before, after, True)} AND NOT regexp_matches({after}, '^[^.!?]*\\?') AND NOT regexp_matches({before}, '[0-9]$') AND NOT regexp_matches({after}, '^[0-9]')"
    for part in (f"regexp_extract({before}, '[^.!?]*$')", f"regexp_extract({after}, '^[^.!?]*')"):
        freed = f"regexp_replace(lower({part}), {_FREED}, 'g')"
        narrows = f"{_has(_words(part), C.QUALIFIERS)} OR regexp_matches(lower({part}), '\\bas part\\b') OR list_contains({_words(f'regexp_replace(lower({part}), {_TO})')}, 'to')"
        test += f" AND NOT ({_has(_words(part), C.CONDITIONALS)}) AND NOT ({_has(_words(freed), C.RESTRICTIONS)}) AND NOT ({narrows})"
    return _some(text, raw, test)
