"""Small builders of SQL text for the checking statements."""

from __future__ import annotations


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_like(text: str, words) -> str:
    return "(" + " or ".join(f"contains({text}, {quote(w)})" for w in words) + ")"


def found_list(text: str, words, prefix: str = "") -> str:
    items = ", ".join(f"case when contains({text}, {quote(w)}) then {quote(prefix + w)} end" for w in words)
    return f"list_filter([{items}], lambda x: x is not null)"


def chain(text: str, steps) -> str:
    for pattern, value in steps:
        text = f"regexp_replace({text}, {quote(pattern)}, {quote(value)}, 'g')"
    return text


def bonus_sum(text: str, bonus: dict[str, float]) -> str:
    return " + ".join(f"case when contains({text}, {quote(w)}) then cast({b} as double) else cast(0.0 as double) end"
                      for w, b in bonus.items())


def ts_text(text: str) -> str:
    """Millisecond text of an ISO time with ``T`` or blank, comma or dot, with or without fraction."""
    clean = f"replace(replace(replace({text}, 'T', ' '), 'Z', ''), ',', '.')"
    return f"(case when length({clean}) = 19 then concat({clean}, '.000') when {clean} = '' then null else {clean} end)"
