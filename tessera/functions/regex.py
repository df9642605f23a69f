"""Extended regular expressions, with POSIX classes, for Spark's regular expression functions."""

from __future__ import annotations

#: POSIX classes and what stands for them inside brackets.
CLASSES = {
    "alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "blank": r" \t", "cntrl": r"\p{Cntrl}", "digit": "0-9",
    "graph": r"\p{Graph}", "lower": r"\p{Lower}", "print": r"\p{Print}", "punct": r"\p{Punct}", "space": r"\s\x0B",
    "upper": r"\p{Upper}", "xdigit": "0-9A-Fa-f",
}
#: Escapes that keep or get a meaning; any other escaped character is itself.
ESCAPES = {
    "n": r"\n", "t": r"\t", "r": r"\r", "f": r"\f", "v": r"\x0B", "a": r"\x07", "b": r"\x08", "y": r"\b", "B": r"\B",
    "<": r"\b(?=\w)", ">": r"\b(?<=\w)", "s": r"[\s\x0B]", "S": r"[^\s\x0B]", "w": r"\w", "W": r"\W", "`": r"\A", "'": r"\z",
}
_SPECIAL = r"\.[]{}()*+?^$|"


def java(pattern: str, ignore_case: bool = False) -> str:
    """The pattern as Spark needs it. A dot matches a newline, and digits after a backslash are literal.

    A sign of repetition with nothing before it, at the start or after ``(``, ``|`` or ``^``, is literal.
    """
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            e = pattern[i + 1]
            out.append(ESCAPES.get(e) or ("\\" + e if e in _SPECIAL or not e.isalnum() else e))
            i += 2
        elif c == "[":
            part, i = _bracket(pattern, i)
            out.append(part)
        else:
            out.append("\\" + c if c in "*+?{" and (not out or out[-1] in ("(", "|", "^")) else c)
            i += 1
    return ("(?si)" if ignore_case else "(?s)") + "".join(out)


def _bracket(pattern: str, i: int) -> tuple[str, int]:
    """A bracket expression that begins at ``i``, and where it ends."""
    out, i = ["["], i + 1
    if pattern[i : i + 1] == "^":
        out.append("^")
        i += 1
    first = True
    while i < len(pattern) and (first or pattern[i] != "]"):
        first = False
        end = pattern.find(":]", i + 2) if pattern.startswith("[:", i) else -1
        if end > 0 and pattern[i + 2 : end] in CLASSES:
            out.append(CLASSES[pattern[i + 2 : end]])
            i = end + 2
        elif pattern[i] == "\\" and i + 1 < len(pattern):
            e = pattern[i + 1]
            out.append({"n": r"\n", "t": r"\t", "r": r"\r", "f": r"\f"}.get(e, e if e.isalnum() else "\\" + e))
            i += 2
        else:
            out.append("\\" + pattern[i] if pattern[i] in "[]&^~\\" else pattern[i])
            i += 1
    if i >= len(pattern):
        raise ValueError(f"unmatched [ in {pattern!r}")
    return "".join(out) + "]", i + 1


def ungrouped(pattern: str) -> str:
    """A pattern that ``java`` returned, with groups that don't capture. Brackets and escapes stay."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        inside = c == "[" or (inside and c != "]")
        out.append("(?:" if c == "(" and not inside and pattern[i + 1 : i + 2] != "?" else c)
        i += 1
    return "".join(out)


def is_literal(pattern: str) -> bool:
    """Whether a pattern has no special character, so that ``contains`` and ``replace`` can stand for it."""
    return not any(c in _SPECIAL for c in pattern)
