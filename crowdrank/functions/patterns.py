"""Regular-expression building blocks shared by Spark (Java regex) and the
DuckDB oracle (RE2).

Python's ``\\s`` on text is Unicode-aware and also matches U+001C–U+001F;
Java's ``\\s`` is ASCII unless ``(?U)`` and then differs from Python on those
four; RE2's ``\\s`` is ASCII.  So whitespace is spelled out as one explicit
class (the characters for which ``str.isspace()`` is true), written with
``\\x{...}`` escapes that both Java and RE2 accept.
"""

from __future__ import annotations


def _python_whitespace_class_body() -> str:
    """Character-class body of every code point with ``str.isspace()``,
    collapsed into ranges (computed, not hand-written)."""
    points = [c for c in range(0x110000) if chr(c).isspace()]
    ranges: list[tuple[int, int]] = []
    for c in points:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1] = (ranges[-1][0], c)
        else:
            ranges.append((c, c))

    def esc(c: int) -> str:
        return f"\\x{{{c:x}}}"

    return "".join(esc(a) if a == b else f"{esc(a)}-{esc(b)}" for a, b in ranges)


WS = _python_whitespace_class_body()          # body, to use inside [...]
WS_RUN = f"[{WS}]+"                           # one or more whitespace
NON_WS_RUN = f"[^{WS}]+"                      # one or more non-whitespace


def _java_whitespace_class_body() -> str:
    """The same class for Java alone, written so that other characters leave it
    early: a bitmap below U+0100, and one range around all that lie above."""
    points = [c for c in range(0x110000) if chr(c).isspace()]
    low, high = ([f"\\x{{{c:x}}}" for c in points if (c < 256) == below] for below in (True, False))
    return "".join(low) + f"[{high[0]}-{high[-1]}&&[{''.join(high)}]]"


_JAVA_WS = _java_whitespace_class_body()
#: Java only: the runs of whitespace that are not one plain space.
WS_CHANGED = f" [{_JAVA_WS}]+|[{_JAVA_WS}&&[^ ]][{_JAVA_WS}]*+"


def quote_literal(word: str) -> str:
    """Quote a literal for Java regex and RE2 alike (both know \\Q...\\E)."""
    if "\\E" in word:
        return "".join(f"\\x{{{ord(ch):x}}}" for ch in word)
    return f"\\Q{word}\\E"
