"""ECMAScript-style patterns to Java patterns.

Three things differ between the dialects and would change results: ``\\b`` (Java counts non-ASCII
letters as word characters on some JDKs), ``\\s`` (Java knows only the ASCII blanks) and ``.``.
"""

from __future__ import annotations

ASCII_BOUNDARY = (
    "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
)
BLANKS = r"\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
ANY_BUT_NEWLINE = r"[^\n\r\x{2028}\x{2029}]"


def expand(pattern: str, boundary: str = ASCII_BOUNDARY) -> str:
    """Spell out ``\\b``, ``\\s`` and ``.`` so that the pattern means the same everywhere."""
    out: list[str] = []
    in_class = False
    chars = iter(pattern)
    for c in chars:
        if c == "\\":
            c += next(chars)
            if c == r"\s":
                c = BLANKS if in_class else f"[{BLANKS}]"
            elif c == r"\b" and not in_class:
                c = boundary
        elif c == "[" and not in_class:
            in_class = True
        elif c == "]" and in_class:
            in_class = False
        elif c == "." and not in_class:
            c = ANY_BUT_NEWLINE
        out.append(c)
    return "".join(out)
