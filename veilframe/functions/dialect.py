"""Regular-expression dialects.

The detectors are specified with ASCII digits and word boundaries but Unicode whitespace. Java 17 counts
Hangul as word characters for ``\\b``, keeps ``\\s`` ASCII and lets ``$`` match before a final newline, so the
patterns are rewritten for Spark; the RE2 form is what the SQL checks use.
"""

from __future__ import annotations

# Whitespace and line terminators as the patterns mean them (also what trimming removes).
SPACE_CHARS = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
_WORD = "[A-Za-z0-9_]"
ASCII_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def _rewrite(pattern: str, spaces: str, boundary: str, end: str, digit: str) -> str:
    out, in_class, i = [], False, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            pair = pattern[i : i + 2]
            if pair == r"\s":
                out.append(spaces if in_class else f"[{spaces}]")
            elif pair == r"\b" and not in_class:
                out.append(boundary)
            elif pair == r"\d":
                out.append(digit if in_class else f"[{digit}]")
            else:
                out.append(pair)
            i += 2
            continue
        if ch == "[":
            in_class = True
        elif ch == "]":
            in_class = False
        out.append(end if ch == "$" and not in_class else ch)
        i += 1
    return "".join(out)


def to_java(pattern: str) -> str:
    return _rewrite(pattern, SPACE_CHARS, ASCII_BOUNDARY, r"\z", "0-9")


def to_re2(pattern: str) -> str:
    """RE2 already has ASCII ``\\b``; it has no lookaround, so patterns that use it cannot be converted."""
    spaces = SPACE_CHARS.replace(r"\x0B", r"\v")
    for code in ("00A0", "1680", "2000", "200A", "2028", "2029", "202F", "205F", "3000", "FEFF"):
        spaces = spaces.replace(rf"\u{code}", rf"\x{{{code}}}")
    return _rewrite(pattern, spaces, r"\b", r"\z", "0-9")
