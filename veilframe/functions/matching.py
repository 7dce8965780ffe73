"""Find-all with offsets, and masking, as SQL over one line of text.

Offsets count characters (code points) from 0, end exclusive, so ``substring(text, start + 1, end - start)``
is the matched text.
"""

from __future__ import annotations

from .sqltext import let, literal, running_max, running_sum

MASK = "█"
_ASTRAL = r"[\x{10000}-\x{10FFFF}]"
_IS_WIDE = literal(_ASTRAL)
_ONE = literal(f"({_ASTRAL})")
_TWO = literal(f"({_ASTRAL})\\1")


def search(text: str, pattern: str, group: int = 0, utf16: bool = False, **tags: str) -> str:
    """A struct with all matches of the pattern and the pieces between them, null when there are none.

    A group other than 0 must be the one a match ends with. With ``utf16`` the pattern's repeat limits count
    UTF-16 units: characters above U+FFFF, which are two units, are doubled before matching. ``tags`` are
    carried along.
    """
    p = literal(pattern)
    part = "_w" if group == 0 else f"regexp_extract_all(_t, {p}, {group})"
    wide = f"rlike(_t, {_IS_WIDE})" if utf16 else "false"
    # Splitting compiles a pattern anew for each text, replacing does not; splitting at a single character needs none.
    pieces = f"if(contains(_t, '\\n'), split(_t, {p}, -1), split(regexp_replace(_t, {p}, '\\n'), '\\n', -1))"
    fields = {**tags, "source": "_t", "wide": wide, "whole": "_w", "part": part, "pieces": pieces}
    found = "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"
    hit = let("_w", f"regexp_extract_all(_t, {p}, 0)", f"if(size(_w) = 0, null, {found})")
    source = f"if(rlike({text}, {_IS_WIDE}), regexp_replace({text}, {_ONE}, '$1$1'), {text})" if utf16 else text
    return let("_t", source, hit)


def spans(hit: str, *tags: str) -> str:
    """array<struct<tags, start, end, matched>> of a ``search`` result.

    A match ends at the summed lengths of the pieces and matches up to it.
    """

    def narrow(value: str) -> str:
        return f"if({hit}.wide, regexp_replace({value}, {_TWO}, '$1'), {value})"

    def offset(value: str) -> str:
        before = f"regexp_replace(substr({hit}.source, 1, {value}), {_TWO}, '$1')"
        return f"if({hit}.wide, length({before}), {value})"

    lengths = f"transform({hit}.whole, (_m, _i) -> length(_m) + length({hit}.pieces[_i]))"
    carried = "".join(f"'{t}', {hit}.{t}, " for t in tags)
    one = (
        f"named_struct({carried}'start', {offset('_ends[_i] - length(_m)')}, "
        f"'end', {offset('_ends[_i]')}, 'matched', {narrow('_m')})"
    )
    ends = f"if(size({hit}.whole) = 1, {lengths}, {running_sum(lengths)})"
    return let("_ends", ends, f"transform({hit}.part, (_m, _i) -> {one})")


def mask_spans(text: str, covered: str) -> str:
    """``text`` with what the spans (array of structs with start and end, any order, may overlap) cover masked.

    Length preserving. With spans sorted by start, each contributes the clear text since the furthest end so
    far, and a mask for what it covers beyond it.
    """
    clipped = (
        f"transform({covered}, _c -> named_struct('start', greatest(_c.start, 0), "
        f"'end', least(_c.end, length({text}))))"
    )
    ordered = f"array_sort(filter({clipped}, _c -> _c.start < _c.end))"
    piece = (
        f"concat(substr({text}, _from + 1, greatest(_c.start - _from, 0)), "
        f"repeat('{MASK}', greatest(_c.end - greatest(_c.start, _from), 0)))"
    )
    pieces = f"transform(_o, (_c, _i) -> {let('_from', 'if(_i = 0, 0, _reach[_i - 1])', piece)})"
    rebuilt = let(
        "_reach",
        running_max("transform(_o, _c -> _c.end)"),
        f"concat(array_join({pieces}, ''), substr({text}, element_at(_reach, -1) + 1))",
    )
    return let("_o", ordered, f"if(size(_o) = 0, {text}, {rebuilt})")
