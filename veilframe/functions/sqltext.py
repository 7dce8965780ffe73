"""Small pieces of Spark SQL text.

Detection and masking are long nested expressions; written as SQL they are parsed in one call, where building
them from column functions takes thousands. A "text" argument below is SQL too: a column name, or a variable
of an enclosing lambda.
"""

from __future__ import annotations

# Running values are built block by block, so that appending to the result copies it once per block and not
# once per element.
BLOCK = 256


def literal(value: str) -> str:
    """A raw string literal: backslashes stay as they are."""
    for quote in ("'", '"'):
        if quote not in value:
            return f"r{quote}{value}{quote}"
    raise ValueError("a pattern may hold single or double quotes, not both")


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``value`` computed once under ``name``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _running(values: str, step: str) -> str:
    """``step`` combines _last and _v."""
    block = (
        f"aggregate(slice(_vs, _first, {BLOCK}), array(_acc.last), "
        f"(_seen, _v) -> {let('_last', 'element_at(_seen, -1)', f'concat(_seen, array({step}))')})"
    )
    after = let(
        "_s",
        block,
        f"named_struct('last', element_at(_s, -1), 'out', concat(_acc.out, slice(_s, 2, {BLOCK})))",
    )
    zero = "named_struct('last', 0, 'out', cast(array() AS array<int>))"
    body = (
        f"aggregate(sequence(1, greatest(size(_vs), 1), {BLOCK}), {zero}, "
        f"(_acc, _first) -> {after}, _acc -> _acc.out)"
    )
    return let("_vs", values, body)


def running_sum(values: str) -> str:
    """array<int> of running totals."""
    return _running(values, "_last + _v")


def running_max(values: str) -> str:
    """array<int> of running maxima of non-negative numbers."""
    return _running(values, "greatest(_last, _v)")
