"""Digit checksums as SQL over a string of digits."""

from __future__ import annotations

from ..fixed_values import BUSINESS_NO_WEIGHTS, RRN_WEIGHTS


def digits_of(text: str) -> str:
    return f"regexp_replace({text}, '[^0-9]', '')"


def _digit(digits: str, position: int) -> str:
    return f"int(substr({digits}, {position}, 1))"


def _weighted(digits: str, weights: tuple[int, ...]) -> str:
    return " + ".join(f"{_digit(digits, i + 1)} * {w}" for i, w in enumerate(weights))


def rrn_checksum(digits: str) -> str:
    check = f"(11 - ({_weighted(digits, RRN_WEIGHTS)}) % 11) % 10"
    return f"if(length({digits}) = 13, {check} = {_digit(digits, 13)}, false)"


def business_no_checksum(digits: str) -> str:
    total = f"({_weighted(digits, BUSINESS_NO_WEIGHTS)} + {_digit(digits, 9)} * 5 div 10)"
    return f"if(length({digits}) = 10, (10 - {total} % 10) % 10 = {_digit(digits, 10)}, false)"


def luhn(digits: str) -> str:
    """Any length. The doubled digit 2d, less 9 when above 9, is 2d - 9 for d > 4."""
    return (
        f"aggregate(sequence(1, greatest(length({digits}), 1)), 0, (_sum, _i) -> _sum + "
        f"transform(array(coalesce(int(nullif(substr({digits}, -_i, 1), '')), 0)), "
        "_d -> if(_i % 2 = 1, _d, 2 * _d - if(_d > 4, 9, 0)))[0]) % 10 = 0"
    )
