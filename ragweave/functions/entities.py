"""Checks and searches for personal data in one text: check digits, and spans in time linear in the text."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Characters of the part of an address before its ``@``.
LOCAL = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)])) + "._%+-"
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    """Whether the check digit of ``digits`` holds."""
    back = [ord(c) - 48 for c in reversed(digits)]
    return (sum(back[::2]) + sum(_DOUBLED[d] for d in back[1::2])) % 10 == 0


def mod97(number: str) -> int:
    """Remainder of an account number, its first four characters moved to the end and letters as 10 to 35."""
    return int("".join(str(int(c, 36)) for c in number[4:] + number[:4])) % 97


def social_security(x: str) -> bool:
    """Whether the area, group and serial of ``ddd-dd-dddd`` are given out."""
    return not (x[:3] in ("000", "666") or x[0] == "9" or x[4:6] == "00" or x[7:] == "0000")


def octets(x: str) -> bool:
    """Whether the dotted numbers are 255 at most, however many digits they have."""
    return all(len(p) < 4 and int(p or "0") < 256 for p in (p.lstrip("0") for p in x.split(".")))


def mail_spans(text: str, domain: re.Pattern) -> Iterator[tuple[int, int]]:
    """Spans of addresses, each found from its ``@``; ``domain`` matches from there to the end."""
    bound = 0
    for found in domain.finditer(text):
        at = found.start()
        head = text[bound:at]
        size = len(head) - len(head.rstrip(LOCAL))
        if size:
            yield at - size, found.end()
            bound = found.end()
        else:
            bound = at + 1
