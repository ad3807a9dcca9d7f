"""The base rules for personal data: one linear pass per kind, leftmost matches that do not overlap."""

from __future__ import annotations

import re

# The kinds in their order, and the patterns they are defined by.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT_OR_AT = re.compile(r"[0-9@]")


def may_hold_any(text: str) -> bool:
    """Every kind needs a digit or an at sign."""
    return _DIGIT_OR_AT.search(text) is not None


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(map(int, reversed(digits))):
        total += digit if place % 2 == 0 else digit * 2 - 9 * (digit > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int, bool]]:
    found, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            found.append((start, end, True))
        # What lies before this sign cannot begin a later match.
        end = max(end, at + 1)
        at = text.find("@", end)
    return found


def _addresses(text: str) -> list[tuple[int, int, bool]]:
    found = []
    for run in _DOTTED.finditer(text):
        parts, place = run[0].split("."), run.start()
        starts = []
        for part in parts:
            starts.append(place)
            place += len(part) + 1
        n = 0
        while n + 3 < len(parts):
            four = parts[n : n + 4]
            if all(four):
                small = all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in four)
                found.append((starts[n], starts[n + 3] + len(four[3]), small))
                n += 4
            else:
                n += 1
    return found


def _cards(text: str) -> list[tuple[int, int, bool]]:
    found = []
    for match in _CARD.finditer(text):
        digits = match[0].replace(" ", "").replace("-", "")
        found.append((match.start(), match.end(), 14 <= len(digits) <= 19 and luhn(digits)))
    return found


def _phones(text: str) -> list[tuple[int, int, bool]]:
    return [(m.start(), m.end(), 10 <= sum(map(str.isdigit, m[0])) <= 15) for m in _PHONE.finditer(text)]


def candidates(text: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, kind, whether it passes) of all matches, in code points."""
    if not may_hold_any(text):
        return []
    found = []
    for kind, rule in zip(KINDS, (_emails, _addresses, _cards, _phones)):
        found += [(start, end, kind, fine) for start, end, fine in rule(text)]
    return sorted(found, key=lambda span: (span[0], KINDS.index(span[2])))


def written(spans: list[tuple[int, int, str]]) -> str:
    """``kind:start:end`` by start, then kind, joined by commas."""
    ordered = sorted(spans, key=lambda span: (span[0], KINDS.index(span[2]), span[1]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in ordered)
