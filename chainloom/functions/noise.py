"""Noise for test questions: small changes outside of protected spans."""

from __future__ import annotations

import random
import re

# Phrases and their short forms.
SHORT_FORMS = (
    ("transactions", "txns"), ("transaction", "txn"), ("account", "acct"), ("address", "addr"), ("average", "avg"), ("maximum", "max"), ("minimum", "min"),
    ("number", "no."), ("giao dịch", "gd"), ("tài khoản", "tk"), ("địa chỉ", "đc"), ("số lượng", "sl"),
)


def free_spans(text: str, protected: list[str]) -> list[tuple[int, int]]:
    """Words that touch no protected span and hold no digit."""
    taken = [m.span() for p in protected if p for m in re.finditer(re.escape(p), text)]
    words = [m.span() for m in re.finditer(r"[^\W\d_]{4,}", text)]
    return [(a, b) for a, b in words if all(b <= s or a >= e for s, e in taken)]


def change(text: str, kind: str, chance: random.Random, protected: list[str]) -> str:
    spans = free_spans(text, protected)
    if kind == "mixed_case":
        pick = chance.choice(spans) if spans else None
        return text if pick is None else text[: pick[0]] + text[pick[0] : pick[1]].swapcase() + text[pick[1] :]
    if kind == "abbreviation":
        for long, short in SHORT_FORMS:
            m = re.search(rf"\b{re.escape(long)}\b", text, re.I)
            if m and all(m.end() <= text.find(p) or m.start() >= text.find(p) + len(p) for p in protected if p and p in text):
                return text[: m.start()] + short + text[m.end() :]
        return text
    if kind == "fragment":
        first = re.match(r"\W*\w+\s+", text)
        kept = text[first.end() :] if first else text
        return kept if all(p in kept for p in protected if p) and kept else text
    if kind == "typo" and spans:
        a, b = chance.choice(spans)
        i = chance.randrange(a, b - 1)
        way = chance.randrange(3)
        if way == 0:
            return text[:i] + text[i + 1] + text[i] + text[i + 2 :]
        return text[:i] + text[i + 1 :] if way == 1 else text[:i] + text[i] + text[i:]
    return text
