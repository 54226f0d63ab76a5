"""Folding of typed text and the Damerau-Levenshtein distance (a metric: swapped neighbours cost one edit, also around other edits)."""

from __future__ import annotations

import re
import unicodedata

#: Letters that Unicode does not decompose.
UNDECOMPOSED = {"ø": "o", "đ": "d", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d", "ı": "i"}

_OTHER = re.compile(r"[\W_]+")


def fold(text: str) -> str:
    """Lower case without accents and invisible characters; every run of other characters than letters and digits is one blank."""
    if text.isascii():
        return _OTHER.sub(" ", text.lower()).strip()
    low = "".join(UNDECOMPOSED.get(c, c) for c in unicodedata.normalize("NFKC", text).casefold() if unicodedata.category(c) != "Cf")
    plain = "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))
    return _OTHER.sub(" ", plain).strip()


def distance(a: str, b: str, most: int) -> int:
    """Damerau-Levenshtein distance of a and b, or most + 1 when it is greater than most."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    while a and b and a[0] == b[0] and len(a) > 1 and len(b) > 1 and a[1] == b[1]:
        a, b = a[1:], b[1:]
    while len(a) > 2 and len(b) > 2 and a[-1] == b[-1] and a[-2] == b[-2]:
        a, b = a[:-1], b[:-1]
    far = len(a) + len(b)
    seen: dict[str, int] = {}
    rows = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row, match = [far, i] + [0] * len(b), 0
        for j, y in enumerate(b, 1):
            back, left = seen.get(y, 0), match
            if x == y:
                cost, match = 0, j
            else:
                cost = 1
            row[j + 1] = min(rows[i][j] + cost, row[j] + 1, rows[i][j + 1] + 1, rows[back][left] + (i - back - 1) + 1 + (j - left - 1))
        seen[x] = i
        rows.append(row)
        if min(row[1:]) > most + 1:
            return most + 1
    return min(rows[-1][-1], most + 1)
