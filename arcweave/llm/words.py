"""Words of a text: an ideograph of U+4E00 to U+9FFF is a word by itself, any
other maximal run of letters and digits is one; texts are lower-cased first."""

from __future__ import annotations

import re

_WORD = re.compile("[一-鿿]|[^\\W_一-鿿]+")
find_words = _WORD.findall


def words(text: str | None) -> list[str]:
    return find_words(text.lower()) if text else []
