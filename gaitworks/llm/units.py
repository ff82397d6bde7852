"""Texts as units that a byte-level BPE tokenizer treats alone.

The pre-tokenization pattern never puts a piece across the place before a space
or line end between two other characters, nor across the place after such a
line end. So a text can be cut there, and most units come again and again.
"""

from __future__ import annotations

import re

_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)|(?<=\S\n)(?=\S)")


def quick_units(text: str) -> list[str]:
    """The text cut at every space and line end; right if every unit is ``sound``."""
    if not text:
        return []
    if "\x00" in text:
        return [""]
    return text.replace("\n", "\x00\n\x00").replace(" ", "\x00 ").split("\x00")


def sound(unit: str) -> bool:
    """A line end alone, or, but for one space in front, something without white space at its ends."""
    word = unit[1:] if unit[:1] == " " else unit
    return unit == "\n" or (word != "" and not word[0].isspace() and not word[-1].isspace())


def careful_units(text: str) -> list[str]:
    """The text cut only where white space is one space or line end alone."""
    return _CUT.split(text) if text else []


def units(text: str) -> list[str]:
    """The text cut into units; joined they are the text again."""
    found = quick_units(text)
    return found if all(map(sound, found)) else careful_units(text)
