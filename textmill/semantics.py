"""Patterns and character sets of the refiner, once for Python kernels and once for JVM expressions.

JVM patterns carry (?U) where Python's classes are Unicode, and (?iu) where case is ignored beyond ASCII.
"""

from __future__ import annotations

import re

PRIVATE_BULLETS = ""
#: Characters and what replaces each, one to one.
TYPOGRAPHIC = dict(zip("·‧∙“”‟„’‘‚–— ", "•••\"\"\"\"'''-- ", strict=True))
TYPE_FROM, TYPE_TO = "".join(TYPOGRAPHIC), "".join(TYPOGRAPHIC.values())
TYPE_TABLE = str.maketrans(TYPOGRAPHIC)
BULLETS = dict.fromkeys(PRIVATE_BULLETS, "•")
BULLET_TABLE = str.maketrans(BULLETS)

#: Python's white space.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

PRIVATE = "[-]"
CONTROL = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]"
ZERO_WIDTH = "[​-‍⁠]"
REPLACEMENT = "[�￾]"
INVISIBLE = "[­﻿︀-️]"
GLYPH = "(?i)glyph<[^>]*>|glyph<\\S*"
GLYPH_ESCAPED = "(?i)glyph&lt;[^&]*&gt;"
CID = "\\(cid:\\d+\\)"
ENTITY = "&[a-zA-Z#0-9]+;"
BROKEN_WORDS = "\\b[a-zA-Z]\\s[a-zA-Z]\\s[a-zA-Z]\\b"
LONG_RUN = "(.)\\1{4,}"
HYPHEN_BREAK = "-\\n[a-z]"

DOTTED = "\\.{3,}\\s*\\d+\\s*$"
BULLET_HEAD = "^\\s*[•*·∙‧■▪●◦—-]\\s*"
PAGE_MARKER = "^page\\s+\\d+(\\s+of\\s+\\d+)?$"
SEPARATOR = "^([-_=*]{6,}|#{6,})$"
REFERENCE_HEAD = "^(references|bibliography|références)\\b"
REFERENCE_NAMES = ("references", "reference", "bibliography", "works cited")
REFERENCE_ENTRY = "^(\\[\\d+\\]\\s|\\d+\\.\\s|[A-Z][a-zA-Z\\-]+,\\s+[A-Z]\\.)"
BOILERPLATE = "^(a&a proofs:\\s*manuscript no\\.|article number,\\s*page\\s*\\d+\\s*of\\s*\\d+|arxiv:\\s*\\d{4}\\.\\d|submitted to)"
CAPTION = "\\b(fig|figure|table)\\b"
UNITS = "\\b(cm|ev|g|gev|ghz|hz|kev|kg|khz|km|lambda|m|mev|mhz|mm|ms|s|sigma)\\b"
TERMINAL = ".?!:;)]}\"'"
LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85  ]"


def java(pattern: str, ignore_case: bool = False) -> str:
    """The pattern for java.util.regex, with Python's Unicode classes and line ends."""
    return ("(?iuUd)" if ignore_case else "(?Ud)") + pattern


def python(pattern: str, ignore_case: bool = False) -> re.Pattern[str]:
    return re.compile(pattern, re.IGNORECASE if ignore_case else 0)
