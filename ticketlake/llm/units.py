"""Pieces of a text that tokenizers of words treat alone.

A space behind a character that is no white space begins a new token in
byte-level pre-tokenizers (their words carry one leading space) as well as in
vocabularies whose pieces don't continue over a following space mark. So a text
splits in front of such spaces into *units*, and what a tokenizer makes of a
unit depends on nothing else: it is worked out once per unit and worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

#: the splitting space itself is left out of the parts; every part but the first had one.
#: ``\\S`` of Python leaves out at least what the tokenizers' white space leaves out.
SPLIT = re.compile(r"(?<=\S) ").split
BORDER = re.compile(r"(?<=\S) ")
PART = 1 << 20


def parts(text: str, size: int = PART) -> Iterator[tuple[str, bool]]:
    """(stretch, whether it begins behind a splitting space) of a long text, about
    ``size`` characters each, so the units of a very long text are not all held at once."""
    at, inner = 0, False
    while len(text) - at > size:
        border = BORDER.search(text, at + size)
        if not border:
            break
        yield text[at:border.start()], inner
        at, inner = border.end(), True
    yield text[at:], inner
