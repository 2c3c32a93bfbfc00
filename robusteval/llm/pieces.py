"""Splitting texts into the pieces that byte-level vocabularies encode one by one.

The rule is the public one of such vocabularies. Its classes (letter, number, white
space) depend on the Unicode version of the library that applies it, so each library
is asked once a worker, over all code points, which characters it takes for what; the
rule then runs with these explicit classes on the standard library's engine. Texts of
Latin-1 and of the basic plane have shorter classes of their own, as the engine tests
the ranges beyond one by one.
"""

from __future__ import annotations

import re
from functools import cache

#: The classes of the rule, as both libraries write them (fixed values).
CLASSES = {"letter": r"\p{L}", "number": r"\p{N}", "space": r"\s"}


def all_characters() -> str:
    return "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))


def found_by_tiktoken(expression: str) -> str:
    """All characters that tiktoken's engine matches: an encoding without merges
    gives back the bytes of what its pattern finds."""
    import tiktoken

    probe = tiktoken.Encoding("probe", pat_str=expression, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    return bytes(probe.encode_ordinary(all_characters())).decode()


def found_by_tokenizers(expression: str) -> str:
    """All characters that the tokenizers library's engine matches: what stays once
    the rest is replaced by nothing."""
    from tokenizers import Regex
    from tokenizers.normalizers import Replace

    rest = Replace(Regex(f"{expression}+"), "").normalize_str(all_characters())
    return all_characters().translate(dict.fromkeys(map(ord, rest)))


def as_ranges(characters: str, last: int) -> str:
    """The body of a class that holds the characters up to a code point."""
    out, points = [], sorted(p for p in map(ord, characters) if p <= last)
    for p in points:
        if out and p == out[-1][1] + 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(re.escape(chr(a)) if a == b else f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in out)


def rule(found: dict[str, str], last: int) -> re.Pattern[str]:
    """The splitting rule over characters up to a code point."""
    letter, number, space = (as_ranges(found[name], last) for name in ("letter", "number", "space"))
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


class Splitter:
    def __init__(self, library: str):
        ask = {"tiktoken": found_by_tiktoken, "tokenizers": found_by_tokenizers}[library]
        found = {name: ask(expression) for name, expression in CLASSES.items()}
        self.latin, self.basic, self.any = (rule(found, last) for last in (0xFF, 0xFFFF, 0x10FFFF))

    def __call__(self, text: str) -> list[str]:
        """The pieces of a text, in order; together they are the text."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            beyond = len(text.encode("utf-16-le", "surrogatepass")) > 2 * len(text)
            return (self.any if beyond else self.basic).findall(text)
        return self.latin.findall(text)


@cache
def splitter(library: str) -> Splitter:
    """A library's splitter, made once a worker."""
    return Splitter(library)
