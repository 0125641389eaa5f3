r"""Greedy packing of pieces into chunks of bounded length, by regular expressions in the JVM.

Pieces are joined by marks of the length of the joint that takes their place. A chunk is then the longest run up to the size that
ends at a mark, or else one piece, and one expression finds them all from left to right: a text costs what it
has characters, however many pieces and chunks it has, and no list grows on the way.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Marks are noncharacters, which no text may hold; where one does, it is left out. SPACE and LINES stand for the joints " " and
#: "\n\n" (LINES twice), BREAK ends a chunk in any case, ALONE leads what is marked by the caller.
SPACE, LINES, BREAK, ALONE, _LEFT, _RIGHT = map(chr, range(0xFDD0, 0xFDD6))
_OPEN, _CLOSE = "".join(map(chr, range(0xFDE0, 0xFDE4))), "".join(map(chr, range(0xFDE4, 0xFDE8)))
_PAIRS = ['""', "''", "「」", "『』"]
_QUOTED = "|".join(f"{a}[^{b}]+{b}" for a, b in _PAIRS)
#: What counts as white space and as the end of a sentence.
WHITE = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
ENDS = "[.!?。！？]"


def unmarked(text: Column) -> Column:
    """The text without marks; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x{FDD0}-\x{FDEF}]", "")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def pieces(parts: Column) -> Column:
    """Trimmed parts without the blank ones."""
    return F.filter(F.transform(parts, trimmed), lambda p: p != "")


def packed(marked: Column, size: int) -> Column:
    """array<string> of the chunks of a text whose pieces are joined by marks, with the joints in place of marks."""
    run = rf"(?s)[^{SPACE}{LINES}{BREAK}][^{BREAK}]{{0,{size - 1}}}(?={LINES}{LINES}|[{SPACE}{BREAK}]|\z)|[^{SPACE}{LINES}{BREAK}]+"
    return F.transform(F.regexp_extract_all(marked, F.lit(run), F.lit(0)), lambda c: F.replace(F.replace(c, F.lit(LINES * 2), F.lit("\n\n")), F.lit(SPACE), F.lit(" ")))


def _sentences(text: Column) -> Column:
    """A trimmed text with SPACE in place of what is between its sentences."""
    return F.regexp_replace(text, rf"({ENDS}){WHITE}*(?!\z)", f"$1{SPACE}")


def by_sentences(text: Column, size: int) -> Column:
    """Sentences packed up to size; a longer one is a chunk of its own."""
    return packed(_sentences(trimmed(unmarked(text))), size)


def _long(paragraph: Column, size: int) -> Column:
    """A long paragraph with its sentences marked, and the words of long sentences, each of which begins a chunk."""
    by_word = lambda s: F.concat(F.lit(BREAK), F.regexp_replace(s, f"{WHITE}+", SPACE))
    parts = F.transform(F.split(_sentences(paragraph), SPACE), lambda s: F.when(F.length(s) > size, by_word(s)).otherwise(s))
    return F.regexp_replace(F.array_join(parts, SPACE), SPACE + BREAK, BREAK)


def set_apart(parts: Column, size: int, within) -> Column:
    """Parts joined by LINES; one of more than size characters is within(part), with a BREAK on both sides."""
    joined = F.array_join(F.transform(parts, lambda p: F.when(F.length(p) > size, F.concat(F.lit(BREAK), within(p), F.lit(BREAK))).otherwise(p)), LINES * 2)
    return F.regexp_replace(joined, f"(?:{LINES * 2})?{BREAK}(?:{LINES * 2})?", BREAK)


def by_paragraphs(text: Column, size: int) -> Column:
    """Paragraphs packed up to size; a longer one by its sentences, and a longer sentence by its words. Blank texts stay as they are."""
    marked = set_apart(pieces(F.split(unmarked(text), r"\n\n+")), size, lambda p: _long(p, size))
    return F.when(F.length(trimmed(unmarked(text))) == 0, F.array(text)).otherwise(packed(marked, size))


def by_speech(text: Column, size: int) -> Column:
    """Chunks that end before a quotation that would take them beyond size; what is longer even so is cut by paragraphs.

    A quotation is never cut unless it alone is longer. Its quotes become marks of their own length that say which is which.
    """
    marked = F.regexp_replace(unmarked(text), _QUOTED, f"{_LEFT}$0{_RIGHT}")
    for (a, b), o, c in zip(_PAIRS, _OPEN, _CLOSE):
        marked = F.replace(F.replace(marked, F.lit(_LEFT + a), F.lit(o)), F.lit(b + _RIGHT), F.lit(c))
    run = rf"(?s).{{0,{size - 1}}}[{_CLOSE}][^{_OPEN}]*|[{_OPEN}][^{_CLOSE}]*[{_CLOSE}][^{_OPEN}]*|[^{_OPEN}]+"
    back = lambda c: F.translate(c, _OPEN + _CLOSE, "".join(a for a, _ in _PAIRS) + "".join(b for _, b in _PAIRS))
    chunks = pieces(F.transform(F.regexp_extract_all(marked, F.lit(run), F.lit(0)), back))
    return F.flatten(F.transform(chunks, lambda c: F.when(F.length(c) <= size, F.array(c)).otherwise(by_paragraphs(c, size))))
