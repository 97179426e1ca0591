"""Text forms: one canonical spelling for texts that look the same, folded words for comparisons.

`canonical` keeps what a reader can see (case, accents, digits, punctuation, number of spaces) and drops what they
cannot: the choice among compatibility forms, composed or combining accents, kinds of single space, default-
ignorable characters, controls and look-alike letters. `fold` is the full case folding of that form; `words` are
the runs of letters and digits of the folded form.
"""

from __future__ import annotations

import re
import unicodedata as ud
from functools import cache
from itertools import chain

# Default_Ignorable_Code_Point of the Unicode Character Database, as ranges.
DEFAULT_IGNORABLE = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)

# Letters of other scripts that are drawn like Latin ones (a subset of Unicode's confusables).
LOOK_ALIKE_SMALL = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "ɡ": "g", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p",
    "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ү": "y", "ο": "o", "ν": "v", "ρ": "p", "ι": "i",
    "ϲ": "c", "ϳ": "j", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "ı": "i", "ɑ": "a", "ⅼ": "l",
}
LOOK_ALIKE_CAPITAL = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I", "Ӏ": "I", "Ј": "J", "К": "K", "М": "M",
    "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y", "Ү": "Y", "Α": "A",
    "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "Տ": "S", "Օ": "O", "Ս": "U",
}

#: Compatibility mappings that change what a reader sees; such characters stay as they are.
VISIBLE_TAGS = {"<super>", "<sub>", "<fraction>", "<circle>", "<square>", "<vertical>"}
_JOINED = re.compile("(?<=[←-⯿\U0001f000-\U0001faff️])‍(?=[←-⯿\U0001f000-\U0001faff])")
_KEEP_JOIN = "\U0010fffd"
_CAPITAL = re.compile("[" + "".join(LOOK_ALIKE_CAPITAL) + "]")
_LATIN = re.compile("[A-Za-z]")
_CHUNK = re.compile(r"\S+")
_WORD = re.compile(r"[^\W_]+")
_ASCII_WORDS = {i: chr(i) if chr(i).isalnum() else " " for i in range(128)}
_ASCII_CONTROL = re.compile("[\x00-\x08\x0b-\x1f\x7f]")
_CONTROLS = bytes([*range(0x09), *range(0x0B, 0x20), 0x7F])


@cache
def _tables() -> tuple[dict[str, str], dict[str, str], frozenset[str], re.Pattern]:
    """What characters become: for the canonical form, for the folded form (after case folding), and those to be kept."""
    spacing = {chr(c): "" for a, b in DEFAULT_IGNORABLE for c in range(a, b + 1)}
    spacing |= {chr(c): "" for c in [*range(0x09), *range(0x0E, 0x20), *range(0x7F, 0xA0)]}
    spacing |= dict.fromkeys("\x0b\x0c\x85\u2028\u2029", "\n")
    protected = []
    # Planes without assigned characters are left out.
    for c in chain(range(0xA0, 0x40000), range(0xE0000, 0xF0000)):
        ch = chr(c)
        if ud.category(ch) == "Zs":
            spacing[ch] = " "
        elif ud.decomposition(ch).partition(" ")[0] in VISIBLE_TAGS:
            protected.append(ch)
    return spacing | LOOK_ALIKE_SMALL | LOOK_ALIKE_CAPITAL, spacing | LOOK_ALIKE_SMALL, frozenset(protected), re.compile("[" + "".join(protected) + "]+")


def _mapped(text: str, table: dict[str, str]) -> str:
    """The text with characters replaced; texts have few different ones, so each is looked up once."""
    for c in set(text) & table.keys():
        text = text.replace(c, table[c])
    return text


def spelling(more: dict[str, str]) -> dict[str, str]:
    """What characters become in the canonical form, with more look-alikes than those listed here."""
    return more | _tables()[0]


def canonical(text: str, table: dict[str, str] | None = None) -> str:
    """The one form of all texts that look like `text`: idempotent, case and visible differences kept.

    `table`, if given, is one of `spelling`. Line ends of any kind become a line feed; one space of any kind becomes an ordinary one (their number stays).
    """
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text.isascii():
        # Deleting bytes is a pass far quicker than a pattern; nearly all texts have no control characters.
        if len(text.encode("ascii").translate(None, _CONTROLS)) == len(text):
            return text
        return _ASCII_CONTROL.sub(lambda m: "\n" if m[0] in "\x0b\x0c" else "", text)
    own, _, kept, protected = _tables()
    if "\u200d" in text:
        text = _JOINED.sub(_KEEP_JOIN, text)
    if not kept.isdisjoint(text):
        parts, at = [], 0
        for m in protected.finditer(text):
            parts += [ud.normalize("NFKD", text[at : m.start()]), m[0]]
            at = m.end()
        text = "".join([*parts, ud.normalize("NFKD", text[at:])])
    else:
        text = ud.normalize("NFKD", text)
    text = ud.normalize("NFC", _mapped(text, own if table is None else table))
    return text.replace(_KEEP_JOIN, "\u200d") if _KEEP_JOIN in text else text


def fold(text: str) -> str:
    """`canonical` with full compatibility mapping and full case folding; capital look-alikes count in Latin words."""
    if text.isascii():
        return text.lower()
    text = ud.normalize("NFKD", text)
    if _CAPITAL.search(text):
        text = _CHUNK.sub(lambda m: _mapped(m[0], LOOK_ALIKE_CAPITAL) if _LATIN.search(m[0]) else m[0], text)
    return ud.normalize("NFKC", _mapped(text.casefold(), _tables()[1]))


def words(text: str | None) -> list[str]:
    """The folded runs of letters and digits of a text, [] for null."""
    if not text:
        return []
    if text.isascii():
        return text.lower().translate(_ASCII_WORDS).split()
    return _WORD.findall(fold(text))
