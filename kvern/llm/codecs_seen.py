"""What wrong decodings do to text, and how to undo them.

A transformation is a pair of codecs: text was written in one and read in the
other.  Codecs come from Python's standard library; which transformations are at
work in a corpus is learnt from the corpus (``garbling``).
"""

from __future__ import annotations

import html
import re
import unicodedata
from functools import cache

#: Codecs of the text as written, and as read by mistake; fixed values.
WRITTEN = ("latin_1", "cp1252", "mac_roman", "cp850", "cp437", "cp865")
READ = (
    "latin_1", "cp1252", "iso8859_15", "iso8859_2", "iso8859_4", "iso8859_5", "iso8859_7", "iso8859_9", "iso8859_10", "iso8859_13",
    "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "koi8_r", "mac_roman", "mac_cyrillic", "cp437", "cp850", "cp852", "cp865", "cp866",
)
TWICE = ("latin_1", "cp1252")
LOST = "�"


@cache
def _bytes_of(read: str) -> dict[str, int]:
    """The byte of each character that a codec gives for bytes from 128 on; where it gives none, the control of that number."""
    out: dict[str, int] = {}
    for byte in range(128, 256):
        out.setdefault(bytes([byte]).decode(read, "ignore") or chr(byte), byte)
    return out


@cache
def _shown(read: str) -> dict[int, str]:
    return {byte: char for char, byte in _bytes_of(read).items()}


class Utf8:
    """UTF-8 text read in a one-byte codec, once or twice over."""

    def __init__(self, read: tuple[str, ...]):
        self.read = read
        self.name = "utf_8>" + ">utf_8>".join(read)
        self.direct = True  # what it makes is plain to see, without a look at other words
        self._steps = []
        for codec in read:
            known = _bytes_of(codec)
            lead = "".join(c for c, b in known.items() if 0xC2 <= b <= 0xF4)
            rest = "".join(c for c, b in known.items() if 0x80 <= b <= 0xBF)
            self._steps.append((codec, re.compile(f"[{re.escape(lead)}][{re.escape(rest)}]{{1,3}}")))

    def garble(self, text: str) -> set[str]:
        """The spellings that text can take: characters a codec lacks may show as controls, as lost or as question marks."""
        plain = {text}
        for codec in self.read:
            plain = {v for t in plain for v in self._once(t, codec)}
        return plain

    @staticmethod
    def _once(text: str, codec: str) -> set[str]:
        shown = _shown(codec)
        raw = text.encode("utf-8", "replace")
        lossy = "".join(chr(b) if b < 128 else shown[b] if b >= 0xC0 else "?" for b in raw)
        return {"".join(chr(b) if b < 128 else shown[b] for b in raw), raw.decode(codec, "replace"), lossy}

    def restore(self, word: str) -> str | None:
        """The word as written; None where it is none of this transformation's, or not wholly."""
        for codec, pattern in reversed(self._steps):
            known = _bytes_of(codec)
            done: list[tuple[int, int]] = []
            out, at = [], 0
            for m in pattern.finditer(word):
                whole = _prefix(bytes(known[c] for c in m.group()))
                if whole is None:
                    continue
                text, used = whole
                out += [word[at : m.start()], text]
                at = m.start() + used
                done.append((m.start(), at))
            if not done:
                return None
            inside = {k for a, b in done for k in range(a, b)}
            if any(ord(c) > 127 and k not in inside and unicodedata.category(c)[0] in "LS" for k, c in enumerate(word)):
                return None  # letters that are no part of a garbled sequence: the word is of another script
            word = "".join(out) + word[at:]
        return word if _sound(word) else None


def _prefix(raw: bytes) -> tuple[str, int] | None:
    """The first character of a UTF-8 sequence and those that follow whole, with the bytes used."""
    need = 2 if raw[0] < 0xE0 else 3 if raw[0] < 0xF0 else 4
    try:
        return (raw[:need].decode("utf-8"), need) if len(raw) >= need else None
    except UnicodeDecodeError:
        return None


class OneByte:
    """Text of a one-byte codec read in another one-byte codec."""

    def __init__(self, written: str, read: str):
        self.written, self.read = written, read
        self.name = f"{written}>{read}"
        self.direct = False  # its characters are also ordinary ones of other languages
        there = {b: c for c, b in _bytes_of(written).items() if not unicodedata.category(c).startswith("C")}
        self.back = {c: there[b] for c, b in _bytes_of(read).items() if b in there and there[b] != c}
        self._to: dict[str, str] = {}
        for c, w in self.back.items():
            self._to.setdefault(w, c)

    def garble(self, text: str) -> set[str]:
        return {"".join(self._to.get(c, c) for c in text)} if any(c in self._to for c in text) else set()

    def restore(self, word: str) -> str | None:
        """The word as written, letters for what stands among letters; None where a character is none of this transformation's."""
        out = []
        for k, c in enumerate(word):
            if ord(c) < 128:
                out.append(c)
                continue
            w = self.back.get(c)
            if w is None or unicodedata.category(w)[0] not in "LP":
                return None
            before, after = word[max(0, k - 1) : k], word[k + 1 : k + 2]
            if not w.isalpha() and before.isalpha() and after.isalpha() and not (w == "’" and after.islower()):
                return None
            if w.islower() and after.isascii() and after.isupper() or w.isupper() and before.isascii() and before.islower():
                return None
            out.append(w)
        back = "".join(out)
        return back if back != word and _sound(back) else None


class Lossy:
    """One-byte text read as UTF-8, or characters a codec lacks: what was there is lost."""

    def __init__(self, written: str):
        self.written = written
        self.name = f"{written}>utf_8"
        self.direct = False

    def garble(self, text: str) -> set[str]:
        read = text.encode(self.written, "replace").decode("utf-8", "replace")
        return {read} if LOST in read and LOST not in text else set()

    def restore(self, word: str) -> str | None:
        return None


def _sound(word: str) -> bool:
    """No controls, unassigned or lost characters."""
    return not any(unicodedata.category(c) in ("Cc", "Cn", "Co", "Cs") or c == LOST for c in word)


@cache
def transformations() -> dict[str, Utf8 | OneByte | Lossy]:
    some: list[Utf8 | OneByte | Lossy] = [Utf8((r,)) for r in READ]
    some += [Utf8((a, b)) for a in TWICE for b in TWICE]
    some += [Utf8((a, a, a)) for a in TWICE]
    some += [OneByte(w, r) for w in WRITTEN for r in READ if w != r and {w, r} != {"latin_1", "cp1252"}]
    some.append(Lossy("cp1252"))
    return {t.name: t for t in some}


#: A word with other than ASCII characters, or with a named character of markup.
_WORD = re.compile(r"[^\s\x1c-\x1f]+", re.ASCII)
_ENTITY = re.compile(r"&[A-Za-z]{2,8};")
_RUN = re.compile(r"[^\x00-\x7f][^\x00-\x7f?]*(?:\?+[^\x00-\x7f?]*)*")
_EDGES = r"!\"#$%&'()*+,-./:;<=>@[\\]^_`{|}~"
_ASCII_LETTER = re.compile(r"[A-Za-z]")


def spelt(word: str) -> str:
    """A word with markup's named characters resolved and ASCII punctuation at its edges cut off."""
    word = html.unescape(word) if _ENTITY.search(word) else word
    word = word.strip(_EDGES)
    return word.rstrip("?!.,:;)\"'") if word.endswith("?") and not re.search(r"[^\x00-\x7f]\?$", word) else word


def skeleton(word: str) -> str:
    """A word with each run of other than ASCII characters replaced by one mark."""
    return _RUN.sub("*", word)


def garbled_words(text: str):
    """``(form, pattern, start, end)`` of each word with other than ASCII characters.

    The pattern is the word stripped of non-ASCII characters, with a mark where they
    stood.  A word without ASCII letters takes its neighbours, stripped, into its pattern.
    """
    found = list(_WORD.finditer(text))
    for k, m in enumerate(found):
        raw = m.group()
        if raw.isascii() and not _ENTITY.search(raw):
            continue
        form = spelt(raw)
        if form.isascii():
            continue
        pattern = skeleton(form)
        if not _ASCII_LETTER.search(pattern):
            sides = [_bare(found[j].group()) if 0 <= j < len(found) else "" for j in (k - 1, k + 1)]
            pattern = f"{sides[0]} {pattern} {sides[1]}"
        yield form, pattern, m.start(), m.end()


def _bare(word: str) -> str:
    return "".join(c for c in word if c.isascii() and c.isalpha()).lower()


def runs(form: str) -> list[str]:
    return _RUN.findall(form)
