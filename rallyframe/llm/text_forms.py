"""Plain forms of texts: letters and digits without accents, look-alikes or markup."""

from __future__ import annotations

import re
import unicodedata

# Letters that look like, or stand for, Latin ones and do not decompose.
_LOOK_ALIKES = str.maketrans(
    {
        "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
        "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ո": "n", "һ": "h", "ԛ": "q", "ԝ": "w",
        "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
        "ø": "o", "ł": "l", "đ": "d", "ð": "d", "ħ": "h", "ı": "i", "æ": "ae", "œ": "oe", "ß": "ss", "þ": "th",
    }
)
_MARKUP = re.compile(r"</?[A-Za-z][^<>]{0,200}>")
_JOINED = re.compile(r"(?<=[^\W\d_])(?:­|[-‐]\s*\n\s*|[-‐] )(?=[a-zà-ÿ])")
_OTHER = re.compile(r"[^a-z0-9\s]+")


def folded(text: str) -> str:
    """Lower case, compatibility-decomposed, without accents and look-alike letters."""
    if text.isascii():
        return text.lower()
    plain = unicodedata.normalize("NFKD", text.replace("­", "").lower())
    return "".join(c for c in plain if not unicodedata.combining(c)).translate(_LOOK_ALIKES)


_LOOKS = re.compile(f"[{''.join(map(chr, _LOOK_ALIKES))}]")


def plain_words(text: str) -> list[str]:
    """Words of ``text`` between blanks, each as its a-z and 0-9, after markup and hyphenation are undone."""
    if "<" in text:
        text = _MARKUP.sub("", text)
    if "-" in text or "\u00ad" in text or "‐" in text:
        text = _JOINED.sub("", text)
    if text.isascii():
        return _OTHER.sub("", text.lower()).split()
    # as folded, but marks that combine go with all other characters
    plain = unicodedata.normalize("NFKD", text.replace("\u00ad", "").lower())
    return _OTHER.sub("", _LOOKS.sub(lambda m: _LOOK_ALIKES[ord(m.group())], plain)).split()
