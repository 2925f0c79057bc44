"""Regular expressions with one meaning on every engine.

The grammar below is written with the ASCII reading of \\d, \\w and \\b. `compiled` renders it for Python, where these
would be Unicode; white space and case stay Unicode, as intended.
"""

from __future__ import annotations

import re
from functools import cache

_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
_INSIDE = {"d": "0-9", "w": "A-Za-z0-9_"}
_OUTSIDE = {"d": "[0-9]", "w": "[A-Za-z0-9_]", "b": _EDGE}


def ascii_classes(pattern: str) -> str:
    """The pattern with \\d, \\w and \\b spelt out for ASCII."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out.append((_INSIDE if inside else _OUTSIDE).get(pattern[i + 1], pattern[i : i + 2]))
            i += 2
            continue
        inside = (c == "[" and not inside) or (inside and c != "]")
        out.append(c)
        i += 1
    return "".join(out)


@cache
def compiled(pattern: str, flags: str = "") -> re.Pattern:
    """flags: of i (any case) and m (lines)."""
    return re.compile(ascii_classes(pattern).replace("$", r"\Z" if "m" not in flags else "$"), (re.I if "i" in flags else 0) | (re.M if "m" in flags else 0))


# The grammar of author-year citations.
YEAR = r"\d{4}[a-z]?"
YEAR_ND = r"\d{4}[a-z]?|n\.d\."
YEAR_ANY = r"\d{4}[a-z]?|n\.d\.|in\s+press"
PAGES = r"pp?\.\s*[\d–\-]+"
ET_AL = r"et\s*\.?\s*al\.?"
PARTICLE = (
    "(?:[Vv]an['’]t|[Vv]an['’]s|['’]t|['’]s|[Dd]e|[Dd]el|[Dd]ella|[Dd]ello|[Dd]er|[Dd]en|[Dd]es|[Dd]i|[Dd]u|[Dd]a|[Dd]al|[Dd]alla|[Dd]ei|[Dd]egli|[Dd]elle|[Dd]os|[Dd]as"
    "|[Ee]l|[Aa]f|[Aa]v|[Ll]a|[Ll]e|[Ll]os|[Ll]as|[Tt]en|[Tt]er|[Vv]an|[Vv]on|[Yy]|[Zz]u|[Zz]ur|[Aa]l|[Bb]en|[Bb]in|[Ii]bn|[Aa]bu|[Ss]t|[Ss]aint)"
)
SURNAME = r"[A-ZÀ-Ÿ][a-zßà-ÿā-ž'-]+(?:[A-Z][a-zßà-ÿā-ž'-]+)?(?:\s+(?:Jr|Sr|II|III|IV)\.?)?"
COMPOUND = rf"(?:{PARTICLE}\s+){{0,2}}{SURNAME}(?:\s+{PARTICLE}\s+{SURNAME})?"
COMPOUND_LIST = rf"{COMPOUND}(?:,\s+{COMPOUND}){{1,5}}"
SIGNAL = (
    r"(?:(?:e\.g\.,?|i\.e\.,?|cf\.,?|see(?:[\s,]+(?:also|for\s+example|e\.g\.?))?\.?,?|as\s+in|c\.f\.,?"
    r"|most\s+recently,?\s+in|for\s+[^,;()]{0,40}?,?\s*see|(?:also\s+)?see\s+[^,;()]{0,30}?\s+in)\s+)?"
)
INITIALS = r"(?:[A-Z]\.\s*){0,3}"
ORG = r"[A-Z][\w.'’\-]*(?:\s+[A-Z][\w.'’\-]*){1,5}"

# The grammar of the family without a comma before the year.
PLAIN_CORE = r"[A-ZÀ-Ÿ][a-zà-ÿā-ž']+(?:-[A-Za-zÀ-ÿ][a-zà-ÿā-ž']*)*+"
PLAIN_GAP = r"(?:[^\S\r\n]+(?:\r?\n[^\S\r\n]*)?|\r?\n[^\S\r\n]*)"
PLAIN_CAPITAL = r"(?:El|Van|Von|De|Del|Della|Den|Der|Des|Di|Da|Das|Dos|Du|La|Le|Lo|Las|Los|San|Santa|Santos|Saint|St|Mac|Mc|Ten|Ter)"
PLAIN_SMALL = r"(?:van|von|de|del|della|den|der|des|di|da|das|do|dos|du|la|le|lo|las|los|el|al|y|e|ten|ter)"
PLAIN_NAME = rf"(?:{PLAIN_CAPITAL}{PLAIN_GAP})?{PLAIN_CORE}(?:{PLAIN_GAP}{PLAIN_SMALL}{PLAIN_GAP}{PLAIN_CORE})?"
PLAIN_RUN = rf"{PLAIN_NAME}(?:{PLAIN_GAP}(?:&|and){PLAIN_GAP}{PLAIN_NAME}){{0,2}}"
PLAIN_PAGE = r"(?:\s*,\s*(?:pp?\.\s*)?[A-Z]?\d+(?:\s*[–\-]\s*\d+)?)?"

# Numbers of numeric citations, and words before a number that make it another thing.
NUMBERS = r"\d+(?:\s*[-–—]\s*\d+)?(?:\s*,\s*\d+(?:\s*[-–—]\s*\d+)?)*"
LABEL_BEFORE = (
    r"(?:Table|Figure|Fig|Eq|Equation|Chapter|Section|Step|Item|page|pages|pp?|Appendix|Supplement|Panel|Part|Scheme|Algorithm|Listing|Line|Row|Column|Criterion"
    r"|Condition|Model|Experiment|Sample|Group|Phase|Trial|Block|Protocol|Hypothesis|H\d+)\s*\.?\s*$"
)
STYLE_LABEL_BEFORE = (
    r"(?:Table|Figure|Fig|Eq|Equation|Chapter|Section|Step|Item|page|pages|pp?|Appendix|Supplement|Panel|Part|Hypothesis|H\d+|Study|Experiment|Model|Wave|Phase"
    r"|Condition|Group|Sample|Level|Block|Trial|Round)\s*\.?\s*$"
)
LABEL_WORD = (
    r"^(?:Table|Figure|Fig|Eq|Equation|Chapter|Section|Step|Item|page|pages|pp?|Appendix|Supplement|Panel|Part|Scheme|Algorithm|Listing|Line|Row|Column|Criterion"
    r"|Condition|Model|Experiment|Sample|Group|Phase|Trial|Block|Protocol|Hypothesis|Version|vol|no|CO|H2O|COVID|SARS|mp|km|mg|kg|Hz|kHz|MHz|GHz|dB|mm|cm|nm|pH)$"
)


def jvm(pattern: str, flags: str = "") -> str:
    """The pattern for the JVM, with Unicode white space."""
    body = ascii_classes(pattern)
    return "(?U" + ("iu" if "i" in flags else "") + ("m" if "m" in flags else "") + ")" + (body if "m" in flags else body.replace("$", r"\z"))


def at_once(pattern: str) -> str:
    """A list of numbers for the JVM whose repeats give nothing back: alike, as what follows one can't be a part of it."""
    return re.sub(r"(\\[ds](?:[*+]|\{\d,\d\})|\)[*?])", r"\1+", pattern)
