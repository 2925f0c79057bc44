"""In-text citations by number: in brackets, as superscripts, in parentheses, or on lines of their own."""

from __future__ import annotations

import re
from collections.abc import Iterator

from .author_year import CONTEXT, NARRATIVE, PAREN, Author, Citation
from .patterns import LABEL_BEFORE, LABEL_WORD, NUMBERS, compiled

RANGE_LIMIT = 100
MOST = 300  # of a number that isn't in brackets
SUPERSCRIPTS = {"⁰": "0", "¹": "1", "²": "2", "³": "3", "⁴": "4", "⁵": "5", "⁶": "6", "⁷": "7", "⁸": "8", "⁹": "9"}
_RAISED = "".join(SUPERSCRIPTS)

# What stands around a number that isn't a citation.
STATISTIC_BEFORE = r"[=<>≤≥nNpPrRdDfFtTzZχ]\s*$"
MEASURE_BEFORE = r"(?:SD|SE|CI|OR|HR|RR|M|df|SS)\s*$"
DOMAIN = r"[A-Za-z0-9-]+\.(?:com|net|org|io|edu|gov|app|info|biz|co|ac|uk|de)\b"


def expand_range(text: str) -> list[int]:
    """The numbers of a list like 1,3-5; thousands commas go, a range gives a hundred numbers at most."""
    out = []
    for part in re.split(r"\s*,\s*", compiled(r"(\d),(\d{3})(?!\d)").sub(r"\1\2", text)):
        if m := compiled(r"^(\d+)\s*[-–—]\s*(\d+)$").match(part):
            out += range(int(m[1]), min(int(m[2]), int(m[1]) + RANGE_LIMIT - 1) + 1)
        elif m := compiled(r"^\s*([-+]?\d+)").match(part):
            out.append(int(m[1]))
    return out


def unbalanced(text: str, at: int) -> bool:
    """Whether a parenthesis is open on the line before a place."""
    line = text[text.rfind("\n", 0, at + 1) + 1 : at]
    return line.count("(") > line.count(")")


class Detector:
    def __init__(self, text: str, references: int | None):
        self.text, self.limit = text, len(text) + 1 if references is None else references
        self.found: list[Citation] = []
        self._spans: set[tuple[int, int]] = set()
        self._token = (-1, -1, False)  # of the last glued digit: first place, end, whether it is an address

    def matches(self, pattern: str) -> Iterator[re.Match]:
        return (m for m in compiled(pattern).finditer(self.text) if m.start() < self.limit)

    def claim(self, span: tuple[int, int]) -> bool:
        new = span not in self._spans
        self._spans.add(span)
        return new

    def before(self, at: int, n: int) -> str:
        return self.text[max(0, at - n) : at]

    def add(self, span: tuple[int, int], raw: str, shown: str, numbers: list[int], around: tuple[int, int] | None = None, style: str = PAREN, authors: list[Author] = ()) -> None:
        a, b = around or span
        context = self.text[max(0, a - CONTEXT) : b + CONTEXT]
        self.found.append(Citation(raw, shown, "numeric", style, list(authors), "", None, *span, context, citation_numbers=numbers))

    def bracketed(self) -> int:
        return sum(c.raw.startswith("[") for c in self.found)

    def brackets(self) -> None:
        for m in self.matches(rf"\[({NUMBERS})\]"):
            if compiled(LABEL_BEFORE, "i").search(self.before(m.start(), 40)) or not self.claim(m.span()):
                continue
            numbers = expand_range(m[1])
            if numbers and 0 not in numbers and not (len(numbers) == 1 and numbers[0] > 500):
                self.add(m.span(), m[0], m[0], numbers)

    def named_brackets(self) -> None:
        for m in self.matches(r"([A-ZÀ-Ÿ][a-zà-ÿā-ž'-]+(?:\s+et\s+al\.?)?)\s*\[(\d+(?:\s*[-–—,]\s*\d+)*)\]"):
            name = m[1].strip()
            if compiled(LABEL_BEFORE, "i").search(re.sub(r"\s+et\s+al\.?\Z", "", name, flags=re.I)) or m.span() in self._spans:
                continue
            if (m.start() + m[0].index("["), m.end()) in self._spans:
                continue
            self.claim(m.span())
            if numbers := expand_range(m[2]):
                self.add(m.span(), m[0], m[0], numbers, style=NARRATIVE, authors=[Author(name, name.lower(), bool(re.search(r"et\s+al", name, re.I)))])

    def superscripts(self) -> None:
        for m in self.matches(f"[{_RAISED}][{_RAISED}⁻,–—-]*"):
            if m.start() and not re.match("[a-zA-Z.]", self.text[m.start() - 1]) or not self.claim(m.span()):
                continue
            plain = "".join(SUPERSCRIPTS.get(c, c) for c in m[0]).replace("⁻", "-")
            if numbers := expand_range(plain):
                self.add(m.span(), m[0], f"[{plain}]", numbers)

    def _in_address(self, start: int, end: int) -> bool:
        """Whether the token around a place, between the nearest white space on both sides, is a web address."""
        a, b, found = self._token
        if not (a <= start and end <= b):
            space, a = compiled(r"\s"), start
            while a > 0 and not space.match(self.text, a - 1):
                a -= 1
            b = compiled(r"\S*").match(self.text, end).end()
            token = self.text[a:b]
            found = bool(compiled(r"(?:https?:\/\/|www\.)", "i").search(token) or compiled(DOMAIN, "i").search(token))
            self._token = (a, b, found)
        return found

    def _is_raised(self, m: re.Match) -> bool:
        """Whether digits glued to a letter or mark can be a superscript that lost its form."""
        text, start, end, mark, digits = self.text, m.start(), m.end(), m[1], m[2]
        last = text[start - 1] if start else ""
        first = int(compiled(r"^\d+").match(digits)[0])
        if not 0 < first <= MOST or (last and last in "0123456789") or text[end : end + 1] in {*"0123456789%"} - {""}:
            return False
        if mark == "." and last and re.match(r"[\s=(<,)]", last):
            return False
        near = text[max(0, start - 50) : end + 20]
        if compiled(r"doi[.:]|10\.\d{4,}", "i").search(near) and not compiled(r"[a-z]{3,}\d", "i").search(m[0]):
            return False
        if compiled(r"https?:\/\/\S+$").search(text[max(0, start - 80) : start + 1]):
            return False
        if self._in_address(start, end):
            return False
        before = self.before(start, 10)
        if compiled(r"pp?\.\s*$").search(before) or compiled(r"(?:vol|no)\.\s*$", "i").search(before):
            return False
        if "a" <= mark <= "z" and not re.match("[a-zA-Z]", last):
            return False
        if compiled(r"^\s*\(\s*[-−]?\d+\s*(?:to|[-–—])\s*\d+").match(text[end : end + 30]):
            return False
        word = compiled(r"([A-Za-z]+)[.)\"]*$").search(text[max(0, start - 30) : start + 1])
        return not word or not (compiled(LABEL_WORD, "i").match(word[1]) or (mark != ")" and re.search("[A-Z]{2}", word[1])))

    def glued_digits(self) -> None:
        for m in self.matches(r"([a-z.)\"])(\d{1,3}(?:[,–-]\d{1,3})*)"):
            span = m.span(2)
            if self._is_raised(m) and self.claim(span) and (numbers := expand_range(m[2])):
                self.add(span, m[0], f"[{m[2]}]", numbers, m.span())

    def after_compounds(self) -> None:
        for m in self.matches(r"[A-Za-z]{3,}-\d\d(\d{1,2}(?:[,–—-]\d{1,3})+)(?!\d)"):
            numbers = expand_range(m[1])
            if numbers and all(0 < n <= MOST for n in numbers) and self.claim(m.span(1)):
                self.add(m.span(1), m[1], f"[{m[1]}]", numbers)

    def parentheses(self) -> None:
        for m in self.matches(rf"\(({NUMBERS})\)"):
            numbers, before = expand_range(m[1]), self.before(m.start(), 40)
            after = self.text[m.end() : m.end() + 10]
            if not numbers or 0 in numbers or (len(numbers) == 1 and 1800 <= numbers[0] <= 2099) or min(numbers) > MOST:
                continue
            if compiled(LABEL_BEFORE, "i").search(before) or compiled(STATISTIC_BEFORE).search(before) or compiled(r"\d\s*$").search(before):
                continue
            if compiled(MEASURE_BEFORE, "i").search(before) or after[:1] in ("%", "°") or unbalanced(self.text, m.start()):
                continue
            if before.rstrip()[-1:] in (":", ";") and re.match(r"\s*[a-zà-ÿ]", after):
                continue
            if self.claim(m.span()):
                self.add(m.span(), m[0], f"[{m[1].strip()}]", numbers)

    def own_lines(self) -> None:
        found = []
        for m in self.matches(r"([.,:;!?)\]\"])\s*\n[ \t]*(\d{1,3}(?:[\s,–-]+\d{1,3})*)[ \t]*(?:\n|$)"):
            digits = m[2].strip()
            numbers = expand_range(re.sub(r"\s+", ",", digits))
            if numbers and all(0 < n <= MOST for n in numbers) and not compiled(LABEL_BEFORE, "i").search(self.before(m.start(), 30)):
                found.append((m, digits, numbers))
        for m, digits, numbers in found if len(found) >= 3 else ():
            at = m.start() + m[0].index(digits)
            if self.claim((at, at + len(digits))):
                self.add((at, at + len(digits)), digits, f"[{digits}]", numbers, m.span())


def detect(text: str, references: int | None = None) -> list[Citation]:
    """Numeric citations before the place where the reference list begins, if given."""
    d = Detector(text, references)
    d.brackets()
    d.named_brackets()
    d.superscripts()
    if d.bracketed() < 3:
        d.glued_digits()
    d.after_compounds()
    if d.bracketed() < 3:
        d.parentheses()
    if len(d.found) < 3:
        d.own_lines()
    return sorted(d.found, key=lambda c: c.start)
