"""Labels for the sample on which the field of personal information is fitted: patterns with a narrow form, read beside a label or a known name.

Nothing here takes part in finding: the field sees words, shapes and neighbours only, so it also finds what no pattern of this module matches.
"""

from __future__ import annotations

import re
from collections.abc import Container, Iterable, Iterator

_AT = r"(?:@|\s?\(at\)\s?|\s?\[at\]\s?|\sat\s)"
_DOT = r"(?:\.|\s?\(dot\)\s?|\s?\[dot\]\s?|\sdot\s)"
EMAIL = re.compile(rf"(?<![\w.+@-])[^\W\d_][\w+-]*(?:{_DOT}[\w+-]+)*(?:@[\w-]+(?:{_DOT}[\w-]+)*\.[^\W\d_]{{2,}}|(?:\s?\(at\)\s?|\s?\[at\]\s?)[\w-]+(?:{_DOT}[\w-]+)*{_DOT}[^\W\d_]{{2,}}|\sat\s[\w-]+(?:{_DOT}[\w-]+)*\sdot\s[^\W\d_]{{2,}})", re.I)
_AT_LETTER = re.compile(r"@[^\W\d]")
PHONE = re.compile(
    r"(?<![\w+(./-])(?:\+\d{1,3}[ .-]?(?:\(?\d{1,4}\)?[ ./-]?){2,6}\d{2,}|00\d{2} ?\(0\) ?\d{2}[ \d]{6,10}\d|\(\d{2,4}\) ?\d{3}[ .-]\d{4}|\(0\d{2,4}\) ?\d[\d -]{4,8}\d|0\d{2,4}/\d{4,6}-\d{2,4}|0\d(?:\.\d\d){4}|0\d(?: \d\d){4}|0\d{2,4} \d{3,4} \d{3,4}|\d{3}\.\d{3}\.\d{4}|[2-9]\d{2}-\d{3}-\d{4}|1[2-9]\d{9})(?![\w/]|[.-]\d)"
)
ID_VALUE = re.compile(
    r"(?<![\w+./-])(?:\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}|[A-Z]{1,2}\d{6,7}[A-Z]?|[A-Z]{2} \d{2} \d{2} \d{2} [A-Z]|\d{6}-\d{4}|\d{4}-\d{4}-\d{2}|\d{2} \d{3} \d{3} \d{3}|[A-Z]\d{3}-\d{4}-\d{4})(?![\w/]|[.-]\d)"
)
ID_LABEL = re.compile(r"\b(?:SSN|social security|passport|identity card|national insurance|tax id|driver licen[cs]e|personal number|Ausweis\w*|Personalausweis|Steuer\w*|Pi[èe]ce d.identit[ée]|permis de conduire|num[ée]ro)\b", re.I)
_PLACE = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ'’-]+(?: [A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ'’-]+)?"
_POST = r"(?:[A-Z]{2} \d{5}|[A-Z]{1,2}\d{1,2}[A-Z]? \d[A-Z]{2})"
ADDRESS = re.compile(
    rf"(?<![\w.,/-])(?:\d{{1,4}}[a-z]? (?:(?:rue|quai|avenue|boulevard|place|impasse|chemin|all[ée]e|route|cours) (?:(?:de la|de l['’]|des|du|de|d['’]) ?)?[A-ZÀ-ÖØ-Þ][^\W\d_]+|[A-ZÀ-ÖØ-Þ][^\W\d_]+(?: [A-ZÀ-ÖØ-Þ][^\W\d_]+)? ?(?:Street|Road|Avenue|Lane|Row|Square|Drive|Close|Way|Court|Place|Terrace|Crescent|Boulevard|Gardens|Hill|Walk|Mews|Grove))(?![^\W\d_])"
    rf"|(?:[A-ZÀ-ÖØ-Þ][^\W\d_]*(?:allee|stra(?:ß|ss)e|ring|weg|gasse|platz|damm|ufer|steig)|(?:Am|An der|Im|Zum|Zur|Auf dem) [A-ZÀ-ÖØ-Þ][^\W\d_]+) \d{{1,3}}[a-z]?(?![^\W_]|[-./]\d))"
    rf"(?:, (?:Apt|Flat|Unit|Suite|App\.?|Whg\.?) ?\d+[A-Z]?)?(?:, \d{{5}} {_PLACE}|, {_PLACE}(?:,? {_POST})?)?"
)
_CAP = r"[A-ZÀ-ÖØ-Þ]"
_FAMILY = rf"(?:(?:van|von|de|der|den|del|di|la|du|da|le|ten|zu|VAN|VON|DE|DER|DI|LA|DU|DA|LE) ){{0,2}}(?:[OD]['’])?{_CAP}[^\W\d_]+(?:-{_CAP}[^\W\d_]+)?"
_NAME = re.compile(rf"(?<![\w.@-])(?P<family>{_FAMILY}), (?P<late>{_CAP}[^\W\d_]+)(?: {_CAP}\.)*(?![\w-]|\.\w)|(?<![\w.@-])(?P<given>{_CAP}[^\W\d_]+) (?:{_CAP}\. ?)*(?P<last>{_FAMILY})(?![\w-])|(?<![\w.@-])(?P<initials>{_CAP}\.(?: ?{_CAP}\.)?) (?P<own>{_FAMILY})(?![\w-])")


def name_matches(text: str, given: Container[str], family: Container[str]) -> Iterator[tuple[int, int]]:
    """Spans in a name's form whose given name is a known one, or with initials before a family name whose parts are known or end like known ones."""
    at = 0
    while m := _NAME.search(text, at):
        at = m.start() + 1
        if m["late"]:
            if m["late"].lower() in given and m["family"].split()[-1].lower() not in given:
                yield m.span()
                at = m.end()
        elif m["given"]:
            if m["given"].lower() in given:
                yield m.span()
                at = m.end()
        else:
            parts = re.split(r"[-\s'’]", m["own"])
            if parts[-1].lower() in given:
                continue
            if parts[-1].lower() in family or any(p.lower() in family for p in parts):
                before = text[max(0, m.start() - 12) : m.start()]
                after = re.match(r", ([^\W\d_]+)", text[m.end() : m.end() + 40])
                if m["initials"].startswith("M.") and after and after[1].lower() in given:
                    at = m.start() + 2  # a French title before a name
                    continue
                if re.search(r"\d[\d.e-]* ?\S{0,4}$", before) and not before.rstrip().endswith((",", ":", ";")):
                    continue
                yield m.span()
                at = m.end()


def _may_mail(text: str) -> bool:
    low = text.lower()
    return "(at)" in low or "[at]" in low or " dot " in low or "@" in text and _AT_LETTER.search(text) is not None


def matches(text: str, given: Container[str], family: Container[str]) -> list[tuple[int, int, int]]:
    """(start, end, type) of pattern matches, the first of overlapping ones in the order email, address, phone, id value, name."""
    found: list[tuple[int, int, int]] = []

    def add(spans: Iterable[tuple[int, int]], kind: int) -> None:
        for a, b in spans:
            if all(b <= x or a >= y for x, y, _ in found):
                found.append((a, b, kind))

    if _may_mail(text):
        add((m.span() for m in EMAIL.finditer(text)), 1)
    add((m.span() for m in ADDRESS.finditer(text)), 4)
    add((m.span() for m in PHONE.finditer(text)), 2)
    add((m.span() for m in ID_VALUE.finditer(text)), 3)
    add(name_matches(text, given, family), 0)
    return found


def sample_labels(text: str, given: Container[str], family: Container[str]) -> list[tuple[int, int, int]]:
    """Spans of a sampled text that stand for its labels: the pattern matches, of id values only those beside a label."""
    labels = [m.span() for m in ID_LABEL.finditer(text)]
    kept = []
    for a, b, kind in matches(text, given, family):
        if kind == 3 and not any(0 <= a - y <= 40 or 0 <= x - b <= 24 for x, y in labels):
            continue
        kept.append((a, b, kind))
    return kept
