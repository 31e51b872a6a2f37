"""Personal data in free text: found on a deobfuscated copy, reported in the source's own characters.

Transducers rewrite a text and keep where every piece came from:

1. characters: full-width forms, other scripts' digits, odd blanks and dashes become their plain
   ASCII counterparts one to one, look-alike letters of other scripts do where they stand
   among Latin letters; invisible characters go away;
2. disguises: bracketed or spelled ``at`` and ``dot`` become ``@`` and ``.``; runs of spelled
   digits (in several languages) become digits between two marks.

Detectors run on the result, and their spans are mapped back.  Domains follow a grammar, identity
numbers are known by their form with a label or by their check digits.  Names are judged by a
small model fitted on a list of known names (whole names, and productive beginnings and endings
of names) and on all texts (words that are often written small are no names).
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexmill.scratch import Shared

#: The lists of known names and of ordinary words are sent to every executor; larger ones are refused.
MAX_NAMES = 1_000_000
MAX_ORDINARY = 2_000_000
#: A word is ordinary if it stands in lower case in at least so many documents, and in at least
#: one in ``SMALL_SHARE`` of those in which it stands in either way.
ORDINARY = 3
SMALL_SHARE = 10
#: Kinds in order of precedence where spans overlap.
KINDS = ("email", "address", "id_number", "phone", "name")

# Titles and openings that stand before names and are no names.
_STARTERS = set(
    "mr mrs ms miss dr prof sir dame herr frau monsieur madame mme señor señora don doña dear hi hello hey meet yesterday today tomorrow both thanks regards from to cc attn contact "
    "call ask by and the a an user patient reviewer author owner holder applicant customer name gruß grüße viele mit cordialement saludos nobody everyone according reported forwarded".split()
)

# Look-alikes of Latin letters, signs, and spelled digits.
_CYRILLIC = dict(zip("аеорсухіјѕАВЕКМНОРСТУХІЈЅ", "aeopcyxijsABEKMHOPCTYXIJS"))
_GREEK = dict(zip("ονΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ovABEZHIKMNOPTYX"))
_DASHES = "‐‑‒–—―−﹣"
_BLANKS = "               　"
_HIDDEN = "­​‌‍‎‏‪‫‬‭‮⁠﻿"
_DIGIT_WORDS = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
    "it": "zero uno due tre quattro cinque sei sette otto nove",
    "pt": "zero um dois três quatro cinco seis sete oito nove",
    "nl": "nul een twee drie vier vijf zes zeven acht negen",
}
_DIGITS = {w: str(i) for words in _DIGIT_WORDS.values() for i, w in enumerate(words.split())} | {"oh": "0", "zwo": "2"}


def _table() -> dict[int, str]:
    t = {c + 0xFEE0: chr(c) for c in range(0x21, 0x7F)}
    t |= dict.fromkeys(map(ord, _DASHES), "-") | dict.fromkeys(map(ord, _BLANKS), " ") | {ord("’"): "'", ord("ʼ"): "'"}
    for c in range(0x660, 0x1E960):
        if (d := unicodedata.decimal(chr(c), None)) is not None and c > 0x7F:
            t[c] = str(d)
    return t


_PLAIN = _table()
_FAR = re.compile(r"[^\x00-\x7f]+")
_LOOKS = _CYRILLIC | _GREEK
#: A run with look-alike letters: folded if a Latin letter stands in it.
_MIXED = re.compile("[\\w.@+'-]*[" + "".join(_LOOKS) + "][\\w.@+'-]*")
_LATIN = re.compile("[A-Za-z]")
_LOOK = re.compile("[" + "".join(_LOOKS) + "]")


def _unmixed(m: re.Match) -> str:
    return "".join(_LOOKS.get(c, c) for c in m[0]) if _LATIN.search(m[0]) else m[0]


def plain(source: str) -> str:
    """The characters' plain counterparts, one to one."""
    if source.isascii():
        return source
    flat = _FAR.sub(lambda m: m[0].translate(_PLAIN), source)
    return _MIXED.sub(_unmixed, flat) if _LOOK.search(flat) else flat


_OPEN, _SHUT = "", ""
_WORD_DIGIT = "(?:" + "|".join(_DIGITS) + ")"
_DISGUISE = re.compile(
    rf"""(?ix)
    (?P<gone>[{_HIDDEN}]+)
    | (?P<at>\s*[\[({{<]\s*(?:at|@|ät|arroba|arobase)\s*[\])}}>]\s*)
    | (?P<dot>\s*[\[({{<]\s*(?:dot|\.|punkt|point|punto)\s*[\])}}>]\s*)
    | (?P<said>(?<=[\w])\s+at\s+(?=[a-z0-9][\w-]*(?:\s+dot\s+[\w-]+)+))
    | (?P<sdot>(?<=[\w])\s+dot\s+(?=\w))
    | (?P<digits>\b{_WORD_DIGIT}(?:[\s-]+{_WORD_DIGIT}){{6,}}\b)
    """
)
_HIDES = re.compile(f"[{_HIDDEN}]")
_BRACKETS = re.compile(r"[\[({<]\s*(?:at|@|dot|\.|ät|punkt|point|punto|arroba|arobase)\s*[\])}>]", re.I)
_SPELLED = set(_DIGITS)


def _disguised(flat: str) -> bool:
    """Whether a text may hold a disguise; the cheap questions come first."""
    if not flat.isascii() and _HIDES.search(flat):
        return True
    low = flat.lower()
    if "dot" in low and re.search(r"\sdot\s", low):
        return True
    if _BRACKETS.search(flat):
        return True
    words = low.replace("-", " ").split()
    # the inner words of a run of seven stand without punctuation
    return not _SPELLED.isdisjoint(words) and b"\x01" * 5 in bytes(map(_SPELLED.__contains__, words))


class Folded:
    """A rewritten text that knows where its characters came from."""

    __slots__ = ("text", "_norm", "_src", "_same", "_size")

    def __init__(self, source: str) -> None:
        flat = plain(source)
        self.text, self._norm, self._src, self._same = flat, [0], [0], [True]
        self._size = len(source)
        if not _disguised(flat):
            return
        out, at, n = [], 0, 0
        norm, src, same = [], [], []
        for m in _DISGUISE.finditer(flat):
            kind = m.lastgroup
            if kind == "gone":
                new = ""
            elif kind in ("at", "said"):
                new = "@"
            elif kind in ("dot", "sdot"):
                new = "."
            else:
                new = _OPEN + "".join(_DIGITS[w.lower()] for w in re.findall(r"[^\W\d_]+", m[0])) + _SHUT
            keep = flat[at : m.start()]
            out += (keep, new)
            norm += (n, n + len(keep))
            src += (at, m.start())
            same += (True, False)
            n += len(keep) + len(new)
            at = m.end()
        out.append(flat[at:])
        norm.append(n)
        src.append(at)
        same.append(True)
        self.text, self._norm, self._src, self._same = "".join(out), norm, src, same

    def start(self, i: int) -> int:
        k = bisect_right(self._norm, i) - 1
        return self._src[k] + (i - self._norm[k] if self._same[k] else 0)

    def end(self, i: int) -> int:
        """Source end of a span whose last rewritten character is ``i - 1``."""
        k = bisect_right(self._norm, i - 1) - 1
        if self._same[k]:
            return self._src[k] + i - self._norm[k]
        return self._src[k + 1] if k + 1 < len(self._src) else self._size


_NOT_BEFORE = r"(?<![\w@.#/=+-])"
_MAIL = re.compile(rf"(?<![\w.+-])[\w](?:[\w.+'-]*[\w])?@(?:[A-Za-z0-9](?:[\w-]*[\w])?\.)+(?:[A-Za-z]{{2,24}})(?![\w-]|\.\w)")
#: A domain: labels of letters, digits and inner hyphens, the last one of letters and no spelled digit.
_MAIL_END = re.compile(rf"@(?:[^\W_](?:[^\W_-]|-(?=[^\W_-]|-)){{0,62}}\.)+(?!{_WORD_DIGIT}$)[A-Za-z]{{2,24}}$", re.I)

#: What stands before a number that is no phone and no identity number.
_NO_LABEL = re.compile(
    r"(?:\b(?:build|version|generation|release|revision|rev|port|ports|epoch|size|score|token|snapshot|hash|commit|offset|order|invoice|sku|part|serial|model|rank|segment|shard|from|to)[ \t]*[:=#]?[ \t]*|[=v#])$",
    re.I,
)
#: What stands before nine plain digits that are an identity number.
_ID_LABEL = re.compile(
    r"(?:\b(?:ssn|social security|identity|identification|id|national|tax|tin|insurance|passport|pass|personal|personnummer|personnr|ausweis|ausweisnummer|steuernummer|steuer-?id|idnr|svnr|sozialversicherungsnummer|nif|nie|dni|cpf|curp|rut|pesel|bsn|cnp|aadhaar|insee|s[ée]cu|codice fiscale|nino|card|id_?n[or]|id_?number|national_?id|tax_?id)\b[^\n\d]{0,24}|[,;|][ \t]*)$",
    re.I,
)
_ID = re.compile(
    r"""(?x)
    (?<![\w.+/-])(?:
      (?P<ssn>\d{3}(?P<s>[-. ])\d{2}(?P=s)\d{4})
    | (?P<nine>\d{9})
    | (?P<nino>[A-Za-z]{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-Da-d])
    | (?P<hetu>\d{6}[-+A]\d{3}[0-9A-Z])
    | (?P<pass>[A-Z]{2}\d{7,8})
    | (?P<dni>(?:\d{8}|[XYZ]\d{7})-?[A-Z])
    | (?P<cpf>\d{3}\.\d{3}\.\d{3}-\d{2})
    | (?P<cf>[A-Z]{6}\d{2}[A-EHLMPRST]\d{2}[A-Z]\d{3}[A-Z])
    | (?P<nir>[12][ ]\d{2}[ ]\d{2}[ ]\d{2}[ ]\d{3}[ ]\d{3}[ ]\d{2})
    | (?P<pnr>\d{6}(?:\d{2})?-\d{4})
    | (?P<steuer>\d{2}[ ]\d{3}[ ]\d{3}[ ]\d{3})
    )(?![\w@]|[-.]\w)"""
)


def _luhn(d: str) -> bool:
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0


def _eleven(d: str, n: int) -> bool:
    return sum(int(c) * w for c, w in zip(d, range(n + 1, 1, -1))) * 10 % 11 % 10 == int(d[n])


def checks(kind: str, text: str) -> bool:
    """Whether the check digits of an identity number of this form are right; forms without any never pass."""
    d = re.sub(r"\D", "", text)
    if kind == "dni":
        d = {"X": "0", "Y": "1", "Z": "2"}.get(text[0], "") + d
        return "TRWAGMYFPDXBNJZSQVHLCKE"[int(d) % 23] == text[-1]
    if kind == "cpf":
        return _eleven(d, 9) and _eleven(d, 10)
    if kind == "nir":
        return 97 - int(d[:13]) % 97 == int(d[13:])
    if kind == "pnr":
        return _luhn(d[-10:])
    return False


#: Forms that are identity numbers as they stand; the others need a label or right check digits.
_CERTAIN = {"ssn", "nino", "hetu", "pass", "cf"}

_PHONE = re.compile(
    rf"""(?x)
    {_OPEN}\d+{_SHUT}
    | (?<![\w.+/@-])(?:
        (?:\+|00)[1-9]\d{{0,2}}(?:[ .\-/]?(?:\(0\)|\(\d{{1,4}}\)|\d{{1,12}})){{1,6}}
      | (?:1[ .-])?(?:\(\d{{3}}\)[ ]?|\d{{3}}[ ./-])\d{{3}}[ .-]\d{{4}}
      | 0\d{{2}}[ ]\d{{4}}[ ]\d{{4}} | 0\d{{3}}[ ]\d{{3}}[ ]\d{{3,4}} | 0\d{{4}}[ ]\d{{6}} | 0\d{{4}}[ ]\d{{5}}
      | 0\d([. -])\d\d(?:\1\d\d){{3}}
      | \(0\d{{2,4}}\)[ ]?\d{{3,8}}(?:[ -]\d{{1,4}})?
      | 0\d{{2,4}}/\d{{4,9}}(?:-\d{{1,4}})?
    )(?![\w@]|[-./]\d|\.\w)"""
)
_CAP = r"[^\W\d_](?:[^\W\d_]|['-](?=[^\W\d_]))*"
_STREET_EN = "street|st|road|rd|avenue|ave|lane|ln|drive|dr|close|court|ct|way|boulevard|blvd|terrace|ter|place|pl|square|sq|crescent|grove|gardens|hill|park|row|walk|mews|parade|highway|parkway|alley|circle"
_STREET_ROMANCE = "rue|avenue|boulevard|allée|allee|chemin|impasse|place|quai|route|cours|via|viale|piazza|corso|rua|travessa"
_STREET_SPANISH = "calle|avenida|paseo|plaza|camino|carrer|carretera|ronda"
_NUMBER_FIRST = re.compile(
    rf"""(?x)
    [0-9](?<![\w.,/:@#+-][0-9])\d{{0,4}}[A-Za-z]?(?:
      [ ]+(?:(?:North|South|East|West|Old|New|Upper|Lower|Great|Little|[NSEW]\.?|NORTH|SOUTH|EAST|WEST|OLD|NEW|UPPER|LOWER|GREAT|LITTLE)[ ]+)*(?P<en>{_CAP}(?:[ ]{_CAP}){{0,2}}?)[ ](?i:{_STREET_EN})\b
    | (?:[ ]?(?:bis|ter))?,?[ ]+(?i:{_STREET_ROMANCE})[ ]+(?:(?i:de[ ]la|de[ ]l'|de|du|des|d'|della|delle|dei|do|da)[ ]*)?(?P<fr>{_CAP}(?:[ ][A-ZÀ-Þ]{_CAP})?)
    )"""
)
_STREET_JOINED = "straße|strasse|str\\.|gasse|allee|platz|weg|damm|ufer|gatan|gata|vägen|veien|gade|vej|straat|laan|plein|gracht|katu"
_STREET_SLAVIC = "ul\\.|ulica|ул\\.|улица|просп\\.|проспект"
_NUMBER_LAST = re.compile(
    rf"""(?x)
    (?<![\w.,/:@#+-])(?:
      (?i:{_STREET_SPANISH})[ ]+(?:(?i:de[ ]la|de[ ]los|de|del)[ ]+)?(?P<sp>{_CAP}),?[ ]+\d{{1,5}}[A-Za-z]?(?!\w|[.,-]\d)
    | (?P<de>[^\W\d_][\w-]*(?i:{_STREET_JOINED}))[ ]+\d{{1,5}}[ ]?[A-Za-z]?(?![\w]|\.\d|-\d)
    | (?i:{_STREET_SLAVIC})[ ]+(?P<sl>{_CAP}),?[ ]+\d{{1,5}}[^\W\d_]?(?!\w|[.,-]\d)
    )"""
)
#: What a text with a street before its number holds somewhere.
_STREETS = tuple("|".join([_STREET_SPANISH, _STREET_JOINED, _STREET_SLAVIC]).replace("\\", "").split("|"))
_PARTICLES = r"(?:(?i:van|von|de|la|del|della|di|da|dos|der|den|le|ter|zu)[ ])*"
_TOKEN = r"[^\W\d_][^\W\d_]*(?:['-][^\W\d_]+)*"
_UP = "A-ZÀ-ÖØ-Þ" + "".join(chr(c) for a, z in ((0x100, 0x250), (0x370, 0x530)) for c in range(a, z) if unicodedata.category(chr(c)) == "Lu")
# what stands before is looked at behind the first letter, so that the search goes from capital to capital
_NAME = re.compile(
    rf"""(?x)
    (?P<first>[{_UP}](?<![\w@.'/+-][\s\S])(?:\.(?=[ ])|[^\W\d_]*(?:['-][^\W\d_]+)*))
    (?P<rest>(?:[ ](?:[{_UP}]\.(?=[ ])|{_PARTICLES}(?=[{_UP}]){_TOKEN})){{1,4}})
    """
)
_PIECE = re.compile(rf"[{_UP}]\.|{_PARTICLES}(?=[{_UP}]){_TOKEN}")
_COMMA = re.compile(rf"[^\W\d_],[ ][{_UP}]")
_TURNED = re.compile(
    rf"(?<![\w@.'/+-])(?P<family>{_PARTICLES}(?=[{_UP}]){_TOKEN}),[ ](?P<given>[{_UP}]\.(?![\w])|(?=[{_UP}]){_TOKEN})(?P<more>(?:[ ](?:[{_UP}]\.(?![\w])|(?=[{_UP}]){_TOKEN}))?)"
)


# Beginnings only family names have.
_ELIDED = re.compile(r"(?:d|o|l|n|dell|dall)'[^\W\d_]{3,}$|fitz[^\W\d_]{3,}$")
# Endings only family names have, in scripts in which no list is given.
_ENDED = re.compile(
    r"[а-яёіїє]{2,}(?:ов|ев|ёв|ова|ева|ёва|ский|ская|цкий|цкая|енко|чук|швили|дзе)$|[α-ωά-ώ]{2,}(?:όπουλος|οπούλου|ίδης|ίδου|ιάδης|ιάδου|άκης|άκη)$"
)
#: A word, not as part of a mailbox (for the JVM).
_WORD = r"(?U)(?<![\w@.'+-])\p{L}+(?![\w@'+-]|\.\w|\s*[\[(]\s*at|＠|\s+at\s+\w+\s+dot\b)"


@dataclass
class NameModel:
    """Which words are given or family names: listed ones, and those put together like many listed ones."""

    given: set[str] = field(default_factory=set)
    family: set[str] = field(default_factory=set)
    ordinary: set[str] = field(default_factory=set)
    heads: dict[str, set[str]] = field(default_factory=dict)
    tails: dict[str, set[str]] = field(default_factory=dict)

    @classmethod
    def fit(cls, names: Iterable[tuple[str | None, str | None]], ordinary: Iterable[str]) -> NameModel:
        """``names`` are (name, 'given' or 'family'), ``ordinary`` words that are no names; nulls are passed over."""
        m = cls()
        m.ordinary = set(ordinary) | _STARTERS
        listed: dict[str, set[str]] = {"given": set(), "family": set()}
        for name, kind in names:
            if name and kind in listed:
                word = name.split()[-1].lower()
                if word not in m.ordinary:
                    listed[kind].add(word)
                    listed[kind].add(name.lower())
        m.given, m.family = listed["given"], listed["family"]
        for kind, low in (("given", 2), ("family", 4)):
            tails, heads = defaultdict(set), defaultdict(set)
            for w in listed[kind]:
                if w.isalpha():
                    for i in range(1, len(w) - 1):
                        heads[w[:i]].add(w[i:])
                        tails[w[i:]].add(w[:i])
            m.heads[kind] = {h for h, x in heads.items() if len(x) >= 2}
            m.tails[kind] = {t for t, x in tails.items() if len(x) >= 3 and len(t) >= low}
        return m

    def _made(self, w: str, kind: str) -> bool:
        heads, tails = self.heads[kind], self.tails[kind]
        return any(w[:i] in heads and w[i:] in tails for i in range(1, len(w) - 1))

    def judged(self) -> NameModel:
        """The same with remembered answers, for one process."""
        for name in ("is_given", "is_family", "could_be_given", "could_be_family"):
            setattr(self, name, lru_cache(200_000)(getattr(self, name)))
        return self

    def is_given(self, w: str) -> bool:
        w = w.lower()
        return w in self.given or (w not in self.ordinary and self._made(w, "given"))

    def knows_given(self, w: str) -> bool:
        return w.lower() in self.given

    def is_family(self, w: str) -> bool:
        small = "'" in w and w.rsplit("'", 1)[1][:1].islower()  # an article, not the beginning of a name
        w = w.lower()
        last = w.split()[-1]
        if w in self.family or last in self.family or (_ELIDED.match(last) and not small) or _ENDED.match(last):
            return True
        if last in self.ordinary:
            return False
        return self._made(last, "family") or any(p in self.family or self._made(p, "family") for p in re.split("['-]", last) if len(p) > 3)

    def could_be_given(self, w: str) -> bool:
        """A word that no one writes small; used only beside a family name."""
        return len(w) > 2 and w.lower() not in self.ordinary

    def could_be_family(self, w: str) -> bool:
        """A word that no one writes small; used only after a listed given name."""
        last = w.lower().split()[-1]
        return len(last) > 3 and last not in self.ordinary and not self.is_given(w)


def _names(s: str, m: NameModel) -> Iterator[tuple[int, int]]:
    at = 0
    turned = bool(_COMMA.search(s))
    while True:
        x = _NAME.search(s, at)
        y = _TURNED.search(s, at) if turned else None
        if y and (not x or y.start() <= x.start() or y.start() < x.end()):
            span = _turned(y, m)
            if span and (not x or not (z := _straight(x, s, m)) or y.start() <= z[0]):
                yield span
                at = span[1]
                continue
            if not x or y.start() < x.start():
                at = y.start() + 1 + len(re.match(r"\w*", s[y.start() + 1 :])[0])
                continue
        if not x:
            return
        span = _straight(x, s, m)
        if span:
            yield span
            at = span[1]
        else:  # go on behind the first word
            at = x.start("rest")


def _turned(y: re.Match, m: NameModel) -> tuple[int, int] | None:
    """Family name, comma, given name or initial."""
    family, given = y["family"], y["given"]
    if not m.is_family(family):
        return None
    if not (given.endswith(".") or m.is_given(given) or (m.could_be_given(given) and not m.is_family(given))):
        return None
    more = y["more"].strip()
    end = y.end() if more and (more.endswith(".") or m.is_given(more)) else y.end("given")
    return y.start(), end


def _straight(x: re.Match, s: str, m: NameModel) -> tuple[int, int] | None:
    """Given name or initial, further ones, family name; the earliest and then longest reading within the run."""
    pieces = [(p[0], p.start(), p.end()) for p in _PIECE.finditer(s, x.start(), x.end())]
    given = [p.endswith(".") or m.is_given(p) for p, _, _ in pieces]
    maybe = [g or m.could_be_given(p) for g, (p, _, _) in zip(given, pieces)]
    family = [not p.endswith(".") and m.is_family(p) for p, _, _ in pieces]
    for i, (w, a, _) in enumerate(pieces[:-1]):
        for j in range(min(i + 3, len(pieces) - 1), i, -1):
            f, _, end = pieces[j]
            if family[j] and all(maybe[i:j]) and not family[i]:
                return a, end
            if all(given[i:j]) and m.knows_given(w) and not f.endswith(".") and m.could_be_family(f):
                return a, end
    return None


#: Addresses, identity numbers and phones hold a digit and stand in one line.
_DIGIT = re.compile(r"\d")


def _numbered(s: str) -> Iterator[tuple[int, int]]:
    """The lines with a digit."""
    at = 0
    while m := _DIGIT.search(s, at):
        at = s.find("\n", m.end())
        at = len(s) if at < 0 else at
        yield s.rfind("\n", 0, m.start()) + 1, at


def _numbers(s: str, at: int, end: int, streets: bool, put) -> None:
    for pattern in (_NUMBER_FIRST, _NUMBER_LAST) if streets else (_NUMBER_FIRST,):
        for x in pattern.finditer(s, at, end):
            if x[x.lastgroup][0].isupper():
                put("address", x.start(), x.end())
    for x in _ID.finditer(s, at, end):
        before = s[max(0, x.start() - 48) : x.start()]
        form = next(g for g in ("nine", "ssn", "nino", "hetu", "pass", "dni", "cpf", "cf", "nir", "pnr", "steuer") if x[g])
        label = _ID_LABEL.search(before)
        # a column of a list is label enough for nine plain digits only
        if form not in _CERTAIN and not checks(form, x[0]) and not (label and (form == "nine" or label[0][0] not in ",;|")):
            continue
        if _NO_LABEL.search(before) and not re.search(r"(?i)\b(?:id|id_?no|ssn|nr|no|number|nummer)\.?[ \t]*[:=#]?[ \t]*$", before):
            continue
        put("id_number", x.start(), x.end())
    for x in _PHONE.finditer(s, at, end):
        digits = sum(c.isdigit() for c in x[0])
        if not 7 <= digits <= 16:
            continue
        before = s[max(0, x.start() - 24) : x.start()]
        if _NO_LABEL.search(before) and not re.search(r"(?i)\b(?:pager|phone|tel|fax|mobile|cell)\.?[ \t]*[:=#]?[ \t]*$", before):
            continue
        put("phone", x.start(), x.end())


def find(source: str | None, model: NameModel) -> list[tuple[str, int, int]]:
    """(kind, start, end) in the source, in order, without overlaps; null and empty give none."""
    if not source:
        return []
    folded = Folded(source)
    s = folded.text
    got: list[tuple[int, int, str]] = []
    starts: list[int] = []
    ends: list[int] = []

    def put(kind: str, a: int, z: int) -> None:
        """Takes a span unless it meets one that is taken; taken spans are kept in order."""
        i = bisect_left(starts, z)
        if i == 0 or ends[i - 1] <= a:
            starts.insert(i, a)
            ends.insert(i, z)
            got.append((a, z, kind))

    if "@" in s:
        for x in _MAIL.finditer(s):
            a, z = folded.start(x.start()), folded.end(x.end())
            if _MAIL_END.search(x[0]) or (source[a:z].count("@") == 1 and " " not in source[a:z]):
                put("email", x.start(), x.end())
    low = s.lower()
    streets = any(x in low for x in _STREETS)
    for line in _numbered(s):
        _numbers(s, *line, streets, put)
    for a, z in _names(s, model):
        put("name", a, z)
    got.sort()
    return [(kind, folded.start(a), folded.end(z)) for a, z, kind in got]


def replace(source: str | None, model: NameModel) -> str | None:
    """The text with ``[KIND]`` in the place of every finding; null stays null."""
    if source is None:
        return None
    out, at = [], 0
    for kind, a, z in find(source, model):
        out += (source[at:a], f"[{kind.upper()}]")
        at = z
    return "".join(out) + source[at:]


def ordinary_words(documents: DataFrame, text: str) -> DataFrame:
    """(word) of capitalised words that are often written small, counted over all documents.

    A word counts once a document and way of writing; words that never stand capitalised
    can't be taken for names and are left out.
    """
    words = documents.select(F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(_WORD), F.lit(0)))).alias("w"))
    low = F.lower("w")
    small, all_ = F.count_if(F.col("w") == low), F.count(F.lit(1))
    counted = words.groupBy(low.alias("word")).agg(small.alias("small"), all_.alias("n"))
    return counted.where((F.col("small") >= ORDINARY) & (F.col("small") < F.col("n")) & (F.col("small") * SMALL_SHARE >= F.col("n"))).select("word")


def fit_model(documents: DataFrame, text: str, names: DataFrame) -> NameModel:
    """Model of the listed names and of all documents' ordinary words (both checked to be few enough to send)."""
    if names.count() > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} names are no list to broadcast")
    words = [r["word"] for r in ordinary_words(documents, text).limit(MAX_ORDINARY + 1).collect()]
    if len(words) > MAX_ORDINARY:
        raise ValueError(f"more than {MAX_ORDINARY} ordinary words are no list to broadcast")
    return NameModel.fit([(r["name"], r["kind"]) for r in names.select("name", "kind").collect()], words)


def findings(df: DataFrame, key: str, text: str, model: NameModel) -> DataFrame:
    """(key, kind, start, stop, value): every finding, ``value`` as it stands in the text.

    Null and empty texts have none; texts of any length are read whole; a document's repeated
    value comes once per place; an empty table gives no rows.
    """
    shared = Shared(df.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.get().judged()
        for b in batches:
            rows = [(k, kind, a, z, t[a:z]) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for kind, a, z in find(t, m)]
            cols = list(zip(*rows)) if rows else [()] * 5
            types = [b.schema.field(0).type, pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[key, "kind", "start", "stop", "value"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, kind string, start int, stop int, value string")


def values(df: DataFrame, key: str, text: str, model: NameModel) -> DataFrame:
    """(key, kind, value): the distinct findings of every row of ``df``; no shuffle where the key is unique."""
    shared = Shared(df.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.get().judged()
        for b in batches:
            rows = [(k, *x) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x in dict.fromkeys((kind, t[a:z]) for kind, a, z in find(t, m))]
            cols = list(zip(*rows)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [b.schema.field(0).type, pa.string(), pa.string()])], names=[key, "kind", "value"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, kind string, value string")


def redacted(df: DataFrame, key: str, text: str, model: NameModel) -> DataFrame:
    """(key, text) with typed placeholders; null stays null."""
    shared = Shared(df.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.get().judged()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([replace(t, m) for t in b.column(1).to_pylist()], pa.string())], names=[key, "text"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, text string")
