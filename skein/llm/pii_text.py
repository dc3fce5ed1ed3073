"""Tokens, candidates and features of personal data in one text; small helpers of skein.llm.pii."""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator, Mapping, Set

import regex

#: Labels of the tokens; the first is "no item".
LABELS = ("other", "email", "phone", "id_number", "street", "name")

TOKEN = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*|\d+|\n|[^\w\s]|_")

_AT = r"(?:[ \t]?@[ \t]?|[ \t]?＠[ \t]?|%40|&#64;|&commat;|[ \t]?[(\[{<][ \t]?(?:at|AT|At|@)[ \t]?[)\]}>][ \t]?|[ \t](?:at|AT)[ \t](?=[\w\-]+(?:[ \t](?:dot|DOT)[ \t])))"
_DOT = r"(?:\.|[ \t]?[(\[{][ \t]?(?:dot|DOT|\.)[ \t]?[)\]}][ \t]?|[ \t](?:dot|DOT)[ \t])"
EMAIL = re.compile(rf"(?<![\w.+\-@:/])[^\W_](?:[\w.+'\-]*\w)?{_AT}[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:{_DOT}[A-Za-z0-9\-]+)*{_DOT}[A-Za-z]{{2,}}(?![\w@])")
#: Where an address can be at all.
AT_SIGN = re.compile(r"@|＠|%40|&#64;|&commat;|[(\[{<][ \t]?(?:at|AT|At)[ \t]?[)\]}>]|[ \t](?:dot|DOT)[ \t]")
#: Mailboxes of machines.
NO_PERSON = frozenset("git svn hg noreply no-reply donotreply do-not-reply root postmaster mailer-daemon nobody".split())

PHONE = re.compile(
    r"(?<![\w.+\-/])(?:"
    r"\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{1,5}(?:[ ./\-]?\d{2,5}){1,5}"
    r"|00\d{2}[ .\-]\d{1,4}(?:[ ./\-]\d{2,5}){1,5}"
    r"|(?:\(\d{3}\)[ .\-]?|\d{3}[ .\-])\d{3}[ .\-]\d{4}"
    r"|(?:\(0\d{1,4}\)|0\d{1,4})[ /\-]\d{3,5}[ /\-]\d{3,4}|(?:\(0\d{4}\)|0\d{4})[ /\-]\d{6}"
    r"|0\d(?:[ .\-]\d{2}){4}"
    r")(?![\w]|[.\-/]\d)"
)
ID_NUMBER = re.compile(
    r"(?<![\w.+\-/])(?:"
    r"(?P<ssn>\d{3}[ \-]\d{2}[ \-]\d{4})"
    r"|(?P<nino>[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D])"
    r"|(?P<nir>\d ?\d{2} ?\d{2} ?(?:\d{2}|2[AB]) ?\d{3} ?\d{3}(?: ?\d{2})?)"
    r"|(?P<dni>\d{8}[ \-]?[A-Z]|[XYZ][ \-]?\d{7}[ \-]?[A-Z])"
    r"|(?P<passport>[A-Z]{2} ?\d{7}|[A-Z]\d{8})"
    r"|(?P<tax>\d{2} \d{3} \d{3} \d{3}|\d{11})"
    r")(?![\w]|[.\-]\w)"
)
_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’]*(?:-[A-ZÀ-ÖØ-Þ]?[\w'’]+)*"
#: Kinds of street in the languages of the texts.
STREET = re.compile(
    r"(?<![\w\-.])(?:"
    rf"(?P<en>\d{{1,4}} ?[A-Za-z]?,? (?:(?:[NSEW]\.?|North|South|East|West) )?{_CAP}(?: {_CAP}){{0,2}}? (?:Street|St\.?|Road|Rd|Avenue|Ave|Lane|Ln|Terrace|Row|Quay|Wharf|Court|Ct|Drive|Dr|Way|Place|Pl"
    r"|Square|Sq|Close|Crescent|Hill|Gate|Boulevard|Blvd|Walk|Mews|Parade|Gardens|Grove|Alley|Highway|Park)\b\.?(?=[\W]|$))"
    r"|(?P<de>[A-ZÄÖÜ][\wäöüß]*(?:straße|strasse|str\.|weg|platz|allee|gasse|damm|ufer|ring|stieg|markt) \d{1,4} ?[a-z]?(?![\w])"
    rf"|(?:Am|An der|An den|Im|In der|In den|Zum|Zur|Auf der|Auf dem|Unter den|Hinter der|Hinter dem|Vor dem|Beim) {_CAP} \d{{1,4}} ?[a-z]?(?![\w]))"
    r"|(?P<fr>\d{1,4}(?: ?(?:bis|ter|quater|[A-D]))?,? (?:[Rr]ue|[Aa]venue|[Bb]oulevard|[Cc]hemin|[Aa]llée|[Pp]lace|[Ii]mpasse|[Qq]uai|[Cc]ours|[Rr]oute|[Pp]assage|[Ss]quare)"
    rf" (?:(?:de la|de l['’]|du|des|de|aux|au|à la|d['’]) ?)?{_CAP}(?: (?:(?:de|du|des|la|le) )?{_CAP})*)"
    r"|(?P<es>(?:[Cc]alle|[Aa]venida|[Pp]laza|[Pp]aseo|[Cc]amino|[Rr]onda|C/|Avda\.|Av\.|Pza\.) ?(?:(?:de las|de los|de la|del|de) )?"
    rf"{_CAP}(?: (?:(?:de|del|de la) )?{_CAP})*,? \d{{1,4}}(?: ?(?:bis|[A-D]))?(?![\w]))"
    r")"
)
#: An abbreviated English kind of street keeps its full stop only where a sentence's own follows.
_SHORT = re.compile(r"(?<! St)\.$")

#: Words between given and family name, and titles before a name.
PARTICLES = frozenset("von van der den de la le del della di da do dos das du des al el bin ibn ben ter ten zu zum zur af av y e".split())
TITLES = frozenset("dr prof mr mrs ms miss mme mlle m herr frau sr sra srta dra señor señora don doña monsieur madame sir".split())


#: What a line must have to hold a telephone or identity number; two capitalised words in a row.
_DIGITS = re.compile(r"\d(?:[ .\-/()+A-Z]{0,3}\d){5}")
_DIGIT = re.compile(r"\d")
_CAPITALS = "".join(c for c in map(chr, range(0x10000)) if unicodedata.category(c) == "Lu")
_PAIR = re.compile(rf"[{_CAPITALS}][\w'’.\-]* [{_CAPITALS}]")
#: The blanks of Unicode but the ordinary one; each is a single character, so a copy without them has the same places.
WIDE_BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_WIDE = re.compile(f"[{WIDE_BLANKS}]")
#: What stands between blanks and marks; apostrophes are part of words.
PLAIN_WORD = re.compile(r"""[^!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~\s]+""")


def plain_blanks(text: str) -> str:
    """A copy of the same length in which every Unicode blank is an ordinary space."""
    return text if text.isascii() else _WIDE.sub(" ", text)


def _emails(line: str) -> list[tuple[int, int, int, str]]:
    found = []
    for m in EMAIL.finditer(line):
        local = re.match(r"[\w.+'\-]+", m[0])[0].lower()
        remote = line[m.end() : m.end() + 2]
        if local in NO_PERSON or re.match(r":[\w/~]", remote) or line[max(0, m.start() - 3) : m.start()] == "://":
            continue
        found.append((m.start(), m.end(), 1, "email"))
    return found


def _numbers(line: str) -> list[tuple[int, int, int, str]]:
    found = []
    if _DIGITS.search(line):
        for m in PHONE.finditer(line):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 14:
                found.append((m.start(), m.end(), 2, "phone"))
        found.extend((m.start(), m.end(), 3, m.lastgroup) for m in ID_NUMBER.finditer(line))
    for m in STREET.finditer(line):
        end = m.end()
        if m.lastgroup == "en" and line[end - 1] == "." and _SHORT.search(m[0]) and line[end : end + 1] not in (".", ",", ";", "'", '"'):
            end -= 1
        found.append((m.start(), end, 4, "street_" + m.lastgroup))
    return found


def _lines_with(anchor: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    """Start and end of every line of text that anchor is found in."""
    at = 0
    while (m := anchor.search(text, at)) is not None:
        start, end = text.rfind("\n", at, m.start()) + 1 or at, text.find("\n", m.end())
        end = len(text) if end < 0 else end
        yield start, end
        at = end + 1


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, label, form) of every stretch of a text that has the form of an item other than a name; none crosses a line."""
    text = plain_blanks(text)
    found = []
    for anchor, read in ((AT_SIGN, _emails), (_DIGIT, _numbers)):
        for a, b in _lines_with(anchor, text):
            found += [(s + a, e + a, k, form) for s, e, k, form in read(text[a:b])]
    return found


_NAME = r"\p{Lu}[\p{L}'’]+(?:-\p{Lu}?\p{L}+)*"
_PART = rf"(?:(?:{'|'.join(sorted(PARTICLES))}) )*(?:al-)?"
_FRONT, _BACK = r"(?<![\p{L}\p{N}._@'’\-])", r"(?![\p{L}\p{N}'’@_\-]|\.\p{L})"
#: Two capitalised words beside each other, perhaps with initial and particles; and with a comma between them.
_BESIDE = regex.compile(rf"{_FRONT}({_NAME}) (?:\p{{Lu}}\. )?{_PART}({_NAME}){_BACK}(, \p{{Lu}})?")
_COMMA = regex.compile(rf"{_FRONT}({_NAME}), ({_NAME}){_BACK}( ?[:\d#]| no\.)?")
_AFTER_WORD = regex.compile(r"[\p{L}.] $")
_TWO = re.compile(rf"[{_CAPITALS}][\w'’.\-]*,? {_PART}[{_CAPITALS}]")


def name_pairs(text: str) -> Iterator[tuple[str, str, str, bool]]:
    """(form, left, right, open), lower case, of every two capitalised words that could be a name.

    form is 'beside', 'comma' or, if no other word stands before, 'first' too.
    open says that what follows speaks against a name: after two words beside
    each other a comma and a capital, after a comma form a number.
    """
    text = plain_blanks(text)
    for a, b in _lines_with(_TWO, text):
        line = text[a:b]
        for m in _BESIDE.finditer(line, overlapped=True):
            yield "beside", m[1].lower(), m[2].lower(), m[3] is not None
        for m in _COMMA.finditer(line, overlapped=True):
            yield "comma", m[1].lower(), m[2].lower(), m[3] is not None
            if not _AFTER_WORD.search(line, max(0, m.start() - 2), m.start()):
                yield "first", m[1].lower(), m[2].lower(), m[3] is not None


def shape(word: str) -> str:
    if word[0].isdigit():
        return f"d{min(len(word), 9)}"
    if not word[0].isalpha():
        return word
    if len(word) == 1:
        return "X" if word.isupper() else "x"
    return "XX" if word.isupper() else "Xx" if word[0].isupper() else "xx"


def name_class(word: str, lexicon: dict[str, str]) -> str:
    """What a word can be in a name: given, family, both, part(icle), title, or '' for unknown."""
    low = word.lower()
    if len(word) == 1:
        return "part" if low in PARTICLES and word == low else ""
    if low in PARTICLES and low not in lexicon:
        return "part"
    c = lexicon.get(low) or (lexicon.get(low[3:]) if low.startswith("al-") else None)
    if c is None and "-" in low:  # a double name is what its parts are
        parts = {lexicon.get(x) for x in low.split("-")}
        c = parts.pop() if len(parts) == 1 else None
    if c is None and low in TITLES:
        return "title"
    return c or ""


class Piece:
    """The tokens of a text that can be of interest: words, places, name classes, candidates.

    common are words that the corpus has in lower case too. Every line is read;
    tokens are kept only of lines that can hold an item.
    """

    __slots__ = ("words", "starts", "classes", "marks", "found", "plain", "hidden")

    def __init__(self, text: str, lexicon: Mapping[str, str], common: Set[str] = frozenset()):
        self.words: list[str] = []
        self.starts: list[int] = []
        text = plain_blanks(text)
        self.found = candidates(text)
        lines = dict(_lines_with(_PAIR, text))
        for start, _, _, _ in self.found:
            end = text.find("\n", start)
            lines[text.rfind("\n", 0, start) + 1] = len(text) if end < 0 else end
        low = text.lower()
        if len(low) != len(text):  # a letter whose lower case is longer would move all places
            low = "".join(c if len(x := c.lower()) != 1 else x for c in text)
        for name in lexicon.keys() & set(PLAIN_WORD.findall(low)):
            at = low.find(name)
            while at >= 0:  # every line that has the name
                start, end = low.rfind("\n", 0, at) + 1, low.find("\n", at)
                end = len(low) if end < 0 else end
                lines[start] = end
                at = low.find(name, end)
        for at, end in sorted(lines.items()):
            for m in TOKEN.finditer(text, at, end):
                self.words.append(m[0])
                self.starts.append(m.start())
            self.words.append("\n")
            self.starts.append(end)
        self.classes = [name_class(w, lexicon) if w[0].isalpha() else "" for w in self.words]
        self.plain = ["v" if w.lower() in common else "" for w in self.words] if common else [""] * len(self.words)
        self.hidden: Set[int] = frozenset()
        self.marks: dict[int, tuple[int, str]] = {}
        for start, end, label, form in sorted(self.found, key=lambda c: c[0] - c[1]):
            for i in range(bisect.bisect_left(self.starts, start), bisect.bisect_left(self.starts, end)):
                self.marks.setdefault(i, (label, form))

    def windows(self, reach: int = 4) -> list[tuple[int, int]]:
        """Stretches of tokens around every anchor: a candidate, a word that can be a name, two capitalised words in a row."""
        anchors = set(self.marks)
        words, classes = self.words, self.classes
        for i, c in enumerate(classes):
            if c in ("given", "family", "both"):
                anchors.add(i)
            elif words[i][0].isupper() and i and words[i - 1][0].isupper() and self.starts[i] - self.starts[i - 1] == len(words[i - 1]) + 1:
                anchors.update((i - 1, i))
        out: list[tuple[int, int]] = []
        for i in sorted(anchors):
            a, b = max(0, i - reach), min(len(words), i + reach + 1)
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
        return out

    def hide(self, words: Set[str], marks: bool) -> None:
        """From now on features don't say what the lexicon knows of `words` (lower case), nor, with marks, which form a candidate has."""
        self.hidden = {i for i, w in enumerate(self.words) if w.lower() in words}
        self.classes = ["" if i in self.hidden else c for i, c in enumerate(self.classes)]
        if marks:
            self.hidden |= self.marks.keys()
            self.marks = {}

    def features(self, i: int) -> list[str]:
        """Names of the features of token i."""
        words, classes, plain, hidden = self.words, self.classes, self.plain, self.hidden

        def at(j: int) -> tuple[str, str, str]:
            if not 0 <= j < len(words):
                return "^", "", "^"
            w = words[j]
            c = classes[j]
            return ("*" if c in ("given", "family", "both") or j in hidden else w.lower()), c, shape(w)

        w, c, s = at(i)
        w1, c1, s1 = at(i - 1)
        w2, c2, s2 = at(i - 2)
        n1, d1, t1 = at(i + 1)
        n2, d2, t2 = at(i + 2)
        v = plain[i]
        out = [
            "bias", f"s={s}", f"c={c}", f"-1={w1}", f"-2={w2}", f"+1={n1}", f"+2={n2}", f"s-1={s1}|{s}", f"s+1={s}|{t1}",
            f"c-1={c1}|{c}|{s}", f"c+1={c}|{d1}|{s}", f"c-2={c2}|{s1}|{c}", f"c+2={c}|{t1}|{d2}", f"-12={w2}|{w1}", f"+12={n1}|{n2}",
            f"k-1={c1}|{c}", f"k+1={c}|{d1}", f"v={v}|{c}|{s}", f"v+1={s}|{t1}|{v}|{plain[i + 1] if i + 1 < len(words) else ''}", f"v-1={s1}|{s}|{plain[i - 1] if i else ''}|{v}",
        ]
        if i not in hidden:
            out.append(f"w={w}")
        mark = self.marks.get(i)
        if mark is not None:
            out += [f"m={mark[1]}", f"m={mark[1]}|{w1}"]
        return out

    def name_spans(self, lo: int, hi: int) -> list[tuple[int, int, list[int]]]:
        """(first, last + 1, word tokens) of every stretch in lo..hi that has the form of a personal name.

        Given name or initial, perhaps a middle initial, particles, family
        name; or family name, comma, given name. Words are capitalised or may
        be names; titles and separators end a name.
        """
        words, classes, starts = self.words, self.classes, self.starts

        def gap(i: int) -> bool:  # one blank between i - 1 and i
            return starts[i] - starts[i - 1] - len(words[i - 1]) == 1

        def word(i: int) -> bool:
            if i >= hi or not words[i][0].isalpha() or i in self.marks and self.marks[i][0] != 5:
                return False
            return len(words[i]) > 1 and classes[i] not in ("part", "title") and (words[i][0].isupper() or classes[i] in ("given", "family", "both"))

        def initial(i: int) -> bool:
            return i + 1 < hi and len(words[i]) == 1 and words[i].isupper() and words[i + 1] == "." and starts[i + 1] == starts[i] + 1

        def family(i: int) -> int:
            j = i
            while j < hi and classes[j] == "part" and j + 1 < hi and gap(j + 1):
                j += 1
            return j + 1 if word(j) and (j == i or gap(j)) else 0

        out = []
        i = lo
        while i < hi:
            best = None
            if initial(i) or word(i):
                j = i + 2 if initial(i) else i + 1
                titled = initial(i) and words[i] == "M"  # 'M.' before an initial is a title, not another one
                if j < hi and gap(j) and initial(j) and j + 2 < hi and gap(j + 2) and not titled:
                    k = family(j + 2)
                    best = (i, k) if k else None
                if best is None and j < hi and gap(j):
                    k = family(j)
                    best = (i, k) if k else None
            end = family(i) if word(i) or classes[i] == "part" else 0
            if end and end + 1 < hi and words[end] == "," and starts[end] == starts[end - 1] + len(words[end - 1]) and gap(end + 1):
                g = end + 1
                if word(g) or initial(g):
                    k = g + 2 if initial(g) else g + 1
                    if k < hi and gap(k) and initial(k):
                        k += 2
                    if best is None or classes[i] in ("family", "part"):
                        best = (i, k)
            if best is not None:
                out.append((*best, [t for t in range(*best) if words[t][0].isalpha()]))
            i += 1
        return out
