"""Personal information in free text: find it, and replace it by typed, linkable placeholders.

Mentions are found by one pass of a word automaton over each whole text (given names, person cues,
street words, signs of an email address) and one scan for runs of digits; a small rule then reads
the surroundings of each hit.  Numbers count by their format and what is written around them, since
stock, ticket and meter numbers look alike.  A name is a given name or initial with a surname; a
word that a public tokenizer's vocabulary holds whole in lower case is taken for an ordinary word
and not for a surname where letter case doesn't tell.

Names of any origin are found by a score: two or more capitalised words, none of them ordinary, of
which what stands before and after them (titles, verbs of saying, place prepositions, articles, words
of firms, streets and products), the vocabulary's proper nouns and slips of the keys speak for or
against a person.  The list of given names only decides where letter case doesn't.

Numbers and birth dates are replaced by their keyed permutation within the format (``feistel``),
names, emails and addresses by a keyed tag, so equal values stay linked across documents.  A number
keeps its format's validity: a valid one becomes a valid one (check letter, area and date rules), one
that is never issued another that isn't.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .feistel import permute, permute_date, rewrite

#: A public vocabulary whose whole lower-case entries serve as the list of ordinary words.
COMMON_WORDS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The same of a vocabulary for many languages.
FOREIGN_WORDS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

KINDS = ("name", "email", "phone", "id_number", "address", "birth_date")

# Given names in several languages.
GIVEN = """
adam ahmed aisha alice amara ana anders andrea anika anna antonio arjun åsa astrid ben björn bram carlos carmen charlotte chen chidi chloe
clara dalia daniel david diana diego elena elif emeka emil emily emma erik esther eva fatima felix fernando fiona francesca freya gabriel george
gustav hana hannah hans hassan heidi helen henrik idris ilse ines ingrid ivan jack james jan jane javier jens joao johan john jolanta jonas jorge
jose josé juan julia julian karim karin katarzyna kenji klaus laila lars laura layla leila lena leo liam linda lisa lucas lucía lucia luis łukasz
magnus marco maria maría marie mark markus marta martin mary matteo mehmet michael mirela miguel mohammed nadia nina noah noor nora olaf olga
oliver olivia omar oskar pablo patrick paul paulo pedro peter petra pierre priya quentin rachel rafael renée robert rosa samir samuel sara sarah
simon sofia sophie stefan susan sven tariq thomas thora tomas umar vera victor vikram wanda wei william yara yuki yusuf zoë zoe
""".split()

# Words before a person's name, words that make a name a firm, product or bot, and articles.
CUES = ("mr", "mrs", "ms", "miss", "dr", "prof", "herr", "frau", "sr", "sra", "my name is", "c/o", "signed:", "this is", "mein name ist", "me llamo")
FIRMS = "ltd limited inc gmbh co-op llc llp ag kg plc corp company group sa srl bv works tools foods freight cargo logistics supply supplies trading transport motors media systems software partners holdings bank insurance".split()
THINGS = "bot dashboard app project model printer edition series award prize cup league team".split()
PLACES = "depot lane road street avenue square park bridge station airport hospital university school college church hotel hall tower campus centre center annex building harbour port county district".split()
NOT_PERSON = frozenset([*FIRMS, *THINGS, *PLACES])
ARTICLES = frozenset("the a an our your this that der die das el la los las".split())
LEADS = frozenset("is with for and between reach to by cc from signed mr mrs ms dr miss prof c/o name contact".split())
PARTICLES = "de del della da dos du van von der den ten ter le bin ibn al el la zu".split()
CALENDAR = frozenset("monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december montag dienstag mittwoch donnerstag freitag samstag sonntag januar februar märz mai juni juli oktober dezember lunes martes miércoles jueves viernes sábado domingo enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split())
AT_PLACES = frozenset("in at near around across inside outside into toward towards via nach bei aus en".split())
SAYING = frozenset("said says asked asks wrote writes called calls told replied reported mentioned confirmed requested complained thinks wants wanted needs needed prefers preferred has had lives works moved joined left sent hat sagte fragte schrieb dijo preguntó escribió".split())
ROLES = frozenset("user customer client colleague friend manager engineer nurse doctor teacher patient member owner guest tenant driver agent caller sender recipient kunde kundin herr frau cliente señor señora".split())

# Street words. A German street word is the end of the name and comes before the number.
STREET_EN = "road rd street st avenue ave lane ln close crescent way drive court terrace place square boulevard blvd".split()
STREET_DE = "straße strasse str. gasse weg allee platz garten ring damm ufer".split()
STREET_ES = "calle c/ plaza avenida avda. paseo".split()

# Words that tell what a number is.
PHONE_WORDS = re.compile(r"(?i)\b(?:phone|tel|telephone|mobile|cell|call|ring|text|number is|fax|contact|reach|dial|teléfono|telefon|handy)\b")
OTHER_WORDS = re.compile(r"(?i)\b(?:sku|order|ticket|batch|meter|reading|barcode|tracking|serial|invoice no|stock|part|parts|kit|kits|unit|units|item|items|ref|reference)\b")
BIRTH_WORDS = re.compile(r"(?i)(?:\bborn(?: on)?|\bdate of birth:?|\bdob:?|\bgeboren(?: am)?|\bnacid[oa](?: el)?)\s*$")
BIRTH_HINTS = ("born", "birth", "dob", "geboren", "nacid")

_LETTER = r"[^\W\d_]"
_NAME = rf"{_LETTER}[\w'’]*(?:-{_LETTER}[\w'’]*)?"
_GAP = r"[^\S\n]{1,3}"
_NEXT = re.compile(rf"{_GAP}(?:({_LETTER})\.{_GAP})?({_NAME})")
_NEXT_INITIAL = re.compile(rf"{_GAP}({_LETTER})\.")
_BEFORE_COMMA = re.compile(rf"({_NAME}),{_GAP}$")
_WORD_BEFORE = re.compile(r"([^\s\"“„<(\[>]+)[\s\"“„<(\[]*$")
_INITIAL = re.compile(rf"(?<![\w.ºª'’@+-])({_LETTER})\.({_GAP})({_NAME})")
_TWO = re.compile(rf"[.:]?[\s\"“]{{0,3}}({_NAME})(?:{_GAP}{_LETTER}\.)?{_GAP}({_NAME})")
_AFTER_WORDS = re.compile(rf"{_GAP}([\w-]+)(?:{_GAP}([\w-]+))?")

_NUMBER = re.compile(r"[+(]{0,2}\d(?:[\d()/-]|\.(?=\d)|[^\S\n](?=[\d(])){5,26}(?<=\d)(?!\w)")
_PHONE = [
    ("intl", re.compile(r"(?:\+|00)(?!0)[1-9][\d\s()./-]{7,18}\d$")),
    ("us", re.compile(r"\([2-9]\d\d\)\s?\d{3}[-.\s]\d{4}$")),
    ("us?", re.compile(r"[2-9]\d\d([-.])\d{3}\1\d{4}$")),
    ("us?", re.compile(r"1[2-9]\d\d[2-9]\d{6}$")),
    ("uk", re.compile(r"02[03489]\s?[378]\d{3}\s?\d{4}$|0(?:1\d{3}|7\d{3})\s\d{3}\s?\d{3}$|0(?:11\d|1\d1)\s\d{3}\s\d{4}$")),
    ("de", re.compile(r"0[2-9]\d{1,3}/\d{5,9}$")),
    ("fr", re.compile(r"0[1-9](?:([ .-])\d\d)(?:\1\d\d){3}$")),
]
#: Numbers that the North American plan reserves for examples and fiction.
_EXAMPLE_RANGE = re.compile(r"555[-.\s]?01\d\d$")
_ID = re.compile(r"(?i)(?<![\w-])(?:(\d{3}([- ])\d{2}\2\d{4})|([a-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[a-d])|(\d{8}-?[a-z])|([a-z]{2}\d{7}))(?![\w]|-\w)")
_ID_HINT = re.compile(r"\d\d(?: ?\d\d ?\d\d|\d[- ]\d\d[- ]\d)")

_LOCAL = re.compile(r"[\w.+-]+$")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_AT = re.compile(r"(?i)([ ]?)(?:@|[\[({]at[\])}])([ ]?)")
_SPELLED = re.compile(r"(?i)([A-Za-z0-9-]+(?: ?(?:[\[({]dot[\])}]|\bdot\b|\.) ?[A-Za-z0-9-]+)*?(?: ?(?:[\[({]dot[\])}]|(?<= )dot(?= )|\.) ?[A-Za-z]{2,}))(?![\w])")
_SPELLED_AT = re.compile(r"(?i)([\w.+-]+) at ((?:[a-z0-9-]+ dot )+[a-z]{2,})(?![\w])")

_EN = re.compile(rf"(?i)(?<![\w.,/-])(?:(flat|apartment|unit){_GAP}\w{{1,5}},?{_GAP})?(\d{{1,5}}[a-z]?){_GAP}((?:{_LETTER}[\w'’-]*\.?{_GAP}){{1,3}}?)({'|'.join(STREET_EN)})\b(\.?)((?:,{_GAP}(?:apt|flat|unit){_GAP}\w{{1,5}})?)")
_DE = re.compile(rf"(?i)(?<![\w-])({_LETTER}[\w-]+(?:{'|'.join(re.escape(x) for x in STREET_DE)}){_GAP}\d{{1,4}}[a-z]?\b(?:,?{_GAP}\d{{5}}{_GAP}{_NAME})?)")
_ES = re.compile(rf"(?i)(?<![\w/])((?:{'|'.join(re.escape(x) for x in STREET_ES)}){_GAP}(?:{_NAME}{_GAP}){{1,4}}?\d{{1,4}}(?:,{_GAP}\d{{1,2}}[ºª]{_GAP}{_LETTER}\b)?)")
_BOX = re.compile(rf"(?i)(?<!\w)(p\.?o\.?{_GAP}box{_GAP}\d{{1,6}}(?:,{_GAP}{_NAME})?)")
_DATE = re.compile(r"\b(\d{4})-(\d{2})-(\d{2})\b|\b(\d{1,2})\.(\d{1,2})\.(\d{4})\b")
_STOP = re.compile(r"[.!?;]\s|[\n>\]]")
_SMALL = frozenset("of the and for in on at to from with per only a an".split())
_UP = r"[^\W\d_a-zß-öø-ÿ]"
_TITLE = rf"(?:{_UP}['’])?{_UP}[^\W\d_]+(?:['’-](?!s\b){_LETTER}+)*"
_JOIN = rf"{_GAP}(?:(?:{'|'.join(PARTICLES)}){_GAP}){{0,2}}(?:{_LETTER}\.{_GAP})?"
_RUN = re.compile(rf"(?<![\w.@'’&/-]){_TITLE}(?:{_JOIN}{_TITLE}){{1,4}}(?![\w@])(?!\.\w)")
_PART = re.compile(_TITLE)
_BEHIND = re.compile(r"(?:['’]s?\b|[^\S\n]{1,3}([\w-]+)(?:[^\S\n]{1,3}([\w-]+))?|[^\S\n]{0,2}[<(])?")
_SENTENCE = re.compile(r"(?:^|[.!?:;\n>\]|•*–—-]\s*|^\s+)[\"“„(\[]*$")


@dataclass(frozen=True)
class Mention:
    kind: str
    start: int  # from 0
    end: int


def _style(w: str) -> str:
    return "lower" if w.islower() else "upper" if len(w) > 1 and w.isupper() else "title"


def _near(word: str, other: str) -> bool:
    """The same word, or one slip of the keys away."""
    if word == other:
        return True
    if abs(len(word) - len(other)) > 1 or len(other) < 3:
        return False
    if sorted(word) == sorted(other):
        return True
    a, b = (word, other) if len(word) > len(other) else (other, word)
    return len(a) > len(b) and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


class Finder:
    """Finds all mentions in a text.

    ``common`` holds ordinary words in lower case, ``foreign`` such words of more languages, which only
    keep capitalised ones from counting as a name, and ``proper`` capitalised words.
    """

    def __init__(self, common: frozenset[str], foreign: frozenset[str] = frozenset(), proper: frozenset[str] = frozenset(), given: tuple[str, ...] = tuple(GIVEN)):
        import ahocorasick

        self.common, self.foreign, self.proper, self.given = common, foreign, proper, frozenset(given)
        self.slips: dict[str, bool] = {}
        self.words = ahocorasick.Automaton()
        for w, kind in [*((g, "g") for g in given), *((c, "c") for c in CUES), *((b, "y") for b in BIRTH_HINTS), *((s + " ", "d") for s in STREET_DE), *((s + " ", "s") for s in STREET_ES), ("box ", "b"), ("@", "@"), ("(at)", "@"), ("[at]", "@"), ("{at}", "@"), (" dot ", "."), ("flat ", "n"), *((" " + s, "n") for s in STREET_EN)]:
            had = self.words.get(w, ("", 0))[0]
            self.words.add_word(w, (had + kind, len(w)))
        self.words.make_automaton()

    def __call__(self, text: str) -> list[Mention]:
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        flat = low.replace("\xa0", " ").replace("\n", " ") if "\xa0" in low or "\n" in low else low
        taken: list[Mention] = []
        given, cues, ats, other = [], [], [], set()
        for end, (kinds, n) in self.words.iter(flat):
            for k in kinds:
                if k == "g":
                    given.append((end + 1 - n, end + 1))
                elif k == "c":
                    cues.append((end + 1 - n, end + 1))
                elif k == "@":
                    ats.append(end + 1 - n)
                elif k != "n" or not flat[end + 1 : end + 2].isalpha():
                    other.add(k)
        for i in ats:
            self._email(text, i, taken)
        if "." in other:
            for m in _SPELLED_AT.finditer(text):
                taken.append(Mention("email", m.start(), m.end()))
        if "d" in other:
            for m in _DE.finditer(text):
                if m[1].split()[0].lower() not in self.common:  # "during 12", "spring 2025"
                    taken.append(Mention("address", m.start(1), m.end(1)))
        if "s" in other:
            for m in _ES.finditer(text):
                taken.append(Mention("address", m.start(1), m.end(1)))
        if "b" in other:
            for m in _BOX.finditer(text):
                taken.append(Mention("address", m.start(1), m.end(1)))
        if "n" in other:
            self._english(text, taken)
        self._numbers(text, taken)
        if "y" in other:
            for m in _DATE.finditer(text):
                if BIRTH_WORDS.search(text, max(0, m.start() - 24), m.start()):
                    taken.append(Mention("birth_date", m.start(), m.end()))
        names: list[Mention] = []
        free = [m for m in taken]
        for s, e in given:
            self._given(text, s, e, free, names)
        for s, e in cues:
            self._cue(text, s, e, free, names)
        for m in _INITIAL.finditer(text):
            self._initial(text, m, free, names)
        found = taken + names
        for m in _RUN.finditer(text):
            self._scored(text, m, found, names)
        return _apart(taken + names)

    def _email(self, text: str, i: int, out: list[Mention]) -> None:
        m = _AT.match(text, i - 1 if i and text[i - 1] == " " else i)
        if not m:
            return
        loc = _LOCAL.search(text, max(0, m.start() - 64), m.start())
        if not loc or not loc[0].strip(".+-_"):
            return
        plain = "@" in m[0]
        if plain and bool(m[1]) != bool(m[2]):
            return  # "see @desk": a handle
        dom = _DOMAIN.match(text, m.end()) if plain else None
        if dom is None:
            dom = _SPELLED.match(text, m.end())
        if dom:
            start = loc.start() + (len(loc[0]) - len(loc[0].lstrip(".-")))
            out.append(Mention("email", start, dom.end()))

    def _english(self, text: str, out: list[Mention]) -> None:
        for m in _EN.finditer(text):
            words = m[3].split()
            if any(w.strip(".").lower() in _SMALL or w.islower() and any(_near(w, x) for x in ("the", "of", "for")) for w in words):
                continue
            after = _AFTER_WORDS.match(text, m.end(4))
            if after and after[1].lower() in NOT_PERSON:
                continue
            if m[4].lower() in ("st", "way", "close", "place", "square", "court", "drive") and _style(m[4]) == "lower" and any(_style(w) == "title" for w in words):
                continue  # "12 Marlow close to ..." in running text
            if m[4].islower() and all(w.islower() for w in words) and not text.islower() and m[1] is None and all(w in self.common for w in words):
                continue
            out.append(Mention("address", m.start(1) if m[1] else m.start(2), m.end(6)))

    def _numbers(self, text: str, out: list[Mention]) -> None:
        if _ID_HINT.search(text):
            for m in _ID.finditer(text):
                if not OTHER_WORDS.search(_clause(text, m.start(), 12)):
                    out.append(Mention("id_number", m.start(), m.end()))
        for m in _NUMBER.finditer(text):
            s, e = m.start(), m.end()
            if s and (text[s - 1].isalnum() or text[s - 1] in "-.@/" and not text[s - 1 : s + 1] == "/ "):
                if not (text[s - 1] == "." and s > 1 and not text[s - 2].isdigit()):
                    continue
            self._phone(text, s, m[0], out)

    def _phone(self, text: str, s: int, raw: str, out: list[Mention]) -> None:
        for kind, p in _PHONE:
            t = raw
            while True:  # a run of digits may go on past the number: try its shorter ends
                m = p.match(t)
                if m:
                    digits = re.sub(r"\D", "", t)
                    if kind == "intl" and not self._international(t, digits):
                        m = None
                if m or " " not in t or kind != "intl" and "\n" not in t and kind not in ("us", "us?", "uk", "de", "fr"):
                    break
                t = t.rsplit(None, 1)[0]
            if not m:
                continue
            before, after = text[max(0, s - 40) : s], text[s + len(t) : s + len(t) + 14]
            if kind in ("us?", "uk", "fr") and OTHER_WORDS.search(_clause(text, s, 16)):
                return
            if kind == "us?" and not (_EXAMPLE_RANGE.search(t) or PHONE_WORDS.search(before) or PHONE_WORDS.search(after)):
                return
            end = s + len(t)
            if x := re.match(r"(?i),? ?(?:ext\.?|x) ?\d{1,5}", text[end:]):
                end += x.end()
            out.append(Mention("phone", s, end))
            return

    def _international(self, t: str, digits: str) -> bool:
        if t.startswith("+"):
            return 9 <= len(digits) <= 15 and "\n" not in t and t.count(" ") <= 6
        return t.startswith("00") and 11 <= len(digits) <= 16 and t.isdigit()

    def _plain(self, w: str) -> bool:
        """An ordinary word rather than a surname."""
        w = w.lower()
        return len(w) < 3 or w in self.common or w in NOT_PERSON or w in ARTICLES

    def _person(self, text: str, start: int, end: int) -> bool:
        """Not the name of a firm, product, bot or street."""
        if m := _AFTER_WORDS.match(text, end):
            if m[1].lower() in NOT_PERSON or m[2] and m[2].lower() in ("ltd", "inc", "gmbh", "co-op", "llc"):
                return False
        b = _WORD_BEFORE.search(text, max(0, start - 24), start)
        return not (b and any(_near(b[1].lower(), a) for a in ("the", "our")))

    def _given(self, text: str, s: int, e: int, free: list[Mention], out: list[Mention]) -> None:
        if s and (text[s - 1].isalnum() or text[s - 1] in "._+@-'") or e < len(text) and (text[e].isalnum() or text[e] in "_@+" or text[e] == "-" and text[e + 1 : e + 2].isalnum()):
            return
        if e < len(text) - 1 and text[e] == "." and text[e + 1].isalnum():
            return
        if any(m.start <= s < m.end for m in free):
            return
        g = text[s:e]
        nxt = _NEXT.match(text, e)
        ok = False
        if nxt:
            w, same = nxt[2], _style(nxt[2].split("-")[0])
            style = _style(g)
            ok = not self._plain(w) and (style == same or (style != "lower" and same != "lower"))
            if not ok and style == "title" and same == "title" and w.lower() not in NOT_PERSON and not text.istitle() and w.lower() not in ARTICLES:
                ok = None  # a surname that is also a word, perhaps
        before = _BEFORE_COMMA.search(text, max(0, s - 48), s)
        if before and not self._plain(before[1]) and before[1].lower() not in self.given and not any(m.start <= before.start() < m.end for m in free):
            lead = _WORD_BEFORE.search(text, max(0, before.start() - 24), before.start())
            word = lead[1].lower().rstrip(".:") if lead else ""
            if not ok or word in LEADS or (lead and lead[1][-1] in ":]>"):
                b = _style(before[1].split("-")[0])
                if (b == "lower") == (_style(g) == "lower") and self._person(text, before.start(), e) and not (lead and lead[1][-1].isdigit()):
                    out.append(Mention("name", before.start(), e))
                    return
        if nxt and (ok or ok is None and self._cued(text, s)) and self._person(text, s, nxt.end()):
            out.append(Mention("name", s, nxt.end()))

    def _cued(self, text: str, s: int) -> bool:
        b = _WORD_BEFORE.search(text, max(0, s - 24), s)
        return bool(b) and b[1].lower().rstrip(".:") in LEADS

    def _cue(self, text: str, s: int, e: int, free: list[Mention], out: list[Mention]) -> None:
        """Two words in title case after a title or an introduction, whatever the names are."""
        if s and text[s - 1].isalnum() or e < len(text) and text[e].isalnum():
            return
        m = _TWO.match(text, e)
        if not m or any(f.start <= m.start(1) < f.end for f in free):
            return
        if all(_style(w.split("-")[0]) != "lower" and not self._plain(w.split("-")[0]) for w in (m[1], m[2])) and self._person(text, m.start(1), m.end()):
            out.append(Mention("name", m.start(1), m.end()))

    def _slip(self, word: str) -> bool:
        """One slip of the keys away from an ordinary word: a letter too many, two exchanged, or one missing."""
        had = self.slips.get(word)
        if had is None:
            if len(self.slips) > 200_000:
                self.slips.clear()
            n, ok = len(word), self.common
            had = any(len(x) > 3 and x in ok for x in (word[:i] + word[i + 1 :] for i in range(n)))
            had = had or any(word[:i] + word[i + 1] + word[i] + word[i + 2 :] in ok for i in range(n - 1))
            had = had or (n > 3 and any(word[:i] + c + word[i:] in ok for i in range(n + 1) for c in "abcdefghijklmnopqrstuvwxyz"))
            self.slips[word] = had
        return had

    def _firm(self, word: str) -> bool:
        return word in NOT_PERSON or any(_near(word, x) for x in NOT_PERSON if len(x) > 3 and abs(len(x) - len(word)) < 2 and x[0] == word[0])

    def _scored(self, text: str, m: re.Match, found: list[Mention], out: list[Mention]) -> None:
        """Capitalised words that, by what speaks for and against it, are a person's name."""
        words = [(w.start() + m.start(), w.end() + m.start(), w[0]) for w in _PART.finditer(m[0])]
        odd = [not self._plain(w.split("-")[0]) and w.lower() not in CALENDAR and w.lower() not in self.foreign for _, _, w in words]
        shouted = sum(len(w) > 1 and w.isupper() for _, _, w in words)
        i = 0
        while i < len(words):
            k = i
            while k < len(words) and odd[k]:
                k += 1
            if k - i in (2, 3) and not shouted and not any(x.start < words[k - 1][1] and words[i][0] < x.end for x in found) and self._score(text, words[i:k], i > 0, k < len(words)) >= 2:
                out.append(Mention("name", words[i][0], words[k - 1][1]))
            i = max(k, i + 1)

    def _score(self, text: str, words: list[tuple[int, int, str]], led: bool, followed: bool) -> float:
        low = [w.lower() for _, _, w in words]
        start, end = words[0][0], words[-1][1]
        if any(_near(a, b) for a, b in zip(low, low[1:], strict=False)) or any(self._firm(w) for w in low):
            return -9.0
        fresh = bool(_SENTENCE.search(text, max(0, start - 12), start))
        score = 1.0 + (words[0][2] in self.proper or low[0] in self.given) - 2 * sum(self._slip(x.lower()) for _, _, x in words if x not in self.proper)
        b = _WORD_BEFORE.search(text, max(0, start - 24), start)
        before = b[1].lower().strip(".,:;") if b else ""
        if fresh:
            alone = not text[end : end + 1].strip() and text[end : end + 1] in ("", "\n")
            score += 1 if alone or (b and b[1][-1] == ":" and before.isalpha()) else 0
        elif any(_near(before, a) for a in ARTICLES if len(a) > 2) or before in ARTICLES or before in AT_PLACES or before[-1:].isdigit():
            score -= 4
        elif before != "by":  # firms and persons alike do things
            score += 1 + (before in LEADS or before in ROLES)
        after = _BEHIND.match(text, end)
        nxt = [x.lower() for x in after.groups() if x] if after else []
        if any(self._firm(x) for x in nxt[:2]):
            score -= 4
        elif nxt and (nxt[0] in SAYING or nxt[0].endswith("ed")) or after and after[0] and not nxt:
            score += 1
        elif followed:
            score -= 3
        return score

    def _initial(self, text: str, m: re.Match, free: list[Mention], out: list[Mention]) -> None:
        s, w = m.start(), m[3]
        if any(f.start <= s < f.end for f in free) or self._plain(w.split("-")[0]):
            return
        if (m[1].islower()) != (_style(w.split("-")[0]) == "lower"):
            return
        b = _WORD_BEFORE.search(text, max(0, s - 24), s)
        if b and (b[1][-1] in "ºª" or b[1].lower() in self.given):
            return
        if b and b[1][-1].isdigit() and not any(f.start <= b.start() < f.end for f in free):
            return  # "section 12 B. Then"; after a number found it is a new sentence
        if self._person(text, s, m.end()):
            out.append(Mention("name", s, m.end()))


def _clause(text: str, at: int, width: int) -> str:
    """Up to ``width`` characters before ``at``, from the last end of a sentence or line on."""
    return _STOP.split(text[max(0, at - width) : at])[-1]


def _apart(found: list[Mention]) -> list[Mention]:
    """Mentions in order without overlap: the one that starts first, the longer of equal starts."""
    out: list[Mention] = []
    for m in sorted(set(found), key=lambda m: (m.start, -m.end, m.kind)):
        if not out or m.start >= out[-1].end:
            out.append(m)
    return out


@lru_cache(maxsize=4)
def _words_of(data: bytes) -> frozenset[str]:
    entries = (base64.b64decode(x.split()[0]) for x in data.splitlines())
    return frozenset(x for w in entries if w[:1] == b" " and (x := w[1:].decode(errors="ignore")).isalpha() and x.islower())


@lru_cache(maxsize=4)
def _proper_of(data: bytes) -> frozenset[str]:
    """Capitalised words the vocabulary holds whole, but not in lower case."""
    entries = (base64.b64decode(x.split()[0]) for x in data.splitlines())
    return frozenset(x for w in entries if w[:1] == b" " and len(w) > 3 and (x := w[1:].decode(errors="ignore")).isalpha() and x.istitle() and x.lower() not in _words_of(data) and x.lower() not in CALENDAR)


def common_words(path: str = COMMON_WORDS, foreign: str | None = FOREIGN_WORDS) -> tuple[bytes, bytes]:
    """The vocabulary files that list ordinary words, as sent to the executors."""
    read = lambda p: open(p, "rb").read() if p else b""  # noqa: E731, SIM115
    return read(path), read(foreign)


def finder(data: tuple[bytes, bytes]) -> Finder:
    return Finder(_words_of(data[0]), _words_of(data[1]), _proper_of(data[0]))


#: Check letters of the eight-digit national number, by its remainder by 23.
CHECK_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def _issued(d: str) -> str:
    """What a nine-digit social or tax number can be: issued, a taxpayer's, or neither."""
    if d[3:5] == "00" or d[5:] == "0000" or d[:3] in ("000", "666"):
        return "never"
    return "taxpayer" if d[0] == "9" else "issued"


def _is_date(d: str) -> bool:
    try:
        date(int(d[:4]), int(d[4:6]), int(d[6:]))
    except ValueError:
        return False
    return True


def _within(key: bytes, digits: str, tweak: str, kind) -> str:
    """The pseudonym of ``digits`` among those of the same ``kind``."""
    own = kind(digits)
    return permute(key, digits, tweak, lambda d: kind(d) == own)


def id_pseudonym(key: bytes, value: str) -> str:
    digits = re.sub(r"\D", "", value)
    letters = re.sub(r"[^a-zA-Z]", "", value)
    if len(digits) == 9:
        return rewrite(value, _within(key, digits, "social number", _issued))
    if len(digits) == 8 and letters.upper() in CHECK_LETTERS:  # the letter's distance from the right one stays: a valid number stays valid
        new = permute(key, digits, "national number")
        off = CHECK_LETTERS.index(letters.upper()) - int(digits) % 23
        letter = CHECK_LETTERS[(int(new) + off) % 23]
        return rewrite(value, new)[:-1] + (letter.lower() if letters.islower() else letter)
    return rewrite(value, permute(key, digits, f"{len(digits)} digits, {len(letters)} letters"))


def phone_pseudonym(key: bytes, value: str) -> str:
    """Country and area stay, so that all spellings of a number agree; an exchange that can be dialled stays one."""
    number = re.sub(r"(?i),?\s*(?:ext\.?|x)\s*\d+$", "", value)
    digits = re.sub(r"\D", "", number)
    tail = 7 if len(digits) > 9 else max(1, len(digits) - 3)
    return rewrite(number, digits[:-tail] + _within(key, digits[-tail:], "phone", lambda d: (d[0] > "1", d[1:3] == "11") if len(d) == 7 else True))


def date_pseudonym(key: bytes, value: str) -> str:
    """A day as another one; a date that doesn't exist as another that doesn't."""
    m = _DATE.match(value)
    y, mo, d = (m[1], m[2], m[3]) if m[1] else (m[6], m[5].zfill(2), m[4].zfill(2))
    day = y + mo + d
    new = permute_date(key, date(int(y), int(mo), int(d))).strftime("%Y%m%d").zfill(8) if _is_date(day) else _within(key, day, "no date", _is_date)
    return f"{new[:4]}-{new[4:6]}-{new[6:]}" if m[1] else f"{new[6:]}.{new[4:6]}.{new[:4]}"


def pseudonym(key: bytes, kind: str, value: str) -> str:
    """What replaces a mention inside its placeholder: a number in its format, or a tag of 96 bits."""
    if kind in ("phone", "id_number", "birth_date"):
        return {"phone": phone_pseudonym, "id_number": id_pseudonym, "birth_date": date_pseudonym}[kind](key, value)
    plain = " ".join(sorted(re.findall(r"\w+", value.lower()))) if kind == "name" else re.sub(r"\s+", " ", value.lower())
    return blake2b(f"{kind}|{plain}".encode(), key=key, digest_size=12).hexdigest()


def redacted(text: str, mentions: list[Mention], names: list[str]) -> str:
    out, at = [], 0
    for m, p in zip(mentions, names, strict=True):
        out += [text[at : m.start], f"[{m.kind.upper()} {p}]"]
        at = m.end
    return "".join([*out, text[at:]])


_ITEM = "struct<field:string,kind:string,start_pos:int,end_pos:int,pseudonym:string>"


def scrub(spark: SparkSession, df: DataFrame, fields: list[str], key: bytes, vocabulary: str = COMMON_WORDS, texts: bool = True, foreign: str | None = FOREIGN_WORDS) -> DataFrame:
    """``df`` with each of ``fields`` replaced by its redacted text, and ``mentions`` of all of them.

    A column named ``mentions`` is replaced.  Positions count characters of the original from 1; ``end_pos`` is the last one.  Null texts stay
    null, empty ones empty.  Whole texts are read, row by row, without a shuffle.  With ``texts``
    False the fields are dropped and only the mentions come out.
    """
    common = spark.sparkContext.broadcast(common_words(vocabulary, foreign))
    rest = [c for c in df.columns if c not in fields and c != "mentions"]
    item = pa.struct([("field", pa.string()), ("kind", pa.string()), ("start_pos", pa.int32()), ("end_pos", pa.int32()), ("pseudonym", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder(common.value)
        for b in batches:
            found: list[list[dict]] = [[] for _ in range(b.num_rows)]
            clean = []
            for f in fields:
                col = b.column(f).to_pylist()
                for i, t in enumerate(col):
                    if t and (ms := find(t)):
                        names = [pseudonym(key, m.kind, t[m.start : m.end]) for m in ms]
                        found[i] += [{"field": f, "kind": m.kind, "start_pos": m.start + 1, "end_pos": m.end, "pseudonym": p} for m, p in zip(ms, names, strict=True)]
                        if texts:
                            col[i] = redacted(t, ms, names)
                clean.append(pa.array(col, pa.string()))
            yield pa.record_batch([*[b.column(c) for c in rest], *(clean if texts else []), pa.array(found, pa.list_(item))], names=[*rest, *(fields if texts else []), "mentions"])

    kinds = dict(df.dtypes)
    return df.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in rest], *([f"`{f}` string" for f in fields] if texts else []), f"mentions array<{_ITEM}>"]))
