"""Personal data in free text, found and replaced.

Found are mail addresses (also spelled out), phone numbers, identity numbers, street and box addresses and names of
persons. Names are told by given names: a prior list and those that the corpus shows (llm/evidence.py); a family name
told once is found again wherever it stands alone in the same text.

Each piece is replaced either by a typed placeholder or by a surrogate. Surrogates come from bijections of one key for the
whole corpus, so no table is shared, different originals get different surrogates in all texts, and the same original
gets the same one everywhere: given names of the prior are permuted within their gender, their short forms become short
forms of the surrogate of the full name (made up where it has too few), other letters are substituted within vowels and
consonants of their script and case, digits by their place counted from the right, so that a number written in several
ways stays one number. A substituted word that would be a given name is substituted again until it is none. Of an address
only street types, words such as Suite or Box and state codes stay, of a mail domain only its last label.

Defined results
* null, empty and blank texts hold nothing and are returned as they are; texts of any length are read whole;
* a value is the text exactly as it stands, within one line; each distinct (field, kind, value) comes out once a row;
* in a garbled text the value is the garbled text; names inside mail addresses and street names do not count;
* a surrogate differs from its original wherever that has a letter of a known script or a digit; it may equal another
  original, which is itself replaced;
* repeated rows each give their rows (repeated ids once per row); extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tacitra.llm.encoding import inspect_text
from tacitra.llm.names import ALSO_WORDS, GIVEN, SHORT, fold
from tacitra.session import checkpointed

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._+%-'")
_DOMAIN = re.compile(r"[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}")
_SPELLED = re.compile(
    r"(?: ?(?:\[at\]|\(at\)|\[@\]) ?[\w-]+(?:(?:\.| ?(?:\[dot\]|\(dot\)) ?| dot )[\w-]+)*(?:\.| ?(?:\[dot\]|\(dot\)) ?| dot )| (?:at|AT) [\w-]+(?:(?:\.| (?:dot|DOT) )[\w-]+)* (?:dot|DOT) )[A-Za-z]{2,}\b"
)
_GAP = r"(?:[ \t]+|[ \t]*\r?\n[>|: \t]*)"
_IDNUM = re.compile(
    rf"\b(?:(?:SSN|S\.S\.N\.|social security(?: number| no\.?| card)?|soc\. ?sec\.|SIN|NI(?: number| no\.?)?|national (?:insurance|id)(?: number| no\.?)?|national insurance"
    rf"|driver'?s? licen[cs]e|licen[cs]e|passport|employee|staff|personnel|badge|insurance|policy|tax id|NHS|ID)(?:{_GAP}(?:number|num\.?|no\.?|nr\.?|id|card|is))?:?{_GAP}(?:#{_GAP}?)?|soc\. ?sec\.{_GAP}#)"
    r"(?P<v>[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-Z]\b|\d{3}[- ]\d{2}[- ]\d{4}\b|\d{3}[- ]\d{3}[- ]\d{3}\b|[A-Z]{0,3}-?\d{5,12}\b)",
    re.IGNORECASE,
)
_BARE_ID = re.compile(r"(?<![\w-])(?:\d{3}-\d{2}-\d{4}|[A-Z]{2} \d\d \d\d \d\d [A-D])(?![\w-])")
_PHONE = re.compile(
    r"(?<![\w$€£.,/+-])(?:\+\d{1,3}[ .-]?(?:\(?\d{1,4}\)?[ .-]?)?\d{3,4}[ .-]?\d{4}|(?:\+?1[ .-])?(?:\(\d{3}\) ?|\d{3}[ ./-])\d{3}[ .-]\d{4}|\(0\d{2,4}\) ?\d{3,4} ?\d{3,4}|\d{10})(?:,? ?(?:x|ext\.?|extension) ?\d{1,5})?(?![\w-]|[.,/]\d)"
)
_SHORT_PHONE = re.compile(r"(?<![\w$€£.,/+-])\d{3}[-.]\d{4}(?:,? ?(?:x|ext\.?|extension) ?\d{1,5})?(?![\w-]|[.,/]\d)")
_PHONE_WORD = re.compile(r"\b(?:phone|tel|call|cell|fax|mobile|reach|dial|ring|direct|pager|extension|ext)\b[^\n\d]{0,30}$", re.IGNORECASE)
_STREET = "Lane|Ln|Avenue|Ave|Street|St|Road|Rd|Boulevard|Blvd|Drive|Dr|Court|Ct|Parkway|Pkwy|Way|Place|Pl|Terrace|Highway|Hwy|Square|Sq|Close|Crescent"
_PLACE = r"(?:[A-Z][\w'’]+(?: [A-Z][a-z'’]+)?)"
_TOWN = rf"(?:,? {_PLACE},? [A-Z]{{2}} \d{{5}}(?:-\d{{4}})?|, {_PLACE}(?=[ ,.;\r\n]|$)(?!@))?"
_ADDRESS = re.compile(rf"(?<![\w,.$-])\d{{1,5}}[A-Z]? (?:[A-Z][\w'’]+ ){{1,3}}(?:{_STREET})\b\.?(?:,? (?:Suite|Ste\.?|Apt\.?|Unit|Floor) \w+| #\w+)?{_TOWN}")
_STREET_PARTS = re.compile(rf"(?P<flat>(?:Flat|Apartment|Unit) )?(?P<door>(?(flat)\w+, ))(?P<number>\d{{1,5}}[A-Z]?) (?P<street>(?:[A-Z][\w'’]+ ){{1,3}})(?P<type>(?:{_STREET})\b\.?(?:,? (?:Suite|Ste\.?|Apt\.?|Unit|Floor) (?=\w)| #(?=\w))?)")
_BOX_PARTS = re.compile(r"(?:P\. ?O\. ?|PO )Box ")
_STATE = re.compile(r"[A-Z]{2}(?= \d{5})")
_FLAT = re.compile(r"(?:Flat|Apartment|Unit) \w+, $")
_BOX = re.compile(rf"\b(?:P\. ?O\. ?|PO )Box \d+{_TOWN}")
_ID_WORDS = ("ssn", "s.s.n", "secur", "soc.", "sin", "ni ", "ni\n", "ni:", "national", "licen", "passport", "employee", "staff", "personnel", "badge", "insurance", "policy", "tax id", "nhs", "id")
# letters, and every character outside ASCII that is no quotation mark, dash or blank: garbled letters stand for letters
_L = r"[^\W\d_]|[^\x00-\x7f“”‘’„…–—«»\s]|(?<=[ÃÂ√])[\xa0«»‘’“”„…–—]"
_TOKEN = re.compile(rf"(?:{_L})+(?:['’](?:{_L})+)*")
_ASCII_TOKEN = re.compile("[A-Za-z]+(?:'[A-Za-z]+)*")
_INITIALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_TITLES = frozenset("Mr Ms Mrs Miss Dr Prof Herr Frau Mme".split())
# Words that stand before ", Given" or behind a given name without being part of it.
_NO_SURNAME = frozenset(
    """regards thanks thank you thx cheers sincerely truly best saludos hi hello dear hey am pm on at le from to cc the and or mon tue wed thu fri sat sun monday tuesday wednesday
    thursday friday saturday sunday jan feb mar apr may jun jul aug sep oct nov dec energy ok yours faithfully team all folks attn re fw fwd subject date sent please ask copy loop
    with for of in is was has have will would could should can wrote writes said says about who whom but as if so that this it by mr ms mrs dr i we he she they you their her his our my
    morning afternoon evening gentlemen ladies everyone folks greetings treasury regulatory credit scheduling settlements operations research legal tax risk power gas reach reached yet before after today tomorrow also only not then now just still does did do are were be been might may""".split()
)

# words at which a name can be told: given names and titles as they are written
_TELLING = frozenset(x for w in (*GIVEN, *SHORT) for x in (w, w.capitalize(), w.upper())) | _TITLES


@lru_cache(maxsize=1 << 16)
def _given(word: str) -> str | None:
    """The folded given name of the prior that a token is, accents and garbled accents aside."""
    low = word.lower()
    if low in GIVEN or low in SHORT:
        return low
    if word.isascii():
        return None
    for plain in (fold(word), fold(inspect_text(word)[0])):
        if plain in GIVEN or plain in SHORT:
            return plain
    holes = re.split(r"[^\x00-\x7f]+", low)  # an accent that cannot be restored stands for one letter
    if sum(map(len, holes)) >= 2:
        fits = re.compile(".".join(map(re.escape, holes)))
        return next((g for g in GIVEN if fits.fullmatch(g)), None)
    return None


@lru_cache(maxsize=64)
def _telling(learned: frozenset[str]) -> frozenset[str]:
    """The words at which a name can be told, with the learned given names as they are written."""
    return _TELLING | {x for w in learned for x in (w.capitalize(), w.upper())}


@lru_cache(maxsize=1 << 16)
def _among(word: str, learned: frozenset[str]) -> str | None:
    """The learned given name that a token is, accents and garbled accents aside."""
    low = word.lower()
    if low in learned or word.isascii():
        return low if low in learned else None
    return next((x for x in (fold(word), fold(inspect_text(word)[0])) if x in learned), None)


def _emails(text: str) -> list[tuple[int, int]]:
    """Spans of mail addresses: the local part is walked back from the sign, the domain matched behind it."""
    out = []
    at = text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        if m:
            out.append((at, m.end()))
        at = text.find("@", at + 1)
    if "[at]" in text or "(at)" in text or "[@]" in text or " dot " in text or " DOT " in text:
        out += [m.span() for m in _SPELLED.finditer(text)]
    found = []
    for at, end in out:
        a = at
        while a and text[a - 1] in _LOCAL:
            a -= 1
        while a < at and (text[a] in "-+%" or text[a] == "'" and text.count("'", a, at) % 2):
            a += 1
        if a < at:
            found.append((a, end))
    return found


def find_names(text: str, taken: list[tuple[int, int]], learned: frozenset[str] = frozenset()) -> list[tuple[int, int]]:
    """Spans of person names outside the spans ``taken``; ``learned`` are given names beside those of the prior.

    A family name found beside a given name, title or initial is found again wherever it stands alone in the same text,
    unless the text has it as a word in small letters.
    """
    chars = text
    if taken:
        pieces, at = [], 0
        for a, b in taken:
            if a >= at:
                pieces += [text[at:a], "\x01" * (b - a)]
                at = b
        chars = "".join(pieces) + text[at:]
    tokens = [(*m.span(), m[0]) for m in (_ASCII_TOKEN if chars.isascii() else _TOKEN).finditer(chars)]
    n, out, used = len(tokens), [], -1
    families: set[str] = set()
    telling = _telling(learned)
    known_small: list[set[str]] = []

    def small() -> set[str]:
        if not known_small:
            known_small.append({t[2] for t in tokens if t[2].islower()})
        return known_small[0]

    plain = chars.isascii()
    for k in [i for i, t in enumerate(tokens) if t[2] in telling or t[2] in _INITIALS or not plain and not t[2].isascii()]:
        a, b, w = tokens[k]
        if k <= used:
            continue
        first = w[0]
        before = chars[a - 1] if a else "\n"
        if before in "@\x01_" or before == "." and a > 1 and (chars[a - 2].isalnum() or chars[a - 2] == "."):
            continue

        def gap(i: int) -> str:
            return chars[tokens[i][1] : tokens[i + 1][0]] if i + 1 < n else "\n"

        def surname(i: int, like: str) -> bool:
            """Whether token i can be the family name of a name written like ``like`` (title, upper or lower)."""
            if i >= n:
                return False
            t = tokens[i][2]
            if len(t) < 3 or t.lower() in _NO_SURNAME:
                return False
            if like == "lower":
                return t.islower() and len(t) >= 5
            if like == "upper":
                return t.upper() == t and len(t) >= 4
            return t[0].isupper() and not (t[1:2].isupper() and t[1:2].isascii())

        if w in _TITLES and gap(k) in (". ", " "):
            j = k + 1
            if surname(j, "title") or surname(j, "upper"):
                s, e = tokens[j][0], tokens[j][1]
                used = j
                if _given(tokens[j][2]) and gap(j) == " " and surname(j + 1, "title"):
                    e, used = tokens[j + 1][1], j + 1
                if not _given(tokens[used][2]):
                    families.add(tokens[used][2])
                out.append((s, e))
            continue
        name = _given(w) or (_among(w, learned) if learned else None)
        if name is None:
            # initial and family name
            if len(w) == 1 and first.isupper() and gap(k) == ". " and before not in ".\x01" and (surname(k + 1, "title") or surname(k + 1, "upper")) and len(tokens[k + 1][2]) >= 4:
                prior = chars[max(0, a - 2) : a]
                if not re.fullmatch(r"[\d\x01] ", prior):
                    families.add(tokens[k + 1][2])
                    out.append((a, tokens[k + 1][1]))
                    used = k + 1
                continue
            continue
        like = "lower" if w.islower() else "upper" if len(w) > 2 and w.upper() == w else "title"
        if like == "lower":
            if name in GIVEN and gap(k) == " " and surname(k + 1, "lower"):
                out.append((a, tokens[k + 1][1]))
                used = k + 1
            continue
        if like == "title" and not first.isupper():
            continue
        # family name, given name
        if k and k - 1 > used and chars[tokens[k - 1][1] : a] == ", " and not (gap(k) == " " and surname(k + 1, like)):
            family = tokens[k - 1][2]
            if len(family) >= 4 and family.lower() not in _NO_SURNAME and family[0].isupper() and chars[tokens[k - 1][0] - 1 : tokens[k - 1][0]] not in ("@", "\x01", "_"):
                e, used = b, k
                if k + 1 < n and gap(k) == " " and len(tokens[k + 1][2]) == 1 and tokens[k + 1][2].isupper() and tokens[k + 1][2] != "I":
                    e, used = tokens[k + 1][1], k + 1
                    if chars[e : e + 1] == ".":
                        e += 1
                families.add(family)
                out.append((tokens[k - 1][0], e))
                continue
        e, used = b, k
        j = k + 1
        if j < n and gap(k) == " " and len(tokens[j][2]) == 1 and tokens[j][2].isupper() and gap(j) in (". ", " ") and (surname(j + 1, like) or surname(j + 1, "upper")):
            e, used = tokens[j + 1][1], j + 1
        elif j < n and re.fullmatch(r' (?:"\w+" |  ?)?', gap(k)) and (surname(j, like) or like == "upper" and surname(j, "title") or like == "title" and surname(j, "upper") and len(tokens[j][2]) > 4):
            e, used = tokens[j][1], j
        if used > k:
            families.add(tokens[used][2])
        elif name in ALSO_WORDS or name not in GIVEN and name not in SHORT and name in small():
            continue
        out.append((a, e))
    families = {f for f in families if len(f) >= 4 and f[0].isupper()}
    if families:
        held = [False] * (len(chars) + 1)
        alone = [t for t in tokens if t[2] in families]
        if len(alone) > len(families):  # otherwise every one stands in the name that told it
            for a, b in out:
                held[a:b] = [True] * (b - a)
            alone = [t for t in alone if not held[t[0]] and chars[t[0] - 1 : t[0]] not in ("@", "\x01", "_", ".", "/") and chars[t[1] : t[1] + 1] not in ("@", "\x01", "_", "/")]
            if alone:
                out += [(a, b) for a, b, w in alone if w.lower() not in small()]
    return out


def find_personal(text: str, learned: frozenset[str] = frozenset()) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every piece of personal data, in order, without overlaps."""
    found: list[tuple[int, int, str]] = []
    found += [(a, b, "email") for a, b in _emails(text)]
    if any(c in text for c in "0123456789"):
        low = text.lower()
        if any(w in low for w in _ID_WORDS):
            for m in _IDNUM.finditer(text):
                if any(c.isdigit() for c in m["v"]):
                    found.append((*m.span("v"), "idnum"))
        for m in _BARE_ID.finditer(text):
            found.append((*m.span(), "idnum"))
        for m in _ADDRESS.finditer(text):
            a, b = m.span()
            flat = _FLAT.search(text, max(0, a - 20), a)
            found.append((flat.start() if flat else a, a + len(m[0].rstrip(" ,")), "address"))
        if "Box" in text:
            for m in _BOX.finditer(text):
                found.append((m.start(), m.start() + len(m[0].rstrip(" ,")), "address"))
        for m in _PHONE.finditer(text):
            found.append((*m.span(), "phone"))
        for m in _SHORT_PHONE.finditer(text):  # numbers without area code count where a word says so
            if _PHONE_WORD.search(text, max(0, m.start() - 45), m.start()):
                found.append((*m.span(), "phone"))
    order = {"email": 0, "idnum": 1, "address": 2, "phone": 3}
    kept: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(found, key=lambda x: (order[x[2]], x[0])):
        if all(b <= c or a >= d for c, d, _ in kept):
            kept.append((a, b, kind))
    kept.sort()
    names = find_names(text, [(a, b) for a, b, _ in kept], learned)
    return sorted(kept + [(a, b, "name") for a, b in names])


# -- replacement -------------------------------------------------------------------------------------------------------

_GROUPS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "0123456789", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь")


def _shuffled(items: str | list[str], key: bytes) -> list[str]:
    return sorted(items, key=lambda x: hmac.digest(key, x.encode(), hashlib.sha256))


def _turned(items: str | list[str], key: bytes) -> dict[str, str]:
    """A keyed permutation of ``items`` that is one cycle: nothing keeps its place."""
    order = _shuffled(items, key)
    return {x: order[(i + 1) % len(order)] for i, x in enumerate(order)}


class Surrogates:
    """Keyed bijections for names, letters and digits."""

    def __init__(self, key: bytes):
        self.key = key
        self.given: dict[str, str] = {}
        for gender in "fm":
            self.given |= _turned(sorted(g for g, (s, _) in GIVEN.items() if s == gender), key + gender.encode())
        self.short = self._shorts()
        self.reserved = {*GIVEN, *SHORT, *self.short.values()}
        self.tables: dict[int, dict[str, str]] = {}
        self.blocks: dict[int, dict[str, str]] = {}

    def _shorts(self) -> dict[str, str]:
        """A short form of the full name's surrogate for each short form, no two alike."""
        forms: dict[str, list[str]] = {}
        for short, full in SHORT.items():
            if short not in GIVEN:
                forms.setdefault(full, []).append(short)
        out, used = {}, {*GIVEN, *SHORT}
        for full, shorts in forms.items():
            to = self.given[full]
            more = (to[:n] + end for n in range(min(3, len(to)), len(to) + 1) for end in ("y", "ie", "o", "a", "u", "in", "el"))
            known = list(forms.get(to, []))
            while len(known) < len(shorts):
                made = next(x for x in more if x not in used)
                used.add(made)
                known.append(made)
            out |= dict(zip(shorts, known))
        return out

    def _letter(self, c: str, place: int) -> str:
        """The substitute of one letter or digit at its place; accents stay on the letter that takes its place."""
        table = self.tables.get(place)
        if table is None:
            table = self.tables[place] = {k: v for group in _GROUPS for k, v in _turned(list(group), self.key + str(place).encode()).items()}
        low = c.lower()
        to = table.get(low)
        if to is not None:
            return to.upper() if c != low else to
        if not c.isalnum():
            return c
        base, marks = unicodedata.normalize("NFD", c)[0], unicodedata.normalize("NFD", c)[1:]
        if marks and base.lower() in table:
            return unicodedata.normalize("NFC", self._letter(base, place) + marks)
        # letters of other scripts: a permutation of the letters of their kind within 256 neighbouring code points
        block = ord(c) >> 8
        if block not in self.blocks:
            known: dict[str, list[str]] = {}
            for x in map(chr, range(block << 8, block + 1 << 8)):
                if x.isalnum() and not unicodedata.decomposition(x) and x.lower() not in table:
                    known.setdefault(unicodedata.category(x), []).append(x)
            self.blocks[block] = {k: v for kind in known.values() for k, v in _turned(kind, self.key + block.to_bytes(3, "big")).items()}
        return self.blocks[block].get(c, c)

    def letters(self, text: str) -> str:
        """Case, script, length and marks kept; a different text of the same shape gives a different result."""
        return "".join(self._letter(c, i % 64) for i, c in enumerate(text))

    def digits(self, value: str) -> str:
        """Digits by their place from the right of the number, an extension for itself; signs between them do not matter."""
        main, end = value, ""
        if m := re.search(r"(?i),? ?(?:x|ext\.?|extension) ?\d+$", value):
            main, end = value[: m.start()], value[m.start() :]
        out = []
        for part in (main, end):
            place, made = 0, []
            for c in reversed(part):
                made.append(self._letter(c, place % 64) if c.isdigit() else c)
                place += c.isdigit()
            out += reversed(made)
        return "".join(out)

    def word(self, word: str) -> str:
        given = _given(word)
        if given is not None:
            to = self.given[given] if given in GIVEN else self.short[given]
            return to.upper() if word.isupper() and len(word) > 1 else to.capitalize() if word[0].isupper() else to
        made = self.letters(word)
        while _given(made) is not None or made.lower() in self.reserved:  # stays a bijection of the words that are no given names
            made = self.letters(made)
        return made

    def address(self, value: str) -> str:
        """Numbers, street, town and unit substituted; types of street, suite and box words and state codes kept."""

        def words(text: str) -> str:
            return re.sub(r"\w+", lambda m: m[0] if _STATE.match(text, m.start()) and m.end() - m.start() == 2 else self.letters(m[0]), text)

        if m := _STREET_PARTS.match(value):
            return "".join([m["flat"] or "", words(m["door"]), self.letters(m["number"]), " ", words(m["street"]), m["type"], words(value[m.end() :])])
        if m := _BOX_PARTS.match(value):
            return m[0] + words(value[m.end() :])
        return words(value)

    def email(self, value: str) -> str:
        """The words of the local part as names, the labels of the domain but the last substituted; spelled-out signs kept."""
        cut = re.search(r"@| ?\[at\] ?| ?\(at\) ?| ?\[@\] ?| at ", value, re.IGNORECASE)
        if not cut:
            return self.letters(value)
        local = re.sub(r"[^\W_]+", lambda m: self.word(m[0]), value[: cut.start()])
        labels = re.split(r"(\.| ?\[dot\] ?| ?\(dot\) ?| dot )", value[cut.end() :], flags=re.IGNORECASE)
        domain = "".join(x if i % 2 or i == len(labels) - 1 else re.sub(r"[^\W_]+", lambda m: self.letters(m[0]), x) for i, x in enumerate(labels))
        return local + cut[0] + domain

    def replace(self, value: str, kind: str) -> str:
        if kind == "name":
            return _TOKEN.sub(lambda m: self.word(m[0]), value)
        if kind == "email":
            return self.email(value)
        if kind == "address":
            return self.address(value)
        return self.digits(value) if kind == "phone" else self.letters(value)


def replace_personal(text: str, surrogates: Surrogates | bytes | None, learned: frozenset[str] = frozenset()) -> str:
    """``text`` with surrogates (of a key or of bijections made before), or with numbered placeholders where they are None."""
    spans = find_personal(text, learned)
    if not spans:
        return text
    if isinstance(surrogates, bytes):
        surrogates = Surrogates(surrogates)
    number: dict[str, int] = {}
    to: dict[tuple[str, str], str] = {}
    out, at = [], 0
    for a, b, kind in spans:
        value = text[a:b]
        if (kind, value) not in to:
            number[kind] = number.get(kind, 0) + 1
            to[kind, value] = f"[{kind.upper()}_{number[kind]}]" if surrogates is None else surrogates.replace(value, kind)
        out += [text[at:a], to[kind, value]]
        at = b
    return "".join([*out, text[at:]])


def _with_learned(df: DataFrame, id_col: str, fields: list[str], learned: DataFrame | None, most_words: int) -> tuple[DataFrame, frozenset[str] | None]:
    """(rows of id, the fields and ``given``, all learned words or None): how the learned given names reach the texts.

    Up to ``most_words`` words travel with the tasks. More stay distributed: the words of the texts meet them in a join,
    and every row gets those of its own words that were learned in ``given``.
    """
    source = df.select(F.col(f"`{id_col}`").alias("id"), *[F.col(f"`{f}`").alias(f"f{i}") for i, f in enumerate(fields)])
    none = F.lit(None).cast("array<string>").alias("given")
    if learned is None:
        return source.select("*", none), frozenset()
    few = learned.select("word").distinct().limit(most_words + 1).collect()
    if len(few) <= most_words:
        return source.select("*", none), frozenset(r.word for r in few)
    numbered = checkpointed(source.withColumn("_n", F.monotonically_increasing_id()))  # the numbers must outlive a lost executor
    words = F.array_distinct(F.transform(F.regexp_extract_all(F.concat_ws(" ", *[f"f{i}" for i in range(len(fields))]), F.lit(r"(\p{L}+)"), 1), F.lower))
    met = numbered.select("_n", F.explode(words).alias("word")).join(learned.select("word").distinct(), "word").groupBy("_n").agg(F.collect_list("word").alias("given"))
    return numbered.join(met, "_n", "left").drop("_n"), None


def personal_data(df: DataFrame, id_col: str, fields: list[str], learned: DataFrame | None = None, most_words: int = 200_000) -> DataFrame:
    """(id, field, kind, value): every distinct piece of personal data of a field; one pass, no shuffle.

    ``learned`` (word) holds given names beside those of the prior.
    """
    source, shared = _with_learned(df, id_col, fields, learned, most_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, where, kinds, values = [], [], [], []
            given = None if shared is not None else [frozenset(x or ()) for x in batch.column(1 + len(fields)).to_pylist()]
            for i, field in enumerate(fields):
                for row, text in enumerate(batch.column(1 + i).to_pylist()):
                    if text:
                        for kind, value in dict.fromkeys((kind, text[a:b]) for a, b, kind in find_personal(text, given[row] if given else shared or frozenset())):
                            at.append(row)
                            where.append(field)
                            kinds.append(kind)
                            values.append(value)
            if at:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(where), pa.array(kinds), pa.array(values)], names=["id", "field", "kind", "value"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, field string, kind string, value string").withColumnRenamed("id", id_col)


def without_personal_data(df: DataFrame, id_col: str, fields: list[str], key: str | None = None, learned: DataFrame | None = None, most_words: int = 200_000) -> DataFrame:
    """(id, the fields with personal data replaced): by placeholders, or by surrogates of ``key``."""
    source, shared = _with_learned(df, id_col, fields, learned, most_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = None if key is None else Surrogates(key.encode())
        for batch in batches:
            given = None if shared is not None else [frozenset(x or ()) for x in batch.column(1 + len(fields)).to_pylist()]
            columns = [
                pa.array([x and replace_personal(x, surrogates, given[row] if given else shared or frozenset()) for row, x in enumerate(batch.column(1 + i).to_pylist())], pa.string())
                for i in range(len(fields))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", *[f"f{i}" for i in range(len(fields))]])

    schema = ", ".join([f"id {source.schema['id'].dataType.simpleString()}", *[f"f{i} string" for i in range(len(fields))]])
    return source.mapInArrow(run, schema).toDF(id_col, *fields)
