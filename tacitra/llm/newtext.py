"""Each mail reduced to the text its sender newly wrote.

Every line gets one of the labels new, quoted, signature or notice from a linear-chain sequence model with fitted weights.
A line is described by

* its cue: what its prefix and wording look like (quote prefix, header, attribution, closing phrase, name, contact line,
  rule, device line, legal wording, title, sentence);
* its shape: first character, last punctuation mark, length, number of words, of words in small letters, of digits, indent;
* its neighbours: their cues and how the line above ends, blank lines above and below;
* its position: from the start and the end of the mail, and how many sentences still follow.

The weights of these features under each label, and of each pair of labels on neighbouring lines, were fitted by
``newtext_fit.py`` on a bounded sample of mails; Viterbi decoding takes the best labelling. In training cues that rest on
word lists were hidden at random, so shape, neighbours and position carry lines whose wording no list knows. History
without prefix runs from the line that opens it to the end of the mail; history with a prefix ends with the prefix, so
answers between quoted lines stay new.

Defined results
* null, empty and blank bodies have no lines that are not new; blank lines are never listed;
* lines are split at \\n, counted from 1; a carriage return belongs to the line's end;
* lines and bodies of any length are read whole; repeated rows each give their rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEW, QUOTED, SIGNATURE, NOTICE = range(4)
_FLAGS = re.IGNORECASE

_PREFIX = re.compile(r"\s*(?:[>|]|:(?= |$))")
_OPENER = re.compile(
    r"\s*(?:-{2,}\s*(?:Original|Forwarded|Urspr\S+|Mensaje|Message)\b.*|-{2,} ?(?:Original Message|Message from .+|Forwarded (?:by|message).*)|Begin forwarded message:?|-{5,} Forwarded by .*)\s*$", _FLAGS
)
_HEADER = re.compile(r"\s*(?:From|To|Cc|Bcc|Sent|Date|Subject|Von|An|Gesendet|Betreff|De|Para|Objet|Envoy\S{1,4}|Asunto)\s*:(?:\s|$)", _FLAGS)
_FROM = re.compile(r"\s*(?:From|Von|De)\s*:\s+\S", _FLAGS)
_AFTER_FROM = re.compile(r"\s*(?:Sent|Date|To|Cc|Gesendet|An|Para|Subject|Envoy\S{1,4})\s*:", _FLAGS)
_NOTES_NAME = re.compile(r"\s*[^\d@<>,;:]{3,}@[A-Z]{2,}\s*$")
_STAMP = re.compile(r"\s*\d{1,2}/\d{1,2}/\d{2,4} +\d{1,2}:\d\d")
_ATTRIBUTION = re.compile(
    r"\s*(?:(?:On|At|Le|Am|El|Il|Em)\s(?=.*\d).{6,}\b(?:wrote|writes|schrieb\b.*|a .{1,8}crit|escribi\S+|ha scritto|escreveu)\s*:"
    r"|In a message dated .+ writes:|.{2,} wrote on .{6,}:|-{2,3} .{2,} wrote:|[^.!?]*<[^<>\s]+@[^<>\s]+>[^<>.!?]*:|Am \d.*\bschrieb .*:|Le \d.*:)\s*$",
    _FLAGS,
)
_LEADS = re.compile(r"\d[/.:-]\d|\b(?:19|20)\d\d\b|@\S+\.|\b(?:wrote|writes|said)\b")
_ATTRIBUTION_START = re.compile(r"\s*(?:On|At|Le|Am|In a message dated)\b.*\d{1,4}.*", _FLAGS)
_ATTRIBUTION_END = re.compile(r".*(?:wrote|writes|crit ?|schrieb.*)\s*:\s*$", _FLAGS)
_RULE = re.compile(r"\s*(?:([-_*=~#+])\1+|(?:[-_*=~#+] ?){4,})\s*$")
_CLOSING = re.compile(
    r"\s*(?i:(?:(?:kind|best|warm|with|many)\s+)?regards|(?:many |with )?thanks(?: again| in advance)?|thank you|thx|cheers|sincerely|(?:yours|best|respectfully)(?: truly| sincerely| faithfully)?|all the best|take care|saludos(?: cordiales)?|cordialement|(?:mit )?(?:freundlichen|besten|viele) gr\S{1,6}en?|mfg|gru\S{1,3}|atentamente|atenciosamente|abra\S{1,3}os?|rgds|ciao)"
    r"\s*[,.!-]*\s*(?:(?:[A-ZÀ-Þ][\w.'’´`-]*|[^\x00-\x7f][^\s]*)[ ,.]*){0,7}\s*$"
)
_DEVICE = re.compile(r"\s*(?:-{1,3}\s*)?(?:sent|get|gesendet|envoy\S{1,4}|enviado)\s+(?:from|via|by|using|von|depuis|desde)\b(?=.*\b(?:my|mail|pager|phone|i?phone|handheld|wireless|mobile|device|blackberry|tablet|outlook|mein\w*|mon|mi)\b)[^.,]{3,}$", _FLAGS)
_NOTICE = re.compile(
    r"\W*(?:notice:|confidential(?:ity notice)?:|disclaimer:|legal notice|this (?:e-?mail|message|mail|communication|transmission)\b|the (?:content|information)s? (?:of|in|contained)\b|information in this\b|diese (?:nachricht|e-?mail)|ce (?:message|courriel)|este (?:mensaje|correo)|esta mensagem|if you (?:are not|have received|received)|please destroy all copies|any (?:copying|use|review)|unauthori[sz]ed)",
    _FLAGS,
)
_LEGAL = re.compile(
    r"confidential|privileged|intended|recipient|addressee|disclosure|solely|opinions|liabilit|viruses|destroy|by mistake|in error|delete|unauthori[sz]ed|not allowed|forbidden|contract is formed|property of|vertraulich|empf|confidentiel|confidencial|destinat|erreur|supprim|por error|eliminar|irrt",
    _FLAGS,
)
_NAME = re.compile(r"\s*(?:[A-ZÀ-Þ][^\W\d_]*[.'’´`-]?[^\W\d_]*\.?)(?:[ ,]+(?:[A-ZÀ-ÞÃÂ][^\s\d:;!?]*\.?|[a-z]{1,3}\b(?= [A-Z]))){0,4}\s*$")
_CODED = re.compile(r"\s*[^\s,;:!?][^,;:!?]+(?:/[A-Z]{2,}){1,4}(?:@[A-Z]+)?\s*$")
_INITIALS = re.compile(r"\s*(?:[A-ZÀ-Þ]\.? ?){2,4}$|\s*[a-z]{2,3}$")
_NOT_INITIALS = frozenset("FYI OK ASAP TBD PS EOM HR IT ok no yes yep nil thx tks so".split())
_THANKS_FOR = re.compile(r"(?:many )?(?:thanks|thank you|thx) for \w", _FLAGS)
_CONTACT = re.compile(
    r"\s*(?:(?:phone|tel|telephone|cell|direct|office|fax|mobile|ph|t|e-?mail|web)\b[.:]*\s*.*|[\w.'’+-]+@[\w.-]+|(?:\+|\(|\d)[\d ()./+-]{5,}(?:\s*(?:x|ext\.?)\s*\d+)?(?:\s*\|.*)?)\s*$", _FLAGS
)
_STARRED = re.compile(r"\s*[^*]{3,}\*[^*]{2,}\*.*$")
_ADDRESS = re.compile(r"\s*(?:[^.?!]*,\s*)?(?:(?:P\.? ?O\.? )?Box \d+|(?:Flat|Suite|Apt\.?|Unit) \S+|\d+ [A-ZÀ-Þ]).*$")
_WORDS = re.compile(r"[^\s,;:()\"]+")
_PARTICLES = frozenset("of the and for von van de der den to la el ext".split())

# Cues of a line. Those of the second list rest on word lists.
CUES = ["history", "prefixed", "indented", "attribution", "closing", "name", "initials", "contact", "starred", "rule", "device", "notice", "legal", "titled", "answer", "sentence"]
MARKED = frozenset(("history", "prefixed", "indented", "attribution", "notice", "legal"))  # told by their marks, wherever they stand
WORDED = frozenset(("attribution", "closing", "contact", "device", "notice", "legal"))


def _inside_sentence(body: list[str], i: int) -> bool:
    """Whether a sign at a line's head only happens to stand there: a lone line that goes on with the one before it."""
    above, below = body[i - 1] if i else "", body[i + 1] if i + 1 < len(body) else ""
    return bool(above) and above[0] not in ">|:" and above[-1].isalnum() and below[:1] not in (">", "|")


def _cues(lines: list[str], body: list[str]) -> tuple[list[str], list[int]]:
    """(cue, number of words in small letters) of every line; ``lines`` are all lines, ``body`` the same without white space at the ends."""
    n = len(lines)
    out, plain = [""] * n, [0] * n
    after = [n] * (n + 1)  # the next line that is not blank
    for i in range(n - 1, -1, -1):
        after[i] = i if body[i] else after[i + 1]
    quoting = 0  # 2 behind an attribution or its indented text, whose quoted text is indented
    for i in range(n):
        t = body[i]
        if not t:
            continue
        line = lines[i]
        first = t[0]
        if first in ">|" and _inside_sentence(body, i):
            out[i], plain[i] = "sentence", 9
            continue
        if first in ">|" or first == ":" and (len(t) == 1 or t[1] == " "):
            out[i], quoting = "prefixed", 0
            continue
        low = t[-1] == ":"
        follows = after[i + 1]
        nxt = body[follows] if follows < n else ""
        if low and _ATTRIBUTION.match(t):
            out[i], quoting = "attribution", 2
            if "@" in t and not _quotes_below(lines, body, follows):  # what it introduces has no sign of its own
                return _close(out, body, i), plain
            continue
        if low and follows < n and body[follows][0] in ">|" and _LEADS.search(t):  # any line with a date, time or address that introduces quoted text
            out[i], quoting = "attribution", 2
            continue
        if quoting and line[0] in " \t" and (line[0] == "\t" or line.startswith("  ")):
            out[i], quoting = "indented", 2
            continue
        if quoting and not (i and out[i - 1] == "attribution"):
            quoting = 0
        if not low and nxt.endswith(":") and i + 1 < n and body[i + 1] and _ATTRIBUTION_START.match(t) and _ATTRIBUTION_END.match(nxt) and _ATTRIBUTION.match(f"{t} {nxt}"):
            out[i] = "attribution"
            continue
        if low and i and out[i - 1] == "attribution" and _ATTRIBUTION_END.match(t):
            out[i], quoting = "attribution", 2
            continue
        opens = False
        if first == "-" or first in "Bb":
            opens = bool(_OPENER.match(t)) or first == "-" and "orwarded by" in t
        if not opens and first in "FVD" and _FROM.match(t) and _AFTER_FROM.match(nxt):
            opens = True
        if not opens and first == "F" and re.match(r"From: .+ on \d{1,2}/\d{1,2}/\d{2,4} ", t):
            opens = True
        if not opens and _RULE.match(t) and _FROM.match(nxt):
            later = after[follows + 1] if follows < n else n
            opens = later < n and bool(_AFTER_FROM.match(body[later]))
        if not opens and "@" in t and _NOTES_NAME.match(t) and _STAMP.match(nxt):
            opens = True
        if opens:
            return _close(out, body, i), plain
        lower = _plain_words(t)
        plain[i] = len(lower)
        if _RULE.match(t):
            out[i] = "rule"
        elif i and out[i - 1] in ("notice", "legal"):  # the paragraph that a notice opens
            out[i] = "legal"
        elif t in _NOT_INITIALS or _THANKS_FOR.match(t):
            out[i] = "answer"
        elif _CLOSING.match(t):
            out[i] = "closing"
        elif (first.isupper() or not first.isalnum()) and _NOTICE.match(t) and len({x.lower() for x in _LEGAL.findall(_paragraph(body, i))}) >= 2:
            out[i] = "notice"
        elif _DEVICE.match(t):
            out[i] = "device"
        elif len(lower) <= 2 and _STARRED.match(t):
            out[i] = "starred"
        elif len(lower) <= 3 and not t.endswith(("?", "!")) and _CONTACT.match(t):
            out[i] = "contact"
        elif _INITIALS.match(t):
            out[i] = "initials"
        elif not lower and (_NAME.match(t) and t[-1] != "." or _CODED.match(t)):
            out[i] = "name"
        elif not lower and t[-1] not in "?!:,-;.…" and not _cyrillic(t) or len(lower) <= 1 and t[-1] not in "?!:" and _ADDRESS.match(t):
            out[i] = "titled"
        else:
            out[i] = "sentence"
    return out, plain


def _close(out: list[str], body: list[str], at: int) -> list[str]:
    """All lines from ``at`` on are history."""
    for i in range(at, len(body)):
        if body[i]:
            out[i] = "history"
    return out


def _quotes_below(lines: list[str], body: list[str], at: int) -> bool:
    """Whether the line at ``at`` is prefixed or indented, or there is none."""
    return at >= len(body) or body[at][0] in ">|:" or lines[at][0] == "\t" or lines[at].startswith("  ")


def _paragraph(body: list[str], at: int) -> str:
    end = at
    while end < len(body) and body[end]:
        end += 1
    return " ".join(body[at:end])


def _plain_words(t: str) -> list[str]:
    """Words of running text: with a small first letter, or beginning outside ASCII without a capital (also garbled)."""
    return [w for w in _WORDS.findall(t) if (w[0].islower() or w[0] > "\x7f" and not w[0].isupper()) and len(w) > 1 and w.strip(".") not in _PARTICLES and "@" not in w]


def _cyrillic(t: str) -> bool:
    return any("\u0400" <= c <= "\u04ff" for c in t)


# -- features ----------------------------------------------------------------------------------------------------------


def _bucket(n: int, steps: tuple[int, ...]) -> int:
    for i, most in enumerate(steps):
        if n <= most:
            return i
    return len(steps)


def _shape(line: str, t: str, plain: int) -> tuple:
    """First character, last mark, sizes and signs of one line."""
    first, last = t[0], t[-1]
    kind = "u" if first.isupper() else "l" if first.islower() else "d" if first.isdigit() else first if first in ">|:-*" else "o"
    end = last if last in ".?!,:;-" else "a" if last.isalnum() else "o"
    indent = 2 if line[0] == "\t" or line.startswith("    ") else int(line[0] == " ")
    digits = sum(map(str.isdigit, t)) if len(t) <= 200 else 9
    return kind, end, _bucket(len(t), (3, 12, 25, 45, 70)), _bucket(t.count(" ") + 1, (1, 2, 3, 5, 9)), _bucket(plain, (0, 1, 3)), indent, _bucket(digits, (0, 4)), "@" in t, t.isupper()


def own_features(cue: str, shape: tuple) -> list[str]:
    kind, end, size, words, plain, indent, digits, at, upper = shape
    if cue in MARKED:
        return [f"c={cue}"]
    return [
        f"c={cue}", f"c={cue} end={end}", f"c={cue} size={size}", f"c={cue} words={words}", f"c={cue} plain={plain}", f"c={cue} first={kind}", f"end={end} words={words}",
        f"end={end} digits={digits} at={at}", f"indent={indent}", f"upper={upper} size={size}",
    ]


def neighbour_features(cue: str, above: str, below: str, above_end: str, end: str, words: int, gap_above: bool, gap_below: bool) -> list[str]:
    if cue in MARKED:
        return [f"c={cue} above={above}"]
    return [
        f"c={cue} above={above}", f"c={cue} below={below}", f"c={cue} above-end={above_end} gap={gap_above}", f"below={below} end={end} words={words}", f"below={below} gap={gap_below} c={cue}",
    ]


def place_features(cue: str, start: int, end: int, left: int, words: int) -> list[str]:
    if cue in MARKED:
        return []
    return [f"c={cue} start={start}", f"c={cue} to-end={end}", f"c={cue} left={left}", f"left={left} words={words}", f"start={start} words={words}"]


def line_features(rows: list[int], lines: list[str], body: list[str], cues: list[str], plain: list[int]) -> Iterator[tuple[tuple, tuple, tuple]]:
    """For each row the arguments of the three feature functions; ``cues`` and ``plain`` run along ``rows``."""
    n = len(rows)
    shapes = [_shape(lines[i], body[i], plain[k]) if cues[k] != "history" else _HISTORY_SHAPE for k, i in enumerate(rows)]
    left = [0] * n
    seen = 0
    for k in range(n - 1, -1, -1):
        left[k] = min(seen, 3)
        if cues[k] == "sentence":
            seen += 1
        elif cues[k] == "history":
            seen = 0
    open_from = next((k for k, c in enumerate(cues) if c == "history"), n)
    for k, i in enumerate(rows):
        cue, shape = cues[k], shapes[k]
        above, above_end = (cues[k - 1], shapes[k - 1][1]) if k else ("start", "")
        below = cues[k + 1] if k + 1 < n else "end"
        gap_above, gap_below = k > 0 and rows[k - 1] != i - 1, k + 1 < n and rows[k + 1] != i + 1
        yield (cue, shape), (cue, above, below, above_end, shape[1], shape[3], gap_above, gap_below), (cue, min(k, 3), _bucket(open_from - 1 - k, (0, 1, 2, 5, 9)), left[k], shape[3])


_HISTORY_SHAPE = ("o", "o", 0, 0, 0, 0, 0, False, False)


# -- model -------------------------------------------------------------------------------------------------------------


class Model:
    """Weights of features under (new, quoted, signature, notice), of a first label and of neighbouring labels."""

    def __init__(self, weights: dict[str, list[float]], start: list[float], steps: list[list[float]]):
        self.weights, self.start, self.steps = weights, start, steps
        self._known: tuple[dict, dict, dict] = ({}, {}, {})

    def emissions(self, parts: tuple[tuple, tuple, tuple]) -> tuple[float, float, float, float]:
        total = [0.0, 0.0, 0.0, 0.0]
        for known, part, features in zip(self._known, parts, (own_features, neighbour_features, place_features)):
            score = known.get(part)
            if score is None:
                rows = [self.weights[f] for f in features(*part) if f in self.weights]
                score = tuple(sum(r[s] for r in rows) for s in range(4))
                if len(known) > 200_000:
                    known.clear()
                known[part] = score
            total[0] += score[0]
            total[1] += score[1]
            total[2] += score[2]
            total[3] += score[3]
        return tuple(total)

    def decode(self, emissions: list[tuple]) -> list[int]:
        """The best labelling (Viterbi); of equal ones the one with smaller labels."""
        steps, back = self.steps, []
        score = [a + b for a, b in zip(self.start, emissions[0])]
        for emit in emissions[1:]:
            came, now = [], []
            for s in range(4):
                best, at = score[0] + steps[0][s], 0
                for p in (1, 2, 3):
                    x = score[p] + steps[p][s]
                    if x > best:
                        best, at = x, p
                came.append(at)
                now.append(best + emit[s])
            back.append(came)
            score = now
        s = max(range(4), key=lambda q: (score[q], -q))
        out = [s]
        for came in reversed(back):
            s = came[s]
            out.append(s)
        return out[::-1]


def load_model(path: str | None = None) -> Model:
    """The fitted model that stands beside this module, or another."""
    with open(path or os.path.join(os.path.dirname(os.path.abspath(__file__)), "newtext_model.json"), encoding="utf-8") as f:
        known = json.load(f)
    return Model(known["weights"], known["start"], known["steps"])


_MODEL: list[Model] = []


def label_lines(text: str, model: Model | None = None) -> list[int]:
    """The label of every line; blank lines get the label NEW."""
    if model is None:
        if not _MODEL:
            _MODEL.append(load_model())
        model = _MODEL[0]
    lines = text.split("\n")
    body = [x.strip() for x in lines]
    rows = [i for i in range(len(lines)) if body[i]]
    labels = [NEW] * len(lines)
    if not rows:
        return labels
    cues, plain = _cues(lines, body)
    found = model.decode([model.emissions(p) for p in line_features(rows, lines, body, [cues[i] for i in rows], [plain[i] for i in rows])])
    for i, s in zip(rows, found):
        labels[i] = s
    return labels


def new_text(text: str | None) -> str | None:
    """Only the sender's own lines, blank lines at the ends removed; null stays null."""
    if text is None:
        return None
    labels = label_lines(text)
    return "\n".join(x for x, s in zip(text.split("\n"), labels) if s == NEW).strip("\n")


def foreign_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, label) of every line that its sender did not newly write; one pass, no shuffle."""
    source = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    names = ["new", "quoted", "signature", "notice"]

    known = load_model()
    weights = known.weights, known.start, known.steps

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*weights)
        for batch in batches:
            at, numbers, found = [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                if text:
                    for i, s in enumerate(label_lines(text, model)):
                        if s:
                            at.append(row)
                            numbers.append(i + 1)
                            found.append(s)
            if at:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(numbers, pa.int32()), pa.DictionaryArray.from_arrays(pa.array(found, pa.int8()), names).cast(pa.string())], names=["id", "line_no", "label"]
                )

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, line_no int, label string").withColumnRenamed("id", id_col)
