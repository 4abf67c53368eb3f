"""Text that was decoded with the wrong character encoding: found, and restored where the bytes are still there.

Multi-byte damage: the characters of a text are mapped back to the bytes of a legacy encoding, an automaton over the
structure of UTF-8 bytes finds the maximal well-formed spans, and only those spans are decoded, whatever their script: two
letters of one script, or signs of three bytes and more, do not come about by chance; a single character of two bytes must
be one that Latin text holds. Text damaged several times is run through again. Single-byte damage has no byte structure; it shows as letters that no script mixes (see RULES), and
the words that hold them are decoded with the pair of encodings that makes the shape disappear.

Defined results
* null, empty, blank and plain ASCII texts are never affected; the latter are told by their byte length alone;
* U+FFFD and C1 control characters always mark a text as affected; U+FFFD cannot be restored;
* the restored text equals the input where nothing can be decoded; well-formed characters of any script are kept;
* damage of several rounds is undone round by round until nothing decodes;
* a row is restorable if nothing is lost and no damaged shape is left in it (kinds ``lost`` and ``unsolved``);
* repeated rows each give their row; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Order of trial: the more common a wrong decoding, the earlier.
LEGACY = ["cp1252", "mac_roman", "cp437", "cp850", "cp1251"]
_UTF8 = r"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})"
_SPAN = re.compile(_UTF8 + "+")
_C1 = re.compile("[\x80-\x9f]+")
_WIDE = re.compile(r"[^\x00-\x7f]{2,}")
# What is left of a multi-byte character: rules on single bytes must not touch it.
_PARTIAL = re.compile("[\xc2-\xf4](?:[\x80-\xbf‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]{2,}|[\x80-\x9f\xa1-\xbf€‚ƒ„†‡ˆ‰Š‹ŒŽ•˜™š›œžŸ]$)")


def _back(codec: str) -> dict[int, int]:
    table = {}
    for byte in range(128, 256):
        try:
            table[ord(bytes([byte]).decode(codec))] = byte
        except UnicodeDecodeError:
            pass
    if codec in ("cp1252", "cp1251"):  # holes and C1 characters stand for their own byte
        for byte in range(128, 256 if codec == "cp1252" else 160):
            table.setdefault(byte, byte)
    return table


_TABLES = {codec: _back(codec) for codec in LEGACY}
_ABSENT = {codec: re.compile("[^\x00-\x7f" + "".join(re.escape(chr(c)) for c in table) + "]") for codec, table in _TABLES.items()}


# Signs and Latin letters that stand alone in running text: what a span of a single character may decode to.
_SINGLE = re.compile("[\x80-\u017fƒ\u0218-\u021bˆ˜\u1e00-\u1eff\u2000-\u206f€№™]+")
_EAST_ASIAN = frozenset(("CJK", "HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA", "HALFWIDTH", "FULLWIDTH", "IDEOGRAPHIC", "BOPOMOFO"))


@lru_cache(maxsize=1 << 16)
def _script(c: str) -> str:
    """The script of a letter as the Unicode name begins; the scripts that Japanese and Chinese mix count as one."""
    first = unicodedata.name(c, "?").split(" ")[0]
    return "EAST ASIAN" if first in _EAST_ASIAN else first


def _coherent(text: str, before: str, after: str, lone: frozenset[str]) -> bool:
    """Whether a decoded span reads as text of whatever script: byte structure alone can arise by chance in two characters."""
    if _SINGLE.fullmatch(text):
        return not _C1.search(text) or bool(_SPAN.search(text))  # control characters only as bytes of an earlier round
    if any(unicodedata.category(c) in ("Cn", "Co", "Cs") or c < "\xa0" for c in text):
        return False
    letters = [_script(c) for c in text if c.isalpha() and not _SINGLE.match(c)]
    if not letters:  # signs, marks, emoji: three bytes and more do not come about by chance
        return all(_SINGLE.match(c) or c >= "\u0800" for c in text)
    if len(set(letters)) > 1 or letters[0] == "LATIN":
        return False
    if len(letters) > 1 or letters[0] in lone:
        return True
    beside = before[-1:].isalnum() or after[:1].isalnum()
    return not beside and all(c >= "\u0800" for c in text if c.isalpha())


def _decode_spans(run: str, lone: frozenset[str] = frozenset(), before: str = "", after: str = "") -> str | None:
    """``run`` with its well-formed multi-byte spans decoded; None if it holds none. ``lone``: scripts of which single letters count too."""
    best = None
    for codec in LEGACY:
        if codec == "cp1251" and not re.search("[^А-яЁё]", run):
            continue  # plain Cyrillic words also look like bytes
        mapped = _ABSENT[codec].sub("\x00", run).translate(_TABLES[codec])
        if codec == "cp1251" and not _SPAN.fullmatch(mapped):
            continue  # spans among Cyrillic letters are chance
        out, at, won = [], 0, 0
        for span in _SPAN.finditer(mapped):
            text = span[0].encode("latin-1").decode("utf-8")
            if not _coherent(text, run[at : span.start()] or before, run[span.end() :] or after, lone):
                continue
            out += [run[at : span.start()], text]
            at, won = span.end(), won + len(span[0])
        if won and (best is None or won > best[0]):
            best = won, "".join([*out, run[at:]])
    return best and best[1]


_LOWER, _UPPER = "a-zß-öø-ÿ", "A-ZÀ-ÖØ-Þ"
_SYMBOL = "²³´¶·¸¨¹¾½¼÷×±¬¦¤¥¢¡«¯†‡ˆ‰‹„‚›˜"
# Shapes that only single-byte damage leaves, with the (wrong, right) encodings that undo it.
RULES = [
    ("western as Cyrillic", re.compile("[A-Za-z][Ѐ-ӿ]|[Ѐ-ӿ][A-Za-z]|[ЂЈјЅѕ](?=[\\d ])"), [("cp1251", "cp1252")]),
    ("Cyrillic as western", re.compile("[À-ÖØ-öø-ÿ]{3}"), [("cp1252", "cp1251"), ("cp1252", "koi8_r"), ("cp1252", "iso8859_5")]),
    ("one Cyrillic as another", re.compile("[а-яё][А-ЯЁ]|[А-я][═-╬░-▓]|[═-╬░-▓][А-я]"), [("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp866", "cp1251"), ("cp1251", "cp866")]),
    (
        "western as DOS or Mac",
        re.compile(
            f"[{_LOWER}][À-ÖØ-Þ]|[A-Za-z][Ͱ-Ͽ∀-⋿⌀-⏿─-◿ⁿ]|[Ͱ-Ͽ∀-⋿⌀-⏿─-◿ⁿ][A-Za-z]"
            f"|(?<![Ͱ-Ͽ])[ΓΘΣΦΩαδεπστφ](?![Ͱ-Ͽ])|[{_LOWER}]{{2}}[{_SYMBOL}](?=[ ,.;{_LOWER}])|(?<![{_LOWER}])[{_SYMBOL.replace('¡', '').replace('«', '').replace('‚', '').replace('„', '').replace('‹', '').replace('±', '')}][{_LOWER}]"
            f"|[{_LOWER}][{_SYMBOL}][{_LOWER}]|[{_LOWER}]þ|õ(?![es])|Ç(?=[\\d ])|(?<![A-Za-zÀ-ÿ])Ó |(?:j|[aeo]r|st)ß(?![a-z])|O¨"
            "|(?<![─-▟])[░-▓═-╬](?![─-▟])"
        ),
        [("cp850", "cp1252"), ("cp437", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("cp1252", "cp437")],
    ),
]
# Of a text with such a shape, the words that are wholly of the damaged script are decoded too.
_WHOLE = {"Cyrillic as western": re.compile("[\xa8\xaf\xb2-\xff]+"), "one Cyrillic as another": re.compile("[Ѐ-ӿ═-╬░-▓]+")}
_HARD = re.compile("[�\x80-\x9f]")
_TOKEN = re.compile(r"\S+")


def inspect_text(text: str) -> tuple[str, list[str]]:
    """(restored text, kinds of damage); no kinds for undamaged text."""
    kinds: list[str] = []
    restored = text
    while True:  # each round of damage is undone by one turn; every decoded span is shorter, so this ends
        changed, lone = False, frozenset()
        scripts: set[str] = set()

        def undo(m: re.Match) -> str:
            nonlocal changed
            got = _decode_spans(m[0], lone, m.string[max(0, m.start() - 1) : m.start()], m.string[m.end() : m.end() + 1])
            if got is None:
                return m[0]
            changed = True
            scripts.update(_script(c) for c in got if c >= "\u0370" and c.isalpha())
            return got

        restored = _WIDE.sub(undo, restored)
        if not changed:
            break
        lone = frozenset(scripts - {_script(c) for c in text if c >= "\u0370" and c.isalpha()} if scripts else ())
        if lone:  # where words were of another script, single letters are too
            restored = _WIDE.sub(undo, restored)
        kinds.append("multi-byte")
    if _HARD.search(restored):
        kinds.append("lost" if "�" in restored else "control")
        restored = _C1.sub(lambda m: m[0].encode("latin-1").decode("cp1252", "replace") if not re.search("[\x81\x8d\x8f\x90\x9d]", m[0]) else m[0], restored)
    elif _HARD.search(text):
        kinds.append("control")
    decoded = "multi-byte" in kinds
    for name, shape, pairs in RULES:
        if shape.search(restored):
            kinds.append(name)
            pair = _fitting(restored, _WHOLE[name], pairs) if name in _WHOLE else None
            # what multi-byte decoding has made, or left of a multi-byte character, is no matter of single bytes
            if pair:
                restored = _WHOLE[name].sub(lambda m: m[0] if decoded and m[0] not in text else _turn(m[0], *pair), restored)
            else:
                restored = _TOKEN.sub(lambda m: m[0] if decoded and m[0] not in text else _redecode(m[0], shape, pairs), restored)
    if any(shape.search(restored) for name, shape, _ in RULES if name in kinds):
        kinds.append("unsolved")
    return restored, list(dict.fromkeys(kinds))


def _turn(word: str, wrong: str, right: str) -> str:
    try:
        return word.encode(wrong).decode(right)
    except UnicodeError:
        return word


def _fitting(text: str, whole: re.Pattern, pairs: list[tuple[str, str]]) -> tuple[str, str] | None:
    """The pair of encodings that leaves the fewest damaged shapes in the words of the damaged script."""
    words = whole.findall(text)
    left = {p: sum(any(rule.search(_turn(w, *p)) for _, rule, _ in RULES) for w in words) for p in pairs}
    # unusual signs against the letters that Russian uses most
    odd = {p: sum((c.isupper() or not c.isalnum()) - (c in "оеаинтср") for w in words for c in _turn(w, *p)) for p in pairs}
    best = min(pairs, key=lambda p: (left[p], odd[p]))
    return best if left[best] < max(len(words), 1) else None


def _redecode(token: str, shape: re.Pattern, pairs: list[tuple[str, str]]) -> str:
    """The token in the first pair of encodings that leaves no such shape; unchanged if none does."""
    if token.isascii() or not shape.search(token + " ") or _PARTIAL.search(token):
        return token
    for wrong, right in pairs:
        try:
            got = token.encode(wrong).decode(right)
        except UnicodeError:
            continue
        if not any(rule.search(got + " ") for _, rule, _ in RULES):
            return got
    return token


def garbled_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, restored, kinds, restorable) of every row whose text was decoded with the wrong encoding; no shuffle."""
    source = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where(F.octet_length("text") > F.char_length("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            wide = pc.indices_nonzero(pc.fill_null(pc.not_equal(pc.binary_length(column), pc.cast(pc.utf8_length(column), pc.binary_length(column).type)), False)).to_pylist()
            at, texts, found = [], [], []
            for i in wide:
                restored, kinds = inspect_text(column[i].as_py())
                if kinds:
                    at.append(i)
                    texts.append(restored)
                    found.append(kinds)
            if at:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(texts, pa.string()), pa.array(found, pa.list_(pa.string())), pa.array(["lost" not in k and "unsolved" not in k for k in found])], names=["id", "restored", "kinds", "restorable"])

    return source.mapInArrow(run, f"id {kind}, restored string, kinds array<string>, restorable boolean").withColumnRenamed("id", id_col)
