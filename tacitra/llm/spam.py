"""Keyword-stuffed pages, link lists and tag lists.

Each text is a sequence of words. Its suffix automaton, built over words (a repeated keyword begins and ends with one),
gives at every place the longest substring that occurs at least three times; the characters of the words under such
maximal repeats are the page's repeated coverage. A second measure from the same automaton is the share of the page that
one repeated phrase of content words takes. Coverage alone does not make spam (minutes and manuals repeat themselves
too), so it counts only in units without clause structure: a unit is a line or sentence, and it has clause structure if
it ends like a sentence, has a sentence's length and holds function words or few repetitions. A phrase of three words or
more that takes a third of the page counts wherever it stands, in sentences too. Words of links, captions of links,
hashtags and lists of product tags count by themselves; lines that open with a time (log entries), mail headers and
addresses never count.

The automaton is built only for pages that can be spam: what each unit could count at most follows from its words alone,
and a page whose units together stay below the limit is none, whatever the automaton would say (``may_be_spam``).

Defined results
* a page is spam if more than half of its words are counted so; null, empty, blank and wordless texts are not;
* every word of a text of any length is counted; repeated rows are judged on their own; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words of the languages of the corpus.
FUNCTION_WORDS = frozenset(
    """a an the of to and or is are was were be been has have had in on at by for from with that this it its as not no if than
    would could can will shall should may might must do does did you i we they he she my your our their there which who what
    when how but so because since while about into any nobody anyone yet still let me us
    der die das den dem des ein eine einen einem einer und oder ist sind war wurde wird hat haben im in am an auf bei von vom
    zu zum zur mit für über trotz wegen ohne nicht noch sie wir ich es aus nach vor dass als auch
    le la les l un une des du de d et ou est sont a ont été au aux en dans sur sous pour par avec sans que qui ne pas nous vous
    il elle ce cette son sa ses notre votre malgré avant après côté
    el los las una uno del y o es son fue ha han con sin por para que no se su al en lo nuestra nuestro cada según será
    os um uma do da dos das no na nos nas e foi com sem por para que não ao à até sobre entre nossa nosso será mais
    и в на не что с по из до за от для без к у о это как был была были мы вы он она они""".split()
)
_WORD = re.compile(r"\w+")
_LINK = re.compile(
    r"<a\b[^>]*>.*?</a>|\[url[=\]].*?\[/url\]|\[[^\]\n]*\]\((?:https?://|www\.)[^)\s]*\)|(?:https?://|ftp://|www\.)[^\s<>\"\]]+|<a\b[^>]*>|(?<![\w&])#\w+",
    re.IGNORECASE | re.DOTALL,
)
_BREAK = re.compile(r"[\s;](?:(?<=[.!?]\s)\s*|(?<=\n)\n*|(?<=;)\s|(?<=\s)[|•·/»]\s)")  # begins with a set, which the engine looks for first
_LOGGED = re.compile(r"\s*(?:[\[(]?(?:\d{4}-\d\d-\d\d|\d{1,2}/\d{1,2}/\d{2,4}|\d{1,2}:\d\d)|(?:Subject|From|To|Cc|Sent|Date):\s|[\w.'+-]+@[\w.-]+\s*$)")
_PRODUCT = re.compile(r"\s*[#*•-]?\s*[A-Z]{2,5}[-_]?\d+\b(?![^\n]*[.?!]\s*$)")
_IS_FUNCTION = FUNCTION_WORDS.__contains__
_ENDS = (".", "?", "!", ":", ";", '"', ")")
_LEAST_TIMES, _LEAST_SHARE = 4, 0.05  # how often a phrase of two content words must stand, and the share of the page it must take


def repeats(words: list[int], leasts: tuple[int, ...] = (2, 3)) -> list[list[int]]:
    """For each of ``leasts``: at each place the length of the longest substring ending there that occurs so often.

    A suffix automaton over the words; occurrences are summed along suffix links from the longest states down.
    """
    link, length, follow, count = [-1], [0], [{}], [0]
    last, prefix = 0, []
    for w in words:
        cur = len(link)
        link.append(0)
        length.append(length[last] + 1)
        follow.append({})
        count.append(1)
        p = last
        while p >= 0 and w not in follow[p]:
            follow[p][w] = cur
            p = link[p]
        if p >= 0:
            q = follow[p][w]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(link)
                link.append(link[q])
                length.append(length[p] + 1)
                follow.append(follow[q].copy())
                count.append(0)
                while p >= 0 and follow[p].get(w) == q:
                    follow[p][w] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
        prefix.append(cur)
    order = sorted(range(1, len(link)), key=length.__getitem__)
    for state in reversed(order):
        count[link[state]] += count[state]
    out = []
    for least in leasts:
        size = [0] * len(link)  # of each state, the length of the first one on its way to the root that occurs so often
        for state in order:
            size[state] = length[state] if count[state] >= least else size[link[state]]
        out.append([size[s] for s in prefix])
    return out


def may_be_spam(text: str, share: float) -> bool:
    """False only where the words counted by ``spam_words`` cannot be more than ``share`` of all: an upper bound without an automaton."""
    low = text.lower()
    if len(low) != len(text) or "://" in low or "www." in low or "#" in low or "<a" in low or "[url" in low or "](" in low:
        return True
    raws = _BREAK.split(low)
    units = list(map(_WORD.findall, raws))
    words = list(chain.from_iterable(units))
    n = len(words)
    least = max(_LEAST_TIMES, _LEAST_SHARE / 2 * n)
    often = {w for w, c in Counter(words).items() if c >= least and w not in FUNCTION_WORDS}
    if often and any(c >= least for c in Counter((a, b) for a, b in zip(words, words[1:]) if a in often and b in often).values()):
        return True  # a phrase that could count within sentences
    limit, most = share * n, 0
    for raw, unit in zip(raws, units):
        size = len(unit)
        if size:
            functional = sum(map(_IS_FUNCTION, unit))
            if functional < 0.45 * size and (not functional and 2 <= size <= 12 or not _clause(raw, unit, functional)):
                most += size
                if most > limit:
                    return True
    return False


def _clause(raw: str, words: list[str], functional: int) -> bool:
    size = len(words)
    return 4 <= size <= 60 and (size >= 6 or functional >= 0.15 * size) and raw.rstrip()[-1:] in _ENDS and len(set(words)) >= 0.6 * size


def _under(sizes: list[int], least_words: int = 2) -> list[bool]:
    """Which places lie under a repeat of ``least_words`` words or more."""
    out = [False] * len(sizes)
    reach = len(sizes)
    for j in range(len(sizes) - 1, -1, -1):
        if sizes[j] >= least_words:
            reach = min(reach, j - sizes[j] + 1)
        out[j] = j >= reach
    return out


def spam_words(text: str) -> tuple[int, int]:
    """(words that are repeated keywords, links with captions or tags; all words)."""
    marks = [(m.start(), m.end()) for m in _LINK.finditer(text)]
    spans = [(m.start(), m.end(), m[0].lower()) for m in _WORD.finditer(text)]
    n = len(spans)
    if not n:
        return 0, 0
    spam = [False] * n
    k = 0
    for i, (a, b, _) in enumerate(spans):
        while k < len(marks) and marks[k][1] <= a:
            k += 1
        if k < len(marks) and marks[k][0] <= a:
            spam[i] = True
    linked = spam[:]
    plain = [i for i in range(n) if not linked[i]]
    code: dict[str, int] = {}
    sizes = repeats([code.setdefault(spans[i][2], len(code)) for i in plain])
    twice, thrice = (_under(x) for x in sizes)
    covered, touched = [False] * n, [False] * n
    for j, i in enumerate(plain):
        covered[i], touched[i] = thrice[j], twice[j]
    # phrases of content words that take a large share of the page
    function = FUNCTION_WORDS
    content = [w.isalpha() and w not in function and len(w) > 2 for _, _, w in spans]
    pairs: dict[tuple[str, str], int] = {}
    for x, y in zip(plain, plain[1:]):
        if content[x] and content[y] and covered[x] and covered[y]:
            key = spans[x][2], spans[y][2]
            pairs[key] = pairs.get(key, 0) + 1
    m = len(plain)
    dense_pairs = {p for p, c in pairs.items() if c >= _LEAST_TIMES and 2 * c >= _LEAST_SHARE * m}
    dense = [False] * n
    if dense_pairs:
        for x, y in zip(plain, plain[1:]):
            if (spans[x][2], spans[y][2]) in dense_pairs:
                dense[x] = dense[y] = True
        # a phrase of three words or more around a pair that alone takes a fifth of the page, if it takes a third of it
        phrase = _under(sizes[1], 3)
        long = [i for j, i in enumerate(plain) if phrase[j]]
        most = max(pairs[p] for p in dense_pairs)
        if most >= 6 and 2 * most >= 0.2 * m and 3 * sum(spans[i][1] - spans[i][0] for i in long) >= sum(spans[i][1] - spans[i][0] for i in plain) and 3 * sum(dense[i] for i in long) >= len(long):
            for i in long:
                spam[i] = True
    # units
    ends = [m_.end() for m_ in _BREAK.finditer(text)] + [len(text)]
    i, start, caption_of, logged = 0, 0, None, False
    products: list[int] = []
    product_lines = 0
    for end in ends:
        unit = []
        while i < n and spans[i][0] < end:
            unit.append(i)
            i += 1
        raw, before = text[start:end], text[max(0, start - 2) : start].strip(" ")[-1:]
        start = end
        logged = bool(_LOGGED.match(raw)) if before in ("", "\n") else logged
        free = [u for u in unit if not linked[u]]
        links = len(unit) - len(free)
        size = len(free)
        words = [spans[u][2] for u in free]
        functional = sum(map(_IS_FUNCTION, words))
        ended = raw.rstrip()[-1:] in _ENDS
        clause = _clause(raw, words, functional)
        if links and size and (size <= 3 or not clause and functional < 0.2 * size):
            for u in free:
                spam[u] = True
        if links and not size and caption_of:  # a bare link under its caption
            for u in caption_of:
                spam[u] = True
        caption_of = free if free and not links and size <= 8 and functional < 0.34 * size and not ended else None
        if before in ("", "\n", ";", "|", "•", "·", "/", "»") and 2 <= size <= 12 and not functional and _PRODUCT.match(raw):
            products += free
            product_lines += 1
        elif size and not links or size > 3:
            thick = sum(dense[u] for u in free)
            if clause and size >= 6 and functional >= 0.2 * size:  # a sentence, unless it repeats a phrase within itself
                inner = [p for p in zip(words, words[1:]) if p in dense_pairs]
                thick *= len(inner) > len(set(inner))
            bare = functional < 0.1 * size and size >= 12  # no clause at all: two occurrences are enough
            under = touched if bare else covered
            shown = sum(spans[u][1] - spans[u][0] for u in free if under[u]) / sum(spans[u][1] - spans[u][0] for u in free)  # in characters
            digits = sum(w[0].isdigit() for w in words)
            if not logged and (thick >= 0.3 * size or not clause and functional < 0.45 * size and shown >= 0.5 and digits < 0.3 * size):
                for u in free:
                    spam[u] = True
    if product_lines >= 4:  # a list of product tags, not one number in passing
        for u in products:
            spam[u] = True
    return sum(spam), n


def spam_pages(df: DataFrame, id_col: str, text_col: str, share: float = 0.5) -> DataFrame:
    """(id, spam_share) of the pages of which more than ``share`` of the words are spam; one pass, no shuffle."""
    source = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, shares = [], []
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                if text and may_be_spam(text, share):
                    bad, n = spam_words(text)
                    if n and bad > share * n:
                        at.append(i)
                        shares.append(bad / n)
            if at:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(shares)], names=["id", "spam_share"])

    return source.mapInArrow(run, f"id {kind}, spam_share double").withColumnRenamed("id", id_col)
