"""Addresses of one person or organisation linked through variant spellings of typed names.

An address and each name typed for it (in an export of display names and in senders) are read into views: family name,
given names, middle initial, or, for organisations, the brand and the line of business. Where nothing tells which word of
a name is the family name, both orders are views, and the one whose family name more addresses bear is taken.

Distinct family names are sharded into tries that Levenshtein automata traverse to enumerate all neighbours within a
bounded distance (a swap of neighbouring letters counts as one edit). A pair of neighbours is then checked over the other
words of the names, whichever order they were typed in: a family name is a misspelling of a more frequent one if every
given name that it stands beside stands beside that one too. Addresses that agree on family and given name, and do not
differ in the middle initial, are one entity, and so are the entities that a known alias connects; entities are formed
over distinct profiles, never over pairs of addresses.

Defined results
* addresses are compared in lower case without outer blanks; an address in several rows counts once with all its names;
* null and blank names leave the address to its local part; null, blank and malformed addresses are not linked;
* two profiles with the same given and family name but different middle initials are different; an address without
  middle initial among several such persons is linked to the one of its own domain if that is unique, else to none;
* an initial alone is linked if exactly one given name of that family name begins with it;
* names in senders count only for addresses of the export; aliases may lead over addresses that are none of its keys;
* repeated rows change nothing; extra columns are ignored; an empty table gives no pair.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tacitra.llm.evidence import given_name_evidence, typed_names
from tacitra.llm.names import GIVEN, SHORT, SHORT_ALSO, fold
from tacitra.operators.graph import components
from tacitra.session import checkpointed

# Words of company names, and local parts that no person has.
COMPANY = frozenset(
    """limited ltd inc incorporated company co corporation corp partners ptnrs associates assocs assoc llc plc utilities util gas pipeline pipe pipel energy ener
    power powe storage stor transmission trans transm trading trad risk commodities comm commod marketing mark mkt services serv advisory advis group holdings""".split()
)
LEGAL = frozenset("limited ltd inc incorporated company co corporation corp partners ptnrs associates assocs assoc llc plc".split())
ROLES = frozenset("info desk billing accounts ops notices sales contact office orders trading invoices".split())


# -- trie and automaton ------------------------------------------------------------------------------------------------


class Trie:
    """Words with the automaton of Levenshtein distance (restricted swaps) run along the branches."""

    def __init__(self, words):
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    def within(self, word: str, limit: int) -> list[tuple[str, int]]:
        """All words of the trie within ``limit`` edits: each branch carries one row of the distance table."""
        out: list[tuple[str, int]] = []
        first = list(range(len(word) + 1))
        stack = [(self.root, first, None, "")]
        while stack:
            node, row, above, last = stack.pop()
            for c, child in node.items():
                if c == "":
                    if row[-1] <= limit:
                        out.append((child, row[-1]))
                    continue
                new = [row[0] + 1]
                for i, w in enumerate(word, 1):
                    d = min(new[i - 1] + 1, row[i] + 1, row[i - 1] + (w != c))
                    if above is not None and i > 1 and w == last and word[i - 2] == c:
                        d = min(d, above[i - 2] + 1)
                    new.append(d)
                if min(new) <= limit or min(row) < limit and min(new) <= limit + 1:
                    stack.append((child, new, row, c))
        return out


_GIVEN_TRIE = Trie(GIVEN)


@lru_cache(maxsize=1 << 17)
def given_names(word: str) -> frozenset[str]:
    """The full given names of the prior that a typed one can stand for; the word itself if none."""
    if word in GIVEN or word in SHORT:
        return frozenset(x for x in (word, SHORT.get(word), SHORT_ALSO.get(word)) if x in GIVEN)
    cut = [g for g in GIVEN if g.startswith(word)] if len(word) >= 4 else []
    near = [w for w, _ in _GIVEN_TRIE.within(word, 1)] if len(word) >= 3 else []
    return frozenset((cut if len(cut) == 1 else []) + near) or frozenset((word,))


def _is_given(word: str, learned: frozenset[str] = frozenset()) -> bool:
    return word in learned or bool(given_names(word) & GIVEN.keys())


def near(a: str, b: str, limit: int = 1) -> bool:
    return a == b or abs(len(a) - len(b)) <= limit and (len(a) < 3 or limit > 1 or a[0] == b[0] or a[-1] == b[-1]) and bool(Trie([a]).within(b, limit))


# -- views -------------------------------------------------------------------------------------------------------------


def read_name(name: str | None, learned: frozenset[str] = frozenset()) -> tuple[str, list[str], str] | None:
    """(family name, given name as typed or its initial, middle initial) of a typed person's name."""
    if not name:
        return None
    text = re.sub(r"\([^)]*\)|/.*|<.*|@.*", " ", name).replace('"', " ")
    left, comma, right = text.partition(",")
    words = lambda t: [w for w in re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", fold(t))]
    if comma:
        family, rest = words(left), words(right)
        if not family or not rest:
            return None
        return "".join(family), [rest[0]], next((w for w in rest[1:] if len(w) == 1), "")
    parts = words(text)
    if len(parts) < 2:
        return None
    middle = next((w for w in parts[1:-1] if len(w) == 1), "")
    # token orders: given name first, or last
    if not _is_given(parts[0], learned) and len(parts[0]) > 1 and (_is_given(parts[-1], learned) or len(parts[-1]) == 1):
        return parts[0], [parts[-1]], next((w for w in parts[1:-1] if len(w) == 1), "")
    if len(parts) == 3 and len(parts[2]) == 1 and len(parts[1]) > 1 and not _is_given(parts[0], learned):
        return parts[0], [parts[1]], parts[2]
    return parts[-1], [parts[0]], middle


def read_local(local: str, family: str | None) -> list[tuple[str, str, str]]:
    """(family name, given name or initial, middle initial) in every way the local part of an address can be read."""
    local = re.sub(r"\d+$", "", local.replace("'", "").replace("-", ""))
    if "." in local or "_" in local:
        parts = re.split(r"[._]", local)
        if parts[0] == "" and len(parts) == 2:
            return [(parts[1], "", "")]
        if len(parts) == 3 and parts[1] == "" and len(parts[0]) == 1:
            return [(parts[2], "", parts[0])]
        full = [p for p in parts if len(p) > 1]
        middle = next((p for p in parts if len(p) == 1), "")
        if len(full) == 1:
            return [(full[0], middle, "")]
        if len(full) >= 2:
            a, b = full[0], full[-1]
            given_first = _is_given(a) or not _is_given(b)
            if family and near(a, family) and not near(b, family):
                given_first = False
            return [(b, a, middle)] if given_first else [(a, b, middle)]
        return []
    ways = [(local[1:], local[0], ""), (local[:-1], local[-1], ""), (local[2:], local[0], local[1:2]), (local[:-2], local[-2:-1], local[-1:])]
    ways = [w for w in ways if len(w[0]) >= 4]
    if family:
        exact = [w for w in ways if w[0] == family]
        return exact or [w for w in ways if near(w[0], family)] or []
    return ways


def either_order(name: str, learned: frozenset[str] = frozenset()) -> list[str]:
    """The two words of a name without comma that nothing tells apart, else nothing."""
    text = re.sub(r"\([^)]*\)|/.*|<.*|@.*", " ", name).replace('"', " ")
    words = [w for w in re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", fold(text)) if len(w) > 1]
    return words if "," not in text and len(words) == 2 and not any(_is_given(w, learned) for w in words) else []


def read_address(address: str, names: list[str], learned: frozenset[str] = frozenset()) -> dict | None:
    """The profile of one address: an organisation (brand, line) or a person (families, givens, middle)."""
    local, at, domain = address.partition("@")
    if not at or not local or not domain:
        return None
    label = domain.split(".")[0] if domain.count(".") == 1 else domain.split(".")[-2]
    words = [[w for w in re.findall(r"[a-z]+", re.sub(r"\([^)]*\)", " ", fold(n)))] for n in names]
    role = re.sub(r"\d+$", "", local)
    company = any(len(w) >= 2 and any(x in COMPANY for x in w[1:]) for w in words)
    if company or not any(words) and (role in ROLES or role == re.sub(r"(?:corp|online|inc|co)$", "", label.split("-")[0])) or role in ROLES and not any(read_name(n) for n in names if "," in n):
        brand = re.sub(r"(?:corp|online|inc|co)$", "", label.split("-")[0]) or label
        line = ""
        for w in words:
            rest = [x for x in w if x != "the" and x not in LEGAL]
            first = next((x for x in rest[1:] if x in COMPANY), "")
            line = first if len(first) > len(line) else line
        return {"org": brand, "line": line[:3]}
    views = [v for v in (read_name(n, learned) for n in names) if v]
    families: list[str] = [v[0] for v in views]
    givens = [g for v in views for g in v[1]]
    middle = {v[2] for v in views if v[2]}
    ways = read_local(local, families[0] if families else None)
    for f in families[1:]:
        ways = ways or read_local(local, f)
    sure = len(ways) == 1
    for f, g, m in ways[: None if not families else 1]:
        families.append(f)
        if sure or families:
            if g and sure:
                givens.append(g)
            if m and sure:
                middle.add(m)
    full = [given_names(g) for g in givens if len(g) > 1]
    known = [s for s in full if s & GIVEN.keys()]
    if known:
        common = frozenset.intersection(*known) or known[-1]
        given = sorted(common)
    elif full:
        given = sorted(full[0])
    else:
        given = sorted({g + "*" for g in givens if g})[:1]
    if not families and not any(words):  # no person has such a local part (an acronym)
        return {"org": re.sub(r"(?:corp|online|inc|co)$", "", label.split("-")[0]) or label, "line": ""}
    if not known:  # words that may be either name: each is a family name to be weighed, and a given name if it is not taken as that
        for n in names:
            for w in either_order(n, learned):
                families.append(w)
                given.append(w)
    return {"families": list(dict.fromkeys(families)), "given": list(dict.fromkeys(given)), "middle": min(middle) if len(middle) == 1 else "", "agreed": len(views) > 0 and sure and ways[0][0] == views[0][0]}


# -- entities of one family name ---------------------------------------------------------------------------------------


def resolve(profiles: list[tuple[tuple[str, ...], str]]) -> list[tuple[str, str, bool]]:
    """(given name, middle initial, whether the domain must decide) of each (given names, middle initial) of a family name.

    The given name is '' where none can be told.
    """
    given_of = [set(g) for g, _ in profiles]
    full = {g for s in given_of for g in s if not g.endswith("*")}
    by_initial: dict[str, set[str]] = defaultdict(set)
    for g in full:
        by_initial[g[0]].add(g)
    certain = {next(iter(s)) for s in given_of if len(s) == 1 and not next(iter(s)).endswith("*")}
    beside = Counter((g, m) for s, (_, m) in zip(given_of, profiles) for g in s)  # how many profiles have a given name with a middle initial
    with_middle: dict[str, set[str]] = defaultdict(set)
    for g, m in beside:
        with_middle[m].add(g)
    chosen: list[str] = []
    for s, (_, m) in zip(given_of, profiles):
        options = {g for g in s if not g.endswith("*")}
        if len(options) > 1:
            options = options & certain or options
        if s:
            for g in s:
                if g.endswith("*"):
                    options |= by_initial[g[0]]
            if len(options) > 1 and m:
                options = {g for g in options if beside[g, m] > (g in s)} or options
        else:  # nothing but the family name
            options = full
            if len(full) > 1 and m:
                options = {g for g in with_middle[m] if g in full} or full
        chosen.append(next(iter(options)) if len(options) == 1 else min(s) if len(s) == 1 and min(s).endswith("*") and not options else "")
    middles: dict[str, set[str]] = defaultdict(set)
    for g, (_, m) in zip(chosen, profiles):
        if g and m:
            middles[g].add(m)
    out = []
    for g, (_, m) in zip(chosen, profiles):
        several = bool(g) and not m and len(middles[g]) > 1
        out.append((g, min(middles[g]) if g and not m and len(middles[g]) == 1 else m, several))
    return out


# -- Spark -------------------------------------------------------------------------------------------------------------

_PROFILE = "addr string, domain string, org string, line string, families array<string>, given array<string>, middle string, agreed boolean"


def _profiles(learned: frozenset[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for addr, names, given in zip(pdf.addr, pdf.names, pdf.given):
                p = read_address(addr, sorted(n for n in names if n and n.strip()), learned if given is None else learned | frozenset(given))
                if p is not None:
                    rows.append((addr, addr.partition("@")[2], p.get("org"), p.get("line"), p.get("families", []), p.get("given", []), p.get("middle"), p.get("agreed", False)))
            yield pd.DataFrame(rows, columns=["addr", "domain", "org", "line", "families", "given", "middle", "agreed"])

    return run


def _settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``resolve`` over rows sorted by family; the last family of a batch waits for the next one."""
    held: pd.DataFrame | None = None
    for pdf in _with_end(batches):
        if pdf is None:
            done, held = held, None
        else:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            last = pdf.family == pdf.family.iloc[-1] if len(pdf) else []
            done, held = (pdf[~last], pdf[last]) if len(pdf) else (None, pdf)
        if done is None or not len(done):
            continue
        at: dict[str, list[int]] = defaultdict(list)
        for i, f in enumerate(done.family):
            at[f].append(i)
        given, middle = [tuple(g) for g in done.given], [m or "" for m in done.middle]
        out: list = [None] * len(done)
        for places in at.values():
            for i, got in zip(places, resolve([(given[i], middle[i]) for i in places])):
                out[i] = got
        yield done.assign(g=[x[0] for x in out], m=[x[1] for x in out], several=[x[2] for x in out])


def _with_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _parts(df: DataFrame) -> int:
    """Partitions for Python work on small rows, which would otherwise be gathered into one task for their few bytes."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)


def _shards(word) -> list:
    """Keys of which two words within one edit share at least one: an edit leaves the head or the tail as it is."""
    n = F.length(word)
    keys = [(n >= 6, 3), ((n >= 5) & (n <= 7), 2), (n <= 6, 1)]
    return [F.when(n <= 2, F.lit("short"))] + [F.when(cond, F.concat(F.lit(f"{side}{k}"), F.substring(word, *((1, k) if side == "h" else (-k, k))))) for cond, k in keys for side in "ht"]


def piece_keys(word: str, limit: int, probe: bool) -> set[str]:
    """Keys of which a word and a probe within ``limit`` edits share at least one.

    A word is cut into more pieces than the edits can touch (a swap can touch two); one stands in the probe unchanged,
    moved by ``limit`` places at most. Words too short for that share the key of short words.
    """
    pieces = 2 * limit + 1
    out = {"short"} if len(word) <= pieces + limit else set()
    for n in range(len(word) - limit, len(word) + limit + 1) if probe else (len(word),):
        if n > pieces:
            cuts = [n * i // pieces for i in range(pieces + 1)]
            for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                for move in range(-limit, limit + 1) if probe else (0,):
                    if a + move >= 0 and b + move <= len(word):
                        out.add(f"{n}.{i}.{word[a + move : b + move]}")
    return out


def near_words(words: DataFrame, probes: DataFrame, limit: int = 1, block: int = 20_000) -> DataFrame:
    """(probe, word) of all different words within ``limit`` edits. Both inputs hold distinct strings in their only column.

    A shard with more than ``block`` words or probes is cut into blocks of about that size on both sides, and every block
    of words meets every block of probes in a task of its own, so no task holds a larger trie or more probes.
    """
    words, probes = words.toDF("word"), probes.toDF("word")

    def spread(df: DataFrame, probe: bool) -> DataFrame:
        if limit == 1:
            return df.select("word", F.explode(F.array_compact(F.array(*_shards(F.col("word"))))).alias("shard"))

        def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame([(w, k) for w in pdf.word for k in piece_keys(w, limit, probe)], columns=["word", "shard"])

        return df.mapInPandas(keys, "word string, shard string")

    build, probe = spread(words, False), spread(probes, True)
    sizes = build.select("shard", F.lit(1).alias("b"), F.lit(0).alias("p")).union(probe.select("shard", F.lit(0), F.lit(1))).groupBy("shard").agg(F.sum("b").alias("b"), F.sum("p").alias("p")).where("b > 0 and p > 0")
    blocks = sizes.select("shard", F.ceil(F.col("b") / block).cast("int").alias("bs"), F.ceil(F.col("p") / block).cast("int").alias("ps"))
    place = lambda n: F.pmod(F.xxhash64("word"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    build = build.join(blocks, "shard").select("shard", place("bs").alias("bsalt"), every("ps").alias("psalt"), "word")
    probe = probe.join(blocks, "shard").select("shard", every("bs").alias("bsalt"), place("ps").alias("psalt"), "word")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Cells one after another, the words of each before its probes."""
        now, held, trie = None, [], None
        for pdf in batches:
            out = []
            for key, probing, word in zip(zip(pdf["shard"], pdf.bsalt, pdf.psalt), pdf.probing, pdf.word):
                if key != now:
                    now, held, trie = key, [], None
                if not probing:
                    held.append(word)
                    continue
                trie = trie or Trie(held)
                out += [(word, w) for w, _ in trie.within(word, limit) if w != word]
            yield pd.DataFrame(out, columns=["probe", "word"])

    cell = ["shard", "bsalt", "psalt"]
    both = build.select(*cell, F.lit(False).alias("probing"), "word").unionByName(probe.select(*cell, F.lit(True).alias("probing"), "word"))
    return both.repartition(_parts(words), *cell).sortWithinPartitions(*cell, "probing").mapInPandas(meet, "probe string, word string").distinct()


def spellings(views: DataFrame, limit: int = 1) -> DataFrame:
    """(family, label): the family names that are spellings of one another, by views (addr, given, agreed, family).

    A family name is taken for a misspelling of a neighbour that more addresses bear if all given names beside it stand
    beside the neighbour too; where it stands beside initials or nothing, and never twice at one address in the same
    spelling, initials must agree. Of several neighbours the most frequent is taken, so no misspelling joins two of them;
    neighbours of the same frequency are spellings of one another if neither has a more frequent one.
    """
    full, initial = ~F.col("g").endswith("*"), F.col("g").endswith("*")
    given = views.select("family", F.explode("given").alias("g")).distinct()
    known = checkpointed(
        views.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.max("agreed").alias("agreed"))
        .join(given.groupBy("family").agg(F.count_if(full).alias("nf"), F.count_if(initial).alias("ni")), "family", "left")
        .select("family", "n", "agreed", F.coalesce("nf", F.lit(0)).alias("nf"), F.coalesce("ni", F.lit(0)).alias("ni"))
    )
    names = known.select("family")
    pairs = near_words(names, names, limit)
    a = known.select(F.col("family").alias("probe"), F.col("n").alias("np"), "agreed", "nf", "ni")
    b = known.select(F.col("family").alias("word"), F.col("n").alias("nw"), F.col("nf").alias("wf"))
    # a word beside no full given name tells nothing
    pairs = checkpointed(pairs.join(a, "probe").join(b, "word").where("np <= nw and wf > 0 and (nf > 0 or not agreed)"))
    beside = given.where(full).select("family", "g")
    mine = pairs.where("nf > 0").join(beside.withColumnRenamed("family", "probe"), "probe").join(beside.withColumnRenamed("family", "word"), ["word", "g"])
    initials = given.where(initial).select(F.col("family").alias("probe"), F.substring("g", 1, 1).alias("i")).distinct()
    theirs = beside.select(F.col("family").alias("word"), F.substring("g", 1, 1).alias("i")).distinct()
    alike = pairs.where("nf = 0").join(initials, "probe").join(theirs, ["word", "i"])
    shared = mine.select("probe", "word").unionByName(alike.select("probe", "word")).groupBy("probe", "word").agg(F.count(F.lit(1)).alias("shared"))
    held = pairs.join(shared, ["probe", "word"], "left").where("coalesce(shared, 0) = if(nf > 0, nf, ni)")
    held = checkpointed(held.select("probe", "word", "np", "nw"))
    best = held.where("np < nw").groupBy("probe").agg(F.max_by("word", F.struct("nw", "word")).alias("word"))
    root = best.select("probe")
    ties = held.where("np = nw").select("probe", "word").join(root, "probe", "left_anti").join(root.withColumnRenamed("probe", "word"), "word", "left_anti")
    edges = best.select(F.col("probe").alias("src"), F.col("word").alias("dst"), F.lit(1.0).alias("weight")).unionByName(ties.select(F.col("probe").alias("src"), F.col("word").alias("dst"), F.lit(1.0).alias("weight")))
    return components(edges).select(F.col("person").alias("family"), F.col("component").alias("label"))


def _named(rows: DataFrame, learned: DataFrame, most_words: int) -> tuple[DataFrame, frozenset[str]]:
    """((addr, names, given), all learned given names): how they reach the profiles.

    Up to ``most_words`` travel with the tasks; more stay distributed, and ``given`` holds those among an address's own words.
    """
    named = rows.repartition(_parts(rows), "addr").groupBy("addr").agg(F.collect_set("name").alias("names"))
    few = learned.select("word").distinct().limit(most_words + 1).collect()
    if len(few) <= most_words:
        return named.withColumn("given", F.lit(None).cast("array<string>")), frozenset(r.word for r in few)

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = {(a, w) for a, n in zip(pdf.addr, pdf.name) if n for w in re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", fold(n))}
            yield pd.DataFrame(sorted(found), columns=["addr", "word"])

    met = rows.select("addr", "name").mapInPandas(words, "addr string, word string").distinct().join(learned.select("word").distinct(), "word").groupBy("addr").agg(F.collect_list("word").alias("given"))
    return named.join(met, "addr", "left"), frozenset()


def entity_keys(
    export: DataFrame, names_col: str = "display_names", aliases_col: str | None = None, mails: DataFrame | None = None, from_col: str = "from", limit: int = 1, most_words: int = 200_000
) -> DataFrame:
    """(addr, entity) of every address among the keys of a map column address -> typed name.

    ``aliases_col`` is a map column alias -> address of known aliases, ``mails`` a table whose senders show more names.
    """
    rows = export.select(F.explode(F.col(f"`{names_col}`")).alias("key", "name")).select(F.lower(F.trim("key")).alias("addr"), F.trim("name").alias("name")).where("addr != ''").distinct()
    if mails is not None:
        sent = typed_names(mails, from_col, None, "").select(F.col("address").alias("addr"), "name")
        rows = rows.unionByName(sent.join(rows.select("addr").distinct(), "addr", "left_semi"))
    rows = checkpointed(rows)
    learned = given_name_evidence(rows.where("name != ''").select(F.col("addr").alias("address"), "name"))
    named, shared = _named(rows, learned, most_words)
    profiles = checkpointed(named.mapInPandas(_profiles(shared), _PROFILE))

    companies = profiles.where("org is not null")
    lines = companies.where("line != ''").groupBy("org").agg(F.countDistinct("line").alias("n"), F.min("line").alias("only"))
    company_keys = companies.join(lines, "org", "left").select("addr", F.concat_ws("|", F.lit("org"), "org", F.when((F.col("line") == "") & (F.col("n") == 1), F.col("only")).otherwise(F.col("line"))).alias("entity"))

    persons = profiles.where("org is null and size(families) > 0")
    views = persons.select("addr", "given", "agreed", F.explode("families").alias("family"))
    support = views.groupBy("family").agg(F.count(F.lit(1)).alias("support"))
    named = views.join(support, "family").join(spellings(views, limit), "family", "left")
    named = checkpointed(named.select("addr", "given", "support", F.coalesce("label", "family").alias("family")))
    best = named.groupBy("addr").agg(F.max_by("family", F.struct("support", "family")).alias("usual"), F.max("support").alias("most"))
    # a rarer spelling that stands beside the usual one at some address is that spelling wherever the given name agrees
    placed = named.select("addr", "family", "support", F.explode("given").alias("g")).join(best, "addr")
    spelt = placed.where(F.struct("support", "family") < F.struct("most", "usual")).where("family != usual and not endswith(g, '*')").groupBy("family", "g").agg(F.max_by("usual", F.struct("most", "usual")).alias("to"))
    again = placed.where("family = usual").join(spelt, ["family", "g"]).groupBy("addr").agg(F.max("to").alias("to"))
    family = best.join(again, "addr", "left").select("addr", F.coalesce("to", "usual").alias("family"))
    placed = persons.join(family, "addr").select("addr", "domain", F.filter("given", lambda g: g != F.col("family")).alias("given"), "middle", "family")

    # distinct given names and initials of a family name: a bounded group however many addresses bear it
    apart = placed.select("family", "given", "middle").distinct().repartition(_parts(export), "family").sortWithinPartitions("family")
    resolved = apart.mapInPandas(_settle, "family string, given array<string>, middle string, g string, m string, several boolean")
    resolved = checkpointed(placed.join(resolved, ["family", "given", "middle"]))
    here = resolved.where("g != '' and m != ''").groupBy("family", "g", "domain").agg(F.countDistinct("m").alias("n"), F.min("m").alias("only"))
    person_keys = (
        resolved.join(here, ["family", "g", "domain"], "left")
        .withColumn("m", F.when(~F.col("several"), F.col("m")).when(F.col("n") == 1, F.col("only")))
        .select("addr", F.when((F.col("g") != "") & F.col("m").isNotNull(), F.concat_ws("|", F.lit("person"), "family", "g", "m")).otherwise(F.concat(F.lit("alone|"), F.col("addr"))).alias("entity"))
    )
    keys = checkpointed(company_keys.unionByName(person_keys))
    return keys if aliases_col is None else _joined_by_aliases(keys, export, aliases_col)


def _joined_by_aliases(keys: DataFrame, export: DataFrame, aliases_col: str) -> DataFrame:
    """Entities that known aliases connect become one."""
    low = lambda c: F.lower(F.trim(c))
    known = export.select(F.explode(F.col(f"`{aliases_col}`")).alias("k", "v")).select(low("k").alias("k"), low("v").alias("v")).where("k != '' and v != '' and k != v").distinct()
    ends = known.join(keys.select(F.col("addr").alias("k"), F.col("entity").alias("ek")), "k", "left").join(keys.select(F.col("addr").alias("v"), F.col("entity").alias("ev")), "v", "left")
    ends = ends.select(F.coalesce("ek", F.concat(F.lit("absent|"), "k")).alias("src"), F.coalesce("ev", F.concat(F.lit("absent|"), "v")).alias("dst"), F.lit(1.0).alias("weight")).where("src != dst")
    whole = components(ends).select(F.col("person").alias("entity"), F.col("component").alias("whole"))
    return keys.join(whole, "entity", "left").select("addr", F.coalesce("whole", "entity").alias("entity"))


def linked_addresses(
    export: DataFrame, names_col: str = "display_names", aliases_col: str | None = None, mails: DataFrame | None = None, from_col: str = "from", limit: int = 1, salt_above: int = 1000
) -> DataFrame:
    """(addr_a, addr_b), addr_a < addr_b: every pair of addresses of one entity, formed after the entities are known.

    The pairs of an entity with more than ``salt_above`` addresses are formed by several tasks.
    """
    keys = checkpointed(entity_keys(export, names_col, aliases_col, mails, from_col, limit))
    sizes = keys.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("entity", F.ceil(F.col("n") / salt_above).cast("int").alias("salts"))
    several = keys.join(sizes, "entity")
    a = several.select("entity", F.pmod(F.xxhash64("addr"), F.col("salts")).cast("int").alias("salt"), F.col("addr").alias("addr_a"))
    b = several.select("entity", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("addr").alias("addr_b"))
    return a.join(b, ["entity", "salt"]).where("addr_a < addr_b").select("addr_a", "addr_b")
