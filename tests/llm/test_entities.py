import random

from tacitra.llm.entities import Trie, linked_addresses, near_words, read_local, read_name, resolve


def distance(a, b):
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j - 1] + 1, rows[i - 1][j] + 1, rows[i - 1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, rows[i - 2][j - 2] + 1)
            row.append(d)
        rows.append(row)
    return rows[-1][-1]


def words(n, seed=1):
    rnd = random.Random(seed)
    return sorted({"".join(rnd.choice("abcd") for _ in range(rnd.randrange(2, 9))) for _ in range(n)})


def test_trie_against_brute_force():
    vocabulary = words(150)
    trie = Trie(vocabulary)
    for w in words(80, 2):
        for limit in (0, 1, 2):
            assert sorted(trie.within(w, limit)) == sorted((v, distance(w, v)) for v in vocabulary if distance(w, v) <= limit)


def test_near_words_against_brute_force(spark):
    vocabulary = words(300, 3)
    df = spark.createDataFrame([(w,) for w in vocabulary], "w string")
    expected = sorted((a, b) for a in vocabulary for b in vocabulary if a != b and distance(a, b) <= 1)
    assert sorted(map(tuple, near_words(df, df).collect())) == expected
    assert sorted(map(tuple, near_words(df, df, block=7).collect())) == expected


def test_names_and_local_parts():
    assert read_name("Varberg, Susan N. (Credit)") == ("varberg", ["susan"], "n")
    assert read_name("Susan  N. Varberg/HQ/CORV") == ("varberg", ["susan"], "n")
    assert read_name("Varberg Susan") == ("varberg", ["susan"], "") and read_name("Zoë") is None and read_name(None) is None
    assert read_local("k..zanovic", None) == [("zanovic", "", "k")] and read_local(".zanovic", None) == [("zanovic", "", "")]
    assert read_local("salanlow.samuel.l2", None) == [("salanlow", "samuel", "l")]
    assert read_local("apwickholworth", "wickholworth") == [("wickholworth", "a", "p")]
    assert read_local("tarfensonv7", "tarfenson") == [("tarfenson", "v", "")]


def test_resolve():
    assert [x[:2] for x in resolve([(("susan",), "n"), (("susan",), ""), (("s*",), ""), ((), "n")])] == [("susan", "n")] * 4
    assert resolve([(("susan",), "n"), (("susan",), "k"), (("susan",), "")])[2] == ("susan", "", True)
    assert resolve([(("susan",), ""), (("samuel",), ""), (("s*",), "")])[2][0] == ""


def test_linked(spark):
    names = {
        "susan.varberg@x.example": "Susan Varberg", "SVarberg7@y.example ": "Varberg, Sue", "varberg.susan@z.example": None, "susan.vraberg@x.example": "Susan Varberg", "susan.varbrg@x.example": None,
        "susan.tarlow@x.example": "Susan Tarlow", "samuel.a.salan@x.example": "Samuel A Salan", "samuel.l.salan@x.example": "Salan, Samuel L.", "l..salan@x.example": "SAMUEL SALAN", "samuel.salan@w.example": "Samuel Salan",
        "info@acme-gas.example": "Acme Gas Marketing Ltd.", "billing@acmeonline.example": "The Acme Gas Limited", "desk@acme-power.example": "Acme Power Trading, Inc.", "": "Nobody", "broken": "No Address", "@x.example": " ",
    }
    df = spark.createDataFrame([(1, names, "a"), (2, {"susan.varberg@x.example": "Varbrg, Susan"}, "b"), (2, {"susan.varberg@x.example": "Varbrg, Susan"}, "b"), (3, None, "c"), (4, {}, "d")], "export_id int, display_names map<string,string>, addr string")
    got = {tuple(r) for r in linked_addresses(df).collect()}
    susan = sorted(["susan.varberg@x.example", "svarberg7@y.example", "varberg.susan@z.example", "susan.vraberg@x.example", "susan.varbrg@x.example"])
    expected = {(a, b) for a in susan for b in susan if a < b} | {("l..salan@x.example", "samuel.l.salan@x.example"), ("billing@acmeonline.example", "info@acme-gas.example")}
    assert got == expected
    assert linked_addresses(df.limit(0)).count() == 0


def test_wider_distance_against_brute_force(spark):
    vocabulary = sorted(set(words(120, 5)) | {"abcabcabcd", "abcabacbcd", "bacabcabcdd", "abcdabcdabcd", "abdcabcdabdc"})
    df = spark.createDataFrame([(w,) for w in vocabulary], "w string")
    for limit in (1, 2):
        expected = sorted((a, b) for a in vocabulary for b in vocabulary if a != b and distance(a, b) <= limit)
        for block in (20_000, 9):
            assert sorted(map(tuple, near_words(df, df, limit=limit, block=block).collect())) == expected


def test_piece_keys_meet():
    from tacitra.llm.entities import piece_keys

    vocabulary = words(400, 6)
    for a in vocabulary[::7]:
        for b in vocabulary:
            for limit in (1, 2):
                if distance(a, b) <= limit:
                    assert piece_keys(a, limit, False) & piece_keys(b, limit, True), (a, b, limit)


def test_misspelling_that_recurs(spark):
    names = {f"susan.{f}@{d}.example": None for f in ("varberg",) for d in "abc"} | {"john.varberg@a.example": "John Varberg", "susan.vraberg@p.example": None, "susan.vraberg@q.example": None, "paul.varburg@a.example": None, "mary.varburg@a.example": None}
    got = {tuple(r) for r in linked_addresses(spark.createDataFrame([(names,)], "display_names map<string,string>")).collect()}
    susan = sorted(a for a in names if a.startswith("susan"))
    assert got == {(a, b) for a in susan for b in susan if a < b}


def test_both_orders_of_unlisted_names(spark):
    names = {"q.ollamar@x.example": "Quendra Ollamar", "ollamar.q@y.example": "Ollamar Quendra", "h.ollamar@x.example": "Ollamar, Halmero", "z@w.example": "Ollamar Quendra", "t.ollamar@x.example": "Ollamar, Tessa"}
    got = {tuple(r) for r in linked_addresses(spark.createDataFrame([(names,)], "display_names map<string,string>")).collect()}
    assert ("ollamar.q@y.example", "q.ollamar@x.example") in got and not any("h.ollamar@x.example" in p for p in got)


def test_aliases_senders_and_salts(spark):
    names = {"bob.lee@x.example": "Bob Lee", "xq1@z.example": None, "ann.ray@x.example": None, "aray@y.example": None}
    export = spark.createDataFrame([(names, {"XQ1@z.example ": "hidden@x.example", "hidden@x.example": "bob.lee@x.example"})], "display_names map<string,string>, duplicates map<string,string>")
    mails = spark.createDataFrame([('"Ray, Ann" <aray@y.example>',), ("Stranger <s@x.example>",), (None,)], "from string")
    expected = {("bob.lee@x.example", "xq1@z.example"), ("ann.ray@x.example", "aray@y.example")}
    for salt in (1, 1000):
        assert {tuple(r) for r in linked_addresses(export, aliases_col="duplicates", mails=mails, salt_above=salt).collect()} == expected
    assert linked_addresses(export.limit(0), aliases_col="duplicates", mails=mails).count() == 0


def test_learned_names_in_a_broadcast_or_a_join(spark):
    from tacitra.llm.entities import entity_keys

    names = {"a@x.example": "Ollamar, Quendra", "b@x.example": "Tessarin, Quendra", "c@x.example": "Bruvik Quendra", "qbruvik@x.example": None, "d@x.example": "Dessalo, Halmero", "e@x.example": "Halmero Bruvik", "f@x.example": "Bruvik, Halmero"}
    df = spark.createDataFrame([(names,)], "display_names map<string,string>")
    one, two = (sorted(map(tuple, entity_keys(df, most_words=n).collect())) for n in (0, 200_000))
    assert one == two and len(one) == len(names)
