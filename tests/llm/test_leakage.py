import random

from tacitra.llm.leakage import leaked_items, within_distance, words_of

PASSAGE = "one two three four five six seven eight nine ten eleven twelve"


def pairs(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id bigint, text string, i string")
    i = spark.createDataFrame(items, "item_id bigint, passage string, question string")
    return sorted((r.doc_id, r.item_id) for r in leaked_items(d, "doc_id", "text", i, "item_id", ["passage", "question"], **kw).collect())


def test_ten_words(spark):
    items = [(1, PASSAGE, "Why so short?"), (2, None, ""), (3, "Alpha beta gamma", "ONE two, three-four five six seven eight nine TEN!"), (1, "spare text of the same item " + PASSAGE[::-1], None)]
    docs = [
        (1, "x " + PASSAGE.upper().replace(" ", "\n- ") + " y", ""),
        (2, "two three four five six seven eight nine ten eleven", ""),
        (3, "two three four five six seven eight nine ten elevenx", ""),
        (4, "one two three four five SIX_seven eight nine ten", ""),
        (5, None, ""), (6, "", ""), (7, " ", ""),
        (8, ("z " * 60000) + PASSAGE, ""),
        (1, "again " + PASSAGE, ""),
    ]
    assert pairs(spark, docs, items) == sorted([(1, 1), (1, 3), (1, 1), (1, 3), (2, 1), (4, 1), (4, 3), (8, 1), (8, 3)])
    assert sorted(set(pairs(spark, docs, items, block_chars=1))) == sorted({(1, 1), (1, 3), (2, 1), (4, 1), (4, 3), (8, 1), (8, 3)})
    for size in (0, 10, 10**9):  # the same rows whether the items are broadcast or joined
        assert pairs(spark, docs, items, block_chars=size) == pairs(spark, docs, items)
    assert pairs(spark, docs, []) == [] and pairs(spark, [], items) == []


def test_words():
    assert words_of("A_b İx-Ö9 é") == ["a", "b", "i̇x", "ö9", "é"]


def edit_distance_to_substring(p, t):
    row = list(range(len(p) + 1))
    best = row[-1]
    for w in t:
        new = [0]
        for i, x in enumerate(p, 1):
            new.append(min(new[-1] + 1, row[i] + 1, row[i - 1] + (x != w)))
        row = new
        best = min(best, row[-1])
    return best


def test_bit_parallel_distance():
    rnd = random.Random(5)
    for _ in range(500):
        p = [rnd.randrange(4) for _ in range(rnd.randrange(1, 11))]
        t = [rnd.randrange(4) for _ in range(rnd.randrange(0, 15))]
        d = edit_distance_to_substring(p, t)
        for k in range(4):
            assert within_distance(p, t, k) == (d <= k)


def test_with_edits(spark):
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=14)), None) for i in range(8)]
    docs = []
    for i in range(60):
        w = rnd.choice(items)[1].split()[2:13]
        for _ in range(rnd.randrange(0, 4)):
            w[rnd.randrange(len(w))] = "other"
        docs.append((i, " ".join(rnd.choices(vocabulary, k=5) + w + rnd.choices(vocabulary, k=5)), ""))
    expected = []
    for d, text, _ in docs:
        for i, passage, _ in items:
            w, t = passage.split(), text.split()
            if any(edit_distance_to_substring(w[k : k + 10], t) <= 2 for k in range(len(w) - 9)):
                expected.append((d, i))
    assert pairs(spark, docs, items, max_edits=2) == sorted(expected)
    assert pairs(spark, docs, items, max_edits=2, block_chars=0) == sorted(expected)


def test_fewest_edits(spark):
    item = spark.createDataFrame([(1, PASSAGE)], "i string, t string")
    texts = [PASSAGE, PASSAGE.replace("six", "x"), PASSAGE.replace("six", "x").replace("two", "y"), PASSAGE.replace("five six", "five and six"), PASSAGE.replace("six ", "")]
    docs = spark.createDataFrame(list(enumerate(texts)), "d int, t string")
    for size in (0, 10**9):
        got = {r.d: r.edits for r in leaked_items(docs, "d", "t", item, "i", ["t"], max_edits=1, block_chars=size).collect()}
        assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1}
