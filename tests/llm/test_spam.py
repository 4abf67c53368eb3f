import random

from tacitra.llm.spam import repeats, spam_pages, spam_words

PROSE = "The margin changed by 18,365 barrels as the pipeline cut flows. Could the gas desk explain why the withdrawal schedule is waiting on numbers? I would not update anything before noon. "
KEYS = ["solar kit", "fuel card", "gas rates", "power deals"]


def share(text):
    bad, n = spam_words(text)
    return bad / n if n else 0.0


def test_kinds():
    rnd = random.Random(1)
    stuffed = " ".join(f"{rnd.choice(['buy', 'for', 'the best', 'with our'])} {rnd.choice(KEYS[:2])} {rnd.choice(['in', 'and the', 'or'])} {rnd.choice(KEYS[:2])}" for _ in range(40))
    links = "\n".join(f'<a href="http://x{i}.example/{i}">{rnd.choice(KEYS)}</a>' for i in range(30))
    tags = " ".join(f"#{rnd.choice(KEYS).replace(' ', '')}{i}" for i in range(40))
    products = " | ".join(f"SKU-{rnd.randrange(9999)} {rnd.choice(KEYS)} {rnd.choice(['new', 'sale', '$5.99'])}" for _ in range(30))
    listed = ", ".join(f"{rnd.choice(KEYS)} {rnd.choice(['Dunmere', 'Pennick', 'Lowfen'])}" for _ in range(40))
    for text in (stuffed, links, tags, products, listed):
        assert share(text) > 0.8
        assert share(text.upper()) > 0.8
        assert share(PROSE + "\n" + text) > 0.5


def test_no_spam():
    log = "".join(f"{h:02}:10 {random.Random(h).choice(['Pressure steady.', 'Walked the yard, all quiet.', 'Checked the pump, no change.'])}\n" for h in range(24))
    readings = "".join(f"{h:02}:00  {700 + h}.4 psi  {12000 + 7 * h} MMBtu\n" for h in range(24))
    glossary = "Glossary\n" + "\n".join(f"nomination: {s}." for s in PROSE.split(". ")[:3])
    for text in (PROSE, PROSE * 40, "Daily readings. " + readings, log, glossary, "", "   ", "...", "word"):
        assert share(text) <= 0.5
    assert share(PROSE + "\nRelated: http://a.example/x http://b.example/y") <= 0.5


def test_repeats_against_brute_force():
    rnd = random.Random(2)
    for _ in range(60):
        words = [rnd.randrange(3) for _ in range(rnd.randrange(0, 25))]
        for least, got in zip((2, 3), repeats(words)):
            for i in range(len(words)):
                best = 0
                for size in range(1, i + 2):
                    part = words[i + 1 - size : i + 1]
                    if sum(words[k : k + size] == part for k in range(len(words) - size + 1)) >= least:
                        best = size
                assert got[i] == best


def test_frame(spark):
    spam = "fuel card gas rates " * 30
    df = spark.createDataFrame([(1, spam, 0.0), (1, spam, 0.0), (2, PROSE, 0.0), (3, None, 0.0), (4, "", 0.0), (5, PROSE * 300, 0.0), (6, spam * 40, 0.0)], "doc_id bigint, text string, spam_share double")
    assert sorted(r.doc_id for r in spam_pages(df, "doc_id", "text").collect()) == [1, 1, 6]
    assert spam_pages(df.limit(0), "doc_id", "text").count() == 0


STUFFED = " ".join(["Our store sells leather boots for men. The best leather boots for men are here.", "If you need leather boots for men, visit us and see leather boots for men today.", "Many people like leather boots for men because they last.", "We ship leather boots for men worldwide. Order leather boots for men and save.", "You can trust leather boots for men from us, as leather boots for men should fit.", "Call about leather boots for men. Leather boots for men and leather boots for men."])


def test_keywords_within_sentences():
    bad, n = spam_words(STUFFED)
    assert bad > 0.5 * n


def test_bound_never_drops_a_page():
    import random

    from tacitra.llm.spam import may_be_spam

    rnd = random.Random(2)
    bits = ["cheap boots online", "The meeting was moved to Friday because the room is closed.", "AB-1234 steel bolt", "boots, boots, boots;", "a\n\n", "| best deal", "the and of", "Notes (draft):", "x", "https://a.example/b", "#sale"]
    spam = 0
    for _ in range(3000):
        text = rnd.choice([" ", "\n", ". "]).join(rnd.choices(bits, k=rnd.randrange(1, 25), weights=[rnd.random() ** 4 for _ in bits]))
        bad, n = spam_words(text)
        if n and bad > 0.5 * n:
            spam += 1
            assert may_be_spam(text, 0.5), text
    assert spam > 100 and may_be_spam(STUFFED, 0.5) and not may_be_spam("", 0.5) and not may_be_spam("The meeting was moved to Friday because the room is closed.", 0.5)
