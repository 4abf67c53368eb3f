import re

import pytest

from tacitra.llm.names import GIVEN, SHORT
from tacitra.llm.personal import Surrogates, find_personal, replace_personal

ADDRESSES = [
    ("1041 Cobble Ln, Suite 1276, Lowfen, CA 00752", {"Ln", "Suite", "CA"}),
    ("Flat 25, 8025 Foundry St., Lowfen", {"Flat", "St"}),
    ("12 Court Street", {"Street"}),
    ("P.O. Box 7715, Hollis Gap, LA 00104", {"P", "O", "Box", "LA"}),
    ("77B O'Dell Mill Rd #4 Ister Bay, TX 77001-1234", {"Rd", "TX"}),
]


@pytest.mark.parametrize("value,kept", ADDRESSES)
def test_only_type_words_of_an_address_stay(value, kept):
    assert [k for _, _, k in find_personal(f"at {value}")] == ["address"]
    out = Surrogates(b"k").replace(value, "address")
    assert set(re.findall(r"\w+", value)) & set(re.findall(r"\w+", out)) == kept
    assert re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "0", value)) == re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "0", out))


def test_short_forms_follow_the_full_name():
    for key in (b"k", b"another"):
        s = Surrogates(key)
        made = {x: s.word(x) for x in (*GIVEN, *SHORT)}
        assert len(set(made.values())) == len(made) and all(x != y for x, y in made.items())
        for x, y in made.items():
            if x in SHORT and x not in GIVEN:
                to = s.word(SHORT[x])
                assert SHORT.get(y) == to or y[:3] == to[:3]
        assert s.word("BOB") == s.word("bob").upper()


def test_address_in_a_text():
    out = replace_personal("Bob lives at 1041 Cobble Ln, Lowfen, CA 00752 now", b"k")
    assert not {"Bob", "1041", "Cobble", "Lowfen", "00752"} & set(re.findall(r"\w+", out))


def test_one_bijection_for_all_texts():
    import itertools
    import random

    rnd = random.Random(4)
    s = Surrogates(b"corpus")
    words = {"".join(rnd.choice("abeilmnorst") for _ in range(rnd.randrange(3, 7))) for _ in range(4000)} | {*GIVEN, *SHORT}
    made = {w: s.word(w) for w in words}
    assert len(set(made.values())) == len(words) and all(a != b for a, b in made.items())
    assert all((made[w] in GIVEN or made[w] in s.short.values()) == (w in GIVEN or w in SHORT) for w in words)
    texts = ["Susan Varberg met Bob Tarlow.", "Mr. Tarlow called SUSAN VARBERG", "Varberg, Susan and Robert Tarlow at susan.varberg@x.example"]
    outs = [replace_personal(t, s) for t in texts]
    given, family = outs[0].split()[:2]
    assert f"{given.upper()} {family.upper()}" in outs[1] and f"{family}, {given}" in outs[2] and f"{given}.{family}@".lower() in outs[2].lower()
    assert outs[1].split()[1] == outs[0].split()[4].rstrip(".")
    for text, out in zip(texts, outs):
        for word in ("Susan", "Varberg", "Tarlow", "Bob", "Robert"):
            assert word.lower() not in re.findall("[a-z]+", out.lower()), (text, out)
    assert len({s.letters("".join(p)) for p in itertools.product("0123456789", repeat=4)}) == 10000


def test_a_number_stays_one_number():
    s = Surrogates(b"k")
    forms = ["(651) 555-0166", "651.555.0166", "6515550166", "651-555-0166 ext. 27"]
    digits = {re.sub(r"\D", "", s.replace(f, "phone"))[:10] for f in forms}
    assert len(digits) == 1 and digits != {"6515550166"}


def test_domains_and_other_scripts():
    s = Surrogates(b"k")
    out = s.replace("ann.lee@mail.corvane.example", "email")
    assert out.endswith(".example") and "corvane" not in out and out.count(".") == 3
    for word in ("Ψαρρός", "יעקב", "محمد", "田中", "Björnsen", "Ёжиков"):
        made = s.letters(word)
        assert len(made) == len(word) and made != word
    assert s.letters("Zöe")[1] in "äëïöü"
