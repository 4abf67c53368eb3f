import pytest

from tacitra.llm.personal import Surrogates, find_personal, personal_data, replace_personal, without_personal_data

CASES = [
    ("Call me at (651) 555-0166.", [("phone", "(651) 555-0166")]),
    ("T. +44 20 7946 0340 or 1-300-555-0180 ext. 278", [("phone", "+44 20 7946 0340"), ("phone", "1-300-555-0180 ext. 278")]),
    ("339/555-0176 x800, 8475550167, 493.555.0187 and (0161) 496 0627", [("phone", "339/555-0176 x800"), ("phone", "8475550167"), ("phone", "493.555.0187"), ("phone", "(0161) 496 0627")]),
    ("Deal 3025762, invoice Q9524558, meter NG-5661349 at 18,365 on 10/9/2000 10:13 AM", []),
    ("Use mailto:d..tren@x.example or <jo at mail dot example>, copy kx202[at]post.example.", [("email", "d..tren@x.example"), ("email", "jo at mail dot example"), ("email", "kx202[at]post.example")]),
    ("Copy 'ann'.lee@x.example and .b@x.example", [("email", "'ann'.lee@x.example"), ("email", ".b@x.example")]),
    ("my SSN 972-27-5963, passport Z2842823, NI number QQ 19 12 96 D. The end", [("idnum", "972-27-5963"), ("idnum", "Z2842823"), ("idnum", "QQ 19 12 96 D")]),
    ("driver license no. 82892911; employee no. P-397210; soc. sec. #912722330; SIN\n> 067-445-933", [("idnum", "82892911"), ("idnum", "P-397210"), ("idnum", "912722330"), ("idnum", "067-445-933")]),
    ("at 1041 Cobble Ln, Suite 1276, Lowfen, CA 00752 from", [("address", "1041 Cobble Ln, Suite 1276, Lowfen, CA 00752")]),
    ("Flat 25, 8025 Foundry St., Lowfen before", [("address", "Flat 25, 8025 Foundry St., Lowfen")]),
    ("Office: P.O. Box 7715, Hollis Gap, LA 00104", [("address", "P.O. Box 7715, Hollis Gap, LA 00104")]),
    ("Dr. Ulrick asked Susan N. Everquill and Varberg, Zoë to meet J. Voslow", [("name", "Ulrick"), ("name", "Susan N. Everquill"), ("name", "Varberg, Zoë"), ("name", "J. Voslow")]),
    ("zelda chamdraby and GREGORY FRIMÖN wrote", [("name", "zelda chamdraby"), ("name", "GREGORY FRIMÖN")]),
    ("Regards, Jennifer", [("name", "Jennifer")]),
    ("To: Samuel Salanlow/LDN/CORV@CORV", [("name", "Samuel Salanlow")]),
    ("RenÃ© MÃ¶ntford called", [("name", "RenÃ© MÃ¶ntford")]),
    ("Birchall Risk Advisory Incorporated and the Dunmere storage field", []),
    ("Please call John Smith tomorrow", [("name", "John Smith")]),
    ("David Brown and Mary Johnson", [("name", "David Brown"), ("name", "Mary Johnson")]),
    ("Kenneth Lay wrote to Jeffrey Skilling", [("name", "Kenneth Lay"), ("name", "Jeffrey Skilling")]),
    ("Smith will call. Mr. Smith agreed.", [("name", "Smith"), ("name", "Smith")]),
    ("Mr. Law agreed. Law is law.", [("name", "Law")]),
    ("Mark the date; Mark Tavelin knows it", [("name", "Mark Tavelin")]),
    ("Call me at 853-1234 or ext 345-9876; deal 853-1234", [("phone", "853-1234"), ("phone", "345-9876")]),
    ("ZoÃ« Kelton and Dorothea G. OsandalÃƒÂ«", [("name", "ZoÃ« Kelton"), ("name", "Dorothea G. OsandalÃƒÂ«")]),
    ("", []),
    ("   ", []),
]


@pytest.mark.parametrize("text,expected", CASES)
def test_found(text, expected):
    assert [(k, text[a:b]) for a, b, k in find_personal(text)] == expected


def test_placeholders():
    assert replace_personal("Susan Lee wrote to a@x.example, Susan Lee answered", None) == "[NAME_1] wrote to [EMAIL_1], [NAME_1] answered"


def test_surrogates_are_distinct_and_alike():
    s = Surrogates(b"key")
    names = ["Varberg", "Tarberg", "Varburg", "Vartberg"]
    assert len({s.word(n) for n in names}) == 4
    assert all(s.word(n)[0].isupper() and len(s.word(n)) == len(n) for n in names)
    from tacitra.llm.names import GIVEN

    for g, (sex, _) in GIVEN.items():
        assert s.word(g) != g and GIVEN[s.word(g)][0] == sex
    assert len({s.word(g) for g in GIVEN}) == len(GIVEN)
    numbers = {s.letters(f"{i:04}") for i in range(10000)}
    assert len(numbers) == 10000


def test_surrogates_keep_form_and_reference():
    text = "Susan Varberg (972-27-5963) met Dr. Varberg; VARBERG, SUSAN"
    out = replace_personal(text, b"k")
    assert out != text and out == replace_personal(text, b"k") and out != replace_personal(text, b"other")
    first = out.split()[1]
    assert f"Dr. {first};" in out and "Susan" not in out and "972" not in out.split("(")[1][:3]


def test_frames(spark):
    rows = [(1, "Call 493.555.0187", "Ann"), (1, "Call 493.555.0187", "Ann"), (2, None, None), (3, "", "word " * 50000 + "a@x.example a@x.example")]
    df = spark.createDataFrame(rows, "row_id bigint, subject string, body string")
    got = sorted(map(tuple, personal_data(df, "row_id", ["subject", "body"]).collect()))
    assert got == [(1, "body", "name", "Ann")] * 2 + [(1, "subject", "phone", "493.555.0187")] * 2 + [(3, "body", "email", "a@x.example")]
    clean = without_personal_data(df, "row_id", ["subject", "body"], key="k")
    assert clean.columns == ["row_id", "subject", "body"] and clean.count() == 4
    assert personal_data(df.limit(0), "row_id", ["body"]).count() == 0


def test_learned_names(spark):
    from tacitra.llm.evidence import given_name_evidence, typed_names

    mails = spark.createDataFrame([("Ollamar, Quendra <q.ollamar@x.example>",), ("Tessarin, Quendra (Gas)" " <qt@x.example>",), ("Bruvik Halmero <hbruvik@x.example>",), ("Dessalo, Halmero <h@x.example>",), (None,), ("plain@x.example",)], "from string")
    export = spark.createDataFrame([({"a@x.example": "Gas Services, Ltd", "b@x.example": None},)], "display_names map<string,string>")
    words = given_name_evidence(typed_names(mails, "from", export, "display_names"))
    assert sorted(r.word for r in words.collect()) == ["halmero", "quendra"]
    df = spark.createDataFrame([(1, "Ask Quendra Ollamar or Halmero."), (2, "quendra"), (1, None)], "row_id bigint, body string")
    for most in (0, 100):  # the same rows whether the words travel with the tasks or meet the texts in a join
        got = sorted(map(tuple, personal_data(df, "row_id", ["body"], learned=words, most_words=most).collect()))
        assert got == [(1, "body", "name", "Halmero"), (1, "body", "name", "Quendra Ollamar")]
        clean = {r.row_id: r.body for r in without_personal_data(df.where("body is not null"), "row_id", ["body"], learned=words, most_words=most).collect()}
        assert clean == {1: "Ask [NAME_1] or [NAME_2].", 2: "quendra"}
