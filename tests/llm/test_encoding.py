import pytest

from tacitra.llm.encoding import garbled_rows, inspect_text

CLEAN = [
    "plain ascii, nothing else", "", " ", "Café René, naïve façade; €5 and £3 – “fine”, it’s 35° or ½…", "Größe, Übersicht, schließlich, Ausschuß", "Não há ações em São José: NÃO, INFORMAÇÃO", "Каждый склад проверил договор № 7 из-за морозов",
    "Où en êtes-vous de l’étude ? L’été, l’œuvre, créée", "¿Podría confirmar el año?", "ANAÏS YARGÖDALÈ and ZOË", "m² and m³, ±5%, n° 3, §12", "│ table │ ─── ┼ ───",
]
TEXTS = ["Die Händlerin bestätigte die Übersicht für größere Beträge", "La reunión será mañana según el índice", "A comissão não cancelou a cobrança de março", "Le marché a vérifié l'échéance à l'été"]
RUSSIAN = "Новый оператор закрыл сделку и ждёт ответа после совещания"


@pytest.mark.parametrize("text", CLEAN)
def test_clean_text_stays(text):
    assert inspect_text(text) == (text, [])


@pytest.mark.parametrize("text", [*TEXTS, RUSSIAN, "“Fine” – it’s €5… ½ of £3"])
@pytest.mark.parametrize("codec", ["latin-1", "cp1252", "mac_roman", "cp437", "cp850"])
def test_multi_byte_round_trip(text, codec):
    try:
        bad = text.encode("utf-8").decode(codec)
    except UnicodeDecodeError:
        return  # this text cannot be damaged so
    restored, kinds = inspect_text("before " + bad + " after")
    assert kinds and restored == "before " + text + " after"


def test_twice_damaged():
    bad = TEXTS[3].encode("utf-8").decode("latin-1").encode("utf-8").decode("latin-1")
    assert inspect_text(bad)[0] == TEXTS[3]


@pytest.mark.parametrize("wrong,right,text", [("cp1251", "cp1252", TEXTS[0]), ("cp1252", "cp1251", RUSSIAN), ("koi8_r", "cp1251", RUSSIAN), ("cp1251", "koi8_r", RUSSIAN)] + [(c, "cp1252", t) for c in ("cp850", "cp437") for t in TEXTS])
def test_single_byte_is_found(wrong, right, text):
    bad = text.encode(right).decode(wrong)
    assert inspect_text(bad)[1], bad


@pytest.mark.parametrize("wrong,right,text", [("cp1251", "cp1252", TEXTS[0]), ("cp1252", "cp1251", RUSSIAN), ("cp1251", "koi8_r", RUSSIAN)])
def test_single_byte_is_restored(wrong, right, text):
    assert inspect_text(text.encode(right).decode(wrong))[0] == text


def test_lost_and_control():
    assert inspect_text("caf� is closed")[1] == ["lost"]
    assert inspect_text("it\x92s \x93old\x94")[0] == "it’s “old”"


SCRIPTS = ["Καλημέρα κόσμε, τι κάνεις;", "שלום עולם, מה שלומך?", "日本語のテキストです。よろしくお願いします", "Great 😀👍🏽 news 🎉", "مرحبا بالعالم", "Tiếng Việt rất đẹp", "București și Țara", "中文 text 字", "안녕하세요 세계", "नमस्ते दुनिया", RUSSIAN]


@pytest.mark.parametrize("text", SCRIPTS)
def test_every_script(text):
    assert inspect_text(text) == (text, [])
    for codec in ("latin-1", "cp1252"):
        bad = text
        for _ in range(4):
            try:
                bad = bad.encode("utf-8").decode(codec)
            except UnicodeDecodeError:
                break
            assert inspect_text(bad)[0] == text and "multi-byte" in inspect_text(bad)[1]


def test_chance_is_no_damage():
    for text in ("« CAFÉ\xa0» est fermé", "È\xa0vero", "ÀÉ", "Ä€5?"[:1] + " 5"):
        assert inspect_text(text)[0] == text


def test_garbled_signs_are_not_changed_into_others():
    bad = SCRIPTS[2].encode("utf-8").decode("cp1252", "replace")  # bytes without a character are lost
    restored, kinds = inspect_text(bad)
    assert "lost" in kinds and not any("\u0400" <= c <= "\u04ff" for c in restored)


def test_frame(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "cafÃ©", 0), (3, "cafÃ©", 0), (4, "café", 0), (5, ("ok " * 40000) + "Ã¼ber", 0), (6, "caf�", 0)]
    df = spark.createDataFrame(rows, "row_id bigint, body string, restored int")
    out = {(r.row_id, r.restorable) for r in garbled_rows(df, "row_id", "body").collect()}
    assert out == {(3, True), (5, True), (6, False)}
    assert garbled_rows(df, "row_id", "body").count() == 4 and garbled_rows(df.limit(0), "row_id", "body").count() == 0
