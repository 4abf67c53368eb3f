from tacitra.llm.newtext import foreign_lines, label_lines, new_text


def kinds(text):
    return "".join(" " if not x.strip() else "nqsd"[k] for x, k in zip(text.split("\n"), label_lines(text)))


def test_top_posting():
    body = "Dear Ann,\n\nPlease check the final report.\nUse the From: and To: columns.\n\nRegards,\n\nBob Lee\nAnalyst, Trading\n(651) 555-0166\n\n-----Original Message-----\nFrom: Ann\nSent: Monday\n\nold text\nold text"
    assert kinds(body) == "n nn s sss qqq qq".replace("q ", "q ")
    assert new_text(body) == "Dear Ann,\n\nPlease check the final report.\nUse the From: and To: columns."


def test_answers_between_quotes():
    body = "On Thu, Nov 8, 1999 at 9:32 AM, Ann Ray wrote:\n> first\nYes, it is.\n\n> second\n> third\nFYI\n\nThanks, Bob"
    assert kinds(body) == "qqn qqn s"


def test_signs_of_quotes_and_openers():
    for sign in ("> ", ">", "| ", ": ", "    > "):
        assert kinds(f"Am 25.05.1999 um 8:15 schrieb Ann Ray:\n{sign}old line here\n\nNew words here.") == "qq n"
    assert kinds("In a message dated 08/21/2001 9:11, a@x.example writes:\n\n      old\n      old\n\nNew words.") == "q qq n"
    for opener in ("Begin forwarded message:", "----- Message from Ann Ray on Sun, Mar 14, 1999 -----", "_____________\nFrom: Ann <a@x.example>\nDate: Mon", "Ann Ray@CORVANE\n10/9/2000 10:13 AM\nTo: Bob", "From: Ann Ray on 02/9/2001 5:57 AM"):
        assert set(kinds(f"New.\n\n{opener}\n\nold").replace(" ", "")[1:]) == {"q"}


def test_signatures_and_notices():
    assert kinds("Done.\n--\nBob Lee\nManager, Gas") == "nsss"
    assert kinds("Done.\n*******\nBob Lee * Analyst * 2155550137\n*******") == "nsss"
    assert kinds("Done.\n\nBL") == "n s" and kinds("Done.\nBob Lee/HQ/CORV") == "ns"
    assert kinds("Done.\n-- sent from my two-way pager") == "ns"
    assert kinds("Sent from the Lowfen meter, the report arrived late.") == "n"
    assert kinds("Done.\nBob\nNOTICE: this mail is intended only for the recipient named above.\nAny copying is forbidden.") == "nsdd"
    assert kinds("The confidential report is ready.\nThe clause on confidential information looks fine.") == "nn"
    assert kinds("FYI") == "n" and kinds("Bob") == "s" and kinds("Approved.") == "n"
    assert kinds("Каждый склад проверил договор.\nНовая строка без точки\nв конце.") == "nnn"


def test_look_alikes():
    assert kinds("There is room. Anything\n> 38059 contracts goes to settlements first. Can you approve\nit?") == "nnn"
    assert kinds("On the board update someone wrote:\ndo not forward it.") == "nn"
    assert kinds("Please check it.\nRegards to all at the\nplant from the credit group.") == "nnn"
    assert kinds("Sent from the\nLowfen meter it came late.") == "nn"
    assert kinds("It is done.\nThank you, Jürgen") == "ns" and kinds("It is done.\nThanks for the update") == "nn"


NEWS = "Hi Ann,\n\nThe report is ready and we can send it tomorrow. Please look at the last page.\n\n"


def test_closings_that_no_list_holds():
    for end, marks in (("Talk soon,\nJane", "ss"), ("Warmly,\nJane Doe", "ss"), ("Best wishes,\n\nJane", "s s"), ("Hugs,\nJ", "ss"), ("Speak Monday,\nPaul Brown\nHead of Sales", "sss"), ("Catch you later\nMarta", "ss")):
        assert kinds(NEWS + end) == "n n " + marks, end


def test_attributions_of_other_forms():
    for text, marks in (
        ("Jane Doe <jane@x.com> wrote on Monday:\nold text here that was sent before.", "qq"),
        ("2001/3/4 Jane Doe <jane@x.com>:\n> old text\n> more\n\nAnswer here is given.", "qqq n"),
        ("Jane Doe said on 3/4/01:\n> old\nYes, I agree with it.", "qqn"),
        ("On " + "Monday the fourteenth of May " * 8 + "2001 Jane Doe wrote:\n> old text\n\nThanks for it, I agree.", "qq n"),
    ):
        assert kinds(NEWS + text) == "n n " + marks, text


def test_long_notice_and_lines():
    assert kinds("Done.\n\nThis message is for its reader.\n" + "It says nothing of note.\n" * 9 + "It is confidential and meant for the recipient.") == "n " + "d" * 11
    assert kinds("word " * 500 + "ends.\n-- \nBob Lee") == "nss"


def test_model_is_fitted_with_cues_hidden():
    from tacitra.llm.newtext import load_model
    from tacitra.llm.newtext_fit import agreement, fit

    texts = [f"Hi Ann,\n\nThe report number {i} is ready now.\nPlease look.\n\n{c},\nBob Lee\n\n-----Original Message-----\nFrom: Ann\nSent: Monday\n\nold text" for i, c in enumerate(["Regards", "Thanks", "Cheers", "Sincerely"] * 30)]
    small = fit(texts[:60], epochs=4)
    for model in (small, load_model()):
        same, n = agreement(model, texts[60:], hidden=1.0)
        assert same >= 0.95 * n


def test_edges():
    assert label_lines("") == [0] and label_lines("\n\n") == [0, 0, 0] and new_text(None) is None
    assert kinds("Hi Bob,\r\nDone.\r\n\r\n> old\r\n") == "nn q "


def test_frame(spark):
    df = spark.createDataFrame([(1, "Done.\n\n> old", 1), (1, "Done.\n\n> old", 1), (2, None, 1), (3, "", 1), (4, "word. " * 30000 + "\n> x", 1)], "row_id bigint, body string, line_no int")
    out = sorted((r.row_id, r.line_no, r.label) for r in foreign_lines(df, "row_id", "body").collect())
    assert out == [(1, 3, "quoted"), (1, 3, "quoted"), (4, 2, "quoted")]
    assert foreign_lines(df.limit(0), "row_id", "body").count() == 0
