import time

import pytest

from commitloom.llm.sentences import sentences, split_documents

CASES = [
    ["It took 5.5 s.", "Ask Mr. Kolmar or Mrs. Fennick about v. 2.3.4, e.g. the scheduler, i.e. it.", "Yes!"],
    ["See Sec. 58.204 of the guide, cf. also the notes by W. B. Briscoe, for the case.", "It rose approx. 3 % (see Fig. 2).", "fetch_x returns None.", "bind_y does not."],
    ['She asked "Did you restart it?" and closed the ticket.', '"It worked on 7.8.2." was all that Dr. Oduya wrote back.', "We could drop it ... but users depend on it.", "It crashed again?!", "The end"],
    ["The nightly job starts at 4 a.m.", "Tested with 7.1 on 5 hosts.", "Wait until 4 a.m. and it recovers.", "It was donated by Oduya Inc.", "Item No. 5 on the list is done.", "It took 0.13 s instead of 28.12 s.", "setting it hides the symptom."],
    ["Seit Version 2.6.0 tritt der Fehler z. B. beim Neustart auf.", "Am 3. Mai war alles leer usw. und nichts ging mehr.", "Die Antwort dauert ca. 13.6 Sekunden, d. h. zu lange.", "„Bei mir läuft es.“ schrieb Marchetto zurück.", "Der Wert stieg auf 2.514,75."],
    ["Cf. la page 387 du guide.", "« Chez moi, tout va bien. » a répondu Mme Tarnow.", "Il suffit de supprimer a.py !", "Pouvez-vous essayer avec 6.15.0 ?", "La réponse prend env. 9.91 secondes, p. ex. après."],
    ["¡No borres a.py!", "¿Alguien puede probarlo?", "«En mi equipo funciona.» respondió la Dra. Fennick.", "El pág. 630 explica el resto.", "Según el Sr. B, tarda aprox. 3 s."],
    ["Ответ занимает ок. 37.30 секунд, т. е. слишком долго.", "По словам г-на B. K. Терновского, дело в файле.", "«У меня работает.» — написал он в ответ.", "См. рис. 339 в руководстве.", "Ошибка видна и т. д. на всех узлах."],
    ["सेवा 407 मिनट बाद रुक जाती है।", "डॉ. Tarnow ने लिखा।", "क्या कोई इसे दोहरा सकता है?"],
    ["هل يمكن لأحد إعادة إنتاج الخطأ على 1.4.10؟", "كتب د. Marchetto أن الذاكرة ممتلئة.", "يستغرق الرد 34.16 ثانية!"],
]
GLUED = [
    ["“重启过吗？”“重启过。”两人都这样写。", "他说：“我这里没有问题。”然后就关闭了工单。", "（详见 host/a.conf。）", "这个改动影响两处（b，见图 268。），其余不变。", "日志里什么都没有……", "users 说：没有问题……但是不行。", "日志里什么都没有……", "版本 3.2.11 没有问题……但是 4.12.10 不行。", "怎么办？！", "有人能重现吗？"],
    ["「こちらでは動いています。」と返事が来ました。", "（詳細は a.conf を参照。）", "え、1.4.2 でもだめですか？！", "しばらく待つと…直ることもあります。", "A の設定（b.py、24 行目。）を確認してください。"],
]


@pytest.mark.parametrize("parts", CASES)
@pytest.mark.parametrize("gap", [" ", "  ", "\n"])
def test_prose(parts, gap):
    text = gap.join(parts)
    assert [text[a:b] for a, b in sentences(text)] == parts


@pytest.mark.parametrize("parts", CASES)
def test_wrapped_prose(parts):
    import textwrap

    text = textwrap.fill(" ".join(parts), 40, break_long_words=False, break_on_hyphens=False)
    assert [" ".join(text[a:b].split()) for a, b in sentences(text)] == [" ".join(p.split()) for p in parts]


@pytest.mark.parametrize("parts", GLUED)
def test_scripts_without_blanks(parts):
    text = "".join(parts)
    assert [text[a:b] for a, b in sentences(text)] == parts


def test_thai():
    parts = ["คิวพอร์ตโหนดฯลฯถูกลบไปหมด", "ระบบตอบช้ามากๆเมื่อมีคำขอเกินกว่า254ครั้ง", "ปัญหาอยู่ที่ไฟล์flavor/split_token.py", "เขาเขียนว่า“ไม่มีปัญหา”แล้วปิด"]
    for gap in (" ", "\n"):
        text = gap.join(parts)
        assert [text[a:b] for a, b in sentences(text)] == parts


def test_lines_that_are_no_prose():
    text = "Using the router\n======\n\nOne. Two\nthree.\n- Edit a.conf.\n2. Run it. Twice\n\n2014-08-07 10:57:05.164 77 TRACE a.b [r] Bad. Retrying\nTraceback (most recent call last):\n  File \"/a/b.py\", line 1, in c\n    self.x(y)\nIOError: x. Giving up\n\nOn Mon, someone wrote:\n> It is. So\n> it goes.\n> New one.\n\n10:52 <nick> First. Second.\n11:00 <nick> Third\n\nunfinished and\n\nClosed.\nCloses-Bug: #1. Yes\nChange-Id: I1\n---\n\u3000end\u00a0"
    want = ["Using the router", "One.", "Two\nthree.", "- Edit a.conf.", "2. Run it. Twice", "2014-08-07 10:57:05.164 77 TRACE a.b [r] Bad. Retrying", "Traceback (most recent call last):", 'File "/a/b.py", line 1, in c', "self.x(y)", "IOError: x. Giving up", "On Mon, someone wrote:", "> It is.", "So\n> it goes.", "> New one.", "10:52 <nick> First.", "Second.", "11:00 <nick> Third", "unfinished and", "Closed.", "Closes-Bug: #1. Yes", "Change-Id: I1", "end"]
    assert [text[a:b] for a, b in sentences(text)] == want


def test_bracketed_sentences():
    text = "One. (See also a.sh. It is the same.) Two (in short. Or not) ends. (Alone.) Last."
    assert [text[a:b] for a, b in sentences(text)] == ["One.", "(See also a.sh.", "It is the same.)", "Two (in short. Or not) ends.", "(Alone.)", "Last."]


def test_positions_cover_all_letters_once():
    text = "A b. C d! “E f?” he said. " * 50
    found = sentences(text)
    assert all(a < b for a, b in found) and all(x[1] <= y[0] for x, y in zip(found, found[1:]))
    assert sum(c.isalpha() for a, b in found for c in text[a:b]) == sum(map(str.isalpha, text))


def test_empty_and_long(spark):
    assert sentences(None) == sentences("") == sentences(" \n\t") == sentences("=====\n...") == []
    assert len(sentences("Go on. " * 30_000)) == 30_000
    df = spark.createDataFrame([(1, "A. B.", "xx"), (2, None, None), (3, "", "en"), (1, "A. B.", "xx")], "doc_id bigint, text string, start_pos string")
    rows = sorted(tuple(r) for r in split_documents(df).collect())
    assert rows == [(1, 0, 5), (1, 0, 5)] or len(rows) in (2, 4)
    assert split_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("He studies modern art. She left.", ["He studies modern art.", "She left."]),
        ("I did 100 abs. Then I slept.", ["I did 100 abs.", "Then I slept."]),
        ("See the ref. It is good.", ["See the ref.", "It is good."]),
        ("Nach Art. Fünf und Abs. Zwei der Verordnung ist das so. Gut.", ["Nach Art. Fünf und Abs. Zwei der Verordnung ist das so.", "Gut."]),
        ("Il faut voir le chap. Trois du livre. Merci.", ["Il faut voir le chap. Trois du livre.", "Merci."]),
    ],
)
def test_abbreviations_are_those_of_the_language(text, want):
    assert [text[a:b] for a, b in sentences(text)] == want


def test_time_grows_with_the_text():
    texts = ["\n".join(["and so the words of this line go on without an end to be seen"] * 16_000), "1.2.3." * 50_000, '" a b. ' * 20_000, "( a b. " * 20_000, "abc def " * 50_000 + "ไทย", "a.\n" + ")\n" * 20_000, "e.g. Art. 3 " * 5_000]
    for text in texts:
        start = time.perf_counter()
        sentences(text)
        assert time.perf_counter() - start < 3
