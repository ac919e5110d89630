import datetime as dt

import pytest

from commitloom.llm import pii

CASES = [
    ("Reported by Anna Miller <anna.miller+x@mail.example.org>.", [("Anna Miller", "NAME"), ("anna.miller+x@mail.example.org", "EMAIL")]),
    ("You can reach me at a.b at mail dot example dot com or call 1-415-555-0123 ext. 45.", [("a.b at mail dot example dot com", "EMAIL"), ("1-415-555-0123 ext. 45", "PHONE")]),
    ("mailto:ab(at)post(dot)test bounced, AB @ POST.TEST too", [("ab(at)post(dot)test", "EMAIL"), ("AB @ POST.TEST", "EMAIL")]),
    ("Clone git@git.example.org:a/b.git from rabbit@node-1 at 10.20.1.7, build 20140312-66, CVE-2014-0012, started at 1398765432.", []),
    ("call +49 (0)30 23125-699 or 01.99.00.93.07 or (702) 555-0105 or 0044 20 79460460", [("+49 (0)30 23125-699", "PHONE"), ("01.99.00.93.07", "PHONE"), ("(702) 555-0105", "PHONE"), ("0044 20 79460460", "PHONE")]),
    ("Frank admission: the driver counts 800-639 twice. Mark it as done and grant access. Bill of materials, will the build fix that?", []),
    ("I pasted SSN 963-73-1396 and passport no. YW7609297, tax id 90-1829390 by mistake", [("963-73-1396", "ID_NUMBER"), ("YW7609297", "ID_NUMBER"), ("90-1829390", "ID_NUMBER")]),
    ("national insurance number QQ 87 97 89 C, DNI 53430727J, driver's licence P347-0930-9460", [("QQ 87 97 89 C", "ID_NUMBER"), ("53430727J", "ID_NUMBER"), ("P347-0930-9460", "ID_NUMBER")]),
    ("Our lab sits at Flat 4, 36 Cobbler Close, Wyncote L16 6DZ.", [("Flat 4, 36 Cobbler Close, Wyncote L16 6DZ", "ADDRESS")]),
    ("at 25 rue des Tilleuls, 94715 Loxford or C/ San Telmo 79, 3º B, 22821 Brackwell", [("25 rue des Tilleuls, 94715 Loxford", "ADDRESS"), ("C/ San Telmo 79, 3º B, 22821 Brackwell", "ADDRESS")]),
    ("Birkenstraße 63, 75431 Falkenrode\nP.O. Box 6477, Loxford\n833 Heron St., Ostervale 82737", [("Birkenstraße 63, 75431 Falkenrode", "ADDRESS"), ("P.O. Box 6477, Loxford", "ADDRESS"), ("833 Heron St., Ostervale 82737", "ADDRESS")]),
    ("The street map layer and the avenue tile load in 3.4 s.", []),
    ("As Lukas wrote above, cc Miller, Anna and ANNA MILLER\nThanks, T. Miller", [("Lukas", "NAME"), ("Miller, Anna", "NAME"), ("ANNA MILLER", "NAME"), ("T. Miller", "NAME")]),
    ("", []), (" \n ", []), (None, []),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_places(text, want):
    assert [(text[a:b], k) for a, b, k in pii.find_pii(text)] == want


def test_redaction_keeps_the_rest():
    assert pii.redact("As Lukas wrote above, mail a@b.org!\r\n\tx") == "As <NAME> wrote above, mail <EMAIL>!\r\n\tx"
    assert pii.redact(None) is None and pii.redact("") == ""


def test_validators():
    assert pii.luhn("4539 1488 0343 6467") and not pii.luhn("4539 1488 0343 6468")
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB82 WEST 1234 5698 7654 33")
    assert pii.check_letter("12345678Z") and pii.check_letter("X1234567L") and not pii.check_letter("12345678A")


def test_very_long_text_in_linear_time():
    text = "word 12345 a.b c-d " * 20_000 + "call 415-555-0123"
    assert [text[a:b] for a, b, _ in pii.find_pii(text)] == ["415-555-0123"]


def test_operator(spark):
    t = [dt.datetime(2020, 1, i) for i in (1, 2, 3)]
    m = "array<struct<content:string,start_pos:int>>"
    rows = [("1", [("old a@b.org", 1)], t[0], None), ("1", [None, (None, 2), ("new c@d.org", 3)], t[1], None), ("1", [None, (None, 2), ("new c@d.org", 3)], t[1], None), ("2", [("x@y.org", 1)], t[0], None), ("2", None, t[1], True), ("3", None, t[0], None), ("4", [], t[0], False)]
    df = spark.createDataFrame(rows, f"id string, messages {m}, ingested_at timestamp_ntz, tombstone boolean")
    assert [tuple(r) for r in pii.pii_places(df).collect()] == [("1", 2, 4, 11, "EMAIL")]
    assert [tuple(r) for r in pii.redacted_messages(df).collect()] == [("1", 2, "new <EMAIL>")]
    assert pii.pii_places(df.limit(0)).count() == 0


#: Names of many languages, none of which any list of the operator holds.
GIVEN = "Siobhan Xiuying Fatima Aoife Chukwuemeka Ngozi Akira Rajeshwari Thandiwe Bartosz Eszter Gulnara Hyejin Ioannis Jadwiga Kwabena Lakshmi Mirela Nkechi Oyelaran Przemek Quynh Ragnhild Saoirse Tatsuya Ulrike Vasiliki Wambui Xochitl Yusuf Zsofia Anneliese Baraka Cosmin Dagny Ebrahim Feodora Goran Hamza Ignacy".split()
SURNAMES = "Gallagher Zhang Hassan Murphy Obi Adichie Tanaka Iyer Nkosi Kowalczyk Horvath Akhmetova Papadakis Boateng Subramaniam Ionescu Okafor Adeyemi Wisniewski Nguyen Haugland Byrne Yamamoto Lindqvist Kamau Hernandez Demir Kovacs Mwangi Popescu Sorensen Rahimi Petrova Jovanovic Siddiqui Zielinski O'Connor Al-Sayed Dvorak Quispe".split()
CONTEXTS = ["Reported by {} last week, on the second host.", "Signed-off-by: {} <{}@example.org>", "Please ask {} about it before the upgrade.", "It works now.\n\nThanks,\n{}\n", "We met {} there and looked at the logs.", "{} wrote: no, that is not the cause.", "Cc: {}", "Hi {},\nthe build is green again.", "According to {}, the index is stale.", "The owner of the volume, {} ({}@mail.example), has not answered.", "please contact {} for access", "I spoke with {} and the fix is in."]


def held_out():
    assert not any(pii._is_given(g) for g in GIVEN)
    for i in range(240):
        given, last = GIVEN[i % 40], SURNAMES[(i * 7 + i // 40) % 40]
        context = CONTEXTS[i % 12]
        yield f"{given} {last}", context.format(f"{given} {last}", given.lower())


def test_names_that_no_list_holds():
    cases = list(held_out())
    assert len({n for n, _ in cases}) >= 200
    found = sum((text.index(name), text.index(name) + len(name), "NAME") in pii.find_pii(text) for name, text in cases)
    assert found >= 0.9 * len(cases), found


@pytest.mark.parametrize("text", ["Reported by Volume Manager in the log.", "Hi All,\nwhat now?", "Dear Team,\nwe go on.", "Thanks to Red Hat for it.", "The Release Team wrote to Open Stack.", "Contact Support Group.", "The Metadata Proxy asked the metadata proxy twice.", "If Cold Shard fails, ask Cold Shard or another cold shard.", "We met Block Allocator issues: the block allocator failed."])
def test_what_is_no_person(text):
    assert pii.find_pii(text) == []


def test_checks_decide():
    def ids(text):
        return [text[a:b] for a, b, k in pii.find_pii(text) if k == "ID_NUMBER"]

    assert ids("my card is 4111 1111 1111 1111, he said") == ["4111 1111 1111 1111"]
    assert ids("my card is 4111 1111 1111 1112, he said") == [] == ids("the blocks 4111 1111 1111 1111 follow")
    assert ids("IBAN DE89 3704 0044 0532 0130 00 it is") == ["DE89 3704 0044 0532 0130 00"]
    assert ids("IBAN DE89 3704 0044 0532 0130 01 it is") == [] == ids("IBAN: DE89370400440532013001")
    assert ids("It ran twice. I pasted 932-52-2854 by mistake.") == ["932-52-2854"]


@pytest.mark.parametrize("address", ["Via Garibaldi 12, 20121 Milano", "Piazza della Repubblica 3, 50123 Firenze", "ul. Marszałkowska 10/5, 00-590 Warszawa", "Keizersgracht 221, 1016 DV Amsterdam", "Rua das Flores 45, 4050-262 Porto"])
def test_addresses_of_more_countries(address):
    text = f"It goes to {address}. Thank you."
    assert pii.find_pii(text) == [(11, 11 + len(address), "ADDRESS")]
