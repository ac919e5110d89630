"""Personal data in running text: places, kinds, and texts with typed placeholders.

Regular expressions propose spans; validators (the lengths of numbers, the Luhn
and mod-97 checks, the check letter of national numbers) and the words nearby
give every span a score, and the best spans that do not overlap stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import current_rows, undeleted
from .names import ORGANISATION, SHORT_FORMS, latin, skeleton

#: Spans that score less stay as they are.
THRESHOLD = 0.5
#: Characters on either side whose words adjust a score.
NEAR = 40

KINDS = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")

_LOCAL = r"(?<![\w.+\-@/])(?P<local>[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63})"
_LABEL = r"[A-Za-z0-9][A-Za-z0-9\-]{0,62}"
_DOT = r"(?:\.|[ \t]*[\[({<]dot[\])}>][ \t]*|[ \t]+dot[ \t]+)"
_SPELLED = r"(?:[ \t]*[\[({<]dot[\])}>][ \t]*|[ \t]+dot[ \t]+)"
EMAILS = (
    regex.compile(rf"{_LOCAL}(?:[ \t]?@[ \t]?|[ \t]*[\[({{<]at[\])}}>][ \t]*)(?P<host>{_LABEL}(?:{_DOT}{_LABEL}){{0,4}}{_DOT}[A-Za-z]{{2,24}})(?![\w@]|\.\w)"),
    regex.compile(rf"{_LOCAL}[ \t]+at[ \t]+(?P<host>{_LABEL}(?:{_SPELLED}{_LABEL}){{0,4}}{_SPELLED}[A-Za-z]{{2,24}})(?![\w@]|\.\w)"),
)
_SPELT_AT = regex.compile(r"[ \t]at[ \t]")
_BRACKETED_AT = regex.compile(r"[\[({<]at[\])}>]")
#: Accounts of machines.
MACHINES = frozenset("git root rabbit hg svn postgres mysql nobody daemon www-data ubuntu admin ssh hdfs".split())

_EXT = r"(?:[ ,;]*(?:ext\.?|extension|x|Durchwahl|poste|anexo)[ .:]*\d{1,6})?"
PHONE = regex.compile(
    rf"(?<![\w.+\-/:@#$%=])(?:"
    rf"(?P<intl>(?:\+|00)[ ]?[1-9]\d{{0,2}}(?:[ .\-/]?\(\d{{1,4}}\))?(?:[ .\-/]?\d{{1,8}}){{1,6}})"
    rf"|(?P<nanp>(?:1[ .\-])?(?:\([2-9]\d\d\)[ .\-]?|[2-9]\d\d[ .\-])[2-9]\d\d[ .\-]\d{{4}})"
    rf"|(?P<trunk>0\d{{1,4}}(?:[ .\-/]\d{{2,8}}){{1,5}}|\(0\d{{1,4}}\)[ .\-/]?\d{{2,8}}(?:[ .\-/]?\d{{2,8}}){{0,3}})"
    rf"|(?P<plain>[0-9][0-9 .\-]{{5,14}}[0-9])"
    rf"){_EXT}(?![\w\-/:@=]|\.\d)"
)
PHONE_WORDS = regex.compile(r"\b(?:tel|phone|call|ring|fax|mobile|cell|anrufen|telefon|téléphone|teléfono|llame|appelez|reach|contact|on the phone|whatsapp)\b", regex.I)
NUMBER_WORDS = regex.compile(r"\b(?:version|port|build|ticket|bug|block|counts?|twice|rows?|checksum|request id|requests?|hosts?|node|pid|step|lines?|bytes|timestamp|started at|epoch|serial|ean|isbn|CVE|MAC)\b", regex.I)

COUNTED = regex.compile(r"^[ ]?(?:block|twice|rows?|requests?|hosts?|nodes?|steps?|lines?|bytes|bugs?|builds?)\b")

#: What may be written before the number of a document of a person, by sort; fixed values.
ID_LABEL = (
    r"(?:passport(?: (?:no|number|nr|num|#))?|passeport|reisepass(?:nummer)?|pasaporte|SSN|social(?: security)?(?: (?:no|number))?|tax(?:payer)?(?: (?:id|number|no|file number))|TIN|ITIN|steuer(?:-?id|nummer)|NIF|DNI|NIE|"
    r"national (?:id|insurance)(?: (?:no|number))?|NINO?|insurance (?:no|number|id)|personal (?:code|number|identity number|id)|personnummer|personalausweis(?:nummer)?|identity (?:card|number)|id (?:card )?(?:no|number)|"
    r"driv(?:er'?s?|er’s|ing) licen[cs]e(?: (?:no|number))?|licen[cs]e (?:no|number)|führerschein(?:nummer)?|permis|health (?:card|insurance)(?: (?:no|number))?|policy (?:no|number)|numéro de sécurité sociale|número de la seguridad social|IBAN)"
)
LABELLED = regex.compile(rf"(?<!\w)(?:my |the |his |her |their )?{ID_LABEL}\.?[ \t]*(?:is|was|=|:|#)?[ \t]*(?P<id>[A-Z]{{0,3}}[ \-]?\d(?:[ \-./]?[0-9A-Z]){{4,20}})(?![\w])", regex.I)
SHAPES = {
    "ssn": regex.compile(r"(?<![\w.\-/])\d{3}([ \-])\d{2}\1\d{4}(?![\w\-/]|\.\d)"),
    "personal": regex.compile(r"(?<![\w.\-/])\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])[\-+]\d{4}(?![\w\-/]|\.\d)"),
    "tax": regex.compile(r"(?<![\w.\-/])9\d-\d{7}(?![\w\-/]|\.\d)"),
    "dni": regex.compile(r"(?<![\w.\-/])(?:\d{8}|[XYZ]\d{7})-?[A-HJ-NP-TV-Z](?![\w\-/])"),
    "nino": regex.compile(r"(?<![\w.\-/])[A-CEGHJ-PQR-TW-Z][A-CEGHJ-NPQR-TW-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D](?![\w\-/])"),
    "licence": regex.compile(r"(?<![\w.\-/])[A-Z]\d{3}-\d{4}-\d{4}(?![\w\-/])"),
    "passport": regex.compile(r"(?<![\w.\-/])[A-Z]{1,2}\d{7,8}(?![\w\-/])"),
    "iban": regex.compile(r"(?<![\w.\-/])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\w\-/])"),
    "card": regex.compile(r"(?<![\w.\-/])\d{4}(?:([ \-])\d{4}){3}(?![\w\-/])"),
}
ID_BASE = {"ssn": 0.55, "personal": 0.3, "tax": 0.25, "dni": 0.45, "nino": 0.6, "licence": 0.35, "passport": 0.2, "iban": 0.1, "card": 0.1}
ID_WORDS = regex.compile(rf"\b{ID_LABEL}\b", regex.I)
CARD_WORDS = regex.compile(r"\b(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta|carta)\b", regex.I)

_W = r"\p{Lu}[\p{L}'’\-]+"
_STREET = r"(?:Road|Rd|Street|St|Lane|Ln|Avenue|Ave|Close|Drive|Dr|Court|Ct|Place|Pl|Way|Terrace|Square|Sq|Boulevard|Blvd|Crescent|Row|Walk|Gardens|Hill|Grove|Mews|Parkway|Pkwy|Highway|Hwy)"
_UNIT = r"(?:Flat|Apt|Apartment|Unit|Suite|Ste|Room|Floor)\.? ?#?\w{1,6}"
_UKPOST = r"[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}"
_PREFIX = r"(?:New|San|Santa|Los|Las|Saint|Sankt|St\.|Bad|Port|Fort|El|La|Le|Les|Great|Upper|Lower|North|South|East|West|Mount|Lake|Old|Little|Long|Royal|Villa|Castel|Mont)"
_TOWN = rf"(?:{_PREFIX} )?{_W}(?:-{_W})*(?: (?:upon|on|am|an der|im|in der|sur|de la|de|del|sous) (?:{_PREFIX} )?{_W})?"
_ZIPTOWN = rf"(?:[A-Z]{{1,2}}-)?\d{{4,5}} {_TOWN}"
ADDRESS = regex.compile(
    rf"(?<![\w/.\-])(?:"
    rf"(?:{_UNIT},? )?\d{{1,5}}[A-Za-z]? (?:{_W} ){{1,4}}?{_STREET}\.?(?:,? {_UNIT})?,? {_TOWN}(?:,? (?:[A-Z]{{2}} )?(?:\d{{5}}(?:-\d{{4}})?|{_UKPOST}))?(?![\w])"
    rf"|\d{{1,4}}(?: ?(?:bis|ter))?,? (?:rue|avenue|boulevard|place|chemin|allée|quai|impasse|route|cours|square) (?:(?:des|de la|de l['’]|du|de|d['’]|aux) ?)?{_W}(?:[ \-](?:et|de|des|du|la|le|{_W}))*,? {_ZIPTOWN}"
    rf"|(?:(?:Am|An der|An den|Auf der|Auf dem|Im|In der|Zum|Zur|Unter den|Hinter der|Alte|Alter|Neue|Neuer|Große|Kleine) )?\p{{Lu}}[\p{{L}}\-]*(?:straße|strasse|str\.|allee|gasse|weg|platz|ring|damm|ufer|markt|steig|graben) \d{{1,4}}[a-z]?,? {_ZIPTOWN}"
    rf"|(?:Am|An der|An den|Auf der|Auf dem|Im|In der|Zum|Zur|Unter den|Hinter der) {_W} \d{{1,4}}[a-z]?,? {_ZIPTOWN}"
    rf"|(?:C/|Calle|Avda\.?|Avenida|Av\.|Plaza|Paseo|Ronda|Camino|Carrera) ?(?:(?:del|de la|de los|de las|de) )?{_W}(?:[ \-](?:de|del|la|{_W}))*,? (?:n[.º°]? ?)?\d{{1,4}}(?:,? \d{{1,2}}[ºª°](?: ?[A-Z]\b)?)?,? {_ZIPTOWN}"
    rf"|(?:Via|Viale|Piazza|Piazzale|Corso|Largo|Vicolo|Vico|Strada) (?:(?:della|delle|dello|degli|del|dei|di|dell['’]|d['’]) ?)?{_W}(?: (?:e|di|del|della|{_W}))*,? (?:n[.º°]? ?)?\d{{1,4}}(?:/?[A-Za-z])?,? (?:\d{{5}} {_TOWN}|{_TOWN})(?: \([A-Z]{{2}}\))?"
    rf"|(?:ul\.|ulica|al\.|aleja|pl\.|plac|os\.) ?{_W}(?: {_W})* \d{{1,4}}[A-Za-z]?(?:/\d{{1,4}})?(?: m\. ?\d{{1,4}})?,? \d{{2}}-\d{{3}} {_TOWN}"
    rf"|\p{{Lu}}[\p{{L}}\-]*(?:straat|laan|plein|gracht|kade|dijk) \d{{1,4}}[a-z]?,? \d{{4}} ?[A-Z]{{2}} {_TOWN}"
    rf"|(?:Rua|Travessa|Praça|Largo|Avenida|Estrada) (?:(?:do|da|dos|das|de) )?{_W}(?: (?:e|de|do|da|dos|das|{_W}))*,? (?:n\.?[º°]? ?)?\d{{1,4}},? \d{{4}}-\d{{3}} {_TOWN}"
    rf"|(?:P\. ?O\.? ?|PO |Post Office |Postfach |B\.?P\.? |Apartado |Casilla )(?:Box |de Correos )?\d{{1,6}},? (?:{_ZIPTOWN}|{_TOWN}(?:,? (?:[A-Z]{{2}} )?(?:\d{{5}}(?:-\d{{4}})?|{_UKPOST}))?(?![\w]))"
    rf")"
)

#: Given names that are common words, so that a context must tell.
WORDLIKE = frozenset("mark grant frank chase bill will rich pat nat art may june april dawn hope grace rose ivy jack rob drew sue dick kit ned ted beth meg tori chuck joy faith miles max guy ray gene dean earl glen cliff rusty sandy penny ruby pearl amber jade iris daisy lily violet heather holly robin jay reed lane wade dale gale".split())
#: Further common given names.
MORE_NAMES = frozenset("mary linda barbara sarah karen nancy lisa betty sandra ashley kimberly emily donna michelle carol amanda melissa deborah sharon cynthia kathleen amy angela shirley brenda pamela nicole samantha christine debra rachel carolyn janet ruth heather diane virginia julie joyce olivia kelly christina lauren joan evelyn judith megan cheryl andrea hannah martha jacqueline frances gloria ann jean alice kathryn teresa doris sara janice julia marie madison judy ronald timothy jason jeffrey ryan jacob gary eric jonathan larry justin scott brandon frank raymond gregory joshua jerry dennis walter patrick peter harold douglas henry carl arthur roger kevin brian kenneth steven edward ronald mark donald paul george".split()) - WORDLIKE
GIVEN = frozenset(skeleton(f) for n, fs in SHORT_FORMS.items() for f in (n, *fs.split())) | {skeleton(n) for n in MORE_NAMES}
WEAK = frozenset(skeleton(n) for n in WORDLIKE)
#: Words in lower case that stand after a given name and are no surname.
NO_SURNAME = frozenset("wrote told said asked reported thinks says has had was is and or told who with from about for by to in on at of not also can could will would should may might sees found fixed broke tested sent thanks please y e und et el la le schrieb sagte a que oder ou dijo bitte via after before their his her the".split())
_NAMEWORD = r"(?:\p{Lu}[\p{L}'’]+(?:-\p{Lu}[\p{L}'’]+)*)"
_INITIALS = r"(?:\p{Lu}\.[ ]?){1,3}"
TOKEN = regex.compile(r"\p{Lu}\.(?=[\s\p{Lu}]|$)|[\p{L}][\p{L}'’]*(?:-[\p{L}'’]+)*")
#: Words before or after a name.
NAME_BEFORE = regex.compile(r"(?:\b(?:as|thanks|thank you|cheers|cc|contact(?:er)?|según|laut|selon|secondo|reported by|signed[- ]off[- ]by|attention of|attn|copy|regards|hi|hello|dear|by|from|user|name|named|called|mr|mrs|ms|dr|herr|frau|mme|sr|sra)[.,:]?|--|[,;:|]|\band|^)\s*$", regex.I | regex.M)
NAME_AFTER = regex.compile(r"^\s*(?:wrote|told|said|asked|reported|thinks|[<(;|,.]|$|and\b)", regex.I | regex.M)
#: What stands before a person and hardly before anything else.
CUE_BEFORE = regex.compile(
    r"(?:\b(?:reported|signed[- ]off|reviewed|tested|acked|approved|suggested|submitted|written|authored|assigned|filed|raised|opened|sent|signed|posted|spotted|noticed|fixed|seen)[- ](?:by|to)"
    r"|\b(?:mr|mrs|ms|miss|dr|prof|herr|frau|mme|mlle|sig|sr|sra|dra|pan|pani)\.?|\b(?:my|his|her|their|whose|full|the user'?s?) name(?: is| was)?|\b(?:name|named|i am|i'm|this is|c/o|cc|attn|attention of|to the attention of|copy|copy to)"
    r"|\b(?:contact|contacter|contactar|ask|asked|tell|told|met|ping|pinged|email|emailed|mail|call|phone|thank|credit|credits to|kudos to|according to|selon|laut|según|secondo|spoke (?:to|with)|talked to|works with|help from|patch from|report from)"
    r"|\b(?:dear|hi|hello|hey|thanks|thanks to|thank you|many thanks|cheers|regards|best|merci|gracias|danke|grazie|grüße|gruß|cordialement|saludos|saluti)[,!]?"
    r"|^(?:author|owner|assignee|reporter|reviewer|maintainer|from|to|user|customer|client|employee|submitter)|\b(?:our user|user|customer|employee|colleague|maintainer|developer))\s?:?[ \t]*\n?[ \t]*$",
    regex.I | regex.M,
)
CUE_AFTER = regex.compile(r"^(?:,?[ \t]*[<(\[]|[ \t]*[;|,\t][ \t]*)[^<>()\[\]\s;|,]+(?:@|[ ]?[\[({]at[\])}])|^,?[ \t]*(?:(?:wrote|writes|said|says|told|asked|reported|reports|thinks|noticed|confirmed|schrieb|escribió|ha scritto|a écrit|tel\.?|phone)\b)", regex.I)
MAIL_AFTER = regex.compile(r"^[ \t]*[<(\[;|,][ \t]*(?P<local>[\w.+\-]+)(?:@|[ ]?[\[({<]at[\])}>])")
WEAK_BEFORE = regex.compile(r"\b(?:by|from|with|and|to|for|of|von|par|por|da|di|et|und|y)[ \t]+$", regex.I)
GREETED = regex.compile(r"(?:^|[\n.!?>][ \t]*)(?:dear|hi|hello|hey|thanks|thank you|cheers|regards|best|merci|gracias|danke|grazie)(?:,|\b)[ \t]*\n?[ \t]*", regex.I)
#: Small words inside names, and words in capitals that tell that something else than a person is named.
PARTICLES = frozenset("de da di do dos das del della der den van von zu la le el al bin ibn ben y e".split())
NO_PERSON = frozenset("team project manager server service group department support release core engine driver api cloud linux windows ubuntu debian fedora foundation list lists community committee board office bank university institute college school hospital street road monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december north south east west new old red open free big small english german french spanish italian chinese sir madam folks everyone guys there people you hi hello hey dear thanks cheers regards best contact ask tell ping thank copy from reported according".split()) | frozenset(ORGANISATION)
_PART = r"\p{Lu}(?:[\p{Ll}\p{M}]+|['’]\p{Lu}[\p{Ll}\p{M}]+)(?:[\-'’]?\p{Lu}?[\p{Ll}\p{M}]+)*"
SHAPED = regex.compile(rf"(?<![\w@/.\-'’_]){_PART}(?:[ \t](?:{_PART}|\p{{Lu}}\.|{'|'.join(sorted(PARTICLES))})(?![\w'’]))*[ \t]{_PART}(?![\w@/(=_\-]|\.\w|['’]\p{{L}})")
TURNED = regex.compile(rf"(?<![\w@/.\-'’_]){_PART}(?:[ \t\-]{_PART})?,[ \t](?:{_PART}|\p{{Lu}}\.)(?:[ \t]?(?:\p{{Lu}}\.|{_PART}))?(?![\w@/(=_\-]|\.\w|['’]\p{{L}})")
CAPITALS = regex.compile(r"(?<![\w@/.\-'’_])\p{Lu}[\p{Lu}'’\-]+(?:[ \t]\p{Lu}\.)?(?:[ \t]\p{Lu}[\p{Lu}'’\-]{2,})+(?![\w@/(=_\-]|\.\w)")
ALONE = regex.compile(rf"(?<![\w@/.\-'’_]){_PART}(?=[ \t]*(?:[,!\n]|$))")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed([c for c in number if c.isdigit()])):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = "".join(c for c in iban if c.isalnum()).upper()
    return len(s) >= 15 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def check_letter(dni: str) -> bool:
    s = dni.replace("-", "")
    digits = s[:-1].translate(str.maketrans("XYZ", "012"))
    return digits.isdigit() and "TRWAGMYFPDXBNJZSQVHLCKE"[int(digits) % 23] == s[-1]


def _refuted(number: str) -> bool:
    """Whether a number has the form of an account or a card but fails its check: then it is none, whatever stands before it."""
    return (SHAPES["iban"].fullmatch(number) is not None and not mod97(number)) or (SHAPES["card"].fullmatch(number) is not None and not luhn(number))


def _near(text: str, a: int, b: int) -> tuple[str, str]:
    return text[max(0, a - NEAR) : a], text[b : b + NEAR]


_BREAK = regex.compile(r"[.!?;][ \t]|\n")


def _clause(before: str) -> str:
    """What stands in the same sentence."""
    return _BREAK.split(before)[-1]


def _emails(text: str) -> Iterator[tuple[float, int, int, str]]:
    signed = "@" in text or _BRACKETED_AT.search(text) is not None
    for m in (m for e, may in zip(EMAILS, (signed, _SPELT_AT.search(text))) if may for m in e.finditer(text)):
        score = 0.9
        after = text[m.end() : m.end() + 2]
        if m["local"].lower() in MACHINES:
            score -= 0.6
        if regex.match(r":[\w/]", after):
            score -= 0.5  # a path on a host
        yield score, m.start("local"), m.end("host"), "EMAIL"


def _phones(text: str) -> Iterator[tuple[float, int, int, str]]:
    for m in PHONE.finditer(text):
        kind = m.lastgroup
        body = m[kind]
        digits = regex.sub(r"\D", "", body)
        a, b = m.start(), m.end()
        before, after = _near(text, a, b)
        score = {"intl": 0.75, "nanp": 0.7, "trunk": 0.6, "plain": 0.15}[kind]
        if not 7 <= len(digits) <= 15 or (kind in ("intl", "trunk") and len(digits) < 9):
            score -= 0.5
        if kind == "plain" and (regex.fullmatch(r"\d{4}-\d\d-\d\d.*|\d+(?:\.\d+){1,3}|\d{1,4}", body) or len(digits) < 9):
            score -= 0.5
        if kind == "trunk" and len(digits) > 12:
            score -= 0.4
        if PHONE_WORDS.search(before[-25:]) or PHONE_WORDS.search(after[:15]):
            score += 0.3
        if NUMBER_WORDS.search(_clause(before[-18:])) or COUNTED.search(after):
            score -= 0.35
        if ID_WORDS.search(before[-30:]):
            score -= 0.4
        yield score, a, b, "PHONE"


def _ids(text: str) -> Iterator[tuple[float, int, int, str]]:
    for m in LABELLED.finditer(text):
        a, b = m.span("id")
        value = m["id"]
        exact = next((s.match(text, a) for s in SHAPES.values() if s.match(text, a)), None)
        if exact:
            b = exact.end()
        else:
            cut = regex.match(r"[A-Za-z]{0,3}[ \-]?\d[\dA-Z]*(?:[ \-./](?:\d[\dA-Z]*|[A-Z](?![\w])))*", value)
            b = a + cut.end() if cut else b
        if sum(c.isdigit() for c in text[a:b]) >= 5 and not _refuted(text[a:b]):
            yield 0.95, a, b, "ID_NUMBER"
    for name, shape in SHAPES.items():
        for m in shape.finditer(text):
            a, b = m.span()
            before, after = _near(text, a, b)
            score = ID_BASE[name]
            score += 0.4 * bool(ID_WORDS.search(before[-35:]))
            score -= 0.35 * bool(NUMBER_WORDS.search(_clause(before[-18:])) or COUNTED.search(after))
            if name == "dni":
                score += 0.3 * check_letter(m.group())
            elif name == "personal":
                score += 0.25 * luhn(m.group())
            elif _refuted(m.group()):
                continue
            elif name == "iban":
                score += 0.6
            elif name == "card":
                score += 0.25 + 0.3 * bool(CARD_WORDS.search(before) or CARD_WORDS.search(after[:20]))
            yield score, a, b, "ID_NUMBER"


def _addresses(text: str) -> Iterator[tuple[float, int, int, str]]:
    for m in ADDRESS.finditer(text):
        yield 1.5, m.start(), m.end(), "ADDRESS"  # whole addresses hold words that may be names


def _is_given(word: str) -> int:
    """2 for a given name, 1 for one that is also a common word, 0 else."""
    s = skeleton(latin(word).replace("'", ""))
    return 1 if s in WEAK else 2 if s in GIVEN else 0


#: A verb at the begin of a sentence that follows a name without a full stop.
_VERB = regex.compile(r"\p{Lu}\p{Ll}+(?:ing|ed) (?:to|from|with|in|on|it|the|an?|this|that|\p{Ll}+[/_])|\p{Lu}\p{Ll}+ (?:it|the|an?|this|that) ")
_INITIAL = regex.compile(r"\p{Lu}\.")
_COMMA = regex.compile(r",[ \t]")
_GAP = regex.compile(r"[ \t]{1,2}|(?<=\.)")
_JOINED = regex.compile(r"[\w@/.+=&?-]")
_JOINS = regex.compile(r"[\w@/(=]|\.\w|-\w")


def _names(text: str) -> Iterator[tuple[float, int, int, str]]:
    tokens = list(TOKEN.finditer(text))
    i = 0
    while i < len(tokens):
        t = tokens[i]
        word = t.group()
        if not word[0].isupper() or _JOINED.match(text, max(0, t.start() - 1), t.start()) or (_JOINS.match(text, t.end(), t.end() + 2) and not word.endswith(".")):
            i += 1
            continue
        used, strength = _take_name(text, tokens, i)
        if not used:
            i += 1
            continue
        a, b = t.start(), tokens[i + used - 1].end()
        before, after = _near(text, a, b)
        if text[b - 1] == "." and used and _INITIAL.fullmatch(tokens[i + used - 1].group()) and used == 1:
            i += 1
            continue
        score = strength + 0.25 * bool(NAME_BEFORE.search(before)) + 0.2 * bool(NAME_AFTER.search(after))
        if _sentence_start(before) and not NAME_AFTER.search(after):
            score -= 0.3
        if score < THRESHOLD:
            i += 1
            continue
        yield score, a, b, "NAME"
        i += used


class _Words:
    """Which words of a text are ordinary ones; what it writes small is looked up only when asked for."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.small: frozenset[str] | None = None

    def ordinary(self, word: str) -> bool:
        """Whether a word in capitals is a common one, or one that the same text also writes small."""
        w = word.lower()
        if w in _COMMON or w in NO_PERSON:
            return True
        if self.small is None:
            self.small = frozenset(_SMALL.findall(self.text))
        return w in self.small


def _shaped(text: str) -> Iterator[tuple[float, int, int, str]]:
    """Names that no list knows: two or more words in capitals whose surroundings speak of a person, and their repetitions."""
    ordinary = _Words(text).ordinary
    sure: set[str] = set()
    found = []
    for m in SHAPED.finditer(text):
        a, b = m.span()
        parts = [(p.group(), a + p.start(), a + p.end()) for p in _PIECES.finditer(m.group())]
        while parts and (parts[0][0] in PARTICLES or ordinary(parts[0][0])):
            parts.pop(0)  # the word that begins the sentence
        stop = next((i for i, p in enumerate(parts) if p[0] not in PARTICLES and not p[0].endswith(".") and (ordinary(p[0]) or (i > 1 and (p[0].lower() in WORDLIKE or _VERB.match(text, p[1]))))), len(parts))
        parts = parts[:stop]
        while parts and (parts[-1][0] in PARTICLES or parts[-1][0].endswith(".")):
            parts.pop()
        if not 2 <= len(parts) <= 5 or sum(p[0] not in PARTICLES for p in parts) < 2:
            continue
        a, b = parts[0][1], parts[-1][2]
        before, after = _near(text, a, b)
        score = 0.2 + 0.4 * bool(CUE_BEFORE.search(before)) + 0.35 * bool(CUE_AFTER.search(after)) + 0.1 * bool(WEAK_BEFORE.search(before)) + 0.15 * (not _sentence_start(before))
        if len(parts) > 2:
            score += 0.25  # an initial and a surname in it are less likely the name
        found.append((score, a, b))
        if score >= THRESHOLD:
            sure.add(text[a:b])
    for shape in (TURNED, CAPITALS):
        for m in shape.finditer(text):
            a, b = m.span()
            if not any(ordinary(p) for p in _LETTERS.findall(m.group())):
                before, after = _near(text, a, b)
                found.append((0.2 + 0.4 * bool(CUE_BEFORE.search(before)) + 0.35 * bool(CUE_AFTER.search(after)), a, b))
    for score, a, b in found:
        if score >= THRESHOLD or text[a:b] in sure:
            yield max(score, THRESHOLD), a, b, "NAME"
    for g in GREETED.finditer(text):
        m = ALONE.match(text, g.end())
        if m and not ordinary(m.group()):
            yield 0.55, m.start(), m.end(), "NAME"
    if "@" in text or "at" in text:
        for m in BEFORE_MAIL.finditer(text):
            mail = MAIL_AFTER.match(text[m.end() : m.end() + 2 * NEAR])
            if mail and not ordinary(m.group()) and latin(m.group()) in mail["local"].lower():
                yield 0.55, m.start(), m.end(), "NAME"


_LETTERS = regex.compile(r"[\p{L}'’]+(?!\.)")
BEFORE_MAIL = regex.compile(rf"(?<![\w@/.\-'’_]){_PART}(?=[ \t]*[<(\[;|,])")
_SMALL = regex.compile(r"(?<![\p{L}\p{M}\p{N}_.@/+\-;|<(])\p{Ll}[\p{Ll}\p{M}]{2,}(?![\p{L}\p{N}_@/+\-;|]|\.[\p{L}\p{N}])")
_PIECES = regex.compile(r"\S+")


def _sentence_start(before: str) -> bool:
    return not before.strip() or regex.search(r"[.!?:\n]\s*$", before) is not None


def _adjacent(text: str, left: regex.Match, right: regex.Match, comma: bool = False) -> bool:
    return (_COMMA if comma else _GAP).fullmatch(text, left.end(), right.start()) is not None


def _take_name(text: str, tokens: list, i: int) -> tuple[int, float]:
    """How many tokens from the i-th on are one name, and how sure that is."""
    n = len(tokens)
    word = tokens[i].group()
    initial = _INITIAL.fullmatch(word) is not None
    # Surname, Given or Surname, I.
    if not initial and i + 1 < n and _adjacent(text, tokens[i], tokens[i + 1], True) and not _is_given(word) and word.lower() not in _COMMON:
        nxt = tokens[i + 1].group()
        if nxt[0].isupper() and (_is_given(nxt) == 2 or (_INITIAL.fullmatch(nxt) and NAME_BEFORE.search(_near(text, tokens[i].start(), 0)[0]))):
            k = 2
            while i + k < n and _adjacent(text, tokens[i + k - 1], tokens[i + k]) and _INITIAL.fullmatch(tokens[i + k].group()):
                k += 1
            return k, 0.7
    given = 0 if initial else _is_given(word)
    if initial:
        k = 1
        while i + k < n and _adjacent(text, tokens[i + k - 1], tokens[i + k]) and _INITIAL.fullmatch(tokens[i + k].group()):
            k += 1
        if i + k < n and _adjacent(text, tokens[i + k - 1], tokens[i + k]):
            last = tokens[i + k].group()
            if last[0].isupper() and len(last) >= 3 and last.lower() not in _COMMON:
                return k + 1, 0.5
        return 0, 0.0
    # Given, initials, further given names, surname
    if not given:
        # Surname Given, in that order
        if i + 1 < n and _adjacent(text, tokens[i], tokens[i + 1]) and _is_given(tokens[i + 1].group()) == 2 and len(word) > 3 and tokens[i + 1].group()[0].isupper() and NAME_BEFORE.search(_near(text, tokens[i].start(), 0)[0]) and word.lower() not in _COMMON:
            return 2, 0.45
        return 0, 0.0
    k = 1
    while i + k < n and _adjacent(text, tokens[i + k - 1], tokens[i + k]):
        nxt = tokens[i + k].group()
        if _INITIAL.fullmatch(nxt):
            if i + k + 1 < n and _adjacent(text, tokens[i + k], tokens[i + k + 1]) and tokens[i + k + 1].group()[0].isalpha():
                k += 1
                continue
            break
        if _VERB.match(text, tokens[i + k].start()):
            break
        if nxt[0].isupper() and len(nxt) > 1 and not regex.match(r"[_@/(=]|\.\w", text[tokens[i + k].end() : tokens[i + k].end() + 2]) and nxt.lower() not in _COMMON:
            k += 1
            if not _is_given(nxt):
                break
            continue
        if nxt[0].islower() and len(nxt) >= 4 and nxt not in NO_SURNAME and nxt not in _COMMON and regex.match(r"\s*(?:$|\n|\p{Lu}|[<(;|,.])|\s+(?:wrote|told|said|asked|reported|and)\b", text[tokens[i + k].end() : tokens[i + k].end() + NEAR]):
            k += 1
        break
    while k > 1 and _INITIAL.fullmatch(tokens[i + k - 1].group()):
        k -= 1  # an initial without a surname is the end of a sentence
    if given == 2:
        return k, 0.75 if k > 1 else 0.55
    return k, 0.45 if k > 1 and tokens[i + k - 1].group()[0].isupper() else 0.1


#: Words that begin sentences or follow names and are no parts of names.
_COMMON = frozenset("box floor room unit flat reviewed committed change changes our some last sorry ok hm each every many few several other more less please all any none nobody everybody something anything here según laut selon merci bitte contacter gracias danke the a an this that these those it in on at as if when while after before and or but so then we i you they he she could would please note such most some each no not does do did is are was were has have had let use see out without both two item version error my our your thanks tel phone fax mail email regards best cheers contact reported row call ship mark grant chase why what how there here from to by with for using notes cc re fwd ps also wait only just now such nothing last too".split())


def find_pii(text: str | None) -> list[tuple[int, int, str]]:
    """Places ``start, end, kind`` of personal data, in order; none for null and blank texts."""
    if not text or not text.strip():
        return []
    found = [x for f in (_emails, _phones, _ids, _addresses, _names, _shaped) for x in f(text) if x[0] >= THRESHOLD]
    out: list[tuple[int, int, str]] = []
    for score, a, b, kind in sorted(found, key=lambda x: (-x[0], x[1] - x[2], x[1])):
        if all(b <= c or a >= d for c, d, _ in out):
            out.append((a, b, kind))
    return sorted(out)


def redact(text: str | None, places: list[tuple[int, int, str]] | None = None) -> str | None:
    """The text with ``<KIND>`` in the place of each piece, all else unchanged."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, kind in places if places is not None else find_pii(text):
        out += [text[at:a], f"<{kind}>"]
        at = b
    return "".join([*out, text[at:]])


def _spread(messages: DataFrame, keep_text: bool) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if keep_text:
                rows = [(k, p, redact(t)) for k, p, t in zip(f["k"], f["p"], f["t"])]
                yield pd.DataFrame(rows, columns=["bug_id", "msg_pos", "content"])
            else:
                rows = [(k, p, a, b, kind) for k, p, t in zip(f["k"], f["p"], f["t"]) for a, b, kind in find_pii(t)]
                yield pd.DataFrame(rows, columns=["bug_id", "msg_pos", "start_pos", "end_pos", "kind"])

    return messages.mapInPandas(run, "bug_id string, msg_pos int, content string" if keep_text else "bug_id string, msg_pos int, start_pos int, end_pos int, kind string")


def bug_messages(bugs: DataFrame, content: Column | None = None) -> DataFrame:
    """``k, p, t``: the messages of the current, undeleted rows of bugs; positions count null elements."""
    now = undeleted(current_rows(bugs.select("id", "messages", "ingested_at", "tombstone"), ["id"]))
    said = now.select(F.col("id").alias("k"), F.posexplode("messages").alias("p", "m")).select("k", "p", F.col("m.content").alias("t"))
    return said.filter(F.col("t").isNotNull())


def pii_places(bugs: DataFrame) -> DataFrame:
    """``bug_id, msg_pos, start_pos, end_pos, kind``: one row per piece of personal data.

    Null messages and contents give no rows but count for positions.  Texts are
    searched whole.  Pieces never overlap: the better founded wins, then the
    longer, then the earlier.
    """
    return _spread(bug_messages(bugs), False)


def redacted_messages(bugs: DataFrame) -> DataFrame:
    """``bug_id, msg_pos, content`` with typed placeholders; all else is unchanged."""
    return _spread(bug_messages(bugs), True)
