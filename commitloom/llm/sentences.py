"""Sentence boundaries across languages and scripts.

Lines are told apart first: running prose may be wrapped over several lines,
every other line (headings, list items, logs, code, trailers) is one sentence.
Within prose the Unicode sentence-break classes find every terminator of every
script; abbreviations of the language, initials, ordinals and ellipses suppress a
break, and brackets and quotations that open before a terminator decide whether the
sentence goes on after they close.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Abbreviations that never end a sentence, by language; those under "all" are used across languages.
ABBREVIATIONS = {
    "all": "e.g i.e cf vs al fig figs dr prof mr mrs ms jan feb apr jun jul aug sept sep oct nov dec",
    "en": "ca approx sec eq chap vol pp st mt messrs viz resp gen col lt sgt capt rev hon gov sen",
    "de": "z.b d.h u.a o.ä i.d.r bzw ggf evtl inkl exkl ca nr str hr fr abs bd vgl sog ehem art st ing dipl aufl hrsg mio mrd tel",
    "fr": "p.ex env mm mme mmes mlle mlles art chap vol éd av bd st ste ca",
    "es": "sr sres sra sras srta dra ud uds pág págs aprox p.ej núm art ej cap vol avda ca",
    "it": "sig sig.ra dott pag pagg art cap ecc es vol",
    "pt": "sr sra dra pág págs art ex núm vol av",
    "nl": "bijv blz d.w.z dhr mevr nr o.a art ca enz",
    "ru": "т.е т.к т.н ок рис см стр им ул г-н г-жа напр др.рис гл проф акад",
    "hi": "डॉ श्री",
    "ar": "د",
}
#: Function words that tell the languages of Latin script.
FUNCTION_WORDS = {
    "en": "the and of to is was are that this with for it in on be not as by from which you have has i he she they we his her did when then",
    "de": "der die das und ist nicht mit ein eine den dem des auf für zu von es im wird bei auch nach sich ich",
    "fr": "le la les et des est une dans pour pas que qui sur avec du au ne ce cette il par nous vous",
    "es": "el la los las y de que en un una es por con para se del lo como más pero su este está",
    "it": "il lo gli e di che non per una con sono della del nel alla si è anche",
    "pt": "o os e de que não uma para com em da dos das é mais foi",
    "nl": "de het een en van is niet dat met op voor zijn te aan ook naar wordt bij",
}
#: Letters that tell them too.
LETTERS = {"de": "äöüß", "fr": "àâçèéêëîïôùûœ", "es": "áéíóúñ¿¡", "it": "àèéìòù", "pt": "áâãçéêíóôõú"}
_LANGUAGES: dict[str, set[str]] = {}
for _language, _words in ABBREVIATIONS.items():
    for _word in _words.split():
        _LANGUAGES.setdefault(_word, set()).add(_language)
_TELLS: dict[str, set[str]] = {}
for _language, _words in FUNCTION_WORDS.items():
    for _word in _words.split():
        _TELLS.setdefault(_word, set()).add(_language)
for _language, _letters in LETTERS.items():
    for _letter in _letters:
        _TELLS.setdefault(_letter, set()).add(_language)
#: Abbreviations that suppress a break only before a number.
BEFORE_NUMBER = frozenset("v n s no nos nr p art para max min vol num fig sec".split())
#: Abbreviations that suppress a break unless a capital, a digit or a quote follows.
UNLESS_CAPITAL = frozenset("a.m p.m etc usw inc ltd corp co jr sr u.s u.k т.д т.п др пр etc.".split()) - {"sr"}
#: Words in lower case that go on a sentence after an abbreviation at its possible end.
GOES_ON = frozenset("and or but nor so yet the a an to of in on at by for from with without until till when while if is are was were be has had that which who because as than then und oder aber sowie et ou mais y o pero и или но а".split())
#: Months, which make a number with a full stop an ordinal.
MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember jänner".split())
#: Words after an ellipsis in scripts without letter case that go on the sentence.
AFTER_ELLIPSIS = regex.compile(r"但是|但|可是|不过|然而|而且|而|所以|因此|于是|然后|就|还|也|却|并|或|和|が|けど|でも|しかし|そして")

_TERM = r"\p{SB=STerm}\p{SB=ATerm}…⋯"
EVENT = regex.compile(rf"(?P<term>(?:[ \u00a0\u202f](?=[!?;](?:\s|$|[»”\"])))?[{_TERM}]+)|(?P<open>[(\[{{（［｛【〔「『《〈«‹„‚“‘“])|(?P<close>[)\]}}）］｝】〕」』》〉»›”’])|(?P<quote>\")|(?P<blank>\s+)")
#: The same without blanks, for runs in which they part nothing.
MARK = regex.compile(EVENT.pattern.rsplit("|", 1)[0])
CLOSERS = regex.compile(r"(?:[\u00a0\u202f ]?[»›]|[\"'”’“)\]}）］｝】〕」』》〉])+")
PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "｛": "｝", "【": "】", "〔": "〕", "「": "」", "『": "』", "《": "》", "〈": "〉", "«": "»", "‹": "›", "„": "“", "‚": "‘", "“": "”", "‘": "’"}
BRACKETS = frozenset("([{（［｛【〔")
WIDE = regex.compile(r"[\p{Script=Han}\p{Script=Hiragana}\p{Script=Katakana}]")
#: Scripts in which blanks part sentences, as nothing else does.
UNMARKED = regex.compile(r"[\p{Script=Thai}\p{Script=Lao}\p{Script=Khmer}\p{Script=Myanmar}]")
#: Characters before an abbreviation, and half as many after it, whose words tell its language.
AROUND = 120
#: Characters of a line from which on it may be wrapped, in scripts without blanks between words.
WRAPPED = 100
ALNUM = regex.compile(r"[\p{L}\p{N}]")
#: The word before a full stop, with the parts of an abbreviation of several (z. B., F. E.).
WORD_BEFORE = regex.compile(r"(?:(?<![\p{L}\p{M}\p{N}_.\-])\p{L}{1,2}\.\s{0,2})*[\p{L}\p{M}\p{N}'’\-]+$")

# kinds of lines
QUOTED = regex.compile(r"[ \t]*(?:>[ \t]?)+")
CHAT = regex.compile(r"[ \t]*(?:\[?\d{1,2}:\d{2}(?::\d{2})?\]?[ \t]+)(?:<[^<>\s]{1,40}>|\*|[\w.\-]{1,30}:)[ \t]+|[ \t]*<[A-Za-z][\w.\-|\[\]`^]{0,30}>[ \t]+(?=\S)")
ITEM = regex.compile(r"[ \t]*(?:[-*+•‣–][ \t]+|\(?\d{1,3}[.)][ \t]+|\(?[a-zA-Z][)][ \t]+)(?=\S)")
NUMBERED_HEADING = regex.compile(r"\d{1,3}+(?:\.\d{1,3}+)++\.?[ \t]+\p{Lu}[^.!?。]*$")
MARKED_HEADING = regex.compile(r"#{1,6}[ \t]+\S")
UNDERLINE = regex.compile(r"[ \t]*([=\-~^\"#*+])\1{2,}[ \t]*$")
LOG = regex.compile(r"[ \t]*(?:\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d(?::\d\d)?\S*|\w{3} [ \d]\d \d\d:\d\d:\d\d|\[\d{2}:\d{2}:\d{2}\])[ \t]+\S")
TRACE = regex.compile(r"[ \t]*Traceback \(most recent call last\):|[ \t]+File \"[^\"]*\", line \d+")
CODE = regex.compile(r"(?:    |\t)[ \t]*\S|[ \t]*[A-Za-z_][\w.]*(?:Error|Exception|Warning|Interrupt|Exit)(?::|$)|[ \t]*(?:\$|>>>|\.\.\.|#)[ \t]\S|[ \t]*(?:diff --git|@@ |index [0-9a-f]{7}|[+\-]{3} [ab]/)|[ \t]*(?:def|class|for|while|if|with) [^.!?]*:$|[ \t]*(?:import [\w.]+|from [\w.]+ import [\w., *]+|return [\w.()\[\]]+;?|#include\b.*)$|[ \t]*[\w.\[\]\"']+ ?= ?[^=\s]+[;)\]}\"']$|[ \t]*[\w.]+\([^()]*\);?$|[ \t]*[{}();]+[ \t]*$")
TRAILER = regex.compile(r"[ \t]*(?:[A-Z][A-Za-z]*(?:-[A-Za-z]+)+|Reviewed|Committed|Submitter|Branch|Commit|Author|Date|Fixes|Closes|Resolves|Bug|Conflicts|Subject|From|To|Cc|CC|Link)[ \t]*:[ \t]+\S")
ATTRIBUTION = regex.compile(r"[ \t]*(?:On|Am|Le|El|Il|Op|W dniu)\b.{0,200}(?:wrote|schrieb|écrit|escribió|scritto|schreef|pisze)[ \t]*:[ \t]*$")
RULE_FIELDS = regex.compile(r"^\s*(\|.*\||\+[-=+]+\+)\s*$")
FINISHED = regex.compile(rf"[{_TERM}:：;；][\s\"'”’“)\]}}）］｝】〕」』》〉»›]*$")

_BULLET = regex.compile(r"[ \t]*[-*•][ \t]+\S")
_DOTS = regex.compile(r"\.\s*")
_LOWER = regex.compile(r"\p{Ll}+")
_UNIT = regex.compile(r"\d[\s\u00a0]?\p{Ll}$")
_LETTERS = regex.compile(r"\p{L}+")
_BEGINS = regex.compile(r"\p{L}|[\p{Ps}\p{Pi}\"¿¡]|\p{N}")
_TELLING = regex.compile(r"\p{L}+|[¿¡]")
_MARKED_LETTER = regex.compile("[" + "".join(sorted(set("".join(LETTERS.values())))) + "]")
_OTHER_SCRIPT = regex.compile(r"(?P<ru>\p{Script=Cyrillic})|(?P<hi>\p{Script=Devanagari})|(?P<ar>\p{Script=Arabic})")
_CASELESS = regex.compile(r"\p{Lo}")
_REPEATS = regex.compile(r"ๆ|ฯ")
_LINE_END = regex.compile(r"(\r\n|\n|\r|\u2028|\u2029|\x85)")


def _kind(line: str, following: str | None, open_prose: bool) -> str:
    """prose, item, line (one sentence as a whole) or chat."""
    body = line[QUOTED.match(line).end() :] if QUOTED.match(line) else line
    if CHAT.match(body):
        return "chat"
    if LOG.match(body) or TRACE.match(body) or TRAILER.match(body) or ATTRIBUTION.match(body) or RULE_FIELDS.match(body):
        return "line"
    if MARKED_HEADING.match(body) or (following is not None and UNDERLINE.match(following) and len(body.strip()) <= 120):
        return "line"
    if _BULLET.match(body) or (not open_prose and (CODE.match(body) or ITEM.match(body) or NUMBERED_HEADING.match(body))):
        return "line"
    return "prose"


def blocks(text: str) -> list[tuple[int, int, bool]]:
    """Stretches ``start, end, whole`` of the text: runs of prose, and lines that are one sentence as a whole."""
    out: list[tuple[int, int, bool]] = []
    pieces = _LINE_END.split(text)
    at, lines = 0, []
    for i in range(0, len(pieces), 2):
        lines.append((at, at + len(pieces[i])))
        at += len(pieces[i]) + (len(pieces[i + 1]) if i + 1 < len(pieces) else 0)
    run: list[int] | None = None  # prose that may go on
    depth, last, tail = 0, "", ""  # of that prose the last line, and the last line with words and what follows it
    for i, (a, b) in enumerate(lines):
        line = text[a:b]
        if not ALNUM.search(line):
            if not line.strip() or QUOTED.fullmatch(line) or UNDERLINE.match(line) or run is None:
                run = None
                continue
            run[1] = b  # closing marks alone on a line
            out[-1] = (run[0], b, False)
            last, tail = line, f"{tail}\n{line}"
            continue
        following = text[lines[i + 1][0] : lines[i + 1][1]] if i + 1 < len(lines) else None
        mark = QUOTED.match(line)
        level = mark.group().count(">") if mark else 0
        unmarked = run is not None and _unmarked_tail(last)
        going = run is not None and level == depth and not unmarked and not FINISHED.search(tail)
        kind = _kind(line, following, going)
        if kind == "line":
            out.append((a, b, True))
            run = None
        elif kind == "chat":
            out.append((a, b, False))
            run = [a, b]
        elif run is not None and level == depth and (going or (not level and not unmarked)):
            run[1] = b
            out[-1] = (run[0], b, False)
        else:
            out.append((a, b, False))
            run = [a, b]
        depth, last, tail = level, line, line
    return out


def _unmarked_tail(line: str) -> bool:
    """Whether a line ends a sentence without a mark: in a script without terminators, or a short line of one without blanks."""
    line = line.rstrip()
    return bool(UNMARKED.search(line.rsplit(" ", 1)[-1])) or (len(line) < WRAPPED and WIDE.match(line[-1:]) is not None)


def languages(text: str, start: int, end: int) -> set[str]:
    """The languages that a stretch may be in: that of most function words and letters, and those of half as many; none if it has fewer than two."""
    found: dict[str, int] = {}
    for w in [*_TELLING.findall(text, start, end), *_MARKED_LETTER.findall(text, start, end)]:
        for language in _TELLS.get(w.lower(), ()):
            found[language] = found.get(language, 0) + 1
    most = max(found.values(), default=0)
    if most < 2:
        return set()
    return {language for language, n in found.items() if 2 * n >= most}


class Stretch:
    """A run of prose within a text, and its language, which is found only when an abbreviation asks for it."""

    def __init__(self, text: str, start: int, end: int) -> None:
        self.text, self.start, self.end = text, start, end
        self._known: set[str] | None = None

    def abbreviates(self, word: str, begin: int, at: int) -> bool:
        """Whether the word before ``at``, in a sentence from ``begin`` on, is an abbreviation of the language there.

        The words around it tell the language, else those of the run, else
        those of the text; if nothing does, it is one of any language.
        """
        used = _LANGUAGES.get(word)
        if not used:
            return False
        if "all" in used or _OTHER_SCRIPT.match(word):
            return True
        here = languages(self.text, max(begin, at - AROUND), min(at + AROUND // 2, self.end))
        if not here:
            if self._known is None:
                self._known = languages(self.text, self.start, self.end) or languages(self.text, 0, len(self.text))
            here = self._known
        return not here or not used.isdisjoint(here)


def _breaks_after(stretch: Stretch, start: int, mark: str, at: int, nxt: int, end: int) -> bool:
    """Whether a sentence ends with the terminator ``mark`` that begins at ``at``; what follows begins at ``nxt``."""
    text = stretch.text
    if nxt >= end:
        return True
    after = text[nxt]
    glued = nxt == at + len(mark) or not text[nxt - 1].isspace()
    if set(mark) <= {"."}:
        if glued:
            return False  # decimals, names of files, versions
        if len(mark) > 1:
            return not (after.islower() or after.isdigit() or after in ",;")
        before = text[max(start, at - 80) : at]
        m = WORD_BEFORE.search(before)
        word = m.group() if m else ""
        parts = _DOTS.split(word)
        low, last = ".".join(parts).lower(), parts[-1]
        if after in ",;:)—–":
            return False
        if low in UNLESS_CAPITAL:
            w = _LOWER.match(text, nxt, end)
            return not (w and (w.group() in GOES_ON or not low.isascii()))
        if any(stretch.abbreviates(".".join(parts[i:]).lower(), start, at) for i in range(len(parts))):
            return False
        if last.lower() in BEFORE_NUMBER and after.isdigit():
            return False
        if len(parts) == 1 and _UNIT.search(before):
            return True  # a unit
        if len(last) == 1 and last.isalpha() and last.lower() != last.upper():
            return not after.isalpha()  # an initial, or part of an abbreviation
        if word.isdigit() and len(word) <= 2:
            w = _LETTERS.match(text, nxt, end)
            if w and w.group().lower() in MONTHS:
                return False
        return True
    if "…" in mark or "⋯" in mark:
        if AFTER_ELLIPSIS.match(text, nxt):
            return False
        if len(mark) < 2 and WIDE.match(after):
            return False
        return not after.islower() or (len(mark) > 1 and at > start and WIDE.match(text[at - 1]) is not None)
    if glued and not (WIDE.match(after) or _BEGINS.match(after) and not mark.isascii()):
        return after in "¿¡" or _CASELESS.match(after) is not None
    if glued and mark.isascii() and not WIDE.match(after):
        return False
    if after in ",;，、；":
        return False
    return True


def split_prose(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Sentences of a run of prose."""
    out: list[tuple[int, int]] = []
    first = start
    marks = QUOTED.match(text, start, end)
    head = marks.end() if marks else start
    for prefix in (CHAT, ITEM):
        m = prefix.match(text, head, end)
        if m:
            head = m.end()
            break
    stack: list[tuple[str, int]] = []  # closing mark wanted, place of the opening one
    pos, begin = head, head  # begin: where the words of this sentence begin

    stretch = Stretch(text, start, end)
    unmarked = UNMARKED.search(text, begin, end)
    event = EVENT if unmarked else MARK
    closing: dict[str, int] = {}  # where each closing mark stands last

    def emit(stop: int, following: int) -> None:
        nonlocal first, begin, stack, unmarked
        out.append((first, stop))
        first = begin = following
        stack = []
        if unmarked and unmarked.start() < begin:
            unmarked = UNMARKED.search(text, begin, end)

    def closes(mark: str, at: int) -> bool:
        if mark not in closing:
            closing[mark] = text.rfind(mark, start, end)
        return closing[mark] >= at

    while pos < end:
        m = event.search(text, pos, end)
        if not m:
            break
        kind = m.lastgroup
        at, pos = m.start(), m.end()
        if kind == "open":
            c = m.group()
            if c == "“" and stack and stack[-1][0] == "“":
                stack.pop()  # closes a quotation that began with „
            elif c == "‘" and stack and stack[-1][0] == "‘":
                stack.pop()
            else:
                stack.append((PAIRS[c], at))
        elif kind == "quote":
            if any(w == '"' for w, _ in stack):
                while stack and stack.pop()[0] != '"':
                    pass
            else:
                stack.append(('"', at))
        elif kind == "close":
            c = m.group()
            if any(w == c for w, _ in stack) and not (c == "’" and at + 1 < end and text[at + 1].isalpha()):
                while stack and stack.pop()[0] != c:
                    pass
        elif kind == "blank":
            if not stack and unmarked and unmarked.start() < at and (pos >= end or not _REPEATS.match(text, pos, end)):
                emit(at, pos)
        else:
            mark = m.group().lstrip(" \u00a0\u202f")
            at = pos - len(mark)
            closers = CLOSERS.match(text, pos, end)
            stop = pos
            inner = bool(stack)
            if closers:
                stop, balance = pos, list(stack)
                for i in range(pos, closers.end()):
                    c = text[i]
                    if c in " \u00a0\u202f":
                        continue
                    if balance and balance[-1][0] == c:
                        balance.pop()
                    elif c in "'’" or (c == "”" and balance and balance[-1][0] == '"'):
                        if balance and balance[-1][0] == '"':
                            balance.pop()
                    elif not any(w == c for w, _ in balance):
                        if c in "\"“":
                            break  # opens what follows
                    else:
                        while balance and balance.pop()[0] != c:
                            pass
                    stop = i + 1
                closed = [x for x in stack if x not in balance]
            else:
                balance, closed = stack, []
            if not closers and inner and mark.strip(".") == "" and stop < end and not text[stop].isspace():
                continue
            if balance and inner:
                # still inside: an end only if that never closes, or if sentences fill a bracket of their own
                alone = len(balance) == 1 and text[balance[0][1]] in BRACKETS and not ALNUM.search(text, begin, balance[0][1]) and not closers
                if not alone and any(closes(w, stop) for w, _ in balance):
                    stack = balance if closed else stack
                    pos = max(pos, stop)
                    continue
            nxt = stop
            while nxt < end and text[nxt].isspace():
                nxt += 1
            if closed:
                outer = closed[0] if len(closed) == 1 else min(closed, key=lambda x: x[1])
                bracket = text[outer[1]] in BRACKETS
                alone = outer[1] <= begin or not ALNUM.search(text, begin, outer[1])
                if not _quote_breaks(text, outer[1], bracket, alone, stop, nxt, end):
                    stack = list(balance)
                    pos = stop
                    continue
                emit(stop, nxt)
                pos = nxt
                continue
            if not _breaks_after(stretch, begin, mark, at, nxt, end):
                continue
            emit(stop, nxt)
            pos = nxt
    if first < end:
        out.append((first, end))
    return out


def _quote_breaks(text: str, opened: int, bracket: bool, alone: bool, stop: int, nxt: int, end: int) -> bool:
    """Whether the sentence ends with a quotation or bracket that closed after a terminator."""
    if nxt >= end:
        return True
    after = text[nxt]
    glued = nxt == stop
    if bracket:
        if not alone:
            return False
        return not (after in ",;:.!?—–" and glued)
    if after in ",;:—–-，、；" or after.islower():
        return False
    if glued:
        return False
    return True


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Positions of all sentences, without blanks at either end; none for null and blank texts."""
    out: list[tuple[int, int]] = []
    if not text:
        return out
    for start, end, whole in blocks(text):
        for a, b in [(start, end)] if whole else split_prose(text, start, end):
            while a < b and text[a].isspace():
                a += 1
            while b > a and text[b - 1].isspace():
                b -= 1
            if a < b and ALNUM.search(text, a, b):
                out.append((a, b))
            elif a < b and out and not whole and text[out[-1][1] : a].strip() == "" and "\n\n" not in text[out[-1][1] : a] and out[-1][0] >= start:
                out[-1] = (out[-1][0], b)  # marks left over belong to the sentence before
    return out


def split_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start_pos, end_pos``: one row per sentence of each document.

    Null, empty and blank texts give no rows.  Texts are split whole, whatever
    their length, in time that grows with it; language columns are not used, as
    they may be wrong: script, letters and function words round each abbreviation
    tell, those of the run of prose or the whole text where there are none.  Repeated rows give repeated sentences; other columns are
    ignored, whatever their names.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(i, a, b) for i, t in zip(f["i"], f["t"]) for a, b in sentences(t)], columns=["doc_id", "start_pos", "end_pos"])

    slim = documents.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t"))
    return slim.filter(F.col("t").isNotNull()).mapInPandas(run, "doc_id bigint, start_pos int, end_pos int")
