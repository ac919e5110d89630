"""Variant spellings of names typed by people.

Spellings are folded (case, accents, transliteration), parsed into given name,
initial and surname, or into the core of an organisation's name, and linked:

1. a trie join finds all pairs of name tokens within a bounded edit distance:
   tokens are sharded by the deletion variants of their prefixes, every shard
   is a trie, and a Levenshtein automaton (with transpositions) walks it for
   every token of the shard;
2. names whose tokens match, in any order, become candidates: one of given name
   and surname alike within the distance, the other the same;
3. an exact check settles each candidate with what else is known: shared
   account ids, the name in the email, and how often each form occurs.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut

#: Edit distance of tokens of at least 6 characters; of 4 and 5 one, of fewer none.
MAX_EDITS = 2
#: Characters of a token whose deletion variants are its shards.
PREFIX = 6
#: Tokens in one trie; larger shards are split into blocks and every token asks each of them.
BLOCK = 2000

#: A given name of at most this many surnames, of a tenth of those of the other, or with half of its surnames in common with the other, may be a misspelt or short form of it.
RARE_GIVEN = 2
#: What a longer given name may have more than a shorter one and be another name.
OTHER_ENDINGS = frozenset("a e o i y s le lle na ne nne ia ina ine ette ita son".split())

#: Common given names with short forms that are no prefix of typing errors.
SHORT_FORMS = {
    "alexander": "alex sasha sandy xander", "amara": "", "andre": "", "anthony": "tony ant", "astrid": "", "benjamin": "ben benny benji", "bjorn": "", "chiara": "",
    "christopher": "chris kit topher", "daniel": "dan danny", "dmitri": "dima mitya", "edward": "ed eddie ned ted teddy", "elizabeth": "beth betty liz lizzie eliza", "farid": "",
    "francisco": "paco pancho cisco", "gerard": "", "giuseppe": "beppe peppe", "gregory": "greg", "hannah": "", "hiroko": "", "ingrid": "", "ivana": "", "jennifer": "jen jenny jenn",
    "johannes": "hannes hans", "jose": "pepe", "jurgen": "", "katherine": "kate kathy katie kat", "kenji": "", "leila": "", "lukas": "", "margaret": "maggie meg peggy marge", "marta": "",
    "mateo": "", "michael": "mick mike mickey", "nathaniel": "nat nate nathan", "nikolaos": "nikos", "noor": "", "oluwaseun": "seun", "patricia": "pat patty tricia trish", "pavel": "pasha",
    "priya": "", "rafael": "rafa", "renee": "", "richard": "dick rich rick ricky", "robert": "bob bobby rob robbie", "samuel": "sam sammy", "soren": "", "stephanie": "steph", "sunita": "",
    "theresa": "terry tess tessa", "thomas": "tom tommy", "tomasz": "tomek", "victoria": "vicky vicki tori", "vladimir": "volodya vova", "wei": "", "william": "bill billy liam will willy",
    "yevgenia": "zhenya", "zoe": "", "james": "jim jimmy jamie", "john": "johnny jack", "joseph": "joe joey", "charles": "charlie chuck", "george": "", "paul": "", "peter": "pete",
    "matthew": "matt", "andrew": "andy drew", "david": "dave", "steven": "steve", "susan": "sue susie", "rebecca": "becky", "maria": "", "anna": "", "laura": "", "julia": "", "nicholas": "nick",
}

#: Words that tell an organisation or an account of a machine, with one spelling of each.
ORGANISATION = {"ci": "", "continuous": "", "integration": "", "third": "", "party": "", "inc": "", "incorporated": "", "ltd": "", "limited": "", "llc": "", "gmbh": "", "corp": "", "corporation": "", "co": "", "company": "", "bot": "", "laboratories": "laboratories", "laboratory": "laboratories", "labs": "laboratories", "lab": "laboratories", "technologies": "technologies", "technology": "technologies", "tech": "technologies", "systems": "systems", "system": "systems", "sys": "systems", "international": "international", "intl": "international", "networks": "networks", "network": "networks", "net": "networks", "software": "software", "foundation": "foundation"}
_SURE = frozenset(w for w, c in ORGANISATION.items() if not c) - {"co", "bot"}
_LONG = tuple(w for w, c in ORGANISATION.items() if c == w)

#: Transliteration of Cyrillic letters, and Latin letters without a decomposition.
LETTERS = dict(zip("абвгдезийклмнопрстуфхцчшщъыьэюяёіїєґ", "a b v g d e z i j k l m n o p r s t u f h ts ch sh sch  y  e yu ya e i i e g".split(" "))) | {"ж": "zh", "ø": "o", "æ": "a", "œ": "o", "ß": "ss", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i"}


def latin(text: str) -> str:
    """Lower-case Latin letters without accents."""
    text = "".join(LETTERS.get(c, c) for c in text.lower())
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def skeleton(word: str) -> str:
    """What different ways to write the same sounds have in common."""
    return re.sub(r"^ye", "e", word.replace("w", "v")).replace("j", "i").replace("y", "i")


_GIVEN: dict[str, str] = {}
for _name, _forms in SHORT_FORMS.items():
    for _form in (_name, *_forms.split()):
        _GIVEN.setdefault(skeleton(_form), _name)


def osa(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance, or most + 1 beyond it."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a):
        row = [i + 1]
        for j, y in enumerate(b):
            v = min(last[j + 1] + 1, row[j] + 1, last[j] + (x != y))
            if i and j and x == b[j - 1] and a[i - 1] == y:
                v = min(v, before[j - 1] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def edits_for(length: int) -> int:
    return 0 if length < 4 else 1 if length < 6 else MAX_EDITS


class Trie:
    """A set of words that answers which of them a Levenshtein automaton accepts."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = word

    def near(self, word: str, most: int) -> list[tuple[str, int]]:
        """All words within ``most`` edits, transpositions counting one, with their distance."""
        out: list[tuple[str, int]] = []
        n = len(word)
        stack = [(self.root, "", None, list(range(n + 1)))]
        while stack:
            node, char, before, row = stack.pop()
            for c, child in node.items():
                if c == "":
                    if row[n] <= most:
                        out.append((child, row[n]))
                    continue
                new = [row[0] + 1]
                for j in range(n):
                    v = min(row[j + 1] + 1, new[j] + 1, row[j] + (word[j] != c))
                    if before is not None and j and word[j] == char and word[j - 1] == c:
                        v = min(v, before[j - 1] + 1)
                    new.append(v)
                if min(new) <= most:
                    stack.append((child, c, row, new))
        return out


_GIVEN_TRIE = Trie()
for _form in _GIVEN:
    _GIVEN_TRIE.add(_form)
_KNOWN: dict[str, tuple[list[str], int]] = {}


def given_names(word: str) -> tuple[list[str], int]:
    """The common given names that a folded word may spell, and at which distance."""
    if word not in _KNOWN:
        if len(_KNOWN) > 100_000:
            _KNOWN.clear()
        if word in _GIVEN:
            _KNOWN[word] = [_GIVEN[word]], 0
        else:
            near = [(d, _GIVEN[w]) for w, d in _GIVEN_TRIE.near(word, edits_for(len(word)) or int(len(word) == 3)) if len(w) >= 4 and not (word.startswith(w) and len(word) > len(w) + 1 and word[len(w) :] in OTHER_ENDINGS)]
            least = min(near)[0] if near else 9
            _KNOWN[word] = sorted({g for d, g in near if d == least}), least
    return _KNOWN[word]


_NICK = re.compile(r"[\"“”„«»][^\"“”„«»]*[\"“”„«»]|\([^)]*\)|\[[^\]]*\]")
_WORDS = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def parse_name(name: str) -> list[tuple]:
    """Readings ``(kind, given, initial, surname, cls, order)`` of a spelling.

    ``kind`` is full, initial, org or other; ``order`` is 0 for the reading that
    the name has by itself, more for others (a mistyped given name that may be
    one of several, parts in the other order).  Names in which no part can be
    told have one reading ``other``, whose surname is the whole folded name.
    """
    text = latin(_NICK.sub(" ", name))
    words = [w.replace("'", "").replace("’", "") for w in _WORDS.findall(text)]
    if not words:
        return [("other", "", "", skeleton("".join(latin(name).split())), "", 0)]
    if any(w in _SURE for w in words) or (len(words) > 1 and any(w in _LONG for w in words)):
        cls, core = "", []
        for w in words:
            if w in ORGANISATION and (len(words) > 1):
                cls = ORGANISATION[w] or cls
                continue
            tail = next((t for t in _LONG if w.endswith(t) and len(w) - len(t) >= 4), None)
            if tail:
                cls, w = tail, w[: -len(tail)]
            core.append(w)
        return [("org", "org", "", skeleton("".join(core or words)), cls, 0)]
    comma = re.match(r"\s*([^,]+),\s*(.+)", _NICK.sub(" ", text))
    if len(words) == 1:
        w = words[0]
        account = len(w) >= 5 and name == name.lower()  # an initial and a surname in one, as in the names of accounts
        return [("initial", "", w[0], skeleton(w[1:]), "", 0)] if account else [("other", "", "", skeleton(w), "", 0)]
    if comma:
        last, first = _WORDS.findall(comma[1]), _WORDS.findall(comma[2])
        if last and first:
            words = [*first, *last]
    long = [w for w in words if len(w) > 1]
    if not long:
        return [("other", "", "", skeleton("".join(words)), "", 0)]
    if len(long) == 1:
        at = words.index(long[0])
        first = words[0] if at else words[1]
        return [("initial", "", first[0], skeleton(long[0]), "", 0)]
    a, b = skeleton(long[0]), skeleton(long[-1])
    (ga, da), (gb, db) = given_names(a), given_names(b)
    if comma or da < db or (da == db and ga):
        readings = [(long[0], g, b) for g in ga] if len(ga) == 1 else [(long[0], a, b), *((long[0], g, b) for g in ga)]
    elif db < da:
        readings = [(long[-1], g, a) for g in gb] if len(gb) == 1 else [(long[-1], b, a), *((long[-1], g, a) for g in gb)]
    else:
        readings = [(long[0], a, b), (long[-1], b, a)]  # no given name is known: either order
    return [("full", g, (g if g in SHORT_FORMS else raw)[0], last, "", i) for i, (raw, g, last) in enumerate(readings)]


def _shards(token: str) -> set[str]:
    head, out = token[:PREFIX], {token[:PREFIX]}
    for k in range(1, min(edits_for(len(token)), len(head) - 1) + 1):
        for gone in combinations(range(len(head)), k):
            out.add("".join(c for i, c in enumerate(head) if i not in gone))
    return out


def trie_join(tokens: DataFrame) -> DataFrame:
    """``a, b, d``: all pairs of different tokens (column ``token``, distinct) within their edit distance, both ways.

    Nulls and empty tokens join nothing.  A shard is one trie; where it has more
    than BLOCK tokens it is split into blocks and each of its tokens asks every
    block, so no task holds more than a block at once.
    """

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(s, t) for t in f["token"] for s in _shards(t)]
            yield pd.DataFrame(rows, columns=["shard", "token"])

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, trie = None, Trie()
        for f in frames:
            out = []
            for shard, block, role, token in zip(f["shard"], f["block"], f["role"], f["token"]):
                if key != (shard, block):
                    key, trie = (shard, block), Trie()
                if role == 0:
                    trie.add(token)
                else:
                    most = edits_for(len(token))
                    out += [(token, w, d) for w, d in trie.near(token, most) if 0 < d <= edits_for(len(w))]
            yield pd.DataFrame(out, columns=["a", "b", "d"])

    spreads = tokens.select("token").filter("token is not null and token <> ''").mapInPandas(spread, "shard string, token string")
    sizes = spreads.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    sized = spreads.join(sizes, "shard")
    index = sized.select("shard", F.pmod(F.xxhash64("token"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("role"), "token")
    asked = sized.select("shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"), "token")
    # a fixed number of parts: by their bytes these would be merged into one or two tasks, but they take much time
    parts = max(tokens.sparkSession.sparkContext.defaultParallelism * 3, int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    both = index.unionAll(asked).repartition(parts, "shard", "block").sortWithinPartitions("shard", "block", "role")
    return both.mapInPandas(walk, "a string, b string, d int").distinct()


def _parsed(names: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(n, *r) for n in f["name"] for r in parse_name(n)], columns=["name", "kind", "given", "initial", "surname", "cls", "ord"])

    return names.select("name").mapInPandas(run, "name string, kind string, given string, initial string, surname string, cls string, ord int")


def short_forms(given: DataFrame) -> DataFrame:
    """``a, b``: given names (column ``token``) and the shorter ones that they begin or end with, as in Chukwuemeka and Emeka.

    Those that differ by an ending that makes another name (Daniel, Danielle) are left out.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(t, t[:k]) for t in f["token"] for k in range(3, len(t) - 1) if t[k:] not in OTHER_ENDINGS] + [(t, t[k:]) for t in f["token"] for k in range(2, len(t) - 3)]
            yield pd.DataFrame(rows, columns=["a", "b"])

    return given.mapInPandas(run, "a string, b string").join(given.select(F.col("token").alias("b")), "b", "left_semi").distinct()


def _email_names(clues: DataFrame) -> DataFrame:
    """``name, hint``: the folded letters before the @ of each email that goes with a spelling."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(n, skeleton(re.sub(r"[^a-z]", "", latin(e.split("@")[0])))) for n, e in zip(f["name"], f["clue"])]
            yield pd.DataFrame([r for r in rows if len(r[1]) >= 6], columns=["name", "hint"])

    return clues.filter("kind = 'email'").select("name", "clue").mapInPandas(run, "name string, hint string").distinct()


def link_names(names: DataFrame, clues: DataFrame) -> DataFrame:
    """``name, entity``: one row per distinct spelling, with a spelling that stands for its entity.

    ``names`` has the columns ``name`` and ``n`` (rows with that spelling);
    ``clues`` has ``name, kind, clue`` with kind account or email, and may be
    empty.  Null and blank names are ignored; names that nothing links, and
    names without letters, are their own entity.  Ties go to the form that is
    more frequent, then to the smaller string; an initial that fits several
    people equally well is linked to none of them.
    """
    known = names.filter("name is not null and trim(name) <> ''").groupBy("name").agg(F.sum("n").alias("n"))
    parsed = cut(_parsed(known).join(known, "name"))
    first = parsed.filter("ord = 0")
    is_form = F.col("kind").isin("full", "org")
    forms = cut(first.filter(is_form).groupBy("kind", "given", "surname").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("spellings"), F.max("initial").alias("initial"), F.max("cls").alias("cls")).withColumn("form", F.concat_ws("|", "kind", "given", "surname")))
    tokens = cut(first.select(F.col("surname").alias("token")).distinct())
    near = cut(trie_join(tokens).unionAll(tokens.select(F.col("token").alias("a"), F.col("token").alias("b"), F.lit(0).alias("d"))))
    by_name = first.select("name", F.concat_ws("|", "kind", "given", "initial", "surname").alias("any"), F.when(is_form, F.concat_ws("|", "kind", "given", "surname")).otherwise(F.concat_ws("|", F.lit("i"), "initial", "surname")).alias("form"), "kind")
    accounts = by_name.select("name", "form").join(clues.filter("kind = 'account'").select("name", "clue"), "name").select("form", "clue").distinct()
    hints = by_name.select("name", "form").join(_email_names(clues), "name").select("form", "hint").distinct()
    accounts, hints = cut(accounts), cut(hints)
    joined = F.concat(F.regexp_replace(F.col("given"), "[yj]", "i"), F.col("surname"))

    # candidates among full forms: the same given name, surnames within the distance; other orders of unknown parts
    p = forms.select(F.col("form").alias("p"), "given", F.col("surname").alias("b"), F.col("n").alias("pn"), F.col("cls").alias("pcls"), joined.alias("pjoin"))
    c = forms.select(F.col("form").alias("c"), "given", F.col("surname").alias("a"), F.col("n").alias("cn"), F.col("cls").alias("ccls"), joined.alias("cjoin"))
    pairs = c.join(near.filter("d > 0"), "a").join(p, ["given", "b"]).filter("c <> p and (pn > cn or (pn = cn and p < c)) and (pcls = '' or ccls = '' or pcls = ccls)")
    own_form = first.select("name", F.concat_ws("|", "kind", "given", "surname").alias("c"))
    other = parsed.filter("kind = 'full' and ord > 0").join(own_form, "name").select("c", "given", F.col("surname").alias("a")).distinct()
    turned = other.join(near.filter("d <= 1"), "a").join(p, ["given", "b"]).join(c.select("c", "cn", "ccls", "cjoin"), "c").filter("c <> p and (pn > cn or (pn = cn and p < c))").withColumn("d", F.col("d") + 1)
    # the same surname, given names within the distance or one a part of the other; two given names that many people have are two
    given = cut(forms.filter("kind = 'full' and given <> ''").groupBy(F.col("given").alias("token")).agg(F.count_distinct("surname").alias("surnames")))
    like = trie_join(given).unionByName(short_forms(given.select("token")).withColumn("d", F.lit(1))).groupBy("a", "b").agg(F.min("d").alias("d"))
    like = like.unionByName(like.select(F.col("b").alias("a"), F.col("a").alias("b"), "d")).groupBy("a", "b").agg(F.min("d").alias("d"))
    many = given.select(F.col("token").alias("a"), F.col("surnames").alias("na")), given.select(F.col("token").alias("b"), F.col("surnames").alias("nb"))
    fewer, more = F.least("na", "nb"), F.greatest("na", "nb")
    ended = F.when(F.col("a").startswith(F.col("b")), F.substr("a", F.length("b") + 1)).when(F.col("b").startswith(F.col("a")), F.substr("b", F.length("a") + 1)).isin(*OTHER_ENDINGS)
    like = cut(like.join(many[0], "a").join(many[1], "b").withColumn("rare", (fewer <= RARE_GIVEN) | (fewer * 10 <= more)).select(F.col("a").alias("given"), F.col("b").alias("g2"), "d", "rare", fewer.alias("fewer"), F.coalesce(ended, F.lit(False)).alias("ended")))
    people_ = forms.filter("kind = 'full'")
    c2 = people_.select(F.col("form").alias("c"), "given", "surname", F.col("n").alias("cn"), joined.alias("cjoin"))
    p2 = people_.select(F.col("form").alias("p"), F.col("given").alias("g2"), "surname", F.col("n").alias("pn"), joined.alias("pjoin"))
    met = cut(c2.join(like, "given").join(p2, ["g2", "surname"]))
    shared = met.groupBy("given", "g2").agg(F.count_distinct("surname").alias("shared"))  # a variant has the surnames of the name that it is one of
    respelt = met.join(shared, ["given", "g2"]).withColumn("rare", (F.col("rare") | (2 * F.col("shared") >= F.col("fewer"))) & ~F.col("ended")).filter("pn > cn or (pn = cn and p < c)")
    cols = ["c", "p", "d", "cn", "pn", "cjoin", "pjoin", "rare"]
    pairs = pairs.withColumn("rare", F.lit(True)).select(cols).unionByName(turned.withColumn("rare", F.lit(True)).select(cols)).unionByName(respelt.select(cols))
    pairs = cut(pairs.groupBy("c", "p", "cn", "pn", "cjoin", "pjoin").agg(F.min("d").alias("d"), F.bool_or("rare").alias("rare")).join(forms.select(F.col("form").alias("c"), "spellings"), "c"))
    pairs = _with_clues(pairs, accounts, hints)
    # two full forms are the same name if one edit apart, else if a clue says so or the rarer one, written in one way only, has no email of its own
    sure = pairs.filter("same_account or hinted or (rare and (d = 1 or (not own and spellings = 1 and cn * 2 <= pn)))")
    best = Window.partitionBy("c").orderBy(F.col("same_account").desc(), F.col("hinted").desc(), "d", F.col("pn").desc(), "p")
    up = sure.withColumn("r", F.row_number().over(best)).filter("r = 1").select("c", "p")
    roots = _roots(forms.select("form"), up)

    # initials and account names: the one full form that fits best
    people = forms.filter("kind = 'full'").join(roots, "form").select(F.col("root").alias("p"), F.col("form").alias("via"), "initial", F.col("surname").alias("b"), F.col("n").alias("pn"), joined.alias("pjoin"))
    shy = by_name.filter("kind = 'initial'").select("form").distinct().select(F.col("form").alias("c"), F.split("form", r"\|")[1].alias("initial"), F.split("form", r"\|")[2].alias("a"))
    fits = shy.join(near, "a").join(people, ["initial", "b"])
    fits = _with_clues(cut(fits.select("c", F.col("via").alias("p"), "d", F.lit("").alias("cjoin"), "pjoin", F.col("p").alias("root"))), accounts, hints)
    fits = fits.filter("d <= 1 or same_account or hinted").withColumn("score", F.expr("4 * int(same_account) + 4 * int(hinted) - d"))
    fits = fits.groupBy("c", "root").agg(F.max("score").alias("score"))
    top = Window.partitionBy("c")
    chosen = fits.withColumn("most", F.max("score").over(top)).filter("score = most").withColumn("k", F.count(F.lit(1)).over(top)).filter("k = 1").select(F.col("c").alias("form"), "root")
    # those that fit no full form are linked with each other: the same initial, surnames one edit apart or an account in common
    alone = cut(by_name.filter("kind = 'initial'").join(known, "name").groupBy("form").agg(F.sum("n").alias("n")).join(chosen.select("form"), "form", "left_anti").withColumn("initial", F.split("form", r"\|")[1]).withColumn("surname", F.split("form", r"\|")[2]))
    ca = alone.select(F.col("form").alias("c"), "initial", F.col("surname").alias("a"), F.col("n").alias("cn"), F.lit("").alias("cjoin"))
    pa = alone.select(F.col("form").alias("p"), "initial", F.col("surname").alias("b"), F.col("n").alias("pn"), F.lit("").alias("pjoin"))
    both = _with_clues(cut(ca.join(near.filter("d > 0"), "a").join(pa, ["initial", "b"]).filter("pn > cn or (pn = cn and p < c)").select("c", "p", "d", "pn", "cjoin", "pjoin")), accounts, hints).filter("d = 1 or same_account")
    first_of = Window.partitionBy("c").orderBy(F.col("same_account").desc(), "d", F.col("pn").desc(), "p")
    up = both.withColumn("r", F.row_number().over(first_of)).filter("r = 1").select("c", "p")
    chosen = chosen.unionByName(_roots(alone.select("form"), up))
    entity = cut(by_name.join(roots.unionByName(chosen), "form", "left").select("name", F.coalesce("root", "form").alias("root")))
    stands = entity.join(known, "name").groupBy("root").agg(F.max_by("name", F.struct("n", "name")).alias("entity"))
    return cut(entity.join(stands, "root").select("name", "entity"))


def _with_clues(pairs: DataFrame, accounts: DataFrame, hints: DataFrame) -> DataFrame:
    """Adds what is known besides the spelling: a shared account, an email that names the other, an email that names itself."""
    pc = pairs.select("c", "p").distinct()
    same = pc.join(accounts.select(F.col("form").alias("c"), "clue"), "c").join(accounts.select(F.col("form").alias("p"), "clue"), ["p", "clue"], "left_semi").select("c", "p").distinct().withColumn("same_account", F.lit(True))
    named = hints.select(F.col("form").alias("c"), F.col("hint").alias("pjoin")).withColumn("hinted", F.lit(True))
    own = hints.select(F.col("form").alias("c"), F.col("hint").alias("cjoin")).withColumn("own", F.lit(True))
    out = pairs.join(same, ["c", "p"], "left").join(named, ["c", "pjoin"], "left").join(own, ["c", "cjoin"], "left")
    return out.fillna(False, ["same_account", "hinted", "own"])


def _roots(forms: DataFrame, up: DataFrame) -> DataFrame:
    """``form, root``: the end of each chain of links; links lead to more frequent forms, so there are no cycles."""
    state = cut(forms.join(up.select(F.col("c").alias("form"), F.col("p").alias("root")), "form", "left").select("form", F.coalesce("root", "form").alias("root")))
    while True:
        ahead = state.select(F.col("form").alias("root"), F.col("root").alias("next"))
        new = cut(state.join(ahead, "root").select("form", F.col("next").alias("root"), (F.col("root") != F.col("next")).alias("moved")))
        if not new.filter("moved").limit(1).count():
            return new.select("form", "root")
        state = new.select("form", "root")


def spelling_pairs(linked: DataFrame) -> DataFrame:
    """``name_a, name_b``: all pairs of different spellings of one entity, ``name_a`` < ``name_b``.

    The pairs are what is asked for; an entity has as many spellings as people
    found ways to write it, which no number of rows changes.
    """
    a, b = linked.select("entity", F.col("name").alias("name_a")), linked.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").filter("name_a < name_b").select("name_a", "name_b")


def repository_names(commits: DataFrame, details: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The spellings and the clues in ``commits.committer``, ``owner.name`` and ``labels`` of change details."""
    who = F.regexp_extract("committer", r"(?s)^<git\.Actor \"(.*) <", 1)
    mail = F.regexp_extract("committer", r"(?s) <([^<>]*)>\"?>?$", 1)
    actors = commits.select(F.trim(F.regexp_replace(who, r"^\s+|\s+$", "")).alias("name"), mail.alias("clue"))
    votes = details.select(F.explode(F.map_values("labels")).alias("v"))
    person = "struct<_account_id:int,name:string>"
    voters = votes.select(F.explode(F.concat(F.coalesce(F.transform("v.all", lambda x: F.struct(x["_account_id"], x["name"])), F.expr(f"cast(array() as array<{person}>)")), F.array("v.approved", "v.recommended"))).alias("x"))
    people = details.select(F.col("owner").alias("x")).unionAll(voters).select(F.col("x.name").alias("name"), F.col("x._account_id").cast("string").alias("clue"))
    rows = actors.withColumn("kind", F.lit("email")).unionAll(people.withColumn("kind", F.lit("account"))).filter("name is not null and name <> ''")
    counted = cut(rows.groupBy("name", "kind", "clue").agg(F.count(F.lit(1)).alias("n")))
    return counted.groupBy("name").agg(F.sum("n").alias("n")), counted.filter("clue is not null and clue <> ''").select("name", "kind", "clue")
