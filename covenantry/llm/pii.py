"""Surrogates for personal data, in DataFrame functions only.

Entities found by pattern are replaced by surrogates of the same type, format and script (names: and
gender), drawn by a keyed hash of the entity's normal form. All occurrences of an entity in the
corpus get one surrogate (coreference). Surrogates are checked over all entities of the corpus: those
that two entities share, or that equal a real entity, are drawn anew until all are distinct. From the
draw ``GROWS_AFTER`` on a surrogate gets longer with each draw, so no number of entities exhausts it.

Names are found after a title or from a given name of the fixed list on; their words are then replaced
in the whole document, with a title or not.

Each text is searched once: the search marks the matches, and the marked texts are stored with their
rows. Only documents with an entity are joined with their surrogates; the others pass through.

Defined cases: null text stays null; texts without an entity are returned as they are; digit runs
that fail the Luhn test are no card numbers and stay; secrets, addresses and hexadecimal keys have no
greatest length; rows that repeat a doc_id are treated one by one; an empty table gives no rows; extra
columns stay, whatever their names, except that of the count, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import boxed, let
from .storage import materialise

KEY = "covenantry"  # where the session names no secret one
KEY_SETTING = "spark.covenantry.pii.key"
GROWS_AFTER = 4  # draws in the format of the entity; later ones are longer by a character or syllable each

# Given names by script and gender, titles and the words before a secret.
MALE = ("James", "Robert", "Michael", "William", "David", "Richard", "Joseph", "Thomas", "Charles", "Daniel", "Pierre", "Jacques", "Wolfgang", "Jürgen", "Carlos", "Javier")
FEMALE = ("Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Camille", "Juliette", "Ingrid", "Heike", "Lucía", "Carmen")
MALE_CYRILLIC = ("Иван", "Сергей", "Алексей", "Дмитрий", "Николай", "Михаил", "Андрей", "Павел")
FEMALE_CYRILLIC = ("Анна", "Мария", "Елена", "Ольга", "Татьяна", "Наталья", "Ирина", "Светлана")
SURNAME_HEADS = ("Al", "Bar", "Cor", "Del", "Fen", "Gar", "Hol", "Kel", "Lor", "Mar", "Nor", "Pel", "Ros", "Sel", "Tor", "Wil")
SURNAME_TAILS = ("bert", "den", "field", "ford", "gate", "ham", "land", "ley", "man", "mont", "nell", "row", "son", "ton", "well", "wick")
SURNAME_HEADS_CYRILLIC = ("Бел", "Вол", "Гор", "Дав", "Зим", "Ков", "Лав", "Мор")
SURNAME_TAILS_CYRILLIC = ("ин", "ов", "ев", "аков", "енков", "ихин", "унов", "атов")
MALE_TITLES = ("Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "Господин")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Госпожа")
TITLES = (*MALE_TITLES, *FEMALE_TITLES, "Dr", "Prof")
PHONE_WORDS = ("tel", "telephone", "phone", "mobile", "cell", "fax", "tél", "téléphone", "telefon", "handy", "teléfono")
SECRET_WORDS = ("password", "passwd", "secret", "token", "api_key", "api-key", "apikey")

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TITLE = r"(?:(?:" + "|".join(sorted(TITLES, key=len, reverse=True)) + r")\.? ){1,3}"
_PARTICLE = "(?:von|van|der|den|de|la|del|di|da|du|le|zu)"
_LETTERS = r"[\p{L}\p{M}]"
_NAME = rf"\p{{Lu}}(?:{_LETTERS}++(?:['’-]{_LETTERS}{{2,}}+){{0,7}}|(?:['’-]{_LETTERS}{{2,}}+){{1,7}})"
_GIVEN = "(?:" + "|".join((*MALE, *FEMALE, *MALE_CYRILLIC, *FEMALE_CYRILLIC)) + ")"
_NAME_PART = rf"(?:{_PARTICLE} ){{0,3}}(?:{_NAME}|\p{{Lu}}\.)"
_MENTION = rf"(?<![\p{{L}}\p{{M}}\p{{N}}]){_NAME}(?![\p{{L}}\p{{N}}])"
_COUNTRY = r"\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})[ .-]?(?:\(0\) ?)?"
# National groupings, longer ones first: by pairs; an area and a number; unseparated or in any groups after a country code.
_PHONE_WORD = r"(?i:" + "|".join(sorted(PHONE_WORDS, key=len, reverse=True)) + r")[.:]{0,2} {0,2}"
_PHONE = "|".join((
    rf"{_PHONE_WORD}\d{{7,12}}",
    rf"(?:{_COUNTRY}\d|0[1-9])(?:[ .-]\d\d){{4}}",
    rf"(?:{_COUNTRY})?[6-9]\d\d(?:[ .-]\d\d){{3}}",
    r"0\d\d[ .-]\d{3}(?:[ .-]\d\d){2}",
    rf"(?:{_COUNTRY}\(?\d{{2,5}}\)?[ /.-]|0\d{{2,4}}[ /-]|\(0\d{{1,4}}\)[ -]?)\d{{6,8}}",
    rf"{_COUNTRY}\d{{7,12}}",
    rf"(?!\+1[ .-]){_COUNTRY}\(?\d{{1,4}}\)?(?:[ .-]\d{{2,4}}){{2,4}}",
    r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}",
))
PATTERNS = {
    "email": r"(?<![\p{L}\p{M}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]++@(?:[\p{L}\p{M}\p{N}-]{1,63}\.){1,126}[\p{L}]{2,63}",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "ipv6": r"(?=[0-9A-Fa-f]{1,4}:)(?<![\w:.])(?=[A-Fa-f:]{0,39}[0-9])(?=[0-9A-Fa-f:]{0,36}[0-9A-Fa-f]{3})(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "iban": r"(?=[A-Z]{2}\d)(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![\d-])\d(?:[ -]?\d){12,18}(?!-?\d)",
    "phone": rf"(?<![\w.+-])(?:{_PHONE})(?![\w-])",
    "secret": r"(?=[PpSsTtAa])(?<![A-Za-z0-9])(?i:" + "|".join(SECRET_WORDS) + r")[\"']?\s{0,3}[=:]\s{0,3}[\"']?(?=[^\p{L}\p{N}\p{Cc}\s\"'<>,;]*+[\p{L}\p{N}])[^\p{Cc}\s\"'<>,;]{6,}+",
    "access": r"(?=[Ags])(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|sk-(?=[_-]*+[A-Za-z0-9])[A-Za-z0-9_-]{20,}+)(?![A-Za-z0-9])",
    "hex": r"(?<![A-Za-z0-9])(?:(?=[0-9]*+[a-f])[0-9a-f]{32,}+|[0-9]{32,64}+)(?![A-Za-z0-9])",
    "name": rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{M}}])(?:{_TITLE}{_NAME_PART}(?: {_NAME_PART}){{0,3}}|{_GIVEN}(?: {_NAME_PART}){{1,3}})",
}
_CYRILLIC = "абвгдежзиклмнопрстуфхцчшэюя"
ANY = "|".join(f"(?:{x})" for x in PATTERNS.values())
# A lookahead at an alternative's first character keeps it cheap where it can't begin.
#: No text without one of these has an entity; the test is cheap.
_HINT = r"[@0-9]|(?=\p{Lu})(?:" + "|".join(TITLES) + f"|{_GIVEN} )|(?=[PpSsTtAa])(?i:" + "|".join(SECRET_WORDS) + ")|gh[pousr]_|sk-|[a-f]{32}"
# Before these controls, of which none is a letter, digit or white space, \x01 marks what it is: itself, a match's begin or end.
_ITSELF, _BEGIN, _END = "\x01\x02", "\x01\x03", "\x01\x04"


def marked(text: Column) -> Column:
    """The text with its matches between marks; null if it has none."""
    found = F.regexp_replace(F.replace(text, F.lit("\x01"), F.lit(_ITSELF)), ANY, f"{_BEGIN}$0{_END}")
    return F.when(text.rlike(_HINT), let(found, lambda m: F.when(m.contains(_BEGIN), m)))


def session_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, KEY)


def _type_of(match: Column) -> Column:
    kind = F.lit("name")
    for name, pattern in reversed(list(PATTERNS.items())[:-1]):
        kind = F.when(match.rlike(rf"\A(?:{pattern})\z"), name).otherwise(kind)
    return kind


def _words(*words: str) -> Column:
    return F.array(*(F.lit(x) for x in words))


def _prefix(kind: Column, match: Column) -> Column:
    """What of a match stays: titles, a country code or the zero in its place, the word before a secret, a key's tag."""
    return (
        F.when(kind == "name", F.regexp_extract(match, rf"\A{_TITLE}", 0))
        .when(kind == "phone", F.regexp_extract(match, rf"\A(?:{_PHONE_WORD})?(?:{_COUNTRY})?\(?0?", 0))
        .when(kind == "secret", F.regexp_extract(match, r"\A[^=:]+[=:]\s*[\"']?", 0))
        .when(kind == "access", F.regexp_extract(match, r"\A(?:AKIA|gh[pousr]_|sk-)", 0))
        .otherwise("")
    )


def _name_type(title: Column, word: Column, last: Column) -> Column:
    given = lambda which: F.concat(F.lit("given_"), which)
    male, female = F.array_contains(_words(*MALE, *MALE_CYRILLIC), word), F.array_contains(_words(*FEMALE, *FEMALE_CYRILLIC), word)
    by_title = F.when(title.rlike(r"\A(?:" + "|".join(MALE_TITLES) + r")\.? "), "m").when(title.rlike(r"\A(?:" + "|".join(FEMALE_TITLES) + r")\.? "), "f").otherwise("m")
    which = F.when(male, "m").when(female, "f").otherwise(by_title)
    return F.when(word.rlike(rf"\A{_PARTICLE}\z"), "particle").when(~last | male | female, given(which)).otherwise("surname")


def entities_of(match: Column) -> Column:
    """struct<prefix, parts: array<struct<kind, value>>> of a match; a name has a part per word."""

    def split(kind: Column, prefix: Column) -> Column:
        rest = F.substring(match, F.length(prefix) + 1, F.length(match))
        words = F.split(rest, " ")
        names = F.transform(words, lambda w, i: F.struct(_name_type(prefix, w, i == F.size(words) - 1).alias("kind"), w.alias("value")))
        parts = F.when(kind == "name", names).otherwise(F.array(F.struct(kind.alias("kind"), rest.alias("value"))))
        return F.struct(prefix.alias("prefix"), parts.alias("parts"))

    return let(_type_of(match), lambda kind: let(_prefix(kind, match), lambda prefix: split(kind, prefix)))


def normal_form(kind: Column, value: Column) -> Column:
    return (
        F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(value, r"\D", ""))
        .when(kind == "iban", F.replace(value, F.lit(" "), F.lit("")))
        .when(kind.isin("email", "hex", "ipv6"), F.lower(value))
        .otherwise(value)
    )


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a number (0 modulo 10 if it is valid)."""
    at = lambda i: F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")  # noqa: E731  from the right
    each = lambda i: F.when(i % 2 == 0, at(i)).otherwise(F.when(at(i) > 4, at(i) * 2 - 9).otherwise(at(i) * 2))
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + each(i))


def _mod97(text: Column) -> Column:
    """An IBAN's remainder: letters count as 10..35."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + value(c)).otherwise(a * 100 + value(c)) % 97
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), step)


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _pick(words: tuple[str, ...], number: Column) -> Column:
    return F.element_at(_words(*words), (F.pmod(number, F.lit(len(words))) + 1).cast("int"))


def draw_surrogate(kind: Column, normal: Column, draw: Column, key: str) -> Column:
    """The surrogate of an entity's normal form; ``draw`` counts how often it was drawn before."""
    seed = F.sha2(F.concat_ws("|", F.lit(key), kind, normal, draw.cast("string")), 256)

    def build(seed: Column) -> Column:
        number = lambda i: F.pmod(F.xxhash64(seed, i), F.lit(1 << 40))
        letter = lambda base, i, n: F.char(F.lit(base) + F.pmod(number(i), F.lit(n)))
        hexed = kind.isin("hex", "ipv6")
        hexed = hexed | ((kind == "secret") & normal.rlike(r"\A[0-9a-f]+\z"))
        # as long a tail of an email as names the top level stays
        tail = F.when(kind == "email", F.length(F.regexp_extract(normal, r"\.\p{L}+$", 0))).otherwise(0)
        head = F.when(kind == "card", 1).when(kind == "iban", 2).otherwise(0)

        def one(c: Column, i: Column, stop: Column, hexed: Column) -> Column:
            digit = F.when((i == 0) & (kind == "phone"), letter(50, i, 8)).otherwise(letter(48, i, 10))
            return (
                F.when((i < head) | (i >= stop), c)
                .when(c.rlike("[0-9]"), F.when(hexed, F.substring(F.lit("0123456789abcdef"), (F.pmod(number(i), F.lit(16)) + 1).cast("int"), F.lit(1))).otherwise(digit))
                .when(c.rlike("[a-z]"), F.when(hexed, F.substring(F.lit("0123456789abcdef"), (F.pmod(number(i), F.lit(16)) + 1).cast("int"), F.lit(1))).otherwise(letter(97, i, 26)))
                .when(c.rlike("[A-Z]"), letter(65, i, 26))
                .when(c.rlike(r"\p{IsCyrillic}"), F.substring(F.lit(_CYRILLIC), (F.pmod(number(i), F.lit(len(_CYRILLIC))) + 1).cast("int"), F.lit(1)))
                .when(c.rlike(r"\p{L}"), letter(97, i, 26))
                .otherwise(c)
            )

        once = F.struct((F.length(normal) - tail).alias("stop"), hexed.alias("hexed"))  # not for each character again
        chars = let(once, lambda o: F.array_join(F.transform(_characters(normal), lambda c, i: one(c, i, o["stop"], o["hexed"])), ""))
        # from here on each draw has a place more, after the entity's own (before them in an email)
        grows = lambda of: F.when(draw > GROWS_AFTER, F.array_join(F.transform(F.sequence(F.lit(1), draw - GROWS_AFTER), lambda k: of(k - 1 + 1000)), "")).otherwise("")
        more = F.when(kind == "email", grows(lambda i: letter(97, i, 26))).otherwise(grows(lambda i: letter(48, i, 10)))
        chars = F.when(kind == "email", F.concat(more, chars)).otherwise(F.concat(chars, more))
        octets = F.array_join(F.transform(F.split(normal, r"\."), lambda x, i: (F.pmod(number(i), F.lit(254)) + 1).cast("string")), ".")
        octets = F.concat(octets, grows(lambda i: F.concat(F.lit("."), (F.pmod(number(i), F.lit(254)) + 1).cast("string"))))
        card = let(chars, lambda x: let(F.concat(F.left(x, F.length(x) - 1), F.lit("0")), lambda y: F.concat(F.left(x, F.length(x) - 1), F.pmod(-_luhn(y), F.lit(10)).cast("string"))))
        iban = let(chars, lambda x: F.concat(F.left(x, F.lit(2)), F.lpad((F.lit(98) - _mod97(F.concat(F.substring(x, 5, 34), F.left(x, F.lit(2)), F.lit("00")))).cast("string"), 2, "0"), F.substring(x, 5, 34)))
        cyrillic = normal.rlike(r"\p{IsCyrillic}")
        first = lambda words, more: F.when(draw < 3, _pick(words, number(F.lit(0)))).otherwise(F.concat_ws("-", _pick(words, number(F.lit(0))), _pick(words, number(F.lit(1))), F.when(draw > 8, _pick(words, number(F.lit(2)))), F.when(draw > 16, _pick(more, number(F.lit(3))))))
        given = F.when(kind == "given_m", F.when(cyrillic, first(MALE_CYRILLIC, SURNAME_HEADS_CYRILLIC)).otherwise(first(MALE, SURNAME_HEADS)))
        given = given.otherwise(F.when(cyrillic, first(FEMALE_CYRILLIC, SURNAME_HEADS_CYRILLIC)).otherwise(first(FEMALE, SURNAME_HEADS)))
        syllables = lambda heads, tails: F.concat(_pick(heads, number(F.lit(0))), F.when(draw > 1, F.lower(_pick(heads, number(F.lit(1))))).otherwise(""), F.when(draw > 4, F.lower(_pick(heads, number(F.lit(2))))).otherwise(""), F.when(draw > 8, F.lower(_pick(heads, number(F.lit(3))))).otherwise(""), _pick(tails, number(F.lit(4))))
        feminine = F.when(normal.rlike("(?:ова|ева|ина|ая)$"), "а").otherwise("")
        surname = F.when(cyrillic, F.concat(syllables(SURNAME_HEADS_CYRILLIC, SURNAME_TAILS_CYRILLIC), feminine)).otherwise(syllables(SURNAME_HEADS, SURNAME_TAILS))
        longer = F.when(cyrillic, grows(lambda i: F.lower(_pick(SURNAME_HEADS_CYRILLIC, number(i))))).otherwise(grows(lambda i: F.lower(_pick(SURNAME_HEADS, number(i)))))
        given, surname = F.concat(given, longer), F.concat(surname, longer)
        return (
            F.when(kind == "ip", octets).when(kind == "card", card).when(kind == "iban", iban)
            .when(kind.startswith("given_"), given).when(kind == "surname", surname).otherwise(chars)
        )

    return let(seed, build)


def _render(kind: Column, value: Column, surrogate: Column) -> Column:
    """The surrogate in the format of one occurrence: its separators and its case; what is longer follows."""

    def fill(a: Column, c: Column) -> Column:
        counts = F.when(kind == "iban", c != " ").otherwise(c.rlike("[0-9]"))
        put = F.when(counts, F.substring(surrogate, a["i"] + 1, F.lit(1))).otherwise(c)
        return F.struct(F.concat(a["out"], put).alias("out"), (a["i"] + F.when(counts, 1).otherwise(0)).alias("i"))

    start, rest = F.struct(F.lit("").alias("out"), F.lit(0).alias("i")), lambda begin: F.substring(surrogate, begin + 1, F.length(surrogate))
    spaced = F.aggregate(_characters(value), start, fill, lambda a: F.concat(a["out"], rest(a["i"])))  # of some dozens of characters
    capitals = (kind == "ipv6") & value.rlike("[A-F]") & ~value.rlike("[a-f]")
    cased = let(capitals, lambda up: F.zip_with(_characters(value), _characters(F.left(surrogate, F.length(value))), lambda c, own: F.when(c.rlike("[A-Z]") | up, F.upper(own)).otherwise(own)))
    return (
        F.when(kind.isin("ip", "surname", "given_m", "given_f"), surrogate)
        .when(kind.isin("phone", "card", "ssn", "iban"), spaced)
        .otherwise(F.concat(F.array_join(cased, ""), rest(F.length(value))))
    )


def assign_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """kind, normal, surrogate of all distinct entities (kind, normal); surrogates are distinct and no entity's own.

    Of entities that draw the same one the least keeps it; only the others draw again."""
    pending = materialise(entities.select("kind", "normal").distinct().withColumn("draws", F.lit(0)), "entities")
    used, kept = pending.select("kind", F.col("normal").alias("surrogate")), None
    while True:
        drawn = materialise(pending.withColumn("surrogate", draw_surrogate(F.col("kind"), F.col("normal"), F.col("draws"), key)), "surrogates")
        # after the first round few are drawn: they are the side that is looked up
        taken = used.join(drawn.select("kind", "surrogate"), ["kind", "surrogate"], "left_semi").distinct()
        free = drawn.join(taken, ["kind", "surrogate"], "left_anti").groupBy("kind", "surrogate").agg(F.min("normal").alias("normal"))
        free = materialise(free.select("kind", "normal", "surrogate"), "surrogates")
        kept = free if kept is None else kept.unionByName(free)
        pending = materialise(drawn.join(free.select("kind", "normal"), ["kind", "normal"], "left_anti").select("kind", "normal", (F.col("draws") + 1).alias("draws")), "collisions")
        if pending.isEmpty():
            return kept
        used = used.unionByName(free.select("kind", "surrogate"))


_NAMES = ("surname", "given_m", "given_f")  # what a mention is replaced as, the first that the text has
_MENTIONED, _LAST = "mention", "last"  # kinds of tokens that are no match


def tokens_of(pieces: Column) -> Column:
    """array<struct<gap, kind, value, match>> of a marked text's pieces, matches at every second place: what may be replaced, and the text before it.

    A match gives a token for each of its parts; in a text with a found name every other capitalised word is one (kind mention,
    no match). The last token has the rest of the text as its gap."""
    nth = lambda rest: F.filter(pieces, lambda x, i: i % 2 == rest)
    between = F.transform(nth(0), lambda x: F.replace(x, F.lit(_ITSELF), F.lit("\x01")))

    def token(gap: Column, kind: Column, value: Column, match: Column) -> Column:
        return F.struct(gap.alias("gap"), kind.alias("kind"), value.alias("value"), match.cast("int").alias("match"))

    def of_piece(m: Column, named: Column, x: Column, i: Column) -> Column:
        words = F.when(named, F.regexp_extract_all(x, F.lit(_MENTION), F.lit(0))).otherwise(F.array().cast("array<string>"))
        gaps = F.when(named, F.split(x, _MENTION, -1)).otherwise(F.array(x))
        none = F.lit(None)

        def build(w: Column, g: Column) -> Column:
            mentions = F.transform(w, lambda v, j: token(F.get(g, j), F.lit(_MENTIONED), v, none))
            rest, own = F.get(g, F.size(w)), F.get(m, i)
            parts = F.transform(own["parts"], lambda p, j: token(F.when(j == 0, F.concat(rest, own["prefix"])).otherwise(F.lit(" ")), p["kind"], p["value"], i))
            return F.concat(mentions, F.coalesce(parts, F.array(token(rest, F.lit(_LAST), F.lit(""), none))))

        return let(words, lambda w: let(gaps, lambda g: build(w, g)))

    named = lambda m: F.exists(m, lambda x: F.exists(x["parts"], lambda p: p["kind"].isin(*_NAMES)))
    return let(F.transform(nth(1), entities_of), lambda m: let(named(m), lambda n: F.flatten(F.transform(between, lambda x, i: of_piece(m, n, x, i)))))


def replace_entities(docs: DataFrame, key: str | None = None, count: str | None = "n_entities") -> DataFrame:
    """``docs`` with surrogates in ``text``, and the occurrences replaced in the column ``count``, if it is to have one.

    Replacements are joined with the places where they belong and put back by place, so a text's cost grows with its length, however many
    entities it has; equal texts are looked at once."""
    key = session_key(docs.sparkSession) if key is None else key
    rows = boxed(docs, marked(F.col("text").cast("string")).alias("marked"))
    rows = materialise(rows.select("doc", F.when(F.col("marked").isNotNull(), tokens_of(F.split("marked", f"{_BEGIN}|{_END}", -1))).alias("tokens")), "marked-texts")
    text = F.col("doc.text")
    matched = rows.filter("tokens IS NOT NULL").select("doc", F.xxhash64(text).alias("row"), F.length(text).alias("size"), "tokens")

    bare = F.transform("tokens", lambda t: F.struct(t["kind"].alias("kind"), t["value"].alias("value"), t["match"].alias("match")))
    places = matched.select("row", "size", F.posexplode(bare).alias("k", "t")).select("row", "size", "k", "t.*")
    places = materialise(places.distinct().withColumn("normal", F.when(~F.col("kind").isin(_MENTIONED, _LAST, "particle"), normal_form(F.col("kind"), F.col("value")))), "entity-places")
    real = places.filter("normal IS NOT NULL").filter((F.col("kind") != "card") | (_luhn(F.col("normal")) % 10 == 0))
    mapping = assign_surrogates(real, key)
    columns = ["row", "size", "k", "kind", "value", "match", "by"]
    by = F.when(F.col("surrogate").isNotNull(), _render(F.col("kind"), F.col("value"), F.col("surrogate"))).alias("by")
    put = materialise(places.filter("normal IS NOT NULL").join(mapping, ["kind", "normal"], "left").select(*columns[:-1], by), "replacements")
    order = F.array_position(F.array(*(F.lit(k) for k in _NAMES)), F.col("kind"))
    names = put.filter(F.col("kind").isin(*_NAMES) & F.col("by").isNotNull()).groupBy("row", "size", "value").agg(F.min_by("by", order).alias("by"))
    mentions = places.filter(F.col("kind") == _MENTIONED).join(names, ["row", "size", "value"], "left").select(*columns)
    others = places.filter(F.col("kind").isin(_LAST, "particle")).withColumn("by", F.lit(None).cast("string")).select(*columns)
    replaced = F.col("by").isNotNull()
    of_row = put.unionByName(mentions).unionByName(others).groupBy("row", "size").agg(
        F.array_sort(F.collect_list(F.struct("k", "by"))).alias("by"),  # of one text, as many as it has tokens
        (F.size(F.collect_set(F.when(replaced, F.col("match")))) + F.count_if(replaced & (F.col("kind") == _MENTIONED))).cast("long").alias("n"),
    )
    held = matched.join(materialise(of_row, "surrogates-of-rows"), ["row", "size"], "left")
    rebuilt = F.array_join(F.transform("tokens", lambda t, i: F.concat(t["gap"], F.coalesce(F.get("by", i)["by"], t["value"]))), "")

    def out(rows: DataFrame, text: Column, n: Column) -> DataFrame:
        own = [text.alias(x) if x == "text" else F.col("doc").getField(x).alias(x) for x in docs.columns if x != count]
        return rows.select(*own, *([n.alias(count)] if count else []))

    clean = out(rows.filter("tokens IS NULL"), text, F.lit(0).cast("long"))
    return clean.unionByName(out(held, rebuilt, F.coalesce("n", F.lit(0)).cast("long")))
