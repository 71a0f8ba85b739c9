"""Surrogates for personal data, in DataFrame functions only.

Detected entities (e-mail and network addresses, telephone, card and social-security numbers, account numbers, secrets,
titled names, birth dates behind their keyword, streets with a house number) are listed once each for the whole corpus.
Names without a title are not found: only a word list could tell them from other capitalised words. Every one gets a replacement drawn by a keyed hash within its own
format: digits for digits, letters for letters of the same case and script, valid octets, card numbers that pass the same
check, names of the same gender. Draws that meet another entity's replacement or a real entity are drawn again, so
different entities stay different and equal ones stay equal in all documents.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossworks.llm.common import broadcast_if_small, documents, let, text_or_empty, unused, written

KEY = "surrogates-1"
#: From this round on draws come from a wider space of the same type, wider each round.
WIDEN = 4
#: So many rounds in a row without a single new replacement mean that a format of fixed size is full.
BARREN = 32

# Titles before names, by gender and script.
MALE = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "господин", "Господин")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа", "Госпожа")
# Syllables that names are made of, and the endings of given names.
LATIN = ("ba", "bel", "car", "da", "del", "fa", "fen", "ga", "han", "jo", "kar", "la", "len", "ma", "mer", "na", "nor", "pa", "ran", "ro", "sa", "sol", "ta", "tor", "va", "ven", "wil", "yar", "za", "zen", "bri", "cla")
CYRILLIC = ("ба", "бел", "вар", "да", "дел", "га", "ган", "жо", "кар", "ла", "лен", "ма", "мер", "на", "нор", "па", "ран", "ро", "са", "сол", "та", "тор", "ва", "вен", "вил", "яр", "за", "зен", "бри", "кла", "ми", "ни")
ENDINGS = {"given_m": ("n", "rd", "s", "l"), "given_f": ("na", "lia", "ra", "sa"), "given": ("ley", "ry", "dy", "sy"), "surname": ("man", "son", "ler", "ner")}
ENDINGS_CYRILLIC = {"given_m": ("н", "р", "с", "л"), "given_f": ("на", "лия", "ра", "са"), "given": ("ся", "ля", "ня", "ша"), "surname": ("ов", "ин", "ко", "ев")}

NEUTRAL = ("Dr", "Prof", "Mx", "Dra")
# Words before a birth date, and the last words of street names.
BORN = ("born", "born on", "date of birth", "birth date", "DOB", "geboren am", "Geburtsdatum", "né le", "née le", "date de naissance", "nacido el", "nacida el", "fecha de nacimiento")
STREETS = ("Street", "St", "Road", "Rd", "Avenue", "Ave", "Lane", "Drive", "Boulevard", "Blvd", "Court", "Square", "Terrace")
MALE, FEMALE, NEUTRAL, STREETS = (tuple(dict.fromkeys((*titles, *(t.upper() for t in titles)))) for titles in (MALE, FEMALE, NEUTRAL, STREETS))

TITLE = "|".join(MALE + FEMALE + NEUTRAL)
#: One name: parts joined by hyphens and apostrophes, two letters at least. Possessive, as all repeated groups here: Java
#: matches these in a loop, where others take a stack frame for every round of a long text.
NAME = r"\p{Lu}(?=['’-]?\p{L})\p{L}*+(?:['’-]\p{L}++)*+"
BIRTH = rf"(?:{'|'.join(f'(?i:{b})' for b in sorted(BORN, key=len, reverse=True))})[: ]{{1,3}}+"
DATE = r"(?:(?:19|20)\d{2}[-./]\d{2}[-./]\d{2}|\d{1,2}[-./]\d{1,2}[-./](?:19|20)\d{2})"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Kinds in the order in which they claim a match; each stands by itself within the text.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    "mac": r"(?<![\w:])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![\w:])",
    "ipv6": r"(?<![\w:.])(?=[A-Fa-f:]*+\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|(?:[0-9A-Fa-f]{1,4}:){2,7}:)(?![\w:])",
    "ip": rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\w.+-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])",
    "card": r"(?<![\w.])\d(?:[ -]?\d){12,18}(?!\d)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9A-Fa-f]{32,}|AKIA[0-9A-Z]{16}|(?:gh[pousr]|GH[POUSR])_[A-Za-z0-9]{36}|(?:sk|SK)-[A-Za-z0-9]{20,})(?![A-Za-z0-9])",
    "street": rf"(?<![\w.,-])\d{{1,5}} {NAME}(?: {NAME})? (?:{'|'.join(STREETS)})(?!\w)",
    "birth": rf"(?<!\w){BIRTH}{DATE}(?!\d)",
    "name": rf"(?<!\w)(?:{TITLE})\.? {NAME}(?: {NAME})?(?!\p{{L}})",
}
MASTER = "|".join(f"(?:{p})" for p in KINDS.values())
#: Every entity has a digit, an @, a title or the start of a secret in it: a cheap test before the long pattern.
HINT = rf"[0-9@]|(?:{TITLE})\.? \p{{Lu}}|(?:sk|SK)-|(?:gh[pousr]|GH[POUSR])_|AKIA|[A-Fa-f]{{32}}"
UNIT = "struct<kind:string,value:string>"


def _unit(kind: Column | None, value: Column) -> Column:
    return F.struct((F.lit(None).cast("string") if kind is None else kind).alias("kind"), value.alias("value"))


def _is(value: Column, kind: str) -> Column:
    return value.rlike(f"^(?:{KINDS[kind]})$")


def units(match: Column) -> Column:
    """A match as an array of (kind, value); kind is null for what stays: titles, keywords, blanks, and other numbers.

    After a title, a first of two names is a given name of the title's gender, the last one a surname. Thirteen digits or
    more are a card where they pass its check, or stand in four groups of four behind a card's first digit; times in
    milliseconds, book and order numbers stay.
    """
    title = F.regexp_extract(match, rf"^(?:{TITLE})\.? ", 0)
    names = F.split(F.regexp_replace(match, rf"^(?:{TITLE})\.? ", ""), " ")
    male = F.regexp_replace(F.trim(title), r"\.$", "").isin(*MALE)
    neutral = F.regexp_replace(F.trim(title), r"\.$", "").isin(*NEUTRAL)
    given = F.when(male, F.lit("given_m")).when(neutral, F.lit("given")).otherwise(F.lit("given_f"))
    two = F.array(_unit(None, title), _unit(given, names[0]), _unit(None, F.lit(" ")), _unit(F.lit("surname"), F.get(names, F.lit(1))))
    one = F.array(_unit(None, title), _unit(F.lit("surname"), names[0]))
    found = F.when(F.size(names) > 1, two).otherwise(one)
    keyword = F.regexp_extract(match, f"^{BIRTH}", 0)
    last = F.concat(F.lit(" "), F.substring_index(match, " ", -1))
    parts = {
        "birth": F.array(_unit(None, keyword), _unit(F.lit("date"), F.substring(match, F.length(keyword) + 1, F.length(match)))),
        "street": F.array(_unit(F.lit("street"), F.substring(match, F.lit(1), F.length(match) - F.length(last))), _unit(None, last)),
        "card": F.array(_unit(F.when((luhn(match) == 0) | match.rlike(r"^[3-6]\d{3}([ -]\d{4}){3}$"), "card"), match)),
    }
    for kind in reversed([k for k in KINDS if k != "name"]):
        found = F.when(_is(match, kind), parts.get(kind, F.array(_unit(F.lit(kind), match)))).otherwise(found)
    return found


def _pick(secret: Column, i: Column, choices: str | tuple[str, ...]) -> Column:
    """One of ``choices``, by the keyed hash and a place."""
    n = len(choices)
    at = F.pmod(F.xxhash64(secret, i), F.lit(n)).cast("int")
    return F.substring(F.lit(choices), at + 1, F.lit(1)) if isinstance(choices, str) else F.array(*map(F.lit, choices))[at]


def _each(value: Column, body) -> Column:
    return F.array_join(F.transform(F.split(value, ""), lambda c, i: body(c, i)), "")


#: Characters in a row of one script, as a rule; a letter is replaced by one of the same case from the same row.
ROW = 32
CASES = ("Lu", "Ll", "Lo")


def _rows() -> dict[str, str]:
    """Letters by case and row, like ``Ll:7`` for small Greek ones; ideographs and Hangul have one row each."""
    out: dict[str, str] = {}
    for cp in (*range(0x100, 0x3100), *range(0x4E00, 0x5000), *range(0xAC00, 0xAE00)):
        c = chr(cp)
        case = unicodedata.category(c)
        if case in CASES and unicodedata.normalize("NFKC", c) == c:
            row = f"{case}:{'ideograph' if 0x4E00 <= cp < 0x5000 else 'hangul' if cp >= 0xAC00 else cp // ROW}"
            out[row] = out.get(row, "") + c
    return {k: v for k, v in out.items() if len(v) > 1}


LETTER_ROWS = _rows()


def _other_letters(secret: Column, c: Column, i: Column) -> Column:
    """A letter outside Latin-1 and basic Cyrillic: one of its row; of an unknown row, an ASCII one of the same case."""
    code = F.ascii(c)
    case = F.when(c.rlike(r"^\p{Lu}$"), "Lu").when(c.rlike(r"^\p{Ll}$"), "Ll").otherwise("Lo")
    ideograph = code.between(0x3400, 0x9FFF) | code.between(0xF900, 0xFAFF) | (code >= 0x20000)
    row = F.when(ideograph, "ideograph").when(code.between(0xAC00, 0xD7A3), "hangul").otherwise(F.floor(code / ROW).cast("string"))
    table = F.create_map(*(F.lit(x) for pair in LETTER_ROWS.items() for x in pair))
    known = F.element_at(table, F.concat_ws(":", case, row))
    choices = F.coalesce(known, F.when(case == "Lu", "ABCDEFGHIJKLMNOPQRSTUVWXYZ").otherwise("abcdefghijklmnopqrstuvwxyz"))
    return F.substring(choices, F.pmod(F.xxhash64(secret, i), F.length(choices)).cast("int") + 1, F.lit(1))


def _letters(secret: Column, c: Column, i: Column) -> Column:
    """A character of the same class: digit, or letter of the same case and script; all others stay.

    A digit of any script becomes an ASCII one; a letter is never left as it is but by the draw.
    """
    out = F.when(c.rlike(r"^\p{L}$"), _other_letters(secret, c, i)).when(c.rlike(r"^\p{N}$"), _pick(secret, i, "0123456789")).otherwise(c)
    for class_, choices in (
        ("[0-9]", "0123456789"), ("[a-z]", "abcdefghijklmnopqrstuvwxyz"), ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        ("[à-öø-ÿ]", "àáâãäåèéêëìíîïòóôõöùúûü"), ("[À-ÖØ-Þ]", "ÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜ"),
        ("[а-я]", "абвгдежзиклмнопрстуфхцчшэюя"), ("[А-Я]", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"),
    ):
        out = F.when(c.rlike(f"^{class_}$"), _pick(secret, i, choices)).otherwise(out)
    return out


def _hex(secret: Column, value: Column) -> Column:
    def made(letters: str) -> Column:
        return _each(value, lambda c, i: F.when(c.rlike(f"^[0-9{letters}]$"), _pick(secret, i, "0123456789" + letters)).when(c.rlike("^[A-F]$"), _pick(secret, i, "ABCDEF")).otherwise(c))

    return F.when(value.rlike("[A-F]") & ~value.rlike("[a-f]"), made("ABCDEF")).otherwise(made("abcdef"))


def luhn(value: Column) -> Column:
    """The card check sum of a number's digits, modulo 10: 0 where it passes."""
    digits = F.reverse(F.split(F.regexp_replace(value, "[^0-9]", ""), ""))

    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.transform(digits, worth), F.lit(0), lambda a, b: a + b) % 10


def _card(secret: Column, value: Column) -> Column:
    """Other digits behind the first; where the number passed its check, the last digit makes this one pass too."""
    drawn = F.concat(F.substring(value, 1, 1), _each(F.substring(value, F.lit(2), F.length(value)), lambda c, i: F.when(c.rlike("^[0-9]$"), _pick(secret, i, "0123456789")).otherwise(c)))
    zero = F.concat(F.substring(drawn, F.lit(1), F.length(drawn) - 1), F.lit("0"))
    fitted = let(zero, lambda z: F.concat(F.substring(z, F.lit(1), F.length(z) - 1), ((10 - luhn(z)) % 10).cast("string")))
    return F.when(luhn(value) == 0, fitted).otherwise(drawn)


def _ip(secret: Column, value: Column, nonce: int) -> Column:
    """Octets of as many digits; of any number of digits once several draws have met others."""

    def octet(o: Column, i: Column) -> Column:
        h = F.xxhash64(secret, i)
        wide = (F.pmod(h, F.lit(254)) + 1).cast("string")
        own = (
            F.when(F.length(o) == 1, F.pmod(h, F.lit(9)) + 1).when(F.length(o) == 2, F.pmod(h, F.lit(90)) + 10).otherwise(F.pmod(h, F.lit(155)) + 100)
        ).cast("string")
        return wide if nonce >= WIDEN else own

    return F.array_join(F.transform(F.split(value, r"\."), octet), ".")


def _name(secret: Column, value: Column, kind: str, more: int) -> Column:
    """A name of three syllables and ``more``, and an ending."""

    def made(syllables: tuple[str, ...], endings: dict) -> Column:
        parts = [_pick(secret, F.lit(k), syllables) for k in range(3)] + [_pick(secret, F.lit(100 + k), syllables) for k in range(more)] + [_pick(secret, F.lit(9), endings[kind])]
        return F.initcap(F.concat(*parts))

    name = F.when(value.rlike(r"\p{IsCyrillic}"), made(CYRILLIC, ENDINGS_CYRILLIC)).otherwise(made(LATIN, ENDINGS))
    joint = F.regexp_extract(value, "['’-]", 0)  # a name of two parts gets one of two parts
    name = F.when(joint == "", name).otherwise(F.concat(name, joint, F.initcap(F.concat(*(_pick(secret, F.lit(200 + k), LATIN) for k in range(2))))))
    return F.when(value == F.upper(value), F.upper(name)).otherwise(name)


def _date(secret: Column, value: Column) -> Column:
    """A date written in the same way, and valid with day and month in either order."""

    def drawn(k: int, like: Column) -> Column:
        two, one = (F.pmod(F.xxhash64(secret, F.lit(300 + k)), F.lit(n)) + 1 for n in (12, 9))
        return F.when(F.length(like) == 1, one.cast("string")).otherwise(F.lpad(two.cast("string"), 2, "0"))

    numbers, signs = F.split(value, r"\D"), F.regexp_extract_all(value, F.lit(r"\D"), F.lit(0))
    year = (F.pmod(F.xxhash64(secret, F.lit(299)), F.lit(90)) + 1920).cast("string")
    parts = [F.when(F.length(numbers[k]) == 4, year).otherwise(drawn(k, numbers[k])) for k in range(3)]
    return F.concat(parts[0], signs[0], parts[1], signs[1], parts[2])


def surrogate(kind: Column, value: Column, nonce: int, key: str = KEY) -> Column:
    """The replacement that ``key`` and ``nonce`` draw for an entity, in the entity's format.

    After some rounds an address gets a longer local part, a name more syllables, an international number more digits.
    """
    secret = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, F.lit(str(nonce)), value), 256)
    more = max(0, nonce - WIDEN + 1)

    def drawn(s: Column) -> Column:
        whole = _each(value, lambda c, i: _letters(s, c, i))
        last = F.regexp_extract(value, r"\.[^.]*$", 0)  # an address keeps its top-level domain
        email = F.concat(_each(F.substring(value, F.lit(1), F.length(value) - F.length(last)), lambda c, i: _letters(s, c, i)), last)
        if more:
            local = F.repeat(F.lit("a"), F.least(F.lit(64), F.instr(value, "@") - 1 + more))
            domain = F.substring(email, F.instr(value, "@"), F.length(value))
            email = F.concat(_each(local, lambda c, i: _letters(s, c, i + 1000)), domain)
        code = F.regexp_extract(value, r"^\+\d{1,3}(?=\D)", 0)  # a number keeps its country code
        phone = F.concat(code, _each(F.substring(value, F.length(code) + 1, F.length(value)), lambda c, i: _letters(s, c, i)))
        if more:  # up to twelve digits, which four to a group always leave a number
            room = F.lit(12) - F.length(F.regexp_replace(value, "[^0-9]", ""))
            added = F.repeat(F.lit("0"), F.greatest(F.lit(0), F.least(F.lit(more), room)))
            phone = F.when(value.rlike(r"^\+[0-9 .-]+$"), F.concat(phone, _each(added, lambda c, i: _letters(s, c, i + 1000)))).otherwise(phone)
        iban = F.concat(F.substring(value, 1, 2), _each(F.substring(value, F.lit(3), F.length(value)), lambda c, i: _letters(s, c, i)))
        ssn = F.concat(_pick(s, F.lit(-1), "12345678"), F.substring(whole, F.lit(2), F.length(value)))
        prefix = F.regexp_extract(value, r"^(?:AKIA|(?:gh[pousr]|GH[POUSR])_|(?:sk|SK)-)", 0)
        secret_ = F.when(prefix == "", _hex(s, value)).otherwise(
            F.concat(prefix, _each(F.substring(value, F.length(prefix) + 1, F.length(value)), lambda c, i: _letters(s, c, i)))
        )
        out = F.when(kind == "email", email).when(kind == "ip", _ip(s, value, nonce)).when(kind == "phone", phone).when(kind == "card", _card(s, value))
        out = out.when(kind == "iban", iban).when(kind == "ssn", ssn).when(kind == "secret", secret_).when(kind == "mac", _hex(s, value))
        number = F.substring_index(value, " ", 1)
        out = out.when(kind == "ipv6", _hex(s, value)).when(kind == "date", _date(s, value))
        out = out.when(kind == "street", F.concat(_each(number, lambda c, i: _pick(s, i + 400, "123456789")), F.lit(" "), _name(s, F.substring_index(value, " ", -1), "surname", more)))
        for name in ENDINGS:
            out = out.when(kind == name, _name(s, value, name, more))
        return out.otherwise(whole)

    return let(secret, drawn)


def surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """``kind, value, surrogate`` for distinct ``kind, value``, with no two alike and none a real entity.

    Each round draws for those still without one. Of several that drew the same the smallest value keeps it; it is drawn
    again if a real entity has it or an earlier round gave it away. Rounds go on until none is left, from ever wider
    spaces. Where a format of fixed size (an IP address, a date, a social-security number) is full, those left over get a
    mark of their kind and a keyed hash instead, so that nothing real stays and nothing fails.
    """
    real = written(entities.select("kind", "value").distinct(), "entities")
    left, given, nonce, barren = real, None, 0, 0
    while barren < BARREN:
        drawn = left.withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), nonce, key))
        first = drawn.groupBy("kind", "surrogate").agg(F.min("value").alias("value"))
        taken = real.select("kind", F.col("value").alias("surrogate"))
        taken = taken if given is None else taken.unionByName(given.select("kind", "surrogate"))
        got = written(first.join(taken, ["kind", "surrogate"], "left_anti").select("kind", "value", "surrogate"), "surrogates")
        given = got if given is None else given.unionByName(got)
        left = written(left.join(got.select("kind", "value"), ["kind", "value"], "left_anti"), "undrawn")
        if left.isEmpty():
            return given
        nonce, barren = nonce + 1, barren + 1 if got.isEmpty() else 0
    mark = F.concat(F.lit("["), F.col("kind"), F.lit("-"), F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), "kind", "value"), 256), 1, 32), F.lit("]"))
    return given.unionByName(left.select("kind", "value", mark.alias("surrogate")))


def cut(docs: DataFrame, pieces: str = "pieces", found: str = "found", row: str = "row") -> DataFrame:
    """``docs`` cut at the matches: ``pieces`` of text around them and ``found``, each match's units; nulls without one.

    Where something was found ``text`` is null, as the pieces and matches hold all of it. ``row`` numbers the rows.
    """
    text = text_or_empty()
    matches = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(MASTER), F.lit(0)))
    own = docs.withColumn(found, matches)
    hit = F.size(found) > 0
    return own.select(
        *(c for c in docs.columns if c.lower() != "text"),
        F.when(~F.coalesce(hit, F.lit(False)), F.col("text")).alias("text"),
        F.when(hit, F.transform(found, units)).alias(found),
        F.when(hit, F.split(text, MASTER, -1)).alias(pieces),
        F.monotonically_increasing_id().alias(row),
    )


def replaced(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with ``text`` rewritten and ``n_entities`` added (any such column is replaced).

    Null texts stay null, empty ones empty; documents without an entity pass unchanged and never shuffle. Repeated rows
    are rewritten alike; an empty table gives no rows. All are searched once and written, those with entities cut at their
    matches; each match meets its replacement by kind and value (broadcast when measured small; else the join shuffles
    and Spark splits a value that very many documents have), and goes back to its own row.
    """
    names = [c for c in docs.columns if c != "n_entities"]
    found, pieces, row, number, unit_number, new = unused(names, "_found", "_pieces", "_row", "_i", "_j", "_new")
    rows = written(cut(docs.select(*names), pieces, found, row), "entity-rows")
    hits = rows.filter(F.col(found).isNotNull())
    each = hits.select(row, F.posexplode(found).alias(number, "_units")).select(row, number, F.posexplode("_units").alias(unit_number, "_unit"))
    each = each.select(row, number, unit_number, F.col("_unit.kind").alias("_kind"), F.col("_unit.value").alias("_value"))
    mapped = surrogates(each.filter("_kind is not null").select(F.col("_kind").alias("kind"), F.col("_value").alias("value")), key)
    mapped = written(mapped, "mapping")
    out = each.join(broadcast_if_small(mapped), (F.col("_kind") == F.col("kind")) & (F.col("_value") == F.col("value")), "left")
    out = out.groupBy(row, number).agg(F.sort_array(F.collect_list(F.struct(unit_number, F.coalesce("surrogate", "_value").alias("s")))).alias("u"))
    out = out.withColumn("s", F.array_join("u.s", "")).groupBy(row).agg(F.sort_array(F.collect_list(F.struct(number, "s"))).alias(new))
    whole = F.array_join(F.flatten(F.zip_with(pieces, F.col(new)["s"], lambda p, s: F.array(p, F.coalesce(s, F.lit(""))))), "")
    rewritten = hits.join(out, row).withColumn("text", whole).withColumn("n_entities", F.size(F.filter(found, lambda m: F.exists(m, lambda u: u["kind"].isNotNull()))).cast("long"))
    plain = rows.filter(F.col(found).isNull()).withColumn("n_entities", F.lit(0).cast("long"))
    return plain.select(*names, "n_entities").unionByName(rewritten.select(*names, "n_entities"))


def op10(spark, sf_dir: str) -> DataFrame:
    return replaced(documents(spark, sf_dir).select("doc_id", "text"))
