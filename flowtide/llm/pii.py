"""PII surrogates in DataFrame operations only: every detected entity gets a keyed replacement of its own kind.

Kinds: e-mail addresses, secrets (access keys, long hex strings), IPv4 addresses, bank account numbers (IBAN), card
and account numbers (13 to 19 digits), phone numbers, social security numbers, and names after a form of address.

A surrogate is a function of (key, kind, normal form, attempt), so one entity has the same surrogate in all documents
and spellings (coreference). Numbers go through a keyed four-round Feistel permutation of their digits, which maps
distinct entities of one length to distinct surrogates; Luhn-valid card numbers stay Luhn-valid, and account numbers
keep right check digits. A bare number of 13 to 19 digits is a card if it begins like one or is Luhn-valid. Other kinds draw
letters for letters and digits for digits, in the script and case of the original; names keep the gender that the form
of address shows, and equal name words get equal surrogates.

Collision check: the distinct entities of the whole corpus are compared with all surrogates. Where two entities would
share a surrogate, or a surrogate is itself an entity of the corpus, all but the first entity move on to another
attempt until none is left. Only these exceptions are joined back to texts; with none, no text is shuffled.

Account numbers are known by the length and form of their country; their check digits aren't asked, as a mistyped
number is personal too. Host names have at most 126 dots. Every pattern is tried in linear time. Case tells apart secrets that begin with gh*_ or sk-, and no others.

Defined results: null stays null; texts without entities are unchanged. Entities never overlap: the leftmost counts,
and kinds are tried in the order above. Repeated rows get equal texts. Other columns pass through.
"""

from __future__ import annotations

import re
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.llm.common import stored

# Forms of address, and the pools that given names are drawn from.
_MALE = ("Mr", "Herr", "Herrn", "Señor", "Monsieur", "Sir", "Господин", "г-н")
_FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Madame", "Mme", "Mlle", "Lady", "Госпожа", "г-жа")
_EITHER = ("Dr", "Prof")
_GIVEN = {"m": ("Adam", "Anton", "Bruno", "David", "Emil", "Felix", "Hugo", "Jonas", "Karl", "Leon", "Martin", "Oskar", "Paul", "Simon", "Tomas", "Victor"),
          "f": ("Ada", "Anna", "Clara", "Diana", "Elena", "Emma", "Greta", "Ines", "Julia", "Laura", "Maria", "Nora", "Olga", "Paula", "Rosa", "Vera")}
_GIVEN_CYRILLIC = {"m": ("Андрей", "Борис", "Виктор", "Денис", "Егор", "Иван", "Максим", "Павел"),
                   "f": ("Алла", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Ольга", "Татьяна")}
_SYLLABLES = ("ba", "de", "fi", "go", "hu", "ka", "le", "mi", "no", "pu", "ra", "se", "ti", "vo", "wu", "za")
_SYLLABLES_CYRILLIC = ("ба", "де", "фи", "го", "ху", "ка", "ле", "ми", "но", "пу", "ра", "се", "ти", "во", "лу", "за")

#: Account numbers by country as the registry has them: runs of digits (n), capitals (a) and either (c).
_IBAN = {
    "4a5n18c": "MT", "4a14n": "GB IE", "4a10n": "NL", "4a6n8c": "BG", "4a14c": "BH", "4a15c": "GI", "4a15n": "IQ", "4a13c": "LV", "4a16c": "PK RO", "4a16n": "VG", "4a20c": "AZ",
    "4a20n": "HN NI SV", "4a21c": "PS QA", "4a22c": "KW", "4a24c": "LC", "4a4n18c": "JO YE", "4a19n3a": "MU", "4a20n3a": "SC", "2a12n": "FK", "2a16n": "GE", "1a10n12c": "IT SM",
    "4c4n16c": "BY", "4c20n": "DO", "24c": "GT", "20c": "MD", "10n11c2n": "FR MC", "23n1a1c": "BR", "3n10c2n": "MK", "8n12c": "AD", "8n16c": "AL CY", "5n12c": "CH LI", "7n16c": "GR",
    "3n13c": "KZ LU", "4n20c": "LB", "3n16c": "OM", "14n15c": "RU", "2n18c": "SA", "6n16c": "TR", "6n19c": "UA", "11n": "NO", "12n": "BE", "14n": "DK FI FO GL SD", "15n": "SI",
    "16n": "AT BA EE LT MN XK", "17n": "HR", "18n": "CR DE ME RS VA", "19n": "AE IL SO TL", "20n": "CZ ES SE SK TN", "21n": "LY PT ST", "22n": "IS", "23n": "BI DJ MR", "24n": "HU PL", "25n": "EG",
}
_CLASS = {"n": "[0-9]", "a": "[A-Z]", "c": "[A-Z0-9]"}


def _iban(form: str, countries: str) -> str:
    """Numbers of one form, compact or in groups of four."""
    each = "".join(c * int(n) for n, c in re.findall(r"([0-9]+)([nac])", form))
    groups = (each[k:k + 4] for k in range(0, len(each), 4))
    return f"(?:{countries.replace(' ', '|')})[0-9]{{2}}" + "".join(" ?" + "".join(f"{_CLASS[c]}{{{len(list(run))}}}" for c, run in groupby(g)) for g in groups)


_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_ADDRESS = "(?:" + "|".join(sorted(_MALE + _FEMALE + _EITHER, key=len, reverse=True)) + r")\.?"
#: Kind and pattern, in order of precedence.
KINDS = (
    # Tried where a run of address characters begins, or where the last entity ended; a host has at most 126 dots.
    ("email", r"(?:(?<![\p{L}\p{N}._%+-])|\G)[\p{L}\p{N}._%+-]++@(?:[A-Za-z0-9-]++\.){1,126}[A-Za-z]{2,}"),
    ("secret", r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+|A[KS]IA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|sk-[A-Za-z0-9]{20,}+)(?![A-Za-z0-9])"),
    ("ip", rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])"),
    # Of countries that aren't listed, whole groups only.
    ("iban", r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(_iban(*x) for x in _IBAN.items()) + r"|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7})(?![A-Za-z0-9])"),
    ("card", r"(?<![0-9A-Za-z+])(?:[0-9]{13,19}|(?:[0-9]{4}[ -]){3}[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])"),
    ("phone", r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[.-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9A-Za-z])"),
    ("ssn", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    ("name", rf"(?<![\p{{L}}\p{{N}}]){_ADDRESS} \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+){{0,2}}"),
)
PATTERN = "|".join(f"(?:{p})" for _, p in KINDS)
#: What card issuers begin with; other bare numbers are cards only where their check digit is right.
_ISSUER = "^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
#: What every entity holds at least; most texts end here.
_HINT = rf"[0-9@]|A[KS]IA|gh[pousr]_|sk-|[a-f]{{32}}|[A-F]{{32}}|(?<![\p{{L}}\p{{N}}]){_ADDRESS} \p{{Lu}}"


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once and stands once in the plan."""
    return F.transform(F.array(value), lambda v: use(v))[0]


def _rx(column: Column, pattern: str) -> Column:
    return F.regexp_like(column, F.lit(pattern))


def entities(text: Column) -> Column:
    """The entities of a text, in order."""
    return F.when(_rx(text, _HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def kind(entity: Column) -> Column:
    found = F.lit("name")
    for name, pattern in reversed(KINDS[:-1]):
        # Context is gone here, so the whole entity has to fit.
        found = F.when(_rx(entity, f"^(?:{pattern})$"), name).otherwise(found)
    return found


def entity_kind(entity: Column) -> Column:
    """The kind of an entity; null for a bare number (a time, a book or order number) that no card looks like."""
    bare = _rx(entity, "^[0-9]+$") & ~_rx(entity, _ISSUER)
    return _let(kind(entity), lambda of: F.when((of == "card") & bare & (_luhn_sum(entity) % 10 != 0), F.lit(None)).otherwise(of))


def normal(entity: Column, of: Column) -> Column:
    """One form for all spellings of an entity."""
    digits = F.regexp_replace(entity, "[^0-9]", "")
    return (F.when(of.isin("card", "phone", "ssn"), digits).when(of == "email", F.lower(entity))
            .when(of == "iban", F.replace(entity, F.lit(" "), F.lit("")))
            .when(of == "secret", F.when(_rx(entity, "^(?:gh[pousr]_|sk-)"), entity).otherwise(F.lower(entity)))
            .when(of == "ip", F.array_join(F.transform(F.split(entity, r"\."), lambda x: x.cast("int").cast("string")), "."))
            .otherwise(F.regexp_replace(entity, r"^(\S+?)\.? ", "$1 ")))


def _digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u001f", F.lit(key), *parts).cast("binary"), 512)


def _number(hexes: Column, at: Column | int, size: int) -> Column:
    return F.conv(F.substring(hexes, at, size) if isinstance(at, int) else hexes.substr(at, F.lit(size)), 16, 10).cast("long")


def _feistel(key: str, digits: Column, *tweak: Column) -> Column:
    """A keyed permutation of the digit strings of each length (2 to 36 digits)."""
    ten = lambda n: F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("decimal(38,0)")

    def turned(d: Column) -> Column:
        a = (F.length(d) / 2).cast("int")
        b = F.length(d) - a
        start = F.struct(d.substr(F.lit(1), a).cast("decimal(38,0)").alias("l"), d.substr(a + 1, b).cast("decimal(38,0)").alias("r"))

        def turn(state: Column, no: Column) -> Column:
            """Even rounds move the left half by a draw from the right one, odd rounds the other way; halves swap."""
            even = no % 2 == 0
            draw = F.conv(F.substring(_digest(key, F.lit("feistel"), no.cast("string"), F.length(d).cast("string"), state["r"].cast("string"), *tweak), 1, 15), 16, 10).cast("decimal(38,0)")
            return F.struct(state["r"].alias("l"), ((state["l"] + draw) % ten(F.when(even, a).otherwise(b))).cast("decimal(38,0)").alias("r"))
        end = F.aggregate(F.array(*map(F.lit, range(4))), start, turn)
        return _let(end, lambda e: F.concat(F.lpad(e["l"].cast("string"), a, F.lit("0")), F.lpad(e["r"].cast("string"), b, F.lit("0"))))
    return _let(digits, turned)


def _luhn_sum(digits: Column) -> Column:
    """Weighted digit sum with the last digit undoubled."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.when((n - i) % 2 == 1, (lambda d: d * 2 - F.when(d > 4, 9).otherwise(0))(digits.substr(i, F.lit(1)).cast("int"))).otherwise(digits.substr(i, F.lit(1)).cast("int")))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def _mod97(text: Column) -> Column:
    """Remainder by 97 of the number that digits and capitals (A is 10) spell."""
    def add(rest: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), rest * 10 + c.try_cast("int")).otherwise(rest * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.split(text, ""), F.lit(0), add)


def _refill(entity: Column, digits: Column) -> Column:
    """``digits`` in the places of the entity's digits."""
    rank = lambda i: F.length(F.regexp_replace(entity.substr(F.lit(1), i), "[^0-9]", ""))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(entity)), lambda i: F.when(entity.substr(i, F.lit(1)).between("0", "9"), digits.substr(rank(i), F.lit(1))).otherwise(entity.substr(i, F.lit(1)))), "")


def _pick(pool: tuple[str, ...], by: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, pool)), (by % len(pool)).cast("int") + 1)


def _letters(text: Column, hexes: Column, hexadecimal: bool = False) -> Column:
    """A letter for each letter, of its case and script, and a digit for each digit."""
    pools = (("[0-9]", "0123456789"), ("[a-f]" if hexadecimal else "[a-z]", "abcdef" if hexadecimal else "abcdefghijklmnopqrstuvwxyz"),
             ("[A-Z]", "ABCDEF" if hexadecimal else "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (r"\p{IsCyrillic}", "абвгдежзиклмнопрстуфхцшэюя"), (r"\p{Lu}", "ÀÁÈÉÍÒÓÖÚÜ"), (r"\p{IsLatin}", "àáèéíòóöúü"), (r"\p{IsHan}", "安白成德方光海林明天"))

    def one(c: Column, i: Column) -> Column:
        draw = _number(hexes, (i % 63) * 2 + 1, 4)
        out = c
        for cls, pool in reversed(pools):
            out = F.when(_rx(c, f"^{cls}$"), F.substring(F.lit(pool), (draw % len(pool)).cast("int") + 1, F.lit(1))).otherwise(out)
        return out
    return F.array_join(F.transform(F.split(text, ""), one), "")


def _word(word: Column, hexes: Column, more: Column) -> Column:
    """A surname for ``word``: syllables of its script, more of them at later attempts, in its case."""
    def made(pool: tuple[str, ...]) -> Column:
        return F.initcap(F.array_join(F.transform(F.sequence(F.lit(0), F.least(more, F.lit(20)) + 3), lambda i: _pick(pool, _number(hexes, i * 5 + 1, 5))), ""))
    out = F.when(_rx(word, r"\p{IsCyrillic}"), made(_SYLLABLES_CYRILLIC)).otherwise(made(_SYLLABLES))
    return F.when((word == F.upper(word)) & (F.length(word) > 1), F.upper(out)).otherwise(out)


def _name(key: str, norm: Column, attempt: Column) -> Column:
    parts = F.split(norm, " ")
    address = parts[0]
    male = F.when(address.isin(*_MALE), True).when(address.isin(*_FEMALE), False).otherwise(_number(_digest(key, F.lit("gender"), norm), 1, 2) % 2 == 0)
    last = F.size(parts) - 1

    def one(word: Column, i: Column) -> Column:
        def drawn(hexes: Column) -> Column:
            draw, cyrillic = _number(hexes, 1, 6), _rx(word, r"\p{IsCyrillic}")
            given = F.when(cyrillic & male, _pick(_GIVEN_CYRILLIC["m"], draw)).when(cyrillic, _pick(_GIVEN_CYRILLIC["f"], draw)).when(male, _pick(_GIVEN["m"], draw)).otherwise(_pick(_GIVEN["f"], draw))
            return F.when(i == last, _word(word, hexes, attempt)).otherwise(given)
        return F.when(i == 0, word).otherwise(_let(_digest(key, F.lit("name"), F.lower(word), attempt.cast("string")), drawn))
    return F.array_join(F.transform(parts, one), " ")


def surrogate(key: str, of: Column, norm: Column, attempt: Column) -> Column:
    """The normal form of the surrogate for a normal form."""
    tweak = (of, attempt.cast("string"))
    hexes = _digest(key, of, norm, attempt.cast("string"))
    body = norm.substr(F.lit(1), F.length(norm) - 1)
    checked = lambda moved: F.concat(moved, ((10 - _luhn_sum(F.concat(moved, F.lit("0"))) % 10) % 10).cast("string"))
    luhn = (of == "card") & (_luhn_sum(norm) % 10 == 0)
    number = _let(_feistel(key, F.when(luhn, body).otherwise(norm), *tweak), lambda moved: F.when(luhn, checked(moved)).otherwise(moved))

    def ip(h: Column) -> Column:
        octets = F.split(norm, r"\.")
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: ((F.get(octets, i).cast("int") + _number(h, i * 6 + 1, 6)) % 256).cast("string")), ".")

    def email(h: Column) -> Column:
        at, top = F.instr(norm, "@"), F.substring_index(norm, ".", -1)
        host = norm.substr(at + 1, F.length(norm) - at - F.length(top) - 1)
        return F.concat(_letters(norm.substr(F.lit(1), at - 1), h), F.lit("@"), _let(_digest(key, F.lit("host"), host, attempt.cast("string")), lambda g: _letters(host, g)), F.lit("."), top)

    def secret(h: Column) -> Column:
        prefix = F.regexp_extract(norm, "^(?:a[ks]ia|gh[pousr]_|sk-)", 0)
        rest = norm.substr(F.length(prefix) + 1, F.length(norm))
        return F.concat(prefix, F.when(prefix == "", _letters(rest, h, True)).otherwise(_letters(rest, h)))

    def iban(h: Column) -> Column:
        """Right check digits where the original's are right."""
        land, tail = norm.substr(1, 2), norm.substr(F.lit(5), F.length(norm))
        right = _mod97(F.concat(tail, land, norm.substr(3, 2))) == 1
        made = lambda t: F.concat(land, F.when(right, F.lpad((98 - _mod97(F.concat(t, land, F.lit("00")))).cast("string"), 2, "0")).otherwise(_letters(norm.substr(3, 2), F.substring(h, 100, 28))), t)
        return _let(_letters(tail, h), made)
    return (F.when(of.isin("card", "phone", "ssn"), number).when(of == "ip", _let(hexes, ip)).when(of == "email", _let(hexes, email))
            .when(of == "iban", _let(hexes, iban)).when(of == "secret", _let(hexes, secret)).otherwise(_name(key, norm, attempt)))


def dressed(entity: Column, of: Column, surrogate_form: Column) -> Column:
    """The surrogate in the entity's own spelling."""
    def spelled(made: Column) -> Column:
        upper = (entity == F.upper(entity)) & (entity != F.lower(entity))
        dotted = F.when(_rx(entity, r"^\S+\. "), F.regexp_replace(made, "^(\\S+) ", "$1. ")).otherwise(made)
        return (F.when(of.isin("card", "phone", "ssn"), _refill(entity, made)).when(of == "iban", _spaced(entity, made))
                .when(of.isin("email", "secret") & (upper | _rx(entity, "^A[KS]IA")), F.upper(made))
                .when(of == "name", dotted).otherwise(made))
    return _let(surrogate_form, spelled)


def _spaced(entity: Column, made: Column) -> Column:
    rank = lambda i: F.length(F.replace(entity.substr(F.lit(1), i), F.lit(" "), F.lit("")))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(entity)), lambda i: F.when(entity.substr(i, F.lit(1)) == " ", " ").otherwise(made.substr(rank(i), F.lit(1)))), "")


def collisions(found: DataFrame, key: str) -> DataFrame:
    """(kind, norm, attempt) of the entities in ``found`` (kind, norm) that can't keep their first surrogate."""
    real = stored(found.distinct(), "entities")
    drawn = stored(real.select("kind", "norm", F.lit(0).alias("attempt"), surrogate(key, F.col("kind"), F.col("norm"), F.lit(0)).alias("made")), "surrogates")
    moved = None
    while True:
        # Of the entities with one surrogate the first stays; none may look like an entity of the corpus.
        held = drawn.groupBy("kind", "made").agg(F.min(F.struct("attempt", "norm")).alias("first"))
        taken = real.select("kind", F.col("norm").alias("made"), F.lit(True).alias("is_real"))
        checked = drawn.join(held, ["kind", "made"]).join(taken, ["kind", "made"], "left")
        clash = F.col("is_real").isNotNull() | (F.struct("attempt", "norm") != F.col("first"))
        lost = stored(checked.filter(clash).select("kind", "norm", (F.col("attempt") + 1).alias("attempt")), "moved")
        if lost.isEmpty():
            return drawn.filter("attempt > 0").select("kind", "norm", "attempt") if moved is not None else lost
        moved = lost.withColumn("made", surrogate(key, F.col("kind"), F.col("norm"), F.col("attempt")))
        drawn = stored(drawn.join(lost.select("kind", "norm"), ["kind", "norm"], "left_anti").unionByName(moved), "surrogates")


def pseudonymized(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with every entity of column ``text`` replaced, and ``n_entities`` in front."""
    held = F.struct(*[docs[c] for c in docs.columns if c != text]).alias("row")
    rows = docs.select(held, F.col(text).alias("text"))
    listed = rows.select("text").withColumn("e", F.explode(entities(F.col("text")))).select(F.xxhash64("text").alias("text_key"), "e")
    listed = listed.withColumn("kind", entity_kind(F.col("e"))).filter(F.col("kind").isNotNull())
    found = stored(listed.select("text_key", "kind", normal(F.col("e"), F.col("kind")).alias("norm")), "found-entities")
    moved = stored(collisions(found.select("kind", "norm"), key), "moved-entities")
    if moved.isEmpty():
        rows = rows.withColumn("attempts", F.lit(None).cast("map<string,int>"))
    else:
        by_text = found.distinct().join(moved, ["kind", "norm"]).groupBy("text_key").agg(
            F.map_from_entries(F.collect_list(F.struct(F.concat_ws(" ", "kind", "norm"), "attempt"))).alias("attempts"))
        rows = rows.withColumn("text_key", F.xxhash64("text")).join(by_text, "text_key", "left").drop("text_key")

    def replaced(x: Column) -> Column:
        return F.when(x["kind"].isNull(), x["e"]).otherwise(exchanged(x["e"], x["kind"]))

    def exchanged(e: Column, of: Column) -> Column:
        tries = lambda of, norm: F.coalesce(F.element_at(F.col("attempts"), F.concat_ws(" ", of, norm)), F.lit(0))
        return _let(normal(e, of), lambda norm: _let(tries(of, norm), lambda n: dressed(e, of, surrogate(key, of, norm, n))))
    rows = rows.withColumn("entities", F.transform(entities(F.col("text")), lambda e: F.struct(e.alias("e"), entity_kind(e).alias("kind"))))
    parts = F.split("text", PATTERN, -1)
    new = F.concat(F.array_join(F.zip_with(F.slice(parts, 1, F.size("entities")), F.transform("entities", replaced), lambda a, b: F.concat(a, b)), ""), F.element_at(parts, -1))
    done = F.when(F.size("entities") > 0, new).otherwise(F.col("text"))
    columns = [done.alias(text) if c == text else F.col("row")[c].alias(c) for c in docs.columns]
    return rows.select(F.coalesce(F.size(F.filter("entities", lambda x: x["kind"].isNotNull())), F.lit(0)).alias("n_entities"), *columns)
