"""PII: format-preserving Feistel pseudonyms, in column expressions only.

One regular expression finds candidates, each is validated (Luhn sum, octet
range, calendar, numbering plan), and a valid value is permuted, under a key,
within the set of all valid values of its format:

=========  =============================================  ======================
kind       what is permuted                               what stays
=========  =============================================  ======================
card       all digits but the last, which is the Luhn     length, separators
           digit of the others
iban       the account's digits among themselves, its     country, layout
           letters too; the check digits follow
phone      area, exchange and line of the North American  country code, layout
           numbering plan (8 x 10 x 10 choices, twice)
abroad     the digits after + and two more of a number    first two digits, layout
           of 8 to 15
ssn        area, group and serial, without the reserved   layout
ip         the four octets as two halves
ip6        the 32 hexadecimal digits of eight groups
date       the day within its 400 years (1800 to 2199     layout
           and so on; the first and last 200 years of
           years 1 to 9999 together)
email      the letters among themselves, the digits too   domain, places
access     the 16 characters after AKIA                   AKIA
=========  =============================================  ======================

The permutation is an alternating Feistel network over Z_a x Z_b: eight rounds
``a += F(b)``, ``b += F(a)`` with F from SHA-256 of key, kind, round and value.
Strings are permuted in blocks of 26 signs, the first under what follows it and
each other under the new ones before it, so all signs of a string change together
and it can be turned back.  Equal values get equal pseudonyms in every document,
different values get different ones, and lengths do not change but for addresses'
octets.  A text is rebuilt from what lies between the matches; rows are
independent, nothing is shuffled, and texts without a digit, @ or AKIA skip all of it.

Defined cases: a null text stays null with nothing found; an empty text stays
empty; values that fail validation stay, and so do IPv6 addresses in a shortened
form; repeated rows, also without a key, get the same text; extra columns of any
name pass through ``pseudonymise`` unchanged; a column named like ``found`` is an
error.  The key is the caller's secret; the registered query takes it from the
session (``spark.tessera.pseudonymKey``) and has one for tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents

ROUNDS = 8

EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+(?<=\.[A-Za-z]{2,24})(?![\p{L}\p{N}_@])"
CARD = r"\d(?:[ -]?\d){12,18}(?![ -]?\d)(?![\p{L}_])"
PHONE = r"(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\p{L}\p{N}_])"
SSN = r"\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}_]|-\d)"
DATE = r"(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\p{L}\p{N}_]|[./-]\d)"
IP = r"(?<!\d\.)\d{1,3}(?:\.\d{1,3}){3}(?![\p{L}\p{N}_]|\.\d)"
IP6 = r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\p{L}\p{N}_:])"
ABROAD = r"\+[2-9]\d{0,2}(?:[ .-]?(?:\(\d{1,4}\)|\d{1,12}+)){1,6}+(?![\p{L}\p{N}_])"
IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}_])"
ACCESS = r"AKIA[A-Z2-7]{16}(?![\p{L}\p{N}_])"
#: Groups of digits of any number, up to a value of another kind; cards are looked for from group to group.
GROUP = r"(?:-| (?!(?:DATE|SSN|PHONE|IP)))".replace("DATE", DATE).replace("SSN", SSN).replace("PHONE", PHONE).replace("IP", IP)
RUN = rf"(?=\d(?:{GROUP}?\d){{12}})\d{{3,}}+(?![\p{{L}}_])(?:{GROUP}\d{{3,}}+(?![\p{{L}}_]))*+(?:{GROUP}\d{{1,2}}+(?![\p{{L}}\p{{N}}_]))?+"
#: A value starts where no word goes on; the order decides between kinds.
CANDIDATE = rf"(?<![\p{{L}}\p{{N}}_@%+-])(?:{EMAIL}|{ACCESS}|{IBAN}|{IP6}|{DATE}|{SSN}|{PHONE}|{ABROAD}|{IP}|{RUN}|{CARD})"

#: Days of the 400-year cycle of the calendar, 189 x 773, and its first day here.
CYCLE, CYCLE_A, CYCLE_B, FIRST_DAY = 146_097, 189, 773, "1800-01-01"
#: Days of the years 1 to 199, and with those of 9800 to 9999 together, 3 x 48577.
EARLY, EDGE_A, EDGE_B = 72_683, 3, 48_577
#: Signs of a string that are permuted at once: two halves of base 26 fit 64 bits.
BLOCK = 26
A_TO_Z, IN_BASE_26 = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdefghijklmnop"
IN_ACCESS, IN_BASE_32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdefghijklmnopqrstuv"
#: Where a text is cut into pieces, and what a \x01 of its own becomes meanwhile; to CANDIDATE all three signs are alike.
CUT, OWN = "\x01\x03", "\x01\x02"


def draw(key: str, kind: str, i: Column, side: str, value: Column) -> Column:
    """A 60-bit number from the key and what is given."""
    said = F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), F.lit(side), value.cast("string"))
    return F.conv(F.substring(F.sha2(said, 256), 1, 15), 16, 10).cast("long")


def feistel(key: str, kind: str, a: Column, b: Column, size_a: Column, size_b: Column, tweak: Column | None = None) -> Column:
    """A keyed permutation of the pairs (a, b), a < size_a, b < size_b; a struct of both."""
    mark = F.lit("") if tweak is None else tweak.cast("string")

    def turn(x: Column, i: Column) -> Column:
        a2 = F.pmod(x["a"] + F.pmod(draw(key, kind, i, "b", F.concat_ws(",", mark, x["b"].cast("string"))), size_a), size_a)
        return F.struct(a2.alias("a"), x["b"].alias("b"))

    def back(x: Column, i: Column) -> Column:
        b2 = F.pmod(x["b"] + F.pmod(draw(key, kind, i, "a", F.concat_ws(",", mark, x["a"].cast("string"))), size_b), size_b)
        return F.struct(x["a"].alias("a"), b2.alias("b"))

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda x, i: F.when(i % 2 == 1, turn(x, i)).otherwise(back(x, i)))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def lower(x: Column) -> Column:
    """ASCII letters in lower case, without the case tables of all of Unicode."""
    return F.translate(x, A_TO_Z.upper(), A_TO_Z)


def upper(x: Column) -> Column:
    return F.translate(x, A_TO_Z, A_TO_Z.upper())


def power(base: int, n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(base**i).cast("long") for i in range(BLOCK // 2 + 1)]), n + 1)


def digits_of(n: Column, width: Column) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def permuted_block(key: str, kind: str, s: Column, base: int, tweak: Column) -> Column:
    """1 to BLOCK signs of the first ``base`` of 0-9a-z, permuted among the strings of that length."""
    n = F.length(s)
    u = (n / 2).cast("int")
    number = lambda x: F.conv(x, base, 10).cast("long")
    spell = lambda x, w: F.lpad(lower(F.conv(x.cast("string"), 10, base)), w, "0")
    one = feistel(key, kind, (number(s) / 2).cast("long"), number(s) % 2, F.lit(base // 2), F.lit(2), tweak)
    more = feistel(key, kind, number(F.substr(s, F.lit(1), u)), number(F.substr(s, u + 1, n - u)), power(base, u), power(base, n - u), tweak)
    return F.when(n == 1, let(one, lambda x: spell(x["a"] * 2 + x["b"], F.lit(1)))).otherwise(let(more, lambda x: F.concat(spell(x["a"], u), spell(x["b"], n - u))))


def permuted_string(key: str, kind: str, s: Column, base: int) -> Column:
    """A string over the first ``base`` signs (an even number) of 0-9a-z, permuted among those of its length."""

    def permuted(s: Column) -> Column:
        n = F.length(s)

        def step(out: Column, i: Column) -> Column:
            rest = F.when(i == 0, F.substr(s, F.lit(BLOCK + 1))).otherwise("")
            part = F.substr(s, i * BLOCK + 1, F.lit(BLOCK))
            tweak = F.concat_ws("/", n.cast("string"), out, rest)
            return F.concat(out, let(part, lambda x: let(tweak, lambda w: permuted_block(key, kind, x, base, w))))

        return F.when(n == 0, "").otherwise(F.aggregate(F.sequence(F.lit(0), F.ceil(n / BLOCK).cast("int") - 1), F.lit(""), step))

    return let(s, permuted)


def refill(shape: Column, signs: str, new: Column) -> Column:
    """``shape`` with its characters of class ``signs`` replaced, in order, by those of ``new``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def filled(new: Column) -> Column:
        def step(x: Column, c: Column) -> Column:
            own = c.rlike(f"^[{signs}]$")
            return F.struct(F.concat(x["out"], F.when(own, F.substr(new, x["at"], F.lit(1))).otherwise(c)).alias("out"), F.when(own, x["at"] + 1).otherwise(x["at"]).alias("at"))

        return F.aggregate(F.split(shape, "", -1), start, step, lambda x: x["out"])

    return let(new, filled)  # else ``new`` would be worked out for every character


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum; every second digit from the last but one is doubled."""
    n = F.length(digits)

    def add(x: Column, i: Column) -> Column:
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return x + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def only_digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def int_at(digits: Column, start: int, n: int) -> Column:
    return F.substr(digits, F.lit(start), F.lit(n)).cast("long")


def card(key: str, m: Column) -> Column:
    def change(d: Column) -> Column:
        payload = permuted_string(key, "card", F.substr(d, F.lit(1), F.length(d) - 1), 10)
        full = let(payload, lambda p: F.concat(p, F.pmod(-luhn_sum(F.concat(p, F.lit("0"))), F.lit(10)).cast("string")))
        uniform = d.rlike(r"^(\d)\1*$")  # 0000... has a right sum but is no card
        return F.when((F.pmod(luhn_sum(d), F.lit(10)) == 0) & ~uniform, refill(m, "0-9", full))

    return let(only_digits(m), change)


PIECE = "struct<kind:string,old:string,new:string>"


def cards(key: str, m: Column) -> Column:
    """The cards in groups of digits and what is around them, in order: array of (kind, old, new).

    From each group on, the longest 13 to 19 digits that end with a group and are
    valid are a card.  Only all of ``m`` may have other groups than the last of
    fewer than three digits.
    """

    def piece(old: Column, new: Column) -> Column:
        return F.array(F.struct(F.lit("card").alias("kind"), old.alias("old"), new.cast("string").alias("new")).cast(PIECE))

    def tried(rest: Column) -> Column:
        spans = F.array(*[F.regexp_extract(rest, rf"^\d(?:[ -]?\d){{{n - 1}}}(?!\d)", 0) for n in range(19, 12, -1)])
        usual = F.filter(spans, lambda x: (x != "") & ((x == m) | ~x.rlike(r"(?:^|[ -])\d{1,2}[ -]")))
        return F.filter(F.transform(usual, lambda x: F.struct(x.alias("old"), card(key, x).alias("new"))), lambda x: x["new"].isNotNull())

    def step(x: Column, _: Column) -> Column:
        def go(found: Column) -> Column:
            plain = F.regexp_extract(x["rest"], r"^(?:\d+[ -]?|[ -])", 0)
            old = F.when(F.size(found) > 0, F.get(found, F.lit(0))["old"]).otherwise(plain)
            return F.struct(F.concat(x["out"], piece(old, F.get(found, F.lit(0))["new"])).alias("out"), F.substr(x["rest"], F.length(old) + 1).alias("rest"))

        return F.when(x["rest"] == "", x).otherwise(let(tried(x["rest"]), go))

    start = F.struct(F.array().cast(f"array<{PIECE}>").alias("out"), m.alias("rest"))
    steps = F.sequence(F.lit(1), F.size(F.split(m, "[ -]")) * 2)  # a group and, after a card, what parts it from the next
    return F.aggregate(steps, start, step, lambda x: x["out"])


def phone(key: str, m: Column) -> Column:
    def change(d: Column) -> Column:
        valid = (int_at(d, 1, 1) >= 2) & (int_at(d, 4, 1) >= 2)
        a = (int_at(d, 1, 3) - 200) * 100 + int_at(d, 7, 2)
        b = (int_at(d, 4, 3) - 200) * 100 + int_at(d, 9, 2)
        size = F.lit(80_000)
        new = let(feistel(key, "phone", a, b, size, size), lambda x: F.concat(
            ((x["a"] / 100).cast("long") + 200).cast("string"), ((x["b"] / 100).cast("long") + 200).cast("string"),
            digits_of(x["a"] % 100, F.lit(2)), digits_of(x["b"] % 100, F.lit(2))))
        country = F.length(only_digits(m)) - 10
        return F.when(valid, F.when(country == 1, refill(m, "0-9", F.concat(F.lit("1"), new))).otherwise(refill(m, "0-9", new)))

    return let(F.right(only_digits(m), F.lit(10)), change)


def ssn(key: str, m: Column) -> Column:
    def change(d: Column) -> Column:
        area, group, serial = int_at(d, 1, 3), int_at(d, 4, 2), int_at(d, 6, 4)
        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        a = (area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1

        def spell(x: Column) -> Column:
            i = (x["a"] / 99).cast("long")
            return F.concat(digits_of(i + F.when(i >= 665, 2).otherwise(1), F.lit(3)), digits_of(x["a"] % 99 + 1, F.lit(2)), digits_of(x["b"] + 1, F.lit(4)))

        return F.when(valid, refill(m, "0-9", let(feistel(key, "ssn", a, serial - 1, F.lit(898 * 99), F.lit(9_999)), spell)))

    return let(only_digits(m), change)


def ip(key: str, m: Column) -> Column:
    def change(o: Column) -> Column:
        size = F.lit(1 << 16)
        new = feistel(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], size, size)
        dotted = let(new, lambda x: F.concat_ws(".", (x["a"] / 256).cast("long"), x["a"] % 256, (x["b"] / 256).cast("long"), x["b"] % 256))
        return F.when(F.array_max(o) <= 255, dotted)

    return let(F.transform(F.split(m, r"\."), lambda x: x.cast("long")), change)


def date(key: str, m: Column) -> Column:
    first, late = F.lit(FIRST_DAY).cast("date"), F.lit("9800-01-01").cast("date")

    def change(d: Column) -> Column:
        day = F.datediff(d, first).cast("long")
        cycle = F.floor(day / CYCLE)
        within = day - cycle * CYCLE
        usual = feistel(key, "date", (within / CYCLE_B).cast("long"), within % CYCLE_B, F.lit(CYCLE_A), F.lit(CYCLE_B), cycle)
        moved = let(usual, lambda x: F.date_add(first, (cycle * CYCLE + x["a"] * CYCLE_B + x["b"]).cast("int")))
        start = F.lit("0001-01-01").cast("date")
        at = F.when(F.year(d) < 200, F.datediff(d, start)).otherwise(F.datediff(d, late) + EARLY).cast("long")
        edge = feistel(key, "date", (at / EDGE_B).cast("long"), at % EDGE_B, F.lit(EDGE_A), F.lit(EDGE_B), F.lit("edge"))
        at_edge = let(edge, lambda x: let(x["a"] * EDGE_B + x["b"], lambda i: F.when(i < EARLY, F.date_add(start, i.cast("int"))).otherwise(F.date_add(late, (i - EARLY).cast("int")))))
        new = F.when((F.year(d) < 200) | (F.year(d) >= 9800), at_edge).otherwise(moved)
        return let(new, lambda x: F.when(m.contains("/"), F.date_format(x, "MM/dd/yyyy")).when(m.contains("."), F.date_format(x, "dd.MM.yyyy")).otherwise(F.date_format(x, "yyyy-MM-dd")))

    read = F.when(m.contains("/"), F.try_to_date(m, "MM/dd/yyyy")).when(m.contains("."), F.try_to_date(m, "dd.MM.yyyy")).otherwise(F.try_to_date(m, "yyyy-MM-dd"))
    return let(read, lambda d: F.when(d.isNotNull(), change(d)))


def email(key: str, m: Column) -> Column:
    def change(local: Column) -> Column:
        letters = F.translate(permuted_string(key, "letters", F.translate(F.regexp_replace(local, "[^a-z]", ""), A_TO_Z, IN_BASE_26), 26), IN_BASE_26, A_TO_Z)
        digits = permuted_string(key, "digits", F.regexp_replace(local, "[^0-9]", ""), 10)
        return F.concat(refill(refill(local, "a-z", letters), "0-9", digits), F.lit("@"), F.substring_index(m, "@", -1))

    return let(lower(F.substring_index(m, "@", 1)), change)


def remainder_97(s: Column) -> Column:
    """Modulo 97 of an account as a number: A counts as 10, B as 11, ..."""

    def add(x: Column, c: Column) -> Column:
        letter = F.instr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c)
        return F.when(letter > 0, (x * 100 + letter + 9) % 97).otherwise((x * 10 + F.when(letter == 0, c).cast("int")) % 97)

    return F.aggregate(F.split(s, "", -1), F.lit(0), add)


def iban(key: str, m: Column) -> Column:
    def change(s: Column) -> Column:
        head, account = F.left(s, F.lit(2)), F.substr(s, F.lit(5))
        digits = permuted_string(key, "iban digits", only_digits(account), 10)
        letters = upper(F.translate(permuted_string(key, "iban letters", F.translate(lower(F.regexp_replace(account, "[0-9]", "")), A_TO_Z, IN_BASE_26), 26), IN_BASE_26, A_TO_Z))
        moved = refill(refill(account, "A-Z", letters), "0-9", digits)
        full = let(moved, lambda x: F.concat(head, digits_of(98 - remainder_97(F.concat(x, head, F.lit("00"))), F.lit(2)), x))
        valid = (remainder_97(F.concat(account, head, F.substr(s, F.lit(3), F.lit(2)))) == 1) & F.length(s).between(15, 34)
        return F.when(valid, refill(m, "A-Z0-9", full))

    return let(F.regexp_replace(m, " ", ""), change)


def abroad(key: str, m: Column) -> Column:
    def change(d: Column) -> Column:
        new = F.concat(F.left(d, F.lit(2)), permuted_string(key, "abroad", F.substr(d, F.lit(3)), 10))
        return F.when(F.length(d).between(8, 15), refill(m, "0-9", new))

    return let(only_digits(m), change)


def ip6(key: str, m: Column) -> Column:
    full = F.array_join(F.transform(F.split(lower(m), ":"), lambda x: F.lpad(x, 4, "0")), "")
    new = permuted_string(key, "ip6", full, 16)
    return let(new, lambda x: F.concat_ws(":", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.substr(x, i * 4 + 1, F.lit(4)))))


def access(key: str, m: Column) -> Column:
    raw = F.translate(F.substr(m, F.lit(5)), IN_ACCESS, IN_BASE_32)

    def change(s: Column) -> Column:
        size = F.lit(32**8)
        number = lambda x: F.conv(x, 32, 10).cast("long")
        spell = lambda x: F.lpad(lower(F.conv(x.cast("string"), 10, 32)), 8, "0")
        new = feistel(key, "access", number(F.left(s, F.lit(8))), number(F.right(s, F.lit(8))), size, size)
        return F.concat(F.lit("AKIA"), F.translate(let(new, lambda x: F.concat(spell(x["a"]), spell(x["b"]))), IN_BASE_32, IN_ACCESS))

    return let(raw, change)


KINDS = {"email": (EMAIL, email), "access": (ACCESS, access), "iban": (IBAN, iban), "ip6": (IP6, ip6), "date": (DATE, date), "ssn": (SSN, ssn), "phone": (PHONE, phone), "abroad": (ABROAD, abroad), "ip": (IP, ip), "card": (CARD, card)}


def kind_of(m: Column) -> Column:
    out = F.when(m.contains("@"), "email").when(m.startswith("AKIA"), "access")
    for name in ("iban", "ip6", "date", "ssn", "phone", "abroad", "ip"):
        out = out.when(m.rlike(f"^(?:{KINDS[name][0]})$"), name)
    return out.otherwise("card")


def pseudonym(key: str, kind: Column, m: Column) -> Column:
    """The value's pseudonym; null if it is not valid."""
    out = None
    for name, (_, change) in KINDS.items():
        out = F.when(kind == name, change(key, m)) if out is None else out.when(kind == name, change(key, m))
    return out


def unused(docs: DataFrame, name: str) -> str:
    """``name``, made longer until no column has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def pseudonymise(docs: DataFrame, key: str, text: str = "text", found: str | None = "pii") -> DataFrame:
    """The documents with pseudonyms in ``text`` and, in ``found``, what was replaced: array of (kind, start, new).

    ``start`` counts characters from 1.  Without ``found`` the columns are those of ``docs``.
    """
    if found is not None and unused(docs, found) != found:
        raise ValueError(f"a column {found} is there already")
    held = unused(docs, "__pieces")
    t = F.col(text)
    some = t.rlike(r"[@0-9]|AKIA") & t.rlike(CANDIDATE)
    one = lambda k, m: F.array(F.struct(k.alias("kind"), m.alias("old"), pseudonym(key, k, m).alias("new")).cast(PIECE))
    changed = lambda m: let(kind_of(m), lambda k: F.when(k == "card", cards(key, m)).otherwise(one(k, m)))
    gap = lambda x: F.array(F.struct(F.lit(None).cast("string").alias("kind"), x.alias("old"), F.lit(None).cast("string").alias("new")).cast(PIECE))
    marked = F.regexp_replace(F.replace(t, F.lit(CUT[0]), F.lit(OWN)), F.lit(CANDIDATE), F.lit(f"{CUT}$0{CUT}"))
    own = lambda x: F.replace(x, F.lit(OWN), F.lit(CUT[0]))
    # of the parts of a text every second one is a match
    pieces = F.flatten(F.transform(F.split(marked, CUT, -1), lambda x, i: F.when(i % 2 == 0, gap(own(x))).otherwise(changed(x))))
    out = docs.withColumn(held, F.when(some, pieces))
    start = F.struct(F.array().cast("array<struct<kind:string,start:int,new:string>>").alias("all"), F.lit(1).alias("at"))

    def place(x: Column, c: Column) -> Column:
        one = F.array(F.struct(c["kind"].alias("kind"), x["at"].alias("start"), c["new"].alias("new")))
        return F.struct(F.when(c["new"].isNotNull(), F.concat(x["all"], one)).otherwise(x["all"]).alias("all"), (x["at"] + F.length(c["old"])).alias("at"))

    where = F.aggregate(held, start, place, lambda x: x["all"])
    none = F.array().cast("array<struct<kind:string,start:int,new:string>>")
    columns = {text: F.when(F.col(held).isNotNull(), F.array_join(F.transform(held, lambda c: F.coalesce(c["new"], c["old"])), "")).otherwise(t)}
    if found is not None:
        columns[found] = F.when(F.col(held).isNotNull(), where).otherwise(none)
    return out.withColumns(columns).drop(held)


def _only(kind: str):
    return lambda x: F.when(x["kind"] == kind, x["start"])


def session_key(spark: SparkSession) -> str:
    """The secret of this session; without one, a key for tests."""
    return spark.conf.get("spark.tessera.pseudonymKey", "a key for tests")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), session_key(spark))
    kinds = {f"n_{k}": F.size(F.array_compact(F.transform("pii", _only(k)))).cast("long") for k in KINDS}
    return found.select("doc_id", F.size("pii").cast("long").alias("n_found"), *[c.alias(n) for n, c in kinds.items()], "text", "pii")
