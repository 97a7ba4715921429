"""Personal data replaced by format-preserving pseudonyms: keyed Feistel permutations within each value's format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflux.llm.common import text_of
from folioflux.sources.tables import load

#: Patterns by kind, tried in this order at each place; a match counts only if it is also valid (see `_kind`). Repeated
#: groups are bounded (a host has 127 labels of 63 characters at most): the pattern matcher goes one call deeper for each.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9/-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9A-Za-z-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
    "phone": r"(?:(?<![0-9+])\+[0-9]{1,3}[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9+])\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,5}(?![0-9])|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A whole run of digits, blanks and hyphens: cards are looked for inside it (see `card_parts`).
RUN = r"(?<![0-9A-Za-z-])[0-9][0-9 -]{11,}[0-9](?![0-9A-Za-z])"
#: Runs and what goes before them where both begin at a place or it begins first; then what is left beside the cards.
FIRST = "|".join(f"(?:{RUN if k == 'card' else p})" for k, p in PATTERNS.items())
REST = "|".join(f"(?:{p})" for k, p in PATTERNS.items() if k != "card")
ROUNDS = 10
#: Days from 1800-01-01 to 2199-12-31: 400 years, 27 * 5411 days.
FIRST_DAY, DAY_PARTS = "1800-01-01", (27, 5411)


def _prf(key: str, tweak: Column, turn: Column, value: Column) -> Column:
    """60 bits that depend on the key, the kind and length of the value, the round and one half of the value."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tweak, turn.cast("string"), value.cast("string")), 256), 1, 15), 16, 10).cast("long")


def feistel(key: str, tweak: Column, left: Column, right: Column, left_size: Column, right_size: Column, rounds: int = ROUNDS) -> Column:
    """struct<l, r>: an alternating Feistel network over pairs (l, r) with 0 <= l < left_size and 0 <= r < right_size.

    Each round adds to one half, modulo its size, what the keyed function gives of the other; the whole is a
    permutation of all pairs, whatever the two sizes.
    """

    def turn(x, k):
        odd = k % 2 == 1
        return F.struct(
            F.when(odd, x["l"]).otherwise(F.pmod(x["l"] + F.pmod(_prf(key, tweak, k, x["r"]), left_size), left_size)).alias("l"),
            F.when(odd, F.pmod(x["r"] + F.pmod(_prf(key, tweak, k, x["l"]), right_size), right_size)).otherwise(x["r"]).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), turn)


def permute_digits(key: str, kind: str, digits: Column) -> Column:
    """A string of 2 to 36 digits permuted among the strings of its length, zeros in front included."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    power = lambda k: F.pow(F.lit(10.0), k).cast("long")
    left, right = F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, n)
    pair = feistel(key, F.concat(F.lit(kind), n.cast("string")), left.cast("long"), right.cast("long"), power(half), power(n - half))
    return F.transform(F.array(pair), lambda x: F.concat(F.lpad(x["l"].cast("string"), half, "0"), F.lpad(x["r"].cast("string"), n - half, "0")))[0]


def luhn_sum(digits: Column, first_doubled: bool) -> Column:
    """The Luhn sum from the right; first_doubled: the rightmost digit is doubled, as where the check digit is missing."""
    even = 0 if first_doubled else 1

    def add(total, i):
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == even, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def mod97(text: Column) -> Column:
    """A string of digits and capitals, capitals as 10 to 35, modulo 97."""
    code = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda rest, c: F.pmod(rest * F.when(code(c) > 9, 100).otherwise(10) + code(c), F.lit(97)).cast("int"))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def refill(value: Column, new: Column, chars: str = "[0-9]") -> Column:
    """`value` with its characters of class `chars` replaced, in order, by those of `new`."""
    each = F.filter(F.split(value, ""), lambda c: c != "")

    def put(x, c):
        fits = c.rlike(chars)
        return F.struct((x["k"] + F.when(fits, 1).otherwise(0)).alias("k"), F.concat(x["out"], F.when(fits, F.substring(new, x["k"] + 1, F.lit(1))).otherwise(c)).alias("out"))

    return F.aggregate(each, F.struct(F.lit(0).alias("k"), F.lit("").alias("out")), put, lambda x: x["out"])


def _day(value: Column) -> tuple[Column, Column]:
    """The date and the format it is written in: ISO, then day first, then month first."""
    tried = [(f, F.try_to_date(value, f)) for f in ("yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy", "MM/dd/yyyy")]
    return F.coalesce(*[d for _, d in tried]), F.coalesce(*[F.when(d.isNotNull(), F.lit(f)) for f, d in tried])


def _kind(value: Column) -> Column:
    """The kind of a match, or null if it is not valid: octets to 255, days of the calendar from 1800 to 2199, Luhn and
    mod-97 sums, phone numbers of 8 to 15 digits, social security numbers outside the blocks that are never issued."""
    digits, compact = digits_of(value), F.regexp_replace(value, "[^A-Z0-9]", "")
    full = {k: value.rlike(f"^(?:{p})$") for k, p in PATTERNS.items()}
    octets = ~F.exists(F.split(value, "\\."), lambda o: F.coalesce(o.try_cast("int"), F.lit(999)) > 255)
    day = _day(value)[0]
    return (
        F.when(full["email"], F.lit("email"))
        .when(full["ip"], F.when(octets, F.lit("ip")))
        .when(full["date"], F.when(day.between(FIRST_DAY, "2199-12-31"), F.lit("date")))
        .when(full["iban"], F.when(mod97(F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, 1, 4))) == 1, F.lit("iban")))
        .when(full["card"], F.when(luhn_sum(digits, False) % 10 == 0, F.lit("card")))
        .when(full["phone"], F.when(F.length(digits).between(8, 15), F.lit("phone")))
        .when(full["ssn"], F.when(~value.rlike("^(000|666|9..)|-00-|-0000$"), F.lit("ssn")))
    )


def card_parts(run: Column) -> Column:
    """array<struct<card, s>>: a run cut into its cards and what stands between them. A card is a stretch of 13 to 19
    digits with a valid Luhn sum that begins and ends at a single blank or hyphen or an end of the run; of those that
    overlap the ones are taken that cover most digits of the run together, the earlier on ties."""

    def cut(g):
        # best of the first j groups: digits covered and cards, as groups [a, b); the last 20 of them are kept
        def step(best, j):
            def ending(n):
                digits = F.transform(F.array(F.slice(g, j - n + 1, n)), lambda x: F.when(~F.exists(x, lambda y: y == ""), F.array_join(x, "")))
                valid = F.exists(digits, lambda d: F.when(F.length(d).between(13, 19), luhn_sum(d, False) % 10 == 0).otherwise(F.lit(False)))
                before = F.element_at(best, -n)
                c = before["c"] + F.length(F.array_join(F.slice(g, j - n + 1, n), ""))
                return F.when(valid, F.struct(c.alias("c"), F.lit(0).alias("same"), F.concat(before["cards"], F.array(F.struct((j - n).alias("a"), j.alias("b")))).alias("cards")))

            last = F.element_at(best, -1)
            stay = F.struct(last["c"].alias("c"), F.lit(1).alias("same"), last["cards"].alias("cards"))
            most = F.array_max(F.concat(F.array(stay), F.transform(F.sequence(F.lit(1), F.least(F.size(best), F.lit(19))), ending)))
            return F.concat(F.slice(best, F.greatest(F.size(best) - 18, F.lit(1)), 19), F.array(most))

        none = F.expr("array(named_struct('c', 0, 'same', 1, 'cards', cast(array() as array<struct<a:int,b:int>>)))")
        return F.aggregate(F.sequence(F.lit(1), F.size(g)), none, step, lambda best: F.element_at(best, -1)["cards"])

    def tokens(x):
        # where each card begins and ends in the run, from the lengths of the groups and their separators
        at = lambda n: F.when(n <= 0, F.lit(0)).otherwise(F.length(F.array_join(F.slice(x["g"], 1, n), " ")))
        ends = F.transform(x["cards"], lambda c: F.struct((at(c["a"]) + F.when(c["a"] > 0, 1).otherwise(0)).alias("a"), at(c["b"]).alias("b")))
        between = lambda a, b: F.substring(run, a + 1, b - a)

        def pair(ends, e, i):
            start = F.when(i > 0, F.try_element_at(ends, i)["b"]).otherwise(0)
            return F.array(F.struct(F.lit(False).alias("card"), between(start, e["a"]).alias("s")), F.struct(F.lit(True).alias("card"), between(e["a"], e["b"]).alias("s")))

        def pairs(ends):
            tail = F.coalesce(F.try_element_at(ends, F.lit(-1))["b"], F.lit(0))
            return F.concat(F.flatten(F.transform(ends, lambda e, i: pair(ends, e, i))), F.array(F.struct(F.lit(False).alias("card"), between(tail, F.length(run)).alias("s"))))

        return F.transform(F.array(ends), pairs)[0]

    groups = F.transform(F.array(F.split(run, "[ -]", -1)), lambda g: F.struct(g.alias("g"), cut(g).alias("cards")))
    return F.transform(groups, tokens)[0]


def apart(text: Column) -> Column:
    """struct<rests, cards>: the cards of a text, and the texts before, between and after them."""
    rest = lambda v: F.array(F.struct(F.lit(False).alias("card"), v.alias("s")))
    pieces = F.arrays_zip(F.split(text, FIRST, -1).alias("piece"), F.regexp_extract_all(text, F.lit(FIRST), F.lit(0)).alias("v"))
    parts = F.flatten(F.transform(pieces, lambda x: F.concat(rest(x["piece"]), F.when(x["v"].rlike(f"^(?:{RUN})$"), card_parts(x["v"])).otherwise(rest(F.coalesce(x["v"], F.lit("")))))))
    none = F.expr("named_struct('at', 0, 'last', 0, 'rests', cast(array() as array<string>), 'cards', cast(array() as array<string>))")

    def add(seen, x):
        to = seen["at"] + F.length(x["s"])
        return F.struct(
            to.alias("at"),
            F.when(x["card"], to).otherwise(seen["last"]).alias("last"),
            F.when(x["card"], F.concat(seen["rests"], F.array(F.substring(text, seen["last"] + 1, seen["at"] - seen["last"])))).otherwise(seen["rests"]).alias("rests"),
            F.when(x["card"], F.concat(seen["cards"], F.array(x["s"]))).otherwise(seen["cards"]).alias("cards"),
        )

    def done(seen):
        return F.struct(F.concat(seen["rests"], F.array(F.substring(text, seen["last"] + 1, F.length(text)))).alias("rests"), seen["cards"].alias("cards"))

    return F.aggregate(parts, none, add, done)


def _shifted(key: str, tweak: str, own: Column, other: Column, turn: int) -> Column:
    """Each letter or digit of `own` moved within its class by what the keyed function gives of `other` and its place."""
    stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), F.lit(str(turn)), other), 256)
    chars = F.filter(F.split(own, ""), lambda c: c != "")

    def move(c, i):
        k = F.conv(F.substring(stream, F.pmod(i, F.lit(16)) * 4 + 1, F.lit(4)), 16, 10).cast("int") + F.floor(i / 16).cast("int")
        turned = lambda first, n: F.chr(F.pmod(F.ascii(c) - first + k, F.lit(n)) + first)
        return F.when(c.rlike("[a-z]"), turned(97, 26)).when(c.rlike("[A-Z]"), turned(65, 26)).when(c.rlike("[0-9]"), turned(48, 10)).otherwise(c)

    return F.array_join(F.transform(chars, move), "")


def permute_name(key: str, name: Column) -> Column:
    """The letters and digits of a name permuted, each within its class: four Feistel rounds over the halves of the name."""
    half = F.floor(F.length(name) / 2).cast("int")
    pair = F.array(F.struct(F.substring(name, F.lit(1), half).alias("l"), F.substring(name, half + 1, F.length(name)).alias("r")))

    def moved(turn: int):
        if turn % 2:
            return lambda x: F.struct(x["l"].alias("l"), _shifted(key, "name", x["r"], x["l"], turn).alias("r"))
        return lambda x: F.struct(_shifted(key, "name", x["l"], x["r"], turn).alias("l"), x["r"].alias("r"))

    for turn in range(4):
        pair = F.transform(pair, moved(turn))
    return F.transform(pair, lambda x: F.concat(x["l"], x["r"]))[0]


def pseudonym(key: str, kind: Column, value: Column) -> Column:
    """The value of the same format that stands for `value`; equal values of a kind give equal pseudonyms, however
    they are spaced. Cards keep their first digit and the check sum, phone numbers all but their last nine digits, IBANs
    country and length, addresses their domain's last part; dates stay dates and IPv4 addresses stay addresses."""
    digits, compact = digits_of(value), F.regexp_replace(value, "[^A-Z0-9]", "")
    n = F.length(digits)

    payload = F.concat(F.substring(digits, 1, 1), permute_digits(key, "card", F.substring(digits, F.lit(2), n - 2)))
    card = F.transform(F.array(payload), lambda p: F.concat(p, F.pmod(F.lit(10) - luhn_sum(p, True) % 10, F.lit(10)).cast("string")))[0]
    tail = F.least(n - 1, F.lit(9))
    phone = F.concat(F.substring(digits, F.lit(1), n - tail), permute_digits(key, "phone", F.substring(digits, n - tail + 1, tail)))

    octet = lambda i: F.split(value, "\\.")[i].cast("long")
    address = feistel(key, F.lit("ip"), octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), F.lit(65536), F.lit(65536))
    ip = F.transform(F.array(address), lambda x: F.concat_ws(".", *[v.cast("string") for h in ("l", "r") for v in (F.shiftright(x[h], 8), x[h] % 256)]))[0]

    day, form = _day(value)
    number = F.datediff(day, F.lit(FIRST_DAY).cast("date")).cast("long")
    moved = feistel(key, F.lit("date"), number % DAY_PARTS[0], F.floor(number / DAY_PARTS[0]).cast("long"), F.lit(DAY_PARTS[0]), F.lit(DAY_PARTS[1]))
    new_day = F.date_add(F.lit(FIRST_DAY).cast("date"), (moved["l"] + moved["r"] * DAY_PARTS[0]).cast("int"))
    date = F.when(form == "yyyy-MM-dd", F.date_format(new_day, "yyyy-MM-dd")).when(form == "dd.MM.yyyy", F.date_format(new_day, "dd.MM.yyyy")).when(form == "dd/MM/yyyy", F.date_format(new_day, "dd/MM/yyyy")).otherwise(F.date_format(new_day, "MM/dd/yyyy"))

    account = F.substring(compact, F.lit(5), F.length(compact))
    new_account = refill(account, permute_digits(key, "iban", F.rpad(digits_of(account), F.greatest(F.length(digits_of(account)), F.lit(2)), "0")))
    iban = F.transform(F.array(new_account), lambda a: F.concat(F.substring(compact, 1, 2), F.lpad((F.lit(98) - mod97(F.concat(a, F.substring(compact, 1, 2), F.lit("00")))).cast("string"), 2, "0"), a))[0]

    name, host = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    labels = F.regexp_extract(host, r"^(.*)\.[^.]*$", 1)
    email = F.concat(permute_name(key, name), F.lit("@"), permute_name(key, labels), F.lit("."), F.substring_index(host, ".", -1))
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", ip)
        .when(kind == "date", date)
        .when(kind == "iban", refill(value, iban, "[A-Z0-9]"))
        .when(kind == "card", refill(value, card))
        .when(kind == "phone", refill(value, phone))
        .when(kind == "ssn", refill(value, permute_digits(key, "ssn", digits)))
        .otherwise(value)
    )


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id_col, text with every valid value replaced by its pseudonym, and found, an
    array<struct<kind, value>> of the pseudonyms in their order.

    Values are e-mail addresses, IPv4 addresses, dates, IBANs, card numbers, phone numbers and social security numbers;
    what has the shape but is not valid stays as it is. Cards are found first, inside runs of digits that may hold other
    numbers too, and the other kinds in what is left. Pseudonyms depend on the key, the kind and the value alone, so
    they agree across documents, runs and tables. Everything is an expression on the row: no shuffle, no hot key, whole
    texts of any length; a text without a match costs one search. Null texts give the empty text; rows with null or
    repeated ids are rows of their own.
    """
    base = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    none = F.expr("cast(array() as array<struct<kind:string,value:string>>)")
    whole = F.struct(F.array("_text").alias("rests"), F.expr("cast(array() as array<string>)").alias("cards"))
    split = base.select("_id", "_text", F.when(F.rlike(F.col("_text"), F.lit(RUN)), apart(F.col("_text"))).otherwise(whole).alias("_x"))

    def replaced(v):
        return F.transform(F.array(F.struct(_kind(v).alias("kind"), v.alias("v"))), lambda x: F.struct(x["kind"].alias("kind"), pseudonym(key, x["kind"], x["v"]).alias("value")))[0]

    def rest(t):
        new = F.when(t.rlike(REST), F.transform(F.regexp_extract_all(t, F.lit(REST), F.lit(0)), replaced)).otherwise(none)

        def put(new):
            pieces = F.arrays_zip(F.split(t, REST, -1).alias("piece"), new.alias("new"))
            text = F.when(F.size(new) > 0, F.array_join(F.transform(pieces, lambda x: F.concat(x["piece"], F.coalesce(x["new"]["value"], F.lit("")))), "")).otherwise(t)
            return F.struct(text.alias("text"), F.filter(new, lambda x: x["kind"].isNotNull()).alias("found"))

        return F.transform(F.array(new), put)[0]

    def card(v):
        return F.transform(F.array(pseudonym(key, F.lit("card"), v)), lambda p: F.struct(p.alias("text"), F.array(F.struct(F.lit("card").alias("kind"), p.alias("value"))).alias("found")))[0]

    with_new = split.select("_id", F.arrays_zip(F.transform("_x.rests", rest).alias("rest"), F.transform("_x.cards", card).alias("card")).alias("_new"))
    text = F.array_join(F.transform("_new", lambda x: F.concat(x["rest"]["text"], F.coalesce(x["card"]["text"], F.lit("")))), "")
    found = F.flatten(F.transform("_new", lambda x: F.concat(x["rest"]["found"], F.coalesce(x["card"]["found"], none))))
    return with_new.select(F.col("_id").alias(id_col), text.alias("text"), found.alias("found"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_<kind> for each kind, text with pseudonyms, for every row of documents. The key is the session's setting
    spark.folioflux.pii.key; without one, as in tests, a fixed word."""
    done = pseudonymise(load(spark, sf_dir, "documents"), key=spark.conf.get("spark.folioflux.pii.key", "op2"))
    counts = [F.expr(f"size(filter(found, x -> x.kind = '{kind}'))").cast("long").alias(f"n_{kind}") for kind in PATTERNS]
    return done.select("doc_id", *counts, "text")
