import re

from pyspark.sql import functions as F

from folioflux.llm import pii
from folioflux.sources.tables import load


def luhn(s):
    digits = [int(c) for c in s if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(digits)) % 10 == 0


def shape(s):
    return re.sub("[0-9]", "9", s)


def run(spark, texts, key="k"):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: r for r in pii.pseudonymise(docs, key).collect()}


def test_formats_and_links(spark):
    texts = [
        "pay 4694843406369062 or 4694 8434 0636 9062 now",
        "again 4694843406369062.",
        "call +1 (846) 555-8663 or (846) 555-8663",
        "from 17.172.118.192 not 300.1.2.3 or 1.2.3.4.5",
        "born 1984-02-29, 29.02.1984 and 02/29/1984 but not 1985-02-29",
        "csih.00@mail7.example.com 🎉 DE89 3704 0044 0532 0130 00 end 4694843406369063",
        "ssn 123-45-6789 and 000-45-6789",
        None,
        "",
        "no numbers here",
    ]
    got = run(spark, texts)
    assert got[7].text == "" and got[8].text == "" and got[9].text == texts[9] and got[9].found == []
    cards = [x.value for x in got[0].found]
    assert [shape(c) for c in cards] == ["9" * 16, "9999 9999 9999 9999"] and all(luhn(c) for c in cards)
    assert cards[0] == cards[1].replace(" ", "") != "4694843406369062" and cards[0][0] == "4"
    assert got[1].found[0].value == cards[0] and got[1].text == f"again {cards[0]}."
    a, b = (x.value for x in got[2].found)
    assert shape(a) == "+9 (999) 999-9999" and shape(b) == "(999) 999-9999" and a[4:] == b[1:] and a[:5] == "+1 (8"
    assert len(got[3].found) == 1 and "300.1.2.3" in got[3].text and all(int(x) < 256 for x in got[3].found[0].value.split("."))
    d = [x.value for x in got[4].found]
    assert len(d) == 3 and "1985-02-29" in got[4].text
    y, m, day = d[0].split("-")
    assert d[1] == f"{day}.{m}.{y}" and d[2] in (f"{m}/{day}/{y}", f"{day}/{m}/{y}")
    kinds = [x.kind for x in got[5].found]
    assert kinds == ["email", "iban"] and "🎉" in got[5].text and got[5].text.endswith("4694843406369063")
    assert re.fullmatch(r"[a-z]{4}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com", got[5].found[0].value)
    iban = got[5].found[1].value.replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and iban != "DE89370400440532013000"
    assert [x.kind for x in got[6].found] == ["ssn"] and "000-45-6789" in got[6].text


def test_feistel_is_a_permutation(spark):
    every = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    assert every.select(pii.permute_digits("k", "t", F.col("d")).alias("p")).where("length(p) = 3").distinct().count() == 1000
    pairs = spark.range(27 * 41).select(pii.feistel("k", F.lit("t"), F.expr("id % 27"), F.expr("id div 27"), F.lit(27), F.lit(41)).alias("p"))
    assert pairs.where("p.l < 27 and p.r < 41 and p.l >= 0 and p.r >= 0").distinct().count() == 27 * 41
    names = spark.range(26 * 26 * 10).select(F.expr("concat(chr(97 + cast(id div 260 as int)), chr(97 + cast(id div 10 % 26 as int)), cast(id % 10 as string))").alias("n"))
    assert names.select(pii.permute_name("k", F.col("n")).alias("p")).distinct().count() == 6760


def test_no_planted_value_stays(spark, sf_dir):
    texts = {r.doc_id: r.text for r in load(spark, sf_dir, "documents").collect()}
    rows = pii.op2_pii(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    seen = 0
    for r in rows:
        before = re.findall(r"[a-z]+\.\d\d@mail\d\.example\.com|\+1 \(\d{3}\) 555-\d{4}|(?<!\d)\d{16}(?!\d)", texts[r.doc_id])
        before = [x for x in before if not x.isdigit() or luhn(x)]
        seen += len(before)
        assert not [x for x in before if x in r.text]
        assert len(r.text) == len(texts[r.doc_id]) or r.n_ip
    assert seen > 5


def test_key_and_nulls(spark):
    docs = spark.createDataFrame([(None, "4694843406369062", "x"), (1, None, "y"), (1, "4694843406369062", "z")], "doc_id long, text string, kind string")
    one, two = (sorted(str(r.text) for r in pii.pseudonymise(docs, k).collect()) for k in ("a", "b"))
    assert len(one) == 3 and one != two
    assert pii.pseudonymise(docs.limit(0), "a").count() == 0


def test_cards_beside_other_numbers(spark):
    card = "4111 1111 1111 1111"
    texts = [f"{card} 123", f"{card} 12/27", f"Order 12 {card}", f"12  {card}", f"{card} 01.02.2024", f"7 {card} 4694843406369062 2024-01-02 x", f"{card}-2024-01-02", "12 34 " * 100, f"{card} 12ab", f"card:{card}, {card}."]
    got = run(spark, texts)
    for i, t in enumerate(texts):
        cards = [x.value for x in got[i].found if x.kind == "card"]
        assert all(luhn(c) for c in cards)
        if card in t:
            assert card not in got[i].text and shape(got[i].text) == shape(t)
            assert any(c.replace(" ", "") == got[0].found[0].value.replace(" ", "") for c in cards), t
    assert got[0].text.endswith(" 123") and got[1].text.endswith(" 12/27") and got[2].text.startswith("Order 12 ") and got[3].text.startswith("12  ")
    assert [x.kind for x in got[4].found] == ["card", "date"] and "01.02.2024" not in got[4].text
    assert [x.kind for x in got[5].found] == ["card", "card", "date"] and "2024-01-02" not in got[5].text and got[5].text.startswith("7 ")
    assert [x.kind for x in got[6].found] == ["card"] and got[6].text.endswith("-2024-01-02") and len(got[9].found) == 2
    assert shape(got[7].text) == shape(texts[7])


def test_long_repeats_of_the_patterns(spark):
    """Long repeats of what a pattern begins with: no match may go deeper with the length of a text."""
    n = 300_000
    texts = ["x@" + "a." * 2000 + "com", "x@" + "a." * (n // 2) + "com", "x@" + "a" * n, "a.b" * (n // 3) + "@c.de", "1." * (n // 2), "DE44" + " ABCD" * (n // 5), "(555) " * (n // 6), "x" * n]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n for r in pii.pseudonymise(docs, "k").selectExpr("doc_id", "length(text) as n").collect()}
    assert all(abs(got[i] - len(t)) <= 2 for i, t in enumerate(texts))
