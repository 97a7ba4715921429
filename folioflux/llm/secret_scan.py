"""Secrets in texts: patterns of known shapes, and tokens that read like random strings rather than identifiers."""

from __future__ import annotations

import math
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflux.llm.common import text_of
from folioflux.llm.spans import overlaps, place_matches
from folioflux.sources.tables import load

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Tokens that the character models judge: at least this long, of these characters.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Kinds in their order.
KINDS = ("assign", "access", "hex", "random")
#: Log-odds that a token must reach: secrets are taken to be one token in ten thousand.
ODDS = math.log(10_000)

#: Stems of the built-in sample of ordinary identifiers.
STEMS = (
    "get set read write open close load store user name file path table column index value count list item node tree"
    " key map cache page text document line word token parse build make create update delete insert select merge join"
    " sort group filter window stream batch task job run start stop begin end test check verify order customer invoice"
    " address number date time year month amount price total first last next previous the and with from that this have"
    " der die das und nicht werden haben schaft lichkeit heit ung verwaltung gesellschaft arbeit recht zeit"
    " les des une dans pour avec mais comme ment tion eur ance politique travail histoire"
    " los las una para como pero cion mente dad ando iendo trabajo gobierno historia"
).split()


def training_samples(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """The built-in labelled sample: token, random (boolean). Ordinary tokens join two to five stems, in snake, kebab,
    path, camel or plain form, or are rules of one character; random ones are hexadecimal, base 36, base 62 and base 64 strings of 20 to 60 characters
    taken from hashes. Both follow from the row number alone."""
    stems = F.array(*[F.lit(x) for x in STEMS])
    pick = lambda k: F.element_at(stems, F.expr(f"cast(pmod(xxhash64(id, {k}), {len(STEMS)}) as int) + 1"))
    words = F.slice(F.array(*[pick(k) for k in range(5)]), 1, F.expr("cast(2 + pmod(xxhash64(id, 11), 4) as int)"))
    form = F.expr("pmod(xxhash64(id, 12), 7)")
    joined = (
        F.when(form == 0, F.array_join(words, "_"))
        .when(form == 1, F.array_join(words, "-"))
        .when(form == 2, F.array_join(words, "/"))
        .when(form == 3, F.array_join(F.transform(words, F.initcap), ""))
        .when(form == 4, F.concat(F.array_join(words, ""), F.expr("cast(pmod(id, 100) as string)")))
        .when(form == 5, F.expr("repeat(element_at(array('-', '=', '_', '/', '+', 'x', '0'), cast(pmod(id, 7) as int) + 1), 24)"))
        .otherwise(F.array_join(words, ""))
    )
    digest = lambda k: F.sha2(F.concat(F.col("id").cast("string"), F.lit(k)), 256)
    shape = F.expr("pmod(id, 5)")
    base = F.base64(F.unhex(F.concat(digest("a"), digest("b"))))
    made = (
        F.when(shape == 0, digest("c"))
        .when(shape == 1, F.upper(F.regexp_replace(base, "[^A-Za-z0-9]", "")))
        .when(shape == 2, base)
        .when(shape == 3, F.translate(base, "+/=", "-_"))
        .otherwise(F.regexp_replace(base, "[^A-Za-z0-9]", ""))
    )
    cut = F.substring(made, F.lit(1), F.expr("cast(20 + pmod(xxhash64(id, 13), 41) as int)"))
    ids = spark.range(rows)
    return ids.select(joined.alias("token"), F.lit(False).alias("random")).union(ids.select(cut.alias("token"), F.lit(True).alias("random")))


def transition_ratios(samples: DataFrame) -> list[float]:
    """The two Markov models as one table: log P(b after a | random) - log P(b after a | ordinary), a and b by their
    place in ALPHABET (0: the start, or any other character), b fastest. Counts get 0.5 each. What comes to the driver
    is one number for each pair of characters, whatever the size of the sample."""
    size = len(ALPHABET) + 1
    chars = F.expr(f"transform(filter(split(token, ''), c -> c != ''), c -> instr('{ALPHABET}', c))")
    pairs = samples.where("length(token) > 0").select("random", chars.alias("c")).select("random", F.explode(F.expr("transform(c, (b, i) -> named_struct('a', if(i = 0, 0, c[i - 1]), 'b', b))")).alias("p"))
    counts = {(r.random, r.a, r.b): r.n for r in pairs.groupBy("random", F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("n")).collect()}

    def log_p(label):
        rows = [[counts.get((label, a, b), 0) + 0.5 for b in range(size)] for a in range(size)]
        return [[math.log(n / sum(row)) for n in row] for row in rows]

    odd, plain = log_p(True), log_p(False)
    return [odd[a][b] - plain[a][b] for a in range(size) for b in range(size)]


@cache
def _built_in(app: str) -> tuple[float, ...]:
    return tuple(transition_ratios(training_samples(SparkSession.getActiveSession())))


def ratio_of(token: Column, ratios: list[float]) -> Column:
    """The log-likelihood ratio of a token: its characters' transitions, summed."""
    table = F.expr("cast(split('" + ",".join(f"{x:.5f}" for x in ratios) + "', ',') as array<double>)")
    size = len(ALPHABET) + 1
    codes = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    pairs = F.flatten(F.transform(F.array(codes), lambda c: F.transform(c, lambda b, i: F.coalesce(F.get(c, i - 1), F.lit(0)) * size + b + 1)))
    return F.aggregate(pairs, F.lit(0.0), lambda total, k: total + F.element_at(table, k))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratios: list[float] | None = None, odds: float = ODDS) -> DataFrame:
    """One row per row of `docs`: id_col, base_spans and spans, arrays of struct<at, rank, kind, end> by place and kind.

    Places are code points, ends exclusive. Base kinds are assignments to a secret's name, access key ids and long
    hexadecimal runs, each searched by itself. A token of TOKEN's shape that overlaps none of them is added as `random`
    if two character Markov models, of random strings and of ordinary identifiers, give it log-odds of `odds` at least.
    `ratios` is transition_ratios() of a labelled sample; by default the built-in one is fitted, once per application.

    Everything is an expression on the row: no shuffle, so no key can be hot, and the whole text is searched whatever
    its length; work grows as n * sqrt(n) with the matches of one text and in proportion with a token's length. An empty
    table gives no rows, and columns beside the two named are not read. Null and empty texts give empty arrays; rows with null or repeated ids are rows of their own.
    """
    if ratios is None:
        ratios = list(_built_in(docs.sparkSession.sparkContext.applicationId))
    base = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    long_enough = lambda x: F.length(x["group"]) >= 6
    as_span = lambda rank: lambda x: F.struct(x["at"].alias("at"), F.lit(rank).alias("rank"), F.lit(KINDS[rank]).alias("kind"), (x["at"] + F.length(x["match"])).alias("end"))
    text = F.col("_text")
    kinds = {
        "_assign": F.transform(F.filter(place_matches(text, ASSIGN, 2), long_enough), as_span(0)),
        "_access": F.transform(place_matches(text, ACCESS), as_span(1)),
        "_hex": F.transform(place_matches(text, HEX), as_span(2)),
    }
    found = base.select("_id", "_text", *[spans.alias(name) for name, spans in kinds.items()])
    odd = lambda x: ratio_of(x["match"], ratios) >= odds

    def clear(x):
        end = x["at"] + F.length(x["match"])
        met = [overlaps(F.col(name), x["at"], end) for name in kinds]
        return ~(met[0] | met[1] | met[2])

    random = F.transform(F.filter(F.filter(place_matches(text, TOKEN), clear), odd), as_span(3))
    both = found.select("_id", F.array_sort(F.concat(*kinds)).alias("base_spans"), random.alias("_random"))
    return both.select(F.col("_id").alias(id_col), "base_spans", F.array_sort(F.concat("base_spans", "_random")).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["at"].cast("string"), x["end"].cast("string"))), ",")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of documents."""
    found = find_secrets(load(spark, sf_dir, "documents"))
    count = lambda rank: F.size(F.filter("base_spans", lambda x: x["rank"] == rank)).cast("long").alias(f"n_{KINDS[rank]}")
    return found.select("doc_id", count(0), count(1), count(2), F.sha2(span_text(F.col("base_spans")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
