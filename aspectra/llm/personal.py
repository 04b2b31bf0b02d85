"""Personal data: fixed patterns, and boosted trees over overlapping candidate spans.

The fixed patterns give the base spans. Generators of high recall propose further spans, overlapping ones included,
described by their format and context. Gradient-boosted trees learn from labels that are not the base rule: spans of
the table and made-up ones, rewritten as people write them ((at), dotted cards, no plus sign), against decoys (failed
check digits, order numbers, versions, prices). A threshold per kind, set on examples kept back, selects what is added.
Only DataFrame and SQL functions and the DataFrame classifiers of Spark are used; texts without a digit or an at sign
are not searched, and all work on a text is linear in its length and its matches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aspectra.functions.labels import bind
from aspectra.session import stored

KINDS = ("email", "ip", "card", "phone")
# The base patterns. Runs that a match would take whole are possessive, and a match does not start inside such a
# run, which changes no match but keeps long runs linear.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Wider patterns whose matches are judged by the trees; all repetitions are bounded.
CANDIDATES = {
    "email": r"[A-Za-z0-9._%+-]{1,64}(?: ?(?:@|\(at\)|\[at\]) ?)[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{1,63}){1,4}",
    "ip": r"[0-9]{1,3}(?:(?:[.,]|\[\.\]|\(\.\))[0-9]{1,3}){3,5}",
    "card": r"[0-9](?:[ .-]{0,2}[0-9]){11,19}",
    "phone": r"(?:\+|\(|00)?[0-9](?:[ ().-]{0,2}[0-9]){6,14}",
}
#: Weight of all candidates of the table together, at most; made-up examples of each kind and label, of weight 1 each.
WEIGHT, MADE_UP = 4_000, 250
#: Share of accepted examples kept back that must be right, and the thresholds tried, the last one if none will do.
PRECISION, STEPS = 0.99, (0.5, 0.6, 0.7, 0.8, 0.9, 0.95)
#: Characters of context on either side.
CONTEXT = 24
#: Values in one step of a running sum, code points in one block of a text.
STEP, BLOCK = 256, 1024
_SPAN = "struct<s:int,e:int,v:string>"
_FEATURES = (
    "k0", "k1", "k2", "k3", "size", "digits", "letters", "groups", "first", "last", "widest", "spaces", "dots", "dashes", "commas", "round", "square",
    "checks", "octets", "four", "plus", "zeros", "name", "ending", "capital", "before", "after", "call", "order", "near_digits", "near_signs",
)


def _running(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """(at, out) of a running value over an array: ``step(at, x)`` is its next value and an array of outputs.

    Outputs are gathered in steps of STEP values, so that appending does not copy all earlier ones each time.
    """
    none = F.array().cast(f"array<{kind}>")
    # The items are computed once, not for every slice of them.
    steps = bind(items, lambda it: F.transform(F.sequence(F.lit(0), F.greatest(F.size(it) - 1, F.lit(0)), F.lit(STEP)), lambda i: F.slice(it, i + 1, STEP)))

    def inner(acc: Column, x: Column) -> Column:
        at, out = step(acc["at"], x)
        return F.struct(at.alias("at"), F.concat(acc["out"], out).alias("out"))

    def outer(acc: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(acc["at"].alias("at"), none.alias("out")), inner)
        return bind(done, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    zero = F.struct(start.alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.aggregate(steps, zero, outer, lambda acc: F.struct(acc["at"].alias("at"), F.flatten(acc["out"]).alias("out")))


def _spans(text: Column, pattern: str) -> Column:
    """(s, e, v) of each match, leftmost and not overlapping; code points, end exclusive."""
    match = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    piece = F.split(text, pattern, -1)

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["p"])
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        # Behind the last match there is a piece of text alone.
        found = F.when(x["m"].isNotNull(), F.array(F.struct(start.alias("s"), end.alias("e"), x["m"].alias("v")))).otherwise(F.array().cast(f"array<{_SPAN}>"))
        return end, found

    return _running(F.arrays_zip(match.alias("m"), piece.alias("p")), F.lit(0), step, _SPAN)["out"]


def _blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), 0)


def _between(blocks: Column, start: Column, end: Column) -> Column:
    """Code points from ``start`` to ``end`` of a text that is cut into blocks, without a walk from its beginning."""

    def part(j: Column) -> Column:
        first = F.greatest(start - j * BLOCK, F.lit(0))
        return F.substr(F.get(blocks, j), first + 1, F.least(end - j * BLOCK, F.lit(BLOCK)) - first)

    first, last = F.floor(start / BLOCK).cast("int"), F.floor((end - 1) / BLOCK).cast("int")
    return F.when(end > start, F.array_join(F.transform(F.sequence(first, F.greatest(first, last)), part), "")).otherwise("")


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    """Whether the digits of a string pass the Luhn check."""
    weighed = F.transform(
        F.filter(F.split(F.reverse(_digits(v)), ""), lambda d: d != ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int") + 1)),
    )
    return F.aggregate(weighed, F.lit(0), lambda a, x: a + x) % 10 == 0


def _octets(v: Column, by: str = r"\.") -> Column:
    return F.forall(F.split(v, by), lambda p: p.rlike("^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _valid(kind: str, v: Column) -> Column:
    size = F.length(_digits(v))
    if kind == "ip":
        return _octets(v)
    if kind == "card":
        return F.when(size.between(13, 19), _luhn(v)).otherwise(False)
    if kind == "phone":
        return size.between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Base spans of a text that is not null: (k, s, e) with k the place of the kind in KINDS."""

    def of(k: int, kind: str) -> Column:
        gate = F.instr(text, "@") > 0 if kind == "email" else text.rlike("[0-9]")
        found = F.filter(_spans(text, BASE[kind]), lambda x: _valid(kind, x["v"]))
        spans = F.transform(found, lambda x: F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e")))
        return F.when(gate, spans).otherwise(F.array().cast("array<struct<k:int,s:int,e:int>>"))

    return F.concat(*(of(k, kind) for k, kind in enumerate(KINDS)))


def candidate_spans(text: Column) -> Column:
    """Candidate spans with their words and surroundings: (k, s, e, v, left, right)."""
    kind_type = "array<struct<k:int,s:int,e:int,v:string,left:string,right:string>>"

    def of(k: int, kind: str, blocks: Column, size: Column) -> Column:
        gate = text.rlike("@|[(\\[]at[)\\]]") if kind == "email" else text.rlike("[0-9]{2}")
        out = F.transform(
            _spans(text, CANDIDATES[kind]),
            lambda x: F.struct(
                F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"),
                _between(blocks, F.greatest(x["s"] - CONTEXT, F.lit(0)), x["s"]).alias("left"),
                _between(blocks, x["e"], F.least(x["e"] + CONTEXT, size)).alias("right"),
            ),
        )
        return F.when(gate, out).otherwise(F.array().cast(kind_type))

    found = bind(
        F.struct(_blocks(text).alias("blocks"), F.length(text).alias("size")),
        lambda t: F.concat(*(of(k, kind, t["blocks"], t["size"]) for k, kind in enumerate(KINDS))),
    )
    return F.when(text.rlike("@|[(\\[]at[)\\]]|[0-9]{2}"), found).otherwise(F.array().cast(kind_type))


def _describe(rows: DataFrame) -> DataFrame:
    """Numbers of the format and context of candidates (k, v, left, right)."""

    def count(c: str, pattern: str) -> Column:
        return F.regexp_count(F.col(c), F.lit(pattern)).cast("double")

    def class_of(c: Column) -> Column:
        return F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike("[0-9]"), 2).when(c.rlike(r"\p{L}"), 3).when(c.rlike("[=\"'_/-]"), 4).otherwise(5).cast("double")

    def matches(c: Column, pattern: str) -> Column:
        return c.rlike(pattern).cast("double")

    v, left, number = F.col("v"), F.lower("left"), F.length(_digits(F.col("v")))
    groups = F.transform(F.regexp_extract_all("v", F.lit("[0-9]+"), 0), lambda g: F.length(g))
    made = {f"k{i}": (F.col("k") == i).cast("double") for i in range(len(KINDS))}
    made |= {
        "size": F.length(v).cast("double"), "digits": number.cast("double"), "letters": count("v", r"\p{L}"),
        "groups": F.size(groups).cast("double"),
        "first": F.coalesce(F.get(groups, F.lit(0)), F.lit(0)).cast("double"), "last": F.coalesce(F.try_element_at(groups, F.lit(-1)), F.lit(0)).cast("double"),
        "widest": F.coalesce(F.array_max(groups), F.lit(0)).cast("double"),
        "spaces": count("v", " "), "dots": count("v", r"\."), "dashes": count("v", "-"), "commas": count("v", ","), "round": count("v", r"\("), "square": count("v", r"\["),
        "checks": F.when(number.between(12, 20), _luhn(v)).otherwise(False).cast("double"),
        "octets": _octets(F.regexp_replace(v, r"[\[\]()]", ""), "[.,]").cast("double"), "four": (F.size(groups) == 4).cast("double"),
        "plus": matches(v, r"^\+"), "zeros": matches(v, "^00"),
        # Of an address: letters in the name, letters of the ending, and a capital behind a full stop.
        "name": matches(v, r"^[A-Za-z0-9._%+-]*[A-Za-z]"), "ending": F.length(F.regexp_extract("v", "[A-Za-z]*$", 0)).cast("double"), "capital": matches(v, r"\. +[A-Z]|[a-z]\.[A-Z]"),
        "before": class_of(F.substring(F.col("left"), -1, 1)), "after": class_of(F.substring(F.col("right"), 1, 1)),
        "call": matches(left, r"(tel|phone|call|fax|mobil|cell|contact|reach|dial|whatsapp|mail|write|card|visa|paid|pay|account|host|server|address|from|ip)[^\p{L}]*$"),
        "order": matches(left, r"(order|invoice|ref|no|nr|id|isbn|version|release|build|total|page|pages|part|item|ticket|serial|case|sum|v|#)[^\p{L}]*$"),
        "near_digits": count("left", "[0-9]") + count("right", "[0-9]"), "near_signs": count("left", r"[^\p{L}\s0-9.,]") + count("right", r"[^\p{L}\s0-9.,]"),
    }
    return rows.withColumns(made)


def _pick(h: Column, *choices: str) -> Column:
    """One of the choices by a hash."""
    return F.element_at(F.array(*map(F.lit, choices)), F.pmod(h, F.lit(len(choices))).cast("int") + 1)


def _with_check(digits: Column) -> Column:
    """The digits and the one that makes them pass the Luhn check."""
    ends = F.filter(F.array(*(F.lit(str(d)) for d in range(10))), lambda d: _luhn(F.concat(digits, d)))
    return F.concat(digits, F.element_at(ends, 1))


def _grouped(digits: Column, by: Column, size: int = 4) -> Column:
    cut = F.regexp_extract_all(digits, F.lit(f"[0-9]{{1,{size}}}"), 0)
    return F.concat_ws("", F.transform(cut, lambda g, i: F.concat(F.when(i > 0, by).otherwise(""), g)))


def _rewritten(k: Column, v: Column, h: Column) -> Column:
    """A base span as people also write it: the same data that the base patterns miss."""
    digits = _digits(v)
    at, dot = _pick(h, " (at) ", "(at)", " [at] ", "[at]", " @ "), _pick(F.xxhash64(h), " (dot) ", "(dot)", "[dot]", " [dot] ", ".")
    name, domain = F.substring_index(v, "@", 1), F.substring_index(v, "@", -1)
    local = F.substr(digits, F.greatest(F.length(digits) - 9, F.lit(1)))
    a, b, c = F.substr(local, F.lit(1), F.lit(3)), F.substr(local, F.lit(4), F.lit(3)), F.substr(local, F.lit(7))
    phone = F.element_at(
        F.array(
            F.concat(F.lit("("), a, F.lit(") "), b, F.lit("-"), c), F.concat(a, F.lit("-"), b, F.lit("-"), c), F.concat(a, F.lit("."), b, F.lit("."), c),
            F.concat(F.lit("00"), F.substr(digits, F.lit(1), F.lit(2)), F.lit(" "), a, F.lit(" "), b, F.lit(" "), c), F.concat(F.lit("("), a, F.lit(") "), b, F.lit(" "), c),
            F.concat(F.lit("00"), F.substr(digits, F.lit(1), F.lit(2)), F.lit(" "), _grouped(local, F.lit(" "), 3)),
            F.concat(F.lit("00"), F.substr(digits, F.lit(1), F.lit(2)), F.lit(" "), F.substr(local, F.lit(1), F.lit(2)), F.lit(" "), _grouped(F.substr(local, F.lit(3)), F.lit(" "), 3)),
        ),
        F.pmod(h, F.lit(7)).cast("int") + 1,
    )
    return (
        F.when(k == 0, F.concat(name, at, F.regexp_replace(domain, r"\.", dot)))
        .when(k == 1, F.concat_ws("", F.transform(F.split(v, r"\."), lambda p, i: F.concat(F.when(i > 0, _pick(h, "[.]", "(.)", ",")).otherwise(""), p))))
        .when(k == 2, _grouped(digits, _pick(h, ".", "  ", " . ", "-.")))
        .otherwise(phone)
    )


def _decoy(k: Column, v: Column, h: Column) -> Column:
    """Something of the same look that is no personal data."""
    digits, n = _digits(v), F.pmod(F.xxhash64(h), F.lit(900)).cast("string")
    last = F.pmod(F.substr(digits, F.length(digits)).cast("int") + 1 + F.pmod(h, F.lit(8)).cast("int"), F.lit(10)).cast("string")
    failed = _grouped(F.concat(F.substr(digits, F.lit(1), F.length(digits) - 1), last), _pick(h, " ", "-", ".", "", ""))
    price = F.concat(n, F.lit(" @ "), F.pmod(h, F.lit(99)).cast("string"), F.lit("."), F.pmod(F.xxhash64(h, k), F.lit(99)).cast("string"))
    sentence = F.concat(_pick(h, "meet", "arrive", "stop", "look", "route66", "gate4"), _pick(F.xxhash64(h), " (at) ", " [at] ", " @ "), _pick(h, "noon", "home", "night", "once"), _pick(h, ". Then", ". The", ". We", ". After"))
    big = F.concat((F.pmod(h, F.lit(600)) + 300).cast("string"), F.regexp_extract(v, r"^[0-9]+(.*)$", 1))
    version = F.concat(F.pmod(h, F.lit(20)).cast("string"), F.lit("."), F.pmod(F.xxhash64(h), F.lit(30)).cast("string"), F.lit("."), n, F.lit("."), F.pmod(h, F.lit(90)).cast("string"), F.lit("."), n)
    thousands = F.concat_ws(",", F.pmod(h, F.lit(99)).cast("string"), F.lpad(n, 3, "0"), F.lpad(n, 3, "1"), F.lpad(n, 3, "2"))
    run = F.substr(F.concat(digits, n, digits), F.lit(1), (F.pmod(h, F.lit(6)) + 7).cast("int"))
    date = F.concat((F.pmod(h, F.lit(80)) + 1950).cast("string"), F.lit("-"), F.lpad((F.pmod(h, F.lit(12)) + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((F.pmod(F.xxhash64(h), F.lit(28)) + 1).cast("string"), 2, "0"))
    years = F.concat((F.pmod(h, F.lit(80)) + 1950).cast("string"), _pick(h, "-", " - ", " "), (F.pmod(F.xxhash64(h), F.lit(80)) + 1950).cast("string"))
    number = F.concat(F.pmod(h, F.lit(9)).cast("string"), F.lit("."), run)
    of = F.pmod(F.xxhash64(h, F.lit(1)), F.lit(5))
    return (
        F.when(k == 0, F.when(of < 2, price).otherwise(sentence))
        .when(k == 1, F.when(of < 2, big).when(of < 4, version).otherwise(thousands))
        .when(k == 2, failed)
        .otherwise(F.when(of == 0, date).when(of == 1, years).when(of == 2, number).otherwise(run))
    )


def _surroundings(own: Column, h: Column, mine: int, neutral: int) -> Column:
    """Words before an example: of ten its own kind's ``mine`` times, neutral ones, else those before numbers of any kind."""
    of = F.pmod(F.xxhash64(h, F.lit(2)), F.lit(10))
    plain = _pick(F.xxhash64(h, F.lit(4)), "and ", "or ", "the ", "with ", "call me at ", "it was ", "some words. ", "")
    number = _pick(F.xxhash64(h, F.lit(5)), "order ", "invoice no. ", "version ", "total ", "pages ", "ref ", "build ", "id ")
    return F.when(of < mine, own).when(of < mine + neutral, plain).otherwise(number)


def _made_up(spark) -> DataFrame:
    """Examples that need no table: (k, v, left, right, h) of base spans of all kinds."""
    rows = spark.range(MADE_UP * len(KINDS)).select((F.col("id") % len(KINDS)).cast("int").alias("k"), F.xxhash64("id", F.lit("made up")).alias("h"))
    figures = F.lpad(F.conv(F.substring(F.sha2(F.col("h").cast("string"), 256), 1, 14), 16, 10), 18, "7")
    k, h = F.col("k"), F.col("h")

    def octet(i: int) -> Column:
        return F.pmod(F.xxhash64(h, F.lit(i)), F.lit(256)).cast("string")

    tail = F.when(F.pmod(F.xxhash64(h, F.lit(3)), F.lit(3)) == 0, F.pmod(h, F.lit(90)).cast("string")).otherwise("")
    email = F.concat(_pick(h, "ann", "j.doe", "info", "sales.team", "k_lee", "maria", "john.smith"), tail, F.lit("@"), _pick(F.xxhash64(h), "mail", "post", "firm-x", "uni"), F.lit("."), _pick(h, "org", "com", "net", "co.uk", "de", "mail.example"))
    value = (
        F.when(k == 0, email)
        .when(k == 1, F.concat_ws(".", octet(0), octet(1), octet(2), octet(3)))
        .when(k == 2, _with_check(F.concat(_pick(h, "4", "5", "6", "34"), F.substring(figures, 1, 14))))
        .otherwise(F.concat(F.lit("+"), F.substring(figures, 1, 12)))
    )
    own = F.when(k == 0, _pick(h, "mail ", "write to ", "contact: ", "ask ")).when(k == 1, _pick(h, "host ", "from ", "server: ", "ip ")).when(
        k == 2, _pick(h, "card ", "paid with ", "visa: ", "account ")
    ).otherwise(_pick(h, "call ", "phone: ", "reach us at ", "dial "))
    left = _surroundings(own, h, 6, 3)
    return rows.select("k", "h", value.alias("v"), left.alias("left"), _pick(F.xxhash64(h), " today", ".", ", or", " and then", "").alias("right"))


def _examples(near: DataFrame) -> DataFrame:
    """(k, v, left, right, label, h, weight) to learn from; ``near`` are all candidates of the table with ``known``, whether a base
    span of their kind stands there, and ``sound``, whether they may be personal data at all."""
    order = F.xxhash64("v", "left", "k")
    found = near.where("known or not sound")
    # However many there are, those of the table weigh as WEIGHT together, beside the made-up ones.
    weight = F.lit(min(1.0, WEIGHT / max(found.count(), 1)))
    found = found.select("k", "v", "left", "right", "known", "sound", order.alias("h"), weight.alias("weight"))
    shape = ["k", "v", "left", "right", "h", "weight"]
    spans = found.where("known").select(*shape).unionByName(_made_up(near.sparkSession).withColumn("weight", F.lit(1.0)))
    k, v, h = F.col("k"), F.col("v"), F.col("h")
    # A decoy stands in the surroundings of spans, in neutral ones and in those of numbers.
    ref = _surroundings(F.col("left"), F.xxhash64(h, F.lit("decoy")), 3, 4)
    parts = [
        spans.withColumn("label", F.lit(1.0)),
        spans.withColumns({"v": _rewritten(k, v, h), "label": F.lit(1.0)}),
        spans.withColumns({"v": _decoy(k, v, h), "left": ref, "label": F.lit(0.0)}),
        found.where("not known and not sound").select(*shape, F.lit(0.0).alias("label")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """One pass over the texts, stored: _doc with the kept columns, a row id, base and candidate spans."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc = F.struct(*(F.col(f"`{c}`") for c in keep)).alias("_doc")
    return stored(docs.select(doc, F.monotonically_increasing_id().alias("_row"), base_spans(text).alias("_base"), candidate_spans(text).alias("_near")), "spans")


def _sound(k: Column, v: Column, left: Column, right: Column) -> Column:
    """Whether a candidate may be personal data at all: check digits, octets and numbers of digits as they must be, and
    no part of a longer number."""
    size = F.length(_digits(v))
    return (
        F.when((k > 0) & (left.rlike("[0-9][.,-]?$") | right.rlike("^[.,-]?[0-9]")), False)
        .when(k == 1, _octets(F.regexp_replace(v, r"[\[\]()]", ""), "[.,]") & (F.size(F.split(v, "[.,]")) == 4))
        .when(k == 2, F.when(size.between(13, 19), _luhn(v)).otherwise(False))
        .when(k == 3, size.between(9, 15))
        .otherwise(v.rlike("[A-Za-z]{2,}$"))
    )


def _placed(scanned: DataFrame) -> DataFrame:
    """One row per candidate, with ``known`` (a base span of its kind stands there), ``taken`` (a base span of any kind
    overlaps it) and ``sound``; by one sort of the spans of each row, not by comparing all with all."""
    none = F.lit(None).cast("string")
    base = F.transform("_base", lambda b: F.struct(b["k"].alias("k"), b["s"].alias("s"), b["e"].alias("e"), none.alias("v"), none.alias("left"), none.alias("right")))
    spans = scanned.where(F.size("_near") > 0).select("_row", F.inline(F.concat(base, F.col("_near")))).withColumn("base", F.col("v").isNull())
    # Running frames both ways: one that ends at the last row would be computed anew for each row.
    ahead, behind = (Window.partitionBy("_row").orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.col("s"), F.desc("s")))
    before, after = F.max(F.when(F.col("base"), F.col("e"))).over(ahead), F.min(F.when(F.col("base"), F.col("s"))).over(behind)
    known = F.max("base").over(Window.partitionBy("_row", "k", "s", "e"))
    taken = F.coalesce(F.col("before") > F.col("s"), F.lit(False)) | F.coalesce(F.col("after") < F.col("e"), F.lit(False))
    spans = spans.withColumns({"before": before, "after": after}).withColumns({"known": known, "taken": taken}).where("not base")
    return spans.select("_row", "k", "s", "e", "v", "left", "right", "known", "taken", _sound(*map(F.col, ("k", "v", "left", "right"))).alias("sound"))


def _additions(scanned: DataFrame) -> DataFrame:
    """(_row, _more) with the spans that the trees add."""
    near = stored(_placed(scanned), "candidates")
    vectors = VectorAssembler(inputCols=list(_FEATURES), outputCol="features")
    examples = stored(_describe(_examples(near)).select("k", "label", "h", "weight", *_FEATURES), "examples")
    examples = vectors.transform(examples)
    back = F.pmod(F.xxhash64("h", "label"), F.lit(4)) == 0
    model = GBTClassifier(maxIter=16, maxDepth=4, maxBins=32, stepSize=0.3, seed=1, cacheNodeIds=False, weightCol="weight").fit(examples.where(~back))
    score = vector_to_array("probability")[1]
    least = thresholds(model.transform(examples.where(back)).select("k", "label", "weight", score.alias("p")))
    # What the base patterns found is there already; what cannot be personal data is not scored.
    rest = _describe(near.where("sound and not taken"))
    passing = F.element_at(F.array(*map(F.lit, least)), F.col("k") + 1) <= F.col("p")
    scored = model.transform(vectors.transform(rest)).select("_row", "k", "s", "e", score.alias("p")).where(passing)
    return scored.groupBy("_row").agg(F.collect_list(F.struct("k", "s", "e")).alias("_more"))


def thresholds(held: DataFrame) -> list[float]:
    """Per kind, the least of STEPS at which PRECISION of the accepted (k, label, p) are right, by ``weight`` if they
    have one; the last if none is."""
    weight = F.col("weight") if "weight" in held.columns else F.lit(1.0)
    right = held.groupBy("k").agg(
        *(F.sum(F.when(F.col("p") >= t, F.col("label") * weight)).alias(f"r{i}") for i, t in enumerate(STEPS)),
        *(F.sum(F.when(F.col("p") >= t, weight)).alias(f"n{i}") for i, t in enumerate(STEPS)),
    )
    least = [STEPS[-1]] * len(KINDS)
    for r in right.collect():
        least[r.k] = next((t for i, t in enumerate(STEPS) if r[f"n{i}"] and r[f"r{i}"] >= PRECISION * r[f"n{i}"]), STEPS[-1])
    return least


def _with_spans(docs: DataFrame, keep: list[str]) -> DataFrame:
    """_doc with the kept columns, ``_base`` and ``_all``: base and added spans, sorted by kind, start and end."""
    scanned = _scan(docs, keep)
    rows = scanned.select("_doc", "_row", "_base").join(_additions(scanned), "_row", "left")
    none = F.array().cast("array<struct<k:int,s:int,e:int>>")
    return rows.select("_doc", "_base", F.sort_array(F.concat("_base", F.coalesce("_more", none))).alias("_all"))


def _written(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["s"], x["e"])), ",")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Spans of personal data in each whole text.

    ``docs`` has doc_id and text; other columns are ignored. Returns doc_id, n_email, n_ip, n_card and n_phone (base
    spans), base_sha256 (of the base spans written kind:start:end, by kind and start) and spans (base and added
    spans, written alike, overlapping ones included). A null text is empty and has none. Rows that repeat a doc_id
    are rows of their own. The trees are fitted on all candidates of the table, rewritten and as decoys,
    and on MADE_UP examples of each kind, so a table of any size, also one without base spans, has its spans
    added. An empty table gives an empty table.
    """
    rows = _with_spans(docs.select("doc_id", "text"), ["doc_id"])

    def of(k: int) -> Column:
        return F.size(F.filter("_base", lambda b: b["k"] == k)).cast("long")

    counts = {f"n_{kind}": of(k) for k, kind in enumerate(KINDS)}
    return rows.select(F.col("_doc.doc_id").alias("doc_id"), *(c.alias(n) for n, c in counts.items()), F.sha2(_written(F.sort_array("_base")), 256).alias("base_sha256"), _written(F.col("_all")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of personal data in text replaced by its kind in brackets, and n_chars set anew.

    Overlapping spans are replaced once, by the kind that starts first. All columns of ``docs`` stay as they are,
    whatever their names, but text and, if there is one, n_chars; null texts stay null.
    """
    rows = _with_spans(docs, docs.columns)
    text, tags = F.col("_doc.text"), F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    by_start = F.sort_array(F.transform("_all", lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("back"), x["k"].alias("k"))))
    kind = "struct<a:int,b:int,k:int>"

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        kept = F.when(x["s"] >= at, F.array(F.struct(at.alias("a"), x["s"].alias("b"), x["k"].alias("k")))).otherwise(F.array().cast(f"array<{kind}>"))
        return F.greatest(at, -x["back"]), kept

    def put(blocks: Column) -> Column:
        def assembled(r: Column) -> Column:
            parts = F.transform(r["out"], lambda p: F.concat(_between(blocks, p["a"], p["b"]), F.element_at(tags, p["k"] + 1)))
            return F.array_join(F.concat(parts, F.array(_between(blocks, r["at"], F.length(text)))), "")

        return bind(_running(by_start, F.lit(0), step, kind), assembled)

    rows = rows.select("_doc", F.when(F.size("_all") == 0, text).otherwise(bind(_blocks(text), put)).alias("_text"))
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return rows.select(*(new[c].alias(c) if c in new else F.col(f"_doc.`{c}`") for c in docs.columns))
