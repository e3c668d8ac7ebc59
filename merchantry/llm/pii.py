"""Personal data by patterns that seed entities induce (2). DataFrame functions only.

Base entities are those of four fixed expressions (email, ip, card, phone), with their checks. Each stands in a lexical
pattern: the word before it, and the two words before it. Together with the other identifier-shaped mentions of the
texts (words with a digit, @, (at) or [at] between base entities, chains of them and each word of a chain) they form a
graph of patterns and instances. Rounds score it: a pattern's confidence in a kind is the summed confidence of its
distinct instances over their number, if at least `support` of them are known; an instance's confidence is the chance
that not all its patterns err. Rounds end when the instances at `least` or more stay the same (or after `rounds`). Those
of the right shape are further entities. Base entities always stay.

Matching takes time in proportion to the text: runs are possessive and are entered at their beginning or where the last
match ended, which gives the same leftmost matches. Places are running sums over gaps and matches, taken by blocks of
the square root of their number. In a copy of the text each base entity is a mark of the same length, so mentions end
there and words before one are read with the mark for what it covers.

Defined results: in a text that holds U+E000 to U+E00F these count as "?" for mentions; a mention that touches a base
entity which overlaps one of another kind is dropped; a null or empty text has no entities; counts and the digest are of base entities; rows that agree in id
and text get the same result each, and count once as instances; null ids are kept; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchantry.session import cut

KINDS = ("email", "ip", "card", "phone")
_MARKS, _FILL = "", ""
_PRIVATE = "".join(chr(c) for c in range(0xE000, 0xE010))
_WORD, _LOCAL = rf"[^\x20\x09-\x0D{_MARKS}{_FILL}]", "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for the expression to be tried at all.
_TRIGGER = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_SIGN = r"(?:[0-9@]|\(at\)|\[at\])"
MENTION = rf"(?<!{_WORD})(?={_WORD}*{_SIGN}){_WORD}++(?:\x20(?={_WORD}*[0-9]){_WORD}++)*+"
#: Shapes of further entities, after outer punctuation is cut off.
SHAPES = {
    "email": r"^[A-Za-z0-9._%+-]+(?:@|\(at\)|\[at\])[A-Za-z0-9.-]+$",
    "ip": r"^[0-9]{1,3}(?:[.,:_-][0-9]{1,3}){3}$",
    "card": r"^[0-9](?:[\x20._/-]?[0-9]){12,18}$",
    "phone": r"^\(?[0-9](?:[\x20()./-]{0,2}[0-9]){8,14}$",
}
_TOKEN = rf"[{_MARKS}]{_FILL}*+|{MENTION}"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, also where body has it inside a function of elements."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _starts(lengths: Column) -> Column:
    """Running sums before each element. A sum that appends to an array copies it each time, so blocks of the square
    root of the number are summed one by one."""
    none = F.array().cast("array<bigint>")

    def scan(values: Column, first: Column) -> Column:
        zero = F.struct(first.alias("at"), none.alias("out"))
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
        return F.aggregate(values, zero, step)["out"]

    def whole(values: Column) -> Column:
        size = F.greatest(F.size(values), F.lit(1))
        side = F.ceil(F.sqrt(size.cast("double"))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(size / side).cast("int") - 1), lambda j: F.slice(values, j * side + 1, side))
        zero = F.lit(0).cast("bigint")
        sums = lambda b: F.transform(b, lambda x: F.aggregate(x, zero, lambda acc, v: acc + v))
        return _let(blocks, lambda b: F.flatten(F.zip_with(b, scan(sums(b), zero), scan)))

    return _let(F.transform(lengths, lambda x: x.cast("bigint")), whole)


def _steps(text: Column, expression: str) -> Column:
    """The matches m of an expression, each with the text g from the match before it."""
    matches = F.regexp_extract_all(text, F.lit(expression), F.lit(0))
    return F.arrays_zip(matches.alias("m"), F.slice(F.split(text, expression, -1), F.lit(1), F.size(matches)).alias("g"))


def _placed(steps: Column) -> Column:
    """Steps with start and end in code points."""
    length = lambda s: F.char_length(s["g"]) + F.char_length(s["m"])
    place = lambda s, at: F.struct((at + F.char_length(s["g"])).alias("start"), (at + length(s)).alias("end"), s["m"].alias("value"), s["g"].alias("gap"))
    return _let(steps, lambda x: F.zip_with(x, _starts(F.transform(x, length)), place))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _octets(value: Column, marks: str) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    small = lambda p: F.when(F.char_length(part(p)) <= 3, part(p).try_cast("int") <= 255).otherwise(False)
    return F.forall(F.split(value, marks), small)


def _valid(kind: str, value: Column) -> Column:
    n = F.char_length(_digits(value))
    if kind == "ip":
        return _octets(value, r"\.")
    if kind == "card":
        return n.between(13, 19) & F.call_function("luhn_check", _digits(value))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _shape(value: Column) -> Column:
    """The kind that a mention may be of, or null."""
    out = F.lit(None).cast("string")
    for kind in ("phone", "card", "ip", "email"):
        fits = F.regexp_like(value, F.lit(SHAPES[kind]))
        if kind == "ip":
            fits = F.when(fits, _octets(value, "[.,:_-]")).otherwise(False)
        if kind == "card":
            fits = F.when(fits, F.call_function("luhn_check", _digits(value))).otherwise(False)
        out = F.when(fits, kind).otherwise(out)
    return out


def _marked(text: Column, steps: Column, expression: str, kind: str) -> Column:
    """The text with a mark and fill over each valid match."""
    cover = lambda v: F.concat(F.lit(_MARKS[KINDS.index(kind)]), F.repeat(F.lit(_FILL), F.char_length(v) - 1))
    one = lambda s: F.concat(s["g"], F.when(_valid(kind, s["m"]), cover(s["m"])).otherwise(s["m"]))
    rest = F.element_at(F.split(text, expression, -1), -1)
    return F.when(F.exists(steps, lambda s: _valid(kind, s["m"])), F.concat(F.array_join(F.transform(steps, one), ""), rest)).otherwise(text)


def _before(steps: Column, i: Column) -> Column:
    """What stands before the match of step i, from the last match but one on: its last 80 characters."""
    match = lambda j: F.coalesce(F.get(steps, j)["value"], F.lit(""))
    gap = lambda j: F.coalesce(F.get(steps, j)["gap"], F.lit(""))
    return F.substring(F.concat(match(i - 2), gap(i - 1), match(i - 1), gap(i)), -80, 80)


def _words(piece: Column) -> Column:
    """The words of a chain as mentions of their own."""

    def each(words: Column, at: Column) -> Column:
        word = lambda j: F.concat(F.get(words, j), F.lit(" "))
        lead = lambda i: F.when(i == 0, piece["before"]).when(i == 1, F.concat(piece["before"], word(i - 1))).otherwise(F.concat(word(i - 2), word(i - 1)))
        start = lambda i: piece["start"] + F.get(at, i)
        one = lambda w, i: _mention(F.lit(None), start(i), start(i) + F.char_length(w), w, F.substring(lead(i), -80, 80), False, piece["start"])
        return F.transform(words, one)

    return _let(F.split(piece["value"], " "), lambda w: _let(_starts(F.transform(w, lambda x: F.char_length(x) + 1)), lambda at: each(w, at)))


def _mention(kind: Column, start: Column, end: Column, value: Column, before: Column, whole: bool, piece: Column) -> Column:
    columns = {"kind": kind.cast("string"), "start": start, "end": end, "value": value, "before": before, "whole": F.lit(whole), "piece": piece}
    return F.struct(*(c.alias(n) for n, c in columns.items()))


def _of_kind(tokens: Column, kind: str) -> Column:
    return F.filter(tokens, lambda s: F.startswith(s["value"], F.lit(_MARKS[KINDS.index(kind)])))


def _seeds(kind: str, tokens: Column, values: Column) -> Column:
    """The marks of a kind as mentions with the values that they cover."""
    return F.zip_with(tokens, values, lambda s, v: _mention(F.lit(kind), s["start"], s["end"], v, s["before"], True, s["start"]))


def base_entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, an array of valid spans for each kind, and all mentions, each with the text before it. whole:
    it is not a word of a longer one, which begins at piece."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("marked", F.translate("text", _PRIVATE, "?" * len(_PRIVATE)))
    none = F.array().cast("array<struct<m:string,g:string>>")
    tried = lambda text, expression, trigger: F.when(F.regexp_like(text, F.lit(trigger)), _steps(text, expression)).otherwise(none)
    for kind in KINDS:
        rows = rows.withColumns({f"{kind}_steps": tried(F.col("text"), BASE[kind], _TRIGGER[kind]), "steps": tried(F.col("marked"), BASE[kind], _TRIGGER[kind])})
        spans = F.filter(_placed(F.col(f"{kind}_steps")), lambda s: _valid(kind, s["value"]))  # noqa: B023
        values = F.transform(F.filter("steps", lambda s: _valid(kind, s["m"])), lambda s: s["m"])  # noqa: B023
        marked = _marked(F.col("marked"), F.col("steps"), BASE[kind], kind)
        rows = rows.withColumns({kind: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))), f"{kind}_values": values, "marked": marked})
        rows = rows.drop("steps", f"{kind}_steps")
    rows = rows.withColumn("tokens", _placed(tried(F.col("marked"), _TOKEN, rf"[{_MARKS}]|{_SIGN}")))
    placed = lambda s, i: _mention(F.lit(None), s["start"], s["end"], s["value"], _before(F.col("tokens"), i), True, s["start"])
    rows = rows.withColumn("tokens", F.transform("tokens", placed))
    key = lambda s: s["start"] * (1 << 32) + s["end"]
    of = {k: _of_kind(F.col("tokens"), k) for k in KINDS}
    seeds = [_seeds(k, of[k], F.col(f"{k}_values")) for k in KINDS]
    # Base entities that overlap one of an earlier kind have no mark of their own.
    hidden = F.flatten(F.array(*(F.array_except(F.transform(k, key), F.transform(of[k], key)) for k in KINDS)))
    rows = rows.withColumns({"seeds": F.concat(*seeds), "hidden": hidden})
    plain = F.filter("tokens", lambda s: ~F.regexp_like(s["value"], F.lit(f"^[{_MARKS}]")))
    meets = lambda s, h: (s["start"] < h % (1 << 32)) & (F.floor(h / (1 << 32)) < s["end"])
    apart = lambda hidden: F.filter(plain, lambda s: ~F.exists(hidden, lambda h: meets(s, h)))
    rows = rows.withColumn("mentions", _let(F.col("hidden"), apart))
    chains = F.filter("mentions", lambda s: F.contains(s["value"], F.lit(" ")))
    signed = F.filter(F.flatten(F.transform(chains, _words)), lambda s: F.regexp_like(s["value"], F.lit(_SIGN)))
    return rows.select("doc_id", F.xxhash64("text").alias("text_hash"), *KINDS, F.concat("seeds", "mentions", signed).alias("seen"))


def _mentions(found: DataFrame) -> DataFrame:
    """A row for each base entity and each other mention, with its patterns and outer punctuation cut off."""
    rows = found.select("doc_id", "text_hash", F.explode("seen").alias("m")).select("doc_id", "text_hash", "m.*")
    lead = F.char_length(F.regexp_extract("value", r"^[^A-Za-z0-9+(@]*", 0))
    value = F.regexp_replace("value", r"^[^A-Za-z0-9+(@]+|[^A-Za-z0-9)]+$", "")
    own = F.col("kind").isNotNull()
    rows = rows.withColumns(
        {
            "value": F.when(own, F.col("value")).otherwise(value),
            "start": F.when(own, F.col("start")).otherwise(F.col("start") + lead),
            "before": F.regexp_replace(F.regexp_replace(F.translate(F.lower("before"), _FILL, ""), f"[{_MARKS}]", "@"), "[0-9]", "0"),
        }
    )
    rows = rows.withColumn("end", F.when(own, F.col("end")).otherwise(F.col("start") + F.char_length("value")))
    words = F.filter(F.split("before", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    last = F.slice(F.concat(F.array(F.lit("^"), F.lit("^")), words), -2, 2)
    rows = rows.withColumn("last", F.transform(last, lambda w: F.substring(w, -24, 24)))
    patterns = F.array(F.concat(F.lit("1:"), F.element_at("last", 2)), F.concat(F.lit("2:"), F.element_at("last", 1), F.lit(" "), F.element_at("last", 2)))
    shape = F.when(own, F.col("kind")).otherwise(_shape(F.col("value")))
    return rows.select("doc_id", "text_hash", "start", "end", F.xxhash64(F.lower("value")).alias("instance"), F.col("kind").alias("base"), shape.alias("kind"), patterns.alias("patterns"), "whole", "piece").where("end > start and (whole or kind is not null)")


def discovered(found: DataFrame, support: int = 5, least: float = 0.9) -> DataFrame:
    """doc_id, text_hash, kind, start, end of the further entities. Confidences only grow from round to round, so rounds end
    by themselves, when none has grown in its first three digits."""
    mentions = cut(_mentions(found))
    edges = cut(mentions.select(F.explode("patterns").alias("pattern"), "instance", "base", "kind").distinct())
    spread = edges.groupBy("pattern").agg(F.count_distinct("instance").alias("n"))
    known = mentions.where("base is not null").select("instance", "kind").distinct().withColumn("c", F.lit(1.0))
    seen = None
    while True:
        sure = edges.select("pattern", "instance", "kind").where("kind is not null").distinct().join(known, ["instance", "kind"])
        scored = sure.groupBy("pattern", "kind").agg(F.sum("c").alias("c"), F.count_if(F.col("c") >= least).alias("k"))
        scored = scored.where(F.col("k") >= support).join(spread, "pattern")
        scored = scored.select("pattern", "kind", (F.col("c") / F.col("n")).alias("p")).where("p >= 0.5")
        open_ones = edges.where("base is null and kind is not null").select("pattern", "instance", "kind").distinct()
        miss = F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-6))))
        new = open_ones.join(scored, ["pattern", "kind"]).groupBy("instance", "kind").agg((1 - F.exp(miss)).alias("c"))
        known = cut(known.where("c = 1.0").unionByName(new).groupBy("instance", "kind").agg(F.max("c").alias("c")))
        # Which instances are at `least` or more, and how far the others are, to three digits.
        mark = F.xxhash64("instance", "kind", F.col("c") >= least, F.round("c", 3)) % F.lit(1 << 40)
        now = tuple(known.agg(F.count_if(F.col("c") >= least), F.sum(mark)).first())
        if now == seen:
            break
        seen = now
    taken = known.where(F.col("c") >= least).select("instance", "kind")
    hits = mentions.where("base is null").join(taken, ["instance", "kind"])
    # Of a chain and its words, where both are taken, the chain stays.
    chains = hits.where("whole").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), F.col("piece").alias("at")).distinct()
    of_chain = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")) & (F.col("piece") == F.col("at"))
    alone = hits.where("not whole").join(chains, of_chain, "left_anti")
    return hits.where("whole").unionByName(alone).select("doc_id", "text_hash", "kind", "start", "end")


def _text(spans: Column) -> Column:
    """kind:start:end, comma-joined, of an array of (order, start, end)."""
    names = F.array(*(F.lit(k) for k in KINDS))
    one = lambda s: F.concat_ws(":", F.element_at(names, s["o"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def find(docs: DataFrame, support: int = 5, least: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_discovered for each row of docs."""
    found = cut(base_entities(docs, id_col, text_col))
    order = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind")).cast("int") - 1
    more = discovered(found, support, least).groupBy("doc_id", "text_hash")
    more = more.agg(F.collect_set(F.struct(order.alias("o"), "start", "end")).alias("more"))
    more = more.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "more")
    joined = found.join(more, found.doc_id.eqNullSafe(F.col("id")) & (found.text_hash == F.col("hash")), "left")
    place = lambda o, k: F.transform(k, lambda s: F.struct(F.lit(o).alias("o"), s["start"].alias("start"), s["end"].alias("end")))
    base = F.concat(*(place(o, F.col(k)) for o, k in enumerate(KINDS)))
    more = F.coalesce("more", F.array().cast("array<struct<o:int,start:bigint,end:bigint>>"))
    return joined.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(_text(base), 256).alias("base_sha256"),
        _text(F.concat(base, more)).alias("spans"),
        F.size(more).cast("long").alias("n_discovered"),
    )
