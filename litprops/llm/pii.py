"""Personal data: fixed patterns, and more of the same kinds learned from the contexts in which those stand. DataFrame functions only.

Base entities (fixed values of the contract): e-mail, IP address, card number (Luhn) and phone number, leftmost and without overlap per kind.
Bootstrapped contextual extraction then looks for identifiers that the fixed patterns do not match ("call 555 0199", "mail to joe@intranet"):

1. Candidates are words with an ASCII digit or ``@``, together with following words of digits and separators, at most :data:`LONGEST` characters
   without the punctuation round them. A candidate has the kinds whose loose form it has. One that holds a base entity is a seed of its kind.
2. Patterns are the word before and the two words before a candidate, lower-cased, with digits alike. They look back :data:`LOOK_BACK` characters.
3. The graph of patterns and instances (distinct candidates) is scored in rounds. A pattern's reliability is ``(known + unknown / 2) / (all + 1)``:
   occurrences before known instances, occurrences before others weighted by their score, and all its occurrences in the corpus, whatever
   follows. It counts from :data:`MIN_SEEDS` different known instances and :data:`MIN_RELIABILITY` on. An instance's score is the probability that not
   all its patterns err. From :data:`PROMOTE` on it is known, and its contexts induce patterns in the next round.
4. Occurrences of promoted instances in a reliable pattern, where no base entity overlaps, are added.

Patterns and instances are table rows; every step is an aggregate with partial sums or a join. Only rows that hold candidates reach the graph.

Defined results: a null or empty text has no spans; a null id is kept; repeated rows each give a row; other columns are ignored; an empty
table gives an empty table. An occurrence with several kinds gets that of the highest score, then the first as listed.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litprops.llm.store import Scratch, only_ids

KINDS = ["email", "ip", "card", "phone"]
#: The base patterns. Possessive quantifiers and looks behind change no match; they keep the time linear in the text.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match of the kind.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Loose forms of identifiers that may be learned.
FORMS = {
    "email": r"^[^@\x20]+@[^@\x20]+$",
    "ip": r"^[0-9]{1,3}(?:[.:][0-9]{1,3}){3}(?:[/:][0-9]+)?$",
    "card": r"^(?:[0-9][\x20./-]*){12,19}$",
    "phone": r"^[+(]*(?:[0-9][\x20()./-]*){7,15}$",
}
SPACE = r"\x20\x09-\x0D"
CANDIDATE = rf"(?<![^{SPACE}])(?=[^{SPACE}0-9@]*+[0-9@])[^{SPACE}]++(?:\x20[0-9()+./-]++(?![^{SPACE}]))*+"
#: Punctuation round a candidate.
OPENS, CLOSES = r"^[(\[{\x22'<]++", r"(?<![.,;:!?)\]}\x22'>])[.,;:!?)\]}\x22'>]++$"
LONGEST, LOOK_BACK = 64, 64
MIN_SEEDS, MIN_RELIABILITY, PROMOTE, ROUNDS = 3, 0.6, 0.8, 4
_BLOCK = 256
SPANS = "array<struct<start:int,order:int,kind:string,end:int>>"


def _luhn(digits: Column) -> Column:
    """Luhn's check of a text of digits."""
    n = F.length(digits)

    def worth(k):
        d = F.substr(digits, n - k, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(k % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, k: acc + worth(k)) % 10 == 0


def passes(kind: str, found: Column) -> Column:
    """Whether a match of a base pattern is an entity."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _matched(text: Column, pattern: str, needs: str | None) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(F.contains(text, F.lit(needs)), found).otherwise(F.array().cast("array<string>")) if needs else found


def _between(text: Column, found: Column, pattern: str) -> Column:
    """What stands before each match, and after the last; empty without a match."""
    return F.when(F.size(found) > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>"))


def _sums_before(sizes: Column) -> Column:
    """For each number of an array the sum of those before it, in blocks, so that long arrays take no quadratic time."""
    empty = F.array().cast("array<int>")

    def scan(numbers):
        start = F.struct(F.lit(0).alias("total"), empty.alias("out"))
        return F.aggregate(numbers, start, lambda acc, x: F.struct((acc["total"] + x).alias("total"), F.concat(acc["out"], F.array(acc["total"])).alias("out")))

    blocks = F.transform(F.sequence(F.lit(0), ((F.size(sizes) - 1) / _BLOCK).cast("int")), lambda b: scan(F.slice(sizes, b * _BLOCK + 1, _BLOCK)))
    offsets = scan(F.transform(blocks, lambda b: b["total"]))["out"]
    return F.when(F.size(sizes) > 0, F.flatten(F.zip_with(blocks, offsets, lambda b, o: F.transform(b["out"], lambda x: x + o)))).otherwise(empty)


def _starts(found: Column, between: Column) -> Column:
    """Code points before each match."""
    ahead = F.transform(F.slice(between, F.lit(1), F.size(found)), F.length)
    steps = F.zip_with(found, ahead, lambda f, n: F.length(f) + n)
    return F.zip_with(_sums_before(steps), ahead, lambda s, n: s + n)


def _normal(text: Column) -> Column:
    return F.translate(F.lower(text), "123456789", "000000000")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"[^{SPACE}]+"), F.lit(0))


def _patterns(words: Column, last: Column) -> Column:
    """The one and two words that end at place ``last`` (from 1) of ``words``, as keys."""
    one, two = F.get(words, last - 1), F.get(words, last - 2)
    return F.filter(F.array(F.when(one.isNotNull(), F.xxhash64(F.lit(1), one)), F.when(one.isNotNull() & two.isNotNull(), F.xxhash64(F.lit(2), two, one))), F.isnotnull)


def base_entities(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id, key, base, candidates`` of every row, written to the shared folder; ``key`` names rows of equal id and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("key", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "text")))
    kinds = [*((k, PATTERNS[k], NEEDS[k]) for k in KINDS), ("any", CANDIDATE, None)]
    rows = rows.withColumns({f"f_{k}": _matched(F.col("text"), p, needs) for k, p, needs in kinds})
    rows = rows.withColumns({f"b_{k}": _between(F.col("text"), F.col(f"f_{k}"), p) for k, p, _ in kinds}).drop("text")
    rows = rows.withColumns({f"s_{k}": _starts(F.col(f"f_{k}"), F.col(f"b_{k}")) for k, _, _ in kinds})

    def entities(order, kind):
        placed = F.arrays_zip(F.col(f"f_{kind}").alias("f"), F.col(f"s_{kind}").alias("s"))
        span = lambda x: F.struct(x["s"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), (x["s"] + F.length(x["f"])).alias("end"))
        return F.transform(F.filter(placed, lambda x: passes(kind, x["f"])), span)

    base = F.array_sort(F.concat(*(entities(i, k) for i, k in enumerate(KINDS))))
    # what stands before a candidate, also across the candidate before it
    earlier = F.concat(F.array(F.lit("")), F.col("f_any"))
    ahead = F.zip_with(F.slice("b_any", F.lit(1), F.size("f_any")), F.slice(earlier, F.lit(1), F.size("f_any")), lambda b, f: F.right(F.concat(f, b), F.lit(LOOK_BACK)))
    placed = F.arrays_zip(F.col("f_any").alias("f"), F.col("s_any").alias("s"), F.transform(ahead, lambda a: _words(_normal(a))).alias("w"))
    opened = lambda x: F.regexp_replace(x["f"], OPENS, "")
    trimmed = lambda x: F.struct(
        (x["s"] + F.length(x["f"]) - F.length(opened(x))).alias("start"), F.regexp_replace(opened(x), CLOSES, "").alias("found"), _patterns(x["w"], F.size(x["w"])).alias("patterns")
    )
    rows = rows.select("doc_id", "key", base.alias("base"), F.transform(placed, trimmed).alias("trimmed"))

    def described(x):
        found = x["found"]
        known = F.filter(F.array(*(F.when(F.exists(_matched(found, PATTERNS[k], NEEDS[k]), partial(passes, k)), F.lit(k)) for k in KINDS)), F.isnotnull)
        loose = F.filter(F.array(*(F.when(found.rlike(FORMS[k]), F.lit(k)) for k in KINDS)), F.isnotnull)
        return F.struct(x["start"].alias("start"), (x["start"] + F.length(found)).alias("end"), F.lower(found).alias("instance"), x["patterns"].alias("patterns"), known.alias("known"), loose.alias("loose"))

    short = F.filter("trimmed", lambda x: (F.length(x["found"]) > 0) & (F.length(x["found"]) <= LONGEST))
    rows = rows.select("doc_id", "key", "base", F.transform(short, described).alias("candidates"))
    kept = F.filter("candidates", lambda c: (F.size(c["patterns"]) > 0) & (F.size(F.concat(c["known"], c["loose"])) > 0))
    return scratch.put(rows.withColumn("candidates", kept), "found")


def _occurrences(found: DataFrame) -> DataFrame:
    """One row per candidate, kind and pattern. A candidate that holds base entities is of their kinds alone."""
    rows = found.select("key", "base", F.inline("candidates"))
    rows = rows.withColumn("seed", F.size("known") > 0).withColumn("kind", F.explode(F.when(F.size("known") > 0, F.col("known")).otherwise(F.col("loose"))))
    return rows.select("key", "base", "start", "end", "instance", "kind", "seed", F.explode("patterns").alias("pattern"))


def pattern_totals(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """``pattern, total``: how often each of ``patterns`` is followed by a word, in all texts."""
    words = docs.select(_words(_normal(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("w"))
    keys = words.filter(F.size("w") > 1).select(F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: _patterns(F.col("w"), i)))).alias("pattern"))
    return only_ids(keys, patterns, "pattern").groupBy("pattern").agg(F.count("*").alias("total"))


def score_graph(edges: DataFrame, totals: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Reliable patterns ``kind, pattern, reliability`` and instances ``kind, instance, known, score``, after the last round."""
    state = edges.groupBy("kind", "instance").agg(F.max("seed").alias("known")).withColumn("score", F.col("known").cast("double"))
    state = scratch.put(state, "instances-0")
    marked, reliable = state.agg(F.count_if("known")).first()[0], None
    for k in range(ROUNDS):
        told = edges.join(state, ["kind", "instance"]).groupBy("kind", "pattern").agg(
            F.count_if("known").alias("seeds"), F.sum(F.when(F.col("known"), F.col("n")).otherwise(F.col("n") * F.col("score") / 2)).alias("weight")
        )
        told = told.filter(F.col("seeds") >= MIN_SEEDS).join(totals, "pattern")
        told = told.select("kind", "pattern", F.least(F.col("weight") / (F.col("total") + 1), F.lit(0.999)).alias("reliability")).filter(F.col("reliability") >= MIN_RELIABILITY)
        reliable = scratch.put(told, f"patterns-{k}")
        scores = edges.join(reliable, ["kind", "pattern"]).groupBy("kind", "instance").agg((1 - F.exp(F.sum(F.log1p(-F.col("reliability"))))).alias("now"))
        state = state.join(scores, ["kind", "instance"], "left").select(
            "kind", "instance", (F.col("known") | (F.coalesce("now", F.lit(0.0)) >= PROMOTE)).alias("known"), F.coalesce("now", F.lit(0.0)).alias("score")
        )
        state = scratch.put(state, f"instances-{k + 1}")
        before, marked = marked, state.agg(F.count_if("known")).first()[0]
        if marked == before:
            break
    return reliable, state


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, base, learned`` for every row: arrays of ``start, order, kind, end`` (code points, end exclusive) by start and kind."""
    scratch = Scratch(docs.sparkSession, "pii")
    found = base_entities(docs, scratch)
    seen = _occurrences(found)
    edges = scratch.put(seen.groupBy("kind", "pattern", "instance").agg(F.count("*").alias("n"), F.max("seed").alias("seed")), "edges")
    often = edges.groupBy("kind", "pattern").agg(F.count("*").alias("instances"), F.count_if("seed").alias("seeds")).filter(F.col("instances") >= MIN_SEEDS)
    often = scratch.put(often.select("pattern").distinct(), "often")
    totals = scratch.put(pattern_totals(docs, often), "totals")
    reliable, instances = score_graph(edges, totals, scratch)
    good = seen.filter("not seed").join(reliable.select("kind", "pattern"), ["kind", "pattern"]).join(instances.filter("known").select("kind", "instance", "score"), ["kind", "instance"])
    good = good.filter(~F.exists("base", lambda b: (b["start"] < F.col("end")) & (F.col("start") < b["end"])))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    best = F.min(F.struct((-F.col("score")).alias("s"), order.alias("order"), "kind", "end")).alias("best")
    added = good.groupBy("key", "start").agg(best).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "best.order", "best.kind", "best.end"))).alias("learned"))
    out = found.select("doc_id", "key", "base").join(scratch.put(added, "added"), "key", "left")
    return out.select("doc_id", F.col("base").cast(SPANS).alias("base"), F.coalesce(F.col("learned").cast(SPANS), F.array().cast(SPANS)).alias("learned"))
