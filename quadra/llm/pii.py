"""Personal data: base patterns and bootstrapped contextual extraction, in DataFrame operations only.

Base spans (email, ip, card, phone) are leftmost non-overlapping matches per kind that pass their test. Seed entities
are these and secrets (tokens of 20 and more letters and digits, four of each at least). Every seed entity induces
lexical patterns: the word before it and the word after it, whatever the entity looks like. Spark then scores the graph
of patterns and instances, where an instance is any token with a digit, in rounds:

* A pattern's confidence is the sum of the scores of its distinct instances over all that it stands beside: its
  distinct instances, and every occurrence of its word beside something that is no instance. A common word is beside
  ordinary words nearly always, so its confidence is near zero. One failure is added.
* A pattern is trusted if its confidence is ``confidence`` at least and ``least_seeds`` of its distinct instances are sure.
* An instance's score is the chance that one of its trusted patterns is right; seeds stay at 1. Instances of score
  ``SURE`` and more are promoted: they support patterns in the next round as seeds do, also patterns no seed has.

Rounds end when the scores stay as they are, or after ``rounds``. Instances beside a trusted pattern are discovered:
their spans have the kind "context", unless they touch a base span. Secrets are discovered in no other way.

Positions are code points, ends exclusive. Regular expressions are possessive or begin at a run's start, so they take
linear time and constant stack on any text; each stands for the plain pattern in ``BASE_PATTERNS``. No word, token
or text is bounded in length.

Defined results: a null text is empty and has no spans; repeated rows each get their row; spans that touch or
overlap across kinds all stay, ordered by start, then kind. Extra columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadra.llm.documents import table
from quadra.llm.store import Workspace

KINDS = ("email", "ip", "card", "phone")
#: What the base kinds mean, as plain patterns (tests hold the ones below against these).
BASE_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_FAST = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Between words: blanks, quotes, brackets and the marks that join a name to its value.
_GAP = r"\x20\x09-\x0D\"'`=:;,|()\[\]{}<>"
_WORD = rf"[^{_GAP}]"
#: A word with a digit.
_TOKEN = rf"(?:\G|(?<!{_WORD}))[^{_GAP}0-9]*+[0-9]{_WORD}*+"
#: The word beside one, after the rest of that one.
_BESIDE = rf"^{_WORD}*+[{_GAP}]++({_WORD}*+)"
#: Score from which an instance is promoted.
SURE = 0.8
#: A token that is a seed without being personal data of a base kind.
SECRET = r"^(?=(?:[0-9]*+[A-Za-z]){4})(?=(?:[A-Za-z]*+[0-9]){4})[0-9A-Za-z]{20,}+$"
SPANS = "array<struct<start:int,end:int,hit:string,left:string,right:string>>"
#: Matches that one inner fold appends.
_CHUNK = 256
_OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def _may_hold(text: Column, kind: str) -> Column:
    """A cheap necessary condition."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    return text.rlike("[0-9]")


def _passes(hit: Column, kind: str) -> Column:
    if kind == "ip":
        return hit.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$")
    if kind == "card":
        digits = F.regexp_replace(hit, "[ -]", "")
        return F.length(digits).between(14, 19) & (_luhn(F.substring(digits, 1, 19)) % 10 == 0)
    if kind == "phone":
        return F.length(F.regexp_replace(hit, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substr(back, i, F.lit(1))) - 48
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add)


def _fold(n: Column, begin: Column, kind: str, step) -> Column:
    """Values of ``step`` over 0 to n - 1, flat. Chunks keep appending to arrays cheap."""

    def chunk(state: Column, c: Column) -> Column:
        inner = F.struct(state["at"].alias("at"), state["near"].alias("near"), F.array().cast(kind).alias("out"))
        done = F.aggregate(F.sequence(c * _CHUNK, F.least((c + 1) * _CHUNK, n) - 1), inner, lambda s, i: step(s, i))
        return F.struct(done["at"].alias("at"), done["near"].alias("near"), F.concat(state["out"], F.array(done["out"])).alias("out"))

    begin = F.struct(begin.alias("at"), F.lit(" ").alias("near"), F.array().cast(f"array<{kind}>").alias("out"))
    return F.flatten(F.aggregate(F.sequence(F.lit(0), F.floor((n - 1) / _CHUNK).cast("int")), begin, chunk)["out"])


def _find(df: DataFrame, text: str, name: str, pattern: str, may: Column) -> DataFrame:
    """Adds ``name``: array of (start, end, hit, left, right) of the pattern's matches.

    ``left`` and ``right`` are the whole words beside the one that a match begins or ends in.
    """
    none = F.array().cast("array<string>")
    hits, gaps, rights = f"_{name}_hits", f"_{name}_gaps", f"_{name}_rights"
    df = df.withColumns({
        hits: F.when(may, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).otherwise(none),
    }).withColumn(gaps, F.when(F.size(hits) > 0, F.split(F.col(text), pattern, -1)).otherwise(none))
    n = F.size(hits)
    # text is gap, hit, gap, hit, ...: folds sum the lengths and carry the last two words; the left ones reversed
    beside = lambda x: F.regexp_extract(x, _BESIDE, 1)
    carried = lambda x: F.regexp_extract(x, _BESIDE, 0)

    def back(state: Column, k: Column) -> Column:
        i = n - 1 - k
        after = F.concat(F.get(F.col(gaps), i + 1), state["near"])
        return F.struct(state["at"].alias("at"), carried(F.concat(F.get(F.col(hits), i), after)).alias("near"), F.concat(state["out"], F.array(beside(after))).alias("out"))

    def forth(state: Column, i: Column) -> Column:
        hit, gap = F.get(F.col(hits), i), F.get(F.col(gaps), i)
        start = state["at"] + F.length(gap)
        before = F.concat(F.reverse(gap), state["near"])
        span = F.struct(start.alias("start"), (start + F.length(hit)).alias("end"), hit.alias("hit"), F.reverse(beside(before)).alias("left"), F.get(F.col(rights), n - 1 - i).alias("right"))
        return F.struct((start + F.length(hit)).alias("at"), carried(F.concat(F.reverse(hit), before)).alias("near"), F.concat(state["out"], F.array(span)).alias("out"))

    df = df.withColumn(rights, F.when(n > 0, _fold(n, F.lit(0), "array<string>", back)).otherwise(none))
    return df.withColumn(name, F.when(n > 0, _fold(n, F.lit(0), SPANS, forth)).otherwise(F.array().cast(SPANS))).drop(hits, gaps, rights)


def _base_and_instances(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Per row: row, doc_id, base spans, and instances (seeds and tokens with a digit) with the words beside them."""
    df = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    failed = {}
    for kind in KINDS:
        df = _find(df, "text", kind, _FAST[kind], _may_hold(F.col("text"), kind))
        # what fails the test is an instance; without blanks it is part of a token
        failed[kind] = F.filter(kind, lambda x: F.contains(x["hit"], F.lit(" ")) & ~_passes(x["hit"], kind)) if kind in ("card", "phone") else F.array().cast(SPANS)
        df = df.withColumns({f"{kind}_failed": failed[kind], kind: F.filter(kind, lambda x: _passes(x["hit"], kind))})
    df = _find(df, "text", "token", _TOKEN, F.col("text").rlike("[0-9]"))
    base = F.concat(*[F.transform(kind, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end"))) for k, kind in enumerate(KINDS)])
    df = df.withColumn("base", F.array_sort(base))

    def core(hit: Column) -> Column:
        return F.regexp_extract(hit, r"(?s)^[^A-Za-z0-9]*+(.*[A-Za-z0-9])", 1)

    def trimmed(x: Column) -> Column:
        lead = F.length(x["hit"]) - F.length(F.regexp_replace(x["hit"], r"^[^A-Za-z0-9]++", ""))
        return F.struct((x["start"] + lead).alias("start"), (x["start"] + lead + F.length(core(x["hit"]))).alias("end"), core(x["hit"]).alias("hit"), x["left"].alias("left"), x["right"].alias("right"))

    df = df.withColumn("token", F.transform(F.concat("token", "card_failed", "phone_failed"), trimmed))
    df = _apart(df, "token", "base")

    def instance(x: Column, seed: Column, new: bool) -> Column:
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), core(x["hit"]).alias("value"), F.lower(x["left"]).alias("left"), F.lower(x["right"]).alias("right"), seed.alias("seed"), F.lit(new).alias("new"))

    found = F.concat(*[F.transform(kind, lambda x: instance(x, F.lit(True), False)) for kind in KINDS], F.transform("token", lambda x: instance(x, x["hit"].rlike(SECRET), True)))
    return df.select("row", "doc_id", "base", found.alias("found"))


def _apart(df: DataFrame, name: str, base: str) -> DataFrame:
    """``name`` without the spans that overlap one of ``base``: one walk by start each way, so it takes linear time."""
    events = f"_{name}_events"

    def walk(df: DataFrame, back: bool) -> DataFrame:
        none = F.lit(None).cast(SPANS[len("array<") : -1])
        both = F.concat(F.transform(base, lambda x: F.struct(x["start"].alias("s"), F.lit(0).alias("t"), x["end"].alias("e"), none.alias("x"))), F.transform(name, lambda x: F.struct(x["start"].alias("s"), F.lit(1).alias("t"), x["end"].alias("e"), x.alias("x"))))
        df = df.withColumn(events, F.when((F.size(base) > 0) & (F.size(name) > 0), F.array_sort(both)))
        n = F.size(events)

        def step(state: Column, k: Column) -> Column:
            e = F.get(F.col(events), n - 1 - k if back else k)
            # ahead: the largest end before; back: the least start behind
            meets = state["at"] < e["e"] if back else state["at"] > e["s"]
            at = F.when(e["t"] == 1, state["at"]).otherwise(e["s"] if back else F.greatest(state["at"], e["e"]))
            return F.struct(at.alias("at"), state["near"].alias("near"), F.concat(state["out"], F.when((e["t"] == 1) & ~meets, F.array(e["x"])).otherwise(F.array().cast(SPANS))).alias("out"))

        kept = _fold(n, F.lit(2**31 - 1 if back else -1), SPANS, step)
        return df.withColumn(name, F.when(F.col(events).isNull(), F.col(name)).otherwise(kept)).drop(events)

    return walk(walk(df, False), True)


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): how often each word stands in all texts, lower-cased; combined before the shuffle."""
    words = docs.select(F.explode(F.split(F.col(text), f"[{_GAP}]+")).alias("w")).where("w <> ''")
    return words.groupBy(F.lower("w").alias("word")).agg(F.count(F.lit(1)).alias("n"))


def trusted_patterns(edges: DataFrame, words: DataFrame, space: Workspace, confidence: float = 0.6, rounds: int = 4, least_seeds: int = 3) -> DataFrame:
    """(pattern, confidence, support) of the trusted patterns of ``edges``, distinct (pattern, value, seed, n: occurrences).

    Sums per pattern and per value are combined before they are shuffled; joins are merge joins at every size, as no
    side has a bound, and Spark splits hot keys.
    """
    if rounds < 1:
        raise ValueError("rounds must be positive")
    of = edges.groupBy("pattern").agg(F.sum("n").alias("_n")).withColumn("word", F.substr("pattern", F.lit(3)))
    beside = of.join(words.hint("merge"), "word").select("pattern", F.greatest(F.col("n") - F.col("_n"), F.lit(0)).alias("bad"))
    beside = space.keep(beside, "beside")
    scores = space.keep(edges.where("seed").select("value", F.lit(1.0).alias("score")).distinct(), "scores")
    total = float(scores.count())
    for r in range(rounds):
        by = edges.select("pattern", "value").join(scores.hint("merge"), "value", "left")
        sums = by.groupBy("pattern").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("sum"), F.count(F.lit(1)).alias("all"), F.count_if(F.col("score") >= SURE).alias("support"))
        sums = sums.where(F.col("support") >= least_seeds).join(beside.hint("merge"), "pattern")
        sums = sums.select("pattern", (F.col("sum") / (F.col("all") + F.col("bad") + 1)).alias("confidence"), "support")
        trusted = space.keep(sums.where(F.col("confidence") >= confidence), f"trusted{r}")
        if r == rounds - 1:
            break
        lent = edges.join(trusted.hint("merge"), "pattern").groupBy("value").agg(F.sum(F.log(1 - F.least("confidence", F.lit(0.999)))).alias("miss"))
        seeds = edges.where("seed").select(F.col("value").alias("v")).distinct()
        both = lent.join(seeds.hint("merge"), F.col("value") == F.col("v"), "full")
        old = scores
        scores = space.keep(both.select(F.coalesce("v", "value").alias("value"), F.when(F.col("v").isNotNull(), 1.0).otherwise(1 - F.exp("miss")).alias("score")), f"scores{r}")
        space.drop(old)
        now = scores.agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0]
        if abs(now - total) <= 1e-9 * total:
            break
        total = now
    return trusted


def personal_data(docs: DataFrame, text: str = "text", key: str = "doc_id", confidence: float = 0.6, rounds: int = 4, least_seeds: int = 3) -> DataFrame:
    """Per row: doc_id, base and all spans as arrays of (start, kind, end), kind 4 standing for "context"."""
    space = Workspace(docs.sparkSession, "pii")
    rows = space.keep(_base_and_instances(docs, text, key), "rows")
    x = rows.where(F.size("found") > 0).select("row", F.explode("found").alias("x")).select("row", "x.*")
    both = F.filter(F.array(F.when(F.col("left") != "", F.concat(F.lit("L|"), "left")), F.when(F.col("right") != "", F.concat(F.lit("R|"), "right"))), lambda p: p.isNotNull())
    uses = x.withColumn("pattern", F.explode(both))
    edges = space.keep(uses.groupBy("pattern", "value").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("n")), "edges")
    good = trusted_patterns(edges, word_counts(docs, text), space, confidence, rounds, least_seeds).select("pattern")
    new = uses.where("new").join(good.hint("merge"), "pattern", "left_semi")
    new = new.groupBy("row").agg(F.collect_set(F.struct("start", F.lit(4).alias("kind"), "end")).alias("new"))
    out = rows.select("row", "doc_id", "base").join(new.hint("merge"), "row", "left")
    return out.select("doc_id", "base", F.when(F.col("new").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "new"))).alias("spans"))


def _written(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, "context")])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    n_spans = F.size("spans").cast("long")
    return found.select("doc_id", *counts, F.sha2(_written("base").cast("binary"), 256).alias("base_sha256"), _written("spans").alias("spans"), (n_spans - F.size("base")).alias("n_context"), n_spans.alias("n_spans"))


QUERY = ("op4_pii", op4_pii)
#: DuckDB has no match positions and no iteration over scores; tests use a brute-force version.
ORACLE = None
