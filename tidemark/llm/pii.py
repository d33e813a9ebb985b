"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

The base patterns find the seeds: e-mail addresses, IPv4 addresses, card numbers
that pass Luhn's test, and phone numbers with a country code. The runs of one to
LENGTH tokens beside a seed, on either side, are its lexical patterns, and they
are counted by the tokens that make them. Broad shapes (LOOSE) give candidates,
which are no finding of themselves. Spark then scores the graph of patterns and instances:

* a pattern (kind, side, word) scores the summed scores of its instances over
  all occurrences of its tokens in the corpus, so that a common word that happens
  to stand before an address scores next to nothing; a pattern needs SUPPORT
  distinct instances of score ACCEPT or more;
* a seed scores 1, a candidate one minus the product of (1 - score) over the
  patterns it occurs with; what round n accepts supports the patterns of n + 1.

After ROUNDS rounds the candidates that score ACCEPT or more are added where
they occur. Base spans always stay, and no candidate that overlaps one is taken.

Positions are code points. The base expressions are written with possessive
quantifiers and anchored at the start of a run, which changes no match but
keeps long runs of word characters or digits linear.

Defined results: a null text counts as empty and has no span; repeated rows are
all returned; a null doc_id is passed through; an empty table gives an empty
result. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import store, text_of

KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?i)(?<![A-Z0-9._%+-])[A-Z0-9._%+-]++ ?(?:@|[(\[{<]at[)\]}>]|(?<= )at(?= )) ?[A-Z0-9-]++(?: ?(?:\.|[(\[{<]dot[)\]}>]|(?<= )dot(?= )) ?[A-Z0-9-]++)++",
    "ip": r"(?i)(?<![0-9A-Z:])(?:[0-9A-F]{1,4}|(?=::))(?::{1,2}[0-9A-F]{1,4}){0,7}(?:::|(?<=:[0-9A-F]{1,4}))(?![0-9A-Z])",
    "card": r"(?<![0-9])[0-9](?:[ ./_-]{0,2}[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?<![0-9][ ()./-]{1,2})\(?[0-9](?:[ ()./-]{0,2}[0-9]){6,14}(?![0-9A-Za-z])(?![ ()./-]{1,2}[0-9])",
}
#: A token of context: letters, digits, or one other character that is no white space.
TOKEN = r"[\p{L}\p{M}_]+|\p{N}+|[^\p{L}\p{M}\p{N}_\x20\x09-\x0D]"
#: The most tokens in a pattern.
LENGTH = 3
#: Characters of context that are looked at on either side of a match.
CONTEXT = 64
SUPPORT = 3
ACCEPT = 0.8
ROUNDS = 3
SPAN = "struct<kind:string,start:int,stop:int>"
FOUND = "array<struct<start:int,stop:int,value:string,before:string,after:string>>"


def _luhn(digits: Column) -> Column:
    places = F.sequence(F.lit(1), F.length(digits))

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(F.reverse(digits), i, 1).cast("int")
        double = digit * 2
        return total + F.when(i % 2 == 1, digit).when(double > 9, double - 9).otherwise(double)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        plain = lambda part: F.regexp_replace(part, "^0+(?=[0-9])", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(plain(p)) <= 3) & (plain(p).try_cast("int") <= 255))
    if kind == "card":
        digits = F.translate(value, " -", "")
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def _loosely_valid(kind: str, value: Column) -> Column:
    if kind == "card":
        return _luhn(F.regexp_replace(value, "[^0-9]", ""))
    if kind == "ip":
        pairs, groups = F.size(F.split(value, "::")) - 1, F.size(F.regexp_extract_all(value, F.lit("(?i)[0-9a-f]+"), F.lit(0)))
        return ((pairs == 1) & (groups <= 7)) | ((pairs == 0) & (groups == 8))
    return F.lit(True)


def _walk(found: str, between: str) -> Column:
    """Matches with their positions and surroundings, from the matches and the text between them."""

    def step(acc: Column, i: Column) -> Column:
        value, gap = F.get(F.col(found), i), F.get(F.col(between), i)
        start = acc["stop"] + F.length(gap)
        stop = start + F.length(value)
        item = F.struct(
            start.alias("start"),
            stop.alias("stop"),
            value.alias("value"),
            F.substring(gap, F.lit(-CONTEXT), F.lit(CONTEXT)).alias("before"),
            F.substring(F.get(F.col(between), i + 1), 1, CONTEXT).alias("after"),
        )
        return F.struct(stop.alias("stop"), F.concat(acc["out"], F.array(item)).alias("out"))

    zero = F.struct(F.lit(0).alias("stop"), F.from_json(F.lit("[]"), FOUND).alias("out"))
    walked = F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), zero, step, lambda acc: acc["out"])
    return F.when(F.size(found) > 0, walked).otherwise(F.from_json(F.lit("[]"), FOUND))


def _scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, and per kind the arrays base_<kind> and loose_<kind> of matches."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    digit, at = F.col("text").rlike("[0-9]"), F.contains(F.col("text"), F.lit("@"))
    may = {"email": at, "ip": digit, "card": digit, "phone": digit & F.contains(F.col("text"), F.lit("+"))}
    may_loosely = {"email": at | F.col("text").rlike(r"(?i)[(\[{< ]at[)\]}> ]"), "ip": F.contains(F.col("text"), F.lit(":")), "card": digit, "phone": digit}
    names = [(f"{name}_{kind}", table[kind], test[kind]) for name, table, test in (("base", BASE, may), ("loose", LOOSE, may_loosely)) for kind in KINDS]
    none = F.array().cast("array<string>")
    found = rows.select("*", *(F.when(m, F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none).alias(n) for n, p, m in names))
    between = found.select("*", *(F.when(F.size(n) > 0, F.split("text", p, -1)).otherwise(none).alias(f"{n}_gaps") for n, p, _ in names))
    walked = between.select("doc_id", *(_walk(n, f"{n}_gaps").alias(n) for n, _, _ in names))

    def valid(prefix: str, test: Callable[[str, Column], Column], kind: str) -> Column:
        return F.filter(f"{prefix}_{kind}", lambda x: test(kind, x["value"])).alias(f"{prefix}_{kind}")

    checked = [valid(*t, kind) for t in (("base", _valid), ("loose", _loosely_valid)) for kind in KINDS]
    return walked.select("doc_id", *checked, F.monotonically_increasing_id().alias("row"))


def _spans(prefix: str) -> Column:
    """All matches of the four columns with this prefix, kind by kind."""

    def of(kind: str) -> Column:
        return F.transform(f"{prefix}_{kind}", lambda x: F.struct(F.lit(kind).alias("kind"), *(x[f].alias(f) for f in ("start", "stop", "value", "before", "after"))))

    return F.concat(*(of(kind) for kind in KINDS))


def _occurrences(scanned: DataFrame) -> DataFrame:
    """row, kind, start, stop, value, seed, and the patterns (side, word) beside each seed and candidate."""
    columns = ["row", *(f"{p}_{k}" for p in ("base", "loose") for k in KINDS)]
    rows = scanned.select(*columns).where(" + ".join(f"size({c})" for c in columns[1:]) + " > 0")
    both = rows.select("row", _spans("base").alias("base"), _spans("loose").alias("loose"))
    seeds = both.select("row", F.explode("base").alias("x"), F.lit(True).alias("seed"))
    fresh = F.filter("loose", lambda x: ~F.exists("base", lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"])))
    candidates = both.select("row", F.explode(fresh).alias("x"), F.lit(False).alias("seed"))
    whole = F.when(F.length("x.before") == CONTEXT, F.regexp_replace("x.before", rf"^(?:{TOKEN})", "")).otherwise(F.col("x.before"))
    end = F.when(F.length("x.after") == CONTEXT, F.regexp_replace("x.after", rf"(?:{TOKEN})$", "")).otherwise(F.col("x.after"))
    tokens = lambda text: F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    sides = {"left": lambda k: F.slice(F.reverse("before"), 1, k), "right": lambda k: F.slice("after", 1, k)}

    def pattern(side: str, k: int) -> Column:
        some = F.reverse(sides[side](k)) if side == "left" else sides[side](k)
        return F.struct(F.lit(side).alias("side"), F.when(F.size(some) == k, F.array_join(some, " ")).otherwise("").alias("word"))

    beside = F.array(*(pattern(side, k) for side in sides for k in range(1, LENGTH + 1)))
    every = seeds.union(candidates).select(
        "row", "x.kind", "x.start", "x.stop", F.lower("x.value").alias("value"), "seed", tokens(F.lower(whole)).alias("before"), tokens(F.lower(end)).alias("after")
    )
    return every.select("row", "kind", "start", "stop", "value", "seed", beside.alias("beside"))


def _totals(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """How often each wanted run of tokens occurs in the whole corpus."""
    tokens = docs.select(F.regexp_extract_all(F.lower(text_of(text_col)), F.lit(TOKEN), F.lit(0)).alias("tokens"))
    size = F.size("tokens")

    def runs(k: int) -> Column:
        """All runs of ``k`` tokens, none if there are fewer."""
        run = F.transform(F.sequence(F.lit(0), size - k), lambda i: F.concat_ws(" ", *(F.get("tokens", i + j) for j in range(k))))
        return F.when(size >= k, run).otherwise(F.array().cast("array<string>"))

    # One pass: a filter on the tokens, or a pass for each length, would cut every text again. No token holds a space,
    # so that a run is told from those of other lengths by its text alone.
    every = tokens.select(F.explode(F.concat("tokens", *(runs(k) for k in range(2, LENGTH + 1)))).alias("word"))
    found = every.join(wanted, "word", "left_semi")
    return found.groupBy("word").agg(F.count("*").alias("total"))


def _accepted(occurrences: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """(kind, value) of the candidates that the patterns vouch for."""
    edges = occurrences.select("kind", "value", "seed", F.explode("beside").alias("b")).where("b.word <> ''")
    edges = store(edges.groupBy("kind", "value", "b.side", "b.word").agg(F.max("seed").alias("seed"), F.count("*").alias("n")), "edges")
    # A pattern of fewer instances never scores.
    often = edges.groupBy("kind", "side", "word").agg(F.count("*").alias("values")).where(F.col("values") >= SUPPORT)
    wanted = store(often.select("word", F.size(F.split("word", " ")).alias("length")).distinct(), "wanted")
    edges = store(edges.join(_totals(docs, text_col, wanted), "word", "left"), "edges")
    scores = edges.groupBy("kind", "value").agg(F.max(F.col("seed").cast("double")).alias("score"))
    for _ in range(ROUNDS):
        strong = F.count(F.when(F.col("score") >= ACCEPT, 1))
        patterns = (
            edges.join(scores, ["kind", "value"])
            .groupBy("kind", "side", "word")
            .agg(F.least(F.lit(0.999), F.sum(F.col("score") * F.col("n")) / F.greatest(F.max("total"), F.sum("n"))).alias("trust"), strong.alias("support"))
            .where(F.col("support") >= SUPPORT)
        )
        doubt = F.exp(F.sum(F.log(1 - F.coalesce("trust", F.lit(0.0)))))
        scores = store(
            edges.join(patterns, ["kind", "side", "word"], "left")
            .groupBy("kind", "value")
            .agg(F.when(F.max("seed"), 1.0).otherwise(1 - doubt).alias("score")),
            "scores",
        )
    return scores.where(F.col("score") >= ACCEPT).select("kind", "value")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, base and spans (arrays of kind, start, stop in the order of KINDS, then start)."""
    scanned = store(_scanned(docs, id_col, text_col), "scanned")
    occurrences = store(_occurrences(scanned), "occurrences")
    accepted = _accepted(occurrences, docs, text_col)
    span = F.struct("kind", "start", "stop")
    added = occurrences.where(~F.col("seed")).join(accepted, ["kind", "value"]).groupBy("row").agg(F.collect_set(span).alias("added"))
    bare = F.transform(_spans("base"), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))
    rows = scanned.select("row", "doc_id", bare.alias("base")).join(added, "row", "left")
    none = F.array().cast(f"array<{SPAN}>")
    rank = F.create_map(*(F.lit(x) for pair in zip(KINDS, range(len(KINDS)), strict=True) for x in pair))
    ranked = lambda x: F.struct(rank[x["kind"]].alias("rank"), x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind"))
    merged = F.array_sort(F.transform(F.concat("base", F.coalesce("added", none)), ranked))
    spans = F.transform(merged, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))
    return rows.select("doc_id", "base", spans.alias("spans"))


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """find() as counts of base spans per kind, a digest of the base spans, and all spans as text."""
    found = find(docs, id_col, text_col)

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
