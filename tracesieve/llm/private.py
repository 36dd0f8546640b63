"""Personal data: base spans, and identifiers found by bootstrapped contexts. SQL functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracesieve.llm.common import spare_name
from tracesieve.session import cut

#: Base kinds in listed order with their patterns. Runs are possessive and anchored where a
#: run begins (or the last match ended), which finds the same matches in linear time.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "token": r"(?<![A-Za-z0-9_./+:@-])[A-Za-z_./+:@-]*+[0-9][A-Za-z0-9_./+:@-]*+",
}
GATES = {"email": "@", "ip": ".", "card": "", "phone": "+", "token": ""}
#: Kind of the spans that the method adds.
FOUND = "id"
ROUNDS = 4
#: Different seed instances that a pattern needs, and the confidence it needs to be used.
SUPPORT, CONFIDENCE = 5, 0.8
CONTEXT = 48


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    size = F.length(digits)
    parts = F.forall(F.split(match, r"\."), lambda p: p.rlike(r"^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{0,2})$"))
    return (
        F.when(kind == "ip", parts)
        .when(kind == "card", F.when(size.between(12, 19), _luhn(digits)).otherwise(False))
        .when(kind == "phone", size.between(9, 15))
        .when(kind == "token", (F.length(match) >= 6) & (size >= 4))
        .otherwise(True)
    )


def _matches(kind: str, text: Column) -> Column:
    """Array of structs (kind, i, gap, match, left) for all matches of a kind, valid or not.

    Splitting on the pattern gives the gaps between the matches, so that sums of lengths
    give places.
    """
    pattern = F.lit(PATTERNS[kind])
    gaps = F.split(text, PATTERNS[kind], -1)
    zipped = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("match"))
    listed = F.transform(F.filter(zipped, lambda x: x["match"].isNotNull()), lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), F.length(x["gap"]).alias("gap"), x["match"].alias("match"), F.right(x["gap"], F.lit(CONTEXT)).alias("left"),
    ))
    needed = text.rlike("[0-9]") if kind != "email" else text.contains("@")
    if GATES[kind]:
        needed = needed & text.contains(GATES[kind])
    return F.when(needed, listed).otherwise(F.array().cast("array<struct<kind:string,i:int,gap:int,match:string,left:string>>"))


def _same_document(a: str, b: str) -> Column:
    return F.expr(f"{a}.doc_id <=> {b}.doc_id and {a}.h = {b}.h")


def places(docs: DataFrame) -> DataFrame:
    """(doc_id, h, kind, start, end, match, left) of all valid matches; ``h`` is a hash of the text.

    One pass over the texts. Repeated rows give their matches once.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    listed = docs.select("doc_id", F.xxhash64(text).alias("h"), F.concat(*[_matches(k, text) for k in PATTERNS]).alias("all"))
    rows = listed.select("doc_id", "h", F.explode("all").alias("m")).select("doc_id", "h", "m.*").distinct()
    order = Window.partitionBy("doc_id", "h", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("match")).over(order)
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("match"))
    return cut(rows.where(_valid(F.col("kind"), F.col("match"))).select("doc_id", "h", "kind", "start", "end", "match", "left"))


def _graph(found: DataFrame) -> DataFrame:
    """Tokens with their context pattern, their instance and whether a base span covers them."""
    base = F.col("kind") != "token"
    key = Window.partitionBy("doc_id", "h").orderBy("start", "end")
    before = F.max(F.when(base, F.col("end"))).over(key.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(base, F.col("start"))).over(key.rowsBetween(0, Window.unboundedFollowing))
    seed = F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("end"), F.lit(False))
    word = F.lower(F.regexp_extract("left", r"(\p{L}[\p{L}_-]*+)[^\p{L}]*$", 1))
    bridge = F.regexp_replace(F.regexp_extract("left", r"([^\p{L}]*)$", 1), r"\s+", " ")
    shape = F.regexp_replace(F.regexp_replace("match", "[A-Za-z]+", "a"), "[0-9]", "9")
    rows = found.withColumn("seed", seed).where(~base)
    return rows.select(
        "doc_id", "h", "start", "end", "seed", F.col("match").alias("instance"),
        F.concat_ws("\u0001", word, bridge, shape).alias("pattern"), (word != "").alias("worded"),
    )


def confident_patterns(tokens: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT) -> DataFrame:
    """(pattern, confidence): contexts scored over the graph of patterns and instances.

    A pattern is the word before a token, the signs between them and the token's shape.
    Its confidence is the mean score of its different instances (with one doubtful one
    added); an instance that is no seed scores the chance that at least one of its
    trusted patterns is right. Seeds keep 1. A pattern needs ``support`` different seeds
    or trusted instances. Both steps are aggregates with map-side combine, so a frequent
    word or token is no hot task.
    """
    edges = cut(tokens.where("worded").groupBy("pattern", "instance").agg(F.max(F.col("seed").cast("double")).alias("seed")))
    seeds = cut(edges.groupBy("instance").agg(F.max("seed").alias("seed")))
    score = seeds.select("instance", F.col("seed").alias("score"))
    for _ in range(rounds):
        patterns = (
            edges.join(score, "instance").groupBy("pattern")
            .agg(F.sum("score").alias("s"), F.count("*").alias("n"), F.sum((F.col("score") >= CONFIDENCE).cast("int")).alias("good"))
            .select("pattern", (F.col("s") / (F.col("n") + 1)).alias("confidence"), "good")
        )
        patterns = cut(patterns.where((F.col("good") >= support) & (F.col("confidence") >= 0.5)))
        belief = (
            edges.join(patterns, "pattern").groupBy("instance")
            .agg((1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))).alias("belief"))
        )
        score = cut(
            seeds.join(belief, "instance", "left")
            .select("instance", F.when(F.col("seed") == 1, 1.0).otherwise(F.coalesce("belief", F.lit(0.0))).alias("score"))
        )
    return patterns.where(F.col("confidence") >= CONFIDENCE).select("pattern", "confidence")


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, h, kind, start, end): base spans and the identifiers that trusted contexts add."""
    found = places(docs)
    tokens = cut(_graph(found))
    patterns = confident_patterns(tokens)
    more = tokens.where("worded and not seed").join(patterns, "pattern").select("doc_id", "h", F.lit(FOUND).alias("kind"), "start", "end")
    base = found.where(F.col("kind") != "token").select("doc_id", "h", "kind", "start", "end")
    return cut(base.unionByName(more))


def _joined(rows: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(rows), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def private_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of ``docs``.

    Counts and digest are those of the base kinds; ``spans`` has the method's, too. A null
    text counts as empty. Repeated rows give equal results; a null id is allowed; other
    columns are ignored. A document's spans are gathered per document only.
    """
    order = reduce(lambda c, k: c.when(F.col("kind") == k[1], k[0]), enumerate(KINDS), F.when(F.col("kind") == FOUND, len(KINDS)))
    one = F.struct("start", order.alias("place"), "end", "kind")
    base = F.col("kind") != FOUND
    per_text = spans(docs).groupBy("doc_id", "h").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in KINDS],
        _joined(F.collect_list(F.when(base, one))).alias("base"), _joined(F.collect_list(one)).alias("spans"),
    )
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).alias("d")
    joined = rows.join(per_text.alias("s"), _same_document("d", "s"), "left")
    return joined.select(
        "d.doc_id", *[F.coalesce(f"s.n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce("s.base", F.lit("")), 256).alias("base_sha256"), F.coalesce("s.spans", F.lit("")).alias("spans"),
    )


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; no row is dropped.

    Null texts stay null and empty ones empty; texts are masked whole, however long; repeated
    rows and rows without an id are masked alike. An empty table gives an empty one.
    Overlapping spans are masked as one, named after the first. Texts without a digit
    or ``@`` have no spans and pass by the join. ``n_chars``, where present, follows.
    """
    docs_key, cuts = spare_name(docs, "h"), spare_name(docs, "cuts")
    key = Window.partitionBy("doc_id", "h").orderBy("start", "end", "kind")
    reach = F.max("end").over(key.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0)
    merged = (
        spans(docs).withColumn("new", new).withColumn("run", F.sum("new").over(key.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc_id", "h", "run").agg(F.min(F.struct("start", "kind")).alias("at"), F.max("end").alias("end"))
        .groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(F.struct("at.start", "end", "at.kind"))).alias(cuts))
    )
    may = F.coalesce(F.col("text").rlike("[0-9@]"), F.lit(False))
    rows = docs.where(may).withColumn(docs_key, F.xxhash64("text"))
    rows = rows.alias("d").join(merged.hint("shuffle_hash").alias("s"), F.expr(f"d.doc_id <=> s.doc_id and d.`{docs_key}` = s.h"), "left")
    rows = rows.select(*[F.col(f"d.`{c}`") for c in docs.columns], F.col(f"s.{cuts}").alias(cuts))
    text, all_cuts = F.col("text"), F.col(cuts)
    pieces = F.transform(all_cuts, lambda s, i: F.concat(
        _between(text, F.coalesce(F.get(all_cuts, i - 1)["end"], F.lit(0)), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"),
    ))
    tail = F.substring(text, F.element_at(all_cuts, -1)["end"] + 1, F.length(text))
    masked_text = F.when(all_cuts.isNull(), text).otherwise(F.concat(F.array_join(pieces, ""), tail))
    rows = rows.withColumn("text", masked_text).drop(cuts)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs.where(~may).unionByName(rows.select(*docs.columns))


def _between(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start.cast("int") + 1, (end - start).cast("int"))
