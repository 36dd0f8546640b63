"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracesieve.llm.common import spare_name
from tracesieve.operators.ordering import number_rows
from tracesieve.session import cut

#: Repeating weights of the sources in order of their names.
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Hash bins in which the fractional repetition of a source is cut.
BINS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A seeded number from 0 to 2^32 - 1 for an id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, size) with ``weight`` and ``target``.

    Sources above ``max_epochs`` times their size are clamped there and what they
    cannot use is shared anew by weight, until none is above. Each round is one
    aggregate over the sources; at least one source is clamped per round but the last.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    sizes = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("long"))
    sizes = cut(sizes.withColumn("cap", F.col("size") * max_epochs))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    level = None
    while True:
        free = F.lit(True) if level is None else F.col("cap") >= level * F.col("weight")
        spent, weight = sizes.agg(
            F.sum(F.when(free, 0).otherwise(F.col("cap"))), F.sum(F.when(free, F.col("weight")).otherwise(0))
        ).first()
        rest = float(total - (spent or 0)) / float(weight or 1)
        if not weight or rest == level:
            break
        level = rest
    return sizes.withColumn("target", F.least(F.col("cap").cast("double"), F.lit(level or 0.0) * F.col("weight")))


def plan_mix(docs: DataFrame, seed: str = SEED, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: its target, its whole repetitions and where the last, partial one ends.

    The partial repetition takes documents in the order of their seeded draw. Sums per
    hash bin find the bin in which the words run out, and only that bin's documents (one
    in ``BINS``) are put in order. The document at that place gives its first ``cut`` words.
    """
    ids = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), draw(F.col("doc_id"), seed).alias("u"))
    ids = cut(ids.where("size > 0").withColumn("bin", F.floor(F.col("u") / (2**32 // BINS))))
    bins = cut(ids.groupBy("source", "bin").agg(F.sum("size").alias("words")))
    named = docs.select("source").distinct().alias("n").join(
        bins.groupBy("source").agg(F.sum("words").alias("size")).alias("b"), F.expr("n.source <=> b.source"), "left"
    )
    targets = source_targets(named.select("n.source", F.coalesce("b.size", F.lit(0)).alias("size")), weights, max_epochs)
    targets = targets.withColumn("whole", F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0))
    targets = cut(targets.withColumn("part", F.col("target") - F.col("whole") * F.col("size")))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = cut(
        bins.withColumn("before", before).alias("b").join(targets.alias("t"), F.expr("b.source <=> t.source"))
        .where("b.before <= t.part and t.part < b.before + b.words").select("t.source", "b.bin", "b.before", "t.part")
    )
    inside = (
        ids.alias("d").join(at.alias("c"), F.expr("d.source <=> c.source and d.bin = c.bin"))
        .select("c.source", "d.bin", "c.before", "c.part", "d.u", _id("d.doc_id"), "d.size")
    )
    # equal rows first, so that a row repeated very often is one row of the window
    inside = inside.groupBy("source", "bin", "before", "part", "u", "id", "size").agg(F.count("*").alias("same"))
    order = Window.partitionBy("source", "bin").orderBy("u", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    words = F.col("size") * F.col("same")
    inside = inside.withColumn("from", F.col("before") + F.sum(words).over(order) - words)
    stops = (
        inside.where(F.col("from") <= F.col("part")).where(F.col("part") < F.col("from") + words).groupBy("source")
        .agg(F.min(F.struct("u", "id", "size")).alias("stop"), F.min(F.struct((F.col("part") - F.col("from")).alias("words"), "same")).alias("left"))
    )
    return cut(
        targets.alias("t").join(at.alias("c"), F.expr("t.source <=> c.source"), "left").join(stops.alias("s"), F.expr("t.source <=> s.source"), "left")
        .select("t.source", F.col("t.size").alias("source_size"), "t.target", "t.whole", "c.bin", "s.stop", F.col("s.left.words").alias("cut"), "s.left.same")
    )


def _id(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(-(2**63))).alias("id")


def mix_sources(docs: DataFrame, seed: str = SEED, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``docs`` with a struct ``mix``: size, source_size, target, whole (repetitions), extra (words).

    A document is taken ``whole`` times in full and then its first ``extra`` words, which
    is its whole size or 0 but for one document per source. A source's words so meet its
    target to the word, and no document exceeds ``max_epochs`` times its size.

    Null text has size 0 and gives no words. A null source is a source of its own, last in
    order. Rows that repeat an id share one draw; where the cut falls among equal rows (id and
    size), they are numbered and only one of them is cut. Other columns pass
    unchanged; an empty table gives an empty one. The plan has one row per source and the
    join has no aggregate above it, so a hot source can be split by adaptive execution.
    """
    plan = plan_mix(docs, seed, weights, max_epochs)
    repeated = not plan.where("same > 1").isEmpty()
    name = spare_name(docs, "mix")
    own = spare_name(docs, "plan")
    plan = plan.select(F.struct(*plan.columns).alias(own)).alias("t")

    def of(field: str) -> Column:
        return F.col(f"t.{own}.{field}")

    u, size = draw(F.col("d.doc_id"), seed), word_count(F.col("d.text"))
    mine = F.struct(u.alias("u"), _id("d.doc_id"), size.alias("size"))
    bin_ = F.floor(u / (2**32 // BINS))

    def mixed(extra: Column) -> Column:
        return F.struct(
            size.alias("size"), of("source_size").alias("source_size"), of("target").alias("target"),
            of("whole").cast("int").alias("whole"), extra.cast("long").alias("extra"),
        ).alias(name)

    columns = [F.col(f"d.`{c}`") for c in docs.columns]
    joined = docs.alias("d").join(plan, F.expr(f"d.source <=> t.{own}.source"))
    inside = F.when(mine < of("stop"), size).when(mine == of("stop"), F.round(of("cut"))).otherwise(0)
    extra = F.when(bin_ < of("bin"), size).when((bin_ == of("bin")) & (size > 0), inside).otherwise(0)
    if not repeated:
        return joined.select(*columns, mixed(extra))
    equal = F.coalesce((bin_ == of("bin")) & (of("same") > 1) & (mine == of("stop")), F.lit(False))
    # Equal rows are alike, so any order numbers them: that of the scan, dealt out by range.
    number, row, key = (spare_name(docs, x) for x in ("number", "row", "key"))
    tied = joined.where(equal).select(*columns, mixed(extra), of("cut").alias(number + "_cut"), F.col("d.source").alias(key), F.monotonically_increasing_id().alias(row))
    tied = number_rows(tied, [row], number, [key])
    left = F.round(F.col(number + "_cut") - (F.col(number) - 1) * F.col(f"{name}.size"))
    shares = F.least(F.greatest(left, F.lit(0)), F.col(f"{name}.size")).cast("long")
    tied = tied.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(name).withField("extra", shares).alias(name))
    return joined.where(~equal).select(*columns, mixed(extra)).unionByName(tied)


def repeated_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as often as it is taken, the document at the cut shortened.

    Documents without words (null and empty texts) are taken no times and vanish. Repeated
    rows are rows of their own; a null source is a source. Long documents are cut at their
    word without limit. An empty table gives an empty one. ``n_chars``, where ``docs`` has
    it, follows a shortened text.
    """
    name = spare_name(docs, "mix")
    mixed, size, extra = mix_sources(docs, **how), F.col(f"{name}.size"), F.col(f"{name}.extra")
    times = F.col(f"{name}.whole") + F.when(extra > 0, 1).otherwise(0)
    start = r"^[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++(?:[\x20\x09-\x0D]++[^\x20\x09-\x0D]++){"
    head = F.regexp_substr("text", F.concat(F.lit(start), (extra - 1).cast("string"), F.lit("}+")))  # possessive: no recursion
    turn_name = spare_name(mixed, "turn")
    rows = mixed.where((times > 0) & (size > 0)).select("*", F.explode(F.sequence(F.lit(1), times)).alias(turn_name))
    turn = F.col(turn_name)
    last = (turn > F.col(f"{name}.whole")) & (extra < size)
    shown = {"text": F.when(last, head).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        shown["n_chars"] = F.when(last, F.length(head).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return rows.select(*[shown.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
