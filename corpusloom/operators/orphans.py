"""References to records that do not exist, are gone, or arrive later.

Plan: references are counted per key and period before any shuffle of their
own. Keys that hold more than ``heavy_share`` of all references are *heavy* (at
most ``1/heavy_share`` of them exist, whatever the data size), and their
timelines, of at most ``max_spans`` lifetimes each, are broadcast: never more
than ``broadcast_rows`` rows, which bounds ``max_spans``. The other keys are anti-joined with the target
keys as counted, not as references; references find the few keys missing by a
broadcast where those are counted to be few. What is left is shuffled once and
compared with the timeline of its key. Targets with more than ``max_spans``
disjoint lifetimes take an as-of pass partitioned by key and day, heavy ones
also by a salt; every key is decided by itself. The parts are united.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import checkpointed, small_side


def match_key(col: Column) -> Column:
    """Key used for comparison: no white space at the ends, no case; blank is null."""
    key = F.lower(F.regexp_replace(col, r"(?U)^\s+|\s+$", ""))
    return F.when(F.length(key) > 0, key)


def _merged(spans: DataFrame, by: list[str]) -> DataFrame:
    """Overlapping or touching spans (``s`` to ``e``, ``e`` null: open) made one per island of ``by``."""
    far = F.coalesce("e", F.lit("9999-12-31").cast("timestamp_ntz"))
    over = Window.partitionBy(*by).orderBy("s", far)
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    marked = spans.withColumn("_far", far).withColumn("_new", (F.max("_far").over(before) >= F.col("s")).cast("int"))
    island = marked.withColumn("_isle", F.sum(F.when(F.coalesce("_new", F.lit(0)) == 1, 0).otherwise(1)).over(over))
    out = island.groupBy(*by, "_isle").agg(F.min("s").alias("s"), F.max("_far").alias("_far"))
    return out.select(*by, "s", F.when(F.col("_far") < F.lit("9999-12-31").cast("timestamp_ntz"), F.col("_far")).alias("e"))


def _verdict(first: Column, alive: Column, at: Column) -> Column:
    """Kind of orphan of a reference whose key exists; null when it is none or its time is unknown."""
    return F.when(at.isNull() | alive, F.lit(None)).when(first <= at, F.lit("deleted")).otherwise(F.lit("late"))


def orphan_references(
    references: DataFrame,
    targets: DataFrame,
    *,
    ref_id: str,
    ref_key: str,
    ref_time: str,
    target_key: str,
    target_from: str,
    target_to: str,
    heavy_share: float = 1 / 1024,
    max_spans: int = 64,
    broadcast_rows: int = 100_000,
) -> DataFrame:
    """Orphan references as ``(ref_id, orphan_kind, period)``, each once.

    ``missing``: no target has the key; ``deleted``: none is alive at the
    reference's time and one had been created by then; ``late``: all come
    later. A target is alive from ``target_from`` on and before ``target_to``
    (null: for ever). ``period`` is the month of ``ref_time`` as ``2025-03``.

    Defined cases: null and blank keys are no references; a null ``ref_time``
    gives ``missing`` with a null period if the key does not exist and no row
    otherwise; a target with null ``target_from`` exists but is never alive;
    repeated rows count once; no targets make every reference ``missing``; no
    references give no rows; other columns are ignored.
    """
    max_spans = min(max_spans, int(broadcast_rows * heavy_share))  # so the timelines of all heavy keys have no more rows
    refs = references.select(F.col(ref_id).alias("r"), match_key(F.col(ref_key)).alias("k"), F.col(ref_time).cast("timestamp_ntz").alias("at")).where("k is not null")
    refs = checkpointed(refs)  # read by the counts and by every part
    life = targets.select(match_key(F.col(target_key)).alias("k"), F.col(target_from).cast("timestamp_ntz").alias("s"), F.col(target_to).cast("timestamp_ntz").alias("e")).where("k is not null")

    firsts = life.groupBy("k").agg(F.min("s").alias("first"))
    # a target key may itself be hot: equal starts collapse map-side, months merge before whole keys
    spans = life.where("s is not null and (e is null or e > s)").groupBy("k", "s").agg(F.when(F.max(F.col("e").isNull()), F.lit(None)).otherwise(F.max("e")).alias("e"))
    spans = _merged(_merged(spans.withColumn("m", F.date_trunc("month", "s")), ["k", "m"]).drop("m"), ["k"])
    counted = spans.withColumn("n", F.count("*").over(Window.partitionBy("k")))
    short = counted.where(F.col("n") <= max_spans).groupBy("k").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    busy = checkpointed(counted.where(F.col("n") > max_spans).drop("n"))
    lines = checkpointed(firsts.join(short, "k", "left").join(busy.select("k", F.lit(True).alias("busy")).distinct(), "k", "left"))

    keys = checkpointed(reference_counts(refs))
    total = keys.agg(F.sum("n")).first()[0] or 0
    heavy = keys.groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") > max(1.0, total * heavy_share)).select("k").toArrow()

    def judged(pairs: DataFrame) -> DataFrame:
        alive = F.exists(F.coalesce("spans", F.array().cast("array<struct<s:timestamp_ntz,e:timestamp_ntz>>")), lambda x: (x["s"] <= F.col("at")) & (x["e"].isNull() | (F.col("at") < x["e"])))
        return pairs.where("busy is null").select("r", "at", _verdict(F.col("first"), alive, F.col("at")).alias("kind"))

    parts, light, is_heavy = [], refs, None
    if heavy.num_rows:
        is_heavy = F.broadcast(references.sparkSession.createDataFrame(heavy))
        hot = refs.join(is_heavy, "k", "left_semi")
        hot_lines = lines.join(is_heavy, "k", "left_semi")
        parts += [hot.join(F.broadcast(hot_lines.select("k")), "k", "left_anti").select("r", "at", F.lit("missing").alias("kind")), judged(hot.join(F.broadcast(hot_lines), "k"))]
        light, keys = refs.join(is_heavy, "k", "left_anti"), keys.join(is_heavy, "k", "left_anti")
    missing = small_side(checkpointed(keys.select("k").distinct().join(lines.select("k"), "k", "left_anti")))
    parts.append(light.join(missing, "k", "left_semi").select("r", "at", F.lit("missing").alias("kind")))
    parts.append(judged(light.join(missing, "k", "left_anti").join(lines, "k")))
    if busy.limit(1).count():
        few = busy.select("k").distinct()
        if is_heavy is not None:
            parts.append(_as_of(refs.join(is_heavy, "k", "left_semi"), firsts, busy.join(is_heavy, "k", "left_semi"), few, SALTS))
        parts.append(_as_of(light, firsts, busy, few, 1))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where("kind is not null").select(F.col("r").alias(ref_id), F.col("kind").alias("orphan_kind"), F.date_format("at", "yyyy-MM").alias("period")).distinct()


#: Parts of a day of a heavy key with many lifetimes.
SALTS = 32


def reference_counts(refs: DataFrame) -> DataFrame:
    """References per key and month, combined before the shuffle."""
    return refs.groupBy("k", F.date_format("at", "yyyy-MM").alias("period")).agg(F.count("*").alias("n"))


def _as_of(refs: DataFrame, firsts: DataFrame, spans: DataFrame, keys: DataFrame, salts: int) -> DataFrame:
    """References of targets with many lifetimes: the last span begun by then, found in a window per key and day.

    Spans are disjoint, so cutting them at midnight adds at most one row per key and day. References are dealt to ``salts`` parts of a day, each with the day's spans.
    """
    mine = refs.join(keys, "k", "left_semi")
    last = mine.agg(F.max("at")).first()[0]
    if last is None:
        return mine.select("r", "at", F.lit(None).cast("string").alias("kind"))
    day = F.date_trunc("day", "s")
    until = F.least(F.coalesce("e", F.lit(last)), F.lit(last)).cast("timestamp_ntz")
    cut = spans.where(F.col("s") <= F.lit(last)).withColumn("d", F.explode(F.sequence(day, F.greatest(F.date_trunc("day", until), day), F.expr("interval 1 day"))))
    marks = cut.select("k", "d", F.greatest("s", "d").alias("at"), F.struct("s", "e").alias("span"), F.lit(0).alias("o"), F.lit(None).cast(refs.schema["r"].dataType).alias("r"), F.explode(F.array(*map(F.lit, range(salts)))).alias("salt"))
    asks = mine.select("k", F.date_trunc("day", "at").alias("d"), "at", F.lit(None).cast(marks.schema["span"].dataType).alias("span"), F.lit(1).alias("o"), "r", F.pmod(F.xxhash64("r"), F.lit(salts)).cast("int").alias("salt"))
    seen = F.last("span", True).over(Window.partitionBy("k", "d", "salt").orderBy("at", "o").rowsBetween(Window.unboundedPreceding, 0))
    found = marks.unionByName(asks).withColumn("seen", seen).where("o = 1").join(firsts, "k", "left")
    alive = F.col("seen").isNotNull() & (F.col("seen.e").isNull() | (F.col("at") < F.col("seen.e")))
    return found.select("r", "at", _verdict(F.col("first"), alive, F.col("at")).alias("kind"))


def orphan_report(orphans: DataFrame, name: str) -> DataFrame:
    """Orphan references counted per referring column, kind and month."""
    return orphans.groupBy("orphan_kind", "period").agg(F.count("*").alias("n_orphans")).select(F.lit(name).alias("table_name"), "orphan_kind", "period", "n_orphans")
