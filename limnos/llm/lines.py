"""Line dedup by a suffix array over line ids, built by distributed prefix doubling; DataFrame operations only.

Lines lie one behind another in the order of documents; each document ends in a sign of its own. The rank of a place at level k is the number
of suffixes whose first 2^k lines are smaller, so places with equal lines share a rank, and the places of a class take up the positions
[rank, rank + copies) of the suffix array: the interval of a longest common prefix of 2^k lines or more. Level k + 1 orders the places of
each interval by the rank of the place 2^k on; places alone in their interval have their final rank and leave. An interval's first copy is its
smallest place. For a place that starts a repeat, its common prefix with the interval's first copy is found by stepping down the
levels; these maximal repeated runs are deleted, but for their first copy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, Scratch, free_names, materialize

#: A class with more than this share of a level's places (and this many) is met by a broadcast table of such classes, at most 1 / share of them.
_HEAVY, _HEAVY_COPIES = 1 / 4096, 1000
#: Classes of about so many rows are ordered in one part, in so many parts at most.
_PER_PART, _MOST_PARTS = 1_000_000, 65_536
#: Ends of documents sort before all lines, by place.
_END = 1 << 62


def _ahead(rows: DataFrame, part: str, sums: dict[str, Column]) -> DataFrame:
    """(part, named sums over all smaller parts): a row for each part of rows."""
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(part).agg(*[v.alias(k) for k, v in sums.items()])
    return totals.select(part, *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(k) for k in sums])


def line_ids(docs: DataFrame, id_col: str, text_col: str, tables: Scratch, words: int | None = None) -> DataFrame:
    """One row per document: id, own (hash of the text), ids (128 bits of SHA-256 of each line, as one array of pairs), n, and first: the place of its first line in the order of (id, own), nulls last.

    With `words` each pair has `alone` too: whether the line counts as a run by itself, as it has so many words or is the whole text and has one."""
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\\n", -1)
    found = lambda x: F.regexp_count(x, F.lit(WORD_PATTERN))
    alone = lambda x: F.when(~F.contains(F.col(text_col), F.lit("\n")), found(x) > 0).when(F.length(x) >= 2 * words - 1, found(x) >= words).otherwise(False)
    more = lambda x: [] if words is None else [alone(x).alias("alone")]
    bits = lambda digest, at: F.conv(F.substring(digest, at, 16), 16, -10).cast("long")
    ids = F.transform(F.transform(lines, lambda x: F.struct(F.sha2(x, 256).alias("digest"), x.alias("line"))), lambda x: F.struct(bits(x["digest"], 1).alias("h"), bits(x["digest"], 17).alias("g"), *more(x["line"])))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("own"), ids.alias("ids"))
    rows = rows.withColumn("n", F.size("ids")).repartitionByRange(F.col("id").asc_nulls_last(), "own")
    rows = tables.write(rows.withColumn("part", F.spark_partition_id()), "ids")
    before = Window.partitionBy("part").orderBy(F.col("id").asc_nulls_last(), "own").rowsBetween(Window.unboundedPreceding, -1)
    # a place that no line has lies behind each document: its end
    size = F.col("n") + 1
    ahead = _ahead(rows, "part", {"ahead": F.sum(size)})
    return rows.withColumn("inside", F.coalesce(F.sum(size).over(before), F.lit(0))).join(F.broadcast(ahead), "part").withColumn("first", F.col("ahead") + F.col("inside")).drop("part", "inside", "ahead")


@dataclass
class Levels:
    """shared[k]: (place, rank, copies, least, left, smaller) of the places in an interval of two suffixes or more at level k: its rank, its size and its smallest place; settled: (place, rank) of all others, final."""

    shared: list[DataFrame]
    settled: list[DataFrame]


def _counted(rows: DataFrame, key: list[str], tables: Scratch, name: str) -> tuple[DataFrame, int, int]:
    """The classes of rows by key: (key, copies, least), how many rows there are, and how many the largest class has. Counted within tasks first."""
    classes = tables.write(rows.groupBy(*key).agg(F.count("*").alias("copies"), F.min("place").alias("least")), f"{name}-classes")
    n = classes.agg(F.sum("copies").alias("n"), F.max("copies").alias("most")).first()
    return classes, n["n"] or 0, n["most"] or 0


def _met(rows: DataFrame, classes: DataFrame, key: list[str], total: int, most: int) -> DataFrame:
    """rows with their class's columns. The few classes that hold a large share of all rows meet them by broadcast, so that no task reads a frequent line's places."""
    bound = max(_HEAVY_COPIES, int(total * _HEAVY))
    if most <= bound:
        return rows.join(classes.hint("merge"), key)
    heavy = F.col("copies") > bound
    few = classes.where(heavy).withColumnsRenamed({c: f"{c}_" for c in classes.columns})
    met = rows.join(F.broadcast(few), [F.col(c) == F.col(f"{c}_") for c in key], "left")
    rest = [c for c in classes.columns if c not in key]
    hot = met.where("copies_ IS NOT NULL").select(*rows.columns, *[F.col(f"{c}_").alias(c) for c in rest])
    cold = met.where("copies_ IS NULL").select(*rows.columns).join(classes.where(~heavy).hint("merge"), key).select(*rows.columns, *rest)
    return hot.unionByName(cold)


def _level(rows: DataFrame, key: list[str], place: Column, base: Column, tables: Scratch, name: str) -> tuple[DataFrame, DataFrame | None, int]:
    """The next level's (shared, settled, places) from rows (place, left, key columns) with classes in the order of the key; shared is None if every class has one place.

    `place`, 0 to 1, ascends with the key and cuts classes into parts of even size, inside which they are ordered; `base` is what a class's running count of smaller rows is moved by."""
    classes, total, most = _counted(rows, key, tables, name)
    parts = min(_MOST_PARTS, max(8, -(-total // _PER_PART)))
    part = F.least(F.floor(place * parts), F.lit(parts - 1)).cast("int")
    classes = classes.withColumn("part", part)
    many = F.when(F.col("copies") > 1, F.col("copies")).otherwise(0)
    inside = Window.partitionBy("part").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    ahead = _ahead(classes, "part", {"all_": F.sum("copies"), "many_": F.sum(many)})
    run = lambda c, to: (F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(to)).cast("long")
    ranked = classes.join(F.broadcast(ahead), "part").select(*key, "copies", "least", (run("copies", "all_") + base).alias("rank"), run(many, "many_").alias("smaller"))
    both = tables.write(_met(rows, ranked, key, total, most).select("place", "left", "copies", "least", "rank", "smaller"), name)
    return both.where("copies > 1") if most > 1 else None, both.where("copies = 1").select("place", "rank"), total


def suffix_levels(placed: DataFrame, tables: Scratch) -> Levels:
    """Prefix doubling until every suffix has a place of its own in the order; each level orders only what the one before left in intervals of two or more."""
    single = placed.select("first", "n", F.posexplode("ids").alias("at", "h")).select((F.col("first") + F.col("at")).alias("place"), F.col("h.h").alias("h"), F.col("h.g").alias("g"), (F.col("n") - F.col("at")).alias("left"))
    shared, settled, total = _level(single, ["h", "g"], F.col("h") / 2.0**64 + 0.5, F.lit(0), tables, "level-0")
    out = Levels([], [settled])
    while shared is not None:
        out.shared.append(shared)
        on = 1 << len(out.shared) - 1
        known = shared.select("place", "rank")
        for s in out.settled:
            known = known.unionByName(s)
        known = known.select((F.col("place") - on).alias("place"), F.col("rank").alias("then_"))
        then = F.when(F.col("left") <= on, F.col("place") - _END).otherwise(F.col("then_")).alias("then")
        rows = shared.join(known, "place", "left").select("place", "left", F.col("rank").alias("now"), F.col("smaller").alias("lower"), F.col("copies").alias("size"), then)
        rows = tables.write(rows, f"rows-{len(out.shared)}")  # counted and met below: the join is not done twice
        # `lower` rows lie before the interval's in this order; its own move to [now, now + size)
        about = (F.col("now") + F.greatest("then", F.lit(0)) / total * F.col("size")) / total
        shared, settled, _ = _level(rows, ["now", "lower", "size", "then"], about, F.col("now") - F.col("lower"), tables, f"level-{len(out.shared)}")
        out.settled.append(settled)
    return out


def common_prefixes(pairs: DataFrame, levels: Levels, known: str | None = None) -> DataFrame:
    """pairs (start, source) with `length`: how many lines both suffixes share, stepping down from the highest level. `known` names a column with lines that are known to be shared."""
    out = pairs.withColumn("length", (F.lit(0) if known is None else F.col(known)).cast("long"))
    for j in range(len(levels.shared) - 1, -1, -1):
        a = levels.shared[j].select(F.col("place").alias("pa"), F.col("rank").alias("na"))
        b = levels.shared[j].select(F.col("place").alias("pb"), F.col("rank").alias("nb"))
        met = out.join(a, F.col("start") + F.col("length") == F.col("pa"), "left").join(b, F.col("source") + F.col("length") == F.col("pb"), "left")
        out = met.select(*pairs.columns, (F.col("length") + F.when(F.col("na") == F.col("nb"), 1 << j).otherwise(0)).alias("length"))
    return out


def suffix_array(placed: DataFrame, tables: Scratch) -> DataFrame:
    """(place, rank, lcp): every place in the order of suffixes, from 0, and how many lines it shares with the suffix before it. Lines are ordered by their hashes, equal suffixes by place."""
    levels = suffix_levels(placed, tables)
    order = levels.settled[0]
    for s in levels.settled[1:]:
        order = order.unionByName(s)
    before = order.select((F.col("rank") + 1).alias("rank"), F.col("place").alias("source"))
    pairs = order.join(before, "rank", "left").select("rank", F.col("place").alias("start"), "source")
    return common_prefixes(pairs, levels).select(F.col("start").alias("place"), "rank", "length").withColumnRenamed("length", "lcp")


def _exact(levels: Levels, least: int, tables: Scratch) -> DataFrame | None:
    """(place, least, left) of the places whose next `least` lines occur at another place, with the first of those; None if none does."""
    k = least.bit_length() - 1
    if len(levels.shared) <= k:
        return None
    now = levels.shared[k]
    if least == 1 << k:
        return now
    # two windows of 2^k, overlapping
    on = least - (1 << k)
    later = now.select((F.col("place") - on).alias("place"), F.col("rank").alias("then"))
    rows = now.where(F.col("left") > on).select("place", "left", F.col("rank").alias("now")).join(later, "place")
    classes, total, most = _counted(rows, ["now", "then"], tables, "exact")
    return tables.write(_met(rows, classes, ["now", "then"], total, most).where("copies > 1").select("place", "least", "left"), "exact")


def repeated_runs(placed: DataFrame, least: int, tables: Scratch, words: int | None = None) -> DataFrame:
    """(start, length, source): maximal runs of at least `least` lines, from place `start`, that occur from place `source` on, which is earlier; within documents. With `words`, also single lines that count alone."""
    levels = suffix_levels(placed, tables)
    lone = placed.sparkSession.createDataFrame([], "start long, length long, source long")
    if words is not None and levels.shared:
        by_itself = placed.select("first", F.posexplode("ids").alias("at", "h")).where("h.alone").select((F.col("first") + F.col("at")).alias("place"))
        lone = levels.shared[0].where(F.col("least") < F.col("place")).join(by_itself, "place").select(F.col("place").alias("start"), F.lit(1).cast("long").alias("length"), F.col("least").alias("source"))
    exact = _exact(levels, least, tables)
    if exact is None:
        return lone
    copies = exact.where(F.col("least") < F.col("place")).select("place", F.col("least").alias("name"), "left")
    # a run starts where the line before is no part of the same repeat
    before = copies.select((F.col("place") + 1).alias("place"), (F.col("name") + 1).alias("was"), (F.col("left") - 1).alias("rest"))
    starts = copies.join(before, "place", "left").where(F.col("was").isNull() | (F.col("was") != F.col("name")) | (F.col("rest") != F.col("left")))
    starts = tables.write(starts.select(F.col("place").alias("start"), F.col("name").alias("source"), F.lit(least).cast("long").alias("held")), "starts")
    runs = common_prefixes(starts, levels, "held").select("start", "length", "source")
    return runs if words is None else runs.unionByName(lone.select("start", "length", "source"))


def deleted_lines(docs: DataFrame, id_col: str, text_col: str, least: int, tables: Scratch, words: int | None = None) -> DataFrame:
    """(id, own, first, spans): the documents that lose lines, with the sorted, disjoint spans (begin, end) of line numbers that repeats take from them."""
    placed = tables.write(line_ids(docs, id_col, text_col, tables, words), "placed")
    runs = repeated_runs(placed, least, tables, words)
    # a run stays within a document: find it by its first place, in blocks of places
    width = 1 << 10
    per = placed.select("id", "own", "n", "first")
    cells = per.withColumn("cell", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor((F.col("first") + F.col("n") - 1) / width))))
    met = runs.withColumn("cell", F.floor(F.col("start") / width)).join(cells, "cell").where((F.col("start") >= F.col("first")) & (F.col("start") < F.col("first") + F.col("n")))
    # runs of one document may overlap: each keeps what is behind all before it
    earlier = Window.partitionBy("first").orderBy("start", F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    met = met.withColumn("begin", F.greatest("start", F.coalesce(F.max(end).over(earlier), F.col("start")))).where(end > F.col("begin"))
    span = F.struct((F.col("begin") - F.col("first")).cast("int").alias("begin"), (end - F.col("first")).cast("int").alias("end"))
    return met.groupBy("first").agg(F.first("id").alias("id"), F.first("own").alias("own"), F.array_sort(F.collect_list(span)).alias("spans"))


def _removed(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0), lambda n, s: n + s["end"] - s["begin"])


def _kept(text: Column, spans: Column) -> Column:
    """The text without the lines of the spans: the slices between them."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    k = F.size(spans)
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["end"])
    end = lambda i: F.when(i < k, F.get(spans, i)["begin"]).otherwise(F.size(lines))
    return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), k), lambda i: F.slice(lines, begin(i) + 1, end(i) - begin(i)))), "\n")


def _with_spans(docs: DataFrame, id_col: str, text_col: str, least: int, words: int | None = None) -> tuple[DataFrame, str]:
    """The rows of docs with their spans (null: none) as one more column, and its name.

    Equal rows share a key. Where a key has several rows, they are numbered and each takes one of the key's lists; the rows left over lose nothing."""
    lost_id, lost_own, lists, flag, spans, nth_ = free_names(docs, "lost_id", "lost_own", "lists", "several", "spans", "nth")
    with Scratch(docs.sparkSession, "lines") as tables:
        got = materialize(deleted_lines(docs, id_col, text_col, least, tables, words), "lines-lost")
    own = F.xxhash64(text_col)
    rows = docs.groupBy(F.col(id_col).alias("id"), own.alias("own")).agg(F.count("*").alias("rows"))
    several = rows.where("rows > 1")
    some = got.groupBy("id", "own").agg(F.sort_array(F.collect_list(F.struct("first", "spans"))).alias("lists"))
    twice = several.select(F.col("id").alias("i"), F.col("own").alias("o"), F.lit(True).alias("several"))
    some = some.join(twice, F.col("id").eqNullSafe(F.col("i")) & (F.col("own") == F.col("o")), "left").select(F.col("id").alias(lost_id), F.col("own").alias(lost_own), F.col("lists").alias(lists), F.col("several").alias(flag))
    met = docs.join(some.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col(lost_id)) & (own == F.col(lost_own)), "left")
    once = met.where(F.col(flag).isNull()).withColumn(spans, F.get(lists, F.lit(0))["spans"])
    nth = F.row_number().over(Window.partitionBy(id_col, lost_own).orderBy(lost_own)) - 1
    more = met.where(F.col(flag)).withColumn(nth_, nth).withColumn(spans, F.get(lists, F.col(nth_))["spans"]).drop(nth_)
    return once.unionByName(more).drop(lost_id, lost_own, lists, flag), spans


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 2, words: int | None = None) -> DataFrame:
    """docs with `text_col` without the lines of later copies: those in a run of at least `least` lines that occurs at an earlier place (documents in the order of ids, nulls last; of repeated ids by a hash of the text; lines in order).

    Lines are what lies between line feeds; a null text has one empty line and stays null, as one line is no run of two (for least = 1 it may become empty). No document goes:
    one that is a copy as a whole keeps its row with an empty text. Of equal rows (same id, same text) the first keeps its lines. All columns stay.
    With `words`, a single line that occurs earlier goes too if it has at least so many words, or if it is the whole text and not blank."""
    rows, spans = _with_spans(docs, id_col, text_col, least, words)
    return rows.withColumn(text_col, F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(_kept(F.col(text_col), F.col(spans)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def line_report(docs: DataFrame, least: int = 2) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the lines that stay, joined by line feeds) for every document."""
    rows, spans = _with_spans(docs.select("doc_id", "text"), "doc_id", "text", least)
    n = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long")
    kept = F.when(F.col(spans).isNull(), F.coalesce("text", F.lit(""))).otherwise(_kept(F.col("text"), F.col(spans)))
    return rows.select("doc_id", n.alias("n_lines"), F.coalesce(_removed(F.col(spans)), F.lit(0)).cast("long").alias("n_removed"), F.sha2(kept, 256).alias("kept_sha256"))
