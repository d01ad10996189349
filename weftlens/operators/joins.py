"""Join shapes: as-of, co-occurrence, existence under a disjunction, bounded graph expansion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from weftlens.sources import shared


def as_of_before(rows: DataFrame, key: str, at: str, tie: str, value: str, out: str) -> DataFrame:
    """Each row with the value of its key's last row strictly before its time.

    Rows of one time form a group; the group before it gives the value of its
    greatest ``tie``. One shuffle by key, no range join.
    """
    by = Window.partitionBy(key).orderBy(at)
    times = rows.groupBy(key, at).agg(F.max_by(value, tie).alias("_v")).withColumn(out, F.lag("_v").over(by)).drop("_v")
    return rows.join(times, [key, at])


#: Items of more docs than this are heavy: their docs are never paired with each other.
HEAVY_DOCS = 500
#: Heavy items that a doc may have; where one has more, items must have twice as many docs to be heavy.
HEAVY_ITEMS = 8


#: Light items that a narrow doc may have; docs with more are paired with whoever shares an item.
NARROW_ITEMS = 16
#: Lines that are shuffled at once: more are gone through in passes, by doc or by item, so that the disk holds one pass's shuffles and not the table's.
PASS_ROWS = 20_000_000


def _pass(rows: DataFrame, key: str, k: int, passes: int) -> DataFrame:
    """The rows of the k-th of so many passes, by their key."""
    return rows if passes == 1 else rows.where(F.pmod(F.xxhash64(key), F.lit(passes)) == k)


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _split(once: DataFrame, doc: str, item: str, passes: int) -> tuple[DataFrame, DataFrame | None, list[DataFrame]]:
    """(rows of light items, rows of heavy ones, the stored sizes behind them): the least bound, from HEAVY_DOCS on by doubling, by which no doc has over HEAVY_ITEMS heavy items."""
    stored = [shared.store(_pass(once, item, k, passes).groupBy(item).agg(F.count("*").alias("_docs")).where(F.col("_docs") > HEAVY_DOCS), "item-sizes") for k in range(passes)]
    sizes = _all(stored)
    if not sizes.head(1):
        return once, None, stored
    bound = HEAVY_DOCS
    while True:
        many = sizes.where(F.col("_docs") > bound).select(item)
        heavy = once.join(many, item, "left_semi")
        most = heavy.groupBy(doc).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if most is None:
            return once, None, stored
        if most <= HEAVY_ITEMS:
            return once.join(many, item, "left_anti"), heavy, stored
        bound *= 2


def _with_rest(rows: DataFrame, doc: str, item: str) -> DataFrame:
    """Each row with _rest, the doc's next items and how often it has them: all of them in a narrow doc."""
    after = Window.partitionBy(doc).orderBy(item).rowsBetween(1, NARROW_ITEMS)
    return rows.withColumn("_rest", F.collect_list(F.struct(F.col(item).alias("i"), F.col("_n").alias("n"))).over(after))


def _firsts(rows: DataFrame, held: DataFrame | None, doc: str, item: str, n: int) -> DataFrame:
    """(item, _others, _ms): the n + 1 first docs of an item, of each set of heavy items by itself, and how often they have it (null: once each)."""
    ranked, group = (rows, [item]) if held is None else (rows.join(held, doc, "left"), [item, "_held"])
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("_n"), doc))
    first = ranked.select(doc, *group, "_n").withColumn("_k", place).where(F.col("_k") <= n + 1).groupBy(item).agg(F.collect_list(F.struct(F.col(doc).alias("other"), F.col("_n").alias("m"))).alias("_first"))
    often = F.when(F.exists("_first", lambda x: x["m"] > 1), F.transform("_first", lambda x: x["m"]))
    return first.select(item, F.transform("_first", lambda x: x["other"]).alias("_others"), often.alias("_ms"))


def _twos(rows: DataFrame, doc: str, item: str) -> DataFrame:
    """(doc, item, _next, _with: docs that have both items too, and what they add by these two).

    A doc's later items go with each of its items as a list, so that pairs of items are not shuffled.
    """
    pairs = rows.where(F.size("_rest") > 0).select(doc, item, "_n", "_rest").repartition(item)
    pairs = pairs.select(doc, item, "_n", F.explode("_rest").alias("t")).select(doc, item, F.col("t.i").alias("_next"), F.col("_n").alias("na"), F.col("t.n").alias("nb"))
    pairs = pairs.withColumn("_docs", F.count("*").over(Window.partitionBy(item, "_next"))).where(F.col("_docs") > 1)
    groups = pairs.groupBy(item, "_next").agg(F.collect_list(F.struct(F.col(doc).alias("d"), "na", "nb")).alias("_group"))
    rest = F.transform(F.filter("_group", lambda x: x["d"] != F.col("t.d")), lambda x: F.struct(x["d"].alias("other"), (F.col("t.na") * x["na"] + F.col("t.nb") * x["nb"]).alias("w")))
    return groups.select(item, "_next", F.explode("_group").alias("t"), "_group").select(F.col("t.d").alias(doc), item, "_next", rest.alias("_with"))


def _several(twos: DataFrame, doc: str, item: str) -> DataFrame:
    """(doc, other, shared, _items) of docs that share two items or more: s shared items come s - 1 times each. Lists are shuffled, pairs are made where they are added up."""
    flat = twos.repartition(doc).select(doc, item, "_next", F.explode("_with").alias("o")).select(doc, item, "_next", "o.other", "o.w")
    pairs = flat.groupBy(doc, "other").agg(F.sum("w").alias("_both"), F.count("*").alias("_twos"), F.array_union(F.collect_set(item), F.collect_set("_next")).alias("_items"))
    less = (F.sqrt(1 + 8 * F.col("_twos").cast("double")) - 1) / 2
    return pairs.select(doc, "other", (F.col("_both") / F.round(less)).cast("long").alias("shared"), "_items")


def _wide_pairs(rows: DataFrame, far: DataFrame, wide: DataFrame, doc: str, item: str) -> tuple[DataFrame, DataFrame]:
    """((doc, other, shared, _items) of narrow docs with wide ones, the same of wide docs with all); far are the wide docs' rows."""
    met = rows.select(doc, item, "_n").join(far.select(F.col(doc).alias("other"), item, F.col("_n").alias("_m")), item).where(F.col(doc) != F.col("other"))
    pairs = met.groupBy(doc, "other").agg(F.sum(F.col("_n") * F.col("_m")).alias("shared"), F.collect_set(item).alias("_items"))
    back = pairs.select(F.col("other").alias(doc), F.col(doc).alias("other"), "shared", "_items")
    return pairs.join(wide, doc, "left_anti"), back


def _light_pairs(light: DataFrame, held: DataFrame | None, doc: str, item: str, n: int) -> tuple[DataFrame, list[DataFrame]]:
    """((doc, other, shared, _item) of docs that share light items, the stored tables behind it).

    _item is the item where they share only that one. Docs that share one item
    with a doc, and have the same heavy ones as each other, rank by how often
    they have it: all but the n + 1 first of an item have n better ones before
    them and are left out. Docs that share two items or more are found by pairs
    of items.
    """
    wide = shared.store(light.groupBy(doc).agg(F.count("*").alias("_many")).where(F.col("_many") > NARROW_ITEMS).select(doc), "wide-docs")
    any_wide = bool(wide.head(1))
    mine = (light.join(wide, doc, "left_anti") if any_wide else light).select(doc, item, "_n")
    listed = mine.join(_firsts(mine, held, doc, item, n), item)
    one = listed.repartition(doc).select(doc, item, "_n", "_ms", F.posexplode("_others").alias("_at", "other")).where(F.col(doc) != F.col("other"))
    one = one.select(doc, "other", (F.col("_n") * F.coalesce(F.get("_ms", F.col("_at")), F.lit(1))).alias("shared"), F.col(item).alias("_item"))
    several = _several(_twos(_with_rest(mine, doc, item), doc, item), doc, item).select(doc, "other", "shared", F.lit(None).cast(light.schema[item].dataType).alias("_item"))
    # What all shared items add is more than what one of them does.
    pairs = one.unionByName(several).groupBy(doc, "other").agg(F.max("shared").alias("shared"), F.when(F.count_if(F.col("_item").isNull()) == 0, F.max("_item")).alias("_item"))
    if any_wide:
        far = light.join(wide, doc, "left_semi")
        pairs = _all([pairs, *(p.select(doc, "other", "shared", F.when(F.size("_items") == 1, F.col("_items")[0]).alias("_item")) for p in _wide_pairs(light, far, wide, doc, item))])
    return pairs, [wide]


def _best(pairs: DataFrame, doc: str, n: int) -> DataFrame:
    """Of each doc the n pairs with most shared, ties to the smaller other."""
    return pairs.withColumn("_k", F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("shared"), F.asc("other")))).where(F.col("_k") <= n).drop("_k")


def _names(item: Column, labels: Column) -> Column:
    """An item's labels as once has them: null where the only one is the item itself."""
    return F.coalesce(labels, F.array(item.cast("string")))


def _listed(found: Column) -> Column:
    return F.when(F.size(found) == 1, F.get(found, F.lit(0))).otherwise(F.array_join(F.sort_array(F.array_distinct(found)), ","))


def _named(best: DataFrame, once: DataFrame, doc: str, item: str) -> DataFrame:
    """best (doc, other, shared) with the labels of the items that both have."""
    both = best.join(once.select(doc, item, _names(F.col(item), F.col("_labels")).alias("_labels")), doc).join(once.select(F.col(doc).alias("other"), item), ["other", item], "left_semi")
    return both.groupBy(doc, "other").agg(F.first("shared").alias("shared"), _listed(F.flatten(F.collect_set("_labels"))).alias("labels"))


def _chosen(rows: DataFrame, more: DataFrame, doc: str, item: str, n: int) -> DataFrame:
    """(doc, other, shared, labels): the n best of each doc, among the first docs of its items (rows) and pairs that are counted in full (more).

    A doc is one row, in which its lists are merged, so that no pair is shuffled or sorted.
    """
    flat = rows.select(doc, item, "_n", "_labels", "_others", "_ms").unionByName(more, allowMissingColumns=True).repartition(doc)
    once = F.when(F.col("other").isNull(), F.struct(F.col(item).alias("i"), "_n", _names(F.col(item), F.col("_labels")).alias("labels"), "_others", "_ms"))
    full = F.when(F.col("other").isNotNull(), F.struct((-F.col("shared")).alias("less"), "other", F.col("_items").alias("items")))
    per = flat.groupBy(doc).agg(F.collect_list(once).alias("_rows"), F.collect_list(full).alias("_more"))
    each = lambda x: F.transform(x["_others"], lambda o, at: F.struct((-(x["_n"] * F.coalesce(F.get(x["_ms"], at), F.lit(1)))).alias("less"), o.alias("other"), x["labels"].alias("labels")))
    fresh = F.filter(F.flatten(F.transform("_rows", each)), lambda s: (s["other"] != F.col(doc)) & ~F.exists("_more", lambda m: m["other"] == s["other"]))
    labels = lambda m: F.flatten(F.transform(F.filter("_rows", lambda x: F.array_contains(m["items"], x["i"])), lambda x: x["labels"]))
    known = F.transform("_more", lambda m: F.struct(m["less"].alias("less"), m["other"].alias("other"), labels(m).alias("labels")))
    merged = F.slice(F.sort_array(F.concat(fresh, known)), 1, n)
    # Where all is shared once the smallest docs are the best, and sorting them alone takes a fifth of the time.
    once_each = (F.size("_more") == 0) & F.forall("_rows", lambda x: (x["_n"] == 1) & x["_ms"].isNull())
    smallest = F.slice(F.sort_array(F.array_remove(F.flatten(F.transform("_rows", lambda x: x["_others"])), F.col(doc))), 1, n)
    through = lambda o: F.filter("_rows", lambda x: F.array_contains(x["_others"], o))[0]["labels"]
    plain = F.transform(smallest, lambda o: F.struct(F.lit(-1).cast("long").alias("less"), o.alias("other"), through(o).alias("labels")))
    best = per.select(doc, F.explode(F.when(once_each, plain).otherwise(merged)).alias("b"))
    return best.select(doc, "b.other", (-F.col("b.less")).alias("shared"), _listed(F.col("b.labels")).alias("labels"))


def _light_best(parts: list[DataFrame], doc: str, item: str, n: int) -> DataFrame:
    """cooccurrence() where no item is heavy: parts are the docs' items, a pass of docs each.

    The n best of a doc's pairs that are counted in full are enough: what is
    left out there has n better ones before it, also where a list has it with one item only.
    """
    passes, once = len(parts), _all(parts)
    wide = shared.store(once.where(F.col("_no") == NARROW_ITEMS + 1).select(doc), "wide-docs")
    any_wide = bool(wide.head(1))
    narrow = lambda rows: rows.join(wide, doc, "left_anti") if any_wide else rows
    firsts = [shared.store(_firsts(narrow(_pass(once, item, k, passes)), None, doc, item, n), "item-firsts") for k in range(passes)]
    twos = [shared.store(_twos(narrow(_pass(once, item, k, passes)), doc, item), "item-twos") for k in range(passes)]
    far, out = [], []
    if any_wide:
        # Stored, so that few such rows are broadcast.
        theirs = shared.store(once.join(wide, doc, "left_semi").select(doc, item, "_n", "_labels"), "wide-items")
        near, back = (shared.store(_best(p, doc, n), "wide-pairs") for p in _wide_pairs(once, theirs, wide, doc, item))
        far = [near]
        named = back.select(doc, "other", "shared", F.explode("_items").alias(item)).join(theirs, [doc, item]).groupBy(doc, "other", "shared")
        out.append(shared.store(named.agg(_listed(F.flatten(F.collect_list(_names(F.col(item), F.col("_labels"))))).alias("labels")), "best-pairs"))
        shared.drop(theirs, back)
    for k, part in enumerate(parts):
        more = _all([_best(_several(_pass(_all(twos), doc, k, passes), doc, item), doc, n), *(_pass(x, doc, k, passes) for x in far)])
        out.append(shared.store(_chosen(narrow(part).join(_all(firsts), item), more, doc, item, n), "best-pairs"))
        shared.drop(part)
    shared.drop(wide, *firsts, *twos, *far)
    return _all(out)


def _items(rows: DataFrame, doc: str, item: str, label: str) -> DataFrame:
    """(doc, item, _n, _labels, _no, _rest): each doc's items once, numbered."""
    itself, by = F.col(label).eqNullSafe(F.col(item).cast("string")), [doc, item]
    once = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.count_if(itself).alias("_own"))
    # Sets are made of labels only that are not the item's own name: mostly there are none.
    once = once.join(rows.where(~itself).groupBy(*by).agg(F.collect_set(label).alias("_set")), by, "left")
    labels = F.when(F.col("_own") > 0, F.array_union("_set", F.array(F.col(item).cast("string")))).otherwise(F.col("_set"))
    once = once.select(*by, "_n", labels.alias("_labels"))
    return _with_rest(once.withColumn("_no", F.row_number().over(Window.partitionBy(doc).orderBy(item))), doc, item)


def _mixed_best(parts: list[DataFrame], light: DataFrame, heavy: DataFrame, sizes: list[DataFrame], doc: str, item: str, n: int) -> DataFrame:
    """cooccurrence() where some items are heavy."""
    once = _all(parts)
    held = shared.store(heavy.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(item).alias("i"), F.col("_n").alias("n")))).alias("_held")), "heavy-items")
    pairs, stored = _light_pairs(light, held, doc, item, n)
    # A bit of the mask for each heavy item of the doc.
    masks = F.explode(F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size("_held")) - 1))
    sets = held.select(doc, "_held", masks.alias("_mask")).withColumn("_set", F.filter("_held", lambda x, k: F.col("_mask").bitwiseAND(F.call_function("shiftleft", F.lit(1), k)) != 0))
    sets = sets.select(doc, F.transform("_set", lambda x: x["i"]).alias("_items"), F.transform("_set", lambda x: x["n"]).alias("_often"))
    place = F.row_number().over(Window.partitionBy("_items", "_often").orderBy(doc))
    first = sets.withColumn("_k", place).where(F.col("_k") <= n + 1).select("_items", F.col(doc).alias("other"))
    through = sets.select(doc, "_items").join(first, "_items").where(F.col(doc) != F.col("other")).select(doc, "other").distinct()
    none = F.lit(None).cast(once.schema[item].dataType).alias("_item")
    pairs = pairs.unionByName(through.select(doc, "other", F.lit(0).cast("long").alias("shared"), none)).groupBy(doc, "other").agg(F.sum("shared").alias("shared"), F.max("_item").alias("_item"))
    theirs = held.select(F.col(doc).alias("other"), F.map_from_entries("_held").alias("_theirs"))
    both = pairs.join(held, doc, "left").join(theirs, "other", "left")
    add = F.aggregate("_held", F.lit(0).cast("long"), lambda acc, x: acc + x["n"] * F.coalesce(F.try_element_at("_theirs", x["i"]), F.lit(0).cast("long")))
    both = both.withColumn("_add", F.coalesce(F.when(F.col("_theirs").isNotNull(), add), F.lit(0).cast("long")))
    pairs = both.select(doc, "other", (F.col("shared") + F.col("_add")).alias("shared"), F.when(F.col("_add") == 0, F.col("_item")).alias("_item"))
    # Labels of the pairs that are kept only: n for each doc.
    best = shared.store(_best(pairs, doc, n), "best-pairs")
    shared.drop(held, *sizes, *stored)
    names = _listed(_names(F.col("_item"), F.col("_labels"))).alias("labels")
    alone = best.where(F.col("_item").isNotNull()).join(once.select(doc, F.col(item).alias("_item"), "_labels"), [doc, "_item"]).select(doc, "other", "shared", names)
    return alone.unionByName(_named(best.where(F.col("_item").isNull()).select(doc, "other", "shared"), once, doc, item))


def cooccurrence(rows: DataFrame, doc: str, item: str, n: int, label: str) -> DataFrame:
    """Pairs (doc, other) that share items: join pairs and distinct labels; for each doc the n with most pairs, ties to the smaller other.

    rows is filtered to one doc's items on the left by the caller where only its neighbours are asked for.

    Exact without all pairs. Docs that share light items are found by _light_best(), or by _light_pairs() where others are heavy.
    Of heavy items each set that a doc has is taken together with how often it has each:
    docs of one such class share as much with whoever has the set, so that all
    but the n + 1 smallest of a class have at least n better ones before them.
    Only these are candidates, whatever the item's size. What a candidate pair
    shares is then counted in full, light and heavy items alike.
    """
    with shared.shuffles_dropped(rows.sparkSession):
        rows = rows.where(F.col(doc).isNotNull() & F.col(item).isNotNull())
        passes = max(1, -(-rows.count() // PASS_ROWS))
        parts = [shared.store(_items(_pass(rows, doc, k, passes), doc, item, label), "doc-items") for k in range(passes)]
        light, heavy, sizes = _split(_all(parts), doc, item, passes)
        if heavy is None:
            shared.drop(*sizes)
            return _light_best(parts, doc, item, n)
        return _mixed_best(parts, light.drop("_rest"), heavy, sizes, doc, item, n)


def where_or_in(rows: DataFrame, condition: Column, key: str, keys: DataFrame, keys_column: str) -> DataFrame:
    """Rows that meet the condition or whose key is among keys: one existence flag, no union."""
    flags = keys.select(F.col(keys_column).alias(key)).where(F.col(key).isNotNull()).distinct().withColumn("_in", F.lit(True))
    return rows.join(flags, key, "left").where(F.coalesce(condition, F.lit(False)) | F.col("_in").isNotNull()).drop("_in")


def expand(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """Edges (src, dst) reached from start (node) in at most ``depth`` steps, each way on its own:
    downwards only from nodes reached downwards, upwards only from nodes reached upwards."""
    found = None
    for near, far in (("src", "dst"), ("dst", "src")):
        frontier, seen = start.select("node").distinct(), start.select("node").distinct()
        for _ in range(depth):
            step = edges.join(frontier.select(F.col("node").alias(near)), near, "left_semi").select("src", "dst").distinct()
            found = step if found is None else found.unionByName(step)
            frontier = step.select(F.col(far).alias("node")).distinct().join(seen, "node", "left_anti")
            seen = seen.unionByName(frontier)
    return found.distinct()


def only(rows: DataFrame, what: str) -> Row:
    """The one row that rows should have; a LookupError that names it where there is none."""
    found = rows.head(1)
    if not found:
        raise LookupError(f"no such {what}")
    return found[0]
