"""Queries over the relational tables: filters, joins, aggregates, windows, maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlens.operators import aggregates, events, joins, windows
from weftlens.plans.registry import Tables, query
from weftlens.sources import shared, store

AS_OF = "1998-06-01"


def _day(name: str):
    return F.col(name).cast("date")


@query("""SELECT l_partkey, count(DISTINCT o_orderkey)::BIGINT AS total,
 count(DISTINCT o_orderkey) FILTER (WHERE o_orderpriority='1-URGENT')::BIGINT AS urgent,
 count(DISTINCT o_orderkey) FILTER (WHERE o_orderpriority='2-HIGH')::BIGINT AS high,
 count(DISTINCT o_orderkey) FILTER (WHERE o_orderstatus='O')::BIGINT AS open,
 max(CAST(o_orderdate AS DATE)) AS latest_on
 FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY l_partkey""")
def entity_stats(t: Tables) -> DataFrame:
    n = t("lineitem").count()
    lines, orders = shared.dealt(t("lineitem").select("l_partkey", "l_orderkey"), n, "l_orderkey"), shared.dealt(t("orders"), n, "o_orderkey")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("day", _day("o_orderdate"))
    kinds = {"urgent": F.col("o_orderpriority") == "1-URGENT", "high": F.col("o_orderpriority") == "2-HIGH", "open": F.col("o_orderstatus") == "O"}
    return aggregates.entity_stats(rows, "l_partkey", "o_orderkey", kinds, "day")


@query("""SELECT year(o_orderdate)::BIGINT AS year, count(*) FILTER (WHERE o_orderstatus='O')::BIGINT AS open,
 count(*) FILTER (WHERE o_orderstatus='F')::BIGINT AS filled, count(*) FILTER (WHERE o_orderstatus='P')::BIGINT AS pending
 FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1""")
def yearly_split(t: Tables) -> DataFrame:
    status = F.col("o_orderstatus")
    return aggregates.yearly_split(t("orders"), "o_orderdate", {"open": status == "O", "filled": status == "F", "pending": status == "P"})


@query("""SELECT n_name, count(DISTINCT o_orderkey)::BIGINT AS docs FROM orders JOIN customer ON o_custkey=c_custkey
 JOIN nation ON c_nationkey=n_nationkey GROUP BY n_name ORDER BY docs DESC, n_name LIMIT 12""")
def top_groups(t: Tables) -> DataFrame:
    rows = t("orders").select("o_orderkey", "o_custkey").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    # nation has 25 rows, whatever the scale.
    rows = rows.join(F.broadcast(t("nation").select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))
    return aggregates.top_groups(rows, "n_name", "o_orderkey", 12)


@query("""SELECT c_mktsegment, count(*)::BIGINT AS docs, count(o)::BIGINT AS linked, round(count(o)::DOUBLE/count(*),3) AS rate
 FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS o FROM orders) ON o=c_custkey GROUP BY c_mktsegment""")
def coverage_rate(t: Tables) -> DataFrame:
    return aggregates.coverage(t("customer"), "c_custkey", t("orders"), "o_custkey", "c_mktsegment")


@query("""WITH per AS (SELECT l_orderkey, count(DISTINCT l_partkey) n, bool_or(l_returnflag='R') r, bool_or(l_linestatus='F') f FROM lineitem GROUP BY 1)
 SELECT count(*)::BIGINT AS keys, count(*) FILTER (WHERE n>1)::BIGINT AS multi, count(*) FILTER (WHERE r AND f)::BIGINT AS all_flags, round(avg(n),1) AS avg_members FROM per""")
def two_level_spread(t: Tables) -> DataFrame:
    flags = {"returned": F.col("l_returnflag") == "R", "final": F.col("l_linestatus") == "F"}
    return aggregates.spread(t("lineitem"), "l_orderkey", "l_partkey", flags)


@query("""SELECT p_brand, count(DISTINCT p_partkey)::BIGINT AS parts, count(DISTINCT p_partkey) FILTER (WHERE l_returnflag='R')::BIGINT AS returned,
 min(CAST(l_shipdate AS DATE)) AS first_on FROM part LEFT JOIN lineitem ON p_partkey=l_partkey GROUP BY p_brand""")
def filtered_distinct_left(t: Tables) -> DataFrame:
    per = t("lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("r"), F.min(_day("l_shipdate")).alias("first_on"))
    rows = t("part").select("p_partkey", "p_brand").join(per, "p_partkey", "left")
    return rows.groupBy("p_brand").agg(F.count_distinct("p_partkey").alias("parts"), F.count_distinct(F.when(F.col("r"), F.col("p_partkey"))).alias("returned"), F.min("first_on").alias("first_on"))


@query(f"""SELECT o_orderstatus, count(*)::BIGINT AS n, count(*) FILTER (WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '{AS_OF}' - 90 AND DATE '{AS_OF}')::BIGINT AS recent,
 count(*) FILTER (WHERE CAST(o_orderdate AS DATE) > DATE '{AS_OF}')::BIGINT AS later, round(avg(DATE '{AS_OF}' - CAST(o_orderdate AS DATE)),1) AS avg_days FROM orders GROUP BY 1""")
def status_counters(t: Tables) -> DataFrame:
    day, as_of = _day("o_orderdate"), F.lit(AS_OF).cast("date")
    return t("orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if(day.between(F.date_sub(as_of, 90), as_of)).alias("recent"), F.count_if(day > as_of).alias("later"), F.round(F.avg(F.datediff(as_of, day)), 1).alias("avg_days"))


@query("""SELECT r_name, (SELECT count(*) FROM nation WHERE n_regionkey=r_regionkey)::BIGINT AS nations,
 (SELECT count(*) FROM customer JOIN nation ON c_nationkey=n_nationkey WHERE n_regionkey=r_regionkey)::BIGINT AS customers,
 (SELECT count(*) FROM customer JOIN nation ON c_nationkey=n_nationkey WHERE n_regionkey=r_regionkey AND c_acctbal<0)::BIGINT AS in_debt,
 (SELECT count(*) FROM supplier JOIN nation ON s_nationkey=n_nationkey WHERE n_regionkey=r_regionkey)::BIGINT AS suppliers
 FROM region WHERE (SELECT count(*) FROM customer JOIN nation ON c_nationkey=n_nationkey WHERE n_regionkey=r_regionkey)>0""")
def structure_matrix(t: Tables) -> DataFrame:
    # region and nation have 5 and 25 rows, whatever the scale.
    nation, zero = F.broadcast(t("nation").select("n_nationkey", "n_regionkey")), F.lit(0).cast("long")
    customers = t("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("c"), F.count_if(F.col("c_acctbal") < 0).alias("d"))
    suppliers = t("supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("s"))
    per = nation.join(customers, "n_nationkey", "left").join(suppliers, "n_nationkey", "left").groupBy(F.col("n_regionkey").alias("r_regionkey"))
    per = per.agg(F.count("*").alias("nations"), *[F.coalesce(F.sum(x), zero).alias(n) for x, n in (("c", "customers"), ("d", "in_debt"), ("s", "suppliers"))])
    return t("region").join(per, "r_regionkey").where("customers > 0").select("r_name", "nations", "customers", "in_debt", "suppliers")


@query("""SELECT p_type, count(*)::BIGINT AS parts, sum(coalesce(n,0))::BIGINT AS linked FROM part LEFT JOIN (SELECT l_partkey, count(DISTINCT l_orderkey) n FROM lineitem GROUP BY 1) ON l_partkey=p_partkey
 GROUP BY p_type HAVING sum(coalesce(n,0))>0""")
def group_having(t: Tables) -> DataFrame:
    per = t("lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count_distinct("l_orderkey").alias("n"))
    return t("part").join(per, "p_partkey", "left").groupBy("p_type").agg(F.count("*").alias("parts"), F.sum(F.coalesce("n", F.lit(0))).alias("linked")).where("linked > 0")


@query("""SELECT l_orderkey, array_to_string(list_sort(array_agg(DISTINCT l_returnflag) FILTER (WHERE l_returnflag IS NOT NULL)), ',') AS flags FROM lineitem GROUP BY 1""")
def array_agg_distinct(t: Tables) -> DataFrame:
    return aggregates.sorted_distinct(t("lineitem"), "l_orderkey", "l_returnflag", "flags")


@query("""WITH mine AS (SELECT l_orderkey, l_partkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL), p AS (
 SELECT a.l_orderkey, b.l_orderkey AS other, sum(a.n * b.n)::BIGINT AS shared, string_agg(DISTINCT a.l_partkey || a.l_returnflag, ',' ORDER BY a.l_partkey || a.l_returnflag) AS labels
 FROM mine a JOIN mine b ON a.l_partkey=b.l_partkey AND a.l_returnflag=b.l_returnflag AND a.l_orderkey<>b.l_orderkey GROUP BY 1,2)
 SELECT l_orderkey, other, shared, labels FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY shared DESC, other) k FROM p) WHERE k<=6""")
def cooccurrence(t: Tables) -> DataFrame:
    """Orders that share a part with the same return flag."""
    label = F.concat(F.col("l_partkey").cast("string"), "l_returnflag")
    mine = t("lineitem").select("l_orderkey", label.alias("item"), label.alias("label"))
    return joins.cooccurrence(mine, "l_orderkey", "item", 6, "label")


@query("""WITH p AS (SELECT a.l_orderkey, b.l_orderkey AS other, count(*)::BIGINT AS shared, string_agg(DISTINCT a.l_partkey::VARCHAR, ',' ORDER BY a.l_partkey::VARCHAR) AS labels
 FROM lineitem a JOIN lineitem b ON a.l_partkey=b.l_partkey AND a.l_orderkey<>b.l_orderkey GROUP BY 1,2)
 SELECT l_orderkey, other, shared, labels FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY shared DESC, other) k FROM p) WHERE k<=6""")
def cooccurrence_all(t: Tables) -> DataFrame:
    rows = t("lineitem").select("l_orderkey", "l_partkey", F.col("l_partkey").cast("string").alias("label"))
    return joins.cooccurrence(rows, "l_orderkey", "l_partkey", 6, "label")


@query("""SELECT l_orderkey, l_partkey, max(l_quantity) AS weight, min(l_returnflag) AS method FROM lineitem GROUP BY 1,2""")
def edge_agg(t: Tables) -> DataFrame:
    return aggregates.edges(t("lineitem"), "l_orderkey", "l_partkey", "l_quantity", "l_returnflag")


@query("""WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1,2),
 r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS c FROM d)
 SELECT event_type, n::BIGINT AS median FROM r WHERE k = c // 2""")
def median_spike(t: Tables) -> DataFrame:
    daily = t("events").groupBy("event_type", _day("ts").alias("day")).agg(F.count("*").alias("n"))
    return aggregates.upper_median(daily, "n", "event_type")


@query("""SELECT event_type, event_id, place::BIGINT AS place, greatest(n-3,0)::BIGINT AS more FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC NULLS FIRST, event_id) place,
 count(*) OVER (PARTITION BY event_type) n FROM events) WHERE place<=3""")
def topk_per_group(t: Tables) -> DataFrame:
    order = [F.col("ts").desc_nulls_first(), F.col("event_id").asc()]
    return windows.topk_with_remainder(t("events").select("event_type", "event_id", "ts"), "event_type", order, 3).select("event_type", "event_id", "place", "more")


@query("""SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus='O')::BIGINT AS total FROM orders WHERE o_orderstatus='O'
 ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 40""")
def page_with_total(t: Tables) -> DataFrame:
    rows = t("orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_totalprice")
    return windows.page_with_total(rows, [F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey").asc()], 20, 40)


@query("""WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events)
 SELECT user_id, day, lead(day) OVER (PARTITION BY user_id ORDER BY day) - 1 AS effective_to FROM d""")
def interval_close(t: Tables) -> DataFrame:
    return windows.close_intervals(t("events").select("user_id", _day("ts").alias("day")).distinct(), "user_id", "day")


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) k FROM events) WHERE k=1""")
def distinct_on(t: Tables) -> DataFrame:
    return windows.latest_per(t("events"), ["user_id", "event_type"], ["ts", "event_id"], ["event_id", "value"])


@query("""WITH c AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type OR row_number() OVER w = 1 THEN 1 ELSE 0 END ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) run FROM c)
 SELECT user_id, run::BIGINT AS run, event_type, count(*)::BIGINT AS length, min(ts) AS first_at FROM r GROUP BY 1,2,3""")
def islands(t: Tables) -> DataFrame:
    return windows.islands(t("events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], "event_type")


@query("""WITH f AS (SELECT l_orderkey, l_partkey, min(l_linenumber) o FROM lineitem GROUP BY 1,2), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY o, l_partkey) k FROM f)
 SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY k) AS parts FROM r WHERE k<=3 GROUP BY 1""")
def first_n_list(t: Tables) -> DataFrame:
    return windows.first_distinct(t("lineitem"), "l_orderkey", "l_partkey", ["l_linenumber"], 3, "parts")


@query(f"""SELECT o_custkey, max_by(o_orderkey, (CAST(o_orderdate AS DATE), o_orderkey)) FILTER (WHERE CAST(o_orderdate AS DATE) <= DATE '{AS_OF}') AS current,
 min_by(o_orderkey, (CAST(o_orderdate AS DATE), o_orderkey)) FILTER (WHERE CAST(o_orderdate AS DATE) > DATE '{AS_OF}') AS pending FROM orders GROUP BY 1""")
def current_pending(t: Tables) -> DataFrame:
    rows = t("orders").select("o_custkey", _day("o_orderdate").alias("day"), "o_orderkey")
    return windows.current_and_pending(rows, "o_custkey", "day", "o_orderkey", F.lit(AS_OF).cast("date"))


@query("""SELECT p_partkey, p_size, lag(p_partkey) OVER w AS previous, lead(p_partkey) OVER w AS next FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size, p_partkey)""")
def neighbours(t: Tables) -> DataFrame:
    return windows.neighbours(t("part"), "p_brand", ["p_size", "p_partkey"], "p_partkey").select("p_partkey", "p_size", "previous", "next")


@query("""WITH e AS (SELECT user_id, ts, max_by(value, event_id) AS v FROM events GROUP BY 1,2)
 SELECT a.event_id, e.v AS before FROM events a ASOF LEFT JOIN e ON a.user_id=e.user_id AND a.ts > e.ts""")
def asof_join(t: Tables) -> DataFrame:
    return joins.as_of_before(t("events").select("event_id", "user_id", "ts", "value"), "user_id", "ts", "event_id", "value", "before").select("event_id", "before")


@query("""SELECT o_orderkey FROM orders WHERE o_orderpriority='1-URGENT' OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment='BUILDING')""")
def or_in_subquery(t: Tables) -> DataFrame:
    keys = t("customer").where("c_mktsegment = 'BUILDING'")
    return joins.where_or_in(t("orders"), F.col("o_orderpriority") == "1-URGENT", "o_custkey", keys, "c_custkey").select("o_orderkey")


@query("""SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_orderpriority='1-URGENT')""")
def semi(t: Tables) -> DataFrame:
    return t("customer").join(t("orders").where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_orderpriority='1-URGENT')""")
def anti(t: Tables) -> DataFrame:
    return t("customer").join(t("orders").where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""SELECT o_orderkey, coalesce(c_mktsegment,'-') AS segment, coalesce(n_name,'-') AS nation FROM orders LEFT JOIN customer ON o_custkey=c_custkey LEFT JOIN nation ON c_nationkey=n_nationkey""")
def left_enrich(t: Tables) -> DataFrame:
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.select("o_orderkey", F.coalesce("c_mktsegment", F.lit("-")).alias("segment"), F.coalesce("n_name", F.lit("-")).alias("nation"))


@query("""SELECT o_orderkey, list_position(['P','O'], o_orderstatus)::BIGINT AS place FROM orders ORDER BY place NULLS LAST, (o_totalprice > 200000) DESC, o_orderkey""")
def enum_order(t: Tables) -> DataFrame:
    place = F.nullif(F.array_position(F.array(F.lit("P"), F.lit("O")), F.col("o_orderstatus")), F.lit(0).cast("long"))
    rows = t("orders").withColumn("place", place)
    return rows.orderBy(F.col("place").asc_nulls_last(), (F.col("o_totalprice") > 200000).desc(), "o_orderkey").select("o_orderkey", "place")


@query("""SELECT o_orderkey, list_position(['P','O'], o_orderstatus)::BIGINT AS place, o_totalprice > 200000 AS large FROM orders ORDER BY place NULLS LAST, large DESC, o_orderkey""")
def enum_order_all(t: Tables) -> DataFrame:
    place = F.nullif(F.array_position(F.array(F.lit("P"), F.lit("O")), F.col("o_orderstatus")), F.lit(0).cast("long"))
    rows = t("orders").select("o_orderkey", place.alias("place"), (F.col("o_totalprice") > 200000).alias("large"))
    return rows.orderBy(F.col("place").asc_nulls_last(), F.col("large").desc_nulls_last(), "o_orderkey")


@query("""SELECT o_custkey AS k FROM orders WHERE o_orderstatus='P' UNION SELECT c_custkey FROM customer WHERE c_acctbal<0""")
def set_union(t: Tables) -> DataFrame:
    return t("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")).union(t("customer").where("c_acctbal < 0").select("c_custkey")).distinct()


@query("""WITH RECURSIVE e AS (SELECT 'r'||r_regionkey AS src, 'n'||n_nationkey AS dst FROM region JOIN nation ON n_regionkey=r_regionkey
 UNION ALL SELECT 'n'||c_nationkey, 'c'||c_custkey FROM customer),
 d1 AS (SELECT * FROM e WHERE src='n3'), d2 AS (SELECT * FROM e WHERE src IN (SELECT dst FROM d1)), u1 AS (SELECT * FROM e WHERE dst='n3'), u2 AS (SELECT * FROM e WHERE dst IN (SELECT src FROM u1))
 SELECT * FROM d1 UNION SELECT * FROM d2 UNION SELECT * FROM u1 UNION SELECT * FROM u2""")
def graph_expand(t: Tables) -> DataFrame:
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    edges = t("nation").select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst"))
    edges = edges.unionByName(t("customer").select(name("n", "c_nationkey").alias("src"), name("c", "c_custkey").alias("dst")))
    return joins.expand(edges, t("nation").where("n_nationkey = 3").select(name("n", "n_nationkey").alias("node")), 2)


@query("""SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND event_type IN ('click','purchase','view') AND (user_id % 7 = 0 OR user_id IN (SELECT user_id FROM events WHERE value > 95))
 ORDER BY ts DESC NULLS LAST, event_id LIMIT 50""")
def feed(t: Tables) -> DataFrame:
    rows = t("events")
    keen = rows.where("value > 95").select("user_id").distinct().withColumn("keen", F.lit(True))
    joined = rows.join(keen, "user_id", "left")
    interest = events.any_interest(F.col("user_id") % 7 == 0, F.coalesce("keen", F.lit(False)))
    got = events.feed(joined, ["click", "purchase", "view"], interest, F.lit("2024-01-05").cast("timestamp_ntz"), [F.col("ts").desc_nulls_last(), F.col("event_id").asc()], 50)
    return got["items"].select("event_id", "user_id", "event_type")


@query(f"""SELECT o_orderkey, CASE WHEN s > DATE '{AS_OF}' THEN 'notice' WHEN e < DATE '{AS_OF}' THEN 'expired' WHEN e <= DATE '{AS_OF}' + 30 THEN 'expiring' ELSE 'active' END AS status,
 round(greatest(0, least(100, (DATE '{AS_OF}' - s) * 100.0::DOUBLE / (e - s)))) AS progress
 FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderdate AS DATE) + 90 + (o_orderkey % 200)::INT END AS e FROM orders)""")
def validity(t: Tables) -> DataFrame:
    from weftlens.functions.text import progress

    as_of = F.lit(AS_OF).cast("date")
    ends = F.when(F.col("o_orderkey") % 10 != 0, F.date_add("s", (90 + F.col("o_orderkey") % 200).cast("int")))
    rows = events.validity(t("orders").select("o_orderkey", _day("o_orderdate").alias("s")).withColumn("e", ends), "s", "e", as_of, 30)
    return rows.select("o_orderkey", "status", progress(F.col("s"), F.col("e"), as_of).alias("progress"))


@query(f"""SELECT 'new' AS kind, CAST(o_orderdate AS DATE) AS occurred_on, 'new:'||o_orderkey AS dedupe_key FROM orders
 UNION ALL SELECT 'open', DATE '{AS_OF}', 'open:'||o_orderkey||':'||CAST(o_orderdate AS DATE) FROM orders WHERE o_orderstatus='O' AND CAST(o_orderdate AS DATE) BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + 30
 UNION ALL SELECT 'big', CAST(o_orderdate AS DATE), 'big:'||o_orderkey FROM orders WHERE o_totalprice > 300000""")
def event_rules(t: Tables) -> DataFrame:
    day, as_of = _day("o_orderdate"), F.lit(AS_OF).cast("date")
    key = lambda kind, *more: F.concat_ws(":", F.lit(kind), F.col("o_orderkey").cast("string"), *more)
    rules = [
        ("new", F.lit(True), day, key("new")),
        ("open", (F.col("o_orderstatus") == "O") & day.between(as_of, F.date_add(as_of, 30)), as_of, key("open", day.cast("string"))),
        ("big", F.col("o_totalprice") > 300000, day, key("big")),
    ]
    found = events.by_rules(t("orders"), rules).select("kind", "occurred_on", "dedupe_key")
    return store.append_events(found, found.limit(0))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' WHEN o_orderkey % 3 = 1 THEN 'changed' ELSE 'same' END AS state FROM orders""")
def upsert_classify(t: Tables) -> DataFrame:
    rows = t("orders").select("o_orderkey", store.content_hash(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("digest"))
    old = rows.where("o_orderkey % 3 <> 0").withColumn("digest", F.when(F.col("o_orderkey") % 3 == 1, "before").otherwise(F.col("digest")))
    return store.classify(rows, old, "o_orderkey", "digest")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_name || '*' END AS c_name, CASE WHEN c_custkey % 4 = 1 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 2 = 1""")
def upsert_coalesce(t: Tables) -> DataFrame:
    rows = t("customer").select("c_custkey", "c_name", "c_acctbal")
    fresh = rows.where("c_custkey % 2 = 1").select("c_custkey", F.concat("c_name", F.lit("*")).alias("c_name"), F.when(F.col("c_custkey") % 4 == 1, 0.0).alias("c_acctbal"))
    return store.upsert(fresh, rows.where("c_custkey % 5 <> 0"), "c_custkey", ["c_acctbal"]).where("c_acctbal IS NOT NULL OR true").join(rows.select("c_custkey", F.col("c_acctbal").alias("b")), "c_custkey").select("c_custkey", "c_name", F.coalesce("c_acctbal", "b").alias("c_acctbal"))


@query("""SELECT l_partkey, l_suppkey, CASE WHEN bool_or(l_returnflag='N') THEN 'N' WHEN bool_or(l_returnflag='R') THEN 'R' ELSE 'A' END AS l_returnflag FROM lineitem GROUP BY 1,2""")
def priority_upsert(t: Tables) -> DataFrame:
    return store.by_priority(t("lineitem"), ["l_partkey", "l_suppkey"], "l_returnflag", ["N", "R", "A"])


@query("""WITH o AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus='P') SELECT c_custkey FROM customer JOIN o ON o_custkey=c_custkey""")
def cascade_prune(t: Tables) -> DataFrame:
    kept = t("orders").where("o_orderstatus = 'P'").select("o_custkey").distinct()
    return store.prune(kept, {"customer": (t("customer").select("c_custkey"), "c_custkey")})["customer"]


@query("""WITH n AS (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber=1), o AS (SELECT l_orderkey, l_partkey, (l_partkey % 5 = 0) AS rev FROM lineitem WHERE l_linenumber>1),
 good AS (SELECT DISTINCT n.* FROM n JOIN part ON p_partkey=l_partkey WHERE p_size > 5),
 kept AS (SELECT l_orderkey, l_partkey FROM o WHERE rev UNION ALL SELECT l_orderkey, l_partkey FROM o WHERE NOT rev AND l_orderkey NOT IN (SELECT l_orderkey FROM n))
 SELECT * FROM kept UNION ALL SELECT * FROM good g WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.l_orderkey=g.l_orderkey AND k.l_partkey=g.l_partkey)""")
def replace_per_key(t: Tables) -> DataFrame:
    rows = t("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", (F.col("l_partkey") % 5 == 0).alias("reviewed"))
    new, old = rows.where("l_linenumber = 1").drop("l_linenumber").distinct(), rows.where("l_linenumber > 1").drop("l_linenumber")
    kept, _ = store.replace_per_key(old, new, "l_orderkey", "reviewed", "l_partkey", t("part").where("p_size > 5").select(F.col("p_partkey").alias("l_partkey")))
    return kept.select("l_orderkey", "l_partkey")
