"""The operators applied to relational tables; every query has an equivalent in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import globs, ids
from ..operators import graph, paths, ranges, traverse
from ..sources.relational import declarations, read, ref, relations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@query("""
SELECT 'line:' || l_orderkey || '-' || l_linenumber AS id, count(*)::BIGINT AS owners,
       CASE WHEN count(*) = 1 THEN 'resolved' ELSE 'ambiguous' END AS resolution
FROM lineitem GROUP BY l_orderkey, l_linenumber
""")
def d01_line_resolution(spark, sf):
    """Entities whose key has several owners are ambiguous."""
    owners = read(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("owners"))
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return owners.select(ref("line", key).alias("id"), "owners", graph.resolution_of(F.col("owners")).alias("resolution"))


@query("""
SELECT id || CASE WHEN n = 1 THEN '' ELSE '#' || n END AS id FROM (
  SELECT 'line:' || l_orderkey || '-' || l_linenumber AS id,
         row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS n
  FROM lineitem)
""")
def d02_occurrence_ordinals(spark, sf):
    """Repeated occurrence keys get an ordinal suffix."""
    order = W.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    rows = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(order).alias("n"))
    key = F.concat(F.lit("line:"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    return rows.select(F.when(F.col("n") == 1, key).otherwise(F.concat_ws("#", key, F.col("n").cast("string"))).alias("id"))


@query("""
SELECT md5(text) AS text_md5, count(*)::BIGINT AS owners, count(DISTINCT source)::BIGINT AS sources, min(doc_id) AS first_doc
FROM documents GROUP BY md5(text) HAVING count(*) > 1
""")
def d03_duplicate_owners(spark, sf):
    """Documents with the same text own one identity; those with several owners."""
    docs = read(spark, sf, "documents").select(F.md5(F.col("text").cast("binary")).alias("text_md5"), "source", "doc_id")
    groups = docs.groupBy("text_md5", "source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    return groups.groupBy("text_md5").agg(F.sum("n").alias("owners"), F.count("source").alias("sources"), F.min("first_doc").alias("first_doc")).filter("owners > 1")


@query("""
SELECT 'orders:' || o_orderkey AS id, 'orphan-detection' AS rule FROM orders
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
""")
def d04_orders_without_lines(spark, sf):
    """Entities without evidence."""
    orders, lines = read(spark, sf, "orders").select("o_orderkey"), read(spark, sf, "lineitem").select("l_orderkey")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left_anti").select(ref("orders", "o_orderkey").alias("id"), F.lit("orphan-detection").alias("rule"))


@query("""
SELECT 'orders:' || o_orderkey AS id FROM orders WHERE o_orderstatus = 'O'
AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F')
""")
def d05_open_without_finished(spark, sf):
    """The lifecycle gate, then the chain of evidence."""
    orders = read(spark, sf, "orders").filter("o_orderstatus = 'O'").select("o_orderkey")
    lines = read(spark, sf, "lineitem").filter("l_linestatus = 'F'").select("l_orderkey")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left_anti").select(ref("orders", "o_orderkey").alias("id"))


@query("""
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id,
       CASE WHEN l.doc_id IS NULL THEN 'doc-only' WHEN d.doc_id IS NULL THEN 'label-only' ELSE 'both' END AS state
FROM documents d FULL OUTER JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id
""")
def d06_correspondence(spark, sf):
    """Two sides of one identity, compared by a full outer join."""
    docs = read(spark, sf, "documents").select("doc_id", F.lit(True).alias("d"))
    labels = read(spark, sf, "labels").select("doc_id").distinct().withColumn("l", F.lit(True))
    state = F.when(F.col("l").isNull(), "doc-only").when(F.col("d").isNull(), "label-only").otherwise("both")
    return docs.join(labels, "doc_id", "full_outer").select("doc_id", state.alias("state"))


@query("""
SELECT 'orders:' || o_orderkey AS src, 'customer:' || o_custkey AS dst FROM orders
WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)
""")
def d07_dangling_targets(spark, sf):
    """Relations whose target is not declared; customers in debt count as removed."""
    known = read(spark, sf, "customer").filter("c_acctbal > 0").select("c_custkey")
    orders = read(spark, sf, "orders").select("o_orderkey", "o_custkey")
    found = orders.join(known, orders.o_custkey == known.c_custkey, "left_anti")
    return found.select(ref("orders", "o_orderkey").alias("src"), ref("customer", "o_custkey").alias("dst"))


@query("""
WITH k AS (
  SELECT DISTINCT 'customer:' || o_custkey AS src, 'supplier:' || l_suppkey AS dst, 'depends_on' AS type
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'
), b AS (
  SELECT DISTINCT 'supplier:' || l_suppkey AS src, 'customer:' || o_custkey AS dst, 'depended_by' AS type
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linestatus = 'F' AND l_returnflag <> 'N'
), e AS (SELECT * FROM k UNION ALL SELECT * FROM b)
SELECT e.src, e.dst, e.type, EXISTS (
  SELECT 1 FROM e r WHERE r.src = e.dst AND r.dst = e.src AND r.type = CASE e.type WHEN 'depends_on' THEN 'depended_by' ELSE 'depends_on' END) AS verified
FROM e
""")
def d08_verified_edges(spark, sf):
    """Edges are verified if the edge of the reverse type exists."""
    lines = read(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_linestatus")
    joined = read(spark, sf, "orders").select("o_orderkey", "o_custkey").join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    ends = [ref("customer", "o_custkey"), ref("supplier", "l_suppkey")]
    out = joined.filter("l_returnflag = 'R'").select(ends[0].alias("src"), ends[1].alias("dst"), F.lit("depends_on").alias("type")).distinct()
    back = joined.filter("l_linestatus = 'F' AND l_returnflag <> 'N'").select(ends[1].alias("src"), ends[0].alias("dst"), F.lit("depended_by").alias("type")).distinct()
    links = out.unionByName(back)
    return graph.verified(links, links.select(F.col("src").alias("id"))).select("src", "dst", "type", "verified")


@query("""
WITH e AS (
  SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
), n AS (
  SELECT 'region:' || r_regionkey AS id FROM region UNION ALL SELECT 'nation:' || n_nationkey FROM nation
  UNION ALL SELECT 'customer:' || c_custkey FROM customer
)
SELECT id, (SELECT count(*) FROM e WHERE dst = id)::BIGINT AS in_degree, (SELECT count(*) FROM e WHERE src = id)::BIGINT AS out_degree FROM n
""")
def d09_degrees(spark, sf):
    """In- and out-degree of every node, none left out."""
    return graph.degrees(declarations(spark, sf, ["region", "nation", "customer"]), relations(spark, sf, ["nation", "customer"]))


@query("""
SELECT 'part:' || p_partkey AS id FROM part
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1998-02-01')
""")
def d10_orphan_parts(spark, sf):
    """Nodes without an edge in a range of dates."""
    used = read(spark, sf, "lineitem").filter("l_shipdate >= TIMESTAMP_NTZ '1998-01-01' AND l_shipdate < TIMESTAMP_NTZ '1998-02-01'").select("l_partkey")
    parts = read(spark, sf, "part").select("p_partkey")
    return parts.join(used, parts.p_partkey == used.l_partkey, "left_anti").select(ref("part", "p_partkey").alias("id"))


@query("""
SELECT (SELECT count(*) FROM customer)::BIGINT AS customers, (SELECT count(*) FROM nation)::BIGINT AS nations,
       (SELECT count(*) FROM region)::BIGINT AS regions, (SELECT count(*) FROM supplier)::BIGINT AS suppliers
""")
def d11_statistics(spark, sf):
    """Counts of entities by kind, in one pass over the declarations."""
    kinds = {"customers": "customer", "nations": "nation", "regions": "region", "suppliers": "supplier"}
    found = declarations(spark, sf, list(kinds.values()))
    return found.agg(*[F.count_if(F.col("kind") == t).alias(n) for n, t in kinds.items()])


@query("SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 5")
def d12_top_types(spark, sf):
    """The five most frequent, ties by name."""
    return read(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(5)


@query("""
SELECT severity, rule, count(*)::BIGINT AS n, count(DISTINCT path)::BIGINT AS files FROM (
  SELECT 'error' AS severity, 'orphan-detection' AS rule, 'orders' AS path FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
  UNION ALL SELECT 'warning', 'negative-balance', 'customer:' || c_nationkey FROM customer WHERE c_acctbal < 0
  UNION ALL SELECT 'warning', 'negative-balance', 'supplier:' || s_nationkey FROM supplier WHERE s_acctbal < 0
) GROUP BY severity, rule
""")
def d13_grouped_findings(spark, sf):
    """Findings by severity and rule: how many, and in how many places."""
    orphans = d04_orders_without_lines(spark, sf).select(F.lit("error").alias("severity"), "rule", F.lit("orders").alias("path"))
    low = lambda t, p: read(spark, sf, t).filter(f"{p}_acctbal < 0").select(F.lit("warning").alias("severity"), F.lit("negative-balance").alias("rule"), ref(t, f"{p}_nationkey").alias("path"))
    found = orphans.unionByName(low("customer", "c")).unionByName(low("supplier", "s"))
    return found.groupBy("severity", "rule").agg(F.count("*").alias("n"), F.countDistinct("path").alias("files"))


@query("""
WITH RECURSIVE e AS (
  SELECT 'nation:' || n_nationkey AS a, 'region:' || n_regionkey AS b FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
), w AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT 'region:0' AS id, 0 AS depth UNION SELECT w.b, r.depth + 1 FROM r JOIN w ON w.a = r.id WHERE r.depth < 2)
SELECT id, min(depth)::INT AS depth FROM r GROUP BY id
""")
def d14_reach(spark, sf):
    """Entities within two relations of one, with the least distance."""
    links = relations(spark, sf, ["nation", "customer"])
    return traverse.hops(links, spark.createDataFrame([("region:0",)], "root_id string"), 2).select("id", F.col("depth").cast("int").alias("depth"))


@query("""
WITH e AS (
  SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
), one AS (SELECT src, dst FROM e WHERE dst = 'region:1'),
two AS (SELECT src, dst FROM e WHERE dst IN (SELECT src FROM one))
SELECT src, dst, 1 AS depth, 'inbound' AS direction FROM one UNION ALL SELECT src, dst, 2, 'inbound' FROM two
""")
def d15_trace_relations(spark, sf):
    """Relations with the depth and direction of their first discovery."""
    links = relations(spark, sf, ["nation", "customer"])
    known = declarations(spark, sf, ["region", "nation", "customer"])
    _, found = traverse.trace(spark.createDataFrame([("region:1",)], "root_id string"), links, known, 2)
    return found.select("src", "dst", "depth", "direction")


CHANGED = "l_shipdate >= {0} '1997-03-01' AND l_shipdate < {0} '1997-03-08'"


@query(f"""
WITH seed AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE {CHANGED.format('TIMESTAMP')})
SELECT 'orders:' || o_orderkey AS id, 1 AS distance, count(*)::BIGINT AS reasons FROM seed JOIN orders ON o_orderkey = l_orderkey GROUP BY o_orderkey
UNION ALL
SELECT 'customer:' || o_custkey, 2, count(*)::BIGINT FROM (SELECT DISTINCT o_orderkey, o_custkey FROM seed JOIN orders ON o_orderkey = l_orderkey) GROUP BY o_custkey
""")
def d16_impact_queue(spark, sf):
    """What changed lines reach: their orders, and those orders' customers, with the number of reasons."""
    lines = read(spark, sf, "lineitem").filter(CHANGED.format("TIMESTAMP_NTZ")).select("l_orderkey", "l_linenumber").distinct()
    orders = read(spark, sf, "orders").select("o_orderkey", "o_custkey")
    near = lines.join(orders, lines.l_orderkey == orders.o_orderkey).groupBy("o_orderkey", "o_custkey").agg(F.count("*").alias("reasons"))
    far = near.groupBy("o_custkey").agg(F.count("*").alias("reasons"))
    return near.select(ref("orders", "o_orderkey").alias("id"), F.lit(1).alias("distance"), "reasons").unionByName(far.select(ref("customer", "o_custkey").alias("id"), F.lit(2).alias("distance"), "reasons"))


@query(f"""
SELECT DISTINCT 'orders:' || o_orderkey AS id, 'related-spec-unchanged' AS rule FROM orders JOIN lineitem ON l_orderkey = o_orderkey
WHERE {CHANGED.format('TIMESTAMP')} AND NOT (o_orderdate >= TIMESTAMP '1997-03-01' AND o_orderdate < TIMESTAMP '1997-03-08')
""")
def d17_owner_unchanged(spark, sf):
    """Queued owners that did not change themselves."""
    lines = read(spark, sf, "lineitem").filter(CHANGED.format("TIMESTAMP_NTZ")).select("l_orderkey")
    orders = read(spark, sf, "orders").filter("NOT (o_orderdate >= TIMESTAMP_NTZ '1997-03-01' AND o_orderdate < TIMESTAMP_NTZ '1997-03-08')").select("o_orderkey")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left_semi").select(ref("orders", "o_orderkey").alias("id"), F.lit("related-spec-unchanged").alias("rule"))


@query("""
SELECT o_orderkey, l_linenumber, count(*)::BIGINT AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey
WHERE l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL '7' DAY GROUP BY o_orderkey, l_linenumber
""")
def d18_span_overlap(spark, sf):
    """Overlap of spans as the residue of an equality join."""
    orders = read(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    lines = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    met = orders.join(lines, (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("l_shipdate") >= F.col("o_orderdate")) & (F.col("l_shipdate") <= F.col("o_orderdate") + F.expr("INTERVAL '7' DAY")))
    return met.groupBy("o_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("""
SELECT event_id, (SELECT min(ts) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts > e.ts) AS next_ts
FROM events e WHERE event_type = 'error'
""")
def d19_next_purchase(spark, sf):
    """As-of forward: one window over both kinds, in place of a range join."""
    rows = read(spark, sf, "events").filter("event_type IN ('error', 'purchase')").select("user_id", "ts", "event_type", "event_id")
    ahead = W.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(1, W.unboundedFollowing)
    return rows.withColumn("next_ts", F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(ahead)).filter("event_type = 'error'").select("event_id", "next_ts")


@query("""
WITH s AS (SELECT user_id, min(ts) AS a, max(ts) AS b FROM events WHERE event_type = 'error' GROUP BY user_id)
SELECT event_id FROM events JOIN s USING (user_id) WHERE event_type = 'click' AND ts >= a AND ts <= b
""")
def d20_contained_events(spark, sf):
    """Events inside each user's range from the first to the last error."""
    rows = read(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    spans = rows.filter("event_type = 'error'").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return rows.filter("event_type = 'click'").join(spans, "user_id").filter("ts >= a AND ts <= b").select("event_id")


UNITS = ("**/*1", "https://*/**", "**/[02468]*")


@query(r"""
SELECT page_id, CASE WHEN n = 0 THEN 'unmapped' WHEN n = 1 THEN 'mapped' ELSE 'ambiguous' END AS state FROM (
  SELECT page_id, (regexp_matches(url, '^(?:[^/]+/)*[^/]*1$'))::INT + (regexp_matches(url, '^https://[^/]*/.*$'))::INT
         + (regexp_matches(url, '^(?:[^/]+/)*[02468][^/]*$'))::INT AS n FROM pages)
""")
def d21_unit_mapping(spark, sf):
    """Paths against unit globs: none, one or several match."""
    n = sum((F.col("url").rlike(globs.glob_regex(p)).cast("int") for p in UNITS[1:]), F.col("url").rlike(globs.glob_regex(UNITS[0])).cast("int"))
    state = F.when(n == 0, "unmapped").when(n == 1, "mapped").otherwise("ambiguous")
    return read(spark, sf, "pages").select("page_id", state.alias("state"))


@query("""
SELECT c.conv_id, r.role AS missing_role FROM (SELECT DISTINCT conv_id FROM conversations) c, (VALUES ('system'), ('user'), ('assistant'), ('tool')) r(role)
WHERE NOT EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = c.conv_id AND x.role = r.role)
""")
def d22_missing_roles(spark, sf):
    """Required roles minus those present, by one aggregate in place of a cross join."""
    present = read(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    required = F.array(*[F.lit(r) for r in ("system", "user", "assistant", "tool")])
    return present.select("conv_id", F.explode(F.array_except(required, "roles")).alias("missing_role"))


@query("""
SELECT doc_id, pos::INT AS line, string_split(text, chr(10))[pos] AS body
FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents)
""")
def d23_lines(spark, sf):
    """Every line of every document with its number."""
    return read(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "body")).select("doc_id", (F.col("p") + 1).cast("int").alias("line"), "body")


@query("""
SELECT md5(body) AS body_md5, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS docs
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS body FROM documents) WHERE body <> '' GROUP BY body HAVING count(*) > 1
""")
def d24_repeated_lines(spark, sf):
    """Lines that occur more than once; partial sums meet by (line, document) first."""
    lines = read(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("body")).filter("body <> ''")
    by_doc = lines.groupBy("body", "doc_id").agg(F.count("*").alias("n"))
    return by_doc.groupBy("body").agg(F.sum("n").alias("n"), F.count("*").alias("docs")).filter("n > 1").select(F.md5(F.col("body").cast("binary")).alias("body_md5"), "n", "docs")


@query("""SELECT page_id, href, count(*)::BIGINT AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) GROUP BY page_id, href""")
def d25_mentions(spark, sf):
    """References found in text, exploded and counted."""
    found = read(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return found.groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query("""
SELECT DISTINCT e.user_id, e.event_type FROM events e
WHERE NOT EXISTS (SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.event_type = e.event_type AND p.value > 50)
""")
def d26_plain_mentions(spark, sf):
    """Mentions without a structured occurrence at the same place."""
    rows = read(spark, sf, "events").select(F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("entity_id"), F.col("event_type").alias("path"), F.lit(1).alias("line"), "user_id", "event_type", "value")
    strong = rows.filter("value > 50").select("entity_id", "path", "line")
    return graph.plain_mentions(rows.drop("value"), strong).select("user_id", "event_type").distinct()


@query("""
SELECT src, dst, CASE split_part(src, ':', 1) WHEN 'nation' THEN 'nation' ELSE 'customer' END AS src_kind,
       CASE split_part(dst, ':', 1) WHEN 'region' THEN 'region' ELSE 'nation' END AS dst_kind, split_part(src, ':', 2) AS namespace FROM (
  SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer)
""")
def d27_inferred_kinds(spark, sf):
    """Kinds and namespaces that follow from identifiers alone."""
    links = relations(spark, sf, ["nation", "customer"])
    return links.select("src", "dst", ids.kind_of(F.col("src")).alias("src_kind"), ids.kind_of(F.col("dst")).alias("dst_kind"), ids.namespace_of(F.col("src")).alias("namespace"))


@query("""
SELECT doc_id, greatest(0, least(8000, 64000 - before))::BIGINT AS emitted FROM (
  SELECT doc_id, coalesce(sum(least(8000, strlen(text))) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM documents)
""")
def d28_running_budget(spark, sf):
    """A budget of bytes that runs down over each source's documents."""
    rows = read(spark, sf, "documents").select("doc_id", "source", F.least(F.lit(8000), F.octet_length("text")).alias("n"))
    spent = ranges.running_sum(rows, "source", ["doc_id"], F.col("n"))
    return spent.select("doc_id", F.greatest(F.lit(0), F.least(F.lit(8000), 64000 - F.col("before"))).cast("long").alias("emitted"))


@query("""
SELECT key, kind FROM (SELECT key, kind, row_number() OVER (PARTITION BY key ORDER BY kind) AS n FROM (
  SELECT c_nationkey AS key, 'customer' AS kind FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier)) WHERE n = 1
""")
def d29_merge_first_wins(spark, sf):
    """The bag of two sets, the first of each key."""
    a = read(spark, sf, "customer").select(F.col("c_nationkey").alias("key"), F.lit("customer").alias("kind"))
    b = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("key"), F.lit("supplier").alias("kind"))
    return graph.merge(a, b).groupBy("key").agg(F.min("kind").alias("kind"))


@query("""
SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1
""")
def d30_last_wins(spark, sf):
    """The last event of each user and type, by an aggregate that combines early."""
    last = read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("l"))
    return last.select("user_id", "event_type", "l.event_id", "l.value")


@query("""
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(p_type || ', ,' || p_brand || ',' || p_type, ','), lambda x: trim(x)), lambda x: x <> ''))), '|') AS refs FROM part
""")
def d31_list_parsing(spark, sf):
    """Comma lists: split, trimmed, emptied of blanks, distinct, sorted."""
    text = F.concat(F.col("p_type"), F.lit(", ,"), F.col("p_brand"), F.lit(","), F.col("p_type"))
    return read(spark, sf, "part").select("p_partkey", F.array_join(ids.distinct_sorted(ids.split_refs(text)), "|").alias("refs"))


@query(r"""
WITH r AS (SELECT DISTINCT regexp_extract(url, '^(https?://[^/]+)', 1) AS root FROM pages UNION SELECT DISTINCT regexp_extract(url, '^(https?://[^/]+/[^/]+)', 1) FROM pages)
SELECT page_id, max(len(root))::INT AS n FROM pages JOIN r ON root <> '' AND (url = root OR starts_with(url, root || '/')) GROUP BY page_id
""")
def d32_longest_prefix(spark, sf):
    """The deepest known root of each path: an equality join on its own prefixes."""
    pages = read(spark, sf, "pages").select("page_id", "url")
    host = pages.select(F.regexp_extract("url", "^(https?://[^/]+)", 1).alias("root"))
    deeper = pages.select(F.regexp_extract("url", "^(https?://[^/]+/[^/]+)", 1).alias("root"))
    roots = host.union(deeper).filter("root <> ''").distinct()
    found = paths.deepest(pages.select(F.col("url").alias("path")), roots)
    return pages.join(found.withColumnRenamed("path", "url"), "url").select("page_id", F.length("root").cast("int").alias("n"))


@query("""
WITH RECURSIVE e AS (SELECT 'nation:' || n_nationkey AS src, 'nation:' || ((n_nationkey * n_nationkey + 3) % 25) AS dst FROM nation),
r AS (SELECT src, dst, 1 AS d FROM e UNION SELECT r.src, e.dst, r.d + 1 FROM r JOIN e ON e.src = r.dst WHERE r.d < 32)
SELECT DISTINCT src AS id FROM r WHERE src = dst
""")
def d33_cycles(spark, sf):
    """Nodes on a cycle of a derived graph."""
    n = F.col("n_nationkey")
    links = read(spark, sf, "nation").select(ref("nation", n).alias("src"), ref("nation", (n * n + 3) % 25).alias("dst"))
    return traverse.cycles(links).select("id")


@query("""
WITH a AS (SELECT o_orderkey AS x, o_orderkey + 1 AS y FROM orders WHERE o_orderstatus = 'F'),
b AS (SELECT o_orderkey AS y, o_orderkey - 1 AS x FROM orders WHERE o_orderpriority <> '1-URGENT')
SELECT coalesce(a.x, b.x) AS old_key, coalesce(a.y, b.y) AS new_key, CASE WHEN b.x IS NULL THEN 'not-acknowledged' ELSE 'not-declared' END AS state
FROM a FULL OUTER JOIN b ON a.x = b.x AND a.y = b.y WHERE a.x IS NULL OR b.x IS NULL
""")
def d34_reciprocal_fields(spark, sf):
    """Two fields that must agree with each other, and do not."""
    orders = read(spark, sf, "orders")
    a = orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("old_key"), (F.col("o_orderkey") + 1).alias("new_key"), F.lit(True).alias("a"))
    b = orders.filter("o_orderpriority <> '1-URGENT'").select((F.col("o_orderkey") - 1).alias("old_key"), F.col("o_orderkey").alias("new_key"), F.lit(True).alias("b"))
    met = a.join(b, ["old_key", "new_key"], "full_outer").filter("a IS NULL OR b IS NULL")
    return met.select("old_key", "new_key", F.when(F.col("b").isNull(), "not-acknowledged").otherwise("not-declared").alias("state"))


@query("""
SELECT doc_id, field FROM (
  SELECT doc_id, 'source' AS field, CASE WHEN source IN ('src0', 'src1') THEN 'TODO' ELSE source END AS value FROM documents
  UNION ALL SELECT doc_id, 'lang', CASE WHEN lang = 'fr' THEN '' ELSE lang END FROM documents)
WHERE trim(value) = '' OR lower(trim(value)) IN ('tbd', 'todo', 'auto-generated', 'autogenerated')
""")
def d35_incomplete_fields(spark, sf):
    """Required fields that are empty or hold a placeholder: columns turned into rows."""
    rows = read(spark, sf, "documents").select("doc_id", F.when(F.col("source").isin("src0", "src1"), "TODO").otherwise(F.col("source")).alias("source"), F.when(F.col("lang") == "fr", "").otherwise(F.col("lang")).alias("lang"))
    fields = rows.unpivot("doc_id", ["source", "lang"], "field", "value")
    return fields.filter(~ids.complete(F.col("value"), F.lit(False))).select("doc_id", "field")


@query("""
SELECT conv_id, turn, role, CASE WHEN role = CASE lag(role) OVER w WHEN 'user' THEN 'assistant' WHEN 'assistant' THEN 'user' ELSE role END THEN TRUE ELSE FALSE END AS expected
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
""")
def d36_turn_order(spark, sf):
    """Whether each turn has the role that the one before asks for."""
    before = F.lag("role").over(W.partitionBy("conv_id").orderBy("turn", "role", "text"))
    due = F.when(before == "user", "assistant").when(before == "assistant", "user").otherwise(F.col("role"))
    return read(spark, sf, "conversations").select("conv_id", "turn", "role", F.coalesce(F.col("role") == due, F.lit(False)).alias("expected"))
