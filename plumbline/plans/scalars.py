"""Projections, filters and predicates (P rows) and string functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import ordered
from .registry import Tables, query


@query("""SELECT event_id, CASE WHEN value > 0 THEN round(ln(value), 6) END AS log_value,
 CASE WHEN value % 7 < 1 THEN NULL ELSE round(value, 6) END AS guarded FROM events""")
def guarded_projection(t: Tables) -> DataFrame:
    holed = F.when(F.col("value") % 7 < 1, F.lit(float("nan"))).otherwise(F.col("value"))
    log = F.when(F.col("value") > 0, F.round(F.ln("value"), 6))
    return t.events.select("event_id", log.alias("log_value"), F.round(S.finite(holed), 6).alias("guarded"))


@query("""SELECT o_custkey, o_orderdate::DATE AS day, o_totalprice FROM orders WHERE o_totalprice IS NOT NULL AND isfinite(o_totalprice) AND o_orderdate IS NOT NULL""")
def valid_points(t: Tables) -> DataFrame:
    day = F.try_to_date(F.date_format("o_orderdate", "yyyy-MM-dd"), "yyyy-MM-dd")
    points = t.orders.select("o_custkey", day.alias("day"), S.finite(F.col("o_totalprice")).alias("o_totalprice"))
    return points.filter("o_totalprice IS NOT NULL AND day IS NOT NULL")


@query("""SELECT c_custkey, round(log10(c_acctbal), 6) AS log_balance FROM customer WHERE c_acctbal > 0""")
def positive_domain(t: Tables) -> DataFrame:
    return t.customer.filter("c_acctbal > 0").select("c_custkey", F.round(F.log10("c_acctbal"), 6).alias("log_balance"))


@query("""SELECT o_orderkey, CASE upper(o_orderstatus) WHEN 'F' THEN 'KEEP' WHEN 'P' THEN 'SCREEN' ELSE 'KILLED' END AS verdict FROM orders""")
def case_equality(t: Tables) -> DataFrame:
    status = F.upper("o_orderstatus")
    return t.orders.select("o_orderkey", S.first_match([(status == "F", "KEEP"), (status == "P", "SCREEN")], "KILLED").alias("verdict"))


@query("""SELECT p_partkey, CASE WHEN contains(upper(p_type), 'STEEL') THEN 'pass' WHEN contains(upper(p_type), 'BRASS') THEN 'fail'
 WHEN contains(upper(p_type), 'A') THEN 'drop' ELSE 'reserved' END AS outcome FROM part""")
def case_substring_precedence(t: Tables) -> DataFrame:
    has = lambda word: F.contains(F.upper("p_type"), F.lit(word))
    return t.part.select("p_partkey", S.first_match([(has("STEEL"), "pass"), (has("BRASS"), "fail"), (has("A"), "drop")], "reserved").alias("outcome"))


@query("""SELECT o_orderkey, CASE WHEN starts_with(o_orderpriority, '1') THEN 'measured' WHEN starts_with(o_orderpriority, '2') THEN 'modeled'
 WHEN o_orderpriority = '5-LOW' THEN 'none' ELSE 'neutral' END AS tone FROM orders""")
def case_prefix(t: Tables) -> DataFrame:
    p = F.col("o_orderpriority")
    return t.orders.select("o_orderkey", S.first_match([(p.startswith("1"), "measured"), (p.startswith("2"), "modeled"), (p == "5-LOW", "none")], "neutral").alias("tone"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'FILLED' WHEN 'O' THEN 'OPEN' ELSE 'QUEUED' END AS label FROM orders""")
def status_map_default(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", S.lookup(F.col("o_orderstatus"), {"F": "FILLED", "O": "OPEN"}, F.lit("QUEUED")).alias("label"))


@query("""WITH m AS (SELECT user_id, event_type, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END, event_type) AS k FROM m WHERE n > 2)
 SELECT user_id, event_type AS horizon, mean FROM r WHERE k = 1""")
def first_available_horizon(t: Tables) -> DataFrame:
    groups = t.events.groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))
    preference = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "signup", 2).otherwise(3)
    best = F.min_by(F.struct("event_type", "mean"), F.struct(preference, "event_type"))
    return groups.filter("n > 2").groupBy("user_id").agg(best.alias("b")).select("user_id", F.col("b.event_type").alias("horizon"), "b.mean")


@query("""SELECT l_orderkey, l_linenumber, coalesce(nullif(l_discount, 0), l_tax) AS rate, CASE WHEN l_discount <> 0 THEN 'discount' ELSE 'tax' END AS source FROM lineitem""")
def coalesce_with_source(t: Tables) -> DataFrame:
    first = F.nullif(F.col("l_discount"), F.lit(0.0))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.coalesce(first, "l_tax").alias("rate"), F.when(first.isNotNull(), "discount").otherwise("tax").alias("source"))


@query("""WITH b AS (SELECT user_id, min(CASE WHEN event_type = 'click' THEN value END) AS lo, max(CASE WHEN event_type = 'error' THEN value END) AS hi FROM events GROUP BY 1)
 SELECT user_id, round(coalesce((lo + hi) / 2, lo, hi), 6) AS mid FROM b WHERE coalesce(lo, hi) IS NOT NULL""")
def band_midpoint(t: Tables) -> DataFrame:
    of = lambda kind: F.when(F.col("event_type") == kind, F.col("value"))
    bands = t.events.groupBy("user_id").agg(F.min(of("click")).alias("lo"), F.max(of("error")).alias("hi"))
    return bands.select("user_id", F.round(S.midpoint(F.col("lo"), F.col("hi")), 6).alias("mid")).filter("mid IS NOT NULL")


@query("""SELECT user_id, count(*) AS points FROM events WHERE event_type <> 'error' GROUP BY 1 HAVING count(*) >= 2 OR bool_or(value > 100 AND event_type = 'purchase')""")
def live_payload_gate(t: Tables) -> DataFrame:
    live = t.events.filter("event_type <> 'error'").groupBy("user_id").agg(F.count("*").alias("points"), F.bool_or(F.expr("value > 100 AND event_type = 'purchase'")).alias("measured"))
    return live.filter("points >= 2 OR measured").drop("measured")


@query("""WITH a AS (SELECT page_id, lower(trim(replace(regexp_replace(url, '^https?://', ''), '/', '@'))) AS address FROM pages)
 SELECT page_id, address, address <> '' AND length(address) <= 254 AND regexp_matches(address, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') AS valid FROM a""")
def input_validation(t: Tables) -> DataFrame:
    address = F.lower(F.trim(F.replace(F.regexp_replace("url", "^https?://", ""), F.lit("/"), F.lit("@"))))
    return t.pages.select("page_id", address.alias("address")).withColumn("valid", S.valid_address(F.col("address")))


@query("""SELECT event_id, ts FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00'""")
def clamp_as_of(t: Tables) -> DataFrame:
    return t.events.filter(F.col("ts") <= F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")).select("event_id", "ts")


@query("""SELECT l_orderkey, l_linenumber, round(l_discount * 100, 1) AS discount_pct, CASE WHEN l_tax = 0 THEN 'untaxed' ELSE 'taxed' END AS label FROM lineitem""")
def unit_projection(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(F.col("l_discount") * 100, 1).alias("discount_pct"), F.when(F.col("l_tax") == 0, "untaxed").otherwise("taxed").alias("label"))


@query("""WITH w AS (SELECT o_custkey, o_orderpriority, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY o_custkey), 0)::INT AS pct FROM orders GROUP BY 1, 2)
 SELECT o_custkey, coalesce(string_agg(o_orderpriority || ' ' || pct || '%', ' / ' ORDER BY pct DESC, o_orderpriority), 'flat') AS label FROM w GROUP BY 1""")
def composed_label(t: Tables) -> DataFrame:
    counts = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    totals = counts.groupBy("o_custkey").agg(F.sum("n").alias("total"), F.collect_list(F.struct("o_orderpriority", "n")).alias("parts"))
    pct = lambda x: F.round(100.0 * x["n"] / F.col("total"), 0).cast("int")
    ordered = F.array_sort(F.transform("parts", lambda x: F.struct((-pct(x)).alias("p"), x["o_orderpriority"].alias("name"))))
    text = F.array_join(F.transform(ordered, lambda x: F.concat(x["name"], F.lit(" "), (-x["p"]).cast("string"), F.lit("%"))), " / ")
    return totals.select("o_custkey", F.coalesce(S.present(text), F.lit("flat")).alias("label"))


@query("""SELECT p_partkey, greatest(0.0, least(100.0, p_retailprice / 10 - 50)) AS weight FROM part WHERE isfinite(p_retailprice)""")
def clamp_weights(t: Tables) -> DataFrame:
    weight = S.finite(F.col("p_retailprice")) / 10 - 50
    return t.part.select("p_partkey", S.clamp(weight, 0.0, 100.0).alias("weight")).filter("weight IS NOT NULL")


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def category_filter(t: Tables) -> DataFrame:
    return t.orders.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_orderstatus")


@query("""SELECT event_id, (props::JSON->>'k')::INT AS k, (props::JSON->'x'->>'y') AS missing FROM events""")
def nested_default(t: Tables) -> DataFrame:
    props = F.from_json("props", "k int, x struct<y:string>")
    return t.events.select("event_id", props["k"].alias("k"), props["x"]["y"].alias("missing"))


@query("""SELECT event_id, '{"kind":"' || event_type || '"}' AS payload FROM events""")
def drop_keys(t: Tables) -> DataFrame:
    whole = F.struct(F.col("event_type").alias("kind"), F.col("value").alias("content_hash"), F.col("ts").alias("generated_at"))
    return t.events.select("event_id", F.to_json(whole.dropFields("content_hash", "generated_at")).alias("payload"))


@query("""WITH j AS (SELECT o_orderkey, json_object('urgent', o_orderpriority = '1-URGENT', 'large', CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice > 200000 END, 'open', o_orderstatus = 'O', 'note', o_orderstatus, 'score', o_orderkey) AS j FROM orders),
 k AS (SELECT o_orderkey, j, list_filter(['large', 'open', 'urgent', 'note', 'score'], lambda g: json_type(j, '$.' || g) = 'BOOLEAN') AS gates FROM j)
 SELECT o_orderkey, array_to_string(list_filter(gates, lambda g: (j->('$.' || g))::BOOLEAN), ',') AS gates, len(gates) AS total FROM k""")
def boolean_entries(t: Tables) -> DataFrame:
    """Of documents with values of several types the gates that are booleans, and those of them that hold."""
    k = F.col("o_orderkey")
    large = F.when(k % 3 != 0, F.col("o_totalprice") > 200000)
    document = F.to_json(F.struct((F.col("o_orderpriority") == "1-URGENT").alias("urgent"), large.alias("large"), (F.col("o_orderstatus") == "O").alias("open"), F.col("o_orderstatus").alias("note"), k.alias("score")), {"ignoreNullFields": "false"})
    gates = t.orders.select("o_orderkey", S.boolean_entries(document).alias("g"))
    held = F.array_join(F.array_sort(F.map_keys(F.map_filter("g", lambda _, v: v))), ",")
    return gates.select("o_orderkey", held.alias("gates"), F.size("g").cast("long").alias("total"))


@query("""WITH d AS (SELECT c_nationkey, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY 1)
 SELECT c_custkey, round(CASE WHEN hi = lo THEN 20 + (c_acctbal - lo) * 80 ELSE 20 + (c_acctbal - lo) / (hi - lo) * 80 END, 6) AS x,
 round((lambda_s.s * lambda_s.s * (3 - 2 * lambda_s.s)), 6) AS eased FROM (SELECT *, greatest(0, least(1, (c_acctbal - 0) / 5000.0)) AS s FROM customer JOIN d USING (c_nationkey)) lambda_s""")
def linear_scale(t: Tables) -> DataFrame:
    """Balances in the range 20 to 100 of their nation's, and eased in between 0 and 5000."""
    ends = t.customer.groupBy("c_nationkey").agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))
    joined = t.customer.join(ends, "c_nationkey")
    scaled = S.linear_scale(F.col("c_acctbal"), F.col("lo"), F.col("hi"), F.lit(20.0), F.lit(100.0))
    eased = S.smoothstep(F.col("c_acctbal"), F.lit(0.0), F.lit(5000.0))
    return joined.select("c_custkey", F.round(scaled, 6).alias("x"), F.round(eased, 6).alias("eased"))


@query("""WITH d AS (SELECT c_nationkey, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer WHERE c_acctbal > 0 GROUP BY 1)
 SELECT c_nationkey, array_to_string(range(ceil(log10(lo))::BIGINT, floor(log10(hi))::BIGINT + 1), ',') AS decades FROM d""")
def decade_lines(t: Tables) -> DataFrame:
    ends = t.customer.filter("c_acctbal > 0").groupBy("c_nationkey").agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))
    lines = S.decades(F.col("lo"), F.col("hi"))
    return ends.select("c_nationkey", F.array_join(F.transform(lines, lambda x: x.cast("string")), ",").alias("decades"))


@query("""WITH b AS (SELECT s_nationkey AS g, s_acctbal AS x, max(s_suppkey)::DOUBLE AS y FROM supplier GROUP BY ALL), q AS (SELECT c_custkey, c_nationkey AS g, c_acctbal AS x FROM customer),
 f AS (SELECT c_custkey, q.x, (SELECT arg_max({'x': b.x, 'y': b.y}, b.x) FROM b WHERE b.g = q.g AND b.x <= q.x) AS a, (SELECT arg_min({'x': b.x, 'y': b.y}, b.x) FROM b WHERE b.g = q.g AND b.x > q.x) AS c FROM q WHERE g IN (SELECT g FROM b))
 SELECT c_custkey, round(CASE WHEN a IS NULL THEN c.y WHEN c IS NULL THEN a.y ELSE a.y + (c.y - a.y) * (x - a.x) / (c.x - a.x) END, 6) AS height FROM f""")
def breakpoint_line(t: Tables) -> DataFrame:
    """Customers' balances on the line through their nation's suppliers, sorted by balance."""
    points = t.supplier.select(F.col("s_nationkey").alias("c_nationkey"), "s_acctbal", F.col("s_suppkey").cast("double").alias("y"))
    customers = t.customer.select("c_custkey", "c_nationkey", "c_acctbal")
    found = ordered.on_lines(customers, points, "c_nationkey", "c_acctbal", "s_acctbal", "y", "height")
    # as DuckDB rounds: the binary product decides a tie, not the decimal digits
    return found.select("c_custkey", (F.round(F.col("height") * 1e6) / 1e6).alias("height"))


@query("""SELECT p_partkey, regexp_replace(p_name || ' — ' || p_brand, '\\s*[–—]\\s*', ' - ', 'g') AS name, trim(regexp_replace(replace(p_type, ' ', '  '), '[ \\t\\r\\n]+', ' ', 'g')) AS kind FROM part""")
def text_normalise(t: Tables) -> DataFrame:
    joined = F.concat_ws(" — ", "p_name", "p_brand")
    return t.part.select("p_partkey", S.plain_dashes(joined).alias("name"), S.collapsed(F.replace("p_type", F.lit(" "), F.lit("  "))).alias("kind"))


@query("""SELECT doc_id, substr(sha256(text), 1, 12) || '...' || right(sha256(text), 6) AS digest FROM documents""")
def short_hash(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", S.short_hash(F.concat(F.lit("sha256:"), F.sha2("text", 256))).alias("digest"))


@query("""SELECT o_orderkey, replace(regexp_extract(o_orderpriority, '^([0-9,]+(?:\\.[0-9]+)?)(.*)$', 1), ',', '')::DOUBLE AS number, regexp_extract(o_orderpriority, '^([0-9,]+(?:\\.[0-9]+)?)(.*)$', 2) AS suffix FROM orders""")
def numeral_parse(t: Tables) -> DataFrame:
    number, suffix = S.number_and_suffix(F.col("o_orderpriority"))
    return t.orders.select("o_orderkey", number.alias("number"), suffix.alias("suffix"))


@query("""SELECT p_partkey, p_size::DOUBLE AS low, (p_size + 10)::DOUBLE AS high FROM part""")
def range_extract(t: Tables) -> DataFrame:
    low, high = S.stated_range(F.concat(F.lit("from "), "p_size", F.lit(" to "), F.col("p_size") + 10, F.lit(" units")))
    return t.part.select("p_partkey", low.alias("low"), high.alias("high"))


@query("""SELECT p_partkey, trim(regexp_replace(lower(p_name || '!'), '[^a-z0-9-]+', '-', 'g'), '-') AS slug FROM part""")
def slug(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", S.slug(F.concat("p_name", F.lit("!"))).alias("slug"))


@query("""SELECT event_id, (props::JSON->>'k')::BIGINT AS k, json_keys(props::JSON) AS names FROM events WHERE json_valid(props)""")
def json_field_scan(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.json_object_keys("props").alias("names")).filter("names IS NOT NULL")


@query("""SELECT event_id, event_type AS kind, user_id::VARCHAR AS usr FROM events""")
def body_decode(t: Tables) -> DataFrame:
    form = F.concat(F.lit("kind="), "event_type", F.lit("&usr="), F.col("user_id").cast("string"))
    body = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("usr")))).otherwise(form)
    fields = S.body_fields(body, ["kind", "usr"])
    return t.events.select("event_id", *(v.alias(k) for k, v in fields.items()))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice >= 1e6 THEN printf('%.1fM', floor(o_totalprice / 1e5 + 0.5) / 10) WHEN o_totalprice >= 1e3 AND o_totalprice / 1e3 = floor(o_totalprice / 1e3) THEN printf('%dK', (o_totalprice / 1e3)::BIGINT)
 WHEN o_totalprice >= 1e3 THEN printf('%.1fK', floor(o_totalprice / 100 + 0.5) / 10) ELSE printf('%.0f', floor(o_totalprice + 0.5)) END AS shown, lpad(o_orderkey::VARCHAR, greatest(2, length(o_orderkey::VARCHAR))::INT, '0') AS number FROM orders""")
def amount_format(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", S.compact_amount(F.col("o_totalprice")).alias("shown"), S.padded(F.col("o_orderkey")).alias("number"))


@query("""WITH a AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN ' Acme' WHEN page_id % 5 = 0 THEN '  ' END AS company, lower(trim(replace(regexp_replace(url, '^https?://', ''), '/', '@'))) AS address FROM pages),
 s AS (SELECT page_id, CASE WHEN trim(coalesce(company, '')) <> '' THEN 'dropped' WHEN address <> '' AND length(address) <= 254 AND regexp_matches(address, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') THEN 'accepted' ELSE 'invalid' END AS status FROM a)
 SELECT page_id, status, status <> 'invalid' AS ok, status = 'accepted' AS stored FROM s""")
def form_intake(t: Tables) -> DataFrame:
    company = F.when(F.col("page_id") % 7 == 0, " Acme").when(F.col("page_id") % 5 == 0, "  ")
    address = F.replace(F.regexp_replace("url", "^https?://", ""), F.lit("/"), F.lit("@"))
    status = F.col("status")
    return t.pages.select("page_id", S.intake(company, address).alias("status")).withColumns({"ok": status != "invalid", "stored": status == "accepted"})


@query("""WITH o AS (SELECT o_orderkey, o_totalprice, (o_orderkey % 1500)::DOUBLE AS days, CASE WHEN o_custkey % 3 > 0 THEN (o_custkey % 1000) / 4.0 END AS low, CASE WHEN o_custkey % 5 > 0 THEN (o_custkey % 1000) / 4.0 + 10 END AS high, sha256(o_orderkey::VARCHAR) AS h FROM orders)
 SELECT o_orderkey, '$' || format('{:,}', floor(o_totalprice + 0.5)::BIGINT) AS amount, CASE WHEN days / 365.25 >= 1 THEN printf('%.1fy', days / 365.25) ELSE printf('%dd', days::BIGINT) END AS sample,
 CASE WHEN low IS NOT NULL AND high IS NOT NULL THEN printf('%.2f to %.2f', low::DOUBLE, high::DOUBLE) WHEN low IS NOT NULL THEN printf('%.2f', low::DOUBLE) WHEN high IS NOT NULL THEN printf('%.2f', high::DOUBLE) END || '%' AS band,
 'sha256:' || left(h, 12) || '...' || right(h, 6) AS digest FROM o""")
def display_labels(t: Tables) -> DataFrame:
    base = (F.col("o_custkey") % 1000) / 4
    low, high = F.when(F.col("o_custkey") % 3 > 0, base), F.when(F.col("o_custkey") % 5 > 0, base + 10)
    digest = F.concat(F.lit("sha256:"), F.sha2(F.col("o_orderkey").cast("string"), 256))
    return t.orders.select(
        "o_orderkey", S.money(F.col("o_totalprice")).alias("amount"), S.span_of_days(F.col("o_orderkey") % 1500).alias("sample"),
        S.range_label(low, high, 2, "%").alias("band"), S.tagged_hash(digest).alias("digest"),
    )


@query("""SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS shown, concat_ws('  /  ', nullif(url, ''), CASE WHEN page_id % 3 > 0 THEN 'page ' || page_id END) AS line FROM pages""")
def escaped_markup(t: Tables) -> DataFrame:
    number = F.when(F.col("page_id") % 3 > 0, F.concat(F.lit("page "), F.col("page_id").cast("string"))).otherwise("")
    return t.pages.select("page_id", S.escaped(F.col("html")).alias("shown"), S.joined_parts([F.col("url"), number], "  /  ").alias("line"))
