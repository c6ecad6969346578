"""M1-M4: samples. The order inside a cell is by key where SQL is to give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as bx
from ..operators import sampling
from ..registry import query
from .base import lattice_sql, table

BIN = "CASE WHEN p_size >= 32 THEN 32 WHEN p_size >= 16 THEN 16 ELSE 0 END"


def parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size", bx.size_bin(F.col("p_size"), (0, 16, 32)).alias("bin"))


@query(
    "m1_cap_by_size",
    f"""WITH p AS (SELECT p_partkey, p_brand, {BIN} AS bin FROM part), c AS (SELECT p_brand, count(DISTINCT bin) AS k FROM p GROUP BY p_brand),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, bin ORDER BY p_partkey) AS r FROM p) SELECT p_partkey, p_brand, bin FROM r JOIN c USING (p_brand) WHERE r <= greatest(1, 10 // k)""",
)
def m1(spark, sf_dir):
    return sampling.by_cells(parts(spark, sf_dir), "p_brand", "bin", 10, ["p_partkey"], [F.col("p_partkey")]).select("p_partkey", "p_brand", "bin")


@query(
    "m2_cap_by_track",
    """WITH t AS (SELECT event_type, user_id, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY user_id) AS r FROM (SELECT DISTINCT event_type, user_id FROM events)),
k AS (SELECT *, greatest(1, least(3, 60 // n)) AS k FROM t), u AS (SELECT event_type, user_id, k FROM k WHERE n * k <= 60 OR r <= 60 // k),
e AS (SELECT event_type, user_id, event_id, k, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY event_type, user_id) AS n FROM events JOIN u USING (event_type, user_id) WINDOW w AS (PARTITION BY event_type, user_id ORDER BY event_id))
SELECT event_type, user_id, event_id FROM e WHERE n <= k OR list_contains(list_transform(range(k), lambda j: CAST(round_even(j * (n - 1) / greatest(k - 1, 1)::DOUBLE, 0) AS BIGINT)), i)""",
)
def m2(spark, sf_dir):
    return sampling.by_tracks(table(spark, sf_dir, "events"), "event_type", "user_id", ["event_id"], 3, 60, F.col("user_id")).select("event_type", "user_id", "event_id")


@query(
    "m3_strata_quotas",
    """WITH a AS (SELECT p_partkey, 'small' AS stratum FROM part WHERE p_size < 10 ORDER BY p_partkey LIMIT 12),
b AS (SELECT p_partkey, 'brand' AS stratum FROM part WHERE p_brand = 'Brand#13' AND p_partkey NOT IN (SELECT p_partkey FROM a) ORDER BY p_partkey LIMIT 5),
c AS (SELECT p_partkey, 'rest' AS stratum FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM a UNION ALL SELECT p_partkey FROM b) ORDER BY p_partkey LIMIT 20) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""",
)
def m3(spark, sf_dir):
    strata = [("small", 12, F.col("p_size") < 10), ("brand", 5, F.col("p_brand") == "Brand#13"), ("rest", 20, F.lit(True))]
    return sampling.by_strata(parts(spark, sf_dir), strata, ["p_partkey"], [F.col("p_partkey")]).select("p_partkey", "stratum")


SAME = " + ".join(f"{w} * len(list_filter(m.picks, lambda y: y.{c} = x.{c}))" for c, w in (("brand", 2.5), ("bin", 1), ("length", 1), ("price", 1)))


@query(
    "m4_diverse_draw",
    f"""WITH RECURSIVE p AS (SELECT p_partkey AS k, p_type, p_brand AS brand, {BIN} AS bin, CASE WHEN p_size >= 40 THEN 3 WHEN p_size >= 20 THEN 2 WHEN p_size >= 5 THEN 1 ELSE 0 END AS length,
  CASE WHEN p_retailprice >= 1500 THEN 3 WHEN p_retailprice >= 1200 THEN 2 WHEN p_retailprice >= 1000 THEN 1 ELSE 0 END AS price, {lattice_sql(['p_partkey'], 4)} AS h FROM part),
c AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY p_type, brand, bin, length, price ORDER BY h, k) <= 8),
l AS (SELECT p_type, list({{'h': h, 'k': k, 'brand': brand, 'bin': bin, 'length': length, 'price': price}}) AS near FROM c GROUP BY p_type),
m AS (SELECT p_type, CAST(0 AS INTEGER) AS n, list_filter(near, lambda x: false) AS picks FROM l
  UNION ALL SELECT p_type, CAST(n + 1 AS INTEGER), list_append(picks, pick) FROM (
    SELECT m.p_type, m.n, m.picks, list_sort(list_transform(list_filter(l.near, lambda x: NOT list_contains(m.picks, x)), lambda x: {{'cost': {SAME}, 'x': x}}))[1].x AS pick
    FROM m JOIN l ON l.p_type = m.p_type WHERE m.n < 8 AND m.n < len(l.near)) t)
SELECT p_type, picks[n].k AS p_partkey, CAST(n - 1 AS INTEGER) AS draw FROM m WHERE n > 0""",
)
def m4(spark, sf_dir):
    price = table(spark, sf_dir, "part").select("p_partkey", bx.bucket(F.col("p_retailprice"), [1000, 1200, 1500]).alias("price"))
    p = parts(spark, sf_dir).withColumn("length", bx.bucket(F.col("p_size"), [5, 20, 40])).join(price, "p_partkey")
    return sampling.diverse(p, ["p_type"], 8, "p_brand", ["bin", "length", "price"], ["p_partkey"], sampling.lattice(["p_partkey"], 4)).select("p_type", "p_partkey", "draw")
