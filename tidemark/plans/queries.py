"""Registered queries: each applies an operator to the driver's tables and has its DuckDB SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import labels as lb
from tidemark.functions.calendar import add_calendar, instant, utc_date, utc_hour, utc_minute_text
from tidemark.operators import coverage as cov
from tidemark.operators import evaluate as ev
from tidemark.operators import features as ft
from tidemark.operators import forecast as fc
from tidemark.operators import reports as rp
from tidemark.operators import samples as sm
from tidemark.operators import slices as sl
from tidemark.operators import star as st
from tidemark.operators import upsert as up
from tidemark.plans import jobs
from tidemark.sources import bronze as br
from tidemark.sources import files as fl
from tidemark.sources import tables as tb
from tidemark.sources.models import list_models, load_model, save_model

V = "temperature_2m"
PLACE = ["region", "lat", "lon"]
#: What the window model sees of an hour.
FEATURES = [V, "hour"]
SERIES = ["region", "dataset", "lat", "lon"]


#: Roots of the lakes built so far, by session and input, and those whose star, ledger and models stand too.
LAKES: dict[tuple[str, str], str] = {}
STARRED: set[str] = set()


# ---- views over the driver's tables ------------------------------------------------------------


class Views:
    """The lake that stands behind the queries, derived from events and lineitem."""

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = spark, sf

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf}/{name}.parquet")

    def raw(self) -> DataFrame:
        e = self.table("events")
        ts = instant("ts")
        return e.select(
            F.concat(F.lit("r"), (F.col("user_id") % 7).cast("string")).alias("region"),
            F.when(F.col("event_id") % 4 == 0, "forecast").otherwise("archive").alias("dataset"),
            F.col("event_type").alias("marz"),
            (F.col("user_id") * F.lit(0.25)).alias("lat"),
            (F.col("user_id") * F.lit(0.5) + 40).alias("lon"),
            ((F.col("event_id") % 3) * F.lit(100.0)).alias("elevation"),
            utc_hour("ts").alias("observed_at"),
            F.col("value").alias(V),
            ts.alias("run_ts"),
            "event_id",
        )

    def silver(self) -> DataFrame:
        rows = ft.dedupe_latest(self.raw(), [*SERIES, "observed_at"], [F.desc("run_ts"), F.desc("event_id")])
        return rows.drop("run_ts", "event_id").withColumn("date", utc_date("observed_at"))

    def dense(self) -> DataFrame:
        """Hourly means per event type, as archive rows of five places."""
        e = self.table("events").select(F.col("event_type").alias("region"), utc_hour("ts").alias("observed_at"), F.col("value").cast("decimal(18,2)").alias("d"))
        means = e.groupBy("region", "observed_at").agg((F.sum("d").cast("double") / F.count("*")).alias(V), F.count("*").cast("double").alias("n"))
        return means.withColumns({"dataset": F.lit("archive"), "lat": F.length("region").cast("double"), "lon": F.lit(44.0), "elevation": F.lit(100.0)})

    def wide(self) -> DataFrame:
        """The dense series with all ten measures; gusts are missing where an hour has one event."""
        others = {m: F.col(V) + F.lit(float(k)) for k, m in enumerate(br.MEASURES) if m != V}
        gusts = F.when(F.col("n") > 1, others["wind_gusts_10m"])
        return self.dense().withColumns({**others, "wind_gusts_10m": gusts}).withColumn("date", utc_date("observed_at"))

    def layers(self) -> str:
        """The root of a lake whose silver and gold layers the jobs have built from landed documents, once per session and input."""
        key = (self.spark.sparkContext.applicationId, self.sf)
        if key not in LAKES:
            root = tb.new_folder(self.spark, "lake")
            docs = br.pack_hourly(self.wide(), ["region", "date", "lat", "lon", "elevation"], "observed_at", br.MEASURES)
            docs = docs.select(F.lit("am").alias("region"), F.lit("archive").alias("dataset"), F.col("region").alias("marz"), F.translate(F.col("date").cast("string"), "-", "").alias("range"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), "elevation", "hourly")
            br.land_bronze(docs, f"{root}/bronze")
            jobs.bronze_to_silver(self.spark, f"{root}/bronze", f"{root}/silver")
            jobs.silver_to_gold(self.spark, f"{root}/silver", f"{root}/gold")
            LAKES[key] = root
        return LAKES[key]

    def lake(self) -> str:
        """The same lake with its star, its ledger and its models, which only the queries on these wait for."""
        root = self.layers()
        if root not in STARRED:
            jobs.load_star(self.spark, f"{root}/silver", f"{root}/star")
            gold = tb.read_layer(self.spark, f"{root}/gold").drop("region").withColumnRenamed("marz", "region")
            jobs.run_walk_forward(self.spark, gold, f"{root}/star", "persistence", [V], V, 6, 3, 4)
            save_model(self.spark, self.fit(self.windows(gold)), f"{root}/models", "linear")
            model, _ = load_model(self.spark, f"{root}/models")
            jobs.run_walk_forward(self.spark, gold, f"{root}/star", "linear", FEATURES, V, 3, 3, 4, models=model)
            STARRED.add(root)
        return root

    def windows(self, rows: DataFrame) -> DataFrame:
        """Three hours of two features, and the three hours after them."""
        return sm.sliding_samples(rows, PLACE, "observed_at", FEATURES, V, 3, 3, 4)

    def fit(self, windows: DataFrame) -> fc.WindowModel:
        return fc.fit_windows(windows, FEATURES, 3, 3, PLACE)

    def dim_location(self, silver: DataFrame) -> DataFrame:
        none = self.spark.createDataFrame([], "location_id long, region string, lat double, lon double, elevation double")
        return up.assign_keys(st.location_dim(silver, PLACE, ["elevation"], "observed_at"), none, PLACE, "location_id")

    def ledger(self, name: str, version: str) -> DataFrame:
        """Rows of one version in a table of the lake's star."""
        return jobs.current_table(self.spark, f"{self.lake()}/star", name).where(F.col("model_version") == f"walkforward:{version}")

    def dim_time(self, silver: DataFrame) -> DataFrame:
        none = self.spark.createDataFrame([], tb.STAR["dim_time"][0])
        return up.assign_keys(st.time_dim(silver, "observed_at"), none, ["date", "observed_at"], "time_id")

    def star(self, silver: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        loc, time = self.dim_location(silver), self.dim_time(silver)
        return st.build_fact(silver, loc, time, PLACE, [V]), loc, time

    def preds(self, seq_in: int = 6, seq_out: int = 3, stride: int = 4) -> DataFrame:
        """Persistence walk-forward over the dense series, keyed by location, without actuals."""
        dense = self.dense()
        samples = sm.sliding_samples(dense, PLACE, "observed_at", [V, "n"], V, seq_in, 0, stride)
        long = ev.walk_forward(sm.persistence(samples, V, seq_out), PLACE, lb.walkforward_version(F.lit("persistence")), seq_in)
        keyed = long.join(self.dim_location(dense).select("location_id", *PLACE), PLACE).drop(*PLACE)
        return keyed.withColumns({"actual_value": F.lit(None).cast("double"), "actual_filled_at": F.lit(None).cast("timestamp")})

    def filled(self) -> DataFrame:
        fact, _, time = self.star(self.dense())
        return ev.backfill_actuals(self.preds(), fact, time, V, now=instant(F.lit("2024-03-01").cast("timestamp_ntz")))


CTES = {
    "raw": """SELECT 'r' || (user_id % 7) AS region, CASE WHEN event_id % 4 = 0 THEN 'forecast' ELSE 'archive' END AS dataset, event_type AS marz,
  user_id * 0.25::DOUBLE AS lat, user_id * 0.5::DOUBLE + 40 AS lon, (event_id % 3) * 100.0::DOUBLE AS elevation, date_trunc('hour', ts) AS observed_at, value AS temperature_2m, ts AS run_ts, event_id FROM events""",
    "silver": """SELECT * EXCLUDE (rn, run_ts, event_id), observed_at::DATE AS date FROM (SELECT *, row_number() OVER (PARTITION BY region, dataset, lat, lon, observed_at ORDER BY run_ts DESC, event_id DESC) AS rn FROM raw) WHERE rn = 1""",
    "dense": """SELECT event_type AS region, date_trunc('hour', ts) AS observed_at, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS temperature_2m, count(*)::DOUBLE AS n, 'archive' AS dataset,
  length(event_type)::DOUBLE AS lat, 44.0::DOUBLE AS lon, 100.0::DOUBLE AS elevation FROM events GROUP BY event_type, date_trunc('hour', ts)""",
    "dim_location": """SELECT row_number() OVER (ORDER BY region, lat, lon) AS location_id, * FROM (SELECT region, lat, lon, arg_max(elevation, (observed_at, elevation)) AS elevation FROM {src} GROUP BY region, lat, lon)""",
    "dim_time": """SELECT row_number() OVER (ORDER BY observed_at) AS time_id, observed_at, observed_at::DATE AS date, hour(observed_at)::SMALLINT AS hour, (dayofweek(observed_at) + 1)::SMALLINT AS day_of_week, month(observed_at)::SMALLINT AS month, year(observed_at)::SMALLINT AS year,
  CASE WHEN month(observed_at) IN (12, 1, 2) THEN 'winter' WHEN month(observed_at) IN (3, 4, 5) THEN 'spring' WHEN month(observed_at) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season, dayofweek(observed_at) IN (0, 6) AS is_weekend FROM (SELECT DISTINCT observed_at FROM {src})""",
    "fact": """SELECT location_id, time_id, dataset, s.temperature_2m FROM {src} s JOIN dim_location USING (region, lat, lon) JOIN dim_time USING (observed_at)""",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY region, lat, lon ORDER BY observed_at) AS rn, count(*) OVER (PARTITION BY region, lat, lon) AS total FROM dense",
    "preds": """SELECT location_id, 'walkforward:persistence' AS model_version, observed_at AS prediction_made_at, observed_at + h * INTERVAL 1 HOUR AS target_time, h AS h_ahead, temperature_2m AS predicted_value, 6 AS seq_in
  FROM ranked JOIN dim_location USING (region, lat, lon), (SELECT unnest([1, 2, 3]) AS h) WHERE rn >= 6 AND (rn - 6) % 4 = 0""",
    "filled": """SELECT preds.*, f.temperature_2m AS actual_value FROM preds LEFT JOIN (SELECT location_id, observed_at AS target_time, temperature_2m FROM fact JOIN dim_time USING (time_id) WHERE dataset = 'archive' AND temperature_2m IS NOT NULL) f USING (location_id, target_time)""",
    "groups": """SELECT location_id, model_version, prediction_made_at, count(*) AS n_hours, avg((predicted_value - actual_value) * (predicted_value - actual_value)) AS mse FROM filled GROUP BY 1, 2, 3 HAVING count(*) = count(actual_value)""",
    "windows": """SELECT region, observed_at AS anchor_ts, rn, array_agg(temperature_2m) OVER i AS inputs, array_agg(temperature_2m) OVER o AS targets FROM ranked
  WINDOW i AS (PARTITION BY region, lat, lon ORDER BY observed_at ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), o AS (PARTITION BY region, lat, lon ORDER BY observed_at ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)""",
    "samples": "SELECT region, anchor_ts, inputs, targets FROM windows WHERE len(inputs) = 6 AND len(targets) = 3 AND (rn - 6) % 4 = 0",
    "latest": "SELECT location_id, max(observed_at) AS observed_at, arg_max(temperature_2m, observed_at) AS temperature_2m FROM fact JOIN dim_time USING (time_id) WHERE dataset = 'archive' AND temperature_2m IS NOT NULL GROUP BY location_id",
    "star_sales": """SELECT n_name, r_name, l_suppkey, CAST(l_shipdate AS DATE) AS d, l_extendedprice, l_discount FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
}
#: The window model in SQL: scaled values u, the system of sums g, one elimination per unknown, the solution's last columns.
CTES |= {
    "w3": """SELECT region, observed_at AS anchor_ts, rn, array_agg(temperature_2m) OVER i AS a, array_agg(hour(observed_at)) OVER i AS b, array_agg(temperature_2m) OVER o AS targets FROM ranked
  WINDOW i AS (PARTITION BY region, lat, lon ORDER BY observed_at ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), o AS (PARTITION BY region, lat, lon ORDER BY observed_at ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)""",
    "s3": "SELECT *, k <= floor(total * (1.0::DOUBLE - 0.2::DOUBLE)) AS train FROM (SELECT *, row_number() OVER (ORDER BY anchor_ts, region) AS k, count(*) OVER () AS total FROM w3 WHERE len(a) = 3 AND len(targets) = 3 AND (rn - 3) % 4 = 0)",
    "scale": "SELECT avg(x) AS ma, stddev_pop(x) AS sa, avg(y) AS mb, stddev_pop(y) AS sb FROM (SELECT unnest(a) AS x, unnest(b) AS y FROM s3 WHERE train)",
    "u3": "SELECT region, anchor_ts, rn, a, targets, [1.0::DOUBLE, (a[1] - ma) / sa, (b[1] - mb) / sb, (a[2] - ma) / sa, (b[2] - mb) / sb, (a[3] - ma) / sa, (b[3] - mb) / sb] AS u FROM w3, scale WHERE len(a) = 3 AND (rn - 3) % 4 = 0",
    "g0": """SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS r FROM (SELECT i, j, avg(u[i] * CASE WHEN j <= 7 THEN u[j] ELSE u3.targets[j - 7] END) + CASE WHEN i = j AND i > 1 THEN 1e-6::DOUBLE ELSE 0 END AS v
  FROM u3 JOIN s3 USING (region, anchor_ts), range(1, 8) AS x(i), range(1, 11) AS y(j) WHERE train GROUP BY i, j) GROUP BY i)""",
}
CTES |= {f"g{k}": f"SELECT [CASE WHEN i = {k} THEN [x / m[{k}][{k}] for x in m[{k}]] ELSE [m[i][j] - m[i][{k}] / m[{k}][{k}] * m[{k}][j] for j in range(1, 11)] END for i in range(1, 8)] AS m FROM g{k - 1}" for k in range(1, 8)}
CTES["p3"] = "SELECT region, anchor_ts, rn, a, u3.targets, [list_sum([u[i] * m[i][7 + h] for i in range(1, 8)]) for h in range(1, 4)] AS preds FROM u3, g7"
CTES["val_error"] = "SELECT avg((preds[h] - p3.targets[h]) * (preds[h] - p3.targets[h])) AS val_mse FROM p3 JOIN s3 USING (region, anchor_ts), range(1, 4) AS x(h) WHERE NOT train"
FIT = ["dense", "ranked", "w3", "s3", "scale", "u3", *(f"g{k}" for k in range(8)), "p3", "val_error"]
DENSE = ["dense", "dim_location", "dim_time", "fact", "ranked", "preds", "filled", "groups"]
STARS = ["raw", "silver", "dim_location", "dim_time", "fact"]


def with_ctes(names: list[str], body: str) -> str:
    src = "silver" if "silver" in names else "dense"
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n].replace('{src}', src)})" for n in names) + ("" if body.startswith(",") else "\n") + body


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, ctes: list[str] | None = None, sql: str | None = None):
    """Register a function of ``Views`` and its SQL."""

    def add(fn: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf: fn(Views(spark, sf))
        if sql is not None:
            SQL[name] = with_ctes(ctes, sql) if ctes else sql
        return fn

    return add


# ---- features ----------------------------------------------------------------------------------
GOLD_SQL = """SELECT region, dataset, lat, observed_at, temperature_2m, hour(observed_at) AS hour, dayofweek(observed_at) + 1 AS day_of_week, month(observed_at) AS month,
 CASE WHEN month(observed_at) IN (12, 1, 2) THEN 'winter' WHEN month(observed_at) IN (3, 4, 5) THEN 'spring' WHEN month(observed_at) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season, (dayofweek(observed_at) IN (0, 6))::INT AS is_weekend,
 lag(temperature_2m, 1) OVER w AS temperature_2m_lag_1h, lag(temperature_2m, 3) OVER w AS temperature_2m_lag_3h, lag(temperature_2m, 24) OVER w AS temperature_2m_lag_24h,
 round(avg(temperature_2m) OVER r, 6) AS mean24, round(stddev_samp(temperature_2m) OVER r, 6) AS std24 FROM silver
 WINDOW w AS (PARTITION BY region, dataset, lat, lon ORDER BY observed_at), r AS (PARTITION BY region, dataset, lat, lon ORDER BY observed_at RANGE BETWEEN INTERVAL 23 HOUR PRECEDING AND CURRENT ROW)"""


@query("c2_build_gold", ["raw", "silver"], GOLD_SQL)
def gold(v):
    g = ft.build_gold(v.silver(), SERIES, "observed_at", V)
    return g.select("region", "dataset", "lat", "observed_at", V, "hour", "day_of_week", "month", "season", "is_weekend", f"{V}_lag_1h", f"{V}_lag_3h", f"{V}_lag_24h", F.round(f"{V}_roll24_mean", 6).alias("mean24"), F.round(f"{V}_roll24_std", 6).alias("std24"))


query("f1_calendar", ["raw"], "SELECT event_id, hour(run_ts)::SMALLINT AS hour, (dayofweek(run_ts) + 1)::SMALLINT AS day_of_week, month(run_ts)::SMALLINT AS month, year(run_ts)::SMALLINT AS year, CASE WHEN month(run_ts) IN (12, 1, 2) THEN 'winter' WHEN month(run_ts) IN (3, 4, 5) THEN 'spring' WHEN month(run_ts) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season, dayofweek(run_ts) IN (0, 6) AS is_weekend FROM raw")(
    lambda v: add_calendar(v.raw(), "run_ts", "dim").select("event_id", "hour", "day_of_week", "month", "year", "season", "is_weekend"))
query("w1_add_lags", ["raw", "silver"], "SELECT region, dataset, lat, observed_at, lag(temperature_2m) OVER w AS lag1, lag(temperature_2m, 24) OVER w AS lag24 FROM silver WINDOW w AS (PARTITION BY region, dataset, lat, lon ORDER BY observed_at)")(
    lambda v: ft.add_lags(v.silver(), SERIES, "observed_at", V, (1, 24)).select("region", "dataset", "lat", "observed_at", F.col(f"{V}_lag_1h").alias("lag1"), F.col(f"{V}_lag_24h").alias("lag24")))
query("w2_add_rolling", ["raw", "silver"], "SELECT region, dataset, lat, observed_at, round(avg(temperature_2m) OVER r, 6) AS m, round(stddev_samp(temperature_2m) OVER r, 6) AS s FROM silver WINDOW r AS (PARTITION BY region, dataset, lat, lon ORDER BY observed_at RANGE BETWEEN INTERVAL 23 HOUR PRECEDING AND CURRENT ROW)")(
    lambda v: ft.add_rolling(v.silver(), SERIES, "observed_at", V).select("region", "dataset", "lat", "observed_at", F.round(f"{V}_roll24_mean", 6).alias("m"), F.round(f"{V}_roll24_std", 6).alias("s")))
query("w9_dedupe_latest", ["raw", "silver"], "SELECT region, dataset, lat, lon, elevation, observed_at, temperature_2m FROM silver")(lambda v: v.silver().select(*SERIES, "elevation", "observed_at", V))


# ---- bronze ------------------------------------------------------------------------------------
def packed(v: Views) -> DataFrame:
    return br.pack_hourly(v.dense().withColumn("date", utc_date("observed_at")), ["region", "date"], "observed_at", [V, "n"])


query("f7_flatten_hourly", ["dense"], "SELECT region, observed_at, temperature_2m, n FROM dense")(lambda v: br.flatten_hourly(packed(v), [V, "n"], keep=["region"]))
query("f8_pack_hourly", ["dense"], "SELECT region, observed_at::DATE AS date, count(*)::INT AS n_rows, min(strftime(observed_at, '%Y-%m-%dT%H:%M')) AS first_time FROM dense GROUP BY 1, 2")(
    lambda v: packed(v).select("region", "date", F.size("hourly.time").alias("n_rows"), F.get("hourly.time", F.lit(0)).alias("first_time")))


@query("s22_split_valid", ["dense"], "SELECT region, observed_at::DATE AS date, count(*)::INT AS n_rows, day(observed_at::DATE) % 5 <> 0 AS valid FROM dense GROUP BY 1, 2")
def split_valid(v):
    docs = packed(v).withColumn("latitude", F.when(F.dayofmonth("date") % 5 != 0, 40.0)).withColumn("longitude", F.lit(44.0))
    good, bad = br.split_valid(docs)
    pick = lambda d, ok: d.select("region", "date", "n_rows", F.lit(ok).alias("valid"))
    return pick(good, True).unionByName(pick(bad, False))


@query("f20_json", None, "SELECT event_id, user_id::VARCHAR AS who FROM events")
def json_round_trip(v):
    e = v.table("events").select("event_id", F.to_json(F.struct("user_id", "event_type")).alias("j"))
    return e.select("event_id", F.from_json("j", "user_id string, event_type string").getField("user_id").alias("who"))


# ---- star --------------------------------------------------------------------------------------
query("a1_location_dim", STARS[:3], "SELECT * FROM dim_location")(lambda v: v.dim_location(v.silver()))
query("a2_time_dim", ["raw", "silver", "dim_time"], "SELECT * FROM dim_time")(lambda v: v.dim_time(v.silver()))
query("j1_build_fact", STARS, "SELECT * FROM fact")(lambda v: v.star(v.silver())[0])


@query("j13_assign_keys", ["raw", "silver"], """, old AS (SELECT region, lat, lon, row_number() OVER (ORDER BY region, lat, lon) AS location_id FROM (SELECT DISTINCT region, lat, lon FROM silver WHERE region < 'r3')),
new AS (SELECT region, lat, lon, (SELECT max(location_id) FROM old) + row_number() OVER (ORDER BY region, lat, lon) AS location_id FROM (SELECT DISTINCT region, lat, lon FROM silver WHERE region >= 'r3')) SELECT * FROM old UNION ALL SELECT * FROM new""")
def assign_keys(v):
    places = v.silver().select(*PLACE).distinct()
    none = v.spark.createDataFrame([], "location_id long, region string, lat double, lon double")
    old = up.assign_keys(places.where("region < 'r3'"), none, PLACE, "location_id")
    return up.assign_keys(places, old, PLACE, "location_id")


query("j10_insert_absent", ["raw"], "SELECT region, marz, count(*) AS n FROM raw WHERE dataset = 'archive' GROUP BY 1, 2 UNION ALL SELECT region, marz, count(*) FROM raw r WHERE dataset = 'forecast' AND NOT EXISTS (SELECT 1 FROM raw a WHERE a.dataset = 'archive' AND a.region = r.region AND a.marz = r.marz) GROUP BY 1, 2")(
    lambda v: (lambda r: up.insert_absent(r.where("dataset = 'archive'").groupBy("region", "marz").agg(F.count("*").alias("n")), r.where("dataset = 'forecast'").groupBy("region", "marz").agg(F.count("*").alias("n")), ["region", "marz"]))(v.raw()))
query("j11_upsert", ["raw"], "SELECT region, marz, count(*) AS n FROM raw WHERE dataset = 'forecast' AND region < 'r4' GROUP BY 1, 2 UNION ALL SELECT region, marz, count(*) FROM raw WHERE dataset = 'archive' AND (region, marz) NOT IN (SELECT (region, marz) FROM raw WHERE dataset = 'forecast' AND region < 'r4') GROUP BY 1, 2")(
    lambda v: (lambda r: up.upsert(r.where("dataset = 'archive'").groupBy("region", "marz").agg(F.count("*").alias("n")), r.where("dataset = 'forecast' and region < 'r4'").groupBy("region", "marz").agg(F.count("*").alias("n")), ["region", "marz"]))(v.raw()))
query("v1_duplicate_keys", ["raw"], "SELECT region, dataset, lat, lon, observed_at, count(*) AS n FROM raw GROUP BY ALL HAVING count(*) > 1")(lambda v: up.duplicate_keys(v.raw(), [*SERIES, "observed_at"]))
@query("v2_orphans", None, "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 7 <> 0 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def orphans(v):
    """Orders whose customer is not among the even ones; every seventh order names no customer, which is no fault."""
    orders = v.table("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("o_custkey"))
    return up.orphans(orders, v.table("customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"])


query("v3_null_violations", ["raw", "silver"], """, l AS (SELECT *, lag(temperature_2m) OVER (PARTITION BY region, dataset, lat, lon ORDER BY observed_at) AS lag1 FROM silver) SELECT 'lag1' AS "column", count(*) AS n FROM l WHERE lag1 IS NULL""")(
    lambda v: up.null_violations(ft.add_lags(v.silver(), SERIES, "observed_at", V, (1,)).withColumnRenamed(f"{V}_lag_1h", "lag1"), ["region", "lag1"]))
query("j17_hottest", STARS, "SELECT lat, lon, max(temperature_2m) AS max_temperature_2m FROM fact JOIN dim_location USING (location_id) GROUP BY lat, lon")(
    lambda v: (lambda s: rp.hottest(s[0], s[1], V, ["lat", "lon"]))(v.star(v.silver())))
query("a8_fact_summary", STARS, "SELECT count(*) AS n_rows, min(observed_at) AS first_at, max(observed_at) AS last_at FROM fact JOIN dim_time USING (time_id)")(
    lambda v: (lambda s: rp.fact_summary(s[0], s[2]))(v.star(v.silver())))
query("j5_latest_per_location", [*STARS, "latest"], "SELECT d.*, observed_at, temperature_2m FROM dim_location d LEFT JOIN latest USING (location_id)")(
    lambda v: (lambda s: rp.latest_per_location(s[0], s[1], s[2], V))(v.star(v.silver())))
query("j7_series", STARS, "SELECT observed_at, round(avg(temperature_2m), 6) AS temperature_2m FROM fact JOIN dim_time USING (time_id) WHERE dataset = 'archive' GROUP BY observed_at")(
    lambda v: (lambda s: rp.series(s[0], s[2], V).withColumn(V, F.round(V, 6)))(v.star(v.silver())))
query("p11_series_of_location", STARS, "SELECT observed_at, round(avg(temperature_2m), 6) AS temperature_2m FROM fact JOIN dim_time USING (time_id) WHERE dataset = 'archive' AND location_id = 3 GROUP BY observed_at")(
    lambda v: (lambda s: rp.series(s[0], s[2], V, 3).withColumn(V, F.round(V, 6)))(v.star(v.silver())))
query("a11_rows_per_partition", ["raw", "silver"], "SELECT dataset, date, count(*) AS n_rows FROM silver GROUP BY 1, 2")(lambda v: rp.rows_per_partition(v.silver(), ["dataset", "date"]))
query("a12_provenance", ["raw", "silver"], "SELECT count(*) AS n_rows, count(DISTINCT (region, lat, lon)) AS n_locations, min(date) AS first_date, max(date) AS last_date FROM silver")(lambda v: rp.provenance(v.silver(), PLACE, "observed_at"))
query("s16_scan_coverage", ["raw", "silver"], "SELECT DISTINCT dataset, date FROM silver")(lambda v: tb.scan_coverage(v.silver()))
query("a18_bounds", ["raw"], "SELECT lo, hi, round(lo - greatest(0.5, (hi - lo) * 0.08), 6) AS axis_lo, round(hi + greatest(0.5, (hi - lo) * 0.08), 6) AS axis_hi FROM (SELECT min(temperature_2m) AS lo, max(temperature_2m) AS hi FROM raw)")(
    lambda v: rp.bounds(v.raw(), V).withColumns({c: F.round(c, 6) for c in ("axis_lo", "axis_hi")}))
query("j16_with_metadata", ["raw", "silver"], ", meta AS (SELECT 'r' || r_regionkey AS region, r_name AS capital FROM region) SELECT region, capital, count(*) AS n FROM silver LEFT JOIN meta USING (region) GROUP BY 1, 2")(
    lambda v: rp.with_metadata(v.silver(), v.table("region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("region"), F.col("r_name").alias("capital"))).groupBy("region", "capital").agg(F.count("*").alias("n")))
query("j2_sales_star", ["star_sales"], "SELECT r_name, n_name, count(*) AS n_lines, round(sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE, 2) AS price, max(d) AS last_day FROM star_sales GROUP BY 1, 2")(
    lambda v: (lambda li, s, n, r: li.join(s, li.l_suppkey == s.s_suppkey).join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
               .groupBy("r_name", "n_name").agg(F.count("*").alias("n_lines"), F.round(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double"), 2).alias("price"), F.max(F.to_date("l_shipdate")).alias("last_day")))(
                   v.table("lineitem").select("l_suppkey", "l_extendedprice", "l_shipdate"), v.table("supplier").select("s_suppkey", "s_nationkey"), v.table("nation").select("n_nationkey", "n_name", "n_regionkey"), v.table("region").select("r_regionkey", "r_name")))
query("j6_asof_backward", None, "SELECT a.event_id, a.user_id, b.ts AS r_ts, b.value AS r_value FROM (SELECT * FROM events WHERE event_id % 4 = 0) a ASOF LEFT JOIN (SELECT * FROM events WHERE event_id % 4 <> 0) b ON a.user_id = b.user_id AND a.ts >= b.ts")(
    lambda v: (lambda e: rp.asof_backward(e.where("event_id % 4 = 0").select("event_id", "user_id", "ts"), e.where("event_id % 4 <> 0").select("user_id", F.col("ts").alias("r_ts"), F.col("value").alias("r_value")), ["user_id"], "ts", "r_ts", ["r_value"]).drop("ts"))(v.table("events")))
query("t5_best_geocode", None, "SELECT query, position, latitude, population FROM (SELECT event_type AS query, event_id AS position, round(value / 3, 4) AS latitude, coalesce(CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id END, 0) AS population, row_number() OVER (PARTITION BY event_type ORDER BY coalesce(CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id END, 0) DESC, event_id) AS rn FROM events WHERE event_id % 2 = 0) WHERE rn = 1")(
    lambda v: rp.best_geocode(v.table("events").select(F.col("event_type").alias("query"), F.col("event_id").alias("position"), (F.col("value") / 3).alias("latitude"), F.lit(0.0).alias("longitude"), F.when(F.col("user_id") % 3 != 0, F.col("user_id")).alias("population"), (F.col("event_id") % 2 == 0).alias("here")), F.col("here")).select("query", "position", "latitude", "population"))


# ---- coverage ----------------------------------------------------------------------------------
def presence(v: Views) -> DataFrame:
    return v.table("orders").select(F.to_date("o_orderdate").alias("date")).distinct()


SPAN = "SELECT unnest(generate_series(DATE '1993-06-01', DATE '1999-03-15', INTERVAL 1 DAY))::DATE AS date"
query("j12_missing_dates", None, f"SELECT date FROM ({SPAN}) WHERE date NOT IN (SELECT o_orderdate::DATE FROM orders)")(lambda v: cov.missing_dates(cov.date_range(v.spark, "1993-06-01", "1999-03-15"), presence(v)))
query("u1_merge_coverage", None, f"SELECT date FROM ({SPAN}) UNION SELECT o_orderdate::DATE FROM orders")(lambda v: cov.merge_coverage(cov.date_range(v.spark, "1993-06-01", "1999-03-15"), presence(v)))
query("a19_coverage_report", None, f"SELECT (SELECT count(DISTINCT o_orderdate::DATE) FROM orders) AS present, (SELECT count(*) FROM ({SPAN}) WHERE date NOT IN (SELECT o_orderdate::DATE FROM orders)) AS added, (SELECT count(*) FROM ({SPAN})) AS requested, (SELECT count(*) FROM ({SPAN}) WHERE date NOT IN (SELECT o_orderdate::DATE FROM orders)) AS missing")(
    lambda v: (lambda r: cov.coverage_report(r, presence(v), r))(cov.date_range(v.spark, "1993-06-01", "1999-03-15")))
query("f12_year_chunks", None, """SELECT c_custkey, greatest(s, make_date(y, 1, 1)) AS chunk_start, least(e, make_date(y, 12, 31)) AS chunk_end FROM (SELECT *, unnest(generate_series(year(s), year(e)))::INT AS y
FROM (SELECT o_custkey AS c_custkey, min(o_orderdate)::DATE AS s, max(o_orderdate)::DATE AS e FROM orders GROUP BY 1))""")(
    lambda v: cov.year_chunks(v.table("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.to_date(F.min("o_orderdate")).alias("s"), F.to_date(F.max("o_orderdate")).alias("e")), "s", "e").select("c_custkey", "chunk_start", "chunk_end"))


@query("j15_work_list", None, f"""SELECT s_suppkey, chunk_start, chunk_end FROM supplier, (SELECT greatest(DATE '1993-06-01', make_date(y, 1, 1)) AS chunk_start, least(DATE '1999-03-15', make_date(y, 12, 31)) AS chunk_end FROM (SELECT DISTINCT year(date)::INT AS y FROM ({SPAN}) WHERE date NOT IN (SELECT o_orderdate::DATE FROM orders)))""")
def ingest_work(v):
    from tidemark.plans.jobs import ingest_plan

    return ingest_plan(v.spark, v.table("supplier").select("s_suppkey"), presence(v), "1993-06-01", "1999-03-15")


A13_SQL = """SELECT count(*) FILTER (NOT s) AS requested, count(*) FILTER (NOT s AND ok) AS succeeded, count(*) FILTER (NOT s AND NOT ok) AS failed,
sum(CASE WHEN NOT s AND ok THEN o_orderkey ELSE 0 END)::BIGINT AS rows, count(*) FILTER (s) AS skipped FROM (SELECT *, o_orderkey % 5 = 0 AS s, o_orderstatus <> 'O' AS ok FROM orders)"""


@query("a13_run_stats", None, A13_SQL)
def run_stats(v):
    return cov.run_stats(v.table("orders").select((F.col("o_orderstatus") != "O").alias("ok"), F.col("o_orderkey").alias("rows"), (F.col("o_orderkey") % 5 == 0).alias("skipped")))


query("f14_partition_date", None, "SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate::DATE END AS date FROM orders")(
    lambda v: v.table("orders").select("o_orderkey", F.concat(F.lit("gold/dataset=archive/"), F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("date="), F.date_format("o_orderdate", "yyyy-MM-dd"))).otherwise("_SUCCESS"), F.lit("/part-0.parquet")).alias("p")).select("o_orderkey", lb.partition_date("p").alias("date")))
query("f13_parse_window", None, "SELECT o_orderkey, o_orderdate::DATE AS w_start, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate::DATE + 30 END AS w_end, o_orderkey % 2 = 0 AS ok FROM orders")(
    lambda v: v.table("orders").select("o_orderkey", F.concat_ws(":", F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(F.col("o_orderkey") % 2 == 0, F.date_format(F.date_add(F.to_date("o_orderdate"), 30), "yyyy-MM-dd")).otherwise("soon")).alias("w")).select("o_orderkey", lb.parse_window("w").alias("x")).select("o_orderkey", F.col("x.start").alias("w_start"), F.col("x.end").alias("w_end"), "x.ok"))
@query("f24_default_window", None, "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate::DATE - 100 ELSE o_orderdate::DATE - 32 END AS s, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate::DATE ELSE o_orderdate::DATE - 2 END AS e FROM orders")
def default_window(v):
    """Both bounds given, one, or none."""
    day = lambda back: F.date_format(F.date_sub(F.to_date("o_orderdate"), back), "yyyy-MM-dd")
    given = v.table("orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"), F.when(F.col("o_orderkey") % 2 == 0, day(100)).otherwise("").alias("a"), F.when(F.col("o_orderkey") % 3 == 0, day(0)).otherwise("").alias("b"))
    return given.select("o_orderkey", lb.default_window("d", "a", "b").alias("x")).select("o_orderkey", F.col("x.start").alias("s"), F.col("x.end").alias("e"))


query("f15_labels", ["raw"], "SELECT event_id, printf('lat=%.4f/lon=%.4f', lat, lon) AS cell, strftime(run_ts, '%Y%m%dT%H%M%SZ') AS run, strftime(run_ts, '%Y-%m-%dT%H-%M-%SZ') AS version, strftime(run_ts, '%b %d, %H:%M') || ' · 3h forecast' AS label, 'bt|' || event_id || '|' || marz AS k, marz AS part FROM raw")(
    lambda v: v.raw().withColumn("h", F.lit(3)).select("event_id", lb.cell_id("lat", "lon").alias("cell"), lb.run_stamp("run_ts").alias("run"), lb.version_id("run_ts").alias("version"), lb.snapshot_label("run_ts", "h").alias("label"), lb.encode_key("bt", "event_id", "marz").alias("k")).withColumn("part", lb.decode_key("k", 2)))


# ---- samples and scores ------------------------------------------------------------------------
query("w4_sliding_samples", ["dense", "ranked", "windows", "samples"], "SELECT region, anchor_ts, inputs, targets FROM samples")(
    lambda v: sm.sliding_samples(v.dense(), PLACE, "observed_at", [V], V, 6, 3, 4).select("region", "anchor_ts", F.transform("inputs", lambda x: x[V]).alias("inputs"), "targets"))
query("w5_anchors", ["dense", "ranked"], "SELECT region, observed_at FROM ranked WHERE rn >= 24 AND (total - rn) % 12 = 0")(lambda v: sm.anchors(v.dense(), PLACE, "observed_at", 24, 12, "end").select("region", "observed_at"))
query("w11_chrono_split", ["dense", "ranked", "windows", "samples"], ", r AS (SELECT *, row_number() OVER (ORDER BY anchor_ts, region) AS i, count(*) OVER () AS total FROM samples) SELECT region, anchor_ts, CASE WHEN i <= floor(total * (1.0::DOUBLE - 0.2::DOUBLE)) THEN 'train' ELSE 'val' END AS split FROM r")(
    lambda v: sm.chrono_split(sm.sliding_samples(v.dense(), PLACE, "observed_at", [V], V, 6, 3, 4).select("region", "anchor_ts"), "anchor_ts", ["region"], 0.2))
query("p6_trim_to_cutoff", None, "SELECT event_id FROM events WHERE ts <= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")(lambda v: sm.trim_to_cutoff(v.table("events"), "ts", 7).select("event_id"))
query("p5_complete_rows", ["raw", "silver"], ", l AS (SELECT *, lag(temperature_2m, 3) OVER (PARTITION BY region, dataset, lat, lon ORDER BY observed_at) AS lag3 FROM silver) SELECT region, dataset, lat, observed_at FROM l WHERE lag3 IS NOT NULL AND temperature_2m IS NOT NULL")(
    lambda v: sm.complete_rows(ft.add_lags(v.silver(), SERIES, "observed_at", V, (3,)), [V, f"{V}_lag_3h"]).select("region", "dataset", "lat", "observed_at"))
query("p7_anchors_between", None, "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20 12:00:00'")(lambda v: sm.anchors_between(v.table("events").withColumn("ts", instant("ts")), "ts", "2024-01-05", "2024-01-20 12:00:00").select("event_id"))
query("a17_fit_scaler", ["dense"], """SELECT 'temperature_2m' AS "column", round(avg(temperature_2m), 6) AS mean, round(stddev_pop(temperature_2m), 6) AS std FROM dense UNION ALL SELECT 'n', round(avg(n), 6), round(stddev_pop(n), 6) FROM dense""")(
    lambda v: sm.fit_scaler(v.dense(), [V, "n"]).select("column", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std")))
query("a17_window_scaler", ["dense", "ranked", "windows", "samples"], """SELECT 'temperature_2m' AS "column", round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM (SELECT unnest(inputs) AS x FROM samples)""")(
    lambda v: sm.fit_window_scaler(sm.sliding_samples(v.dense(), PLACE, "observed_at", [V], V, 6, 3, 4), [V]).select("column", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std")))
query("f22_apply_scaler", ["dense"], "SELECT region, observed_at, round((temperature_2m - (SELECT avg(temperature_2m) FROM dense)) / (SELECT stddev_pop(temperature_2m) FROM dense), 6) AS z FROM dense")(
    lambda v: sm.apply_scaler(v.dense(), sm.fit_scaler(v.dense(), [V]), [V]).select("region", "observed_at", F.round(V, 6).alias("z")))
query("w12_batch_ids", ["dense", "ranked"], "SELECT region, observed_at, (rn - 1) // 50 AS batch_id FROM ranked")(lambda v: sm.batch_ids(v.dense(), ["observed_at"], 50, ["region"]).select("region", "observed_at", "batch_id"))
query("t8_evenly_spaced", ["dense"], ", r AS (SELECT region, observed_at, row_number() OVER (ORDER BY observed_at, region) - 1 AS i, count(*) OVER () AS n FROM dense) SELECT region, observed_at FROM r WHERE i IN (SELECT floor(k * (n - 1) / 8)::BIGINT FROM range(9) t(k))")(
    lambda v: sm.evenly_spaced(v.dense(), ["observed_at", "region"], 9).select("region", "observed_at"))
query("m3_walk_forward", DENSE[:6], "SELECT location_id, prediction_made_at, target_time, h_ahead, predicted_value FROM preds")(lambda v: v.preds().select("location_id", "prediction_made_at", "target_time", "h_ahead", "predicted_value"))
query("j3_backfill_actuals", DENSE[:7], "SELECT location_id, prediction_made_at, target_time, actual_value, actual_value IS NOT NULL AS filled_now FROM filled")(lambda v: v.filled().select("location_id", "prediction_made_at", "target_time", "actual_value", "filled_now"))
# nine decimals: a mean of three squares may lie halfway between two numbers of six, and the order of summing would decide
query("a6_score_groups", DENSE, "SELECT location_id, model_version, prediction_made_at, n_hours, round(mse, 9) AS mse FROM groups")(lambda v: ev.score_groups(v.filled()).withColumn("mse", F.round("mse", 9)))
METRICS = "count(*) AS n, round(avg(abs(p - t)), 6) AS mae, round(sqrt(avg((p - t) * (p - t))), 6) AS rmse, round(avg(abs((p - t) / CASE WHEN abs(t) < 1e-3 THEN 1e-3 ELSE t END)) * 100, 6) AS mape FROM (SELECT h_ahead, predicted_value AS p, actual_value AS t FROM filled WHERE actual_value IS NOT NULL)"


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("mae", "rmse", "mape")})


query("a14_error_metrics", DENSE[:7], f"SELECT {METRICS}")(lambda v: rounded(ev.error_metrics(v.filled().where("actual_value is not null"), "predicted_value", "actual_value")))
query("a15_error_by_horizon", DENSE[:7], f"SELECT h_ahead, {METRICS} GROUP BY h_ahead")(lambda v: rounded(ev.error_metrics(v.filled().where("actual_value is not null"), "predicted_value", "actual_value", ["h_ahead"])))
query("a10_prediction_summary", DENSE[:7], "SELECT count(*) AS n_rows, count(DISTINCT prediction_made_at) AS n_snapshots, count(actual_value) AS n_filled, max(prediction_made_at) AS latest FROM filled")(lambda v: rp.prediction_summary(v.filled()))
query("a5_snapshots", DENSE[:7], "SELECT prediction_made_at, count(DISTINCT target_time) AS n_hours, prediction_made_at = (SELECT max(prediction_made_at) FROM filled) AS is_latest FROM filled GROUP BY 1 ORDER BY 1 DESC LIMIT 50")(lambda v: rp.snapshots(v.filled()))
@query("a4_snapshot_values", DENSE[:7], "SELECT target_time, prediction_made_at, round(avg(predicted_value), 6) AS predicted, round(avg(actual_value), 6) AS actual FROM filled WHERE prediction_made_at IN (SELECT DISTINCT prediction_made_at FROM filled ORDER BY 1 DESC LIMIT 5) GROUP BY 1, 2")
def snapshot_values(v):
    """The five newest runs."""
    filled = v.filled()
    values = rp.snapshot_values(filled, rp.snapshots(filled, n=5))
    return values.select("target_time", "prediction_made_at", F.round("predicted", 6).alias("predicted"), F.round("actual", 6).alias("actual"))


query("w8_best_groups", DENSE, "SELECT g.location_id, g.prediction_made_at, n_hours, round(mse, 6) AS mse, region, 6 AS seq_in FROM groups g JOIN dim_location USING (location_id) ORDER BY g.mse, g.location_id, g.prediction_made_at LIMIT 200")(
    lambda v: rp.best_groups(ev.score_groups(v.filled()), v.preds(), v.dim_location(v.dense())).select("location_id", "prediction_made_at", "n_hours", F.round("mse", 6).alias("mse"), "region", "seq_in"))
query("j18_anchor_actual", DENSE[:6], "SELECT DISTINCT location_id, prediction_made_at, predicted_value AS anchor_value FROM preds")(
    lambda v: (lambda s: rp.anchor_actual(v.preds(), s[0], s[2], V).select("location_id", "prediction_made_at", "anchor_value"))(v.star(v.dense())))
@query("f21_signed_error", DENSE[:7], "SELECT location_id, prediction_made_at, target_time, CASE WHEN actual_value IS NULL THEN 'pending' ELSE (CASE WHEN e < 0 THEN '-' ELSE '+' END) || round(abs(e)::VARCHAR::DECIMAL(30, 17), 2)::DECIMAL(18, 2)::VARCHAR END AS error FROM (SELECT *, predicted_value - actual_value AS e FROM filled)")
def signed_error(v):
    """Rounded half up, as the shortest decimal form of the difference reads."""
    return v.filled().select("location_id", "prediction_made_at", "target_time", lb.signed_error("predicted_value", "actual_value").alias("error"))


query("p13_visible_range", DENSE[:6], "SELECT region, observed_at FROM dense WHERE observed_at >= (SELECT min(target_time) FROM preds WHERE prediction_made_at > TIMESTAMP '2024-01-20') - INTERVAL 1 DAY AND observed_at <= (SELECT max(target_time) FROM preds)")(
    lambda v: rp.visible_range(v.dense(), v.preds().where("prediction_made_at > timestamp'2024-01-20'")).select("region", "observed_at"))
@query("a20_walk_forward_report", DENSE[:6], "SELECT count(*) AS rows, count(DISTINCT (location_id, prediction_made_at)) AS anchors, count(DISTINCT location_id) AS cells, (SELECT count(*) FROM dim_location WHERE location_id <= 2) AS skipped FROM preds WHERE location_id > 2")
def walk_forward_report(v):
    """A run whose first two cells have no row in the dimension: they are skipped, and counted."""
    dense = v.dense()
    samples = sm.sliding_samples(dense, PLACE, "observed_at", [V, "n"], V, 6, 0, 4)
    long = ev.walk_forward(sm.persistence(samples, V, 3), PLACE, lb.walkforward_version(F.lit("persistence")), 6)
    known = v.dim_location(dense).where("location_id > 2").select("location_id", *PLACE)
    return ev.walk_forward_report(long.join(known, PLACE), long.select(*PLACE).distinct().join(known, PLACE, "left_anti"))


M4_METRICS = "count(*) AS n, round(avg(abs(p - t)), 6) AS mae, round(sqrt(avg((p - t) * (p - t))), 6) AS rmse, round(avg(abs((p - t) / CASE WHEN abs(t) < 1e-3 THEN 1e-3 ELSE t END)) * 100, 6) AS mape, round(avg(abs(l - t)), 6) AS persistence_mae, round(sqrt(avg((l - t) * (l - t))), 6) AS persistence_rmse"
M4_SQL = f""", r AS (SELECT *, row_number() OVER (ORDER BY anchor_ts, region) AS i, count(*) OVER () AS total FROM samples),
v AS (SELECT inputs[6] AS l, list_sum(inputs) / 6 AS p, unnest(targets) AS t, unnest([1, 2, 3]) AS h FROM r WHERE i > floor(total * (1.0::DOUBLE - 0.2::DOUBLE)))
SELECT h AS h_ahead, {M4_METRICS} FROM v GROUP BY h UNION ALL SELECT 0, {M4_METRICS} FROM v"""


@query("m4_holdout_report", ["dense", "ranked", "windows", "samples"], M4_SQL)
def holdout_report(v):
    """The mean of the inputs as forecast, on the last fifth of the samples."""
    samples = sm.sliding_samples(v.dense(), PLACE, "observed_at", [V], V, 6, 3, 4)
    held = sm.chrono_split(samples, "anchor_ts", ["region"], 0.2).where("split = 'val'")
    mean = F.aggregate("inputs", F.lit(0.0), lambda a, x: a + x[V]) / 6
    report = ev.holdout_report(held.withColumn("preds", F.array_repeat(mean, 3)), V)
    return report.withColumns({c: F.round(c, 6) for c in ("mae", "rmse", "mape", "persistence_mae", "persistence_rmse")})


# ---- all ten measures, and the jobs that build the lake ---------------------------------------
TEN = ", ".join(f"CASE WHEN n > 1 THEN temperature_2m + {k} END AS {m}" if m == "wind_gusts_10m" else f"temperature_2m + {k} AS {m}" for k, m in enumerate(br.MEASURES))


@query("f7_flatten_ten_measures", ["dense"], f"SELECT region, observed_at, {TEN} FROM dense")
def flatten_ten(v):
    docs = br.pack_hourly(v.wide(), ["region", "date"], "observed_at", br.MEASURES)
    return br.flatten_hourly(docs, br.MEASURES, keep=["region"])


@query("j1_fact_ten_measures", ["dense", "dim_location", "dim_time"], f"SELECT location_id, time_id, dataset, {TEN} FROM dense JOIN dim_location USING (region, lat, lon) JOIN dim_time USING (observed_at)")
def fact_ten(v):
    rows = v.wide()
    return st.build_fact(rows, v.dim_location(rows), v.dim_time(rows), PLACE, br.MEASURES)


@query("c1_silver_layer", ["dense"], f"SELECT region AS marz, observed_at, observed_at::DATE AS date, {TEN} FROM dense")
def silver_layer(v):
    return tb.read_layer(v.spark, f"{v.layers()}/silver").select("marz", "observed_at", "date", *br.MEASURES)


@query("c3_star_tables", ["dense", "dim_location", "dim_time"], f"SELECT location_id, time_id, 'archive' AS dataset, {TEN} FROM dense JOIN dim_location USING (region, lat, lon) JOIN dim_time USING (observed_at)")
def star_tables(v):
    return jobs.current_table(v.spark, f"{v.lake()}/star", "fact").select("location_id", "time_id", "dataset", *br.MEASURES)


@query("c4_prediction_ledger", DENSE[:7], "SELECT location_id, model_version, prediction_made_at, target_time, predicted_value, actual_value FROM filled")
def prediction_ledger(v):
    return v.ledger("predictions", "persistence").select("location_id", "model_version", "prediction_made_at", "target_time", "predicted_value", "actual_value")


@query("c6_scored_groups", DENSE, "SELECT location_id, model_version, prediction_made_at, n_hours, round(mse, 9) AS mse FROM groups")
def scored_groups(v):
    return v.ledger("scored_groups", "persistence").select("location_id", "model_version", "prediction_made_at", "n_hours", F.round("mse", 9).alias("mse"))


@query("v4_add_column", ["dense"], "SELECT DISTINCT region AS marz, NULL::VARCHAR AS note FROM dense")
def add_column(v):
    """A table over the lake's silver layer gets a column it lacks, once."""
    name = f"tide_{v.layers()[-8:]}"
    tb.register_external(v.spark, name, f"{v.layers()}/silver")
    added = [tb.add_column_if_absent(v.spark, name, "note", "STRING") for _ in range(2)]
    if added[1]:
        raise ValueError("the column was added twice")
    return v.spark.table(name).select("marz", "note").distinct()


@query("m1_fit_and_score", ["dense", "ranked", "windows", "samples"], """, s AS (SELECT region, anchor_ts, inputs[6] AS x, targets[1] AS y FROM samples) SELECT region, anchor_ts, round((SELECT regr_intercept(y, x) FROM s) + (SELECT regr_slope(y, x) FROM s) * x, 6) AS pred FROM s""")
def fit_and_score(v):
    s = sm.sliding_samples(v.dense(), PLACE, "observed_at", [V], V, 6, 3, 4)
    models = ev.fit_horizons(s, [V], 1)
    return ev.score(s, models, [V]).select("region", "anchor_ts", F.round(F.get("preds", F.lit(0)), 6).alias("pred"))


@query("m2_score_with", ["dense", "ranked", "windows", "samples"], "SELECT region, anchor_ts, round(list_sum(inputs) / 6, 6) AS pred FROM samples")
def score_with(v):
    s = sm.sliding_samples(v.dense(), PLACE, "observed_at", [V], V, 6, 3, 4).select("region", "anchor_ts", F.transform("inputs", lambda x: x[V]).alias("inputs"))

    def mean(frames):
        for f in frames:
            yield f.assign(pred=[float(sum(x) / len(x)) for x in f["inputs"]])[["region", "anchor_ts", "pred"]]

    return ev.score_with(s, mean, "region string, anchor_ts timestamp, pred double").withColumn("pred", F.round("pred", 6))


# ---- the window model: all horizons in one fit --------------------------------------------------
def dense_windows(v: Views) -> DataFrame:
    return v.windows(add_calendar(v.dense(), "observed_at"))


@query("m1_fit_windows", FIT, "SELECT region, p3.anchor_ts, round(preds[1], 6) AS h1, round(preds[2], 6) AS h2, round(preds[3], 6) AS h3, round(val_mse, 6) AS val_mse FROM p3 JOIN s3 USING (region, anchor_ts), val_error")
def fit_windows(v):
    """Three horizons from six scaled values in one pass, and the error on the last fifth of the windows."""
    windows = dense_windows(v)
    model = v.fit(windows)
    horizons = [F.round(F.get("preds", F.lit(h)), 6).alias(f"h{h + 1}") for h in range(3)]
    return fc.predict(windows, model).select("region", "anchor_ts", *horizons, F.lit(round(model.val_mse, 6)).alias("val_mse"))


M4_FIT_SQL = f""", v AS (SELECT a[3] AS l, unnest(preds) AS p, unnest(p3.targets) AS t, unnest([1, 2, 3]) AS h FROM p3 JOIN s3 USING (region, anchor_ts, a) WHERE NOT train)
SELECT h AS h_ahead, {M4_METRICS} FROM v GROUP BY h UNION ALL SELECT 0, {M4_METRICS} FROM v"""


@query("m4_fitted_report", FIT, M4_FIT_SQL)
def fitted_report(v):
    """The fitted model on the last fifth of the windows, beside persistence."""
    windows = dense_windows(v)
    held = windows.where(~fc.training_part(windows, PLACE, 0.2))
    report = ev.holdout_report(fc.predict(held, v.fit(windows)), V)
    return report.withColumns({c: F.round(c, 6) for c in ("mae", "rmse", "mape", "persistence_mae", "persistence_rmse")})


@query("c4_fitted_ledger", ["dense", "dim_location", "dim_time", "fact", *FIT[1:]], """SELECT location_id, 'walkforward:linear' AS model_version, anchor_ts AS prediction_made_at, target_time, round(predicted, 6) AS predicted_value, f.temperature_2m AS actual_value
FROM (SELECT region, anchor_ts, anchor_ts + h * INTERVAL 1 HOUR AS target_time, preds[h] AS predicted FROM p3, range(1, 4) AS x(h)) JOIN dim_location USING (region)
LEFT JOIN (SELECT location_id, observed_at AS target_time, temperature_2m FROM fact JOIN dim_time USING (time_id)) f USING (location_id, target_time)""")
def fitted_ledger(v):
    """The walk-forward run of the lake's stored model."""
    return v.ledger("predictions", "linear").select("location_id", "model_version", "prediction_made_at", "target_time", F.round("predicted_value", 6).alias("predicted_value"), "actual_value")


@query("m5_model_store", FIT, "SELECT 'linear' AS version, 1 AS epoch, 3 AS seq_in, 3 AS seq_out, round(val_mse, 6) AS metric FROM val_error")
def model_store(v):
    return list_models(v.spark, f"{v.lake()}/models").select("version", "epoch", "seq_in", "seq_out", F.round("metric", 6).alias("metric"))


# ---- the lake by its folders and catalog ---------------------------------------------------------
@query("s16_coverage_by_keys", ["dense"], "SELECT DISTINCT 'archive' AS dataset, observed_at::DATE AS date FROM dense")
def coverage_by_keys(v):
    """Dates of the gold layer from the names of its folders."""
    return fl.list_coverage(v.spark, f"{v.layers()}/gold")


@query("s20_files_per_layer", ["dense"], "SELECT layer, count(DISTINCT observed_at::DATE) AS dates, true AS has_files FROM dense, (SELECT unnest(['silver', 'gold']) AS layer) GROUP BY layer")
def files_in_layers(v):
    root = v.layers()
    dates = [fl.list_coverage(v.spark, f"{root}/{n}").agg(F.count("date").alias("dates")).withColumn("layer", F.lit(n)) for n in ("silver", "gold")]
    counted = fl.files_per_layer(v.spark, {n: f"{root}/{n}" for n in ("silver", "gold")})
    return counted.join(dates[0].unionByName(dates[1]), "layer").select("layer", "dates", (F.col("files") > 0).alias("has_files"))


@query("s10_dim_read_back", ["dense", "dim_location", "dim_time"], "SELECT 'location' AS dim, location_id AS id, region AS label FROM dim_location UNION ALL SELECT 'time', time_id, strftime(observed_at, '%Y-%m-%dT%H:%M') FROM dim_time")
def dim_read_back(v):
    """The dimensions that the load has numbered, as the catalog has them."""
    root = f"{v.lake()}/star"
    places = jobs.current_table(v.spark, root, "dim_location").select(F.lit("location").alias("dim"), F.col("location_id").alias("id"), F.col("region").alias("label"))
    times = jobs.current_table(v.spark, root, "dim_time").select(F.lit("time").alias("dim"), F.col("time_id").alias("id"), utc_minute_text("observed_at").alias("label"))
    return places.unionByName(times)


# ---- one series over many tasks ------------------------------------------------------------------
# nine decimals: a mean of hourly values with four may lie halfway between two numbers of six
ONE_GOLD = GOLD_SQL.replace("FROM silver", "FROM one").replace("OVER r, 6)", "OVER r, 9)")


@query("c2_gold_of_one_series", ["dense"], ", one AS (SELECT 'all' AS region, 'archive' AS dataset, 1.0::DOUBLE AS lat, 2.0::DOUBLE AS lon, observed_at, max(temperature_2m) AS temperature_2m FROM dense GROUP BY observed_at)\n" + ONE_GOLD)
def gold_of_one_series(v):
    """Gold features where all hours belong to one place, in slices of a hundred rows."""
    place = {"region": F.lit("all"), "dataset": F.lit("archive"), "lat": F.lit(1.0), "lon": F.lit(2.0)}
    one = v.dense().groupBy("observed_at").agg(F.max(V).alias(V)).withColumns(place)
    g = sl.build_gold_in_slices(one, SERIES, "observed_at", V, 100)
    return g.select("region", "dataset", "lat", "observed_at", V, "hour", "day_of_week", "month", "season", "is_weekend", f"{V}_lag_1h", f"{V}_lag_3h", f"{V}_lag_24h", F.round(f"{V}_roll24_mean", 9).alias("mean24"), F.round(f"{V}_roll24_std", 9).alias("std24"))


@query("j6_asof_of_one_key", None, "SELECT a.event_id, (SELECT max(b.ts) FROM events b WHERE b.event_type = 'purchase' AND b.ts <= a.ts) AS r_ts FROM events a WHERE a.event_type <> 'purchase'")
def asof_of_one_key(v):
    """Each event with the newest purchase of anyone before it: one key, in slices of a thousand rows."""
    e = v.table("events").select(F.lit(1).alias("k"), "event_id", "ts", "event_type")
    left, right = e.where("event_type <> 'purchase'").drop("event_type"), e.where("event_type = 'purchase'").select("k", F.col("ts").alias("r_ts"))
    return sl.asof_backward_in_slices(left, right, ["k"], "ts", "r_ts", [], 1000).select("event_id", "r_ts")
