"""Streaming queries run to completion over the event table as a file stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import adapters
from ..streaming import corrections as C
from . import Tables, query


def feed(t: Tables):
    schema = t.events.schema
    raw = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    cols = adapters.ADAPTERS["corrections"][1]
    return raw.selectExpr(*[f"{adapters._typed(e, c)} AS {c}" for c, e in cols])


@query("stream_correction_rules", "T1 L2", "SELECT firma_id, buero, feld, count(*) AS n FROM corrections GROUP BY ALL HAVING count(*) > 2", "corrections")
def stream_correction_rules(t: Tables):
    out, ck = C.folders(t.spark)
    C.start_rule_detector(feed(t), out, ck).awaitTermination()
    return C.latest(t.spark, out, C.KEY).select(*C.KEY, "n")


@query("stream_correction_volume", "T2", """SELECT strftime(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M') AS von, feld, count(*) AS n, round(sum(wert), 4) AS summe FROM corrections GROUP BY 1, 2""", "corrections")
def stream_correction_volume(t: Tables):
    out, ck = C.folders(t.spark)
    C.start_volume(feed(t), out, ck).awaitTermination()
    d = C.latest(t.spark, out, ["von", "feld"])
    return d.select(F.date_format("von", "yyyy-MM-dd HH:mm").alias("von"), "feld", "n", F.round("summe", 4).alias("summe"))


@query("correction_sessions", "T2", """
, s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS neu FROM corrections)
, g AS (SELECT *, sum(neu) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM s)
 SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS von, count(*) AS n FROM g GROUP BY user_id, sid""", "corrections")
def correction_sessions(t: Tables):
    return C.sessions(t.corrections).select("user_id", F.date_format("von", "yyyy-MM-dd HH:mm:ss").alias("von"), "n")


@query("sliding_correction_volume", "T2", """
, w AS (SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS b, feld FROM corrections)
, e AS (SELECT b AS von, feld FROM w UNION ALL SELECT b - INTERVAL 6 HOURS, feld FROM w)
 SELECT strftime(von, '%Y-%m-%d %H:%M') AS von, feld, count(*) AS n FROM e GROUP BY 1, 2""", "corrections")
def sliding_correction_volume(t: Tables):
    v = C.volume(t.corrections, "12 hours", "6 hours")
    return v.select(F.date_format("von", "yyyy-MM-dd HH:mm").alias("von"), "feld", "n")
