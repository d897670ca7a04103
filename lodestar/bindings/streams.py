"""Stream operators (T) on the given tables: events are samples, users sessions. Batch replays; the stream form is run over the same files."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.bindings.registry import SQL, bound, table
from lodestar.bindings.spatial import _DIST, _ELEM, TOUCHERS, charts, elements
from lodestar.sources.scratch import scratch
from lodestar.streaming import events as E
from lodestar.streaming import selection as S
from lodestar.streaming import stateful as R
from lodestar.streaming.consumer import consumed

col = F.col


def from_events(ev, micros):
    """Samples of 15 a second: event number k of the table is at k / 15 seconds; a value over 120 means no hand."""
    hand = col("value") <= 120
    x, y = (col("event_id") % 700) / 7.0, (col("event_id") % 310) / 3.1
    gap = F.when(col("value") > 60, 40.0).otherwise(20.0)
    return ev.select("user_id", charts(col("user_id"), 5, TOUCHERS).alias("chart"), col("event_id").alias("n"), micros.alias("t"), F.when(hand, x).alias("x"), F.when(hand, y).alias("y"), F.when(hand, x + gap).alias("x2"), F.when(hand, y).alias("y2"), F.when(col("value") > 5, 90.0).alias("palm")).withColumnRenamed("user_id", "session")


def samples(spark, d):
    return from_events(table(spark, d, "events"), col("event_id") / 15.0)


@bound("t1_samples", "select user_id as session, event_id as n, event_id/15.0::double as t, case when value <= 120 then round((event_id % 700)/7.0::double, 6) end as x from events")
def t1(spark, d):
    return samples(spark, d).select("session", "n", "t", F.round("x", 6).alias("x"))


_SAMPLES = """s as (select user_id as session, event_id as n, event_id/15.0::double as t, case when value <= 120 then (event_id % 700)/7.0::double end as x, case when value <= 120 then (event_id % 310)/3.1::double end as y,
 case when value <= 120 then case when value > 60 then 40.0::double else 20.0 end end as gap, case when value > 5 then 90.0::double end as palm from events)"""


@bound("t2_one_euro", f"""with recursive {_SAMPLES}, k as (select *, row_number() over (partition by session order by t, n) as i from s where x is not null),
 r as (select session, n, t, i, x as sx, y as sy, 0.0::double as vx, 0.0::double as vy from k where i = 1
 union all select k.session, k.n, k.t, k.i, w.w*k.x + (1 - w.w)*r.sx, w.w*k.y + (1 - w.w)*r.sy, v.vx, v.vy from r join k on k.session = r.session and k.i = r.i + 1, lateral (select k.t - r.t as dt) d, lateral (select 1/(1 + 1/(2*pi()*1.0*d.dt)) as u) u,
 lateral (select u.u*(k.x - r.sx)/d.dt + (1 - u.u)*r.vx as vx, u.u*(k.y - r.sy)/d.dt + (1 - u.u)*r.vy as vy) v, lateral (select 1/(1 + 1/(2*pi()*(1.5 + 0.05*sqrt(v.vx*v.vx + v.vy*v.vy))*d.dt)) as w) w)
 select session, n, round(t, 6) as t, round(sx, 6) as sx, round(sy, 6) as sy from r""")
def t2(spark, d):
    return S.filtered(samples(spark, d)).withColumns({c: F.round(c, 6) for c in ("t", "sx", "sy")})


@bound("t3_pinch", f"""with recursive {_SAMPLES}, k as (select *, row_number() over (partition by session order by t, n) as i, gap is null as lost, case when palm between 45 and 160 then gap <= 0.28*palm else gap <= 22 end as tight, case when palm between 45 and 160 then gap >= 0.36*palm else gap >= 28 end as slack from s),
 r as (select session, n, i, t, coalesce(tight, false) as closed, null::double as opening, case when not lost then t end as seen from k where i = 1
 union all select k.session, k.n, k.i, k.t, case when not r.closed then coalesce(tight, false) when lost then (k.t - r.seen)*1000 < 300 when slack then (k.t - coalesce(r.opening, k.t))*1000 < 250 else true end,
 case when r.closed and slack and (k.t - coalesce(r.opening, k.t))*1000 < 250 then coalesce(r.opening, k.t) end, case when lost then r.seen else k.t end from r join k on k.session = r.session and k.i = r.i + 1)
 select session, n, closed as active from r""")
def t3(spark, d):
    return S.pinched(samples(spark, d))


@bound("t4_debounce", """with recursive k as (select user_id, event_id, event_id/15.0::double as t, event_type as v, row_number() over (partition by user_id order by event_id/15.0, event_id) as i from events),
 a as (select user_id, 0::bigint as event_id, 0::bigint as i, null::varchar as stable, false as waiting, null::varchar as nxt, 0.0::double as since from k where i = 1
 union all select k.user_id, k.event_id, k.i, case when m.held then k.v else a.stable end, k.v is distinct from a.stable and not m.held, k.v, m.since from a join k on k.user_id = a.user_id and k.i = a.i + 1,
 lateral (select case when a.waiting and a.nxt is not distinct from k.v then a.since else k.t end as since) q, lateral (select q.since, k.v is distinct from a.stable and (k.t - q.since)*1000 >= case when a.stable is null then 60 when k.v is null then 150 else 120 end as held) m)
 select user_id, event_id, stable as estable from a where i > 0""")
def t4(spark, d):
    ev = table(spark, d, "events").select("user_id", (col("event_id") / 15.0).alias("t"), "event_id", "event_type")
    return S.debounced(ev, "user_id", "t", "event_id", "event_type")


@bound("u2_held", SQL["t4_debounce"].replace("stable as estable", "stable as selection").replace("select user_id, event_id, stable", "select user_id as session, event_id as n, stable"))
def u2(spark, d):
    """T4 as a consumer of its name, made and configured for each session."""
    ev = table(spark, d, "events").select(col("user_id").alias("session"), (col("event_id") / 15.0).alias("t"), col("event_id").alias("n"), col("event_type").alias("value"))
    return consumed(ev, "held", {"enter": 60, "change": 120, "leave": 150})


#: The filter does not hang on the choice: first each sample's pinch and smoothed place, then what lies near it, then the choice.
_PLACED = f"""{_SAMPLES.replace("end as palm from events", "end as palm, user_id % 5 + 5*(user_id // 75) as chart from events")}, k as (select *, row_number() over (partition by session order by t, n) as i, gap is null as lost, case when palm between 45 and 160 then gap <= 0.28*palm else gap <= 22 end as tight, case when palm between 45 and 160 then gap >= 0.36*palm else gap >= 28 end as slack from s),
 f as (select session, 0::bigint as n, 0::bigint as i, 0.0::double as t, false as closed, null::double as opening, null::double as seen, null::double as ft, null::double as fx, null::double as fy, 0.0::double as vx, 0.0::double as vy from k where i = 1
 union all select k.session, k.n, k.i, k.t, q.closed, case when f.closed and not k.lost and k.slack and (k.t - coalesce(f.opening, k.t))*1000 < 250 then coalesce(f.opening, k.t) end, case when k.lost then f.seen else k.t end,
 case when not k.lost then k.t when q.closed then f.ft end, case when k.lost then f.fx when z.old is null then k.x else w.w*k.x + (1 - w.w)*f.fx end, case when k.lost then f.fy when z.old is null then k.y else w.w*k.y + (1 - w.w)*f.fy end, case when k.lost then f.vx when z.old is null then 0 else v.vx end, case when k.lost then f.vy when z.old is null then 0 else v.vy end
 from f join k on k.session = f.session and k.i = f.i + 1, lateral (select case when not f.closed then coalesce(k.tight, false) when k.lost then (k.t - f.seen)*1000 < 300 when k.slack then (k.t - coalesce(f.opening, k.t))*1000 < 250 else true end as closed) q,
 lateral (select case when k.t - f.ft <= 300/1000 then f.ft end as old) z, lateral (select k.t - z.old as dt) d, lateral (select 1/(1 + 1/(2*pi()*1.0*d.dt)) as u) u, lateral (select u.u*(k.x - f.fx)/d.dt + (1 - u.u)*f.vx as vx, u.u*(k.y - f.fy)/d.dt + (1 - u.u)*f.vy as vy) v,
 lateral (select 1/(1 + 1/(2*pi()*(1.5 + 0.05*sqrt(v.vx*v.vx + v.vy*v.vy))*d.dt)) as w) w)"""
_SELECTED = f"""with recursive e as ({_ELEM}), {_PLACED}, p as (select f.*, k.chart, k.lost from f join k on f.session = k.session and f.i = k.i),
 m as (select session, i, e.*, {_DIST.replace("px", "fx").replace("py", "fy")} as d from p join e on p.chart = e.chart where not lost),
 near as (select session, i, list(struct_pack(n := n, id := id, series := series, priority := priority, d := d, radius := radius, worth := d - case when shape = 'punto' then 3 else 0 end) order by n) as found from m where d <= radius + 2 group by all),
 c as (select p.session, p.n, p.i, p.t, p.closed, p.lost, coalesce(found, []) as found from p left join near on p.session = near.session and p.i = near.i),
 r as (select session, n, 0::bigint as i, t, closed, null::varchar as stable, null::varchar as run, null::double as since, '' as series, null::double as series_at, []::varchar[] as reach from c where i = 1
 union all select c.session, c.n, c.i, c.t, c.closed, case when c.lost and not c.closed then null else b.stable end, case when c.lost and not c.closed then null else h.run end, case when c.lost and not c.closed then null else h.since end,
 case when g.followed then g.series else r.series end, case when g.followed then c.t else r.series_at end, o.reach
 from r join c on c.session = r.session and c.i = r.i + 1, lateral (select [x for x in c.found if x.d - if(x.id is not distinct from r.stable, 2, 0) <= x.radius] as own) a,
 lateral (select [x.id for x in a.own] as reach, list_min([struct_pack(v := x.worth - if(x.id is not distinct from r.stable, 2, 0), priority := x.priority, n := x.n, id := x.id, series := x.series) for x in a.own if x.priority < 10]) as first,
 list_min([struct_pack(v := x.worth - if(x.id is not distinct from r.stable, 2, 0), priority := x.priority, n := x.n, id := x.id, series := x.series) for x in a.own if x.priority < 10 and r.series <> '' and c.t - r.series_at <= 1.5 and x.series = r.series]) as same,
 list_min([struct_pack(v := x.d - if(x.id is not distinct from r.stable, 2, 0), priority := x.priority, n := x.n, id := x.id) for x in a.own if x.priority >= 10]) as rest) o,
 lateral (select case when o.same.v - 3 <= o.first.v then o.same else o.first end as best) j, lateral (select case when j.best is null then o.rest.id when o.rest.v + 3 < j.best.v then o.rest.id else j.best.id end as hit) l,
 lateral (select case when c.lost then r.run else l.hit end as run, case when c.lost or l.hit is not distinct from r.run then r.since else c.t end as since) h,
 lateral (select case when c.lost then r.stable when r.stable is null and h.run is not null and (c.t - h.since)*1000 >= 60 then h.run when r.stable is not null and h.run is not null and (c.t - h.since)*1000 >= 120 then h.run when r.stable is not null and h.run is null and (c.t - h.since)*1000 >= 150 then null else r.stable end as stable) b,
 lateral (select coalesce(not c.lost and len([x for x in c.found if x.id = b.stable]) > 0, false) as there) y, lateral (select max(series) as series, coalesce(bool_or(not c.lost and priority < 10), false) as followed from e where e.id = b.stable) g)
 select session, n, round(t, 6) as t, closed as active, stable as element, array_to_string(reach, ',') as candidates from r where i > 0"""


def shown(found):
    return found.select("session", "n", F.round("t", 6).alias("t"), "active", "element", F.array_join("candidates", ",").alias("candidates"))


@bound("t5_selection", _SELECTED)
def t5(spark, d):
    return shown(S.replay(samples(spark, d), elements(spark, d)))


def running(spark, d, query, schema, mark=None, ended=False):
    """A stream over the file of events, run to its end into a written table. mark: how long the watermark waits. ended: nothing comes after the files, so the watermark passes their last millisecond too; it follows the column seen."""
    given = spark.read.parquet(f"{d}/events.parquet")
    reader = spark.readStream.schema(given.schema)
    single = all(f.endswith("/events.parquet") for f in given.inputFiles())
    ev = reader.option("pathGlobFilter", "events.parquet").parquet(d) if single else reader.parquet(f"{d}/events.parquet")
    ev = ev.withColumns({c: ev[c].cast("timestamp") for c, t in ev.dtypes if t == "timestamp_ntz"})
    if ended:
        ev, mark = ev.withColumn("seen", ev["ts"] + F.expr("interval 1 millisecond")).withWatermark("seen", mark), None
    out = scratch(spark, "stream")
    with R.rocksdb(spark):
        run = query(ev.withWatermark("ts", mark) if mark else ev).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/rows")


@bound("t5_selection_stream", _SELECTED)
def t5b(spark, d):
    """The stream over the same file; charts' elements are the sessions' initial state."""
    sessions = table(spark, d, "events").select(col("user_id").alias("session"), charts(col("user_id"), 5, TOUCHERS).alias("chart"))
    return shown(running(spark, d, lambda ev: R.selected(from_events(ev, col("event_id") / 15.0), sessions, elements(spark, d)), R.SELECTED))


_ON = "on_ as (select user_id, event_id, ts, value > 30 as e, case when value > 45 then event_type end as el, lag(value > 30) over (partition by user_id order by ts, event_id) as was from events), act as (select *, sum((e and not coalesce(was, false))::int) over (partition by user_id order by ts, event_id rows unbounded preceding) as activacion from on_)"


def touched(spark, d):
    return table(spark, d, "events").select("user_id", "event_id", "ts", "value", F.when(col("value") > 45, col("event_type")).alias("el"))


@bound("t6_announcements", f"with {_ON}, s as (select *, lag(el) over (partition by user_id, activacion order by ts, event_id) as p from act where e and el is not null) select user_id, event_id, activacion::bigint as activacion, el from s where el is distinct from p")
def t6(spark, d):
    return E.announcements(touched(spark, d), ["user_id"], col("value") > 30, "el", ["ts", "event_id"]).select("user_id", "event_id", "activacion", "el")


@bound("t7_crossing_once", f"with {_ON}, s as (select *, lag(el) over (partition by user_id, activacion order by ts, event_id) as p from act where e and el is not null), a as (select * from s where el is distinct from p), k as (select *, row_number() over (partition by user_id, activacion, el order by ts, event_id) as k from a) select user_id, event_id, el from k where k = 1")
def t7(spark, d):
    a = E.announcements(touched(spark, d), ["user_id"], col("value") > 30, "el", ["ts", "event_id"])
    return E.first_in_activation(a, ["user_id"], "activacion", ["el"], ["ts", "event_id"]).select("user_id", "event_id", "el")


@bound("t8_limited_alerts", """with recursive k as (select user_id, event_id, epoch_us(ts)/1e6 as t, value > 20 as f, row_number() over (partition by user_id order by epoch_us(ts)/1e6, event_id) as i from events),
 r as (select user_id, 0::bigint as event_id, 0::bigint as i, 0.0::double as t, null::double as since, '-infinity'::double as sent, false as alert from k where i = 1
 union all select k.user_id, k.event_id, k.i, k.t, q.since, case when m.alert then k.t else r.sent end, m.alert from r join k on k.user_id = r.user_id and k.i = r.i + 1, lateral (select case when coalesce(k.f, false) then coalesce(r.since, k.t) end as since) q,
 lateral (select coalesce((k.t - q.since)*1000 >= 400, false) and k.t - r.sent >= 86400 as alert) m)
 select user_id, event_id, t from r where alert""")
def t8(spark, d):
    ev = table(spark, d, "events").select("user_id", (F.unix_micros("ts") / 1e6).alias("t"), "event_id", (col("value") > 20).alias("fuera"))
    return S.limited_alerts(ev, "user_id", "t", "event_id", "fuera", 400, 86400)


@bound("t9_confirmed", """with l as (select user_id, event_id, value/40 as x, lag(value/40) over w as p, lead(value/40) over w as n from events where event_type <> 'error' window w as (partition by user_id order by ts, event_id)) select user_id, event_id, not coalesce(abs(x-p) > 1.0, false) or coalesce(abs(x-n) <= 0.5, false) as aceptado from l""")
def t9(spark, d):
    ev = table(spark, d, "events").withColumn("x", col("value") / 40).withColumn("y", F.lit(0.0))
    return E.confirmed(ev, ["user_id"], "x", "y", col("event_type") != "error", ["ts", "event_id"], 1.0, 0.5).select("user_id", "event_id", "aceptado")


@bound("t10_inactivity", """with l as (select user_id, ts, coalesce((ts - lag(ts) over w >= interval 10 hour)::int, 0) as f from events window w as (partition by user_id order by ts)), g as (select *, sum(f) over (partition by user_id order by ts rows unbounded preceding) as g from l) select user_id, min(ts) as desde, max(ts) + interval 10 hour as aviso, count(*) as n from g group by user_id, g""")
def t10(spark, d):
    return E.inactivity(table(spark, d, "events"), ["user_id"], "ts", "10 hours")


@bound("t11_latest", "select user_id, arg_max(event_id, (ts, event_id)) as event_id, arg_max(value, (ts, event_id)) as value from events group by 1")
def t11(spark, d):
    return E.latest(table(spark, d, "events"), ["user_id"], "ts", ["event_id", "value"])


@bound("t12_throughput", "select time_bucket(interval 1 hour, ts) as desde, round(count(*)/3600.0, 9) as por_s, round(count_if(value > 50)/3600.0, 9) as hechos_s, round(median(value), 6) as ms_mediana from events group by 1")
def t12(spark, d):
    t = E.throughput(table(spark, d, "events"), "ts", col("value") > 50, "value", "1 hour")
    return t.select("desde", F.round("por_s", 9).alias("por_s"), F.round("hechos_s", 9).alias("hechos_s"), F.round("ms_mediana", 6).alias("ms_mediana"))


@bound("t13_in_order", "with m as (select *, max(ts) over (partition by user_id order by event_id % 97, event_id rows between unbounded preceding and 1 preceding) as m from events) select user_id, event_id from m where m is null or ts > m")
def t13(spark, d):
    ev = table(spark, d, "events").withColumn("o", col("event_id") % 97)
    return E.in_order(ev, ["user_id"], "ts", ["o", "event_id"]).select("user_id", "event_id")


#: Rows that the watermark has passed when the files end: all, as it waits for none.
_LAST = "(select time_bucket(interval 1 millisecond, max(ts)) from events)"


def touching(ev):
    return ev.select("user_id", "event_id", "ts", "value", (col("value") > 30).alias("activo"), F.when(col("value") > 45, col("event_type")).alias("el"), *seen(ev))


def seen(ev):
    """The column that the watermark follows, if it is not ts."""
    return [c for c in ev.columns if c == "seen"]


def ordered(ev):
    return R.in_time(touching(ev), "user_id", "ts", ["event_id"]).drop("seen")


@bound("t13_reordered_stream", f"select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) - 1 as puesto from events where ts <= {_LAST}")
def t13b(spark, d):
    """Rows of a stream let go in order of time. puesto: how many of the user's went before."""
    found = running(spark, d, lambda ev: ordered(ev), "user_id bigint, event_id bigint, ts timestamp, value double, activo boolean, el string", "0 seconds")
    return found.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("l")).select("user_id", F.posexplode("l").alias("puesto", "x")).select("user_id", col("x.event_id").alias("event_id"), col("puesto").cast("bigint").alias("puesto"))


#: No silence is so long that a user's state ends.
_NEVER = 400 * 86_400_000
_OUT = "user_id bigint, event_id bigint, ts timestamp, value double, activo boolean, el string"


@bound("t6_announcements_stream", SQL["t6_announcements"])
def t6b(spark, d):
    return running(spark, d, lambda ev: R.announced(ordered(ev), "user_id", "activo", "el", "ts", ["event_id"], _NEVER), f"{_OUT}, activacion bigint", "0 seconds", ended=True).select("user_id", "event_id", "activacion", "el")


@bound("t7_crossing_once_stream", SQL["t7_crossing_once"])
def t7b(spark, d):
    return running(spark, d, lambda ev: R.announced(ordered(ev), "user_id", "activo", "el", "ts", ["event_id"], _NEVER, first=True), f"{_OUT}, activacion bigint", "0 seconds", ended=True).select("user_id", "event_id", "el")


@bound("t8_limited_alerts_stream", SQL["t8_limited_alerts"].replace("select user_id, event_id, t from", "select user_id, event_id from"))
def t8b(spark, d):
    return running(spark, d, lambda ev: R.alerted(R.in_time(ev.select("user_id", "event_id", "ts", (col("value") > 20).alias("fuera"), *seen(ev)), "user_id", "ts", ["event_id"]).drop("seen"), "user_id", "fuera", "ts", ["event_id"], 400, 86400), "user_id bigint, event_id bigint, ts timestamp, fuera boolean", "0 seconds", ended=True).select("user_id", "event_id")


@bound("t9_confirmed_stream", f"""with a as ({SQL["t9_confirmed"].replace("from events where", f"from events where ts <= {_LAST} and")}), k as (select user_id, event_id, ts, lead(ts) over (partition by user_id order by ts, event_id) as following from events where ts <= {_LAST} and event_type <> 'error') select a.* from a join k using (user_id, event_id) where following is not null""")
def t9b(spark, d):
    """A user's last detection waits for its successor."""
    sure = lambda ev: ev.where("event_type <> 'error'").select("user_id", "event_id", "ts", (col("value") / 40).alias("x"), F.lit(0.0).alias("y"))
    return running(spark, d, lambda ev: R.confirmed(R.in_time(sure(ev), "user_id", "ts", ["event_id"]), "user_id", "x", "y", "ts", ["event_id"], 1.0, 0.5, _NEVER), "user_id bigint, event_id bigint, ts timestamp, x double, y double, aceptado boolean", "0 seconds").select("user_id", "event_id", "aceptado")


@bound("t10_inactivity_stream", SQL["t10_inactivity"] + f" having max(ts) + interval 10 hour <= {_LAST}")
def t10b(spark, d):
    """An alert for each stretch that has been over for ten hours when the files end."""
    return running(spark, d, lambda ev: R.silent(R.in_time(ev.select("user_id", "event_id", "ts"), "user_id", "ts", ["event_id"]), "user_id", "ts", 36_000_000), "user_id bigint, desde timestamp, aviso timestamp, n bigint", "0 seconds")
