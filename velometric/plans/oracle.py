"""Equivalent SQL of the catalogue's queries, for checking results on another engine."""

from __future__ import annotations

from velometric.schema import RIDE_COLUMNS


def _sid(k: str) -> str:
    return f"""case when {k} < 10 then concat(cast({k} + 100 as varchar), '.0')
      when {k} < 60 then concat(cast({k} + 4000 as varchar), '.', lpad(cast({k} as varchar), 2, '0'))
      when {k} < 80 then concat('JC', lpad(cast({k} as varchar), 3, '0'))
      when {k} = 92 then 'Liberty State Park' when {k} = 93 then 'North Yard' when {k} = 94 then 'Depot 94'
      when {k} < 95 then concat('HB', lpad(cast({k} as varchar), 3, '0'))
      when {k} >= 95 then concat('SYS', lpad(cast({k} as varchar), 3, '0')) end"""


def _region(i: str, src: str = "src_region") -> str:
    return f"""case when {i} is null or left({i}, 1) in ('N','o','n','e') then 'None'
      when regexp_matches({i}, '^[0-9]') then case when {src} = 'JC' then 'JC' else 'NYC' end
      when regexp_matches({i}, '^JC[0-9]{{3}}') or starts_with({i}, 'Liberty State Park') then 'JC'
      when regexp_matches({i}, '^HB[0-9]{{3}}') then 'HB'
      when regexp_matches({i}, '^SYSY?[0-9]{{3}}') then 'SYS' end"""


RAW = f"""ev as (select *, cast(json_extract_string(props, '$.k') as integer) as k from events),
ev2 as (select *, case when event_id % 67 <> 0 then (k * 7 + user_id % 13) % 100 end as ek,
    ts - to_days(cast((user_id % 48 + 12) * 30 as integer)) as started_at,
    case when event_id % 97 = 0 then -(event_id % 60 * 1000000 + 500000)
         else event_id * 7919 % 100000 * 1000000 + event_id % 1000 * 1000 end as micros from ev),
raw as (select cast(event_id as varchar) as ride_id,
    case event_type when 'click' then 'classic_bike' when 'view' then 'docked_bike'
      when 'purchase' then 'electric_bike' when 'signup' then 'unknown' else 'motivate_dockless_bike' end as rideable_type,
    started_at, started_at + to_microseconds(micros) as ended_at,
    case when event_id % 101 <> 0 then concat('Stop ', cast(k as varchar), case when user_id % 7 = 0 then ' (alt)' else '' end) end as start_station_name,
    {_sid('k')} as start_station_id,
    case when ek is not null then concat('Stop ', cast(ek as varchar), case when user_id % 5 = 0 then ' (alt)' else '' end) end as end_station_name,
    {_sid('ek')} as end_station_id,
    40.7e0 + cast(k as double) / 997 + cast(user_id % 3 as double) / 9973 as start_lat,
    -74e0 + cast(k as double) / 997 as start_lng,
    40.7e0 + cast(ek as double) / 997 as end_lat, -74e0 + cast(ek as double) / 997 as end_lng,
    case when value < 50 then 'member' else 'casual' end as member_casual,
    cast(user_id % 3 as integer) as gender,
    case when user_id % 4 <> 0 then cast(user_id % 50 + 1950 as integer) end as birth_year,
    cast(user_id as integer) as bikeid,
    case when user_id % 2 = 0 then 'NYC' else 'JC' end as src_region from ev2),
ids as (select *, regexp_replace(start_station_id, '^([0-9]+)\\.0$', '\\1') as s_id,
    regexp_replace(end_station_id, '^([0-9]+)\\.0$', '\\1') as e_id from raw),
allrides as (select ride_id as "Ride ID", started_at as "Start Time", ended_at as "Stop Time",
    s_id as "Start Station ID", start_station_name as "Start Station Name",
    start_lat as "Start Station Latitude", start_lng as "Start Station Longitude",
    {_region('s_id')} as "Start Region",
    e_id as "End Station ID", end_station_name as "End Station Name",
    end_lat as "End Station Latitude", end_lng as "End Station Longitude",
    {_region('e_id')} as "End Region",
    case rideable_type when 'docked_bike' then 'classic_bike' when 'motivate_dockless_bike' then null else rideable_type end as "Rideable Type",
    case member_casual when 'member' then 'Subscriber' else 'Customer' end as "User Type",
    gender as "Gender", birth_year as "Birth Year", bikeid as "Bike ID" from ids),
rides as (select * from allrides where coalesce("Start Region", '') not in ('None', 'SYS')
    and coalesce("End Region", '') not in ('None', 'SYS')),
timed as (select *, year("Start Time") as y, month("Start Time") as mo, day("Start Time") as d,
    isodow("Start Time") - 1 as w, hour("Start Time") as h,
    cast(floor((epoch_us("Stop Time") - epoch_us("Start Time")) / 1000000.0) as bigint) as total_s,
    year("Stop Time") * 100 + month("Stop Time") as ym from rides),
t as (select *, ((total_s % 86400) + 86400) % 86400 as secs from timed)"""

ENDS = """ends as (select "Start Station ID" as id, "Start Station Name" as name, "Start Station Latitude" as lat,
      "Start Station Longitude" as lng, true as is_start, y, mo, "Start Time" as moment from t
    union all select "End Station ID", "End Station Name", "End Station Latitude", "End Station Longitude",
      false, y, mo, "Stop Time" from t),
hin as (select id, name, count(*) as cnt from ends where id is not null and name is not null group by all),
hil as (select id, lat, lng, count(*) as cnt from ends where id is not null and lat is not null and lng is not null group by all),
names as (select id, name from (select *, row_number() over (partition by id order by cnt desc, name) as rn from hin) where rn = 1),
places as (select id, sum(lat * cnt) / sum(cnt) as lat, sum(lng * cnt) / sum(cnt) as lng from hil group by id),
ecount as (select id, count(*) as ends from ends where not is_start and id is not null group by id),
dim as (select id, name, lat, lng, coalesce(ends, 0) as ends from names full join places using (id) full join ecount using (id)),
idx as (select id, row_number() over (order by id) - 1 as idx from dim),
sec as (select "Start Station ID" as sid, "End Station ID" as eid, count(*) as cnt from t
    where "Start Station ID" is not null and "End Station ID" is not null group by all),
pairs as (select s.idx as sidx, e.idx as eidx, p.cnt as count from sec p left join idx s on p.sid = s.id left join idx e on p.eid = e.id)"""

RECORDS = """rec as (select y as "Year", mo as "Month", case "Start Region" when 'HB' then 'HOB' else "Start Region" end as "Region",
    case "User Type" when 'Customer' then 'Daily' else 'Annual' end as "User Type", "Rideable Type", "Gender",
    count(*) as "Count", sum(secs)::bigint as "Duration" from t
    where "Start Region" is not null and "Rideable Type" is not null and "User Type" is not null and "Gender" is not null group by all),
lab as (select printf('%d-%02d', "Year", "Month") as m, "Region", "User Type",
    case "Gender" when 0 then 'Unknown' when 1 then 'Men' else 'Women' end as "Gender",
    case "Rideable Type" when 'classic_bike' then 'Classic' when 'electric_bike' then 'Electric' else 'Unknown' end as "Rideable Type",
    "Count" as "Rides", "Duration" / 60.0 as "Ride minutes" from rec)"""

SNAPSHOTS = """snew as (select * replace (
      case when minute("Start Time") % 3 = 0 then 0 else "Gender" end as "Gender",
      case when minute("Start Time") % 3 <> 0 then "Birth Year" end as "Birth Year",
      case when minute("Start Time") % 3 <> 0 then "Bike ID" end as "Bike ID") from rides),
snew4 as (select * from snew where hour("Start Time") <> 4),
sold as (select * from rides where hour("Start Time") <> 3),
dup as (select * from rides union all select * from rides where isodow("Start Time") = 1),
pair as (select *, 'b' as file from snew union all select *, 'a' as file from rides where isodow("Start Time") >= 6)"""

MONTHS = """om as (select strftime(o_orderdate, '%Y-%m') as m, o_orderstatus as status, o_orderpriority as priority,
    count(*) as rides, cast(sum(cast(o_totalprice as decimal(18,2))) as double) / 60 as minutes from orders group by all),
mt as (select m, sum(rides)::bigint as r, sum(minutes) as mins from om group by m),
avg12 as (select m, r, case when lag(r, 12) over (order by m) is not null
    then sum(r) over (order by m rows between 11 preceding and current row) / 12.0 end as avg from mt)"""


def _with(body: str, *extra: str) -> str:
    return f"with {', '.join([RAW, *extra])} {body}"


def _rollup(cols: dict[str, str], sums: str, by_month: bool = False) -> str:
    if by_month:
        cols = {"ym": "ym", **cols}
    picked = ", ".join(f'{e} as "{c}"' for c, e in cols.items())
    where = " and ".join(f"{e} is not null" for e in cols.values())
    totals = ["count(*) as \"Count\""] if "c" in sums else []
    if "d" in sums:
        totals.append('sum(secs)::bigint as "Duration"')
    return _with(f"select {picked}, {', '.join(totals)} from t where {where} group by {', '.join(cols.values())}")


_C = {
    "r": {"Region": '"Start Region"'},
    "y": {"Start Year": "y"},
    "m": {"Start Month": "mo"},
    "d": {"Start Day": "d"},
    "w": {"Start Weekday": "w"},
    "h": {"Start Hour": "h"},
    "g": {"Gender": '"Gender"'},
    "t": {"User Type": '"User Type"'},
    "b": {"Rideable Type": '"Rideable Type"'},
    "s": {"Start Station ID": '"Start Station ID"'},
    "e": {"End Station ID": '"End Station ID"'},
    "n": {"Start Station Name": '"Start Station Name"'},
    "N": {"End Station Name": '"End Station Name"'},
}


def _cols(keys: str) -> dict[str, str]:
    return {c: e for k in keys for c, e in _C[k].items()}


_SKETCH = """s as (select id, max(cnt) as mode_count, sum(cnt)::bigint as total, count(*) as num,
      (list(cnt order by cnt desc))[2] as second from {hist} group by id),
runs as (select id, string_agg(cnt || 'x' || times, ' ' order by cnt desc) as runs
    from (select id, cnt, count(*) as times from {hist} group by id, cnt) group by id)"""
_SKETCH_COLS = """mode_count, second, total - mode_count as restsum, total,
    round(mode_count / second, 6) as "first/second", round(mode_count / total, 6) as mode_pct, num"""


def _growth(source: str, value: str, stack: str | None = None) -> str:
    part = f"partition by {stack}" if stack else ""
    keep = f"{stack}, " if stack else ""
    return f"""g as (select {keep}m as first_m, {value} as first_v,
      row_number() over ({part} order by m desc) - 1 as months, count(*) over ({part}) - 1 as span,
      first_value(m) over ({part} order by m desc) as last_m,
      first_value({value}) over ({part} order by m desc) as last_v from {source} where {value} is not null)"""


_DOCKS = """docks as (select id as "Station ID", moment, is_start as "Start", day(moment) as "Day",
    isodow(moment) - 1 as w, hour(moment) as "Hour" from ends where id is not null)"""
_NJ = "regexp_matches(\"Station ID\", '^(JC|HB)')"


def _backfilled(src: str) -> str:
    return f"""select n.* replace (
      cast(case when n."Gender" = 0 then coalesce(o."Gender", 0) else n."Gender" end as integer) as "Gender",
      coalesce(n."Birth Year", o."Birth Year") as "Birth Year", coalesce(n."Bike ID", o."Bike ID") as "Bike ID")
    from {src} n left join sold o on n."Start Time" = o."Start Time" and n."Stop Time" = o."Stop Time" """


def _merged(source: str) -> str:
    """Later row of a pair, taking the earlier row's fields when its own are all empty."""
    def empty(p: str) -> str:
        return f"({p}\"Birth Year\" is null and coalesce({p}\"Gender\", 0) = 0 and {p}\"Bike ID\" is null)"
    take = f"b.n = 2 and {empty('b.')} and not {empty('a.')}"
    cols = ", ".join(f'case when {take} then a."{c}" else b."{c}" end as "{c}"' for c in ("Birth Year", "Gender", "Bike ID"))
    return f"""ranked as (select *, row_number() over (partition by "Start Time", "Stop Time" order by file) as n,
        count(*) over (partition by "Start Time", "Stop Time") as size from {source}),
    merged as (select b.* exclude (n, size) replace ({cols}) from ranked b
        left join (select * from ranked where n = 1) a
          on a."Start Time" = b."Start Time" and a."Stop Time" = b."Stop Time" where b.n = b.size)"""


def oracle() -> dict[str, str]:
    q: dict[str, str] = {}
    conformed = _with("select * from rides")
    for name in ("rides_conformed", "csv_ingest", "sorted_csv", "zip_ingest", "zip_to_csv", "dedupe_rows"):
        q[name] = conformed
    q["rides_open_ended"] = _with(
        """select "Ride ID", "Start Region", "End Station ID",
        case when "End Region" = 'None' then "Start Region" else "End Region" end as "End Region" from allrides
        where coalesce("Start Region", '') not in ('None', 'SYS') and coalesce("End Region", '') <> 'SYS'"""
    )
    q["region_classify"] = _with(
        f"""select id, src_region, count(*) as n, {_region('id')} as region from
        (select start_station_id as id, src_region from raw union all select end_station_id, src_region from raw)
        group by id, src_region"""
    )
    q["region_ambiguity"] = _with(
        """select distinct id, 'JC,HB' as regions from (select s_id as id from ids union all select e_id from ids)
        where regexp_matches(id, '^JC0[67][0-9]')"""
    )
    q["calendar_parts"] = _with(
        """select "Ride ID", y as year, mo as month, d as day, w as weekday, h as hour, secs as seconds,
        total_s as total_seconds, strftime("Start Time", '%Y%m') || '_' || strftime("Stop Time", '%Y%m') as part from t"""
    )
    q["month_range_filter"] = _with(
        """select ym as stop_ym, count(*) as n from t where ym in (201906, 201907, 202001, 202002, 202003, 202004, 202005, 202201, 202202) group by ym"""
    )

    q["rollup_ymrgtb_cd"] = _rollup(_cols("rymgtb"), "cd")
    q["rollup_s_c"] = _rollup(_cols("s"), "c", True)
    q["rollup_e_c"] = _rollup(_cols("e"), "c", True)
    q["rollup_se_c"] = _rollup(_cols("se"), "c", True)
    q["rollup_ymrgw_c"] = _rollup(_cols("rymwg"), "c")
    q["rollup_day_hour_cd"] = _rollup(_cols("ymdh"), "cd")
    q["rollup_name_c"] = _rollup(_cols("nN"), "c")
    q["rollup_ymrse_c"] = _rollup(_cols("rymse"), "c")
    places = ["Start Station Latitude", "Start Station Longitude", "End Station Latitude", "End Station Longitude"]
    q["rollup_latlng_c"] = _with(
        "select " + ", ".join(f'round("{p}", 6) as "{p}"' for p in places) + ', n as "Count" from (select '
        + ", ".join(f'"{p}"' for p in places) + ", count(*) as n from t where "
        + " and ".join(f'"{p}" is not null' for p in places) + " group by all)"
    )
    q["group_totals"] = _with(
        """select "Start Station ID", count(*) as "Count", sum(secs)::bigint as "Duration" from t
        where "Start Station ID" is not null and "End Station ID" is not null and "Rideable Type" is not null group by 1"""
    )
    routed = {"r": "cd", "gt": "cd", "yw": "c", "s": "c", "rh": "d"}
    q["rollup_routed"] = _with(
        " union all ".join(
            f"""select '{keys}' as keys, concat_ws('|', {", ".join(cols.values())}) as key,
            {"count(*)" if "c" in sums else "null::bigint"} as "Count", {"sum(secs)::bigint" if "d" in sums else "null::bigint"} as "Duration"
            from t where {" and ".join(f"{e} is not null" for e in cols.values())} group by {", ".join(cols.values())}"""
            for keys, sums, cols in ((k, v, _cols(k)) for k, v in routed.items())
        )
    )
    q["grand_totals"] = _with(
        """select sum(cnt)::bigint as total, count(distinct sid) as "distinct Start Station ID",
        count(distinct eid) as "distinct End Station ID" from sec""", ENDS
    )
    q["month_gender"] = _with(
        """select y as "Start Year", mo as "Start Month", "Gender",
        strftime(make_date(y, mo, 1), '%b') || '-' || substr('UMF', "Gender" + 1, 1) as mg,
        case "Gender" when 0 then 0 when 1 then 2 else 1 end as rank, count(*) as "Count" from t group by all"""
    )
    q["dashboard"] = _with("select * from rec", RECORDS)
    q["json_records"] = q["dashboard"]
    q["compact_codes"] = _with(
        """select case "Region" when 'NYC' then 0 when 'JC' then 1 when 'HOB' then 2 end as r, "Year" - 2000 as y,
        "Month" as m, "Gender" as g, case "User Type" when 'Annual' then 0 else 1 end as t,
        case "Rideable Type" when 'classic_bike' then 0 when 'electric_bike' then 2 else 3 end as b,
        "Count" as c, "Duration" as d from rec""", RECORDS
    )
    q["hudson_pairs"] = _with(
        """select "Start Station ID" as start, "End Station ID" as "end", y, mo as m, count(*) as count from t
        where "Start Region" <> 'NYC' group by "Start Region", 1, 2, 3, 4"""
    )
    q["value_counts"] = _with(
        'select "User Type", "Rideable Type", count(*) as "Count" from t where "Rideable Type" is not null group by 1, 2'
    )
    q["category_filter"] = _with(
        "select rideable_type, count(*) as n from raw where rideable_type <> 'motivate_dockless_bike' group by 1"
    )

    q["station_hist_in"] = _with("select id, name, cnt as count from hin", ENDS)
    q["station_hist_il"] = _with("select id, round(lat, 6) as lat, round(lng, 6) as lng, cnt as count from hil", ENDS)
    q["station_hist_ymi"] = _with(
        "select y as year, mo as month, id, count(*) as count from ends where id is not null group by all", ENDS
    )
    q["station_mode"] = _with("select id, name from names", ENDS)
    q["station_latlng"] = _with("select id, round(lat, 6) as lat, round(lng, 6) as lng from places", ENDS)
    dim = _with("select id, name, round(lat, 6) as lat, round(lng, 6) as lng, ends from dim", ENDS)
    for name in ("stations_dim", "stations_joined", "station_json", "station_json_whole"):
        q[name] = dim
    later = ENDS.replace('as moment from t\n', 'as moment from t where ym > (select min(ym) from t)\n').replace(
        '"Stop Time" from t),', '"Stop Time" from t where ym > (select min(ym) from t)),'
    )
    q["stations_all_time"] = _with("select id, name, round(lat, 6) as lat, round(lng, 6) as lng, ends from dim", later)
    q["mode_diagnostics"] = _with(
        """select id, name, cnt as count, sum(cnt) over (partition by id)::bigint as total, count(*) over (partition by id) as n,
        round(cnt / sum(cnt) over (partition by id), 6) as frac,
        round(cnt / lead(cnt) over (partition by id order by cnt desc, name), 6) as ratio from hin""", ENDS
    )
    q["station_sketch"] = _with(f"select id, {_SKETCH_COLS}, runs from s join runs using (id)", ENDS, _SKETCH.format(hist="hin"))
    q["place_sketch"] = _with(f"select id, {_SKETCH_COLS}, runs from s join runs using (id)", ENDS, _SKETCH.format(hist="hil"))
    q["sketched_names"] = _with(
        f"""select id, name, {_SKETCH_COLS} from s join
        (select id, name from (select *, row_number() over (partition by id order by cnt desc, name desc) as rn from hin) where rn = 1)
        using (id)""", ENDS, _SKETCH.format(hist="hin")
    )
    q["weak_modes"] = _with(
        "select id, round(max(cnt) / sum(cnt), 6) as mode_pct from hin group by id having max(cnt) / sum(cnt) < 0.8", ENDS
    )
    q["pair_idx"] = _with("select sidx, eidx, count from pairs", ENDS)
    q["pair_json"] = q["pair_json_whole"] = q["pair_idx"]
    q["pair_encode"] = _with(
        """select s.idx as sidx, e.idx as eidx, cnt as count from sec join own s on sid = s.id join own e on eid = e.id""",
        ENDS,
        "own as (select id, row_number() over (order by id) - 1 as idx from (select sid as id from sec union select eid from sec))",
    )
    q["pair_decode"] = _with("select sid as start_id, eid as end_id, cnt as count from sec", ENDS)
    q["pair_maps"] = _with(
        """select sidx, '{' || string_agg('"' || eidx || '":' || count, ',' order by eidx) || '}' as ends
        from pairs group by sidx""", ENDS
    )
    q["pair_flow_weight"] = _with(
        """select sid as start_id, eid as end_id, cnt as count,
        round(cnt / max(cnt) over (partition by sid) * sqrt(ends), 6) as weight from sec join dim on sid = id""", ENDS
    )
    q["station_radius"] = _with("select id, ends, round(sqrt(ends), 6) as radius from dim", ENDS)

    q["dup_keys"] = _with('select "Start Time", "Stop Time", "Ride ID", count(*) as n from dup group by 1, 2, 3 having count(*) > 1', SNAPSHOTS)
    short = '"Ride ID", "Start Time", "Stop Time", "Start Station ID"'
    sized = 'select *, count(*) over (partition by "Start Time", "Stop Time") as n from dup'
    q["dup_rows"] = _with(f"select {short} from ({sized}) where n > 1", SNAPSHOTS)
    q["once_only"] = _with(f"select {short} from ({sized}) where n = 1", SNAPSHOTS)
    q["group_sizes"] = _with(
        'select "Start Station ID", "End Station ID", "Bike ID", count(*) as dupes from rides group by 1, 2, 3 having count(*) > 1'
    )
    q["freq_of_freq"] = _with(
        'select times, count(*) as keys from (select count(*) as times from dup group by "Start Time", "Stop Time") group by 1', SNAPSHOTS
    )
    q["first_ride_per_station"] = _with(
        """select "Start Station ID", "Start Time", "Ride ID" from (select *, row_number() over
        (partition by "Start Station ID" order by "Start Time", "Ride ID") as rn from rides) where rn = 1"""
    )
    q["merge_pairs"] = _with("select * from merged", SNAPSHOTS, _merged("pair"))
    q["dup_provenance"] = _with(
        """select files, count(*) as keys from (select string_agg(file || ':' || n, ' ' order by file) as files
        from (select "Start Time", "Stop Time", file, count(*) as n from pair group by all)
        group by "Start Time", "Stop Time" having sum(n) > 1) group by files""", SNAPSHOTS
    )
    q["backfill"] = _with(_backfilled("snew"), SNAPSHOTS)
    q["backfill_report"] = _with(
        """select c as "column", before as empty, before - after as filled,
        case when before > 0 then round((before - after) * 100.0 / before, 1) else 0 end as pct from (
          select 'Birth Year' as c, (select count(*) from snew where "Birth Year" is null) as before, (select count(*) from f where "Birth Year" is null) as after
          union all select 'Gender', (select count(*) from snew where "Gender" = 0), (select count(*) from f where "Gender" = 0)
          union all select 'Bike ID', (select count(*) from snew where "Bike ID" is null), (select count(*) from f where "Bike ID" is null))""",
        SNAPSHOTS, f"f as ({_backfilled('snew')})"
    )
    keys_new = 'select distinct "Start Time", "Stop Time" from snew4'
    keys_old = 'select distinct "Start Time", "Stop Time" from sold'
    def unknown(c: str) -> str:
        return {"Gender": '"Gender" = 0', "Rideable Type": "\"Rideable Type\" = 'unknown'"}.get(c, f'"{c}" is null')

    q["backfill_written"] = _with(
        """select 'Length' as "column", (select count(*) from snew) as before, (select count(*) from f) as after union all """
        + " union all ".join(
            f"""select '{c}', (select count(*) from snew where {unknown(c)}), (select count(*) from f where {unknown(c)})"""
            for c in RIDE_COLUMNS
        ), SNAPSHOTS, f"f as ({_backfilled('snew')})"
    )
    q["snapshot_changes"] = _with(
        """select coalesce(n.ym, o.ym) as ym, coalesce(n."Start Time", o."Start Time") as "Start Time",
          coalesce(n."Stop Time", o."Stop Time") as "Stop Time", "Ride ID",
          case when o.ym is null then 'added' when n.ym is null then 'dropped' else 'altered' end as change,
          (n.ym is not null)::bigint as rows_new, (o.ym is not null)::bigint as rows_old
        from n full join o using ("Ride ID") where n.ym is null or o.ym is null or n."Gender" <> o."Gender" """,
        """n as (select * replace (case when ym % 4 = 0 and minute("Start Time") % 3 = 0 then 0 else "Gender" end as "Gender")
          from t where not (ym % 4 = 0 and h = 4)), o as (select * from t where not (ym % 4 = 0 and h = 3))"""
    )
    q["snapshot_diff"] = _with(
        f"""select (select count(*) from ({keys_new} except {keys_old})) as adds,
        (select count(*) from ({keys_old} except {keys_new})) as dels,
        (select count(*) from ({keys_new} intersect {keys_old})) as both""", SNAPSHOTS
    )
    cols = [
        "Ride ID", "Start Time", "Stop Time", "Start Station ID", "Start Station Name", "Start Station Latitude",
        "Start Station Longitude", "Start Region", "End Station ID", "End Station Name", "End Station Latitude",
        "End Station Longitude", "End Region", "Rideable Type", "User Type", "Gender", "Birth Year", "Bike ID",
    ]

    def empties(side: str, c: str) -> str:
        if side == "sold" and c == "Ride ID":
            return "count(*)"
        special = {"Gender": "\"Gender\" = 0", "Rideable Type": "\"Rideable Type\" = 'unknown'"}
        return f"count(*) filter (where {special.get(c, chr(34) + c + chr(34) + ' is null')})"

    lines = " union all ".join(
        f"select '{c}' as \"column\", (select {empties('sold', c)} from sold) as old, (select {empties('snew', c)} from snew) as new"
        for c in cols
    )
    q["null_profile"] = _with(
        f"""select * from (select 'Length' as "column", (select count(*) from sold) as old, (select count(*) from snew) as new
        union all {lines}) where old <> 0 or new <> 0""", SNAPSHOTS
    )
    sides = {"Ride ID": "extra", "Birth Year": "missing"}

    def side_count(table: str, absent: str, c: str) -> str:
        return "null" if sides.get(c) == absent else f'(select count("{c}") from {table})'

    q["schema_profile"] = _with(
        " union all ".join(
            f"""select '{c}' as "column", '{sides.get(c, 'common')}' as side, {side_count('snew', 'missing', c)} as "left",
            {side_count('sold', 'extra', c)} as "right\""""
            for c in cols
        ), SNAPSHOTS
    )
    joined = """from snew4 n full join sold o on n."Start Time" = o."Start Time" and n."Stop Time" = o."Stop Time" """
    q["snapshot_outer"] = _with(
        f"""select coalesce(n."Start Time", o."Start Time") as "Start Time", coalesce(n."Stop Time", o."Stop Time") as "Stop Time",
        n."Birth Year" as "Birth Year new", n."User Type" as "User Type new",
        case when n."Start Time" is not null then true end as in_new,
        o."Birth Year" as "Birth Year old", o."User Type" as "User Type old",
        case when o."Start Time" is not null then true end as in_old {joined}""", SNAPSHOTS
    )
    q["snapshot_mismatches"] = _with(
        " union all ".join(
            f"""select '{c}' as "column", count(*) filter (where n."{c}" is distinct from o."{c}") as differs
            from snew4 n join sold o on n."Start Time" = o."Start Time" and n."Stop Time" = o."Stop Time" """
            for c in ("Birth Year", "User Type", "End Region")
        ), SNAPSHOTS
    )
    starts = 'select "Start Station ID", count(*) as c from {0} where "Start Station ID" is not null group by 1'
    q["reconcile"] = _with(
        f"""select "Start Station ID", a.c as "Count_x", b.c as "Count_y" from ({starts.format('rides')}) a
        join ({starts.format('dup')}) b using ("Start Station ID") where a.c <> b.c""", SNAPSHOTS
    )
    q["natural_join"] = _with(
        f"""select "Start Station ID", c as "Count" from ({starts.format('rides')}) join ({starts.format('kept4')})
        using ("Start Station ID", c)""", SNAPSHOTS,
        """kept4 as (select * from rides where right("Start Station ID", 1) <> '3' or hour("Start Time") <> 4)""",
    )
    listed = ", ".join(f'"{c}"' for c in cols)
    q["monthly_rides"] = _with(
        f"""select {listed}, ym from (
          select {listed}, ym from inside2 union all select {listed}, ym from parts where ym not between 202001 and 202101)""",
        SNAPSHOTS,
        """parts as (select * replace (case when hour("Start Time") % 2 = 0 then "Birth Year" end as "Birth Year"),
            cast(y * 100 + mo as varchar) as file from t),
        late as (select * replace (0 as "Gender", null::integer as "Birth Year", null::integer as "Bike ID"), '202102' as file
            from t where ym between 202001 and 202101 and w = 0),
        inside as (select * from parts where ym between 202001 and 202101 union all select * from late)""",
        _merged("inside"),
        f"inside2 as ({_backfilled('merged')})",
    )

    halves = """early as (select * from t where y < 2021), later as (select * from t where y >= 2021)"""
    changed = """early as (select * from t where y < 2021 and right("Start Station ID", 1) <> '3'),
        later as (select * from t where y >= 2021 and right("Start Station ID", 1) <> '7')"""
    s = 'select "Start Station ID" from {}'
    q["stations_added"] = _with(f"{s.format('later')} except {s.format('early')}", changed)
    q["stations_lost"] = _with(f"{s.format('early')} except {s.format('later')}", changed)
    q["stations_kept"] = _with(f"{s.format('later')} intersect {s.format('early')}", changed)
    q["ids_union"] = _with('select "Start Station ID" as id from t union select "End Station ID" from t')
    q["key_pairs_union"] = _with(
        """select "Start Station ID", "End Station ID" from early union select "Start Station ID", "End Station ID" from later""", halves
    )
    q["distinct_bikes"] = _with('select distinct "Bike ID", "User Type" from rides')

    q["month_series"] = f'with {MONTHS} select m, r as "Rides", round(mins, 4) as "Ride minutes" from mt'
    q["month_stack"] = f'with {MONTHS} select m, priority, sum(rides)::bigint as "Rides" from om group by 1, 2'
    prios = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    q["month_pivot"] = f"with {MONTHS} select m, " + ", ".join(
        f"(sum(rides) filter (where priority = '{p}'))::bigint as \"{p}\"" for p in prios
    ) + " from om group by m"
    q["month_share"] = f"""with {MONTHS} select m, status, round(sum(rides) / sum(sum(rides)) over (partition by m), 6) as "Rides"
        from om group by m, status"""
    q["filtered_series"] = f"""with {MONTHS} select m, sum(rides)::bigint as "Rides" from om
        where status in ('F', 'P') and priority in ('1-URGENT', '2-HIGH') group by m"""
    q["rolling_avg"] = f'with {MONTHS} select m, r as "Rides", round(avg, 6) as avg from avg12'
    q["rolling_avg_full"] = f"""with {MONTHS} select m, r as "Rides", round(case when row_number() over (order by m) >= 12
        then sum(r) over (order by m rows between 11 preceding and current row) / 12.0 end, 6) as avg from mt"""
    q["rolling_avg_stack"] = f"""with {MONTHS}, grid as (select m, priority, r from (select distinct m from om)
          cross join (select distinct priority from om) left join
          (select m, priority, sum(rides) as r from om group by 1, 2) using (m, priority))
        select m, priority, r::bigint as "Rides", round(case when lag(r, 3) over (partition by priority order by m) is not null
          then sum(coalesce(r, 0)) over (partition by priority order by m rows between 2 preceding and current row) / 3.0 end, 6) as avg from grid"""
    growth_cols = """months, first_m, {fv}, last_m, {lv}, round(last_v / first_v, 6) as ratio, round(months / 12.0, 6) as years,
        round((pow(last_v / first_v, 12.0 / months) - 1) * 100, 6) as percent"""
    kept = "from g where months > 0 and (months % 12 = 0 or months = span)"
    q["annualized_growth"] = f"""with {MONTHS}, {_growth('avg12', 'avg')} select
        {growth_cols.format(fv='round(first_v, 6) as first_v', lv='round(last_v, 6) as last_v')} {kept}"""
    q["growth_by_stack"] = f"""with {MONTHS}, st as (select m, status, sum(rides)::bigint as r from om group by 1, 2),
        {_growth('st', 'r', 'status')} select status, {growth_cols.format(fv='first_v', lv='last_v')} {kept}"""
    q["series_clamped"] = f"""with {MONTHS} select m, r as "Rides" from mt where m >= '1996-03' and m < '1999-11'"""
    q["series_last_years"] = f"""with {MONTHS} select m, r as "Rides" from mt where m >= (select
        strftime(cast(max(m) || '-01' as date) + interval 1 month - interval 24 month, '%Y-%m') from mt)"""
    q["ride_month_totals"] = _with(
        'select m, "Region", round(sum("Ride minutes"), 4) as "Ride minutes" from lab group by 1, 2', RECORDS
    )
    q["ride_type_shares"] = _with(
        """select m, k as "Rideable Type", round(r / sum(r) over (partition by m), 6) as "Rides" from
        (select distinct m from lab) cross join (values ('Electric'), ('Classic'), ('Unknown')) kinds(k)
        left join (select m, "Rideable Type" as k, sum("Rides") as r from lab group by 1, 2) using (m, k)""", RECORDS
    )
    q["ride_gender_averages"] = _with(
        """select m, k as "Gender", r::bigint as "Rides", round(case when m < '2021-02' then avg end, 6) as avg from (
        select *, case when lag(r, 6) over (partition by k order by m) is not null then
            sum(coalesce(r, 0)) over (partition by k order by m rows between 5 preceding and current row) / 6.0 end as avg from
          (select distinct m from sel) cross join (values ('Unknown'), ('Women'), ('Men')) kinds(k)
          left join (select m, "Gender" as k, sum("Rides") as r from sel group by 1, 2) using (m, k)) where m >= '2019-06'""",
        RECORDS, """sel as (select * from lab where "Region" in ('NYC', 'JC'))"""
    )

    q["region_matrix"] = _with(
        'select "Start Region", ' + ", ".join(
            f"nullif(count(*) filter (where \"End Region\" = '{r}'), 0) as \"{r}\"" for r in ("NYC", "JC", "HB")
        ) + ' from t where "Start Region" is not null and "End Region" is not null group by 1'
    )
    q["cross_region"] = _with(
        'select "Start Region", "End Region", count(*) as "Count" from t where "Start Region" <> "End Region" group by 1, 2'
    )
    q["category_share"] = _with(
        'select y as year, mo as month, "Start Region" as region, ' + ", ".join(
            f"nullif(count(*) filter (where \"Gender\" = {i}), 0) as \"{c}\", "
            f"round_even(nullif(count(*) filter (where \"Gender\" = {i}), 0) / count(*) * 100, 1) as \"{c}%\""
            for i, c in enumerate("UMF")
        ) + ' from t where "Start Region" is not null group by 1, 2, 3'
    )
    label = """case when {s} = 0 then '0s' else case when {s} >= 3600 then ({s} // 3600) || 'h' else '' end
        || case when {s} % 3600 >= 60 then ({s} % 3600 // 60) || 'm' else '' end
        || case when {s} % 60 > 0 then ({s} % 60) || 's' else '' end end"""
    q["duration_hist"] = _with(
        f"""select secs // 60 as bucket, count(*) as "# Rides", {label.format(s='(secs // 60 * 60)')} as "Duration"
        from t group by all order by 1 limit 300"""
    )
    q["duration_mode"] = _with(
        f"""select bucket, n as "# Rides", {label.format(s='(bucket * 600)')} as "Duration" from
        (select secs // 600 as bucket, count(*) as n from t group by 1) qualify n = max(n) over ()"""
    )
    q["duration_labels"] = _with(f"select {label.format(s='secs')} as label, count(*) as n from t group by 1")
    base = """select "Station ID", name as "Station Name", {keys}count(*) as "Count"{avg} from docks join names on id = "Station ID"
        where {where} group by all"""
    days = "(select count(*) from range(date '2019-02-01', date '2023-03-01', interval 1 day) r(x) where {})"
    q["station_daily"] = _with(base.format(keys='"Day", ', avg="", where=_NJ), ENDS, _DOCKS)
    q["station_avg_weekday"] = _with(
        base.format(keys="", avg=f', round(count(*) / {days.format("isodow(x) <= 5")}, 6) as "Avg"', where="w < 5"), ENDS, _DOCKS
    )
    q["station_hour_weekend"] = _with(
        base.format(keys='"Hour", "Start", ', avg=f', round(count(*) / {days.format("isodow(x) >= 6")}, 6) as "Avg"',
                    where=f"w >= 5 and not {_NJ}"), ENDS, _DOCKS
    )
    q["docking_sides"] = _with(f'select "Start", count(*) as n from docks where {_NJ} group by 1', ENDS, _DOCKS)
    q["top_stations"] = _with(
        f"select * from ({base.format(keys='', avg='', where=_NJ)}) order by \"Count\" desc, \"Station ID\" limit 5", ENDS, _DOCKS
    )
    jc = "starts_with(\"Station ID\", 'JC')"
    q["top_station_days"] = _with(
        f"""select * from ({base.format(keys='"Day", ', avg='', where=jc)}) order by "Count" desc, "Station ID", "Day" limit 50""", ENDS, _DOCKS
    )
    jan = "moment >= timestamp '2020-01-01' and moment < timestamp '2020-02-01'"
    q["top_station_series"] = _with(
        f"""select *, strftime(make_date(2020, 1, "Day"), '%Y-%m-%d') as "Date",
          case when isodow(make_date(2020, 1, "Day")) <= 5 then 'Weekday' else 'Weekend' end as "Kind"
        from ({base.format(keys='"Day", ', avg='', where=_NJ + ' and ' + jan)}) where "Station ID" in (
          select "Station ID" from ({base.format(keys='', avg='', where=_NJ + ' and ' + jan)}) order by "Count" desc, "Station ID" limit 5)""",
        ENDS, _DOCKS
    )
    q["round_trip_share"] = _with(
        """select y as "Year", mo as "Month", count(*) filter (where "Start Station Name" = "End Station Name") as same,
        count(*) as rides, round(count(*) filter (where "Start Station Name" = "End Station Name") / count(*), 6) as share from t group by 1, 2"""
    )
    q["id_extract"] = _with(
        """select id, regexp_extract(id, '((JC|HB)[0-9]+)', 1) as station, regexp_extract(id, '((JC|HB)[0-9]+)', 2) as region
        from (select "Start Station ID" as id from t union select "End Station ID" from t) where regexp_matches(id, '(JC|HB)[0-9]+')"""
    )

    q["partition_write"] = _with(
        """select y * 100 + mo as src_ym, y * 100 + mo as start_ym, ym as stop_ym, count(*) as n from t
        where ym <= y * 100 + mo or y * 100 + mo > (select min(y * 100 + mo) from t) group by all"""
    )
    q["incremental_append"] = _rollup(_cols("rg"), "cd", True)
    q["saved_formats"] = _with(
        """select "Region", "User Type", "Count", "Duration", format from (select "Start Region" as "Region", "User Type",
        count(*) as "Count", sum(secs)::bigint as "Duration" from t where "Start Region" is not null group by 1, 2)
        cross join (values ('parquet'), ('csv'), ('json')) f(format)"""
    )
    files = """select ym, case when "Start Region" = 'NYC' then 'NYC' else 'JC' end as src_region, count(*) as size,
        sum(cast("Ride ID" as bigint))::bigint as etag,
        case when "Start Region" = 'NYC' then '' else 'JC-' end || ym || '-trips.zip' as path from t where {} group by all"""
    q["manifest_status"] = _with(
        f"""select path, o.etag as old_etag, c.etag as new_etag, case when o.etag is null then 'new' when c.etag is null then 'gone'
          when o.etag <> c.etag then 'changed' else 'same' end as status
        from ({files.format(chr(34) + 'User Type' + chr(34) + " = 'Subscriber' or y < 2020")}) o
        full join (select * from ({files.format('ym > 201904')}) where not starts_with(path, 'JC-2022')) c using (path)"""
    )
    q["months_available"] = _with(
        f"""select ym, count(distinct src_region) as regions, 2 as expected, count(distinct src_region) >= 2 as complete
        from ({files.format('true')}) where not (src_region = 'JC' and ym >= 202212) group by ym"""
    )
    q["latest_month"] = _with(
        f"""select max(ym) as ym, 2 as regions from ({files.format('true')})
        where ym < (select max(ym) from t) and ym in (select ym from ({files.format('true')}) group by ym having count(*) = 2)"""
    )
    q["csv_months"] = _with('select rides.* from rides where year("Start Time") * 100 + month("Start Time") between 202003 and 202008')
    q["zip_name_types"] = _with(
        """select 1 + id % 2 as name_type, count(*) as n, sum(id)::bigint as ids
        from (select cast(ride_id as bigint) as id from raw where src_region = 'NYC') group by 1"""
    )
    q["pair_remap"] = q["pair_decode"]
    q["month_rebuild"] = _with(
        """select ym, count(*) as n from t where y * 100 + mo > (select min(year(started_at) * 100 + month(started_at)) from raw)
        or ym <= (select min(year(started_at) * 100 + month(started_at)) from raw) group by ym"""
    )
    q["rollup_delta"] = _rollup(_cols("rymgtb"), "cd", True)
    q["ride_order"] = _with("select ym as stop_ym, count(*) as n, 0 as out_of_order from t group by ym")
    sides = " full join ".join(
        f"""(select 202001 as src_ym, year("Start Time") * 100 + month("Start Time") as start_ym,
        year("Stop Time") * 100 + month("Stop Time") as stop_ym, count(*) as rows_{name} from {table} group by all) {name}"""
        for name, table in (("v1", "snew4"), ("v0", "sold"))
    )
    q["snapshot_scan"] = _with(f"select * from {sides} using (src_ym, start_ym, stop_ym)", SNAPSHOTS)
    q["month_files"] = _with(
        """select ym, "Start Region" as "Region", "User Type", count(*) as "Count" from t
        where ym in (202001, 202006, 202012) and "Start Region" is not null group by all"""
    )
    q["old_header"] = _with(
        """select "Start Time", "Stop Time", "Start Station ID", "Start Station Name", "Start Station Latitude",
        "Start Station Longitude", "End Station ID", "End Station Name", "End Station Latitude", "End Station Longitude",
        'unknown' as "Rideable Type", 'Customer' as "User Type", 0 as "Gender", "Birth Year", "Bike ID" from rides"""
    )
    first = "(select min(y * 100 + mo) from t)"
    q["known_bad_part"] = _with(
        f"""select s as start_ym, e as stop_ym, count(*) as n from (
          select case when y * 100 + mo = {first} then 201307 else y * 100 + mo end as s,
          case when ym = {first} then 201307 else ym end as e from t) where s <> 201307 or e <> 201307 group by all"""
    )
    q["region_union"] = _with(
        """select "Start Region", count(*) as n, count("Bike ID") filter (where "Start Region" <> 'NYC') as bikes,
        count("Birth Year") filter (where "Start Region" = 'NYC') as births from t where "Start Region" is not null group by 1"""
    )
    unfilled = {"Ride ID": "ym < 202001", "Bike ID": "ym >= 202102", "Birth Year": "ym >= 202102"}
    q["month_columns"] = _with(
        "select * from (" + " union all ".join(
            f"""select ym, '{c}' as "column", count("{c}") as filled, {unfilled.get(c, 'false')} as empty from t group by ym""" for c in cols
        ) + ") where empty = (filled > 0)"
    ).replace("select * from (select ym", "select ym, \"column\", filled from (select ym", 1)
    q["station_hist_order"] = _with("select id, name, cnt as count from hin", ENDS)
    q["station_hist_whole"] = _with("select id, name, cnt as count from hin", ENDS)
    q["modal_places"] = _with(
        """select id, lat, lng, mode_count, second, total - mode_count as restsum, total, mode_count / second as "first/second",
        mode_count / total as mode_pct, num from s join m using (id)""",
        ENDS,
        """s as (select id, max(cnt) as mode_count, sum(cnt)::bigint as total, count(*) as num,
          (list(cnt order by cnt desc))[2] as second from hil group by id)""",
        """m as (select id, lat, lng from (select *, row_number() over (partition by id order by cnt desc, lat desc, lng desc) as rn from hil) where rn = 1)""",
    )
    q["ride_type_averages"] = _with(
        """select m, k as "Rideable Type", r::bigint as "Rides", round(case when k <> 'Unknown' or m < '2021-02' then avg end, 6) as avg from (
        select *, case when lag(r, 6) over (partition by k order by m) is not null then
            sum(coalesce(r, 0)) over (partition by k order by m rows between 5 preceding and current row) / 6.0 end as avg from
          (select distinct m from lab) cross join (values ('Electric'), ('Classic'), ('Unknown')) kinds(k)
          left join (select m, "Rideable Type" as k, sum("Rides") as r from lab group by 1, 2) using (m, k))""",
        RECORDS,
    )
    return q
