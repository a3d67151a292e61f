"""Scan, preparation, ingest and sink queries (S rows, E10-E13)."""

from pyspark.sql import functions as F

from brinefield.functions.digest import exact_number
from brinefield.operators import audit as au
from brinefield.operators import axes as ax
from brinefield.registry import q_collocation as qco
from brinefield.registry.core import query
from brinefield.registry.projections import NT, NX, NY, NZ, register_cte
from brinefield.registry.q_regions import digest_sql
from brinefield.runtime import checkpoint_root
from brinefield.sources import grids, tables
from brinefield.sources import observations as ob

KEYS = "case_id, it, iz, iy, ix"


@query("S1_explode_field", f"SELECT {KEYS}, value FROM dense", ("dense",))
def s1(i):
    """Wire arrays per frame are rebuilt from the lattice, then exploded."""
    flat = (F.col("iz") * NY + F.col("iy")) * NX + F.col("ix")
    packed = i.dense.groupBy("case_id", "it").agg(F.array_sort(F.collect_list(F.struct(flat.alias("k"), F.coalesce("value", F.lit(float("nan"))).alias("v")))).alias("_a"))
    wire = packed.select("case_id", "it", F.lit(NZ).alias("nz"), F.lit(NY).alias("ny"), F.lit(NX).alias("nx"), F.transform("_a", lambda s: s["v"]).alias("values"))
    return grids.explode_field(wire, "case_id", "it")


BLOCK = 97


def blocks(i):
    """The lattice in blocks of 97 values. One block of frame 3 is absent, one of frame 5 comes twice, frame 6 has one too many."""
    flat = (F.col("iz") * NY + F.col("iy")) * NX + F.col("ix")
    entry = F.struct(flat.alias("k"), F.coalesce("value", F.lit(float("nan"))).alias("v"))
    rows = i.dense.groupBy("case_id", "it", F.floor(flat / BLOCK).alias("_b")).agg(F.array_sort(F.collect_list(entry)).alias("_a"))
    rows = rows.select("case_id", "it", F.lit(NZ).alias("nz"), F.lit(NY).alias("ny"), F.lit(NX).alias("nx"), (F.col("_b") * BLOCK).alias("offset"), F.transform("_a", lambda s: s["v"]).alias("values"))
    twice = rows.filter(f"it = 5 AND offset = {2 * BLOCK}")
    more = rows.filter("it = 6 AND offset = 0").withColumn("offset", F.lit(NZ * NY * NX))
    return rows.filter(f"it != 3 OR offset != {BLOCK}").unionByName(twice).unionByName(more)


@query("S1_field_blocks", f"SELECT {KEYS}, value FROM dense WHERE it NOT IN (3, 5, 6)", ("dense",))
def s1b(i):
    return grids.explode_blocks(blocks(i), "case_id", "it")


@query("S1_block_problems", f"""SELECT case_id, it, o AS "offset", problem FROM (SELECT DISTINCT case_id FROM lattice) c,
  (VALUES (3, {2 * BLOCK}, 'missing_before'), (5, {2 * BLOCK}, 'overlapping'), (6, {NZ * NY * NX}, 'beyond_frame')) p(it, o, problem)""", ("lattice",))
def s1c(i):
    return grids.block_problems(blocks(i), "case_id", "it")


PACKED = """SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'temperature' WHEN 1 THEN 'salinity' ELSE 'broken' END AS variable,
  CASE WHEN l_partkey % 19 = 0 THEN -32767 ELSE CAST(l_quantity AS INT) * 100 - 1000 END AS packed FROM {lineitem}"""


@query("S2_cf_decode", f"""
SELECT l_orderkey, l_linenumber, variable, packed, CASE variable WHEN 'temperature' THEN CASE WHEN packed <> -32767 AND packed <> 700 AND packed BETWEEN -800 AND 3500 THEN packed * 0.001e0 + 20 END
   WHEN 'salinity' THEN CASE WHEN packed <> -32767 THEN packed * 0.5e0 END END AS value,
 CASE WHEN variable = 'broken' THEN 'invalid_packing' WHEN packed = -32767 OR (variable = 'temperature' AND (packed = 700 OR packed NOT BETWEEN -800 AND 3500)) THEN 'masked' ELSE 'ok' END AS status
FROM ({PACKED.format(lineitem='lineitem')}) t""")
def s2(i):
    attrs = i.spark.createDataFrame([("temperature", -32767.0, 700.0, -800.0, 3500.0, 0.001, 20.0), ("salinity", -32767.0, None, None, None, 0.5, None),
                                     ("broken", -32767.0, None, None, None, 0.0, None)],
                                    "variable string, fill_value double, missing_value double, valid_min double, valid_max double, scale_factor double, add_offset double")
    return grids.cf_decode(i.sql(PACKED, "lineitem"), attrs)


_SRC = """SELECT case_id, axis, CASE axis WHEN 'depth' THEN {n} - 1 - idx ELSE (idx + 5) % {m} END AS idx, CASE axis WHEN 'depth' THEN -coord WHEN 'lon' THEN coord + 100 ELSE coord END AS coord FROM axes"""


def source_axes(i):
    size = F.when(F.col("axis") == "lat", NY).otherwise(NX)
    idx = F.when(F.col("axis") == "depth", NZ - 1 - F.col("idx")).otherwise((F.col("idx") + 5) % size)
    coord = F.when(F.col("axis") == "depth", -F.col("coord")).when(F.col("axis") == "lon", F.col("coord") + 93.0).otherwise(F.col("coord"))
    return i.axes.select("case_id", "axis", idx.cast("int").alias("idx"), coord.alias("coord"), F.when(F.col("axis") == "depth", "up").alias("positive"))


register_cte("source_axes", f"""SELECT case_id, axis, CASE axis WHEN 'depth' THEN {NZ - 1} - idx WHEN 'lat' THEN (idx + 5) % {NY} ELSE (idx + 5) % {NX} END AS old_idx,
  CASE axis WHEN 'depth' THEN coord WHEN 'lon' THEN CASE WHEN coord + 93 >= 180 THEN coord + 93 - 360 ELSE coord + 93 END ELSE coord END AS coord FROM axes""", ("axes",))
register_cte("new_axes", "SELECT *, row_number() OVER (PARTITION BY case_id, axis ORDER BY coord) - 1 AS idx FROM source_axes", ("source_axes",))


@query("S3_normalize_axes", "SELECT case_id, axis, idx, old_idx, coord FROM new_axes JOIN (SELECT DISTINCT case_id FROM grid) USING (case_id)", ("new_axes", "grid"))
def s3(i):
    return ax.normalize_axes(source_axes(i).join(i.cells.select("case_id").distinct(), "case_id", "left_semi"))


@query("S3_reindex_cells", """SELECT g.case_id, it, z.idx AS iz, y.idx AS iy, x.idx AS ix, value FROM grid g
JOIN new_axes z ON z.case_id = g.case_id AND z.axis = 'depth' AND z.old_idx = g.iz JOIN new_axes y ON y.case_id = g.case_id AND y.axis = 'lat' AND y.old_idx = g.iy
JOIN new_axes x ON x.case_id = g.case_id AND x.axis = 'lon' AND x.old_idx = g.ix""", ("new_axes", "grid"))
def s3b(i):
    return ax.reindex_cells(i.cells, ax.normalize_axes(source_axes(i)))


_CHECKS = [(f"{a} {c}", "true") for a in ("depth", "lat", "lon") for c in ("present", "finite", "unique", "strictly increasing", "units", "bounds")]


@query("S4_check_grid", """
WITH c AS (SELECT DISTINCT case_id FROM grid), k AS (SELECT * FROM (VALUES """ + ", ".join(f"('{n}')" for n, _ in _CHECKS) + """) v("check"))
SELECT c.case_id, k."check", NOT (c.case_id = 1 AND k."check" IN ('lon strictly increasing', 'lon unique')) AND NOT (c.case_id = 2 AND k."check" = 'depth units') AS passed FROM c, k
UNION ALL SELECT case_id, 'temperature definition and units', true FROM c UNION ALL SELECT case_id, 'salinity definition and units', case_id <> 0 FROM c
UNION ALL SELECT case_id, 'variables share axes', case_id <> 1 FROM c""", ("grid",))
def s4(i):
    cases = i.cells.select("case_id").distinct()
    units = F.when(F.col("axis") == "depth", F.when(F.col("case_id") == 2, "dbar").otherwise("m")).when(F.col("axis") == "lat", "degrees_north").otherwise("degrees_east")
    coord = F.when((F.col("axis") == "lon") & (F.col("case_id") == 1) & (F.col("idx") == 4), F.lit(85.75)).otherwise(F.col("coord"))
    axes = i.axes.join(cases, "case_id", "left_semi").withColumns({"units": units, "coord": coord})
    entries = F.array(F.struct(F.lit("temperature").alias("variable"), F.lit("sea_water_temperature").alias("standard_name"), F.lit("degC").alias("units"), F.lit("grid").alias("axes_key")),
                      F.struct(F.lit("salinity").alias("variable"), F.lit("sea_water_salinity").alias("standard_name"),
                               F.when(F.col("case_id") == 0, "g/kg").otherwise("psu").alias("units"), F.when(F.col("case_id") == 1, "staggered").otherwise("grid").alias("axes_key")))
    allowed = i.spark.createDataFrame([("temperature", "sea_water_temperature", "degC"), ("salinity", "sea_water_salinity", "psu")], "variable string, standard_name string, units string")
    return grids.check_grid(axes, cases.select("case_id", F.inline(entries)), allowed)


@query("S5_check_frames", """
SELECT f.case_id, f.it, CASE WHEN f.it = 4 THEN 1 WHEN f.it = 6 THEN 15 ELSE 0 END AS coordinate_differences, f.it <> 5 AS time_matches, f.it NOT IN (4, 5, 6) AS passed
FROM frames f JOIN (SELECT DISTINCT case_id FROM grid) USING (case_id)""", ("frames", "grid"))
def s5(i):
    frames = i.frames.join(i.cells.select("case_id").distinct(), "case_id", "left_semi")
    shift = F.when((F.col("it") == 4) & (F.col("axis") == "depth") & (F.col("idx") == 3), 0.5).when((F.col("it") == 6) & (F.col("axis") == "lon"), 0.125).otherwise(0.0)
    coords = frames.select("case_id", "it").join(i.axes, "case_id").withColumn("coord", F.col("coord") + shift)
    declared = frames.withColumn("ts", F.when(F.col("it") == 5, F.col("ts") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("ts")))
    return grids.check_frames(coords, declared, frames)


CSV_ROWS = """
SELECT concat('p', CAST(user_id AS VARCHAR(20))) AS profile_id, CASE WHEN user_id % 17 = 0 AND event_id % 2 = 0 THEN 'buoy' ELSE 'argo' END AS instrument,
  concat('pf', CAST(user_id % 20 AS VARCHAR(20))) AS platform, CASE WHEN event_id % 13 = 0 THEN '2024-01-05T10:00:00' ELSE '2024-01-05T10:00:00+02:00' END AS time,
  CAST(CASE WHEN event_id % 23 = 0 THEN 95 ELSE user_id % 60 END AS VARCHAR(20)) AS latitude, CAST(user_id % 170 AS VARCHAR(20)) AS longitude,
  CASE WHEN event_id % 7 > 0 THEN CAST(event_id % 2000 AS VARCHAR(20)) ELSE '' END AS pressure_dbar, '1' AS pressure_qc, CAST(event_id % 3 AS VARCHAR(20)) AS position_qc, '1' AS time_qc,
  CASE WHEN event_id % 31 = 4 THEN 'warm' WHEN event_id % 5 > 0 THEN CAST(event_id % 30 AS VARCHAR(20)) ELSE '' END AS temperature_c, CAST(event_id % 4 AS VARCHAR(20)) AS temperature_qc,
  CAST(event_id % 40 AS VARCHAR(20)) AS salinity_psu, '1' AS salinity_qc FROM {events}"""
MEASURED = ("temperature_c", "salinity_psu")


def csv_rows(i):
    """Observation files are written from the events, then read back through the source."""
    import uuid
    path = f"{checkpoint_root(i.spark)}/csv-{uuid.uuid4().hex}"
    i.sql(CSV_ROWS, "events").write.csv(path, header=True)
    return ob.read_observation_csv(i.spark, path, MEASURED)


register_cte("csv_rows", CSV_ROWS.format(events="events"))


@query("S6_read_observation_csv", """
SELECT profile_id, variable, count(*) AS n, count(value) AS present, sum(value) AS total, count(pressure_dbar) AS pressures, count(t) AS times FROM (
 SELECT profile_id, 'temperature' AS variable, TRY_CAST(nullif(temperature_c, '') AS DOUBLE) AS value, TRY_CAST(nullif(pressure_dbar, '') AS DOUBLE) AS pressure_dbar,
   CASE WHEN time LIKE '%+02:00' THEN 1 END AS t FROM csv_rows
 UNION ALL SELECT profile_id, 'salinity', TRY_CAST(salinity_psu AS DOUBLE), TRY_CAST(nullif(pressure_dbar, '') AS DOUBLE), CASE WHEN time LIKE '%+02:00' THEN 1 END FROM csv_rows) q GROUP BY 1, 2""",
       ("csv_rows",))
def s6(i):
    return ob.csv_readings(csv_rows(i), MEASURED).groupBy("profile_id", "variable").agg(
        F.count("*").alias("n"), F.count("value").alias("present"), F.sum("value").alias("total"), F.count("pressure_dbar").alias("pressures"), F.count("ts").alias("times"))


@query("S6_csv_problems", """
WITH b AS (SELECT profile_id, CASE WHEN instrument NOT IN ('argo', 'bgc', 'glider', 'ctd') THEN 'unsupported_instrument' WHEN latitude = '95' THEN 'invalid_position'
  WHEN time NOT LIKE '%+02:00' THEN 'invalid_time' WHEN temperature_c = 'warm' THEN 'invalid_number' END AS problem FROM csv_rows)
SELECT profile_id, problem, count(*) AS n FROM b WHERE problem IS NOT NULL GROUP BY 1, 2
UNION ALL SELECT profile_id, 'inconsistent_metadata', 1 FROM csv_rows GROUP BY 1 HAVING count(DISTINCT instrument) > 1 OR count(DISTINCT platform) > 1""", ("csv_rows",))
def s6b(i):
    return ob.csv_problems(csv_rows(i))


CTD_LINES = """SELECT user_id, user_id * 1000000 + CAST(floor(event_id / 500e0) AS BIGINT) AS station, event_id, CASE WHEN event_id % 9 = 0 THEN -999 ELSE event_id % 30 END AS t, event_id % 37 AS s, event_id % 4000 AS p, event_id % 3 + 1 AS f FROM {events}"""


@query("S7_read_ctd_exchange", f"""
SELECT station, variable, count(*) AS n, count(v) AS present, CAST(sum(v) AS DOUBLE) AS total, CAST(sum(p) AS DOUBLE) AS pressure_total, count(*) FILTER (WHERE f = 2) AS good FROM (
 SELECT station, user_id, 'temperature' AS variable, CASE WHEN t <> -999 THEN t END AS v, p, f FROM ({CTD_LINES.format(events='events')}) a
 UNION ALL SELECT station, user_id, 'salinity', s, p, f FROM ({CTD_LINES.format(events='events')}) b) q WHERE user_id % 11 > 0 GROUP BY 1, 2
UNION ALL SELECT DISTINCT station, 'incomplete_file', 1, 0, NULL, NULL, 0 FROM ({CTD_LINES.format(events='events')}) c WHERE user_id % 11 = 0""")
def s7(i):
    """One text per station of at most 500 rows, so no text grows with the table."""
    row = F.concat_ws(",", "p", F.lit("2"), "t", "f", "s", "f")
    files = i.sql(CTD_LINES, "events").groupBy("user_id", "station").agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("_rows"))
    head = F.concat(F.lit("CTD,20240101\n# comment\nEXPOCODE = X\nSTNNBR = "), F.col("station").cast("string"),
                    F.lit("\nCASTNO = 1\nDATE = 20240105\nTIME = 930\nLATITUDE = 10.5\nLONGITUDE = 86\nCTDPRS,CTDPRS_FLAG_W,CTDTMP,CTDTMP_FLAG_W,CTDSAL,CTDSAL_FLAG_W\nDBAR,,DEG_C,,PSS-78,\n"))
    end = F.when(F.col("user_id") % 11 > 0, F.lit("\nEND_DATA\n")).otherwise(F.lit("\n"))
    texts = files.select(F.concat(F.lit("station-"), F.col("station").cast("string")).alias("path"), F.concat(head, F.col("_rows"), end).alias("value"))
    rows = ob.parse_ctd(texts)
    name = F.coalesce("problem", "variable")
    return rows.groupBy(F.col("station").cast("bigint").alias("station"), name.alias("variable")).agg(
        F.count("*").alias("n"), F.count("value").alias("present"), F.sum("value").alias("total"), F.sum("pressure_dbar").alias("pressure_total"), F.count_if(F.col("qc") == "2").alias("good"))


MODES = """SELECT event_id, concat('p', CAST(user_id AS VARCHAR(20))) AS profile_id, CASE event_id % 2 WHEN 0 THEN 'temperature' ELSE 'oxygen' END AS variable,
  CASE user_id % 4 WHEN 0 THEN 'R' WHEN 1 THEN 'A' WHEN 2 THEN 'D' ELSE 'X' END AS mode, value AS raw, '1' AS raw_qc,
  CASE WHEN event_id % 6 > 0 THEN value + 0.5 END AS adjusted, CASE WHEN event_id % 6 > 0 THEN '2' ELSE '9' END AS adjusted_qc FROM {events}"""


@query("S8_select_by_mode", f"""
SELECT event_id, round(CASE WHEN mode = 'R' THEN raw WHEN mode IN ('A', 'D') THEN adjusted END, 6) AS value, CASE WHEN mode = 'R' THEN raw_qc WHEN mode IN ('A', 'D') THEN adjusted_qc END AS qc,
  CASE WHEN mode = 'X' THEN 'unsupported_data_mode' ELSE 'ok' END AS mode_status FROM ({MODES.format(events='events')}) t""")
def s8(i):
    return ob.select_by_mode(i.sql(MODES, "events")).select("event_id", F.round("value", 6).alias("value"), "qc", "mode_status")


@query("S8_parameter_modes", f"""
SELECT event_id, round(CASE WHEN user_id % 3 = 0 AND variable = 'oxygen' THEN raw ELSE adjusted END, 6) AS value FROM ({MODES.format(events='events')}) t JOIN (SELECT event_id, user_id FROM events) USING (event_id)""")
def s8b(i):
    rows = i.sql(MODES, "events")
    user = F.substring("profile_id", 2, 20).cast("bigint")
    modes = rows.select("profile_id", "variable").distinct().withColumn("mode", F.when((user % 3 == 0) & (F.col("variable") == "oxygen"), "R").otherwise("D"))
    return ob.select_by_mode(ob.with_parameter_modes(rows, modes)).select("event_id", F.round("value", 6).alias("value"))


CTD_FAULTS = """SELECT user_id * 1000000 + CAST(floor(event_id / 500e0) AS BIGINT) AS station, CASE user_id % 7 WHEN 0 THEN 'missing_metadata' WHEN 1 THEN 'incompatible_units' WHEN 2 THEN 'missing_variable'
  WHEN 3 THEN 'invalid_position' WHEN 4 THEN 'invalid_time' WHEN 5 THEN 'incomplete_file' END AS fault, count(*) AS n FROM {events} GROUP BY 1, 2"""


@query("S7_refused_files", f"SELECT station, coalesce(fault, 'salinity') AS said, CASE WHEN fault IS NULL THEN n ELSE 1 END AS n FROM ({CTD_FAULTS.format(events='events')}) f", ())
def s7b(i):
    """Every kind of faulty file, one for each station, and whole files of pressure and salinity."""
    fault = F.col("fault")
    when = lambda name, bad, good: F.when(fault.eqNullSafe(name), bad).otherwise(good)
    head = F.concat(F.lit("CTD,20240101\nEXPOCODE = X\nSTNNBR = 1\n"), when("missing_metadata", "", "CASTNO = 1\n"), F.lit("DATE = 20240105\nTIME = "), when("invalid_time", "9x", "930"),
                    F.lit("\nLATITUDE = "), when("invalid_position", "95", "10.5"), F.lit("\nLONGITUDE = 86\nCTDPRS,CTDPRS_FLAG_W"), when("missing_variable", "", ",CTDSAL,CTDSAL_FLAG_W"),
                    F.lit("\nDBAR,"), when("missing_variable", "", when("incompatible_units", ",g/kg,", ",PSS-78,")), F.lit("\n"))
    body = F.repeat(F.lit("5,2,34.5,2\n"), F.col("n").cast("int"))
    files = i.sql(CTD_FAULTS, "events").select(F.concat(F.lit("s-"), F.col("station").cast("string")).alias("path"), F.concat(head, body, when("incomplete_file", "", "END_DATA\n")).alias("value"))
    rows = ob.parse_ctd(files).withColumn("said", F.coalesce("problem", "variable"))
    return rows.groupBy(F.substring_index("path", "-", -1).cast("bigint").alias("station"), "said").agg(F.count("*").alias("n"))


GLIDER_ROWS = """SELECT event_id, CASE WHEN event_id % 19 = 0 THEN 'NaN' WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 29 = 0 THEN 'x' ELSE concat(CAST(user_id AS VARCHAR(20)), '.0') END AS profile_id FROM {events}"""
_GLIDER = f"WITH g AS (SELECT event_id, CASE WHEN profile_id <> 'NaN' THEN CAST(TRY_CAST(profile_id AS DOUBLE) AS BIGINT) END AS p FROM ({GLIDER_ROWS.format(events='events')}) t)"


@query("S9_number_profiles", f"""{_GLIDER}, h AS (SELECT p, row_number() OVER (ORDER BY min(event_id)) - 1 AS profile_no FROM g WHERE p IS NOT NULL GROUP BY p)
SELECT event_id, g.p AS profile_id, row_number() OVER (PARTITION BY g.p ORDER BY event_id) - 1 AS place, profile_no FROM g JOIN h ON h.p = g.p""")
def s9b(i):
    return ob.number_profiles(i.sql(GLIDER_ROWS, "events"), "event_id")[0].select("event_id", "profile_id", "place", "profile_no")


@query("S9_refused_rows", f"{_GLIDER} SELECT event_id, 'missing_profile_id' AS problem FROM g WHERE p IS NULL")
def s9c(i):
    return ob.number_profiles(i.sql(GLIDER_ROWS, "events"), "event_id")[1].select("event_id", "problem")


@query("S9_group_rows_to_profiles", f"SELECT event_id, variable, variable = 'oxygen' AS inspect_only FROM ({MODES.format(events='events')}) t")
def s9(i):
    ranges = {"temperature": (-3.0, 45.0), "oxygen": (500.0, 0.0), "pressure": (0.0, 12000.0)}
    return ob.group_rows_to_profiles(i.sql(MODES, "events").select("event_id", "variable"), ranges)


MAPPED = """SELECT event_id, concat('p', CAST(user_id AS VARCHAR(20))) AS cast_name, CAST(ts AS VARCHAR(40)) AS time, CAST(event_id % 90 AS VARCHAR(20)) AS lat_text,
  CASE event_id % 4 WHEN 0 THEN CAST(event_id % 300 AS VARCHAR(20)) WHEN 1 THEN '' WHEN 2 THEN 'NaN' ELSE CASE WHEN event_id % 12 = 3 THEN 'warm' ELSE '280' END END AS kelvin,
  CAST(event_id % 50 AS VARCHAR(20)) AS chl, event_type AS note FROM {events}"""


@query("S10_apply_column_mapping", f"""
SELECT cast_name AS profile_id, lat_text AS latitude, CASE WHEN kelvin IN ('', 'NaN', 'warm') THEN NULL ELSE round(CAST(TRY_CAST(kelvin AS DOUBLE) - 273.15e0 AS DOUBLE), 6) END AS temperature_c,
  TRY_CAST(chl AS DOUBLE) * 1000 AS chlorophyll_mg_m3, kelvin = 'warm' AS rejected FROM ({MAPPED.format(events='events')}) t""")
def s10(i):
    out = ob.map_columns(i.sql(MAPPED, "events"), [("profile_id", "cast_name", None), ("latitude", "lat_text", None), ("temperature_c", "kelvin", "K"), ("chlorophyll_mg_m3", "chl", "mg/L")])
    return out.select("profile_id", "latitude", F.round("temperature_c", 6).alias("temperature_c"), "chlorophyll_mg_m3", F.col("_rejected").alias("rejected"))


@query("S11_profile_summary", """
SELECT case_id, profile_id, epoch_us(min(ts)) AS t0, epoch_us(max(ts)) AS t1, arg_min(lat, sample_index) AS lat, arg_min(lon, sample_index) AS lon, min(depth_m) AS depth_min, max(depth_m) AS depth_max,
  count(*) AS samples, count(*) FILTER (WHERE qc_verdict = 'accepted') AS accepted FROM obs_qc GROUP BY 1, 2""", ("obs_qc",))
def s11(i):
    s = ob.profile_summary(qco.readings(i))
    return s.withColumns({"t0": F.unix_micros("time"), "t1": F.unix_micros("time_end")}).drop("time", "time_end")


@query("S11_profile_track", """
WITH m AS (SELECT case_id, profile_id, sample_index, lon, CASE WHEN sample_index % 7 < 3 THEN lat + 1 ELSE lat END AS lat FROM obs),
 l AS (SELECT *, lag(lon) OVER w AS pl, lag(lat) OVER w AS pa FROM m WINDOW w AS (PARTITION BY case_id, profile_id ORDER BY sample_index))
SELECT case_id, profile_id, sample_index, lon, lat FROM l WHERE pl IS NULL OR pl <> lon OR pa <> lat""", ("obs",))
def s11b(i):
    moving = i.obs.withColumn("lat", F.when(F.col("sample_index") % 7 < 3, F.col("lat") + 1).otherwise(F.col("lat")))
    return ob.profile_track(moving)


CORE = """SELECT CAST(floor(event_id / 3334e0) AS BIGINT) AS case_id, concat('p', CAST(user_id AS VARCHAR(20))) AS profile_id, event_id, CAST(event_id % 3000 AS DOUBLE) / 2 - 20 AS pressure,
  CASE WHEN event_id % 9 > 0 THEN value END AS temperature, CAST(event_id % 40 AS DOUBLE) AS salinity, CAST(event_id % 3 AS VARCHAR(20)) AS pressure_qc, CAST(event_id % 5 AS VARCHAR(20)) AS temperature_qc,
  CAST(event_id % 7 AS VARCHAR(20)) AS salinity_qc, CASE user_id % 9 WHEN 0 THEN '4' ELSE '1' END AS position_qc, '2' AS time_qc, CAST(event_id % 3000 AS DOUBLE) / 2 AS depth_m FROM {events}"""


@query("S12_core_profile_eligibility", f"""
WITH e AS (SELECT *, position_qc IN ('1', '2') AND time_qc IN ('1', '2') AND pressure_qc IN ('1', '2') AND temperature_qc IN ('1', '2') AND salinity_qc IN ('1', '2') AND temperature IS NOT NULL
  AND pressure >= 0 AS ok FROM ({CORE.format(events='events')}) t)
SELECT case_id, profile_id, count(*) AS samples, count(*) FILTER (WHERE ok) AS eligible_samples, min(depth_m) FILTER (WHERE ok) AS depth_min, max(depth_m) FILTER (WHERE ok) AS depth_max FROM e GROUP BY 1, 2""")
def s12(i):
    return ob.core_profiles(i.sql(CORE, "events"))


@query("S13_profile_model_overlap", """
WITH p AS (SELECT case_id, profile_id, min(ts) AS t, arg_min(lat, sample_index) AS lat, arg_min(lon, sample_index) AS lon, min(depth_m) AS d0, max(depth_m) AS d1, count(*) FILTER (WHERE qc_verdict = 'accepted') AS n
  FROM obs_qc GROUP BY 1, 2),
 s AS (SELECT *, floor(epoch_us(t) / 1e6) AS sec FROM p),
 f AS (SELECT case_id, it, epoch_us(ts) / 1e6 AS fs FROM frames),
 n AS (SELECT s.case_id, profile_id, arg_min(it, (abs(fs - sec), it)) AS it, arg_min(fs, (abs(fs - sec), it)) AS fs, any_value(sec) BETWEEN min(fs) AND max(fs) AS temporal FROM s JOIN f USING (case_id) GROUP BY 1, 2)
SELECT case_id, profile_id, lat BETWEEN 10 AND 12.75 AND lon BETWEEN 85 AND 88.5 AS spatial, temporal, greatest(d0, 0) <= least(d1, 250) AS vertical,
  lat BETWEEN 10 AND 12.75 AND lon BETWEEN 85 AND 88.5 AND temporal AND greatest(d0, 0) <= least(d1, 250) AND s.n > 0 AS eligible, n.it AS nearest_it, CAST(sec - fs AS BIGINT) AS offset_seconds
FROM s JOIN n USING (case_id, profile_id)""", ("obs_qc", "frames"))
def s13(i):
    box = i.axes.groupBy("case_id").agg(*[f(F.when(F.col("axis") == a, F.col("coord"))).alias(n) for a, f, n in (
        ("lon", F.min, "west"), ("lat", F.min, "south"), ("lon", F.max, "east"), ("lat", F.max, "north"), ("depth", F.min, "depth_min"), ("depth", F.max, "depth_max"))])
    p = ob.profile_summary(qco.readings(i)).withColumnRenamed("accepted", "eligible_samples")
    return tables.profile_model_overlap(p, box, i.frames)


@query("S14_field_stats", f"""SELECT case_id, it, min(value) AS min, max(value) AS max, count(value) AS valid, {NZ * NY * NX} - count(value) AS missing FROM grid GROUP BY 1, 2""", ("grid",))
def s14(i):
    return grids.field_stats(i.cells, grids.lattice_size(i.axes), "it")


@query("S15_decimate", f"SELECT {KEYS}, value, CAST(value AS FLOAT) AS display FROM grid WHERE (iy % 2 = 0 OR iy = 11) AND (ix % 2 = 0 OR ix = 14)", ("grid",))
def s15(i):
    return grids.decimate(i.cells, i.axes, 2)


@query("S15_rounding_error", """SELECT case_id, it, coalesce(max(abs(CAST(CAST(w AS FLOAT) AS DOUBLE) - w)), 0) AS max_error FROM (SELECT *, value / 3 AS w FROM grid) t
WHERE (iy % 3 = 0 OR iy = 11) AND (ix % 3 = 0 OR ix = 14) GROUP BY 1, 2""", ("grid",))
def s15b(i):
    thirds = i.cells.withColumn("value", F.col("value") / 3)
    return grids.rounding_error(grids.decimate(thirds, i.axes, 3), "case_id", "it")


@query("S16_linspace_decimate", f"""SELECT {KEYS}, value FROM grid WHERE iy IN (SELECT CAST(round_even(k * 11 / 4e0, 0) AS INT) FROM generate_series(0, 4) g(k))
 AND ix IN (SELECT CAST(round_even(k * 14 / 5e0, 0) AS INT) FROM generate_series(0, 5) g(k)) AND iz IN (SELECT CAST(round_even(k * 6 / 3e0, 0) AS INT) FROM generate_series(0, 3) g(k))""", ("grid",))
def s16(i):
    return grids.linspace_decimate(i.cells, i.axes, {"lat": 5, "lon": 6, "depth": 4}).select("case_id", "it", "iz", "iy", "ix", "value")


register_cte("docfiles", "SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, CAST(strlen(text) AS BIGINT) AS bytes, sha256(text) AS sha256 FROM documents")


def docfiles(i):
    docs = i.table("documents").withColumn("path", F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return au.inventory(docs, "path", "text")


@query("S21_file_inventory", "SELECT * FROM docfiles", ("docfiles",))
def s21(i):
    return docfiles(i)


@query("S21_inventory_budget", """SELECT count(*) AS files, CAST(sum(bytes) AS BIGINT) AS total_bytes, max(bytes) AS largest, sum(bytes) <= 500000000 AND max(bytes) <= 100000000 AND count(*) <= 5000 AS within_budget FROM docfiles""", ("docfiles",))
def s21b(i):
    return au.inventory_budget(docfiles(i), 500_000_000, 100_000_000, 5000)


@query("S21_read_tree")
def s21c(i):
    return au.read_tree(i.spark, i.dir)


@query("S21_read_tree_known", """
WITH f AS (SELECT coalesce(source, '-') AS s, doc_id // 100 AS b, string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id) AS body FROM documents GROUP BY 1, 2)
SELECT 's=' || s || '/b=' || CAST(b AS VARCHAR) AS folder, CAST(strlen(body) AS BIGINT) AS bytes, sha256(body) AS sha256 FROM f""")
def s21d(i):
    """The documents as text files, a hundred ids a file, written in order and then read as a tree."""
    import uuid
    root = f"{checkpoint_root(i.spark)}/tree-{uuid.uuid4().hex}"
    rows = i.table("documents").select(F.coalesce("source", F.lit("-")).alias("s"), F.floor(F.col("doc_id") / 100).alias("b"), "doc_id", F.coalesce("text", F.lit("")).alias("value"))
    rows.repartition("s", "b").sortWithinPartitions("s", "b", "doc_id").drop("doc_id").write.partitionBy("s", "b").text(root)
    files = au.read_tree(i.spark, root).filter("path LIKE '%/part-%'")
    return files.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), "bytes", "sha256")


@query("S22_audit_manifest", """
WITH m AS (SELECT path, CASE WHEN bytes % 10 = 3 THEN bytes + 1 ELSE bytes END AS bytes, CASE WHEN bytes % 10 = 4 THEN 'x' ELSE sha256 END AS sha256 FROM docfiles WHERE bytes % 10 <> 5),
 f AS (SELECT * FROM docfiles WHERE bytes % 10 <> 6)
SELECT path, CASE WHEN f.bytes IS NULL THEN 'missing' WHEN m.bytes IS NULL THEN 'undeclared' WHEN f.bytes <> m.bytes OR f.sha256 <> m.sha256 THEN 'mismatch' ELSE 'ok' END AS status
FROM f FULL JOIN m USING (path)""", ("docfiles",))
def s22(i):
    f, r = docfiles(i), F.col("bytes") % 10
    manifest = f.filter(r != 5).withColumns({"sha256": F.when(r == 4, "x").otherwise(F.col("sha256")), "bytes": F.when(r == 3, F.col("bytes") + 1).otherwise(F.col("bytes"))})
    return au.audit_manifest(f.filter(r != 6), manifest)


SEAM = """SELECT DISTINCT case_id, CAST((343 + 7 * case_id) % 360 AS DOUBLE) AS west, CAST((358 + 7 * case_id) % 360 AS DOUBLE) AS east, 10.25e0 AS south, 12.5e0 AS north,
  CAST(CASE WHEN case_id % 2 = 0 THEN '2024-01-01' ELSE '2023-12-01' END AS DATE) AS {q}start{q}, CAST(CASE WHEN case_id % 2 = 0 THEN '2024-02-01' ELSE '2024-01-01' END AS DATE) AS {q}end{q},
  5e0 AS depth_min, 120e0 AS depth_max FROM {cases}"""
_SEAM = f"""WITH c AS ({SEAM.format(q='"', cases='cases')}), p AS (SELECT case_id, profile_id, min(ts) AS t, arg_min(lat, sample_index) AS lat, round((arg_min(lon, sample_index) - 85) * 10 - 17, 3) AS lon,
  min(depth_m) AS d0, max(depth_m) AS d1 FROM obs GROUP BY 1, 2), f AS (SELECT p.profile_id, p.case_id AS own, c.case_id, d0, d1, lat BETWEEN south AND north
  AND CASE WHEN west <= east THEN (lon + 360) % 360 BETWEEN west AND east ELSE (lon + 360) % 360 >= west OR (lon + 360) % 360 <= east END AS spatial,
  t >= "start" AND t < "end" AS temporal, greatest(d0, depth_min) <= least(d1, depth_max) AS vertical FROM p, c)"""


def seam(i):
    """Cases around the seam, a month each, and the profiles with their longitudes spread over it."""
    p = ob.profile_summary(qco.readings(i)).withColumn("lon", F.round((F.col("lon") - 85) * 10 - 17, 3))
    return p, i.spark.sql(SEAM.format(q="`", cases="{cases}"), cases=i.cases)


@query("S13_monthly_overlap", f"{_SEAM} SELECT case_id, profile_id, spatial, temporal, vertical, false AS eligible FROM f WHERE own = case_id", ("cases", "obs"))
def s13b(i):
    return tables.cyclic_overlap(*seam(i))


@query("S13_cases_met", f"{_SEAM} SELECT profile_id, case_id FROM f WHERE spatial AND temporal", ("cases", "obs"))
def s13c(i):
    return tables.cases_met(*seam(i))


@query("S23_catalog", """
SELECT f.case_id, f.frames, epoch_us(time_start) AS t0, epoch_us(time_end) AS t1, profiles, platforms, instruments, collections
FROM (SELECT case_id, count(*) AS frames, min(ts) AS time_start, max(ts) AS time_end FROM frames GROUP BY 1) f
LEFT JOIN (SELECT case_id, count(DISTINCT profile_id) AS profiles, count(DISTINCT platform) AS platforms, count(DISTINCT instrument) AS instruments, count(DISTINCT collection) AS collections
  FROM obs GROUP BY 1) p USING (case_id)""", ("frames", "obs"))
def s23(i):
    profiles = i.obs.select("case_id", "profile_id", "platform", "instrument", "collection").distinct()
    return tables.catalog(profiles, i.frames).withColumns({"t0": F.unix_micros("time_start"), "t1": F.unix_micros("time_end")}).drop("time_start", "time_end")


@query("S24_write_table_csv", r"""SELECT 'v1' AS method, event_id, CASE WHEN regexp_matches(t, '^\s*[=+\-@]') THEN '''' || t ELSE t END AS note, value FROM (
 SELECT event_id, CASE event_id % 6 WHEN 0 THEN '=1+1' WHEN 1 THEN '  -x' WHEN 2 THEN '@a' WHEN 3 THEN event_type WHEN 4 THEN '+' ELSE NULL END AS t, value FROM events) q""")
def s24(i):
    k = F.col("event_id") % 6
    note = F.when(k == 0, "=1+1").when(k == 1, "  -x").when(k == 2, "@a").when(k == 3, F.col("event_type")).when(k == 4, "+")
    return tables.guarded(i.table("events").select("event_id", note.alias("note"), "value"), {"method": "v1"})


@query("S25_export_result_tables", """SELECT 'm1' AS method_version, case_id, state, total_profiles, matched_profiles FROM (
 SELECT case_id, 'baseline' AS state, count(*) AS total_profiles, count(*) FILTER (WHERE matched > 0) AS matched_profiles FROM cover GROUP BY 1) q""", ("cover",))
def s25(i):
    """Tables are exported to files and read back."""
    import uuid
    from brinefield.operators import coverage as cov
    profiles = cov.profile_coverage(qco.matches(i))
    states = profiles.groupBy("case_id").agg(F.count("*").alias("total_profiles"), F.count_if(F.col("matched") > 0).alias("matched_profiles")).withColumn("state", F.lit("baseline"))
    root = f"{checkpoint_root(i.spark)}/export-{uuid.uuid4().hex}"
    tables.export_tables({"blackout-coverage": states}, root, {"method_version": "m1"}, ["case_id"])
    return i.spark.read.csv(f"{root}/blackout-coverage", header=True, schema="method_version string, total_profiles bigint, matched_profiles bigint, state string, case_id bigint")


@query("S26_regional_export", """
SELECT g.case_id, it, g.ix AS source_longitude_index, g.iy AS source_latitude_index, g.iz AS source_level_index, lon AS longitude_unwrapped_deg_east, lat AS latitude_deg_north, depth AS vertical_coordinate,
  value AS temperature, '°C' AS units FROM grid g JOIN ax_depth z ON z.case_id = g.case_id AND z.idx = g.iz JOIN ax_lat y ON y.case_id = g.case_id AND y.idx = g.iy
JOIN ax_lon x ON x.case_id = g.case_id AND x.idx = g.ix WHERE lon BETWEEN 85.75 AND 87.5 AND lat BETWEEN 10.5 AND 12.25""", ("grid", "ax_depth", "ax_lat", "ax_lon"))
def s26(i):
    return tables.regional_export(i.cells, i.axes, 85.75, 87.5, 10.5, 12.25, "temperature", "°C")


@query("S27_upsert_profiles", """
WITH e AS (SELECT 'p' || CAST(user_id AS VARCHAR) AS profile_id, 'old' AS version, count(*) AS samples FROM events WHERE user_id % 3 > 0 GROUP BY 1),
 n AS (SELECT 'p' || CAST(user_id AS VARCHAR) AS profile_id, 'new' AS version, count(*) AS samples FROM events WHERE user_id % 5 < 2 GROUP BY 1)
SELECT * FROM e WHERE profile_id NOT IN (SELECT profile_id FROM n) UNION ALL SELECT * FROM n""")
def s27(i):
    def side(cond, version):
        return i.table("events").filter(cond).groupBy(F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("profile_id")).agg(F.count("*").alias("samples")).withColumn("version", F.lit(version))
    return tables.upsert_profiles(side("user_id % 3 > 0", "old"), side("user_id % 5 < 2", "new"))


# Audit of results

def _exact(name):
    return exact_number(f"CAST({name} AS DOUBLE)", "VARCHAR", refuse=False)


_TXT = (f"'case_id|' || {_exact('case_id')} || '|it|' || {_exact('it')} || '|name|s' || CAST(length(name) AS VARCHAR) || ':' || name "
        f"|| '|value|' || {_exact('value')}")
#: Values that differ in the last bits, and very large and very small ones.
STRETCHED = "CASE ix WHEN 3 THEN value * 1e30 WHEN 4 THEN value + 1e-12 WHEN 5 THEN value / 1e200 WHEN 6 THEN -value / 3e0 ELSE value END"


@query("E10_fingerprint", f"""SELECT iz, count(*) AS "rows", {digest_sql(_TXT)} AS fingerprint FROM (SELECT case_id, it, iz, 'cell-' || CAST(ix AS VARCHAR) AS name, {STRETCHED} AS value FROM grid) t GROUP BY 1""", ("grid",))
def e10(i):
    rows = i.cells.select("case_id", "it", "iz", F.concat(F.lit("cell-"), F.col("ix").cast("string")).alias("name"), F.expr(STRETCHED).alias("value"))
    return au.fingerprint(rows, "iz")


_RUN = """SELECT case_id || '-' || it AS run_id, CASE WHEN it = 1 THEN 'r2' ELSE 'r1' END AS recipe_sha, CASE WHEN it = 2 THEN 'm2' ELSE 'm1' END AS method, CASE WHEN it = 3 THEN 's2' ELSE 's1' END AS source_sha FROM (SELECT DISTINCT case_id, it FROM grid)"""


@query("E11_replay", f"""SELECT case_id || '-' || it AS run_id, CASE it WHEN 0 THEN 'source_unavailable' WHEN 1 THEN 'recipe_mismatch' WHEN 2 THEN 'method_mismatch' WHEN 3 THEN 'source_mismatch' WHEN 4 THEN 'result_mismatch'
  ELSE 'matched' END AS outcome FROM (SELECT DISTINCT case_id, it FROM grid) t""", ("grid",))
def e11(i):
    run = F.concat_ws("-", F.col("case_id").cast("string"), F.col("it").cast("string")).alias("run_id")
    def part(k, other, value):
        return F.when(F.col("it") == k, other).otherwise(value)
    changed = i.cells.withColumn("value", F.when((F.col("it") == 4) & (F.col("ix") == 0), F.col("value") + 1e-12).otherwise(F.col("value")))
    def table(cells, new):
        digests = au.fingerprint(cells, "case_id", "it")
        return digests.select(run, "it", part(1, "r2", "r1").alias("recipe_sha") if new else F.lit("r1").alias("recipe_sha"), part(2, "m2", "m1").alias("method") if new else F.lit("m1").alias("method"),
                              part(3, "s2", "s1").alias("source_sha") if new else F.lit("s1").alias("source_sha"), F.col("fingerprint").alias("result_sha"))
    return au.replay(table(i.cells, False), table(changed, True).filter("it <> 0"))


WIDE_LINES = """SELECT index_id, y, concat_ws(' ', CAST(y AS VARCHAR(9)), CAST(m1 AS VARCHAR(20)), CAST(m2 AS VARCHAR(20)), CAST(m3 AS VARCHAR(20)), CAST(m4 AS VARCHAR(20)), CAST(m5 AS VARCHAR(20)), CAST(m6 AS VARCHAR(20)),
  CAST(m7 AS VARCHAR(20)), CAST(m8 AS VARCHAR(20)), CAST(m9 AS VARCHAR(20)), CAST(m10 AS VARCHAR(20)), CAST(m11 AS VARCHAR(20)), CASE WHEN y % 4 < 3 THEN CAST(m12 AS VARCHAR(20)) END) AS line
FROM (SELECT CAST(floor(o_custkey / 500e0) AS BIGINT) AS index_id, year(o_orderdate) AS y, """ + ", ".join(
    f"CASE WHEN count(CASE WHEN month(o_orderdate) = {m} THEN 1 END) % 9 = 0 THEN -999 ELSE count(CASE WHEN month(o_orderdate) = {m} THEN 1 END) END AS m{m}" for m in range(1, 13)) + """
  FROM {orders} GROUP BY 1, 2) t"""


@query("E12_wide_to_long", """SELECT CAST(floor(o_custkey / 500e0) AS BIGINT) AS index_id, y, m, CAST(CASE WHEN count(*) FILTER (WHERE month(o_orderdate) = m) % 9 > 0 THEN count(*) FILTER (WHERE month(o_orderdate) = m) END AS DOUBLE) AS value_c
FROM (SELECT *, year(o_orderdate) AS y FROM orders), generate_series(1, 12) g(m) WHERE y % 4 < 3 GROUP BY 1, 2, 3""")
def e12(i):
    return ob.wide_to_long(i.sql(WIDE_LINES, "orders").withColumn("sentinel", F.lit(-999.0)))


@query("E12_wide_problems", """WITH y AS (SELECT DISTINCT CAST(floor(o_custkey / 500e0) AS BIGINT) AS index_id, year(o_orderdate) AS y FROM orders)
SELECT index_id, 'malformed' AS problem, count(*) AS n FROM y WHERE y % 4 = 3 GROUP BY 1 UNION ALL SELECT a.index_id, 'year_order', count(*) FROM y a JOIN y b ON b.index_id = a.index_id AND b.y = a.y - 2
WHERE a.y % 4 = 0 GROUP BY 1""")
def e12b(i):
    return ob.wide_problems(i.sql(WIDE_LINES, "orders")).groupBy("index_id", "problem").agg(F.count("*").alias("n"))


SEASON_LINES = """SELECT index_id, y, m, CASE WHEN m = 12 AND y % 2 = 0 THEN 'comment line' ELSE concat_ws('  ', CAST(y AS VARCHAR(9)), season, CAST(a AS VARCHAR(20)), 'NaN', CAST(b AS VARCHAR(20))) END AS line FROM (
  SELECT CAST(floor(o_custkey / 500e0) AS BIGINT) AS index_id, year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS a, sum(o_orderkey) % 7 - 3 AS b,
   CASE month(o_orderdate) """ + " ".join(f"WHEN {k + 1} THEN '{s}'" for k, s in enumerate(ob.SEASONS)) + """ END AS season FROM {orders} GROUP BY 1, 2, 3) t"""


@query("E13_read_season_text", f"""SELECT index_id, y, m, split_part(line, '  ', 2) AS season, CAST(split_part(line, '  ', 3) AS DOUBLE) AS west_c, CAST(NULL AS DOUBLE) AS east_c, CAST(split_part(line, '  ', 5) AS DOUBLE) AS value_c
FROM ({SEASON_LINES.format(orders='orders')}) t WHERE line <> 'comment line'""")
def e13(i):
    return ob.read_season_text(i.sql(SEASON_LINES, "orders").select("index_id", "line"))


BROKEN_LINES = f"""SELECT index_id, y, m, n, CASE WHEN line = 'comment line' THEN line WHEN m = 1 AND y % 2 = 0 THEN concat(CAST(y AS VARCHAR(9)), '  DJF  1.0') WHEN m = 2 THEN concat(line, '  9')
  WHEN m = 3 THEN concat(CAST(y AS VARCHAR(9)), '  XYZ  1  2  3') WHEN m = 5 AND y % 3 = 0 THEN concat(CAST(y AS VARCHAR(9)), '  AMJ  warm  2  3') ELSE line END AS line
FROM ({SEASON_LINES}) q CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2) r WHERE n = 1 OR (m = 7 AND y % 2 = 1)"""


@query("E13_season_problems", f"""SELECT index_id, problem, count(*) AS n FROM (SELECT index_id, CASE WHEN line = 'comment line' THEN NULL WHEN m = 1 AND y % 2 = 0 OR m = 2 THEN 'malformed' WHEN m = 3 THEN 'unknown_season'
  WHEN m = 5 AND y % 3 = 0 THEN 'invalid_number' WHEN m = 7 AND y % 2 = 1 THEN 'duplicate' END AS problem FROM ({BROKEN_LINES.format(orders='orders')}) b) t WHERE problem IS NOT NULL GROUP BY 1, 2""")
def e13b(i):
    return ob.season_problems(i.sql(BROKEN_LINES, "orders").select("index_id", "line")).groupBy("index_id", "problem").agg(F.count("*").alias("n"))


assert NT == 7
