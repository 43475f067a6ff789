"""Queries over sample arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from framekit.dims import line_geometry as geometry
from framekit.operators import samples as sm
from framekit.plans.fixtures import view
from framekit.plans.registry import query


def text(col: str):
    return F.array_join(F.transform(col, lambda x: x.cast("string")), ",")


@query("line_geometry", """WITH
 g AS (SELECT 'PAL' AS standard, n, 1135 + CASE WHEN n IN (313, 625) THEN 2 ELSE 0 END AS c, 312 AS f1, 24970 AS lo, 707104 AS hi, n BETWEEN 6 AND 18 OR n BETWEEN 319 AND 331 AS r FROM range(1, 626) t(n)
   UNION ALL SELECT 'NTSC', n, 910, 262, 19110, 474109, n BETWEEN 10 AND 18 OR n BETWEEN 273 AND 281 FROM range(1, 526) t(n)
   UNION ALL SELECT 'PAL_M', n, 909, 262, 19089, 473588, n BETWEEN 10 AND 18 OR n BETWEEN 273 AND 281 FROM range(1, 526) t(n)),
 o AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY standard ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM g),
 p AS (SELECT standard, count(*) AS n_projects FROM fx_project GROUP BY 1)
SELECT o.standard, CAST(n AS INT) AS line_no, CAST(off AS BIGINT) AS sample_offset, CAST(c AS INT) AS sample_count, CASE WHEN n <= f1 THEN 1 ELSE 2 END AS field, off + c > lo AND off <= hi AS is_active, r AS is_reserved, n_projects FROM o JOIN p USING (standard)""")
def line_geometry(spark, sf):
    projects = view(spark, sf, "fx_project").groupBy("standard").agg(F.count("*").alias("n_projects"))
    return geometry(spark).join(projects, "standard")


RECIP = "CASE standard WHEN 'PAL' THEN 901925094 ELSE 841820325 END"
BLANK = "CASE standard WHEN 'PAL' THEN 256 ELSE 240 END"
M50, H50 = 1 << 50, 1 << 49
POS = f"""
 v AS (SELECT frame_id, capture_id, standard, unnest(range(len(y))) AS i, CAST(round(unnest(y) * 1048576) AS BIGINT) AS yf, CAST(round(unnest(c) * 1048576) AS BIGINT) AS cf FROM fx_yc),
 x AS (SELECT *, (yf + cf) * {RECIP} AS p, yf * {RECIP} AS py, cf * {RECIP} AS pc FROM v),
 h AS (SELECT *, CASE WHEN p >= 0 THEN p + {H50} ELSE p - {H50} END AS q, CASE WHEN py >= 0 THEN py + {H50} ELSE py - {H50} END AS qy, CASE WHEN pc >= 0 THEN pc + {H50} ELSE pc - {H50} END AS qc FROM x),
 k AS (SELECT *, (q - ((q % {M50}) + {M50}) % {M50}) // {M50} + {BLANK} AS code, (qy - ((qy % {M50}) + {M50}) % {M50}) // {M50} + {BLANK} AS ycode, (qc - ((qc % {M50}) + {M50}) % {M50}) // {M50} + 512 AS ccode,
   CAST(round((yf + cf) / 1048576.0::DOUBLE / CASE standard WHEN 'PAL' THEN 1.1905::DOUBLE ELSE 1.2755::DOUBLE END) AS BIGINT) + {BLANK} AS nominal FROM h)"""


@query("quantise_samples", f"""WITH {POS}
SELECT frame_id, string_agg(CAST(least(greatest(code, 4), 1019) AS VARCHAR), ',' ORDER BY i) AS u10, string_agg(CAST((least(greatest(code, 4), 1019) - 508) * 64 AS VARCHAR), ',' ORDER BY i) AS tpg21,
 string_agg(CAST(least(greatest((code - {BLANK}) * 32, -32768), 32767) AS VARCHAR), ',' ORDER BY i) AS s16, string_agg(CAST(least(greatest(CAST(round((yf + cf) / 1048576.0::DOUBLE) AS BIGINT), -32768), 32767) AS VARCHAR), ',' ORDER BY i) AS raw,
 string_agg(CAST(least(greatest(nominal, 4), 1019) AS VARCHAR), ',' ORDER BY i) AS nominal, string_agg(CAST(least(greatest(ycode, 4), 1019) AS VARCHAR), ',' ORDER BY i) AS luma, string_agg(CAST(least(greatest(ccode, 4), 1019) AS VARCHAR), ',' ORDER BY i) AS chroma FROM k GROUP BY 1""")
def quantise_samples(spark, sf):
    lines = view(spark, sf, "fx_yc")
    out = lines
    for name, encoding, rounding in (
        ("u10", "CVBS_U10_4FSC", "fixed"), ("tpg21", "CVBS_TPG21_4FSC", "fixed"), ("s16", "CVBS_S16_4FSC", "fixed"),
        ("raw", "RAW_S16_28M", "fixed"), ("nominal", "CVBS_U10_4FSC", "nominal"),
    ):
        coded = sm.quantise_samples(out.withColumns({"__y": F.col("y"), "__c": F.col("c")}), encoding, rounding=rounding)
        out = coded.withColumnsRenamed({"codes": name, "__y": "y", "__c": "c"})
    out = sm.quantise_samples(out, "CVBS_U10_4FSC", "yc")
    names = {"u10": "u10", "tpg21": "tpg21", "s16": "s16", "raw": "raw", "nominal": "nominal", "codes": "luma", "chroma_codes": "chroma"}
    return out.select("frame_id", *[text(c).alias(n) for c, n in names.items()])


#: Captures by how they are sent; four rows make a frame, so that positions need the row.
SENT = "CASE capture_id % 4 WHEN 0 THEN 'yc' WHEN 1 THEN 'raw' ELSE 'composite' END"


@query("nonstandard_rollup", f"""WITH {POS},
 s AS (SELECT *, frame_id // 4 AS frame, frame_id % 4 + 1 AS line, {SENT} AS sent FROM k),
 f AS (SELECT *, CASE sent WHEN 'raw' THEN FALSE WHEN 'yc' THEN ycode < CASE standard WHEN 'PAL' THEN 3 ELSE 15 END OR ycode > 1020
   ELSE code < CASE standard WHEN 'PAL' THEN 3 ELSE 15 END OR code > 1020 END AS odd FROM s)
SELECT capture_id, bool_or(odd) AS has_nonstandard, count(*) FILTER (WHERE odd) AS n_nonstandard,
 CAST(arg_min(frame, (frame, line, i)) FILTER (WHERE odd) AS BIGINT) AS first_frame, CAST(arg_min(line, (frame, line, i)) FILTER (WHERE odd) AS BIGINT) AS first_line,
 CAST(arg_min(i, (frame, line, i)) FILTER (WHERE odd) AS BIGINT) AS first_sample FROM f GROUP BY 1""")
def nonstandard_rollup(spark, sf):
    rows = view(spark, sf, "fx_yc").withColumns({
        "line": F.col("frame_id") % 4 + 1, "frame_id": F.floor(F.col("frame_id") / 4), "sent": F.expr(SENT),
    })
    kinds = {"composite": ("CVBS_U10_4FSC", "composite"), "yc": ("CVBS_U10_4FSC", "yc"), "raw": ("RAW_S16_28M", "composite")}
    parts = [
        sm.nonstandard_rollup(rows.filter(F.col("sent") == sent), ["capture_id"], encoding, signal_type, line="line")
        for sent, (encoding, signal_type) in kinds.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


RESAMPLED = """
 s AS (SELECT frame_id, list_transform(samples, lambda v: CAST(round(v * 1048576) AS BIGINT)) AS a, 20 + frame_id % 100 AS n FROM fx_line_array),
 i AS (SELECT *, unnest(range(n)) AS i FROM s),
 p AS (SELECT *, (len(a) - 1)::DOUBLE * (i::DOUBLE / (n - 1)::DOUBLE) AS pos FROM i),
 l AS (SELECT *, CAST(floor(pos) AS BIGINT) AS l FROM p),
 v AS (SELECT frame_id, i, CAST(round((1.0 - (pos - l)) * a[l + 1] + (pos - l) * a[least(l + 1, len(a) - 1) + 1]) AS BIGINT) AS v FROM l)"""


@query("resample_linear", f"WITH {RESAMPLED} SELECT frame_id, string_agg(CAST(v AS VARCHAR), ',' ORDER BY i) AS samples FROM v GROUP BY 1")
def resample_linear(spark, sf):
    lines = view(spark, sf, "fx_line_array").withColumn("samples", F.transform("samples", sm.to_fixed))
    out = sm.resample_linear(lines, (20 + F.col("frame_id") % 100).cast("int"))
    return out.select("frame_id", text("samples").alias("samples"))


@query("requantise_24_to_16", """WITH
 s AS (SELECT frame_id, unnest(range(len(samples))) AS i, CAST(floor(unnest(samples) * 30000) AS BIGINT) AS v FROM fx_line_array),
 r AS (SELECT *, CASE WHEN v < 0 THEN -((-v + 128) // 256) ELSE (v + 128) // 256 END AS q FROM s)
SELECT frame_id, string_agg(CAST(least(greatest(q, -32768), 32767) AS VARCHAR), ',' ORDER BY i) AS samples, CAST(count(*) FILTER (WHERE q > 32767 OR q < -32768) AS INT) AS n_saturated FROM r GROUP BY 1""")
def requantise_24_to_16(spark, sf):
    rows = view(spark, sf, "fx_line_array").withColumn("samples", F.transform("samples", lambda v: F.floor(v * 30000)))
    out = sm.requantise_24_to_16(rows.select("frame_id", "samples"))
    return out.select("frame_id", text("samples").alias("samples"), "n_saturated")


@query("measure_noise", """WITH v AS (SELECT capture_id, unnest(samples) AS x FROM fx_line_array),
 g AS (SELECT capture_id, count(*) AS n, avg(x) AS m, stddev_pop(x) AS s FROM v GROUP BY 1)
SELECT capture_id, n, round(m, 6) AS mean_mv, round(s, 6) AS stddev_mv, round(20 * log10(700.0::DOUBLE / s), 6) AS snr_db FROM g""")
def measure_noise(spark, sf):
    out = sm.measure_noise(view(spark, sf, "fx_line_array"), ["capture_id"], 700.0)
    return out.select("capture_id", "n", *[F.round(c, 6).alias(c) for c in ("mean_mv", "stddev_mv", "snr_db")])


@query("pulse_widths", """WITH
 v AS (SELECT frame_id, unnest(range(len(samples))) AS i, unnest(samples) AS x FROM fx_line_array),
 f AS (SELECT frame_id, min(CASE WHEN x <= -100 THEN i END) AS st FROM v GROUP BY 1),
 e AS (SELECT v.frame_id, st, min(CASE WHEN i > st AND x > -100 THEN i END) AS en, max(i) + 1 AS n FROM v JOIN f USING (frame_id) GROUP BY 1, 2)
SELECT frame_id, CAST(st AS INT) AS pulse_start, CAST(CASE WHEN st IS NULL THEN 0 ELSE coalesce(en, n) - st END AS INT) AS pulse_width FROM e""")
def pulse_widths(spark, sf):
    return sm.pulse_widths(view(spark, sf, "fx_line_array"), -100.0).select("frame_id", "pulse_start", "pulse_width")


def images(spark, sf):
    """Frames of 64 values as 8 x 8 images: rows of eight pixels with three shifted channels."""
    light = F.transform("samples", lambda v: F.least(F.abs(v) / 250.0, F.lit(1.0)))
    base = view(spark, sf, "fx_line_array").select(F.col("frame_id").alias("image_id"), light.alias("a"))
    rows = base.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(7))))

    def channel(shift: int):
        return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda x: F.get("a", F.pmod(F.col("y") * 8 + x + shift, F.lit(64))))

    return rows.select("image_id", "y", channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b"))


OETF = "CASE WHEN {x} <= 0 THEN 0 WHEN {x} < 0.018 THEN 4.5 * {x} ELSE 1.099 * pow({x}, 0.45) - 0.099 END"
IMAGE = f"""
 px AS (SELECT frame_id AS image_id, i, least(abs(s) / 250.0::DOUBLE, 1.0) AS l FROM (SELECT frame_id, unnest(range(64)) AS i, unnest(samples) AS s FROM fx_line_array)),
 gm AS (SELECT image_id, i, l, {OETF.format(x='l')} AS v FROM px),
 rgb AS (SELECT a.image_id, a.i, a.i % 8 AS x, a.i // 8 AS y, a.v AS r, b.v AS g, c.v AS b, a.l AS lr, b.l AS lg, c.l AS lb FROM gm a JOIN gm b ON a.image_id = b.image_id AND b.i = (a.i + 1) % 64 JOIN gm c ON a.image_id = c.image_id AND c.i = (a.i + 2) % 64)"""


@query("component_stats", f"""WITH {IMAGE},
 yy AS (SELECT *, 0.299 * r + 0.587 * g + 0.114 * b AS ey FROM rgb),
 d AS (SELECT *, r - ey AS dr, b - ey AS db FROM yy),
 n AS (SELECT *, lead(ey) OVER w AS ny, lead(dr) OVER w AS nr, lead(db) OVER w AS nb FROM d WINDOW w AS (PARTITION BY image_id, y ORDER BY x)),
 q AS (SELECT *, 219 * ey + 16 AS cy, 160 * dr + 128 AS cr, 126 * db + 128 AS cb FROM n WHERE y % 2 = 0 AND x % 2 = 0),
 z AS (SELECT *, (least(greatest(round_even(cy, 0), 0), 255) - 16) / 219 AS e2, (least(greatest(round_even(cr, 0), 0), 255) - 128) / 160 AS r2, (least(greatest(round_even(cb, 0), 0), 255) - 128) / 126 AS b2 FROM q),
 w AS (SELECT *, e2 + r2 AS rr, e2 + b2 AS bb, (e2 - 0.299 * (e2 + r2) - 0.114 * (e2 + b2)) / 0.587 AS gg FROM z),
 er AS (SELECT *, (abs(least(greatest(rr, 0), 1) - r) + abs(least(greatest(gg, 0), 1) - g) + abs(least(greatest(bb, 0), 1) - b)) * 255 / 3 AS e FROM w)
SELECT image_id, count(*) AS n, round(min(cy), 6) AS y_min, round(max(cy), 6) AS y_max, round(min(cb), 6) AS cb_min, round(max(cb), 6) AS cb_max, round(min(cr), 6) AS cr_min, round(max(cr), 6) AS cr_max,
 round(avg(e), 6) AS mean_error, round(max(e), 6) AS max_error, round(sum(0.5 * (abs(nr - dr) + abs(nb - db))) / greatest(sum(abs(ny - ey)), 1e-12), 6) AS edge_ratio FROM er GROUP BY 1""")
def component_stats(spark, sf):
    out = sm.component_stats(images(spark, sf), stride=(2, 2))
    return out.select("image_id", "n", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("image_id", "n")])


BORDER = f"""{IMAGE},
 bd AS (SELECT *, lr > 0.8 OR lg > 0.8 OR lb > 0.8 AS bad FROM rgb WHERE x < 1 OR x >= 7),
 rk AS (SELECT *, row_number() OVER (PARTITION BY image_id, bad ORDER BY y, x) AS n FROM bd),
 brd AS (SELECT image_id, count(*) AS border_pixels, count(*) FILTER (WHERE bad) AS bad_pixels, string_agg(CASE WHEN bad AND n <= 5 THEN concat(x, ',', y) END, ';' ORDER BY y, x) AS examples, count(*) FILTER (WHERE bad) = 0 AS ok FROM rk GROUP BY 1)"""


@query("border_check", f"WITH {BORDER} SELECT * FROM brd")
def border_check(spark, sf):
    return sm.border_check(images(spark, sf), 8, 1, 1, 0.8)


@query("check_report", f"""WITH {BORDER},
 ch AS (SELECT image_id, 'border' AS name, ok, 'FAIL' AS severity FROM brd UNION ALL SELECT image_id, 'bright', max(l) < 0.9, 'WARN' FROM px GROUP BY 1 UNION ALL SELECT image_id, 'dark', min(l) > 0.005, 'FAIL' FROM px GROUP BY 1)
SELECT image_id, CASE WHEN bool_or(NOT ok AND severity = 'FAIL') THEN 'FAIL' ELSE 'PASS' END AS verdict, count(*) AS n_checks, count(*) FILTER (WHERE NOT ok) AS n_not_ok,
 coalesce(string_agg(CASE WHEN NOT ok AND severity = 'FAIL' THEN name END, ',' ORDER BY name), '') AS failures, CASE WHEN bool_or(NOT ok) THEN 'FAIL' ELSE 'PASS' END AS strict_verdict FROM ch GROUP BY 1""")
def check_report(spark, sf):
    border = sm.border_check(images(spark, sf), 8, 1, 1, 0.8)
    light = images(spark, sf).groupBy("image_id").agg(F.max(F.array_max("r")).alias("hi"), F.min(F.array_min("r")).alias("lo"))

    def check(df, name, ok, severity):
        return df.select("image_id", F.lit(name).alias("name"), ok.alias("ok"), F.lit(severity).alias("severity"))

    checks = check(border, "border", F.col("ok"), "FAIL").unionByName(
        check(light, "bright", F.col("hi") < 0.9, "WARN")
    ).unionByName(check(light, "dark", F.col("lo") > 0.005, "FAIL"))
    strict = sm.check_report(checks, "image_id", strict=True).select("image_id", F.col("verdict").alias("strict_verdict"))
    return sm.check_report(checks, "image_id").join(strict, "image_id")
