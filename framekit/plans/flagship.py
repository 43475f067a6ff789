"""End to end: sections to numbered frames, dropout runs merged and split, lost samples per section type."""

from __future__ import annotations

from pyspark.sql import functions as F

from framekit.operators import intervals as iv
from framekit.operators import timeline as tl
from framekit.plans.fixtures import view
from framekit.plans.registry import query


@query("lost_samples_by_section_type", """WITH
 cap AS (SELECT project_id, CASE WHEN project_id >= 0 THEN project_id % 15 END AS capture_id FROM fx_project),
 f AS (SELECT p.section_type, p.standard, c.capture_id, first_frame + i AS frame_id FROM fx_placed p JOIN cap c USING (project_id), LATERAL (SELECT unnest(range(n_frames)) AS i) u),
 e AS (SELECT DISTINCT capture_id, frame_id, unnest(range(sample_start, sample_start + sample_count)) AS p FROM fx_run),
 k AS (SELECT capture_id, frame_id, count(*) AS lost FROM e GROUP BY 1, 2),
 r AS (SELECT section_type, standard, count(*) AS n_frames, count(lost) AS n_hit, coalesce(sum(lost), 0) AS lost FROM f LEFT JOIN k USING (capture_id, frame_id) GROUP BY 1, 2)
SELECT section_type, standard, CAST(grouping_id(section_type, standard) AS INT) AS level, CAST(sum(n_frames) AS BIGINT) AS n_frames, CAST(sum(n_hit) AS BIGINT) AS n_hit, CAST(sum(lost) AS BIGINT) AS lost FROM r GROUP BY ROLLUP (section_type, standard)""")
def lost_samples_by_section_type(spark, sf):
    """Each project is one playing of a capture; frames are counted per (capture, frame) before the join."""
    placed = view(spark, sf, "fx_placed").select(
        "project_id", "section_no", "section_type", "standard", "start_frame", "first_frame", "n_frames", "pass_length"
    )
    frames = tl.expand_placed(placed).select("section_type", "standard", (F.col("project_id") % 15).alias("capture_id"), "frame_id")
    played = frames.groupBy("section_type", "standard", "capture_id", "frame_id").agg(F.count("*").alias("n"))
    lost = iv.merge_intervals(view(spark, sf, "fx_run")).groupBy("capture_id", "frame_id").agg(F.sum("sample_count").alias("lost"))
    joined = played.join(lost, ["capture_id", "frame_id"], "left")
    return joined.rollup("section_type", "standard").agg(
        F.grouping_id().cast("int").alias("level"), F.sum("n").alias("n_frames"),
        F.sum(F.when(F.col("lost").isNotNull(), F.col("n")).otherwise(0)).alias("n_hit"),
        F.sum(F.coalesce("lost", F.lit(0)) * F.col("n")).alias("lost"),
    )
