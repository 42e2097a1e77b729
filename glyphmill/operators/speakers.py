"""Which lines of a frame name a speaker, from many weak signs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions import gates, labels
from glyphmill.functions.scripts import text_or_empty
from glyphmill.functions.text import casefold

#: Score from which a line names a speaker.
THRESHOLD = 2.2


def score(lines: DataFrame, frame: list[str], order: str, known: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``score`` to lines (text, box, kind, stable_passes) that have a box.

    Points for the role, for speech below in the same column, for a compact
    box, for repeats in the frame, a known name, stability and kind; short
    texts and lines far from speech are damped. A line of speech has 0. Lines
    meet speech of their own frame only.
    """
    t = F.trim(text_or_empty(F.col("text")))
    told = lines.withColumns({"_t": t, "_role": labels.role(F.col("kind"), F.col("text"), F.col("box")), "_speech": gates.is_spoken_line(F.col("text")), "_h": F.greatest(F.lit(1), F.col("box.y2") - F.col("box.y1")), "_w": F.greatest(F.lit(1), F.col("box.x2") - F.col("box.x1"))})
    speech = told.where("_speech OR _role = 'dialogue'").select(*frame, F.col(order).alias("_po"), F.col("box").alias("_pb"))
    near = told.select(*frame, order, "box", "_h").join(speech, frame).where("_pb.y1 >= box.y2 - 2 AND _pb.y1 - box.y2 <= greatest(48, _h * 3) AND least(box.x2, _pb.x2) - greatest(box.x1, _pb.x1) > 0")
    below = near.groupBy(order).agg(F.min_by(F.expr("_pb.y1 - box.y2"), "_po").alias("_gap"))
    told = told.join(below, order, "left").withColumn("_repeats", F.count("*").over(Window.partitionBy(*frame, casefold(F.col("_t")))) - 1)
    under = F.col("_gap").isNotNull()
    points = lambda test, p: F.when(F.coalesce(test, F.lit(False)), F.lit(float(p))).otherwise(0.0)
    total: Column = points(F.col("_role") == "speaker", 2.5) + points(under, 2.2) + points(F.col("_gap") <= F.greatest(F.lit(12), F.col("_h")), 0.6)
    total = total + points((F.col("_h") <= 32) & (F.col("_w") <= 280), 0.7) + points(F.col("_h").between(10, 28), 0.4) + F.least(F.lit(1.2), 0.4 * F.col("_repeats"))
    if known:
        total = total + points(casefold(F.col("_t")).isin(*(k.casefold() for k in known)), 1.5)
    total = total + points(F.col("stable_passes") >= 3, 0.3) + points(F.lower(F.trim(F.col("kind"))).isin("name", "speaker", "chip"), 1.0)
    short = (F.regexp_count("_t", F.lit(r"\S+")) == 1) | (F.length("_t") < 12)
    told = told.withColumn("_p", total)
    told = told.withColumn("_p", F.when(short & (F.col("_p") < 2.0), F.col("_p") * 0.35).otherwise(F.col("_p")))
    damped = F.when(F.col("_role") == "dialogue", 0.0).when(~under & (F.col("_role") != "speaker") & (F.col("_p") < 2.5), F.col("_p") * 0.5).otherwise(F.col("_p"))
    return told.withColumn("score", damped).drop("_t", "_role", "_speech", "_h", "_w", "_gap", "_repeats", "_p")


def detect(scored: DataFrame, frame: list[str], order: str, threshold: float = THRESHOLD) -> DataFrame:
    """The lines from the threshold on, with their ``place`` in the frame, the highest score first."""
    best = Window.partitionBy(*frame).orderBy(F.desc("score"), order)
    return scored.where(F.col("score") >= threshold).withColumn("place", F.row_number().over(best))
