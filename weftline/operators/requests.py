"""Edge-block requests [start_vertex.start_edge, end_vertex.end_edge) as ranges of the edge order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class RejectedRequest(ValueError):
    """A request that starts behind its end or beyond the last vertex."""


def edge_range(offset_of, vertices: int, sv: int, se: int, ev: int | None, ee: int | None) -> tuple[int, int]:
    """[lo, hi) of a request; ``offset_of`` gives the offset of a vertex, None stands for the end."""
    ev = vertices if ev is None else ev
    ee = 0 if ee is None else ee
    if sv > ev or (sv == ev and se > ee):
        raise RejectedRequest(f"{sv}.{se} lies behind {ev}.{ee}")
    if sv >= vertices:
        raise RejectedRequest(f"vertex {sv} is beyond the last one")
    at = lambda v, e: offset_of(v) + min(e, offset_of(v + 1) - offset_of(v))
    lo, hi = at(sv, se), offset_of(vertices) if ev >= vertices else at(ev, ee)
    return lo, max(lo, hi)


def normalise(requests: DataFrame, offset_rows: DataFrame, vertices: int | Column) -> DataFrame:
    """Many requests (id, sv, se, ev, ee; -1 for the end) at once: adds status, lo and hi.

    status: ``ok``, ``empty`` or ``rejected``; lo and hi are null for rejected requests.
    """
    v = vertices if isinstance(vertices, Column) else F.lit(vertices)
    row = offset_rows.select(F.col("v").alias("_v"), F.col("offset").alias("_o"))
    following = row.select((F.col("_v") - 1).alias("_v"), F.col("_o").alias("_next"))
    spans = row.join(following, "_v", "left").select("_v", "_o", F.coalesce(F.col("_next") - F.col("_o"), F.lit(0)).alias("_d"))
    to_end = (F.col("ev") < 0) | (F.col("ev") >= v)
    ask = requests.withColumn("_ev", F.when(to_end, v).otherwise(F.col("ev"))).withColumn("_ee", F.when(to_end, F.lit(0)).when(F.col("ee") < 0, F.lit((1 << 62))).otherwise(F.col("ee")))
    reject = (F.col("sv") >= v) | (~(F.col("ev") < 0) & ((F.col("sv") > F.col("ev")) | ((F.col("sv") == F.col("ev")) & (F.col("ee") >= 0) & (F.col("se") > F.col("ee")))))
    a, b = (spans.select(F.col("_v").alias(k), F.col("_o").alias(f"{k}o"), F.col("_d").alias(f"{k}d")) for k in ("_a", "_b"))
    both = ask.join(a, ask["sv"] == a["_a"], "left").join(b, F.col("_ev") == b["_b"], "left")
    lo = F.col("_ao") + F.least("se", "_ad")
    hi = F.greatest(lo, F.col("_bo") + F.least("_ee", "_bd"))
    status = F.when(reject, "rejected").when(lo >= hi, "empty").otherwise("ok")
    return both.select(*requests.columns, status.alias("status"), F.when(~reject, lo).cast("long").alias("lo"), F.when(~reject, hi).cast("long").alias("hi"))
