"""Window scoring per case (M1-M5): isolation forest, normalisation, dual gate."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions import predicates as P
from tracemill.operators.features import window_start
from tracemill.operators.ranking import first_or_all
from tracemill.operators.slices import top_k_per_group
from tracemill.schema import FEATURE_NAMES, AnomalyParams
from tracemill.session import reliable_checkpoint, small_side

_TREE = "case_id string, tree int, n int, feature array<int>, cut array<double>, child array<int>, size array<int>"


def _path_norm(n: float) -> float:
    """Mean unsuccessful-search depth of a binary tree over n points."""
    if n <= 1:
        return 0.0
    if n <= 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _grow(x: np.ndarray, limit: int, rng: np.random.Generator, nodes: list) -> None:
    """Append one tree to ``nodes`` in breadth-first order; children are adjacent."""
    queue = [(len(nodes), x, 0)]
    nodes.append(None)
    while queue:
        at, rows, depth = queue.pop(0)
        spread = rows.max(axis=0) - rows.min(axis=0) if len(rows) > 1 else np.zeros(rows.shape[1])
        usable = np.flatnonzero(spread)
        if depth >= limit or usable.size == 0:
            nodes[at] = (-1, 0.0, -1, len(rows))
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
        go_left = rows[:, f] <= cut
        child = len(nodes)
        nodes[at] = (f, cut, child, len(rows))
        nodes += [None, None]
        queue += [(child, rows[go_left], depth + 1), (child + 1, rows[~go_left], depth + 1)]


def fit_forests(windows: DataFrame, p: AnomalyParams = AnomalyParams()) -> DataFrame:
    """One forest per case; every tree has its own sample of ``max_samples`` of all the case's windows.

    A tree takes the windows with the smallest draws. A draw far above the
    expected one of the last window taken is left out before the shuffle.
    Trees grow one per group, and a case gathers its ``n_estimators`` trees.
    """
    cols = list(FEATURE_NAMES)
    per_case = windows.groupBy("case_id").agg(F.count("*").alias("_n"))
    span = 1 << 52
    draw = lambda t: F.pmod(F.xxhash64("case_id", "window_start", t, F.lit(p.seed)), F.lit(span))
    near = F.lit(2.0 * p.max_samples + 64) / F.col("_n") * span
    trees = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(p.n_estimators - 1)), lambda t: F.struct(t.alias("tree"), draw(t).alias("draw"))),
        lambda d: d["draw"] < near)
    drawn = windows.select("case_id", "window_start", *cols).join(per_case, "case_id").withColumn("_d", F.explode(trees)).select(
        "case_id", "window_start", *cols, "_d.tree", "_d.draw")
    samples = top_k_per_group(drawn, ["case_id", "tree"], [F.asc("draw"), F.asc("window_start")], p.max_samples)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["draw", "window_start"])
        x = pdf[cols].to_numpy(dtype=np.float64)
        case, tree = str(pdf["case_id"].iloc[0]), int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([p.seed, zlib.crc32(case.encode()), tree])
        nodes: list = []
        _grow(x, math.ceil(math.log2(max(len(x), 2))), rng, nodes)
        feature, cut, child, size = (list(c) for c in zip(*nodes))
        return pd.DataFrame(
            [[case, tree, len(x), feature, cut, child, size]],
            columns=["case_id", "tree", "n", "feature", "cut", "child", "size"],
        )

    return samples.groupBy("case_id", "tree").applyInPandas(fit, _TREE).groupBy("case_id").agg(
        F.max("n").alias("n"),
        F.sort_array(F.collect_list(F.struct("tree", "feature", "cut", "child", "size"))).alias("trees"))


def raw_scores(windows: DataFrame, forests: DataFrame, p: AnomalyParams = AnomalyParams()) -> DataFrame:
    """``raw_score`` per window (higher is more normal).

    A task scores one month of one case (at most 8,928 five-minute windows)
    against the case's forest.
    """
    cols = list(FEATURE_NAMES)
    month = F.substring(P.stamp("window_start"), 1, 7)
    rows = windows.select("case_id", "window_start", month.alias("month"), *cols)
    months = windows.select(
        F.col("case_id").alias("slab_case"), month.alias("slab_month")
    ).distinct()
    spread = forests.join(months, forests["case_id"] == months["slab_case"]).drop("case_id")

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        x = left[cols].to_numpy(dtype=np.float64)
        f = right.iloc[0]
        total = np.zeros(len(x))
        for tree in f["trees"]:
            feature, cut, child, size = (np.asarray(tree[k]) for k in ("feature", "cut", "child", "size"))
            leaf_depth = np.array([_path_norm(k) for k in range(int(size.max()) + 1)])
            at = np.zeros(len(x), int)
            depth = np.zeros(len(x))
            live = feature[at] >= 0
            while live.any():
                node = at[live]
                at[live] = child[node] + (x[live, feature[node]] > cut[node])
                depth[live] += 1
                live = feature[at] >= 0
            total += depth + leaf_depth[size[at]]
        mean = total / len(f["trees"])
        raw = -np.power(2.0, -mean / max(_path_norm(int(f["n"])), 1.0))
        return pd.DataFrame(
            {"case_id": left["case_id"], "window_start": left["window_start"], "raw_score": raw}
        )

    scored = (
        rows.groupBy("case_id", "month")
        .cogroup(spread.groupBy("slab_case", "slab_month"))
        .applyInPandas(score, "case_id string, window_start timestamp_ntz, raw_score double")
    )
    return windows.join(scored, ["case_id", "window_start"])


def gate(windows: DataFrame, p: AnomalyParams = AnomalyParams()) -> DataFrame:
    """M2-M4: min-max score, dual gate and abstention per case.

    Case statistics are a mergeable aggregate joined back, not a window over
    the whole case.
    """
    inverted = -F.col("raw_score")
    stats = windows.groupBy("case_id").agg(
        F.count("*").alias("windows_total"),
        F.min(inverted).alias("lo"), F.max(inverted).alias("hi"),
        F.avg("raw_score").alias("mean"), F.stddev_pop("raw_score").alias("std"),
    )
    abstained = F.col("windows_total") < p.min_windows
    spread = F.col("hi") - F.col("lo")
    score = F.when(spread > 0, (inverted - F.col("lo")) / spread).otherwise(F.lit(0.0))
    flagged = (F.col("score") >= p.threshold) & (
        F.col("raw_score") < F.col("mean") - F.lit(p.z_sigmas) * F.col("std")
    )
    return (
        windows.join(stats, "case_id")
        .withColumn("abstained", abstained)
        .withColumn("score", F.when(~abstained, score))
        .withColumn("flagged", ~abstained & F.coalesce(flagged, F.lit(False)))
        .drop("lo", "hi", "mean", "std")
    )


def abstain_reason(p: AnomalyParams = AnomalyParams()):
    return F.concat(
        F.col("windows_total").cast("string"),
        F.lit(f" event window(s) available; at least {p.min_windows} are required for a meaningful "
              "ML comparison. Anomaly detection abstained and no ML finding was created for this run."),
    )


def score_windows(windows: DataFrame, p: AnomalyParams = AnomalyParams()) -> DataFrame:
    """M1-M4 for all cases. The windows are read four times, so they are cut off first."""
    windows = reliable_checkpoint(windows)
    return gate(raw_scores(windows, fit_forests(windows, p), p), p)


def annotate_events(events: DataFrame, scored: DataFrame, p: AnomalyParams = AnomalyParams()) -> DataFrame:
    """``anomaly_score`` and ``is_anomalous`` of each event's window; events are not shuffled while the windows are few."""
    marks = small_side(scored.select(
        "case_id", "window_start", F.round("score", 6).alias("anomaly_score"),
        F.col("flagged").alias("is_anomalous"),
    ))
    return (
        events.withColumn("window_start", window_start(F.col("timestamp"), p.window_minutes))
        .join(marks, ["case_id", "window_start"], "left")
        .withColumn("is_anomalous", F.coalesce("is_anomalous", F.lit(False)))
        .drop("window_start")
    )


def ml_windows(scored: DataFrame, p: AnomalyParams = AnomalyParams()) -> DataFrame:
    """The first flagged windows of every case (all where the limit is None), with severity and title."""
    top = first_or_all(
        scored.filter("flagged"), ["case_id"], [F.asc("window_start")], p.max_findings,
        rank="ml_rank",
    )
    return top.withColumns(
        {
            "severity": F.when(F.col("score") >= p.high_score, "High").otherwise("Medium"),
            "title": F.concat(
                F.lit("Anomalous activity window "), P.clock("window_start"), F.lit("–"), P.clock("window_end")
            ),
            "explanation": F.concat(
                F.lit("Window "), F.substring(P.stamp("window_start"), 1, 16), F.lit("–"),
                P.clock("window_end"), F.lit(" has an anomaly score of "), F.format_string("%.3f", "score"),
                F.lit(f" against a detection threshold of {p.threshold:.2f}; the raw model score also "
                      f"sits below the case reference gate (mean - {p.z_sigmas:g}·std)."),
            ),
        }
    )


def ml_window_events(events: DataFrame, flagged: DataFrame, p: AnomalyParams = AnomalyParams()) -> DataFrame:
    """Events inside the flagged windows, long form."""
    rows = events.select(
        "case_id", "id", "event_uid", "evidence_id", "timestamp",
        window_start(F.col("timestamp"), p.window_minutes).alias("window_start"),
    )
    return rows.join(small_side(flagged.select("case_id", "window_start", "ml_rank")), ["case_id", "window_start"])

