"""Classification metrics.

One shuffle does the heavy work: ``confusion = groupBy(true, pred).count()`` (partial
aggregation map-side, k*k rows out). Everything else is arithmetic on that small table, so
the cost is one pass over the scored rows whatever the number of rows.

Conventions (published definitions of the usual metric library; zero denominators give 0):
labels = union of true and predicted labels; macro = unweighted mean over those labels;
weighted = by true support; micro = pooled (= accuracy for single-label data); balanced
accuracy = mean recall over labels with true support; multiclass MCC and unweighted Cohen's
kappa from the confusion margins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import round4, safe_div
from .auc import auc_from_counts, ovo_from_counts, split_counts

OVERALL_COLUMNS = [
    "accuracy", "balanced_accuracy", "precision_macro", "precision_micro", "precision_weighted",
    "recall_macro", "recall_micro", "recall_weighted", "f1_macro", "f1_micro", "f1_weighted",
    "matthews_corrcoef", "cohen_kappa", "num_samples", "num_classes"]


def confusion_counts(df: DataFrame, true_col: str, pred_col: str) -> DataFrame:
    """H1: ``(true_label, pred_label, n)`` over rows with both labels present."""
    return (df.filter(F.col(true_col).isNotNull() & F.col(pred_col).isNotNull())
              .groupBy(F.col(true_col).cast("string").alias("true_label"),
                       F.col(pred_col).cast("string").alias("pred_label"))
              .agg(F.count(F.lit(1)).alias("n")))


def label_set(confusion: DataFrame) -> DataFrame:
    """Sorted union of true and predicted labels."""
    return confusion.select(F.col("true_label").alias("label")).union(
        confusion.select(F.col("pred_label").alias("label"))).distinct()


def confusion_matrix_dense(confusion: DataFrame) -> DataFrame:
    """Every (true, pred) pair of the label set, zero cells included."""
    labels = label_set(confusion)
    everyone = labels.agg(F.collect_set("label").alias("_all"))  # k labels, one row
    grid = everyone.select(F.explode("_all").alias("true_label"), "_all") \
        .select("true_label", F.explode("_all").alias("pred_label"))
    return grid.join(confusion, ["true_label", "pred_label"], "left") \
        .select("true_label", "pred_label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def per_class_metrics(confusion: DataFrame) -> DataFrame:
    """H7: precision, recall, f1, support (+ predicted count, tp) per label."""
    labels = label_set(confusion)
    support = confusion.groupBy(F.col("true_label").alias("label")).agg(F.sum("n").alias("support"))
    predicted = confusion.groupBy(F.col("pred_label").alias("label")).agg(F.sum("n").alias("predicted"))
    tp = confusion.filter(F.col("true_label") == F.col("pred_label")) \
        .select(F.col("true_label").alias("label"), F.col("n").alias("tp"))
    t = labels.join(support, "label", "left").join(predicted, "label", "left").join(tp, "label", "left")
    t = t.select("label", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("support", "predicted", "tp")])
    return t.select("label",
                    safe_div("tp", "predicted").alias("precision"),
                    safe_div("tp", "support").alias("recall"),
                    safe_div(F.col("tp") * 2, F.col("support") + F.col("predicted")).alias("f1_score"),
                    "support", "predicted", "tp")


def overall_metrics(confusion: DataFrame) -> DataFrame:
    """H2-H6, H8, H9, H12 (num_samples, num_classes): one row."""
    pc = per_class_metrics(confusion)
    sums = pc.agg(
        F.sum("support").alias("_n"), F.sum("tp").alias("_tp"), F.count(F.lit(1)).alias("num_classes"),
        F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"),
        F.avg("f1_score").alias("f1_macro"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.sum(F.col("precision") * F.col("support")).alias("_pw"),
        F.sum(F.col("recall") * F.col("support")).alias("_rw"),
        F.sum(F.col("f1_score") * F.col("support")).alias("_fw"),
        F.sum(F.col("predicted").cast("double") * F.col("support")).alias("_pt"),
        F.sum(F.col("predicted").cast("double") * F.col("predicted")).alias("_pp"),
        F.sum(F.col("support").cast("double") * F.col("support")).alias("_tt"))
    n = F.col("_n").cast("double")
    acc = safe_div("_tp", "_n")
    cov_ytyp = F.col("_tp") * n - F.col("_pt")
    cov_ypyp = n * n - F.col("_pp")
    cov_ytyt = n * n - F.col("_tt")
    mcc = F.when(cov_ypyp * cov_ytyt == 0, F.lit(0.0)).otherwise(cov_ytyp / F.sqrt(cov_ytyt * cov_ypyp))
    expected_disagree = (n * n - F.col("_pt")) / n
    kappa = F.when(expected_disagree == 0, F.lit(float("nan"))).otherwise(
        F.lit(1.0) - (n - F.col("_tp")) / expected_disagree)
    return sums.select(
        acc.alias("accuracy"),
        F.coalesce("balanced_accuracy", F.lit(0.0)).alias("balanced_accuracy"),
        "precision_macro", acc.alias("precision_micro"), safe_div("_pw", "_n").alias("precision_weighted"),
        "recall_macro", acc.alias("recall_micro"), safe_div("_rw", "_n").alias("recall_weighted"),
        "f1_macro", acc.alias("f1_micro"), safe_div("_fw", "_n").alias("f1_weighted"),
        mcc.alias("matthews_corrcoef"), kappa.alias("cohen_kappa"),
        F.col("_n").cast("long").alias("num_samples"), F.col("num_classes").cast("long"))


def class_distribution(confusion: DataFrame) -> DataFrame:
    """True-label counts."""
    return confusion.groupBy(F.col("true_label").alias("label")).agg(F.sum("n").alias("count"))


def classification_report(confusion: DataFrame, digits: int | None = None) -> DataFrame:
    """Per-label rows plus ``accuracy``, ``macro avg``, ``weighted avg`` rows."""
    pc = per_class_metrics(confusion).select("label", "precision", "recall", "f1_score", "support")
    o = overall_metrics(confusion)
    extra = o.select(
        F.explode(F.array(
            F.struct(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"), F.col("accuracy").alias("f1_score"),
                     F.col("num_samples").alias("support")),
            F.struct(F.lit("macro avg").alias("label"), F.col("precision_macro").alias("precision"),
                     F.col("recall_macro").alias("recall"), F.col("f1_macro").alias("f1_score"),
                     F.col("num_samples").alias("support")),
            F.struct(F.lit("weighted avg").alias("label"), F.col("precision_weighted").alias("precision"),
                     F.col("recall_weighted").alias("recall"), F.col("f1_weighted").alias("f1_score"),
                     F.col("num_samples").alias("support")))).alias("_r")).select("_r.*")
    rep = pc.unionByName(extra)
    if digits is not None:
        rep = rep.select("label", *[F.bround(c, digits).alias(c) for c in ("precision", "recall", "f1_score")],
                         "support")
    return rep


def metrics_long(overall: DataFrame, auc: DataFrame | None = None) -> DataFrame:
    """``(metric, averaging, value)``, e.g. ('precision', 'macro', 0.91); with ``auc`` (the row of
    ``roc_auc``) also ('roc_auc', 'ovr' or 'ovo'), where there is a value."""
    pairs = []
    for c in OVERALL_COLUMNS:
        if c in ("num_samples", "num_classes"):
            continue
        metric, _, avg = c.rpartition("_")
        if avg in ("macro", "micro", "weighted"):
            pairs.append((metric, avg, c))
        else:
            pairs.append((c, "none", c))

    def rows(df: DataFrame, items) -> DataFrame:
        arr = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(a).alias("averaging"),
                                 F.col(c).cast("double").alias("value")) for m, a, c in items])
        return df.select(F.explode(arr).alias("_m")).select("_m.*")

    out = rows(overall, pairs)
    if auc is not None:
        more = rows(auc, [("roc_auc", "ovr", "roc_auc_ovr"), ("roc_auc", "ovo", "roc_auc_ovo")])
        out = out.unionByName(more.filter(F.col("value").isNotNull()))
    return out


def get_metric(long: DataFrame, metric: str, averaging: str = "none") -> float:
    """One value of ``metrics_long``; an unknown name or averaging is an error."""
    rows = long.collect()  # a fixed handful of metrics
    for r in rows:
        if (r["metric"], r["averaging"]) == (metric, averaging):
            return r["value"]
    known = sorted({r["averaging"] for r in rows if r["metric"] == metric})
    raise ValueError(f"metric {metric!r} has no averaging {averaging!r}; it has: {', '.join(known)}" if known
                     else f"unknown metric {metric!r}; known: {', '.join(sorted({r['metric'] for r in rows}))}")


def metrics_json(long: DataFrame, round_digits: int | None = None) -> DataFrame:
    """The metrics as nested JSON text, ``{metric: {averaging: value}}`` (one row)."""
    v = F.col("value") if round_digits is None else F.round("value", round_digits)
    per = long.groupBy("metric").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("averaging", v.alias("v"))))).alias("m"))
    return per.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("metric", "m")))).alias("json"))


def probability_row_check(scored: DataFrame) -> DataFrame:
    """One row: the largest distance of a row's probabilities from a sum of 1, and the least number of
    them (computed inside each row)."""
    total = F.aggregate("probs", F.lit(0.0), lambda a, b: a + b)
    return scored.agg(F.max(F.abs(total - 1.0)).alias("_dev"), F.min(F.size("probs")).alias("_cmin"))


def roc_auc(scored_long: DataFrame, confusion: DataFrame, true_labels: DataFrame,
            true_col: str = "true_label", row_check: DataFrame | None = None) -> DataFrame:
    """One row ``roc_auc_ovr``, ``roc_auc_ovo`` following the reference's rules.

    * more than 2 classes: macro OVR and macro OVO (Hand & Till);
    * exactly 2: binary AUC with the second sorted label positive, OVO null;
    * null when a true label lacks a probability, when a label is only ever predicted (the
      probability matrix then has too few columns), or when rows do not sum to 1.

    All three AUCs come from one written table of counts per (label, true label, score). The number
    of classes is known from two small jobs first, so only the branch that applies is planned;
    ``row_check`` (``probability_row_check``) saves regrouping the long rows by id.
    """
    from ..session import write_table
    spark = scored_long.sparkSession
    labels = [r[0] for r in true_labels.orderBy("label").collect()]  # the class list of the model
    nothing = spark.range(1).select(F.lit(None).cast("double").alias("roc_auc_ovr"), F.lit(None).cast("double").alias("roc_auc_ovo"))
    if len(labels) < 2 or label_set(confusion).count() != len(labels):
        return nothing
    have = scored_long.filter(F.col("label").isin(labels))
    if row_check is None:
        sums = have.groupBy("id").agg(F.sum("prob").alias("_s"), F.count(F.lit(1)).alias("_c"))
        row_check = sums.agg(F.max(F.abs(F.col("_s") - 1.0)).alias("_dev"), F.min("_c").alias("_cmin"))
    check = row_check.first()
    if check["_dev"] is None or check["_dev"] > 1e-5 + 1e-8 or check["_cmin"] < len(labels):
        return nothing
    counts = write_table(have.groupBy("label", F.col(true_col).alias("true_label"), F.col("prob").cast("double").alias("score"))
                         .agg(F.count(F.lit(1)).alias("n")), "score_counts")
    if len(labels) == 2:
        one = counts.filter(F.col("label") == labels[1]).withColumn("_g", F.lit(0))
        ovr = auc_from_counts(split_counts(one, ["_g"]), ["_g"])
        return ovr.select(F.col("auc").cast("double").alias("roc_auc_ovr"), F.lit(None).cast("double").alias("roc_auc_ovo"))
    ovr = auc_from_counts(split_counts(counts, ["label"]), ["label"]).agg(
        F.avg("auc").alias("_v"), F.count("auc").alias("_n"))
    ovo = ovo_from_counts(counts, labels).agg(F.avg("auc").alias("_w"), F.count("auc").alias("_m"))
    n_pairs = len(labels) * (len(labels) - 1) // 2
    return ovr.crossJoin(ovo).select(  # one row each
        F.when(F.col("_n") == len(labels), F.col("_v")).cast("double").alias("roc_auc_ovr"),
        F.when(F.col("_m") == n_pairs, F.col("_w")).cast("double").alias("roc_auc_ovo"))


def misclassified(df: DataFrame, true_col: str, pred_col: str = "predicted_label",
                  confidence_col: str = "confidence", text_col: str | None = None,
                  top_n: int | None = None, order_key: str | None = None) -> DataFrame:
    """Rows where true != pred (null true counts as misclassified), projected
    ``[text], true, pred, confidence`` and ordered by confidence, highest first."""
    mis = df.filter(~F.col(true_col).eqNullSafe(F.col(pred_col)) | F.col(true_col).isNull()
                    | F.col(pred_col).isNull())
    cols = [true_col, pred_col, confidence_col]
    if text_col and text_col in df.columns:
        cols.insert(0, text_col)
    if order_key:
        cols.insert(0, order_key)
    out = mis.select(*cols)
    order = [F.desc(confidence_col)] + ([F.asc(order_key)] if order_key else [])
    out = out.orderBy(*order)
    return out.limit(top_n) if top_n is not None else out


def confidence_calibration(df: DataFrame, true_col: str, pred_col: str = "predicted_label",
                           confidence_col: str = "confidence", bins: int = 10) -> DataFrame:
    """Equal-width bins over the observed [min, max] (right-closed, the left edge
    lowered by 0.1% of the range; a constant value widens both ends by 0.1% of |value|,
    0.001 at 0); per non-empty bin: count, correct, accuracy, mean confidence (4 places)."""
    x = F.col(confidence_col).cast("double")
    base = df.filter(x.isNotNull() & ~F.isnan(x)).select(
        x.alias("_x"), F.coalesce(F.col(true_col) == F.col(pred_col), F.lit(False)).cast("int").alias("_ok"))
    mm = base.agg(F.min("_x").alias("_mn"), F.max("_x").alias("_mx"))
    same = F.col("_mn") == F.col("_mx")
    pad_lo = F.when(F.col("_mn") != 0, F.abs(F.col("_mn")) * 0.001).otherwise(F.lit(0.001))
    pad_hi = F.when(F.col("_mx") != 0, F.abs(F.col("_mx")) * 0.001).otherwise(F.lit(0.001))
    lo = F.when(same, F.col("_mn") - pad_lo).otherwise(F.col("_mn"))
    hi = F.when(same, F.col("_mx") + pad_hi).otherwise(F.col("_mx"))
    mm = mm.select(lo.alias("_lo"), hi.alias("_hi"), same.alias("_same"))
    step = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    adj = (F.col("_hi") - F.col("_lo")) * 0.001
    edges = F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: F.when(
        i == bins, F.col("_hi")).when((i == 0) & ~F.col("_same"), F.col("_lo") - adj).otherwise(
        i.cast("double") * step + F.col("_lo")))
    mm = mm.select(edges.alias("_edges"))
    binned = base.crossJoin(F.broadcast(mm)).withColumn(
        "confidence_bin", F.size(F.filter("_edges", lambda e: e < F.col("_x"))) - 1)
    g = binned.groupBy("confidence_bin").agg(
        F.first(F.col("_edges")[F.col("confidence_bin")]).alias("bin_lower"),
        F.first(F.col("_edges")[F.col("confidence_bin") + 1]).alias("bin_upper"),
        F.count(F.lit(1)).alias("total_samples"),
        F.sum("_ok").cast("long").alias("correct_predictions"),
        F.avg("_ok").alias("_acc"), F.avg("_x").alias("_conf"))
    return g.select("confidence_bin", "bin_lower", "bin_upper", "total_samples", "correct_predictions",
                    round4("_acc").alias("accuracy"), round4("_conf").alias("avg_confidence"))
