"""Registered curation queries (sources, projections, filters, aggregations, set ops)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import hash_half, iso_timestamp, prob_column_expr, report_key, round4
from ..operators import curate as C
from ..operators import labels as L
from ..sources.tables import read_table, scan_articles, scan_texts
from .registry import register, rounded

# Fixed values of the test binding: three of the five priorities play the kept categories,
# 1996 is the filter year (the reference keeps five news categories and one year).
ARTICLE_LABELS = ["1-URGENT", "2-HIGH", "5-LOW"]
ARTICLE_YEAR = 1996
SEED = 42

ARTICLES_SQL = ("SELECT o_orderkey AS article_id, o_orderpriority AS category, o_orderdate AS date, "
                "o_orderstatus AS status, o_totalprice AS amount FROM orders")
LABELS_SQL = "('1-URGENT', '2-HIGH', '5-LOW')"
KEPT_SQL = f"SELECT *, CAST(year(date) AS INTEGER) AS year FROM ({ARTICLES_SQL}) a WHERE category IN {LABELS_SQL}"
ALL_SQL = f"SELECT *, CAST(year(date) AS INTEGER) AS year FROM ({ARTICLES_SQL}) a"
TEXTS_SQL = ("SELECT doc_id, lang AS category, split_part(text, chr(10), 1) AS headline, "
             "CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) END "
             "AS short_description, text, source, n_chars FROM documents")


def kept_articles(spark, sf):
    """Label-filtered articles with their year (the curated pool of the reference)."""
    return C.extract_year(C.label_filter(scan_articles(spark, sf), ARTICLE_LABELS))


def all_articles(spark, sf):
    """Every article with its year."""
    return C.extract_year(scan_articles(spark, sf))


def year_articles(spark, sf):
    return C.year_filter(kept_articles(spark, sf), ARTICLE_YEAR)


@register("scan_articles", f"SELECT * FROM ({ARTICLES_SQL}) a")
def q_scan_articles(spark, sf):
    return rounded(scan_articles(spark, sf))


@register("label_filter", f"SELECT article_id, category FROM ({ARTICLES_SQL}) a WHERE category IN {LABELS_SQL}")
def q_label_filter(spark, sf):
    return C.label_filter(scan_articles(spark, sf), ARTICLE_LABELS).select("article_id", "category")


@register("parse_date", "SELECT o_orderkey AS article_id, "
          "CAST(strptime(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) AS date "
          "FROM orders")
def q_parse_date(spark, sf):
    a = scan_articles(spark, sf).select(
        "article_id", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"))
    out = C.parse_date(a, "date", "yyyy-MM-dd HH:mm:ss")
    return out.withColumn("date", F.col("date").cast("timestamp_ntz"))


@register("extract_year", f"SELECT article_id, CAST(year(date) AS INTEGER) AS year FROM ({ARTICLES_SQL}) a")
def q_extract_year(spark, sf):
    return C.extract_year(scan_articles(spark, sf)).select("article_id", "year")


@register("year_filter", f"SELECT article_id, category, date FROM ({KEPT_SQL}) k WHERE year = {ARTICLE_YEAR}")
def q_year_filter(spark, sf):
    return year_articles(spark, sf).select("article_id", "category", "date")


@register("stable_row_id", "SELECT article_id, CAST(row_number() OVER (ORDER BY article_id) - 1 AS BIGINT) AS row_id "
          f"FROM ({ALL_SQL}) k")
def q_stable_row_id(spark, sf):
    return C.stable_row_id(all_articles(spark, sf).select("article_id"), "article_id")


@register("compose_text", "SELECT doc_id, headline || ' ' || coalesce(short_description, '') AS text "
          f"FROM ({TEXTS_SQL}) t")
def q_compose_text(spark, sf):
    t = scan_texts(spark, sf).drop("text")
    return C.compose_text(t).select("doc_id", "text")


@register("encode_label", "SELECT article_id, category, CAST(CASE category WHEN '1-URGENT' THEN 0 "
          "WHEN '2-HIGH' THEN 1 WHEN '5-LOW' THEN 2 END AS INTEGER) AS label "
          f"FROM ({ARTICLES_SQL}) a")
def q_encode_label(spark, sf):
    dim = L.label_dimension_from_list(spark, ARTICLE_LABELS)
    return L.encode_label(scan_articles(spark, sf).select("article_id", "category"), dim)


@register("decode_label", "SELECT article_id, CAST(CASE category WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 "
          "WHEN '5-LOW' THEN 2 END AS INTEGER) AS label, CASE WHEN category IN "
          f"{LABELS_SQL} THEN category END AS predicted_category FROM ({ARTICLES_SQL}) a")
def q_decode_label(spark, sf):
    dim = L.label_dimension_from_list(spark, ARTICLE_LABELS)
    enc = L.encode_label(scan_articles(spark, sf).select("article_id", "category"), dim)
    return L.decode_label(enc.drop("category"), dim, "label", "predicted_category")


@register("label_lookup_join", "WITH dim AS (SELECT CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS label_id, "
          "lang AS label FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) d) "
          "SELECT doc_id, lang, label_id FROM documents LEFT JOIN dim ON documents.lang = dim.label")
def q_label_lookup_join(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "lang")
    dim = L.label_dimension_from_data(docs, "lang")
    return L.encode_label(docs, dim, "lang", "label_id")


@register("label_dimension", "SELECT CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS label_id, lang AS label, "
          "'prob_' || replace(replace(lang, ' ', '_'), '&', 'and') AS prob_column "
          "FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) d")
def q_label_dimension(spark, sf):
    """The label table persisted as JSON and read back (keys are strings in JSON)."""
    from ..session import shared_path
    docs = read_table(spark, sf, "documents").select("lang")
    dim = L.label_dimension_from_data(docs, "lang")
    path = L.write_label_mappings(dim, shared_path(spark, "label_mappings"))
    back = L.read_label_mappings(spark, path)
    return back.withColumn("prob_column", prob_column_expr(F.col("label")))


@register("project_columns", "SELECT text, doc_id, lang FROM documents")
def q_project_columns(spark, sf):
    return C.project_columns(read_table(spark, sf, "documents"), ["doc_id", "lang"], text_column="text")


@register("drop_null_text", f"SELECT doc_id, n_chars FROM ({TEXTS_SQL}) t WHERE short_description IS NOT NULL")
def q_drop_null_text(spark, sf):
    return C.drop_null_text(scan_texts(spark, sf), "short_description").select("doc_id", "n_chars")


@register("drop_null_text_report", f"SELECT count(*) AS rows_in, count(short_description) AS rows_kept, "
          f"count(*) - count(short_description) AS rows_dropped FROM ({TEXTS_SQL}) t")
def q_drop_null_text_report(spark, sf):
    t = scan_texts(spark, sf)
    return t.agg(F.count(F.lit(1)).alias("rows_in"), F.count("short_description").alias("rows_kept")) \
            .withColumn("rows_dropped", F.col("rows_in") - F.col("rows_kept"))


@register("text_as_string", f"SELECT doc_id, coalesce(short_description, 'None') AS description FROM ({TEXTS_SQL}) t")
def q_text_as_string(spark, sf):
    return C.text_as_string(scan_texts(spark, sf), "short_description", "description").select("doc_id", "description")


@register("prob_column_name", f"SELECT DISTINCT category, 'prob_' || replace(replace(category, ' ', '_'), '&', 'and') "
          f"AS prob_column FROM ({ARTICLES_SQL}) a")
def q_prob_column_name(spark, sf):
    a = scan_articles(spark, sf).select("category").distinct()
    return a.withColumn("prob_column", prob_column_expr(F.col("category")))


@register("selection_state_init", f"SELECT article_id, category, false AS selected, CAST(-1 AS INTEGER) AS iteration "
          f"FROM ({ALL_SQL}) k")
def q_selection_state_init(spark, sf):
    return C.selection_state_init(all_articles(spark, sf).select("article_id", "category"))


@register("default_description", f"SELECT doc_id, short_description AS description, '' AS missing_description "
          f"FROM ({TEXTS_SQL}) t")
def q_default_description(spark, sf):
    t = scan_texts(spark, sf).select("doc_id", "short_description")
    present = C.default_description(t, "short_description", "description")
    return C.default_description(present, "no_such_column", "missing_description").drop("short_description")


@register("round4", "SELECT year, category, count, round_even(share, 4) AS share FROM ("
          "SELECT year, category, count(*) AS count, count(*) / sum(count(*)) OVER (PARTITION BY year) AS share "
          f"FROM ({ALL_SQL}) k GROUP BY year, category) s")
def q_round4(spark, sf):
    s = C.category_shares(all_articles(spark, sf), "category", "year")
    return s.withColumn("share", round4("share"))


@register("iso_timestamp", f"SELECT article_id, strftime(date, '%Y-%m-%dT%H:%M:%S.%f') AS date_iso FROM ({ARTICLES_SQL}) a")
def q_iso_timestamp(spark, sf):
    return scan_articles(spark, sf).select("article_id", iso_timestamp("date").alias("date_iso"))


@register("report_key", "SELECT event_type, CAST(ts AS DATE) AS day, 'domain_classifier_batch_' || event_type || '_' || "
          "strftime(min(ts), '%Y%m%d_%H%M%S') AS report_key FROM events GROUP BY event_type, CAST(ts AS DATE)")
def q_report_key(spark, sf):
    e = read_table(spark, sf, "events")
    g = e.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.min("ts").alias("start"))
    return g.select("event_type", "day", report_key(F.lit("domain_classifier"),
                                                    F.concat(F.lit("batch_"), F.col("event_type")),
                                                    F.col("start")).alias("report_key"))


@register("category_counts", f"SELECT category, count(*) AS count FROM ({ALL_SQL}) k GROUP BY category")
def q_category_counts(spark, sf):
    return C.category_counts(all_articles(spark, sf))


@register("category_shares", "SELECT year, category, count(*) AS count, count(*) / sum(count(*)) OVER (PARTITION BY year) "
          f"AS share FROM ({ALL_SQL}) k GROUP BY year, category")
def q_category_shares(spark, sf):
    return rounded(C.category_shares(all_articles(spark, sf)))


@register("year_distribution", f"SELECT year, count(*) AS count FROM ({ALL_SQL}) k GROUP BY year")
def q_year_distribution(spark, sf):
    return C.year_distribution(all_articles(spark, sf))


@register("category_by_year", f"SELECT CAST(year(date) AS INTEGER) AS year, category, count(*) AS count "
          f"FROM ({ARTICLES_SQL}) a GROUP BY 1, 2")
def q_category_by_year(spark, sf):
    return C.category_by_year(C.extract_year(scan_articles(spark, sf)))


@register("category_by_year_wide", "SELECT CAST(year(date) AS INTEGER) AS year, "
          "count(*) FILTER (WHERE category = '1-URGENT') AS \"1-URGENT\", "
          "count(*) FILTER (WHERE category = '2-HIGH') AS \"2-HIGH\", "
          "count(*) FILTER (WHERE category = '3-MEDIUM') AS \"3-MEDIUM\", "
          "count(*) FILTER (WHERE category = '4-NOT SPECIFIED') AS \"4-NOT SPECIFIED\", "
          "count(*) FILTER (WHERE category = '5-LOW') AS \"5-LOW\" "
          f"FROM ({ARTICLES_SQL}) a GROUP BY 1")
def q_category_by_year_wide(spark, sf):
    wide = C.category_by_year(C.extract_year(scan_articles(spark, sf)), wide=True)
    return wide.fillna(0)


@register("row_counts", "SELECT count(*) AS rows_in, count(*) FILTER (WHERE category IN " + LABELS_SQL +
          ") AS after_label_filter, count(*) FILTER (WHERE category IN " + LABELS_SQL +
          f" AND year(date) = {ARTICLE_YEAR}) AS after_year_filter FROM ({ARTICLES_SQL}) a")
def q_row_counts(spark, sf):
    a = scan_articles(spark, sf)
    kept = F.col("category").isin(ARTICLE_LABELS)
    return C.row_counts(a, {"after_label_filter": kept,
                            "after_year_filter": kept & (F.year("date") == ARTICLE_YEAR)})


@register("scarce_categories", "SELECT source || '/' || lang AS category, count(*) AS count FROM documents "
          "GROUP BY 1 HAVING count(*) < 16")
def q_scarce_categories(spark, sf):
    d = read_table(spark, sf, "documents").select(F.concat_ws("/", "source", "lang").alias("category"))
    return C.scarce_categories(d, "category", 0.2, 0.1)


@register("class_weights", "WITH c AS (SELECT lang AS label, count(*) AS count FROM documents "
          "WHERE substr(md5('42:train:' || doc_id), 1, 1) < '8' AND lang IS NOT NULL GROUP BY lang) "
          "SELECT label, count, (SELECT sum(count) FROM c) / ((SELECT count(*) FROM c) * count) AS weight FROM c")
def q_class_weights(spark, sf):
    d = read_table(spark, sf, "documents").filter(hash_half(SEED, "train", "doc_id"))
    return rounded(C.class_weights(d.select(F.col("lang").alias("label")), "label"))


@register("top_categories", "SELECT o_orderpriority AS category, count(*) AS count FROM orders "
          "GROUP BY 1 ORDER BY count DESC, category LIMIT 10")
def q_top_categories(spark, sf):
    return C.top_categories(scan_articles(spark, sf), 10)


@register("preview_rows", f"SELECT article_id, category, date FROM ({ALL_SQL}) k ORDER BY article_id LIMIT 5")
def q_preview_rows(spark, sf):
    return C.preview_rows(all_articles(spark, sf).select("article_id", "category", "date"), 5, "article_id")


@register("distinct_labels", "SELECT DISTINCT lang AS label FROM documents WHERE lang IS NOT NULL")
def q_distinct_labels(spark, sf):
    return C.distinct_labels(read_table(spark, sf, "documents"), "lang")


@register("missing_categories", "SELECT DISTINCT o_orderpriority AS category FROM orders WHERE o_orderpriority NOT IN "
          f"(SELECT category FROM ({KEPT_SQL}) k)")
def q_missing_categories(spark, sf):
    expected = scan_articles(spark, sf).select("category").distinct()
    return C.missing_categories(kept_articles(spark, sf), expected)


@register("tag_ref_current", "SELECT doc_id, CASE WHEN lang = 'en' THEN 'ref' ELSE 'cur' END AS side, text "
          "FROM documents")
def q_tag_ref_current(spark, sf):
    from ..operators.drift_text import with_side
    d = read_table(spark, sf, "documents").select("doc_id", "lang", "text")
    return with_side(d, F.col("lang") == "en").select("doc_id", "side", "text")


@register("corpus_union", "SELECT side, count(*) AS docs, sum(length(text)) AS chars FROM ("
          "SELECT CASE WHEN lang = 'en' THEN 'ref' ELSE 'cur' END AS side, text FROM documents) u GROUP BY side")
def q_corpus_union(spark, sf):
    from ..operators.drift_text import tag_sides
    d = read_table(spark, sf, "documents").select("doc_id", "lang", "text")
    u = tag_sides(d.filter(F.col("lang") == "en"), d.filter(F.coalesce(F.col("lang") != "en", F.lit(True))))
    return u.groupBy("side").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length("text")).alias("chars"))
