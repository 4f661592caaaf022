"""Registered sampling, split and active-learning queries (E1-E5, C8, C9, D3-D7, K*, A2-A7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import active as A
from ..operators import sampling as SM
from ..operators import scoring as S
from ..session import write_table
from ..sources.tables import read_table
from .q_curate import ALL_SQL, all_articles
from .q_model import documents_key, letter_model, scorer_cte
from .registry import register, rounded

SEED = 42
POOL_SQL = f"SELECT article_id, category FROM ({ALL_SQL}) k"


def pool_articles(spark, sf):
    return all_articles(spark, sf).select("article_id", "category")


# ---------------------------------------------------------------- sampling and splits

@register("initial_stratified_sample", f"""
WITH p AS ({POOL_SQL}), big AS (SELECT category FROM p GROUP BY category HAVING count(*) >= 10)
SELECT article_id, category FROM (SELECT *, row_number() OVER (PARTITION BY category
  ORDER BY md5('{SEED}:initial:' || article_id), article_id) AS rn FROM p) r
WHERE rn <= 10 AND category IN (SELECT category FROM big)""")
def q_initial_stratified_sample(spark, sf):
    return SM.initial_stratified_sample(pool_articles(spark, sf), 10, "category", "article_id", SEED)


CANDIDATES_SQL = f"""SELECT article_id, category, CAST(row_number() OVER (ORDER BY h, article_id) - 1 AS INTEGER) AS local_idx
FROM (SELECT *, md5('{SEED}:candidates:1:' || article_id) AS h FROM ({POOL_SQL}) p ORDER BY h, article_id LIMIT 100) c"""


@register("random_candidates", CANDIDATES_SQL)
def q_random_candidates(spark, sf):
    return SM.random_candidates(pool_articles(spark, sf), 100, "article_id", SEED, 1)


@register("random_fallback_pick", f"""SELECT article_id, local_idx FROM (SELECT *, row_number() OVER (
ORDER BY md5('{SEED}:fallback:1:' || local_idx), local_idx) AS rn FROM ({CANDIDATES_SQL}) c) r WHERE rn <= 20""")
def q_random_fallback_pick(spark, sf):
    c = SM.random_candidates(pool_articles(spark, sf), 100, "article_id", SEED, 1)
    return SM.random_fallback_pick(c, 20, "local_idx", SEED, 1).select("article_id", "local_idx")


def _quota_sql(src: str, label: str, size: float) -> str:
    """Per-class train quota: largest remainder of ``count / n * n_train``, ties to the smaller label."""
    return f"""
  SELECT {label}, c AS class_count, CAST(fl + CASE WHEN rk <= need THEN 1 ELSE 0 END AS BIGINT) AS train_quota FROM (
    SELECT *, n_train - sum(fl) OVER () AS need,
           row_number() OVER (ORDER BY cont - fl DESC, {label}) AS rk FROM (
      SELECT {label}, c, n_train, c / n * n_train AS cont, floor(c / n * n_train) AS fl FROM (
        SELECT {label}, c, sum(c) OVER () AS n,
               sum(c) OVER () - CAST(ceil(CAST({size} AS DOUBLE) * sum(c) OVER ()) AS BIGINT) AS n_train
        FROM (SELECT {label}, count(*) AS c FROM ({src}) y GROUP BY {label}) cc) a) b) c2"""


def _split_sql(src: str, label: str, key: str, size: float, tag: str, first: str, rest: str) -> str:
    """SQL twin of ``stratified_split``: quotas by largest remainder, then rank per class."""
    return f"""
SELECT s.*, CASE WHEN rn <= q.train_quota THEN '{first}' ELSE '{rest}' END AS split FROM (
  SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY md5('{SEED}:{tag}:' || {key}), {key}) AS rn FROM ({src}) x) s
JOIN ({_quota_sql(src, label, size)}) q USING ({label})"""


SPLIT_TEST_SQL = _split_sql(POOL_SQL, "category", "article_id", 0.2, "test", "train", "test")
TRAIN_VAL_SQL = _split_sql(f"SELECT article_id, category FROM ({SPLIT_TEST_SQL}) t WHERE split = 'train'",
                           "category", "article_id", 0.1, "val", "train", "val")
THREE_WAY_SQL = (f"SELECT article_id, category, split FROM ({TRAIN_VAL_SQL}) tv UNION ALL "
                 f"SELECT article_id, category, split FROM ({SPLIT_TEST_SQL}) t WHERE split = 'test'")


@register("stratified_split", f"SELECT article_id, category, split FROM ({SPLIT_TEST_SQL}) s", bench=True)
def q_stratified_split(spark, sf):
    return SM.stratified_split(pool_articles(spark, sf), "category", "article_id", 0.2, SEED)


@register("nested_val_split", THREE_WAY_SQL)
def q_nested_val_split(spark, sf):
    return SM.train_val_test_split(pool_articles(spark, sf), "category", "article_id", 0.2, 0.1, SEED)


@register("split_distribution", f"SELECT split, category, count(*) AS count FROM ({THREE_WAY_SQL}) s GROUP BY 1, 2")
def q_split_distribution(spark, sf):
    from ..operators.curate import split_distribution
    return split_distribution(SM.train_val_test_split(pool_articles(spark, sf), "category", "article_id"))


@register("split_distribution_totals", f"SELECT split, category, count(*) AS count FROM ({THREE_WAY_SQL}) s "
          "GROUP BY ROLLUP (split, category)")
def q_split_distribution_totals(spark, sf):
    from ..operators.curate import split_distribution
    return split_distribution(SM.train_val_test_split(pool_articles(spark, sf), "category", "article_id"),
                              totals=True)


@register("split_quotas", f"""SELECT category, class_count, train_quota, class_count - train_quota AS test_quota
FROM ({_quota_sql(POOL_SQL, "category", 0.2)}) q""")
def q_split_quotas(spark, sf):
    return SM.split_quotas(pool_articles(spark, sf), "category", 0.2)


# ---------------------------------------------------------------- active learning on documents

def al_pool(spark, sf):
    """Pool = every document (category = language) with class probabilities from the letter
    model (the selector's uncertainty input)."""
    from ..session import materialise

    def build():
        d = read_table(spark, sf, "documents").select("doc_id", F.col("lang").alias("category"), "text")
        return S.predict(d, letter_model(spark, sf), "text")
    return materialise(spark, f"al_pool_{documents_key(spark, sf)}", build)


def al_log_zero(pool):
    """The log of the initial sample, written: as a small table it is sent to the tasks that join it."""
    init = SM.initial_stratified_sample(pool, 10, "category", "doc_id", SEED)
    return write_table(init.select(F.lit(0).alias("iteration"), F.lit(0).alias("pick_pos"),
                                   F.col("doc_id").cast("long").alias("row_id")), "selection_log")


def al_round_one(spark, sf):
    pool = al_pool(spark, sf)
    log0 = al_log_zero(pool)
    new = A.active_learning_iteration(pool, log0, 1, 20, 100, SEED, "category", "text", "doc_id")
    return pool, log0, write_table(new.select("iteration", "pick_pos", "row_id"), "selection_log")


AL_SQL = "WITH " + scorer_cte(True).strip() + f""",
pool AS (SELECT doc_id, lang AS category, text FROM documents WHERE text IS NOT NULL),
init AS (SELECT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY category
           ORDER BY md5('{SEED}:initial:' || doc_id), doc_id) AS rn FROM pool WHERE category IS NOT NULL) r
         WHERE rn <= 10 AND category IN (SELECT category FROM pool GROUP BY category HAVING count(*) >= 10)),
cands AS (SELECT *, CAST(row_number() OVER (ORDER BY h, doc_id) - 1 AS INTEGER) AS local_idx FROM (
           SELECT pool.*, md5('{SEED}:candidates:1:' || doc_id) AS h FROM pool
           WHERE doc_id NOT IN (SELECT doc_id FROM init) ORDER BY h, doc_id LIMIT 100) c),
dist AS (SELECT category, count(*) AS n FROM pool WHERE doc_id IN (SELECT doc_id FROM init) GROUP BY category),
feat AS (SELECT doc_id, -sum(CASE WHEN prob > 0 THEN prob * ln(prob) ELSE 0 END) / ln(count(*)) AS unc,
                max(prob) - (list(prob ORDER BY prob DESC))[2] AS margin FROM p GROUP BY doc_id),
inf AS (SELECT c.doc_id, c.category, c.local_idx, round(
               0.4 * f.unc + 0.3 * (1 - f.margin)
               + 0.2 * (1 - coalesce((SELECT n FROM dist WHERE dist.category = c.category) / (SELECT sum(n) FROM dist), 0.0))
               + 0.1 * least(1.0, ln(1 + len(string_split_regex(trim(c.text), '\\s+'))) / ln(201.0)), 12) AS informativeness
        FROM cands c JOIN feat f USING (doc_id)),
picks AS (SELECT *, CAST(row_number() OVER (ORDER BY informativeness DESC, local_idx) - 1 AS INTEGER) AS pick_pos
          FROM inf QUALIFY pick_pos < 20)
"""


@register("rank_informative", AL_SQL + "SELECT doc_id, category, local_idx, round(informativeness, 6) AS informativeness, "
          "pick_pos FROM picks")
def q_rank_informative(spark, sf):
    pool = al_pool(spark, sf)
    log0 = al_log_zero(pool)
    rem = A.remaining_pool(pool, log0, "doc_id")
    cands = SM.random_candidates(rem, 100, "doc_id", SEED, 1)
    picks = A.rank_informative(cands, 20, A.distribution_map(A.training_rows(pool, log0, "doc_id")))
    return rounded(picks.select("doc_id", "category", "local_idx", "informativeness", "pick_pos"))


DIVERSE_SQL = AL_SQL[:AL_SQL.index("cands AS (")].replace("WITH ", "WITH RECURSIVE ", 1) + f"""
dist AS (SELECT category, count(*) AS n FROM pool WHERE doc_id IN (SELECT doc_id FROM init) GROUP BY category),
feat AS MATERIALIZED (SELECT doc_id, -sum(CASE WHEN prob > 0 THEN prob * ln(prob) ELSE 0 END) / ln(count(*)) AS unc,
                max(prob) - (list(prob ORDER BY prob DESC))[2] AS margin FROM p GROUP BY doc_id),
nb AS (SELECT CAST(ceil(count(*) / 100.0) AS BIGINT) AS n FROM pool),
cb AS (SELECT p.*, md5('{SEED}:diverse:' || doc_id) AS h,
              CAST('0x' || substr(md5('{SEED}:diverse:' || doc_id), 1, 8) AS BIGINT) % (SELECT n FROM nb) AS batch FROM pool p),
c AS MATERIALIZED (SELECT batch, doc_id, category, row_number() OVER (PARTITION BY batch ORDER BY h, doc_id) - 1 AS local_idx, text,
  round(0.4 * f.unc + 0.3 * (1 - f.margin)
        + 0.2 * (1 - coalesce((SELECT n FROM dist WHERE dist.category = cb.category) / (SELECT sum(n) FROM dist), 0.0))
        + 0.1 * least(1.0, ln(1 + len(string_split_regex(trim(cb.text), '\\s+'))) / ln(201.0)), 12) AS inf
  FROM cb JOIN feat f USING (doc_id)),
ws AS MATERIALIZED (SELECT batch, local_idx, category, list_distinct(regexp_extract_all(lower(text), '[\\pL\\pN_]{{2,}}')) AS words FROM c),
wl AS (SELECT batch, local_idx, unnest(words) AS word FROM ws),
com AS (SELECT a.batch, a.local_idx AS i, b.local_idx AS j, count(*) AS n FROM wl a JOIN wl b USING (batch, word) GROUP BY ALL),
far AS MATERIALIZED (SELECT a.batch, a.local_idx AS i, b.local_idx AS j, CASE WHEN len(a.words) + len(b.words) - coalesce(n, 0) > 0
    THEN 1 - coalesce(n, 0) / (len(a.words) + len(b.words) - coalesce(n, 0)) ELSE 0.0 END AS d
  FROM ws a JOIN ws b ON a.batch = b.batch AND a.category IS NOT DISTINCT FROM b.category
  LEFT JOIN com ON com.batch = a.batch AND com.i = a.local_idx AND com.j = b.local_idx),
g AS (SELECT batch, local_idx, doc_id, category, inf, CAST(1.0 AS DOUBLE) AS novelty, 0 AS step FROM c
  UNION ALL
  SELECT t.batch, t.local_idx, t.doc_id, t.category, t.inf, least(t.novelty, coalesce(far.d, 1.0)), t.step + 1
  FROM (SELECT *, first_value(local_idx) OVER (PARTITION BY batch ORDER BY novelty = 0, round(inf + 0.5 * novelty, 12) DESC, local_idx) AS top
        FROM g) t LEFT JOIN far ON far.batch = t.batch AND far.i = t.local_idx AND far.j = t.top
  WHERE t.local_idx <> t.top AND t.step < 19)
SELECT batch, doc_id, category, CAST(local_idx AS INTEGER) AS local_idx, round(inf, 6) AS informativeness, round(novelty, 6) AS novelty, step AS pick_pos
FROM g QUALIFY row_number() OVER (PARTITION BY batch, step ORDER BY novelty = 0, round(inf + 0.5 * novelty, 12) DESC, local_idx) = 1"""


@register("rank_diverse", DIVERSE_SQL)
def q_rank_diverse(spark, sf):
    """K7 farthest-first: 20 picks from each hash batch of about 100 rows of the whole pool."""
    from pyspark.sql import Window
    from ..functions.columns import hash_key
    pool = al_pool(spark, sf)
    n_batches = max(1, -(-pool.count() // 100))
    key = hash_key(SEED, "diverse", "doc_id")
    b = pool.withColumn("batch", F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), F.lit(n_batches)))
    b = b.withColumn("local_idx", F.row_number().over(Window.partitionBy("batch").orderBy(key, "doc_id")) - 1)
    current = A.distribution_map(SM.initial_stratified_sample(pool, 10, "category", "doc_id", SEED))
    picks = A.rank_diverse(b, 20, current, group_cols=["batch"])
    return rounded(picks.select("batch", "doc_id", "category", "local_idx", "informativeness", "novelty", "pick_pos"))


@register("active_learning_iteration", AL_SQL + "SELECT 1 AS iteration, pick_pos, CAST(doc_id AS BIGINT) AS row_id FROM picks")
def q_active_learning_iteration(spark, sf):
    _, _, new = al_round_one(spark, sf)
    return new


@register("map_local_to_global", AL_SQL + "SELECT pick_pos, local_idx, doc_id FROM picks")
def q_map_local_to_global(spark, sf):
    """D3: picked local positions -> pool row ids (posexplode of the answer joined back)."""
    pool = al_pool(spark, sf)
    log0 = al_log_zero(pool)
    cands = SM.random_candidates(A.remaining_pool(pool, log0, "doc_id"), 100, "doc_id", SEED, 1)
    picks = A.rank_informative(cands, 20, A.distribution_map(A.training_rows(pool, log0, "doc_id")))
    answer = A.render_response(picks)
    parsed = A.parse_selection_response(answer, "response")
    local = parsed.select(F.posexplode("selected_indices").alias("pick_pos", "local_idx"))
    return local.join(cands.select("local_idx", "doc_id"), "local_idx").select(
        F.col("pick_pos").cast("int"), "local_idx", "doc_id")


STATE_SQL = AL_SQL + """, log AS (SELECT 0 AS iteration, doc_id FROM init UNION ALL SELECT 1, doc_id FROM picks)
"""


@register("apply_selection", STATE_SQL + "SELECT pool.doc_id, pool.category, log.doc_id IS NOT NULL AS selected, "
          "CAST(coalesce(log.iteration, -1) AS INTEGER) AS iteration FROM pool LEFT JOIN log USING (doc_id)")
def q_apply_selection(spark, sf):
    pool, log0, new = al_round_one(spark, sf)
    return A.apply_selection(pool.select("doc_id", "category"), log0.unionByName(new), "doc_id")


@register("remaining_pool", STATE_SQL + "SELECT doc_id FROM pool WHERE doc_id NOT IN (SELECT doc_id FROM log)")
def q_remaining_pool(spark, sf):
    pool, log0, new = al_round_one(spark, sf)
    return A.remaining_pool(pool.select("doc_id"), log0.unionByName(new), "doc_id")


@register("training_rows", STATE_SQL + "SELECT doc_id, category FROM pool WHERE doc_id IN (SELECT doc_id FROM log)")
def q_training_rows(spark, sf):
    pool, log0, new = al_round_one(spark, sf)
    return A.training_rows(pool.select("doc_id", "category"), log0.unionByName(new), "doc_id")


@register("iteration_distribution", STATE_SQL + "SELECT CAST(iteration AS INTEGER) AS iteration, category, count(*) AS count "
          "FROM log JOIN pool USING (doc_id) GROUP BY 1, 2")
def q_iteration_distribution(spark, sf):
    pool, log0, new = al_round_one(spark, sf)
    return A.iteration_distribution(pool, log0.unionByName(new), "doc_id")


@register("selected_categories", AL_SQL + "SELECT 1 AS iteration, list(CAST(doc_id AS BIGINT) ORDER BY pick_pos) AS selected_indices, "
          "list(category ORDER BY pick_pos) AS selected_categories FROM picks")
def q_selected_categories(spark, sf):
    pool, _, new = al_round_one(spark, sf)
    return A.selected_categories(pool, new, "doc_id")


@register("candidate_samples", AL_SQL + "SELECT 1 AS batch, local_idx, doc_id AS \"index\", category, "
          "split_part(text, chr(10), 1) AS headline FROM cands")
def q_candidate_samples(spark, sf):
    """K3: candidate structs (flattened for comparison)."""
    pool = al_pool(spark, sf).withColumn("headline", F.substring_index("text", "\n", 1))
    log0 = al_log_zero(pool)
    cands = SM.random_candidates(A.remaining_pool(pool, log0, "doc_id"), 100, "doc_id", SEED, 1)
    s = A.candidate_samples(cands.withColumn("batch", F.lit(1)), ["headline"], "doc_id", "category", "batch")
    return s.select("batch", F.inline("samples")).select("batch", "local_idx", "index", "category", "headline")


PROMPT_SQL = f"""
WITH pool AS (SELECT doc_id, lang AS category, text FROM documents WHERE text IS NOT NULL),
nb AS (SELECT CAST(ceil(count(*) / 100.0) AS BIGINT) AS n FROM pool),
b AS (SELECT p.*, md5('{SEED}:batch:' || doc_id) AS h,
             CAST('0x' || substr(md5('{SEED}:batch:' || doc_id), 1, 8) AS BIGINT) % (SELECT n FROM nb) AS batch FROM pool p),
s AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY h, doc_id) - 1 AS local_idx,
             split_part(text, chr(10), 1) AS headline,
             CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) END AS description FROM b),
init AS (SELECT category FROM (SELECT *, row_number() OVER (PARTITION BY category
           ORDER BY md5('{SEED}:initial:' || doc_id), doc_id) AS rn FROM pool WHERE category IS NOT NULL) r
         WHERE rn <= 10 AND category IN (SELECT category FROM pool GROUP BY category HAVING count(*) >= 10)),
cur AS (SELECT map_from_entries(list(struct_pack(k := category, v := n) ORDER BY category)) AS m,
               list(category ORDER BY category) AS cats FROM (SELECT category, count(*) AS n FROM init GROUP BY category) c),
pd AS (SELECT map_from_entries(list(struct_pack(k := category, v := n) ORDER BY category)) AS m
       FROM (SELECT category, count(*) AS n FROM pool WHERE category IS NOT NULL GROUP BY category) c),
r AS (SELECT batch, local_idx, concat_ws(chr(10), '[Sample ' || local_idx || ']',
             CASE WHEN coalesce(headline, '') <> '' THEN 'Headline: ' || headline END,
             CASE WHEN coalesce(description, '') <> '' THEN 'Description: ' || description END,
             'Category: ' || category, '---') AS txt FROM s)
SELECT batch, count(*) AS num_candidates, concat_ws(chr(10), '{A.PROMPT_HEAD.format(n=20)}',
  (SELECT array_to_string(list_transform(cats, lambda c: '- ' || c), chr(10)) FROM cur),
  'Current training distribution:', (SELECT CAST(to_json(m) AS VARCHAR) FROM cur),
  'Pool distribution:', (SELECT CAST(to_json(m) AS VARCHAR) FROM pd),
  '{A.PROMPT_GUIDE}', 'Candidates:', string_agg(txt, chr(10) ORDER BY local_idx),
  '{A.PROMPT_ANSWER[0].format(n=20)}' || (count(*) - 1) || '{A.PROMPT_ANSWER[1]}') AS prompt
FROM r GROUP BY batch"""


@register("selection_prompts", PROMPT_SQL)
def q_selection_prompts(spark, sf):
    """K4: one prompt per candidate batch; the whole pool is cut into hash batches of about
    100 rows (md5 prefix modulo the batch count, a partition key, not a filter)."""
    from pyspark.sql import Window
    from ..functions.columns import hash_key
    pool = al_pool(spark, sf).withColumn("headline", F.substring_index("text", "\n", 1)) \
        .withColumn("description", F.when(F.instr("text", "\n") > 0,
                                          F.expr("substring(text, instr(text, '\\n') + 1)")))
    n_batches = max(1, -(-pool.count() // 100))
    key = hash_key(SEED, "batch", "doc_id")
    b = pool.withColumn("batch", F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), F.lit(n_batches)))
    w = Window.partitionBy("batch").orderBy(key, "doc_id")
    b = b.withColumn("local_idx", F.row_number().over(w) - 1)
    samples = A.candidate_samples(b, ["headline", "description"], "doc_id", "category", "batch")
    cur = A.distribution_map(SM.initial_stratified_sample(pool, 10, "category", "doc_id", SEED))
    return A.selection_prompts(samples, cur, A.distribution_map(pool), 20, ["headline", "description"])


RESPONSES_SQL = """SELECT conv_id, turn, text AS response FROM conversations WHERE role = 'assistant'"""
EXTRACT_SQL = ("trim(CASE WHEN contains(response, '```json') THEN split_part(split_part(response, '```json', 2), '```', 1) "
               "WHEN contains(response, '```') THEN split_part(response, '```', 2) ELSE response END)")


@register("parse_selection_response", f"""SELECT conv_id, turn, coalesce(json_type(j) = 'OBJECT', false) AS is_json,
coalesce(CAST(json_extract(j, '$.selected_indices') AS INTEGER[]), []) AS selected_indices,
CASE WHEN json_exists(j, '$.reasoning') THEN json_extract_string(j, '$.reasoning') ELSE 'No reasoning provided' END AS reasoning
FROM (SELECT conv_id, turn, TRY_CAST({EXTRACT_SQL} AS JSON) AS j FROM ({RESPONSES_SQL}) r) x""")
def q_parse_selection_response(spark, sf):
    """K5 over real response-like texts (assistant turns of ``conversations``)."""
    r = read_table(spark, sf, "conversations").filter(F.col("role") == "assistant") \
        .select("conv_id", "turn", F.col("text").alias("response"))
    return A.parse_selection_response(r, "response").select("conv_id", "turn", "is_json", "selected_indices", "reasoning")


@register("validate_selection", f"""SELECT conv_id, turn, coalesce(json_type(j) = 'OBJECT', false) AND len(idx) > 0 AND list_min(idx) >= 0
AND list_max(idx) < 100 AS valid FROM (SELECT conv_id, turn, j, coalesce(CAST(json_extract(j, '$.selected_indices') AS INTEGER[]), [])
AS idx FROM (SELECT conv_id, turn, TRY_CAST({EXTRACT_SQL} AS JSON) AS j FROM ({RESPONSES_SQL}) r) x) y""")
def q_validate_selection(spark, sf):
    """K6: validity of each answer against 100 candidates (invalid -> random fallback)."""
    r = read_table(spark, sf, "conversations").filter(F.col("role") == "assistant") \
        .select("conv_id", "turn", F.col("text").alias("response"))
    p = A.parse_selection_response(r, "response")
    return p.select("conv_id", "turn", A.validate_selection(p, F.lit(100)).alias("valid"))


@register("selection_round_trip")
def q_selection_round_trip(spark, sf):
    """K5+K6 valid path: the selector's picks rendered as a fenced JSON answer, parsed and
    validated back (rows-only; unit tests check the exact values)."""
    pool = al_pool(spark, sf)
    cands = SM.random_candidates(pool, 100, "doc_id", SEED, 1)
    picks = A.rank_informative(cands, 20, A.distribution_map(cands.limit(0)))
    p = A.parse_selection_response(A.render_response(picks), "response")
    return p.select("is_json", "selected_indices", "reasoning", "category_breakdown",
                    A.validate_selection(p, F.lit(100)).alias("valid"))


ROUNDS = 10  # the run's default


def _run_sql(rounds: int = ROUNDS) -> str:
    """The whole run in SQL: one block per round (a round without candidates adds no rows)."""
    out = AL_SQL[:AL_SQL.index("cands AS (")].rstrip() + """
feat AS MATERIALIZED (SELECT doc_id, -sum(CASE WHEN prob > 0 THEN prob * ln(prob) ELSE 0 END) / ln(count(*)) AS unc,
                max(prob) - (list(prob ORDER BY prob DESC))[2] AS margin FROM p GROUP BY doc_id),
log0 AS MATERIALIZED (SELECT 0 AS iteration, row_number() OVER (PARTITION BY category ORDER BY md5('%(s)s:initial:' || doc_id), doc_id) - 1 AS pick_pos,
         doc_id, category FROM pool WHERE doc_id IN (SELECT doc_id FROM init))""" % {"s": SEED}
    for i in range(1, rounds + 1):
        out += f""",
c{i} AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY h, doc_id) - 1 AS local_idx FROM (
  SELECT pool.*, md5('{SEED}:candidates:{i}:' || doc_id) AS h FROM pool WHERE doc_id NOT IN (SELECT doc_id FROM log{i - 1})
  ORDER BY h, doc_id LIMIT 100) x),
d{i} AS MATERIALIZED (SELECT category, count(*) AS n FROM log{i - 1} GROUP BY category),
n{i} AS (SELECT c.doc_id, c.category, c.local_idx, round(0.4 * f.unc + 0.3 * (1 - f.margin)
  + 0.2 * (1 - coalesce((SELECT n FROM d{i} WHERE d{i}.category = c.category) / (SELECT sum(n) FROM d{i}), 0.0))
  + 0.1 * least(1.0, ln(1 + len(string_split_regex(trim(c.text), '\\s+'))) / ln(201.0)), 12) AS informativeness
  FROM c{i} c JOIN feat f USING (doc_id)),
log{i} AS MATERIALIZED (SELECT * FROM log{i - 1} UNION ALL SELECT {i}, pick_pos, doc_id, category FROM (
  SELECT *, row_number() OVER (ORDER BY informativeness DESC, local_idx) - 1 AS pick_pos FROM n{i}) x WHERE pick_pos < 20)"""
    return out + f""",
log AS MATERIALIZED (SELECT * FROM log{rounds}),
hist AS (SELECT CAST(iteration AS INTEGER) AS iteration, list(CAST(doc_id AS BIGINT) ORDER BY pick_pos) AS selected_indices,
  'highest informativeness score' AS reasoning, list(category ORDER BY pick_pos) AS selected_categories FROM log
  WHERE iteration >= 1 GROUP BY iteration),
brk AS (SELECT iteration, map_from_entries(list(struct_pack(k := category, v := CAST(n AS VARCHAR)) ORDER BY category)) AS category_breakdown
  FROM (SELECT iteration, category, count(*) AS n FROM log WHERE iteration >= 1 GROUP BY ALL) x GROUP BY iteration)
"""


RUN_SQL = _run_sql()
_LOGS: dict = {}


def _run(spark, sf, iterations=ROUNDS):
    """The run's log is written once per application and state of the table; every output derives from it."""
    pool = al_pool(spark, sf)
    key = (spark.sparkContext.applicationId, documents_key(spark, sf), iterations)
    if key not in _LOGS:
        _LOGS[key] = A.active_learning_run(pool, 10, 20, iterations, 100, SEED, "category", "text", "doc_id").log
    return A.result_of(pool, _LOGS[key], "doc_id", "category")


@register("active_learning_run", RUN_SQL + """SELECT pool.doc_id, pool.category, log.doc_id IS NOT NULL AS selected,
CAST(coalesce(log.iteration, -1) AS INTEGER) AS iteration FROM pool LEFT JOIN log USING (doc_id)""")
def q_active_learning_run(spark, sf):
    """K1: all ten rounds over the whole document pool."""
    res = _run(spark, sf)
    return res.pool_with_selections.select("doc_id", "category", "selected", "iteration")


@register("selection_history", RUN_SQL + "SELECT hist.iteration, selected_indices, reasoning, selected_categories, category_breakdown "
          "FROM hist JOIN brk USING (iteration)")
def q_selection_history(spark, sf):
    """K8."""
    return _run(spark, sf).selection_history


SUMMARY_SQL = """SELECT (SELECT count(*) FROM log) AS total_training_samples,
(SELECT map_from_entries(list(struct_pack(k := category, v := n) ORDER BY category)) FROM (
   SELECT category, count(*) AS n FROM log GROUP BY category) d) AS final_distribution,
(SELECT count(*) FROM hist) AS num_iterations, 'llm_based' AS strategy"""


@register("selection_summary", RUN_SQL + SUMMARY_SQL)
def q_selection_summary(spark, sf):
    """A7."""
    res = _run(spark, sf)
    return A.selection_summary(res.training_data, res.selection_history)


ANSWER_BATCH_SQL = f"""nb AS (SELECT CAST(ceil(count(*) / 10.0) AS BIGINT) AS n FROM documents),
b AS (SELECT CAST('0x' || substr(md5('{SEED}:answers:' || doc_id), 1, 8) AS BIGINT) % (SELECT n FROM nb) AS batch, count(*) AS m
      FROM documents GROUP BY 1)"""
KINDS = 8  # valid, junk, empty list, out of range, null index, text behind, retried, single quotes


@register("selection_answers", f"""WITH {ANSWER_BATCH_SQL}, v AS (SELECT batch, CAST(m AS INTEGER) AS m, batch % {KINDS} IN (0, 6) AS valid FROM b)
SELECT batch, m, valid, CASE WHEN valid THEN [m - 1, 0] ELSE list_transform(list_sort(list_transform(range(m),
  lambda i: {{'h': md5('{SEED}:fallback:1:' || batch || ':' || i), 'i': i}}))[1:3], lambda s: CAST(s.i AS INTEGER)) END AS final_indices,
CASE WHEN NOT valid THEN 'Random selection (LLM query failed)' WHEN batch % {KINDS} = 6 THEN 'No reasoning provided' END AS final_reasoning,
CASE WHEN valid AND batch % {KINDS} = 0 THEN MAP {{'a': '2', 'b': 'x'}} ELSE MAP {{}} END AS final_breakdown FROM v""")
def q_selection_answers(spark, sf):
    """K5 + K6 + E3 over one answer (or two attempts) per candidate batch of the whole pool, each batch
    with its own candidate count: valid, junk, empty, out of range, null index, text behind the
    object, retried and single-quoted answers."""
    from ..functions.columns import hash_key
    d = read_table(spark, sf, "documents").select("doc_id")
    n = max(1, -(-d.count() // 10))
    key = hash_key(SEED, "answers", "doc_id")
    b = d.withColumn("batch", F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), F.lit(n))) \
        .groupBy("batch").agg(F.count(F.lit(1)).cast("int").alias("m"))
    kind = F.col("batch") % KINDS
    last = (F.col("m") - 1).cast("string")
    good = F.concat(F.lit('{"selected_indices": ['), last, F.lit(', 0]}'))
    first = (F.when(kind == 0, F.concat(F.lit('Here:\n' + A.FENCE + 'json\n{"selected_indices": ['), last,
                                        F.lit(', 0], "reasoning": null, "category_breakdown": {"a": 2, "b": "x"}}\n' + A.FENCE)))
             .when(kind == 1, F.lit("I would pick the longest ones."))
             .when(kind == 2, F.lit('{"selected_indices": [], "reasoning": "none"}'))
             .when(kind == 3, F.concat(F.lit('{"selected_indices": [0, '), F.col("m").cast("string"), F.lit("]}")))
             .when(kind == 4, F.lit('{"selected_indices": [0, null]}'))
             .when(kind == 5, F.concat(good, F.lit(" as asked")))
             .when(kind == 6, F.lit("not ready"))
             .otherwise(F.lit("{'selected_indices': [0]}")))
    tries = b.withColumn("tries", F.when(kind == 6, F.array(first, good)).otherwise(F.array(first)))
    rows = tries.select("batch", "m", F.posexplode("tries").alias("attempt", "response"))
    out = A.resolve_attempts(A.parse_selection_response(rows, "response"), F.col("m"), 3, SEED, 1)
    return out.select("batch", "m", "valid", "final_indices", "final_reasoning", "final_breakdown")


@register("resolve_selection", f"""SELECT conv_id, turn, valid,
CASE WHEN valid THEN idx ELSE list_transform(list_sort(list_transform(range(100),
  lambda i: {{'h': md5('{SEED}:fallback:1:' || conv_id || ':' || i), 'i': i}}))[1:20], lambda s: s.i) END AS final_indices,
CASE WHEN valid THEN coalesce(json_extract_string(j, '$.reasoning'), 'No reasoning provided')
     ELSE '{A.FALLBACK_REASON}' END AS final_reasoning
FROM (SELECT conv_id, turn, j, idx, coalesce(json_type(j) = 'OBJECT', false) AND len(idx) > 0 AND list_min(idx) >= 0
      AND list_max(idx) < 100 AS valid FROM (SELECT conv_id, turn, j,
      coalesce(CAST(json_extract(j, '$.selected_indices') AS INTEGER[]), []) AS idx FROM (
      SELECT conv_id, turn, TRY_CAST({EXTRACT_SQL} AS JSON) AS j FROM ({RESPONSES_SQL}) r) x) y) z""")
def q_resolve_selection(spark, sf):
    """K6 + E3: each answer to a 100-candidate batch resolved to 20 positions (valid answer, or
    the random fallback)."""
    r = read_table(spark, sf, "conversations").filter(F.col("role") == "assistant") \
        .select("conv_id", "turn", F.col("text").alias("response"))
    p = A.resolve_selection(A.parse_selection_response(r, "response"), 100, 20, SEED, 1, "conv_id")
    return p.select("conv_id", "turn", "valid", "final_indices", "final_reasoning")


@register("selection_summary_one_round", _run_sql(1) + SUMMARY_SQL)
def q_selection_summary_one_round(spark, sf):
    """A7 after the initial sample and one selection round."""
    res = _run(spark, sf, iterations=1)
    return A.selection_summary(res.training_data, res.selection_history)


@register("selection_by_answers", f"""WITH pool AS (SELECT doc_id, lang AS category, text FROM documents WHERE text IS NOT NULL),
init AS (SELECT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5('{SEED}:initial:' || doc_id), doc_id) AS rn
  FROM pool WHERE category IS NOT NULL) r WHERE rn <= 10 AND category IN (SELECT category FROM pool GROUP BY category HAVING count(*) >= 10)),
c1 AS (SELECT doc_id, row_number() OVER (ORDER BY md5('{SEED}:candidates:1:' || doc_id), doc_id) - 1 AS local_idx FROM pool
  WHERE doc_id NOT IN (SELECT doc_id FROM init) QUALIFY local_idx < 100),
p1 AS (SELECT doc_id FROM c1 WHERE local_idx IN (3, 1)),
c2 AS (SELECT doc_id, row_number() OVER (ORDER BY md5('{SEED}:candidates:2:' || doc_id), doc_id) - 1 AS local_idx FROM pool
  WHERE doc_id NOT IN (SELECT doc_id FROM init UNION ALL SELECT doc_id FROM p1) QUALIFY local_idx < 100),
p2 AS (SELECT doc_id, row_number() OVER (ORDER BY md5('{SEED}:fallback:2:2:' || local_idx)) - 1 AS pick_pos FROM c2 QUALIFY pick_pos < 20)
SELECT 1 AS iteration, [(SELECT CAST(doc_id AS BIGINT) FROM c1 WHERE local_idx = 3), (SELECT CAST(doc_id AS BIGINT) FROM c1 WHERE local_idx = 1)] AS selected_indices,
  'close calls' AS reasoning UNION ALL
SELECT 2, list(CAST(doc_id AS BIGINT) ORDER BY pick_pos), 'Random selection (LLM query failed)' FROM p2""")
def q_selection_by_answers(spark, sf):
    """K1 with an outside selector: a valid second attempt in round 1, none in round 2 (fallback)."""
    answers = spark.createDataFrame([(1, 0, "busy"), (1, 1, '{"selected_indices": [3, 1], "reasoning": "close calls"}'),
                                     (2, 0, '{"selected_indices": [100]}')], "iteration int, attempt int, response string")
    pool = read_table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", F.col("lang").alias("category"), "text")
    res = A.active_learning_run(pool, 10, 20, 2, 100, SEED, "category", "text", "doc_id", selector=A.AnswerSelector(answers, "doc_id", SEED))
    return res.selection_history.select("iteration", "selected_indices", "reasoning")
