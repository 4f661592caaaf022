"""Active learning: grow a labelled training set by rounds of selection.

State is an immutable pool plus an append-only selection log ``(iteration, pick_pos, row_id)``;
"selected" and "iteration" are a left join of the two (D4), "remaining" an anti join (D5),
"training rows" a semi join (D6). Each round is one small top-k job over the remaining rows.
The log is written every round into the session's shared folder, so the lineage does not grow with
the number of rounds and an executor loss never replays earlier rounds. Being a table, its size is
known when the pool is joined with it: a log of some rows is sent to the pool's tasks and the pool
is never shuffled.

Selection (M3): the reference asks a hosted language model to pick the most informative
candidates. Here the default selector is a computed score over the same criteria
(``rank_informative``): uncertainty (normalised entropy), closeness to the decision boundary
(1 - top1 + top2), category rarity in the current training set, and text substance (length).
External selections arrive as response texts and go through ``parse_selection_response`` and
``validate_selection`` with the reference's fallback (random positions).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import hash_key
from .sampling import initial_stratified_sample, random_candidates

# The answer fence, the default reasoning text of a parsed answer without one, the
# reasoning text of the random fallback, and the strategy label written to the run summary (these
# must equal the reference's outputs).
FENCE = "```"
NO_REASON = "No reasoning provided"
SUMMARY_STRATEGY = "llm_based"
RESPONSE_SCHEMA = T.StructType([
    T.StructField("selected_indices", T.ArrayType(T.IntegerType())),
    T.StructField("reasoning", T.StringType()),
    T.StructField("category_breakdown", T.MapType(T.StringType(), T.StringType()))])
FALLBACK_REASON = "Random selection (LLM query failed)"
LOG_SCHEMA = "iteration int, pick_pos int, row_id long, reasoning string, breakdown map<string,string>"


@dataclass
class ActiveLearningResult:
    """K9: the named outputs of a run."""
    pool_with_selections: DataFrame
    training_data: DataFrame
    selection_history: DataFrame
    final_distribution: DataFrame
    log: DataFrame = field(repr=False, default=None)


# ------------------------------------------------------------------ state

def apply_selection(pool: DataFrame, log: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Pool + ``selected``, ``iteration`` (-1 never); the latest iteration wins."""
    last = log.groupBy(F.col("row_id").alias(id_col)).agg(F.max("iteration").alias("_it"))
    j = pool.join(last, id_col, "left")
    return j.withColumn("selected", F.col("_it").isNotNull()) \
            .withColumn("iteration", F.coalesce(F.col("_it"), F.lit(-1)).cast("int")).drop("_it")


def remaining_pool(pool: DataFrame, log: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Rows never selected."""
    return pool.join(log.select(F.col("row_id").alias(id_col)), id_col, "left_anti")


def training_rows(pool: DataFrame, log: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Rows selected so far."""
    return pool.join(log.select(F.col("row_id").alias(id_col)), id_col, "left_semi")


def selected_categories(pool: DataFrame, log: DataFrame, id_col: str = "row_id",
                        category_col: str = "category") -> DataFrame:
    """Per iteration, the picked row ids and their categories in pick order."""
    j = log.join(pool.select(F.col(id_col).alias("row_id"), F.col(category_col).alias("_cat")), "row_id")
    g = j.groupBy("iteration").agg(F.array_sort(F.collect_list(F.struct("pick_pos", "row_id", "_cat"))).alias("_p"))
    return g.select("iteration", F.transform("_p", lambda s: s["row_id"]).alias("selected_indices"),
                    F.transform("_p", lambda s: s["_cat"]).alias("selected_categories"))


def iteration_distribution(pool: DataFrame, log: DataFrame, id_col: str = "row_id",
                           category_col: str = "category") -> DataFrame:
    """Category counts per iteration (iterations without rows do not appear)."""
    state = apply_selection(pool, log, id_col).filter(F.col("selected"))
    return state.groupBy("iteration", category_col).agg(F.count(F.lit(1)).alias("count"))


def distribution_map(df: DataFrame, category_col: str = "category") -> DataFrame:
    """One row ``{category: count}`` (a distribution is bounded by the number of categories)."""
    c = df.filter(F.col(category_col).isNotNull()).groupBy(category_col).agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(category_col, "n")))).alias("distribution"))


# ------------------------------------------------------------------ candidates, prompts (K3, K4)

def candidate_samples(candidates: DataFrame, text_fields: list[str], id_col: str = "row_id",
                      category_col: str | None = "category", batch_col: str | None = None) -> DataFrame:
    """K3: one row per candidate batch with ``samples: array<struct>`` in local order."""
    fields = [F.col("local_idx"), F.col(id_col).alias("index")]
    fields += [F.col(f).cast("string").alias(f) for f in text_fields if f in candidates.columns]
    if category_col and category_col in candidates.columns:
        fields.append(F.col(category_col).alias("category"))
    g = [batch_col] if batch_col else []
    return candidates.groupBy(*g).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("samples"))


PROMPT_HEAD = ("Select the {n} most informative samples for training a text classifier on imbalanced "
               "data. Categories:")
PROMPT_GUIDE = ("Prefer uncertain or ambiguous samples, cases near category boundaries, variety within "
                "each category and substantial text; keep minority classes learnable.")
PROMPT_ANSWER = ('Answer with JSON only: {{"selected_indices": [{n} indices from 0 to ', '], "reasoning": "...", '
                 '"category_breakdown": {"<category>": <count>}}')


def _title(name: str) -> str:
    return name.replace("_", " ").title()


def selection_prompts(samples: DataFrame, current_dist: DataFrame, pool_dist: DataFrame,
                      num_to_select: int, text_fields: list[str] | None = None, categories: Column | None = None) -> DataFrame:
    """K4: one instruction document per candidate batch.

    Lists the categories (default: those of the current training set), the current and pool
    distributions as JSON, every sample numbered with its non-empty fields (title-cased names)
    and category (if the samples have one), and the required JSON answer shape. Without
    ``text_fields`` all fields of the samples are shown."""
    dist = current_dist.select(F.col("distribution").alias("_cur")).crossJoin(
        pool_dist.select(F.col("distribution").alias("_pool")))
    j = samples.crossJoin(F.broadcast(dist))
    cats = categories if categories is not None else F.array_sort(F.map_keys("_cur"))

    has_category = "category" in samples.schema["samples"].dataType.elementType.names
    text_fields = text_fields or [f for f in samples.schema["samples"].dataType.elementType.names
                                  if f not in ("local_idx", "index", "category")]

    def render(s):
        parts = [F.concat(F.lit("[Sample "), s["local_idx"].cast("string"), F.lit("]"))]
        for f in text_fields:
            parts.append(F.when(F.coalesce(s[f], F.lit("")) != "",
                                F.concat(F.lit(_title(f) + ": "), s[f])))
        if has_category:
            parts.append(F.concat(F.lit("Category: "), s["category"]))
        return F.concat_ws("\n", *parts, F.lit("---"))

    n_samples = F.size("samples")
    body = F.concat_ws(
        "\n",
        F.lit(PROMPT_HEAD.format(n=num_to_select)),
        F.array_join(F.transform(cats, lambda c: F.concat(F.lit("- "), c)), "\n"),
        F.lit("Current training distribution:"), F.to_json("_cur"),
        F.lit("Pool distribution:"), F.to_json("_pool"),
        F.lit(PROMPT_GUIDE),
        F.lit("Candidates:"),
        F.array_join(F.transform("samples", render), "\n"),
        F.concat(F.lit(PROMPT_ANSWER[0].format(n=num_to_select)), (n_samples - 1).cast("string"),
                 F.lit(PROMPT_ANSWER[1])))
    return j.select(*[c for c in samples.columns if c != "samples"], n_samples.alias("num_candidates"),
                    body.alias("prompt"))


# ------------------------------------------------------------------ responses (K5, K6)

def extract_json_text(response: Column) -> Column:
    """K5: text after the first json fence up to the next fence, else between the first two
    fences, else the whole text; trimmed."""
    tagged = F.split_part(F.split_part(response, F.lit(FENCE + "json"), F.lit(2)), F.lit(FENCE), F.lit(1))
    plain = F.split_part(response, F.lit(FENCE), F.lit(2))
    body = F.when(F.contains(response, F.lit(FENCE + "json")), tagged) \
            .when(F.contains(response, F.lit(FENCE)), plain).otherwise(response)
    return F.regexp_replace(body, r"^\s+|\s+$", "")


STRICT_JSON = {"allowSingleQuotes": "false", "allowUnquotedFieldNames": "false", "allowComments": "false",
               "allowNonNumericNumbers": "true", "mode": "PERMISSIVE"}


def parse_selection_response(df: DataFrame, response_col: str = "response") -> DataFrame:
    """K5: the answer as strict JSON. ``is_json``: the whole text is one JSON object (single quotes,
    unquoted names or anything behind the object make it junk). ``list_ok``: the indices are a list
    of integers. Missing keys get defaults; a ``reasoning`` that is present and null stays null;
    breakdown counts are kept as written (text)."""
    body = extract_json_text(F.col(response_col))
    one = T.ArrayType(T.MapType(T.StringType(), T.StringType()))
    # the text between brackets is an array of one object only if nothing stands around the object
    d = df.withColumn("_b", body).withColumn("_w", F.concat(F.lit("["), F.col("_b"), F.lit("]")))
    d = d.withColumn("_m", F.from_json("_w", one, STRICT_JSON))
    is_json = F.coalesce((F.size("_m") == 1) & F.element_at("_m", 1).isNotNull() & F.col("_b").startswith("{"), F.lit(False))
    keys = F.when(is_json, F.map_keys(F.element_at("_m", 1)))
    raw = F.element_at(F.element_at("_m", 1), F.lit("selected_indices"))
    listed = F.from_json(raw, T.ArrayType(T.StringType()), STRICT_JSON)
    whole = F.forall(listed, lambda x: F.coalesce(x.rlike(r"^-?\d{1,9}$"), F.lit(False)))
    has = F.array_contains(keys, "selected_indices")
    brk = F.from_json(F.element_at(F.element_at("_m", 1), F.lit("category_breakdown")), T.MapType(T.StringType(), T.StringType()), STRICT_JSON)
    return d.select(
        *df.columns, is_json.alias("is_json"),
        F.coalesce(is_json & (~has | (listed.isNotNull() & whole)), F.lit(False)).alias("list_ok"),
        F.when(F.coalesce(is_json & has & whole, F.lit(False)), F.transform(listed, lambda x: x.cast("int")))
        .otherwise(F.array().cast("array<int>")).alias("selected_indices"),
        F.when(F.coalesce(F.array_contains(keys, "reasoning"), F.lit(False)), F.element_at(F.element_at("_m", 1), F.lit("reasoning")))
        .otherwise(F.lit(NO_REASON)).alias("reasoning"),
        F.coalesce(F.when(is_json, brk), F.create_map().cast("map<string,string>")).alias("category_breakdown"))


def validate_selection(parsed: DataFrame, num_candidates: Column) -> Column:
    """K6: a usable answer is JSON with a non-empty list of integers, all in [0, m). A null or
    non-integer index makes it unusable; a wrong length only warns (kept); duplicates are allowed."""
    idx = F.col("selected_indices")
    return F.coalesce(F.col("is_json") & F.col("list_ok") & (F.size(idx) > 0) & (F.array_min(idx) >= 0)
                      & (F.array_max(idx) < num_candidates), F.lit(False))


def _as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def resolve_selection(parsed: DataFrame, num_candidates: int | Column, num_to_select: int, seed: int = 42,
                      iteration: int | Column = 0, key_col: str = "batch") -> DataFrame:
    """K6 + E3: keep a valid answer; otherwise ``min(n, m)`` random candidate positions (hash
    order of ``seed:fallback:iteration:key:position``), the fixed fallback reason and an empty
    breakdown. ``num_candidates`` is each batch's own count (a column or one number). Array
    functions over the m positions of each answer row; no shuffle."""
    m, it = _as_column(num_candidates).cast("int"), _as_column(iteration).cast("string")
    valid = validate_selection(parsed, m)
    keyed = F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.struct(
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.concat(F.lit("fallback:"), it), F.col(key_col).cast("string"),
                          i.cast("string"))).alias("h"), i.alias("i")))
    fallback = F.when(m > 0, F.transform(F.slice(F.array_sort(keyed), 1, num_to_select), lambda s: s["i"])) \
        .otherwise(F.array().cast("array<int>"))
    return parsed.select(
        "*", valid.alias("valid"),
        F.when(valid, F.col("selected_indices")).otherwise(fallback).alias("final_indices"),
        F.when(valid, F.col("reasoning")).otherwise(F.lit(FALLBACK_REASON)).alias("final_reasoning"),
        F.when(valid, F.col("category_breakdown")).otherwise(
            F.create_map().cast("map<string,string>")).alias("final_breakdown"))


def resolve_attempts(parsed: DataFrame, num_candidates: int | Column, num_to_select: int, seed: int = 42,
                     iteration: int | Column = 0, batch_col: str = "batch", attempt_col: str = "attempt") -> DataFrame:
    """K6 with several attempts per batch: the first valid attempt counts; if none is valid, the
    fallback. One row per batch. Attempts per batch are few (the caller's retry limit)."""
    tried = parsed.withColumn("_ok", validate_selection(parsed, _as_column(num_candidates).cast("int")))
    best = Window.partitionBy(batch_col).orderBy(F.desc("_ok"), F.asc(attempt_col))
    first = tried.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r", "_ok")
    return resolve_selection(first, num_candidates, num_to_select, seed, iteration, batch_col)


# ------------------------------------------------------------------ selector (K7)

def informativeness(candidates: DataFrame, current_dist: DataFrame, category_col: str = "category", text_col: str = "text",
                    weights=(0.4, 0.3, 0.2, 0.1)) -> DataFrame:
    """K7: candidates with their score: uncertainty, closeness of the two best classes, rarity of the
    category in the training set and length. Needs ``probs`` (class probabilities)."""
    w_unc, w_bnd, w_rare, w_len = weights
    k = F.size("probs")
    ent = -F.aggregate("probs", F.lit(0.0), lambda a, p: a + F.when(p > 0, p * F.log(p)).otherwise(F.lit(0.0)))
    unc = F.when(k > 1, ent / F.log(k.cast("double"))).otherwise(F.lit(0.0))
    srt = F.sort_array("probs", asc=False)
    margin = F.when(k > 1, srt[0] - srt[1]).otherwise(F.lit(1.0))
    dist = current_dist.select(F.col("distribution").alias("_cur"))
    total = F.aggregate(F.map_values("_cur"), F.lit(0).cast("long"), lambda a, b: a + b)
    share = F.coalesce(F.element_at("_cur", F.col(category_col)).cast("double") / F.greatest(total, F.lit(1)), F.lit(0.0))
    words = F.size(F.split(F.trim(F.coalesce(F.col(text_col), F.lit(""))), r"\s+"))
    quality = F.least(F.lit(1.0), F.log1p(words.cast("double")) / F.log1p(F.lit(200.0)))
    # rounded to 12 places: equal texts get equal scores in every engine, ties then go to local_idx
    return candidates.crossJoin(F.broadcast(dist)).withColumn(
        "informativeness", F.round(F.lit(w_unc) * unc + F.lit(w_bnd) * (1 - margin) + F.lit(w_rare) * (1 - share)
                                   + F.lit(w_len) * quality, 12)).drop("_cur")


def rank_informative(candidates: DataFrame, n: int, current_dist: DataFrame,
                     category_col: str = "category", text_col: str = "text",
                     weights=(0.4, 0.3, 0.2, 0.1), group_cols: list[str] | None = None) -> DataFrame:
    """K7: score candidates and keep the n best per batch (``pick_pos`` 0..n-1).

    Needs ``probs`` (class probabilities) on the candidates."""
    scored = informativeness(candidates, current_dist, category_col, text_col, weights)
    g = list(group_cols or [])
    w = (Window.partitionBy(*g) if g else Window.partitionBy()).orderBy(F.desc("informativeness"), F.asc("local_idx"))
    return scored.withColumn("pick_pos", F.row_number().over(w) - 1).filter(F.col("pick_pos") < n)


def rank_diverse(candidates: DataFrame, n: int, current_dist: DataFrame, category_col: str = "category", text_col: str = "text",
                 weights=(0.4, 0.3, 0.2, 0.1), group_cols: list[str] | None = None, diversity: float = 0.5) -> DataFrame:
    """K7 with variety inside the categories: farthest-first picks per batch (``pick_pos`` 0..n-1).

    Every step takes the candidate with the largest ``informativeness + diversity * novelty``, where
    novelty is the Jaccard distance of its distinct words to the nearest pick of its own category (1
    before the first; the column shows it as it was when picked). A candidate with the very words
    of a pick of its category (novelty 0) is taken only when no other is left. Ties go to the smaller
    ``local_idx``. A null or empty text has no words and equals another such text; null categories
    are a category of their own. A task holds one candidate batch, whose size the caller sets when
    it draws candidates (K3); batches spread over the cluster."""
    from ..functions.text import word_tokens
    from ..session import prepare_udfs
    prepare_udfs(candidates.sparkSession)
    g = list(group_cols or [])
    scored = informativeness(candidates, current_dist, category_col, text_col, weights)
    schema = T.StructType([*scored.schema.fields, T.StructField("novelty", T.DoubleType()), T.StructField("pick_pos", T.IntegerType())])
    words = F.array_distinct(word_tokens(F.coalesce(F.col(text_col), F.lit(""))))
    keyed = scored.withColumns({"_words": words, "_batch": F.struct(*g) if g else F.lit(0)})
    return keyed.groupBy("_batch").applyInArrow(_farthest_first(n, diversity, category_col), schema)


def _farthest_first(n: int, diversity: float, category_col: str):
    def run(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, [("local_idx", "ascending")]))
        m = t.num_rows
        score = t["informativeness"].to_numpy()
        category = t[category_col].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        words = t["_words"].combine_chunks()
        code = words.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(m), sizes)
        novelty, left, picks, seen = np.ones(m), np.ones(m, bool), [], []
        for _ in range(min(n, m)):
            value = np.round(score + diversity * novelty, 12)
            best = int(np.lexsort((np.arange(m), -value, novelty == 0, ~left))[0])
            picks.append(best)
            seen.append(novelty[best])
            left[best] = False
            held = np.zeros(int(code.max(initial=-1)) + 1, bool)
            held[code[owner == best]] = True
            common = np.bincount(owner, weights=held[code], minlength=m)
            union = sizes + sizes[best] - common
            far = np.where(union > 0, 1 - common / np.maximum(union, 1), 0.0)
            novelty = np.where(category == category[best], np.minimum(novelty, far), novelty)
        out = t.drop_columns(["_words", "_batch"]).take(pa.array(picks, pa.int64()))
        return out.append_column("novelty", pa.array(seen, pa.float64())).append_column("pick_pos", pa.array(range(len(picks)), pa.int32()))
    return run


def render_response(picks: DataFrame, category_col: str = "category", group_cols: list[str] | None = None) -> DataFrame:
    """The selector's answer as the fenced JSON text an external selector would return."""
    g = list(group_cols or [])
    agg = picks.groupBy(*g).agg(F.array_sort(F.collect_list(F.struct("pick_pos", "local_idx", category_col))).alias("_p"))
    idx = F.transform("_p", lambda s: s["local_idx"])
    cats = F.transform("_p", lambda s: s[category_col])
    breakdown = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(cats)), lambda c: F.struct(
        c, F.size(F.filter(cats, lambda x: x == c)).cast("int"))))
    js = F.to_json(F.struct(idx.alias("selected_indices"),
                            F.lit("highest informativeness score").alias("reasoning"),
                            breakdown.alias("category_breakdown")))
    return agg.select(*g, F.concat(F.lit(FENCE + "json\n"), js, F.lit("\n" + FENCE)).alias("response"))


# ------------------------------------------------------------------ one round and the loop (K1, K2)

class Selector(Protocol):
    """M3: picks from one round's candidates. Returns (pick_pos, row id, reasoning, breakdown)."""

    def select(self, candidates: DataFrame, current: DataFrame, iteration: int, n: int) -> DataFrame: ...


@dataclass
class InformativenessSelector:
    """The computed selector (K7); with ``diversity`` the picks also differ inside each category."""
    category_col: str = "category"
    text_col: str = "text"
    id_col: str = "row_id"
    reasoning: str = "highest informativeness score"
    diversity: float | None = None

    def select(self, candidates: DataFrame, current: DataFrame, iteration: int, n: int) -> DataFrame:
        if self.diversity is None:
            picks = rank_informative(candidates, n, current, self.category_col, self.text_col)
        else:
            picks = rank_diverse(candidates, n, current, self.category_col, self.text_col, diversity=self.diversity)
        return picks.select(F.col("pick_pos").cast("int"), F.col(self.id_col).cast("long").alias("row_id"),
                            F.lit(self.reasoning).alias("reasoning"), F.lit(None).cast("map<string,string>").alias("breakdown"))


@dataclass
class AnswerSelector:
    """Answers of an outside selector as a table ``(iteration, attempt, response)``: parsed, validated
    against the round's own candidates, the first valid attempt counts, else the random fallback
    (also for a round without any answer)."""
    answers: DataFrame
    id_col: str = "row_id"
    seed: int = 42

    def select(self, candidates: DataFrame, current: DataFrame, iteration: int, n: int) -> DataFrame:
        own = self.answers.filter(F.col("iteration") == iteration).select("attempt", "response")
        nothing = candidates.sparkSession.range(1).select(F.lit(1 << 30).alias("attempt"), F.lit("").alias("response"))
        m = candidates.agg(F.count(F.lit(1)).cast("int").alias("m"))  # one row
        parsed = parse_selection_response(own.unionByName(nothing), "response").crossJoin(F.broadcast(m)).withColumn("batch", F.lit(iteration))
        done = resolve_attempts(parsed, F.col("m"), n, self.seed, iteration)
        at = done.select(F.posexplode("final_indices").alias("pick_pos", "local_idx"), F.col("final_reasoning").alias("reasoning"),
                         F.col("final_breakdown").alias("breakdown"))
        return at.join(candidates.select("local_idx", F.col(self.id_col).cast("long").alias("row_id")), "local_idx") \
            .select("pick_pos", "row_id", "reasoning", "breakdown")


def active_learning_iteration(pool: DataFrame, log: DataFrame, iteration: int, samples_per_iteration: int = 20,
                              batch_size: int = 100, seed: int = 42, category_col: str = "category",
                              text_col: str = "text", id_col: str = "row_id", selector: Selector | None = None) -> DataFrame | None:
    """K2: D5 -> E2 -> selector -> D3; returns this round's log rows (None when nothing remains)."""
    remaining = remaining_pool(pool, log, id_col)
    cands = random_candidates(remaining, batch_size, id_col, seed, iteration)
    if cands.isEmpty():
        return None
    train = training_rows(pool, log, id_col)
    selector = selector or InformativenessSelector(category_col, text_col, id_col)
    picks = selector.select(cands, distribution_map(train, category_col), iteration, samples_per_iteration)
    return picks.select(F.lit(iteration).cast("int").alias("iteration"), "pick_pos", "row_id", "reasoning", "breakdown")


def _cut_lineage(df: DataFrame) -> DataFrame:
    """Write into the session's shared folder (reliable, survives executor loss) and read back. A
    checkpoint would keep the size estimate of its plan, which is that of the pool and more."""
    from ..session import write_table
    return write_table(df, "selection_log")


def active_learning_run(pool: DataFrame, initial_samples_per_class: int = 10, samples_per_iteration: int = 20,
                        num_iterations: int = 10, batch_size: int = 100, seed: int = 42,
                        category_col: str = "category", text_col: str = "text", id_col: str = "row_id",
                        categories: list[str] | None = None, selector: Selector | None = None) -> ActiveLearningResult:
    """K1: initial stratified sample, then up to ``num_iterations`` rounds of the selector; stops when
    the pool is empty. Pool rows need ``probs`` for the default selector."""
    init = initial_stratified_sample(pool, initial_samples_per_class, category_col, id_col, seed, categories)
    w = Window.partitionBy(category_col).orderBy(hash_key(seed, "initial", id_col), F.col(id_col))
    log = init.select(F.lit(0).alias("iteration"), (F.row_number().over(w) - 1).cast("int").alias("pick_pos"),
                      F.col(id_col).cast("long").alias("row_id"), F.lit(None).cast("string").alias("reasoning"),
                      F.lit(None).cast("map<string,string>").alias("breakdown"))
    log = _cut_lineage(log)
    for it in range(1, num_iterations + 1):
        new = active_learning_iteration(pool, log, it, samples_per_iteration, batch_size, seed,
                                        category_col, text_col, id_col, selector)
        if new is None:
            break
        log = _cut_lineage(log.unionByName(new))
    return result_of(pool, log, id_col, category_col)


def result_of(pool: DataFrame, log: DataFrame, id_col: str = "row_id", category_col: str = "category") -> ActiveLearningResult:
    """K9 from the pool and the selection log of a run."""
    state = apply_selection(pool, log, id_col)
    train = state.filter(F.col("selected"))
    return ActiveLearningResult(state, train, selection_history(pool, log, id_col, category_col),
                                distribution_map(train, category_col), log)


def selection_history(pool: DataFrame, log: DataFrame, id_col: str = "row_id", category_col: str = "category") -> DataFrame:
    """K8: one record per iteration >= 1: iteration, selected_indices, reasoning (the selector's own),
    selected_categories, category_breakdown (the selector's own, else counted)."""
    own = log.filter(F.col("iteration") >= 1)
    sc = selected_categories(pool, own, id_col, category_col)
    said = own.groupBy("iteration").agg(F.max_by("reasoning", -F.col("pick_pos")).alias("reasoning"),
                                        F.max_by("breakdown", -F.col("pick_pos")).alias("_said"))
    cats = F.col("selected_categories")
    counted = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(cats)), lambda c: F.struct(
        c, F.size(F.filter(cats, lambda x: x == c)).cast("string"))))
    return sc.join(said, "iteration").select("iteration", "selected_indices", "reasoning",
                                             "selected_categories", F.coalesce("_said", counted).alias("category_breakdown"))


def selection_summary(training: DataFrame, history: DataFrame, category_col: str = "category",
                      strategy: str | None = SUMMARY_STRATEGY) -> DataFrame:
    """``total_training_samples, final_distribution, num_iterations[, strategy]``; the
    distribution is filled only when a column literally named ``category`` exists."""
    if category_col == "category" and "category" in training.columns:
        dist = distribution_map(training, "category").select(F.col("distribution").alias("final_distribution"))
    else:
        dist = training.sparkSession.range(1).select(
            F.create_map().cast("map<string,bigint>").alias("final_distribution"))
    tot = training.agg(F.count(F.lit(1)).alias("total_training_samples"))
    its = history.agg(F.count(F.lit(1)).alias("num_iterations"))
    out = tot.crossJoin(dist).crossJoin(its)
    return out.withColumn("strategy", F.lit(strategy)) if strategy else out
