"""Further registered queries: dataset report, log flattening, names and keys.

The driver's tables have no evaluation logs; keys that the logs would carry are
derived from ids (stated in each query), and no row is dropped by them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from langmix.functions import text as tx
from langmix.operators import dist as D
from langmix.operators import entropy as E
from langmix.operators import lid
from langmix.operators import ml as ML
from langmix.operators import matrix as Mx
from langmix.operators import naming as N
from langmix.operators import overlap as O
from langmix.operators import prompts as C
from langmix.operators import segment
from langmix.operators import stats as S
from langmix.operators import typology as Y
from langmix.plans import inputs as I
from langmix.plans import oracle as SQL
from langmix.plans import queries as Q
from langmix.plans.oracle import ORACLES
from langmix.plans.queries import query
from langmix.session import cut_lineage
from langmix.sources import files as SRC
from langmix.sources.tables import SCHEMAS, load, spread
from langmix.streaming import incremental as R


def _side_lines(spark, sf):
    """Kept lines of predictions (replies) and references (user messages)."""
    pairs = C.reply_pairs(load(spark, sf, "conversations"))
    both = pairs.select("conv_id", "turn", F.explode(F.array(
        F.struct(F.lit("pred").alias("side"), F.col("output_text").alias("text")),
        F.struct(F.lit("labels").alias("side"), F.col("input_text").alias("text")))).alias("x"))
    return both.select("conv_id", "turn", "x.side", F.explode(tx.kept_lines(tx.normalize_completion("x.text"))).alias("line"))


@query("dataset_language_report")
def q_dataset_language_report(spark, sf):
    """Language shares of all predictions and all references, by line and by word."""
    lines = lid.label_column(_side_lines(spark, sf), "line", I.lid_model(spark, sf), mode="cascade", threshold=0.3)
    by_line = D.ratios(lines, ["side"]).withColumn("level", F.lit("line"))
    toks = I.labelled_tokens(lines.filter(F.col("pred_lang") != lid.UNKNOWN), spark, sf).filter(F.col("token_lang") != lid.UNKNOWN)
    by_word = D.ratios(toks, ["side"], "token_lang").withColumn("level", F.lit("word"))
    return by_line.unionByName(by_word).select("side", "level", "lang", "p")


ORACLES["dataset_language_report"] = SQL.with_(SQL.MODEL, SQL.PAIRS.strip().removeprefix("WITH")) + f""",
sd AS (SELECT 'pred' AS side, output_text AS t FROM pairs UNION ALL SELECT 'labels', input_text FROM pairs),
lines AS (SELECT side, unnest(list_filter(string_split({SQL.norm_sql('t')}, chr(10)), lambda x: length(x) > 5)) AS line FROM sd),
line_units AS (SELECT line AS unit FROM lines),""" + SQL.detect_sql("line_units", "line_lab") + f""",
ll AS (SELECT side, line, coalesce(pred_lang, 'unknown') AS lang FROM lines LEFT JOIN line_lab ON line = unit),
toks AS (SELECT side, unnest(regexp_extract_all(line, {SQL.WORD_RE})) AS token FROM ll WHERE lang <> 'unknown'),
tok_units AS (SELECT token AS unit FROM toks),""" + SQL.detect_sql("tok_units", "tok_lab") + """,
tl AS (SELECT side, pred_lang AS lang FROM toks JOIN tok_lab ON token = unit WHERE pred_lang <> 'unknown'),
c AS (SELECT 'line' AS level, side, lang, count(*) AS n FROM ll GROUP BY ALL
      UNION ALL SELECT 'word', side, lang, count(*) FROM tl GROUP BY ALL)
SELECT side, level, lang, round(n / sum(n) OVER (PARTITION BY side, level), 2) AS p FROM c QUALIFY p > 0"""


# the evaluation step of a completion, and its place in the log, come from its id
STEP_OF = "element_at(array('Labels', 'Base', 'Step1', 'Step50+sbeam8'), cast(pmod(floor(id / 4), 4) as int) + 1)"


@query("flattened_step_distributions")
def q_flattened_step_distributions(spark, sf):
    """D7 + D8: model -> evaluated language -> step -> distribution at both levels;
    completions of one (model, language, step) are evaluations in id order, of
    which the last one counts for Labels and the first one otherwise."""
    # read twice below: for the evaluations that stand, and for their rows
    d = cut_lineage(D.prune(Q.both_dists(spark, sf)).withColumn("step", F.expr(STEP_OF)))
    flat = N.flatten_steps(d, ["level", "model", "language"], "step", "id")
    return flat.select("level", "model", F.col("language").alias("eval_lang"), "step", "id", "lang", "p")


ORACLES["flattened_step_distributions"] = SQL._BD + """,
d AS (SELECT *, ['Labels', 'Base', 'Step1', 'Step50+sbeam8'][(id // 4) % 4 + 1] AS step
      FROM both_dist WHERE lang NOT IN ('unknown', 'others') AND p > 0.05)
SELECT level, model, language AS eval_lang, step, id, lang, p
FROM (SELECT *, min(id) OVER w AS lo, max(id) OVER w AS hi FROM d WINDOW w AS (PARTITION BY level, model, language, step))
WHERE id = CASE WHEN step = 'Labels' THEN hi ELSE lo END"""

O5_LANGS = ("deu", "fra", "spa")


@query("token_metric_matrix")
def q_token_metric_matrix(spark, sf):
    """Token-set F1 x 100 (two decimals) by step, model and evaluated language
    (columns in fixed order, rows by rank).  Model, language and step of a reply
    come from its conversation and turn."""
    s = O.token_set_scores(Q._pairs(spark, sf), Q.PAIR_KEYS)
    s = s.select(F.concat(F.lit("m"), F.pmod("conv_id", F.lit(4)).cast("string")).alias("model"),
                 F.element_at(F.array(*[F.lit(x) for x in O5_LANGS]), (F.pmod("conv_id", F.lit(3)) + 1).cast("int")).alias("eval_lang"),
                 F.when(F.col("turn") <= 1, "Base").otherwise("Step1").alias("step"), "f1")
    m = s.groupBy("step", "model").pivot("eval_lang", list(O5_LANGS)).agg(F.round(F.avg("f1") * 100, 2))
    rank = F.when(F.col("step") == "Base", 0).otherwise(4) + F.substring("model", 2, 1).cast("int")
    return m.select("step", "model", *O5_LANGS, rank.cast("int").alias("row_order"))


ORACLES["token_metric_matrix"] = SQL.with_(SQL.PAIR_SCORES.strip().removeprefix("WITH")) + """,
k AS (SELECT 'm' || (conv_id % 4)::VARCHAR AS model, ['deu', 'fra', 'spa'][conv_id % 3 + 1] AS eval_lang,
             CASE WHEN turn <= 1 THEN 'Base' ELSE 'Step1' END AS step, f1 FROM scores)
SELECT step, model, round(avg(CASE WHEN eval_lang = 'deu' THEN f1 END) * 100, 2) AS deu,
       round(avg(CASE WHEN eval_lang = 'fra' THEN f1 END) * 100, 2) AS fra, round(avg(CASE WHEN eval_lang = 'spa' THEN f1 END) * 100, 2) AS spa,
       CAST(CASE WHEN step = 'Base' THEN 0 ELSE 4 END + substr(model, 2, 1)::INT AS INTEGER) AS row_order
FROM k GROUP BY step, model"""

# fixed values: model names as the logs write them; a document's name is chosen by its id
LOG_NAMES = ("owner/mt5_me5_pan_Guru_32_2layers_inverter", "mt5_me5_deu_tur_32_2layers_corrector", "mt5_me5_ara-script_32_2layers_inverter",
             "mt5_me5_turkic-fami_32_2layers_corrector", "owner/mt5_gtr_deu_Latn_32_corrector", "mt5_alephbert_heb_Hebr_32_inverter",
             "mt5_me5_semitic-fami_32_2layers_inverter")


@query("model_key_training")
def q_model_key_training(spark, sf):
    """T9 + D9: normalised model name of every document's log name and its training
    languages; names that no rule knows are left out by D9 and counted as such."""
    names = F.element_at(F.array(*[F.lit(x) for x in LOG_NAMES]), (F.pmod("doc_id", F.lit(len(LOG_NAMES))) + 1).cast("int"))
    d = load(spark, sf, "documents").select(N.normalise_model(names).alias("model"))
    return d.groupBy("model").agg(F.count(F.lit(1)).alias("n")).select(
        "model", F.array_join(N.training_languages(F.col("model")), ",").alias("training"), "n")


ORACLES["model_key_training"] = """
SELECT k.model, k.training, count(*) AS n FROM documents JOIN (VALUES
  (0, 'me5_pan_Guru', 'pan_Guru'), (1, 'me5_deu_tur', 'deu_Latn,tur_Latn'), (2, 'me5_arab-script', 'arb_Arab,heb_Hebr'),
  (3, 'me5_turkic-fami', 'tur_Latn,kaz_Cyrl'), (4, 'gtr_deu_Latn', 'deu_Latn'), (5, 'alephbert_heb_Hebr', 'heb_Hebr'),
  (6, 'me5_semitic-fami', NULL)) k(i, model, training) ON doc_id % 7 = k.i GROUP BY k.model, k.training"""


@query("composite_key_parts")
def q_composite_key_parts(spark, sf):
    """Five parts of the key ``idx_llm_task_lang_source`` of every document;
    the source of several words is chosen by the id."""
    source = F.element_at(F.array(*[F.lit(x) for x in (*N.MULTI_WORD_SOURCES, "okapi")]), (F.pmod("doc_id", F.lit(5)) + 1).cast("int"))
    key = F.concat_ws("_", F.col("doc_id").cast("string"), F.concat(F.lit("m"), F.pmod("doc_id", F.lit(4)).cast("string")),
                      F.when(F.col("doc_id") % 2 == 0, "mono").otherwise("cross"), "lang", source)
    return load(spark, sf, "documents").select("doc_id", *N.split_key(key))


ORACLES["composite_key_parts"] = """
SELECT doc_id, doc_id::VARCHAR AS idx, 'm' || (doc_id % 4)::VARCHAR AS llm, CASE WHEN doc_id % 2 = 0 THEN 'mono' ELSE 'cross' END AS task,
       lang, ['complex-prompts', 'dolly-human-edited', 'aya-human-annotated', 'native-prompts', 'okapi'][doc_id % 5 + 1] AS source
FROM documents"""


@query("edge_feature_mean")
def q_edge_feature_mean(spark, sf):
    """For every supplier, the mean normalised PMI between its nation and two
    'training' nations (by nation key), -1 if none of the edges exists."""
    n = load(spark, sf, "nation").select("n_nationkey", "n_name")
    names = n.agg(F.map_from_entries(F.collect_list(F.struct("n_nationkey", "n_name")))).scalar()  # one entry per nation
    s = load(spark, sf, "supplier").select("s_suppkey", "s_nationkey").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    at = lambda k: F.element_at(names, F.pmod(F.col("s_nationkey") + k, F.lit(25)).cast(n.schema["n_nationkey"].dataType))
    units = s.select("s_suppkey", F.col("n_name").alias("eval"), F.array(at(1), at(7)).alias("training"))
    edges = Q.QUERIES["cooccurrence_pmi"](spark, sf).select("a", "b", "pmi_norm")
    return N.edge_feature_mean(units, ["s_suppkey"], "training", "eval", edges, "pmi_norm").select(
        "s_suppkey", F.round("pmi_norm", 6).alias("pmi_norm"))


ORACLES["edge_feature_mean"] = "WITH edges AS (" + ORACLES["cooccurrence_pmi"] + """),
t AS (SELECT s.s_suppkey, n.n_name AS e, t.n_name AS t FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey
      JOIN nation t ON t.n_nationkey IN ((s.s_nationkey + 1) % 25, (s.s_nationkey + 7) % 25))
SELECT s_suppkey, round(coalesce(avg(pmi_norm), -1.0), 6) AS pmi_norm
FROM t LEFT JOIN edges ON a = least(t.e, t.t) AND b = greatest(t.e, t.t) GROUP BY s_suppkey"""


@query("step_one_hot")
def q_step_one_hot(spark, sf):
    """The evaluation step of every completion as 0/1 columns."""
    d = I.completions(spark, sf).select("id", F.expr(STEP_OF).alias("step"))
    d = d.withColumn("step", F.regexp_replace("step", r"\+", "_"))
    return N.one_hot(d, "step", ("Base", "Labels", "Step1", "Step50_sbeam8"), "step_").drop("step")


ORACLES["step_one_hot"] = "SELECT doc_id AS id, " + ", ".join(
    f"CAST((doc_id // 4) % 4 = {k} AS INTEGER) AS step_{n}" for k, n in enumerate(("Labels", "Base", "Step1", "Step50_sbeam8"))) + " FROM documents"


@query("pass_rate_strings")
def q_pass_rate_strings(spark, sf):
    """The rolled-up pass rates as text with two significant digits."""
    r = Q.QUERIES["line_pass_rate"](spark, sf)
    return r.select("task", "model", "source", "language", *[N.two_digits(F.col(c)).alias(c) for c in ("acc", "lpr", "wpr")])


def _digits_sql(c: str) -> str:
    scale = f"pow(10.0, 1 - floor(log10({c})))"
    return f"CASE WHEN {c} = 0 THEN '0.0' ELSE CAST(round({c} * {scale}) / {scale} AS VARCHAR) END AS {c}"


ORACLES["pass_rate_strings"] = "SELECT task, model, source, language, " + ", ".join(_digits_sql(c) for c in ("acc", "lpr", "wpr")) + \
    " FROM (" + ORACLES["line_pass_rate"] + ")"


@query("share_means_by_training")
def q_share_means_by_training(spark, sf):
    """O6, second half: mean language shares by (training set, task), unpivoted."""
    langs = ["de", "en", "es", "fr"]
    wide = D.widen(Q.line_dist(spark, sf), ["id", "task", "model"], langs)
    key = F.array_join(F.array_sort(I.training_of(F.col("model"))), "_")
    long = wide.select(key.alias("training"), "task", *langs).unpivot(["training", "task"], langs, "lang", "share")
    return long.groupBy("training", "task", "lang").agg(F.round(F.avg("share"), 6).alias("mean_share"))


ORACLES["share_means_by_training"] = SQL._LD + f""",
u AS (SELECT DISTINCT id, task, array_to_string(list_sort({SQL.train_list()}), '_') AS training FROM line_dist),
g AS (SELECT u.*, l.lang FROM u, (SELECT unnest(['de', 'en', 'es', 'fr']) AS lang) l)
SELECT g.training, g.task, g.lang, round(avg(coalesce(d.p, 0.0)), 6) AS mean_share
FROM g LEFT JOIN line_dist d ON d.id = g.id AND d.lang = g.lang GROUP BY ALL"""


@query("kmeans_centres")
def q_kmeans_centres(spark, sf):
    """Centres of the k-means models (k = 3 and 6) of the embeddings."""
    return Q._kmeans(spark, sf).centre_rows(spark).withColumn("value", F.round("value", 6))


_KMEANS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL),
far AS (
  SELECT 1 AS n, [arg_min(e, vec_id)] AS cs FROM v
  UNION ALL
  SELECT far.n + 1, list_append(any_value(far.cs), arg_max(v.e, {'d': list_min(list_transform(far.cs, lambda c: round(list_distance(c, v.e) ** 2, 9))), 'k': -v.vec_id}))
  FROM far, v WHERE far.n < 6 GROUP BY far.n),
lloyd AS (
  SELECT 0 AS r, n AS k, cs FROM far WHERE n IN (3, 6)
  UNION ALL
  SELECT r + 1, k, list_transform(range(k), lambda c: coalesce(map_from_entries(new)[c], old[c + 1])) FROM (
    SELECT r, k, list((cl, e)) AS new, any_value(old) AS old FROM (
      SELECT r, k, cl, list(x ORDER BY dim) AS e, any_value(old) AS old FROM (
        SELECT r, k, cl, dim, avg(x) AS x, any_value(old) AS old FROM (
          SELECT r, k, cl, unnest(range(len(e))) AS dim, unnest(e) AS x, old FROM (
            SELECT r, k, v.e, cs AS old, list_position(ds, list_min(ds)) - 1 AS cl FROM (
              SELECT lloyd.*, v.*, list_transform(cs, lambda c: round(list_distance(c, v.e) ** 2, 9)) AS ds FROM lloyd, v WHERE r < 10) v))
        GROUP BY r, k, cl, dim) GROUP BY r, k, cl) GROUP BY r, k)),
model AS (SELECT k, cs FROM lloyd WHERE r = 10)"""

ORACLES["kmeans_centres"] = _KMEANS_SQL + """
SELECT CAST(k AS INTEGER) AS k, CAST(c AS INTEGER) AS cluster, CAST(f AS INTEGER) AS feature, round(value, 6) AS value FROM (
  SELECT k, c, unnest(range(len(e))) AS f, unnest(e) AS value FROM (SELECT k, unnest(range(k)) AS c, unnest(cs) AS e FROM model))"""

ORACLES["kmeans_embeddings"] = _KMEANS_SQL + """
SELECT vec_id, CAST(k AS INTEGER) AS k, CAST(list_position(ds, list_min(ds)) - 1 AS INTEGER) AS cluster FROM (
  SELECT vec_id, k, list_transform(cs, lambda c: round(list_distance(c, e) ** 2, 9)) AS ds FROM model, v)"""


@query("subset_ablation")
def q_subset_ablation(spark, sf):
    """M7 + M8: mean error of forests that predict language shares, for every subset
    of three features beside the base one, for even and odd completions ('mono' and
    'cross'), aligned and sorted."""
    data = Q._forest_data(spark, sf)
    found = {}
    for name, part in (("mono", data.where("id % 2 = 0")), ("cross", data.where("id % 2 = 1"))):
        train, test = Y.hash_split(part, "id", 80)
        found[name] = ML.subset_ablation(train, test, ["n_chars"], ["n_lines", "quality", "toxic"], ["de", "en"], "id")
    return ML.collect_ablations(found, "cross")


@query("training_multi_hot")
def q_training_multi_hot(spark, sf):
    """A 0/1 column for each training language of a completion's model."""
    c = I.completions(spark, sf)
    return c.select("id", *[F.array_contains("training", x).cast("int").alias(f"train_{x}") for x in ("de", "en", "es", "fr")])


ORACLES["training_multi_hot"] = "SELECT id, " + ", ".join(
    f"CAST(list_contains({SQL.train_list()}, '{x}') AS INTEGER) AS train_{x}" for x in ("de", "en", "es", "fr")) + \
    " FROM (SELECT doc_id AS id FROM documents)"


@query("price_box_summary")
def q_price_box_summary(spark, sf):
    """Percentiles of the extended price (nearly all values distinct) per return flag."""
    return S.box_summary(Q._load(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice")


ORACLES["price_box_summary"] = "SELECT l_returnflag, " + ", ".join(
    f"round(quantile_cont(CAST(l_extendedprice AS DOUBLE), {q}), 6) AS p{round(100 * q):02d}" for q in S.BOX_QUANTILES) + \
    " FROM lineitem GROUP BY 1"


@query("part_label_codes")
def q_part_label_codes(spark, sf):
    """Y11 on many values: the place of every part's price among all prices."""
    return Y.label_encode(Q._load(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_retailprice", "code").select("p_partkey", "code")


ORACLES["part_label_codes"] = "SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_retailprice) - 1 AS BIGINT) AS code FROM part"


def _stream_of(sf: str) -> str:
    return f"{sf.rstrip('/')}/documents.parquet*"  # the table may be a folder of files or one file


@query("incremental_language_totals")
def q_incremental_language_totals(spark, sf):
    """R1 + S13, stateful: lines and tokens by (level, language) of the documents that
    arrive as a stream of files; the counts live in the state store."""
    folder = R.stream_folder(spark, "totals")

    def rows_of(stream):
        model = I.lid_model(spark, sf)
        # a batch is a few files: its rows are dealt out to every core
        dealt = stream.repartition(spark.sparkContext.defaultParallelism)
        lines = lid.label_column(I.distribution_lines(I.completions_from(dealt)), "line", model, mode="cascade", threshold=0.3)
        toks = lid.label_array(lines.select("pred_lang", tx.tokenize("line").alias("tokens")), "tokens", model, mode="cascade", threshold=0.3)
        both = F.concat(F.array(F.struct(F.lit("line").alias("level"), F.col("pred_lang").alias("lang"))),
                        F.transform("langs", lambda x: F.struct(F.lit("word").alias("level"), x.alias("lang"))))
        return toks.select(F.explode(both).alias("x")).select("x.level", "x.lang")

    R.run_counts(spark, _stream_of(sf), SCHEMAS["documents"], f"{folder}/sink", f"{folder}/ckpt", rows_of, ["level", "lang"])
    return R.latest(spark, f"{folder}/sink").select("level", "lang", "n")


ORACLES["incremental_language_totals"] = SQL.with_(SQL.COMPLETIONS, SQL.MODEL, SQL.LABELLED_LINES, SQL.LABELLED_TOKENS) + """
SELECT 'line' AS level, pred_lang AS lang, count(*) AS n FROM llines GROUP BY ALL
UNION ALL SELECT 'word', token_lang, count(*) FROM ltoks GROUP BY ALL"""


@query("incremental_group_entropy")
def q_incremental_group_entropy(spark, sf):
    """R1 for E12: mean line entropy by (model, source, language, task), kept current by
    partial counts and sums of each batch of files."""
    model, folder, keys = I.lid_model(spark, sf), R.stream_folder(spark, "entropy"), ["model", "source", "language", "task"]

    def transform(batch):
        lab = lid.label_column(I.distribution_lines(I.completions_from(batch)), "line", model, mode="cascade", threshold=0.3)
        d = D.ratios(lab, I.UNIT_KEYS).withColumn("expected", F.col("language"))
        ent = E.entropies(d, I.UNIT_KEYS, "expected", None, variants=["reweighted_entropy_expected"], decimals=None)
        return R.partial_means(ent.withColumnRenamed("reweighted_entropy_expected", "h"), keys, ["h"])

    R.run_incremental(spark, _stream_of(sf), SCHEMAS["documents"], f"{folder}/sink", f"{folder}/ckpt", transform)
    return R.merged_means(R.read_sink(spark, f"{folder}/sink"), keys, ["h"]).select(*keys, F.round("h", 6).alias("entropy"))


ORACLES["incremental_group_entropy"] = SQL._LD + """,
ent AS (SELECT id, model, task, source, language, sum(-(CASE WHEN lang = language THEN 1 - p ELSE p END) * ln(p)) AS h
        FROM line_dist GROUP BY ALL)
SELECT model, source, language, task, round(avg(h), 6) AS entropy FROM ent GROUP BY ALL"""


@query("spaceless_tokens")
def q_spaceless_tokens(spark, sf):
    """Tokens of every document, where German stands for a language written without
    spaces: its letters are run together and split again by the unigram model learned
    from the documents' own words; other languages are split as usual."""
    d = spread(load(spark, sf, "documents")).select("doc_id", "lang", F.lower("text").alias("t"))
    words = F.regexp_extract_all("t", F.lit(r"\p{L}+"), 0)
    model = segment.learn(d.where("lang = 'de'").select(F.explode(words).alias("w")), "w")
    lines = F.transform(F.split("t", "\n"), lambda x: F.regexp_replace(x, r"[^\p{L}]+", ""))
    run = F.when(F.col("lang") == "de", F.array_join(lines, " ")).otherwise(F.col("t"))
    out = segment.tokens_by_language(d.select("doc_id", "lang", run.alias("t"), F.size(words).alias("n_words")), "t", "lang", model, ["de"])
    return out.select("doc_id", "lang", "n_words", F.size("tokens").alias("n_tokens"))


@query("page_hosts")
def q_page_hosts(spark, sf):
    """K8: the first page (by id) of each host, as labels are deduplicated before matrices align."""
    p = load(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1).alias("host"), F.length("html").alias("size"))
    return D.keep_one(p, ["host"], "page_id").select("host", "page_id", "size")


ORACLES["page_hosts"] = r"""
SELECT host, page_id, size FROM (
  SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, CAST(length(html) AS INTEGER) AS size FROM pages)
QUALIFY row_number() OVER (PARTITION BY host ORDER BY page_id) = 1"""


@query("page_name_parts")
def q_page_name_parts(spark, sf):
    """T11 + T12: three-part names ``measure_source_language_Script`` made of a page's scheme,
    first host label and language folder, and their parts."""
    at = lambda k: F.regexp_extract("url", r"^([a-z]+)://([^./]*)[^/]*(?:/([a-z]{2})(?=[/?#]|$))?", k)
    name = F.concat_ws("_", at(1), at(2), F.when(at(3) != "", at(3)).otherwise("und"), F.lit("Latn"))
    p = load(spark, sf, "pages").select("page_id", name.alias("name"))
    part = lambda k: F.split_part("name", F.lit("_"), F.lit(k))
    code = F.concat_ws("_", part(3), part(4))
    return p.select("page_id", part(1).alias("measure"), part(2).alias("source"), part(3).alias("language"),
                    tx.lang_part(code).alias("lang"), tx.script_part(code).alias("script"))


ORACLES["page_name_parts"] = r"""
SELECT page_id, p[1] AS measure, p[2] AS source, l AS language, l AS lang, 'Latn' AS script FROM (
  SELECT page_id, [regexp_extract(url, '^([a-z]+)://([^./]*)', 1), regexp_extract(url, '^([a-z]+)://([^./]*)', 2)] AS p,
         coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/]*/([a-z][a-z])([/?#]|$)', 1), ''), 'und') AS l FROM pages)"""


@query("restricted_confusion")
def q_restricted_confusion(spark, sf):
    """K7, second half (+ S12): the confusion matrix restricted to the training languages
    of the models, written as JSON lines and read again."""
    labels = I.completions(spark, sf).select(F.explode("training").alias("label")).where("label <> 'es'")
    m = Mx.restrict(Q._confusion(spark, sf, materialize=True), labels).select("row", "col", F.round("value", 6).alias("value"))
    path = R.stream_folder(spark, "matrix") + "/confusion_json"
    SRC.write_json(m, path)
    return spark.read.schema("row string, col string, value double").json(path)


ORACLES["restricted_confusion"] = "SELECT * FROM (" + ORACLES["confusion_matrix"] + """) WHERE "row" IN ('de', 'en', 'fr') AND col IN ('de', 'en', 'fr')"""
