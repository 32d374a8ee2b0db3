"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the driver tables (or data Spark derives from them) in
full; floating results are rounded to 6 decimals and every computed column is
aliased, so the DuckDB oracle in :mod:`langmix.plans.oracle` can be compared
column by column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from langmix.operators import dist as D
from langmix.operators import entropy as E
from langmix.operators import lid
from langmix.plans import inputs as I

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------- LID ------

@query("lid_profile")
def q_lid_profile(spark, sf):
    """Trigram profile (lang, gram, cnt, weight) learned from labelled documents."""
    return I.lid_model(spark, sf).profile.select(
        "lang", "gram", F.col("cnt").cast("bigint").alias("cnt"), "weight")


@query("lid_stopwords")
def q_lid_stopwords(spark, sf):
    """The 30 most frequent words of each language (a report)."""
    return lid.stopword_lists(_load(spark, sf, "documents"))


@query("line_language")
def q_line_language(spark, sf):
    """Cascade label (threshold 0.3) of every kept line of every completion."""
    return I.labelled_lines(spark, sf).select("id", F.col("indice").cast("bigint").alias("indice"),
                                              "pred_lang")


@query("line_language_strict")
def q_line_language_strict(spark, sf):
    """L1: cascade at 0.6; secondary labels outside the mapped codes -> 'others'."""
    m = I.lid_model(spark, sf)
    lines = I.distribution_lines(I.completions(spark, sf))
    out = lid.label_column(lines, "line", m, mode="cascade", threshold=0.6,
                           code_map={"de": "de", "en": "en"}, unmapped=lid.OTHERS)
    return out.select("id", F.col("indice").cast("bigint").alias("indice"), "pred_lang")


@query("line_language_single")
def q_line_language_single(spark, sf):
    """L3: single detector, label if confidence > 0.3 else unknown, on pass-rate lines."""
    lines = I.pass_rate_lines(I.completions(spark, sf))
    out = lid.label_column(lines, "line", I.lid_model(spark, sf), mode="single", threshold=0.3)
    return out.select("id", F.col("line_no").cast("bigint").alias("line_no"), "pred_lang")


@query("tokens_by_language")
def q_tokens_by_language(spark, sf):
    """Number of tokens per (unit, token language), unknown included."""
    raw = I.distribution_lines(I.completions(spark, sf))
    toks = I.labelled_tokens(raw, spark, sf)
    return toks.groupBy("id", F.col("token_lang").alias("lang")).agg(F.count(F.lit(1)).alias("n_tokens"))


# ------------------------------------------------------- distributions -----

def line_dist(spark, sf) -> DataFrame:
    return D.ratios(I.labelled_lines(spark, sf), I.UNIT_KEYS)


def word_dist(spark, sf) -> DataFrame:
    return D.ratios(I.label_counts(I.labelled_lines(spark, sf), spark, sf), I.UNIT_KEYS, "lang", "n")


def both_dists(spark, sf) -> DataFrame:
    """D1 and D2 in one long table with a ``level`` column: every line is read and
    labelled once for both."""
    counts = I.label_counts(I.labelled_lines(spark, sf), spark, sf, line_level=True)
    return D.ratios(counts, ["level", *I.UNIT_KEYS], "lang", "n").select(*I.UNIT_KEYS, "lang", "p", "level")


@query("line_distribution")
def q_line_distribution(spark, sf):
    """D1."""
    return line_dist(spark, sf).select("id", "lang", "p")


@query("word_distribution")
def q_word_distribution(spark, sf):
    """D2."""
    return word_dist(spark, sf).select("id", "lang", "p")


# ------------------------------------------------------------- entropy -----

@query("entropy_by_group")
def q_entropy_by_group(spark, sf):
    """Flagship (E5 + E12): reweighted entropy per completion at line and word
    level, averaged by (model, source, language, task) in one aggregation."""
    d = both_dists(spark, sf)
    ent = E.entropies(d.withColumn("expected", F.col("language")),
                      ["level"] + I.UNIT_KEYS, "expected", None,
                      variants=["reweighted_entropy_expected"], decimals=None)
    h = F.col("reweighted_entropy_expected")
    return (ent.groupBy("model", "source", "language", "task")
            .agg(F.round(F.avg(F.when(F.col("level") == "line", h)), 6).alias("line_reweighted_entropy"),
                 F.round(F.avg(F.when(F.col("level") == "word", h)), 6).alias("word_reweighted_entropy")))


def _with_expected(d: DataFrame) -> DataFrame:
    return d.withColumn("expected", F.col("language")).withColumn(
        "training", I.training_of(F.col("model")))


@query("pruned_distribution")
def q_pruned_distribution(spark, sf):
    """D3 on line distributions: drop unknown/others and p <= 0.05."""
    return D.prune(line_dist(spark, sf)).select("id", "lang", "p")


@query("unknown_mass")
def q_unknown_mass(spark, sf):
    """D3 then D4: residual mass ``unk = round(1 - sum, 2)`` added when positive,
    1 for completions without any kept language."""
    units = I.completions(spark, sf).select("id")
    return D.complete_unknown(D.prune(line_dist(spark, sf)), ["id"], units).select("id", "lang", "p")


@query("widened_distribution")
def q_widened_distribution(spark, sf):
    """One column per target language (missing 0) and ``other = 1 - sum``."""
    units = I.completions(spark, sf).select("id")
    return D.widen(line_dist(spark, sf), ["id"], ["de", "en", "es", "fr"], units)


@query("langset_frequency")
def q_langset_frequency(spark, sf):
    """Frequency of (sorted predicted-language set + expected language)."""
    return D.lang_set_frequency(line_dist(spark, sf), I.UNIT_KEYS, "language")


@query("multi_language_units")
def q_multi_language_units(spark, sf):
    """Completions whose line distribution has more than one language."""
    return D.multi_language_units(line_dist(spark, sf), ["id"]).select(
        "id", F.col("n_langs").cast("bigint").alias("n_langs"))


@query("extra_languages")
def q_extra_languages(spark, sf):
    """Predicted languages outside training and expected, sets without English."""
    d = _with_expected(word_dist(spark, sf))
    out = D.extra_languages(d, ["id", "expected", "training"], "expected", "training")
    return out.select("id", F.array_join("extra", "_").alias("extra"))


@query("lang_unit_ranking")
def q_lang_unit_ranking(spark, sf):
    """Number of completions per predicted language (word level)."""
    return D.unit_ranking(word_dist(spark, sf))


@query("off_target_by_task")
def q_off_target_by_task(spark, sf):
    """Mean probability of off-target languages per task ('step'); kept
    when present in every task with mean > 0.01."""
    d = _with_expected(line_dist(spark, sf))
    out = D.off_target(d, "expected", "training", "task", n_steps=2)
    return out.select("lang", "task", F.round("mean_p", 6).alias("mean_p"))


@query("probability_pool")
def q_probability_pool(spark, sf):
    """Pooled probabilities per language (p >= 0.01) at word level."""
    return D.probability_pool(word_dist(spark, sf)).select(
        "lang", F.col("n").cast("bigint").alias("n"), "mean_p", "max_p")


@query("entropy_variants")
def q_entropy_variants(spark, sf):
    """E1-E6 for every completion at line and word level (one aggregation)."""
    d = _with_expected(both_dists(spark, sf))
    ent = E.entropies(d, ["level", "id"], "expected", "training")
    return ent.drop("expected", "training")


@query("entropy_by_language_task")
def q_entropy_by_language_task(spark, sf):
    """E9 (+E14 flag): mean training-aware reweighted entropy by expected
    language x task (task plays the step), line level, long form."""
    d = _with_expected(line_dist(spark, sf))
    ent = E.entropies(d, ["id", "task"], "expected", "training", variants=["reweighted_entropy"], decimals=None)
    return E.mean_by(ent, ["expected", "task"], ["reweighted_entropy"])


@query("entropy_by_training_language")
def q_entropy_by_training_language(spark, sf):
    """Mean weighted entropy by sorted training-set key and by single
    training language (exploded), word level."""
    d = _with_expected(word_dist(spark, sf))
    ent = E.entropies(d, ["id"], "expected", "training", variants=["weighted_entropy"], decimals=None)
    # both kinds of key in one pass: the lines are labelled once
    entry = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    every = F.concat(F.array(entry("set", E.training_key())), F.transform("training", lambda x: entry("single", x)))
    return E.mean_by(ent.select(F.explode(every).alias("_x"), "weighted_entropy").select("_x.*", "weighted_entropy"),
                     ["kind", "key"], ["weighted_entropy"])


@query("token_norm_entropy")
def q_token_norm_entropy(spark, sf):
    """Base-2 entropy of the normalised token counts per language of each completion."""
    toks = I.labelled_tokens(I.distribution_lines(I.completions(spark, sf)), spark, sf)
    counts = toks.groupBy("id", "token_lang").agg(F.count(F.lit(1)).alias("v"))
    return E.norm_entropy_base2(counts, ["id"], "v")


@query("complete_levels")
def q_complete_levels(spark, sf):
    """E13 + E14: completions having both a line and a word distribution,
    restricted to the cross-lingual setting, with their two reweighted entropies."""
    d = _with_expected(both_dists(spark, sf))
    ent = E.entropies(d, ["level", "id"], "expected", "training", variants=["reweighted_entropy"])
    ent = E.setting_filter(ent, "crosslingual")
    ent = E.complete_steps(ent, ["id"], "level", 2)
    return ent.select("level", "id", "reweighted_entropy")


# ---------------------------------------------------------- pass rates -----

from langmix.operators import overlap as O  # noqa: E402
from langmix.operators import passrate as P  # noqa: E402
from langmix.operators import prompts as C  # noqa: E402
from langmix.sources.tables import load as _load  # noqa: E402

# The driver's text is Latin-script only; the reference reports WPR for six
# non-Latin languages.  The queries report it for the non-English languages
# present so the word check is exercised (parameter of ``group_rates``).
WPR_LANGS_HERE = ("de", "es", "fr")
GROUP_KEYS = ["task", "model", "source", "language"]


def _checks(spark, sf):
    comp = I.completions(spark, sf)
    lines = I.pass_rate_lines(comp)
    lab = lid.label_column(lines, "line", I.lid_model(spark, sf), mode="single", threshold=0.3)
    words = P.dictionary(_load(spark, sf, "benchmark"))
    return P.completion_checks(comp, lab, words, I.UNIT_KEYS, raw_lines=lines)


@query("english_dictionary")
def q_english_dictionary(spark, sf):
    """Dictionary words (lower-case, alphabetic, > 3 characters) of the benchmark passages."""
    return P.dictionary(_load(spark, sf, "benchmark"))


@query("completion_checks")
def q_completion_checks(spark, sf):
    """Per completion qualifying lines, line errors, line/word error flags."""
    return _checks(spark, sf)


def _rates(spark, sf):
    return P.group_rates(_checks(spark, sf), GROUP_KEYS, "language", WPR_LANGS_HERE)


@query("line_pass_rate")
def q_line_pass_rate(spark, sf):
    """acc/lpr/wpr per (task, model, source, language) and the staged roll-ups."""
    return P.rollup(_rates(spark, sf), ["task", "model"])


@query("pass_rate_report")
def q_pass_rate_report(spark, sf):
    """P10: mean line pass rate x 100 by model x language over tasks."""
    return P.report(P.rollup(_rates(spark, sf), ["task", "model"]), "lpr")


# ------------------------------------------------------ overlap, prompts ---

def _pairs(spark, sf):
    conv = _load(spark, sf, "conversations")
    pairs = C.reply_pairs(conv)
    return pairs.select("conv_id", "turn", tx_tokens("input_text").alias("ref_tokens"),
                        tx_tokens("output_text").alias("pred_tokens"))


def tx_tokens(col):
    from langmix.functions import text as tx
    return tx.tokenize(col)


PAIR_KEYS = ["conv_id", "turn"]


def _pair_scores(spark, sf):
    pairs = _pairs(spark, sf)
    s = O.token_set_scores(pairs, PAIR_KEYS)
    m = O.ngram_matches(pairs, PAIR_KEYS)
    return s.join(m, PAIR_KEYS)


@query("reply_pairs")
def q_reply_pairs(spark, sf):
    """Assistant replies paired with the last user message before them."""
    return C.reply_pairs(_load(spark, sf, "conversations"))


@query("turn_prompts")
def q_turn_prompts(spark, sf):
    """Every conversation rendered as a Q/A prompt."""
    return C.turns_to_prompt(_load(spark, sf, "conversations"))


@query("few_shot_prompts")
def q_few_shot_prompts(spark, sf):
    """One-shot prefix (first user/assistant exchange) plus the next turn, and
    whether that turn is there and is the user's."""
    return C.few_shot(_load(spark, sf, "conversations"), k=1)


@query("token_overlap_pairs")
def q_token_overlap_pairs(spark, sf):
    """O1 + O2 per (user message, reply) pair."""
    s = _pair_scores(spark, sf)
    return s.select(*PAIR_KEYS, *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")],
                    F.col("num_true_words").cast("bigint").alias("num_true_words"),
                    F.col("num_pred_words").cast("bigint").alias("num_pred_words"),
                    "n_ngrams_match_1", "n_ngrams_match_2", "n_ngrams_match_3")


@query("token_overlap")
def q_token_overlap(spark, sf):
    """O3 + O4: mean token-set scores, n-gram matches, word counts and the SEM of F1."""
    return O.summarize(_pair_scores(spark, sf))


# ------------------------------------------- confusion, divergence, graphs --

from langmix.operators import divergence as K  # noqa: E402
from langmix.operators import graph as G  # noqa: E402
from langmix.operators import matrix as Mx  # noqa: E402
from langmix.functions import text as _tx  # noqa: E402
from langmix.session import cut_lineage  # noqa: E402


def _confusion(spark, sf, materialize: bool = False):
    d = line_dist(spark, sf).withColumn("expected", F.col("language"))
    m = Mx.drop_zero_lines(Mx.drop_labels(K.confusion_matrix(d, "expected", pivot_lang="en")))
    # the matrix is languages x languages; when several operators read it,
    # checkpoint it once instead of re-running the labelling job per reference
    return cut_lineage(m) if materialize else m


@query("confusion_matrix")
def q_confusion_matrix(spark, sf):
    """K1 + K5 + K6: mean reweighted term per (predicted row, expected column), line level."""
    return _confusion(spark, sf).select("row", "col", F.round("value", 6).alias("value"))


def _token_sets(spark, sf):
    d = _load(spark, sf, "documents")
    toks = d.select("lang", F.explode(_tx.word_punct_tokens(F.lower("text"))).alias("tok"))
    sets = G.node_sets(toks.filter(F.col("tok").rlike(r"^\p{L}+$")), "lang", "tok", nodes=d.select("lang"))
    return cut_lineage(G.crop_sets(sets, 3))


@query("language_similarity")
def q_language_similarity(spark, sf):
    """Jaccard distance between languages' word sets (documents)."""
    return G.set_jaccard(_token_sets(spark, sf)).select("row", "col", F.round("value", 6).alias("value"))


def _similarities(spark, sf):
    """K10/K15 catalogue: token-set Jaccard similarity and trigram-profile cosine."""
    jac = Mx.distance_to_similarity(G.set_jaccard(_token_sets(spark, sf))) \
        .withColumn("sim_name", F.lit("token_jaccard"))
    prof = I.lid_model(spark, sf).profile.select(F.col("lang").alias("node"), F.col("gram").alias("dim"),
                                                 F.col("weight").alias("x"))
    cos = G.cosine_scaled_long(prof).withColumn("sim_name", F.lit("trigram_cosine"))
    return cut_lineage(jac.unionByName(cos))


def _aligned(spark, sf):
    conf = _confusion(spark, sf, materialize=True)
    # one copy of the (small) confusion matrix per similarity source
    p = conf.select("*", F.explode(F.array(*[F.lit(n) for n in SIM_NAMES])).alias("sim_name"))
    return Mx.align(p, _similarities(spark, sf), ["sim_name"])


SIM_NAMES = ("token_jaccard", "trigram_cosine")


@query("confusion_kl")
def q_confusion_kl(spark, sf):
    """KL divergence per expected-language column between the
    confusion matrix and each similarity matrix (one keyed job)."""
    p, q = _aligned(spark, sf)
    kl = K.kl_by_column(p, q, ["sim_name"])
    return kl.select("sim_name", "col", F.round("kl", 6).alias("kl"))


@query("confusion_kl_summary")
def q_confusion_kl_summary(spark, sf):
    """K12 (mean of finite column KLs), K13 (whole-matrix KL), K14 (NaN-Euclidean)."""
    p, q = _aligned(spark, sf)
    m = K.kl_mean(K.kl_by_column(p, q, ["sim_name"]), ["sim_name"])
    w = K.kl_whole(p, q, ["sim_name"])
    e = K.nan_euclidean(p, q, ["sim_name"])
    return (m.join(w, "sim_name").join(e, "sim_name")
            .select("sim_name", *[F.round(c, 6).alias(c) for c in ("kl_mean", "kl_whole", "nan_euclidean")]))


@query("confusion_row_mean")
def q_confusion_row_mean(spark, sf):
    """Per predicted language, mean of the cells below the row maximum."""
    return K.robust_row_mean(_confusion(spark, sf)).select("row", F.round("robust_mean", 6).alias("robust_mean"))


@query("top_confusions")
def q_top_confusions(spark, sf):
    """The 20 largest positive cells of each expected-language column."""
    t = K.top_k_per_col(_confusion(spark, sf), 20)
    return t.select("col", "row", F.round("value", 6).alias("value"), F.col("rank").cast("bigint").alias("rank"))


def _nation_parts(spark, sf):
    li = _load(spark, sf, "lineitem").select("l_partkey", "l_suppkey")
    su = _load(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    na = _load(spark, sf, "nation").select("n_nationkey", "n_name")
    # supplier and nation are dimension tables: AQE broadcasts them at runtime
    # when they are small; no hint, so a large supplier table still works.
    return (li.join(su, li.l_suppkey == su.s_suppkey).join(na, su.s_nationkey == na.n_nationkey)
            .select(F.col("n_name").alias("node"), F.col("l_partkey").alias("concept")))


def _part_sets(spark, sf):
    """The nations of each part, as counted sets: one scan for all that follows."""
    return G.node_sets(_nation_parts(spark, sf), "node", "concept", nodes=_load(spark, sf, "nation").select("n_name"))


@query("cooccurrence_pmi")
def q_cooccurrence_pmi(spark, sf):
    """Nation co-occurrence over shared parts (lineitem x supplier),
    degree filter >= 3, PMI and min-max normalised PMI."""
    rows = _nation_parts(spark, sf)
    edges = G.set_edges(_part_sets(spark, sf))
    e = G.pmi_edges(edges, G.degrees(rows, "node"), 3)
    return e.select("a", "b", F.col("weight").cast("bigint").alias("weight"),
                    F.round("pmi", 6).alias("pmi"), F.round("pmi_norm", 6).alias("pmi_norm"))


@query("degree_quantiles")
def q_degree_quantiles(spark, sf):
    """0.25 quantile and maximum of node degrees."""
    d = G.degree_quantiles(G.degrees(_nation_parts(spark, sf), "node"), 0.25)
    return d.select(F.round("q", 6).alias("q"), F.col("max_degree").cast("bigint").alias("max_degree"))


@query("jaccard_distance")
def q_jaccard_distance(spark, sf):
    """G6-G9 at scale: Jaccard distance between nations over the parts they supply."""
    sets = G.crop_sets(_part_sets(spark, sf), 3)
    return G.set_jaccard(sets).select("row", "col", F.round("value", 6).alias("value"))


@query("embedding_cosine")
def q_embedding_cosine(spark, sf):
    """Scaled cosine between the label centroids of the embeddings."""
    e = _load(spark, sf, "embeddings")
    long = e.select("label", F.posexplode("embedding").alias("dim", "x"))
    cent = long.groupBy(F.col("label").alias("node"), "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return G.cosine_scaled_long(cent).select("row", "col", F.round("value", 6).alias("value"))


def _nation_features(spark, sf):
    c = _load(spark, sf, "customer")
    n = _load(spark, sf, "nation")
    g = c.groupBy("c_nationkey", "c_mktsegment").agg(F.avg("c_acctbal").alias("bal"))
    return (n.join(g, g.c_nationkey == n.n_nationkey, "left")
            .select(F.col("n_name").alias("node"), F.col("c_mktsegment").alias("feature"), F.col("bal").alias("value")))


@query("nation_feature_distance")
def q_nation_feature_distance(spark, sf):
    """NaN-Euclidean distance between nations over per-segment mean balances;
    a segment without customers is missing, and every pair of nations has a row."""
    f = _nation_features(spark, sf)
    return G.nan_euclidean_pairs(f, "node", "feature", "value").select(
        "row", "col", F.round("value", 6).alias("value"))


@query("regional_subgraph")
def q_regional_subgraph(spark, sf):
    """Co-occurrence edges induced by the nations of one region (EUROPE)."""
    edges = G.set_edges(_part_sets(spark, sf))
    n = _load(spark, sf, "nation")
    r = _load(spark, sf, "region").filter(F.col("r_name") == "EUROPE")
    nodes = n.join(r, n.n_regionkey == r.r_regionkey, "left_semi").select(F.col("n_name").alias("node"))
    return G.induced_subgraph(edges, nodes).select("a", "b", F.col("weight").cast("bigint").alias("weight"))


# ------------------------------------------------ statistics, typology, ML --

from langmix.operators import ml as ML  # noqa: E402
from langmix.operators import stats as S  # noqa: E402
from langmix.operators import typology as Y  # noqa: E402

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("pearson_lineitem")
def q_pearson_lineitem(spark, sf):
    """M4 + M3: Pearson r of the lineitem measures, lower triangle."""
    return S.pearson_long(_load(spark, sf, "lineitem").select(*MEASURES), MEASURES)


@query("spearman_lineitem")
def q_spearman_lineitem(spark, sf):
    """M1 + M3: Spearman rho (average ranks for ties) of the lineitem measures."""
    return S.spearman_long(_load(spark, sf, "lineitem").select(*MEASURES), MEASURES)


@query("spearman_significance")
def q_spearman_significance(spark, sf):
    """M2: p-values and stars of the Spearman correlations (t test, n - 2 df)."""
    li = _load(spark, sf, "lineitem").select(*MEASURES)
    return S.with_significance(S.spearman_long(li, MEASURES, with_n=True))


def _conditional_measures(spark, sf):
    """Measures with missing values: each known for a part of the rows only."""
    li = _load(spark, sf, "lineitem")
    return li.select(F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("quantity"),
                     F.when(F.col("l_linestatus") == "O", F.col("l_discount")).alias("discount"),
                     F.when(F.col("l_returnflag") != "A", F.col("l_tax")).alias("tax"), F.col("l_extendedprice").alias("price"))


CONDITIONAL = ["quantity", "discount", "tax", "price"]


@query("pearson_conditional")
def q_pearson_conditional(spark, sf):
    """M4 with missing values: each pair on the rows where both are known."""
    return S.pearson_long(_conditional_measures(spark, sf), CONDITIONAL)


@query("spearman_conditional")
def q_spearman_conditional(spark, sf):
    """M1 with missing values: ranks and correlation on each pair's own rows."""
    return S.spearman_long(_conditional_measures(spark, sf), CONDITIONAL)


@query("describe_lineitem")
def q_describe_lineitem(spark, sf):
    """Count / mean / std / min / max per measure."""
    return S.describe_long(_load(spark, sf, "lineitem"), MEASURES)


@query("quantity_box_summary")
def q_quantity_box_summary(spark, sf):
    """5/25/50/75/95 percentiles of quantity per (return flag, line status)."""
    return S.box_summary(_load(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity")


@query("price_histogram")
def q_price_histogram(spark, sf):
    """5 equal-width bins of the extended price."""
    return S.histogram(_load(spark, sf, "lineitem"), "l_extendedprice", 5)


@query("entropy_pass_rates")
def q_entropy_pass_rates(spark, sf):
    """Per (model, source, language, task) mean reweighted entropy joined
    (left) with the group's pass rates."""
    ent = q_entropy_by_group(spark, sf)
    rates = _rates(spark, sf).select("model", "source", "language", "task",
                                     *[F.round(c, 6).alias(c) for c in ("acc", "lpr", "wpr")])
    return ent.join(rates, ["model", "source", "language", "task"], "left")


def _typology(spark, sf):
    o = _load(spark, sf, "orders").select("o_custkey", "o_orderpriority")
    c = _load(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = _load(spark, sf, "nation").select("n_nationkey", "n_name")
    x = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    cnt = x.groupBy("n_nationkey", "n_name", "c_mktsegment", "o_orderpriority").agg(F.count(F.lit(1)).alias("k"))
    from pyspark.sql import Window
    w = Window.partitionBy("n_nationkey", "c_mktsegment")
    top = cnt.withColumn("rk", F.row_number().over(w.orderBy(F.desc("k"), "o_orderpriority"))).filter("rk = 1")
    # every nation has every segment as a feature; without orders its value is missing
    segments = c.agg(F.array_sort(F.collect_set("c_mktsegment"))).scalar()  # one name per segment
    grid = n.select("*", F.explode(segments).alias("feature"))
    top = top.select("n_nationkey", F.col("c_mktsegment").alias("feature"), F.col("o_orderpriority").alias("value"))
    return grid.join(top, ["n_nationkey", "feature"], "left").select(F.col("n_name").alias("node"), "n_nationkey", "feature", "value")


@query("typology_codes")
def q_typology_codes(spark, sf):
    """Dominant order priority per (nation, segment) as a categorical
    feature (missing where a nation has no such orders), coded by first
    appearance, nations cropped at 25 % coverage, features kept at 75 %."""
    t = Y.encode_first_appearance(_typology(spark, sf), "n_nationkey")
    t = Y.features_with_coverage(Y.crop_nodes(t, 0.25, 5), 0.75)
    return t.select("node", "feature", "value", F.col("code").cast("int").alias("code"))


@query("typology_pair_match")
def q_typology_pair_match(spark, sf):
    """Y5 + Y8: three-valued feature match for every nation pair; pairs with
    no information dropped."""
    t = Y.encode_first_appearance(_typology(spark, sf), "n_nationkey")
    return Y.drop_uninformative(Y.pair_match(t), ["a", "b"]).select(
        "a", "b", "feature", F.col("match").cast("int").alias("match"))


@query("priority_label_codes")
def q_priority_label_codes(spark, sf):
    """Label encoding of the order priority (sorted distinct -> 0..n-1)."""
    o = _load(spark, sf, "orders").select("o_orderpriority").distinct()
    return Y.label_encode(o, "o_orderpriority", "code").select(
        "o_orderpriority", F.col("code").cast("int").alias("code"))


def _embedding_vectors(spark, sf):
    return ML.as_vector(_load(spark, sf, "embeddings"), "embedding")


_KMEANS: dict[tuple, ML.KMeans] = {}


def _kmeans(spark, sf):
    """One fit (k = 3 and 6) for both queries."""
    key = (spark.sparkContext.applicationId, sf.rstrip("/"))
    if key not in _KMEANS:
        _KMEANS[key] = ML.kmeans(_load(spark, sf, "embeddings"), "vec_id", "embedding", (3, 6))
    return _KMEANS[key]


@query("kmeans_embeddings")
def q_kmeans_embeddings(spark, sf):
    """K-means (k = 3 and 6, ten rounds) cluster of every embedding."""
    return _kmeans(spark, sf).assignments(_load(spark, sf, "embeddings"), "vec_id", "embedding")


@query("pca_embeddings")
def q_pca_embeddings(spark, sf):
    """First two principal components of the centred embeddings."""
    return ML.pca2(_embedding_vectors(spark, sf), "vec_id")


FOREST_FEATURES = ["quality", "toxic", "n_chars", "n_lines"]
FOREST_TARGETS = ["de", "en", "es", "fr"]


def _forest_data(spark, sf):
    wide = D.widen(line_dist(spark, sf), ["id"], FOREST_TARGETS)
    n_lines = I.distribution_lines(I.completions(spark, sf)).groupBy("id").agg(
        F.count(F.lit(1)).cast("double").alias("n_lines"))
    lab = _load(spark, sf, "labels").withColumnRenamed("doc_id", "id")
    docs = _load(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double"))
    data = (wide.join(lab, "id").join(docs, "id").join(n_lines, "id")
            .select("id", *[F.col(c).cast("double").alias(c) for c in FOREST_FEATURES + FOREST_TARGETS]))
    return cut_lineage(data)


def _forest(spark, sf, joint=False):
    train, test = Y.hash_split(_forest_data(spark, sf), "id", 80)
    return ML.forest_per_target(train, test, FOREST_FEATURES, FOREST_TARGETS, "id", num_trees=100, joint=joint)


@query("forest_errors")
def q_forest_errors(spark, sf):
    """M5/M6 (+Y15 hash split): per-target MSE and MAE of 100-tree forests that
    predict a completion's language shares from its labels and size."""
    return _forest(spark, sf)[0]


@query("forest_joint_errors")
def q_forest_joint_errors(spark, sf):
    """M5/M6: the same with one 100-tree forest that splits for all shares at once."""
    return _forest(spark, sf, joint=True)[0]


@query("forest_importance")
def q_forest_importance(spark, sf):
    """M9 + M10: feature importances per target and the top features by sum."""
    return ML.top_features(_forest(spark, sf)[1], 10)


# ------------------------------------------------- sources, sinks, stream --

from langmix.sources import files as SRC  # noqa: E402
from langmix.sources.tables import SCHEMAS as _SCHEMAS  # noqa: E402
from langmix.streaming import incremental as R  # noqa: E402


@query("incremental_line_distribution")
def q_incremental_line_distribution(spark, sf):
    """The documents' files are a stream (availableNow trigger, checkpointed)
    that labels the lines of each micro-batch and writes its line
    distributions; the union of all batches equals the batch result (D1)."""
    model = I.lid_model(spark, sf)
    folder = R.stream_folder(spark, "documents")

    def transform(batch):
        lines = I.distribution_lines(I.completions_from(batch))
        lab = lid.label_column(lines, "line", model, mode="cascade", threshold=0.3)
        return D.ratios(lab, I.UNIT_KEYS).select("id", "lang", "p")

    # a glob: the table may be a folder of files or one file
    R.run_incremental(spark, f"{sf.rstrip('/')}/documents.parquet*", _SCHEMAS["documents"], f"{folder}/sink", f"{folder}/ckpt",
                      transform, files_per_trigger=2)
    return R.read_sink(spark, f"{folder}/sink").select("id", "lang", "p")


@query("matrix_csv_roundtrip")
def q_matrix_csv_roundtrip(spark, sf):
    """S6 + S12: the confusion matrix written as a wide CSV (one column per
    language) and read back into coordinate form."""
    m = _confusion(spark, sf, materialize=True).select("row", "col", F.round("value", 6).alias("value"))
    cols = sorted(r["col"] for r in m.select("col").distinct().collect())  # one row per language
    path = R.stream_folder(spark, "matrix") + "/confusion_csv"
    SRC.write_matrix_csv(m, path, cols)
    return SRC.read_matrix_csv(spark, path)


# ---------------------------------------------------- more matrix variants --

# fixed values: ISO 639-1 -> ISO 639-3 codes and English names of the
# languages that occur in the data, plus the reference's harmonisation of
# macro-language codes (zho -> cmn, msa/ara -> arb)
ISO3 = [("de", "deu", "German"), ("en", "eng", "English"), ("es", "spa", "Spanish"), ("fr", "fra", "French")]
HARMONISE = [("zho", "cmn"), ("msa", "arb"), ("ara", "arb")]


@query("confusion_matrix_training")
def q_confusion_matrix_training(spark, sf):
    """K2: confusion matrix weighting predicted languages in the training set or
    equal to the expected one with ``1 - p``."""
    d = line_dist(spark, sf).withColumn("expected", F.col("language")) \
        .withColumn("training", I.training_of(F.col("model")))
    m = Mx.drop_zero_lines(Mx.drop_labels(K.confusion_matrix(d, "expected", "training", pivot_lang=None)))
    return m.select("row", "col", F.round("value", 6).alias("value"))


@query("confusion_by_training")
def q_confusion_by_training(spark, sf):
    """K3: columns are the (exploded) training languages."""
    d = line_dist(spark, sf).withColumn("expected", F.col("language")) \
        .withColumn("training", I.training_of(F.col("model")))
    m = Mx.drop_labels(K.confusion_by_training(d, "training", "expected"))
    return m.select("row", "col", F.round("value", 6).alias("value"))


@query("confusion_norm_entropy")
def q_confusion_norm_entropy(spark, sf):
    """K4: per (predicted, expected) cell, the base-2 entropy of the normalised
    list of probabilities; cells of rows/columns with a missing cell dropped."""
    d = line_dist(spark, sf).select(F.col("lang").alias("row"), F.col("language").alias("col"), F.col("p").alias("v"))
    cells = E.norm_entropy_base2(d, ["row", "col"], "v")
    n_rows = cells.select("row").distinct()
    n_cols = cells.select("col").distinct()
    full_rows = cells.groupBy("row").agg(F.count(F.lit(1)).alias("k")).filter(
        F.col("k") == n_cols.agg(F.count(F.lit(1))).scalar()).select("row")
    full_cols = cells.groupBy("col").agg(F.count(F.lit(1)).alias("k")).filter(
        F.col("k") == n_rows.agg(F.count(F.lit(1))).scalar()).select("col")
    return cells.join(full_rows, "row", "left_semi").join(full_cols, "col", "left_semi").select(
        "row", "col", "norm_entropy")


@query("confusion_matrix_iso3")
def q_confusion_matrix_iso3(spark, sf):
    """Confusion matrix with ISO 639-3 codes (harmonised) and language names attached."""
    codes = spark.createDataFrame([(a, b) for a, b, _ in ISO3] + HARMONISE, "code string, mapped string")
    names = spark.createDataFrame([(b, n) for _, b, n in ISO3], "iso3 string, name string")
    m = Mx.rename_labels(_confusion(spark, sf), codes)
    m = (m.join(F.broadcast(names.withColumnRenamed("iso3", "row").withColumnRenamed("name", "row_name")), "row", "left")
         .join(F.broadcast(names.withColumnRenamed("iso3", "col").withColumnRenamed("name", "col_name")), "col", "left"))
    return m.select("row", "col", "row_name", "col_name", F.round("value", 6).alias("value"))


@query("pmi_matrix")
def q_pmi_matrix(spark, sf):
    """The PMI edge list as a symmetric matrix (both triangles)."""
    rows = _nation_parts(spark, sf)
    e = G.pmi_edges(G.set_edges(_part_sets(spark, sf)), G.degrees(rows, "node"), 3)
    return Mx.symmetric(e.select("a", "b", F.round("pmi", 6).alias("value")))


def _segment_wide(spark, sf):
    t = _typology(spark, sf)
    segs = sorted(r["feature"] for r in t.select("feature").distinct().collect())  # bounded: categories
    wide = t.groupBy("node").agg(*[F.max(F.when((F.col("feature") == s) & F.col("value").isNotNull(), 1)
                                         .otherwise(0)).cast("int").alias(s.lower()) for s in segs])
    return wide, [s.lower() for s in segs]


@query("segment_multi_hot")
def q_segment_multi_hot(spark, sf):
    """Per nation one 0/1 column per market segment that has a dominant
    priority (a present typology value)."""
    return _segment_wide(spark, sf)[0]


@query("segment_multi_hot_nonzero")
def q_segment_multi_hot_nonzero(spark, sf):
    """The multi-hot table without its all-zero columns (one aggregate of
    the column maxima, then a projection; the schema depends on the data, so
    this check is rows-only)."""
    wide, cols = _segment_wide(spark, sf)
    nz = wide.agg(*[F.max(c).alias(c) for c in cols]).first()
    return wide.select("node", *[c for c in cols if nz[c] != 0])


@query("typology_pair_match_known")
def q_typology_pair_match_known(spark, sf):
    """-1 (missing) -> NULL, rows with NULL dropped."""
    t = Y.encode_first_appearance(_typology(spark, sf), "n_nationkey")
    return Y.missing_to_null(Y.pair_match(t), ["match"]).select(
        "a", "b", "feature", F.col("match").cast("int").alias("match"))


@query("merged_distribution")
def q_merged_distribution(spark, sf):
    """D6 + D5 (+D4): line and word distributions appended per (unit, lang) in
    level order, the first value kept, residual mass added as ``unk``."""
    d = both_dists(spark, sf)
    merged = D.append_merge(d, ["id"], "level")
    lists = merged.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("lang", "ps"))).alias("dist"))  # one entry per language
    first = D.first_values(lists).select("id", F.explode("dist").alias("lang", "p"))
    return D.complete_unknown(first, ["id"]).select("id", "lang", F.round("p", 6).alias("p"))


@query("kl_side_by_side")
def q_kl_side_by_side(spark, sf):
    """K17 (+T11): mean column KL per similarity source for {line, word} x
    {all, mono, cross} in one keyed job (each unit feeds 'all' and its own
    setting), pivoted side by side; the source name is split into kind/measure."""
    d = both_dists(spark, sf).withColumn("expected", F.col("language"))
    mono = F.array_contains(I.training_of(F.col("model")), F.col("expected"))
    d = d.withColumn("setting", F.explode(F.array(F.lit("all"),
                                                  F.when(mono, F.lit("mono")).otherwise(F.lit("cross")))))
    keys = ["level", "setting"]
    inside = (F.col("lang") == F.col("expected")) | (F.col("lang") == "en")
    term = -F.when(inside, 1 - F.col("p")).otherwise(F.col("p")) * F.ln("p")
    conf = d.groupBy(*keys, F.col("lang").alias("row"), F.col("expected").alias("col")).agg(
        F.avg(term).alias("value"))
    conf = cut_lineage(Mx.drop_labels(conf))
    sims = _similarities(spark, sf)
    p = conf.select("*", F.explode(F.array(*[F.lit(n) for n in SIM_NAMES])).alias("sim_name"))
    # one copy of every similarity matrix per (level, setting) key
    q = sims.select("*", F.explode(F.array(*[F.struct(F.lit(l).alias("level"), F.lit(s).alias("setting"))
                                              for l in ("line", "word") for s in ("all", "mono", "cross")]))
                    .alias("_k")).select("sim_name", "row", "col", "value", "_k.level", "_k.setting")
    kk = keys + ["sim_name"]
    pa, qa = Mx.align(p, q, kk)
    m = K.kl_mean(K.kl_by_column(pa, qa, kk), kk)
    names = [f"{l}_{s}" for l in ("line", "word") for s in ("all", "mono", "cross")]
    wide = (m.withColumn("name", F.concat_ws("_", "level", "setting")).groupBy("sim_name")
            .pivot("name", names).agg(F.first("kl_mean")))
    return wide.select(F.split_part("sim_name", F.lit("_"), F.lit(1)).alias("kind"),
                       F.split_part("sim_name", F.lit("_"), F.lit(2)).alias("measure"),
                       *[F.round(n, 6).alias(n) for n in names])


@query("attribute_match_features")
def q_attribute_match_features(spark, sf):
    """Y9 + Y10: script / family / word-order / direction match between each
    completion's training languages and its expected language."""
    from langmix.sources import dims
    codes = F.broadcast(dims.data_codes(spark))
    comp = I.completions(spark, sf).select("id", "language", "training")
    comp = comp.join(codes.withColumnRenamed("code", "language"), "language", "left") \
        .withColumn("eval_code", F.coalesce("mapped", "language")).drop("mapped")
    mapping = F.create_map(*[x for a, b in dims.DATA_CODES for x in (F.lit(a), F.lit(b))])
    comp = comp.withColumn("train_codes", F.transform("training", lambda t: F.coalesce(mapping[t], t)))
    out = Y.attribute_matches(comp, ["id"], "train_codes", "eval_code", dims.lang_attributes(spark))
    return out.select("id", F.col("eval_code").alias("eval_lang"),
                      *[F.col(c).cast("int").alias(c) for c in
                        ("script", "family", "word_order", "script_lr", "training_script_lr")])


@query("share_means_by_task")
def q_share_means_by_task(spark, sf):
    """The widened language shares (one column per language) unpivoted and
    averaged by (language, task)."""
    langs = ["de", "en", "es", "fr"]
    wide = D.widen(line_dist(spark, sf), ["id", "task"], langs)
    long = wide.unpivot(["id", "task"], langs, "lang", "share")
    return long.groupBy("lang", "task").agg(F.round(F.avg("share"), 6).alias("mean_share"))


@query("entropy_metric_share")
def q_entropy_metric_share(spark, sf):
    """Mean reweighted entropy per (expected language, task) left-joined with
    the mean line pass rate of the same (language, task) and the language's
    pre-training share; languages shown as ISO 639-3 codes."""
    from langmix.sources import dims
    ent = q_entropy_by_language_task(spark, sf).withColumnRenamed("expected", "lang")
    lpr = _rates(spark, sf).groupBy(F.col("language").alias("lang"), "task").agg(
        F.round(F.avg("lpr"), 6).alias("lpr_mean"))
    iso = spark.createDataFrame([(a, b) for a, b, _ in ISO3], "lang string, iso3 string")
    out = (ent.join(lpr, ["lang", "task"], "left").join(F.broadcast(iso), "lang", "left")
           .join(F.broadcast(dims.mt5_share(spark)), "iso3", "left"))
    return out.select(F.coalesce("iso3", "lang").alias("lang"), "task",
                      F.col("mean_reweighted_entropy").alias("entropy"), "lpr_mean", "mt5")


@query("stacked_shares_by_task")
def q_stacked_shares_by_task(spark, sf):
    """Mean language shares per (expected language, task) for the units
    present in every task ('step'), one column per predicted language plus
    ``etc = 1 - sum``, with the fixed task order.  (The synthetic model and
    source keys are functions of the id parity, as is the task, so they never
    span both tasks; the expected language does.)"""
    langs = ["de", "en", "es", "fr"]
    keys = ["language"]
    d = line_dist(spark, sf)
    m = d.groupBy(*keys, "task", "lang").agg(F.sum("p").alias("s"))
    n_units = d.select("id", *keys, "task").distinct().groupBy(*keys, "task").agg(F.count(F.lit(1)).alias("n"))
    full = n_units.groupBy(*keys).agg(F.countDistinct("task").alias("k")).filter("k = 2").drop("k")
    wide = (m.join(full, keys, "left_semi").groupBy(*keys, "task")
            .pivot("lang", langs).agg(F.first("s")))
    wide = wide.join(n_units, keys + ["task"]).fillna(0.0, subset=langs)
    out = wide.select(*keys, "task", *[F.round(F.col(l) / F.col("n"), 6).alias(l) for l in langs])
    total = sum((F.col(l) for l in langs[1:]), F.col(langs[0]))
    order = F.when(F.col("task") == "monolingual", 0).otherwise(1)
    return out.withColumn("etc", F.round(F.lit(1.0) - total, 6)).withColumn("step_order", order.cast("int"))


@query("distribution_with_similarity")
def q_distribution_with_similarity(spark, sf):
    """Every line-distribution row left-joined with the trigram-profile
    cosine similarity between its predicted and its expected language."""
    prof = I.lid_model(spark, sf).profile.select(F.col("lang").alias("node"), F.col("gram").alias("dim"),
                                                 F.col("weight").alias("x"))
    cos = G.cosine_scaled_long(prof).select(F.col("row").alias("lang"), F.col("col").alias("language"),
                                            F.round("value", 6).alias("cos_sim"))
    d = line_dist(spark, sf).select("id", "language", "lang", "p")
    # the similarity matrix is languages x languages (bounded): AQE broadcasts it
    return d.join(cos, ["lang", "language"], "left").select("id", "language", "lang", "p", "cos_sim")
