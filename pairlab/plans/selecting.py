"""Queries on feature relevance, redundancy and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.operators import correlation, ranking, relevance, selection
from pairlab.operators.features import to_long
from pairlab.plans import views
from pairlab.plans.oracle_views import WITH_PAIRS, r
from pairlab.plans.registry import register, rounded
from pairlab.session import read_table

# The embeddings correlate weakly, so redundancy starts lower than the default.
THRESHOLD = 0.12
DOC_FEATURES = ("chars", "words", "lines", "digits", "marks", "upper_share")

_LONG_SQL = """WITH long AS (SELECT vec_id, cast(label < 5 AS INTEGER) AS y, cast(pos - 1 AS INTEGER) AS pos,
  'f' || lpad((pos - 1)::VARCHAR, 3, '0') AS feature, embedding[pos]::DOUBLE AS x
  FROM embeddings, (SELECT unnest(range(1, 65)) AS pos))"""


def _embeddings(spark, sf):
    return read_table(spark, sf, "embeddings").withColumn("y", (F.col("label") < 5).cast("int"))


def _quantiles(table: str, keys: str, where: str = "") -> str:
    return f"""SELECT {keys}, unnest([0.25, 0.5, 0.75])::DOUBLE AS prob,
      unnest(quantile_cont(x, [0.25, 0.5, 0.75])) AS threshold, count(*) AS n FROM {table} {where} GROUP BY {keys}"""


@register(
    "corr_label",
    f"{WITH_PAIRS} SELECT {r('corr(a_seed - b_seed, winner)')} AS seed_diff_winner_corr, count(*) AS n FROM pairs",
)
def corr_label(spark, sf):
    df = views.pairs(spark, sf)
    r_ = correlation.pearson(F.col("a_seed") - F.col("b_seed"), F.col("winner"))
    return rounded(df.agg(r_.alias("seed_diff_winner_corr"), F.count(F.lit(1)).alias("n")))


@register(
    "pearson_matrix",
    f"{_LONG_SQL} SELECT a.pos AS i, b.pos AS j, {r('corr(a.x, b.x)')} AS r FROM long a JOIN long b USING (vec_id) "
    "WHERE a.pos <= b.pos GROUP BY ALL",
)
def pearson_matrix(spark, sf):
    return rounded(correlation.pearson_matrix(_embeddings(spark, sf), vector="embedding"))


_EDGES_SQL = f"""edges AS (SELECT a.pos AS i, b.pos AS j, corr(a.x, b.x) AS r FROM long a JOIN long b USING (vec_id)
  WHERE a.pos < b.pos GROUP BY ALL HAVING abs(corr(a.x, b.x)) > {THRESHOLD})"""


@register("corr_pairs", f"{_LONG_SQL}, {_EDGES_SQL} SELECT i, j, {r('r')} AS r FROM edges")
def corr_pairs(spark, sf):
    matrix = correlation.pearson_matrix(_embeddings(spark, sf), vector="embedding")
    return rounded(correlation.correlated_pairs(matrix, THRESHOLD))


@register(
    "feature_quantiles",
    f"{_LONG_SQL}, q AS ({_quantiles('long', 'feature')}) SELECT feature, prob, {r('threshold')} AS threshold, n FROM q",
)
def feature_quantiles(spark, sf):
    return rounded(relevance.feature_quantiles(views.embedding_features(spark, sf)))


@register(
    "fact_quantiles",
    """SELECT l_returnflag AS feature, unnest([0.25, 0.5, 0.75])::DOUBLE AS prob,
      round(unnest(quantile_cont(l_extendedprice, [0.25, 0.5, 0.75])), 4) AS threshold, count(*) AS n
    FROM lineitem GROUP BY l_returnflag""",
)
def fact_quantiles(spark, sf):
    """Three groups that hold all facts: the case the counting passes are made for."""
    long = read_table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("feature"), F.col("l_extendedprice").alias("x")
    )
    return rounded(relevance.feature_quantiles(long), 4)


_MCC_SQL = f"""q AS ({_quantiles('long', 'feature')}),
counts AS (SELECT l.feature, prob, count(*) FILTER (WHERE x > threshold AND y = 1)::DOUBLE AS tp,
  count(*) FILTER (WHERE x > threshold AND y = 0)::DOUBLE AS fp, count(*) FILTER (WHERE x <= threshold AND y = 1)::DOUBLE AS fn,
  count(*) FILTER (WHERE x <= threshold AND y = 0)::DOUBLE AS tn FROM long l JOIN q USING (feature) GROUP BY ALL),
mcc AS (SELECT feature, max(coalesce(abs((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0)), 0)) AS mcc
  FROM counts GROUP BY feature)"""


@register("mcc_scores", f"{_LONG_SQL}, {_MCC_SQL} SELECT feature, {r('mcc')} AS mcc FROM mcc")
def mcc_scores(spark, sf):
    return rounded(relevance.mcc_scores(views.embedding_features(spark, sf)))


_DOC_SQL = """WITH d AS (SELECT doc_id, quality AS y, text FROM documents JOIN labels USING (doc_id)),
wide AS (SELECT doc_id, y, length(text)::DOUBLE AS chars, len(regexp_extract_all(text, '[^ \\n]+'))::DOUBLE AS words,
  (length(text) - length(replace(text, chr(10), '')))::DOUBLE AS lines, len(regexp_extract_all(text, '[0-9]'))::DOUBLE AS digits,
  len(regexp_extract_all(text, '[.,;:!?]'))::DOUBLE AS marks,
  len(regexp_extract_all(text, '[A-Z]'))::DOUBLE / nullif(length(text), 0) AS upper_share FROM d),
long AS (""" + " UNION ALL ".join(
    f"SELECT doc_id, y, '{f}' AS feature, {i} AS pos, coalesce({f}, 0) AS x FROM wide"
    for i, f in enumerate(DOC_FEATURES)
) + ")"


def _documents(spark, sf):
    return to_long(views.document_features(spark, sf), DOC_FEATURES, ["doc_id", "y"])


@register("mcc_scores_documents", f"{_DOC_SQL}, {_MCC_SQL} SELECT feature, {r('mcc')} AS mcc FROM mcc")
def mcc_scores_documents(spark, sf):
    """Integer-like features with many ties at the thresholds."""
    return rounded(relevance.mcc_scores(_documents(spark, sf)))


_BINNED_SQL = """qb AS (SELECT feature, unnest(quantile_cont(x, [0.25, 0.5, 0.75])) AS threshold FROM long GROUP BY feature),
binned AS (SELECT l.feature, l.y, (SELECT count(*) FROM qb WHERE qb.feature = l.feature AND l.x > qb.threshold) AS bin FROM long l),
cells AS (SELECT feature, bin, y, count(*)::DOUBLE AS c FROM binned GROUP BY ALL),
terms AS (SELECT feature, c, sum(c) OVER (PARTITION BY feature) AS n, sum(c) OVER (PARTITION BY feature, bin) AS nb,
  sum(c) OVER (PARTITION BY feature, y) AS ny FROM cells),
mi AS (SELECT feature, greatest(sum(c / n * ln(c * n / (nb * ny))), 0) AS mi FROM terms GROUP BY feature)"""


@register("mi_binned", f"{_LONG_SQL}, {_BINNED_SQL} SELECT feature, {r('mi')} AS mi FROM mi")
def mi_binned(spark, sf):
    return rounded(relevance.mi_binned(views.embedding_features(spark, sf)))


def _knn_sql(source: str) -> str:
    """Brute force: every pair of observations of a feature."""
    return f"""obs AS (SELECT row_number() OVER () AS id, * FROM {source}),
big AS (SELECT feature, y, count(*) AS members FROM obs GROUP BY ALL HAVING count(*) > 1),
kept AS (SELECT obs.*, members, least(5, members - 1) AS k FROM obs JOIN big USING (feature, y)),
dist AS (SELECT a.id, a.k, abs(a.x - b.x) AS d FROM kept a JOIN kept b ON a.feature = b.feature AND a.y = b.y AND a.id <> b.id),
radius AS (SELECT id, d AS r FROM dist QUALIFY row_number() OVER (PARTITION BY id ORDER BY d) = k),
near AS (SELECT a.id, a.feature, a.members, a.k, count(*) AS m FROM kept a JOIN radius USING (id)
  JOIN kept b ON a.feature = b.feature AND (abs(a.x - b.x) < r OR (r = 0 AND a.x = b.x)) GROUP BY ALL),
psi AS (SELECT n, coalesce(sum(1.0::DOUBLE / (n - 1)) FILTER (WHERE n > 1) OVER (ORDER BY n), 0) - 0.5772156649015329 AS v
  FROM (SELECT unnest(range(1, (SELECT count(*) + 2 FROM {source}))) AS n)),
mi AS (SELECT feature, greatest(0, any_value(pn.v) + avg(pk.v) - avg(pc.v) - avg(pm.v)) AS mi
  FROM near JOIN (SELECT feature, count(*) AS total FROM kept GROUP BY feature) USING (feature)
  JOIN psi pn ON pn.n = total JOIN psi pk ON pk.n = k JOIN psi pc ON pc.n = members JOIN psi pm ON pm.n = m GROUP BY feature)"""


@register("mi_knn", f"{_LONG_SQL}, {_knn_sql('long')} SELECT feature, {r('mi')} AS mi FROM mi")
def mi_knn(spark, sf):
    return rounded(relevance.mi_knn(views.embedding_features(spark, sf)))


@register("mi_knn_documents", f"{_DOC_SQL}, {_knn_sql('long')} SELECT feature, {r('mi')} AS mi FROM mi")
def mi_knn_documents(spark, sf):
    """Features with many equal values, over several range buckets."""
    return rounded(relevance.mi_knn(_documents(spark, sf), buckets=9))


def _noisy_sql(source: str, key: str) -> str:
    """x plus noise from the MD5 of key and feature, as ``mi_knn`` draws it."""
    draw = lambda n: f"(('0x' || substr(md5({key}::VARCHAR || '/' || feature || '/{n}'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0"
    return f"""noisy AS (SELECT {source}.* EXCLUDE (x), x + 1e-10::DOUBLE * scale * (sqrt(-2.0::DOUBLE * ln({draw(1)})) * cos(2 * pi() * ({draw(2)}))) AS x
  FROM {source} JOIN (SELECT feature, greatest(stddev_pop(x), avg(abs(x))) AS scale FROM {source} GROUP BY feature) USING (feature))"""


@register(
    "mi_knn_jitter",
    f"{_DOC_SQL}, {_noisy_sql('long', 'doc_id')}, {_knn_sql('noisy')} SELECT feature, {r('mi')} AS mi FROM mi",
)
def mi_knn_jitter(spark, sf):
    """Features with many equal values, told apart by repeatable noise."""
    return rounded(relevance.mi_knn(_documents(spark, sf), jitter_by="doc_id"))


_RANKS_SQL = """scores AS (SELECT feature, pos, round(mi, 9) AS mi, round(mcc, 9) AS mcc
  FROM mi JOIN mcc USING (feature) JOIN (SELECT DISTINCT feature, pos FROM long) USING (feature)),
ranked AS (SELECT *, cast(row_number() OVER (ORDER BY mi DESC, pos) - 1 AS INTEGER) AS mi_rank,
  cast(row_number() OVER (ORDER BY mcc DESC, pos) - 1 AS INTEGER) AS mcc_rank FROM scores),
combined AS (SELECT *, (mi_rank + mcc_rank) / 2.0::DOUBLE AS combined_rank FROM ranked)"""
_WITH_RANKS = f"{_LONG_SQL}, {_MCC_SQL}, {_BINNED_SQL}, {_RANKS_SQL}"
_WITH_KNN_RANKS = f"{_LONG_SQL}, {_MCC_SQL}, {_knn_sql('long')}, {_RANKS_SQL}"


def _relevance(spark, sf, mi="binned"):
    return selection.relevance(views.embedding_features(spark, sf), mi=mi)


@register(
    "rank_scores",
    f"{_LONG_SQL}, {_MCC_SQL} SELECT feature, {r('mcc', 9)} AS mcc, "
    "cast(row_number() OVER (ORDER BY round(mcc, 9) DESC, feature) - 1 AS INTEGER) AS mcc_rank FROM mcc",
)
def rank_scores(spark, sf):
    scores = relevance.mcc_scores(views.embedding_features(spark, sf)).withColumn("mcc", F.round("mcc", 9))
    return rounded(ranking.rank_scores(scores, "mcc", "feature", "mcc_rank"), 9)


@register(
    "combined_rank",
    f"{_WITH_RANKS} SELECT feature, pos, {r('mi')} AS mi, {r('mcc')} AS mcc, mi_rank, mcc_rank, combined_rank FROM combined",
)
def combined_rank(spark, sf):
    return rounded(_relevance(spark, sf))


@register(
    "top_features",
    f"{_WITH_RANKS} SELECT feature, pos, {r('mi')} AS mi, {r('mcc')} AS mcc, combined_rank FROM combined ORDER BY combined_rank, pos LIMIT 20",
)
def top_features(spark, sf):
    top = ranking.top_features(_relevance(spark, sf), "pos", 20)
    return rounded(top.drop("mi_rank", "mcc_rank"))


@register(
    "prune_bottom",
    f"""{_WITH_RANKS} SELECT feature, combined_rank, cast(row_number() OVER (ORDER BY combined_rank, pos) AS INTEGER) AS place
    FROM combined QUALIFY place <= greatest(10, floor(64 * 0.3))""",
)
def prune_bottom(spark, sf):
    kept = ranking.prune_bottom(_relevance(spark, sf), "pos", drop_share=0.7)
    return kept.select("feature", "combined_rank", "place")


_SCAN_SQL = f"""{_EDGES_SQL}, queue AS (SELECT row_number() OVER (ORDER BY i, j) AS step, i, j,
  ci.combined_rank AS ri, cj.combined_rank AS rj FROM edges JOIN combined ci ON ci.pos = i JOIN combined cj ON cj.pos = j),
scan AS (SELECT 0::BIGINT AS step, []::INTEGER[] AS gone UNION ALL
  SELECT queue.step, CASE WHEN list_contains(gone, i) OR list_contains(gone, j) THEN gone
    WHEN ri <= rj THEN list_append(gone, j) ELSE list_append(gone, i) END
  FROM scan JOIN queue ON queue.step = scan.step + 1),
dropped AS (SELECT unnest(gone) AS pos FROM (SELECT gone FROM scan ORDER BY step DESC LIMIT 1))"""


def _recursive(with_text: str) -> str:
    return with_text.replace("WITH ", "WITH RECURSIVE ", 1)


@register(
    "dedup_correlated",
    _recursive(f"{_WITH_RANKS}, {_SCAN_SQL} SELECT pos AS dropped FROM dropped"),
)
def dedup_correlated(spark, sf):
    ranks = _relevance(spark, sf)
    matrix = correlation.pearson_matrix(_embeddings(spark, sf), vector="embedding")
    edges = selection.redundancy_edges(matrix, ranks, THRESHOLD).withColumn("run", F.lit(0))
    return selection.dedup_correlated(edges).select("dropped")


_SELECTED_SQL = f"""{_SCAN_SQL}, survivors AS (SELECT * FROM combined WHERE pos NOT IN (SELECT pos FROM dropped)),
selected AS (SELECT *, cast(row_number() OVER (ORDER BY combined_rank, pos) AS INTEGER) AS place FROM survivors
  QUALIFY place <= greatest(10, floor((SELECT count(*) FROM survivors) * 0.5)))"""


def _selected(spark, sf, **options):
    return selection.select_features(
        views.embedding_features(spark, sf),
        vector=(_embeddings(spark, sf), "embedding"),
        threshold=THRESHOLD,
        **options,
    )


@register(
    "select_features",
    _recursive(
        f"{_WITH_KNN_RANKS}, {_SELECTED_SQL} SELECT feature, pos, {r('mi')} AS mi, {r('mcc')} AS mcc, combined_rank, place FROM selected"
    ),
)
def select_features(spark, sf):
    return rounded(_selected(spark, sf))


@register(
    "select_features_jitter",
    _recursive(
        f"{_LONG_SQL}, {_MCC_SQL}, {_noisy_sql('long', 'vec_id')}, {_knn_sql('noisy')}, {_RANKS_SQL}, {_SELECTED_SQL} "
        f"SELECT feature, pos, {r('mi')} AS mi, {r('mcc')} AS mcc, combined_rank, place FROM selected"
    ),
)
def select_features_jitter(spark, sf):
    """Selection with the noise in the information that breaks ties."""
    return rounded(_selected(spark, sf, jitter_by="vec_id"))


@register(
    "key_feature_status",
    _recursive(
        f"""{_WITH_KNN_RANKS}, {_SELECTED_SQL} SELECT f.feature,
        CASE WHEN s.feature IS NULL THEN 'DROPPED' ELSE 'KEPT' END AS status
        FROM (SELECT DISTINCT feature FROM long WHERE pos % 8 = 0) f LEFT JOIN selected s USING (feature)"""
    ),
)
def key_feature_status(spark, sf):
    keys = views.embedding_features(spark, sf).filter(F.col("pos") % 8 == 0).select("feature").distinct()
    return selection.key_feature_status(_selected(spark, sf), keys)
