"""K-means, expectation-maximisation and gradient steps on the embeddings and the line items."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixframe.catalog.base import (
    JOINT,
    LINE_FEATURES,
    Query,
    gamma_sql,
    label_model,
    latent,
    lines,
    rounded,
    table,
)
from mixframe.model import Mixture, vector_literal
from mixframe.operators import finetune, fitting, seeding
from mixframe.operators.scoring import joint_log_prob
from mixframe.plans.training import train_mixture

CLUSTERS = 10
ROUNDS = 2
FACTOR = 0.4
RATE = 1e-6


def start_centres(spark: SparkSession, folder: str) -> np.ndarray:
    """The rows with the smallest ids: as many as there are clusters."""
    first = table(spark, folder, "embeddings").orderBy("vec_id").limit(CLUSTERS)
    return np.array([row["embedding"] for row in first.select("vec_id", "embedding").orderBy("vec_id").collect()])


def _fitted(spark: SparkSession, folder: str) -> tuple[np.ndarray, fitting.MixtureFit]:
    rows = table(spark, folder, "embeddings")
    centres = fitting.lloyd(rows, "embedding", start_centres(spark, folder), ROUNDS).centres
    return centres, fitting.diag_gmm(rows, "embedding", centres, max_iter=ROUNDS, tolerance=None)


def _flat(spark: SparkSession, model: Mixture, digits: int = 6) -> DataFrame:
    exploded = model.to_table(spark).select("k", "pi", F.posexplode(F.arrays_zip("mu", "var")).alias("d", "e"))
    return exploded.select(
        "k", "d", rounded("pi", digits).alias("pi"), rounded("e.mu", digits).alias("mu"), rounded("e.var", digits).alias("var")
    )


def _lloyd(spark: SparkSession, folder: str) -> DataFrame:
    """Centres after the rounds, and how many rows are nearest to each."""
    centres, _ = _fitted(spark, folder)
    rows = table(spark, folder, "embeddings")
    # equal weights and unit variances: the greatest joint is the nearest centre
    model = Mixture(np.full(CLUSTERS, 1.0 / CLUSTERS), centres, np.ones(centres.shape))
    near = joint_log_prob(rows, model, "embedding").select(
        (F.array_position("joint", F.array_max("joint")) - 1).cast("int").alias("k")
    )
    sizes = near.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    literal = F.array(*[vector_literal(c) for c in centres])
    return sizes.select("k", "n", F.posexplode(F.element_at(literal, F.col("k") + 1)).alias("d", "mu")).select(
        "k", "n", "d", rounded("mu").alias("mu")
    )


def _kmeans(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    found = fitting.kmeans(rows, "embedding", CLUSTERS, restarts=2, max_iter=20)
    model = Mixture(np.full(CLUSTERS, 1.0 / CLUSTERS), found.centres, np.ones(found.centres.shape))
    return _flat(spark, model).select("k", "d", "mu")


def _bounded(spark: SparkSession, folder: str) -> DataFrame:
    """The rounds of ``lloyd``, with bounds kept beside each row."""
    rows = table(spark, folder, "embeddings")
    found = seeding.lloyd_bounded(rows, "embedding", start_centres(spark, folder), ROUNDS).clustering
    flat = _flat(spark, Mixture(np.full(CLUSTERS, 1.0 / CLUSTERS), found.centres, np.ones(found.centres.shape)))
    return flat.select("k", "d", "mu")


def _seeding(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates of two restarts after two passes over all embeddings, with the rows nearest to each."""
    rows = table(spark, folder, "embeddings")
    found, weights = seeding.candidates(rows, "vec_id", "embedding", CLUSTERS, [0, 1], passes=2)
    flat = [
        (r, i, int(w), v.tolist()) for r in range(2) for i, (v, w) in enumerate(zip(found[r], weights[r], strict=True))
    ]
    listed = spark.createDataFrame(flat, "restart int, candidate int, n bigint, v array<double>")
    return listed.select("restart", "candidate", "n", F.posexplode("v").alias("d", "x")).select(
        "restart", "candidate", "n", "d", rounded("x").alias("x")
    )


def _gmm(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(spark, _fitted(spark, folder)[1].model)


def _line_gmm(spark: SparkSession, folder: str) -> DataFrame:
    """Two rounds on all line items, from the means of the return flags."""
    rows = lines(spark, folder)
    means = rows.groupBy("l_returnflag").agg(*[F.avg(F.col("z_mu")[i]).alias(f"m{i}") for i in range(4)])
    start = np.array([list(r)[1:] for r in means.orderBy("l_returnflag").collect()])
    fit = fitting.diag_gmm(rows, "z_mu", start, max_iter=ROUNDS, tolerance=None)
    flat = _flat(spark, fit.model, 9).select("k", "d", "pi", "mu", "var")
    return flat.select("k", "d", rounded("pi", 5).alias("pi"), _signif("mu"), _signif("var"))


def _signif(column: str) -> F.Column:
    """Five digits after the leading one, so that prices and discounts are compared alike."""
    c = F.col(column)
    scale = F.pow(F.lit(10.0), F.floor(F.log10(c)).cast("double"))
    return rounded(c / scale, 4).alias(column)


def _momentum(spark: SparkSession, folder: str) -> DataFrame:
    centres, fit = _fitted(spark, folder)
    fresh = Mixture(fit.model.weights, centres, fit.model.variances).to_table(spark)
    blended = fitting.momentum_update_table(label_model(spark, folder).to_table(spark), fresh, FACTOR)
    return _flat(spark, Mixture.from_table(blended))


def _gradient(through_gamma: bool):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        model = label_model(spark, folder)
        _, gradient = finetune.latent_loss_gradient(latent(spark, folder), model, through_gamma=through_gamma)
        rows = [
            (k, d, float(gradient["pi"][k]), float(gradient["mu"][k, d]), float(gradient["var"][k, d]))
            for k in range(model.k)
            for d in range(model.dim)
        ]
        flat = spark.createDataFrame(rows, "k int, d int, by_pi double, by_mu double, by_var double")
        return flat.select("k", "d", *[rounded(c, 4).alias(c) for c in ("by_pi", "by_mu", "by_var")])

    return run


def _finetune(spark: SparkSession, folder: str) -> DataFrame:
    model = label_model(spark, folder)
    tuned, _ = finetune.finetune_mixture(latent(spark, folder), model, [0.5], [RATE], optimizer="SGD")
    return _flat(spark, tuned)


def _train(spark: SparkSession, folder: str) -> DataFrame:
    result = train_mixture(
        latent(spark, folder), "vec_id", clusters=4, init_steps=3, batch_size=100, max_iter=5, beta_steps=2, static_steps=1
    )
    return _flat(spark, result.model)


def lloyd_sql() -> str:
    """CTEs c0 .. c2 (centres) and n2 (nearest centre of each row to c2)."""
    parts = [
        """e AS (
  SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS d, unnest(embedding)::DOUBLE AS x FROM embeddings)""",
        f"""c0 AS (
  SELECT * FROM (SELECT dense_rank() OVER (ORDER BY vec_id) - 1 AS k, d, x AS mu FROM e) WHERE k < {CLUSTERS})""",
    ]
    for i in range(ROUNDS + 1):
        parts.append(
            f"""n{i} AS (
  SELECT vec_id, arg_min(k, (dist, k)) AS k
  FROM (SELECT vec_id, k, sum((x - mu) * (x - mu)) AS dist FROM e JOIN c{i} USING (d) GROUP BY vec_id, k) GROUP BY vec_id)"""
        )
        if i < ROUNDS:
            parts.append(
                f"""c{i + 1} AS (
  SELECT k, d, coalesce(m.mu, c.mu) AS mu FROM c{i} c
  LEFT JOIN (SELECT k, d, avg(x) AS mu FROM e JOIN n{i} USING (vec_id) GROUP BY k, d) m USING (k, d))"""
            )
    return ",\n".join(parts)


def em_sql(centres: str, nearest: str, elements: str, key: str, dims: int) -> str:
    """CTEs g0 .. g2: mixtures (k, d, w, mu, var) of the start and of each round."""
    total = f"(SELECT count(DISTINCT ({key})) FROM {elements})"
    parts = [
        f"""g0 AS (
  SELECT c.k, c.d, s.n / {total} AS w, c.mu, s.var + 1e-6 AS var
  FROM {centres} c JOIN (
    SELECT k, d, count(*) AS n, var_pop(x) AS var FROM {elements} JOIN {nearest} USING ({key}) GROUP BY k, d) s USING (k, d))"""
    ]
    for i in range(ROUNDS):
        parts.append(
            f"""j{i} AS (
  SELECT {key}, k, ln(any_value(w)) - 0.5 * ({dims} * ln(2 * pi()) + sum((x - mu) * (x - mu) / var + ln(var))) AS j
  FROM {elements} JOIN g{i} USING (d) GROUP BY {key}, k),
t{i} AS (SELECT *, j - max(j) OVER (PARTITION BY {key}) AS s FROM j{i}),
r{i} AS (SELECT {key}, k, exp(s) / sum(exp(s)) OVER (PARTITION BY {key}) AS r FROM t{i}),
m{i} AS (
  SELECT k, d, sum(r) AS n, sum(r * x) / sum(r) AS mu
  FROM {elements} JOIN r{i} USING ({key}) GROUP BY k, d),
g{i + 1} AS (
  SELECT k, d, any_value(n) / {total} AS w, any_value(mu) AS mu,
         sum(r * (x - mu) * (x - mu)) / any_value(n) + 1e-6 AS var
  FROM {elements} JOIN r{i} USING ({key}) JOIN m{i} USING (k, d) GROUP BY k, d)"""
        )
    return ",\n".join(parts)


def seeding_sql(passes: int) -> str:
    """CTEs of the candidates (restart r, vec_id, turn) after each pass, and the last ones numbered with their nearest rows."""

    def draw(turn: int) -> str:
        return f"('0x' || substr(md5(vec_id || ':{turn}:' || r), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"

    def cost(turn: int) -> str:
        return f"""SELECT r, a.vec_id, c.vec_id AS other, round(sum((a.x - b.x) * (a.x - b.x)), 9) AS dist
  FROM e a JOIN e b USING (d) JOIN c{turn} c ON c.vec_id = b.vec_id GROUP BY ALL"""

    parts = [
        "e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS d, unnest(embedding)::DOUBLE AS x FROM embeddings)",
        f"""c0 AS (
  SELECT r, arg_min(vec_id, ({draw(0)}, vec_id)) AS vec_id, 0 AS turn
  FROM embeddings, (SELECT unnest([0, 1]) AS r) GROUP BY r)""",
    ]
    for turn in range(1, passes + 1):
        parts.append(
            f"""d{turn} AS (SELECT r, vec_id, min(dist) AS cost FROM ({cost(turn - 1)}) GROUP BY r, vec_id),
c{turn} AS (
  SELECT * FROM c{turn - 1} UNION ALL
  SELECT r, vec_id, {turn} FROM (SELECT *, sum(cost) OVER (PARTITION BY r) AS total FROM d{turn})
  WHERE {draw(turn)} * total < {2.0 * CLUSTERS} * cost)"""
        )
    parts.append(
        f"""listed AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY turn, vec_id) - 1 AS i FROM c{passes}),
owner AS (
  SELECT t.r, t.vec_id, min(s).i AS i
  FROM (SELECT t.r, t.vec_id, {{'dist': dist, 'i': i}} AS s FROM ({cost(passes)}) t
        JOIN listed l ON l.r = t.r AND l.vec_id = t.other) t GROUP BY t.r, t.vec_id)"""
    )
    return ",\n".join(parts)


LLOYD = lloyd_sql()
GMM = f"{LLOYD},\n{em_sql('c2', 'n2', 'e', 'vec_id', 64)}"
FLAT = """SELECT k::INTEGER AS k, d::INTEGER AS d, round(w, 6) + 0.0 AS pi, round(mu, 6) + 0.0 AS mu,
       round(var, 6) + 0.0 AS var"""
LINE_ELEMENTS = f"""rows AS (SELECT *, row_number() OVER () AS id FROM lineitem),
e AS (
  SELECT id, l_returnflag, unnest(range(4)) AS d, unnest([{", ".join(LINE_FEATURES)}]) AS x FROM rows),
c0 AS (
  SELECT dense_rank() OVER (ORDER BY l_returnflag) - 1 AS k, d, mu
  FROM (SELECT l_returnflag, d, avg(x) AS mu FROM e GROUP BY 1, 2)),
n0 AS (
  SELECT id, arg_min(k, (dist, k)) AS k
  FROM (SELECT id, k, sum((x - mu) * (x - mu)) AS dist FROM e JOIN c0 USING (d) GROUP BY id, k) GROUP BY id)"""

# Gradient of the mixture latent loss. ``lead`` is the derivative by the joint (zero when gamma is held constant).
GRADIENT = f"""{JOINT},
{gamma_sql()},
span AS (SELECT max(-j) - min(-j) + 1e-12 AS span, min(-j) AS low, arg_min((vec_id, k), -j) AS best,
  arg_max((vec_id, k), -j) AS worst FROM joint),
q AS (
  SELECT vec_id, k, sum(ln(var) + ((x - mu) * (x - mu) + 0.01 + x * x) / var) + 64 * 64 * ln(2 * pi()) AS q, any_value(w) AS w
  FROM e JOIN model USING (d) GROUP BY vec_id, k),
by_gamma AS (SELECT vec_id, k, j, g, ln(g) + 1 - ln(w) + 0.5 * q AS b FROM gamma JOIN q USING (vec_id, k)),
by_p AS (SELECT *, g * (b - sum(g * b) OVER (PARTITION BY vec_id)) AS h FROM by_gamma),
pull AS (SELECT 20 * sum(h * (-j - low)) / any_value(span * span) AS pull FROM by_p, span),
lead AS (
  SELECT vec_id, k, g, 20 / span * h + CASE WHEN (vec_id, k) = best THEN pull ELSE 0 END
         - CASE WHEN (vec_id, k) = worst THEN pull ELSE 0 END AS a
  FROM by_p, span, pull)"""


def gradient_sql(lead: str) -> str:
    return f"""{GRADIENT},
gradient AS (
  SELECT l.k, e.d, sum(({lead}) - g) / any_value(w) / count(*) AS by_pi,
         sum((({lead}) - g) * (x - mu) / var) / count(*) AS by_mu,
         sum(({lead}) * ((x - mu) * (x - mu) / var - 1) / (2 * var)
             + g * (1 - ((x - mu) * (x - mu) + 0.01 + x * x) / var) / (2 * var)) / count(*) AS by_var,
         any_value(w) AS w, any_value(mu) AS mu, any_value(var) AS var
  FROM lead l JOIN e USING (vec_id) JOIN model m ON m.k = l.k AND m.d = e.d GROUP BY l.k, e.d)"""


BY = """SELECT k::INTEGER AS k, d::INTEGER AS d, round(by_pi, 4) + 0.0 AS by_pi, round(by_mu, 4) + 0.0 AS by_mu,
       round(by_var, 4) + 0.0 AS by_var FROM gradient"""
SIGNIF = "round({0} / pow(10, floor(log10({0}))), 4) + 0.0 AS {0}"

QUERIES = [
    Query(
        "lloyd",
        _lloyd,
        f"""WITH {LLOYD}, sizes AS (SELECT k, count(*) AS n FROM n2 GROUP BY k)
SELECT k::INTEGER AS k, n, d::INTEGER AS d, round(mu, 6) + 0.0 AS mu FROM c2 JOIN sizes USING (k)""",
    ),
    Query(
        "lloyd_bounded",
        _bounded,
        f"WITH {LLOYD}\nSELECT k::INTEGER AS k, d::INTEGER AS d, round(mu, 6) + 0.0 AS mu FROM c2",
    ),
    Query(
        "kmeans_seeding",
        _seeding,
        f"""WITH {seeding_sql(2)}
SELECT l.r::INTEGER AS restart, l.i::INTEGER AS candidate, coalesce(o.n, 0)::BIGINT AS n, e.d::INTEGER AS d, round(e.x, 6) + 0.0 AS x
FROM listed l JOIN e USING (vec_id)
LEFT JOIN (SELECT r, i, count(*) AS n FROM owner GROUP BY r, i) o ON o.r = l.r AND o.i = l.i""",
    ),
    Query("kmeans", _kmeans),
    Query("diag_gmm", _gmm, f"WITH {GMM}\n{FLAT} FROM g2"),
    Query(
        "diag_gmm_lines",
        _line_gmm,
        f"""WITH {LINE_ELEMENTS},
{em_sql("c0", "n0", "e", "id", 4)}
SELECT k::INTEGER AS k, d::INTEGER AS d, round(w, 5) + 0.0 AS pi, {SIGNIF.format("mu")}, {SIGNIF.format("var")} FROM g2""",
    ),
    Query(
        "momentum_update",
        _momentum,
        f"""WITH {GMM},
old AS (
  SELECT dense_rank() OVER (ORDER BY label) - 1 AS k, d, n / sum(n) OVER (PARTITION BY d) AS w, mu, var
  FROM (SELECT label, d, count(*) AS n, avg(x) AS mu, var_pop(x) AS var
        FROM e JOIN embeddings USING (vec_id) GROUP BY label, d))
SELECT o.k::INTEGER AS k, o.d::INTEGER AS d, round(o.w, 6) + 0.0 AS pi,
       round(o.mu + pow(1 - {FACTOR}, 3) * (c.mu - o.mu), 6) + 0.0 AS mu,
       round(o.var + pow(1 - {FACTOR}, 3) * (g.var - o.var), 6) + 0.0 AS var
FROM old o JOIN c2 c USING (k, d) JOIN g2 g USING (k, d)""",
    ),
    Query("latent_loss_gradient", _gradient(True), f"WITH {gradient_sql('a')}\n{BY}"),
    Query("latent_loss_gradient_constant", _gradient(False), f"WITH {gradient_sql('0')}\n{BY}"),
    Query(
        "finetune_mixture",
        _finetune,
        f"""WITH {gradient_sql("a")}
SELECT k::INTEGER AS k, d::INTEGER AS d, round(w - {RATE} * 0.5 * by_pi, 6) + 0.0 AS pi,
       round(mu - {RATE} * 0.5 * by_mu, 6) + 0.0 AS mu, round(var - {RATE} * 0.5 * by_var, 6) + 0.0 AS var
FROM gradient""",
    ),
    Query("train_mixture", _train),
]
