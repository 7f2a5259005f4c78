"""SQL for DuckDB that checks the queries: common table expressions and a finishing step."""

from __future__ import annotations

REG = """
reg_panel AS (
  SELECT dataset_id, seed, model, y, point_pred, spread, x_disc, x_tax, x_qty, c_status,
         row_number() OVER (PARTITION BY dataset_id, seed, model
                            ORDER BY l_orderkey, l_partkey, l_suppkey, y, x_disc, x_tax, x_qty, c_status) - 1 AS row_pos,
         count(*) OVER (PARTITION BY dataset_id, seed, model) AS n_test
  FROM (SELECT p_size % 10 AS dataset_id, l_linenumber - 1 AS seed, l_returnflag AS model,
               l_extendedprice / 1000 AS y,
               (l_extendedprice / 1000) * (1 + (l_discount - CAST(0.05 AS DOUBLE)) *
                  (1 + (CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END + p_size % 10) % 3)) AS point_pred,
               CAST(0.05 AS DOUBLE) + l_tax AS spread, l_discount AS x_disc, l_tax AS x_tax, CAST(l_quantity AS DOUBLE) AS x_qty,
               l_linestatus AS c_status, l_orderkey, l_partkey, l_suppkey
        FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber <= 5) t)"""

LEVELS = "[" + ", ".join(f"CAST({round(0.05 * k, 2)} AS DOUBLE)" for k in range(1, 20)) + "]"
PPD = f"ppd AS (SELECT *, list_transform({LEVELS}, lambda q: point_pred * (1 + (q - 0.5) * spread)) AS q FROM reg_panel)"

IV = """
iv AS (
  SELECT *, upper - lower AS width, CASE WHEN y >= lower AND y <= upper THEN 1 ELSE 0 END AS covered,
         (upper - lower) + (2 / alpha) * (greatest(lower - y, 0) + greatest(y - upper, 0)) AS winkler,
         CASE WHEN y >= lower THEN alpha / 2 * (y - lower) ELSE (alpha / 2 - 1) * (y - lower) END AS pl,
         CASE WHEN y >= upper THEN (1 - alpha / 2) * (y - upper) ELSE (-alpha / 2) * (y - upper) END AS pu,
         row_pos >= floor(n_test / 2) AS eval_half
  FROM (SELECT p.*, alpha, point_pred * (1 + (greatest(alpha / 2, 0.05::DOUBLE) - 0.5) * spread) AS lower,
               point_pred * (1 + (least(1 - alpha / 2, 0.95::DOUBLE) - 0.5) * spread) AS upper
        FROM reg_panel p CROSS JOIN (SELECT unnest([0.05::DOUBLE, 0.1::DOUBLE, 0.15::DOUBLE, 0.2::DOUBLE]) AS alpha)))"""

IM = """
im AS (
  SELECT dataset_id, seed, model, alpha, avg(covered) AS marginal_coverage, 1 - alpha AS nominal,
         avg(covered) - (1 - alpha) AS cov_dev_signed, abs(avg(covered) - (1 - alpha)) AS cov_abs_dev,
         avg(width) AS avg_length, avg(width) / greatest(stddev_pop(y), 1e-10) AS avg_width_norm,
         avg(winkler) AS interval_score, avg(pl) AS pinball_lower, avg(pu) AS pinball_upper, (avg(pl) + avg(pu)) / 2 AS pinball_mean,
         count(*) AS n_eval
  FROM iv WHERE eval_half GROUP BY dataset_id, seed, model, alpha)"""

PA = """
pa AS (
  SELECT dataset_id, seed, model,
         CASE WHEN var_pop(y) > 0 THEN 1 - sum((y - point_pred) ** 2) / (var_pop(y) * count(*)) END AS r2,
         sqrt(avg((y - point_pred) ** 2)) AS rmse, avg(abs(y - point_pred)) AS mae
  FROM reg_panel GROUP BY ALL)"""

LONG = """
long AS (
  SELECT dataset_id, seed, model, CAST(NULL AS DOUBLE) AS alpha, unnest(['r2', 'rmse', 'mae']) AS metric, unnest([r2, rmse, mae]) AS value FROM pa
  UNION ALL
  SELECT dataset_id, seed, model, alpha, unnest(['interval_score', 'cov_abs_dev', 'cov_dev_signed', 'avg_width_norm']),
         unnest([interval_score, cov_abs_dev, cov_dev_signed, avg_width_norm]) FROM im)"""

WIDE = """
wide AS (SELECT im.*, r2, rmse, mae FROM im JOIN pa USING (dataset_id, seed, model))"""

FEAT = """
feat AS (
  SELECT dataset_id, seed, avg(x_disc) AS f_disc_mean, stddev_pop(x_disc) AS f_disc_sd, avg(x_tax) AS f_tax_mean, avg(x_qty) AS f_qty_mean,
         stddev_pop(x_qty) AS f_qty_sd, avg(y) AS f_y_mean, stddev_pop(y) AS f_y_sd, avg(CASE WHEN c_status = 'F' THEN 1.0::DOUBLE ELSE 0 END) AS f_status_share,
         count(*) AS n_context, 4 AS n_features
  FROM reg_panel GROUP BY ALL)"""

FEATURES = ["f_disc_mean", "f_disc_sd", "f_tax_mean", "f_qty_mean", "f_qty_sd", "f_y_mean", "f_y_sd", "f_status_share"]
FLONG = f"flong AS (SELECT dataset_id, seed, unnest({FEATURES}) AS feature, unnest([{', '.join(FEATURES)}]) AS value FROM feat)"

CLF = """
clf AS (
  SELECT vec_id, vec_id % 5 AS dataset_id, 'm' || k AS model, label AS y_idx, list_transform(e, lambda v: v / list_sum(e)) AS p
  FROM (SELECT vec_id, label, k, list_transform(embedding[10 * k + 1 : 10 * k + 10], lambda v: exp(CAST(v AS DOUBLE))) AS e
        FROM embeddings CROSS JOIN (SELECT unnest([0, 1, 2]) AS k))),
ci AS (
  SELECT *, list_max(p) AS confidence, list_position(p, list_max(p)) - 1 AS pred,
         CASE WHEN list_position(p, list_max(p)) - 1 = y_idx THEN 1 ELSE 0 END AS hit, p[y_idx + 1] AS p_true
  FROM clf)"""

EDGES = "[" + ", ".join(f"quantile_cont({{x}}, {k}/15.0::DOUBLE)" for k in range(1, 15)) + "]"


def binned(source: str, keys: str, score: str, target: str, name: str) -> str:
    """CTEs {name}_ew and {name}_em with columns ece and mce by keys."""
    using = ", ".join(x.strip() for x in keys.split(","))
    edges = EDGES.format(x=score)
    out = f"{name}_e AS (SELECT {keys}, {edges} AS edges FROM {source} GROUP BY {keys}),\n"
    out += f"""{name}_b AS (SELECT s.*, least(14, len(list_filter(list_transform(range(1, 16), lambda k: k / 15.0::DOUBLE), lambda e: e < {score}))) AS ew,
      len(list_filter(edges, lambda e: e < {score})) AS em FROM {source} s JOIN {name}_e USING ({using}))"""
    for kind in ("ew", "em"):
        out += f""",
{name}_{kind} AS (SELECT {keys}, sum(d * n) / sum(n) AS ece, max(d) AS mce
  FROM (SELECT {keys}, {kind}, abs(avg({target}) - avg({score})) AS d, count(*) AS n FROM {name}_b GROUP BY {keys}, {kind}) GROUP BY {keys})"""
    return out


def query(*parts: str) -> str:
    """CTEs and a final SELECT."""
    *ctes, last = parts
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + last


def finished(sql: str, doubles: str) -> str:
    """The result with numbers rounded to six places, NaN as null and no negative zero."""
    made = ", ".join(f"round(CASE WHEN isnan({c}) THEN NULL ELSE {c} END, 6) + 0.0::DOUBLE AS {c}" for c in doubles.split())
    return f"SELECT * REPLACE ({made}) FROM ({sql})" if made else sql
