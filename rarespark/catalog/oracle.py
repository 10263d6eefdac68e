"""DuckDB SQL that states independently what each registered query must return."""

from __future__ import annotations

from rarespark.catalog.inputs import CATEGORICAL, DEAR_LINE, LINE_FEATURES, NUMERIC, SCORE_RECIPES
from rarespark.operators.metrics import threshold_grid
from rarespark.settings import COMPARISONS, K_NEIGHBORS, LATENT_GRID, MISSING_TOKEN, RATE_GRID, SCENARIOS, SEED

_RATE = 0.2
_THRESHOLD = 0.3


def _r(sql: str, name: str) -> str:
    return f"round({sql}, 6) + 0.0 AS {name}"


def _u(tag: str, key: str) -> str:
    return f"(('0x' || substr(md5('{SEED}:{tag}:' || {key}), 1, 13))::BIGINT / 4503599627370496.0)"


_FACTS = """facts AS (
  SELECT o_orderkey AS id, CAST(o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' AS INTEGER) AS y,
         o_custkey, o_orderstatus, o_totalprice FROM orders)"""
_TX = _FACTS + """, sides AS (
  SELECT l_orderkey AS id, max(l_returnflag) AS max_returnflag, count(*) AS n_lines,
         sum(l_extendedprice) AS sum_price, avg(l_discount) AS avg_discount FROM lineitem GROUP BY l_orderkey),
tx AS (
  SELECT f.id, y, o_custkey, o_orderstatus, max_returnflag, o_totalprice, n_lines, sum_price, avg_discount,
         1.0::DOUBLE AS const_one, NULL::DOUBLE AS all_null FROM facts f LEFT JOIN sides s ON f.id = s.id)"""
_SPLIT = f""", hashed AS (
  SELECT id, row_number() OVER (PARTITION BY y ORDER BY {_u('split', 'id')}, id) AS rn,
         count(*) OVER (PARTITION BY y) AS n FROM facts),
split AS (
  SELECT id, CASE WHEN rn <= floor(round(0.6 * n, 6)) THEN 'train'
    WHEN rn <= floor(round(0.6 * n, 6)) + floor(round(0.2 * n, 6)) THEN 'validation' ELSE 'test' END AS split
  FROM hashed)"""
_SPLIT_FACTS = _FACTS + _SPLIT + ", sf AS (SELECT f.*, split FROM facts f JOIN split USING (id))"
_SPLIT_TX = _TX + _SPLIT + ", stx AS (SELECT t.*, split FROM tx t JOIN split USING (id)), train AS (SELECT * FROM stx WHERE split = 'train')"

_FREQ = ", freq AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", coalesce(CAST({c} AS VARCHAR), '{MISSING_TOKEN}') AS "value",
    count(*) AS n, count(*) / (SELECT count(*)::DOUBLE FROM train) AS f FROM train GROUP BY 2""" for c in CATEGORICAL
) + ")"
_CAT_STATS = """, cat_mean AS (
  SELECT "column" AS c, sum(n * f) / sum(n) AS m, min(f) AS lo, max(f) AS hi FROM freq GROUP BY 1),
cat_stats AS (
  SELECT c, CASE WHEN any_value(lo) = any_value(hi) THEN any_value(lo) ELSE any_value(m) END AS mean,
    CASE WHEN any_value(lo) = any_value(hi) THEN 1.0 ELSE sqrt(sum(n * (f - m) * (f - m)) / sum(n)) END AS std
  FROM freq JOIN cat_mean ON "column" = c GROUP BY c)"""
_NUM_STATS = ", medians AS (SELECT " + ", ".join(
    f"coalesce(median({c}::DOUBLE), 0.0) AS {c}" for c in NUMERIC
) + " FROM train), num_stats AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS c, any_value(m) AS median, CASE WHEN min(x) = max(x) THEN min(x) ELSE avg(x) END AS mean,
    CASE WHEN min(x) = max(x) THEN 1.0 ELSE stddev_pop(x) END AS std
    FROM (SELECT medians.{c} AS m, coalesce(train.{c}::DOUBLE, medians.{c}) AS x FROM train, medians)""" for c in NUMERIC
) + ")"
_MODEL = _SPLIT_TX + _FREQ + _CAT_STATS + _NUM_STATS


_X = "x AS (SELECT vec_id AS id, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS value FROM embeddings WHERE label = 0)"
_ENCODE = 64, [128, 64, 8], 0
_DECODE = 8, [64, 128, 64], 64 * 128 + 128 + 128 * 64 + 64 + 64 * 8 + 8


def _layer_parts(source: str, width: int, widths: list[int], at: int, h: str = "h") -> str:
    """Dense layers with weights drawn by number from ``at`` on, rectified except the last, from ``source(id, pos, value)``."""
    draw = lambda number: f"(({_u('weight', f'({number})')} - 0.5) * 0.2)"
    parts = [f"{h}0 AS (SELECT * FROM {source})"]
    for i, columns in enumerate(widths):
        w = f"{h}w{i} AS (SELECT r, c, {draw(f'{at} + r * {columns} + c')} AS w FROM range({width}) a(r), range({columns}) b(c))"
        b = f"{h}b{i} AS (SELECT c, {draw(f'{at + width * columns} + c')} AS b FROM range({columns}) t(c))"
        z = "sum(value * w) + any_value(b)"
        made = z if i == len(widths) - 1 else f"greatest({z}, 0.0)"
        parts += [w, b, f"{h}{i + 1} AS (SELECT id, c AS pos, {made} AS value FROM {h}{i} JOIN {h}w{i} ON r = pos JOIN {h}b{i} USING (c) GROUP BY id, c)"]
        at, width = at + width * columns + columns, columns
    return ", ".join(parts)


def _layers(source: str, *layers) -> str:
    return f"WITH {_X}, {_layer_parts(source, *layers)} SELECT id, CAST(pos AS INTEGER) AS pos, {_r('value', 'value')} FROM h3"


def _number_code(c: str) -> str:
    s = f"(SELECT {{}} FROM num_stats WHERE c = '{c}')"
    x = f"coalesce(stx.{c}::DOUBLE, {s.format('median')})"
    return f"greatest(-10.0, least(10.0, ({x} - {s.format('mean')}) / {s.format('std')}))::FLOAT"


def _category_code(c: str, scaled: bool) -> str:
    f = f"coalesce(f_{c}.f, 0.0)"
    if not scaled:
        return f"({f})::FLOAT"
    s = f"(SELECT {{}} FROM cat_stats WHERE c = '{c}')"
    return f"greatest(-10.0, least(10.0, ({f} - {s.format('mean')}) / {s.format('std')}))::FLOAT"


_LOOKUPS = "".join(
    f""" LEFT JOIN freq f_{c} ON f_{c}."column" = '{c}' AND f_{c}."value" = coalesce(CAST(stx.{c} AS VARCHAR), '{MISSING_TOKEN}')"""
    for c in CATEGORICAL
)
_DENSE = _MODEL + ", dense AS (SELECT id, y, split, " + ", ".join(
    [f"{_category_code(c, True)} AS {c}" for c in CATEGORICAL] + [f"{_number_code(c)} AS {c}" for c in NUMERIC]
) + f" FROM stx{_LOOKUPS})"
_MIXED = _MODEL + ", mixed AS (SELECT id, y, split, " + ", ".join(
    [f"{_number_code(c)} AS {c}" for c in NUMERIC] + [f"{_category_code(c, False)} AS {c}_frequency" for c in CATEGORICAL]
) + f" FROM stx{_LOOKUPS})"


def _rounded(columns: list[str]) -> str:
    return ", ".join(_r(f"{c}::DOUBLE", c) for c in columns)


_NAMES = [name for name, _ in SCENARIOS]
_SCORES = _FACTS + ", scores AS (" + " UNION ALL ".join(
    f"""SELECT id, y, '{name}' AS scenario,
    round(0.6::DOUBLE * {_u(name, 'id')} + {pull}::DOUBLE * CAST(o_orderstatus = 'F' AS DOUBLE), {places}) AS score FROM facts"""
    for name, pull, places in SCORE_RECIPES
) + ")"


def _cumulative(scores: str) -> str:
    return f""", cells AS (
  SELECT scenario, score, sum(y)::BIGINT AS pos, sum(1 - y)::BIGINT AS neg FROM {scores} GROUP BY 1, 2),
cum AS (
  SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY scenario) AS p,
    sum(neg) OVER (PARTITION BY scenario) AS n, lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg,
    row_number() OVER w AS rn
  FROM cells WINDOW w AS (PARTITION BY scenario ORDER BY score DESC))"""


_AP_SQL = "sum(pos * tp / (tp + fp)::DOUBLE) / sum(pos)"
# ranks: each positive beats the negatives below it, and half of those at its score
_AUC_SQL = "sum(pos::DOUBLE * ((n - fp) + neg / 2.0)) / (any_value(p)::DOUBLE * any_value(n))"


def _grid_sql(rounded: bool) -> str:
    return "grid AS (SELECT unnest([" + ", ".join(f"{t!r}::DOUBLE" for t in threshold_grid(rounded)) + "]) AS threshold)"


_PRF = """coalesce(tp / nullif(k, 0)::DOUBLE, 0.0) AS precision, coalesce(tp / nullif(p, 0)::DOUBLE, 0.0) AS recall,
    coalesce(2 * tp / nullif(k + p, 0)::DOUBLE, 0.0) AS f1"""


def _sweep(scores: str, rounded: bool) -> str:
    return f""", {_grid_sql(rounded)}, hits AS (
  SELECT scenario, threshold, sum(CASE WHEN score >= threshold THEN m ELSE 0 END)::BIGINT AS k,
    sum(CASE WHEN score >= threshold THEN mp ELSE 0 END)::BIGINT AS tp, sum(mp)::BIGINT AS p
  FROM (SELECT scenario, score, count(*) AS m, sum(y) AS mp FROM {scores} GROUP BY 1, 2), grid GROUP BY 1, 2),
sweep AS (SELECT scenario, threshold, {_PRF} FROM hits),
marked AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY f1 DESC, recall DESC, threshold) = 1 AS selected FROM sweep)"""


_DIMENSION = "dim AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{name}', '{label}')" for i, (name, label) in enumerate(SCENARIOS)
) + ") v(position, scenario, label))"
_AP_TABLE = _SCORES + _cumulative("scores") + f", ap AS (SELECT scenario, {_AP_SQL} AS average_precision FROM cum GROUP BY 1), {_DIMENSION}"
_METRIC_COLUMNS = ", ".join(_r(c, c) for c in ("threshold", "precision", "recall", "f1"))

_VECTORS = "vectors AS (SELECT vec_id AS id, CAST(label = 0 AS INTEGER) AS y, embedding::DOUBLE[] AS x FROM embeddings)"


def _neighbours(rows: str) -> str:
    """kNN and SMOTE over ``rows(id, y, x)`` by brute force."""
    return f""", minority AS (SELECT id, x, row_number() OVER (ORDER BY id) - 1 AS position FROM {rows} WHERE y = 1),
pairs AS (
  SELECT a.id, b.id AS neighbor_id, round(list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9) AS d2
  FROM minority a JOIN minority b ON a.id <> b.id),
near AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, neighbor_id) AS rank FROM pairs)
  WHERE rank <= {K_NEIGHBORS}),
size AS (SELECT count(*) AS m, least({K_NEIGHBORS}, count(*) - 1) AS k FROM minority),
wanted AS (
  SELECT greatest(0, round_even(sum(1 - y) / (1.0 - {_RATE})::DOUBLE - count(*), 0))::BIGINT AS n FROM {rows})"""


_MADE_ROWS = f""", draws AS (
  SELECT i, floor({_u('a', 'i')} * m)::BIGINT AS position, floor({_u('b', 'i')} * k)::BIGINT + 1 AS rank, {_u('l', 'i')} AS share
  FROM (SELECT unnest(range((SELECT n FROM wanted))) AS i), size),
made AS (
  SELECT i, a.id AS anchor_id, n.neighbor_id, share, a.x AS ax, b.x AS bx
  FROM draws d JOIN minority a USING (position) JOIN near n ON n.id = a.id AND n.rank = d.rank JOIN minority b ON b.id = n.neighbor_id),
long AS (SELECT i, anchor_id, neighbor_id, share, unnest(ax) AS av, unnest(bx) AS bv, generate_subscripts(ax, 1) - 1 AS pos FROM made)"""
_MADE = f"""{_MADE_ROWS}
SELECT i, anchor_id, neighbor_id, {_r('share', 'share')}, pos::INTEGER AS pos, {_r('av + share * (bv - av)', '"value"')} FROM long"""

_GRID = "grid AS (SELECT cell, latent_dim, rate, avg(o_totalprice) / max(o_totalprice) AS average_precision FROM (SELECT (o_orderkey % 20)::INTEGER AS cell, " + (
    f"[{', '.join(map(str, LATENT_GRID))}][((o_orderkey % 20) // 5 + 1)::INTEGER] AS latent_dim, "
    f"[{', '.join(f'{r}::DOUBLE' for r in RATE_GRID)}][(o_orderkey % 5 + 1)::INTEGER] AS rate, o_totalprice FROM orders) GROUP BY ALL)"
)
_GRID_COLUMNS = f"cell, latent_dim, {_r('rate', 'rate')}, {_r('average_precision', 'average_precision')}"


def _stumps(trees: int, step: float, weight: float, least: int) -> str:
    """``g0`` to ``g<trees>``: the rows with the summed outputs ``f`` of so many trees of one split.

    A tree is fitted to the slope of the log loss at ``f``; its split leaves the smallest squared error."""
    label = lambda t: "s" if t == 0 else "4 * s / (1 + exp(2 * s * f))"
    parts = [f"""g0 AS MATERIALIZED (SELECT l_orderkey, l_linenumber, {', '.join(LINE_FEATURES)}, y, 2 * y - 1 AS s,
        CASE WHEN y = 1 THEN {weight} ELSE 1.0 END::DOUBLE AS w, 0.0::DOUBLE AS f
        FROM (SELECT *, coalesce(l_extendedprice > {DEAR_LINE}, false)::INTEGER AS y FROM lineitem))"""]
    for t in range(trees):
        counted = " UNION ALL ".join(
            f"SELECT {i} AS c, {x} AS v, count(*) AS n, sum(w) AS w, sum(w * {label(t)}) AS m FROM g{t} GROUP BY {x}" for i, x in enumerate(LINE_FEATURES)
        )
        parts.append(f"""c{t} AS (SELECT c, v, sum(n) OVER up AS n, sum(w) OVER up AS w, sum(m) OVER up AS m,
            sum(n) OVER (PARTITION BY c) AS an, sum(w) OVER (PARTITION BY c) AS aw, sum(m) OVER (PARTITION BY c) AS am
            FROM ({counted}) WINDOW up AS (PARTITION BY c ORDER BY v))""")
        parts.append(f"""b{t} AS MATERIALIZED (SELECT c, v, m / w AS low, (am - m) / (aw - w) AS high FROM c{t}
            WHERE n >= {least} AND an - n >= {least} ORDER BY m * m / w + (am - m) * (am - m) / (aw - w) DESC, c, v LIMIT 1)""")
        side = "CASE c " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(LINE_FEATURES)) + " END <= v"
        parts.append(f"g{t + 1} AS MATERIALIZED (SELECT g{t}.* EXCLUDE (f), f + {1.0 if t == 0 else step} * CASE WHEN {side} THEN low ELSE high END AS f FROM g{t}, b{t})")
    return ", ".join(parts)


def statements() -> dict[str, str]:
    sql: dict[str, str] = {}
    tx_columns = ["o_totalprice", "sum_price", "avg_discount"]
    shared = f"id, y, o_custkey, o_orderstatus, max_returnflag, n_lines::DOUBLE AS n_lines, {_rounded(tx_columns)}"
    sql["left_join_side"] = f"WITH {_TX} SELECT {shared}, {_rounded(['const_one', 'all_null'])} FROM tx"
    sql["csv_source"] = f"WITH {_TX} SELECT {shared} FROM tx"
    sql["stratified_split"] = f"WITH {_SPLIT_FACTS} SELECT id, y, split FROM sf"
    sql["split_summary"] = (
        f"WITH {_SPLIT_FACTS} SELECT split, count(*) AS rows, sum(y)::BIGINT AS fraud_count, {_r('avg(y)', 'fraud_rate')} FROM sf GROUP BY 1"
    )
    sql["rate_percent"] = f"WITH {_SPLIT_FACTS} SELECT split, {_r('avg(y) * 100', 'fraud_rate_percent')} FROM sf GROUP BY 1"
    common = lambda a, b: (
        f"(SELECT count(*) FROM (SELECT id FROM sf WHERE split = '{a}' INTERSECT SELECT id FROM sf WHERE split = '{b}')) AS {a}_{b}"
    )
    sql["split_disjoint"] = (
        f"WITH {_SPLIT_FACTS} SELECT (SELECT count(DISTINCT id) FROM sf) AS keys, "
        f"{common('train', 'validation')}, {common('train', 'test')}, {common('validation', 'test')}"
    )
    sql["dup_keys"] = "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"
    sql["null_target"] = "SELECT d.doc_id, lang, source, n_chars FROM documents d LEFT JOIN labels l USING (doc_id) WHERE toxic IS NULL"
    sql["freq_table"] = f"""WITH {_SPLIT_TX}{_FREQ} SELECT "column", "value", n, {_r('f', 'f')} FROM freq"""
    sql["num_stats"] = (
        f"""WITH {_MODEL} SELECT c AS "column", 'numeric' AS role, {_r('median', 'median')}, {_r('mean', 'mean')}, {_r('std', 'std')} FROM num_stats
        UNION ALL SELECT c, 'categorical', NULL::DOUBLE, round(mean, 6) + 0.0, round(std, 6) + 0.0 FROM cat_stats"""
    )
    sql["preprocessing_summary"] = f"""SELECT 'A1_frequency_median_zscore' AS kind, 'train split only' AS fit_scope,
        {len(CATEGORICAL) + len(NUMERIC)} AS raw_feature_count, {len(NUMERIC)} AS numeric_feature_count,
        {len(CATEGORICAL)} AS categorical_feature_count, {len(CATEGORICAL) + len(NUMERIC)} AS transformed_feature_count,
        '{','.join(sorted(CATEGORICAL))}' AS ieee_categorical_columns_used, 10.0::DOUBLE AS zscore_clip"""
    sql["encode_dense"] = f"WITH {_DENSE} SELECT id, y, split, {_rounded(CATEGORICAL + NUMERIC)} FROM dense"
    sql["saved_preprocessor"] = sql["encode_dense"]
    sql["encode_mixed"] = (
        f"WITH {_MIXED} SELECT id, y, split, {_rounded(NUMERIC + [c + '_frequency' for c in CATEGORICAL])} FROM mixed"
    )
    raw = "CASE WHEN event_type = 'error' THEN event_type ELSE value::VARCHAR END"
    sql["coerce_numeric"] = f"SELECT event_id, {_r(f'TRY_CAST({raw} AS DOUBLE)', 'number')} FROM events"
    bad = lambda c: f"count(*) FILTER (WHERE {c} IS NULL OR NOT isfinite({c})) AS {c}"
    sql["finite_check"] = f"WITH {_DENSE} SELECT count(*) AS rows, {', '.join(bad(c) for c in CATEGORICAL + NUMERIC)} FROM dense"
    weights = f"sum(1 - y)::BIGINT AS n0, sum(y)::BIGINT AS n1, {_r('sum(1 - y) / greatest(sum(y), 1)::DOUBLE', 'pos_weight')}"
    sql["class_weight"] = f"WITH {_SPLIT_FACTS} SELECT split, {weights} FROM sf GROUP BY 1"
    sql["class_weight_train"] = f"WITH {_SPLIT_FACTS} SELECT {weights} FROM sf WHERE split = 'train'"
    sql["synth_counts"] = (
        f"""WITH {_SPLIT_FACTS}, c AS (SELECT sum(1 - y)::DOUBLE AS n0, sum(y)::DOUBLE AS n1 FROM sf WHERE split = 'train'),
        r AS (SELECT unnest([{', '.join(f'{r}::DOUBLE' for r in RATE_GRID)}]) AS rate)
        SELECT {_r('rate', 'rate')}, greatest(0, round_even(n0 / (1.0 - rate) - (n0 + n1), 0))::BIGINT AS n_synthetic FROM c, r"""
    )
    cum = f"WITH {_SCORES}{_cumulative('scores')}"
    sql["average_precision"] = f"{cum} SELECT scenario, {_r(_AP_SQL, 'average_precision')} FROM cum GROUP BY 1"
    sql["roc_auc"] = f"{cum} SELECT scenario, {_r(_AUC_SQL, 'roc_auc')} FROM cum GROUP BY 1"
    at = f"sum(CASE WHEN score >= {_THRESHOLD} THEN 1 ELSE 0 END) AS k, sum(CASE WHEN score >= {_THRESHOLD} THEN y ELSE 0 END) AS tp, sum(y) AS p"
    sql["metrics_at_threshold"] = (
        f"WITH {_SCORES}, c AS (SELECT scenario, {_THRESHOLD}::DOUBLE AS threshold, {at} FROM scores GROUP BY 1), "
        f"m AS (SELECT scenario, threshold, {_PRF} FROM c) SELECT scenario, {_METRIC_COLUMNS} FROM m"
    )
    sql["decisions"] = f"WITH {_SCORES} SELECT id, scenario, CAST(score >= {_THRESHOLD} AS INTEGER) AS decision FROM scores"
    sql["threshold_sweep"] = f"WITH {_SCORES}{_sweep('scores', False)} SELECT scenario, {_METRIC_COLUMNS} FROM sweep"
    sql["threshold_sweep_rounded"] = f"WITH {_SCORES}{_sweep('scores', True)} SELECT scenario, {_METRIC_COLUMNS}, selected FROM marked"
    sql["best_threshold"] = f"WITH {_SCORES}{_sweep('scores', True)} SELECT scenario, {_METRIC_COLUMNS} FROM marked WHERE selected"
    sql["pr_curve"] = (
        f"{cum} SELECT scenario, {_r('score', 'threshold')}, {_r('tp / (tp + fp)::DOUBLE', 'precision')}, {_r('tp / p::DOUBLE', 'recall')} FROM cum "
        "UNION ALL SELECT DISTINCT scenario, NULL::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE FROM cum"
    )
    roc = f"scenario, {_r('score', 'threshold')}, {_r('fp / n::DOUBLE', 'fpr')}, {_r('tp / p::DOUBLE', 'tpr')} FROM cum"
    origin = "UNION ALL SELECT DISTINCT scenario, NULL::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM cum"
    sql["roc_curve"] = f"{cum} SELECT {roc} WHERE rn = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg {origin}"
    sql["roc_curve_full"] = f"{cum} SELECT {roc} {origin}"
    sql["knn"] = f"WITH {_VECTORS}{_neighbours('vectors')} SELECT id, rank::INTEGER AS rank, neighbor_id, {_r('d2', 'd2')} FROM near"
    sql["smote_vectors"] = f"WITH {_VECTORS}{_neighbours('vectors')}{_MADE}"
    packed = "[" + ", ".join(f"{c}::DOUBLE" for c in CATEGORICAL + NUMERIC) + "]"
    # MATERIALIZED: the encoded rows are used several times
    feature_rows = f"{_DENSE}, encoded AS MATERIALIZED (SELECT id, y, {packed} AS x FROM dense WHERE split = 'train')"
    sql["smote_features"] = f"WITH {feature_rows}{_neighbours('encoded')}{_MADE}"
    sql["augmented_rate"] = (
        f"WITH {_VECTORS}{_neighbours('vectors')} SELECT count(*) + any_value(n) AS rows, "
        f"{_r('(sum(y) + any_value(n)) / (count(*) + any_value(n))::DOUBLE', 'fraud_rate')} FROM vectors, wanted"
    )
    pivot = ", ".join(_r(f"max(CASE WHEN scenario = '{s}' THEN score END)", s) for s in _NAMES)
    sql["scores_wide"] = f"WITH {_SCORES} SELECT id, y, {pivot} FROM scores GROUP BY 1, 2"
    held_out = f"{_SCORES}{_SPLIT}, held AS (SELECT s.*, split FROM scores s JOIN split USING (id)), v AS (SELECT * FROM held WHERE split = 'validation'), t AS (SELECT * FROM held WHERE split = 'test')"
    sql["scenario_metrics"] = (
        f"WITH {held_out}{_cumulative('t')}{_sweep('v', False)}, {_DIMENSION}, "
        f"rank_part AS (SELECT scenario, {_AP_SQL} AS average_precision, {_AUC_SQL} AS roc_auc FROM cum GROUP BY 1), "
        "counted AS (SELECT t.scenario, threshold, sum(CASE WHEN score >= threshold THEN 1 ELSE 0 END) AS k, "
        "sum(CASE WHEN score >= threshold THEN y ELSE 0 END) AS tp, sum(y) AS p FROM t JOIN marked m ON m.scenario = t.scenario AND selected GROUP BY 1, 2), "
        f"cut_part AS (SELECT scenario, threshold, {_PRF} FROM counted) "
        f"SELECT position, scenario, label, {_r('average_precision', 'average_precision')}, {_r('roc_auc', 'roc_auc')}, {_METRIC_COLUMNS} "
        "FROM dim JOIN rank_part USING (scenario) JOIN cut_part USING (scenario)"
    )
    pairs = ", ".join(f"('{c}', '{a}', '{b}')" for c, a, b in COMPARISONS)
    sql["scenario_deltas"] = (
        f"WITH {_AP_TABLE}, wanted AS (SELECT * FROM (VALUES {pairs}) v(comparison, a, b)) "
        f"SELECT comparison, {_r('x.average_precision - z.average_precision', 'delta')} FROM wanted JOIN ap x ON x.scenario = a JOIN ap z ON z.scenario = b"
    )
    ap = _r("average_precision", "average_precision")
    sql["best_scenario"] = (
        f"WITH {_AP_TABLE} SELECT position, scenario, label, {ap} FROM dim JOIN ap USING (scenario) ORDER BY ap.average_precision DESC, position LIMIT 1"
    )
    sql["ap_bars"] = f"WITH {_AP_TABLE} SELECT position, label, {ap}, scenario LIKE '%\\_tuned' ESCAPE '\\' AS tuned FROM dim JOIN ap USING (scenario)"
    sql["curve_scenarios"] = f"WITH {_SCORES} SELECT DISTINCT scenario FROM scores WHERE ends_with(scenario, '_tuned')"
    sql["drawn_pr_curves"] = f"SELECT * FROM ({sql['pr_curve']}) WHERE ends_with(scenario, '_tuned')"
    sql["drawn_roc_curves_untuned"] = f"SELECT * FROM ({sql['roc_curve']}) WHERE NOT ends_with(scenario, '_tuned')"
    sql["best_threshold_table"] = (
        f"WITH {_AP_TABLE}{_sweep('scores', True)} SELECT scenario, {_METRIC_COLUMNS}, selected FROM marked "
        "WHERE scenario = (SELECT scenario FROM dim JOIN ap USING (scenario) ORDER BY average_precision DESC, position LIMIT 1)"
    )
    sql["csv_dirty"] = """
      SELECT doc_id, '<' || replace(replace(substr(coalesce(text, ''), 1, 30), chr(13), ' '), chr(10), ' ') || ', "' || lang || '">' AS title,
        CASE WHEN doc_id % 5 < 2 THEN NULL WHEN doc_id % 5 = 2 THEN n_chars::DOUBLE ELSE n_chars + 0.5 END::DOUBLE AS size,
        CASE doc_id % 5 WHEN 3 THEN NULL WHEN 4 THEN '1.0d' ELSE n_chars::VARCHAR END AS code, NULL::DOUBLE AS hole
      FROM documents"""
    sql["csv_whole_text"] = """
      SELECT doc_id, '<' || coalesce(text, '') || ', "' || lang || '">' AS title,
        CASE WHEN doc_id % 5 < 2 THEN NULL WHEN doc_id % 5 = 2 THEN n_chars::DOUBLE ELSE n_chars + 0.5 END::DOUBLE AS size,
        CASE doc_id % 5 WHEN 3 THEN NULL WHEN 4 THEN '1.0d' ELSE n_chars::VARCHAR END AS code, NULL::DOUBLE AS hole
      FROM documents"""
    sql["csv_round_trip"] = f"SELECT o_orderkey, o_orderstatus, {_r('o_totalprice', 'o_totalprice')}, o_orderpriority FROM orders"
    sql["json_round_trip"] = (
        f"SELECT o_custkey, o_orderkey, {_r('o_totalprice', 'o_totalprice')}, o_orderstatus AS status, o_orderpriority AS priority FROM orders"
    )
    u = lambda name: _u(name, "trial")
    whole = lambda low, high, name: f"CAST({low} + floor({u(name)} * {high - low + 1}) AS INTEGER) AS {name}"
    sql["trial_draws"] = (
        "WITH t AS (SELECT CAST(o_orderkey % 10 AS INTEGER) AS trial, count(*) AS orders FROM orders GROUP BY 1) SELECT trial, orders, "
        + _r(f"exp(ln(0.01) + {u('learning_rate')} * (ln(0.1) - ln(0.01)))", "learning_rate")
        + f", {whole(16, 256, 'num_leaves')}, {whole(10, 200, 'min_child_samples')}, "
        + _r(f"0.5 + 0.5 * {u('subsample')}", "subsample") + ", " + _r(f"0.5 + 0.5 * {u('colsample_bytree')}", "colsample_bytree") + " FROM t"
    )
    sql["required_tables"] = f"WITH {_FACTS} SELECT 'facts' AS table_name, true AS found, count(*) AS rows FROM facts UNION ALL SELECT 'sides', false, 0"
    stumps = f"WITH {_stumps(3, 0.3, 3.0, 50)}"
    sql["gbt_stumps"] = f"{stumps} SELECT l_orderkey, l_linenumber, {_r('1 / (1 + exp(-2 * f))', 'score')} FROM g3"
    prefixes = " UNION ALL ".join(f"SELECT {t} AS scenario, y, f AS score FROM g{t}" for t in (1, 2, 3))
    sql["gbt_stumps_staged_ap"] = (
        f"{stumps}, scores AS ({prefixes}){_cumulative('scores')} SELECT scenario AS iteration, {_r(_AP_SQL, 'average_precision')} FROM cum GROUP BY 1"
    )
    sql["ae_encode_fixed"] = _layers("x", *_ENCODE)
    sql["ae_decode_fixed"] = _layers("x WHERE pos < 8", *_DECODE)
    sql["ae_oversample_fixed"] = (
        f"WITH {_VECTORS}, {_X}, {_layer_parts('x', *_ENCODE)}, latent AS (SELECT id, list(value ORDER BY pos) AS x FROM h3 GROUP BY id), "
        f"coded AS MATERIALIZED (SELECT v.id, v.y, l.x FROM vectors v LEFT JOIN latent l USING (id)){_neighbours('coded')}{_MADE_ROWS}, "
        f"midway AS (SELECT i AS id, pos, av + share * (bv - av) AS value FROM long), {_layer_parts('midway', *_DECODE, 'd')}, "
        "every AS (SELECT -id - 1 AS id, 1 AS y, true AS is_synthetic, pos, value FROM d3 "
        "UNION ALL SELECT id, y, false, unnest(range(64)), unnest(x) FROM vectors) "
        f"SELECT id, y, is_synthetic, pos::INTEGER AS pos, {_r('value::FLOAT::DOUBLE', '\"value\"')} FROM every"
    )
    by_rate = ", ".join(_r(f"max(CASE WHEN rate = {r} THEN average_precision END)", f"rate_{round(r * 100):02d}") for r in RATE_GRID)
    sql["sensitivity_pivot"] = f"WITH {_GRID} SELECT latent_dim, {by_rate} FROM grid GROUP BY 1"
    sql["sensitivity_top"] = f"WITH {_GRID} SELECT {_GRID_COLUMNS} FROM grid ORDER BY grid.average_precision DESC, cell LIMIT 10"
    sql["best_cell"] = f"WITH {_GRID} SELECT {_GRID_COLUMNS} FROM grid ORDER BY grid.average_precision DESC, cell LIMIT 1"
    return sql
