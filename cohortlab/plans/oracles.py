"""The registered queries as plain SQL for DuckDB, written without the Spark-side tricks."""

from __future__ import annotations

import math

from cohortlab.operators import explain, kernel_svm, services
from cohortlab.plans import catalog, fixed_scores
from cohortlab.sources.cohorts import DOCUMENTS, ORDERS

LEAN = ORDERS.without_leakage().features
FULL = ORDERS.features
CODED = "o_orderpriority"


def number(x: float) -> str:
    """A literal that DuckDB reads as DOUBLE."""
    text = repr(float(x))
    return text if "e" in text else f"{text}e0"


def dbl(c: str) -> str:
    return f"CAST({c} AS DOUBLE)"


def with_(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


# --- inputs --------------------------------------------------------------------

LINES = """li AS (
  SELECT l_orderkey, count(*) AS n_lines,
         CAST(sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS BIGINT) AS gross_cents,
         max(CAST(round(l_extendedprice*100) AS BIGINT)) AS max_line_cents,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty,
         CAST(sum(CAST(round(l_discount*100) AS BIGINT)) AS BIGINT) AS disc_pts,
         CAST(sum(CAST(round(l_tax*100) AS BIGINT)) AS BIGINT) AS tax_pts,
         max(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END) AS any_return
  FROM lineitem GROUP BY l_orderkey)"""

_ORDER_COLUMNS = """o.o_orderkey AS row_id, o.o_custkey, o.o_orderpriority,
         li.n_lines, li.gross_cents, li.max_line_cents, li.qty, li.disc_pts, li.tax_pts, li.any_return,
         CAST(round(o.o_totalprice*100) AS BIGINT) AS total_cents,
         CAST(round(c.c_acctbal*100) AS BIGINT) AS acctbal_cents, c.c_nationkey"""

COHORT = f"""{LINES},
cohort AS (
  SELECT {_ORDER_COLUMNS},
         CASE WHEN li.gross_cents >= 6000000 THEN 1 ELSE 0 END AS target
  FROM orders o JOIN li ON li.l_orderkey = o.o_orderkey
                JOIN customer c ON c.c_custkey = o.o_custkey)"""

RAW_REQUESTS = f"""{LINES},
raw_requests AS (
  SELECT {_ORDER_COLUMNS}
  FROM orders o LEFT JOIN li ON li.l_orderkey = o.o_orderkey
                JOIN customer c ON c.c_custkey = o.o_custkey)"""

CODES = """codes AS (
  SELECT o_orderpriority AS name, CAST(row_number() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS code
  FROM (SELECT DISTINCT o_orderpriority FROM orders))"""

ENCODED = f"""{COHORT},
{CODES},
encoded AS (
  SELECT cohort.* EXCLUDE (o_orderpriority), codes.code AS o_orderpriority
  FROM cohort JOIN codes ON codes.name = cohort.o_orderpriority)"""


def quota_ctes(source: str, total: str, seed: str = "42") -> str:
    """Per-class quotas for ``total`` (an expression over n_all), largest remainders first."""
    return f"""counts AS (SELECT target, count(*) AS n FROM {source} GROUP BY target),
want AS (SELECT target, n, CAST(sum(n) OVER () AS BIGINT) AS n_all FROM counts),
goal AS (SELECT target, n, n_all, CAST({total} AS BIGINT) AS t FROM want),
shares AS (SELECT target, t, (t*n)//n_all AS base, (t*n)%n_all AS rest FROM goal),
quotas AS (
  SELECT target, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, target)
                                  <= t - sum(base) OVER () THEN 1 ELSE 0 END AS quota
  FROM shares)"""


def split_cte(source: str = "encoded", seed: int = 42, name: str = "data") -> str:
    return f"""{name} AS (
  SELECT s.*, CASE WHEN row_number() OVER (PARTITION BY s.target
                        ORDER BY md5('{seed}|' || CAST(s.row_id AS VARCHAR)), s.row_id) <= q.quota
                   THEN 'test' ELSE 'train' END AS split
  FROM {source} s JOIN quotas q ON q.target = s.target)"""


SPLIT = f"""{ENCODED},
{quota_ctes("encoded", "ceil(0.2e0*n_all)")},
{split_cte()}"""


def linear_sql(intercept: float, weights: dict[str, float]) -> str:
    terms = [number(intercept)] + [f"{number(w)}*{dbl(c)}" for c, w in weights.items()]
    return " + ".join(terms)


def logistic_sql(intercept: float, weights: dict[str, float]) -> str:
    return f"round(1e0/(1e0+exp(-({linear_sql(intercept, weights)}))), {fixed_scores.SCORE_DIGITS})"


def scored_ctes(source: str, extra=()) -> str:
    more = "".join(f", {c}" for c in extra)
    parts = []
    exprs = {k: logistic_sql(b, w) for k, (b, w) in fixed_scores.LINEAR.items()}
    exprs.update({k: f"round({exprs[s]}, {fixed_scores.COARSE_DIGITS})" for k, s in fixed_scores.COARSE.items()})
    for (e, m), p in exprs.items():
        parts.append(
            f"SELECT '{e}' AS experiment, '{m}' AS model, row_id, target AS y, {p} AS p{more} FROM {source}"
        )
    union = "\n  UNION ALL ".join(parts)
    return f"""raw_scores AS ({union}),
scored AS (SELECT *, CASE WHEN p >= 0.5e0 THEN 1 ELSE 0 END AS yhat FROM raw_scores)"""


SCORED = f"""{COHORT},
{scored_ctes("cohort")}"""


def conf_cte(source: str, keys: str = "experiment, model", name: str = "conf") -> str:
    return f"""{name} AS (
  SELECT {keys},
         CAST(sum(CASE WHEN y=1 AND yhat=1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
         CAST(sum(CASE WHEN y=0 AND yhat=1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
         CAST(sum(CASE WHEN y=0 AND yhat=0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
         CAST(sum(CASE WHEN y=1 AND yhat=0 THEN 1 ELSE 0 END) AS BIGINT) AS fn
  FROM {source} GROUP BY {keys})"""


def div(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) <> 0 THEN ({a})::DOUBLE/({b})::DOUBLE ELSE 0e0 END"


P0, P1 = div("tn", "tn+fn"), div("tp", "tp+fp")
R0, R1 = div("tn", "tn+fp"), div("tp", "tp+fn")
F0, F1 = div("2*tn", "2*tn+fn+fp"), div("2*tp", "2*tp+fp+fn")
ACC = "(tp+tn)::DOUBLE/(tp+fp+tn+fn)::DOUBLE"
# All metric queries run on data that holds both classes.
MET = {
    "accuracy": ACC,
    "balanced_accuracy": f"(({R0}) + ({R1}))/2e0",
    "precision": P1,
    "recall": R1,
    "f1": F1,
    "macro_precision": f"(({P0}) + ({P1}))/2e0",
    "macro_recall": f"(({R0}) + ({R1}))/2e0",
    "macro_f1": f"(({F0}) + ({F1}))/2e0",
}
CHANCE = (
    "(((tp+fp)::DOUBLE*(tp+fn)::DOUBLE) + ((fn+tn)::DOUBLE*(fp+tn)::DOUBLE))"
    "/((tp+fp+tn+fn)::DOUBLE*(tp+fp+tn+fn)::DOUBLE)"
)
MET["cohen_kappa"] = f"CASE WHEN {CHANCE} <> 1e0 THEN (({ACC}) - {CHANCE})/(1e0 - {CHANCE}) END"


def met(names, digits: int = 4) -> str:
    return ", ".join(f"round({MET[m]}, {digits}) AS {m}" for m in names)


BY_VALUE = """byv AS (
  SELECT experiment, model, p, count(*) FILTER (WHERE y=1) AS pos, count(*) FILTER (WHERE y=0) AS neg
  FROM scored GROUP BY experiment, model, p)"""


def auc_cte(digits: int) -> str:
    return f"""{BY_VALUE},
below AS (
  SELECT *, coalesce(sum(neg) OVER (PARTITION BY experiment, model ORDER BY p
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lower_neg FROM byv),
auc AS (
  SELECT experiment, model,
         round(sum(pos::DOUBLE*(lower_neg::DOUBLE + neg::DOUBLE/2))/(sum(pos)::DOUBLE*sum(neg)::DOUBLE), {digits}) AS roc_auc
  FROM below GROUP BY experiment, model)"""


BOARD = f"""{SCORED},
{conf_cte("scored")},
{auc_cte(4)},
board AS (
  SELECT conf.experiment, conf.model, {met(MET)}, auc.roc_auc
  FROM conf JOIN auc ON auc.experiment = conf.experiment AND auc.model = conf.model),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY experiment ORDER BY balanced_accuracy DESC, model) AS INTEGER) AS position
  FROM board)"""

DESCENDING = f"""{SCORED},
{BY_VALUE},
cum AS (
  SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn,
         sum(pos) OVER (PARTITION BY experiment, model) AS tp_all,
         sum(neg) OVER (PARTITION BY experiment, model) AS tn_all,
         lead(pos) OVER (PARTITION BY experiment, model ORDER BY p DESC) AS next_pos,
         lead(neg) OVER (PARTITION BY experiment, model ORDER BY p DESC) AS next_neg
  FROM byv WINDOW w AS (PARTITION BY experiment, model ORDER BY p DESC
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def roc_body(where: str = "") -> str:
    return f"""SELECT experiment, model, p AS threshold,
       round(cn::DOUBLE/tn_all::DOUBLE, 6) AS fpr, round(cp::DOUBLE/tp_all::DOUBLE, 6) AS tpr
FROM cum {where}
UNION ALL
SELECT DISTINCT experiment, model, CAST(NULL AS DOUBLE), 0e0, 0e0 FROM byv"""


def means_cte(split: str, name: str = "means") -> str:
    cols = ", ".join(f"round(avg({dbl(c)}), 6) AS m_{c}" for c in LEAN)
    return f"{name} AS (SELECT {cols} FROM data WHERE split = '{split}')"


FILLED = f"""{SPLIT},
{means_cte("test")},
raw_requests AS (
  SELECT {_ORDER_COLUMNS}
  FROM orders o LEFT JOIN li ON li.l_orderkey = o.o_orderkey
                JOIN customer c ON c.c_custkey = o.o_custkey),
asked AS (
  SELECT r.* EXCLUDE (o_orderpriority), codes.code AS o_orderpriority
  FROM raw_requests r JOIN codes ON codes.name = r.o_orderpriority),
filled AS (
  SELECT row_id, CAST({" + ".join(f"(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in LEAN)} AS INTEGER) AS n_filled,
         {", ".join(f"coalesce({dbl(c)}, m_{c}) AS {c}" for c in LEAN)}
  FROM asked, means)"""

RISK_SQL = logistic_sql(fixed_scores.RISK_INTERCEPT, fixed_scores.RISK)
SCORED_REQUESTS = f"""{FILLED},
risky AS (SELECT *, {RISK_SQL} AS p FROM filled)"""


def phi_ctes(source: str) -> str:
    parts = [
        f"SELECT d.row_id, '{f}' AS feature, {dbl('d.' + f)} AS value, "
        f"round({number(w)}*({dbl('d.' + f)} - t.m_{f}), 6) AS phi FROM {source} d, train_means t"
        for f, w in fixed_scores.RISK.items()
    ]
    union = "\n  UNION ALL ".join(parts)
    return f"""{means_cte("train", "train_means")},
phis AS ({union})"""


PHI = f"""{SPLIT},
tested AS (SELECT * FROM data WHERE split = 'test'),
{phi_ctes("tested")}"""


def distance_sql(a: str, b: str, columns) -> str:
    return " + ".join(f"({dbl(a + c)} - {dbl(b + c)})*({dbl(a + c)} - {dbl(b + c)})" for c in columns)


def nearest_ctes(queries: str, points: str, key: str, columns, k: int, label: str | None, exclude: bool) -> str:
    pair = "struct_pack(d2 := d2, id := pid)"
    carried = f", p.{label} AS lab" if label else ", 0 AS lab"
    skip = f"WHERE q.{key} <> p.{key}" if exclude else ""
    return f"""pairs AS (
  SELECT q.{key} AS qid, p.{key} AS pid{carried}, {distance_sql("q.", "p.", columns)} AS d2
  FROM {queries} q, {points} p {skip}),
tops AS (
  SELECT qid, arg_min(struct_pack(d2 := d2, id := pid, lab := lab), {pair}, {k}) AS l FROM pairs GROUP BY qid),
unrolled AS (SELECT qid, unnest(l) AS e, generate_subscripts(l, 1) AS r FROM tops),
near AS (
  SELECT qid, CAST(r AS INTEGER) AS neighbor_rank, e.id AS neighbor_id, e.d2 AS d2, CAST(e.lab AS INTEGER) AS lab
  FROM unrolled)"""


EXACT_SCALER = "exact_scaler AS (SELECT " + ", ".join(
    f"avg({dbl(c)}) AS m_{c}, CASE WHEN min({c}) < max({c}) THEN stddev_pop({dbl(c)}) ELSE 0e0 END AS s_{c}" for c in LEAN
) + " FROM data WHERE split = 'train')"

# for distances, whose ties both engines must see alike
SCALER = f"{EXACT_SCALER},\nscaler AS (SELECT " + ", ".join(
    f"round(m_{c}, 6) AS m_{c}, round(s_{c}, 6) AS s_{c}" for c in LEAN
) + " FROM exact_scaler)"


def scaled(c: str) -> str:
    return f"({dbl(c)} - m_{c})/(CASE WHEN s_{c} = 0 THEN 1e0 ELSE s_{c} END)"


def smote_sql(columns, ratio: float) -> str:
    mixed = ", ".join(f"round(b.{c} + u*({dbl('n.' + c)} - b.{c}), 4) AS {c}" for c in columns)
    plain = ", ".join(f"round({dbl(c)}, 4) AS {c}" for c in columns)
    doubles = ", ".join(f"{dbl(c)} AS {c}" for c in columns)
    return with_(
        SPLIT,
        "train AS (SELECT * FROM data WHERE split = 'train')",
        "rare AS (SELECT * FROM train WHERE target = 0)",
        nearest_ctes("rare", "rare", "row_id", columns, 5, None, True),
        f"""amount AS (
  SELECT CAST(floor({number(ratio)}*count(*) FILTER (WHERE target=1)) AS BIGINT)
           - count(*) FILTER (WHERE target=0) AS n_new, count(*) FILTER (WHERE target=0) AS n_rare FROM train)""",
        f"""bases AS (
  SELECT row_id, {doubles},
         row_number() OVER (ORDER BY md5('42|' || CAST(row_id AS VARCHAR)), row_id) AS rnk FROM rare)""",
        """turns AS (
  SELECT b.*, n_rare, unnest(range(n_new//n_rare + CASE WHEN rnk <= n_new % n_rare THEN 1 ELSE 0 END)) AS turn
  FROM bases b, amount)""",
        """picked AS (
  SELECT *, CAST(('0x' || substr(md5('42|n|' || CAST(row_id AS VARCHAR) || '|' || CAST(turn AS VARCHAR)), 1, 8)) AS BIGINT) % 5 + 1 AS pick,
         CAST(('0x' || substr(md5('42|u|' || CAST(row_id AS VARCHAR) || '|' || CAST(turn AS VARCHAR)), 1, 8)) AS BIGINT)::DOUBLE/4294967296e0 AS u
  FROM turns)""",
        body=f"""SELECT row_id, target, 0 AS synthetic, row_id AS base_id, row_id AS neighbor_id, {plain}
FROM train
UNION ALL
SELECT -(b.turn*b.n_rare + b.rnk), 0, 1, b.row_id, x.neighbor_id, {mixed}
FROM picked b JOIN near x ON x.qid = b.row_id AND x.neighbor_rank = b.pick
              JOIN rare n ON n.row_id = x.neighbor_id""",
    )


def corr_sql(features, leakage, source_ctes: str, source: str) -> str:
    parts = [
        f"SELECT '{f}' AS feature, {int(f in leakage)} AS is_leakage, "
        f"round(corr({dbl(f)}, {dbl('target')}), 6) AS corr_target FROM {source}"
        for f in features
    ]
    return with_(source_ctes, body="\nUNION ALL ".join(parts))


def box_sql() -> str:
    long = "\n  UNION ALL ".join(
        f"SELECT '{f}' AS feature, target, {dbl(f)} AS value FROM cohort" for f in catalog.BOX_FEATURES
    )
    return with_(
        COHORT,
        f"long AS ({long})",
        """q AS (
  SELECT feature, target, count(*) AS n, min(value) AS minimum, quantile_cont(value, 0.25) AS q1,
         quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3, max(value) AS maximum
  FROM long GROUP BY feature, target)""",
        body="""SELECT q.feature, q.target, q.n, round(minimum, 4) AS minimum, round(q1, 4) AS q1, round(median, 4) AS median,
       round(q3, 4) AS q3, round(maximum, 4) AS maximum,
       round(min(value) FILTER (WHERE value >= q1 - 1.5e0*(q3-q1) AND value <= q3 + 1.5e0*(q3-q1)), 4) AS whisker_low,
       round(max(value) FILTER (WHERE value >= q1 - 1.5e0*(q3-q1) AND value <= q3 + 1.5e0*(q3-q1)), 4) AS whisker_high,
       count(*) FILTER (WHERE value < q1 - 1.5e0*(q3-q1) OR value > q3 + 1.5e0*(q3-q1)) AS n_outliers
FROM long JOIN q ON q.feature = long.feature AND q.target = long.target
GROUP BY q.feature, q.target, q.n, minimum, q1, median, q3, maximum""",
    )


def threshold_ctes(source: str, thresholds) -> str:
    values = ", ".join(f"({number(t)})" for t in thresholds)
    return f"""grid AS (SELECT * FROM (VALUES {values}) g(threshold)),
applied AS (
  SELECT experiment, model, threshold, y, CASE WHEN p >= threshold THEN 1 ELSE 0 END AS yhat
  FROM {source}, grid),
{conf_cte("applied", "experiment, model, threshold")}"""


THRESHOLDS = threshold_ctes("scored", [i / 20 for i in range(1, 19)])


def report_lines() -> str:
    pieces = []
    classes = (("0", P0, R0, F0, "tn+fp"), ("1", P1, R1, F1, "tp+fn"))
    for k, p, r, f, s in classes:
        pieces.append(
            f"SELECT experiment, model, '{ORDERS.labels[int(k)]}' AS label, round({p}, 4) AS precision, "
            f"round({r}, 4) AS recall, round({f}, 4) AS f1, {s} AS support FROM conf"
        )
    pieces.append(
        f"SELECT experiment, model, 'accuracy', NULL, NULL, round({ACC}, 4), tp+fp+tn+fn FROM conf"
    )
    macro = ", ".join(f"round((({a}) + ({b}))/2, 4)" for a, b in ((P0, P1), (R0, R1), (F0, F1)))
    pieces.append(f"SELECT experiment, model, 'macro avg', {macro}, tp+fp+tn+fn FROM conf")
    weighted = ", ".join(
        f"round((({a})*(tn+fp) + ({b})*(tp+fn))/(tp+fp+tn+fn)::DOUBLE, 4)" for a, b in ((P0, P1), (R0, R1), (F0, F1))
    )
    pieces.append(f"SELECT experiment, model, 'weighted avg', {weighted}, tp+fp+tn+fn FROM conf")
    return "\nUNION ALL ".join(pieces)


def unpivot(names, source: str, keys: str = "experiment, model") -> str:
    return "\nUNION ALL ".join(
        f"SELECT {keys}, '{m}' AS metric, {m} AS score FROM {source}" for m in names
    )


def tier(texts: dict[str, str]) -> str:
    low, moderate, high = (texts[n] for n in services.TIERS)
    return f"CASE WHEN p < 0.3e0 THEN '{low}' WHEN p < 0.7e0 THEN '{moderate}' ELSE '{high}' END"


def fold_sql(metric: str) -> str:
    return with_(
        COHORT,
        """folded AS (
  SELECT *, CAST((row_number() OVER (PARTITION BY target ORDER BY md5('42|' || CAST(row_id AS VARCHAR)), row_id) - 1) % 5 AS INTEGER) AS fold
  FROM cohort)""",
        scored_ctes("folded", ("fold",)),
        conf_cte("scored", "experiment, model, fold"),
        body=f"""SELECT experiment, model, count(*) AS n_folds, round(avg(s), 4) AS mean_score, round(stddev_pop(s), 4) AS std_score
FROM (SELECT experiment, model, {MET[metric]} AS s FROM conf) GROUP BY experiment, model""",
    )


def random_cuts_sql() -> str:
    """First cuts of random trees: draws by hash, class counts below each cut, best Gini gain."""
    long = "\n  UNION ALL ".join(f"SELECT target, '{f}' AS feature, {dbl(f)} AS v FROM data WHERE split = 'train'" for f in LEAN)

    def impure(a: str, b: str) -> str:
        return f"(1e0 - pow({a}/({a}+{b}), 2) - pow({b}/({a}+{b}), 2))"

    return with_(
        SPLIT,
        f"long AS ({long})",
        "ranges AS (SELECT feature, min(v) AS lo, max(v) AS hi FROM long GROUP BY feature HAVING min(v) < max(v))",
        f"trees AS (SELECT CAST(unnest(range({catalog.ROOT_TREES})) AS INTEGER) AS tree)",
        f"""drawn AS (
  SELECT *, row_number() OVER (PARTITION BY tree
                ORDER BY md5('42|' || tree || ':1:' || feature || ':order'), feature) AS slot
  FROM trees CROSS JOIN ranges QUALIFY slot <= {math.isqrt(len(LEAN))})""",
        """cuts AS (
  SELECT tree, feature, slot,
         lo + (hi - lo) * (CAST('0x' || substr(md5('42|' || tree || ':1:' || feature), 1, 8) AS BIGINT) / 4294967296e0) AS cut
  FROM drawn)""",
        """sides AS (
  SELECT tree, slot, c.feature, cut,
         count(*) FILTER (v <= cut AND target = 0) AS low_0, count(*) FILTER (v <= cut AND target = 1) AS low_1,
         count(*) FILTER (v > cut AND target = 0) AS high_0, count(*) FILTER (v > cut AND target = 1) AS high_1
  FROM cuts c JOIN long USING (feature) GROUP BY ALL)""",
        body=f"""SELECT tree, feature, cut, low_0, low_1, high_0, high_1 FROM sides
QUALIFY row_number() OVER (PARTITION BY tree ORDER BY
  ({impure('(low_0+high_0)::DOUBLE', '(low_1+high_1)::DOUBLE')}
   - (low_0+low_1)::DOUBLE/(low_0+low_1+high_0+high_1)*{impure('low_0::DOUBLE', 'low_1::DOUBLE')}
   - (high_0+high_1)::DOUBLE/(low_0+low_1+high_0+high_1)*{impure('high_0::DOUBLE', 'high_1::DOUBLE')}) DESC, slot) = 1""",
    )


def kernel_shap_sql() -> str:
    """Shapley values of three features from the scores of all eight coalitions."""
    intercept, weights = fixed_scores.LINEAR[("no_leakage", "pricing")]
    names = list(weights)

    def coalition(members: int) -> str:
        mixed = " + ".join(f"{number(w)}*{dbl(('t.' if members >> i & 1 else 'b.') + f)}" for i, (f, w) in enumerate(weights.items()))
        return f"avg(1e0/(1e0+exp(-({number(intercept)} + {mixed})))) AS v{members}"

    def phi(i: int) -> str:
        me = 1 << i
        j, k = (1 << o for o in range(3) if o != i)
        return f"round((v{me} - v0 + v7 - v{j | k})/3e0 + (v{me | j} - v{j} + v{me | k} - v{k})/6e0, 6)"

    return with_(
        SPLIT,
        "test AS (SELECT * FROM data WHERE split = 'test')",
        f"bg AS (SELECT * FROM test ORDER BY md5('42|bg|' || CAST(row_id AS VARCHAR)), row_id LIMIT {explain.BACKGROUND_ROWS})",
        f"scores AS (SELECT t.row_id, {', '.join(f'any_value(t.{f}) AS {f}' for f in names)}, {', '.join(map(coalition, range(8)))} FROM test t, bg b GROUP BY t.row_id)",
        body="\nUNION ALL ".join(
            f"SELECT row_id, '{f}' AS feature, {dbl(f)} AS value, {phi(i)} AS phi, round(v0, 6) AS base_value FROM scores"
            for i, f in enumerate(names)
        ),
    )


def svm_residuals_sql() -> str:
    """Three steps of a pivoted Cholesky factor, spelled out."""
    stats = ", ".join(
        f"avg({dbl(f)}) AS m_{f}, CASE WHEN min({f}) < max({f}) THEN stddev_pop({dbl(f)}) ELSE 1e0 END AS s_{f}" for f in LEAN
    )
    scaled = ", ".join(f"({dbl(f)} - m_{f})/s_{f} AS {f}" for f in LEAN)

    def kernel(a: str, b: str) -> str:
        return f"exp(-({' + '.join(f'pow({a}.{f} - {b}.{f}, 2)' for f in LEAN)})/{number(len(LEAN))})"

    second = f"({kernel('p', 'l')} - p.k1*l.k1)/sqrt(1e0 - l.k1*l.k1)"
    third = f"({kernel('p', 'l')} - p.k1*l.k1 - p.k2*l.k2)/sqrt(l.r2)"
    return with_(
        SPLIT,
        "train AS (SELECT * FROM data WHERE split = 'train')",
        f"stats AS (SELECT {stats} FROM train)",
        f"scaled AS (SELECT row_id, {scaled} FROM train, stats)",
        "placed AS (SELECT *, row_number() OVER (ORDER BY md5('42|svm|' || CAST(row_id AS VARCHAR)), row_id) AS pos FROM scaled)",
        f"one AS (SELECT p.*, {kernel('p', 'l')} AS k1 FROM placed p, (SELECT * FROM placed WHERE pos = 1) l)",
        f"l2 AS (SELECT * FROM one WHERE pos <= {kernel_svm.POOL} ORDER BY k1*k1, pos LIMIT 1)",
        f"two AS (SELECT p.*, {second} AS k2, 1e0 - p.k1*p.k1 - k2*k2 AS r2 FROM one p, l2 l)",
        f"l3 AS (SELECT * FROM two WHERE pos <= {kernel_svm.POOL} ORDER BY r2 DESC, pos LIMIT 1)",
        f"three AS (SELECT p.*, {third} AS k3 FROM two p, l3 l)",
        body="SELECT row_id, round(r2 - k3*k3, 6) AS residual FROM three",
    )


def bayes_sql() -> str:
    aggs, ll = [], {}
    floor = "(1e-9*greatest(" + ", ".join(f"v_{f}" for f in LEAN) + "))"
    for c in (0, 1):
        aggs.append(f"count(*) FILTER (WHERE target={c})::DOUBLE AS n{c}")
        parts = [f"ln(n{c}/(n0+n1))"]
        for f in LEAN:
            aggs.append(f"avg({dbl(f)}) FILTER (WHERE target={c}) AS m{c}_{f}")
            aggs.append(f"var_pop({dbl(f)}) FILTER (WHERE target={c}) AS v{c}_{f}")
            v = f"(v{c}_{f} + {floor})"
            parts.append(
                f"(-(ln(2*pi()*{v}) + ({dbl(f)}-m{c}_{f})*({dbl(f)}-m{c}_{f})/{v})/2)"
            )
        ll[c] = " + ".join(parts)
    aggs += [f"var_pop({dbl(f)}) AS v_{f}" for f in LEAN]
    return with_(
        SPLIT,
        f"fitted AS (SELECT {', '.join(aggs)} FROM data WHERE split = 'train')",
        f"""lls AS (
  SELECT row_id, target AS y, {ll[0]} AS l0, {ll[1]} AS l1 FROM data, fitted WHERE split = 'test')""",
        body="""SELECT row_id, y, round(1e0/(1e0+exp(l0-l1)), 5) AS p,
       CASE WHEN 1e0/(1e0+exp(l0-l1)) >= 0.5e0 THEN 1 ELSE 0 END AS yhat FROM lls""",
    )


def direction_sql() -> str:
    parts = [
        f"SELECT '{f}' AS feature, avg({dbl(f)}) FILTER (WHERE target=1) - avg({dbl(f)}) FILTER (WHERE target=0) AS d FROM encoded"
        for f in FULL
    ]
    return with_(
        ENCODED,
        "diffs AS (" + "\n  UNION ALL ".join(parts) + ")",
        "low AS (SELECT * FROM diffs ORDER BY d, feature LIMIT 8)",
        "high AS (SELECT * FROM diffs ORDER BY d DESC, feature DESC LIMIT 8)",
        body="""SELECT feature, round(d, 4) AS mean_difference
FROM (SELECT * FROM low UNION SELECT * FROM high)""",
    )


def corr_lower_sql() -> str:
    names = [*FULL, "target"]
    devs = "\n  UNION ALL ".join(f"SELECT '{c}' AS f, var_samp({dbl(c)}) AS v FROM encoded" for c in FULL)
    pairs = "\n  UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, corr({dbl(a)}, {dbl(b)}) AS r FROM encoded"
        for i, a in enumerate(names)
        for b in names[:i]
    )
    return with_(
        ENCODED,
        f"devs AS ({devs})",
        """pos AS (
  SELECT f, row_number() OVER (ORDER BY v DESC, f) AS k FROM devs UNION ALL SELECT 'target', 1000)""",
        f"pairs AS ({pairs})",
        body="""SELECT CASE WHEN pa.k > pb.k THEN a ELSE b END AS feature_a, CASE WHEN pa.k > pb.k THEN b ELSE a END AS feature_b,
       round(r, 6) AS r
FROM pairs JOIN pos pa ON pa.f = a JOIN pos pb ON pb.f = b""",
    )


def counterfactual_sql() -> str:
    parts = []
    for f, d in ORDERS.shifts.items():
        moved = logistic_sql(
            fixed_scores.RISK_INTERCEPT, fixed_scores.RISK
        ).replace(dbl(f), f"({dbl(f)} + {number(d)})")
        parts.append(
            f"SELECT row_id, '{f}' AS feature, {number(d)} AS delta, round(p, 6) AS base_p, "
            f"round(({moved} - p)*100, 4) AS risk_change_percent FROM risky"
        )
    return with_(SCORED_REQUESTS, body="\nUNION ALL ".join(parts))


def violations_sql() -> str:
    parts = [
        f"SELECT row_id, '{f}' AS feature, {dbl(f)} AS value, {number(lo)} AS lower, {number(hi)} AS upper "
        f"FROM raw_requests WHERE {f} < {number(lo)} OR {f} > {number(hi)}"
        for f, (lo, hi) in ORDERS.bounds.items()
    ]
    return with_(RAW_REQUESTS, body="\nUNION ALL ".join(parts))


def error_patterns_sql() -> str:
    columns = FULL[:10]
    parts = []
    for kind, y, yhat in (("FP", 0, 1), ("FN", 1, 0)):
        for c in columns:
            part = f"avg({dbl(c)}) FILTER (WHERE y={y} AND yhat={yhat})"
            parts.append(
                f"SELECT '{kind}' AS quadrant, '{c}' AS feature, "
                f"round(({part} - avg({dbl(c)}))/(abs(avg({dbl(c)})) + 1e-9)*100, 4) AS deviation_percent FROM one"
            )
    return with_(
        COHORT,
        scored_ctes("cohort", columns),
        "one AS (SELECT * FROM scored WHERE experiment='no_leakage' AND model='volume')",
        body="SELECT * FROM (" + "\nUNION ALL ".join(parts) + ") WHERE deviation_percent IS NOT NULL",
    )


def risk_report_sql() -> str:
    return with_(
        SCORED_REQUESTS,
        phi_ctes("filled"),
        """tops AS (
  SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(phi) DESC, feature) AS r FROM phis),
lines AS (
  SELECT row_id, string_agg(feature || ' ' || CASE WHEN phi > 0 THEN 'Increases Risk' ELSE 'Reduces Risk' END
           || ' (magnitude: ' || printf('%.4f', CAST(round(CAST(abs(phi) AS DECIMAL(18,6)), 4) AS DOUBLE)) || ')', '; ' ORDER BY r) AS factors
  FROM tops WHERE r <= 10 GROUP BY row_id)""",
        body=f"""SELECT k.row_id,
       'total_cents=' || CAST(CAST(total_cents AS BIGINT) AS VARCHAR) || '; acctbal_cents=' || CAST(CAST(acctbal_cents AS BIGINT) AS VARCHAR)
         || '; c_nationkey=' || CAST(CAST(c_nationkey AS BIGINT) AS VARCHAR) AS profile,
       printf('%.1f%%', round(p*100, 1)) AS risk_score,
       upper({tier({n: n for n in services.TIERS})}) AS level,
       {tier(services.TIERS)} AS recommendation, factors, '{catalog.REPORT_TIME}' AS generated_at
FROM risky k JOIN lines ON lines.row_id = k.row_id""",
    )


def repeated_sql() -> str:
    parts = [split_cte("cohort", 42 + run, f"run{run}") for run in range(5)]
    union = "\nUNION ALL ".join(f"SELECT {r} AS run, row_id, target, split FROM run{r}" for r in range(5))
    return with_(COHORT, quota_ctes("cohort", "ceil(0.2e0*n_all)"), *parts, body=union)


def grouped_sql() -> str:
    cases = " ".join(
        f"WHEN feature IN ({', '.join(repr(m) for m in members)}) THEN '{g}'" for g, members in ORDERS.groups.items()
    )
    return with_(
        PHI,
        "per AS (SELECT feature, avg(abs(phi)) AS m FROM phis GROUP BY feature)",
        f"""grp AS (SELECT coalesce(CASE {cases} END, 'ungrouped') AS "group", sum(m) AS t FROM per GROUP BY 1)""",
        body="""SELECT "group", round(t, 6) AS importance,
       round(CASE WHEN "group" <> 'ungrouped' THEN t/sum(t) FILTER (WHERE "group" <> 'ungrouped') OVER ()*100 END, 4) AS percent
FROM grp""",
    )


def _intake_null_columns() -> list[str]:
    return ["row_id", "o_orderpriority", *[c for c in LEAN if c != CODED]]


REQUEST_COLUMNS = _intake_null_columns()


def all_sql() -> dict[str, str]:
    base = linear_sql(fixed_scores.RISK_INTERCEPT, fixed_scores.RISK)
    for f in LEAN:
        base = base.replace(dbl(f), f"m_{f}")
    out = {
        "audit_profile": with_(
            RAW_REQUESTS,
            body=f"SELECT count(*) AS n_rows, {len(REQUEST_COLUMNS)} AS n_columns, CAST("
            + " + ".join(f"sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in REQUEST_COLUMNS)
            + " AS BIGINT) AS n_nulls FROM raw_requests",
        ),
        "null_counts": with_(
            RAW_REQUESTS,
            body="\nUNION ALL ".join(
                f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS n_nulls FROM raw_requests"
                for c in REQUEST_COLUMNS
            ),
        ),
        "class_distribution": with_(
            COHORT,
            body="""SELECT target, CASE WHEN target=1 THEN 'Large (1)' ELSE 'Regular (0)' END AS label, count(*) AS n,
       round(count(*)*100::DOUBLE/(SELECT count(*) FROM cohort), 4) AS percent FROM cohort GROUP BY target""",
        ),
        "category_distribution": with_(
            COHORT, body="SELECT o_orderpriority AS category, count(*) AS n FROM cohort GROUP BY 1"
        ),
        "prevalence": with_(
            COHORT,
            body="""SELECT count(*) FILTER (WHERE target=0) AS n_neg, count(*) FILTER (WHERE target=1) AS n_pos,
       round(avg(target)*100, 4) AS positive_percent FROM cohort""",
        ),
        "majority_baseline": with_(
            COHORT,
            """c AS (SELECT count(*) FILTER (WHERE target=0) AS a, count(*) FILTER (WHERE target=1) AS b FROM cohort)""",
            body="""SELECT CASE WHEN b >= a THEN 1 ELSE 0 END AS majority_class, round(greatest(a,b)::DOUBLE/(a+b), 4) AS accuracy,
       0.5e0 AS balanced_accuracy, round(2*greatest(a,b)::DOUBLE/(2*greatest(a,b) + least(a,b))/2, 4) AS macro_f1 FROM c""",
        ),
        "leakage_screen": corr_sql([f for f in FULL if f != CODED], ORDERS.leakage, COHORT, "cohort"),
        "document_screen": corr_sql(
            [f for f in DOCUMENTS.features if f != "lang"],
            (),
            """docs AS (
  SELECT doc_id, n_chars, toxic, quality AS target, length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS n_digits,
         length(text) - length(replace(text, chr(10), '')) AS n_lines, length(text) - length(replace(text, ' ', '')) AS n_spaces
  FROM documents JOIN labels USING (doc_id))""",
            "docs",
        ),
        "drop_leakage": with_(COHORT, body=f"SELECT row_id, {', '.join(LEAN)}, target FROM cohort"),
        "train_test_union": with_(COHORT, body=f"SELECT row_id, {', '.join(LEAN)}, target FROM cohort"),
        "hist_by_class": with_(
            COHORT,
            "lim AS (SELECT target, min(qty) AS lo, max(qty) AS hi, count(*) AS c FROM cohort GROUP BY target)",
            body="""SELECT l.target, CAST(least(floor((qty-lo)::DOUBLE*25/(hi-lo)::DOUBLE), 24) AS INTEGER) AS bin,
       round(lo + CAST(least(floor((qty-lo)::DOUBLE*25/(hi-lo)::DOUBLE), 24) AS INTEGER)*((hi-lo)::DOUBLE/25), 6) AS bin_low,
       count(*) AS n, round(count(*)*100::DOUBLE/c, 4) AS percent_of_class
FROM cohort JOIN lim l ON l.target = cohort.target GROUP BY l.target, 2, 3, lo, hi, c""",
        ),
        "hist_shared": with_(
            COHORT,
            "b AS (SELECT target, CAST(floor(qty/10e0) AS INTEGER) AS bin, count(*) AS n FROM cohort GROUP BY 1, 2)",
            body="SELECT target, bin, n, round(n*100::DOUBLE/sum(n) OVER (PARTITION BY target), 4) AS percent_of_class FROM b",
        ),
        "variance_top20": with_(
            ENCODED,
            "v AS ("
            + "\n  UNION ALL ".join(
                f"SELECT '{c}' AS feature, var_samp({dbl(c)}) AS v FROM encoded" for c in [*FULL, "target"]
            )
            + ")",
            body="""SELECT feature, CAST(rank AS INTEGER) AS rank, std_dev FROM (
  SELECT feature, row_number() OVER (ORDER BY v DESC, feature) AS rank, round(sqrt(v), 4) AS std_dev FROM v) WHERE rank <= 20""",
        ),
        "corr_lower": corr_lower_sql(),
        "box_stats": box_sql(),
        "feature_direction": direction_sql(),
        "column_means": with_(
            ENCODED,
            body="\nUNION ALL ".join(
                f"SELECT '{c}' AS feature, round(avg({dbl(c)}), 6) AS mean FROM encoded" for c in FULL
            ),
        ),
        "stratified_sample": with_(
            COHORT,
            quota_ctes("cohort", "least(5000, n_all)"),
            split_cte("cohort"),
            body="SELECT row_id, target FROM data WHERE split = 'test'",
        ),
        "stratified_split": with_(
            COHORT,
            quota_ctes("cohort", "ceil(0.2e0*n_all)"),
            split_cte("cohort"),
            body="SELECT row_id, target, split FROM data",
        ),
        "stratified_folds": with_(
            COHORT,
            body="""SELECT row_id, target, CAST((row_number() OVER (PARTITION BY target
       ORDER BY md5('42|' || CAST(row_id AS VARCHAR)), row_id) - 1) % 5 AS INTEGER) AS fold FROM cohort""",
        ),
        "repeated_splits": repeated_sql(),
        "label_encode": with_(ENCODED, body="SELECT row_id, o_orderpriority FROM encoded"),
        "standard_scale": with_(
            SPLIT,
            EXACT_SCALER,
            body="SELECT row_id, split, "
            + ", ".join(f"round({scaled(c)}, 6) AS z_{c}" for c in LEAN)
            + " FROM data, exact_scaler",
        ),
        "class_weights": with_(
            COHORT,
            "c AS (SELECT target, count(*) AS n FROM cohort GROUP BY target)",
            "t AS (SELECT sum(n) AS s, count(*) AS k, sum(n) FILTER (WHERE target=0) AS n0, sum(n) FILTER (WHERE target=1) AS n1 FROM c)",
            body="""SELECT target, n, round(s::DOUBLE/(k*n)::DOUBLE, 6) AS balanced_weight,
       round(CASE WHEN target=1 THEN n0::DOUBLE/greatest(n1, 1)::DOUBLE ELSE 1e0 END, 6) AS pos_weight FROM c, t""",
        ),
        "smote_neighbors": with_(
            SPLIT,
            "rare AS (SELECT * FROM data WHERE split = 'train' AND target = 0)",
            nearest_ctes("rare", "rare", "row_id", FULL, 5, None, True),
            body="SELECT qid AS row_id, neighbor_rank, neighbor_id, round(sqrt(d2), 2) AS distance FROM near",
        ),
        "smote_resample": smote_sql(FULL, 0.5),
        "smote_full_balance": smote_sql(LEAN, 1.0),
        "confusion_counts": with_(SCORED, conf_cte("scored"), body="SELECT * FROM conf"),
        "leaderboard": with_(BOARD, body="SELECT * FROM ranked"),
        "best_model": with_(BOARD, body="SELECT * EXCLUDE (position) FROM ranked WHERE position = 1"),
        "board_view": with_(
            BOARD,
            body="SELECT experiment, model, position, balanced_accuracy, macro_f1, roc_auc FROM ranked WHERE position <= 5",
        ),
        "headline": with_(
            BOARD,
            body="""SELECT model, printf('%.2f%%', round(balanced_accuracy*100, 2)) AS balanced_accuracy, roc_auc,
       (SELECT count(*) FROM cohort) AS n_rows, (SELECT max(tp + fp + tn + fn) FROM conf) AS n_used
FROM ranked WHERE position = 1 AND experiment = 'no_leakage'""",
        ),
        "leakage_drop": with_(
            BOARD,
            "f AS (SELECT * FROM ranked WHERE position = 1 AND experiment = 'full')",
            "l AS (SELECT * FROM ranked WHERE position = 1 AND experiment = 'no_leakage')",
            body="\nUNION ALL ".join(
                f"SELECT '{m}' AS metric, f.model AS full_model, f.{m} AS full_value, l.model AS reduced_model, "
                f"l.{m} AS reduced_value, round(f.{m} - l.{m}, 4) AS \"drop\" FROM f, l"
                for m in ("accuracy", "balanced_accuracy", "recall", "roc_auc")
            ),
        ),
        "experiment_comparison": with_(
            BOARD,
            "f AS (SELECT * FROM ranked WHERE experiment = 'full')",
            "l AS (SELECT * FROM ranked WHERE experiment = 'no_leakage')",
            body="SELECT coalesce(f.model, l.model) AS model, f.position AS position_left, l.position AS position_right, "
            + ", ".join(
                f"f.{m} AS {m}_left, l.{m} AS {m}_right, round(f.{m} - l.{m}, 4) AS {m}_change"
                for m in ("balanced_accuracy", "macro_f1", "macro_recall")
            )
            + " FROM f FULL JOIN l ON l.model = f.model WHERE f.position <= 5 OR l.position <= 5",
        ),
        "metrics_long": with_(BOARD, body=unpivot(("macro_precision", "macro_recall", "macro_f1"), "board")),
        "accuracy_axis": with_(
            BOARD,
            body="SELECT experiment, round(greatest(min(accuracy) - 0.05e0, 0e0), 4) AS axis_min FROM board GROUP BY experiment",
        ),
        "classification_report": with_(SCORED, conf_cte("scored"), body=report_lines()),
        "cv_scores": fold_sql("balanced_accuracy"),
        "cv_accuracy": fold_sql("accuracy"),
        "roc_auc": with_(SCORED, auc_cte(6), body="SELECT * FROM auc"),
        "roc_curve": with_(DESCENDING, body=roc_body()),
        "roc_curve_compact": with_(
            DESCENDING, body=roc_body("WHERE next_pos IS NULL OR next_pos <> pos OR next_neg <> neg")
        ),
        "pr_curve": with_(
            DESCENDING,
            body="""SELECT experiment, model, p AS threshold, round(cp::DOUBLE/(cp+cn)::DOUBLE, 6) AS precision,
       round(cp::DOUBLE/tp_all::DOUBLE, 6) AS recall FROM cum
UNION ALL SELECT DISTINCT experiment, model, CAST(NULL AS DOUBLE), 1e0, 0e0 FROM byv""",
        ),
        "average_precision": with_(
            DESCENDING,
            body="""SELECT experiment, model, round(sum(pos::DOUBLE*(cp::DOUBLE/(cp+cn)::DOUBLE))/max(tp_all)::DOUBLE, 6) AS average_precision
FROM cum GROUP BY experiment, model""",
        ),
        "threshold_tuning": with_(
            SCORED,
            THRESHOLDS,
            body=f"SELECT experiment, model, threshold, {met(('balanced_accuracy', 'macro_f1'))} FROM conf",
        ),
        "best_threshold": with_(
            SCORED,
            THRESHOLDS,
            f"tab AS (SELECT experiment, model, threshold, {met(('balanced_accuracy', 'macro_f1'))} FROM conf)",
            body="""SELECT * EXCLUDE (k) FROM (
  SELECT *, row_number() OVER (PARTITION BY experiment, model ORDER BY macro_f1 DESC, threshold) AS k FROM tab) WHERE k = 1""",
        ),
        "metrics_at_threshold": with_(
            SCORED,
            threshold_ctes("scored", [catalog.USER_THRESHOLD]),
            body=f"SELECT experiment, model, threshold, {met(('balanced_accuracy', 'precision', 'recall', 'macro_f1'))} FROM conf",
        ),
        "calibration": with_(
            SCORED,
            "b AS (SELECT *, CAST(1 + "
            + " + ".join(f"(CASE WHEN p > {number(i / 10)} THEN 1 ELSE 0 END)" for i in range(1, 10))
            + " AS INTEGER) AS bin FROM scored)",
            body="""SELECT experiment, model, bin, count(*) AS n, round(sum(p), 6)/count(*)::DOUBLE AS mean_predicted,
       sum(y)::DOUBLE/count(*)::DOUBLE AS fraction_positive FROM b GROUP BY experiment, model, bin""",
        ),
        "risk_histogram": with_(
            SCORED,
            body="""SELECT experiment, model, CAST(least(floor(p*30), 29) AS INTEGER) AS bin, count(*) AS n
FROM scored GROUP BY 1, 2, 3""",
        ),
        "error_rows": with_(
            COHORT,
            scored_ctes("cohort", LEAN),
            body=f"""SELECT experiment, model, row_id, y, p, yhat, {", ".join(LEAN)},
       CASE WHEN y=0 THEN 'FP' ELSE 'FN' END AS quadrant FROM scored WHERE y <> yhat""",
        ),
        "error_patterns": error_patterns_sql(),
        "shuffled_sanity": with_(
            SCORED,
            """a AS (SELECT experiment, model, yhat, row_number() OVER (PARTITION BY experiment, model
       ORDER BY md5('42a|' || CAST(row_id AS VARCHAR)), row_id) AS k FROM scored)""",
            """b AS (SELECT experiment, model, y, row_number() OVER (PARTITION BY experiment, model
       ORDER BY md5('42b|' || CAST(row_id AS VARCHAR)), row_id) AS k FROM scored)""",
            "mixed AS (SELECT a.experiment, a.model, y, yhat FROM a JOIN b ON a.experiment=b.experiment AND a.model=b.model AND a.k=b.k)",
            conf_cte("mixed"),
            body=f"SELECT experiment, model, round({MET['balanced_accuracy']}, 4) AS shuffled_balanced_accuracy FROM conf",
        ),
        "knn_vote": with_(
            SPLIT,
            SCALER,
            "z AS (SELECT row_id, split, target, " + ", ".join(f"{scaled(c)} AS {c}" for c in LEAN) + " FROM data, scaler)",
            "ztest AS (SELECT * FROM z WHERE split = 'test')",
            "ztrain AS (SELECT * FROM z WHERE split = 'train')",
            nearest_ctes("ztest", "ztrain", "row_id", LEAN, 7, "target", False),
            body="""SELECT qid AS row_id, round(avg(lab), 6) AS p, CASE WHEN avg(lab) >= 0.5e0 THEN 1 ELSE 0 END AS yhat
FROM near GROUP BY qid""",
        ),
        "vector_neighbors": with_(
            "v AS (SELECT vec_id, CASE WHEN label <> 0 THEN 1 ELSE 0 END AS target, "
            + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(64))
            + " FROM embeddings)",
            nearest_ctes("v", "v", "vec_id", [f"e{i}" for i in range(64)], 5, "target", True),
            body="""SELECT qid AS vec_id, neighbor_rank, neighbor_id, lab AS neighbor_target, round(sqrt(d2), 4) AS distance FROM near""",
        ),
        "random_tree_cuts": random_cuts_sql(),
        "svm_residuals": svm_residuals_sql(),
        "gaussian_nb": bayes_sql(),
        "kernel_shap": kernel_shap_sql(),
        "linear_shap": with_(PHI, body="SELECT * FROM phis"),
        "shap_global": with_(
            PHI, body="SELECT feature, round(avg(abs(phi)), 6) AS mean_abs_phi FROM phis GROUP BY feature"
        ),
        "shap_grouped": grouped_sql(),
        "shap_topn": with_(
            PHI,
            body="""SELECT row_id, feature, value, phi, CAST(k AS INTEGER) AS factor_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(phi) DESC, feature) AS k FROM phis) WHERE k <= 10""",
        ),
        "shap_protective_risk": with_(
            PHI,
            "s AS (SELECT *, CASE WHEN phi < 0 THEN 'protective' ELSE 'risk' END AS side FROM phis WHERE phi <> 0)",
            body="""SELECT row_id, feature, value, phi, side, CAST(k AS INTEGER) AS side_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY row_id, side ORDER BY abs(phi) DESC, feature) AS k FROM s) WHERE k <= 8""",
        ),
        "shap_waterfall": with_(
            PHI,
            f"base AS (SELECT {base} AS b FROM train_means)",
            body="""SELECT row_id, feature, value, phi,
       CAST(row_number() OVER (PARTITION BY row_id ORDER BY abs(phi) DESC, feature) AS INTEGER) AS step, round(b, 6) AS base_value,
       round(b + sum(phi) OVER (PARTITION BY row_id ORDER BY abs(phi) DESC, feature
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS running_score
FROM phis, base""",
        ),
        "shap_beeswarm": with_(
            PHI,
            "lim AS (SELECT feature AS f, min(value) AS lo, max(value) AS hi FROM phis GROUP BY feature)",
            body="""SELECT row_id, feature, value, phi, round(CASE WHEN hi > lo THEN (value-lo)/(hi-lo) ELSE 0.5e0 END, 4) AS value_place
FROM phis JOIN lim ON f = feature""",
        ),
        "request_fill": with_(FILLED, body="SELECT * FROM filled"),
        "request_flags": """SELECT o_orderkey, o_orderpriority, o_orderstatus,
       CASE WHEN o_orderpriority='1-URGENT' THEN 1 ELSE 0 END AS is_urgent, CASE WHEN o_orderstatus='O' THEN 1 ELSE 0 END AS is_open,
       CASE WHEN o_orderstatus='F' THEN 0 ELSE 1 END AS not_filled FROM orders""",
        "request_validation": violations_sql(),
        "risk_tier": with_(
            SCORED_REQUESTS,
            body=f"""SELECT row_id, p, {tier({n: n for n in services.TIERS})} AS level, {tier(services.TIERS)} AS action,
       {tier(services.TIER_COLORS)} AS color, CASE WHEN p >= {number(catalog.TUNED_THRESHOLD)} THEN 1 ELSE 0 END AS decision FROM risky""",
        ),
        "counterfactual": counterfactual_sql(),
        "risk_percentile": with_(
            SCORED_REQUESTS,
            f"pop AS (SELECT {RISK_SQL} AS pp FROM data WHERE split = 'test')",
            "tot AS (SELECT count(*) AS c FROM pop)",
            "vals AS (SELECT DISTINCT p FROM risky)",
            "cdf AS (SELECT p, (SELECT count(*) FROM pop WHERE pp < p)*100::DOUBLE/c::DOUBLE AS x FROM vals, tot)",
            body="""SELECT row_id, risky.p, round(x, 4) AS percentile, round(100e0 - x, 4) AS top_percent
FROM risky JOIN cdf ON cdf.p = risky.p""",
        ),
        "similar_subjects": with_(
            FILLED,
            "known AS (SELECT * FROM data WHERE split = 'train')",
            nearest_ctes("filled", "known", "row_id", LEAN, 5, "target", False),
            body="SELECT qid AS row_id, neighbor_rank, neighbor_id, lab AS neighbor_target, round(sqrt(d2), 2) AS distance, "
            + ", ".join(f"{dbl('k.' + c)} AS neighbor_{c}" for c in catalog.SHOWN)
            + " FROM near JOIN known k ON k.row_id = neighbor_id",
        ),
        "similar_outcomes": with_(
            FILLED,
            "known AS (SELECT * FROM data WHERE split = 'train')",
            nearest_ctes("filled", "known", "row_id", LEAN, 5, "target", False),
            body="SELECT qid AS row_id, CAST(sum(lab) AS BIGINT) AS n_positive, count(*) AS n_similar FROM near GROUP BY qid",
        ),
        "risk_report": risk_report_sql(),
        "stream_scoring": with_(
            SCORED_REQUESTS,
            body=f"""SELECT row_id, n_filled, p, {tier({n: n for n in services.TIERS})} AS level,
       CASE WHEN p >= {number(catalog.TUNED_THRESHOLD)} THEN 1 ELSE 0 END AS decision FROM risky""",
        ),
    }
    return out
