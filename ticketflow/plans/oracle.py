"""The same results as queries.py in SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from ticketflow.fixed_values import (
    CONFIDENT_CLASSES,
    MAX_LENGTH,
    MONTHLY_COST,
    NEW_EXAMPLES,
    SEED,
    SLOTS,
    TEMPLATES,
)
from ticketflow.operators.bootstrap import BOUNDS, DRAW_BITS, DRAWS
from ticketflow.plans.queries import COMPACT_FIT, FULL_FIT, REPLICATES
from ticketflow.plans.tables import EVENT_CLASSES, LANGUAGES, LINE_KEY, RETURN_FLAGS


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_text(v) for v in values) + "]"


def _draw(seed: int, tag: str, key: str) -> str:
    return f"(CAST('0x' || substr(md5('{seed}:{tag}:' || CAST({key} AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE)"


def _pick(values: str, u: str) -> str:
    return f"({values})[1 + CAST(floor({u} * len({values})) AS INTEGER)]"


def _labels(labels, key="label_id", value="category") -> str:
    rows = ", ".join(f"({i}, {_text(v)})" for i, v in enumerate(labels))
    return f"(SELECT CAST(i AS INTEGER) AS {key}, v AS {value} FROM (VALUES {rows}) AS dim(i, v))"


def _order(labels, col: str) -> str:
    if labels is None:
        return col
    cases = " ".join(f"WHEN {_text(v)} THEN {i}" for i, v in enumerate(labels))
    return f"CASE {col} {cases} ELSE {len(labels)} END, {col}"


def _allocation(counts: str, name: str, share: str, order: str) -> str:
    """CTEs from ``counts(c, n)`` to ``name(c, n, kept)`` by largest remainder."""
    return f"""
    {name}_t AS (SELECT CAST(sum(n) AS BIGINT) AS total,
                        CAST(sum(n) AS BIGINT) - CAST(ceil(CAST({share} AS DECIMAL(4, 2)) * CAST(sum(n) AS BIGINT)) AS BIGINT) AS draws
                 FROM {counts}),
    {name}_b AS (SELECT c, n, draws, n * draws // total AS base, n * draws % total AS rem FROM {counts}, {name}_t),
    {name} AS (SELECT c, n, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, {order})
                                          <= draws - sum(base) OVER () THEN 1 ELSE 0 END AS kept
               FROM {name}_b)"""


def _split(src: str, strat: str, key: tuple, labels=None, three: bool = True, seed: int = SEED) -> str:
    """CTEs ending in ``sp``: ``src`` with its split. Starts without WITH."""
    keys = ", ".join(f"CAST({k} AS VARCHAR)" for k in key)
    order = _order(labels, "c")
    ctes = f"""src AS ({src}),
    cls AS (SELECT {strat} AS c, count(*) AS n FROM src GROUP BY 1),
    {_allocation("cls", "tr", "0.30", order)},
    rest AS (SELECT c, n - kept AS n FROM tr),
    {_allocation("rest", "va", "0.50", order)},
    ranked AS (SELECT src.*, row_number() OVER (PARTITION BY {strat} ORDER BY md5(concat_ws(':', '{seed}:split', {keys}))) AS rk
               FROM src)"""
    middle = "WHEN rk <= tr.kept + va.kept THEN 'validation' " if three else ""
    return f"""{ctes},
    sp AS (SELECT ranked.* EXCLUDE (rk), CASE WHEN rk <= tr.kept THEN 'train' {middle}ELSE 'test' END AS split
           FROM ranked JOIN tr ON tr.c = {strat} JOIN va ON va.c = {strat})"""


DOCUMENTS = """SELECT doc_id AS id, text, lang AS category,
    CAST(n_chars % 4 + 2 AS INTEGER) AS annotator_confidence FROM documents"""
DOCUMENT_SPLITS = _split(DOCUMENTS, "category", ("id",), LANGUAGES)
LINES = f"""SELECT {", ".join(LINE_KEY)}, l_linestatus AS method, l_returnflag AS truth,
    CASE WHEN l_discount < 0.04 THEN 'A' WHEN l_discount < 0.09 THEN 'N' ELSE 'X' END AS prediction,
    1.0::DOUBLE - l_discount * l_tax * 50 AS confidence FROM lineitem"""
ROUTED = f"""SELECT *, CASE WHEN confidence > 0.8 THEN 'automatic' ELSE 'human_review' END AS decision FROM ({LINES})"""
PAIRS = "SELECT doc_id, quality AS truth, 1 - toxic AS prediction FROM labels"
TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
NORMAL = r"trim(regexp_replace(lower(text), '[ \t\r\n]+', ' ', 'g'))"
DECISIONS = """SELECT event_id, ts, event_type AS prediction,
    CASE WHEN value > 60 THEN 'error' ELSE event_type END AS truth FROM events"""

EVENT_CASE = "CASE event_type " + " ".join(f"WHEN '{e}' THEN '{c}'" for e, c in EVENT_CLASSES.items()) + " END"
QUOTAS = f"""quotas AS (SELECT CAST(x.i AS INTEGER) AS ord, x.c AS category, count(*) AS quota
    FROM events JOIN (VALUES {", ".join(f"({i}, '{e}', '{c}')" for i, (e, c) in enumerate(EVENT_CLASSES.items()))})
      AS x(i, e, c) ON x.e = event_type GROUP BY 1, 2),
    firsts AS (SELECT *, CAST(coalesce(sum(quota) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first
      FROM quotas),
    expanded AS (SELECT first + 1 + unnest(range(quota)) AS id, category FROM firsts)"""


def _generated() -> str:
    templates = " ".join(f"WHEN '{c}' THEN {_pick(_list(v), _draw(SEED, 'template', 'id'))}" for c, v in TEMPLATES.items())
    slot = _draw(SEED, "slot", "id")
    filled = "t"
    for name, values in SLOTS.items():
        filled = f"replace({filled}, '{{{name}}}', {_pick(_list(values), slot)})"
    u = _draw(SEED, "confidence", "id")
    sure = ", ".join(_text(c) for c in CONFIDENT_CLASSES)
    return f"""WITH {QUOTAS},
    chosen AS (SELECT id, category, CASE category {templates} END AS t, {u} * 100 AS u FROM expanded)
    SELECT id, {filled} AS text, category,
      CAST(CASE WHEN category IN ({sure}) THEN CASE WHEN u < 10 THEN 3 WHEN u < 45 THEN 4 ELSE 5 END
           ELSE CASE WHEN u < 10 THEN 2 WHEN u < 35 THEN 3 WHEN u < 75 THEN 4 ELSE 5 END END AS INTEGER) AS annotator_confidence,
      row_number() OVER (ORDER BY md5('{SEED}:shuffle:' || CAST(id AS VARCHAR))) - 1 AS pos
    FROM chosen"""


def _centroid_scores() -> str:
    """CTEs ending in ``scored``: the held-out embeddings with logits, probs."""
    return f"""{_split("SELECT vec_id, label, embedding FROM embeddings", "label", ("vec_id",))},
    dims AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS i FROM sp WHERE split = 'train'),
    means AS (SELECT label, i, avg(x) AS m FROM dims GROUP BY 1, 2),
    cent AS (SELECT label AS l, list(m ORDER BY i) AS centroid FROM means GROUP BY 1),
    lg AS (SELECT vec_id, split, label AS truth, l, 120 * list_dot_product(embedding::DOUBLE[], centroid) AS z
           FROM sp, cent WHERE split <> 'train'),
    mx AS (SELECT *, max(z) OVER (PARTITION BY vec_id) AS top FROM lg),
    pr AS (SELECT *, exp(z - top) / sum(exp(z - top)) OVER (PARTITION BY vec_id) AS p FROM mx),
    scored AS (SELECT vec_id, split, truth, arg_max(l, p) AS prediction, max(p) AS confidence,
                      max(CASE WHEN l = truth THEN p END) AS p_truth,
                      CASE WHEN max(p) > 0.8 THEN 'automatic' ELSE 'human_review' END AS decision
               FROM pr GROUP BY 1, 2, 3)"""


def _totals(rows: str, by: str = "") -> str:
    """CTEs ending in ``cm``: support, predicted and hits per class."""
    g = f"{by}, " if by else ""
    return f"""conf AS (SELECT {g}truth, prediction, count(*) AS n FROM ({rows}) GROUP BY ALL),
    sides AS (SELECT {g}truth AS label, n AS support, 0 AS predicted, CASE WHEN truth = prediction THEN n ELSE 0 END AS tp FROM conf
              UNION ALL SELECT {g}prediction, 0, n, 0 FROM conf),
    ct AS (SELECT {g}label, sum(support) AS support, sum(predicted) AS predicted, sum(tp) AS tp FROM sides GROUP BY ALL),
    cm AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0::DOUBLE ELSE tp / predicted END AS precision,
                  CASE WHEN support = 0 THEN 0.0::DOUBLE ELSE tp / support END AS recall,
                  CASE WHEN support + predicted = 0 THEN 0.0::DOUBLE ELSE 2 * tp / (support + predicted) END AS f1 FROM ct)"""


MACRO = """round(sum(tp) / sum(support), 6) AS accuracy, round({f1}, 6) AS f1_macro,
    round({p}, 6) AS precision_macro, round({r}, 6) AS recall_macro"""
MEANS = MACRO.format(f1="avg(f1)", p="avg(precision)", r="avg(recall)")
LISTED = MACRO.format(
    **{
        k: f"sum(CASE WHEN label IN ('N', 'R', 'A', 'Z') THEN {v} ELSE 0 END) / 4"
        for k, v in (("f1", "f1"), ("p", "precision"), ("r", "recall"))
    }
)
SUMMARY = """count(*) AS total, count(*) FILTER (decision = 'automatic') AS automatic,
    count(*) FILTER (decision = 'human_review') AS human_review,
    round(count(*) FILTER (decision = 'automatic') * 100.0::DOUBLE / count(*), 6) AS automatic_pct,
    round(count(*) FILTER (decision = 'human_review') * 100.0::DOUBLE / count(*), 6) AS human_review_pct"""


def _vocabulary() -> str:
    return f"""words AS (SELECT unnest({TOKENS}) AS token FROM documents),
    vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY n DESC, md5(token), token) + 3 AS INTEGER) AS token_id
              FROM (SELECT token, count(*) AS n FROM words GROUP BY 1))"""


def _encoded(rows: str, keys: str) -> str:
    """Id sequences of ``rows(keys, text)`` as text, empty for no token."""
    return f"""WITH {_vocabulary()},
    rows_in AS ({rows}),
    pos AS (SELECT {keys}, unnest(toks) AS token, unnest(range(len(toks))) AS i
            FROM (SELECT {keys}, {TOKENS} AS toks FROM rows_in)),
    ids AS (SELECT {keys}, string_agg(CAST(coalesce(token_id, 1) AS VARCHAR), ' ' ORDER BY i) AS ids
            FROM pos LEFT JOIN vocab USING (token) GROUP BY ALL)
    SELECT {keys}, coalesce(ids, '') AS ids FROM rows_in LEFT JOIN ids USING ({keys})"""


HISTORY = """hist AS (SELECT event_type AS run_id, CAST(day(ts) AS INTEGER) AS epoch, round(avg(value), 4) AS f1_macro
    FROM events GROUP BY 1, 2)"""


def _stops(patience: int) -> str:
    return f"""{HISTORY},
    h1 AS (SELECT *, row_number() OVER w AS k,
                  max(f1_macro) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best
           FROM hist WINDOW w AS (PARTITION BY run_id ORDER BY epoch)),
    h2 AS (SELECT *, k - max(CASE WHEN best IS NULL OR f1_macro > best THEN k END)
                       OVER (PARTITION BY run_id ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS stale FROM h1),
    stops AS (SELECT run_id, CAST(coalesce(min(epoch) FILTER (stale >= {patience}), max(epoch)) AS INTEGER) AS stop_epoch
              FROM h2 GROUP BY 1)"""


RUNS = f"""{_totals(LINES, "method")},
    figures AS (SELECT method, sum(tp) / sum(support) AS accuracy, avg(f1) AS f1_macro,
                       avg(precision) AS precision_macro, avg(recall) AS recall_macro FROM cm GROUP BY 1),
    sizes AS (SELECT l_linestatus AS method, avg(l_quantity) AS training_time_seconds, max(l_tax) AS peak_gpu_memory_mb,
                     count(*) AS total_parameters, count(*) FILTER (l_discount > 0.05) AS trainable_parameters
              FROM lineitem GROUP BY 1),
    runs AS (SELECT *, trainable_parameters * 100.0::DOUBLE / total_parameters AS trainable_percentage
             FROM figures JOIN sizes USING (method))"""
RUN_DOUBLES = (
    "accuracy",
    "f1_macro",
    "precision_macro",
    "recall_macro",
    "training_time_seconds",
    "peak_gpu_memory_mb",
    "trainable_percentage",
)
RUN_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in RUN_DOUBLES) + ", total_parameters, trainable_parameters"

DRIFT = (
    "SELECT epoch(date_trunc('day', ts))::BIGINT AS window_start, count(*) AS n, "
    + ", ".join(
        f"round(count(*) FILTER (prediction = '{e}') / count(*), 6) AS share_{e}" for e in EVENT_CLASSES
    )
    + f", round(count(*) FILTER (prediction <> truth) / count(*), 6) AS error_rate FROM ({DECISIONS}) "
)

BINS = f"""bins AS (SELECT CAST(least(9, floor(confidence * 10)) AS INTEGER) AS bin, count(*) AS n,
    count(*) FILTER (truth = prediction) / count(*) AS accuracy, avg(confidence) AS mean_confidence
    FROM ({LINES}) GROUP BY 1)"""

LINE_SPLITS = _split(f"SELECT *, truth AS l_returnflag FROM ({LINES})", "l_returnflag", LINE_KEY, RETURN_FLAGS)
# isotonic regression by its min-max formula over the distinct confidences of the validation rows
CALIBRATED = f"""{LINE_SPLITS},
    x AS (SELECT confidence + 0.0 AS c, count(*) AS n, count(*) FILTER (truth = prediction) AS r, row_number() OVER (ORDER BY confidence + 0.0) AS i
          FROM sp WHERE split = 'validation' GROUP BY 1),
    upto AS (SELECT i, c, sum(n) OVER (ORDER BY i) AS n, sum(r) OVER (ORDER BY i) AS r, n AS own_n, r AS own_r FROM x),
    means AS (SELECT a.i AS a, b.i AS b, (b.r - a.r + a.own_r) / (b.n - a.n + a.own_n)::DOUBLE AS m FROM upto a JOIN upto b ON a.i <= b.i),
    least_from AS (SELECT a, x.i, min(m) AS m FROM means JOIN x ON a <= x.i AND b >= x.i GROUP BY 1, 2),
    fitted AS (SELECT x.i, any_value(x.c) AS c, max(m) AS y FROM least_from JOIN x ON x.i = least_from.i GROUP BY 1),
    asked AS (SELECT confidence AS c, count(*) AS n FROM sp WHERE split = 'test' GROUP BY 1),
    placed AS (SELECT asked.c, asked.n, max(fitted.c) FILTER (fitted.c <= asked.c) AS below, min(fitted.c) FILTER (fitted.c >= asked.c) AS above
               FROM asked, fitted GROUP BY 1, 2),
    answer AS (SELECT p.c, p.n, CASE WHEN below IS NULL THEN hi.y WHEN above IS NULL OR below = above THEN lo.y
                 ELSE lo.y + (hi.y - lo.y) * (p.c - below) / (above - below) END AS y
               FROM placed p LEFT JOIN fitted lo ON lo.c = below LEFT JOIN fitted hi ON hi.c = above)"""

PRICED = f"""priced AS (SELECT p.l_extendedprice / 104729.0::DOUBLE AS c, (r.truth = r.prediction)::INT AS hit
    FROM lineitem p JOIN ({LINES}) r USING ({", ".join(LINE_KEY)})),
    curve AS (SELECT c, count(*) AS n, sum(hit) AS r,
        coalesce(sum(count(*)) OVER above, 0) AS n_above, coalesce(sum(sum(hit)) OVER above, 0) AS r_above,
        sum(count(*)) OVER () AS total, sum(sum(hit)) OVER () AS total_r
      FROM priced GROUP BY c WINDOW above AS (ORDER BY c DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    lines AS (SELECT c AS threshold, CAST(n_above AS BIGINT) AS automatic, n_above / total AS coverage,
        CASE WHEN n_above > 0 THEN r_above / n_above END AS precision, r_above / total_r AS recall FROM curve)"""
CURVE_COLUMNS = "round(threshold, 6) AS threshold, automatic, round(coverage, 6) AS coverage, round(precision, 6) AS precision, round(recall, 6) AS recall"


def _divergence(counts: str, name: str) -> str:
    """CTEs from ``counts(w, k, n)`` to ``name(w, psi, js)`` against the first window."""
    return f"""
    {name}_g AS (SELECT w, k, coalesce(c.n, 0) + 0.5::DOUBLE AS n FROM (SELECT * FROM (SELECT DISTINCT w FROM {counts}) a, (SELECT DISTINCT k FROM {counts}) b) g
                 LEFT JOIN {counts} c USING (w, k)),
    {name}_p AS (SELECT w, k, n / sum(n) OVER (PARTITION BY w) AS p FROM {name}_g),
    {name} AS (SELECT s.w, sum((s.p - q.p) * ln(s.p / q.p)) AS psi,
                 sum(s.p * ln(2 * s.p / (s.p + q.p)) + q.p * ln(2 * q.p / (s.p + q.p))) / (2 * ln(2.0::DOUBLE)) AS js
               FROM {name}_p s JOIN {name}_p q ON q.k = s.k AND q.w = (SELECT min(w) FROM {name}_p) GROUP BY 1)"""


DRIFT_SCORES = f"""WITH e AS (SELECT epoch(date_trunc('day', ts))::BIGINT AS w, event_type AS k,
      CAST(greatest(0, least(1023, floor(least(1.0::DOUBLE, value / 200.0::DOUBLE) * 1024))) AS INTEGER) AS cell FROM events),
    ref AS (SELECT cell, count(*) AS n FROM e WHERE w = (SELECT min(w) FROM e) GROUP BY 1),
    bins AS (SELECT g.cell, least(9, coalesce(sum(n) OVER (ORDER BY g.cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 10
                // sum(n) OVER ()) AS k FROM (SELECT unnest(range(1024))::INTEGER AS cell) g LEFT JOIN ref USING (cell)),
    by_bin AS (SELECT w, bins.k, count(*) AS n FROM e JOIN bins USING (cell) GROUP BY 1, 2),
    by_class AS (SELECT w, k, count(*) AS n FROM e GROUP BY 1, 2),
    {_divergence("by_bin", "conf")}, {_divergence("by_class", "cls")},
    days AS (SELECT w, count(*) AS n, quantile_disc(cell, 0.5) AS median_cell FROM e GROUP BY 1)
    SELECT w AS window_start, days.n, median_cell, round(conf.psi, 6) AS psi_confidence, round(conf.js, 6) AS js_confidence,
      round(cls.psi, 6) AS psi_class, round(cls.js, 6) AS js_class FROM days JOIN conf USING (w) JOIN cls USING (w)"""

_WEIGHT = f"CASE {' '.join(f'WHEN u < {b} THEN {n}' for n, b in enumerate(BOUNDS))} ELSE {len(BOUNDS)} END"
_LINE_HASH = f"md5(concat_ws(':', '{SEED}:bootstrap' || (r // {DRAWS}), {', '.join(f'CAST({k} AS VARCHAR)' for k in LINE_KEY)}))"
BOOTSTRAP = f"""lines AS ({LINES}),
    drawn AS (SELECT method, truth, prediction, r,
        (('0x' || substr({_LINE_HASH}, CASE WHEN r % {DRAWS} < {DRAWS // 2} THEN 1 ELSE 16 END, 15))::BIGINT
          >> CAST({DRAW_BITS} * (r % {DRAWS // 2}) AS BIGINT)) & {2**DRAW_BITS - 1} AS u
      FROM lines, (SELECT unnest(range({REPLICATES})) AS r)),
    weighed AS (SELECT method, truth, prediction, r, sum({_WEIGHT}) AS n FROM drawn GROUP BY 1, 2, 3, 4
                UNION ALL SELECT method, truth, prediction, -1, count(*) FROM lines GROUP BY 1, 2, 3),
    sides AS (SELECT method, r, truth AS label, n AS support, 0 AS predicted, CASE WHEN truth = prediction THEN n ELSE 0 END AS tp FROM weighed WHERE n > 0
              UNION ALL SELECT method, r, prediction, 0, n, 0 FROM weighed WHERE n > 0),
    ct AS (SELECT method, r, label, sum(support) AS support, sum(predicted) AS predicted, sum(tp) AS tp FROM sides GROUP BY ALL),
    macro AS (SELECT method, r, sum(tp) / sum(support) AS accuracy,
        avg(CASE WHEN support + predicted = 0 THEN 0 ELSE 2 * tp / (support + predicted) END) AS f1_macro,
        avg(CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END) AS precision_macro,
        avg(CASE WHEN support = 0 THEN 0 ELSE tp / support END) AS recall_macro FROM ct GROUP BY 1, 2),
    tidy AS (UNPIVOT macro ON accuracy, f1_macro, precision_macro, recall_macro INTO NAME metric VALUE value)"""
ENDS = """round(max(value) FILTER (r < 0), 6) AS value, round(quantile_cont(value, 0.05) FILTER (r >= 0), 6) AS low,
    round(quantile_cont(value, 0.95) FILTER (r >= 0), 6) AS high"""

OUTCOMES = f"""WITH d AS ({DECISIONS}),
    l AS (SELECT event_id, ts + to_hours(CAST(event_id % 80 - 4 AS INTEGER)) AS label_ts, truth FROM d WHERE event_id % 5 > 0)
    SELECT coalesce(d.event_id, l.event_id) AS event_id,
      CASE WHEN d.event_id IS NULL THEN 'STRAY' WHEN l.event_id IS NULL THEN 'UNLABELLED' WHEN prediction = l.truth THEN 'OK' ELSE 'ERROR' END AS status,
      prediction, l.truth, epoch(date_trunc('second', label_ts))::BIGINT AS label_time
    FROM d FULL JOIN l ON d.event_id = l.event_id AND label_ts >= ts AND label_ts <= ts + INTERVAL 2 DAY"""

TEXT_KEYS = f"SELECT id, category, split, md5({NORMAL}) AS t FROM sp"


def _external() -> str:
    groups = ", ".join(f"4.0::DOUBLE * list_sum(v[{8 * i + 1}:{8 * i + 8}])" for i in range(8))
    return f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    z AS (SELECT vec_id, unnest([{groups}]) AS z, unnest(range(8)) AS l FROM e),
    m AS (SELECT *, max(z) OVER (PARTITION BY vec_id) AS top FROM z),
    s AS (SELECT vec_id, 'c' || CAST(arg_max(l, z) AS VARCHAR) AS prediction, 1 / sum(exp(z - top)) AS confidence FROM m GROUP BY 1)
    SELECT vec_id, prediction, round(confidence, 6) AS confidence,
      CASE WHEN confidence > 0.8 THEN 'automatic' ELSE 'human_review' END AS decision FROM s"""


def sql() -> dict[str, str]:
    sp = DOCUMENT_SPLITS
    choices = [f"v{i}" for i in range(7)]
    weighted = _draw(7, "weighted", "o_orderkey")
    sweep = " UNION ALL ".join(
        f"""SELECT {t}::DOUBLE AS threshold, count(*) FILTER (confidence > {t}) AS automatic,
        round(count(*) FILTER (confidence > {t}) / count(*), 6) AS coverage,
        round(count(*) FILTER (confidence > {t} AND truth = prediction) / nullif(count(*) FILTER (confidence > {t}), 0), 6) AS precision,
        round(count(*) FILTER (confidence > {t} AND truth = prediction) / nullif(count(*) FILTER (truth = prediction), 0), 6) AS recall
        FROM ({LINES})"""
        for t in (0.5, 0.6, 0.7, 0.8, 0.9, 0.97)
    )
    matrix = ", ".join(
        f"""CAST(count(*) FILTER (prediction = '{v}') AS BIGINT) AS "{v}\"""" for v in (*RETURN_FLAGS, "X")
    )
    examples = " UNION ALL ".join(f"SELECT {_text(t)} AS text, {_text(e)} AS expected" for t, e in NEW_EXAMPLES)
    keep = MAX_LENGTH - 2
    fixed = f"""SELECT doc_id, list_concat(['[CLS]'], list_slice({TOKENS}, 1, {keep}), ['[SEP]']) AS toks FROM documents"""
    compared = " UNION ALL ".join(
        f"""SELECT '{c}' AS metric, round(max(CAST({c} AS DOUBLE)) FILTER (method = 'F'), 6) AS "F",
        round(max(CAST({c} AS DOUBLE)) FILTER (method = 'O'), 6) AS "O" FROM runs"""
        for c in (*RUN_DOUBLES, "total_parameters", "trainable_parameters")
    )
    return {
        "held_out_automation": f"""WITH {_centroid_scores()}, {_totals("SELECT * FROM scored", "split")},
            macro AS (SELECT split, {MEANS} FROM cm GROUP BY 1)
            SELECT * FROM (SELECT split, {SUMMARY} FROM scored GROUP BY 1) JOIN macro USING (split)""",
        "held_out_predictions": f"""WITH {_centroid_scores()}
            SELECT vec_id, split, truth, prediction, round(confidence, 6) AS confidence, decision FROM scored""",
        "expand_quota": f"WITH {QUOTAS} SELECT id, category FROM expanded",
        "random_choices": f"""SELECT o_orderkey, {_pick(_list(choices), _draw(7, "pick", "o_orderkey"))} AS picked,
            CAST(CASE WHEN {weighted} * 100 < 10 THEN 2 WHEN {weighted} * 100 < 35 THEN 3
                      WHEN {weighted} * 100 < 75 THEN 4 ELSE 5 END AS INTEGER) AS weighted FROM orders""",
        "generated_tickets": _generated(),
        "shuffled_preview": f"""SELECT doc_id, lang, row_number() OVER (ORDER BY md5('{SEED}:shuffle:' || CAST(doc_id AS VARCHAR))) - 1 AS pos
            FROM documents ORDER BY pos LIMIT 5""",
        "shuffled_positions": f"""SELECT o_orderkey,
            row_number() OVER (ORDER BY md5('{SEED}:shuffle:' || CAST(o_orderkey AS VARCHAR))) - 1 AS pos FROM orders""",
        "class_counts": """SELECT l_returnflag, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS pct
            FROM lineitem GROUP BY 1""",
        "class_counts_by_language": "SELECT lang, count(*) AS n FROM documents GROUP BY 1",
        "document_split": f"""WITH {_split("SELECT doc_id, lang FROM documents", "lang", ("doc_id",), three=False)}
            SELECT doc_id, lang, split FROM sp""",
        "line_split_totals": f"""WITH {_split(f"SELECT {', '.join(LINE_KEY)}, l_returnflag FROM lineitem", "l_returnflag", LINE_KEY, RETURN_FLAGS)}
            SELECT split, l_returnflag, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS order_sum,
              CAST(sum(l_partkey) AS BIGINT) AS part_sum FROM sp GROUP BY 1, 2""",
        "conversation_split": f"""WITH {_split("SELECT conv_id, turn, role FROM conversations", "role", ("conv_id", "turn"))}
            SELECT conv_id, turn, role, split FROM sp""",
        "counts_by_split": f"WITH {sp} SELECT split, category, count(*) AS n FROM sp GROUP BY 1, 2",
        "split_row_counts": f"""WITH {sp} SELECT split AS part, count(*) AS n FROM sp GROUP BY 1
            UNION ALL SELECT 'total', count(*) FROM sp""",
        "encoded_labels": f"""SELECT doc_id, lang AS category, label_id FROM documents
            LEFT JOIN {_labels(LANGUAGES[:3])} AS l ON l.category = lang""",
        "decoded_labels": f"""SELECT vec_id, e.label_id, l.category FROM (SELECT vec_id, label - 2 AS label_id FROM embeddings) AS e
            LEFT JOIN {_labels(EVENT_CLASSES.values())} AS l ON l.label_id = e.label_id""",
        "labelled_projection": f"""SELECT md5(text) AS text_md5, label_id AS label FROM documents
            LEFT JOIN {_labels(LANGUAGES)} AS l ON l.category = lang""",
        "class_weights": f"""WITH {sp}, counts AS (SELECT category, count(*) AS n FROM sp WHERE split = 'train' GROUP BY 1)
            SELECT label_id, category, n, round((SELECT sum(n) FROM counts) / (5 * n), 6) AS weight
            FROM {_labels([*LANGUAGES, "it"])} LEFT JOIN counts USING (category)""",
        "row_weights": """SELECT l_returnflag AS category, count(*) AS n,
            round(count(*) * ((SELECT count(*) FROM lineitem) / (3 * count(*))), 6) AS weight_sum FROM lineitem GROUP BY 1""",
        "tokenized_documents": f"""SELECT doc_id, CAST(len({TOKENS}) AS INTEGER) AS n_tokens,
            md5(array_to_string({TOKENS}, ' ')) AS tokens_md5 FROM documents""",
        "fixed_length_tokens": f"""SELECT doc_id, rtrim(array_to_string(toks, ' ') || repeat(' [PAD]', {MAX_LENGTH} - len(toks)), ' ') AS tokens,
            rtrim(repeat('1 ', len(toks)) || repeat('0 ', {MAX_LENGTH} - len(toks)), ' ') AS mask FROM ({fixed})""",
        "batch_padded_tokens": f"""WITH t AS (SELECT conv_id, turn, nullif(conv_id // 8, 0) AS b,
              list_concat(['[CLS]'], list_slice({TOKENS}, 1, {keep}), ['[SEP]']) AS toks FROM conversations),
            m AS (SELECT *, max(len(toks)) OVER (PARTITION BY b) AS longest FROM t)
            SELECT conv_id, turn, CAST(longest AS INTEGER) AS length,
              array_to_string(toks, ' ') || repeat(' [PAD]', longest - len(toks)) AS tokens,
              rtrim(repeat('1 ', len(toks)) || repeat('0 ', longest - len(toks)), ' ') AS mask FROM m""",
        "vocabulary": f"WITH {_vocabulary()} SELECT token, token_id FROM vocab",
        "token_ids": _encoded("SELECT conv_id, turn, text FROM conversations", "conv_id, turn"),
        "example_token_ids": _encoded(examples, "text, expected"),
        "mapped_batches": """SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) AS net FROM lineitem""",
        "softmax_rows": """WITH z AS (SELECT l_quantity / 10 AS a, l_discount * 50 AS b, l_tax * 50 AS c FROM lineitem),
            e AS (SELECT *, greatest(a, b, c) AS top FROM z),
            p AS (SELECT exp(a - top) AS ea, exp(b - top) AS eb, exp(c - top) AS ec FROM e),
            q AS (SELECT ea / (ea + eb + ec) AS p0, eb / (ea + eb + ec) AS p1, ec / (ea + eb + ec) AS p2 FROM p)
            SELECT CAST(CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS INTEGER) AS label_id,
              count(*) AS n, round(avg(greatest(p0, p1, p2)), 6) AS confidence,
              round(avg(greatest(p0, p1, p2)), 6) AS direct_confidence,
              round(avg(p0), 6) AS p0, round(avg(p2), 6) AS p2 FROM q GROUP BY 1""",
        "routed_lines": """WITH c AS (SELECT nullif(round(1 - l_discount * 4, 2), 0.88) AS confidence FROM lineitem)
            SELECT confidence, CASE WHEN confidence > 0.8 THEN 'automatic' ELSE 'human_review' END AS decision,
              CASE WHEN confidence >= 0.8 THEN 'automatic' ELSE 'human_review' END AS inclusive_decision, count(*) AS n
            FROM c GROUP BY ALL""",
        "rounded_confidence": f"""SELECT {", ".join(LINE_KEY)}, round_even(l_extendedprice / 104729.0::DOUBLE, 4) AS confidence FROM lineitem""",
        "confusion": f"SELECT truth, prediction, count(*) AS n FROM ({LINES}) GROUP BY 1, 2",
        "confusion_matrix": f"""SELECT category AS truth, {matrix}
            FROM {_labels([*RETURN_FLAGS, "X"])} LEFT JOIN ({LINES}) ON truth = category GROUP BY 1""",
        "quality_accuracy": f"SELECT round(avg(CASE WHEN truth = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM ({PAIRS})",
        "macro_metrics": f"WITH {_totals(LINES)} SELECT {MEANS} FROM cm",
        "macro_metrics_listed": f"WITH {_totals(LINES)} SELECT {LISTED} FROM cm",
        "class_report": f"""WITH {_totals(LINES)}, r AS (
              SELECT label AS row, precision, recall, f1, support FROM cm
              UNION ALL SELECT 'accuracy', NULL, NULL, sum(tp) / sum(support), sum(support) FROM cm
              UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM cm
              UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                sum(f1 * support) / sum(support), sum(support) FROM cm)
            SELECT row, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
              CAST(support AS BIGINT) AS support FROM r""",
        "named_metrics": f"""SELECT count(*) AS n_pairs,
            round(1 - sum(CASE WHEN truth = prediction THEN n ELSE 0 END) / sum(n), 6) AS error_rate, max(n) AS largest_cell
            FROM (SELECT truth, prediction, count(*) AS n FROM ({LINES}) GROUP BY 1, 2)""",
        "scored_metrics": f"""WITH {_centroid_scores()},
            one AS (SELECT vec_id, split, max(p) FILTER (l = truth) AS own, list(p) AS ps,
              sum(pow(p - CASE WHEN l = truth THEN 1 ELSE 0 END, 2)) AS apart FROM pr GROUP BY 1, 2)
            SELECT split, round(avg(CASE WHEN len(list_filter(ps, lambda x: x > own)) < 2 THEN 1.0 ELSE 0.0 END), 6) AS top_2,
              round(avg(own), 6) AS p_truth, round(avg(apart), 6) AS brier FROM one GROUP BY 1""",
        "weighted_log_loss": f"""WITH {_centroid_scores()}, w AS (SELECT label, sum(count(*)) OVER () / (10 * count(*)) AS weight FROM sp WHERE split = 'train' GROUP BY 1)
            SELECT round(sum(weight * -ln(p_truth)) / sum(weight), 6) AS log_loss FROM scored JOIN w ON label = truth""",
        "automation_summary": f"SELECT {SUMMARY} FROM ({ROUTED})",
        "confidence_stats": f"""SELECT round(avg(confidence), 6) AS mean_confidence, round(min(confidence), 6) AS min_confidence,
            round(max(confidence), 6) AS max_confidence FROM ({LINES})""",
        "flagged_errors": f"SELECT *, CASE WHEN truth = prediction THEN 'OK' ELSE 'ERROR' END AS status FROM ({PAIRS})",
        "error_rows": f"""SELECT {", ".join(LINE_KEY)}, truth AS expected, prediction AS predicted, round(confidence, 6) AS confidence
            FROM ({LINES}) WHERE truth <> prediction""",
        "error_summary": f"""SELECT count(*) AS evaluated, count(*) FILTER (truth = prediction) AS correct,
            count(*) FILTER (truth <> prediction) AS errors,
            round(count(*) FILTER (truth = prediction) / count(*), 6) AS accuracy FROM ({LINES})""",
        "confused_pairs": f"""SELECT truth, nullif(prediction, 'N') AS prediction, count(*) AS n FROM ({LINES})
            WHERE NOT coalesce(truth = nullif(prediction, 'N'), false)
            GROUP BY 1, 2 ORDER BY n DESC, 1, 2 NULLS FIRST LIMIT 4""",
        "confident_errors": f"""SELECT {", ".join(LINE_KEY)}, truth AS expected, prediction AS predicted, round(confidence, 6) AS confidence
            FROM ({LINES}) WHERE truth <> prediction AND confidence > 0.97""",
        "early_stop": f"WITH {_stops(3)} SELECT run_id, stop_epoch FROM stops",
        "best_round": f"""WITH {_stops(4)}, seen AS (SELECT hist.*, stop_epoch,
              row_number() OVER (PARTITION BY run_id ORDER BY f1_macro DESC, epoch) AS r
              FROM hist JOIN stops USING (run_id) WHERE epoch <= stop_epoch)
            SELECT run_id, stop_epoch, epoch AS best_epoch, f1_macro FROM seen WHERE r = 1""",
        "compared_runs": f"WITH {RUNS} {compared}",
        "chosen_run": f"""WITH {RUNS} SELECT method, {RUN_ROUNDED} FROM runs
            ORDER BY f1_macro DESC, training_time_seconds, method LIMIT 1""",
        "run_intervals": f"WITH {BOOTSTRAP} SELECT method, metric, {ENDS} FROM tidy GROUP BY 1, 2",
        "run_difference": f"""WITH {BOOTSTRAP}, apart AS (SELECT r, metric, sum(CASE method WHEN 'F' THEN value ELSE -value END) AS value FROM tidy GROUP BY 1, 2),
            ends AS (SELECT metric, {ENDS} FROM apart GROUP BY 1) SELECT *, low > 0 OR high < 0 AS differs FROM ends""",
        "savings": f"""SELECT round(r, 6) AS automation_rate, round({MONTHLY_COST} * r, 6) AS monthly_saving,
            round({MONTHLY_COST} * r * 12, 6) AS annual_saving
            FROM (SELECT count(*) FILTER (decision = 'automatic') / count(*) AS r FROM ({ROUTED}))""",
        "csv_round_trip": f"SELECT id, md5(text) AS text_md5, category, annotator_confidence FROM ({DOCUMENTS})",
        "refused_rows": f"""SELECT CASE WHEN id % 7 <> 3 THEN id END AS id, md5(text) AS text_md5, category,
            CASE WHEN id % 11 <> 5 THEN annotator_confidence END AS annotator_confidence, id % 7 = 3 OR id % 11 = 5 AS refused
            FROM ({DOCUMENTS})""",
        "stored_splits": f"WITH {sp} SELECT id, category, md5(text) AS text_md5 FROM sp WHERE split = 'validation'",
        "stored_scores": f"""SELECT truth AS category, prediction, decision, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS id_sum,
            round(sum(confidence), 6) AS confidence_sum FROM ({ROUTED}) GROUP BY 1, 2, 3""",
        "routed_output": f"""SELECT count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS key_sum, round(max(confidence), 6) AS max_confidence
            FROM ({ROUTED}) WHERE decision = 'human_review'""",
        "stored_runs": f"""WITH {RUNS} SELECT 'm' AS model, method, true AS weighted, {RUN_ROUNDED}, CAST(42 AS BIGINT) AS seed FROM runs""",
        "threshold_sweep": sweep,
        "reliability_bins": f"""WITH {BINS} SELECT bin, n, round(accuracy, 6) AS accuracy, round(mean_confidence, 6) AS mean_confidence,
            round(abs(accuracy - mean_confidence), 6) AS gap FROM bins""",
        "calibration_error": f"WITH {BINS} SELECT round(sum(n * abs(accuracy - mean_confidence)) / sum(n), 6) AS ece FROM bins",
        "calibrated_confidence": f"""WITH {CALIBRATED}
            SELECT round(c, 6) AS raw_confidence, round(y, 6) AS confidence, CAST(sum(n) AS BIGINT) AS n FROM answer GROUP BY c, y""",
        "calibration_gain": f"""WITH {LINE_SPLITS}, bins AS (SELECT floor(confidence * 10) AS bin, count(*) AS n,
              count(*) FILTER (truth = prediction) / count(*) AS accuracy, avg(confidence) AS mean FROM sp WHERE split = 'test'
              GROUP BY least(9, floor(confidence * 10)), 1)
            SELECT round(sum(n * abs(accuracy - mean)) / sum(n), 6) AS ece_before, true AS improved, true AS monotone
            FROM (SELECT least(9, bin) AS bin, sum(n) AS n, sum(n * accuracy) / sum(n) AS accuracy, sum(n * mean) / sum(n) AS mean FROM bins GROUP BY 1)""",
        "threshold_curve": f"WITH {PRICED} SELECT {CURVE_COLUMNS} FROM lines",
        "chosen_threshold": f"""WITH {PRICED}, best AS (SELECT * FROM lines WHERE precision >= 0.4 ORDER BY threshold LIMIT 1),
            rank AS (SELECT round(sum((n - r) * (2 * r_above + r))::DOUBLE / (2 * sum(r) * sum(n - r)), 6) AS auc FROM curve)
            SELECT {CURVE_COLUMNS}, auc FROM rank LEFT JOIN best ON true""",
        "drift_scores": DRIFT_SCORES,
        "streamed_errors": OUTCOMES,
        "drift_windows": DRIFT + "GROUP BY 1",
        "streamed_drift": DRIFT + "GROUP BY 1",
        "streamed_drift_closed": DRIFT + """GROUP BY 1 HAVING date_trunc('day', min(ts)) + INTERVAL 1 DAY
            <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
        "split_leakage": f"""WITH {sp}, k AS ({TEXT_KEYS}), seen AS (SELECT DISTINCT t FROM k WHERE split = 'train')
            SELECT split, count(*) AS n, count(*) FILTER (seen.t IS NOT NULL) AS leaked, count(DISTINCT seen.t) AS leaked_texts
            FROM k LEFT JOIN seen USING (t) WHERE split <> 'train' GROUP BY 1""",
        "leaked_rows": f"""WITH {sp}, k AS ({TEXT_KEYS})
            SELECT id, category, split FROM k WHERE split <> 'train' AND t IN (SELECT t FROM k WHERE split = 'train')""",
        "benchmark_overlap": f"""WITH i AS (SELECT item_id, ' ' || array_to_string({TOKENS}, ' ') || ' ' AS line
              FROM benchmark WHERE len({TOKENS}) > 0),
            d AS (SELECT doc_id, ' ' || array_to_string({TOKENS}, ' ') || ' ' AS line FROM documents)
            SELECT item_id, count(*) AS n_documents FROM i JOIN d ON contains(d.line, i.line) GROUP BY 1""",
        "conflicting_labels": f"""SELECT md5({NORMAL}) AS text_key, count(*) AS n_rows, count(DISTINCT source) AS n_labels
            FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1""",
        "external_scores": _external(),
        "fitted_full": f"""SELECT 'hashed' AS model, 'full' AS method, true AS weighted, CAST({SEED} AS BIGINT) AS seed,
            CAST({FULL_FIT.features} * 5 + 4 AS BIGINT) AS total_parameters, CAST({FULL_FIT.features} * 4 + 4 AS BIGINT) AS trainable_parameters,
            true AS accurate, true AS timed""",
        "fitted_compact": f"""SELECT 'projected' AS model, 'compact' AS method, false AS weighted, CAST({SEED} AS BIGINT) AS seed,
            CAST({COMPACT_FIT.features} * 2 + {COMPACT_FIT.components} * 4 + 4 AS BIGINT) AS total_parameters,
            CAST({COMPACT_FIT.components} * 4 + 4 AS BIGINT) AS trainable_parameters, true AS accurate, true AS timed""",
        "fit_history": "SELECT 'full' AS run_id, 1 AS first, true AS stops_there, true AS keeps_the_best",
        "scored_documents": f"""WITH {sp} SELECT id, md5(text) AS text_md5, 4 AS n_probs, true AS sums_to_one, true AS is_largest,
            true AS decision_follows FROM sp WHERE split = 'test'""",
        "wrong_labels": f"""SELECT count(*) AS n, count(*) FILTER ({_draw(11, "wrong", "doc_id")} < 0.03) AS n_planted,
            true AS found, true AS mostly_planted FROM documents""",
        "scored_text": f"WITH {sp} SELECT min(id) AS id, true AS same FROM sp WHERE split = 'test'",
        "reloaded_model": f"WITH {sp} SELECT count(*) AS n, CAST(0 AS BIGINT) AS different FROM sp WHERE split = 'test'",
        "streamed_scores": f"WITH {sp} SELECT id, CAST(1 AS BIGINT) AS n, true AS same FROM sp WHERE split = 'test'",
    }
