"""The same answers in plain SQL, for DuckDB over the same tables.

Written from the definitions and not from the Spark plans: ranks are global
window ranks, neighbours compare every pair, folds deal out places one by one.
"""

from __future__ import annotations

from ..operators.fingerprint import BASE, LAYER_PATH, MAX_PATH, PRIME, RADIUS, WIDTHS, WORD_BITS, default_keys, n_words
from ..operators.grid import GRIDS
from .queries import REPEATS, RUN_CLOCK, TREE


def _key(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


DOCS = "docs AS (SELECT doc_id AS row_id, text AS structure FROM documents)"
GOOD = "good AS (SELECT * FROM docs WHERE length(structure) >= 30 AND length(trim(structure)) > 0)"
HITS = """hits AS (SELECT doc_id AS row_id, 'quality' AS assay, quality AS hit FROM labels
  UNION ALL SELECT doc_id, 'toxic', toxic FROM labels)"""
WIDE = """wide AS (SELECT d.doc_id AS row_id, d.text AS structure, l.quality::DOUBLE AS quality, l.toxic::DOUBLE AS toxic
  FROM documents d LEFT JOIN labels l USING (doc_id))"""
SCORES = """scores AS (SELECT d.doc_id AS row_id, lang, source, toxic AS y, (n_chars % 37)::DOUBLE / 37e0 AS score,
  ((n_chars % 37)::DOUBLE / 37e0 >= 0.5)::INT AS prediction FROM documents d JOIN labels l USING (doc_id))"""
FAMILY = "CASE lang WHEN 'en' THEN 'MACCS' WHEN 'de' THEN 'Morgan' ELSE upper(lang) END"
REQUEST = f"""request AS (SELECT source AS assay_name, 'dt' AS "Model", {FAMILY} AS "MF", min(doc_id) AS request_pos
  FROM documents GROUP BY ALL)"""
REGISTRY = f"""registry AS (SELECT source AS assay, {FAMILY} AS fp, 'dt' AS model, 'tree' AS kind,
  concat_ws('_', source, 'best_model', {FAMILY}, 'dt') AS path
  FROM scores GROUP BY ALL HAVING max(y) = 1)"""
FAMILIES = "families AS (SELECT unnest(" + _list(WIDTHS) + ") AS fp)"
REJECTS = "rejects AS (SELECT row_id, fp, 'too short' AS reason FROM docs, families WHERE length(structure) < 30)"

BITS = f"""bits AS (SELECT row_id, list_filter(range(1, {len(default_keys()) + 1}),
    lambda i: contains(lower(structure), ({_list(default_keys())})[i])) AS b FROM good)"""
ALIGNED = "x AS (SELECT row_id, assay, hit, b FROM bits JOIN hits USING (row_id))"


def _csv(column: str) -> str:
    return f"array_to_string({column}, ',')"


def _sorted(column: str) -> str:
    return f"list_sort(list_distinct({column}))"


def _token_hash(tokens: str) -> str:
    return f"list_transform({tokens}, lambda t: {_key('t')} % {PRIME})"


def _fold(values: str, start: str = "0::BIGINT") -> str:
    return f"list_reduce({values}, lambda a, v: (a * {BASE} + v) % {PRIME}, {start})"


def _runs(values: str, n: int) -> str:
    """Hash of every run of n values, from the list zipped with itself shifted by 1 … n - 1."""
    if n == 1:
        return values
    step = "z[1]"
    for i in range(2, n + 1):
        step = f"(({step} * {BASE} + z[{i}]) % {PRIME})"
    shifted = ", ".join(f"{values}[{i}:]" for i in range(1, n + 1))
    return f"list_transform(list_zip({shifted})[:greatest(len({values}) - {n - 1}, 0)], lambda z: {step})"


def _place(hashes: str, tag: int, width: int) -> str:
    return f"list_transform({hashes}, lambda h: ((h + {tag * BASE}) % {width})::INT)"


def _concat(parts: list[str]) -> str:
    return "flatten([" + ", ".join(parts) + "])"


TOKENS = f"tok AS (SELECT row_id, {_token_hash("string_split(structure, ' ')")} AS t FROM good)"


def _window(radius: int) -> str:
    if radius == 0:
        return "t"
    inside = f"t[greatest(i - {radius}, 1):least(i + {radius}, len(t))]"
    return f"list_transform(range(1, len(t) + 1), lambda i: {_fold(inside)})"


MORGAN = "SELECT row_id, " + _sorted(_concat([_place(_window(r), r, WIDTHS["Morgan"]) for r in range(RADIUS + 1)])) + " AS b FROM tok"
PATHS = "SELECT row_id, " + _sorted(_concat([_place(_runs("t", n), n, WIDTHS["RDKit"]) for n in range(1, MAX_PATH + 1)])) + " AS b FROM tok"
LAYER_VALUES = f"""lay AS (SELECT row_id, {_token_hash("string_split(structure, ' ')")} AS t1,
  {_token_hash("string_split(lower(structure), ' ')")} AS t2,
  list_transform(string_split(structure, ' '), lambda w: least(length(w), 12)::BIGINT) AS t3 FROM good)"""
LAYERED = "SELECT row_id, " + _sorted(_concat([
    _place(_runs(f"t{layer}", n), layer * 100 + n, WIDTHS["Layered"]) for layer in (1, 2, 3) for n in range(1, LAYER_PATH + 1)
])) + " AS b FROM lay"
CHARS = "ch AS (SELECT row_id, list_transform(string_split(structure, ''), lambda c: unicode(c)::BIGINT) AS t FROM good)"
PATTERNS = "SELECT row_id, " + _sorted(_place(_runs("t", 3), 3, WIDTHS["Pattern"])) + " AS b FROM ch"


def _ranked(name: str, source: str, by: str, key: str) -> str:
    return f"""{name} AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {key}, row_id) AS r,
  count(*) OVER (PARTITION BY {by}) AS n FROM {source})"""


def _shuffle(seed: str) -> str:
    return _key(f"'{seed}:' || row_id")


TEST_SIZE = "ceil(round(n * 0.2, 9))"


def _holdout(source: str, by: str, seed: str) -> str:
    return _ranked("ranked", source, by, _shuffle(seed)) + f""",
split AS (SELECT *, CASE WHEN r <= {TEST_SIZE} THEN 'test' ELSE 'train' END AS split FROM ranked)"""


def _folds(source: str, key: str, k: int = 5) -> str:
    """Places of a class are dealt out to the folds in turn; ranks take them fold by fold."""
    return f"""cls AS (SELECT assay, hit, count(*) AS n_cls, min(row_id) AS first_id FROM {source} GROUP BY ALL),
starts AS (SELECT *, coalesce(sum(n_cls) OVER (PARTITION BY assay ORDER BY first_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM cls),
places AS (SELECT assay, hit, unnest(range(start, start + n_cls)) AS p FROM starts),
dealt AS (SELECT assay, hit, (p % {k})::INT AS fold, row_number() OVER (PARTITION BY assay, hit ORDER BY p % {k}, p) AS r FROM places),
{_ranked('by_class', source, 'assay, hit', key)},
folded AS (SELECT s.*, d.fold FROM by_class s JOIN dealt d USING (assay, hit, r))"""


KEYED_SCORES = "keyed AS (SELECT *, 'toxic' AS assay, y AS hit FROM scores)"
SHUFFLED_FOLDS = _folds("hits", _shuffle("42"))
SCORE_FOLDS = SCORES + ",\n" + KEYED_SCORES + ",\n" + _folds("keyed", _shuffle("42"))


def _confusion(source: str, by: str) -> str:
    return f"""conf AS (SELECT {by},
  count(*) FILTER (y = 1 AND prediction = 1) AS n_tp, count(*) FILTER (y <> 1 AND prediction = 1) AS n_fp,
  count(*) FILTER (y = 1 AND prediction <> 1) AS n_fn, count(*) FILTER (y <> 1 AND prediction <> 1) AS n_tn
  FROM {source} GROUP BY {by})"""


def _ratio(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} = 0 THEN 0e0 ELSE ({part})::DOUBLE / ({whole})::DOUBLE END"


RATIOS = {
    "precision": _ratio("n_tp", "(n_tp + n_fp)"),
    "recall": _ratio("n_tp", "(n_tp + n_fn)"),
    "f1": _ratio("2 * n_tp", "(2 * n_tp + n_fp + n_fn)"),
    "accuracy": _ratio("n_tp + n_tn", "(n_tp + n_fp + n_fn + n_tn)"),
}
ALL_RATIOS = ", ".join(f"{expr} AS {name}" for name, expr in RATIOS.items())


def _auc(source: str, by: str, name: str = "auc") -> str:
    """Share of (positive, negative) pairs in the right order, ties half, from mid-ranks."""
    return f"""mid AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY score) + (count(*) OVER (PARTITION BY {by}, score) - 1) / 2e0 AS mr
  FROM {source}),
{name} AS (SELECT {by}, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg,
  CASE WHEN count(*) FILTER (y = 1) > 0 AND count(*) FILTER (y = 0) > 0 THEN
    (sum(mr) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2e0)
    / (count(*) FILTER (y = 1)::DOUBLE * count(*) FILTER (y = 0)) END AS roc_auc FROM mid GROUP BY {by})"""


SMALL = """counts AS (SELECT assay, count(*) FILTER (hit = 1) AS n_pos, count(*) FILTER (hit = 0) AS n_neg FROM x GROUP BY assay),
small AS (SELECT x.*, abs(n_pos - n_neg) AS n_new, least(n_pos, n_neg) AS m FROM x JOIN counts USING (assay)
  WHERE hit = (n_pos < n_neg)::INT AND n_pos <> n_neg)"""


def _pairs(distance: str, by: str, source: str) -> str:
    return f"""pairs AS (SELECT a.{by}, a.row_id, b.row_id AS other, {distance} AS d
  FROM {source} a JOIN {source} b ON a.{by} = b.{by} AND a.row_id <> b.row_id),
near AS (SELECT *, row_number() OVER (PARTITION BY {by}, row_id ORDER BY d, other) AS nn_rank FROM pairs QUALIFY nn_rank <= 5)"""


HAMMING = "(len(a.b) + len(b.b) - 2 * len(list_intersect(a.b, b.b)))::BIGINT"
SQUARED = "list_sum(list_transform(list_zip(a.g, b.g), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
GRIDDED = "list_transform(embedding, lambda v: round(v::DOUBLE * 1000e0)::BIGINT)"

DRAWS = f"""drawn AS (SELECT assay, m, unnest(range(0, n_new)) AS draw FROM (SELECT DISTINCT assay, n_new, m FROM small)),
picks AS (SELECT assay, draw, {_key("'42:' || assay || ':b:' || draw")} % m AS base_rank,
  {_key("'42:' || assay || ':n:' || draw")} % 5 + 1 AS nn_rank, {_key("'42:' || assay || ':g:' || draw")}::DOUBLE / {2**60}e0 AS gap FROM drawn),
based AS (SELECT assay, row_id, row_number() OVER (PARTITION BY assay ORDER BY {_key("row_id::VARCHAR")}, row_id) - 1 AS base_rank FROM small),
chosen AS (SELECT p.*, s.row_id AS base_id, n.other AS neighbour_id FROM picks p JOIN based s USING (assay, base_rank)
  JOIN near n ON n.assay = s.assay AND n.row_id = s.row_id AND n.nn_rank = p.nn_rank)"""
SMOTE_BITS = [DOCS, GOOD, HITS, BITS, ALIGNED, SMALL, _pairs(HAMMING, "assay", "small"), DRAWS,
              """made AS (SELECT c.assay, draw, base_id, neighbour_id, a.hit, list_sort(list_intersect(a.b, b.b)) AS b FROM chosen c
  JOIN small a ON a.assay = c.assay AND a.row_id = base_id JOIN small b ON b.assay = c.assay AND b.row_id = neighbour_id)"""]


def _gini(n1: str, n: str) -> str:
    p = f"(({n1})::DOUBLE / ({n})::DOUBLE)"
    return f"(2e0 * {p} * (1e0 - {p}))"


def _entropy(n1: str, n: str) -> str:
    p = f"(({n1})::DOUBLE / ({n})::DOUBLE)"
    return "(" + " + ".join(f"CASE WHEN {q} <= 0e0 THEN 0e0 ELSE -{q} * log2({q}) END" for q in (p, f"(1e0 - {p})")) + ")"


def _gain(measure) -> str:
    return (
        f"round({measure('n1', 'n')} - (s::DOUBLE * {measure('s1', 's')} + (n - s)::DOUBLE * "
        f"{measure('n1 - s1', 'n - s')}) / n::DOUBLE, 10)"
    )


def _scan(by: str, source: str, measure) -> str:
    return f"""tot AS (SELECT {by}, count(*) AS n, sum(hit)::BIGINT AS n1 FROM {source} GROUP BY ALL),
per_bit AS (SELECT {by}, bit, count(*) AS s, sum(hit)::BIGINT AS s1 FROM (SELECT {by}, hit, unnest(b) AS bit FROM {source}) GROUP BY ALL),
scan AS (SELECT *, {_gain(measure)} AS gain FROM per_bit JOIN tot USING ({by}) WHERE s < n)"""


def _scan_query(measure) -> str:
    return _with(DOCS, GOOD, HITS, BITS, ALIGNED, _scan("assay", "x", measure)) + \
        "SELECT assay, bit::INT AS bit, s, s1, n, n1, round(gain, 6) AS gain FROM scan"


def _level(i: int) -> str:
    """Nodes and best bits of level i from the rows of that level."""
    src = f"rows{i}"
    return f"""nodes{i} AS (SELECT assay, node, count(*) AS n, sum(hit)::BIGINT AS n1 FROM {src} GROUP BY ALL),
bits{i} AS (SELECT assay, node, bit, count(*) AS s, sum(hit)::BIGINT AS s1 FROM (SELECT assay, node, hit, unnest(b) AS bit FROM {src}) GROUP BY ALL),
scan{i} AS (SELECT *, {_gain(_gini)} AS gain FROM bits{i} JOIN nodes{i} USING (assay, node) WHERE s < n AND n1 > 0 AND n1 < n),
best{i} AS (SELECT * FROM scan{i} QUALIFY row_number() OVER (PARTITION BY assay, node ORDER BY gain DESC, bit) = 1),
rows{i + 1} AS (SELECT r.assay, r.row_id, r.hit, r.b,
  md5(r.node || '>' || k.bit || '>' || CASE WHEN list_contains(r.b, k.bit) THEN '1' ELSE '0' END) AS node
  FROM {src} r JOIN best{i} k USING (assay, node))"""


def _final_tree(depth: int) -> list[str]:
    """``tested``: the hold-out rows with the score of the leaf they reach in the tree of the training rows."""
    walks = [f"""walk{i + 1} AS (SELECT w.assay, w.row_id, w.hit, w.b, CASE WHEN k.bit IS NULL THEN w.node
  ELSE md5(w.node || '>' || k.bit || '>' || CASE WHEN list_contains(w.b, k.bit) THEN '1' ELSE '0' END) END AS node
  FROM walk{i} w LEFT JOIN best{i} k USING (assay, node))""" for i in range(depth)]
    every = " UNION ALL ".join(f"SELECT assay, node, n, n1 FROM nodes{i}" for i in range(depth + 1))
    return [
        DOCS, GOOD, HITS, BITS, ALIGNED, _holdout("x", "assay", "42"),
        "rows0 AS (SELECT assay, row_id, hit, b, 'root' AS node FROM split WHERE split = 'train')", *[_level(i) for i in range(depth)],
        f"nodes{depth} AS (SELECT assay, node, count(*) AS n, sum(hit)::BIGINT AS n1 FROM rows{depth} GROUP BY ALL)",
        "walk0 AS (SELECT assay, row_id, hit, b, 'root' AS node FROM split WHERE split = 'test')", *walks, f"every AS ({every})",
        f"""tested AS (SELECT assay, row_id, hit AS y, n1::DOUBLE / n::DOUBLE AS score, (2 * n1 > n)::INT AS prediction
  FROM walk{depth} JOIN every USING (assay, node))""",
    ]


def _fp(name: str) -> tuple[list[str], str]:
    return {
        "MACCS": ([DOCS, GOOD, BITS], "SELECT row_id, b FROM bits"),
        "Morgan": ([DOCS, GOOD, TOKENS], MORGAN),
        "RDKit": ([DOCS, GOOD, TOKENS], PATHS),
        "Layered": ([DOCS, GOOD, LAYER_VALUES], LAYERED),
        "Pattern": ([DOCS, GOOD, CHARS], PATTERNS),
    }[name]


def _fp_query(name: str) -> str:
    parts, select = _fp(name)
    return _with(*parts) + f"SELECT row_id, {_csv('b')} AS bits FROM ({select})"


def _words() -> str:
    word = f"coalesce(list_sum(list_transform(list_filter(b, lambda i: i // {WORD_BITS} = w), lambda i: (1::BIGINT << (i % {WORD_BITS})::INT))), 0)::BIGINT"
    return f"SELECT row_id, w::INT AS place, {word} AS word FROM bits, (SELECT unnest(range(0, {n_words(WIDTHS['MACCS'])})) AS w)"


def _values(grid_name: str, key: str) -> str:
    values = GRIDS[grid_name][key]
    rows = ", ".join(
        f"({i}, {'NULL' if v is None else repr(v) if isinstance(v, str) else v})" for i, v in enumerate(values)
    )
    return f"(VALUES {rows}) AS {key}_v(i_{key}, {key})"


def _grid(name: str) -> str:
    keys = sorted(GRIDS[name])
    order = ", ".join(f"i_{k}" for k in keys)
    return (
        f"grid AS (SELECT (row_number() OVER (ORDER BY {order}) - 1)::INT AS param_idx, {', '.join(keys)} FROM "
        + ", ".join(_values(name, k) for k in keys) + ")"
    )


def sql() -> dict[str, str]:
    out: dict[str, str] = {}
    # sources, sinks
    out["src_assay_wide"] = _with(WIDE) + "SELECT * FROM wide"
    parts, select = _fp("Pattern")
    out["src_fingerprint_partition"] = _with(*parts) + f"SELECT row_id, 'Pattern' AS fp, {_csv('b')} AS bits FROM ({select})"
    out["src_rejects"] = _with(DOCS, FAMILIES, REJECTS) + "SELECT row_id, fp, reason FROM rejects WHERE fp = 'Morgan'"
    out["src_request"] = _with(REQUEST) + "SELECT * FROM request"
    out["snk_fp_roundtrip"] = _with(DOCS, GOOD, BITS, TOKENS) + (
        f"SELECT row_id, 'MACCS' AS fp, {_csv('b')} AS bits FROM bits UNION ALL "
        f"SELECT row_id, 'Morgan', {_csv('b')} FROM ({MORGAN})"
    )
    out["snk_rejects_roundtrip"] = _with(DOCS, FAMILIES, REJECTS) + "SELECT row_id, fp, reason FROM rejects"
    out["snk_split_roundtrip"] = _with(HITS, _holdout("hits", "assay", "42")) + (
        "SELECT row_id, hit, 'documents' AS data_name, assay, 'MACCS' AS fp, 'dt' AS model, "
        f"'20250408' AS run_date, '{RUN_CLOCK}' AS run_time, split FROM split"
    )
    out["snk_results_resume"] = _with(SCORES) + (
        "SELECT DISTINCT lang AS assay, source AS fp, 'dt' AS model, round(score * 37)::INT AS param_idx "
        "FROM scores WHERE score >= 0.5"
    )
    long_metrics = " UNION ALL ".join(
        f"SELECT lang, part, '{m}' AS metric, round({m}, 6) AS value FROM m" for m in [*RATIOS, "roc_auc"]
    )
    out["metric_record"] = _with(
        SCORES, _holdout("scores", "lang", "42"),
        "parted AS (SELECT *, CASE WHEN split = 'train' THEN 'validation' ELSE 'test' END AS part FROM split)",
        _confusion("parted", "lang, part"), _auc("parted", "lang, part"),
        f"m AS (SELECT lang, part, {ALL_RATIOS}, roc_auc FROM conf JOIN auc USING (lang, part))",
    ) + long_metrics

    # projection, filter, predicate
    out["prj_required"] = "SELECT text AS structure FROM documents"
    out["prj_assay_by_number"] = _with(WIDE) + "SELECT row_id, 'toxic' AS assay, toxic AS hit FROM wide"
    out["prj_assay_names"] = _with(WIDE) + (
        "SELECT 1::INT AS assay_num, 'quality' AS assay, count(quality) AS n_hits FROM wide "
        "UNION ALL SELECT 2::INT, 'toxic', count(toxic) FROM wide"
    )
    melted = (
        "(SELECT row_id, 'quality' AS assay, quality::INT AS hit FROM wide UNION ALL SELECT row_id, 'toxic', toxic::INT FROM wide)"
    )
    out["prj_melt_assays"] = _with(WIDE) + f"SELECT * FROM {melted}"
    columns = ", ".join(f"list_contains(b, {i})::INT AS maccs_{i + 1}" for i in range(WIDTHS["MACCS"]))
    out["prj_bit_columns"] = _with(DOCS, GOOD, BITS) + f"SELECT row_id, {columns} FROM bits"
    out["flt_labelled"] = _with(WIDE) + f"SELECT * FROM {melted} WHERE hit IS NOT NULL"
    out["flt_drop_rejects"] = _with(DOCS) + "SELECT * FROM docs WHERE length(structure) >= 30"
    out["flt_parseable"] = _with(DOCS) + (
        "SELECT row_id, length(structure) >= 30 AS ok, CASE WHEN length(structure) < 30 THEN 'too short' END AS reason FROM docs"
    )
    out["flt_usable_requests"] = _with(SCORES, REQUEST, REGISTRY, FAMILIES) + (
        'SELECT q.*, reason = \'ok\' AS usable FROM (SELECT request.*, CASE WHEN g.assay IS NULL THEN \'no model\' '
        "WHEN f.fp IS NULL THEN 'no features' ELSE 'ok' END AS reason FROM request "
        'LEFT JOIN registry g ON g.assay = assay_name AND g.fp = request."MF" AND g.model = request."Model" LEFT JOIN families f ON f.fp = request."MF") q'
    )
    out["flt_gate"] = _with(
        HITS, SHUFFLED_FOLDS,
        "per AS (SELECT assay, fold, sum(hit)::BIGINT AS p, count(*) AS c FROM folded GROUP BY ALL)",
        "total AS (SELECT assay, sum(p)::BIGINT AS n_pos, (sum(c) - sum(p))::BIGINT AS n_neg FROM per GROUP BY ALL)",
        """gated AS (SELECT assay, n_pos, n_neg, min(least(n_pos - p, n_neg - (c - p)))::BIGINT AS min_minority
  FROM per JOIN total USING (assay) GROUP BY ALL)""",
    ) + """SELECT *, min_minority >= 6 AS open, CASE WHEN least(n_pos, n_neg) = 0 THEN 'one class'
  WHEN min_minority < 1 THEN 'a fold has one class' WHEN min_minority < 6 THEN 'too few minority rows' ELSE 'ok' END AS reason FROM gated"""
    out["flt_min_support"] = _with(SCORES, "each AS (SELECT row_id, source AS assay, y AS hit FROM scores)") + (
        "SELECT * FROM each WHERE assay IN (SELECT assay FROM each GROUP BY assay HAVING sum(hit) >= 5)"
    )
    out["flt_main_fragment"] = _with(DOCS, "parts AS (SELECT row_id, unnest(string_split(structure, '.')) AS part, generate_subscripts(string_split(structure, '.'), 1) AS i FROM docs)") + (
        "SELECT row_id, part AS fragment, regexp_matches(structure, '[0-9]') AS has_digit FROM parts JOIN docs USING (row_id) "
        "QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY length(part) DESC, i) = 1"
    )
    out["flt_dense_index"] = _with(DOCS) + (
        "SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS row_no FROM docs WHERE length(structure) >= 30"
    )

    # joins
    out["join_align_xy"] = _with(DOCS, GOOD, HITS, BITS, ALIGNED) + f"SELECT row_id, assay, hit, {_csv('b')} AS bits FROM x"
    out["join_request_registry"] = _with(SCORES, REQUEST, REGISTRY) + (
        'SELECT request.*, kind, path FROM request '
        'JOIN registry g ON g.assay = assay_name AND g.fp = request."MF" AND g.model = request."Model"'
    )
    out["join_attach_structure"] = _with(SCORES) + (
        "SELECT row_id, prediction, text AS structure FROM scores JOIN documents ON doc_id = row_id"
    )
    out["join_knn_hamming"] = _with(DOCS, GOOD, HITS, BITS, ALIGNED, SMALL, _pairs(HAMMING, "assay", "small")) + (
        "SELECT assay, row_id, nn_rank::INT AS nn_rank, other AS neighbour_id, d AS distance FROM near"
    )
    out["join_knn_euclid"] = _with(
        f"v AS (SELECT vec_id AS row_id, label, {GRIDDED} AS g FROM embeddings)", _pairs(SQUARED, "label", "v")
    ) + "SELECT label, row_id, nn_rank::INT AS nn_rank, other AS neighbour_id, d AS distance FROM near"
    counted = "counted AS (SELECT assay, count(*) FILTER (hit = 1) AS n_pos, count(*) FILTER (hit = 0) AS n_neg FROM hits GROUP BY ALL)"
    out["join_run_matrix"] = _with(HITS, counted) + (
        "SELECT assay, n_pos, n_neg, abs(n_pos - n_neg) AS n_new, model, fp, seed::INT AS seed FROM counted, "
        f"(SELECT unnest({_list(GRIDS)}) AS model), (SELECT unnest({_list(WIDTHS)}) AS fp), "
        f"(SELECT unnest({list(REPEATS)}) AS seed)"
    )

    # aggregation
    by_source = _with(SCORES, _confusion("scores", "lang, source"))
    out["agg_confusion"] = by_source + "SELECT * FROM conf"
    for name, expr in RATIOS.items():
        out[f"agg_{name}"] = by_source + f"SELECT lang, source, round({expr}, 6) AS {name} FROM conf"
    out["agg_roc_auc"] = _with(SCORES, _auc("scores", "lang")) + (
        "SELECT lang, n_pos, n_neg, round(roc_auc, 6) AS roc_auc FROM auc"
    )
    per_fold = _with(SCORE_FOLDS, _confusion("folded", "lang, fold"), f"m AS (SELECT lang, {ALL_RATIOS} FROM conf)")
    for how, agg in (("mean", "avg"), ("median", "median")):
        out[f"agg_fold_{how}"] = per_fold + (
            "SELECT lang, " + ", ".join(f"round({agg}({m}), 6) AS {m}" for m in RATIOS) + " FROM m GROUP BY lang"
        )
    out["agg_class_counts"] = _with(HITS, counted) + "SELECT *, abs(n_pos - n_neg) AS n_new FROM counted"
    out["agg_reject_count"] = _with(DOCS, FAMILIES, REJECTS) + "SELECT fp, count(*) AS n_rejects FROM rejects GROUP BY fp"
    parted = """parted AS (SELECT f.* EXCLUDE (fold), f.fold, 'val' AS part FROM folded f UNION ALL
  SELECT f.* EXCLUDE (fold), g.fold::INT AS fold, 'train' AS part FROM folded f, (SELECT unnest(range(0, 5)) AS fold) g WHERE g.fold <> f.fold)"""
    out["agg_train_val_metrics"] = _with(
        SCORE_FOLDS, parted, _confusion("parted", "lang, fold, part"), f"m AS (SELECT lang, part, {ALL_RATIOS} FROM conf)"
    ) + "SELECT lang, " + ", ".join(
        f"round(avg({m}) FILTER (part = '{p}'), 6) AS {p}_{m}" for p in ("train", "val") for m in RATIOS
    ) + " FROM m GROUP BY lang"
    out["agg_last_wins"] = (
        "SELECT doc_id AS row_id, 'quality' AS assay, (n_chars % 3 = 0)::INT AS prediction FROM documents "
        "UNION ALL SELECT doc_id, 'toxic', (n_chars % 7 = 0)::INT FROM documents"
    )
    out["pred_wide"] = (
        "SELECT doc_id AS row_id, text AS structure, (n_chars % 3 = 0)::INT AS quality, (n_chars % 7 = 0)::INT AS toxic FROM documents"
    )

    # selection, sets
    out["top_best_candidate"] = _with(
        SCORE_FOLDS, _confusion("folded", "lang, source, fold"),
        f"m AS (SELECT lang, substr(source, 4)::INT AS param_idx, avg({RATIOS['f1']}) AS s FROM conf GROUP BY ALL)",
    ) + "SELECT lang, param_idx, round(s, 6) AS best_score FROM m QUALIFY row_number() OVER (PARTITION BY lang ORDER BY s DESC, param_idx) = 1"
    out["set_union_synthetic"] = _with(*SMOTE_BITS) + (
        f"SELECT assay, row_id, hit, false AS is_synthetic, {_csv('b')} AS bits FROM x UNION ALL "
        f"SELECT assay, -draw - 1, hit, true, {_csv('b')} FROM made"
    )
    sizes = "sizes AS (SELECT assay, count(*) AS n_rows FROM hits GROUP BY assay)"
    out["set_distinct_candidates"] = _with(HITS, sizes, _grid("logistic")) + (
        'SELECT assay, penalty, round(1e0 / ("C"::DOUBLE * n_rows), 9) AS reg_param, min(param_idx)::INT AS param_idx, '
        "count(*) AS n_same FROM sizes, grid GROUP BY 1, 2, 3"
    )
    out["grd_expand"] = _with(HITS, sizes, _grid("dt")) + "SELECT * FROM sizes, grid"

    # scalar functions
    out["sc_model_key"] = "SELECT doc_id, source || '_best_model_' || lang || '_dt' AS model_key FROM documents"
    out["sc_time_seed"] = (
        "SELECT event_id, strftime(ts, '%H-%M-%S') AS clock, 2208988800::BIGINT - (hour(ts) * 3600 + minute(ts) * 60 + second(ts)) AS seed, "
        "NULL::BIGINT AS bad_seed FROM events"
    )
    out["sc_run_date"] = (
        "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS stamp, strftime(o_orderdate, '%Y-%m-%d') AS dashed FROM orders"
    )
    out["sc_linspace"] = (
        "SELECT doc_id, pos::INT AS pos, round(0e0 + pos::DOUBLE * (n_chars::DOUBLE - 0e0) / 9e0, 6) AS value "
        "FROM documents, (SELECT unnest(range(0, 10)) AS pos)"
    )
    out["sc_argmax"] = "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS place FROM embeddings"
    out["sc_one_hot"] = (
        "SELECT vec_id, array_to_string(list_transform(range(0, 10), lambda c: (label = c)::INT), ',') AS one_hot FROM embeddings"
    )
    out["sc_results_json"] = by_source + "SELECT * FROM conf"

    # sampling and balancing
    out["smp_train_test"] = _with(HITS, _holdout("hits", "assay", "42")) + "SELECT row_id, assay, split FROM split"
    h, m, s = (int(p) for p in RUN_CLOCK.split("-"))
    out["smp_time_seeded"] = _with(HITS, _holdout("hits", "assay", str(2208988800 - (h * 3600 + m * 60 + s)))) + (
        "SELECT row_id, assay, split FROM split"
    )
    out["smp_stratified_kfold"] = _with(HITS, SHUFFLED_FOLDS) + "SELECT row_id, assay, hit, fold FROM folded"
    out["smp_kfold_ordered"] = _with(HITS, _folds("hits", "row_id")) + "SELECT row_id, assay, hit, fold FROM folded"
    out["smp_stratified_split"] = _with(
        HITS, _ranked("ranked", "hits", "assay, hit", _shuffle("42")),
        f"alls AS (SELECT assay, count(*) AS n, {TEST_SIZE} AS t FROM hits GROUP BY assay)",
        """shares AS (SELECT assay, hit, any_value(t) AS t, floor(round(count(*)::DOUBLE * any_value(t) / any_value(n), 9)) AS base,
  round(count(*)::DOUBLE * any_value(t) / any_value(n), 9) AS share FROM hits JOIN alls USING (assay) GROUP BY assay, hit)""",
        """sized AS (SELECT assay, hit, base + (row_number() OVER (PARTITION BY assay ORDER BY share - base DESC, hit)
  <= t - sum(base) OVER (PARTITION BY assay))::INT AS size FROM shares)""",
    ) + "SELECT row_id, assay, hit, CASE WHEN r <= size THEN 'test' ELSE 'train' END AS split FROM ranked JOIN sized USING (assay, hit)"
    out["smp_repeated_holdout"] = _with(
        HITS, f"seeded AS (SELECT hits.*, seed::BIGINT AS seed FROM hits, (SELECT unnest({list(REPEATS)}) AS seed))",
        _ranked("ranked", "seeded", "assay, seed", _key("seed || ':' || row_id")),
    ) + f"SELECT row_id, assay, seed, CASE WHEN r <= {TEST_SIZE} THEN 'test' ELSE 'train' END AS split FROM ranked"
    out["smp_smote_bits"] = _with(*SMOTE_BITS) + f"SELECT assay, draw, base_id, neighbour_id, hit, {_csv('b')} AS bits FROM made"
    out["smp_smote_interpolate"] = _with(
        f"x AS (SELECT vec_id AS row_id, 'label0' AS assay, (label = 0)::INT AS hit, embedding AS e, {GRIDDED} AS g FROM embeddings)",
        SMALL, _pairs(SQUARED, "assay", "small"), DRAWS,
    ) + """SELECT draw, base_id, neighbour_id, round(gap, 6) AS gap, (i - 1)::INT AS pos,
  round(a.e[i]::DOUBLE + gap * (b.e[i]::DOUBLE - a.e[i]::DOUBLE), 5) AS value
  FROM chosen c JOIN small a ON a.row_id = base_id JOIN small b ON b.row_id = neighbour_id, (SELECT unnest(range(1, 65)) AS i)"""

    # fingerprints
    for name, family in (
        ("fp_dictionary", "MACCS"), ("fp_neighbourhood", "Morgan"), ("fp_paths", "RDKit"),
        ("fp_layered", "Layered"), ("fp_patterns", "Pattern"),
    ):
        out[name] = _fp_query(family)
    selects = " UNION ALL ".join(
        f"SELECT row_id, '{f}' AS fp, len(b)::INT AS n_bits, coalesce(list_sum(b), 0)::BIGINT AS bit_sum FROM ({_fp(f)[1]})" for f in WIDTHS
    )
    out["fp_all_families"] = _with(DOCS, GOOD, BITS, TOKENS, LAYER_VALUES, CHARS) + selects
    out["fp_pack"] = _with(DOCS, GOOD, BITS) + _words()

    # models
    out["cl_split_scan_gini"] = _scan_query(_gini)
    out["cl_split_scan_entropy"] = _scan_query(_entropy)
    root = "rows0 AS (SELECT assay, row_id, hit, b, 'root' AS node FROM x)"
    out["cl_tree_levelwise"] = _with(DOCS, GOOD, HITS, BITS, ALIGNED, root, _level(0), _level(1), "nodes2 AS (SELECT assay, node, count(*) AS n, sum(hit)::BIGINT AS n1 FROM rows2 GROUP BY ALL)") + (
        "SELECT assay, 0::INT AS depth, n0.node, n0.n, n0.n1, b.bit::INT AS bit FROM nodes0 n0 LEFT JOIN best0 b USING (assay, node) UNION ALL "
        "SELECT assay, 1::INT, n0.node, n0.n, n0.n1, b.bit::INT FROM nodes1 n0 LEFT JOIN best1 b USING (assay, node) UNION ALL "
        "SELECT assay, 2::INT, node, n, n1, NULL::INT FROM nodes2"
    )
    out["cl_pls_gram"] = _with(
        DOCS, GOOD, HITS, BITS, ALIGNED, "t AS (SELECT row_id, unnest(b) AS i FROM x WHERE assay = 'toxic')"
    ) + "SELECT a.i::INT AS i, c.i::INT AS j, count(*) AS n FROM t a JOIN t c ON a.row_id = c.row_id AND a.i <= c.i GROUP BY 1, 2"
    final = _final_tree(TREE["max_depth"])
    out["pred_class"] = _with(*final) + "SELECT assay, row_id, prediction FROM tested"
    out["pred_probability"] = _with(*final) + "SELECT assay, row_id, round(score, 6) AS probability FROM tested"
    out["fit_final_and_test"] = _with(*final, _confusion("tested", "assay"), _auc("tested", "assay")) + "SELECT assay, " + ", ".join(
        f"round({e}, 6) AS {m}" for m, e in RATIOS.items()
    ) + ", round(roc_auc, 6) AS roc_auc FROM conf JOIN auc USING (assay)"
    out["flagship"] = _with(
        DOCS, GOOD, HITS, BITS, ALIGNED, _holdout("x", "assay", "42"), "tr AS (SELECT * FROM split WHERE split = 'train')",
        _scan("assay", "tr", _gini),
        "best AS (SELECT * FROM scan QUALIFY row_number() OVER (PARTITION BY assay ORDER BY gain DESC, bit) = 1)",
        """scored AS (SELECT assay, k.bit, hit AS y, CASE WHEN list_contains(t.b, k.bit) THEN s1::DOUBLE / s ELSE (k.n1 - s1)::DOUBLE / (k.n - s) END AS score,
  (score >= greatest(s1::DOUBLE / s, (k.n1 - s1)::DOUBLE / (k.n - s)))::INT AS prediction FROM split t JOIN best k USING (assay) WHERE split = 'test')""",
        _confusion("scored", "assay, bit"), _auc("scored", "assay, bit"),
    ) + "SELECT assay, bit::INT AS bit, " + ", ".join(f"round({e}, 6) AS {m}" for m, e in RATIOS.items()) + (
        ", round(roc_auc, 6) AS roc_auc FROM conf JOIN auc USING (assay, bit)"
    )
    return out
