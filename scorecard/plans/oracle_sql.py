"""DuckDB SQL for every registered query (the correctness oracle).

Each statement reads the driver's pre-registered views and recomputes the
query from scratch with plain SQL, so a match checks the Spark plan
end to end.  Shared CTE chains are composed from the same fixed values
the fixtures use (rubric rows, raters).
"""

from __future__ import annotations

from collections import Counter

from ..sources import fixtures as fx


def r6(expr: str) -> str:
    """Same half-to-even 6-digit rounding as ``functions.numeric.round6``."""
    return f"(round_even(({expr}) * 1000000.0, 0) / 1000000.0)"


def r3(expr: str) -> str:
    return f"(round_even(({expr}) * 1000.0, 0) / 1000.0)"


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("'", "''") + "'"


def d_rubric_values() -> str:
    rows, dim_pos, q_pos = [], {}, Counter()
    counts = Counter(r[0] for r in fx.D_RUBRIC_ROWS)
    total = len(fx.D_RUBRIC_ROWS)
    for dim, label, question, pc, ex in fx.D_RUBRIC_ROWS:
        dim_pos.setdefault(dim, len(dim_pos) + 1)
        q_pos[dim] += 1
        rows.append("(" + ", ".join([
            _lit(fx.D_CONCEPT), "1", "1.0", _lit(dim), str(dim_pos[dim]),
            f"{counts[dim]}.0 / {total}.0", _lit(label), _lit(question), _lit(pc),
            _lit(ex if ex is not None else ""), str(q_pos[dim])]) + ")")
    cols = ("concept, concept_pos, concept_weight, dimension, dim_pos, dim_weight, "
            "question_label, question, positive_contribution, examples, q_pos")
    return (f"rubric_raw AS (SELECT * FROM (VALUES {', '.join(rows)}) AS t({cols})), "
            "rubric AS (SELECT concept, CAST(concept_pos AS BIGINT) AS concept_pos, "
            "CAST(concept_weight AS DOUBLE) AS concept_weight, dimension, "
            "CAST(dim_pos AS BIGINT) AS dim_pos, CAST(dim_weight AS DOUBLE) AS dim_weight, "
            "question_label, question, positive_contribution, examples, "
            "CAST(q_pos AS BIGINT) AS q_pos FROM rubric_raw)")


def d_raters_values() -> str:
    rows = ", ".join("(" + ", ".join([_lit(m), str(p), repr(k)]) + ")" for m, p, k in fx.D_RATERS)
    return (f"raters_raw AS (SELECT * FROM (VALUES {rows}) AS t(model, model_pos, k)), "
            "raters AS (SELECT model, CAST(model_pos AS BIGINT) AS model_pos, CAST(k AS DOUBLE) AS k FROM raters_raw)")


D_FEATURES = r"""feat AS (
  SELECT CAST(doc_id AS VARCHAR) AS label,
         CAST(length(text) AS DOUBLE) AS n,
         CAST(len(string_split_regex(regexp_replace(text, '\A[ \n\t]+|[ \n\t]+\z', '', 'g'), '[ \n\t]+')) AS DOUBLE) AS w,
         CAST(length(text) - length(translate(text, '.!?', '')) AS DOUBLE) AS st,
         CAST(length(text) - length(replace(text, chr(10), '')) AS DOUBLE) AS nl,
         CAST(length(text) - length(replace(text, ',', '')) AS DOUBLE) AS cm
  FROM documents)"""

D_LOGIT = """CASE question_label
    WHEN 'q_sent_len' THEN (CAST(12.0 AS DOUBLE) * k - w / greatest(st, CAST(1.0 AS DOUBLE))) / CAST(4.0 AS DOUBLE)
    WHEN 'q_commas' THEN (cm / greatest(st, CAST(1.0 AS DOUBLE)) - CAST(0.8 AS DOUBLE) * k) / CAST(0.4 AS DOUBLE)
    WHEN 'q_word_len' THEN (CAST(6.2 AS DOUBLE) * k - n / w) / CAST(0.8 AS DOUBLE)
    WHEN 'q_short' THEN (CAST(50.0 AS DOUBLE) * k - w) / CAST(25.0 AS DOUBLE)
    WHEN 'q_lines' THEN CAST(100.0 AS DOUBLE) * nl / w - CAST(2.0 AS DOUBLE) * k
    WHEN 'q_long' THEN (w - CAST(600.0 AS DOUBLE) * k) / CAST(200.0 AS DOUBLE) END"""


def _top(p: str) -> str:
    t = f"{{'token': 'True', 'logprob': ln({p})}}"
    f = f"{{'token': 'False', 'logprob': ln(CAST(1.0 AS DOUBLE) - {p})}}"
    return f"CASE WHEN {p} >= 0.5 THEN [{t}, {f}] ELSE [{f}, {t}] END"


def d_response_ctes(temperature: bool = False, failing: bool = False) -> str:
    """grid -> z -> p -> top_logprobs/error (the fixture D rule scorer; ``failing``: the
    one with failures and abstentions)."""
    def at(place) -> str:
        return f"CAST(label AS BIGINT) % {place[0]} = {place[1]}" if failing else "FALSE"
    temps = ""
    zexpr = "z0"
    if temperature:
        temps = ", temps AS (SELECT CAST(t AS DOUBLE) AS temperature FROM (VALUES (0.0), (0.5), (1.0)) AS v(t))"
        zexpr = "z0 / (CAST(0.5 AS DOUBLE) + temperature)"
    grid_from = "feat CROSS JOIN raters CROSS JOIN rubric" + (" CROSS JOIN temps" if temperature else "")
    return f"""{d_rubric_values()}, {d_raters_values()}, {D_FEATURES}{temps},
grid AS (SELECT * FROM {grid_from}),
zz AS (SELECT *, {D_LOGIT} AS z0 FROM grid),
pp AS (SELECT *, CAST(1.0 AS DOUBLE) / (CAST(1.0 AS DOUBLE) + exp(-greatest(least({zexpr}, CAST(10.0 AS DOUBLE)), CAST(-10.0 AS DOUBLE)))) AS p FROM zz),
er AS (SELECT *, CASE WHEN model = 'strict' AND {at(fx.FAILS_AT)} THEN '{fx.FAILURE}' END AS error FROM pp),
resp AS (SELECT *, CASE WHEN error IS NOT NULL THEN NULL
                        WHEN {at(fx.ABSTAINS_AT)} THEN [{{'token': 'Maybe', 'logprob': ln(CAST(0.9 AS DOUBLE))}}]
                        ELSE {_top('p')} END AS top_logprobs FROM er)"""


SCAN = """scan AS (SELECT *, list_filter(top_logprobs, lambda x: lower(x.token) =
      CASE WHEN positive_contribution THEN 'true' WHEN NOT positive_contribution THEN 'false' END)[1] AS m
    FROM {src})"""

ANSWER_COLS = f"""coalesce(m.token, lower(top_logprobs[-1].token)) AS answer,
  CASE WHEN positive_contribution THEN {r3('exp(m.logprob)')}
       WHEN NOT positive_contribution THEN CAST(1.0 AS DOUBLE) - {r3('exp(m.logprob)')} END AS score,
  m.logprob AS logprob, m IS NOT NULL AS matched"""


def d_question_ctes(failing: bool = False) -> str:
    return (d_response_ctes(failing=failing) + ",\n" + SCAN.format(src="resp") +
            f""",
qs AS (SELECT label, model, model_pos, concept, concept_pos, concept_weight, dimension, dim_pos,
              dim_weight, question_label, question, q_pos, positive_contribution, examples,
              {ANSWER_COLS}, error FROM scan)""")


def rollup_ctes(src: str = "qs", weighted: bool = False, prefix: str = "") -> str:
    """Staged means of rounded children (RU1-RU4) over question rows ``src``."""
    if weighted:
        cmean = ("sum(score * weight) / nullif(sum(CASE WHEN score IS NOT NULL THEN weight END), 0)")
    else:
        cmean = "avg(score)"
    p = prefix
    return f"""{p}ds AS (SELECT label, model, concept, dimension, {r3('avg(score)')} AS score,
      min(model_pos) AS model_pos, min(concept_pos) AS concept_pos, min(dim_pos) AS dim_pos,
      coalesce(min(dim_weight), 1.0) AS weight, min(concept_weight) AS concept_weight,
      bool_or(error IS NOT NULL) AS failed
    FROM {src} GROUP BY label, model, concept, dimension),
{p}cs AS (SELECT label, model, concept, {r3(cmean)} AS score, min(model_pos) AS model_pos,
      min(concept_pos) AS concept_pos, coalesce(min(concept_weight), 1.0) AS weight, bool_or(failed) AS failed
    FROM {p}ds GROUP BY label, model, concept),
{p}ms AS (SELECT label, model, CASE WHEN NOT bool_or(failed) THEN {r3('avg(score)')} END AS score,
      min(model_pos) AS model_pos, CASE WHEN bool_or(failed) THEN 'error' ELSE 'ok' END AS status
    FROM {p}cs GROUP BY label, model),
{p}ts AS (SELECT label, {r3("avg(CASE WHEN status = 'ok' THEN score END)")} AS score,
      count(CASE WHEN status = 'ok' THEN score END) AS n_models FROM {p}ms GROUP BY label)"""


def d_with(*tail: str, failing: bool = False) -> str:
    return "WITH " + ",\n".join([d_question_ctes(failing), *tail])


HUMAN_CTES = """hr AS (SELECT CAST(l.doc_id AS VARCHAR) AS sheet, q.question_label AS label,
      CAST(CASE WHEN q.positive_contribution THEN 1 + 4 * l.quality ELSE 1 + 4 * l.toxic END AS INTEGER) AS score
    FROM labels l CROSS JOIN rubric q),
hgrid AS (SELECT CAST(d.doc_id AS VARCHAR) AS label, 'human' AS model, CAST(1 AS BIGINT) AS model_pos, q.*
    FROM documents d CROSS JOIN rubric q),
hq0 AS (SELECT g.*, hr.score AS rating,
      CASE WHEN g.positive_contribution THEN (CAST(hr.score AS DOUBLE) - 1.0) / 4.0
           WHEN NOT g.positive_contribution THEN 1.0 - (CAST(hr.score AS DOUBLE) - 1.0) / 4.0 END AS score
    FROM hgrid g LEFT JOIN hr ON hr.sheet = g.label AND hr.label = g.question_label),
hq AS (SELECT label, model, model_pos, concept, concept_pos, concept_weight, dimension, dim_pos, dim_weight,
      question_label, question, q_pos, positive_contribution, examples,
      CASE WHEN positive_contribution THEN 'True' WHEN NOT positive_contribution THEN 'False' END AS answer,
      score, ln(score + 1e-9) AS logprob, rating IS NOT NULL AS matched, rating,
      CAST(NULL AS VARCHAR) AS error FROM hq0)"""

P_FLAT = """flat AS (SELECT p_partkey AS ord, p_brand AS Dimension, CAST(p_partkey AS VARCHAR) AS Label,
      p_name AS Question, (p_size % 2 = 0) AS positive_contribution,
      CASE WHEN p_size >= 10 THEN p_type END AS Examples FROM part)"""

P_LONG = P_FLAT + """,
dims AS (SELECT Dimension, min(ord) AS dim_ord, count(*) AS nq FROM flat GROUP BY Dimension),
dimpos AS (SELECT Dimension, dim_ord, nq, CAST(row_number() OVER (ORDER BY dim_ord) AS BIGINT) AS dim_pos FROM dims),
lr AS (SELECT 'parts' AS concept, CAST(1 AS BIGINT) AS concept_pos, CAST(1.0 AS DOUBLE) AS concept_weight,
      f.Dimension AS dimension, d.dim_pos, CAST(d.nq AS DOUBLE) / (SELECT count(*) FROM flat) AS dim_weight,
      f.Label AS question_label, f.Question AS question, f.positive_contribution,
      coalesce(f.Examples, '') AS examples,
      CAST(row_number() OVER (PARTITION BY f.Dimension ORDER BY f.ord) AS BIGINT) AS q_pos
    FROM flat f JOIN dimpos d ON f.Dimension = d.Dimension)"""

H_VALID = r"""raw AS (SELECT CAST(user_id AS VARCHAR) AS sheet, event_type AS label, event_id AS ord,
      CASE WHEN value < 1.0 THEN '' WHEN value < 2.0 THEN 'n/a'
           ELSE CAST(CAST(floor(value) AS BIGINT) % 7 AS VARCHAR) END AS score_text FROM events),
cls AS (SELECT *, CASE WHEN regexp_full_match(score_text, '\s*[+-]?[0-9]+\s*') THEN TRY_CAST(score_text AS INTEGER) END AS sc,
      CASE WHEN ord % 31 = 5 THEN 'short_row' WHEN label = '' OR score_text = '' THEN 'empty_cell'
           WHEN NOT regexp_full_match(score_text, '\s*[+-]?[0-9]+\s*') OR TRY_CAST(score_text AS INTEGER) IS NULL THEN 'bad_cast' END AS reason
    FROM raw)"""


def oracles() -> dict[str, str]:
    o: dict[str, str] = {}
    # ---- phase 1: D pipeline
    o["texts"] = "SELECT CAST(doc_id AS VARCHAR) AS label, text AS input_text FROM documents"
    o["eval_grid"] = ("WITH " + d_rubric_values() + ", " + d_raters_values() +
                      " SELECT CAST(d.doc_id AS VARCHAR) AS label, r.model, q.concept, q.dimension, "
                      "q.question_label FROM documents d CROSS JOIN raters r CROSS JOIN rubric q")
    o["question_scores"] = "WITH " + d_question_ctes() + f"""
SELECT label, model, concept, dimension, question_label, question, positive_contribution, answer,
       score, {r6('logprob')} AS logprob, matched, error FROM qs"""
    o["dimension_scores"] = d_with(rollup_ctes()) + \
        f" SELECT label, model, concept, dimension, score, {r6('weight')} AS weight FROM ds"
    o["concept_scores"] = d_with(rollup_ctes()) + " SELECT label, model, concept, score FROM cs"
    o["model_scores"] = d_with(rollup_ctes()) + " SELECT label, model, score, status FROM ms"
    o["text_scores"] = d_with(rollup_ctes()) + " SELECT label, score, n_models FROM ts"
    o["concept_scores_weighted"] = d_with(rollup_ctes(weighted=True)) + \
        " SELECT label, model, concept, score FROM cs"
    # ---- phase 2: rubric (fixture P)
    o["rubric_questions"] = "WITH " + P_FLAT + """
SELECT Dimension AS dimension, CAST(row_number() OVER (PARTITION BY Dimension ORDER BY ord) AS BIGINT) AS q_pos,
       Label AS label, Question AS question, positive_contribution, coalesce(Examples, '') AS examples FROM flat"""
    o["rubric_dimensions"] = "WITH " + P_FLAT + """
SELECT Dimension AS dimension, min(ord) AS dim_ord,
       CAST(row_number() OVER (ORDER BY min(ord)) AS BIGINT) AS dim_pos FROM flat GROUP BY Dimension"""
    o["rubric_weights"] = "WITH " + P_FLAT + """
SELECT Dimension AS dimension, count(*) AS n_questions,
       CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM flat) AS weight,
       arg_min(Label, ord) AS first_label FROM flat GROUP BY Dimension"""
    o["rubric_concept"] = "WITH " + P_FLAT + """,
dims AS (SELECT Dimension, min(ord) AS dim_ord FROM flat GROUP BY Dimension)
SELECT 'parts' AS concept_description, CAST(count(*) AS BIGINT) AS n_dimensions,
       string_agg(Dimension, '|' ORDER BY dim_ord) AS dimensions, CAST(1.0 AS DOUBLE) AS weight FROM dims"""
    o["rubric_roundtrip"] = "WITH " + P_LONG + """
SELECT concept, concept_pos, concept_weight, dimension, dim_pos, dim_weight, question_label, question,
       positive_contribution, examples, q_pos FROM lr"""
    o["rubric_documents"] = o["rubric_positions"] = """
WITH flat AS (
  SELECT p_partkey AS ord, CAST(floor(p_partkey / 200) AS BIGINT) AS rubric, p_brand AS dimension,
         CAST(p_partkey AS VARCHAR) AS question_label, p_name AS question, p_size % 2 = 0 AS positive_contribution,
         CASE WHEN p_size >= 10 THEN p_type ELSE '' END AS examples FROM part),
dims AS (
  SELECT rubric, dimension, count(*) AS n_q,
         row_number() OVER (PARTITION BY rubric ORDER BY min(ord)) AS dim_pos FROM flat GROUP BY rubric, dimension),
totals AS (SELECT rubric, count(*) AS n FROM flat GROUP BY rubric)
SELECT f.rubric, 'parts' AS concept, CAST(1 AS BIGINT) AS concept_pos, CAST(1.0 AS DOUBLE) AS concept_weight,
       f.dimension, d.dim_pos, CAST(d.n_q AS DOUBLE) / CAST(t.n AS DOUBLE) AS dim_weight, f.question_label, f.question,
       f.positive_contribution, f.examples,
       row_number() OVER (PARTITION BY f.rubric, f.dimension ORDER BY f.ord) AS q_pos
FROM flat f JOIN dims d ON d.rubric = f.rubric AND d.dimension IS NOT DISTINCT FROM f.dimension
JOIN totals t ON t.rubric = f.rubric"""
    # ---- phase 3: human ratings
    o["human_scores_dedup"] = "WITH " + H_VALID + """
SELECT sheet, label, arg_max(sc, ord) AS score FROM cls WHERE reason IS NULL GROUP BY sheet, label"""
    hwith = "WITH " + d_rubric_values() + ",\n" + HUMAN_CTES
    o["human_question_scores"] = hwith + f"""
SELECT label, model, concept, dimension, question_label, answer, score, {r6('logprob')} AS logprob, rating FROM hq"""
    o["human_rollup"] = hwith + ",\n" + rollup_ctes("hq") + " SELECT label, model, score, status FROM ms"
    return o


# ---------------------------------------------------------------- phase 4
def gmean(x: str = "score", digits: int = 3) -> str:
    f = 10 ** digits
    return (f"(CAST(sum(CAST(round_even(({x}) * {float(f)}, 0) AS BIGINT)) AS DOUBLE) / "
            f"CAST(count({x}) * {f} AS DOUBLE))")


def flat_union(p: str = "", q: str = "qs") -> str:
    n = "CAST(NULL AS VARCHAR)"
    return f"""SELECT label, model, 'TEXT' AS concept, {n} AS dimension, {n} AS question, score, 'model' AS level FROM {p}ms
UNION ALL SELECT label, model, concept, {n}, {n}, score, 'concept' FROM {p}cs
UNION ALL SELECT label, model, concept, dimension, {n}, score, 'dimension' FROM {p}ds
UNION ALL SELECT label, model, concept, dimension, question_label, score, 'question' FROM {q}"""


def d_and_human_with(failing: bool = False) -> str:
    return ("WITH " + d_question_ctes(failing) + ",\n" + rollup_ctes("qs") + ",\n" + HUMAN_CTES + ",\n" +
            rollup_ctes("hq", prefix="h_"))


E_CTES = f"""e_raw AS (SELECT event_id, CAST(user_id AS VARCHAR) AS label, event_type AS model, 'EV' AS concept,
      'd' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 AS VARCHAR) AS dimension,
      'k' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) AS VARCHAR) AS question,
      value / 500.0 AS score FROM events),
e AS (SELECT label, model, concept, dimension, question, {gmean('score', 6)} AS score
    FROM e_raw GROUP BY label, model, concept, dimension, question),
e_agg AS (SELECT label, concept, dimension, question, {gmean('score', 6)} AS score FROM e
    WHERE model IN ('click', 'error', 'signup', 'view') GROUP BY label, concept, dimension, question),
e_all AS (SELECT label, concept, dimension, question, model, score FROM e
    UNION ALL SELECT label, concept, dimension, question, 'aggregate_models', score FROM e_agg),
ref AS (SELECT label, concept, dimension, question, score AS ref_score FROM e_all
    WHERE model = 'purchase' AND score IS NOT NULL),
pairs AS (SELECT o.label, o.concept, o.dimension, o.question, o.model, o.score, r.ref_score
    FROM e_all o JOIN ref r ON o.label = r.label AND o.concept = r.concept AND o.dimension = r.dimension
     AND o.question = r.question WHERE o.model <> 'purchase' AND o.score IS NOT NULL),
diffs AS (SELECT label, concept, dimension, question, model, abs(score - ref_score) AS diff FROM pairs),
outl AS (SELECT c.label, c.concept, c.dimension, c.question, s.max_diff, s.mean_diff, s.avg_diff_excl
    FROM (SELECT DISTINCT label, concept, dimension, question FROM e_all) c LEFT JOIN
    (SELECT label, concept, dimension, question, max(diff) AS max_diff, {gmean('diff', 9)} AS mean_diff,
            {gmean("CASE WHEN model <> 'view' THEN diff END", 9)} AS avg_diff_excl
     FROM diffs GROUP BY label, concept, dimension, question) s
    ON c.label = s.label AND c.concept = s.concept AND c.dimension = s.dimension AND c.question = s.question)"""

E_RATERS = ["click", "error", "signup", "view", "aggregate_models"]


def spearman_sql(group: list[str]) -> str:
    g = ", ".join(group)
    return f"""rk AS (SELECT {g}, score, ref_score,
      rank() OVER (PARTITION BY {g} ORDER BY score) + (count(*) OVER (PARTITION BY {g}, score) - 1) / 2.0 AS r1,
      rank() OVER (PARTITION BY {g} ORDER BY ref_score) + (count(*) OVER (PARTITION BY {g}, ref_score) - 1) / 2.0 AS r2
    FROM pairs),
st AS (SELECT {g}, covar_pop(r1, r2) / nullif(stddev_pop(r1) * stddev_pop(r2), 0) AS rho, count(*) AS n_pairs
    FROM rk GROUP BY {g})"""


L_CTE = """l AS (SELECT CAST(year(l_shipdate) AS VARCHAR) AS text_key, l_returnflag AS model,
      l_linestatus AS concept, CAST(l_linenumber AS VARCHAR) AS dimension,
      CAST(l_suppkey % 10 AS VARCHAR) AS question, l_discount * 10.0 AS score FROM lineitem)"""


def l_avg(keys: str, where: str = "") -> str:
    w = f" WHERE {where}" if where else ""
    return f"SELECT {keys}, {gmean()} AS score FROM l{w} GROUP BY {keys}"


def l_pivot(src: str, index: str) -> str:
    cols = ", ".join(f"max(score) FILTER (WHERE text_key = '{y}') AS \"{y}\"" for y in fx.L_YEARS)
    return f"SELECT {index}, {cols} FROM {src} GROUP BY {index}"


def more_oracles(o: dict[str, str]) -> None:
    fw = d_with(rollup_ctes())
    o["flat_scores"] = fw + "\n" + flat_union()
    o["nested_roundtrip"] = o["flat_scores"]
    both = d_and_human_with()
    six = "label, model, concept, dimension, question, score"
    o["flat_export"] = (both + f"\nSELECT {six} FROM ({flat_union('h_', 'hq')}) "
                        f"UNION ALL SELECT {six} FROM ({flat_union()})")
    o["flat_scan"] = o["flat_export"]
    o["eval_rows"] = fw + f"\nSELECT label, model, concept, dimension, question, score, {r6('logprob')} AS logprob FROM qs"
    o["eval_union"] = both + f"""
SELECT 'model_eval' AS text_key, label, model, concept, dimension, question, score, {r6('logprob')} AS logprob FROM qs
UNION ALL SELECT 'human_eval', label, model, concept, dimension, question, score, {r6('logprob')} FROM hq"""
    o["compare_sources"] = "WITH " + E_CTES + f"""
SELECT label, model, concept, dimension, question,
  {r6("avg(score) FILTER (WHERE event_id % 2 = 0)")} AS file1,
  {r6("avg(score) FILTER (WHERE event_id % 2 = 1)")} AS file2,
  {r6("avg(score) FILTER (WHERE event_id % 2 = 1) - avg(score) FILTER (WHERE event_id % 2 = 0)")} AS difference
FROM e_raw WHERE score IS NOT NULL GROUP BY label, model, concept, dimension, question"""
    # ---- phase 5: analysis on L
    lw = "WITH " + L_CTE + "\n"
    o["avg_question"] = lw + l_avg("concept, dimension, question, text_key")
    o["avg_dimension"] = lw + l_avg("concept, dimension, text_key")
    o["avg_concept"] = lw + l_avg("concept, text_key")
    o["cross_model"] = lw + l_avg("text_key, concept, dimension")
    cm = "WITH " + L_CTE + ", cm AS (" + l_avg("text_key, concept, dimension") + ")\n"
    o["overall_by_text"] = cm + f"SELECT text_key, {r6('avg(score)')} AS score FROM cm GROUP BY text_key"
    o["dim_by_text"] = cm + f"SELECT dimension, text_key, {r6('avg(score)')} AS score FROM cm GROUP BY dimension, text_key"
    o["dim_by_model"] = lw + l_avg("concept, dimension, text_key", "model = 'R'")
    o["filter_dimension"] = lw + l_avg("concept, dimension, question, text_key", "dimension = '3'")
    o["filter_threshold"] = lw + l_avg("concept, dimension, question, text_key", "score >= 0.5")
    o["filter_models"] = lw + ("SELECT text_key, model, concept, dimension, question, score FROM l "
                               "WHERE model IN ('A', 'R') AND concept = 'F'")
    o["distinct_options"] = lw + " UNION ALL ".join(
        f"SELECT DISTINCT '{c}' AS kind, CAST({c} AS VARCHAR) AS value FROM l"
        for c in ["model", "concept", "text_key", "dimension"])
    o["pivot_dimension"] = (cm + f", dt AS (SELECT dimension, text_key, {r6('avg(score)')} AS score "
                            "FROM cm GROUP BY dimension, text_key)\n" + l_pivot("dt", "dimension"))
    aq = ("WITH " + L_CTE + ", aq AS (" + l_avg("concept, dimension, question, text_key") + ")\n")
    index = "concept, dimension, question"
    o["pivot_question"] = aq + l_pivot("aq", index)
    o["question_ranking"] = (aq + ", pv AS (" + l_pivot("aq", index) + "),\n"
                             f"ra AS (SELECT {index}, avg(score) AS a FROM aq GROUP BY {index})\n"
                             "SELECT pv.*, CAST(row_number() OVER (ORDER BY " + r6("ra.a") +
                             f" DESC NULLS LAST, {index}) AS BIGINT) AS position "
                             f"FROM pv LEFT JOIN ra USING ({index})")
    # ---- phase 6: agreement on E
    ew = "WITH " + E_CTES
    models = ["click", "error", "purchase", "signup", "view", "aggregate_models"]
    o["wide_by_model"] = ew + "\nSELECT label, concept, dimension, question, " + ", ".join(
        f"max(score) FILTER (WHERE model = '{m}') AS {m}" for m in models) + \
        " FROM e_all GROUP BY label, concept, dimension, question"
    o["aggregate_models"] = ew + """
SELECT k.label, k.concept, k.dimension, k.question, a.score AS aggregate_models
FROM (SELECT DISTINCT label, concept, dimension, question FROM e) k LEFT JOIN e_agg a
  ON k.label = a.label AND k.concept = a.concept AND k.dimension = a.dimension AND k.question = a.question"""
    o["spearman_overall"] = ew + ",\n" + spearman_sql(["model"]) + f"""
SELECT m.model, {r6('st.rho')} AS spearman_r, st.n_pairs
FROM (SELECT DISTINCT model FROM e_all WHERE model <> 'purchase') m LEFT JOIN st ON m.model = st.model"""
    o["spearman_by_dimension"] = (ew.replace("pairs AS (SELECT", "pairs_all AS (SELECT") +
                                  ",\npairs AS (SELECT * FROM pairs_all WHERE model <> 'aggregate_models'),\n" +
                                  spearman_sql(["dimension", "model"]) + f"""
SELECT p.dimension, p.model, {r6('st.rho')} AS spearman_r, st.n_pairs
FROM (SELECT DISTINCT dimension, model FROM e WHERE model <> 'purchase' AND score IS NOT NULL) p
LEFT JOIN st ON p.dimension = st.dimension AND p.model = st.model""")
    o["abs_diff"] = ew + f"\nSELECT label, concept, dimension, question, model, {r6('diff')} AS diff FROM diffs"
    o["outlier_scores"] = ew + f"""
SELECT label, concept, dimension, question, {r6('max_diff')} AS max_diff, {r6('mean_diff')} AS mean_diff,
       {r6('avg_diff_excl')} AS avg_diff_excl FROM outl"""
    dcols = ", ".join(f"{r6(f'max(diff) FILTER (WHERE d.model = {_lit(r)})')} AS diff_{r}" for r in E_RATERS)
    o["outliers_top"] = ew + f""",
top AS (SELECT * FROM outl ORDER BY max_diff DESC NULLS LAST, label, concept, dimension, question LIMIT 20)
SELECT t.label, t.concept, t.dimension, t.question, {dcols},
       {r6('min(t.max_diff)')} AS max_diff, {r6('min(t.mean_diff)')} AS mean_diff
FROM top t LEFT JOIN diffs d ON t.label = d.label AND t.concept = d.concept AND t.dimension = d.dimension
  AND t.question = d.question GROUP BY t.label, t.concept, t.dimension, t.question"""
    o["outliers_full"] = o["outliers_top"].replace(" LIMIT 20)", ")")
    acols = ", ".join(f"{gmean(f'CASE WHEN model = {_lit(r)} THEN diff END', 9)} AS avg_diff_{r}"
                      for r in E_RATERS)
    ebd = (f""",
pr AS (SELECT dimension, {acols} FROM diffs GROUP BY dimension),
sm AS (SELECT dimension, {gmean('mean_diff', 9)} AS avg_mean_diff, {gmean('max_diff', 9)} AS avg_max_diff,
       {gmean('avg_diff_excl', 9)} AS avg_avg_diff_excl FROM outl GROUP BY dimension),
ebd AS (SELECT sm.*, {', '.join(f'pr.avg_diff_{r}' for r in E_RATERS)} FROM sm LEFT JOIN pr ON sm.dimension = pr.dimension)""")
    rcols = ["avg_mean_diff", "avg_max_diff", "avg_avg_diff_excl"] + [f"avg_diff_{r}" for r in E_RATERS]
    o["error_by_dimension"] = ew + ebd + "\nSELECT dimension, " + ", ".join(
        f"{r6(c)} AS {c}" for c in rcols) + " FROM ebd"
    strict = ("CASE WHEN count(*) FILTER (WHERE {c} IS NULL) = 0 THEN "
              "CAST(sum(CAST(round_even({c} * 1000000000.0, 0) AS BIGINT)) AS DOUBLE) / 1000000000.0 END")
    o["error_totals"] = ew + ebd + "\nSELECT " + \
        f"{r6(strict.format(c='avg_avg_diff_excl'))} AS total_avg_diff_excl, " + \
        f"{r6(strict.format(c='avg_mean_diff'))} AS total_mean_diff FROM ebd"


_base_oracles = oracles


def oracles() -> dict[str, str]:  # noqa: F811 - extends the phase 1-3 set
    o = _base_oracles()
    more_oracles(o)
    return o


# ---------------------------------------------------------------- phase 7-8
def _models_values() -> str:
    return "(VALUES " + ", ".join(f"({_lit(m)})" for m in fx.D_MODELS) + ") AS pm(model)"


def profile_ctes() -> str:
    models = ", ".join(_lit(m) for m in fx.D_MODELS)
    return f""",
flat AS ({flat_union()}),
pf AS (SELECT * FROM flat WHERE concept = {_lit(fx.D_CONCEPT)} AND model IN ({models})),
pdims AS (SELECT DISTINCT label, dimension FROM pf WHERE dimension IS NOT NULL AND dimension <> ''),
pord AS (SELECT DISTINCT dimension, dim_pos FROM rubric),
pgrid AS (SELECT d.label, d.dimension, o.dim_pos, pm.model FROM pdims d LEFT JOIN pord o ON d.dimension = o.dimension
          CROSS JOIN {_models_values()}),
psc AS (SELECT label, model, dimension, score FROM pf WHERE level = 'dimension'),
prof AS (SELECT g.label, g.model, g.dimension, g.dim_pos, coalesce(s.score, CAST(0.0 AS DOUBLE)) AS score
         FROM pgrid g LEFT JOIN psc s ON g.label = s.label AND g.model = s.model AND g.dimension = s.dimension)"""


def band_sql(score: str = "score") -> str:
    return (f"CASE WHEN {score} IS NULL THEN 'dim' WHEN {score} < 0.4 THEN 'red' "
            f"WHEN {score} < 0.7 THEN 'yellow' ELSE 'green' END")


def _pad(c: str) -> str:
    return f"lpad(CAST({c} AS VARCHAR), 19, '0')"


def report_sql() -> str:
    n = "CAST(NULL AS VARCHAR)"
    cp = "dense_rank() OVER (PARTITION BY label, model ORDER BY concept_pos)"
    dp = "dense_rank() OVER (PARTITION BY label, model, concept ORDER BY dim_pos)"
    qp = "row_number() OVER (PARTITION BY label, model, concept, dimension ORDER BY q_pos)"
    return f"""SELECT *, {band_sql()} AS band FROM (
SELECT CAST(doc_id AS VARCHAR) AS label, '000' AS sort_path, CAST(0 AS BIGINT) AS depth, 'text' AS kind,
       {n} AS name, CAST(NULL AS DOUBLE) AS score, {n} AS answer, 'Input Text: ' || coalesce(text, '') AS line
  FROM documents
UNION ALL SELECT label, {_pad('model_pos')}, CAST(0 AS BIGINT), 'model', model, score, {n}, 'Model: ' || model FROM ms
UNION ALL SELECT label, {_pad('model_pos')} || '.' || {_pad(cp)}, CAST(1 AS BIGINT), 'concept', concept,
       score, {n}, chr(9) || 'Concept: ' || concept FROM cs
UNION ALL SELECT label, {_pad('model_pos')} || '.' || {_pad(cp)} || '.' || {_pad(dp)},
       CAST(2 AS BIGINT), 'dimension', dimension, score, {n}, chr(9) || chr(9) || 'Dimension: ' || dimension FROM ds
UNION ALL SELECT label, {_pad('model_pos')} || '.' || {_pad(cp)} || '.' || {_pad(dp)} || '.' ||
       {_pad(qp)}, CAST(3 AS BIGINT), 'question', question, score, answer,
       chr(9) || chr(9) || chr(9) || 'Question: ' || question FROM qs)"""


def render_sql(template: str, cols: dict[str, str]) -> str:
    from ..operators.grid import template_parts
    parts = []
    for kind, val in template_parts(template):
        parts.append(_lit(val) if kind == "lit" else f"coalesce(CAST({cols[val]} AS VARCHAR), '')")
    return "concat(" + ", ".join(parts) + ")"


def _key_part(expr: str) -> str:
    return f"coalesce(CAST(length(CAST({expr} AS VARCHAR)) AS VARCHAR) || ':' || CAST({expr} AS VARCHAR), '-')"


KEYED = """th AS (SELECT CAST(doc_id AS VARCHAR) AS label, sha256(text) AS text_hash FROM documents),
keyed AS (SELECT r.*, sha256(""" + " || ".join(_key_part(p) for p in (
    "r.model", "'{pv}'", "r.concept", "r.dimension", "r.question_label", "r.question", "r.examples",
    "r.positive_contribution", "NULL", "th.text_hash")) + """) AS cache_key FROM resp r JOIN th ON r.label = th.label),
cache AS (SELECT cache_key, min(top_logprobs) AS top_logprobs, min(error) AS error FROM keyed
          WHERE CAST(label AS BIGINT) % 3 = 0 GROUP BY cache_key)"""


def token_sql(n: int, extra: str = "") -> str:
    return f"""SELECT label, model, question_label{extra}, CAST(i AS BIGINT) AS rank, top_logprobs[i].token AS token,
       {r6('top_logprobs[i].logprob')} AS logprob,
       round_even(exp(top_logprobs[i].logprob) * 100.0 * 100.0, 0) / 100.0 AS probability_pct
FROM (SELECT *, unnest(generate_series(1, len(top_logprobs))) AS i FROM resp WHERE top_logprobs IS NOT NULL)
WHERE i <= {n}"""


def phase78_oracles(o: dict[str, str]) -> None:
    from ..operators.grid import QUESTION_PROMPT_TEMPLATE, SYSTEM_PROMPT_TEMPLATE
    fw = d_with(rollup_ctes())
    o["profile"] = o["profile_of_flat"] = fw + profile_ctes() + "\nSELECT label, model, dimension, dim_pos, score FROM prof"
    o["profile_polar"] = fw + profile_ctes() + f""",
pn AS (SELECT *, row_number() OVER (PARTITION BY label, model ORDER BY dim_pos) - 1 AS i,
       count(*) OVER (PARTITION BY label, model) AS n FROM prof),
pts AS (SELECT label, model, i + 1 AS point, dimension, 2.0 * pi() * i / n AS angle, score FROM pn WHERE n >= 3
        UNION ALL SELECT label, model, n + 1, dimension, 2.0 * pi() * 0 / n, score FROM pn WHERE i = 0 AND n >= 3)
SELECT label, model, CAST(point AS BIGINT) AS point, dimension, {r6('angle')} AS angle, score FROM pts"""
    o["score_bands"] = fw + f"\nSELECT *, {band_sql()} AS band FROM ({flat_union()})"
    o["report_lines"] = fw + "\n" + report_sql()
    o["quality_report"] = d_and_human_with(failing=True) + ",\n" + H_VALID + ",\n" + E_CTES + """
SELECT 'sheet_short_row' AS reason, count(*) AS n FROM cls WHERE reason = 'short_row'
UNION ALL SELECT 'sheet_empty_cell', count(*) FROM cls WHERE reason = 'empty_cell'
UNION ALL SELECT 'sheet_bad_cast', count(*) FROM cls WHERE reason = 'bad_cast'
UNION ALL SELECT 'sheet_superseded', CAST(coalesce(sum(c - 1), 0) AS BIGINT)
  FROM (SELECT count(*) AS c FROM cls WHERE reason IS NULL GROUP BY sheet, label)
UNION ALL SELECT 'rating_out_of_range', count(*)
  FROM (SELECT arg_max(sc, ord) AS s FROM cls WHERE reason IS NULL GROUP BY sheet, label) WHERE s < 1 OR s > 5
UNION ALL SELECT 'missing_rating', count(*) FROM hq WHERE NOT matched
UNION ALL SELECT 'no_answer_match', count(*) FROM qs WHERE error IS NULL AND NOT matched
UNION ALL SELECT 'scorer_error', count(*) FROM qs WHERE error IS NOT NULL
UNION ALL SELECT 'duplicate_cell', CAST(coalesce(sum(c - 1), 0) AS BIGINT)
  FROM (SELECT count(*) AS c FROM e_raw GROUP BY label, model, concept, dimension, question)"""
    keyed = "WITH " + d_response_ctes() + ",\n" + KEYED.format(pv=fx.PROMPT_VERSION)
    o["cache_missing"] = keyed + """
SELECT k.label, k.model, k.question_label, k.cache_key FROM keyed k
WHERE NOT EXISTS (SELECT 1 FROM cache c WHERE c.cache_key = k.cache_key)"""
    o["cache_lookup"] = keyed + """,
lk AS (SELECT k.label, k.model, k.question_label, k.positive_contribution, c.top_logprobs,
       c.cache_key IS NOT NULL AS cached FROM keyed k LEFT JOIN cache c ON k.cache_key = c.cache_key),
""" + SCAN.format(src="lk") + f"""
SELECT label, model, question_label, cached,
  CASE WHEN positive_contribution THEN {r3('exp(m.logprob)')}
       WHEN NOT positive_contribution THEN CAST(1.0 AS DOUBLE) - {r3('exp(m.logprob)')} END AS cached_score
FROM scan"""
    o["token_probabilities"] = "WITH " + d_response_ctes() + "\n" + token_sql(5)
    o["token_sweep"] = "WITH " + d_response_ctes(temperature=True) + "\n" + token_sql(3, ", temperature")
    cols = {"concept": "q.concept", "dimension": "q.dimension", "question": "q.question",
            "examples": "q.examples", "input_text": "d.text"}
    o["prompt_render"] = ("WITH " + d_rubric_values() + "\nSELECT CAST(d.doc_id AS VARCHAR) AS label, q.concept, "
                          "q.dimension, q.question_label, " + render_sql(SYSTEM_PROMPT_TEMPLATE, cols) +
                          " AS system_prompt, " + render_sql(QUESTION_PROMPT_TEMPLATE, cols) +
                          " AS user_prompt FROM documents d CROSS JOIN rubric q")
    o["response_content"] = d_with() + f"""
SELECT label, model, question_label,
       CASE WHEN k IS NULL THEN answer END AS answer, CASE WHEN k IS NULL THEN score END AS score, k AS error
FROM (SELECT *, CASE CAST(label AS BIGINT) % 11 WHEN 0 THEN 'broken JSON' WHEN 1 THEN 'empty content'
                WHEN 2 THEN 'no logprobs' WHEN 3 THEN 'no choices' END AS k FROM qs)"""
    o["failed_scores"] = d_with(rollup_ctes(), failing=True) + """
SELECT q.label, q.model, q.question_label, q.answer, q.score, q.matched, q.error, m.score AS model_score,
       t.score AS text_score
FROM qs q JOIN ms m ON m.label = q.label AND m.model = q.model JOIN ts t ON t.label = q.label"""
    o["stored_scores"] = fw + """
SELECT label, model, concept, dimension, score, DATE '2024-05-02' AS run_date FROM ds"""
    o["model_status"] = d_with(failing=True) + """
SELECT label, model, CASE WHEN bool_or(error IS NOT NULL) THEN 'error' ELSE 'ok' END AS status,
       min(error) AS error, count(*) AS n_questions, count(score) AS n_scored FROM qs GROUP BY label, model"""
    o["run_metadata"] = fw + f"""
SELECT label, array_to_string(list_sort(list_distinct(list(model))), ',') AS models_used,
       {_lit(SYSTEM_PROMPT_TEMPLATE)} AS system_prompt, {_lit(QUESTION_PROMPT_TEMPLATE)} AS base_prompt
FROM qs GROUP BY label"""


_phase6_oracles = oracles


def oracles() -> dict[str, str]:  # noqa: F811 - extends the phase 1-6 set
    o = _phase6_oracles()
    phase78_oracles(o)
    return o
