"""Registered queries for scoring pairs of SQL texts and result sets (Q1-Q17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kitescope.functions import fixed_values as fixed
from kitescope.functions import sqltext
from kitescope.operators import sqlscore
from kitescope.plans.registry import query
from kitescope.plans.text_queries import sql_list

CLAUSES = sqlscore.CLAUSES


def ratio(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0)"


def f1(p: str, r: str) -> str:
    return f"coalesce(2 * ({p}) * ({r}) / nullif(({p}) + ({r}), 0), 0)"


def shared(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


COMPARE_TAIL = f"""SELECT {{keys}} bool_and(in_g = in_t) AS exact_match, CAST(sum(g) AS BIGINT) AS generated_rows, CAST(sum(t) AS BIGINT) AS truth_rows,
 CASE WHEN sum(in_t) > 0 THEN {ratio('sum(in_g * in_t)', 'sum(in_g)')} ELSE 0 END AS precision, {ratio('sum(in_g * in_t)', 'sum(in_t)')} AS recall,
 CASE WHEN sum(in_t) > 0 THEN {ratio('sum(in_g * in_t)', 'count(*)')} ELSE 0 END AS jaccard FROM rows {{group}}"""
ROWS = """marked AS (SELECT *, 1 AS g, 0 AS t FROM x_generated_rows UNION ALL SELECT *, 0, 1 FROM x_truth_rows),
 rows AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, sum(g) AS g, sum(t) AS t, CAST(sum(g) > 0 AS INT) AS in_g, CAST(sum(t) > 0 AS INT) AS in_t FROM marked GROUP BY 1, 2, 3, 4)"""


def compare_sql(keys: str) -> str:
    tail = COMPARE_TAIL.format(keys=keys + ("," if keys else ""), group=f"GROUP BY {keys}" if keys else "")
    return f"""WITH {ROWS}, m AS ({tail}) SELECT {keys + ',' if keys else ''} exact_match, generated_rows, truth_rows, round(precision, 6) AS precision, round(recall, 6) AS recall,
 round({f1('precision', 'recall')}, 6) AS f1_score, round(jaccard, 6) AS jaccard FROM m"""


def rounded(df, columns):
    return df.select(*[F.round(x, 6).alias(x) if x in columns else F.col(x) for x in df.columns])


COMPARED = ["precision", "recall", "f1_score", "jaccard"]


@query("q1_compare_results", compare_sql(""))
def q1(c):
    return rounded(sqlscore.compare_results(c("x_generated_rows"), c("x_truth_rows")), COMPARED)


@query("q1_compare_results_by_key", compare_sql("o_custkey"))
def q1_keyed(c):
    return rounded(sqlscore.compare_results(c("x_generated_rows"), c("x_truth_rows"), ["o_custkey"]), COMPARED)


@query("q1_compare_many_results", compare_sql("o_custkey"))
def q1_many(c):
    return rounded(sqlscore.compare_many_results(c("x_generated_rows"), c("x_truth_rows"), ["o_custkey"]), COMPARED)


# clause patterns written for an engine without look-around; (?s) lets a dot cross lines
P = sqltext.CLAUSE_PATTERNS
TRIM = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def component_sql(col: str, clause: str) -> str:
    up = TRIM.format(x=f"upper({col})")
    pattern = P[clause].replace("'", "''")
    if clause == "join":
        return f"list_distinct(regexp_extract_all({up}, '{pattern}', 1))"
    body = f"regexp_extract({up}, '{pattern}', 1)"
    if clause in sqltext.LISTED_CLAUSES:
        found = f"list_distinct(list_transform(string_split({body}, ','), lambda x: {TRIM.format(x='x')}))"
    else:
        found = f"[{body if clause == 'from' else TRIM.format(x=body)}]"
    return f"CASE WHEN regexp_matches({up}, '{pattern}') THEN {found} ELSE CAST([] AS VARCHAR[]) END"


PARTS = "parts AS (SELECT *, " + ", ".join(
    f"{component_sql(col, c)} AS {n}_{c}" for c in CLAUSES for n, col in (("g", "generated_sql"), ("t", "truth_sql"))
) + " FROM s_pairs)"
SHOWN = ", ".join(f"array_to_string(list_sort({n}_{c}), '|') AS {n}_{c}" for c in CLAUSES for n in "gt")


@query("q2_sql_components", f"WITH {PARTS} SELECT pair_id, {SHOWN} FROM parts")
def q2(c):
    parts = sqlscore.components(c("s_pairs"))
    return parts.select("pair_id", *[F.array_join(F.array_sort(f"{n}_{x}"), "|").alias(f"{n}_{x}") for x in CLAUSES for n in "gt"])


LOGIC = {c: f"CASE WHEN len(t_{c}) > 0 THEN {ratio(shared(f'g_{c}', f't_{c}'), f'len(t_{c})')} ELSE CAST(len(g_{c}) = 0 AS DOUBLE) END" for c in CLAUSES}
LOGICAL = "(" + " + ".join(LOGIC.values()) + ") / 7"


@query("q3_logical_form_score", f"WITH {PARTS} SELECT pair_id, {', '.join(f'round({e}, 6) AS {c}_score' for c, e in LOGIC.items())}, round({LOGICAL}, 6) AS logical FROM parts")
def q3(c):
    names = [f"{x}_score" for x in CLAUSES] + ["logical"]
    return rounded(sqlscore.logical_form_score(c("s_pairs").select("pair_id", "generated_sql", "truth_sql")).select("pair_id", *names), names)


def tokens_sql(col: str) -> str:
    return rf"regexp_extract_all(regexp_replace(regexp_replace({col}, '--.*?\n', ' ', 'g'), '(?s)/\*.*?\*/', ' ', 'g'), '\w+|[^\w\s]')"


@query("q4_sql_tokens", f"SELECT pair_id, array_to_string({tokens_sql('generated_sql')}, ' ') AS tokens, CAST(len({tokens_sql('truth_sql')}) AS INT) AS n_truth FROM s_pairs")
def q4(c):
    return c("s_pairs").select(
        "pair_id", F.array_join(sqltext.sql_tokens(F.col("generated_sql")), " ").alias("tokens"), F.size(sqltext.sql_tokens(F.col("truth_sql"))).alias("n_truth")
    )


def kind_sql(col: str, kind: str) -> str:
    if kind == "keyword":
        return f"list_distinct(list_filter(list_transform({tokens_sql(col)}, lambda x: upper(x)), lambda x: list_contains({sql_list(fixed.SQL_MATCH_KEYWORDS)}, x)))"
    if kind == "table":
        return f"list_distinct(regexp_extract_all(upper({col}), '(?:FROM|JOIN|UPDATE|INTO)\\s+([^\\s,\\)]+)', 1))"
    up = rf"regexp_replace(regexp_replace(regexp_replace(upper({col}), '\x27[^\x27]*\x27', '', 'g'), '\x22[^\x22]*\x22', '', 'g'), '--.*?\n', ' ', 'g')"
    body = f"regexp_extract({up}, '{P['select']}', 1)"
    picked = f"list_filter(list_transform(string_split({body}, ','), lambda i: regexp_extract(i, '([A-Z_][A-Z0-9_]*)', 1)), lambda n: n <> '' AND NOT list_contains({sql_list(fixed.SQL_AGGREGATES)}, n))"
    compared = f"list_filter(regexp_extract_all({up}, '([A-Z_][A-Z0-9_]*)\\s*[=<>!]', 1), lambda n: NOT list_contains({sql_list(fixed.SQL_PREDICATE_WORDS)}, n))"
    return f"list_distinct(list_concat({picked}, {compared}))"


KINDS = ["keyword", "table", "column"]
KIND_SETS = "ks AS (SELECT *, " + ", ".join(f"{kind_sql(col, k)} AS {n}_{k}" for k in KINDS for n, col in (("g", "generated_sql"), ("t", "truth_sql"))) + " FROM s_pairs)"
KIND_PR = "kp AS (SELECT *, " + ", ".join(
    f"{ratio(shared(f'g_{k}', f't_{k}'), f'len(g_{k})')} AS {k}_precision, {ratio(shared(f'g_{k}', f't_{k}'), f'len(t_{k})')} AS {k}_recall" for k in KINDS) + " FROM ks)"
PARTIAL = "(" + " + ".join(f1(f"{k}_precision", f"{k}_recall") for k in KINDS) + ") / 3"
MEASURES = [f"{k}_{m}" for k in KINDS for m in ("precision", "recall")]


@query(
    "q5_partial_match",
    f"WITH {KIND_SETS}, {KIND_PR} SELECT pair_id, {', '.join(f'round({m}, 6) AS {m}' for m in MEASURES)}, {', '.join(f'round({f1(f'{k}_precision', f'{k}_recall')}, 6) AS {k}_f1' for k in KINDS)}, round({PARTIAL}, 6) AS partial FROM kp",
)
def q5(c):
    names = MEASURES + [f"{k}_f1" for k in KINDS] + ["partial"]
    return rounded(sqlscore.partial_match(c("s_pairs").select("pair_id", "generated_sql", "truth_sql")).select("pair_id", *names), names)


EXECUTION = "CASE WHEN pair_id % 5 = 0 THEN NULL ELSE CAST(pair_id % 3 AS DOUBLE) / 2 END"


@query(
    "q6_overall_a",
    f"""WITH {PARTS}, {KIND_SETS}, {KIND_PR}, s AS (SELECT p.pair_id, {EXECUTION.replace('pair_id', 'p.pair_id')} AS e, {LOGICAL} AS l, {PARTIAL} AS m, p.judge_score AS j FROM parts p JOIN kp ON kp.pair_id = p.pair_id)
SELECT pair_id, round((coalesce(e * 0.4, 0) + l * 0.25 + m * 0.2 + coalesce(j * 0.15, 0))
 / (CASE WHEN e IS NULL THEN 0 ELSE 0.4::DOUBLE END + 0.25::DOUBLE + 0.2::DOUBLE + CASE WHEN j IS NULL THEN 0 ELSE 0.15::DOUBLE END), 6) AS overall FROM s""",
)
def q6(c):
    pairs = c("s_pairs")
    scored = sqlscore.logical_form_score(sqlscore.partial_match(pairs)).select(
        "pair_id", F.when(F.col("pair_id") % 5 != 0, (F.col("pair_id") % 3).cast("double") / 2).alias("execution"), "logical", "partial", F.col("judge_score").alias("judge")
    )
    return rounded(sqlscore.overall_a(scored).select("pair_id", "overall"), ["overall"])


NORMAL = "lower(trim(regexp_replace({x}, '\\s+', ' ', 'g')))"
EXACT = f"CAST({NORMAL.format(x='generated_sql')} = {NORMAL.format(x='truth_sql')} AS DOUBLE)"


@query("q7_exact_match", f"SELECT pair_id, {EXACT} AS exact_match FROM s_pairs")
def q7(c):
    return c("s_pairs").select("pair_id", sqlscore.exact_match(c("s_pairs")).alias("exact_match"))


def segments_sql(col: str) -> str:
    return rf"string_split(regexp_replace(regexp_replace({col}, '\s+', ' ', 'g'), '(?i)\b(select|from|where|group by|order by|having)\b', chr(1) || '\1' || chr(2), 'g'), chr(1))"


def clause_sql(seg: str, clause: str) -> str:
    word = sqlscore.CLAUSE_WORDS[clause]
    bodies = f"array_to_string(list_transform(list_filter({seg}, lambda s: starts_with(lower(s), '{word}' || chr(2))), lambda s: substr(s, {len(word) + 2})), ' ')"
    return f"list_filter(list_distinct(regexp_extract_all({bodies}, '''[^'']*''|\\w+|[^\\w\\s,.;()]')), lambda t: NOT list_contains({sql_list(sqlscore.NOT_COUNTED)}, lower(t)))"


SEG = f"seg AS (SELECT pair_id, {segments_sql('generated_sql')} AS g, {segments_sql('truth_sql')} AS t FROM s_pairs)"
SEGC = "segc AS (SELECT pair_id, " + ", ".join(f"{clause_sql(n, k)} AS {n}_{k}" for k in sqlscore.CLAUSE_WORDS for n in "gt") + " FROM seg)"
SEEN = [
    f"CASE WHEN len(g_{k}) > 0 OR len(t_{k}) > 0 THEN {f1(ratio(shared(f'g_{k}', f't_{k}'), f'len(g_{k})'), ratio(shared(f'g_{k}', f't_{k}'), f'len(t_{k})'))} END"
    for k in sqlscore.CLAUSE_WORDS
]
COMPONENT = f"coalesce(list_avg([{', '.join(SEEN)}]), 0)"


@query("q8_component_f1", f"WITH {SEG}, {SEGC} SELECT pair_id, round({COMPONENT}, 6) AS component_f1 FROM segc")
def q8(c):
    return rounded(sqlscore.component_f1(c("s_pairs").select("pair_id", "generated_sql", "truth_sql")).select("pair_id", "component_f1"), ["component_f1"])


LOW = r"list_transform(regexp_extract_all({x}, '''[^'']*''|\d+\.\d+|\w+|[^\w\s]'), lambda w: lower(w))"
FLAGS = "list_filter([" + ", ".join(f"CASE WHEN contains(upper({{x}}), '{m}') THEN '{m}' END" for m in fixed.SQL_STRUCTURE_MARKS) + "], lambda m: m IS NOT NULL)"
REFS = rf"list_distinct(list_filter(list_transform(regexp_extract_all({{x}}, '\w+'), lambda w: lower(w)), lambda w: length(w) > 2 AND NOT list_contains({sql_list(fixed.SQL_REFERENCE_STOP)}, w)))"
BIGRAMS = "list_distinct(list_transform(list_zip({x}[1:len({x}) - 1], {x}[2:len({x})]), lambda z: z[1] || chr(1) || z[2]))"
G, T = "generated_sql", "truth_sql"
TOK = f"""tok AS (SELECT pair_id, {LOW.format(x=G)} AS g, {LOW.format(x=T)} AS t, {FLAGS.format(x=G)} AS gs, {FLAGS.format(x=T)} AS ts, {REFS.format(x=G)} AS gr, {REFS.format(x=T)} AS tr FROM s_pairs),
 tk AS (SELECT *, {BIGRAMS.format(x='g')} AS g2, {BIGRAMS.format(x='t')} AS t2, list_distinct(g) AS g1, list_distinct(t) AS t1 FROM tok)"""
WEIGHT = f"list_sum(list_transform({{x}}, lambda w: CASE WHEN list_contains({sql_list(fixed.SQL_WEIGHTED_KEYWORDS)}, w) THEN 5.0::DOUBLE ELSE 1.0 END))"


def overlap(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN {ratio(shared(a, b), f'len(list_distinct(list_concat({a}, {b})))')} ELSE 0 END"


SCORES = f"""sc AS (SELECT pair_id, least(1, {ratio('len(g)', 'len(t)')}) * sqrt({ratio(shared('g1', 't1'), 'len(g1)')} * {ratio(shared('g2', 't2'), 'len(g2)')}) AS bleu,
 coalesce(coalesce({WEIGHT.format(x='list_filter(g, lambda w: list_contains(t1, w))')}, 0) / nullif({WEIGHT.format(x='g')}, 0), 0) AS weighted,
 {overlap('gs', 'ts')} AS structure, {overlap('gr', 'tr')} AS reference_overlap FROM tk)"""


def token_query(name: str, column: str, expr: str | None = None) -> None:
    @query(name, f"WITH {TOK}, {SCORES} SELECT pair_id, round({expr or column}, 6) AS {column} FROM sc")
    def run(c):
        return rounded(sqlscore.token_scores(c("s_pairs").select("pair_id", G, T)).select("pair_id", column), [column])


token_query("q9_bleu_simple", "bleu")
token_query("q10_weighted_token_match", "weighted")
token_query("q11_structure_jaccard", "structure")
token_query("q12_reference_jaccard", "reference_overlap")
CODE_BLEU = "0.25::DOUBLE * bleu + 0.25::DOUBLE * weighted + 0.25::DOUBLE * structure + 0.25::DOUBLE * reference_overlap"
token_query("q13_code_bleu", "code_bleu", CODE_BLEU)


def pair_terms(col: str, source: str, key: str = "pair_id") -> str:
    w = rf"regexp_extract_all(lower({col}), '\w{{2,}}')"
    return f"SELECT {key}, unnest(list_concat(w, list_transform(list_zip(w[1:len(w) - 1], w[2:len(w)]), lambda z: z[1] || ' ' || z[2]))) AS term FROM (SELECT {key}, {w} AS w FROM {source}) w0"


def cosine_sql(source: str, left: str, right: str) -> str:
    return f"""pt AS (SELECT pair_id, term, sum(g) AS g, sum(t) AS t FROM (SELECT *, 1 AS g, 0 AS t FROM ({pair_terms(left, source)}) a UNION ALL SELECT *, 0, 1 FROM ({pair_terms(right, source)}) b) u GROUP BY 1, 2),
 pw AS (SELECT pair_id, g * (ln(3.0::DOUBLE / (1 + CAST(g > 0 AS INT) + CAST(t > 0 AS INT))) + 1) AS a, t * (ln(3.0::DOUBLE / (1 + CAST(g > 0 AS INT) + CAST(t > 0 AS INT))) + 1) AS b FROM pt),
 cos AS (SELECT pair_id, coalesce(sum(a * b) / nullif(sqrt(sum(a * a) * sum(b * b)), 0), 0) AS semantic FROM pw GROUP BY 1)"""


@query("q14_pair_tfidf_cosine", f"WITH {cosine_sql('s_pairs', G, T)} SELECT p.pair_id, round(coalesce(c.semantic, 0), 6) AS semantic FROM s_pairs p LEFT JOIN cos c ON c.pair_id = p.pair_id")
def q14(c):
    return rounded(sqlscore.pair_tfidf_cosine(c("s_pairs"), unique=True), ["semantic"])


TURNS = "turns AS (SELECT a.conv_id * 1000 + a.turn AS pair_id, a.text AS g_text, b.text AS t_text FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"


@query(
    "q14_pair_tfidf_cosine_turns",
    f"WITH {TURNS}, {cosine_sql('turns', 'g_text', 't_text')} SELECT p.pair_id, round(coalesce(c.semantic, 0), 6) AS semantic FROM turns p LEFT JOIN cos c ON c.pair_id = p.pair_id",
)
def q14_turns(c):
    a, b = c("conversations").alias("a"), c("conversations").alias("b")
    turns = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") == F.col("a.turn") + 1)).select(
        (F.col("a.conv_id") * 1000 + F.col("a.turn")).alias("pair_id"), F.col("a.text").alias("g_text"), F.col("b.text").alias("t_text")
    )
    return rounded(sqlscore.pair_tfidf_cosine(turns, "g_text", "t_text"), ["semantic"])


COMPLEXITY = """(1.0::DOUBLE + 2 * len(regexp_extract_all(upper({x}), 'JOIN')) + CASE WHEN contains(upper({x}), 'SUBQUERY') OR (contains({x}, '(') AND contains({x}, 'SELECT')) THEN 3 ELSE 0 END
 + CASE WHEN contains(upper({x}), 'GROUP BY') THEN 2 ELSE 0 END + CASE WHEN contains(upper({x}), 'ORDER BY') THEN 1 ELSE 0 END + CASE WHEN contains(upper({x}), 'HAVING') THEN 2 ELSE 0 END)"""
EFFICIENCY = f"CASE WHEN trim(generated_sql) <> '' THEN least(1, {COMPLEXITY.format(x=T)} / {COMPLEXITY.format(x=G)}) ELSE 0 END"


@query("q15_efficiency", f"SELECT pair_id, {COMPLEXITY.format(x=G)} AS generated_complexity, {COMPLEXITY.format(x=T)} AS truth_complexity, round({EFFICIENCY}, 6) AS efficiency FROM s_pairs")
def q15(c):
    return c("s_pairs").select(
        "pair_id", sqltext.complexity(F.col(G)).alias("generated_complexity"), sqltext.complexity(F.col(T)).alias("truth_complexity"),
        F.round(sqlscore.efficiency(F.col(G), F.col(T)), 6).alias("efficiency"),
    )


ENT = rf"list_filter(list_transform(list_filter(regexp_extract_all({{x}}, '\w+'), lambda w: regexp_matches(w, '^[A-Za-z_]')), lambda w: lower(w)), lambda w: length(w) > 1 AND NOT list_contains({sql_list(fixed.SQL_ENTITY_STOP)}, w))"
SOFT = f"""ent AS (SELECT pair_id, {ENT.format(x=G)} AS g, {ENT.format(x=T)} AS t FROM s_pairs),
 hit AS (SELECT pair_id, len(g) AS ng, len(t) AS nt, len(list_filter(g, lambda x: len(list_filter(t, lambda y: 1 - levenshtein(x, y) / CAST(greatest(length(x), length(y)) AS DOUBLE) > 0.8::DOUBLE)) > 0)) AS h FROM ent),
 soft AS (SELECT pair_id, {ratio('h', 'ng')} AS soft_precision, {ratio('h', 'nt')} AS soft_recall FROM hit)"""


@query("q16_soft_f1_edit", f"WITH {SOFT} SELECT pair_id, round(soft_precision, 6) AS soft_precision, round(soft_recall, 6) AS soft_recall, round({f1('soft_precision', 'soft_recall')}, 6) AS soft_f1 FROM soft")
def q16_edit(c):
    names = ["soft_precision", "soft_recall", "soft_f1"]
    return rounded(sqlscore.soft_f1_edit(c("s_pairs").select("pair_id", G, T)).select("pair_id", *names), names)


# lengths of the longest run of x from each place that lies in y; the first longest one splits both texts
RUNS = "list_transform(range(1, length(x) + 1), lambda i: list_max(list_filter(range(0, length(x) - i + 2), lambda k: contains(y, substr(x, i, k)))))"
BLOCKS = f"""names AS (SELECT DISTINCT x, y FROM (SELECT unnest(g) AS x, t FROM ent) a, unnest(t) u(y) WHERE x <> y AND 2 * least(length(x), length(y)) > 0.8::DOUBLE * (length(x) + length(y))),
 work AS (SELECT x AS x0, y AS y0, x, y, 0::BIGINT AS size FROM names
  UNION ALL SELECT x0, y0, unnest([x[:pos - 1], x[pos + k:], '']), unnest([y[:b - 1], y[b + k:], '']), unnest([0, 0, k]) FROM (
   SELECT *, instr(y, substr(x, pos, k)) AS b FROM (SELECT *, list_position(runs, k) AS pos FROM (SELECT *, list_max(runs) AS k FROM (SELECT x0, y0, x, y, {RUNS} AS runs FROM work WHERE x <> '' AND y <> '') r) l) p WHERE k > 0) s),
 near AS (SELECT x0 AS x, y0 AS y FROM work GROUP BY 1, 2 HAVING 2.0::DOUBLE * sum(size) / (length(x0) + length(y0)) > 0.8::DOUBLE),
 nearby AS (SELECT e.pair_id, list(DISTINCT n.x) AS xs FROM (SELECT pair_id, unnest(g) AS x, t FROM ent) e JOIN near n ON n.x = e.x AND list_contains(e.t, n.y) GROUP BY 1),
 bhit AS (SELECT e.pair_id, len(g) AS ng, len(t) AS nt, len(list_filter(g, lambda x: list_contains(t, x) OR coalesce(list_contains(xs, x), FALSE))) AS h FROM ent e LEFT JOIN nearby n ON n.pair_id = e.pair_id),
 bsoft AS (SELECT pair_id, {ratio('h', 'ng')} AS soft_precision, {ratio('h', 'nt')} AS soft_recall FROM bhit)"""


@query("q16_soft_f1", f"WITH RECURSIVE {SOFT}, {BLOCKS} SELECT pair_id, round(soft_precision, 6) AS soft_precision, round(soft_recall, 6) AS soft_recall, round({f1('soft_precision', 'soft_recall')}, 6) AS soft_f1 FROM bsoft")
def q16(c):
    return rounded(sqlscore.soft_f1(c("s_pairs")), ["soft_precision", "soft_recall", "soft_f1"])


W = fixed.TEXT_SCORE_WEIGHTS
ALL = f"""allscores AS (SELECT p.pair_id, {EXACT} AS exact_match, {COMPONENT} AS component_f1, bleu, {CODE_BLEU} AS code_bleu, structure, coalesce(cos.semantic, 0) AS semantic,
 {EFFICIENCY} AS efficiency, {f1('soft_precision', 'soft_recall')} AS soft_f1, p.judge_score AS judge
 FROM s_pairs p JOIN segc ON segc.pair_id = p.pair_id JOIN sc ON sc.pair_id = p.pair_id JOIN soft ON soft.pair_id = p.pair_id LEFT JOIN cos ON cos.pair_id = p.pair_id)"""
TOP = " + ".join(f"coalesce({n} * {w}::DOUBLE, 0)" for n, w in W.items())
BOTTOM = " + ".join(f"CASE WHEN {n} IS NULL THEN 0 ELSE {w}::DOUBLE END" for n, w in W.items())
ADVISED = "list_filter([" + ", ".join(f"CASE WHEN {n} < {b} THEN '{text}' END" for n, b, text in fixed.ADVICE) + "], lambda a: a IS NOT NULL)"


@query(
    "q17_overall_b",
    f"""WITH {SEG}, {SEGC}, {TOK}, {SCORES}, {cosine_sql('s_pairs', G, T)}, {SOFT}, {ALL}, rated AS (SELECT *, round(({TOP}) / ({BOTTOM}), 6) AS overall, {ADVISED} AS advice FROM allscores)
SELECT pair_id, overall, CASE WHEN overall >= 0.9 THEN 'A' WHEN overall >= 0.8 THEN 'B' WHEN overall >= 0.7 THEN 'C' WHEN overall >= 0.6 THEN 'D' ELSE 'F' END AS grade,
 CASE WHEN overall >= 0.7 THEN 'Good' WHEN overall >= 0.5 THEN 'Needs Improvement' ELSE 'Poor' END AS status,
 CASE WHEN len(advice) > 0 THEN array_to_string(advice, '|') ELSE '{fixed.ADVICE_NONE}' END AS recommendations FROM rated""",
)
def q17(c):
    rated = sqlscore.score_texts(c("s_pairs"), edit_distance=True)
    overall = F.round("overall", 6)
    return rated.select(
        "pair_id", overall.alias("overall"), sqlscore.grade(overall).alias("grade"), sqlscore.status(overall).alias("status"), F.array_join("recommendations", "|").alias("recommendations")
    )
