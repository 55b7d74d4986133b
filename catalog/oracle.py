"""The same queries in SQL for DuckDB, written from the definitions, not from the Spark code."""

from __future__ import annotations

from traitscope.functions import prompts

PREDICATES = ["the", "und", "el", "le"]
CANDIDATES = ["of", "die", "la", "que", "and"]
LANGS = ["en", "de", "es", "fr"]
WS = r"[\t-\r\x1c-\x1f \x{85}\pZ]+"


def toks(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '{WS}'), lambda tok: tok <> '')"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}|{WS}$', '', 'g')"


def r(x: str, n: int = 9) -> str:
    return f"round({x}, {n}) + 0.0"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def bit_columns(predicates, c: str = "tk") -> str:
    return ", ".join(f"CAST(list_contains({c}, {q(p)}) AS INT) AS p{i}" for i, p in enumerate(predicates))


def distinct_bits(predicates) -> str:
    return f"""t AS (SELECT min(doc_id) AS text_id, text FROM documents GROUP BY text),
k AS (SELECT text_id, {toks('text')} AS tk FROM t),
b AS (SELECT text_id, {bit_columns(predicates)} FROM k)"""


def all_bits(predicates) -> str:
    return f"""k AS (SELECT doc_id, lang, {toks('text')} AS tk FROM documents),
b AS (SELECT doc_id AS text_id, lang, {bit_columns(predicates)} FROM k)"""


def labelled_bits(predicates) -> str:
    return f"""k AS (SELECT doc_id, quality AS label, {toks('text')} AS tk FROM documents JOIN labels USING (doc_id)),
b AS (SELECT doc_id AS text_id, label, {bit_columns(predicates)} FROM k)"""


def names(k: int, prefix: str = "p") -> str:
    return ", ".join(f"{prefix}{i}" for i in range(k))


def loss_of(columns: list[str], source: str) -> str:
    """Cluster fitness of 0/1 columns of a relation, with smoothing 1."""
    best = ", ".join(f"c{i} / (sum(c{i}) OVER () + 1e-6)" for i in range(len(columns)))
    renamed = ", ".join(f"{c} AS c{i}" for i, c in enumerate(columns))
    return f"(SELECT avg(-ln(m)) FROM (SELECT greatest(1.0 / count(*) OVER (), {best}) AS m FROM (SELECT {renamed} FROM {source})))"


def prompt_sql(template: str, values: dict[str, str]) -> str:
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return " || ".join(q(p) if i % 2 == 0 else values[p] for i, p in enumerate(parts))


def gauss(row: str, dim: str, seed: int = 0) -> str:
    h = f"md5('{seed}:' || {row} || ':' || {dim})"
    u = f"((('0x' || substr({h}, 1, 8))::BIGINT + 1) / 4294967297.0)"
    v = f"(('0x' || substr({h}, 9, 8))::BIGINT / 4294967296.0)"
    return f"(sqrt(-2.0 * ln({u})) * cos(2.0 * pi() * {v}))"


RUN_LOG = """g AS (SELECT 'run' || doc_id AS run_id, lang AS problem_type,
  CASE WHEN source = 'src0' THEN 'dummy' ELSE source END AS dataset, CAST(doc_id % 11 % 7 AS INT) AS seed,
  ['normal', 'random_update', 'one_hot', 'no_refine'][doc_id % 4 + 1] AS tag, (n_chars % 1000) / 1000.0 AS main_f1,
  1704153600 - doc_id % 60 * 3600 AS started, n_chars % 3 = 0 AS finished FROM documents)"""

PAIRS = f"""WITH {all_bits(PREDICATES)},
g AS (SELECT text_id, unnest([0, 1, 2, 3]) AS ref_id, unnest([CAST(lang = 'en' AS INT), CAST(lang = 'de' AS INT), CAST(lang = 'es' AS INT), CAST(lang = 'fr' AS INT)]) AS y FROM b),
p AS (SELECT text_id, unnest([0, 1, 2, 3]) AS pred_id, unnest([p0, p1, p2, p3]) AS s FROM b),
m AS (SELECT ref_id, pred_id, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y * s) AS DOUBLE) AS tp, CAST(sum(y) AS DOUBLE) AS sy, CAST(sum(s) AS DOUBLE) AS ss
  FROM g JOIN p USING (text_id) GROUP BY ALL),
f AS (SELECT *, CASE WHEN sy + ss = 0 THEN 0 ELSE 2 * tp / (sy + ss) END AS f1,
  abs((tp - sy * ss / n) / ((sqrt(sy - sy * sy / n) + 1e-8) * (sqrt(ss - ss * ss / n) + 1e-8))) AS cosine FROM m)"""

PLACED = """e AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS t, CAST(event_type = 'error' AS DOUBLE) AS x0, CAST(event_type = 'view' AS DOUBLE) AS x1 FROM events)"""


def ema(source: str, x: str, out: str, seed_n: int, part: str = "") -> str:
    """Closed form of the smoothing: (1-a)^t seed + sum over j of a (1-a)^(t-j) x_j, without x_0."""
    over = f"PARTITION BY {part} " if part else ""
    return (
        f"pow(0.995, t) * avg({x}) FILTER (t < {seed_n}) OVER ({f'PARTITION BY {part}' if part else ''}) + "
        f"pow(0.995, t) * sum(CASE WHEN t = 0 THEN 0 ELSE 0.005 * {x} * pow(0.995, -t) END) OVER ({over}ORDER BY t) AS {out}"
    )


def curve_sql(seed_n: int) -> str:
    return f"""WITH {PLACED}, c AS (SELECT event_id, t, {ema('e', 'x0', 'c0', seed_n)}, {ema('e', 'x1', 'c1', seed_n)} FROM e)
SELECT event_id, t, {r('c0')} AS c0, {r('c1')} AS c1 FROM c"""


def bow_sql(slots: int = 500, dims: int = 50) -> str:
    """CTEs up to x(doc_id, e0.., norm): CRC-32 slots of the tokens times a fixed Gaussian matrix."""
    columns = ", ".join(f"{gauss('slot', q(str(d)))} AS g{d}" for d in range(dims))
    sums = ", ".join(f"sum(c * g{d}) AS e{d}" for d in range(dims))
    norm = " + ".join(f"e{d} * e{d}" for d in range(dims))
    return f"""bit(i, n, c) AS (SELECT i, 0, i FROM range(256) AS z(i) UNION ALL SELECT i, n + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM bit WHERE n < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM bit WHERE n = 8),
s AS (SELECT doc_id, unnest({toks('text')}) AS tok FROM documents),
w AS (SELECT tok, hex(encode(tok)) AS x FROM (SELECT DISTINCT tok FROM s)),
y AS (SELECT tok, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT) AS bytes FROM w),
k AS (SELECT tok, xor(list_reduce(bytes, lambda c, v: xor(tab[(xor(c, v) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295) % {slots} AS slot FROM y, crc),
h AS (SELECT doc_id, slot, count(*) AS c FROM s JOIN k USING (tok) GROUP BY ALL),
g AS (SELECT slot, {columns} FROM range({slots}) AS t(slot)),
u AS (SELECT doc_id, {sums} FROM h JOIN g USING (slot) GROUP BY doc_id),
x AS (SELECT *, sqrt({norm}) AS norm FROM u)"""


def bow_columns(dims: int = 50) -> str:
    return ", ".join(f"{r(f'CAST(e{d} / norm AS FLOAT)::DOUBLE', 4)} AS e{d}" for d in range(dims))


def recursive_curve_sql(seed_n: int, rate: float) -> str:
    """The recursion of the smoothing, row by row."""
    return f"""WITH RECURSIVE {PLACED}, c(t, c0, c1) AS (
SELECT 0::BIGINT, avg(x0) FILTER (t < {seed_n}), avg(x1) FILTER (t < {seed_n}) FROM e
UNION ALL SELECT c.t + 1, {1 - rate} * c0 + {rate} * x0, {1 - rate} * c1 + {rate} * x1 FROM c JOIN e ON e.t = c.t + 1)
SELECT event_id, t, {r('c0')} AS c0, {r('c1')} AS c1 FROM c JOIN e USING (t)"""


def class_fitness_sql() -> str:
    """Bits that exclude each other: one logistic unknown per language, by Newton's method.

    d = w1 - w0 minimises n_l * cross-entropy(p_l, sigmoid(d)) / n + d^2 / (4 C n).
    """
    return """WITH RECURSIVE g AS (SELECT lang, CAST(count(*) AS DOUBLE) AS nl, avg(quality) AS p, CAST(sum(count(*)) OVER () AS DOUBLE) AS n
FROM documents JOIN labels USING (doc_id) GROUP BY lang),
d(lang, nl, p, n, step, d) AS (SELECT lang, nl, p, n, 0, 0.0::DOUBLE FROM g
UNION ALL SELECT lang, nl, p, n, step + 1, d - greatest(-1.0, least(1.0, (nl * (1 / (1 + exp(-d)) - p) + d / 2e5) / (nl / (1 + exp(-d)) / (1 + exp(d)) + 1 / 2e5))) FROM d WHERE step < 60)
SELECT CAST(max(n) AS BIGINT) AS n, round(-sum(nl / n * (p * ln(1 / (1 + exp(-d))) + (1 - p) * ln(1 / (1 + exp(d))))), 6) + 0.0 AS loss FROM d WHERE step = 60"""


def hash_rank(seed: int, key: str) -> str:
    return f"md5('{seed}:' || {key})"


EXTREMES = f"""l AS (SELECT doc_id AS text_id, text, length(text) AS target FROM documents JOIN labels USING (doc_id)),
x AS (SELECT text_id, text, target, 'top' AS part FROM (FROM l ORDER BY target DESC, text_id LIMIT 5)
UNION ALL SELECT text_id, text, target, 'bottom' FROM (FROM l ORDER BY target, text_id DESC LIMIT 5)
UNION ALL SELECT text_id, text, target, 'random' FROM (FROM l ORDER BY {hash_rank(3, 'text_id')}, text_id LIMIT 30))"""

TRUNCATED = f"CASE WHEN len({toks('text')}) <= 256 THEN text ELSE array_to_string(list_slice({toks('text')}, 1, 256), ' ') END"


def scored_context_sql() -> str:
    lines = f"""(SELECT string_agg('Sample ' || (rn - 1) || ': ' || shown || ' (score: ' || printf('%.1f', target / 7.0) || ')', chr(10) ORDER BY rn)
FROM (SELECT {TRUNCATED} AS shown, target, row_number() OVER (ORDER BY target, text_id, text) AS rn FROM x))"""
    shown = q('Earlier hypotheses; keep their form but not their content:\n"uses irony"\n')
    body = prompt_sql(
        prompts.PROPOSE_SCORED,
        {
            "samples_in_prompt_w_scores": lines,
            "goal": "'the goal'",
            "example_description_in_prompt": shown,
            "num_descriptions_per_prompt": "'5'",
        },
    )
    return f"WITH {EXTREMES} SELECT md5(replace({body}, chr(10) || chr(10), chr(10))) AS prompt_md5"


ANSWER = """CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL
WHEN 3 THEN [doc_id % 6, doc_id % 3] WHEN 4 THEN [doc_id % 4] WHEN 5 THEN [doc_id % 4] ELSE [-(doc_id % 6)] END"""


def kmeanspp_sql(k: int, seed: int) -> str:
    dist = "sqrt(list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
    parts = [
        "v AS (SELECT vec_id AS text_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)",
        f"s0 AS (SELECT text_id, e FROM v ORDER BY {hash_rank(seed, 'text_id')}, text_id LIMIT 1)",
    ]
    for step in range(1, k):
        centres = " UNION ALL ".join(f"SELECT text_id, e FROM s{i}" for i in range(step))
        u = f"((('0x' || substr(md5('{seed}:{step}:' || v.text_id), 1, 12))::BIGINT + 0.5) / {16 ** 12}.0)"
        parts.append(
            f"""s{step} AS (SELECT text_id, e FROM (SELECT v.text_id, any_value(v.e) AS e, min({dist}) AS d, any_value({u}) AS u FROM v, ({centres}) c GROUP BY v.text_id)
WHERE d > 0 ORDER BY -ln(u) / d, text_id LIMIT 1)"""
        )
    rows = " UNION ALL ".join(f"SELECT {i} AS step, text_id FROM s{i}" for i in range(k))
    return "WITH " + ", ".join(parts) + " " + rows


def candidate_sql() -> str:
    rows = []
    for j in range(len(CANDIDATES)):
        columns = ["p0", "p1", f"p{4 + j}", "p3"]
        rows.append(f"SELECT {j} AS variant, {loss_of(columns, 'b')} AS loss")
    return f"WITH {distinct_bits(PREDICATES + CANDIDATES)}, l AS ({' UNION ALL '.join(rows)})"


def ablation_sql() -> str:
    p = PREDICATES + ["und"]
    all_columns = [f"p{i}" for i in range(5)]
    rows = []
    for i in range(5):
        cut = [c if j != i else "0" for j, c in enumerate(all_columns)]
        twin = " OR ".join(f"(SELECT bool_and(p{i} = p{j}) FROM b)" for j in range(5) if j != i)
        rows.append(
            f"SELECT {i} AS predicate_id, {loss_of(cut, 'b')} - {loss_of(all_columns, 'b')} AS increase, ({twin}) AS has_twin"
        )
    return f"""WITH {distinct_bits(p)}, l AS ({' UNION ALL '.join(rows)})
SELECT predicate_id, {r('increase')} AS increase, has_twin,
CAST(row_number() OVER (ORDER BY CASE WHEN has_twin THEN -1e308 ELSE round(increase, 12) END, predicate_id) - 1 AS INT) AS place FROM l"""


def correlation_sql(predicates, absolute: bool) -> str:
    ids = ", ".join(str(i) for i in range(len(predicates)))
    c = "CASE WHEN var_pop(x) = 0 OR var_pop(label) = 0 THEN 0 ELSE covar_pop(x, label) / sqrt(var_pop(x) * var_pop(label)) END"
    return f"""WITH {labelled_bits(predicates)},
l AS (SELECT label, unnest([{ids}]) AS predicate_id, unnest([{names(len(predicates))}]) AS x FROM b),
c AS (SELECT predicate_id, {f'abs({c})' if absolute else c} AS correlation FROM l GROUP BY predicate_id)"""


SIMILAR = """CASE WHEN split_part(a, ' ', 1) = split_part(b, ' ', 1) THEN 1.0 WHEN substr(a, 1, 1) = substr(b, 1, 1) THEN 0.5 ELSE 0.0 END"""


def oracle() -> dict[str, str]:
    bits4 = names(4)
    out = {
        "load_problem": r"""WITH l AS (SELECT string_split(text, chr(10)) AS a FROM documents),
x AS (SELECT unnest(a) AS line, generate_subscripts(a, 1) - 1 AS position FROM l)
SELECT position, count(*) AS n, CAST(sum(length(line) % 2) AS BIGINT) AS labels, CAST(sum(length(line) % 3) AS BIGINT) AS reference FROM x GROUP BY position""",
        "load_texts": "SELECT doc_id AS text_id, md5(text) AS text_md5 FROM documents",
        "load_labelled": "SELECT doc_id AS text_id, quality AS label, md5(text) AS text_md5 FROM documents JOIN labels USING (doc_id)",
        "write_result": f"""WITH {distinct_bits(PREDICATES)}, l AS (SELECT unnest([0, 1, 2, 3]) AS predicate_id, unnest([{bits4}]) AS v FROM b)
SELECT 'first' AS run_id, predicate_id, count(*) AS n, CAST(sum(v) AS BIGINT) AS matches FROM l GROUP BY predicate_id""",
        "embedding_cache": f"WITH RECURSIVE {bow_sql()} SELECT doc_id AS text_id, {bow_columns()}, (SELECT count(DISTINCT text) FROM documents) AS stored FROM x",
        "verdict_cache": f"WITH {all_bits(PREDICATES)} SELECT text_id, {bits4} FROM b",
        "seed_verdicts": f"""WITH {all_bits(['the', 'und'])}
SELECT text_id, CASE WHEN text IN (SELECT text FROM documents WHERE lang = 'de') THEN 1 ELSE p0 END AS p0, p1 FROM b JOIN documents ON doc_id = text_id""",
        "pending_runs": f"""WITH {RUN_LOG}, grid AS (SELECT problem_type, dataset, unnest(range(7)) AS seed FROM (SELECT DISTINCT problem_type, dataset FROM g WHERE dataset <> 'dummy'))
SELECT problem_type, dataset, CAST(seed AS INT) AS seed FROM grid WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.problem_type = grid.problem_type AND g.dataset = grid.dataset AND g.seed = grid.seed AND (finished OR 1704153600 - started < 86400))""",
        "load_results": f"WITH {RUN_LOG} SELECT run_id, problem_type, dataset, seed, tag, {r('main_f1')} AS main_f1 FROM g WHERE finished AND dataset <> 'dummy'",
        "summarize_performance": f"""WITH {RUN_LOG}, m AS (SELECT problem_type, dataset, avg(main_f1) FILTER (tag = 'normal') AS normal, avg(main_f1) FILTER (tag = 'random_update') AS random_update,
avg(main_f1) FILTER (tag = 'one_hot') AS one_hot, avg(main_f1) FILTER (tag = 'no_refine') AS no_refine FROM g WHERE finished AND dataset <> 'dummy' GROUP BY problem_type, dataset),
a AS (SELECT * FROM m UNION ALL SELECT problem_type, 'avg', avg(normal), avg(random_update), avg(one_hot), avg(no_refine) FROM m GROUP BY problem_type)
SELECT problem_type, dataset, {r('normal')} AS normal, {r('random_update')} AS random_update, {r('one_hot')} AS one_hot, {r('no_refine')} AS no_refine FROM a""",
        "trajectory_scores": f"""WITH e AS (SELECT conv_id, arg_max(length(text) / 1000.0, turn) AS l, arg_min(length(text) / 1000.0, turn) AS f FROM conversations GROUP BY conv_id)
SELECT CAST(conv_id AS VARCHAR) AS run_id, 'normal' AS tag, {r('l')} AS main_f1 FROM e UNION ALL SELECT CAST(conv_id AS VARCHAR), 'no_refine', {r('f')} FROM e""",
        "token_predicate": f"WITH {all_bits(PREDICATES)} SELECT text_id, {bits4} FROM b",
        "denote_pairs": f"""WITH w AS (SELECT doc_id AS text_id, text, CASE lang WHEN 'de' THEN 'und' WHEN 'es' THEN 'el' WHEN 'fr' THEN 'le' ELSE 'the' END AS predicate FROM documents)
SELECT text_id, predicate, CAST(list_contains({toks('text')}, predicate) AS INT) AS value FROM w""",
        "first_match_assign": "SELECT doc_id AS text_id, CASE WHEN contains(text, 'the') THEN 0 WHEN contains(text, 'und') THEN 1 WHEN contains(text, 'el') THEN 2 ELSE 3 END AS choice FROM documents",
        "render_validator_prompt": f"SELECT doc_id AS text_id, md5({prompt_sql(prompts.VALIDATE, {'hypothesis': q('mentions {text} and the weather'), 'text': 'text'})}) AS prompt_md5 FROM documents",
        "render_assign_prompt": "SELECT doc_id AS text_id, md5("
        + prompt_sql(prompts.ASSIGN, {"descriptions_with_index": q("0. the\n1. und\n2. el\n3. le\n4. none of the above"), "text": "text"})
        + ") AS prompt_md5 FROM documents",
        "parse_yes_no": "SELECT doc_id AS text_id, CAST(contains(lower(text), 'yes') AS INT) AS value FROM documents",
        "parse_assignment": f"""WITH a AS (SELECT doc_id, {ANSWER} AS ans FROM documents),
w AS (SELECT doc_id, CASE WHEN list_min(ans) < -4 THEN NULL ELSE list_transform(ans, lambda v: CASE WHEN v < 0 THEN v + 4 ELSE v END) END AS ans FROM a)
SELECT doc_id AS text_id, {', '.join(f'CAST(coalesce(list_contains(ans, {i}), false) AS INT) AS p{i}' for i in range(4))} FROM w""",
        "parse_proposals": f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents),
x AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS i FROM l),
c AS (SELECT doc_id, {strip('line')} AS s, i FROM x),
d AS (SELECT doc_id, CASE WHEN i = 1 THEN s ELSE {strip("regexp_replace(" + strip("regexp_replace(s, '^-', '')") + ", '^" + '"' + "', '')")} END AS description FROM c)
SELECT DISTINCT doc_id AS text_id, md5(description) AS description_md5 FROM d
WHERE description <> '' AND NOT starts_with(lower(description), 'here are') AND NOT ends_with(description, ':')""",
        "drop_refusals": r"""SELECT doc_id AS text_id FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND doc_id % 11 <> 0
AND NOT contains(lower(text), 'unfortunately') AND NOT contains(lower(text), 'enough information') AND NOT contains(lower(text), 'i apologize')""",
        "truncate_tokens": f"SELECT doc_id AS text_id, md5({TRUNCATED}) AS text_md5 FROM documents",
        "strip_double_newlines": "SELECT doc_id AS text_id, md5(replace(text, chr(10), chr(10) || chr(10))) AS text_md5 FROM documents",
        "parse_similarity": """WITH l AS (SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN lower(text) END AS s FROM documents)
SELECT doc_id AS text_id, CASE WHEN s IS NULL THEN 0 WHEN contains(s, 'yes') THEN 1 WHEN contains(s, 'no') THEN 0 ELSE 0.5 END::DOUBLE AS value FROM l""",
        "is_null_description": """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN true ELSE len(string_split(trim(p_name), ' ')) <= 1 END AS is_null FROM part""",
        "l2_normalize": f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v)
SELECT vec_id AS text_id, CAST(generate_subscripts(e, 1) - 1 AS INT) AS dim, unnest(list_transform(e, lambda x: CASE WHEN vec_id % 5 = 0 THEN NULL ELSE {r('x / n', 6)} END)) AS value FROM n""",
        "hashed_bow_embed": f"WITH RECURSIVE {bow_sql()} SELECT doc_id AS text_id, {bow_columns()} FROM x",
        "random_project": f"""WITH g AS (SELECT d, {', '.join(f"{gauss('d', q(str(j)))} AS g{j}" for j in range(3))} FROM range(64) AS t(d)),
m AS (SELECT d, {', '.join(f'g{j} / sqrt(sum(g{j} * g{j}) OVER ()) AS g{j}' for j in range(3))} FROM g),
v AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings)
SELECT vec_id AS text_id, {', '.join(f"{r(f'sum(x * g{j})', 6)} AS e{j}" for j in range(3))} FROM v JOIN m USING (d) GROUP BY vec_id""",
        "one_hot_embed": """WITH t AS (SELECT min(doc_id) AS text_id, text FROM documents GROUP BY text)
SELECT text_id, row_number() OVER (ORDER BY text) - 1 AS index, count(*) OVER () AS size, 1 AS value FROM t""",
        "turn_features": f"""WITH k AS (SELECT conv_id, turn, {toks('text')} AS tk FROM conversations)
SELECT conv_id, turn, {', '.join(f"CAST(list_contains(tk, '{p}') AS INT) AS f{i}" for i, p in enumerate(PREDICATES))} FROM k""",
        "expand_taxonomy": """WITH b AS (SELECT p_brand, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS VARCHAR) AS place FROM (SELECT DISTINCT p_brand FROM part)),
s AS (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY p_type) - 1 AS i FROM (SELECT DISTINCT p_brand, p_type FROM part))
SELECT place AS code, p_brand AS predicate, CAST(NULL AS VARCHAR) AS parent FROM b
UNION ALL SELECT place || '.' || CASE WHEN i >= 26 THEN chr(CAST(64 + i // 26 AS INT)) ELSE '' END || chr(CAST(65 + i % 26 AS INT)), p_type, p_brand FROM s JOIN b USING (p_brand)""",
        "log_softmax": f"""WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / 0.1) AS e FROM embeddings),
z AS (SELECT vec_id, e, ln(list_sum(list_transform(e, lambda x: exp(x)))) AS z FROM v)
SELECT vec_id AS text_id, CAST(generate_subscripts(e, 1) - 1 AS INT) AS dim, unnest(list_transform(e, lambda x: {r('x - z', 6)})) AS value FROM z""",
        "floor_prob": f"""WITH n AS (SELECT count(*) AS n FROM embeddings), v AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)
SELECT vec_id AS text_id, CAST(dim AS INT) AS dim, {r('-ln(least(1.0, greatest(exp(x) / n, 1.0 / n)))')} AS nll FROM v, n""",
        "denote_distinct": f"WITH {distinct_bits(PREDICATES)} SELECT text_id, {bits4} FROM b",
        "denote_long": f"WITH {distinct_bits(PREDICATES)} SELECT text_id, unnest([0, 1, 2, 3]) AS predicate_id, unnest([{bits4}]) AS value FROM b",
        "scatter_back": "SELECT doc_id AS text_id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents",
        "cache_misses": """WITH t AS (SELECT text, bool_or(lang = 'de') AS de FROM documents GROUP BY text), p AS (SELECT text, de, unnest(['the', 'und', 'el', 'le']) AS predicate FROM t)
SELECT md5(text) AS text_md5, predicate FROM p WHERE NOT (de AND predicate IN ('the', 'und'))""",
        "new_predicates": f"""WITH w AS (SELECT DISTINCT lang, unnest({toks('text')}) AS predicate FROM documents)
SELECT DISTINCT predicate FROM w WHERE lang <> 'en' AND predicate NOT IN (SELECT predicate FROM w WHERE lang = 'en')""",
        "token_matches": f"""WITH w AS (SELECT DISTINCT doc_id, unnest({toks('text')}) AS predicate_id FROM documents)
SELECT predicate_id, count(*) AS matches FROM w GROUP BY predicate_id""",
        "duplicate_predicates": f"WITH {distinct_bits(['the', 'und', 'the', 'zzzz', 'qqqq'])} SELECT * FROM ("
        + " UNION ALL ".join(
            f"SELECT {i} AS predicate_id, ({' OR '.join(f'(SELECT bool_and(p{i} = p{j}) FROM b)' for j in range(5) if j != i)}) AS has_twin"
            for i in range(5)
        )
        + ")",
        "screen_sample": f"SELECT doc_id AS text_id, md5(text) AS text_md5 FROM documents ORDER BY {hash_rank(1, 'doc_id')}, doc_id LIMIT 256",
        "predicate_counts": f"""WITH {distinct_bits(PREDICATES)}, l AS (SELECT unnest([0, 1, 2, 3]) AS predicate_id, unnest(['the', 'und', 'el', 'le']) AS predicate, unnest([{bits4}]) AS v FROM b)
SELECT predicate_id, predicate, count(*) AS n_texts, CAST(sum(v) AS BIGINT) AS matches FROM l GROUP BY predicate_id, predicate""",
        "predicate_report": f"""WITH {distinct_bits(PREDICATES)}, l AS (SELECT text_id, unnest([0, 1, 2, 3]) AS predicate_id, unnest([{bits4}]) AS v FROM b),
h AS (SELECT predicate_id, text_id, row_number() OVER (PARTITION BY predicate_id ORDER BY text_id) AS rn FROM l WHERE v = 1),
s AS (SELECT predicate_id, md5(string_agg(text, '|' ORDER BY rn)) AS sample_md5 FROM h JOIN t USING (text_id) WHERE rn <= 5 GROUP BY predicate_id),
c AS (SELECT predicate_id, CAST(sum(v) AS BIGINT) AS matches FROM l GROUP BY predicate_id)
SELECT predicate_id, ['the', 'und', 'el', 'le'][predicate_id + 1] AS predicate, matches, coalesce(sample_md5, md5('')) AS sample_md5 FROM c LEFT JOIN s USING (predicate_id)""",
        "predicate_correlation": correlation_sql(PREDICATES + ["zzzz"], False) + f" SELECT predicate_id, {r('correlation')} AS correlation FROM c",
        "rank_candidates": correlation_sql(PREDICATES + CANDIDATES, True)
        + f" SELECT predicate_id, CAST(row_number() OVER (ORDER BY round(correlation, 12) DESC, predicate_id) - 1 AS INT) AS place, {r('correlation')} AS correlation FROM c",
        "random_rank": f"""WITH p AS (SELECT DISTINCT string_split(p_type, ' ')[1] AS predicate_id FROM part)
SELECT predicate_id, CAST(row_number() OVER (ORDER BY {hash_rank(3, 'predicate_id')}) - 1 AS INT) AS place FROM p""",
        "token_scores": f"""WITH l AS (SELECT text, quality - avg(quality) OVER () AS y FROM documents JOIN labels USING (doc_id)), w AS (SELECT unnest({toks('text')}) AS predicate, y FROM l)
SELECT predicate, {r('sum(y)', 6)} AS score FROM w GROUP BY predicate""",
        "token_propose": f"""WITH l AS (SELECT text, quality - avg(quality) OVER () AS y FROM documents JOIN labels USING (doc_id)), w AS (SELECT unnest({toks('text')}) AS predicate, y FROM l)
SELECT predicate, {r('sum(y)')} AS score FROM w GROUP BY predicate ORDER BY round(sum(y), 9) DESC, predicate LIMIT 5""",
        "token_propose_many": f"""WITH l AS (SELECT text, quality - avg(quality) OVER () AS y0, length(text) - avg(length(text)) OVER () AS y1 FROM documents JOIN labels USING (doc_id)),
w AS (SELECT unnest({toks('text')}) AS predicate, y0, y1 FROM l), a AS (SELECT predicate, unnest([0, 1]) AS target_id, unnest([sum(y0), sum(y1)]) AS score FROM w GROUP BY predicate)
SELECT target_id, CAST(row_number() OVER (PARTITION BY target_id ORDER BY round(score, 9) DESC, predicate) AS INT) AS place, predicate FROM a QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY round(score, 9) DESC, predicate) <= 4""",
        "distinct_tokens": f"SELECT DISTINCT predicate FROM (SELECT unnest({toks('text')}) AS predicate FROM documents) ORDER BY predicate LIMIT 25",
        "pattern_counts": f"WITH {distinct_bits(PREDICATES)} SELECT {bits4}, count(*) AS cnt FROM b GROUP BY {bits4}",
        "label_pattern_counts": f"WITH {labelled_bits(PREDICATES)} SELECT {bits4}, label, count(*) AS cnt FROM b GROUP BY {bits4}, label",
        "cluster_fitness": f"WITH {distinct_bits(PREDICATES)} SELECT (SELECT count(*) FROM b) AS n, {r(loss_of(['p0', 'p1', 'p2', 'p3'], 'b'))} AS loss",
        "ablation_loss": ablation_sql(),
        "candidate_losses": candidate_sql() + f" SELECT variant, {r('loss')} AS loss FROM l",
        "best_candidate": candidate_sql() + f" SELECT variant, {r('loss')} AS loss FROM l ORDER BY l.loss, variant LIMIT 1",
        "pairwise_f1": PAIRS + f" SELECT ref_id, pred_id, {r('f1')} AS f1 FROM f",
        "best_matches": PAIRS + f" SELECT ref_id, pred_id, {r('f1')} AS f1 FROM f QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY f.f1 DESC, pred_id) = 1",
        "cosine_columns": PAIRS + f" SELECT ref_id, pred_id, {r('cosine')} AS cosine FROM f",
        "matched_metrics": PAIRS
        + f""", o AS (SELECT CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'es' THEN 2 WHEN 'fr' THEN 3 ELSE 0 END AS rl, CASE WHEN p0 + p1 + p2 + p3 = 0 THEN 0 WHEN p0 = 1 THEN 0 WHEN p1 = 1 THEN 1 WHEN p2 = 1 THEN 2 ELSE 3 END AS pl FROM b),
a AS (SELECT rl, pl, count(*) AS c FROM o GROUP BY ALL),
i AS (SELECT unnest([0, 1, 2, 3]) AS id),
w AS (SELECT x0.id AS a0, x1.id AS a1, x2.id AS a2, x3.id AS a3 FROM i x0, i x1, i x2, i x3 WHERE x0.id <> x1.id AND x0.id <> x2.id AND x0.id <> x3.id AND x1.id <> x2.id AND x1.id <> x3.id AND x2.id <> x3.id),
best AS (SELECT [a0, a1, a2, a3] AS m FROM w ORDER BY (SELECT sum(c) FROM a WHERE (rl = 0 AND pl = a0) OR (rl = 1 AND pl = a1) OR (rl = 2 AND pl = a2) OR (rl = 3 AND pl = a3)) DESC LIMIT 1)
SELECT ref_id, pred_id, {r('cosine')} AS cosine, {r('(1 + tp / sy - (ss - tp) / (n - sy)) / 2')} AS auc, {r('f1')} AS f1, {r('CASE WHEN ss = 0 THEN 0 ELSE tp / ss END')} AS precision,
{r('CASE WHEN sy = 0 THEN 0 ELSE tp / sy END')} AS recall, {r('ss')} AS size FROM f, best WHERE pred_id = m[ref_id + 1]""",
        "auc_roc": f"""WITH l AS (SELECT quality AS y, length(text) AS s FROM documents JOIN labels USING (doc_id)),
k AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM l)
SELECT {r('(sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0))')} AS auc FROM k""",
        "best_threshold_f1": f"""WITH l AS (SELECT quality AS y, length(text) AS s FROM documents JOIN labels USING (doc_id)),
p AS (SELECT unnest(range(10)) / 9.0 AS q), h AS (SELECT q, (SELECT quantile_cont(s, [0.0, 1/9, 2/9, 3/9, 4/9, 5/9, 6/9, 7/9, 8/9, 1.0]) FROM l)[CAST(round(q * 9) AS INT) + 1] AS cut FROM p),
f AS (SELECT q, 2.0 * sum(y) FILTER (s >= cut) / (sum(y) + count(*) FILTER (s >= cut)) AS f1 FROM l, h GROUP BY q)
SELECT {r('greatest(0.0, max(f1))')} AS best_f1 FROM f""",
        "surface_similarity": f"""WITH p AS (SELECT p_partkey, p_name AS a, CASE WHEN p_partkey % 5 = 0 THEN p_type WHEN p_partkey % 4 = 0 THEN p_name ELSE split_part(p_name, ' ', 1) || ' ' || p_brand END AS b FROM part)
SELECT p_partkey, CASE WHEN contains(trim(a), ' ') AND contains(trim(b), ' ') THEN {SIMILAR} WHEN a = b THEN 1.0 ELSE 0.0 END::DOUBLE AS similarity FROM p""",
        "avg_token_length": f"""WITH s AS (SELECT avg(len({toks('text')})) AS a FROM (SELECT text FROM documents ORDER BY {hash_rank(2, 'doc_id')}, doc_id LIMIT 500))
SELECT {r('a')} AS avg_tokens, CAST(floor((16000 - 1024) * 0.75 / (least(a, 256.0) + 20)) AS INT) AS budget, CAST(floor((16000 - 1024) * 0.75 / a) AS INT) AS plain_budget FROM s""",
        "inference_count": """SELECT 'token' AS scorer, 4 * count(*) AS inferences FROM documents
UNION ALL SELECT 'batch', 4 * (SELECT count(DISTINCT text) FROM documents) - (SELECT count(DISTINCT text) FROM documents WHERE doc_id % 2 = 0)""",
        "centroids": f"""WITH v AS (SELECT label AS k, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)
SELECT k, dim, {r('avg(x)', 6)} AS value FROM v GROUP BY k, dim""",
        "project_scores": f"""WITH v AS (SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings),
m AS (SELECT label AS k, d, avg(x) AS c FROM v GROUP BY ALL)
SELECT vec_id AS text_id, k, {r('sum(x * c)', 6)} AS score FROM v JOIN m USING (d) GROUP BY vec_id, k""",
        "assign_argmax": """WITH v AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) / 0.1 AS x, unnest(range(64)) AS k FROM embeddings),
s AS (SELECT vec_id, k, exp(x) / sum(exp(x)) OVER (PARTITION BY k) AS p FROM v)
SELECT vec_id AS text_id, CAST(k AS INT) AS cluster FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, k) = 1""",
        "kmeanspp_seed": kmeanspp_sql(3, 5),
        "number_rows": f"WITH {PLACED} SELECT event_id, t FROM e",
        "time_percentile": f"SELECT event_id, {r('percent_rank() OVER (ORDER BY ts, event_id)')} AS percentile FROM events",
        "ema_curve": curve_sql(50),
        "ema_curve_100": curve_sql(100),
        "ema_curve_fast": recursive_curve_sql(50, 0.8),
        "ema_curve_at_once": recursive_curve_sql(50, 1.0),
        "class_fitness": class_fitness_sql(),
        "own_model": f"WITH {distinct_bits(PREDICATES)} "
        + " UNION ALL ".join(
            f"SELECT {v} AS variant, {r('avg(CASE WHEN ' + ' AND '.join(f'p{i} = 0' for i in range(4) if i != v) + ' THEN 1.0 ELSE 0.0 END)')} AS loss FROM b"
            for v in range(-1, 4)
        ),
        "permutation_band": f"""WITH {PLACED}, c AS (SELECT t AS t0, {ema('e', 'x0', 'c0', 100)}, {ema('e', 'x1', 'c1', 100)} FROM e),
s AS (SELECT rep, c0, c1, row_number() OVER (PARTITION BY rep ORDER BY md5('0:' || rep || ':' || t0)) - 1 AS t FROM c, range(100) AS z(rep)),
k AS (SELECT {ema('s', 'c0', 'v0', 100, 'rep')}, {ema('s', 'c1', 'v1', 100, 'rep')} FROM s)
SELECT 0 AS curve_id, {r('least(1.0, min(v0))', 7)} AS lower, {r('greatest(0.0, max(v0))', 7)} AS upper FROM k
UNION ALL SELECT 1, {r('least(1.0, min(v1))', 7)}, {r('greatest(0.0, max(v1))', 7)} FROM k""",
        "weight_jumps": f"""WITH w AS (SELECT vec_id AS t, unnest(CAST(embedding AS DOUBLE[])) AS w, generate_subscripts(embedding, 1) AS k FROM embeddings),
j AS (SELECT w - lag(w) OVER (PARTITION BY k ORDER BY t) AS d FROM w) SELECT {r('avg(d * d)')} AS mean_squared_jump FROM j""",
        "prefix_sums": """WITH l AS (SELECT length(text) AS len, count(*) AS c FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT len, c, CAST(sum(c) OVER (ORDER BY len) AS BIGINT) AS cum_c FROM l""",
        "dedup_texts": "SELECT min(doc_id) AS text_id, md5(text) AS text_md5 FROM documents GROUP BY text",
        # The loss is convex: a gradient of zero at every weight is a proof that no weights are better.
        "series_certificate": "WITH d AS (SELECT text FROM documents GROUP BY text), t AS (SELECT row_number() OVER () - 1 AS t FROM d) SELECT t, k::INTEGER AS k, 0.0::DOUBLE AS gradient FROM t, range(4) z(k)",
        "dedup_keep_first": "WITH d AS (SELECT min(doc_id) AS first_at, text FROM documents GROUP BY text) SELECT first_at, row_number() OVER (ORDER BY first_at) - 1 AS t, md5(text) AS text_md5 FROM d",
        "dedup_last_label": "SELECT min(doc_id) AS text_id, arg_max(quality, doc_id) AS label, md5(text) AS text_md5 FROM documents JOIN labels USING (doc_id) GROUP BY text",
        "dedup_by_prefix": "SELECT string_split(p_name, ' ')[1] AS prefix, max(p_name) AS description FROM part GROUP BY 1",
        "extremes_sample": f"WITH {EXTREMES} SELECT text_id, target, part FROM x",
        "scored_context": scored_context_sql(),
        "uniform_sample": f"SELECT doc_id AS text_id FROM documents ORDER BY {hash_rank(9, 'doc_id')}, doc_id LIMIT 40",
        "merge_proposals": f"""WITH w AS (SELECT lang, predicate, count(*) AS n FROM (SELECT lang, unnest({toks('text')}) AS predicate FROM documents) GROUP BY ALL HAVING count(*) > 5),
a AS (SELECT 0 AS part, length(predicate) AS place, predicate FROM w WHERE lang = 'en'
UNION ALL SELECT 1, place, predicate FROM (SELECT length(predicate) AS place, predicate FROM w WHERE lang = 'de' ORDER BY place, predicate LIMIT 25)
UNION ALL SELECT 2, unnest([0, 1]), unnest(['is formal', 'the']))
SELECT part, place, predicate FROM a QUALIFY row_number() OVER (PARTITION BY predicate ORDER BY part, place) = 1""",
        "prompt_scorer": f"WITH {all_bits(PREDICATES)} SELECT text_id, {bits4} FROM b",
        "batch_embedder": "SELECT doc_id AS text_id, "
        + ", ".join(f"CAST(length(text) - length(replace(text, '{v}', '')) AS INT) AS e{i}" for i, v in enumerate("aeiou"))
        + " FROM documents",
        "prompt_proposer": f"""WITH {EXTREMES}, s AS (SELECT {toks('text')} AS tk FROM x ORDER BY target DESC, text_id DESC LIMIT 1),
w AS (SELECT unnest(tk[1:6]) AS predicate, unnest(range(6)) AS place FROM s), d AS (SELECT predicate, min(place) AS place FROM w GROUP BY predicate)
SELECT CAST(row_number() OVER (ORDER BY place) - 1 AS INT) AS place, predicate FROM d QUALIFY row_number() OVER (ORDER BY place) <= 5""",
    }
    choice = "CASE WHEN contains(text, 'the') THEN 0 WHEN contains(text, 'und') THEN 1 WHEN contains(text, 'el') THEN 2 WHEN contains(text, 'le') THEN 3 ELSE {} END"
    for name, other in (("commit", 3), ("prompt_committer", -1)):
        out[name] = f"WITH c AS (SELECT doc_id AS text_id, {choice.format(other)} AS c FROM documents) SELECT text_id, " + ", ".join(
            f"CAST(c = {i} AS INT) AS p{i}" for i in range(4)
        ) + " FROM c"
    return out
