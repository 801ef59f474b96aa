"""The same queries in DuckDB's SQL, put together from common table expressions that name what they build on."""

from __future__ import annotations

import re

from ..functions.text import BLOCKERS, LEGAL_TOKENS, PROPOSALS
from ..operators.features import TYPES, UNIT


def norm(x: str) -> str:
    """Names and addresses of Latin text: controls go first, then accents, case, separators, ends, length, the end again."""
    return f"rtrim(left(trim(regexp_replace(lower(strip_accents(regexp_replace({x}, '[\\x00-\\x1f\\x7f]', '', 'g'))), '[^\\pL\\pM\\pN]+', ' ', 'g')), 512))"


def tokens(c: str) -> str:
    return f"[x FOR x IN string_split({c}, ' ') IF x <> '']"


TOKENS = tokens("name_norm")


def grams(c: str, n: int) -> str:
    return f"CASE WHEN length({c}) >= {n} THEN list_distinct([substr({c}, i, {n}) FOR i IN range(1, length({c}) - {n - 2})]) ELSE []::VARCHAR[] END"


def jaccard(x: str, y: str) -> str:
    return f"coalesce(len(list_intersect({x}, {y})) / nullif(len({x}) + len({y}) - len(list_intersect({x}, {y})), 0), 0)::DOUBLE"


def trigram_jaccard(x: str, y: str) -> str:
    return f"CASE WHEN length({x}) < 3 OR length({y}) < 3 THEN {jaccard(grams(x, 1), grams(y, 1))} ELSE {jaccard(grams(x, 3), grams(y, 3))} END"


def suffix(c: str) -> str:
    legal = "[" + ", ".join(f"'{t}'" for t in LEGAL_TOKENS) + "]"
    kept = f"[x FOR x IN {tokens(c)} IF NOT list_contains({legal}, x)]"
    return f"array_to_string(list_sort(list_distinct(CASE WHEN len({kept}) > 0 THEN {kept} ELSE {tokens(c)} END)), ' ')"


def stripped(c: str) -> str:
    legal = "[" + ", ".join(f"'{t}'" for t in LEGAL_TOKENS) + "]"
    kept = f"[x FOR x IN {tokens(c)} IF NOT list_contains({legal}, x)]"
    return f"CASE WHEN len({kept}) > 0 THEN {kept} ELSE {tokens(c)} END"


def md5_bucket(c: str, n: int) -> str:
    return f"(('0x' || substr(md5({c}), 1, 15))::BIGINT % {n})"


def distribution(c: str, prefix: str) -> str:
    qs = ", ".join(f"round(quantile_cont({c}, {q}), 6) AS {prefix}_p{round(q * 100)}" for q in (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99))
    return f"count({c}) AS {prefix}_n, round(avg({c}), 6) AS {prefix}_mean, round(min({c})::DOUBLE, 6) AS {prefix}_min, round(max({c})::DOUBLE, 6) AS {prefix}_max, {qs}"


_F05 = "1.25 * n_hits / nullif(1.25 * n_hits + 0.25 * (n_true - n_hits) + (n_candidates - n_hits), 0)"
MACRO = f"round(avg(CASE WHEN n_true > 0 THEN coalesce({_F05}, 0) WHEN n_candidates > 0 THEN 0 ELSE 1 END), 6) AS macro_f05_score_zero, round(coalesce(avg(coalesce({_F05}, 0)) FILTER (n_true > 0), 0), 6) AS macro_f05_exclude"
_RECALL = "coalesce(avg(n_hits / n_true) FILTER (n_true > 0), 0)"
_MATCHED = "count(*) FILTER (n_true > 0)"
MEASURES = f"""count(*) AS n_s1_entities, {_MATCHED} AS n_s1_with_true_matches, count(*) FILTER (n_true = 0) AS n_s1_with_zero_true_matches, sum(n_true)::BIGINT AS n_true_pairs,
 sum(n_candidates)::BIGINT AS n_candidate_pairs, sum(n_hits)::BIGINT AS true_pairs_retrieved, round(coalesce(sum(n_hits) / nullif(sum(n_true), 0), 0), 6) AS blocking_recall_pair,
 round({_RECALL}, 6) AS macro_recall_entity, round(1.25 * {_RECALL} / (0.25 + {_RECALL}), 6) AS f05_ceiling_from_macro_recall,
 round(coalesce(count(*) FILTER (n_true > 0 AND n_hits >= n_true) / nullif({_MATCHED}, 0), 0), 6) AS s1_full_recall_rate, round(coalesce(count(*) FILTER (n_true > 0 AND n_hits > 0) / nullif({_MATCHED}, 0), 0), 6) AS s1_partial_recall_rate,
 round(sum(n_candidates) / count(*), 6) AS avg_candidates_per_s1, round(coalesce(sum(n_candidates) / nullif({_MATCHED}, 0), 0), 6) AS avg_candidates_per_s1_with_matches,
 round(quantile_cont(n_candidates, 0.5), 6) AS median_candidates_per_s1, round(quantile_cont(n_candidates, 0.99), 6) AS p99_candidates_per_s1, max(n_candidates) AS max_candidates_per_s1,
 count(*) FILTER (n_candidates = 0) AS n_s1_with_zero_candidates, round(count(*) FILTER (n_candidates = 0) / count(*), 6) AS fraction_s1_with_zero_candidates,
 round(coalesce(sum(n_hits) / nullif(sum(n_candidates), 0), 0), 6) AS candidate_precision, round(coalesce(avg({_F05}) FILTER (n_true > 0), 0), 6) AS f05_accept_all_macro,
 round(avg(CASE WHEN n_true > 0 THEN coalesce({_F05}, 0) WHEN n_candidates > 0 THEN 0 ELSE 1 END), 6) AS f05_accept_all_macro_score_zero"""
_P, _R = "(sum(n_hits) / nullif(sum(n_candidates), 0))", "(sum(n_hits) / nullif(sum(n_true), 0))"
ENTITY_METRICS = f"""sum(n_hits)::BIGINT AS true_positives, sum(n_candidates - n_hits)::BIGINT AS false_positives, sum(n_true - n_hits)::BIGINT AS false_negatives, round(coalesce({_P}, 0), 6) AS pair_precision,
 round(coalesce({_R}, 0), 6) AS pair_recall, round(coalesce(1.25 * {_P} * {_R} / nullif(0.25 * {_P} + {_R}, 0), 0), 6) AS pair_f05, round(coalesce(avg(n_hits / n_candidates) FILTER (n_candidates > 0), 0), 6) AS macro_precision_entity,
 round({_RECALL}, 6) AS macro_recall_entity, count(*) FILTER (n_candidates > 0) AS n_entities_with_predictions, count(*) FILTER (n_true = 0) AS n_empty_gt_entities,
 count(*) FILTER (n_true = 0 AND n_candidates > 0) AS n_empty_gt_entities_with_predictions, count(*) FILTER (n_true > 0 AND n_candidates = 0) AS n_matched_entities_with_no_prediction, max(n_candidates) AS max_predictions_per_s1,
 round(avg(n_candidates), 6) AS mean_predictions_per_s1, round(coalesce(avg(n_candidates) FILTER (n_candidates > 0), 0), 6) AS mean_predictions_per_s1_with_predictions"""

_BOTH = "JOIN s1 a ON a.entity_id = p.s1_id JOIN t b ON b.entity_id = p.target_id"
_A, _B = "list_distinct(" + tokens("a.name_norm") + ")", "list_distinct(" + tokens("b.name_norm") + ")"
_DA, _DB = "list_distinct(" + tokens("a.address_norm") + ")", "list_distinct(" + tokens("b.address_norm") + ")"


def _counted(source: str) -> str:
    return f"SELECT st.s1_id, st.row_pos, st.n_true, coalesce(n, 0) AS n_candidates, coalesce(h, 0) AS n_hits FROM st LEFT JOIN (SELECT s1_id, count(*) AS n, sum(is_true)::BIGINT AS h FROM {source} GROUP BY s1_id) USING (s1_id)"


def _rarest(keys: str, df: str, order: str, where: str, on: str) -> str:
    return lambda cap, k: f"SELECT d.source, x.entity_id, x.key, d.df, row_number() OVER (PARTITION BY d.source, x.entity_id ORDER BY d.df, {order}) AS rank FROM {keys} x JOIN {df} d ON {on} WHERE {where} AND d.df <= {cap} QUALIFY rank <= {k}"


_FLAG = "({})::INT"
_NAME = "p"


def _features() -> str:
    none = "''"
    ok = "(a.entity_id IS NOT NULL AND b.entity_id IS NOT NULL)"
    ratio = lambda f: f"least(length(a.{f}), length(b.{f})) / nullif(greatest(length(a.{f}), length(b.{f})), 0)"
    has = lambda kind: f"contains(p.blockers, ':{kind}')::INT"
    values = {
        "name_norm_equal": f"(a.name_norm <> {none} AND a.name_norm = b.name_norm)::INT",
        "name_key_equal": f"(a.name_key <> {none} AND a.name_key = b.name_key)::INT",
        "name_token_jaccard": jaccard(_A, _B),
        "name_char3_jaccard": trigram_jaccard("a.name_key", "b.name_key"),
        "name_length_ratio": f"coalesce({ratio('name_norm')}, 0)",
        "name_token_count_diff": f"abs(len({_A}) - len({_B}))",
        "name_first_token_equal": f"(split_part(a.name_norm, ' ', 1) <> {none} AND split_part(a.name_norm, ' ', 1) = split_part(b.name_norm, ' ', 1))::INT",
        "address_norm_equal": f"(a.address_norm <> {none} AND a.address_norm = b.address_norm)::INT",
        "address_token_jaccard": jaccard(_DA, _DB),
        "address_shared_token_count": f"len(list_intersect({_DA}, {_DB}))",
        "address_length_ratio": f"coalesce({ratio('address_norm')}, 0)",
        "s1_address_missing": f"(a.address_norm = {none})::INT",
        "target_address_missing": f"(b.address_norm = {none})::INT",
        "both_address_missing": f"(a.address_norm = {none} AND b.address_norm = {none})::INT",
        "token_df": "p.token_df",
        "char_jaccard": "p.char_jaccard",
        "blocker_exact_name": has("exact_name"),
        "blocker_token": has("token"),
        "blocker_char_ngram": has("char_ngram"),
        "n_blockers": f"{has('exact_name')} + {has('token')} + {has('char_ngram')}",
        "s1_candidate_count": "count(*) OVER (PARTITION BY p.s1_id)",
        "source_is_s2": "(p.source = 2)::INT",
        "country_equal": f"(a.country_norm <> {none} AND a.country_norm = b.country_norm)::INT",
        "country_missing": f"(a.country_norm = {none} OR b.country_norm = {none})::INT",
    }
    made = [f"round(({v})::FLOAT::DOUBLE, 6) AS {n}" if TYPES[n] == "float" else f"({v})::BIGINT AS {n}" for n, v in values.items()]
    return f"SELECT p.s1_id, p.target_id, p.source, {', '.join(made)}, {ok}::INT AS text_join_ok FROM cand p LEFT JOIN s1 a ON a.entity_id = p.s1_id LEFT JOIN t b ON b.entity_id = p.target_id"


_FEATURES = [n for n in TYPES if n not in ("name_token_set_ratio", "name_token_sort_ratio", "name_partial_ratio")]


def _proposed() -> str:
    none = "[]::VARCHAR[]"
    one = lambda x: f"CASE WHEN {x} <> '' THEN [{x}] ELSE {none} END"
    gram = lambda n: f"CASE WHEN length(name_key) < {n} THEN {one('name_key')} ELSE {grams('name_key', n)} END"
    keys = {
        "token_any": f"list_distinct({TOKENS})",
        "token_sorted": one(f"array_to_string(list_sort(list_distinct({TOKENS})), ' ')"),
        "initials": one(f"array_to_string([x[1] FOR x IN {TOKENS}], '')"),
        "prefix4": one("substr(name_key, 1, 4)"),
        "prefix6": one("substr(name_key, 1, 6)"),
        "prefix8": one("substr(name_key, 1, 8)"),
        "suffix_stripped": one(suffix("name_norm")),
        "suffix_stripped_prefix6": one(f"substr(replace({suffix('name_norm')}, ' ', ''), 1, 6)"),
        "digits_stripped": one("regexp_replace(name_key, '\\p{Nd}', '', 'g')"),
        "address_tokens": f"list_distinct({tokens('address_norm')})",
        "country_prefix6": f"CASE WHEN country_norm <> '' AND name_key <> '' THEN [country_norm || '#' || substr(name_key, 1, 6)] ELSE {none} END",
        "char_2gram_any": gram(2),
        "char_trigram_any": gram(3),
        "char_4gram_any": gram(4),
    }
    assert list(keys) == list(PROPOSALS)
    return " UNION ALL ".join(f"SELECT '{p}' AS p, source, entity_id, unnest({k}) AS key FROM r" for p, k in keys.items())


def _classified(pairs: str) -> str:
    x, y = "a.name_norm", "b.name_norm"
    longest = f"greatest(length({x}), length({y}))"
    cap = f"greatest(3, floor({longest} * 0.6::DOUBLE)::INT + 1)"
    edits = f"least(levenshtein({x}, {y}), {cap} + 1)"
    shared = f"len(list_intersect({_A}, {_B}))"
    content = trigram_jaccard(x, y)
    far = f"{edits} > 0.6::DOUBLE * {longest}"
    rules = [
        (f"{x} <> '' AND {x} = {y}", "exact_normalized_match", "not_applicable"),
        (f"{x} = '' OR {y} = ''", "unknown_other", "missing_name"),
        (f"replace({x}, ' ', '') = replace({y}, ' ', '')", "separator_only", "not_applicable"),
        (f"list_sort({tokens(x)}) = list_sort({tokens(y)})", "token_word_order", "not_applicable"),
        (f"({shared} = len({_A}) OR {shared} = len({_B})) AND len({_A}) <> len({_B})", "token_subset_superset", "not_applicable"),
        (f"{edits} <= 0.15::DOUBLE * {longest}", "typo_small_edit", "not_applicable"),
        (f"{shared} > 0", "unknown_other", "partial_token_overlap"),
        (f"{far} AND {content} <= 0.25", "substantially_different", "not_applicable"),
        (f"{far} OR {content} > 0.25", "unknown_other", "shared_character_content"),
    ]
    case = lambda i, other: "CASE " + " ".join(f"WHEN {r[0]} THEN '{r[i]}'" for r in rules) + f" ELSE '{other}' END"
    return f"SELECT p.s1_id, p.target_id, {case(1, 'unknown_other')} AS category, {case(2, 'no_shared_content')} AS reason, len({tokens(x)}) AS n_tokens_a, len({tokens(y)}) AS n_tokens_b, p.source, a.country_norm AS ca, b.country_norm AS cb FROM {pairs} p {_BOTH}"


def _diagnosed(pairs: str, more: str = "") -> str:
    x, y, kx, ky = "a.name_norm", "b.name_norm", "a.name_key", "b.name_key"
    shared = f"len(list_intersect({_A}, {_B}))"
    initials = lambda c: f"array_to_string([x[1] FOR x IN {tokens(c)}], '')"
    shorter, longer = f"CASE WHEN length({kx}) <= length({ky}) THEN {kx} ELSE {ky} END", f"CASE WHEN length({kx}) <= length({ky}) THEN {ky} ELSE {kx} END"
    content, prefix = trigram_jaccard(kx, ky), f"(({shorter}) <> '' AND starts_with({longer}, {shorter}))"
    legal = f"(({stripped(x)}) = ({stripped(y)}))"
    digits = lambda c: f"regexp_replace({c}, '\\p{{Nd}}', '', 'g')"
    rules = [
        (f"{x} = '' OR {y} = ''", "empty_normalized_name"),
        (f"{x} = {y}", "DEFECT_identical_name_not_retrieved"),
        (f"len({tokens(x)}) > 0 AND list_sort({tokens(x)}) = list_sort({tokens(y)})", "token_reorder_only"),
        (f"len({_A}) > 0 AND len({_B}) > 0 AND ({shared} = len({_A}) OR {shared} = len({_B}))", "token_insertion_or_deletion"),
        (legal, "legal_suffix_variation"),
        (f"{initials(x)} <> '' AND ({initials(x)} = {ky} OR {initials(y)} = {kx})", "abbreviation_initials"),
        (prefix, "prefix_truncation"),
        (f"{shared} > 0", "shares_token_but_not_retrieved"),
        (f"{content} >= 0.3::DOUBLE", "char_overlap_above_threshold_but_not_retrieved"),
        (f"{content} > 0", "char_overlap_below_threshold"),
    ]
    cause = "CASE " + " ".join(f"WHEN {r} THEN '{n}'" for r, n in rules) + " ELSE 'no_lexical_overlap' END"
    return f"""SELECT p.s1_id, p.target_id, {cause} AS primary_cause, {shared} AS shared_tokens, {jaccard(_A, _B)} AS token_jaccard, {content} AS trigram_jaccard,
      coalesce(least(length({kx}), length({ky})) / nullif(greatest(length({kx}), length({ky})), 0), 0) AS char_len_ratio, {legal} AS suffix_stripped_equal, {prefix} AS prefix_relation,
      ({x} <> '' AND {digits(x)} = {digits(y)} AND {x} <> {y}) AS digits_only_diff, {jaccard(_DA, _DB)} AS address_jaccard{more} FROM {pairs} p {_BOTH}"""


_RANKED = {
    "tk": _rarest("tok", "tdf", "d.first", "x.source > 1", "x.source = d.source AND x.key = d.key"),
    "sk": _rarest("tok", "tdf", "d.first", "x.source = 1", "x.key = d.key"),
    "gk": _rarest("gram", "gdf", "d.key", "x.source > 1", "x.source = d.source AND x.key = d.key"),
    "sgk": _rarest("gram", "gdf", "d.key", "x.source = 1", "x.key = d.key"),
}
#: Name -> (what it builds on, SQL).
_CTES: dict[str, tuple[str, str]] = {
    "r": (
        "",
        f"""SELECT *, replace(name_norm, ' ', '') AS name_key FROM (SELECT (1 + doc_id % 3)::INT AS source, 'S' || (1 + doc_id % 3) || '-' || doc_id AS entity_id, doc_id AS row_pos,
        {norm("split_part(coalesce(text, ''), chr(10), 1)")} AS name_norm, {norm("split_part(coalesce(text, ''), chr(10), 2)")} AS address_norm, lower(trim(coalesce(lang, ''))) AS country_norm, md5(text) AS h FROM documents)""",
    ),
    "s1": ("r", "SELECT * FROM r WHERE source = 1"),
    "t": ("r", "SELECT * FROM r WHERE source > 1"),
    "tp": ("s1,t", "SELECT s1.entity_id AS s1_id, t.entity_id AS target_id, t.source FROM s1 JOIN t USING (h)"),
    "st": ("s1,tp", "SELECT s1.entity_id AS s1_id, s1.row_pos, count(tp.target_id) AS n_true FROM s1 LEFT JOIN tp ON tp.s1_id = s1.entity_id GROUP BY ALL"),
    "tok": (
        "r",
        f"SELECT source, entity_id, row_pos, key, row_number() OVER (PARTITION BY entity_id ORDER BY i) - 1 AS pos FROM (SELECT source, entity_id, row_pos, key, min(i) AS i FROM (SELECT source, entity_id, row_pos, unnest({TOKENS}) AS key, generate_subscripts({TOKENS}, 1) AS i FROM r) GROUP BY ALL)",
    ),
    "tt": ("tok", "SELECT * FROM tok WHERE source > 1"),
    "tdf": ("tt", "SELECT source, key, count(*) AS df, min((row_pos, pos)) AS first FROM tt GROUP BY ALL"),
    "gram": ("r", f"SELECT source, entity_id, unnest({grams('name_key', 3)}) AS key FROM r"),
    "gdf": ("gram", "SELECT source, key, count(*) AS df FROM gram WHERE source > 1 GROUP BY ALL"),
    "exact": ("s1,t", "SELECT a.entity_id AS s1_id, b.entity_id AS target_id, b.source FROM s1 a JOIN t b USING (name_norm) WHERE name_norm <> ''"),
    "found": (
        "exact,token,char",
        "SELECT s1_id, target_id, source, 0 AS rank, 'source' || source || ':exact_name' AS label, NULL::DOUBLE AS token_df, NULL::DOUBLE AS char_jaccard FROM exact UNION ALL SELECT s1_id, target_id, source, 1, 'source' || source || ':token', token_df, NULL FROM token UNION ALL SELECT s1_id, target_id, source, 2, 'source' || source || ':char_ngram', NULL, char_jaccard FROM char",
    ),
    "cand": ("found", "SELECT s1_id, target_id, source, string_agg(label, ',' ORDER BY rank) AS blockers, min(token_df) AS token_df, min(char_jaccard) AS char_jaccard FROM found GROUP BY ALL"),
    "marked": ("cand,tp,st,t", "SELECT c.*, (x.s1_id IS NOT NULL)::INT AS is_true FROM cand c LEFT JOIN tp x ON x.s1_id = c.s1_id AND x.target_id = c.target_id"),
    "ec": ("marked,st", _counted("marked")),
    "exact_ec": ("exact,tp,st", _counted("(SELECT e.*, (x.s1_id IS NOT NULL)::INT AS is_true FROM exact e LEFT JOIN tp x ON x.s1_id = e.s1_id AND x.target_id = e.target_id)")),
    "hits_at": (
        "marked,st",
        "SELECT k, (SELECT coalesce(sum(is_true), 0)::BIGINT FROM (SELECT is_true, row_number() OVER (PARTITION BY s1_id ORDER BY source, substr(target_id, 4)::BIGINT) AS p FROM marked) WHERE p <= k) AS hits FROM (SELECT unnest([10, 25, 50, 100, 200])::INT AS k)",
    ),
    "feat": ("cand,s1,t", _features()),
    "scored": ("marked,s1,t", f"SELECT p.s1_id, p.target_id, p.source, p.is_true, ({trigram_jaccard('a.name_key', 'b.name_key')})::FLOAT AS score FROM marked p {_BOTH}"),
    "points": ("scored", "SELECT DISTINCT score FROM scored UNION ALL SELECT NULL"),
    "sweep": (
        "scored,st,points",
        f"""SELECT round(score::DOUBLE, 6) AS threshold, sum(n_candidates)::BIGINT AS predicted_rows, sum(n_hits)::BIGINT AS hits, {MACRO}, round(coalesce({_P}, 0), 6) AS pair_precision, round(coalesce({_R}, 0), 6) AS pair_recall,
        round(coalesce(1.25 * {_P} * {_R} / nullif(0.25 * {_P} + {_R}, 0), 0), 6) AS pair_f05, count(*) FILTER (n_true = 0 AND n_candidates > 0) AS n_empty_gt_entities_with_predictions
        FROM (SELECT p.score, st.s1_id, st.n_true, count(x.s1_id) AS n_candidates, coalesce(sum(x.is_true), 0) AS n_hits FROM points p CROSS JOIN st LEFT JOIN scored x ON x.s1_id = st.s1_id AND x.score >= p.score GROUP BY ALL) GROUP BY score""",
    ),
    "decided": ("scored", "SELECT * FROM scored WHERE score >= 0.5::FLOAT"),
    "decided_ec": ("decided,st", _counted("decided")),
    "loose_ec": ("scored,st", _counted("(SELECT * FROM scored WHERE score::DOUBLE >= 0.35::DOUBLE)")),
    "submission": ("s1,decided", "SELECT s1.entity_id AS source1_entity_id, coalesce(m, '') AS matched_entity_ids FROM s1 LEFT JOIN (SELECT s1_id, string_agg(target_id, ',' ORDER BY source, substr(target_id, 4)::BIGINT) AS m FROM (SELECT DISTINCT s1_id, target_id, source FROM decided) GROUP BY s1_id) ON s1_id = s1.entity_id"),
    "adf": ("tdf", "SELECT key, sum(df)::BIGINT AS df FROM tdf GROUP BY key"),
    "sdf": ("tdf,adf", "SELECT 'source' || source AS scope, key, df FROM tdf UNION ALL SELECT 'all', key, df FROM adf"),
    "ps": (
        "tp,s1,t,adf",
        f"""SELECT *, coalesce(addr_shared / nullif(addr_a + addr_b - addr_shared, 0), 0)::DOUBLE AS addr_jaccard, coalesce(addr_shared / nullif(least(addr_a, addr_b), 0), 0)::DOUBLE AS addr_overlap FROM (
        SELECT p.s1_id, p.target_id, p.source, a.name_norm = b.name_norm AS name_equal, coalesce((SELECT min(df) FROM adf WHERE list_contains(list_intersect({_A}, {_B}), key)), 0) AS min_df, len(list_intersect({_A}, {_B})) AS n_shared,
        {trigram_jaccard("a.name_key", "b.name_key")} AS char_jaccard, len({_DA}) AS addr_a, len({_DB}) AS addr_b, len(list_intersect({_DA}, {_DB})) AS addr_shared FROM tp p {_BOTH})""",
    ),
    "sig": ("ps", "SELECT s1_id, target_id, name_equal AS exact, min_df > 0 AND min_df <= 1000 AS token, char_jaccard >= 0.5 AS char, addr_a > 0 AND addr_b > 0 AND addr_jaccard >= 0.5 AS address FROM ps"),
    "census": (
        "st,tok,adf",
        "SELECT st.s1_id, st.n_true, coalesce(n_tokens, 0) AS n_tokens, coalesce(n_present, 0) AS n_present, coalesce(rarest, 0) AS rarest FROM st LEFT JOIN (SELECT entity_id, count(*) AS n_tokens, count(df) AS n_present, min(df) AS rarest FROM tok LEFT JOIN adf USING (key) WHERE source = 1 GROUP BY entity_id) ON entity_id = st.s1_id",
    ),
    "exn": ("s1,t", "SELECT s1.entity_id AS s1_id, coalesce(n, 0) AS n_exact FROM s1 LEFT JOIN (SELECT name_norm, count(*) AS n FROM t WHERE name_norm <> '' GROUP BY name_norm) USING (name_norm)"),
    "zero": ("s1,st", "SELECT s1.* FROM s1 JOIN st ON st.s1_id = s1.entity_id WHERE n_true = 0"),
    "zp": ("zero,t", f"SELECT a.entity_id AS s1_id, len({_DA}) > 0 AND len({_DB}) > 0 AS both_, {jaccard(_DA, _DB)} AS j FROM zero a JOIN t b USING (name_norm) WHERE name_norm <> ''"),
    "cls": ("cand,s1,t", _classified("cand")),
    "tcls": ("tp,s1,t", _classified("tp")),
    "diag": ("cand,s1,t", _diagnosed("cand")),
    "missed": ("cand,tp", "SELECT s1_id, target_id, source FROM tp ANTI JOIN cand USING (s1_id, target_id)"),
    "mdiag": ("missed,s1,t", _diagnosed("missed")),
    "grouped": ("missed,cand,tp", "SELECT *, 'missed' AS grp FROM missed UNION ALL SELECT s1_id, target_id, source, 'recovered' FROM tp SEMI JOIN cand USING (s1_id, target_id)"),
    "bdiag": ("grouped,s1,t", _diagnosed("grouped", ', p.grp AS "group"')),
    "scored_tok": ("marked,s1,t", f"SELECT p.s1_id, p.target_id, p.source, p.is_true, ({jaccard(_A, _B)})::FLOAT AS score FROM marked p {_BOTH}"),
    "tok_ec": ("scored_tok,st", _counted("(SELECT * FROM scored_tok WHERE score >= 0.5::FLOAT)")),
    "suffixed": ("r,s1,t", f"SELECT a.entity_id AS s1_id, b.entity_id AS target_id, b.source FROM (SELECT *, {suffix('name_norm')} AS k FROM s1) a JOIN (SELECT *, {suffix('name_norm')} AS k FROM t) b USING (k) WHERE k <> ''"),
    "masked4": (
        "exact,token,char,suffixed,tp",
        "SELECT f.s1_id, f.target_id, bit_or(f.m) AS mask, max((x.s1_id IS NOT NULL)::INT) AS is_true FROM (SELECT s1_id, target_id, 1 AS m FROM exact UNION ALL SELECT s1_id, target_id, 2 FROM token UNION ALL SELECT s1_id, target_id, 4 FROM char UNION ALL SELECT s1_id, target_id, 8 FROM suffixed) f LEFT JOIN tp x ON x.s1_id = f.s1_id AND x.target_id = f.target_id GROUP BY f.s1_id, f.target_id",
    ),
    "masked": ("marked", "SELECT *, contains(blockers, ':exact_name')::INT + 2 * contains(blockers, ':token')::INT + 4 * contains(blockers, ':char_ngram')::INT AS mask FROM marked"),
    "prop": ("r,tp", _proposed()),
}


def _cte(name: str, done: dict[str, str]) -> None:
    """Adds a common table expression and what it builds on; ``tk(20,3)`` and the like have a cap and a number of keys."""
    base, _, rest = name.partition("(")
    if base in done:
        return
    cap, k = (int(x) for x in rest.rstrip(")").split(",")) if rest else ((1000, 1) if base in ("token", "tk", "sk") else (1000, 5))
    if base in _RANKED:
        for n in ("tdf", "tok") if base in ("tk", "sk") else ("gdf", "gram"):
            _cte(n, done)
        done[base] = _RANKED[base](cap, k)
    elif base == "token":
        for n in (f"tk({cap},{k})", f"sk({cap},{k})"):
            _cte(n, done)
        done[base] = "SELECT a.entity_id AS s1_id, b.entity_id AS target_id, b.source, min(b.df)::DOUBLE AS token_df FROM sk a JOIN tk b USING (source, key) GROUP BY ALL"
    elif base == "char":
        for n in (f"gk({cap},{k})", f"sgk({cap},{k})", "s1", "t"):
            _cte(n, done)
        pairs = "(SELECT DISTINCT x.entity_id AS s1_id, y.entity_id AS target_id, y.source FROM sgk x JOIN gk y USING (source, key)) p"
        done[base] = f"SELECT * FROM (SELECT p.s1_id, p.target_id, p.source, {jaccard(grams('a.name_key', 3), grams('b.name_key', 3))} AS char_jaccard FROM {pairs} {_BOTH}) WHERE char_jaccard >= 0.3::DOUBLE"
    else:
        needs, sql = _CTES[base]
        for n in re.findall(r"\w+(?:\(\d+,\d+\))?", needs):
            _cte(n, done)
        done[base] = sql


def q(needs: str, body: str) -> str:
    done: dict[str, str] = {}
    for n in re.findall(r"\w+(?:\(\d+,\d+\))?", needs):
        _cte(n, done)
    for n in ("s1", "t"):
        _cte(n, done)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({sql})" for n, sql in done.items()) + "\n" + body


def feature_stats() -> str:
    rows = " UNION ALL ".join(f"SELECT '{n}' AS feature, count(*) AS n, count(*) - count({n}) AS n_missing, round(min({n})::DOUBLE, 6) AS least, round(max({n})::DOUBLE, 6) AS greatest, {f'coalesce(min({n}) >= 0 AND max({n}) <= 1, true)' if n in UNIT else 'NULL::BOOLEAN'} AS in_unit_interval FROM feat" for n in _FEATURES)
    return q("feat", rows)


def operating_point() -> str:
    return """SELECT 'score_zero' AS policy, threshold AS chosen_threshold, macro_f05_score_zero AS chosen_macro_f05, round(top / 1000000, 6) AS best_macro_f05, predicted_rows AS chosen_predicted_rows, i AS chosen_index, best AS best_index, high - low + 1 AS plateau_points
    FROM (SELECT *, coalesce((SELECT max(i) FROM w WHERE micro < top - 2000 AND i < best) + 1, 0) AS low, coalesce((SELECT min(i) FROM w WHERE micro < top - 2000 AND i > best) - 1, (SELECT max(i) FROM w)) AS high
          FROM (SELECT *, (SELECT max(micro) FROM w) AS top, (SELECT min(i) FROM w WHERE micro = (SELECT max(micro) FROM w)) AS best FROM w))
    WHERE i = (low + high) // 2""".replace("FROM w", "FROM (SELECT *, row_number() OVER (ORDER BY predicted_rows) - 1 AS i, round(macro_f05_score_zero * 1000000)::BIGINT AS micro FROM sweep) w")


def submission_checks() -> str:
    ids = "[x FOR x IN string_split(matched_entity_ids, ',') IF x <> '']"
    checks = {
        "exactly_one_row_per_s1_entity": "(SELECT count(*) FROM submission) = (SELECT count(*) FROM s1)",
        "row_count_matches_the_s1_file": "(SELECT count(*) FROM submission) = (SELECT count(*) FROM s1)",
        "the_s1_file_is_not_empty": "(SELECT count(*) FROM s1) > 0",
        "no_duplicate_s1_ids": "(SELECT count(DISTINCT source1_entity_id) FROM submission) = (SELECT count(*) FROM submission) AND (SELECT count(DISTINCT entity_id) FROM s1) = (SELECT count(*) FROM s1)",
        "no_s1_entity_dropped": "(SELECT count(*) FROM scored WHERE s1_id NOT IN (SELECT entity_id FROM s1)) = 0",
        "every_row_is_singleton_or_matched": "true",
        "predictions_are_valid_target_ids": f"(SELECT count(*) FROM (SELECT unnest({ids}) AS x FROM submission) WHERE NOT regexp_matches(x, '^S[23]-')) = 0",
        "predictions_within_selected_rows": f"(SELECT sum(len({ids})) FROM submission) <= (SELECT count(*) FROM decided)",
        "selected_within_scored_rows": "(SELECT count(*) FROM decided) <= (SELECT count(*) FROM scored)",
    }
    return q("submission,scored,decided", " UNION ALL ".join(f"SELECT '{n}' AS name, {w} AS holds" for n, w in checks.items()))


def address_overlap() -> str:
    both = "addr_a > 0 AND addr_b > 0"
    return f"""SELECT scope, pair_group, count(*) AS n_pairs, count(*) FILTER ({both}) AS n_both, count(*) FILTER (addr_shared = 0) AS n_zero_shared, count(*) FILTER (addr_shared >= 1) AS n_1_shared, count(*) FILTER (addr_shared >= 2) AS n_2_shared,
    count(*) FILTER (addr_shared >= 3) AS n_3_shared, count(*) FILTER ({both} AND addr_jaccard >= 0.5) AS n_jaccard_50, count(*) FILTER ({both} AND addr_jaccard >= 0.8::DOUBLE) AS n_jaccard_80,
    count(*) FILTER ({both} AND addr_overlap >= 0.8::DOUBLE) AS n_overlap_80, count(*) FILTER ({both} AND addr_overlap >= 1) AS n_overlap_100, round(avg(addr_shared), 6) AS mean_shared, round(avg(addr_jaccard) FILTER ({both}), 6) AS mean_jaccard
    FROM (SELECT *, unnest([x FOR x IN ['all', CASE WHEN {both} THEN 'both_addresses_present' END, CASE WHEN name_equal THEN 'name_norm_identical' ELSE 'name_norm_differs' END] IF x IS NOT NULL]) AS pair_group
          FROM (SELECT *, unnest(['all', 'source' || source]) AS scope FROM ps)) GROUP BY ALL"""


def census_summary() -> str:
    return f"""SELECT count(*) AS n_entities, count(*) FILTER (NOT usable) AS n_structural_zero, count(*) FILTER (n_tokens = 0) AS n_empty_name, count(*) FILTER (n_tokens > 0 AND n_present = 0) AS n_no_token_in_targets,
    count(*) FILTER (n_present > 0 AND NOT usable) AS n_every_token_above_cap, sum(est)::BIGINT AS total_estimate, {distribution("est", "est")}, round(coalesce(sum(est) FILTER (n_true > 0) / nullif(sum(n_true), 0), 0), 6) AS candidates_per_true_pair,
    count(*) FILTER (n_true > 0 AND est < n_true) AS n_below_one, count(*) FILTER (n_true > 0 AND est = 0) AS n_matched_without_candidates
    FROM (SELECT *, rarest > 0 AND rarest <= 1000 AS usable, CASE WHEN rarest > 0 AND rarest <= 1000 THEN rarest ELSE 0 END AS est FROM census)"""


def zero_match_risk() -> str:
    return """SELECT count(*) AS n_zero_match_entities, count(*) FILTER (n > 0) AS n_exact_name_norm, count(*) FILTER (k > n) AS n_name_key_only, count(*) FILTER (k = 0) AS n_no_candidate, sum(n)::BIGINT AS n_candidate_pairs, max(n) AS max_candidates,
    (SELECT count(*) FILTER (both_) FROM zp) AS n_both_addresses, (SELECT count(*) FILTER (both_ AND j = 0) FROM zp) AS n_zero_overlap, (SELECT count(*) FILTER (NOT both_) FROM zp) AS n_address_missing,
    (SELECT count(*) FROM (SELECT s1_id FROM zp WHERE both_ GROUP BY s1_id HAVING max(j) >= 0.5)) AS n_with_address_support
    FROM (SELECT z.entity_id, coalesce(a.n, 0) AS n, coalesce(b.n, 0) AS k FROM zero z LEFT JOIN (SELECT name_norm, count(*) AS n FROM t WHERE name_norm <> '' GROUP BY name_norm) a USING (name_norm) LEFT JOIN (SELECT name_key, count(*) AS n FROM t WHERE name_key <> '' GROUP BY name_key) b USING (name_key))"""


def blocker_table(kinds: int = 3, masked: str = "masked") -> str:
    rows = []
    for i, k in enumerate(BLOCKERS[:kinds]):
        has = f"mask & {1 << i} > 0"
        rows.append(
            f"""SELECT '{k}' AS blocker, count(*) FILTER (is_true = 1 AND {has}) AS true_pairs_recovered, round(count(*) FILTER (is_true = 1 AND {has}) / (SELECT count(*) FROM tp), 6) AS true_pair_recall, count(*) FILTER ({has}) AS candidate_rows,
            round(count(*) FILTER ({has}) / count(*), 6) AS share_of_candidate_rows, round(coalesce(count(*) FILTER (is_true = 1 AND {has}) / nullif(count(*) FILTER ({has}), 0), 0), 6) AS candidate_precision,
            count(*) FILTER (is_true = 1 AND mask = {1 << i}) AS pairs_only_this_blocker_finds, count(*) FILTER (mask = {1 << i}) AS rows_where_only_this_blocker_fires FROM {masked}"""
        )
    return " UNION ALL ".join(rows)


def entity_accounting() -> str:
    return f"""SELECT count(*) AS entities_scored, {_MATCHED} AS entities_with_true_matches, count(*) FILTER (n_true > 0 AND n_hits = n_true) AS entities_fully_covered, count(*) FILTER (n_hits > 0 AND n_hits < n_true) AS entities_partially_covered,
    count(*) FILTER (n_true > 0 AND n_hits = 0) AS entities_with_zero_recovered, count(*) FILTER (n_candidates = 0) AS entities_with_zero_candidates, count(*) FILTER (n_candidates = 0 AND n_true > 0) AS entities_with_zero_candidates_and_matches,
    coalesce(sum(n_candidates) FILTER (n_true = 0), 0)::BIGINT AS candidate_rows_on_no_match_entities, round(quantile_cont(n_candidates, 0.5), 6) AS rows_p50, round(quantile_cont(n_candidates, 0.9), 6) AS rows_p90, round(quantile_cont(n_candidates, 0.99), 6) AS rows_p99,
    round({_RECALL}, 6) AS macro_recall, round(1.25 * {_RECALL} / (0.25 + {_RECALL}), 6) AS f05_ceiling, max(n_true - n_hits) AS missed_max,
    (SELECT round(coalesce(sum(m) FILTER (r <= greatest(1, k // 10)), 0) / coalesce(nullif(sum(m), 0), 1), 6) FROM (SELECT n_true - n_hits AS m, row_number() OVER (ORDER BY n_true - n_hits DESC, s1_id) AS r, count(*) OVER () AS k FROM ec WHERE n_true > n_hits)) AS missed_pairs_worst_decile_share
    FROM ec"""


def _grid(caps, ks) -> str:
    return "(VALUES " + ", ".join(f"({c}, {k})" for c in caps for k in ks) + ") g(df_cap, rarest_k)"


def volume_bound_body(kind: str, caps, ks) -> str:
    s, t = ("sk", "tk") if kind == "token" else ("sgk", "gk")
    return f"""SELECT g.df_cap, g.rarest_k, coalesce(sum(n), 0)::BIGINT AS bound, count(DISTINCT x.entity_id) AS s1_reached FROM {_grid(caps, ks)} LEFT JOIN (
        SELECT g.df_cap, g.rarest_k, s.entity_id, p.n FROM {_grid(caps, ks)} JOIN {s} s ON s.df <= g.df_cap AND s.rank <= g.rarest_k
        JOIN (SELECT g.df_cap, g.rarest_k, source, key, count(*) AS n FROM {_grid(caps, ks)} JOIN {t} ON df <= g.df_cap AND rank <= g.rarest_k GROUP BY ALL) p ON p.df_cap = g.df_cap AND p.rarest_k = g.rarest_k AND p.source = s.source AND p.key = s.key) x
        ON x.df_cap = g.df_cap AND x.rarest_k = g.rarest_k GROUP BY ALL"""


def volume_bound(caps, ks) -> str:
    loose = f"({max(caps)},{max(ks)})"
    return q(f"tk{loose},sk{loose}", volume_bound_body("token", caps, ks))


def _pairs_in_cells(kind: str, caps, ks) -> str:
    s, t = ("sk", "tk") if kind == "token" else ("sgk", "gk")
    return f"SELECT DISTINCT g.df_cap, g.rarest_k, s.entity_id AS s1_id, x.entity_id AS target_id FROM {_grid(caps, ks)}, {s} s JOIN {t} x USING (source, key) WHERE s.df <= g.df_cap AND s.rank <= g.rarest_k AND x.rank <= g.rarest_k"


def token_grid(caps, ks) -> str:
    loose = f"({max(caps)},{max(ks)})"
    return q(
        f"tk{loose},sk{loose},tp",
        f"SELECT df_cap, rarest_k, count(*) AS n_candidates, count(x.s1_id) AS true_pairs, count(DISTINCT c.s1_id) AS s1_reached, round(count(x.s1_id) / (SELECT count(*) FROM tp), 6) AS recall, round(count(x.s1_id) / count(*), 6) AS precision FROM ({_pairs_in_cells('token', caps, ks)}) c LEFT JOIN tp x ON x.s1_id = c.s1_id AND x.target_id = c.target_id GROUP BY ALL",
    )


def char_grid(caps, ks, jaccards) -> str:
    loose = f"({max(caps)},{max(ks)})"
    pairs = "SELECT * FROM cells JOIN alike USING (s1_id, target_id)"
    ctes = q(f"gk{loose},sgk{loose},tp,s1,t", "").rstrip() + f",\ncells AS MATERIALIZED ({_pairs_in_cells('char', caps, ks)}),\nalike AS MATERIALIZED (SELECT p.*, {jaccard(grams('a.name_key', 3), grams('b.name_key', 3))} AS j FROM (SELECT DISTINCT s1_id, target_id FROM cells) p {_BOTH})\n"
    return ctes + (
        f"SELECT df_cap, rarest_k, min_jaccard, count(*) AS n_candidates, count(x.s1_id) AS true_pairs, count(DISTINCT c.s1_id) AS s1_reached, round(count(x.s1_id) / (SELECT count(*) FROM tp), 6) AS recall, round(count(x.s1_id) / count(*), 6) AS precision FROM ({pairs}) c JOIN (SELECT unnest({list(jaccards)})::DOUBLE AS min_jaccard) ON j >= min_jaccard LEFT JOIN tp x ON x.s1_id = c.s1_id AND x.target_id = c.target_id GROUP BY ALL"
    )


def incremental_token(caps, ks) -> str:
    loose = f"({max(caps)},{max(ks)})"
    return q(
        f"tk{loose},sk{loose},tp,exact,char",
        f"""SELECT df_cap, rarest_k, count(*) AS n_true_pairs, count(*) FILTER (e) AS exact, count(*) FILTER (c) AS char, count(*) FILTER (t) AS token, count(*) FILTER (e OR t) AS token_plus_exact, count(*) FILTER (e OR c) AS exact_plus_char,
        count(*) FILTER (e OR c OR t) AS exact_char_token, count(*) FILTER (e OR c OR t) - count(*) FILTER (e OR c) AS additional,
        round((count(*) FILTER (e OR c OR t) - count(*) FILTER (e OR c)) / nullif(count(*) - count(*) FILTER (e OR c), 0), 6) AS additional_on_misses
        FROM (SELECT g.df_cap, g.rarest_k, (x.s1_id, x.target_id) IN (SELECT (s1_id, target_id) FROM exact) AS e, (x.s1_id, x.target_id) IN (SELECT (s1_id, target_id) FROM char) AS c,
              (g.df_cap, g.rarest_k, x.s1_id, x.target_id) IN (SELECT (df_cap, rarest_k, s1_id, target_id) FROM ({_pairs_in_cells('token', caps, ks)})) AS t FROM tp x, {_grid(caps, ks)}) GROUP BY ALL""",
    )


SUMMARISED = ("shared_tokens", "token_jaccard", "trigram_jaccard", "char_len_ratio", "suffix_stripped_equal", "prefix_relation", "digits_only_diff")


def diagnosis_summary(of: str = "diag", by: str = "") -> str:
    keys, end = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    rows = " UNION ALL ".join(
        f"SELECT {keys}'{f}' AS field, round(coalesce(avg({f}::DOUBLE), 0), 6) AS mean, round(coalesce(quantile_cont({f}::DOUBLE, 0.5), 0), 6) AS p50, round(coalesce(quantile_cont({f}::DOUBLE, 0.9), 0), 6) AS p90, round(coalesce(avg(({f}::DOUBLE <> 0)::INT), 0), 6) AS share_nonzero FROM {of}{end}"
        for f in SUMMARISED
    )
    return q(of, rows)


def proposal_value(recall: str, growth: str) -> str:
    """Both queries joined; the candidates are counted anew."""
    return f"""SELECT a.*, b.candidate_rows, round(b.candidate_rows / (SELECT count(*) FROM ({q("cand", "SELECT * FROM cand")})), 6) AS growth_factor, round(coalesce(a.true_pairs_recovered / nullif(b.candidate_rows, 0), 0), 6) AS candidate_precision,
    round(coalesce(1.25 * a.macro_entity_recall * 0.8957 / nullif(0.25 + a.macro_entity_recall * 0.8957, 0), 0), 6) AS f05_ceiling_at_retention FROM ({recall}) a JOIN ({growth}) b USING (proposal)"""


def calibrated(kind: str, caps, ks, jaccards=()) -> str:
    """Every set of blockers in every cell, for both parts of the split and all entities; no cell is over the budget."""
    loose, grid = f"({max(caps)},{max(ks)})", _grid(caps, ks)
    bound = "(" + volume_bound_body(kind, caps, ks) + ")"
    cells = f"cells AS MATERIALIZED ({_pairs_in_cells(kind, caps, ks)})"
    if kind == "token":
        needs = f"tk{loose},sk{loose},tp,st,exact,char"
        parts = {"exact": f"SELECT df_cap, rarest_k, s1_id, target_id FROM exact, {grid}", "token": "SELECT df_cap, rarest_k, s1_id, target_id FROM cells", "char": f"SELECT df_cap, rarest_k, s1_id, target_id FROM char, {grid}"}
        sets = {"exact": ("exact",), "char": ("char",), "token": ("token",), "token_plus_exact": ("exact", "token"), "exact_plus_char": ("exact", "char"), "exact_char_token": ("exact", "char", "token")}
        rows = " UNION ALL ".join(f"SELECT '{n}' AS candidate_set, NULL::DOUBLE AS min_jaccard, * FROM ({' UNION '.join(parts[p] for p in of)})" for n, of in sets.items())
        more = ""
    else:
        needs = f"gk{loose},sgk{loose},tp,st,exact,s1,t"
        more = f", alike AS MATERIALIZED (SELECT p.*, {jaccard(grams('a.name_key', 3), grams('b.name_key', 3))} AS j FROM (SELECT DISTINCT s1_id, target_id FROM cells) p {_BOTH})"
        levels = f"(SELECT unnest({list(jaccards)})::DOUBLE AS min_jaccard)"
        char = f"SELECT min_jaccard, df_cap, rarest_k, s1_id, target_id FROM cells JOIN alike USING (s1_id, target_id) JOIN {levels} ON j >= min_jaccard"
        rows = f"SELECT 'char' AS candidate_set, * FROM ({char}) UNION ALL SELECT 'char_plus_exact', * FROM ({char} UNION SELECT min_jaccard, df_cap, rarest_k, s1_id, target_id FROM exact, {grid}, {levels})"
    split = f"CASE WHEN {md5_bucket('s1_id', 1000000)} < 200000 THEN 'val' ELSE 'train' END"
    return (
        q(needs, "").rstrip()
        + f""",
{cells}{more}, own AS MATERIALIZED ({rows}), sp AS (SELECT s1_id, n_true, {split} AS part FROM st),
marks AS (SELECT own.*, sp.part, (x.s1_id IS NOT NULL)::INT AS is_true FROM own JOIN sp USING (s1_id) LEFT JOIN tp x ON x.s1_id = own.s1_id AND x.target_id = own.target_id)
SELECT b.df_cap, b.rarest_k, b.bound, true AS evaluated, m.candidate_set, m.min_jaccard, y.split, count(*) FILTER ({_IN}) AS n_candidates, count(*) FILTER ({_IN} AND is_true = 1) AS true_pairs,
count(DISTINCT CASE WHEN {_IN} THEN m.s1_id END) AS s1_reached, round(coalesce(count(*) FILTER ({_IN} AND is_true = 1) / nullif(any_value(y.n), 0), 0), 6) AS recall,
round(coalesce(count(*) FILTER ({_IN} AND is_true = 1) / nullif(count(*) FILTER ({_IN}), 0), 0), 6) AS precision
FROM {bound} b JOIN marks m ON m.df_cap = b.df_cap AND m.rarest_k = b.rarest_k,
(SELECT 'all' AS split, (SELECT sum(n_true) FROM sp) AS n UNION ALL SELECT part, sum(n_true) FROM sp GROUP BY part) y GROUP BY ALL"""
    )


_IN = "(y.split = 'all' OR y.split = m.part)"
