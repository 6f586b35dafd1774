"""The same queries as SQL for DuckDB."""

from __future__ import annotations

from inkroll.operators import thresholds as TH

# The word lists once more, so that a slip in one place shows.
ORG_KEYWORDS = (
    "academy administration agency association biology center centre centro chemistry clinic collaboration collaboratory college company consortium corporation department dept division engineering faculty foundation gmbh group "
    "hospital inc institut institute institution lab laboratoire laboratories laboratory labs llc ltd mathematics medicine ministry observatory physics program programme project research sa school science sciences society srl team "
    "unit universidad universitat university université zentrum"
).split()
ORG_PHRASES = [
    "center for", "centre for", "cern", "cnrs", "department of", "faculty of", "institute of", "max planck", "nasa", "national laboratory", "research group", "school of", "the collaboration", "the consortium", "university of", "working group",
]
CONNECTORS = "and at by da das de del della den der di dos du for in la le of on ten ter the van von with".split()
PARTICLES = "al bin da das de del della den der di dos du el ibn la le ten ter van von".split()
COLLABORATION = "collaboration collaborations consortium experiment group project survey team working".split()

PAIRS = TH.parse_pairs(TH.DEFAULT_PAIRS)
WS = r"[\x{0009}-\x{000D}\x{001C}-\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
TRIM = ".,;:()[]{}<>\"“”‘’"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(values: list[str]) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def spaces(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'), ' ')"


SPLIT = f"""
cleaned as (select line_no, id, {spaces("translate(regexp_replace(authors, '\\([^)]*\\)', ' ', 'g'), chr(10) || chr(9), '  ')")} a from raw_records where authors is not null and authors <> ''),
unified as (select line_no, id, regexp_replace(regexp_replace(a, '{WS}*[;|]{WS}*', ',', 'g'), '(?i){WS}+and{WS}+', ',', 'g') a from cleaned),
parts as (select line_no, id, list_filter(list_transform(string_split(a, ','), lambda x: {spaces(f"trim({spaces('x')}, ' .;:-')")}), lambda x: x <> '') p from unified),
cand as (select line_no, id, unnest(range(0, len(p))) as position, unnest(p) as candidate from parts)"""

TOKENS = f"list_filter(list_transform(string_split({spaces('candidate')}, ' '), lambda x: trim(x, {q(TRIM)})), lambda x: x <> '')"
PIECE = r"regexp_matches(trim(x, " + q(TRIM) + r"), '^[\p{L}\-''’]*\p{L}[\p{L}\-''’]*$')"
MIXED = r"regexp_matches(x, '^\p{Lu}.*\p{Ll}')"
UPPER = "(len(x) > 1 and upper(x) = x and lower(x) <> x)"


def count(source: str, test: str) -> str:
    return f"len(list_filter({source}, lambda x: {test}))"


def features(keys: str, source: str, ner: str = "ner_label") -> str:
    """CTE ``f`` with the features."""
    phrases = " + ".join(f"cast(contains(cl, {q(p)}) as int)" for p in ORG_PHRASES)
    return f"""
t as (select {keys}, candidate, {ner} as ner, {spaces("candidate")} c, lower({spaces("candidate")}) cl, {TOKENS} tk, list_transform({TOKENS}, lambda x: lower(x)) lt from {source}),
f as (select {keys}, candidate, c,
  len(tk) token_count, len(c) char_count, ln(1 + len(c)) log_char_count,
  {count("lt", f"list_contains({words(ORG_KEYWORDS)}, x)")} org_keyword_count, {count("lt", f"list_contains({words(CONNECTORS)}, x)")} connector_count,
  {count("lt", f"list_contains({words(PARTICLES)}, x)")} particle_count, {count("lt", f"list_contains({words(COLLABORATION)}, x)")} collaboration_count,
  {phrases} org_phrase_count, 0 initial_count, {count("tk", PIECE)} alpha_name_piece_count, {count("tk", UPPER)} uppercase_tokens, {count("tk", f"(len(x) > 1 and {MIXED})")} titlecase_tokens,
  cast(regexp_matches(c, '\\p{{Nd}}') as int) has_digit, cast(regexp_matches(c, '[^ ]+@[^ ]+') as int) has_email, cast(regexp_matches(cl, 'https?://|www\\.') as int) has_url,
  cast(contains(c, '&') as int) has_ampersand, cast(contains(c, '/') as int) has_slash, cast(contains(c, '-') as int) has_hyphen, cast(contains(c, '''') or contains(c, '’') as int) has_apostrophe,
  cast(len(tk) > 0 and {count("tk", f"not {PIECE}")} = 0 as int) all_tokens_name_like, cast(len(tk) between 2 and 5 as int) plausible_person_length, cast(len(tk) > 6 as int) too_long_for_person,
  cast(starts_with(cl, 'the ') as int) starts_with_the, cast(contains(' ' || cl || ' ', ' of ') as int) contains_of,
  cast({count("lt", f"list_contains({words(COLLABORATION)}, x)")} > 0 or ends_with(cl, 'collaboration') as int) looks_like_collaboration,
  cast(coalesce(ner = 'PERSON', false) as int) ner_is_person, cast(coalesce(ner = 'ORG', false) as int) ner_is_org from t)"""


RULES = [
    ("c = ''", "NON_PERSON", 1.0, "empty"),
    ("has_digit + has_email + has_url > 0", "NON_PERSON", 0.99, "contains digit/email/url"),
    ("looks_like_collaboration = 1", "NON_PERSON", 0.98, "collaboration/group-like"),
    ("org_phrase_count > 0", "NON_PERSON", 0.97, "contains organization phrase"),
    ("org_keyword_count >= 2", "NON_PERSON", 0.96, "multiple organization keywords"),
    ("org_keyword_count >= 1 and contains_of = 1", "NON_PERSON", 0.95, "organization keyword plus 'of'"),
    ("too_long_for_person = 1", "NON_PERSON", 0.93, "too many tokens"),
    ("starts_with_the = 1", "NON_PERSON", 0.92, "starts with 'the'"),
    ("uppercase_tokens >= 1 and char_count <= 8", "NON_PERSON", 0.88, "short acronym-like candidate"),
    ("ner_is_org = 1", "NON_PERSON", 0.8, "NER says ORG"),
    ("plausible_person_length = 1 and all_tokens_name_like = 1 and org_keyword_count = 0 and titlecase_tokens > 0", "PERSON", 0.9, "name-like structure"),
    ("ner_is_person = 1 and plausible_person_length = 1 and org_keyword_count = 0", "PERSON", 0.88, "NER says PERSON and structure plausible"),
    ("token_count = 1", "UNCERTAIN", 0.5, "single-token candidate"),
    ("connector_count > 0 and particle_count = 0", "UNCERTAIN", 0.45, "connector words present"),
    ("true", "UNCERTAIN", 0.5, "ambiguous"),
]


def case(index: int, convert=q) -> str:
    return "case " + " ".join(f"when {r[0]} then {convert(r[index])}" for r in RULES) + " end"


def rules(keys: str, source: str, ner: str = "ner_label") -> str:
    """CTE ``r`` with the rule decision."""
    return features(keys, source, ner) + f", r as (select {keys}, candidate, {case(1)} rule_label, cast({case(2, str)} as double) rule_score, {case(3)} rule_reason from f)"


PROBABILITY = "round(case rule_label when 'PERSON' then rule_score when 'NON_PERSON' then 1 - rule_score else 0.5 end, 10)"
DECIDED = f"with {SPLIT}, {rules('line_no, id, position', 'cand', 'null')}"
SWEEP = "pairs as (" + " union all ".join(f"select cast({p} as double) pt, cast({n} as double) nt, {q(TH.tag(p, n))} tag" for p, n in PAIRS) + ")"
EVERY = f"with {SWEEP}, every as (select s.*, pt, nt, tag, case when person_score >= pt then 'PERSON' when person_score <= nt then 'NON_PERSON' else 'UNCERTAIN' end decision from scored_candidates s cross join pairs)"


# Fields of a CSV that read as missing.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def present(column: str) -> str:
    return f"case when not list_contains({words(MISSING)}, {column}) then {column} end"


LABELLED = f"select candidate, label, {present('ner_label')} ner_label from labelled_candidates where {present('candidate')} is not null and"


def mode(column: str, keys: str, source: str, name: str) -> str:
    """CTE with the usual value per group, ties to the smallest."""
    return f"{name} as (select {keys}, {column} from (select {keys}, {column}, row_number() over (partition by {keys} order by count(*) desc, {column}) k from {source} where {column} is not null group by {keys}, {column}) where k = 1)"


def histogram(source: str, column: str, bins: int, group: str = "1") -> str:
    """Equal-width histogram; ``group`` is a column or a constant."""
    return f"""with x as (select {group} g, cast({column} as double) v from ({source}) where {column} is not null),
b as (select g, case when min(v) = max(v) then min(v) - 0.5 else min(v) end lo, case when min(v) = max(v) then max(v) + 0.5 else max(v) end hi from x group by g),
h as (select x.g, cast(least(floor((v - lo) / ((hi - lo) / {bins})), {bins - 1}) as int) bin, count(*) n from x join b using (g) group by all),
k as (select cast(unnest(range({bins})) as int) bin)
select {"" if group == "1" else f"b.g {group}, "}k.bin, round(lo + k.bin * ((hi - lo) / {bins}), 10) bin_left, round(lo + (k.bin + 1) * ((hi - lo) / {bins}), 10) bin_right, coalesce(n, 0) count
from b cross join k left join h on h.g = b.g and h.bin = k.bin"""


SCORES = "select cast(ner_label = 'PERSON' as int) y, person_score s from scored_candidates where ner_label is not null and person_score is not null"
MATRIX = f"m as (select count(*) filter (y = 0 and s < 0.9) tn, count(*) filter (y = 0 and s >= 0.9) fp, count(*) filter (y = 1 and s < 0.9) fn, count(*) filter (y = 1 and s >= 0.9) tp from ({SCORES}))"
RUNNING = f"""with p as (select s, cast(sum(y) as bigint) pos, cast(sum(1 - y) as bigint) neg from ({SCORES}) group by s),
run as (select s, pos, neg, cast(sum(pos) over (order by s desc) as bigint) tp, cast(sum(neg) over (order by s desc) as bigint) fp, cast(sum(pos) over () as bigint) ap, cast(sum(neg) over () as bigint) an,
  lead(pos) over (order by s desc) npos, lead(neg) over (order by s desc) nneg, row_number() over (order by s desc) k from p)"""


def ratio(a: str, b: str) -> str:
    return f"coalesce(({a}) / nullif(cast({b} as double), 0), 0.0)"


F1 = "case when {p} + {r} = 0 then 0.0 else 2 * ({p}) * ({r}) / ({p} + {r}) end"
P0, R0, P1, R1 = ratio("tn", "tn + fn"), ratio("tn", "tn + fp"), ratio("tp", "tp + fp"), ratio("tp", "tp + fn")
F0, F1_ = F1.format(p=P0, r=R0), F1.format(p=P1, r=R1)
N = "(tn + fp + fn + tp)"
JUDGED = """j as (select candidate, score, label from (select candidate, max(person_score) score from scored_candidates group by candidate)
  join (select candidate, min(label) label from labelled_candidates where label in (0, 1) and candidate is not null group by candidate) using (candidate) where score is not null),
p as (select *, label true_label, cast(score >= 0.9 as int) predicted_label, case when label = 1 then 'PERSON' else 'NON_PERSON' end true_label_name, case when score >= 0.9 then 'PERSON' else 'NON_PERSON' end predicted_label_name from j)"""
GRAMS = f"""w as (select row_number() over () id, list_filter(string_split({spaces("lower(candidate)")}, ' '), lambda x: x <> '') ws from labelled_candidates where candidate is not null),
g as (select id, unnest(flatten(list_transform(ws, lambda x: flatten(list_transform(range(2, least(5, len(x) + 2) + 1), lambda n: list_transform(range(1, len(x) + 2 - n + 2), lambda i: substr(' ' || x || ' ', i, n))))))) gram from w)"""
REJECTED = "(select candidate, person_score score, ner_label from scored_candidates where person_score <= 0.1)"


def summary(source: str, score: str, extra: str = "") -> str:
    return f"select candidate, count(*) frequency, round(avg({score}), 12) mean_score{extra} from {source} where candidate is not null group by candidate"


UNCERTAIN_SUMMARY = f"""with {mode("reason", "candidate", "uncertain_occurrences", "mr")}, {mode("ner_label", "candidate", "uncertain_occurrences", "mn")},
s as ({summary("uncertain_occurrences", "score", ", min(score) min_score, max(score) max_score")})
select s.*, coalesce(mr.reason, '') most_common_reason, coalesce(mn.ner_label, '') most_common_ner_label from s left join mr using (candidate) left join mn using (candidate)"""


def describe(table: str, column: str) -> str:
    c = f'cast("{column}" as double)'
    return f"select count({c}) count, round(avg({c}), 6) mean, round(stddev_samp({c}), 6) std, round(min({c}), 6) min, round(quantile_cont({c}, 0.25), 6) p25, round(quantile_cont({c}, 0.5), 6) p50, round(quantile_cont({c}, 0.75), 6) p75, round(max({c}), 6) max from {table}"


COUNTED = f"{DECIDED} select candidate author, count(*) count from r where rule_label = 'PERSON' group by candidate"
FEATURE_LIST = (
    "token_count char_count org_keyword_count connector_count particle_count collaboration_count org_phrase_count initial_count alpha_name_piece_count uppercase_tokens titlecase_tokens has_digit has_email has_url has_ampersand has_slash "
    "has_hyphen has_apostrophe all_tokens_name_like plausible_person_length too_long_for_person starts_with_the contains_of looks_like_collaboration ner_is_person ner_is_org"
).split()
NAMES = {"person": "PERSON", "nonperson": "NON_PERSON", "uncertain": "UNCERTAIN"}

SQL = {
    "candidates": f"with {SPLIT} select line_no, id, cast(position as int) position, candidate from cand",
    "tokens": f"""with t as (select cand_id, {TOKENS} tk from scored_candidates), u as (select cand_id, unnest(range(0, len(tk))) n, unnest(tk) x from t)
select cand_id, cast(n as int) n, x token, trim(lower(x), ' ') lower_token, {PIECE} name_piece, {MIXED} mixed_case, {UPPER} upper_case from u""",
    "features": f"with {features('cand_id', 'scored_candidates')} select cand_id, round(log_char_count, 9) log_char_count, {', '.join(FEATURE_LIST)} from f",
    "rule_decisions": f"with {rules('cand_id', 'scored_candidates')} select cand_id, rule_label, rule_score, rule_reason from r",
    "rule_classification": f"with {rules('cand_id', 'scored_candidates')} select cand_id, rule_label as label, {PROBABILITY} score, rule_reason reason from r",
    "decision_counts": f"{DECIDED} select rule_label as label, count(*) count from r group by rule_label",
    "author_counts": COUNTED,
    "top_authors": f"{COUNTED} order by count desc, author limit 30",
    "distinct_authors": f"{DECIDED} select count(distinct candidate) authors from r where rule_label = 'PERSON'",
    "uncertain_rows": f"{DECIDED} select line_no, id, cast(position as int) position, candidate, {PROBABILITY} score, rule_reason reason from r where rule_label = 'UNCERTAIN'",
    "labelling_sheet": f"""{DECIDED}, {mode("rule_label", "candidate", "r", "ml")}, {mode("rule_reason", "candidate", "r", "mr")}, s as (select candidate, count(*) frequency, round(avg(rule_score), 9) rule_score from r group by candidate)
select candidate, frequency, ml.rule_label, s.rule_score, mr.rule_reason, '' as label from s join ml using (candidate) join mr using (candidate) order by frequency * case when ml.rule_label = 'UNCERTAIN' then 3 else 1 end desc, candidate limit 5000""",
    "threshold_decisions": f"{EVERY} select cand_id, tag, decision from every",
    "threshold_summary": f"{EVERY} select pt person_threshold, nt nonperson_threshold, count(*) total_candidate_occurrences, "
    + ", ".join(f"count(*) filter (decision = '{v}') {k}_occurrences, count(distinct candidate) filter (decision = '{v}') {k}_unique, round(count(*) filter (decision = '{v}') / count(*), 9) {k}_occurrence_rate" for k, v in NAMES.items())
    + " from every group by pt, nt",
    "bucket_groups": f"""{EVERY}, {mode("ner_label", "tag, decision, candidate", "every", "mn")}, s as (select tag, decision, candidate, count(*) frequency, round(avg(person_score), 12) mean_score, min(person_score) min_score, max(person_score) max_score
  from every where candidate is not null group by tag, decision, candidate)
select s.*, coalesce(ner_label, '') most_common_ner_label from s left join mn using (tag, decision, candidate)""",
    "score_classification": "select cand_id, case when person_score >= 0.9 then 'PERSON' when person_score <= 0.1 then 'NON_PERSON' else 'UNCERTAIN' end as label, 'supervised_model' reason from scored_candidates",
    "uncertain_summary": UNCERTAIN_SUMMARY,
    "uncertain_top": f"{UNCERTAIN_SUMMARY} order by frequency desc, mean_score desc, candidate limit 100",
    "rejected_summary": f"{summary(REJECTED, 'score')} order by frequency desc, candidate limit 100",
    "reason_histogram": "select coalesce(reason, 'missing') reason, count(*) count from uncertain_occurrences group by 1 order by 2 desc, 1 limit 20",
    "ner_distribution": f"select decision, coalesce(ner_label, 'NO_NER_LABEL') ner_label, count(*) count from (select 'UNCERTAIN' decision, ner_label from uncertain_occurrences union all select 'REJECTED', ner_label from {REJECTED}) group by 1, 2",
    "decision_overview": f"""select count(*) "rows", count(distinct author) "unique", 'accepted' part from author_counts union all select count(*), count(distinct candidate), 'uncertain' from uncertain_occurrences
union all select count(*), count(distinct candidate), 'rejected' from {REJECTED}""",
    "count_describe": describe("author_counts", "count"),
    "score_describe": describe("uncertain_occurrences", "score"),
    "score_frequency": summary("uncertain_occurrences", "score"),
    "candidate_frequency": "select candidate, count(*) frequency from scored_candidates where candidate is not null group by candidate",
    "score_histogram": histogram("select * from uncertain_occurrences", "score", 40),
    "count_histogram": histogram("select * from author_counts", '"count"', 50),
    "threshold_histogram": histogram(f"{EVERY} select * from every where decision = 'UNCERTAIN'", "person_score", 40, "tag"),
    "histogram_by_class": histogram(SCORES, "s", 40, "y"),
    "confusion": f"with {MATRIX} select * from m",
    "confusion_norm": f"with {MATRIX} select round({ratio('tn', 'tn + fp')}, 8) tn, round({ratio('fp', 'tn + fp')}, 8) fp, round({ratio('fn', 'fn + tp')}, 8) fn, round({ratio('tp', 'fn + tp')}, 8) tp from m",
    "class_report": f"""with {MATRIX}, a as (select '0' "class", {P0} p, {R0} r, {F0} f, tn + fp n from m union all select '1', {P1}, {R1}, {F1_}, fn + tp from m
union all select 'accuracy', {ratio("tn + tp", N)}, {ratio("tn + tp", N)}, {ratio("tn + tp", N)}, {N} from m
union all select 'macro avg', ({P0} + {P1}) / 2, ({R0} + {R1}) / 2, ({F0} + {F1_}) / 2, {N} from m
union all select 'weighted avg', ({P0} * (tn + fp) + {P1} * (fn + tp)) / {N}, ({R0} * (tn + fp) + {R1} * (fn + tp)) / {N}, (({F0}) * (tn + fp) + ({F1_}) * (fn + tp)) / {N}, {N} from m)
select "class", round(p, 8) "precision", round(r, 8) recall, round(f, 8) f1, n support from a""",
    "threshold_sweep": f"""with t as (select round(0.01 + i * 0.01, 12) threshold from range(99) r(i)), x as (select threshold, count(*) filter (s >= threshold and y = 1) tp, count(*) filter (s >= threshold) n, count(*) filter (y = 1) ap, count(*) total
  from t cross join ({SCORES}) group by threshold), z as (select threshold, {ratio("tp", "n")} p, {ratio("tp", "ap")} r, {ratio("n", "total")} a from x)
select round(threshold, 8) threshold, round(p, 8) "precision", round(r, 8) recall, round({F1.format(p="p", r="r")}, 8) f1, round(a, 8) accepted_rate from z""",
    "roc_auc": f"{RUNNING} select round(sum(neg * (tp - pos / 2.0)) / max(cast(ap as double) * an), 8) roc_auc from run",
    "average_precision": f"{RUNNING} select round(sum(pos * tp / cast(tp + fp as double)) / max(ap), 8) average_precision from run",
    "roc_curve": f"{RUNNING} select round(s, 8) threshold, round(fp / cast(an as double), 8) fpr, round(tp / cast(ap as double), 8) tpr from run where k = 1 or npos is null or npos <> pos or nneg <> neg union all select null, 0.0, 0.0",
    "pr_curve": f"{RUNNING} select round(s, 8) threshold, round(tp / cast(tp + fp as double), 8) \"precision\", round(tp / cast(ap as double), 8) recall from run union all select null, 1.0, 0.0",
    "calibration": "select cast(" + " + ".join(f"cast(s > {i / 10} as int)" for i in range(1, 10)) + f" as int) bin, round(avg(s), 8) mean_score, round(avg(y), 8) positive_rate, count(*) count from ({SCORES}) group by 1",
    "class_counts": "select label, count(*) count from labelled_candidates where label in (0, 1) group by label",
    "predictions": f"with {JUDGED} select * from p",
    "error_fp": f"with {JUDGED} select * from p where true_label = 0 and predicted_label = 1",
    "error_fn": f"with {JUDGED} select * from p where true_label = 1 and predicted_label = 0",
    "stratified_split": """with x as (select candidate, label, row_number() over (partition by label order by md5(concat_ws('|', candidate, '42')), candidate) k, count(*) over (partition by label) n from labelled_candidates where label in (0, 1) and candidate is not null)
select candidate, label, k <= floor(n * 0.2 + 0.5) is_test from x""",
    "source_slice_lines": "select line_no, id, authors from raw_records where line_no < 50000 and authors is not null",
    "source_slice_valid": "select line_no, id, authors from raw_records where line_no >= 100 and authors is not null and authors <> '' order by line_no limit 1000",
    "jsonl_lines": "select line_no, id, authors from (select row_number() over (order by line_no) - 1 line_no, id, authors from raw_records) where line_no < 50000",
    "jsonl_slice": "select line_no, id, authors from (select row_number() over (order by line_no) - 1 line_no, id, authors from raw_records) where line_no >= 100 order by line_no limit 1000",
    "csv_training": f"{LABELLED} label is not null",
    "csv_evaluation": f"{LABELLED} label in (0, 1)",
    "csv_counts": f"select {present('author')} author, count from ({COUNTED})",
    "csv_uncertain": f"{DECIDED} select {present('id')} arxiv_id, {present('candidate')} candidate, cast(position as int) position, cast(null as varchar) ner_label, {PROBABILITY} score, rule_reason reason from r where rule_label = 'UNCERTAIN'",
    "csv_scored": f"select cand_id, {present('candidate')} candidate, person_score from scored_candidates",
    "baseline": f"select round(avg(y), 8) positive_rate from ({SCORES})",
    "char_ngrams": f"with {GRAMS} select gram, count(*) count from g group by gram",
    "tfidf": f"with {GRAMS}, d as (select gram, count(distinct id) df from g group by gram having count(distinct id) >= 2) select gram, df, round(ln((1 + (select count(*) from w)) / (1.0 + df)) + 1, 8) idf from d",
}
