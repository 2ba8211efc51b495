"""DuckDB SQL twins of the Spark queries (the correctness oracle).

Each builder returns SQL text over the shared tables (`events`, `documents`, ...).
They are written independently of the DataFrame code, from the operator definitions, and
spell out their own patterns and character sets; only fixed texts (keywords, explanations)
are shared.
"""

from __future__ import annotations

from logsieve.operators import explain as ex
from logsieve.operators import flags as fl
from logsieve.operators.tokens import SPECIAL_TOKENS


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


SPECIALS_SQL = "(" + ", ".join(q(t) for t in SPECIAL_TOKENS) + ")"
# Uncased word splitting, spelled out for DuckDB's regular expressions: punctuation marks, ASCII
# symbols and CJK ideographs stand alone, other characters between white space make words.
_ALONE = (r"\p{P}$+<=>^`|~\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}"
          r"\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}")
_REMOVED = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\p{Cf}\p{Co}\x{FFFD}]"


def tokens_sql(x: str) -> str:
    clean = f"strip_accents(lower(regexp_replace({x}, {q(_REMOVED)}, '', 'g')))"
    return f"regexp_extract_all({clean}, {q(f'[{_ALONE}]|[^{_ALONE}{chr(92)}p{{Z}}{chr(92)}t{chr(92)}n{chr(92)}r]+')})"


# white space as str.isspace has it
_SPACES = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]


def strip_sql(x: str) -> str:
    return f"trim({x}, {' || '.join(f'chr({c})' for c in _SPACES)})"


def split_ws_sql(x: str) -> str:
    return f"regexp_split_to_array({x}, {q('[' + ''.join(f'{chr(92)}x{{{c:X}}}' for c in _SPACES) + ']+')})"


def h01_sql(*parts: str) -> str:
    """Same draw as functions.hashing.h01: parts are SQL expressions."""
    key = "concat_ws(':', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")"
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296.0)"


def contains_any_sql(x: str, kws) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(k)})" for k in kws) + ")"


_TS = "strftime(ts, '%Y-%m-%d %H:%M:%S')"
_BODY = ("'log_channel(' || CASE WHEN event_type = 'signup' THEN 'mon' WHEN event_type = 'view' THEN 'client' "
         "ELSE 'cluster' END || ') log [' || CASE WHEN event_type = 'error' THEN 'ERR' WHEN event_type = 'purchase' "
         "THEN 'WRN' WHEN event_type = 'view' THEN 'DBG' WHEN event_type = 'click' THEN 'INF' "
         "WHEN event_type = 'signup' THEN 'NTC' ELSE 'UNK' END || '] : ' || event_type || ' user ' || "
         "CAST(user_id AS VARCHAR) || ' k ' || json_extract_string(props, '$.k')")
_PLAIN = f"({_TS} || ' ' || {_BODY})"


def lines_sql(view: str = "plain") -> str:
    """(log_id, line) from events, as logs_from_events."""
    if view == "plain":
        line = _PLAIN
    elif view == "labelled":
        line = (f"CASE WHEN event_type = 'error' THEN {_PLAIN} || ' ##ANOMALY' WHEN event_type = 'signup' "
                f"THEN {_PLAIN} ELSE {_PLAIN} || ' ##NORMAL' END")
    elif view == "messy":
        line = (f"CASE event_id % 7 WHEN 0 THEN replace({_PLAIN}, ' ', '  ') || chr(9) "
                f"WHEN 1 THEN ' ' || {_BODY} WHEN 2 THEN event_type "
                f"WHEN 3 THEN event_type || ' ' || CAST(user_id AS VARCHAR) "
                f"WHEN 4 THEN ' ' || chr(9) || ' ' "
                f"WHEN 5 THEN substr({_TS}, 1, 5) || '13' || substr({_TS}, 8, 12) || ' ' || {_BODY} "
                f"ELSE {_PLAIN} || ' [ERR] [OK]' END")
    else:
        raise ValueError(view)
    return f"SELECT event_id AS log_id, {line} AS line FROM events"


def clean_sql(src: str) -> str:
    return f"SELECT log_id, {strip_sql('line')} AS line FROM ({src}) WHERE {strip_sql('line')} <> ''"


def positional_sql(src: str) -> str:
    """parse_positional over a (log_id, line) query."""
    return (f"SELECT log_id, CASE WHEN len(w) >= 2 THEN w[1] || ' ' || w[2] ELSE 'N/A' END AS timestamp, "
            f"CASE WHEN len(w) >= 2 THEN array_to_string(w[3:], ' ') ELSE s END AS message "
            f"FROM (SELECT log_id, s, {split_ws_sql('s')} AS w "
            f"FROM (SELECT log_id, {strip_sql('line')} AS s FROM ({src})))")


def strict_sql(src: str) -> str:
    ts = r"nullif(regexp_extract(line, '^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})', 1), '')"
    return (f"SELECT log_id, {ts} AS timestamp, CASE WHEN {ts} IS NULL THEN line "
            f"ELSE {strip_sql('substr(line, 20)')} END AS message FROM ({src})")


def nonblank_sql(src: str) -> str:
    return f"SELECT * FROM ({src}) WHERE message IS NOT NULL AND {strip_sql('message')} <> ''"


def positions_sql(src: str, id_col: str = "log_id", text_col: str = "message", keep: str = "") -> str:
    """(id, [keep,] pos, l, t, r, seq_len) over a query with an id and a text column."""
    k = f"{keep}, " if keep else ""
    seq = (f"SELECT {id_col}, {k}list_concat(['[CLS]'], ({tokens_sql(text_col)})[1:62], "
           f"['[SEP]']) AS seq FROM ({src})")
    return (f"SELECT {id_col}, {k}CAST(i AS INTEGER) AS pos, CASE WHEN i = 1 THEN '[PAD]' ELSE seq[i - 1] END AS l, seq[i] AS t, "
            f"CASE WHEN i = len(seq) THEN '[PAD]' ELSE seq[i + 1] END AS r, len(seq) AS seq_len "
            f"FROM (SELECT {id_col}, {k}seq, unnest(generate_series(1, len(seq))) AS i FROM ({seq}))")


def loss_table_sql(pos: str) -> str:
    """(l, t, r, loss) for the contexts of a positions query, the model fitted on it."""
    c3 = f"SELECT l, t, r, count(*) AS n FROM ({pos}) GROUP BY l, t, r"
    marg = (f"SELECT l, t, r, n AS n3, sum(n) OVER (PARTITION BY l) AS n_l, sum(n) OVER (PARTITION BY l, r) AS n_lr, "
            f"sum(n) OVER (PARTITION BY l, t) AS n_lt, sum(n) OVER (PARTITION BY t) AS n_t, "
            f"sum(n) OVER (PARTITION BY t, r) AS n_tr, sum(n) OVER (PARTITION BY r) AS n_r FROM ({c3})")
    g = f"SELECT sum(n) AS big_n, count(DISTINCT t) AS big_v FROM ({c3})"
    p = ("0.4 * n3 / n_lr + 0.2 * n_lt / n_l + 0.2 * n_tr / n_r + 0.2 * (n_t + 0.1) / (big_n + 0.1 * (big_v + 1))")
    return (f"SELECT l, t, r, CAST(round(CAST(-ln({p}) AS DECIMAL(20,9)), 6) AS DOUBLE) AS loss "
            f"FROM ({marg}) m, ({g}) g")


def ranked_losses_sql(pos: str) -> str:
    """(log_id, pos, t, loss, rk): every position with its loss and rank in its log."""
    lt = loss_table_sql(pos)
    return (f"SELECT p.log_id, p.pos, p.t, x.loss, row_number() OVER (PARTITION BY p.log_id "
            f"ORDER BY x.loss DESC, p.pos DESC) AS rk FROM ({pos}) p JOIN ({lt}) x "
            f"ON p.l = x.l AND p.t = x.t AND p.r = x.r")


def scores_sql(logs: str) -> str:
    """(log_id, anomaly_score, top_list) for a (log_id, timestamp, message) query."""
    rl = ranked_losses_sql(positions_sql(logs))
    # DuckDB divides decimals as doubles; multiplying by the exact decimal 1/64 keeps it exact
    return (f"SELECT log_id, CAST(round(sum(CAST(loss AS DECIMAL(18,6))) * CAST(0.015625 AS DECIMAL(10,6)), 6) "
            f"AS DOUBLE) AS anomaly_score, "
            f"coalesce(list(t ORDER BY rk) FILTER (WHERE rk <= 3 AND t NOT IN {SPECIALS_SQL}), []) AS top_list "
            f"FROM ({rl}) GROUP BY log_id")


def meaning_sql(x: str, ignore_case: bool = False) -> str:
    k = f"upper({x})" if ignore_case else x
    cases = " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in ex.TOKEN_MEANINGS.items())
    return f"CASE {k} {cases} ELSE {q(ex.DEFAULT_MEANING)} END"


def detail_sql(lst: str) -> str:
    return (f"array_to_string(list_transform({lst}, lambda t: '''' || t || ''' (' || {meaning_sql('t')} || ')'), ', ')")


def detect_sql(view: str = "plain") -> str:
    """Full detection result (RESULT_COLUMNS + top_list) over the events log view."""
    logs = nonblank_sql(positional_sql(clean_sql(lines_sql(view))))
    sc = scores_sql(logs)
    rule = contains_any_sql("g.message", fl.ANOMALY_KEYWORDS)
    allow = contains_any_sql("g.message", fl.ALLOW_KEYWORDS)
    base = (f"SELECT g.log_id, g.timestamp, g.message, s.anomaly_score, s.top_list, "
            f"coalesce(s.anomaly_score > th.threshold, false) AND NOT {allow} AS is_anomaly, "
            f"{rule} AND NOT {allow} AS rule_based_flag, {allow} AS is_whitelisted, "
            f"round((s.anomaly_score - mm.mn) / (mm.mx - mm.mn + 1e-5), 4) AS confidence_score "
            f"FROM ({logs}) g JOIN sc s ON g.log_id = s.log_id, "
            f"(SELECT quantile_cont(anomaly_score, {fl.DEFAULT_PERCENTILE / 100.0}) AS threshold FROM sc) th, "
            f"(SELECT min(anomaly_score) AS mn, max(anomaly_score) AS mx FROM sc) mm")
    comb = f"SELECT *, is_anomaly OR rule_based_flag AS combined_anomaly FROM ({base})"
    det = detail_sql("top_list")
    expl = (f"CASE WHEN is_whitelisted THEN {q(ex.TEXT_ALLOWED)} "
            f"WHEN combined_anomaly THEN {q(ex.TEXT_FLAGGED_HEAD)} || {det} || {q(ex.TEXT_FLAGGED_TAIL)} "
            f"ELSE {q(ex.TEXT_NORMAL_HEAD)} || {det} || {q(ex.TEXT_NORMAL_MID)} || "
            f"CASE WHEN rule_based_flag THEN {q(ex.REASON_RULE)} ELSE {q(ex.REASON_NORMAL)} END END")
    return f"WITH sc AS ({sc}) SELECT *, {expl} AS explanation FROM ({comb})"


# ---------------------------------------------------------------- generator twin
def placeholder_sql(name: str, kind: str, spec, seed: int, key: str) -> str:
    h = h01_sql(str(seed), key, q(name))
    if kind == "int":
        lo, hi = spec
        return f"CAST(CAST({lo} + floor({h} * {hi - lo + 1}) AS BIGINT) AS VARCHAR)"
    if kind == "choice":
        return f"[{', '.join(q(c) for c in spec)}][CAST(floor({h} * {len(spec)}) AS BIGINT) + 1]"
    if kind == "fmt":
        pre, lo, hi, suf = spec
        return f"({q(pre)} || CAST(CAST({lo} + floor({h} * {hi - lo + 1}) AS BIGINT) AS VARCHAR) || {q(suf)})"
    if kind == "sample":
        k, cands = spec
        items = ", ".join(f"{{'h': {h01_sql(str(seed), key, q(name), str(i))}, 'v': {q(c)}}}"
                          for i, c in enumerate(cands))
        return f"array_to_string(list_transform(list_sort([{items}])[1:{k}], lambda x: x.v), ',')"
    raise ValueError(kind)


def fill_sql(text: str, seed: int, key: str) -> str:
    from logsieve.sources.generate import DOMAINS
    out = text
    for name, kind, spec in DOMAINS:
        out = f"replace({out}, {q('{' + name + '}')}, {placeholder_sql(name, kind, spec, seed, key)})"
    return out


def pick_sql(templates: list, seed: int, key: str, draw: str = "tpl") -> str:
    return (f"[{', '.join(q(t) for t in templates)}]"
            f"[CAST(floor({h01_sql(str(seed), key, q(draw))} * {len(templates)}) AS BIGINT) + 1]")


def ts_sql(base_ts: str, secs: str) -> str:
    return f"strftime(TIMESTAMP '{base_ts}' + to_seconds(CAST({secs} AS BIGINT)), '%Y-%m-%d %H:%M:%S')"


def generate_sql(mode: str, seed: int, ids: str = "SELECT event_id AS id FROM events") -> str:
    from logsieve.sources import generate as G
    from logsieve.sources import templates as T
    b = G.DEFAULT_BASE_TS
    if mode == "raw":
        line = (f"{ts_sql(b, f'id * {G.RAW_STEP_S}')} || ' ' || "
                f"{fill_sql(pick_sql(T.NORMAL_UNLABELLED, seed, 'id'), seed, 'id')}")
        return f"SELECT id AS log_id, {line} AS line FROM ({ids})"
    if mode == "finetuned":
        tpl = (f"CASE WHEN id % {G.ANOMALY_EVERY} = 0 THEN {pick_sql(T.ANOMALY_LABELLED, seed, 'id')} "
               f"ELSE {pick_sql(T.NORMAL_LABELLED, seed, 'id')} END")
        step = f"CAST(1 + floor({h01_sql(str(seed), 'id', q('step'))} * 3) AS BIGINT)"
        tag = f"CASE WHEN id % {G.ANOMALY_EVERY} = 0 THEN ' ##ANOMALY' ELSE ' ##NORMAL' END"
        line = f"{ts_sql(b, f'{step} * id')} || ' ' || {fill_sql(tpl, seed, 'id')} || {tag}"
        return f"SELECT id AS log_id, {line} AS line FROM ({ids})"
    tpl = (f"CASE WHEN id < nn THEN {pick_sql(T.NORMAL_TEST, seed, 'id')} "
           f"ELSE {pick_sql(T.ANOMALY_TEST, seed, 'id')} END")
    secs = f"CASE WHEN id < nn THEN id ELSE {G.TEST_ANOMALY_OFFSET_S} + id - nn END"
    line = f"{ts_sql(b, secs)} || ' ' || {fill_sql(tpl, seed, 'id')}"
    return (f"SELECT id AS log_id, {line} AS line, row_number() OVER (ORDER BY "
            f"{h01_sql(str(seed), 'id', q('shuffle'))}, id) - 1 AS position "
            f"FROM ({ids}) i, (SELECT CAST(floor(count(*) * {G.TEST_NORMAL_SHARE}) AS BIGINT) AS nn FROM ({ids})) c")
