"""DuckDB SQL for the queries of this subpackage that SQL can state."""

from __future__ import annotations

from .equalaverage import ENTRIES, PARTS, ROUNDS, SCALE
from .repair import CUT_SHORT, DELETE, INSERT, KINDS, NEXT, REROLE, STEP


def _assigned(entries: str) -> str:
    """Each part's nearest entry, by full distances; ties to the lower index."""
    distance = "list_sum(list_transform(range(1, len(a.x) + 1), lambda i: (a.x[i] - b.x[i]) * (a.x[i] - b.x[i])))"
    return f"SELECT vec_id, label, p, x, arg_min(e, d * {ENTRIES} + e) AS e, min(d) AS d FROM (SELECT a.vec_id, a.label, a.p, a.x, b.e, CAST({distance} AS BIGINT) AS d FROM parts a JOIN {entries} b ON b.p = a.p) GROUP BY vec_id, label, p, x"


def _moved(assigned: str, entries: str) -> str:
    """Entries as the floored means of their parts; unused ones stay."""
    means = f"SELECT p, e, list(m ORDER BY i) AS x FROM (SELECT p, e, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS m FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS i FROM {assigned}) GROUP BY p, e, i) GROUP BY p, e"
    return f"SELECT b.p, b.e, coalesce(n.x, b.x) AS x FROM {entries} b LEFT JOIN ({means}) n ON n.p = b.p AND n.e = b.e"


def equal_average() -> str:
    steps = {
        "ints": f"SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0",
        "parts": f"SELECT vec_id, label, p, list_slice(v, p * (len(v) // {PARTS}) + 1, (p + 1) * (len(v) // {PARTS})) AS x FROM (SELECT *, unnest(range({PARTS})) AS p FROM ints)",
        "b0": f"SELECT p, e, x FROM (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM parts) WHERE e < {ENTRIES}",
    }
    for k in range(ROUNDS):
        steps[f"a{k}"] = _assigned(f"b{k}")
        steps[f"b{k + 1}"] = _moved(f"a{k}", f"b{k}")
    steps["final"] = _assigned(f"b{ROUNDS}")
    steps["codes"] = "SELECT vec_id, any_value(label) AS label, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM final GROUP BY vec_id"
    steps["book"] = f"SELECT sha256(string_agg(CAST(m AS VARCHAR), ',' ORDER BY p, e, i)) AS sha FROM (SELECT p, e, unnest(range(len(x))) AS i, unnest(x) AS m FROM b{ROUNDS})"
    made = ", ".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in steps.items())
    return f"WITH {made} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256 FROM codes, book"


def crc32(text: str) -> str:
    """CRC-32 of an ASCII text, a bit at a time: each byte is eight steps, the first of which takes it in."""
    steps = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: [CAST(ascii(substr({text}, i, 1)) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {steps}), lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), CAST(4294967295 AS BIGINT))"


def conversations() -> str:
    """Damage, faults, the cheapest edits by recursion from the last row, and the repaired text by recursion along them."""
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    plain = lambda c: f"coalesce(CAST({c} AS VARCHAR), ' ')"

    def state(s: int) -> str:
        """The cheapest repair of the rows from here on in a state, before insertions."""
        moves = [f"{{'c': {DELETE} + r.c{s}, 'a': 'D' || r.a{s}}}"]
        more = f"CASE WHEN n.fault = 'truncated' THEN {CUT_SHORT} ELSE 0 END"
        dear = f"{{'c': {1 << 40}, 'a': ''}}"
        good = "coalesce(n.fault, '') NOT IN ('blank', 'duplicate')"
        moves.append(f"CASE WHEN {good} THEN {{'c': {REROLE} + {more} + r.c{NEXT[s]}, 'a': 'R' || r.a{NEXT[s]}}} ELSE {dear} END")
        moves += [f"CASE WHEN {good} AND n.initial = '{x}' THEN {{'c': {more} + r.c{to}, 'a': 'K' || r.a{to}}} ELSE {dear} END" for (at, x), to in STEP.items() if at == s]
        return f"list_sort([{', '.join(moves)}])[1]"

    insert = lambda own, other: f"list_sort([{own}, {{'c': {INSERT} + {other}.c, 'a': 'I' || {other}.a}}])[1]"
    edits = f"""SELECT conv_id, k, {", ".join(f"s{s}.c AS c{s}, s{s}.a AS a{s}" for s in range(4))} FROM (SELECT conv_id, k, s2, s3, {insert('b0', 's2')} AS s0, {insert('b1', 's2')} AS s1 FROM (SELECT *, {insert('b2', 'b3')} AS s2, {insert('b3', 'b2')} AS s3 FROM (
      SELECT r.conv_id, r.k + 1 AS k, {", ".join(f"{state(s)} AS b{s}" for s in range(4))} FROM solved r JOIN judged n ON n.conv_id = r.conv_id AND n.back = r.k + 1)))"""
    put = "CASE state WHEN 2 THEN 'assistant' ELSE 'user' END"
    after = "CASE state WHEN 2 THEN 3 ELSE 2 END"
    kept = "CASE WHEN initial = 's' THEN 1 WHEN initial = 'u' THEN 2 ELSE 3 END"
    steps = {
        "marked": f"SELECT conv_id, turn, {plain('role')} AS role, {plain('text')} AS text, {crc32(f'({plain('conv_id')} || chr(58) || {plain('turn')})')} % {KINDS} AS kind FROM conversations",
        "left_": "SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM marked WHERE kind <> 0",
        "placed": "SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS at_, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC, copy DESC) AS back FROM left_",
        "judged": f"""SELECT *, left(role, 1) AS initial, CASE WHEN rtrim(text, {blank}) = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY at_) > 1 THEN 'duplicate' WHEN right(rtrim(text, {blank}), 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
          lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY at_) || left(role, 1) AS pair FROM placed""",
        "solved": f"SELECT conv_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS c0, '' AS a0, CAST({2 * INSERT} AS BIGINT) AS c1, 'II' AS a1, CAST({INSERT} AS BIGINT) AS c2, 'I' AS a2, CAST(0 AS BIGINT) AS c3, '' AS a3 FROM (SELECT DISTINCT conv_id FROM judged) UNION ALL {edits}",
        "audits": "SELECT conv_id, max(k) AS n, arg_max(c0, k) AS cost, arg_max(a0, k) AS audit FROM solved GROUP BY conv_id",
        "walked": f"""SELECT conv_id, audit, 0 AS p, CAST(0 AS BIGINT) AS row_, 0 AS state, CAST([] AS VARCHAR[]) AS told FROM audits
          UNION ALL SELECT w.conv_id, audit, p + 1, row_ + CASE WHEN e = 'I' THEN 0 ELSE 1 END, CASE e WHEN 'D' THEN state WHEN 'K' THEN {kept} ELSE {after} END, CASE e WHEN 'D' THEN told WHEN 'I' THEN list_append(told, {put} || ':') WHEN 'K' THEN list_append(told, role || ':' || text) ELSE list_append(told, {put} || ':' || text) END
            FROM (SELECT *, substr(audit, p + 1, 1) AS e FROM walked WHERE p < length(audit)) w LEFT JOIN judged j ON j.conv_id = w.conv_id AND j.at_ = w.row_ + 1 AND e <> 'I'""",
        "counted": """SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id""",
    }
    made = ", ".join(f"{name} AS ({sql})" for name, sql in steps.items())
    zero = ", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return f"""WITH RECURSIVE {made} SELECT c.conv_id, {zero}, coalesce(a.audit, '') AS audit, sha256(coalesce(array_to_string(w.told, chr(10)), '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) c
      LEFT JOIN counted n ON n.conv_id = c.conv_id LEFT JOIN audits a ON a.conv_id = c.conv_id LEFT JOIN (SELECT conv_id, arg_max(told, p) AS told FROM walked GROUP BY conv_id) w ON w.conv_id = c.conv_id"""


ORACLES = {"op11_equalaverage": equal_average(), "op13_repair": conversations()}
