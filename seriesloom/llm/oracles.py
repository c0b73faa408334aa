"""SQL of the operators that SQL expresses: written apart from them, for comparison at small sizes."""

SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LINE_DEDUP = f"""WITH rw AS (SELECT row_number() OVER () AS rw, doc_id, str_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
 ln AS (SELECT rw, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM rw),
 ky AS (SELECT *, translate(trim(line, {SPACES}), '{UPPER}', '{LOWER}') AS k FROM ln),
 hot AS (SELECT k, max(doc_id) AS keeper FROM ky WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT rw) >= 5),
 fate AS (SELECT ky.*, hot.k IS NOT NULL AND doc_id IS DISTINCT FROM keeper AS gone FROM ky LEFT JOIN hot USING (k))
 SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM fate GROUP BY rw, doc_id"""

#: CRC-32 by a table of 256 entries that is built from the polynomial.
CRC_TABLE = "ct AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT) AS c FROM range(256) r(i)))"


def crc32(s: str) -> str:
    """Of an ASCII string that isn't empty, with ct in scope."""
    return f"xor(list_reduce(list_transform(str_split({s}, ''), lambda x: ord(x)::BIGINT), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"


def _tree(name: str, leaves: str, tree: str, levels: int) -> str:
    """CTEs name0, name1, ... of the levels (tree, idx, d, c: nodes of the tree at that level), and name_runs0, ... of siblings."""
    parts, source = [], leaves
    for k in range(levels):
        parts.append(f"{name}{k} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY {tree}) AS c FROM {source})")
        parts.append(f"{name}_runs{k} AS MATERIALIZED (SELECT {tree}, idx // 8 AS up, list(d ORDER BY idx) AS run FROM {name}{k} WHERE c > 1 GROUP BY ALL)")
        source = f"(SELECT {tree}, up AS idx, sha256(array_to_string(run, '')) AS d FROM {name}_runs{k})"
    return ", ".join(parts)


def _paths(name: str, tree: str, levels: int, source: str, idx: str) -> tuple[str, str]:
    """(joins of the runs, the siblings one after the other)."""
    joins, said = "", []
    for k in range(levels):
        run, at = f"{name}_r{k}.run", f"(({idx} // {8**k}) % 8)"
        joins += f" LEFT JOIN {name}_runs{k} {name}_r{k} ON {name}_r{k}.{tree} IS NOT DISTINCT FROM {source}.{tree} AND {name}_r{k}.up = {idx} // {8 ** (k + 1)}"
        said.append(f"coalesce(array_to_string({run}[:{at}] || {run}[{at} + 2:], ''), '')")
    return joins, " || ".join(said)


def _merkle(levels: int = 8, upper: int = 3) -> str:
    """Trees of up to 8^levels rows each, and up to 8^upper of them."""
    value = lambda c: f"coalesce(strlen({c}) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(value(c) for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"
    subroots = " UNION ALL ".join(f"SELECT lang, d FROM l{k} WHERE c = 1" for k in range(levels))
    root = " UNION ALL ".join(f"SELECT d FROM u{k} WHERE c = 1" for k in range(upper))
    inside, said = _paths("l", "lang", levels, "lf", "lf.idx")
    over, beyond = _paths("u", "one", upper, "us", "us.idx")
    # folds go level by level, each in its own CTE
    folds, source = [], "met"
    for k in range(levels + upper):
        name, at = (f"lrun{k}", f"((idx // {8**k}) % 8)") if k < levels else (f"urun{k - levels}", f"((place // {8 ** (k - levels)}) % 8)")
        folds.append(f"f{k} AS (SELECT * REPLACE (CASE WHEN {name} IS NULL THEN node ELSE sha256(array_to_string({name}[:{at}] || [node] || {name}[{at} + 2:], '')) END AS node) FROM {source})")
        source = f"f{k}"
    return f"""WITH {CRC_TABLE}, seen AS (SELECT doc_id, lang, {leaf("text")} AS leaf, CASE WHEN {crc32("doc_id::VARCHAR")} % 3 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {leaf("text")} END AS seen FROM documents, ct),
 lf AS MATERIALIZED (SELECT *, leaf AS d, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM seen),
 {_tree("l", "(SELECT lang, idx, d FROM lf)", "lang", levels)}, sr AS ({subroots}), us AS MATERIALIZED (SELECT 1 AS one, lang, d, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx FROM sr),
 {_tree("u", "(SELECT one, idx, d FROM us)", "one", upper)}, rt AS ({root}),
 met AS (SELECT lf.doc_id, lf.leaf, us.d AS subroot, rt.d AS root, sha256({said} || {beyond}) AS proof_sha256, lf.seen AS node, lf.idx, us.idx AS place,
 {", ".join(f"l_r{k}.run AS lrun{k}" for k in range(levels))}, {", ".join(f"u_r{k}.run AS urun{k}" for k in range(upper))}
 FROM lf JOIN us ON us.lang IS NOT DISTINCT FROM lf.lang, rt{inside}{over}), {", ".join(folds)}
 SELECT doc_id, leaf, subroot, root, proof_sha256, node AS folded_root, node = root AS verified FROM {source}"""


MERKLE = _merkle()


def _repair() -> str:
    """Cheapest edits by dynamic programming over turns: for each grammar state the least (cost and audit as text `k`, lines `v`)."""
    add = lambda x, cost, letter, line: f"CASE WHEN {x} IS NOT NULL THEN {{'k': lpad((left({x}.k, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({x}.k, 10) || '{letter}', 'v': {x}.v{line}}} END"
    least = lambda *x: f"list_min([{', '.join(x)}])"
    user, assistant, own = " || ['user:']", " || ['assistant:']", " || [role || ':' || text]"
    into2 = least("s2", *(add(s, 2, "I", user) for s in ("s0", "s1", "s3")))
    into3 = least("s3", add("c2", 2, "I", assistant))
    stays = "fault IS NULL OR fault = 'truncated'"
    cut = "(fault IS NOT DISTINCT FROM 'truncated')::INT"
    keep = lambda s, initial: f"CASE WHEN ({stays}) AND initial = '{initial}' THEN {add(s, cut, 'K', own)} END"
    rerole = lambda s, role: f"CASE WHEN {stays} THEN {add(s, f'2 + {cut}', 'R', f' || [{role!r} || text]')} END"
    gone = lambda s: add(s, 3, "D", "")
    into_u = [x for s in ("s0", "s1", "c3") for x in (keep(s, "u"), rerole(s, "user:"))]
    nexts = [gone("s0"), least(gone("s1"), keep("s0", "s")), least(gone("c2"), *into_u), least(gone("c3"), keep("c2", "a"), rerole("c2", "assistant:"))]
    spaced = lambda c: f"coalesce({c}::VARCHAR, ' ')"
    closed = lambda source: f"(SELECT *, {into3} AS c3 FROM (SELECT *, {into2} AS c2 FROM {source}))"
    return f"""WITH RECURSIVE {CRC_TABLE}, kd AS (SELECT conv_id, turn, {spaced("role")} AS role, {spaced("text")} AS text, {crc32(f"({spaced('conv_id')} || ':' || {spaced('turn')})")} % 20 AS kind FROM conversations, ct),
 dm AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kd),
 od AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS idx, left(role, 1) AS initial, rtrim(text, {SPACES}) AS bare FROM dm),
 ft AS MATERIALIZED (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY idx) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
 lag(initial) OVER (PARTITION BY conv_id ORDER BY idx) || initial AS pair FROM od),
 st AS (SELECT DISTINCT conv_id, -1::BIGINT AS idx, {{'k': '000000000', 'v': []::VARCHAR[]}} AS s0, NULL::STRUCT(k VARCHAR, v VARCHAR[]) AS s1, NULL::STRUCT(k VARCHAR, v VARCHAR[]) AS s2, NULL::STRUCT(k VARCHAR, v VARCHAR[]) AS s3 FROM ft
 UNION ALL SELECT conv_id, next_idx, {nexts[0]}, {nexts[1]}, {nexts[2]}, {nexts[3]} FROM {closed("(SELECT st.*, ft.idx AS next_idx, ft.role, ft.text, ft.initial, ft.fault FROM st JOIN ft ON ft.conv_id IS NOT DISTINCT FROM st.conv_id AND ft.idx = st.idx + 1)")}),
 en AS (SELECT conv_id, {least("s0", "c3")} AS best FROM {closed("(SELECT st.* FROM st QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY idx DESC) = 1)")}),
 sm AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, {", ".join(f"count(*) FILTER (fault = '{f}') AS {f}" for f in ("blank", "duplicate", "truncated"))}, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM ft GROUP BY 1)
 SELECT c.conv_id, {", ".join(f"coalesce(sm.{x}, 0)::BIGINT AS {x}" for x in ("gaps", "blank", "duplicate", "truncated", "illegal"))}, coalesce(left(en.best.k, 9)::BIGINT, 0) AS cost, coalesce(substr(en.best.k, 10), '') AS audit, sha256(coalesce(array_to_string(en.best.v, chr(10)), '')) AS repaired_sha256
 FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN en ON en.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN sm ON sm.conv_id IS NOT DISTINCT FROM c.conv_id"""


REPAIR = _repair()
