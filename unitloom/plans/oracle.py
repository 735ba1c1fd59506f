"""The views and stages once more, as DuckDB SQL over the same tables: independent twins of the operators."""

from __future__ import annotations

from ..functions.scoring import KIND_WEIGHT
from ..sources.views import ADDRESSES, ANSWERS, KINDS, LINES, NAMES


def _s(v) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


_KINDS = ", ".join(map(_s, KINDS))
_WEIGHT = " ".join(f"WHEN slice_kind = '{k}' THEN {v}::DOUBLE" for k, v in KIND_WEIGHT.items())
_LINES = ", ".join(f"({_s(f)}, {i}, {_s(line)}, {_s(ea)})" for f, i, line, ea in LINES)
NAMES_SQL, ADDRESSES_SQL, ANSWERS_SQL = (", ".join(f"({_s(v)})" for v in x) for x in (NAMES, ADDRESSES, ANSWERS))
_PRIOR = f"""(CASE {_WEIGHT} ELSE 1.0::DOUBLE END) * least(1.5::DOUBLE, greatest(0.35::DOUBLE, coalesce(nullif(slice_quality, 0), 1.0)))
  * (CASE WHEN semantic_role = 'primary' THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END) * greatest(0.45::DOUBLE, 1 - 0.5::DOUBLE * least(1, greatest(0, generic_penalty)))"""
_NORM = "list_transform({v}, lambda x: x / greatest(sqrt(list_dot_product({v}, {v})), 1e-12))"

#: Each view or stage by name, in order of use.
CTES = {
    "units": f"""SELECT vec_id // 5 AS func_id, CAST(vec_id % 5 AS INTEGER) AS pos, vec_id, [{_KINDS}][vec_id % {len(KINDS)} + 1] AS slice_kind, 0.4::DOUBLE + (vec_id % 12) / 10 AS slice_quality,
  CASE WHEN vec_id % 7 = 3 THEN 'secondary' ELSE 'primary' END AS semantic_role, (vec_id % 4) * 0.25::DOUBLE AS generic_penalty, CAST(embedding AS DOUBLE[]) AS emb FROM embeddings""",
    "functions": "SELECT DISTINCT func_id, 'bin' || (func_id % 8) AS binary_name, '0x' || lower(to_hex(func_id * 16)) AS func_addr, 'f' || (func_id % 90) AS func_name FROM units",
    "centroids": "SELECT CAST(vec_id // 16 AS INTEGER) AS bucket_id, emb FROM units WHERE vec_id % 16 = 0",
    "gmean": "SELECT func_id, list(x ORDER BY i) AS v FROM (SELECT func_id, i, avg(x) AS x FROM (SELECT func_id, unnest(range(1, len(emb) + 1)) AS i, unnest(emb) AS x FROM units) GROUP BY func_id, i) GROUP BY func_id",
    "globals": f"SELECT func_id, {_NORM.format(v='v')} AS emb FROM gmean",
    "mixed": "SELECT u.func_id // 10 AS query_id, u.pos AS r, u.slice_kind, u.slice_quality, u.semantic_role, u.generic_penalty, list_transform(list_zip(u.emb, o.emb), lambda p: 0.7::DOUBLE * p[1] + 0.3::DOUBLE * p[2]) AS m FROM units u JOIN units o ON o.vec_id = (u.vec_id + 7) % (SELECT max(vec_id) + 1 FROM units) WHERE u.func_id % 10 = 0",
    "qrows": f"SELECT *, {_NORM.format(v='m')} AS emb FROM mixed",
    "qmean": "SELECT query_id, list(x ORDER BY i) AS v FROM (SELECT query_id, i, avg(x) AS x FROM (SELECT query_id, unnest(range(1, len(emb) + 1)) AS i, unnest(emb) AS x FROM qrows) GROUP BY query_id, i) GROUP BY query_id",
    "queries": f"SELECT query_id, query_id * 10 AS gt_func, CAST((query_id * 10) % 3 AS INTEGER) AS gt_type, {_NORM.format(v='v')} AS gq FROM qmean",
    "lines": f"""SELECT CAST(doc_id AS VARCHAR) AS func, CAST(i - 1 AS INTEGER) AS line_index, l[i] AS line, CAST(NULL AS VARCHAR) AS line_ea FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
  UNION ALL SELECT * FROM (VALUES {_LINES}) AS v(func, line_index, line, line_ea)""",
    "flagged": r"""SELECT *, regexp_replace(coalesce(line, ''), '[^\x00-\x7F]', '_', 'g') AS al FROM lines WHERE NOT (regexp_matches(coalesce(line, ''), '[{};]') AND regexp_full_match(coalesce(line, ''), '[\s{};]+') AND coalesce(line_ea, '') = '')""",
    "bounds": r"""SELECT *, CAST(regexp_full_match(coalesce(line, ''), '\s*LABEL_\d+\s*:\s*') OR coalesce(lag(regexp_matches(al, '\b(if|for|while|switch|goto|return|break|continue)\b')) OVER (PARTITION BY func ORDER BY line_index), false) AS INTEGER) AS o FROM flagged""",
    "blocks": "SELECT func, line_index, line, al, CAST(dense_rank() OVER (PARTITION BY func ORDER BY b) - 1 AS BIGINT) AS bb_id FROM (SELECT *, sum(o) OVER (PARTITION BY func ORDER BY line_index) AS b FROM bounds)",
    "records": "SELECT func, bb_id, count(*) AS n_lines, string_agg(coalesce(line, ''), chr(10) ORDER BY line_index) AS pseudo FROM blocks GROUP BY func, bb_id",
    "texts": "SELECT func, coalesce(string_agg(pseudo, chr(10) ORDER BY bb_id) FILTER (pseudo <> ''), '') AS text FROM records GROUP BY func",
    "knn": "SELECT *, CAST(row_number() OVER (PARTITION BY func_id, pos ORDER BY sim DESC, bucket_id) - 1 AS INTEGER) AS rank FROM (SELECT u.func_id, u.pos, c.bucket_id, round(list_dot_product(u.emb, c.emb), 6) AS sim FROM units u, centroids c) QUALIFY rank < 24",
    "hits": f"SELECT k.*, u.slice_kind, u.prior, u.prior / sqrt(k.rank + 1) AS c FROM knn k JOIN (SELECT func_id, pos, slice_kind, {_PRIOR} AS prior FROM units) u USING (func_id, pos)",
    "post0": "SELECT bucket_id, func_id, max(c) AS best, sum(c) AS support FROM hits WHERE prior > 0 GROUP BY ALL",
    "post1": "SELECT p.*, least(1, greatest(0, 0.58::DOUBLE * (1 - exp(-1.6::DOUBLE * best)) + 0.3::DOUBLE * (1 - exp(-0.85::DOUBLE * support)) + 0.12::DOUBLE / sqrt(greatest(1, b)))) AS signal FROM post0 p JOIN (SELECT func_id, count(DISTINCT bucket_id) AS b FROM hits GROUP BY func_id) USING (func_id)",
    "post": "SELECT *, row_number() OVER (PARTITION BY bucket_id ORDER BY round(0.7::DOUBLE * best + 0.3::DOUBLE * (1 - exp(-0.85::DOUBLE * support)), 9) DESC, round(best, 9) DESC, round(support, 9) DESC, func_id) AS pos FROM post1",
    "lens": "SELECT CAST(b AS INTEGER) AS bucket_id, coalesce(len, 0) AS posting_len, coalesce(len, 0) / (SELECT count(*) FROM functions) AS df_ratio FROM range(0, (SELECT max(bucket_id) + 1 FROM post)) t(b) LEFT JOIN (SELECT bucket_id, count(*) AS len FROM post GROUP BY bucket_id) p ON p.bucket_id = t.b",
    "lim": "SELECT greatest(1, ceil(quantile_cont(posting_len, 0.99))) AS t FROM lens WHERE posting_len > 0",
    "stats0": "SELECT *, ln(((SELECT count(*) FROM functions) + 1) / (posting_len + 1)) + 1 AS idf, CASE WHEN posting_len <= (SELECT t FROM lim) THEN 1.0::DOUBLE ELSE greatest(0.35::DOUBLE, 1 / sqrt(posting_len / (SELECT t FROM lim))) END AS hot_weight FROM lens",
    "stats1": "SELECT *, greatest(0.15::DOUBLE, 1 - 2.5::DOUBLE * df_ratio) AS dt, 1 / sqrt(greatest(1.0::DOUBLE, posting_len / 32)) AS pt FROM stats0",
    "stats": "SELECT *, least(0.55::DOUBLE, idf * greatest(0.18::DOUBLE, dt * pt) * CASE WHEN posting_len >= 128 AND df_ratio >= 0.18 THEN greatest(0.18::DOUBLE, sqrt(dt * pt)) ELSE 1 END) * hot_weight AS query_weight FROM stats1",
    "fstats": "SELECT func_id, unit_count, coalesce(bucket_count, 0) AS bucket_count, coalesce(total_support, 0) AS total_support FROM (SELECT func_id, count(*) AS unit_count FROM units GROUP BY func_id) LEFT JOIN (SELECT func_id, count(DISTINCT bucket_id) AS bucket_count FROM hits GROUP BY func_id) USING (func_id) LEFT JOIN (SELECT func_id, sum(support) AS total_support FROM post GROUP BY func_id) USING (func_id)",
    "uidf": "SELECT func_id, pos, coalesce(idf, m) / m AS unit_idf FROM (SELECT h.func_id, h.pos, s.idf, avg(s.idf) OVER () AS m FROM hits h LEFT JOIN stats s USING (bucket_id) WHERE h.rank = 0)",
    "prof0": f"SELECT query_id, r, emb, gq, {_PRIOR} AS prior, greatest(0, list_dot_product(emb, gq)) AS a FROM qrows JOIN queries USING (query_id)",
    "prof": "SELECT query_id, r, emb, gq, CASE WHEN m > 1e-6 THEN w0 * a / m ELSE w0 END AS w FROM (SELECT *, CASE WHEN sum(prior) OVER p <= 0 THEN 1 ELSE prior END AS w0, avg(a) OVER p AS m FROM prof0 WINDOW p AS (PARTITION BY query_id))",
    "idf_pivot": "SELECT median(idf) AS p FROM stats",
    "qhit0": "SELECT *, CAST(row_number() OVER (PARTITION BY query_id, r ORDER BY sim DESC, bucket_id) - 1 AS INTEGER) AS rank FROM (SELECT q.query_id, q.r, c.bucket_id, round(list_dot_product(q.emb, c.emb), 6) AS sim FROM prof q, centroids c) QUALIFY rank < 16",
    "qhit": "SELECT h.*, s.idf, s.query_weight, least(1.4::DOUBLE, greatest(0.6::DOUBLE, max(s.idf) OVER (PARTITION BY query_id, r) / (SELECT p FROM idf_pivot))) AS mult FROM qhit0 h JOIN stats s USING (bucket_id)",
    "ev": "SELECT q.query_id, q.r, p.func_id, q.mult, query_weight * signal / sqrt(rank + 1) AS s, query_weight * signal / sqrt(rank + 1) * greatest(0, q.idf / (SELECT p FROM idf_pivot)) AS ev FROM qhit q JOIN post p USING (bucket_id)",
    "rf": "SELECT e.*, w * mult AS rw, count(*) OVER (PARTITION BY query_id, r) AS n FROM (SELECT query_id, r, func_id, sum(s) AS s, max(ev) AS ev, min(mult) AS mult FROM ev GROUP BY ALL) e JOIN prof USING (query_id, r)",
    "a1": "SELECT query_id, func_id, count(*) AS hit_count, sum(rw) AS hit_weight, sum(rw * s) AS support_mass, sum(rw / sqrt(n)) AS selectivity_mass, max(ev) AS maxb FROM rf GROUP BY query_id, func_id",
    "a2": """SELECT *, 1 - exp(-support_mass / tqw) AS sup, selectivity_mass / tqw AS sel, least(1, support_mass / greatest(1e-6, total_support)) AS spec, least(1, hit_count / greatest(1, unit_count)) AS phr,
  least(1, hit_weight / greatest(1e-6, tqw * greatest(1, least(nrow, greatest(1, unit_count))) / greatest(1, nrow))) AS qwr
  FROM a1 JOIN (SELECT query_id, greatest(1e-6, sum(w)) AS tqw, count(*) AS nrow FROM prof GROUP BY query_id) USING (query_id) JOIN fstats USING (func_id)""",
    "a3": "SELECT *, 0.1::DOUBLE * qwr + 0.28::DOUBLE * phr + 0.2::DOUBLE * sup + 0.18::DOUBLE * spec + 0.14::DOUBLE * least(qwr, phr) + 0.1::DOUBLE * sel + 0.8::DOUBLE * least(1.5::DOUBLE, greatest(0, maxb)) AS slice_score FROM a2 JOIN functions USING (func_id)",
    "a": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(slice_score, 6) DESC, round(sup, 6) DESC, hit_count DESC, binary_name, func_addr) AS a_rank FROM a3 QUALIFY a_rank <= greatest(500, ceil(6 * sqrt((SELECT count(*) FROM functions))))",
    "sims": "SELECT a.query_id, a.func_id, u.pos, q.r, q.w, i.unit_idf, least(1, greatest(0, list_dot_product(u.emb, q.emb))) AS sim FROM a JOIN units u USING (func_id) JOIN uidf i ON i.func_id = u.func_id AND i.pos = u.pos JOIN prof q ON q.query_id = a.query_id",
    "brow": "SELECT query_id, func_id, r, max(sim) AS m, max(sim * unit_idf) AS mi, min(w) AS w FROM sims GROUP BY query_id, func_id, r",
    "bq": "SELECT query_id, func_id, sum(w * m) / greatest(1e-6, sum(w)) AS q2f, sum(w * mi) / greatest(1e-6, sum(w)) AS q2f_idf, CASE WHEN count(*) FILTER (m >= 0.5) <= 1 THEN 1.0::DOUBLE ELSE count(*) FILTER (m >= 0.5) / (max(r) FILTER (m >= 0.5) - min(r) FILTER (m >= 0.5) + 1) END AS conn FROM brow GROUP BY query_id, func_id",
    "bf": "SELECT query_id, func_id, avg(m) AS f2q, sum(i * m) / greatest(1e-6, sum(i)) AS f2q_idf FROM (SELECT query_id, func_id, pos, max(sim) AS m, min(unit_idf) AS i FROM sims GROUP BY query_id, func_id, pos) GROUP BY query_id, func_id",
    "b0": "SELECT a.query_id, a.func_id, a.slice_score, a.hit_count, a.binary_name, a.func_addr, a.func_name, bq.q2f, bq.q2f_idf, bq.conn, bf.f2q, bf.f2q_idf, least(1, greatest(0, list_dot_product(g.emb, q.gq))) AS global_sim, least(q2f, f2q) AS alignment FROM a JOIN bq USING (query_id, func_id) JOIN bf USING (query_id, func_id) JOIN globals g ON g.func_id = a.func_id JOIN queries q ON q.query_id = a.query_id",
    "b1": "SELECT *, q2f + 0.8::DOUBLE * greatest(0, f2q_idf - q2f) AS slice_channel FROM b0",
    "b2": "SELECT *, 0.05::DOUBLE * slice_score + (0.85::DOUBLE - 0.55::DOUBLE * alignment) * slice_channel + (0.05::DOUBLE + 0.6::DOUBLE * alignment) * global_sim AS score FROM b1",
    "b": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, round(slice_channel, 6) DESC, round(global_sim, 6) DESC, round(slice_score, 6) DESC, binary_name, func_addr) AS rank FROM b2",
    "gtkeys": "SELECT DISTINCT q.query_id, q.gt_type, f2.func_id FROM queries q JOIN functions f1 ON f1.func_id = q.gt_func JOIN functions f2 ON f2.func_name = f1.func_name OR f2.func_id = f1.func_id",
    "gtrank": "SELECT q.query_id, q.gt_type, min(b.rank) AS gt_rank FROM queries q LEFT JOIN gtkeys k USING (query_id) LEFT JOIN b ON b.query_id = k.query_id AND b.func_id = k.func_id GROUP BY q.query_id, q.gt_type",
}


def sql(body: str) -> str:
    """body with the stages it builds on, and theirs, in front."""
    import re

    need: list[str] = []

    def add(text: str) -> None:
        for name in reversed(CTES):
            if name not in need and re.search(rf"\b(FROM|JOIN|,)\s*{name}\b", text):
                need.append(name)
                add(CTES[name])

    add(body)
    used = [n for n in CTES if n in need]
    body = body.strip()
    if not used:
        return body
    head = ", ".join(f"{n} AS ({CTES[n]})" for n in used)
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
